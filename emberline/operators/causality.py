"""Causal walks over the provenance graph, merged reports of one start, and groups that share a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.stateful import folded
from emberline.plans.lineage import cut, held, replaced

HOUR = 3_600_000_000
SECOND = 1_000_000
#: Processes that a walk may reach but does not go through.
BOUNDARY = ("system", "smss.exe", "csrss.exe", "wininit.exe", "winlogon.exe", "services.exe", "svchost.exe", "lsass.exe", "userinit.exe", "explorer.exe", "sihost.exe", "runtimebroker.exe", "taskhostw.exe", "taskeng.exe", "wmiprvse.exe", "dllhost.exe", "systemd", "init", "sshd", "cron", "crond")


def flows(events: DataFrame) -> DataFrame:
    """src, dst, us: the way that influence goes. A process writes a file or forks a child; a file is executed by a process."""
    process = lambda p: F.concat_ws(":", "host_id", F.col(p).cast("string"))
    file = F.concat_ws("|", "host_id", F.lower("path"))
    start = F.col("event_type") == "process_create"
    hops = F.array_compact(
        F.array(
            F.when(start & (F.col("ppid") != F.col("pid")), F.struct(process("ppid").alias("src"), process("pid").alias("dst"))),
            F.when(start & F.col("path").isNotNull(), F.struct(file.alias("src"), process("pid").alias("dst"))),
            F.when(F.col("event_type").isin("file_create", "file_rename") & F.col("path").isNotNull(), F.struct(process("pid").alias("src"), file.alias("dst"))),
        )
    )
    return events.select("us", F.explode(hops).alias("h")).select("h.src", "h.dst", "us").distinct()


def walk(starts: DataFrame, flow: DataFrame, back: bool, depth: int = 12, span: int = 6 * HOUR, stop: DataFrame | None = None) -> DataFrame:
    """anchor, node, lo, hi, depth: what each anchor reaches by steps that never go back (or, back, forward) in time.

    starts: anchor, node, lo, hi. A step backward takes an edge into a node between lo and hi, and hi becomes its time; a step forward one
    out of a node, and lo becomes its time. For a node only the widest interval so far goes on: a narrower one later reaches nothing more.
    Edges are joined by node and bucket of time, so a node that very many edges share is spread, and each level is one join and two
    aggregations. stop: nodes that are reached but not gone through.
    """
    near, far = ("dst", "src") if back else ("src", "dst")
    hops = flow.select(F.col(near).alias("node"), F.col(far).alias("next"), "us", F.floor(F.col("us") / span).alias("_b"))
    hops = held(hops if stop is None else hops.join(stop.select("node").distinct(), "node", "left_anti"))
    # what each level adds is written once, and the widest so far is told from all levels by the shuffle that its join needs anyway
    widest = lambda rows: rows.groupBy("anchor", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("depth").alias("depth"))
    front = held(widest(starts.select("anchor", "node", "lo", "hi", F.lit(0).alias("depth"))))
    reached = front
    for level in range(1, depth + 1):
        buckets = F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span)))
        got = front.withColumn("_b", buckets).join(hops, ["node", "_b"]).where(F.col("us").between(F.col("lo"), F.col("hi")))
        step = got.groupBy("anchor", F.col("next").alias("node")).agg(*((F.min("lo").alias("lo"), F.max("us").alias("hi")) if back else (F.min("us").alias("lo"), F.max("hi").alias("hi"))))
        known = widest(reached).select("anchor", "node", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        front = held(step.join(known, ["anchor", "node"], "left").where("_lo is null or lo < _lo or hi > _hi").select("anchor", "node", "lo", "hi", F.lit(level).alias("depth")))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    replaced(hops)
    return widest(reached)


def merged_starts(starts: DataFrame, keys: list[str], same: list[str], fill: list[str], gap: int = SECOND) -> DataFrame:
    """Starts that several sensors report become one: same keys, at most `gap` after the first report, and equal `same` where both are known.

    Columns of `fill` take their first known value in order of time. Reports counts what went into a row, event_id is that of the first.
    """

    def step(state, row):
        near = [r for r in state if row.us - r[0] <= gap]
        own = tuple(getattr(row, c) for c in same)
        for i, (first, event, known) in enumerate(near):
            if all(a is None or b is None or a == b for a, b in zip(own, known, strict=True)):
                near[i] = (first, event, tuple(b if b is not None else a for a, b in zip(own, known, strict=True)))
                return near, {"event_id": row.event_id, "run": event}
        return [*near, (row.us, row.event_id, own)], {"event_id": row.event_id, "run": row.event_id}

    kind = dict(starts.dtypes)["event_id"]
    rows = starts.select(*keys, "us", "event_id", *[F.col(c).cast("string").alias(c) for c in same])
    runs = folded(rows, keys, ["us", "event_id"], [], step, f"event_id {kind}, run {kind}")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("us", "event_id", c)))[c].alias(c)
    return starts.join(runs, "event_id").groupBy(*keys, "run").agg(F.min("us").alias("us"), F.count("*").alias("reports"), *[first(c) for c in fill]).withColumnRenamed("run", "event_id")


def template_groups(rows: DataFrame, item: str, template: str) -> DataFrame:
    """item, group: items that share a template, or are linked by a chain of such, have the same smallest item.

    The smallest item goes over to templates and back until nothing changes; each round also jumps to the group of the group, so long
    chains take few rounds. An item or template of very many rows is aggregated partially before it is shuffled.
    """
    links = cut(rows.where(F.col(item).isNotNull() & F.col(template).isNotNull()).select(F.col(item).alias("item"), F.col(template).alias("template")).distinct())
    state = cut(links.select("item", F.col("item").alias("group")).distinct())
    while True:
        least = links.join(state, "item").groupBy("template").agg(F.min("group").alias("group"))
        moved = links.join(least, "template").groupBy("item").agg(F.min("group").alias("group"))
        jump = moved.select(F.col("item").alias("group"), F.col("group").alias("above"))
        after = cut(moved.join(jump, "group", "left").select("item", F.least("group", "above").alias("group")))
        changed = after.join(state.withColumnRenamed("group", "before"), "item").where(F.col("group") != F.col("before"))
        if changed.isEmpty():
            return after
        state = after
