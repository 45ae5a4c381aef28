"""Process identity: which run of a pid an event belongs to, told from starts, stops and mentions; and what follows for joins.

A host's pid is followed in order of time by one ordered fold whose state is a few values. Everything else is set-based.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import joins
from emberline.operators.causality import BOUNDARY
from emberline.operators.stateful import SECOND, folded
from emberline.plans.lineage import cut, stored

#: A process that is not seen to end counts as running for so long.
LIFETIME = 86_400 * SECOND
#: Order of what one event says about a pid.
ORDER = {"parent": 0, "start": 1, "context": 2, "reference": 3, "stop": 4}
#: What is known of a process, besides its name and its parent's pid.
FACTS = ("process_name", "executable", "command_line", "user", "sha256", "start_time_ticks", "process_guid")


def iso(us: Column) -> Column:
    """A time in microseconds as text without a zone; whole seconds have no fraction."""
    part = F.pmod(us, F.lit(SECOND))
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))))


def node_id(host: Column, pid: Column, start_us: Column) -> Column:
    return F.concat(F.lit("proc_"), F.substring(F.sha2(F.concat_ws("|", host, pid.cast("string"), iso(start_us)), 256), 1, 32))


def follow(state: dict[str, Any], us: int, kind: str, name: str | None, ppid: str | None) -> tuple[dict[str, Any], int | None, bool]:
    """A pid of a host, and one more mention of it: the new state, the start of the run that is meant, and whether it opens one.

    A start closes the run before, unless it reports one again: within a second, with the same parent and name where both are known. A mention
    that no run covers opens an inferred one a microsecond before. A stop closes the run that it meets, if any.
    """
    start, end = state.get("start"), state.get("end")
    live = start is not None and start <= us and (us < end if end is not None else us - start <= LIFETIME)
    if kind == "start":
        recent = [r for r in state.get("recent", ()) if us - r[0] <= SECOND]
        for i, (at, known, parent) in enumerate(recent):
            if not (name and known and name != known) and not (ppid and parent and ppid != parent):
                recent[i] = (at, known or name, parent or ppid)
                return state | {"recent": recent}, at, False
        return {"start": us, "end": None, "recent": [*recent, (us, name, ppid)]}, us, True
    if kind == "stop":
        return (state | {"end": us}, start, False) if live else (state, None, False)
    if live:
        return state, start, False
    return {"start": us - 1, "end": None, "recent": state.get("recent", [])}, us - 1, True


def mentions(events: DataFrame) -> DataFrame:
    """event_id, kind, host_id, pid, us, name, ppid, parent_name and facts (JSON): a row for each process that an event names.

    events: event_id, event_type, host_id, pid, us; ppid, parent_name, target_pid, target_path and the facts where there are such columns.
    """
    have = lambda c, t="string": F.col(c).cast(t) if c in events.columns else F.lit(None).cast(t)
    kind = F.when(F.col("event_type") == "process_create", "start").when(F.col("event_type") == "process_terminate", "stop").otherwise("context")
    facts = F.to_json(F.struct(*[have(c).alias(c) for c in FACTS]))
    own = F.struct(kind.alias("kind"), F.col("pid").cast("long").alias("pid"), F.lower(have("process_name")).alias("name"), have("ppid").alias("ppid"), F.lower(have("parent_name")).alias("parent_name"), facts.alias("facts"))
    none = F.lit(None).cast("string")
    parent = F.struct(F.lit("parent").alias("kind"), have("ppid", "long").alias("pid"), F.lower(have("parent_name")).alias("name"), none.alias("ppid"), none.alias("parent_name"), none.alias("facts"))
    leaf = F.lower(F.nullif(F.element_at(F.split(F.replace(have("target_path"), F.lit("\\"), F.lit("/")), "/"), -1), F.lit("")))
    target = F.struct(F.lit("reference").alias("kind"), have("target_pid", "long").alias("pid"), leaf.alias("name"), none.alias("ppid"), none.alias("parent_name"), F.to_json(F.struct(have("target_path").alias("executable"))).alias("facts"))
    said = F.array_compact(F.array(own, F.when(kind == "start", parent), F.when(F.col("event_type").isin("process_access", "remote_thread"), target)))
    return events.select("event_id", "host_id", "us", F.explode(said).alias("m")).select("event_id", "host_id", "us", "m.*").where("pid is not null and us is not null and host_id is not null")


#: Columns of mentions that only say something of the run that they open or report.
SAID = ("name", "ppid", "parent_name", "facts")


def _followed(rows: DataFrame, opening: bool = False) -> DataFrame:
    """Mentions with start_us and opens; what is said of a run goes with those that open or report one. opening: only those that open one."""
    said = [c for c in SAID if c in rows.columns]
    out = f"event_id {dict(rows.dtypes)['event_id']}, kind string, host_id string, pid long, us long, start_us long, opens boolean, " + ", ".join(f"{c} string" for c in said)

    def step(state, row):
        state, start, opens = follow(state, row.us, row.kind, row.name, row.ppid)
        if start is None or (opening and not opens):
            return state, None
        says = opens or row.kind == "start"
        made = {"event_id": row.event_id, "kind": row.kind, "host_id": row.host_id, "pid": row.pid, "us": row.us, "start_us": start, "opens": opens}
        return state, made | {c: getattr(row, c) if says else None for c in said}

    place = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in ORDER.items()])
    return folded(rows.withColumn("o", place), ["host_id", "pid"], ["us", "o", "event_id"], {}, step, out)


def resolved(events: DataFrame) -> DataFrame:
    """The mentions of events with the start of the run that each means (start_us) and whether it opens it; with names and facts if it opens or reports it.

    An inferred run names its parent, too, which may have to be inferred in turn: hence a second pass with these mentions.
    """
    first = _followed(mentions(events).drop("facts"), opening=True)
    none = F.lit(None).cast("string")
    above = first.where("opens and kind = 'context' and ppid is not null").select("event_id", F.lit("parent").alias("kind"), "host_id", F.col("ppid").cast("long").alias("pid"), (F.col("us") - 1).alias("us"), F.col("parent_name").alias("name"), none.alias("ppid"), none.alias("parent_name"), none.alias("facts"))
    return stored(_followed(mentions(events).unionByName(cut(above))))


def incarnations(found: DataFrame) -> DataFrame:
    """Runs of pids of resolved(): node_id, host_id, pid, start_us, end_us, end_observed, inferred, name, ppid, parent_node_id and facts.

    Of what several reports say the first known value counts. A parent is the run of its pid that is live when the child starts.
    """
    fact = {c: F.get_json_object("facts", f"$.{c}") for c in FACTS[1:]}
    says = F.col("kind").isin("start") | F.col("opens")
    known = lambda c, col: F.min(F.when(says & col.isNotNull() & (col != ""), F.struct("us", "event_id", col.alias("v"))))["v"].alias(c)
    runs = found.groupBy("host_id", "pid", "start_us").agg(
        F.bool_and(F.col("kind") != "start").alias("inferred"),
        F.min(F.when(F.col("kind") == "stop", F.col("us"))).alias("stop_us"),
        known("name", F.col("name")),
        known("ppid", F.col("ppid")),
        *[known(c, x) for c, x in fact.items()],
    )
    after = F.lead("start_us").over(Window.partitionBy("host_id", "pid").orderBy("start_us"))
    runs = runs.withColumns({"end_us": F.least("stop_us", after), "end_observed": F.col("stop_us").isNotNull(), "node_id": node_id(F.col("host_id"), F.col("pid"), F.col("start_us")), "ppid": F.col("ppid").cast("long")}).drop("stop_us")
    asked = runs.withColumn("_at", F.when(F.col("ppid") == F.col("pid"), F.col("start_us") - 1).otherwise(F.col("start_us")))  # no run is its own parent
    return live_at(asked, as_runs(runs), "ppid", "_at").withColumnRenamed("match_node_id", "parent_node_id").drop("_at")


def live_at(rows: DataFrame, runs: DataFrame, pid: str, at: str) -> DataFrame:
    """Rows with the node (match_node_id) of the run of their host and pid that is live at a time. runs: host_id, _pid, since, end_us, node_id."""
    left = rows.withColumn("_key", F.col(pid).cast("long"))
    got = joins.as_of(left, runs.select("host_id", F.col("_pid").alias("_key"), "since", F.col("end_us").alias("until"), "node_id"), ["host_id", "_key"], at, "since", ["until", "node_id"])
    live = F.when(F.col("match_until").isNull(), F.col(at) - F.col("match_since") <= LIFETIME).otherwise(F.col(at) < F.col("match_until"))
    return got.withColumn("match_node_id", F.when(live & F.col("_key").isNotNull(), F.col("match_node_id"))).drop("_key", "match_since", "match_until")


def as_runs(runs: DataFrame) -> DataFrame:
    """incarnations() as live_at() takes them."""
    return runs.select("host_id", F.col("pid").alias("_pid"), F.col("start_us").alias("since"), "end_us", "node_id")


def lineage(runs: DataFrame) -> DataFrame:
    """node_id, ancestor_names (parent first), depth, lineage (root first), root_node_id and root_name of runs.

    The root is the topmost ancestor, or the run itself, below the first boundary process.
    """
    chain = joins.ancestors(runs.where("parent_node_id is not null").select(F.col("node_id").alias("node"), F.col("parent_node_id").alias("parent")))
    names = runs.select(F.col("node_id").alias("ancestor"), "name")
    up = chain.join(names, "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "name", "ancestor"))).alias("l"))
    hub = lambda x: F.coalesce(x["name"].isin(*BOUNDARY), F.lit(False))
    first = F.coalesce(F.array_min(F.transform(F.filter("l", hub), lambda x: x["level"])), F.lit(1 << 30))
    below = F.filter("l", lambda x: x["level"] < first)
    top = F.when(F.size(below) > 0, F.element_at(below, -1))
    tree = up.select(F.col("node").alias("node_id"), F.transform("l", lambda x: x["name"]).alias("ancestor_names"), F.size("l").alias("depth"), top["ancestor"].alias("_root"), top["name"].alias("_root_name"))
    empty = F.array().cast("array<string>")
    out = runs.select("node_id", "name").join(tree, "node_id", "left").withColumn("ancestor_names", F.coalesce("ancestor_names", empty))
    line = F.array_join(F.filter(F.reverse(F.concat(F.array("name"), F.col("ancestor_names"))), lambda x: x.isNotNull() & (x != "")), " -> ")
    return out.select("node_id", "ancestor_names", F.coalesce("depth", F.lit(0)).alias("depth"), line.alias("lineage"), F.coalesce("_root", "node_id").alias("root_node_id"), F.when(F.col("_root").isNotNull(), F.col("_root_name")).otherwise(F.col("name")).alias("root_name"))


def with_ticks(alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts (host_id, target_pid, us, target_start_time_ticks) whose missing token is that of the run of the pid that is live then, as it was reported."""
    got = live_at(alerts, as_runs(runs), "target_pid", "us").withColumnRenamed("match_node_id", "node_id")
    return got.join(runs.select("node_id", F.col("start_time_ticks").cast("long").alias("_ticks")), "node_id", "left").withColumn("target_start_time_ticks", F.coalesce("target_start_time_ticks", "_ticks")).drop("_ticks", "node_id")


def closure(links: DataFrame) -> DataFrame:
    """node, ancestor, level of links node, parent, to any depth; a cycle ends where it comes round."""
    step = cut(links.where("node is not null and parent is not null and node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("level")).distinct())
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    out = step
    level = 1
    while True:
        level += 1
        reached = step.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(level).alias("level")).where("node <> ancestor").distinct()
        step = cut(reached.join(out.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if step.isEmpty():
            return out
        out = cut(out.unionByName(step))


def own_children(starts: DataFrame, spans: DataFrame, stops: DataFrame, default: int) -> DataFrame:
    """Starts (host_id, pid, ppid, us, event_id) that come, at any remove, from processes alive in spans (host_id, pid, since, until).

    What such a start begins is alive until its pid's next stop (host_id, pid, us), or for `default` microseconds.
    """
    ends = stops.select("host_id", "pid", F.col("us").alias("stop_us"))
    front, found = spans.select("host_id", "pid", "since", "until"), None
    while True:
        alive = front.select("host_id", F.col("pid").alias("ppid"), "since", "until")
        hit = starts.join(alive, ["host_id", "ppid"]).where("us between since and until").select(*starts.columns).dropDuplicates(["event_id"])
        hit = cut(hit if found is None else hit.join(found.select("event_id"), "event_id", "left_anti"))
        if hit.isEmpty():
            return found if found is not None else hit
        found = hit if found is None else cut(found.unionByName(hit))
        later = hit.join(ends, ["host_id", "pid"], "left").groupBy("host_id", "pid", "us", "event_id").agg(F.min(F.when(F.col("stop_us") >= F.col("us"), F.col("stop_us"))).alias("stop_us"))
        front = later.select("host_id", "pid", F.col("us").alias("since"), F.coalesce("stop_us", F.col("us") + default).alias("until"))


def side(rows: DataFrame, table: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """Rows with columns of a side table of the same keys (integrity levels by event, canonical events by record, labels by host, pid and time)."""
    return rows.join(table.select(*keys, *take).dropDuplicates(keys), keys, "left")
