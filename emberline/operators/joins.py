"""As-of, interval and band joins, closures, and the provenance graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.lineage import held

DAY = 86_400_000_000


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, take: list[str], at_most: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its keys whose `since` is not after its `at`: one shuffle by the keys, no range join."""
    tagged = left.withColumns({"_t": F.col(at), "_o": F.lit(1), "_r": F.lit(None).cast(right.select(F.struct(since, *take)).schema[0].dataType)})
    other = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_o"), F.struct(since, *take).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(other, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_o = 1")
    keep = F.lit(True) if at_most is None else (F.col("_t") - F.col(f"_r.{since}") <= at_most)
    return both.select(*left.columns, *[F.when(keep, F.col(f"_r.{c}")).alias(f"match_{c}") for c in (since, *take)])


def incarnations(events: DataFrame) -> DataFrame:
    """Process starts as intervals: each ends where the next of its host and pid starts, or stays open."""
    w = Window.partitionBy("host_id", "pid").orderBy("us", "event_id")
    starts = events.where("event_type = 'process_create'")
    return starts.select("host_id", "pid", "ppid", F.col("us").alias("start_us"), F.lead("us").over(w).alias("end_us"), "event_id", "process_name", F.concat(F.lit("proc_"), F.substring(F.sha2(F.concat_ws("|", "host_id", "pid", "us"), 256), 1, 32)).alias("node_id"))


def band(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: int) -> DataFrame:
    """Pairs whose times are at most `width` apart: an equi-join on keys and buckets of time, each right row in three of them."""
    l = left.withColumn("_b", F.floor(F.col(a) / width))
    r = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col(b) / width) + i for i in (-1, 0, 1)])))
    return l.join(r, [*keys, "_b"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_b")


def ancestors(edges: DataFrame, depth: int = 16) -> DataFrame:
    """node, ancestor, level of parent edges (node, parent): a bounded closure, one join for each level, without revisits."""
    step = edges.where("node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("level"), F.array("node", "parent").alias("path"))
    out, up = step, edges.where("node <> parent").select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    for i in range(2, depth + 1):
        step = step.join(up, "ancestor").where(~F.array_contains("path", F.col("next"))).select("node", F.col("next").alias("ancestor"), F.lit(i).alias("level"), F.concat("path", F.array("next")).alias("path"))
        if i <= 6 or i % 4 == 0:  # long chains end early, plans stay small, and few levels are on their way at once
            step = held(step)
            if step.isEmpty():
                break
        out = out.unionByName(step)
    return out.select("node", "ancestor", "level")


#: Edge kind and target of event types.
EDGES = {"network_connect": ("connected_to", "destination_ip"), "file_create": ("wrote", "path"), "file_rename": ("renamed", "path"), "registry_write": ("set_value", "path"), "process_create": ("executed", "path")}


def edges(events: DataFrame) -> DataFrame:
    """edge_id, kind, src, dst, us, host_id of events that have a target."""
    kind = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(k)) for t, (k, _) in EDGES.items()])
    target = F.coalesce(*[F.when(F.col("event_type") == t, F.col(c)) for t, (_, c) in EDGES.items()])
    src = F.concat_ws(":", "host_id", "pid")
    return events.select(kind.alias("kind"), src.alias("src"), F.lower(target).alias("dst"), "us", "host_id", "event_id").where("kind is not null and dst is not null").withColumn("edge_id", F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("|", "kind", "src", "dst", "us", "event_id"), 256), 1, 32))).dropDuplicates(["edge_id"])


def nodes(edges_: DataFrame) -> DataFrame:
    """label, first_us, degree of the ends of edges."""
    both = edges_.select(F.col("src").alias("label"), "us").unionByName(edges_.select(F.col("dst").alias("label"), "us"))
    return both.groupBy("label").agg(F.min("us").alias("first_us"), F.count("*").alias("degree"))
