"""Counts of behaviour, rarity, coverage and the measures by which detectors are judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def behaviour(events: DataFrame) -> DataFrame:
    """What each process of a host did, counted in one aggregation."""
    of = lambda t: F.count_if(F.col("event_type") == t)
    return events.groupBy("host_id", "pid").agg(of("process_create").alias("children"), of("network_connect").alias("connections"), of("file_create").alias("file_writes"), of("file_rename").alias("renames"), of("registry_write").alias("registry_writes"), F.count_distinct("query_name").alias("domains"), F.least(F.count_distinct("path"), F.lit(10)).alias("paths"))


def rarity(events: DataFrame) -> DataFrame:
    """dimension, value, n of process starts: the baseline, by one pass with grouping sets."""
    starts = events.where("event_type = 'process_create' and process_name is not null").select("process_name", F.concat_ws(">", F.col("ppid").cast("string"), "process_name").alias("pair"))
    rows = starts.select(F.explode(F.array(F.struct(F.lit("name").alias("dimension"), F.col("process_name").alias("value")), F.struct(F.lit("parent_child").alias("dimension"), F.col("pair").alias("value")))).alias("r")).select("r.*")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def rated(values: DataFrame, baseline: DataFrame, ready: int = 200) -> DataFrame:
    """Adds n and category (not_ready, unseen, uncommon, common) to rows of dimension and value."""
    total = baseline.where("dimension = 'name'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = values.join(baseline, ["dimension", "value"], "left").join(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("category", F.when(F.col("total") < ready, "not_ready").when(F.col("n") == 0, "unseen").when(F.col("n") <= 2, "uncommon").otherwise("common")).drop("total")


def observed_seconds(events: DataFrame, most: int = 3600) -> DataFrame:
    """Time that each host was observed: gaps count up to `most` seconds."""
    w = Window.partitionBy("host_id").orderBy("us", "event_id")
    gap = (F.col("us") - F.lag("us").over(w)) / 1e6
    return events.select("host_id", F.least(gap, F.lit(float(most))).alias("g")).groupBy("host_id").agg(F.round(F.sum("g"), 3).alias("seconds"))


def census(events: DataFrame) -> DataFrame:
    """family, events and hours: how much of each family of events there is, and the hours of the hosts that have it."""
    family = F.split_part("event_type", F.lit("_"), F.lit(1))
    hours = observed_seconds(events).select("host_id", F.round(F.coalesce("seconds", F.lit(0.0)) / 3600, 4).alias("hours"))
    by = events.groupBy("host_id", family.alias("family")).agg(F.count("*").alias("n")).join(hours, "host_id")
    return by.groupBy("family").agg(F.sum("n").alias("events"), F.round(F.sum("hours"), 2).alias("hours"))


def consistent(rows: DataFrame, key: list[str], label: str, order: list[str]) -> DataFrame:
    """The first row of each key; keys with more than one label are left out."""
    agreed = rows.groupBy(*key).agg(F.min(label).alias("_a"), F.max(label).alias("_b"), F.min(F.struct(*order, label)).alias("r")).where("_a = _b")
    return agreed.select(*key, *[F.col(f"r.{c}").alias(c) for c in (*order, label)])


def capped(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group: here the limit is the feature."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """positives, negatives, auc: from the counts of each score, so the window runs over distinct scores alone."""
    by = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = by.withColumn("q", F.col("n") - F.col("p")).withColumn("under", F.coalesce(F.sum("q").over(w), F.lit(0)))
    sums = below.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)).alias("s"))
    return sums.select("positives", "negatives", F.round(F.col("s") / (F.col("positives") * F.col("negatives")), 6).alias("auc"))


def threshold_for_budget(rows: DataFrame, budget: float, score: str = "score", label: str = "label") -> DataFrame:
    """The lowest score at which the false positives at or above it are within budget; ties go together."""
    by = rows.groupBy(score).agg(F.count_if(F.col(label) == 0).alias("fp"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("total", F.sum("fp").over(w)).where(F.col("total") <= budget).agg(F.min(score).alias("threshold"), F.max("total").alias("false_positives"))


def tokens(events: DataFrame, most: int = 100) -> DataFrame:
    """Event types of each process in order, repeats in a row once, the first `most` of them."""
    w = Window.partitionBy("host_id", "pid").orderBy("us", "event_id")
    new = events.withColumn("before", F.lag("event_type").over(w)).where("before is null or before <> event_type")
    first = new.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return first.groupBy("host_id", "pid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "event_type"))), lambda x: x["event_type"]), ",").alias("tokens"))


def first_bits(events: DataFrame, most: int = 8) -> DataFrame:
    """When each process first showed each behaviour, the first `most` of them."""
    first = events.groupBy("host_id", "pid", "event_type").agg(F.min("us").alias("first_us"))
    return capped(first, ["host_id", "pid"], ["first_us", "event_type"], most)


def pr_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """positives, average_precision: by distinct scores, ties together."""
    by = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cum = by.withColumns({"tp": F.sum("p").over(w), "all": F.sum("n").over(w)})
    return cum.agg(F.sum("p").alias("positives"), F.round(F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.sum("p"), 6).alias("average_precision"))


def calibration_error(rows: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """n, ece: the weighted gap of mean score and share of positives in bins of equal width."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    by = rows.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(F.col(label).cast("double")).alias("y"))
    return by.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


def at_threshold(rows: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """recall and precision of scores at or above a threshold."""
    over, positive = F.col(score) >= threshold, F.col(label) == 1
    tp = F.count_if(over & positive)
    return rows.agg(F.round(F.try_divide(tp, F.count_if(positive)), 6).alias("recall"), F.round(F.try_divide(tp, F.count_if(over)), 6).alias("precision"))


def bootstrap(rows: DataFrame, group: str, value: str, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """mean, low, high: an interval of the mean from resampled groups.

    Rows are summed by group first; a group's weight in a resample is a Poisson count from a hash of the group and its number, so nothing
    is drawn twice differently when a task runs again.
    """
    sums = rows.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = F.pmod(F.xxhash64(F.col(group), F.col("b")), F.lit(1 << 40)) / float(1 << 40)
    share, weight = 0.36787944117144233, F.lit(0)
    total = share
    for k in range(1, 9):
        weight = F.when(u >= total, k).otherwise(weight) if k == 1 else F.when(u >= total, F.lit(k)).otherwise(weight)
        share /= k
        total += share
    means = sums.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).join(F.broadcast(ends))


def units(rows: DataFrame, keys: list[str], at: str, item: str) -> DataFrame:
    """One row for each key with the earliest item and a count."""
    return rows.groupBy(*keys).agg(F.min(F.struct(at, item)).alias("f"), F.count("*").alias("n")).select(*keys, f"f.{at}", f"f.{item}", "n")


def latency(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, total, least, most, p50 and p95 of a measure."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))
