"""What follows from detections: stages and scores of incidents, responses, delivery of alerts, and model scores as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.storyline import BANDS


def stages(hits: DataFrame) -> DataFrame:
    """The first hit of each rule in each process."""
    first = hits.groupBy("host_id", "pid", "rule_id").agg(F.min(F.struct("us", "event_id", "level", "tactic")).alias("f"))
    return first.select("host_id", "pid", "rule_id", "f.us", "f.event_id", "f.level", "f.tactic")


def scored(level: Column, tactics: Column, context: Column | float = 0.0) -> Column:
    """Score of an incident: of its highest level, its number of tactics, and what its context adds, up to a quarter."""
    more = context if isinstance(context, Column) else F.lit(context)
    return F.round(F.round(0.45 * F.least(level / 16, F.lit(1.0)), 3) + F.round(0.30 * F.least(tactics, F.lit(5)) / 5, 3) + F.round(F.least(more, F.lit(0.25)), 3), 3)


def banded(score: Column) -> Column:
    """The band of a score; the values are those of storyline.BANDS."""
    return reduce(lambda made, b: made.when(score >= b[0], b[1]), BANDS[1:], F.when(score >= BANDS[0][0], BANDS[0][1]))


def incident_scores(stages_: DataFrame) -> DataFrame:
    """host_id, stages, tactics, score and band: from the highest level and the number of tactics."""
    out = stages_.groupBy("host_id").agg(F.count("*").alias("stages"), F.count_distinct("tactic").alias("tactics"), F.max("level").alias("level"))
    score = scored(F.col("level"), F.col("tactics"))
    return out.select("host_id", "stages", "tactics", score.alias("score"), banded(score).alias("band"))


def response(level: Column, pid: Column) -> Column:
    """What a level alone recommends; alerts.response() knows the rule's own action, too."""
    return F.when(level.between(12, 13) & pid.isNotNull(), "terminate_process").when(level >= 14, "isolate_host")


def risk_index(hits: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The largest score and a fifth of the rest."""
    return hits.groupBy(*keys).agg(F.round(F.max(score) + 0.2 * (F.sum(score) - F.max(score)), 6).alias("risk_index"))


def undelivered(alerts: DataFrame, delivered: DataFrame) -> DataFrame:
    """Alerts whose id is not delivered yet, each once."""
    return alerts.dropDuplicates(["alert_id"]).join(delivered.select("alert_id"), "alert_id", "left_anti")


def claim(spool: DataFrame, now: Column, n: int) -> DataFrame:
    """The n oldest alerts that are due: here the limit is the feature."""
    return spool.where((F.col("status") == "pending") & (F.col("next_attempt_us") <= now)).orderBy("created_us", "alert_id").limit(n)


def tree_score(trees: list[dict]) -> Column:
    """A sum of trees as nested conditions. A node is {feature, threshold, left, right} or {value}; a missing feature counts as 0."""

    def node(t: dict) -> Column:
        if "value" in t:
            return F.lit(float(t["value"]))
        return F.when(F.coalesce(F.col(t["feature"]).cast("double"), F.lit(0.0)) <= t["threshold"], node(t["left"])).otherwise(node(t["right"]))

    return reduce(lambda a, b: a + b, [node(t) for t in trees])


def grams(command: Column) -> Column:
    """Distinct words and pairs of neighbouring words of a command line, sorted."""
    words = F.regexp_extract_all(F.lower(command), F.lit(r"([a-z0-9_.]+)"), 1)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(words, pairs)))
