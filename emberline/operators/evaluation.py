"""How detectors are judged, and the workflow from labelled rows to a frozen model: labels, folds, thresholds, intervals, probes, bundles."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators.identity import closure

# ---- intervals


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _poisson(k: int, rate: float) -> float:
    """The probability of k events or fewer."""
    return sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1)) if rate > 0 else 1.0


def _root(f: Callable[[float], float], low: float, high: float) -> float:
    """Where a falling function is zero."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float] | None:
    """The exact interval of a share of k among n."""
    if not n:
        return None
    tail = (1 - level) / 2
    low = 0.0 if k == 0 else _root(lambda p: tail - _beta(p, k, n - k + 1), 0, 1)
    high = 1.0 if k == n else _root(lambda p: (1 - tail) - _beta(p, k + 1, n - k), 0, 1)
    return round(low, 4), round(high, 4)


def poisson_interval(k: int, hours: float, level: float = 0.95) -> tuple[float, float] | None:
    """The exact interval of a rate of k events in so many hours."""
    if not hours:
        return None
    tail, most = (1 - level) / 2, k + 10 * math.sqrt(k + 1) + 20
    low = 0.0 if k == 0 else _root(lambda r: tail - (1 - _poisson(k - 1, r)), 0, most)
    return round(low / hours, 4), round(_root(lambda r: _poisson(k, r) - tail, 0, most) / hours, 4)


def with_intervals(rows: DataFrame, hits: str, n: str, events: str, hours: str) -> DataFrame:
    """Adds share_low, share_high (of hits among n) and rate_low, rate_high (of events in hours) to aggregated rows."""

    @F.pandas_udf("struct<share_low:double,share_high:double,rate_low:double,rate_high:double>")
    def ends(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = [(clopper_pearson(int(x), int(y)) or (None, None)) + (poisson_interval(int(z), float(h)) or (None, None)) for x, y, z, h in zip(a, b, c, d, strict=True)]
        return pd.DataFrame(out, columns=["share_low", "share_high", "rate_low", "rate_high"])

    return rows.withColumn("_e", ends(F.col(hits), F.col(n), F.col(events), F.col(hours).cast("double"))).select("*", "_e.*").drop("_e")


# ---- measures by distinct score, without a window over all of them in one task


def running(by: DataFrame, order: str, sums: list[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """Adds before_<sum> to rows of distinct `order` values: what all earlier rows sum to.

    Rows are dealt out by ranges of `order`; a task sums its range, and the sums of whole ranges before it, a row for each, are added.
    """
    key = F.desc(order) if descending else F.asc(order)
    dealt = by.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    whole = dealt.groupBy("_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums], (F.max if descending else F.min)(order).alias("_first"))  # a row for each part
    w = Window.orderBy(F.desc("_first") if descending else F.asc("_first")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.select("_part", *[F.coalesce(F.sum(f"_{s}").over(w), F.lit(0)).alias(f"_{s}") for s in sums])
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(ahead), "_part")
    return out.select(*by.columns, *[(F.col(f"_{s}") + F.coalesce(F.sum(s).over(own), F.lit(0))).alias(f"before_{s}") for s in sums])


def partial_auc(rows: DataFrame, most_fpr: float, score: str = "score", label: str = "label") -> DataFrame:
    """auc: the area up to a rate of false positives, put on the scale where chance is 0.5 and the best is 1."""
    by = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    cum = running(by, score, ["p", "q"], descending=True)
    total = rows.agg(F.sum(F.col(label).cast("long")).alias("all_p"), F.count_if(F.col(label) == 0).alias("all_q"))  # one row
    x0, x1 = F.col("before_q") / F.col("all_q"), (F.col("before_q") + F.col("q")) / F.col("all_q")
    y0, y1 = F.col("before_p") / F.col("all_p"), (F.col("before_p") + F.col("p")) / F.col("all_p")
    end = F.least(x1, F.lit(most_fpr))
    y_end = F.when(x1 > x0, y0 + (y1 - y0) * (end - x0) / (x1 - x0)).otherwise(y1)
    area = F.sum(F.when(x0 < most_fpr, (end - x0) * (y0 + y_end) / 2))
    least = most_fpr**2 / 2
    return cum.join(F.broadcast(total)).agg(F.round(0.5 * (1 + (area - least) / (most_fpr - least)), 6).alias("auc"))


def thresholds(rows: DataFrame, budgets: dict[str, float], env: str = "env") -> DataFrame:
    """env, budget, threshold: for each environment the lowest score at or above which its false positives stay within a budget an hour.

    rows: env, score, weight of benign units and hours (observed in the environment). Ties go together; without any such score, just above the highest.
    """
    by = rows.groupBy(env, "hours", "score").agg(F.sum("weight").alias("fp"))
    w = Window.partitionBy(env).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    cum = by.withColumn("total", F.sum("fp").over(w))
    found = [cum.groupBy(env).agg(F.lit(n).alias("budget"), F.coalesce(F.min(F.when(F.col("total") <= b * F.col("hours"), F.col("score"))), F.max("score") + 1e-9).alias("threshold")) for n, b in budgets.items()]
    return reduce(DataFrame.unionByName, found)


def minimax(by_env: DataFrame) -> DataFrame:
    """budget, threshold: the strictest over environments, so that no one of them goes beyond the budget."""
    return by_env.groupBy("budget").agg(F.max("threshold").alias("threshold"))


def judged(units: DataFrame, threshold: float, env: str = "env") -> DataFrame:
    """A row for each environment: recall of distinct and of all malicious units, false positives an hour, with exact intervals.

    units: env, label, score, n (rows that a unit stands for) and hours.
    """
    over = F.col("score") >= threshold
    bad, good = F.col("label") == 1, F.col("label") == 0
    got = units.groupBy(env, "hours").agg(F.count_if(bad & over).alias("hits"), F.count_if(bad).alias("malicious"), F.coalesce(F.sum(F.when(bad & over, F.col("n"))), F.lit(0)).alias("hit_events"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("events"), F.coalesce(F.sum(F.when(good & over, F.col("n"))), F.lit(0)).alias("fp_events"))
    rated = got.withColumns({"recall": F.round(F.try_divide("hits", "malicious"), 4), "recall_events": F.round(F.try_divide("hit_events", "events"), 4), "fp_per_hour": F.round(F.try_divide("fp_events", "hours"), 4)})
    return with_intervals(rated, "hits", "malicious", "fp_events", "hours")


def paired(rows: DataFrame, resamples: int = 1000) -> DataFrame:
    """model, baseline, diff, low, high: difference of mean recall over environments, from resampled groups within each.

    rows: env, grp, a, b (0 or 1). A group's weight in a resample is a Poisson count from a hash, so a task that runs again draws the same.
    """
    sums = rows.groupBy("env", "grp").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))
    u = F.pmod(F.xxhash64("env", "grp", "draw"), F.lit(1 << 40)) / float(1 << 40)
    share = total = math.exp(-1)
    weight: Column = F.lit(0)
    for k in range(1, 9):
        weight = F.when(u >= total, F.lit(k)).otherwise(weight)
        share /= k
        total += share
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    each = drawn.groupBy("draw", "env").agg(F.try_divide(F.sum(F.col("w") * (F.col("a") - F.col("b"))), F.sum(F.col("w") * F.col("n"))).alias("d")).groupBy("draw").agg(F.avg("d").alias("d"))
    ends = each.agg(F.round(F.percentile("d", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 4).alias("high"))
    point = sums.groupBy("env").agg((F.sum("a") / F.sum("n")).alias("a"), (F.sum("b") / F.sum("n")).alias("b")).agg(F.round(F.avg("a"), 4).alias("model"), F.round(F.avg("b"), 4).alias("baseline"), F.round(F.avg("a") - F.avg("b"), 4).alias("diff"))
    return point.join(F.broadcast(ends))


def environment_weights(units: DataFrame, env: str = "env") -> DataFrame:
    """env, label, weight: benign units of all environments weigh the same in sum, malicious ones as much as all benign."""
    by = units.groupBy(env, "label").agg(F.count("*").alias("n"))
    total = by.agg(F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("good"), F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("bad"), F.count_if(F.col("label") == 0).alias("envs"))  # one row
    weight = F.when(F.col("label") == 0, F.col("good") / F.col("envs") / F.col("n")).otherwise(F.col("good") / F.greatest(F.lit(1), F.col("bad")))
    return by.join(F.broadcast(total)).select(env, "label", F.round(weight, 6).alias("weight"))


def missing_rates(hosts: DataFrame, families: list[str]) -> DataFrame:
    """family, rate: the share of hours at hosts where a family was not collected. hosts: host_id, hours and families (array)."""
    return reduce(DataFrame.unionByName, [hosts.agg(F.lit(f).alias("family"), F.round(F.try_divide(F.sum(F.when(~F.array_contains("families", f), F.col("hours")).otherwise(0.0)), F.sum("hours")), 6).alias("rate")) for f in families])


def by_minute(rows: DataFrame, key: list[str], most: int = 3600) -> tuple[DataFrame, DataFrame]:
    """A row for each host and key with a count and its first time; and the hours that each host was seen, by its distinct minutes."""
    counted = rows.groupBy("host_id", *key).agg(F.count("*").alias("n"), F.min("us").alias("first_us"))
    minutes = rows.select("host_id", F.floor(F.col("us") / 60_000_000).alias("m")).distinct()
    gap = F.least((F.col("m") - F.lag("m").over(Window.partitionBy("host_id").orderBy("m"))) * 60, F.lit(most))
    return counted, minutes.withColumn("g", gap).groupBy("host_id").agg(F.round((F.coalesce(F.sum("g"), F.lit(0)) + 60) / 3600, 4).alias("hours"))


def technique_group(techniques: Column, source: Column, tool: Column) -> Column:
    """The group that is left out together: the parent technique, else where a row is from."""
    first = F.element_at(F.array_sort(techniques), 1)
    return F.when(F.size(techniques) > 0, F.concat(F.lit("T:"), F.substring_index(first, ".", 1))).otherwise(F.concat_ws(":", source, tool))


# ---- labels

#: Images that a labelled recording says nothing about.
CONSOLE, BROWSERS = ("conhost.exe",), ("chrome.exe", "msedge.exe", "firefox.exe", "iexplore.exe")


def scenario_labels(rows: DataFrame, roots: list[tuple[str, str | None, str, str]]) -> DataFrame:
    """Adds label and label_rule: a start is malicious if it, or an ancestor, is a documented root (host prefix, parent, image, scenario).

    rows: guid, parent_guid, host, image, parent_image.
    """
    leaf = lambda c: F.lower(C.basename(F.col(c)))
    is_root = reduce(lambda a, b: a | b, [F.startswith(F.lower("host"), F.lit(h)) & (leaf("image") == i) & (F.lit(True) if p is None else leaf("parent_image") == p) for h, p, i, _ in roots])
    named = F.coalesce(*[F.when(F.startswith(F.lower("host"), F.lit(h)) & (leaf("image") == i) & (F.lit(True) if p is None else leaf("parent_image") == p), F.lit(s)) for h, p, i, s in roots])
    marked = rows.withColumn("_own", F.when(F.coalesce(is_root, F.lit(False)), named))
    up = closure(rows.select(F.col("guid").alias("node"), F.col("parent_guid").alias("parent")))
    above = up.join(marked.where("_own is not null").select(F.col("guid").alias("ancestor"), F.col("_own").alias("scenario")).dropDuplicates(["ancestor"]), "ancestor")
    inherited = above.groupBy(F.col("node").alias("guid")).agg(F.min_by("scenario", "level").alias("_above"))
    out = marked.join(inherited, "guid", "left").withColumn("scenario", F.coalesce("_own", "_above"))
    return out.withColumns({"label": F.when(F.col("scenario").isNotNull(), 1).otherwise(0), "label_rule": F.when(F.col("scenario").isNotNull(), "malicious/documented_scenario").otherwise("benign/environment")}).drop("_own", "_above")


def recording_labels(rows: DataFrame, background: tuple[str, ...], defensive: tuple[str, ...], interactive: tuple[str, ...], infrastructure: tuple[str, ...]) -> DataFrame:
    """Adds label (null: left out) and label_rule to starts of an attack recording: what is no background is malicious, and so is what it starts.

    rows: guid, parent_guid, image, parent_image. Malice is inherited from any ancestor that is neither left out, nor infrastructure, nor
    background, nor interactive by itself.
    """
    leaf = lambda c: F.lower(C.basename(F.col(c)))
    left_out = leaf("image").isin(*CONSOLE, *defensive, *BROWSERS)
    own_infra = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(m)) for m in infrastructure for c in ("image", "parent_image")], F.lit(False))
    quiet = leaf("image").isin(*background) & (F.col("parent_image").isNull() | leaf("parent_image").isin(*background))
    marked = rows.withColumns({"_out": left_out, "_infra": own_infra, "_quiet": F.coalesce(quiet, F.lit(False)), "_known": leaf("image").isin(*background), "_inter": leaf("image").isin(*interactive)})
    up = closure(rows.select(F.col("guid").alias("node"), F.col("parent_guid").alias("parent")))
    facts = marked.select(F.col("guid").alias("ancestor"), *(F.col(c) for c in ("_out", "_infra", "_quiet", "_known", "_inter"))).dropDuplicates(["ancestor"])
    above = up.join(facts, "ancestor").groupBy(F.col("node").alias("guid")).agg(F.bool_or("_infra").alias("_a_infra"), F.bool_and("_known").alias("_a_known"), F.bool_or(~F.col("_out") & ~F.col("_infra") & ~F.col("_quiet") & ~F.col("_inter")).alias("_a_bad"))
    out = marked.join(above, "guid", "left").fillna({"_a_infra": False, "_a_known": True, "_a_bad": False})
    infra = F.col("_infra") | F.col("_a_infra")
    rule = F.when(leaf("image").isin(*CONSOLE), "excluded/console_host").when(leaf("image").isin(*defensive), "excluded/defensive_tool").when(leaf("image").isin(*BROWSERS), "excluded/browser").when(infra, "benign/infrastructure").when(~F.col("_a_bad") & F.col("_quiet") & F.col("_a_known"), "benign/background").when(~F.col("_a_bad") & F.col("_inter"), "excluded/interactive").otherwise("malicious/attack_recording")
    label = F.when(F.startswith("label_rule", F.lit("benign")), 0).when(F.startswith("label_rule", F.lit("malicious")), 1)
    return out.withColumn("label_rule", rule).withColumn("label", label).drop("_out", "_infra", "_quiet", "_known", "_inter", "_a_infra", "_a_known", "_a_bad")


# ---- folds, probes, bundles


def folds(rows: DataFrame, group: str, label: str, n: int = 5) -> DataFrame:
    """Adds fold: whole groups, dealt out by size within each label, so that folds are of like size."""
    sizes = rows.groupBy(group, label).agg(F.count("*").alias("_n")).groupBy(group).agg(F.max_by(label, "_n").alias("_l"), F.sum("_n").alias("_n"))
    place = F.row_number().over(Window.partitionBy("_l").orderBy(F.desc("_n"), group)) - 1
    turn, at = F.floor(place / n), place % n
    return rows.join(sizes.select(group, F.when(turn % 2 == 0, at).otherwise(n - 1 - at).cast("int").alias("fold")), group)


def early_stop(curve: list[float], patience: int = 20) -> int:
    """The round after which a loss has not fallen for so many rounds; the best one before it."""
    best, at = math.inf, 0
    for i, loss in enumerate(curve):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at + 1


def left_out(rows: DataFrame, env: str, run: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """run(train, test) for each environment left out in turn, all results with its name."""
    names = [r[0] for r in rows.select(env).distinct().orderBy(env).collect()]  # environments are few by nature
    return reduce(DataFrame.unionByName, [run(rows.where(F.col(env) != e), rows.where(F.col(env) == e)).withColumn("left_out", F.lit(e)) for e in names])


def bundle(folder: str, model: dict[str, Any], features: dict[str, Any], limits: dict[str, float], calibration: dict[str, float], golden: list[dict[str, Any]], score: Callable[[dict[str, float]], float]) -> dict[str, Any]:
    """Writes a model, its features, thresholds, calibration and golden vectors as JSON, with a manifest of hashes and of the largest golden error."""
    from pathlib import Path

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    parts = {"model.json": model, "features.json": features, "thresholds.json": {"raw_score": limits}, "calibration.json": {"method": "platt", **calibration}, "golden.json": golden}
    for name, content in parts.items():
        (out / name).write_text(json.dumps(content, sort_keys=True) + "\n")
    worst = max((abs(score(g["vector"]) - g["raw_score"]) for g in golden), default=0.0)
    manifest = {"files": {n: hashlib.sha256((out / n).read_bytes()).hexdigest() for n in parts}, "golden_max_abs_error": worst, "final_candidate": False}
    (out / "manifest.json").write_text(json.dumps(manifest, indent=2) + "\n")
    return manifest


def freeze(folder: str) -> None:
    """Marks a bundle as the final one; its files must be as they were written."""
    from pathlib import Path

    path = Path(folder) / "manifest.json"
    manifest = json.loads(path.read_text())
    for name, want in manifest["files"].items():
        if hashlib.sha256((path.parent / name).read_bytes()).hexdigest() != want:
            raise ValueError(f"{name} is not what the manifest says")
    path.write_text(json.dumps(manifest | {"final_candidate": True}, indent=2) + "\n")


def sealed(folder: str, marker: str, evaluate: Callable[[], dict[str, Any]]) -> dict[str, Any]:
    """The final test, of a frozen bundle, once: a marker that is written stands in the way of a second run."""
    from pathlib import Path

    if not json.loads((Path(folder) / "manifest.json").read_text()).get("final_candidate"):
        raise ValueError("freeze the bundle first")
    spent = Path(marker)
    if spent.exists():
        raise ValueError(f"the test was run before: {marker}")
    spent.parent.mkdir(parents=True, exist_ok=True)
    result = evaluate()
    spent.write_text(json.dumps(result, default=str) + "\n")
    return result
