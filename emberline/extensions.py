"""What others can add: families of telemetry, detectors over frames, and callbacks for what is emitted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event type of a further category of wire events, and its columns, each as a function of the frame.
FAMILIES: dict[str, tuple[Callable[[], Column], dict[str, Callable[[], Column]]]] = {}
#: Functions from events to signals (detector, rule_id, event_id, host_id, us, level).
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SIGNAL = ("detector", "rule_id", "event_id", "host_id", "us", "level", "alert_id")


def register_family(category: str, event_type: Callable[[], Column], columns: dict[str, Callable[[], Column]]) -> None:
    """Says how wire events of a category become canonical ones."""
    FAMILIES[category] = (event_type, columns)


def with_families(wire: DataFrame, canonical: DataFrame) -> DataFrame:
    """Canonical events and those of registered families; both are projections of the same wire events."""
    out = [canonical]
    for category, (kind, columns) in FAMILIES.items():
        rows = wire.where(F.lower("event.category") == category)
        out.append(rows.select(F.col("event.id").alias("event_id"), F.try_to_timestamp("event.timestamp").alias("ts"), F.coalesce("host.id", "host.hostname").alias("host_id"), F.col("process.pid").alias("pid"), kind().alias("event_type"), *[c().alias(n) for n, c in columns.items()]))
        out[0] = out[0].join(rows.select(F.col("event.id").alias("event_id")), "event_id", "left_anti")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def register_detector(name: str, detect: Callable[[DataFrame], DataFrame]) -> None:
    DETECTORS[name] = detect


def signals(events: DataFrame) -> DataFrame:
    """What all registered detectors say, with ids made from the content."""
    found = [d(events).withColumn("detector", F.lit(n)) for n, d in sorted(DETECTORS.items())]
    if not found:
        return events.sparkSession.createDataFrame([], "detector string, rule_id string, event_id string, host_id string, us long, level int, alert_id string")
    made = F.concat(F.lit("BHV-"), F.upper(F.substring(F.sha1(F.concat_ws("|", "detector", "rule_id", "host_id", F.col("event_id").cast("string"), F.col("us").cast("string"))), 1, 10)))
    return reduce(DataFrame.unionByName, [x.withColumn("alert_id", made).select(*[F.col(c).cast("string") if c == "event_id" else F.col(c) for c in SIGNAL]) for x in found])


def emitting(callback: Callable[[list[dict]], None], most: int = 10_000) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that gives each batch of alerts to a callback, part by part, so that the driver holds `most` at once."""

    def run(batch: DataFrame, _: int) -> None:
        held: list[dict] = []
        for row in batch.toLocalIterator():
            held.append(row.asDict(recursive=True))
            if len(held) >= most:
                callback(held)
                held = []
        if held:
            callback(held)

    return run
