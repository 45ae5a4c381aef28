"""Detection over streams: files of wire events to alerts, each alert written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.plans.rules import Rule, scan
from emberline.sources.telemetry import canonical, wire


def alerts(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alerts with ids made from their content, so that a replay makes the same ones."""
    hits = scan(events, rules)
    return hits.select(F.concat(F.lit("ALT-"), F.upper(F.substring(F.sha1(F.concat_ws("|", "rule_id", "event_id", "host_id", F.col("ts").cast("string"))), 1, 8))).alias("alert_id"), "rule_id", "event_id", "host_id", "ts", "level", "tactic", "matched")


def deliver(batch: DataFrame, out: str) -> None:
    """Appends alerts that are not there yet: a batch that is written again changes nothing."""
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fresh = batch.dropDuplicates(["alert_id"])
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        fresh = fresh.join(spark.read.parquet(out).select("alert_id"), "alert_id", "left_anti")
    fresh.write.mode("append").parquet(out)


def run(spark: SparkSession, source: str, rules: list[Rule], out: str, checkpoint: str, delay: str = "10 minutes", most_files: int = 64) -> StreamingQuery:
    """Reads all files that are there (and, run again, only new ones). most_files bounds a batch; a restart goes on from the checkpoint."""
    lines = spark.readStream.option("maxFilesPerTrigger", most_files).text(source)
    events = canonical(wire(lines)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return alerts(events, rules).writeStream.foreachBatch(lambda batch, _: deliver(batch, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
