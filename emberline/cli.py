"""Command line: detection over files of wire events, coverage of rules, baselines and features, and streams of files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="emberline", description="Rules, graphs and behaviour over endpoint telemetry", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("--rules", default="rules", help="folder of rules")
    p.add_argument("--telemetry", help="wire events as JSON lines: a file, folder or pattern")
    p.add_argument("--output-format", choices=["console", "json", "ndjson"], default="console")
    p.add_argument("--output", help="folder for the alerts as JSON lines")
    p.add_argument("--story", action="store_true", help="tell the alerts as a story")
    p.add_argument("--show", type=int, default=200, help="alerts shown at most")
    p.add_argument("--coverage", action="store_true", help="show what the rules cover")
    p.add_argument("--navigator", help="file for a Navigator layer")
    p.add_argument("--graph-stats", action="store_true")
    p.add_argument("--features", help="folder for feature records")
    p.add_argument("--learn-baseline", help="file for a baseline of what is rare")
    p.add_argument("--baseline", help="baseline to judge process starts by")
    p.add_argument("--stream", help="folder for alerts of a stream of files; needs --checkpoint")
    p.add_argument("--checkpoint", help="folder for the state of the stream")
    p.add_argument("--max-files", type=int, default=64, help="files of one batch at most")
    p.add_argument("--max-events", type=int, help="events read at most")
    p.add_argument("--duration", type=float, help="seconds a stream runs at most")
    p.add_argument("--metrics-file", help="file for measures of the stream")
    p.add_argument("--health-file", help="file for its health")
    return p


def prepared(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    from emberline.sources import telemetry

    events = telemetry.canonical(telemetry.ndjson(spark, path)).withColumn("us", F.unix_micros("ts"))
    return events.limit(most) if most else events


def graph_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of processes and edges of events."""
    from emberline.operators import graph, identity

    found = identity.resolved(events)
    runs = identity.incarnations(found)
    return runs, graph.edges(graph.with_nodes(events, found), runs)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    from emberline.operators import alerts as A
    from emberline.operators import graph, processes
    from emberline.plans import fields
    from emberline.plans import rules as R

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("emberline").getOrCreate()
    rules = R.load(args.rules) if Path(args.rules).is_dir() else []
    for said in R.all_problems(rules):
        print(said, file=sys.stderr)
    if args.coverage:
        print(A.heatmap(spark, rules), file=out)
    if args.navigator:
        Path(args.navigator).write_text(json.dumps(A.navigator_layer(rules), indent=2))
    if not args.telemetry:
        return 0
    if args.stream:
        return _stream(spark, args, rules)
    events = prepared(spark, args.telemetry, args.max_events)
    errors: dict[str, str] = {}
    found = A.records(R.scan(fields.derive(events, rules), rules, errors), rules)
    for rule, why in errors.items():
        print(f"{rule}: {why}", file=sys.stderr)
    if args.output:
        found.write.mode("overwrite").json(args.output)
    if args.story:
        for row in A.narrative(found).orderBy("step").limit(args.show + 1).collect():
            print(row.text, file=out)
    else:
        for row in found.orderBy("timestamp", "alert_id").limit(args.show).collect():
            alert = row.asDict(recursive=True)
            print(A.console(alert) if args.output_format == "console" else A.as_json(alert, 2 if args.output_format == "json" else None), file=out)
    if args.graph_stats or args.features or args.learn_baseline or args.baseline:
        runs, edges = graph_of(events)
        if args.graph_stats:
            print(graph.nodes(edges, runs).groupBy("kind").count().toPandas().to_string(index=False), file=out)
            print(f"edges {edges.count()}", file=out)
        records = processes.records(runs, edges, processes.image_writes(runs, edges))
        if args.features:
            from emberline.sources.files import write_features

            write_features(records, args.features)
        if args.learn_baseline:
            Path(args.learn_baseline).write_text(json.dumps(processes.baseline_document(processes.rarity(records)), indent=2) + "\n")
        if args.baseline:
            known = processes.baseline_from(spark, json.loads(Path(args.baseline).read_text()))
            values = records.where("parent_child is not null").select(F.lit("parent_child").alias("dimension"), F.col("parent_child").alias("value"), "node_id")
            for row in processes.rated(values, known).where("category in ('unseen', 'uncommon')").orderBy("node_id").limit(args.show).collect():
                print(json.dumps(row.asDict()), file=out)
    return 0


def _stream(spark: SparkSession, args: argparse.Namespace, rules: list) -> int:
    from emberline.streaming import delivery, pipeline

    watch = delivery.Watch()
    spark.streams.addListener(watch)
    try:
        query = pipeline.run(spark, args.telemetry, rules, args.stream, args.checkpoint, most_files=args.max_files)
        if not query.awaitTermination(args.duration) if args.duration else query.awaitTermination() is False:
            query.stop()
    finally:
        spark.streams.removeListener(watch)
        if args.metrics_file:
            delivery.replace_file(args.metrics_file, watch.prometheus())
        if args.health_file:
            delivery.replace_file(args.health_file, json.dumps(watch.health(), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
