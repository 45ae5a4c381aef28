"""Files of many kinds: label tables, packages of segments, feature records, manifests, alert logs and per-host runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def metadata(path: str) -> list[dict[str, Any]]:
    """Techniques and tactics of a recording, from its YAML description."""
    import yaml

    found = yaml.safe_load(Path(path).read_text()) or {}
    rows = found.get("attack_mappings") or found.get("attack") or []
    return [{"technique": ".".join(str(x) for x in (r.get("technique"), r.get("sub-technique")) if x), "tactics": list(r.get("tactics") or [])} for r in rows]


#: Bytes that one piece of a text stream has, about.
PIECE = 16 * 1024 * 1024


def pieces(blocks: Iterator[bytes], tag: str = "Event") -> Iterator[str]:
    """Elements of a stream of XML in blocks of bytes, UTF-8 or UTF-16 by its mark; an element that goes on in the next block is carried over."""
    import codecs
    import re

    decoder, carry = None, ""
    whole = re.compile(rf"<{tag}[\s>].*?</{tag}>", re.S)
    for block in blocks:
        if decoder is None:
            name = "utf-16" if block[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else "utf-8-sig"
            decoder = codecs.getincrementaldecoder(name)(errors="replace")
        carry += decoder.decode(block)
        last = 0
        for m in whole.finditer(carry):
            yield m[0]
            last = m.end()
        carry = carry[last:]


def xml_stream(spark: SparkSession, path: str, tag: str = "Event") -> DataFrame:
    """value: the elements of files of XML, each file in pieces; UTF-8 and UTF-16 by their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = content.as_buffer()
                some: list[str] = []
                for e in pieces((bytes(held[i : i + PIECE]) for i in range(0, len(held), PIECE)), tag):
                    some.append(e)
                    if len(some) >= 1_000:
                        yield pa.RecordBatch.from_arrays([pa.array(some)], names=["value"])
                        some = []
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def pinned(path: str, sha256: str | None, pins: str) -> str:
    """The hash of a file, which must be the one asked for, or else the one that was pinned when it was first seen."""
    got = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    book = Path(pins)
    known = json.loads(book.read_text()) if book.exists() else {}
    want = sha256 or known.get(path)
    if want and want != got:
        raise ValueError(f"{path} has hash {got}, not {want}")
    if path not in known:
        book.write_text(json.dumps(known | {path: got}, indent=2, sort_keys=True) + "\n")
    return got


def package(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, Any]]:
    """Records (category, kind, data as JSON, self, observed_at) of a package's segments, and its manifest and heartbeat."""
    schema = "kind string, category string, data string, self boolean, observed_at string, record_id string"
    rows = spark.read.text(f"{folder}/segment-*.ndjson").where("trim(value) <> ''").select(F.from_json(F.ltrim(F.regexp_replace("value", "^﻿", "")), schema).alias("r")).select("r.*")
    # small documents, read as text so that the folder may be in any store
    facts = {n: spark.read.text(f"{folder}/{n}.json", wholetext=True).first() for n in ("manifest", "heartbeat") if _there(spark, f"{folder}/{n}.json")}
    return rows, {n: json.loads(r[0].lstrip("﻿")) for n, r in facts.items() if r}


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def labelled_csv(spark: SparkSession, path: str, label: int) -> DataFrame:
    """Rows of a labelled sample with a header: row_id, grp, user and its domain, process and parent."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    from emberline.functions.columns import account

    name, domain = account(have("username"))
    return rows.select(F.concat(F.lit("csv:"), have("event_id")).alias("row_id"), F.lit(label).alias("label"), F.coalesce(have("mitre_technique"), F.lit("benign" if label == 0 else "malicious")).alias("grp"), have("integrity_level").alias("integrity"), have("process_name").alias("process_name"), have("process_path").alias("executable"), have("command_line").alias("command_line"), have("parent_process").alias("parent_name"), name.alias("user"), domain.alias("domain"))


def label_table(lines: DataFrame, scenario: str) -> DataFrame:
    """host_id, image, pid and us of the attack rows of a label table: fields are separated by commas, the fourth holds pid and start as hexadecimal numbers."""
    part = F.transform(F.split("value", ","), lambda x: F.trim(x))
    code = F.split(F.try_element_at(part, F.lit(4)), "-")
    ticks = F.conv(F.try_element_at(code, F.lit(5)), 16, 10).cast("bigint")
    from emberline.functions.columns import filetime

    rows = lines.where((F.size(part) >= 5) & (F.try_element_at(part, F.lit(5)) == "attack") & (F.size(code) >= 5))
    return rows.select(F.lit(scenario.split("-")[0]).alias("host_id"), F.lower(F.try_element_at(part, F.lit(2))).alias("image"), F.conv(F.try_element_at(code, F.lit(3)), 16, 10).cast("bigint").alias("pid"), filetime(ticks).alias("us"))


def merged_runs(runs: list[DataFrame], order: list[str]) -> DataFrame:
    """Sorted runs as one sorted frame."""
    from functools import reduce

    return reduce(DataFrame.unionByName, runs).orderBy(*order)


def write_runs(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows sorted within each host, in a folder for each host; a host of very many rows is written by several tasks, by day."""
    day = F.to_date(F.timestamp_micros("us"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.withColumn("day", day).repartition(n, "host_id", "day").sortWithinPartitions("host_id", "day", *order).write.partitionBy("host_id", "day").mode("append").option("compression", "gzip").json(path)


def rows_gz(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of gzip files of JSON lines."""
    return spark.read.schema(schema).json(path)


def write_rows_gz(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def write_features(records: DataFrame, path: str) -> None:
    """Feature records as JSON lines, in the order of start and node."""
    records.orderBy("start_time", "node_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Feature records of JSON lines; a field that the record does not have is an error, which says so when the rows are read."""
    names = F.array(*[F.lit(n) for n in schema.names])
    extra = F.array_except(F.json_object_keys("value"), names)
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))).otherwise(F.col("value"))
    return spark.read.text(path).where("trim(value) <> ''").select(F.from_json(checked.cast("string"), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_canonical(events: DataFrame, path: str) -> dict[str, Any]:
    """Canonical events as JSON lines, sorted by time and id, with a manifest of counts by type and a hash of the content."""
    events.orderBy("ts", "event_id").write.mode("overwrite").json(f"{path}/events")
    by = {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}  # event types are few
    whole = events.select(F.xxhash64(F.to_json(F.struct(*events.columns))).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    manifest = {"events": sum(by.values()), "by_type": dict(sorted(by.items(), key=str)), "content": str(whole)}
    events.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_alerts(alerts: DataFrame, path: str) -> None:
    """All alerts of a run as JSON lines."""
    alerts.write.mode("overwrite").json(path)


def append_alerts(alerts: list[dict[str, Any]], path: str) -> int:
    """Appends alerts to one file of JSON lines, each id once; a last line that a crash cut short goes first. For consoles of one machine."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    seen: set[str] = set()
    if out.exists():
        data = out.read_bytes()
        if data and not data.endswith(b"\n"):
            data = data[: data.rfind(b"\n") + 1]
            out.write_bytes(data)
        for line in data.splitlines():
            try:
                seen.add(json.loads(line).get("alert_id"))
            except (json.JSONDecodeError, AttributeError):
                continue
    fresh = {a["alert_id"]: a for a in alerts if a["alert_id"] not in seen}
    with out.open("a", encoding="utf-8") as f:
        for a in fresh.values():
            f.write(json.dumps(a, separators=(",", ":"), default=str) + "\n")
    return len(fresh)
