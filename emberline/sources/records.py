"""Recordings of other tools: Sysmon and PowerShell records (JSON or XML, plain or in archives) and eCAR, as canonical columns.

Each mapping is one projection with a `reason`: null for what is mapped, else why a record is left out. Nothing is dropped silently.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import columns as C

SYSMON = "Microsoft-Windows-Sysmon/Operational"
POWERSHELL = "Microsoft-Windows-PowerShell/Operational"
SCRIPT_BYTES = 16_384
#: Event types of Sysmon's event numbers.
SYSMON_TYPES = {1: "process_create", 3: "network_connect", 5: "process_terminate", 7: "image_load", 8: "remote_thread", 10: "process_access", 11: "file_create", 12: "registry_add_key", 13: "registry_write", 14: "registry_rename_key", 22: "dns_query", 23: "file_delete", 26: "file_delete"}
#: Event types of eCAR objects and actions.
ECAR_TYPES = {
    ("PROCESS", "CREATE"): "process_create",
    ("PROCESS", "TERMINATE"): "process_terminate",
    ("FLOW", "START"): "network_connect",
    ("FILE", "CREATE"): "file_create",
    ("FILE", "RENAME"): "file_rename",
    ("FILE", "DELETE"): "file_delete",
    ("MODULE", "LOAD"): "image_load",
    ("REGISTRY", "ADD"): "registry_write",
    ("REGISTRY", "EDIT"): "registry_write",
    ("REGISTRY", "REMOVE"): "registry_delete_key",
    ("THREAD", "REMOTE_CREATE"): "remote_thread",
}
ECAR = "object string, action string, hostname string, pid string, ppid string, principal string, timestamp string, timestamp_ms string, id string, objectID string, properties map<string,string>"


def _member(name: str) -> bool:
    leaf = name.replace("\\", "/").rsplit("/", 1)[-1]
    return name.lower().endswith(".json") and "__MACOSX/" not in name and not leaf.startswith("._")


def _lines(content: bytes, path: str) -> Iterator[str]:
    """Lines of the members of an archive, by name; a member is read as a stream."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(n for n in z.namelist() if _member(n)):
                with z.open(name) as f:
                    yield from io.TextIOWrapper(f, encoding="utf-8", errors="replace")
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            for m in sorted((m for m in t.getmembers() if m.isfile() and _member(m.name)), key=lambda m: m.name):
                yield from io.TextIOWrapper(t.extractfile(m), encoding="utf-8", errors="replace")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one row for each line of plain, gzip, zip and tar.gz recordings.

    Plain and gzip files are read by the text source; archives one to a task, their members as streams of 10,000 lines.
    """
    archive = path.lower().endswith((".zip", ".tar.gz", ".tgz"))
    if not archive:
        return spark.read.text(path).where("trim(value) <> ''")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                held = []
                for line in _lines(content, name):
                    if line.strip():
                        held.append(line.strip())
                    if len(held) == 10_000:
                        yield pd.DataFrame({"value": held})
                        held = []
                yield pd.DataFrame({"value": held}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "value string")


def records(lines_: DataFrame) -> DataFrame:
    """record: a flat map of each line that is a JSON object."""
    return lines_.select(F.from_json("value", "map<string,string>").alias("record")).where("record is not null")


def xml_records(texts: DataFrame, column: str = "value") -> DataFrame:
    """record: a flat map of every <Event> of texts that may hold one or many.

    Elements are cut out by patterns, so that a malformed one costs no other; System's fields and EventData's named values go in.
    """
    event = texts.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(<Event[\s>].*?</Event>)"), F.lit(1))).alias("x"))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    one = lambda p: F.nullif(plain(F.trim(F.regexp_extract("x", p, 1))), F.lit(""))
    tag = lambda t: one(rf"(?s)<{t}(?:\s[^>]*)?>([^<]*)</{t}>")
    system = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("SourceName", "@timestamp", "Hostname", "EventID", "EventRecordID", "Channel", "Version")]),
        F.array(one(r"<Provider\s[^>]*?Name=['\"]([^'\"]*)['\"]"), one(r"<TimeCreated\s[^>]*?SystemTime=['\"]([^'\"]*)['\"]"), tag("Computer"), tag("EventID"), tag("EventRecordID"), tag("Channel"), tag("Version")),
    )
    pattern = r"(?s)<Data\s+Name=['\"]([^'\"]+)['\"]\s*(?:/>|>([^<]*)</Data>)"
    names = F.regexp_extract_all("x", F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all("x", F.lit(pattern), F.lit(2)), plain)
    pairs = F.arrays_zip(names.alias("key"), values.alias("value"))
    # a name that comes twice keeps its last value, and stands over a field of System
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    data = F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))
    kept = F.map_filter(system, lambda k, v: v.isNotNull() & ~F.map_contains_key(data, k))
    return event.where("x rlike '(?s)</System>'").select(F.map_concat(kept, data).alias("record"))


def splunk_xml(spark: SparkSession, path: str) -> DataFrame:
    """record of exports with one result a line, whose raw text is XML."""
    return xml_records(spark.read.text(path).select(F.get_json_object("value", "$.result._raw").alias("value")).where("value is not null"))


def only(records_: DataFrame, numbers: list[int]) -> DataFrame:
    """Sysmon records of these event numbers."""
    return records_.where((F.col("record")["Channel"] == SYSMON) & F.expr("try_cast(record['EventID'] as int)").isin(numbers))


def _value(*keys: str) -> Column:
    """The first value that is there; a dash stands for none."""
    some = [F.nullif(F.nullif(F.trim(F.col("record")[k]), F.lit("")), F.lit("-")) for k in keys]
    return F.coalesce(*some) if len(some) > 1 else some[0]


def _number(*keys: str) -> Column:
    v = _value(*keys)
    hexa = v.rlike(r"^0[xX][0-9A-Fa-f]{1,15}$")
    return F.when(hexa, F.conv(F.substr(v, F.lit(3)), 16, 10).try_cast("bigint")).otherwise(v.try_cast("bigint"))


def truncated(text: Column) -> Column:
    """The first 16,384 bytes, cut between characters."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, 1, SCRIPT_BYTES)
    short = F.replace(F.make_valid_utf8(head.cast("string")), F.lit("�"), F.lit(""))
    return F.when(F.octet_length(text) <= SCRIPT_BYTES, text).otherwise(short)


def sysmon(records_: DataFrame, dataset: str) -> DataFrame:
    """Canonical columns and `reason` of flat records. A script block has no image: see with_images."""
    number, channel = _number("EventID"), F.col("record")["Channel"]
    source = lambda key: F.when(number.isin(8, 10) & (channel == SYSMON), _value(f"Source{key}")).otherwise(_value(key))
    script = (channel == POWERSHELL) & (number == 4104)
    kind = F.coalesce(*[F.when((channel == SYSMON) & (number == n), t) for n, t in SYSMON_TYPES.items()], F.when(script, "script_block"))
    kind = F.when((kind == "registry_add_key") & (_value("EventType") == "DeleteKey"), "registry_delete_key").otherwise(kind)
    pid = F.when(script, _number("ExecutionProcessID", "ProcessID", "ProcessId")).when(number.isin(8, 10), _number("SourceProcessId")).otherwise(_number("ProcessId"))
    when = F.coalesce(F.try_to_timestamp(F.substring(_value("UtcTime"), 1, 23)), F.try_to_timestamp(_value("@timestamp", "TimeCreated")))
    image, host = source("Image"), F.coalesce(_value("Hostname", "host"), F.lit("UNKNOWN_HOST"))
    user, domain = C.account(source("User"))
    text = F.nullif(F.col("record")["ScriptBlockText"], F.lit(""))
    return records_.select(
        F.when(kind.isNull(), F.concat_ws(" ", F.lit("not mapped:"), channel, number.cast("string"))).when(when.isNull(), "no time").when(pid.isNull(), "no process id").alias("reason"),
        F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", F.lit(dataset), host, channel, number.cast("string"), F.coalesce(_value("RecordNumber", "EventRecordID"), F.sha2(F.to_json("record"), 256))), 256), 1, 32)).alias("event_id"),
        when.alias("ts"),
        host.alias("host_id"),
        kind.alias("event_type"),
        channel.alias("channel"),
        number.alias("number"),
        pid.alias("pid"),
        C.basename(image).alias("process_name"),
        image.alias("executable"),
        _value("CommandLine").alias("command_line"),
        F.coalesce(user, F.when(script, _value("AccountName"))).alias("user_name"),
        F.coalesce(domain, F.when(script, _value("Domain"))).alias("user_domain"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce(_value("Hashes"), F.lit("")), "SHA256=([0-9A-Fa-f]{64})", 1)), F.lit("")).alias("sha256"),
        _value("IntegrityLevel").alias("integrity"),
        _number("ParentProcessId").alias("ppid"),
        C.basename(_value("ParentImage")).alias("parent_name"),
        F.when(F.lower(F.coalesce(_value("Initiated"), F.lit(""))).isin("true", "1"), "outbound").otherwise(F.when(number == 3, "inbound")).alias("direction"),
        F.when(F.lower(_value("Protocol")).isin("tcp", "udp"), F.lower(_value("Protocol"))).alias("protocol"),
        _value("DestinationIp").alias("destination_ip"),
        _number("DestinationPort").alias("destination_port"),
        F.coalesce(_value("TargetFilename"), _value("ImageLoaded"), F.when(kind == "process_create", image), _value("Path")).alias("path"),
        F.when(F.startswith(kind, F.lit("registry")), _value("TargetObject")).alias("key_path"),
        F.when(number == 13, C.registry_value_type(_value("Details"))).alias("value_type"),
        F.lower(_value("Signed")).isin("true", "1").alias("is_signed"),
        _number("TargetProcessId").alias("target_pid"),
        _value("TargetImage").alias("target_executable"),
        F.when(_value("GrantedAccess").rlike("^0x[0-9A-Fa-f]+$"), _number("GrantedAccess")).alias("access_mask"),
        _value("CallTrace").alias("call_trace"),
        F.rtrim(F.lower(_value("QueryName")), F.lit(".")).alias("query_name"),
        C.dns_answers(_value("QueryResults")).alias("query_results"),
        F.when(script, truncated(text)).alias("script_text"),
        F.when(script, F.coalesce(F.octet_length(text), F.lit(0))).alias("script_bytes"),
        F.when(script, F.sha2(text, 256)).alias("script_sha256"),
    )


def with_images(events: DataFrame) -> DataFrame:
    """Script blocks with the image of the latest start of their process: one shuffle by host and process."""
    from pyspark.sql import Window

    w = Window.partitionBy("host_id", "pid").orderBy("ts", F.when(F.col("event_type") == "process_create", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    image = F.last(F.when(F.col("event_type") == "process_create", F.col("executable")), ignorenulls=True).over(w)
    own = F.coalesce(F.col("executable"), F.when(F.col("event_type") == "script_block", image))
    return events.withColumn("executable", own).withColumn("process_name", F.coalesce("process_name", C.basename(F.col("executable"))))


def ecar(lines_: DataFrame, dataset: str) -> DataFrame:
    """Canonical columns and `reason` of lines of eCAR; -1 stands for none."""
    e = lines_.select(F.from_json("value", ECAR).alias("e")).where("e is not null").select("e.*")
    p = lambda k: F.col("properties")[k]
    number = lambda c: F.when(c.try_cast("bigint") >= 0, c.try_cast("bigint"))
    stamp = F.coalesce("timestamp", "timestamp_ms")
    when = F.when(stamp.rlike(r"^\d+$"), F.timestamp_millis(stamp.try_cast("bigint"))).otherwise(F.try_to_timestamp(stamp))
    kind = F.coalesce(*[F.when((F.col("object") == o) & (F.col("action") == a), t) for (o, a), t in ECAR_TYPES.items()])
    image, file, moved, module = C.drive_path(p("image_path")), C.drive_path(p("file_path")), C.drive_path(p("new_path")), C.drive_path(p("module_path"))
    renamed = kind == "file_rename"
    path = F.when(renamed, F.coalesce(F.nullif(moved, F.lit("")), file)).when(F.startswith(kind, F.lit("file")), file).when(kind == "image_load", module).when(kind == "process_create", image)
    host = F.coalesce(F.nullif(F.col("hostname"), F.lit("")), F.lit("UNKNOWN_HOST"))
    user, domain = C.account(F.coalesce(p("user"), F.col("principal")))
    gone = (
        F.when(kind.isNull(), F.concat_ws(" ", F.lit("not mapped:"), "object", "action"))
        .when(when.isNull(), "no time")
        .when(number(F.col("pid")).isNull(), "no process id")
        .when((kind == "network_connect") & (F.lower(F.coalesce(p("direction"), F.lit(""))) != "outbound"), "not outbound")
        .when((F.startswith(kind, F.lit("file")) & (F.coalesce(file, F.lit("")) == "")) | ((kind == "image_load") & (F.coalesce(module, F.lit("")) == "")), "no path")
        .when(F.startswith(kind, F.lit("registry")) & (F.coalesce(p("key"), F.lit("")) == ""), "no key")
        .when((kind == "remote_thread") & number(p("tgt_pid")).isNull(), "no target")
    )
    return e.select(
        gone.alias("reason"),
        F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", F.lit(dataset), host, F.lit("ecar"), F.coalesce("id", "objectID"), "object", "action"), 256), 1, 32)).alias("event_id"),
        when.alias("ts"),
        host.alias("host_id"),
        kind.alias("event_type"),
        number(F.col("pid")).alias("pid"),
        C.basename(image).alias("process_name"),
        image.alias("executable"),
        p("command_line").alias("command_line"),
        user.alias("user_name"),
        domain.alias("user_domain"),
        number(F.col("ppid")).alias("ppid"),
        C.basename(C.drive_path(p("parent_image_path"))).alias("parent_name"),
        F.when(kind == "network_connect", "outbound").alias("direction"),
        F.when(p("l4protocol") == "6", "tcp").when(p("l4protocol") == "17", "udp").alias("protocol"),
        p("dest_ip").alias("destination_ip"),
        number(p("dest_port")).alias("destination_port"),
        path.alias("path"),
        F.when(renamed, file).alias("previous_path"),
        F.when(F.startswith(kind, F.lit("registry")), p("key")).alias("key_path"),
        number(p("tgt_pid")).alias("target_pid"),
    )


def mapped(events: DataFrame) -> DataFrame:
    """What is mapped, each event id once."""
    return events.where("reason is null").drop("reason").dropDuplicates(["event_id"])


def report(events: DataFrame) -> DataFrame:
    """event_type, reason, n, hosts and the first and last time, by one aggregation."""
    return events.groupBy("event_type", "reason").agg(F.count("*").alias("n"), F.count_distinct("host_id").alias("hosts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def clock_offset(records_: DataFrame) -> DataFrame:
    """Median of Sysmon's time less the export's, in whole seconds."""
    wall = F.try_to_timestamp(_value("@timestamp", "TimeCreated"))
    gap = F.unix_micros(F.try_to_timestamp(F.substring(_value("UtcTime"), 1, 23))) - F.unix_micros(wall)
    return records_.select((gap / 1e6).alias("g")).agg(F.coalesce(F.bround(F.median("g")), F.lit(0.0)).alias("offset_seconds"), F.count("g").alias("n"))
