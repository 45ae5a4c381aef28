"""Training rows from three more recordings, each as one projection: flattened sources, an agent's own package, and eCAR process starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

#: Columns of a training row.
ROW = ("row_id", "source", "dataset", "host", "utc", "guid", "parent_guid", "pid", "ppid", "image", "parent_image", "command_line", "parent_name", "user", "domain", "integrity", "label", "label_rule", "grp")


def _id(*parts: Column) -> Column:
    """A hash of parts, each with its length before it."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def _row(made: dict[str, Column]) -> list[Column]:
    return [made.get(c, F.lit(None).cast("string")).alias(c) for c in ROW]


def flattened(lines: DataFrame) -> DataFrame:
    """Rows of process starts that a collector has flattened into _source; one that a rule hit is left without a label. Unusable lines go."""
    s = F.from_json(F.get_json_object("value", "$._source"), "map<string,string>")
    rows = lines.select(s.alias("s")).where("s is not null")
    g = lambda k: F.nullif(F.try_element_at("s", F.lit(k)), F.lit(""))
    when = F.try_to_timestamp(F.coalesce(g("event_original_time"), g("@timestamp"), g("UtcTime")))
    pid, host, image = F.expr("try_cast(s['process_id'] as bigint)"), F.lower(F.coalesce(g("host_name"), F.lit("UNKNOWN_HOST"))), g("process_path")
    hit = F.exists(F.map_keys("s"), lambda k: F.startswith(F.lower(k), F.lit("rule_")))
    name, domain = C.account(g("user_account"))
    made = {
        "row_id": _id(F.lit("flattened"), host, g("record_number"), g("process_guid")), "source": F.lit("flattened"), "dataset": F.lit("flattened:real"), "host": host, "utc": when, "guid": g("process_guid"), "parent_guid": g("process_parent_guid"),
        "pid": pid, "ppid": F.expr("try_cast(s['process_parent_id'] as bigint)"), "image": image, "parent_image": g("process_parent_path"), "command_line": g("CommandLine"), "parent_name": F.coalesce(g("process_parent_name"), C.basename(g("process_parent_path"))),
        "user": name, "domain": domain, "integrity": g("IntegrityLevel"), "label": F.when(~hit, 0), "label_rule": F.when(hit, "excluded/rule_hit").otherwise("benign/real_environment"), "grp": F.concat(F.lit("flattened:"), host),
    }
    return rows.where(when.isNotNull() & pid.isNotNull() & image.isNotNull()).select(*_row(made))


_START = "event struct<id:string,timestamp:string>, source struct<kind:string>, host struct<id:string>, user struct<name:string,domain:string>, process struct<pid:bigint,name:string,executable:string,command_line:string,parent:struct<pid:bigint,name:string>>, source_facts struct<process:struct<executable:string,parent_pid:bigint,parent_executable:string,process_guid:string,parent_process_guid:string>>"


def starts(records: DataFrame) -> DataFrame:
    """event_id, host_id, pid, ppid, us, name, kind (of source) and self of process starts in an agent's package, with what its facts add."""
    d = F.from_json("data", _START)
    rows = records.where("kind = 'observation' and category = 'process'").select(d.alias("d"), F.coalesce("self", F.lit(False)).alias("self"), "record_id")
    p, f = "d.process", "d.source_facts.process"
    image = F.coalesce(f"{p}.executable", f"{f}.executable")
    us = F.unix_micros(F.try_to_timestamp("d.event.timestamp"))
    return rows.select(
        F.coalesce("d.event.id", "record_id").alias("event_id"), F.coalesce("d.host.id", F.lit("UNKNOWN_HOST")).alias("host_id"), F.col(f"{p}.pid").alias("pid"), F.coalesce(f"{p}.parent.pid", f"{f}.parent_pid").alias("ppid"), us.alias("us"),
        F.lower(C.basename(F.coalesce(f"{p}.name", f"{p}.executable"))).alias("name"), F.col("d.source.kind").alias("kind"), "self", image.alias("image"), F.col(f"{f}.parent_executable").alias("parent_image"), F.col(f"{p}.command_line").alias("command_line"),
        F.coalesce(F.nullif(f"{p}.parent.name", F.lit("")), C.basename(F.col(f"{f}.parent_executable"))).alias("parent_name"), F.col(f"{f}.process_guid").alias("guid"), F.col(f"{f}.parent_process_guid").alias("parent_guid"), F.col("d.user.name").alias("user"), F.col("d.user.domain").alias("domain"),
    ).where("us is not null and pid is not null")


def agent_rows(records: DataFrame, dataset: str, own: DataFrame | None = None, window: int = 600_000_000, pair: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows of an agent's package, and counts of what was dropped: its own processes and what they start, and the twin of a start that another sensor reports.

    own: host_id, pid, since, until of the collector's own processes, besides those that are marked.
    """
    from emberline.operators.identity import own_children
    from emberline.operators.joins import band

    all_ = starts(records)
    marked = all_.where("self").select("host_id", "pid", F.col("us").alias("since"), (F.col("us") + window).alias("until"))
    spans = marked if own is None else marked.unionByName(own)
    stop = F.from_json("data", "host struct<id:string>, process struct<pid:bigint>")
    stops = records.where("category = 'process_stop'").select(stop.alias("d"), F.unix_micros(F.try_to_timestamp("observed_at")).alias("us")).select(F.coalesce("d.host.id", F.lit("UNKNOWN_HOST")).alias("host_id"), F.col("d.process.pid").alias("pid"), "us")
    clean = all_.where("not self")
    children = own_children(clean.select("event_id", "host_id", "pid", "ppid", "us"), spans, stops, window)
    kept = clean.join(children.select("event_id"), "event_id", "left_anti")
    main, twin = kept.where("kind = 'sysmon'"), kept.where("kind = 'etw'")
    paired = band(twin.select("event_id", "host_id", "pid", "name", "us"), main.select("host_id", "pid", "name", F.col("us").alias("other_us")), ["host_id", "pid", "name"], "us", "other_us", pair).select("event_id").distinct()
    made = {
        "row_id": F.col("event_id"), "source": F.lit("agent"), "dataset": F.lit(dataset), "host": F.col("host_id"), "utc": F.timestamp_micros("us"), **{c: F.col(c) for c in ("guid", "parent_guid", "pid", "ppid", "image", "parent_image", "command_line", "parent_name", "user", "domain")},
        "label": F.lit(0), "label_rule": F.lit("benign/agent_recording"), "grp": F.concat(F.lit("agent:"), "host_id"),
    }
    counts = {"self_tagged": all_.where("self"), "self_children": children, "twin": paired, "twin_unpaired": twin.join(paired, "event_id", "left_anti"), "rows": main}
    from functools import reduce

    return main.select(*_row(made)), reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("what"), F.count("*").alias("n")) for n, df in counts.items()])


def ecar_starts(lines: DataFrame, dataset: str) -> DataFrame:
    """Rows of the process creations of eCAR lines; an image without a path is left out, as only a benign set has such. Others are never parsed."""
    likely = lines.where(F.contains("value", F.lit('"PROCESS"')) & F.contains("value", F.lit('"CREATE"')))
    schema = "id string, object string, action string, hostname string, timestamp string, timestamp_ms bigint, pid bigint, ppid bigint, principal string, objectID string, actorID string, properties map<string,string>"
    rows = likely.select(F.from_json("value", schema).alias("r")).select("r.*").where("object = 'PROCESS' and action = 'CREATE'")
    p = lambda k: F.nullif(F.try_element_at("properties", F.lit(k)), F.lit(""))
    image, parent = C.drive_path(p("image_path")), C.drive_path(p("parent_image_path"))
    when = F.coalesce(F.try_to_timestamp("timestamp"), F.timestamp_millis(F.expr("try_cast(timestamp as bigint)")), F.timestamp_millis("timestamp_ms"))
    host, real = F.coalesce("hostname", F.lit("UNKNOWN_HOST")), lambda c: F.when(F.col(c) >= 0, F.col(c))
    name, domain = C.account(F.coalesce(p("user"), F.nullif("principal", F.lit(""))))
    made = {
        "row_id": _id(F.lit(dataset), host, F.lit("ecar"), F.coalesce("id", "objectID")), "source": F.lit("ecar"), "dataset": F.lit(dataset), "host": host, "utc": when, "guid": F.col("objectID"), "parent_guid": F.col("actorID"), "pid": real("pid"), "ppid": real("ppid"),
        "image": image, "parent_image": parent, "command_line": p("command_line"), "parent_name": C.basename(parent), "user": name, "domain": domain, "label": F.lit(0), "label_rule": F.lit("benign/benign_period"), "grp": F.concat(F.lit("ecar:"), host),
    }
    return rows.where(image.isNotNull() & F.contains(image, F.lit("\\")) & when.isNotNull() & real("pid").isNotNull()).select(*_row(made))


def together(*sources: DataFrame) -> DataFrame:
    """Rows of all sources."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [s.select(*ROW) for s in sources])
