"""Sources: newline-delimited telemetry, and telemetry derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape of one wire event; never inferred.
WIRE = (
    "schema_version string, event struct<id:string,category:string,type:string,timestamp:string>, source struct<kind:string,provider:string,channel:string,record_id:string>, agent struct<id:string,version:string>, raw struct<host_id:string>, host struct<id:string,hostname:string>, user struct<name:string,domain:string>, "
    "process struct<entity_id:string,start_time_ticks:bigint,pid:bigint,name:string,executable:string,command_line:string,parent:struct<pid:bigint,name:string,executable:string>,hash:struct<sha256:string>,sha256:string>, "
    "network struct<direction:string,protocol:string,destination_ip:string,destination_port:bigint,dst_ip:string,dst_port:bigint,source_ip:string,source_port:bigint,src_ip:string,src_port:bigint,initiated:boolean>, file struct<operation:string,path:string,previous_path:string>, "
    "registry struct<operation:string,key_path:string,key:string,target_object:string,value_name:string,value_data:string>, dns struct<query_name:string,query_results:string,query_status:bigint>, "
    "image_load struct<path:string,image_loaded:string,is_signed:boolean,signed:boolean,sha256:string,signature_status:string>, image struct<path:string,image_loaded:string,is_signed:boolean,signed:boolean,sha256:string,signature_status:string>, "
    "process_access struct<target:struct<pid:bigint,executable:string>,granted_access:string,call_trace:string>, "
    "remote_thread struct<target:struct<pid:bigint,executable:string>,start_module:string,start_function:string>, script_block struct<text:string,path:string,script_block_id:string,message_number:bigint,text_length:bigint,text_sha256:string>"
)

_CASE = lambda key, values: f"case {key} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"
NAMES = ("whoami.exe", "net.exe", "ipconfig.exe", "powershell.exe", "cmd.exe", "winword.exe", "svchost.exe", "explorer.exe", "chrome.exe", "rundll32.exe", "nltest.exe", "systeminfo.exe")
COMMANDS = ("'powershell.exe -enc SQBFAFgAIABhAGIAYwA='", "'cmd.exe /c w^h^o^a^m^i'", "null", "'net user /domain'", "'powershell ''down''+''load'''", "'C:/Users/Bob Smith/AppData/Local/Temp/a1b2c3d4.tmp 12345'", "'rundll32.exe C:/Windows/System32/x.dll,Start'", "''")
PATHS = ("'C:/Users/a/AppData/Local/Temp/x.exe'", "'C:/Users/a/Downloads/report.PDF'", "'C:/Program Files/App/app.exe'", "'/usr/bin/curl'", "'D:/tools/x.tar.gz'", "'powershell.exe'", "null")
ADDRESSES = ("concat('10.0.', k, '.', user_id % 250)", "'203.0.113.10'", "'127.0.0.1'", "'8.8.8.8'", "'224.0.0.251'", "'169.254.10.1'", "'not-an-ip'", "null")
DOMAINS = ("'google.com'", "'xkjqw1987znvcb.biz'", "'mail.example.org.'", "null", "'aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q0NTY3ODk.cdn.attacker-c2.com'")
TYPES = {"signup": "process_create", "click": "network_connect", "view": "file_create", "purchase": "file_rename", "error": "registry_write"}

_TEMPLATE = (
    "select event_id, us, user_id, k, value, concat('H', user_id % 16) as host_id, user_id as pid, {parent} as ppid, "
    "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in TYPES.items()) + " end as event_type, "
    f"{_CASE('k % 12', [f"'{x}'" for x in NAMES])} as process_name, {_CASE('k % 8', COMMANDS)} as command_line, {_CASE('(k + user_id) % 7', PATHS)} as path, "
    f"{_CASE('k % 8', ADDRESSES)} as destination_ip, (k * 7919) % 65536 as destination_port, {_CASE('k % 5', DOMAINS)} as query_name, k * 97 as access_mask "
    "from (select event_id, user_id, event_type, value, {micros} as us, {k} as k from {events}) x"
)
#: The same rows for the SQL that checks queries.
ORACLE = "with tel as (" + _TEMPLATE.format(parent="user_id // 10", micros="epoch_us(ts)", k="cast(json_extract_string(props, '$.k') as bigint)", events="events") + ") "


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry from the `events` table, as one projection of its scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = _TEMPLATE.format(parent="user_id div 10", micros="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", k="cast(get_json_object(props, '$.k') as bigint)", events="{events}")
    return spark.sql(sql, events=events)


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Wire events of newline-delimited files; blank lines, comments and malformed lines are left out."""
    return wire(spark.read.text(path))


def wire(lines: DataFrame) -> DataFrame:
    """Wire events of a frame of lines, batch or stream."""
    kept = lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return kept.select(F.from_json("value", WIRE, {"mode": "PERMISSIVE"}).alias("e"), "value").where("e is not null and e.event is not null").select("e.*")


def canonical(events: DataFrame) -> DataFrame:
    """One projection from wire events to the columns that rules read."""
    some = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    category, kind = F.lower("event.category"), F.lower("event.type")
    operation = F.lower(F.coalesce(some("file.operation"), some("event.type"), F.lit("create")))
    event_type = (
        F.when(category == "network", "network_connect")
        .when(category == "file", F.concat(F.lit("file_"), operation))
        .when(category == "registry", F.when(F.lower("registry.operation").isin("add_key", "delete_key", "rename_key"), F.concat(F.lit("registry_"), F.lower("registry.operation"))).otherwise("registry_write"))
        .when(category == "dns", "dns_query")
        .when(category == "script_block", "script_block")
        .when(category.isin("image_load", "image"), "image_load")
        .when(category.isin("process_access", "remote_thread"), category)
        .when(kind.isin("start", "create"), "process_create")
        .when(kind.isin("stop", "terminate"), "process_terminate")
        .otherwise(F.concat(F.lit("process_"), kind))
    )
    base = lambda c: F.nullif(F.element_at(F.split(F.rtrim(F.replace(F.col(c), F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1), F.lit(""))
    return events.select(
        F.col("event.id").alias("event_id"),
        F.try_to_timestamp("event.timestamp").alias("ts"),
        F.coalesce(some("host.id"), some("host.hostname"), some("raw.host_id"), F.lit("UNKNOWN_HOST")).alias("host_id"),
        event_type.alias("event_type"),
        F.col("process.pid").alias("pid"),
        F.coalesce(some("process.name"), base("process.executable")).alias("process_name"),
        F.col("process.executable").alias("executable"),
        F.col("process.command_line").alias("command_line"),
        F.col("process.parent.pid").alias("ppid"),
        F.coalesce(some("process.parent.name"), base("process.parent.executable")).alias("parent_name"),
        some("network.destination_ip", "network.dst_ip").alias("destination_ip"),
        F.coalesce("network.destination_port", "network.dst_port").alias("destination_port"),
        F.coalesce(F.lower("network.direction"), F.when(F.coalesce(F.col("network.initiated"), F.lit(True)), "outbound").otherwise("inbound")).alias("direction"),
        F.coalesce("file.path", F.when(category == "process", F.col("process.executable"))).alias("path"),
        F.col("file.previous_path").alias("previous_path"),
        F.rtrim(F.lower("dns.query_name"), F.lit(".")).alias("query_name"),
        F.col("process.entity_id").alias("process_guid"),
        F.when(some("user.name", "user.name").isNotNull(), F.concat_ws("\\", some("user.domain", "user.domain"), "user.name")).alias("user"),
        F.coalesce("process.hash.sha256", "process.sha256").alias("sha256"),
        some("registry.key_path", "registry.key", "registry.target_object").alias("key_path"),
        F.col("registry.value_name").alias("value_name"),
        F.col("registry.value_data").alias("value_data"),
        some("image_load.path", "image_load.image_loaded", "image.path", "image.image_loaded").alias("image_path"),
        F.coalesce("image_load.is_signed", "image_load.signed", "image.is_signed", "image.signed").alias("is_signed"),
        F.coalesce("process_access.target.pid", "remote_thread.target.pid").alias("target_pid"),
        F.coalesce(base("process_access.target.executable"), base("remote_thread.target.executable")).alias("target_name"),
        F.when(F.col("process_access.granted_access").rlike("^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substr("process_access.granted_access", F.lit(3)), 16, 10).cast("bigint")).alias("access_mask"),
        F.col("process_access.call_trace").alias("call_trace"),
        F.col("remote_thread.start_module").alias("start_module"),
        F.col("remote_thread.start_function").alias("start_function"),
        F.col("script_block.text").alias("script_text"),
        F.coalesce(some("host.hostname"), some("host.id")).alias("host_name"),
        F.coalesce(F.col("source.kind"), F.lit("agent")).alias("source_kind"),
        F.col("agent.version").alias("agent_version"),
        F.when(F.col("process.start_time_ticks") > 0, F.col("process.start_time_ticks")).alias("start_time_ticks"),
        F.lower("network.protocol").alias("protocol"),
        some("network.source_ip", "network.src_ip").alias("source_ip"),
        F.coalesce("network.source_port", "network.src_port").alias("source_port"),
        F.coalesce("image_load.sha256", "image.sha256").alias("image_sha256"),
        F.coalesce("image_load.signature_status", "image.signature_status").alias("signature_status"),
        F.col("dns.query_results").alias("query_results"),
        F.col("dns.query_status").alias("query_status"),
        F.coalesce("process_access.target.executable", "remote_thread.target.executable").alias("target_path"),
        F.col("script_block.script_block_id").alias("script_block_id"),
        F.col("script_block.message_number").alias("message_number"),
        F.coalesce("script_block.text_length", F.length("script_block.text")).alias("script_length"),
        F.coalesce("script_block.text_sha256", F.when(F.col("script_block.text").isNotNull(), F.sha2(F.col("script_block.text").cast("binary"), 256))).alias("script_sha256"),
    )


def lines_of(rows: DataFrame) -> DataFrame:
    """Wire lines (value) of rows with event_id, event_type, host_id, pid, ppid, us, process_name, command_line, path, destination_ip, destination_port and query_name."""
    category = F.when(F.startswith("event_type", F.lit("file")), "file").when(F.col("event_type") == "network_connect", "network").when(F.col("event_type") == "dns_query", "dns").when(F.startswith("event_type", F.lit("registry")), "registry").otherwise("process")
    kind = F.when(F.col("event_type") == "process_create", "start").when(F.col("event_type") == "process_terminate", "stop").otherwise(F.regexp_replace("event_type", "^[a-z]+_", ""))
    when = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    document = F.struct(
        F.lit("0.5").alias("schema_version"),
        F.struct(F.col("event_id").cast("string").alias("id"), category.alias("category"), kind.alias("type"), when.alias("timestamp")).alias("event"),
        F.struct(F.col("host_id").alias("id")).alias("host"),
        F.struct("pid", F.col("process_name").alias("name"), "command_line", F.col("path").alias("executable"), F.struct(F.col("ppid").alias("pid")).alias("parent")).alias("process"),
        F.when(category == "network", F.struct("destination_ip", "destination_port")).alias("network"),
        F.when(category == "file", F.struct(F.regexp_replace("event_type", "^file_", "").alias("operation"), "path")).alias("file"),
        F.when(category == "registry", F.struct(F.col("path").alias("key_path"))).alias("registry"),
        F.when(category == "dns", F.struct("query_name")).alias("dns"),
    )
    return rows.select(F.to_json(document).alias("value"))
