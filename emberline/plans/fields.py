"""Fields that rules read, as columns of canonical events. Only fields that the given rules read are worked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators import joins
from emberline.operators.causality import BOUNDARY
from emberline.plans.rules import HASH_KINDS, Rule, intel_flag, intel_read, read_fields

_c = F.col
#: Indicators that are known without a table of one's own.
KNOWN_INTEL = (
    ("hash", "58593a38d72bb01c5f3b7c844cf19597793b8782a20b72c918a287a93540a931", "Mimikatz", "Credential Stealer", 15),
    ("hash", "24d004a104d4d54034dbcffc2a4b19a11f39008a575aa614ea04703480b1022c", "WannaCry", "Ransomware", 16),
    ("hash", "a8e52e4726bf60b7324f6e3a5180f128e08d5aa4a4d6a6bb7c2bc350d32bb584", "Cobalt Strike", "Command & Control Beacon", 15),
    ("ip", "198.51.100.45", "APT29", "Cobalt Strike C2 Server", 15),
    ("ip", "203.0.113.88", "LockBit Affiliate", "LockBit Ransomware Exfiltration Gateway", 16),
)
INTEL_SCHEMA = "kind string, value string, name string, threat_type string, severity_level int"


def _flag(mask: int) -> Column:
    return _c("access_mask").bitwiseAND(F.lit(mask)) != 0


#: Fields that are a column of their own.
PLAIN = {
    "host_id": "host_id", "event_type": "event_type", "process.name": "process_name", "process.executable": "executable", "process.executable_path": "executable", "process.command_line": "command_line",
    "process.pid": "pid", "process.process_guid": "process_guid", "process.user": "user", "process.file_hash": "sha256", "process.sha256": "sha256", "parent.name": "parent_name", "parent.pid": "ppid",
    "network.direction": "direction", "network.destination_ip": "destination_ip", "network.destination_port": "destination_port", "file.path": "path", "file.previous_path": "previous_path",
    "registry.key_path": "key_path", "registry.value_name": "value_name", "registry.value_data": "value_data", "image.path": "image_path", "image.is_signed": "is_signed", "target.pid": "target_pid",
    "target.name": "target_name", "target.executable": "target_path", "network.protocol": "protocol", "network.source_ip": "source_ip", "network.source_port": "source_port", "image.sha256": "image_sha256", "image.signature_status": "signature_status",
    "script_block.text_length": "script_length", "script_block.text_sha256": "script_sha256", "process.start_time_ticks": "start_time_ticks", "host.name": "host_name", "dns.query_status": "query_status", "remote_thread.start_module": "start_module", "remote_thread.start_function": "start_function", "process_access.call_trace": "call_trace", "dns.query_name": "query_name",
    "script_block.text": "script_text", "process.image_writer_name": "image_writer_name", "process.image_age_seconds": "image_age_seconds", "process.ancestor_names": "ancestor_names", "process.tree_root_name": "tree_root_name",
}


def derived(name: str) -> Column | None:
    """A field that is worked out of columns; None if there is none of this name."""
    made = {
        "process.deobfuscated_command": lambda: C.deobfuscated(_c("command_line")),
        "process.normalized_command": lambda: C.deobfuscated(_c("command_line")),
        "process.is_obfuscated": lambda: F.size(C.evasion_techniques(_c("command_line"))) > 0,
        "process.evasion_techniques": lambda: F.array_join(C.evasion_techniques(_c("command_line")), ", "),
        "process.entropy": lambda: F.round(C.entropy(_c("command_line")), 3),
        "process.is_high_entropy": lambda: C.high_entropy(_c("command_line")),
        "process.path_class": lambda: C.path_class(_c("executable")),
        "file.path_class": lambda: C.path_class(_c("path")),
        "image.path_class": lambda: C.path_class(_c("image_path")),
        "target.path_class": lambda: C.path_class(_c("target_path")),
        "script_block.evasion_techniques": lambda: F.array_join(C.evasion_techniques(_c("script_text")), ", "),
        "dns.answers": lambda: F.array_join(C.dns_answers(_c("query_results")), ", "),
        "file.extension": lambda: C.file_extension(_c("path")),
        "file.extension_changed": lambda: C.extension_changed(_c("path"), _c("previous_path")),
        "network.destination_scope": lambda: C.destination_scope(_c("destination_ip")),
        "process_access.can_read_memory": lambda: _flag(0x10),
        "process_access.can_write_memory": lambda: _flag(0x20),
        "process_access.can_create_thread": lambda: _flag(0x02),
        "process_access.via_minidump": lambda: F.lower("call_trace").rlike(r"dbghelp\.dll|dbgcore\.dll"),
        "process_access.unbacked_caller": lambda: F.contains(F.lower("call_trace"), F.lit("unknown")),
        "script_block.deobfuscated_text": lambda: C.deobfuscated(_c("script_text")),
        "script_block.is_obfuscated": lambda: F.size(C.evasion_techniques(_c("script_text"))) > 0,
        "dns.is_dga": lambda: C.is_generated_domain(_c("query_name")),
        "dns.query_entropy": lambda: F.round(C.entropy(C.second_level(_c("query_name"))), 3),
        "process.ancestry": lambda: derived("process.lineage"),
        "process.lineage": lambda: F.array_join(F.reverse(F.concat(F.array("process_name"), F.coalesce("ancestor_names", F.array().cast("array<string>")))), " -> "),
    }
    return made[name]() if name in made else None


def with_tree(events: DataFrame) -> DataFrame:
    """Adds ancestor_names (parent first), tree_root and tree_root_name: the topmost ancestor, or the process itself, below the first boundary process.

    A process is a host and a pid here; its last start counts.
    """
    node = F.struct("host_id", "pid")
    last = events.where("event_type = 'process_create' and pid is not null").groupBy(node.alias("node")).agg(F.max_by(F.struct("ppid", "process_name", "parent_name"), "ts").alias("p"))
    links = last.where("p.ppid is not null").select("node", F.struct(F.col("node.host_id").alias("host_id"), F.col("p.ppid").alias("pid")).alias("parent"))
    names = last.select("node", F.col("p.process_name").alias("name")).unionByName(last.select(F.struct(F.col("node.host_id").alias("host_id"), F.col("p.ppid").alias("pid")).alias("node"), F.col("p.parent_name").alias("name")))
    names = names.where("node.pid is not null").groupBy(F.col("node").alias("ancestor")).agg(F.min("name").alias("name"))
    up = joins.ancestors(links).join(names, "ancestor", "left")
    chain = up.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "name", "ancestor"))).alias("l"))
    hub = lambda x: F.coalesce(F.lower(x["name"]).isin(*BOUNDARY), F.lit(False))
    first = F.coalesce(F.array_min(F.transform(F.filter("l", hub), lambda x: x["level"])), F.lit(1 << 30))
    below = F.filter("l", lambda x: x["level"] < first)
    top = F.when(F.size(below) > 0, F.element_at(below, -1))
    tree = chain.select(F.col("node.host_id").alias("host_id"), F.col("node.pid").alias("pid"), F.transform("l", lambda x: x["name"]).alias("ancestor_names"), top["ancestor"]["pid"].alias("_root"), top["name"].alias("_root_name"))
    return events.join(tree, ["host_id", "pid"], "left").withColumns({"tree_root": F.coalesce("_root", "pid"), "tree_root_name": F.coalesce("_root_name", "process_name")}).drop("_root", "_root_name")


def with_image_writer(events: DataFrame) -> DataFrame:
    """Adds image_writer_name and image_age_seconds to starts: who last wrote the image before, and how long ago."""
    starts = events.where("event_type = 'process_create' and executable is not null").withColumns({"_file": F.lower("executable"), "_at": F.unix_micros("ts")})
    writes = events.where("event_type in ('file_create', 'file_rename') and path is not null").select("host_id", F.lower("path").alias("_file"), F.unix_micros("ts").alias("_since"), F.col("process_name").alias("_writer"))
    got = joins.as_of(starts, writes, ["host_id", "_file"], "_at", "_since", ["_writer"])
    got = got.withColumns({"image_writer_name": F.col("match__writer"), "image_age_seconds": F.round((F.col("_at") - F.col("match__since")) / 1e6, 3)})
    rest = events.where("not coalesce(event_type = 'process_create' and executable is not null, false)")
    return got.select(*events.columns, "image_writer_name", "image_age_seconds").unionByName(rest, allowMissingColumns=True)


def with_intel(events: DataFrame, wanted: set[tuple[str, str]], intel: DataFrame) -> DataFrame:
    """Adds for each field and kind the flag that in_threat_intel reads, and what is known of it (<flag>:known, JSON). intel: INTEL_SCHEMA.

    A left join with distinct values: Spark broadcasts a small table and shuffles a large one.
    """
    for name, is_hash in sorted({(n, k in HASH_KINDS) for n, k in wanted}):
        column = f"`{name}`" if name in events.columns else PLAIN.get(name, name)
        if column.strip("`") not in events.columns:
            continue
        flag = intel_flag(name, "hash" if is_hash else "ip")
        value = F.lower("value") if is_hash else F.trim("value")
        rows = intel.where(F.col("kind") == ("hash" if is_hash else "ip")).groupBy(value.alias("_value")).agg(F.max(F.to_json(F.struct("name", "threat_type", "severity_level"))).alias(f"{flag}:known"))
        own = F.lower(_c(column).cast("string")) if is_hash else F.trim(_c(column).cast("string"))
        events = events.withColumn("_own", own).join(rows, F.col("_own") == F.col("_value"), "left").drop("_own", "_value").withColumn(flag, F.col(f"`{flag}:known`").isNotNull())
    return events


def derive(events: DataFrame, rules: list[Rule], intel: DataFrame | None = None) -> DataFrame:
    """Canonical events with one more column for each field that the rules read; a field that nobody knows is null, so that it never matches."""
    wanted = set().union(*[read_fields(r) for r in rules]) if rules else set()
    looked = intel_read(rules) | ({("process.file_hash", "hash")} if "threat_intel.hash_match" in wanted else set()) | ({("network.destination_ip", "ip")} if "threat_intel.ip_match" in wanted else set())
    if wanted & {"process.image_writer_name", "process.image_age_seconds"}:
        events = with_image_writer(events)
    has_ancestor = any("has_ancestor" in str(r.logic) + str(r.steps) for r in rules)
    if has_ancestor or wanted & {"process.ancestor_names", "process.tree_root_name", "process.lineage", "process.ancestry"} or any("process_tree" in r.by for r in rules):
        events = with_tree(events)
    made = {}
    for name in sorted(wanted - set(events.columns)):
        own = derived(name)
        made[name] = own if own is not None else _c(PLAIN[name]) if PLAIN.get(name) in events.columns else F.lit(None).cast("string")
    events = events.withColumns(made) if made else events
    if looked:
        spark = events.sparkSession
        events = with_intel(events, looked, intel if intel is not None else spark.createDataFrame(list(KNOWN_INTEL), INTEL_SCHEMA))
        known = {"threat_intel.hash_match": ("process.file_hash", "hash"), "threat_intel.ip_match": ("network.destination_ip", "ip")}
        for name, at in known.items():
            column = f"{intel_flag(*at)}:known"
            if name in wanted and column in events.columns:
                of = F.col(f"`{column}`")
                events = events.withColumn(name, F.when(F.col("event_type") == "network_connect", of) if at[1] == "ip" else of)
        events = events.drop(*[c for c in events.columns if c.startswith("_intel:") and c.endswith(":known")])
    return events


def registry() -> dict[str, list[str]]:
    """The fields that rules may read: those with a column of their own, and those that are worked out."""
    import re
    from inspect import getsource

    made = sorted(set(re.findall(r'"([a-z_]+\.[a-z_]+)": lambda', getsource(derived))))
    return {"plain": sorted(PLAIN), "derived": [*made, "threat_intel.hash_match", "threat_intel.ip_match"]}


def unknown_fields(rules: list[Rule]) -> list[str]:
    """Fields that rules read and nothing produces, each with its rule."""
    known = {x for part in registry().values() for x in part}
    return [f"{r.id}: {f}" for r in rules for f in sorted(read_fields(r)) if f not in known]
