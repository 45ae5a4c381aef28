"""The provenance graph: what events say that processes did to files, sockets, keys, names, scripts and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators.identity import as_runs, iso, live_at
from emberline.plans.lineage import held

#: Relation of each event type, where a type has one only.
RELATIONS = {
    "network_connect": "connected_to", "file_create": "wrote", "file_write": "wrote", "file_delete": "deleted", "file_rename": "renamed", "registry_write": "set_value", "registry_add_key": "created_key",
    "registry_delete_key": "deleted_key", "registry_rename_key": "set_value", "image_load": "loaded", "dns_query": "resolved", "process_access": "accessed", "remote_thread": "injected", "script_block": "ran_script",
}
#: Edges of a node that what is counted of the graph itself looks at; records of processes count all, those of a node with more in steps.
MOST_EDGES = 4096


def entity(kind: str, host: Column, identifier: Column) -> Column:
    """Id of what is no process. Sockets are the same on all hosts."""
    scope = F.lit("") if kind == "socket" else host
    return F.concat(F.lit(f"{kind[:4]}_"), F.substring(F.sha2(F.concat(F.lit(f"{kind}|"), scope, F.lit("|"), F.lower(identifier)), 256), 1, 32))


def with_nodes(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events with node_id, the run that acts, and target_node_id, the one that is acted on, of identity.resolved()."""
    from emberline.operators.identity import node_id

    # as bytes, half as long and in the same order, while they are brought together
    named = found.where("kind in ('start', 'context', 'reference')").select("event_id", "kind", F.unhex(F.substr(node_id(F.col("host_id"), F.col("pid"), F.col("start_us")), F.lit(6))).alias("n"))
    by = named.groupBy("event_id").agg(F.max(F.when(F.col("kind") != "reference", F.col("n"))).alias("node_id"), F.max(F.when(F.col("kind") == "reference", F.col("n"))).alias("target_node_id"))
    text = lambda c: F.concat(F.lit("proc_"), F.lower(F.hex(c))).alias(c)
    return events.join(by, "event_id", "left").select(*events.columns, text("node_id"), text("target_node_id"))


def edges(events: DataFrame, runs: DataFrame) -> DataFrame:
    """edge_id, kind, src, dst, us, host_id, event_id, label, attrs (map) and inferred: one projection of events with nodes, and one of inferred runs.

    A start executes its image and is forked by its parent. An inferred run is forked at its first sighting.
    """
    have = lambda c, t="string": F.col(c).cast(t) if c in events.columns else F.lit(None).cast(t)
    some = lambda c: F.nullif(have(c), F.lit(""))
    host, kind = F.col("host_id"), F.col("event_type")
    rows = events.where("node_id is not null and us is not null")
    # only starts ask for what is known of their run, so only they are brought to it, and only their ids
    parents = runs.select(F.col("node_id").alias("_run"), F.col("parent_node_id").alias("_parent"), F.col("executable").alias("_image"))
    begun = held(rows.where("event_type = 'process_create'").select("event_id", F.col("node_id").alias("_run")).join(parents, "_run").drop("_run").dropDuplicates(["event_id"]))
    rows = rows.join(begun, "event_id", "left")
    attrs = lambda **a: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in a]), F.array(*[v.cast("string") for v in a.values()])), lambda _, v: v.isNotNull())
    edge = lambda k, src, dst, label, a: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), src.alias("src"), dst.alias("dst"), label.alias("label"), a.alias("attrs"))
    relation = F.coalesce(*[F.when(kind == t, F.lit(k)) for t, k in RELATIONS.items()])
    start, node = kind == "process_create", F.col("node_id")
    ip, port = some("destination_ip"), have("destination_port", "long")
    socket = F.when((port != 0) & port.isNotNull(), F.concat(ip, F.lit(":"), port.cast("string"))).otherwise(ip)
    key, name, script = some("key_path"), some("query_name"), F.coalesce(some("script_block_id"), some("script_sha256"))
    file, image = some("path"), some("image_path")
    obfuscated = F.size(C.evasion_techniques(F.coalesce(have("script_text"), F.lit("")))) > 0
    family = {
        "executed": F.when(start & F.col("_image_path").isNotNull(), edge("executed", node, entity("file", host, F.col("_image_path")), F.col("_image_path"), attrs(sha256=have("sha256")))),
        "forked": F.when(start & F.col("_parent").isNotNull(), edge("forked", F.col("_parent"), node, have("process_name"), attrs(command_line=have("command_line")))),
        "socket": F.when((kind == "network_connect") & ip.isNotNull(), edge(relation, node, entity("socket", host, socket), socket, attrs(ip=ip, port=port, direction=have("direction"), protocol=have("protocol")))),
        "file": F.when(kind.isin("file_create", "file_write", "file_delete", "file_rename") & file.isNotNull(), edge(relation, node, entity("file", host, file), file, attrs(previous_path=have("previous_path")))),
        "registry": F.when(F.startswith(kind, F.lit("registry_")) & key.isNotNull(), edge(relation, node, entity("registry_key", host, key), key, attrs(value_name=have("value_name")))),
        "image": F.when((kind == "image_load") & image.isNotNull(), edge(relation, node, entity("file", host, image), image, attrs(is_signed=have("is_signed"), signature_status=have("signature_status")))),
        "dns": F.when((kind == "dns_query") & name.isNotNull(), edge(relation, node, entity("domain", host, name), name, attrs(query_status=have("query_status")))),
        "access": F.when((kind == "process_access") & F.col("target_node_id").isNotNull(), edge(relation, node, F.col("target_node_id"), have("target_path"), attrs(access_mask=have("access_mask")))),
        "thread": F.when((kind == "remote_thread") & F.col("target_node_id").isNotNull(), edge(relation, node, F.col("target_node_id"), have("target_path"), attrs(start_module=have("start_module"), start_function=have("start_function")))),
        "script": F.when((kind == "script_block") & script.isNotNull(), edge(relation, node, entity("script", host, F.concat(script, F.lit("#"), F.coalesce(have("message_number"), F.lit("1")))), script, attrs(text_length=F.coalesce(have("text_length", "long"), F.length(have("script_text"))), obfuscated=obfuscated))),
    }
    rows = rows.withColumn("_image_path", F.coalesce(F.nullif(F.col("_image"), F.lit("")), some("executable")))
    made = F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("|", "kind", "src", "dst", iso(F.col("us")), F.coalesce(F.col("event_id").cast("string"), F.lit(""))), 256), 1, 32))
    seen = rows.select("us", "host_id", "event_id", F.explode(F.array_compact(F.array(*family.values()))).alias("e")).select("e.*", "us", "host_id", "event_id", F.lit(False).alias("inferred"))
    # an edge's id comes from its event's, so what is the same is where the event is, and edges need not be dealt out again
    seen = seen.withColumn("edge_id", made).dropDuplicates(["event_id", "edge_id"]).withColumn("event_id", F.col("event_id").cast("string"))
    guessed = runs.where("inferred and parent_node_id is not null").select(
        F.lit("forked").alias("kind"), F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst"), F.col("name").alias("label"), attrs(inferred=F.lit(True), command_line=F.col("command_line")).alias("attrs"),
        F.col("start_us").alias("us"), "host_id", F.lit(None).cast("string").alias("event_id"), F.lit(True).alias("inferred"),
    )
    return seen.unionByName(guessed.withColumn("edge_id", made))


def nodes(edges_: DataFrame, runs: DataFrame) -> DataFrame:
    """node_id, kind, label, first_us, degree and attrs of what edges touch: earliest time, first label that is not empty, latest value of each attribute. A process is labelled by its run alone."""
    kind = F.when(F.col("kind").isin("forked", "accessed", "injected"), "process").when(F.col("kind") == "connected_to", "socket").when(F.col("kind").isin("set_value", "created_key", "deleted_key"), "registry_key").when(F.col("kind") == "resolved", "domain").when(F.col("kind") == "ran_script", "script").otherwise("file")
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.lit("process").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("map<string,string>").alias("attrs")), F.struct(F.col("dst").alias("node_id"), kind.alias("kind"), F.when(kind != "process", F.col("label")).alias("label"), F.when(kind != "process", F.col("attrs")).alias("attrs")))
    rows = edges_.select("us", "edge_id", F.explode(ends).alias("n")).select("n.*", "us", "edge_id")
    first = F.min(F.when(F.col("label") != "", F.struct("us", "edge_id", "label")))["label"]
    made = rows.groupBy("node_id").agg(F.min("kind").alias("kind"), first.alias("label"), F.min("us").alias("first_us"), F.count("*").alias("degree"), F.max_by("attrs", F.struct("us", "edge_id")).alias("attrs"))
    named = runs.select("node_id", F.col("name").alias("_name"), "pid", "start_us")
    own = made.join(named, "node_id", "left")
    return own.select("node_id", "kind", F.coalesce("_name", "label").alias("label"), F.least("first_us", "start_us").alias("first_us"), "degree", F.coalesce("attrs", F.when(F.col("pid").isNotNull(), F.create_map(F.lit("pid"), F.col("pid").cast("string")))).alias("attrs"))


def busy(ends: DataFrame) -> DataFrame | None:
    """_h, the hash of each node that may have more than MOST_EDGES edges; None if no node has. ends: node_id of each end of each edge."""
    found = held(ends.groupBy(F.xxhash64("node_id").alias("_h")).agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES).select("_h"))
    return None if found.isEmpty() else found


def first_edges(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with node_id, us and edge_id: the first MOST_EDGES of each node. Only nodes that may have more are put in order. ends: node_id of the same rows."""
    many = busy(ends)
    if many is None:
        return rows
    by_hash = rows.select("*", F.xxhash64("node_id").alias("_h"))
    placed = by_hash.join(many, "_h", "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy("node_id").orderBy("us", "edge_id")))
    return by_hash.join(many, "_h", "left_anti").drop("_h").unionByName(placed.where(F.col("_place") <= MOST_EDGES).drop("_place", "_h"))


def adjacent(edges_: DataFrame) -> DataFrame:
    """node_id and edge columns: the edges of each node, the first MOST_EDGES of it."""
    both = edges_.withColumn("node_id", F.explode(F.array_distinct(F.array("src", "dst"))))
    return first_edges(both, both.select("node_id"))


def actor(kind: Column, src: Column, dst: Column) -> Column:
    """Whom a detection on an edge is about: a fork's child, else the source."""
    return F.when(kind == "forked", dst).otherwise(src)


def tags(edges_: DataFrame, hits: DataFrame, emitted: DataFrame) -> DataFrame:
    """edge_id, rule_id, actor, us, level, tactic and alert_id of hits (event_id, rule_id, level, tactic); alert_id is null where the alert was held back as a repeat.

    An event's edge is its fork where it has several. emitted: event_id, rule_id, alert_id.
    """
    e = edges_.where("not inferred and kind <> 'executed'").select("edge_id", "event_id", "us", actor(F.col("kind"), F.col("src"), F.col("dst")).alias("actor"))
    named = hits.select(F.col("event_id").cast("string").alias("event_id"), "rule_id", "level", "tactic")
    sent = emitted.select(F.col("event_id").cast("string").alias("event_id"), "rule_id", "alert_id").dropDuplicates(["event_id", "rule_id"])
    return e.join(named, "event_id").join(sent, ["event_id", "rule_id"], "left").select("edge_id", "event_id", "rule_id", "actor", "us", "level", "tactic", "alert_id")


def size(edges_: DataFrame, nodes_: DataFrame, tags_: DataFrame) -> DataFrame:
    """nodes, edges and tagged edges of a graph."""
    return nodes_.agg(F.count("*").alias("nodes")).join(edges_.agg(F.count("*").alias("edges"))).join(tags_.agg(F.count_distinct("edge_id").alias("tagged")))


def kept(rows: DataFrame, last: str, now_us: Column, horizon: int) -> DataFrame:
    """What a prune leaves: state that was touched within the horizon."""
    return rows.where(F.col(last) >= now_us - horizon)


def targets(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Cross-process events with the run that they act on (match_node_id)."""
    return live_at(events.where("event_type in ('process_access', 'remote_thread')"), as_runs(runs), "target_pid", "us")
