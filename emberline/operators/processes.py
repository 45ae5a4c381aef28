"""The record of features of each process, from identity, lineage and graph; and the baseline of what is rare."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.functions import features as X
from emberline.operators.graph import adjacent, busy, first_edges
from emberline.operators.identity import iso, lineage
from emberline.operators.joins import as_of
from emberline.plans.lineage import held

#: Version of the record, and of the baseline's file.
FEATURE_VERSION, BASELINE_FORMAT, BASELINE_TYPE = 3, 1, "process_rarity"
#: Endings of images, and of those and scripts.
IMAGES = (".exe", ".dll", ".scr", ".sys", ".com")
DROPPED = (*IMAGES, ".ps1", ".vbs", ".vbe", ".js", ".jse", ".hta", ".bat", ".cmd", ".wsf")
#: Fixed pattern: registry keys that start programs.
PERSISTENCE = r"(?i)\\currentversion\\(?:run|runonce|runservices)\b|\\services\\[^\\]+\\imagepath|image file execution options|\\winlogon\\(?:userinit|shell)|\\currentversion\\explorer\\shell folders"
#: The behaviour bits, in order, and the most distinct objects that one counts.
BITS = ("child:shell_or_lolbin", "file:executable_to_user_path", "registry:persistence_key", "image_load:user_path_module", "image_load:unsigned_module", "process_access:lsass_read", "remote_thread:out", "remote_thread:in", "network:public_destination", "network:public_nonstandard_port", "dns:failed_query", "script_block:obfuscated")
MOST_OBJECTS = 10


def _said(kind: Column, label: Column, attrs: Column) -> list[Column]:
    """Whether an edge gives each behaviour bit, in order, to its source; remote_thread:in is for its target alone."""
    attr = lambda k: F.try_element_at(attrs, F.lit(k))
    writable, suffix = F.coalesce(C.path_class(label).isin("user_writable", "temp"), F.lit(False)), F.coalesce(C.file_extension(label), F.lit(""))
    public = (kind == "connected_to") & (C.destination_scope(attr("ip")) == "public")
    said = {
        "child:shell_or_lolbin": (kind == "forked") & X.role(F.lower(label)).isin("shell", "script_host", "lolbin", "admin_tool", "discovery"),
        "file:executable_to_user_path": (kind == "wrote") & writable & suffix.isin(*DROPPED),
        "registry:persistence_key": kind.isin("set_value", "created_key") & label.rlike(PERSISTENCE),
        "image_load:user_path_module": (kind == "loaded") & writable,
        "image_load:unsigned_module": (kind == "loaded") & (attr("is_signed") == "false"),
        "process_access:lsass_read": (kind == "accessed") & F.endswith(F.lower(label), F.lit("lsass.exe")) & (attr("access_mask").cast("bigint").bitwiseAND(F.lit(0x10)) != 0),
        "remote_thread:out": kind == "injected",
        "network:public_destination": public,
        "network:public_nonstandard_port": public & ~F.coalesce(attr("port").isin("53", "80", "443"), F.lit(False)),
        "dns:failed_query": (kind == "resolved") & attr("query_status").isNotNull() & (attr("query_status") != "0"),
        "script_block:obfuscated": (kind == "ran_script") & (attr("obfuscated") == "true"),
    }
    return [F.coalesce(said.get(b, F.lit(False)), F.lit(False)) for b in BITS]


def bits(kind: Column, label: Column, attrs: Column, out: Column) -> Column:
    """The behaviour bits that an edge gives to its source (out), or to its target."""
    given = F.array_compact(F.array(*[F.when(c, F.lit(b)) for b, c in zip(BITS, _said(kind, label, attrs), strict=True)]))
    return F.when(out, given).otherwise(F.when(kind == "injected", F.array(F.lit("remote_thread:in"))).otherwise(F.array().cast("array<string>")))


def touched(edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """node_id, out (whether the node is the source), other (node) and bits: a row for each end of each edge up to a time."""
    rows = adjacent(edges if as_of is None else edges.where(F.col("us") <= as_of))
    rows = rows.withColumns({"out": F.col("src") == F.col("node_id"), "other": F.when(F.col("src") == F.col("node_id"), F.col("dst")).otherwise(F.col("src"))})
    return rows.withColumn("bits", bits(F.col("kind"), F.col("label"), F.col("attrs"), F.col("out")))


#: What edges are counted as, in the order of the marks of _noted().
COUNTS = ("child_count", "file_write_count", "executable_write_count", "registry_write_count", "network_connect_count", "public_connect_count", "module_load_count", "dns_query_count", "failed_dns_query_count", "process_access_count", "lsass_access_count", "remote_thread_count", "injected_thread_count", "script_block_count", "obfuscated_script_block_count")


def _noted(edges: DataFrame, as_of: Column | None, processes: bool) -> tuple[DataFrame, DataFrame]:
    """node_id, does (a mark for each of COUNTS), shows (a mark for each of BITS) and what else counts of an edge: a row for each end of each edge up to a time; and node_id of all these ends.

    processes: only for ends that are processes, of all edges that say something of them. Else of the first MOST_EDGES of each node.
    """
    kind, label, attrs = F.col("kind"), F.col("label"), F.col("attrs")
    attr = lambda k: F.try_element_at(attrs, F.lit(k))
    marks = lambda cs: sum((F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, c in enumerate(cs)), F.lit(0))
    leaf = F.lower(C.basename(label))
    does = {
        "child_count": kind == "forked",
        "file_write_count": kind == "wrote",
        "executable_write_count": (kind == "wrote") & C.file_extension(label).isin(*IMAGES),
        "registry_write_count": kind.isin("set_value", "created_key", "deleted_key"),
        "network_connect_count": kind == "connected_to",
        "public_connect_count": (kind == "connected_to") & (C.destination_scope(attr("ip")) == "public"),
        "module_load_count": kind == "loaded",
        "dns_query_count": kind == "resolved",
        "failed_dns_query_count": (kind == "resolved") & attr("query_status").isNotNull() & (attr("query_status") != "0"),
        "process_access_count": kind == "accessed",
        "lsass_access_count": (kind == "accessed") & (leaf == "lsass.exe"),
        "remote_thread_count": kind == "injected",
        "script_block_count": kind == "ran_script",
        "obfuscated_script_block_count": (kind == "ran_script") & (attr("obfuscated") == "true"),
    }
    source = F.struct(
        F.col("src").alias("node_id"), F.col("dst").alias("other"), marks([does.get(c, F.lit(False)) for c in COUNTS]).alias("does"), marks(_said(kind, label, attrs)).alias("shows"),
        F.when(kind.isin("accessed", "injected") & (leaf != ""), leaf).alias("leaf"), F.when(kind == "resolved", F.lower(label)).alias("domain"), F.when(kind == "ran_script", attr("text_length").cast("bigint")).alias("bytes"),
    )
    into = lambda names, n: marks([(kind == "injected") if x == n else F.lit(False) for x in names])
    none = F.lit(None).cast("string")
    target = F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other"), into(COUNTS, "injected_thread_count").alias("does"), into(BITS, "remote_thread:in").alias("shows"), none.alias("leaf"), none.alias("domain"), F.lit(None).cast("bigint").alias("bytes"))
    met = (F.col("src") != F.col("dst")) & (kind.isin("forked", "accessed", "injected") if processes else F.lit(True))
    told = edges if as_of is None else edges.where(F.col("us") <= as_of)
    ends = told.select(F.explode(F.array_compact(F.array("src", F.when(met, F.col("dst"))))).alias("node_id"))
    rows = told.select("us", "edge_id", F.explode(F.array_compact(F.array(source, F.when(met, target)))).alias("e"))
    rows = rows.select("e.*") if processes else first_edges(rows.select("e.*", "us", "edge_id"), ends).drop("us", "edge_id")
    rows = rows.withColumn("other", F.when(F.col("shows") != 0, F.col("other")))
    return (rows.where("does <> 0 or shows <> 0") if processes else rows), ends


def _marked(c: Column, names: tuple[str, ...], n: str) -> Column:
    return c.bitwiseAND(F.lit(1 << names.index(n))) != 0


def _totals(**sets: Column) -> list[Column]:
    """The aggregates of rows of _noted() that are a node's counts and distinct names; in their places what takes a set of objects."""
    names = lambda n: F.array_sort(F.collect_set(F.when(_marked(F.col("does"), COUNTS, n), F.col("leaf"))))
    counts = [F.count_if(_marked(F.col("does"), COUNTS, n)).alias(n) for n in COUNTS]
    return [
        *counts[:-1],
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("script_block_bytes"),
        counts[-1],
        *[c.alias(n) for n, c in sets.items()],
        names("process_access_count").alias("access_targets"),
        names("remote_thread_count").alias("remote_thread_targets"),
    ]


def _in_one(rows: DataFrame) -> DataFrame:
    """Rows of _noted() by node, by one aggregation behind one shuffle: a node's objects are held as a set."""
    seen = F.collect_set(F.when(F.col("shows") != 0, F.struct("shows", "other"))).alias("_seen")
    got = rows.repartition("node_id").groupBy("node_id").agg(*_totals(distinct_domain_count=F.size(F.collect_set("domain")).cast("long")), seen)
    objects = lambda b: F.size(F.array_distinct(F.transform(F.filter("_seen", lambda x: _marked(x["shows"], BITS, b)), lambda x: x["other"]))).cast("long")
    return got.withColumn("_objects", F.array(*[objects(b) for b in BITS])).drop("_seen")


def _in_steps(rows: DataFrame) -> DataFrame:
    """The same for nodes of very many edges: each distinct object is brought together apart, so a node is never held whole and no task gets all of it."""
    domains = rows.where("domain is not null").select("node_id", "domain").distinct().groupBy("node_id").agg(F.count("*").alias("_domains"))
    met = rows.where("shows <> 0").groupBy("node_id", "other").agg(F.bit_or("shows").alias("shows"))
    objects = met.groupBy("node_id").agg(F.array(*[F.count_if(_marked(F.col("shows"), BITS, b)) for b in BITS]).alias("_objects"))
    got = rows.groupBy("node_id").agg(*_totals(distinct_domain_count=F.lit(0).cast("long"))).join(domains, "node_id", "left").join(objects, "node_id", "left")
    none = F.array(*[F.lit(0).cast("long") for _ in BITS])
    return got.withColumns({"distinct_domain_count": F.coalesce("_domains", F.lit(0)), "_objects": F.coalesce("_objects", none)}).drop("_domains")


def _summed(edges: DataFrame, as_of: Column | None, processes: bool = False) -> DataFrame:
    """What each node did up to a time: counts, distinct names, and the objects of each behaviour bit, of which MOST_OBJECTS say as much as more."""
    rows, ends = _noted(edges, as_of, processes)
    many = busy(ends) if processes else None
    if many is None:
        got = _in_one(rows)
    else:
        by_hash = rows.select("*", F.xxhash64("node_id").alias("_h"))
        got = _in_one(by_hash.join(many, "_h", "left_anti").drop("_h")).unionByName(_in_steps(by_hash.join(many, "_h", "left_semi").drop("_h")))
    each = [F.struct(F.lit(b).alias("bit"), F.least(F.col("_objects")[i], F.lit(MOST_OBJECTS)).cast("long").alias("objects")) for i, b in enumerate(BITS)]
    return got.withColumn("found", F.filter(F.array(*each), lambda x: x["objects"] > 0)).drop("_objects")


def behaviour(edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """What each node did up to a time: 16 counts, and distinct names."""
    return _summed(edges, as_of).drop("found")


def bit_objects(edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """node_id, bit, objects: how many distinct objects each behaviour bit of a node has, MOST_OBJECTS at most."""
    return _summed(edges, as_of).select("node_id", F.explode("found").alias("x")).select("node_id", "x.*")


def first_bits(edges: DataFrame, most: int = 8) -> DataFrame:
    """node_id, bit, us: when each node first showed each behaviour bit, the first `most` of them: its checkpoints between start and stop."""
    from emberline.operators.aggregates import capped

    first = touched(edges).select("node_id", "us", F.explode("bits").alias("bit")).groupBy("node_id", "bit").agg(F.min("us").alias("us"))
    return capped(first, ["node_id"], ["us", "bit"], most)


def records(runs: DataFrame, edges: DataFrame, written: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The record of 47 features of each process. written: node_id, image_writer_name and image_age_seconds of runs whose image was written before."""
    tree = held(lineage(runs).select("node_id", F.slice("ancestor_names", 1, 4).alias("ancestor_names"), "depth", F.col("root_name").alias("tree_root_name")))
    command = F.coalesce("command_line", F.lit(""))
    parent, grandparent = F.nullif(F.try_element_at("ancestor_names", F.lit(1)), F.lit("")), F.nullif(F.try_element_at("ancestor_names", F.lit(2)), F.lit(""))
    name = F.coalesce("name", F.lit(""))
    did = _summed(edges, as_of, processes=True)
    none = F.array().cast("array<string>")
    rows = runs.join(tree, "node_id", "left").join(did, "node_id", "left").join(written, "node_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in did.columns if c.endswith(("count", "bytes"))]
    found = F.coalesce("found", F.array().cast("array<struct<bit:string,objects:bigint>>"))
    ended = F.col("end_observed") & (F.lit(True) if as_of is None else F.col("end_us") <= as_of)
    return rows.select(
        F.lit(FEATURE_VERSION).alias("feature_schema_version"), "host_id", "node_id", "pid", F.col("ppid").alias("parent_pid"), name.alias("name"), F.coalesce("executable", F.lit("")).alias("executable"),
        C.path_class(F.col("executable")).alias("path_class"), iso(F.col("start_us")).alias("start_time"), F.coalesce("user", F.lit("")).alias("user"), "inferred", parent.alias("parent_name"), grandparent.alias("grandparent_name"),
        F.nullif("tree_root_name", F.lit("")).alias("tree_root_name"), F.coalesce("depth", F.lit(0)).alias("depth"), F.when((parent != "") & (name != ""), F.concat(parent, F.lit(" -> "), name)).alias("parent_child"),
        F.length(command).alias("cmdline_length"), F.size(F.filter(F.split(command, r"\s+"), lambda x: x != "")).alias("cmdline_token_count"), F.round(C.entropy(command), 3).alias("cmdline_entropy"),
        (F.size(C.evasion_techniques(command)) > 0).alias("cmdline_obfuscated"), F.size(C.evasion_techniques(command)).alias("cmdline_evasion_count"), "image_writer_name", "image_age_seconds", *counts,
        F.coalesce("access_targets", none).alias("access_targets"), F.coalesce("remote_thread_targets", none).alias("remote_thread_targets"), F.transform(found, lambda x: x["bit"]).alias("behavior_bits"), found.alias("behavior_bit_objects"),
        F.when(ended, F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3)).alias("lifetime_seconds"), (F.lit(None).cast("string") if as_of is None else iso(as_of)).alias("as_of"), F.coalesce("ancestor_names", none).alias("ancestor_names"),
    )


def image_writes(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, image_writer_name and image_age_seconds: who else last wrote or renamed a run's image before it started, and how long before.

    An as-of join: a file that is often written and often run never meets itself in all pairs.
    """
    from emberline.operators.graph import entity

    files = runs.where("executable is not null and executable <> ''").select("node_id", "start_us", entity("file", F.col("host_id"), F.col("executable")).alias("file"))
    writes = edges.where("kind in ('wrote', 'renamed')").select(F.col("dst").alias("file"), F.col("us").alias("since"), F.col("src").alias("writer"), "edge_id")
    # A run's own writes do not count, so each write also knows the last one before it of another writer; of one time, the last write stands for all.
    order = Window.partitionBy("file").orderBy("since", "edge_id")
    own, before = F.struct("writer", "since"), F.lag(F.struct("writer", "since")).over(order)
    known = writes.withColumns({"own": own, "_change": F.when(before["writer"] != F.col("writer"), before), "_next": F.lead("since").over(order)})
    known = known.withColumn("other", F.last("_change", ignorenulls=True).over(order)).where("_next is null or _next <> since").select("file", "since", "own", "other")
    last = as_of(files, known, ["file"], "start_us", "since", ["own", "other"])
    which = F.when(F.col("match_own.writer") != F.col("node_id"), F.col("match_own")).otherwise(F.col("match_other"))
    last = last.select("node_id", "start_us", which.alias("w")).where("w is not null").select("node_id", "start_us", "w.writer", "w.since")
    names = runs.select(F.col("node_id").alias("writer"), F.nullif(F.coalesce("name", F.lit("")), F.lit("")).alias("image_writer_name"))
    return last.join(names, "writer").select("node_id", "image_writer_name", F.round((F.col("start_us") - F.col("since")) / 1e6, 6).alias("image_age_seconds"))


def rarity(records_: DataFrame) -> DataFrame:
    """dimension, value, n of what was seen to start: names, parent and child, name and kind of place, and who opens or injects into whom."""
    rows = records_.where("not inferred and name <> ''")
    entry = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    crossed = lambda c, how: F.transform(c, lambda t: entry("cross_process", F.concat(F.col("name"), F.lit(" -> "), t, F.lit(f" ({how})"))))
    plain = F.array_compact(F.array(entry("name", F.col("name")), F.when(F.col("parent_child").isNotNull(), entry("parent_child", F.col("parent_child"))), F.when(F.col("path_class").isNotNull(), entry("name_path_class", F.concat("name", F.lit(" @ "), "path_class")))))
    values = rows.select(F.explode(F.concat(plain, crossed(F.col("access_targets"), "access"), crossed(F.col("remote_thread_targets"), "remote_thread"))).alias("r")).select("r.*")
    return values.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def readiness(baseline: DataFrame, starts: int = 200, relationships: int = 25, crossed: int = 10) -> DataFrame:
    """observations, relationships, crossed, ready and crossed_ready of a baseline."""
    of = lambda d, v: F.coalesce(F.sum(F.when(F.col("dimension") == d, v)), F.lit(0)).cast("long")
    got = baseline.agg(of("name", F.col("n")).alias("observations"), of("parent_child", F.lit(1)).alias("relationships"), of("cross_process", F.col("n")).alias("crossed"))
    ready = (F.col("observations") >= starts) & (F.col("relationships") >= relationships)
    return got.withColumns({"ready": ready, "crossed_ready": ready & (F.col("crossed") >= crossed)})


def rated(values: DataFrame, baseline: DataFrame, uncommon: int = 2, **limits: int) -> DataFrame:
    """Adds n, category (not_ready, unseen, uncommon, common) and relative to rows of dimension and value.

    The place of a process is judged only if its name (column `name`, where there is one) is known.
    """
    one = readiness(baseline, **limits).select(F.col("observations").alias("_all"), F.col("crossed").alias("_crossed"), F.col("ready").alias("_ready"), F.col("crossed_ready").alias("_crossed_ready"))  # one row
    out = values.join(baseline, ["dimension", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(F.broadcast(one))
    if "name" in values.columns:
        known = baseline.where("dimension = 'name'").select(F.col("value").alias("name"), F.lit(True).alias("_known"))
        out = out.join(known, "name", "left").where("dimension <> 'name_path_class' or _known").drop("_known")
    cross = F.col("dimension") == "cross_process"
    ready, total = F.when(cross, F.col("_crossed_ready")).otherwise(F.col("_ready")), F.when(cross, F.col("_crossed")).otherwise(F.col("_all"))
    category = F.when(~ready, "not_ready").when(F.col("n") == 0, "unseen").when(F.col("n") <= uncommon, "uncommon").otherwise("common")
    return out.withColumns({"category": category, "relative": F.when(total > 0, F.round(F.col("n") / total, 6)).otherwise(0.0)}).drop("_all", "_crossed", "_ready", "_crossed_ready")


def _content(counts: dict[str, dict[str, int]], limits: dict[str, int], uncommon: int, first: str | None, last: str | None) -> dict[str, Any]:
    return {
        "baseline_type": BASELINE_TYPE, "format_version": BASELINE_FORMAT, "feature_schema_version": FEATURE_VERSION, "readiness": limits, "thresholds": {"uncommon_max_count": uncommon},
        "observed_from": first, "observed_to": last, "total_observations": sum(counts["name"].values()), "counts": {d: dict(sorted(t.items())) for d, t in counts.items()},
    }


def _version(content: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:12]


#: Entries of a baseline that may be brought to the driver for its file.
MOST_ENTRIES = 1_000_000


def baseline_document(baseline: DataFrame, first: str | None = None, last: str | None = None, uncommon: int = 2, starts: int = 200, relationships: int = 25, crossed: int = 10) -> dict[str, Any]:
    """A baseline as the document of its file, with a version that comes from its content."""
    rows = baseline.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a baseline file holds {MOST_ENTRIES} entries at most; write a larger one as a table")
    counts: dict[str, dict[str, int]] = {d: {} for d in ("name", "parent_child", "name_path_class", "cross_process")}
    for r in rows:
        counts[r.dimension][r.value] = r.n
    content = _content(counts, {"min_observations": starts, "min_relationships": relationships, "min_cross_process": crossed}, uncommon, first, last)
    return content | {"baseline_version": _version(content)}


def baseline_from(spark: SparkSession, document: dict[str, Any]) -> DataFrame:
    """dimension, value, n of a baseline's document; one of another kind or version, or one that was changed, is an error."""
    content = {k: v for k, v in document.items() if k not in ("baseline_version", "created_at")}
    for key, want in (("baseline_type", BASELINE_TYPE), ("format_version", BASELINE_FORMAT), ("feature_schema_version", FEATURE_VERSION)):
        if document.get(key) != want:
            raise ValueError(f"{key} is {document.get(key)!r}, not {want!r}")
    if document.get("baseline_version") not in (None, _version(content)):
        raise ValueError("the baseline's version does not fit its content")
    return spark.createDataFrame([(d, v, n) for d, t in document["counts"].items() for v, n in t.items()], "dimension string, value string, n long")
