"""From detections to alerts: records, responses, incident alerts, coverage of tactics, and the texts that people read."""

from __future__ import annotations

import json
import textwrap
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.plans.rules import Rule

#: The tactics of coverage reports, in their order.
TACTICS = (("TA0001", "Initial Access"), ("TA0002", "Execution"), ("TA0003", "Persistence"), ("TA0004", "Privilege Escalation"), ("TA0005", "Defense Evasion"), ("TA0006", "Credential Access"), ("TA0007", "Discovery"), ("TA0008", "Lateral Movement"), ("TA0009", "Collection"), ("TA0011", "Command and Control"), ("TA0010", "Exfiltration"), ("TA0040", "Impact"))
#: Applications through which attacks enter, and what context adds to an incident's score, up to a cap.
ENTRY = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe", "msaccess.exe", "mspub.exe", "visio.exe", "chrome.exe", "msedge.exe", "firefox.exe", "iexplore.exe", "brave.exe", "opera.exe", "thunderbird.exe", "acrord32.exe", "acrobat.exe")
CONTEXT, MOST_CONTEXT = {"entry": 0.10, "writable": 0.08, "public": 0.07, "obfuscated": 0.05}, 0.25


def response(level: Column, pid: Column, asked: Column) -> Column:
    """The action that a detection recommends: the rule's own, else one by level; one that nobody knows is none."""
    known = asked.isin("TERMINATE_PROCESS", "ISOLATE_HOST", "COLLECT_PROCESS_INFO", "COLLECT_NETWORK_CONNECTIONS", "QUARANTINE_FILE")
    by_level = F.when(level.between(12, 13) & pid.isNotNull() & (pid != 0), "TERMINATE_PROCESS").when(level >= 14, "ISOLATE_HOST")
    return F.when(asked.isNotNull(), F.when(known, asked)).otherwise(by_level)


def response_class(action: Column, source: Column, ticks: Column) -> Column:
    """How a recommendation is staged: by itself, only recorded, or for approval; a kill without a token of the process cannot be carried out."""
    return (
        F.when(action.isNull(), "none")
        .when(action.isin("COLLECT_PROCESS_INFO", "COLLECT_NETWORK_CONNECTIONS"), "auto")
        .when(source == "behavioral", "record-only (behavioral)")
        .when((action == "TERMINATE_PROCESS") & ticks.isNull(), "unexecutable")
        .otherwise("approval")
    )


def alert_id(rule: Column, event: Column, host: Column, at: Column, evidence: Column) -> Column:
    """An id from the content of a detection, so that a replay makes the same one."""
    keys = F.array_join(F.array_sort(F.map_keys(evidence)), ",")
    return F.concat(F.lit("ALT-"), F.upper(F.substring(F.sha1(F.concat(rule, F.lit("|"), F.coalesce(event, F.lit("")), F.lit("|"), F.coalesce(host, F.lit("")), F.lit("|"), F.coalesce(at, F.lit("")), F.lit("|"), keys)), 1, 8)))


def records(hits: DataFrame, rules: list[Rule], source: str = "rule") -> DataFrame:
    """Alerts of rules.scan(): id, rule, texts, level, evidence, response and technique, as their record has them."""
    spark = hits.sparkSession
    facts = spark.createDataFrame([(r.id, r.name or r.id, r.description, r.severity, float(r.confidence), r.active_response, r.technique) for r in rules], "rule_id string, title string, description string, severity string, confidence double, asked string, mitre_technique string")  # a row for each rule
    rows = hits.join(F.broadcast(facts), "rule_id", "left")
    pid = F.col("pid") if "pid" in hits.columns else F.lit(None).cast("long")
    file = F.col("path") if "path" in hits.columns else F.lit(None).cast("string")
    action = response(F.col("level"), pid, F.col("asked"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if "ts" in hits.columns else F.col("us").cast("string")
    said = F.when(action.isNotNull(), F.struct(action.alias("action"), "host_id", F.when(action != "COLLECT_NETWORK_CONNECTIONS", pid).alias("target_pid"), F.when(action == "QUARANTINE_FILE", file).alias("target_file"), F.concat(F.lit("Rule ["), F.col("rule_id"), F.lit("] triggered at Level "), F.col("level").cast("string")).alias("reason")))
    evidence = F.map_concat(F.col("evidence"), F.create_map(F.lit("matched_conditions"), F.col("matched")))
    return rows.select(
        alert_id(F.col("rule_id"), F.col("event_id").cast("string"), F.col("host_id"), at, F.col("evidence")).alias("alert_id"), "rule_id", "title", "description", "level", "severity", "confidence", "host_id", at.alias("timestamp"),
        F.col("event_id").cast("string").alias("event_id"), evidence.alias("evidence"), said.alias("active_response"), F.col("tactic").alias("mitre_tactic"), "mitre_technique", F.lit(source).alias("detection_source"),
    )


def host_evidence(alerts: DataFrame) -> DataFrame:
    """host_id, rules, confidence and alerts: what a host's risk rests on."""
    return alerts.groupBy("host_id").agg(F.count_distinct("rule_id").alias("rules"), F.round(F.avg("confidence"), 3).alias("confidence"), F.count("*").alias("alerts"))


def context(scopes: DataFrame, runs: DataFrame, edges: DataFrame) -> DataFrame:
    """incident_id, factors and context: what the processes of an incident add to its score. scopes: incident_id, node_id, is_root."""
    public = edges.where("kind = 'connected_to'").where(C.destination_scope(F.try_element_at("attrs", F.lit("ip"))) == "public").select(F.col("src").alias("node_id")).distinct().withColumn("_public", F.lit(True))
    rows = scopes.join(runs.select("node_id", "name", "executable", "command_line"), "node_id").join(public, "node_id", "left")
    marks = {
        "entry": F.col("is_root") & F.col("name").isin(*ENTRY),
        "writable": C.path_class(F.col("executable")).isin("temp", "user_writable"),
        "public": F.coalesce("_public", F.lit(False)),
        "obfuscated": F.size(C.evasion_techniques(F.coalesce("command_line", F.lit("")))) > 0,
    }
    got = rows.groupBy("incident_id").agg(*[F.bool_or(F.coalesce(m, F.lit(False))).alias(k) for k, m in marks.items()])
    total = sum((F.when(F.col(k), F.lit(v)).otherwise(0.0) for k, v in CONTEXT.items()), F.lit(0.0))
    return got.select("incident_id", F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in CONTEXT])).alias("factors"), F.round(F.least(total, F.lit(MOST_CONTEXT)), 3).alias("context"))


def origins(scopes: DataFrame, runs: DataFrame) -> DataFrame:
    """incident_id, origin_node_id and origin: the earliest process of an incident that is no boundary."""
    from emberline.operators.causality import BOUNDARY

    rows = scopes.join(runs.select("node_id", "name", "start_us"), "node_id").where(~F.coalesce(F.col("name").isin(*BOUNDARY), F.lit(False)))
    return rows.groupBy("incident_id").agg(F.min(F.struct("start_us", "node_id", "name")).alias("f")).select("incident_id", F.col("f.node_id").alias("origin_node_id"), F.col("f.name").alias("origin"))


def paths(path_edges: DataFrame, nodes: DataFrame, most: int = 25) -> DataFrame:
    """incident_id and causal_path: the first edges of an incident as lines of text. path_edges: incident_id, edge_id, kind, src, dst, us."""
    from emberline.operators.identity import iso

    name = lambda n: F.when(F.col(f"{n}.kind") == "process", F.concat(F.coalesce(F.col(f"{n}.label"), F.lit("")), F.lit("["), F.coalesce(F.try_element_at(F.col(f"{n}.attrs"), F.lit("pid")), F.lit("?")), F.lit("]"))).otherwise(F.coalesce(F.col(f"{n}.label"), F.lit("?")))
    first = path_edges.withColumn("_p", F.row_number().over(Window.partitionBy("incident_id").orderBy("us", "edge_id"))).where(F.col("_p") <= most)
    of = nodes.select("node_id", F.struct("kind", "label", "attrs").alias("n"))
    both = first.join(of.select(F.col("node_id").alias("src"), F.col("n").alias("a")), "src", "left").join(of.select(F.col("node_id").alias("dst"), F.col("n").alias("b")), "dst", "left")
    line = F.concat(iso(F.col("us")), F.lit(" "), name("a"), F.lit(" -["), F.col("kind"), F.lit("]-> "), name("b"))
    return both.groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", line.alias("line")))), lambda x: x["line"]).alias("causal_path"))


def incident_alerts(incidents: DataFrame, stages: DataFrame) -> DataFrame:
    """The alert of each revision of an incident. incidents: incident_id, revision, host_id, band, score, root_name, root_pid, root_node_id, root_ticks; stages: incident_id, us, rule_id, tactic, confidence, alert_id."""
    of = stages.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("us", "rule_id", "tactic", "alert_id"))).alias("s"), F.min(F.when(F.col("tactic") != "", F.col("confidence"))).alias("least"))
    tactics = F.array_distinct(F.transform(F.filter("s", lambda x: F.coalesce(x["tactic"], F.lit("")) != ""), lambda x: x["tactic"]))
    chain = F.array_join(F.transform("s", lambda x: F.when(F.coalesce(x["tactic"], F.lit("")) != "", F.concat(x["rule_id"], F.lit(" ("), x["tactic"], F.lit(")"))).otherwise(x["rule_id"])), " -> ")
    rows = incidents.join(of, "incident_id").withColumns({"tactics": tactics, "attack_chain": chain, "root": F.coalesce("root_name", F.lit("unknown"))})
    many = lambda c: F.size(c).cast("string")
    level = F.when(F.col("band") == "critical", 15).when(F.col("band") == "high", 13).otherwise(11)
    kill = F.when(F.col("root_pid").isNotNull() & F.col("root_ticks").isNotNull(), F.struct(F.lit("TERMINATE_PROCESS").alias("action"), "host_id", F.col("root_pid").alias("target_pid"), F.col("root_node_id").alias("target_guid"), F.col("root_ticks").alias("target_start_time_ticks")))
    return rows.select(
        F.concat("incident_id", F.lit("-R"), F.col("revision").cast("string")).alias("alert_id"), F.lit("PROV-CAMPAIGN").alias("rule_id"), "incident_id", "host_id", level.alias("level"), F.col("band").alias("severity"),
        F.concat(F.lit("[INCIDENT] "), many("tactics"), F.lit("-tactic attack chain rooted at "), F.col("root")).alias("title"),
        F.concat(many("s"), F.lit(" causally-connected detection(s) across "), many("tactics"), F.lit(" ATT&CK tactic(s) on "), F.col("host_id"), F.lit(", traced back to "), F.col("root"), F.lit(".")).alias("description"),
        F.round(F.coalesce("least", F.lit(0.5)), 3).alias("confidence"), "attack_chain", F.transform("s", lambda x: x["alert_id"]).alias("members"), "score", kill.alias("active_response"), F.lit("correlation").alias("detection_source"),
    )


# ---- coverage


def coverage_report(spark, rules: list[Rule]) -> DataFrame:
    """place, tactic_id, tactic, rules and techniques of every tactic of the matrix, those without a rule, too; any other tactic behind them."""
    rows = spark.createDataFrame([(r.id, (r.tactic or "Unknown").strip(), r.technique) for r in rules if r.technique], "rule_id string, tactic string, technique string")
    order = spark.createDataFrame([(i, a, b, b.lower()) for i, (a, b) in enumerate(TACTICS)], "place int, tactic_id string, tactic string, key string")
    by = rows.groupBy(F.lower("tactic").alias("key")).agg(F.min("tactic").alias("_name"), F.count("*").alias("rules"), F.array_sort(F.collect_set("technique")).alias("techniques"))
    out = order.join(by, "key", "full")
    return out.select(F.coalesce("place", F.lit(99)).alias("place"), F.coalesce("tactic_id", F.lit("TA9999")).alias("tactic_id"), F.coalesce("tactic", "_name").alias("tactic"), F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques")).orderBy("place", "tactic")


def heatmap(spark, rules: list[Rule]) -> str:
    """Coverage as a table of text."""
    rows = coverage_report(spark, rules).collect()  # a row for each tactic
    known = [r for r in rows if r.place < 99]
    covered = sum(r.rules > 0 for r in known)
    bar = "=" * 80
    lines = [bar, "ATT&CK coverage by tactic", bar, f"  rules {len(rules)}, techniques {len({t for r in rows for t in r.techniques})}, tactics {covered} / {len(known)} ({round(100 * covered / len(known), 1)}%)", "-" * 80]
    lines += [f"{r.tactic_id:<10} | {r.tactic:<24} | {'covered' if r.rules else 'no rules':<10} | {r.rules:>3} | {', '.join(r.techniques) or '-'}" for r in known]
    return "\n".join([*lines, bar])


def navigator_layer(rules: list[Rule], name: str = "Detection coverage") -> dict[str, Any]:
    """A layer for the ATT&CK Navigator: a technique for each rule, coloured by level."""
    color = lambda n: "#e02424" if n >= 12 else "#e3a008" if n >= 7 else "#3f83f8"
    techniques = [{"techniqueID": r.technique, "score": r.level, "color": color(r.level), "comment": f"Rule [{r.id}]: {r.name or r.id} (Level {r.level})", "enabled": True} for r in rules if r.technique]
    return {"name": name, "version": "4.5", "domain": "enterprise-attack", "techniques": techniques, "gradient": {"colors": ["#3f83f8", "#e3a008", "#e02424"], "minValue": 0, "maxValue": 16}}


# ---- texts


def advice(action: dict[str, Any] | None) -> str:
    """What a response asks for, and who approves it; the column of this is columns.recommendation()."""
    if not action:
        return "no action recommended -- detection only"
    target = ", ".join([*([f"pid {action['target_pid']}"] if action.get("target_pid") is not None else []), *([action["target_file"]] if action.get("target_file") else [])])
    head = action["action"] + (f" ({target})" if target else "")
    return head + (" -- requires analyst approval before it runs" if action["action"] in ("TERMINATE_PROCESS", "ISOLATE_HOST", "QUARANTINE_FILE", "RELEASE_HOST_ISOLATION") else " -- read-only, may run automatically")


def console(alert: dict[str, Any], width: int = 78) -> str:
    """An alert in a box."""
    badge = "[CRITICAL]" if alert["level"] >= 15 else "[HIGH]" if alert["level"] >= 12 else "[DETECTION]"
    technique = f"{alert.get('mitre_tactic') or '-'} / {alert.get('mitre_technique') or '-'}" if alert.get("mitre_tactic") or alert.get("mitre_technique") else ""
    rows = [("Host", alert["host_id"]), ("Rule", alert["rule_id"]), ("Observed", alert.get("description")), ("ATT&CK", technique), ("Severity", f"level {alert['level']}/16 ({str(alert.get('severity') or '').upper()}), confidence {(alert.get('confidence') or 0) * 100:.0f}%"), ("Recommended", advice(alert.get("active_response")))]
    inner = width - 4
    lines = ["┌" + "─" * (width - 2) + "┐", *(f"│ {t:<{inner}} │" for t in textwrap.wrap(f"{badge} {alert['title']}", inner)), "├" + "─" * (width - 2) + "┤"]
    for label, value in rows:
        for i, part in enumerate(textwrap.wrap(str(value or ""), inner - 17)):
            lines.append(f"│ {label if i == 0 else '':<14} {':' if i == 0 else ' '} {part:<{inner - 17}} │")
    return "\n".join([*lines, "└" + "─" * (width - 2) + "┘"])


def as_json(alert: dict[str, Any], indent: int | None = None) -> str:
    return json.dumps(alert, indent=indent, default=str)


def narrative(alerts: DataFrame) -> DataFrame:
    """step and text: a story of alerts in order of time, then what they come to. Steps are numbered through the whole table, by its ranges of time."""
    from emberline.operators.evaluation import running

    action = F.col("active_response")
    technique = F.when(F.col("mitre_tactic") != "", F.concat(F.lit("\n        technique : "), F.col("mitre_tactic"), F.lit(" / "), F.coalesce("mitre_technique", F.lit("-")))).otherwise("")
    mark = F.when(F.col("severity") == "critical", "!!").when(F.col("severity") == "high", "! ").otherwise("  ")
    by = alerts.withColumn("_at", F.concat_ws("|", "timestamp", "alert_id")).dropDuplicates(["_at"]).withColumn("one", F.lit(1))
    placed = running(by.select("_at", "one"), "_at", ["one"]).select("_at", (F.col("before_one") + 1).alias("step"))
    number = F.lpad(F.col("step").cast("string"), F.greatest(F.lit(2), F.length(F.col("step").cast("string"))), "0")
    text = F.concat(F.lit("  "), mark, F.lit(" STEP "), number, F.lit("  "), C.clean_title(F.col("title")), F.lit("\n        host      : "), F.col("host_id"), F.lit("\n        observed  : "), F.coalesce("description", F.lit("")), technique, F.lit("\n        recommend : "), C.recommendation(action["action"], action["target_pid"], action["target_file"]))
    steps = by.join(placed, "_at").select("step", text.alias("text"))
    end = alerts.agg(F.lit(2**62).alias("step"), F.concat(F.count("*").cast("string"), F.lit(" detection(s) across "), F.count_distinct("host_id").cast("string"), F.lit(" host(s) | "), F.count("active_response").cast("string"), F.lit(" response action(s) recommended for analyst review")).alias("text"))
    return steps.unionByName(end)
