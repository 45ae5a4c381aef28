"""Queries over rules, alerts, labels, measures, sources and delivery, with the SQL that checks them where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.functions import variants as V
from emberline.operators import aggregates as A
from emberline.operators import alerts as AL
from emberline.operators import evaluation as E
from emberline.operators import identity as ID
from emberline.plans import fields
from emberline.plans import rules as R
from emberline.plans.catalogue import ENTROPY, HITS, RULES, put, tel
from emberline.plans.provenance import RUNS, parts, wide
from emberline.sources import files, records, rows, telemetry
from emberline.streaming import delivery

# ---- rules: threat intelligence, addresses, evidence, isolation

_INTEL = (("ip", "203.0.113.10", "x", "c2", 15), ("ip", " 8.8.8.8 ", "y", "dns", 4), ("ip", "203.0.113.10", "z", "c2", 15), ("hash", "ABC", "m", "tool", 9))


def _intel(s: SparkSession, d: str) -> DataFrame:
    rule = R.Rule("I-1", "network_connect", {"any": [{"field": "network.destination_ip", "operator": "in_threat_intel", "value": "c2"}, {"field": "process.file_hash", "operator": "in_threat_intel", "value": "sha256"}]}, evidence=["threat_intel.ip_match", "network.destination_ip"])
    events = tel(s, d).withColumn("sha256", F.when(F.col("k") % 10 == 0, "abc"))
    return R.scan(fields.derive(events, [rule], s.createDataFrame(list(_INTEL), fields.INTEL_SCHEMA)), [rule])


put("rule_threat_intel", lambda s, d: _intel(s, d).select("event_id"), "select event_id from tel where event_type = 'network_connect' and (destination_ip in ('203.0.113.10', '8.8.8.8') or k % 10 = 0)")
put(
    "threat_intel_evidence",
    lambda s, d: _intel(s, d).select("event_id", F.get_json_object(F.try_element_at("evidence", F.lit("threat_intel.ip_match")), "$.threat_type").alias("threat"), F.try_element_at("evidence", F.lit("network.destination_ip")).alias("address")),
    "select event_id, case destination_ip when '203.0.113.10' then 'c2' when '8.8.8.8' then 'dns' end as threat, destination_ip as address from tel where event_type = 'network_connect' and (destination_ip in ('203.0.113.10', '8.8.8.8') or k % 10 = 0)",
)
#: Addresses of both families, as an expression that both engines read, and what they are.
_ADDRESS = "case k % 12 when 0 then 'fe80::1' when 1 then '2001:db8::7' when 2 then '::1' when 3 then '::ffff:10.0.0.5' when 4 then '2606:4700:4700::1111' when 5 then 'ff02::fb' when 6 then 'fd12:3456:789a::1' when 7 then '::' when 8 then '1:2:3' when 9 then '203.0.113.9' when 10 then '4000::1' else '10.1.2.3' end"
put("address_scopes", lambda s, d: tel(s, d).selectExpr("event_id", f"{_ADDRESS} as a").select("event_id", C.destination_scope(F.col("a")).alias("scope")), "select event_id, case k % 12 when 0 then 'link_local' when 1 then 'private' when 2 then 'loopback' when 3 then 'private' when 4 then 'public' when 5 then 'multicast' when 6 then 'private' when 7 then 'private' when 8 then 'unknown' when 9 then 'public' when 10 then 'reserved' else 'private' end as scope from tel")
_CIDR = lambda blocks: {"all": [{"field": "a", "operator": "cidr", "value": blocks}]}
put(
    "address_blocks",
    lambda s, d: tel(s, d).selectExpr("event_id", f"{_ADDRESS} as a").select("event_id", R.condition(_CIDR(["fe80::/10", "10.0.0.0/8"])).alias("both"), R.condition(_CIDR(["2001:db8::/32", "10.0.0.0/99", "10.0.0.0/8"])).alias("broken"), R.condition(_CIDR("nonsense")).alias("none")),
    "select event_id, k % 12 in (0, 11) as \"both\", k % 12 = 1 as broken, false as none from tel",
)
_WITH_EVIDENCE = [R.Rule(r.id, r.event_type, r.logic, level=r.level, tactic=r.tactic, technique=r.technique, evidence=["process_name", "path", "nothing"]) for r in RULES]
put(
    "rule_evidence",
    lambda s, d: R.scan(tel(s, d), _WITH_EVIDENCE).select("event_id", "rule_id", F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("keys"), F.try_element_at("evidence", F.lit("path")).alias("path")),
    ", " + HITS + "select event_id, rule_id, case when path is null then 'process_name' else 'path,process_name' end as keys, path from hits",
)


def _isolated(s: SparkSession, d: str) -> DataFrame:
    """Two rules that cannot be planned, which stop no other."""
    broken = [R.Rule("B-1", "process_create", {"all": [{"field": "process_name", "operator": "regex", "value": "(?P<x>"}]}), R.Rule("B-2", "process_create", {"all": [{"field": "not.there", "operator": "equals", "value": 1}]})]
    errors: dict[str, str] = {}
    hits = R.scan(tel(s, d), [broken[0], *RULES, broken[1]], errors).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return hits.unionByName(s.createDataFrame([(k, -1) for k in errors], "rule_id string, hits long"))


put("rule_errors", _isolated, ", " + HITS + "select rule_id, count(*) as hits from hits group by all union all select * from (values ('B-1', -1::bigint), ('B-2', -1))")

# ---- alerts

_ASKED = "case k % 5 when 0 then 'ISOLATE_HOST' when 1 then 'QUARANTINE_FILE' when 2 then 'REVOKE_USER_SESSIONS' when 3 then 'COLLECT_PROCESS_INFO' end"
_ACTION = f"case when {_ASKED} is not null then nullif({_ASKED}, 'REVOKE_USER_SESSIONS') when k % 17 between 12 and 13 and pid <> 0 then 'TERMINATE_PROCESS' when k % 17 >= 14 then 'ISOLATE_HOST' end"
_RESPONSE = lambda s, d: tel(s, d).selectExpr("event_id", "host_id", "pid", "k", "path", f"{_ASKED} as asked").select("*", AL.response(F.col("k") % 17, F.col("pid"), F.col("asked")).alias("action"))
put("response_actions", lambda s, d: _RESPONSE(s, d).select("event_id", "action"), f"select event_id, {_ACTION} as action from tel")
put("response_classes", lambda s, d: _RESPONSE(s, d).select("event_id", AL.response_class(F.col("action"), F.when(F.col("k") % 2 == 0, "behavioral").otherwise("rule"), F.when(F.col("k") % 3 == 0, 1)).alias("stage")), f", a as (select *, {_ACTION} as action from tel) select event_id, case when action is null then 'none' when action = 'COLLECT_PROCESS_INFO' then 'auto' when k % 2 = 0 then 'record-only (behavioral)' when action = 'TERMINATE_PROCESS' and k % 3 <> 0 then 'unexecutable' else 'approval' end as stage from a")
put(
    "recommendations",
    lambda s, d: _RESPONSE(s, d).select("event_id", C.recommendation(F.col("action"), F.when(F.col("action") != "QUARANTINE_FILE", F.col("pid")), F.when(F.col("action") == "QUARANTINE_FILE", F.col("path"))).alias("text"), C.clean_title(F.concat(F.lit("[X] "), "asked")).alias("title")),
    f", a as (select *, {_ACTION} as action, {_ASKED} as asked from tel) select event_id, case when action is null then 'no action recommended -- detection only' else action || case when action = 'QUARANTINE_FILE' then coalesce(' (' || path || ')', '') else ' (pid ' || pid || ')' end || case when action = 'COLLECT_PROCESS_INFO' then ' -- read-only, may run automatically' else ' -- requires analyst approval before it runs' end end as text, asked as title from a",
)
put("alert_records", lambda s, d: AL.records(R.scan(tel(s, d), _WITH_EVIDENCE), RULES).select("event_id", "rule_id", "alert_id", F.col("active_response.action").alias("action"), "severity"), ", " + HITS + "select event_id::varchar as event_id, rule_id, 'ALT-' || upper(substr(sha1(rule_id || '|' || event_id || '|' || host_id || '|' || us || '|' || case when path is null then 'process_name' else 'path,process_name' end), 1, 8)) as alert_id, case when level between 12 and 13 and pid <> 0 then 'TERMINATE_PROCESS' when level >= 14 then 'ISOLATE_HOST' end as action, 'medium' as severity from hits")
put("host_evidence", lambda s, d: AL.host_evidence(AL.records(R.scan(tel(s, d), RULES), RULES)), ", " + HITS + "select host_id, count(distinct rule_id) as rules, 0.7::double as confidence, count(*) as alerts from hits group by host_id")
put("story", lambda s, d: AL.narrative(AL.records(R.scan(tel(s, d), RULES), RULES)).where("step < 1000000").select("step", F.element_at(F.split("text", "\n"), 2).alias("host")), ", " + HITS + ", o as (select host_id, row_number() over (order by us::varchar || '|' || 'ALT-' || upper(substr(sha1(rule_id || '|' || event_id || '|' || host_id || '|' || us || '|'), 1, 8))) as step from hits) select step, '        host      : ' || host_id as host from o where step < 1000000")
put("coverage_matrix", lambda s, d: AL.coverage_report(s, RULES).select("tactic_id", "rules", F.array_join("techniques", ",").alias("techniques")), "select t.id as tactic_id, coalesce(r.n, 0)::bigint as rules, coalesce(r.t, '') as techniques from (values " + ", ".join(f"('{a}')" for a, _ in AL.TACTICS) + ") t(id) left join (values ('TA0007', 2, 'T1083,T1087'), ('TA0008', 1, 'T1021'), ('TA0011', 1, 'T1071')) r(id, n, t) on r.id = t.id")

# ---- closures and side tables

_LINKS = lambda s, d: tel(s, d).where("pid > 0").select(F.concat("host_id", F.lit(":"), F.col("pid").cast("string")).alias("node"), F.concat("host_id", F.lit(":"), F.col("ppid").cast("string")).alias("parent"))
put("lineage_closure", lambda s, d: ID.closure(_LINKS(s, d)).groupBy("node").agg(F.max("level").cast("long").alias("depth"), F.count("*").alias("ancestors")), ", l as (select distinct host_id || ':' || pid as node, host_id || ':' || ppid as parent from tel where pid > 0 and pid <> ppid), c as (with recursive c as (select node, parent as ancestor, 1 as level from l union all select c.node, l.parent, c.level + 1 from c join l on l.node = c.ancestor where c.node <> l.parent) select * from c) select node, max(level)::bigint as depth, count(distinct ancestor) as ancestors from c group by node")
put(
    "own_children",
    lambda s, d: ID.own_children(tel(s, d).where("event_type = 'process_create'").select("event_id", "host_id", "pid", "ppid", "us"), tel(s, d).where("event_type = 'file_create'").where("user_id % 3 = 0").select("host_id", "pid", F.col("us").alias("since"), (F.col("us") + 10**12).alias("until")), tel(s, d).where("event_type = 'registry_write'").select("host_id", "pid", "us"), 10**12).select("event_id"),
    ", st as (select event_id, host_id, pid, ppid, us from tel where event_type = 'process_create'), stp as (select host_id, pid, us from tel where event_type = 'registry_write'), nx as (select st.*, coalesce((select min(us) from stp where stp.host_id = st.host_id and stp.pid = st.pid and stp.us >= st.us), st.us + 1000000000000) as until from st), "
    "o as (with recursive o as (select nx.event_id, nx.host_id, nx.pid, nx.us, nx.until from nx join tel t on t.host_id = nx.host_id and t.pid = nx.ppid and t.event_type = 'file_create' and t.user_id % 3 = 0 and nx.us between t.us and t.us + 1000000000000 union select nx.event_id, nx.host_id, nx.pid, nx.us, nx.until from o join nx on nx.host_id = o.host_id and nx.ppid = o.pid and nx.us between o.us and o.until) select * from o) select distinct event_id from o",
)
put("side_table", lambda s, d: ID.side(tel(s, d).select("event_id", "host_id"), tel(s, d).where("k % 3 = 0").select("event_id", F.col("process_name").alias("integrity")), ["event_id"], ["integrity"]), "select event_id, host_id, case when k % 3 = 0 then process_name end as integrity from tel")
put(
    "replay_labels",
    lambda s, d: ID.side(parts(s, d)[2].select("node_id", "host_id", "pid", F.col("start_us").alias("us")), tel(s, d).where("event_type = 'process_create'").groupBy("host_id", "pid", "us").agg(F.max(F.col("k") % 2).alias("label")), ["host_id", "pid", "us"], ["label"]).groupBy("label").agg(F.count("*").alias("n")),
    RUNS + "select l.label, count(*) as n from runs r left join (select host_id, pid, us, max(k % 2) as label from tel where event_type = 'process_create' group by all) l on l.host_id = r.host_id and l.pid = r.pid and l.us = r.start_us group by all",
)

# ---- measures and labels

_UNITS = lambda s, d: tel(s, d).select(F.col("host_id").alias("env"), (F.floor(F.col("value")) % 100 / 100).alias("score"), F.when(F.col("k") + F.col("value") > 120, 1).otherwise(0).alias("label"), F.lit(1).alias("n"), (F.col("user_id") % 3).alias("grp"), F.lit(100.0).alias("hours"), "k")
_UNITS_SQL = ", un as (select host_id as env, cast(floor(value) as bigint) % 100 / 100::double as score, case when k + value > 120 then 1 else 0 end as label, 1 as n, user_id % 3 as grp, 100.0::double as hours, k from tel) "
put("partial_auc", lambda s, d: E.partial_auc(_UNITS(s, d), 0.1), _UNITS_SQL + ", g as (select score, sum(label) as p, count(*) - sum(label) as q from un group by score), c as (select *, coalesce(sum(p) over o, 0) as bp, coalesce(sum(q) over o, 0) as bq, sum(p) over () as tp, sum(q) over () as tq from g window o as (order by score desc rows between unbounded preceding and 1 preceding)), x as (select bq / tq as x0, (bq + q) / tq as x1, bp / tp as y0, (bp + p) / tp as y1 from c), a as (select sum((least(x1, 0.1) - x0) * (y0 + case when x1 > x0 then y0 + (y1 - y0) * (least(x1, 0.1) - x0) / (x1 - x0) else y1 end) / 2) as a from x where x0 < 0.1) select round(0.5 * (1 + (a - 0.005) / (0.1 - 0.005)), 6) as auc from a")
_BUDGETS = {"alert": 0.02, "review": 0.2}
_LIMITS_SQL = _UNITS_SQL + ", bg as (select env, hours, score, sum(n) as fp from un where label = 0 group by all), cu as (select *, sum(fp) over (partition by env order by score desc) as total, max(score) over (partition by env) as top from bg), th as (select env, b.budget, coalesce(min(score) filter (total <= b.v * hours), max(top) + 1e-9) as threshold from cu cross join (values ('alert', 0.02), ('review', 0.2)) b(budget, v) group by env, b.budget) "
_LIMITS = lambda s, d: E.thresholds(_UNITS(s, d).where("label = 0").withColumnRenamed("n", "weight"), _BUDGETS)
put("budget_thresholds", lambda s, d: _LIMITS(s, d).withColumn("threshold", F.round("threshold", 6)), _LIMITS_SQL + "select env, budget, round(threshold, 6) as threshold from th")
put("minimax_thresholds", lambda s, d: E.minimax(_LIMITS(s, d)).withColumn("threshold", F.round("threshold", 6)), _LIMITS_SQL + "select budget, round(max(threshold), 6) as threshold from th group by budget")
put(
    "environment_report",
    lambda s, d: E.judged(_UNITS(s, d), 0.9).select("env", "malicious", "hits", "fp_events", "recall", "fp_per_hour", "rate_low", "rate_high", "share_low", "share_high"),
    _UNITS_SQL + ", r as (select env, hours, count(*) filter (label = 1) as malicious, count(*) filter (label = 1 and score >= 0.9) as hits, count(*) filter (label = 0 and score >= 0.9)::bigint as fp from un group by all), bi as (select r.*, i, "
    "lo_l, hi_l, lo_h, hi_h, bl_l, bh_l, bl_h, bh_h from (with recursive q as (select env, 0 as i, 0.0::double as lo_l, fp + 200.0::double as hi_l, 0.0::double as lo_h, fp + 200.0::double as hi_h, 0.0::double as bl_l, 1.0::double as bh_l, 0.0::double as bl_h, 1.0::double as bh_h, fp, hits, malicious from r "
    "union all select env, i + 1, case when p_l >= 0.975 then ml else lo_l end, case when p_l >= 0.975 then hi_l else ml end, case when p_h >= 0.025 then mh else lo_h end, case when p_h >= 0.025 then hi_h else mh end, case when b_l <= 0.025 then cl else bl_l end, case when b_l <= 0.025 then bh_l else cl end, case when b_h >= 0.025 then ch else bl_h end, case when b_h >= 0.025 then bh_h else ch end, fp, hits, malicious from ("
    "select *, list_sum(list_transform(range(0, fp), lambda j: exp(j * ln(ml) - ml - lgamma(j + 1)))) as p_l, list_sum(list_transform(range(0, fp + 1), lambda j: exp(j * ln(mh) - mh - lgamma(j + 1)))) as p_h, list_sum(list_transform(range(hits, malicious + 1), lambda j: exp(lgamma(malicious + 1) - lgamma(j + 1) - lgamma(malicious - j + 1) + j * ln(cl) + (malicious - j) * ln(1 - cl)))) as b_l, list_sum(list_transform(range(0, hits + 1), lambda j: exp(lgamma(malicious + 1) - lgamma(j + 1) - lgamma(malicious - j + 1) + j * ln(ch) + (malicious - j) * ln(1 - ch)))) as b_h from ("
    "select *, (lo_l + hi_l) / 2 as ml, (lo_h + hi_h) / 2 as mh, (bl_l + bh_l) / 2 as cl, (bl_h + bh_h) / 2 as ch from q where i < 50)) ) select * exclude (fp, hits, malicious) from q where i = 50) z join r using (env)) "
    "select env, malicious, hits, fp as fp_events, case when malicious > 0 then round(hits / malicious::double, 4) end as recall, round(fp / hours, 4) as fp_per_hour, case when fp = 0 then 0.0 else round(hi_l / hours, 4) end as rate_low, round(hi_h / hours, 4) as rate_high, case when malicious = 0 then null when hits = 0 then 0.0 else round(bh_l, 4) end as share_low, case when malicious = 0 then null when hits = malicious then 1.0 else round(bh_h, 4) end as share_high from bi",
)
put("environment_weights", lambda s, d: E.environment_weights(_UNITS(s, d)), _UNITS_SQL + ", b as (select env, label, count(*) as n from un group by all), t as (select sum(n) filter (label = 0) as good, sum(n) filter (label = 1) as bad, count(*) filter (label = 0) as envs from b) select env, label, round(case when label = 0 then good / envs / n else good / greatest(1, bad) end, 6) as weight from b cross join t")
put("missing_rates", lambda s, d: E.missing_rates(tel(s, d).groupBy("host_id").agg(F.collect_set("event_type").alias("families"), F.count("*").cast("double").alias("hours")), ["process_create", "dns_query"]), ", h as (select host_id, count(*)::double as hours, list(distinct event_type) as f from tel group by host_id) select b.family, round(sum(case when list_contains(h.f, b.family) then 0.0::double else h.hours end) / sum(h.hours), 6) as rate from h cross join (values ('process_create'), ('dns_query')) b(family) group by b.family")
put("counted_by_key", lambda s, d: E.by_minute(tel(s, d), ["process_name", "event_type"])[0], "select host_id, process_name, event_type, count(*) as n, min(us) as first_us from tel group by all")
put("hours_by_minute", lambda s, d: E.by_minute(tel(s, d), ["process_name"])[1], ", m as (select distinct host_id, us // 60000000 as m from tel), g as (select host_id, least((m - lag(m) over (partition by host_id order by m)) * 60, 3600) as g from m) select host_id, round((coalesce(sum(g), 0) + 60) / 3600::double, 4) as hours from g group by host_id")
put("technique_groups", lambda s, d: tel(s, d).select(E.technique_group(F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("T10"), (F.col("k") % 7).cast("string"), F.lit(".001")), F.lit("T9"))).otherwise(F.array().cast("array<string>")), F.lit("s"), F.col("process_name")).alias("grp")).groupBy("grp").agg(F.count("*").alias("n")), "select case when k % 2 = 0 then 'T:T10' || (k % 7) else 's:' || process_name end as grp, count(*) as n from tel group by all")
put("group_folds", lambda s, d: E.folds(_UNITS(s, d), "env", "label").groupBy("fold").agg(F.count_distinct("env").alias("groups"), F.count("*").alias("n")), _UNITS_SQL + ", z as (select env, label, count(*) as n from un group by all), y as (select env, arg_max(label, n) as l, sum(n) as n from z group by env), p as (select *, row_number() over (partition by l order by n desc, env) - 1 as p from y), f as (select env, n, (case when (p // 5) % 2 = 0 then p % 5 else 4 - p % 5 end)::int as fold from p) select fold, count(*) as groups, sum(n)::bigint as n from f group by fold")
put("paired_recall", lambda s, d: E.paired(_UNITS(s, d).where("label = 1").select("env", "grp", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("a"), F.when(F.col("k") >= 50, 1).otherwise(0).alias("b"))).select("model", "baseline", "diff"), _UNITS_SQL + ", e as (select env, avg(case when score >= 0.5 then 1.0 else 0 end) as a, avg(case when k >= 50 then 1.0 else 0 end) as b from un where label = 1 group by env) select round(avg(a), 4) as model, round(avg(b), 4) as baseline, round(avg(a) - avg(b), 4) as diff from e")
_STARTS = lambda s, d: tel(s, d).where("event_type = 'process_create'").select(F.concat("host_id", F.lit(":"), F.col("pid").cast("string")).alias("guid"), F.concat("host_id", F.lit(":"), F.col("ppid").cast("string")).alias("parent_guid"), "host_id", F.col("process_name").alias("image"), "us", "event_id").withColumnRenamed("host_id", "host")
_STARTS_ONE = lambda s, d: _STARTS(s, d).groupBy("guid", "parent_guid", "host").agg(F.min(F.struct("us", "event_id", "image"))["image"].alias("image")).withColumn("parent_image", F.lit(None).cast("string"))
_STARTS_SQL = ", st as (select host_id || ':' || pid as guid, host_id || ':' || ppid as parent_guid, host_id as host, arg_min(process_name, (us, event_id)) as image from tel where event_type = 'process_create' group by all), cl as (with recursive c as (select guid as node, parent_guid as ancestor from st where guid <> parent_guid union select c.node, s.parent_guid from c join st s on s.guid = c.ancestor where c.node <> s.parent_guid) select * from c) "
put("scenario_labels", lambda s, d: E.scenario_labels(_STARTS_ONE(s, d), [("h1", None, "cmd.exe", "one"), ("h", None, "net.exe", "two")]).groupBy("label", "label_rule").agg(F.count("*").alias("n")), _STARTS_SQL + ", rt as (select guid from st where (lower(host) like 'h1%' and image = 'cmd.exe') or image = 'net.exe'), lb as (select st.guid, st.guid in (select guid from rt) or exists (select 1 from cl join rt on rt.guid = cl.ancestor where cl.node = st.guid) as bad from st) select case when bad then 1 else 0 end as label, case when bad then 'malicious/documented_scenario' else 'benign/environment' end as label_rule, count(*) as n from lb group by all")
put(
    "recording_labels",
    lambda s, d: E.recording_labels(_STARTS_ONE(s, d), ("svchost.exe", "ipconfig.exe"), ("systeminfo.exe",), ("explorer.exe",), ("nltest",)).groupBy("label", "label_rule").agg(F.count("*").alias("n")),
    _STARTS_SQL + ", fa as (select *, image in ('conhost.exe', 'systeminfo.exe', 'chrome.exe') as outs, contains(image, 'nltest') as infra, image in ('svchost.exe', 'ipconfig.exe') as quiet, image = 'explorer.exe' as inter from st), ab as (select cl.node, bool_or(fa.infra) as infra, bool_and(fa.quiet) as known, bool_or(not fa.outs and not fa.infra and not fa.quiet and not fa.inter) as bad from cl join fa on fa.guid = cl.ancestor group by cl.node), "
    "rl as (select case when image = 'systeminfo.exe' then 'excluded/defensive_tool' when image = 'chrome.exe' then 'excluded/browser' when fa.infra or coalesce(ab.infra, false) then 'benign/infrastructure' when not coalesce(ab.bad, false) and quiet and coalesce(ab.known, true) then 'benign/background' when not coalesce(ab.bad, false) and inter then 'excluded/interactive' else 'malicious/attack_recording' end as label_rule from fa left join ab on ab.node = fa.guid) "
    "select case when label_rule like 'benign%' then 0 when label_rule like 'malicious%' then 1 end as label, label_rule, count(*) as n from rl group by all",
)

# ---- texts

for _kind, _sql in {
    "envvar": "replace(replace(c, 'C:' || chr(92) || 'Windows', '%SystemRoot%'), 'c:' || chr(92) || 'windows', '%SystemRoot%')", "whitespace": "replace(c, ' ', '  ')", "renamed_binary": "replace(c, process_name, 'updater.exe')", "unicode_dash": "regexp_replace(c, '(\\s)-([A-Za-z])', '\\1–\\2', 'g')",
    "flag_prefix": "regexp_replace(c, '(\\s)[-/](e|ec|enc|encodedcommand)(\\s)', '\\1-encodedcomm\\3', 'gi')", "argswap": "case when len(string_split(c, ' ')) > 2 then array_to_string(list_concat(string_split(c, ' ')[:-3], [string_split(c, ' ')[-1], string_split(c, ' ')[-2]]), ' ') else c end",
    "quote_split": "case when w <> '' then substr(c, 1, position(lower(w) in lower(c)) + 1) || '\"\"' || substr(c, position(lower(w) in lower(c)) + 2) else c end",
}.items():
    put(f"mutation_{_kind}", lambda s, d, kind=_kind: tel(s, d).select("event_id", V.mutated(F.col("command_line"), F.col("process_name"), F.col("event_id").cast("string"), kind).alias("command")), ", z as (select event_id, process_name, coalesce(command_line, '') as c, case when length(regexp_replace(process_name, '\\.exe$', '')) >= 4 and contains(lower(coalesce(command_line, '')), regexp_replace(process_name, '\\.exe$', '')) then regexp_replace(process_name, '\\.exe$', '') else regexp_extract(coalesce(command_line, ''), '([A-Za-z]{4,})', 1) end as w from tel) select event_id, " + _sql + " as command from z")
put("mutation_letters", lambda s, d: tel(s, d).select("event_id", F.replace(V.mutated(F.col("command_line"), F.col("process_name"), F.col("event_id").cast("string"), "caret"), F.lit("^")).alias("caret"), F.lower(V.mutated(F.col("command_line"), F.col("process_name"), F.col("event_id").cast("string"), "case")).alias("case_")), "select event_id, replace(coalesce(command_line, ''), '^', '') as caret, lower(coalesce(command_line, '')) as case_ from tel")
put("score_by_hand", lambda s, d: V.by_hand(tel(s, d), F.col("command_line"), F.col("path"), F.col("process_name"), F.when(F.col("k") % 3 == 0, "WINWORD.EXE")).select("event_id", "score"), "select event_id, (case when process_name in ('rundll32.exe', 'nltest.exe') then 1 else 0 end + case when process_name = 'powershell.exe' then 1 else 0 end + case when k % 3 = 0 then 1 else 0 end + case when k % 8 = 0 then 1 else 0 end)::double as score from tel")
put("start_tokens", lambda s, d: tel(s, d).select(F.explode(V.tokens(F.col("command_line"), F.col("path"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("token like 'c:net%' or token like 'p:curl'"), ", t as (select 'c:net' as token, count(*) filter (k % 8 = 3) as n from tel union all select 'c:net user', count(*) filter (k % 8 = 3) from tel union all select 'p:curl', count(*) filter (path = '/usr/bin/curl') from tel) select * from t where n > 0")
put("scrubbed_text", lambda s, d: tel(s, d).select("event_id", C.scrubbed(F.concat(F.lit("C:\\AtomicRedTeam\\atomics\\T1059\\x.ps1 -h win-dc-7 T1003.001 a.theshire.local "), F.col("k").cast("string"))).alias("text")), "select event_id, 'c:' || chr(92) || 'tools' || chr(92) || 'payload -h host item host.example ' || k as text from tel")
put("retry_jitter", lambda s, d: tel(s, d).select("event_id", C.retry_delay(F.col("k") % 10, key=F.col("event_id").cast("string")).between(C.retry_delay(F.col("k") % 10) * 0.9, C.retry_delay(F.col("k") % 10) * 1.1).alias("within")), "select event_id, true as within from tel")


def _context(s: SparkSession, d: str) -> DataFrame:
    from emberline.plans.provenance import records as process_records

    rec = process_records(s, d)
    of = {c: F.col(c) for c in ("ancestor_names", "depth", "behavior_bits", "behavior_bit_objects", "child_count", "image_writer_name", "image_age_seconds")}
    seen = F.when(F.col("pid") % 2 == 0, F.array(*[F.lit(g) for g in V.GROUPS])).otherwise(F.array(F.lit("network")))
    return rec.select("node_id", F.explode(V.context_vector(of, seen)).alias("feature", "value"))


put("context_vector", lambda s, d: _context(s, d).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.isnan("value")).alias("unknown")).where("feature in ('dns:failed_query', 'image_age_log', 'anc1_role=missing')").select("feature", "unknown"), RUNS + "select feature, case when feature = 'anc1_role=missing' then 0 else (select count(*) from runs where pid % 2 = 1) end::bigint as unknown from (values ('dns:failed_query'), ('image_age_log'), ('anc1_role=missing')) t(feature)")

# ---- sources and delivery

_WIRE = lambda s, d: telemetry.canonical(telemetry.wire(telemetry.lines_of(wide(s, d))))
put(
    "wire_canonical",
    lambda s, d: _WIRE(s, d).select("event_id", "event_type", "host_id", "pid", "ppid", "process_name", "command_line", "destination_ip", "query_name", F.unix_micros("ts").alias("us"), "direction"),
    ", x as (select event_id::varchar as event_id, us, host_id, pid, ppid, process_name, command_line, k, case when event_type = 'network_connect' and k % 5 = 0 then 'dns_query' when event_type = 'file_rename' and k % 4 = 0 then 'image_load' when event_type = 'registry_write' and k % 8 = 0 then 'process_terminate' when event_type = 'registry_write' and k % 8 = 1 then 'process_access' when event_type = 'registry_write' and k % 8 = 2 then 'remote_thread' when event_type = 'registry_write' and k % 8 = 3 then 'script_block' else event_type end as et, destination_ip, query_name from tel) "
    "select event_id, case et when 'image_load' then 'process_load' when 'process_access' then 'process_access' when 'remote_thread' then 'process_thread' when 'script_block' then 'process_block' else et end as event_type, host_id, pid, ppid, process_name, command_line, case when et = 'network_connect' then destination_ip end as destination_ip, case when et = 'dns_query' then rtrim(lower(query_name), '.') end as query_name, us, 'outbound' as direction from x",
)


def _flat_lines(s: SparkSession, d: str) -> DataFrame:
    e = tel(s, d)
    return e.select(F.to_json(F.struct(F.to_json(F.map_filter(F.create_map(F.lit("host_name"), F.col("host_id"), F.lit("@timestamp"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("process_id"), F.when(F.col("k") > 2, F.col("pid").cast("string")).otherwise("x"), F.lit("process_path"), F.col("path"), F.lit("user_account"), F.concat(F.lit("D\\"), "process_name"), F.lit("record_number"), F.col("event_id").cast("string"), F.when(F.col("k") % 9 == 0, "rule_x").otherwise("other"), F.lit("1")), lambda _, v: v.isNotNull())).alias("_source"))).alias("value"))


put("flattened_rows", lambda s, d: rows.flattened(_flat_lines(s, d)).groupBy("label", "label_rule", "host", "domain").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("ids"), F.count_distinct("user").alias("users")), "select case when k % 9 <> 0 then 0 end as label, case when k % 9 = 0 then 'excluded/rule_hit' else 'benign/real_environment' end as label_rule, lower(host_id) as host, 'D' as domain, count(*) as n, count(distinct event_id) as ids, count(distinct process_name) as users from tel where k > 2 and path is not null group by all")


def _package(s: SparkSession, d: str) -> DataFrame:
    e = tel(s, d).where("event_type in ('process_create', 'registry_write')")
    data = F.to_json(F.struct(F.struct(F.col("event_id").cast("string").alias("id"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")).alias("event"), F.struct(F.when(F.col("event_type") == "registry_write", "etw").otherwise("sysmon").alias("kind")).alias("source"), F.struct(F.col("host_id").alias("id")).alias("host"), F.struct("pid", F.col("process_name").alias("name"), F.col("path").alias("executable"), F.struct(F.col("ppid").alias("pid")).alias("parent")).alias("process")))
    return e.select(F.lit("observation").alias("kind"), F.lit("process").alias("category"), data.alias("data"), (F.col("k") % 50 == 0).alias("self"), F.lit(None).cast("string").alias("observed_at"), F.col("event_id").cast("string").alias("record_id"))


put(
    "agent_rows",
    lambda s, d: rows.agent_rows(_package(s, d), "x", window=10**11, pair=60_000_000)[1],
    ", st as (select event_id, host_id, pid, ppid, us, process_name as name, case when event_type = 'registry_write' then 'etw' else 'sysmon' end as kind, k % 50 = 0 as own from tel where event_type in ('process_create', 'registry_write')), cl as (select * from st where not own), "
    "ch as (with recursive c as (select cl.event_id, cl.host_id, cl.pid, cl.us from cl join st o on o.own and o.host_id = cl.host_id and o.pid = cl.ppid and cl.us between o.us and o.us + 100000000000 union select cl.event_id, cl.host_id, cl.pid, cl.us from c join cl on cl.host_id = c.host_id and cl.ppid = c.pid and cl.us between c.us and c.us + 100000000000) select distinct event_id from c), "
    "kp as (select * from cl where event_id not in (select event_id from ch)), tw as (select e.event_id, exists (select 1 from kp m where m.kind = 'sysmon' and m.host_id = e.host_id and m.pid = e.pid and m.name = e.name and abs(m.us - e.us) <= 60000000) as paired from kp e where e.kind = 'etw') "
    "select 'self_tagged' as what, (select count(*) from st where own) as n union all select 'self_children', (select count(*) from ch) union all select 'twin', (select count(*) from tw where paired) union all select 'twin_unpaired', (select count(*) from tw where not paired) union all select 'rows', (select count(*) from kp where kind = 'sysmon')",
)


def _ecar_starts(s: SparkSession, d: str) -> DataFrame:
    e = tel(s, d)
    props = F.struct(F.when(F.col("k") % 4 == 0, F.col("process_name")).otherwise(F.concat(F.lit("\\Device\\HarddiskVolume2\\x\\"), "process_name")).alias("image_path"), F.concat(F.lit("D\\"), F.lit("u")).alias("user"))
    return e.select(F.to_json(F.struct(F.when(F.col("event_type") == "process_create", "PROCESS").otherwise("FILE").alias("object"), F.lit("CREATE").alias("action"), F.col("host_id").alias("hostname"), F.when(F.col("k") > 2, F.col("pid")).otherwise(-1).alias("pid"), F.floor(F.col("us") / 1000).alias("timestamp_ms"), F.col("event_id").cast("string").alias("id"), props.alias("properties"))).alias("value"))


put("ecar_starts", lambda s, d: rows.ecar_starts(_ecar_starts(s, d), "x").groupBy("image", "user", "domain").agg(F.count("*").alias("n"), F.max(F.unix_millis("utc")).alias("last_ms")), "select 'C:' || chr(92) || 'x' || chr(92) || process_name as image, 'u' as user, 'D' as domain, count(*) as n, max(us // 1000) as last_ms from tel where event_type = 'process_create' and k % 4 <> 0 and k > 2 group by all")
put("all_rows", lambda s, d: rows.together(rows.flattened(_flat_lines(s, d)), rows.ecar_starts(_ecar_starts(s, d), "x")).groupBy("source").agg(F.count("*").alias("n")), "select 'flattened' as source, count(*) as n from tel where k > 2 and path is not null union all select 'ecar', count(*) from tel where event_type = 'process_create' and k % 4 <> 0 and k > 2")
put("label_table", lambda s, d: files.label_table(tel(s, d).select(F.concat(F.lit("a, "), F.upper("process_name"), F.lit(", x, p-q-"), F.lower(F.hex("pid")), F.lit("-r-"), F.lower(F.hex((F.col("us") + 11_644_473_600_000_000) * 10)), F.lit(", "), F.when(F.col("k") % 2 == 0, "attack").otherwise("benign")).alias("value")), "h1-m2"), "select 'h1' as host_id, lower(process_name) as image, pid, us from tel where k % 2 = 0")
put("merged_runs", lambda s, d: files.merged_runs([tel(s, d).where(f"k % 3 = {i}").select("us", "event_id") for i in range(3)], ["us", "event_id"]).withColumn("one", F.lit(1)).select("us", "event_id"), "select us, event_id from tel where k >= 0 order by us, event_id")


def _spool(s: SparkSession, d: str) -> DataFrame:
    """Alerts that are spooled, then tried three times: what k says fails, and is dead in the end."""
    alerts = tel(s, d).select(F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("alert_id"), F.when(F.col("k") % 10 == 0, "{").otherwise('{"a":1}').alias("payload"), F.lit("r").alias("rule_id"), "k")
    spool = delivery.spooled(alerts.select("alert_id", "payload", "rule_id"), s.createDataFrame([], delivery.SPOOL), F.lit(0))
    fails = alerts.select("alert_id", F.when(F.col("k") % 3 == 0, "no route").alias("error"), "k")
    for i in range(2):
        spool = delivery.attempted(spool, fails.join(spool.where("status = 'pending'").select("alert_id"), "alert_id").where(F.lit(i == 0) | F.col("k").between(0, 60)).select("alert_id", "error"), F.lit(1_000_000 * (i + 1)), most=2)
    return spool


put("spool_round", lambda s, d: delivery.spool_stats(_spool(s, d), F.lit(3_500_000)), "select count(*) filter (k % 10 <> 0 and k % 3 = 0 and k > 60) as pending_ready, 0::bigint as pending_retry, count(*) filter (k % 10 <> 0 and k % 3 <> 0) as delivered, count(*) filter (k % 10 = 0 or (k % 3 = 0 and k <= 60)) as dead, count(*) as total from tel")
put("dead_letters", lambda s, d: delivery.dead_letters(_spool(s, d)).groupBy("last_error", "attempts").agg(F.count("*").alias("n")), "select case when k % 10 = 0 then 'unparseable payload' else 'no route' end as last_error, case when k % 10 = 0 then 0 else 2 end as attempts, count(*) as n from tel where k % 10 = 0 or (k % 3 = 0 and k <= 60) group by all")
put("requeued", lambda s, d: delivery.requeued(_spool(s, d), ["A1", "A2", "A3", "A4"]).where("status = 'pending' and attempts = 0").select("alert_id"), "select 'A' || event_id as alert_id from tel where event_id in (1, 2, 3, 4) and (k % 10 = 0 or (k % 3 = 0 and k <= 60))")
_TIMED = lambda s, d: tel(s, d).select("event_id", "host_id", "event_type", F.timestamp_micros("us").alias("ts"), "us")
put("tumbling_activity", lambda s, d: delivery.activity(_TIMED(s, d), "1 hour").select(F.unix_micros("start").alias("start_us"), "host_id", "event_type", "n"), "select us // 3600000000 * 3600000000 as start_us, host_id, event_type, count(*) as n from tel group by all")
put("host_sessions", lambda s, d: delivery.sessions(_TIMED(s, d), "6 hours").select(F.unix_micros("start").alias("start_us"), "host_id", "n"), ", g as (select host_id, us, case when us - lag(us) over (partition by host_id order by us, event_id) < 21600000000 then 0 else 1 end as new from tel), r as (select *, sum(new) over (partition by host_id order by us rows unbounded preceding) as run from g) select min(us) as start_us, host_id, count(*) as n from r group by host_id, run")
put("admission", lambda s, d: delivery.admitted(_TIMED(s, d), "drop_oldest", 40, F.floor(F.col("us") / 86_400_000_000))[1], "select us // 86400000000 as batch, count(*) - 40 as dropped from tel group by all having count(*) > 40")

# ---- measures that the library makes, in place of inline expressions

put("clock_offset", lambda s, d: records.clock_offset(records.records(tel(s, d).select(F.to_json(F.struct(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSS").alias("UtcTime"), F.date_format(F.timestamp_micros(F.col("us") - (F.col("k") % 5 + 60) * 1_000_000), "yyyy-MM-dd HH:mm:ss.SSS").alias("TimeCreated"))).alias("value")))), "select round_even(median(k % 5 + 60), 0)::double as offset_seconds, count(*) as n from tel")
put("census", lambda s, d: A.census(tel(s, d)), ", g as (select host_id, least((us - lag(us) over (partition by host_id order by us, event_id)) / 1e6, 3600.0) / 3600 as h from tel), hh as (select host_id, round(coalesce(sum(h), 0), 4) as hours from g group by host_id), f as (select distinct host_id, split_part(event_type, '_', 1) as family from tel) select f.family, (select count(*) from tel where split_part(event_type, '_', 1) = f.family) as events, round(sum(hh.hours), 2) as hours from f join hh using (host_id) group by f.family")
put("canonical_projection", lambda s, d: _WIRE(s, d).select("event_id", "host_id", "pid", "ppid", "process_name", F.unix_micros("ts").alias("us")), "select event_id::varchar as event_id, host_id, pid, ppid, process_name, us from tel")
put("access_mask_bits", lambda s, d: fields.derive(tel(s, d), [R.Rule("M", "process_access", {"any": [{"field": f"process_access.{x}", "operator": "equals", "value": True} for x in ("can_read_memory", "can_write_memory", "can_create_thread")]})]).select("event_id", F.col("`process_access.can_read_memory`").alias("can_read"), F.col("`process_access.can_write_memory`").alias("can_write"), F.col("`process_access.can_create_thread`").alias("can_create_thread")), "select event_id, (access_mask::bigint & 16) <> 0 as can_read, (access_mask::bigint & 32) <> 0 as can_write, (access_mask::bigint & 2) <> 0 as can_create_thread from tel")
put("consistent_labels", lambda s, d: A.consistent(tel(s, d).select("process_name", "host_id", F.floor(F.col("us") / 10**11).alias("bucket"), "us", "event_id", (F.col("k") % 2).alias("label")), ["process_name", "host_id", "bucket"], "label", ["us", "event_id"]).select("process_name", "host_id", "bucket", "event_id", "label"), "select process_name, host_id, us // 100000000000 as bucket, arg_min(event_id, (us, event_id)) as event_id, arg_min(k % 2, (us, event_id)) as label from tel group by 1, 2, 3 having min(k % 2) = max(k % 2)")

# ---- a whole rule set over wire events

#: Operator, event type, condition and the SQL of it.
_SET = [
    ("equals", "process_create", {"field": "process.name", "operator": "equals", "value": "WHOAMI.EXE"}, "process_name = 'whoami.exe'"),
    ("not_equals", "process_create", {"field": "process.name", "operator": "not_equals", "value": "whoami.exe"}, "process_name <> 'whoami.exe'"),
    ("contains", "file_create", {"field": "file.path", "operator": "contains", "value": "TEMP"}, "contains(lower(path), 'temp')"),
    ("not_contains", "file_create", {"field": "file.path", "operator": "not_contains", "value": "temp"}, "not contains(lower(path), 'temp')"),
    ("in", "process_create", {"field": "process.name", "operator": "in", "value": ["net.exe", "nltest.exe"]}, "process_name in ('net.exe', 'nltest.exe')"),
    ("not_in", "process_create", {"field": "process.name", "operator": "not_in", "value": ["net.exe", "nltest.exe"]}, "process_name not in ('net.exe', 'nltest.exe')"),
    ("starts_with", "file_create", {"field": "file.path", "operator": "starts_with", "value": "c:/users"}, "lower(path) like 'c:/users%'"),
    ("ends_with", "file_create", {"field": "file.path", "operator": "ends_with", "value": ".pdf"}, "lower(path) like '%.pdf'"),
    ("regex", "process_create", {"field": "process.name", "operator": "regex", "value": r"^(net|nltest)\.exe$"}, "process_name in ('net.exe', 'nltest.exe')"),
    ("greater_than", "network_connect", {"field": "network.destination_port", "operator": "greater_than", "value": 60000}, "destination_port > 60000"),
    ("less_than", "network_connect", {"field": "network.destination_port", "operator": "less_than", "value": 2000}, "destination_port < 2000"),
    ("cidr", "network_connect", {"field": "network.destination_ip", "operator": "cidr", "value": ["fe80::/10", "10.0.0.0/8"]}, "destination_ip like '10.%'"),
    ("windash", "process_create", {"field": "process.command_line", "operator": "windash", "value": "enc"}, "contains(command_line, '-enc ')"),
    ("exists", "process_create", {"field": "process.executable", "operator": "exists", "value": True}, "path is not null"),
    ("intel", "network_connect", {"field": "network.destination_ip", "operator": "in_threat_intel", "value": "ip"}, "destination_ip in ('203.0.113.10', '8.8.8.8')"),
    ("entropy", "process_create", {"field": "process.name", "operator": "entropy_greater_than", "value": 3.0}, ENTROPY.format("process_name") + " >= 3.0"),
    ("decoded", "process_create", {"field": "process.command_line", "operator": "contains", "value": "whoami"}, "k % 8 = 1"),
    ("place", "process_create", {"field": "process.path_class", "operator": "equals", "value": "temp"}, "contains(path, '/Temp/')"),
    ("scope", "network_connect", {"field": "network.destination_scope", "operator": "equals", "value": "private"}, "destination_ip like '10.%'"),
]
WIRE_RULES = [R.Rule(n, t, {"all": [c]}, level=5, evidence=["process.name"]) for n, t, c, _ in _SET]


def wire_rules(s: SparkSession, d: str) -> DataFrame:
    """A rule for each operator, from lines of JSON through the canonical projection and derived fields."""
    events = telemetry.canonical(telemetry.wire(telemetry.lines_of(wide(s, d))))
    return R.scan(fields.derive(events, WIRE_RULES, s.createDataFrame(list(_INTEL), fields.INTEL_SCHEMA)), WIRE_RULES)


put(
    "wire_rules",
    lambda s, d: wire_rules(s, d).groupBy("rule_id").agg(F.count("*").alias("hits"), F.count_distinct("host_id").alias("hosts")),
    ", x as (select * replace (case when event_type = 'network_connect' and k % 5 = 0 then 'dns_query' else event_type end as event_type) from tel) select * from (" + " union all ".join(f"select '{n}' as rule_id, count(*) as hits, count(distinct host_id) as hosts from x where event_type = '{t}' and {w}" for n, t, _, w in _SET) + ") where hits > 0",
)
