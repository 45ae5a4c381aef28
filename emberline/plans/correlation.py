"""More queries over the driver's tables: causal walks, correlation, features, measures and the mapping of recordings, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.functions import features as X
from emberline.operators import aggregates as A
from emberline.operators import causality as G
from emberline.operators import joins as J
from emberline.operators import stateful as S
from emberline.operators import storyline as T
from emberline.plans import rules as R
from emberline.plans.catalogue import HITS, ORACLES, PLAIN, RULES, put, tel
from emberline.sources import records

SPAN = 6 * G.HOUR
MINUTE = 60 * S.SECOND
WINDOW = 600 * MINUTE

# ---- causal walks

_FLOW = (
    ", fl as (select distinct * from (select host_id || ':' || ppid as src, host_id || ':' || pid as dst, us from tel where event_type = 'process_create' and ppid <> pid "
    "union all select host_id || '|' || lower(path), host_id || ':' || pid, us from tel where event_type = 'process_create' and path is not null "
    "union all select host_id || ':' || pid, host_id || '|' || lower(path), us from tel where event_type in ('file_create', 'file_rename') and path is not null)), "
    f"named as (select host_id || ':' || pid as node, arg_max(process_name, us) as name from tel group by all), hub as (select node from named where name in ('svchost.exe', 'explorer.exe')), "
)


def _starts(s: SparkSession, d: str, rule: R.Rule) -> DataFrame:
    hits = R.scan(tel(s, d), [rule])
    return hits.select(F.col("event_id").alias("anchor"), F.concat_ws(":", "host_id", F.col("pid").cast("string")).alias("node"), (F.col("us") - SPAN).alias("lo"), F.col("us").alias("hi"))


def _hubs(s: SparkSession, d: str) -> DataFrame:
    named = tel(s, d).groupBy(F.concat_ws(":", "host_id", F.col("pid").cast("string")).alias("node")).agg(F.max_by("process_name", "us").alias("name"))
    return named.where(F.col("name").isin(*G.BOUNDARY)).select("node")


def _walk(s: SparkSession, d: str, rule: R.Rule, back: bool) -> DataFrame:
    return G.walk(_starts(s, d, rule), G.flows(tel(s, d)), back, stop=_hubs(s, d)).select("anchor", "node", F.col("hi" if back else "lo").alias("reached_us"), F.col("depth").cast("bigint").alias("depth"))


def _walk_sql(rule: str, back: bool) -> str:
    near, far, bounds, end = ("dst", "src", "w.lo, f.us", "max(hi)") if back else ("src", "dst", "f.us, w.hi", "min(lo)")
    return _FLOW + HITS.rstrip() + (
        f", w as (with recursive w(anchor, node, lo, hi, depth) as (select event_id, host_id || ':' || pid, us - {SPAN}, us, 0::bigint from hits where rule_id = '{rule}' "
        f"union select w.anchor, f.{far}, {bounds}, w.depth + 1 from w join fl f on f.{near} = w.node and f.us between w.lo and w.hi where w.depth < 12 and w.node not in (select node from hub)) select * from w) "
        f"select anchor, node, {end} as reached_us, min(depth) as depth from w group by all"
    )


put("backward_walk", lambda s, d: _walk(s, d, RULES[3], True), _walk_sql("T-004", True))
put("forward_closure", lambda s, d: _walk(s, d, RULES[2], False), _walk_sql("T-003", False))
put(
    "duplicate_start_merge",
    lambda s, d: G.merged_starts(tel(s, d).where("event_type = 'process_create'"), ["host_id", "pid"], ["path"], ["path", "command_line"], SPAN),
    ", ix as (select *, row_number() over (partition by host_id, pid order by us, event_id) as i from tel where event_type = 'process_create'), f as (with recursive f as (select host_id, pid, 0::bigint as i, 0::bigint as event_id, []::struct(f bigint, e bigint, p varchar)[] as st, 0::bigint as run from (select distinct host_id, pid from ix) union all "
    "select host_id, pid, i, event_id, case when len(same) = 0 then list_append(near, {'f': us, 'e': event_id, 'p': path}) else list_transform(near, lambda r: case when r.e = same[1].e then {'f': r.f, 'e': r.e, 'p': coalesce(r.p, path)} else r end) end, case when len(same) = 0 then event_id else same[1].e end from ("
    "select *, list_filter(near, lambda r: not (path is not null and r.p is not null and path <> r.p)) as same from ("
    f"select x.host_id, x.pid, x.i, x.event_id, x.us, x.path, list_filter(f.st, lambda r: x.us - r.f <= {SPAN}) as near from f join ix x on x.host_id = f.host_id and x.pid = f.pid and x.i = f.i + 1))) select * from f where i > 0) "
    "select ix.host_id, ix.pid, min(ix.us) as us, f.run as event_id, count(*) as reports, arg_min(ix.path, (ix.us, ix.event_id)) filter (ix.path is not null) as path, arg_min(ix.command_line, (ix.us, ix.event_id)) filter (ix.command_line is not null) as command_line from f join ix on ix.event_id = f.event_id group by ix.host_id, ix.pid, f.run",
)
_TEMPLATES = lambda s, d: tel(s, d).select("event_id", F.explode(F.array(F.concat_ws("|", F.lit("a"), "host_id", "user_id", "process_name"), F.concat_ws("|", F.lit("b"), "host_id", "user_id", "event_type"))).alias("t"))
put(
    "template_components",
    lambda s, d: G.template_groups(_TEMPLATES(s, d), "event_id", "t").select(F.col("item").alias("event_id"), F.col("group").alias("component")),
    ", l as (select event_id as e, 'a|' || host_id || '|' || user_id || '|' || process_name as t from tel union all select event_id, 'b|' || host_id || '|' || user_id || '|' || event_type from tel), r as (with recursive c(e, g) as (select event_id, event_id from tel union select b.e, c.g from c join l a on a.e = c.e join l b on b.t = a.t) select * from c) "
    "select e as event_id, min(g) as component from r group by e",
)
put(
    "rule_has_ancestor",
    lambda s, d: _with_ancestors(s, d).where(R.condition({"field": "process_name", "operator": "has_ancestor", "value": ["Explorer.exe", "winword.exe"]})).select("event_id"),
    ", e as (select distinct pid as node, ppid as parent from tel where pid <> ppid), nm as (select pid, arg_max(process_name, us) as name from tel group by pid), r as (with recursive c(node, ancestor, level) as (select node, parent, 1 from e union all select c.node, e.parent, level + 1 from c join e on c.ancestor = e.node where level < 16) select * from c) "
    "select event_id from tel where pid in (select r.node from r join nm on nm.pid = r.ancestor where nm.name in ('explorer.exe', 'winword.exe'))",
)


def _with_ancestors(s: SparkSession, d: str) -> DataFrame:
    t = tel(s, d)
    links = J.ancestors(t.where("pid <> ppid").select(F.col("pid").alias("node"), F.col("ppid").alias("parent")).distinct())
    named = t.groupBy(F.col("pid").alias("ancestor")).agg(F.max_by("process_name", "us").alias("name"))
    chains = links.join(named, "ancestor").groupBy(F.col("node").alias("pid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]).alias("ancestor_names"))
    return t.join(chains, "pid", "left")


# ---- correlation


def _chains(s: SparkSession, d: str) -> DataFrame:
    hits = R.scan(tel(s, d), RULES)
    ordered = hits.groupBy("host_id", "pid").agg(F.array_sort(F.collect_list(F.struct("us", "rule_id", "tactic"))).alias("l"))
    return ordered.select("host_id", "pid", T.chain_run(F.transform("l", lambda x: x["tactic"])).cast("bigint").alias("run"))


put(
    "kill_chain_run",
    _chains,
    ", " + HITS.rstrip() + ", o as (select host_id, pid, us * 10 + cast(substr(rule_id, 5) as int) as pos, case when rule_id = 'T-002' then 'l' when rule_id = 'T-004' then 'c' else 'd' end as t from hits), "
    "g as (select host_id, pid, min(pos) filter (t = 'd') as d0, min(pos) filter (t = 'l') as l0, max(pos) filter (t = 'l') as l1, max(pos) filter (t = 'c') as c1 from o group by all) "
    "select host_id, pid, case when exists (select 1 from o where o.host_id = g.host_id and o.pid = g.pid and t = 'l' and pos > d0 and pos < c1) then 3 when d0 < l1 or d0 < c1 or l0 < c1 then 2 else 1 end::bigint as run from g",
)


_INDEXED = "ix as (select *, row_number() over (partition by host_id order by us, event_id) as i from ev)"
_FOLD = ", ev as ({ev}), " + _INDEXED + ", f as (with recursive f as (select h.host_id, 0::bigint as i, 0::bigint as event_id, {start} as st, false as fired from (select distinct host_id from ix) h union all select host_id, i, event_id, {after}, fired from (select x.host_id, x.i, x.event_id, x.us, {new} from f join ix x on x.host_id = f.host_id and x.i = f.i + 1) y) select * from f) select event_id, host_id from f where fired"
ORACLES["threshold_reset"] = ORACLES["multi_rule_scan"].split(", hits as")[0] + _FOLD.format(
    ev="select host_id, us, event_id from tel where event_type = 'file_rename'", start="[]::bigint[]", after="case when fired then []::bigint[] else st end",
    new=f"list_append(list_filter(f.st, lambda t: t >= x.us - {WINDOW}), x.us) as st, len(list_append(list_filter(f.st, lambda t: t >= x.us - {WINDOW}), x.us)) >= 3 as fired",
)
_VC = f"list_append(list_filter(f.st, lambda t: t.u >= x.us - {WINDOW}), {{'u': x.us, 'v': x.process_name}})"
ORACLES["value_count_reset"] = ORACLES["multi_rule_scan"].split(", hits as")[0] + _FOLD.format(
    ev="select host_id, us, event_id, process_name from tel where event_type = 'process_create' and process_name is not null", start="[]::struct(u bigint, v varchar)[]", after="case when fired then []::struct(u bigint, v varchar)[] else st end",
    new=f"{_VC} as st, len(list_distinct(list_transform({_VC}, lambda t: t.v))) >= 3 as fired",
)
_LIVE = f"list_filter(f.st, lambda p: x.us - p.a <= {WINDOW})"
_AT = f"list_position(list_transform({_LIVE}, lambda p: p.n = x.step), true)"
ORACLES["sequence_match"] = ORACLES["multi_rule_scan"].split(", hits as")[0] + _FOLD.format(
    ev="select host_id, us, event_id, case event_type when 'process_create' then 0 when 'network_connect' then 1 else 2 end as step from tel where event_type in ('process_create', 'network_connect', 'file_create')",
    start="[]::struct(a bigint, n integer)[]", after="st",
    new=f"case when x.step = 0 then list_append({_LIVE}, {{'a': x.us, 'n': 1}})[-16:] when coalesce({_AT}, 0) = 0 then {_LIVE} when x.step = 2 then list_concat({_LIVE}[1:{_AT} - 1], {_LIVE}[{_AT} + 1:]) "
    f"else list_concat(list_append({_LIVE}[1:{_AT} - 1], {{'a': {_LIVE}[{_AT}].a, 'n': 2}}), {_LIVE}[{_AT} + 1:]) end as st, x.step = 2 and coalesce({_AT}, 0) > 0 as fired",
)

_HALF = 3_600 * S.SECOND
ORACLES["risk_meter"] = ORACLES["multi_rule_scan"].split("select event_id, rule_id, cast(level")[0].rstrip() + (
    ", ev as (select host_id, us, event_id, max(level) as level, arg_max(rule_id, level) as rule_id from hits group by all), " + _INDEXED + ", f as (with recursive f as ("
    "select h.host_id, 0::bigint as i, 0::bigint as event_id, 0::bigint as score, null::bigint as seen, []::struct(r varchar, u bigint)[] as rules, false as latched, false as fired from (select distinct host_id from ix) h union all "
    "select host_id, i, event_id, score, us, case when recent then rules else list_append(list_filter(rules, lambda x: x.r <> rule_id), {'r': rule_id, 'u': us}) end, case when recent then latched else (latched and score >= 37.5) or score >= 75 end, not recent and score >= 75 and not latched from ("
    "select host_id, i, event_id, us, rule_id, rules, latched, recent, case when recent then decayed else least(100, decayed + case level when 8 then 15 when 10 then 30 when 12 then 45 else 55 end) end::bigint as score from ("
    f"select x.host_id, x.i, x.event_id, x.us, x.rule_id, x.level, f.rules, f.latched, len(list_filter(f.rules, lambda r: r.r = x.rule_id and r.u >= x.us - {_HALF})) > 0 as recent, case when x.us > f.seen then floor(f.score * 0.5::double ** ((x.us - f.seen) / {_HALF}::double)) else f.score end as decayed "
    "from f join ix x on x.host_id = f.host_id and x.i = f.i + 1) a) b) select * from f) select event_id, host_id, score from f where fired"
)

# ---- scalar functions and features

_ENT = "(-list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::double * log2(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::double))))"
put("decoded_commands", lambda s, d: tel(s, d).select("event_id", C.deobfuscated(F.col("command_line")).alias("text"), F.array_join(C.evasion_techniques(F.col("command_line")), ",").alias("techniques")), f"select event_id, {PLAIN} || case when k % 8 = 0 then ' [DECODED: IEX abc]' else '' end as text, case k % 8 when 0 then 'encoding' when 1 then 'caret' when 4 then 'concatenation' else '' end as techniques from tel")
put(
    "high_entropy_commands",
    lambda s, d: tel(s, d).select("event_id", C.high_entropy(F.col("command_line")).alias("high")),
    ", c as (select distinct command_line as cl from tel where command_line <> ''), w as (select cl, unnest(string_split_regex(cl, '\\s+')) as w from c union select cl, cl from c), "
    f"e as (select cl, w, round({_ENT.format('w')}, 3) as bits from w where w = cl or length(w) >= 12) select event_id, exists (select 1 from e where e.cl = tel.command_line and ((w = cl and bits >= 4.6) or (length(w) >= 12 and bits >= 4.3 and (w <> cl or not regexp_matches(cl, '\\s'))))) as high from tel",
)
put(
    "dns_answers",
    lambda s, d: tel(s, d).select("event_id", F.array_join(C.dns_answers(F.concat(F.lit("type:  5 a.b;::ffff:10.0.0."), F.col("k").cast("string"), F.lit("; 8.8.8."), F.col("k").cast("string"), F.lit(";"))), ",").alias("answers")),
    "select event_id, '10.0.0.' || k || ',8.8.8.' || k as answers from tel",
)
put(
    "accounts_and_ticks",
    lambda s, d: tel(s, d).select("event_id", C.account(F.concat("host_id", F.lit("\\"), "process_name"))[0].alias("name"), C.account(F.concat("host_id", F.lit("\\"), "process_name"))[1].alias("domain"), C.filetime((F.col("us") + 11_644_473_600_000_000) * 10).alias("us"), C.user_category(F.when(F.col("k") % 3 == 0, "SYSTEM").when(F.col("k") % 3 == 1, "PC01$").otherwise("bob"), F.lit(None).cast("string")).alias("category"), C.retry_delay(F.col("k") % 12 + 1).alias("delay")),
    "select event_id, process_name as name, host_id as domain, us, case when k % 3 < 2 then 'system' else 'user' end as category, least(2.0::double ** (k % 12), 300.0) as delay from tel",
)


def _features(s: SparkSession, d: str) -> DataFrame:
    starts = tel(s, d).where("event_type = 'process_create'")
    rows = X.with_features(starts, F.col("command_line"), F.col("path"), F.col("process_name"), F.when(F.col("k") % 3 > 0, F.lit("EXPLORER.EXE")))
    # outer: no map is empty, and a filter on it would be pushed down and work everything out once more
    return rows.select("event_id", F.explode_outer("features").alias("feature", "value"))


put("process_features", lambda s, d: _features(s, d).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
_ROLE = "case when process_name in ('whoami.exe', 'net.exe', 'ipconfig.exe', 'nltest.exe', 'systeminfo.exe') then 'discovery' when process_name in ('powershell.exe', 'cmd.exe') then 'shell' when process_name = 'winword.exe' then 'office' when process_name = 'chrome.exe' then 'browser' when process_name = 'rundll32.exe' then 'lolbin' when process_name = 'svchost.exe' then 'service_host' else 'session' end"
put(
    "feature_roles",
    lambda s, d: _features(s, d).where("feature like 'pair=%' or feature in ('cmd_missing', 'parent_missing', 'ind_discovery_command', 'ind_command_chaining', 'cmd_evasion_count', 'name_equals_parent')").groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")),
    f", p as (select *, {_ROLE} as role, k % 3 > 0 as parented from tel where event_type = 'process_create') select 'pair=' || case when parented then 'session' else 'missing' end || '>' || role as feature, count(*) as n, count(*)::double as total from p group by all "
    "union all select 'cmd_missing', count(*), count(*) from p where command_line is null having count(*) > 0 union all select 'parent_missing', count(*), count(*) from p where not parented having count(*) > 0 "
    "union all select 'ind_discovery_command', count(*), count(*) from p where regexp_matches(replace(command_line, '^', ''), '\\bwhoami\\b|\\bnet (user|group|localgroup|view|share|session|accounts)\\b') having count(*) > 0 "
    "union all select 'cmd_evasion_count', count(*), count(*) from p where k % 8 in (0, 1, 4) having count(*) > 0 union all select 'name_equals_parent', count(*), count(*) from p where parented and process_name = 'explorer.exe' having count(*) > 0",
)

# ---- measures

_SCORED = lambda s, d: tel(s, d).select("host_id", (F.floor(F.col("value")) % 100 / 100).alias("score"), F.when(F.col("k") + F.col("value") > 120, 1).otherwise(0).alias("label"), "value", "us", "event_id")
_SCORED_SQL = ", sc as (select host_id, cast(floor(value) as bigint) % 100 / 100::double as score, case when k + value > 120 then 1 else 0 end as label, value, us, event_id from tel) "
put("pr_auc", lambda s, d: A.pr_auc(_SCORED(s, d)), _SCORED_SQL + ", g as (select score, sum(label) as p, count(*) as n from sc group by score), c as (select *, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as a from g) select sum(p)::bigint as positives, round(sum(p::double * tp / a) / sum(p), 6) as average_precision from c")
put("calibration_error", lambda s, d: A.calibration_error(_SCORED(s, d)), _SCORED_SQL + ", g as (select least(floor(score * 10), 9) as b, count(*) as n, avg(score) as s, avg(label) as y from sc group by all) select sum(n)::bigint as n, round(sum(n * abs(s - y)) / sum(n), 6) as ece from g")
put("recall_precision", lambda s, d: A.at_threshold(_SCORED(s, d), 0.5), _SCORED_SQL + "select round(count(*) filter (score >= 0.5 and label = 1) / (count(*) filter (label = 1))::double, 6) as recall, round(count(*) filter (score >= 0.5 and label = 1) / (count(*) filter (score >= 0.5))::double, 6) as precision from sc")
put("unit_build", lambda s, d: A.units(_SCORED(s, d), ["host_id", "label"], "us", "event_id"), _SCORED_SQL + "select host_id, label, min(us) as us, arg_min(event_id, us) as event_id, count(*) as n from sc group by all")
put("latency_summary", lambda s, d: A.latency(_SCORED(s, d), ["host_id"], "value").select("host_id", "n", *[F.round(c, 4).alias(c) for c in ("total", "least", "most", "p50", "p95")]), _SCORED_SQL + "select host_id, count(*) as n, round(sum(value), 4) as total, round(min(value), 4) as least, round(max(value), 4) as most, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95 from sc group by host_id")
put("bootstrap_interval", lambda s, d: A.bootstrap(_SCORED(s, d), "host_id", "value", 200))

# ---- recordings


def _sysmon_lines(s: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("event_type") == "process_create", 1).when(F.col("event_type") == "network_connect", 3).when(F.col("event_type") == "file_create", 11).when(F.col("event_type") == "registry_write", 13).otherwise(9)
    image = F.concat(F.lit("C:\\Windows\\System32\\"), "process_name")
    fields = F.struct(F.lit(records.SYSMON).alias("Channel"), number.alias("EventID"), F.col("event_id").alias("RecordNumber"), F.col("host_id").alias("Hostname"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSS").alias("UtcTime"), F.when(F.col("k") > 2, F.col("pid").cast("string")).otherwise("-").alias("ProcessId"), image.alias("Image"), F.col("command_line").alias("CommandLine"), F.col("destination_ip").alias("DestinationIp"), F.lit("DWORD (0x1)").alias("Details"))
    return tel(s, d).select(F.to_json(fields).alias("value"))


put(
    "sysmon_mapping",
    lambda s, d: records.sysmon(records.records(_sysmon_lines(s, d)), "x").groupBy("event_type", "reason", "process_name", "value_type").agg(F.count("*").alias("n"), F.count_distinct("host_id").alias("hosts"), F.count("destination_ip").alias("addresses")),
    ", m as (select *, case event_type when 'file_rename' then null else event_type end as kind from tel) select kind as event_type, case when kind is null then 'not mapped: Microsoft-Windows-Sysmon/Operational 9' when k <= 2 then 'no process id' end as reason, process_name, case when kind = 'registry_write' then 'REG_DWORD' end as value_type, count(*) as n, count(distinct host_id) as hosts, count(destination_ip) as addresses from m group by all",
)


def _ecar_lines(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    thing = F.when(kind == "process_create", "PROCESS").when(kind == "network_connect", "FLOW").when(kind == "registry_write", "REGISTRY").otherwise("FILE")
    action = F.when(kind == "network_connect", "START").when(kind == "registry_write", "EDIT").when(kind == "file_rename", "RENAME").otherwise("CREATE")
    props = F.struct(F.concat(F.lit("\\Device\\HarddiskVolume1\\x\\"), "process_name").alias("image_path"), F.when(F.col("k") % 2 == 0, "outbound").otherwise("inbound").alias("direction"), F.col("path").alias("file_path"), F.lit("HKLM\\x").alias("key"), F.lit("6").alias("l4protocol"))
    return tel(s, d).select(F.to_json(F.struct(thing.alias("object"), action.alias("action"), F.col("host_id").alias("hostname"), F.when(F.col("k") > 2, F.col("pid")).otherwise(-1).alias("pid"), F.floor(F.col("us") / 1000).alias("timestamp"), F.col("event_id").cast("string").alias("id"), props.alias("properties"))).alias("value"))


put(
    "ecar_mapping",
    lambda s, d: records.ecar(_ecar_lines(s, d), "x").groupBy("event_type", "reason", "executable").agg(F.count("*").alias("n"), F.count("protocol").alias("flows"), F.max(F.unix_millis("ts")).alias("last_ms")),
    "select event_type, case when k <= 2 then 'no process id' when event_type = 'network_connect' and k % 2 = 1 then 'not outbound' when event_type in ('file_create', 'file_rename') and path is null then 'no path' end as reason, 'C:\\x\\' || process_name as executable, count(*) as n, count(*) as flows, max(us // 1000) as last_ms from tel group by all",
)
