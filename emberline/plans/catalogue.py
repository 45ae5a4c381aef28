"""All queries of the engine over the driver's tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators import aggregates as A
from emberline.operators import incidents as I
from emberline.operators import joins as J
from emberline.operators import stateful as S
from emberline.plans import rules as R
from emberline.sources import telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
tel = telemetry.derived


def put(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = telemetry.ORACLE + oracle


# ---- conditions

PLAIN = "case when position('''+''' in replace(replace(trim(command_line), '^', ''), '`', '')) > 0 then regexp_replace(replace(replace(trim(command_line), '^', ''), '`', ''), '[''\"]\\s*\\+\\s*[''\"]', '', 'g') else replace(replace(trim(command_line), '^', ''), '`', '') end"
ENTROPY = "(select -sum(p * log2(p)) from (select count(*) / sum(count(*)) over () as p from (select unnest(string_split({0}, '')) as c) group by c))"
IP = "case when regexp_matches({0}, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') then cast(split_part({0}, '.', 1) as bigint) * 16777216 + cast(split_part({0}, '.', 2) as bigint) * 65536 + cast(split_part({0}, '.', 3) as bigint) * 256 + cast(split_part({0}, '.', 4) as bigint) end"

CONDITIONS = {
    "equals": ({"field": "process_name", "operator": "equals", "value": "WHOAMI.exe"}, "process_name = 'whoami.exe'"),
    "equals_number": ({"field": "k", "operator": "equals", "value": 7}, "k = 7"),
    "not_equals": ({"field": "path", "operator": "not_equals", "value": "/usr/bin/curl"}, "path <> '/usr/bin/curl'"),
    "contains": ({"field": "path", "operator": "contains", "value": "TEMP"}, "lower(path) like '%temp%'"),
    "not_contains": ({"field": "path", "operator": "not_contains", "value": "temp"}, "lower(path) not like '%temp%'"),
    "in": ({"field": "process_name", "operator": "in", "value": ["net.exe", "cmd.exe"]}, "process_name in ('net.exe', 'cmd.exe')"),
    "not_in": ({"field": "destination_ip", "operator": "not_in", "value": ["8.8.8.8"]}, "destination_ip <> '8.8.8.8'"),
    "starts_with": ({"field": "path", "operator": "starts_with", "value": "c:/users"}, "lower(path) like 'c:/users%'"),
    "ends_with": ({"field": "path", "operator": "ends_with", "value": ".exe"}, "lower(path) like '%.exe'"),
    "regex": ({"field": "process_name", "operator": "regex", "value": r"^(net|nltest)\.exe$"}, "process_name in ('net.exe', 'nltest.exe')"),
    "greater_than": ({"field": "value", "operator": "greater_than", "value": 100}, "value > 100"),
    "less_than": ({"field": "destination_port", "operator": "less_than", "value": 1024}, "destination_port < 1024"),
    "cidr": ({"field": "destination_ip", "operator": "cidr", "value": ["10.0.0.0/8", "127.0.0.0/8"]}, "regexp_matches(destination_ip, '^(10|127)\\.')"),
    "windash": ({"field": "command_line", "operator": "windash", "value": "-domain"}, "regexp_matches(command_line, '(^|\\s)[-/]domain(\\s|$|:|=)')"),
    "exists": ({"field": "command_line", "operator": "exists", "value": True}, "command_line is not null and command_line <> ''"),
    "not_exists": ({"field": "command_line", "operator": "exists", "value": False}, "command_line is null or command_line = ''"),
    "entropy": ({"field": "process_name", "operator": "entropy_greater_than", "value": 3.0}, ENTROPY.format("process_name") + " >= 3.0"),
    "deobfuscated": ({"field": "command_line", "operator": "contains", "value": "whoami"}, f"position('whoami' in lower(command_line)) > 0 or position('whoami' in lower({PLAIN})) > 0"),
    "tree": ({"all": [{"field": "process_name", "operator": "ends_with", "value": ".exe"}], "any": [{"field": "k", "operator": "less_than", "value": 20}, {"field": "value", "operator": "greater_than", "value": 50}], "none": [{"field": "path", "operator": "contains", "value": "temp"}, {"field": "destination_ip", "operator": "equals", "value": "8.8.8.8"}]}, "process_name like '%.exe' and (k < 20 or value > 50) and not coalesce(lower(path) like '%temp%', false) and not coalesce(destination_ip = '8.8.8.8', false)"),
}
for _name, (_logic, _where) in CONDITIONS.items():
    put(f"rule_{_name}", lambda s, d, logic=_logic: tel(s, d).where(R.condition(logic)).select("event_id", "host_id"), f"select event_id, host_id from tel where {_where}")

RULES = [
    R.Rule("T-001", "process_create", {"any": [{"field": "process_name", "operator": "in", "value": ["whoami.exe", "net.exe"]}, {"field": "k", "operator": "greater_than", "value": 90}]}, level=10, tactic="Discovery", technique="T1087"),
    R.Rule("T-002", "network_connect", {"all": [{"field": "destination_ip", "operator": "cidr", "value": "10.0.0.0/8"}]}, level=8, tactic="Lateral Movement", technique="T1021"),
    R.Rule("T-003", "file_create", {"all": [{"field": "path", "operator": "contains", "value": "temp"}], "none": [{"field": "value", "operator": "less_than", "value": 10}]}, level=12, tactic="Discovery", technique="T1083"),
    R.Rule("T-004", "network_connect", {"any": [{"field": "destination_port", "operator": "less_than", "value": 1024}, {"field": "value", "operator": "greater_than", "value": 100}]}, level=14, tactic="Command and Control", technique="T1071"),
]
HITS = (
    "hits as (select *, 'T-001' as rule_id, 10 as level from tel where event_type = 'process_create' and (process_name in ('whoami.exe', 'net.exe') or k > 90) union all "
    "select *, 'T-002', 8 from tel where event_type = 'network_connect' and destination_ip like '10.%' union all "
    "select *, 'T-003', 12 from tel where event_type = 'file_create' and lower(path) like '%temp%' and not coalesce(value < 10, false) union all "
    "select *, 'T-004', 14 from tel where event_type = 'network_connect' and (destination_port < 1024 or value > 100)) "
)
put("multi_rule_scan", lambda s, d: R.scan(tel(s, d), RULES).select("event_id", "rule_id", F.col("level").cast("bigint").alias("level")), ", " + HITS + "select event_id, rule_id, cast(level as bigint) as level from hits")
put(
    "rule_trace",
    lambda s, d: R.scan(tel(s, d), RULES[:1]).select("event_id", "matched"),
    "select event_id, case when process_name in ('whoami.exe', 'net.exe') then 'process_name in [''whoami.exe'', ''net.exe'']' else 'k greater_than 90' end as matched from tel where event_type = 'process_create' and (process_name in ('whoami.exe', 'net.exe') or k > 90)",
)
put("coverage_by_tactic", lambda s, d: R.coverage(s, RULES), "select * from (values ('Discovery', 2::bigint, 2::bigint), ('Lateral Movement', 1, 1), ('Command and Control', 1, 1)) t(tactic, rules, techniques)")

# ---- scalar functions

put("path_class", lambda s, d: tel(s, d).select("event_id", C.path_class(F.col("path")).alias("path_class")), "select event_id, case path when 'C:/Users/a/AppData/Local/Temp/x.exe' then 'temp' when 'C:/Users/a/Downloads/report.PDF' then 'user_writable' when 'C:/Program Files/App/app.exe' then 'program_files' when '/usr/bin/curl' then 'system' when 'D:/tools/x.tar.gz' then 'other' when 'powershell.exe' then 'unknown' end as path_class from tel")
put("file_extension", lambda s, d: tel(s, d).select("event_id", C.file_extension(F.col("path")).alias("extension")), "select event_id, nullif(lower(regexp_extract(coalesce(regexp_extract(path, '[^/]+$'), ''), '^.+(\\.[^.]+)$', 1)), '') as extension from tel")
put("destination_scope", lambda s, d: tel(s, d).select("event_id", C.destination_scope(F.col("destination_ip")).alias("scope")), "select event_id, case when destination_ip is null then null when destination_ip like '10.%' then 'private' when destination_ip like '127.%' then 'loopback' when destination_ip like '169.254.%' then 'link_local' when destination_ip like '224.%' then 'multicast' when destination_ip = 'not-an-ip' then 'unknown' else 'public' end as scope from tel")
put("entropy", lambda s, d: tel(s, d).select("event_id", F.round(C.entropy(F.col("process_name")), 6).alias("bits")), f"select event_id, round({ENTROPY.format('process_name')}, 6) as bits from tel")
put("generated_domains", lambda s, d: tel(s, d).select("event_id", C.is_generated_domain(F.col("query_name")).alias("is_dga"), C.is_tunnel(F.col("query_name")).alias("is_tunnel")), "select event_id, coalesce(query_name = 'xkjqw1987znvcb.biz', false) as is_dga, coalesce(query_name like '%attacker-c2.com', false) as is_tunnel from tel")
put("deobfuscation", lambda s, d: tel(s, d).select("event_id", C.plain_command(F.col("command_line")).alias("plain"), C.encoded_part(F.col("command_line")).alias("encoded")), f"select event_id, {PLAIN} as plain, nullif(regexp_extract({PLAIN}, '(?i)(?:-e|-enc|-encodedcommand|-encodedc)\\s+([A-Za-z0-9+/=]{{10,}})', 1), '') as encoded from tel")
put("normalized_text", lambda s, d: tel(s, d).select("event_id", C.normalized_text(F.col("command_line")).alias("text")), "select event_id, case k % 8 when 0 then 'powershell.exe -enc sqbfafgaiabhagiaywa=' when 1 then 'cmd.exe \\c whoami' when 3 then 'net user \\domain' when 4 then 'powershell ''down''+''load''' when 5 then 'c:\\users\\<user>\\appdata\\local\\temp\\<rand>.tmp <n>' when 6 then 'rundll32.exe win_system_dir\\x.dll,start' else '' end as text from tel")
put("template_collapse", lambda s, d: tel(s, d).select(C.template(F.col("command_line")).alias("template")).where("template is not null").groupBy("template").agg(F.count("*").alias("n")), "select regexp_replace(command_line, '\\S*\\d\\S*', '<d>', 'g') as template, count(*) as n from tel where command_line is not null group by 1")
put("risk_points", lambda s, d: tel(s, d).select("event_id", F.round(C.risk_points(F.col("k") % 17, F.lit(None).cast("double")), 6).alias("points"), F.round(C.platt(F.col("value") / 100, 1.5, -2.0), 6).alias("p")), "select event_id, round((k % 17) / 16.0 * 100 * 0.7, 6) as points, round(1 / (1 + exp(-(value / 100 * 1.5 - 2.0))), 6) as p from tel")

# ---- joins and graph

put(
    "identity_as_of",
    lambda s, d: J.as_of(tel(s, d).where("event_type <> 'process_create'").select("event_id", "host_id", "pid", "us"), J.incarnations(tel(s, d)), ["host_id", "pid"], "us", "start_us", ["process_name"], J.DAY).select("event_id", F.col("match_start_us").alias("start_us"), F.col("match_process_name").alias("image")),
    f"select e.event_id, case when e.us - i.us <= {J.DAY} then i.us end as start_us, case when e.us - i.us <= {J.DAY} then i.process_name end as image from (select * from tel where event_type <> 'process_create') e asof left join (select * from tel where event_type = 'process_create') i on e.host_id = i.host_id and e.pid = i.pid and e.us >= i.us",
)
put("identity_intervals", lambda s, d: J.incarnations(tel(s, d)).select("event_id", "host_id", "pid", "start_us", "end_us"), "select event_id, host_id, pid, us as start_us, lead(us) over (partition by host_id, pid order by us, event_id) as end_us from tel where event_type = 'process_create'")
put(
    "parent_as_of",
    lambda s, d: J.as_of(J.incarnations(tel(s, d)).select("event_id", "host_id", F.col("ppid").alias("pid"), F.col("start_us").alias("us")), J.incarnations(tel(s, d)).withColumn("host_id", F.col("host_id")), ["host_id", "pid"], "us", "start_us", ["process_name"]).select("event_id", F.col("match_process_name").alias("parent_image")),
    "select e.event_id, i.process_name as parent_image from (select * from tel where event_type = 'process_create') e asof left join (select * from tel where event_type = 'process_create') i on e.host_id = i.host_id and e.ppid = i.pid and e.us >= i.us",
)
put(
    "ancestor_closure",
    lambda s, d: J.ancestors(tel(s, d).where("user_id <> ppid").select(F.col("pid").alias("node"), F.col("ppid").alias("parent")).distinct()).withColumn("level", F.col("level").cast("bigint")),
    ", e as (select distinct pid as node, ppid as parent from tel where pid <> ppid), r as (with recursive c(node, ancestor, level) as (select node, parent, 1::bigint from e union all select c.node, e.parent, level + 1 from c join e on c.ancestor = e.node where level < 16) select * from c) select node, ancestor, level from r",
)
put(
    "tree_root",
    lambda s, d: J.ancestors(tel(s, d).where("user_id <> ppid").select(F.col("pid").alias("node"), F.col("ppid").alias("parent")).distinct()).groupBy("node").agg(F.max_by("ancestor", "level").alias("root")),
    ", e as (select distinct pid as node, ppid as parent from tel where pid <> ppid), r as (with recursive c(node, ancestor, level) as (select node, parent, 1::bigint from e union all select c.node, e.parent, level + 1 from c join e on c.ancestor = e.node where level < 16) select * from c) select node, max_by(ancestor, level) as root from r group by node",
)
put(
    "image_writer",
    lambda s, d: J.as_of(tel(s, d).where("event_type = 'process_create' and path is not null").select("event_id", "host_id", F.lower("path").alias("file"), "us"), tel(s, d).where("event_type in ('file_create', 'file_rename') and path is not null").groupBy("host_id", F.lower("path").alias("file"), "us").agg(F.min("event_id").alias("writer")), ["host_id", "file"], "us", "us", ["writer"]).select("event_id", F.col("match_writer").alias("writer"), F.round((F.col("us") - F.col("match_us")) / 1e6, 3).alias("age")),
    ", w as (select host_id, lower(path) as file, us, min(event_id) as writer from tel where event_type in ('file_create', 'file_rename') and path is not null group by all) select e.event_id, w.writer, round((e.us - w.us) / 1e6, 3) as age from (select event_id, host_id, lower(path) as file, us from tel where event_type = 'process_create' and path is not null) e asof left join w on e.host_id = w.host_id and e.file = w.file and e.us >= w.us",
)
put(
    "band_join",
    lambda s, d: J.band(tel(s, d).where("event_type = 'process_create'").select("host_id", F.col("event_id").alias("a"), F.col("us").alias("a_us")), tel(s, d).where("event_type = 'network_connect'").select("host_id", F.col("event_id").alias("b"), F.col("us").alias("b_us")), ["host_id"], "a_us", "b_us", 60_000_000).select("a", "b"),
    "select a.event_id as a, b.event_id as b from tel a join tel b on a.host_id = b.host_id and abs(a.us - b.us) <= 60000000 where a.event_type = 'process_create' and b.event_type = 'network_connect'",
)
_KIND = "case event_type when 'network_connect' then 'connected_to' when 'file_create' then 'wrote' when 'file_rename' then 'renamed' when 'registry_write' then 'set_value' else 'executed' end"
_EDGES = f", e as (select {_KIND} as kind, host_id || ':' || pid as src, lower(case when event_type = 'network_connect' then destination_ip else path end) as dst, us, host_id, event_id from tel), ok as (select * from e where dst is not null) "
put("graph_edges", lambda s, d: J.edges(tel(s, d)).select("edge_id", "kind", "src", "dst"), _EDGES + "select 'e_' || substr(sha256(concat_ws('|', kind, src, dst, us, event_id)), 1, 32) as edge_id, kind, src, dst from ok")
put("graph_nodes", lambda s, d: J.nodes(J.edges(tel(s, d))), _EDGES + "select label, min(us) as first_us, count(*) as degree from (select src as label, us from ok union all select dst, us from ok) group by label")

# ---- aggregations

put(
    "behaviour_counts",
    lambda s, d: A.behaviour(tel(s, d)).withColumn("paths", F.col("paths").cast("bigint")),
    "select host_id, pid, count(*) filter (event_type = 'process_create') as children, count(*) filter (event_type = 'network_connect') as connections, count(*) filter (event_type = 'file_create') as file_writes, count(*) filter (event_type = 'file_rename') as renames, count(*) filter (event_type = 'registry_write') as registry_writes, count(distinct query_name) as domains, least(count(distinct path), 10)::bigint as paths from tel group by host_id, pid",
)
_RARITY = ", st as (select process_name, ppid from tel where event_type = 'process_create'), base as (select 'name' as dimension, process_name as value, count(*) as n from st group by all union all select 'parent_child', ppid || '>' || process_name, count(*) from st group by all) "
put("rarity_baseline", lambda s, d: A.rarity(tel(s, d)), _RARITY + "select * from base")
put(
    "rarity_category",
    lambda s, d: A.rated(tel(s, d).where("event_type = 'network_connect'").select(F.lit("parent_child").alias("dimension"), F.concat_ws(">", F.col("ppid").cast("string"), "process_name").alias("value"), "event_id"), A.rarity(tel(s, d))).select("event_id", "n", "category"),
    _RARITY + "select event_id, coalesce(n, 0) as n, case when (select sum(n) from base where dimension = 'name') < 200 then 'not_ready' when n is null then 'unseen' when n <= 2 then 'uncommon' else 'common' end as category from (select event_id, ppid || '>' || process_name as value from tel where event_type = 'network_connect') e left join (select * from base where dimension = 'parent_child') b using (value)",
)
put("observed_seconds", lambda s, d: A.observed_seconds(tel(s, d)), "select host_id, round(sum(g), 3) as seconds from (select host_id, least((us - lag(us) over (partition by host_id order by us, event_id)) / 1e6, 3600.0) as g from tel) group by host_id")
put("group_cap", lambda s, d: A.capped(tel(s, d), ["host_id", "event_type"], ["us", "event_id"], 3).select("event_id", F.col("place").cast("bigint").alias("place")), "select event_id, place from (select event_id, row_number() over (partition by host_id, event_type order by us, event_id) as place from tel) where place <= 3")
_SCORED = lambda s, d: tel(s, d).select(F.floor(F.col("value")).alias("score"), F.when(F.col("k") + F.col("value") > 120, 1).otherwise(0).alias("label"))
_SCORED_SQL = ", sc as (select cast(floor(value) as bigint) as score, case when k + value > 120 then 1 else 0 end as label from tel) "
put("roc_auc", lambda s, d: A.roc_auc(_SCORED(s, d)), _SCORED_SQL + ", g as (select score, sum(label) as p, count(*) - sum(label) as q from sc group by score), c as (select *, coalesce(sum(q) over (order by score rows between unbounded preceding and 1 preceding), 0) as under from g) select cast(sum(p) as bigint) as positives, cast(sum(q) as bigint) as negatives, round(sum(p * (under + q / 2)) / (sum(p) * sum(q)), 6) as auc from c")
put("threshold_for_budget", lambda s, d: A.threshold_for_budget(_SCORED(s, d), 50), _SCORED_SQL + ", g as (select score, count(*) filter (label = 0) as fp from sc group by score), c as (select *, sum(fp) over (order by score desc) as total from g) select min(score) as threshold, cast(max(total) as bigint) as false_positives from c where total <= 50")
put("token_sequences", lambda s, d: A.tokens(tel(s, d)), ", n as (select *, lag(event_type) over (partition by host_id, pid order by us, event_id) as before from tel), f as (select *, row_number() over (partition by host_id, pid order by us, event_id) as place from n where before is null or before <> event_type) select host_id, pid, string_agg(event_type, ',' order by place) as tokens from f where place <= 100 group by all")
put("first_behaviours", lambda s, d: A.first_bits(tel(s, d)).select("host_id", "pid", "event_type", "first_us"), "select host_id, pid, event_type, min(us) as first_us from tel group by all")
put(
    "allowlist",
    lambda s, d: tel(s, d).where("user_id % 2 = 0").select("process_name", "path", "event_type").distinct().join(tel(s, d).where("user_id % 2 = 1").select("process_name", "path", "event_type").distinct(), ["process_name", "path", "event_type"], "left_anti"),
    "select process_name, path, event_type from (select distinct process_name, path, event_type from tel where user_id % 2 = 0) a where not exists (select 1 from tel b where b.user_id % 2 = 1 and a.process_name = b.process_name and a.path = b.path and a.event_type = b.event_type)",
)

# ---- ordered operators

MINUTE = 60 * S.SECOND
put("threshold_unreset", lambda s, d: S.unreset(tel(s, d).where("event_type = 'file_rename'").select("event_id", "host_id", "us"), ["host_id"], 600 * MINUTE, 3).select("event_id", "observed"), f"select * from (select event_id, count(*) over (partition by host_id order by us range between {600 * MINUTE} preceding and current row) as observed from tel where event_type = 'file_rename') where observed >= 3")
put("value_count_unreset", lambda s, d: S.unreset(tel(s, d).where("event_type = 'process_create'").select("event_id", "host_id", "us", "process_name"), ["host_id"], 600 * MINUTE, 3, "process_name").select("event_id", "observed"), f"select * from (select a.event_id, count(distinct b.process_name) as observed from tel a join tel b on a.host_id = b.host_id and b.us between a.us - {600 * MINUTE} and a.us where a.event_type = 'process_create' and b.event_type = 'process_create' group by a.event_id) where observed >= 3")
_KEPT = "list_reduce(list_prepend({{'us': cast(-1 as bigint), 'last': cast(-1 as bigint), 'n': cast(0 as bigint)}}, l), lambda a, x: case when a.last >= 0 and x.us - a.last < {0} and x.us >= a.last then {{'us': x.us, 'last': a.last, 'n': a.n}} else {{'us': x.us, 'last': x.us, 'n': a.n + 1}} end)"


def _dedup(s: SparkSession, d: str) -> DataFrame:
    def step(state, row):
        last, passed = S.dedup(state, row.us, 1440 * MINUTE)
        return last, {"event_id": row.event_id, "host_id": row.host_id} if passed else None

    rows = tel(s, d).where("event_type = 'network_connect'").select("event_id", "host_id", "pid", "us")
    return S.folded(rows, ["host_id", "pid"], ["us", "event_id"], None, step, "event_id long, host_id string").groupBy("host_id").agg(F.count("*").alias("emitted"))


put("alert_dedup", _dedup, ", l as (select host_id, pid, list({'us': us, 'last': cast(-1 as bigint), 'n': cast(0 as bigint)} order by us, event_id) as l from tel where event_type = 'network_connect' group by all), r as (select host_id, " + _KEPT.format(1440 * MINUTE) + ".n as n from l) select host_id, cast(sum(n) as bigint) as emitted from r group by host_id")


def _threshold(s: SparkSession, d: str) -> DataFrame:
    def step(state, row):
        state, fired = S.threshold(state, row.us, 600 * MINUTE, 3)
        return state, {"event_id": row.event_id, "host_id": row.host_id} if fired else None

    return S.folded(tel(s, d).where("event_type = 'file_rename'").select("event_id", "host_id", "us"), ["host_id"], ["us", "event_id"], [], step, "event_id long, host_id string")


def _value_count(s: SparkSession, d: str) -> DataFrame:
    def step(state, row):
        state, fired = S.value_count(state, row.us, row.process_name, 600 * MINUTE, 3)
        return state, {"event_id": row.event_id, "host_id": row.host_id} if fired else None

    return S.folded(tel(s, d).where("event_type = 'process_create'").select("event_id", "host_id", "us", "process_name"), ["host_id"], ["us", "event_id"], [], step, "event_id long, host_id string")


def _sequence(s: SparkSession, d: str) -> DataFrame:
    def step(state, row):
        steps = {"process_create": [0], "network_connect": [1], "file_create": [2]}.get(row.event_type, [])
        state, fired = S.sequence(state, row.us, steps, 3, 600 * MINUTE)
        return state, {"event_id": row.event_id, "host_id": row.host_id} if fired else None

    return S.folded(tel(s, d).select("event_id", "host_id", "us", "event_type"), ["host_id"], ["us", "event_id"], [], step, "event_id long, host_id string")


def _beacon(s: SparkSession, d: str) -> DataFrame:
    def step(state, row):
        state, found = S.beacon(state, row.us)
        return state, {"event_id": row.event_id, "destination_ip": row.destination_ip, **found} if found else None

    rows = tel(s, d).where("event_type = 'network_connect'").where(C.destination_scope(F.col("destination_ip")) == "public").select("event_id", "host_id", "pid", "destination_ip", "destination_port", "us")
    return S.folded(rows, ["host_id", "pid", "destination_ip", "destination_port"], ["us", "event_id"], {}, step, "event_id long, destination_ip string, connections long, median_gap double, dispersion double")


def _risk(s: SparkSession, d: str) -> DataFrame:
    def step(state, row):
        state, fired = S.risk(state, row.us, row.rule_id, int(row.level))
        return state, {"event_id": row.event_id, "host_id": row.host_id, "score": state["score"]} if fired else None

    rows = R.scan(tel(s, d), RULES).groupBy("host_id", "event_id", "us").agg(F.max(F.struct("level", "rule_id")).alias("r")).select("host_id", "event_id", "us", "r.level", "r.rule_id")
    return S.folded(rows, ["host_id"], ["us", "event_id"], {}, step, "event_id long, host_id string, score long")


for _n, _q in (("threshold_reset", _threshold), ("value_count_reset", _value_count), ("sequence_match", _sequence), ("beacon_detect", _beacon), ("risk_meter", _risk)):
    put(_n, _q)


_LEVEL = lambda s, d: R.scan(tel(s, d), RULES)
_STAGES = ", " + HITS.rstrip() + ", tac(rule_id, tactic) as (values ('T-001', 'Discovery'), ('T-002', 'Lateral Movement'), ('T-003', 'Discovery'), ('T-004', 'Command and Control')), stg as (select host_id, pid, rule_id, min(us) as us, any_value(level) as level from hits group by all) "
put("incident_stages", lambda s, d: I.stages(_LEVEL(s, d)).select("host_id", "pid", "rule_id", "us"), _STAGES + "select host_id, pid, rule_id, us from stg")
put(
    "incident_score",
    lambda s, d: I.incident_scores(I.stages(_LEVEL(s, d))),
    _STAGES + ", g as (select host_id, count(*) as stages, count(distinct tactic) as tactics, max(level) as level from stg join tac using (rule_id) group by host_id), c as (select *, round(round(0.45::double * least(level / 16, 1), 3) + round(0.30::double * least(tactics, 5) / 5, 3), 3) as score from g) select host_id, stages, tactics, score, case when score >= 0.75 then 'critical' when score >= 0.55 then 'high' else 'medium' end as band from c",
)
put("response_recommendation", lambda s, d: _LEVEL(s, d).select("event_id", "rule_id", I.response(F.col("level"), F.col("pid")).alias("action")), ", " + HITS + "select event_id, rule_id, case when level between 12 and 13 and pid is not null then 'terminate_process' when level >= 14 then 'isolate_host' end as action from hits")
put("risk_index", lambda s, d: I.risk_index(_LEVEL(s, d).withColumn("points", F.col("level").cast("double")), ["host_id"], "points"), ", " + HITS + "select host_id, round(max(level) + 0.2::double * (sum(level) - max(level)), 6) as risk_index from hits group by host_id")
_SPOOL = lambda s, d: tel(s, d).select(F.col("event_id").cast("string").alias("alert_id"), F.when(F.col("k") % 3 == 0, "delivered").otherwise("pending").alias("status"), F.col("us").alias("created_us"), (F.col("us") + F.col("k") * 1_000_000).alias("next_attempt_us"))
_SPOOL_SQL = ", sp as (select event_id::varchar as alert_id, case when k % 3 = 0 then 'delivered' else 'pending' end as status, us as created_us, us + k * 1000000 as next_attempt_us from tel) "
put("spool_claim", lambda s, d: I.claim(_SPOOL(s, d), F.lit(2 * 10**15), 25).select("alert_id", "created_us"), _SPOOL_SQL + "select alert_id, created_us from sp where status = 'pending' and next_attempt_us <= 2000000000000000 order by created_us, alert_id limit 25")
put("delivery_dedup", lambda s, d: I.undelivered(_SPOOL(s, d), _SPOOL(s, d).where("status = 'delivered'")).groupBy("status").agg(F.count("*").alias("n")), _SPOOL_SQL + "select status, count(*) as n from sp where alert_id not in (select alert_id from sp where status = 'delivered') group by status")
TREES = [{"feature": "k", "threshold": 40, "left": {"value": -0.5}, "right": {"feature": "value", "threshold": 60, "left": {"value": 0.25}, "right": {"value": 1.0}}}, {"feature": "access_mask", "threshold": 5000, "left": {"value": 0.125}, "right": {"value": -0.125}}]
put("tree_score", lambda s, d: tel(s, d).select("event_id", I.tree_score(TREES).alias("score")), "select event_id, (case when k <= 40 then -0.5 when value <= 60 then 0.25 else 1.0 end + case when access_mask <= 5000 then 0.125 else -0.125 end)::double as score from tel")
put("token_grams", lambda s, d: tel(s, d).where("command_line <> ''").select(F.explode(I.grams(F.col("command_line"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), ", w as (select event_id, regexp_extract_all(lower(command_line), '([a-z0-9_.]+)', 1) as w from tel where command_line <> ''), g as (select distinct event_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as gram from w) select gram, count(*) as n from g group by gram")
put("time_to_detect", lambda s, d: tel(s, d).groupBy("host_id").agg(F.round((F.min(F.when(F.col("value") >= 150, F.col("us"))) - F.min("us")) / 1e6, 3).alias("seconds")), "select host_id, round((min(us) filter (value >= 150) - min(us)) / 1e6, 3) as seconds from tel group by host_id")
put("behaviour_difference", lambda s, d: tel(s, d).groupBy("host_id").agg(F.array_join(F.array_sort(F.array_except(F.collect_set(F.when(F.col("k") < 50, F.col("process_name"))), F.collect_set(F.when(F.col("value") > 100, F.col("process_name"))))), ",").alias("only")), "select host_id, coalesce(string_agg(process_name, ',' order by process_name), '') as only from (select host_id, process_name from tel group by all having bool_or(k < 50) and not bool_or(coalesce(value > 100, false))) right join (select distinct host_id from tel) using (host_id) group by host_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one scan, counted by host and rule."""
    return R.scan(tel(spark, sf_dir), RULES).groupBy("host_id", "rule_id").agg(F.count("*").alias("hits"), F.max("level").cast("bigint").alias("level"))


put("rule_hits_by_host", flagship, ", " + HITS + "select host_id, rule_id, count(*) as hits, cast(max(level) as bigint) as level from hits group by all")
