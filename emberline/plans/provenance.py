"""Queries over process identity, the provenance graph and what follows from them, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import alerts as AL
from emberline.operators import causality as G
from emberline.operators import graph as GR
from emberline.operators import identity as ID
from emberline.operators import processes as PR
from emberline.operators import stateful as S
from emberline.operators import storyline as T
from emberline.operators.causality import BOUNDARY
from emberline.plans import rules as R
from emberline.plans.catalogue import HITS, RULES, put, tel
from emberline.plans.lineage import alone, held, passing, stored

#: Columns of events of all families, as expressions that both engines read.
WIDE = {
    "event_type": "case when event_type = 'network_connect' and k % 5 = 0 then 'dns_query' when event_type = 'file_rename' and k % 4 = 0 then 'image_load' when event_type = 'registry_write' and k % 8 = 0 then 'process_terminate' "
    "when event_type = 'registry_write' and k % 8 = 1 then 'process_access' when event_type = 'registry_write' and k % 8 = 2 then 'remote_thread' when event_type = 'registry_write' and k % 8 = 3 then 'script_block' else event_type end",
    "target_pid": "user_id + 1",
    "target_path": "case when k % 2 = 0 then 'C:/Windows/System32/lsass.exe' else 'C:/Windows/explorer.exe' end",
    "executable": "path",
    "image_path": "path",
    "key_path": "replace(case when k % 3 = 0 then 'HKLM/SOFTWARE/Microsoft/Windows/CurrentVersion/Run/x' else 'HKLM/x' end, '/', chr(92))",
    "query_status": "case when k % 3 = 0 then 1 else 0 end",
    "is_signed": "case when k % 3 = 0 then 'false' else 'true' end",
    "script_text": "command_line",
    "script_block_id": "concat('s', cast(k as varchar(20)))",
    "parent_name": "case k % 4 when 0 then 'winword.exe' when 1 then 'Explorer.exe' when 2 then 'cmd.exe' end",
    "start_time_ticks": "case when k % 2 = 0 then k + 1 end",
}


def wide(s: SparkSession, d: str) -> DataFrame:
    rows = tel(s, d)
    return rows.selectExpr(*[c for c in rows.columns if c not in WIDE], *[f"{e} as {c}" for c, e in WIDE.items()])


ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || case when {0} % 1000000 = 0 then '' else '.' || lpad(({0} % 1000000)::varchar, 6, '0') end"
NODE = "'proc_' || substr(sha256({0} || '|' || {1} || '|' || " + ISO.format("{2}") + "), 1, 32)"
_WIDE_SQL = ", w0 as (select * exclude (event_type), " + ", ".join(f"{e} as {c}" for c, e in WIDE.items()) + " from tel), w as (select * from w0) "
_SAID = "select event_id, host_id, us, case event_type when 'process_create' then 'start' when 'process_terminate' then 'stop' else 'context' end as kind, pid, process_name as name, ppid::varchar as ppid from w union all select event_id, host_id, us, 'parent', ppid, lower(parent_name), null from w where event_type = 'process_create' union all select event_id, host_id, us, 'reference', target_pid, lower(string_split(target_path, '/')[-1]), null from w where event_type in ('process_access', 'remote_thread')"


def _fold(name: str, said: str) -> str:
    """A CTE that follows each pid of a host through what is said of it."""
    return (
        f"{name}_ix as (select *, row_number() over (partition by host_id, pid order by us, case kind when 'parent' then 0 when 'start' then 1 when 'context' then 2 when 'reference' then 3 else 4 end, event_id) as i from ({said})), "
        f"{name} as (with recursive f as (select host_id, pid, 0::bigint as i, 0::bigint as event_id, ''::varchar as kind, 0::bigint as us, null::varchar as name, null::varchar as ppid, null::bigint as st, null::bigint as en, []::struct(a bigint, n varchar, p varchar)[] as recent, null::bigint as got, false as opens from (select distinct host_id, pid from {name}_ix) "
        "union all select host_id, pid, i, event_id, kind, us, name, ppid, case when fresh then us when infer then us - 1 else st end, case when fresh or infer then null when kind = 'stop' and live then us else en end, case when fresh then list_append(near, {'a': us, 'n': name, 'p': ppid}) else recent end, "
        "case when fresh then us when kind = 'start' then same[1].a when infer then us - 1 when live then st end, fresh or infer from ("
        "select *, kind = 'start' and len(same) = 0 as fresh, kind in ('parent', 'context', 'reference') and not live as infer from ("
        "select *, list_filter(near, lambda r: not (name is not null and r.n is not null and name <> r.n) and not (ppid is not null and r.p is not null and ppid <> r.p)) as same from ("
        "select x.host_id, x.pid, x.i, x.event_id, x.kind, x.us, x.name, x.ppid, f.st, f.en, f.recent, f.st is not null and f.st <= x.us and case when f.en is not null then x.us < f.en else x.us - f.st <= 86400000000 end as live, list_filter(f.recent, lambda r: x.us - r.a <= 1000000) as near "
        f"from f join {name}_ix x on x.host_id = f.host_id and x.pid = f.pid and x.i = f.i + 1)))) select * from f where i > 0 and got is not null) "
    )


_LIVE = "p.host_id = {0}.host_id and p.start_us <= {1} and ({1} < p.end_us or (p.end_us is null and {1} - p.start_us <= 86400000000))"
_KNOWN = "arg_min({0}, (us, event_id)) filter ((kind = 'start' or opens) and {0} <> '')"
RUNS = (
    _WIDE_SQL + ", " + _fold("f1", _SAID) + ", " + _fold("f2", _SAID + " union all select f1.event_id, f1.host_id, f1.us - 1, 'parent', f1.ppid::bigint, lower(w.parent_name), null from f1 join w on w.event_id = f1.event_id where f1.opens and f1.kind = 'context' and f1.ppid is not null")
    + f", facts as (select f.*, w.executable, w.command_line, w.start_time_ticks from f2 f left join w on w.event_id = f.event_id and f.kind in ('start', 'context')), ref as (select f.event_id, f.host_id, f.pid, f.got, w.target_path from f2 f join w on w.event_id = f.event_id where f.kind = 'reference' and f.opens), "
    f"r0 as (select host_id, pid, got as start_us, bool_and(kind <> 'start') as inferred, min(us) filter (kind = 'stop') as stop_us, {_KNOWN.format('name')} as name, ({_KNOWN.format('ppid')})::bigint as ppid, {_KNOWN.format('executable')} as executable, {_KNOWN.format('command_line')} as command_line, arg_min(start_time_ticks, (us, event_id)) filter ((kind = 'start' or opens) and start_time_ticks is not null) as ticks from facts group by host_id, pid, got), "
    "r1 as (select r0.* replace (coalesce(r0.executable, (select min(target_path) from ref where ref.host_id = r0.host_id and ref.pid = r0.pid and ref.got = r0.start_us)) as executable), lead(start_us) over (partition by host_id, pid order by start_us) as next_us from r0), "
    f"r2 as (select host_id, pid, start_us, least(stop_us, next_us) as end_us, stop_us is not null as end_observed, inferred, name, ppid, executable, command_line, ticks, {NODE.format('host_id', 'pid', 'start_us')} as node_id from r1), "
    f"runs as (select r.*, p.node_id as parent_node_id from r2 r left join r2 p on p.pid = r.ppid and {_LIVE.format('r', '(r.start_us - case when r.ppid = r.pid then 1 else 0 end)')}) "
)

#: The parts of the folder that was asked for last.
_held: dict[tuple[int, str], tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = {}


def parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events with nodes, mentions, runs and edges of a folder, worked out once a session and written to the shared folder."""
    key = (id(s._jsparkSession), d)
    if key not in _held:
        _held.clear()
        events = wide(s, d)
        found = ID.resolved(events)
        runs = stored(ID.incarnations(found))
        named = GR.with_nodes(events, found)  # as wide as the events, so it is not written beside them
        with passing(s):
            _held[key] = named, found, runs, stored(GR.edges(named, runs))
    return _held[key]


put("identity_runs", lambda s, d: parts(s, d)[2].select("host_id", "pid", "start_us", "end_us", "end_observed", "inferred", "name", "node_id", "parent_node_id"), RUNS + "select host_id, pid, start_us, end_us, end_observed, inferred, name, node_id, parent_node_id from runs")
put("event_actors", lambda s, d: parts(s, d)[0].select("event_id", "node_id", "target_node_id"), RUNS + f", a as (select event_id, max({NODE.format('host_id', 'pid', 'got')}) filter (kind in ('start', 'context')) as node_id, max({NODE.format('host_id', 'pid', 'got')}) filter (kind = 'reference') as target_node_id from f2 group by event_id) select w.event_id, a.node_id, a.target_node_id from w left join a using (event_id)")
put("inferred_parents", lambda s, d: parts(s, d)[2].where("inferred").groupBy("host_id").agg(F.count("*").alias("inferred"), F.count("parent_node_id").alias("parented"), F.count("name").alias("named")), RUNS + "select host_id, count(*) as inferred, count(parent_node_id) as parented, count(name) as named from runs where inferred group by host_id")
put("observed_ends", lambda s, d: parts(s, d)[2].where("end_observed").select("node_id", F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("lifetime_seconds")), RUNS + "select node_id, round((end_us - start_us) / 1e6, 3) as lifetime_seconds from runs where end_observed")
put("cross_process_targets", lambda s, d: GR.targets(parts(s, d)[0], parts(s, d)[2]).select("event_id", F.col("match_node_id").alias("target")), RUNS + f"select w.event_id, p.node_id as target from w left join runs p on p.pid = w.target_pid and {_LIVE.format('w', 'w.us')} where w.event_type in ('process_access', 'remote_thread')")
put(
    "response_ticks",
    lambda s, d: ID.with_ticks(wide(s, d).where("k % 7 = 0").select("event_id", "host_id", F.col("pid").alias("target_pid"), "us", F.lit(None).cast("long").alias("target_start_time_ticks")), parts(s, d)[2]).select("event_id", "target_start_time_ticks"),
    RUNS + f"select w.event_id, p.ticks as target_start_time_ticks from w left join runs p on p.pid = w.pid and {_LIVE.format('w', 'w.us')} where w.k % 7 = 0",
)
_HUBS = ", ".join(f"'{b}'" for b in BOUNDARY)
_UP = ", up as (with recursive u as (select node_id as node, parent_node_id as ancestor, 1 as level from runs where parent_node_id is not null union all select u.node, r.parent_node_id, u.level + 1 from u join runs r on r.node_id = u.ancestor where r.parent_node_id is not null and u.level < 16) select u.*, r.name from u join runs r on r.node_id = u.ancestor) "
_TREE = _UP + f", hub as (select node, min(level) filter (name in ({_HUBS})) as first, max(level) as depth from up group by node), top as (select u.node, arg_max(u.ancestor, u.level) as root, max(u.level) as at from up u join hub h on h.node = u.node where h.first is null or u.level < h.first group by u.node), tree as (select r.node_id, coalesce(h.depth, 0)::bigint as depth, coalesce(t.root, r.node_id) as root_node_id from runs r left join hub h on h.node = r.node_id left join top t on t.node = r.node_id) "
put("process_lineage", lambda s, d: ID.lineage(parts(s, d)[2]).select("node_id", F.col("depth").cast("long").alias("depth"), "root_node_id"), RUNS + _TREE + "select node_id, depth, root_node_id from tree")

# ---- the graph

_FILE = "'file_' || substr(sha256('file|' || {0}.host_id || '|' || lower({1})), 1, 32)"
_SOCKET = "case when w.destination_port <> 0 then w.destination_ip || ':' || w.destination_port else w.destination_ip end"
EDGES = (
    RUNS + f", ac as (select event_id, max({NODE.format('host_id', 'pid', 'got')}) filter (kind in ('start', 'context')) as node_id, max({NODE.format('host_id', 'pid', 'got')}) filter (kind = 'reference') as target from f2 group by event_id), wn as (select w.*, ac.node_id, ac.target, r.parent_node_id, coalesce(nullif(r.executable, ''), nullif(w.executable, '')) as image from w join ac using (event_id) left join runs r on r.node_id = ac.node_id where ac.node_id is not null), "
    f"e0 as (select 'executed' as kind, node_id as src, {_FILE.format('wn', 'image')} as dst, us, event_id::varchar as event_id, image as label, host_id from wn where event_type = 'process_create' and image is not null "
    "union all select 'forked', parent_node_id, node_id, us, event_id::varchar, process_name, host_id from wn where event_type = 'process_create' and parent_node_id is not null "
    f"union all select 'connected_to', w.node_id, 'sock_' || substr(sha256('socket||' || lower({_SOCKET})), 1, 32), us, event_id::varchar, {_SOCKET}, host_id from wn w where event_type = 'network_connect' and destination_ip is not null "
    f"union all select case event_type when 'file_create' then 'wrote' else 'renamed' end, node_id, {_FILE.format('wn', 'path')}, us, event_id::varchar, path, host_id from wn where event_type in ('file_create', 'file_rename') and path is not null "
    "union all select 'set_value', node_id, 'regi_' || substr(sha256('registry_key|' || host_id || '|' || lower(key_path)), 1, 32), us, event_id::varchar, key_path, host_id from wn where event_type = 'registry_write' "
    f"union all select 'loaded', node_id, {_FILE.format('wn', 'path')}, us, event_id::varchar, path, host_id from wn where event_type = 'image_load' and path is not null "
    "union all select 'resolved', node_id, 'doma_' || substr(sha256('domain|' || host_id || '|' || lower(query_name)), 1, 32), us, event_id::varchar, query_name, host_id from wn where event_type = 'dns_query' and query_name is not null "
    "union all select case event_type when 'process_access' then 'accessed' else 'injected' end, node_id, target, us, event_id::varchar, target_path, host_id from wn where event_type in ('process_access', 'remote_thread') and target is not null "
    "union all select 'ran_script', node_id, 'scri_' || substr(sha256('script|' || host_id || '|' || lower(script_block_id) || '#1'), 1, 32), us, event_id::varchar, script_block_id, host_id from wn where event_type = 'script_block' "
    "union all select 'forked', parent_node_id, node_id, start_us, null, name, host_id from runs where inferred and parent_node_id is not null), "
    f"ed as (select distinct on (edge_id) * from (select 'e_' || substr(sha256(kind || '|' || src || '|' || dst || '|' || {ISO.format('us')} || '|' || coalesce(event_id, '')), 1, 32) as edge_id, * from e0)) "
)
put("provenance_edges", lambda s, d: parts(s, d)[3].select("edge_id", "kind", "src", "dst", "us"), EDGES + "select edge_id, kind, src, dst, us from ed")
put(
    "provenance_nodes",
    lambda s, d: GR.nodes(parts(s, d)[3], parts(s, d)[2]).select("node_id", "kind", "first_us", "degree"),
    EDGES + ", en as (select src as node_id, 'process' as kind, us from ed union all select dst, case when kind in ('forked', 'accessed', 'injected') then 'process' when kind = 'connected_to' then 'socket' when kind = 'set_value' then 'registry_key' when kind = 'resolved' then 'domain' when kind = 'ran_script' then 'script' else 'file' end, us from ed) "
    "select en.node_id, min(en.kind) as kind, least(min(en.us), min(r.start_us)) as first_us, count(*) as degree from en left join runs r on r.node_id = en.node_id group by en.node_id",
)
_TAC = ", tac(rule_id, tactic) as (values ('T-001', 'Discovery'), ('T-002', 'Lateral Movement'), ('T-003', 'Discovery'), ('T-004', 'Command and Control')) "
_TAGS = EDGES + ", " + HITS.rstrip() + _TAC + ", sent as (select event_id::varchar as event_id, rule_id from hits where event_id % 2 = 0), tg as (select ed.edge_id, ed.us, hits.rule_id, hits.level, tac.tactic, case when ed.kind = 'forked' then ed.dst else ed.src end as actor, case when sent.event_id is not null then 'A' || ed.event_id end as alert_id from ed join hits on hits.event_id::varchar = ed.event_id join tac on tac.rule_id = hits.rule_id left join sent on sent.event_id = ed.event_id and sent.rule_id = hits.rule_id where ed.kind <> 'executed') "


def tags(s: SparkSession, d: str) -> DataFrame:
    hits = R.scan(tel(s, d), RULES).select("event_id", "rule_id", "level", "tactic")
    sent = hits.where("event_id % 2 = 0").select("event_id", "rule_id", F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("alert_id"))
    return GR.tags(parts(s, d)[3], hits, sent)


put("edge_tags", lambda s, d: tags(s, d).select("edge_id", "rule_id", "actor", "tactic", "alert_id"), _TAGS + "select edge_id, rule_id, actor, tactic, alert_id from tg")
put("graph_size", lambda s, d: GR.size(parts(s, d)[3], GR.nodes(parts(s, d)[3], parts(s, d)[2]), tags(s, d)), _TAGS + "select (select count(distinct n) from (select src as n from ed union all select dst from ed)) as nodes, (select count(*) from ed) as edges, (select count(distinct edge_id) from tg) as tagged")
put("pruned_edges", lambda s, d: GR.kept(parts(s, d)[3], "us", F.lit(1_705_200_000_000_000), 86_400_000_000 * 2).groupBy("kind").agg(F.count("*").alias("n")), EDGES + f"select kind, count(*) as n from ed where us >= 1705200000000000 - {86_400_000_000 * 2} group by kind")

# ---- what processes did

_WRITABLE = "(contains('/' || lower(replace(ltrim({0}, '/'), chr(92), '/')), '/temp/') or contains('/' || lower(ltrim({0}, '/')), '/users/') or contains(lower({0}), '/appdata/') or contains(lower({0}), '/downloads/'))"
_PUBLIC = "x.destination_ip in ('203.0.113.10', '8.8.8.8')"
_DID = EDGES + (
    ", ends as (select e.*, e.src as node_id, true as out, e.dst as other from ed e union all select e.*, e.dst, false, e.src from ed e where e.src <> e.dst), x as (select ends.*, t.destination_ip, t.destination_port, t.query_status, t.is_signed, t.access_mask, t.command_line, t.path from ends left join w t on t.event_id::varchar = ends.event_id) "
)
put(
    "process_behaviour",
    lambda s, d: PR.behaviour(parts(s, d)[3]).select("node_id", "child_count", "file_write_count", "executable_write_count", "registry_write_count", "network_connect_count", "public_connect_count", "module_load_count", "dns_query_count", "failed_dns_query_count", "process_access_count", "lsass_access_count", "remote_thread_count", "injected_thread_count", "script_block_count", "script_block_bytes", "distinct_domain_count"),
    _DID + ", c as (select node_id, count(*) filter (out and kind = 'forked') as child_count, count(*) filter (out and kind = 'wrote') as file_write_count, count(*) filter (out and kind = 'wrote' and regexp_matches(lower(label), '[^/]\\.(exe|dll|scr|sys|com)$')) as executable_write_count, count(*) filter (out and kind = 'set_value') as registry_write_count, "
    f"count(*) filter (out and kind = 'connected_to') as network_connect_count, count(*) filter (out and kind = 'connected_to' and {_PUBLIC}) as public_connect_count, count(*) filter (out and kind = 'loaded') as module_load_count, count(*) filter (out and kind = 'resolved') as dns_query_count, count(*) filter (out and kind = 'resolved' and query_status <> 0) as failed_dns_query_count, "
    "count(*) filter (out and kind = 'accessed') as process_access_count, count(*) filter (out and kind = 'accessed' and contains(label, 'lsass')) as lsass_access_count, count(*) filter (out and kind = 'injected') as remote_thread_count, count(*) filter (not out and kind = 'injected') as injected_thread_count, count(*) filter (out and kind = 'ran_script') as script_block_count, "
    "coalesce(sum(length(command_line)) filter (out and kind = 'ran_script'), 0)::bigint as script_block_bytes, count(distinct lower(label)) filter (out and kind = 'resolved') as distinct_domain_count from x group by node_id) select * from c",
)
_ROLE = "x.label in ('whoami.exe', 'net.exe', 'ipconfig.exe', 'nltest.exe', 'systeminfo.exe', 'powershell.exe', 'cmd.exe', 'rundll32.exe')"
_BITS = _DID + (
    f", bt as (select node_id, other, unnest(list_filter([case when out and kind = 'forked' and {_ROLE} then 'child:shell_or_lolbin' end, case when out and kind = 'wrote' and {_WRITABLE.format('label')} and regexp_matches(lower(label), '[^/]\\.exe$') then 'file:executable_to_user_path' end, case when out and kind = 'set_value' and contains(lower(label), 'currentversion' || chr(92) || 'run') then 'registry:persistence_key' end, "
    f"case when out and kind = 'loaded' and {_WRITABLE.format('label')} then 'image_load:user_path_module' end, case when out and kind = 'loaded' and is_signed = 'false' then 'image_load:unsigned_module' end, case when out and kind = 'accessed' and contains(label, 'lsass') and (access_mask::bigint & 16) <> 0 then 'process_access:lsass_read' end, case when out and kind = 'injected' then 'remote_thread:out' end, case when not out and kind = 'injected' then 'remote_thread:in' end, "
    f"case when out and kind = 'connected_to' and {_PUBLIC} then 'network:public_destination' end, case when out and kind = 'connected_to' and {_PUBLIC} and destination_port not in (53, 80, 443) then 'network:public_nonstandard_port' end, case when out and kind = 'resolved' and query_status <> 0 then 'dns:failed_query' end, "
    "case when out and kind = 'ran_script' and (contains(command_line, '^') or contains(command_line, '`') or contains(command_line, '''+''') or contains(command_line, '-enc ')) then 'script_block:obfuscated' end], lambda b: b is not null)) as bit, us from x) "
)
put("behaviour_bits", lambda s, d: PR.bit_objects(parts(s, d)[3]).select("node_id", "bit", F.col("objects").cast("long").alias("objects")), _BITS + "select node_id, bit, least(count(distinct other), 10)::bigint as objects from bt group by all")
put("bit_checkpoints", lambda s, d: PR.first_bits(parts(s, d)[3]).select("node_id", "bit", "us"), _BITS + "select node_id, bit, us from (select node_id, bit, min(us) as us, row_number() over (partition by node_id order by min(us), bit) as p from bt group by node_id, bit) where p <= 8")


_recorded: dict[int, DataFrame] = {}


def records(s: SparkSession, d: str) -> DataFrame:
    _, _, runs, edges = parts(s, d)
    if id(runs) not in _recorded:
        _recorded.clear()
        with passing(s):
            _recorded[id(runs)] = stored(PR.records(runs, edges, held(PR.image_writes(runs, edges))))
    return _recorded[id(runs)]


_WRITES = ", wr as (select r.node_id, arg_max(e.src, (e.us, e.edge_id)) as writer, max(e.us) as since from runs r join ed e on e.kind in ('wrote', 'renamed') and e.dst = " + _FILE.format("r", "r.executable") + " where r.executable <> '' and e.us <= r.start_us and e.src <> r.node_id group by r.node_id) "
put(
    "process_records",
    lambda s, d: records(s, d).select("node_id", F.col("depth").cast("long").alias("depth"), "parent_name", "cmdline_length", "cmdline_token_count", "image_writer_name", "image_age_seconds", "lifetime_seconds", F.array_join("behavior_bits", ",").alias("bits")),
    _BITS + _TREE + _WRITES + ", ob as (select node_id, list(distinct bit) as b from bt group by node_id) select r.node_id, tree.depth, nullif(p.name, '') as parent_name, length(coalesce(r.command_line, ''))::int as cmdline_length, len(list_filter(string_split_regex(coalesce(r.command_line, ''), '\\s+'), lambda x: x <> ''))::int as cmdline_token_count, wn2.name as image_writer_name, round((r.start_us - wr.since) / 1e6, 6) as image_age_seconds, "
    "case when r.end_observed then round((r.end_us - r.start_us) / 1e6, 3) end as lifetime_seconds, coalesce(array_to_string(list_filter([" + ", ".join(f"'{b}'" for b in PR.BITS) + "], lambda b: list_contains(ob.b, b)), ','), '') as bits "
    "from runs r join tree using (node_id) left join runs p on p.node_id = r.parent_node_id left join wr on wr.node_id = r.node_id left join runs wn2 on wn2.node_id = wr.writer left join ob on ob.node_id = r.node_id",
)
_CLASS = "case when {0} is null or {0} = '' then null when length('/' || ltrim(lower({0}), '/')) - length(replace('/' || ltrim(lower({0}), '/'), '/', '')) < 2 then 'unknown' when contains('/' || lower({0}), '/temp/') then 'temp' when regexp_matches('/' || ltrim(lower({0}), '/'), '/(users|appdata|programdata|home|downloads)/') then 'user_writable' when regexp_matches('/' || ltrim(lower({0}), '/'), '/(program files|program files \\(x86\\)|opt)/') then 'program_files' when regexp_matches('/' || ltrim(lower({0}), '/'), '/(windows|usr/bin|usr/sbin|usr/lib|bin|sbin|lib)/') then 'system' else 'other' end"
_RARE = _DID + (
    f", rec as (select r.node_id, r.name, p.name as parent, {_CLASS.format('r.executable')} as place from runs r left join runs p on p.node_id = r.parent_node_id where not r.inferred and r.name <> ''), crossed as (select distinct x.node_id, x.kind, lower(string_split(x.label, '/')[-1]) as target from x where x.out and x.kind in ('accessed', 'injected')), "
    "base as (select 'name' as dimension, name as value, count(*) as n from rec group by all union all select 'parent_child', parent || ' -> ' || name, count(*) from rec where parent <> '' group by all union all select 'name_path_class', name || ' @ ' || place, count(*) from rec where place is not null group by all "
    "union all select 'cross_process', rec.name || ' -> ' || c.target || case when c.kind = 'accessed' then ' (access)' else ' (remote_thread)' end, count(*) from rec join crossed c using (node_id) group by all) "
)
put("rarity_dimensions", lambda s, d: PR.rarity(records(s, d)), _RARE + "select * from base")
_READY = "select coalesce(sum(n) filter (dimension = 'name'), 0)::bigint as observations, count(*) filter (dimension = 'parent_child') as relationships, coalesce(sum(n) filter (dimension = 'cross_process'), 0)::bigint as crossed from base"
put("rarity_readiness", lambda s, d: PR.readiness(PR.rarity(records(s, d))), _RARE + f"select *, observations >= 200 and relationships >= 25 as ready, observations >= 200 and relationships >= 25 and crossed >= 10 as crossed_ready from ({_READY})")
put(
    "rarity_rated",
    lambda s, d: PR.rated(records(s, d).where("parent_child is not null").select("node_id", F.lit("parent_child").alias("dimension"), F.col("parent_child").alias("value")), PR.rarity(records(s, d))).select("node_id", "n", "category", "relative"),
    _RARE + f", rd as ({_READY}), ask as (select r.node_id, p.name || ' -> ' || r.name as value from runs r join runs p on p.node_id = r.parent_node_id where p.name <> '' and r.name <> '') select ask.node_id, coalesce(b.n, 0) as n, case when rd.observations < 200 or rd.relationships < 25 then 'not_ready' when b.n is null then 'unseen' when b.n <= 2 then 'uncommon' else 'common' end as category, case when rd.observations > 0 then round(coalesce(b.n, 0) / rd.observations, 6) else 0.0 end as relative from ask cross join rd left join base b on b.dimension = 'parent_child' and b.value = ask.value",
)

# ---- incidents

_SCOPE = lambda s, d: ID.lineage(parts(s, d)[2]).select(F.col("root_node_id").alias("incident_id"), "node_id", (F.col("root_node_id") == F.col("node_id")).alias("is_root"))
_SCOPE_SQL = _TREE + ", sc as (select root_node_id as incident_id, node_id, root_node_id = node_id as is_root from tree) "
put("incident_origins", lambda s, d: AL.origins(_SCOPE(s, d), parts(s, d)[2]), RUNS + _SCOPE_SQL + f"select sc.incident_id, arg_min(r.node_id, (r.start_us, r.node_id)) as origin_node_id, arg_min(struct_pack(v := r.name), (r.start_us, r.node_id)).v as origin from sc join runs r using (node_id) where coalesce(r.name, '') not in ({_HUBS}) group by sc.incident_id")
_ENTRY = ", ".join(f"'{b}'" for b in AL.ENTRY)
put(
    "incident_context",
    lambda s, d: AL.context(_SCOPE(s, d), parts(s, d)[2], parts(s, d)[3]).select("incident_id", F.array_join("factors", ",").alias("factors"), "context"),
    _DID + _SCOPE_SQL + f", pub as (select distinct node_id from x where out and kind = 'connected_to' and {_PUBLIC}), fa as (select sc.incident_id, bool_or(sc.is_root and coalesce(r.name, '') in ({_ENTRY})) as a, bool_or(coalesce({_CLASS.format('r.executable')}, '') in ('temp', 'user_writable')) as b, bool_or(pub.node_id is not null) as c, bool_or(contains(coalesce(r.command_line, ''), '^') or contains(coalesce(r.command_line, ''), '''+''') or contains(coalesce(r.command_line, ''), '-enc ')) as o from sc join runs r on r.node_id = sc.node_id left join pub on pub.node_id = sc.node_id group by sc.incident_id) "
    "select incident_id, array_to_string(list_filter([case when a then 'entry' end, case when b then 'writable' end, case when c then 'public' end, case when o then 'obfuscated' end], lambda x: x is not null), ',') as factors, round(least((case when a then 0.10 else 0 end + case when b then 0.08 else 0 end + case when c then 0.07 else 0 end + case when o then 0.05 else 0 end)::double, 0.25), 3) as context from fa",
)
put(
    "causal_paths",
    lambda s, d: AL.paths(parts(s, d)[3].where("kind = 'forked'").join(_SCOPE(s, d).select("incident_id", F.col("node_id").alias("dst")), "dst").select("incident_id", "edge_id", "kind", "src", "dst", "us"), GR.nodes(parts(s, d)[3], parts(s, d)[2])).select("incident_id", F.size("causal_path").cast("long").alias("lines"), F.element_at("causal_path", 1).alias("first")),
    EDGES + _SCOPE_SQL + f", pe as (select sc.incident_id, e.*, row_number() over (partition by sc.incident_id order by e.us, e.edge_id) as p from ed e join sc on sc.node_id = e.dst where e.kind = 'forked') select pe.incident_id, least(max(count(*)) over (partition by pe.incident_id), 25)::bigint as lines, any_value({ISO.format('pe.us')} || ' ' || coalesce(a.name, '') || '[' || a.pid || '] -[forked]-> ' || coalesce(b.name, '') || '[' || b.pid || ']') filter (pe.p = 1) as first from pe join runs a on a.node_id = pe.src join runs b on b.node_id = pe.dst group by pe.incident_id",
)


def _incident_rows(s: SparkSession, d: str) -> DataFrame:
    _, _, runs, _ = parts(s, d)
    stages = tags(s, d).join(_SCOPE(s, d).select("incident_id", F.col("node_id").alias("actor")), "actor").select("incident_id", "us", "rule_id", "tactic", F.lit(0.8).alias("confidence"), "alert_id")
    root = runs.select(F.col("node_id").alias("incident_id"), "host_id", F.col("name").alias("root_name"), F.col("pid").alias("root_pid"), F.col("node_id").alias("root_node_id"), F.col("start_time_ticks").alias("root_ticks"))
    incidents = root.select("*", F.lit(1).alias("revision"), F.lit("high").alias("band"), F.lit(0.6).alias("score"))
    return AL.incident_alerts(incidents, stages)


put(
    "incident_records",
    lambda s, d: _incident_rows(s, d).select("alert_id", "level", "title", "attack_chain", F.size("members").cast("long").alias("stages"), F.col("active_response.target_start_time_ticks").cast("long").alias("ticks")),
    _TAGS + _SCOPE_SQL + ", st as (select sc.incident_id, tg.us, tg.rule_id, tg.tactic from tg join sc on sc.node_id = tg.actor), g as (select incident_id, string_agg(rule_id || ' (' || tactic || ')', ' -> ' order by us, rule_id) as attack_chain, count(*) as stages, count(distinct tactic) as tactics from st group by incident_id) "
    "select g.incident_id || '-R1' as alert_id, 13 as level, '[INCIDENT] ' || g.tactics || '-tactic attack chain rooted at ' || coalesce(r.name, 'unknown') as title, g.attack_chain, g.stages, r.ticks from g join runs r on r.node_id = g.incident_id",
)


# ---- storylines and incidents over the graph

SPAN = 6 * G.HOUR
#: Detected edges whose scopes are searched at once: all have their turn, and disk is for those of one.
AT_ONCE = 100_000


def storylines(s: SparkSession, d: str) -> DataFrame:
    """Risk of storylines: what is detected in a process tree, by its root."""
    roots = ID.lineage(parts(s, d)[2]).select(F.col("node_id").alias("actor"), "root_node_id")
    rows = tags(s, d).join(roots, "actor").join(wide(s, d).select(F.col("event_id").cast("string").alias("event_id"), "k", "host_id"), "event_id").select("host_id", "root_node_id", "us", "event_id", "rule_id", "level", "tactic", "k")

    def step(state, row):
        state, made = T.story(state, row.us, f"rule:{row.rule_id}", str(row.k), row.level / 16 * 70, row.tactic)
        return state, {"host_id": row.host_id, "root_node_id": row.root_node_id, "event_id": row.event_id, **{k: made[k] for k in ("score", "run", "sources")}} if made else None

    return S.folded(rows, ["host_id", "root_node_id"], ["us", "event_id", "rule_id"], {}, step, "host_id string, root_node_id string, event_id string, score double, run long, sources long")


def _key(c: str) -> Column:
    """An id of a node as 17 bytes: the first letter of its kind, and its hash; of one kind they are in the order of ids."""
    return F.concat(F.substring(c, 1, 1).cast("binary"), F.unhex(F.substring(c, 6, 32)))


def incidents(s: SparkSession, d: str) -> DataFrame:
    """Incidents: a detection's scope is what led to its process and, from the root of its tree on, what came of that, within the horizon."""
    _, _, runs, edges = parts(s, d)
    with passing(s):
        return stored(_incidents(s, d, runs.withColumn("key", _key("node_id")), edges))


def _incidents(s: SparkSession, d: str, runs: DataFrame, edges: DataFrame) -> DataFrame:
    # an edge has one actor, so its number, which is shorter than its id, stands for the detections on it in all that is reached
    found = tags(s, d).join(edges.select("edge_id", "host_id"), "edge_id").groupBy("edge_id", "event_id", "actor", "us", "host_id").agg(F.collect_list(F.struct("rule_id", "level", "tactic")).alias("hits"))
    found = held(found.select(F.monotonically_increasing_id().alias("anchor"), "event_id", _key("actor").alias("actor"), "us", "host_id", "hits"))
    hubs = runs.where(F.col("name").isin(*BOUNDARY)).select(F.col("key").alias("node"))
    along = F.when(F.col("kind").isin("executed", "loaded"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))).when(F.col("kind").isin("forked", "wrote", "renamed", "deleted", "set_value", "created_key", "deleted_key", "injected"), F.struct("src", "dst"))
    flow = edges.select("us", along.alias("f"), "kind").where("f is not null").select(_key("f.src").alias("src"), _key("f.dst").alias("dst"), "us", "kind")
    starts = found.select("anchor", "actor", (F.col("us") - SPAN).alias("lo"), F.col("us").alias("hi"))
    roots = held(ID.lineage(runs).select(_key("node_id").alias("actor"), _key("root_node_id").alias("node")))
    process = F.substring("node", 1, 1) == F.lit("p").cast("binary")
    portions = -(-found.count() // AT_ONCE) or 1

    def reach(i: int) -> DataFrame:
        some = starts.where(F.col("anchor") % portions == i)
        back = G.walk(some.withColumnRenamed("actor", "node"), flow, True, span=SPAN, stop=hubs)
        ahead = G.walk(some.join(roots, "actor").select("anchor", "node", "lo", "hi"), flow.where("kind in ('forked', 'injected')"), False, span=SPAN, stop=hubs)
        return back.select("anchor", "node").unionByName(ahead.select("anchor", "node")).where(process).distinct().join(hubs, "node", "left_anti")

    reached = reduce(DataFrame.unionByName, [alone(s, lambda i=i: reach(i)) for i in range(portions)])
    own, known = F.col("anchor").alias("incident_id"), runs.select(F.col("key").alias("node_id"), "name", "executable", "command_line")
    context = held(AL.context(reached.select(own, F.col("node").alias("node_id"), F.lit(False).alias("is_root")), known, edges.withColumn("src", _key("src"))).select(F.col("incident_id").alias("anchor"), "context"))
    scopes = reached.groupBy("anchor").agg(F.collect_list("node").alias("scope"))
    rows = found.join(context, "anchor", "left").join(scopes, "anchor", "left").select("host_id", "event_id", "actor", "us", "context", "scope", F.inline("hits"))

    def step(state, row):
        state, made = T.incident(state, {"us": row.us, "event_id": row.event_id, "rule_id": row.rule_id, "actor": row.actor, "level": row.level, "tactic": row.tactic, "context": row.context, "scope": [] if row.scope is None else list(row.scope)})
        return state, {"host_id": row.host_id, "event_id": row.event_id, **made, "root": f"proc_{made['root'][1:].hex()}"} if made else None

    return S.folded(rows, ["host_id"], ["us", "event_id", "rule_id"], {}, step, "host_id string, event_id string, incident_id string, revision long, score double, band string, stages long, tactics long, root string, merged long")


put("storyline_alerts", storylines)
put("incident_alerts", incidents)
