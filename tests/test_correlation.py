"""Recordings, walks, storylines, incidents and features on small fixtures."""

import base64
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.functions import features as X
from emberline.operators import causality as G
from emberline.operators import stateful as S
from emberline.operators import storyline as T
from emberline.sources import records

EVENT = "<Event xmlns='x'><System><Provider Name='Microsoft-Windows-Sysmon'/><EventID>1</EventID><TimeCreated SystemTime='2020-09-04T20:09:55.76Z'/><EventRecordID>{i}</EventRecordID><Channel>Microsoft-Windows-Sysmon/Operational</Channel><Computer>PC1</Computer></System><EventData><Data Name='UtcTime'>2020-09-04 20:09:55.760</Data><Data Name='ProcessId'>0x10</Data><Data Name='Image'>C:\\Windows\\cmd.exe</Data><Data Name='CommandLine'>cmd /c a &amp;&amp; b</Data><Data Name='User'>CORP\\al</Data><Data Name='ParentImage'>-</Data></EventData></Event>"


def one(spark, fn, *inputs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").orderBy("i").select(fn(F.col("x"))).collect()]


def test_xml(spark):
    text = EVENT.format(i=7) + "\n<Event ><broken</Event>" + EVENT.format(i=8)
    got = records.sysmon(records.xml_records(spark.createDataFrame([(text,), (None,), ("",)], "value string")), "d").collect()
    assert len(got) == 2 and len({r.event_id for r in got}) == 2
    r = got[0]
    assert (r.reason, r.event_type, r.pid, r.process_name, r.command_line, r.user_name, r.user_domain, r.parent_name, r.host_id) == (None, "process_create", 16, "cmd.exe", "cmd /c a && b", "al", "CORP", None, "PC1")


@pytest.mark.parametrize("kind", ["zip", "tar.gz", "json"])
def test_archives(spark, tmp_path, kind):
    path, one_, two = str(tmp_path / f"r.{kind}"), '{"a": 1}\n\n{bad\n', '{"a": 2}\n'
    if kind == "zip":
        with zipfile.ZipFile(path, "w") as z:
            for name, text in (("b.json", two), ("a.json", one_), ("__MACOSX/._a.json", "junk"), ("x.txt", "junk")):
                z.writestr(name, text)
    elif kind == "tar.gz":
        with tarfile.open(path, "w:gz") as t:
            for name, text in (("b.json", two), ("a.json", one_), ("._c.json", "junk")):
                info = tarfile.TarInfo(name)
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
    else:
        (tmp_path / "r.json").write_text(one_ + two)
    got = [r.record["a"] for r in records.records(records.lines(spark, path)).collect() if r.record.get("a")]
    assert sorted(got) == ["1", "2"]


def test_script_blocks(spark):
    base = {"Hostname": "H", "@timestamp": "2020-01-01T00:00:05Z"}
    rows = [
        {**base, "Channel": records.SYSMON, "EventID": 1, "RecordNumber": 1, "UtcTime": "2020-01-01 00:00:01.000", "ProcessId": "5", "Image": "C:\\a\\ps.exe"},
        {**base, "Channel": records.POWERSHELL, "EventID": 4104, "RecordNumber": 2, "ExecutionProcessID": "5", "ScriptBlockText": "é" * 9000},
        {**base, "Channel": "Security", "EventID": 4624},
        {**base, "Channel": records.SYSMON, "EventID": 10, "RecordNumber": 3, "SourceProcessId": "5", "SourceImage": "C:\\m.exe", "TargetProcessId": "9", "GrantedAccess": "0x1410"},
    ]
    df = records.sysmon(records.records(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")), "d")
    assert df.where("reason is not null").count() == 1
    got = {r.event_type: r for r in records.with_images(records.mapped(df)).collect()}
    script = got["script_block"]
    assert script.process_name == "ps.exe" and script.script_bytes == 18000 and script.script_text == "é" * 8192
    assert got["process_access"].access_mask == 0x1410 and got["process_access"].process_name == "m.exe" and got["process_access"].target_pid == 9
    assert {(r.event_type, r.n) for r in records.report(df).collect() if r.reason is None} == {("process_create", 1), ("script_block", 1), ("process_access", 1)}
    assert records.clock_offset(records.records(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))).first().offset_seconds == -4


def test_paths_of_devices(spark):
    table = {"\\Device\\HarddiskVolume2\\a\\b.exe": "C:\\a\\b.exe", "\\\\?\\C:\\x": "C:\\x", "\\Windows\\y": "C:\\Windows\\y", "z.exe": "z.exe", None: None, "\\Device\\HarddiskVolume\\q": "\\Device\\HarddiskVolume\\q"}
    assert one(spark, C.drive_path, *table) == list(table.values())


def test_decoding(spark):
    code = lambda text, how: base64.b64encode(text.encode(how)).decode().rstrip("=")
    wide, narrow = code("DownloadString('x')", "utf-16le"), code("plain text here", "utf-8")
    got = one(spark, C.deobfuscated, f"ps -enc {wide}", f"ps -e {narrow}", "ps -enc !!!", None, "", "a^b")
    assert got == [f"ps -enc {wide} [DECODED: DownloadString('x')]", f"ps -e {narrow} [DECODED: plain text here]", "ps -enc !!!", None, "", "ab"]


def brute(starts, flow, back, depth, stops):
    """Every path, without any memory of intervals."""
    out = {}

    def go(anchor, node, lo, hi, level):
        key = (anchor, node)
        held = out.get(key)
        end = hi if back else lo
        out[key] = (end, level) if held is None else ((max if back else min)(held[0], end), min(held[1], level))
        if level == depth or node in stops:
            return
        for src, dst, us in flow:
            if lo <= us <= hi and (dst if back else src) == node:
                go(anchor, src if back else dst, lo if back else us, us if back else hi, level + 1)

    for s in starts:
        go(*s, 0)
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("back", [True, False])
def test_walk(spark, back):
    random.seed(5)
    flow = [(f"n{random.randrange(9)}", f"n{random.randrange(9)}", random.randrange(100)) for _ in range(40)]
    starts = [(a, f"n{a}", 20, 90) for a in range(4)]
    got = G.walk(spark.createDataFrame(starts, "anchor long, node string, lo long, hi long"), spark.createDataFrame(flow, "src string, dst string, us long"), back, 4, 30, spark.createDataFrame([("n8",)], "node string"))
    assert {(r.anchor, r.node, r.hi if back else r.lo, r.depth) for r in got.collect()} == brute(starts, flow, back, 4, {"n8"})


def test_template_groups(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z"), (None, "a"), (4, None), (3, "c"), (5, "c")]
    got = {r.item: r.group for r in G.template_groups(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 9: 9}
    assert G.template_groups(spark.createDataFrame([], "i int, t string"), "i", "t").count() == 0


def test_merged_starts(spark):
    rows = [("H", 1, 0, "a", "x.exe", None), ("H", 1, 500_000, "b", None, "x -y"), ("H", 1, 900_000, "c", "z.exe", None), ("H", 1, 5_000_000, "d", "z.exe", None)]
    got = G.merged_starts(spark.createDataFrame(rows, "host_id string, pid int, us long, event_id string, name string, cmd string"), ["host_id", "pid"], ["name"], ["name", "cmd"])
    assert sorted((r.event_id, r.reports, r.name, r.cmd) for r in got.collect() if r.event_id in "ad") == [("a", 2, "x.exe", "x -y"), ("d", 1, "z.exe", None)]


def test_story_scores():
    rule = lambda i, score, t=None: (f"rule:{i}", score, i, t)
    assert not T.story_score([rule(i, 40.0) for i in range(1)] + [("ml:a", 30.0, 1, None)] * 4)["fires"]
    assert T.story_score([("ml:a", 500.0, 1, None)])["score"] == 40
    state, fired = {}, []
    for us, source, score in ((0, "rule:a", 70.0), (1, "ml:m", 100.0), (2, "rule:b", 90.0), (3, "rule:c", 90.0)):
        state, made = T.story(state, us, source, "x", score, "Execution")
        fired.append(made is not None)
    assert sum(fired) == 1
    chain = T.story_score([rule(0, 1.0, "Execution"), rule(1, 1.0, "Persistence"), rule(2, 1.0, "Command and Control")])
    assert chain["run"] == 3 and chain["fires"]


def test_chain_run(spark):
    table = {("Execution", "Persistence", "Command and Control"): 3, ("Impact", "Execution", "Discovery"): 2, (): 0, ("nothing", "Impact"): 1, ("Discovery", "Discovery"): 1}
    df = spark.createDataFrame([(i, list(k)) for i, k in enumerate(table)], "i int, t array<string>").orderBy("i")
    assert [r[0] for r in df.select(T.chain_run(F.col("t"))).collect()] == list(table.values())


def tag(us, rule, actor, level, tactic, scope=()):
    return {"us": us, "event_id": us, "rule_id": rule, "actor": actor, "level": level, "tactic": tactic, "scope": list(scope)}


def test_incidents_open_grow_and_merge():
    state, made = {}, []
    for t in (
        tag(1, "a", "p1", 8, "Execution"),
        tag(2, "b", "p2", 12, "Impact"),  # nothing else in scope
        tag(3, "b", "p3", 12, "Impact", ["p1"]),  # opens with p1
        tag(4, "b", "p3", 12, "Impact", ["p1"]),  # quiet
        tag(5, "c", "p3", 8, "Persistence"),  # a new tactic
        tag(6, "d", "q1", 8, "Discovery"),
        tag(7, "e", "q1", 12, "Exfiltration"),  # opens another
        tag(8, "f", "p1", 12, "Collection", ["q1"]),  # joins both
    ):
        state, out = T.incident(state, t)
        made.append(out)
    assert [m is not None for m in made] == [False, False, True, False, True, False, True, True]
    assert made[2]["root"] == "p1" and made[4]["revision"] == 2 and made[7]["merged"] == 1 and made[7]["incident_id"] == made[2]["incident_id"]
    assert len(state["incidents"]) == 1 and made[7]["tactics"] == 6
    assert T.band(T.incident_score([16], 5)) == "critical" and T.band(T.incident_score([10], 2)) == "medium"


def test_sequences_complete_and_open_at_once():
    state, hit = S.sequence([], 0, [0], 2, 100, "p")
    state, hit = S.sequence(state, 5, [0, 1], 2, 100, "p")
    assert hit and state == [(5, 5, 1, "p")]
    state, hit = S.sequence(state, 6, [0], 2, 100, "p")
    assert not hit and len(state) == 1
    assert len(S.sequence(state, 7, [0], 2, 100, "q")[0]) == 2


def test_features(spark):
    rows = [("powershell.exe -nop -w hidden -enc " + "QQBB" * 10, "C:\\Users\\a\\AppData\\Local\\Temp\\svchost.exe", "svchost.exe", "winword.exe"), (None, None, None, None), ("", "", "report.pdf.exe", "")]
    df = spark.createDataFrame(rows, "c string, e string, n string, p string")
    got = [r.features for r in X.with_features(df, F.col("c"), F.col("e"), F.col("n"), F.col("p")).collect()]
    first = got[0]
    assert {"ind_ps_encoded", "ind_ps_noprofile", "ind_ps_hidden_window", "path_masquerade", "bin=svchost.exe", "parent_bin=winword.exe", "role=service_host", "pair=office>service_host", "path_class=temp"} <= set(first)
    assert first["name_length"] == 7
    assert set(got[1]) == {"cmd_missing", "name_missing", "parent_missing", "path_class=none", "bin=other", "parent_bin=missing", "role=missing", "parent_role=missing", "pair=missing>missing"}
    assert got[2]["name_double_extension"] == 1
    assert len(X.names()) == len(set(X.names())) == 540 and all(set(g) <= set(X.names()) for g in got)


def test_rules_of_all_types_over_wire_events(spark, tmp_path):
    from emberline.operators import detectors
    from emberline.plans import fields
    from emberline.plans import rules as R
    from emberline.sources import telemetry

    (tmp_path / "rules").mkdir()
    docs = {
        "single": "id: S\nevent_type: process_access\nlevel: 12\nlogic:\n  all:\n    - {field: target.name, operator: equals, value: LSASS.exe}\n    - {field: process_access.can_read_memory, operator: equals, value: true}\n    - {field: process.command_line, operator: contains, value: whoami}\n",
        "dropped": "id: D\nevent_type: process_create\nlogic:\n  all:\n    - {field: process.image_writer_name, operator: equals, value: winword.exe}\n    - {field: process.image_age_seconds, operator: less_than, value: 60}\n    - {field: unknown.field, operator: exists, value: false}\n",
        "count": "id: V\ntype: value_count\nby: parent\nevent_type: process_create\nfield: process.name\ncount: 3\nwindow: 60s\nlogic:\n  all:\n    - {field: process.name, operator: ends_with, value: .exe}\n",
        "threshold": "id: T\ntype: threshold\nby: process\nevent_type: file_rename\ncount: 3\nwindow: 30s\nlogic:\n  all:\n    - {field: file.extension_changed, operator: equals, value: true}\n",
        "sequence": "id: Q\ntype: sequence\nby: process_tree\nmaxspan: 5m\nsteps:\n  - event_type: file_create\n    logic: {all: [{field: file.path_class, operator: equals, value: temp}]}\n  - event_type: registry_write\n    logic: {any: [{field: registry.key_path, operator: contains, value: '\\Run'}]}\n",
    }
    for name, text in docs.items():
        (tmp_path / "rules" / f"{name}.yaml").write_text(text)
    rules = R.load(str(tmp_path / "rules"))
    assert len(rules) == 5 and not [p for r in rules for p in R.problems(r)]
    lines = []

    def event(t, category, kind, pid, image, parent=(None, None), **more):
        lines.append(json.dumps({"event": {"id": f"e{t}", "category": category, "type": kind, "timestamp": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"}, "host": {"id": "H"}, "process": {"pid": pid, "executable": image, "command_line": more.pop("cmd", None), "parent": {"pid": parent[0], "executable": parent[1]}}, **more}))

    event(1, "process", "start", 10, "C:\\o\\winword.exe", (4, "C:\\Windows\\explorer.exe"))
    event(2, "file", "create", 10, "C:\\o\\winword.exe", file={"path": "C:\\Temp\\a.exe"})
    event(3, "process", "start", 11, "C:\\Temp\\A.exe", (10, "C:\\o\\winword.exe"))
    event(4, "registry", "set_value", 11, "C:\\Temp\\a.exe", registry={"key": "HKCU\\CurrentVersion\\Run"})
    event(5, "process", "start", 12, "C:\\w\\net.exe", (11, "C:\\Temp\\a.exe"))
    event(6, "process", "start", 13, "C:\\w\\whoami.exe", (11, "C:\\Temp\\a.exe"))
    event(7, "process", "start", 14, "C:\\w\\arp.exe", (11, "C:\\Temp\\a.exe"))
    event(8, "process_access", "access", 11, "C:\\Temp\\a.exe", cmd="w^hoami", process_access={"target": {"pid": 1, "executable": "C:\\w\\lsass.exe"}, "granted_access": "0x1410"})
    for t in (9, 10, 39):
        event(t, "file", "rename", 11, "C:\\Temp\\a.exe", file={"operation": "rename", "path": "C:\\d\\x.locked", "previous_path": "C:\\d\\x.doc"})
    (tmp_path / "e.ndjson").write_text("\n".join(lines))
    events = fields.derive(telemetry.canonical(telemetry.ndjson(spark, str(tmp_path / "e.ndjson"))), rules)
    assert events.count() == len(lines)
    assert sorted((r.rule_id, r.event_id) for r in R.scan(events, rules).select("rule_id", "event_id").collect()) == [("D", "e3"), ("S", "e8")]
    fired = sorted((r.rule_id, r.event_id) for rule in rules if rule.type != "single" for r in detectors.detect(events, rule).collect())
    assert fired == [("Q", "e4"), ("T", "e39"), ("V", "e7")]
    tree = {r.event_id: (r.tree_root, r.tree_root_name) for r in events.select("event_id", "tree_root", "tree_root_name").collect()}
    assert tree["e7"] == (10, "winword.exe") and tree["e1"] == (10, "winword.exe")
