"""Truth tables, ordered kernels and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators import stateful as S
from emberline.plans import rules as R
from emberline.sources import telemetry
from emberline.streaming import pipeline


def values(spark, fn, inputs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").orderBy("i").select(fn(F.col("x"))).collect()]


def test_path_class(spark):
    table = {r"C:\Users\a\AppData\Local\Temp\x.exe": "temp", r"C:\ProgramData\x\y.exe": "user_writable", r"C:\Program Files\App\app.exe": "program_files", r"C:\Windows\System32\cmd.exe": "system", "/tmp/.x/implant": "temp", "/usr/bin/curl": "system", r"D:\tools\x.exe": "other", "powershell.exe": "unknown", None: None}
    assert values(spark, C.path_class, list(table)) == list(table.values())


def test_destination_scope(spark):
    table = {"93.184.216.34": "public", "203.0.113.10": "public", "10.1.2.3": "private", "192.168.1.1": "private", "127.0.0.1": "loopback", "169.254.10.1": "link_local", "224.0.0.251": "multicast", "not-an-ip": "unknown", "": None}
    assert values(spark, C.destination_scope, list(table)) == list(table.values())


def test_commands(spark):
    assert values(spark, C.plain_command, ["c^md.exe", "power`shell", "'down' + 'x'+'load'"]) == ["cmd.exe", "powershell", "'downxload'"]
    assert values(spark, C.is_generated_domain, ["google.com", "xkjqw1987znvcb.biz", None]) == [False, True, False]


@pytest.mark.parametrize(("text", "want"), [(90, 90), ("90s", 90), ("5m", 300), ("1h", 3600)])
def test_durations(text, want):
    assert R.seconds(text) == want


def test_bad_rules():
    with pytest.raises(ValueError):
        R.seconds("soon")
    assert R.problems(R.Rule("x", "process_create", {}))
    assert R.problems(R.Rule("x", "process_create", {"all": [{"field": "a", "operator": "in", "value": "b"}]}))
    assert R.spliced({"value": ["$a", "c"]}, {"a": ["x", "y"]}) == {"value": ["x", "y", "c"]}


def test_load(tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "tools.yaml").write_text("tools: [whoami.exe, net.exe]\n")
    (tmp_path / "a.yaml").write_text("id: A\nevent_type: process_create\ntype: value_count\nby: parent\ncount: 3\nwindow: 60s\nlogic:\n  all:\n    - {field: process_name, operator: in, value: $tools}\n")
    (tmp_path / "b.yaml").write_text("id: B\nstatus: disabled\nlogic: {}\n")
    (rule,) = R.load(str(tmp_path))
    assert rule.window == 60 and rule.by == ["parent"] and rule.logic["all"][0]["value"] == ["whoami.exe", "net.exe"]


def test_missing_fields_never_match(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "event_id int, f string")
    for op in ("not_equals", "not_contains"):
        assert [r[0] for r in df.where(R.condition({"field": "f", "operator": op, "value": "b"})).collect()] == [2]
    assert [r[0] for r in df.where(R.condition({"none": [{"field": "f", "operator": "equals", "value": "a"}]})).collect()] == [1]


def test_threshold_clears():
    state, fired = [], []
    for t in (0, 10, 20, 30, 60, 61):
        state, hit = S.threshold(state, t, 30, 3)
        fired.append(hit)
    assert fired == [False, False, True, False, False, False]


def test_sequence():
    def run(events, span=100):
        state, out = [], []
        for t, steps in events:
            state, hit = S.sequence(state, t, steps, 3, span)
            out.append(hit)
        return out

    assert run([(0, [0]), (5, [1]), (9, [2])]) == [False, False, True]
    assert run([(0, [0]), (5, [2]), (9, [1])]) == [False, False, False]
    assert run([(0, [0]), (5, [1]), (101, [2])]) == [False, False, False]


def test_dedup_window_is_from_the_first():
    last, out = None, []
    for t in (0, 500, 599, 600, 50):
        last, passed = S.dedup(last, t, 600)
        out.append(passed)
    assert out == [True, False, False, True, True]


@pytest.mark.parametrize(("jitter", "most", "least"), [(0.1, 1.0, 1.0), (None, 0.1, 0.0)])
def test_beacon(jitter, most, least):
    random.seed(7)
    found = 0
    for _ in range(100):
        t, state, hit = 0, {}, False
        for _ in range(20):
            t += int((60 * (1 + random.uniform(-jitter, jitter)) if jitter else random.expovariate(1 / 60)) * S.SECOND)
            state, got = S.beacon(state, t)
            hit |= got is not None
        found += hit
    assert least <= found / 100 <= most


def test_risk_meter_latches():
    state, out = {}, []
    for t, rule, level in ((0, "a", 14), (1, "b", 12), (2, "b", 12), (3, "c", 12)):
        state, fired = S.risk(state, t * S.SECOND, rule, level)
        out.append(fired)
    assert out == [False, True, False, False]


def test_stream_writes_each_alert_once(spark, tmp_path):
    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    event = lambda i, name: json.dumps({"event": {"id": f"e{i}", "category": "process", "type": "start", "timestamp": f"2024-01-01T00:00:{i:02d}Z"}, "host": {"id": "H"}, "process": {"pid": i, "executable": f"C:\\x\\{name}"}})
    rules = [R.Rule("A", "process_create", {"all": [{"field": "process_name", "operator": "equals", "value": "WHOAMI.exe"}]})]
    (source / "1.ndjson").write_text("# comment\n\n{bad\n" + event(1, "whoami.exe") + "\n" + event(2, "calc.exe") + "\n" + event(1, "whoami.exe") + "\n")
    for more in (None, event(3, "whoami.exe")):
        if more:
            (source / "2.ndjson").write_text(more + "\n")
        pipeline.run(spark, str(source), rules, str(out), str(mark)).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(out)).collect()) == ["e1", "e3"]
    batch = pipeline.alerts(telemetry.canonical(telemetry.ndjson(spark, str(source))), rules)
    pipeline.deliver(batch, str(out))
    assert spark.read.parquet(str(out)).count() == 2
