"""What keeps a stream honest: a spool of alerts with retries and dead letters, measures and health, windows, and ordered rules on streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from emberline.functions.columns import retry_delay
from emberline.operators import stateful as S
from emberline.plans.rules import Rule

#: Columns of the spool.
SPOOL = "alert_id string, payload string, rule_id string, created_us long, status string, attempts int, next_attempt_us long, last_error string"


def spooled(alerts: DataFrame, spool: DataFrame, now: Column) -> DataFrame:
    """The spool with new alerts as pending; an id that is there already, whatever its state, changes nothing. A payload that is no JSON is dead at once."""
    fresh = alerts.dropDuplicates(["alert_id"]).where("alert_id is not null").join(spool.select("alert_id"), "alert_id", "left_anti")
    bad = F.try_parse_json("payload").isNull() if hasattr(F, "try_parse_json") else F.get_json_object("payload", "$").isNull()
    rows = fresh.select("alert_id", "payload", "rule_id", now.cast("long").alias("created_us"), F.when(bad, "dead").otherwise("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("next_attempt_us"), F.when(bad, "unparseable payload").alias("last_error"))
    return spool.unionByName(rows)


def attempted(spool: DataFrame, outcome: DataFrame, now: Column, most: int = 5, base: float = 1.0, longest: float = 300.0) -> DataFrame:
    """The spool after a round: outcome has alert_id and error (null: delivered). What failed waits longer each time, and is dead after `most` attempts; what was delivered keeps its row without a payload."""
    rows = spool.join(outcome.dropDuplicates(["alert_id"]).select("alert_id", "error", F.lit(True).alias("_tried")), "alert_id", "left")
    tried, failed = F.coalesce("_tried", F.lit(False)), F.col("error").isNotNull()
    n = F.col("attempts") + F.when(tried & failed, 1).otherwise(0)
    wait = (now + F.round(retry_delay(n, base, longest, F.col("alert_id")) * 1_000_000)).cast("long")
    status = F.when(~tried, F.col("status")).when(~failed, "delivered").when(n >= most, "dead").otherwise("pending")
    return rows.select(
        "alert_id", F.when(tried & ~failed, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "rule_id", "created_us", status.alias("status"), n.cast("int").alias("attempts"),
        F.when(~tried, F.col("next_attempt_us")).when(failed & (n < most), wait).alias("next_attempt_us"), F.when(~tried, F.col("last_error")).when(failed, F.substring("error", 1, 8192)).alias("last_error"),
    )


def requeued(spool: DataFrame, ids: list[str]) -> DataFrame:
    """The spool with dead alerts of these ids as new ones."""
    again = F.col("alert_id").isin(ids) & (F.col("status") == "dead")
    made = {"status": F.lit("pending"), "attempts": F.lit(0), "next_attempt_us": F.lit(None).cast("long"), "last_error": F.lit(None).cast("string")}
    return spool.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in made.items()})


def spool_stats(spool: DataFrame, now: Column) -> DataFrame:
    """pending_ready, pending_retry, delivered, dead and total."""
    pending, due = F.col("status") == "pending", F.col("next_attempt_us").isNull() | (F.col("next_attempt_us") <= now)
    return spool.agg(F.count_if(pending & due).alias("pending_ready"), F.count_if(pending & ~due).alias("pending_retry"), F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("status") == "dead").alias("dead"), F.count("*").alias("total"))


def dead_letters(spool: DataFrame) -> DataFrame:
    """Alerts that will not be tried again, with what went wrong."""
    return spool.where("status = 'dead'").select("alert_id", "rule_id", "payload", "attempts", "last_error")


# ---- measures and health


class Watch(StreamingQueryListener):
    """Counts what streaming queries do; callbacks get each progress and each failure."""

    def __init__(self, on_progress: Callable[[dict[str, Any]], None] | None = None, on_error: Callable[[str], None] | None = None) -> None:
        self.on_progress, self.on_error = on_progress, on_error
        self.counters = {"batches": 0, "events_received": 0, "rows_written": 0, "rows_dropped_late": 0, "failures": 0}
        self.latencies: list[float] = []
        self.state, self.last_error = "idle", None

    def onQueryStarted(self, event) -> None:  # noqa: N802  the names of the interface
        self.state = "streaming"

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        self.counters["batches"] += 1
        self.counters["events_received"] += p.get("numInputRows", 0)
        self.counters["rows_written"] += max(0, (p.get("sink") or {}).get("numOutputRows", 0))
        self.counters["rows_dropped_late"] += sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", ()))
        self.latencies = [*self.latencies, (p.get("durationMs") or {}).get("triggerExecution", 0) / 1000][-1024:]
        if self.on_progress:
            self.on_progress(p)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.state = "idle"

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.state = "stopped"
        if event.exception:
            self.counters["failures"] += 1
            self.last_error = str(event.exception)[:2000]
            if self.on_error:
                self.on_error(self.last_error)

    def percentile(self, share: float) -> float:
        held = sorted(self.latencies)
        return held[min(len(held) - 1, max(0, round(share * (len(held) - 1))))] if held else 0.0

    def prometheus(self, prefix: str = "emberline") -> str:
        lines = [x for k, v in self.counters.items() for x in (f"# TYPE {prefix}_{k}_total counter", f"{prefix}_{k}_total {v}")]
        lines += [f"# TYPE {prefix}_batch_seconds summary", *(f'{prefix}_batch_seconds{{quantile="{q}"}} {self.percentile(q)}' for q in (0.5, 0.95)), f"{prefix}_batch_seconds_count {len(self.latencies)}"]
        return "\n".join(lines) + "\n"

    def health(self, spool: dict[str, int] | None = None) -> dict[str, Any]:
        return {"status": "stopped" if self.state == "stopped" else "running", "ingestion_state": self.state, "last_error": self.last_error, "counters": dict(self.counters), "spool": spool}


def replace_file(path: str, text: str) -> None:
    """Writes a file so that a reader sees the old or the new one, never a part."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    part = out.with_name(out.name + ".part")
    part.write_text(text)
    part.replace(out)


def admitted(events: DataFrame, policy: str, most: int, batch: Column) -> tuple[DataFrame, DataFrame]:
    """What a bounded queue lets through of each batch, and how many it drops: block lets all through, drop_newest keeps the first `most`, drop_oldest the last."""
    if policy == "block":
        return events, events.where("false").groupBy(batch.alias("batch")).agg(F.count("*").alias("dropped"))
    from pyspark.sql import Window

    order = F.asc("us") if policy == "drop_newest" else F.desc("us")
    placed = events.withColumn("_b", batch).withColumn("_p", F.row_number().over(Window.partitionBy("_b").orderBy(order, "event_id")))
    return placed.where(F.col("_p") <= most).drop("_b", "_p"), placed.where(F.col("_p") > most).groupBy(F.col("_b").alias("batch")).agg(F.count("*").alias("dropped"))


# ---- windows


def activity(events: DataFrame, width: str = "10 minutes", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """start, host_id, event_type, n: counts in tumbling or sliding windows; on a stream with the lateness that is waited for."""
    rows = events.withWatermark("ts", delay) if delay else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "host_id", "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "host_id", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """start, end, host_id, n: runs of a host's events without a longer gap."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "host_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "host_id", "n")


# ---- ordered rules on streams


def detect(events: DataFrame, rule: Rule, delay: str = "10 minutes", idle: int = 86_400_000) -> DataFrame:
    """rule_id, event_id, host_id, us and key of the events with which a rule over many events fires, on a stream.

    The kernels are those of the batch path. A batch's events of a key are folded in order of time; state that is idle for `idle` ms of event time goes.
    """
    from emberline.operators.detectors import key_of
    from emberline.plans.rules import condition

    steps = rule.steps or [(rule.event_type, rule.logic)]
    met = F.array_compact(F.array(*[F.when((F.col("event_type") == t) & condition(logic), F.lit(i)) for i, (t, logic) in enumerate(steps)]))
    value = F.col(f"`{rule.value_field}`").cast("string") if rule.value_field else F.lit(None).cast("string")
    rows = events.withWatermark("ts", delay).select("ts", F.col("event_id").cast("string").alias("event_id"), "host_id", F.unix_micros("ts").alias("us"), key_of(rule).alias("key"), met.alias("met"), value.alias("value")).where("size(met) > 0 and key is not null and us is not null")
    span, kind, count, n, rule_id = int(rule.window * S.SECOND), rule.type, rule.count, len(steps), rule.id

    def fold(key: tuple[str], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(frames)).sort_values(["us", "event_id"]).itertuples(index=False):
            us = int(row.us)
            if kind == "threshold":
                held, fired = S.threshold(held, us, span, count)
            elif kind == "value_count":
                held, fired = S.value_count([tuple(x) for x in held], us, row.value, span, count)
            else:
                held, fired = S.sequence([tuple(x) for x in held], us, [int(x) for x in row.met], n, span)
            if fired:
                out.append((rule_id, row.event_id, row.host_id, us, key[0]))
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(us // 1000, state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame(out, columns=["rule_id", "event_id", "host_id", "us", "key"])

    return rows.groupBy("key").applyInPandasWithState(fold, "rule_id string, event_id string, host_id string, us long, key string", "held string", "append", "EventTimeTimeout")


def live(command: list[str], landing: str, lines_a_file: int = 1_000, most_events: int | None = None, seconds: float | None = None) -> int:
    """Runs a program that writes wire events to its output and lands them as files that a stream reads; ends with the program, or after so many events or seconds."""
    import subprocess
    import threading
    import time

    folder = Path(landing)
    folder.mkdir(parents=True, exist_ok=True)
    process = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)
    threading.Thread(target=process.stderr.read, daemon=True).start()  # a full pipe would stop the program
    timer = threading.Timer(seconds, process.terminate) if seconds else None
    if timer:
        timer.start()
    held: list[str] = []
    count = 0

    def land() -> None:
        if held:
            replace_file(str(folder / f"events-{time.time_ns()}.ndjson"), "".join(held))
            held.clear()

    try:
        for line in process.stdout:
            if line.strip():
                held.append(line)
                count += 1
            if len(held) >= lines_a_file:
                land()
            if most_events and count >= most_events:
                break
    finally:
        land()
        if timer:
            timer.cancel()
        process.terminate()
        try:
            process.wait(5)
        except subprocess.TimeoutExpired:
            process.kill()
    return count
