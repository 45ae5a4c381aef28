"""Rules over many events: threshold, value count and sequence, each one ordered fold over the events that meet its conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators import stateful as S
from emberline.plans.rules import Rule, condition

OUT = "rule_id string, event_id string, host_id string, us long, key string, level long, tactic string"


def key_of(rule: Rule) -> Column:
    """What a rule keeps apart: the host and each part of `by`; null if a part is."""
    named = {"host": "host_id", "process": "pid", "parent": "ppid", "process_tree": "tree_root", "user": "user"}
    parts = [F.concat(F.lit(f"{b}="), F.col(f"`{named.get(b, b)}`").cast("string")) for b in rule.by]
    return reduce(lambda a, b: F.concat(a, F.lit("|"), b), [F.col("host_id"), *parts])


def detect(events: DataFrame, rule: Rule) -> DataFrame:
    """rule_id, event_id, host_id, us, key, level and tactic of the events with which a rule fires. events: with the fields that it reads.

    Events that meet no condition, or have no key or time, are left out before the shuffle.
    """
    steps = rule.steps or [(rule.event_type, rule.logic)]
    met = F.array_compact(F.array(*[F.when((F.col("event_type") == t) & condition(logic), F.lit(i)) for i, (t, logic) in enumerate(steps)]))
    value = F.col(f"`{rule.value_field}`").cast("string") if rule.value_field else F.lit(None).cast("string")
    actor = F.concat_ws(":", "host_id", F.col("pid").cast("string"))
    rows = events.select("event_id", "host_id", F.unix_micros("ts").alias("us"), key_of(rule).alias("key"), met.alias("met"), value.alias("value"), actor.alias("actor")).where("size(met) > 0 and key is not null and us is not null")
    span, kind, count, n = int(rule.window * S.SECOND), rule.type, rule.count, len(steps)
    head = {"rule_id": rule.id, "level": rule.level, "tactic": rule.tactic}

    def step(state, row):
        if kind == "threshold":
            state, fired = S.threshold(state, row.us, span, count)
        elif kind == "value_count":
            state, fired = S.value_count(state, row.us, row.value, span, count)
        else:
            state, fired = S.sequence(state, row.us, list(row.met), n, span, row.actor)
        return state, {**head, "event_id": row.event_id, "host_id": row.host_id, "us": row.us, "key": row.key} if fired else None

    return S.folded(rows, ["key"], ["us", "event_id"], [], step, OUT)
