"""Ordered correlation: risk of storylines, and incidents that open, grow and merge. Kernels as in `stateful`; a key is folded in order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
HORIZON = 21_600_000_000
#: Tactics in the order of the kill chain.
TACTICS = ("reconnaissance", "resource development", "initial access", "execution", "persistence", "privilege escalation", "defense evasion", "credential access", "discovery", "lateral movement", "collection", "command and control", "exfiltration", "impact")
#: Tactics from which an incident is searched for.
TERMINAL = ("impact", "exfiltration", "commandandcontrol", "credentialaccess", "lateralmovement")
PHASE = {t: i for i, t in enumerate(TACTICS)}
#: Bands of scores, highest first.
BANDS = ((0.75, "critical"), (0.55, "high"), (0.0, "medium"))
RANK = {"medium": 0, "high": 1, "critical": 2}


def chain_run(tactics: Column) -> Column:
    """The longest strictly rising run of phases in an array of tactics that is in order of time."""
    phases = F.filter(F.transform(tactics, lambda t: F.array_position(F.array(*[F.lit(x) for x in TACTICS]), F.lower(t)).cast("int")), lambda p: p > 0)
    empty = F.array_repeat(F.lit(0), len(TACTICS))
    best = lambda a, p: F.coalesce(F.array_max(F.slice(a, F.lit(1), p - 1)), F.lit(0)) + 1
    longest = F.aggregate(phases, empty, lambda a, p: F.transform(a, lambda v, i: F.when(i + 1 == p, F.greatest(v, best(a, p))).otherwise(v)))
    return F.coalesce(F.array_max(longest), F.lit(0))


def _run(tactics: list[str]) -> int:
    best = [0] * len(TACTICS)
    for t in tactics:
        p = PHASE.get((t or "").lower())
        if p is not None:
            best[p] = max(best[p], 1 + max(best[:p], default=0))
    return max(best)


def _sum(scores: list[float]) -> float:
    top = max(scores, default=0.0)
    return top + 0.2 * (sum(scores) - top)


def story_score(events: list[tuple[str, float, int, str | None]], limit: float = 100.0) -> dict[str, Any]:
    """Score of (source, score, us, tactic): rules and a bonus for a chain of tactics; models and rarity add at most 40 % of the limit."""
    hard = [e for e in events if e[0].split(":")[0] not in ("ml", "rarity")]
    rules = _sum([e[1] for e in hard])
    soft = min(max(0.0, _sum([e[1] for e in events]) - rules), 0.4 * limit)
    run = _run([e[3] for e in sorted(hard, key=lambda e: e[2])])
    bonus = min(30.0, 10.0 * max(0, run - 1))
    total, tactics, sources = rules + soft + bonus, {e[3] for e in hard if e[3]}, {e[0] for e in hard}
    return {"score": round(total, 3), "run": run, "tactics": len(tactics), "sources": len(sources), "fires": total >= limit or (len(tactics) >= 3 and len(sources) >= 3)}


def story(state: dict[str, Any], us: int, source: str, target: str, score: float, tactic: str | None, window: int = DAY) -> tuple[dict[str, Any], dict[str, Any] | None]:
    """A storyline: the highest score of each source and object for a day; it fires once."""
    events = dict(state.get("events", {}))
    if (source, target) not in events or score > events[source, target][1]:
        events[source, target] = (source, score, us, tactic)
    events = {k: e for k, e in events.items() if e[2] >= us - window}
    state = state | {"events": events}
    if state.get("fired"):
        return state, None
    made = story_score(list(events.values()))
    return (state | {"fired": True}, made) if made["fires"] else (state, None)


def is_anchor(level: int, tactic: str | None, least: int = 10) -> bool:
    return level >= least and "".join(c for c in (tactic or "").lower() if c.isalnum()) in TERMINAL


def incident_score(levels: list[int], tactics: int, context: float = 0.0) -> float:
    return round(round(0.45 * min(max(levels, default=0) / 16, 1.0), 3) + round(0.30 * min(tactics, 5) / 5, 3) + round(min(context, 0.25), 3), 3)


def band(score: float) -> str:
    return next(name for least, name in BANDS if score >= least)


def incident(state: dict[str, Any], tag: dict[str, Any], horizon: int = HORIZON, keep: int = DAY) -> tuple[dict[str, Any], dict[str, Any] | None]:
    """A host's incidents and one more tagged detection: us, event_id, rule_id, actor, level, tactic, context and scope (processes).

    A scope that touches incidents joins them into the oldest. Else an anchor with two stages of two tactics opens one. What changes an
    incident materially (it is new, has a new tactic or a higher band) is emitted. What is idle for a day is forgotten.
    """
    us, scope = tag["us"], {*tag["scope"], tag["actor"]}
    tags = [t for t in state.get("tags", []) if t["us"] >= us - keep] + [tag]
    incidents = [i for i in state.get("incidents", []) if i["last"] >= us - keep]
    state = {"tags": tags, "incidents": incidents}
    touched = sorted((i for i in incidents if i["scope"] & scope), key=lambda i: (i["opened"], i["id"]))

    def stages(of: set[str], since: int, until: int) -> list[dict[str, Any]]:
        first: dict[tuple[str, str], dict[str, Any]] = {}
        for t in tags:
            at = (t["rule_id"], t["actor"])
            if t["actor"] in of and since <= t["us"] <= until and (at not in first or t["us"] < first[at]["us"]):
                first[at] = t
        return sorted(first.values(), key=lambda t: (t["us"], t["rule_id"], t["actor"]))

    if touched:
        own = {**touched[0]}
        for other in touched[1:]:
            own["scope"] = own["scope"] | other["scope"]
            own["opened"] = min(own["opened"], other["opened"])
        ids = {i["id"] for i in touched}
        state["incidents"] = [i for i in incidents if i["id"] not in ids]
    else:
        found = stages(scope, us - horizon, us)
        if not is_anchor(tag["level"], tag["tactic"]) or len(found) < 2 or len({t["tactic"] for t in found if t["tactic"]}) < 2:
            return state, None
        own = {"id": f"INC-{tag['event_id']}-{tag['rule_id']}", "opened": us, "last": us, "scope": set(), "revision": 0, "tactics": set(), "band": "medium", "quiet": 0}
    own["scope"], own["last"] = own["scope"] | scope, max(own["last"], us)
    found = stages(own["scope"], own["opened"] - horizon, own["last"])
    tactics = {t["tactic"] for t in found if t["tactic"]}
    score = incident_score([t["level"] for t in found], len(tactics), max((t.get("context") or 0.0 for t in found), default=0.0))
    now = band(score)
    material = own["revision"] == 0 or not tactics <= own["tactics"] or RANK[now] > RANK[own["band"]]
    if material:
        own |= {"revision": own["revision"] + 1, "tactics": tactics, "band": now}
    else:
        own["quiet"] += 1
    state["incidents"] = [*state["incidents"], own]
    if not material:
        return state, None
    return state, {"incident_id": own["id"], "revision": own["revision"], "score": score, "band": now, "stages": len(found), "tactics": len(tactics), "root": found[0]["actor"], "merged": len(touched) - 1 if len(touched) > 1 else 0}
