"""Rules: documents in YAML become columns, so that any number of rules is one projection of one scan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

OPERATORS = ("equals", "not_equals", "contains", "not_contains", "in", "not_in", "starts_with", "ends_with", "regex", "greater_than", "less_than", "cidr", "windash", "exists", "has_ancestor", "in_threat_intel", "entropy_greater_than")
#: Names of the command line, as a column and as a field of rules.
COMMANDS = ("command_line", "process.command_line")
KEYS = ("host", "process", "parent", "process_tree", "user")
#: What may stand in a rule's document, and names of the kinds of threat intelligence.
ENTRIES = ("id", "name", "description", "status", "event_type", "logic", "type", "level", "severity", "confidence", "mitre", "by", "count", "window", "maxspan", "evidence", "field", "steps", "active_response", "compliance", "tags", "author", "version", "date", "references", "false_positives")
HASH_KINDS, IP_KINDS = ("hash", "file_hash", "sha256", "md5"), ("ip", "ip_address", "c2")
NEGATED = ("not_equals", "not_contains", "not_in")


@dataclass
class Rule:
    id: str
    event_type: str
    logic: dict[str, Any]
    type: str = "single"
    level: int = 5
    tactic: str = ""
    technique: str = ""
    by: list[str] = field(default_factory=list)
    count: int = 1
    window: float = 0
    evidence: list[str] = field(default_factory=list)
    value_field: str = ""
    name: str = ""
    description: str = ""
    severity: str = "medium"
    confidence: float = 0.7
    active_response: str | None = None
    steps: list[tuple[str, dict[str, Any]]] = field(default_factory=list)


def seconds(text: str | float) -> float:
    """90, "90s", "5m", "1h" and "1d" in seconds; anything else is an error."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhd]?)", str(text).strip())
    if not m or float(m[1]) <= 0:
        raise ValueError(f"no duration: {text!r}")
    return float(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def spliced(node: Any, lists: dict[str, list]) -> Any:
    """Puts named lists ($name) in place, as whole values or within lists."""
    if isinstance(node, str) and node.startswith("$"):
        return lists[node[1:]]
    if isinstance(node, dict):
        return {k: spliced(v, lists) for k, v in node.items()}
    if isinstance(node, list):
        return [y for x in node for y in (spliced(x, lists) if isinstance(x, str) and x.startswith("$") else [spliced(x, lists)])]
    return node


def intel_flag(field_: str, kind: str) -> str:
    """Name of the column that says whether a field is known to threat intelligence; fields.derive() makes it."""
    return f"_intel:{'hash' if kind.lower() in HASH_KINDS else 'ip'}:{field_}"


def intel_read(rules: list[Rule]) -> set[tuple[str, str]]:
    """Fields, with their kind, that the rules look up in threat intelligence."""
    return {(n["field"], str(n.get("value")).lower()) for r in rules for n in leaves(r) if n["operator"] == "in_threat_intel" and str(n.get("value")).lower() in HASH_KINDS + IP_KINDS}


def leaves(rule: Rule) -> list[dict[str, Any]]:
    """All conditions of a rule."""
    out: list[dict[str, Any]] = []

    def walk(node: dict[str, Any]) -> None:
        if "operator" in node:
            out.append(node)
        for k in ("all", "any", "none"):
            for child in node.get(k) or ():
                walk(child)

    for _, logic in rule.steps or [(rule.event_type, rule.logic)]:
        walk(logic)
    return out


def all_problems(rules: list[Rule]) -> list[str]:
    """What is wrong with each rule, and ids that stand twice."""
    seen: set[str] = set()
    out = []
    for r in rules:
        if r.id in seen:
            out.append(f"{r.id}: the id stands twice")
        seen.add(r.id)
        out += problems(r)
    return out


def problems(rule: Rule) -> list[str]:
    """What is wrong with a rule, by its document alone."""
    out: list[str] = []

    def walk(node: dict[str, Any]) -> None:
        if "operator" in node:
            op, value = node["operator"], node.get("value")
            if op not in OPERATORS:
                out.append(f"{rule.id}: unknown operator {op}")
            if op in ("in", "not_in", "has_ancestor") and not isinstance(value, list):
                out.append(f"{rule.id}: {op} needs a list")
            if op == "exists" and not isinstance(value, bool):
                out.append(f"{rule.id}: exists needs true or false")
            if op == "regex":
                try:
                    re.compile(str(value))
                except re.error as x:
                    out.append(f"{rule.id}: {x}")
            if op == "cidr":
                for b in value if isinstance(value, list) else [value]:
                    try:
                        C.block(b)
                    except ValueError as x:
                        out.append(f"{rule.id}: {x}")
            if op == "in_threat_intel" and str(value).lower() not in HASH_KINDS + IP_KINDS:
                out.append(f"{rule.id}: unknown kind of threat intelligence {value!r}")
            return
        if not any(node.get(k) for k in ("all", "any", "none")):
            out.append(f"{rule.id}: empty block")
        for k in ("all", "any", "none"):
            for child in node.get(k) or ():
                walk(child)

    for _, logic in rule.steps or [(rule.event_type, rule.logic)]:
        walk(logic)
    if rule.type not in ("single", "threshold", "value_count", "sequence"):
        out.append(f"{rule.id}: unknown type {rule.type}")
    elif rule.type != "single" and not (rule.by and rule.window > 0):
        out.append(f"{rule.id}: {rule.type} needs a key and a window")
    out.extend(f"{rule.id}: no key {b!r}" for b in rule.by if b not in KEYS and not re.fullmatch(r"[a-z_]+(\.[a-z_]+)+|[a-z_]+", b))
    if not 0 <= rule.level <= 16:
        out.append(f"{rule.id}: a level is 0 to 16")
    if not 0 <= rule.confidence <= 1:
        out.append(f"{rule.id}: a confidence is 0 to 1")
    if rule.type == "sequence" and not 2 <= len(rule.steps) <= 8:
        out.append(f"{rule.id}: a sequence has 2 to 8 steps")
    if rule.type == "value_count" and not rule.value_field:
        out.append(f"{rule.id}: value_count needs a field")
    return out


def read_fields(rule: Rule) -> set[str]:
    """Fields that a rule reads."""
    found = {k for k in rule.by if k not in KEYS} | ({rule.value_field} if rule.value_field else set())

    def walk(node: dict[str, Any]) -> None:
        if "field" in node:
            found.add(node["field"])
        for k in ("all", "any", "none"):
            for child in node.get(k) or ():
                walk(child)

    for _, logic in rule.steps or [(rule.event_type, rule.logic)]:
        walk(logic)
    return found | {e for e in rule.evidence}


def load(folder: str) -> list[Rule]:
    """Enabled rules of a folder of YAML documents, in the order of their paths; named lists are in `lists`."""
    import yaml

    root = Path(folder)
    lists: dict[str, list] = {}
    for p in sorted((root / "lists").glob("*.y*ml")):
        got = yaml.safe_load(p.read_text())
        lists |= got if isinstance(got, dict) else {p.stem: got}
    out = []
    for p in sorted(root.rglob("*.y*ml")):
        if "lists" in p.relative_to(root).parts:
            continue
        d = spliced(yaml.safe_load(p.read_text()), lists)
        if d.get("status", "enabled") != "enabled":
            continue
        unknown = set(d) - set(ENTRIES)
        if unknown:
            raise ValueError(f"{p}: unknown entries {sorted(unknown)}")
        mitre, by = d.get("mitre") or {}, d.get("by") or []
        out.append(Rule(d["id"], d.get("event_type", ""), d.get("logic") or {}, d.get("type", "single"), d.get("level", 5), mitre.get("tactic", ""), mitre.get("technique", ""), [by] if isinstance(by, str) else by, d.get("count", 1), seconds(d.get("window", d.get("maxspan"))) if "window" in d or "maxspan" in d else 0, d.get("evidence") or [], d.get("field", ""), d.get("name", ""), d.get("description", ""), str(d.get("severity", "medium")), float(d.get("confidence", 0.7)), d.get("active_response"), [(x["event_type"], x.get("logic") or {}) for x in d.get("steps") or ()]))
    return out


def leaf(node: dict[str, Any], plain: Column | None = None) -> Column:
    """A condition. A field that is missing never matches, negated or not. plain: the deobfuscated command line, if there is such a column."""
    op, value, exact = node["operator"], node.get("value"), node.get("case_sensitive", False)
    col = F.col(f"`{node['field']}`")
    text = col.cast("string") if exact else F.lower(col.cast("string"))
    want = lambda v: str(v) if exact else str(v).lower()

    def same(v: Any) -> Column:
        if isinstance(v, bool):
            return col.cast("string") == str(v).lower()
        return text == want(v) if isinstance(v, str) else F.expr(f"try_cast(`{node['field']}` as double)") == float(v)

    def tested(text: Column, col: Column) -> Column:
        match op:
            case "equals":
                return same(value) if text is plain_text else text == want(value)
            case "not_equals":
                return ~same(value)
            case "contains":
                return F.contains(text, F.lit(want(value)))
            case "not_contains":
                return ~F.contains(text, F.lit(want(value)))
            case "in" | "not_in":
                found = reduce(lambda a, b: a | b, [same(v) for v in value]) if any(not isinstance(v, str) for v in value) else text.isin([want(v) for v in value])
                return found if op == "in" else ~found
            case "starts_with":
                return F.startswith(text, F.lit(want(value)))
            case "ends_with":
                return F.endswith(text, F.lit(want(value)))
            case "regex":
                return col.cast("string").rlike(("" if exact else "(?iU)") + value)
            case "greater_than" | "less_than":
                number = F.expr(f"try_cast(`{node['field']}` as double)")
                return number > float(value) if op == "greater_than" else number < float(value)
            case "cidr":
                return C.in_blocks(col.cast("string"), value if isinstance(value, list) else [value])
            case "windash":
                return col.cast("string").rlike(r"(?i)(?:^|\s)[-/]" + re.escape(str(value).lstrip("-/")) + r"(?:\s|$|:|=)")
            case "exists":
                return (col.isNotNull() & (col.cast("string") != "")) == value
            case "has_ancestor":
                return F.exists(F.col("ancestor_names"), lambda x: F.lower(x).isin([str(v).lower() for v in value]))
            case "in_threat_intel":
                return F.col(f"`{intel_flag(node['field'], str(value))}`") if str(value).lower() in HASH_KINDS + IP_KINDS else F.lit(False)
            case "entropy_greater_than":
                return F.round(C.entropy(col.cast("string")), 3) >= float(value)
        raise ValueError(op)

    plain_text = text
    out = F.coalesce(tested(text, col), F.lit(False)) if op != "exists" else F.coalesce(tested(text, col), F.lit(not value))
    if node["field"] in COMMANDS and op not in NEGATED + ("exists", "entropy_greater_than"):
        decoded = C.deobfuscated(col) if plain is None else plain
        again = decoded if exact else F.lower(decoded)
        out = out | F.coalesce((decoded != col) & tested(again, decoded), F.lit(False))
    return out


def condition(node: dict[str, Any], plain: Column | None = None, ready: dict[str, Column] | None = None) -> Column:
    """All of `all`, one of `any` and none of `none`. ready: conditions that are columns already, by key_of_leaf()."""
    if "operator" in node:
        return ready[key_of_leaf(node)] if ready else leaf(node, plain)
    parts = [condition(x, plain, ready) for x in node.get("all") or ()]
    if node.get("any"):
        parts.append(reduce(lambda a, b: a | b, [condition(x, plain, ready) for x in node["any"]]))
    parts += [~condition(x, plain, ready) for x in node.get("none") or ()]
    return reduce(lambda a, b: a & b, parts)


def key_of_leaf(node: dict[str, Any]) -> str:
    return json.dumps(node, sort_keys=True, default=str)


def shown(value: Any) -> str:
    """A rule's value as text; of a long list the first six."""
    return str([*value[:6], "..."] if isinstance(value, list) and len(value) > 6 else value)


def trace(node: dict[str, Any], ready: dict[str, Column] | None = None) -> Column:
    """Texts of the conditions that made a tree true: every one of `all`, the first true one of `any`."""
    said = lambda x: F.when(condition(x, None, ready), F.lit(f"{x['field']} {x['operator']} {shown(x.get('value'))}"[:160])) if "operator" in x else F.array_join(trace(x, ready), "; ")
    parts = [said(x) for x in node.get("all") or ()]
    if node.get("any"):
        parts.append(F.coalesce(*[F.when(condition(x, None, ready), said(x)) for x in node["any"]]))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def evidence(rule: Rule, columns: list[str]) -> Column:
    """The values of a rule's evidence fields that are there, as a map; a long text is cut."""
    there = [e for e in rule.evidence if e in columns]
    if not there:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(e) for e in there]), F.array(*[F.col(f"`{e}`").cast("string") for e in there])), lambda _, v: v.isNotNull())


def sound(events: DataFrame, rules: list[Rule], errors: dict[str, str] | None = None) -> list[Rule]:
    """The single-event rules that can be planned over these events; what is wrong with others goes to errors, by id, and stops no other rule."""
    out = []
    java = events.sparkSession._jvm.java.util.regex.Pattern
    for r in rules:
        if r.type != "single":
            continue
        try:
            for n in leaves(r):
                if n["operator"] == "regex":
                    java.compile(str(n["value"]))
            events.select(condition(r.logic).alias("c")).schema  # noqa: B018  plans, and runs nothing
        except Exception as x:  # noqa: BLE001  whatever a rule does wrong is its own
            if errors is not None:
                errors[r.id] = str(x).splitlines()[0]
            continue
        out.append(r)
    return out


def scan(events: DataFrame, rules: list[Rule], errors: dict[str, str] | None = None) -> DataFrame:
    """The events' columns and rule_id, level, tactic, matched and evidence: one row for each rule that an event meets, by one pass over the events.

    With errors, a rule that cannot be planned is left out and told there.
    """
    for name, kind in intel_read(rules):
        if intel_flag(name, kind) not in events.columns:  # nothing was looked up
            events = events.withColumn(intel_flag(name, kind), F.lit(False))
    if errors is not None:
        rules = sound(events, rules, errors)
    plain = None
    columns = [c for c in events.columns if not c.startswith("_intel:")]
    rules = [r for r in rules if r.type == "single"]
    command = next((c for c in COMMANDS if c in columns), None)
    if command:  # worked out once for all rules
        events, plain = events.withColumn("_plain", C.deobfuscated(F.col(f"`{command}`"))), F.col("_plain")
    # each distinct condition is one column, over which rules and traces are written
    distinct = {key_of_leaf(n): n for r in rules for n in leaves(r)}
    names = {k: f"_c{i}" for i, k in enumerate(distinct)}
    if distinct:
        events = events.withColumns({names[k]: leaf(n, plain) for k, n in distinct.items()})
    ready = {k: F.col(n) for k, n in names.items()}
    hits = [F.when((F.col("event_type") == r.event_type) & condition(r.logic, None, ready), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.level).alias("level"), F.lit(r.tactic).alias("tactic"), F.array_join(trace(r.logic, ready), " & ").alias("matched"), evidence(r, columns).alias("evidence"))) for r in rules]
    if not hits:
        return events.select(*[F.col(f"`{c}`") for c in columns], *[F.lit(None).cast(t).alias(c) for c, t in (("rule_id", "string"), ("level", "int"), ("tactic", "string"), ("matched", "string"), ("evidence", "map<string,string>"))]).where("false")
    # outer, and filtered behind: a filter in front, as the optimizer infers it of explode, works all rules out once more
    return events.select("*", F.explode_outer(F.array_compact(F.array(*hits))).alias("hit")).where("hit is not null").select(*[F.col(f"`{c}`") for c in columns], "hit.*")


def coverage(spark, rules: list[Rule]) -> DataFrame:
    """tactic, rules, techniques."""
    rows = spark.createDataFrame([(r.id, r.tactic, r.technique) for r in rules], "rule_id string, tactic string, technique string")
    return rows.groupBy("tactic").agg(F.count("*").alias("rules"), F.count_distinct("technique").alias("techniques"))
