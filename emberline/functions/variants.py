"""Rewritten command lines to test models with, the context vector of a process, tokens, and a score by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.functions import features as X

#: Kinds of rewriting: random ones draw from a hash of the row and the place, so a task that runs again writes the same.
KINDS = ("caret", "case", "envvar", "whitespace", "argswap", "renamed_binary", "quote_split", "envvar_substring", "short_path", "unicode_dash", "flag_prefix", "renamed_copy")
#: Binaries that the score by hand knows.
LIVING_OFF = (
    "certutil.exe", "bitsadmin.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "msbuild.exe", "installutil.exe", "regasm.exe", "regsvcs.exe", "cmstp.exe", "wmic.exe", "msiexec.exe", "odbcconf.exe", "forfiles.exe", "pcalua.exe",
    "schtasks.exe", "at.exe", "sc.exe", "reg.exe", "vssadmin.exe", "wbadmin.exe", "bcdedit.exe", "netsh.exe", "esentutl.exe", "expand.exe", "extrac32.exe", "hh.exe", "ieexec.exe", "infdefaultinstall.exe", "makecab.exe",
    "presentationhost.exe", "syncappvpublishingserver.exe", "control.exe", "csc.exe", "atbroker.exe", "mavinject.exe", "createdump.exe", "procdump.exe", "ntdsutil.exe", "nltest.exe", "dsquery.exe", "adfind.exe",
)


def _drawn(key: Column, place: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(key, place), F.lit(1_000_000)) < int(share * 1_000_000)


def _letters(command: Column, write) -> Column:
    chars = F.filter(F.split(command, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, write), "")


def _replaced(text: Column, old: Column, new: str) -> Column:
    """Every place of a text in any case."""
    quoted = F.concat(F.lit(r"(?i)\Q"), old, F.lit(r"\E"))
    return F.when((old != "") & old.isNotNull(), F.regexp_replace(text, quoted, F.lit(new))).otherwise(text)


def _injected(command: Column, name: Column, insert: str) -> Column:
    """A text put behind the second letter of the program's name, or else of the first long word."""
    stem = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.exe$", ""))
    word = F.when((F.length(stem) >= 4) & F.contains(F.lower(command), stem), stem).otherwise(F.regexp_extract(command, "([A-Za-z]{4,})", 1))
    at = F.when(word == "", 0).otherwise(F.call_function("locate", F.lower(word), F.lower(command)))
    return F.when(at > 0, F.concat(F.substr(command, F.lit(1), at + 1), F.lit(insert), F.substr(command, at + 2))).otherwise(command)


def mutated(command: Column, name: Column, key: Column, kind: str) -> Column:
    """A command line as an attacker might write it instead."""
    cmd = F.coalesce(command, F.lit(""))
    match kind:
        case "caret":
            return _letters(cmd, lambda c, i: F.concat(c, F.when(c.rlike("[A-Za-z]") & _drawn(key, i, 0.3), "^").otherwise("")))
        case "case":
            return _letters(cmd, lambda c, i: F.when(_drawn(key, i, 0.5), F.upper(c)).otherwise(F.lower(c)))
        case "envvar":
            return F.replace(F.replace(cmd, F.lit("C:\\Windows"), F.lit("%SystemRoot%")), F.lit("c:\\windows"), F.lit("%SystemRoot%"))
        case "whitespace":
            return F.replace(cmd, F.lit(" "), F.lit("  "))
        case "argswap":
            parts = F.split(cmd, " ")
            swapped = F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), F.array(F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))))
            return F.when(F.size(parts) > 2, F.array_join(swapped, " ")).otherwise(cmd)
        case "renamed_binary":
            return F.when(F.coalesce(name, F.lit("")) != "", F.replace(cmd, name, F.lit("updater.exe"))).otherwise(cmd)
        case "renamed_copy":
            return _replaced(cmd, name, "updater.exe")
        case "quote_split":
            return _injected(cmd, name, '""')
        case "envvar_substring":
            return _injected(cmd, name, "%LOCALAPPDATA:~0,0%")
        case "short_path":
            out = F.regexp_replace(F.regexp_replace(cmd, r"(?i)c:\\program files \(x86\)", r"C:\\PROGRA~2"), r"(?i)c:\\program files", r"C:\\PROGRA~1")
            return F.regexp_replace(out, r"(?i)(c:\\users\\)([^\\\s\"']{1,6})[^\\\s\"']*", "$1$2~1")
        case "unicode_dash":
            return F.regexp_replace(cmd, r"(\s)-(?=[A-Za-z])", "$1–")
        case "flag_prefix":
            out = F.regexp_replace(cmd, r"(?i)(\s)[-/](?:e|ec|enc|encodedcommand)(\s)", "$1-encodedcomm$2")
            out = F.regexp_replace(out, r"(?i)(\s)[-/]nop(?:rofile)?\b", "$1-noprof")
            out = F.regexp_replace(out, r"(?i)(\s)[-/]w(?:indowstyle)?(\s+h)", "$1-windowst$2")
            return F.regexp_replace(out, r"(?i)(\s)[-/](?:ep|ex|exec|executionpolicy)(\s+bypass)", "$1-executionp$2")
    raise ValueError(kind)


def by_hand(df: DataFrame, command: Column, executable: Column, name: Column, parent: Column, column: str = "score") -> DataFrame:
    """Adds an additive score of a process start: what models are held against."""
    text = F.lower(F.coalesce(command, F.lit("")))
    own, above = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(parent, F.lit("")))
    flags = {"encoded": r"\s[-/](?:e|ec|enc|encodedcommand)\s", "hidden": r"\s[-/]w(?:indowstyle)?\s+h", "bypass": r"bypass", "url": r"https?://", "base64": r"[a-z0-9+/]{40,}={0,2}"}
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    score = one(own.isin(*LIVING_OFF)) + one(own.isin("powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe")) + one(above.isin("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe"))
    for pattern in flags.values():
        score = score + one(text.rlike(pattern))
    return df.withColumn(column, score + 0.5 * one(F.contains(text, F.lit("\\temp\\")) | F.contains(text, F.lit("\\appdata\\"))))


def tokens(command: Column, executable: Column) -> Column:
    """Distinct tokens of a start, sorted: c: words and pairs of the command line, p: words of the path."""
    pattern = F.lit(r"([a-z0-9_.$<>-]+)")
    words, path = F.regexp_extract_all(C.normalized_text(command), pattern, 1), F.regexp_extract_all(C.normalized_text(executable), pattern, 1)
    n = F.greatest(F.size(words) - 1, F.lit(1))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(F.lit("c:"), a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("c:"), w)), pairs, F.transform(path, lambda w: F.concat(F.lit("p:"), w)))))


#: Behaviour bits by the family of events that shows them.
GROUPS = {
    "network": ("network:public_destination", "network:public_nonstandard_port"), "image_load": ("image_load:user_path_module", "image_load:unsigned_module"), "file": ("file:executable_to_user_path",), "registry": ("registry:persistence_key",),
    "process_access": ("process_access:lsass_read",), "remote_thread": ("remote_thread:out", "remote_thread:in"), "dns": ("dns:failed_query",), "script_block": ("script_block:obfuscated",),
}


def context_vector(record: dict[str, Column], collected: Column, elapsed: Column | None = None) -> Column:
    """A map of context features of a process: lineage, children and each family's bits; NaN where a family is not collected on its host.

    record: ancestor_names, depth, behavior_bits, behavior_bit_objects, child_count, image_writer_name, image_age_seconds. Zeros are left out.
    """
    names, marks, objects = F.coalesce(record["ancestor_names"], F.array().cast("array<string>")), record["behavior_bits"], record["behavior_bit_objects"]
    entry = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("key"), F.round(v.cast("double"), 6).alias("value"))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    has = lambda b: one(F.array_contains(marks, b))
    count = lambda b: F.coalesce(F.try_element_at(F.filter(objects, lambda x: x["bit"] == b), F.lit(1))["objects"], F.lit(0))
    out = []
    for i in range(1, 5):
        out.append(entry(F.concat(F.lit(f"anc{i}_role="), X.role(F.lower(F.try_element_at(names, F.lit(i))))), F.lit(1.0)))
    out.append(entry("depth", F.least(record["depth"], F.lit(10))))
    roles = F.transform(names, lambda n: X.role(F.lower(n)))
    out += [entry(f"descends_from_role={r}", one(F.array_contains(roles, r))) for r in ("office", "browser", "script_host", "server_app")]
    out += [entry(f"descends_from={b}", one(F.array_contains(F.transform(names, lambda n: F.lower(n)), b))) for b in ("wmiprvse.exe", "psexesvc.exe", "services.exe")]
    child = "child:shell_or_lolbin"
    out += [entry(child, has(child)), entry(f"{child}_objects", count(child)), entry("child_count_log", F.log1p(F.least(record["child_count"], F.lit(50))))]
    if elapsed is not None:
        out.append(entry("elapsed_log", F.log1p(F.greatest(elapsed, F.lit(0.0)))))
    for family, bits in GROUPS.items():
        there = F.array_contains(collected, family)
        known = lambda v, there=there: F.when(there, v).otherwise(F.lit(float("nan")))
        for b in bits:
            out += [entry(b, known(has(b))), entry(f"{b}_objects", known(count(b).cast("double")))]
        if family == "file":
            writer = record["image_writer_name"]
            role = F.when(writer.isNull(), "none").otherwise(X.role(F.lower(writer)))
            out += [entry(f"image_writer_role={r}", known(one(role == r))) for r in (*X.ROLES, "other", "missing", "none")]
            out.append(entry("image_age_log", known(F.coalesce(F.log1p(F.greatest(record["image_age_seconds"], F.lit(0.0))), F.lit(0.0)))))
    return F.map_from_entries(F.filter(F.array(*out), lambda e: F.isnan(e["value"]) | (e["value"] != 0)))
