"""Scalar functions as columns: all stay in the JVM."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of path classes, in the order in which they are tried.
PATH_MARKERS = {
    "temp": ("/temp/", "/tmp/", "/var/tmp/", "/dev/shm/"),
    "user_writable": ("/users/", "/appdata/", "/programdata/", "/home/", "/downloads/"),
    "program_files": ("/program files/", "/program files (x86)/", "/opt/"),
    "system": ("/windows/system32/", "/windows/syswow64/", "/windows/", "/usr/bin/", "/usr/sbin/", "/usr/lib/", "/bin/", "/sbin/", "/lib/"),
}
#: IPv4 ranges of scopes, first match first.
SCOPES = (
    ("public", ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")),
    ("loopback", ("127.0.0.0/8",)),
    ("link_local", ("169.254.0.0/16",)),
    ("multicast", ("224.0.0.0/4",)),
    ("private", ("0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4")),
)
#: The block of RFC 9637 is private from the releases of Python on whose library has it, as scopes are the library's.
DOCUMENTATION = ("3fff::/20",) if ipaddress.ip_address("3fff::").is_private else ()
#: IPv6 ranges of scopes, first match first; ranges that are public though a private one holds them stand before it.
SCOPES6 = (
    ("loopback", ("::1/128",)),
    ("link_local", ("fe80::/10",)),
    ("multicast", ("ff00::/8",)),
    ("public", ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")),
    ("private", ("::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", *DOCUMENTATION, "fc00::/7")),
    ("reserved", ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")),
)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: nested uses of a long expression would multiply the generated code."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_class(path: Column) -> Column:
    """temp, user_writable, program_files, system, other; unknown for a bare name; null without a path."""
    norm = F.concat(F.lit("/"), F.ltrim(F.lower(slashed(path)), F.lit("/")))
    out = F.when(path.isNull() | (path == ""), None).when(F.length(norm) - F.length(F.replace(norm, F.lit("/"))) < 2, "unknown")
    for name, markers in PATH_MARKERS.items():
        out = out.when(_any([F.contains(norm, F.lit(m)) for m in markers]), name)
    return out.otherwise("other")


def basename(path: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.rtrim(slashed(path), F.lit("/")), "/"), -1), F.lit(""))


def file_extension(path: Column) -> Column:
    """The last suffix in lower case, with its dot; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(basename(path), F.lit("")), r"^.+(\.[^.]+)$", 1)), F.lit(""))


def ipv4(address: Column) -> Column:
    """The number of a dotted address; null if it is none."""
    parts = F.split(F.trim(address), r"\.")
    number = reduce(lambda a, b: a * 256 + b, [F.element_at(parts, i + 1).cast("bigint") for i in range(4)])
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(F.trim(address).rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"), number)


def ipv6(address: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null if it is none. A zone goes, and a dotted end counts as two groups."""
    text = F.regexp_replace(F.lower(F.trim(address)), "%[^%/]+$", "")
    dotted = F.regexp_extract(text, r"^[0-9a-f:]*:(\d+\.\d+\.\d+\.\d+)$", 1)
    low = F.lpad(F.lower(F.hex(ipv4(dotted))), 8, "0")
    plain = F.when(dotted == "", text).otherwise(F.concat(F.regexp_extract(text, r"^([0-9a-f:]*:)", 1), F.substr(low, F.lit(1), F.lit(4)), F.lit(":"), F.substr(low, F.lit(5), F.lit(4))))

    def digits(t: Column) -> Column:
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
        whole = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        halves = F.split(t, "::")
        left, right = groups(F.element_at(halves, 1)), groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        shape = t.rlike("^[0-9a-f:]+$") & ~t.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}")
        short = F.concat(whole(left), F.repeat(F.lit("0000"), 8 - F.size(left) - F.size(right)), whole(right))
        return F.when(shape & (F.size(halves) == 2) & (F.size(left) + F.size(right) <= 7), short).when(shape & (F.size(halves) == 1) & (F.size(left) == 8), whole(left))

    return bound(plain, digits)


def block(cidr: str) -> tuple[int, int]:
    """First and last number of a block of addresses; a ValueError if it is none."""
    net = ipaddress.ip_network(str(cidr).strip(), strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_blocks(address: Column, blocks: list) -> Column:
    """Whether an address is in one of the blocks, tried in order: a malformed block ends the search without a hit. Blocks of the other family hold nothing."""
    four, six = [], []
    for b in blocks:
        try:
            low, high = block(b)
        except ValueError:
            break
        if ":" in str(b):
            six.append((f"{low:032x}", f"{high:032x}"))
        else:
            four.append((low, high))
    found = F.lit(False)
    for known, ends in ((ipv4(address), four), (ipv6(address), six)):
        if ends:
            found = found | F.coalesce(bound(known, _among(ends)), F.lit(False))
    return found


def _among(ends: list) -> Callable[[Column], Column]:
    return lambda n: _any([n.between(*e) for e in ends])


def destination_scope(address: Column) -> Column:
    """public, private, loopback, link_local, multicast or reserved; unknown if it is no address. An IPv4 address mapped into IPv6 counts as such."""
    six = F.when(F.contains(address, F.lit(":")), ipv6(address))

    def number(six: Column) -> Column:
        return F.when(F.startswith(six, F.lit("0" * 20 + "ffff")), F.conv(F.substr(six, F.lit(25)), 16, 10).cast("bigint")).otherwise(ipv4(address))

    def scope(six: Column, n: Column) -> Column:
        out = F.when(address.isNull() | (address == ""), None)
        out = out.when(n.isNull() & six.isNull(), "unknown")
        for name, blocks in SCOPES:
            out = out.when(_any([n.between(*block(b)) for b in blocks]), name)
        out = out.when(n.isNotNull(), "public")
        for name, blocks in SCOPES6:
            out = out.when(_any([six.between(*(f"{x:032x}" for x in block(b))) for b in blocks]), name)
        return out.otherwise("public")

    return bound(six, lambda x: bound(number(x), lambda n: scope(x, n)))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits for a character; 0 for one character or none."""

    def bits(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars).cast("double"))
        return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))

    return F.when(F.length(text) <= 1, 0.0).otherwise(bound(F.split(text, ""), bits))


def vowel_ratio(text: Column) -> Column:
    letters = F.lower(F.regexp_replace(text, "[^a-zA-Z]", ""))
    return F.when(F.length(letters) == 0, 0.0).otherwise(F.length(F.regexp_replace(letters, "[^aeiou]", "")) / F.length(letters))


def domain_labels(name: Column) -> Column:
    return F.split(F.rtrim(F.lower(F.trim(name)), F.lit(".")), r"\.")


def second_level(name: Column) -> Column:
    labels = domain_labels(name)
    return F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1))


def is_generated_domain(name: Column) -> Column:
    sld = second_level(name)
    ratio, bits, size = F.round(vowel_ratio(sld), 3), F.round(entropy(sld), 3), F.length(sld)
    first = (size >= 12) & (bits >= 3.6)
    return F.coalesce(F.when(first, (ratio < 0.2) | (ratio > 0.7)).otherwise((size >= 16) & (bits >= 3.8)), F.lit(False))


def is_tunnel(name: Column) -> Column:
    labels = domain_labels(name)
    sub = F.when(F.size(labels) >= 3, F.array_join(F.slice(labels, 1, F.size(labels) - 2), "")).otherwise("")
    return F.coalesce(F.when(F.length(sub) >= 40, F.round(entropy(sub), 3) >= 3.8).otherwise((F.size(labels) >= 5) & (F.length(F.array_join(labels, ".")) >= 50)), F.lit(False))


def plain_command(command: Column) -> Column:
    """A command line without carets, backticks and joined string parts."""
    out = F.regexp_replace(F.regexp_replace(F.trim(command), r"\^", ""), "`", "")
    return F.when(F.contains(out, F.lit("'+'")) | F.contains(out, F.lit('"+"')), F.regexp_replace(out, r"['\"]\s*\+\s*['\"]", "")).otherwise(out)


def encoded_part(command: Column) -> Column:
    return _argument(plain_command(command))


def _argument(plain: Column) -> Column:
    return F.nullif(F.regexp_extract(plain, r"(?i)(?:-e|-enc|-encodedcommand|-encodedc)\s+([A-Za-z0-9+/=]{10,})", 1), F.lit(""))


#: Fixed patterns: what differs between machines and runs, in the order in which it is replaced.
MACHINE_DETAIL = (
    (r"\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?", "<guid>"),
    (r"([a-z]:\\users\\)(?:[^\\/\"':;|=,+*?<>\[\]]+(?=\\)|[^\\\"' ]+)", "$1<user>"),
    (r"[a-z]:\\windows\\(?:system32|syswow64|sysnative)", "win_system_dir"),
    (r"[a-z]:\\windows", "win_dir"),
    (r"[a-z]:\\program files(?: \(x86\))?", "program_files_dir"),
    (r"\b[a-z0-9]{8}\.(cmdline|dll|pdb|out|err|tmp|0)\b", "<rand>.$1"),
    (r"\b(?:0x)?[0-9a-f]{8,}\b", "<hex>"),
    (r"\d{3,}", "<n>"),
    (r"\s+", " "),
)


def normalized_text(text: Column) -> Column:
    out = F.replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("^"))), F.lit("/"), F.lit("\\"))
    for pattern, by in MACHINE_DETAIL:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def template(text: Column) -> Column:
    """Tokens with a digit become one mark."""
    return F.regexp_replace(text, r"\S*\d\S*", "<d>")


def risk_points(level: Column, confidence: Column) -> Column:
    return level / 16 * 100 * F.coalesce(confidence, F.lit(0.7))


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(score * a + b)))


def decoded_payload(encoded: Column) -> Column:
    """Text of a base64 argument: UTF-16LE if all of it is printable, else what is valid of UTF-8; null if it is no base64.

    Stays in the JVM. Text with surrogate pairs counts as UTF-8.
    """

    def bits(e: Column) -> Column:
        padded = F.concat(e, F.repeat(F.lit("="), (4 - F.length(e) % 4) % 4))
        return F.when((F.length(e) % 4 != 1) & e.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), F.try_to_binary(padded, F.lit("base64")))

    def text(raw: Column) -> Column:
        narrow = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))
        wide = F.when(F.hex(raw).rlike(r"^(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2})+$"), F.decode(raw, "UTF-16LE"))
        return bound(wide, lambda w: F.when(w.rlike(r"^[^\p{C}\p{Z}]*(?:[ \r\n\t][^\p{C}\p{Z}]*)*$"), w).otherwise(narrow))

    return F.nullif(F.regexp_replace(bound(bound(encoded, bits), text), r"(?U)^\s+|\s+$", ""), F.lit(""))


def deobfuscated(command: Column) -> Column:
    """The plain command line, and what its encoded part says behind it. Only command lines with such a part are looked at closely."""
    whole = lambda p: F.concat(p, F.coalesce(F.concat(F.lit(" [DECODED: "), decoded_payload(_argument(p)), F.lit("]")), F.lit("")))
    return F.when(F.contains(command, F.lit("-")), bound(plain_command(command), whole)).otherwise(plain_command(command))


def evasion_techniques(command: Column) -> Column:
    """Names of the disguises that a command line uses."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(command), r"\^", ""), "`", "")
    return F.array_compact(
        F.array(
            F.when(F.contains(command, F.lit("^")), "caret"),
            F.when(F.contains(command, F.lit("`")), "backtick"),
            F.when(F.contains(bare, F.lit("'+'")) | F.contains(bare, F.lit('"+"')), "concatenation"),
            F.when(decoded_payload(encoded_part(command)).isNotNull(), "encoding"),
        )
    )


def high_entropy(command: Column) -> Column:
    """True if a word of 12 characters or more has 4.3 bits, or the whole 4.6."""
    words = F.filter(F.split(command, r"\s+"), lambda w: F.length(w) >= 12)
    best = F.coalesce(F.array_max(F.transform(words, lambda w: F.round(entropy(w), 3))), F.lit(0.0))
    return F.coalesce((best >= 4.3) | (F.round(entropy(command), 3) >= 4.6), F.lit(False))


def dns_answers(results: Column) -> Column:
    """Addresses of a list of answers set apart by semicolons; rows that tell a type are left out and mapped addresses unwrapped."""
    parts = F.transform(F.split(results, ";"), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x: (x != "") & ~F.startswith(F.lower(x), F.lit("type:")))
    return F.transform(kept, lambda x: F.regexp_replace(x, r"^(?i)::ffff:", ""))


def extension_changed(path: Column, before: Column) -> Column:
    """Whether a rename gives another suffix; null if a path is missing."""
    now, was = file_extension(path), file_extension(before)
    return F.when(path.isNotNull() & before.isNotNull(), now.isNotNull() & ~now.eqNullSafe(was))


def account(text: Column) -> tuple[Column, Column]:
    """Name and domain of DOMAIN\\name; a bare name has no domain."""
    at = F.instr(text, "\\")
    name = F.when(at > 0, F.substr(text, at + 1)).otherwise(text)
    return F.nullif(name, F.lit("")), F.nullif(F.when(at > 0, F.substr(text, F.lit(1), at - 1)), F.lit(""))


def registry_value_type(details: Column) -> Column:
    return F.when(details.isNull(), None).when(F.startswith(details, F.lit("DWORD")), "REG_DWORD").when(F.startswith(details, F.lit("QWORD")), "REG_QWORD").when(F.startswith(details, F.lit("Binary Data")), "REG_BINARY").otherwise("REG_SZ")


def drive_path(path: Column) -> Column:
    """Device and driveless paths as C:\\...; bare names stay."""
    text = F.replace(F.regexp_replace(path, r"^\\\\\?\\", ""), F.lit("\\\\"), F.lit("\\"))
    device = F.regexp_extract(text, r"(?i)^\\device\\harddiskvolume\d+(\\.*)$", 1)
    return F.when(device != "", F.concat(F.lit("C:"), device)).when(F.startswith(F.lower(text), F.lit("\\device\\harddiskvolume")), text).when(F.startswith(text, F.lit("\\")), F.concat(F.lit("C:"), text)).otherwise(text)


def filetime(ticks: Column) -> Column:
    """Microseconds since 1970 of a count of 100 ns since 1601."""
    return F.call_function("div", ticks, F.lit(10)) - 11_644_473_600_000_000


def user_category(name: Column, domain: Column) -> Column:
    user, dom = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    return (
        F.when(user == "", "unknown")
        .when(user.isin("system", "local system") | F.endswith(user, F.lit("$")), "system")
        .when(user.isin("local service", "network service", "servicio local", "servicio de red") | dom.isin("nt authority", "nt-autorität", "autorite nt"), "service")
        .otherwise("user")
    )


def integrity_category(value: Column) -> Column:
    text = F.lower(F.trim(value))
    out = F.when(text.isNull(), "missing")
    for level in ("low", "medium", "high", "system"):
        out = out.when(F.startswith(text, F.lit(level)), level)
    return out.otherwise("missing")


def retry_delay(attempt: Column, base: float = 1.0, most: float = 300.0, key: Column | None = None, jitter: float = 0.1) -> Column:
    """Seconds before the next attempt. With a key, up to a share of them more or less: from a hash, so a task that runs again says the same."""
    plain = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    if key is None:
        return plain
    share = F.pmod(F.xxhash64(key, attempt), F.lit(20_001)) / 10_000.0 - 1
    return F.greatest(F.lit(0.0), plain * (1 + jitter * share))


#: Fixed patterns: marks of the laboratories in which attacks were recorded, in the order in which they are replaced.
SCRUB = (
    (r"(?i)[a-z]:\\atomicredteam\\atomics\\[^\s\"']*", r"c:\\tools\\payload"),
    (r"(?i)[a-z]:\\detectiontesting\\[^\s\"']*", r"c:\\tools\\payload"),
    (r"(?i)pathtoatomicsfolder|externalpayloads|atomicredteam|invoke-atomictest", "tool"),
    (r"(?i)\bt1\d{3}(?:\.\d{3})?\b", "item"),
    (r"(?i)\b[\w.-]*\.(?:attackrange\.local|theshire\.local|mordor\.local|waynecorpinc\.local|pandalab\.com|azsentinel\.local|contoso\.lab|systemia\.com)\b", "host.example"),
    (r"(?i)\bwin-(?:dc|host)-[\w-]+\b", "host"),
)


def scrubbed(text: Column) -> Column:
    for pattern, by in SCRUB:
        text = F.regexp_replace(text, pattern, by)
    return text


def recommendation(action: Column, pid: Column, file: Column) -> Column:
    """What a response asks for, and whether somebody has to approve it."""
    target = F.concat_ws(", ", F.concat(F.lit("pid "), pid.cast("string")), file)
    named = F.concat(action, F.when(target == "", "").otherwise(F.concat(F.lit(" ("), target, F.lit(")"))))
    destructive = action.isin("TERMINATE_PROCESS", "ISOLATE_HOST", "QUARANTINE_FILE", "RELEASE_HOST_ISOLATION")
    return F.when(action.isNull(), "no action recommended -- detection only").otherwise(F.concat(named, F.when(destructive, " -- requires analyst approval before it runs").otherwise(" -- read-only, may run automatically")))


def clean_title(title: Column) -> Column:
    """A title without the [CATEGORY] in front."""
    return F.when(F.startswith(title, F.lit("[")) & F.contains(title, F.lit("]")), F.trim(F.regexp_replace(title, r"^\[[^\]]*\]", ""))).otherwise(title)
