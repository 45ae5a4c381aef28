"""Removal of byte strings that repeat, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus. Every such string has an anchor: its
leftmost gram of the least hash. Equal strings have equal anchors, so strings can only repeat within the segments (all strings of a run that
share an anchor occurrence) of one anchor value. Anchors that occur once are dropped. Segments with the same bytes are counted, not kept;
where an anchor has only one such content, all of it repeats. The other distinct segments are brought together by anchor in blocks of bounded
size. In a block, strings that lie in no window of bytes that another segment has, too, alike around the anchor, cannot repeat and are left out.
Of the rest, suffixes are sorted, and intervals of equal prefixes are extended backward, breadth first, one byte at a time: common prefixes
come out by increasing value, and the expansion stops at `length`. Segments of an anchor with very many distinct ones (a common line
between unlike neighbours) are cut into short ranges of strings; ranges have to share their common core, so most of them are alone and go.
What still is very many is spread over several units; strings that are alone in their unit are then compared by hash across units, so nothing
is lost and no task gets all of them.

Null and empty texts have no bytes. Documents are told apart by id and text; rows that repeat both are documents of their own, so their texts repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, checkpointed, hit, keyed, mix, prepare, ragged, rows_from, settle, table, texts_of, with_columns

LENGTH, GRAM = 200, 32
#: Distinct segments of one anchor that a unit of work holds, about; an anchor with more is spread over several.
UNIT = 512
#: Strings of a range that a segment of a very common anchor is cut into.
RANGE = 12
#: Bits of the filter, sent to all tasks, of the documents to read segments from: 2 MB.
WANTED_BITS = 24
#: Bytes of the segments whose transform is built at once, unless a unit has more.
BLOCK_BYTES = 300_000
#: Bytes of text whose grams are hashed at once, unless a text is longer: what is made of them stays within a core's cache.
HASHED_BYTES = 100_000
#: Searches among the last ends of intervals cost about as much as so many places in a sum over all of them.
SEARCHED = 8
#: Places of strings that are told apart, before a transform is built, as to whether the strings may repeat.
STEP = 24
POSITION = np.uint64((1 << 24) - 1)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` bytes (a multiple of 8) from each position on; data ends with as many spare bytes."""
    n = len(data) - size
    word = np.ndarray((n + size - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = np.zeros(n, dtype=np.uint64)
    for i in range(0, size, 8):
        out ^= word[i : i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return mix(out)


def content_by_grams(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of byte strings of any lengths from `gram` on, by the hashes of grams side by side; the last gram ends where the string ends."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    many = sizes // gram + 1
    k = ragged(np.zeros(len(many), dtype=np.int64), many)
    power = np.cumprod(np.full(int(many.max()), 0xD6E8FEB86659FD93, dtype=np.uint64))
    terms = h[np.repeat(starts, many) + np.minimum(k * gram, np.repeat(sizes - gram, many))] * power[k]
    terms ^= terms >> np.uint64(29)
    return mix(np.add.reduceat(terms, np.cumsum(many) - many) + sizes.astype(np.uint64))


def anchored(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, digests: bool = True) -> tuple[np.ndarray, ...]:
    """Segments of texts: text, first string, number of strings, hash of the anchor, where it is from the first string on, and hash of the bytes (if asked for). All strings of a segment share the anchor occurrence."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join([*texts, bytes(length + 8)]), dtype=np.uint8)
    many = np.maximum(sizes - length + 1, 0)
    if not many.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(data) > int(POSITION):
        parts = [anchored_long(t, length, gram, digests) if len(t) > 8_000_000 else anchored([t], length, gram, digests) for t in texts]
        return (np.concatenate([np.full(len(p[0]), i, np.int64) for i, p in enumerate(parts)]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4, 5)))
    h = grams(data, gram)
    key = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    width, span = length - gram + 1, 1
    least = key
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    has = np.flatnonzero(many)
    inside = np.zeros(len(least) + 1, dtype=np.int8)  # whether a string starts there
    inside[starts[has]] = 1
    inside[(starts + many)[has]] = -1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[starts[has]] = True
    first = np.flatnonzero(new & inside)
    of = has[np.searchsorted(starts[has], first, side="right") - 1]
    count = np.minimum(np.append(first[1:], len(data)), (starts + many)[of]) - first
    anchor = (least[first] & POSITION).astype(np.int64)
    return of, first - starts[of], count, h[anchor], anchor - first, content_by_grams(h, first, count + length - 1, gram) if digests else np.zeros(len(first), np.uint64)


def anchored_long(text: bytes, length: int, gram: int, digests: bool = True, step: int = 4_000_000) -> tuple[np.ndarray, ...]:
    """As anchored for one very long text, part by part; a segment may be cut in two where parts meet, which changes no result."""
    found = []
    for i in range(0, max(1, len(text) - length + 1), step):
        _, a, *more = anchored([text[i : i + step + length - 1]], length, gram, digests)
        found.append((a + i, *more))
    return (np.zeros(sum(len(x[0]) for x in found), np.int64), *(np.concatenate(x) for x in zip(*found, strict=True)))


def candidates(data: np.ndarray, starts: np.ndarray, many: np.ndarray, place: np.ndarray, unit: np.ndarray, all_of: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of strings (segment, first, number) that may repeat in another segment of the same unit; all strings of the segments that all_of marks.

    Equal strings lie alike around their anchors. So all strings that start within a few bytes of each other share a window that lies alike in
    segments that repeat any of them: where no other segment of the unit has that window, by its hash, none of them repeats there.
    """
    h = grams(data, GRAM)
    windows = -(-(length - GRAM + 1) // STEP)
    size = length - STEP + 1
    steps = [*range(0, size - GRAM, GRAM), size - GRAM]
    high, low = place, place - many + 1  # how far before the anchor strings start
    segment, window, keys = [], [], []
    for w in range(windows):
        i = np.flatnonzero((w * STEP <= high) & ((w + 1) * STEP > low) & ~all_of)
        at = starts[i] + place[i] - w * STEP
        key = mix(unit[i] + np.uint64(w))
        for k in steps:
            key = (key ^ h[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        segment.append(i)
        window.append(np.full(len(i), w))
        keys.append(key)
    i, w, key = np.concatenate(segment), np.concatenate(window), np.concatenate(keys)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else np.zeros(0, dtype=bool)
    shared = np.zeros((len(starts), windows + 2), dtype=np.int8)
    shared[i[order[twice]], w[order[twice]] + 1] = 1
    edge = np.diff(shared, axis=1)
    (of, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # by segment, so that ends meet their beginnings
    near, far = np.maximum(a * STEP, low[of]), np.minimum(b * STEP - 1, high[of])
    whole = np.flatnonzero(all_of)
    return np.concatenate([of, whole]), np.concatenate([place[of] - far, np.zeros(len(whole), np.int64)]), np.concatenate([far - near + 1, many[whole]])


def suffixes(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of data (which ends with 0xFF bytes) in the order of their first `depth` bytes or more, as the transform needs them."""
    n = len(data) - 8
    order = np.argsort(np.ndarray((n,), dtype=">u8", buffer=data, strides=(1,)).astype(np.uint64))
    word = np.ndarray((n,), dtype=">u8", buffer=data, strides=(1,))[order]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    at = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    step = 8
    while step <= depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        who = order[slots]
        key = (rank[who] << 32) | rank[np.minimum(who + step, n - 1)]
        sort = np.argsort(key)
        who, key = who[sort], key[sort]
        order[slots] = who
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, slots, 0))
        step *= 2
    return order


def repeated(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and whether each shares its first `length` bytes with the one before it.

    differs holds the ends of the intervals of suffixes with equal prefixes of a length, from length 1 on. An interval of the next length is one
    of this length extended by the byte before it: neighbours in the order that begin with the same byte stay together as long as no interval
    ends between what follows that byte in either, which are their places under the transform's mapping. Where these places are neighbours, too,
    only one end lies between them, so it is handed back when it is found; all others look again at each length.
    """
    order = suffixes(data, length)
    n = len(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    after = place[np.minimum(order + 1, n - 1)]  # what the transform's mapping leads back from
    byte = data[order]
    differs = np.concatenate([[True], byte[1:] != byte[:-1]])
    chained = np.concatenate([[False], after[1:] == after[:-1] + 1]) & ~differs & (order < n - 2)
    back = np.full(n, -1, dtype=np.int64)
    back[after[chained]] = np.flatnonzero(chained)
    open_ = np.flatnonzero(~differs & ~chained)
    low, high = after[open_ - 1], after[open_]
    fresh = np.flatnonzero(differs)
    marks = np.zeros(n, dtype=np.int32)
    ends = np.empty(n, dtype=np.int32)
    for _ in range(1, length):
        if not len(fresh):  # no interval has been split, so none will be
            break
        # Only the last ends can lie between places that have none between them so far.
        if len(open_) * SEARCHED < n:
            last = np.sort(fresh)
            apart = np.searchsorted(last, low, side="right") != np.searchsorted(last, high, side="right")
        else:
            marks[fresh] = 1
            np.cumsum(marks, out=ends)
            marks[fresh] = 0
            apart = ends[low] != ends[high]
        handed = back[fresh]
        fresh = np.concatenate([open_[apart], handed[handed >= 0]])
        differs[fresh] = True
        if len(fresh) and apart.any():
            open_, low, high = open_[~apart], low[~apart], high[~apart]
    return order, ~differs


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of runs of true."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


SEGMENT = "anchor long, digest long, _k1 long, _k2 long, first int, many int, place int"
OUTCOME = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("string", T.LongType())])


def _segments(docs: DataFrame, length: int, only_anchor: bool) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = texts_of(batch.column(0))
        of, first, many, h, place, digest = anchored(texts, length, digests=not only_anchor)
        anchor = pa.array(h.view(np.int64))
        if only_anchor:
            return {"anchor": anchor}
        k1, k2 = (np.asarray(batch.column(i)) for i in (1, 2))
        return {"anchor": anchor, "digest": pa.array(digest.view(np.int64)), "_k1": pa.array(k1[of]), "_k2": pa.array(k2[of]), "first": pa.array(first, pa.int32()), "many": pa.array(many, pa.int32()), "place": pa.array(place, pa.int32())}

    schema = T._parse_datatype_string("anchor long" if only_anchor else SEGMENT)
    return rows_from(docs.select("text", "_k1", "_k2"), kernel, schema, "text", HASHED_BYTES)


def content(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of byte strings of any lengths."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    table_ = mix(np.arange(1, 257, dtype=np.uint64))
    power = np.cumprod(np.full(int(sizes.max()), 0xD6E8FEB86659FD93, dtype=np.uint64))
    within = ragged(np.zeros(len(sizes), dtype=np.int64), sizes)
    terms = table_[data[ragged(starts, sizes)]] * power[within]
    terms ^= terms >> np.uint64(29)
    return mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def _expanded(units: DataFrame, length: int) -> DataFrame:
    """OUTCOME rows of distinct segments (anchor, salt, salts, digest, bytes, place) sorted by unit within partitions.

    first and last: strings of a segment that repeat within its unit. string: the hash of a string of a spread anchor that is alone in its unit
    (first and last tell where), or that the unit has more than once (no first).
    """

    def block(distinct: list[tuple]) -> Iterator[tuple]:
        sizes = np.array([len(r[4]) for r in distinct], dtype=np.int64)
        data = np.frombuffer(b"".join([*(r[4] for r in distinct), bytes(GRAM)]), dtype=np.uint8)
        unit = np.array([r[0] for r in distinct], dtype=np.int64).view(np.uint64)
        of, first, many = candidates(data, np.cumsum(sizes) - sizes, sizes - length + 1, np.array([r[5] for r in distinct], dtype=np.int64), unit, np.array([r[2] > 1 for r in distinct]), length)
        if not len(of):
            return
        rows = [distinct[i] for i in of.tolist()]
        segments = [r[4][a : a + n + length - 1] for r, a, n in zip(rows, first.tolist(), many.tolist(), strict=True)]
        sizes = many + length - 1
        data = np.frombuffer(b"\xff".join([*segments, b"\xff" * 264]), dtype=np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        order, same = repeated(data, length)
        twice = same.copy()
        twice[:-1] |= same[1:]
        flags = np.zeros(len(data), dtype=bool)
        flags[order[twice]] = True
        spread = np.array([r[2] > 1 for r in rows])
        if spread.any():
            leader = np.zeros(len(data), dtype=bool)
            leader[order[~same]] = True
            many = many * spread
            at = ragged(starts, many)
            of = np.repeat(np.arange(len(rows)), many)
            keep = leader[at]
            at, of = at[keep], of[keep]
            hashes = content(data, at, np.full(len(at), length, dtype=np.int64)).view(np.int64)
            for h, i, p, more in zip(hashes.tolist(), of.tolist(), (at - starts[of]).tolist(), flags[at].tolist(), strict=True):
                yield (rows[i][0], rows[i][3], None if more else p, None if more else p, h)
        flags[(starts + sizes)[:, None] - np.arange(length)] = False  # no string starts there
        flags[starts[-1] + sizes[-1] :] = False
        low, high = runs(flags)
        of = np.searchsorted(starts, low, side="right") - 1
        back = first[of] - starts[of]
        for i, a, b in zip(of.tolist(), (low + back).tolist(), (high + back).tolist(), strict=True):
            yield (rows[i][0], rows[i][3], a, b, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            out = list(block(held)) if held else []
            for i in range(0, len(out), 50_000):
                columns = list(zip(*out[i : i + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=OUTCOME.names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size >= BLOCK_BYTES and (row[0], row[1]) != (held[-1][0], held[-1][1]):
                    yield from given()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield from given()
        held.clear()
        settle()

    return units.mapInArrow(run, OUTCOME)


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_k1, _k2 and spans (array of first byte and end) of the documents of a keyed frame that lose something; spans do not touch."""
    prepare(docs.sparkSession)
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    slim = docs.select("text", "_k1", "_k2").where(F.octet_length("text") >= length)
    # Written, as adaptive joins can split a hot anchor only where both sides come straight from a shuffle.
    shared = checkpointed(_segments(slim, length, True).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    every = checkpointed(_segments(slim, length, False).join(shared, "anchor"))
    contents = checkpointed(every.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2", "first", "many", "place")).alias("at")))
    kinds = checkpointed(contents.groupBy("anchor").agg(F.count("*").alias("kinds")))
    contents = checkpointed(contents.join(kinds, "anchor"))
    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out: list[tuple] = []
        for text, found in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for s in found:
                segment = text[s["first"] : s["first"] + s["many"] + length - 1]
                if s["kinds"] <= UNIT:
                    out.append((s["anchor"], s["digest"], s["anchor"], s["digest"], s["kinds"], 0, segment, s["place"]))
                    continue
                # ranges are counted from the anchor occurrence, so equal strings are in equal ranges
                place = s["place"]
                edges = [i for i in range(s["many"]) if i == 0 or (place - i) % RANGE == RANGE - 1] + [s["many"]]
                for a, b in zip(edges, edges[1:], strict=False):
                    k = (place - a) // RANGE
                    low, high = place - k * RANGE, place - k * RANGE - RANGE + 1 + length  # what all strings of a whole range share
                    core = np.frombuffer(segment[low:high], dtype=np.uint8)
                    part = segment[a : b - 1 + length]
                    both = content(np.frombuffer(part + core.tobytes(), dtype=np.uint8), np.array([0, len(part)]), np.array([len(part), len(core)]))
                    refined = mix(both[1:] ^ mix(np.array([s["anchor"]], dtype=np.int64).view(np.uint64) + np.uint64(k)))
                    out.append((int(refined.view(np.int64)[0]), int(both[:1].view(np.int64)[0]), s["anchor"], s["digest"], 0, a, part, place - a))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
        return {f.name: pa.array(c, t) for f, c, t in zip(cut_schema.fields, columns, kinds_, strict=True)}

    cut_schema = T._parse_datatype_string("u_anchor long, u_digest long, anchor long, digest long, kinds long, shift int, bytes binary, place int")

    def read(which: str) -> DataFrame:
        """The bytes of distinct segments, from one document that has each."""
        wanted = contents.where(which).select("at._k1", "at._k2", F.struct("anchor", "digest", "kinds", "at.first", "at.many", "at.place").alias("s")).groupBy("_k1", "_k2").agg(F.collect_list("s").alias("s"))
        filter_ = docs.sparkSession.sparkContext.broadcast(bitmap(contents.where(which).select(F.shiftrightunsigned(F.xxhash64("at._k2"), 64 - WANTED_BITS).alias("slot")), WANTED_BITS))

        def needed(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
            keep = pa.array(hit(filter_.value, np.asarray(batch.column(3)).view(np.uint64), WANTED_BITS))
            return {k: batch.column(i).filter(keep) for i, k in enumerate(("text", "_k1", "_k2"))}

        some = rows_from(slim.withColumn("slot", F.xxhash64("_k2")), needed, T._parse_datatype_string("text string, _k1 long, _k2 long"), "text")
        return rows_from(some.join(wanted.hint("merge"), ["_k1", "_k2"]).select("text", "s"), cut, cut_schema, "text")

    whole = read(f"kinds between 2 and {UNIT}").select("u_anchor", "u_digest", "kinds", "bytes", "place")
    ranges = checkpointed(read(f"kinds > {UNIT}"))
    met = ranges.groupBy("u_anchor").agg(F.count("*").alias("n")).where("n > 1").select("u_anchor")
    parts = ranges.join(met, "u_anchor").groupBy("u_anchor", "u_digest").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.first("place").alias("place"))
    parts = checkpointed(parts.join(parts.groupBy("u_anchor").agg(F.count("*").alias("kinds")), "u_anchor"))
    salts = F.ceil(F.col("kinds") / UNIT).cast("int")
    units = whole.unionByName(parts.where("kinds > 1").select("u_anchor", "u_digest", "kinds", "bytes", "place"))
    units = units.select(F.col("u_anchor").alias("anchor"), F.pmod("u_digest", salts).cast("int").alias("salt"), salts.alias("salts"), F.col("u_digest").alias("digest"), "bytes", "place")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    outcome = checkpointed(_expanded(units.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt", "digest"), length))
    across = outcome.where("string is not null").groupBy("string").agg(F.count("*").alias("units")).where("units > 1").select("string")
    met = outcome.where("string is not null and first is not null").join(across, "string").select("anchor", "digest", "first", "last")
    equal = parts.where("n > 1").select(F.col("u_anchor").alias("anchor"), F.col("u_digest").alias("digest"), F.lit(0).alias("first"), (F.octet_length("bytes") - length).alias("last"))
    seen = outcome.where("string is null").select("anchor", "digest", "first", "last").unionByName(met).unionByName(equal)
    # back from ranges to the segments that they were cut from
    of_ranges = ranges.select("u_anchor", "u_digest", "anchor", "digest", "shift").join(seen.select(F.col("anchor").alias("u_anchor"), F.col("digest").alias("u_digest"), "first", "last"), ["u_anchor", "u_digest"])
    of_ranges = of_ranges.select("anchor", "digest", (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
    partly = seen.unionByName(of_ranges).groupBy("anchor", "digest").agg(F.collect_list(F.struct("first", "last")).alias("parts"))
    wholly = contents.where("n > 1").select("anchor", "digest", F.lit(None).cast("array<struct<first:int,last:int>>").alias("parts"))
    verdict = wholly.unionByName(partly.join(wholly.select("anchor", "digest"), ["anchor", "digest"], "left_anti"))
    covered = every.join(verdict, ["anchor", "digest"]).withColumn("p", F.explode(F.coalesce("parts", F.array(F.struct(F.lit(0).alias("first"), (F.col("many") - 1).alias("last"))))))
    covered = covered.select("_k1", "_k2", F.struct((F.col("first") + F.col("p.first")).alias("a"), (F.col("first") + F.col("p.last") + length).alias("b")).alias("r"))
    return covered.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("r")).alias("ranges"))


def remove(df: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """Adds kept (binary: the bytes that stay) and removed (array of first byte and end of each maximal removed run).

    Takes doc_id and text; other columns pass through, and columns named kept or removed are replaced. as_text: kept is a string; a cut may fall
    within a character, and what is left of such a character goes as well.
    """
    docs = keyed(df.drop("kept", "removed"))
    found = checkpointed(spans(docs, length))
    # Texts go to their spans only where there may be some; the filter is of fixed size, and what it lets through for nothing finds none.
    filter_ = df.sparkSession.sparkContext.broadcast(bitmap(found.select(F.shiftrightunsigned(F.xxhash64("_k2"), 64 - WANTED_BITS).alias("slot")), WANTED_BITS))
    marked, names = docs.withColumn("_slot", F.xxhash64("_k2")), docs.columns
    runs_ = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    fields = [T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])))]

    def result(kept: list[bytes], removed: list[list[dict]]) -> dict[str, pa.Array]:
        left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        return {"kept": left, "removed": pa.array(removed, runs_)}

    def may_lose(batch: pa.RecordBatch) -> np.ndarray:
        return hit(filter_.value, np.asarray(batch.column(batch.schema.get_field_index("_slot"))).view(np.uint64), WANTED_BITS)

    def some(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        keep = pa.array(may_lose(batch))
        return {k: batch.column(batch.schema.get_field_index(k)).filter(keep) for k in names}

    def whole(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        keep = pa.array(~may_lose(batch))
        own = {k: batch.column(batch.schema.get_field_index(k)).filter(keep) for k in names}
        kept = texts_of(own["text"])
        return own | result(kept, [[]] * len(kept))

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        kept, removed = [], []
        for text, ranges in zip(texts_of(batch.column(batch.schema.get_field_index("text"))), batch.column(batch.schema.get_field_index("ranges")).to_pylist(), strict=True):
            gone: list[list[int]] = []
            for r in ranges or ():
                if gone and r["a"] <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], r["b"])
                else:
                    gone.append([r["a"], r["b"]])
            edges = [0, *(x for g in gone for x in g), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append([{"first": a, "end": b} for a, b in gone])
        return result(kept, removed)

    # A task has one Python step at most, here and in spans(): each step of a task takes a worker of its own, and workers stay for the stages to come.
    # So a step is not read by the next but through a shuffle, which the hint keeps where a side is small.
    joined = rows_from(marked, some, docs.schema, "text").join(found.hint("merge"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    rest = rows_from(marked, whole, T.StructType([*docs.schema.fields, *fields]), "text").drop("_k1", "_k2")
    return with_columns(joined, kernel, fields, "text").drop("ranges").unionByName(rest)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
