"""N-gram Jaccard join: a size-aware join of sets of word shingles that is heavy-light in set size.

Documents with equal sets count once. A small set lists its subsets of the fixed sizes that a link with another small set must share; sets that
share one are linked by their sizes alone. A large set is found by scanning inverted lists of the first shingles of its set in an order common
to all: by how many documents have them, in levels, then by hash. The boundary between small and large is where listing subsets would
cost more than scanning lists. Lists are scanned three times: first every member is held against one member of its list, then against one of
several, which joins groups of near copies into components at a cost linear in the group; then members of different components in one list
are compared, unless what they have left from there on shows that they cannot link. So no link between different texts is lost, and a group of copies costs no square.

A null text, or one without words, has an empty set and is linked with nothing. Sets and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, checkpointed, hit, lists, mix, prepare, ragged, rows_from, settle, slices, table, texts_of
from .graph import components

WORDS = 5
#: Sets link when 100 * intersection >= 75 * union, that is 7 * intersection >= 3 * (sum of their sizes).
PART, WHOLE = 3, 7
#: Rows that one posting costs, about, with what is compared because of it.
POSTING_COST = 16
#: Documents that make a shingle frequent (a task must see it twice before it counts), and how many times more make it frequent at the next level.
FREQUENT, LEVEL = 8, 4
#: Shingles of a task that are counted at once.
COUNTED = 2_000_000
#: Ratio of the limits of a class of set sizes: sets that link are of one class or of neighbouring ones, so a little over 4 / 3.
CLASS = 1.34
#: Sets of a longer list, about, that are held against one of them.
DRAWN = 16
#: Bits of the filters that go to all tasks: 4 MB for each of three levels and 2 MB. More frequent shingles than a sixteenth of it raise FREQUENT.
FREQUENT_BITS, WANTED_BITS = 25, 24

#: What sets that meet in a list must have left, and by how much their sketches may differ, if they link.
MAY_LINK = f"{WHOLE} * least(room, room_b) >= {PART} * (n + n_b) and {WHOLE} * coalesce({' + '.join(f'bit_count(sketch[{i}] ^ sketch_b[{i}])' for i in range(4))}, 0) <= {WHOLE - 2 * PART} * (n + n_b)"

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = mix(np.arange(1, 257, dtype=np.uint64))[LOWER]
ODD = np.uint64(0xD6E8FEB86659FD93)


def required(a: int, b: int) -> int:
    """Shared shingles that link sets of these sizes."""
    return -(-PART * (a + b) // WHOLE)


def first_shingles(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n cannot all be missing from a set that links with it."""
    return n - (3 * n + 3) // 4 + 1


def subset_sizes(n: int, most: int) -> list[int]:
    """Sizes of the subsets that a set of n shares with any set of at most `most` that it links with."""
    return sorted({required(n, m) for m in range(1, most + 1) if required(n, m) <= min(n, m)})


def boundary() -> int:
    """The largest size up to which listing subsets costs no more than scanning inverted lists."""
    n = 1
    while sum(comb(n + 1, c) for c in subset_sizes(n + 1, 2 * n)) <= POSTING_COST * int(first_shingles(np.array(n + 1))):
        n += 1
    return n


SMALL = boundary()
#: The least size of a set that can link with a large one.
SCANNED = ceil(0.75 * (SMALL + 1))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts, flat, and how many each has."""
    sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    counts = np.zeros(len(texts), dtype=np.int64)
    word = ~SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), counts
    length = end - begin
    letters = data[word]
    within = ragged(np.zeros(len(length), dtype=np.int64), length)
    power = np.cumprod(np.full(int(length.max()), ODD, dtype=np.uint64))
    hashes = mix(np.add.reduceat(BYTE[letters] * power[within], np.cumsum(length) - length) + length.astype(np.uint64))
    of = np.searchsorted(np.cumsum(sizes), begin, side="right")
    words = np.bincount(of, minlength=len(texts))
    first = np.cumsum(words) - words
    many = np.where(words == 0, 0, np.maximum(words - WORDS + 1, 1))
    at = ragged(first, many)
    span = np.minimum(words, WORDS)[np.repeat(np.arange(len(texts)), many)]
    total = np.zeros(len(at), dtype=np.uint64)
    last = len(hashes) - 1
    for i in range(WORDS):
        total = mix(total + np.where(i < span, hashes[np.minimum(at + i, last)], np.uint64(i)))
    out = []
    ends = np.cumsum(many)
    for i, (a, b) in enumerate(zip((ends - many).tolist(), ends.tolist(), strict=True)):
        own = np.unique(total[a:b])
        counts[i] = len(own)
        out.append(own)
    return np.concatenate(out), counts


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ ODD), dtype=np.uint64)])
    ends = np.cumsum(counts)
    return np.where(counts > 0, mix(total[ends] - total[ends - counts] + counts.astype(np.uint64)), np.uint64(0)).view(np.int64)


def sketches(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """256 bits for each set, as four longs: whether the number of its shingles of each slot is odd. Two sets differ by as many shingles as bits at least."""
    slot = (mix(flat ^ BYTE[0]) >> np.uint64(56)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(counts)), counts) * 256 + slot, minlength=256 * len(counts)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(counts), 4)


def frequent(docs: DataFrame) -> list[np.ndarray]:
    """Filters of the shingles that many documents have, that LEVEL times as many have, and so on. They only set the order of shingles, so what they miss or add by chance costs time, not links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                h, n = h[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in slices(batches, "text", 1_000_000):
            flat, _ = shingles(texts_of(batch.column(0)))
            held.append(flat)
            size += len(flat)
            if size > COUNTED:
                yield from given()
                held, size = [], 0
        yield from given()
        held.clear()
        settle()

    counts = checkpointed(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {FREQUENT}"))
    steps = [FREQUENT << i for i in range(40)]
    sizes = counts.agg(*[F.count_if(F.col("n") >= s).alias(str(s)) for s in steps]).first()
    least = next(s for s in steps if sizes[str(s)] <= 1 << (FREQUENT_BITS - 4))
    return [bitmap(counts.where(f"n >= {least * LEVEL**i}").select(F.shiftrightunsigned("h", 64 - FREQUENT_BITS).alias("slot")), FREQUENT_BITS) for i in range(3)]


def _sets(docs: DataFrame, often: list[np.ndarray]) -> DataFrame:
    """doc_id, n, rare (shingles that few have), sig, first: shingles to scan lists for, as numbers whose unsigned order is the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        flat, counts = shingles(texts_of(batch.column(1)))
        sig = signatures(flat, counts)
        level = sum(hit(x, flat, FREQUENT_BITS).astype(np.uint64) for x in shared.value)
        hot = level > 0
        ranked = (flat >> np.uint64(2)) | (level << np.uint64(62))
        take = np.where(counts >= SCANNED, first_shingles(counts), 0)
        out = []
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(hot.astype(np.int64))])
        rare = counts - (total[ends] - total[ends - counts])
        for a, b, k in zip((ends - counts).tolist(), ends.tolist(), take.tolist(), strict=True):
            if k:
                out.append(np.sort(ranked[a:b])[:k])
        small = [flat[b - n : b].view(np.int64) if 0 < n <= SMALL else flat[:0].view(np.int64) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        return {
            "doc_id": batch.column(0),
            "text_hash": batch.column(2),
            "n": pa.array(counts),
            "rare": pa.array(rare),
            "sig": pa.array(sig),
            "sketch": lists(sketches(flat, counts).ravel(), np.full(len(counts), 4), pa.int64()),
            "first": lists(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64), take, pa.int64()),
            "small": lists(np.concatenate(small) if small else np.zeros(0, np.int64), np.where(counts <= SMALL, counts, 0), pa.int64()),
        }

    schema = T._parse_datatype_string("doc_id long, text_hash long, n long, rare long, sig long, sketch array<long>, first array<long>, small array<long>")
    return rows_from(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), kernel, schema, "text", 1_000_000)


def _small_links(sets: DataFrame) -> DataFrame:
    """a, b: links among small sets, at least as many as hold the groups together."""

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        key, c_, n_, sig_ = [], [], [], []
        for sig, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mixed = mix(np.array(values, dtype=np.int64).view(np.uint64)).tolist()
            for c in subset_sizes(len(values), SMALL):
                for part in combinations(mixed, c):
                    key.append(sum(part) % 2**64)
                    c_.append(c)
                    n_.append(len(values))
                    sig_.append(sig)
        return {"key": pa.array(mix(np.array(key, dtype=np.uint64)).view(np.int64)), "c": pa.array(c_, pa.int32()), "n": pa.array(n_, pa.int64()), "sig": pa.array(sig_, pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                made = kernel(batch.slice(i, 512))
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    rows = sets.where(f"n between 1 and {SMALL}").select("sig", "small").mapInArrow(run, "key long, c int, n long, sig long")
    least = rows.groupBy("key", "c").agg(F.min(F.struct("n", "sig")).alias("m"), F.count("*").alias("k")).where("k > 1").select("key", "c", F.col("m.n").alias("m_n"), F.col("m.sig").alias("m_sig"))
    return rows.join(least, ["key", "c"]).where(f"sig <> m_sig and {PART} * (n + m_n) <= {WHOLE} * c").select(F.col("sig").alias("a"), F.col("m_sig").alias("b")).distinct()


def _lists(postings: DataFrame) -> DataFrame:
    """h, sig, n, rare, p, lead: postings of lists with more than one member; lead is the member with the fewest rare shingles, like the text that
    the others of a group were copied from.

    Lists of shingles that few documents have are read in order from one partition. Others may hold much of the corpus, so their lead comes
    from an aggregation and is joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        before: tuple[int, int] | None = None  # the list that is open, and its lead, once a part of it has been given out

        def given(h: np.ndarray, sig: np.ndarray, n: np.ndarray, rare: np.ndarray, p: np.ndarray, start: tuple[int, int] | None) -> pa.RecordBatch:
            new = np.concatenate([[True], h[1:] != h[:-1]])
            begin = np.flatnonzero(new)
            size = np.diff(begin, append=len(h))
            lead = np.repeat(sig[begin], size)
            many = np.repeat(size > 1, size)
            if start and len(h) and h[0] == start[0]:
                lead[: size[0]] = start[1]
                many[: size[0]] = True
            return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (h, sig, n, rare, p, lead)], names=["h", "sig", "n", "rare", "p", "lead"])

        for batch in batches:
            part = tuple(batch.column(i).to_numpy() for i in range(5))
            if rest is not None:
                part = tuple(np.concatenate([a, b]) for a, b in zip(rest, part, strict=True))
            if not len(part[0]):
                continue
            last = int(np.searchsorted(part[0], part[0][-1]))  # the last list may go on
            if len(part[0]) - last > 100_000:
                last = len(part[0])
            if last:
                made = given(*(x[:last] for x in part), before)
                h, lead = part[0][last - 1], part[1][int(np.searchsorted(part[0][:last], part[0][last - 1]))]
                before = (h, before[1] if before and before[0] == h else lead)
                yield made
            rest = tuple(x[last:] for x in part)
        if rest is not None and len(rest[0]):
            yield given(*rest, before)

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seldom = postings.where("shiftrightunsigned(h, 62) = 0").repartition(n, "h").sortWithinPartitions("h", "rare", "sig").mapInArrow(run, "h long, sig long, n long, rare long, p int, lead long")
    often = postings.where("shiftrightunsigned(h, 62) > 0")
    leads = often.groupBy("h").agg(F.min(F.struct("rare", "sig")).alias("lead"), F.count("*").alias("k")).where("k > 1").select("h", F.col("lead.sig").alias("lead"))
    return seldom.unionByName(often.join(leads, "h").select("h", "sig", "n", "rare", "p", "lead"))


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: those of pairs (a, b) of sets that do link, by their whole sets."""
    ids = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(reps.join(ids, "sig").select(F.shiftrightunsigned(F.xxhash64("text_hash"), 64 - WANTED_BITS).alias("slot")), WANTED_BITS))

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        keep = hit(wanted.value, np.asarray(batch.column(1)).view(np.uint64), WANTED_BITS)
        if not keep.any():
            return None
        flat, counts = shingles(texts_of(batch.column(0).filter(pa.array(keep))))
        return {"sig": pa.array(signatures(flat, counts)), "s": lists(flat.view(np.int64), counts, pa.int64())}

    texts = docs.select("text", F.xxhash64(F.xxhash64("text")).alias("slot"))
    sets = rows_from(texts, kernel, T._parse_datatype_string("sig long, s array<long>"), "text", 1_000_000).groupBy("sig").agg(F.first("s").alias("s"))
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("sig").alias("b"), F.col("s").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(WHOLE * shared >= PART * (F.size("s_a") + F.size("s_b"))).select("a", "b")


def _long(lists_: DataFrame) -> DataFrame:
    """Postings of lists of more than DRAWN; in shorter ones all pairs are few."""
    return lists_.join(lists_.groupBy("h").agg(F.count("*").alias("k")).where(f"k > {DRAWN}").select("h"), "h", "left_semi")


def _open(lists_: DataFrame, first: DataFrame, reps: DataFrame) -> DataFrame:
    """sig, c (its component), n, sketch, taken (how many first shingles), end (the last of them) and hs: those that other components have, too, in the common order, with the lengths of their lists and their places."""
    flipped = lambda x: x.bitwiseXOR(F.lit(-(2**63)))  # noqa: E731  unsigned order
    known = lists_.select("h", "sig", "p").join(first.withColumnRenamed("node", "sig"), "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component")
    mixed = known.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")).where("low <> high").select("h", "k")
    open_ = known.join(mixed, "h").groupBy("sig").agg(F.first("c").alias("c"), F.sort_array(F.collect_list(F.struct(flipped(F.col("h")).alias("h"), "k", "p"))).alias("hs"))
    return checkpointed(open_.join(reps.select("sig", "n", "sketch", F.size("first").alias("taken"), flipped(F.try_element_at("first", F.lit(-1))).alias("end")), "sig"))


def _postings(open_: DataFrame) -> DataFrame:
    """h, k, class (of size), sig, c, n, sketch (in lists of more than DRAWN only, as it is wide) and room: what a set has from a shingle on, in the common order.

    A pair is met in the list of the first shingle that it shares: nothing before it is shared, so there both rooms must be enough to link with a
    set of the other's size.
    """
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(CLASS))).cast("int")
    rows = open_.select("sig", "c", "n", "sketch", size.alias("class"), F.explode("hs").alias("x"))
    return rows.select("x.h", "x.k", "class", "sig", "c", "n", F.when(F.col("x.k") > DRAWN, F.col("sketch")).alias("sketch"), (F.col("n") - F.col("x.p")).alias("room")).where("4 * room >= 3 * n")


def _drawn(open_: DataFrame) -> DataFrame:
    """a, b: each set of an open list with one of about DRAWN of its list, where the two may link. As many pairs as postings at most."""
    rows = _postings(open_).withColumn("part", F.pmod(F.xxhash64("sig", "h"), F.ceil(F.col("k") / DRAWN)))
    lead = rows.groupBy("h", "part").agg(F.min(F.struct(F.xxhash64("h", "sig").alias("o"), F.col("sig").alias("b"), F.col("c").alias("c_b"), F.col("n").alias("n_b"), F.col("room").alias("room_b"), F.col("sketch").alias("sketch_b"))).alias("lead"))
    both = rows.join(lead, ["h", "part"]).select("sig", "c", "n", "room", "sketch", "lead.*")
    return both.where(f"c <> c_b and 4 * least(n, n_b) >= 3 * greatest(n, n_b) and {MAY_LINK}").select(F.least("sig", "b").alias("a"), F.greatest("sig", "b").alias("b")).distinct()


def _across(open_: DataFrame) -> DataFrame:
    """a, b: pairs of sets of different components that may link. Lists are split by classes of size."""
    rows = _postings(open_)
    shorter = rows.where(f"{WHOLE} * room >= {2 * PART} * n")
    longer = rows.select("h", F.explode(F.array("class", F.col("class") - 1)).alias("class"), F.col("sig").alias("b"), F.col("c").alias("c_b"), F.col("n").alias("n_b"), F.col("room").alias("room_b"), F.col("sketch").alias("sketch_b"))
    fits = F.expr(f"c <> c_b and (n < n_b or n = n_b and sig < b) and 4 * n >= 3 * n_b and {MAY_LINK}")
    pairs = shorter.join(longer, ["h", "class"]).where(fits).select(F.col("sig").alias("a"), "b").distinct()
    # all shared shingles up to where the first of the two prefixes ends are known, and beyond it that set has n - taken more
    side = lambda x: open_.select(F.col("sig").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in ("n", "taken", "end")), F.col("hs.h").alias(f"hs_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    left = F.expr("case when end_a < end_b then n_a - taken_a when end_a > end_b then n_b - taken_b else least(n_a - taken_a, n_b - taken_b) end")
    return both.where(WHOLE * (F.size(F.array_intersect("hs_a", "hs_b")) + left) >= PART * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def join(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of a frame with doc_id and text: the smallest doc_id that links reach, itself included.

    Rows that repeat a doc_id are documents of their own; a null doc_id gets the smallest id of the others that links reach, if any.
    """
    found = groups(df)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def groups(df: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, component (a number for each group; null: no shingle) and component_id (its smallest doc_id) of each row."""
    prepare(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = checkpointed(_sets(docs, frequent(docs)))
    reps = checkpointed(sets.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("first").alias("first"), F.first("small").alias("small")))
    lists_ = checkpointed(_lists(reps.where("size(first) > 0").select(F.posexplode("first").alias("p", "h"), "sig", "n", "rare").select("h", "sig", "n", "rare", "p")))
    fits = lambda a, b: (4 * F.least(a, b) >= 3 * F.greatest(a, b))
    size = reps.select(F.col("sig").alias("lead"), F.col("n").alias("lead_n"))
    near = lists_.where("sig <> lead").groupBy("sig", "lead").agg(F.first("n").alias("n"), F.count("*").alias("shared")).join(size, "lead").where(fits("n", "lead_n"))
    # only to save comparisons: what this drops is looked at again below
    near = near.where(5 * F.col("shared") >= F.least("n", "lead_n") - (3 * F.least("n", "lead_n") + 3) / 4 + 1)
    links = _small_links(reps).unionByName(_verified(docs, reps, checkpointed(near.select(F.col("sig").alias("a"), F.col("lead").alias("b")))))
    links = checkpointed(links)
    first = components(links)
    # A group of near copies is not always joined by one member of its lists, so open lists are held against several, drawn by hash, ...
    links = checkpointed(links.unionByName(_verified(docs, reps, checkpointed(_drawn(_open(_long(lists_), first, reps))))))
    first = components(links)
    # ... and then only members of different components are compared, pair by pair.
    rest = checkpointed(_across(_open(lists_, first, reps)))
    more = checkpointed(_verified(docs, reps, rest)) if rest.head(1) else None
    if more is not None and more.head(1):
        first = components(links.unionByName(more))
    whole = reps.select("sig", "least").join(first.withColumnRenamed("node", "sig"), "sig", "left").withColumn("c", F.coalesce("component", "sig"))
    named = whole.join(whole.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("sig", F.col("c").alias("component"), "component_id")
    return sets.select("doc_id", "text_hash", "n", "sig").join(named, "sig", "left").drop("sig")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each group of linked documents: the one of the smallest doc_id (null last; then by a hash of the text).

    Rows with empty sets stay, each; of rows that repeat id and text one stays if they hold a shingle.
    """
    keys = {"_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_k2": F.xxhash64("text")}
    docs = df.withColumns(keys)
    found = checkpointed(groups(docs.select(F.col("_k1").alias("doc_id"), "text")))
    chosen = found.where("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("_k1"), F.col("k.text_hash").alias("_k2"))
    many = found.where("n > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).select(F.col("doc_id").alias("_k1"), F.col("text_hash").alias("_k2"), "rows")
    chosen = chosen.join(many, ["_k1", "_k2"])
    empty = found.where("n = 0").select(F.col("doc_id").alias("_k1"), F.col("text_hash").alias("_k2"), F.lit(0).cast("long").alias("rows")).distinct()
    kept = docs.join(chosen.unionByName(empty), ["_k1", "_k2"])
    again = kept.where("rows > 1").dropDuplicates(["_k1", "_k2"])
    return kept.where("rows < 2").unionByName(again).select(*df.columns)
