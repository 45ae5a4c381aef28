"""The training-data operators against brute force, round trips and libraries, on small frames with all kinds of odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import ann, bpe, jaccard, language, linededup, packing, quality, substrings, topk, toxicity, vectors
from emberline.llm.bpe import ByteBpe

random.seed(11)
WORDS = [f"w{i}" for i in range(60)] + ["über", "été", "漢字", "don't", "X1"]
SCHEMA = "doc_id long, text string, score double, kept string, ids string"


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def odd_rows():
    base = prose(120)
    near = base.split()
    near[50] = "changed"
    shared = prose(70)
    lines = "\n".join(prose(6) for _ in range(8))
    texts = [None, "", " \n\t ", "a", "one two", base, base, " ".join(near), prose(30) + " " + shared + " " + prose(20), prose(9) + " " + shared, lines, "x\n" + lines + "\ny", "=" * 3000, "ab " * 900, "é" * 700, prose(3000), "one two", "\x85\x1c|￿", shared[:150]]
    rows = [(i, t, 0.5, "k", "i") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, None, None), (None, None, None, None, None), (5, "another text of the same id", 0.1, "", "")]


ROWS = odd_rows()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


def test_bpe_rows(odd, empty, reference):
    for r in bpe.decode(bpe.encode(odd)).collect():
        assert list(r.ids) == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(empty)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_any_text(own, reference, texts):
    ids, counts = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "xyzzy" * 700, "=-" * 900])
def test_bpe_long_pieces(own, reference, text):
    assert own.encode([text])[0].tolist() == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÉéß's 1-\x85\x1cİΣσ<|endoftext>漢\n", max_size=40), max_size=6))
def test_word_tokens_are_the_tokenizers(texts):
    w = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    assert [x.tolist() for x in w.encode(texts)] == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.pack(odd.where("doc_id is not null and doc_id <> 5")).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, np.frombuffer(r.tokens, "<u4").tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text, *_ in ROWS:
        if i is not None and i != 5:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
            assert [x for _, part, _ in sorted(docs[i]) for x in part] == ids and {n for *_, n in docs[i]} == {len(ids)}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack(empty).count() == 0


def test_differencing_is_even():
    sizes = [random.randint(1, 512) for _ in range(2000)]
    dealt = packing.differencing(sizes, 250)
    assert sorted(i for _, part in dealt for i in part) == list(range(2000)) and all(n == sum(sizes[i] for i in part) for n, part in dealt)
    assert max(n for n, _ in dealt) - min(n for n, _ in dealt) < 60
    assert all(sum(sizes[i] for i in part) <= 600 for part in packing.windows(sizes, 600))


def removed_by_hand(texts, length):
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("unit", [512, 2])
def test_substrings(odd, empty, unit, monkeypatch):
    monkeypatch.setattr(substrings, "UNIT", unit)
    rows = substrings.remove(odd).collect()
    assert len(rows) == odd.count()
    assert [bytes(r.kept) for r in rows] == removed_by_hand([(r.text or "").encode() for r in rows], substrings.LENGTH)
    assert substrings.remove(empty).count() == 0


def test_expansion_on_a_block():
    data = b"\xff".join([b"abcabcabcabc" * 3, b"xabcabcabcy", b"abd" * 9])
    text = np.frombuffer(data + b"\xff" * 264, dtype=np.uint8)
    order, same = substrings.repeated(text, 10)
    twice = same.copy()
    twice[:-1] |= same[1:]
    found = {int(i) for i in order[twice] if i + 10 <= len(data) and b"\xff" not in data[i : i + 10]}
    count = Counter(data[i : i + 10] for i in range(len(data) - 9))
    assert found == {i for i in range(len(data) - 9) if b"\xff" not in data[i : i + 10] and count[data[i : i + 10]] > 1}


def by_hand(rows):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    low = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
    sets = []
    for _, text in rows:
        w = word.findall((text or "").encode().translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if up[j] == up[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_jaccard(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    base = prose(60).split()
    for i in range(60):  # copies with more and more changes, and short texts around the boundary of the two ways
        copy = list(base)
        for _ in range(i % 6):
            copy[random.randrange(len(copy))] = random.choice(WORDS)
        rows.append((1000 + i, " ".join(copy[: random.choice((60, 60, 55, 50))])))
        rows.append((2000 + i, " ".join(base[: random.randint(1, 22)])))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == by_hand(rows)
    assert jaccard.join(empty).count() == 0


def test_one_of_each_group_stays(odd):
    kept = jaccard.deduplicate(odd)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == odd.columns
    texts = [t for _, t in rows if t and t.strip()]
    assert len(texts) == len(set(texts)) and sum(not (t or "").strip() for _, t in rows) == sum(not (r[1] or "").strip() for r in ROWS)


def test_line_dedup(spark, odd, empty):
    block = [f"line {i} of a block" for i in range(5)]
    rows = [(1, "\n".join(["a", *block, "b"])), (2, "\n".join(["c", *block, "d"])), (3, "\n".join(block[:2] + ["e"])), (4, "\n".join(["same"] * 9)), (5, None), (6, "")]
    got = {r.doc_id: r for r in linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept == rows[0][1] and got[2].kept == "c\nd" and got[2].n_removed == 5 and got[2].n_runs == 1
    assert got[3].kept == rows[2][1] and got[4].kept == "same" and got[5].kept is None and got[6].kept == ""
    assert linededup.remove(odd).count() == odd.count() and linededup.remove(empty).count() == 0


def test_long_lines_repeat_alone(spark):
    long = "one line of more than forty bytes that is copied"
    rows = [(0, long), (1, long), (2, f"p\n{long}\nq"), (3, "u\nv\nw"), (4, "k\nu\nv\nw\nl"), (5, "u\nv"), (6, "u\nv")]
    got = linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [long, "", "p\nq", "u\nv\nw", "k\nl", "u\nv", "u\nv"]


def test_ends_of_a_run_within_a_longer_copy(spark):
    x = [f"{c} 5" for c in "vwxyz"]  # of these shingles, winnowing by 3 lines and 2 shingles keeps the middle one alone
    rows = [(1, "\n".join(["p", *x[1:4], "q"])), (2, "\n".join(x)), (3, "\n".join(["r", *x, "s"]))]
    got = linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [rows[0][1], "v 5\nz 5", "r\ns"]


def lines_by_hand(rows):
    """Kept text of rows, from all pairs of runs: a line goes if it lies in a long run that occurs earlier."""
    lines = {i: [x.strip() for x in (t or "").split("\n") if x.strip()] for i, t in rows}
    out = []
    for i, t in rows:
        gone, own = set(), lines[i]
        for j in (x for x in lines if x <= i):
            for a in range(len(own)):
                for b in range(len(lines[j]) if j < i else a):
                    n = 0
                    while a + n < len(own) and b + n < len(lines[j]) and own[a + n] == lines[j][b + n]:
                        n += 1
                        if n >= 3 or len("".join(own[a : a + n]).encode()) >= 40:
                            gone.update(range(a, a + n))
        at, left = 0, []
        for x in (t or "").split("\n"):
            if not x.strip() or at not in gone:
                left.append(x)
            at += bool(x.strip())
        out.append((i, t if not gone else "\n".join(left), len(own), len(gone), sum(k in gone and k - 1 not in gone for k in range(len(own)))))
    return out


def line_rows(n):
    """Texts of few distinct lines of all lengths, so that runs repeat in many ways."""
    rng = random.Random(5)
    pool = ["}", "a", "return 0", "é" * 12, "x" * 19, "y" * 20, "z" * 21, "w" * 39, "v" * 40, "漢字" * 9, "ein langer Satz, der allein schon zählt, weil er lang ist"]
    rows = []
    for i in range(n):
        own = [f"{rng.choice(('', ' ', chr(9)))}{rng.choice(pool) if rng.random() < 0.7 else f'own {i} {k}'}" for k in range(rng.randint(0, 9))]
        if i > 3 and rng.random() < 0.6:
            k = rng.randrange(len(own) + 1)
            own[k:k] = rng.choice(rows)[1].split("\n")[rng.randint(0, 3) :][: rng.randint(1, 6)]
        rows.append((i, "\n".join(x for y in own for x in ([y, " "] if rng.random() < 0.1 else [y]))))
    return [*rows, (n, "")]


def test_line_dedup_is_exact(spark):
    long = "one line of more than forty bytes that is copied"
    x = [f"l{i}" for i in range(5)]
    rows = [(0, long), (1, f"p\n{long}\nq"), (2, "\n".join(["p", *x[1:4], "q"])), (3, "\n".join(x)), (4, "\n".join(x)), (5, "l0\nl1"), (6, "l0\nl1"), (7, f"u\n{long}\nq\nv")]
    for given_rows in (rows, line_rows(150)):
        got = linededup.remove(spark.createDataFrame(given_rows, "doc_id long, text string").repartition(3)).orderBy("doc_id")
        assert [tuple(r) for r in got.select("doc_id", "kept", "n_lines", "n_removed", "n_runs").collect()] == lines_by_hand(given_rows)
    assert [k for _, k, *_ in lines_by_hand(rows)] == [long, "p\nq", "p\nl1\nl2\nl3\nq", "l0\nl4", "", "l0\nl1", "l0\nl1", "u\nv"]


@pytest.fixture(scope="module")
def vectors_frame(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24))
    x[100:250] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, None), (650, []), (700, [float("nan")] * 24), (750, [0.0] * 24), (800, [1.0] * 7), (None, [1.0] * 24), (850, [None] * 24), (900, [float("inf")] * 24)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), x


def test_top_k(vectors_frame):
    frame, x = vectors_frame
    rows = topk.integers(frame)
    got = defaultdict(list)
    for r in topk.top_k(rows, rows.where("vec_id % 50 = 0 and size(v) = 24")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = np.vstack([np.floor(256 * x), np.zeros((1, 24))]).astype(np.int64)
    ids = [*range(600), 750]
    for q in range(0, 600, 50):
        score = ints @ ints[q]
        assert got[q] == [(ids[i], int(score[i])) for i in sorted((i for i in range(601) if i != q), key=lambda i: (-score[i], ids[i]))[:5]]
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_neighbours(vectors_frame):
    frame, x = vectors_frame
    rows = ann.nearest(ann.nonzero(frame), ann.nonzero(frame).where("vec_id % 50 = 0 and size(v) = 24")).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = 0
    for q in range(0, 600, 50):
        score = np.round(unit @ unit[q], 12)
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert len(own) == 5 and all(abs(s - float(unit[v] @ unit[q])) < 1e-12 for _, v, s in own)
        found += len(set(want) & {v for _, v, _ in own})
    assert found >= 0.9 * 60
    assert vectors.usable(frame).count() == 602


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    held = language.predict(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2), model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    for r in language.predict(odd, model).collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r.text
    none = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"} and language.predict(empty, model).count() == 0


def test_languages_known_from_set_aside_texts_alone(spark):
    ids = spark.range(2000).select("id", (F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(language.ASIDE)) == 0).alias("aside")).collect()
    aside, others = [r.id for r in ids if r.aside], [r.id for r in ids if not r.aside]
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs", "en") for i in [*aside[1:9], *others[:30]]]
    rows.append((aside[0], "szybki brązowy lis przeskoczył nad leniwym psem", "pl"))
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["en", "pl"]
    assert model.predict(["leniwym psem przeskoczył", "the lazy dog"])[0] == ["pl", "en"]


def test_languages_that_share_a_script(spark):
    han = [chr(0x4E00 + 37 * i) for i in range(400)]  # one class modulo 37
    rng = random.Random(2)
    texts = {"xa": han[:200], "xb": han[200:], "cs": ["čas", "tečka", "oči"], "fr": ["èas", "teèka", "oèi"]}
    rows = [(lang, " ".join("".join(rng.choices(pool, k=3)) if lang < "y" and lang > "x" else rng.choice(pool) for _ in range(30))) for lang, pool in texts.items() for _ in range(60)]
    frame = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(frame, F.col("doc_id") % 2 == 0)
    assert model.predict([t for _, t in rows[1::2]])[0] == [lang for lang, _ in rows[1::2]]


def test_models_have_a_bound_that_grows(spark, monkeypatch):
    rows = [("en", i, 0, 1 + 7 * (i < 5), 1) for i in range(40)] + [("fr", 1, 0, 1, 1)]
    counts = spark.createDataFrame(rows, "lang string, head int, rest long, n long, held long")
    assert language._bounded(counts).count() == 41 and language.most_grams(1e10) > language.most_grams(1e8) > 2**24
    monkeypatch.setattr(language, "most_grams", lambda n: 6)
    assert sorted(tuple(r) for r in language._bounded(counts).collect()) == sorted(r for r in rows if r[0] == "fr" or r[3] == 8)


@pytest.mark.parametrize(("module", "label", "mod"), [(toxicity, "toxic", 3), (quality, "quality", 4)])
def test_classifiers(spark, odd, empty, module, label, mod):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != 1)
    rows = module.score(docs.join(labels, "doc_id"), model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 1).select(label, "score", "predicted").collect()
    ones, zeros = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
    assert sum(r.predicted for r in ones) >= 0.85 * len(ones) and sum(r.predicted for r in zeros) <= 0.03 * len(zeros) + 3
    assert all(0 <= r.score <= 1 for r in module.score(odd, model).collect()) and module.score(empty, model).count() == 0
    module.score(odd, module.fit(docs.limit(0), labels.limit(0), F.lit(True))).count()


def test_isotonic_and_folds(spark):
    from emberline.llm.common import fold
    from emberline.llm.words import isotonic

    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == 0.5
    assert spark.range(1).select(fold(F.lit(17), 3)).first()[0] == zlib.crc32(b"17") % 3
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(b""), 256)).first()[0]


def test_pipeline(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus.STAGES[1:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
    assert corpus.run(spark, "/root/testdata/sf0.001").count() > 0


def pack_by_hand(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}


def test_pipeline_rows_by_hand(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    shared, long = prose(80), "one line of more than forty bytes that is copied"
    rows = line_rows(40)
    rows += [(100, prose(60)), (101, f"a b\n{shared} c"), (102, f"{prose(60)} {shared} {prose(60)}"), (103, f"\n{long}\n\n"), (104, f" \n\n{long}\n"), (105, long), (106, None), (107, " \n")]
    rows += [(110, f"{rows[41][1]} and one more"), (111, f"{rows[41][1]} and two more")]
    frame = lambda x: spark.createDataFrame([(i, t, len(t or "")) for i, t in x], "doc_id long, text string, n_chars int").repartition(3)
    full = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=repr)
    sized = lambda x: sorted(((i, t, None if t is None else len(t)) for i, t in x), key=repr)
    left = lambda before, kept: [(i, None if t is None else k) for (i, t), k in zip(before, kept, strict=True) if (k or "").strip() or not (t or "").strip()]

    lined = left(rows, [k for _, k, *_ in lines_by_hand(rows)])
    assert full(corpus.drop_lines(spark, frame(rows), "")) == sized(lined)
    assert not {104, 105} & {i for i, _ in lined} and {103, 106, 107} <= {i for i, _ in lined}

    component = {i: (n, c) for i, n, c in by_hand(lined)}
    single = [(i, t) for i, t in lined if not component[i][0] or component[i][1] == i]
    assert [(i, t) for i, t, _ in full(corpus.drop_near_duplicates(spark, frame(lined), ""))] == sorted(single, key=repr) and len(single) < len(lined)

    cut = left(single, [x.decode("utf-8", "ignore") for x in removed_by_hand([(t or "").encode() for _, t in single], substrings.LENGTH)])
    assert full(corpus.drop_passages(spark, frame(single), "")) == sized(cut) and cut != single

    parts = defaultdict(list)
    for r in corpus.pack(spark, frame(cut), "").collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.tokens, "<u4").tolist()))
    assert {i: [x for _, p in sorted(found) for x in p] for i, found in parts.items()} == pack_by_hand(cut)


def test_pipeline_chains_its_stages(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus.drop_toxic(spark, docs, folder)
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    assert rows == sorted((r.doc_id, r.text) for r in toxicity.score(docs, model).collect() if not r.predicted)
    rows = [(i, k) for (i, t), (_, k, *_) in zip(rows, lines_by_hand(rows), strict=True) if k.strip() or not t.strip()]
    component = {i: (n, c) for i, n, c in by_hand(rows)}
    rows = [(i, t) for i, t in rows if not component[i][0] or component[i][1] == i]
    kept = [x.decode("utf-8", "ignore") for x in removed_by_hand([t.encode() for _, t in rows], substrings.LENGTH)]
    want = pack_by_hand([(i, k) for (i, t), k in zip(rows, kept, strict=True) if k.strip() or not t.strip()])
    parts = defaultdict(list)
    for r in corpus.run(spark, folder).collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.tokens, "<u4").tolist()))
    assert {i: [x for _, p in sorted(found) for x in p] for i, found in parts.items()} == want
