"""Models and searches against plain versions of themselves, and what each operator does with odd frames."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import ann, common, jaccard, language, quality, substrings, topk, toxicity
from tests.llm.test_operators import by_hand, prose

# ---- vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5, 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score double, code int").repartition(3)


def repeated_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [rows[0], rows[7], rows[7], (8, [9.0] * 6), (50, [-9.0] * 6), (61, [0.0] * 6), (100, None), (None, [1.0] * 6), (150, [float("inf")] * 6)]
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(map(math.isfinite, v)):
            held[i] = min(held.get(i, v), v)
    return rows, held


def test_repeated_ids_count_once_and_other_columns_do_not_matter(spark):
    rows, held = repeated_rows()
    near = ann.nonzero(frame(spark, rows))
    got = ann.nearest(near, near.where("vec_id % 50 = 0"), probes=10**6).orderBy("query_id", "rank").collect()
    for q in (0, 50):
        x = {i: np.array(v) for i, v in held.items() if any(v)}
        score = {i: float(v @ x[q] / math.sqrt((v @ v) * (x[q] @ x[q]))) for i, v in x.items() if i != q}
        assert [r.vec_id for r in got if r.query_id == q] == sorted(score, key=lambda i: (-score[i], i))[:5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in got if r.query_id == q)
    whole = topk.integers(frame(spark, rows))
    got = topk.top_k(whole, whole.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    ints = {i: [math.floor(256 * c) for c in v] for i, v in held.items()}
    for q in (0, 50):
        score = {i: sum(a * b for a, b in zip(v, ints[q], strict=True)) for i, v in ints.items() if i != q}
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:5]]


def test_searches_of_nothing(spark):
    none = frame(spark, []).where("false")
    some = frame(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])
    assert ann.nearest(ann.nonzero(none), ann.nonzero(none)).count() == 0 and topk.top_k(topk.integers(none), topk.integers(none)).count() == 0
    assert ann.nearest(ann.nonzero(none), ann.nonzero(some)).count() == 0
    assert [(r.query_id, r.vec_id) for r in ann.nearest(ann.nonzero(some), ann.nonzero(some).where("vec_id = 0")).collect()] == [(0, 1)]


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(-(2**38), 2**38)) for _ in range(5)]) for i in range(40)]
    whole = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(whole, whole.where("vec_id = 0")).orderBy("rank").collect()
    ints = [[256 * int(c) for c in v] for _, v in rows]
    score = {i: min(max(sum(a * b for a, b in zip(v, ints[0], strict=True)), -(2**63)), 2**63 - 1) for i, v in enumerate(ints) if i}
    assert [(r.vec_id, r.score) for r in got] == [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:5]]


def test_cells_bound_from_above():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 7)) * 50, rng.standard_normal((9, 7)) * 50
    cells = topk.Cells(x.min(axis=0), x.max(axis=0))
    code, limits = cells.code(x), cells.limits(q)
    bound = sum(limits[:, j][:, code[:, j]] for j in range(code.shape[1]))
    assert code.dtype == np.uint8 and code.shape == (500, 4) and (bound >= q @ x.T - 1e-9).all()
    assert np.mean(bound - q @ x.T) < 0.5 * np.mean(np.abs(q) @ np.abs(x).T)


def test_recall_on_the_real_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = ann.nonzero(table)
    got = defaultdict(set)
    for r in ann.nearest(rows, rows.where("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    held = sorted((r.vec_id, r.v) for r in rows.collect())
    ids, x = np.array([i for i, _ in held]), np.array([v for _, v in held])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = wanted = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        best = set(ids[np.argsort(-score, kind="stable")[:5]].tolist())
        found, wanted = found + len(best & got[int(ids[i])]), wanted + len(best)
    assert found >= 0.9 * wanted, found / wanted


# ---- Jaccard


def test_components_that_share_frequent_shingles(spark, monkeypatch):
    """Texts of a few common passages, which share much and link seldom: shingles at all levels of frequency, all sizes."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    random.seed(21)
    passages = [prose(random.randint(12, 30)) for _ in range(7)]
    rows = []
    for i in range(170):
        parts = random.sample(passages, random.randint(1, 4))
        if random.random() < 0.6:
            parts.append(" ".join(f"own{i}x{k}" for k in range(random.randint(1, 9))))
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, f"{t} more") for i, t in rows[:20]]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = by_hand(rows)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == want
    assert len({c for *_, c in want}) > 20


def test_jaccard_ignores_extra_columns(spark):
    text = prose(30)
    odd = spark.createDataFrame([(1, text, 1, "a", 2), (2, text, 1, "a", 2)], "doc_id long, text string, sig int, component_id string, n int")
    assert sorted(tuple(r) for r in jaccard.join(odd).select("doc_id", "component_id").collect()) == [(1, 1), (2, 1)]
    assert jaccard.deduplicate(odd).columns == odd.columns and jaccard.deduplicate(odd).count() == 1


# ---- suffix expansion


@pytest.mark.parametrize("length", [1, 3, 10, 64, 200])
def test_expansion_from_the_first_byte(length):
    rng = random.Random(length)
    base = bytes(rng.choice(b"abc \xc3") for _ in range(400))
    parts = []
    for _ in range(14):
        a = rng.randrange(300)
        t = bytearray(base[a : a + rng.randrange(1, 100)] * rng.choice((1, 1, 5)))
        if t and rng.random() < 0.7:
            t[rng.randrange(len(t))] = 100
        parts.append(bytes(t))
    data = b"\xff".join([*parts, b"a" * 700, b""])
    order, same = substrings.repeated(np.frombuffer(data + b"\xff" * 264, dtype=np.uint8), length)
    twice = same.copy()
    twice[:-1] |= same[1:]
    count = Counter(data[i : i + length] for i in range(len(data) - length + 1))
    whole = lambda i: i + length <= len(data) and b"\xff" not in data[i : i + length]
    assert {int(i) for i in order[twice] if whole(i)} == {i for i in range(len(data)) if whole(i) and count[data[i : i + length]] > 1}


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "POSITION", np.uint64((1 << 13) - 1))  # texts are cut into parts as those of many megabytes are
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(9_000)) + shared, shared + "".join(rng.choice("ijkl ") for _ in range(30_000)), "x" * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    from tests.llm.test_operators import removed_by_hand

    got = substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in got] == removed_by_hand([t.encode() for t in texts], substrings.LENGTH)


@pytest.mark.parametrize("length", [64, 65, 100, 200])
@pytest.mark.parametrize("salts", [1, 2])
def test_only_strings_that_may_repeat_are_transformed(length, salts, monkeypatch):
    """Near copies, and texts that share no more than a phrase: the transform gets little beyond what repeats, and nothing that repeats is lost."""
    rng = random.Random(length)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    phrase, texts = text(50), []
    for _ in range(60):
        texts.append(text(400) + phrase + text(400))
    for base in texts[:6]:
        for _ in range(3):
            near = bytearray(base)
            for _ in range(rng.randrange(1, 9)):
                near[rng.randrange(len(near))] = 120
            texts.append(bytes(near[rng.randrange(40) :]))
    of, first, many, h, place, *digest = substrings.anchored(texts, length)
    bytes_of = [texts[i][a : a + n + length - 1] for i, a, n in zip(of.tolist(), first.tolist(), many.tolist(), strict=True)]
    distinct = {*zip(h.view(np.int64).tolist(), bytes_of, place.tolist(), strict=True)}
    kinds = Counter(a for a, *_ in distinct)
    rows = [(a, 0, salts, d, b, p) for d, (a, b, p) in enumerate(sorted(distinct)) if kinds[a] > 1]
    transformed = []
    monkeypatch.setattr(substrings, "repeated", lambda data, length, f=substrings.repeated: (transformed.append(len(data)), f(data, length))[1])

    class Units:
        def mapInArrow(self, run, schema):
            return run

    def batches():
        columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["anchor", "salt", "salts", "digest", "bytes", "place"])

    out = [r for b in substrings._expanded(Units(), length)(batches()) for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
    count = Counter((a, b[i : i + length]) for a, _, _, _, b, _ in rows for i in range(len(b) - length + 1))
    want = {(a, d, i) for a, _, _, d, b, _ in rows for i in range(len(b) - length + 1) if count[a, b[i : i + length]] > 1}
    assert {(a, d, i) for a, d, x, y, s in out if s is None for i in range(x, y + 1)} == want and want
    if salts == 1:
        assert sum(transformed) < (0.7 if length > 65 else 0.9) * sum(len(r[4]) for r in rows) and not [r for r in out if r[4] is not None]
    else:  # strings of anchors that lie in several units are all told, once each
        assert len([r for r in out if r[4] is not None]) == len(count)
    assert len({*zip(h.tolist(), *(x.tolist() for x in digest), strict=True)}) == len(distinct)  # contents are told apart, and equal ones are not


# ---- models


def naive_kneser_ney(words, letters):
    """Probabilities of characters after three others, by dictionaries and the formula alone."""
    grams = Counter()
    for w in words:
        padded = "\0\0\0" + w + "\0"
        for i in range(3, len(padded)):
            grams[padded[i - 3 : i + 1]] += 1
    orders = []
    for _ in range(4):
        ones, twos = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
        discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        total, saved = Counter(), Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            saved[g[:-1]] += min(discount, c)
        orders.append((dict(grams), discount, total, saved))
        grams = Counter(g[1:] for g in grams)

    def p(gram, k=0):
        if k == 4:
            return 1 / letters
        counts, discount, total, saved = orders[k]
        context = gram[:-1]
        if not total[context]:
            return p(gram[1:], k + 1)
        c = counts.get(gram, 0)
        return (c - min(discount, c)) / total[context] + saved[context] / total[context] * p(gram[1:], k + 1)

    return p


def test_kneser_ney_is_the_formula():
    rng = random.Random(8)
    words = ["".join(rng.choice("aábcdéж漢") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    head, rest, _ = language.grams(words)
    a, b, at = language.within(head, rest)
    model = language.KneserNey(a, b, np.bincount(at), 50)
    p = naive_kneser_ney(words, 50)
    asked = ["bad", "жж", "zé漢x", "a"]
    head, rest, counts = language.grams(asked)
    want = []
    for w in asked:
        padded = "\0\0\0" + w + "\0"
        want += [-math.log2(p(padded[i - 3 : i + 1])) for i in range(3, len(padded))]
    assert np.allclose(model.bits(head, rest), want, atol=1e-5) and counts.tolist() == [len(w) + 1 for w in asked]


def test_discriminant_is_the_formula():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5)) + 3
    y = (x[:, 0] + rng.standard_normal(300) > 3).astype(int)
    model = quality.Discriminant(0.1, 0.2).fit(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    pooled = np.cov(z.T, bias=True)
    want = []
    for k in (0, 1):
        part = z[y == k]
        cov = 0.8 * np.cov(part.T, bias=True) + 0.2 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.maximum(np.diag(cov), 1e-2)) + 1e-3 * np.eye(5)
        gap = z - part.mean(axis=0)
        far = np.array([g @ np.linalg.solve(cov, g) for g in gap])
        want.append(math.log((len(part) + 1) / 302) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far)
    assert np.allclose(model.score(x), want[1] - want[0])


def test_trees_split_where_all_splits_say():
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((200, 4)), 1)
    y = (x[:, 2] * x[:, 1] > 0.2).astype(float)
    model = toxicity.Boosted().fit(x, y)
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    p = 1 / (1 + math.exp(-base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(model.edges, x.T, strict=True)])
    gain = {}
    for f in range(4):
        for cut in range(model.bins):
            left = binned[:, f] <= cut
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain[f, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + model.ridge) for s in (left, ~left))
    (feature, cut), *_ = [(f[0], c[0]) for f, c in model.trees[0][0]]
    assert gain[int(feature), int(cut)] >= max(gain.values()) - 1e-9
    slow = []
    for row in binned:
        total = model.base
        for splits, value in model.trees:
            node = 0
            for f, c in splits:
                node = 2 * node + (row[f[node]] > c[node])
            total += value[node]
        slow.append(total)
    assert np.allclose(model.score(x), slow) and np.mean((model.score(x) > 0) == (y > 0.5)) > 0.9


# ---- the pipeline on odd frames


def test_stages_with_odd_rows(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    random.seed(31)
    text = prose(90)
    rows = [(None, text, 1, "k"), (None, None, 2, "k"), (1, text, 3, "k"), (1, text, 3, "k"), (2, "", 4, "k"), (2, "another of the same id", 5, "k"), (3, " \n ", 6, "k"), (4, None, 7, "k"), (5, prose(4_000), 8, "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n int, kept string")
    for name, stage in corpus.STAGES[1:-1]:
        got = stage(spark, odd, "")
        assert got.columns == odd.columns, name
        assert {r.n for r in got.collect()} >= {2, 4, 6, 7}, name  # empty ones stay
        assert stage(spark, odd.where("false"), "").count() == 0, name
    packed = corpus.pack(spark, odd, "").collect()
    assert len({r.doc_id for r in packed}) == 6 and corpus.pack(spark, odd.where("false"), "").count() == 0


def test_only_texts_that_may_lose_bytes_are_brought_to_their_spans(spark):
    from tests.llm.test_operators import removed_by_hand

    rng = np.random.default_rng(9)
    word = lambda n: "".join(chr(97 + i) for i in rng.integers(0, 26, n))
    shared = word(300)
    texts = [word(900) for _ in range(60)] + [shared + word(50), word(40) + shared, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substrings.remove(frame)
    rows = {r.doc_id: r for r in got.collect()}
    assert [bytes(rows[i].kept) for i in range(len(texts))] == removed_by_hand([(t or "").encode() for t in texts], substrings.LENGTH)
    assert [i for i in rows if rows[i].removed] and got.columns == ["doc_id", "text", "kept", "removed"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("Join")[0]  # the texts that lose nothing go past the join


def test_what_is_checkpointed_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held() -> set[str]:
        files = manager.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("a")).agg(F.count("*").alias("n"))
    before = held()
    out = common.checkpointed(df)
    for _ in range(50):  # they go in the background
        if not (left := held() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == df.count() == 7


def python_steps(plan):
    """Python operators above the next exchanges, and the most that a task below them has: operators of one task have a worker each at once."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return python_steps(plan.executedPlan())
    if "QueryStage" in name:
        return python_steps(plan.plan())
    children = [python_steps(plan.children().apply(i)) for i in range(plan.children().size())]
    # tasks of a union run one of its sides
    own = (max if name.startswith("Union") else sum)([n for n, _ in children] or [0]) + ("Arrow" in name or "Python" in name)
    most = max([own, *(n for _, n in children)])
    return (0, most) if "Exchange" in name else (own, most)


def test_a_task_has_one_python_step(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_operators import removed_by_hand

    shared = " ".join(f"word{i}" for i in range(60))
    texts = [shared, "x " + shared, f"{shared} é", "short", None, *(" ".join(f"own{i}x{j}" for j in range(60)) for i in range(5))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for as_text in (False, True):
        got = substrings.remove(frame, as_text=as_text)
        kept = {r.doc_id: r.kept if as_text else bytes(r.kept) for r in got.collect()}
        want = removed_by_hand([(t or "").encode() for t in texts], substrings.LENGTH)
        assert [kept[i] for i in range(len(texts))] == ([x.decode("utf-8", "ignore") for x in want] if as_text else want)
        assert python_steps(got._jdf.queryExecution().executedPlan())[1] == 1
    got = corpus.drop_passages(spark, frame, "")
    got.collect()
    assert python_steps(got._jdf.queryExecution().executedPlan())[1] == 1


def test_a_query_whose_lists_hold_too_few_gets_all_its_neighbours(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((120, 16))
    x[0] = 0.0
    x[0, 0], x[1:, 0] = 9.0, -np.abs(x[1:, 0])  # far from all others, so alone in its list
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    for n, lists in ((120, 40), (4, 16), (1, 16)):
        rows = ann.nonzero(frame.where(f"vec_id < {n}"))
        got = defaultdict(list)
        for r in ann.nearest(rows, rows, lists=lists, probes=1).collect():
            got[r.query_id].append((r.rank, r.vec_id))
        for q in range(n):
            own = sorted(got[q])
            assert [r for r, _ in own] == list(range(1, min(5, n - 1) + 1)) and len({v for _, v in own} - {q}) == len(own)
