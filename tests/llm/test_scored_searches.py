"""Positive-unlabelled quality, K2-treap search and periodic runs against brute force, with nulls,
empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import k2search, periodic, pu_quality

WORDS = "the of and thing river stone light carry seven window garden market winter silver table ocean".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


TEXTS = [
    (1, "short"), (2, None), (3, ""), (4, "   \n\t "), (5, prose(5, 300)), (6, prose(5, 300)), (7, prose(7, 60) + " " + prose(5, 20)),
    (8, "A\x0bb 　c\xa0d\n\nA\x0bb"), (9, "word " * 4000), (10, "x" * 20000), (None, "no id here"), (None, None), (5, prose(5, 300)),
    (11, "one two three four " * 3), (12, "a b " * 6 + "c " * 12 + prose(3, 30)), (13, "Stone-light, STONE light_7!"), (20, prose(20, 400)), (30, prose(30, 9)), (14, prose(14, 3000)),
]
CLASH = "doc_id long, text string, lang string, term string, n_chars long, score double, good boolean, x string, rank long, item string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "t", 1, 0.5, True, "x", 3, "i") for d, t in TEXTS], CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


# -- ranked search -------------------------------------------------------------------------------

ITEMS = [(1, "stone light carry"), (2, None), (3, "!!"), (4, "word word STONE3 stone3 the5"), (5, "nowhere"), (6, prose(5, 40)), (4, "window1"), (None, "short short"), (7, "no id here river7")]


def term_list(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(texts, items, k):
    docs = [(d, Counter(term_list(t))) for d, t in texts]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(term_list(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, c in docs:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in terms.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,words,opened", [(20, 1 << 21, 48), (3, 500, 1)])
def test_search_equals_brute_force(spark, docs, empty, monkeypatch, k, words, opened):
    monkeypatch.setattr(k2search, "SHARD_WORDS", words)
    monkeypatch.setattr(k2search, "OPENED", opened)
    monkeypatch.setattr(k2search, "ITEM_BLOCK", 3)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in k2search.ranked(docs, items, k).collect()), key=repr)
    assert got == brute_search(TEXTS, ITEMS, k)
    assert k2search.ranked(empty, items, k).count() == 0 and k2search.ranked(docs, items.limit(0), k).count() == 0


def test_search_with_string_ids(spark):
    texts = [(f"d{i}", prose(i, 5 + i % 50)) for i in range(80)]
    items = [("q", prose(3, 12)), ("r", "stone1 stone2")]
    got = k2search.ranked(spark.createDataFrame(texts, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), 5).collect()
    want = [(q, i, d, s) for q, i, d, s in ((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got)]
    scores = brute_search([(i, t) for i, (_, t) in enumerate(texts)], items, 5)
    assert sorted((q, i, s) for q, i, _, s in want) == sorted((q, i, s) for q, i, _, s in scores)


@pytest.mark.parametrize("seed", range(6))
def test_treap_holds_its_cells_and_maxima(seed):
    rng = np.random.default_rng(seed)
    n_rows, n_columns = int(rng.integers(1, 200)), int(rng.integers(1, 60))
    cells = np.unique(rng.integers(0, n_rows * n_columns, 300))
    rows, columns = cells // n_columns, cells % n_columns
    tf, norms = rng.integers(1, 9, len(cells)), rng.integers(75, 400, n_columns)
    impact = k2search.impacts(tf, norms[columns])
    tree = k2search.Treap.build(rows, columns, tf, impact)
    tree = k2search.Treap.unpacked(tree.levels, *tree.packed())
    depth, inner, children = len(tree.levels) - 1, sum(tree.levels[:-1]), tree.first_children()
    for r, c, f in zip(rows.tolist(), columns.tolist(), tf.tolist()):
        node, least = 0, k2search.impacts(np.array(f), norms[c])
        for level in range(depth):
            assert tree.maxima[node].astype(int) * k2search.STEP >= least
            quadrant = 2 * (r >> (depth - 1 - level) & 1) + (c >> (depth - 1 - level) & 1)
            assert tree.masks[node] >> quadrant & 1
            node = children[node] + k2search.BELOW[tree.masks[node], quadrant]
        assert tree.frequencies[node - inner] == f
    assert tree.maxima[0] == -(-impact.max() // k2search.STEP) if depth else True


# -- periodic runs -------------------------------------------------------------------------------

def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc, text, rewrite):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if rewrite and doc is not None and n and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *first, hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("rewrite", [None, periodic.tiled])
def test_runs_equal_brute_force(docs, empty, rewrite):
    got = sorted((tuple(r)[:8] for r in periodic.periodic_runs(docs, rewrite).collect()), key=repr)
    texts = [(d, t) for d, t in TEXTS if d != 9]  # brute force is quadratic
    assert [r for r in got if r[0] != 9] == sorted((brute_row(d, t, rewrite) for d, t in texts), key=repr)
    long_one = next(r for r in got if r[0] == 9)
    assert long_one[1:6] == (1, 0, 4000, 1, 4_000_000)
    assert periodic.periodic_runs(empty).count() == 0
    assert periodic.periodic_runs(docs).where("doc_id = 11").first()["collapsed"] == "one two three four"


def test_splits_and_scan_on_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds, words = rng.randrange(0, 120), rng.choice([1, 2, 3, 5, 20, 60]), []
        while len(words) < n:
            if words and rng.random() < 0.3:
                a = rng.randrange(len(words))
                words += words[a:a + rng.randrange(1, 12)] * rng.randrange(1, 5)
            else:
                words.append(rng.randrange(kinds))
        ids = np.array(words[:n], np.int64)
        assert periodic.runs_of(ids) == brute_runs(words[:n])
        segments = periodic.split_singly(ids, 0, n) if n else []
        assert all((np.unique(ids[a:b], return_counts=True)[1] > 1).all() for a, b in segments)
        whole, stable = periodic.split_rounds(ids)
        assert not stable or whole == segments


@pytest.mark.parametrize("kind", ["equal", "peeled", "thirds"])
def test_run_work_grows_with_the_text(kind):
    def seconds(n):
        import time

        i = np.arange(n)
        ids = {"equal": i * 0, "peeled": i // 2 + 2 * (i % 2), "thirds": i % (n // 3)}[kind]
        start = time.perf_counter()
        periodic.runs_of(ids)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(64_000) < 60 * max(0.01, seconds(8_000))  # eight times the words


# -- quality -------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(w + "###" for w in prose(i, 60).split()) if bad else prose(i, 60).capitalize() + "."
        rows.append((i, text, "z", 1.0))
        if i % 2:
            labels.append((i, int(not bad), "t"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model, _ = pu_quality.fit(docs, known)
    assert 0.7 < model.prior < 0.9
    got = {r["doc_id"]: r for r in pu_quality.scored(docs, known).collect()}
    assert len(got) == 600 and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert sum(r["predicted"] == (d % 5 != 0) for d, r in got.items() if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in got.values())


def test_quality_cases(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1), (7, 1), (7, 0), (14, 1), (None, 1), (1, None), (20, 1), (12, 0)], "doc_id long, quality int")
    got = sorted((tuple(r) for r in pu_quality.scored(docs, labels).collect()), key=repr)
    assert len(got) == len(TEXTS) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.7) for r in got)
    assert len({r[2] for r in got if r[0] == 5}) == 1
    assert {r["_good_id"] for r in pu_quality.trusted(labels).collect()} <= {5, 14, 20}
    assert {r["score"] for r in pu_quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.scored(empty, labels).count() == 0


def test_risk_sums_equal_the_formula():
    rng = np.random.default_rng(2)
    x, good = rng.random((40, len(pu_quality.NAMES))), rng.random(40) < 0.4
    model = pu_quality.QualityModel(x.mean(0), x.std(0), rng.normal(size=len(pu_quality.NAMES) + 1), 0.5)
    d = len(model.weights)
    s = pu_quality.risk_sums(model, model.weights[None])(x, good)
    g = model.inputs(x) @ model.weights
    assert np.isclose(s[0], np.log1p(np.exp(g)).sum())
    assert np.allclose(s[1 + d + d * d:3 + d + d * d], [np.log1p(np.exp(-g[good])).sum(), np.log1p(np.exp(g[good])).sum()])
    e = 1e-5
    moved = pu_quality.risk_sums(model, (model.weights + e * np.eye(d)[3])[None])(x, good)
    assert np.isclose((moved[0] - s[0]) / e, s[4], rtol=1e-2)


# -- lines ---------------------------------------------------------------------------------------

def test_line_dedup_with_string_ids(spark):
    from folioscope.llm import linededup

    rows = [("a", "first line of text\nshared line here\nshort"), ("b", "shared line here\nSHARED LINE HERE \nown line of b"), (None, "own line of b\nshort")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (rows[0][1], 3, 0), "b": ("own line of b", 3, 2), None: ("short", 2, 1)}


def test_line_dedup_time_grows_with_the_lines(spark, tmp_path):
    import time

    from folioscope.llm import linededup

    def seconds(n):
        rows = [(d, "\n".join(f"a line of the log number {i}" for i in range(n))) for d in (1, 2)]
        path = str(tmp_path / f"log-{n}")
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
        start = time.perf_counter()
        assert linededup.deduplicated(spark.read.parquet(path)).agg({"n_dropped": "sum"}).first()[0] == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(80_000) < 10 * max(1.0, seconds(10_000))
