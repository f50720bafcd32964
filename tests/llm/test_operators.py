"""The corpus operators against brute force on small tables with nulls, empty and long texts,
ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from folioscope.llm import chat, decontam, html_extract, linededup, mixing, quality, simhash, tokencount, toxicity, wavelet

WORDS = "the of and thing river stone light carry seven window garden market winter silver table ocean".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


TEXTS = [
    (1, "short"), (2, None), (3, ""), (4, "   \n\t "), (5, prose(5, 300)), (6, prose(5, 300)), (7, prose(7, 60) + " " + prose(5, 20)),
    (8, "A\x0bb \u3000c\xa0d\n\nA\x0bb"), (9, "word " * 4000), (10, "x" * 20000), (None, "no id here"), (None, None), (5, prose(5, 300)), (12, "<|endoftext|> a  <|endoftext|>▁▁ y"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, score double, kind string, _key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 3}" if d != 3 else None, 1, 2, 3, 0.5, "k", "z") for d, t in TEXTS]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- chat ----------------------------------------------------------------------------------------

CONVERSATIONS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\</s> <\\/s> [INST][/INST] \\"), (1, 2, "user", "bye"),
    (2, 0, "user", None), (2, 0, "user", None), (3, 0, "assistant", ""), (3, None, None, "first"), (None, 1, "assistant", "x\n<s"),
    (4, 0, "a[INST]\nb", "role with marks"), (5, 0, "assistant", "one"), (5, 1, "assistant", "two"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*c, "e") for c in CONVERSATIONS], "conv_id long, turn long, role string, text string, example string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.prefix_examples(df)).collect()}
    for conv in {c[0] for c in CONVERSATIONS}:
        turns = sorted(((c[1] is not None, c[1] or 0, c[2] or "", c[3] or "") for c in CONVERSATIONS if c[0] == conv))
        spoken = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), hashlib.sha256(spoken.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.prefix_examples(df)
    assert examples.where("conv_id = 1").count() == 2 and examples.where("conv_id = 1 AND trainable").count() == 1
    assert examples.where("conv_id = 5 AND trainable").count() == 2
    assert chat.prefix_examples(df.limit(0)).count() == 0


# -- pages ---------------------------------------------------------------------------------------

PAGE = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><div class='top'><a href=x>Home</a></div><nav><li>Menu</nav>"
        "<div class=sidebar>Side</div><div><h1>Head &amp; {0}</h1><p>One <b>two<br>three</b><p>Four{1}</div><div class='x'>Same for all</div>"
        "<div id=comments><p>Nice</p></div><footer>Foot</footer></body></html>")


def test_pages(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(f"h{i}", f" n{i} {prose(i, 5)}")) for i in range(30)]
    odd = [(100, None, None), (101, "", ""), (102, "http://o.example", "<article><p>a<p>b &lt;c&gt; &am"), (103, "x", "<p>cut <a hre"), (104, "y", "no tags &copy;"),
           (105, "z", "<div>" * 3000 + "deep"), (106, "http://o.example", "<main><aside>no</aside><p>yes</p><form>f</form></main><p>out</p>")]
    df = spark.createDataFrame([(*p, "h") for p in pages + odd], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_extract.main_texts(df).collect()}
    assert len(got) == 37
    for i in range(30):
        assert got[i]["text"] == f"Head & h{i}\n\nOne two three\n\nFour n{i} {prose(i, 5)}"
    assert [got[i]["text"] for i in range(100, 107)] == ["", "", "a\n\nb <c> &am", "cut", "no tags ©", "deep", "yes"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.main_texts(df.limit(0)).count() == 0


ONE_ARTICLE = """<html><body><div class="x7">menu one</div><div class="r">c{n}</div><article><h1>Same</h1><section><div>A shared text in a box.</div>
<ul><li>item</li></ul><table><tr><td>cell</td></tr></table><p>End</p></section></article><script>track({n})</script></body></html>"""
IN_BOXES = """<html><body><div class="x7"><div>menu of all pages</div></div><div class="r">count {n}</div><div class="b"><div>{text}</div></div></body></html>"""


def test_pages_that_carry_one_article(spark):
    pages = [(i, f"http://one.example/{i}", ONE_ARTICLE.format(n=i)) for i in range(14)]
    shared = prose(1, 40)
    pages += [(100 + i, f"http://box.example/{i}", IN_BOXES.format(n=i, text=shared if i < 60 else prose(i, 40))) for i in range(80)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Same\n\nA shared text in a box.\n\nitem\n\ncell\n\nEnd" for i in range(14))
    assert all((shared if i < 60 else prose(i, 40)) in got[100 + i] and "menu" not in got[100 + i] for i in range(80))
    assert len({html_extract.page_nodes(p[2])[0] for p in pages}) == 1 + 1 + 20


# -- tokens --------------------------------------------------------------------------------------

def test_token_counts(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted([(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in TEXTS], key=repr)
    assert rows_of(tokencount.token_counts(docs, path)) == want
    assert tokencount.token_counts(empty, path).count() == 0


def test_wavelet_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = sorted(map(tuple, wavelet.round_trip(docs, path).collect()), key=lambda r: r[1])
    assert sorted(x[0] is None for x in got) == [x[0] is None for x in got]
    assert [x[0] for x in got if x[0] is not None] == sorted(d for d, _ in TEXTS if d is not None)
    assert [x[1] for x in got] == list(itertools.accumulate([0] + [x[2] for x in got[:-1]]))
    want = []
    for d, t in TEXTS:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((a, c, e) for a, _, c, e in got), key=repr) == sorted(want, key=repr)
    assert wavelet.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("n", [1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 70, n).astype("<u4")
    matrix = wavelet.WaveletMatrix(n, *wavelet.WaveletMatrix.build(ids))
    assert (matrix.ids() == ids).all()
    for i in {0, n // 2, n - 1}:
        assert matrix.access(i) == ids[i]
        assert matrix.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        spots = np.flatnonzero(ids == ids[i])
        assert [matrix.select(int(ids[i]), j) for j in range(len(spots))] == spots.tolist()
    assert matrix.count(200) == 0


# -- quality -------------------------------------------------------------------------------------

def test_measures_and_ablation(docs, empty):
    got = {r["doc_id"]: r for r in quality.decide(quality.ledger(docs)).collect()}
    assert len(got) == len({d for d, _ in TEXTS})
    assert (got[8]["n_words"], got[8]["n_dup_lines"], got[8]["word_chars"]) == (5, 0, 8)
    assert got[9]["n_repeat_words"] == 4000 and got[9]["base_failed"] and not got[9]["kept"]
    assert got[5]["kept"] and not got[2]["kept"] and got[2]["n_words"] == 0
    table = {(r["policy"], r["rule"]): r for r in quality.ablation(quality.ledger(docs)).collect()}
    assert table["base", "few_words"]["failed"] == sum(1 for _, t in TEXTS if len((t or "").encode().split()) < 50)
    assert quality.ledger(empty).count() == 0 and quality.ablation(quality.ledger(empty)).first()["kept"] == 0


# -- near duplicates -----------------------------------------------------------------------------

@pytest.mark.parametrize("hot", [4096, 3])
def test_links_and_components(spark, hot):
    rng = random.Random(4)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(25)]
    prints += [0, (1 << 64) - 1, 1 << 63]
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    near = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {tuple(r) for r in simhash.links(df, hot).collect()}
    assert got <= near and (hot == 3 or got == near)
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = dict(map(tuple, simhash.components(simhash.links(df, hot)).collect()))
    assert all(roots.get(s, s) == find(s) for s in signed)


def test_near_distinct(docs, empty):
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.near_distinct(docs).collect()), key=repr)
    prints = {}
    for d, t in TEXTS:
        prints.setdefault(simhash.fingerprint(t), []).append((d is None, d or 0))
    assert [d for d, _ in got] == sorted((None if min(v)[0] else min(v)[1] for v in prints.values()), key=repr)
    assert simhash.near_distinct(docs).columns == docs.columns
    assert simhash.near_distinct(empty).count() == 0 and simhash.near_clusters(empty).count() == 0


# -- decontamination -----------------------------------------------------------------------------

def test_masks_are_lossless():
    for low, high, masks in decontam.MASKS:
        for length in range(low, (high or low) + 1):
            window, least = decontam.needed(length)
            for lost in itertools.combinations(range(window), window - least):
                assert any(all(not (m[o] == "1" and s + o in lost) for o in range(len(m))) for m in masks for s in range(window - len(m) + 1))


def test_matches_equal_brute_force(spark, docs, empty):
    rng = random.Random(1)
    items = [(i, prose(900 + i, n)) for i, n in enumerate([40, 15, 14, 10, 7, 5, 4])] + [(50, None), (51, ""), (0, prose(900, 40)), (None, prose(950, 20))]
    texts = []
    for d in range(40):
        words = prose(2000 + d, 80).split()
        source = (items[d % 7][1] if d % 9 else items[-1][1]).split()
        changed = [w if rng.random() > 0.03 * (d % 8) else "zzz" for w in source]
        texts.append((d, " ".join(words[:30] + changed + words[30:])))
    df = spark.createDataFrame([(*t, "m") for t in texts] + [(None, texts[0][1], "m"), (77, None, "m")], "doc_id long, text string, mark string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, item int")
    want = {}
    for d, t in [*texts, (None, texts[0][1])]:
        ours = decontam.WORDS.findall(t.lower())
        for i, b in items:
            theirs = decontam.WORDS.findall((b or "").lower())
            if len(theirs) < decontam.SHORTEST:
                continue
            window, least = decontam.needed(len(theirs))
            for shift in range(-len(theirs), len(ours)):
                same = {q for q in range(len(theirs)) if 0 <= q + shift < len(ours) and ours[q + shift] == theirs[q]}
                low, high = max(0, -shift), min(len(theirs), len(ours) - shift)
                hit = {q for s in range(low, high - window + 1) if len(same & set(range(s, s + window))) >= least for q in same & set(range(s, s + window))}
                if hit:
                    want[d, i] = max(want.get((d, i), 0), len(hit))
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontam.matches(df, bench).collect()}
    assert got == want and want
    bad = {d for d, _ in want}
    assert {r["doc_id"] for r in decontam.clean(df, bench).collect()} == {77, *range(40)} - bad
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == len(TEXTS)


# -- mixing and lines ----------------------------------------------------------------------------

def test_mixing(docs, empty):
    shares = mixing.shares(docs).collect()
    assert len(shares) == len(TEXTS) and all(r["taken"] <= 3 * r["size"] for r in shares)
    total = sum(r["size"] for r in shares)
    goals = {(r["source_size"], r["target"]) for r in shares}
    assert sum(t for _, t in goals) == pytest.approx(total) and all(t <= 3 * s for s, t in goals)
    again = sorted(map(tuple, mixing.shares(docs.repartition(5)).collect()), key=repr)
    assert again == sorted(map(tuple, shares), key=repr)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").encode().split()) for r in out.collect()) == sum(r["taken"] for r in shares)
    assert mixing.shares(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_positions_follow_the_schedule(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", "w " * 10) for i in range(400)], "doc_id long, source string, text string")
    places = [p for r in mixing.shares(df).collect() for p in r["positions"]]
    assert len(places) and 0 <= min(places) and max(places) <= 1


def test_lines(docs, empty):
    texts = [(1, "Same Line Here\nx"), (2, " same line here\t\nown line of two"), (2, "own line of two"), (None, "SAME LINE HERE"), (3, None), (4, "short\nshort"), (5, "short")]
    df = docs.sparkSession.createDataFrame([(*t, 9) for t in texts], "doc_id long, text string, n_lines int")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.deduplicated(df).collect()), key=repr)
    want = [(1, "Same Line Here\nx", 2, 0), (2, "own line of two", 2, 1), (2, "own line of two", 1, 0), (None, "", 1, 1), (3, "", 1, 0), (4, "short\nshort", 2, 0), (5, "short", 1, 0)]
    assert got == sorted(want, key=repr)
    assert linededup.deduplicated(empty).count() == 0


# -- toxicity ------------------------------------------------------------------------------------

def test_maximal_segments_equal_brute_force():
    def brute(x):
        if not len(x):
            return []
        best = max(((sum(x[a:b]), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return brute(x[:a]) + [(best[0], a, b)] + [(s, p + b, q + b) for s, p, q in brute(x[b:])]

    rng = random.Random(3)
    for _ in range(200):
        x = [rng.uniform(-1, 0.8) for _ in range(rng.randrange(0, 25))]
        got = toxicity.maximal_segments(np.array(x))
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in brute(x)]


def test_toxic_documents(spark, empty):
    bad = ["grumlo", "vextar", "plonk"]
    rng = random.Random(5)
    rows, labels = [], []
    for d in range(900):
        toxic = d % 6 == 0
        words = prose(d, rng.randrange(20, 80)).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + ",")
        rows.append((d, " ".join(words), 0.1))
        labels.append((d, int(toxic)))
    df = spark.createDataFrame(rows + [(None, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(0, 0), (2, None)], "doc_id long, toxic int")
    got = toxicity.scored(df, known).collect()
    held = [(r["predicted"], r["doc_id"] % 6 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(got) == 902 and len(held) > 200
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    kept = toxicity.clean(df, known)
    assert kept.columns == df.columns and kept.where("doc_id IS NULL").count() == 1
    assert toxicity.scored(empty, known).count() == 0
    assert toxicity.scored(df, known.limit(0)).where("predicted = 1").count() == 0


def test_repeated_words_are_scored_at_every_place(spark):
    bad = ["grumlo", "vextar", "plonk"]
    rows = [(d, prose(d, 40) + (" grumlo plonk vextar" if d % 6 == 0 else "")) for d in range(600)]
    known = spark.createDataFrame([(d, int(d % 6 == 0)) for d, _ in rows], "doc_id long, toxic int")
    model, _ = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), known)
    words = [w for i, b in enumerate(bad) for w in [b, *prose(700 + i, 40).split()]]
    places = []
    for i in range(2):
        places.append((len(words), len(words) + 12))
        words += bad * 4 + prose(800 + i, 60).split()
    found = [(a, b) for _, a, b in model.passages(" ".join(words))]
    assert all(any(a <= x and y <= b for a, b in found) for x, y in places) and len(found) >= 2


def test_common_words_do_not_hide_a_rare_toxic_one(spark):
    # The hash of the first common word is that of the toxic one modulo 2**20, the second's modulo 2**20 without its lower half.
    rows = [(d, prose(d, 30) + (" grumlo" if d % 30 == 0 else " atjoaaq gocjaaq")) for d in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(d, int(d % 30 == 0)) for d, _ in rows], "doc_id long, toxic int")
    model, _ = toxicity.fit(df, known)
    scores = model.weights().of(["grumlo", "grumbling", "atjoaaq", "gocjaaq", "unseen"], 0)[0]
    assert (scores[:2] > 0).all() and (scores[2:] < 0).all()
    # Counted exactly, from votes of labelled rows and from all rows.
    votes = {r["doc_id"]: (r["toxic"], r["vote"]) for r in toxicity.votes(df, known).collect()}
    word = int(np.array([toxicity.feature_hashes("grumlo")[0]], np.uint64).view(np.int64)[0])
    row = toxicity.feature_counts(df, known).where(f"feature = {word}").first()
    assert row["c0"] == 30 and row["c1"] + row["c3"] == pytest.approx(sum(v for d, (t, v) in votes.items() if d % 30 == 0))
    assert row["c2"] == row["c4"] == 0


def test_words_of_several_texts_are_looked_up_together():
    weights = np.array([[2.0, -0.5], [np.nan, 1.0], [0.5, np.nan]], np.float32)
    known = sorted((int(np.uint64(toxicity.feature_hashes(w)[0]).view(np.int64)), k) for k, w in enumerate(("grumlo", "snarkel")))
    table = np.array([h for h, _ in known], np.int64), weights[:, [k for _, k in known]]
    rows = [["grumlo,", "and", "snarkel"], [], ["snarkel", "grumlo"]]
    one, more = toxicity.WordScores(*table), toxicity.WordScores(*table)
    settled = []
    more.settle = lambda: (settled.append(len(more.fresh)), toxicity.WordScores.settle(more))
    for k in range(3):
        for words, found in zip(rows, more.of_texts(rows, [k] * 3)):
            assert found.tolist() == one.of(words, k)[0].tolist() and len(found) == len(words)
    assert settled == [4]  # once for all three texts
    for w in ("grumlo", "«snarkel»", "--", "ÀÉ"):
        assert tuple(toxicity.features_of([w])[0].tolist()) == toxicity.feature_hashes(w)


def test_kept_words_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(wavelet, "REMEMBERED", 40)
    monkeypatch.setattr(wavelet, "MARKED", 10)
    encoder = wavelet.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for d in range(30):
        text = " ".join(f"{w}{'.,;!?'[i % 5]}" if i % 2 else w for i, w in enumerate(prose(d, 60).split())) + " é… a.b 12, tail"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    # Words with marks fell into the words kept before, and took their places.
    assert len(encoder) <= 50 and encoder.marked == 10 and len(encoder.parts) <= 40


def test_planes_are_parted_in_pieces(monkeypatch):
    ids = np.random.default_rng(6).integers(0, 50_000, 5000)
    whole = wavelet.WaveletMatrix.build(ids)
    monkeypatch.setattr(wavelet, "PIECE", 512)
    sizes = [len(down) + len(up) for _, down, up in wavelet._parted(np.arange(1100) % 3 == 0)]
    assert sizes == [512, 512, 76]
    assert wavelet.WaveletMatrix.build(ids) == whole
    assert np.array_equal(wavelet.WaveletMatrix(len(ids), *whole).ids(), ids)
