"""Grid cells above the limit leave the same components as pairing all fingerprints."""

import random

from folioscope.llm.simhash import MAX_BITS, components, links


def test_hot_cells_keep_components(spark):
    rng = random.Random(5)
    prints = {0}
    for _ in range(3):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(12)}
    prints |= {rng.getrandbits(64) for _ in range(10)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= MAX_BITS:
                one, two = sorted((find(a), find(b)))
                root[two] = one
    wanted = {p: find(p) for p in signed}
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for limit in (2, 4096):
        found = {r["node"]: r["root"] for r in components(links(nodes, hot_cell=limit)).distinct().collect()}
        assert {p: found.get(p, p) for p in signed} == wanted


def test_growing_tables_are_not_broadcast(spark):
    from folioscope.llm import simhash

    prints = spark.createDataFrame([(i, (i % 7) * 3 + (i << 40)) for i in range(60)], "doc_id long, fp long")
    found = simhash.clusters(prints)
    assert found.count() == 60
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_not_broadcast(spark):
    from folioscope.llm import simhash

    nodes = spark.createDataFrame([(7 + (i << 40),) for i in range(60)], "fp long")
    assert "Broadcast" not in simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i % 5, f"some words of the text {i} " * 9) for i in range(10)], "doc_id long, text string")
    kept = simhash.near_distinct(docs)  # ids are met twice
    assert kept.count() == len(kept.select("doc_id", "text").distinct().collect())
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_places_of_documents_are_not_broadcast(spark, monkeypatch):
    from folioscope.llm import decontam

    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"begin {i} {passage} end" if i % 2 else f"other text {i}") for i in range(8)], "doc_id long, text string")
    items = spark.createDataFrame([("a", passage), ("b", "too few words")], "item_id string, text string")

    def met():
        out = decontam.matches(docs, items)
        return sorted((r["doc_id"], r["item_id"], r["matched"], r["word_start"]) for r in out.collect()), out._jdf.queryExecution().executedPlan().toString()

    want, plan = met()
    assert want == [(i, "a", 20, 2) for i in (1, 3, 5, 7)] and "SortMergeJoin" in plan
    monkeypatch.setattr(decontam, "SENT_KEYS", 0)
    rows, plan = met()
    assert rows == want and "Broadcast" not in plan


def test_fingerprints_release_earlier_caches():
    from folioscope.llm import common, simhash, toxicity

    common.worker_kept("counts", dict)
    toxicity.feature_hashes("insult")
    assert "beginnings" in common._KEPT
    simhash.worker_kept("fingerprints", dict)
    assert "beginnings" not in common._KEPT and not hasattr(toxicity, "_FIVE")
