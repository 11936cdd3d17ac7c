"""SimHash links and components against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from vertexloom.llm import jaccard, simhash


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps}


def test_fingerprint():
    for t in ["", None, "one", "Two words", "a b c", "Ä B\tc\x0bd e f é", "x " * 70000, "nbsp is no blank here at all"]:
        assert simhash.fingerprint(t) == plain(t)


def test_links_span_all_components(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:40]:
        for _ in range(4):
            g = f
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 3, 3, 4])):
                g ^= 1 << b
            fps.add(g)
    for f in list(fps)[:10]:  # three bits in one third, and over the border of the halves
        fps |= {f ^ 0b111 << 5, f ^ 0b111 << 30, f ^ 0b111 << 60, f ^ (1 | 1 << 30 | 1 << 50)}
    signed = {f - 2**64 if f >> 63 else f for f in fps}
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = {r["node"]: r["root"] for r in simhash.connected_components(got).collect()}
    want = components(signed)
    assert {f: found.get(f, f) for f in signed} == want


@pytest.mark.parametrize("rows", [[], [(None, "a b c d"), (5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, None), (8, ""), (9, " \n")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, root long")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == ([(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 7)] if rows else [])
    for how in ({}, {"width": 5, "similar": 0.8}):
        kept = simhash.keep_one(docs.withColumnRenamed("root", "_kept_id"), **how)
        assert kept.columns == ["doc_id", "text", "fp", "_kept_id"] and sorted(r["doc_id"] for r in kept.collect()) == ([3, 7] if rows else [])


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {d: plain(t) for d, t in texts.items()}
    root = components(set(fps.values()))
    least = {}
    for d, f in sorted(fps.items()):
        least.setdefault(root[f], d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{f:016x}", least[root[f]]) for d, f in fps.items()}


def test_rows_of_one_id(spark):
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3)]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[0]), (7, texts[2]), (7, texts[2]), (None, texts[2])]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string"), width=5, similar=0.8)
        assert sorted(map(tuple, kept.collect())) == sorted([(3, texts[0]), (5, texts[1]), (7, texts[2])])


def test_candidates_of_a_bucket():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, jaccard.PLACES)
    signatures = np.stack([np.where(rng.random(jaccard.PLACES) < q, base, rng.integers(0, 256, jaccard.PLACES)) for q in [1, 0.95, 0.95, 0.9, 0.9, 0.2, 0.1]]).astype(np.uint8)
    got = jaccard.chosen(signatures)
    assert all(i < j < 5 for i, j in got) and {x for p in got for x in p} == set(range(5))


def similar(texts, least=0.8):
    """Links between ids by brute force: Jaccard similarity of five-word shingles."""
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    return [(a, b) for i, b in enumerate(ids) for a in ids[:i] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def first_of(ids, pairs):
    """The smallest id of each component."""
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {top(i) for i in ids}


@pytest.mark.parametrize("crowd", [128, 12])
def test_family_of_near_copies(spark, monkeypatch, crowd):
    """Copies with more or fewer words changed: many are near one another, many are not; also in buckets over CROWD."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    said, texts = [word() for _ in range(150)], {}
    for i in range(150):
        copy = list(said)
        for j in rnd.sample(range(150), rnd.choice([0, 1, 1, 2, 4, 6, 8, 12])):
            copy[j] = word()
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(kept) > 5 and kept == first_of(texts, similar(texts))


def test_near_copies_by_similarity(spark):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    of = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near = [], set()
    for i in range(0, 400, 2):
        said = [word() for _ in range(rnd.randrange(60, 400))]
        copy = list(said)
        for j in rnd.sample(range(len(said)), max(1, int(len(said) * rnd.choice([0.004, 0.01, 0.02, 0.025, 0.06])))):
            copy[j] = word()
        a, b = of(said), of(copy)
        if len(a & b) >= 0.8 * len(a | b):
            near.add(i + 1)
        rows += [(i, " ".join(said)), (i + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(near) > 100 and len(near & kept) <= 1 and set(range(400)) - kept <= near


def test_links_that_keys_and_buckets_miss(spark, monkeypatch):
    """12,000 pairs at exactly 0.8, some of which share no key; and families, when crowded buckets give no candidates at all."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    rows = []
    for i in range(0, 24000, 2):
        said = [word() for _ in range(13)]
        rows += [(i, " ".join(said)), (i + 1, " ".join([*said[:-1], word()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(0, 24000, 2))
    monkeypatch.setattr(jaccard, "CUT", 2.0)
    texts = {}
    for i in range(240):
        said = [word() for _ in range(90)] if i % 80 == 0 else said
        copy = list(said)
        for j in rnd.sample(range(90), rnd.choice([0, 1, 2, 2, 3, 4, 6])):
            copy[j] = word()
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for small in (64, 4):
        monkeypatch.setattr(jaccard, "SMALL", small, raising=False)
        assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == first_of(texts, similar(texts))
