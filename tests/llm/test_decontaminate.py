"""Decontamination: planted copies and paraphrases found, clean documents left alone, against brute force, edge cases."""

import random

import numpy as np

from vertexloom.llm import decontaminate as dc


def test_lcs_against_table():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = [rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 90))], [rnd.randrange(0, 6) for _ in range(rnd.randrange(0, 120))]
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        assert dc.lcs(dc.masks_of(a), len(a), b) == row[-1]


def corpus(rnd, n):
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ren", "tus", "vo", "zel", "the", "an"]) for _ in range(rnd.randrange(1, 4)))
    return lambda k: " ".join(word() for _ in range(k)), n


def test_planted(spark):
    rnd = random.Random(6)
    say, _ = corpus(rnd, 0)
    items = {i: say(rnd.randrange(12, 60)) + ". " + say(6).capitalize() + "." for i in range(30)}
    items[30], items[31] = "lone short item here", say(400)
    rows, want = [], set()
    for d in range(240):
        words = say(rnd.randrange(20, 300)).split()
        if d % 4 == 0:
            k = rnd.randrange(32)
            copy = items[k].split()
            if d % 8 == 0 and k < 30:  # a paraphrase: every sixth word changed, none in the answer
                copy = [say(1) if i % 6 == 3 and i < len(copy) - 7 else w for i, w in enumerate(copy)]
            if d % 12 == 0:
                copy = [w.upper() + "!!" for w in copy]
            at = rnd.randrange(len(words))
            words[at:at] = copy
            want.add((d, k))
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, lcs int, item_id string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc"], r["item_id"]) for r in dc.contaminations(docs, bench).collect()}
    assert got == want
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(240)) - {d for d, _ in want}
    few = dc.BLOCK_WORDS
    try:
        dc.BLOCK_WORDS = 500  # several blocks give the same pairs
        assert {(r["doc"], r["item_id"]) for r in dc.contaminations(docs, bench).collect()} == want
    finally:
        dc.BLOCK_WORDS = few


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, f"x y {item} z", 1), (1, None, 1), (2, "", 1), (3, f"a {item}", 1), (3, f"a {item}", 1), (4, "word " * 50_000, 1), (5, "... !!! ***", 1)], "doc_id long, text string, tag int")
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, ""), (4, "?!"), (1, item)], "item_id long, text string")
    got = sorted({(r["doc"] or 0, r["item_id"]) for r in dc.contaminations(docs, bench).collect()})
    assert got == [(0, 1), (3, 1)]
    assert sorted(r["doc_id"] for r in dc.clean(docs, bench).collect()) == [1, 2, 4, 5]
    assert dc.contaminations(docs.where("false"), bench).count() == 0
    assert dc.clean(docs, bench.where("false")).count() == 7


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    norm = lambda t: dc.words(t or "")
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        joined = b" " + b" ".join(norm(r["text"])) + b" "
        want |= {(r["doc_id"], i) for i, w in items.items() if b" " + b" ".join(w) + b" " in joined}
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in dc.op9_decontaminate(spark, sf).collect()}
    assert len(want) > 15 and want <= set(got) and np.mean([got[k] for k in want]) == 1
    assert len(set(got) - want) <= 1


def test_heavy_paraphrases_and_short_items(spark):
    rnd = random.Random(12)
    say, _ = corpus(rnd, 0)
    items = {i: say(rnd.randrange(24, 40)) + ". " + say(6).capitalize() + "." for i in range(100)} | {100 + i: say(rnd.randrange(3, 6)) for i in range(60)}
    mix = [w for t in items.values() for w in t.replace(".", "").split()]
    rows, want = [], set()
    for i, t in items.items():
        copy, around = t.split(), [rnd.choice(mix) for _ in range(200)]
        if i < 100:  # a third of the words changed for other benchmark words, none in the answer
            n = len(copy) - 6
            for j in rnd.sample(range(n), int(0.35 * len(copy))):
                copy[j] = rnd.choice(mix)
        around[90:90] = copy
        rows.append((i, " ".join(around)))
        want.add((i, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc"], r["item_id"]) for r in dc.contaminations(docs, bench).collect()}
    assert len({x for x in want - got if x[0] < 100}) <= 2 and not {x for x in want - got if x[0] >= 100}
