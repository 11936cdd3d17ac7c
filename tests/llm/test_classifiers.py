"""Quality and toxicity: held-out quality, leak checks, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import labelled, quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(s, y):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / (y == 0).sum()


@pytest.mark.parametrize(("query", "column", "held"), [(quality.op3_quality, "quality", lambda d: zlib.crc32(str(d).encode()) % 5 == 0), (toxicity.op8_toxicity, "toxic", lambda d: zlib.crc32(str(d).encode()) % 4 == 2)])
def test_held_out(spark, query, column, held):
    got = {r["doc_id"]: r for r in query(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == held(d) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for d, r in got.items())
    labels = [(r["doc_id"], r[column]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    test = [(got[d]["score"], y) for d, y in labels if held(d) and d in got]
    s, y = np.array(test).T
    assert auc(s, y) > 0.97


def test_sample_is_bounded_and_clean(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, quality int")
    assert labelled.sample(docs, labels, "quality", F.lit(True), 10) == [(1, "a", 1), (2, "", 0)]
    assert len(labelled.sample(docs, labels, "quality", F.lit(True), 1)) == 1
    assert labelled.sample(docs, labels, "quality", F.col("doc_id") > 5, 10) == []
    same = spark.createDataFrame([(7, f"text {i}") for i in range(200)], "doc_id long, text string")
    assert labelled.sample(same, spark.createDataFrame([(7, 1)], "doc_id long, quality int"), "quality", F.lit(True), 10) == [(7, "text 99", 1)]
    long = spark.createDataFrame([(i, "word " * 20) for i in range(50)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert len(labelled.sample(long, marks, "quality", F.lit(True), 40, chars=1250)) == 12
    assert len(labelled.sample(long, marks, "quality", F.lit(True), 40, chars=5)) == 1


ROWS = [(None, None), (1, ""), (1, ""), (2, "word " * 60_000), (3, "x" * 300_000), (4, "¿!? ... \n\n"), (5, "퟿日本語 𝔘nicode")]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in ROWS], "doc_id long, text string, score double, label int")
    text = ["good day to all of them", "vile scoundrel words vile scoundrel"]
    model = module.fit([(i, f"{text[i % 2]} {i % 7}", i % 2) for i in range(60)])
    assert model.scores(["vile scoundrel"])[0] > model.scores(["good day"])[0]
    got = module.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(docs.where("false"), model).count() == 0
    for none in ([], [(1, "a", 1)], [(1, "a", 0), (2, "b", 0)]):
        assert len(module.fit(none).scores(["a", ""])) == 2


def test_inserted_and_gapped():
    rows = [(i, "some plain words stand here today and more of them" if i % 2 else "you worthless scoundrel and worthless scoundrel go away") for i in range(90)]
    model = toxicity.fit([(i, f"{t} extra{i}", int(i % 2 == 0)) for i, t in rows])
    plain = model.scores(["some plain words stand here"])[0]
    for w in ("worthless", "w.o.r.t.h.l.e.s.s", "worth-less", "worthlxess", "w0rthle5s", "w o r t h l e s s"):
        assert model.scores([f"you {w} scoundrel"])[0] > plain + 0.3, w


def test_accepted_keeps_columns(spark):
    model = quality.fit([(i, ("fine calm words in a row " if i % 2 else "BUY!! NOW!! BUY!! ") * 5, i % 2) for i in range(80)])
    docs = spark.createDataFrame([(1, "fine calm words in a row " * 5, "en"), (2, "BUY!! NOW!! BUY!! " * 5, "en"), (3, None, None), (4, "\t", None)], "doc_id long, text string, lang string")
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


def plain_kernel(a, b):
    """Every three characters in order within SPAN places, weighed by DECAY to the places spanned; over lengths."""

    def features(word):
        word, out = f"^{word}$", {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    t = word[i] + word[j] + word[k]
                    out[t] = out.get(t, 0) + toxicity.DECAY ** (k - i + 1)
        size = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(len(word)) for j in range(i + 1, len(word)) for k in range(j + 1, min(len(word), i + toxicity.SPAN))) ** 0.5
        return {t: v / size for t, v in out.items()}

    x, y = features(a), features(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def test_folded_weights_are_sums_of_kernels():
    marks, words = ["worthless", "plain", "scoundrel", "today", "stand"], ["worthlxess", "plane", "wrthless", "standing", "zzz"]
    column = toxicity.columns(marks)
    land = toxicity.dense(marks, column)
    kernels = np.array([[plain_kernel(w, m) for m in marks] for w in words])
    assert np.allclose(toxicity.dense(words, column) @ land.T, kernels, atol=1e-5)
    fold = toxicity.nystrom(land)
    assert np.allclose((land @ land.T @ fold) @ (land @ land.T @ fold).T, land @ land.T, atol=1e-4)
    w = np.random.default_rng(1).normal(size=fold.shape[1])
    folded = np.append((fold @ w) @ land, 0.0)[column]
    assert np.allclose(toxicity.values(words, folded, 0.25), kernels @ fold @ w + 0.25, atol=1e-4)


def test_sentences_are_labelled():
    """Insults beyond any list, each rare; near copies aren't evidence; words beside insults stay clean."""
    rnd = np.random.default_rng(7)
    draw = lambda letters, n: "".join(rnd.choice(list(letters), n))
    stems, plain = [draw("bdfgkpvwaou", 7) for _ in range(130)], [draw("aeiourstlnm", 6) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(plain, k)).capitalize()
    rows = []
    for i in range(4680):
        bad = int(i % 6 == 0)
        said = [say(8) for _ in range(4)]
        if bad:
            said[i % 4] += " " + stems[(i // 6) % 130]
        rows.append((i, ". ".join(said), bad))
    fresh = [(". ".join([say(8), f"{say(5)} {stems[k]}", say(6)]), 1) for k in range(130)] + [(". ".join([say(8), say(6), say(7)]), 0) for _ in range(130)]
    model = toxicity.fit(rows)
    s, y = model.scores([t for t, _ in fresh]), np.array([y for _, y in fresh])
    assert (s[y == 1] >= 0.3).mean() > 0.9 and (s[y == 0] >= 0.3).mean() < 0.05
    copies = [(i, rows[0][1] + f" x{i}", 0) for i in range(3)] + [(i, rows[0][1] + f" y{i}", 1) for i in range(3)]
    assert toxicity._copies(copies) == [False, True, True, False, True, True]


def test_quality_against_plain_sums():
    texts = [("calm words stand in a row and more of them follow " if i % 2 else "BUY!! NOW!! buy buy BUY!! ") * (1 + i % 4) + f"end{i}" for i in range(80)]
    model = quality.fit([(i, t, i % 2) for i, t in enumerate(texts)])
    v, net = model.vectors, model.network
    d = v.table.shape[1] // 2
    for t in [*texts[:6], "calm calm strangeWord 12 !!"]:
        words, rows, before = t.split(), [], None
        for w in words:
            key = "\0same" if w == before else w if w in v.keys else quality.shape(w)
            rows.append(v.table[v.keys.get(key, 0)].astype(float))
            before = w
        mean = np.mean(rows, axis=0)
        x = np.concatenate([mean[:d], np.sqrt(np.maximum(mean[d:] - mean[:d] ** 2, 0)), [np.log1p(len(words)) / 10, 1.0]])
        assert np.allclose(v.pooled(t), x, atol=1e-4)
        z = np.append(np.clip((v.pooled(t).astype(float) - net.mean) / net.std, -6, 6), 1)
        margin = np.append(np.tanh(z @ net.a), 1) @ net.b
        assert model.scores([t])[0] == pytest.approx(1 / (1 + np.exp(-margin / net.temperature)))
    assert model.scores(texts)[1::2].min() > model.scores(texts)[::2].max()
