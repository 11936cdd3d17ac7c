"""The pipeline against plain Python versions of its stages."""

import corpus_pipeline
import pytest
from vertexloom.llm import decontaminate, linededup, quality

from tests.llm.test_linededup import brute
from tests.llm.test_mixing import resharing
from tests.llm.test_simhash import first_of, similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        out.append((docs, rows))
        docs = rows
    return out


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_stages(spark, stages):
    columns = stages[0][0].columns
    assert all(rows.columns == columns for _, rows in stages[:-1])
    # quality: the same model over each text by itself
    docs, kept = stages[0]
    model = quality.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts(kept)) == {d for d, t in texts(docs).items() if t.split() and model.scores([t])[0] >= quality.THRESHOLD}
    # line dedup: what a search for common runs finds goes, and nothing else
    docs, kept = map(texts, stages[1])
    want = {d: linededup.cut(t, [{"start": a, "end": b} for a, b in brute(docs).get(d, [])]) for d, t in docs.items()}
    assert kept == {d: t for d, t in want.items() if t or not docs[d]}
    # near duplicates: components of similar texts (fingerprints that are near add none here)
    docs, kept = map(texts, stages[2])
    assert kept == {d: docs[d] for d in first_of(docs, similar(docs))}
    # decontamination: whole items
    docs, kept = map(texts, stages[3])
    words = lambda t: b" ".join(decontaminate.words(t)).decode()
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(kept) == {d for d, t in docs.items() if not any(f" {i} " in f" {words(t)} " for i in items)}
    # mixing: targets
    docs, mixed = stages[4]
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    taken = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"]
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in resharing(sizes).items())


def test_run(spark, stages):
    got = sorted((r["doc_id"], r["words"], round(r["position"], 9), r["text"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["words"], round(r["position"], 9), r["text"]) for r in stages[-1][1].collect())


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, position int, words string, _doc int, _tag int, _spans int, _key int, _kept_id int, tag int, fp string, label int"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, empty):
    """Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names."""
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    extra = (1, "w", 2, 3, 4, 5, 6, 7, "f", 8)
    rows = [(i, t, "en", f"src{i % 3}", len(t), *extra) for i, t in enumerate(real)]
    rows += [(None, real[0], None, None, None, *[None] * 10), (50, None, "en", "src1", 0, *extra), (51, "", "en", "src1", 0, *extra), (52, " \n\t", None, None, 3, *extra)]
    rows += [(3, real[3], "en", "src0", len(real[3]), *extra)] * 2 + [(3, real[5], "en", "src0", 1, *extra), (None, None, None, None, None, *[None] * 10), (60, " ".join(real) * 20, "en", "src2", 9, *extra)]
    docs = spark.createDataFrame([] if empty else rows, EXTRA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept = [tuple(r) for r in out.collect()]
        columns = docs.columns if name != "mix" else [*docs.columns, "words_", "position_"]
        assert out.columns == columns, name
        if empty:
            assert not kept
        elif name != "line_dedup":
            assert kept and {r[:2] for r in kept} <= {r[:2] for r in rows}, name
        if name in ("line_dedup", "decontamination") and not empty:
            assert {50, 51, 52} <= {r[0] for r in kept} and (None, None) in {r[:2] for r in kept}
