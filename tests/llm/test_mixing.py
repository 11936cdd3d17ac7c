"""Mixing: targets against iterated resharing, taken words, positions, edge cases."""

import pytest

from vertexloom.llm import mixing


def resharing(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, target int")


def test_targets_and_taken(spark):
    sizes = {"a": 300, "b": 10, "c": 7, "é": 1000, "z": 2, "": 50, None: 40}
    rows, k = [], 0
    for s, n in sizes.items():
        for i in range(n):
            rows.append((k, s, "w\x0bx" if i % 2 else "nbsp one"))
            k += 1
    real = {s: sum(2 if i % 2 else 1 for i in range(n)) for s, n in sizes.items()}
    got = mixing.schedule(docs(spark, rows)).collect()
    want = resharing(real)
    assert sum(want.values()) == pytest.approx(sum(real.values()))
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == real[s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] and sum(c["words"] for c in r["copies"]) == r["taken"] for r in mine)
        assert all(0 <= c["position"] <= 1 for r in mine for c in r["copies"])
    again = mixing.schedule(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_curriculum(spark):
    rows = [(i, ("a", "b", "c")[i % 3], "one two three") for i in range(600)]
    mixed = mixing.mixture(docs(spark, rows))
    got = mixed.collect()
    place = [r["position"] for r in got]
    assert place == sorted(place)
    early = lambda s: sum(r["words"] for r in got if r["source"] == s and r["position"] < 0.5) / max(1, sum(r["words"] for r in got if r["source"] == s))
    assert early("a") == pytest.approx(0.35, abs=0.03) and early("b") == pytest.approx(0.5, abs=0.03) and early("c") == pytest.approx(0.65, abs=0.03)


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, "a", ""), (1, "a", "x y"), (1, "a", "x y"), (2, "a", " \t")]])
def test_edges(spark, rows):
    got = mixing.schedule(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["taken"] for r in got) == (4 if rows else 0)
    assert mixing.mixture(docs(spark, rows)).count() == (2 if rows else 0)


def test_null_ids_ties_and_names(spark):
    rows = [(None, "a", "x y z", 1, "p", 0.5), (None, "a", "u v w", 1, "p", 0.5), (7, "a", "k l m", 1, "q", 0.25), (7, "a", "n o p", 2, "q", 0.25), (None, "b", "x y z", 1, "p", 0.5), (None, "b", "x y z", 1, "p", 0.5)]
    schema = "doc_id long, source string, text string, words int, Position string, _key double"
    table = spark.createDataFrame(rows, schema)
    out = mixing.mixture(table)
    assert out.columns == ["doc_id", "source", "text", "words", "Position", "_key", "words_", "position_"]
    got = out.collect()
    assert {r["text"] for r in got if r["source"] == "a"} == {r[2] for r in rows if r[1] == "a"} or sum(r["words_"] for r in got if r["source"] == "a") < 12
    taken = sum(r["taken"] for r in mixing.schedule(table).collect())
    assert sum(r["words_"] for r in got) == taken >= 17
    assert all(tuple(r)[:6] in rows for r in got)
    assert mixing.mixture(spark.createDataFrame([], schema)).count() == 0


def test_curriculum_reaches_the_query(spark, sf_dir, monkeypatch):
    """op5's rows stand in the order of the mix and take what its copies hold; without training time nothing is taken."""
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {}
    for r in mixing.mixture(docs_).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["words"]
    got = mixing.op5_mixing(spark, sf_dir).collect()
    assert [r["doc_id"] for r in got if r["taken"]] == list(words)
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: 0 for r in docs_.collect()} | words
    for r in mixing.schedule(docs_, until=0.5).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        slope = mixing.SLOPES[sorted(x[0] for x in docs_.select("source").distinct().collect()).index(r["source"]) % 3]
        assert abs(r["sum(taken)"] - r["max(target)"] * (0.5 - slope / 4)) <= 1
    monkeypatch.setattr(mixing, "_position", lambda words: words * 0.0 + 2.0)
    assert not any(r["taken"] for r in mixing.op5_mixing(spark, sf_dir).collect())
