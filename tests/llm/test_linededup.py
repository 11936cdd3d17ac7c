"""Repeated passages: against a brute-force search for long common runs, and edge cases."""

import random

import numpy as np
import pyarrow as pa

from vertexloom.llm import linededup as ld
from vertexloom.llm import wordhash


def docs(spark, rows):
    return spark.createDataFrame([(*r, 3, "t") for r in rows], "doc_id long, text string, pos int, tag string")


def sentence(rnd):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6))) for _ in range(rnd.randrange(3, 14))).capitalize() + "."


def brute(texts, least=50):
    """Word ranges of each document whose every word lies in ``least`` words that stand earlier: in an earlier document or place."""
    out, seen = {}, set()
    for d in sorted(texts):
        words = texts[d].encode().split()
        hit = np.zeros(len(words) + 1, dtype=bool)
        for j in range(len(words) - least + 1):
            run = tuple(words[j : j + least])
            if run in seen:
                hit[j : j + least] = True
            seen.add(run)
        edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(int)]))
        out[d] = [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]
    return {k: v for k, v in out.items() if v}


def test_against_brute_force(spark):
    rnd = random.Random(2)
    passages = [" ".join(sentence(rnd) for _ in range(rnd.randrange(8, 14))) for _ in range(6)]
    short = [" ".join(sentence(rnd) for _ in range(2)) for _ in range(3)]
    texts = {}
    for i in range(60):
        parts = [sentence(rnd) for _ in range(rnd.randrange(4, 25))]
        for p in rnd.sample(passages, rnd.choice([0, 0, 1, 2])):
            at = rnd.randrange(len(parts) + 1)
            if rnd.random() < 0.5:  # in the middle of a line
                parts[at : at + 1] = [f"mid{i} line {p} tail{i} words"]
            else:
                parts.insert(at, p)
        parts.insert(rnd.randrange(len(parts)), rnd.choice(short))
        texts[i] = "".join(x + rnd.choice([" ", "\n"]) for x in parts)
    texts[60], texts[61] = texts[7], texts[9].replace(".", "", 1)
    got = {r["doc"]: [(s["start"], s["end"]) for s in r["spans"]] for r in ld.repeats(docs(spark, list(texts.items()))).collect()}
    want = brute(texts)
    assert len(want) > 15 and got == want
    kept = {r["doc_id"]: r["text"] for r in ld.deduplicated(docs(spark, list(texts.items()))).collect()}
    assert 60 not in kept and set(kept) | {60} == set(texts)
    for d, t in kept.items():
        assert t == texts[d] or d in want
    assert not brute({**kept}, 60)


def test_unpunctuated_and_long(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(120))
    long = " ".join(word() for _ in range(30_000))
    rows = [(1, f"{long} {passage} {word()}"), (2, f"{word()} {passage} {word()} {word()}"), (3, f"{word()} {long}")]
    got = {r["doc"]: [(s["start"], s["end"]) for s in r["spans"]] for r in ld.repeats(docs(spark, rows)).collect()}
    assert got == {2: [(1, 121)], 3: [(1, 30_001)]}


def test_edges(spark):
    text = " ".join(f"w{i} x." for i in range(40))
    rows = [(None, None), (1, ""), (2, text), (2, text), (2, text + " other"), (3, " ".join(["same."] * 500)), (None, "short one")]
    out = sorted((r["doc_id"] or 0, r["text"] or "") for r in ld.deduplicated(docs(spark, rows)).collect())
    assert len(out) == len(rows) and out.count((2, text)) + out.count((2, "")) + out.count((2, "other")) >= 2
    assert (3, "same.") in out and (0, "short one") in out
    assert ld.deduplicated(docs(spark, [])).count() == 0
    assert ld.cut("a  b\nc d ", [{"start": 1, "end": 3}]) == "a  d"


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute(texts)
    got = {r["doc_id"]: r for r in ld.op7_linededup(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    found = {d: [tuple(map(int, x.split(":"))) for x in r["runs"].split(",")] for d, r in got.items() if r["runs"]}
    assert found == want
    assert all(r["n_runs"] == len(want.get(d, [])) and r["removed_words"] == sum(e - s for s, e in want.get(d, [])) for d, r in got.items())


def spans(spark, rows):
    return {r["doc"]: [(s["start"], s["end"]) for s in r["spans"]] for r in ld.repeats(docs(spark, rows)).collect()}


def word(rnd):
    return "".join(rnd.choice("abcdefghij") for _ in range(7))


def test_stretch_of_one_line(spark):
    rnd = random.Random(7)
    line = " ".join(word(rnd) for _ in range(9)) + " end."
    around = lambda n: " ".join(word(rnd) for _ in range(n))
    texts = {1: f"{around(30)} {' '.join([line] * 60)} {around(25)}", 2: f"{around(17)} {' '.join([line] * 40)} {around(40)}", 3: f"{around(5)} {' '.join([line] * 90)}"}
    assert spans(spark, list(texts.items())) == brute(texts) == {1: [(40, 630)], 2: [(17, 417)], 3: [(5, 905)]}


def test_passage_of_frequent_lines(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join(word(rnd) for _ in range(n)).capitalize() + "."
    lines = [say(rnd.randrange(9, 13)) for _ in range(9)]
    texts = {i: f"{say(22)} {line} {say(23)}" for i, line in enumerate(lines)}  # each line stands alone somewhere before
    texts |= {20: f"{say(30)} {' '.join(lines)} {say(12)}", 21: f"{say(8)} {' '.join(lines)} {say(33)}"}
    n = len(" ".join(lines).split())
    assert spans(spark, list(texts.items())) == brute(texts) == {21: [(8, 8 + n)]}


def test_short_passages_of_long_sentences(spark):
    rnd = random.Random(9)
    say = lambda n: " ".join(word(rnd) for _ in range(n)).capitalize() + "."
    texts = {}
    for i in range(0, 200, 2):  # 50 to 60 words, cut anywhere
        whole = " ".join(say(rnd.randrange(15, 25)) for _ in range(8)).split()
        at, n = rnd.randrange(80), rnd.randrange(50, 61)
        texts[i] = " ".join(whole)
        texts[i + 1] = " ".join([say(rnd.randrange(10, 40)), *whole[at : at + n], say(rnd.randrange(10, 40))])
    want = brute(texts)
    assert len(want) == 100 and spans(spark, list(texts.items())) == want


def test_passages_named_in_reviews(spark):
    rnd = random.Random(10)
    around = lambda n: " ".join(word(rnd) for _ in range(n))
    line = around(13)
    texts = {1: " ".join([line] * 60), 2: f"{around(4)} {' '.join([line] * 40)}"}
    assert spans(spark, list(texts.items())) == brute(texts) and spans(spark, list(texts.items()))[2] == [(4, 524)]
    texts = {1: " ".join(["same."] * 500), 2: " ".join(["same."] * 300)}
    assert spans(spark, list(texts.items())) == brute(texts) == {1: [(1, 500)], 2: [(0, 300)]}
    twice = around(100)
    texts = {1: f"{twice} {around(30)} {twice} {around(5)}"}
    assert spans(spark, list(texts.items())) == brute(texts) == {1: [(130, 230)]}
    passage = around(60).split()  # 35 words of one document and 35 of another, 10 of them in both: no run of 50
    texts = {1: f"{around(20)} {' '.join(passage[:35])} {around(20)}", 2: f"{around(9)} {' '.join(passage[25:])} {around(20)}", 3: f"{around(12)} {' '.join(passage)} {around(12)}"}
    assert spans(spark, list(texts.items())) == brute(texts) == {}


def test_blocks(spark, monkeypatch):
    """Long texts are worked on in blocks of words, bytes and documents; results don't hang on where those end."""
    rnd = random.Random(11)
    pool = [" ".join(word(rnd) for _ in range(rnd.randrange(30, 90))) for _ in range(40)]
    texts = {i: " ".join(rnd.choice(pool) + rnd.choice([" ", "", "\n"]) for _ in range(rnd.randrange(0, 12))) for i in range(60)}
    columns = [pa.array(list(texts.values())), pa.array(["", "x" * 700, "é" * 300 + " b", "y" * 512, "y" * 512 + " "])]

    def words(column):
        return [h[a:b].tolist() for _, h, bounds in wordhash.grouped(column) for a, b in zip(bounds, bounds[1:], strict=False)]

    whole = [words(c) for c in columns]
    assert [len(w) for w in whole[0]] == [len(t.split()) for t in texts.values()] and whole[1][3] == whole[1][4]
    monkeypatch.setattr(wordhash, "BYTES", 512)
    monkeypatch.setattr(wordhash, "GROUP", 3000)
    assert [[len(w) for w in c] for c in map(words, columns)] == [[len(w) for w in c] for c in whole]
    assert words(columns[0]) == whole[0] and words(columns[1])[3] == words(columns[1])[4]
    monkeypatch.setattr(wordhash, "WORDS", 64)
    bounds = np.array([0, 150, 150, 400])
    hashes = np.concatenate([np.arange(1, 151), np.arange(1, 251)]).astype(np.uint64)
    starts = [(int(s), int(n)) for _, _, first, count in ld.stretches(hashes, bounds, 50, 20) for s, n in zip(first, count, strict=True)]
    assert sorted(x for s, n in starts for x in range(s, s + n)) == [*range(101), *range(150, 351)]


def test_nulls_and_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    schema = "doc_id long, text string, _doc int, _TAG string, _spans string"
    rows = [(None, text, 1, "a", None), (1, text, 2, "b", "x"), (1, text, 2, "b", "x"), (2, None, 3, None, None), (3, "", 4, "c", None)]
    out = ld.deduplicated(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "_doc", "_TAG", "_spans"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, text, 1, "a", None), (2, None, 3, None, None), (3, "", 4, "c", None)], key=str)
    assert ld.deduplicated(spark.createDataFrame([], schema)).count() == 0
