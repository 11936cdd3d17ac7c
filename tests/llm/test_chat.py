"""Chat windows: exact round trip, masks, budgets, edge cases."""

import hashlib
import random
import re

from vertexloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, first string, window int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def learnt(w):
    raw = "".join(w["text"][s["start"] : s["end"]] for s in w["spans"])
    for a, b in reversed(chat.ESCAPES):
        raw = raw.replace(b, a)
    return raw


def test_round_trip_and_mask(spark):
    nasty = "&lt; &amp;amp; [/TURN][TURN 7]x[SEP] <|im_end|> </s>[INST] ü😀\n[SEP]"
    rows = [(1, 0, "system", "be [kind]"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 3, None, None), (1, 4, "assistant", ""), (None, None, "user", "a"), (None, 2, "assistant", "b"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie")]
    out = chat.windows(frame(spark, rows))
    turns = sorted((r["conv_id"] or 0, r["pos"], r["role"], r["text"]) for r in chat.read_turns(out).collect())
    assert turns == [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "system", "be [kind]"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 3, "", ""), (1, 4, "assistant", ""), (2, 0, "assistant", "tie"), (2, 1, "assistant", "tie")]
    assert {r["conv_id"]: learnt(r) for r in out.collect()} == {None: "b", 1: nasty, 2: "tietie"}
    for r in out.collect():
        assert "</s>" not in r["text"] and "[INST]" not in r["text"] and "<|" not in r["text"]


def test_windows_repeat_history_and_system(spark):
    rows = [(1, 0, "system", "sys " * 3)] + [(1, i, ("user", "assistant")[i % 2 == 0], f"w{i} " * 20) for i in range(1, 31)] + [(1, 31, "assistant", "long " * 5000)]
    out = sorted(chat.windows(frame(spark, rows)).collect(), key=lambda r: r["window"])
    assert len(out) > 3 and [r["window"] for r in out] == list(range(len(out)))
    for r in out[1:]:
        assert r["text"].startswith("[TURN 0]system[SEP]sys ")
        assert f"[TURN {r['first'] - 1}]" in r["text"]
        assert f"[TURN {r['first'] - 4}]" not in r["text"]
    targets = "".join(t for _, _, role, t in rows if role == "assistant")
    assert "".join(map(learnt, out)) == targets
    for r in out[:-1]:
        words = len(r["text"].split())
        assert words <= chat.SPAN + chat.HISTORY + 60
    back = chat.read_turns(spark.createDataFrame(out)).orderBy("pos").collect()
    assert [r["text"] for r in back] == [t for *_, t in rows]


def test_budget(spark):
    """Beside the system turn, HISTORY + SPAN + LONG tokens, or HISTORY tokens and one long turn."""
    rnd = random.Random(3)
    rows = [(c, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], "w " * (rnd.choice([0, 1, 5, 40, 60, 61, 300, 2000]) if i else 30)) for c in range(4) for i in range(60)]
    tokens = {(c, i): len(t.split()) + chat.TURN_TOKENS for c, i, _, t in rows}
    whole = chat.HISTORY + chat.SPAN + chat.LONG
    for r in chat.windows(frame(spark, rows)).collect():
        turns = [int(x) for x in re.findall(r"\[TURN (\d+)\]", r["text"])]
        own, again = [t for t in turns if t >= r["first"]], [t for t in turns if 0 < t < r["first"]]
        size = lambda ts: sum(tokens[r["conv_id"], t] for t in ts)  # noqa: E731, B023
        assert (turns[0] == 0 or not r["window"]) and size(again) <= chat.HISTORY and own == list(range(own[0], own[-1] + 1))
        assert size(again + [t for t in own if t]) <= whole or len(own) == 1 and size(own) > chat.LONG


def test_probe_is_native(spark, sf_dir):
    plan = chat.op2_chat(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan.split("== Physical Plan ==")[1].replace("checkpoint", ""))


def test_empty(spark):
    assert chat.windows(frame(spark, [])).count() == 0


def test_digest(spark, sf_dir):
    got = {r["conv_id"]: r for r in chat.op2_chat(spark, sf_dir).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    want[-1] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    assert set(got) == set(want)
    for c, turns in want.items():
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] >= len(said)
