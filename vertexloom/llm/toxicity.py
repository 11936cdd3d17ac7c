"""Toxicity by a subsequence string kernel, a support vector machine, and Nyström landmarks.

Kernel: a word (with marks for its ends) has a feature for every three characters in order within SPAN places, gaps allowed,
weighed by DECAY to the power of the places spanned; the kernel is the product of two words' features over their lengths. So
``worthless`` stays near ``worth-lless`` and ``wxorthless``. Marks inside a word are dropped, digits that stand for letters
are read as such, and runs of single letters count as a word too.

Training: labelled sentences. All sentences of clean documents are negative. Those of toxic documents are labelled in rounds
(multiple-instance training): first by a word that is TIMES commoner in toxic documents, which is more than chance allows (binomial tails, at a
false discovery rate of FALSE_SEEDS; of near copies one counts), later also by the machine: a sentence is positive if its value is
above what the values of clean words that the machine hasn't met allow, at the same rate. A sentence's value is its
strongest word's, and in the kernel it goes by that word: for positive ones whatever word that is, seen often or once, and
for clean ones the words that come nearest to an insult. Positive words are also trained with characters inserted. The machine is linear in Nyström features
over landmarks, the words that sentences go by; since those are sums of kernels, it folds to one weight per three
characters, and a word's value takes a few dozen look-ups.

A document's score is a logistic function of its three strongest words, their number, and its length, fitted on documents that
the machine hasn't seen; then the machine is fitted again on all. Fitting takes at most SAMPLE labelled documents; scoring reads every document whole.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import wordhash
from vertexloom.llm.batches import short_batches
from vertexloom.llm.jaccard import shingles
from vertexloom.llm.labelled import remainder, sample

SAMPLE = 6_000
WIDTH = 24
SPAN = 6
DECAY = 0.75
LANDMARKS = 240
FALSE_SEEDS = 0.3
TIMES = 12
INSERTED = 8
COST = 40.0
HARD = 1500
ROUNDS = 4
COPIED = 0.3
SKETCH = 64
THRESHOLD = 0.3
CACHE = 200_000
CODES = 64
BLOCK = 8_192
#: Digits and marks that stand for letters.
LOOKS = str.maketrans("013457@$", "oieastas")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPELT = re.compile(r"(?<!\S)\w(?:[\s.*_-]{1,3}\w){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+")


#: A sentence: its distinct normal words, sorted.
Sentence = tuple[str, ...]


def _code_table() -> np.ndarray:
    table = np.zeros(0x11000, dtype=np.int64)
    for c in range(1, len(table)):
        table[c] = 27 + (c * 2654435761 >> 7) % 34
    for c in range(26):
        table[ord("a") + c] = c + 1
    table[ord("^")], table[ord("$")] = 62, 63
    return table


_CODE = _code_table()


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples within SPAN places of n characters, and their weights."""
    out = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    t = np.array(out, dtype=np.int64).reshape(-1, 3)
    return t, DECAY ** (t[:, 2] - t[:, 0] + 1.0)


def normal(word: str) -> str:
    """Lower-case letters of a word; digits and marks between letters are read as letters where they look like some."""
    if word.isalpha():
        return word.lower()
    core = word.strip(".,;:!?|\"'()[]{}<>*#%&$+-=~_/\\")
    if not core.isalpha() and any(c.isalpha() for c in core):
        core = core.translate(LOOKS)
    return "".join(_LETTERS.findall(core)).lower()


def _pieces(word: str) -> list[str]:
    """The word with end marks, or overlapping pieces of a long one."""
    if len(word) <= WIDTH - 2:
        return [f"^{word}$"]
    step = (WIDTH - 2) // 2
    return [("^" if i == 0 else "") + word[i : i + WIDTH - 2] + ("$" if i + WIDTH - 2 >= len(word) else "") for i in range(0, len(word) - step, step)]


def _coded(pieces: list[str]):
    """By length: (positions in the list, codes of triples, weights divided by the piece's norm)."""
    lengths = np.array([len(p) for p in pieces])
    for n in np.unique(lengths):
        if n < 3:
            continue
        at = np.flatnonzero(lengths == n)
        chars = np.array([pieces[i] for i in at], dtype=f"U{n}").view(np.uint32).reshape(-1, n)
        codes = _CODE[np.minimum(chars, len(_CODE) - 1)]
        t, w = _triples(int(n))
        yield at, (codes[:, t[:, 0]] * CODES + codes[:, t[:, 1]]) * CODES + codes[:, t[:, 2]], w / np.linalg.norm(w)


def dense(words: list[str], column: np.ndarray) -> np.ndarray:
    """Feature rows of words (of their first pieces). ``column`` maps a triple's code to a column; the last column is dropped."""
    out = np.zeros((len(words), int(column.max()) + 1), dtype=np.float32)
    for at, codes, w in _coded([_pieces(x)[0] for x in words]):
        np.add.at(out, (np.repeat(at, codes.shape[1]), column[codes].ravel()), np.tile(w.astype(np.float32), len(at)))
    return out[:, :-1]


def columns(words: list[str]) -> np.ndarray:
    """Columns for the triples that occur in the words; all others share the last one."""
    used = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(c.ravel() for _, c, _ in _coded([_pieces(x)[0] for x in words]))]))
    out = np.full(CODES**3, len(used), dtype=np.int64)
    out[used] = np.arange(len(used))
    return out


def values(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of each normal word; of long words the largest over their pieces."""
    out = np.full(len(words), -np.inf)
    for begin in range(0, len(words), BLOCK):
        pieces, owner = [], []
        for i, w in enumerate(words[begin : begin + BLOCK]):
            mine = _pieces(w)
            pieces += mine
            owner += [begin + i] * len(mine)
        found = np.full(len(pieces), -1.0 + bias)
        for at, codes, w in _coded(pieces):
            found[at] = weights[codes] @ w + bias
        np.maximum.at(out, np.array(owner, dtype=np.int64), found)
    return out


def tokens(text: str) -> set[str]:
    """Distinct raw words of a text, and spelt-out runs joined."""
    out = set(text.split())
    if "  " in text or _SPELT.search(text):
        out.update("".join(_LETTERS.findall(m[0])) for m in _SPELT.finditer(text))
    return out


class Model:
    """Folded kernel weights, bias, and the document calibration."""

    def __init__(self, weights: np.ndarray | None, bias: float, calibration: np.ndarray | None, prior: float):
        self.weights, self.bias, self.calibration, self.prior = weights, bias, calibration, prior
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _rate(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(words)
        forms = [normal(w) for w in new]
        distinct = sorted({f for f in forms if len(f) >= 3})
        known = dict(zip(distinct, values(distinct, self.weights, self.bias).tolist(), strict=True)) if distinct else {}
        low = self.bias - 1.0
        self.cache.update((w, known.get(f, low)) for w, f in zip(new, forms, strict=True))

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: three strongest words' values, count of positive ones (log), length (log), 1."""
        out = np.zeros((len(texts), 6))
        at, group, words = 0, [], set()
        for i, t in enumerate(texts):
            mine = tokens(t)
            group.append(mine)
            words |= mine
            if len(words) > 50_000 or i == len(texts) - 1:
                self._rate(words)
                for j, m in enumerate(group):
                    if not all(w in self.cache for w in m):
                        self._rate(m)
                    v = [self.cache[w] for w in m]
                    top = heapq.nlargest(3, v)
                    out[at + j, :3] = (top + [-2.0] * 3)[:3]
                    out[at + j, 3] = np.log1p(sum(x > 0 for x in v))
                    out[at + j, 4] = np.log1p(len(v)) / 5
                at, group, words = i + 1, [], set()
        out[:, :3] = np.clip(out[:, :3], -1.5, 1.0)
        out[:, 5] = 1
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.calibration, -40, 40)))


def _variants(word: str, rnd: random.Random) -> list[str]:
    """A word with a character inserted, several times, and one doubled."""
    j, out = rnd.randrange(len(word)), []
    for _ in range(INSERTED if len(word) >= 4 else 0):
        i = rnd.randrange(1, len(word))
        out.append(word[:i] + rnd.choice("abcdefghijklmnopqrstuvwxyz") + word[i:])
    return [*out, word[:j] + word[j] + word[j:]]


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared-hinge support vector machine in the primal by Newton steps; the last column of x is the bias."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * c[on, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _spread(documents: list[list[Sentence]], once: set[Sentence] | None) -> Counter:
    """In how many documents each word stands; with ``once``, by sentences that weren't there before: copies add nothing."""
    out: Counter = Counter()
    for d in documents:
        new = d
        if once is not None:
            new = [s for s in d if s not in once]
            once.update(new)
        out.update(set().union(*new))
    return out


def _tails(p: Counter, n: Counter, share: float) -> dict[str, float]:
    """For each word of toxic documents, the chance of as many among the documents that hold it, by the binomial law."""
    known: dict[tuple[int, int], float] = {}
    for a, b in {(p[w], n[w]) for w in p}:
        c, lg = a + b, math.lgamma
        known[a, b] = sum(math.exp(lg(c + 1) - lg(k + 1) - lg(c - k + 1) + k * math.log(share) + (c - k) * math.log1p(-share)) for k in range(a, c + 1))
    return {w: known[p[w], n[w]] for w in p}


def _seeds(p: Counter, n: Counter, share: float) -> dict[str, float]:
    """Words that are commoner in toxic documents than chance allows, with their tails."""
    tails = sorted((t, w) for w, t in _tails(p, n, share).items())
    words = len(p.keys() | n.keys())
    last = max((k for k, (t, _) in enumerate(tails, 1) if t * words <= FALSE_SEEDS * k), default=0)
    return {w: t for t, w in tails[:last]}


def _least(found: np.ndarray, clean: np.ndarray) -> float:
    """The lowest value above which clean words the machine hasn't met let expect a share of FALSE_SEEDS of those found."""
    found, clean = np.sort(found)[::-1], np.sort(clean)
    if not len(clean):
        return np.inf
    wrong = (len(clean) - np.searchsorted(clean, found)) / len(clean) * len(found)
    good = np.flatnonzero((wrong <= FALSE_SEEDS * np.arange(1, len(found) + 1)) & (found > 0))
    return float(found[good[-1]]) if len(good) else np.inf


def nystrom(land: np.ndarray) -> np.ndarray:
    """Turns kernels with the landmarks (rows of features) into Nyström features."""
    value, vector = np.linalg.eigh((land @ land.T).astype(np.float64))
    keep = value > 1e-4
    return vector[:, keep] / np.sqrt(value[keep])


def _machine(pos: list[list[Sentence]], neg: list[list[Sentence]], seed: int = 3) -> tuple[np.ndarray, float] | None:
    """From toxic and clean documents as lists of sentences; None without any signal."""
    rnd = random.Random(seed)
    if not pos or not neg:
        return None
    for once in (set(), None):  # where that leaves no signal, repeated sentences count too
        n, p = (_spread(docs, once) for docs in (neg, pos))
        seeds = {w: t for w, t in _seeds(p, n, len(pos) / (len(pos) + len(neg))).items() if p[w] * len(neg) >= TIMES * n[w] * len(pos)}
        if seeds:
            break
    else:
        return None
    clean = sorted(n, key=lambda w: (-n[w], w))
    rare = {w for w in p if 3 * n[w] * len(pos) < p[w] * len(neg)}  # words that may make a sentence positive
    first = chosen = set(seeds)  # a sentence goes by each of these that it holds
    hard: list[str] = []
    weights, bias, met = None, 0.0, set()
    for round_ in range(ROUNDS):
        if weights is not None:
            top = values(clean, weights, bias)  # of a clean sentence the strongest word counts
            hard = sorted(set(hard) | {clean[i] for i in np.argsort(-top, kind="stable")[:HARD]})
        if round_ > 1:  # once the machine has met the words of clean documents that come nearest
            pool = sorted(rare)
            value = dict(zip(pool, values(pool, weights, bias).tolist(), strict=True))
            least = _least(np.array(list(value.values())), top[[w not in met for w in clean]])
            best = [max(((value[w], w) for w in s if w in value), default=(-2.0, "")) for d in pos for s in d]
            chosen = first | {w for v, w in best if v >= least}
        plus = sorted(chosen)
        marks = sorted(plus, key=lambda w: (-p[w], w))[: LANDMARKS // 2]
        anchors = sorted({*marks, *clean[: LANDMARKS // 4], *rnd.sample(clean, min(len(clean), LANDMARKS // 4))})
        column = columns(anchors)
        land = dense(anchors, column)
        fold = nystrom(land)
        plus = plus + [v for w in plus for v in _variants(w, rnd) if v not in n]
        minus = sorted({*clean[:800], *rnd.sample(clean, min(len(clean), 2500)), *hard} - chosen)
        met = set(minus)
        known = plus + minus
        x = np.concatenate([dense(known[b : b + 256], column) @ land.T for b in range(0, len(known), 256)]).astype(np.float64) @ fold
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        y = np.r_[np.ones(len(plus)), -np.ones(len(minus))]
        w = _svm(x, y, np.full(len(y), COST))
        weights, bias = np.append((fold @ w[:-1]) @ land.astype(np.float64), 0.0)[column], float(w[-1])
    return weights.astype(np.float32), bias


def _sentences(text: str, forms: dict[str, str]) -> list[Sentence]:
    """The sentences of a text. ``forms`` keeps the normal form of each word, so that equal ones are one object."""
    out = []
    for said in _SENTENCE.split(text):
        mine = set()
        for w in tokens(said):
            form = forms.get(w)
            if form is None:
                form = normal(w)
                form = forms[w] = forms.setdefault(form, form)
            if len(form) >= 3:
                mine.add(form)
        if mine:
            out.append(tuple(sorted(mine)))
    return out


def _copies(rows: list[tuple[int, str, int]]) -> list[bool]:
    """Whether a text shares COPIED of its shingles (five words, the SKETCH least hashes) with earlier ones of its label."""
    once: dict[int, set[int]] = {0: set(), 1: set()}
    out: list[bool] = []
    for at in range(0, len(rows), 500):
        some = rows[at : at + 500]
        for row, hashes, bounds in wordhash.grouped(pa.array([r[1] for r in some], type=pa.string()), lower=True):
            for i in range(len(bounds) - 1):
                s = shingles(hashes[bounds[i] : bounds[i + 1]], 5)
                mine, seen = set(np.unique(s)[:SKETCH].tolist()), once[some[row + i][2]]
                out.append(bool(mine) and len(mine & seen) >= COPIED * len(mine))
                seen |= mine
    return out


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """From (id, text, label) rows. With no rows, one class or no signal, every score is the share of label 1 (0 without rows)."""
    y = np.array([r[2] for r in rows])
    prior = float(y.mean()) if len(y) else 0.0
    if prior in (0.0, 1.0):
        return Model(None, 0.0, None, prior)
    first = np.arange(len(rows)) % 3 != 2
    copies = _copies(rows)
    forms: dict[str, str] = {}
    bags = [None if c else _sentences(r[1], forms) for r, c in zip(rows, copies, strict=True)]

    def machine(use):
        mine = [(b, t) for b, t, u in zip(bags, y, use, strict=True) if u and b is not None]
        return _machine([b for b, t in mine if t], [b for b, t in mine if not t])

    made = machine(first)
    if made is None and any(copies):  # copies count where there is nothing else
        bags = [_sentences(r[1], forms) for r in rows]
        made = machine(first)
    if made is None:
        return Model(None, 0.0, None, prior)
    model = Model(*made, None, prior)
    use = ~first if 0 < y[~first].sum() < (~first).sum() else np.ones(len(rows), bool)
    x, t = model.features([r[1] for r, u in zip(rows, use, strict=True) if u]), y[use]
    w = np.zeros(x.shape[1])
    for _ in range(50):  # logistic regression with a small ridge, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1]), x.T @ (t - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    whole = machine(np.ones(len(rows), bool)) or made
    return Model(*whole, w, prior)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Null texts are empty; null ids and repeated rows are kept; scores see no other column."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.scores([t or "" for t in pdf["text"]])})

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")


def learned(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model of labels.toxic, from rows whose crc32(doc_id as text) mod 4 is not 2."""
    return fit(sample(docs, labels, "toxic", remainder("doc_id", 4) != 2, bound))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, learned(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
