"""Quality by random-indexing word vectors, pooled per document, and a small calibrated network.

Word vectors: every key has a sparse ternary index vector drawn from its hash; its word vector is the sum of the index vectors
of the keys beside it (two to either side) over the fitting sample. Keys are words that are frequent in the sample; any
other word goes by its shape (case, ending, marks around it), and a word that repeats the one before it by a key for that.
A document is the mean and the spread of its words' vectors over the whole text, and its length.

Network: one hidden layer, trained with Adam in numpy; a temperature fitted on held-back sample rows calibrates the output.
Fitting takes at most SAMPLE labelled rows; scoring reads every document whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.batches import short_batches
from vertexloom.llm.labelled import remainder, sample

SAMPLE = 6_000
VOCABULARY = 20_000
MIN_COUNT = 5
DIM = 48
NONZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS = 400
THRESHOLD = 0.3
CACHE = 200_000
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Case, ending, and marks of a word."""
    core = word.strip("!?.,;:*#$%&|\"'()[]{}<>=+-_/\\~^@")
    left, _, right = word.partition(core) if core else ("", "", word)
    if not core:
        case = "-"
    elif core.isdigit():
        case = "0"
    elif core.isupper():
        case = "AA" if len(core) > 1 else "A"
    elif core[:1].isupper():
        case = "Aa"
    elif core.islower():
        case = "a"
    else:
        case = "x"
    end = core[-2:].lower() if case in ("a", "Aa", "AA") else ""
    return f"\0{case}{end}\0{left[:3]}\0{_RUN.sub(r'\1+', right)[:4]}\0{min(len(core), 30) // 6}"


class Vectors:
    """Keys and their vectors. ``table`` holds a word vector and its square per key; row 0 is for unseen shapes."""

    def __init__(self, keys: dict[str, int], table: np.ndarray):
        self.keys, self.table = keys, table
        self.cache: dict[str, int] = {}

    def ids(self, text: str) -> np.ndarray:
        keys, cache, same = self.keys, self.cache, self.keys.get("\0same", 0)
        out, before = [], None
        for w in text.split():
            if w == before:
                out.append(same)
                continue
            before = w
            i = keys.get(w)
            if i is None:
                i = cache.get(w)
                if i is None:
                    i = keys.get(shape(w), 0)
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = i
            out.append(i)
        return np.array(out, dtype=np.int32)

    def pooled(self, text: str) -> np.ndarray:
        ids = self.ids(text)
        n, d = len(ids), self.table.shape[1] // 2
        if not n:
            return np.zeros(2 * d + 2, dtype=np.float32)
        total = np.zeros(2 * d, dtype=np.float64)
        for at in range(0, n, 4096):
            total += self.table[ids[at : at + 4096]].sum(axis=0)
        total /= n
        spread = np.sqrt(np.maximum(total[d:] - total[:d] ** 2, 0))
        return np.concatenate([total[:d], spread, [np.log1p(n) / 10, 1.0]]).astype(np.float32)

    def __getstate__(self):
        return {"keys": self.keys, "table": self.table, "cache": {}}


def learn_vectors(texts: list[str]) -> Vectors:
    """Random indexing over the sample."""
    counts: Counter = Counter()
    for t in texts:
        counts.update(t.split())
    words = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= MIN_COUNT]
    known = set(words)
    shapes = sorted({shape(w) for w in counts if w not in known})
    keys = {k: i + 1 for i, k in enumerate([*words, "\0same", *shapes])}
    del counts
    v = len(keys) + 1
    index = np.zeros((v, DIM), dtype=np.float32)
    for k, i in keys.items():
        h = xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 7)
        for j in range(NONZERO):
            index[i, (h >> (j * 12)) % DIM] += 1 if h >> (50 + j) & 1 else -1
    vectors = Vectors(keys, np.zeros((v, 2 * DIM), dtype=np.float32))
    context = np.zeros((v, DIM), dtype=np.float32)
    ids = [vectors.ids(t) for t in texts]
    for at in range(0, len(ids), 500):  # pairs of a few hundred documents at a time
        pairs = [np.empty(0, dtype=np.int64)]
        for x in ids[at : at + 500]:
            for k in range(1, REACH + 1):
                if len(x) > k:
                    pairs += [x[k:].astype(np.int64) * v + x[:-k], x[:-k].astype(np.int64) * v + x[k:]]
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        for b in range(0, len(pair), 100_000):
            p, c = pair[b : b + 100_000], n[b : b + 100_000]
            a = p // v
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            context[a[first]] += np.add.reduceat(index[p % v] * np.sqrt(c)[:, None].astype(np.float32), first, axis=0)
    context += index
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    vectors.table = np.concatenate([context, context**2], axis=1)
    return vectors


class Network:
    """Two layers: tanh(x A) B, with scaled inputs and a temperature."""

    def __init__(self, mean, std, a, b, temperature=1.0):
        self.mean, self.std, self.a, self.b, self.temperature = mean, std, a, b, temperature

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        h = np.tanh(np.concatenate([z, np.ones((len(z), 1))], axis=1) @ self.a)
        return np.concatenate([h, np.ones((len(h), 1))], axis=1) @ self.b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the log loss with weight decay; every fifth row is held back for the temperature."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    fit = ~held if held.any() and len(set(y[held])) > 1 else np.ones(len(y), bool)
    mean, std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net = Network(mean, std, rng.normal(0, 0.15, (x.shape[1] + 1, HIDDEN)), rng.normal(0, 0.15, HIDDEN + 1))
    z = np.concatenate([np.clip((x[fit] - mean) / std, -6, 6), np.ones((int(fit.sum()), 1))], axis=1)
    t = y[fit]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.a, net.b)]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ net.a)
        h1 = np.concatenate([h, np.ones((len(h), 1))], axis=1)
        g = (1 / (1 + np.exp(-np.clip(h1 @ net.b, -40, 40))) - t) / len(t)
        grads = [z.T @ (np.outer(g, net.b[:-1]) * (1 - h * h)) + 1e-4 * net.a, h1.T @ g + 1e-4 * net.b]
        for p, d, m in zip((net.a, net.b), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.999 * m[1] + 0.001 * d * d
            p -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    if not fit.all():
        m = net.margin(x[held])
        loss = lambda k: np.logaddexp(0, np.where(y[held] > 0, -m, m) / k).mean()
        net.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return net


class Model:
    def __init__(self, vectors: Vectors, network: Network | None, prior: float):
        self.vectors, self.network, self.prior = vectors, network, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.empty(0)
        return self.network.probabilities(np.stack([self.vectors.pooled(t) for t in texts]).astype(np.float64))


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """From (id, text, label) rows. With no rows or one class, every score is the share of label 1 (a half without rows)."""
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows])
    prior = float(y.mean()) if len(y) else 0.5
    if prior in (0.0, 1.0) or not len(y):
        return Model(Vectors({}, np.zeros((1, 2 * DIM), dtype=np.float32)), None, prior)
    vectors = learn_vectors(texts)
    return Model(vectors, train(np.stack([vectors.pooled(t) for t in texts]), y), prior)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Null texts are empty; null ids and repeated rows are kept; scores don't see other columns."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.scores([t or "" for t in pdf["text"]])})

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")


def learned(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model of labels.quality, from rows whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(sample(docs, labels, "quality", remainder("doc_id", 5) != 0, bound))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, with their columns. Documents without words are rejected."""

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t or "" for t in texts]))

    short_batches(docs.sparkSession)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return docs.where(words).where(rate(F.col("text").cast("string")) >= threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, learned(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
