"""Benchmark decontamination by latent semantic retrieval.

Words (lower-cased, parted by blanks and marks) become term numbers: the vocabulary is the benchmark's own words, any other word
is 0. The corpus is cut into passages of PASSAGE words. TF-IDF weights come from all documents (occurrences against passages); terms with
more than MAX_DF occurrences per passage weigh nothing. A randomised SVD of the passage-by-term matrix gives the latent space: every task adds up
its share of A'A times a random thin matrix (terms x DIM) from its passages, the shares are summed in two steps by blocks of
terms, and the driver holds matrices of that size alone. Eigenvectors follow from that one pass.

Candidates are windows of SCAN words (at half-window steps) whose cosine in the latent space to a piece of an item (of SCAN
words; a shorter item is one piece) is at least COSINE. Any SCAN words share three quarters with some window. They are
checked on term numbers, on which all words of the item are exact: the longest common subsequence of the item and the
words around the passage must hold LCS of the item, or WEAK of it together with its answer (its last sentence). Items of
under SHORT words must occur whole and in one piece; they are looked up by their rarest word, without the cosine.

Benchmarks are taken in blocks of at most BLOCK_WORDS words, so what is broadcast is bounded however large the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.columns import free_names
from vertexloom.llm.batches import short_batches
from vertexloom.session import written

PASSAGE = 40
SCAN = 24
STEP = SCAN // 2
DIM = 64
MAX_DF = 0.1
COSINE = 0.45
LCS = 0.75
WEAK = 0.6
ANSWER = 0.8
SHORT = 8
BLOCK_WORDS = 200_000
TERMS = 512
#: Marks that part words, and blanks in their stead.
_MARKS = b".,;:!?|\"'()[]{}<>*#%&$+-=~_/\\`@^"
_BLANKS = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[bytes]:
    """Lower-case words of a text in UTF-8; marks part words."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()


class Items:
    """A block of benchmark items: term numbers (from 1), sequences, answers."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.terms: dict[bytes, int] = {}
        self.ids, self.sequences, self.answers = [], [], []
        for item, text in rows:
            said = words(text or "")
            if not said:
                continue
            last = words(_SENTENCE.split(text.strip())[-1])
            self.ids.append(item)
            self.sequences.append([self.terms.setdefault(w, len(self.terms) + 1) for w in said])
            self.answers.append([self.terms[w] for w in (last if len(last) >= 4 else said[-6:])])

    def encode(self, text: str) -> np.ndarray:
        """Term numbers of all words of a text; 0 for words that no item has."""
        return np.array(list(map(self.terms.get, words(text), repeat(0))), dtype=np.int32)


def lcs(masks: dict[int, int], m: int, words) -> int:
    """Length of the longest common subsequence of an item of m words (term -> bits of its places) and words, by bit vectors."""
    row = full = (1 << m) - 1
    for w in words:
        hit = masks.get(w)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return m - row.bit_count()


def masks_of(sequence: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(sequence):
        out[t] = out.get(t, 0) | 1 << i
    return out


def _pieces(batch: list[np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms of each piece of ``step`` words, filled up with 0; pieces before each document)."""
    n = np.array([-(-len(x) // step) for x in batch], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(start[-1]) * step, dtype=np.int32)
    for x, at in zip(batch, start, strict=False):
        out[at * step : at * step + len(x)] = x
    return out.reshape(-1, step), start


def _gathered(pieces: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each piece's terms, a place at a time."""
    out = np.zeros((len(pieces), rows.shape[1]), dtype=np.float32)
    for j in range(pieces.shape[1]):
        out += rows[pieces[:, j]]
    return out


def _summed(rows: np.ndarray, index: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """rows[index] summed by sorted keys in 0..n-1, sixteen at a time (numpy's own sums down columns are slow)."""
    out = np.zeros((n, rows.shape[1]))
    while len(keys):
        key, first, count = np.unique(keys, return_index=True, return_counts=True)
        blocks = -(-count // 16)
        begin = np.concatenate([[0], np.cumsum(blocks)])
        pieces = np.full(int(begin[-1]) * 16, len(rows), dtype=np.int64)
        pieces[np.repeat(begin[:-1] * 16 - first, count) + np.arange(len(keys))] = index
        rows = _gathered(pieces.reshape(-1, 16), np.concatenate([rows, np.zeros((1, rows.shape[1]), dtype=rows.dtype)]))
        if blocks.max() == 1:
            out[key] = rows
            break
        keys, index = np.repeat(key, blocks), np.arange(len(rows))
    return out


def _unpack(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Documents in groups of some hundred thousand words."""
    arrays, at, size = [], 0, 0
    for i, b in enumerate(pdf["words"]):
        arrays.append(np.frombuffer(b, dtype=np.int32))
        size += len(arrays[-1])
        if size > 200_000 or i == len(pdf) - 1:
            yield pdf.iloc[at : i + 1], arrays
            arrays, at, size = [], i + 1, 0


def passage_counts(encoded: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """(occurrences of each term, passages) over all documents; the passages stand at 0."""

    def count(batches):
        total = np.zeros(n_terms + 1, dtype=np.int64)
        passages = 0
        for pdf in batches:
            for _, arrays in _unpack(pdf):
                total += np.bincount(np.concatenate(arrays), minlength=n_terms + 1)
                passages += sum(-(-len(x) // PASSAGE) for x in arrays)
        total[0] = passages
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    rows = encoded.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_terms + 1, dtype=np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out, int(out[0])


def _gram(encoded: DataFrame, weights: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """A'A times a thin matrix, over the unit TF-IDF passages of all documents."""
    n_rows, dim = thin.shape
    # the last column sums squared weights, for the passages' lengths
    heavy = np.concatenate([thin * weights[:, None], weights[:, None] ** 2], axis=1).astype(np.float32)

    def share(batches):
        total = np.zeros((n_rows, dim), dtype=np.float64)
        for pdf in batches:
            for _, arrays in _unpack(pdf):
                pieces, _ = _pieces(arrays, PASSAGE)
                got = _gathered(pieces, heavy)
                seen = got[:, :dim] / np.maximum(got[:, dim:], 1e-9)
                where, place = np.nonzero(weights[pieces])
                terms = pieces[where, place]
                order = np.argsort(terms, kind="stable")
                total += _summed(seen, where[order], terms[order], n_rows) * weights[:, None]
        for b in range(0, n_rows, TERMS):
            yield pd.DataFrame({"block": [b // TERMS], "m": [total[b : b + TERMS].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in pdf["m"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "salt": pdf["salt"].iloc[:1], "m": [total.tobytes()]})

    kind = "block int, salt int, m binary"
    parts = encoded.mapInPandas(share, "block int, m binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = parts.groupBy("block", "salt").applyInPandas(add, kind).withColumn("salt", F.lit(0))
    rows = once.groupBy("block", "salt").applyInPandas(add, kind).collect()
    return np.concatenate([np.frombuffer(r["m"], dtype=np.float64).reshape(-1, dim) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros((n_rows, dim))


def latent_space(encoded: DataFrame, weights: np.ndarray, dim: int = DIM, seed: int = 23) -> np.ndarray:
    """Terms x dim: the terms' directions among the leading right singular vectors of the TF-IDF passages, at unit length (so
    that rare terms, of which those vectors hold little, keep their weight), with the spread along the vectors evened out.

    One pass over the corpus: with Y = A'A W for a random W, A'A is nearly Y (W'Y)^-1 Y', whose eigenvectors come from the
    small singular value decomposition of Y times the inverse Cholesky factor of W'Y.
    """
    dim = min(dim, len(weights))
    thin, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(weights), dim)))
    image = _gram(encoded, weights, thin)
    shift = 1e-7 * max(np.linalg.norm(image), 1e-12)
    image = image + shift * thin
    core = thin.T @ image
    factor = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * shift * np.eye(dim))
    basis, values, _ = np.linalg.svd(np.linalg.solve(factor, image.T).T, full_matrices=False)
    values = np.maximum(values**2 - shift, 0)
    keep = values > values.max() * 1e-6
    places = basis[:, keep] / np.sqrt(values[keep]) if keep.any() else basis
    return places / np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-12)


def _checked(items: Items, masks: list[dict[int, int]], answers: list[dict[int, int]], k: int, words: np.ndarray, at: int) -> tuple[float, bool, int, int] | None:
    """(share of the item found, answer found, region) around a window at word ``at``, if that makes a contamination."""
    m = len(items.sequences[k])
    lo, hi = max(0, at - m), min(len(words), at + SCAN + m)
    region = words[lo:hi].tolist()
    share = lcs(masks[k], m, region) / m
    if share < WEAK:
        return None
    a = items.answers[k]
    answered = lcs(answers[k], len(a), region) >= ANSWER * len(a)
    return (share, answered, lo, hi) if share >= LCS or answered else None


def _whole(words: np.ndarray, item: np.ndarray, anchor: int) -> Iterator[int]:
    """Positions of a whole item in a text, found by one of its words."""
    m = len(item)
    at = np.flatnonzero(words[anchor : len(words) - m + anchor + 1] == item[anchor])
    for j in range(m):
        at = at[words[at + j] == item[j]]
    yield from at.tolist()


def _search(encoded: DataFrame, items: Items, weights: np.ndarray, counts: np.ndarray, space: np.ndarray, cosine: float) -> DataFrame:
    heavy = (space * weights[:, None]).astype(np.float32)
    short: dict[int, list[tuple[int, np.ndarray, int]]] = {}  # by rarest word
    for k, s in enumerate(items.sequences):
        if len(s) < SHORT:
            anchor = int(np.argmin(counts[s]))
            short.setdefault(s[anchor], []).append((k, np.array(s, dtype=np.int32), anchor))
    rare = np.zeros(len(weights), dtype=bool)
    rare[list(short)] = True
    pieces = [(k, s[a : a + SCAN]) for k, s in enumerate(items.sequences) if len(s) >= SHORT for a in sorted({*range(0, max(1, len(s) - SCAN + 1), SCAN), max(0, len(s) - SCAN)})]
    owner = np.array([k for k, _ in pieces], dtype=np.int64)
    points = np.array([heavy[s].sum(axis=0) for _, s in pieces], dtype=np.float32).reshape(-1, heavy.shape[1])
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    masks, answers = [masks_of(s) for s in items.sequences], [masks_of(s) for s in items.answers]
    # an item without any weighing term has no direction: it is compared with passages that hold its first word
    blank = [(k, items.sequences[k][0]) for k in np.unique(owner).tolist() if not np.abs(points[owner == k]).sum()]

    def find(batches):
        for pdf in batches:
            out = []
            for docs, arrays in _unpack(pdf):
                for d, said in enumerate(arrays):
                    for t in np.unique(said[rare[said]]).tolist():
                        for k, item, anchor in short[t]:
                            out += [(docs["doc"].iloc[d], docs["tag"].iloc[d], items.ids[k], 1.0, True, a, a + len(item)) for a in _whole(said, item, anchor)]
                pieces, start = _pieces(arrays, STEP)
                n = len(pieces)
                half = _gathered(pieces, heavy)
                inner = np.ones(n, dtype=bool)
                inner[start[1:][start[1:] > start[:-1]] - 1] = False  # a document's last piece stands alone
                at = np.flatnonzero(inner)
                full = half.copy()
                full[at] += half[at + 1]
                norm = np.linalg.norm(full, axis=1)
                for b in range(0, n, 4096):
                    live = np.flatnonzero(norm[b : b + 4096] > 0) + b
                    hit, k = np.divmod(np.flatnonzero((full[live] / norm[live, None]) @ points.T >= cosine), len(points))
                    near = sorted(set(zip(live[hit].tolist(), owner[k].tolist(), strict=True)))
                    near += [(p, k) for k, t in blank for p in (np.flatnonzero((pieces[b : b + 4096] == t).any(axis=1)) + b).tolist()]
                    for p, k in near:
                        d = int(np.searchsorted(start, p, side="right")) - 1
                        got = _checked(items, masks, answers, k, arrays[d], (p - int(start[d])) * STEP)
                        if got:
                            out.append((docs["doc"].iloc[d], docs["tag"].iloc[d], items.ids[k], *got))
            yield pd.DataFrame(out, columns=["doc", "tag", "item_id", "lcs", "answer", "lo", "hi"])

    rows = encoded.mapInPandas(find, "doc long, tag int, item_id long, lcs double, answer boolean, lo int, hi int")
    return rows.groupBy("doc", "tag", "item_id").agg(F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in order of id, in blocks of at most BLOCK_WORDS words (a longer item is a block of its own)."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


SCHEMA = "doc long, tag int, item_id long, lcs double, answer boolean, lo int, hi int"


def contaminations(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", cosine: float = COSINE) -> DataFrame:
    """(doc, tag, item_id, lcs, answer, lo, hi): documents (by id and hash of the text) that hold an item, the share of its words
    found in order, whether its answer was, and the word range around it.

    Null texts are empty; a null doc_id gives a null doc; items that are null or without words match nothing; repeated rows
    are one. Empty tables give an empty one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.hash(text).alias("tag"), text.alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(benchmark):
        items = Items(block)
        if not items.ids:
            continue

        def encode(batches, items=items):
            for pdf in batches:
                yield pd.DataFrame({"doc": pdf["doc"], "tag": pdf["tag"], "words": [items.encode(t).tobytes() for t in pdf["text"]]})

        encoded = written(rows.mapInPandas(encode, "doc long, tag int, words binary"), "terms")
        counts, passages = passage_counts(encoded, len(items.terms))
        if not passages:
            continue
        weights = np.log((1 + passages) / (1 + counts)).astype(np.float32)
        weights[(counts > max(50, MAX_DF * passages)) | (weights <= 0)] = 0
        weights[0] = 0
        out = out.unionByName(_search(encoded, items, weights, counts, latent_space(encoded, weights), cosine))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The documents that hold no benchmark item, with their columns, whatever those are named.

    Null and empty texts hold none. Rows with a null id and rows that share an id are told apart by their texts' hashes; rows
    equal in both go or stay together. An empty table gives an empty one; an empty benchmark leaves all.
    """
    doc, tag = free_names(docs.columns, "_doc", "_tag")
    bad = written(contaminations(docs, benchmark, id_column, text_column, **how).select(F.col("doc").alias(doc), F.col("tag").alias(tag)).distinct(), "contaminated")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.join(bad, F.col(id_column).cast("long").eqNullSafe(F.col(doc)) & (F.hash(text) == F.col(tag)), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, lcs, answer of every document that holds a benchmark item."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminations(docs, benchmark).select(F.col("doc").alias("doc_id"), "item_id", F.round("lcs", 6).alias("lcs"), "answer")
