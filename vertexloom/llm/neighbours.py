"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node projects onto the difference of two rows drawn at random and splits at the median.
Largest inner products become nearest directions by one more coordinate that fills every vector up to the largest norm of the
table (a query has 0 there). Every row is indexed: it goes to its leaf in each tree. Leaves are to hold CELL rows of a large
table, and there are LEAVES of them in a tree at least where the table has the rows for it, so depth grows with the table (to
what the sample can split: SAMPLE / LEAST_SAMPLE leaves).

A query's leaves, of all trees, stand in one priority queue by the summed squared margins of the splits that lie between. The
queue is drained until the leaves taken hold EFFORT times the table's rows, counted in every tree, and TREES times k + 1 rows at
least, so that there are k others among them. Costs of all leaves are found level by level for many queries at once; taken in
order of cost they are what a heap would give one by one.

Leaves decide what moves: a row is sent once to each tree, a query once to each leaf it takes, and both meet by (tree, leaf).
Leaves with more than BLOCK rows or QUERIES queries are split into blocks. A block gives each query's k best of its rows, in
double precision on the original vectors; a query keeps the k best of all. Of equal vectors the k + 1 smallest ids are kept: no
other copy can be among a query's k nearest.

The vectors in the test tables are all but random in 64 dimensions, where trees separate little: EFFORT is set for a recall over
0.9 there, about two thirds of all rows as candidates, so work grows with rows times queries. On clustered vectors a far lower
``effort`` does, and work grows with it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.session import written

SAMPLE = 16_384
LEAST_SAMPLE = 4
TREES = 8
LEAVES = 64
CELL = 4_096
EFFORT = 1.2
BLOCK = 8_192
QUERIES = 4_096
#: Over this many parts equal vectors are thinned before they meet.
SALTS = 64


class Forest:
    """Trees over a sample of the rows; leaves are numbered through the forest, from 0.

    ``nodes``: per tree, (direction, cut, left, right), or (leaf number,)."""

    def __init__(self, sample: np.ndarray, top: float, rows: int, trees: int = TREES, seed: int = 17):
        self.top, self.nodes, self.leaves = max(top, 1e-300), [], 0
        rng = np.random.default_rng(seed)
        x = self.filled(sample)
        leaves = max(LEAVES, math.ceil(rows / CELL))
        size = max(LEAST_SAMPLE, len(x) // leaves)
        for _ in range(trees):
            tree: list[tuple] = []
            self._grow(x, np.arange(len(x)), size, rng, tree)
            self.nodes.append(tree)

    def filled(self, x: np.ndarray) -> np.ndarray:
        """Vectors scaled by the largest norm, with the coordinate that fills them up to it."""
        x = x / self.top
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def _grow(self, x: np.ndarray, rows: np.ndarray, size: int, rng: np.random.Generator, tree: list) -> int:
        at = len(tree)
        tree.append(())
        if len(rows) > size:
            a, b = rng.choice(rows, 2, replace=False)
            v = x[a] - x[b]
            n = np.linalg.norm(v)
            v = v / n if n > 0 else rng.normal(size=x.shape[1]) / math.sqrt(x.shape[1])
            p = x[rows] @ v
            cut = float(np.median(p))
            left, right = rows[p <= cut], rows[p > cut]
            if len(left) and len(right):
                tree[at] = (v, cut, self._grow(x, left, size, rng, tree), self._grow(x, right, size, rng, tree))
                return at
        tree[at] = (self.leaves,)
        self.leaves += 1
        return at

    def index(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers of vectors: rows x trees."""
        x = self.filled(x)
        out = np.zeros((len(x), len(self.nodes)), dtype=np.int32)
        for t, tree in enumerate(self.nodes):
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, rows = todo.pop()
                node = tree[at]
                if len(node) == 1:
                    out[rows, t] = node[0]
                elif len(rows):
                    go = x[rows] @ node[0] <= node[1]
                    todo += [(node[2], rows[go]), (node[3], rows[~go])]
        return out

    def costs(self, queries: np.ndarray) -> np.ndarray:
        """Queries x leaves: the place of each leaf in each query's queue."""
        norm = np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
        q = np.concatenate([queries / norm, np.zeros((len(queries), 1))], axis=1)
        out = np.zeros((len(q), self.leaves))
        for tree in self.nodes:
            todo = [(0, np.zeros(len(q)))]
            while todo:
                at, cost = todo.pop()
                node = tree[at]
                if len(node) == 1:
                    out[:, node[0]] = cost
                else:
                    d = q @ node[0] - node[1]
                    todo += [(node[2], cost + np.where(d > 0, d * d, 0)), (node[3], cost + np.where(d > 0, 0, d * d))]
        return out

    def search(self, queries: np.ndarray, counts: np.ndarray, want: float) -> list[np.ndarray]:
        """Leaves that each query takes from its queue, until they hold ``want`` rows."""
        order = np.argsort(self.costs(queries), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        return [o[: int(np.searchsorted(h, want)) + 1] for o, h in zip(order, held, strict=True)]


def valid(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part. Left out: null ids; vectors that are null, empty, zero or hold null or non-finite
    components; vectors of another length than most. Of rows that share an id the one with the smallest vector counts."""
    v = F.col(vector_column).cast("array<double>")
    good = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = good.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (length["n"] if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _thinned(table: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids; a third of the table may be one vector, so parts of a group are thinned first."""
    least = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    salted = table.withColumn("_code", F.xxhash64("v")).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    return least(least(salted, "_code", "_salt", "v"), "_code", "v").select("vec_id", "v")


def search(rows: DataFrame, queries: F.Column, k: int = 20, effort: float = EFFORT, trees: int = TREES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` (over vec_id) holds, its k nearest found, its own id left
    out; nearest first, ties to the smaller id. All candidates, if fewer. An empty table gives an empty one."""
    spark = rows.sparkSession
    table = written(valid(rows, id_column, vector_column), "vectors")
    index = written(_thinned(table, k), "distinct")
    facts = index.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
    n, asked = facts["n"], table.where(queries)
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a share of the rows by hash, about SAMPLE in number
    share = min(1.0, SAMPLE / n) * (1 << 30)
    drawn = index.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).toPandas().sort_values("vec_id")
    forest = Forest(np.array(drawn["v"].tolist(), dtype=float).reshape(len(drawn), -1) if len(drawn) else np.zeros((0, 1)), facts["top"], n, trees)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), dtype=float)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "x": [r.tobytes() for r in x], "leaves": list(forest.index(x))})

    held = written(index.mapInPandas(place, "vec_id long, x binary, leaves array<int>"), "placed")
    tally = lambda df: {r["leaf"]: r["count"] for r in df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    sizes = tally(held)  # a row per leaf
    counts = np.array([sizes.get(i, 0) for i in range(forest.leaves)], dtype=np.int64)
    want = min(max(effort * n, trees * (k + 1)), int(counts.sum()))

    def walk(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                x = np.array(some["v"].tolist(), dtype=float)
                yield pd.DataFrame({"query_id": some["vec_id"], "q": [r.tobytes() for r in x], "leaves": forest.search(x, counts, want)})

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asks = written(asked.repartition(spread, "vec_id").mapInPandas(walk, "query_id long, q binary, leaves array<int>"), "asks")
    crowds = tally(asks)
    # blocks of rows and of queries in each leaf
    parts = spark.createDataFrame([(i, max(1, -(-int(counts[i]) // BLOCK)), max(1, -(-crowds.get(i, 0) // QUERIES))) for i in range(forest.leaves)], "leaf int, rows int, queries int")
    by = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    parts = F.broadcast(parts)  # a row per leaf, of which a sample row makes one at most
    mine = held.select("vec_id", "x", F.explode("leaves").alias("leaf")).join(parts, "leaf").select("leaf", by("vec_id", "rows").alias("i"), every("queries").alias("j"), "vec_id", "x")
    theirs = asks.select("query_id", "q", F.explode("leaves").alias("leaf")).join(parts, "leaf").select("leaf", every("rows").alias("i"), by("query_id", "queries").alias("j"), "query_id", "q")

    def best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, asking = mine["vec_id"].to_numpy(), theirs["query_id"].to_numpy()
        x, q = (np.frombuffer(b"".join(c), dtype=float).reshape(len(c), -1) for c in (mine["x"], theirs["q"]))
        out = []
        for at in range(0, len(q), 512):
            near = q[at : at + 512] @ x.T
            near[asking[at : at + 512, None] == ids] = -np.inf
            least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(near), -np.inf)
            who, which = np.nonzero((near >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (near > -np.inf))
            score = (x[which] * q[at + who]).sum(axis=1)  # row by row in one order, so that equal vectors have equal scores
            order = np.lexsort((ids[which], -score, who))
            who, which, score = who[order], which[order], score[order]
            first = np.searchsorted(who, who)
            keep = np.arange(len(who)) - first < k
            out.append(pd.DataFrame({"query_id": asking[at + who[keep]], "vec_id": ids[which[keep]], "score": score[keep]}))
        return pd.concat(out)

    found = mine.groupBy("leaf", "i", "j").cogroup(theirs.groupBy("leaf", "i", "j")).applyInPandas(best, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 20 nearest found to each row whose vec_id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
