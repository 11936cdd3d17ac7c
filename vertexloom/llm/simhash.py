"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at RADIUS (3) or fewer differing bits. Distinct fingerprints only (copies share one) go through two steps:

1. Colliding: the 64 bits are cut into thirds. Over the 42 or 43 bits that remain when one third is left out, every
   fingerprint emits all its variants within half the radius (rounded down: 1 bit), 131 in all. Of three differing bits, at
   most two remain when the third that holds most of them is left out, unless all three lie in one third; then nothing
   remains when it is left out. Two linked fingerprints hence always share a variant. Variants are shuffled; those with two
   or more fingerprints are collisions. Neighbours in a variant's order within RADIUS are linked there and then. A variant
   whose neighbours are all linked is one component, and one of two fingerprints is settled; the members of any other go on
   to step 2. A variant costs a row of 16 bytes, and all 2081 variants of a whole ball of radius 2
   would cost 16 times as many.
2. Verified: those members emit whole 64-bit variants: all within 1 bit, and those with an even number of set bits
   also the variants at 2 bits that lie in one half of the word (of three differing bits two always do). Linked pairs at 1 or
   2 bits meet at a variant within 1 bit of both; pairs at 3 bits have one even and one odd member and meet at a variant 2
   bits from the even and 1 bit from the odd one. Members of a variant's group are linked with the smallest member within 1
   bit of it; distances add up to 3 at most, and every pair is checked again by its differing bits. A group has at most 65
   members within 1 bit and 992 at 2 bits, whatever the corpus holds, so there are neither pairs of all members nor hot keys.

Components are found on the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.llm import jaccard
from vertexloom.llm.columns import free_names
from vertexloom.llm.components import connected_components
from vertexloom.llm.batches import short_batches
from vertexloom.session import written

RADIUS = 3
WIDTH = 3
SEED = 42
CHUNK = 1 << 15


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles of a whole text (A-Z lower-cased), repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        said: Iterator[bytes] = iter([b" ".join(words)] if words else [])
    else:
        said = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in said), dtype="<u8")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text (A-Z lower-cased); 0 without words."""
    return folded(shingles(text, width)) & ((1 << 64) - 1)


def folded(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, tag, fp): the text's hash, and its SimHash as a signed 64-bit integer. Null texts count as empty."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tag": pdf["tag"], "fp": np.array([fingerprint(t, width) for t in pdf["text"]], dtype="<u8").view("<i8")})

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return rows.mapInPandas(run, "doc_id long, tag long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _thirds() -> list[tuple[int, int]]:
    """(flip, mask) of the variants over the bits that remain when a third is left out."""
    out = []
    for lo, hi in ((0, 21), (21, 42), (42, 64)):
        keep = ((1 << 64) - 1) ^ (((1 << hi) - 1) ^ ((1 << lo) - 1))
        out += [(0, keep)] + [(1 << b, keep) for b in range(64) if not lo <= b < hi]
    return out


def _ball() -> tuple[list[int], list[int]]:
    """Masks within 1 bit; masks of 2 bits that lie in one half."""
    near = [0] + [1 << b for b in range(64)]
    pairs = [1 << a | 1 << b for a in range(64) for b in range(a) if a // 32 == b // 32]
    return near, pairs


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that span exactly the components at RADIUS bits."""
    flips = F.array(*(F.struct(F.lit(_signed(f)).alias("flip"), F.lit(_signed(m)).alias("mask")) for f, m in _thirds()))
    variants = fps.select("fp", F.inline(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.col("mask")).alias("key"))
    before = F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))
    variants = variants.withColumn("before", F.when(before != F.col("fp"), before))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) > RADIUS
    group = Window.partitionBy("key")
    variants = variants.select("fp", "before", far.alias("far"), F.count("before").over(group).alias("more"), F.max(far).over(group).alias("broken"))
    met = written(variants.where("more > 0 and (before is not null and not far or more > 1 and broken)"), "collisions")
    chained = met.where("before is not null and not far").select("fp", F.col("before").alias("to"))
    colliding = met.where("more > 1 and broken").select("fp").distinct()
    near, pairs = _ball()
    masks = lambda xs: F.array(*(F.lit(_signed(x)) for x in xs))
    even = F.bit_count("fp") % 2 == 0
    ball = colliding.select("fp", F.explode(F.when(even, masks(near + pairs)).otherwise(masks(near))).alias("mask"))
    ball = ball.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), (F.bit_count("mask") < 2).alias("near"))
    least = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("key"))
    whole = ball.select("fp", least.alias("to")).where("fp <> to").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("to"))) <= RADIUS)
    return chained.unionByName(whole).select(F.col("fp").alias("u"), F.col("to").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similar: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id, tag, component) for every row: component_id is the smallest doc_id reachable over links, itself
    included, tag the text's hash, and component a name that is never null.

    With ``similar``, texts link if their sets of shingles are at least so similar (Jaccard): near fingerprints are
    candidates, MinHash gives more of them, and each is checked; an exact join finds what they leave out. Fingerprints then come from another hash of words.

    Null texts are empty; texts without words have fingerprint 0 and link like any other. Repeated rows give repeated rows.
    A null doc_id is kept; it counts for a component only where no other id is there (component_id is null then). Very long
    texts are read whole. An empty table gives an empty one.
    """
    short_batches(docs.sparkSession)
    if similar is None:
        node, rows = "fp", written(fingerprints(docs, id_column, text_column, width), "fingerprints")
        linked = links(rows.select("fp").distinct())
    else:
        node, rows = "tag", written(jaccard.banded(docs, id_column, text_column, width, similar), "bands")
        told = rows.groupBy("fp").agg(F.min("tag").alias("tag"))
        same = rows.select("fp", F.col("tag").alias("v")).distinct().join(told, "fp").select(F.col("tag").alias("u"), "v").where("u <> v")
        near = links(told.select("fp")).join(told.withColumnsRenamed({"fp": "u", "tag": "a"}), "u").join(told.withColumnsRenamed({"fp": "v", "tag": "b"}), "v")
        near = written(same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v"))), "near")
        linked = jaccard.links(docs, rows, near, text_column, width, similar)
    found = connected_components(linked)
    nodes = rows.groupBy(node).agg(F.min("doc_id").alias("first"))
    rooted = nodes.join(found, nodes[node] == found.node, "left").select(nodes[node], "first", F.coalesce("root", nodes[node]).alias("component"))
    best = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(best, "component").select(node, "component", "component_id"), node).select("doc_id", "fp", "component_id", "tag", "component")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """One document of each group of near-duplicates: of the smallest id in its component.

    Rows that share that id are told apart by their texts: equal ones are one, and of unlike ones that are near-duplicates the
    one whose text has the smallest hash stays; unlike ones that aren't stay both. Rows with a null id count as larger
    than any; a component of such alone keeps one. Null texts are empty, and all texts without words are one group. Columns are
    kept, whatever they are named; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    code = F.xxhash64(text)
    rows = near_duplicates(docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")), "doc_id", "text", **how)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tag")).alias("b"))
    kept = best.select(F.col("b.doc_id").alias("id"), F.col("b.tag").alias("tag"))
    id_, tag = free_names(docs.columns, "_kept_id", "_kept_tag")
    kept = kept.toDF(id_, tag)
    chosen = docs.join(kept, F.col(id_column).cast("long").eqNullSafe(F.col(id_)) & (code == F.col(tag)), "left_semi")
    # rows equal in id and text: one of them
    key = chosen.withColumns({id_: F.col(id_column).cast("long"), tag: code})
    return key.dropDuplicates([id_, tag]).select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
