"""Bounded samples of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.session import written

#: Code points of a sample, at most.
CHARS = 40_000_000


def remainder(id_column: str, divisor: int) -> F.Column:
    """crc32(id as text) mod divisor; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(divisor))


def sample(docs: DataFrame, labels: DataFrame, column: str, learn: F.Column, bound: int, chars: int = CHARS) -> list[tuple[int, str, int]]:
    """At most ``bound`` (doc_id, text, label) rows, of ``chars`` code points in all (but one row at least), for which ``learn``
    (over doc_id) holds: whole texts, those first by a hash of the id.

    A document with several labels counts by their mean (a half is 1); null labels and ids are left out; of repeated rows of
    an id the one with the largest text is taken. Ids are chosen first, so that texts of chosen rows alone reach the driver. The same rows come
    whatever the partitions.
    """
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn).groupBy(F.col("doc_id").alias("_id")).agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    known = docs.select(F.col("doc_id").alias("_id")).where("_id is not null")
    eligible = votes.join(known, "_id", "left_semi")
    # a hash threshold first, so that no partition sends its own top rows to the driver
    share = min(1.0, (1.5 * bound + 1000) / max(1, eligible.count())) * (1 << 30)
    code = F.xxhash64("_id")
    ids = eligible.where(F.pmod(code, F.lit(1 << 30)) <= share).orderBy(F.pmod(code, F.lit(1 << 30)), "_id").limit(bound)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("text").cast("string").alias("text"), "label")
    # texts of the table are read once, and of an id's rows one stays; lengths come first, then what fits
    chosen = written(chosen.groupBy("doc_id", "label").agg(F.max("text").alias("text")), "sample")
    lengths = chosen.select("doc_id", F.length("text").alias("n"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    left, kept = chars, []
    for r in sorted(lengths.collect(), key=lambda r: (r["h"], r["doc_id"])):  # at most ``bound`` rows
        left -= r["n"] or 0
        if left < 0 and kept:
            break
        kept.append(r["doc_id"])
    if not kept:
        return []
    chosen = chosen.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in kept], "_id long")), F.col("doc_id") == F.col("_id"))
    return sorted((r["doc_id"], r["text"] or "", r["label"]) for r in chosen.select("doc_id", "text", "label").toLocalIterator())
