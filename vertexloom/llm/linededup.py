"""Repeated passages, by winnowing over hashes of word runs.

A word is repeated if it lies in LEAST words that stood before: in an earlier document, by id, or earlier in its own. Only
later repeats go. Lines here begin at every word, since passages are also cut inside lines: a line is RUN words.

1. Winnowing: of the line hashes in every LEAST words, the smallest (the first of equal ones) is the fingerprint, so equal
   passages of LEAST words have the same one. Neighbouring starts with one fingerprint at one place make a stretch: the
   starts, and the words from the first start to the end of the last passage, which reach both ways from the fingerprint.
   Stretches are one row each, of two hashes (fingerprint; all the stretch's words), place, and number of starts.
2. Positions are joined by fingerprint. Stretches alike in all words repeat the first of them whole: copies and long passages
   cost no more than that, however many share them.
3. Where stretches with one fingerprint differ, matches end inside them. The first of each kind is extended to the word:
   the hashes of its passages of LEAST words (at most LEAST - RUN + 1) are joined, and those that stood before are repeats.

So the result is exact but for equal 64-bit hashes: no partner is preferred, and nothing is as large as a group squared.
Texts are read twice, the second time only those with such differing stretches, which alone are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import wordhash
from vertexloom.llm.columns import free_names
from vertexloom.llm.wordhash import between, prefixes
from vertexloom.llm.batches import short_batches
from vertexloom.session import written

LEAST = 50
RUN = 20
#: The id that stands for a null one: it comes first.
NO_ID = -(1 << 63)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bits of a line hash that rank it; the rest of the 64 hold its place.
_RANK = ~np.uint64((1 << 20) - 1)


def _smallest(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return x if width == size else np.minimum(x[: len(x) - size + width], x[size - width :])


def stretches(hashes: np.ndarray, bounds: np.ndarray, least: int, run: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(fingerprint, hash of all words, first start, starts) of the stretches in documents' words; see step 1.

    Works on WORDS starts at a time; a stretch over that border counts as two, which changes no result."""
    for at in range(0, len(hashes) - least + 1, wordhash.WORDS):
        some = hashes[at : at + wordhash.WORDS + least - 1]
        n = len(some) - least + 1
        start = np.arange(n)
        end = bounds[np.searchsorted(bounds, start + at, side="right")] - at
        start = start[start + least <= end]
        if not len(start):
            continue
        p = prefixes(some)
        place = np.arange(len(some) - run + 1)
        lines = between(p, place, place + run)
        chosen = (_smallest((lines & _RANK) | place.astype(np.uint64), least - run + 1) & ~_RANK)[start].astype(np.int64)
        new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (np.diff(start) != 1)])
        first, count = start[new], np.diff(np.append(new, len(start)))
        yield lines[chosen[new]], between(p, first, first + count - 1 + least), first + at, count


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, tag, text): a document is known by its id (null: NO_ID) and a hash of its text, so equal rows are one."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text).alias("tag"), text.alias("text"))


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, run: int = RUN) -> DataFrame:
    """(doc, tag, spans array<struct<start, end>>): word ranges that stood before, for documents that have any.

    Documents are in order of id (a null id, here NO_ID, comes first), then of their text's hash; rows equal in id and text
    are one document. Null texts are empty, and texts under ``least`` words repeat nothing. Texts of any length are
    read whole, in blocks. An empty table gives an empty one. ``run`` <= ``least`` sets the cost, not the result.
    """
    short_batches(docs.sparkSession)
    keyed = _keyed(docs, id_column, text_column)

    def cut_up(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            for row, hashes, bounds in wordhash.grouped(batch.column("text")):
                for fp, ctx, start, count in stretches(hashes, bounds, least, run):
                    owner = np.searchsorted(bounds, start, side="right") - 1
                    with np.errstate(over="ignore"):  # within a document, all but the first of equal stretches
                        once = fp * np.uint64(3) ^ ctx ^ owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    again = np.ones(len(fp), dtype=bool)
                    again[np.unique(once, return_index=True)[1]] = False
                    columns = [fp.view(np.int64), ctx.view(np.int64), doc[row + owner], tag[row + owner], (start - bounds[owner]).astype(np.int32), count.astype(np.int32), again]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "ctx", "doc", "tag", "start", "n", "again"])

    rows = written(keyed.mapInArrow(cut_up, "fp long, ctx long, doc long, tag int, start int, n int, again boolean"), "stretches")
    fresh = rows.where("not again")
    # equal rows come twice; one is enough for both, and their stretches fall on the same place
    shared = fresh.groupBy("fp").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b"), F.count("*").alias("c")).where("c > 1").select("fp", (F.col("a") != F.col("b")).alias("mixed"))
    live = written(fresh.join(written(shared, "shared"), "fp").select("fp", "ctx", "mixed", "doc", "tag", "start", "n"), "live")
    place = F.struct("doc", "tag", "start")
    firsts = written(live.groupBy("fp", "ctx").agg(F.min(place).alias("f")), "firsts")
    known = live.join(firsts, ["fp", "ctx"])
    is_first = (F.col("doc") == F.col("f.doc")) & (F.col("tag") == F.col("f.tag")) & (F.col("start") == F.col("f.start"))
    known = written(known.select("doc", "tag", "start", "n", "mixed", is_first.alias("is_first")).where("mixed or not is_first"), "known")
    asked = known.where("mixed and is_first").groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "n")).alias("asked"))

    def extend(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, wanted = (batch.column(c) for c in ("doc", "tag", "asked"))
            for row, hashes, bounds in wordhash.grouped(batch.column("text")):
                some = wanted.slice(row, len(bounds) - 1)
                flat = some.flatten()
                owner = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy(zero_copy_only=False))
                start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                start, owner = np.repeat(start + bounds[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(owner, n)
                for at in range(0, len(hashes), wordhash.WORDS):
                    mine = (start >= at) & (start < at + wordhash.WORDS)
                    here, whose = start[mine] - at, owner[mine]
                    if len(here):
                        codes = between(prefixes(hashes[at : at + wordhash.WORDS + least]), here, here + least)
                        columns = [codes.view(np.int64), doc.take(pa.array(row + whose)), tag.take(pa.array(row + whose)), (here + at - bounds[whose]).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["code", "doc", "tag", "start"])

    concerned = keyed.join(asked, ["doc", "tag"])
    passages = written(concerned.mapInArrow(extend, "code long, doc long, tag int, start int"), "passages")
    first = written(passages.groupBy("code").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("code", "f"), "first")
    later = passages.join(first, "code").where(~is_first).select("doc", "tag", "start", F.lit(1).alias("n"))
    found = later.unionByName(rows.where("again").select("doc", "tag", "start", "n")).unionByName(known.where("not is_first").select("doc", "tag", "start", "n"))
    ends = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "n")).alias("starts"))

    def merge(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for starts in batch.column("starts"):
                pairs = starts.values
                a, n = (pairs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate((a + n - 1 + least)[order])
                new = np.flatnonzero(a[1:] > b[:-1]) + 1
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a[np.r_[0, new]], b[np.r_[new - 1, len(b) - 1]], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(spans, type=kind)], names=["doc", "tag", "spans"])

    return ends.mapInArrow(merge, "doc long, tag int, spans array<struct<start:int,end:int>>")


def cut(text: str, spans) -> str:
    """The text without word ranges; each goes with the blanks after it."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for s in spans:
        out.append(text[done : at[s["start"]]])
        done = at[s["end"]]
    return "".join([*out, text[done:]]).rstrip() if out else text


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """The documents without their repeats of what stood before; documents of which nothing is left are dropped.

    Columns are kept (a column n_chars with the length of the text is set anew), whatever they are named. Documents without
    repeats come through as they are, null and empty texts and null ids among them. Rows equal in id and text are cut alike.
    An empty table gives an empty one.
    """
    doc, tag, spans = free_names(docs.columns, "_doc", "_tag", "_spans")
    found = repeats(docs, id_column, text_column, least).toDF(doc, tag, spans)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    joined = docs.join(found, (F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)) == F.col(doc)) & (F.hash(text) == F.col(tag)), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else cut(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    touched = F.col(spans).isNotNull()
    rest = without(F.when(touched, F.col(text_column).cast("string")), spans)  # Python gets the texts that change
    clean = joined.withColumn(tag, rest).withColumn(text_column, F.when(touched, F.col(tag)).otherwise(F.col(text_column)))
    clean = clean.where(~touched | (F.col(text_column) != ""))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(touched, F.length(text_column).cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, removed_words, runs ('start:end' word ranges, comma-joined) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeats(docs)
    ids = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), F.hash(F.coalesce(F.col("text"), F.lit(""))).alias("tag"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    runs = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return ids.join(found, ["doc", "tag"], "left").select("doc_id", F.size(spans).cast("long").alias("n_runs"), removed.alias("removed_words"), runs.alias("runs"))
