"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of the whole corpus; a target
stops at three times its source's words and the excess goes to the others by weight. That is one water level: with sources
in order of cap / weight, running sums give for each whether the level is above it. Nothing is collected but three sums.

Order: documents of a source stand in the order of a hash of their id; running sums of their words (over range-partitioned
slices, so that a source with a third of all rows isn't one task) give each its place in a pass. Whole passes and the start
of one more make up the target to the word.

Curriculum: each source has a weight schedule over training time t in [0, 1], a line that integrates to its target: more
early or more late. Its integral, the demand, is a quadratic in t; inverting it at a copy's place in its source's word
count gives the copy's training position. The mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.ordered import running
from vertexloom.llm.columns import free_names
from vertexloom.session import written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Slopes of the schedules, by rank of the source, repeating: -1 falls to nothing, 0 is even, 1 starts from nothing.
SLOPES = (0.6, 0.0, -0.6)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: tuple, rank: F.Column) -> F.Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, slopes: tuple = SLOPES) -> DataFrame:
    """(source, source_size, target, slope) from (source, size) rows; the number of sources may be large."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("_last", F.col("source").isNull().cast("int"))
    ranked = running(per, [], ["_last", "source"]).withColumnRenamed("pos", "rank")
    ranked = ranked.withColumn("w", _cycle(weights, F.col("rank"))).withColumn("slope", _cycle(slopes, F.col("rank"))).withColumn("most", F.col("source_size") * float(cap))
    ranked = ranked.withColumn("level", F.col("most") / F.col("w"))
    ranked = running(ranked.drop("_last"), [], ["level", "rank"], "most").withColumnRenamed("cum", "most_to").drop("pos")
    ranked = running(ranked, [], ["level", "rank"], "w").withColumnRenamed("cum", "w_to").drop("pos")
    ranked = written(ranked, "sources")
    all_ = ranked.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total, w = float(all_["t"] or 0), float(all_["w"] or 0)
    before, left = F.col("most_to") - F.col("most"), F.lit(w) - (F.col("w_to") - F.col("w"))
    full = before + left * F.col("level") <= total
    rest = ranked.where(~full).agg(F.min("level").alias("l"), F.sum("w").alias("w")).first()
    filled = ranked.where(full).agg(F.sum("most").alias("m")).first()["m"] or 0.0
    water = (total - filled) / rest["w"] if rest["w"] else 0.0
    return ranked.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("w") * F.lit(water)).alias("target"), "slope")


def schedule(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, slopes: tuple = SLOPES, key: F.Column | None = None, until: float = 1.0) -> DataFrame:
    """A row per document: (doc_id, source, size, source_size, target, taken, copies array<struct<words, position>>[, key]).

    ``copies`` are those that training reaches by the time ``until``; ``taken`` sums their words. A source's sum is what its
    schedule demands by then, rounded down: its target, at the end. A copy may be cut: its
    first ``words`` words are taken. Documents of the last, partial pass are those first in hash order. Null texts and texts
    without words have size 0, no copies, and take 0; a null source is a source; where the id is null, the text's
    digest stands for it; rows that share an id are in order of size and a hash of the text, and repeated rows each take
    their share. An empty table gives an empty one. ``key``: a column over the documents that is carried along.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    id_ = F.col(id_column).cast("long")
    order = F.md5(F.coalesce(id_.cast("string"), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select(id_.alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(text_column).alias("size"), order.alias("_order"), F.xxhash64(text).alias("_tie"), *([key.alias("key")] if key is not None else []))
    rows = written(rows, "sizes")
    aims = targets(rows, weights, cap, slopes).withColumnsRenamed({"source": "_source"})
    placed = running(rows, ["source"], ["_order", "doc_id", "size", "_tie"], "size")
    joined = placed.join(F.broadcast(aims) if _few(aims) else aims, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor(_demand(F.lit(float(until)))).cast("long")
    size, total = F.col("size"), F.col("source_size")
    passes = F.when(total > 0, F.floor(whole / total).cast("long")).otherwise(F.lit(0))
    joined = joined.withColumn("_passes", F.least(passes, F.lit(cap).cast("long"))).withColumn("_start", F.col("cum") - size)
    joined = joined.withColumn("_extra", F.greatest(F.lit(0), F.least(size, whole - F.col("_passes") * total - F.col("_start"))).cast("long"))
    at = lambda k, n: F.struct(n.cast("long").alias("words"), _position(k * total + F.col("_start") + n / 2).alias("position"))
    again = F.when((F.col("_passes") > 0) & (size > 0), F.transform(F.sequence(F.lit(0), (F.col("_passes") - 1).cast("int")), lambda k: at(k, size))).otherwise(F.array().cast("array<struct<words:bigint,position:double>>"))
    last = F.when(F.col("_extra") > 0, F.array(at(F.col("_passes"), F.col("_extra")))).otherwise(F.array().cast("array<struct<words:bigint,position:double>>"))
    reached = joined.withColumn("copies", F.filter(F.concat(again, last), lambda c: c["position"].between(0.0, float(until))))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return reached.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", *(["key"] if key is not None else []))


#: Source tables are broadcast up to this many rows, counted first; beyond it they are joined by shuffle.
BROADCAST_ROWS = 50_000


def _few(aims: DataFrame) -> bool:
    return aims.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _demand(t: F.Column) -> F.Column:
    """Words that a source's schedule, integrated, asks for by time t; its target at 1."""
    return F.col("target") * (t + F.col("slope") * (t * t - t))


def _position(words: F.Column) -> F.Column:
    """Time t at which the demand reaches ``words``."""
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), words / F.col("target"))).otherwise(F.lit(0.0))
    s = F.col("slope")
    root = F.sqrt((1 - s) * (1 - s) + 4 * s * share)
    return F.when(F.abs(s) < 1e-9, share).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (root - (1 - s)) / F.when(F.abs(s) < 1e-9, F.lit(1.0)).otherwise(2 * s))))


def mixture(docs: DataFrame, partitions: int | None = None, **how) -> DataFrame:
    """The mix: a row per copy with its columns, ``words`` and ``position``, range-sorted by position.

    A copy's text is whole; ``words`` says how many of its words count. Copies find their rows by a hash over all columns, so
    null ids and rows that share an id come with their own; rows equal in every column are alike, and each has its copies. Null
    and empty texts have no words and no copies. A column named words or position keeps its name, and the new one gets an
    underscore. An empty table gives an empty one.
    """
    words, position, key = free_names(docs.columns, "words", "position", "_key")
    code = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns))
    plan = schedule(docs, key=code, **how).select("key", F.explode("copies").alias("c"))
    copies = plan.select(F.col("key").alias(key), F.col("c.words").alias(words), F.col("c.position").alias(position))
    once = docs.withColumn(key, code).dropDuplicates([key])  # equal rows meet before they are sent
    out = once.join(copies, key).select(*docs.columns, words, position, key)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, position, key).sortWithinPartitions(position, key).drop(key)


def in_training_order(plan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a schedule, range-sorted by when training first meets them; those without copies stand last, by id."""
    n = partitions or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.array_min(F.transform("copies", lambda c: c["position"]))
    order = [F.col("_first").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return plan.withColumn("_first", first).drop("copies").repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_first")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, in the order in which the curriculum first takes them."""
    plan = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return in_training_order(plan).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with recursive d as (select doc_id, "text", source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by 1),
r as (select *, row_number() over (order by source is null, source collate C) - 1 k from s),
w as (select *, [5.0, 2.0, 1.0][(k % 3 + 1)::int]::double w, source_size * 3.0::double most from r),
o as (select *, sum(most) over (order by most / w, k rows unbounded preceding) - most b, (select sum(w) from w) - (sum(w) over (order by most / w, k rows unbounded preceding) - w) l from w),
f as (select *, b + l * (most / w) <= (select sum(source_size) from s) is_full from o),
t as (select source, source_size, case when is_full then most else w * (((select sum(source_size) from s) - (select coalesce(sum(most), 0) from f where is_full)) / (select sum(w) from f where not is_full)) end target from f),
p as (select doc_id, size, source_size, target, case when source_size > 0 then least(3, floor(target)::bigint // source_size) else 0 end passes,
  sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, md5(coalesce("text", '')))), doc_id, size rows unbounded preceding) - size bg
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (passes * size + greatest(0, least(size, floor(target)::bigint - passes * source_size - bg)))::bigint taken from p
"""
