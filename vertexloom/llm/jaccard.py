"""Near copies by the Jaccard similarity of word shingles: MinHash buckets, a few candidates a text, an exact check of each.

Distinct texts (by a 64-bit hash) get BANDS keys of ROWS least hashes; two texts at similarity s share one with probability
1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8. Texts that meet are read again for their shingles and a signature (PLACES least
hashes, a byte each), from which similarities in a bucket are estimated without pairs leaving it.

* Buckets of up to CROWD texts: of the pairs whose estimate comes to CUT, a spanning forest by estimate and each text's TOP
  nearest are candidates. So they grow with a bucket's texts, not with their square, and whatever hangs together by estimates
  hangs together by candidates.
* Larger buckets: texts that all but equal the first one (estimate SAME) are candidates with it and go. The rest is dealt
  into smaller buckets by DEALT further keys of ROWS places each. A near pair shares 6.5 buckets on average, and more after
  every deal, so few are parted. After DEPTH deals, overlapping blocks in order of signatures end it.

Every candidate, once, is checked on the shingles themselves.

All this leaves links out, rarely: texts that share no key, or whose estimates mislead in every bucket that they share. So an
exact join follows (``missing``), over the components so far. Of two sets at similarity s or more, in one order of all
shingles, the first shingle they share stands among the first n - ceil(s * n) + 1 of either (n: its size). Each text gives
these, frequent ones last; two texts that meet in one, lie in different components, and can still come to s by their sizes
and by what stands behind the shingle, are told apart by parities of their shingles' bits (as many as differ there differ in
shingles, at least) and what remains is checked like the other candidates. No such pair is left out, however many texts a
shingle has; families that hang together already cost no pairs. The order follows counts in a sample of SAMPLE texts: it
bears on the work only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.ordered import running
from vertexloom.llm import wordhash
from vertexloom.llm.components import connected_components
from vertexloom.session import drop_written, written

SIMILAR = 0.8
ROWS = 5
BANDS = 20
PLACES = 256
CROWD = 128
TOP = 3
CUT = 0.7
SAME = 0.97
DEALT = 5
DEPTH = 12
CHUNK = 2048
SAMPLE = 8192
OFTEN = 3
FREQUENT = 1 << 18
SMALL = 64
_RANDOM = np.random.default_rng(11).integers(0, 1 << 63, size=(3, PLACES), dtype=np.uint64)
_ODD = _RANDOM[1] * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of a set's hashes under each of n mixings."""
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), CHUNK):
            least = np.minimum(least, ((hashes[at : at + CHUNK, None] ^ _RANDOM[0, :n]) * _ODD[:n]).min(axis=0))
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes."""
    least = least_hashes(hashes, ROWS * BANDS)
    with np.errstate(over="ignore"):
        return ((least ^ least >> np.uint64(29)) * (_RANDOM[2, : ROWS * BANDS] | np.uint64(1))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def signature(hashes: np.ndarray) -> bytes:
    """PLACES bytes; two sets agree in about as many of them as they are similar."""
    least = least_hashes(hashes, PLACES)
    return ((least ^ least >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8).tobytes()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of words' hashes, repeats included: the whole sequence if it is shorter; none without words."""
    start = np.arange(max(1, len(words) - width + 1))
    out = [np.zeros(0, dtype=np.uint64)]
    for at in range(0, len(start) if len(words) else 0, wordhash.WORDS):
        some = start[at : at + wordhash.WORDS] - at
        sums = wordhash.prefixes(words[at : at + len(some) - 1 + width])
        out.append(wordhash.between(sums, some, np.minimum(some + width, len(sums) - 1)))
    return np.concatenate(out)


def _shingled(batch: pa.RecordBatch, width: int):
    """(row, shingle hashes) of the texts of a batch, A-Z as a-z."""
    for row, hashes, bounds in wordhash.grouped(batch.column("text"), lower=True):
        for i in range(len(bounds) - 1):
            yield row + i, shingles(hashes[bounds[i] : bounds[i + 1]], width)


def frequent(docs: DataFrame, text_column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): those in OFTEN or more texts of a sample by hash, at most FREQUENT; sorted by shingle."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(s).view(np.int64) for _, s in _shingled(batch, width)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, type=pa.list_(pa.int64()))], names=["words"])

    texts = docs.select(*_texts(text_column)).where(F.pmod("tag", F.lit(max(1, docs.count() // SAMPLE))) == 0).dropDuplicates(["tag"])
    counts = texts.mapInArrow(run, "words array<long>").select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    words, n = found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(words)
    return words[order], n[order]


def prefix(words: np.ndarray, often: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones last, one of which any set at least ``similar`` shares."""
    known, counts = often
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        n = np.where(known[at] == words, counts[at], 0)
        if n.any():
            words = words[np.lexsort((words, n))]
    return words[: len(words) - int(np.ceil(similar * len(words) - 1e-6)) + 1]


def parity(words: np.ndarray) -> bytes:
    """A bit per hash, on if an odd number of a set's hashes falls there: two to four times as many as hashes, at most 65,536."""
    bits = min(1 << 16, max(64, 1 << (2 * len(words) - 1).bit_length()))
    return np.packbits(np.bincount((words & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """At least how many hashes differ between two sets, by their parities; longer ones are folded to the shorter."""
    la, lb = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    out = np.zeros(len(la), dtype=np.int64)
    for m, n in set(zip(la.tolist(), lb.tolist(), strict=True)):
        at = np.flatnonzero((la == m) & (lb == n))
        x, y = (np.frombuffer(b"".join(side[i] for i in at), dtype=np.uint8).reshape(len(at), -1) for side in (a, b))
        while x.shape[1] != y.shape[1]:
            half = max(x.shape[1], y.shape[1]) // 2
            x, y = (z[:, :half] ^ z[:, half:] if z.shape[1] > half else z for z in (x, y))
        out[at] = np.unpackbits(x ^ y, axis=1).sum(axis=1, dtype=np.int64)
    return out


def _least_common(similar: float, sizes):
    """Hashes that two sets of so many in all must share."""
    return np.ceil(similar / (1 + similar) * sizes - 1e-6)


def banded(docs: DataFrame, id_column: str, text_column: str, width: int, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, tag, fp, keys, size, prefix, bits) of every row: hash of the text, SimHash, band keys, number of different shingles,
    the first of them, their parities (none for texts without words)."""
    from vertexloom.llm.simhash import folded

    often = frequent(docs, text_column, width)

    def run(batches):
        for batch in batches:
            fps, sizes = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int32)
            keys, first, bits = [[]] * batch.num_rows, [[]] * batch.num_rows, [b""] * batch.num_rows
            for row, s in _shingled(batch, width):
                if len(s):
                    words = np.unique(s)
                    fps[row], keys[row] = folded(s), band_keys(words).view(np.int64)
                    sizes[row], first[row], bits[row] = len(words), prefix(words, often, similar).view(np.int64), parity(words)
            many = [pa.array(x, type=pa.list_(pa.int64())) for x in (keys, first)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(fps), many[0], pa.array(sizes), many[1], pa.array(bits, type=pa.binary())], names=["doc_id", "tag", "fp", "keys", "size", "prefix", "bits"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *_texts(text_column))
    return rows.mapInArrow(run, "doc_id long, tag long, fp long, keys array<long>, size int, prefix array<long>, bits binary")


def _texts(text_column: str) -> tuple:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return F.xxhash64(text).alias("tag"), text.alias("text")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def chosen(signatures: np.ndarray) -> list[tuple[int, int]]:
    """Candidates of a bucket, as index pairs; see above."""
    n = len(signatures)
    near = np.stack([_agreement(signatures, s) for s in signatures])
    np.fill_diagonal(near, 0)
    out = set()
    for i in range(n):
        best = np.argsort(-near[i], kind="stable")[:TOP]
        out |= {(min(i, j), max(i, j)) for j in best.tolist() if near[i, j] >= CUT}
    todo, best, of = np.ones(n, dtype=bool), np.full(n, -1.0), np.zeros(n, dtype=np.int64)
    for _ in range(n):  # a spanning forest, nearest first
        i = int(np.argmax(np.where(todo, best, -2.0)))
        if best[i] >= CUT:
            out.add((min(i, int(of[i])), max(i, int(of[i]))))
        todo[i] = False
        closer = near[i] > best
        best, of = np.where(closer, near[i], best), np.where(closer, i, of)
    return sorted(out)


def _candidates(buckets: DataFrame) -> DataFrame:
    """(u, v): tags u < v, from (key, tag, sig) rows of buckets of 2 to CROWD texts."""

    def pick(batches):
        for batch in batches:
            out = []
            for members in batch.column("members"):
                tags, sigs = (members.values.field(k) for k in (0, 1))
                tags = tags.to_numpy()
                signatures = np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint8).reshape(-1, PLACES)
                out += [(min(tags[i], tags[j]), max(tags[i], tags[j])) for i, j in chosen(signatures)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["u", "v"], dtype="int64"), preserve_index=False)

    grouped = buckets.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("tag", "sig"))).alias("members"))
    return grouped.select("members").mapInArrow(pick, "u long, v long")


def _dealt(large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, smaller buckets) from (key, tag, sig) rows of large buckets."""
    first = large.groupBy("key").agg(F.min(F.struct("tag", "sig")).alias("f")).select("key", F.col("f.tag").alias("to"), F.col("f.sig").alias("there"))

    def rate(batches):
        for batch in batches:
            mine, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, PLACES) for c in ("sig", "there"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "tag", "sig", "to")), pa.array(_agreement(mine, theirs) >= SAME)], names=["key", "tag", "sig", "to", "same"])

    rated = written(large.join(first, "key").mapInArrow(rate, "key long, tag long, sig binary, to long, same boolean"), "rated")
    twins = rated.where("same and tag <> to").select(F.least("tag", "to").alias("u"), F.greatest("tag", "to").alias("v"))
    rest = rated.where("not same or tag = to").select("key", "tag", "sig")
    if level >= DEPTH:
        block = F.floor(F.col("pos") / (CROWD // 2))
        placed = running(rest, ["key"], ["sig", "tag"]).select("key", "tag", "sig", F.explode(F.array(block, block + 1)).alias("block"))
        return twins, placed.select(F.xxhash64("key", "block").alias("key"), "tag", "sig")
    places = np.random.default_rng(100 + level)
    keys = [F.xxhash64("key", F.lit(j), *(F.substring("sig", int(p) + 1, 1) for p in places.choice(PLACES, ROWS, replace=False))) for j in range(DEALT)]
    return twins, rest.select(F.explode(F.array(*keys)).alias("key"), "tag", "sig")


def met(word: np.ndarray, tag: np.ndarray, root: np.ndarray, size: np.ndarray, pos: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): tags of the pairs that share a word, differ in root (0: the tag) and may be ``similar``; rows are sorted by word and size."""
    root = np.where(root == 0, tag, root)

    def may(i, j):  # size[i] <= size[j]
        return (root[i] != root[j]) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= _least_common(similar, size[i] + size[j]))

    us, vs = [tag[:0]], [tag[:0]]
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    count = np.diff(np.r_[start, len(word)])
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    end = np.repeat(np.where(mixed & (count <= SMALL), start + count, 0), count)
    at = np.arange(len(word))
    for d in range(1, SMALL):
        at = at[at + d < end[at]]
        at = at[size[at] >= similar * size[at + d] - 1e-6]
        if not len(at):
            break
        some = at[may(at, at + d)]
        us.append(tag[some])
        vs.append(tag[some + d])
    for lo, n in zip(start[mixed & (count > SMALL)], count[mixed & (count > SMALL)], strict=True):
        roots, of, each = np.unique(root[lo : lo + n], return_inverse=True, return_counts=True)
        for i in lo + np.flatnonzero(of != np.argmax(each)):  # pairs outside the largest component, and with it
            near = lo + np.searchsorted(size[lo : lo + n], [similar * size[i] - 1e-6, size[i] / similar + 1e-6])
            others = np.arange(near[0], near[1])
            some = others[may(np.full(len(others), i), others)]
            us.append(np.full(len(some), tag[i]))
            vs.append(tag[some])
    u, v = np.concatenate(us), np.concatenate(vs)
    return np.minimum(u, v), np.maximum(u, v)


def missing(rows: DataFrame, found: DataFrame, similar: float) -> DataFrame:
    """(u, v): all pairs of texts of different components that may be ``similar``; found: (node, root) of texts that have links."""
    columns = ["word", "tag", "root", "size", "pos"]

    def meet(batches):
        def pairs(parts):
            u, v = met(*(np.concatenate(x) for x in zip(*parts, strict=True)), similar)
            for i in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (u, v)], names=["u", "v"])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(c).to_numpy() for c in columns]
            once = np.r_[True, (got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1])]  # copies of a text follow one another
            got = [x[once] for x in got]
            cut = int(np.searchsorted(got[0], got[0][-1]))  # the last word may go on in the next batch
            if held and (cut or got[0][0] != last):
                yield from pairs([*held, [x[:cut] for x in got]])
                held = []
            elif cut:
                yield from pairs([[x[:cut] for x in got]])
            held, last = [*held, [x[cut:] for x in got]], got[0][-1]
        if held:
            yield from pairs(held)

    def rate(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            n = batch.column("n").to_numpy()
            keep = differing(a, b) <= n - 2 * _least_common(similar, n)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], names=["u", "v"])

    texts = rows.select("tag", "size", "prefix").join(found.withColumnRenamed("node", "tag"), "tag", "left").withColumn("root", F.coalesce("root", F.lit(0).cast("long")))
    words = texts.select(F.posexplode("prefix").alias("pos", "word"), "tag", "root", "size").select(*columns)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = written(words.repartition(n, "word").sortWithinPartitions("word", "size", "tag").mapInArrow(meet, "u long, v long").distinct(), "meeting")
    bits = rows.select("tag", "size", "bits").join(pairs.select(F.explode(F.array("u", "v")).alias("tag")).distinct(), "tag", "left_semi")
    bits = bits.groupBy("tag").agg(F.min("size").alias("size"), F.min("bits").alias("bits"))
    rated = pairs.join(bits.toDF("u", "m", "a"), "u").join(bits.toDF("v", "n", "b"), "v").select("u", "v", (F.col("m") + F.col("n")).alias("n"), "a", "b")
    return rated.mapInArrow(rate, "u long, v long")


def links(docs: DataFrame, rows: DataFrame, near: DataFrame, text_column: str, width: int, similar: float = SIMILAR) -> DataFrame:
    """(u, v): links that span exactly the components of texts, by their hashes, whose shingles (A-Z lower-cased) are at least
    ``similar``; all texts without words are alike.

    ``rows``: what ``banded`` gave for ``docs``; ``near``: more candidates (u, v). Both are written tables.
    """
    known = rows.groupBy("tag").agg(F.min("keys").alias("keys"))
    keyed = known.select("tag", F.explode("keys").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = written(keyed.join(crowded, "key").select("key", "tag", "n"), "buckets")
    done = [live]

    def read(batches):
        for batch in batches:
            sets, sigs = [None] * batch.num_rows, [None] * batch.num_rows
            for row, s in _shingled(batch, width):
                s = np.unique(s)
                sets[row], sigs[row] = s.view(np.int64), signature(s)
            yield pa.RecordBatch.from_arrays([batch.column("tag"), pa.array(sets, type=pa.list_(pa.int64())), pa.array(sigs, type=pa.binary())], names=["tag", "words", "sig"])

    # copies are read again as often as they stand there, and one of each stays
    texts = docs.select(*_texts(text_column)).join(live.select("tag").unionByName(near.select(F.explode(F.array("u", "v")).alias("tag"))).distinct(), "tag", "left_semi")
    sets = written(texts.mapInArrow(read, "tag long, words array<long>, sig binary").groupBy("tag").agg(F.min("words").alias("words"), F.min("sig").alias("sig")), "shingles")
    sigs = sets.select("tag", "sig")
    pairs = live.where("n = 2").groupBy("key").agg(F.min("tag").alias("u"), F.max("tag").alias("v")).select("u", "v")
    more = written(live.where("n > 2").join(sigs, "tag").select("key", "tag", "sig", "n"), "crowds")
    done += [sets, more]
    level = 0
    while True:
        pairs = pairs.unionByName(_candidates(more.where(F.col("n") <= CROWD)))
        large = more.where(F.col("n") > CROWD)
        if large.isEmpty():
            break
        twins, dealt = _dealt(large.select("key", "tag", "sig"), level)
        dealt = written(dealt, "dealt")
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        more = written(dealt.join(sizes, "key"), "crowds")
        done += [dealt, more]
        pairs = pairs.unionByName(twins)
        level += 1
    pairs = written(pairs.unionByName(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    found = connected_components(_checked(pairs, sets, similar))
    for table in [*done, pairs]:  # no longer read; the exact join needs the room
        drop_written(table)
    rest = written(missing(rows, found, similar), "missing")
    if rest.isEmpty():
        return found.select(F.col("node").alias("u"), F.col("root").alias("v"))

    def reread(batches):
        for batch in batches:
            sets = [None] * batch.num_rows
            for row, s in _shingled(batch, width):
                sets[row] = np.unique(s).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("tag"), pa.array(sets, type=pa.list_(pa.int64()))], names=["tag", "words"])

    texts = docs.select(*_texts(text_column)).join(rest.select(F.explode(F.array("u", "v")).alias("tag")).distinct(), "tag", "left_semi")
    sets = written(texts.mapInArrow(reread, "tag long, words array<long>").groupBy("tag").agg(F.min("words").alias("words")), "more-shingles")
    return found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(_checked(rest, sets, similar))


def _checked(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose sets (tag, words) are at least ``similar``."""
    there = sets.select(F.col("tag").alias("v"), F.col("words").alias("there"))
    common = F.size(F.array_intersect("words", "there"))
    enough = common >= similar * (F.size("words") + F.size("there") - common)
    return pairs.join(sets.select(F.col("tag").alias("u"), "words"), "u").join(there, "v").where(enough).select("u", "v")
