"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns get a running sum of tokens. A turn belongs to the span in which it starts (spans are SPAN tokens of
the running sum), so spans are aligned to turns, and a turn of more than LONG tokens is a span of its own; a window holds one
span's turns. A later window first repeats the system turn (a first turn whose role is 'system'), then those last turns of the
window before that start at most HISTORY tokens ahead of it. So a window holds, beside the system turn, at most HISTORY + SPAN +
LONG tokens, or HISTORY tokens and one long turn. The loss mask covers assistant texts once: repeated ones are masked out.

Template: ``[TURN n]role[SEP]text[/TURN]`` per turn, n counting from 0. In roles and texts ``& [ ] < >`` are escaped, so
neither the template's marks nor control strings of other templates (``</s>``, ``[INST]``, ``<|...|>``) can occur in them, and
``unescape`` gives back the text. Tokens are counted as words plus 4 per turn.

Running sums go over range-partitioned slices, windows are grouped by (conversation, window), and only the digest of a whole
conversation gathers it, since SHA-256 is sequential; it gathers a string per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.ordered import running
from vertexloom.session import written

SPAN = 192
HISTORY = 64
LONG = 64
TURN_TOKENS = 4
#: Tokens of a conversation stay below this.
HIGH = 1 << 31
WORD = r"[^\x20\x09-\x0D]+"
#: What is escaped, and by what; '&' first.
ESCAPES = (("&", "&amp;"), ("[", "&#91;"), ("]", "&#93;"), ("<", "&lt;"), (">", "&gt;"))
PROBE = "</s>[INST] ok [/INST]"


def escape(c: F.Column) -> F.Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: F.Column) -> F.Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY, long: int = LONG) -> DataFrame:
    """(conv_id, window, first, text, spans): a row per window of (conv_id, turn, role, text) rows.

    ``first`` is the number of the window's first new turn, ``spans`` array<struct<start, end>> its loss mask in code points.
    Turns are ordered by turn (null first), then role and MD5 of the text, so ties and repeated rows have a defined place. Null roles and
    texts are empty; a null conv_id is a conversation. A turn of more than ``long`` tokens has a window of its own. An empty table
    gives an empty one. Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("code", F.unhex(F.md5(F.col("text").cast("binary"))))
    # places are found without texts, which join in once, by turn and code
    light = rows.select("conv_id", "turn", "role", "code", (F.regexp_count("text", F.lit(WORD)) + TURN_TOKENS).alias("tokens"))
    # one running sum counts tokens and, above them, long turns
    light = light.withColumn("alone", (F.col("tokens") > long).cast("long")).withColumn("sum", F.col("tokens") + F.col("alone") * HIGH)
    placed = running(light, ["conv_id"], ["turn", "role", "code"], "sum").withColumn("sums", F.col("cum") - F.col("sum"))
    placed = placed.withColumn("before", F.pmod("sums", F.lit(HIGH))).withColumn("breaks", 2 * F.floor(F.col("sums") / HIGH) + F.col("alone"))
    placed = written(placed.withColumn("slot", F.col("breaks") * HIGH + F.floor(F.col("before") / span)).select("conv_id", "slot", "before", "pos", "turn", "role", "code"), "places")
    slots = placed.groupBy("conv_id", "slot").agg(F.min("before").alias("start"), F.min("pos").alias("first"))
    slots = written(running(slots, ["conv_id"], ["slot"]).select("conv_id", "slot", "start", "first", F.col("pos").alias("window")), "windows")
    after = slots.select(F.col("conv_id").alias("_c"), (F.col("window") - 1).alias("_w"), F.col("start").alias("next"))
    spots = slots.join(after, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("window") == F.col("_w")), "left").select(F.col("conv_id").alias("_c"), F.col("slot").alias("_s"), "window", "next")
    own = placed.join(spots, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("slot") == F.col("_s")))
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    told_again = (F.col("next") - F.col("before") <= history) & ~system
    here = F.struct(F.col("window").alias("window"), F.lit(False).alias("again"))
    entries = own.select("conv_id", F.explode(F.when(told_again, F.array(here, F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("again")))).otherwise(F.array(here))).alias("e"), "pos", "turn", "role", "code")
    entries = entries.select("conv_id", "e.window", "e.again", "pos", "turn", "role", "code")
    heads = placed.where(system).select(F.col("conv_id").alias("_c"), "pos", "turn", "role", "code")
    later = slots.where("window > 0").join(heads, F.col("conv_id").eqNullSafe(F.col("_c")))
    entries = entries.unionByName(later.select("conv_id", "window", F.lit(True).alias("again"), "pos", "turn", "role", "code"))
    texts = rows.dropDuplicates(["conv_id", "turn", "role", "code"]).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("role").alias("_r"), F.col("code").alias("_k"), "text")
    entries = entries.join(texts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("role") == F.col("_r")) & (F.col("code") == F.col("_k")))
    head = F.concat(F.lit("[TURN "), F.col("pos").cast("string"), F.lit("]"), escape(F.col("role")), F.lit("[SEP]"))
    body = escape(F.col("text"))
    piece = F.struct(
        "pos", F.concat(head, body, F.lit("[/TURN]")).alias("piece"), F.length(head).cast("long").alias("skip"), F.length(body).cast("long").alias("size"),
        ((F.col("role") == "assistant") & ~F.col("again")).alias("target"), F.when(~F.col("again"), F.col("pos")).alias("new"),
    )
    grouped = entries.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    spans_type = "array<struct<start:bigint,end:bigint>>"

    def add(acc, x):
        begin = acc["at"] + x["skip"]
        span_ = F.array(F.struct(begin.alias("start"), (begin + x["size"]).alias("end")))
        return F.struct((begin + x["size"] + len("[/TURN]")).alias("at"), F.when(x["target"], F.concat(acc["spans"], span_)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans_type).alias("spans")), add, lambda acc: acc["spans"])
    return grouped.select("conv_id", "window", F.array_min(F.transform("p", lambda x: x["new"])).alias("first"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), spans.alias("spans"))


def _parts(text) -> F.Column:
    """The turns in a formatted text: array<struct<pos, role, text>>."""
    pieces = F.filter(F.split(text, r"\[/TURN\]"), lambda x: x != "")
    cut = lambda x: F.split(x, r"[\[\]]")
    return F.transform(pieces, lambda x: F.struct(F.substring(cut(x)[1], 6, 20).cast("long").alias("pos"), unescape(cut(x)[2]).alias("role"), unescape(cut(x)[4]).alias("text")))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): every turn once, read back from formatted windows."""
    parts = formatted.select("conv_id", "first", F.explode(_parts(F.col("text"))).alias("t"))
    return parts.where("t.pos >= first").select("conv_id", "t.pos", "t.role", "t.text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation and of the probe, -1."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kind = {x.name: x.dataType for x in turns.schema}
    probe = spark.range(2).select(F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = windows(turns.unionByName(probe))
    new = F.filter(_parts(F.col("text")), lambda t: t["pos"] >= F.col("first"))
    said = F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform("spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    per = out.select("conv_id", "window", F.size(new).alias("n"), F.array_join(said, "").alias("said"), F.array_join(learnt, "").alias("learnt"), F.length("text").alias("chars"))
    whole = per.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"), F.sum(F.length("learnt")).cast("long").alias("loss_chars"))
    joined = lambda k: F.sha2(F.array_join(F.transform("w", lambda x: x[k]), ""), 256)
    return whole.select("conv_id", "n_turns", joined("said").alias("turns_sha256"), "loss_chars", joined("learnt").alias("loss_sha256"), "formatted_chars")


def _sql() -> str:
    size = lambda c: f"({' + '.join([f'length({c})'] + [f'{len(code) - 1} * (length({c}) - length(replace({c}, {raw!r}, {chr(39) * 2})))' for raw, code in ESCAPES])})"
    return rf"""
with t as (select conv_id, turn, coalesce("role", '') r, coalesce("text", '') x from conversations union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
p as (select *, row_number() over w - 1 pos, len(regexp_extract_all(x, '{WORD}')) + {TURN_TOKENS} k from t window w as (partition by conv_id order by turn nulls first, r, md5(x))),
c as (select *, (sum(k) over w - k)::bigint bef, (2 * (sum((k > {LONG})::int) over w - (k > {LONG})::int) + (k > {LONG})::int)::bigint breaks from p window w as (partition by conv_id order by pos rows unbounded preceding)),
s as (select *, breaks * {HIGH} + bef // {SPAN} slot, length('[TURN ' || pos || ']') + {size("r")} + 5 + {size("x")} + 7 chars from c),
w as (select conv_id, slot, min(bef) start, row_number() over (partition by conv_id order by slot) - 1 win from s group by 1, 2),
n as (select *, lead(start) over (partition by conv_id order by win) nxt from w),
e as (select s.conv_id, chars + case when nxt - bef <= {HISTORY} and not (pos = 0 and r = 'system') then chars else 0 end chars from s join n on s.conv_id is not distinct from n.conv_id and s.slot = n.slot
  union all select s.conv_id, s.chars from s join w on s.conv_id is not distinct from w.conv_id where s.pos = 0 and s.r = 'system' and w.win > 0),
f as (select conv_id, sum(chars)::bigint formatted_chars from e group by 1)
select c.conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by pos)) turns_sha256, coalesce(sum(length(x)) filter (where r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by pos) filter (where r = 'assistant'), '')) loss_sha256, any_value(formatted_chars) formatted_chars
from c join f on c.conv_id is not distinct from f.conv_id group by 1
"""


SQL = _sql()
