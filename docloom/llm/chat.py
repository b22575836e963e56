"""Chat formatting by multi-party perspective rotation (DataFrame functions).

Method: a dialogue is rendered once for every participant. In a participant's rendering
their turns are the assistant's and carry the loss mask; everyone else is a named user;
system turns stay system turns and belong to nobody.

A long dialogue is rendered in segments of SEGMENT_TURNS turn numbers, so that no group is
gathered whole: a dialogue's text is its segments in order, and mask spans count code points
from the start of their segment; `start` is where the segment begins in the whole rendering.

Defined results: repeated rows count once; turns of one number are ordered by role, then
text; null text is empty; a null role is the speaker "unknown"; rows without a turn number
form segment -1; rows without conv_id form one dialogue; control strings in a text or
role lose their meaning by a space after "<|", and line ends in a role become spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SEGMENT_TURNS = 64
SYSTEM = ("system",)
TAIL = "<|im_end|>\n"


def _plain(role: Column) -> Column:
    """A name that cannot leave its line or open a turn."""
    return F.replace(F.translate(role, "\r\n", "  "), F.lit("<|"), F.lit("<| "))


def _header(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == speaker, F.lit("<|im_start|>assistant\n"))
        .when(role.isin(*SYSTEM), F.lit("<|im_start|>system\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), _plain(role), F.lit("\n")))
    )


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, segment, n_turns, text, mask array<struct<start,end>>, start from
    (conv_id, turn, role, text)."""
    t = turns.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-1)).cast("long").alias("segment"), "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<| ")).alias("text"),
    ).distinct()
    speakers = t.where(~F.col("role").isin(*SYSTEM)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    parts = t.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    both = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["c"]))

    speaker = F.col("speaker")
    shown = F.transform("m", lambda m: F.struct(_header(m["role"], speaker).alias("head"), m["text"].alias("body"), (m["role"] == speaker).alias("own")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("out"))

    def place(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.char_length(p["head"])
        b = a + F.char_length(p["body"])
        return F.struct((b + len(TAIL)).alias("at"), F.when(p["own"], F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["out"]).alias("out"))

    both = both.withColumn("shown", shown)
    before = Window.partitionBy("conv_id", "speaker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    out = both.select(
        "conv_id", "speaker", "segment", F.size("m").cast("long").alias("n_turns"),
        F.array_join(F.transform("shown", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "").alias("text"),
        F.aggregate("shown", start, place, lambda acc: acc["out"]).alias("mask"),
    )
    return out.withColumn("start", F.coalesce(F.sum(F.char_length("text").cast("long")).over(before), F.lit(0).cast("long")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "speaker", "segment", "n_turns", "text", mask.alias("mask"))


OP6_SQL = f"""
with t as (
  select distinct conv_id, coalesce(floor(turn / {SEGMENT_TURNS}.0), -1)::bigint as segment, turn,
    coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '<| ') as text
  from conversations
), s as (select distinct conv_id as c, role as speaker from t where role not in ('system')
), p as (
  select conv_id, speaker, segment, turn, role, text,
    case when role = speaker then '<|im_start|>assistant' || chr(10)
         when role in ('system') then '<|im_start|>system' || chr(10)
         else '<|im_start|>user name=' || replace(translate(role, chr(13) || chr(10), '  '), '<|', '<| ') || chr(10) end as head
  from t join s on t.conv_id is not distinct from s.c
), o as (
  select *, coalesce(sum(length(head) + length(text) + {len(TAIL)}) over (
    partition by conv_id, speaker, segment order by turn nulls first, role, text
    rows between unbounded preceding and 1 preceding), 0) + length(head) as a
  from p
)
select conv_id, speaker, segment, count(*)::bigint as n_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' order by turn nulls first, role, text) as text,
  coalesce(string_agg(a::bigint || ':' || (a + length(text))::bigint, ',' order by turn nulls first, role, text) filter (role = speaker), '') as mask
from o group by conv_id, speaker, segment
"""
