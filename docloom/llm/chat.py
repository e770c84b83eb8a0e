"""Chat formatting after cumulative-snapshot collapse (operator 8, native).

Loggers often store a conversation again after every exchange, so a table holds
many prefixes of the same talk.  A rolling hash goes along the turns of each
conversation: the exclusive-or of 128-bit hashes of (position, role, text), so
entry k stands for the turns up to k, and all entries take one pass over the
sorted turns.  Conversations whose last entry is an earlier entry of another one
are removed by an anti-join, equal ones keep the smallest conv_id, and only then
the turns of the maximal ones are gathered and rendered.

Both sides of the anti-join are distinct hashes (aggregated before the
shuffle), so a first turn shared by a third of all conversations is one row.

Defined cases: turns sort by turn number (null first), then role and text; null
role or text renders as empty but hashes as null; rows with a null conv_id form
one conversation; repeated rows are repeated turns; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, k, a, b, last: for each turn the hash of all turns of its conversation up to it."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    line = W.partitionBy("conv_id").orderBy(*order)
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(line)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("conv_id")))
    # A null is told from an empty text by a flag of its own.
    own = lambda seed: F.xxhash64(F.lit(seed), "k", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    return placed.select("conv_id", "k", F.bit_xor(own(1)).over(upto).alias("a"), F.bit_xor(own(2)).over(upto).alias("b"), (F.col("k") == F.col("n")).alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: conversations that are no prefix of another; equal ones once."""
    each = rolling(turns)
    whole = each.where("last").groupBy("a", "b").agg(
        F.min_by(F.struct("conv_id"), F.struct(F.col("conv_id").isNull(), "conv_id")).alias("c"), F.max("k").cast("long").alias("n_turns"), F.count(F.lit(1)).alias("n_copies")
    )
    inner = each.where("not last").select("a", "b").distinct()
    return whole.join(inner, ["a", "b"], "left_anti").select("c.conv_id", "n_turns", "n_copies")


def gather(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``kept`` with their turns in order."""
    each = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    own = turns.select(F.col("conv_id").alias("c"), each.alias("t"))
    met = own.join(kept, F.col("c").eqNullSafe(F.col("conv_id")))
    return met.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def render(turns: Column, start: str = START, end: str = END) -> Column:
    """The chat template; its own control words are taken out of role and text."""
    clean = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(start), F.lit("")), F.lit(end), F.lit(""))
    one = lambda t: F.concat(F.lit(start), clean(t["role"]), F.lit("\n"), clean(t["text"]), F.lit(end + "\n"))
    return F.array_join(F.transform(turns, one), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text."""
    return gather(turns, maximal(turns)).select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("text"))


ORACLE = rf"""
with t as (
  select conv_id, list({{'turn': turn, 'role': role, 'text': text}} order by turn nulls first, role nulls first, text nulls first) as turns
  from conversations group by conv_id),
m as (
  select conv_id, len(turns)::bigint as n_turns, turns,
    [coalesce(strlen(x.role)::varchar || ':' || x.role, '-') || coalesce(strlen(x.text)::varchar || ':' || x.text, '-') for x in turns] as marks from t),
w as (select marks, min_by(turns, conv_id) as turns, min(conv_id) as conv_id, min(n_turns) as n_turns, count(*) as n_copies from m group by marks),
p as (select distinct marks[1:k] as marks from w, unnest(range(1, n_turns)) as u(k))
select conv_id, n_turns, n_copies,
  array_to_string([ '<|im_start|>' || replace(replace(coalesce(x.role, ''), '<|im_start|>', ''), '<|im_end|>', '') || chr(10)
    || replace(replace(coalesce(x.text, ''), '<|im_start|>', ''), '<|im_end|>', '') || '<|im_end|>' || chr(10) for x in turns], '') as text
from w where not exists (select 1 from p where p.marks = w.marks)
"""
