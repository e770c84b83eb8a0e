"""Mixing sources to target weights by Sainte-Lague apportionment (operator 4, native).

Plan: word counts -> one row per source -> targets (weighted filling with a cap)
-> blocks of equal tokens per source, then per shard, by highest quotients
-> seeded choice of blocks inside a shard -> overlap of each document with the
chosen blocks.  A source is laid out over shards of bounded size, so no window
ever holds a whole hot source; only sources and shards are sorted together.
Everything is built from DataFrame functions.

Defined cases: a null text has size 0; a null source is a source of its own,
ranked last; repeated rows are separate documents; documents of size 0 take 0;
an empty table gives an empty result; other columns of the input, whatever their
names, are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, freed, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 256
#: A source of fewer words than so many blocks is no party to the apportionment: it has FINE blocks or single words, and its own target.
FEW_BLOCKS, FINE = 8, 64
SHARD_TOKENS = 500_000
SEED = 17


def _key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> source_no, weight, target: weighted shares that stop at ``most`` times the size.

    Sources in order of cap / weight reach their cap first; the first one whose
    even share stays under its cap fixes the level for all that follow.
    """
    every = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("source_no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    by_cap = every.orderBy("fill_at", "source_no")
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("fill_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("after", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("open", F.col("weight") * (F.col("total") - F.col("before")) / F.col("after") <= F.col("cap"))
        .withColumn("level", F.first(F.when(F.col("open"), F.struct("before", "after")), ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    even = F.col("weight") * (F.col("total") - F.col("level.before")) / F.col("level.after")
    return filled.select("source", "source_no", "source_size", "weight", F.least(F.col("cap"), F.coalesce(even, F.col("cap"))).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: give ``seats`` of each group to its parties by the highest quotients votes / (2k - 1).

    With V votes, n parties and H seats the final divisor lies between
    V / (H + n / 2) and V / (H - n / 2); the seats above the larger one are
    certain, and only those between the two are ranked: about 2n rows a group.
    """
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    all_votes, n, h = F.col("_votes"), F.col("_n"), F.col(seats).cast("double")
    half = F.lit(0.5)
    some = v > 0
    bounds = (
        parties.withColumn("_votes", F.sum(v).over(w))
        .withColumn("_n", F.count(F.lit(1)).over(w).cast("double"))
        .withColumn("_sure", F.when(some & (h > n / 2), F.greatest(F.floor(v * (h - n / 2) / all_votes + half) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_most", F.when(some, F.floor(v * (h + n / 2) / all_votes + half) + 1).otherwise(F.col("_sure")).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    )
    asked = bounds.where(F.col("_most") > F.col("_sure")).select(
        *group, party, "_left", F.col(votes), F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k")
    )
    ranked = asked.withColumn("_q", v / (2 * F.col("_k") - 1)).withColumn(
        "_rank", F.row_number().over(w.orderBy(F.desc("_q"), F.asc(party), F.asc("_k")))
    )
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*group, party).agg(F.count(F.lit(1)).alias("_won"))
    return bounds.join(won, [*group, party], "left").withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_votes", "_n", "_sure", "_most", "_left", "_won")


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, print (hash of the text), size, source, source_size, target, taken.

    ``taken`` counts words with repeats; it never exceeds ``most`` = 2 times the
    size, and a source's sum differs from its target by about a block a shard.
    """
    return _laid(docs, weights, share, most, block, shard_tokens, seed).select("doc_id", "print", "size", "source", "source_size", "target", "taken")


def _laid(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """The rows of ``mix`` with the place of each document: source_no, shard."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(
        docs.select("doc_id", "source", F.xxhash64("text").alias("print"), n_words(F.col("text")).alias("size")).withColumn("key", _key(seed, F.col("doc_id"))),
        "sizes",
    )
    by_source = scratch.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    small = F.col("source_size") < FEW_BLOCKS * block
    fine = F.greatest(F.floor(F.col("source_size") / FINE), F.lit(1)).cast("long")
    seats = F.floor(F.sum("target").over(W.partitionBy(F.lit(0))) / block + F.lit(0.5)).cast("long")
    columns = ["source", "source_no", "source_size", "target", "quota", "block"]
    own = by_source.where(small).withColumn("block", fine).withColumn("quota", F.floor(F.col("target") / F.col("block") + F.lit(0.5)).cast("long"))
    shared = apportion(by_source.where(~small).withColumn("seats", seats), [], "source_no", "target", "seats", "quota").withColumn("block", F.lit(block).cast("long"))
    sources = scratch.keep(
        own.select(*columns).unionByName(shared.select(*columns))
        .withColumn("shards", F.greatest(F.ceil(F.col("source_size") / F.lit(shard_tokens)), F.lit(1)).cast("long"))
        .select(*columns, "shards"),
        "sources",
    )
    placed = (
        sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
        .select("doc_id", sized["source"], "print", "size", "key", "source_no", "source_size", "target", "quota", "block", "shards")
        .withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards"))
    )
    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.max("quota").alias("quota"), F.max("block").alias("block"))
    quotas = (
        apportion(shards, ["source_no"], "shard", "shard_size", "quota", "blocks_due")
        .where(F.col("shard_size") > 0)
        .withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
        .withColumn("blocks_due", F.least(F.col("blocks_due"), F.col("blocks") * most))
        .select("source_no", "shard", "blocks", F.floor(F.col("blocks_due") / F.col("blocks")).cast("long").alias("passes"), (F.col("blocks_due") % F.col("blocks")).alias("part"))
    )
    in_shard = W.partitionBy("source_no", "shard")
    chosen = (
        quotas.select("source_no", "shard", "passes", "part", F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("block_no"), "blocks")
        .withColumn("_last", (F.col("block_no") == F.col("blocks")).cast("int"))  # a position may be the end of the line
        .withColumn("_order", F.row_number().over(in_shard.orderBy("_last", _key(seed, F.col("source_no"), F.col("shard"), F.col("block_no")), "block_no")))
        .withColumn("picked", ((F.col("_order") <= F.col("part")) & (F.col("_last") == 0)).cast("long"))
        .withColumn("earlier", F.coalesce(F.sum("picked").over(in_shard.orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("source_no", "shard", "block_no", "passes", "picked", "earlier")
    )
    line = in_shard.orderBy("key", "doc_id", "size", "print")
    laid = placed.withColumn("ends", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("block_no", F.floor(F.col("ends") / F.col("block")).cast("long"))
    upto = F.col("earlier") * F.col("block") + F.col("picked") * (F.col("ends") % F.col("block"))
    # Before the explode Spark takes the blocks for a few rows and would broadcast them at any size.
    counted = laid.join(chosen.hint("merge"), ["source_no", "shard", "block_no"], "left").withColumn("upto", F.coalesce(upto, F.lit(0)))
    overlap = F.col("upto") - F.coalesce(F.lag("upto").over(in_shard.orderBy("ends", "key", "doc_id", "size", "print")), F.lit(0))
    taken = (F.coalesce("passes", F.lit(0)) * F.col("size") + overlap).cast("long")
    return counted.withColumn("taken", taken).select("doc_id", "print", "size", "source", "source_no", "shard", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, *, most: int = MOST, **kw) -> DataFrame:
    """The mixed corpus: each document whole, as often as its taken words make it, rounded up or down.

    Down a shard's documents, the longest first, the running sum of the parts
    of a copy is rounded, not each part.  What is then still missing of the
    shard's part of its source's target, or too much, is made up by one copy
    more or less of its shortest documents (repeated rows count as one).
    """
    scratch = Scratch(docs.sparkSession)
    with freed():
        unit = _laid(docs, most=most, **kw).groupBy("source_no", "shard", "source", "doc_id", "print").agg(F.sum("size").alias("words"), F.sum("taken").alias("due"), F.max("target").alias("target"))
        unit = scratch.keep(unit, "units")
    sources = scratch.keep(unit.groupBy("source_no").agg(F.sum("due").alias("source_due")), "due")
    shard = W.partitionBy("source_no", "shard")
    line = shard.orderBy(F.desc("words"), "print", "doc_id")
    part = F.when(F.col("words") > 0, (F.col("due") % F.col("words")) / F.col("words")).otherwise(F.lit(0.0))
    upto = F.floor(F.sum("part").over(line.rowsBetween(W.unboundedPreceding, 0)) + F.lit(0.5))
    whole = F.when(F.col("words") > 0, F.floor(F.col("due") / F.col("words"))).otherwise(F.lit(1))
    times = (whole + F.col("upto") - F.coalesce(F.lag("upto").over(line), F.lit(0))).cast("int")
    rounded = unit.join(sources, "source_no").withColumn("part", part).withColumn("upto", upto).withColumn("times", times)
    goal = F.sum("due").over(shard) * F.col("target") / F.col("source_due")
    gap = rounded.withColumn("gap", F.coalesce(goal, F.lit(0.0)) - F.sum(F.col("times") * F.col("words")).over(shard))
    can = (F.col("words") > 0) & F.when(F.col("gap") > 0, F.col("times") < most).otherwise(F.col("times") > 0)
    short = shard.orderBy(F.desc("can"), "words", "print", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    makes = gap.withColumn("can", can).withColumn("words_upto", F.sum("words").over(short))
    fits = F.col("can") & (F.col("words_upto") - F.col("words") / 2 <= F.abs("gap"))
    counted = makes.withColumn("times", F.col("times") + F.when(fits, F.signum("gap")).otherwise(F.lit(0)).cast("int"))
    copies = scratch.keep(counted.where("times > 0").select("source", "doc_id", "print", "times"), "copies")
    # The documents as one struct, so that no column's name can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.select(row, F.col("source").alias("s"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("p")).alias("d")
    on = F.col("d.s").eqNullSafe(F.col("c.source")) & F.col("d.i").eqNullSafe(F.col("c.doc_id")) & (F.col("d.p") == F.col("c.print"))
    each = held.join(copies.alias("c"), on).select("d.row", F.explode(F.sequence(F.lit(1), F.col("c.times"))))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = rf"""
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('{SEED}:' || coalesce(doc_id::varchar, 'null')) as key, text
  from documents),
src as (select source, sum(size)::bigint as source_size from s group by source),
rk as (select *, row_number() over (order by source nulls last) as source_no from src),
wt as (select *, [3.0, 1.0, 2.0][((source_no - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap from rk),
fl as (
  select *, (sum(source_size) over ())::double * 1.5::double as total,
    coalesce(sum(cap) over (order by cap / weight, source_no rows between unbounded preceding and 1 preceding), 0.0::double) as before,
    sum(weight) over (order by cap / weight, source_no rows between current row and unbounded following) as after
  from wt),
lv as (select before as lb, after as la from fl where weight * (total - before) / after <= cap order by cap / weight, source_no limit 1),
tg as (select source, source_no, source_size, least(cap, coalesce(weight * (total - lb) / la, cap)) as target from fl left join lv on true),
h as (select floor(sum(target) / {BLOCK} + 0.5)::bigint as seats, count(*)::double as n, sum(target) as votes from tg),
cand as (
  select source_no, target / (2 * k - 1) as q, k from tg, h, unnest(range(1, (case when target > 0 then floor(target * (seats + n / 2) / votes + 0.5)::bigint + 2 else 1 end))) as u(k)),
q1 as (select source_no, count(*) as quota from (select *, row_number() over (order by q desc, source_no, k) as r from cand), h where r <= seats group by source_no),
sources as (select tg.*, coalesce(quota, 0) as quota, greatest(ceil(source_size / {SHARD_TOKENS}.0), 1)::bigint as shards from tg left join q1 using (source_no)),
placed as (
  select doc_id, size, key, text, source_no, p.source_size, target, quota, ('0x' || substr(key, 1, 8))::bigint % shards as shard
  from s join sources p on s.source is not distinct from p.source),
sh as (select source_no, shard, sum(size)::bigint as shard_size, max(quota) as quota from placed group by all),
sn as (select *, count(*) over (partition by source_no)::double as n, (sum(shard_size) over (partition by source_no))::double as votes from sh),
c2 as (
  select source_no, shard, quota, shard_size::double / (2 * k - 1) as q, k from sn,
    unnest(range(1, (case when shard_size > 0 then floor(shard_size * (quota + n / 2) / votes + 0.5)::bigint + 2 else 1 end))) as u(k)),
q2 as (select source_no, shard, count(*) as due from (select *, row_number() over (partition by source_no order by q desc, shard, k) as r from c2) where r <= quota group by all),
q3 as (
  select source_no, shard, ceil(shard_size / {BLOCK}.0)::bigint as blocks, least(coalesce(due, 0), 2 * ceil(shard_size / {BLOCK}.0)::bigint) as due
  from sh left join q2 using (source_no, shard) where shard_size > 0),
bl as (
  select source_no, shard, due // blocks as passes, due % blocks as part, b as block_no, blocks,
    row_number() over (partition by source_no, shard order by (b = blocks)::int, md5('{SEED}:' || source_no || ':' || shard || ':' || b), b) as o
  from q3, unnest(range(0, blocks + 1)) as u(b)),
pk as (select *, (o <= part and block_no < blocks)::bigint as picked from bl),
ch as (select *, coalesce(sum(picked) over (partition by source_no, shard order by block_no rows between unbounded preceding and 1 preceding), 0) as earlier from pk),
laid as (select *, sum(size) over (partition by source_no, shard order by key, doc_id, size rows unbounded preceding) as ends from placed),
cn as (
  select l.*, passes, coalesce(earlier * {BLOCK} + picked * (ends % {BLOCK}), 0) as upto
  from laid l left join ch c on l.source_no = c.source_no and l.shard = c.shard and c.block_no = ends // {BLOCK})
select doc_id, size, source_size, target,
  (coalesce(passes, 0) * size + upto - coalesce(lag(upto) over (partition by source_no, shard order by ends, key, doc_id, size), 0))::bigint as taken
from cn
"""
