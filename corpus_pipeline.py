"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read by the next.

1. toxicity: documents that the classifier chain rejects are left out;
2. near duplicates: SimHash fingerprints are linked tile by tile and checked by shingle sets, as are pairs beyond their
   radius that share minimal hashes; of documents whose five-word shingles are similar by 0.8 or more, one stays;
3. substring dedup: words covered by repeated 50-word windows are cut from texts;
4. mixing: sources are brought to their target weights, documents whole;
5. packing: token sequences along the Hilbert curve, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import mixing, packing, simhash, substring, toxicity
from docloom.llm.common import Scratch, freed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), []
    for name, stage in STAGES:
        with freed():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return docs


#: A trained classifier and a tokenizer are not SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None
