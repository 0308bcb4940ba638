"""From documents to training sequences: five stages, each of which works on all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Nulls, empty texts and empty tables go through every stage; what becomes of them is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scanweave.llm import langid, mixing, packing, simhash, substrings
from scanweave.llm.base import fold, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with all of its columns in one, ``__row``, so that no name of theirs meets a name of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Those with null text, without a letter, or with a calibrated score
    below the threshold go. Without any labelled row there is no language to tell, and all that have letters go too.
    """
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.predict(_rows(docs), model, text_col="__row.text").where("accepted").select("__row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, one row of it. Rows without an id stay."""
    groups = simhash.simhash_components(docs)
    first = stored(groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct())
    return (docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.where("doc_id is null")).select(*docs.columns))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that a smaller document has; n_chars follows. A document of which nothing
    is left goes; one that was empty before stays. A character cut in two leaves a replacement character.
    """
    rows = _rows(docs).select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.text").alias("text"))
    left = substrings.remove_repeats(rows, keep=["__row"], part_bytes=4 << 20).where("n_removed < n_bytes or n_bytes = 0")
    changed = F.col("n_removed") > 0
    text = F.expr("make_valid_utf8(cast(kept as string))")
    new = {"text": text, "n_chars": F.length(text)}
    kinds = dict(docs.dtypes)
    return left.select(*[F.when(changed, new[c].cast(kinds[c])).otherwise(F.col(f"__row.`{c}`")).alias(c) if c in new
                         else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix (slot, place in block): the files, read one after the other, are a
    stream in which each source has its target weight until it runs out. Rows without an id come last.
    """
    slots = mixing.mix(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("slot", "place_in_block")).alias("at"))
    rows = _rows(docs)
    return (rows.join(slots.withColumnRenamed("doc_id", "__id"), F.col("__row.doc_id") == F.col("__id"), "left")
            .orderBy(F.col("at").asc_nulls_last(), "__row.doc_id").select("__row.*"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of at most 2048 tokens, which follow the mix: sequence ids are
    in the order of its slots, so that read by them each source has its target weight until it runs out. The mix of
    the same rows is the same again, whatever the order of the files. Ranges of the mix are packed best-fit, and
    sequences with room are merged up a tree of neighbouring ranges.
    """
    return packing.pack_in_order(docs, mixing.mix(docs), VOCABULARY)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("suffix_dedup", suffix_dedup),
          ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: Hashes, models and token ids can't be written in SQL: the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
