"""Queries opN_<name> of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_simhash_near_dedup(spark, sf_dir):
    from scanweave.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op2_mix_sources(spark, sf_dir):
    from scanweave.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from scanweave.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_language_id(spark, sf_dir):
    from scanweave.llm.base import fold
    from scanweave.llm.langid import predict, train
    docs = table(spark, sf_dir, "documents")
    model = train(docs, fold(F.col("doc_id"), 4) != 2)
    return predict(docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out")), model).drop("text")


@query
def op8_toxicity(spark, sf_dir):
    from scanweave.llm import langid, toxicity
    from scanweave.llm.base import fold
    docs = table(spark, sf_dir, "documents")
    usable = fold(F.col("doc_id"), 4) != 2
    langs = langid.train(docs, usable)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable, langs)
    return toxicity.score(docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out")), model, langs).drop("text")


@query
def op10_lm_scores(spark, sf_dir):
    from scanweave.llm.lm import score
    return score(table(spark, sf_dir, "documents"))


@query
def op1_balanced_list_search(spark, sf_dir):
    from scanweave.llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op6_pivot_near_dedup(spark, sf_dir):
    from scanweave.llm.pivots import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_word_piece_counts(spark, sf_dir):
    import public_tokenizers

    from scanweave.llm.wordpieces import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), every=True)


@query
def op9_suffix_dedup(spark, sf_dir):
    from scanweave.llm.substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_quality_rules(spark, sf_dir):
    from scanweave.llm.rules import apply_rules
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op12_pivot_table_clusters(spark, sf_dir):
    from scanweave.llm.pivot_table import cluster
    return cluster(table(spark, sf_dir, "embeddings"))


@query
def op13_periodic_runs(spark, sf_dir):
    from scanweave.llm.runs import collapse_runs, run_digests, with_planted_runs
    return run_digests(collapse_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def _sql() -> None:
    from scanweave.llm.mixing import OP2_SQL
    from scanweave.llm.substrings import OP9_SQL
    from scanweave.llm.rules import OP11_SQL
    from scanweave.llm.pivot_table import OP12_SQL
    SQL.update(op12_pivot_table_clusters=OP12_SQL, op11_quality_rules=OP11_SQL, op2_mix_sources=OP2_SQL, op9_suffix_dedup=OP9_SQL)


_sql()
