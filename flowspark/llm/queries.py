"""Queries of this subpackage for ``__spark_entry__``: (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.token_store import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.pii import digest, find

    return digest(find(_table(spark, sf_dir, "documents"))[0])


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.byte_cnn import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.packing import pack, token_pieces

    return pack(token_pieces(_table(spark, sf_dir, "documents")))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.warc_derivatives import derive, responses

    records = derive(responses(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.near_dedup import link

    return link(_table(spark, sf_dir, "documents"), width=4)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.edit_counts import count_edited, review_edits

    return count_edited(review_edits(_table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.common import materialize
    from flowspark.llm.quality_rules import judge, learn, statistics

    stats = materialize(statistics(_table(spark, sf_dir, "documents")), "statistics")
    rules = learn(stats, _table(spark, sf_dir, "labels"))
    return judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.merkle import tampered, verify

    docs = _table(spark, sf_dir, "documents")
    return verify(docs, tampered(docs))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.ranked_search import build_index, search

    index = build_index(_table(spark, sf_dir, "documents"))
    return search(index, _table(spark, sf_dir, "benchmark"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.llm.simhash import link

    return link(_table(spark, sf_dir, "documents"))


def _written(name: str, query: Query) -> Query:
    """``query`` with its rows written: its Arrow batches are small, and the session's settings stay as they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from flowspark.llm.common import materialize

        return materialize(query(spark, sf_dir), name)

    return run


def queries() -> dict[str, Query]:
    every = (
        op1_token_store,
        op2_pii,
        op3_byte_cnn,
        op4_best_fit_packing,
        op5_warc_derivatives,
        op6_near_dedup,
        op7_substring_dedup,
        op8_edit_counts,
        op9_quality_rules,
        op10_decontamination,
        op11_merkle_manifest,
        op12_ranked_search,
        op13_simhash_dedup,
    )
    return {q.__name__: _written(q.__name__, q) for q in every}


def oracle_sql() -> dict[str, str]:
    from flowspark.llm import merkle, ranked_search, warc_derivatives

    return {"op5_warc_derivatives": warc_derivatives.oracle_sql(), "op11_merkle_manifest": merkle.oracle_sql(), "op12_ranked_search": ranked_search.oracle_sql()}
