"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; ``run`` writes them as Parquet in the shared
folder and reads them again as the next stage's docs. All but the last return the columns of ``documents``, and any
others that come with them, whatever their names. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import discard, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network accepts. It learns from the labels' training part.

    A null or empty text is scored like any other; null doc_ids and rows that repeat are judged by their texts.
    """
    from flowspark.llm.byte_cnn import accept, train

    return accept(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Every row is a document, also where doc_ids repeat or are null. Texts without words are all kept.
    """
    from flowspark.llm.near_dedup import keep_first

    return keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Texts without words, and rows without a doc_id, are judged alike: by text."""
    from flowspark.llm.decontaminate import clean

    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars follows the text.

    A null text stays null, with a null n_chars. Rows that repeat stay, each masked by itself.
    """
    from flowspark.llm.pii import redact

    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 4096 tokens; a null text is an empty document."""
    from flowspark.llm.packing import pack, token_pieces

    return pack(token_pieces(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier, near-duplicate groups and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
