"""The training-data pipeline: quality classifier, SimHash near-dedup, benchmark decontamination,
secret scan and packing, each stage over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of documents.
Defined results follow the operators': an empty table stays empty, null texts are texts without
words, repeated documents are judged alike, and further columns pass through to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import catalog, decontaminate, packing, quality, secret_scan, simhash
from quarry.llm._io import prepare, read, written

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production quality model accepts."""
    prepare(spark)
    return quality.accepted(docs, catalog.quality_model(spark, sf_dir))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash group."""
    prepare(spark)
    return simhash.first_of_group(docs, shingle=3, max_bits=3).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    prepare(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark (``n_chars`` follows the text)."""
    prepare(spark)
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, filled in the mixture of the sources."""
    prepare(spark)
    return packing.pack(docs, str(public_tokenizers.path(TOKENIZER)), max_tokens=2048)


STAGES = [("quality classifier", keep_quality), ("simhash near-dedup", first_copies),
          ("benchmark decontamination", without_benchmark), ("secret scan", without_secrets), ("packing", packed)]

# trained models and similarity search have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
