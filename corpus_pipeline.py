"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.bpe_automaton import encode_documents
from buildlens.llm.decontaminate import without_leaks
from buildlens.llm.jaccard_join import one_of_each
from buildlens.llm.pii import pseudonymise
from buildlens.llm.quality import only_good
from buildlens.llm.queries import PII_KEY, table, tokenizer
from buildlens.llm.shared import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return only_good(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return one_of_each(docs).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows the text."""
    put = pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        put = put.withColumn("n_chars", F.length("text").cast("bigint"))
    return put.select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the text they decode to."""
    return encode_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", private),
    ("BPE encoding and decoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents. Columns that the table lacks are not
    needed but for doc_id, text and lang; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
