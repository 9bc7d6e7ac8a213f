"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what its predecessor kept, written as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import langid, mixing, packing, simhash, sketchdedup
from tapeloom.llm.common import documents, table

# Share of a document's words that its main language must hold.
LEAST_SHARE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` with all but the columns of documents under reserved names inside, so that none meets a column of its operator."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"_extra_{k}" for k, c in enumerate(docs.columns) if c not in COLUMNS}
        return stage(spark, docs.withColumnsRenamed(names), sf_dir).toDF(*docs.columns)

    return run


@apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language stay; those without letters, or without a language for half their words, go."""
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    named = langid.identify(docs, carry=more, keep_body=True)
    kept = named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("text", F.col("body").cast("string")).select(docs.columns)


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.keep_one(docs).select(docs.columns)


@apart
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller id or an earlier place holds too are cut out; a document that had words and keeps none goes."""
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = sketchdedup.remove_repeats(docs, carry=more, spare=True).where("n_words = 0 OR n_removed < n_words")
    text = F.col("kept").cast("string")
    return cut.withColumn("text", text).withColumn("n_chars", F.length(text).cast("long")).select(docs.columns)


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and kinds of text have their target shares of tokens."""
    return mixing.mix(docs).where("_copies > 0").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

# Language mixtures, fingerprints, token ids and best-fit places have no SQL form; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
