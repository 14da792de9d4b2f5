"""A corpus pipeline: five operators one after the other, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.llm import decontaminate, jaccard_join, langid, pii
from lintfleet.llm.common import free_name, read
from lintfleet.llm.queries import packed
from lintfleet.session import materialize

LEAST_LANGUAGE_SCORE = 0.3
NEAR_WORDS = 5
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a text, or of no language that the classifier tells from the others, go."""
    prefix = free_name(docs, "_language_")
    found = langid.identify(docs, langid.train(docs), prefix=prefix)
    kept = found.filter((F.col(f"`{prefix}lang_pred`") != langid.UNKNOWN) & (F.col(f"`{prefix}score`") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. Rows with a null id stay; of rows with one id, one stays."""
    found = jaccard_join.join_similar(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    first = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay; of repeated rows all stay or go."""
    into = free_name(docs, "_passages")
    found = decontaminate.find_passages(docs, read(spark, sf_dir, "benchmark"), into=into)
    return found.filter(F.col(f"{into}.n_hit") == 0).drop(into)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, and n_chars follows."""
    masked = pii.masked(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences. A null text is packed as an empty one, repeated rows each for themselves."""
    return packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None  # the classifier and the tokenizer are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
