"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.llm import (
    brown_lm, decontaminate, html_extract, jaccard_join, langid, manifest, media, negatives, packing, pii, sharding, sql, toxicity, vector_dedup,
)
from lintfleet.llm.common import held_out, read

VOCABULARY = "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE)))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenize(docs, public_tokenizers.path(VOCABULARY))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"))
    return packing.pack(pieces)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", "passages.*")
    items = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.align_clips(media.clips_of(read(spark, sf_dir, "embeddings")))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op12_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in manifest.FIELDS]
    tampered_leaf = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, manifest.leaf_of(tampered))
    found = manifest.manifest(docs, carry={"tampered_leaf": tampered_leaf})
    folded = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(vectors, F.col("vec_id") % 50 == 0, label)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_media_columns": op10_media_columns,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_merkle_dataset_manifest": op12_merkle_dataset_manifest,
    "op13_hard_negative_mining": op13_hard_negative_mining,
}
SQL = sql.SQL
