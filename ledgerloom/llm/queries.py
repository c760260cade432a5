"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    collocations, decontaminate, exact, jaccard, licences, lm, mixing, pii, quality, repeats, sharding, sql, toxicity,
    whitening,
)
from ledgerloom.llm.common import crc_mod, documents, query


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of all sources takes each document."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    plan = mixing.mix(docs, mixing.size_of(F.col("text")))
    return plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree by 90 % or more."""
    found = jaccard.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by jump consistent hashing of doc_id."""
    return sharding.shard(documents(spark, sf_dir, "doc_id", "text"), 40)


@query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by the sentences in it."""
    return licences.licences(documents(spark, sf_dir, "doc_id", "text"))


@query
def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document by distance from its language."""
    judged = quality.quality(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document inside 100-byte strings that start earlier."""
    cut = repeats.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items, and windows that are there in part."""
    found = decontaminate.decontaminate(
        documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("item_ids")).alias("items_sha256"),
        "contaminated", "n_near",
    )


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by models of six sevenths of them."""
    return lm.score(documents(spark, sf_dir, "doc_id", "text"), crc_mod(F.col("doc_id"), 7) == 2)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of three quarters of the labels."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    scored = docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("t"))
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("t.worst_start").alias("worst_start"),
        F.col("t.worst_end").alias("worst_end"),
    )


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    found = documents(spark, sf_dir, "doc_id", "text").select("doc_id", pii.pii_spans(F.col("text")).alias("found"))
    spans = F.col("found")
    return found.select(
        "doc_id",
        *[pii.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(spans, pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the first four components of their distinct integer vectors."""
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("*", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.col("explained")[F.col("at")].alias("explained"), "identity_error",
    )


@query
def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact.exact_groups(documents(spark, sf_dir, "doc_id", "text"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of two to four words of every language."""
    return collocations.collocations(documents(spark, sf_dir, "text", "lang"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_mixing, op2_near_duplicates, op3_sharding, op4_licence_scan, op5_quality_divergence, op6_repeated_substrings,
        op7_decontamination, op8_lm_scoring, op9_toxicity, op10_personal_data, op11_embedding_whitening,
        op12_exact_duplicates, op13_collocations,
    )
}
ORACLES: dict[str, str] = {
    "op2_near_duplicates": sql.NEAR_DUPLICATES,
    "op3_sharding": sql.sharding_sql(40),
    "op4_licence_scan": licences.oracle(),
    "op7_decontamination": sql.DECONTAMINATION,
    "op12_exact_duplicates": exact.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
