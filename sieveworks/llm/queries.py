"""The opN queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontam, embed_dup, langid, main_text, mixing, mixing_sql, near_dup, oracle_queries, phrases, quality, secrets, substring, token_store, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.substring_dedup(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.doc_held_out().alias("held_out"), "expected_grade", "p_good", "keep")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", toxicity.doc_held_out().alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.doc_held_out().alias("held_out"), "score", "predicted")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), token_store.vocabulary(), end_id=2)
    return token_store.crc_of_ids(token_store.read_store(spark, path))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality": op3_quality,
    "op4_mix_sources": op4_mix_sources,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_token_store": op8_token_store,
    "op9_decontaminate": op9_decontaminate,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_collocations": op12_collocations,
    "op13_main_text": op13_main_text,
}
#: The others train a model, follow regular expressions SQL engines lack, or write files; they are tested
#: against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": oracle_queries.OP1,
    "op2_secret_scan": oracle_queries.OP2,
    "op4_mix_sources": mixing_sql.mix_sql(),
    "op5_embedding_dedup": oracle_queries.OP5,
    "op10_near_duplicates": oracle_queries.OP10,
    "op11_centroid_clusters": centroids.cluster_sql(),
    "op12_collocations": phrases.collocations_sql(),
}
