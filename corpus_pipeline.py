"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveworks.llm import decontam, mixing, near_dup, token_store, toxicity
from sieveworks.llm.store import new_path, stage

#: Rows with a whole text that a worker is given at a time. Workers live on from stage to stage with all the memory that
#: their largest batch took.
TEXT_ROWS = 256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go. Null and empty texts have no term and stay; without
    labelled rows all stay; rows with a null doc_id, repeated rows and very long texts are judged each by
    its whole text. An empty table stays empty, other columns pass through."""
    return stage(toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))), "clean", TEXT_ROWS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id. Null, empty and blank
    texts are in no group and stay, as do rows with a null doc_id and rows that repeat a kept doc_id."""
    return near_dup.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; items of fewer than five tokens are no evidence. Null and empty texts hold none; rows with a null doc_id
    stay; an empty benchmark lets all pass."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"), least_tokens=decontam.EVIDENCE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words have nothing to take and go; a null source is
    a source, a null doc_id a doc_id; repeated rows are taken as rows of their own."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the content-addressed store, verified and read back: a row a document, in the order of doc_id,
    nulls first and repeated ones next to each other."""
    path = token_store.write_store(docs.select("doc_id", "text"), token_store.vocabulary(), end_id=2)
    return token_store.crc_of_ids(token_store.read_store(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token-store", token_stage),
]

#: SQL can express neither the trained model nor the encoder.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The stages' tables stay in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
