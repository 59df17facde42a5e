"""JSON trees as rows: every leaf with its path, in one pass over the documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaves_of(text: str) -> Iterator[tuple[str, str | None, str | None]]:
    """path, key and text of each leaf of a JSON value, in document order, however deep it is nested.

    Numbers keep the characters they are written with; an empty object or array has no leaf."""
    stack = [("", None, json.loads(text, parse_float=str, parse_int=str, parse_constant=str))]
    while stack:
        path, key, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path}.{k}", k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{path}[{k}]", key, v) for k, v in reversed(list(enumerate(value)))]
        else:
            yield path, key, value if value is None or isinstance(value, str) else str(value).lower()


CHUNK = 10_000


def walk(docs: DataFrame, id_column: str, variant: str) -> DataFrame:
    """id, pos, path, leaf, value of every leaf; pos numbers a document's leaves in its order from 0. ``leaf`` is the
    key itself, so keys that hold a dot stay whole. A null variant has no leaves. Each document is walked in the task
    that reads it, and its leaves leave it ``CHUNK`` at a time. A document nested deeper than the parser follows
    (some thousands of levels) is one row with a null path and pos -1."""
    rows = docs.select(F.col(id_column).alias("id"), F.to_json(variant).alias("json"))

    def leaves(i: object, text: str | None) -> Iterator[tuple]:
        if text is None:  # not a filter: that would be moved before the exchange that deals the documents
            return
        try:
            for pos, leaf in enumerate(leaves_of(text)):
                yield (i, pos, *leaf)
        except RecursionError:
            yield i, -1, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = (leaf for i, text in zip(pdf.id, pdf.json) for leaf in leaves(i, text))
            while chunk := list(islice(found, CHUNK)):
                yield pd.DataFrame(chunk, columns=["id", "pos", "path", "leaf", "value"])

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, pos long, path string, leaf string, value string")


def in_key(term: str) -> Column:
    """Whether a leaf's key holds the term, whatever its case."""
    return F.coalesce(F.contains(F.lower("leaf"), F.lit(term.lower())), F.lit(False))


def in_value(term: str) -> Column:
    """Whether a leaf's text, under 300 characters, holds the term."""
    return F.coalesce(F.contains(F.lower("value"), F.lit(term.lower())) & (F.length("value") < 300), F.lit(False))


def find(leaves: DataFrame, term: str, keys: int = 25, values: int = 15) -> DataFrame:
    """Leaves whose key holds the term, else those whose text under 300 characters does: the first of each
    document in its order, with kind key or value."""
    rows = leaves.withColumn("kind", F.when(in_key(term), "key").when(in_value(term), "value")).filter("kind is not null")
    place = F.row_number().over(Window.partitionBy("id", "kind").orderBy("pos"))
    most = F.when(F.col("kind") == "key", keys).otherwise(values)
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def stable_paths(leaves: DataFrame, pages: int) -> DataFrame:
    """Paths that stand in at least ``pages`` documents, array positions apart."""
    path = F.regexp_replace("path", r"\[\d+\]", "[]")
    return leaves.groupBy(path.alias("path")).agg(F.countDistinct("id").alias("pages")).filter(F.col("pages") >= pages)
