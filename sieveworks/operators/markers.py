"""Which of thousands of markers a text holds, in one pass over the text.

Markers become one Aho-Corasick automaton, which finds all of them at once, whatever their number. It is broadcast
only up to ``most_bytes`` of markers; a larger table is dealt by hash into so many automata of about that size, each a
pass of its own over the texts. Texts are lower-cased before they leave the JVM, so the result is that of
``contains(lower(text), marker)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20


def automaton(markers: list[str]) -> ahocorasick.Automaton:
    """Finds each marker; the value found is the marker itself."""
    found = ahocorasick.Automaton()
    for m in markers:
        found.add_word(m, m)
    found.make_automaton()
    return found


def matching(texts: DataFrame, key: str, text: str, markers: DataFrame, marker: str = "marker", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``texts``: key, text. ``markers``: a column of markers. A row a text and distinct marker in it: key, marker.
    Markers are lower-cased; null and empty ones, and null texts, match nothing."""
    table = markers.select(F.lower(marker).alias("marker")).filter("marker <> ''").distinct()
    size = table.agg(F.sum(F.octet_length("marker"))).first()[0] or 0
    parts = max(1, math.ceil(size / most_bytes))
    key_type = texts.schema[key].dataType.simpleString()
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    out = None
    for p in range(parts):
        part = table if parts == 1 else table.filter(F.pmod(F.xxhash64("marker"), F.lit(parts)) == p)
        own = rows.sparkSession.sparkContext.broadcast([r.marker for r in part.toLocalIterator()])
        found = rows.mapInArrow(_found(own), f"key {key_type}, marker string")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key").alias(key), "marker")


def _found(markers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton(markers.value)
        for batch in batches if len(search) else ():
            at, names = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = {m for _, m in search.iter(text)}
                at += [k] * len(own)
                names += own
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(names, pa.string())], names=["key", "marker"])

    return run
