"""Near-duplicate documents by bottom-k sketches.

A document's set holds the 64-bit hashes of its distinct shingles of five words; its sketch is the k
smallest. One hash function serves all. Documents with equal sets are one class, so copies are gone
before anything is compared. Then, over classes:

1. Inverted lists. Two sets with Jaccard similarity 0.75 share at least ``shared`` retained values but
   for a chance of 2.4e-7, so they meet in one of the first k - shared + 1 values of either sketch, in
   any order that all sketches use. The order is from rare to frequent, so values of common passages
   come last and their long lists are seldom entered.
2. Round one links each class with the most central one of each of its lists. These pairs grow with the
   number of entries. The union sketch estimates their similarity and drops the hopeless ones, the
   full sets decide the others. Components of the links follow.
3. Round two takes the lists that still hold more than one component. Of short lists, all pairs across
   components are estimated and verified as before. Long lists are cut into blocks, those of the
   list's largest component and those of the others; each block of the others meets every block, and a
   task compares a pair of blocks on full sets and emits a spanning forest of its links. Members of the
   largest component are connected already and don't meet each other.

So every pair that shares an entry is compared on full sets unless it is already connected or its
estimate is hopeless. Components are therefore those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Stages, stage
from .words import hashed_words, mix64, windows

_K, _SHARED, _WORDS = 32, 11, 5
_SHORT_LIST, _BLOCK = 48, 384


def shingle_sets(texts: list[str | None], length: int = _WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text: of all runs of ``length`` words, ASCII
    letters in lower case; with fewer words, of the one sequence; without words, none."""
    raw = [(t or "").encode().lower() for t in texts]
    for first, last, hashes, offsets in hashed_words(raw):
        runs = windows(hashes, length)
        for k in range(last - first):
            lo, hi = int(offsets[k]), int(offsets[k + 1])
            if hi - lo >= length:
                yield np.unique(runs[lo : hi - length + 1].view(np.int64))
            elif hi > lo:
                yield mix64(windows(hashes[lo:hi], hi - lo), seed=hi - lo).view(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (128 bits of the set), sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:_K].copy()) for s in shingle_sets(pdf.text.tolist())]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_shingles": [s[0] for s in sets], "fp": [s[1] for s in sets], "sketch": [s[2] for s in sets]})

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").mapInPandas(run, "doc_id long, n_shingles long, fp binary, sketch array<long>")


def _needed(n: Column) -> Column:
    """Shared retained values that a similar partner has at least: exact for sets that are retained whole
    with all their possible partners, else the bound above."""
    return F.when(n * 4 <= _K * 3, F.ceil(n * 0.75)).otherwise(F.lit(_SHARED)).cast("int")


def entries_of(reps: DataFrame, work: Stages) -> DataFrame:
    """value, rep, n, weight: the entries of classes in inverted lists of two or more."""
    values = reps.select("rep", "n", F.explode("sketch").alias("value"))
    often = work(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "sketch-values")
    met = values.join(often, "value")
    # A class has at most k values. Values that no other class retains only take up places.
    lists = met.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    places = F.least(F.col("n"), F.lit(_K)) - _needed(F.col("n")) + 1 - (F.least(F.col("n"), F.lit(_K)) - F.size("v"))
    weight = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    lists = lists.select("rep", "n", weight.alias("weight"), F.when(places > 0, F.slice("v", F.lit(1), places.cast("int"))).alias("v"))
    found = lists.select("rep", "n", "weight", F.explode("v.value").alias("value"))
    return work(found, "entries")


def _alike(n: Column, m: Column) -> Column:
    return (n * 4 >= m * 3) & (m * 4 >= n * 3)


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and union sketch allow the similarity."""
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").filter(_alike(F.col("na"), F.col("nb")))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, _K)
    both = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    return met.filter(both * _K >= _SHARED * F.size(union)).select("a", "b")


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.sort_values("a", kind="stable")
        linked, last, left = [], None, None
        for lo in range(0, len(pdf), 256):
            part = pdf.iloc[lo : lo + 256]
            for a, b, text, right in zip(part.a, part.b, part.ta, shingle_sets(part.tb.tolist())):
                if last != a or left is None:
                    last, left = a, next(shingle_sets([text]))
                common = len(np.intersect1d(left, right, assume_unique=True))
                if common and 100 * common >= 75 * (len(left) + len(right) - common):
                    linked.append((a, b))
        yield pd.DataFrame(linked, columns=["a", "b"]).astype("int64")


#: Rows with one and with two whole texts that a worker is given at a time.
_TEXT_ROWS, _PAIR_ROWS = 256, 128


def confirmed(pairs: DataFrame, docs: DataFrame, work: Stages, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The pairs whose full sets have the similarity, from whole texts. The pair list is broadcast up to
    ``broadcast_rows`` pairs, so that only texts of its documents are shuffled; beyond, all joins shuffle."""
    pairs = work(pairs, "pairs")
    few = pairs.count() <= broadcast_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    members = pairs if not few else F.broadcast(pairs)
    leaders = pairs.select(F.col("a").alias("l")).distinct()
    right = texts.join(members, F.col("d") == F.col("b")).select("a", "b", F.col("text").alias("tb"))
    left = texts.join(F.broadcast(leaders) if few else leaders, F.col("d") == F.col("l")).select("l", F.col("text").alias("ta"))
    met = right.join(left.hint("merge"), F.col("a") == F.col("l")).select("a", "b", "ta", "tb")
    return work(met.mapInPandas(_confirm, "a long, b long").distinct(), "confirmed", _PAIR_ROWS)


def _forest(reps: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different components (within the block, or between blocks 0 and 1),
    as a spanning forest. Intersections are products of 0/1 rows, exact in float32 below 2**24."""
    n = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.flatnonzero(np.bincount(place) > 1)
    rank = np.full(len(values), -1)
    rank[often] = np.arange(len(often))
    row, col = np.repeat(np.arange(len(sets)), n), rank[place]
    row, col = row[col >= 0], col[col >= 0]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, len(often), 4096):
        inside = (col >= lo) & (col < lo + 4096)
        m = np.zeros((len(sets), min(4096, len(often) - lo)), dtype=np.float32)
        m[row[inside], col[inside] - lo] = 1
        common += m @ m.T
    linked = (100 * common >= 75 * (n[:, None] + n[None, :] - common)) & (comps[:, None] != comps[None, :])
    linked &= (side[:, None] <= side[None, :]) if side.any() else True
    found, root = [], {int(c): int(c) for c in np.unique(comps)}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for i, j in zip(*np.nonzero(np.triu(linked, 1) | (linked & (side[:, None] < side[None, :])))):
        x, y = top(int(comps[i])), top(int(comps[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((int(reps[i]), int(reps[j])))
    return found


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (value, i, j): a group may reach over batches."""
    held: list[pd.DataFrame] = []
    key = None

    def done() -> pd.DataFrame:
        group = pd.concat(held).drop_duplicates("rep")
        i, j = key[1], key[2]
        side = (group.block != i).to_numpy().astype(np.int8) if i != j else np.zeros(len(group), dtype=np.int8)
        found = _forest(group.rep.to_numpy(), group.comp.to_numpy(), list(shingle_sets(group.text.tolist())), side)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    for pdf in batches:
        for k, group in pdf.groupby(["value", "i", "j"], sort=False):
            if key is not None and k != key:
                yield done()
                held.clear()
            key = k
            held.append(group)
    if key is not None:
        yield done()


def _long_lists(entries: DataFrame, lists: DataFrame, docs: DataFrame) -> DataFrame:
    """Links across components in lists longer than a short one, by pairs of blocks."""
    rows = entries.join(lists.filter(F.col("m") > _SHORT_LIST), "value")
    inside = F.col("comp") == F.col("main")
    guests, hosts = F.ceil((F.col("m") - F.col("m_main")) / _BLOCK).cast("int"), F.ceil(F.col("m_main") / _BLOCK).cast("int")
    rows = rows.withColumns({"guests": guests, "hosts": hosts})
    # Blocks 0 .. guests - 1 hold the other components, the rest the main one, whose members are connected.
    own = F.when(inside, F.col("guests") + F.pmod(F.xxhash64("rep", "value"), F.col("hosts"))).otherwise(F.pmod(F.xxhash64("rep", "value"), F.col("guests"))).cast("int")
    mates = F.sequence(F.lit(0), F.when(inside, F.col("guests") - 1).otherwise(F.col("guests") + F.col("hosts") - 1))
    rows = rows.select("value", "rep", "comp", own.alias("block"), F.explode(mates).alias("other"))
    rows = rows.select("value", "rep", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    wanted = rows.select("rep").distinct()
    texts = texts.join(wanted, "rep", "left_semi")
    met = rows.join(texts, "rep")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "value", "i", "j").sortWithinPartitions("value", "i", "j").mapInPandas(_block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept.

    Links are pairs with 100 * |intersection| >= 75 * |union| of the shingle sets. Null, empty and
    blank texts have an empty set and link with nothing. Very long texts are read whole. Of equal sets the
    smallest doc_id stands for all. Rows that repeat a doc_id give a row each and
    share one node. Rows with a null doc_id are left out. An empty table gives an empty result. Only
    doc_id and text are read.
    """
    work = Stages(docs.sparkSession)
    found = stage(profiles(docs), "profiles", _TEXT_ROWS)
    some = found.filter("n_shingles > 0")
    classes = work(some.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")
    reps = classes.select("rep", "n", "sketch")
    entries = entries_of(reps, work)

    heads = entries.groupBy("value").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    heads = work(heads.select("value", (-F.col("head.rep")).alias("a"), "m"), "heads")
    first = entries.join(heads, "value").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    links = confirmed(estimated(first, reps), docs, work)
    comp = work(components(links), "components")

    labelled = work(entries.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).select("value", "rep", "comp"), "labelled")
    sizes = labelled.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c"))
    lists = sizes.groupBy("value").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("main")).filter("comps > 1")
    lists = work(lists.select("value", "m", F.col("main.comp").alias("main"), F.col("main.c").alias("m_main")), "open-lists")
    short = labelled.join(lists.filter(F.col("m") <= _SHORT_LIST).select("value"), "value")
    pairs = short.select("value", F.col("rep").alias("a"), F.col("comp").alias("ca")).join(short.select("value", F.col("rep").alias("b"), F.col("comp").alias("cb")), "value")
    pairs = pairs.filter("a < b and ca <> cb").select("a", "b").distinct()
    more = confirmed(estimated(pairs, reps), docs, work)
    if lists.filter(F.col("m") > _SHORT_LIST).limit(1).count():
        more = more.unionByName(work(_long_lists(labelled, lists, docs), "block-links", _PAIR_ROWS))
    if more.limit(1).count():
        # Links of round one are stood for by their stars.
        comp = work(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    labels = stage(classes.select("fp", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "labels")
    work.drop()
    out = found.select("doc_id", "n_shingles", "fp").join(labels, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for. Of rows that repeat the
    doc_id of a kept document, all stay; rows with a null doc_id stay."""
    dropped = stage(near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("k")).filter("not k").select(F.col("doc_id").alias("_gone")), "dropped")
    few = dropped.count() <= broadcast_rows
    return docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col("_gone"), "left_anti")
