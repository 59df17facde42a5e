"""Collocations of two to four words, by hashed bucket counts and Apriori pruning.

There are four passes over the texts. Pass k counts phrases of k words exactly, but only candidates: the bucket of
the phrase was reached often enough in the pass before, and both its parts of k - 1 words are frequent. In the same
pass, phrases of k + 1 words whose parts are still candidates are counted into buckets by a hash. Bucket counts are
bytes that stop at 255 (support is at most that), so a task holds and sends at most 2**bits bytes; what is broadcast
is one bit a bucket, and one bit a hash of the frequent shorter phrases. Both are bounded by 2**27 bits (16 MB)
however large the corpus is; a bit set by chance only lets a phrase be counted that is dropped afterwards.

Within a task words are numbered by their bytes and phrases by the numbers of their words, and between tasks counts
meet under the phrase itself, so hashes never decide a count. Long texts are worked on in parts cut between pieces.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Stages, stage
from .words import hash_bytes, mix64, windows

_PART, _BLOCK, _LEAST_BITS, _MOST_BITS = 4 << 20, 1 << 16, 16, 27
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" ")
_COUNTS = "kind int, lang string, phrase string, cnt long, block int, payload binary"
_COUNT_TYPE = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("cnt", pa.int64()), ("block", pa.int32()), ("payload", pa.binary())])


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Folded texts with their languages, about ``size`` bytes at a time; longer ones are cut at a piece's end."""
    texts, langs, total = [], [], 0
    for raw, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()):
        at, text = 0, (raw or b"").translate(_FOLD)
        while at < len(text):
            end = len(text)
            if end - at > size:
                cut = text.rfind(b"\n", at, at + size)
                cut = cut if cut > at else text.find(b"\n", at + size)
                end = cut if cut > at else end
            texts.append(text[at:end])
            langs.append(lang)
            total, at = total + end - at, end
            if total >= size:
                yield texts, langs
                texts, langs, total = [], [], 0
    if texts:
        yield texts, langs


class _Words:
    """The words of folded texts: ids and vocabulary, text and piece of each, and a hash of word and language."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        solid = np.zeros(len(data) + 2, dtype=np.int8)
        solid[1:-1] = (data != 0x20) & (data != 0x0A)
        edge = np.diff(solid)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[solid[1:-1] == 1]))
        coded = words.dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.piece = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.text = np.searchsorted(begins, starts, side="right") - 1
        code, names = pd.factorize(np.array(langs, dtype=object))
        self.names, self.lang = pa.array(list(names), pa.string()), code[self.text] if len(starts) else np.zeros(0, dtype=np.int64)
        tongue = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest()) for n in names], dtype=np.uint64)
        own = hash_bytes(b"\n".join(self.vocabulary.cast(pa.binary()).to_pylist()))[1] if len(starts) else np.zeros(0, dtype=np.uint64)
        self.hash = mix64(own[self.ids] ^ tongue[self.lang]) if len(starts) else own

    def whole(self, k: int) -> np.ndarray:
        """Whether a phrase of k words that lies in one piece starts at a word."""
        n = len(self.ids) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """Counts of the phrases of k words that start at the places ``at``."""
        dense, _ = pd.factorize(self.lang * len(self.vocabulary) + self.ids)
        most, code = len(self.ids) + 1, dense[at]
        for j in range(1, k):
            code, _ = pd.factorize(code * most + dense[at + j])
        counts = np.bincount(code)
        first = np.empty(len(counts), dtype=np.int64)
        first[code[::-1]] = at[::-1]
        texts = [self.vocabulary.take(pa.array(self.ids[first + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*texts, " ") if k > 1 else texts[0]
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), self.names.take(pa.array(self.lang[first])), phrase, pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_COUNT_TYPE)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _is_set(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1


def _add(counts: np.ndarray, bucket: np.ndarray) -> None:
    code, own = pd.factorize(bucket)
    counts[own] = np.minimum(255, counts[own] + np.bincount(code, minlength=len(own)))


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in range(len(counts) // _BLOCK):
        part = counts[b * _BLOCK : (b + 1) * _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=_COUNT_TYPE)


def _pass(k: int, longest: int, bits: int, size: int, often, frequent):
    """Pass k. ``often``: broadcast bits of the buckets of phrases of k words; ``frequent``: of the hashes of the
    frequent phrases of k - 1 words. Both are None in the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(1 << bits if k < longest else 0, dtype=np.uint8)
        reached = np.frombuffer(often.value, dtype=np.uint8) if often else None
        known = np.frombuffer(frequent.value, dtype=np.uint8) if frequent else None
        for batch in batches:
            for texts, langs in _parts(batch, size):
                w = _Words(texts, langs)
                alive = w.whole(k)
                if k > 1 and len(alive):
                    part = _is_set(known, _bucket(windows(w.hash, k - 1) if k > 2 else w.hash, bits))
                    alive &= part[: len(alive)] & part[1 : len(alive) + 1]
                    at = np.flatnonzero(alive)
                    alive[at] = _is_set(reached, _bucket(windows(w.hash, k)[at], bits))
                at = np.flatnonzero(alive)
                if len(at):
                    yield w.counted(at, k)
                if k < longest and len(alive) > 1:
                    next_at = np.flatnonzero(w.whole(k + 1) & alive[:-1] & alive[1:])
                    if len(next_at):
                        _add(buckets, _bucket(windows(w.hash, k + 1)[next_at], bits))
        yield from _blocks(buckets)

    return run


def _mark(k: int, bits: int, size: int):
    """Sets the bit of the hash of each row's phrase of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, dtype=np.uint8)
        for batch in batches:
            for texts, langs in _parts(batch, size):
                w = _Words(texts, langs)
                first = np.flatnonzero(np.diff(w.text, prepend=-1))
                marks[_bucket((windows(w.hash, k) if k > 1 else w.hash)[first], bits)] = 1
        yield from _blocks(marks)

    return run


def _to_bits(least: int):
    """Adds up the counts of each block as they stream by; a bit a bucket that reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("payload")):
                own = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                if b in total:
                    total[b] = np.minimum(255, total[b].astype(np.uint16) + own).astype(np.uint8)
                else:
                    total[b] = own
        for b, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _bitmap(blocks: DataFrame, least: int, bits: int):
    """The broadcast bitmap: 2**bits bits, at most 16 MB, on the driver."""
    found = bytearray((1 << bits) // 8)
    for r in blocks.select("block", "payload").repartition("block").mapInArrow(_to_bits(least), "block int, bits binary").toLocalIterator():
        found[r.block * _BLOCK // 8 : (r.block + 1) * _BLOCK // 8] = r.bits
    return blocks.sparkSession.sparkContext.broadcast(bytes(found))


def bucket_bits(size: int, support: int) -> int:
    """Buckets for a corpus of ``size`` bytes: the mean bucket holds a quarter of ``support`` phrases, up to 2**27
    buckets; beyond that more phrases are counted than need be, with the same result."""
    return min(_MOST_BITS, max(_LEAST_BITS, math.ceil(math.log2(max(1, size) / 6 * 4 / support))))


def frequent_phrases(documents: DataFrame, longest: int, support: int, stages: Stages, part_bytes: int = _PART, bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """[phrases of 1, 2, ... words as lang, phrase, f >= support], and words by lang (lang, n)."""
    if not 1 <= support <= 255:
        raise ValueError("support must lie between 1 and 255, the most a bucket counts")
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = bits or bucket_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, support)
    often, frequent, found, n = None, None, [], None
    for k in range(1, longest + 1):
        counts = stages(docs.mapInArrow(_pass(k, longest, bits, part_bytes, often, frequent), _COUNTS), f"phrases-{k}")
        phrases = counts.filter("kind = 0")
        if k == 1:
            n = stages(phrases.groupBy("lang").agg(F.sum("cnt").alias("n")), "phrases-n")
        found.append(stages(phrases.groupBy("lang", "phrase").agg(F.sum("cnt").alias("f")).filter(F.col("f") >= support), f"phrases-f{k}"))
        for used in (often, frequent):
            if used:
                used.destroy()
        if k < longest:
            often = _bitmap(counts.filter("kind = 1"), support, bits)
            frequent = _bitmap(found[-1].select("lang", F.col("phrase").alias("text")).mapInArrow(_mark(k, bits, part_bytes), _COUNTS), 1, bits)
    return found, n


def _cuts(longest: int) -> F.Column:
    """For each cut of a phrase, its first and its last part, numbered."""
    word = F.col("w")
    both = [(2 * k + side, F.slice(word, F.lit(1 + side * k), F.lit(k) if side == 0 else F.size(word) - k), k) for k in range(1, longest) for side in (0, 1)]
    return F.filter(F.array(*[F.struct(F.lit(slot).alias("slot"), F.when(F.size(word) > k, F.array_join(part, " ")).alias("part")) for slot, part, k in both]), lambda x: x["part"].isNotNull())


def collocations(documents: DataFrame, longest: int = 4, support: int = 30, percent: int = 80, most: int = 2000, part_bytes: int = _PART, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language.

    A null language is ``und``; null, empty and blank texts have no words. Phrases end at ``.,;:!?`` and at line ends;
    counts include overlaps and repeated rows. Of equal lowest cuts the one after fewer words counts. Phrases that lie
    in a longer one with at least ``percent`` of their count are dropped. Arithmetic is decimal. An empty table gives
    no rows; further columns are ignored. A single piece longer than ``part_bytes`` is held as a whole."""
    stages = Stages(documents.sparkSession)
    found, n = frequent_phrases(documents, longest, support, stages, part_bytes, bits)
    shorter = found[0]
    for f in found[1:-1]:
        shorter = shorter.unionByName(f)
    candidates = found[1]
    for f in found[2:]:
        candidates = candidates.unionByName(f)
    candidates = candidates.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    pieces = candidates.select("lang", "phrase", "a", F.inline(_cuts(longest)))
    parts = pieces.join(shorter.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    slots = parts.groupBy("lang", "phrase", "a").agg(*[F.max(F.when(F.col("slot") == s, F.col("f"))).alias(f"f{s}") for s in range(2, 2 * longest)])
    score = lambda k: F.expr(f"(CAST(a AS DECIMAL(20,0)) * 2000000BD) div (CAST(f{2 * k} AS DECIMAL(20,0)) + f{2 * k + 1})")
    cuts = F.array(*[F.when(F.col(f"f{2 * k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))) for k in range(1, longest)])
    scored = slots.select("lang", "phrase", "a", F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    within = [F.array_join(F.slice("w", at, size), " ") for size in range(2, longest) for at in range(1, longest - size + 2)]
    sizes = [(size, at) for size in range(2, longest) for at in range(1, longest - size + 2)]
    inner = F.array_compact(F.array(*[F.when((F.size("w") > size) & (F.size("w") >= at + size - 1), part) for (size, at), part in zip(sizes, within)])) if within else F.array().cast("array<string>")
    covered = candidates.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(covered, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).filter(F.col("rank") <= most)
    result = stage(first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases-first")
    stages.drop()
    return result


def collocations_sql(longest: int = 4, support: int = 30, percent: int = 80, most: int = 2000) -> str:
    """The same rows in the dialect of the checking engine."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
 f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {longest + 1}) AS t(k)) GROUP BY 1, 2, 3 HAVING count(*) >= {support}),
 c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
 cut AS (SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, range(1, {longest}) AS t(j) WHERE j < k),
 best AS (SELECT cut.lang, cut.phrase, any_value(a) AS a, min(struct_pack(score := (a::HUGEINT * 2000000) // (fx.f + fy.f), j := j, l := fx.f, r := fy.f)) AS b FROM cut JOIN f AS fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f AS fy ON fy.lang = cut.lang AND fy.phrase = y GROUP BY 1, 2),
 long AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, range(2, {longest}) AS t(m), range(1, {longest}) AS u(i) WHERE m < k AND i + m - 1 <= k) GROUP BY 1, 2),
 ranked AS (SELECT best.lang, best.phrase, a, b.l AS l, b.r AS r, CAST(b.score AS BIGINT) AS score, row_number() OVER (PARTITION BY best.lang ORDER BY b.score DESC, a DESC, best.phrase) AS rank FROM best LEFT JOIN long ON long.lang = best.lang AND long.phrase = best.phrase WHERE longer IS NULL OR longer * 100 < a * {percent})
 SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {most}"""
