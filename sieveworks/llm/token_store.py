"""Token ids in a content-addressed store.

Encoding. Texts are encoded with the tokenizers library. A space between two characters that are no
white space always begins a pre-token, as does a line feed after such a character, so a text is cut
there and pieces are encoded once; the pieces' ids joined are the ids of the whole text. Texts are
cut, pieces numbered and their ids joined by Arrow, so Python sees only the pieces that are new.

Store. A rolling hash over the last 16 ids cuts each document's ids into chunks, so equal stretches in
different documents give equal chunks. A chunk is named by its digest and stored once, by its first
document in doc_id order. Layout below the store's path:

    docs/      one row per document, files in ascending doc_id order: doc_id, shard, at (ids before it in
               its shard), n_tokens, recipe (20 bytes a chunk: digest, n << 1 | shared), own (the ids
               of chunks that stand nowhere else, in order), shared (digest and ids of chunks that stand
               again later: each is kept by the document it stands in first), root (Merkle root of
               the recipe)
    manifest/  one row per shard: shard, start (ids before it), n_docs, n_tokens, root (Merkle root over
               its documents in order; a leaf binds doc_id, place, number of ids and the document's root)
    top/       one row: width (bytes an id), end_id, n_shards, n_docs, n_tokens, root (over the shards' rows)

Ids are little-endian unsigned integers of two bytes if the vocabulary fits, else of four.
Reading checks all of it: before anything is rebuilt, the documents' rows against the shards' roots and
counts, and those against the top; while rebuilding, each chunk against its digest and each recipe
against its document's root. Lost, emptied, exchanged or changed rows and files fail the read.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
import sys
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import drop_path, new_path, write_parquet, write_table

_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n)")
_KNOWN_PIECES, _KNOWN_BYTES, _KNOWN_WORDS = 600_000, 1 << 25, 500_000
#: Bytes of text that are encoded at once.
_PORTION = 1 << 24
#: Ids whose chunks are sought at once.
_GROUP = 1 << 18
_WINDOW, _MIN, _MAX, _MASK = 16, 64, 2048, 0xFF
_DIGEST = 16


class Encoder:
    """Encodes texts to id arrays; one per worker process and vocabulary file.

    A new piece that is letters and closing marks is itself parted into its pre-tokens, and the library's
    model encodes each; any other new piece goes through the whole tokenizer. That a vocabulary
    parts texts in this way is tried when it is loaded; if it doesn't, texts go through it whole.

    ``known`` are pieces, ``values`` their ids. A piece that begins with a line feed stands for itself, any
    other for a space and itself. ``odd`` are those that a cut at every space and line feed must not
    give: empty ones and such with white space at an end."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 65536 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self._forget()
        self.words: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.shown = "".join(chr(letters[b]) for b in range(256))
        self.tokenize = self.tokenizer.model.tokenize
        trial = " a don't, über. 12%% x\ny;\n\n  z\t(q) ñandú!? \u3000w £5 a\u0301\nb.\n"
        self.parted = True
        self.parted = sys.byteorder == "little" and self.encode([trial, trial[1:], ""]) == self._whole([trial, trial[1:], ""])
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _forget(self) -> None:
        self.known, self.values, self.odd = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, dtype=bool)

    def _keep(self, numbers: np.ndarray) -> None:
        """Forgets all but these pieces, and them too if they are long."""
        used = np.zeros(len(self.known), dtype=bool)
        used[numbers] = True
        self.known, self.values, self.odd = self.known.filter(pa.array(used)), self.values.filter(pa.array(used)), self.odd[used]
        if len(self.known) > _KNOWN_PIECES or self.known.nbytes > _KNOWN_BYTES:
            self._forget()

    def _pretoken(self, text: str) -> bytes:
        shown = charmap_decode(text.encode(), None, self.shown)[0]
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def _solid(self, lead: str, piece: str) -> bytes | None:
        """The ids of letters with closing marks; null for any other piece. What is a letter is old and settled in
        the alphabets up to U+0530."""
        core = piece.rstrip(string.punctuation)
        if not core.isalpha() or not (core.isascii() or max(core) < "\u0530"):
            return None
        ids = self.words.get(core) if lead else None
        if ids is None:
            ids = self._pretoken(lead + core)
            if lead:
                self.words[core] = ids
        if len(core) == len(piece):
            return ids
        marks = piece[len(core) :]
        found = self.pretokens.get(marks)
        if found is None:
            found = self.pretokens[marks] = self._pretoken(marks)
        return ids + found

    def _learn(self, pieces: Sequence[str]) -> None:
        """Adds the ids of pieces to ``values``, and which are odd."""
        if len(self.words) > _KNOWN_WORDS:
            self.words.clear()
            self.pretokens.clear()
        feed, lead, words, tokenize, code, out, rest = self._pretoken("\n"), self.shown[32], self.words, self.tokenize, self.code, [], []
        for k, piece in enumerate(pieces):
            if piece.isalpha() and piece.isascii():
                ids = words.get(piece)
                if ids is None:
                    ids = words[piece] = array(code, [t.id for t in tokenize(lead + piece)]).tobytes()
            elif piece[:1] == "\n":
                ids = self._solid("", piece[1:])
                ids = None if ids is None else feed + ids
            else:
                ids = self._solid(" ", piece)
            if ids is None:
                rest.append(k)
            out.append(ids)
        for k, ids in zip(rest, self._whole([pieces[k] if pieces[k][:1] == "\n" else " " + pieces[k] for k in rest])):
            out[k] = ids
        odd = np.zeros(len(out), dtype=bool)
        odd[[k for k in rest if not (p := pieces[k]) or p[-1].isspace() or (p[0] != "\n" and p[0].isspace())]] = True
        self.values = pa.concat_arrays([self.values, pa.array(out, pa.binary())])
        self.odd = np.concatenate([self.odd, odd])

    def _heads(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces that begin a text."""
        found = {p: self._solid("", p) for p in pieces}
        rest = [p for p, ids in found.items() if ids is None]
        return found | dict(zip(rest, self._whole(rest)))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The places of pieces in ``known``; new ones are learned."""
        n = len(self.known)
        both = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        new = both.dictionary[n:].to_numpy(zero_copy_only=False).tolist()
        if new:
            self.known = both.dictionary
            self._learn(new)
        return both.indices.to_numpy()[n:]

    def _joined(self, numbers: np.ndarray, starts: np.ndarray, heads: list[str]) -> list[bytes]:
        """The ids of texts whose pieces begin at ``starts``; the first of each has no space before it."""
        first = self._heads(list(dict.fromkeys(heads)))
        place = {p: len(self.values) + k for k, p in enumerate(first)}
        numbers = numbers.copy()
        numbers[starts[:-1]] = [place[p] for p in heads]
        found = pa.concat_arrays([self.values, pa.array(list(first.values()), pa.binary())]).take(pa.array(numbers))
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[starts].tolist()
        data = data.to_pybytes() if data is not None else b""
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.parted:
            return self._whole(texts.to_pylist())
        if not len(texts):
            return []
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts, pieces = rows.offsets.to_numpy(), rows.flatten()
        numbers = self._numbers(pieces)
        out = self._joined(numbers, starts, pieces.take(pa.array(starts[:-1])).to_pylist())
        odd = self.odd[numbers]
        if odd.any():  # white space beside white space: cut those texts only where the side before, or both, are solid
            again = np.flatnonzero(np.logical_or.reduceat(odd, starts[:-1]))
            parts = [_CUT.split(t) for t in texts.take(pa.array(again)).to_pylist()]
            more = self._numbers(pa.array([p for x in parts for p in x], pa.string()))
            numbers = np.concatenate([numbers, more])
            for k, ids in zip(again.tolist(), self._joined(more, np.cumsum([0, *map(len, parts)]), [x[0] for x in parts])):
                out[k] = ids
        if len(self.known) > _KNOWN_PIECES or self.known.nbytes > _KNOWN_BYTES:
            self._keep(numbers)
        return out


_GEAR = np.random.default_rng(20240229).integers(1, 2**63, size=1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray, sizes: Sequence[int] | None = None) -> list[list[int]]:
    """Of each document (``sizes`` ids one after another in ``ids``): the ends of its chunks, after an id where
    the hash over the last 16 ids has its low bits clear, at least 64 and at most 2048 ids after the one
    before, and at its end. (No chunk ends in a document's first 63 ids, so no hash reaches into the one before.)"""
    n = len(ids)
    with np.errstate(over="ignore"):
        gear = _GEAR[ids] if ids.dtype.itemsize == 2 else _GEAR[ids & 0xFFFF] * (np.uint64(1) + (ids.astype(np.uint64) >> np.uint64(16)))
        rolled = gear
        for k in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 ids, each id shifted by its age
            more = rolled.copy()
            more[k:] += rolled[: max(0, n - k)] << np.uint64(k)
            rolled = more
        marks = np.flatnonzero(((rolled >> np.uint64(_WINDOW)) & np.uint64(_MASK)) == 0) + 1
    ends = np.cumsum([n] if sizes is None else sizes)
    split = np.searchsorted(marks, ends, side="right").tolist()
    every, out, lo, base = marks.tolist(), [], 0, 0
    for hi, end in zip(split, ends.tolist()):
        found, last, size = [], 0, end - base
        for mark in every[lo:hi]:
            mark -= base
            while mark - last > _MAX:
                last += _MAX
                found.append(last)
            if mark - last >= _MIN:
                last = mark
                found.append(mark)
        while size - last > _MAX:
            last += _MAX
            found.append(last)
        if last < size:
            found.append(size)
        out.append(found)
        lo, base = hi, end
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=_DIGEST).digest()


def merkle_root(leaves: Sequence[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up unchanged."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class Merkle:
    """The root over leaves that come one by one; holds one node a level."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.nodes and self.nodes[-1][0] == height:
            leaf, height = digest(b"\x01" + self.nodes.pop()[1] + leaf), height + 1
        self.nodes.append((height, leaf))

    def root(self) -> bytes:
        if not self.nodes:
            return digest(b"")
        found = self.nodes[-1][1]
        for _, node in reversed(self.nodes[:-1]):
            found = digest(b"\x01" + node + found)
        return found


def doc_leaf(doc_id: int | None, at: int, n_tokens: int, root: bytes) -> bytes:
    none = doc_id is None or doc_id != doc_id
    return digest(struct.pack("<?qqq", none, 0 if none else int(doc_id), at, n_tokens) + root)


def _seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of documents in (shard, at) order. Emits a row for each shard."""
    shard, tree, n_docs, n_tokens = None, Merkle(), 0, 0

    def row() -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens], "root": [tree.root()]})

    for pdf in batches:
        for doc_id, own, at, n, root in zip(pdf.doc_id, pdf.shard, pdf["at"], pdf.n_tokens, pdf.root):
            if shard is not None and own != shard:
                yield row()
                tree, n_docs, n_tokens = Merkle(), 0, 0
            shard, n_docs, n_tokens = own, n_docs + 1, n_tokens + n
            tree.add(doc_leaf(doc_id, at, n, bytes(root)))
    if shard is not None:
        yield row()


def _sealed(docs: DataFrame) -> DataFrame:
    """shard, n_docs, n_tokens, root: recomputed from the documents' rows, each shard as a stream."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "shard", "at", "n_tokens", "root").repartition(n, "shard").sortWithinPartitions("shard", "at", "doc_id")
    return rows.mapInPandas(_seal, "shard int, n_docs long, n_tokens long, root binary")


def _top(rows: list[tuple[int, int, int, int, bytes]]) -> bytes:
    tree = Merkle()
    for shard, start, n_docs, n_tokens, root in rows:
        tree.add(digest(struct.pack("<qqqq", shard, start, n_docs, n_tokens) + bytes(root)))
    return tree.root()


_ENCODED = "doc_id long, n_tokens long, ids binary, lens binary, digests binary"
_DOCS = "doc_id long, shard int, at long, n_tokens long, recipe binary, own binary, root binary, shared array<struct<digest:binary,ids:binary>>"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end, w = np.array([end_id], dtype=encoder.dtype).tobytes(), encoder.dtype.itemsize
        for batch in batches:
            every = pc.fill_null(batch.column(1), "")
            last = np.cumsum(pc.binary_length(every).to_numpy(zero_copy_only=False), dtype=np.int64) // _PORTION
            bounds = [0, *(np.flatnonzero(np.diff(last)) + 1).tolist(), len(every)]
            for lo, hi in zip(bounds, bounds[1:]):
                coded = [data + end for data in encoder.encode(every[lo:hi])]
                sizes = [len(data) // w for data in coded]
                lens, digests, k = [], [], 0
                for group in np.split(np.array(sizes, dtype=np.int64), np.flatnonzero(np.diff(np.cumsum(sizes) // _GROUP)) + 1):
                    part = coded[k : k + len(group)]
                    k += len(group)
                    for data, found in zip(part, cuts(np.frombuffer(b"".join(part), dtype=encoder.dtype), group)):
                        begins = [0, *found[:-1]]
                        digests.append(b"".join([digest(data[a * w : b * w]) for a, b in zip(begins, found)]))
                        lens.append(array("I", [b - a for a, b in zip(begins, found)]).tobytes())
                binary = [pa.array(x, pa.binary()) for x in (coded, lens, digests)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes, pa.int64()), *binary], names=["doc_id", "n_tokens", "ids", "lens", "digests"])

    return run


def _pack(width: int):
    """Rows of a shard come in (doc_id, kind) order: the shared chunks of a document (kind 0), then the
    document (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, at, flags = TaskContext.get().partitionId(), 0, {}
        for pdf in batches:
            rows = []
            for doc_id, kind, n, data, lens, names, marks in zip(pdf.doc_id, pdf.kind, pdf.n_tokens, pdf.ids, pdf.lens, pdf.digests, pdf.marks):
                if kind == 0:
                    flags = {int(m) >> 1: bool(int(m) & 1) for m in marks}
                    continue
                recipe, own, shared, pos = [], [], [], 0
                for k, length in enumerate(np.frombuffer(lens, dtype="<u4").tolist()):
                    name, chunk = names[k * _DIGEST : (k + 1) * _DIGEST], data[pos * width : (pos + length) * width]
                    recipe.append(name + struct.pack("<I", length << 1 | (k in flags)))
                    if k not in flags:
                        own.append(chunk)
                    elif flags[k]:
                        shared.append({"digest": name, "ids": chunk})
                    pos += length
                rows.append((doc_id, shard, at, n, b"".join(recipe), b"".join(own), merkle_root(recipe), shared))
                at, flags = at + n, {}
            yield pd.DataFrame(rows, columns=["doc_id", "shard", "at", "n_tokens", "recipe", "own", "root", "shared"])

    return run


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shards: int | None = None) -> str:
    """Encode ``docs`` (doc_id, text) and write the store; returns its path.

    A null text is empty; every document ends with ``end_id``. Rows that repeat a doc_id are documents of
    their own, next to each other. Rows with a null doc_id come first. An empty table gives a store
    without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    encoder = Encoder.of(tokenizer_path)
    wide = encoder.dtype.itemsize
    raw = write_table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(tokenizer_path, end_id), _ENCODED).withColumn("row", F.monotonically_increasing_id()), "ids")
    encoded = spark.read.parquet(raw)

    # Which chunks stand more than once, and which of their places is the first: names only.
    count = (F.length("digests") / _DIGEST).cast("int")
    names = encoded.select("doc_id", "row", "digests", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("k"))
    names = names.select("doc_id", "row", "k", F.substring(F.col("digests"), F.col("k") * _DIGEST + 1, F.lit(_DIGEST)).alias("digest"))
    place = F.struct(F.col("doc_id").isNotNull().alias("v"), "doc_id", "row", "k")
    often = names.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    often_path = write_table(often.select(F.col("digest").alias("_d"), "first"), "often")
    often = spark.read.parquet(often_path)
    first = (F.col("first.row") == F.col("row")) & (F.col("first.k") == F.col("k"))
    marks = names.join(often, F.col("digest") == F.col("_d")).groupBy("doc_id", "row").agg(F.collect_list(F.col("k") * 2 + first.cast("int")).alias("marks"))

    empty = F.lit(None).cast("binary")
    both = marks.select("doc_id", "row", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n_tokens"), empty.alias("ids"), empty.alias("lens"), empty.alias("digests"), "marks")
    both = both.unionByName(encoded.select("doc_id", "row", F.lit(1).alias("kind"), "n_tokens", "ids", "lens", "digests", F.lit(None).cast("array<int>").alias("marks")))
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = both.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row", "kind").drop("row")
    path = new_path(spark, "token-store")
    write_parquet(ordered.mapInPandas(_pack(wide), _DOCS), f"{path}/docs")

    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sealed = _sealed(spark.read.parquet(f"{path}/docs")).withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    sealed.coalesce(1).write.parquet(f"{path}/manifest")
    rows = _shards(spark, path)
    top = (wide, end_id, len(rows), sum(r[2] for r in rows), sum(r[3] for r in rows), _top(rows))
    spark.createDataFrame([top], "width int, end_id int, n_shards long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/top")
    for used in (raw, often_path):
        drop_path(spark, used)
    return path


def _shards(spark: SparkSession, path: str) -> list[tuple[int, int, int, int, bytes]]:
    """The manifest's rows in order: one a shard, so as many as there are files."""
    rows = spark.read.parquet(f"{path}/manifest").select("shard", "start", "n_docs", "n_tokens", "root").collect()
    return sorted((r["shard"], r["start"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in rows)


def verify_store(spark: SparkSession, path: str) -> int:
    """Checks the documents' rows against the manifest and the manifest against the top; returns the width of
    an id. Raises ValueError on any difference."""
    top = spark.read.parquet(f"{path}/top").collect()
    rows = _shards(spark, path)
    if len(top) != 1 or (top[0]["n_shards"], top[0]["n_docs"], top[0]["n_tokens"], bytes(top[0]["root"])) != (len(rows), sum(r[2] for r in rows), sum(r[3] for r in rows), _top(rows)):
        raise ValueError("the manifest does not match the store's root")
    found = _sealed(spark.read.parquet(f"{path}/docs")).select(F.col("shard").alias("s"), F.col("n_docs").alias("d"), F.col("n_tokens").alias("t"), F.col("root").alias("r"))
    both = spark.read.parquet(f"{path}/manifest").join(found, F.col("shard") == F.col("s"), "full_outer")
    same = F.col("n_docs").eqNullSafe(F.col("d")) & F.col("n_tokens").eqNullSafe(F.col("t")) & F.col("root").eqNullSafe(F.col("r"))
    wrong = both.filter(~same).select(F.coalesce("shard", "s").alias("shard")).orderBy("shard").first()
    if wrong is not None:
        raise ValueError(f"shard {wrong['shard']}: its documents do not match the manifest")
    return int(top[0]["width"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of every document, rebuilt
    from recipes and chunks. The store is verified first; a chunk that differs from its digest, a
    recipe that differs from its document's root or a missing chunk fails the read."""
    width = verify_store(spark, path)
    docs, manifest = (spark.read.parquet(f"{path}/{x}") for x in ("docs", "manifest"))
    chunks = docs.select(F.inline("shared"))  # reads that column only
    docs = docs.withColumn("row", F.struct("shard", "at"))
    entries = (F.length("recipe") / (_DIGEST + 4)).cast("int")
    last = F.conv(F.hex(F.substring(F.col("recipe"), F.col("k") * (_DIGEST + 4) + _DIGEST + 1, F.lit(1))), 16, 10).cast("int")
    wanted = docs.select("shard", "at", "recipe", F.explode(F.sequence(F.lit(0), entries - 1)).alias("k")).filter(last % 2 == 1)
    wanted = wanted.select("shard", "at", "k", F.substring(F.col("recipe"), F.col("k") * (_DIGEST + 4) + 1, F.lit(_DIGEST)).alias("digest"))
    parts = wanted.join(chunks, "digest").groupBy("shard", "at").agg(F.collect_list(F.struct("k", "ids")).alias("parts"))
    # Documents whose chunks are all their own are rebuilt where they are read; the others meet their parts.
    shares = F.exists(F.sequence(F.lit(0), entries - 1), lambda k: F.conv(F.hex(F.substring(F.col("recipe"), k * (_DIGEST + 4) + _DIGEST + 1, F.lit(1))), 16, 10).cast("int") % 2 == 1)
    columns = ["doc_id", "shard", "at", "n_tokens", "recipe", "own", "root"]
    alone = docs.filter(~shares).select(*columns, F.lit(None).cast("array<struct<k:int,ids:binary>>").alias("parts"))
    met = docs.filter(shares).join(parts, ["shard", "at"], "left").select(*columns, "parts")

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = "<u2" if width == 2 else "<u4"
        for pdf in batches:
            rows = []
            for doc_id, shard, at, n, recipe, own, root, parts in zip(pdf.doc_id, pdf.shard, pdf["at"], pdf.n_tokens, pdf.recipe, pdf.own, pdf.root, pdf.parts):
                got = {int(p["k"]): bytes(p["ids"]) for p in parts} if parts is not None else {}
                entries = [recipe[k : k + _DIGEST + 4] for k in range(0, len(recipe), _DIGEST + 4)]
                pos, out = 0, []
                for k, entry in enumerate(entries):
                    size = struct.unpack("<I", entry[_DIGEST:])[0]
                    if size & 1:
                        chunk = got.get(k, b"")
                    else:
                        chunk = own[pos : pos + (size >> 1) * width]
                        pos += len(chunk)
                    if digest(chunk) != entry[:_DIGEST]:
                        raise ValueError(f"document {doc_id}: chunk {k} does not match its digest")
                    out.append(chunk)
                if merkle_root(entries) != root:
                    raise ValueError(f"document {doc_id}: its recipe does not match its root")
                rows.append((doc_id, shard, at, n, np.frombuffer(b"".join(out), dtype=kind).astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "shard", "at", "n_tokens", "ids"])

    # Rebuilt in the same pass as it is read: the caller takes what it needs from the ids.
    found = alone.unionByName(met).mapInPandas(rebuild, "doc_id long, shard int, at long, n_tokens long, ids binary")
    starts = manifest.select("shard", F.col("start").alias("_start"))
    # One row a shard, so as many as there are files: bounded by the number of shards.
    return found.join(F.broadcast(starts), "shard").select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def crc_of_ids(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_store returns."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def vocabulary() -> str:
    """The vocabulary file the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_crc(ids: Sequence[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
