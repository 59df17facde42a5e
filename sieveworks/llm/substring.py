"""Substring dedup: repeated passages by prefix-partitioned suffix trees over words.

The suffix that begins at a word is followed down to depth ``length`` (20 words). Two suffixes that reach
that depth together are under one deep internal node, and all but the first of its leaves are windows
that stand earlier already.

Anchors. A window's anchor is the run of ``anchor`` words inside it with the least hash. Equal windows have
equal anchors, and neighbouring windows nearly always share theirs, so a text has about two anchors in
thirteen words. A window whose anchor stands nowhere else is not repeated: a first exchange of anchor
hashes tells each document which of its anchors are met elsewhere, and only windows around those go on.

Partition by prefixes. The path of such a window is 64 bits: 40 of its anchor, then 24 of its first eight
words. Neighbours on one anchor travel together, with their words. A prefix of the path names a group.
Anchors are counted by short prefixes (at most 65,536 counters); each prefix is then lengthened until
what is under it fits in memory. So prefixes are of variable length: long where many suffixes share
an anchor, short elsewhere.

Subtrees. A task numbers the words of a group, sorts its suffixes by their words and takes the longest
common prefix of neighbours. Runs of neighbours with ``length`` words in common are the deep internal
nodes; the leaf with the least (doc_id, start) is a node's first. (Suffixes whose 64-bit window hash is
unique in the group can't be under a deep node and are left out of the sort; equality is decided on words.)
Consecutive windows that are not first make one maximal repeated stretch.

Hot passages. Each batch of documents builds its own nodes first and sends only their first leaves; the
others are known to stand earlier. A group is read in chunks: after each, only first leaves are held. So a
passage in a third of all documents sends one suffix a batch, and a task holds it once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage
from .words import hash_bytes, hashed_words, windows

_GROUP = 1_000_000
_BATCH_BYTES = 4_000_000
_HEAD_BITS, _ANCHOR_BITS = 16, 40
_WINDOWS_AN_ANCHOR = 6.5  # of 20 words with anchors of 9
_ANCHORS = "kind int, grp long, doc_id long, data binary"
_PARTS = "kind int, part int, grp long, doc_id long, data binary"
_SPACE = b" \t\n\x0b\x0c\r"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    done, found = 1, x
    while done < width:
        step = min(done, width - done)
        found = np.minimum(found[: len(found) - step], found[step:])
        done += step
    return found


def _stretches(starts: np.ndarray) -> np.ndarray:
    """Sorted starts as rows (first, count) of consecutive runs."""
    if not len(starts):
        return np.empty((0, 2), dtype="<u4")
    cut = np.flatnonzero(np.diff(starts) > 1)
    first = starts[np.concatenate([[0], cut + 1])]
    last = starts[np.concatenate([cut, [len(starts) - 1]])]
    return np.stack([first, last - first + 1], 1).astype("<u4")


def _per_doc(doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """doc_id and its stretches, from windows in (doc, start) order."""
    if len(doc):
        at = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield int(doc[lo]), _stretches(start[lo:hi]).tobytes()


class Words:
    """Numbers words in order of their first sight, and keeps a hash of each."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self._hashes = np.empty(0, dtype=np.uint64)

    def number(self, words: Iterator[bytes] | list[bytes], count: int) -> np.ndarray:
        codes = self.codes
        return np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int32, count=count)

    def hashes(self) -> np.ndarray:
        known = len(self._hashes)
        if known < len(self.codes):
            self._hashes = np.concatenate([self._hashes, hash_bytes(b"\n".join(list(self.codes)[known:]))[1]])
        return self._hashes


@dataclass
class Runs:
    """Runs of consecutive windows: of run k, ``count[k]`` windows from word ``start[k]`` of ``doc[k]`` on. Their
    ``count[k] + length - 1`` words lie one after another in ``codes``."""

    codes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: place in codes, document, first word."""
        inside = np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        size = self.count + length - 1
        return np.repeat(np.cumsum(size) - size, self.count) + inside, np.repeat(self.doc, self.count), np.repeat(self.start, self.count) + inside


def runs_of(codes: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> Runs:
    """The runs that some windows make, in the order given."""
    if not len(at):
        empty = np.empty(0, dtype=np.int64)
        return Runs(np.empty(0, dtype=np.int32), empty, empty, empty)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    size = count + length - 1
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return Runs(codes[np.repeat(at[head], size) + inside], doc[head], start[head], count)


def deep_nodes(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, length: int, block: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The windows (numbers into ``at``) that share all their words with another one, in suffix order, and
    the number of the deep node that each is under. ``hashes`` are those of the words of ``codes``."""
    if len(at) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    key = windows(hashes, length, seed=1)[at]
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    maybe = np.zeros(len(by), dtype=bool)
    maybe[1:] |= same
    maybe[:-1] |= same
    by = by[maybe]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(key[by])) + 1, [len(by)]]) if len(by) else np.array([0])
    members, nodes, last, lo = [], [], 0, 0
    while lo < len(by):
        hi = int(bounds[max(np.searchsorted(bounds, lo + block, side="right") - 1, np.searchsorted(bounds, lo, side="right"))])
        part = by[lo:hi]
        rows = np.stack([codes[at[part] + k] for k in range(length)], 1)
        order = np.lexsort((*rows.T[::-1], key[part]))
        part, rows = part[order], rows[order]
        unlike = rows[1:] != rows[:-1]
        common = np.where(unlike.any(1), unlike.argmax(1), length)  # longest common prefix of neighbours
        deep = common >= length
        inside = np.zeros(len(part), dtype=bool)
        inside[1:] |= deep
        inside[:-1] |= deep
        node = last + np.concatenate([[0], np.cumsum(~deep)])
        members.append(part[inside])
        nodes.append(node[inside])
        last, lo = int(node[-1]) + 1, hi
    if not members:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    node = np.concatenate(nodes)
    return np.concatenate(members), np.unique(node, return_inverse=True)[1]


def late_windows(members: np.ndarray, node: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows under deep nodes: those that stand later than their node's first leaf, in (doc, start)
    order, and those that are the first leaf's place once more (rows that repeat a doc_id)."""
    order = np.lexsort((start[members], doc[members]))
    members, node = members[order], node[order]
    first = np.full(int(node.max()) + 1 if len(node) else 0, len(members), dtype=np.int64)
    np.minimum.at(first, node, np.arange(len(members)))
    head = members[first][node]
    late = (doc[members] != doc[head]) | (start[members] != start[head])
    return members[late], members[~late & (members != head)]


@dataclass(frozen=True)
class Prefixes:
    """How long the prefix is under each of the table's short prefixes, and where the groups go: ``depth`` bits
    in all, and suffixes before it."""

    bits: int
    depth: np.ndarray
    before: np.ndarray
    parts: int

    @classmethod
    def plan(cls, counts: np.ndarray, group: int, parts: int) -> Prefixes:
        bits = int(len(counts)).bit_length() - 1
        more = np.ceil(np.log2(np.maximum(counts / group, 1))).astype(np.int64)
        return cls(bits, np.minimum(bits + more, 63), np.concatenate([[0], np.cumsum(counts)]), parts)

    def of(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group (the prefix, left-aligned, which no other group begins with) and part of each path."""
        head = (path >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(path), dtype=np.int64)
        left = (64 - self.depth[head]).astype(np.uint64)
        prefix = np.where(left >= 64, np.uint64(0), (path >> np.minimum(left, np.uint64(63))) << np.minimum(left, np.uint64(63)))
        inside = (prefix << np.uint64(self.bits)).astype(np.float64) / 2.0**64
        place = self.before[head] + inside * (self.before[head + 1] - self.before[head])
        part = np.minimum(place * self.parts / max(1, self.before[-1]), self.parts - 1).astype(np.int32)
        return prefix.view(np.int64), part


def _by_doc(doc: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """doc_id and the upper halves of its anchors."""
    by = np.argsort(doc, kind="stable")
    doc, anchors = doc[by], (anchors[by] >> np.uint64(32)).astype("<u4")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else np.array([0])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(doc[lo]), anchors[lo:hi].tobytes()


def _anchors(length: int, anchor: int, bits: int):
    """Of each batch: anchors that it holds twice, by document (kind 0), and by group, the leading bits, each of
    its anchors once with a document that holds it (kind 1)."""

    def one(ids: list[int], texts: list[bytes]) -> pd.DataFrame:
        docs, found = [], []
        for first, last, hashes, offsets in hashed_words(texts):
            if len(hashes) < length:
                continue
            n = np.maximum(np.diff(offsets) - length + 1, 0)
            at = np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            short, reach = windows(hashes, anchor, seed=2), length - anchor + 1
            # A place is an anchor if it has the least hash of a window that covers it: each place counts,
            # also where a text repeats itself inside a window.
            least = np.zeros(len(short) + reach - 1, dtype=np.uint64)
            least[at + reach - 1] = _least(short, reach)[at]
            place = np.flatnonzero(~_least(~least, reach) == short)
            place = place[short[place] != 0]
            docs.append(np.repeat(np.arange(first, last), np.diff(offsets))[place])
            found.append(short[place])
        if not docs:
            return pd.DataFrame(columns=["kind", "grp", "doc_id", "data"])
        least, doc = np.concatenate(found), np.array(ids, dtype=np.int64)[np.concatenate(docs)]
        least, doc, twice = _met(least, doc)
        rows = [(0, d, d, data) for d, data in _by_doc(doc[twice], least[twice])]  # dealt out by doc_id
        head = np.ones(len(least), dtype=bool)
        head[1:] = least[1:] != least[:-1]
        least, doc = least[head], doc[head]
        group = (least >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(least), dtype=np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            rows.append((1, int(group[lo]), 0, least[lo:hi].astype("<u8").tobytes() + doc[lo:hi].astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["kind", "grp", "doc_id", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0
        for pdf in batches:
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                ids.append(doc_id)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= _BATCH_BYTES or len(ids) >= 60_000:
                    yield one(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield one(ids, texts)

    return run


def _met(least: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order with their documents, and which of them stand there more than once."""
    by = np.argsort(least, kind="stable")
    least, doc = least[by], doc[by]
    same = least[1:] == least[:-1]
    twice = np.zeros(len(least), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    return least, doc, twice


def _meet(chunk_bytes: int):
    """Rows sorted by group. Emits doc_id and those of its anchors that another batch holds as well. Between
    chunks of a group each anchor is held once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, size = None, [], 0

        def met(last: bool) -> Iterator[tuple[int, bytes]]:
            least, doc, twice = _met(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            yield from _by_doc(doc[twice], least[twice])
            held.clear()
            if not last:
                head = np.ones(len(least), dtype=bool)
                head[1:] = least[1:] != least[:-1]
                held.append((least[head], doc[head]))

        for pdf in batches:
            out = [(d, x) for kind, d, x in zip(pdf.kind, pdf.doc_id, pdf.data) if not kind]
            for kind, grp, data in zip(pdf.kind, pdf.grp, pdf.data):
                if not kind:
                    continue
                if group is not None and grp != group and held:
                    out += met(last=True)
                    size = 0
                elif size >= chunk_bytes:
                    out += met(last=False)
                    size = 0
                group, n = grp, len(data) // 16
                size += len(data)
                held.append((np.frombuffer(data, dtype="<u8", count=n), np.frombuffer(data, dtype="<i8", count=n, offset=8 * n)))
            yield pd.DataFrame(out, columns=["doc_id", "data"])
        if held:
            yield pd.DataFrame(list(met(last=True)), columns=["doc_id", "data"])

    return run


def pieces_of(text: bytes, length: int, size: int = _BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text with the place of the first: all at once or, of a very long text, in pieces that
    share ``length - 1`` words, so that each window lies in one."""
    if len(text) <= size:
        yield 0, text.split()
        return
    at, place, tail = 0, 0, []
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        words = tail + text[at:end].split()
        yield place, words
        tail = words[-(length - 1) :] if length > 1 else []
        place, at = place + len(words) - len(tail), end


def _batches(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[list[int], list[int], list[list[bytes]], list[np.ndarray]]]:
    """doc_id, place and words of the pieces of about _BATCH_BYTES of text, and the anchors that are met elsewhere."""
    ids: list[int] = []
    places: list[int] = []
    words: list[list[bytes]] = []
    wanted: list[np.ndarray] = []
    size = 0
    for pdf in batches:
        for doc_id, text, anchors in zip(pdf.doc_id, pdf.text, pdf.anchors):
            data = (text or "").encode()
            met = np.concatenate([np.frombuffer(a, dtype="<u4") for a in anchors])
            for place, piece in pieces_of(data, length):
                if len(piece) >= length:
                    ids.append(doc_id)
                    places.append(place)
                    words.append(piece)
                    wanted.append(met)
                size += min(len(data), _BATCH_BYTES)
                if size >= _BATCH_BYTES:
                    yield ids, places, words, wanted
                    ids, places, words, wanted, size = [], [], [], [], 0
    if ids:
        yield ids, places, words, wanted


def _first_leaves(ids: list[int], places: list[int], words: list[list[bytes]], wanted: list[np.ndarray], length: int, anchor: int):
    """Of a batch: its vocabulary and codes, those windows with a wanted anchor (place in codes, document,
    start, path) that are the first leaves of the batch's nodes, and the late ones as (document, start)."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    known = Words()
    sizes = np.array([len(words[k]) for k in order], dtype=np.int64)
    codes = known.number((w for k in order for w in words[k]), int(sizes.sum()))
    hashes = known.hashes()[codes]
    n = sizes - length + 1
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + inside
    least = _least(windows(hashes, anchor, seed=2), length - anchor + 1)[at]
    piece = np.repeat(np.arange(len(order)), n).astype(np.uint64)
    met = np.concatenate([wanted[k].astype(np.uint64) | np.uint64(p << 32) for p, k in enumerate(order)])
    mine = np.isin(piece << np.uint64(32) | least >> np.uint64(32), met)
    at, least = at[mine], least[mine]
    doc = np.repeat(np.array([ids[k] for k in order], dtype=np.int64), n)[mine]
    start = (np.repeat(np.array([places[k] for k in order], dtype=np.int64), n) + inside)[mine]
    gone, again = late_windows(*deep_nodes(codes, at, hashes, length), doc, start)
    keep = np.ones(len(at), dtype=bool)
    keep[gone] = False
    keep[again] = False
    first = windows(hashes, min(8, length), seed=3)[at[keep]]
    low = np.uint64(64 - _ANCHOR_BITS)
    path = ((least[keep] >> low) << low) | (first >> np.uint64(_ANCHOR_BITS))
    return list(known.codes), codes, (at[keep], doc[keep], start[keep], path), (doc[gone], start[gone])


def pack(vocabulary: list[bytes], runs: Runs) -> bytes:
    """Runs with the words that they use."""
    seen = np.zeros(len(vocabulary), dtype=bool)
    seen[runs.codes] = True
    used = np.flatnonzero(seen)
    place = np.zeros(len(vocabulary), dtype=np.uint32)
    place[used] = np.arange(len(used))
    kind = "<u2" if len(used) <= 65536 else "<u4"
    names = b" ".join([vocabulary[k] for k in used.tolist()])
    shape = np.array([len(used), len(names), len(runs.doc), len(runs.codes)], dtype="<u4").tobytes()
    light = np.diff(runs.doc, prepend=0).astype("<i8").tobytes() + runs.start.astype("<u4").tobytes() + runs.count.astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(shape + light + names + place[runs.codes].astype(kind).tobytes())


def unpack(data: bytes, known: Words) -> Runs:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n_words, n_bytes, n_runs, n_codes = np.frombuffer(raw, dtype="<u4", count=4).tolist()
    doc = np.cumsum(np.frombuffer(raw, dtype="<i8", count=n_runs, offset=16))
    start, count = np.frombuffer(raw, dtype="<u4", count=2 * n_runs, offset=16 + 8 * n_runs).astype(np.int64).reshape(2, n_runs)
    at = 16 + 16 * n_runs
    number = known.number(raw[at : at + n_bytes].split(b" "), n_words)
    return Runs(number[np.frombuffer(raw, dtype="<u2" if n_words <= 65536 else "<u4", count=n_codes, offset=at + n_bytes)], doc, start, count)


def _send(length: int, anchor: int, prefixes: Prefixes):
    """Of each batch: stretches known to stand earlier in the batch (kind 0), and by group the first
    leaves of the batch's nodes with their words (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(batches, length):
            vocabulary, codes, (at, doc, start, path), gone = _first_leaves(*batch, length, anchor)
            rows = [(0, d % prefixes.parts, 0, d, data) for d, data in _per_doc(*gone)]
            group, part = prefixes.of(path)
            by = np.argsort(group, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1, [len(by)]]) if len(by) else np.array([0])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = by[lo:hi]
                rows.append((1, int(part[own[0]]), int(group[own[0]]), 0, pack(vocabulary, runs_of(codes, at[own], doc[own], start[own], length))))
            for lo in range(0, len(rows), 500):
                yield pd.DataFrame(rows[lo : lo + 500], columns=["kind", "part", "grp", "doc_id", "data"])

    return run


class Subtree:
    """The deep nodes of one group, fed in chunks; between chunks it holds their first leaves only."""

    def __init__(self, length: int) -> None:
        self.length, self.words, self.held = length, Words(), None

    def feed(self, chunk: list[bytes], last: bool) -> Iterator[tuple[int, bytes]]:
        """doc_id and stretches of the windows that turn out to stand later than another one."""
        got = ([self.held] if self.held is not None else []) + [unpack(x, self.words) for x in chunk]
        runs = Runs(*(np.concatenate([getattr(r, f) for r in got]) for f in ("codes", "doc", "start", "count")))
        at, doc, start = runs.windows(self.length)
        late, again = late_windows(*deep_nodes(runs.codes, at, self.words.hashes()[runs.codes], self.length), doc, start)
        if not last:
            keep = np.ones(len(at), dtype=bool)
            keep[late] = False
            keep[again] = False
            self.held = runs_of(runs.codes, at[keep], doc[keep], start[keep], self.length)
        yield from _per_doc(doc[late], start[late])


def _packed(found: list[tuple[int, bytes]], buckets: int) -> pd.DataFrame:
    """A row a bucket of documents: their doc_ids, the sizes of their stretches and these."""
    by: dict[int, list[tuple[int, bytes]]] = {}
    for doc_id, data in found:
        by.setdefault(doc_id % buckets, []).append((doc_id, data))
    rows = [(b, np.array([d for d, _ in own], dtype="<i8").tobytes(), np.array([len(x) for _, x in own], dtype="<u4").tobytes(), b"".join(x for _, x in own)) for b, own in by.items()]
    return pd.DataFrame(rows, columns=["bucket", "ids", "sizes", "data"])


def _subtrees(length: int, buckets: int, chunk_bytes: int, most: int = 200_000):
    """Rows sorted by kind and group. Emits the stretches of windows that are not first leaves, packed by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, group, held, size = Subtree(length), None, [], 0
        out: list[tuple[int, bytes]] = []
        for pdf in batches:
            for kind, grp, doc_id, data in zip(pdf.kind, pdf.grp, pdf.doc_id, pdf.data):
                if not kind:
                    out.append((int(doc_id), data))
                else:
                    if group is not None and grp != group:
                        out += tree.feed(held, last=True)
                        tree, held, size = Subtree(length), [], 0
                    elif size >= chunk_bytes:
                        out += tree.feed(held, last=False)
                        held, size = [], 0
                    group = grp
                    held.append(data)
                    size += len(data)
                if len(out) >= most:
                    yield _packed(out, buckets)
                    out = []
        if held:
            out += tree.feed(held, last=True)
        if out:
            yield _packed(out, buckets)

    return run


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket. Emits a row a document with all its stretches."""
    bucket, held = None, {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"doc_id": list(held), "stretches": [[b"".join(x)] for x in held.values()]})

    for pdf in batches:
        for b, ids, sizes, data in zip(pdf.bucket, pdf.ids, pdf.sizes, pdf.data):
            if bucket is not None and b != bucket and held:
                yield rows()
                held = {}
            bucket, at = b, 0
            for doc_id, n in zip(np.frombuffer(ids, dtype="<i8").tolist(), np.frombuffer(sizes, dtype="<u4").tolist()):
                held.setdefault(doc_id, []).append(data[at : at + n])
                at += n
    if held:
        yield rows()


def repeated_stretches(docs: DataFrame, length: int = 20, anchor: int = 9, group: int = _GROUP, chunk_bytes: int = 32_000_000) -> DataFrame:
    """doc_id, stretches: arrays of (first, count) pairs (little-endian uint32) of the windows of each
    document that stand earlier too. Only documents with such windows have a row. ``group`` bounds the
    suffixes of a group, ``chunk_bytes`` what is read of one at a time."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(40, max(int(size / 6 / _WINDOWS_AN_ANCHOR / group).bit_length(), (4 * n).bit_length()))
    known = texts.mapInPandas(_anchors(length, anchor, bits), _ANCHORS)
    met = known.repartition(n, "grp").sortWithinPartitions("kind", "grp").mapInPandas(_meet(chunk_bytes), "doc_id long, data binary")
    met = stage(met.groupBy("doc_id").agg(F.collect_list("data").alias("anchors")), "anchors-met", batch_rows=64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(1 << _HEAD_BITS, dtype=np.int64)
        for pdf in batches:
            heads = [np.frombuffer(a, dtype="<u4") >> (32 - _HEAD_BITS) for row in pdf.anchors for a in row]
            found += np.bincount(np.concatenate(heads), minlength=len(found)) if heads else 0
        used = np.flatnonzero(found)
        yield pd.DataFrame({"head": used, "n": found[used]})

    heads = met.mapInPandas(count, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).toPandas()  # 65,536 rows at most
    counts = np.zeros(1 << _HEAD_BITS)
    counts[heads["head"].to_numpy(dtype=np.int64)] = heads["n"].to_numpy(dtype=np.int64) * _WINDOWS_AN_ANCHOR
    # Short prefixes are put together as long as the groups stay within bounds and are enough to deal out.
    while len(counts) > 1 and (counts[0::2] + counts[1::2]).max() <= group and len(counts) > 4 * n:
        counts = counts[0::2] + counts[1::2]
    prefixes = Prefixes.plan(counts, group, n)
    sent = texts.join(met, "doc_id").select("doc_id", "text", "anchors").mapInPandas(_send(length, anchor, prefixes), _PARTS)
    found = sent.repartitionById(n, F.col("part")).sortWithinPartitions("kind", "grp").mapInPandas(_subtrees(length, 4 * n, chunk_bytes // 4), "bucket long, ids binary, sizes binary, data binary")
    found = found.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_unpacked, "doc_id long, stretches array<binary>")
    return stage(found, "stretches", batch_rows=64)


def substring_dedup(docs: DataFrame, length: int = 20, **options: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), spans (removed word
    ranges [first, end) in order).

    A word is removed if a window of ``length`` words that covers it also stands in a smaller doc_id, or
    earlier in its document; windows are judged on the input. A null text has no words; texts shorter
    than a window lose nothing. Rows that repeat a doc_id are one place: they don't remove each other.
    Rows with a null doc_id are left out, other columns are not read. An empty table gives an empty
    result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                rows = []
                for doc_id, text, stretches in zip(pdf.doc_id.iloc[lo : lo + 500], pdf.text.iloc[lo : lo + 500], pdf.stretches.iloc[lo : lo + 500]):
                    words, spans = (text or "").encode().split(), []
                    if stretches is not None and len(stretches):
                        runs = np.concatenate([np.frombuffer(s, dtype="<u4").reshape(-1, 2) for s in stretches]).astype(np.int64)
                        runs = runs[np.argsort(runs[:, 0], kind="stable")]
                        for first, count in runs.tolist():
                            end = first + count + length - 1
                            if spans and first <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], end)
                            else:
                                spans.append([first, end])
                    kept, at = [], 0
                    for first, end in spans:
                        kept += words[at:first]
                        at = end
                    kept += words[at:]
                    rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"first": a, "end": b} for a, b in spans]))
                yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept", "spans"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    joined = texts.join(repeated_stretches(docs, length, **options), "doc_id", "left").select("doc_id", "text", "stretches")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,end:long>>")


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
