"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: its words in lower case, and the first four and five
letters of longer words, so that unseen inflections still meet a known stem. The score is

    sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>)

over its selected terms; the second sum holds pairs such as an insult with the mention of a group,
which a linear model over the same terms misses.

Training reads a bounded sample of labelled rows (``sample`` rows, those with the smallest seeded
hashes). Term statistics over the sample are made by Spark; at most ``terms`` terms with the highest
chi-square are kept, and the machine is fitted to the sample's rows over those terms on the driver.
Scoring reads every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 100_000


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the doc_id as text leaves no remainder by five."""
    return F.coalesce((F.crc32(F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long") % 5) == 0, F.lit(False))


def doc_held_out(doc_id: str = "doc_id") -> Column:
    return held_out(F.col(doc_id).cast("string"))


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def term_hashes(word: str) -> list[int]:
    """The signed 64-bit hashes of the terms of a word."""
    terms = ["w" + word] + [f"{n}{word[:n]}" for n in (4, 5) if len(word) > n]
    return [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in terms]


@dataclass
class FactorizationMachine:
    """Binary features 0..n-1; ``fit`` takes rows as one index array and row bounds."""

    factors: int = 8
    epochs: int = 30
    rate: float = 0.2
    l2: float = 1e-4
    batch: int = 512
    seed: int = 5

    def fit(self, n: int, index: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> FactorizationMachine:
        rng = np.random.default_rng(self.seed)
        # The start of the bias stays below one half: without a term nothing speaks against a text.
        share = min(max(labels.mean() if len(labels) else 0.0, 1e-3), 0.49)
        self.b = float(np.log(share / (1 - share)))
        self.w = np.zeros(n)
        self.v = rng.normal(0, 0.02, (n, self.factors))
        gw, gv = np.full(n, 1e-3), np.full((n, self.factors), 1e-3)
        for _ in range(self.epochs if len(labels) else 0):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), self.batch):
                rows = order[lo : lo + self.batch]
                sizes = bounds[rows + 1] - bounds[rows]
                local = np.repeat(np.arange(len(rows)), sizes)
                at = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                ids = index[at]
                z, s = self._margin(ids, local, len(rows))
                error = 1 / (1 + np.exp(-z)) - labels[rows]
                self.b -= 0.05 * error.mean()
                used, place = np.unique(ids, return_inverse=True)
                e = error[local]
                dw = np.bincount(place, e, len(used)) / len(rows) + self.l2 * self.w[used]
                dv = np.stack([np.bincount(place, e * (s[local, k] - self.v[ids, k]), len(used)) for k in range(self.factors)], 1) / len(rows) + self.l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= self.rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * self.rate * dv / np.sqrt(gv[used])
        return self

    def _margin(self, ids: np.ndarray, local: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[ids]
        s = np.stack([np.bincount(local, v[:, k], n) for k in range(self.factors)], 1)
        q = np.bincount(local, (v * v).sum(1), n)
        return self.b + np.bincount(local, self.w[ids], n) + 0.5 * ((s * s).sum(1) - q), s

    def predict(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        local = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return 1 / (1 + np.exp(-np.clip(self._margin(index, local, len(bounds) - 1)[0], -40, 40)))


@dataclass
class ToxicityModel:
    terms: dict[int, int]
    machine: FactorizationMachine
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def rows(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The selected terms of each text, as one index array and row bounds."""
        if self.name not in _KNOWN:  # workers live on: only the words of the latest model are kept
            _KNOWN.clear()
        known = _KNOWN.setdefault(self.name, {})
        found: list[int] = []
        bounds = [0]
        for text in texts:
            own: set[int] = set()
            for word in words_of(text):
                hit = known.get(word)
                if hit is None:
                    if len(known) >= _CACHE_WORDS:
                        known.clear()
                    hit = known[word] = tuple(self.terms[h] for h in term_hashes(word) if h in self.terms)
                own.update(hit)
            found += sorted(own)
            bounds.append(len(found))
        return np.array(found, dtype=np.int64), np.array(bounds, dtype=np.int64)


_KNOWN: dict[str, dict[str, tuple[int, ...]]] = {}


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cache: dict[str, list[int]] = {}
        hashes: list[int] = []
        labels: list[int] = []
        for text, toxic in zip(pdf.text, pdf.toxic):
            own: set[int] = set()
            for word in words_of(text):
                own.update(cache.get(word) or cache.setdefault(word, term_hashes(word)))
            hashes += own
            labels += [int(toxic)] * len(own)
        if hashes:
            term, place = np.unique(np.array(hashes, dtype=np.int64), return_inverse=True)
            yield pd.DataFrame({"term": term, "n": np.bincount(place), "n_toxic": np.bincount(place, labels).astype(np.int64)})


def train(docs: DataFrame, labels: DataFrame, sample: int = 24_000, terms: int = 2_048, min_docs: int = 3, min_chi2: float = 10.0, seed: int = 11) -> ToxicityModel:
    """Learn from rows of ``docs`` that ``labels`` marks and that are not held out.

    ``sample`` bounds the labelled rows used, ``terms`` the size of the model. A term needs ``min_docs``
    rows and a chi-square of ``min_chi2``, so that chance alone rarely selects one (one in 600 at 10);
    rarer toxic terms than that are not learned. Labels other than 0 and 1
    are ignored; of repeated labels the larger holds. Without labelled rows, or with one label only,
    the model can't tell texts apart and scores all alike, below one half.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~doc_held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_d"), "toxic")
    # At most ``sample`` rows of two numbers: that bound is what makes the broadcast safe.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_d")).select("doc_id", "text", "toxic")

    counts = rows.select("text", "toxic").mapInPandas(_term_counts, "term long, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic")).first()
    n, bad = int(total["n"]), int(total["n_toxic"])
    if not n or bad in (0, n):
        return ToxicityModel({}, FactorizationMachine(epochs=0).fit(0, np.array([], dtype=np.int64), np.zeros(n + 1, dtype=np.int64), np.zeros(n)))
    a, c = F.col("n_toxic"), F.col("n")
    gap = a.cast("double") * (n - bad) - (c - a).cast("double") * bad
    chi2 = gap * gap * n / (c.cast("double") * (n - c + 1e-9) * bad * (n - bad))
    top = counts.filter(c >= min_docs).withColumn("chi2", chi2).filter(F.col("chi2") >= min_chi2).orderBy(F.desc("chi2"), "term").limit(terms).select("term").toPandas()
    model = ToxicityModel({int(t): k for k, t in enumerate(sorted(top.term))}, FactorizationMachine())

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index, bounds = model.rows(pdf.text)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "toxic": pdf.toxic, "ids": [index[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]})

    seen = rows.mapInPandas(pick, "doc_id long, toxic int, ids binary").toPandas()
    seen["ids"] = [bytes(x) for x in seen.ids]
    seen = seen.sort_values(["doc_id", "toxic", "ids"])  # every row counts, also those without a selected term
    each = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in seen.ids]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    model.machine.fit(len(model.terms), np.concatenate(each) if each else np.array([], dtype=np.int64), bounds, seen.toxic.to_numpy(dtype=float))
    return model


def _predicted(model: ToxicityModel, texts: pd.Series, at_once: int = 512) -> np.ndarray:
    """Scores of a batch, ``at_once`` texts at a time, so that a worker holds the terms of so many only."""
    parts = [model.machine.predict(*model.rows(texts.iloc[k : k + at_once])) for k in range(0, len(texts), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for each row of ``docs``; a null or empty text has the score
    of no terms. A very long text is read whole. Each row is scored by itself, so equal texts have equal
    scores, repeated rows and rows with a null doc_id have rows of their own, and an empty table gives an
    empty result. Only doc_id and text are read, so other columns may have any name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = _predicted(model, pdf.text)
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""

    @F.pandas_udf("int")
    def predicted(texts: pd.Series) -> pd.Series:
        return pd.Series((_predicted(model, texts) >= 0.5).astype(np.int32))

    return docs.filter(predicted(F.col("text")) == 0)
