"""Quality classifier: ordinal cumulative-link regression over hashed text.

Grades 0 < 1 < ... < K - 1 share one weight vector; ordered thresholds cut its score:

    P(grade <= k) = sigmoid(theta_k - s),   s = sum_f w_f x_f,   theta_0 < theta_1 < ...

Features are hashed: each word and its shape (runs of lower case, upper case, digits and marks), as a
share of the text's words, and buckets of a few whole-text measures (length, share of repeated lines and
of repeated words). From the grade probabilities follow the expected grade and the tail probability
P(grade >= good), by which documents are selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import doc_held_out

_BITS = 16
_MASK = (1 << _BITS) - 1
_SHAPE = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "AA"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"\d+"), "9"))
_CACHE_WORDS = 300_000
_SEEN: dict[str, tuple[int, int]] = {}


def _hash(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "replace")) & _MASK


def _word(word: str) -> tuple[int, int]:
    found = _SEEN.get(word)
    if found is None:
        shape = word
        for pattern, to in _SHAPE:
            shape = pattern.sub(to, shape)
        if len(_SEEN) >= _CACHE_WORDS:
            _SEEN.clear()
        found = _SEEN[word] = (_hash("w" + word.lower()), _hash("s" + shape))
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and values of a text; a null text is empty."""
    words = text.split() if text else []
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()] if text else []
    counts = Counter(words)
    ids, values = [], []
    for word, c in counts.items():
        a, b = _word(word)
        ids += (a, b)
        values += (3.0 * c / n, 10.0 * c / n)
    buckets = (("len", n.bit_length()), ("lines", round(10 * (1 - len(set(lines)) / max(1, len(lines))))), ("words", round(10 * (1 - len(counts) / max(1, n)))))
    for name, at in buckets:
        ids.append(_hash(f"b{name}:{at}"))
        values.append(1.0)
    return np.array(ids, dtype=np.int64), np.array(values)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) by row."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))
        below = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], 1)
        return np.diff(below, axis=1)

    def score(self, texts: pd.Series) -> np.ndarray:
        found = (features(t) for t in texts)
        return np.array([float(self.weights[i] @ v) for i, v in found])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, count: int, epochs: int = 20, rate: float = 0.1, l2: float = 1e-5, seed: int = 9) -> OrdinalModel:
    """Maximum likelihood by Adagrad; the gaps between thresholds are exponentials, so they stay ordered."""
    share = np.clip(np.cumsum(np.bincount(grades, minlength=count))[:-1] / max(1, len(grades)), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(count - 1))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    model = OrdinalModel(np.zeros(1 << _BITS), start)
    gw, gf = np.full(1 << _BITS, 1e-3), np.full(len(free), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            sizes = [len(rows[k][0]) for k in part]
            ids, values = np.concatenate([rows[k][0] for k in part]), np.concatenate([rows[k][1] for k in part])
            local = np.repeat(np.arange(len(part)), sizes)
            s = np.bincount(local, model.weights[ids] * values, len(part))
            y = grades[part]
            theta = np.concatenate([[-np.inf], model.thresholds, [np.inf]])
            up, down = 1 / (1 + np.exp(-np.clip(theta[y + 1] - s, -40, 40))), 1 / (1 + np.exp(-np.clip(theta[y] - s, -40, 40)))
            p = np.maximum(up - down, 1e-9)
            slope_up, slope_down = up * (1 - up) / p, down * (1 - down) / p
            error = slope_up - slope_down  # d(-log p) / ds
            used, place = np.unique(ids, return_inverse=True)
            g = np.bincount(place, error[local] * values, len(used)) / len(part) + l2 * model.weights[used]
            gw[used] += g * g
            model.weights[used] -= rate * g / np.sqrt(gw[used])
            d = np.zeros(count + 1)
            np.add.at(d, y + 1, -slope_up)
            np.add.at(d, y, slope_down)
            d = d[1:count] / len(part)
            f = np.array([d[k:].sum() * (1 if k == 0 else np.exp(free[k])) for k in range(len(free))])
            gf += f * f
            free -= rate * f / np.sqrt(gf)
            model.thresholds = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
    return model


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", sample: int = 12_000, seed: int = 13) -> OrdinalModel:
    """Learn from labelled documents that are not held out; at most ``sample`` of them, those with the
    least seeded hashes. Grades are whole numbers from 0; of repeated labels the largest holds; null and
    negative grades are ignored. Without labels the model has one threshold and gives every text 0.5."""
    marked = labels.filter(F.col(grade).isNotNull() & (F.col(grade) >= 0) & F.col("doc_id").isNotNull() & ~doc_held_out())
    marked = marked.groupBy(F.col("doc_id").alias("_d")).agg(F.max(grade).cast("int").alias("grade"))
    chosen = marked.orderBy(F.xxhash64(F.lit(seed), "_d"), "_d").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_d")).select("doc_id", "text", "grade")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "grade": pdf.grade, "ids": [i.astype("<u2").tobytes() for i, _ in found], "vals": [v.astype("<f4").tobytes() for _, v in found]})

    # The bound on the sample bounds what the driver gets: about 6 bytes a distinct word.
    seen = rows.mapInPandas(pack, "doc_id long, grade int, ids binary, vals binary").toPandas().sort_values(["doc_id", "grade"])
    unpacked = [(np.frombuffer(i, dtype="<u2").astype(np.int64), np.frombuffer(v, dtype="<f4").astype(float)) for i, v in zip(seen.ids, seen.vals)]
    grades = seen.grade.to_numpy(dtype=np.int64)
    return fit(unpacked, grades, max(2, int(grades.max()) + 1 if len(grades) else 2))


def score(docs: DataFrame, model: OrdinalModel, good: int = 1, at_least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good = P(grade >= good), keep (p_good >= at_least) for each row; null and
    empty texts have the score of no words. A very long text is read whole. Each row is scored by itself, so
    equal texts have equal scores, repeated rows and rows with a null doc_id have rows of their own, and an
    empty table gives an empty result. Only doc_id and text are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = model.probabilities(model.score(pdf.text))
            tail = p[:, good:].sum(1)
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "expected_grade": p @ np.arange(p.shape[1]), "p_good": tail, "keep": tail >= at_least})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, expected_grade double, p_good double, keep boolean")
