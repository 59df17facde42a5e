"""Language identification of words by a linear-chain conditional random field.

A text is a sequence of words (ASCII white space apart), in lower case. The score of labels y is

    sum_t  weights(word_t) . y_t  +  sum_t  T[y_{t-1}, y_t]

where a word's features are hashed: its two-, three- and four-byte grams with marks at both ends (those
at the ends are its affixes) in one space, and the word itself (the lexicon) in another. Forward-backward gives each word's
posterior over languages, so a switch inside a text costs one transition and the words around it decide
where it is. A document's language is the one with the greatest mean posterior over its words that
have letters; that mean is the score.

Training reads a bounded sample of labelled documents, and of each a few short runs of words from
anywhere in its whole text, drawn where the text is; only those come to the driver. Sequences are put
together from runs of different documents, so transitions between languages are seen and learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import doc_held_out

_BITS, _LEXICON = 18, 17
_LONGEST = 100
_U = np.uint64


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word as one array and its bounds (every word has at least one)."""
    parts = [w.encode("utf-8", "replace") for w in words]
    size = np.array([len(p) for p in parts], dtype=np.int64) + 2
    data = np.frombuffer(b"".join(b"\x02" + p + b"\x03" for p in parts), dtype=np.uint8).astype(_U)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(parts)), size)
    left = np.repeat(first + size, size) - np.arange(len(data))  # bytes from here to the word's end
    found, owners = [], []
    with np.errstate(over="ignore"):
        code = data.copy()
        for n in (2, 3, 4):
            code = code[: max(0, len(data) - n + 1)] | (data[n - 1 :] << _U(8 * (n - 1)))
            ok = left[: len(code)] >= n
            found.append(((code[ok] * _U(0x9E3779B97F4A7C15) + _U(n) * _U(0xC2B2AE3D27D4EB4F)) * _U(0xD6E8FEB86659FD93)) >> _U(64 - _BITS))
            owners.append(owner[: len(code)][ok])
        whole = np.zeros(len(parts), dtype=_U)
        power = np.arange(len(data), dtype=np.int64) - np.repeat(first, size)
        rolled = (data + _U(1)) * (_U(0x100000001B3) ** (power % 61).astype(_U)) + power.astype(_U) * data
        if len(parts):
            whole = np.add.reduceat(rolled, first)
        found.append(((whole * _U(0xD6E8FEB86659FD93)) >> _U(64 - _LEXICON)) + _U(1 << _BITS))
        owners.append(np.arange(len(parts)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    features = np.concatenate(found).astype(np.int64)[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owners), minlength=len(parts)))])
    return features, bounds


@dataclass
class WordCRF:
    languages: list[str]
    weights: np.ndarray  # (2**_BITS + 2**_LEXICON, L)
    trans: np.ndarray  # (L, L)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), dtype=np.float32)
        for lo in range(0, len(words), 20_000):
            features, bounds = _grams(words[lo : lo + 20_000])
            scale = np.diff(bounds)[:, None].astype(np.float32) ** 0.5
            out[lo : lo + 20_000] = np.add.reduceat(self.weights[features], bounds[:-1], axis=0) / scale
        return out

    def passes(self, emission: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward messages and the words' own factors, each up to a factor a word, over many
        sequences side by side; longest first, so that at each step those still running are a leading slice."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        begin, size = bounds[:-1][order], size[order]
        e = np.exp(emission - emission.max(1, keepdims=True)) + 1e-12
        move = np.exp(self.trans - self.trans.max()).astype(e.dtype)
        forward, backward = np.empty_like(e), np.empty_like(e)
        longest = int(size[0]) if len(size) else 0
        running = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        alpha = None
        for t in range(longest):
            at = begin[: running[t]] + t
            alpha = e[at] if t == 0 else (alpha[: running[t]] @ move) * e[at]
            alpha /= alpha.sum(1, keepdims=True)
            forward[at] = alpha
        beta = np.ones((0, e.shape[1]), dtype=e.dtype)
        for t in range(longest - 1, -1, -1):
            at = begin[: running[t]] + t
            grown = np.ones((running[t], e.shape[1]), dtype=e.dtype)
            if len(beta):
                grown[: len(beta)] = (beta * e[at[: len(beta)] + 1]) @ move.T
                grown /= grown.sum(1, keepdims=True)
            backward[at] = grown
            beta = grown
        return forward, backward, e

    def posteriors(self, emission: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each word, the probability of each language given the whole sequence."""
        forward, backward, _ = self.passes(emission, bounds)
        forward *= backward
        return forward / forward.sum(1, keepdims=True)

    def pair_posteriors(self, forward: np.ndarray, backward: np.ndarray, e: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of the words t, the probability of each pair of languages of the word before and the word."""
        pair = forward[t - 1][:, :, None] * np.exp(self.trans - self.trans.max())[None] * (e[t] * backward[t])[:, None, :]
        return pair / pair.sum((1, 2), keepdims=True)


def _fit(sequences: list[list[str]], labels: list[list[int]], languages: list[str], epochs: int, rate: float, l2: float, seed: int) -> WordCRF:
    """Maximum likelihood by Adagrad over batches of sequences of equal length."""
    count = len(languages)
    model = WordCRF(languages, np.zeros(((1 << _BITS) + (1 << _LEXICON), count), dtype=np.float32), np.zeros((count, count)))
    grad_w, grad_t = np.full(model.weights.shape, 1e-3, dtype=np.float32), np.full((count, count), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            words = [w for k in batch for w in sequences[k]]
            y = np.concatenate([labels[k] for k in batch])
            bounds = np.concatenate([[0], np.cumsum([len(sequences[k]) for k in batch])])
            features, cuts = _grams(words)
            scale = np.diff(cuts)[:, None].astype(np.float32) ** 0.5
            emission = np.add.reduceat(model.weights[features], cuts[:-1], axis=0) / scale
            forward, backward, e = model.passes(emission, bounds)
            error = forward * backward
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(y)), y] -= 1
            inner = np.ones(len(y), dtype=bool)
            inner[bounds[:-1]] = False
            t = np.flatnonzero(inner)
            gap = model.pair_posteriors(forward, backward, e, t).sum(0)
            np.subtract.at(gap, (y[t - 1], y[t]), 1)
            gap = gap / len(y) + l2 * model.trans
            grad_t += gap * gap
            model.trans -= rate * gap / np.sqrt(grad_t)
            used, place = np.unique(features, return_inverse=True)
            each = np.repeat(error / scale, np.diff(cuts), axis=0)
            step = np.stack([np.bincount(place, each[:, k], len(used)) for k in range(count)], 1) / len(batch) + l2 * model.weights[used]
            grad_w[used] += step * step
            model.weights[used] -= rate * step / np.sqrt(grad_w[used])
    return model


def _runs(seed: int, each: int, run_words: int):
    """Of each text, ``each`` runs of at most ``run_words`` words from places drawn by the seed and the doc_id, without
    words of over 100 characters. A text without a letter gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, lang in zip(pdf.doc_id, pdf.text, pdf.lang):
                words = text.lower().split()
                rng = np.random.default_rng([seed, int(doc_id) & (2**63 - 1)])
                for k in range(each):
                    at = int(rng.integers(max(1, len(words) - run_words + 1)))
                    own = [w for w in words[at : at + run_words] if len(w) <= _LONGEST]
                    if any(c.isalpha() for w in own for c in w):
                        rows.append((doc_id, k, lang, " ".join(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "lang", "words"])

    return run


def train(docs: DataFrame, sample: int = 4_000, sequences: int = 4_000, run_words: int = 24, runs: int = 5, each: int = 6, epochs: int = 3, seed: int = 7) -> WordCRF:
    """Learn from text and non-null lang of documents that are not held out; at most ``sample`` doc_ids,
    those with the least seeded hashes. ``each`` runs of ``run_words`` words come from anywhere in the
    whole text of each; ``sequences`` sequences are made of ``runs`` of them. So the driver gets at most
    ``sample * each`` runs, whatever the texts' length. Rows that repeat a doc_id give runs of their own.
    Without labelled words, or on an empty table, the model has no languages."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~doc_held_out())
    keys = rows.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    # At most ``sample`` numbers are broadcast.
    picked = rows.join(F.broadcast(keys), "doc_id", "left_semi").select(F.col("doc_id").cast("long"), "text", "lang")
    picked = picked.mapInPandas(_runs(seed, each, run_words), "doc_id long, k int, lang string, words string").dropDuplicates(["lang", "words"]).toPandas()
    picked = picked.sort_values(["lang", "doc_id", "k", "words"])
    languages = sorted(set(picked.lang))
    rng = np.random.default_rng(seed)
    by = {g: [w.split(" ") for w in own.words] for g, own in picked.groupby("lang")}
    drawn, labels = [], []
    for _ in range(sequences if languages else 0):
        words: list[str] = []
        marks: list[int] = []
        for _ in range(runs):
            k = int(rng.integers(len(languages)))
            run = by[languages[k]][int(rng.integers(len(by[languages[k]])))]
            words += run
            marks += [k] * len(run)
        drawn.append(words)
        labels.append(marks)
    return _fit(drawn, labels, languages, epochs, 0.5, 1e-6, seed)


def predict(docs: DataFrame, model: WordCRF) -> DataFrame:
    """doc_id, lang_pred, score for each row. A null text, or one without a letter, is ``und`` with score 0.
    A very long text is read whole, as one sequence. Of languages with equal means the first by name is
    given. Each row is judged by itself, so repeated rows and rows with a null doc_id have rows of their
    own; an empty table gives an empty result, and a model without languages gives ``und``. Only doc_id
    and text are read."""

    def some(texts: list[str | None]) -> tuple[list[str], list[float]]:
        known: dict[str, int] = {}
        ids, sizes = [], []
        for text in texts:
            words = text.lower().split() if text else []
            ids.append([known.setdefault(w, len(known)) for w in words])
            sizes.append(len(words))
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known or not model.languages:
            return names, scores
        unique = list(known)
        letters = np.array([any(c.isalpha() for c in w) if not w.isalpha() else True for w in unique])
        at = np.fromiter((k for x in ids for k in x), dtype=np.int64, count=sum(sizes))
        emission = model.emissions(unique)[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        filled = np.flatnonzero(np.diff(bounds))
        p = model.posteriors(emission, np.concatenate([bounds[:-1][filled], [bounds[-1]]]))
        p *= letters[at][:, None]
        total = np.add.reduceat(p, bounds[:-1][filled], axis=0)
        n = np.add.reduceat(letters[at].astype(float), bounds[:-1][filled])
        for row, doc in enumerate(filled.tolist()):
            if n[row]:
                best = int(total[row].argmax())
                names[doc], scores[doc] = model.languages[best], float(min(1.0, total[row, best] / n[row]))
        return names, scores

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, lo = pdf.text.tolist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < 8_000_000):
                    size += len(texts[hi] or "")
                    hi += 1
                names, scores = some(texts[lo:hi])
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[lo:hi].astype("Int64"), "lang_pred": names, "score": scores})
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def label_words(model: WordCRF, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its most probable language and that posterior."""
    words = text.lower().split()
    if not words or not model.languages:
        return []
    p = model.posteriors(model.emissions(words), np.array([0, len(words)]))
    return [(w, model.languages[int(row.argmax())], float(row.max())) for w, row in zip(text.split(), p)]
