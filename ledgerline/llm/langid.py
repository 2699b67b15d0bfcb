"""Language identification: multinomial logistic regression over TF-IDF character n-grams, trained with FTRL-proximal.

Whole texts are lower-cased and their letters kept, other stretches becoming one blank; hashed n-grams of one to three
characters are counted. Document frequencies come from all rows that may be learned from, summed as vectors of fixed size. The
weights are fitted on a bounded sample of them (at most about ``sample`` rows a language), by follow-the-regularised-leader
with L1 and L2 penalties, and a temperature is then fitted on sample rows that the training has not seen.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; null languages and texts are not
learned from; without any row to learn from, every text is ``und``; a single language is predicted with score 1; repeated
rows get equal results, and equal texts of a language are in the sample once; texts of any length are read whole; a column
that is named as the result is replaced, and other columns, whatever their names, pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches

UNKNOWN = "und"
BITS = 15
SAMPLE = 1500
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letters(text: str | None) -> np.ndarray | None:
    """Code points of the lower-cased text with each stretch of other characters as one blank; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(points.max())
    if top < 0x250:  # Latin
        keep = _LATIN[points]
    else:
        known, inverse = np.unique(points, return_inverse=True)
        keep = np.array([chr(c).isalpha() for c in known])[inverse]
    if not keep.any():
        return None
    points = np.where(keep, points, 32)
    points = points[keep | np.concatenate([[False], keep[:-1]])]
    return np.concatenate([[32], points, [32]]).astype(np.uint32)


_LATIN = np.array([chr(c).isalpha() for c in range(0x250)])


def features(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams, as a dense vector."""
    points = letters(text)
    if points is None:
        return None
    shift = np.uint32(32 - bits)
    one = points * _MULTIPLIERS[0]
    two = (one[:-1] ^ (points[1:] * _MULTIPLIERS[1])) * _MULTIPLIERS[2]
    three = (two[:-1] ^ (points[2:] * _MULTIPLIERS[0])) * _MULTIPLIERS[1]
    return np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]), minlength=1 << bits)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        value = (1 + np.log(counts[at])) * self.idf[at]
        return at, value / max(np.linalg.norm(value), 1e-12)

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = features(text, int(np.log2(len(self.idf))))
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*self.vector(counts)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], model: LanguageModel, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> None:
    """FTRL-proximal over sparse rows (positions, values, language); the last position of the state is the bias."""
    size, n = model.weights.shape
    z, g2 = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, value, language = rows[k]
            at, value = np.append(at, size), np.append(value, 1.0)
            w = _weights(z[at], g2[at], alpha, beta, l1, l2)
            error = _softmax(value @ w)
            error[language] -= 1
            g = np.outer(value, error)
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha * w
            g2[at] += g * g
    w = _weights(z, g2, alpha, beta, l1, l2)
    model.weights, model.bias = w[:-1], w[-1]


def _weights(z: np.ndarray, g2: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))


def calibrate(rows: list[tuple[np.ndarray, np.ndarray, int]], model: LanguageModel) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    if not rows:
        return 1.0
    logits = np.array([model.logits(at, value) for at, value, _ in rows])
    truth = np.array([language for *_, language in rows])

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    low, high, ratio = np.log(0.2), np.log(5.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, sample: int = SAMPLE) -> LanguageModel:
    """A model of ``rows``, all of which may be learned from.

    The driver gets vectors of document frequencies (one, after a tree of sums) and the sample's sparse features; both are
    bounded by the parameters and the number of languages.
    """
    bounded_batches(rows.sparkSession)
    labelled = rows.select(rows[text].cast("string").alias("text"), rows[lang].cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    size = 1 << bits

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, langs = np.zeros(size, np.int64), 0, {}
        for batch in batches:
            for t, x in zip(batch["text"], batch["lang"], strict=True):
                counts = features(t, bits)
                if counts is not None:
                    df += counts > 0
                    n += 1
                    langs[x] = langs.get(x, 0) + 1
        yield pd.DataFrame({"df": [df.tobytes()], "n": [n], "langs": [list(langs)], "counts": [list(langs.values())]})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, langs = np.zeros(size, np.int64), 0, {}
        for batch in batches:
            for x in batch.itertuples():
                df += np.frombuffer(x.df, np.int64)
                n += x.n
                for k, c in zip(x.langs, x.counts, strict=True):
                    langs[k] = langs.get(k, 0) + int(c)
        yield pd.DataFrame({"df": [df.tobytes()], "n": [n], "langs": [list(langs)], "counts": [list(langs.values())]})

    vector = "df binary, n long, langs array<string>, counts array<long>"
    parts = labelled.mapInPandas(frequencies, vector).repartition(16).mapInPandas(summed, vector)
    total = next(summed(iter([parts.toPandas()])))
    df, n = np.frombuffer(total["df"][0], np.int64), int(total["n"][0])
    seen = dict(sorted(zip(total["langs"][0], total["counts"][0], strict=True)))
    languages = list(seen)
    model = LanguageModel(languages, np.log((1 + n) / (1 + df)) + 1, np.zeros((size, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    share = F.lit(0.0)
    for k, c in seen.items():
        share = F.when(F.col("lang") == k, F.lit(min(1.0, sample / c))).otherwise(share)
    # a text's hash decides, so the sample neither depends on tasks nor grows by copies
    chosen = labelled.filter(_unit(1) < share).dropDuplicates(["lang", "text"]).withColumn("later", _unit(2) < 0.2)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, x, later in zip(batch["text"], batch["lang"], batch["later"], strict=True):
                counts = features(t, bits)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((x, bool(later), at.astype(np.int32).tobytes(), counts[at].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "later", "at", "counts"])

    got = chosen.mapInPandas(sparse, "lang string, later boolean, at binary, counts binary").toPandas()
    got = got.sort_values(["at", "counts", "lang"], kind="stable")  # the order of training must not depend on tasks
    use: dict[bool, list] = {False: [], True: []}
    for x in got.itertuples():
        counts = np.zeros(size, np.int64)
        counts[np.frombuffer(x.at, np.int32)] = np.frombuffer(x.counts, np.int32)
        use[bool(x.later)].append((*model.vector(counts), languages.index(x.lang)))
    train(use[False] or use[True], model)
    model.temperature = calibrate(use[True], model)
    return model


def _unit(seed: int) -> Column:
    """A number from 0 to 1 that depends on the text alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("text")), 11).cast("double") / F.lit(float(1 << 53))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a column of (lang, score)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits x languages numbers

    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    # kept from being evaluated again by filters on its result
    predicted = F.pandas_udf(predict, "lang string, score double").asNondeterministic()
    return docs.withColumn(into, predicted(docs[text]))
