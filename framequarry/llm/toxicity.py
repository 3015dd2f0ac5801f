"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has four grades, 0 to 3. One weight vector is shared by the three ordered thresholds:
``P(grade <= k) = logistic(threshold_k - weights . features)``. Features are the distinct words and
word prefixes of a text, present or not, of which those that tell toxic labels apart most are used.
The output is the expected grade, and the chance of each.

Labels say only toxic or not. Training grades split toxic texts by the number of distinct
features which only toxic texts of the sample have: up to 4, up to 16, more.

The training sample is bounded: ``per_class`` labelled texts of each label by lowest hash of the id, and 64 MB
of each (``labelled_sample``).
Every text is scored whole. The chosen features (``n_features`` at most) travel with the function.

Defined cases: a null or empty text has no features and gets the grade of the thresholds alone;
repeated rows get the same grade each; without labels of both classes every text is grade 0; an
empty table gives an empty result; other columns are passed on and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import whole_text
from framequarry.llm.quality import labelled_sample

GRADES = 4
PREFIXES = (4, 5, 6)
CACHE = 1 << 18
TRAINING_CACHE = 1 << 14  # of the driver
LEAST = 12.0  # chi-square below which a feature may be chance
EDGE = b".,;:!?*#$%&|\"'()[]<>-"


class Model(NamedTuple):
    features: dict[bytes, int]  # a feature's place among the weights
    weights: np.ndarray
    thresholds: np.ndarray


def word_features(word: bytes) -> list[bytes]:
    """A word without punctuation at its ends, marked as whole, and its prefixes in bytes."""
    word = word.strip(EDGE)
    return [word + b"$"] + [word[:n] for n in PREFIXES if len(word) > n] if word else []


def text_features(text: str, known: dict[bytes, int] | None, cache: dict, most: int = CACHE) -> set:
    """Places of the known features of a text; with ``known`` None, all its features."""
    out: set = set()
    for word in set(text.encode("utf-8", "surrogatepass").lower().split()):
        found = cache.get(word)
        if found is None:
            parts = word_features(word)
            found = tuple(parts) if known is None else tuple(known[h] for h in parts if h in known)
            if len(cache) >= most:
                cache.clear()
            cache[word] = found
        if found:
            out.update(found)
    return out


def _choose(texts: list[str], y: np.ndarray, n_features: int) -> tuple[dict[bytes, int], list[np.ndarray], np.ndarray]:
    """The features with the largest chi-square excess in toxic texts, their places in each text, and each text's count of purely toxic ones.

    Features are counted as hashes in one sorted array; only those that may be chosen are spelled out.
    """
    cache: dict = {}
    hashed = []
    for t in texts:
        found = text_features(t, None, cache, TRAINING_CACHE)
        hashed.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
    all_hashes, inverse = np.unique(np.concatenate(hashed), return_inverse=True)
    toxic = np.repeat(y == 1, [len(h) for h in hashed])
    a, b = np.bincount(inverse[toxic], minlength=len(all_hashes)), np.bincount(inverse[~toxic], minlength=len(all_hashes))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    n, df = n1 + n0, a + b
    strength = (a - df * n1 / n) ** 2 / (df * (n - df) * n1 * n0 / n**3 + 1e-9)
    fit_for = np.flatnonzero((a >= 3) & (a / n1 > 2 * b / n0) & (strength >= LEAST))
    names = dict.fromkeys(all_hashes[fit_for].tolist(), b"")
    cache.clear()
    for t, h in zip(texts, hashed, strict=True):
        if np.isin(h, all_hashes[fit_for]).any():
            names.update((x, f) for f in text_features(t, None, cache, TRAINING_CACHE) if (x := xxhash.xxh64_intdigest(f)) in names)
    order = sorted(fit_for.tolist(), key=lambda i: (-strength[i], names[int(all_hashes[i])]))[:n_features]
    place = np.full(len(all_hashes), -1)
    place[order] = np.arange(len(order))
    pure = (place >= 0) & (b == 0)
    parts = np.split(inverse, np.cumsum([len(h) for h in hashed])[:-1])
    places = [np.sort(place[p][place[p] >= 0]) for p in parts]
    return {names[int(all_hashes[i])]: k for k, i in enumerate(order)}, places, np.array([int(pure[p].sum()) for p in parts])


def _fit(x, rows: int, columns: int, grade: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the cumulative-link likelihood; thresholds stay ordered as a first one plus positive gaps."""
    row, col = x
    w, free = np.zeros(columns), np.array([0.0, 0.0, 0.0])
    m, v = np.zeros(columns + 3), np.zeros(columns + 3)
    link = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        th = free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]
        eta = np.bincount(row, w[col], rows)
        edges = np.r_[-np.inf, th, np.inf]
        up, low = link(edges[grade + 1] - eta), link(edges[grade] - eta)
        up, low = np.where(grade == GRADES - 1, 1.0, up), np.where(grade == 0, 0.0, low)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_eta = -(d_up - d_low)
        g_th = np.array([d_up[grade == k].sum() - d_low[grade == k + 1].sum() for k in range(GRADES - 1)])
        gaps = np.exp(free[1:])
        g_free = np.array([g_th.sum(), gaps[0] * g_th[1:].sum(), gaps[1] * g_th[2]])
        g = np.r_[np.bincount(col, g_eta[row], columns) - ridge * w, g_free] / rows
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, free = w + step[:columns], free + step[columns:]
    return w, free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text", per_class: int = 2500, n_features: int = 4096, ridge: float = 0.05, steps: int = 400) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    rows, counts = labelled_sample(docs, labels, label, id_column, text, per_class)
    return fit(rows, counts, n_features, ridge, steps)


def fit(rows: list[tuple[str, int]], counts: dict[int, int], n_features: int = 4096, ridge: float = 0.05, steps: int = 400) -> Model:
    y = np.array([label for _, label in rows], int)
    if len(set(y.tolist())) < 2:
        return Model({}, np.zeros(0), np.array([30.0, 31.0, 32.0]))
    chosen, places, pure = _choose([t for t, _ in rows], y, n_features)
    grade = np.where(y == 1, 1 + (pure > 4) + (pure > 16), 0)
    row = np.repeat(np.arange(len(rows)), [len(p) for p in places])
    col = np.concatenate(places).astype(int)
    weights, thresholds = _fit((row, col), len(rows), max(1, len(chosen)), grade, ridge, steps)
    # The sample may hold more toxic texts than the corpus: move the thresholds by the difference of the log odds.
    shift = np.log(counts[0] / counts[1] * (y == 1).sum() / (y == 0).sum())
    return Model(chosen, weights, thresholds + shift)


def grade_chances(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Chance of each grade, one row per text."""
    below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - eta[:, None], -30, 30)))
    edges = np.column_stack([np.zeros(len(eta)), below, np.ones(len(eta))])
    return np.diff(edges, axis=1)


def toxicity(model: Model, text: str = "text") -> Column:
    """Struct of ``severity`` (expected grade), ``grade`` (likeliest) and ``toxic_chance`` (of any grade above 0)."""

    @F.pandas_udf("severity double, grade int, toxic_chance double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            eta = np.array([sum(model.weights[i] for i in sorted(text_features(t, model.features, cache))) for t in batch], float)
            p = grade_chances(eta, model.thresholds)
            yield pd.DataFrame({"severity": p @ np.arange(GRADES), "grade": p.argmax(1).astype("int32"), "toxic_chance": 1 - p[:, 0]})

    return score(whole_text(text))


def grade_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", limit: float = 0.3) -> DataFrame:
    """One row per document: id, ``severity``, ``grade``, ``toxic_chance`` and ``kept`` (chance below ``limit``)."""
    out = docs.select(F.col(id_column), toxicity(model, text).alias("t"))
    return out.select(id_column, "t.severity", "t.grade", "t.toxic_chance", (F.col("t.toxic_chance") < limit).alias("kept"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows that are not rejected, with the columns they came with."""
    return docs.filter(toxicity(model, text)["toxic_chance"] < limit)
