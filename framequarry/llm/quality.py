"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled good and bad texts. A text is compressed with
each; what the good dictionary saves over the bad one, relative to the two sizes, says which class it
resembles. A logistic curve fitted on labelled texts that built no dictionary turns that difference
(and how far the text shrinks at all, since runs of one word shrink alike under both) into a score.

The training sample is bounded: ``per_class`` labelled texts of each class by lowest hash of the id,
and ``max_bytes`` of text per class in that order. Every text is scored whole.

Defined cases: a null or empty text scores as an empty text does; repeated rows get the same score
each; without labels of both classes the score is the share of good labels, 0.5 if there are none;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.base import whole_text, written

LEVEL = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features, then the constant


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str, per_class: int, most_bytes: int = 64 << 20) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_class`` texts of each label 0 and 1, those whose id hashes lowest, and how many labels there are.

    Ids break ties. The join keeps the labels of ``docs`` only, and the sample is bounded, so it may be broadcast.
    A text with which those before it would have more than ``most_bytes`` bytes of a label together is left out before
    anything is brought to the driver. Ids are of any type that hashes.
    """
    ids = docs.select(F.col(id_column).alias("id")).filter("id is not null")
    known = labels.select(F.col(id_column).alias("id"), F.col(label).alias("y")).filter("y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = written(known.join(ids, "id", "left_semi"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("t"))
    sizes = texts.select("id", F.octet_length("t").cast("bigint").alias("size")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.max("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    fitting = written(sizes.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).select("id", "y"))
    rows = texts.join(F.broadcast(fitting), "id").groupBy("id", "y").agg(F.max("t").alias("t"))
    return [(r.t, r.y) for r in sorted(rows.collect(), key=lambda r: _shuffled(r.id))], counts


def _shuffled(ident) -> tuple:
    """Sort key that mixes the ids of the sample."""
    number = ident if isinstance(ident, int) else int.from_bytes(hashlib.sha256(str(ident).encode()).digest()[:8])
    return number * 0x9E3779B97F4A7C15 % 2**64, ident


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in (model.good, model.bad):
        known = zstandard.ZstdCompressionDict(data) if data else None
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
    return out


def _features(texts: list[str], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Normalised difference of the compressed sizes, and the logarithm of the shrinkage under each dictionary."""
    good, bad = compressors
    out = np.empty((len(texts), 3))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        a, b = len(good.compress(raw)), len(bad.compress(raw))
        out[i] = (b - a) / (a + b), np.log((a + 16) / (len(raw) + 16)), np.log((b + 16) / (len(raw) + 16))
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    """The features, the two squares of the shrinkage and a constant."""
    return np.column_stack([x * [10.0, 1.0, 1.0], x[:, 1:] ** 2, np.ones(len(x))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method, a step halved until the penalised likelihood grows; the ridge keeps separable classes finite."""
    value = lambda w: (y * (z := x @ w) - np.logaddexp(0, z)).sum() - ridge / 2 * w @ w
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while value(w + step) < value(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", per_class: int = 1500, max_bytes: int = 16 << 20, dictionary_bytes: int = 112_640) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``; pass only rows that may be learned from."""
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    held: dict[int, list[str]] = {0: [], 1: []}
    size = {0: 0, 1: 0}
    rows, counts = labelled_sample(docs, labels, label, id_column, text, per_class)
    for k, (t, y) in enumerate(rows):
        raw = t.encode("utf-8", "surrogatepass")
        if size[y] + len(raw) > max_bytes:
            continue
        size[y] += len(raw)
        if k % 2:
            held[y].append(t)
        else:
            parts[y].append(raw)
    share = (len(parts[1]) + len(held[1]) + 1) / (sum(map(len, parts.values())) + sum(map(len, held.values())) + 2)
    odds = float(np.log(share / (1 - share)))
    if not (held[0] and held[1] and parts[0] and parts[1]):
        return Model(b"", b"", (0.0, 0.0, 0.0, 0.0, 0.0, odds))
    good, bad = _dictionary(parts[1], dictionary_bytes), _dictionary(parts[0], dictionary_bytes)
    model = Model(good, bad, ())
    x = _squares(_features(held[0] + held[1], _compressors(model)))
    y = np.r_[np.zeros(len(held[0])), np.ones(len(held[1]))]
    weights = _logistic(x, y)
    weights[-1] += np.log(counts[1] / counts[0] * len(held[0]) / len(held[1]))  # the sample is even, the corpus is not
    return model._replace(weights=tuple(weights.tolist()))


def score_texts(texts: list[str], model: Model, compressors=None) -> np.ndarray:
    x = _squares(_features(texts, compressors or _compressors(model)))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def quality_score(model: Model, text: str = "text") -> Column:
    """Column from 0 to 1, higher where a label of 1 is likelier."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = _compressors(model)
        for batch in batches:
            yield pd.Series(score_texts(batch.tolist(), model, compressors))

    return score(whole_text(text))
