"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are presences of hashed character n-grams (words with their borders). Training counts, by class, the texts
that hold each n-gram, keeps the n-grams whose log-count ratio is significant, scales their presences by the ratio and
fits a logistic regression. Scoring looks hashed n-grams up in one broadcast table of fixed size.

Bounds: the model is fitted on about ``sample`` labelled texts at most, chosen by a hash of the id, on the ``features``
n-grams of the greatest significance (ties: the lesser bucket) that at least ``least`` texts of class 1 hold, in ``steps``
steps; all are parameters of ``train``. The hash has ``BUCKETS`` values, a constant. Every text is scored whole, by all
its n-grams, however long it is: slices of ``SLICE`` characters bound the memory.

Defined results: null and empty texts score what the intercept gives; without both classes in the labels all score 0;
several labels of a text are so many training rows; rows with null labels are not used; repeated rows are scored alone;
an empty table gives an empty table; extra columns are ignored unless carried; a carried column
must not be named score or predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import materialise

BUCKETS = 1 << 20
ORDERS = (3, 4, 5, 6)
#: Texts of class 1 that must hold an n-gram, n-grams kept at most, labelled texts at most, steps of the fit.
LEAST, FEATURES, SAMPLE, STEPS = 3, 8192, 20_000, 400
SLICE = 1 << 16
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    slot: np.ndarray  # int32 of BUCKETS: the feature of a bucket, or -1
    weight: np.ndarray  # float64 of features: regression weight times log-count ratio
    bias: float


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of the lower-cased text, slice by slice, repeats included."""
    for at in range(0, len(text), SLICE):
        piece = text[max(0, at - max(ORDERS) + 1) : at + SLICE].lower()
        code = np.frombuffer((" " * (at == 0) + piece + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where(code < 48, np.uint32(32), code)  # white space and most marks border words
        for n in ORDERS:
            m = len(code) - n + 1
            if m > 0:
                h = np.full(m, (n * 0x2545F491) & 0xFFFFFFFF, dtype=np.uint32)
                for j in range(n):
                    h = (h ^ code[j : m + j]) * _MULT[j]
                    h ^= h >> np.uint32(15)
                yield h & np.uint32(BUCKETS - 1)


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, seen, texts = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(BUCKETS, dtype=bool), np.zeros(2, dtype=np.int64)
    for pdf in batches:
        for y, t in zip(pdf["y"], pdf["text"], strict=True):
            for ids in ngrams(t or ""):
                seen[ids] = True
            (at,) = np.nonzero(seen)
            counts[y, at] += 1
            texts[y] += 1
            seen[at] = False
    (at,) = np.nonzero(counts.sum(axis=0))
    yield pd.DataFrame({"b": at.astype("int32"), "c0": counts[0, at], "c1": counts[1, at]})
    yield pd.DataFrame({"b": np.array([-1], dtype="int32"), "c0": texts[:1], "c1": texts[1:]})


def _present(text: str, slot: np.ndarray) -> np.ndarray:
    found = [s[s >= 0] for s in (slot[ids] for ids in ngrams(text))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


def _fit(cols: np.ndarray, sizes: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent on present features (cols, row after row; sizes by row).

    A presence is scaled by its feature's ratio, so two index arrays, by row and by feature, are all that is held.
    """
    n, some = len(sizes), sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    by_col = np.argsort(cols, kind="stable").astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[by_col]
    counts = np.bincount(cols, minlength=len(ratio))
    used = counts > 0
    col_starts = (np.cumsum(counts) - counts)[used]

    def per_row(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(starts):
            out[some] = np.add.reduceat(v[cols], starts)
        return out

    def per_feature(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ratio))
        if len(col_starts):
            out[used] = np.add.reduceat(v[owner], col_starts)
        return out

    rate = 8.0 / (0.25 * (per_row(ratio * ratio).max() + 1) + l2)
    w, b, w0, b0 = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    for k in range(steps):
        vw, vb = w + (k / (k + 3)) * (w - w0), b + (k / (k + 3)) * (b - b0)
        e = 1 / (1 + np.exp(-np.clip(per_row(ratio * vw) + vb, -30, 30))) - y
        w0, b0 = w, b
        w = vw - rate * (ratio * per_feature(e) / n + l2 * vw)
        b = vb - rate * e.mean()
    return w, b


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, z_least: float = 4.0, l2: float = 1e-4, least: int = LEAST, features: int = FEATURES, steps: int = STEPS) -> Model:
    """labels: (id, label 0/1) rows to learn from."""
    ship(df.sparkSession)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
    n = rows.count()
    part = F.crc32(F.concat(F.lit("sample:"), F.col("i").cast("string")).cast("binary")) < int(min(1.0, sample / max(n, 1)) * 2**32)
    chosen = F.broadcast(rows.where(part))  # about `sample` rows of two numbers, whatever the input
    texts = materialise(df.select(F.col(id_col).alias("i"), F.col(text).alias("text")).join(chosen, "i").select("i", "y", "text"))
    counts = texts.mapInPandas(_class_counts, "b int, c0 long, c1 long").groupBy("b").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    counts = counts.where((F.col("b") < 0) | (F.col("c1") >= least)).toPandas()  # buckets, at most
    size = counts[counts.b < 0]
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    if not len(size) or not size.c0.sum() or not size.c1.sum():
        return Model(slot, np.zeros(0), -np.inf)
    c, n0, n1 = counts[counts.b >= 0], int(size.c0.iloc[0]), int(size.c1.iloc[0])
    ratio = np.log((c.c1 + 0.5) / (n1 + 1)) - np.log((c.c0 + 0.5) / (n0 + 1))
    z = ratio / np.sqrt(1 / (c.c1 + 0.5) + 1 / (c.c0 + 0.5))
    best = c.assign(r=ratio, z=z.abs()).query("z >= @z_least").sort_values(["z", "b"], ascending=[False, True]).head(features)
    slot[best.b] = np.arange(len(best), dtype=np.int32)
    shared = df.sparkSession.sparkContext.broadcast(slot)
    kind = np.uint16 if features <= 1 << 16 else np.int32

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [_present(t or "", shared.value) for t in pdf["text"]]
            packed = [pdf["i"].to_numpy(dtype=np.int64), pdf["y"].to_numpy(dtype=np.int8), np.array([len(v) for v in x], dtype=np.int32), np.concatenate([*x, np.zeros(0, dtype=np.int32)]).astype(kind)]
            yield pd.DataFrame([[v.tobytes() for v in packed]], columns=["i", "y", "n", "x"])

    parts = texts.mapInPandas(rows_of, "i binary, y binary, n binary, x binary").collect()  # of the sample: two bytes a feature, or four
    ids, y, sizes, cols = (np.concatenate([np.frombuffer(p[k], dtype=t) for p in parts]) for k, t in enumerate((np.int64, np.int8, np.int32, kind)))
    del parts
    order = np.lexsort((sizes, y, ids))  # sums in one order: reruns agree
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    cols = np.concatenate([*(cols[first[k] : first[k] + sizes[k]] for k in order), np.zeros(0, dtype=kind)]).astype(np.int32)
    r = best.r.to_numpy()
    w, b = _fit(cols, sizes[order].astype(np.int64), y[order].astype(float), r, l2, steps)
    return Model(slot, w * r, b)


def score(df: DataFrame, model: Model, text: str = "text", carry: tuple[Column, ...] = (), threshold: float = 0.3) -> DataFrame:
    """The carried columns, score (0 to 1, rounded to 9 places) and predicted (1 where score >= threshold)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            z = np.array([m.bias + m.weight[_present(t or "", m.slot)].sum() for t in pdf.pop("text__")], dtype=float)
            p = np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9)
            yield pdf.assign(score=p, predicted=(p >= threshold).astype("int32"))

    kept = df.select(*carry, F.col(text).alias("text__"))
    return kept.mapInPandas(run, kept.drop("text__").schema.add("score", "double").add("predicted", "integer"))
