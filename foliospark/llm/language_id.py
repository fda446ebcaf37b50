"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every labelled text in numpy, sums them by language in Spark, and keeps smoothed
log probabilities as 32-bit fixed-point numbers. Scoring broadcasts that matrix (buckets x languages, bounded by
``MAX_CELLS``) and scores a batch of texts as one sparse product: n-gram indices, offsets per text, ``reduceat``.
Fixed-point sums are exact, so a score does not depend on batches, order or machine.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the first language in
code-point order; without any labelled text all are ``und``; repeated rows are judged alone; an empty table gives an
empty table; extra columns are ignored unless carried. Texts are walked in slices, so memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import materialise

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_CELLS = 1 << 25
SLICE = 1 << 16
SCALE = 1 << 20
UNKNOWN = "und"
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def ngrams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text, slice by slice; all characters but letters are one space."""
    for at in range(0, len(text), SLICE):
        piece = text[max(0, at - max(ORDERS) + 1) : at + SLICE].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where(_letter(code), code, np.uint32(32))
        if at == 0:
            code = np.concatenate([np.array([32], dtype=np.uint32), code])
        code = np.append(code, np.uint32(32)) if at + SLICE >= len(text) else code
        code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]
        found = []
        for n in ORDERS:
            if len(code) >= n:
                h = np.full(len(code) - n + 1, n * 0x165667B1 & 0xFFFFFFFF, dtype=np.uint32)
                for j in range(n):
                    h = (h ^ code[j : len(code) - n + 1 + j]) * _MULT[j]
                    h ^= h >> np.uint32(15)
                found.append(h & np.uint32(buckets - 1))
        if found:
            yield np.concatenate(found)


_ALPHA: np.ndarray | None = None


def _letter(code: np.ndarray) -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _ALPHA[code]


def train(df: DataFrame, text: str, label: str, buckets: int = BUCKETS, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, int64 of (language, bucket), from all rows whose label is not null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, t in zip(pdf["lang"], pdf["text"], strict=True):
                if t:
                    into = sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                    for ids in ngrams(t, buckets):
                        into += np.bincount(ids, minlength=buckets)
        for lang, n in sums.items():
            (at,) = np.nonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "n": n[at]})

    ship(df.sparkSession)
    labelled = df.where(F.col(label).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"))
    total = labelled.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total = materialise(total)
    while total.select("lang").distinct().count() * buckets > MAX_CELLS:  # the halves of a table of n-grams fall together
        buckets //= 2
        total = total.groupBy("lang", (F.col("bucket") % buckets).alias("bucket")).agg(F.sum("n").alias("n"))
    got = total.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).collect()
    langs = sorted(r["lang"] for r in got)
    counts = np.zeros((len(langs), buckets))
    for r in got:
        at = np.array([(x["bucket"], x["n"]) for x in r["x"]], dtype=np.int64)
        counts[langs.index(r["lang"]), at[:, 0]] = at[:, 1]
    logs = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * buckets))
    return langs, np.round(logs * SCALE).astype(np.int64)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """The carried columns, lang_pred and score: the winner's share of the probability per n-gram, 0 to 1."""
    langs, logs = model
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((langs, np.ascontiguousarray(logs.T.astype(np.int32))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, table = shared.value
        for pdf in batches:
            texts = pdf.pop("text__")
            sums, sizes = np.zeros((len(pdf), max(1, len(langs))), dtype=np.int64), np.zeros(len(pdf))
            letters = np.zeros(len(pdf), dtype=bool)
            pending, owners, held = [], [], 0

            def flush(sums=sums, pending=pending, owners=owners) -> None:
                if pending:
                    starts = np.cumsum([0, *map(len, pending[:-1])])
                    ids = np.concatenate(pending)
                    for k in range(len(langs)):
                        np.add.at(sums[:, k], owners, np.add.reduceat(table[ids, k], starts, dtype=np.int64))
                    pending.clear()
                    owners.clear()

            for i, t in enumerate(texts):
                if t and langs:
                    for ids in ngrams(t, len(table)):
                        pending.append(ids)
                        owners.append(i)
                        sizes[i] += len(ids)
                        held += len(ids)
                    letters[i] = any(c.isalpha() for c in t)
                    if held > 1 << 20:
                        flush()
                        held = 0
            flush()
            best = sums.argmax(axis=1)
            # tempered to the mean per n-gram times 8, so that long texts do not all score 1
            mean = (sums - sums.max(axis=1, keepdims=True)) / SCALE / np.maximum(sizes, 1)[:, None] * 8
            share = 1 / np.exp(mean).sum(axis=1)
            names = np.array([*langs, UNKNOWN], dtype=object)
            yield pdf.assign(lang_pred=names[np.where(letters, best, len(langs))], score=np.where(letters, share, 0.0))

    kept = df.select(*carry, F.col(text).alias("text__"))
    schema = kept.drop("text__").schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInPandas(score, schema)
