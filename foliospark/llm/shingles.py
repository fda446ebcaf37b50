"""Hashed words and word shingles in numpy, and a filter of row ids; shared by the two operators on passages."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once.
SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, x % (1 << 64), dtype=np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between spaces: polynomials of their bytes, from prefix sums over slices of whole words."""
    out, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.rfind(b" ", at, at + SLICE) + 1
        if end <= at:  # a word longer than a slice
            end = data.find(b" ", at + SLICE) + 1 or len(data)
        part = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        edge = np.diff(np.r_[False, part != 32, False].view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        powers, back = _powers(SLICE) if len(part) <= SLICE else _powers.__wrapped__(len(part))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[part] * powers[: len(part)])])
        out.append(mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out)


class WordHash:
    """64-bit hashes of words, which hold no space."""

    def of(self, found: list[bytes]) -> np.ndarray:
        return word_hashes(b" ".join(found))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)


def occurrences(g: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    count = np.zeros(len(g), dtype=np.uint64)
    in_order = np.sort(g)
    if not (in_order[1:] == in_order[:-1]).any():
        return count
    order = np.argsort(g, kind="stable")
    same = np.r_[False, g[order][1:] == g[order][:-1]]
    at = np.arange(len(g))
    count[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return count


def may_hold(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """df without most rows whose id is not in ids (one column); never drops a row whose id is."""
    return df.where(maybe_in(df, id_col, ids))


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """df without the rows whose id is in ids; rows with a null id stay. Few others are shuffled."""
    test = maybe_in(df, id_col, ids)
    rest = df.where(test).join(ids.select(F.col(ids.columns[0]).alias("gone__")).distinct(), F.col(id_col) == F.col("gone__"), "left_anti")
    return df.where(~test).unionByName(rest)


def maybe_in(df: DataFrame, id_col: str, ids: DataFrame, bits_per_id: int = 12, most_bits: int = 1 << 26) -> Column:
    """False only for ids that are not in ids.

    A Bloom filter of at most ``most_bits``: beyond that it fills up, lets more rows pass and stays right. It saves
    shuffling whole texts to a join that keeps few of them.
    """
    ship(df.sparkSession)
    n = max(1 << 10, ids.count() * bits_per_id)
    bits = min(most_bits, 1 << (n - 1).bit_length())

    def places(x: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for shift in (0, 21, 42):
            yield ((h >> np.uint64(shift)) ^ (h << np.uint64(7))) & np.uint64(bits - 1)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits, dtype=bool)
        for pdf in batches:
            for at in places(pdf["i"].dropna().to_numpy()):
                own[at] = True
        yield pd.DataFrame({"b": [np.packbits(own).tobytes()]})

    whole = np.zeros(bits // 8, dtype=np.uint8)
    for row in ids.toDF("i").coalesce(8).mapInPandas(build, "b binary").toLocalIterator():
        whole |= np.frombuffer(row["b"], dtype=np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        some, v = shared.value, x.fillna(0).to_numpy(dtype=np.int64)
        ok = np.ones(len(v), dtype=bool)
        for at in places(v):
            ok &= (some[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return pd.Series(ok & x.notna().to_numpy())

    return test(F.col(id_col))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): root is the least node of the component.

    Alternates large-star and small-star, each a grouped minimum and a join, until no link changes; the links live in
    written tables, never on the driver. A hub's minimum is summed up before it is shuffled.
    """
    from .common import join_back, materialise

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    cur = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = join_back(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        small = join_back(large, large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        cur = materialise(small.where("u <> v").distinct())
        after = state(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


