"""Passages that repeat across documents, found with suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words around it also starts in a document with a smaller id. The reference is the
whole corpus, which has no size bound, so its automata cannot be broadcast; they are dealt out instead:

1. Each window chooses an anchor, the least-hashed run of ``ANCHOR`` words in it. Equal windows choose equal anchors, so
   only windows whose anchor is found in two documents can repeat. Windows with one anchor form a context, the
   stretch of words that they span.
2. Contexts with a shared anchor go to the shard of that anchor, equal contexts once, with the least id that has them.
3. A shard builds a suffix automaton of its contexts, in the order of their ids, so that each state knows the first
   document that holds its words. The contexts are then streamed through it for matching statistics, cut at WINDOW
   words: a window whose state was first seen in a smaller document repeats.
4. An anchor with more than ``HOT`` different contexts is too much for one task. Runs of ``RUN`` windows of its contexts
   are rows of their own: those whose common words another context has too are taken apart into windows, which are
   grouped by 128 bits of their words. That finds the same.
5. Covered words are removed while the documents that have any are streamed once more.

Anchors (64 bits) only choose what is compared. Contexts, and the windows of step 4, are equal if 128 bits
made of the 64-bit hashes of their words are; step 3 compares words.

Defined results: null and empty texts have no words; documents shorter than a window keep all words; rows with a null
id keep all words and are no reference; rows that repeat an id must repeat its text, and get the same result; an empty
table gives an empty table; extra columns are ignored. A passage that repeats in one document only is kept. Of equal
windows the least id is the reference, so there are no ties. A very long text is one row: its words and their hashes, a
few dozen bytes a word, are the largest thing held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import Scratch, join_back, materialise
from .shingles import WordHash, grams, may_hold, mix

WINDOW, ANCHOR = 50, 8
#: Different contexts of one anchor that a task takes; words of a shard's automaton.
HOT, SHARD_WORDS = 1000, 60_000
_CONTEXT = ("a", "c1", "c2", "n")
#: Windows, by the anchor's place in them, that are looked for together at first.
RUN = 8
_CUT = "a long, c1 long, c2 long, n int, least long, words string, runs array<struct<core:struct<x:long,y:long>,windows:array<struct<i:int,x:long,y:long>>>>"
_B = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def text_words(text: str | None) -> list[bytes]:
    """Words of a text: bytes.split() parts at space, \\t, \\n, \\v, \\f and \\r."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def least_in_windows(g: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` values the place of its least value, the last of equal ones."""
    n = len(g) - size + 1
    best, at, span = g.copy(), np.arange(len(g)), 1
    while span * 2 <= size:  # doubling: best[i] is the least of span values from i
        m = len(best) - span
        right = best[span:] <= best[:m]
        best, at = np.where(right, best[span:], best[:m]), np.where(right, at[span:], at[:m])
        span *= 2
    rest = size - span
    left, right = best[:n], best[rest : rest + n]
    take = (right < left) | ((right == left) & (at[rest : rest + n] >= at[:n]))
    return np.where(take, at[rest : rest + n], at[:n])


def stretch_hashes(h: np.ndarray, from_: np.ndarray, to: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of h[from_:to] for each pair, from prefix sums of a polynomial modulo 2**64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(len(h), base, dtype=np.uint64)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(h), inverse, dtype=np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(h * powers[:-1])]
        return mix((sums[to] - sums[from_]) * back[from_] + (to - from_).astype(np.uint64))


def contexts(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a document's hashed words: anchors, context hashes (2), numbers of windows, first windows, anchors' places."""
    if len(h) < WINDOW:
        return (np.zeros(0, dtype=np.int64),) * 6
    g = grams(h, ANCHOR)
    chosen = least_in_windows(g, WINDOW - ANCHOR + 1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    count = np.diff(np.r_[first, len(chosen)])
    end = first + count - 1 + WINDOW
    c1, c2 = (stretch_hashes(mix(h + b), first, end, b) for b in _B)
    return g[chosen[first]].view(np.int64), c1.view(np.int64), c2.view(np.int64), count, first, chosen[first] - first


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each different context of a document, and one for each document with its words and their digest."""
    import hashlib

    hashes = WordHash()
    for pdf in batches:
        rows, own, total, digest = [], [], [], []
        for i, t in zip(pdf["id"], pdf["text"], strict=True):
            found = text_words(t)
            total.append(len(found))
            digest.append(hashlib.sha256(b" ".join(found)).hexdigest())
            if len(found) >= WINDOW and not pd.isna(i):
                x = contexts(hashes.of(found))[:4]
                once = np.unique(x[1], return_index=True)[1]  # a repeated line gives one row, not one for each repeat
                rows.append([c[once] for c in x])
                own.append(np.full(len(once), i, dtype=np.int64))
        yield pd.DataFrame({"id": pdf["id"], "a": None, "c1": None, "c2": None, "n": None, "n_words": total, "sha": digest})
        if rows:
            a, c1, c2, n = (np.concatenate([r[k] for r in rows]) for k in range(4))
            yield pd.DataFrame({"id": np.concatenate(own), "a": a, "c1": c1, "c2": c2, "n": n, "n_words": None, "sha": None})


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts, cut from the documents that are first to hold them: their words, or the runs of their windows if hot."""
    hashes = WordHash()
    for pdf in batches:
        out = []
        for i, t, wanted in zip(pdf["id"], pdf["text"], pdf["wanted"], strict=True):
            found = text_words(t)
            h = hashes.of(found)
            _, c1, c2, _, first, place = contexts(h)
            at = {(x, y): (f, p) for x, y, f, p in zip(c1.tolist(), c2.tolist(), first.tolist(), place.tolist(), strict=True)}
            for x in wanted:
                f, p = at[x["c1"], x["c2"]]
                row, end = (x["a"], x["c1"], x["c2"], x["n"], i), f + x["n"] - 1 + WINDOW
                if x["hot"]:
                    out.append((*row, None, window_runs(h[f:end], p)))
                else:
                    out.append((*row, b" ".join(found[f:end]).decode("utf-8", "surrogatepass"), None))
        yield pd.DataFrame(out, columns=[*_CONTEXT, "least", "words", "runs"])


def window_runs(h: np.ndarray, place: int) -> list[dict]:
    """Windows of a context's hashed words in runs, with two hashes each, and of the words that all windows of a run have.

    Equal windows have the anchor at one place, so they are in runs of the same number, whose cores are equal.
    """
    n = len(h) - WINDOW + 1
    i = np.arange(n)
    run = (place - i) // RUN
    core = place - np.unique(run)[::-1] * RUN  # in the order of the windows
    x, y = (stretch_hashes(mix(h + b), i, i + WINDOW, b).view(np.int64).tolist() for b in _B)
    cx, cy = (stretch_hashes(mix(h + b), core, core + WINDOW - RUN + 1, b).view(np.int64).tolist() for b in _B)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]).tolist()
    return [
        {"core": {"x": a, "y": b}, "windows": [{"i": k, "x": x[k], "y": y[k]} for k in range(lo, hi)]}
        for a, b, lo, hi in zip(cx, cy, starts, [*starts[1:], n], strict=True)
    ]


class SuffixAutomaton:
    """Of several word sequences; each state keeps the owner that was first to have its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def add(self, sequence: list, owner) -> None:
        next_, link, length, first = self.next, self.link, self.length, self.owner
        last = 0
        for w in sequence:
            q = next_[last].get(w)
            if q is not None:  # known from another sequence
                if length[q] != length[last] + 1:
                    q = self._split(last, w, q)
                last = q
                continue
            cur = len(next_)
            next_.append({})
            length.append(length[last] + 1)
            first.append(owner)
            link.append(0)
            p = last
            while p >= 0 and w not in next_[p]:
                next_[p][w] = cur
                p = link[p]
            if p >= 0:
                q = next_[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w, q: int) -> int:
        """A state for the shorter words of q, those that end after p and w; it has q's first owner."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.owner.append(self.owner[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def owners(self, sequence: list, size: int) -> list:
        """Matching statistics cut at ``size``: for each run of ``size`` words, who had it first (None: nobody)."""
        next_, link, length, out = self.next, self.link, self.length, []
        v, n = 0, 0
        for k, w in enumerate(sequence):
            while v > 0 and w not in next_[v]:
                v = link[v]
                n = length[v]
            if w in next_[v]:
                v = next_[v][w]
                n += 1
            while v > 0 and length[link[v]] >= size:
                v = link[v]
            n = min(n, size) if length[v] >= size else min(n, length[v])
            if k >= size - 1:
                out.append(self.owner[v] if n >= size else None)
        return out


def repeated_windows(shard: list[tuple[int, list]], size: int) -> list[list[int]]:
    """(least id, words) of a shard's contexts: for each, the windows that start in a document with a smaller id."""
    index = SuffixAutomaton()
    for least, found in sorted(shard, key=lambda x: x[0]):
        index.add(found, least)
    return [[k for k, o in enumerate(index.owners(found, size)) if o is not None and o < least] for least, found in shard]


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts sorted by anchor: an automaton for each run of whole anchors of up to SHARD_WORDS words."""

    def solved(rows: list) -> pd.DataFrame:
        found = repeated_windows([(r[4], r[5].split(" ")) for r in rows], WINDOW)
        hit = [(*r[:4], x) for r, x in zip(rows, found, strict=True) if x]
        return pd.DataFrame(hit, columns=["a", "c1", "c2", "n", "at"])

    rows, held, last = [], 0, None
    for pdf in batches:
        for r in zip(*[pdf[c] for c in (*_CONTEXT, "least", "words")], strict=True):
            if r[0] != last and held > SHARD_WORDS:
                yield solved(rows)
                rows, held = [], 0
            last = r[0]
            rows.append(r)
            held += r[3] + WINDOW
    if rows:
        yield solved(rows)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Removes the words of repeated windows: all windows of a context (at is null) or those listed."""
    import hashlib

    hashes = WordHash()
    for pdf in batches:
        out = []
        for i, t, hits in zip(pdf["id"], pdf["text"], pdf["hits"], strict=True):
            found = text_words(t)
            _, c1, c2, n, first, _ = contexts(hashes.of(found))
            hit = {(x["c1"], x["c2"]): x["at"] for x in hits}
            edge = np.zeros(len(found) + 1, dtype=np.int64)
            for x, y, windows, f in zip(c1.tolist(), c2.tolist(), n.tolist(), first.tolist(), strict=True):
                if (x, y) in hit:
                    at = hit[x, y]
                    if at is None:
                        edge[f] += 1
                        edge[f + windows - 1 + WINDOW] -= 1
                    else:
                        np.add.at(edge, f + np.asarray(at), 1)
                        np.add.at(edge, f + np.asarray(at) + WINDOW, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = [w for w, k in zip(found, keep.tolist(), strict=True) if k]
            text = b" ".join(kept)
            out.append((i, len(found) - len(kept), text.decode("utf-8", "surrogatepass"), hashlib.sha256(text).hexdigest()))
        yield pd.DataFrame(out, columns=["id", "n_removed", "kept_text", "kept_sha256"])


def _hot_windows(hot: DataFrame) -> DataFrame:
    """(context, at) of repeated windows of crowded anchors, by grouping runs and then windows as rows."""
    runs = materialise(hot.select(F.struct(*_CONTEXT).alias("c"), "least", F.explode("runs").alias("r")).select("c", "least", "r.*"))
    common = runs.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("core")
    rows = join_back(runs, common, "core").select("c", "least", F.explode("windows").alias("w"))
    rows = materialise(rows.select("c", "least", "w.i", F.struct("w.x", "w.y").alias("window")))
    first = rows.groupBy("window").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("window", "first")
    hit = join_back(rows, first, "window").where("first < least")
    return hit.groupBy("c").agg(F.collect_list("i").alias("at")).select("c.*", "at")


def repeated(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, text) and the contexts of _anchors to (id, hits): contexts with repeated windows, and which (null: all)."""
    both = anchors.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    cand = materialise(join_back(anchors, both, "a").select("id", "a", F.struct(*_CONTEXT).alias("x")))
    distinct = materialise(cand.groupBy("x").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")))
    # an anchor with one context: its windows repeat wherever the context is found again
    own = distinct.select("x.a", "x", "least")
    crowd = own.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    several = join_back(own, crowd, "a").where("size > 1").select("x.*", "least", (F.col("size") > HOT).alias("hot"))
    wanted = materialise(several.groupBy(F.col("least").alias("i")).agg(F.collect_list(F.struct(*_CONTEXT, "hot")).alias("wanted")))
    source = may_hold(docs, "id", wanted.select("i")).dropDuplicates(["id"]).join(wanted, F.col("id") == F.col("i")).select("id", "text", "wanted")
    cut = materialise(source.mapInPandas(_stretches, _CUT))
    calm = cut.where("words is not null").select(*_CONTEXT, "least", "words").repartition("a").sortWithinPartitions("a")
    found = calm.mapInPandas(_shards, "a long, c1 long, c2 long, n int, at array<int>").unionByName(_hot_windows(cut.where("words is null")))
    # a document after the first to hold a context repeats all of it; the first repeats what an earlier one had
    later = join_back(cand, distinct, "x").where("id > least").select("id", "x.c1", "x.c2", F.lit(None).cast("array<int>").alias("at"))
    first = found.select(F.struct(*_CONTEXT).alias("x"), "at").join(distinct, "x").select(F.col("least").alias("id"), "x.c1", "x.c2", "at")
    return later.unionByName(first).groupBy("id").agg(F.collect_list(F.struct("c1", "c2", "at")).alias("hits"))


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (null where nothing went), kept_sha256."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialise(docs.mapInPandas(_anchors, "id long, a long, c1 long, c2 long, n int, n_words long, sha string"))
    scratch = Scratch(df.sparkSession)
    hits = materialise(repeated(docs.where("id is not null"), rows.where("a is not null").select("id", *_CONTEXT)).withColumnRenamed("id", "i"))
    scratch.end(hits)
    touched = may_hold(docs.where("id is not null"), "id", hits.select("i")).dropDuplicates(["id"]).join(hits, F.col("id") == F.col("i"))
    changed = touched.select("id", "text", "hits").mapInPandas(_cut, "id long, n_removed long, kept_text string, kept_sha256 string").withColumnRenamed("id", "i")
    out = rows.where("a is null").select("id", "n_words", "sha").join(changed, F.col("id") == F.col("i"), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "kept_text", F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
