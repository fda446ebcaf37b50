"""Near duplicates by order MinHash, verified by banded alignment.

Texts become words (lower case, ASCII marks are gaps). A sketch takes, under one hash order, the two least
occurrence-labelled 5-word shingles and keeps them in text order: texts share it only if they hold the same shingles in
the same order, so agreement follows edit similarity, not just set overlap. Texts that share one of those
sketches (a bucket) are candidates; a candidate pair is linked if an alignment in a band finds at most
``1 - similarity`` edits a word.

All pairs of a bucket are candidates, at every size of bucket. First each member meets the two that most often are the
least and the greatest id of its buckets (linear in the members), which joins most copies into classes. Then the pairs of
different classes are compared by bounds that never rule out a similar pair: word counts, and how many words one text has
that the other lacks. That work grows with the square of a bucket of unlike texts, as operations on bits; members are
dealt into blocks by length and hash, so a task holds at most two blocks. There the pairs within the bounds are aligned at
once, but for those that links found before already join, so a group writes fewer links than it has members and no
pairs; only buckets of at most ``MANY`` members write pairs. Equal word sequences are one member from the start, so copies
make no pairs at all.

Defined results: a text without words (null, empty) is a class by itself; fewer than five words make one shingle; rows
with a null id have a null class; rows that repeat an id are one document; an empty table gives an empty table; extra
columns are ignored; a very long text is sketched whole, a few hash orders at a time, and aligned in a band of
``1 - similarity`` of its words. Among equal sketches or sizes nothing is chosen: classes are connected components of
the links, named by their least id, found in tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import give_back, ship
from .common import Scratch, join_back, materialise
from .shingles import components, grams, may_hold, maybe_in, mix, occurrences, word_hashes

SHINGLE, SIMILARITY, SKETCHES = 5, 0.8, 16
#: Further sketches, of shorter shingles: edits spread evenly at the similarity leave no run of five words whole.
SHORT, SHORT_SKETCHES = 3, 96
#: Members that each member meets first.
HUBS = 3
#: Members of a block, when all pairs of a bucket are compared; no pair depends on it.
HOT = 2048
#: Members of a bucket above which its rows carry words and sketches, to align a pair on the spot and only once.
MANY = 32
#: Elements of one numpy operation while a text is sketched or a block compared.
CHUNK = 1 << 20
_GAPS = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def spaced(text: str | None) -> bytes:
    """A text's words with spaces for all else between them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_GAPS)


def text_words(text: str | None) -> list[bytes]:
    return spaced(text).split()


@functools.cache
def _seeds(k: int, m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * (k - SHINGLE)))


def sketch(h: np.ndarray, k: int = SHINGLE, m: int = SKETCHES) -> np.ndarray:
    """m order-min-hash values (int64) of hashed words; none for no words."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    g = grams(h, min(k, len(h)))
    key = mix(g + occurrences(g) * np.uint64(0xD1B54A32D192ED03))
    seeds = _seeds(k, m)
    low, high = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    step = max(1, CHUNK // len(key))
    for j in range(0, m, step):
        v = (key ^ seeds[j : j + step, None]) * np.uint64(0xDA942042E4DD58B5)
        a = b = v.argmin(axis=1)
        if len(key) > 1:
            v[np.arange(len(v)), a] = np.uint64(0xFFFFFFFFFFFFFFFF)
            b = v.argmin(axis=1)
        low[j : j + step], high[j : j + step] = np.minimum(a, b), np.maximum(a, b)
    return mix(g[low] * np.uint64(0x9E3779B97F4A7C15) + (g[high] ^ np.arange(m, dtype=np.uint64) + np.uint64(1000 * (k - SHINGLE) % 2**32))).view(np.int64)


def profile(h: np.ndarray) -> bytes:
    """16 bits of each occurrence-labelled word, in order.

    A word that no alignment matches costs an edit; equal bits of different words only lower that bound.
    """
    h = np.sort(h)
    at = np.arange(len(h))
    label = at - np.maximum.accumulate(np.where(np.r_[False, h[1:] == h[:-1]], 0, at)) if len(h) else at
    return np.sort((mix(h + label.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(48)).astype(np.uint16)).tobytes()


def outline(exact: bytes) -> bytes:
    """A profile as bits, two to four a word; halves of it, put over each other, are the outline of half the width."""
    own = np.frombuffer(exact, dtype=np.uint16)
    on = np.zeros(min(1 << 16, max(64, 1 << (2 * max(len(own), 1) - 1).bit_length())), dtype=bool)
    on[own & np.uint16(len(on) - 1)] = True
    return np.packbits(on, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At least so many words that one text has and the other lacks, by their outlines."""
    if len(a) > len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
    while size > len(a) * 8:
        size //= 2
        y = (y >> size) | (y & ((1 << size) - 1))
    return max(x.bit_count(), y.bit_count()) - (x & y).bit_count()


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    Bit-parallel in the band of diagonals within ``most``: one row of the band is one integer.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    n = len(b)
    differ = np.flatnonzero(a[:n] != b)
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = len(b)
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[::-1]) if n else ()
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: n - tail]
    if not len(b):
        return len(a)
    most = min(most, len(a))
    if most == 0:
        return 1
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    width = 2 * most + 2
    mask = (1 << width) - 1
    plus, minus = (mask << (width - most - 1)) & mask, 0
    dist, diagonal, across = most, 1 << (width - 1), 1 << (width - 2)
    stop = 2 * most + len(b) - len(a)
    start = most + 1 - width
    for i, w in enumerate(b.tolist()):
        x = where.get(w, 0)
        x = ((x >> start) if start >= 0 else (x << -start)) & mask
        d = ((((x & plus) + plus) ^ plus) | x | minus) & mask
        hp, hn = minus | (mask ^ (d | plus)), d & plus
        if i < len(a) - most:
            dist += not d & diagonal
        else:
            dist += bool(hp & across) - bool(hn & across)
            across >>= 1
        if dist > stop:
            return most + 1
        d >>= 1
        plus, minus = hn | (mask ^ (d | hp)), d & hp
        start += 1
    return min(dist, most + 1)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        for i, t in zip(pdf["id"], pdf["text"], strict=True):
            data = spaced(t)
            h = word_hashes(data)
            digest = xxhash.xxh3_128_digest(b" ".join(data.split())) if len(h) else None
            yield i, len(h), digest, np.r_[sketch(h), sketch(h, SHORT, SHORT_SKETCHES)], outline(profile(h))

    for pdf in batches:
        yield pd.DataFrame(rows(pdf), columns=["id", "n", "digest", "sketch", "outline"])
    give_back()


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame(((i, word_hashes(spaced(t)).astype(np.uint32).view(np.int32)) for i, t in zip(pdf["id"], pdf["text"], strict=True)), columns=["id", "vec"])


def _aligned(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for a, b in zip(pdf["va"], pdf["vb"], strict=True):
            most = allowed(max(len(a), len(b)), similarity)
            ok.append(banded_distance(a, b, most) <= most)
        yield pdf.loc[ok, ["a", "b"]]


def allowed(n: int, similarity: float) -> int:
    """Edits that n words may have."""
    return int(n * (1 - similarity) + 1e-9)


def buckets(members: DataFrame) -> DataFrame:
    """(id, sketch) to (id, h, size): a row for each sketch that at least two members share."""
    rows = members.select("id", F.explode("sketch").alias("h"))
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("size > 1")


def candidates(shared: DataFrame, hubs: int = HUBS) -> DataFrame:
    """Rows of buckets to a first set of distinct pairs (a, b), a < b: each member with the ``hubs`` members that most
    often lead its buckets. A bucket's leader is the member with most company in all its own: the likely origin of copies.
    """
    company = shared.withColumn("company", F.sum("size").over(Window.partitionBy("id")))
    led = company.withColumn("o", -F.max(F.struct("company", (-F.col("id")).alias("o"))).over(Window.partitionBy("h"))["o"]).where("o <> id")
    often = led.groupBy("id", "o").agg(F.count(F.lit(1)).alias("times"))
    first = Window.partitionBy("id").orderBy(F.col("times").desc(), "o")
    chosen = often.withColumn("k", F.row_number().over(first)).where(F.col("k") <= hubs)
    return chosen.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def unsettled(shared: DataFrame, root: DataFrame) -> DataFrame:
    """Rows (id, h, size, root) of those buckets whose members are of different classes so far."""
    named = shared.select("id", "h", "size").join(root, F.col("id") == F.col("node"), "left").select("id", "h", "size", F.coalesce("root", "id").alias("root"))
    named = materialise(named)
    return materialise(named.join(named.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h"), "h"))


def few_pairs(rows: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every pair (a, b) of a bucket of at most ``MANY`` members whose ends are of different classes and whose outlines allow the similarity."""
    dealt = rows.where(F.col("size") <= MANY).join(members.select("id", "n", "outline"), "id").repartition("h").sortWithinPartitions("h")
    return dealt.mapInPandas(lambda it: _whole(it, ("h",), functools.partial(_few, similarity=similarity)), "a long, b long").distinct()


def crowd_links(df: DataFrame, rows: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join all members of a bucket of more than ``MANY`` members whose texts align; df has (id, text).

    No bucket is capped. Members fall into classes of length, of which only equal or adjacent ones can be similar, and a
    bucket of more than ``HOT`` members into blocks by hash; every two blocks of such lengths meet in a group of their own.
    """
    rows = rows.where(F.col("size") > MANY)
    ids = materialise(rows.select("id").distinct())
    test = maybe_in(df, "id", ids)
    some = lambda x: x.where(test).join(ids, "id", "left_semi")
    vecs = some(df.where("id is not null")).dropDuplicates(["id"]).mapInPandas(_vectors, "id long, vec array<int>")
    rows = rows.join(materialise(vecs.join(some(members.select("id", "sketch")), "id")), "id").withColumn("n", F.size("vec"))
    blocks = F.ceil(F.col("size") / HOT).cast("int")
    by_length = (blocks > 8) & F.lit(similarity < 1)  # else three times the rows would not pay
    parts = F.when(by_length, F.ceil(blocks / 2).cast("int")).otherwise(blocks)
    length = F.when(by_length, F.floor(F.log(F.greatest("n", F.lit(1))) / -np.log(min(similarity, 0.99)) + 1e-9)).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("x", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("c", length)
    every = F.sequence(F.lit(0), parts - 1)
    same = F.transform(every, lambda y: F.struct(F.col("c").alias("g"), F.least("x", y).alias("s"), F.greatest("x", y).alias("t"), (F.col("x") > y).alias("upper"), F.lit(False).alias("across")))
    below = F.transform(every, lambda y: F.struct((F.col("c") - 1).alias("g"), y.alias("s"), F.col("x").alias("t"), F.lit(True).alias("upper"), F.lit(True).alias("across")))
    above = F.transform(every, lambda y: F.struct(F.col("c").alias("g"), F.col("x").alias("s"), y.alias("t"), F.lit(False).alias("upper"), F.lit(True).alias("across")))
    meets = F.when(by_length, F.concat(same, below, above)).otherwise(same)
    rows = rows.withColumn("m", F.explode(meets)).select("h", "m.*", "id", "root", "sketch", "vec")
    dealt = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInPandas(lambda it: _whole(it, _GROUP, functools.partial(_crowd, similarity=similarity)), "a long, b long").distinct()


_GROUP = ("h", "g", "s", "t", "across")


def _whole(batches: Iterator[pd.DataFrame], names: tuple[str, ...], found: Callable[[pd.DataFrame, np.ndarray], list[tuple]]) -> Iterator[pd.DataFrame]:
    """What is found in whole groups of rows, which are in order of their names; a group may go on in the next batch."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[list(names)].to_numpy(dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        pairs: list[tuple] = []
        if held and (held[-1][list(names)].to_numpy(dtype=np.int64)[-1] != key[0]).any():
            pairs += found(pd.concat(held, ignore_index=True), np.zeros(1, dtype=np.int64))
            held = []
        if len(starts) > 1:  # the last group waits
            whole = pd.concat([*held, pdf.iloc[: starts[-1]]], ignore_index=True)
            pairs += found(whole, np.r_[0, starts[1:-1] + sum(map(len, held))])
            held = []
        held.append(pdf.iloc[starts[-1] :])
        yield _frame(pairs)
    if held:
        yield _frame(found(pd.concat(held, ignore_index=True), np.zeros(1, dtype=np.int64)))
    give_back()


def _frame(found: list[tuple]) -> pd.DataFrame:
    a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *(x[k] for x in found)]) for k in range(2))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _spans(starts: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """The groups of rows that begin at starts, but for those of one class."""
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(root)], strict=True):
        if (root[at:end] != root[at]).any():
            yield at, end


def _few(rows: pd.DataFrame, starts: np.ndarray, similarity: float) -> list[tuple]:
    """Pairs (arrays of ids) of the small buckets that begin at starts."""
    n, ids, root, outlines = (rows[c].to_numpy() for c in ("n", "id", "root", "outline"))
    found = []
    for at, end in _spans(starts, root):
        o = at + np.argsort(n[at:end], kind="stable")
        found += _few_pairs(n[o].tolist(), ids[o].tolist(), root[o].tolist(), outlines[o].tolist(), similarity)
    return found


def _crowd(rows: pd.DataFrame, starts: np.ndarray, similarity: float) -> list[tuple]:
    """Links (arrays of ids) of the groups of rows that begin at starts."""
    h, ids, root, upper, across, s, t, sketches, vecs = (rows[c].to_numpy() for c in ("h", "id", "root", "upper", "across", "s", "t", "sketch", "vec"))
    n = np.fromiter(map(len, vecs), dtype=np.int64, count=len(vecs))
    found = []
    for at, end in _spans(starts, root):
        o = at + np.argsort(n[at:end], kind="stable")
        side = None if s[at] == t[at] and not across[at] else upper[o]
        found += _links(n[o], ids[o], root[o], side, vecs[o], np.stack(sketches[o]), h[at], similarity)
    return found


def _few_pairs(n: list, ids: list, root: list, outlines: list, similarity: float) -> list[tuple]:
    """Pairs of one small bucket, by outlines; texts in order of their length."""
    left, right = [], []
    for j in range(1, len(n)):
        most = allowed(n[j], similarity)
        for i in range(j - 1, -1, -1):
            if n[i] < n[j] - most:
                break
            if root[i] != root[j] and apart(outlines[i], outlines[j]) <= most:
                left.append(ids[i])
                right.append(ids[j])
    return [(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))] if left else []


def _links(n: np.ndarray, ids: np.ndarray, root: np.ndarray, side: np.ndarray | None, vecs: np.ndarray, sk: np.ndarray, h: int, similarity: float) -> list[tuple]:
    """Links of one block (side is None) or of a lower with an upper one; texts in order of their length.

    A pair counts in the first of the buckets that it shares only, and not where links found here join it already.
    """
    left, right, label = [], [], root.copy()
    own = [np.frombuffer(profile(v.view(np.uint32).astype(np.uint64)), dtype=np.uint16) for v in vecs]
    scratch = np.zeros(1 << 16, dtype=bool)
    most = np.floor(n * (1 - similarity) + 1e-9).astype(np.int64)
    reach = np.searchsorted(n - most, n, side="right")  # texts of i + 1 .. reach[i] are short enough for i
    level = np.minimum(np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64) + 2, 16)  # 4 to 8 bits a word
    for v in np.unique(level).tolist():
        lo, hi = np.searchsorted(level, v), np.searchsorted(level, v, side="right")
        bits = np.stack([_bits(p, v) for p in own[lo : int(reach[hi - 1])]])
        total = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for i in range(lo, hi):
            j = np.arange(i + 1, reach[i])
            j = j[label[j] != label[i]]
            if side is not None:
                j = j[side[j] != side[i]]
            if len(j):
                first = [(sk[k] == sk[i]).argmax(axis=1) for k in np.array_split(j, 1 + len(j) * sk.shape[1] // CHUNK)]
                j = j[sk[i][np.concatenate(first)] == h]
            if len(j):
                both = [np.bitwise_count(bits[k - lo] & bits[i - lo]).sum(axis=1, dtype=np.int64) for k in np.array_split(j, 1 + len(j) * bits.shape[1] // CHUNK)]
                j = j[np.maximum(total[j - lo], total[i - lo]) - np.concatenate(both) <= most[j]]  # bits that one has and the other lacks
            if len(j):
                scratch[own[i]] = True
                j = j[[n[k] - np.count_nonzero(scratch[own[k]]) <= most[k] for k in j.tolist()]]
                scratch[own[i]] = False
            for k in j.tolist():
                if label[k] != label[i] and banded_distance(vecs[k], vecs[i], int(most[k])) <= most[k]:
                    left.append(ids[i])
                    right.append(ids[k])
                    label[label == label[k]] = label[i]
    return [(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))] if left else []


def _bits(own: np.ndarray, v: int) -> np.ndarray:
    """A profile as 2**v bits, in words of 64."""
    on = np.zeros(1 << v, dtype=bool)
    on[own >> np.uint16(16 - v)] = True
    return np.packbits(on).view(np.uint64)


def possible(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) that word counts and outlines allow."""
    side = lambda c: members.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("outline").alias(f"o{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = both.where(F.greatest("na", "nb") - F.least("na", "nb") <= F.greatest("na", "nb") * (1 - similarity) + 1e-6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [apart(x, y) <= allowed(max(m, n), similarity) for x, y, m, n in zip(pdf["oa"], pdf["ob"], pdf["na"], pdf["nb"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    return near.mapInPandas(run, "a long, b long")


def verified(df: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose texts align; df has (id, text)."""
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = may_hold(df.where("id is not null"), "id", ends).join(ends, "id", "left_semi")
    vecs = materialise(some.dropDuplicates(["id"]).mapInPandas(_vectors, "id long, vec array<int>"))
    both = pairs.join(vecs.toDF("a", "va"), "a").join(vecs.toDF("b", "vb"), "b")
    return materialise(both.select("a", "b", "va", "vb").mapInPandas(lambda it: _aligned(it, similarity), "a long, b long"))


def links(df: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) that connect all members of which some bucket holds both and whose texts align; df has (id, text)."""
    shared = materialise(buckets(members))
    first = materialise(possible(materialise(candidates(shared)), members, similarity))
    root = components(verified(df, first, similarity).toDF("u", "v"))
    rows = unsettled(shared, root)
    rest = materialise(few_pairs(rows, members, similarity).join(first, ["a", "b"], "left_anti"))
    crowds = materialise(crowd_links(df, rows, members, similarity))
    return root.toDF("u", "v").unionByName(verified(df, rest, similarity).toDF("u", "v")).unionByName(crowds.toDF("u", "v"))


def once(known: DataFrame, copies: DataFrame, again: DataFrame) -> DataFrame:
    """(id, n, sketch, outline) of known without ids of copies, and one row for each id of again (of its least digest).

    Few rows are shuffled: a filter of ids tells which can be concerned.
    """
    test = maybe_in(known, "id", materialise(copies.unionByName(again).distinct()))
    names = ("n", "sketch", "outline")
    some = known.where(test).join(copies, "id", "left_anti").groupBy("id").agg(F.min_by(F.struct(*names), "digest").alias("x")).select("id", "x.*")
    return known.where(~test).select("id", *names).unionByName(some)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, class_id (least id of its class), class_size, kept (it is that least id)."""
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    wide = materialise(df.mapInPandas(_sketches, "id long, n int, digest binary, sketch array<long>, outline binary"))
    rows = materialise(wide.select("id", "digest"))
    known = rows.where("id is not null and digest is not null")
    texts = materialise(known.groupBy("digest").agg(F.min("id").alias("id")))
    copies = known.join(texts.select("digest", F.col("id").alias("least")), "digest").where("id <> least").select("id").distinct()
    again = known.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    members = materialise(once(wide.where("id is not null and digest is not null"), materialise(copies), again))
    scratch.end(rows, texts, members)
    root = components(links(df, members, similarity))
    named = materialise(texts.select("digest", "id").join(root, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("class_id")))
    alone = rows.where("id is null or digest is null").select("id", F.col("id").alias("class_id"))
    ids = materialise(known.join(named, "digest").select("id", "class_id").unionByName(alone))
    scratch.end(ids)
    known = ids.where("id is not null")
    sizes = known.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    out = join_back(known, sizes, "class_id").select("id", "class_id", F.col("size").alias("class_size"), (F.col("id") == F.col("class_id")).alias("kept"))
    none = ids.where("id is null").select("id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(none).withColumnRenamed("id", id_col)
