"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of code points. All blocks are sorted, and equal ones get one integer name;
then adjacent pairs of names are sorted and named in the same way, level by level, until every text has one name. Names
are given by comparing the blocks themselves, so two texts have one name only if they are identical: nothing is hashed.

Blocks are sorted by a hash and then by themselves, with the row as tie-breaker, so range partitioning samples short keys
and spreads a block that a third of all rows share over many partitions. A partition numbers its blocks while it streams
them; blocks of the first and last hash of each partition are grouped as rows of their own, which finds the names of a
block that goes on over borders. The driver reads no block.

Defined results: null text is an empty text. Each input row counts on its own, repeated rows too. Of equal texts the row
with the largest id stays (null ids lose; rows that repeat the largest id all say kept). An empty table gives an empty
table. Extra columns are ignored. A text of n blocks takes log2(n) levels, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import Scratch, join_back, materialise, shuffle_parts

BLOCK = 16_384
_NAMED = "row long, pos long, n long, id string, sha string, part int, name long, h long, edge string, key string"


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of one partition: a number for each distinct key, and rows with the keys of the first and last hash."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    hash_, key_, number = None, None, -1
    first: list[tuple] = []
    last: list[tuple] = []
    for pdf in batches:
        if not len(pdf):
            continue
        h, key = pdf["h"].to_numpy(), pdf["key"].to_numpy(dtype=object)
        new = np.r_[h[0] != hash_ or key[0] != key_, (h[1:] != h[:-1]) | (key[1:] != key[:-1])]
        names = number + np.cumsum(new)
        begin = h[0] if hash_ is None else first[0][0]
        first += [(x, k, int(n)) for x, k, n in zip(h[new & (h == begin)], key[new & (h == begin)], names[new & (h == begin)], strict=True)]
        at = new & (h == h[-1])
        if h[-1] != hash_:
            last = []
        last += [(x, k, int(n)) for x, k, n in zip(h[at], key[at], names[at], strict=True)]
        hash_, key_, number = h[-1], key[-1], int(names[-1])
        yield pdf[["row", "pos", "n", "id", "sha"]].assign(part=part, name=names, h=None, edge=None, key=None)
    for edge, keys in (("first", first), ("last", last)):
        yield pd.DataFrame([(None, None, None, None, None, part, n, x, edge, k) for x, k, n in keys], columns=_COLUMNS)


_COLUMNS = [c.split(" ")[0] for c in _NAMED.split(", ")]


def name_sorted(df: DataFrame) -> DataFrame:
    """(row, pos, n, id, sha, key) to (row, pos, n, id, sha, name): equal keys, and only those, have equal names."""
    ship(df.sparkSession)
    df = df.withColumn("h", F.xxhash64("key"))
    ranged = df.repartitionByRange(shuffle_parts(df.sparkSession), "h", "row", "pos").sortWithinPartitions("h", "key", "row", "pos")
    named = materialise(ranged.mapInPandas(_number, _NAMED))
    # a block in several partitions has the last or first hash of each: all go by the least (part, name)
    edges = named.where("edge is not null").select("h", "key", F.struct("part", "name").alias("at")).distinct()
    least = edges.groupBy("h", "key").agg(F.min("at").alias("to"), F.count(F.lit(1)).alias("times")).where("times > 1")
    goes = edges.join(least, ["h", "key"]).where("at <> to").select("at", "to")
    rows = named.where("edge is null").select("row", "pos", "n", "id", "sha", F.struct("part", "name").alias("at"))
    at = F.coalesce("to", "at")
    name = F.shiftleft(at["part"].cast("long"), 40) + at["name"]
    # two hashes a partition, each of one block but for collisions: as many rows as partitions, without their blocks
    return rows.join(F.broadcast(goes), "at", "left").select("row", "pos", "n", "id", "sha", name.alias("name"))


def identities(df: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id (string), sha (of the text), level, name; equal (level, name) means equal text."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = F.when(F.length(t) <= block, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % block), F.lit(0)))
    blocks = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.sha2(t.cast("binary"), 256).alias("sha"), cut.alias("cut"))
    rows = blocks.select("row", "id", "sha", F.size("cut").cast("long").alias("n"), F.posexplode("cut").alias("pos", "key"))
    first = F.col("pos") == 0
    named = name_sorted(rows.select("row", F.col("pos").cast("long"), "n", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha"), "key"))
    longest = named.agg(F.max("n")).first()[0] or 1
    done, level = None, 0
    while True:
        part = named.where("n = 1").select("id", "sha", F.lit(level).alias("level"), "name")
        done = part if done is None else done.unionByName(part)
        if longest <= 1:
            return done
        even = F.col("pos") % 2 == 0
        pairs = named.where("n > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("long").alias("pos")).agg(
            F.first("n").alias("n"), F.max("id").alias("id"), F.max("sha").alias("sha"),
            F.max(F.when(even, F.col("name"))).alias("l"), F.max(F.when(~even, F.col("name"))).alias("r"),
        )
        key = F.concat_ws(",", F.col("l").cast("string"), F.coalesce(F.col("r").cast("string"), F.lit("")))
        named = name_sorted(pairs.select("row", "pos", F.ceil(F.col("n") / 2).cast("long").alias("n"), "id", "sha", key.alias("key")))
        longest, level = (longest + 1) // 2, level + 1


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256. The id column is an integer."""
    kind = df.schema[id_col].dataType
    scratch = Scratch(df.sparkSession)
    ids = materialise(identities(df, id_col, text, block).withColumn("id", F.col("id").cast(kind)))
    scratch.end(ids)
    ids = ids.select("id", "sha", F.struct("level", "name").alias("same"))
    groups = ids.groupBy("same").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    return join_back(ids, groups, "same").select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of df that stay: of equal texts the one with the largest id, once. Rows with a null id all stay."""
    from .shingles import maybe_in

    own = exact_dedup(df, id_col, text, block)
    out = materialise(own.select(F.col(id_col).alias("i__"), "kept", F.col("text_sha256").alias("h__")).where("i__ is not null"))
    goes = out.where("not kept").select("i__")
    again = out.where("kept").groupBy("i__", "h__").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i__")  # repeated rows
    test = maybe_in(df, id_col, materialise(goes.unionByName(again).distinct()))
    some = df.where(test).withColumn("h__", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    stay = out.where("kept").select("i__", F.col("h__").alias("g__")).distinct()
    held = some.join(stay, (F.col(id_col) == F.col("i__")) & (F.col("h__") == F.col("g__"))).dropDuplicates(["i__", "h__"]).select(*df.columns)
    return df.where(~test).unionByName(held)
