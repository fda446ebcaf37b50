"""Mixing sources to target weights with histograms of hashed ids; built-in functions only.

Every row has a 60-bit hash of its id. A source's budget is met by whole passes over the source and a last part pass
that takes the rows whose hash lies below a threshold. The threshold is found without sorting rows: sum sizes by source
and by the top bits of the hash, locate the bucket in which the budget is reached, and refine that bucket alone by the
next bits. A larger budget has a larger threshold, so what it takes contains what a smaller one takes (nested budgets).

Defined results: null text counts 0 words; null source is a source of its own, ordered last; rows with equal ids have
equal hashes and are taken together; a source of size 0 has target 0; an empty table gives an empty table. Extra
columns are ignored. Memory is bounded by sources x buckets; a hot source is summed before it is shuffled. Tables of
sources are joined without a hint, so Spark broadcasts them only while their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words

#: Bits of each level of the histogram; three levels narrow a threshold to 2**-36 of a source.
BITS, LEVELS, HASH_BITS = 12, 3, 60
WEIGHTS = (5, 2, 1)


def id_hash(col: Column) -> Column:
    """0 <= long < 2**60, from md5 of the id as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights in code-point order, filled up to the caps.

    With sources sorted by size over weight, the first k are at their caps, where k is the least number for which the
    level of the rest, (total - their caps) / (weights of the rest), is within the next one's cap: what repeated
    resharing of the excess arrives at. Rows here are sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_fill = Window.orderBy("fill", "rank")
    every = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    share, cap = F.lit(float(share)), F.lit(float(cap))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    level = ranked.withColumn("fill", F.col("source_size") / F.col("w")).select(
        "*",
        (share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("rest"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_rest"),
    )
    free = cap * F.col("source_size") * F.col("w_rest") >= F.col("rest") * F.col("w")
    at = level.withColumn("x", F.min(F.when(free, F.struct("fill", "rank", "rest", "w_rest"))).over(every))
    fills = (F.col("fill") > F.col("x.fill")) | ((F.col("fill") == F.col("x.fill")) & (F.col("rank") >= F.col("x.rank")))
    return at.select(
        "source",
        "source_size",
        F.when(F.col("x").isNotNull() & fills, F.col("w") * F.col("x.rest") / F.col("x.w_rest")).otherwise(cap * F.col("source_size")).alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, size, hash) and (source, budget) to (source, below): take rows with hash < below.

    Narrows [low, low + 2**shift) level by level; the last bucket is taken or left as is nearer to the budget.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("n"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        up = shift + BITS
        at = state.select(F.col("source").alias("s"), "low", "left")
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", up) == F.shiftright("low", up)))
        counts = inside.groupBy("source", F.shiftright("hash", shift).alias("b")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        hit = upto.where("upto > left").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("b", "upto", "n")).alias("x"))
        found = F.col("x").isNotNull()
        state = materialise(
            state.join(hit, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                F.when(found, F.col("left") - F.col("x.upto") + F.col("x.n")).otherwise(F.col("left")).alias("left"),
                F.when(found, F.shiftleft("x.b", shift)).otherwise(F.col("low")).alias("low"),
                F.when(found, F.col("x.n")).otherwise(F.col("n")).alias("n"),
            )
        )
    step = 1 << (HASH_BITS - BITS * LEVELS)
    return state.select("source", (F.col("low") + F.when((F.col("n") > 0) & (F.col("left") * 2 >= F.col("n")), F.lit(step)).otherwise(F.lit(0))).alias("below"))


def sized(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, hash) of each row."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), id_hash(F.col(id_col)).alias("hash"))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(s, source_size, target, whole, below) of each source s, from written rows of ``sized``."""
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = materialise(goal.withColumn("whole", whole.cast("long")))
    below = thresholds(rows, goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    return materialise(
        goal.join(below.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "whole", "below")
    )


def copies(hashed: Column, cap: float = 2.0) -> Column:
    """Times that the mix takes a row, given its hash and the columns of its source's plan."""
    return (F.col("whole") + F.when((hashed < F.col("below")) & (F.col("whole") < cap), 1).otherwise(0)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies (times the mix takes the row), taken."""
    rows = materialise(sized(df, id_col, source, text))
    joined = rows.join(plan(rows, weights, share, cap), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies(F.col("hash"), cap))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: df's rows, each as often as the mix takes it. Only plans are joined, texts are not shuffled."""
    goal = plan(materialise(sized(df, id_col, source, text)), weights, share, cap)
    given = F.struct(*[F.col(c) for c in df.columns]).alias("given")
    rows = df.select(given, F.col(source).alias("s_"), id_hash(F.col(id_col)).alias("hash_"))
    times = rows.join(goal, F.col("s_").eqNullSafe(F.col("s"))).select("given", copies(F.col("hash_"), cap).alias("times")).where("times > 0")
    return times.select("given", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).select("given.*")
