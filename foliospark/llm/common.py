"""What the operators of this subpackage share: words, hashes and tables in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let  # noqa: F401
from ..runtime import Scratch, materialise  # noqa: F401

#: Words are maximal runs of characters other than space, \t, \n, \v, \f and \r.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % n


def literal_rows(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A small table as literals of the plan, without Python on the executors."""
    each = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_back(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of written rows with what was summed up of them by key.

    The groups are written before. So neither side of the join holds an aggregate, and Spark deals the rows of a hot key
    over several tasks (its adaptive skew join), which it can't where the groups are summed in the same stage.
    """
    return rows.join(materialise(groups), key)
