"""A synthetic layout over a table of texts: lines become blocks in columns of pages. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box

WIDTH, HEIGHT, LINES = 576, 768, 12


def pages_from_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """RAW_PAGES rows (the id keeps its type): 12 lines a page, in 1 + id % 3 columns."""
    lines = F.split(F.col(text), "\n")
    docs = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    page = F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES).cast("int")))
    pages = docs.select("doc_id", page.alias("p"), "lines").select("doc_id", "p", F.slice("lines", F.col("p") * LINES + 1, LINES).alias("lines"))
    columns = (1 + F.pmod("doc_id", F.lit(3))).cast("int")

    def block(line: Column, slot: Column) -> Column:
        wide = F.lit(float(WIDTH)) / columns
        x0, y0 = (slot % columns) * wide + 16, F.floor(slot / columns) * 64
        span = F.struct(line.alias("text"), F.lit("Synthetic").alias("font"), F.lit(12.0).alias("size"))
        return F.struct(
            (F.col("p") * LINES + slot).cast("int").alias("raw_seq"), F.lit(0).alias("type"), box(x0, y0, x0 + wide - 32, y0 + 48).alias("bbox"),
            F.array(F.struct(F.array(span).alias("spans"))).alias("lines"),
        )

    return pages.select(
        "doc_id", (F.col("p") + 1).alias("page_number"), F.lit(float(WIDTH)).alias("width"), F.lit(float(HEIGHT)).alias("height"),
        F.array_join("lines", "\n").alias("text"), F.lit(None).cast("string").alias("alt_text"), F.transform("lines", block).alias("blocks"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_from_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
