"""Stage 7 and columns: cleaned text with fresh counts, the page's number of columns, each block's column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STAGES, PipelineConfig
from ..functions import geometry as G
from ..functions import text as X
from .stages import PAGE, column_count, thirds


def post_process(blocks: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Cleans texts and derives counts again; ratio and direction stay as they were found.

    reshaped and fixed tell whether the block counts as reshaped Arabic and as changed.
    """
    out = blocks.withColumn("raw_text", F.col("text")).withColumn("text", X.clean(F.col("raw_text"), F.col("rtl_ratio")))
    return out.withColumn("m__", X.measures(F.col("text"))).withColumns({
        "word_count": F.col("m__.words"), "char_count": F.col("m__.chars"),
        "reshaped": F.col("rtl_ratio") > 0.3, "fixed": F.col("text") != F.col("raw_text"),
        "source_stage": F.lit(STAGES[-1]) if cfg.overwrite_stage else F.col("source_stage"),
    }).drop("raw_text", "m__")


def page_columns(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, columns) from the centres of a page's blocks; 1 without blocks."""
    at = blocks.select(*PAGE, "bbox").join(pages.select(*PAGE, "width"), list(PAGE))
    left, middle, right = thirds(F.col("bbox"), F.col("width"))
    counts = at.groupBy(*PAGE).agg(F.count_if(left).alias("l"), F.count_if(middle).alias("m"), F.count_if(right).alias("r"))
    return pages.select(*PAGE).join(counts.select(*PAGE, column_count(F.col("l"), F.col("m"), F.col("r")).alias("columns")), list(PAGE), "left").fillna(1, ["columns"])


def assign_columns(pages: DataFrame, blocks: DataFrame, columns: DataFrame) -> DataFrame:
    context = pages.select(*PAGE, "width").join(columns, list(PAGE))
    joined = blocks.join(context, list(PAGE))
    return joined.withColumn("column", G.assign_column(F.col("bbox"), F.col("width"), F.col("columns"))).drop("width", "columns")


def with_columns(blocks: DataFrame, frame: DataFrame) -> DataFrame:
    """Blocks with columns and column, by one join with the pages' (width, height) and a window on the same key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*PAGE)
    at = blocks.join(frame.select(*PAGE, "width"), list(PAGE))
    n = column_count(*[F.count_if(c).over(w) for c in thirds(F.col("bbox"), F.col("width"))])
    at = at.withColumn("columns", n)
    return at.withColumn("column", G.assign_column(F.col("bbox"), F.col("width"), F.col("columns"))).drop("width")
