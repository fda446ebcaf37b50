"""Roll-ups block to page to document; sums combine before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .stages import PAGE


def stage_summary(blocks: DataFrame) -> DataFrame:
    """Per page and stage: block_count, total_chars, avg_confidence."""
    return blocks.groupBy(*PAGE, "source_stage").agg(
        F.count(F.lit(1)).alias("block_count"), F.sum("char_count").alias("total_chars"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence")
    )


def stage_counts(blocks: DataFrame, *grain: str) -> DataFrame:
    return blocks.groupBy(*grain, "source_stage").agg(F.count(F.lit(1)).alias("n"))


def as_map(counts: DataFrame, *grain: str) -> DataFrame:
    """(grain, stage_stats map) from rows of counts."""
    return counts.groupBy(*grain).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_stage", "n")))).alias("stage_stats"))


def page_summary(pages: DataFrame, blocks: DataFrame, images: DataFrame | None = None, columns: bool = False) -> DataFrame:
    """Per page: blocks, characters, total_confidence (mean, 0 without blocks), text_coverage (sum of areas, may pass 100).

    With columns, blocks have their page's columns; a page without blocks has 1.
    """
    sums = blocks.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("char_count").alias("n_chars"), F.avg("confidence").alias("mean"), F.sum(G.area(F.col("bbox"))).alias("covered"),
        *([F.max("columns").alias("columns")] if columns else []),
    )
    out = pages.select(*PAGE, "width", "height").join(sums, list(PAGE), "left")
    if images is not None:
        out = out.join(images.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_images")), list(PAGE), "left")
    size = F.col("width") * F.col("height")
    return out.select(
        *PAGE, "width", "height", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_blocks", "n_chars")],
        (F.coalesce("n_images", F.lit(0)) if images is not None else F.lit(0)).cast("long").alias("n_images"),
        F.coalesce("mean", F.lit(0.0)).alias("total_confidence"),
        F.when(size > 0, F.coalesce("covered", F.lit(0.0)) / size * 100).otherwise(F.lit(0.0)).alias("text_coverage"),
        *([F.coalesce("columns", F.lit(1)).alias("columns")] if columns else []),
    )


def document_summary(page_rows: DataFrame) -> DataFrame:
    """Per document: pages, blocks, images, and the mean of the page means that are above 0."""
    some = F.when(F.col("total_confidence") > 0, F.col("total_confidence"))
    return page_rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("n_blocks").alias("total_blocks"), F.sum("n_images").alias("total_images"), F.coalesce(F.avg(some), F.lit(0.0)).alias("avg_confidence")
    )


def direct_counters(blocks: DataFrame, threshold: float = 0.3) -> DataFrame:
    high = F.col("confidence") >= threshold
    return blocks.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("total_blocks"), F.count_if(high).alias("high_confidence_blocks"), F.count_if(~high).alias("low_confidence_blocks"))


def cleaning_counters(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.count_if("reshaped").alias("arabic_blocks_reshaped"), F.count_if("fixed").alias("words_fixed"))


def stage_counters(frame: DataFrame, blocks: DataFrame, asked: list[DataFrame], images: DataFrame | None = None) -> DataFrame:
    """Per page, what the OCR stages asked for and got: blocks_processed and blocks_improved, grid_regions and
    regions_with_text, images and images_with_text; 0 where a stage did not run.

    blocks are those of all stages; asked has a row (page, counter) for each region asked for.
    """
    got = {"block_ocr": "blocks_improved", "grid_ocr": "regions_with_text", "image_ocr": "images_with_text"}
    rows = blocks.where(F.col("source_stage").isin(*got)).select(*PAGE, F.create_map(*[F.lit(x) for k in got.items() for x in k])[F.col("source_stage")].alias("counter"))
    for more in asked:
        rows = rows.unionByName(more)
    if images is not None:
        rows = rows.unionByName(images.select(*PAGE, F.lit("images").alias("counter")))
    names = ("blocks_processed", "blocks_improved", "grid_regions", "regions_with_text", "images", "images_with_text")
    counts = rows.groupBy(*PAGE).agg(*[F.count_if(F.col("counter") == n).alias(n) for n in names])
    return frame.select(*PAGE).join(counts, list(PAGE), "left").fillna(0, list(names))


def structured_counts(blocks: DataFrame) -> DataFrame:
    is_text = F.col("type") == "text"
    return blocks.groupBy(*PAGE).agg(
        F.count_if(is_text).alias("text_blocks"), F.count_if(~is_text).alias("image_blocks"),
        F.count_if(is_text & (F.col("extraction_method") == "direct")).alias("direct_blocks"), F.count_if(is_text & (F.col("extraction_method") == "ocr")).alias("ocr_blocks"),
    )


def pages_by_method(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id", "method").agg(F.count(F.lit(1)).alias("n_pages"))


def full_text(pages: DataFrame) -> DataFrame:
    """Per document the page texts under their headings, in page order."""
    rule = "=" * 50
    part = F.concat(F.lit(f"\n{rule}\nPage "), F.col("page_number").cast("string"), F.lit(" ("), F.upper("method"), F.lit(f")\n{rule}\n"), F.col("text"), F.lit("\n"))
    rows = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", part.alias("part")))).alias("parts"))
    return rows.select("doc_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("full_text"))


def job_status(outcomes: DataFrame) -> DataFrame:
    """(job_id, file, error) to one row per job: total, results, errors, status.

    A boolean column done, if there is one, tells files that are through; a job with others is processing. A string
    column failure, if there is one, is an error of the whole job.
    """
    done = F.col("done") if "done" in outcomes.columns else F.lit(True)
    failed = F.max(F.col("failure").isNotNull()) if "failure" in outcomes.columns else F.lit(False)
    out = outcomes.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done & F.col("error").isNull()).alias("results"), F.count_if(done & F.col("error").isNotNull()).alias("errors"),
        F.when(failed, "error").when(F.min(done), "completed").otherwise("processing").alias("status"),
    )
    return out


def page_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with images_count; images are rows per page."""
    counts = images.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("images_count"))
    return pages.join(counts, list(PAGE), "left").fillna(0, ["images_count"])


def document_images(images: DataFrame) -> DataFrame:
    """(doc_id, images): each document's images as one list in order: page, index, format, size in bytes, filename."""
    one = F.struct(
        F.col("page_number").alias("page"), F.col("img_index").alias("index"), "format", F.octet_length("bytes").alias("size"),
        F.format_string("page%d_img%d.%s", "page_number", "img_index", "format").alias("filename"),
    )
    return images.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("images"))


def run_summary(documents: DataFrame) -> DataFrame:
    """One row over all documents: documents, pages, blocks, images and the mean of the means above 0."""
    some = F.when(F.col("avg_confidence") > 0, F.col("avg_confidence"))
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(f"total_{c}"), F.lit(0)).alias(f"total_{c}") for c in ("pages", "blocks", "images")],
        F.coalesce(F.avg(some), F.lit(0.0)).alias("avg_confidence"),
    )


def viewer_filter(blocks: DataFrame, name: str) -> DataFrame:
    """all, direct, ocr (anything not direct) or rtl."""
    keep = {"direct": F.col("source_stage") == "direct", "ocr": F.col("source_stage") != "direct", "rtl": F.col("direction") == "rtl"}
    return blocks.where(keep[name]) if name in keep else blocks
