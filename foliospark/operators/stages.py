"""Extraction stages as DataFrame functions. A page row carries its raw blocks, so block rules run without a shuffle.

Block rows: doc_id, page_number, stage_ord, seq, block_id, bbox, text, confidence, source_stage, font, size, direction,
rtl_ratio, word_count, char_count. (stage_ord, seq) is the order within a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_FONT, DEFAULT_IMAGE_BOX, DEFAULT_SIZE, HYBRID_OCR_CONFIDENCE, OCR_CONFIDENCE, STAGES, STRUCTURED_IMAGE_CONFIDENCE, STRUCTURED_OCR_CONFIDENCE, PipelineConfig
from ..functions import geometry as G
from ..functions import text as X

PAGE = ("doc_id", "page_number")
BLOCK = (*PAGE, "stage_ord", "seq", "block_id", "bbox", "text", "confidence", "source_stage", "font", "size", "direction", "rtl_ratio", "word_count", "char_count")
#: Text of rows that need OCR: takes them, returns them with ocr_text.
Ocr = Callable[[DataFrame], DataFrame]


def first_span(lines: Column) -> Column:
    return F.try_element_at(F.try_element_at(lines, F.lit(1))["spans"], F.lit(1))


def font_info(lines: Column) -> tuple[Column, Column]:
    """Font and size of the first span of the first line; null without one, defaults where the span lacks them."""
    s = first_span(lines)
    return F.when(s.isNotNull(), F.coalesce(s["font"], F.lit(DEFAULT_FONT))), F.when(s.isNotNull(), F.coalesce(s["size"], F.lit(DEFAULT_SIZE)))


def numbered(pages: DataFrame, keep: Callable[[Column], Column], outer: bool = False) -> DataFrame:
    """(doc_id, page_number, width, height, seq, b): a page's kept raw blocks, numbered densely from 0.

    With outer, a page that keeps none has one row, of null seq and b.
    """
    shaped = F.transform("blocks", lambda b: F.struct(b.alias("raw"), X.block_text(b["lines"]).alias("text")))
    explode = F.posexplode_outer if outer else F.posexplode
    return pages.select(*PAGE, "width", "height", explode(F.filter(shaped, keep)).alias("seq", "b"))


def page_id(suffix: str, number: Column | None = None) -> Column:
    args = [F.col("page_number")] + ([number] if number is not None else [])
    return F.format_string("p%d" + suffix, *args)


def finish(df: DataFrame, stage: str, confidence: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Derives direction and counts from text and gives the columns of block rows; without a confidence the text is scored."""
    df = df.withColumns({"m__": X.measures(F.col("text")), "rtl_ratio": X.rtl_ratio(F.col("text"))})
    return df.withColumns({
        "confidence": X.measured_confidence(F.col("m__")) if confidence is None else confidence, "direction": X.direction(F.col("rtl_ratio")),
        "word_count": F.col("m__.words"), "char_count": F.col("m__.chars"), "stage_ord": F.lit(STAGES.index(stage)), "source_stage": F.lit(stage),
    }).select(*BLOCK, *extra)


def direct(pages: DataFrame, outer: bool = False) -> DataFrame:
    """Stage 1: text blocks of at least two characters, scored by their text.

    With outer, rows have width and height too, and a page without blocks has one row, of null seq.
    """
    rows = numbered(pages, lambda b: (b["raw"]["type"] == 0) & (F.length(b["text"]) >= 2), outer)
    font, size = font_info(F.col("b.raw.lines"))
    rows = rows.select(*PAGE, "width", "height", "seq", page_id("_b%d", F.col("seq")).alias("block_id"), F.col("b.raw.bbox").alias("bbox"), F.col("b.text").alias("text"), font.alias("font"), size.alias("size"))
    return finish(rows, "direct", extra=("width", "height") if outer else ())


def needs_ocr(threshold: float = 0.3) -> Column:
    return (F.col("confidence") < threshold) | (F.col("word_count") < 3) | (X.strip(F.col("text")) == "")


def improves(ocr_text: Column, text: Column) -> Column:
    """OCR text is taken if it is not empty and strictly longer."""
    return (F.length(ocr_text) > 0) & (X.char_count(ocr_text) > X.char_count(text))


def block_ocr(blocks: DataFrame, ocr: Ocr, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Stage 2: weak blocks read again; the better text is a new block in the same place."""
    read = ocr(blocks.where(needs_ocr(cfg.confidence_threshold)))
    better = read.where(improves(F.col("ocr_text"), F.col("text"))).select(
        *PAGE, "seq", F.concat("block_id", F.lit("_ocr")).alias("block_id"), "bbox", X.strip(F.col("ocr_text")).alias("text"), "font", "size"
    )
    return finish(better, "block_ocr", F.lit(OCR_CONFIDENCE["block_ocr"]))


def page_stats(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, width, height, total_chars, coverage) with pages that have no block."""
    sums = blocks.groupBy(*PAGE).agg(F.sum("char_count").alias("total_chars"), F.sum(G.area(F.col("bbox"))).alias("covered"))
    joined = pages.select(*PAGE, "width", "height").join(sums, list(PAGE), "left")
    size = F.col("width") * F.col("height")
    return joined.select(
        *PAGE, "width", "height", F.coalesce("total_chars", F.lit(0)).alias("total_chars"),
        F.when(size > 0, F.coalesce("covered", F.lit(0.0)) / size * 100).otherwise(F.lit(0.0)).alias("coverage"),
    )


def needs_full_page(cfg: PipelineConfig = PipelineConfig()) -> Column:
    weak = (F.col("total_chars") < cfg.full_page_min_chars) | (F.col("coverage") < cfg.text_coverage_threshold)
    return weak | (F.col("page_number") == 1) if cfg.first_page_always else weak


def full_page_ocr(stats: DataFrame, ocr: Ocr, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Stage 3: one block over the whole page where the direct text is thin."""
    asked = stats.where(needs_full_page(cfg)).withColumn("bbox", G.box(0.0, 0.0, F.col("width"), F.col("height")))
    read = ocr(asked).withColumn("text", X.strip(F.col("ocr_text"))).where(F.length("text") > 0)
    rows = read.select(*PAGE, F.lit(0).alias("seq"), page_id("_full_ocr").alias("block_id"), "bbox", "text", F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size"))
    return finish(rows, "full_page_ocr", F.lit(OCR_CONFIDENCE["full_page_ocr"]))


def grid(pages: DataFrame, dpi: int = 300) -> DataFrame:
    """(doc_id, page_number, cell, bbox): nine cells a page, whole in raster pixels, in page units."""
    wide, high = F.floor(F.col("width") * dpi / 72), F.floor(F.col("height") * dpi / 72)
    cells = pages.select(*PAGE, "width", "height", wide.alias("iw"), high.alias("ih"), F.explode(G.grid_cells(wide, high)).alias("c"))
    return cells.select(*PAGE, F.col("c.cell").alias("cell"), G.to_points(F.col("c.bbox"), F.col("width"), F.col("height"), F.col("iw"), F.col("ih")).alias("bbox"))


def sparse_cells(pages: DataFrame, blocks: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Cells that no block overlaps, numbered per page among themselves; pages with enough text have none.

    A page's boxes are gathered beside its cells once (pages are small), so the anti join is a filter.
    """
    sums = blocks.groupBy(*PAGE).agg(F.sum("char_count").alias("total_chars"), F.collect_list("bbox").alias("boxes"))
    few = pages.select(*PAGE, "width", "height").join(sums, list(PAGE), "left").where(F.coalesce("total_chars", F.lit(0)) <= cfg.grid_max_chars)
    boxes = F.coalesce("boxes", F.array().cast(blocks.select(F.array("bbox").alias("b")).schema["b"].dataType))
    wide, high = F.floor(F.col("width") * cfg.dpi / 72), F.floor(F.col("height") * cfg.dpi / 72)
    cells = F.transform(
        G.grid_cells(wide, high), lambda c: F.struct(c["cell"].alias("cell"), G.to_points(c["bbox"], F.col("width"), F.col("height"), wide, high).alias("bbox"))
    )
    few = few.select(*PAGE, boxes.alias("boxes"), cells.alias("cells"))
    free = F.filter("cells", lambda c: ~F.exists("boxes", lambda b: G.iou(c["bbox"], b) > cfg.grid_overlap))
    return few.select(*PAGE, F.posexplode(free).alias("seq", "c")).select(*PAGE, "seq", "c.cell", "c.bbox")


def grid_ocr(cells: DataFrame, ocr: Ocr) -> DataFrame:
    """Stage 4: text of sparse cells."""
    read = ocr(cells).withColumn("text", X.strip(F.col("ocr_text"))).where(F.length("text") > 0)
    rows = read.select(*PAGE, "seq", page_id("_grid%d", F.col("seq")).alias("block_id"), "bbox", "text", F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size"))
    return finish(rows, "grid_ocr", F.lit(OCR_CONFIDENCE["grid_ocr"]))


def images(raw: DataFrame, ocr: Ocr, folder: str | None = None) -> DataFrame:
    """Image rows: id, place (default box where none is known), OCR text, confidence 0.7 or 0."""
    path = F.format_string(f"{folder}/page%d_img%d.%s", "page_number", "img_index", "format") if folder else F.lit(None).cast("string")
    read = ocr(raw.withColumn("bbox", F.coalesce("bbox", G.box(*DEFAULT_IMAGE_BOX))))
    text = X.strip(F.col("ocr_text"))
    return read.select(
        *PAGE, "img_index", page_id("_img%d", F.col("img_index")).alias("image_id"), "bbox", path.alias("image_path"), text.alias("ocr_text"),
        F.when(F.length(text) > 0, OCR_CONFIDENCE["image_ocr"]).otherwise(0.0).alias("confidence"), "format",
    )


def image_ocr(found: DataFrame) -> DataFrame:
    """Stage 5: a block for each image with text."""
    rows = found.where(F.length("ocr_text") > 0).select(
        *PAGE, F.col("img_index").alias("seq"), F.concat("image_id", F.lit("_text")).alias("block_id"), "bbox", F.col("ocr_text").alias("text"),
        F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size"),
    )
    return finish(rows, "image_ocr", F.lit(OCR_CONFIDENCE["image_ocr"]))


def union_stages(*stages: DataFrame) -> DataFrame:
    """All blocks of all stages; (stage_ord, seq) keeps their order."""
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def structured(pages: DataFrame, raw_images: DataFrame | None = None, ocr: Ocr | None = None, threshold: float = 0.1) -> DataFrame:
    """Structured pages: text blocks read directly or by OCR, image blocks with the page's first image.

    One numbering covers both kinds, and only kept blocks count.
    """
    shaped = F.transform("blocks", lambda b: F.struct(b.alias("raw"), X.block_text(b["lines"]).alias("text")))
    rows = pages.select(*PAGE, "width", "height", F.explode(shaped).alias("b")).select(*PAGE, "width", "height", F.col("b.raw").alias("raw"), F.col("b.text").alias("found"))
    text = F.when(F.length("found") >= 3, F.col("found")).otherwise(F.lit(""))
    texts = rows.where("raw.type = 0").withColumn("direct_text", text).withColumn("direct_confidence", X.structured_confidence(F.col("direct_text")))
    weak = F.col("direct_confidence") < threshold
    if ocr is None:
        read = texts.withColumn("ocr_text", F.lit("")).withColumn("by_ocr", weak)
    else:
        asked = ocr(texts.where(weak).withColumn("bbox", F.col("raw.bbox")).withColumn("seq", F.col("raw.raw_seq")).withColumn("text", F.col("found"))).drop("bbox", "seq", "text", "ocr_error")
        read = texts.where(~weak).withColumn("ocr_text", F.lit("")).unionByName(asked).withColumn("by_ocr", weak)
    font, size = font_info(F.col("raw.lines"))
    kept = read.withColumn("text", F.when(F.col("by_ocr"), X.strip(F.col("ocr_text"))).otherwise(F.col("direct_text"))).where(F.length("text") > 0)
    kept = kept.select(
        *PAGE, "width", "raw.raw_seq", F.lit("text").alias("type"), "raw.bbox", F.when(F.col("by_ocr"), "ocr").otherwise("direct").alias("extraction_method"),
        F.when(F.col("by_ocr"), F.lit(STRUCTURED_OCR_CONFIDENCE)).otherwise(F.col("direct_confidence")).alias("confidence"), "text",
        X.rtl_ratio(F.col("text")).alias("rtl_ratio"), font.alias("font"), size.alias("size"), F.lit(None).cast("string").alias("ocr_text"),
    ).withColumn("direction", X.direction_two_way(F.col("rtl_ratio")))
    if raw_images is not None:
        first = raw_images.where("img_index = 0").select(*PAGE, "bytes", "format")
        places = rows.where("raw.type = 1").join(first, list(PAGE))
        got = ocr(places.withColumn("bbox", F.col("raw.bbox"))) if ocr else places.withColumn("bbox", F.col("raw.bbox")).withColumn("ocr_text", F.lit(""))
        has = F.length(X.strip(F.col("ocr_text"))) > 0
        kept = kept.unionByName(
            got.select(*PAGE, "width", "raw.raw_seq", F.lit("image").alias("type"), "bbox", F.lit("ocr").alias("extraction_method"),
                       F.when(has, F.lit(STRUCTURED_IMAGE_CONFIDENCE)).otherwise(0.0).alias("confidence"), X.strip(F.col("ocr_text")).alias("ocr_text"), "format"),
            allowMissingColumns=True,
        )
    return with_columns(number_blocks(kept))


def number_blocks(kept: DataFrame) -> DataFrame:
    """block_id from a block's place among the kept ones of its page."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("raw_seq")) - 1
    return kept.withColumn("seq", k).withColumn("block_id", page_id("_b%d", F.col("seq"))).drop("raw_seq")


def with_columns(blocks: DataFrame) -> DataFrame:
    """Adds each page's number of columns and each block's column; text blocks alone decide the number.

    Counts by a window on the page, whose partitioning the numbering already has.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*PAGE)
    is_text = F.col("type") == "text"
    n = column_count(*[F.count_if(is_text & c).over(w) for c in thirds(F.col("bbox"), F.col("width"))])
    out = blocks.withColumn("columns", n)
    return out.withColumn("column", G.assign_column(F.col("bbox"), F.col("width"), F.col("columns")))


def thirds(bbox: Column, width: Column) -> tuple[Column, Column, Column]:
    """Whether a box's centre is in the left, middle or right third."""
    x = G.center_x(bbox)
    return x < width / 3, (x >= width / 3) & (x < width * 2 / 3), x >= width * 2 / 3


def column_count(left: Column, middle: Column, right: Column) -> Column:
    return (
        F.when(left + middle + right < 2, 1).when((left > 0) & (right > 0) & (middle < 2), 2).when((left > 0) & (middle > 0) & (right > 0), 3).otherwise(1)
    )


def hybrid(pages: DataFrame, ocr: Ocr | None = None, threshold: float = 0.1) -> DataFrame:
    """Hybrid pages: the first parser's text if it is valid, else the second's; OCR where that scores too low.

    A null alt_text says that there is one parser only.
    """
    rows = pages.select(*PAGE, "width", "height", "text", "alt_text", X.validate_page_text(F.col("text"), threshold).alias("one"))
    two = F.when(F.col("alt_text").isNull(), F.col("one")).otherwise(X.validate_page_text(F.col("alt_text"), threshold))
    rows = rows.select(*PAGE, "width", "height", "text", F.coalesce("alt_text", "text").alias("alt"), "one", F.when(F.col("one.valid"), F.col("one")).otherwise(two).alias("two"))
    rows = rows.select(
        *PAGE, "width", "height", F.coalesce(F.when(F.col("one.valid"), F.col("text")).otherwise(F.col("alt")), F.lit("")).alias("text"),
        F.when(F.col("one.valid"), F.col("one.confidence")).otherwise(F.col("two.confidence")).alias("confidence"),
    ).withColumn("method", F.when(F.col("confidence") > threshold, "direct").otherwise("ocr"))
    if ocr is None:
        return rows.withColumn("confidence", F.when(F.col("method") == "ocr", F.lit(HYBRID_OCR_CONFIDENCE)).otherwise(F.col("confidence")))
    read = ocr(rows.where("method = 'ocr'")).withColumn("text", F.col("ocr_text")).withColumn("confidence", F.lit(HYBRID_OCR_CONFIDENCE)).select(rows.columns)
    return rows.where("method = 'direct'").unionByName(read)
