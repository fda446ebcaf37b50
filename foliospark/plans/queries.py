"""The catalogue of queries over the synthetic layout. Each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MODES, PipelineConfig, stages_of
from ..functions import geometry as G
from ..functions import text as X
from ..operators import cleaning, merge, rollups, stages
from ..operators.stages import PAGE
from ..runtime import scratch_path
from ..sinks import documents as sink
from ..sources import layout
from ..sources.files import document_blocks, read_documents
from . import extraction
from .oracles import FIXED_FONTS, LATIN, RTL

ENGINES = extraction.fixture_engines()


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return stages.direct(layout.pages(spark, sf))


def block_scan(spark, sf):
    b = F.col("bbox")
    return _blocks(spark, sf).select(*PAGE, "seq", "block_id", "text", *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


def block_counts(spark, sf):
    return _blocks(spark, sf).select(*PAGE, "seq", "word_count", "char_count")


def block_confidence(spark, sf):
    return _blocks(spark, sf).select(*PAGE, "seq", "confidence", (F.col("confidence") >= 0.3).alias("high"))


def page_text_validation(spark, sf):
    v = X.validate_page_text(F.col("text"))
    return layout.pages(spark, sf).select(*PAGE, v["valid"].alias("valid"), v["confidence"].alias("confidence"))


def structured_confidence(spark, sf):
    c = X.structured_confidence(F.col("text"))
    return _blocks(spark, sf).select(*PAGE, "seq", c.alias("confidence"), (c < 0.1).alias("needs_ocr"))


def _mixed_script(spark, sf):
    """Every third block right to left, and of every third the first 40 characters."""
    t = F.translate("text", LATIN, RTL)
    half = F.concat(F.translate(F.substring("text", 1, 40), "abcdefghijklmnopqrstuvwxyz", "ا" * 26), F.expr("substring(text, 41)"))
    return _blocks(spark, sf).withColumn("text", F.when(F.col("seq") % 3 == 0, t).when(F.col("seq") % 3 == 1, half).otherwise(F.col("text")))


def direction_three_way(spark, sf):
    r = X.rtl_ratio(F.col("text"))
    return _mixed_script(spark, sf).select(*PAGE, "seq", r.alias("rtl_ratio"), X.direction(r).alias("direction"))


def direction_two_way(spark, sf):
    r = X.rtl_ratio(F.col("text"))
    return _mixed_script(spark, sf).select(*PAGE, "seq", X.direction_two_way(r).alias("direction"))


def font_info(spark, sf):
    rows = [(i, [([tuple(s) for s in line],) for line in lines] if lines is not None else None) for i, lines in FIXED_FONTS]
    df = literal_rows(spark, "i int, lines array<struct<spans:array<struct<text:string,font:string,size:double>>>>", rows)
    font, size = stages.font_info(F.col("lines"))
    return df.select("i", font.alias("font"), size.alias("size"), X.block_text(F.col("lines")).alias("text"))


def ocr_candidates(spark, sf):
    return _blocks(spark, sf).where(stages.needs_ocr()).select(*PAGE, "seq", "text")


def ocr_accept(spark, sf):
    return stages.block_ocr(_blocks(spark, sf), ENGINES.block).select(*PAGE, "seq", "block_id", "text", "confidence", "word_count", "char_count")


def full_page_trigger(spark, sf):
    pages = layout.pages(spark, sf)
    s = stages.page_stats(pages, stages.direct(pages))
    return s.select(*PAGE, "total_chars", "coverage", stages.needs_full_page().alias("needs_full_page"))


def grid_cells(spark, sf):
    b = F.col("bbox")
    return stages.grid(layout.pages(spark, sf)).select(*PAGE, "cell", *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


def grid_sparse(spark, sf):
    pages = layout.pages(spark, sf)
    return stages.sparse_cells(pages, stages.direct(pages)).select(*PAGE, "seq", "cell")


def _shifted(spark, sf):
    """Direct blocks and, for each, one moved by a tenth of its width: two boxes a place."""
    direct = _blocks(spark, sf)
    b = F.col("bbox")
    dx = (b["x1"] - b["x0"]) / 8
    moved = direct.where("seq % 2 = 0").withColumns({
        "bbox": G.box(b["x0"] + dx, b["y0"], b["x1"] + dx, b["y1"]), "stage_ord": F.lit(1), "source_stage": F.lit("block_ocr"),
        "text": F.concat(F.expr("substring(text, 4)"), F.lit(" end")), "block_id": F.concat("block_id", F.lit("_ocr")),
    })
    return direct.unionByName(moved)


def iou_pairs(spark, sf):
    pairs = merge.overlapping_pairs(_shifted(spark, sf))
    return pairs.select(*PAGE, "later", "earlier", F.round("iou", 9).alias("iou"))


def similarity_pairs(spark, sf):
    return merge.similar_pairs(_shifted(spark, sf)).select(*PAGE, "later", "earlier", F.round("similarity", 9).alias("similarity"))


def _with_copies(spark, sf):
    """Direct blocks and, for every third, an upper-case copy from a later stage in the same place."""
    direct = _blocks(spark, sf)
    copy = direct.where("seq % 3 = 0").withColumns({
        "stage_ord": F.lit(1), "source_stage": F.lit("block_ocr"), "block_id": F.concat("block_id", F.lit("_ocr")),
        "text": F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    })
    return direct.unionByName(copy)


def dedup_exact(spark, sf):
    kept, _ = merge.deduplicate(_with_copies(spark, sf))
    return kept.select(*PAGE, "out_seq", "block_id")


def dedup_counters(spark, sf):
    return merge.deduplicate(_with_copies(spark, sf))[1]


def dedup_priority_reversed(spark, sf):
    rows = _with_copies(spark, sf).withColumn("rev", -F.col("stage_ord"))
    kept, _ = merge.deduplicate(rows, order=("rev", "seq"))
    return kept.select(*PAGE, "out_seq", "block_id")


def dedup_general(spark, sf):
    return merge.deduplicate(_shifted(spark, sf))[0].select(*PAGE, "out_seq", "block_id")


def arabic_normalize(spark, sf):
    return _mixed_script(spark, sf).select(*PAGE, "seq", X.normalize_arabic(F.col("text")).alias("text"))


def broken_words(spark, sf):
    return _blocks(spark, sf).select(*PAGE, "seq", X.fix_broken_words(F.col("text")).alias("text"))


def _noisy(spark, sf):
    t = F.when(F.col("seq") % 3 == 0, F.replace("text", F.lit(". "), F.lit(".... "))).when(F.col("seq") % 3 == 1, F.replace("text", F.lit(" "), F.lit(" --- "))).otherwise(F.col("text"))
    return _blocks(spark, sf).withColumn("text", t)


def ocr_artifacts(spark, sf):
    return _noisy(spark, sf).select(*PAGE, "seq", X.remove_artifacts(F.col("text")).alias("text"))


def punct_spacing(spark, sf):
    return _noisy(spark, sf).select(*PAGE, "seq", X.normalize_spacing(F.col("text")).alias("text"))


def post_process(spark, sf):
    return cleaning.post_process(_noisy(spark, sf)).select(*PAGE, "seq", "text", "word_count", "char_count", "fixed", "source_stage")


def post_process_counters(spark, sf):
    return rollups.cleaning_counters(cleaning.post_process(_noisy(spark, sf)))


def column_detect(spark, sf):
    pages = layout.pages(spark, sf)
    return cleaning.page_columns(pages, stages.direct(pages))


def column_assign(spark, sf):
    pages = layout.pages(spark, sf)
    blocks = stages.direct(pages)
    return cleaning.assign_columns(pages, blocks, cleaning.page_columns(pages, blocks)).select(*PAGE, "seq", "column")


def stage_stats_page(spark, sf):
    return rollups.stage_counts(_with_copies(spark, sf), *PAGE)


def stage_stats_doc(spark, sf):
    return rollups.stage_counts(_with_copies(spark, sf), "doc_id")


def stage_stats_maps(spark, sf):
    maps = rollups.as_map(rollups.stage_counts(_with_copies(spark, sf), "doc_id"), "doc_id")
    return maps.select("doc_id", *[F.coalesce(F.try_element_at("stage_stats", F.lit(s)), F.lit(0)).alias(f"n_{s}") for s in ("direct", "block_ocr")])


def stage_summary(spark, sf):
    return rollups.stage_summary(_with_copies(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 9))


def page_summary(spark, sf):
    pages = layout.pages(spark, sf)
    return rollups.page_summary(pages, stages.direct(pages)).withColumn("total_confidence", F.round("total_confidence", 9))


def document_summary(spark, sf):
    pages = layout.pages(spark, sf)
    rows = rollups.page_summary(pages, stages.direct(pages))
    return rollups.document_summary(rows).withColumn("avg_confidence", F.round("avg_confidence", 9))


def high_low_counts(spark, sf):
    return rollups.direct_counters(_blocks(spark, sf))


def stage_union(spark, sf):
    rows = stages.union_stages(_blocks(spark, sf), stages.block_ocr(_blocks(spark, sf), ENGINES.block))
    return merge.ordered(rows).select(*PAGE, "ord", "block_id", "source_stage")


def viewer_filters(spark, sf):
    rows = _with_copies(spark, sf)
    each = [rollups.viewer_filter(rows, n).select(F.lit(n).alias("view"), *PAGE, "block_id") for n in ("all", "direct", "ocr", "rtl")]
    return stages.union_stages(*each).groupBy("view", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def hybrid_routing(spark, sf):
    return stages.hybrid(layout.pages(spark, sf)).select(*PAGE, "method", "confidence")


def hybrid_methods(spark, sf):
    return rollups.pages_by_method(stages.hybrid(layout.pages(spark, sf)))


def hybrid_full_text(spark, sf):
    return rollups.full_text(stages.hybrid(layout.pages(spark, sf)))


def structured_blocks(spark, sf):
    rows = stages.structured(layout.pages(spark, sf))
    return rows.select(*PAGE, "block_id", "type", "extraction_method", "confidence", "direction", "column", "columns")


def structured_counts(spark, sf):
    return rollups.structured_counts(stages.structured(layout.pages(spark, sf)))


def coordinate_scaling(spark, sf):
    b, w, h = F.col("bbox"), F.lit(576.0), F.lit(768.0)
    px = G.to_pixels(b, w, h, F.lit(2400.0), F.lit(3200.0))
    pt = G.to_points(px, w, h, F.lit(2400.0), F.lit(3200.0))
    cols = ("x0", "y0", "x1", "y1")
    return _blocks(spark, sf).select(*PAGE, "seq", *[px[c].alias(f"p{c}") for c in cols], *[F.round(pt[c], 6).alias(f"q{c}") for c in cols])


def _images(spark, sf):
    """Three images on every page, the second without a place."""
    place = F.when(F.col("img_index") == 1, F.lit(None)).otherwise(G.box(0.0, 0.0, 100.0 + F.col("img_index"), 50.0))
    pages = layout.pages(spark, sf).select(*PAGE, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("img_index"))
    return pages.select(*PAGE, "img_index", (F.col("img_index") + 10).alias("xref"), F.lit("png").alias("format"), place.alias("bbox"), F.lit(b"\x89").alias("bytes"))


def image_blocks(spark, sf):
    found = stages.images(_images(spark, sf), ENGINES.image, "out")
    cols = [F.col("bbox")[c].alias(c) for c in ("x0", "y0", "x1", "y1")]
    return found.select(*PAGE, "image_id", "image_path", "ocr_text", "confidence", "format", *cols)


def image_counters(spark, sf):
    found = stages.images(_images(spark, sf), ENGINES.image)
    blocks = stages.image_ocr(found)
    return found.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.length("ocr_text") > 0).alias("images_with_text")).join(
        blocks.select(*PAGE, "block_id", "word_count"), list(PAGE)
    )


def stage_counters(spark, sf):
    """What the OCR stages of a thorough run ask for and get, per page."""
    pages, cfg = layout.pages(spark, sf), PipelineConfig(mode="thorough")
    direct, frame = stages.direct(pages), pages.select(*PAGE, "width", "height")
    found = [direct, stages.block_ocr(direct, ENGINES.block, cfg), stages.full_page_ocr(stages.page_stats(frame, direct), ENGINES.page, cfg)]
    cells = stages.sparse_cells(frame, stages.union_stages(*found), cfg)
    images = stages.images(_images(spark, sf), ENGINES.image)
    every = stages.union_stages(*found, stages.grid_ocr(cells, ENGINES.cell), stages.image_ocr(images))
    weak = direct.where(stages.needs_ocr(cfg.confidence_threshold))
    asked = [rows.select(*PAGE, F.lit(name).alias("counter")) for rows, name in ((weak, "blocks_processed"), (cells, "grid_regions"))]
    return rollups.stage_counters(frame, every, asked, images)


def hybrid_images(spark, sf):
    """Images per page of the hybrid path; those with a place only."""
    rows, _ = extraction.run_hybrid(layout.pages(spark, sf), raw_images=_images(spark, sf).where("bbox is not null"))
    return rows.select(*PAGE, "method", "images_count")


def run_summary(spark, sf):
    pages = layout.pages(spark, sf)
    docs = rollups.document_summary(rollups.page_summary(pages, stages.direct(pages)))
    return rollups.run_summary(docs).withColumn("avg_confidence", F.round("avg_confidence", 9))


def mode_stage_matrix(spark, sf):
    rows = [(m, s.block_ocr, s.full_page_ocr, s.grid_ocr, s.image_ocr) for m in (*MODES, "other") for s in [stages_of(m)]]
    return literal_rows(spark, "mode string, block_ocr boolean, full_page_ocr boolean, grid_ocr boolean, image_ocr boolean", rows)


def job_status(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outcome = docs.select(F.col("source").alias("job_id"), F.col("doc_id").alias("file"), F.when(F.length("text") < 100, F.lit("too short")).alias("error"))
    return rollups.job_status(outcome)


def output_names(spark, sf):
    rows = literal_rows(spark, "name string", [("a.pdf",), ("a.b.PDF",), ("noext",), (".hidden",), ("dir.d.pdf",)])
    return rows.select("name", sink.output_name(F.col("name"), "_intelligent.json").alias("out"))


def seven_stages(spark, sf):
    """The whole seven-stage run, thorough mode, with stand-in engines."""
    r = extraction.run(layout.pages(spark, sf), ENGINES, _images(spark, sf), PipelineConfig(mode="thorough"))
    return r.pages.withColumn("total_confidence", F.round("total_confidence", 9)).withColumn("text_coverage", F.round("text_coverage", 6))


def json_roundtrip(spark, sf):
    """Writes the run's documents as JSON and reads their blocks back."""
    pages, images = layout.pages(spark, sf), _images(spark, sf)
    r = extraction.run(pages, ENGINES, images, PipelineConfig(mode="fast"))
    docs = r.documents.select(
        "doc_id", F.format_string("%d.pdf", "doc_id").alias("filename"), F.col("total_pages").cast("int"), F.col("total_blocks").cast("int"), F.col("total_images").cast("int"), "avg_confidence",
        F.lit(0.0).alias("total_execution_time"), F.create_map(F.lit("format"), F.lit("synthetic")).alias("metadata"),
    )
    tree = sink.nested(docs, r.pages.withColumn("execution_time", F.lit(0.0)), r.blocks, r.images)
    path = scratch_path(spark)
    sink.write_json(tree, path)
    back = document_blocks(read_documents(spark, path))
    return back.select("filename", "page_number", "out_seq", "block_id", "text", "confidence", "word_count", "column")


QUERIES = {
    f.__name__: f
    for f in (
        block_scan, block_counts, block_confidence, page_text_validation, structured_confidence, direction_three_way, direction_two_way, font_info, ocr_candidates,
        ocr_accept, full_page_trigger, grid_cells, grid_sparse, iou_pairs, similarity_pairs, dedup_exact, dedup_counters, dedup_priority_reversed, dedup_general,
        arabic_normalize, broken_words, ocr_artifacts, punct_spacing, post_process, post_process_counters, column_detect, column_assign, stage_stats_page,
        stage_stats_doc, stage_stats_maps, stage_summary, page_summary, document_summary, high_low_counts, stage_union, viewer_filters, hybrid_routing, hybrid_methods,
        hybrid_full_text, structured_blocks, structured_counts, coordinate_scaling, image_blocks, image_counters, stage_counters, hybrid_images, run_summary, mode_stage_matrix, job_status, output_names,
        seven_stages, json_roundtrip,
    )
}
