"""Whole runs: source tables in, block, image, page, document and metric tables out. """

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import cleaning, merge, rollups, stages
from ..operators.stages import PAGE, Ocr
from ..runtime import materialise


@dataclass(frozen=True)
class Engines:
    """How each kind of region is read; each takes rows and returns them with ocr_text."""

    block: Ocr
    page: Ocr
    cell: Ocr
    image: Ocr


@dataclass(frozen=True)
class Results:
    blocks: DataFrame
    images: DataFrame | None
    pages: DataFrame
    documents: DataFrame
    stage_metrics: DataFrame
    #: Seconds of the run's written steps; lazy roll-ups are not in them.
    seconds: dict[str, float]


def run(pages: DataFrame, engines: Engines, raw_images: DataFrame | None = None, cfg: PipelineConfig = PipelineConfig(), image_folder: str | None = None) -> Results:
    """The seven stages. A stage that the mode leaves out is not in the plan.

    Pages are read once: what the first stage writes has each page's size, whether it has blocks or not. The blocks of all
    stages, merged pages and final blocks are written once too: later steps read them several times, and no region is
    read by OCR twice.
    """
    on, seconds = cfg.stages, {}

    def written(step: str, df: DataFrame) -> DataFrame:
        began = time.monotonic()
        out = materialise(df)
        seconds[step] = time.monotonic() - began
        return out

    rows = written("direct", stages.direct(pages, outer=True))
    direct = rows.where("seq is not null").drop("width", "height")
    frame = rows.where("coalesce(seq, 0) = 0").select(*PAGE, "width", "height")
    found, asked = [direct], []
    if on.block_ocr:
        found.append(stages.block_ocr(direct, engines.block, cfg))
        asked.append(direct.where(stages.needs_ocr(cfg.confidence_threshold)).select(*PAGE, F.lit("blocks_processed").alias("counter")))
    if on.full_page_ocr:
        found.append(stages.full_page_ocr(stages.page_stats(frame, direct), engines.page, cfg))
    if on.grid_ocr:
        cells = stages.sparse_cells(frame, stages.union_stages(*found), cfg)
        if len(found) > 1:
            cells = written("grid_cells", cells)
        found.append(stages.grid_ocr(cells, engines.cell))
        asked.append(cells.select(*PAGE, F.lit("grid_regions").alias("counter")))
    images = None
    if on.image_ocr and raw_images is not None:
        images = written("image_ocr", stages.images(raw_images, engines.image, image_folder))
        found.append(stages.image_ocr(images))
    every = written("ocr", stages.union_stages(*found))
    solved = written("merged", merge.solve(every, cfg))
    blocks = written("post_processed", cleaning.with_columns(cleaning.post_process(merge.kept(solved), cfg), frame))
    page_rows = rollups.page_summary(frame, blocks, images, columns=True)
    counters = merge.counters(solved).join(rollups.cleaning_counters(blocks), list(PAGE), "left").join(rollups.direct_counters(direct, cfg.confidence_threshold), list(PAGE), "left")
    counters = counters.join(rollups.stage_counters(frame, every, asked, images), list(PAGE), "left")
    metrics = rollups.stage_summary(every).join(counters, list(PAGE), "left")
    return Results(blocks.drop("reshaped", "fixed", "columns"), images, page_rows, rollups.document_summary(page_rows), metrics, seconds)


def run_structured(pages: DataFrame, ocr: Ocr | None = None, raw_images: DataFrame | None = None, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    return stages.structured(pages, raw_images, ocr, cfg.structured_threshold)


def run_hybrid(pages: DataFrame, ocr: Ocr | None = None, cfg: PipelineConfig = PipelineConfig(), raw_images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page rows, full text per document); with images, page rows have images_count."""
    rows = stages.hybrid(pages, ocr, cfg.hybrid_threshold)
    text = rollups.full_text(rows)
    return rows if raw_images is None else rollups.page_images(rows, raw_images), text


def fixture_engines() -> Engines:
    """Deterministic stand-ins, all in the JVM."""
    from ..operators.ocr import fixture_text

    return Engines(
        block=lambda df: df.withColumn("ocr_text", fixture_text(F.col("text"), F.col("seq"))),
        page=lambda df: df.withColumn("ocr_text", F.format_string("scan of page %d", "page_number")),
        cell=lambda df: df.withColumn("ocr_text", F.when(F.col("cell") % 2 == 0, F.format_string("cell %d", "cell")).otherwise("")),
        image=lambda df: df.withColumn("ocr_text", F.when(F.col("img_index") == 0, F.lit("words in an image")).otherwise("")),
    )


def ocr_engines(cfg: PipelineConfig = PipelineConfig(), method: str | None = "pipeline") -> Engines:
    """Real engines by the config's name; a row's doc_id must be a path that workers can open.

    method prepares images: pipeline for the seven stages, adaptive for structured pages, all for hybrid ones.
    """
    from ..operators.ocr import make_engine, read_regions

    name, lang, languages = cfg.ocr_engine, cfg.lang, cfg.engine_languages

    def reader(kind: str) -> Ocr:
        return lambda df: read_regions(df.withColumn("path", F.col("doc_id").cast("string")), lambda: make_engine(name, lang, languages, method), kind, cfg.dpi).drop("path")

    return Engines(block=reader("region"), page=reader("page"), cell=reader("region"), image=reader("image"))


def no_engines() -> Engines:
    """For runs without OCR: nothing is recognised."""
    nothing: Ocr = lambda df: df.withColumn("ocr_text", F.lit(""))
    return Engines(nothing, nothing, nothing, nothing)
