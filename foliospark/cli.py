"""python -m foliospark.cli IN OUT [--way seven|structured|hybrid] [--mode ...] [--engine ...]: PDFs of a folder to files.

Beside OUT it writes OUT_status (a row per file with its error, if it could not be read) and, with --extract_images, the
image files to OUT_images; structured pages go to OUT as rows of blocks and to OUT_structure as one JSON per document.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import MODES, PipelineConfig
from .operators import rollups
from .plans import extraction
from .sinks import documents as sink
from .sources import files, pdf

#: How each way prepares images for OCR.
METHODS = {"seven": "pipeline", "structured": "adaptive", "hybrid": "all"}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("source", help="folder of PDFs, any that Spark reads")
    p.add_argument("out", help="folder to write to")
    p.add_argument("--way", choices=("seven", "structured", "hybrid"), default="seven")
    p.add_argument("--mode", default="balanced", help=", ".join(MODES))
    p.add_argument("--lang", default="ara+eng")
    p.add_argument("--dpi", type=int, default=300)
    p.add_argument("--engine", choices=("none", "tesseract", "easyocr"), default="none")
    p.add_argument("--extract_images", action="store_true", help="write image files; OUT must be a folder that all executors have")
    given = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    cfg = PipelineConfig(lang=given.lang, mode=given.mode, dpi=given.dpi, ocr_engine=given.engine)
    engines = extraction.no_engines() if given.engine == "none" else extraction.ocr_engines(cfg, METHODS[given.way])
    out = given.out.rstrip("/")
    found = files.uploads(spark, given.source)
    pages, images, info = pdf.pages_of(found), pdf.images_of(found), pdf.info_of(found)
    name = files.safe_name(F.col("doc_id")).alias("filename")
    if given.way == "structured":
        blocks = extraction.run_structured(pages, engines.block, images if given.extract_images else None, cfg)
        blocks.write.json(out)
        heads = info.where("error is null").select("doc_id", name, "total_pages", "metadata")
        sink.structured_lines(sink.structured_tree(heads, pages, blocks)).select("value").write.text(f"{out}_structure")
    elif given.way == "hybrid":
        rows, text = extraction.run_hybrid(pages, engines.page, cfg, images)
        sink.write_text(text, out)
        rows.drop("text").write.json(f"{out}_pages")
    else:
        r = extraction.run(pages, engines, images, cfg, f"{out}_images" if given.extract_images else None)
        share = F.lit(sum(r.seconds.values()) / max(1, r.pages.count()))  # files are read together: a page's share of the run
        heads = r.documents.join(info.select("doc_id", "metadata"), "doc_id").select(
            "doc_id", name, *[F.col(c).cast("int") for c in ("total_pages", "total_blocks", "total_images")], "avg_confidence", (share * F.col("total_pages")).alias("total_execution_time"), "metadata"
        )
        sink.write_json(sink.nested(heads, r.pages.withColumn("execution_time", share), r.blocks, r.images), out)
        rollups.run_summary(r.documents).show()
    if given.extract_images:
        stem = sink.output_name(files.safe_name(F.col("doc_id")), "_images")
        sink.write_files(sink.image_files(images, stem), f"{out}_images")
    info.select(F.lit("run").alias("job_id"), name, "total_pages", "error").write.json(f"{out}_status")


if __name__ == "__main__":
    main()
