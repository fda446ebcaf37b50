"""Nested JSON and text sinks. Numbers are rounded here and nowhere else."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

PAGE = ("doc_id", "page_number")


def output_name(filename: Column, suffix: str) -> Column:
    """stem + suffix; names without a dot, or with only a leading one, keep everything."""
    stem = F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", "")
    return F.concat(stem, F.lit(suffix))


def nested(documents: DataFrame, pages: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, document, pages) in the layout of schema.DOCUMENT_JSON, unrounded.

    documents: doc_id, filename, total_pages, total_blocks, total_images, avg_confidence, total_execution_time, metadata;
    pages: page summary with columns and execution_time; blocks have out_seq and column; images have img_index.
    """
    box = lambda c: F.array(*[F.col(f"{c}.{k}") for k in ("x0", "y0", "x1", "y1")]).alias(c)
    counts = lambda *by: blocks.groupBy(*by, "source_stage").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_stage", "n")))).alias("stage_stats")
    )
    block = F.struct("block_id", box("bbox"), "text", "confidence", "source_stage", "font", "size", "direction", "rtl_ratio", F.col("word_count").cast("int").alias("word_count"), "column")
    image = F.struct("image_id", box("bbox"), "image_path", "ocr_text", "confidence", "format")
    in_order = lambda c, by: F.transform(F.array_sort(c, lambda x, y: F.signum(x[by] - y[by]).cast("int")), lambda x: x["b"])
    b = blocks.groupBy(*PAGE).agg(in_order(F.collect_list(F.struct("out_seq", block.alias("b"))), "out_seq").alias("blocks"))
    i = images.groupBy(*PAGE).agg(in_order(F.collect_list(F.struct("img_index", image.alias("b"))), "img_index").alias("images"))
    full = pages.join(counts(*PAGE), list(PAGE), "left").join(b, list(PAGE), "left").join(i, list(PAGE), "left")
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType))
    page = F.struct(
        "page_number", "width", "height", "columns", "text_coverage", "total_confidence", "execution_time", F.coalesce("stage_stats", F.create_map().cast("map<string,bigint>")).alias("stage_stats"),
        none("blocks", b).alias("blocks"), none("images", i).alias("images"),
    )
    docs = documents.join(counts("doc_id"), "doc_id", "left")
    head = F.struct(
        "filename", "total_pages", "total_blocks", "total_images", "avg_confidence", "total_execution_time",
        F.coalesce("stage_stats", F.create_map().cast("map<string,bigint>")).alias("stage_stats"), "metadata",
    )
    pages_ = full.groupBy("doc_id").agg(in_order(F.collect_list(F.struct("page_number", page.alias("b"))), "page_number").alias("pages"))
    return docs.select("doc_id", head.alias("document")).join(pages_, "doc_id", "left")


ROUNDED = {"avg_confidence", "total_execution_time", "text_coverage", "total_confidence", "execution_time", "confidence", "rtl_ratio"}


def rounded(value, key: str = ""):
    """A copy with the rounded fields at two places, by Python's rule (half to even on the binary value)."""
    if isinstance(value, dict):
        return {k: rounded(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [rounded(v) for v in value]
    return round(value, 2) if key in ROUNDED and isinstance(value, float) else value


def json_lines(tree: DataFrame, indent: int | None = None) -> DataFrame:
    """(doc_id, value) with one JSON text per document; characters are not escaped."""
    ship(tree.sparkSession)
    text = tree.select("doc_id", F.to_json(F.struct("document", "pages"), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            yield pdf.assign(value=[json.dumps(rounded(json.loads(v)), ensure_ascii=False, indent=indent) for v in pdf["value"]])

    return text.mapInPandas(run, text.schema)


def write_json(tree: DataFrame, path: str) -> None:
    """One JSON document per line."""
    json_lines(tree).select("value").write.text(path)


def structured_tree(documents: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, document, pages) of structured pages, unrounded; pages that kept no block have an empty list.

    documents: doc_id, filename, total_pages, metadata; pages: (doc_id, page_number, width, height); blocks as
    operators.stages.structured gives them. Text and image blocks have the fields of both; json_lines drops null ones.
    """
    image = F.when(F.col("type") == "image", F.format_string("page%d_img%d.%s", "page_number", "seq", F.coalesce("format", F.lit("png")))) if "format" in blocks.columns else F.lit(None).cast("string")
    box = F.array(*[F.col(f"bbox.{k}") for k in ("x0", "y0", "x1", "y1")])
    block = F.struct("block_id", "type", box.alias("bbox"), "extraction_method", "confidence", "text", "direction", "rtl_ratio", "font", "size", image.alias("image_path"), "ocr_text", "column")
    listed = blocks.groupBy(*PAGE).agg(F.max("columns").alias("columns"), F.sort_array(F.collect_list(F.struct("seq", block.alias("b")))).alias("x"))
    full = pages.select(*PAGE, "width", "height").join(listed, list(PAGE), "left")
    kept = F.coalesce(F.transform("x", lambda x: x["b"]), F.array().cast(listed.select(F.transform("x", lambda x: x["b"]).alias("b")).schema["b"].dataType))
    page = F.struct("page_number", "width", "height", F.coalesce("columns", F.lit(1)).alias("columns"), kept.alias("blocks"))
    ordered = full.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", page.alias("p")))).alias("x"))
    head = F.struct("filename", "total_pages", "metadata").alias("document")
    return documents.select("doc_id", head).join(ordered.select("doc_id", F.transform("x", lambda x: x["p"]).alias("pages")), "doc_id", "left")


#: Fields that only one kind of structured block has.
BY_KIND = {"text": ("text", "direction", "rtl_ratio", "font", "size"), "image": ("image_path", "ocr_text")}


def structured_lines(tree: DataFrame, indent: int | None = None) -> DataFrame:
    """(doc_id, value): structured documents as JSON; a block has the fields of its kind, text blocks without a font neither
    font nor size, image blocks no extraction method."""
    ship(tree.sparkSession)
    text = tree.select("doc_id", F.to_json(F.struct("document", "pages"), {"ignoreNullFields": "false"}).alias("value"))

    def shaped(b: dict) -> dict:
        leave = {*BY_KIND["image" if b["type"] == "text" else "text"]} | ({"extraction_method"} if b["type"] == "image" else set())
        leave |= {"font", "size"} if b.get("font") is None else set()
        return {k: v for k, v in b.items() if k not in leave}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            trees = [json.loads(v) for v in pdf["value"]]
            for t in trees:
                for page in t.get("pages") or ():
                    page["blocks"] = [shaped(b) for b in page["blocks"]]
            yield pdf.assign(value=[json.dumps(rounded(t), ensure_ascii=False, indent=indent) for t in trees])

    return text.mapInPandas(run, text.schema)


def write_files(files: DataFrame, folder: str) -> None:
    """(name, bytes) rows as files of a folder that all executors have mounted; names may have folders.

    A file is written beside its place and then renamed, so a task that runs twice leaves whole files.
    """
    ship(files.sparkSession)
    top = folder.removeprefix("file://")

    def put(rows) -> None:
        import os
        import uuid

        for r in rows:
            path = os.path.join(top, r["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            own = f"{path}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(bytes(r["bytes"] or b""))
            os.replace(own, path)

    files.select("name", "bytes").foreachPartition(put)


def write_text(texts: DataFrame, path: str) -> None:
    """(doc_id, full_text): one JSON line per document, which any number of documents allows."""
    texts.select("doc_id", "full_text").write.json(path)


def text_files(texts: DataFrame, suffix: str = ".txt") -> DataFrame:
    """(name, bytes) of one text file per document, for write_files."""
    last = F.regexp_extract(F.col("doc_id").cast("string"), r"([^/\\]*)$", 1)
    return texts.select(output_name(last, suffix).alias("name"), F.col("full_text").cast("binary").alias("bytes"))


def image_files(images: DataFrame, folder: Column | None = None) -> DataFrame:
    """(name, bytes) of image files, of each document in a folder of its own if one is given; for write_files."""
    name = F.format_string("page%d_img%d.%s", "page_number", "img_index", "format")
    return images.select((F.concat(folder, F.lit("/"), name) if folder is not None else name).alias("name"), "bytes")


def clear(folder: str) -> int:
    """Removes the files at the top of a local folder and leaves its folders, such as those of images; how many went."""
    import os

    files = [f.path for f in os.scandir(folder) if f.is_file()]
    for f in files:
        os.remove(f)
    return len(files)
