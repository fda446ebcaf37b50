"""Schemas of the tables that operators exchange; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType())])
LINE = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
RAW_BLOCK = T.StructType([
    T.StructField("raw_seq", T.IntegerType()), T.StructField("type", T.IntegerType()), T.StructField("bbox", BOX), T.StructField("lines", T.ArrayType(LINE)),
])
#: A page with its raw blocks in reading order: block numbering and page rules need no shuffle.
RAW_PAGES = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
    T.StructField("text", T.StringType()), T.StructField("alt_text", T.StringType()), T.StructField("blocks", T.ArrayType(RAW_BLOCK)),
])
RAW_IMAGES = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("img_index", T.IntegerType()), T.StructField("xref", T.IntegerType()),
    T.StructField("format", T.StringType()), T.StructField("bbox", BOX), T.StructField("bytes", T.BinaryType()),
])
_JSON_BLOCK = T.StructType([
    T.StructField("block_id", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("source_stage", T.StringType()), T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("direction", T.StringType()),
    T.StructField("rtl_ratio", T.DoubleType()), T.StructField("word_count", T.IntegerType()), T.StructField("column", T.IntegerType()),
])
_JSON_IMAGE = T.StructType([
    T.StructField("image_id", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("image_path", T.StringType()),
    T.StructField("ocr_text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("format", T.StringType()),
])
_COUNTS = T.MapType(T.StringType(), T.LongType())
_JSON_PAGE = T.StructType([
    T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("columns", T.IntegerType()),
    T.StructField("text_coverage", T.DoubleType()), T.StructField("total_confidence", T.DoubleType()), T.StructField("execution_time", T.DoubleType()),
    T.StructField("stage_stats", _COUNTS), T.StructField("blocks", T.ArrayType(_JSON_BLOCK)), T.StructField("images", T.ArrayType(_JSON_IMAGE)),
])
#: The nested JSON document that the sink writes and the reader reads.
DOCUMENT_JSON = T.StructType([
    T.StructField("document", T.StructType([
        T.StructField("filename", T.StringType()), T.StructField("total_pages", T.IntegerType()), T.StructField("total_blocks", T.IntegerType()),
        T.StructField("total_images", T.IntegerType()), T.StructField("avg_confidence", T.DoubleType()), T.StructField("total_execution_time", T.DoubleType()),
        T.StructField("stage_stats", _COUNTS), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ])),
    T.StructField("pages", T.ArrayType(_JSON_PAGE)),
])
