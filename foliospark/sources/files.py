"""File sources: uploaded PDFs and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_UPLOAD_BYTES
from ..schema import DOCUMENT_JSON

PDF_GLOB = "*.[pP][dD][fF]"


def safe_name(path):
    """The last part of a path with anything unusual made an underscore."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\s+", "_"), r"[^A-Za-z0-9_.-]", "")


def uploads(spark: SparkSession, folder: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """(path, filename, length, content) of PDFs up to a size; content is read only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PDF_GLOB).load(folder)
    return files.where(F.col("length") <= max_bytes).select("path", safe_name(F.col("path")).alias("filename"), "length", "content")


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON documents as the sink writes them (one per line), or indented ones (multi_line)."""
    return spark.read.schema(DOCUMENT_JSON).option("multiLine", str(multi_line).lower()).json(path)


def document_blocks(documents: DataFrame) -> DataFrame:
    """One row per block of read documents, in order."""
    pages = documents.select("document.filename", F.explode("pages").alias("p"))
    return pages.select("filename", "p.page_number", F.posexplode("p.blocks").alias("out_seq", "b")).select("filename", "page_number", "out_seq", "b.*")
