"""PDF reading, JSON and text sinks, uploads, streaming."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.config import PipelineConfig, stages_of
from foliospark.operators import ocr, rollups, stages
from foliospark.plans import extraction
from foliospark.sinks import documents as sink
from foliospark.sources import files, pdf
from foliospark.sources.layout import pages_from_texts
from foliospark.streaming import arrivals


def make_pdf(texts, squeeze=True, title="A (small) one"):
    """A PDF with one page per text; a text's lines are shown one below the other."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >>"}
    kids = []
    for k, text in enumerate(texts):
        shown = b"".join(b"(" + line.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T* " for line in text.split("\n"))
        body = b"BT /F1 14 Tf 16 TL 72 700 Td " + shown + b"ET"
        extra = b" /Filter /FlateDecode" if squeeze else b""
        body = zlib.compress(body) if squeeze else body
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (11 + 2 * k)
        objects[11 + 2 * k] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), extra, body)
        kids.append(b"%d 0 R" % (10 + 2 * k))
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d /MediaBox [0 0 612 792] >>" % len(texts)
    objects[4] = b"<< /Title (" + title.replace("(", "\\(").replace(")", "\\)").encode() + b") /Producer (by hand) >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer\n<< /Root 1 0 R /Info 4 0 R >>\n%%EOF"


@pytest.mark.parametrize("squeeze", [True, False])
def test_pdf_pages(squeeze):
    rows = list(pdf.page_rows("x", make_pdf(["Hello (world)\nsecond \\ line", "page two"], squeeze)))
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [(1, 612.0, 792.0, "Hello (world)\nsecond \\ line"), (2, 612.0, 792.0, "page two")]
    (seq, kind, box, lines), *_ = rows[0][6]
    assert (seq, kind, len(lines)) == (0, 0, 2) and box[0] == 72.0 and box[1] == pytest.approx(792 - 700 - 14)
    assert lines[0][0][0] == ("Hello (world)", "Times-Roman", 14.0)


def test_pdf_info_and_errors():
    info = pdf.Pdf(make_pdf(["x"])).info()
    assert (info["format"], info["title"], info["producer"], info["encryption"]) == ("PDF 1.4", "A (small) one", "by hand", None)
    with pytest.raises(ValueError):
        pdf.Pdf(b"nothing")


def test_data_source(spark, tmp_path):
    for name, texts in (("a.pdf", ["one two three four five six"]), ("b.PDF", ["x\ny", "z"])):
        (tmp_path / name).write_bytes(make_pdf(texts))
    (tmp_path / "c.txt").write_text("no")
    pdf.register(spark)
    pages = spark.read.format("folio_pdf").load(str(tmp_path))
    assert sorted((r["doc_id"][-5:], r["page_number"]) for r in pages.collect()) == [("a.pdf", 1), ("b.PDF", 1), ("b.PDF", 2)]
    blocks = stages.direct(pages).collect()
    assert sorted(b["text"] for b in blocks) == ["one two three four five six", "x y"]
    found = files.uploads(spark, str(tmp_path))
    assert sorted(r["filename"] for r in found.collect()) == ["a.pdf", "b.PDF"]
    assert files.uploads(spark, str(tmp_path), max_bytes=1).count() == 0
    same = pdf.pages_of(found)
    assert same.schema == pages.schema and sorted(r["text"] for r in same.collect()) == sorted(r["text"] for r in pages.collect())


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(make_pdf(["first page", "second page"]))
    seen = []
    for _ in range(2):
        query = arrivals.watch(spark, str(folder), str(tmp_path / "state"), lambda df, n: seen.extend((n, r["text"]) for r in stages.direct(df).collect()), once=True)
        query.awaitTermination(120)
        assert arrivals.progress(query)["error"] is None
        (folder / "b.pdf").write_bytes(make_pdf(["third"]))
    assert sorted(seen) == [(0, "first page"), (0, "second page"), (1, "third")]


def test_json_sink_rounds_like_python(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nbc défg\n" + "word " * 30), (2, "")], "doc_id long, text string")
    pages = pages_from_texts(docs)
    r = extraction.run(pages, extraction.fixture_engines(), None, PipelineConfig(mode="fast"))
    heads = r.documents.select("doc_id", F.lit("é.pdf").alias("filename"), F.col("total_pages").cast("int"), F.col("total_blocks").cast("int"), F.col("total_images").cast("int"), F.lit(2.675).alias("avg_confidence"), F.lit(0.125).alias("total_execution_time"), F.create_map(F.lit("title"), F.lit(None).cast("string")).alias("metadata"))
    none = spark.createDataFrame([], "doc_id long, page_number int, img_index int, image_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>, image_path string, ocr_text string, confidence double, format string")
    tree = sink.nested(heads, r.pages.withColumn("execution_time", F.lit(0.155)), r.blocks, none)
    by_id = {x["doc_id"]: json.loads(x["value"]) for x in sink.json_lines(tree).collect()}
    head = by_id[1]["document"]
    assert (head["avg_confidence"], head["total_execution_time"], head["metadata"], head["filename"]) == (2.67, 0.12, {"title": None}, "é.pdf")
    assert by_id[1]["pages"][0]["execution_time"] == 0.15 and by_id[2]["pages"][0]["blocks"] == []
    assert list(by_id[1]["pages"][0]["blocks"][0]) == ["block_id", "bbox", "text", "confidence", "source_stage", "font", "size", "direction", "rtl_ratio", "word_count", "column"]
    sink.write_json(tree, str(tmp_path / "out"))
    back = files.document_blocks(files.read_documents(spark, str(tmp_path / "out")))
    assert back.count() == r.blocks.count() and {b["source_stage"] for b in back.collect()} == {"post_processed"}


def test_text_sink(spark, tmp_path):
    pages = pages_from_texts(spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(15)))], "doc_id long, text string"))
    rows, text = extraction.run_hybrid(pages)
    got = text.first()["full_text"]
    assert got.startswith("\n" + "=" * 50 + "\nPage 1 (DIRECT)\n" + "=" * 50 + "\nline 0\n") and "Page 2" in got
    sink.write_text(text, str(tmp_path / "t"))
    assert {(r["method"], r["n_pages"]) for r in rollups.pages_by_method(rows).collect()} == {("direct", 1), ("ocr", 1)}


class Reader:
    """An engine that fails on one page."""

    def region(self, path, page, box, dpi):
        if page == 2:
            raise OSError("broken")
        return f" {path} {page} {int(box[2])} "

    def page(self, path, page, dpi):
        return f"page {page}"

    def image(self, data):
        return data.decode()


def test_engines_are_isolated(spark):
    df = spark.createDataFrame([("f", 1, (0.0, 0.0, 5.0, 5.0), b"img"), ("f", 2, (0.0, 0.0, 5.0, 5.0), b"\xff")], "path string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, bytes binary")
    region = {r["page_number"]: r for r in ocr.read_regions(df, Reader, "region", 72).collect()}
    assert region[1]["ocr_text"] == " f 1 5 " and region[2]["ocr_text"] == "" and region[2]["ocr_error"] == "broken"
    assert [r["ocr_text"] for r in ocr.read_regions(df, Reader, "page", 72).orderBy("page_number").collect()] == ["page 1", "page 2"]
    assert [r["ocr_text"] for r in ocr.read_regions(df, Reader, "image", 72).orderBy("page_number").collect()] == ["img", ""]


def test_structured_with_images(spark):
    span = lambda t: [([(t, None, None)],)]
    box = (0.0, 0.0, 10.0, 10.0)
    schema = "doc_id string, page_number int, width double, height double, text string, alt_text string, blocks array<struct<raw_seq:int,type:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>,lines:array<struct<spans:array<struct<text:string,font:string,size:double>>>>>>"
    raw = [(0, 0, box, span("four words are here")), (1, 1, box, None), (2, 0, box, span("ab")), (3, 0, box, [])]
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0, "", None, raw)], schema)
    images = spark.createDataFrame([("d", 1, 0, b"x", "png"), ("d", 1, 1, b"y", "png")], "doc_id string, page_number int, img_index int, bytes binary, format string")
    ocr_ = lambda df: df.withColumn("ocr_text", F.lit(" seen "))
    rows = stages.structured(pages, images, ocr_).orderBy("seq").collect()
    assert [(r["block_id"], r["type"], r["extraction_method"], r["text"], r["confidence"]) for r in rows] == [
        ("p1_b0", "text", "direct", "four words are here", 0.4), ("p1_b1", "image", "ocr", None, 0.7), ("p1_b2", "text", "ocr", "seen", 0.8), ("p1_b3", "text", "ocr", "seen", 0.8),
    ]
    assert rows[0]["font"] == "Unknown" and rows[3]["font"] is None
    assert [r["block_id"] for r in stages.structured(pages).orderBy("seq").collect()] == ["p1_b0"]


def test_hybrid_routing(spark):
    rows = [("d", 1, 1.0, 1.0, "one two", None, None), ("d", 2, 1.0, 1.0, "a b c", "enough words to be a valid text of a page " * 3, None), ("d", 3, 1.0, 1.0, None, None, None), ("d", 4, 1.0, 1.0, "ab cd ef gh ij", None, None)]
    schema = "doc_id string, page_number int, width double, height double, text string, alt_text string, blocks array<int>"
    got = {r["page_number"]: r for r in stages.hybrid(spark.createDataFrame(rows, schema), lambda df: df.withColumn("ocr_text", F.lit("scan"))).collect()}
    assert [got[k]["method"] for k in (1, 2, 3, 4)] == ["direct", "direct", "ocr", "ocr"]
    assert got[2]["text"].startswith("enough") and got[3]["text"] == "scan" and got[4]["confidence"] == 0.8


def test_modes():
    assert not stages_of("fast").full_page_ocr and not stages_of("fast").grid_ocr and stages_of("thorough").grid_ocr
    assert stages_of("odd") == stages_of("balanced") and PipelineConfig(lang="eng").engine_languages == ("en",)
    with pytest.raises(ModuleNotFoundError):
        ocr.make_engine("easyocr", "eng", ("en",))


def test_output_names(spark):
    df = spark.createDataFrame([("a.b.pdf",), ("none",), (".x",)], "n string")
    assert [r[0] for r in df.select(sink.output_name(F.col("n"), "_o")).collect()] == ["a.b_o", "none_o", ".x_o"]


@pytest.mark.parametrize("way", ["seven", "structured", "hybrid"])
def test_cli(spark, tmp_path, way):
    from foliospark import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(make_pdf(["these are some words of a page that is read", "two"]))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"no pdf")
    cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--way", way, "--mode", "fast"])
    if way == "seven":
        d = files.read_documents(spark, str(tmp_path / "out")).first()["document"]
        assert (d["filename"], d["total_pages"], d["total_blocks"], d["metadata"]["producer"]) == ("a.pdf", 2, 2, "by hand")
    elif way == "structured":
        assert [r["text"] for r in spark.read.json(str(tmp_path / "out")).orderBy("page_number").collect()] == ["these are some words of a page that is read", "two"]
    else:
        assert "Page 2" in "".join(r["value"] + "\n" for r in spark.read.text(str(tmp_path / "out")).collect())


def test_info_and_images(spark):
    image = b"%PDF-1.4\n1 0 obj\n<< /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Resources << /XObject << /I 4 0 R >> >> >>\nendobj\n4 0 obj\n<< /Subtype /Image /Filter /DCTDecode >>\nstream\nJPEG\nendstream\nendobj\ntrailer << /Root 1 0 R >>"
    df = spark.createDataFrame([("a", bytearray(image)), ("b", bytearray(b"x"))], "path string, content binary")
    (row,) = pdf.images_of(df).collect()
    assert (row["page_number"], row["img_index"], row["xref"], row["format"], bytes(row["bytes"]), row["bbox"]) == (1, 0, 4, "jpeg", b"JPEG", None)
    info = {r["doc_id"]: r for r in pdf.info_of(df).collect()}
    assert info["a"]["total_pages"] == 1 and info["a"]["error"] is None and info["b"]["error"] == "not a PDF"
    found = stages.images(pdf.images_of(df), extraction.no_engines().image).first()
    assert tuple(found["bbox"]) == (0.0, 0.0, 100.0, 100.0) and found["confidence"] == 0.0
