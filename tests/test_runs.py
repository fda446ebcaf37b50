"""Whole runs against a model of the seven stages in plain Python, and what runs count, write and report."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from foliospark.config import PRIORITY, PipelineConfig
from foliospark.operators import rollups
from foliospark.plans import extraction, queries
from foliospark.sinks import documents as sink
from foliospark.sources import pdf
from foliospark.sources.layout import pages_from_texts
from tests.test_sources_sinks import make_pdf

TEXTS = {
    1: "a\nb c\nfirst line of some words here\nx\n" + "\n".join(f"line {i} with words enough to score, and a th e split" for i in range(20)),
    2: "", 3: None, 4: "one\n\ntwo words\n" + "\n".join("same line of text" for _ in range(6)), 5: "é à ü\nzz\n" + "long " * 200, 6: "\n" * 15 + "last page only words",
}


def score(text, few=3):
    words = text.split()
    if not words:
        return 0.0
    if len(words) < few:
        return 0.2
    if sum(len(w) == 1 for w in words) / len(words) > 0.5:
        return 0.3
    return min(1.0, len(words) / 50.0 * 0.5 + len(text.strip()) / 500.0 * 0.5)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return None
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def cleaned(t):
    t = re.sub(r"\b(\w)\s+(\w)\b", r"\1\2", t)
    for a, b in (("th e", "the"), ("an d", "and"), ("i s", "is")):
        t = t.replace(a, b)
    t = re.sub(r"\.{3,}", "...", re.sub(r"[|~`]{2,}", "", re.sub(r"\s+[|~`]\s+", " ", t)))
    t = re.sub(r"\s+", " ", re.sub(r"-{3,}", "--", t)).strip()
    return re.sub(r"([.,!?;:])\s*", r"\1 ", re.sub(r"\s+([.,!?;:])", r"\1", t))


def page_model(doc, number, lines, mode, with_images=True):
    """Final blocks, images, columns and counters of one page."""
    ncols = 1 + doc % 3
    wide, blocks, n = 576 / ncols, [], dict.fromkeys(("blocks_processed", "blocks_improved", "grid_regions", "regions_with_text", "images", "images_with_text"), 0)
    kept = [(slot, line.strip()) for slot, line in enumerate(lines) if len(line.strip()) >= 2]
    for seq, (slot, t) in enumerate(kept):
        x, y = slot % ncols * wide + 16, slot // ncols * 64
        blocks.append({"id": f"p{number}_b{seq}", "box": (x, y, x + wide - 32, y + 48), "text": t, "conf": score(t), "stage": "direct", "seq": seq})
    direct = list(blocks)
    for b in direct:
        if b["conf"] < 0.3 or len(b["text"].split()) < 3:
            n["blocks_processed"] += 1
            t = b["text"]
            read = (t, t + " recovered words", t[:3], "", "different " + t[::-1])[b["seq"] % 5]
            if read and len(read.strip()) > len(t):
                n["blocks_improved"] += 1
                blocks.append(b | {"id": b["id"] + "_ocr", "text": read.strip(), "conf": 0.8, "stage": "block_ocr"})
    chars = sum(len(b["text"]) for b in direct)
    cover = sum((b["box"][2] - b["box"][0]) * (b["box"][3] - b["box"][1]) for b in direct) / (576 * 768) * 100
    if mode != "fast" and (chars < 100 or cover < 20 or number == 1):
        blocks.append({"id": f"p{number}_full_ocr", "box": (0, 0, 576, 768), "text": f"scan of page {number}", "conf": 0.75, "stage": "full_page_ocr"})
    if mode == "thorough" and sum(len(b["text"]) for b in blocks) <= 200:
        sx, sy = 576 / 2400, 768 / 3200
        cells = [(c, (800 * (c % 3) * sx, 1066 * (c // 3) * sy, 800 * (c % 3 + 1) * sx, 1066 * (c // 3 + 1) * sy)) for c in range(9)]
        free = [(c, box) for c, box in cells if not any((iou(box, b["box"]) or 0) > 0.3 for b in blocks)]
        n["grid_regions"] = len(free)
        for k, (c, box) in enumerate(free):
            if c % 2 == 0:
                n["regions_with_text"] += 1
                blocks.append({"id": f"p{number}_grid{k}", "box": box, "text": f"cell {c}", "conf": 0.7, "stage": "grid_ocr"})
    images = []
    if with_images:
        for i in range(3):
            images.append(f"p{number}_img{i}")
            if i == 0:
                blocks.append({"id": f"p{number}_img0_text", "box": (0, 0, 100, 50), "text": "words in an image", "conf": 0.7, "stage": "image_ocr"})
        n |= {"images": 3, "images_with_text": 1}
    out = []
    for b in blocks:
        match = next((k for k in out if (o := iou(b["box"], k["box"])) is not None and o >= 0.7 and difflib.SequenceMatcher(None, b["text"].lower(), k["text"].lower()).ratio() > 0.8), None)
        if match is None:
            out.append(b)
        elif PRIORITY.get(b["stage"], 0) > PRIORITY.get(match["stage"], 0):
            out.remove(match)
            out.append(b)
    for b in out:
        b["text"] = cleaned(b["text"])
    x = [(b["box"][0] + b["box"][2]) / 2 for b in out]
    left, right = sum(v < 192 for v in x), sum(v >= 384 for v in x)
    middle = len(x) - left - right
    columns = 1 if len(x) < 2 else 2 if left and right and middle < 2 else 3 if left and middle and right else 1
    return out, images, columns, n


def pages_of(texts):
    for doc, t in texts.items():
        lines = t.split("\n") if t is not None else []
        for p in range(0, len(lines), 12):
            yield doc, p // 12 + 1, lines[p : p + 12]


@pytest.fixture(scope="module")
def texts_frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


@pytest.mark.parametrize("mode", ["fast", "balanced", "thorough"])
def test_run_against_model(spark, texts_frame, mode):
    pages = pages_from_texts(texts_frame)
    images = pages.select("doc_id", "page_number", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("img_index")).select(
        "*", F.lit(1).alias("xref"), F.lit("png").alias("format"), F.when(F.col("img_index") != 1, F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(50.0).alias("y1"))).alias("bbox"), F.lit(b"x").alias("bytes")
    )
    r = extraction.run(pages, extraction.fixture_engines(), images, PipelineConfig(mode=mode))
    blocks, counts = {}, {}
    summary = {(x["doc_id"], x["page_number"]): x for x in r.pages.collect()}
    for b in r.blocks.orderBy("out_seq").collect():
        blocks.setdefault((b["doc_id"], b["page_number"]), []).append((b["block_id"], b["text"], round(b["confidence"], 9), b["char_count"]))
    for m in r.stage_metrics.collect():
        counts[m["doc_id"], m["page_number"]] = m
    want = {(doc, number): page_model(doc, number, lines, mode) for doc, number, lines in pages_of(TEXTS)}
    assert summary.keys() == want.keys() and len(want) > 6
    for key, (out, found, columns, n) in want.items():
        assert blocks.get(key, []) == [(b["id"], b["text"], round(b["conf"], 9), len(b["text"].strip())) for b in out]
        p = summary[key]
        assert (p["n_blocks"], p["n_images"], p["columns"]) == (len(out), len(found), columns)
        assert p["total_confidence"] == pytest.approx(sum(b["conf"] for b in out) / len(out) if out else 0.0)
        assert p["text_coverage"] == pytest.approx(sum((b["box"][2] - b["box"][0]) * (b["box"][3] - b["box"][1]) for b in out) / (576 * 768) * 100)
        if key in counts:
            assert {k: counts[key][k] for k in n} == n
    assert set(r.seconds) >= {"direct", "ocr", "merged", "post_processed"}


def test_seven_stages_query(spark, sf):
    """The registered query is the thorough run over the whole table."""
    got = {(r["doc_id"], r["page_number"]): r for r in queries.QUERIES["seven_stages"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(doc, number): page_model(doc, number, lines, "thorough") for doc, number, lines in pages_of(texts)}
    assert got.keys() == want.keys()
    wrong = [k for k, (out, found, columns, _) in want.items() if (got[k]["n_blocks"], got[k]["n_images"], got[k]["columns"], got[k]["n_chars"]) != (len(out), len(found), columns, sum(len(b["text"].strip()) for b in out))]
    assert not wrong


def test_json_roundtrip_query(spark, sf):
    got = {(r["filename"], r["page_number"], r["out_seq"]): (r["block_id"], r["text"], r["confidence"]) for r in queries.QUERIES["json_roundtrip"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {}
    for doc, number, lines in pages_of(texts):
        out, *_ = page_model(doc, number, lines, "fast")
        want |= {(f"{doc}.pdf", number, k): (b["id"], b["text"], round(b["conf"], 2)) for k, b in enumerate(out)}
    assert got == want


def test_pages_are_read_once(spark, texts_frame):
    """However many steps a run has, the source's Python or scan runs once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    pages = pages_from_texts(texts_frame)
    once = pages.mapInPandas(count, pages.schema)
    r = extraction.run(once, extraction.fixture_engines(), None, PipelineConfig(mode="thorough"))
    r.pages.count(), r.stage_metrics.count(), r.blocks.count()
    assert seen.value == len(list(pages_of(TEXTS)))


def test_job_states(spark):
    rows = [("a", "1", None, True, None), ("a", "2", "bad", True, None), ("b", "1", None, True, None), ("b", "2", None, False, None), ("c", "1", None, True, "disk")]
    got = {r["job_id"]: r for r in rollups.job_status(spark.createDataFrame(rows, "job_id string, file string, error string, done boolean, failure string")).collect()}
    assert {k: (r["total"], r["results"], r["errors"], r["status"]) for k, r in got.items()} == {"a": (2, 1, 1, "completed"), "b": (2, 1, 0, "processing"), "c": (1, 1, 0, "error")}


def test_hybrid_images(spark):
    pages = pages_from_texts(spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(15)))], "doc_id long, text string"))
    images = spark.createDataFrame([(1, 1, 0, "png", b"abc"), (1, 1, 1, "jpeg", b"d")], "doc_id long, page_number int, img_index int, format string, bytes binary")
    rows, _ = extraction.run_hybrid(pages, raw_images=images)
    assert {r["page_number"]: r["images_count"] for r in rows.collect()} == {1: 2, 2: 0}
    assert [tuple(x) for x in rollups.document_images(images).first()["images"]] == [(1, 0, "png", 3, "page1_img0.png"), (1, 1, "jpeg", 1, "page1_img1.jpeg")]


def test_run_summary(spark):
    docs = spark.createDataFrame([("a", 2, 5, 1, 0.5), ("b", 1, 0, 0, 0.0)], "doc_id string, total_pages long, total_blocks long, total_images long, avg_confidence double")
    assert tuple(rollups.run_summary(docs).first()) == (2, 3, 5, 1, 0.5)


def test_structured_json(spark, tmp_path):
    pages = pages_from_texts(spark.createDataFrame([(1, "four words are here\nab"), (2, "")], "doc_id long, text string"))
    blocks = extraction.run_structured(pages)
    heads = spark.createDataFrame([(1, "a.pdf", 1, {"title": "t"}), (2, "b.pdf", 1, {})], "doc_id long, filename string, total_pages int, metadata map<string,string>")
    got = {r["doc_id"]: json.loads(r["value"]) for r in sink.structured_lines(sink.structured_tree(heads, pages, blocks)).collect()}
    assert got[1]["document"] == {"filename": "a.pdf", "total_pages": 1, "metadata": {"title": "t"}}
    (block,) = got[1]["pages"][0]["blocks"]
    assert list(block) == ["block_id", "type", "bbox", "extraction_method", "confidence", "text", "direction", "rtl_ratio", "font", "size", "column"]
    assert (block["block_id"], block["text"], block["confidence"], got[1]["pages"][0]["columns"]) == ("p1_b0", "four words are here", 0.4, 1)
    assert got[2]["pages"][0]["blocks"] == []


def test_files_and_clear(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0, "png", b"abc"), ("b", 2, 1, "jpeg", b"")], "doc_id string, page_number int, img_index int, format string, bytes binary")
    for _ in range(2):  # a second time changes nothing
        sink.write_files(sink.image_files(rows, F.concat("doc_id", F.lit("_images"))), str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a_images/page1_img0.png", "b_images/page2_img1.jpeg"]
    assert (tmp_path / "a_images/page1_img0.png").read_bytes() == b"abc"
    sink.write_files(sink.text_files(spark.createDataFrame([("/x/a.pdf", "é")], "doc_id string, full_text string")), str(tmp_path))
    assert (tmp_path / "a.txt").read_text() == "é"
    assert sink.clear(str(tmp_path)) == 1 and (tmp_path / "a_images").is_dir()


def packed_pdf():
    """A PDF whose page tree is in an object stream, with a font of two-byte codes and an image that is drawn."""
    import zlib

    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [5 0 R] /MediaBox [0 0 200 100] >>", 5: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << /F1 7 0 R >> /XObject << /Im 9 0 R >> >> >>", 7: b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /ToUnicode 8 0 R >>"}
    at, head, body = 0, b"", b""
    for n, x in inner.items():
        head += b"%d %d " % (n, at)
        body += x + b" "
        at = len(body)
    packed = zlib.compress(head + body)
    text = b"q 50 0 0 20 10 30 cm /Im Do Q BT /F1 10 Tf 20 80 Td <00010002> Tj ET BT /F1 10 Tf 20 90 Td <0003> Tj ET"
    cmap = b"1 beginbfchar <0001> <0645> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    objects = {
        3: b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(inner), len(head), len(packed)) + packed + b"\nendstream",
        4: b"<< /Type /XRef /Root 1 0 R /Size 9 /Length 0 >>\nstream\n\nendstream", 6: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(text), text),
        8: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap), 9: b"<< /Subtype /Image /Filter /DCTDecode >>\nstream\nJPEG\nendstream",
    }
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"startxref\n0\n%%EOF"


def test_packed_pdf():
    (row,) = pdf.page_rows("x", packed_pdf())
    assert row[2:6] == (200.0, 100.0, "مa\nb", "b\nمa")  # as drawn, and from top to bottom
    (image,) = pdf.image_rows("x", packed_pdf())
    assert image[5] == (10.0, 50.0, 60.0, 70.0) and image[6] == b"JPEG"


def test_encrypted_pdf_is_an_error(spark):
    locked = make_pdf(["secret"]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")
    files = spark.createDataFrame([("a", bytearray(locked)), ("b", bytearray(make_pdf(["open"])))], "path string, content binary")
    assert [r["doc_id"] for r in pdf.pages_of(files).collect()] == ["b"]
    assert {r["doc_id"]: r["error"] for r in pdf.info_of(files).collect()} == {"a": "encrypted PDF", "b": None}
