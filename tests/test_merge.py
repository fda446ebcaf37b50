"""The merge against a small model written from its definition, and the golden document."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from foliospark.config import PRIORITY, STAGES, PipelineConfig
from foliospark.operators import cleaning, merge, rollups, stages

from .test_geometry import model as iou

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SCHEMA = f"doc_id string, page_number int, stage_ord int, seq int, block_id string, bbox {BOX}, text string, confidence double, source_stage string, font string, size double, direction string, rtl_ratio double, word_count int, char_count int"


def block(page, stage, seq, box, text, confidence=0.5, ratio=0.0):
    return ("d", page, STAGES.index(stage), seq, f"{stage}{seq}", tuple(map(float, box)), text, confidence, stage, None, None, "ltr", ratio, len(text.split()), len(text.strip()))


def expected(rows, key):
    """Greedy choice over a page's list; returns ids, removed, merged."""
    kept, removed, merged = [], 0, 0
    for r in sorted(rows, key=key):
        hit = next((k for k in kept if iou(r[5], k[5]) >= 0.7 and difflib.SequenceMatcher(None, r[6].lower(), k[6].lower()).ratio() > 0.8), None)
        if hit is None:
            kept.append(r)
            continue
        removed += 1
        if PRIORITY[r[8]] > PRIORITY[hit[8]]:
            kept.remove(hit)
            kept.append(r)
            merged += 1
    return [k[4] for k in kept], removed, merged


@pytest.mark.parametrize("order", [("stage_ord", "seq"), ("rev", "seq")])
def test_random_pages(spark, order):
    r = random.Random(11)
    rows = []
    for page in range(1, 25):
        for stage in PRIORITY:
            for seq in range(r.randrange(4)):
                x, y = r.choice([(0, 0), (0, 1), (1, 0), (30, 30)])
                text = r.choice(["hello brave new world", "Hello brave new world!", "hello brave old world", "something else", "", "tide", "diet"])
                rows.append(block(page, stage, seq, (x, y, x + 10, y + 10), text))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rev", -F.col("stage_ord"))
    kept, counters = merge.deduplicate(df, order=order)
    got, count = {}, {c["page_number"]: c for c in counters.collect()}
    for k in kept.orderBy("page_number", "out_seq").collect():
        got.setdefault(k["page_number"], []).append(k["block_id"])
    for page in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == page]
        ids, removed, merged = expected(own, (lambda x: (x[2], x[3])) if order[0] == "stage_ord" else (lambda x: (-x[2], x[3])))
        assert got[page] == ids
        assert (count[page]["total_input_blocks"], count[page]["duplicates_removed"], count[page]["blocks_merged"]) == (len(own), removed, merged)


def test_chain_is_greedy(spark):
    texts = ["aaaaaaaaaabbbbbbbbbb", "aaaaaaaaaabbbbbbbxyz", "aaaaaaaaaabbbbqrsxyz"]
    rows = [block(1, "direct", i, (0, 0, 10, 10), t) for i, t in enumerate(texts)]
    ids, _, _ = expected(rows, lambda x: x[3])
    assert [k["block_id"] for k in merge.deduplicate(spark.createDataFrame(rows, SCHEMA))[0].orderBy("out_seq").collect()] == ids == ["direct0", "direct2"]


def test_similarity_is_not_symmetric(spark):
    df = spark.createDataFrame([(["tide", "ab" * 150], ["diet", "ba" * 150])], "a array<string>, b array<string>")
    assert df.select(merge.similarities("a", "b")).first()[0] == [0.25, 0.0]
    assert df.select(merge.similarities("b", "a")).first()[0] == [0.5, 0.0]


def test_golden_page(spark):
    """The figures of a published one-page result."""
    one = (295.32000732421875, 507.53997802734375, 663.3380126953125, 525.6472778320312)
    title = "Chapter 8: hash functions and data integrity for the course one"  # stands in for the scanned text
    rows = [
        block(1, "direct", 0, one, "1 ©MSA 2025/2026", 0.046), block(1, "full_page_ocr", 0, (0, 0, 720, 540), title, 0.75),
        block(1, "image_ocr", 0, (0, 0, 719, 539), title[:52], 0.7),
    ]
    blocks = spark.createDataFrame(rows, SCHEMA)
    pages = spark.createDataFrame([("d", 1, 720.0, 540.0)], "doc_id string, page_number int, width double, height double")
    kept, _ = merge.deduplicate(blocks)
    done = cleaning.post_process(kept)
    assert [r["block_id"] for r in done.orderBy("out_seq").collect()] == ["direct0", "full_page_ocr0"]
    p = rollups.page_summary(pages, done).first()
    assert round(p["text_coverage"], 2) == 101.71 and round(p["total_confidence"], 2) == 0.4
    assert cleaning.page_columns(pages, done).first()["columns"] == 1


@pytest.mark.parametrize("l, m, r, n", [(0, 0, 0, 1), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 2), (1, 2, 1, 3), (0, 2, 2, 1), (2, 0, 0, 1)])
def test_column_count(spark, l, m, r, n):  # noqa: E741
    assert spark.range(1).select(stages.column_count(F.lit(l), F.lit(m), F.lit(r))).first()[0] == n


def test_page_without_blocks(spark):
    pages = spark.createDataFrame([("d", 1, 0.0, 540.0), ("d", 2, 10.0, 10.0)], "doc_id string, page_number int, width double, height double")
    blocks = spark.createDataFrame([block(1, "direct", 0, (0, 0, 1, 1), "xx")], SCHEMA)
    rows = {r["page_number"]: r for r in rollups.page_summary(pages, blocks).collect()}
    assert rows[1]["text_coverage"] == 0.0 and rows[2]["total_confidence"] == 0.0 and rows[2]["n_blocks"] == 0
    doc = rollups.document_summary(rollups.page_summary(pages, blocks)).first()
    assert (doc["total_pages"], doc["total_blocks"], doc["avg_confidence"]) == (2, 1, 0.5)
    assert {r["columns"] for r in cleaning.page_columns(pages, blocks).collect()} == {1}


@pytest.mark.parametrize("chars, coverage, page, needed", [(99, 50.0, 2, True), (100, 20.0, 2, False), (100, 19.9, 2, True), (1000, 90.0, 1, True)])
def test_full_page_rule(spark, chars, coverage, page, needed):
    df = spark.createDataFrame([(chars, coverage, page)], "total_chars int, coverage double, page_number int")
    assert df.select(stages.needs_full_page()).first()[0] is needed
    assert df.select(stages.needs_full_page(PipelineConfig(first_page_always=False))).first()[0] is (needed and page != 1)


def test_grid_rule(spark):
    """A block must cover enough of a cell; pages above 200 characters have no sparse cells; ids count sparse cells."""
    pages = spark.createDataFrame([("d", 1, 90.0, 90.0), ("d", 2, 90.0, 90.0), ("d", 3, 90.0, 90.0)], "doc_id string, page_number int, width double, height double")
    rows = [block(1, "direct", 0, (0, 0, 30, 30), "ab"), block(1, "direct", 1, (40, 40, 42, 42), "ab"), block(2, "direct", 0, (0, 0, 1, 1), "x" * 201)]
    cells = stages.sparse_cells(pages, spark.createDataFrame(rows, SCHEMA)).orderBy("page_number", "seq").collect()
    assert [(c["seq"], c["cell"]) for c in cells if c["page_number"] == 1] == [(i, i + 1) for i in range(8)]
    assert {c["page_number"] for c in cells} == {1, 3}


def test_priority_covers_stages(spark):
    df = spark.createDataFrame([(s,) for s in STAGES], "s string")
    assert dict(df.select("s", merge.priority(F.col("s"))).collect()) == {s: PRIORITY.get(s, 0) for s in STAGES}


def test_moved_copies_keep_long_texts(spark, tmp_path):
    from foliospark.plans import queries

    spark.createDataFrame([(1, "word " * 3000, "en", "a", 15000)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lengths = [len(r["text"]) for r in queries._shifted(spark, str(tmp_path)).select("stage_ord", "text").orderBy("stage_ord").collect()]
    assert lengths == [14999, 14999 - 3 + len(" end")]
