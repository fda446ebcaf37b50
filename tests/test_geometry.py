import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G


def rows_of(spark, rows, *columns):
    df = spark.createDataFrame([(*a, *b) for a, b in rows], "a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    a, b = (G.box(*[F.col(f"{n}{i}") for i in range(4)]) for n in "ab")
    df = df.select(a.alias("a"), b.alias("b"))
    return [tuple(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def model(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_iou(spark):
    r = random.Random(1)
    boxes = [(x, y, x + r.randint(0, 6), y + r.randint(0, 6)) for x, y in ((r.randint(-3, 6), r.randint(-3, 6)) for _ in range(200))]
    boxes += [(0, 0, 1, 1), (1, 0, 2, 1), (0, 0, 0, 0), (0, 0, 10, 7), (0, 0, 10, 10)]
    pairs = [(r.choice(boxes), r.choice(boxes)) for _ in range(400)] + [((0, 0, 10, 7), (0, 0, 10, 10)), ((0, 0, 1, 1), (1, 0, 2, 1)), ((0, 0, 0, 0),) * 2]
    pairs = [tuple(tuple(map(float, x)) for x in p) for p in pairs]
    got = rows_of(spark, pairs, G.iou(F.col("a"), F.col("b")), G.overlaps(F.col("a"), F.col("b")), G.overlaps(F.col("a"), F.col("b"), 0.0))
    for (a, b), (iou, over, any_) in zip(pairs, got, strict=True):
        assert iou == pytest.approx(model(a, b)) and over == (model(a, b) >= 0.7)
        apart = min(a[2], b[2]) < max(a[0], b[0]) or min(a[3], b[3]) < max(a[1], b[1])
        assert any_ == (not apart)


@pytest.mark.parametrize("x, width, n, column", [(99, 300, 3, 1), (100, 300, 3, 2), (250, 300, 3, 3), (300, 300, 3, 3), (-50, 300, 3, 1), (-150, 300, 3, 0), (50, 0, 1, 1), (50, 0, 2, None)])
def test_columns(spark, x, width, n, column):
    got = rows_of(spark, [((float(x),) * 4, (0.0,) * 4)], G.assign_column(F.col("a"), F.lit(float(width)), F.lit(n)))[0][0]
    assert got == (column if column is not None else n)


def test_grid_and_scaling(spark):
    cells = spark.range(1).select(F.inline(G.grid_cells(F.lit(100.0), F.lit(50.0)))).collect()
    assert [c["cell"] for c in cells] == list(range(9)) and tuple(cells[8]["bbox"]) == (66.0, 32.0, 99.0, 48.0)
    px, back = rows_of(spark, [((10.5, 20.0, 30.0, 40.9), (0.0,) * 4)], G.to_pixels(F.col("a"), F.lit(100.0), F.lit(100.0), F.lit(200.0), F.lit(200.0)), G.to_points(F.col("a"), F.lit(100.0), F.lit(100.0), F.lit(200.0), F.lit(200.0)))[0]
    assert tuple(px) == (21, 40, 60, 81) and tuple(back) == (5.25, 10.0, 15.0, 20.45)
