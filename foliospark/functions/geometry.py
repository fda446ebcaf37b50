"""Boxes as Column expressions. Origin top left, units as the page has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    given = zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in given])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes apart and for an empty union, touching boxes meet in area 0."""
    left, top = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    right, low = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    shared = (right - left) * (low - top)
    union = area(a) + area(b) - shared
    return F.when((right < left) | (low < top) | (union <= 0), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(shared, union), F.lit(0.0)))


def overlaps(a: Column, b: Column, threshold: float = 0.7) -> Column:
    """iou >= threshold; boxes that are apart never overlap, whatever the threshold."""
    apart = (F.least(a["x1"], b["x1"]) < F.greatest(a["x0"], b["x0"])) | (F.least(a["y1"], b["y1"]) < F.greatest(a["y0"], b["y0"]))
    return ~apart & (iou(a, b) >= threshold)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def assign_column(b: Column, width: Column, columns: Column) -> Column:
    """1-based column of a box's centre, at most ``columns``; a centre left of the page may give 0 or less."""
    at = F.try_divide(center_x(b), width / columns).cast("int") + 1
    return F.when(columns == 1, F.lit(1)).otherwise(F.least(at, columns))


def to_pixels(b: Column, page_width: Column, page_height: Column, image_width: Column, image_height: Column) -> Column:
    """Page units to whole pixels of a raster, towards zero."""
    sx, sy = image_width / page_width, image_height / page_height
    return F.struct(*[(b[c] * s).cast("int").alias(c) for c, s in (("x0", sx), ("y0", sy), ("x1", sx), ("y1", sy))])


def to_points(b: Column, page_width: Column, page_height: Column, image_width: Column, image_height: Column) -> Column:
    sx, sy = page_width / image_width, page_height / image_height
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def grid_cells(width: Column, height: Column, n: int = 3) -> Column:
    """array<struct<cell, bbox>> of an n x n grid in reading order; cells have whole sizes, the rest stays uncovered."""
    w, h = F.floor(width / n), F.floor(height / n)

    def cell(i: int) -> Column:
        row, col = divmod(i, n)
        return F.struct(F.lit(i).alias("cell"), box(w * col, h * row, w * (col + 1), h * (row + 1)).alias("bbox"))

    return F.array(*[cell(i) for i in range(n * n)])
