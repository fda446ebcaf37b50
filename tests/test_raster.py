"""Image preparation against plain loops over pixels."""

import numpy as np
import pytest

from foliospark.functions import raster
from foliospark.operators import ocr

PICTURE = np.random.default_rng(5).integers(0, 256, (23, 31, 3)).astype(np.uint8)


def test_gray():
    flat = raster.gray(PICTURE)
    assert abs(int(flat[3, 4]) - (0.299 * PICTURE[3, 4, 0] + 0.587 * PICTURE[3, 4, 1] + 0.114 * PICTURE[3, 4, 2])) <= 1
    assert raster.gray(np.full((2, 2, 3), 255, dtype=np.uint8)).tolist() == [[255, 255], [255, 255]]
    assert raster.gray(flat) is flat


def test_adaptive_threshold():
    flat, size, sigma = raster.gray(PICTURE), 11, 2.0
    g = [np.exp(-((k - 5) ** 2) / (2 * sigma**2)) for k in range(size)]
    g = [x / sum(g) for x in g]
    out = raster.adaptive_threshold(flat)
    h, w = flat.shape
    for y, x in ((0, 0), (5, 7), (22, 30), (11, 0)):
        mean = sum(g[a] * g[b] * flat[min(max(y + a - 5, 0), h - 1), min(max(x + b - 5, 0), w - 1)] for a in range(size) for b in range(size))
        assert out[y, x] == (255 if flat[y, x] > round(mean) - 2 else 0)
    assert raster.adaptive_threshold(np.full((9, 9), 7, dtype=np.uint8)).min() == 255


def test_otsu():
    two = np.array([[10] * 30 + [12] * 20, [200] * 40 + [210] * 10], dtype=np.uint8)
    assert raster.otsu(two).tolist() == [[0] * 50, [255] * 50]

    def spread(flat, t):
        a, b = flat[flat <= t].astype(float), flat[flat > t].astype(float)
        return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0.0

    flat = raster.gray(PICTURE)
    best = max(range(256), key=lambda t: (round(spread(flat, t), 3), -t))
    assert (raster.otsu(flat) == np.where(flat > best, 255, 0)).all()


def test_denoise():
    flat = raster.gray(PICTURE)[:9, :8]
    out = raster.denoise(flat, strength=40.0, template=3, search=5, rows=4)
    p = np.pad(flat.astype(float), 3, mode="reflect")
    for y, x in ((0, 0), (4, 3), (8, 7)):
        total = weight = 0.0
        own = p[y + 2 : y + 5, x + 2 : x + 5]
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                other = p[y + 2 + dy : y + 5 + dy, x + 2 + dx : x + 5 + dx]
                w = np.exp(-((own - other) ** 2).mean() / 1600)
                total, weight = total + w * other[1, 1], weight + w
        assert out[y, x] == round(total / weight)
    assert (raster.denoise(np.full((30, 30), 99, dtype=np.uint8)) == 99).all()


def test_contrast_and_sharpness():
    flat = np.array([[100, 100, 100], [100, 160, 100], [100, 100, 100]], dtype=np.uint8)
    mean = int(flat.mean() + 0.5)
    assert raster.contrast(flat)[1, 1] == mean + 2 * (160 - mean) and raster.contrast(flat)[0, 0] == mean + 2 * (100 - mean)
    smooth = (8 * 100 + 5 * 160) / 13
    assert abs(int(raster.sharpness(flat)[1, 1]) - min(255, smooth + 1.5 * (160 - smooth))) <= 1 and raster.sharpness(flat)[0, 0] == 100
    assert raster.enhance(PICTURE).shape == PICTURE.shape


def test_morphology():
    dot = np.zeros((5, 5), dtype=np.uint8)
    dot[2, 2] = 255
    assert (raster.dilate(dot) == dot).all() and raster.dilate(dot, 3).sum() == 9 * 255 and raster.erode(raster.dilate(dot, 3), 3).sum() == 255


@pytest.mark.parametrize("method", ["adaptive", "pipeline", "threshold", "denoise", "all", "other"])
def test_methods(method):
    out = raster.preprocess(PICTURE, method)
    assert out.shape == PICTURE.shape[:2] and out.dtype == np.uint8
    if method == "other":
        assert (out == raster.gray(PICTURE)).all()
    if method in ("adaptive", "threshold"):
        assert set(np.unique(out)) <= {0, 255}
    assert (ocr.prepared(PICTURE, method) == out).all() and ocr.prepared("as it is", None) == "as it is"


def test_sure_text():
    assert ocr.sure_text([((), "one", 0.9), ((), "no", 0.3), ((), "two", 0.31)]) == "one two"
