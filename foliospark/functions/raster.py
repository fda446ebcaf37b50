"""Preparing page images for OCR, in numpy alone: gray, thresholds, denoising, contrast. Images are uint8 arrays."""

from __future__ import annotations

import numpy as np

# Window and offset of the adaptive threshold; strength, template and search window of denoising; enhancement.
BLOCK, OFFSET = 11, 2
STRENGTH, TEMPLATE, SEARCH = 10.0, 7, 21
CONTRAST, SHARPNESS = 2.0, 1.5


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image (ITU-R 601 weights in 14-bit fixed point); a gray one stays."""
    if image.ndim == 2:
        return image
    r, g, b = (image[..., k].astype(np.int32) for k in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)


def _along(x: np.ndarray, weights: np.ndarray, axis: int, mode: str) -> np.ndarray:
    """Weighted sum over a centred window along an axis."""
    half = len(weights) // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(x.ndim)]
    padded, n, out = np.pad(x, pad, mode=mode), x.shape[axis], 0.0
    for k, w in enumerate(weights):
        out = out + w * np.take(padded, np.arange(k, k + n), axis=axis)
    return out


def local_mean(image: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Gaussian mean of each pixel's window, edges repeated, rounded."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    return np.rint(_along(_along(image.astype(np.float64), weights, 1, "edge"), weights, 0, "edge")).astype(np.int32)


def adaptive_threshold(image: np.ndarray, size: int = BLOCK, offset: int = OFFSET) -> np.ndarray:
    """White where a pixel is above its local mean less the offset."""
    return np.where(image.astype(np.int32) > local_mean(image, size) - offset, 255, 0).astype(np.uint8)


def otsu(image: np.ndarray) -> np.ndarray:
    """White above the level that separates two classes of pixels best (the least such level)."""
    counts = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    return np.where(image > int(between.argmax()), 255, 0).astype(np.uint8)


def denoise(image: np.ndarray, strength: float = STRENGTH, template: int = TEMPLATE, search: int = SEARCH, rows: int = 256) -> np.ndarray:
    """Non-local means: each pixel is the mean of its search window, weighted by how alike the templates around them are.

    Bands of rows bound the memory; a template's distance is a box sum, so the cost is one pass a shift.
    """
    t, s, out = template // 2, search // 2, np.empty_like(image)
    padded = np.pad(image.astype(np.float64), t + s, mode="reflect" if min(image.shape) > t + s else "symmetric")
    box = np.ones(template) / template
    for top in range(0, len(image), rows):
        n = min(rows, len(image) - top)
        band = padded[top : top + n + 2 * (t + s)]
        centre = band[s : s + n + 2 * t, s : band.shape[1] - s]
        total, weight = np.zeros((n, image.shape[1])), np.zeros((n, image.shape[1]))
        for dy in range(search):
            for dx in range(search):
                other = band[dy : dy + n + 2 * t, dx : dx + centre.shape[1]]
                gap = _along(_along((other - centre) ** 2, box, 1, "edge"), box, 0, "edge")[t : t + n, t : t + image.shape[1]]
                w = np.exp(-gap / (strength * strength))
                total += w * other[t : t + n, t : t + image.shape[1]]
                weight += w
        out[top : top + n] = np.rint(total / weight)
    return out


def _extreme(image: np.ndarray, size: int, pick) -> np.ndarray:
    half = size // 2
    padded = np.pad(image, (half, size - 1 - half), mode="edge")
    h, w = image.shape
    return pick.reduce([padded[y : y + h, x : x + w] for y in range(size) for x in range(size)])


def dilate(image: np.ndarray, size: int = 1) -> np.ndarray:
    return _extreme(image, size, np.maximum)


def erode(image: np.ndarray, size: int = 1) -> np.ndarray:
    return _extreme(image, size, np.minimum)


def _blend(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    return np.clip(a + share * (b.astype(np.float64) - a), 0, 255).astype(np.uint8)


def contrast(image: np.ndarray, factor: float = CONTRAST) -> np.ndarray:
    """Away from the mean gray level."""
    mean = int(gray(image).astype(np.float64).mean() + 0.5)
    return _blend(np.full(image.shape, mean, dtype=np.float64), image, factor)


def sharpness(image: np.ndarray, factor: float = SHARPNESS) -> np.ndarray:
    """Away from the image smoothed by its eight neighbours (centre 5 of 13); the outermost pixels stay."""
    smooth = image.astype(np.float64)
    h, w = image.shape[:2]
    if h > 2 and w > 2:
        inner = sum(image[y : y + h - 2, x : x + w - 2].astype(np.float64) for y in range(3) for x in range(3)) + 4.0 * image[1:-1, 1:-1]
        smooth[1:-1, 1:-1] = np.floor(inner / 13 + 0.5)
    return _blend(smooth, image, factor)


def enhance(image: np.ndarray) -> np.ndarray:
    return sharpness(contrast(image))


def preprocess(image: np.ndarray, method: str = "adaptive") -> np.ndarray:
    """adaptive (structured pages), pipeline (adaptive and denoised, the seven stages), threshold, denoise, all (as
    pipeline, then opened by one pixel); any other name gives gray."""
    out = gray(image)
    if method in ("adaptive", "pipeline", "all"):
        out = adaptive_threshold(out)
    elif method == "threshold":
        out = otsu(out)
    if method in ("denoise", "pipeline", "all"):
        out = denoise(out)
    return erode(dilate(out)) if method == "all" else out
