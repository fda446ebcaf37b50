"""OCR behind one interface. Engines run in Python workers, one per worker; what a page needs is asked for in one call."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship


class OcrEngine(Protocol):
    """What a stage asks for: text and error of a region of a page, of a page, or of an image's bytes."""

    def region(self, path: str, page: int, box: tuple[float, float, float, float], dpi: int) -> str: ...

    def page(self, path: str, page: int, dpi: int) -> str: ...

    def image(self, data: bytes) -> str: ...


class TesseractEngine:
    """Optional: needs pytesseract and pdf2image. One raster per page serves all regions of it.

    Images are prepared by ``method`` of raster.preprocess first.
    """

    method: str | None = "pipeline"

    def __init__(self, lang: str = "ara+eng", method: str | None = "pipeline"):
        import pytesseract

        self.run, self.lang, self.last, self.method = pytesseract.image_to_string, lang, (None, None), method

    def _read(self, image) -> str:
        return self.run(prepared(image, self.method), lang=self.lang, config="--oem 3 --psm 6")

    def _raster(self, path: str, page: int, dpi: int):
        if self.last[0] != (path, page, dpi):
            from pdf2image import convert_from_path

            self.last = ((path, page, dpi), convert_from_path(path, dpi=dpi, first_page=page, last_page=page)[0])
        return self.last[1]

    def region(self, path, page, box, dpi):
        image = self._raster(path, page, dpi)
        return self._read(image.crop(tuple(int(v * dpi / 72) for v in box)))

    def page(self, path, page, dpi):
        return self._read(self._raster(path, page, dpi))

    def image(self, data):
        import io

        from PIL import Image

        return self._read(Image.open(io.BytesIO(data)))


class EasyOcrEngine(TesseractEngine):
    """Optional: needs easyocr, which reads images as they are; detections above 0.3 are joined by spaces."""

    def __init__(self, languages: tuple[str, ...] = ("ar", "en")):
        import easyocr
        import numpy

        reader = easyocr.Reader(list(languages), gpu=False)
        self.lang, self.last, self.method = None, (None, None), None
        self.run = lambda image, **_: sure_text(reader.readtext(numpy.array(image)))


def prepared(image, method: str | None):
    """A PIL image (anything that numpy reads) prepared by a method of raster.preprocess; None leaves it as it is."""
    if method is None:
        return image
    import numpy

    from ..functions import raster

    pixels = numpy.asarray(image.convert("RGB") if hasattr(image, "convert") else image)
    out = raster.preprocess(pixels, method)
    if not hasattr(image, "convert"):
        return out
    from PIL import Image

    return Image.fromarray(out)


def sure_text(detections: list[tuple], least: float = 0.3) -> str:
    """Texts of (place, text, confidence) detections above a confidence, joined by spaces."""
    return " ".join(text for _, text, sure in detections if sure > least)


def make_engine(name: str, lang: str, languages: tuple[str, ...], method: str | None = "pipeline") -> OcrEngine:
    """The named engine; the other one if it can't start."""
    if name == "easyocr":
        try:
            return EasyOcrEngine(languages)
        except Exception:
            pass
    return TesseractEngine(lang, method)


def read_regions(df: DataFrame, factory, kind: str, dpi: int, out: str = "ocr_text") -> DataFrame:
    """df (path, page_number, bbox or bytes) with the text of each row's region, page or image; '' and an error on failure.

    Rows must be filtered before: every row here is read.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for pdf in batches:
            texts, errors = [], []
            for r in pdf.to_dict("records"):
                try:
                    if kind == "region":
                        b = r["bbox"]
                        text = engine.region(r["path"], r["page_number"], (b["x0"], b["y0"], b["x1"], b["y1"]), dpi)
                    else:
                        text = engine.page(r["path"], r["page_number"], dpi) if kind == "page" else engine.image(r["bytes"])
                    texts.append(text or "")
                    errors.append(None)
                except Exception as e:  # an unreadable page must not end the run
                    texts.append("")
                    errors.append(str(e))
            yield pdf.assign(**{out: texts, "ocr_error": errors})

    added = [T.StructField(out, T.StringType()), T.StructField("ocr_error", T.StringType())]
    return df.mapInPandas(run, T.StructType(df.schema.fields + added))


def fixture_text(text: Column, seq: Column) -> Column:
    """A deterministic stand-in for an engine: same, longer, shorter, empty or other text, by the block's number."""
    n = F.pmod(seq, F.lit(5))
    return (
        F.when(n == 0, text).when(n == 1, F.concat(text, F.lit(" recovered words"))).when(n == 2, F.substring(text, 1, 3)).when(n == 3, F.lit(""))
        .otherwise(F.concat(F.lit("different "), F.reverse(text)))
    )
