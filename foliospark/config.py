"""Options of a run, resolved on the driver before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Names, priorities and constants that results depend on.
STAGES = ("direct", "block_ocr", "full_page_ocr", "grid_ocr", "image_ocr", "merged", "post_processed")
PRIORITY = {"direct": 5, "block_ocr": 4, "full_page_ocr": 3, "grid_ocr": 2, "image_ocr": 1}
OCR_CONFIDENCE = {"block_ocr": 0.8, "full_page_ocr": 0.75, "grid_ocr": 0.7, "image_ocr": 0.7}
HYBRID_OCR_CONFIDENCE, STRUCTURED_OCR_CONFIDENCE, STRUCTURED_IMAGE_CONFIDENCE = 0.8, 0.8, 0.7
DEFAULT_FONT, DEFAULT_SIZE, DEFAULT_IMAGE_BOX = "Unknown", 12.0, (0.0, 0.0, 100.0, 100.0)
LANGUAGES = {"ara+eng": ("ar", "en"), "ara": ("ar",), "eng": ("en",)}
MAX_UPLOAD_BYTES = 100 * 1024 * 1024


@dataclass(frozen=True)
class Stages:
    """Which optional stages a mode runs; direct extraction, merging and cleaning always run."""

    block_ocr: bool = True
    full_page_ocr: bool = True
    grid_ocr: bool = False
    image_ocr: bool = True


#: Any other mode is balanced.
MODES = {"fast": Stages(full_page_ocr=False), "balanced": Stages(), "thorough": Stages(grid_ocr=True)}


def stages_of(mode: str) -> Stages:
    return MODES.get(mode, MODES["balanced"])


@dataclass(frozen=True)
class PipelineConfig:
    """Options of the three ways to extract. Quirk flags default to what existing outputs show."""

    lang: str = "ara+eng"
    mode: str = "balanced"
    ocr_engine: str = "tesseract"
    dpi: int = 300
    confidence_threshold: float = 0.3
    text_coverage_threshold: float = 20.0
    full_page_min_chars: int = 100
    grid_max_chars: int = 200
    grid_overlap: float = 0.3
    overlap_threshold: float = 0.7
    similarity_threshold: float = 0.8
    structured_threshold: float = 0.1
    hybrid_threshold: float = 0.1
    #: Cleaned blocks are all tagged post_processed; False keeps the stage that found them.
    overwrite_stage: bool = True
    #: Page 1 always gets a full-page pass.
    first_page_always: bool = True

    @property
    def stages(self) -> Stages:
        return stages_of(self.mode)

    @property
    def engine_languages(self) -> tuple[str, ...]:
        return LANGUAGES.get(self.lang, LANGUAGES["ara+eng"])

    def but(self, **changes) -> PipelineConfig:
        return replace(self, **changes)
