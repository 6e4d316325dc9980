"""Options of a batch run, checked once on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

#: The defaults and limits that decide results.
MEBIBYTE = 1 << 20
POINTS_PER_INCH = 72
AXIS_CAP_PT = 14_400
PIXEL_CAP = 715_827_882
ANOMALY_RATIO = 200
PAGES_PER_SPEC = 1_000_000
DPI_RANGE = (1, 1200)
MEMORY_FLOOR = 8 << 30
MEMORY_CEILING = 16 << 30
MEMORY_FACTOR = 16
HOST_SHARE = 0.7
LEVENSHTEIN_CEILING = {"standard": 0.05, "safe": 0.02, "fast": 0.05}
SSIM_FLOOR = 0.92
TILE_FLOOR = {"standard": 0.85, "safe": 0.88, "fast": 0.85}
MODES = ("fast", "standard", "safe")
CODECS = ("jpeg", "jpeg2000")
SUBSAMPLING = ("4:4:4", "4:2:2", "4:2:0")

#: Error codes, process exit codes and labels.
EXIT_CODES = {
    "OK": (0, "ok"),
    "NOOP-PASSTHROUGH": (2, "passed through"),
    "E-INPUT-ENCRYPTED": (10, "encrypted without password"),
    "E-INPUT-SIGNED": (11, "signed"),
    "E-INPUT-OVERSIZE": (12, "oversize"),
    "E-INPUT-CORRUPT": (13, "corrupt"),
    "E-INPUT-MALICIOUS": (14, "malicious"),
    "E-INPUT-CERTIFIED": (15, "certifying signature"),
    "E-INPUT-DECOMPRESSION-BOMB": (16, "decompression bomb"),
    "E-ENV-MISSING": (17, "environment"),
    "E-MEM-CAP": (18, "memory cap"),
    "E-HOST-RESOURCE": (19, "host resource"),
    "E-VERIFIER-FAIL": (20, "content drift"),
    "E-INPUT-NOT-PDF": (13, "no such format"),
    "E-ENGINE-ERROR": (30, "engine error"),
    "E-OCR-TIMEOUT": (30, "recognition timeout"),
    "E-TIMEOUT-PER-PAGE": (30, "page timeout"),
    "E-TIMEOUT-TOTAL": (30, "total timeout"),
    "E-USAGE": (40, "usage"),
}
#: Codes of warning lines.
WARNING_CODES = (
    "W-MAX-OUTPUT-MB-IMAGE-MODE",
    "W-MAX-OUTPUT-MB-STDOUT",
    "W-OUTPUT-FORMAT-EXTENSION-OVERRIDE",
    "W-CHUNKS-EXCEED-CAP",
    "W-STALE-CHUNK-FILES",
    "W-SINGLE-CHUNK-OVERSIZE",
    "W-VERIFIER-SKIPPED",
    "W-VERIFIER-FAILED",
    "W-IMAGE-EXPORT-PARTIAL-FAILURE",
    "W-CHUNK-WRITE-PARTIAL-FAILURE",
    "W-PASSTHROUGH-SIGNED",
    "W-MEM-RSS-WATCHDOG",
    "W-CAPS-UNAVAILABLE",
    "W-CAPS-FAILED",
    "W-WATCHDOG-DIED",
)
#: How a worker ends that its system stopped for its memory.
MEMORY_KILLS = (-9, 137, 0xC0000044)


def positive_float(raw: str) -> float:
    """A finite number above 0."""
    value = float(raw)
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"must be a finite number above 0: {raw!r}")
    return value


def positive_int(raw: str) -> int:
    value = int(raw)
    if value < 1:
        raise ValueError(f"must be at least 1: {raw!r}")
    return value


def positive_megabytes(raw: str) -> float:
    """Megabytes that come to one byte at least."""
    value = positive_float(raw)
    if int(value * MEBIBYTE) < 1:
        raise ValueError(f"below one byte: {raw!r}")
    return value


def bounded_int(raw: str, least: int, most: int) -> int:
    value = int(raw)
    if not least <= value <= most:
        raise ValueError(f"must lie in {least}..{most}: {raw!r}")
    return value


def worker_setting(raw: str) -> int:
    return bounded_int(raw, 0, 256)


def dpi_setting(raw: str) -> int:
    return bounded_int(raw, *DPI_RANGE)


def check_correlation_id(value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._:-]{1,64}", value):
        raise ValueError("correlation id: 1 to 64 of letters, digits and ._:-")
    return value


def worker_count(setting: int, pages: int, cpus: int) -> int:
    """0 means one less than the processors; never more than pages, never below 1."""
    return max(1, min(setting or max(1, cpus - 1), max(1, pages)))


def worker_memory_cap(input_bytes: int, workers: int, available: int | None, setting_mb: int | None = None) -> int:
    """Bytes for each worker; 0 switches the cap off."""
    if setting_mb == 0:
        return 0
    own = setting_mb * MEBIBYTE if setting_mb is not None else min(MEMORY_CEILING, max(MEMORY_FLOOR, MEMORY_FACTOR * input_bytes))
    return own if available is None else min(own, int(available * HOST_SHARE) // max(1, workers))


@dataclass(frozen=True)
class Options:
    """One run's settings. ``None`` in ``max_pages`` switches that gate off."""

    mode: str = "standard"
    bg_codec: str = "jpeg"
    target_bg_dpi: int = 150
    target_color_quality: int = 55
    bg_chroma_subsampling: str = "4:4:4"
    force_monochrome: bool = False
    legal_codec_profile: str | None = None
    ocr: bool = False
    re_ocr: bool = False
    strip_text_layer: bool = False
    allow_signed_invalidation: bool = False
    allow_certified_invalidation: bool = False
    preserve_signatures: bool = False
    accept_drift: bool = False
    skip_verify: bool = True
    password: str | None = None
    min_input_mb: float = 0.0
    min_ratio: float = 1.5
    max_pages: int | None = 10_000
    max_input_mb: float = 250.0
    min_image_byte_fraction: float = 0.30
    per_page_timeout_seconds: int = 120
    total_timeout_seconds: int = 1200
    photo_target_dpi: int = 200
    max_workers: int = 0
    max_worker_memory_mb: int | None = None

    def __post_init__(self) -> None:
        if self.preserve_signatures and self.allow_signed_invalidation:
            raise ValueError("preserve_signatures and allow_signed_invalidation exclude each other")
        if self.mode not in MODES or self.bg_codec not in CODECS or self.bg_chroma_subsampling not in SUBSAMPLING:
            raise ValueError("unknown mode, codec or subsampling")

    @property
    def forces_all_pages(self) -> bool:
        """Whether every page must be processed whatever its content."""
        return self.re_ocr or self.strip_text_layer or self.legal_codec_profile is not None or not self.skip_verify

    @property
    def source_dpi(self) -> int:
        return 200 if self.mode == "fast" else 300

    @property
    def effective_codec(self) -> tuple[str, tuple[str, ...]]:
        """The codec and the warnings of its choice: jpeg2000 is too slow for the fast mode."""
        if self.mode == "fast" and self.bg_codec == "jpeg2000":
            return "jpeg", ("jpeg2000-demoted-to-jpeg-in-fast-mode",)
        return self.bg_codec, ()


def read_password(file_text: str | None, environment: str | None) -> str | None:
    """The password of a file, without one final line end, or else the environment's."""
    if file_text is not None:
        return file_text[:-2] if file_text.endswith("\r\n") else file_text.removesuffix("\n")
    return environment


def parse_pages(spec: str) -> set[int]:
    """'1,3-5,10' as page numbers from 1; at most a million, in any range and in all."""
    chosen: set[int] = set()
    for token in (t.strip() for t in spec.split(",")):
        if not token:
            continue
        ends = token.split("-", 1)
        try:
            low, high = int(ends[0]), int(ends[-1])
        except ValueError:
            raise ValueError(f"pages: {token!r} is no number or range 'lo-hi'") from None
        if low < 1 or high < low:
            raise ValueError(f"pages: {token!r} must count from 1, lo <= hi")
        if high - low >= PAGES_PER_SPEC:
            raise ValueError(f"pages: {token!r} is too large")
        chosen.update(range(low, high + 1))
    if len(chosen) > PAGES_PER_SPEC:
        raise ValueError("pages: too many in all")
    return chosen
