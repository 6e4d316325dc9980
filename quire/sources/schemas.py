"""Declared schemas; nothing is inferred. Later versions only add fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

PAGES = "doc_id long, page_index int, page_key long, content_bytes long, image_bytes long, other_bytes long"
XOBJECTS = "doc_id long, page_index int, kind string, length long"
GLYPHS = "page_id long, i int, ch string, left double, bottom double, right double, top double"
WORDS = "page_id long, word_no long, text string, x double, y double, w double, h double"
RASTERS = "doc_id long, page_index int, w int, h int, px array<int>"
EDGES = "doc_id long, parent long, child long, key string, is_indirect boolean"
VERDICT = "doc_id long, page_index int, lev double, ssim_global double, ssim_tile_min double, digits_match boolean, color_preserved boolean, passed boolean"
MANIFEST = "schema_version int, fixtures array<struct<name: string, url: string, sha256: string, tags: array<string>>>"
BUILD_INFO = "version string, git_sha string, build_date string, base_image string"

#: What the native kernels that plug in have to deliver: page sizes and boxes, page
#: rasters, recognized boxes, encoded images and mask streams, glyph styles.
PAGE_SIZES = "doc_id long, page_index int, width_pt double, height_pt double"
PAGE_BOXES = "doc_id long, page_index int, crop array<string>, media array<string>"
PAGE_RASTERS = "doc_id long, page_index int, w int, h int, r array<int>, g array<int>, b array<int>"
OCR_BOXES = "page_id long, word_no long, text string, confidence string"
ENCODED = "doc_id long, page_index int, codec string, image binary, error string"
GLYPH_PROBES = "page_id long, i int, font string, flags string, size string, weight string, fill array<int>, matrix array<double>"


def conforming(df: DataFrame, schema: str) -> DataFrame:
    """The declared columns of ``df``, in order; a ValueError names those that are missing or of another type."""
    declared = _parse_datatype_string(schema)
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in declared.fields if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")
    return df.select(*[f.name for f in declared.fields])
