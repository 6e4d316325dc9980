"""Names of chunks and images, and output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and the formats they stand for.
FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "pdf": "pdf"}
EXTENSIONS = {"jpeg": ".jpg", "png": ".png", "webp": ".webp"}


def numbered(base: Column, index: Column, width: Column, ext: Column) -> Column:
    """``{base}_{index}{ext}``; the number is padded to ``width`` and never cut."""
    digits = index.cast("string")
    return F.concat(base, F.lit("_"), F.lpad(digits, F.greatest(width, F.length(digits)), "0"), ext)


def chunk_name(base: Column, index: Column, count: Column, ext: Column) -> Column:
    """Names from 1, three digits or as many as the count has (K3)."""
    return numbered(base, index, F.greatest(F.lit(3), F.length(count.cast("string"))), ext)


def image_name(base: Column, page: Column, count: Column, last_page: Column, ext: Column) -> Column:
    """Names by page number, wide enough for the count and the last page (K7)."""
    return numbered(base, page, F.greatest(F.lit(3), F.length(count.cast("string")), F.length(last_page.cast("string"))), ext)


def stale_index(name: Column, base: Column, ext: Column) -> Column:
    """The number in a chunk's name, null for any other name (K4)."""
    middle = F.substr(name, F.length(base) + 2, F.length(name) - F.length(base) - F.length(ext) - 1)
    fits = name.startswith(F.concat(base, F.lit("_"))) & name.endswith(ext) & middle.rlike(r"^\d{3,}$")
    return F.when(fits, middle.try_cast("long"))


def resolve_format(explicit: Column, path: Column) -> Column:
    """(format, overridden): an explicit format, else the extension's, else pdf (K8)."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    implied = F.try_element_at(table, ext)
    chosen = F.coalesce(explicit, implied, F.lit("pdf"))
    overridden = explicit.isNotNull() & implied.isNotNull() & (implied != chosen)
    return F.struct(chosen.alias("format"), F.coalesce(overridden, F.lit(False)).alias("overridden"))
