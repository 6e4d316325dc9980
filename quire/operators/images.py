"""Pages exported as images, a row each; the codec is a function that plugs in."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry, naming, raster
from quire.options import DPI_RANGE
from quire.sources.schemas import PAGE_SIZES, conforming


def plan_images(pages: DataFrame, image_format: str, dpi: int, base: str = "doc") -> DataFrame:
    """(doc_id, page_index, page_no, name, width_px, height_px, error_code) of each page to export (K6, K7).

    ``pages`` has ``PAGE_SIZES``. An unknown format or resolution raises at once,
    before any page is read; a page that would pass the pixel cap, or has no
    size, is a row with an error code. Names are as wide as the document's pages need.
    """
    if image_format not in naming.EXTENSIONS:
        raise ValueError(f"image format must be one of {sorted(naming.EXTENSIONS)}: {image_format!r}")
    if not DPI_RANGE[0] <= dpi <= DPI_RANGE[1]:
        raise ValueError(f"dpi must lie in {DPI_RANGE[0]}..{DPI_RANGE[1]}: {dpi}")
    own, own_dpi = Window.partitionBy("doc_id"), F.lit(dpi)
    page_no = F.col("page_index") + 1
    sized = conforming(pages, PAGE_SIZES).withColumns({"n": F.count(F.lit(1)).over(own), "last": F.max(page_no).over(own)})
    guard = geometry.render_guard(F.col("width_pt"), F.col("height_pt"), own_dpi)
    prefix = F.concat(F.lit(base), F.col("doc_id").cast("string"))
    return sized.select(
        "doc_id", "page_index", page_no.alias("page_no"),
        naming.image_name(prefix, page_no, F.col("n"), F.col("last"), F.lit(naming.EXTENSIONS[image_format])).alias("name"),
        geometry.target_dimension(F.col("width_pt"), own_dpi).alias("width_px"), geometry.target_dimension(F.col("height_pt"), own_dpi).alias("height_px"),
        F.when(guard == "bomb", "E-INPUT-DECOMPRESSION-BOMB").when(F.coalesce(guard, F.lit("invalid")) == "invalid", "E-INPUT-CORRUPT").alias("error_code"),
    )


def png(gray: np.ndarray) -> bytes:
    """A grey raster as a PNG file: unfiltered rows, deflated."""
    rows = np.clip(gray, 0, 255).astype(np.uint8)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 6)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def export_images(planned: DataFrame, rasters: DataFrame, encode: Callable[[np.ndarray], bytes] = png, seconds: float | None = None) -> DataFrame:
    """``planned`` with image, image_bytes and error: one page a row, encoded as it comes (K6).

    ``rasters`` has doc_id, page_index, w, h and px. A page that has no raster, or on which
    ``encode`` fails or takes longer than ``seconds``, has its error and no image; the others go on.
    """
    fine = planned.filter("error_code IS NULL").join(rasters.select("doc_id", "page_index", "w", "h", "px"), ["doc_id", "page_index"])
    made = raster.map_rasters(fine, lambda px: {"image": encode(px)}, ["px"], ["doc_id", "page_index"], "image binary", seconds)
    joined = planned.join(made, ["doc_id", "page_index"], "left")
    missing = F.col("image").isNull() & F.col("error").isNull()
    error = F.coalesce(F.col("error_code"), F.col("error"), F.when(missing, "no raster"))
    return joined.withColumn("image_bytes", F.octet_length("image").cast("long")).withColumn("error", error)


def collected_images(exported: DataFrame) -> DataFrame:
    """(doc_id, images, failed): a document's images in the order of its pages, all at once.

    The pages of a document meet in one row; large exports read the rows of ``export_images`` instead.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("page_no", "name", "image"))))
    return exported.groupBy("doc_id").agg(listed.alias("images"), F.count_if(F.col("error").isNotNull()).alias("failed"))
