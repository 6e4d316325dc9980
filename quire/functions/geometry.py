"""Page geometry as Column expressions; halves round to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.options import AXIS_CAP_PT, PIXEL_CAP, POINTS_PER_INCH


def points_to_pixels(points: Column, dpi: Column) -> Column:
    return F.bround(points * dpi / POINTS_PER_INCH).cast("long")


def target_dimension(points: Column, dpi: Column) -> Column:
    """Pixels of an exported side, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), points_to_pixels(points, dpi))


def render_guard(width: Column, height: Column, dpi: Column, cap: int = PIXEL_CAP) -> Column:
    """ok, invalid (a side of 0 or less) or bomb (more pixels than the cap)."""
    pixels = points_to_pixels(width, dpi) * points_to_pixels(height, dpi)
    return F.when((width <= 0) | (height <= 0), "invalid").when(pixels > cap, "bomb").otherwise("ok")


def axis_bomb(x1: Column, y1: Column, x2: Column, y2: Column, cap: int = AXIS_CAP_PT) -> Column:
    """Whether a page box has a side over the cap; a malformed box is no bomb."""
    return F.coalesce(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) > cap, F.lit(False))


def box_axis(box: Column) -> Column:
    """The longer side of a box of four numbers, as numbers or text; null for a malformed one."""
    numbers = F.transform(F.slice(box, 1, 4), lambda x: F.nullif(x.try_cast("double"), F.lit(float("nan"))))
    side = lambda k: F.abs(F.get(numbers, k + 2) - F.get(numbers, k))
    whole = (F.size(box) >= 4) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(whole, F.greatest(side(0), side(1)))


def box_to_pixels(left: Column, bottom: Column, right: Column, top: Column, sx: Column, sy: Column, page_height: Column) -> Column:
    """(x, y, w, h) in pixels from a box in points, y from the top, sides 1 at least."""
    px = lambda c: F.bround(c).cast("long")
    one = F.lit(1).cast("long")
    return F.struct(
        px(left * sx).alias("x"), px((page_height - top) * sy).alias("y"), F.greatest(one, px((right - left) * sx)).alias("w"), F.greatest(one, px((top - bottom) * sy)).alias("h")
    )
