"""NumPy kernels on rasters, the Arrow functions that run them over rows, and measures as Columns.

A raster is a row-major list of pixels with its width and height; colour rasters
have three lists. Kernels handle one raster, or a stack of equal size, and know nothing of Spark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.columns import let
from quire.plans.deadline import time_limit

#: Fixed values of the image measures.
SSIM_WINDOW = 7
SSIM_RANGE = 255.0
CHANNEL_SPREAD = 15
COLOR_FRACTION = 0.001
COLOR_COMPONENT = 200
MONOCHROME_PERCENTILE = 99
LIGHT = 230
DARK = 96
ADAPTIVE_BLOCK = 25
ADAPTIVE_C = 15
THUMBNAIL = 512
LUMA = (19595, 38470, 7471)


def _box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over size x size windows of the last two axes, edges mirrored with the edge pixel repeated."""
    half = size // 2
    still = [(0, 0)] * (a.ndim - 2)
    padded = np.pad(a, [*still, (half, half), (half, half)], mode="symmetric")
    sums = np.pad(padded.cumsum(-2).cumsum(-1), [*still, (1, 0), (1, 0)])
    return (sums[..., size:, size:] - sums[..., :-size, size:] - sums[..., size:, :-size] + sums[..., :-size, :-size]) / size**2


def ssim_map(a: np.ndarray, b: np.ndarray, size: int = SSIM_WINDOW) -> np.ndarray:
    """Structural similarity at each pixel of one raster or a stack: uniform windows, sample covariance."""
    a, b = a.astype(float), b.astype(float)
    n = size**2
    ma, mb = _box_mean(a, size), _box_mean(b, size)
    unbias = n / (n - 1)
    va, vb = unbias * (_box_mean(a * a, size) - ma * ma), unbias * (_box_mean(b * b, size) - mb * mb)
    cov = unbias * (_box_mean(a * b, size) - ma * mb)
    c1, c2 = (0.01 * SSIM_RANGE) ** 2, (0.03 * SSIM_RANGE) ** 2
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of (3, h, w) as integers, in 16-bit fixed point."""
    r, g, b = rgb.astype(np.int64)
    return (r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 0x8000) >> 16


def resized(b: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """``b`` in another size, each pixel the one nearest to its centre."""
    rows, cols = ((np.arange(n) + 0.5) * m / n for n, m in zip(shape[-2:], b.shape[-2:], strict=True))
    return b[..., rows.astype(int)[:, None], cols.astype(int)[None, :]]


def ssim_global(a: np.ndarray, b: np.ndarray, size: int = SSIM_WINDOW) -> np.ndarray:
    """Mean similarity where windows lie inside the raster; ``b`` is brought to the size of ``a`` first."""
    if b.shape != a.shape:
        b = resized(b, a.shape)
    half = size // 2
    return ssim_map(a, b, size)[..., half : a.shape[-2] - half, half : a.shape[-1] - half].mean((-2, -1))


def fit_by_one(b: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """``b`` in ``shape``; more than one pixel apart is an error."""
    if any(abs(x - y) > 1 for x, y in zip(b.shape[-2:], shape[-2:], strict=True)):
        raise ValueError(f"page sizes differ: {b.shape} and {shape}")
    return b if b.shape == shape else resized(b, shape)


def ssim_tile_min(a: np.ndarray, b: np.ndarray, tile: int = 50, size: int = SSIM_WINDOW) -> np.ndarray:
    """The worst tile, which is the worst pixel, whatever ``tile`` is: edge tiles only hold real pixels (R2)."""
    found = np.nan_to_num(ssim_map(a, fit_by_one(b, a.shape), size), nan=1.0)
    rows, cols = range(0, found.shape[-2], tile), range(0, found.shape[-1], tile)
    return np.min([found[..., r : r + tile, c : c + tile].min((-2, -1)) for r in rows for c in cols], axis=0)


def channel_spread(rgb: np.ndarray) -> np.ndarray:
    """Largest minus smallest channel at each pixel of (3, h, w)."""
    return rgb.max(0).astype(int) - rgb.min(0).astype(int)


def largest_component(mask: np.ndarray) -> int:
    """Pixels of the largest 8-connected region, by spreading the largest label until nothing changes."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        h, w = mask.shape
        spread = np.max([padded[r : r + h, c : c + w] for r in range(3) for c in range(3)], axis=0)
        spread = np.where(mask, spread, 0)
        # jump along the labels: a pixel takes the label of the pixel that its label names
        flat = np.concatenate([[0], spread.ravel()])
        spread = np.where(mask, np.maximum(spread, flat[spread]), 0)
        if (spread == labels).all():
            return int(np.bincount(labels.ravel(), minlength=2)[1:].max(initial=0))
        labels = spread


def has_color(rgb: np.ndarray, fraction: float = COLOR_FRACTION, component: int = COLOR_COMPONENT, spread: int = CHANNEL_SPREAD) -> bool:
    """Whether enough pixels, or one region large enough, are coloured."""
    mask = channel_spread(rgb) > spread
    return bool(mask.mean() > fraction or largest_component(mask) >= component)


def thumbnail(rgb: np.ndarray, most: int = THUMBNAIL) -> np.ndarray:
    """(3, h, w) brought down to ``most`` pixels a side by the means of blocks; smaller ones stay as they are."""
    step = -(-max(rgb.shape[1:]) // most)
    if step <= 1:
        return rgb
    h, w = (n // step * step for n in rgb.shape[1:])
    blocks = rgb[:, :h, :w].reshape(3, h // step, step, w // step, step)
    return np.rint(blocks.mean((2, 4)))


def is_monochrome(rgb: np.ndarray, tolerance: int = CHANNEL_SPREAD, fraction: float = COLOR_FRACTION) -> bool:
    """Whether the 99th percentile of a thumbnail's spread and its coloured fraction are small."""
    found = channel_spread(thumbnail(rgb))
    return bool(np.percentile(found, MONOCHROME_PERCENTILE) <= tolerance and (found > tolerance).mean() <= fraction)


def paper_color(rgb: np.ndarray) -> tuple[int, int, int]:
    """Mean colour, cut to integers, of pixels whose brightest channel is light; white without any."""
    light = rgb.max(0) >= LIGHT
    return tuple(int(c[light].mean()) for c in rgb) if light.any() else (255, 255, 255)


def ink_color(rgb: np.ndarray, mask: np.ndarray) -> tuple[int, int, int]:
    """Median colour, cut to integers, under the mask; black without any."""
    return tuple(int(np.median(c[mask])) for c in rgb) if mask.any() else (0, 0, 0)


def adaptive_mask(gray: np.ndarray, block: int = ADAPTIVE_BLOCK, c: float = ADAPTIVE_C, dark: int = DARK, close: int = 3) -> np.ndarray:
    """Ink pixels: darker than their Gaussian neighbourhood by ``c``, or dark; then closed.

    The neighbourhood's mean is rounded to a grey level and edges repeat their
    pixel. This is our own definition of the filter's rounding.
    """
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    at = np.arange(block) - block // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    padded = np.pad(gray.astype(float), block // 2, mode="edge")
    rows = np.apply_along_axis(np.convolve, 1, padded, kernel, "valid")
    mean = np.rint(np.apply_along_axis(np.convolve, 0, rows, kernel, "valid"))
    mask = (gray <= mean - c) | (gray < dark)
    if close > 1:
        grow = lambda m, fill: np.lib.stride_tricks.sliding_window_view(np.pad(m, close // 2, constant_values=fill), (close, close))
        mask = grow(mask, False).any((2, 3))
        mask = grow(mask, True).all((2, 3))
    return mask


def pack_bits(mask: np.ndarray) -> bytes:
    """One bit a pixel, the first highest, rows padded to bytes."""
    return np.packbits(mask, axis=1).tobytes()


def mask_bytes(mask: np.ndarray) -> int:
    """Size of a mask stream: the packed bits, deflated at level 9."""
    import zlib

    return len(zlib.compress(pack_bits(mask), 9))


def _pixels(column: Column, *more: Column) -> Column:
    return F.arrays_zip(column.alias("r"), *[c.alias(n) for c, n in zip(more, ("g", "b"), strict=True)])


def gray_pixels(r: Column, g: Column, b: Column) -> Column:
    """Luma of three pixel lists, as ``gray`` has it, inside the JVM."""
    return F.transform(_pixels(r, g, b), lambda p: F.shiftright(p["r"] * LUMA[0] + p["g"] * LUMA[1] + p["b"] * LUMA[2] + 0x8000, 16))


def _cut_means(pixels: Column) -> Column:
    total = lambda c: F.aggregate(pixels, F.lit(0).cast("long"), lambda n, p: n + p[c])
    return F.struct(*[F.floor(total(c) / F.size(pixels)).cast("int").alias(name) for c, name in (("r", "red"), ("g", "green"), ("b", "blue"))])


def paper_pixels(r: Column, g: Column, b: Column) -> Column:
    """(red, green, blue) as ``paper_color`` has them."""
    white = F.struct(*[F.lit(255).alias(n) for n in ("red", "green", "blue")])
    return let(F.filter(_pixels(r, g, b), lambda p: F.greatest(p["r"], p["g"], p["b"]) >= LIGHT), lambda light: F.when(F.size(light) == 0, white).otherwise(_cut_means(light)))


def ink_pixels(r: Column, g: Column, b: Column, is_ink: Callable[[Column], Column]) -> Column:
    """(red, green, blue) as ``ink_color`` has them, under the mask of pixels that ``is_ink`` holds for."""
    black = F.struct(*[F.lit(0).alias(n) for n in ("red", "green", "blue")])

    def median(pixels: Column, c: str) -> Column:
        def middle(values: Column) -> Column:
            n = F.size(values)
            return F.floor((F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2).cast("int")

        return let(F.array_sort(F.transform(pixels, lambda p: p[c])), middle)

    found = lambda pixels: F.struct(*[median(pixels, c).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])
    return let(F.filter(_pixels(r, g, b), is_ink), lambda ink: F.when(F.size(ink) == 0, black).otherwise(found(ink)))


def spread_pixels(r: Column, g: Column, b: Column) -> Column:
    """Largest minus smallest channel of each pixel."""
    return F.transform(_pixels(r, g, b), lambda p: F.greatest(p["r"], p["g"], p["b"]) - F.least(p["r"], p["g"], p["b"]))


def is_monochrome_spread(spread: Column, tolerance: int = CHANNEL_SPREAD, fraction: float = COLOR_FRACTION) -> Column:
    """As ``is_monochrome`` for a raster of thumbnail size, from its pixels' spread."""

    def judged(values: Column) -> Column:
        at = (F.size(values) - 1) * F.lit(MONOCHROME_PERCENTILE / 100)
        low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
        share = F.size(F.filter(values, lambda x: x > tolerance)) / F.size(values)
        return (low + (high - low) * (at - F.floor(at)) <= tolerance) & (share <= fraction)

    return let(F.array_sort(spread), judged)


def packed_hex(mask: Column, w: Column, h: Column) -> Column:
    """Hexadecimal digits of ``pack_bits`` of a list of booleans."""
    width = F.ceil(w / 8).cast("int")

    def byte(j: Column) -> Column:
        y, x = F.floor(j / width).cast("int"), (j % width) * 8
        bit = lambda k: F.when((x + k < w) & F.coalesce(F.get(mask, (y * w + x + k).cast("int")), F.lit(False)), 128 >> k).otherwise(0)
        return F.lower(F.lpad(F.hex(sum((bit(k) for k in range(1, 8)), bit(0))), 2, "0"))

    return F.array_join(F.transform(F.sequence(F.lit(0), h * width - 1), byte), "")


def map_rasters(df, kernel: Callable[..., dict], inputs: list[str], keys: list[str], outputs: str, seconds: float | None = None, stacked: bool = False):
    """``keys`` and the kernel's results for each row.

    ``kernel`` gets (h, w) arrays of the ``inputs`` columns and returns a
    dictionary of the ``outputs`` (a schema string); ``stacked`` ones get (n, h, w) arrays, the
    rows of a batch that agree in size, and return lists of n. Pixels are
    read off the Arrow lists without a copy. A raster on which the kernel fails, or that takes longer than
    ``seconds``, gives nulls and the reason in ``error``, so one bad page stops nothing (X7, X12).
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(outputs)
    chosen = df.select(*keys, "w", "h", *inputs)
    schema = StructType([chosen.schema[k] for k in keys] + list(made.fields)).add("error", "string")
    names = [f.name for f in made.fields]

    def one(arrays: list[np.ndarray]) -> dict:
        try:
            with time_limit(seconds, "E-TIMEOUT-PER-PAGE"):
                return {k: v[0] for k, v in kernel(*[a[None] for a in arrays]).items()} if stacked else kernel(*arrays)
        except (ValueError, TypeError, TimeoutError) as failure:
            return {"error": str(failure)}

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            lists = [batch.column(c) for c in inputs]
            flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            ends = [x.offsets.to_numpy() for x in lists]
            sizes = list(zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True))
            found: list[dict] = [{}] * batch.num_rows
            groups: dict[tuple, list[int]] = {}
            for row, (h, w) in enumerate(sizes):
                cells = {int(e[row + 1] - e[row]) for e in ends}
                if h is None or w is None or any(not x[row].is_valid for x in lists):
                    found[row] = {"error": "no raster"}
                elif cells != {h * w}:
                    found[row] = {"error": f"cannot reshape {sorted(cells)} pixels into ({h},{w})"}
                else:
                    groups.setdefault((h, w), []).append(row)
            for (h, w), rows in groups.items():
                at = lambda row, h=h, w=w: [f[e[row] : e[row + 1]].reshape(h, w) for f, e in zip(flat, ends, strict=True)]
                done = None
                if stacked and seconds is None:
                    try:
                        results = kernel(*[np.stack(x) for x in zip(*map(at, rows), strict=True)])
                        done = [dict(zip(results, values, strict=True)) for values in zip(*results.values(), strict=True)]
                    except (ValueError, TypeError):
                        done = None  # one of them fails; the others are found one by one
                for k, row in enumerate(rows):
                    found[row] = done[k] if done is not None else one(at(row))
            results = [pa.array([x.get(n) for x in found], to_arrow_type(f.dataType)) for n, f in zip(names, made.fields, strict=True)]
            errors = pa.array([x.get("error") for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *results, errors], schema.names)

    return chosen.mapInArrow(run, schema)
