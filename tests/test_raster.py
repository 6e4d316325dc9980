import numpy as np
import pytest

from quire.functions import raster as R


def brute_ssim(a, b, size=7):
    half = size // 2
    pa, pb = np.pad(a.astype(float), half, mode="symmetric"), np.pad(b.astype(float), half, mode="symmetric")
    out = np.zeros(a.shape)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            x, y = pa[r : r + size, c : c + size].ravel(), pb[r : r + size, c : c + size].ravel()
            cov = np.cov(x, y)
            c1, c2 = 2.55**2, 7.65**2
            out[r, c] = (2 * x.mean() * y.mean() + c1) * (2 * cov[0, 1] + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2))
    return out


def test_ssim_map_and_tile():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (17, 23))
    b = np.clip(a + rng.integers(-40, 40, a.shape), 0, 255)
    assert np.allclose(R.ssim_map(a, b), brute_ssim(a, b))
    assert np.isclose(R.ssim_global(a, b), brute_ssim(a, b)[3:-3, 3:-3].mean())
    assert {round(R.ssim_tile_min(a, b, t), 9) for t in (3, 5, 50)} == {round(float(brute_ssim(a, b).min()), 9)}
    assert R.ssim_global(a, a) == pytest.approx(1.0)


def test_size_mismatch():
    a = np.arange(100).reshape(10, 10)
    assert R.ssim_tile_min(a, np.pad(a, ((0, 1), (0, 1)), mode="edge")) <= 1.0
    with pytest.raises(ValueError):
        R.ssim_tile_min(a, np.zeros((12, 10)))


def test_stacks_and_sizes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (2, 5, 12, 9))
    assert np.allclose(R.ssim_global(a, b), [R.ssim_global(x, y) for x, y in zip(a, b, strict=True)])
    assert np.allclose(R.ssim_tile_min(a, b), [R.ssim_tile_min(x, y) for x, y in zip(a, b, strict=True)])
    double = np.kron(a[0], np.ones((2, 2)))
    assert R.ssim_global(a[0], double) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        R.ssim_tile_min(a[0], double)
    rgb = rng.integers(0, 256, (3, 4, 5))
    assert np.abs(R.gray(rgb) - np.tensordot([0.299, 0.587, 0.114], rgb, 1)).max() <= 0.6
    big = np.zeros((3, 1030, 700))
    big[0, :3, :3] = 255
    assert R.thumbnail(big).shape == (3, 343, 233) and R.thumbnail(rgb) is rgb and R.thumbnail(big)[0, 0, 0] == 255 and R.is_monochrome(big)


def test_columns_agree_with_kernels(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        h, w = rng.integers(1, 12, 2)
        px = rng.integers(0, 256, (3, h, w)) if i % 3 else np.full((3, h, w), 200 + i % 2 * 40)
        rows.append((i, int(w), int(h), *[c.ravel().tolist() for c in px]))
    table = spark.createDataFrame(rows, "i int, w int, h int, r array<int>, g array<int>, b array<int>")
    r, g, b = (F.col(c) for c in "rgb")
    made = table.select(
        "i", R.gray_pixels(r, g, b).alias("gray"), R.paper_pixels(r, g, b).alias("paper"), R.ink_pixels(r, g, b, lambda p: p["g"] < 60).alias("ink"),
        R.is_monochrome_spread(R.spread_pixels(r, g, b), 100, 0.3).alias("mono"), R.packed_hex(F.transform(r, lambda x: x < 96), F.col("w"), F.col("h")).alias("packed"),
    )
    for x, (_, w, h, *px) in zip(made.orderBy("i").collect(), rows, strict=True):
        rgb = np.array(px).reshape(3, h, w)
        assert x.gray == R.gray(rgb).ravel().tolist() and tuple(x.paper) == R.paper_color(rgb) and tuple(x.ink) == R.ink_color(rgb, rgb[1] < 60)
        assert x.mono == R.is_monochrome(rgb, 100, 0.3) and x.packed == R.pack_bits(rgb[0] < 96).hex()


def brute_component(mask):
    left, best = {tuple(p) for p in np.argwhere(mask)}, 0
    while left:
        todo, n = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_components(seed):
    mask = np.random.default_rng(seed).random((15, 19)) < 0.05 + 0.1 * seed
    assert R.largest_component(mask) == brute_component(mask)


def test_color():
    grey = np.full((3, 600, 600), 200)
    stamp = grey.copy()
    stamp[0, :15, :15] = 255
    halo = grey.copy()
    halo[0, ::40, ::40] = 255
    assert not R.has_color(grey) and R.has_color(stamp) and not R.has_color(halo) and R.is_monochrome(halo) and not R.is_monochrome(np.stack([grey[0] + 40, grey[1], grey[2]]))


def test_colors():
    rgb = np.zeros((3, 4, 4))
    assert R.paper_color(rgb) == (255, 255, 255) and R.ink_color(rgb, rgb[0] > 1) == (0, 0, 0)
    rgb[:, :2] = np.array([230.9, 225.2, 210.7])[:, None, None]
    assert R.paper_color(rgb) == (230, 225, 210) and R.ink_color(rgb, rgb[0] == 0) == (0, 0, 0)


def test_masks():
    page = np.full((60, 60), 250)
    page[20:40, 20:22] = 30
    mask = R.adaptive_mask(page)
    assert mask[20:40, 20:22].all() and mask.sum() < 200
    holed = page.copy()
    holed[20:40, 20:26] = 30
    holed[30, 23] = 250
    assert R.adaptive_mask(holed)[30, 23]
    assert R.pack_bits(np.array([[1, 0, 1] + [0] * 6], bool)) == b"\xa0\x00" and R.mask_bytes(mask) > 0


def test_error_rows(spark):
    rows = spark.createDataFrame([(1, 2, 2, [1, 2, 3, 4]), (2, 2, 2, [1])], "id int, w int, h int, px array<int>")
    got = {r.id: r for r in R.map_rasters(rows, lambda px: {"total": int(px.sum())}, ["px"], ["id"], "total int").collect()}
    assert got[1].total == 10 and got[1].error is None and got[2].total is None and got[2].error
