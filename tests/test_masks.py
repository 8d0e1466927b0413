"""Masks, components, distances and outlines on small tiles, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fields, outlines, rasters
from tessera.plans import QUERIES, rastering
from tessera.sources.tables import materialize

RNG = np.random.default_rng(11)
TILES = [RNG.random((h, w)) < share for h, w, share in ((12, 9, 0.1), (9, 12, 0.4), (7, 7, 0.6), (5, 8, 0.0), (6, 6, 1.0), (1, 10, 0.5), (13, 13, 0.5))]
SPIRAL = np.array([[c == "#" for c in line] for line in ("#########", "........#", "#######.#", "#.....#.#", "#.###.#.#", "#.#...#.#", "#.#####.#", "#.......#", "#########")])


@pytest.fixture(scope="module")
def tiles(spark):
    rows = [(t, int(x), int(y), bool(v)) for t, m in enumerate([*TILES, SPIRAL]) for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "tile int, x int, y int, on boolean")


def planes(df, value):
    out = [np.full(m.shape, np.nan) for m in [*TILES, SPIRAL]]
    for r in df.collect():
        assert np.isnan(out[r.tile][r.y, r.x])  # each pixel once
        out[r.tile][r.y, r.x] = r[value]
    return out


def test_distance(tiles):
    got = planes(fields.distance(tiles.withColumn("on", F.col("on").cast("int")), ["tile"]), "dist")
    for m, g in zip([*TILES, SPIRAL], got):
        on = np.argwhere(m)
        want = np.array([[np.sqrt(((on - (y, x)) ** 2).sum(1).min()) if len(on) else np.inf for x in range(m.shape[1])] for y in range(m.shape[0])])
        assert np.allclose(g, want)


def test_components(tiles):
    got = planes(rasters.components(tiles.where("on"), ["tile"]), "label")
    for m, g in zip([*TILES, SPIRAL], got):
        want, n = np.full(m.shape, np.nan), 0
        for y, x in np.argwhere(m):
            if np.isnan(want[y, x]):
                n, stack = n + 1, [(y, x)]
                while stack:
                    b, a = stack.pop()
                    if 0 <= b < m.shape[0] and 0 <= a < m.shape[1] and m[b, a] and np.isnan(want[b, a]):
                        want[b, a] = n
                        stack += [(b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert np.array_equal(g, want, equal_nan=True)
    assert rasters.components(tiles.limit(0), ["tile"]).count() == 0


def neighbours(m, element, how, outside):
    out = np.zeros(m.shape, bool)
    for y, x in np.ndindex(*m.shape):
        out[y, x] = how(m[y + dy, x + dx] if 0 <= y + dy < m.shape[0] and 0 <= x + dx < m.shape[1] else outside for dx, dy in element)
    return out


@pytest.mark.parametrize("element", [rasters.ellipse(5), rasters.square(-1, 2)])
def test_dilate_and_erode(tiles, element):
    for run, how, outside in ((rasters.dilate, any, False), (rasters.erode, all, True)):
        got = planes(run(tiles, ["tile"], "on", element), "on")
        assert all(np.array_equal(g, neighbours(m, element, how, outside)) for m, g in zip([*TILES, SPIRAL], got))


def test_elements_and_cleaning(spark, tiles):
    assert sorted(rasters.ellipse(5)) == sorted((x, y) for x in range(-2, 3) for y in range(-2, 3) if abs(y) < 2 or x == 0)
    assert rasters.ellipse(0) == rasters.ellipse(1) == [(0, 0)]
    for bad in (4, -1):
        with pytest.raises(ValueError, match="odd"):
            rasters.ellipse(bad)
    with pytest.raises(ValueError, match="negative"):
        rasters.clean(tiles, ["tile"], "on", min_area=-1)
    grid = np.zeros((20, 20), bool)
    grid[2:6, 2:6] = grid[10, 10] = grid[15, 3] = True
    frame = spark.createDataFrame([(0, int(x), int(y), bool(v)) for (y, x), v in np.ndenumerate(grid)], "tile int, x int, y int, on boolean")
    for area, n in ((4, 16), (1, 18), (17, 0)):
        kept = rasters.clean(frame, ["tile"], "on", min_area=area)
        assert kept.count() == 400 and kept.where("on").count() == n
    assert rasters.clean(frame, ["tile"], "on", open_size=3).where("on").count() == 12  # the cross leaves the corners


def test_median_saturation_and_tissue(spark):
    plane = RNG.integers(0, 9, (8, 6))
    frame = spark.createDataFrame([(0, int(x), int(y), int(v)) for (y, x), v in np.ndenumerate(plane)], "tile int, x int, y int, v int")
    padded = np.pad(plane, 2, mode="edge")
    got = {(r.y, r.x): r.v for r in rasters.median_filter(frame, ["tile"], "v", 5).collect()}
    assert got == {(y, x): np.median(padded[y : y + 5, x : x + 5]) for y, x in np.ndindex(8, 6)}
    with pytest.raises(ValueError, match="odd"):
        rasters.median_filter(frame, ["tile"], "v", 4)
    colours = spark.createDataFrame([(0, 0, 0), (255, 0, 0), (100, 50, 75)], "r int, g int, b int")
    assert [r.s for r in colours.select(rasters.saturation(F.col("r"), F.col("g"), F.col("b")).alias("s")).collect()] == [0, 255, 128]
    inside = lambda x, y: 8 <= x < 30 and 8 <= y < 30
    rows = [(0, x, y, *((180, 60, 120) if inside(x, y) else (240, 240, 240))) for x in range(40) for y in range(40)]
    mask = {(r.x, r.y) for r in rasters.tissue(spark.createDataFrame(rows, "tile int, x int, y int, r int, g int, b int"), ["tile"], ("r", "g", "b")).where("tissue").collect()}
    assert all((x, y) in mask for x in range(10, 28) for y in range(10, 28)) and not any(x < 6 or y < 6 or x > 33 or y > 33 for x, y in mask)


def test_covered_pixels(spark):
    shapes = [[(2.9, 1.2), (6, 1), (6, 4), (2, 4)], [(1, 1), (2, 2)], [(-50.5, -3), (40, 6), (-3, 14)], [(1e12, 5), (3, 3), (3, 9)], []]
    shapes += [[tuple(int(v) for v in p) for p in RNG.integers(-3, 15, (RNG.integers(3, 8), 2))] for _ in range(40)]
    frame = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in s]) for i, s in enumerate(shapes)] + [(900, None), (901, [(1.0, None), (float("nan"), 2.0), (3.0, 3.0), (1.0, 1.0)])], "id int, points array<struct<x:double,y:double>>")
    got = {r.id: {(p.x, p.y) for p in r.pixels} for r in outlines.with_pixels(frame, "points", 12, 12).collect()}
    assert got[900] == got[901] == got[1] == got[4] == set() and len(got[0]) == 20
    for i, shape in enumerate(shapes):
        corners = [(int(min(max(x, -outlines.FAR), outlines.FAR)), int(y)) for x, y in shape]
        want = set()
        for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]) if len(corners) > 2 else ():
            n = max(abs(x1 - x0), abs(y1 - y0), 1)
            if n < 1000:
                want |= {(round(x0 + k / n * (x1 - x0)), round(y0 + k / n * (y1 - y0))) for k in range(n + 1)}
        edges = list(zip(corners, corners[1:] + corners[:1])) if len(corners) > 2 else []
        for y, x in np.ndindex(12, 12):
            cross = [x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in edges if (y0 <= y) != (y1 <= y)]
            if sum(c <= x for c in cross) % 2 or x in cross:
                want.add((x, y))
        if i != 3:
            assert got[i] == {(x, y) for x, y in want if 0 <= x < 12 and 0 <= y < 12}, shape
        else:
            assert got[i] >= {(x, y) for x, y in want if 0 <= x < 12 and 0 <= y < 12}


@pytest.fixture
def one_tile(spark, monkeypatch):
    """A tile with vessels in columns of every remainder by 4, and some muscle; returns the masks (y, x)."""
    cd31, sma = np.zeros((64, 64), int), np.zeros((64, 64), int)
    for i in range(16):
        cd31[3 * i + 2, 4 * i : 4 * i + 4] = np.where(np.arange(4) == i % 4, 9, 0)
    sma[::2] = 7
    rows = [(0, x, y, int(cd31[y, x]), int(sma[y, x]), 0, 0) for y in range(64) for x in range(64)]
    frame = spark.createDataFrame(rows, "tile bigint, x int, y int, cd31 bigint, sma bigint, ki67 bigint, pcna bigint")
    monkeypatch.setattr(rastering, "channels", lambda *_: frame)
    return cd31 > 0, sma > 0


def on(rows):
    out = np.zeros((64, 64), bool)
    for r in rows:
        out[r.y, r.x] = True
    return out


def test_whole_masks_grow(spark, one_tile):
    for name, mask, reach in (("dilate_vessels", one_tile[0], 1), ("dilate_rect", one_tile[1], 2)):
        got, want = on(QUERIES[name](spark, "").collect()), np.zeros((64, 64), bool)
        for y, x in zip(*np.nonzero(mask)):
            want[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1] = True
        assert np.array_equal(got, want)


def test_muscle_near_all_vessels(spark, one_tile):
    vessels, muscle = one_tile
    for name, first, other in (("sma_vessels", vessels, muscle), ("sma_refine", muscle, vessels)):
        assert np.array_equal(on(QUERIES[name](spark, "").collect()), first | (other & neighbours(first, rasters.ellipse(5), any, False)))


def test_the_grid_counts_its_pixels_for_the_planner(spark):
    px = materialize(spark.createDataFrame([(t, 1, 2, 5) for t in range(3)], "tile int, x int, y int, v int").coalesce(1), "px").groupBy("tile", "x", "y").agg(F.sum("v").alias("v"))
    grid = rasters.full_grid(px, ["tile"], 64, ["v"])
    assert grid.count() == grid.select("tile", "x", "y").distinct().count() == 3 * 64 * 64
    assert grid.agg({"x": "max"}).first()[0] == grid.agg({"y": "max"}).first()[0] == 63 and [tuple(r) for r in grid.where("v > 0").select("x", "y", "v").distinct().collect()] == [(1, 2, 5)]
    assert int(str(grid.select("tile", "x", "y")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 3 * 64 * 64 * 12


def test_components_shuffle_what_is_not_few(spark):
    on = spark.createDataFrame([(t, x, y) for t in range(2) for x in range(20) for y in range(20) if (x * 7 + y * 3 + t) % 5 < 2], "tile int, x int, y int")
    few, many = (rasters.components(on, ["tile"], n) for n in (10_000, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() == on.count()
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString().replace("autoBroadcast", "")
