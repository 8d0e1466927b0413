"""Supply layers and outlines on small tiles."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fields, outlines, rasters


def test_layers(spark):
    cd31, ki67 = np.zeros((96, 96), int), np.zeros((96, 96), int)
    cd31[40:60, 40:60], ki67[10:30, 10:30] = 5000, 8000
    rows = [(t, int(x), int(y), int(cd31[y, x]) if t == "a" else 0, int(ki67[y, x])) for t in "ab" for y, x in np.ndindex(96, 96)]
    made = fields.layers(spark.createDataFrame(rows, "tile string, x int, y int, cd31 int, ki67 int"), ["tile"], fields.LayerOptions(cd31="cd31", ki67="ki67", close_size=3, min_area=4)).collect()
    got = {(r.tile, r.x, r.y): r for r in made}
    assert len(got) == len(made) == 2 * 96 * 96 and {(r.tile, r.status) for r in made} == {("a", "ok"), ("b", "empty")}
    assert sum(r.vessel for r in made) == 400 and got["a", 41, 59].vessel
    assert got["a", 50, 50].oxygen == got["a", 50, 50].glucose == 1 and got["a", 90, 50].oxygen == pytest.approx(1 - 31 / 160)
    assert got["a", 20, 20].proliferation == 1 and got["a", 90, 50].proliferation == 0
    assert got["a", 90, 50].glucose == pytest.approx(np.exp(-31 / 450)) and got["a", 20, 50].glucose == pytest.approx(np.exp(-20 / 450))
    assert got["a", 20, 29].glucose < np.exp(-np.hypot(20, 11) / 450)  # demand shortens the reach
    assert all(r.oxygen == 0 and np.isinf(r.dist_um) for r in made if r.tile == "b")
    for bad in ({"open_size": 2}, {"noisy": 0.0}, {"min_area": -1}, {"bin_um": 0.0}):
        with pytest.raises(ValueError):
            fields.LayerOptions(cd31="cd31", ki67="ki67", **bad)


def test_layers_never_broadcast_pixels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(t, x, y, *map(int, rng.integers(0, 50, 4))) for t in range(6) for y in range(16) for x in range(16)]
    px = spark.createDataFrame(rows, "tile int, x int, y int, cd31 int, sma int, ki67 int, pcna int")
    o = fields.LayerOptions(cd31="cd31", sma="sma", ki67="ki67", pcna="pcna", close_size=3, min_area=4)
    plans, write = [], rasters.materialize

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    for module in (fields, rasters):
        monkeypatch.setattr(module, "materialize", written)
    results = []
    for few in (10_000, 0):
        plans.clear()
        made = fields.layers(px, ["tile"], o, few)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        sent = {re.sub(r"#\d+L?", "", keys) for plan in plans for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)}
        assert not [keys for keys in sent if {"x", "y"} <= {*keys.split(", ")} or "label" in keys] and ("tile" in sent) == (few > 0)
        results.append(sorted(map(tuple, made.collect())))
    assert results[0] == results[1] and len(results[0]) == len(rows)


def test_means_masks_and_crops(spark):
    plane = np.arange(64).reshape(8, 8)
    px = spark.createDataFrame([("p", int(x), int(y), int(v), 2 * int(v)) for (y, x), v in np.ndenumerate(plane) if v != 9], "tile string, x int, y int, a int, b int")
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 2.0), (1.0, 2.0)]
    far = [(x + 50, y) for x, y in square]
    cells = spark.createDataFrame([("p", 1, 2, square), ("p", 2, 2, square[:2]), ("p", 3, 2, far), ("q", 4, 1, square), ("p", 5, 2, None), ("p", 6, None, [(2.0, 1.0), *square[1:]])], "tile string, cell int, kind int, points array<struct<x:double,y:double>>")
    got = {r.cell: (r.area, r.M, r.one) for r in outlines.means_under(cells, px, ["tile"], ["cell"], "points", 8, {"M": ["a", "b"], "one": ["a"]}).collect() if r.tile == "p"}
    under = plane[1:3, 1:4].copy()
    under[0, 0] = 0  # a pixel without a row
    assert got[1] == (6, pytest.approx(1.5 * under.mean()), pytest.approx(under.mean())) and set(got) == {1, 6}
    assert tuple(outlines.skipped(cells, px, ["tile"], "points", 8).first()) == (6, 1, 3)
    masks = {(r.tile, r.kind): (r.n_cells, r.n_on) for r in outlines.masks(cells, ["tile"], "kind", "points", 8).collect()}
    assert masks == {("p", 2): (2, 6), ("q", 1): (1, 6), ("p", None): (1, 6)} or masks["p", None][1] <= 6
    drawn = outlines.last_drawn(cells.where("tile = 'p'").fillna(7, ["kind"]), ["tile"], ["cell"], "kind", "points", 8)
    assert {r.kind for r in drawn.where("x = 2 and y = 1").collect()} == {7} and drawn.count() == 6
    picks = spark.createDataFrame([("p", 1, 1.0, 0.5), ("p", 5, 0.0, 0.0), ("p", 77, 0.0, 0.0)], "tile string, cell int, x0_crop double, y0_crop double")
    crop = {r.cell: r.points and [tuple(p) for p in r.points] for r in outlines.in_crop(picks, cells, ["tile"], "cell", "points").collect()}
    assert crop == {1: [(0.0, 0.5), (2.0, 0.5), (2.0, 1.5), (0.0, 1.5)], 5: None, 77: None}
    assert outlines.masks(cells.limit(0), ["tile"], "kind", "points", 8).count() == 0
