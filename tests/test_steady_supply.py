"""The steady state of the diffusion equation against a direct solution."""

import numpy as np
import pytest

from tessera.operators import fields
from tessera.plans import QUERIES, rastering


def solved(source, k):
    """u of lap(u) - k u + s = 0 with mirrored edges, by one linear system."""
    h, w = source.shape
    a = np.zeros((h * w, h * w))
    for y in range(h):
        for x in range(w):
            a[y * w + x, y * w + x] += 4 + k[y, x]
            for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                a[y * w + x, min(max(y + dy, 0), h - 1) * w + min(max(x + dx, 0), w - 1)] -= 1
    return np.linalg.solve(a, source.ravel()).reshape(h, w)


def plane(rows, side, key):
    out = np.full((side, side), np.nan)
    for r in rows:
        if r.tile == key:
            out[r.y, r.x] = r.u
    return out


def test_steady_state_of_a_small_tile(spark):
    source, k = np.zeros((12, 12)), np.random.default_rng(2).uniform(0.1, 0.5, (12, 12))
    source[3, 4] = source[9, 10] = 1
    rows = [(t, x, y, float(source[y, x]) * (t == 0), float(k[y, x])) for t in (0, 1) for y in range(12) for x in range(12)]
    got = fields.steady(spark.createDataFrame(rows, "tile int, x int, y int, s double, k double"), ["tile"], "s", "k").collect()
    assert np.abs(plane(got, 12, 0) - solved(source, k)).max() < 0.004  # tolerance / (1 - 4 / 4.1)
    assert not plane(got, 12, 1).any()


def test_few_steps_and_bad_arguments(spark):
    rows = [(0, x, y, float(x == y == 2), 0.1) for y in range(5) for x in range(5)]
    frame = spark.createDataFrame(rows, "tile int, x int, y int, s double, k double")
    one = {(r.x, r.y): r.u for r in fields.diffused(frame, ["tile"], "s", "k", 1).collect()}
    assert one.pop((2, 2)) == pytest.approx(1 / 4.1) and set(one.values()) == {0.0} and len(one) == 24
    two = {(r.x, r.y): r.u for r in fields.diffused(frame, ["tile"], "s", "k", 2).collect()}
    assert two[2, 1] == two[1, 2] == two[3, 2] == two[2, 3] == pytest.approx(1 / 4.1 / 4.1)
    for bad in ({"tol": 0.0}, {"most_steps": 0}):
        with pytest.raises(ValueError):
            fields.steady(frame, ["tile"], "s", "k", **bad)
    with pytest.raises(ValueError):
        fields.diffused(frame, ["tile"], "s", "k", 0)


def test_supply_reaches_the_whole_tile(spark, monkeypatch):
    side = 20
    cd31, ki67 = np.zeros((side, side), int), np.arange(side * side).reshape(side, side)
    cd31[5, 5] = 200
    frame = spark.createDataFrame([(0, x, y, int(cd31[y, x]), 0, int(ki67[y, x]), 0) for y in range(side) for x in range(side)], "tile bigint, x int, y int, cd31 bigint, sma bigint, ki67 bigint, pcna bigint")
    monkeypatch.setattr(rastering, "channels", lambda *_: frame)
    u = plane(QUERIES["steady_supply"](spark, "").collect(), side, 0)
    low, high = np.percentile(ki67, [1, 99])
    k = 0.1 + 0.3 * (np.clip(ki67, low, high) - low) / (high - low)
    assert np.abs(u - solved((cd31 > 0).astype(float), k)).max() < 0.004
    assert u[5, 12] > 0.001 and u[5, 5] == pytest.approx(u.max())
