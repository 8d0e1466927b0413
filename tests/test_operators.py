"""Typing, reports, rasters, grids and fields: known values, hand-made tables and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import markers, scores
from tessera.operators import fields, grids, matching, rasters, reports, typing
from tessera.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(*v):
    return dict(zip(scores.CLASSES, map(F.lit, v)))


def test_class_ties_and_priors(spark):
    assert one(spark, scores.argmax_class(lits(0.4, 0.4, 0.2))) == "cancer"
    assert one(spark, scores.argmax_class(lits(0.2, 0.4, 0.4))) == "immune"
    assert [one(spark, scores.prior(F.lit(k))["cancer"]) for k in (1, 2, 5, 9)] == [1.0, 0.0, 0.5, pytest.approx(1 / 3)]
    assert one(spark, scores.argmax_class(scores.prior(F.lit(5)))) == "cancer"


def test_fusion(spark):
    fused = scores.fuse(F.lit(2), lits(0.6, 0.3, 0.1))
    assert [round(one(spark, fused[c]), 6) for c in scores.CLASSES] == [0.42, 0.51, 0.07]
    unsure = scores.fuse(F.lit(3), lits(0.39, 0.31, 0.3))
    assert [one(spark, unsure[c]) for c in scores.CLASSES] == [0.0, 0.0, 1.0]
    assert round(one(spark, scores.fuse(F.lit(77), lits(1.0, 0.0, 0.0))["cancer"]), 6) == 0.9


@pytest.mark.parametrize(("gap", "mismatch", "want"), [(0.25, False, "high"), (0.25, True, "medium"), (0.12, False, "medium"), (0.2, True, "low"), (0.1, False, "low"), (0.1, True, "low")])
def test_confidence(spark, gap, mismatch, want):
    assert one(spark, scores.confidence(F.lit(gap), F.lit(mismatch))) == want


def test_states_and_types(spark):
    assert [one(spark, scores.state(F.lit(k), F.lit(v), F.lit(5.0))) for k, v in ((4, 9.0), (1, 5.0), (1, 4.9))] == ["dead", "proliferative", "quiescent"]
    limit = {k: F.lit(10.0) for k in ("Ki67", "PCNA", "Vimentin", "Keratin", "Ecadherin_high")} | {"Ecadherin": F.lit(2.0)}
    value = lambda **kw: {k: F.lit(float(kw.get(k, 5))) for k in ("Ki67", "PCNA", "Vimentin", "Keratin", "Ecadherin")}
    got = [one(spark, scores.legacy_state(F.lit(k), value(**v), limit)) for k, v in ((4, {}), (0, {"PCNA": 10}), (0, {"Vimentin": 11, "Ecadherin": 1}), (0, {"Keratin": 10, "Ecadherin": 10}), (0, {"Ecadherin": 10}), (0, {}))]
    assert got == ["apoptotic", "proliferative", "emt", "quiescent", "healthy", "other"]
    low = {"CD45": F.lit(1.0), "SMA": F.lit(9.0)}
    assert one(spark, scores.legacy_type(low, {"CD45": F.lit(5.0), "SMA": F.lit(5.0)})) == "stromal"


def test_margins_and_labels(spark):
    assert one(spark, scores.class_margin(F.lit("immune"), lits(0.05, 0.9, 0.15))) == pytest.approx(0.75)
    assert one(spark, scores.class_margin(F.lit("other"), lits(0.05, 0.9, 0.15))) is None
    assert one(spark, scores.margin([F.lit(v) for v in (0.92, 0.05, 0.03)])) == pytest.approx(0.87)
    got = [one(spark, scores.mapped_class(F.lit(k), F.lit(p))) for k, p in (("1", None), ("5", " Healthy"), ("5", "x"), ("a", None))]
    assert got == ["cancer", "healthy", "other", "other"]
    assert [one(spark, scores.truthy(F.lit(v))) for v in (" YES", "1", "no", None)] == [True, True, False, False]
    assert [one(spark, scores.safe_double(F.lit(v), 7.0)) for v in ("1.5", "x", None, "NaN")] == [1.5, 7.0, 7.0, 7.0]


def test_marker_names(spark):
    names = ["Pan-CK", " pan ck ", "SMA", "CD3e", "Na/K ATPase", "DAPI", "PD-1", None]
    got = [one(spark, markers.canonical_name(F.lit(n))) for n in names]
    assert got == ["PanCK", "PanCK", "aSMA", "CD3e", "NaKATPase", "DAPI", "PD1", None]
    assert markers.by_marker(["x", "E-cadherin", "Pan CK", "PanCK", "CD3"]) == {"x": ["x"], "Ecadherin": ["E-cadherin"], "PanCK": ["Pan CK", "PanCK"], "CD3": ["CD3"]}
    assert files.missing_markers(["x", "E-cadherin"], ["Ecadherin", "CD31"]) == ["CD31"]
    df = spark.createDataFrame([(None, 3.0), (float("nan"), 4.0)], "`Pan-CK` double, Keratin double")
    assert [r.v for r in df.select(markers.marker_value(df.columns, "PanCK").alias("v")).collect()] == [3.0, 4.0]
    assert one(spark, markers.marker_value([], "CD4")) == 0.0


def test_find_channels(spark):
    listed = spark.createDataFrame([("s", 0, "DAPI"), ("s", 1, "Pan-CK"), ("s", 2, " cd31 "), ("s", 3, "CD31"), ("s", 4, "SMA-2"), ("s", 5, None), ("t", 0, "Aortic smooth muscle actin")], "k string, i int, n string")
    found = markers.find_channels(listed, ["k"], "i", "n", ["CD31", "PanCK", "SMA", "CD4"])
    got = {(r.k, r.wanted): (r.i, r.how) for r in found.collect()}
    assert got["s", "CD31"] == (2, "exact") and got["s", "PanCK"] == (1, "canonical") and got["s", "SMA"] == (4, "contains") and got["s", "CD4"] == (None, None)
    assert got["t", "SMA"] == (0, "canonical") and len(got) == 8
    with pytest.raises(ValueError, match="no channel for CD31, CD4, PanCK; there are Aortic"):
        markers.require_channels(found, listed, "i", "n")
    markers.require_channels(found.where("wanted = 'SMA'"), listed, "i", "n")
    assert markers.find_channels(listed.limit(0), ["k"], "i", "n", ["CD31"]).count() == 0


def test_argument_checks(spark):
    with pytest.raises(ValueError, match="share"):
        grids.overlapping(spark.range(1).withColumn("overlap", F.lit(1.0)), 1.5)
    grids.inside(0, 0, 10, 10, 10, 10)
    for box in ((-1, 0, 5, 5), (6, 0, 5, 5), (0, 0, 0, 5)):
        with pytest.raises(ValueError, match="not inside"):
            grids.inside(*box, 10, 10)


def test_softmax_and_collapse(spark):
    soft = scores.softmax({"a": F.lit(2.0), "b": F.lit(2.0)})
    assert [one(spark, v) for v in soft.values()] == [0.5, 0.5]
    none = scores.collapse({k: F.lit(0.0) for k in scores.SIGNATURES})
    assert [one(spark, v) for v in none.values()] == [0.0, 0.0, 0.0]
    sig = scores.signature_scores({"CD31": F.lit(1.0), "PanCK": F.lit(-2.0)})
    assert [round(one(spark, sig[k]), 6) for k in ("endothelial", "epithelial", "b_cell")] == [1.0, -2.35, 0.0]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 60, (200, 2)), rng.integers(0, 60, (80, 2))
    cells = spark.createDataFrame([(i, i % 2, int(x), int(y)) for i, (x, y) in enumerate(a)] + [(999, None, 1, 1), (998, 0, None, 1)], "cell bigint, s int, x int, y int")
    feats = spark.createDataFrame([(i, i % 2, int(x), int(y)) for i, (x, y) in enumerate(b)], "row_idx bigint, s int, x int, y int")
    got = {r.cell: (r.match_id, r.distance) for r in matching.nearest(cells, feats, ["s"], 4.0, "row_idx").collect()}
    assert len(got) == 202 and got[999] == got[998] == (None, None)
    for i, p in enumerate(a):
        near = min(((math.dist(p, q), j) for j, q in enumerate(b) if j % 2 == i % 2), default=(9, None))
        assert got[i] == ((near[1], pytest.approx(near[0])) if near[0] <= 4 else (None, None))
    assert matching.nearest(cells.limit(0), feats, ["s"], 4.0, "row_idx").count() == 0


def test_nearest_keeps_equal_rows(spark):
    cells = spark.createDataFrame([(1, 0, 5, 5)] * 3 + [(2, 0, 50, 50)] * 2 + [(3, None, None, 1)] * 2, "cell bigint, s int, x int, y int")
    feats = spark.createDataFrame([(7, 0, 5, 6), (8, 0, 6, 6)], "row_idx bigint, s int, x int, y int")
    got = sorted((r.cell, r.match_id) for r in matching.nearest(cells, feats, ["s"], 4.0, "row_idx").select("cell", "match_id").collect())
    assert got == [(1, 7)] * 3 + [(2, None)] * 2 + [(3, None)] * 2


def test_nearest_in_a_dense_place(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 12, (300, 2)), rng.integers(0, 12, (90, 2))
    cells = spark.createDataFrame([(i, None if i % 50 == 0 else 0, int(x), int(y)) for i, (x, y) in enumerate(a)], "cell bigint, s int, x int, y int")
    feats = spark.createDataFrame([(i, 0, int(x), int(y)) for i, (x, y) in enumerate(b)], "row_idx bigint, s int, x int, y int")
    few, many = (matching.nearest(cells, feats, ["s"], 4.0, "row_idx", dense) for dense in (2000, 7))
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr) and many.count() == 300


def test_greedy_pairs_of_parts_equal_those_of_the_whole(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 90, (150, 2)), rng.integers(0, 90, (120, 2))
    cells = spark.createDataFrame([(i, "p", float(x), float(y)) for i, (x, y) in enumerate(a)] + [(500, "p", None, 1.0)], "id bigint, k string, x double, y double")
    rows = spark.createDataFrame([(i, "p", float(x), float(y)) for i, (x, y) in enumerate(b)], "id bigint, k string, x double, y double")
    used, want = set(), {500: None}
    for i, p in enumerate(a):
        near = min(((math.dist(p, q), j) for j, q in enumerate(b) if j not in used), default=(99, None))
        want[i] = near[1] if near[0] <= 5 else None
        used |= {want[i]} - {None}
    assert {r.id: r.match_id for r in matching.greedy_pairs(cells, rows, ["k"], 5.0).collect()} == want
    assert matching.greedy_pairs(cells.limit(0), rows, ["k"], 5.0).count() == 0


def test_greedy_pairs(spark):
    cells = spark.createDataFrame([(1, "p", 0.0, 0.0), (2, "p", 1.0, 0.0), (3, "p", 50.0, 0.0), (1, "q", 0.0, 0.0)], "id bigint, k string, x double, y double")
    rows = spark.createDataFrame([(10, "p", 1.0, 0.0), (11, "p", 3.0, 0.0), (12, "p", -1.0, 0.0)], "id bigint, k string, x double, y double")
    got = {(r.k, r.id): r.match_id for r in matching.greedy_pairs(cells, rows, ["k"], 6.0).collect()}
    assert got == {("p", 1): 10, ("p", 2): 11, ("p", 3): None, ("q", 1): None}


def test_rank_share(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 5.0), ("s", 3, 9.0), ("s", 4, None), ("t", 5, 1.0), ("t", 6, None)], "s string, i int, m double")
    got = {r.i: r.share for r in typing.rank_share(typing.long_form(df, ["s", "i"], ["m"]), ["s", "marker"]).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: 0.0, 5: 0.5, 6: 0.5}


def test_standardise_a_constant(spark):
    long = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, None)], "marker string, i int, value double")
    z = [r.z for r in typing.standardise(long.where("value is not null"), ["marker"]).collect()]
    assert z == [0.0, 0.0]


ASSIGNED = "cell_id bigint, patch_id string, cell_type string, cell_type_confidence string, is_mismatch boolean, p_final_cancer double, p_final_immune double, p_final_healthy double, p_model_cancer double, p_model_immune double, p_model_healthy double"


def assigned(spark):
    row = lambda i, p, t, c, m, *probs: (i, p, t, c, m, *probs, *probs)
    rows = [
        row(1, "good", "cancer", "high", False, 0.9, 0.05, 0.05), row(2, "good", "cancer", "low", False, 0.4, 0.35, 0.25), row(3, "bad", "cancer", "medium", True, 0.5, 0.3, 0.2),
        row(4, "bad", "immune", "Low", True, 0.3, 0.4, 0.3), row(5, None, "immune", None, None, None, math.nan, 0.2), row(6, "good", None, "high", False, 0.1, 0.8, 0.1),
    ]
    return spark.createDataFrame(rows, ASSIGNED)


def test_patch_summary(spark):
    s = reports.patch_summary(assigned(spark), ["patch_id"])
    got = {r.patch_id: (r.n_cells, r.mismatch_count, r.low_confidence_count, r.mismatch_rate) for r in s.collect()}
    assert got == {"good": (3, 0, 1, 0.0), "bad": (2, 2, 1, 1.0), None: (1, 0, 0, 0.0)}
    assert [r.patch_id for r in reports.top_patches(s.where("patch_id is not null"), 2, ["patch_id"]).collect()] == ["bad", "good"]


def test_representatives(spark):
    got = {(r.cell_type, r.example_kind): r.cell_id for r in reports.representatives(assigned(spark), "cell_id").collect()}
    assert got == {("cancer", "match"): 1, ("cancer", "ambiguous"): 2, ("cancer", "disagreement"): 3, ("immune", "ambiguous"): 4}


def test_agree_medium_disagree(spark):
    got = {r.example_kind: r.cell_id for r in reports.agree_medium_disagree(assigned(spark), "cell_id").collect()}
    assert got == {"agree": 1, "medium": 2, "disagree": 3}


def test_confusion_and_panel(spark):
    df = spark.createDataFrame([("cancer", "cancer"), ("cancer", "immune"), ("x", "immune")], "a string, b string")
    got = {(r.a, r.b): (r.n, r.share) for r in reports.confusion(df, "a", "b").collect()}
    assert len(got) == 9 and got["cancer", "immune"] == (1, 0.5) and got["healthy", "cancer"] == (0, 0.0)
    panel = {r.cell_type: (r.n, r.agree, r.medium, r.disagree) for r in reports.class_panel(assigned(spark)).collect()}
    assert panel == {"cancer": (3, 1, 1, 1), "immune": (2, 0, 1, 1)}


def test_best_marker(spark):
    rows = [("g", "a", "CD45", 1.0), ("g", "b", "CD45", 9.0), ("g", "a", "SMA", 3.0), ("g", "b", "SMA", 11.0), ("g", None, "SMA", 99.0), ("g", "a", "DAPI", None)]
    df = spark.createDataFrame(rows, "k string, t string, marker string, value double")
    assert [(r.marker, r.spread) for r in reports.best_marker(df, ["k"], "t").collect()] == [("CD45", 8.0)]


def pixels(spark, array, key="t"):
    return spark.createDataFrame([(key, int(x), int(y), int(v)) for (y, x), v in np.ndenumerate(np.asarray(array))], "tile string, x int, y int, v bigint")


def test_otsu_and_status(spark):
    px = pixels(spark, np.where(np.arange(64).reshape(8, 8) % 8 < 4, 10, 90)).unionByName(pixels(spark, np.full((2, 2), 7), "flat"))
    got = {r.tile: r.threshold for r in rasters.otsu(px, ["tile"]).collect()}
    assert got == {"t": 10, "flat": 0}
    masks_ = spark.createDataFrame([("e", False, False), ("f", False, True), ("n", True, False), ("o", True, True), ("o", False, True)], "k string, c boolean, f boolean")
    got = {r.k: r.status for r in rasters.mask_status(masks_, F.col("c"), F.col("f"), ["k"]).collect()}
    assert got == {"e": "empty", "f": "empty_fallback", "n": "noisy_fallback", "o": "ok"}
    with pytest.raises(ValueError):
        rasters.mask_status(masks_, F.col("c"), F.col("f"), ["k"], 0.0)


def test_norms(spark):
    flat = rasters.percentile_norm(pixels(spark, [[5, 5], [5, 5]]), ["tile"], "v")
    assert {r.norm for r in flat.collect()} == {0.0}
    assert sorted(r.u8 for r in rasters.stretch_u8(pixels(spark, [[0, 1], [2, 3]]), ["tile"], "v").collect()) == [0, 85, 170, 255]
    with pytest.raises(ValueError):
        rasters.overview(flat, 0, 2, 2)
    w = rasters.window_read(pixels(spark, [[1, 2], [3, 4]]), ["tile"], 1, 1, 2, 2)
    assert {(r.wx, r.wy): r.v for r in w.collect()} == {(0, 0): 4, (1, 0): 0, (0, 1): 0, (1, 1): 0}


def test_grid_and_boxes(spark):
    s = spark.createDataFrame([("a", 512, 512, 256, 256), ("b", 100, 512, 256, 256), ("c", 600, 300, 256, 128)], "slide_id string, img_w int, img_h int, patch_size int, stride int")
    got = grids.patch_grid(s)
    assert {r.slide_id: r.n for r in got.groupBy("slide_id").agg(F.count("*").alias("n")).collect()} == {"a": 4, "c": 3}
    crops = {t: one(spark, grids.parse_crop(F.lit(t))) for t in ("1,2", " 1, 2, 3", "1,2,3,4,", "1", "a,2", "")}
    assert [tuple(crops[t]) for t in ("1,2", " 1, 2, 3", "1,2,3,4,")] == [(1, 2, 512, 512), (1, 2, 3, 3), (1, 2, 3, 4)] and crops["1"] is crops["a,2"] is crops[""] is None
    share = lambda *v: one(spark, grids.overlap_share(*map(F.lit, v)))
    assert share(0, 0, 10, 10, 10) == 1.0 and share(5, 0, 10, 10, 10) == pytest.approx(0.5) and share(50, 0, 10, 10, 10) == 0.0
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    m = grids.polygon_measures(square)
    assert [one(spark, m[k]) for k in ("area", "cx", "cy", "max_x")] == [8.0, 2.0, 1.0, 4.0]
    empty = grids.polygon_measures(F.slice(square, 1, 0))
    assert one(spark, empty["area"]) == 0.0 and one(spark, empty["cx"]) is None


def test_supply(spark):
    assert [round(one(spark, fields.uptake(F.lit(d), F.lit(i))), 6) for d, i in ((0.0, 0.0), (1.0, 0.0), (5.0, 1.0))] == [0.1, 0.4, 0.5]
    with pytest.raises(ValueError):
        fields.uptake(F.lit(0.0), base=-1)
    assert one(spark, fields.clamped(F.lit(float("inf")), 1.0, 160.0)) == 1.0
    assert one(spark, fields.decay(F.lit(True), F.lit(0.0), F.lit(0.1), 1.0, 160.0)) == 1.0
    assert one(spark, fields.decay(F.lit(False), F.lit(160.0), F.lit(0.1), 1.0, 160.0)) == pytest.approx(math.exp(-1))
    px = spark.createDataFrame([(0.0, 1.0), (9.0, 3.0), (25.0, 5.0), (1e9, 7.0)], "d double, v double")
    got = fields.profile(px, F.col("d"), F.col("v"), 10.0, 30.0).orderBy("bin").collect()
    assert [(r.distance_um, r.pixel_count, r["mean"]) for r in got] == [(5.0, 2, 2.0), (15.0, 0, None), (25.0, 1, 5.0), (35.0, 1, 7.0)]
    with pytest.raises(ValueError):
        fields.profile(px, F.col("d"), F.col("v"), 0.0, 30.0)
    curve = spark.createDataFrame([(1.0, 0.0, 0.0), (1.0, 10.0, 1.0), (1.0, 20.0, 0.0)], "d double, at double, u double")
    at = spark.createDataFrame([(5.0,), (10.0,), (20.0,), (21.0,), (-1.0,)], "p double")
    assert sorted((r.p, r.u_at) for r in fields.interpolate(at, curve, "p").collect()) == [(5.0, 0.5), (10.0, 1.0), (20.0, 0.0)]
    pairs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "k string, a double, b double")
    assert {r.k: round(r.r, 6) for r in fields.correlation(pairs, ["k"], "a", "b").collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
