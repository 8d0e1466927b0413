"""Queries of reports, patch grids, channel names and coordinates over the given tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import markers, scores
from tessera.operators import grids, reports
from tessera.operators.dedup import keep_first, ordinals
from tessera.plans.fixtures import CELLS_SQL, cells
from tessera.sources.files import split_suffix
from tessera.sources.tables import table


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _assignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cell_assignments")


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """Assignments with the class in its plain spelling."""
    return _assignments(spark, d).withColumn("cell_type", F.lower(F.trim("cell_type")))


def patch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cells, mismatches, low confidence, mean score, mean margin and mismatch rate of each patch."""
    s = reports.patch_summary(_assignments(spark, d))
    return s.select("slide_id", "patch_id", "n_cells", "mismatch_count", "low_confidence_count", *[r6(F.col(c)).alias(c) for c in ("mean_confidence_score", "mean_final_margin", "mismatch_rate")])


def top_patches(spark: SparkSession, d: str) -> DataFrame:
    """The 25 patches that most need a look."""
    s = reports.patch_summary(_assignments(spark, d).where("slide_id is not null and patch_id is not null"))
    return reports.top_patches(s, 25).select("slide_id", "patch_id", "n_cells", "mismatch_count", "low_confidence_count", r6(F.col("mismatch_rate")).alias("mismatch_rate"))


def representative_cells(spark: SparkSession, d: str) -> DataFrame:
    """A match, an ambiguous cell and a disagreement of each class."""
    df = _clean(spark, d).where("patch_id is not null")
    return reports.representatives(df, "row_id").select("cell_type", "example_kind", "row_id", "confidence_score", r6(F.col("final_margin")).alias("final_margin"))


def agree_medium_disagree(spark: SparkSession, d: str) -> DataFrame:
    """Three rows by model margin."""
    return reports.agree_medium_disagree(_clean(spark, d), "row_id").select("example_kind", "row_id", r6(F.col("codex_margin")).alias("codex_margin"))


def _probs() -> dict[str, Column]:
    return {c: F.coalesce(F.nanvl(f"p_model_{c}", F.lit(None)), F.lit(0.0)) for c in scores.CLASSES}


def class_margin(spark: SparkSession, d: str) -> DataFrame:
    """Model margin of every cell with one of the three classes."""
    df = _clean(spark, d).where(F.col("cell_type").isin(*scores.CLASSES))
    return df.select("row_id", r6(scores.class_margin(F.col("cell_type"), _probs())).alias("codex_margin"))


def confusion_3x3(spark: SparkSession, d: str) -> DataFrame:
    """Final class against the segmentation's class, dense."""
    df = _clean(spark, d).withColumn("mapped", scores.mapped_class(F.col("type_cellvit"), F.col("type_cellvit_prior")))
    c = reports.confusion(df.where(F.col("cell_type").isin(*scores.CLASSES)), "cell_type", "mapped")
    return c.select("cell_type", "mapped", "n", r6(F.col("share")).alias("share"))


def class_panel(spark: SparkSession, d: str) -> DataFrame:
    """Agreement counts per class."""
    p = reports.class_panel(_clean(spark, d))
    return p.withColumn("mismatch_rate", r6(F.col("mismatch_rate")))


def best_marker(spark: SparkSession, d: str) -> DataFrame:
    """The marker that parts the classes best, per slide."""
    from tessera.operators.typing import long_form

    long = long_form(_clean(spark, d), ["slide_id", "cell_type"], ["pan_ck", "cd45", "sma", "ki67"])
    return reports.best_marker(long, ["slide_id"], "cell_type").select("slide_id", "marker", r6(F.col("spread")).alias("spread"))


def display_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells by class under display names, most first."""
    name = F.coalesce(F.initcap(F.lower(F.trim("cell_type"))), F.lit("Unknown"))
    return _assignments(spark, d).groupBy(name.alias("label")).agg(F.count("*").alias("n"), F.count_if(scores.truthy(F.col("is_mismatch"))).alias("n_mismatch")).orderBy(F.desc("n"), "label")


def majority_type(spark: SparkSession, d: str) -> DataFrame:
    """The commonest segmentation class of each patch; ties to the smaller id."""
    counts = _assignments(spark, d).where("type_cellvit is not null").groupBy("slide_id", "patch_id", "type_cellvit").agg(F.count("*").alias("n"))
    return counts.groupBy("slide_id", "patch_id").agg(F.max_by("type_cellvit", F.struct("n", -F.col("type_cellvit"))).alias("majority"), F.sum("n").alias("n"))


def channel_panel(spark: SparkSession, d: str) -> DataFrame:
    """The channel list: 0-based place and original name, the first of each name whatever its case."""
    p = table(spark, d, "channel_panel").where("channel_number is not null and marker_name is not null").withColumns({"channel_index": F.col("channel_number") - 1, "key": F.lower(F.trim("marker_name"))})
    return keep_first(p, ["key"], [F.asc("channel_number"), F.asc("marker_name")], ["marker_name"]).select("key", "channel_index", "marker_name")


def channel_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Places of each slide's channels in the panel by name, with those the panel lacks."""
    used = grids.latest(table(spark, d, "slide_index")).select("slide_id", F.explode("channels").alias("name")).groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count("*").alias("n_slides"))
    return used.join(channel_panel(spark, d).select("key", "channel_index"), "key", "left").select("key", "n_slides", "channel_index", F.col("channel_index").isNull().alias("missing"))


def alias_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical and normal form of every spelling among the slides' channels."""
    names = table(spark, d, "slide_index").select(F.explode("channels").alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", markers.normal_form(F.col("name")).alias("normal"), markers.canonical_name(F.col("name")).alias("canonical"))


def keep_first_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered cell once, by its first load."""
    k = keep_first(_assignments(spark, d).select("row_id", "slide_id", "cell_id", "loaded_at"), ["slide_id", "cell_id"], [F.asc_nulls_last("loaded_at"), F.asc("row_id")], ["row_id"])
    return k.select("row_id", "slide_id", "cell_id")


def _slides(spark: SparkSession, d: str) -> DataFrame:
    return grids.latest(table(spark, d, "slide_index"))


def patch_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every patch of every slide's grid."""
    return grids.patch_grid(_slides(spark, d).select("slide_id", "img_w", "img_h", "patch_size", "stride")).select("slide_id", "x0", "y0")


MASK_STEP = 64


def _tissue(index: DataFrame) -> DataFrame:
    masked = index.select("slide_id", "patch_size", F.explode("patches").alias("p")).where("p.has_mask").select("slide_id", "patch_size", F.col("p.x0").alias("x0"), F.col("p.y0").alias("y0"))
    wide, high = F.lit(1 << 20), F.lit(1 << 20)
    mask = grids.covered_cells(masked, MASK_STEP, wide, high).select("slide_id", "mx", "my").distinct()
    grid = grids.patch_grid(index.select("slide_id", "img_w", "img_h", "patch_size", "stride", "tissue_min"))
    width, height = F.floor(F.col("img_w") / MASK_STEP), F.floor(F.col("img_h") / MASK_STEP)
    return grids.tissue_patches(grid, mask, MASK_STEP, width, height, F.col("tissue_min"))


def tissue_patches(spark: SparkSession, d: str) -> DataFrame:
    """Of every revision of every slide the grid patches whose tissue share reaches its limit; tissue is where the revision's patches have a mask."""
    each = table(spark, d, "slide_index").withColumn("slide_id", F.struct("slide_id", "rev"))
    kept = _tissue(grids.latest(each))
    return kept.select("slide_id.slide_id", "slide_id.rev", "x0", "y0", r6(F.col("tissue")).alias("tissue"))


def valid_tissue_patches(spark: SparkSession, d: str) -> DataFrame:
    """Grid patches whose tissue share reaches the slide's limit; tissue is where the valid revision's patches have a mask."""
    return _tissue(_slides(spark, d)).select("slide_id", "x0", "y0", r6(F.col("tissue")).alias("tissue"))


def mx_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Place of each indexed patch on the other image, its overlap with it, and whether it is whole."""
    s = _slides(spark, d).select("slide_id", "patch_size", "img_w", "img_h", F.coalesce("mpp_scale", F.lit(1.0)).alias("scale"), F.explode("patches").alias("p")).select("*", F.col("p.x0").alias("x0"), F.col("p.y0").alias("y0"))
    b = s.withColumns(grids.multiplex_box(F.col("scale")))
    w, h = (F.floor(F.col(c) * F.col("scale") * 0.8) for c in ("img_w", "img_h"))
    o = grids.overlap_share(F.col("mx_x0"), F.col("mx_y0"), F.col("mx_size"), w, h)
    return b.select("slide_id", "x0", "y0", "mx_x0", "mx_y0", "mx_size", r6(o).alias("overlap"), (o >= 1.0).alias("whole"))


def extent_check(spark: SparkSession, d: str) -> DataFrame:
    """Scale and physical extents of both images of a slide, and whether they agree within 5 %."""
    s = _slides(spark, d).where("he_mpp is not null and mx_mpp is not null").withColumns({"mx_w": F.floor(F.col("img_w") * 0.47), "mx_h": F.floor(F.col("img_h") * 0.52)})
    a, b = (F.col(f"img_{k}") * F.col("he_mpp") for k in "wh")
    c, e = (F.col(f"mx_{k}") * F.col("mx_mpp") for k in "wh")
    dw, dh = (F.abs(p - q) / F.greatest(p, q) * 100 for p, q in ((a, c), (b, e)))
    return s.select("slide_id", r6(F.col("he_mpp") / F.col("mx_mpp")).alias("scale"), r6(dw).alias("diff_w"), r6(dh).alias("diff_h"), ((dw <= 5) & (dh <= 5)).alias("agrees"))


def coord_convert(spark: SparkSession, d: str) -> DataFrame:
    """Cell positions on the slide, in micrometres and on the other image; without mpp the scale column, else 1."""
    s = _slides(spark, d).select("slide_id", "he_mpp", F.coalesce(F.col("he_mpp") / F.col("mx_mpp"), "mpp_scale", F.lit(1.0)).alias("scale"))
    x, y = F.col("patch_x0") + F.col("centroid_x_local"), F.col("patch_y0") + F.col("centroid_y_local")
    c = _assignments(spark, d).where("patch_x0 is not null and not isnan(centroid_x_local) and not isnan(centroid_y_local)").join(s, "slide_id")
    return c.select("row_id", r6(x).alias("x_he"), r6(y).alias("y_he"), r6(x * F.col("he_mpp")).alias("x_um"), r6(x * F.col("scale")).alias("x_mx"), r6(y * F.col("scale")).alias("y_mx"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    c = _assignments(spark, d).select("slide_id", (F.col("patch_x0") + F.nanvl("centroid_x_local", F.lit(None))).alias("x"), (F.col("patch_y0") + F.nanvl("centroid_y_local", F.lit(None))).alias("y"))
    return c.join(_slides(spark, d).select("slide_id", "img_w", "img_h"), "slide_id")


def dense_tile(spark: SparkSession, d: str) -> DataFrame:
    """The window of 1,024 pixels with most cells, per slide."""
    return grids.dense_window(_placed(spark, d), ["slide_id"], 1024)


def bounds_split(spark: SparkSession, d: str) -> DataFrame:
    """Cells inside and outside the image and inside a zoom window, per slide."""
    p = _placed(spark, d).where("x is not null and y is not null")
    inside = (F.col("x") >= 0) & (F.col("x") < F.col("img_w")) & (F.col("y") >= 0) & (F.col("y") < F.col("img_h"))
    zoom = F.col("x").between(1000, 2999.999) & F.col("y").between(1000, 2999.999)
    return p.groupBy("slide_id").agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"), F.count_if(inside & zoom).alias("n_zoom"))


def _patch_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    index = _slides(spark, d).select("slide_id", F.explode("patches").alias("p")).select("slide_id", F.concat_ws("_", "p.x0", "p.y0").alias("patch_id"), F.coalesce("p.has_multiplex", F.lit(False)).alias("has_multiplex")).distinct()
    files = table(spark, d, "stage_files").where("kind = 'cellvit'").select("slide_id", F.regexp_extract("file_path", r"([0-9]+_[0-9]+)\.json$", 1).alias("patch_id")).where("patch_id <> ''").distinct()
    named = _assignments(spark, d).select("slide_id", F.trim("patch_id").alias("patch_id")).distinct()
    return index, files, named


def available_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches that are indexed, have a cell file and have assignments."""
    index, files, named = _patch_keys(spark, d)
    return index.join(files, ["slide_id", "patch_id"], "left_semi").join(named, ["slide_id", "patch_id"], "left_semi").select("slide_id", "patch_id")


def todo_patches(spark: SparkSession, d: str) -> DataFrame:
    """Indexed patches whose cell file is not there yet."""
    index, files, _ = _patch_keys(spark, d)
    return index.join(files, ["slide_id", "patch_id"], "left_anti").select("slide_id", "patch_id", "has_multiplex")


def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per slide: indexed patches, those without a cell file, those without assignments."""
    index, files, named = _patch_keys(spark, d)
    j = index.join(files.withColumn("f", F.lit(1)), ["slide_id", "patch_id"], "left").join(named.withColumn("a", F.lit(1)), ["slide_id", "patch_id"], "left")
    return j.groupBy("slide_id").agg(F.count("*").alias("n_patches"), F.count_if(F.col("f").isNull()).alias("no_file"), F.count_if(F.col("a").isNull()).alias("no_cells"))


def patch_key_union(spark: SparkSession, d: str) -> DataFrame:
    """All patch names that any of the three sources knows, once."""
    index, files, named = _patch_keys(spark, d)
    keys = ["slide_id", "patch_id"]
    return index.select(*keys).unionByName(files).unionByName(named.where("patch_id is not null")).distinct().groupBy("slide_id").agg(F.count("*").alias("n_patches"))


MATRIX = ((0.5, 0.01, 3.25), (-0.02, 0.48, 40.0))


def affine_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around cells mapped to the other image, kept where they lie inside it."""
    c = cells(spark, d).select("cell_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.lit(16) + F.col("cell_id") % 32).alias("w"))
    b = c.select("cell_id", "x0", "y0", *[v.cast("bigint").alias(k) for k, v in grids.mapped_box(MATRIX, F.col("x0"), F.col("y0"), F.col("w"), F.col("w")).items()])
    return b.where("bx >= 0 and by >= 0 and bx + bw <= 512 and by + bh <= 512")


def _placed_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches of the valid revisions, each once, with their box on the other image, which is 0.8 of the scaled size."""
    s = _slides(spark, d).select("slide_id", "patch_size", "stride", "img_w", "img_h", F.coalesce("mpp_scale", F.lit(1.0)).alias("scale"), F.explode("patches").alias("p")).distinct()
    s = s.select("*", F.col("p.x0").alias("x0"), F.col("p.y0").alias("y0"), F.coalesce("p.multiplex_overlap_fraction", F.lit(0.0)).alias("f"), F.coalesce("p.has_mask", F.lit(False)).alias("m"), F.coalesce("p.has_multiplex", F.lit(False)).alias("has_multiplex"))
    return s.withColumns({"mx_w": F.floor(F.col("img_w") * F.col("scale") * 0.8), "mx_h": F.floor(F.col("img_h") * F.col("scale") * 0.8)} | grids.multiplex_box(F.col("scale")))


def best_crop(spark: SparkSession, d: str) -> DataFrame:
    """Of each slide the crop of two by two patches with the best total of three coverages of its indexed patches, first in scan order.

    Mask on 0.6 of it, mask and other image together on 0.5, mean overlap 0.6 at least; its box on the other image must lie inside that.
    """
    p = _placed_patches(spark, d)
    both = (F.col("m") & F.col("has_multiplex")).cast("double")
    told = p.select("slide_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("dx"), "x0", "y0", "stride", F.col("m").cast("double").alias("a"), both.alias("b"), F.col("f").alias("c"))
    told = told.select("slide_id", (F.col("x0") - F.col("dx") * F.col("stride")).alias("x0"), F.explode(F.array(F.col("y0"), F.col("y0") - F.col("stride"))).alias("y0"), "a", "b", "c")
    cover = told.groupBy("slide_id", "x0", "y0").agg(*[(F.avg(k)).alias(k) for k in "abc"])
    side = F.greatest(F.rint((F.col("stride") + F.col("patch_size")) * F.col("scale")), F.lit(1.0))
    inside = (F.col("mx_x0") >= 0) & (F.col("mx_y0") >= 0) & (F.col("mx_x0") + side <= F.col("mx_w")) & (F.col("mx_y0") + side <= F.col("mx_h"))
    anchors = p.where(inside).select("slide_id", "x0", "y0").distinct()
    ok = anchors.join(cover, ["slide_id", "x0", "y0"]).where("a >= 0.6 and b >= 0.5 and c >= 0.6").withColumn("score", F.round(F.col("a") + F.col("b") + F.col("c"), 9))
    best = ok.withColumn("n", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc("score"), "y0", "x0"))).where("n = 1")
    return best.select("slide_id", "x0", "y0", r6(F.col("score")).alias("score"))


def valid_best_crop(spark: SparkSession, d: str) -> DataFrame:
    """The valid revision's patch with the best total of overlap and mask that each reach their limit, first in scan order, per slide."""
    p = _slides(spark, d).select("slide_id", F.explode("patches").alias("p")).distinct().select("slide_id", F.col("p.x0").alias("x0"), F.col("p.y0").alias("y0"), F.col("p.multiplex_overlap_fraction").alias("f"), F.coalesce("p.has_mask", F.lit(False)).cast("double").alias("m"))
    ok = p.where("f >= 0.6 and m >= 0.5").withColumn("score", F.col("f") + F.col("m"))
    best = ok.withColumn("n", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc("score"), "y0", "x0"))).where("n = 1")
    return best.select("slide_id", "x0", "y0", r6(F.col("score")).alias("score"))


def overlapping_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches whose box lies on the other image by 0.25 at least."""
    o = grids.overlap_share(F.col("mx_x0"), F.col("mx_y0"), F.col("mx_size"), F.col("mx_w"), F.col("mx_h"))
    return grids.overlapping(_placed_patches(spark, d).withColumn("overlap", o), 0.25).select("slide_id", "x0", "y0", r6(F.col("overlap")).alias("overlap"))


def multiplex_patches(spark: SparkSession, d: str) -> DataFrame:
    """Indexed patches that the other image covers and whose cell file is not there yet."""
    return todo_patches(spark, d).where("has_multiplex").select("slide_id", "patch_id")


#: Markers asked of each slide's channels.
WANTED = ("CD31", "Ki67", "aSMA", "PanCK", "CD3", "CD45", "Ecad", "Vimentin")


def channel_find(spark: SparkSession, d: str) -> DataFrame:
    """The channel of each wanted marker in each slide: by name, by meaning, or by a part of the name."""
    listed = _slides(spark, d).select("slide_id", F.posexplode("channels").alias("channel_index", "name"))
    return markers.find_channels(listed, ["slide_id"], "channel_index", "name", WANTED)


def crop_parse(spark: SparkSession, d: str) -> DataFrame:
    """Crop texts of two, three, four and other numbers of parts."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.concat_ws(",", k, k % 7)).when(k % 5 == 1, F.concat_ws(", ", k % 11, k % 13, k % 17)).when(k % 5 == 2, F.concat_ws(",", k % 11, k % 13, k % 17, k % 19)).when(k % 5 == 3, F.concat_ws(",", k % 3)).otherwise(F.concat(F.lit("a,"), k))
    return table(spark, d, "orders").select("o_orderkey", grids.parse_crop(text).alias("c")).select("o_orderkey", *[F.col(f"c.{n}").cast("bigint").alias(n) for n in "xywh"])


def polygon_moments(spark: SparkSession, d: str) -> DataFrame:
    """Area, centroid and bounds of a pentagon around each cell, kept where the area is a nucleus's."""
    c = cells(spark, d)
    r = (F.col("cell_id") % 40 + 3).cast("double")
    corners = ((0, -1), (1, -0.25), (0.5, 1), (-0.5, 1), (-1, -0.25))
    points = F.array(*[F.struct((F.col("x") + r * a).alias("x"), (F.col("y") + r * b).alias("y")) for a, b in corners])
    m = c.select("cell_id", points.alias("p")).select("cell_id", *[v.alias(k) for k, v in grids.polygon_measures(F.col("p")).items()])
    return m.where("area between 30 and 6000").select("cell_id", *[r6(F.col(k)).alias(k) for k in ("area", "cx", "cy", "min_x", "min_y", "max_x", "max_y")])


def json_cells(spark: SparkSession, d: str) -> DataFrame:
    """A number out of JSON text, lenient about missing ones."""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return table(spark, d, "events").select("event_id", F.coalesce(v, F.lit(0.0)).alias("k"))


def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Confidence as a number, labels that are none as 0; markers with null and NaN as 0."""
    a = _assignments(spark, d)
    return a.select("row_id", scores.safe_double(F.col("cell_type_confidence")).alias("conf"), scores.safe_double(F.col("ki67")).alias("ki67"), scores.confidence_score(F.trim("cell_type_confidence")).alias("score"))


SEED = 7


def sample_patches(spark: SparkSession, d: str) -> DataFrame:
    """Twelve indexed patches of each slide, all where it has fewer, in the scattered order of a seeded integer mix."""
    index, _, _ = _patch_keys(spark, d)
    x, y = (F.split("patch_id", "_")[i].cast("bigint") for i in (0, 1))
    by = Window.partitionBy("slide_id").orderBy(((x * 31 + y * 17 + SEED) * 7919) % 1000003, "patch_id")
    return index.select("slide_id", "patch_id").distinct().withColumn("n", F.row_number().over(by)).where("n <= 12")


def cell_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Running cell numbers in the order of patch name (as text) and row."""
    c = _assignments(spark, d).where("patch_id is not null").select("row_id", "patch_id")
    return ordinals(c, [F.asc("patch_id"), F.asc("row_id")], "cell_number").select("row_id", "cell_number")


def stem_parse(spark: SparkSession, d: str) -> DataFrame:
    """Stems and suffixes of file names, some of them under image suffixes."""
    base = F.regexp_extract("file_path", "([^/]+)$", 1)
    name = F.when(F.col("file_id") % 4 == 0, F.concat(base, F.lit(".OME.tif"))).when(F.col("file_id") % 4 == 1, F.concat(F.lit("a.b"), F.lit(".tiff"))).when(F.col("file_id") % 4 == 2, F.regexp_replace(base, r"\.json$", "")).otherwise(base)
    return table(spark, d, "stage_files").select("file_id", *[v.alias(k) for k, v in split_suffix(name).items()])


_GAP = "list_reverse_sort([coalesce(CASE WHEN isnan(p_final_cancer) THEN NULL ELSE p_final_cancer END, 0), coalesce(CASE WHEN isnan(p_final_immune) THEN NULL ELSE p_final_immune END, 0), coalesce(CASE WHEN isnan(p_final_healthy) THEN NULL ELSE p_final_healthy END, 0)])"
_W = f"WITH w AS (SELECT *, lower(trim(cell_type)) AS ct, {_GAP}[1] - {_GAP}[2] AS gap, CASE lower(cell_type_confidence) WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS cs FROM cell_assignments) "
_SUMMARY = "count(*) AS n_cells, sum(coalesce(is_mismatch::INT, 0))::BIGINT AS mismatch_count, count(*) FILTER (WHERE lower(cell_type_confidence) = 'low') AS low_confidence_count"
_MARGIN = "CASE ct WHEN 'cancer' THEN c - greatest(i, h) WHEN 'immune' THEN i - greatest(c, h) WHEN 'healthy' THEN h - greatest(c, i) END"
_M = "WITH q AS (SELECT row_id, lower(trim(cell_type)) AS ct, is_mismatch, coalesce(CASE WHEN isnan(p_model_cancer) THEN NULL ELSE p_model_cancer END, 0) AS c, coalesce(CASE WHEN isnan(p_model_immune) THEN NULL ELSE p_model_immune END, 0) AS i, coalesce(CASE WHEN isnan(p_model_healthy) THEN NULL ELSE p_model_healthy END, 0) AS h FROM cell_assignments), k AS (SELECT row_id, ct, is_mismatch, " + _MARGIN + " AS m FROM q WHERE ct IN ('cancer', 'immune', 'healthy')) "
_SLIDES = "WITH sl AS (SELECT * FROM slide_index QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY rev DESC) = 1) "
_KEYS = _SLIDES + ", ix AS (SELECT DISTINCT slide_id, concat(p.x0, '_', p.y0) AS patch_id, coalesce(p.has_multiplex, FALSE) AS mxp FROM (SELECT slide_id, unnest(patches) AS p FROM sl)), fl AS (SELECT DISTINCT slide_id, regexp_extract(file_path, '([0-9]+_[0-9]+)\\.json$', 1) AS patch_id FROM stage_files WHERE kind = 'cellvit' AND regexp_extract(file_path, '([0-9]+_[0-9]+)\\.json$', 1) <> ''), nm AS (SELECT DISTINCT slide_id, trim(patch_id) AS patch_id FROM cell_assignments) "
_PLACED = _SLIDES + ", pl AS (SELECT a.slide_id, patch_x0 + CASE WHEN isnan(centroid_x_local) THEN NULL ELSE centroid_x_local END AS x, patch_y0 + CASE WHEN isnan(centroid_y_local) THEN NULL ELSE centroid_y_local END AS y, img_w, img_h FROM cell_assignments a JOIN sl ON a.slide_id = sl.slide_id) "
_NULLNAN = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
#: What each normal form means.
_CANON = "(VALUES ('keratin', 'Keratin'), ('panck', 'PanCK'), ('asma', 'aSMA'), ('sma', 'aSMA'), ('aorticsmoothmuscleactin', 'aSMA'), ('pd1', 'PD1'), ('ecadherin', 'Ecadherin'), ('cd3', 'CD3'), ('cd3e', 'CD3e'), ('nakatpase', 'NaKATPase')) AS c(normal, canonical)"
_PATCH_SQL = _SLIDES + ", p AS (SELECT slide_id, patch_size, stride, sc, w, h, p.x0 AS x0, p.y0 AS y0, coalesce(p.multiplex_overlap_fraction, 0) AS f, coalesce(p.has_mask, FALSE) AS m, coalesce(p.has_multiplex, FALSE) AS mxp FROM (SELECT DISTINCT slide_id, patch_size, stride, coalesce(mpp_scale, 1.0) AS sc, floor(img_w*coalesce(mpp_scale, 1.0)*0.8)::BIGINT AS w, floor(img_h*coalesce(mpp_scale, 1.0)*0.8)::BIGINT AS h, unnest(patches) AS p FROM sl)), b AS (SELECT *, round_even(x0*sc, 0)::INT AS mx_x0, round_even(y0*sc, 0)::INT AS mx_y0, greatest(round_even(patch_size*sc, 0), 1)::INT AS mx_size FROM p) "
_POLY = "WITH " + CELLS_SQL + ", p AS (SELECT cell_id, x::DOUBLE AS x, y::DOUBLE AS y, (cell_id % 40 + 3)::DOUBLE AS r FROM cells), c AS (SELECT cell_id, unnest(range(5)) AS i, unnest([x, x + r, x + 0.5*r, x - 0.5*r, x - r]) AS px, unnest([y - r, y - 0.25*r, y + r, y + r, y - 0.25*r]) AS py FROM p), e AS (SELECT a.cell_id, a.px, a.py, b.px AS qx, b.py AS qy FROM c a JOIN c b ON a.cell_id = b.cell_id AND b.i = (a.i + 1) % 5), m AS (SELECT cell_id, sum(px*qy - qx*py) AS t, sum((px+qx)*(px*qy - qx*py)) AS sx, sum((py+qy)*(px*qy - qx*py)) AS sy, min(px) AS min_x, min(py) AS min_y, max(px) AS max_x, max(py) AS max_y FROM e GROUP BY cell_id) "

QUERIES = {f.__name__: f for f in (patch_summary, top_patches, representative_cells, agree_medium_disagree, class_margin, confusion_3x3, class_panel, best_marker, display_counts, majority_type, channel_panel, channel_lookup, alias_canonical, keep_first_cells, patch_grid, tissue_patches, valid_tissue_patches, mx_overlap, extent_check, coord_convert, dense_tile, bounds_split, available_patches, todo_patches, missing_counts, patch_key_union, affine_boxes, best_crop, valid_best_crop, overlapping_patches, multiplex_patches, channel_find, crop_parse, polygon_moments, json_cells, safe_numbers, sample_patches, cell_ordinals, stem_parse)}
ORACLE = {
    "patch_summary": _W + f"SELECT slide_id, patch_id, {_SUMMARY}, round(avg(cs), 6) AS mean_confidence_score, round(avg(gap), 6) AS mean_final_margin, round(sum(coalesce(is_mismatch::INT, 0)) / count(*), 6) AS mismatch_rate FROM w GROUP BY slide_id, patch_id",
    "top_patches": _W + f"SELECT slide_id, patch_id, n_cells, mismatch_count, low_confidence_count, round(rate, 6) AS mismatch_rate FROM (SELECT slide_id, patch_id, {_SUMMARY}, sum(coalesce(is_mismatch::INT, 0)) / count(*) AS rate FROM w WHERE slide_id IS NOT NULL AND patch_id IS NOT NULL GROUP BY slide_id, patch_id) ORDER BY rate DESC, low_confidence_count DESC, n_cells DESC, slide_id, patch_id LIMIT 25",
    "representative_cells": _W + ", v AS (SELECT * FROM w WHERE ct IS NOT NULL AND patch_id IS NOT NULL), a AS (SELECT * FROM v WHERE is_mismatch = FALSE QUALIFY row_number() OVER (PARTITION BY ct ORDER BY cs DESC, gap DESC, patch_id, row_id) = 1), b AS (SELECT * FROM v WHERE row_id NOT IN (SELECT row_id FROM a) QUALIFY row_number() OVER (PARTITION BY ct ORDER BY cs, gap, patch_id, row_id) = 1), c AS (SELECT * FROM v WHERE is_mismatch = TRUE AND row_id NOT IN (SELECT row_id FROM a UNION ALL SELECT row_id FROM b) QUALIFY row_number() OVER (PARTITION BY ct ORDER BY cs DESC, gap DESC, patch_id, row_id) = 1) SELECT ct AS cell_type, example_kind, row_id, cs AS confidence_score, round(gap, 6) AS final_margin FROM (SELECT *, 'match' AS example_kind FROM a UNION ALL SELECT *, 'ambiguous' FROM b UNION ALL SELECT *, 'disagreement' FROM c)",
    "agree_medium_disagree": "WITH k AS (SELECT row_id, is_mismatch, CASE lower(trim(cell_type)) WHEN 'cancer' THEN p_model_cancer - greatest(p_model_immune, p_model_healthy) WHEN 'immune' THEN p_model_immune - greatest(p_model_cancer, p_model_healthy) WHEN 'healthy' THEN p_model_healthy - greatest(p_model_cancer, p_model_immune) END AS m FROM cell_assignments), v AS (SELECT * FROM k WHERE m IS NOT NULL AND NOT isnan(m)), a AS (SELECT * FROM v WHERE is_mismatch = FALSE ORDER BY m DESC, row_id LIMIT 1), b AS (SELECT * FROM v WHERE is_mismatch = FALSE AND row_id NOT IN (SELECT row_id FROM a) ORDER BY m, row_id LIMIT 1), c AS (SELECT * FROM v WHERE is_mismatch = TRUE ORDER BY m DESC, row_id LIMIT 1) SELECT 'agree' AS example_kind, row_id, round(m, 6) AS codex_margin FROM a UNION ALL SELECT 'medium', row_id, round(m, 6) FROM b UNION ALL SELECT 'disagree', row_id, round(m, 6) FROM c",
    "class_margin": _M + "SELECT row_id, round(m, 6) AS codex_margin FROM k",
    "confusion_3x3": "WITH k AS (SELECT lower(trim(cell_type)) AS ct, CASE WHEN type_cellvit = 1 THEN 'cancer' WHEN type_cellvit = 2 THEN 'immune' WHEN type_cellvit = 3 THEN 'healthy' WHEN type_cellvit = 5 AND lower(trim(type_cellvit_prior)) IN ('cancer', 'immune', 'healthy') THEN lower(trim(type_cellvit_prior)) ELSE 'other' END AS mp FROM cell_assignments), dm AS (SELECT unnest(['cancer', 'immune', 'healthy']) AS t), n AS (SELECT a.t AS cell_type, b.t AS mapped, count(k.ct) AS n FROM dm a CROSS JOIN dm b LEFT JOIN k ON k.ct = a.t AND k.mp = b.t GROUP BY ALL) SELECT cell_type, mapped, n, round(CASE WHEN sum(n) OVER (PARTITION BY cell_type) > 0 THEN n / sum(n) OVER (PARTITION BY cell_type) ELSE 0 END, 6) AS share FROM n",
    "class_panel": _M + "SELECT ct AS cell_type, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(is_mismatch, FALSE) AND m >= 0.5) AS agree, count(*) FILTER (WHERE NOT coalesce(is_mismatch, FALSE) AND m < 0.5) AS medium, count(*) FILTER (WHERE coalesce(is_mismatch, FALSE)) AS disagree, round(count(*) FILTER (WHERE coalesce(is_mismatch, FALSE)) / count(*), 6) AS mismatch_rate FROM k GROUP BY ct",
    "best_marker": "WITH l AS (SELECT slide_id, lower(trim(cell_type)) AS ct, unnest(['pan_ck', 'cd45', 'sma', 'ki67']) AS marker, unnest([" + ", ".join(_NULLNAN.format(m) for m in ("pan_ck", "cd45", "sma", "ki67")) + "]) AS v FROM cell_assignments), m AS (SELECT slide_id, marker, ct, median(v) AS m FROM l WHERE ct IS NOT NULL AND v IS NOT NULL GROUP BY ALL), s AS (SELECT slide_id, marker, max(m) - min(m) AS spread FROM m GROUP BY ALL) SELECT slide_id, marker, round(spread, 6) AS spread FROM s QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY spread DESC, marker) = 1",
    "display_counts": "SELECT coalesce(upper(substr(lower(trim(cell_type)), 1, 1)) || substr(lower(trim(cell_type)), 2), 'Unknown') AS label, count(*) AS n, count(*) FILTER (WHERE is_mismatch) AS n_mismatch FROM cell_assignments GROUP BY 1",
    "majority_type": "WITH c AS (SELECT slide_id, patch_id, type_cellvit, count(*) AS n FROM cell_assignments WHERE type_cellvit IS NOT NULL GROUP BY ALL) SELECT slide_id, patch_id, type_cellvit AS majority, sum(n) OVER (PARTITION BY slide_id, patch_id)::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY slide_id, patch_id ORDER BY n DESC, type_cellvit) = 1",
    "channel_panel": "SELECT lower(trim(marker_name)) AS key, channel_number - 1 AS channel_index, marker_name FROM channel_panel WHERE channel_number IS NOT NULL AND marker_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(marker_name)) ORDER BY channel_number, marker_name) = 1",
    "channel_lookup": _SLIDES + ", p AS (SELECT lower(trim(marker_name)) AS key, min(channel_number) - 1 AS channel_index FROM channel_panel WHERE channel_number IS NOT NULL AND marker_name IS NOT NULL GROUP BY 1), u AS (SELECT lower(trim(name)) AS key, count(*) AS n_slides FROM (SELECT unnest(channels) AS name FROM sl) GROUP BY 1) SELECT u.key, n_slides, channel_index, channel_index IS NULL AS missing FROM u LEFT JOIN p USING (key)",
    "alias_canonical": "WITH n AS (SELECT name, count(*) AS n, lower(regexp_replace(trim(name), '[^\\p{L}\\p{N}]', '', 'g')) AS normal FROM (SELECT unnest(channels) AS name FROM slide_index) GROUP BY name) SELECT name, n, n.normal, coalesce(c.canonical, trim(name)) AS canonical FROM n LEFT JOIN " + _CANON + " ON c.normal = n.normal",
    "keep_first_cells": "SELECT row_id, slide_id, cell_id FROM cell_assignments QUALIFY row_number() OVER (PARTITION BY slide_id, cell_id ORDER BY loaded_at NULLS LAST, row_id) = 1",
    "patch_grid": _SLIDES + "SELECT slide_id, (gx.i * stride)::INT AS x0, (gy.i * stride)::INT AS y0 FROM sl, (SELECT unnest(range(400)) AS i) gx, (SELECT unnest(range(400)) AS i) gy WHERE gx.i * stride + patch_size <= img_w AND gy.i * stride + patch_size <= img_h",
    "tissue_patches": "WITH sl AS (SELECT * FROM slide_index QUALIFY row_number() OVER (PARTITION BY slide_id, rev) = 1), fp AS (SELECT DISTINCT slide_id, rev, patch_size, p.x0 AS x0, p.y0 AS y0 FROM (SELECT slide_id, rev, patch_size, unnest(patches) AS p FROM sl) WHERE p.has_mask), mk AS (SELECT DISTINCT slide_id, rev, x0 // 64 + dx.i AS mx, y0 // 64 + dy.i AS my FROM fp, (SELECT unnest(range(16)) AS i) dx, (SELECT unnest(range(16)) AS i) dy WHERE x0 // 64 + dx.i < greatest(x0 // 64 + 1, (x0 + patch_size) // 64) AND y0 // 64 + dy.i < greatest(y0 // 64 + 1, (y0 + patch_size) // 64)), gr AS (SELECT slide_id, rev, (gx.i * stride)::INT AS x0, (gy.i * stride)::INT AS y0, patch_size, tissue_min, img_w // 64 AS w, img_h // 64 AS h FROM sl, (SELECT unnest(range(400)) AS i) gx, (SELECT unnest(range(400)) AS i) gy WHERE gx.i * stride + patch_size <= img_w AND gy.i * stride + patch_size <= img_h), cv AS (SELECT slide_id, rev, x0, y0, tissue_min, x0 // 64 + dx.i AS mx, y0 // 64 + dy.i AS my FROM gr, (SELECT unnest(range(16)) AS i) dx, (SELECT unnest(range(16)) AS i) dy WHERE x0 // 64 + dx.i < least(greatest(x0 // 64 + 1, (x0 + patch_size) // 64), w) AND y0 // 64 + dy.i < least(greatest(y0 // 64 + 1, (y0 + patch_size) // 64), h)) SELECT slide_id, rev, x0, y0, round(avg((mk.mx IS NOT NULL)::INT), 6) AS tissue FROM cv LEFT JOIN mk USING (slide_id, rev, mx, my) GROUP BY slide_id, rev, x0, y0 HAVING avg((mk.mx IS NOT NULL)::INT) >= max(tissue_min)",
    "valid_tissue_patches": _SLIDES + ", fp AS (SELECT DISTINCT slide_id, patch_size, p.x0 AS x0, p.y0 AS y0 FROM (SELECT slide_id, patch_size, unnest(patches) AS p FROM sl) WHERE p.has_mask), mk AS (SELECT DISTINCT slide_id, x0 // 64 + dx.i AS mx, y0 // 64 + dy.i AS my FROM fp, (SELECT unnest(range(16)) AS i) dx, (SELECT unnest(range(16)) AS i) dy WHERE x0 // 64 + dx.i < greatest(x0 // 64 + 1, (x0 + patch_size) // 64) AND y0 // 64 + dy.i < greatest(y0 // 64 + 1, (y0 + patch_size) // 64)), gr AS (SELECT slide_id, (gx.i * stride)::INT AS x0, (gy.i * stride)::INT AS y0, patch_size, tissue_min, img_w // 64 AS w, img_h // 64 AS h FROM sl, (SELECT unnest(range(400)) AS i) gx, (SELECT unnest(range(400)) AS i) gy WHERE gx.i * stride + patch_size <= img_w AND gy.i * stride + patch_size <= img_h), cv AS (SELECT slide_id, x0, y0, tissue_min, x0 // 64 + dx.i AS mx, y0 // 64 + dy.i AS my FROM gr, (SELECT unnest(range(16)) AS i) dx, (SELECT unnest(range(16)) AS i) dy WHERE x0 // 64 + dx.i < least(greatest(x0 // 64 + 1, (x0 + patch_size) // 64), w) AND y0 // 64 + dy.i < least(greatest(y0 // 64 + 1, (y0 + patch_size) // 64), h)) SELECT slide_id, x0, y0, round(avg((mk.mx IS NOT NULL)::INT), 6) AS tissue FROM cv LEFT JOIN mk USING (slide_id, mx, my) GROUP BY slide_id, x0, y0 HAVING avg((mk.mx IS NOT NULL)::INT) >= max(tissue_min)",
    "mx_overlap": _SLIDES + ", p AS (SELECT slide_id, patch_size, coalesce(mpp_scale, 1.0) AS sc, floor(img_w*coalesce(mpp_scale, 1.0)*0.8)::BIGINT AS w, floor(img_h*coalesce(mpp_scale, 1.0)*0.8)::BIGINT AS h, unnest(patches) AS p FROM sl), b AS (SELECT slide_id, p.x0 AS x0, p.y0 AS y0, round_even(p.x0*sc, 0)::INT AS mx_x0, round_even(p.y0*sc, 0)::INT AS mx_y0, greatest(round_even(patch_size*sc, 0), 1)::INT AS mx_size, w, h FROM p), o AS (SELECT *, CASE WHEN mx_x0 >= 0 AND mx_y0 >= 0 AND mx_x0 + mx_size <= w AND mx_y0 + mx_size <= h THEN 1.0 ELSE (greatest(0, least(mx_x0 + mx_size, w) - greatest(0, mx_x0))::DOUBLE * greatest(0, least(mx_y0 + mx_size, h) - greatest(0, mx_y0))) / (mx_size::DOUBLE * mx_size + 1e-9) END AS ov FROM b) SELECT slide_id, x0, y0, mx_x0, mx_y0, mx_size, round(ov, 6) AS overlap, ov >= 1.0 AS whole FROM o",
    "extent_check": _SLIDES + ", e AS (SELECT slide_id, he_mpp, mx_mpp, img_w*he_mpp AS a, img_h*he_mpp AS b, floor(img_w*0.47)*mx_mpp AS c, floor(img_h*0.52)*mx_mpp AS d FROM sl WHERE he_mpp IS NOT NULL AND mx_mpp IS NOT NULL), f AS (SELECT slide_id, he_mpp/mx_mpp AS s, abs(a-c)/greatest(a, c)*100 AS dw, abs(b-d)/greatest(b, d)*100 AS dh FROM e) SELECT slide_id, round(s, 6) AS scale, round(dw, 6) AS diff_w, round(dh, 6) AS diff_h, dw <= 5 AND dh <= 5 AS agrees FROM f",
    "coord_convert": _SLIDES + "SELECT row_id, round(x, 6) AS x_he, round(y, 6) AS y_he, round(x*he_mpp, 6) AS x_um, round(x*sc, 6) AS x_mx, round(y*sc, 6) AS y_mx FROM (SELECT row_id, patch_x0 + centroid_x_local AS x, patch_y0 + centroid_y_local AS y, he_mpp, coalesce(he_mpp/mx_mpp, mpp_scale, 1.0) AS sc FROM cell_assignments a JOIN sl ON a.slide_id = sl.slide_id WHERE patch_x0 IS NOT NULL AND NOT isnan(centroid_x_local) AND NOT isnan(centroid_y_local))",
    "dense_tile": _PLACED + ", c AS (SELECT slide_id, img_w, img_h, floor(x/1024)::BIGINT AS ix, floor(y/1024)::BIGINT AS iy, count(*) AS n FROM pl WHERE x >= 0 AND y >= 0 AND x < img_w AND y < img_h GROUP BY ALL) SELECT slide_id, least(ix*1024, greatest(img_w - 1024, 0)) AS x0, least(iy*1024, greatest(img_h - 1024, 0)) AS y0, n AS n_points FROM c QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY n DESC, iy, ix) = 1",
    "bounds_split": _PLACED + "SELECT slide_id, count(*) FILTER (WHERE ins) AS n_inside, count(*) FILTER (WHERE NOT ins) AS n_outside, count(*) FILTER (WHERE ins AND x BETWEEN 1000 AND 2999.999 AND y BETWEEN 1000 AND 2999.999) AS n_zoom FROM (SELECT *, x >= 0 AND x < img_w AND y >= 0 AND y < img_h AS ins FROM pl WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY slide_id",
    "available_patches": _KEYS + "SELECT slide_id, patch_id FROM ix WHERE EXISTS (SELECT 1 FROM fl WHERE fl.slide_id = ix.slide_id AND fl.patch_id = ix.patch_id) AND EXISTS (SELECT 1 FROM nm WHERE nm.slide_id = ix.slide_id AND nm.patch_id = ix.patch_id)",
    "todo_patches": _KEYS + "SELECT slide_id, patch_id, mxp AS has_multiplex FROM ix WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.slide_id = ix.slide_id AND fl.patch_id = ix.patch_id)",
    "missing_counts": _KEYS + "SELECT ix.slide_id, count(*) AS n_patches, count(*) FILTER (WHERE fl.patch_id IS NULL) AS no_file, count(*) FILTER (WHERE nm.patch_id IS NULL) AS no_cells FROM ix LEFT JOIN fl ON ix.slide_id = fl.slide_id AND ix.patch_id = fl.patch_id LEFT JOIN nm ON ix.slide_id = nm.slide_id AND ix.patch_id = nm.patch_id GROUP BY ix.slide_id",
    "patch_key_union": _KEYS + "SELECT slide_id, count(*) AS n_patches FROM (SELECT slide_id, patch_id FROM ix UNION SELECT slide_id, patch_id FROM fl UNION SELECT slide_id, patch_id FROM nm WHERE patch_id IS NOT NULL) GROUP BY slide_id",
    "affine_boxes": "WITH " + CELLS_SQL + ", b AS (SELECT cell_id, x AS x0, y AS y0, x + 15 + cell_id % 32 AS x1, y + 15 + cell_id % 32 AS y1 FROM cells), c AS (SELECT cell_id, x0, y0, unnest([x0, x1, x0, x1]) AS x, unnest([y0, y0, y1, y1]) AS y FROM b), m AS (SELECT cell_id, x0, y0, 0.5::DOUBLE*x + 0.01::DOUBLE*y + 3.25::DOUBLE AS u, -0.02::DOUBLE*x + 0.48::DOUBLE*y + 40.0::DOUBLE AS v FROM c), r AS (SELECT cell_id, x0, y0, floor(min(u))::BIGINT AS bx, floor(min(v))::BIGINT AS b_y, ceil(max(u))::BIGINT + 1 AS hx, ceil(max(v))::BIGINT + 1 AS hy FROM m GROUP BY ALL) SELECT cell_id, x0, y0, bx, b_y AS \"by\", hx - bx AS bw, hy - b_y AS bh FROM r WHERE bx >= 0 AND b_y >= 0 AND hx <= 512 AND hy <= 512",
    "best_crop": _PATCH_SQL + ", o AS (SELECT slide_id, x0 - dx.i * stride AS x0, y0 - dy.i * stride AS y0, m::INT AS a, (m AND mxp)::INT AS b, f AS c FROM b, (VALUES (0), (1)) dx(i), (VALUES (0), (1)) dy(i)), v AS (SELECT slide_id, x0, y0, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM o GROUP BY ALL), "
    "an AS (SELECT DISTINCT slide_id, x0, y0 FROM b WHERE mx_x0 >= 0 AND mx_y0 >= 0 AND mx_x0 + greatest(round_even((stride + patch_size)*sc, 0), 1) <= w AND mx_y0 + greatest(round_even((stride + patch_size)*sc, 0), 1) <= h) SELECT slide_id, x0, y0, round(a + b + c, 6) AS score FROM an JOIN v USING (slide_id, x0, y0) WHERE a >= 0.6 AND b >= 0.5 AND c >= 0.6 QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY round(a + b + c, 9) DESC, y0, x0) = 1",
    "overlapping_patches": _PATCH_SQL + ", o AS (SELECT *, CASE WHEN mx_x0 >= 0 AND mx_y0 >= 0 AND mx_x0 + mx_size <= w AND mx_y0 + mx_size <= h THEN 1.0 ELSE (greatest(0, least(mx_x0 + mx_size, w) - greatest(0, mx_x0))::DOUBLE * greatest(0, least(mx_y0 + mx_size, h) - greatest(0, mx_y0))) / (mx_size::DOUBLE * mx_size + 1e-9) END AS ov FROM b) SELECT slide_id, x0, y0, round(ov, 6) AS overlap FROM o WHERE ov >= 0.25",
    "multiplex_patches": _KEYS + "SELECT slide_id, patch_id FROM ix WHERE mxp AND NOT EXISTS (SELECT 1 FROM fl WHERE fl.slide_id = ix.slide_id AND fl.patch_id = ix.patch_id)",
    "channel_find": _SLIDES + ", c AS (SELECT slide_id, unnest(range(len(channels)))::INT AS i, unnest(channels) AS name FROM sl), w AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in WANTED) + "]) AS wanted), n AS (SELECT slide_id, i, name, wanted, lower(regexp_replace(trim(name), '[^\\p{L}\\p{N}]', '', 'g')) AS nf, lower(regexp_replace(wanted, '[^\\p{L}\\p{N}]', '', 'g')) AS wf FROM c, w), "
    "m AS (SELECT n.*, coalesce(a.canonical, trim(name)) AS nc, coalesce(b.canonical, wanted) AS wc FROM n LEFT JOIN " + _CANON.replace("AS c(", "AS a(") + " ON a.normal = nf LEFT JOIN " + _CANON.replace("AS c(", "AS b(") + " ON b.normal = wf), r AS (SELECT slide_id, wanted, i, CASE WHEN lower(trim(name)) = lower(wanted) THEN 0 WHEN nc = wc THEN 1 WHEN contains(nf, wf) THEN 2 END AS r FROM m) "
    "SELECT slide_id, wanted, CASE WHEN r IS NOT NULL THEN i END AS channel_index, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'canonical' WHEN 2 THEN 'contains' END AS how FROM r QUALIFY row_number() OVER (PARTITION BY slide_id, wanted ORDER BY r NULLS LAST, i) = 1",
    "valid_best_crop": _SLIDES + ", p AS (SELECT DISTINCT slide_id, p.x0 AS x0, p.y0 AS y0, p.multiplex_overlap_fraction AS f, coalesce(p.has_mask, FALSE)::INT::DOUBLE AS m FROM (SELECT slide_id, unnest(patches) AS p FROM sl)) SELECT slide_id, x0, y0, round(f + m, 6) AS score FROM p WHERE f >= 0.6 AND m >= 0.5 QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY f + m DESC, y0, x0) = 1",
    "crop_parse": "WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k % 11 WHEN 2 THEN k % 11 END AS x, CASE k % 5 WHEN 0 THEN k % 7 WHEN 1 THEN k % 13 WHEN 2 THEN k % 13 END AS y, CASE k % 5 WHEN 0 THEN 512 WHEN 1 THEN k % 17 WHEN 2 THEN k % 17 END AS w, CASE k % 5 WHEN 0 THEN 512 WHEN 1 THEN k % 17 WHEN 2 THEN k % 19 END AS h FROM k",
    "polygon_moments": _POLY + "SELECT cell_id, round(abs(t)/2, 6) AS area, round(sx/(3*t), 6) AS cx, round(sy/(3*t), 6) AS cy, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y FROM m WHERE abs(t)/2 BETWEEN 30 AND 6000",
    "json_cells": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k FROM events",
    "safe_numbers": "SELECT row_id, coalesce(TRY_CAST(cell_type_confidence AS DOUBLE), 0.0) AS conf, coalesce(CASE WHEN isnan(ki67) THEN NULL ELSE ki67 END, 0.0) AS ki67, CASE lower(trim(cell_type_confidence)) WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS score FROM cell_assignments",
    "cell_ordinals": "SELECT row_id, row_number() OVER (ORDER BY patch_id, row_id) AS cell_number FROM cell_assignments WHERE patch_id IS NOT NULL",
    "stem_parse": "WITH n AS (SELECT file_id, regexp_extract(file_path, '([^/]+)$', 1) AS b FROM stage_files), m AS (SELECT file_id, CASE file_id % 4 WHEN 0 THEN b || '.OME.tif' WHEN 1 THEN 'a.b.tiff' WHEN 2 THEN regexp_replace(b, '\\.json$', '') ELSE b END AS name FROM n), x AS (SELECT file_id, name, regexp_extract(name, '(?i)(\\.ome\\.tiff|\\.ome\\.tif|\\.tiff|\\.tif|\\.[^.]*)$', 1) AS s FROM m) SELECT file_id, name[:length(name) - length(s)] AS stem, CASE WHEN s = '' THEN '.tif' ELSE s END AS suffix FROM x",
    "sample_patches": _KEYS + "SELECT slide_id, patch_id, row_number() OVER (PARTITION BY slide_id ORDER BY ((split_part(patch_id, '_', 1)::BIGINT*31 + split_part(patch_id, '_', 2)::BIGINT*17 + 7) * 7919) % 1000003, patch_id)::INT AS n FROM (SELECT DISTINCT slide_id, patch_id FROM ix) QUALIFY n <= 12",
}
