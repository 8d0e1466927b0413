"""Queries of outlines on rasters and of the supply layers of whole tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markers
from tessera.operators import fields, grids, nested, outlines
from tessera.operators.dedup import keep_first, ordinals
from tessera.plans.fixtures import CELLS_SQL, SIDE, STAGE_SQL, cells, covered_sql
from tessera.plans.rastering import _PX, CHANNELS, K, channels, r6
from tessera.sources.tables import materialize, scratch, table

BIN = 10.0


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return fields.layers(channels(spark, d), K, fields.LayerOptions(cd31="cd31", sma="sma", ki67="ki67", pcna="pcna", mpp=2.6, close_size=3, min_area=4))


def supply_layers(spark: SparkSession, d: str) -> DataFrame:
    """Of every tile, the state of its vessel mask, its vessels and its mean supply."""
    return _layers(spark, d).groupBy("tile", "status").agg(F.count_if("vessel").alias("n_vessel"), *[r6(F.avg(c)).alias(c) for c in ("oxygen", "glucose")])


def layer_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean Ki67 by distance from vessels over all tiles."""
    p = fields.profile(_layers(spark, d).where("dist_um < double('infinity')"), F.col("dist_um"), F.col("proliferation"), BIN, fields.OXYGEN_UM)
    return p.select("bin", "distance_um", "pixel_count", r6(F.col("mean")).alias("mean"))


def cell_outlines(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, slide_id, patch_id, cell_pos, type_cellvit, points) of the cells in stage_files; points are null for a cell without an outline."""
    files = table(spark, d, "stage_files").where("kind = 'cellvit'")
    path = scratch(spark, "flat")
    nested.write_flat(nested.emit(files), path)
    tagged = nested.read_tagged(spark, path)
    kinds = nested.flat_table(tagged, "cell").select("file_id", "cell_pos", F.col("type_cellvit").cast("int").alias("type_cellvit"))
    named = files.select("file_id", "slide_id", F.regexp_extract("file_path", r"([0-9]+_[0-9]+)\.json$", 1).alias("patch_id"))
    return kinds.join(nested.outlines(tagged).select("file_id", "cell_pos", "points"), ["file_id", "cell_pos"], "left").join(named, "file_id")


def cell_masks(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that the outlines of each class cover on each file's patch."""
    return outlines.masks(cell_outlines(spark, d), ["file_id"], "type_cellvit", "points", 256)


def label_areas(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each class on each file's patch when later cells are drawn over earlier ones."""
    drawn = outlines.last_drawn(cell_outlines(spark, d), ["file_id"], ["cell_pos"], "type_cellvit", "points", 256)
    return drawn.groupBy("file_id", "type_cellvit").agg(F.count("*").alias("n_on"))


def _on_tiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Outlines on the stand-in tiles, a quarter of the size, and the tiles' pixels: file after file takes tile after tile, whichever numbers these have."""
    px = channels(spark, d)
    tiles = materialize(ordinals(px.select("tile").distinct(), [F.asc("tile")], "place"), "tiles")
    n = max(1, tiles.count())
    quarter = F.transform("points", lambda p: F.struct((p["x"] / 4).alias("x"), (p["y"] / 4).alias("y")))
    placed = cell_outlines(spark, d).withColumns({"place": F.pmod("file_id", F.lit(n)) + 1, "points": quarter})
    return placed.join(tiles, "place").select("tile", "file_id", "cell_pos", "points"), px


def contour_means(spark: SparkSession, d: str) -> DataFrame:
    """Area and channel means under each cell outline, on the stand-in tile of its file."""
    at, px = _on_tiles(spark, d)
    m = outlines.means_under(at, px, K, ["file_id", "cell_pos"], "points", SIDE, {c: [c] for c in CHANNELS})
    return m.select("file_id", "cell_pos", "area", *[r6(F.col(c)).alias(c) for c in CHANNELS])


def contour_markers(spark: SparkSession, d: str) -> DataFrame:
    """Means of canonical markers under each outline, of all raw channels that mean the marker; the tiles' channels stand for four raw names of which two mean one."""
    raw = {"SMA": "cd31", "Aortic smooth muscle actin": "sma", "Ki67": "ki67", "PCNA": "pcna"}
    values = {m: [raw[name] for name in own] for m, own in markers.by_marker(list(raw)).items()}
    at, px = _on_tiles(spark, d)
    m = outlines.means_under(at, px, K, ["file_id", "cell_pos"], "points", SIDE, values)
    return m.select("file_id", "cell_pos", "area", *[r6(F.col(c)).alias(c) for c in values])


def contour_skips(spark: SparkSession, d: str) -> DataFrame:
    """Cells in all and those skipped for want of a tile or of a pixel."""
    at, px = _on_tiles(spark, d)
    return outlines.skipped(at, px, K, "points", SIDE)


def crop_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Size and bounds in their crop of the outlines of every assigned cell's place in its patch: cells are numbered within a patch, the crop begins 32 pixels up and left of the centroid."""
    own = keep_first(cell_outlines(spark, d).where("patch_id <> ''"), ["slide_id", "patch_id", "cell_pos"], [F.asc("file_id")], ["file_id"])
    a = table(spark, d, "cell_assignments").where("slide_id is not null and patch_id is not null and not isnan(centroid_x_local) and not isnan(centroid_y_local)")
    a = a.select("row_id", "slide_id", F.trim("patch_id").alias("patch_id"), (F.col("row_id") % 12).cast("int").alias("cell_pos"), (F.col("centroid_x_local") - 32).alias("x0_crop"), (F.col("centroid_y_local") - 32).alias("y0_crop"))
    found = outlines.in_crop(a, own, ["slide_id", "patch_id"], "cell_pos", "points").where("points is not null")
    ends = {"x_low": F.array_min("points.x"), "x_high": F.array_max("points.x"), "y_low": F.array_min("points.y"), "y_high": F.array_max("points.y")}
    return found.select("row_id", F.size("points").alias("n_points"), *[r6(v).alias(k) for k, v in ends.items()])


def contour_moments(spark: SparkSession, d: str) -> DataFrame:
    """Area, centroid and bounds of the outlines in the cell files, kept where the area is a nucleus's."""
    m = cell_outlines(spark, d).where("points is not null").select("file_id", "cell_pos", *[v.alias(k) for k, v in grids.polygon_measures(F.col("points")).items()])
    return m.where("area between 30 and 6000").select("file_id", "cell_pos", *[r6(F.col(k)).alias(k) for k in ("area", "cx", "cy", "min_x", "min_y", "max_x", "max_y")])


def polygon_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that a pentagon around each cell covers on a tile of 1,024 pixels, and their sums of places."""
    c = cells(spark, d)
    r = (F.col("cell_id") % 12 + 3).cast("double")
    corners = ((0, -1), (1, -0.25), (0.5, 1), (-0.5, 1), (-1, -0.25))
    points = F.array(*[F.struct((F.col("x") + r * a).alias("x"), (F.col("y") + r * b).alias("y")) for a, b in corners])
    p = outlines.with_pixels(c.select("cell_id", points.alias("points")), "points", 1024, 1024)
    total = lambda k: F.aggregate("pixels", F.lit(0).cast("bigint"), lambda acc, q: acc + q[k])
    return p.select("cell_id", F.size("pixels").alias("n_pixels"), total("x").alias("sum_x"), total("y").alias("sum_y"))


_POLYGON_SQL = (
    "WITH " + CELLS_SQL + ", p AS (SELECT cell_id, x::DOUBLE AS x, y::DOUBLE AS y, (cell_id % 12 + 3)::DOUBLE AS r FROM cells), "
    "c AS (SELECT cell_id AS id, unnest(range(5)) AS i, 5 AS n, trunc(unnest([x, x + r, x + 0.5*r, x - 0.5*r, x - r]))::INT AS px, trunc(unnest([y - r, y - 0.25*r, y + r, y + r, y - 0.25*r]))::INT AS py FROM p), "
    + covered_sql(1024) + "SELECT cells.cell_id, count(al.x)::INT AS n_pixels, coalesce(sum(al.x), 0)::BIGINT AS sum_x, coalesce(sum(al.y), 0)::BIGINT AS sum_y FROM cells LEFT JOIN al ON al.id = cells.cell_id GROUP BY cells.cell_id"
)
_CELLS = STAGE_SQL + ", o AS (SELECT *, file_id * 1000000 + cell_pos AS id, kind_id::INT AS kind FROM jq)"


def _on_side(side: int, scale: int) -> str:
    corners = f"c AS (SELECT id, i, n, trunc(p.x / {scale})::INT AS px, trunc(p.y / {scale})::INT AS py FROM (SELECT id, len(points) AS n, unnest(range(len(points))) AS i, unnest(points) AS p FROM o WHERE len(points) >= 3)), "
    return "WITH " + _CELLS + ", " + corners + covered_sql(side)


def _means_sql(values: str) -> str:
    tiles = ", tl AS (SELECT tile, row_number() OVER (ORDER BY tile) AS place FROM (SELECT DISTINCT tile FROM px)), nt AS (SELECT count(*) AS n FROM tl), "
    sums = ", ".join(f"sum({c}) / count(*) AS {c}" for c in CHANNELS)
    return (
        _PX + tiles + (_on_side(SIDE, 4)).removeprefix("WITH ") + f", mn AS (SELECT o.file_id, o.cell_pos, count(*) AS area, {sums} FROM o JOIN al ON al.id = o.id JOIN nt ON TRUE JOIN tl ON tl.place = o.file_id % nt.n + 1 JOIN px ON px.tile = tl.tile AND px.x = al.x AND px.y = al.y GROUP BY ALL) SELECT file_id, cell_pos, area, {values} FROM mn"
    )


_SHOELACE_SQL = (
    "WITH " + _CELLS + ", c AS (SELECT id, i, n, p.x AS px, p.y AS py FROM (SELECT id, len(points) AS n, unnest(range(len(points))) AS i, unnest(points) AS p FROM o)), e AS (SELECT a.id, a.px, a.py, b.px AS qx, b.py AS qy FROM c a JOIN c b ON a.id = b.id AND b.i = (a.i + 1) % a.n), "
    "m AS (SELECT id, sum(px*qy - qx*py) AS t, sum((px+qx)*(px*qy - qx*py)) AS sx, sum((py+qy)*(px*qy - qx*py)) AS sy, min(px) AS min_x, min(py) AS min_y, max(px) AS max_x, max(py) AS max_y FROM e GROUP BY id) "
    "SELECT file_id, cell_pos, round(abs(t)/2, 6) AS area, round(sx/(3*t), 6) AS cx, round(sy/(3*t), 6) AS cy, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y FROM m JOIN o USING (id) WHERE abs(t)/2 BETWEEN 30 AND 6000"
)

QUERIES = {f.__name__: f for f in (supply_layers, cell_masks, label_areas, contour_means, contour_markers, contour_skips, contour_moments, crop_outlines, polygon_pixels)} | {"tile_profile": layer_profile}
ORACLE: dict[str, str] = {
    "polygon_pixels": _POLYGON_SQL,
    "cell_masks": _on_side(256, 1) + "SELECT o.file_id, kind AS type_cellvit, count(DISTINCT o.id)::INT AS n_cells, count(DISTINCT al.y * 256 + al.x)::INT AS n_on FROM o LEFT JOIN al ON al.id = o.id WHERE len(points) >= 3 GROUP BY ALL",
    "label_areas": _on_side(256, 1) + ", top AS (SELECT file_id, kind FROM o JOIN al ON al.id = o.id QUALIFY row_number() OVER (PARTITION BY file_id, x, y ORDER BY cell_pos DESC) = 1) SELECT file_id, kind AS type_cellvit, count(*) AS n_on FROM top GROUP BY ALL",
    "contour_means": _means_sql(", ".join(f"round({c}, 6) AS {c}" for c in CHANNELS)),
    "contour_markers": _means_sql('round((cd31 + sma) / 2, 6) AS "aSMA", round(ki67, 6) AS "Ki67", round(pcna, 6) AS "PCNA"'),
    "contour_skips": _on_side(SIDE, 4) + "SELECT count(*) AS n_cells, 0::BIGINT AS n_no_tile, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.id = o.id)) AS n_no_pixel FROM o",
    "contour_moments": _SHOELACE_SQL,
    "crop_outlines": "WITH " + _CELLS + r", f AS (SELECT slide_id, regexp_extract(file_path, '([0-9]+_[0-9]+)\.json$', 1) AS patch_id, cell_pos, points FROM o QUALIFY row_number() OVER (PARTITION BY slide_id, patch_id, cell_pos ORDER BY file_id) = 1), "
    + "a AS (SELECT row_id, slide_id, trim(patch_id) AS patch_id, row_id % 12 AS cell_pos, centroid_x_local - 32 AS xc, centroid_y_local - 32 AS yc FROM cell_assignments WHERE NOT isnan(centroid_x_local) AND NOT isnan(centroid_y_local)) "
    "SELECT row_id, len(points)::INT AS n_points, round(list_min(list_transform(points, lambda p: p.x)) - xc, 6) AS x_low, round(list_max(list_transform(points, lambda p: p.x)) - xc, 6) AS x_high, round(list_min(list_transform(points, lambda p: p.y)) - yc, 6) AS y_low, round(list_max(list_transform(points, lambda p: p.y)) - yc, 6) AS y_high FROM a JOIN f USING (slide_id, patch_id, cell_pos) WHERE patch_id <> '' AND points IS NOT NULL",
}
