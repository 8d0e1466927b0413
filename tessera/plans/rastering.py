"""Queries of rasters, masks and supply fields, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fields, matching, rasters
from tessera.plans.fixtures import CELLS_SQL, SIDE, cells
from tessera.sources.tables import table

K = ["tile"]
MPP, STEP = 0.325, 8
CHANNELS = ("cd31", "sma", "ki67", "pcna")


def r6(c):
    return F.round(c, 6)


def channels(spark: SparkSession, d: str) -> DataFrame:
    """(tile, x, y, cd31, sma, ki67, pcna) of every pixel of every tile."""
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    x, y = (k * 37 + n * 11) % SIDE, (p * 29 + s * 5) % SIDE
    base = table(spark, d, "lineitem").select(F.floor(k / 1000).alias("tile"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.col("l_quantity").cast("bigint").alias("cd31"), ((p * 7 + s) % 50).alias("sma"), ((k * 3 + p) % 50).alias("ki67"), ((s * 11 + n) % 50).alias("pcna"))
    px = base.groupBy("tile", "x", "y").agg(*[F.sum(c).cast("bigint").alias(c) for c in CHANNELS])
    return rasters.full_grid(px, K, SIDE, CHANNELS)


def _masked(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Channels with a boolean ``{name}_on`` by Otsu's threshold for each of ``names``."""
    out = channels(spark, d)
    for name in names:
        limit = rasters.otsu(out, K, name).withColumnRenamed("threshold", f"{name}_t")
        out = out.join(limit, K).withColumn(f"{name}_on", F.col(name) > F.col(f"{name}_t"))
    return out


def padded_window(spark: SparkSession, d: str) -> DataFrame:
    """A 32 x 32 window that hangs over the raster's corner, zero-padded."""
    w = rasters.window_read(channels(spark, d), K, -8, -8, 32, 32, "cd31")
    return w.select("tile", "wx", "wy", "cd31")


def overview(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth pixel."""
    return rasters.overview(channels(spark, d), 5, SIDE, SIDE).select("tile", "x", "y", "cd31")


def pyramid_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels and sums of each halving level."""
    return rasters.pyramid(channels(spark, d).select("tile", "x", "y", "cd31"), SIDE, 16).groupBy("tile", "level").agg(F.count("*").alias("n"), F.sum("cd31").alias("total"))


def level_choice(spark: SparkSession, d: str) -> DataFrame:
    """The level that each policy picks for a downsampling of 6."""
    levels = channels(spark, d).select("tile").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("factor", F.pow(F.lit(2.0), "level") + (F.col("tile") % 3) * 0.3)
    picks = [rasters.pick_level(levels, K, 6, p).withColumn("policy", F.lit(p)) for p in ("last", "largest", "nearest")]
    return picks[0].unionByName(picks[1]).unionByName(picks[2]).select("tile", "policy", "level", "stride")


def percentile_norm(spark: SparkSession, d: str) -> DataFrame:
    """A channel scaled between its 1st and 99th percentile, with the truncated byte form."""
    n = rasters.percentile_norm(channels(spark, d), K, "ki67")
    return n.select("tile", "x", "y", r6(F.col("norm")).alias("norm"), (F.round(F.col("norm") * 255, 6)).cast("int").alias("u8"))


def minmax_u8(spark: SparkSession, d: str) -> DataFrame:
    """A channel stretched to bytes."""
    return rasters.stretch_u8(channels(spark, d), K, "sma").select("tile", "x", "y", "u8")


def max_projection(spark: SparkSession, d: str) -> DataFrame:
    """The greatest channel value of each pixel."""
    return channels(spark, d).select("tile", "x", "y", F.greatest(*CHANNELS).alias("v"))


def alpha_blend(spark: SparkSession, d: str) -> DataFrame:
    """Two channels composited."""
    return channels(spark, d).select("tile", "x", "y", rasters.blend(F.col("cd31"), F.col("sma"), 0.25).alias("v"))


ANCHORS = [(0.0, 0, 0, 0), (0.25, 128, 0, 0), (0.5, 255, 64, 0), (1.0, 255, 255, 224)]


def lut_colour(spark: SparkSession, d: str) -> DataFrame:
    """A channel through a piecewise linear colour map."""
    c = rasters.ramp(F.least(F.col("cd31") / 256.0, F.lit(1.0)), ANCHORS)
    return channels(spark, d).select("tile", "x", "y", *[v.alias(k) for k, v in c.items()])


def otsu_mask(spark: SparkSession, d: str) -> DataFrame:
    """Otsu's threshold and the pixels above it, per tile."""
    return _masked(spark, d, "cd31").groupBy("tile").agg(F.max("cd31_t").alias("threshold"), F.count_if("cd31_on").alias("n_on"))


def mask_logic(spark: SparkSession, d: str) -> DataFrame:
    """And, or and not of two masks."""
    m = _masked(spark, d, "cd31", "sma")
    return m.groupBy("tile").agg(F.count_if(F.col("cd31_on") & F.col("sma_on")).alias("n_and"), F.count_if(F.col("cd31_on") | F.col("sma_on")).alias("n_or"), F.count_if(~F.col("cd31_on")).alias("n_not"))


def mask_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the strict mask and which mask to use."""
    m = _masked(spark, d, "cd31").withColumn("strict", F.col("cd31") > 120 + (F.col("tile") % 4) * 60)
    s = rasters.mask_status(m, F.col("strict"), F.col("cd31_on"), K, 0.3)
    return s.select("tile", r6(F.col("coverage")).alias("coverage"), "status")


def dilate_rect(spark: SparkSession, d: str) -> DataFrame:
    """The smooth-muscle mask grown by 2 pixels to each side."""
    return rasters.dilate_rect(_masked(spark, d, "sma").where("sma_on"), K, SIDE, 2)


def dilate_vessels(spark: SparkSession, d: str) -> DataFrame:
    """The vessel mask grown by 1 pixel to each side."""
    return rasters.dilate_rect(_masked(spark, d, "cd31").where("cd31_on"), K, SIDE, 1)


def _refined(spark: SparkSession, d: str, first: str, other: str) -> DataFrame:
    at = [*K, "x", "y"]
    m = _masked(spark, d, first, other).select(*at, F.col(f"{first}_on").alias("a"), F.col(f"{other}_on").alias("b"))
    near = rasters.dilate(m, K, "a", rasters.ellipse(5)).withColumnRenamed("a", "near")
    return m.join(near, at).where("a or (b and near)").select(*at)


def sma_refine(spark: SparkSession, d: str) -> DataFrame:
    """Smooth muscle plus vessels within 2 pixels of it."""
    return _refined(spark, d, "sma", "cd31")


def sma_vessels(spark: SparkSession, d: str) -> DataFrame:
    """Vessels plus smooth muscle within 2 pixels of them."""
    return _refined(spark, d, "cd31", "sma")


def components(spark: SparkSession, d: str) -> DataFrame:
    """Size of each 8-connected component of a sparse mask."""
    m = _masked(spark, d, "cd31").where("cd31 > 2 * cd31_t")
    return rasters.components(m, K).groupBy("tile", "label").agg(F.count("*").alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"))


def cleaned_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that stay after opening, closing and removal of small components."""
    out = rasters.clean(_masked(spark, d, "cd31").select("tile", "x", "y", F.col("cd31_on").alias("on")), K, "on", 3, 3, 12)
    return out.groupBy("tile").agg(F.count_if("on").alias("n_kept"))


def box_filter(spark: SparkSession, d: str) -> DataFrame:
    """The brightest 16 x 16 box of each tile, first in scan order."""
    b = rasters.box_means(channels(spark, d), K, 16, "cd31").where(f"x <= {SIDE - 16} and y <= {SIDE - 16}")
    best = b.groupBy("tile").agg(F.min(F.struct((-F.col("box_mean")).alias("m"), "y", "x")).alias("b"))
    return best.select("tile", F.col("b.x").alias("x"), F.col("b.y").alias("y"), r6(-F.col("b.m")).alias("box_mean"))


def _distances(spark: SparkSession, d: str) -> DataFrame:
    m = _masked(spark, d, "cd31").withColumn("on", (F.col("cd31") > F.col("cd31_t") + 60).cast("int"))
    return fields.distance(m.select("tile", "x", "y", "on"), K)


def edt_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest vessel pixel as a share of the oxygen limit, and the supply map."""
    share = fields.clamped(F.col("dist"), MPP * STEP * 8, fields.OXYGEN_UM)
    return _distances(spark, d).select("tile", "x", "y", r6(share).alias("share"), r6(1 - share).alias("oxygen"))


def _field(spark: SparkSession, d: str) -> DataFrame:
    ki67 = rasters.percentile_norm(channels(spark, d), K, "ki67").select("tile", "x", "y", F.col("norm").alias("ki67n"))
    pcna = rasters.percentile_norm(channels(spark, d), K, "pcna").select("tile", "x", "y", F.col("norm").alias("pcnan"))
    at = [*K, "x", "y"]
    f = _distances(spark, d).join(ki67, at).join(pcna, at).withColumn("k", fields.uptake(F.greatest("ki67n", "pcnan"), F.col("pcnan")))
    return f.withColumn("u", fields.decay(F.col("dist") == 0, F.col("dist"), F.col("k"), MPP * STEP, fields.OXYGEN_UM))


def consumption(spark: SparkSession, d: str) -> DataFrame:
    """Uptake of each pixel."""
    return _field(spark, d).select("tile", "x", "y", r6(F.col("k")).alias("k"))


def wkb_field(spark: SparkSession, d: str) -> DataFrame:
    """The supply field with locally adjusted decay length."""
    return _field(spark, d).select("tile", "x", "y", r6(F.col("u")).alias("u"))


def jacobi_steps(spark: SparkSession, d: str) -> DataFrame:
    """Three steps of the diffusion equation from vessels."""
    f = _field(spark, d).withColumn("source", (F.col("dist") == 0).cast("double"))
    return fields.diffused(f, K, "source", "k", 3).select("tile", "x", "y", r6(F.col("u")).alias("u"))


def steady_supply(spark: SparkSession, d: str) -> DataFrame:
    """The diffusion equation from vessels, run to its tolerance on every tile; ``jacobi_steps`` is its first steps for the check by SQL."""
    f = _field(spark, d).withColumn("source", (F.col("dist") == 0).cast("double"))
    return fields.steady(f, K, "source", "k").select("tile", "x", "y", r6(F.col("u")).alias("u"))


def tissue_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Tissue share of each tile taken as a colour overview."""
    out = rasters.tissue(channels(spark, d), K, ("cd31", "sma", "ki67"))
    return out.groupBy("tile").agg(r6(F.avg(F.col("tissue").cast("int"))).alias("tissue"))


def vessel_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with any vessel pixel, and how many."""
    return _masked(spark, d, "cd31").groupBy("tile").agg(F.count_if(F.col("cd31") > F.col("cd31_t") + 150).alias("n_on")).where("n_on > 0")


BIN, LIMIT = 2.6, 40.0


def _profile(spark: SparkSession, d: str) -> DataFrame:
    ki67 = rasters.percentile_norm(channels(spark, d), K, "ki67").select("tile", "x", "y", F.col("norm").alias("ki67n"))
    return fields.profile(_distances(spark, d).join(ki67, [*K, "x", "y"]), F.col("dist") * MPP * STEP, F.col("ki67n"), BIN, LIMIT)


def dist_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean proliferation by distance from vessels."""
    return _profile(spark, d).select("bin", r6(F.col("distance_um")).alias("distance_um"), "pixel_count", r6(F.col("mean")).alias("mean"))


RATES = [1.0, 5.0, 20.0, 80.0]


def _fits(spark: SparkSession, d: str) -> DataFrame:
    curves = fields.decay_curves(spark, RATES, 0.1, 5.0, LIMIT)
    at = fields.interpolate(_profile(spark, d).where("pixel_count > 50"), curves, "distance_um")
    return fields.correlation(at, ["d"], "u_at", "mean")


def profile_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the measured profile with each model curve."""
    return _fits(spark, d).select("d", r6(F.col("r")).alias("r"))


def best_d(spark: SparkSession, d: str) -> DataFrame:
    """The diffusivity that correlates best; ties to the smaller."""
    return _fits(spark, d).orderBy(F.desc("r"), "d").limit(1).select("d", r6(F.col("r")).alias("r"))


def _spots(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("cell_id", "type_cellvit", F.floor(F.col("cell_id") / 1000).alias("tile"), (F.col("x") % 72).alias("x"), (F.col("y") % 72).alias("y"))


def point_in_raster(spark: SparkSession, d: str) -> DataFrame:
    """Cells on and off the vessel mask per tile, with the share that hits."""
    on = _masked(spark, d, "cd31").select("tile", "x", "y", F.col("cd31_on").cast("int").alias("v"))
    hits = matching.point_in_raster(_spots(spark, d), on, K)
    return hits.groupBy("tile").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hit"), r6(F.count_if("hit") / F.count("*") * 100).alias("hit_pct"), F.countDistinct("type_cellvit").alias("n_types"))


def rect_zonal_mean(spark: SparkSession, d: str) -> DataFrame:
    """Area and mean channel values under a rectangle around each cell; parts beyond the raster are cut off."""
    s = _spots(spark, d).select("tile", "cell_id", F.col("x").cast("int").alias("x0"), F.col("y").cast("int").alias("y0"))
    end = lambda c, k: F.least(F.col(c) + 2 + (F.col("cell_id") % k).cast("int"), F.lit(SIDE))
    boxes = s.withColumns({"x1": end("x0", 3), "y1": end("y0", 4)})
    z = rasters.zonal_mean(boxes, channels(spark, d), K, "cell_id", ["cd31", "ki67"])
    return z.select("tile", "cell_id", "area", r6(F.col("mean_cd31")).alias("mean_cd31"), r6(F.col("mean_ki67")).alias("mean_ki67"))


_PX = """WITH base AS (SELECT l_orderkey // 1000 AS tile, ((l_orderkey*37+l_linenumber*11)%64)::INT AS x, ((l_partkey*29+l_suppkey*5)%64)::INT AS y, l_quantity::BIGINT AS cd31, (l_partkey*7+l_suppkey)%50 AS sma, (l_orderkey*3+l_partkey)%50 AS ki67, (l_suppkey*11+l_linenumber)%50 AS pcna FROM lineitem),
s AS (SELECT tile, x, y, sum(cd31)::BIGINT AS cd31, sum(sma)::BIGINT AS sma, sum(ki67)::BIGINT AS ki67, sum(pcna)::BIGINT AS pcna FROM base GROUP BY ALL),
g AS (SELECT tile, gx.x::INT AS x, gy.y::INT AS y FROM (SELECT DISTINCT tile FROM s), (SELECT unnest(range(64)) AS x) gx, (SELECT unnest(range(64)) AS y) gy),
px AS (SELECT g.tile, g.x, g.y, coalesce(cd31, 0)::BIGINT AS cd31, coalesce(sma, 0)::BIGINT AS sma, coalesce(ki67, 0)::BIGINT AS ki67, coalesce(pcna, 0)::BIGINT AS pcna FROM g LEFT JOIN s USING (tile, x, y))
"""


def _otsu_sql(c: str) -> str:
    return (
        f", {c}_l AS (SELECT tile, {c} AS v, count(*)::DOUBLE AS n FROM px GROUP BY ALL), {c}_c AS (SELECT tile, v, sum(n) OVER w AS w0, sum(n*v) OVER w AS s0, sum(n) OVER (PARTITION BY tile) AS wa, sum(n*v) OVER (PARTITION BY tile) AS sa FROM {c}_l WINDOW w AS (PARTITION BY tile ORDER BY v)), "
        f"{c}_s AS (SELECT tile, v, CASE WHEN w0 < wa THEN w0*(wa-w0)*(s0/w0 - (sa-s0)/(wa-w0))*(s0/w0 - (sa-s0)/(wa-w0)) ELSE -1.0 END AS score FROM {c}_c), {c}_o AS (SELECT tile, (CASE WHEN score < 0 THEN 0 ELSE v END)::BIGINT AS {c}_t FROM {c}_s QUALIFY row_number() OVER (PARTITION BY tile ORDER BY score DESC, v) = 1) "
    )


_CD = _PX + _otsu_sql("cd31") + ", m AS (SELECT px.*, cd31_t, cd31 > cd31_t AS cd31_on FROM px JOIN cd31_o USING (tile)) "
_CS = _PX + _otsu_sql("cd31") + _otsu_sql("sma") + ", m AS (SELECT px.*, cd31 > cd31_t AS cd31_on, sma > sma_t AS sma_on FROM px JOIN cd31_o USING (tile) JOIN sma_o USING (tile)) "


def _norm_sql(c: str) -> str:
    return f", {c}_e AS (SELECT tile, quantile_cont({c}, 0.01) AS a, quantile_cont({c}, 0.99) AS b FROM px GROUP BY tile), {c}_n AS (SELECT tile, x, y, {c} AS v, CASE WHEN b > a THEN (least(greatest({c}, a), b) - a) / (b - a) ELSE 0 END AS norm FROM px JOIN {c}_e USING (tile)) "


_DIST = (
    _CD + ", v AS (SELECT tile, x, y FROM m WHERE cd31 > cd31_t + 60), col AS (SELECT g.tile, g.x, g.y, min((g.y - v.y)**2) AS d2 FROM g JOIN v ON g.tile = v.tile AND g.x = v.x GROUP BY ALL), "
    "e AS (SELECT g.tile, g.x, g.y, coalesce(sqrt(min((g.x - col.x)**2 + d2)), 'inf'::DOUBLE) AS dist FROM g LEFT JOIN col ON g.tile = col.tile AND g.y = col.y GROUP BY ALL) "
)
_FIELD = (
    _DIST + _norm_sql("ki67") + _norm_sql("pcna") + ", f AS (SELECT e.*, a.norm AS ki67n, 0.1 + 0.3*greatest(a.norm, b.norm) + 0.1*b.norm AS k FROM e JOIN ki67_n a USING (tile, x, y) JOIN pcna_n b USING (tile, x, y)), "
    f"u AS (SELECT *, CASE WHEN dist = 0 THEN 1.0 ELSE exp(-dist*sqrt(k/0.1)*{MPP * STEP}/160.0) END AS u FROM f) "
)


def _jacobi_sql(steps: int) -> str:
    sql = _FIELD + ", s0 AS (SELECT tile, x, y, k, CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END AS s, 0.0::DOUBLE AS u FROM f)"
    for i in range(steps):
        sql += f", s{i + 1} AS (SELECT tile, x, y, k, s, least(greatest((coalesce(lag(u) OVER r, u) + coalesce(lead(u) OVER r, u) + coalesce(lag(u) OVER c, u) + coalesce(lead(u) OVER c, u) + s) / (4.0 + k), 0.0), 1.0) AS u FROM s{i} WINDOW r AS (PARTITION BY tile, y ORDER BY x), c AS (PARTITION BY tile, x ORDER BY y))"
    return sql + f" SELECT tile, x, y, round(u, 6) AS u FROM s{steps}"


_COMPONENTS_SQL = (
    "WITH RECURSIVE " + _CD.removeprefix("WITH ") + ", onp AS (SELECT tile, x, y, y * 64 + x AS id FROM m WHERE {where}), "
    "nb AS (SELECT a.tile, a.id, b.id AS other FROM onp a JOIN onp b ON a.tile = b.tile AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id), "
    "reach AS (SELECT tile, id AS root, id FROM onp UNION SELECT r.tile, r.root, nb.other FROM reach r JOIN nb ON r.tile = nb.tile AND r.id = nb.id WHERE nb.other > r.root), "
    "low AS (SELECT tile, id, min(root) AS root FROM reach GROUP BY tile, id), lab AS (SELECT onp.tile, onp.x, onp.y, low.root FROM onp JOIN low USING (tile, id)) "
)


def _near_sql(name: str, source: str, how: str, offsets: str, value: str = "v") -> str:
    """A step of morphology: the least or greatest value over neighbours at the offsets, inside the tile."""
    return f", {name} AS (SELECT a.tile, a.x, a.y, {how}(b.{value}) AS {value} FROM {source} a CROSS JOIN {offsets} o(dx, dy) JOIN {source} b ON b.tile = a.tile AND b.x = a.x + o.dx AND b.y = a.y + o.dy GROUP BY ALL)"


_CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))"
_CLEAN_SQL = (
    _CD.replace("WITH base", "WITH RECURSIVE base", 1) + ", m0 AS (SELECT tile, x, y, cd31_on AS v FROM m)" + _near_sql("m1", "m0", "min", _CROSS) + _near_sql("m2", "m1", "max", _CROSS) + _near_sql("m3", "m2", "max", _CROSS) + _near_sql("m4", "m3", "min", _CROSS)
    + ", onp AS (SELECT tile, x, y, y * 64 + x AS id FROM m4 WHERE v), nb AS (SELECT a.tile, a.id, b.id AS other FROM onp a JOIN onp b ON a.tile = b.tile AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id), "
    # a component is small if it is exhausted within 12 steps with fewer than 12 pixels
    "reach AS (SELECT tile, id AS root, id, 0 AS step FROM onp UNION SELECT r.tile, r.root, nb.other, r.step + 1 FROM reach r JOIN nb ON r.tile = nb.tile AND r.id = nb.id WHERE r.step < 11), "
    "big AS (SELECT tile, root FROM reach GROUP BY tile, root HAVING count(DISTINCT id) >= 12) "
    "SELECT t.tile, count(b.root) AS n_kept FROM (SELECT DISTINCT tile FROM px) t LEFT JOIN big b ON b.tile = t.tile GROUP BY t.tile"
)
_TISSUE_SQL = (
    _PX + ", s0 AS (SELECT tile, x, y, greatest(least(cd31, 255), least(sma, 255), least(ki67, 255)) AS hi, least(cd31, sma, ki67, 255) AS lo FROM px), sat AS (SELECT tile, x, y, round_even((hi - lo) * 255 / greatest(hi, 1), 0)::INT AS v FROM s0), "
    "blur AS (SELECT a.tile, a.x, a.y, quantile_disc(b.v, 0.5) AS v FROM sat a CROSS JOIN (SELECT unnest(range(-3, 4)) AS i) dx CROSS JOIN (SELECT unnest(range(-3, 4)) AS i) dy JOIN sat b ON b.tile = a.tile AND b.x = least(greatest(a.x + dx.i, 0), 63) AND b.y = least(greatest(a.y + dy.i, 0), 63) GROUP BY ALL)"
    + ", lv AS (SELECT tile, v, count(*)::DOUBLE AS n FROM blur GROUP BY ALL), cu AS (SELECT tile, v, sum(n) OVER w AS w0, sum(n*v) OVER w AS s0, sum(n) OVER (PARTITION BY tile) AS wa, sum(n*v) OVER (PARTITION BY tile) AS sa FROM lv WINDOW w AS (PARTITION BY tile ORDER BY v)), "
    "sc AS (SELECT tile, v, CASE WHEN w0 < wa THEN w0*(wa-w0)*(s0/w0 - (sa-s0)/(wa-w0))*(s0/w0 - (sa-s0)/(wa-w0)) ELSE -1.0 END AS score FROM cu), th AS (SELECT tile, CASE WHEN score < 0 THEN 0 ELSE v END AS t FROM sc QUALIFY row_number() OVER (PARTITION BY tile ORDER BY score DESC, v) = 1), "
    "m0 AS (SELECT blur.tile, x, y, blur.v > t AS v FROM blur JOIN th USING (tile))" + _near_sql("m1", "m0", "max", "(SELECT i, j FROM (SELECT unnest(range(-1, 3)) AS i), (SELECT unnest(range(-1, 3)) AS j))") + _near_sql("m2", "m1", "min", "(SELECT i, j FROM (SELECT unnest(range(-2, 2)) AS i), (SELECT unnest(range(-2, 2)) AS j))")
    + " SELECT tile, round(avg(v::INT), 6) AS tissue FROM m2 GROUP BY tile"
)

_BINS = 17
_PROFILE = _FIELD + f", b AS (SELECT least(floor(dist*{MPP}*{STEP}/{BIN}), {_BINS - 1})::INT AS bin, sum(ki67n) AS t, count(*) AS n FROM f GROUP BY 1), p AS (SELECT r.i::INT AS bin, (r.i + 0.5)*{BIN} AS distance_um, coalesce(n, 0)::BIGINT AS pixel_count, t / n AS mean FROM (SELECT unnest(range({_BINS})) AS i) r LEFT JOIN b ON b.bin = r.i) "
_FIT = _PROFILE + (
    f", q AS (SELECT d.d, i*5.0 AS px_at, exp(-(i*5.0)/sqrt(d.d/0.1)) AS u FROM (SELECT unnest([1.0, 5.0, 20.0, 80.0])::DOUBLE AS d) d, (SELECT unnest(range({int(LIMIT / 5) + 1})) AS i)), z AS (SELECT *, lead(px_at) OVER w AS too, lead(u) OVER w AS u2 FROM q WINDOW w AS (PARTITION BY d ORDER BY px_at)), "
    "i AS (SELECT d, mean, u + (distance_um - px_at)/(too - px_at)*(u2 - u) AS u_at FROM p JOIN z ON distance_um >= px_at AND distance_um < too WHERE pixel_count > 50 AND mean IS NOT NULL), r AS (SELECT d, CASE WHEN count(*) >= 3 THEN corr(u_at, mean) ELSE 0 END AS r FROM i GROUP BY d) "
)
_RAMP = {c: "CASE " + " ".join(f"WHEN t < {b[0]} THEN floor({a[i]} + (greatest(t, {a[0]}) - {a[0]}) / {b[0] - a[0]} * {b[i] - a[i]})::INT" for a, b in zip(ANCHORS, ANCHORS[1:])) + f" ELSE {ANCHORS[-1][i]} END" for i, c in enumerate("rgb", 1)}
_SPOTS = ", " + CELLS_SQL + ", spots AS (SELECT cell_id, type_cellvit, cell_id // 1000 AS tile, x % 72 AS x, y % 72 AS y FROM cells) "

QUERIES = {f.__name__: f for f in (padded_window, overview, pyramid_levels, level_choice, percentile_norm, minmax_u8, max_projection, alpha_blend, lut_colour, otsu_mask, mask_logic, mask_fallback, dilate_rect, dilate_vessels, sma_refine, sma_vessels, components, cleaned_mask, box_filter, edt_clamped, consumption, wkb_field, jacobi_steps, steady_supply, dist_profile, profile_corr, best_d, point_in_raster, rect_zonal_mean, tissue_fraction, vessel_tiles)}
ORACLE = {
    "padded_window": _PX + "SELECT t.tile, wx.i::INT AS wx, wy.i::INT AS wy, coalesce(cd31, 0)::BIGINT AS cd31 FROM (SELECT DISTINCT tile FROM px) t, (SELECT unnest(range(32)) AS i) wx, (SELECT unnest(range(32)) AS i) wy LEFT JOIN px ON px.tile = t.tile AND px.x = wx.i - 8 AND px.y = wy.i - 8",
    "overview": _PX + "SELECT tile, (x // 5)::INT AS x, (y // 5)::INT AS y, cd31 FROM px WHERE x % 5 = 0 AND y % 5 = 0 AND x < 60 AND y < 60",
    "pyramid_levels": _PX + "SELECT tile, l.level::INT AS level, count(*) AS n, sum(cd31)::BIGINT AS total FROM px, (VALUES (0, 1), (1, 2), (2, 4)) l(level, s) WHERE x % s = 0 AND y % s = 0 GROUP BY tile, l.level",
    "level_choice": _PX + ", l AS (SELECT tile, level::INT AS level, 2.0**level + (tile % 3)*0.3 AS factor FROM (SELECT DISTINCT tile FROM px), (SELECT unnest(range(4)) AS level)), p AS (SELECT *, 'last' AS policy FROM l QUALIFY row_number() OVER (PARTITION BY tile ORDER BY CASE WHEN round_even(factor, 0) <= 6 THEN level END DESC NULLS LAST) = 1 UNION ALL SELECT *, 'largest' FROM l QUALIFY row_number() OVER (PARTITION BY tile ORDER BY CASE WHEN factor <= 6 THEN factor END DESC NULLS LAST, level) = 1 UNION ALL SELECT *, 'nearest' FROM l QUALIFY row_number() OVER (PARTITION BY tile ORDER BY abs(factor - 6), level) = 1) SELECT tile, policy, level, greatest(round_even(6 / factor, 0), 1)::INT AS stride FROM p",
    "percentile_norm": _PX + _norm_sql("ki67") + "SELECT tile, x, y, round(norm, 6) AS norm, trunc(round(norm*255, 6))::INT AS u8 FROM ki67_n",
    "minmax_u8": _PX + ", e AS (SELECT tile, min(sma) AS a, max(sma) AS b FROM px GROUP BY tile) SELECT tile, x, y, (CASE WHEN b > a THEN trunc((sma - a) / (b - a) * 255) ELSE 0 END)::INT AS u8 FROM px JOIN e USING (tile)",
    "max_projection": _PX + "SELECT tile, x, y, greatest(cd31, sma, ki67, pcna) AS v FROM px",
    "alpha_blend": _PX + "SELECT tile, x, y, trunc(cd31*0.25::DOUBLE + sma*0.75::DOUBLE)::INT AS v FROM px",
    "lut_colour": _PX + "SELECT tile, x, y, " + ", ".join(f"{v} AS {k}" for k, v in _RAMP.items()) + " FROM (SELECT *, least(cd31 / 256.0, 1.0)::DOUBLE AS t FROM px)",
    "otsu_mask": _CD + "SELECT tile, max(cd31_t) AS threshold, count(*) FILTER (WHERE cd31_on) AS n_on FROM m GROUP BY tile",
    "mask_logic": _CS + "SELECT tile, count(*) FILTER (WHERE cd31_on AND sma_on) AS n_and, count(*) FILTER (WHERE cd31_on OR sma_on) AS n_or, count(*) FILTER (WHERE NOT cd31_on) AS n_not FROM m GROUP BY tile",
    "mask_fallback": _CD + "SELECT tile, round(c, 6) AS coverage, CASE WHEN c = 0 AND f THEN 'empty_fallback' WHEN c = 0 THEN 'empty' WHEN c >= 0.3 THEN 'noisy_fallback' ELSE 'ok' END AS status FROM (SELECT tile, avg((cd31 > 120 + (tile % 4)*60)::INT) AS c, bool_or(cd31_on) AS f FROM m GROUP BY tile)",
    "dilate_rect": _PX + _otsu_sql("sma") + "SELECT DISTINCT px.tile, (px.x + dx.i)::INT AS x, (px.y + dy.i)::INT AS y FROM px JOIN sma_o USING (tile), (SELECT unnest(range(-2, 3)) AS i) dx, (SELECT unnest(range(-2, 3)) AS i) dy WHERE sma > sma_t AND px.x + dx.i BETWEEN 0 AND 63 AND px.y + dy.i BETWEEN 0 AND 63",
    "dilate_vessels": _CD + "SELECT DISTINCT m.tile, (m.x + dx.i)::INT AS x, (m.y + dy.i)::INT AS y FROM m, (VALUES (-1), (0), (1)) dx(i), (VALUES (-1), (0), (1)) dy(i) WHERE cd31_on AND m.x + dx.i BETWEEN 0 AND 63 AND m.y + dy.i BETWEEN 0 AND 63",
    "sma_refine": _CS + ", n AS (SELECT DISTINCT m.tile, m.x + dx.i AS x, m.y + dy.i AS y FROM m, (SELECT unnest(range(-2, 3)) AS i) dx, (SELECT unnest(range(-2, 3)) AS i) dy WHERE sma_on AND (abs(dy.i) < 2 OR dx.i = 0)) SELECT tile, x, y FROM m WHERE sma_on OR (cd31_on AND (tile, x, y) IN (SELECT (tile, x, y) FROM n))",
    "components": _COMPONENTS_SQL.format(where="cd31 > 2 * cd31_t") + "SELECT tile, dense_rank() OVER (PARTITION BY tile ORDER BY root)::INT AS label, count(*) AS area, min(x) AS min_x, min(y) AS min_y FROM lab GROUP BY tile, root",
    "cleaned_mask": _CLEAN_SQL,
    "tissue_fraction": _TISSUE_SQL,
    "sma_vessels": _CS + ", n AS (SELECT DISTINCT m.tile, m.x + dx.i AS x, m.y + dy.i AS y FROM m, (SELECT unnest(range(-2, 3)) AS i) dx, (SELECT unnest(range(-2, 3)) AS i) dy WHERE cd31_on AND (abs(dy.i) < 2 OR dx.i = 0)) SELECT tile, x, y FROM m WHERE cd31_on OR (sma_on AND (tile, x, y) IN (SELECT (tile, x, y) FROM n))",
    "box_filter": _PX + ", r AS (SELECT tile, x, y, sum(cd31) OVER (PARTITION BY tile, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS s FROM px), b AS (SELECT tile, x, y, sum(s) OVER (PARTITION BY tile, x ORDER BY y ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) / 256 AS m FROM r) SELECT tile, x, y, round(m, 6) AS box_mean FROM b WHERE x <= 48 AND y <= 48 QUALIFY row_number() OVER (PARTITION BY tile ORDER BY m DESC, y, x) = 1",
    "edt_clamped": _DIST + f"SELECT tile, x, y, round(least(dist / (160.0 / {MPP * STEP * 8}), 1.0), 6) AS share, round(1 - least(dist / (160.0 / {MPP * STEP * 8}), 1.0), 6) AS oxygen FROM e",
    "consumption": _FIELD + "SELECT tile, x, y, round(k, 6) AS k FROM f",
    "wkb_field": _FIELD + "SELECT tile, x, y, round(u, 6) AS u FROM u",
    "jacobi_steps": _jacobi_sql(3),
    "dist_profile": _PROFILE + "SELECT bin, round(distance_um, 6) AS distance_um, pixel_count, round(mean, 6) AS mean FROM p",
    "profile_corr": _FIT + "SELECT d, round(r, 6) AS r FROM r",
    "best_d": _FIT + "SELECT d, round(r, 6) AS r FROM r ORDER BY r.r DESC, d LIMIT 1",
    "point_in_raster": _CD + _SPOTS + "SELECT s.tile, count(*) AS n, count(*) FILTER (WHERE coalesce(cd31_on, FALSE)) AS n_hit, round((count(*) FILTER (WHERE coalesce(cd31_on, FALSE))) / count(*) * 100, 6) AS hit_pct, count(DISTINCT type_cellvit) AS n_types FROM spots s LEFT JOIN m ON s.tile = m.tile AND s.x = m.x AND s.y = m.y GROUP BY s.tile",
    "rect_zonal_mean": _PX + _SPOTS + ", b AS (SELECT tile, cell_id, x AS x0, y AS y0, least(x + 2 + cell_id % 3, 64) AS x1, least(y + 2 + cell_id % 4, 64) AS y1 FROM spots) SELECT b.tile, cell_id, any_value((x1-x0)*(y1-y0))::BIGINT AS area, round(coalesce(sum(cd31), 0) / any_value((x1-x0)*(y1-y0)), 6) AS mean_cd31, round(coalesce(sum(ki67), 0) / any_value((x1-x0)*(y1-y0)), 6) AS mean_ki67 FROM b LEFT JOIN px ON px.tile = b.tile AND px.x >= x0 AND px.x < x1 AND px.y >= y0 AND px.y < y1 WHERE x1 > x0 AND y1 > y0 GROUP BY b.tile, cell_id",
    "vessel_tiles": _CD + "SELECT tile, count(*) AS n_on FROM m WHERE cd31 > cd31_t + 150 GROUP BY tile",
}
