"""Supply fields and their profiles: distance, decay, uptake, binned means, fits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import rasters
from tessera.sources.tables import materialize

#: Uptake base and weights, diffusion limits in um.
BASE, DEMAND, IMMUNE = 0.1, 0.3, 0.1
OXYGEN_UM, GLUCOSE_UM = 160.0, 450.0


def distance(pixels: DataFrame, keys: Sequence[str], on: str = "on") -> DataFrame:
    """(keys, x, y, dist): pixels to the nearest on pixel (above 0) of the tile; infinite where the tile has none.

    Down each column by a window over the column, then across: a line's columns are one array, of which each pixel
    takes the least of squared shift plus squared column distance. ``pixels`` has a row for every pixel.
    """
    column = Window.partitionBy(*keys, "x").orderBy("y")
    here = F.when(F.col(on) > 0, F.col("y"))
    above = F.last(here, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.last(here, ignorenulls=True).over(Window.partitionBy(*keys, "x").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down = rasters.spread(pixels.select(*keys, "x", "y", on), keys).select(*keys, "x", "y", F.least(F.col("y") - above, below - F.col("y")).cast("double").alias("__d"))
    lines = down.groupBy(*keys, "y").agg(F.collect_list(F.struct("x", (F.col("__d") * F.col("__d")).alias("d2"))).alias("__c"))
    lines = lines.withColumn("__n", F.filter("__c", lambda c: c["d2"].isNotNull()))
    across = lambda p: F.array_min(F.transform("__n", lambda c: (c["x"] - p["x"]) * (c["x"] - p["x"]) + c["d2"]))
    out = F.transform("__c", lambda p: F.struct(p["x"].alias("x"), F.coalesce(F.sqrt(across(p)), F.lit(float("inf"))).alias("dist")))
    # the outer form: for the inner one the optimizer would work out the lists once more to drop empty ones first
    return lines.select(*keys, "y", F.explode_outer(out).alias("o")).select(*keys, F.col("o.x").alias("x"), "y", F.col("o.dist").alias("dist"))


def clamped(dist: Column, mpp: float, limit_um: float) -> Column:
    """Distance as a share of the diffusion limit, at most 1."""
    return F.least(dist / (limit_um / mpp), F.lit(1.0))


def uptake(demand: Column, immune: Column | None = None, base: float = BASE, demand_weight: float = DEMAND, immune_weight: float = IMMUNE) -> Column:
    """Base rate plus weighted demand and immune terms, each clipped to [0, 1]."""
    if min(base, demand_weight, immune_weight) < 0:
        raise ValueError("base rate and weights must be >= 0")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    out = base + demand_weight * clip(demand)
    return out if immune is None else out + immune_weight * clip(immune)


def decay(on: Column, dist: Column, k: Column, mpp: float, limit_um: float, base: float = BASE) -> Column:
    """1 on vessels, else exponential decay whose length shrinks with the root of the uptake."""
    return F.when(on, 1.0).otherwise(F.exp(-dist * F.sqrt(k / base) * mpp / limit_um))


def _lines(pixels: DataFrame, keys: Sequence[str], source: str, k: str) -> DataFrame:
    """One row a line, with its places, clipped sources and rates in order, and a field of 0."""
    clip = F.struct("x", F.least(F.greatest(F.col(source), F.lit(0.0)), F.lit(1.0)).alias("s"), F.greatest(F.col(k), F.lit(0.0)).alias("k"))
    lines = rasters.spread(pixels.select(*keys, "x", "y", source, k), keys).groupBy(*keys, "y").agg(F.array_sort(F.collect_list(clip)).alias("__p"))
    return lines.withColumns({"u": F.transform("__p", lambda _: F.lit(0.0)), "__moved": F.lit(0.0)})


def _relaxed(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One step: each pixel takes what its four neighbours, its source and its uptake balance to; at an edge the pixel is its own neighbour."""
    tile = Window.partitionBy(*keys).orderBy("y")
    near = lines.withColumns({"__a": F.coalesce(F.lag("u").over(tile), "u"), "__b": F.coalesce(F.lead("u").over(tile), "u")})

    def balance(p: Column, i: Column) -> Column:
        own = F.get("u", i)
        around = F.coalesce(F.get("u", i - 1), own) + F.coalesce(F.get("u", i + 1), own) + F.get("__a", i) + F.get("__b", i)
        return F.least(F.greatest((around + p["s"]) / (p["k"] + 4.0), F.lit(0.0)), F.lit(1.0))

    step = near.select(*keys, "y", "__p", F.col("u").alias("__u"), F.transform("__p", balance).alias("u"))
    moved = F.array_max(F.zip_with("u", "__u", lambda a, b: F.abs(a - b)))
    return step.select(*keys, "y", "__p", "u", moved.alias("__moved"))


def _pixels(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lines.select(*keys, "y", F.explode_outer(F.arrays_zip(F.col("__p.x").alias("x"), "u")).alias("o")).select(*keys, F.col("o.x").alias("x"), "y", F.col("o.u").alias("u"))


def diffused(pixels: DataFrame, keys: Sequence[str], source: str, k: str, steps: int) -> DataFrame:
    """(keys, x, y, u) after ``steps`` steps of the steady-state equation lap(u) - k u + s = 0 on each tile, edges mirrored, u from 0 to 1.

    A row is a line of a tile; a step is a window over the tile's lines and expressions along them, so all
    steps share one shuffle and one sort. ``pixels`` has a row for every pixel.
    """
    if steps < 1:
        raise ValueError("at least one step")
    lines = _lines(pixels, keys, source, k)
    for _ in range(steps):
        lines = _relaxed(lines, keys)
    return _pixels(lines, keys)


def steady(pixels: DataFrame, keys: Sequence[str], source: str, k: str, tol: float = 1e-4, most_steps: int = 500, at_once: int = 25) -> DataFrame:
    """The field of ``diffused`` when no pixel of any tile moves by ``tol`` in a step any more, after ``most_steps`` at last.

    Every ``at_once`` steps the field is written and the largest move looked at.
    """
    if tol <= 0 or most_steps < 1:
        raise ValueError("tolerance and steps are above 0")
    lines = _lines(pixels, keys, source, k)
    for done in range(0, most_steps, at_once):
        for _ in range(min(at_once, most_steps - done)):
            lines = _relaxed(lines, keys)
        lines = materialize(lines, "field")
        if (lines.agg(F.max("__moved")).first()[0] or 0.0) < tol:
            break
    return _pixels(lines, keys)


@dataclass(frozen=True)
class LayerOptions:
    """Columns by role (None where a panel has no such marker) and the parameters of the supply layers."""

    cd31: str
    ki67: str
    sma: str | None = None
    pcna: str | None = None
    mpp: float = 1.0
    oxygen_um: float = OXYGEN_UM
    glucose_um: float = GLUCOSE_UM
    sma_reach: int = 2
    open_size: int = 0
    close_size: int = 0
    min_area: int = 0
    noisy: float = 0.98
    bin_um: float = 10.0

    def __post_init__(self) -> None:
        rasters.ellipse(self.open_size), rasters.ellipse(self.close_size)
        if not 0 < self.noisy <= 1:
            raise ValueError("noisy must be in (0, 1]")
        if self.min_area < 0 or self.sma_reach < 0:
            raise ValueError("min_area and sma_reach must be >= 0")
        if self.bin_um <= 0 or self.mpp <= 0:
            raise ValueError("bin_um and mpp must be > 0")


def _strong(pixels: DataFrame, keys: Sequence[str], value: str, name: str, how: str) -> DataFrame:
    """The pixels with ``name``: above Otsu's level of 256 levels of the value between its 1st and 99th percentile. ``how``: the hint for joins with tables of tiles."""
    levels = rasters.percentile_norm(pixels, keys, value, how=how).withColumn("__level", F.floor(F.col("norm") * 255).cast("int"))
    limit = rasters.otsu(levels, keys, "__level")
    return levels.join(limit.hint(how), list(keys)).withColumn(name, F.col("__level") > F.col("threshold")).drop("__level", "threshold", "norm")


def vessel_mask(pixels: DataFrame, keys: Sequence[str], o: LayerOptions, how: str) -> tuple[DataFrame, DataFrame]:
    """Vessels (keys, x, y, vessel) of every tile, and (keys, coverage, status) of how they were found: ok, noisy_fallback, empty_fallback or empty.

    ``how`` is the hint for joins with tables of tiles, as of ``rasters.sent``.
    """
    at = [*keys, "x", "y"]
    found = _strong(pixels, keys, o.cd31, "plain", how)
    mask = found.select(*at, F.col("plain").alias("on"))
    if o.sma:
        near = rasters.dilate(mask, keys, "on", rasters.ellipse(2 * o.sma_reach + 1)).withColumnRenamed("on", "near")
        muscle = _strong(found, keys, o.sma, "muscle", how).select(*at, "plain", "muscle")
        mask = muscle.join(near.hint("merge"), at).select(*at, (F.col("plain") | (F.col("muscle") & F.col("near"))).alias("on"))
    cleaned = rasters.clean(mask, keys, "on", o.open_size, o.close_size, o.min_area)
    both = materialize(found.select(*at, "plain").join(cleaned.hint("merge"), at), "masks")
    status = rasters.mask_status(both, F.col("on"), F.col("plain"), keys, o.noisy)
    chosen = both.join(status.hint(how), list(keys)).select(*at, F.when(F.col("status") == "ok", F.col("on")).otherwise(F.col("plain")).alias("vessel"))
    return chosen, status


def layers(pixels: DataFrame, keys: Sequence[str], o: LayerOptions, few: int = rasters.FEW) -> DataFrame:
    """(keys, x, y, vessel, dist_um, proliferation, oxygen, glucose, status) of every pixel: vessel mask and supply maps in [0, 1], 1 at a vessel.

    ``pixels`` has a row for every pixel and the columns named in ``o``; a tile without vessels has infinite distances and no supply.
    Tables of pixels are told to be shuffled, those of tiles to be broadcast where there are ``few`` tiles, which are counted: the planner goes by
    the size of the files, which are so well compressed that it would broadcast millions of pixels.
    """
    at = [*keys, "x", "y"]
    pixels = rasters.spread(pixels.select(*at, *dict.fromkeys(c for c in (o.cd31, o.ki67, o.sma, o.pcna) if c)), keys)
    how = rasters.sent(pixels.select(*keys).distinct().count(), few)
    mask, status = vessel_mask(pixels, keys, o, how)
    dist = distance(mask.withColumn("on", F.col("vessel").cast("int")), keys).withColumn("dist_um", F.col("dist") * o.mpp)
    demand = rasters.percentile_norm(pixels, keys, o.ki67, how=how).select(*at, F.col("norm").alias("proliferation"), F.col("norm").alias("__demand"))
    if o.pcna:
        other = rasters.percentile_norm(pixels, keys, o.pcna, how=how).select(*at, F.col("norm").alias("__other"))
        demand = demand.join(other.hint("merge"), at).select(*at, "proliferation", F.greatest("__demand", "__other").alias("__demand"))
    made = dist.join(demand.hint("merge"), at).join(status.select(*keys, "status").hint(how), list(keys))
    oxygen = 1 - clamped(F.col("dist"), o.mpp, o.oxygen_um)
    glucose = decay(F.col("dist") == 0, F.least(F.col("dist"), F.lit(1e9)), uptake(F.col("__demand")), o.mpp, o.glucose_um)
    return made.select(*at, (F.col("dist") == 0).alias("vessel"), "dist_um", "proliferation", oxygen.alias("oxygen"), glucose.alias("glucose"), "status")


def profile(pixels: DataFrame, distance_um: Column, value: Column, bin_um: float, limit_um: float) -> DataFrame:
    """Mean value by distance bin over all tiles, every bin present; a mean is null where the bin is empty.

    Partial sums per task, one row a bin after the shuffle.
    """
    if bin_um <= 0:
        raise ValueError("bin must be > 0")
    n = math.ceil(limit_um / bin_um) + 1
    spark = pixels.sparkSession
    at = F.least(F.greatest(F.floor(distance_um / bin_um), F.lit(0)), F.lit(n - 1)).cast("int")
    sums = pixels.withColumn("bin", at).groupBy("bin").agg(F.sum(value).alias("total"), F.count("*").alias("pixel_count"))
    return spark.range(n).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left").select("bin", ((F.col("bin") + 0.5) * bin_um).alias("distance_um"), F.coalesce("pixel_count", F.lit(0)).alias("pixel_count"), (F.col("total") / F.col("pixel_count")).alias("mean"))


def decay_curves(spark: SparkSession, rates: Sequence[float], k: float, step_um: float, limit_um: float) -> DataFrame:
    """Model curves exp(-d / sqrt(D / k)) sampled every ``step_um`` for each diffusivity D."""
    d = spark.createDataFrame([(float(r),) for r in rates], "d double")
    points = spark.range(int(limit_um / step_um) + 1).select((F.col("id") * step_um).alias("at"))
    return d.join(F.broadcast(points)).select("d", "at", F.exp(-F.col("at") / F.sqrt(F.col("d") / k)).alias("u"))


def interpolate(points: DataFrame, curve: DataFrame, x: str) -> DataFrame:
    """``u`` on the straight line between the curve's neighbouring samples; points outside have no row.

    The curve's segments (a few rows a curve) are broadcast; each point meets one segment a curve.
    """
    by = Window.partitionBy("d").orderBy("at")
    parts = curve.withColumns({"to": F.lead("at").over(by), "u_to": F.lead("u").over(by)}).where("to is not null")
    last = F.max("to").over(Window.partitionBy("d"))
    parts = parts.withColumn("end", last)
    hit = (F.col(x) >= F.col("at")) & ((F.col(x) < F.col("to")) | ((F.col(x) == F.col("end")) & (F.col("to") == F.col("end"))))
    share = (F.col(x) - F.col("at")) / (F.col("to") - F.col("at"))
    return points.join(F.broadcast(parts), hit).withColumn("u_at", F.col("u") + share * (F.col("u_to") - F.col("u"))).drop("at", "to", "u", "u_to", "end")


def correlation(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson r per key over rows where both are set; 0 with fewer than 3 or without spread."""
    ok = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return ok.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.coalesce(r, F.lit(0.0))).otherwise(0.0).alias("r"))
