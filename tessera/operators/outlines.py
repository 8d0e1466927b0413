"""Cell outlines on rasters: the pixels they cover, means under them, their place in a crop.

An outline is an array of structs x, y in pixels of its tile. It becomes pixel rows inside its own row, line by
line, so a tile that holds a large part of all cells is spread like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import materialize

#: Points further out than this many pixels count as so far out.
FAR = float(1 << 20)


def _corners(points: Column) -> Column:
    """The outline's points as whole numbers, truncated; points without two numbers are left out."""
    near = lambda c: F.greatest(F.least(c.cast("double"), F.lit(FAR)), F.lit(-FAR)).cast("int")
    ok = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.transform(ok, lambda p: F.struct(near(p["x"]).alias("x"), near(p["y"]).alias("y")))


def _range(low: Column, high: Column) -> Column:
    """The whole numbers from low to high, none where high is less."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _exploded(cells: DataFrame, *names: str) -> DataFrame:
    """One row a covered pixel. The outer form: for the inner one the optimizer would work out the pixels once more to drop empty lists first."""
    return cells.select(*names, F.explode_outer("pixels").alias("p")).where("p is not null")


#: Outlines for one task: rows are small and their pixels many, so they are spread by number, not by bytes.
TOGETHER = 1_000


def _spread(cells: DataFrame) -> DataFrame:
    cells = materialize(cells, "outlines")
    return cells.repartition(max(1, -(-cells.count() // TOGETHER)))


def with_pixels(cells: DataFrame, points: str, width: int, height: int, name: str = "pixels") -> DataFrame:
    """``name``: the pixels (structs x, y, each once) of a ``width`` x ``height`` tile that an outline covers; empty for null, for fewer than 3 points or off the tile.

    Vertices are truncated to whole numbers. A line's crossings with the edges, in order, open and close its spans
    (even-odd), both ends included; the pixels of the edges themselves, at whole steps along the longer side,
    halves to even, come on top.
    """
    made = cells.withColumn("__p", _corners(F.col(points)))
    turned = F.concat(F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), F.slice("__p", 1, 1))
    edge = lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy"))
    made = made.withColumn("__e", F.when(F.size("__p") >= 3, F.zip_with("__p", turned, edge)).otherwise(F.array().cast("array<struct<px:int,py:int,qx:int,qy:int>>")))
    span = lambda c, most: (F.greatest(F.array_min(F.col("__e")[c]), F.lit(0)), F.least(F.array_max(F.col("__e")[c]), F.lit(most - 1)))
    (x0, x1), (y0, y1) = span("px", width), span("py", height)
    made = made.withColumns({"__x0": x0, "__x1": x1, "__y0": y0, "__y1": y1})

    def line(y: Column) -> Column:
        rising = F.filter("__e", lambda e: (e["py"] <= y) != (e["qy"] <= y))
        cuts = F.array_sort(F.transform(rising, lambda e: e["px"] + (y - e["py"]) * (e["qx"] - e["px"]) / (e["qy"] - e["py"])))
        return F.struct(y.alias("y"), cuts.alias("c"))

    made = made.withColumn("__l", F.transform(_range(F.col("__y0"), F.col("__y1")), line))

    def spans(li: Column) -> Column:
        pairs = _range(F.lit(0), (F.size(li["c"]) / 2).cast("int") - 1)
        low = lambda i: F.greatest(F.ceil(li["c"][i * 2]).cast("int"), F.col("__x0"))
        high = lambda i: F.least(F.floor(li["c"][i * 2 + 1]).cast("int"), F.col("__x1"))
        return F.flatten(F.transform(pairs, lambda i: F.transform(_range(low(i), high(i)), lambda x: x + li["y"] * width)))

    def along(e: Column) -> Column:
        n = F.greatest(F.abs(e["qx"] - e["px"]), F.abs(e["qy"] - e["py"]), F.lit(1))
        at = lambda a, b, i: F.rint(a + i / n * (b - a)).cast("int")
        inside = lambda x, y: F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), x + y * width)
        return F.transform(_range(F.lit(0), n), lambda i: inside(at(e["px"], e["qx"], i), at(e["py"], e["qy"], i)))

    # an edge that is off the tile as a whole is not walked along
    close = F.filter("__e", lambda e: (F.least(e["px"], e["qx"]) < width) & (F.greatest(e["px"], e["qx"]) >= 0) & (F.least(e["py"], e["qy"]) < height) & (F.greatest(e["py"], e["qy"]) >= 0))
    places = F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform("__l", spans)), F.flatten(F.transform(close, along)))))
    made = made.withColumn("__at", F.coalesce(places, F.array().cast("array<int>")))
    pixels = F.transform("__at", lambda k: F.struct((k % width).alias("x"), F.floor(k / width).cast("int").alias("y")))
    return made.withColumn(name, pixels).drop("__p", "__e", "__l", "__at", "__x0", "__x1", "__y0", "__y1")


def means_under(cells: DataFrame, pixels: DataFrame, keys: Sequence[str], id_cols: Sequence[str], points: str, side: int, values: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, id_cols, area, values): the mean of each named value under each outline, of several columns the mean of their means.

    ``pixels`` has keys, x, y and the columns; pixels without a row count as 0. An outline of fewer than 3 points or
    without a pixel on the tile has no row (``skipped`` counts those). Covered pixels meet the raster by tile
    and pixel, so the cells of one tile are spread over tasks.
    """
    names = list(dict.fromkeys(c for own in values.values() for c in own))
    covered = _exploded(with_pixels(_spread(cells.select(*keys, *id_cols, points)), points, side, side), *keys, *id_cols).select(*keys, *id_cols, "p.x", "p.y")
    found = covered.join(pixels.select(*keys, "x", "y", *names), [*keys, "x", "y"], "left")
    each = found.groupBy(*keys, *id_cols).agg(F.count("*").alias("area"), *[(F.coalesce(F.sum(c), F.lit(0)) / F.count("*")).alias(f"__m_{c}") for c in names])
    mean = {k: sum((F.col(f"__m_{c}") for c in own[1:]), F.col(f"__m_{own[0]}")) / len(own) for k, own in values.items()}
    return each.select(*keys, *id_cols, "area", *[m.alias(k) for k, m in mean.items()])


def skipped(cells: DataFrame, pixels: DataFrame, keys: Sequence[str], points: str, side: int) -> DataFrame:
    """(n_cells, n_no_tile, n_no_pixel): outlines in all, of tiles that have no raster, and of those that have, without a pixel on it."""
    tiles = pixels.select(*keys).distinct().withColumn("__t", F.lit(True))
    at = with_pixels(_spread(cells.select(*keys, points)), points, side, side).join(tiles, list(keys), "left")
    return at.agg(F.count("*").alias("n_cells"), F.count_if(F.col("__t").isNull()).alias("n_no_tile"), F.count_if(F.col("__t").isNotNull() & (F.size("pixels") == 0)).alias("n_no_pixel"))


def masks(cells: DataFrame, keys: Sequence[str], label: str, points: str, side: int) -> DataFrame:
    """(keys, label, n_cells, n_on): outlines of each label on each tile, and the pixels that any of them covers. Fewer than 3 points don't count."""
    work = _spread(cells.where(F.size(points) >= 3).select(*keys, label, points))
    counts = work.groupBy(*keys, label).agg(F.count("*").cast("int").alias("n_cells"))
    pixels = _exploded(with_pixels(work, points, side, side), *keys, label).select(*keys, label, (F.col("p.y") * side + F.col("p.x")).alias("p"))
    on = pixels.distinct().groupBy(*keys, label).agg(F.count("*").cast("int").alias("__on"))
    named = on.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, label)], "__on")
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, label)]
    return counts.join(named, same, "left").select(*keys, label, "n_cells", F.coalesce("__on", F.lit(0)).alias("n_on"))


def last_drawn(cells: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, points: str, side: int) -> DataFrame:
    """(keys, x, y, label) of the covered pixels, where outlines overlap with the label of the last one by ``order``."""
    work = _exploded(with_pixels(_spread(cells.select(*keys, *order, label, points)), points, side, side), *keys, *order, label)
    return work.groupBy(*keys, "p").agg(F.max_by(label, F.struct(*order)).alias(label)).select(*keys, "p.x", "p.y", label)


def in_crop(picks: DataFrame, outlines: DataFrame, keys: Sequence[str], ordinal: str, points: str) -> DataFrame:
    """``picks`` (keys, ordinal, x0_crop, y0_crop) with the ``points`` of their outlines, by tile and place in the file, shifted to the crop; null for a cell or outline that is not there."""
    named = outlines.select(*keys, ordinal, F.col(points).alias("__points"))
    moved = F.transform("__points", lambda p: F.struct((p["x"] - F.col("x0_crop")).alias("x"), (p["y"] - F.col("y0_crop")).alias("y")))
    return picks.join(named, [*keys, ordinal], "left").withColumn(points, F.when(F.size("__points") > 0, moved)).drop("__points")
