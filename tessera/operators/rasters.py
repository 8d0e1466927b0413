"""Raster operators. Pixels are rows (keys, x, y, values), a tile is what ``keys`` name.

Windows and groups are lines and pixels of one tile, whose size the tiling bounds, so none grows with the slide.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import materialize

#: Pixels for one task. They are small and what is done for each is not, so they are spread by number, not by bytes.
TOGETHER = 50_000
#: Up to so many rows of a table of tiles, runs or edges are broadcast.
FEW = 10_000


def sent(n: int, few: int = FEW) -> str:
    """The hint for a join with a table of ``n`` counted rows: broadcast if these are few, else shuffled."""
    return "broadcast" if n <= few else "merge"


def spread(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pixels, written once and spread by tile: windows and groups within tiles then need no further shuffle."""
    pixels = materialize(pixels, "pixels")
    return pixels.repartition(max(1, -(-pixels.count() // TOGETHER)), *keys)


def full_grid(pixels: DataFrame, keys: Sequence[str], side: int, values: Sequence[str]) -> DataFrame:
    """All ``side`` x ``side`` pixels of each key; absent pixels and null values are 0.

    A join with the places and not an explosion, whose rows the planner would not count: it would broadcast the whole grid.
    """
    at = F.col("id")
    places = pixels.sparkSession.range(side * side).select((at % side).cast("int").alias("x"), F.floor(at / side).cast("int").alias("y"))
    grid = pixels.select(*keys).distinct().join(F.broadcast(places))
    return grid.join(pixels.select(*keys, "x", "y", *values), [*keys, "x", "y"], "left").fillna(0, list(values))


def window_read(pixels: DataFrame, keys: Sequence[str], x0: int, y0: int, width: int, height: int, value: str = "v") -> DataFrame:
    """The window's pixels at window coordinates, 0 beyond the raster. Filters before it joins, so scans are pruned."""
    inside = pixels.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    grid = pixels.select(*keys).distinct().withColumn("wx", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("wy", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    found = inside.select(*keys, (F.col("x") - x0).alias("wx"), (F.col("y") - y0).alias("wy"), value)
    return grid.join(found, [*keys, "wx", "wy"], "left").fillna(0, [value])


def overview(pixels: DataFrame, step: int, width: int, height: int) -> DataFrame:
    """Every ``step``-th pixel, at overview coordinates, of the part that whole steps cover."""
    if step < 1:
        raise ValueError("step must be >= 1")
    kept = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("x") < width // step * step) & (F.col("y") < height // step * step))
    return kept.withColumns({"x": F.floor(F.col("x") / step).cast("int"), "y": F.floor(F.col("y") / step).cast("int")})


def pyramid(pixels: DataFrame, side: int, least: int) -> DataFrame:
    """Levels by halving until a side is at most ``least``; level 0 is the raster itself."""
    out, level, step = pixels.withColumn("level", F.lit(0)), 0, 1
    while side // step > least:
        level, step = level + 1, step * 2
        out = out.unionByName(overview(pixels, step, side, side).withColumn("level", F.lit(level)))
    return out


def pick_level(levels: DataFrame, keys: Sequence[str], wanted: int, policy: str) -> DataFrame:
    """One level per key for a wanted downsampling, from (keys, level, factor).

    ``last``: the last level with round(factor) <= wanted; ``largest``: the largest factor <= wanted;
    ``nearest``: the least difference; ties to the lower level. ``stride`` is what remains to be skipped.
    """
    order = {"last": [F.desc(F.when(F.rint("factor") <= wanted, F.col("level")))], "largest": [F.desc(F.when(F.col("factor") <= wanted, F.col("factor"))), F.asc("level")], "nearest": [F.asc(F.abs(F.col("factor") - wanted)), F.asc("level")]}[policy]
    ranked = levels.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return ranked.withColumn("stride", F.greatest(F.rint(wanted / F.col("factor")), F.lit(1.0)).cast("int"))


def percentile_norm(pixels: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99, how: str | None = None) -> DataFrame:
    """``norm``: clipped to the key's exact low and high percentile and scaled to [0, 1]; 0 where these are equal. ``how``: the hint for the join with the percentiles."""
    ends = pixels.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__e"))
    ends = ends.hint(how) if how else ends
    lo, hi = F.col("__e")[0], F.col("__e")[1]
    norm = F.when(hi > lo, (F.least(F.greatest(F.col(value).cast("double"), lo), hi) - lo) / (hi - lo)).otherwise(0.0)
    return pixels.join(ends, list(keys)).withColumn("norm", norm).drop("__e")


def stretch_u8(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``u8``: scaled from the key's least to greatest value, truncated; a constant is 0."""
    ends = pixels.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    u8 = F.when(F.col("__b") > F.col("__a"), ((F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a")) * 255).cast("int")).otherwise(0)
    return pixels.join(ends, list(keys)).withColumn("u8", u8).drop("__a", "__b")


def otsu(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """(keys, threshold) that parts an integer-valued raster best in two; the lowest of equals, 0 for a constant.

    Counts per level before the shuffle; only levels are sorted.
    """
    by = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    levels = pixels.groupBy(*keys, value).agg(F.count("*").alias("n"))
    n, s = F.col("n"), F.col("n") * F.col(value)
    cum = levels.withColumns({"w0": F.sum(n).over(by), "s0": F.sum(s).over(by), "w": F.sum(n).over(whole), "s": F.sum(s).over(whole)})
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    score = F.when(F.col("w0") < F.col("w"), F.col("w0").cast("double") * (F.col("w") - F.col("w0")).cast("double") * gap * gap).otherwise(-1.0)
    best = cum.groupBy(*keys).agg(F.min(F.struct((-score).alias("__s"), F.col(value).alias("t"))).alias("__m"))
    return best.select(*keys, F.when(F.col("__m.__s") > 0, 0).otherwise(F.col("__m.t")).cast("bigint").alias("threshold"))


def dilate_rect(on: DataFrame, keys: Sequence[str], side: int, radius: int) -> DataFrame:
    """Pixels within a square of ``2 radius + 1`` of an on pixel, inside the raster."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    spread = lambda c: F.explode(F.transform(reach, lambda o: F.col(c) + o)).alias(c)
    moved = on.select(*keys, spread("x"), "y").distinct().select(*keys, "x", spread("y"))
    return moved.where(F.col("x").between(0, side - 1) & F.col("y").between(0, side - 1)).distinct()


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of an elliptic element: row dy reaches round(r sqrt(1 - (dy/r)^2)) to each side; 0 and 1 are the pixel itself."""
    if size < 0 or (size and size % 2 == 0):
        raise ValueError(f"an element has a centre: its size is odd, or 0 for none, not {size}")
    r = size // 2
    reach = {dy: round(r * math.sqrt(1 - (dy / r) ** 2)) if r else 0 for dy in range(-r, r + 1)}
    return [(dx, dy) for dy, w in reach.items() for dx in range(-w, w + 1)]


def square(low: int, high: int) -> list[tuple[int, int]]:
    """Offsets of a square from ``low`` to ``high`` in both directions."""
    return [(dx, dy) for dy in range(low, high + 1) for dx in range(low, high + 1)]


def _over_neighbours(mask: DataFrame, keys: Sequence[str], on: str, element: Sequence[tuple[int, int]], pick) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in element])
    told = mask.select(*keys, "x", "y", F.col(on).alias("__v"), F.explode(offsets).alias("o"))
    told = told.select(*keys, (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "__v", (F.greatest(F.abs(F.col("o.dx")), F.abs(F.col("o.dy"))) == 0).alias("__own"))
    # targets beyond the raster hear of others only; every element holds its centre
    return told.groupBy(*keys, "x", "y").agg(pick("__v").alias(on), F.max("__own").alias("__own")).where("__own").drop("__own")


def dilate(mask: DataFrame, keys: Sequence[str], on: str, element: Sequence[tuple[int, int]]) -> DataFrame:
    """(keys, x, y, on): on where any pixel at the element's offsets is; ``mask`` has a row for every pixel, beyond it counts as off.

    Each pixel tells its neighbours; maxima are taken within tasks before the one shuffle by tile and pixel.
    """
    return _over_neighbours(mask, keys, on, element, F.max)


def erode(mask: DataFrame, keys: Sequence[str], on: str, element: Sequence[tuple[int, int]]) -> DataFrame:
    """(keys, x, y, on): on where all pixels at the element's offsets are; beyond the mask counts as on."""
    return _over_neighbours(mask, keys, on, element, F.min)


def components(on: DataFrame, keys: Sequence[str], few: int = FEW) -> DataFrame:
    """(keys, x, y, label) of on pixels, given once each: 8-connected components, numbered from 1 in scan order of their first pixels.

    Runs of pixels in a line are the nodes, runs that touch one of the next line the edges. In each round every node takes
    the least of its neighbours that is below it as its parent, sixteen parents further at once, and edges are
    drawn between what is left; at least half of the nodes that still have edges go. A round is two written tables of
    a row a node and a row an edge, and the rounds' parents are followed at the end. Parents and runs are broadcast where
    there are ``few`` edges or runs, which are counted, and else shuffled: by the size of their files, which are well
    compressed, the planner would broadcast tables that in memory are a hundred times as large.
    """
    line = Window.partitionBy(*keys, "y").orderBy("x")
    begins = F.coalesce(F.col("x") - F.lag("x").over(line) != 1, F.lit(True)).cast("int")
    pixels = materialize(on.select(*keys, "x", "y").withColumn("__b", begins).withColumn("__run", F.sum("__b").over(line)).drop("__b"), "runs")
    runs = pixels.groupBy(*keys, "y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).withColumn("node", F.struct("y", F.col("x0").alias("x")))
    runs = materialize(runs, "nodes")
    by = sent(runs.count(), few)
    below = runs.select(*keys, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("node").alias("other"))
    touch = runs.join(below.hint(by), [*keys, "y"]).where("b0 <= x1 + 1 and b1 >= x0 - 1").select(*keys, "node", "other")
    edges = materialize(touch.unionByName(touch.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))), "edges")
    state = runs.select(*keys, F.col("node"), F.col("node").alias("root"))
    follow = lambda df, c, parents, how: df.join(parents.select(*keys, F.col("node").alias(c), F.col("parent").alias("__p")).hint(how), [*keys, c], "left").withColumn(c, F.coalesce("__p", c)).drop("__p")
    while n := edges.count():
        how = sent(n, few)
        parents = edges.groupBy(*keys, "node").agg(F.min("other").alias("parent")).where("parent < node")
        for _ in range(4):
            parents = follow(parents, "parent", parents.select(*keys, F.col("node").alias("node"), F.col("parent").alias("parent")), how)
        parents = materialize(parents, "parents")
        edges = materialize(follow(follow(edges, "node", parents, how), "other", parents, how).where("node <> other").select(*keys, "node", "other").distinct(), "edges")
        state = follow(state, "root", parents, how)
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("root"))
    labels = state.withColumn("label", number).select(*keys, F.col("node.y").alias("y"), F.col("node.x").alias("x0"), "label")
    named = runs.select(*keys, "y", "__run", "x0").join(labels.hint(by), [*keys, "y", "x0"]).select(*keys, "y", "__run", "label")
    return pixels.join(named.hint(by), [*keys, "y", "__run"]).select(*keys, "x", "y", "label")


def clean(mask: DataFrame, keys: Sequence[str], on: str, open_size: int = 0, close_size: int = 0, min_area: int = 0) -> DataFrame:
    """(keys, x, y, on) of a mask with all its pixels after opening, closing and removal of components of fewer than ``min_area`` pixels, each optional.

    Components and kept pixels are told to be shuffled: the planner goes by the size of the written tables' files, which are well compressed.
    """
    opening, closing = ellipse(open_size), ellipse(close_size)
    if min_area < 0:
        raise ValueError("a least area is not negative")
    if open_size > 1:
        mask = dilate(erode(mask, keys, on, opening), keys, on, opening)
    if close_size > 1:
        mask = erode(dilate(mask, keys, on, closing), keys, on, closing)
    mask = mask.select(*keys, "x", "y", on)
    if min_area > 1:
        mask = materialize(mask, "mask")
        label = components(mask.where(on), keys)
        large = label.groupBy(*keys, "label").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_area).select(*keys, "label")
        kept = label.join(large.hint("merge"), [*keys, "label"]).select(*keys, "x", "y", F.lit(True).alias("__kept"))
        mask = mask.join(kept.hint("merge"), [*keys, "x", "y"], "left").select(*keys, "x", "y", F.coalesce("__kept", F.lit(False)).alias(on))
    return mask


def median_filter(pixels: DataFrame, keys: Sequence[str], value: str, size: int) -> DataFrame:
    """(keys, x, y, value): the median over a square of an odd size, edges repeated; ``pixels`` has a row for every pixel.

    One row a line with its values in order; the neighbour lines come by a window over the tile.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError(f"a median has a middle: the size is odd, not {size}")
    r = size // 2
    lines = spread(pixels.select(*keys, "x", "y", value), keys).groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))).alias("__p")).withColumn("__v", F.col("__p.v"))
    padded = F.concat(F.array_repeat(F.get("__v", F.lit(0)), r), F.col("__v"), F.array_repeat(F.element_at("__v", -1), r))
    lines = lines.withColumn("__w", padded)
    tile = Window.partitionBy(*keys).orderBy("y")
    whole = tile.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.coalesce(F.lag("__w", i).over(tile), F.first("__w").over(whole)) for i in range(r, 0, -1)] + [F.col("__w")] + [F.coalesce(F.lead("__w", i).over(tile), F.last("__w").over(whole)) for i in range(1, r + 1)]
    lines = lines.select(*keys, "y", "__p", F.array(*near).alias("__near"))
    middle = lambda i: F.array_sort(F.flatten(F.transform("__near", lambda line: F.slice(line, i + 1, size))))[size * size // 2]
    out = F.transform("__p", lambda p, i: F.struct(p["x"].alias("x"), middle(i).alias("v")))
    return lines.select(*keys, "y", F.explode_outer(out).alias("o")).select(*keys, F.col("o.x").alias("x"), "y", F.col("o.v").alias(value))


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation of byte channels, 0 to 255, halves to even; black is 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.rint((top - low) * 255 / F.greatest(top, F.lit(1))).cast("int")


def tissue(pixels: DataFrame, keys: Sequence[str], rgb: Sequence[str], blur: int = 7, close: int = 4) -> DataFrame:
    """(keys, x, y, tissue) of a stained overview: blurred saturation above its Otsu level, closed by a square; an even blur grows by 1."""
    channel = [F.least(F.greatest(F.col(c), F.lit(0)), F.lit(255)) for c in rgb]
    blurred = median_filter(pixels.select(*keys, "x", "y", saturation(*channel).alias("v")), keys, "v", blur + 1 - blur % 2)
    blurred = materialize(blurred, "blurred")
    mask = blurred.join(otsu(blurred, keys, "v"), list(keys)).select(*keys, "x", "y", (F.col("v") > F.col("threshold")).alias("tissue"))
    back = close // 2
    return erode(dilate(mask, keys, "tissue", square(back - close + 1, back)), keys, "tissue", square(-back, close - 1 - back))


def mask_status(tiles: DataFrame, candidate: Column, fallback: Column, keys: Sequence[str], noisy: float = 0.98) -> DataFrame:
    """Per key the candidate's coverage and which mask to use: ok, noisy_fallback, empty_fallback or empty."""
    if not 0 < noisy <= 1:
        raise ValueError("noisy must be in (0, 1]")
    cover = tiles.groupBy(*keys).agg(F.avg(candidate.cast("int")).alias("coverage"), F.max(candidate).alias("__c"), F.max(fallback).alias("__f"))
    status = F.when(~F.col("__c") & F.col("__f"), "empty_fallback").when(~F.col("__c"), "empty").when(F.col("coverage") >= noisy, "noisy_fallback").otherwise("ok")
    return cover.select(*keys, "coverage", status.alias("status"))


def rectangle_pixels(boxes: DataFrame) -> DataFrame:
    """The pixels of half-open boxes (x0, y0, x1, y1), one row each; empty boxes have none."""
    ok = boxes.where("x1 > x0 and y1 > y0")
    return ok.withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))


def zonal_mean(boxes: DataFrame, pixels: DataFrame, keys: Sequence[str], id_col: str, values: Sequence[str]) -> DataFrame:
    """Area and means of the raster under each box; pixels without a row count as 0."""
    cover = rectangle_pixels(boxes.select(*keys, id_col, "x0", "y0", "x1", "y1"))
    joined = cover.join(pixels, [*keys, "x", "y"], "left")
    return joined.groupBy(*keys, id_col).agg(F.count("*").alias("area"), *[(F.coalesce(F.sum(v), F.lit(0)) / F.count("*")).alias(f"mean_{v}") for v in values])


def blend(top: Column, under: Column, alpha: float) -> Column:
    """Alpha compositing, truncated."""
    return (top * alpha + under * (1 - alpha)).cast("int")


def ramp(value: Column, anchors: Sequence[tuple[float, int, int, int]]) -> dict[str, Column]:
    """r, g, b of a value in [0, 1] on straight lines between colour anchors; values beyond take the end's."""
    out = {}
    for i, name in enumerate("rgb"):
        color = F.lit(anchors[-1][i + 1])
        for (a, *from_), (b, *to) in reversed(list(zip(anchors, anchors[1:]))):
            color = F.when(value < b, F.floor(from_[i] + (F.greatest(value, F.lit(a)) - a) / (b - a) * (to[i] - from_[i])).cast("int")).otherwise(color)
        out[name] = color
    return out


def box_means(pixels: DataFrame, keys: Sequence[str], size: int, value: str = "v") -> DataFrame:
    """Mean over a ``size`` x ``size`` box from each pixel on (cut at the edges), by two one-dimensional passes over a full grid."""
    along = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(0, size - 1)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(0, size - 1)
    row = pixels.withColumns({"__s": F.sum(value).over(along), "__n": F.count("*").over(along)})
    return row.withColumn("box_mean", F.sum("__s").over(down) / F.sum("__n").over(down)).drop("__s", "__n")
