"""Patch grids, boxes, coordinates and windows of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(slide_index: DataFrame) -> DataFrame:
    """The highest revision of each slide, rows delivered twice once; a slide index row is small, so the aggregate keeps it whole."""
    return slide_index.groupBy("slide_id").agg(F.max_by(F.struct(*[c for c in slide_index.columns if c != "slide_id"]), "rev").alias("__r")).select("slide_id", "__r.*")


def patch_grid(slides: DataFrame) -> DataFrame:
    """(slide_id, x0, y0) of every patch that lies wholly inside the image; images smaller than a patch have none."""
    ok = slides.where("img_w >= patch_size and img_h >= patch_size and stride > 0")
    xs, ys = (F.sequence(F.lit(0), F.col(s) - F.col("patch_size"), F.col("stride")) for s in ("img_w", "img_h"))
    return ok.withColumn("x0", F.explode(xs)).withColumn("y0", F.explode(ys))


def covered_cells(boxes: DataFrame, step: int, width: Column, height: Column) -> DataFrame:
    """The mask cells (mx, my) of each patch box on a mask that is ``step`` times coarser, at least one, cut at the mask's edge."""
    if step < 1:
        raise ValueError("step must be >= 1")
    from_x, from_y = F.floor(F.col("x0") / step), F.floor(F.col("y0") / step)
    to_x = F.least(F.greatest(from_x + 1, F.floor((F.col("x0") + F.col("patch_size")) / step)), width)
    to_y = F.least(F.greatest(from_y + 1, F.floor((F.col("y0") + F.col("patch_size")) / step)), height)
    ok = boxes.where((to_x > from_x) & (to_y > from_y))
    return ok.withColumn("mx", F.explode(F.sequence(from_x, to_x - 1))).withColumn("my", F.explode(F.sequence(from_y, to_y - 1)))


def tissue_patches(boxes: DataFrame, mask: DataFrame, step: int, width: Column, height: Column, least: Column) -> DataFrame:
    """Patches whose mask region is at least ``least`` on (inclusive): boxes are spread over the cells they cover and equi-joined."""
    cells = covered_cells(boxes, step, width, height)
    on = mask.select("slide_id", "mx", "my", F.lit(1).alias("__on"))
    share = cells.join(on, ["slide_id", "mx", "my"], "left").groupBy("slide_id", "x0", "y0").agg(F.avg(F.coalesce("__on", F.lit(0))).alias("tissue"), F.max(least).alias("__least"))
    return share.where(F.col("tissue") >= F.col("__least")).drop("__least")


def multiplex_box(scale: Column) -> dict[str, Column]:
    """Place and size of a patch on the other image; halves round to even, the size is at least 1."""
    return {"mx_x0": F.rint(F.col("x0") * scale).cast("int"), "mx_y0": F.rint(F.col("y0") * scale).cast("int"), "mx_size": F.greatest(F.rint(F.col("patch_size") * scale), F.lit(1.0)).cast("int")}


def overlap_share(x0: Column, y0: Column, size: Column, width: Column, height: Column) -> Column:
    """The part of a box inside an image; exactly 1 where it is wholly inside."""
    x1, y1, zero = x0 + size, y0 + size, F.lit(0)
    w = F.greatest(zero, F.least(x1, width) - F.greatest(zero, x0))
    h = F.greatest(zero, F.least(y1, height) - F.greatest(zero, y0))
    inside = (x0 >= 0) & (y0 >= 0) & (x1 <= width) & (y1 <= height)
    return F.when(inside, 1.0).otherwise(w.cast("double") * h / (size.cast("double") * size + 1e-9))


def overlapping(patches: DataFrame, least: float) -> DataFrame:
    """The patches whose ``overlap`` is ``least`` or more."""
    if not 0 <= least <= 1:
        raise ValueError("an overlap is a share from 0 to 1")
    return patches.where(F.col("overlap") >= least)


def inside(x: int, y: int, width: int, height: int, img_w: int, img_h: int) -> None:
    """ValueError unless a box lies inside an image."""
    if min(x, y) < 0 or min(width, height) < 1 or x + width > img_w or y + height > img_h:
        raise ValueError(f"the box {x},{y},{width},{height} is not inside {img_w} x {img_h}")


def dense_window(points: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Per key the window of ``size`` with most points (first in row-major order), its origin kept inside the image.

    Points need x, y, img_w and img_h; those outside the image do not count. Counts combine before the shuffle.
    """
    inside = points.where("x >= 0 and y >= 0 and x < img_w and y < img_h")
    counts = inside.groupBy(*keys, "img_w", "img_h", F.floor(F.col("x") / size).alias("ix"), F.floor(F.col("y") / size).alias("iy")).agg(F.count("*").alias("n"))
    best = counts.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "iy", "ix"))).where("__n = 1")
    keep = lambda i, side: F.least(F.col(i) * size, F.greatest(F.col(side) - size, F.lit(0))).cast("bigint")
    return best.select(*keys, keep("ix", "img_w").alias("x0"), keep("iy", "img_h").alias("y0"), F.col("n").alias("n_points"))


def affine(matrix: Sequence[Sequence[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """A 2 x 3 affine map of points."""
    (a, b, tx), (c, d, ty) = matrix
    return a * x + b * y + tx, c * x + d * y + ty


def mapped_box(matrix: Sequence[Sequence[float]], x0: Column, y0: Column, w: Column, h: Column) -> dict[str, Column]:
    """The axis-aligned box (bx, by, bw, bh) around a box's mapped corners: floor of the least, ceil of the greatest + 1."""
    corners = [affine(matrix, x, y) for x in (x0, x0 + w - 1) for y in (y0, y0 + h - 1)]
    lx, ly = (F.floor(F.least(*[p[i] for p in corners])) for i in (0, 1))
    hx, hy = (F.ceil(F.greatest(*[p[i] for p in corners])) + 1 for i in (0, 1))
    return {"bx": lx, "by": ly, "bw": hx - lx, "bh": hy - ly}


def parse_crop(text: Column, default_size: int = 512) -> Column:
    """x, y, width and height of ``x,y``, ``x,y,size`` or ``x,y,width,height``; null for anything else (the strict form raises)."""
    parts = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    numbers = F.transform(parts, lambda t: t.try_cast("int"))
    n = F.when(F.exists(numbers, lambda v: v.isNull()), 0).otherwise(F.size(numbers))
    at = lambda i: F.get(numbers, F.lit(i))
    box = lambda w, h: F.struct(at(0).alias("x"), at(1).alias("y"), w.alias("w"), h.alias("h"))
    return F.when(n == 2, box(F.lit(default_size), F.lit(default_size))).when(n == 3, box(at(2), at(2))).when(n == 4, box(at(2), at(3)))


def polygon_measures(points: Column) -> dict[str, Column]:
    """Area, centroid and bounds of a polygon given as an array of structs x, y (shoelace formula).

    Area 0 or fewer than 3 points give null centroids.
    """
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    pairs = F.zip_with(points, turned, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
    twice = total(lambda p: p["c"])
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"area": F.abs(twice) / 2, "cx": F.when(twice != 0, total(lambda p: p["sx"] * p["c"]) / (3 * twice)), "cy": F.when(twice != 0, total(lambda p: p["sy"] * p["c"]) / (3 * twice)), "min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}
