"""Spatial matching: nearest neighbour within a radius, points in rasters, greedy one-to-one pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import attach
from tessera.operators.rasters import components
from tessera.sources.tables import materialize


#: Points of a square beyond which it is split, so that no task gets all of a dense place.
DENSE = 2_000


def nearest(points: DataFrame, others: DataFrame, keys: Sequence[str], radius: float, other_id: str, dense: int = DENSE) -> DataFrame:
    """Every row of ``points`` (x, y) with ``match_id`` and ``distance`` of the nearest of ``others`` within ``radius``, else nulls.

    A grid-bucket equi-join: squares of the radius, each of ``others`` copied to its 9 neighbours, so no
    pair further apart than 3 radii meets and no nested loop is planned. Ties go to the lowest id. Null
    keys or coordinates match nothing and are spread over squares of their own. A square with more than ``dense`` points
    is split into pieces of about as many, to each of which its others are copied. A point is in one piece
    only, so the reduction to the nearest reuses the join's partitioning. A number for each row
    of ``points`` keeps apart those that are equal in every column.
    """
    near = others.select(*keys, F.col(other_id).alias("__id"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = near.withColumn("__bx", F.explode(F.transform(offsets, lambda o: F.floor(F.col("__x") / radius) + o))).withColumn("__by", F.explode(F.transform(offsets, lambda o: F.floor(F.col("__y") / radius) + o)))
    spread = F.pmod(F.xxhash64(*points.columns), F.lit(4096))
    at = {"__bx": F.coalesce(F.floor(F.col("x") / radius), spread), "__by": F.floor(F.col("y") / radius)}
    squares = [*keys, "__bx", "__by"]
    full = points.withColumns(at).groupBy(*squares).agg(F.count("*").alias("__rows")).where(F.col("__rows") > dense).where(F.col("__by").isNotNull())
    full = materialize(full.withColumn("__pieces", F.ceil(F.col("__rows") / dense).cast("int")), "dense")
    left = points.withColumns(at | {"__row": F.monotonically_increasing_id()})
    if full.isEmpty():
        left, near = left.withColumn("__piece", F.lit(0)), near.withColumn("__piece", F.lit(0))
    else:
        left = attach(left, full, squares, "__rows", "left").withColumn("__piece", F.coalesce(F.pmod("__row", "__pieces"), F.lit(0)).cast("int")).drop("__pieces")
        near = attach(near, full, squares, "__rows", "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    d2 = (F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2
    same = [left[c] == near[c] for c in (*squares, "__piece")] + [d2 <= radius * radius]
    square = [*squares, "__piece", "__row", *[c for c in points.columns if c not in keys]]
    joined = left.join(near, same, "left").select(*[left[c] for c in square], F.when(F.col("__id").isNotNull(), F.struct(d2.alias("d2"), F.col("__id").alias("id"))).alias("__m"))
    best = joined.groupBy(*square).agg(F.min("__m").alias("__m"))
    return best.select(*points.columns, F.col("__m.id").alias("match_id"), F.sqrt("__m.d2").alias("distance"))


TOGETHER = 256


def greedy_pairs(cells: DataFrame, rows: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """One-to-one nearest pairs per patch, in the order of cells, without replacement.

    ``cells`` and ``rows`` have the keys, ``id``, x and y; ``match_id`` is null where no unused row lies
    within ``radius``; the lowest id wins ties; null places match nothing. Sequential by nature, but only among what is linked: a patch is
    parted into groups of adjoining squares of the radius that hold anything, between which no pair can be, and
    a call gets ``TOGETHER`` of them.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("id"), right.sort_values("id")
        rx, ry, rid = right.x.to_numpy(float), right.y.to_numpy(float), right.id.to_numpy()
        order = np.argsort(rx, kind="stable")
        used, out = np.zeros(len(rid), bool), []
        sorted_x = rx[order]
        for x, y in zip(left.x, left.y):
            near = np.sort(order[np.searchsorted(sorted_x, x - radius) : np.searchsorted(sorted_x, x + radius, "right")])
            near = near[~used[near]]
            d = np.hypot(rx[near] - x, ry[near] - y)
            at = int(d.argmin()) if len(d) else -1
            if at >= 0 and d[at] <= radius:
                used[near[at]] = True
                out.append(rid[near[at]])
            else:
                out.append(None)
        found = left[[*keys, "id"]].copy()
        found["match_id"] = pd.array(out, dtype="Int64")
        return found

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", id bigint, match_id bigint"
    at = {"__bx": F.coalesce(F.floor(F.col("x") / radius).cast("int"), F.lit(0)), "__by": F.coalesce(F.floor(F.col("y") / radius).cast("int"), F.lit(0))}
    a, b = (df.select(*keys, F.col("id").cast("bigint").alias("id"), "x", "y").withColumns(at) for df in (cells, rows))
    held = a.select(*keys, F.col("__bx").alias("x"), F.col("__by").alias("y")).union(b.select(*keys, "__bx", "__by")).distinct()
    parts = materialize(components(held, keys), "squares").select(*keys, F.col("x").alias("__bx"), F.col("y").alias("__by"), F.floor(F.col("label") / TOGETHER).alias("label"))
    # told to be shuffled: a row a square, in files so well compressed that the planner would broadcast all of them
    a, b = (df.join(parts.select(*[F.col(c).alias(c) for c in parts.columns]).hint("merge"), [*keys, "__bx", "__by"]).select(*keys, "label", "id", "x", "y") for df in (a, b))
    return a.groupBy(*keys, "label").cogroup(b.groupBy(*keys, "label")).applyInPandas(run, schema)


def point_in_raster(points: DataFrame, pixels: DataFrame, keys: Sequence[str], step: int = 1) -> DataFrame:
    """``hit``: the pixel at floor(point / step) is above 0; points off the raster do not hit."""
    at = points.withColumns({"__px": F.floor(F.col("x") / step), "__py": F.floor(F.col("y") / step)})
    on = pixels.where("v > 0").select(*keys, F.col("x").alias("__px"), F.col("y").alias("__py"), F.lit(True).alias("hit"))
    return at.join(on, [*keys, "__px", "__py"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("__px", "__py")
