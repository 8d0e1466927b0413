"""The N best items of every group, by descending score bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import HOT_KEYS, SMALL_ROWS
from tessera.sources.tables import materialize, scratch

#: Pieces by item into which a group's rows of a band are spread.
SALTS = 16


def band_edges(scored: DataFrame, score: str, bands: int) -> list[float]:
    """Falling lower edges of all bands but the last; each band holds about four times as many rows as the one above."""
    shares = [1 - 4.0 ** (i - bands + 1) for i in range(bands - 1)]
    found = scored.agg(F.percentile_approx(score, F.array(*[F.lit(s) for s in shares]), F.lit(1000))).first()[0] if shares else []
    return sorted(set(found or []), reverse=True)


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def _without(df: DataFrame, groups: DataFrame, group: Sequence[str]) -> DataFrame:
    named = groups.select(*[F.col(c).alias(f"__f_{c}") for c in group])
    return df.join(named, [F.col(c).eqNullSafe(F.col(f"__f_{c}")) for c in group], "left_anti")


def _unfilled(band: DataFrame, filled: DataFrame, group: Sequence[str], small_rows: int) -> DataFrame:
    """``band`` (with __salt) without the filled groups: by broadcast if these are few, else only the band's hot ones so, and the others by a salted join.

    Beyond ``small_rows`` the filled groups are told to be shuffled: their table is compressed and copied ``SALTS`` times when
    read, so the planner, which goes by the size of its files, would broadcast what doesn't fit the driver.
    """
    if filled.count() <= small_rows:
        return _without(band, F.broadcast(filled), group)
    sizes = materialize(band.groupBy(*group).agg(F.count("*").alias("__rows")), "sizes")
    total = sizes.agg(F.sum("__rows")).first()[0] or 0
    hot = sizes.where(F.col("__rows") * HOT_KEYS > total)  # fewer than HOT_KEYS groups
    named = filled.select(*[F.col(c).alias(f"__f_{c}") for c in group]).hint("merge")
    hot = hot.join(named, [F.col(c).eqNullSafe(F.col(f"__f_{c}")) for c in group], "left_semi")
    spread = filled.select(*group, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")).hint("merge")
    return _without(_without(band, F.broadcast(hot), group), spread, [*group, "__salt"])


def top_n(df: DataFrame, group: Sequence[str], item: str, score: Column, order: Sequence[Column], n: int, bands: int = 3, small_rows: int = SMALL_ROWS) -> DataFrame:
    """The first ``n`` distinct items of each group, with ``group_rank`` from 1.

    ``score`` is a numeric column, higher is better, that never contradicts ``order`` (it may tie where
    ``order`` does not); null and NaN go last. ``order`` must end the ties. An item counts once per group,
    by its best row; null group keys form a group, null items are one item. An empty table gives an empty
    table; further columns of ``df`` are kept.

    One pass finds the bands' edges, a second writes the rows as a table partitioned by ranges of the score, a folder a
    band, without a shuffle. The bands are then read from the top, each once. Groups that the bands above have
    filled are anti-joined away before anything of a band is shuffled or, where there are too many to
    broadcast, in the shuffle that also brings together the rows of an item. That shuffle is by group and a
    salt of the item, so a group that holds a large part of a band is spread over ``SALTS`` tasks. What is
    left is ranked exactly; each task keeps at most ``n`` rows a group before the rows of a group meet, so a
    band leaves at most ``n`` rows a group.
    """
    names = df.columns
    scored = df.withColumn("__score", F.coalesce(F.nanvl(score.cast("double"), F.lit(None)), F.lit(float("-inf"))))
    edges = band_edges(scored, "__score", bands)
    band = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        band = F.when(F.col("__score") >= edge, i).otherwise(band)
    path = scratch(df.sparkSession, "bands")
    salt = F.pmod(F.xxhash64(F.col(f"`{item}`")), F.lit(SALTS))
    ready = scored.withColumn("__band", band).drop("__score")
    ready.write.option("compression", "zstd").partitionBy("__band").parquet(path)
    table = df.sparkSession.read.schema(ready.schema).parquet(path)
    taken: DataFrame | None = None
    for i in range(len(edges) + 1):
        rows = table.where(F.col("__band") == i).select(*names).withColumn("__salt", salt)
        if taken is not None:
            held = _first(taken, [*group, item], order, 1, "__r").groupBy(*group).agg(F.count("*").alias("__n"))
            rows = _unfilled(rows, materialize(held.where(F.col("__n") >= n).select(*group), "filled"), group, small_rows)
        best = _first(rows, [*group, "__salt", item], order, 1, "__r").select(*names)
        piece = materialize(_first(best, group, order, n, "__r").select(*names), "band")
        taken = piece if taken is None else taken.unionByName(piece)
    once = _first(taken, [*group, item], order, 1, "__r").select(*names)
    return _first(once, group, order, n, "group_rank")
