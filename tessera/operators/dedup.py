"""First-of-key and duplicate detection that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import attach
from tessera.sources.tables import materialize


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt_on: Sequence[str], salts: int = 32) -> DataFrame:
    """One row for each value of ``keys``: the first by ``order``; null keys form one group.

    A key that holds a large part of all rows is ranked in ``salts`` pieces chosen by ``salt_on``; the at
    most ``salts`` heads of a key are then ranked once more. Ties beyond ``order`` are the caller's to rule
    out; an empty table gives an empty table.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    heads = salted.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))).where("__n = 1")
    return heads.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n", "__salt")


def later_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that come, by the columns ``order`` ascending, behind the first row of their key; null keys form one group.

    Rows that tie with the first are first too. Firsts are found by partial minima, so a key that holds a large
    part of all rows costs one row a task there, and only keys with several rows are joined back (``attach``).
    ``df`` is read twice: give it materialized. An empty table gives an empty table.
    """
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    return attach(df, materialize(firsts, "firsts"), keys, "__n").where(F.struct(*order) > F.col("__first")).drop("__first")


def ordinals(df: DataFrame, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 1 in a total order, without bringing them into one task.

    Rows are range-partitioned and sorted; each task numbers its own, and a table of one row a partition
    says where it begins. Ties beyond ``order`` get different numbers; an empty table stays empty.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(sorted_.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "sorted")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    ends = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = ends.withColumn("__start", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__start")
    return numbered.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + within + 1).drop("__part", "__id", "__start")
