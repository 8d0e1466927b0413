"""Reports over cell assignments: summaries, representative rows, confusion, marker choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores


def with_margin(df: DataFrame) -> DataFrame:
    """``final_margin`` (top minus second of p_final_*, null and NaN as 0) and ``confidence_score``."""
    p = [F.coalesce(F.nanvl(f"p_final_{c}", F.lit(None)), F.lit(0.0)) for c in scores.CLASSES]
    return df.withColumns({"final_margin": scores.margin(p), "confidence_score": scores.confidence_score(F.col("cell_type_confidence"))})


def patch_summary(df: DataFrame, keys: Sequence[str] = ("slide_id", "patch_id")) -> DataFrame:
    """Cells, mismatches, low confidence, mean score and margin, mismatch rate of each patch; a null patch is a group."""
    work = with_margin(df)
    wrong = F.coalesce(F.col("is_mismatch").cast("int"), F.lit(0))
    out = work.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.sum(wrong).alias("mismatch_count"), F.count_if(F.lower("cell_type_confidence") == "low").alias("low_confidence_count"), F.avg("confidence_score").alias("mean_confidence_score"), F.avg("final_margin").alias("mean_final_margin"))
    return out.withColumn("mismatch_rate", F.col("mismatch_count") / F.col("n_cells"))


def top_patches(summary: DataFrame, n: int, keys: Sequence[str] = ("slide_id", "patch_id")) -> DataFrame:
    """The ``n`` patches that most need a look: by mismatch rate, low confidence, cells, then key."""
    return summary.orderBy(F.desc("mismatch_rate"), F.desc("low_confidence_count"), F.desc("n_cells"), *keys).limit(n)


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], kind: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n").withColumn("example_kind", F.lit(kind))


def representatives(df: DataFrame, id_col: str, keys: Sequence[str] = ("cell_type",), patch: str = "patch_id") -> DataFrame:
    """Per class up to three rows: the best match, the least sure other, the best other mismatch.

    Best is by confidence, margin, then patch and id. Each pick leaves one row a class, so later picks
    exclude at most two ids a class by a join with as many rows as classes; ranks are limited within tasks
    before the shuffle.
    """
    work = with_margin(df.where(F.col(keys[0]).isNotNull()))
    tail = [F.asc(patch), F.asc(id_col)]
    best, least = [F.desc("confidence_score"), F.desc("final_margin"), *tail], [F.asc("confidence_score"), F.asc("final_margin"), *tail]
    match = _first(work.where("is_mismatch = false"), keys, best, "match")
    used = match.select(F.col(id_col).alias("__used"))
    ambiguous = _first(work.join(F.broadcast(used), F.col(id_col) == F.col("__used"), "left_anti"), keys, least, "ambiguous")
    used = used.unionByName(ambiguous.select(F.col(id_col).alias("__used")))
    wrong = _first(work.where("is_mismatch = true").join(F.broadcast(used), F.col(id_col) == F.col("__used"), "left_anti"), keys, best, "disagreement")
    return match.unionByName(ambiguous).unionByName(wrong)


def agree_medium_disagree(df: DataFrame, id_col: str) -> DataFrame:
    """Three rows by model margin: greatest and (another) least among agreeing, greatest among mismatching; ties by id."""
    work = df.withColumn("codex_margin", scores.class_margin(F.col("cell_type"), {c: F.col(f"p_model_{c}") for c in scores.CLASSES})).where("codex_margin is not null and not isnan(codex_margin)")

    def one(part: DataFrame, order: Column, kind: str) -> DataFrame:
        return part.orderBy(order, F.asc(id_col)).limit(1).withColumn("example_kind", F.lit(kind))

    same = work.where("is_mismatch = false")
    agree = one(same, F.desc("codex_margin"), "agree")
    medium = one(same.join(F.broadcast(agree.select(F.col(id_col).alias("__used"))), F.col(id_col) == F.col("__used"), "left_anti"), F.asc("codex_margin"), "medium")
    wrong = one(work.where("is_mismatch = true"), F.desc("codex_margin"), "disagree")
    return agree.unionByName(medium).unionByName(wrong)


def confusion(df: DataFrame, row: str, column: str) -> DataFrame:
    """Dense class-by-class counts and row shares (0 for an empty row)."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(a, b) for a in scores.CLASSES for b in scores.CLASSES], f"{row} string, {column} string")
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    dense = F.broadcast(domain).join(counts, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(row))
    return dense.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def class_panel(df: DataFrame, high: float = 0.5) -> DataFrame:
    """Per class: agreeing with margin from ``high``, agreeing below it, mismatching, and the mismatch rate."""
    margin = scores.class_margin(F.col("cell_type"), {c: F.coalesce(F.nanvl(f"p_model_{c}", F.lit(None)), F.lit(0.0)) for c in scores.CLASSES})
    wrong = F.coalesce("is_mismatch", F.lit(False))
    out = df.where(F.col("cell_type").isin(*scores.CLASSES)).withColumns({"__m": margin, "__w": wrong}).groupBy("cell_type")
    return out.agg(F.count("*").alias("n"), F.count_if(~F.col("__w") & (F.col("__m") >= high)).alias("agree"), F.count_if(~F.col("__w") & (F.col("__m") < high)).alias("medium"), F.count_if("__w").alias("disagree"), (F.count_if("__w") / F.count("*")).alias("mismatch_rate"))


def best_marker(long: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Per group the marker whose class medians spread most; ties to the smaller name. Null labels and values do not count."""
    medians = long.where(F.col(label).isNotNull() & F.col("value").isNotNull()).groupBy(*group, "marker", label).agg(F.median("value").alias("m"))
    spread = medians.groupBy(*group, "marker").agg((F.max("m") - F.min("m")).alias("spread"))
    pick = F.min(F.struct((-F.col("spread")).alias("s"), "marker"))
    return spread.groupBy(*group).agg(pick.alias("p")).select(*group, F.col("p.marker").alias("marker"), (-F.col("p.s")).alias("spread"))
