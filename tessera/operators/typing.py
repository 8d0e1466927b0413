"""Cell typing: marker ranks, classifiers, fusion with the segmentation prior, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators.joins import attach
from tessera.sources.tables import materialize


def long_form(df: DataFrame, keys: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """(keys, marker, value) from one column per marker; NaN becomes null."""
    out = df.select(*keys, *[F.nanvl(F.col(f"`{m}`").cast("double"), F.lit(None)).alias(m) for m in markers])
    return out.unpivot(list(keys), list(markers), "marker", "value")


def rank_share(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """``share``: average rank of a value among the group's, divided by their number.

    Null has 0; groups with at most one value have 0.5 throughout. Works on value counts: rows are counted
    per distinct value before the shuffle, only distinct values are sorted, and a value that many rows have is
    broadcast back to them. ``long`` is read several times.
    """
    by = Window.partitionBy(*group).orderBy("value")
    counts = long.where("value is not null").groupBy(*group, "value").agg(F.count("*").alias("__n"))
    ranked = counts.withColumns({"__upto": F.sum("__n").over(by), "__all": F.sum("__n").over(Window.partitionBy(*group))})
    share = F.when(F.col("__all") <= 1, 0.5).otherwise((F.col("__upto") - (F.col("__n") - 1) / 2) / F.col("__all"))
    rated = materialize(ranked.select(*group, "value", share.alias("share"), "__n", "__all"), "ranks")
    few = rated.where("__all > 1").select(*group, F.lit(0.0).alias("__null")).distinct()
    with_share = attach(long, rated.drop("__all"), [*group, "value"], "__n", "left")
    return with_share.join(few, list(group), "left").withColumn("share", F.coalesce("share", "__null", F.lit(0.5))).drop("__null")


def wide_form(long: DataFrame, keys: Sequence[str], markers: Sequence[str], value: str) -> DataFrame:
    """One row per key again, a column per marker."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("marker") == m, F.col(value))).alias(m) for m in markers])


RULE_MARKERS = ("CD163", "CD20", "CD31", "CD3e", "CD4", "CD45", "CD45RO", "CD68", "CD8a", "Ecadherin", "FOXP3", "PD1", "PanCK", "SMA")


def rule_probabilities(df: DataFrame, keys: Sequence[str], slide: str) -> DataFrame:
    """(keys, p_model_*) from marker ranks within the slide."""
    ranks = rank_share(long_form(df, keys, RULE_MARKERS), [slide, "marker"])
    wide = wide_form(ranks, keys, RULE_MARKERS, "share")
    probs = scores.rule_scores({m: F.coalesce(F.col(m), F.lit(0.0)) for m in RULE_MARKERS})
    return wide.select(*keys, *[probs[c].alias(f"p_model_{c}") for c in scores.CLASSES])


def fuse(matched: DataFrame) -> DataFrame:
    """Final class, confidence and state of cells matched to feature rows.

    Needs type_cellvit, match_id, p_model_*, Ki67 and ki67_threshold. Unmatched cells (null match_id) have
    the prior's class, low confidence, model types ``unmatched``, no mismatch and model probabilities 0. The fine
    model type is the feature row's where it has one, else the model type.
    """
    kind, hit = F.coalesce("type_cellvit", F.lit(0)), F.col("match_id").isNotNull()
    model = {c: F.when(hit, F.coalesce(F.nanvl(f"p_model_{c}", F.lit(None)), F.lit(0.0))).otherwise(0.0) for c in scores.CLASSES}
    first = scores.prior(kind)
    mixed = scores.fuse(kind, model)
    out = matched.withColumns({f"p_model_{c}": model[c] for c in scores.CLASSES} | {"__prior": scores.argmax_class(first)})
    out = out.withColumns({f"p_final_{c}": F.when(hit, mixed[c]).otherwise(first[c]) for c in scores.CLASSES})
    final = {c: F.col(f"p_final_{c}") for c in scores.CLASSES}
    out = out.withColumns({"type_codex": F.when(hit, scores.argmax_class({c: F.col(f"p_model_{c}") for c in scores.CLASSES})).otherwise("unmatched"), "cell_type": scores.argmax_class(final)})
    fine = F.col("type_codex_fine") if "type_codex_fine" in matched.columns else F.lit(None).cast("string")
    out = out.withColumn("type_codex_fine", F.when(hit, F.coalesce(fine, "type_codex")).otherwise("unmatched"))
    out = out.withColumn("is_mismatch", F.when(hit, F.col("type_codex") != F.col("__prior")).otherwise(False))
    sure = scores.confidence(scores.margin([final[c] for c in scores.CLASSES]), F.col("is_mismatch"))
    ki67 = F.coalesce(F.nanvl("Ki67", F.lit(None)), F.lit(0.0))
    out = out.withColumns({"cell_type_confidence": F.when(hit, sure).otherwise("low"), "cell_state": F.when(hit, scores.state(kind, ki67, F.coalesce("ki67_threshold", F.lit(float("inf"))))).otherwise(F.when(kind == scores.DEAD_CLASS, "dead").otherwise("quiescent"))})
    return out.withColumnRenamed("__prior", "type_cellvit_prior")


def standardise(long: DataFrame, group: Sequence[str], floor: float = 0.05, tail: float = 0.01, eps: float = 1e-6) -> DataFrame:
    """``z``: values (null as 0, at least 0) minus the group's p5, winsorised to p1..p99, as z-scores.

    A deviation of at most ``eps`` divides by 1. Percentiles are exact; each pass aggregates before its
    shuffle and comes back as one row a group.
    """
    base = long.withColumn("__v", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))
    low = base.groupBy(*group).agg(F.percentile("__v", F.lit(floor)).alias("__floor"))
    lifted = base.join(low, list(group)).withColumn("__v", F.greatest(F.col("__v") - F.col("__floor"), F.lit(0.0)))
    ends = lifted.groupBy(*group).agg(F.percentile("__v", F.array(F.lit(tail), F.lit(1 - tail))).alias("__ends"))
    cut = lifted.join(ends, list(group)).withColumn("__v", F.least(F.greatest("__v", F.col("__ends")[0]), F.col("__ends")[1]))
    moments = cut.groupBy(*group).agg(F.avg("__v").alias("__mean"), F.stddev_pop("__v").alias("__sd"))
    z = (F.col("__v") - F.col("__mean")) / F.when(F.col("__sd") <= eps, 1.0).otherwise(F.col("__sd"))
    return cut.join(moments, list(group)).withColumn("z", z).drop("__v", "__floor", "__ends", "__mean", "__sd")


def assign_clusters(points: DataFrame, centers: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``cluster_id`` of the nearest centre; ties to the lower id. ``centers`` is at most a few rows (k)."""
    k = F.broadcast(centers.select(F.collect_list(F.struct("cluster_id", *dims)).alias("__c")))
    spread = lambda c: sum(((c[d] - F.col(d)) ** 2 for d in dims[1:]), (c[dims[0]] - F.col(dims[0])) ** 2)
    near = F.array_min(F.transform("__c", lambda c: F.struct(spread(c).alias("d2"), c["cluster_id"].alias("id"))))
    return points.join(k).withColumn("cluster_id", near["id"]).drop("__c")


def lloyd_step(points: DataFrame, centers: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The centres after one step: means of the points nearest to each; an empty cluster keeps its centre."""
    moved = assign_clusters(points, centers, dims).groupBy("cluster_id").agg(*[F.avg(d).alias(f"__{d}") for d in dims])
    return centers.join(moved, "cluster_id", "left").select("cluster_id", *[F.coalesce(f"__{d}", d).alias(d) for d in dims])


def kmeans_centers(points: DataFrame, dims: Sequence[str], k: int, seeds: int = 20) -> DataFrame:
    """Centres of the best of ``seeds`` k-means runs by training cost; k is at most the number of points, no points give no centres."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    schema = "cluster_id int, " + ", ".join(f"`{d}` double" for d in dims)
    points = materialize(points.select(*dims), "points")
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], schema)
    data = VectorAssembler(inputCols=list(dims), outputCol="__f").transform(points).select("__f")
    fit = inheritable_thread_target(points.sparkSession)(lambda s: KMeans(k=k, seed=s, featuresCol="__f").fit(data))
    with ThreadPool(4) as runs:  # Spark jobs side by side, as a search over parameters runs them
        best = min(runs.imap(fit, range(seeds)), key=lambda m: m.summary.trainingCost)
    return points.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(best.clusterCenters())], schema)


def assignment_record(fused: DataFrame, x0: Column, y0: Column) -> DataFrame:
    """The analysis-ready row of each cell of ``fuse``: the patch's origin, local and global centroids and the match, beside what is there.

    ``x`` and ``y`` are the cell's place on the slide; a cell without a match has no distance.
    """
    at = {"patch_x0": x0.cast("int"), "patch_y0": y0.cast("int"), "centroid_x_global": F.col("x").cast("double"), "centroid_y_global": F.col("y").cast("double"), "centroid_x_local": (F.col("x") - x0).cast("double"), "centroid_y_local": (F.col("y") - y0).cast("double")}
    return fused.withColumns(at).withColumnRenamed("distance", "match_distance")
