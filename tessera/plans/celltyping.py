"""Queries of cell matching, typing and state, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators import matching, reports, typing
from tessera.plans.fixtures import CELLS_SQL, FEATURES_SQL, MARKERS, cells, features
from tessera.sources.tables import table

RADIUS = 6.0


def r6(c) -> Column:
    return F.round(c, 6)


def nn_match(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their nearest feature row within the radius; unmatched cells are left out."""
    m = matching.nearest(cells(spark, d), features(spark, d), ["slide_no"], RADIUS, "row_idx")
    return m.where("match_id is not null").select("slide_no", "cell_id", "match_id", r6(F.col("distance")).alias("distance"))


def nn_unmatched_count(spark: SparkSession, d: str) -> DataFrame:
    """Cells and unmatched cells per slide and patch."""
    m = matching.nearest(cells(spark, d), features(spark, d), ["slide_no"], RADIUS, "row_idx")
    return m.groupBy("slide_no", "patch_id").agg(F.count("*").alias("n_cells"), F.count_if(F.col("match_id").isNull()).alias("n_unmatched"))


def rank_pct(spark: SparkSession, d: str) -> DataFrame:
    """Rank share of every marker value within its slide."""
    long = typing.long_form(features(spark, d), ["slide_no", "row_idx"], list(MARKERS))
    return typing.rank_share(long, ["slide_no", "marker"]).select("slide_no", "row_idx", "marker", r6(F.col("share")).alias("share"))


def rule_probs(spark: SparkSession, d: str) -> DataFrame:
    """Class probabilities of each feature row by the rule classifier."""
    p = typing.rule_probabilities(features(spark, d), ["slide_no", "row_idx"], "slide_no")
    return p.select("slide_no", "row_idx", *[r6(F.col(f"p_model_{c}")).alias(f"p_model_{c}") for c in scores.CLASSES])


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """The assignment pipeline: match, classify, fuse, confidence and state of every cell."""
    feats = features(spark, d)
    probs = typing.rule_probabilities(feats, ["slide_no", "row_idx"], "slide_no")
    limit = feats.groupBy("slide_no").agg(F.percentile("Ki67", F.lit(0.75)).alias("ki67_threshold"))
    rows = feats.select("slide_no", F.col("row_idx").alias("match_id"), "Ki67").join(probs.withColumnRenamed("row_idx", "match_id"), ["slide_no", "match_id"]).join(limit, "slide_no")
    matched = matching.nearest(cells(spark, d), feats, ["slide_no"], RADIUS, "row_idx")
    return typing.fuse(matched.join(rows, ["slide_no", "match_id"], "left"))


def fused_type(spark: SparkSession, d: str) -> DataFrame:
    """Class, mismatch, confidence, state and fused probabilities of each cell."""
    return assigned(spark, d).select("cell_id", "cell_type", "type_codex", "type_cellvit_prior", "is_mismatch", "cell_type_confidence", "cell_state", *[r6(F.col(f"p_final_{c}")).alias(f"p_final_{c}") for c in scores.CLASSES])


def assignment_record(spark: SparkSession, d: str) -> DataFrame:
    """The assignment table's row of each cell: patch origin, centroids, match and fine model type."""
    x0, y0 = (F.split("patch_id", "_")[i].cast("int") for i in (0, 1))
    a = typing.assignment_record(assigned(spark, d), x0, y0)
    return a.select("cell_id", "patch_id", "patch_x0", "patch_y0", "type_cellvit_prior", "type_codex", "type_codex_fine", "centroid_x_local", "centroid_y_local", "centroid_x_global", "centroid_y_global", r6(F.col("match_distance")).alias("match_distance"))


def assigned_patch_summary(spark: SparkSession, d: str) -> DataFrame:
    """The patch summary of the assignment pipeline, end to end."""
    s = reports.patch_summary(assigned(spark, d), ["slide_no", "patch_id"])
    return s.select("slide_no", "patch_id", "n_cells", "mismatch_count", "low_confidence_count", *[r6(F.col(c)).alias(c) for c in ("mean_confidence_score", "mean_final_margin", "mismatch_rate")])


def confidence_census(spark: SparkSession, d: str) -> DataFrame:
    """Cells by class and confidence."""
    return assigned(spark, d).groupBy("cell_type", "cell_type_confidence").agg(F.count("*").alias("n"))


def state_census(spark: SparkSession, d: str) -> DataFrame:
    """Cells by slide and state."""
    return assigned(spark, d).groupBy("slide_no", "cell_state").agg(F.count("*").alias("n"))


def assignment_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary document: nested counters per slide as one JSON object each."""
    a = assigned(spark, d)
    counts = a.groupBy("slide_no", "cell_type").agg(F.count("*").alias("n")).groupBy("slide_no").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell_type", "n"))))).alias("type_counts"))
    rate = a.groupBy("slide_no").agg(F.count("*").alias("n_cells"), r6(F.count_if("is_mismatch") / F.count("*")).alias("mismatch_rate"))
    return rate.join(counts, "slide_no")


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mismatching cells by model and prior class."""
    a = assigned(spark, d).where("is_mismatch")
    return a.groupBy(F.concat(F.lit("model="), "type_codex", F.lit(",cellvit="), "type_cellvit_prior").alias("conflict")).agg(F.count("*").alias("n"))


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows under the older scheme's markers, with thresholds per slide; the stand-ins have no Vimentin and PCNA, so other markers stand for them."""
    f = features(spark, d).select("slide_no", "row_idx", (F.col("row_idx") % 6).cast("int").alias("type_cellvit"), "Ki67", F.col("CD68").alias("PCNA"), F.col("SMA").alias("Vimentin"), F.col("PanCK").alias("Keratin"), "Ecadherin", "CD45", "CD4", F.col("CD31").alias("CD31"))
    p = f.groupBy("slide_no").agg(*[F.percentile(m, F.lit(0.95)).alias(f"t_{m}") for m in ("Ki67", "PCNA", "Vimentin", "Keratin", "CD45", "CD4", "CD31")], F.percentile("Ecadherin", F.lit(0.25)).alias("t_Ecadherin"), F.percentile("Ecadherin", F.lit(0.5)).alias("t_Ecadherin_high"))
    return f.join(p, "slide_no")


def legacy_state(spark: SparkSession, d: str) -> DataFrame:
    """States of the older scheme, counted per slide."""
    f = _legacy(spark, d)
    value = {m: F.col(m) for m in ("Ki67", "PCNA", "Vimentin", "Keratin", "Ecadherin")}
    limit = {m: F.col(f"t_{m}") for m in (*value, "Ecadherin_high")}
    return f.groupBy("slide_no", scores.legacy_state(F.col("type_cellvit"), value, limit).alias("state")).agg(F.count("*").alias("n"))


def legacy_type(spark: SparkSession, d: str) -> DataFrame:
    """Types of the older scheme, counted per slide."""
    names = ("Keratin", "CD45", "CD4", "CD31")
    return _legacy(spark, d).groupBy("slide_no", scores.legacy_type({m: F.col(m) for m in names}, {m: F.col(f"t_{m}") for m in names}).alias("type")).agg(F.count("*").alias("n"))


def winsor_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Background-subtracted, winsorised z-scores of every marker per slide."""
    long = typing.long_form(features(spark, d), ["slide_no", "row_idx"], list(MARKERS))
    return typing.standardise(long, ["slide_no", "marker"]).select("slide_no", "row_idx", "marker", r6(F.col("z")).alias("z"))


DIMS = ("PanCK", "Ecadherin", "CD45", "SMA")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(m) for i, m in enumerate(MARKERS)])


def _label_centers(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).groupBy(F.col("label").cast("int").alias("cluster_id")).agg(*[F.avg(m).alias(m) for m in MARKERS])


def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    """Signature scores of the clusters given by the vectors' labels."""
    s = scores.signature_scores({m: F.col(m) for m in MARKERS})
    return _label_centers(spark, d).select("cluster_id", *[r6(v).alias(k) for k, v in s.items()])


def softmax_types(spark: SparkSession, d: str) -> DataFrame:
    """Class probabilities of those clusters: softmax of the scores, collapsed."""
    s = scores.signature_scores({m: F.col(m) for m in MARKERS})
    base = _label_centers(spark, d).select("cluster_id", *[v.alias(k) for k, v in s.items()])
    soft = base.select("cluster_id", *[v.alias(k) for k, v in scores.softmax({k: F.col(k) for k in s}).items()])
    return soft.select("cluster_id", *[r6(v).alias(f"p_{k}") for k, v in scores.collapse({k: F.col(k) for k in s}).items()])


def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    """Centres after one k-means step from the label means."""
    c = typing.lloyd_step(_vectors(spark, d), _label_centers(spark, d), list(MARKERS))
    return c.select("cluster_id", *[r6(F.col(m)).alias(m) for m in MARKERS])


def kmeans_types(spark: SparkSession, d: str) -> DataFrame:
    """Class probabilities of every vector by clustering, annotation and mapping back."""
    v = _vectors(spark, d)
    centers = typing.kmeans_centers(v, list(MARKERS), len(scores.SIGNATURES))
    s = scores.signature_scores({m: F.col(m) for m in MARKERS})
    base = centers.select("cluster_id", *[x.alias(k) for k, x in s.items()])
    soft = base.select("cluster_id", *[x.alias(k) for k, x in scores.softmax({k: F.col(k) for k in s}).items()])
    named = soft.select("cluster_id", *[x.alias(f"p_model_{k}") for k, x in scores.collapse({k: F.col(k) for k in s}).items()])
    return typing.assign_clusters(v, centers, list(MARKERS)).select("vec_id", "cluster_id").join(F.broadcast(named), "cluster_id")


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one pairs of cells and feature rows per patch, in cell order."""
    keys = ["slide_no", "patch_id"]
    f = features(spark, d).withColumn("patch_id", F.concat_ws("_", F.col("x") - F.col("x") % 256, F.col("y") - F.col("y") % 256))
    return matching.greedy_pairs(cells(spark, d).withColumnRenamed("cell_id", "id"), f.withColumnRenamed("row_idx", "id"), keys, RADIUS)


def marker_long(spark: SparkSession, d: str) -> DataFrame:
    """Markers of cell_assignments in long form; NaN is null."""
    return typing.long_form(table(spark, d, "cell_assignments"), ["row_id"], ["pan_ck", "cd45", "sma", "ki67"])


_RANKS = [f"CASE WHEN count(*) OVER s <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY slide_no ORDER BY {m}) + (count(*) OVER (PARTITION BY slide_no, {m}) - 1) / 2.0) / count(*) OVER s END AS {m}" for m in typing.RULE_MARKERS]
_RULE_SQL = (
    "WITH " + CELLS_SQL + ", " + FEATURES_SQL + ", r AS (SELECT slide_no, row_idx, " + ", ".join(_RANKS) + " FROM features WINDOW s AS (PARTITION BY slide_no)), "
    "t AS (SELECT slide_no, row_idx, 0.55*CD45 + 0.30*(CD3e+CD4+CD8a+CD45RO+FOXP3+PD1)/6 + 0.15*(CD20+CD68+CD163)/3 AS i, 0.55*PanCK + 0.25*Ecadherin + 0.20*(1-CD45) AS c, 0.60*(SMA+CD31)/2 + 0.40*((1-PanCK)+(1-CD45))/2 AS h FROM r), "
    "probs AS (SELECT slide_no, row_idx, greatest(c,0)/s AS pc, greatest(i,0)/s AS pi, greatest(h,0)/s AS ph FROM (SELECT *, CASE WHEN greatest(c,0)+greatest(i,0)+greatest(h,0) > 0 THEN greatest(c,0)+greatest(i,0)+greatest(h,0) ELSE 1 END AS s FROM t)), "
    "nn AS (SELECT c.cell_id, c.slide_no, c.patch_id, c.type_cellvit, f.row_idx AS match_id, sqrt((c.x-f.x)**2 + (c.y-f.y)**2) AS distance FROM cells c LEFT JOIN features f "
    "ON c.slide_no = f.slide_no AND f.x BETWEEN c.x-6 AND c.x+6 AND f.y BETWEEN c.y-6 AND c.y+6 AND (c.x-f.x)**2 + (c.y-f.y)**2 <= 36 "
    "QUALIFY row_number() OVER (PARTITION BY c.cell_id ORDER BY (c.x-f.x)**2 + (c.y-f.y)**2, f.row_idx) = 1), "
    "lim AS (SELECT slide_no, quantile_cont(Ki67, 0.75) AS thr FROM features GROUP BY slide_no), "
    "j AS (SELECT nn.*, pc, pi, ph, f.Ki67, thr, CASE type_cellvit WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 5 THEN 0.5 ELSE 1.0/3 END AS qc, CASE type_cellvit WHEN 2 THEN 1.0 WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 WHEN 5 THEN 0.0 ELSE 1.0/3 END AS qi, "
    "CASE type_cellvit WHEN 3 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 5 THEN 0.5 ELSE 1.0/3 END AS qh, CASE type_cellvit WHEN 1 THEN 0.3 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.5 END AS w "
    "FROM nn LEFT JOIN probs ON nn.slide_no = probs.slide_no AND nn.match_id = probs.row_idx LEFT JOIN features f ON nn.slide_no = f.slide_no AND nn.match_id = f.row_idx LEFT JOIN lim ON nn.slide_no = lim.slide_no), "
    "k AS (SELECT *, match_id IS NULL OR greatest(pc, pi, ph) < 0.4 AS alone FROM j), "
    "m AS (SELECT *, CASE WHEN alone THEN qc ELSE w*pc+(1-w)*qc END AS fc, CASE WHEN alone THEN qi ELSE w*pi+(1-w)*qi END AS fi, CASE WHEN alone THEN qh ELSE w*ph+(1-w)*qh END AS fh, "
    "CASE WHEN match_id IS NULL THEN 'unmatched' WHEN pc>=pi AND pc>=ph THEN 'cancer' WHEN pi>=ph THEN 'immune' ELSE 'healthy' END AS type_codex, CASE WHEN qc>=qi AND qc>=qh THEN 'cancer' WHEN qi>=qh THEN 'immune' ELSE 'healthy' END AS type_cellvit_prior FROM k), "
    "n AS (SELECT *, CASE WHEN fc>=fi AND fc>=fh THEN 'cancer' WHEN fi>=fh THEN 'immune' ELSE 'healthy' END AS cell_type, match_id IS NOT NULL AND type_codex <> type_cellvit_prior AS is_mismatch, "
    "list_reverse_sort([fc, fi, fh])[1] - list_reverse_sort([fc, fi, fh])[2] AS gap FROM m), "
    "a AS (SELECT *, CASE WHEN match_id IS NULL THEN 'low' WHEN gap >= 0.25 THEN CASE WHEN is_mismatch THEN 'medium' ELSE 'high' END WHEN gap >= 0.12 THEN CASE WHEN is_mismatch THEN 'low' ELSE 'medium' END ELSE 'low' END AS cell_type_confidence, "
    "CASE WHEN type_cellvit = 4 THEN 'dead' WHEN match_id IS NOT NULL AND Ki67 >= thr THEN 'proliferative' ELSE 'quiescent' END AS cell_state FROM n) "
)
_LEGACY_SQL = (
    "WITH " + FEATURES_SQL + ", f AS (SELECT slide_no, row_idx, (row_idx % 6)::INT AS t, Ki67, CD68 AS PCNA, SMA AS Vimentin, PanCK AS Keratin, Ecadherin, CD45, CD4, CD31 FROM features), "
    "p AS (SELECT slide_no, " + ", ".join(f"quantile_cont({m}, 0.95) AS t_{m}" for m in ("Ki67", "PCNA", "Vimentin", "Keratin", "CD45", "CD4", "CD31")) + ", quantile_cont(Ecadherin, 0.25) AS el, quantile_cont(Ecadherin, 0.5) AS eh FROM f GROUP BY slide_no) "
)
_CENTERS_SQL = "WITH v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {m}" for i, m in enumerate(MARKERS)) + " FROM embeddings), c AS (SELECT label::INT AS cluster_id, " + ", ".join(f"avg({m}) AS {m}" for m in MARKERS) + " FROM v GROUP BY label) "


def _signature_sql() -> str:
    out = []
    for name, markers in scores.SIGNATURES.items():
        own = [m for m in markers if m in MARKERS]
        rest = [m for m in MARKERS if m not in own]
        out.append(f"({' + '.join(own)}) / {len(own)} - 0.35 * ({' + '.join(f'greatest({m}, 0)' for m in rest)}) / {len(rest)} AS {name}")
    return ", ".join(out)


_FINE = list(scores.SIGNATURES)
_SOFT_SQL = _CENTERS_SQL + ", s AS (SELECT cluster_id, " + _signature_sql() + " FROM c), e AS (SELECT cluster_id, " + ", ".join(f"exp(({f} - greatest({', '.join(_FINE)})) / 0.75) AS {f}" for f in _FINE) + " FROM s), q AS (SELECT cluster_id, epithelial AS c, 0.2*(cd4_t+cd8_t+treg+b_cell+macrophage) AS i, 0.5*(endothelial+sma_stromal) AS h FROM e) "
_Z_SQL = (
    "WITH " + FEATURES_SQL + ", l AS (SELECT slide_no, row_idx, unnest([" + ", ".join(f"'{m}'" for m in MARKERS) + "]) AS marker, unnest([" + ", ".join(MARKERS) + "]) AS v FROM features), "
    "b AS (SELECT slide_no, marker, quantile_cont(greatest(v, 0), 0.05) AS lo FROM l GROUP BY ALL), u AS (SELECT l.slide_no, row_idx, l.marker, greatest(v - lo, 0) AS v FROM l JOIN b ON l.slide_no = b.slide_no AND l.marker = b.marker), "
    "e AS (SELECT slide_no, marker, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS z FROM u GROUP BY ALL), w AS (SELECT u.slide_no, row_idx, u.marker, least(greatest(v, a), z) AS v FROM u JOIN e ON u.slide_no = e.slide_no AND u.marker = e.marker), "
    "s AS (SELECT slide_no, marker, avg(v) AS m, stddev_pop(v) AS sd FROM w GROUP BY ALL) SELECT w.slide_no, row_idx, w.marker, round((v - m) / CASE WHEN sd <= 1e-6 THEN 1 ELSE sd END, 6) AS z FROM w JOIN s ON w.slide_no = s.slide_no AND w.marker = s.marker"
)

QUERIES = {f.__name__: f for f in (nn_match, nn_unmatched_count, rank_pct, rule_probs, fused_type, assignment_record, assigned_patch_summary, confidence_census, state_census, assignment_summary, conflict_pairs, legacy_state, legacy_type, winsor_zscore, cluster_scores, softmax_types, lloyd_step, kmeans_types, greedy_match, marker_long)}
ORACLE = {
    "nn_match": _RULE_SQL + "SELECT slide_no, cell_id, match_id, round(distance, 6) AS distance FROM a WHERE match_id IS NOT NULL",
    "nn_unmatched_count": _RULE_SQL + "SELECT slide_no, patch_id, count(*) AS n_cells, count(*) FILTER (WHERE match_id IS NULL) AS n_unmatched FROM a GROUP BY ALL",
    "rank_pct": "WITH " + FEATURES_SQL + ", l AS (SELECT slide_no, row_idx, unnest([" + ", ".join(f"'{m}'" for m in MARKERS) + "]) AS marker, unnest([" + ", ".join(MARKERS) + "]) AS v FROM features) SELECT slide_no, row_idx, marker, round((rank() OVER (PARTITION BY slide_no, marker ORDER BY v) + (count(*) OVER (PARTITION BY slide_no, marker, v) - 1) / 2.0) / count(*) OVER (PARTITION BY slide_no, marker), 6) AS share FROM l",
    "rule_probs": _RULE_SQL + "SELECT slide_no, row_idx, round(pc, 6) AS p_model_cancer, round(pi, 6) AS p_model_immune, round(ph, 6) AS p_model_healthy FROM probs",
    "fused_type": _RULE_SQL + "SELECT cell_id, cell_type, type_codex, type_cellvit_prior, is_mismatch, cell_type_confidence, cell_state, round(fc, 6) AS p_final_cancer, round(fi, 6) AS p_final_immune, round(fh, 6) AS p_final_healthy FROM a",
    "assignment_record": _RULE_SQL + "SELECT a.cell_id, a.patch_id, (c.x - c.x % 256)::INT AS patch_x0, (c.y - c.y % 256)::INT AS patch_y0, type_cellvit_prior, type_codex, type_codex AS type_codex_fine, (c.x % 256)::DOUBLE AS centroid_x_local, (c.y % 256)::DOUBLE AS centroid_y_local, c.x::DOUBLE AS centroid_x_global, c.y::DOUBLE AS centroid_y_global, round(distance, 6) AS match_distance FROM a JOIN cells c USING (cell_id)",
    "assigned_patch_summary": _RULE_SQL + "SELECT slide_no, patch_id, count(*) AS n_cells, sum(is_mismatch::INT)::BIGINT AS mismatch_count, count(*) FILTER (WHERE cell_type_confidence = 'low') AS low_confidence_count, round(avg(CASE cell_type_confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END), 6) AS mean_confidence_score, round(avg(gap), 6) AS mean_final_margin, round(avg(is_mismatch::INT), 6) AS mismatch_rate FROM a GROUP BY slide_no, patch_id",
    "confidence_census": _RULE_SQL + "SELECT cell_type, cell_type_confidence, count(*) AS n FROM a GROUP BY ALL",
    "state_census": _RULE_SQL + "SELECT slide_no, cell_state, count(*) AS n FROM a GROUP BY ALL",
    "assignment_summary": _RULE_SQL + "SELECT slide_no, count(*) AS n_cells, round(avg(is_mismatch::INT), 6) AS mismatch_rate, '{' || (SELECT string_agg('\"' || cell_type || '\":' || n, ',' ORDER BY cell_type) FROM (SELECT cell_type, count(*) AS n FROM a b WHERE b.slide_no = a.slide_no GROUP BY cell_type)) || '}' AS type_counts FROM a GROUP BY slide_no",
    "conflict_pairs": _RULE_SQL + "SELECT 'model=' || type_codex || ',cellvit=' || type_cellvit_prior AS conflict, count(*) AS n FROM a WHERE is_mismatch GROUP BY ALL",
    "legacy_state": _LEGACY_SQL + "SELECT slide_no, CASE WHEN t = 4 THEN 'apoptotic' WHEN Ki67 >= t_Ki67 OR PCNA >= t_PCNA THEN 'proliferative' WHEN Vimentin >= t_Vimentin AND Ecadherin < el THEN 'emt' WHEN Keratin >= t_Keratin AND Ecadherin >= eh THEN 'quiescent' WHEN Ecadherin >= eh AND Keratin < t_Keratin THEN 'healthy' ELSE 'other' END AS state, count(*) AS n FROM f JOIN p USING (slide_no) GROUP BY ALL",
    "legacy_type": _LEGACY_SQL + "SELECT slide_no, CASE WHEN Keratin >= t_Keratin THEN 'tumor' WHEN CD45 >= t_CD45 OR CD4 >= t_CD4 THEN 'immune' WHEN CD31 >= t_CD31 THEN 'stromal' ELSE 'other' END AS type, count(*) AS n FROM f JOIN p USING (slide_no) GROUP BY ALL",
    "winsor_zscore": _Z_SQL,
    "cluster_scores": _SOFT_SQL + "SELECT cluster_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in _FINE) + " FROM s",
    "softmax_types": _SOFT_SQL + "SELECT cluster_id, round(c/(c+i+h), 6) AS p_cancer, round(i/(c+i+h), 6) AS p_immune, round(h/(c+i+h), 6) AS p_healthy FROM q",
    "lloyd_step": _CENTERS_SQL + ", n AS (SELECT v.*, c.cluster_id FROM v, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY " + " + ".join(f"(v.{m} - c.{m})**2" for m in MARKERS) + ", c.cluster_id) = 1) SELECT c.cluster_id, " + ", ".join(f"round(coalesce(avg(n.{m}), any_value(c.{m})), 6) AS {m}" for m in MARKERS) + " FROM c LEFT JOIN n USING (cluster_id) GROUP BY c.cluster_id",
    "marker_long": "SELECT row_id, unnest(['pan_ck', 'cd45', 'sma', 'ki67']) AS marker, unnest([CASE WHEN isnan(pan_ck) THEN NULL ELSE pan_ck END, CASE WHEN isnan(cd45) THEN NULL ELSE cd45 END, CASE WHEN isnan(sma) THEN NULL ELSE sma END, CASE WHEN isnan(ki67) THEN NULL ELSE ki67 END]) AS value FROM cell_assignments",
}
