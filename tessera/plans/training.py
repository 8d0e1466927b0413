"""Queries of the general training-data problems (1, 2, 5) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compaction, nested, references
from tessera.operators.dedup import later_copies
from tessera.plans.fixtures import P1_SQL, P2_BOXES_SQL, P2_SQL, P2_TABLES_SQL
from tessera.sources.tables import materialize, scratch, table


#: Bytes of a container. The tables here are small; a container is also what one task reads, so it stays well under a block.
CONTAINER_BYTES = 4 << 20


def _containers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, catalogue) of stage_files written as containers and read back."""
    files, path = table(spark, d, "stage_files").select("file_id", "kind", "slide_id", "body"), scratch(spark, "containers")
    catalogue = compaction.write_containers(compaction.pack(files, "file_id", "kind", "body", carry=["slide_id"], target_bytes=CONTAINER_BYTES), path)
    return compaction.read_containers(spark, path, catalogue), catalogue


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Unreadable files and repeated records, read back from the consolidated containers."""
    keys = materialize(compaction.record_keys(compaction.unpack(_containers(spark, d)[0])), "records")
    again = later_copies(keys.where("digest is not null"), ["kind", "slide_id", "digest"], ["file_id", "record_pos"])
    return keys.where("digest is null").select("file_id", "record_pos").unionByName(again.select("file_id", "record_pos"))


def p1_containers(spark: SparkSession, d: str) -> DataFrame:
    """What the consolidation carries, by kind; byte and file counts as unpacked again."""
    back = compaction.unpack(_containers(spark, d)[0])
    return back.groupBy("kind").agg(F.count("*").alias("n_files"), F.count_if(F.col("body").isNull()).alias("n_null"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n_bytes"), F.sum("id").alias("sum_ids"))


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Containers a kind: how many, their files and bytes, and whether at most one is under half full and none too large."""
    _, catalogue = _containers(spark, d)
    small, large = F.count_if(F.col("size") * 2 < CONTAINER_BYTES), F.count_if((F.col("size") > CONTAINER_BYTES + 1024) & (F.col("n_files") > 1))
    return catalogue.groupBy("kind").agg(F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), (F.count("*") <= F.ceil(F.sum("size") * 2 / CONTAINER_BYTES)).alias("few"), (small <= 1).alias("well_filled"), (large == 0).alias("within_target"))


def _flat(spark: SparkSession, d: str) -> str:
    """The folder of the flat tables of all cell files."""
    path = scratch(spark, "flat")
    nested.write_flat(nested.emit(table(spark, d, "stage_files").where("kind = 'cellvit'")), path)
    return path


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells without a complete centroid, bbox or contour."""
    return nested.missing_parts(spark, _flat(spark, d))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and keys of each flat table."""
    path, out = _flat(spark, d), None
    for tag in nested.TABLES:
        one = nested.read_flat(spark, path, tag).select(F.lit(tag).alias("tag"), "pk")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tag").agg(F.count("*").alias("n_rows"), F.countDistinct("pk").alias("n_keys"))


def p2_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Cells joined to their boxes and centroids by parent key; cells without either stay."""
    path = _flat(spark, d)
    cells = nested.read_flat(spark, path, "cell").select("file_id", "cell_pos", "pk", "type_cellvit")
    box = nested.read_flat(spark, path, "bbox").select(F.col("parent_pk").alias("pk"), (F.col("y1") - F.col("y0")).alias("height"), (F.col("x1") - F.col("x0")).alias("width"))
    centre = nested.read_flat(spark, path, "centroid").select(F.col("parent_pk").alias("pk"), "x", "y")
    return cells.join(box, "pk", "left").join(centre, "pk", "left").select("file_id", "cell_pos", "type_cellvit", "height", "width", "x", "y")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_patches(table(spark, d, "slide_index"), {t: table(spark, d, t) for t in ("cell_assignments", "channel_values")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a missing, deleted or late patch."""
    return _orphans(spark, d).select("tbl_name", "row_id", "orphan_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and kind."""
    return references.orphan_report(_orphans(spark, d))


_ORPHAN_SQL = """
WITH held AS (SELECT slide_id, rev, indexed_at, unnest(patches) AS p FROM slide_index),
top AS (SELECT slide_id, max(rev) AS top_rev FROM slide_index GROUP BY slide_id),
par AS (SELECT h.slide_id, p.x0 AS x0, p.y0 AS y0, max(h.rev) = any_value(t.top_rev) AS live, arg_min(indexed_at, h.rev) AS first_at
  FROM held h JOIN top t USING (slide_id) GROUP BY h.slide_id, p.x0, p.y0),
refs AS (SELECT 'cell_assignments' AS tbl_name, row_id, slide_id, patch_id, loaded_at FROM cell_assignments
  UNION ALL SELECT 'channel_values', row_id, slide_id, patch_id, loaded_at FROM channel_values),
keyed AS (SELECT *, TRY_CAST(regexp_extract(patch_id, '^\\s*([0-9]+)(?:\\.0)?_([0-9]+)(?:\\.0)?\\s*$', 1) AS BIGINT) AS x0,
  TRY_CAST(regexp_extract(patch_id, '^\\s*([0-9]+)(?:\\.0)?_([0-9]+)(?:\\.0)?\\s*$', 2) AS BIGINT) AS y0 FROM refs WHERE patch_id IS NOT NULL),
orphans AS (SELECT k.tbl_name, k.row_id, k.loaded_at,
  CASE WHEN par.slide_id IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN first_at > loaded_at THEN 'late' END AS orphan_kind
  FROM keyed k LEFT JOIN par ON k.slide_id = par.slide_id AND k.x0 = par.x0 AND k.y0 = par.y0)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_containers, p1_sizes, p2_found, p2_tables, p2_boxes, p5_found, p5_report)}
ORACLE = {
    "p1_found": P1_SQL,
    "p2_found": P2_SQL,
    "p2_tables": P2_TABLES_SQL,
    "p2_boxes": P2_BOXES_SQL,
    "p1_containers": "SELECT kind, count(*) AS n_files, count(*) FILTER (WHERE body IS NULL) AS n_null, coalesce(sum(strlen(body)), 0)::BIGINT AS n_bytes, sum(file_id)::BIGINT AS sum_ids FROM stage_files GROUP BY kind",
    "p1_sizes": "SELECT kind, count(*) AS n_files, coalesce(sum(strlen(body)), 0)::BIGINT AS n_bytes, TRUE AS few, TRUE AS well_filled, TRUE AS within_target FROM stage_files GROUP BY kind",
    "p5_found": _ORPHAN_SQL + "SELECT tbl_name, row_id, orphan_kind FROM orphans WHERE orphan_kind IS NOT NULL",
    "p5_report": _ORPHAN_SQL + "SELECT tbl_name, strftime(loaded_at, '%Y-%m') AS loaded_month, orphan_kind, count(*) AS n_rows FROM orphans WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
