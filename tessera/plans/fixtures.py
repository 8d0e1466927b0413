"""Stand-ins for cells, features and rasters, made from the given tables by the same integers in both engines.

A slide is 15,000 order keys and 10,000 events, so slides, not densities, grow with the tables; a raster
tile is 1,000 order keys of lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: Multipliers of the stand-in markers.
MARKERS = {
    "PanCK": (11, 17), "Ecadherin": (13, 19), "CD45": (17, 23), "CD3e": (19, 29), "CD4": (23, 31), "CD8a": (29, 37), "CD20": (31, 41), "CD68": (37, 43),
    "CD163": (41, 47), "FOXP3": (43, 53), "CD45RO": (47, 59), "PD1": (53, 61), "SMA": (59, 67), "CD31": (61, 71), "Ki67": (67, 73),
}
SIDE = 64


def cells(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    base = table(spark, d, "orders").select(o.alias("cell_id"), F.floor(o / 15000).alias("slide_no"), ((o * 37 + c * 11) % 1024).alias("x"), ((o * 91 + c * 5) % 1024).alias("y"), (c % 6).cast("int").alias("type_cellvit"))
    return base.withColumn("patch_id", F.concat_ws("_", F.col("x") - F.col("x") % 256, F.col("y") - F.col("y") % 256))


def features(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(e.alias("row_idx"), F.floor(e / 10000).alias("slide_no"), ((e * 53 + u * 7) % 1024).alias("x"), ((e * 29 + u * 13) % 1024).alias("y"), *[((e * a + u * b) % 5000).cast("double").alias(m) for m, (a, b) in MARKERS.items()])


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """(tile, x, y, v) of the pixels that any lineitem falls on."""
    k = F.col("l_orderkey")
    x, y = (k * 37 + F.col("l_linenumber") * 11) % SIDE, (F.col("l_partkey") * 29 + F.col("l_suppkey") * 5) % SIDE
    return table(spark, d, "lineitem").select(F.floor(k / 1000).alias("tile"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.col("l_quantity").cast("bigint").alias("q")).groupBy("tile", "x", "y").agg(F.sum("q").alias("v"))


CELLS_SQL = """cells AS (SELECT o_orderkey AS cell_id, o_orderkey // 15000 AS slide_no, (o_orderkey*37+o_custkey*11)%1024 AS x, (o_orderkey*91+o_custkey*5)%1024 AS y,
  (o_custkey%6)::INT AS type_cellvit, concat(x - x%256, '_', y - y%256) AS patch_id FROM orders)"""
FEATURES_SQL = "features AS (SELECT event_id AS row_idx, event_id // 10000 AS slide_no, (event_id*53+user_id*7)%1024 AS x, (event_id*29+user_id*13)%1024 AS y, " + ", ".join(f"((event_id*{a}+user_id*{b})%5000)::DOUBLE AS {m}" for m, (a, b) in MARKERS.items()) + " FROM events)"
PIXELS_SQL = "px AS (SELECT l_orderkey // 1000 AS tile, ((l_orderkey*37+l_linenumber*11)%64)::INT AS x, ((l_partkey*29+l_suppkey*5)%64)::INT AS y, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL)"
#: All pixels of each tile, 0 where there is none.
GRID_SQL = PIXELS_SQL + ", grid AS (SELECT tile, gx.x::INT AS x, gy.y::INT AS y FROM (SELECT DISTINCT tile FROM px), (SELECT unnest(range(64)) AS x) gx, (SELECT unnest(range(64)) AS y) gy), full_px AS (SELECT g.tile, g.x, g.y, coalesce(v, 0)::BIGINT AS v FROM grid g LEFT JOIN px USING (tile, x, y))"


def _said(e: str) -> str:
    return f"CASE WHEN json_type({e}) = 'VARCHAR' AND left(ltrim({e} ->> '$'), 1) IN ('[', '{{') AND json_valid({e} ->> '$') THEN ({e} ->> '$')::JSON ELSE {e} END"


def _number(e: str) -> str:
    return f"CASE WHEN json_type({e}) IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN ({e})::DOUBLE WHEN json_type({e}) = 'VARCHAR' THEN TRY_CAST({e} ->> '$' AS DOUBLE) END"


def _points(e: str) -> str:
    each = f"CASE WHEN json_type({e}) = 'ARRAY' THEN from_json({e}, '[\"json\"]') ELSE [] END"
    level = f"flatten(list_transform({each}, lambda p: CASE WHEN json_type(p -> 0) = 'ARRAY' THEN from_json(p, '[\"json\"]') WHEN json_type(p) = 'ARRAY' THEN [p] ELSE [] END))"
    return f"list_filter(list_transform({level}, lambda p: struct_pack(x := {_number('(p -> 0)')}, y := {_number('(p -> 1)')})), lambda p: p.x IS NOT NULL AND p.y IS NOT NULL)"


_OUTLINES = ("contour", "contours", "polygon", "boundary", "coords", "points", "outline")
#: Cells of the readable cell files: jq(file_id, slide_id, file_path, cell_pos, cell, cx, cy, b, points), parts null or with nulls where incomplete.
STAGE_SQL = f"""jf AS (SELECT file_id, slide_id, file_path, body::JSON AS j FROM stage_files WHERE kind = 'cellvit' AND json_valid(body)),
jc AS (SELECT * EXCLUDE j, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(j -> 'cells', j -> 'nuclei', j -> 'detections', j -> 'instances', j) ELSE j END AS c0 FROM jf),
jd AS (SELECT * EXCLUDE c0, {_said("c0")} AS c FROM jc),
je AS (SELECT * EXCLUDE c, unnest(range(json_array_length(c)::BIGINT))::INT AS cell_pos, unnest(from_json(c, '["json"]')) AS cell FROM jd WHERE json_type(c) = 'ARRAY'
  UNION ALL SELECT * EXCLUDE (c, k), TRY_CAST(k AS INT), c -> ('$."' || k || '"') FROM (SELECT *, unnest(json_keys(c)) AS k FROM jd WHERE json_type(c) = 'OBJECT') WHERE TRY_CAST(k AS INT) IS NOT NULL),
jp AS (SELECT *, {_said("(cell -> 'centroid')")} AS ce, {_said("(cell -> 'bbox')")} AS bb, {", ".join(_said(f"(cell -> '{n}')") + f" AS o_{n}" for n in _OUTLINES)} FROM je WHERE json_type(cell) = 'OBJECT'),
jq AS (SELECT file_id, slide_id, file_path, cell_pos, cell, {_number("(ce -> 0)")} AS cx, {_number("(ce -> 1)")} AS cy, {_number("(cell -> 'type_cellvit')")} AS kind_id, {_number("(cell -> 'type_prob')")} AS prob,
  CASE WHEN json_type(bb -> 0) = 'ARRAY' THEN [{", ".join(_number(f"(bb -> {i} -> {k})") for i in (0, 1) for k in (0, 1))}] ELSE [{", ".join(_number(f"(bb -> {i})") for i in range(4))}] END AS b,
  list_filter([{", ".join(_points(f"o_{n}") for n in _OUTLINES)}], lambda o: len(o) > 0)[1] AS points FROM jp)"""
_FULL_BOX = "len(list_filter(b, lambda v: v IS NULL)) = 0"
#: Entries of the readable index files: ix(file_id, slide_id, pos, entry).
INDEX_SQL = """xf AS (SELECT file_id, slide_id, body::JSON AS j FROM stage_files WHERE kind = 'index' AND json_valid(body)), xc AS (SELECT file_id, slide_id, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(j -> 'patches', j) ELSE j END AS c FROM xf),
ix AS (SELECT file_id, slide_id, unnest(range(json_array_length(c)::BIGINT))::INT AS pos, unnest(from_json(c, '["json"]')) AS entry FROM xc WHERE json_type(c) = 'ARRAY'
  UNION ALL SELECT file_id, slide_id, TRY_CAST(k AS INT), c -> ('$."' || k || '"') FROM (SELECT *, unnest(json_keys(c)) AS k FROM xc WHERE json_type(c) = 'OBJECT') WHERE TRY_CAST(k AS INT) IS NOT NULL)"""
_ENTRY = " || '|' || ".join(f"coalesce(({_number(f'(entry -> {chr(39)}{k}{chr(39)})')})::VARCHAR, lower(entry ->> '{k}'), '')" for k in ("x0", "y0", "has_multiplex", "multiplex_overlap_fraction", "has_mask"))
P1_SQL = f"""WITH {STAGE_SQL}, {INDEX_SQL},
r AS (SELECT 'cellvit' AS kind, slide_id, file_id, cell_pos AS pos, concat_ws('|', CASE WHEN cx IS NOT NULL AND cy IS NOT NULL THEN [cx, cy]::VARCHAR ELSE '-' END, CASE WHEN {_FULL_BOX} THEN b::VARCHAR ELSE '-' END, coalesce(points::VARCHAR, '-'), coalesce(kind_id::VARCHAR, cell ->> 'type_cellvit', ''), coalesce(cell ->> 'type_name', ''), coalesce(prob::VARCHAR, cell ->> 'type_prob', '')) AS key FROM jq
  UNION ALL SELECT 'index', slide_id, file_id, pos, {_ENTRY} FROM ix WHERE json_type(entry) = 'OBJECT'),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, slide_id, key ORDER BY file_id, pos) AS n FROM r)
SELECT file_id, pos AS record_pos FROM n WHERE n > 1 UNION ALL SELECT file_id, -1 FROM stage_files WHERE body IS NULL OR NOT json_valid(body)"""
P2_SQL = f"WITH {STAGE_SQL}, m AS (SELECT file_id, cell_pos, unnest(['bbox', 'centroid', 'contour']) AS nested_field, unnest([NOT ({_FULL_BOX}), cx IS NULL OR cy IS NULL, points IS NULL]) AS lacks FROM jq) SELECT file_id, cell_pos, nested_field FROM m WHERE lacks"
P2_TABLES_SQL = f"""WITH {STAGE_SQL}, t AS (SELECT 'file' AS tag, count(*) AS n FROM stage_files WHERE kind = 'cellvit' UNION ALL SELECT 'cell', count(*) FROM jq UNION ALL SELECT 'centroid', count(*) FROM jq WHERE cx IS NOT NULL AND cy IS NOT NULL
  UNION ALL SELECT 'bbox', count(*) FROM jq WHERE {_FULL_BOX} UNION ALL SELECT 'contour', coalesce(sum(len(points)), 0)::BIGINT FROM jq) SELECT tag, n AS n_rows, n AS n_keys FROM t WHERE n > 0"""
P2_BOXES_SQL = f"WITH {STAGE_SQL} SELECT file_id, cell_pos, kind_id AS type_cellvit, CASE WHEN {_FULL_BOX} THEN b[3] - b[1] END AS height, CASE WHEN {_FULL_BOX} THEN b[4] - b[2] END AS width, CASE WHEN cy IS NOT NULL THEN cx END AS x, CASE WHEN cx IS NOT NULL THEN cy END AS y FROM jq"


def covered_sql(side: int) -> str:
    """al(id, x, y): the pixels that polygons cover on a tile, from c(id, i, n, px, py), their n truncated corners in order."""
    return (
        "e AS (SELECT a.id, a.px, a.py, b.px AS qx, b.py AS qy FROM c a JOIN c b ON a.id = b.id AND b.i = (a.i + 1) % a.n), "
        f"bx AS (SELECT id, greatest(min(px), 0) AS x0, least(max(px), {side - 1}) AS x1, greatest(min(py), 0) AS y0, least(max(py), {side - 1}) AS y1 FROM c GROUP BY id), "
        "gd AS (SELECT id, x, unnest(range(y0, y1 + 1))::INT AS y FROM (SELECT *, unnest(range(x0, x1 + 1))::INT AS x FROM bx WHERE x0 <= x1) WHERE y0 <= y1), "
        "k AS (SELECT id, y, px + (y - py) * (qx - px) / (qy - py)::DOUBLE AS cx FROM (SELECT e.*, unnest(range(least(py, qy), greatest(py, qy) + 1)) AS y FROM e) WHERE (py <= y) <> (qy <= y)), "
        "ins AS (SELECT gd.id, gd.x, gd.y FROM gd JOIN k ON k.id = gd.id AND k.y = gd.y GROUP BY ALL HAVING count(*) FILTER (WHERE cx <= gd.x) % 2 = 1 OR bool_or(cx = gd.x)), "
        "st AS (SELECT *, greatest(abs(qx - px), abs(qy - py), 1) AS n FROM e), bo AS (SELECT id, round_even(px + t / n * (qx - px), 0)::INT AS x, round_even(py + t / n * (qy - py), 0)::INT AS y FROM (SELECT *, unnest(range(n + 1))::DOUBLE AS t FROM st)), "
        f"al AS (SELECT id, x, y FROM ins UNION SELECT id, x, y FROM bo WHERE x BETWEEN 0 AND {side - 1} AND y BETWEEN 0 AND {side - 1}) "
    )
