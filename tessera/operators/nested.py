"""Flat tables from deeply nested cell records, by one pass that emits tagged rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload schema of each tag. An outline is one payload with all its points, which become rows when the table is read.
TABLES = {
    "file": "n_records int, readable boolean",
    "cell": "type_cellvit double, type_name string, type_prob double",
    "centroid": "x double, y double",
    "bbox": "y0 double, x0 double, y1 double, x1 double",
    "contour": "points array<array<double>>",
}
TAGGED_SCHEMA = "tag string, file_id bigint, cell_pos int, pk string, parent_pk string, payload string"


def _visit(key: int, body: str | None) -> Iterator[tuple]:
    from tessera.sources import lenient

    value, parent = lenient.parse(body), str(key)
    found = [] if value is lenient.UNREADABLE else list(lenient.records("cellvit", value))
    yield "file", key, None, parent, None, f'{{"n_records":{len(found)},"readable":{"false" if value is lenient.UNREADABLE else "true"}}}'
    for place, cell in found:
        pk = f"{key}/{place}"
        kind, prob, name = lenient.number(cell.get("type_cellvit")), lenient.number(cell.get("type_prob")), cell.get("type_name")
        yield "cell", key, place, pk, parent, json.dumps({"type_cellvit": kind, "type_name": name if name is None or isinstance(name, str) else json.dumps(name), "type_prob": prob})
        parts = lenient.cell_parts(cell)
        if parts["centroid"]:
            x, y = parts["centroid"]
            yield "centroid", key, place, f"{pk}/centroid", pk, f'{{"x":{x!r},"y":{y!r}}}'
        if parts["bbox"]:
            y0, x0, y1, x1 = parts["bbox"]
            yield "bbox", key, place, f"{pk}/bbox", pk, f'{{"y0":{y0!r},"x0":{x0!r},"y1":{y1!r},"x1":{x1!r}}}'
        if parts["contour"]:
            yield "contour", key, place, f"{pk}/contour", pk, f'{{"points":{parts["contour"]!r}}}'


def emit(files: DataFrame, id_col: str = "file_id", body_col: str = "body") -> DataFrame:
    """Tagged rows of every file, depth first: the file, each cell, then the cell's complete parts.

    One pass, no shuffle. The visitor gives each row its primary and parent key, which are paths: ``file``,
    ``file/cell``, ``file/cell/bbox``. An unreadable or null body gives its file row only; a cell without a part
    keeps its cell row; repeated files give repeated rows under their own ids; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tag", pa.string()), ("file_id", pa.int64()), ("cell_pos", pa.int32()), ("pk", pa.string()), ("parent_pk", pa.string()), ("payload", pa.string())])
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += _visit(key, body)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(body_col).cast("string").alias("body")).mapInArrow(run, TAGGED_SCHEMA)


def outlines(tagged: DataFrame) -> DataFrame:
    """(file_id, cell_pos, parent_pk, points) with one row an outline, its points as an array of structs x, y."""
    said = F.from_json("payload", TABLES["contour"])["points"]
    points = F.transform(said, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return tagged.where("tag = 'contour'").select("file_id", "cell_pos", "parent_pk", points.alias("points"))


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    """The rows of one tag with its schema applied; keys and parent keys stay as columns. Outlines have a row a point, numbered by item_pos."""
    keys = ["file_id", "cell_pos", "pk", "parent_pk"]
    if tag == "contour":
        each = outlines(tagged).select("file_id", "cell_pos", "parent_pk", F.posexplode("points").alias("item_pos", "p"))
        return each.select("file_id", "cell_pos", "item_pos", F.concat_ws("/", "parent_pk", F.lit(tag), "item_pos").alias("pk"), "parent_pk", "p.*")
    return tagged.where(F.col("tag") == tag).select(*keys, F.from_json("payload", TABLES[tag]).alias("p")).select(*keys, "p.*")


def write_flat(tagged: DataFrame, path: str) -> None:
    """Write the tagged rows once, a folder a tag; ``read_flat`` applies the schemas."""
    tagged.write.mode("overwrite").option("compression", "zstd").partitionBy("tag").parquet(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_flat``, of a table without rows too; a reader of one tag opens that folder only."""
    kinds = dict(c.split(" ") for c in TAGGED_SCHEMA.split(", "))
    return spark.read.schema(TAGGED_SCHEMA).parquet(path).select(*kinds)


def read_flat(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One table of ``write_flat``."""
    return flat_table(read_tagged(spark, path), tag)


def missing_parts(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, cell_pos, nested_field) for each cell of the tables below ``path`` and part of which it has no row.

    Cells and parts meet by their link, the cell's key: one shuffle of a narrow row for each of them; the points of
    an outline are one row there.
    """
    parts = ("bbox", "centroid", "contour")
    link = None
    for tag in ("cell", *parts):
        one = (outlines(read_tagged(spark, path)) if tag == "contour" else read_flat(spark, path, tag)).select("file_id", "cell_pos", *[F.lit(tag == p).alias(p) for p in parts])
        link = one if link is None else link.unionByName(one)
    per_cell = link.groupBy("file_id", "cell_pos").agg(*[F.max(p).alias(p) for p in parts])
    lacks = F.filter(F.array(*[F.when(~F.col(p), F.lit(p)) for p in parts]), lambda p: p.isNotNull())
    return per_cell.select("file_id", "cell_pos", F.explode(lacks).alias("nested_field"))
