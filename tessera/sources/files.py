"""File sources: patch manifests, cell files, channel lists, feature and assignment tables, array tiles, image headers."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markers
from tessera.operators.dedup import keep_first

INDEX_SCHEMA = """patches array<struct<x0 int, y0 int, has_multiplex boolean, multiplex_overlap_fraction double, has_mask boolean>>,
patch_size int, stride int, tissue_min double, img_w int, img_h int, he_mpp double, mx_mpp double, mpp_scale double, channels array<string>, channel_indices array<int>"""
PATCH_NAME = r"([0-9]+_[0-9]+)\.[A-Za-z]+$"


def patch_of(path: Column) -> Column:
    """The patch named by a file's stem, null for other stems."""
    return F.nullif(F.regexp_extract(path, PATCH_NAME, 1), F.lit(""))


def split_suffix(name: Column) -> dict[str, Column]:
    """stem and suffix of a file name, whatever the case; the longest image suffix counts as one."""
    suffix = F.regexp_extract(name, r"(?i)(\.ome\.tiff|\.ome\.tif|\.tiff|\.tif|\.[^.]*)$", 1)
    return {"stem": F.left(name, F.length(name) - F.length(suffix)), "suffix": F.when(suffix == "", ".tif").otherwise(suffix)}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, one row a file with an explicit schema; patches are empty and patch_size is 256 where absent."""
    raw = spark.read.schema(INDEX_SCHEMA).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    empty = F.array().cast("array<struct<x0:int,y0:int,has_multiplex:boolean,multiplex_overlap_fraction:double,has_mask:boolean>>")
    return raw.withColumns({"patches": F.coalesce("patches", empty), "patch_size": F.coalesce("patch_size", F.lit(256))})


def index_patches(index: DataFrame) -> DataFrame:
    """One row per patch of the manifests; a patch without has_multiplex has none."""
    return index.select("path", "patch_size", "stride", F.explode("patches").alias("p")).select("path", "patch_size", "stride", "p.*").withColumn("has_multiplex", F.coalesce("has_multiplex", F.lit(False))).withColumn("patch_id", F.concat_ws("_", "x0", "y0"))


def read_cell_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, patch_id, file_id, body) of cell files, for ``nested.emit``; file_id is a hash of the path."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return raw.select("path", patch_of(F.col("path")).alias("patch_id"), F.xxhash64("path").alias("file_id"), "body")


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """(key, channel_index, marker_name) of a channel list, the first of each lower-case name.

    Either ``Channel_Number`` (from 1) and ``Marker_Name``, or ``Channel ID`` (last colon-separated part,
    from 0) and ``Target Name``; other headers raise ValueError. Rows without a number or name are left out.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if {"Channel_Number", "Marker_Name"} <= set(raw.columns):
        number, name = F.trim("Channel_Number").try_cast("int") - 1, F.col("Marker_Name")
    elif {"Channel ID", "Target Name"} <= set(raw.columns):
        number, name = F.trim(F.element_at(F.split("`Channel ID`", ":"), -1)).try_cast("int"), F.col("`Target Name`")
    else:
        raise ValueError(f"no channel columns among {raw.columns}")
    listed = raw.select(number.alias("channel_index"), F.trim(name).alias("marker_name")).where("channel_index is not null and marker_name <> ''").withColumn("key", F.lower("marker_name"))
    return keep_first(listed, ["key"], [F.asc("channel_index"), F.asc("marker_name")], ["marker_name"]).select("key", "channel_index", "marker_name")


def coordinate_columns(columns: Sequence[str]) -> tuple[str, str]:
    """Xt and Yt, else X and Y; ValueError without either."""
    for pair in (("Xt", "Yt"), ("X", "Y")):
        if set(pair) <= set(columns):
            return pair
    raise ValueError("the table needs columns Xt and Yt, or X and Y")


def read_features(spark: SparkSession, path: str, mpp: float | None = None) -> DataFrame:
    """A feature table with ``x`` and ``y`` in pixels; with ``mpp`` the file's coordinates are micrometres. NaN is null."""
    raw = spark.read.csv(path, header=True, inferSchema=True, nanValue="NaN")
    cx, cy = coordinate_columns(raw.columns)
    scale = F.lit(float(mpp) if mpp else 1.0)
    clean = [F.nanvl(F.col(f"`{n}`"), F.lit(None)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in raw.dtypes]
    return raw.select(*clean, (F.col(cx).cast("double") / scale).alias("x"), (F.col(cy).cast("double") / scale).alias("y"))


def read_assignments(spark: SparkSession, path: str, columns: Sequence[str], patches: DataFrame | None = None) -> DataFrame:
    """Named columns of an assignment table that exist, of the given patches only."""
    raw = spark.read.csv(path, header=True)
    out = raw.select(*[F.col(f"`{c}`") for c in columns if c in raw.columns])
    return out if patches is None else out.join(patches.select("patch_id").distinct(), "patch_id", "left_semi")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(patch_id, channel, h, w, dtype, data) of array files, one row a channel, so that readers of few channels skip the rest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(patch_of(F.col("path")).alias("patch_id"), "content")
    schema = pa.schema([("patch_id", pa.string()), ("channel", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("dtype", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for patch, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tile = np.load(io.BytesIO(content), allow_pickle=False)
                tile = tile[None] if tile.ndim == 2 else tile
                rows = [(patch, c, *plane.shape, plane.dtype.str, np.ascontiguousarray(plane).tobytes()) for c, plane in enumerate(tile)]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(run, "patch_id string, channel int, h int, w int, dtype string, data binary")


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """(patch_id, channel, x, y, v): pixels of tiles, for overviews and small rasters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for patch, channel, h, w, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(data, np.dtype(kind)).astype(float)
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
                yield pa.RecordBatch.from_arrays([pa.array([patch] * len(v), pa.string()), pa.array(np.full(len(v), channel, np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(v)], names=["patch_id", "channel", "x", "y", "v"])

    return tiles.mapInArrow(run, "patch_id string, channel int, x int, y int, v double")


def ome_mpp(xml: Column) -> dict[str, Column]:
    """Physical pixel sizes of an image description, null where it has none or is no XML."""
    size = lambda a: F.regexp_extract(xml, rf"<(?:\w+:)?Pixels\b[^>]*?\b{a}\s*=\s*[\"']([^\"']+)[\"']", 1).try_cast("double")
    return {"mpp_x": size("PhysicalSizeX"), "mpp_y": size("PhysicalSizeY")}


#: The leading columns of an assignment table, in order.
ASSIGNMENT_COLUMNS = (
    "patch_id", "patch_x0", "patch_y0", "type_cellvit", "type_cellvit_prior", "type_codex", "type_codex_fine", "cell_type",
    "cell_state", "cell_type_confidence", "is_mismatch", "centroid_x_local", "centroid_y_local", "centroid_x_global", "centroid_y_global", "match_distance",
)


def write_assignments(df: DataFrame, path: str) -> None:
    """An assignment table as CSV: fixed columns first, then features, then probabilities; names once, the first kept."""
    tail = [c for c in df.columns if c.startswith(("p_model_", "p_final_"))]
    names = [c for c in ASSIGNMENT_COLUMNS if c in df.columns] + [c for c in df.columns if c not in ASSIGNMENT_COLUMNS and c not in tail] + tail
    df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(names)]).write.mode("overwrite").csv(path, header=True)


def write_json_rows(df: DataFrame, path: str) -> None:
    """Manifests or summaries, one JSON object a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_layers(tiles: DataFrame, path: str) -> None:
    """Tile rows with a ``layer`` column as Parquet, a folder a layer, neighbours together: ranges of patches, so that a layer has many writers."""
    tiles.repartitionByRange("layer", "patch_id").sortWithinPartitions("layer", "patch_id").write.mode("overwrite").partitionBy("layer").parquet(path)


#: The leading columns of a table of cell features, in order.
FEATURE_COLUMNS = ("PatchID", "CellIndex", "type_cellvit", "type_prob", "Xt", "Yt", "X", "Y", "X_he", "Y_he", "X_local", "Y_local", "Area_cellvit_px")


def write_features(df: DataFrame, path: str) -> None:
    """A table of cell features as CSV: the fixed columns that are there first, then the markers, by name."""
    names = [c for c in FEATURE_COLUMNS if c in df.columns] + sorted(c for c in df.columns if c not in FEATURE_COLUMNS)
    df.select(*[F.col(f"`{c}`") for c in names]).write.mode("overwrite").csv(path, header=True)


def missing_markers(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Wanted markers that no column holds under any of their names."""
    held = markers.by_marker(columns)
    return [m for m in wanted if not held.get(next(iter(markers.by_marker([m]))))]
