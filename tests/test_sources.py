"""File sources and sinks on small files, and the incremental run."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nested
from tessera.sources import files
from tessera.streaming import resume


def test_index(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "index.json").write_text(json.dumps({"patches": [{"i": 0, "x0": 0, "y0": 256, "has_multiplex": True}, {"x0": 1, "y0": 2}], "stride": 128, "channels": ["DAPI"]}, indent=1))
    (tmp_path / "a" / "other.json").write_text("{}")
    index = files.read_index(spark, str(tmp_path / "a"))
    assert sorted((r.patch_size, len(r.patches)) for r in index.collect()) == [(256, 0), (256, 2)]
    assert [(r.patch_id, r.has_multiplex) for r in files.index_patches(index).orderBy("x0").collect()] == [("0_256", True), ("1_2", False)]


def test_cell_files_and_incremental_run(spark, tmp_path):
    src = tmp_path / "cells"
    src.mkdir()
    cell = {"centroid": [1, 2], "contour": [[0, 0], [4, 0], [4, 4]], "bbox": [[0, 0], [4, 4]], "type_cellvit": 1, "type_prob": 0.5}
    (src / "0_0.json").write_text(json.dumps({"patch": "0_0", "cells": [cell, {}]}, indent=2))
    (src / "256_0.json").write_text(json.dumps([cell]))
    found = files.read_cell_files(spark, str(src))
    assert sorted(r.patch_id for r in found.collect()) == ["0_0", "256_0"]
    assert nested.flat_table(nested.emit(found), "cell").count() == 3
    target, mark = str(tmp_path / "flat"), str(tmp_path / "mark")
    resume.flatten_arriving(spark, str(src), target, mark).awaitTermination()
    assert nested.read_flat(spark, target, "cell").count() == 3
    (src / "512_0.json").write_text(json.dumps([cell]))
    resume.flatten_arriving(spark, str(src), target, mark).awaitTermination()
    assert nested.read_flat(spark, target, "cell").count() == 4 and nested.read_flat(spark, target, "contour").count() == 9


@pytest.mark.parametrize("text", [" Channel_Number , Marker_Name\n1,CD31\n2,Ki67\n3,cd31\nx,Bad\n4,\n", "Channel ID,Target Name\nChannel:0:0,CD31\n1,Ki67\nChannel:0:7,CD31\n"])
def test_channels(spark, tmp_path, text):
    (tmp_path / "c.csv").write_text(text)
    got = files.read_channels(spark, str(tmp_path / "c.csv"))
    assert sorted((r.key, r.channel_index, r.marker_name) for r in got.collect()) == [("cd31", 0, "CD31"), ("ki67", 1, "Ki67")]


def test_channels_need_their_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no channel columns"):
        files.read_channels(spark, str(tmp_path / "c.csv"))


def test_features_and_assignments(spark, tmp_path):
    (tmp_path / "f.csv").write_text("CellID,Xt,Yt,X,Pan-CK\n1,10,20,5,NaN\n2,30,40,6,7.5\n")
    got = files.read_features(spark, str(tmp_path / "f.csv"), mpp=0.5).orderBy("CellID").collect()
    assert [(r.x, r.y, r["Pan-CK"]) for r in got] == [(20.0, 40.0, None), (60.0, 80.0, 7.5)]
    with pytest.raises(ValueError, match="Xt and Yt"):
        files.coordinate_columns(["a"])
    df = spark.createDataFrame([("p1", "c1", 0.5, "cancer"), ("p2", "c2", 0.1, "immune")], "patch_id string, cell_id string, p_final_cancer double, cell_type string").withColumn("Pan-CK", F.lit(1.0))
    files.write_assignments(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["patch_id", "cell_type", "cell_id", "Pan-CK", "p_final_cancer"]
    few = files.read_assignments(spark, str(tmp_path / "out"), ["cell_id", "patch_id", "absent"], df.where("patch_id = 'p2'"))
    assert [(r.cell_id, r.patch_id) for r in few.collect()] == [("c2", "p2")]
    files.write_json_rows(df.groupBy().agg(F.count("*").alias("n")), str(tmp_path / "summary"))
    assert spark.read.text(str(tmp_path / "summary")).first()[0] == '{"n":2}'
    assert files.missing_markers(df.columns, ["PanCK", "CD45"]) == ["CD45"]


def test_tiles(spark, tmp_path):
    src = tmp_path / "mx"
    src.mkdir()
    tile = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    np.save(src / "0_256.npy", tile)
    np.save(src / "other.npy", tile[0].astype(bool))
    tiles = files.read_tiles(spark, str(src))
    assert sorted((r.patch_id or "", r.channel, r.h, r.w) for r in tiles.collect()) == [("", 0, 3, 4), ("0_256", 0, 3, 4), ("0_256", 1, 3, 4)]
    px = files.tile_pixels(tiles.where("patch_id = '0_256'"))
    assert all(r.v == tile[r.channel, r.y, r.x] for r in px.collect()) and px.count() == 24
    files.write_layers(tiles.where("patch_id is not null").withColumn("layer", F.lit("raw")), str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers")).where("layer = 'raw'").count() == 2


def test_image_header(spark):
    rows = [('<OME xmlns="http://x"><Image><Pixels ID="p" PhysicalSizeX="0.325" PhysicalSizeY="0.5"/></Image></OME>',), ("<ome:Pixels PhysicalSizeY='2'>",), ("no xml",), (None,)]
    got = spark.createDataFrame(rows, "xml string").select(*[v.alias(k) for k, v in files.ome_mpp(F.col("xml")).items()]).collect()
    assert [tuple(r) for r in got] == [(0.325, 0.5), (None, 2.0), (None, None), (None, None)]
