"""Queries of the valid revision on a slide whose patches change between revisions."""

import pytest

from tessera.plans import QUERIES

INDEX = "slide_id string, rev int, patches array<struct<x0:int,y0:int,has_multiplex:boolean,multiplex_overlap_fraction:double,has_mask:boolean>>, patch_size int, stride int, tissue_min double, img_w int, img_h int"


@pytest.fixture(scope="module")
def revised(spark, tmp_path_factory):
    size = (256, 256, 0.5, 1024, 1024)
    old, new = [(0, 0, True, 1.0, True)], [(0, 0, True, 0.5, True), (256, 256, True, 0.75, True), (512, 0, True, 1.0, None)]
    rows = [("a", 1, old, *size), ("a", 2, new, *size), ("a", 2, new, *size), ("b", 1, old, *size), ("b", 2, [], *size), ("c", 1, None, *size), ("c", 3, old, *size)]
    at = str(tmp_path_factory.mktemp("revised"))
    spark.createDataFrame(rows, INDEX).write.parquet(f"{at}/slide_index.parquet")
    return at


def test_best_crop_of_the_valid_revision(spark, revised):
    assert {tuple(r) for r in QUERIES["valid_best_crop"](spark, revised).collect()} == {("a", 256, 256, 1.75), ("c", 0, 0, 2.0)}


def test_tissue_of_the_valid_revision(spark, revised):
    assert {tuple(r) for r in QUERIES["valid_tissue_patches"](spark, revised).collect()} == {("a", 0, 0, 1.0), ("a", 256, 256, 1.0), ("c", 0, 0, 1.0)}


def test_tissue_of_every_revision(spark, revised):
    got = {tuple(r) for r in QUERIES["tissue_patches"](spark, revised).collect()}
    assert got == {("a", 1, 0, 0, 1.0), ("a", 2, 0, 0, 1.0), ("a", 2, 256, 256, 1.0), ("b", 1, 0, 0, 1.0), ("c", 3, 0, 0, 1.0)}
