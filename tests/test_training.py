"""Consolidation, flattening and orphan references against brute force, with the hard cases of each."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import compaction, nested, references
from tessera.operators.dedup import keep_first, later_copies, ordinals
from tessera.operators.joins import attach
from tessera.plans import training
from tessera.sources import lenient
from tessera.sources.tables import materialize, table

FILES = "file_id bigint, kind string, slide_id string, body string"


def brute_cells(body):
    """Cells of a readable body, written anew: (place, centroid, points, box, type, name, prob)."""
    value = json.loads(body)
    if isinstance(value, dict):
        for key in ("cells", "nuclei", "detections", "instances"):
            if key in value:
                value = value[key]
                break
    pairs = enumerate(value) if isinstance(value, list) else ((int(k), v) for k, v in value.items() if k.lstrip("-").isdigit())
    ok = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    for place, cell in pairs:
        c = cell.get("centroid") or []
        b = cell.get("bbox") or []
        b = [x for part in b for x in (part if isinstance(part, list) else [part])]
        outline = next((cell[k] for k in ("contour", "contours", "polygon", "boundary", "coords", "points") if cell.get(k)), [])
        outline = json.loads(outline) if isinstance(outline, str) else outline
        outline = [p[0] if p and isinstance(p[0], list) else p for p in outline]
        points = tuple(tuple(map(float, p)) for p in outline if len(p) == 2 and all(map(ok, p)))
        yield place, tuple(map(float, c)) if len(c) == 2 and all(map(ok, c)) else None, points, tuple(map(float, b)) if len(b) == 4 and all(map(ok, b)) else None, cell.get("type_cellvit"), cell.get("type_name"), cell.get("type_prob")


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_found_equals_brute_force(spark, scale):
    d = f"/root/testdata/{scale}"
    seen, want1, want2 = set(), set(), set()
    for r in table(spark, d, "stage_files").orderBy("file_id").collect():
        try:
            value = json.loads(r.body)
        except (TypeError, ValueError):
            want1.add((r.file_id, -1))
            continue
        if r.kind == "index":
            entries = value["patches"] if isinstance(value, dict) else value
            found = [(i, tuple(p.get(k) for k in ("x0", "y0", "has_multiplex", "multiplex_overlap_fraction", "has_mask"))) for i, p in enumerate(entries)]
        else:
            found = [(c[0], c[1:]) for c in brute_cells(r.body)]
            for place, centroid, points, box, *_ in brute_cells(r.body):
                want2 |= {(r.file_id, place, n) for n, v in (("centroid", centroid), ("contour", points), ("bbox", box)) if not v}
        for place, key in sorted(found, key=lambda x: x[0]):
            if (r.kind, r.slide_id, key) in seen:
                want1.add((r.file_id, place))
            seen.add((r.kind, r.slide_id, key))
    got1 = [tuple(r) for r in training.p1_found(spark, d).collect()]
    assert len(got1) == len(set(got1)) and set(got1) == want1
    got2 = [tuple(r) for r in training.p2_found(spark, d).collect()]
    assert len(got2) == len(set(got2)) and set(got2) == want2


@pytest.mark.parametrize("target", [200, 1 << 20])
def test_pack_round_trip_of_awkward_files(spark, tmp_path, target):
    rows = [(1, "a", "s", None), (2, "a", "s", ""), (3, "a", None, "x\n\ny\n"), (4, None, "s", "é" * 70_000), (5, "b/c", "s", '{"broken'), (5, "b/c", "s", '{"broken')]
    files = spark.createDataFrame(rows, FILES).withColumn("extra", F.lit("clash"))
    boxes = compaction.pack(files, "file_id", "kind", "body", carry=["slide_id"], target_bytes=target)
    catalogue = compaction.write_containers(boxes, str(tmp_path / "out"))
    for read in (boxes, compaction.read_containers(spark, str(tmp_path / "out"), catalogue)):
        back = [(r.id, r.kind, json.loads(r.carry).get("slide_id"), None if r.body is None else bytes(r.body).decode()) for r in compaction.unpack(read).collect()]
        assert sorted(back, key=repr) == sorted(rows, key=repr)
    if target > 200:
        assert catalogue.count() == 3  # one container for each kind and for no kind
    next((tmp_path / "out").glob("*/*.zst")).unlink()
    with pytest.raises(compaction.DamagedContainer, match="missing"):
        compaction.read_containers(spark, str(tmp_path / "out"), catalogue)
    none = compaction.pack(files.limit(0), "file_id", "kind", "body")
    assert none.count() == 0
    assert compaction.unpack(compaction.read_containers(spark, str(tmp_path / "none"), compaction.write_containers(none, str(tmp_path / "none")))).count() == 0


def test_many_tiny_files_fill_their_containers(spark):
    import random

    r = random.Random(2)
    files = spark.range(3000).select(F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, "index").otherwise("cellvit").alias("kind"), F.expr("hex(unhex(sha2(cast(id as string), 512)))").alias("body")).repartition(40)
    whole = compaction.pack(files, "file_id", "kind", "body").collect()
    assert sorted((x.kind, x.n_files) for x in whole) == [("cellvit", 2000), ("index", 1000)]
    target = r.randint(9_000, 11_000)
    for boxes in (compaction.pack(files, "file_id", "kind", "body", target_bytes=target), compaction.pack(files.coalesce(2), "file_id", "kind", "body", target_bytes=target)):
        sizes = boxes.select("kind", "size", "n_files").collect()
        assert sum(x.n_files for x in sizes) == 3000 and max(x["size"] for x in sizes) <= target + 200  # the trailer comes on top
        assert all(sum(2 * x["size"] < target for x in sizes if x.kind == k) <= 1 for k in ("index", "cellvit"))


def test_equal_containers_are_read_as_often_as_they_were_made(spark, tmp_path):
    files = spark.createDataFrame([(1, "a", "s", "x" * 500)] * 3, FILES)
    catalogue = compaction.write_containers(compaction.pack(files, "file_id", "kind", "body", target_bytes=10), str(tmp_path / "out"))
    assert catalogue.count() == 3
    assert compaction.unpack(compaction.read_containers(spark, str(tmp_path / "out"), catalogue)).count() == 3


def test_container_is_plain_zstandard_and_damage_is_found(spark):
    import zstandard

    box = compaction.pack(spark.createDataFrame([(1, "a", "s", "one\n"), (2, "a", "s", "two\n")], FILES).coalesce(1), "file_id", "kind", "body").collect()[0]
    payload = bytes(box.payload)
    assert zstandard.ZstdDecompressor().stream_reader(payload, read_across_frames=True).read() == b"one\ntwo\n"
    assert [d for _, d in compaction.frames(payload)] == [b"one\n", b"two\n", None]
    first = payload.index(b'"xxh3": ', payload.index(b'"files"'))
    for damaged in (payload[:-1], payload[:-3] + b"abc", payload[4:], payload[: payload.rindex(b"*M\x18") - 1], payload[: first + 8] + b"9" + payload[first + 9 :]):
        with pytest.raises(Exception):  # noqa: B017 - zstandard's own error or ours
            list(compaction.frames(damaged))
    frame = spark.createDataFrame([(bytearray(payload[:-9]),)], "payload binary")
    with pytest.raises(Exception, match="DamagedContainer"):
        compaction.unpack(frame).collect()


def test_map_keys_of_32_bits():
    keys = ["2147483647", "-2147483648", " +1000000000 ", "0000000012", "0" * 6000 + "5", "000", "2147483648", "-2147483649", "9" * 6000, "", "+", "1.0", "1 2"]
    assert [p for p, _ in lenient.records("cellvit", {k: {} for k in keys})] == [2147483647, -2147483648, 1000000000, 12, 5, 0]


def test_map_keys_that_say_one_integer_are_one_record():
    assert list(lenient.records("cellvit", {"7": {"a": 1}, "+7": {"a": 2}, "8": {}})) == [(7, {"a": 2}), (8, {})]


def test_plain_points_and_awkward_ones_say_the_same():
    for plain, awkward in (([1, 2], ["1", 2.0]), ([1, 2], [[1, 2]]), ([0.0, 3], "[0, 3]")):
        assert lenient.numbers(plain, 2) == lenient.numbers(awkward, 2)
    assert lenient.numbers([float("nan"), 1], 2) is None and lenient.numbers([10**400, 1], 2) is None and lenient.numbers([1.5, 2], 4) is None
    assert lenient.outline({"contour": [[1, 2], [3, None], [4, 5]]}) == [[1.0, 2.0], [4.0, 5.0]]
    assert lenient.numbers([[1, 2], [3, 4]], 4) == [1.0, 2.0, 3.0, 4.0] and lenient.numbers([[1, 2, 9], [3, 4]], 4) == [1.0, 2.0, 9.0, 3.0]


def test_lenient_forms():
    say = lambda c: lenient.cell_parts(c)
    assert say({"centroid": "[1, 2]"})["centroid"] == [1.0, 2.0]
    assert say({"centroid": ["1", 2]})["centroid"] == [1.0, 2.0]
    assert say({"centroid": [True, 2]})["centroid"] is None
    assert say({"bbox": [1, 2, 3, 4]})["bbox"] == say({"bbox": [[1, 2], [3, 4.0]]})["bbox"]
    assert say({"bbox": [[1, 2], [None, 4]]})["bbox"] is None
    assert say({"contour": [5, 6]})["contour"] == []
    assert say({"contour": None, "polygon": "[[1, 2], [3], [null, 4]]"})["contour"] == [[1.0, 2.0]]
    assert say({"points": [[[1, 2]], [[3, 4]]]})["contour"] == [[1.0, 2.0], [3.0, 4.0]]
    assert say({"outline": {"x": [1, 2], "y": [3, 4]}})["contour"] == [[1.0, 3.0], [2.0, 4.0]]
    assert [p for p, _ in lenient.records("cellvit", {"7": {}, "x": {}, "99999999999": {}})] == [7]
    assert list(lenient.records("cellvit", {"patch": "0_0"})) == [] and list(lenient.records(None, 3)) == []
    assert lenient.parse("[1] x") is lenient.UNREADABLE and lenient.parse("") is lenient.UNREADABLE and lenient.parse("[" * 100_000) is lenient.UNREADABLE
    assert lenient.canonical("index", {"x0": 1, "y0": -0.0}) == lenient.canonical("index", {"x0": 1.0, "y0": "0", "has_mask": None})
    assert math.isfinite(lenient.number("3e2")) and lenient.number("nan") is None and lenient.number(10**400) is None


def test_flat_tables_keep_links(spark, tmp_path):
    body = json.dumps({"cells": [{"centroid": [1, 2], "contour": [[0, 0], [1, 1]], "bbox": [0, 1, 2, 3], "type_cellvit": 2, "type_name": "n", "type_prob": 0.5}, {}]})
    tagged = nested.emit(spark.createDataFrame([(9, body), (10, None), (11, "[]")], "file_id bigint, body string"))
    nested.write_flat(tagged, str(tmp_path / "flat"))
    read = lambda tag: nested.read_flat(spark, str(tmp_path / "flat"), tag).orderBy("pk")
    assert [(r.pk, r.parent_pk, r.type_cellvit, r.type_name) for r in read("cell").collect()] == [("9/0", "9", 2.0, "n"), ("9/1", "9", None, None)]
    assert [(r.pk, r.parent_pk, r.x, r.y) for r in read("contour").collect()] == [("9/0/contour/0", "9/0", 0.0, 0.0), ("9/0/contour/1", "9/0", 1.0, 1.0)]
    assert [(r.y0, r.x1) for r in read("bbox").collect()] == [(0.0, 3.0)]
    assert sorted((r.file_id, r.n_records, r.readable) for r in read("file").collect()) == [(9, 2, True), (10, 0, False), (11, 0, True)]
    assert [tuple(r) for r in nested.missing_parts(spark, str(tmp_path / "flat")).orderBy("nested_field").collect()] == [(9, 1, p) for p in ("bbox", "centroid", "contour")]
    none = nested.emit(tagged.select("file_id", F.lit("").alias("body")).limit(0))
    nested.write_flat(none, str(tmp_path / "none"))
    assert nested.read_flat(spark, str(tmp_path / "none"), "cell").count() == 0 and nested.missing_parts(spark, str(tmp_path / "none")).count() == 0


def test_runs_and_asof(spark):
    parents = spark.createDataFrame([("s", y, 256, p) for y, p in ((0, "a"), (256, "a"), (512, "b"), (100, "a"), (1024, "b"))], "g string, k bigint, step bigint, p string")
    runs = references.compress_runs(parents, ["g"], "k", "step", ["p"])
    assert sorted((r.run_start, r.run_end, r.p) for r in runs.collect()) == [(0, 0, "a"), (100, 100, "a"), (256, 256, "a"), (512, 512, "b"), (1024, 1024, "b")]
    even = references.compress_runs(parents.where("k <> 100"), ["g"], "k", "step", ["p"])
    assert sorted((r.run_start, r.run_end) for r in even.collect()) == [(0, 256), (512, 512), (1024, 1024)]
    refs = spark.createDataFrame([("s", k) for k in (0, 128, 256, 512, 768, 2048, -5)] + [("t", 0)], "g string, k bigint")
    got = {(r.g, r.k): (r.in_run, r.p) for r in references.asof_runs(refs, even, ["g"], "k", ["p"]).collect()}
    assert got == {("s", 0): (True, "a"), ("s", 128): (False, None), ("s", 256): (True, "a"), ("s", 512): (True, "b"), ("s", 768): (False, None), ("s", 2048): (False, None), ("s", -5): (False, None), ("t", 0): (False, None)}


def test_orphans_with_nulls_and_no_tables(spark):
    index = spark.sql("""SELECT 's' AS slide_id, 1 AS rev, timestamp'2024-01-01' AS indexed_at, array(named_struct('x0', 0, 'y0', 0), named_struct('x0', 0, 'y0', 256)) AS patches, 256 AS stride
      UNION ALL SELECT 's', 2, timestamp'2024-02-01', array(named_struct('x0', 0, 'y0', 0), named_struct('x0', 256, 'y0', 0)), 256 UNION ALL SELECT 'e', 1, timestamp'2024-01-01', NULL, NULL""")
    rows = [(1, "s", " 0.0_0 ", "2024-03-01"), (2, "s", "0_256", "2024-03-01"), (3, "s", "256_0", "2024-01-15"), (4, "s", "256_0", None), (5, "s", None, None), (6, None, "0_0", "2024-03-01"), (7, "s", "0-0", "2024-03-01"), (8, "e", "0_0", "2024-03-01"), (9, "s", "99999999999999999999_0", "2024-03-01"), (10, "s", "0_0", "2023-12-01")]
    refs = spark.createDataFrame(rows, "row_id bigint, slide_id string, patch_id string, loaded_at string").withColumn("loaded_at", F.to_timestamp("loaded_at"))
    got = {r.row_id: r.orphan_kind for r in references.orphan_patches(index, {"t": refs.withColumn("x0", F.lit("clash"))}).collect()}
    assert got == {2: "deleted", 3: "late", 6: "missing", 7: "missing", 8: "missing", 9: "missing", 10: "late"}
    none = references.orphan_patches(index.limit(0), {"t": refs})
    assert none.where("orphan_kind = 'missing'").count() == 9
    report = {(r.loaded_month, r.orphan_kind): r.n_rows for r in references.orphan_report(none).collect()}
    assert report[(None, "missing")] == 1
    assert references.orphan_patches(index, {"t": refs.limit(0)}).count() == 0


def test_keep_first_of_a_hot_key(spark):
    df = spark.range(2000).select((F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("hot")).alias("k"), "id")
    first = keep_first(df, ["k"], [F.asc("id")], ["id"], salts=8)
    assert sorted((r.k, r.id) for r in first.collect() if r.k) == [("hot", 1)] and first.count() == 2
    assert later_copies(df, ["k"], ["id"]).count() == 1998 and later_copies(df.limit(0), ["k"], ["id"]).count() == 0
    assert keep_first(df.limit(0), ["k"], [F.asc("id")], ["id"]).count() == 0


def test_attach_by_any_way_gives_the_same(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 1700)).alias("k"))
    marks = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k is null or k <> 'k1'")
    for how in ("inner", "left"):
        few, many = (attach(rows, marks, ["k"], "n", how, small) for small in (10_000, 0))
        assert few.orderBy("id").collect() == many.orderBy("id").collect()
        assert few.count() == (6000 if how == "left" else 6000 - rows.where("k = 'k1'").count())
    assert attach(rows, marks.limit(0), ["k"], "n").count() == 0 and attach(rows.limit(0), marks, ["k"], "n", "left", 0).count() == 0


def test_ordinals(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v"), (F.col("id") % 3).alias("ordinal_of"))
    assert [r.ordinal for r in ordinals(df, [F.asc("v")]).orderBy("v").collect()] == list(range(1, 501))
    assert ordinals(df.limit(0), [F.asc("v")]).count() == 0


def test_materialize_reads_back(spark):
    df = spark.range(10).withColumn("a", F.array("id"))
    assert materialize(df, "t").orderBy("id").collect() == df.collect()
