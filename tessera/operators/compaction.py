"""Consolidation of very many small files into few containers, byte by byte.

A container is the plain concatenation of complete zstandard frames, two for each file: a skippable frame
that holds the file's header (id, path columns, length, checksum) and a data frame with the file's bytes. A
last skippable frame, the trailer, holds the container's kind, number of files and checksum. Nothing is
parsed, so line breaks, broken files and empty files pass unchanged, and any zstandard tool can decompress
a container as a whole. Reading validates the length and the checksum of every file and container.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import materialize

#: The first magic number of skippable frames, of the zstandard format.
SKIPPABLE = 0x184D2A50
PART_SCHEMA = "task int, number int, kind string, n_files bigint, n_bytes bigint, size bigint, done boolean, payload binary"
#: Tasks whose remainders are put together by one group of the second stage: bounds that group, whatever the table.
TASK_BLOCK = 4096


class DamagedContainer(ValueError):
    """A length or checksum of a container does not hold."""


def _skippable(header: dict) -> bytes:
    head = json.dumps(header).encode()
    return struct.pack("<II", SKIPPABLE, len(head)) + head


def frames(payload: bytes) -> Iterator[tuple[dict, bytes | None]]:
    """(header, bytes) of each file of a container and at last (trailer, None), validated; bytes is None for a file without a body."""
    unpress, at, n = zstandard.ZstdDecompressor(), 0, 0
    while at < len(payload):
        start = at
        if at + 8 > len(payload):
            raise DamagedContainer(f"the frame at byte {at} is cut off")
        magic, size = struct.unpack_from("<II", payload, at)
        if magic != SKIPPABLE or at + 8 + size > len(payload):
            raise DamagedContainer(f"no header frame at byte {at}")
        header = json.loads(payload[at + 8 : at + 8 + size])
        at += 8 + size
        if "files" in header:
            if header["files"] != n or at != len(payload) or xxhash.xxh3_64_intdigest(payload[:start]) != header["xxh3"]:
                raise DamagedContainer("the container's length or checksum differs")
            yield header, None
            return
        data = unpress.decompress(payload[at : at + header["packed"]], max_output_size=max(1, header["n_bytes"] or 0)) if header["packed"] else b""
        at += header["packed"]
        if len(data) != (header["n_bytes"] or 0) or xxhash.xxh3_64_intdigest(data) != header["xxh3"]:
            raise DamagedContainer(f"length or checksum of file {header['id']} differs")
        n += 1
        yield header, None if header["n_bytes"] is None else data
    raise DamagedContainer("the container has no trailer")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _parts(files: DataFrame, target_bytes: int) -> DataFrame:
    """Concatenated frames of each task's own files: full containers, and one remainder a task and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("task", pa.int32()), ("number", pa.int32()), ("kind", pa.string()), ("n_files", pa.int64()), ("n_bytes", pa.int64()), ("size", pa.int64()), ("done", pa.bool_()), ("payload", pa.binary())])
        press, task, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        open_: dict[str | None, tuple[list[bytes], list[int]]] = {}

        def closed(kind: str | None) -> pa.RecordBatch:
            nonlocal made
            parts, (size, n_bytes) = open_.pop(kind)
            made += 1
            return _batch([(task, made, kind, len(parts), n_bytes, size, 2 * size >= target_bytes, b"".join(parts))], schema)

        for batch in batches:
            for key, kind, body, carried in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = body or b""
                packed = press.compress(data) if data else b""
                head = {"id": key, "n_bytes": None if body is None else len(data), "packed": len(packed), "xxh3": xxhash.xxh3_64_intdigest(data), "carry": carried}
                piece = _skippable(head) + packed
                if kind in open_ and open_[kind][1][0] + len(piece) > target_bytes:
                    yield closed(kind)
                parts, sizes = open_.setdefault(kind, ([], [0, 0]))
                parts.append(piece)
                sizes[0] += len(piece)
                sizes[1] += len(data)
        for kind in list(open_):
            yield closed(kind)

    return files.mapInArrow(run, PART_SCHEMA)


def _placed(parts: DataFrame, target_bytes: int) -> DataFrame:
    """(task, number, box): the container of each remainder, filled one after the other within a block of tasks; only sizes are read."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["task", "number"], ignore_index=True)
        box, filled, boxes = 0, 0, []
        for size in group["size"]:
            if filled and filled + size > target_bytes:
                box, filled = box + 1, 0
            filled += size
            boxes.append(box)
        return group.assign(box=boxes)[["task", "number", "box"]]

    small = parts.where("not done").select("task", "number", "kind", "size")
    return small.groupBy("kind", F.floor(F.col("task") / TASK_BLOCK)).applyInPandas(run, "task int, number int, box int")


SEALED_SCHEMA = "kind string, n_files bigint, n_bytes bigint, size bigint, payload binary"


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, kind, box, single, n_files, n_bytes, payload): one container with its trailer for each of the first four."""
    schema = pa.schema([("kind", pa.string()), ("n_files", pa.int64()), ("n_bytes", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())])
    held: list[tuple] = []

    def one() -> pa.RecordBatch:
        payload, n_files = b"".join(x[6] for x in held), sum(x[4] for x in held)
        payload += _skippable({"files": n_files, "kind": held[0][1], "xxh3": xxhash.xxh3_64_intdigest(payload)})
        return _batch([(held[0][1], n_files, sum(x[5] for x in held), len(payload), payload)], schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:4] != held[0][:4]:
                yield one()
                held.clear()
            held.append(row)
    if held:
        yield one()


def pack(files: DataFrame, id_col: str, kind_col: str, body_col: str, carry: Sequence[str] = (), target_bytes: int = 16 << 20) -> DataFrame:
    """Containers (kind, n_files, n_bytes, size, payload) of about ``target_bytes`` at most, one kind each, from one row per file.

    First each task joins the files of its own split as they come: no sort, no parsing, memory for one open
    container a kind. A container that is at least half full is done; smaller ones are joined across tasks,
    complete frames behind complete frames, by their sizes alone. So all but the last container of a kind
    (one for each ``TASK_BLOCK`` tasks) are at least half full; only a file that is larger than a container
    has a larger one for itself. ``carry`` columns travel in the file's header. A null body is kept as such;
    a null kind makes containers of its own; an empty table makes none. Repeated rows stay repeated: nothing
    is lost or added.
    """
    columns = [F.col(id_col).alias("id"), F.col(kind_col).cast("string").alias("kind"), F.col(body_col).cast("binary").alias("body"), F.to_json(F.struct(*carry)).alias("carry") if carry else F.lit("{}").alias("carry")]
    parts = materialize(_parts(files.select(*columns), target_bytes), "parts", large_rows=True)
    whole = parts.where("done").select(F.col("task").alias("group"), "kind", F.col("number").alias("box"), F.lit(True).alias("single"), "n_files", "n_bytes", "payload")
    rest = parts.where("not done").join(_placed(parts, target_bytes), ["task", "number"])
    keys = ["group", "kind", "box"]
    rest = rest.select(F.floor(F.col("task") / TASK_BLOCK).cast("int").alias("group"), "kind", "box", F.lit(False).alias("single"), "n_files", "n_bytes", "payload")
    return whole.mapInArrow(_sealed, SEALED_SCHEMA).unionByName(rest.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sealed, SEALED_SCHEMA))


def write_containers(containers: DataFrame, path: str) -> DataFrame:
    """Write each container as a file below ``path``, a folder a kind, and return the catalogue (kind, name, n_files, n_bytes, size).

    The tasks write, under another name that becomes the file's when it is complete; names follow from the content,
    so a task that runs twice leaves one file. Equal containers are one file with two rows in the catalogue.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import quote

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
        schema = pa.schema([("kind", pa.string()), ("name", pa.string()), ("n_files", pa.int64()), ("n_bytes", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            rows = []
            for kind, n_files, n_bytes, size, payload in zip(*(c.to_pylist() for c in batch.columns)):
                folder, name = f"{root}/{'no-kind' if kind is None else 'kind-' + quote(kind, safe='')}", f"{xxhash.xxh3_128_hexdigest(payload)}.zst"
                where.create_dir(folder, recursive=True)
                trial = f"{folder}/.{uuid.uuid4().hex}"
                with where.open_output_stream(trial) as out:
                    out.write(payload)
                where.move(trial, f"{folder}/{name}")
                rows.append((kind, name, n_files, n_bytes, size))
            yield _batch(rows, schema)

    return materialize(containers.select("kind", "n_files", "n_bytes", "size", "payload").mapInArrow(run, "kind string, name string, n_files bigint, n_bytes bigint, size bigint"), "catalogue")


def read_containers(spark: SparkSession, path: str, catalogue: DataFrame) -> DataFrame:
    """(payload) of the containers below ``path``; raises DamagedContainer where one of the catalogue is gone."""
    if catalogue.isEmpty():
        return catalogue.select(F.lit(None).cast("binary").alias("payload"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").option("recursiveFileLookup", True).load(path)
    there = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    if not catalogue.join(there, "name", "left_anti").isEmpty():
        raise DamagedContainer(f"containers are missing below {path}")
    copies = catalogue.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    extra = files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).join(copies, "name").select("content", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("again"))
    return files.select(F.col("content").alias("payload")).unionByName(extra.select(F.col("content").alias("payload")))


def unpack(containers: DataFrame) -> DataFrame:
    """One row per file again, from the containers' payloads: id, kind, the carried columns as JSON text, body. Raises on damage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("carry", pa.string()), ("body", pa.binary())])
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                *held, (trailer, _) = frames(payload)
                for at in range(0, len(held), 1000):
                    yield _batch([(h["id"], trailer["kind"], h["carry"], data) for h, data in held[at : at + 1000]], schema)

    return containers.select("payload").mapInArrow(run, "id bigint, kind string, carry string, body binary")


def record_keys(files: DataFrame) -> DataFrame:
    """(file_id, kind, slide_id, record_pos, digest) of every record in unpacked stage files.

    A body that is null or not one complete JSON value gives one row with record_pos -1 and no digest.
    """
    from tessera.sources import lenient

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("slide_id", pa.string()), ("record_pos", pa.int32()), ("digest", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            for key, kind, carry, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                slide = json.loads(carry).get("slide_id")
                value = lenient.parse(None if body is None else body.decode("utf-8", "replace"))
                if value is lenient.UNREADABLE:
                    rows.append((key, kind, slide, -1, None))
                    continue
                for place, record in lenient.records(kind, value):
                    rows.append((key, kind, slide, place, xxhash.xxh3_128_digest(lenient.canonical(kind, record))))
            yield _batch(rows, schema)

    return files.mapInArrow(run, "file_id bigint, kind string, slide_id string, record_pos int, digest binary")
