"""Files that tasks write: copies of listed files into the library, and one JSON document a row. Under a temporary name first, then renamed."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.checkpoints import written
from lumora.functions.scalar import base_name, media_type

PIECE = 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there. Without a scheme it is a local one, which all tasks must see."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _pieces(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            yield piece


def _sha256(fs: pafs.FileSystem, path: str) -> str:
    h = hashlib.sha256()
    for piece in _pieces(fs, path):
        h.update(piece)
    return h.hexdigest()


def place(target: str, pieces: Iterator[bytes]) -> None:
    """Writes a file in one step, as readers see it: whole, or not at all."""
    fs, path = opened(target)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part) as out:
            for piece in pieces:
                out.write(piece)
        if fs.type_name != "local" and fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_file(path)  # others don't rename over a file
        fs.move(part, path)
    except BaseException:
        if fs.get_file_info(part).type != pafs.FileType.NotFound:
            fs.delete_file(part)
        raise


def copy(source: str, target: str) -> str:
    """present if the target has the same content already (or is the source), else copied. Memory holds a piece, whatever the size."""
    (a, at), (b, to) = opened(source), opened(target)
    old, new = a.get_file_info(at), b.get_file_info(to)
    if old.type != pafs.FileType.File:
        raise FileNotFoundError(source)
    if new.type == pafs.FileType.File and new.size == old.size and (at == to or _sha256(a, at) == _sha256(b, to)):
        return "present"
    place(target, _pieces(a, at))
    return "copied"


COPIED = "position long, path string, name string, media_type string, target string, action string, message string"


def copied(spark: SparkSession, paths: list[str], library: str) -> DataFrame:
    """Copies an explicit list of files into the library, in tasks: position, path, name, media_type, target, action (copied; present: was
    there; unsupported; error, with a message). Files of one name go one after another in the list's order, so the last one stays, as
    when they were copied in turn. A rerun copies nothing. It is done when this returns; actions are kept in a table."""
    base = library.rstrip("/")
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "position long, path string")
    name = base_name(F.col("path"))
    listed = rows.select("position", "path", name.alias("name"), media_type(F.col("path")).alias("media_type"), F.concat(F.lit(base + "/"), name).alias("target"))
    n = max(1, min(len(paths), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = ["position", "path", "name", "media_type", "target", "action", "message"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            done = []
            for row in batch.to_pylist():
                try:
                    done.append((copy(row["path"], row["target"]) if row["media_type"] else "unsupported", None))
                except Exception as e:  # noqa: BLE001 - one file's failure is its row's
                    done.append(("error", f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=names)

    return written(listed.repartition(n, "target").sortWithinPartitions("target", "position").mapInArrow(run, COPIED), "copied")


def to_classify(copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What copied() gave, for ingest: (targets in the library to classify, rows with actions that are final: unsupported and error)."""
    there = F.col("action").isin("copied", "present")
    return copies.where(there).select(F.col("target").alias("path"), "name", "media_type").distinct(), copies.where(~there).select("path", "action")


def artifacts(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """One JSON document a row, <folder>/<key>.json, with all columns, nested ones as they are and nulls kept; documents of other keys stay.
    Returns key, path, bytes; done when this returns. Keys are unique and not null."""
    base = folder.rstrip("/")
    documents = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("body"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keys, paths, sizes = batch.column(0).to_pylist(), [], []
            for k, body in zip(keys, batch.column(1).to_pylist(), strict=True):
                data = body.encode()
                paths.append(f"{base}/{quote(k, safe=' ')}.json")
                sizes.append(len(data))
                place(paths[-1], iter([data]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["key", "path", "bytes"])

    return written(documents.mapInArrow(run, "key string, path string, bytes long"), "artifacts")
