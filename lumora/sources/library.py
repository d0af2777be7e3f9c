"""Sources: folders of media, known people, lists of files, pasted images, and the logs of video tools."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.functions.scalar import base_name, extension, fraction, media_type, pts_time
from lumora.functions.text import name_uuid

PASTED = ("jpg", "jpeg", "png", "webp")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder, one row each. Contents are read only where a later step selects them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def media_files(found: DataFrame) -> DataFrame:
    """path, name, size, modified_at (UTC, whole seconds), media_type, content of media files; thumbnails and debug images are left out,
    and so is what lies in the trash."""
    name = base_name(F.col("path"))
    skip = name.endswith(".thumb.jpg") | name.endswith(".debug.jpg") | F.col("path").contains("/.trash/")
    rows = found.withColumn("media_type", media_type(F.col("path"))).where(F.col("media_type").isNotNull() & ~skip)
    return rows.select("path", name.alias("name"), F.col("length").alias("size"), F.date_format(F.date_trunc("second", "modificationTime"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("modified_at"), "media_type", "content")


def with_hash(found: DataFrame) -> DataFrame:
    return found.withColumn("sha256", F.sha2("content", 256))


def _dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP, WebP or JPEG file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def dimensions(content: pd.Series) -> pd.DataFrame:
    """Nulls for videos and for what can't be read."""
    got = [(_dimensions(bytes(c)) if c is not None else None) or (None, None) for c in content]
    return pd.DataFrame(got, columns=["width", "height"]).astype("Int32")


def listed(spark: SparkSession, paths: list[str], library: str) -> DataFrame:
    """An explicit list of files: path, name, media_type, supported, and target (where a copy goes unless it is there)."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    kind = media_type(F.col("path"))
    inside = F.col("path").startswith(library.rstrip("/") + "/")
    return rows.select("path", base_name(F.col("path")).alias("name"), kind.alias("media_type"), kind.isNotNull().alias("supported"), F.when(inside, F.col("path")).otherwise(F.concat(F.lit(library.rstrip("/") + "/"), base_name(F.col("path")))).alias("target"))


def pasted(rows: DataFrame) -> DataFrame:
    """Pasted images (data: base64, ext, at: milliseconds) as name and content; other extensions are left out."""
    ext = F.lower("ext")
    return rows.where(ext.isin(*PASTED)).select(F.concat(F.lit("paste_"), F.col("at").cast("string"), F.lit("."), ext).alias("name"), F.unbase64("data").alias("content"))


def known_people(spark: SparkSession, folder: str) -> DataFrame:
    """Images of known people, <folder>/<name>/<file>: name, face_id (stable for a name), path, content."""
    found = files(spark, folder).where(extension(F.col("path")).isin("jpg", "jpeg", "png"))
    name = F.element_at(F.split("path", "/"), -2)
    return found.select(name.alias("name"), name_uuid(name).alias("face_id"), "path", "content")


def probed(rows: DataFrame, fallback: float = 30.0) -> DataFrame:
    """Probe results (media_id, rate, nb_frames, duration) as fps and total_frames."""
    fps = F.coalesce(fraction(F.col("rate")), F.lit(fallback))
    by_time = F.floor(F.coalesce(F.col("duration"), F.lit(0.0)) * fps)
    return rows.select("media_id", fps.alias("fps"), F.greatest(F.coalesce("nb_frames", F.lit(0)).cast("long"), by_time).alias("total_frames"))


def scene_cuts(lines: DataFrame, fps: Column) -> DataFrame:
    """Cuts from a tool's log (media_id, value): each frame once."""
    at = pts_time(F.col("value"))
    return lines.where(at.isNotNull()).select("media_id", F.round(at * fps).cast("long").alias("frame_idx")).distinct()


@dataclass(frozen=True)
class Settings:
    """Thresholds lie between 0 and 1, counts are 1 at least; the environment overrides the defaults."""

    face_threshold: float = 0.33
    search_threshold: float = 0.256
    search_limit: int = 10_000
    vector_size: int = 384
    threads: int = 1

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env, given = dict(os.environ if env is None else env), {}
        for name, kind in cls.__annotations__.items():
            try:
                value = (float if kind == "float" else int)(env.get(f"LUMORA_{name.upper()}", ""))
            except ValueError:
                continue
            given[name] = min(1.0, max(0.0, value)) if kind == "float" else max(1, value)
        return cls(**given)
