"""Video: scenes from cuts, sampled frames, and roll-ups of what the frames show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARES = (0.2, 0.5, 0.8)


def scenes(cuts: DataFrame) -> DataFrame:
    """cuts: media_id, frame_idx, total_frames. Returns media_id, scene, first, last: up to each cut, and the tail."""
    by_media = Window.partitionBy("media_id").orderBy("frame_idx")
    distinct = cuts.select("media_id", "frame_idx", "total_frames").distinct()
    before = distinct.select("media_id", (F.row_number().over(by_media) - 1).alias("scene"), F.lag("frame_idx", 1, 0).over(by_media).alias("first"), F.greatest(F.col("frame_idx") - 1, F.lit(0)).alias("last"))
    tail = distinct.groupBy("media_id").agg(F.count(F.lit(1)).cast("int").alias("scene"), F.max("frame_idx").alias("first"), F.greatest(F.max("total_frames") - 1, F.lit(0)).alias("last"))
    return before.unionByName(tail)


def samples(found: DataFrame) -> DataFrame:
    """Frames at fixed shares of each scene's length, each once: media_id, scene, frame, ord."""
    length = F.greatest(F.col("last") - F.col("first"), F.lit(0))
    at = F.array_distinct(F.array(*[F.col("first") + F.floor(length * s) for s in SHARES]))
    return found.select("media_id", "scene", F.posexplode(at).alias("ord", "frame"))


def kept(frames: DataFrame) -> DataFrame:
    """frames: media_id, scene, ord, frame, luma (null: unreadable, passes). All good ones, else the one nearest to 128."""
    value = F.coalesce("luma", F.lit(128.0))
    scene = Window.partitionBy("media_id", "scene")
    nearest = F.row_number().over(scene.orderBy(F.abs(value - 128), "ord")) == 1
    rows = frames.withColumns({"_good": value.between(25, 240), "_nearest": nearest}).withColumn("_any", F.bool_or("_good").over(scene))
    return rows.where(F.col("_good") | (~F.col("_any") & F.col("_nearest"))).drop("_good", "_nearest", "_any")


def scene_of(frames: DataFrame, found: DataFrame) -> DataFrame:
    """Each frame (media_id, frame) with its first scene that holds it, or 0."""
    held = frames.join(found, "media_id", "left").where(F.col("frame").between(F.col("first"), F.col("last")))
    first = held.groupBy("media_id", "frame").agg(F.min("scene").alias("scene"))
    return frames.join(first, ["media_id", "frame"], "left").withColumn("scene", F.coalesce("scene", F.lit(0)))


def objects(detections: DataFrame, order: str = "frame_idx") -> DataFrame:
    """Each label's best detection in a video: of the highest confidence above 0, the earliest first; else the first one's box."""
    rank = F.struct(F.greatest(F.col("conf"), F.lit(0.0)), -F.col(order), -F.col("x"), -F.col("y"))
    fields = [c for c in ("x", "y", "w", "h", "mask_area", "mask_rle") if c in detections.columns]
    best = detections.groupBy("media_id", "class_name").agg(F.greatest(F.max("conf"), F.lit(0.0)).alias("conf"), F.max_by(F.struct(*fields, order), rank).alias("_b"))
    return best.select("media_id", "class_name", "conf", *[F.col(f"_b.{c}").alias(c) for c in fields], F.col(f"_b.{order}").alias("best_frame"))


def faces(detections: DataFrame, order: str = "frame_idx") -> DataFrame:
    """Each face's highest confidence, its name there, and the frame."""
    rank = F.struct(F.greatest(F.col("conf"), F.lit(0.0)), -F.col(order))
    return detections.groupBy("media_id", "face_id").agg(F.greatest(F.max("conf"), F.lit(0.0)).alias("conf"), F.max_by(F.struct("name", order), rank).alias("_b")).select("media_id", "face_id", "conf", F.col("_b.name").alias("name"), F.col(f"_b.{order}").alias("best_frame"))


def thumbnail(frames: DataFrame) -> DataFrame:
    """The first frame that was worked on."""
    return frames.groupBy("media_id").agg(F.min_by("frame", F.struct("scene", "ord")).alias("frame"))
