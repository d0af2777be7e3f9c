"""Ingest: what to do with each file, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Which actions each counter counts.
ACTIONS = {"new": ("insert", "reprocess", "reset"), "skipped": ("skip", "unsupported"), "errors": ("error",)}


def classified(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, name, size, modified_at, sha256) with action and media_id.

    A file known by name, size and time (null-safe) is skipped, or reprocessed if its row isn't processed; so is one known by name
    and content; one known by name only resets its row; any other is inserted. The least id wins among equals.
    """
    pick = lambda cond_cols: F.min_by(F.struct("id", "processed"), "id")  # noqa: E731, ARG005
    row = known.select("id", F.col("file_name").alias("name"), F.col("file_size").alias("size"), F.col("meta_modified_at").alias("modified_at"), F.col("file_sha256").alias("sha256"), "processed")
    meta = row.groupBy("name", "size", "modified_at").agg(pick(None).alias("_meta"))
    hashed = row.where(F.col("sha256").isNotNull()).groupBy("name", "sha256").agg(pick(None).alias("_hash"))
    named = row.groupBy("name").agg(pick(None).alias("_name"))
    f, m = files.alias("f"), meta.alias("m")
    joined = f.join(m, (F.col("f.name") == F.col("m.name")) & (F.col("f.size") == F.col("m.size")) & F.col("f.modified_at").eqNullSafe(F.col("m.modified_at")), "left").select("f.*", "m._meta")
    joined = joined.join(hashed, ["name", "sha256"], "left").join(named, "name", "left")
    known_as = F.coalesce("_meta", "_hash")
    action = F.when(known_as.isNotNull(), F.when(known_as["processed"], F.lit("skip")).otherwise(F.lit("reprocess"))).when(F.col("_name").isNotNull(), F.lit("reset")).otherwise(F.lit("insert"))
    return joined.select(*files.columns, action.alias("action"), F.coalesce(known_as["id"], F.col("_name.id")).alias("media_id"))


def unhashed(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files that metadata alone doesn't settle: only their contents need to be read and hashed."""
    k = known.select(F.col("file_name").alias("_n"), F.col("file_size").alias("_s"), F.col("meta_modified_at").alias("_m"))
    return files.join(k, (F.col("name") == F.col("_n")) & (F.col("size") == F.col("_s")) & F.col("modified_at").eqNullSafe(F.col("_m")), "left_anti")


def summary(actions: DataFrame) -> DataFrame:
    """One row: found, new (reprocessed and reset ones as well), skipped (unsupported ones as well), errors."""
    n = lambda *a: F.coalesce(F.sum(F.when(F.col("action").isin(*a), 1).otherwise(0)), F.lit(0)).cast("long")
    return actions.agg(F.count(F.lit(1)).alias("found"), *[n(*kinds).alias(c) for c, kinds in ACTIONS.items()])


def pruned(media: DataFrame, listing: DataFrame, key: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(media whose file is gone, media whose file is there). Trashed media keep their rows: their files lie elsewhere."""
    there = listing.select(F.col("name").alias(key)).distinct()
    live = media.where(F.col("deleted_at").isNull())
    return live.join(there, key, "left_anti"), live.join(there, key, "left_semi").unionByName(media.where(F.col("deleted_at").isNotNull()))


def work_list(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Images, then videos, each by path."""
    return images.withColumn("_kind", F.lit(0)).unionByName(videos.withColumn("_kind", F.lit(1))).orderBy("_kind", "path").drop("_kind")
