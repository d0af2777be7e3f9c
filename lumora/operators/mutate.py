"""Changes, as new snapshots: every function takes the tables that it changes and returns them changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns set where the condition holds (null counts as false)."""
    cond = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(cond, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def inserted(media: DataFrame, new: DataFrame) -> DataFrame:
    """New rows get flags of false, and no thumbnail or deletion."""
    fresh = {"processed": F.lit(False), "favorite": F.lit(False), "is_hidden": F.lit(False), "deleted_at": F.lit(None), "thumbnail": F.lit(None)}
    rows = new.withColumns({c: v.cast(media.schema[c].dataType) for c, v in fresh.items() if c in media.columns})
    rows = rows.withColumns({c: F.lit(None).cast(media.schema[c].dataType) for c in media.columns if c not in rows.columns})
    return media.unionByName(rows.select(*media.columns))


def reset(media: DataFrame, objects: DataFrame, faces: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose file has changed take the new values (id and columns of media), are not processed, and lose objects, faces and
    thumbnail. Favourite, hidden and deleted stay."""
    values = [c for c in files.columns if c != "id"]
    new = files.select("id", F.struct(*values).alias("_f"))
    hit = F.col("_f").isNotNull()
    out = media.join(new, "id", "left")
    out = out.withColumns({c: F.when(hit, F.col(f"_f.{c}")).otherwise(F.col(c)) for c in values})
    out = out.withColumn("processed", F.col("processed") & ~hit)
    if "thumbnail" in media.columns:
        out = out.withColumn("thumbnail", F.when(~hit, F.col("thumbnail")))
    gone = files.select(F.col("id").alias("media_id")).distinct()
    return out.select(*media.columns), objects.join(gone, "media_id", "left_anti"), faces.join(gone, "media_id", "left_anti")


def analysed(media: DataFrame, objects: DataFrame, faces: DataFrame, done: DataFrame, new_objects: DataFrame, new_faces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of analysis: done (media_id, thumbnail) are processed, and their objects and faces are those given. A null
    thumbnail leaves the old one."""
    touched = done.select("media_id").distinct()
    out = media.join(done.select(F.col("media_id").alias("id"), F.col("thumbnail").alias("_t"), F.lit(True).alias("_done")), "id", "left")
    out = out.withColumn("processed", F.col("processed") | F.coalesce("_done", F.lit(False))).withColumn("thumbnail", F.coalesce("_t", "thumbnail"))
    replace = lambda old, new: old.join(touched, "media_id", "left_anti").unionByName(new.join(touched, "media_id", "left_semi"))
    return out.select(*media.columns), replace(objects, new_objects), replace(faces, new_faces)


def processed(media: DataFrame, ids: list, flag: bool = True) -> DataFrame:
    return changed(media, F.col("id").isin(ids), processed=F.lit(flag))


def favourite_toggled(media: DataFrame, media_id: object) -> DataFrame:
    """An unknown id is an error."""
    if not media.where(F.col("id") == media_id).limit(1).count():
        raise KeyError(media_id)
    return changed(media, F.col("id") == media_id, favorite=~F.col("favorite"))


def trashed(media: DataFrame, ids: list, now: Column) -> DataFrame:
    return changed(media, F.col("id").isin(ids), deleted_at=now)


def restored(media: DataFrame, ids: list) -> DataFrame:
    return changed(media, F.col("id").isin(ids), deleted_at=F.lit(None))


def emptied(media: DataFrame) -> DataFrame:
    return media.where(F.col("deleted_at").isNull())


def purged(media: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """What was deleted more than `days` days before now goes."""
    return media.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= now - F.make_dt_interval(F.lit(days))))


def deleted(media: DataFrame, media_id: object, only_trashed: bool = True) -> DataFrame:
    """One row goes for good, if it is in the trash (or whether or not)."""
    hit = F.col("id").eqNullSafe(media_id)
    return media.where(~(hit & F.col("deleted_at").isNotNull()) if only_trashed else ~hit)


def hidden(media: DataFrame, ids: list, flag: bool = True) -> DataFrame:
    return changed(media, F.col("id").isin(ids), is_hidden=F.lit(flag))


def cascaded(media: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Children (with media_id) of media that are still there."""
    ids = media.select(F.col("id").alias("media_id"))
    return [c.join(ids, "media_id", "left_semi") for c in children]


def cleared(*tables: DataFrame) -> list[DataFrame]:
    return [t.limit(0) for t in tables]


def album_created(album: DataFrame, title: str, now: Column) -> DataFrame:
    row = album.sparkSession.range(1).select(F.expr("uuid()").alias("id"), F.lit(title).alias("title"), now.cast("string").alias("created_at"))
    return album.unionByName(row.select(*[F.col(c).cast(album.schema[c].dataType) for c in album.columns]))


def members_added(members: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs that are there already stay one."""
    return members.unionByName(new.select(*members.columns)).dropDuplicates(["album_id", "media_id"])


def members_removed(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("album_id", "media_id"), ["album_id", "media_id"], "left_anti")


def album_deleted(album: DataFrame, members: DataFrame, album_id: object) -> tuple[DataFrame, DataFrame]:
    return album.where(~F.col("id").eqNullSafe(album_id)), members.where(~F.col("album_id").eqNullSafe(album_id))


def vectors_added(embedding: DataFrame, new: DataFrame, width: int | None = None) -> DataFrame:
    """New points get random ids. A vector of another width is an error when the table is written."""
    rows = new.withColumn("point_id", F.expr("uuid()"))
    if width is not None:
        rows = rows.withColumn("vec", F.when(F.size("vec") == width, F.col("vec")).otherwise(F.raise_error(F.lit(f"vectors must have {width} components")).cast("array<float>")))
    return embedding.unionByName(rows.select(*embedding.columns))


def vectors_of_removed(embedding: DataFrame, media_ids: DataFrame) -> DataFrame:
    return embedding.join(media_ids.select("media_id"), "media_id", "left_anti")


def history_added(history: DataFrame, row: dict) -> DataFrame:
    """Appends a search; unlike the text of the query, its filters are kept too, where given."""
    one = history.sparkSession.createDataFrame([tuple(row.get(c) for c in history.columns)], history.schema)
    return history.unionByName(one)


def configured(config: DataFrame, source_dir: str, now: Column) -> DataFrame:
    """The one row of settings, replaced."""
    return config.sparkSession.range(1).select(F.lit("main").alias("id"), F.lit(source_dir).alias("source_dir"), now.cast("string").alias("updated_at"))
