"""Albums: custom ones, those made of labels, and favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.media import visible


def albums(album: DataFrame, members: DataFrame, media: DataFrame) -> DataFrame:
    """Every album, newest first (where the table says when it was made), with its members (all of them, seen or not) and a cover:
    the member of the least id. Where media have thumbnails, the cover's as well."""
    thumbs = "thumbnail" in media.columns
    cover = F.struct("file_name", *(["thumbnail"] if thumbs else []))
    known = members.join(media.select(F.col("id").alias("media_id"), cover.alias("_cover")), "media_id", "left")
    by_album = known.groupBy("album_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_cover", F.when(F.col("_cover.file_name").isNotNull(), F.col("media_id"))).alias("_cover"))
    found = album.join(by_album.withColumnRenamed("album_id", "id"), "id", "left")
    found = found.orderBy(F.col("created_at").desc_nulls_last(), "id") if "created_at" in album.columns else found.orderBy("id")
    more = [F.col("_cover.thumbnail").alias("cover_thumbnail")] if thumbs else []
    return found.select("id", "title", F.coalesce("_n", F.lit(0)).alias("n_media"), F.col("_cover.file_name").alias("cover"), *more)


def photos(members: DataFrame, media: DataFrame, album_id: object) -> DataFrame:
    """An album's visible media, newest first."""
    own = members.where(F.col("album_id") == album_id).select(F.col("media_id").alias("id")).distinct()
    return media.where(visible()).join(own, "id", "left_semi").orderBy(F.col("created_at").desc_nulls_last(), "id")


def labels(media: DataFrame, objects: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """For each label of visible images: how many, the first cover, most first. A label counts once an image."""
    seen = objects.select(F.col("media_id").alias("id"), F.lower("class_name").alias("tag")).distinct()
    shown = seen.join(media.where(visible() & (F.col("media_type") != "video")).select("id", "file_name"), "id")
    found = shown.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min_by("file_name", "id").alias("cover"))
    title = F.try_element_at(F.create_map(*[F.lit(x) for p in titles.items() for x in p]), F.col("tag")) if titles else F.lit(None).cast("string")
    return found.withColumn("title", F.coalesce(title, F.col("tag"))).orderBy(F.desc("n"), "tag")


def favourites(media: DataFrame) -> DataFrame:
    """How many visible favourite images there are, and the newest as a cover."""
    fav = media.where(visible() & F.col("favorite") & (F.col("media_type") != "video"))
    return fav.agg(F.count(F.lit(1)).alias("n"), F.max_by("file_name", F.struct("created_at", -F.col("id"))).alias("cover"))


def distinct_labels(media: DataFrame, objects: DataFrame) -> DataFrame:
    shown = media.where(visible()).select(F.col("id").alias("media_id"))
    return objects.join(shown, "media_id", "left_semi").select("class_name").distinct().orderBy("class_name")


def status(person: DataFrame, faces: DataFrame, embedding: DataFrame) -> DataFrame:
    """One row: people, media with faces (seen or not), vectors."""
    one = person.agg(F.count(F.lit(1)).alias("people"))
    return one.crossJoin(faces.agg(F.countDistinct("media_id").alias("media_with_faces"))).crossJoin(embedding.agg(F.count(F.lit(1)).alias("vectors")))
