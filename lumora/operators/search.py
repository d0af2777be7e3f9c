"""Search: vector hits, their resolution to media, and the six modes.

Limits come before residual filters where the product has them so; Catalyst doesn't move a filter below a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions import vectors
from lumora.functions.scalar import contains_ignoring_case, equals_ignoring_ascii_case, year_month
from lumora.operators.media import visible

THRESHOLD, TOP = 0.256, 10_000
LIMIT_EXACT, LIMIT_FILTER = 100, 200


@dataclass(frozen=True)
class Filters:
    object: str | None = None
    face: str | None = None
    month: int | None = None
    year: int | None = None
    media_type: str | None = None

    @property
    def active(self) -> int:
        return sum(x is not None for x in (self.object, self.face, self.month, self.year, self.media_type))


def residual(filters: Filters) -> Column:
    """The filters on nested rows (objects, faces, media_type, created_at). Object and face match parts of names."""
    keep = F.lit(True)
    if filters.object is not None:
        keep &= F.exists("objects", lambda o: F.coalesce(contains_ignoring_case(o["class_name"], F.lit(filters.object)), F.lit(False)))
    if filters.face is not None:
        named = lambda f: F.coalesce(contains_ignoring_case(f["name"], F.lit(filters.face)), F.lit(False))
        keep &= F.exists("faces", lambda f: named(f) | equals_ignoring_ascii_case(f["face_id"], F.lit(filters.face)))
    if filters.media_type is not None:
        keep &= F.col("media_type") == {"photo": "image"}.get(filters.media_type, filters.media_type)
    when = year_month(F.substring(F.col("created_at").cast("string"), 1, 19))
    if filters.month is not None:
        keep &= F.coalesce(when["m"] == filters.month, F.lit(False))
    if filters.year is not None:
        keep &= F.coalesce(when["y"] == filters.year, F.lit(False))
    return keep


def top_hits(embedding: DataFrame, query: list[float], threshold: float = THRESHOLD, limit: int = TOP, payload: Column | None = None) -> DataFrame:
    """Points (point_id, media_id, score) at or above the threshold, best first. Ties go to the lesser point."""
    points = embedding if payload is None else embedding.where(payload)
    hits = vectors.scored(points.select("point_id", "media_id", "vec"), query).select("point_id", "media_id", "score")
    return hits.where(F.col("score") >= threshold).orderBy(F.desc("score"), "point_id").limit(limit)


def resolve(hits: DataFrame, media: DataFrame, ordered: bool = True) -> DataFrame:
    """The visible media of hits, each with its best score (0 at least), best first (in no order where further joins follow)."""
    best = hits.groupBy("media_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    found = media.where(visible()).join(best.withColumnRenamed("media_id", "id"), "id")
    return found.orderBy(F.desc("score"), "id") if ordered else found


def combined(text_hits: DataFrame, image_hits: DataFrame) -> DataFrame:
    """Media that both searches hit: the mean of an image hit's score and the text side's lowest one."""
    low = text_hits.groupBy("media_id").agg(F.min("score").alias("_text"))
    return image_hits.join(low, "media_id").withColumn("score", (F.col("score") + F.col("_text")) / 2).drop("_text")


def _newest(media: DataFrame, limit: int) -> DataFrame:
    return media.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit)


def by_object(media: DataFrame, objects: DataFrame, name: str) -> DataFrame:
    """The newest visible media with an object of exactly this label."""
    found = objects.where(F.col("class_name") == name).select(F.col("media_id").alias("id"))
    return _newest(media.where(visible()).join(found, "id", "left_semi"), LIMIT_EXACT)


def by_face(media: DataFrame, faces: DataFrame, who: str) -> DataFrame:
    """The newest visible media with a face of exactly this id or name."""
    found = faces.where((F.col("face_id").cast("string") == who) | (F.col("name") == who)).select(F.col("media_id").alias("id"))
    return _newest(media.where(visible()).join(found, "id", "left_semi"), LIMIT_EXACT)


def newest(media: DataFrame) -> DataFrame:
    return _newest(media.where(visible()), LIMIT_FILTER)


def mode(text: bool, image: bool, filters: Filters) -> str:
    """Which search the given inputs ask for."""
    if text or image:
        return "combined" if text and image else "image" if image else "text"
    return "object" if filters.object else "face" if filters.face else "filter"


def history(rows: DataFrame, limit: int = 20) -> DataFrame:
    kept = rows.where(F.col("deleted_at").isNull()).orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).limit(limit)
    return kept.select(*[c for c in ("id", "query", "image_path", "created_at") if c in rows.columns])


def suggestions(rows: DataFrame, limit: int = 8) -> DataFrame:
    """The last few searches, of which those without a text are then left out."""
    return history(rows, limit).where(F.coalesce(F.trim("query"), F.lit("")) != "")
