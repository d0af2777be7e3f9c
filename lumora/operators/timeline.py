"""Timelines, histograms and the client's list filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.functions.scalar import base_name, contains_ignoring_case, day_key, month_label, year_month_of
from lumora.operators.media import visible

LIMIT = 5000


def items(media: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest visible, processed media with ord (their place), y, m and label."""
    text = F.substring(F.col("created_at").cast("string"), 1, 19)
    modified = F.col("modified_at").cast("string") if "modified_at" in media.columns else F.lit(None).cast("string")
    newest = media.where(visible() & F.col("processed")).orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit)
    ranked = newest.withColumn("ord", F.row_number().over(Window.orderBy(F.col("created_at").desc_nulls_last(), "id")))  # at most `limit` rows
    when = ranked.withColumn("_ym", year_month_of(text, modified))
    return when.withColumns({"y": F.col("_ym.y"), "m": F.col("_ym.m")}).withColumn("label", month_label(F.col("y"), F.col("m"))).drop("_ym")


def projected(found: DataFrame, faces: DataFrame) -> DataFrame:
    """Timeline items as the client takes them: id, file_name, media_type, created_at, favorite, is_hidden, ord, y, m, label, and face_ids (each
    once, sorted; empty if there is none). At most the timeline's limit of items meet the faces."""
    who = faces.join(found.select(F.col("id").alias("media_id")), "media_id", "left_semi").groupBy(F.col("media_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("face_id").cast("string"))).alias("face_ids"))
    return found.join(who, "id", "left").select("id", "file_name", "media_type", "created_at", "favorite", "is_hidden", "ord", "y", "m", "label", F.coalesce("face_ids", F.array().cast("array<string>")).alias("face_ids"))


def months(found: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each month, latest first: y, m, label, n, and its items in the order in which they came."""
    row = F.struct("ord", *fields)
    return found.groupBy("y", "m", "label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("items")).orderBy(F.desc("y"), F.desc("m"))


def flat(groups: DataFrame) -> DataFrame:
    """Month groups back to items."""
    return groups.select("y", "m", "label", F.inline("items"))


def first_of_year(groups: DataFrame) -> DataFrame:
    """Marks each year's first section in display order. One row a month, so that one task orders them all."""
    return groups.withColumn("first_of_year", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("m"))) == 1)


def text_box(query: str, media_type: str | None = None) -> Column:
    """The timeline's box on rows with labels, people, path. A media type tab takes its place."""
    if media_type is not None:
        video = F.coalesce(F.col("media_type") == "video", F.lit(False))
        return video if media_type == "video" else ~video
    if not query.strip():
        return F.lit(True)
    needle = F.lit(query)
    has = lambda c: F.exists(c, lambda x: F.coalesce(contains_ignoring_case(x, needle), F.lit(False)))
    return has("labels") | has("people") | contains_ignoring_case(F.col("path"), needle)


def flat_filter(query: str, media_type: str | None = None) -> Column:
    """The flat list's filter on rows with labels, objects, id. A media type tab takes its place."""
    if media_type is not None or not query.strip():
        return text_box("", media_type)
    needle = F.lit(query)
    has = lambda c: F.exists(c, lambda x: F.coalesce(contains_ignoring_case(x, needle), F.lit(False)))
    return F.coalesce(has("labels"), F.lit(False)) | F.coalesce(has("objects"), F.lit(False)) | contains_ignoring_case(F.col("id").cast("string"), needle)


def picker(query: str, name: str = "class_name") -> Column:
    """The label picker's filter."""
    return contains_ignoring_case(F.col(name), F.lit(query)) if query else F.lit(True)


def among(groups: DataFrame, shown: DataFrame) -> DataFrame:
    """Month groups with only those items (field id) that are among the rows shown; groups without one go."""
    kept = flat(groups).join(shown.select("id").distinct(), "id", "left_semi")
    fields = [f.name for f in groups.schema["items"].dataType.elementType]
    return kept.groupBy("y", "m", "label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*fields))).alias("items")).orderBy(F.desc("y"), F.desc("m"))


# What screenshots' paths and names hold.
SCREENSHOT_PATHS = ("screenshot", "screen-capture", "screencast", "ảnh chụp màn hình", "screenshots")
SCREENSHOT_START, SCREENSHOT_NAME = "scr_", "screen_shot"


def screenshot(path: Column) -> Column:
    low = F.lower(path)
    name = base_name(F.replace(low, F.lit("\\"), F.lit("/")))
    keep = name.startswith(SCREENSHOT_START) | name.contains(SCREENSHOT_NAME)
    for part in SCREENSHOT_PATHS:
        keep |= low.contains(part)
    return keep


def gallery(kind: str, payload: str | None = None) -> Column:
    """The client's gallery filters, on rows with media_type, favorite, labels, face_ids, people, path."""
    video = F.coalesce(F.col("media_type") == "video", F.lit(False))
    if kind == "favorites":
        return F.col("favorite") & {"photos": ~video, "videos": video}.get(payload or "", F.lit(True))
    if kind == "videos":
        return video
    if kind == "person":
        return F.array_contains("face_ids", payload or "") | F.array_contains("people", payload or "")
    if kind == "album":
        if payload == "fav":
            return ~video & F.col("favorite")
        if payload == "scr":
            return ~video & screenshot(F.col("path"))
        if payload and payload.startswith("tag_"):
            return ~video & F.array_contains(F.transform("labels", F.lower), payload.removeprefix("tag_"))
        return ~video
    return F.lit(True)


def monthly(media: DataFrame) -> DataFrame:
    return media.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def daily(media: DataFrame) -> DataFrame:
    """By day, keyed as text without padding, latest text first."""
    at = F.col("created_at")
    return media.groupBy(day_key(F.year(at), F.month(at), F.dayofmonth(at)).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day"))
