"""Media rows: nested rows from the flat tables, views of them, and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions import masks
from lumora.functions.scalar import join_path


def visible() -> Column:
    return F.col("deleted_at").isNull() & ~F.col("is_hidden")


def trash(media: DataFrame) -> DataFrame:
    """What was deleted, oldest deletion first; hidden or not."""
    return media.where(F.col("deleted_at").isNotNull()).orderBy("deleted_at", "id")


def hidden(media: DataFrame) -> DataFrame:
    return media.where(F.col("is_hidden") & F.col("deleted_at").isNull()).orderBy(F.desc("created_at"), "id")


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("float").alias(c) for c in "xywh"])


def children(table: DataFrame, order: str, **fields: Column) -> DataFrame:
    """media_id and its rows as one array of structs, in the given order."""
    row = F.struct(F.col(order).alias("_ord"), *[c.alias(n) for n, c in fields.items()])
    names = list(fields)
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(*[r[n].alias(n) for n in names]))
    return table.groupBy("media_id").agg(ordered.alias("rows"))


def nested(media: DataFrame, objects: DataFrame, faces: DataFrame) -> DataFrame:
    """Media with arrays of its objects and faces (empty where there are none): two joins, no query for each row."""
    rle = masks.parsed(F.col("mask_rle")) if "mask_rle" in objects.columns else F.lit(None).cast(masks.RUNS)
    o = children(objects, "obj_no", class_name=F.col("class_name"), conf=F.col("conf"), bbox=box(), mask_rle=rle)
    f = children(faces, "face_no", face_id=F.col("face_id").cast("string"), name=F.col("name"), conf=F.col("conf"))
    rows = media.join(o.select(F.col("media_id").alias("id"), F.col("rows").alias("objects")), "id", "left").join(f.select(F.col("media_id").alias("id"), F.col("rows").alias("faces")), "id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    return rows.withColumns({"objects": empty("objects"), "faces": empty("faces")})


def by_id(media: DataFrame, objects: DataFrame, faces: DataFrame, media_id: object) -> DataFrame:
    """The nested row of one id; no row if there is none. The key reaches all three scans."""
    own = lambda children: children.where(F.col("media_id") == media_id)
    return nested(media.where(F.col("id") == media_id), own(objects), own(faces))


def with_file(media: DataFrame) -> DataFrame:
    """The flat file and metadata columns that there are, as two structs."""
    own = lambda prefix: [F.col(c).alias(c.removeprefix(prefix)) for c in media.columns if c.startswith(prefix)]
    rest = [c for c in media.columns if not c.startswith(("file_", "meta_"))]
    structs = [F.struct(*own(p)).alias(n) for p, n in (("file_", "file"), ("meta_", "metadata")) if own(p)]
    return media.select(*rest, *structs)


def names(faces: Column | str) -> Column:
    """The names that aren't null."""
    return F.filter(F.transform(faces, lambda f: f["name"]), lambda n: n.isNotNull())


def result(rows: DataFrame, folder: str) -> DataFrame:
    """Search results: id, score, path, labels, names, and the nested rows."""
    return rows.select(
        "id",
        "score",
        "media_type",
        join_path(F.lit(folder), F.col("file_name")).alias("path"),
        F.transform("objects", lambda o: o["class_name"]).alias("labels"),
        names("faces").alias("names"),
        "objects",
        "faces",
        "created_at",
    )


def with_thumbnails(media: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """Videos without a thumbnail take the one of the listing (stem, cached, sibling) with the same stem."""
    from lumora.functions.scalar import resolved, stem

    found = listing.groupBy("stem").agg(F.min("cached").alias("cached"), F.min("sibling").alias("sibling"))
    joined = media.withColumn("stem", stem(F.col("file_name"))).join(found, "stem", "left")
    fallback = F.when(F.col("media_type") == "video", F.coalesce("cached", "sibling"))
    return joined.withColumn("thumbnail", resolved(F.coalesce("thumbnail", fallback), F.lit(folder))).drop("stem", "cached", "sibling")
