"""People: their roll-up from faces, and changes to identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.operators.media import visible

#: Rows of faces, or of media, that meet in one part, about; and the parts that fewer are cut into, so that tasks share them.
ROWS, SPREAD = 1_200_000, 8


def candidates(faces: DataFrame) -> DataFrame:
    """What a media's faces say of persons: face_id, conf, face_bbox."""
    return faces.select("face_id", "conf", F.struct("x", "y", "w", "h").alias("face_bbox"))


def people(faces: DataFrame, media: DataFrame, person: DataFrame) -> DataFrame:
    """One row for each face id with a visible face, most photos first, then by face id: photos (distinct contents), cover, and the
    person's own values first. Where the tables have them, also face_bbox (the person's, else the best face's) and thumbnail.

    The best face is that of the highest confidence; ties go to the lesser media id, then the lesser face number.
    """
    seen = faces.join(media.where(visible()).select(F.col("id").alias("media_id"), "content_key", "file_name"), "media_id")
    order = F.struct(F.coalesce("conf", F.lit(-1.0)), -F.col("media_id"), -F.col("face_no"))
    boxed = {"x", "y", "w", "h"} <= set(faces.columns)
    box = [F.struct("x", "y", "w", "h").alias("box")] if boxed else []
    by_face = seen.groupBy("face_id").agg(
        F.countDistinct("content_key").alias("photo_count"),
        F.max_by(F.struct("file_name", "conf", "media_id", *box), order).alias("_best"),
        F.min_by("file_name", F.struct("media_id", "face_no")).alias("first_file"),
    )
    further = [F.col(c).alias(f"_{c}") for c in ("face_bbox", "thumbnail") if c in person.columns]
    own = person.select("face_id", F.col("name").alias("_name"), F.col("conf").alias("_conf"), *further)
    added = []
    if "face_bbox" in person.columns or boxed:
        added.append(F.coalesce(*[F.col(c) for c, there in (("_face_bbox", "face_bbox" in person.columns), ("_best.box", boxed)) if there]).alias("face_bbox"))
    if "thumbnail" in person.columns:
        added.append(F.col("_thumbnail").alias("thumbnail"))
    rows = by_face.join(own, "face_id", "left").select(
        "face_id",
        F.col("_name").alias("name"),
        "photo_count",
        F.coalesce("_conf", "_best.conf").alias("conf"),
        F.coalesce(F.col("_best.file_name"), F.col("first_file")).alias("cover"),
        F.col("_best.media_id").alias("best_media_id"),
        *added,
    )
    return rows.orderBy(F.desc("photo_count"), "face_id")


def named_in_rows(rows: DataFrame, face_id: object, name: str) -> DataFrame:
    """Nested media rows with the name of one identity set in their arrays of faces; other elements and fields stay."""
    give = lambda f: F.when(f["face_id"].eqNullSafe(F.lit(face_id)), f.withField("name", F.lit(name))).otherwise(f)
    return rows.withColumn("faces", F.transform("faces", give))


def photos_of(faces: DataFrame, media: DataFrame, person: DataFrame) -> DataFrame:
    """Every person with the number of visible media that show them, 0 included.

    Faces meet their media in parts of about ROWS rows, whatever the tables' size, and repeats are told by order there: a task sorts a part
    of either table and holds no table of all pairs.
    """
    n = max(faces.count(), media.count())
    parts = max(-(-n // ROWS), min(SPREAD, 1 + n // 65_536))
    dealt = faces.select("media_id", "face_id").repartition(parts, "media_id")
    once = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("media_id", "face_id").orderBy("face_id"))).where("_k = 1")
    seen = media.where(visible()).select(F.col("id").alias("media_id")).repartition(parts, "media_id")
    shown = once.join(seen, "media_id", "left_semi").groupBy("face_id").agg(F.count("media_id").alias("_n"))
    return person.join(shown, "face_id", "left").select("face_id", "name", F.coalesce("_n", F.lit(0)).alias("photos"))


def merged(person: DataFrame, new: DataFrame) -> DataFrame:
    """person after new candidates (face_id, name, conf and further columns, ord), taken in the order of ord.

    A new id is added. A candidate of strictly higher confidence, or the first with one, replaces all values, and the name if it
    has one; any other only gives its name, if it has one. All candidates of an id fold into one state: the highest confidence,
    the person's own and then the earliest first among equals, and the last name given.
    """
    values = [c for c in person.columns if c not in ("face_id", "name")]
    old = person.select("*", F.lit(-1).cast("long").alias("ord"))
    every = old.unionByName(new.select(*person.columns, F.col("ord").cast("long")))
    rank = F.struct(F.col("conf").isNotNull(), F.coalesce("conf", F.lit(0.0)), -F.col("ord"))
    folded = every.groupBy("face_id").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"),
        F.max_by(F.struct(*values), rank).alias("_v"),
    )
    return folded.select(*[F.col(c) if c in ("face_id", "name") else F.col(f"_v.{c}") for c in person.columns])


def renamed(person: DataFrame, faces: DataFrame, face_id: object, name: str) -> tuple[DataFrame, DataFrame]:
    give = lambda df: df.withColumn("name", F.when(F.col("face_id") == face_id, F.lit(name)).otherwise(F.col("name")))
    return give(person), give(faces)


def joined(person: DataFrame, faces: DataFrame, target: object, source: object) -> tuple[DataFrame, DataFrame]:
    """source becomes target: its faces move, its person goes; target's name, else source's, is given to all."""
    ids = person.where(F.col("face_id").isin(target, source))
    name = ids.agg(F.coalesce(F.max(F.when(F.col("face_id") == target, F.col("name"))), F.max(F.when(F.col("face_id") == source, F.col("name")))).alias("_n"))
    one = F.broadcast(name)
    who = person.where(~F.col("face_id").eqNullSafe(source)).crossJoin(one).withColumn("name", F.when(F.col("face_id").eqNullSafe(target) & F.col("_n").isNotNull(), F.col("_n")).otherwise(F.col("name"))).drop("_n")
    both = F.coalesce(F.col("face_id").isin(target, source), F.lit(False))
    moved = faces.crossJoin(one).withColumn("name", F.when(both, F.col("_n")).otherwise(F.col("name"))).withColumn("face_id", F.when(both, F.lit(target)).otherwise(F.col("face_id"))).drop("_n")
    return who, moved.select(*faces.columns)


def without(person: DataFrame, faces: DataFrame, face_id: object) -> tuple[DataFrame, DataFrame]:
    keep = ~F.col("face_id").eqNullSafe(face_id)
    return person.where(keep), faces.where(keep)


def without_in(faces: DataFrame, face_id: object, media_id: object) -> DataFrame:
    """All of one identity's boxes in one media go."""
    return faces.where(~(F.col("face_id").eqNullSafe(face_id) & F.col("media_id").eqNullSafe(media_id)))
