"""Duplicates in three stages: equal content, near perceptual hashes, similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.functions.vectors import hash_of_hex
from lumora.operators import graph
from lumora.operators.media import visible

HAMMING, COSINE = 8, 0.92
NO_FRAME = 4294967295


def exact(media: DataFrame, key: str = "content_key", media_type: str | None = None) -> DataFrame:
    """Rows (group_id, media_id) of visible media that share a content key."""
    seen = media.where(visible() if "is_hidden" in media.columns else F.lit(True)).where(F.col(key).isNotNull())
    if media_type is not None:
        seen = seen.where(F.col("media_type") == media_type)
    often = seen.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return seen.join(often, key).select(F.col(key).cast("string").alias("group_id"), F.col("id").alias("media_id"))


def grouped(members: DataFrame) -> DataFrame:
    """One row for each group: group_id, n, ids (joined text, by id)."""
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("media_id")), lambda x: x.cast("string")), ",").alias("ids"))


def of_components(pairs: DataFrame) -> DataFrame:
    """Rows (group_id, media_id) from pairs: a component's group id is its least media id."""
    return graph.components(pairs.select("a", "b")).select(F.col("root").alias("group_id"), F.col("id").alias("media_id"))


def near(hashes: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """Rows (id, hash) within `most` bits, as groups."""
    return of_components(graph.hamming_links(hashes, most, bits))


def by_hash(media: DataFrame, most: int = HAMMING, media_type: str | None = None) -> DataFrame:
    """Visible media (id, file_phash in hex; of one type, if given) whose hashes are within `most` bits, as groups."""
    seen = media.where(visible())
    if media_type is not None:
        seen = seen.where(F.col("media_type") == media_type)
    return near(seen.select("id", hash_of_hex(F.col("file_phash")).alias("hash")), most)


def representatives(embedding: DataFrame) -> DataFrame:
    """Each media's vector of the earliest frame; a point without a frame comes last; ties go to the lesser point."""
    order = F.struct(F.coalesce(F.col("frame_idx"), F.lit(NO_FRAME)), F.col("point_id"))
    return embedding.groupBy("media_id").agg(F.min_by(F.struct("point_id", "vec"), order).alias("_p")).select("media_id", F.col("_p.point_id").alias("point_id"), F.col("_p.vec").alias("vec"))


def by_vector(embedding: DataFrame, threshold: float = COSINE, media_type: str | None = None) -> DataFrame:
    """Pairs (a, b, score): a's representative against any point of b, for a < b. Videos are compared by their frames' points, all others
    by images' points; points of the other source take no part."""
    return by_any_vector(embedding.where(F.col("source") == ("video_frame" if media_type == "video" else "image")), threshold)


def by_any_vector(embedding: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Pairs (a, b, score): a's representative against any point of b, for a < b, whatever the points' sources."""
    return graph.cosine_pairs(representatives(embedding).select(F.col("media_id").alias("id"), "vec"), embedding.select(F.col("media_id").alias("id"), "vec"), threshold)


def library(media: DataFrame, embedding: DataFrame, media_type: str | None = None, most: int = HAMMING, threshold: float = COSINE) -> DataFrame:
    """The three stages over a library (kind, group_id, media_id), of one media type, if given. Equal content and near hashes look at visible
    media; vectors have no such look, but a group counts only if two of its members are still media, and only those are shown."""
    groups = of_components(by_vector(embedding, threshold, media_type))
    there = groups.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    often = there.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("group_id")
    stages = [("hash", exact(media, media_type=media_type)), ("phash", by_hash(media, most, media_type)), ("semantic", there.join(often, "group_id", "left_semi").select("group_id", "media_id"))]
    return staged(stages)


def staged(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Groups of all stages (kind, group_id, media_id), in order; a later group goes if earlier stages cover all its members."""
    out, covered = None, None
    for kind, members in stages:
        rows = members.select(F.lit(kind).alias("kind"), F.col("group_id").cast("string").alias("group_id"), "media_id")
        if out is None:
            out = rows
        else:
            marked = rows.join(covered.withColumn("_c", F.lit(True)), "media_id", "left")
            keep = marked.groupBy("group_id").agg(F.bool_and(F.coalesce("_c", F.lit(False))).alias("_all")).where(~F.col("_all")).select("group_id")
            rows = rows.join(keep, "group_id", "left_semi").select("kind", "group_id", "media_id")
            out = out.union(rows)
        covered = out.select("media_id").distinct()
    return out


def marked(members: DataFrame) -> DataFrame:
    """Every member of a group but the first is marked for deletion."""
    return members.withColumn("marked", F.row_number().over(Window.partitionBy("group_id").orderBy("media_id")) > 1)


def reclaimable(members: DataFrame, media: DataFrame) -> DataFrame:
    """How many are marked, and their size."""
    sizes = media.select(F.col("id").alias("media_id"), "file_size")
    return marked(members).where("marked").join(sizes, "media_id").agg(F.count(F.lit(1)).alias("n_marked"), F.sum("file_size").alias("bytes"))
