"""The library's tables, derived from the driver's: once as DataFrames, once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.vectors import sign_hash


class Tables:
    """One driver directory's views, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def media(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey as id",
            "case when o_orderstatus = 'F' then 'video' else 'image' end as media_type",
            "concat('IMG_', cast(o_orderkey as string), case when o_orderstatus = 'F' then '.mp4' else '.jpg' end) as file_name",
            "cast(floor(o_totalprice) as bigint) as file_size",
            "concat(cast(o_custkey as string), '|', substr(cast(o_orderdate as string), 1, 10)) as content_key",
            "o_orderdate as created_at",
            "o_orderkey % 11 <> 0 as processed",
            "o_orderkey % 5 = 0 as favorite",
            "o_orderpriority = '5-LOW' as is_hidden",
            "case when o_orderkey % 13 = 0 then o_orderdate end as deleted_at",
        )

    @property
    def objects(self) -> DataFrame:
        part = self.read("part").select("p_partkey", "p_type", "p_size")
        return self.read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey as media_id", "l_linenumber as obj_no", "p_type as class_name", "l_discount as conf", "cast(l_quantity as double) as x", "cast(p_size as double) as y", "cast(l_quantity as double) + 1 as w", "cast(p_size as double) + 1 as h")

    @property
    def faces(self) -> DataFrame:
        supplier = self.read("supplier").select("s_suppkey", "s_name", "s_acctbal")
        return self.read("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr("l_orderkey as media_id", "l_linenumber as face_no", "l_suppkey as face_id", "case when s_acctbal > 0 then s_name end as name", "l_tax as conf")

    @property
    def person(self) -> DataFrame:
        return self.read("supplier").selectExpr("s_suppkey as face_id", "case when s_acctbal > 0 then s_name end as name", "case when s_suppkey % 3 = 0 then null else s_acctbal / 10000 end as conf")

    @property
    def album(self) -> DataFrame:
        return self.read("nation").selectExpr("n_nationkey as id", "n_name as title")

    @property
    def album_media(self) -> DataFrame:
        customer = self.read("customer").select("c_custkey", "c_nationkey")
        return self.read("orders").where("o_orderkey % 4 = 0").join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr("c_nationkey as album_id", "o_orderkey as media_id")

    @property
    def embedding(self) -> DataFrame:
        return self.read("embeddings").selectExpr("vec_id as point_id", "vec_id % 100 as media_id", "cast(floor(vec_id / 100) as bigint) as frame_idx", "case when vec_id % 3 = 0 then 'video_frame' else 'image' end as source", "embedding as vec", "label")

    @property
    def history(self) -> DataFrame:
        return self.read("events").selectExpr("event_id as id", "event_type as query", "ts as created_at", "case when user_id % 10 = 0 then ts end as deleted_at")

    @property
    def hashes(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), sign_hash(F.col("embedding")).alias("hash"))

    @property
    def cuts(self) -> DataFrame:
        """Sign-ups as cuts, by user: frames are the seconds of the hour in which they came."""
        return self.read("events").where("event_type = 'signup'").selectExpr("user_id as media_id", "cast(event_id % 9000 as bigint) as frame_idx", "9000L as total_frames")

    def vector(self, point: int) -> list[float]:
        """One query vector."""
        row = self.read("embeddings").where(F.col("vec_id") == point).select("embedding").first()
        return list(row[0]) if row else []


VIEWS = {
    "media": """select o_orderkey as id, case when o_orderstatus = 'F' then 'video' else 'image' end as media_type,
        concat('IMG_', cast(o_orderkey as varchar), case when o_orderstatus = 'F' then '.mp4' else '.jpg' end) as file_name,
        cast(floor(o_totalprice) as bigint) as file_size, concat(cast(o_custkey as varchar), '|', substr(cast(o_orderdate as varchar), 1, 10)) as content_key,
        o_orderdate as created_at, o_orderkey % 11 <> 0 as processed, o_orderkey % 5 = 0 as favorite, o_orderpriority = '5-LOW' as is_hidden,
        case when o_orderkey % 13 = 0 then o_orderdate end as deleted_at from orders""",
    "seen": "select * from media where deleted_at is null and not is_hidden",
    "media_objects": """select l_orderkey as media_id, l_linenumber as obj_no, p_type as class_name, l_discount as conf, cast(l_quantity as double) as x,
        cast(p_size as double) as y, cast(l_quantity as double) + 1 as w, cast(p_size as double) + 1 as h from lineitem join part on p_partkey = l_partkey""",
    "media_faces": "select l_orderkey as media_id, l_linenumber as face_no, l_suppkey as face_id, case when s_acctbal > 0 then s_name end as name, l_tax as conf from lineitem join supplier on s_suppkey = l_suppkey",
    "person": "select s_suppkey as face_id, case when s_acctbal > 0 then s_name end as name, case when s_suppkey % 3 = 0 then null else s_acctbal / 10000 end as conf from supplier",
    "album": "select n_nationkey as id, n_name as title from nation",
    "album_media": "select c_nationkey as album_id, o_orderkey as media_id from orders join customer on c_custkey = o_custkey where o_orderkey % 4 = 0",
    "embedding": """select vec_id as point_id, vec_id % 100 as media_id, cast(floor(vec_id / 100) as bigint) as frame_idx,
        case when vec_id % 3 = 0 then 'video_frame' else 'image' end as source, embedding::double[] as vec, label from embeddings""",
    "history": "select event_id as id, event_type as query, ts as created_at, case when user_id % 10 = 0 then ts end as deleted_at from events",
    "hashes": "select vec_id as id, list_sum(list_transform(range(0, 62), lambda i: case when embedding[i + 1] >= 0 then (1::bigint << i::bigint) else 0 end))::bigint as hash from embeddings",
    "cuts": "select distinct user_id as media_id, cast(event_id % 9000 as bigint) as frame_idx, 9000::bigint as total_frames from events where event_type = 'signup'",
}


def sql(query: str) -> str:
    """query with the views that it can use in front. It may begin with further views: 'with a as (...), ... select'."""
    views = ", ".join(f"{name} as ({text})" for name, text in VIEWS.items())
    query = query.strip()
    if query.startswith("with recursive "):
        return f"with recursive {views}, " + query.removeprefix("with recursive ")
    return f"with {views}, " + query.removeprefix("with ") if query.startswith("with ") else f"with {views} {query}"


def similarity(a: str, b: str) -> str:
    """The cosine of two double arrays, in SQL."""
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-8))"
