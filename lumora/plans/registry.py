"""All queries by name, and the SQL that each is held against. Names begin with the operator's number in the inventory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.checkpoints import shared_root, written
from lumora.functions import labels, masks, scalar, text, vectors
from lumora.operators import albums, detect, duplicates, graph, index, ingest, media, mutate, people, search, timeline, video
from lumora.plans.fixtures import Tables, similarity, sql
from lumora.sources import library
from lumora.streaming import session, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Thresholds that the driver's vectors reach; the operators' defaults are the product's.
NEAR, ALIKE, BITS = 0.2, 0.4, 18
FOLDER = "/library/"
NOW = "1997-01-01 00:00:00"


def query(name: str, oracle: str | None = None):
    """Registers a function of the tables under a name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


def _hits(point: int, view: str) -> str:
    s = similarity("e.vec", "q.vec")
    return f"{view} as (select e.point_id, e.media_id, {s} as score from embedding e, (select vec from embedding where point_id = {point}) q where {s} >= {NEAR} order by score desc, point_id limit 10000)"


def _score(column: str = "score"):
    return F.round(column, 6).alias("score")


def _names(column: str, out: str):
    return F.array_join(F.array_sort(column), ",").alias(out)


# --- search


@query(
    "search_text_filtered",
    f"""with {_hits(0, "hits")}, best as (select media_id, greatest(max(score), 0) as score from hits group by 1)
    select m.id, round(b.score, 6) as score, m.media_type, '/library/' || file_name as path,
        coalesce((select string_agg(class_name, ',' order by class_name) from media_objects o where o.media_id = m.id), '') as labels,
        coalesce((select string_agg(name, ',' order by name) from media_faces f where f.media_id = m.id), '') as names
    from best b join seen m on m.id = b.media_id
    where media_type = 'image' and year(created_at) between 1992 and 1998
        and exists (select 1 from media_objects o where o.media_id = m.id and contains(lower(class_name), 'a'))""",
)
def search_text_filtered(t: Tables) -> DataFrame:
    # The hits (search.TOP at most) are scored and resolved once; three branches read what was written.
    found = written(search.resolve(search.top_hits(t.embedding, t.vector(0), NEAR), t.media, ordered=False), "hits")
    ids = found.select(F.col("id").alias("media_id"))
    rows = media.nested(found, t.objects.join(ids, "media_id", "left_semi"), t.faces.join(ids, "media_id", "left_semi"))
    kept = rows.where(search.residual(search.Filters(object="A", media_type="photo")) & F.year("created_at").between(1992, 1998))
    return media.result(kept, FOLDER).select("id", _score(), "media_type", "path", _names("labels", "labels"), _names("names", "names")).orderBy(F.desc("score"), "id")


@query("l02_topk_cosine", f"""with s as (select point_id, media_id, {similarity("e.vec", "q.vec")} as score from embedding e, (select vec from embedding where point_id = 0) q) select point_id, media_id, round(score, 6) as score from s where score >= {NEAR} order by s.score desc, point_id limit 20""")
def l02_topk_cosine(t: Tables) -> DataFrame:
    return search.top_hits(t.embedding, t.vector(0), NEAR, 20).select("point_id", "media_id", _score())


@query("f15_payload_hits", f"""with s as (select point_id, media_id, {similarity("e.vec", "q.vec")} as score from embedding e, (select vec from embedding where point_id = 3) q where source = 'image') select point_id, media_id, round(score, 6) as score from s where score >= {NEAR}""")
def f15_payload_hits(t: Tables) -> DataFrame:
    return search.top_hits(t.embedding, t.vector(3), NEAR, payload=F.col("source") == "image").select("point_id", "media_id", _score())


@query("j07_resolve_hits", f"with {_hits(0, 'hits')} select m.id, round(greatest(max(score), 0), 6) as score from hits join seen m on m.id = media_id group by 1")
def j07_resolve_hits(t: Tables) -> DataFrame:
    return search.resolve(search.top_hits(t.embedding, t.vector(0), NEAR), t.media).select("id", _score())


@query(
    "j08_combined",
    f"""with {_hits(0, "texts")}, {_hits(1, "images")}, low as (select media_id, min(score) as s from texts group by 1),
    mean as (select i.media_id, (i.score + low.s) / 2 as score from images i join low on i.media_id = low.media_id)
    select m.id, round(greatest(max(score), 0), 6) as score from mean join seen m on m.id = media_id group by 1""",
)
def j08_combined(t: Tables) -> DataFrame:
    e = t.embedding
    return search.resolve(search.combined(search.top_hits(e, t.vector(0), NEAR), search.top_hits(e, t.vector(1), NEAR)), t.media).select("id", _score())


@query("f09_object_search", "with hit as (select * from seen where id in (select media_id from media_objects where class_name = 'ECONOMY') order by created_at desc nulls last, id limit 100) select id, media_type, created_at from hit where media_type = 'image'")
def f09_object_search(t: Tables) -> DataFrame:
    return search.by_object(t.media, t.objects, "ECONOMY").where("media_type = 'image'").select("id", "media_type", "created_at")


@query("f10_face_search", "with hit as (select * from seen where id in (select media_id from media_faces where cast(face_id as varchar) = '7' or name = '7') order by created_at desc nulls last, id limit 100) select id, media_type, created_at from hit where year(created_at) >= 1993")
def f10_face_search(t: Tables) -> DataFrame:
    return search.by_face(t.media, t.faces, "7").where(F.year("created_at") >= 1993).select("id", "media_type", "created_at")


@query(
    "f11_filter_only",
    """with hit as (select * from seen order by created_at desc nulls last, id limit 200)
    select id, media_type from hit where media_type = 'image' and month(created_at) = 7 and exists (select 1 from media_faces f where f.media_id = hit.id and (contains(lower(name), '1') or lower(cast(face_id as varchar)) = '1'))""",
)
def f11_filter_only(t: Tables) -> DataFrame:
    found = search.newest(t.media)
    ids = found.select(F.col("id").alias("media_id"))
    rows = media.nested(found, t.objects.join(ids, "media_id", "left_semi"), t.faces.join(ids, "media_id", "left_semi"))
    return rows.where(search.residual(search.Filters(face="1", month=7, media_type="photo"))).select("id", "media_type")


@query("l05_history", "select id, query, created_at from history where deleted_at is null order by created_at desc nulls last, id desc limit 20")
def l05_history(t: Tables) -> DataFrame:
    return search.history(t.history)


@query("f23_suggestions", "with h as (select id, query, created_at from history where deleted_at is null order by created_at desc nulls last, id desc limit 8) select * from h where coalesce(trim(query), '') <> ''")
def f23_suggestions(t: Tables) -> DataFrame:
    return search.suggestions(t.history)


# --- timeline and views


@query("l01_timeline", "select id, year(created_at)::int as y, month(created_at)::int as m, 'Tháng ' || month(created_at) || ' ' || year(created_at) as label from seen where processed order by created_at desc nulls last, id limit 5000")
def l01_timeline(t: Tables) -> DataFrame:
    return timeline.items(t.media).select("id", "y", "m", "label")


@query("a03_timeline_counts", "with i as (select * from seen where processed order by created_at desc nulls last, id limit 5000) select year(created_at)::int as y, month(created_at)::int as m, count(*) as n, string_agg(cast(id as varchar), ',' order by created_at desc, id) as ids from i group by 1, 2")
def a03_timeline_counts(t: Tables) -> DataFrame:
    return timeline.months(timeline.items(t.media), ["id"]).select("y", "m", "n", F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ",").alias("ids"))


@query("p10_flatten", "with i as (select * from seen where processed order by created_at desc nulls last, id limit 5000) select year(created_at)::int as y, month(created_at)::int as m, id, file_name from i")
def p10_flatten(t: Tables) -> DataFrame:
    return timeline.flat(timeline.months(timeline.items(t.media), ["id", "file_name"])).select("y", "m", "id", "file_name")


@query("w02_first_of_year", "with i as (select * from seen where processed order by created_at desc nulls last, id limit 5000), g as (select distinct year(created_at)::int as y, month(created_at)::int as m from i) select y, m, m = max(m) over (partition by y) as first_of_year from g")
def w02_first_of_year(t: Tables) -> DataFrame:
    return timeline.first_of_year(timeline.months(timeline.items(t.media), ["id"])).select("y", "m", "first_of_year")


@query("f03_trash", "select id, deleted_at from media where deleted_at is not null")
def f03_trash(t: Tables) -> DataFrame:
    return media.trash(t.media).select("id", "deleted_at")


@query("f04_hidden", "select id, created_at from media where is_hidden and deleted_at is null")
def f04_hidden(t: Tables) -> DataFrame:
    return media.hidden(t.media).select("id", "created_at")


_LISTED = "listed as (select m.*, '/library/' || file_name as path, coalesce((select list(distinct class_name) from media_objects o where o.media_id = m.id), []) as labels from seen m)"


def _client(t: Tables) -> DataFrame:
    """What the client filters: visible media with labels, people, face ids and path."""
    some = t.media.where(media.visible())
    o = t.objects.groupBy(F.col("media_id").alias("id")).agg(F.collect_set("class_name").alias("labels"))
    f = t.faces.groupBy(F.col("media_id").alias("id")).agg(F.collect_set("name").alias("people"), F.collect_set(F.col("face_id").cast("string")).alias("face_ids"))
    rows = some.join(o, "id", "left").join(f, "id", "left")
    empty = F.array().cast("array<string>")
    return rows.withColumns({**{c: F.coalesce(c, empty) for c in ("labels", "people", "face_ids")}, "path": scalar.join_path(F.lit(FOLDER), F.col("file_name"))})


@query("f18_text_box", f"with {_LISTED} select id from listed where len(list_filter(labels, lambda l: contains(lower(l), '99.j'))) > 0 or contains(lower(path), '99.j') or exists (select 1 from media_faces f where f.media_id = listed.id and contains(lower(name), '99.j'))")
def f18_text_box(t: Tables) -> DataFrame:
    return _client(t).where(timeline.text_box("99.J")).select("id")


@query("f20_gallery", f"with {_LISTED} select 'favorites' as kind, count(*) as n from listed where favorite and media_type <> 'video' union all select 'videos', count(*) from listed where media_type = 'video' union all select 'person', count(*) from listed where exists (select 1 from media_faces f where f.media_id = listed.id and (cast(face_id as varchar) = '3' or name = '3')) union all select 'album', count(*) from listed where media_type <> 'video' and list_contains(labels, 'PROMO')")
def f20_gallery(t: Tables) -> DataFrame:
    rows, out = _client(t), None
    for kind, payload in (("favorites", "photos"), ("videos", None), ("person", "3"), ("album", "tag_promo")):
        one = rows.where(timeline.gallery(kind, payload)).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", "n")
        out = one if out is None else out.union(one)
    return out


_SHOTS = "/library/{0}-my-SCREEN-CAPTURE.png", "/library/scr_{0}.png", "/library/x/Screen_Shot {0}.jpg", "/library/Ảnh chụp màn hình {0}.png", "/library/Screencast/{0}.mp4", "/library/described_{0}.jpg", "/scr_/{0}.png"


@query("f21_screenshots", "with f as (select page_id, case page_id % 9 " + " ".join(f"when {k} then '{x.replace('{0}', chr(39) + ' || page_id || ' + chr(39))}'" for k, x in enumerate(_SHOTS)) + " else url end as path from pages) select page_id, path from f where regexp_matches(lower(path), 'screenshot|screen-capture|screencast|ảnh chụp màn hình') or starts_with(lower(split_part(path, '/', -1)), 'scr_') or contains(lower(split_part(path, '/', -1)), 'screen_shot')")
def f21_screenshots(t: Tables) -> DataFrame:
    """Pages as files, some of them named as screenshots are."""
    path = F.col("url")
    for k, shape in enumerate(_SHOTS):
        before, after = shape.split("{0}")
        path = F.when(F.col("page_id") % 9 == k, F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit(after))).otherwise(path)
    return t.read("pages").select("page_id", path.alias("path")).where(timeline.screenshot(F.col("path")))


@query("a20_counts", "select count(*) as n_media, count(*) filter (where media_type = 'video') as n_videos, count(deleted_at) as n_deleted from media")
def a20_counts(t: Tables) -> DataFrame:
    return t.media.agg(F.count(F.lit(1)).alias("n_media"), F.count_if(F.col("media_type") == "video").alias("n_videos"), F.count("deleted_at").alias("n_deleted"))


@query("a21_monthly", "select strftime(created_at, '%Y-%m') as month, count(*) as n from media group by 1")
def a21_monthly(t: Tables) -> DataFrame:
    return timeline.monthly(t.media)


@query("a22_daily", "select year(created_at) || '-' || month(created_at) || '-' || day(created_at) as day, count(*) as n from media group by 1")
def a22_daily(t: Tables) -> DataFrame:
    return timeline.daily(t.media)


@query("s09_nested_media", "select m.id, (select count(*) from media_objects o where o.media_id = m.id) as n_objects, coalesce((select string_agg(class_name, ',' order by obj_no, class_name) from media_objects o where o.media_id = m.id), '') as labels, coalesce((select string_agg(name, ',' order by face_no, cast(face_id as varchar)) from media_faces f where f.media_id = m.id), '') as names from media m")
def s09_nested_media(t: Tables) -> DataFrame:
    rows = media.nested(t.media, t.objects, t.faces)
    return rows.select("id", F.size("objects").cast("long").alias("n_objects"), F.array_join(F.col("objects.class_name"), ",").alias("labels"), F.array_join(media.names("faces"), ",").alias("names"))


# --- people and albums


@query(
    "a04_people",
    """with f as (select f.*, content_key, file_name from media_faces f join seen m on m.id = f.media_id),
    best as (select *, row_number() over (partition by face_id order by conf desc nulls last, media_id, face_no) as r from f),
    n as (select face_id, count(distinct content_key) as photo_count from f group by 1)
    select n.face_id, p.name, photo_count, round(coalesce(p.conf, b.conf), 6) as conf, b.file_name as cover, b.media_id as best_media_id
    from n join best b on b.face_id = n.face_id and r = 1 left join person p on p.face_id = n.face_id""",
)
def a04_people(t: Tables) -> DataFrame:
    return people.people(t.faces, t.media, t.person).drop("face_bbox").withColumn("conf", F.round("conf", 6)).orderBy(F.desc("photo_count"), "face_id")


@query("j24_person_photo_count", "select p.face_id, p.name, count(distinct f.media_id) as photos from person p left join (select f.* from media_faces f join seen m on m.id = f.media_id) f on f.face_id = p.face_id group by 1, 2")
def j24_person_photo_count(t: Tables) -> DataFrame:
    return people.photos_of(t.faces, t.media, t.person)


@query("a06_distinct_objects", "select distinct class_name from media_objects where media_id in (select id from seen)")
def a06_distinct_objects(t: Tables) -> DataFrame:
    return albums.distinct_labels(t.media, t.objects)


@query("j09_albums", "select a.id, title, count(am.media_id) as n_media, arg_min(file_name, am.media_id) as cover from album a left join album_media am on am.album_id = a.id left join media m on m.id = am.media_id group by 1, 2")
def j09_albums(t: Tables) -> DataFrame:
    return albums.albums(t.album, t.album_media, t.media)


@query("j04_album_photos", "select id, media_type, created_at from seen where id in (select media_id from album_media where album_id = 3)")
def j04_album_photos(t: Tables) -> DataFrame:
    return albums.photos(t.album_media, t.media, 3).select("id", "media_type", "created_at")


@query("a07_status", "select (select count(*) from person) as people, (select count(distinct media_id) from media_faces) as media_with_faces, (select count(*) from embedding) as vectors")
def a07_status(t: Tables) -> DataFrame:
    return albums.status(t.person, t.faces, t.embedding)


@query("a15_label_albums", "select lower(class_name) as tag, count(distinct id) as n, arg_min(file_name, id) as cover, lower(class_name) as title from media_objects o join seen m on m.id = o.media_id where media_type <> 'video' group by 1")
def a15_label_albums(t: Tables) -> DataFrame:
    return albums.labels(t.media, t.objects)


@query("a16_favorites", "select count(*) as n, (select file_name from seen where favorite and media_type <> 'video' order by created_at desc, id limit 1) as cover from seen where favorite and media_type <> 'video'")
def a16_favorites(t: Tables) -> DataFrame:
    return albums.favourites(t.media)


# --- duplicates


@query("a01_exact_duplicates", "select content_key as group_id, count(*) as n, string_agg(cast(id as varchar), ',' order by id) as ids from seen group by 1 having count(*) > 1")
def a01_exact_duplicates(t: Tables) -> DataFrame:
    return duplicates.grouped(duplicates.exact(t.media))


@query("a01_duplicate_texts", "select sha256(text) as group_id, count(*) as n, string_agg(cast(doc_id as varchar), ',' order by doc_id) as ids from documents where text is not null group by 1 having count(*) > 1")
def a01_duplicate_texts(t: Tables) -> DataFrame:
    return duplicates.grouped(duplicates.exact(t.read("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_key"))))


_BITS = f"pairs as (select a.id as a, b.id as b, bit_count(xor(a.hash, b.hash))::int as distance from hashes a join hashes b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= {BITS})"
_GROUPS = "edges as (select a, b from pairs union select b, a from pairs), reach as (select a as id, a as root from edges union select e.b, r.root from reach r join edges e on e.a = r.id), roots as (select id, min(root) as root from reach group by 1)"


@query("j11_hamming_pairs", f"with {_BITS} select * from pairs")
def j11_hamming_pairs(t: Tables) -> DataFrame:
    return graph.hamming_pairs(t.hashes, BITS, 62).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("a11_hamming_groups", f"with recursive {_BITS}, {_GROUPS} select root as group_id, id as media_id from roots")
def a11_hamming_groups(t: Tables) -> DataFrame:
    return duplicates.near(t.hashes, BITS, 62)


@query("a10_representative", "select media_id, arg_min(point_id, frame_idx * 1000000 + point_id) as point_id from embedding group by 1")
def a10_representative(t: Tables) -> DataFrame:
    return duplicates.representatives(t.embedding).select("media_id", "point_id")


_REPS = "reps as (select * from (select *, row_number() over (partition by media_id order by frame_idx, point_id) as r from embedding where source = 'image') where r = 1)"
_COSINE = f"{_REPS}, pairs as (select a.media_id as a, b.media_id as b, max({similarity('a.vec', 'b.vec')}) as score from reps a join (select * from embedding where source = 'image') b on a.media_id < b.media_id group by 1, 2 having max({similarity('a.vec', 'b.vec')}) >= {ALIKE})"


#: Points of all sources.
_ALL_COSINE = _COSINE.replace(" where source = 'image'", "")


@query("j12_cosine_pairs", f"with {_ALL_COSINE} select a, b, round(score, 6) as score from pairs")
def j12_cosine_pairs(t: Tables) -> DataFrame:
    return duplicates.by_any_vector(t.embedding, ALIKE).select("a", "b", _score())


@query("a11_cosine_groups", f"with recursive {_COSINE}, {_GROUPS} select root as group_id, id as media_id from roots")
def a11_cosine_groups(t: Tables) -> DataFrame:
    return duplicates.of_components(duplicates.by_vector(t.embedding, ALIKE))


@query(
    "j19_duplicate_groups",
    f"""with recursive {_COSINE}, {_GROUPS},
    bitlinks as (select a.id as a, b.id as b from hashes a join hashes b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= {BITS}),
    bitedges as (select a, b from bitlinks union select b, a from bitlinks), bitreach as (select a as id, a as root from bitedges union select e.b, r.root from bitreach r join bitedges e on e.a = r.id),
    first as (select 'hash' as kind, content_key as group_id, id as media_id from seen where content_key in (select content_key from seen group by 1 having count(*) > 1)),
    second as (select 'phash' as kind, cast(min(root) as varchar) as group_id, id as media_id from bitreach group by id),
    kept2 as (select group_id from second left join (select distinct media_id as m from first) f on f.m = media_id group by 1 having not bool_and(f.m is not null)),
    two as (select * from first union all select * from second where group_id in (select group_id from kept2)),
    third as (select 'semantic' as kind, cast(root as varchar) as group_id, id as media_id from roots),
    kept3 as (select group_id from third left join (select distinct media_id as m from two) f on f.m = media_id group by 1 having not bool_and(f.m is not null))
    select * from two union all select * from third where group_id in (select group_id from kept3)""",
)
def j19_duplicate_groups(t: Tables) -> DataFrame:
    return duplicates.staged([("hash", duplicates.exact(t.media)), ("phash", duplicates.near(t.hashes, BITS, 62)), ("semantic", duplicates.of_components(duplicates.by_vector(t.embedding, ALIKE)))])


@query("w01_mark_duplicates", "select content_key as group_id, id as media_id, row_number() over (partition by content_key order by id) > 1 as marked from seen where content_key in (select content_key from seen group by 1 having count(*) > 1)")
def w01_mark_duplicates(t: Tables) -> DataFrame:
    return duplicates.marked(duplicates.exact(t.media))


@query("a17_reclaimable", "with r as (select *, row_number() over (partition by content_key order by id) as r from seen) select count(*) as n_marked, sum(file_size)::bigint as bytes from r where r > 1")
def a17_reclaimable(t: Tables) -> DataFrame:
    return duplicates.reclaimable(duplicates.exact(t.media), t.media)


# --- faces, video, detections


@query("j13_nearest_reference", f"with s as (select e.point_id as id, r.point_id as ref_id, {similarity('e.vec', 'r.vec')} as score from embedding e join embedding r on r.point_id < 50 where e.point_id >= 50), best as (select id, arg_max(ref_id, score) as ref_id, max(score) as score from s group by 1) select id, case when score > 0.33 then ref_id end as ref_id, case when score > 0.33 then round(score, 6) end as score from best")
def j13_nearest_reference(t: Tables) -> DataFrame:
    e = t.embedding
    refs = e.where("point_id < 50").select(F.col("point_id").alias("ref_id"), "vec")
    return graph.nearest_reference(e.where("point_id >= 50").select(F.col("point_id").alias("id"), "vec"), refs, 0.33).select("id", "ref_id", _score())


def _led(rows: str, threshold: float) -> str:
    """Leaders by a recursive walk over each session's vectors in the order of ids; rows: session, id, vec."""
    return f"""with recursive v as (select session, id, vec, row_number() over (partition by session order by id) as r from ({rows})),
    walk as (select session, r, [{{'id': id, 'vec': vec}}] as kept from v where r = 1 union all
        select w.session, v.r, case when len(list_filter(w.kept, lambda k: {similarity("k.vec", "v.vec")} > {threshold})) = 0 then list_append(w.kept, {{'id': v.id, 'vec': v.vec}}) else w.kept end from walk w join v on v.session = w.session and v.r = w.r + 1),
    leads as (select session, unnest(kept) as k from (select session, arg_max(kept, r) as kept from walk group by 1)),
    near as (select v.session, v.id, l.k.id as leader, {similarity("l.k.vec", "v.vec")} as score from v join leads l on l.session = v.session and l.k.id < v.id where v.id not in (select k.id from leads)),
    led as (select session, id, arg_max(leader, score) as leader, max(score) as score from near group by 1, 2 union all select session, k.id, k.id, null from leads)"""


@query("j14_leader_clusters", _led("select 'all' as session, point_id as id, vec from embedding", detect.FACE_LEADER) + " select id, leader, round(score, 6) as score from led")
def j14_leader_clusters(t: Tables) -> DataFrame:
    return detect.leaders(t.embedding.select(F.col("point_id").alias("id"), "vec")).select("id", "leader", _score())


_SCENES = "numbered as (select *, row_number() over (partition by media_id order by frame_idx) - 1 as scene, lag(frame_idx, 1, 0) over (partition by media_id order by frame_idx) as first from cuts), scenes as (select media_id, scene::int as scene, first, greatest(frame_idx - 1, 0) as last from numbered union all select media_id, count(*)::int, max(frame_idx), max(total_frames) - 1 from cuts group by 1)"
_SAMPLES = f"{_SCENES}, wide as (select media_id, scene, unnest([0, 1, 2]) as ord, unnest([first + floor(greatest(last - first, 0) * 0.2), first + floor(greatest(last - first, 0) * 0.5), first + floor(greatest(last - first, 0) * 0.8)])::bigint as frame from scenes), samples as (select media_id, scene, frame, min(ord) as ord from wide group by 1, 2, 3)"


@query("w03_scenes", f"with {_SCENES} select * from scenes")
def w03_scenes(t: Tables) -> DataFrame:
    return video.scenes(t.cuts)


@query("w04_samples", f"with {_SAMPLES} select media_id, scene, frame from samples")
def w04_samples(t: Tables) -> DataFrame:
    return video.samples(video.scenes(t.cuts)).select("media_id", "scene", "frame")


@query("j15_frame_scene", f"with {_SAMPLES}, f as (select distinct media_id, frame from samples) select f.media_id, f.frame, coalesce(min(s.scene), 0) as scene from f left join scenes s on s.media_id = f.media_id and f.frame between s.first and s.last group by 1, 2")
def j15_frame_scene(t: Tables) -> DataFrame:
    found = video.scenes(t.cuts)
    return video.scene_of(video.samples(found).select("media_id", "frame").distinct(), found).select("media_id", "frame", "scene")


@query(
    "w05_fallback",
    f"""with {_SAMPLES}, lit as (select media_id, scene, ord, frame, ((frame * 37 + media_id * 11) % 300)::double as luma from samples where scene % 2 = 0 or (frame * 37 + media_id * 11) % 300 > 240),
    ranked as (select *, luma between 25 and 240 as good, bool_or(luma between 25 and 240) over (partition by media_id, scene) as any_good, row_number() over (partition by media_id, scene order by abs(luma - 128), ord) as r from lit)
    select media_id, scene, frame from ranked where good or (not any_good and r = 1)""",
)
def w05_fallback(t: Tables) -> DataFrame:
    value = (F.col("frame") * 37 + F.col("media_id") * 11) % 300
    frames = video.samples(video.scenes(t.cuts)).withColumn("luma", value.cast("double")).where((F.col("scene") % 2 == 0) | (F.col("luma") > 240))
    return video.kept(frames).select("media_id", "scene", "frame")


@query("a12_video_objects", "with r as (select *, row_number() over (partition by media_id, class_name order by greatest(conf, 0) desc, obj_no, x, y) as r from media_objects) select media_id, class_name, greatest(conf, 0) as conf, x, y, w, h, obj_no as best_frame from r where r = 1")
def a12_video_objects(t: Tables) -> DataFrame:
    return video.objects(t.objects, "obj_no")


@query("a13_video_faces", "with r as (select *, row_number() over (partition by media_id, face_id order by greatest(conf, 0) desc, face_no) as r from media_faces) select media_id, face_id, greatest(conf, 0) as conf, name, face_no as best_frame from r where r = 1")
def a13_video_faces(t: Tables) -> DataFrame:
    return video.faces(t.faces, "face_no")


def _suppressed(rows: str, overlap: str, threshold: float, values: str, ties: str = "obj_no, class_name, x1, y1, x2, y2") -> str:
    """Greedy suppression by a recursive walk over each image's boxes in order; rows: media_id, obj_no, conf and the box."""
    return f"""with recursive boxes as ({rows}), d as (select media_id, row_number() over (partition by media_id order by conf desc, {ties}) as r, {values} as b from boxes),
    walk as (select media_id, r, [b] as kept from d where r = 1 union all
        select w.media_id, d.r, case when len(list_filter(w.kept, lambda k: {overlap} > {threshold})) = 0 then list_append(w.kept, d.b) else w.kept end from walk w join d on d.media_id = w.media_id and d.r = w.r + 1),
    last as (select media_id, arg_max(kept, r) as kept from walk group by 1), alive as (select media_id, unnest(kept) as k, unnest(range(len(kept)))::int as n from last)"""


_SIDE = "greatest(least(k.{1}, d.b.{1}) - greatest(k.{0}, d.b.{0}), 0)"
_INTER = f"({_SIDE.format('x1', 'x2')} * {_SIDE.format('y1', 'y2')})"
_AREAS = "(greatest(k.x2 - k.x1, 0) * greatest(k.y2 - k.y1, 0) + greatest(d.b.x2 - d.b.x1, 0) * greatest(d.b.y2 - d.b.y1, 0))"
_IOU = f"case when {_AREAS} - {_INTER} > 0 then {_INTER} / ({_AREAS} - {_INTER}) else 0 end"
_CORNERS = "{'obj_no': obj_no, 'class_name': class_name, 'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"


@query("j20_nms", _suppressed("select media_id, obj_no, class_name, conf, x as x1, y as y1, x + w as x2, y + h as y2 from media_objects", _IOU, 0.45, _CORNERS) + " select media_id, k.obj_no as obj_no, k.class_name as class_name, k.conf as conf from alive")
def j20_nms(t: Tables) -> DataFrame:
    corners = t.objects.selectExpr("media_id", "obj_no", "class_name", "conf", "x as x1", "y as y1", "x + w as x2", "y + h as y2")
    return detect.suppressed(corners, 0.45, corners=True).select("media_id", "obj_no", "class_name", "conf")


@query("j21_face_nms", _suppressed("select media_id, obj_no, class_name, conf, x as x1, y as y1, x + w as x2, y + h as y2 from media_objects", _IOU, 0.3, _CORNERS) + " select media_id, k.obj_no as obj_no, k.conf as conf from alive")
def j21_face_nms(t: Tables) -> DataFrame:
    return detect.suppressed(t.objects, detect.FACE_OVERLAP).select("media_id", "obj_no", "conf")


@query("n07_iou_pairs", "with p as (select a.media_id, a.obj_no as i, b.obj_no as j, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) as o, a.w * a.h + b.w * b.h as s from media_objects a join media_objects b on a.media_id = b.media_id and a.obj_no < b.obj_no) select media_id, i, j, round(o / (s - o), 6) as iou from p where o > 0")
def n07_iou_pairs(t: Tables) -> DataFrame:
    box = lambda a: F.struct(*[F.col(f"{a}.{c}").alias(c) for c in "xywh"])
    a, b = t.objects.alias("a"), t.objects.alias("b")
    pairs = a.join(b, (F.col("a.media_id") == F.col("b.media_id")) & (F.col("a.obj_no") < F.col("b.obj_no")))
    return pairs.select(F.col("a.media_id").alias("media_id"), F.col("a.obj_no").alias("i"), F.col("b.obj_no").alias("j"), F.round(scalar.iou_boxes(box("a"), box("b")), 6).alias("iou")).where("iou > 0")


@query("f24_confident", "select media_id, obj_no, conf from media_objects where conf >= 0.05 and least(w, h) >= 20")
def f24_confident(t: Tables) -> DataFrame:
    return t.objects.where((F.col("conf") >= 0.05) & detect.large_enough(F.col("w"), F.col("h"), 20)).select("media_id", "obj_no", "conf")


@query("f29_point_in_box", "with p as (select o_orderkey as point_id, o_orderkey as media_id, 20.0 as px, 20.0 as py from orders), h as (select point_id, obj_no, class_name, row_number() over (partition by point_id order by obj_no, class_name) as r from p join media_objects o on o.media_id = p.media_id where px between x and x + w and py between y and y + h) select point_id, obj_no, class_name from h where r = 1")
def f29_point_in_box(t: Tables) -> DataFrame:
    points = t.read("orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("media_id"), F.lit(20.0).alias("px"), F.lit(20.0).alias("py"))
    return detect.hit(t.objects, points)


@query("n04_l2_normalize", "select point_id, round(sqrt(list_dot_product(vec, vec)), 6) as norm, round(vec[1] / greatest(sqrt(list_dot_product(vec, vec)), 1e-8), 6) as first, round(vec[64] / greatest(sqrt(list_dot_product(vec, vec)), 1e-8), 6) as last from embedding")
def n04_l2_normalize(t: Tables) -> DataFrame:
    rows = t.embedding.select("point_id", F.round(vectors.norm(F.col("vec")), 6).alias("norm"), vectors.normalized(F.col("vec")).alias("u"))
    return rows.select("point_id", "norm", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("n01_cosine_neighbours", f"select a.point_id as i, b.point_id as j, round({similarity('a.vec', 'b.vec')}, 6) as score from embedding a join embedding b on b.point_id = a.point_id + 1")
def n01_cosine_neighbours(t: Tables) -> DataFrame:
    a = t.embedding.select(F.col("point_id").alias("i"), F.col("vec").alias("u"))
    b = t.embedding.select(F.col("point_id").alias("j"), (F.col("point_id") - 1).alias("i"), F.col("vec").alias("v"))
    return a.join(b, "i").select("i", "j", F.round(vectors.cosine(F.col("u"), F.col("v")), 6).alias("score"))


@query("n09_sigmoid", "select vec_id, round(1 / (1 + exp(-greatest(least(embedding[1]::double * 40, 88), -88))), 6) as s, round(sqrt(least(greatest(embedding[2]::double, 0), 1) * least(greatest(embedding[3]::double, 0), 1)), 6) as f from embeddings")
def n09_sigmoid(t: Tables) -> DataFrame:
    v = lambda k: F.col("embedding")[k].cast("double")
    return t.read("embeddings").select("vec_id", F.round(scalar.sigmoid(v(0) * 40), 6).alias("s"), F.round(scalar.face_score(v(1), v(2)), 6).alias("f"))


# --- masks


@query("w06_rle_encode", "with bits as (select distinct l_orderkey as id, l_linenumber as pos from lineitem), i as (select *, pos - row_number() over (partition by id order by pos) as g from bits), runs as (select id, min(pos) as first, count(*) as n from i group by id, g) select id, string_agg(first || '+' || n, ',' order by first) as rle, sum(n)::bigint as area from runs group by 1")
def w06_rle_encode(t: Tables) -> DataFrame:
    rows = masks.encoded(t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos")), ["id"])
    return rows.select("id", F.array_join(F.transform("rle", lambda r: F.concat_ws("+", r[0].cast("string"), r[1].cast("string"))), ",").alias("rle"), masks.area(F.col("rle")).alias("area"))


@query("y01_rle_decode", "select distinct l_orderkey as id, l_linenumber::bigint as pos from lineitem where l_linenumber < 6")
def y01_rle_decode(t: Tables) -> DataFrame:
    rows = masks.encoded(t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos")), ["id"])
    return rows.select("id", F.explode(masks.decoded(F.col("rle"), F.lit(6).cast("bigint"))).alias("pos"))


# --- text, paths, dates


@query("x_text_normalize", "select conv_id, turn, trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) as text from conversations")
def x_text_normalize(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", text.normalized(F.col("text")).alias("text"))


@query("x06_path_parts", "select page_id, split_part(url, '/', -1) as name, case when regexp_matches(split_part(url, '/', -1), '^.+\\.[^.]*$') then regexp_extract(split_part(url, '/', -1), '^(.+)\\.[^.]*$', 1) else split_part(url, '/', -1) end as stem, lower(regexp_extract(split_part(url, '/', -1), '^.+\\.([^.]*)$', 1)) as ext, case when starts_with(url, '/') then url else '/library/' || url end as resolved from pages")
def x06_path_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.read("pages").select("page_id", scalar.base_name(url).alias("name"), scalar.stem(url).alias("stem"), scalar.extension(url).alias("ext"), scalar.resolved(url, F.lit(FOLDER)).alias("resolved"))


@query("s02_media_type", "select id, case when lower(split_part(file_name, '.', -1)) = 'jpg' then 'image' when lower(split_part(file_name, '.', -1)) = 'mp4' then 'video' end as media_type from media")
def s02_media_type(t: Tables) -> DataFrame:
    return t.media.select("id", scalar.media_type(F.col("file_name")).alias("media_type"))


@query("q01_json", "select l_orderkey, l_linenumber, case when l_orderkey % 5 > 0 then l_partkey end as first, case when l_orderkey % 5 > 0 then l_suppkey end as n from lineitem")
def q01_json(t: Tables) -> DataFrame:
    """Runs as JSON text, every fifth of them broken."""
    text_ = F.when(F.col("l_orderkey") % 5 > 0, F.concat(F.lit("[["), F.col("l_partkey"), F.lit(", "), F.col("l_suppkey"), F.lit("], [1, 2]]"))).otherwise(F.lit("[[1, 2"))
    runs = masks.parsed(text_)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", runs[0][0].alias("first"), runs[0][1].alias("n"))


@query("d01_year_month", "select id, year(created_at)::int as y, month(created_at)::int as m, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as at from media")
def d01_year_month(t: Tables) -> DataFrame:
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    when = scalar.year_month(F.concat(iso, F.lit("+07:00")))
    return t.media.select("id", when["y"].alias("y"), when["m"].alias("m"), iso.alias("at"))


@query("x10_hashes", "select doc_id, sha256(coalesce(text, '')) as sha256, hex(coalesce(text, '')) as hex from documents")
def x10_hashes(t: Tables) -> DataFrame:
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")
    return library.with_hash(t.read("documents").select("doc_id", content)).select("doc_id", "sha256", F.hex("content").alias("hex"))


_CLASSES = {"PROMO": " dog ", "ECONOMY": "cat", "STANDARD": "person"}


@query("p07_labels", "select p_partkey, case p_type when 'PROMO' then 'chó' when 'ECONOMY' then 'mèo' when 'STANDARD' then 'người' else p_type end as label from part")
def p07_labels(t: Tables) -> DataFrame:
    """Three part types stand for classes, one of them with blanks around its name; the others have no label."""
    name = F.col("p_type")
    for kind, class_ in _CLASSES.items():
        name = F.when(F.col("p_type") == kind, class_).otherwise(name)
    return t.read("part").select("p_partkey", labels.display_label(name).alias("label"))


@query("b02_bpe")
def b02_bpe(t: Tables) -> DataFrame:
    pieces = text.WordPieces(text.load_merges(["t h", "th e</w>", "i n", "in g</w>", "a n", "an d</w>"]), text.load_vocabulary(["the 9", "and 8", "in@@ 7", "ing 6", "a 5", "th@@ 4"]))
    coded = t.read("conversations").select("conv_id", "turn", text.encode_column(F.col("text"), pieces).alias("e"))
    return coded.select("conv_id", "turn", F.col("e.ids").alias("ids"), F.col("e.mask").alias("mask"))


# --- changes


@query(
    "k12_person_merge",
    """with new as (select s_suppkey + 5 as face_id, case when s_suppkey % 2 = 0 then 'new ' || s_suppkey end as name, case when s_suppkey % 7 <> 0 then s_acctbal / 9000 end as conf from supplier),
    j as (select coalesce(p.face_id, n.face_id) as face_id, p.name as pn, p.conf as pc, n.name as nn, n.conf as nc, p.face_id is null as fresh from person p full join new n on n.face_id = p.face_id)
    select face_id, coalesce(nn, pn) as name, round(case when fresh or nc > pc or (pc is null and nc is not null) then nc else pc end, 6) as conf from j""",
)
def k12_person_merge(t: Tables) -> DataFrame:
    new = t.read("supplier").selectExpr("s_suppkey + 5 as face_id", "case when s_suppkey % 2 = 0 then concat('new ', s_suppkey) end as name", "case when s_suppkey % 7 <> 0 then s_acctbal / 9000 end as conf", "s_suppkey as ord")
    return people.merged(t.person, new).withColumn("conf", F.round("conf", 6))


@query("k13_rename", "select 'person' as kind, face_id, case when face_id = 3 then 'Ada' else name end as name from person union all select 'face', face_id, case when face_id = 3 then 'Ada' else name end from media_faces")
def k13_rename(t: Tables) -> DataFrame:
    who, rows = people.renamed(t.person, t.faces, 3, "Ada")
    return who.select(F.lit("person").alias("kind"), "face_id", "name").union(rows.select(F.lit("face"), "face_id", "name"))


@query(
    "k14_merge_people",
    "with n as (select coalesce(max(name) filter (where face_id = 2), max(name) filter (where face_id = 5)) as name from person) select case when face_id in (2, 5) then 2 else face_id end as face_id, case when face_id in (2, 5) then (select name from n) else name end as name, count(*) as n from media_faces f group by 1, 2",
)
def k14_merge_people(t: Tables) -> DataFrame:
    return people.joined(t.person, t.faces, 2, 5)[1].groupBy(F.col("face_id").cast("long").alias("face_id"), "name").agg(F.count(F.lit(1)).alias("n"))


@query("k16_remove_face", "select media_id, face_no, face_id from media_faces where not (face_id = 4 and media_id = (select min(media_id) from media_faces where face_id = 4))")
def k16_remove_face(t: Tables) -> DataFrame:
    least = t.faces.where("face_id = 4").agg(F.min("media_id")).first()[0]
    return people.without_in(t.faces, 4, least).select("media_id", "face_no", "face_id")


@query("k15_delete_person", "select 'person' as kind, face_id, name from person where face_id <> 6 union all select 'face', face_id, name from media_faces where face_id <> 6")
def k15_delete_person(t: Tables) -> DataFrame:
    who, rows = people.without(t.person, t.faces, 6)
    return who.select(F.lit("person").alias("kind"), "face_id", "name").union(rows.select(F.lit("face"), "face_id", "name"))


@query("k17_trash_restore", f"select id, case when id in (1, 2, 3) then timestamp '{NOW}' when id in (13, 26) then null else deleted_at end as deleted_at, case when id in (7) then true else is_hidden end as is_hidden, case when id in (4, 5) then not favorite else favorite end as favorite from media")
def k17_trash_restore(t: Tables) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = mutate.hidden(mutate.restored(mutate.trashed(t.media, [1, 2, 3], now), [13, 26]), [7])
    rows = mutate.changed(rows, F.col("id").isin(4, 5), favorite=~F.col("favorite"))
    return rows.select("id", "deleted_at", "is_hidden", "favorite")


@query("k20_purge", f"select id, deleted_at from media where deleted_at is null or deleted_at >= timestamp '{NOW}' - interval 30 day")
def k20_purge(t: Tables) -> DataFrame:
    return mutate.purged(t.media, F.lit(NOW).cast("timestamp_ntz")).select("id", "deleted_at")


@query("k19_empty_trash", "select count(*) as media, (select count(*) from media_objects where media_id in (select id from media where deleted_at is null)) as objects from media where deleted_at is null")
def k19_empty_trash(t: Tables) -> DataFrame:
    left = mutate.emptied(t.media)
    (objects,) = mutate.cascaded(left, t.objects)
    return left.agg(F.count(F.lit(1)).alias("media")).crossJoin(objects.agg(F.count(F.lit(1)).alias("objects")))


@query("k24_album_add", "select distinct album_id, media_id from (select * from album_media union all select 3, o_orderkey from orders where o_orderkey % 8 = 0) where not (album_id = 5 and media_id % 16 = 0)")
def k24_album_add(t: Tables) -> DataFrame:
    new = t.read("orders").where("o_orderkey % 8 = 0").selectExpr("3 as album_id", "o_orderkey as media_id")
    gone = t.album_media.where("album_id = 5 and media_id % 16 = 0")
    return mutate.members_removed(mutate.members_added(t.album_media, new), gone)


@query("k26_album_delete", "select a.id, count(am.media_id) as n from album a left join album_media am on am.album_id = a.id where a.id <> 4 group by 1")
def k26_album_delete(t: Tables) -> DataFrame:
    left, members = mutate.album_deleted(t.album, t.album_media, 4)
    return albums.albums(left, members, t.media).select("id", F.col("n_media").alias("n"))


@query("k02_reset", "select id, case when id % 50 = 1 then file_size + 1 else file_size end as file_size, processed and id % 50 <> 1 as processed, (select count(*) from media_objects o where o.media_id = m.id and m.id % 50 <> 1) as n_objects from media m")
def k02_reset(t: Tables) -> DataFrame:
    new = t.media.where("id % 50 = 1").selectExpr("id", "file_size + 1 as file_size")
    rows, objects, _ = mutate.reset(t.media, t.objects, t.faces, new)
    n = objects.groupBy(F.col("media_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "id", "left").select("id", "file_size", "processed", F.coalesce("n", F.lit(0)).alias("n_objects"))


@query("k03_analysed", "select id, processed or id % 40 = 2 as processed, case when id % 40 = 2 then 'thumb' end as thumbnail, (select count(*) from media_objects o where o.media_id = m.id and (m.id % 40 <> 2 or obj_no = 1)) as n_objects from media m")
def k03_analysed(t: Tables) -> DataFrame:
    rows = t.media.withColumn("thumbnail", F.lit(None).cast("string"))
    done = rows.where("id % 40 = 2").select(F.col("id").alias("media_id"), F.lit("thumb").alias("thumbnail"))
    out, objects, _ = mutate.analysed(rows, t.objects, t.faces, done, t.objects.where("obj_no = 1"), t.faces)
    n = objects.groupBy(F.col("media_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return out.join(n, "id", "left").select("id", "processed", "thumbnail", F.coalesce("n", F.lit(0)).alias("n_objects"))


@query("k09_drop_vectors", "select point_id, media_id from embedding where media_id not in (select id from media where deleted_at is not null)")
def k09_drop_vectors(t: Tables) -> DataFrame:
    return mutate.vectors_of_removed(t.embedding, media.trash(t.media).select(F.col("id").alias("media_id"))).select("point_id", "media_id")


@query("k06_prune", "select id from media where deleted_at is null and id % 17 = 0")
def k06_prune(t: Tables) -> DataFrame:
    listing = t.media.where("id % 17 <> 0").select(F.col("file_name").alias("name"))
    return ingest.pruned(t.media, listing)[0].select("id")


def _files(t: Tables) -> tuple[DataFrame, DataFrame]:
    known = t.media.selectExpr("id", "file_name", "file_size", "processed", "substr(cast(created_at as string), 1, 19) as meta_modified_at", "content_key as file_sha256")
    files = t.media.selectExpr("concat('/in/', file_name) as path", "case when id % 10 = 0 then concat('new_', file_name) else file_name end as name", "file_size + case when id % 3 = 0 then 1 else 0 end as size", "substr(cast(created_at as string), 1, 19) as modified_at", "case when id % 6 = 0 then 'other' else content_key end as sha256")
    return files, known


_ACTIONS = "actions as (select '/in/' || file_name as path, case when id % 10 = 0 then 'insert' when id % 3 <> 0 or id % 6 <> 0 then case when processed then 'skip' else 'reprocess' end else 'reset' end as action, case when id % 10 <> 0 then id end as media_id from media)"


@query("j17_classify", f"with {_ACTIONS} select * from actions")
def j17_classify(t: Tables) -> DataFrame:
    return ingest.classified(*_files(t)).select("path", "action", "media_id")


@query("a14_summary", f"with {_ACTIONS} select count(*) as found, count(*) filter (where action in ('insert', 'reprocess', 'reset')) as new, count(*) filter (where action = 'skip') as skipped, 0::bigint as errors from actions")
def a14_summary(t: Tables) -> DataFrame:
    return ingest.summary(ingest.classified(*_files(t)))


# --- streams


@query("t02_debounce_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as burst from g) select user_id, min(ts) as first, count(*) as n from s group by user_id, burst")
def t02_debounce_sessions(t: Tables) -> DataFrame:
    rows = t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return watch.bursts(rows, "1 hour", key="user_id").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "n")


@query("t03_stream_dedup", "select user_id, event_type, 1::bigint as n from events group by 1, 2")
def t03_stream_dedup(t: Tables) -> DataFrame:
    """The same distinct keys as a stream over the events' files, one batch after another, gives."""
    root = f"{shared_root(t.spark)}/lumora/stream-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.read("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir).select("user_id", "event_type")

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    watch.run(stream.withColumn("key", F.concat_ws("|", "user_id", "event_type")), apply, f"{root}/checkpoint", available_now=True, key="key").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


# --- single filters and projections


def _rows(t: Tables) -> DataFrame:
    return media.nested(t.media, t.objects, t.faces)


@query("f05_object_filter", "select id from media where exists (select 1 from media_objects o where o.media_id = media.id and contains(lower(class_name), 'rom'))")
def f05_object_filter(t: Tables) -> DataFrame:
    return _rows(t).where(search.residual(search.Filters(object="ROM"))).select("id")


@query("f06_face_filter", "select id from media where exists (select 1 from media_faces f where f.media_id = media.id and (contains(lower(name), '09') or lower(cast(face_id as varchar)) = '09'))")
def f06_face_filter(t: Tables) -> DataFrame:
    return _rows(t).where(search.residual(search.Filters(face="09"))).select("id")


@query("f08_month_year", "select id, media_type from media where month(created_at) = 3 and year(created_at) = 1996 and media_type = 'image'")
def f08_month_year(t: Tables) -> DataFrame:
    return _rows(t).where(search.residual(search.Filters(month=3, year=1996, media_type="photo"))).select("id", "media_type")


@query("f30_nested_predicates", "select id, (select count(*) from media_faces f where f.media_id = m.id and name is not null) as named from media m where exists (select 1 from media_faces f where f.media_id = m.id) and exists (select 1 from media_objects o where o.media_id = m.id and class_name = 'SMALL')")
def f30_nested_predicates(t: Tables) -> DataFrame:
    rows = _rows(t).where((F.size("faces") > 0) & F.array_contains(F.col("objects.class_name"), "SMALL"))
    return rows.select("id", F.size(media.names("faces")).cast("long").alias("named"))


@query("p12_nested_paths", "select id, coalesce((select string_agg(distinct class_name, ',' order by class_name) from media_objects o where o.media_id = m.id), '') as labels from media m")
def p12_nested_paths(t: Tables) -> DataFrame:
    return _rows(t).select("id", F.array_join(F.array_sort(F.array_distinct(F.col("objects.class_name"))), ",").alias("labels"))


@query("p08_boxes", "select media_id, obj_no, x, y, (x + w) - x as w, (y + h) - y as h from media_objects")
def p08_boxes(t: Tables) -> DataFrame:
    box = scalar.corners_to_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    return t.objects.select("media_id", "obj_no", box.alias("b")).select("media_id", "obj_no", "b.x", "b.y", "b.w", "b.h")


@query("p05_thumbnails", "select id, case when media_type = 'video' then '/thumbs/' || 'IMG_' || id || case when id % 2 = 0 then '.cache.jpg' else '.side.jpg' end end as thumbnail from media")
def p05_thumbnails(t: Tables) -> DataFrame:
    some = t.media.withColumn("thumbnail", F.lit(None).cast("string"))
    listing = some.selectExpr("concat('IMG_', id) as stem", "case when id % 2 = 0 then concat('IMG_', id, '.cache.jpg') end as cached", "concat('IMG_', id, '.side.jpg') as sibling")
    return media.with_thumbnails(some, listing, "/thumbs/").select("id", "thumbnail")


@query("n10_anchors", "with sizes as (select distinct (p_size * 16)::int as width, (p_size * 12)::int as height from part), c as (select width, height, unnest([8, 16, 32, 64]) as s from sizes), r as (select *, unnest(range((height + s - 1) // s))::int as row from c), g as (select *, unnest(range((width + s - 1) // s))::int as col from r) select width, height, s as stride, row, col, col * s as x, row * s as y from g")
def n10_anchors(t: Tables) -> DataFrame:
    return detect.anchor_grid(t.read("part").select((F.col("p_size") * 16).cast("int").alias("width"), (F.col("p_size") * 12).cast("int").alias("height")).distinct())


@query("n12_letterbox", "with s as (select p_partkey, p_size * 37 + 1 as w, p_size * 11 + 5 as h from part), r as (select *, least(640.0::double / w, 640.0::double / h) as ratio from s) select p_partkey, round(ratio, 6) as ratio, (640 - round(w * ratio)) / 2 as pad_x, (640 - round(h * ratio)) / 2 as pad_y from r")
def n12_letterbox(t: Tables) -> DataFrame:
    fit = scalar.letterbox(F.col("p_size") * 37 + 1, F.col("p_size") * 11 + 5)
    return t.read("part").select("p_partkey", fit.alias("f")).select("p_partkey", F.round("f.ratio", 6).alias("ratio"), "f.pad_x", "f.pad_y")


@query("a18_mean_luma", "select p_brand, round(avg(floor((p_size * 299 + (p_size % 7) * 587 + (p_size % 3) * 114) / 1000.0)), 6) as luma from part group by 1")
def a18_mean_luma(t: Tables) -> DataFrame:
    value = scalar.luma(F.col("p_size"), F.col("p_size") % 7, F.col("p_size") % 3)
    return t.read("part").groupBy("p_brand").agg(F.round(F.avg(value), 6).alias("luma"))


@query("k01_insert", "select id, file_name, processed, favorite, deleted_at from media union all select -o_orderkey, 'new_' || o_orderkey, false, false, null from orders where o_orderkey % 1000 = 1")
def k01_insert(t: Tables) -> DataFrame:
    new = t.read("orders").where("o_orderkey % 1000 = 1").selectExpr("-o_orderkey as id", "concat('new_', o_orderkey) as file_name")
    return mutate.inserted(t.media, new).select("id", "file_name", "processed", "favorite", "deleted_at")


@query("k28_history_add", "select id, query from history where deleted_at is null union all select -1, 'cats'")
def k28_history_add(t: Tables) -> DataFrame:
    return mutate.history_added(t.history, {"id": -1, "query": "cats"}).where("deleted_at is null").select("id", "query")


@query("k29_configured", f"select 'main' as id, '/photos' as source_dir, '{NOW}' as updated_at")
def k29_configured(t: Tables) -> DataFrame:
    config = t.spark.createDataFrame([("main", "/old", "x")], "id string, source_dir string, updated_at string")
    return mutate.configured(config, "/photos", F.lit(NOW))


@query("k04_flags", "select id, case when id in (3, 11) then not (id = 11) or id = 3 else processed end as processed from media")
def k04_flags(t: Tables) -> DataFrame:
    return mutate.processed(mutate.processed(t.media, [3]), [11], False).select("id", "processed")


@query("j22_similar_points", f"select a.point_id as i, b.point_id as j, round({similarity('a.vec', 'b.vec')}, 6) as score from embedding a join embedding b on a.point_id < b.point_id where {similarity('a.vec', 'b.vec')} >= {ALIKE}")
def j22_similar_points(t: Tables) -> DataFrame:
    left, right = (t.embedding.select(F.col("point_id").alias("id"), "vec") for _ in range(2))
    return graph.cosine_pairs(left, right, ALIKE).select(F.col("a").alias("i"), F.col("b").alias("j"), _score())


@query("w08_thumbnail_frame", f"with {_SAMPLES} select media_id, arg_min(frame, scene * 10 + ord) as frame from samples group by 1")
def w08_thumbnail_frame(t: Tables) -> DataFrame:
    return video.thumbnail(video.samples(video.scenes(t.cuts)))


# --- look-ups, filters and forms of the client


@query("s10_by_id", "select id, (select count(*) from media_objects o where o.media_id = m.id) as n_objects, (select count(*) from media_faces f where f.media_id = m.id) as n_faces from media m where id = 7")
def s10_by_id(t: Tables) -> DataFrame:
    return media.by_id(t.media, t.objects, t.faces, 7).select("id", F.size("objects").cast("long").alias("n_objects"), F.size("faces").cast("long").alias("n_faces"))


@query("l18_second_page", "select point_id, media_id from embedding where source = 'image' order by point_id limit 16 offset 16")
def l18_second_page(t: Tables) -> DataFrame:
    _, cursor = vectors.page(t.embedding, size=16, source="image")
    return vectors.page(t.embedding, cursor, 16, "image")[0].select("point_id", "media_id")


@query("f19_flat_filter", f"with {_LISTED} select id from listed where len(list_filter(labels, lambda l: contains(lower(l), '1'))) > 0 or contains(cast(id as varchar), '1')")
def f19_flat_filter(t: Tables) -> DataFrame:
    return _client(t).withColumn("objects", F.col("labels")).where(timeline.flat_filter("1")).select("id")


@query("f22_picker", "select distinct class_name from media_objects where media_id in (select id from seen) and contains(lower(class_name), 'bru')")
def f22_picker(t: Tables) -> DataFrame:
    return albums.distinct_labels(t.media, t.objects).where(timeline.picker("Bru"))


@query("j25_groups_among", "with i as (select * from seen where processed order by created_at desc nulls last, id limit 5000) select year(created_at)::int as y, month(created_at)::int as m, count(*) as n from i where id in (select id from seen where favorite) group by 1, 2")
def j25_groups_among(t: Tables) -> DataFrame:
    return timeline.among(timeline.months(timeline.items(t.media), ["id"]), t.media.where(media.visible() & F.col("favorite"))).select("y", "m", "n")


@query("d05_frame_seconds", "select media_id, frame_idx, frame_idx / 25.0::double as seconds from embedding")
def d05_frame_seconds(t: Tables) -> DataFrame:
    return t.embedding.select("media_id", "frame_idx", scalar.frame_seconds(F.col("frame_idx"), F.lit(25.0)).alias("seconds"))


@query("d06_long_date", "select id, (['Chủ Nhật', 'Thứ Hai', 'Thứ Ba', 'Thứ Tư', 'Thứ Năm', 'Thứ Sáu', 'Thứ Bảy'])[dayofweek(created_at) + 1] || strftime(created_at, ', ngày %d tháng %m năm %Y') as label from media")
def d06_long_date(t: Tables) -> DataFrame:
    return t.media.select("id", scalar.long_date(F.col("created_at")).alias("label"))


@query("q02_json", "select face_id, '{' || '\"face_id\":' || face_id || case when name is null then '' else ',\"name\":\"' || name || '\"' end || '}' as json from person")
def q02_json(t: Tables) -> DataFrame:
    return t.person.select("face_id", scalar.as_json(F.struct("face_id", "name")).alias("json"))


@query("p09_candidates", "select face_id, conf, face_no::double as x, face_no::double + 1 as y, 2.0::double as w, 3.0::double as h from media_faces")
def p09_candidates(t: Tables) -> DataFrame:
    boxed = t.faces.withColumns({"x": F.col("face_no").cast("double"), "y": F.col("face_no").cast("double") + 1, "w": F.lit(2.0), "h": F.lit(3.0)})
    return people.candidates(boxed).select("face_id", "conf", "face_bbox.x", "face_bbox.y", "face_bbox.w", "face_bbox.h")


@query("y05_named_in_rows", "select m.id, coalesce((select string_agg(case when cast(face_id as varchar) = '3' then 'Alice' else name end, ',' order by face_no, cast(face_id as varchar)) from media_faces f where f.media_id = m.id), '') as names from media m")
def y05_named_in_rows(t: Tables) -> DataFrame:
    rows = people.named_in_rows(media.nested(t.media, t.objects, t.faces), "3", "Alice")
    return rows.select("id", F.array_join(media.names("faces"), ",").alias("names"))


@query("n07_iou_corners", "with b as (select p_partkey as id, p_size::double as x1, (p_size % 7)::double as y1, (p_size * 3 % 41)::double as x2, 9.0::double as y2 from part), o as (select id, greatest(least(x2, 20) - greatest(x1, 2), 0) * greatest(least(y2, 12) - greatest(y1, 1), 0) as i, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) + 198 as a from b) select id, round(case when a - i > 0 then i / (a - i) else 0 end, 6) as iou from o")
def n07_iou_corners(t: Tables) -> DataFrame:
    box = t.read("part").selectExpr("p_partkey as id", "named_struct('x1', cast(p_size as double), 'y1', cast(p_size % 7 as double), 'x2', cast(p_size * 3 % 41 as double), 'y2', cast(9 as double)) as a", "named_struct('x1', 2d, 'y1', 1d, 'x2', 20d, 'y2', 12d) as b")
    return box.select("id", F.round(scalar.iou_corners(F.col("a"), F.col("b")), 6).alias("iou"))


# --- tensors of models, derived from the tables


#: Records out of raw detections: an order is an image, its lines are detections in the padded square. Two prototypes of ones and a coefficient make a mask
#: that is the whole box or nothing, so that SQL can say its area.
_RAW = "select media_id, obj_no, class_name, conf, x * 8 as x1, y * 8 as y1, x * 8 + w * 5 as x2, y * 8 + h * 5 as y2 from media_objects where conf >= 0.03"
_UNPADDED = "least(greatest((k.{0} - {1}) / ratio, 0), {2})"


@query(
    "v04_records",
    _suppressed(_RAW, _IOU, 0.45, _CORNERS, "obj_no, x1, y1, x2, y2")
    + f""", sized as (select media_id, k, n, 100 + media_id % 200 as width, 100 + media_id % 100 as height, least(640.0::double / (100 + media_id % 200), 640.0::double / (100 + media_id % 100)) as ratio from alive),
    padded as (select *, (640 - floor(width * ratio + 0.5)::bigint) // 2 as l, (640 - floor(height * ratio + 0.5)::bigint) // 2 as t from sized),
    cut as (select media_id, n, k.obj_no as obj, k.conf as conf, {_UNPADDED.format("x1", "l", "width")} as x1, {_UNPADDED.format("y1", "t", "height")} as y1, {_UNPADDED.format("x2", "l", "width")} as x2, {_UNPADDED.format("y2", "t", "height")} as y2, width from padded)
    select media_id, n as obj_no, 'cls_' || obj as class_name, conf, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2,
        case when obj % 2 = 0 then (floor(x2) - floor(x1))::bigint * (floor(y2) - floor(y1))::bigint else 0 end as mask_area,
        case when obj % 2 = 0 and floor(x2) > floor(x1) and floor(y2) > floor(y1) then (floor(y1) * width + floor(x1))::bigint end as first_set
    from cut""",
)
def v04_records(t: Tables) -> DataFrame:
    c = lambda x: F.col(x).cast("double")
    corner = [c("x") * 8, c("y") * 8, c("x") * 8 + c("w") * 5, c("y") * 8 + c("h") * 5]
    mask = F.when(F.col("obj_no") % 2 == 0, 1.0).otherwise(-1.0)
    rows = t.objects.select("media_id", F.struct("obj_no", F.array(*corner, c("conf"), c("obj_no"), mask, mask).alias("row")).alias("d"))
    # Dealt by number, so that small tables' images aren't put into one task: masks cost more than their bytes tell.
    dealt = rows.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "media_id")
    packed = dealt.groupBy("media_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["row"])).alias("det"))
    ones = F.array_repeat(F.lit(1.0), 2 * 4 * 4).alias("protos")
    raw = packed.select("media_id", "det", F.lit(8).alias("det_dim"), ones, F.lit(4).alias("proto_h"), F.lit(4).alias("proto_w"), (100 + F.col("media_id") % 200).cast("int").alias("width"), (100 + F.col("media_id") % 100).cast("int").alias("height"))
    found = detect.records(raw, 0.03, 0.45)
    return found.select("media_id", "obj_no", "class_name", "conf", *[F.round(x, 6).alias(x) for x in ("x1", "y1", "x2", "y2")], "mask_area", F.get(F.get("mask_rle", F.lit(0)), F.lit(0)).alias("first_set"))


_CELLS = "cells as (select unnest([8, 16, 32]) as stride, unnest([20, 10, 5]) as cols, unnest([15, 7, 3]) as rows, unnest([0, 1, 2]) as level), places as (select stride, cols, level, unnest(range(cols * rows)) as i from cells)"


@query(
    "v05_faces",
    f"""with {_CELLS}, spots as (select point_id as media_id, stride, i, level, i % cols as col, i // cols as row, greatest(least(vec[(i * 5 + level) % 64 + 1] * 8, 1), 0) as cls, greatest(least(vec[(i * 7 + level) % 64 + 1] * 8, 1), 0) as obj,
        vec[(i * 4) % 64 + 1] as dx, vec[(i * 4 + 1) % 64 + 1] as dy, vec[(i * 4 + 2) % 64 + 1] as lw, vec[(i * 4 + 3) % 64 + 1] as lh, vec[(i * 10) % 64 + 1] as kx from embedding, places),
    found as (select media_id, sqrt(cls * obj) as conf, (col + dx) * stride - exp(lw) * stride / 2 as x, (row + dy) * stride - exp(lh) * stride / 2 as y, exp(lw) * stride as w, exp(lh) * stride as h, (kx + col) * stride as mx from spots)
    select media_id, round(conf, 6) as conf, round(x * 2, 4) as x, round(y * 3, 4) as y, round(w * 2, 4) as w, round(h * 3, 4) as h, round(mx * 2, 4) as mark from found where conf >= 0.7""",
)
def v05_faces(t: Tables) -> DataFrame:
    """An embedding as a face detector's twelve tensors; no suppression, as SQL has none here."""
    v = F.transform("vec", lambda x: x.cast("double"))
    pick = lambda n, index: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.col("v"), index(i).cast("int")))
    cells = (300, 70, 15)
    score = lambda k: [F.transform(pick(n, lambda i, level=level: (i * k + level) % 64), lambda x: x * 8) for level, n in enumerate(cells)]
    outputs = F.array(*score(5), *score(7), *[pick(4 * n, lambda i: i % 64) for n in cells], *[pick(10 * n, lambda i: i % 64) for n in cells])
    raw = t.embedding.select(F.col("point_id").alias("media_id"), v.alias("v")).select("media_id", outputs.alias("outputs"), F.lit(320).alias("width"), F.lit(360).alias("height"))
    found = detect.faces_of(raw, 0.7, overlap=1.0)
    return found.select("media_id", F.round("conf", 6).alias("conf"), *[F.round(c, 4).alias(c) for c in "xywh"], F.round(F.col("landmarks")[0], 4).alias("mark"))


@query("t07_session_leaders", _led("select source as session, point_id as id, vec from embedding", detect.FACE_LEADER) + " select session, id, leader, round(score, 6) as score from led")
def t07_session_leaders(t: Tables) -> DataFrame:
    """Leaders of a stream over the vectors' files, a session a source, as keyed state."""
    root = f"{shared_root(t.spark)}/lumora/stream-{uuid.uuid4().hex}"
    # A stream takes no single file, but a pattern; it finds the table as one file and as a folder.
    stream = t.spark.readStream.schema(t.read("embeddings").schema).parquet(f"{t.dir}/embeddings.parque[t]")
    faces = stream.selectExpr("case when vec_id % 3 = 0 then 'video_frame' else 'image' end as session", "vec_id as id", "embedding as vec")
    session.prepared(t.spark)
    found = session.session_leaders(faces).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
    found.awaitTermination()
    return t.spark.read.schema("session string, id long, leader long, score double").parquet(f"{root}/out").select("session", "id", "leader", _score())


# --- the library's three stages, the index, timeline items


@query(
    "j19_library",
    f"""with recursive {_COSINE}, {_GROUPS}, printed as (select m.id, h.hash from seen m join hashes h on h.id = m.id),
    bitlinks as (select a.id as a, b.id as b from printed a join printed b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= {BITS}),
    bitedges as (select a, b from bitlinks union select b, a from bitlinks), bitreach as (select a as id, a as root from bitedges union select e.b, r.root from bitreach r join bitedges e on e.a = r.id),
    first as (select 'hash' as kind, content_key as group_id, id as media_id from seen where content_key in (select content_key from seen group by 1 having count(*) > 1)),
    second as (select 'phash' as kind, cast(min(root) as varchar) as group_id, id as media_id from bitreach group by id),
    kept2 as (select group_id from second left join (select distinct media_id as m from first) f on f.m = media_id group by 1 having not bool_and(f.m is not null)),
    two as (select * from first union all select * from second where group_id in (select group_id from kept2)),
    alive as (select 'semantic' as kind, cast(root as varchar) as group_id, id as media_id from roots where id in (select id from media)),
    third as (select * from alive where group_id in (select group_id from alive group by 1 having count(*) > 1)),
    kept3 as (select group_id from third left join (select distinct media_id as m from two) f on f.m = media_id group by 1 having not bool_and(f.m is not null))
    select * from two union all select * from third where group_id in (select group_id from kept3)""",
)
def j19_library(t: Tables) -> DataFrame:
    """All three stages over a library whose hashes are kept as hex text."""
    prints = t.hashes.select("id", F.lower(F.hex("hash")).alias("file_phash"))
    return duplicates.library(t.media.join(prints, "id", "left"), t.embedding, most=BITS, threshold=ALIKE)


@query("k10_index_pairs", f"with {_COSINE} select a, b, round(score, 6) as score from pairs")
def k10_index_pairs(t: Tables) -> DataFrame:
    points = t.embedding.where("source = 'image'")
    reps = duplicates.representatives(points)
    return index.near_pairs(reps.select(F.col("media_id").alias("id"), "vec"), points.select(F.col("media_id").alias("id"), "vec"), ALIKE).select("a", "b", _score())


@query("k10_index_hits", f"""with s as (select point_id, media_id, {similarity("e.vec", "q.vec")} as score from embedding e, (select vec from embedding where point_id = 3) q where source = 'image') select point_id, media_id, round(score, 6) as score from s where score >= {NEAR} order by s.score desc, point_id limit 20""")
def k10_index_hits(t: Tables) -> DataFrame:
    found = index.built(t.embedding.select(F.col("point_id").alias("id"), "media_id", "source", "vec"))
    return found.hits(t.vector(3), NEAR, 20, F.col("source") == "image").select(F.col("id").alias("point_id"), "media_id", _score())


@query("p03_timeline_items", "with i as (select *, row_number() over (order by created_at desc nulls last, id) as ord from seen where processed order by created_at desc nulls last, id limit 5000) select i.id, file_name, media_type, favorite, is_hidden, ord::int as ord, coalesce((select string_agg(distinct cast(face_id as varchar), ',' order by cast(face_id as varchar)) from media_faces f where f.media_id = i.id), '') as face_ids from i")
def p03_timeline_items(t: Tables) -> DataFrame:
    found = timeline.projected(timeline.items(t.media), t.faces)
    return found.select("id", "file_name", "media_type", "favorite", "is_hidden", "ord", F.array_join("face_ids", ",").alias("face_ids"))
