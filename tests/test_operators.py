"""Goldens and properties of the operators that SQL doesn't express, and of orders and limits."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators import albums, detect, duplicates, graph, ingest, mutate, people, search, timeline, video
from lumora.streaming import watch


def test_limit_comes_before_filter(spark):
    rows = [(i, "image" if i == 0 else "video", f"2020-01-01 00:00:{i % 60:02d}", None, False) for i in range(300)]
    media = spark.createDataFrame([(i, m, f"20{99 - i // 10:02d}-01-01 00:00:00", d, h) for i, m, _, d, h in rows], "id long, media_type string, created_at string, deleted_at string, is_hidden boolean")
    found = search.newest(media)
    assert found.count() == 200
    last = media.withColumn("media_type", F.when(F.col("id") == 299, "image").otherwise("video"))
    assert search.newest(last).where("media_type = 'image'").count() == 0 and search.newest(last.where("media_type = 'image'")).count() == 1


def test_mode_and_filters(spark):
    assert [search.mode(*x) for x in ((True, True, search.Filters()), (False, True, search.Filters()), (False, False, search.Filters(object="a", face="b")), (False, False, search.Filters()))] == ["combined", "image", "object", "filter"]
    assert search.Filters(month=1, year=2).active == 2


def test_timeline_order(spark):
    rows = [(1, "2020-01-02 00:00:00"), (2, "2020-02-01 00:00:00"), (3, "2020-01-03 00:00:00"), (4, None)]
    media = spark.createDataFrame([(i, c, None, False, True) for i, c in rows], "id long, created_at string, deleted_at string, is_hidden boolean, processed boolean")
    got = [(r.y, r.m, r.label, [i.id for i in r["items"]]) for r in timeline.months(timeline.items(media), ["id"]).collect()]
    assert got == [(2020, 2, "Tháng 2 2020", [2]), (2020, 1, "Tháng 1 2020", [3, 1]), (1970, 1, "Tháng 1 1970", [4])]


def test_banded_hamming_is_brute_force(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(12))) for b in base for _ in range(4)] + base[:2]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    for most in (0, 3, 8):
        got = sorted(tuple(r) for r in graph.hamming_pairs(rows, most).collect())
        want = sorted((i, j, (values[i] ^ values[j]).bit_count()) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= most)
        assert got == want


def test_components_do_not_depend_on_order(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 300)]
    want = {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 102: 100}
    for seed in (1, 2):
        rnd = random.Random(seed)
        mixed = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in edges]
        rnd.shuffle(mixed)
        got = {r.id: r.root for r in graph.components(spark.createDataFrame(mixed, "a long, b long")).collect()}
        assert got == want


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _iou(a, b):
    w = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0)
    h = max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_suppression(spark):
    rnd = np.random.default_rng(2)
    rows = [(int(m), k, float(np.round(rnd.random(), 2)), *map(float, rnd.integers(1, 30, 4))) for m in range(4) for k in range(15)]
    df = spark.createDataFrame(rows, "media_id long, obj_no int, conf double, x double, y double, w double, h double")
    got = {(r.media_id, r.obj_no) for r in detect.suppressed(df, 0.3).collect()}
    want = set()
    for m in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == m), key=lambda r: (-r[2], r[1])):
            if all(_iou(r[3:], k[3:]) <= 0.3 for k in kept):
                kept.append(r)
        want |= {r[:2] for r in kept}
    assert got == want


def test_suppression_keeps_what_only_equals_the_threshold(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 2, 0.8, 0.0, 0.0, 2.0, 1.0), (1, 3, 0.7, 0.0, 0.0, 2.0, 2.0)], "media_id long, obj_no int, conf double, x double, y double, w double, h double")
    assert sorted(r.obj_no for r in detect.suppressed(df, 0.5).collect()) == [1, 2]


def test_leaders(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(60, 6))
    got = {r.id: r.leader for r in detect.leaders(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>"), 0.5).collect()}
    u = x.astype(np.float32).astype(float)
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8)
    lead, want = [], {}
    for i in range(60):
        best = max(((cos(u[i], u[j]), -j) for j in lead), default=(0, 0))
        if best[0] > 0.5:
            want[i] = -best[1]
        else:
            lead.append(i)
            want[i] = i
    assert got == want


def test_scenes_and_samples(spark):
    cuts = spark.createDataFrame([(1, 450, 9000), (1, 90, 9000), (1, 90, 9000)], "media_id long, frame_idx long, total_frames long")
    found = video.scenes(cuts)
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(0, 0, 89), (1, 90, 449), (2, 450, 8999)]
    got = {}
    for r in video.samples(found).orderBy("scene", "ord").collect():
        got.setdefault(r.scene, []).append(r.frame)
    assert got[0] == [17, 44, 71] and got[1] == [161, 269, 377]


def test_kept_frames(spark):
    rows = [(1, 0, 0, 10, 5.0), (1, 0, 1, 11, 250.0), (1, 0, 2, 12, 6.0), (1, 1, 0, 20, 100.0), (1, 1, 1, 21, 1.0), (1, 2, 0, 30, None)]
    frames = spark.createDataFrame(rows, "media_id long, scene int, ord int, frame long, luma double")
    assert sorted(r.frame for r in video.kept(frames).collect()) == [11, 20, 30]


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ((0.5, "a"), [(0.6, None)], (0.6, "a")),
        ((0.5, "a"), [(0.6, "b")], (0.6, "b")),
        ((0.5, "a"), [(0.5, "b")], (0.5, "b")),
        ((0.5, "a"), [(0.4, None)], (0.5, "a")),
        ((None, None), [(0.1, None), (0.1, "c")], (0.1, "c")),
        ((0.5, "a"), [(None, "d")], (0.5, "d")),
    ],
)
def test_person_merge(spark, old, new, want):
    person = spark.createDataFrame([(1, old[1], old[0], "old")], "face_id long, name string, conf double, thumbnail string")
    rows = spark.createDataFrame([(1, n, c, "new", k) for k, (c, n) in enumerate(new)], "face_id long, name string, conf double, thumbnail string, ord long")
    got = people.merged(person, rows).first()
    assert (got.conf, got.name) == want and got.thumbnail == ("new" if got.conf != old[0] else "old")


def test_classify(spark):
    known = spark.createDataFrame([(1, "a", 5, "t", "h", True), (2, "b", 5, None, "h2", False), (3, "c", 5, "t", "h3", True)], "id long, file_name string, file_size long, meta_modified_at string, file_sha256 string, processed boolean")
    files = spark.createDataFrame([("1", "a", 5, "t", "zz"), ("2", "b", 5, None, "x"), ("3", "a", 6, "t", "h"), ("4", "c", 7, "t", "new"), ("5", "z", 5, "t", "h")], "path string, name string, size long, modified_at string, sha256 string")
    got = {r.path: (r.action, r.media_id) for r in ingest.classified(files, known).collect()}
    assert got == {"1": ("skip", 1), "2": ("reprocess", 2), "3": ("skip", 1), "4": ("reset", 3), "5": ("insert", None)}
    assert sorted(r.path for r in ingest.unhashed(files, known).collect()) == ["3", "4", "5"]


def test_stage_suppression(spark):
    first = spark.createDataFrame([("x", 1), ("x", 2)], "group_id string, media_id long")
    second = spark.createDataFrame([("y", 1), ("y", 2), ("z", 2), ("z", 3)], "group_id string, media_id long")
    got = {(r.kind, r.group_id) for r in duplicates.staged([("hash", first), ("near", second)]).collect()}
    assert got == {("hash", "x"), ("near", "z")}


def test_unknown_favourite(spark):
    media = spark.createDataFrame([(1, False)], "id long, favorite boolean")
    assert mutate.favourite_toggled(media, 1).first().favorite is True
    with pytest.raises(KeyError):
        mutate.favourite_toggled(media, 2)


def test_hard_delete_needs_trash(spark):
    media = spark.createDataFrame([(1, None), (2, "t")], "id long, deleted_at string")
    assert [r.id for r in mutate.deleted(mutate.deleted(media, 1), 2).collect()] == [1] and mutate.deleted(media, 1, False).count() == 1


def test_stream_is_batch(spark, tmp_path):
    rows = [(f"/in/{k % 7}.{'jpg' if k % 3 else 'txt'}", "create", f"2024-01-01 00:{k:02d}:00") for k in range(30)]
    events = spark.createDataFrame(rows, "path string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = watch.media_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    seen = []
    q = watch.run(watch.once(stream, "1 day"), lambda batch, n: seen.extend(r.path for r in batch.collect()), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert sorted(seen) == sorted(r.path for r in watch.media_events(events).select("path").distinct().collect())


def test_bursts(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:09"), ("b", "2024-01-01 00:00:01")], "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.path, r.n) for r in watch.bursts(rows).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_anchors(spark):
    assert detect.anchors(spark, 160, 120).groupBy("stride").count().orderBy("stride").collect()[0]["count"] == 300


def _plain_leaders(vecs, threshold):
    leads, out = [], {}
    for k, v in enumerate(vecs):
        best = max(((float(v @ vecs[a]) / (np.linalg.norm(v) * np.linalg.norm(vecs[a]) + 1e-8), -a) for a in leads), default=(-2, 0))
        if best[0] > threshold:
            out[k] = -best[1]
        else:
            leads.append(k)
            out[k] = k
    return out


def test_leaders_of_a_chain(spark):
    """Each face is like its neighbours only: what the rounds leave open is settled in order."""
    vecs = np.zeros((140, 141))
    for k in range(140):
        vecs[k, k], vecs[k, k + 1] = 1, 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "id long, vec array<double>")
    got = {r.id: r.leader for r in detect.leaders(df, 0.33, rounds=3).collect()}
    assert got == _plain_leaders(vecs, 0.33)


def test_nearest_of_many_references(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(100, 4)), rng.normal(size=(130, 4))
    y[77] = y[12]
    faces, refs = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], f"{name} long, vec array<double>") for m, name in ((x, "id"), (y, "ref_id")))
    s = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1) + 1e-8)
    want = {k: (int(s[k].argmax()) if s[k].max() > 0.9 else None) for k in range(100)}
    assert {r.id: r.ref_id for r in graph.nearest_reference(faces, refs, 0.9).collect()} == want
    assert {r.ref_id for r in graph.nearest_reference(faces, refs.limit(0), 0.9).collect()} == {None}


def test_null_keys_stay(spark):
    person = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "face_id long, name string")
    faces = spark.createDataFrame([(1, "a"), (None, "z")], "face_id long, name string")
    who, moved = people.joined(person, faces, 1, 2)
    assert sorted((r.face_id or 0, r.name) for r in who.collect()) == [(0, "c"), (1, "a")] and (None, "z") in [tuple(r) for r in moved.collect()]
    album = spark.createDataFrame([(1, "a"), (None, "b")], "id long, title string")
    members = spark.createDataFrame([(1, 5), (None, 6)], "album_id long, media_id long")
    left = mutate.album_deleted(album, members, 1)
    assert [x.count() for x in left] == [1, 1]
    media_ = spark.createDataFrame([(1, None), (None, None)], "id long, deleted_at string")
    assert mutate.deleted(media_, 1, only_trashed=False).count() == 1


def test_album_and_people_columns(spark):
    album = spark.createDataFrame([(1, "old", "2020"), (2, "new", "2021")], "id long, title string, created_at string")
    members = spark.createDataFrame([(1, 5)], "album_id long, media_id long")
    m = spark.createDataFrame([(5, "f.jpg", "t.jpg", "k", None, False)], "id long, file_name string, thumbnail string, content_key string, deleted_at string, is_hidden boolean")
    assert [tuple(r) for r in albums.albums(album, members, m).collect()] == [(2, "new", 0, None, None), (1, "old", 1, "f.jpg", "t.jpg")]
    faces = spark.createDataFrame([(5, 1, 9, 0.5, 1.0, 2.0, 3.0, 4.0)], "media_id long, face_no int, face_id long, conf double, x double, y double, w double, h double")
    person = spark.createDataFrame([(9, "n", 0.7, "p.jpg")], "face_id long, name string, conf double, thumbnail string")
    r = people.people(faces, m, person).first()
    assert (r.thumbnail, r.face_bbox.w, r.conf) == ("p.jpg", 3.0, 0.7)
