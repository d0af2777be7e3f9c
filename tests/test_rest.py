"""Small functions that no query runs, against their definitions."""

import datetime
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lumora.functions import labels, scalar, text
from lumora.operators import ingest, media, mutate, timeline
from lumora.sources import library
from lumora.streaming import watch


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_times_as_text(spark):
    at = datetime.datetime(2024, 2, 29, 23, 59, 59, 999_999)
    (utc, epoch), = values(spark, [(at, 86_399)], "ts timestamp, epoch long", scalar.utc_text(F.col("ts")), scalar.rfc3339(F.col("epoch")))
    assert utc == "2024-02-29 23:59:59" and epoch in ("1970-01-01T23:59:59+00:00", "1970-01-01T23:59:59Z")


def test_shares_of_two_classes(spark):
    got = [r[0] for r in values(spark, [(0.0, 0.0), (-500.0, 500.0), (500.0, -500.0), (1.0, 3.0)], "a double, b double", scalar.softmax2(F.col("a"), F.col("b")))]
    assert got == pytest.approx([0.5, 1.0, 0.0, 1 / (1 + 2.718281828459045**-2)], abs=2e-6)


def test_unpadded_and_brightness(spark):
    c = [F.lit(float(x)) for x in (10, 0.5, 100)]
    assert [r[0] for r in values(spark, [(5.0,), (30.0,), (500.0,)], "v double", scalar.unpadded(F.col("v"), *c))] == [0.0, 40.0, 100.0]
    assert [r[0] for r in values(spark, [(24.9,), (25.0,), (240.0,), (240.1,), (None,)], "l double", scalar.good_brightness(F.col("l")))] == [False, True, True, False, True]


def test_uploads(spark):
    rows = [("image/png", "x"), ("video/mp4", "x.txt"), ("text/plain", "a.JPG"), (None, "b.mp4"), ("text/plain", "c.txt"), (None, None), ("myimage/png", "d")]
    assert [r[0] for r in values(spark, rows, "mime string, path string", scalar.uploadable(F.col("mime"), F.col("path")))] == [True, True, True, True, False, False, False]


def test_flat_rows_become_nested(spark):
    row = media.with_file(spark.createDataFrame([(1, "a.jpg", 5, "h", 640, None)], "id long, file_name string, file_size long, file_sha256 string, meta_width int, meta_created_at string")).first()
    assert row.asDict(True) == {"id": 1, "file": {"name": "a.jpg", "size": 5, "sha256": "h"}, "metadata": {"width": 640, "created_at": None}}
    assert media.with_file(spark.createDataFrame([(1,)], "id long")).columns == ["id"]


def test_class_names(spark):
    names = spark.createDataFrame([(0, "person"), (2, "cat")], "number int, name string")
    got = labels.class_name(spark.createDataFrame([(0,), (1,), (2,), (2,)], "class_no int"), names)
    assert sorted(r.class_name for r in got.collect()) == ["cat", "cat", "cls_1", "person"]


def test_images_come_before_videos(spark):
    frame = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in ingest.work_list(frame("z.jpg", "b.jpg"), frame("a.mp4", "c.mp4")).collect()] == ["b.jpg", "z.jpg", "a.mp4", "c.mp4"]


def test_changes_of_tables(spark):
    album = spark.createDataFrame([("1", "old", "2020")], "id string, title string, created_at string")
    new = mutate.album_created(album, "new", F.lit("2024-01-01 00:00:00")).where("title = 'new'").collect()
    assert len(new) == 1 and uuid.UUID(new[0].id).version == 4 and new[0].created_at == "2024-01-01 00:00:00"
    points = spark.createDataFrame([("p", 1, [1.0, 2.0])], "point_id string, media_id long, vec array<float>")
    added = mutate.vectors_added(points, spark.createDataFrame([(2, [3.0, 4.0])], "media_id long, vec array<float>"), 2).orderBy("media_id").collect()
    assert [r.media_id for r in added] == [1, 2] and uuid.UUID(added[1].point_id).version == 4
    with pytest.raises(Exception, match="2 components"):
        mutate.vectors_added(points, spark.createDataFrame([(2, [3.0])], "media_id long, vec array<float>"), 2).collect()
    assert [t.count() for t in mutate.cleared(album, points)] == [0, 0] and mutate.cleared(album)[0].schema == album.schema


def test_listed_files(spark):
    rows = library.listed(spark, ["/in/a.jpg", "/lib/b.mp4", "/in/c.txt", "/library/d.png"], "/lib/").collect()
    assert [(r.name, r.media_type, r.supported, r.target) for r in rows] == [("a.jpg", "image", True, "/lib/a.jpg"), ("b.mp4", "video", True, "/lib/b.mp4"), ("c.txt", None, False, "/lib/c.txt"), ("d.png", "image", True, "/lib/d.png")]


def test_functions_by_name(spark):
    text.register(spark)
    row = spark.sql("select nfc('e\u0301') as n, name_uuid('x') as u, name_uuid('x') as v").first()
    assert row.n == "é" and row.u == row.v and uuid.UUID(row.u).version == 5


def test_timeline_items_with_faces(spark):
    rows = spark.createDataFrame([(1, "a.jpg", "image", "2020-01-02 00:00:00", True, False, None, True), (2, "b.jpg", "image", "2020-01-03 00:00:00", False, False, None, True), (3, "c.jpg", "image", "2020-01-04 00:00:00", False, False, None, False)], "id long, file_name string, media_type string, created_at string, favorite boolean, is_hidden boolean, deleted_at string, processed boolean")
    faces = spark.createDataFrame([(1, 9), (1, 10), (1, 9), (3, 4), (None, 1)], "media_id long, face_id long")
    got = {r.id: (r.ord, r.favorite, r.face_ids) for r in timeline.projected(timeline.items(rows), faces).collect()}
    assert got == {2: (1, False, []), 1: (2, True, ["10", "9"])}


def test_status_and_new_files(spark, tmp_path):
    """A stream of new files, and the listener that tells where it is; a failing batch is an error with its message."""
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.jpg").write_bytes(b"1")
    (folder / "sub" / "b.png").write_bytes(b"22")
    status, seen = watch.SyncStatus(), []
    spark.streams.addListener(status)

    def wait(state):
        began = time.monotonic()
        while status.state != state and time.monotonic() - began < 20:
            time.sleep(0.1)
        return status.state

    try:
        files = watch.new_files(spark, str(folder)).select("path", "length")
        query = watch.run(files, lambda batch, n: seen.extend(r.length for r in batch.collect()), str(tmp_path / "ck"), available_now=True)
        assert query.awaitTermination(60) and wait("done") == "done" and sorted(seen) == [1, 2] and status.rows >= 2

        def fails(batch, n):
            raise ValueError("out of order")

        query = watch.run(files, fails, str(tmp_path / "ck2"), available_now=True)
        with pytest.raises(Exception, match="out of order"):
            query.awaitTermination(60)
        assert wait("error") == "error" and "out of order" in status.message
    finally:
        spark.streams.removeListener(status)


def test_scratch_tables_go_and_threads_keep_apart(spark):
    """A block deletes what it wrote, an inner one its own first; what another thread writes meanwhile stays."""
    import threading

    from lumora.checkpoints import scratch, written

    there = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rpartition("/")[0])
    exists = lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    made = {}
    with scratch(spark):
        made["outer"] = there(written(spark.range(1).toDF("a"), "t"))
        with scratch(spark):
            made["inner"] = there(written(spark.range(1).toDF("a"), "t"))
            other = threading.Thread(target=lambda: made.update(other=there(written(spark.range(1).toDF("a"), "t"))))
            other.start()
            other.join()
        assert [exists(made[k]) for k in ("outer", "inner", "other")] == [True, False, True]
    assert [exists(made[k]) for k in ("outer", "inner", "other")] == [False, False, True]
