"""Streams: leaders over batches and restarts, changed files, fencing, progress."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators import detect, ingest
from lumora.sources import changes
from lumora.streaming import session, watch


def finished(query):
    try:
        assert query.awaitTermination(90), query.status
    finally:
        query.stop()
    if query.exception():
        raise query.exception()


def until(query, done, seconds=60):
    """Waits for what a stream without an end does, then stops it."""
    try:
        began = time.monotonic()
        while not done() and time.monotonic() - began < seconds:
            if query.exception():
                raise query.exception()
            time.sleep(0.3)
    finally:
        query.stop()


def test_leaders_over_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x[40] = x[3]
    rows = [("a" if k % 3 else "b", k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "session string, id long, vec array<float>")
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    session.prepared(spark)
    stream = lambda: session.session_leaders(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), 0.5)
    start = lambda: stream().writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    for lo, hi in ((0, 20), (20, 55)):
        df.where(f"id >= {lo} and id < {hi}").coalesce(1).write.mode("append").parquet(src)
    finished(start())
    assert spark.read.parquet(out).count() == 55
    df.where("id >= 55").coalesce(1).write.mode("append").parquet(src)
    finished(start())  # another query on the same checkpoint
    got = {r.id: (r.leader, r.score) for r in spark.read.parquet(out).collect()}
    want = {}
    for s in ("a", "b"):
        want |= {r.id: (r.leader, r.score) for r in detect.leaders(df.where(F.col("session") == s).select("id", "vec"), 0.5).collect()}
    assert len(got) == 90 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all((got[k][1] is None) == (v[1] is None) and (v[1] is None or abs(got[k][1] - v[1]) < 1e-6) for k, v in want.items())
    assert any(v[0] < 20 and k >= 55 for k, v in got.items())


def test_leaders_that_nobody_joins_go(spark, tmp_path):
    """With a time to live, a leader is forgotten unless it is joined."""
    df = spark.createDataFrame([("a", 1, [1.0, 0.0])], "session string, id long, vec array<double>")
    src, seen = str(tmp_path / "src"), []
    df.coalesce(1).write.parquet(src)
    session.prepared(spark)
    stream = session.session_leaders(spark.readStream.schema(df.schema).parquet(src), 0.5, ttl_ms=1500)
    query = stream.writeStream.foreachBatch(lambda batch, n: seen.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").outputMode("append").start()

    def next_face():
        if len(seen) == 1 and not added:
            time.sleep(3)
            df.withColumn("id", F.lit(2).cast("long")).coalesce(1).write.mode("append").parquet(src)
            added.append(1)
        return len(seen) >= 2

    added = []
    until(query, next_face)
    assert [(r.id, r.leader) for r in seen] == [(1, 1), (2, 2)]


def test_vectors_that_are_null_or_odd_lead_alone(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, None), ("a", 3, [1.0]), ("a", 4, [2.0, 0.0]), ("a", None, [1.0, 0.0]), ("a", 5, [0.0, 0.0])], "session string, id long, vec array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    session.prepared(spark)
    stream = session.session_leaders(spark.readStream.schema(df.schema).parquet(str(tmp_path / "src")), 0.5)
    finished(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")))
    assert sorted((r.id, r.leader) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 5)]


def test_changed_files_come_again(spark, tmp_path):
    """A rewritten file gives a second row, also after a restart, and once only; a file moved in with an old date gives one too."""
    folder, ck, seen = tmp_path / "library", str(tmp_path / "ck"), []
    (folder / "sub").mkdir(parents=True)
    (folder / "a.jpg").write_bytes(b"one")
    (folder / "sub" / "b.mp4").write_bytes(b"two")
    (folder / "notes.txt").write_bytes(b"no media")
    take = lambda batch, n: seen.extend((os.path.basename(r.path), r.length) for r in batch.collect())
    start = lambda: watch.run(watch.changes(spark, str(folder), 0.5), take, ck)
    until(start(), lambda: len(seen) >= 2)
    assert sorted(seen) == [("a.jpg", 3), ("b.mp4", 3)]
    (folder / "a.jpg").write_bytes(b"changed")  # while nobody looks
    (tmp_path / "c.png").write_bytes(b"old")
    os.utime(tmp_path / "c.png", (1e9, 1e9))
    os.rename(tmp_path / "c.png", folder / "sub" / "c.png")
    query = start()
    began = time.monotonic()
    until(query, lambda: len(seen) >= 4 and time.monotonic() - began > 8)  # some empty batches more
    assert sorted(seen[2:]) == [("a.jpg", 7), ("c.png", 3)]


def test_stamps_bound_a_batch(tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.jpg").write_bytes(b"1234")
    reader = changes.Reader(str(tmp_path), 0)
    (path, stamp, size), = changes.stamped(str(tmp_path))
    parts = lambda a, b: [r for p in reader.partitions({"until": a}, {"until": b}) for r in reader.read(p)]
    assert size == 4 and [len(parts(a, b)) for a, b in ((0, stamp - 1), (stamp - 1, stamp), (stamp, stamp + 1))] == [0, 1, 0]
    assert list(changes.stamped(str(tmp_path / "gone"))) == [] and changes.Reader(str(tmp_path / "gone"), 0).partitions({"until": 0}, {"until": 1}) == []


def source(spark, path, n=3):
    for k in range(n):
        spark.createDataFrame([(f"/in/{k}{j}.jpg", ("insert", "skip", "reset", "error")[j]) for j in range(4)], "path string, action string").coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema("path string, action string").option("maxFilesPerTrigger", 1).parquet(path)


def test_replaced_stream_cannot_write(spark, tmp_path):
    """Two streams on one target: once the second has begun, the first one's next batch is refused."""
    read, target, wrote = source(spark, str(tmp_path / "src")), str(tmp_path / "target"), []
    second = []

    def first(batch, n):
        wrote.append(("first", n))
        if n == 0:
            second.append(watch.Fence(spark, target))  # another stream takes over while the batch runs

    query = watch.run(read(), first, str(tmp_path / "ck1"), available_now=True, target=target)
    with pytest.raises(Exception, match="StaleEpoch|was replaced"):
        query.awaitTermination(60)
    assert wrote == [("first", 0)] and not os.path.exists(tmp_path / "ck1" / "commits" / "0")
    second[0].check()
    finished(watch.run(read(), lambda batch, n: wrote.append(("third", n)), str(tmp_path / "ck3"), available_now=True, target=target))
    assert wrote[1:] == [("third", 0), ("third", 1), ("third", 2)]
    with pytest.raises(watch.StaleEpoch):
        second[0].check()
    again = [watch.Fence(spark, target).epoch for _ in range(2)]
    assert again[1] == again[0] + 1


def test_progress_counts_what_the_summary_counts(spark, tmp_path):
    read, progress = source(spark, str(tmp_path / "src")), watch.Progress()
    spark.streams.addListener(progress)
    try:
        finished(watch.counted(read()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")))
        began = time.monotonic()
        while len(progress.rows) < 3 and time.monotonic() - began < 20:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    assert progress.totals == ingest.summary(spark.read.parquet(str(tmp_path / "out"))).first().asDict() == {"found": 12, "new": 6, "skipped": 3, "errors": 3}
    progress.write(spark, str(tmp_path / "progress"))
    rows = spark.read.parquet(str(tmp_path / "progress")).orderBy("batch").collect()
    assert [(r.batch, r.found, r.current) for r in rows] == [(0, 4, "/in/03.jpg"), (1, 4, "/in/13.jpg"), (2, 4, "/in/23.jpg")] or sum(r.found for r in rows) == 12
    assert progress.rows == []
