"""Pairs by blocks: every pair of blocks meets, whatever the blocks' number, and groups need few links."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumora.operators import duplicates, graph
from lumora.plans import registry


def hashes(spark, n=300, bits=62):
    rnd = random.Random(2)
    values = [rnd.getrandbits(bits) for _ in range(n)]
    values += [values[0]] * 40 + [values[1] ^ (1 << k) for k in range(bits)]
    return values, spark.createDataFrame([*enumerate(values), (9000, None)], "id long, hash long").repartition(7)


def test_wide_hamming_meets_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "HASHES", 50)
    values, rows = hashes(spark)
    want = sorted((i, j, d) for (i, x), (j, y) in itertools.combinations(enumerate(values), 2) if (d := (x ^ y).bit_count()) <= 18)
    assert sorted(tuple(r) for r in graph.hamming_pairs(rows, 18, 62).collect()) == want
    links = graph.hamming_links(rows, 18, 62)
    assert links.count() < len(want) / 2
    got, root = {r.media_id: r.group_id for r in duplicates.near(rows, 18, 62).collect()}, list(range(len(values)))
    for _ in range(len(values)):
        was = list(root)
        for i, j, _d in want:
            root[i] = root[j] = min(root[i], root[j])
        if was == root:
            break
    assert got == {k: root[k] for k in {x for i, j, _d in want for x in (i, j)}}


@pytest.mark.parametrize("same", [True, False])
def test_vectors_of_several_blocks_meet(spark, monkeypatch, same):
    """Three blocks a side, in many partitions that are not put together: once the two sides' keys were of different types and did not meet."""
    monkeypatch.setattr(graph, "BLOCK", 40)
    x = np.random.default_rng(4).normal(size=(110, 6))
    frame = lambda: spark.createDataFrame([*[(k, v.tolist()) for k, v in enumerate(x)], (500, None), (501, []), (None, [1.0] * 6)], "id long, vec array<double>")
    s = (x @ x.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1) + 1e-8)
    want = {(i, j) for i, j in itertools.combinations(range(110), 2) if s[i, j] >= 0.5}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left = frame()
        got = {(r.a, r.b): r.score for r in graph.cosine_pairs(left, left if same else frame(), 0.5).collect()}
        refs = frame().where("id < 100").select(F.col("id").alias("ref_id"), "vec")
        near = {r.id: r.ref_id for r in graph.nearest_reference(frame().where("id >= 50"), refs, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.keys() == want and all(abs(v - s[k]) < 1e-12 for k, v in got.items())
    best = s[:, :100].argmax(axis=1)
    assert near == {**{k: int(best[k]) if s[k, best[k]] > 0.5 else None for k in range(50, 110)}, 500: None, 501: None}


def test_session_leaders_of_a_table_in_parts(spark, sf_dir, tmp_path):
    """A table may be one file or a folder of files."""
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = ({tuple(r) for r in registry.QUERIES["t07_session_leaders"](spark, d).collect()} for d in (str(tmp_path), sf_dir))
    assert got == want and len(got) > 100


def test_cosine_pairs_of_all_sources(spark):
    """Points of videos' frames take part as images' do."""
    rows = [(0, 1, 0, "image", [1.0, 0.0]), (1, 2, 0, "video_frame", [1.0, 0.1]), (2, 3, 0, "video_frame", [0.0, 1.0]), (3, 3, 1, "image", [1.0, 0.2])]
    points = spark.createDataFrame(rows, "point_id long, media_id long, frame_idx long, source string, vec array<double>")
    assert {(r.a, r.b) for r in duplicates.by_any_vector(points, 0.9).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.a, r.b) for r in duplicates.by_vector(points, 0.9).collect()} == {(1, 3)}
    assert "source = 'image'" not in registry.ORACLES["j12_cosine_pairs"].split("reps as")[1]


def test_blocks_meet_in_parts_of_bounded_size(spark, monkeypatch):
    """Equal rows (id, vector) fall into one block, however many; its rows are unpacked a part at a time, and every part meets every other."""
    x = np.random.default_rng(6).normal(size=(30, 5))
    rows = [(k, v.tolist(), True) for k, v in enumerate(x)] + [(k, v.tolist(), False) for k, v in enumerate(x)] + [(29, x[29].tolist(), False)] * 500
    batch = pa.RecordBatch.from_pylist([dict(zip(("id", "vec", "left"), r, strict=True)) for r in rows])
    met = collections.Counter()
    for ia, a, ib, b in graph._meetings(iter([batch]), 16):
        assert len(ia) == len(a) <= 16 and len(ib) == len(b) <= 16
        met.update(itertools.product(ia.to_pylist(), ib.to_pylist()))
    assert met == {(i, j): 501 if j == 29 else 1 for i in range(30) for j in range(30)}

    monkeypatch.setattr(graph, "PART", 7)
    monkeypatch.setattr(graph, "SCORED", 5)
    side = lambda of: spark.createDataFrame([r[:2] for r in rows if r[2] == of], "id long, vec array<double>")
    s = (x @ x.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1) + 1e-8)
    got = {(r.a, r.b): r.score for r in graph.cosine_pairs(side(True), side(False), 0.3).collect()}
    assert got.keys() == {(i, j) for i, j in itertools.combinations(range(30), 2) if s[i, j] >= 0.3} and all(abs(v - s[k]) < 1e-12 for k, v in got.items())
