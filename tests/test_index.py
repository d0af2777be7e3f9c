"""The index against products of all vectors: hits and pairs are exact, odd vectors are like nothing, lists are skipped."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumora.functions import vectors
from lumora.operators import detect, graph, index, search


def clustered(n=600, width=16, seed=1, spread=0.25):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 20, width))
    x = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, width)) * spread
    x[5] = x[9]
    return x.astype(np.float32)


def frame(spark, x, odd=True):
    rows = [(k, k % 50, "image" if k % 3 else "video_frame", v.tolist()) for k, v in enumerate(x)]
    if odd:
        rows += [(9000, 1, "image", None), (9001, 1, "image", []), (9002, 1, "image", [1.0]), (9003, 1, "image", [0.0] * x.shape[1]), (9004, 1, "image", [float("nan")] + [1.0] * (x.shape[1] - 1)), (9005, 1, "image", [float("inf")] * x.shape[1])]
    return spark.createDataFrame(rows, "id long, media_id long, source string, vec array<float>").repartition(4)


def cosines(x, y):
    x, y = x.astype(float), y.astype(float)
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1) + 1e-8)


@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.05])
def test_hits_are_all_vectors_hits(spark, threshold):
    x = clustered()
    found = index.built(frame(spark, x))
    assert found.rows.count() == len(x)
    for point, limit in ((5, 10), (77, 3), (300, 1000)):
        s = cosines(x[point : point + 1], x)[0]
        want = sorted((-round(v, 9), k) for k, v in enumerate(s.tolist()) if v >= threshold)[:limit]
        got = [(-round(r.score, 9), r.id) for r in found.hits(x[point].tolist(), threshold, limit).collect()]
        assert got == want
    only = found.hits(x[5].tolist(), threshold, 10, F.col("source") == "image").collect()
    s = cosines(x[5:6], x)[0]
    assert [r.id for r in only] == [k for _, k in sorted((-round(v, 9), k) for k, v in enumerate(s.tolist()) if v >= threshold and k % 3)][:10]
    assert found.hits([1.0], threshold, 5).count() == 0 and found.hits([0.0] * 16, threshold, 5).count() == 0


@pytest.mark.parametrize(("threshold", "strict"), [(0.9, False), (0.3, True)])
def test_pairs_are_all_vectors_pairs(spark, monkeypatch, threshold, strict):
    monkeypatch.setattr(index, "BLOCK", 40)
    x = clustered(400)
    df = frame(spark, x)
    s = cosines(x, x)
    want = {(i, j): s[i, j] for i in range(400) for j in range(i + 1, 400) if (s[i, j] > threshold if strict else s[i, j] >= threshold)}
    for got in (index.near_pairs(df, df, threshold, strict), graph.cosine_pairs(df.where("id < 9000"), df.where("id < 9000"), threshold, strict)):
        rows = {(r.a, r.b): r.score for r in got.collect()}
        assert rows.keys() == want.keys() and all(abs(rows[k] - v) < 1e-9 for k, v in want.items())
    best = {i: int(s[i, :50].argmax()) if s[i, :50].max() > threshold else None for i in range(50, 400)}
    monkeypatch.setattr(graph, "GRID", 0)
    refs = df.where("id < 50").select(F.col("id").alias("ref_id"), "vec")
    got = {r.id: r.ref_id for r in graph.nearest_reference(df.where("id >= 50 and id < 9000").select("id", "vec"), refs, threshold).collect()}
    assert {k: (v if v != 9 else 5) for k, v in got.items()} == {k: (v if v != 9 else 5) for k, v in best.items()}


def test_ids_that_repeat_keep_the_best(spark):
    x = clustered(200)
    df = frame(spark, x, odd=False).withColumn("id", F.col("media_id"))
    got = {(r.a, r.b): r.score for r in index.near_pairs(df, df, 0.8).collect()}
    want = {(r.a, r.b): r.score for r in graph.cosine_pairs(df, df, 0.8).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_leaders_by_the_index(spark, monkeypatch):
    x = clustered(300)
    df = frame(spark, x, odd=False).select("id", "vec")
    want = {r.id: r.leader for r in detect.leaders(df, 0.8).collect()}
    monkeypatch.setattr(graph, "GRID", 0)
    assert {r.id: r.leader for r in detect.leaders(df, 0.8).collect()} == want


def test_lists_are_skipped():
    """Far directions aren't compared: on clusters a row visits few lists, and candidates are near the true pairs."""
    x = clustered(4000, 24, spread=0.12).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    pivots = unit[::16]
    by = index.angles(unit, pivots)
    nearest = by.argmin(axis=1)
    own = by[np.arange(4000), nearest]
    k = len(pivots)
    low = np.array([own[nearest == c].min(initial=np.inf) for c in range(k)])
    high = np.array([own[nearest == c].max(initial=-np.inf) for c in range(k)])
    found = index.Index(None, pivots, np.bincount(nearest, minlength=k), low, high)
    met = found.reached(by, np.arccos(0.92)) @ found.sizes
    assert met.mean() < 0.1 * 4000, met.mean()
    q, scale, err = index.quantised(unit)
    assert (np.abs((q * scale[:, None]) @ unit[:50].T - unit @ unit[:50].T) <= err[:, None] + 1e-12).all() and err.max() < 0.02


def test_empty_index(spark):
    df = frame(spark, clustered(20)).limit(0)
    assert index.near_pairs(df, df, 0.5).count() == 0 and index.built(df).hits([1.0] * 16, 0.5, 3).count() == 0


def test_search_by_the_index_is_the_scan(spark):
    x = clustered(500)
    df = frame(spark, x).withColumnRenamed("id", "point_id")
    want = [(r.point_id, round(r.score, 9)) for r in search.top_hits(df, x[3].tolist(), 0.4, 25).collect()]
    found = index.built(df.withColumnRenamed("point_id", "id"))
    assert [(r.id, round(r.score, 9)) for r in found.hits(x[3].tolist(), 0.4, 25).collect()] == want and vectors.EPSILON


def test_candidates_are_rows_not_ids(spark):
    """Rows of one id don't bring one another in; else few ids of many rows would all be scored."""
    x = clustered(300)
    df = frame(spark, x, odd=False).withColumn("id", F.col("id") % 3)
    found, own = index.built(df), df.withColumn("row", F.monotonically_increasing_id())
    s = cosines(x, x)
    ids = np.arange(300) % 3
    may = found.pairs(own, 0.9)
    assert may.columns == ["left", "right"]
    n, true = may.count(), int(((s >= 0.9) & (ids[:, None] < ids)).sum())
    assert true <= n <= 1.5 * true + 50


def test_angles_in_memory_are_bounded():
    batch = pa.RecordBatch.from_pydict({"id": list(range(5000))})
    sizes = [p.num_rows for p in index.parts(batch, 4096)]
    assert sum(sizes) == 5000 and max(sizes) * 4096 <= index.ANGLES
