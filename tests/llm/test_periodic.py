"""Periodic runs against their definition, place by place, with hard inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import periodic
from lumora.llm.queries import QUERIES
from tests.llm.test_operators import HARD


def smallest_period(words):
    border = [0] * len(words)
    for i in range(1, len(words)):
        k = border[i - 1]
        while k and words[i] != words[k]:
            k = border[k - 1]
        border[i] = k + (words[i] == words[k])
    return len(words) - border[-1]


def brute_runs(words, shortest=periodic.SHORTEST):
    """Every stretch for every period, straight from the definition."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            b = i + q
            if b - a >= max(shortest, 2 * q) and smallest_period(words[a:b]) == q:
                out.add((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(kept))


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_the_definition(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        words = []
        while len(words) < rnd.choice((13, 40, 150, 400)):
            unit = [rnd.randrange(rnd.choice((1, 2, 3, 50))) for _ in range(rnd.randrange(1, 30))]
            words += unit * rnd.randrange(1, 6)
        shortest = rnd.choice((2, 12, 30))
        assert periodic.find_runs(np.array(words), shortest) == brute_runs(words, shortest)


def test_heavy_and_light_counts_are_exact(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(periodic, "CELLS", 5000)  # several portions of heavy words
    for n in (2, 13, 300, 2000):
        codes = rng.zipf(1.3, n) % 200
        want = [0] + [int((codes[:-p] == codes[p:]).sum()) for p in range(1, n // 2 + 1)]
        for heavy in (0, 16, n):
            monkeypatch.setattr(periodic, "HEAVY", heavy)
            assert periodic.lag_matches(codes, n // 2).tolist() == want


def test_long_and_constant_texts():
    assert periodic.find_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    rng = np.random.default_rng(2)
    half = rng.integers(0, 1000, 30_000)
    runs = periodic.find_runs(np.concatenate([half, half]))
    assert (0, 60_000, 30_000) in runs


def test_rows(spark, sf_dir):
    """The hard texts, copies, null ids, and a part of the documents, with repetitions planted as the query does."""
    hard = [(i, t, 7, "x") for i, t in HARD] + [(None, "a b " * 30, 7, "x"), (None, None, 7, "x"), (20, "x y z " * 40 + "q", 7, "x"), (20, "x y z " * 40 + "q", 7, "x")]
    df = spark.createDataFrame(hard, "doc_id long, text string, n_words long, runs string").repartition(3)
    got = collections.Counter(tuple(r) for r in periodic.digests(periodic.runs(periodic.with_planted(df))).collect())
    assert got == collections.Counter(brute_row(i, t) for i, t, _, _ in hard)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {tuple(r) for r in QUERIES["op12_periodic"](spark, sf_dir).collect()}
    assert len(got) == docs.count()
    short = docs.where(F.length("text") < 5000).select("doc_id", "text").collect()
    assert {brute_row(r.doc_id, r.text) for r in short} <= got and sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in short) > 5


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = periodic.digests(periodic.runs(periodic.with_planted(df)))
    assert out.count() == 0 and out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_batches_close_by_bytes():
    import pyarrow as pa

    from lumora.llm.common import parts

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 25, "c", "d" * 100, "e"])], names=["k", "t"])
    cut = [p.column(0).to_pylist() for p in parts([batch, batch.slice(0, 0)], "t", rows=2, size=20)]
    length = {0: 10, 1: 0, 2: 25, 3: 1, 4: 100, 5: 1}
    assert sum(cut, []) == list(range(6)) and max(map(len, cut)) <= 2 and all(sum(length[k] for k in c[:-1]) < 20 for c in cut)
    assert [p.num_rows for p in parts([batch], "t", rows=100, size=20)] == [3, 2, 1]
    assert [p.num_rows for p in parts([batch], "t", rows=100, size=1000)] == [6]
