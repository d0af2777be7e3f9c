"""Line dedup against brute force and its SQL, both ways of dropping, levels of runs, and hard inputs."""

import collections
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumora.llm import linededup
from lumora.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import HARD

WHITE = r"[\x20\x09-\x0D]"


def brute(rows, least_docs=10, least_chars=1):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(f"^{WHITE}+|{WHITE}+$", "", line))
    docs = collections.Counter()
    for _, t in rows:
        docs.update({key(x) for x in (t or "").split("\n")})
    common = {k for k, n in docs.items() if n >= least_docs and len(k) >= least_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in common]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return collections.Counter(out)


def rows_of(seed=3, n=90):
    rnd = random.Random(seed)
    lines = ["Cookie policy", " cookie POLICY\t", "\x1cx", "İstanbul", "istanbul", "ÉTÉ", "été", "", "   ", "\r", "é", "you", "you."] + [f"line {k}" for k in range(40)]
    rows = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(8)))) for k in range(n)]
    return rows + HARD + [(None, "you\nonly here"), (None, None), (3, rows[3][1]), (3, rows[3][1])]


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of()
    return rows, spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, kept string, n_lines int").repartition(3)


def got(df):
    return collections.Counter(tuple(r) for r in linededup.digests(df).collect())


@pytest.mark.parametrize(("batches", "least_docs", "least_chars"), [(1, 10, 1), (3, 10, 1), (5, 2, 3), (4, 1, 0)])
def test_any_number_of_batches(table, batches, least_docs, least_chars):
    rows, df = table
    cut = [df.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == k) for k in range(batches)]
    assert got(linededup.deduplicated(cut, df, least_docs=least_docs, least_chars=least_chars)) == brute(rows, least_docs, least_chars)


def test_dropping_by_join(spark, table, monkeypatch):
    """Beyond the bound on held keys the joins give the same rows, hot keys and copies included."""
    rows, df = table
    monkeypatch.setattr(linededup, "MOST_HELD", 2)
    runs = linededup.Runs(spark)
    runs.add(linededup.document_keys(df))
    common = linededup.written(runs.common(), "test-common")
    runs.drop()
    assert common.count() > 2 and got(linededup.without_common(df, common, most_held=2)) == brute(rows)
    for texts in (0, 10**7):  # all keys hot, and none
        assert got(linededup._without_joined(df, common, "doc_id", "text", texts)) == brute(rows)


def test_levels(spark, table):
    """Runs are sorted and few; merging them takes no shuffle; counts stay."""
    _, df = table
    runs = linededup.Runs(spark, buckets=3)
    for k in range(7):
        runs.add(linededup.document_keys(df.where(F.pmod(F.xxhash64("text"), F.lit(7)) == k)), 1000)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    try:
        plan = runs.common(1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = linededup.document_keys(df).groupBy("k1", "k2").count()
    assert collections.Counter(tuple(r) for r in runs.common(1).collect()) == collections.Counter(tuple(r) for r in want.collect())
    runs.drop()
    assert not runs.tables


def test_known_lines_are_not_counted_again(spark):
    df = spark.createDataFrame([(k, "same\nrare %d" % k) for k in range(12)], "doc_id long, text string")
    runs = linededup.Runs(spark, fanout=9)
    runs.add(linededup.document_keys(df))
    runs.add(linededup.document_keys(df.withColumn("text", F.regexp_replace("text", "rare", "other"))))
    assert spark.table(runs.levels[0][0]).count() == 13 and spark.table(runs.levels[0][1]).count() == 12
    runs.drop()


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(ORACLES["op13_linededup"]).fetchall()
    rows = QUERIES["op13_linededup"](spark, sf_dir).collect()
    assert collections.Counter(tuple(r) for r in rows) == collections.Counter(want) and sum(r.n_dropped for r in rows) > 0


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.digests(linededup.deduplicated([df, df], df)).count() == 0
    assert linededup.digests(linededup.deduplicated([], df)).count() == 0
