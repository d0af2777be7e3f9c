"""The pipeline against its stages in plain Python, and on an empty table."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from lumora.llm import secrets
from tests.llm.test_operators import brute_classes, brute_spans, check_packed


def test_stages(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    extra = spark.createDataFrame([(9001, "token=abcdefgh1 the quick and the brown", "en", "s", 1), (9002, None, "en", "s", 0), (9003, "#### 123", None, None, None), (9001, "token=abcdefgh1 the quick and the brown", "en", "s", 1)], docs.schema)
    whole = docs.unionByName(extra).withColumn("rep", F.lit(1))
    kept = {}
    now = whole
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, src)
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, now)
        if name != "packing":
            assert now.columns == whole.columns
    assert {9002, 9003}.isdisjoint(r.doc_id for r in kept["language_id"][1].collect()) and kept["language_id"][1].count() >= 0.97 * docs.count()
    toxic = {r.doc_id for r in spark.read.parquet(f"{src}/labels.parquet").where("toxic = 0").collect()}
    before, after = ([r.doc_id for r in x.collect()] for x in kept["toxicity"])
    assert len(toxic & set(after)) >= 0.98 * len(toxic & set(before))
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in kept["near_dedup"])
    classes = brute_classes(list(dict(before).items()))
    assert sorted(i for i, _ in after) == sorted(set(classes.values()))
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept["secrets"])
    assert before.keys() == after.keys()
    assert all((after[i] == t) == (not brute_spans(t)) and not brute_spans(after[i]) for i, t in before.items())
    assert check_packed(kept["packing"][1].collect(), 2048) > 0
    assert collections.Counter(r.doc_id for r in kept["packing"][1].where("piece = 0").collect()) == collections.Counter(list(after))


def test_near_dedup_keeps_every_text(spark):
    """Ids that repeat, also without an id: one row of each class, and of rows without an id all."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(2, a), (5, a + " end"), (5, b), (9, b), (9, b), (None, a), (None, a), (11, None), (11, ""), (12, " ")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id int, text string, h string, root string")
    out = corpus_pipeline.one_of_each(spark, df, "")
    assert out.columns == df.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got[(11, None)] + got[(11, "")] == 1 and {k: n for k, n in got.items() if k[0] != 11} == {(2, a): 1, (5, b): 1, (None, a): 2, (12, " "): 1}


def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mark_holds_no_secret():
    assert not brute_spans("[SECRET]") and secrets.RULES
