"""A corpus pipeline: language ID, toxicity, near-duplicates, secrets, packing. Each stage gets what the one before kept.

Defined results, for every stage: an empty table gives an empty table with the same columns; null text counts as empty; texts
are taken whole, whatever their length; further columns stay as they are, whatever their names, but for the last stage,
which returns places in sequences; repeated rows are treated alike. By stage:

* language_id: null text, and text without a letter, has no language and goes.
* toxicity: null and empty text isn't toxic and stays; a score of exactly 0.5 counts as toxic.
* near_dedup: of a class of near-duplicates the row with the least doc_id stays; repeated rows are one. Different texts
  with one doc_id are documents of their own. Rows without a doc_id stay.
* secrets: no row goes; a text with secrets has marks in their place, and n_chars, if there, is the new text's.
* packing: pieces of all rows; null and empty text is one token, the end.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.checkpoints import removed, scratch, shared_root
from lumora.llm import bagminhash, langid, packing, secrets, toxicity


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is trained on the documents given."""
    return langid.predict(docs, langid.train(docs), prefix="_ours_").where(~F.col("_ours_rejected")).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.predict(docs, model, prefix="_ours_").where(F.col("_ours_predicted") == 0).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id (of equal ids, the least hash of the text) of each class of near-duplicates. Rows without an id stay."""
    named = docs.where(F.col("doc_id").isNotNull()).withColumns({"_ours_id": F.col("doc_id").cast("long"), "_ours_text": bagminhash.text_hash()}).dropDuplicates(["_ours_id", "_ours_text"])
    heads = bagminhash.heads(docs).select(F.col("doc_id").alias("_ours_id"), F.col("h").alias("_ours_text"))
    return named.join(heads, ["_ours_id", "_ours_text"], "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of a secret replaced by a mark; n_chars follows the text."""
    ledger = secrets.commit(docs, secrets.empty_ledger(docs))
    found = secrets.findings(docs, ledger, name="_ours_spans")
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("_ours_spans")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size("_ours_spans") > 0, length).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Models, signatures and packing have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another. A stage's own tables go once its result is written, and its input once it was read."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/lumora/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            removed(spark, [last])
        last = path
    return docs
