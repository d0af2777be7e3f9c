"""Lines that many documents hold, counted by levelled sorted runs, and texts without them.

A line's key is the line without white space at its ends, A-Z lower-cased. A key that stands in at least LEAST_DOCS documents is
common; common lines go from every document, the first included.

1. Keys. Each document gives each of its keys once, as a 128-bit hash.
2. Runs. A batch of documents is counted by key and stored as a sorted run: a table bucketed and sorted by the key's hash, all runs
   alike, so that runs meet in merge joins without a shuffle. A new batch is merge-anti-joined with the runs: keys that one of them
   has as common already need no further count. What is left is the batch's own run, at level 0.
3. Compaction. Once a level has FANOUT runs they are merged into one of the next level, counts added; so there are few runs,
   and a key is rewritten once a level.
4. Dropping. Common keys are those whose counts over all runs reach the bound. As long as they are MOST_HELD or fewer, every task holds
   them, and texts stay where they are. Beyond that they meet the documents' keys in a join, and the numbers of the common lines
   go back to the texts, by the texts' hash.

Keys are counted before the shuffle, so a line in any share of all documents is one row a task. In the join beyond MOST_HELD,
keys in more than a 10,000th of all texts are held by every task, and equal texts are dealt over SALTS shares.

Defined results: a row is a document, repeated rows are several. Null and empty texts are one empty line. Keys shorter than
LEAST_CHARS code points are never common. A document whose lines all go has the empty text. An empty table gives no row. Of the
input, the two columns named are read only, so that others may have any name; a null key column stays. Texts are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumora.checkpoints import removed, shared_root
from lumora.llm.common import parts, written

LEAST_DOCS, LEAST_CHARS = 10, 1
#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Common keys that every task holds, at most (16 bytes each; about 30 MB as a set).
MOST_HELD = 250_000
SALTS = 16


def keys_of(text: bytes) -> list[bytes]:
    """The keys of a text's lines; bytes.strip and bytes.lower touch ASCII alone."""
    return [line.strip().lower() for line in text.split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8")) >= least)


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """128-bit hashes as two columns of longs."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


def document_keys(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """k1, k2: the hash of each key, once a document."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in parts(found, "_text"):
            out: list[bytes] = []
            for t in batch.column(0).to_pylist():
                out += [digest(k) for k in dict.fromkeys(keys_of(t or b"")) if _long_enough(k, least_chars)]
            yield pa.RecordBatch.from_arrays(_halves(out), names=["k1", "k2"])

    return docs.select(F.encode(text, "UTF-8").alias("_text")).mapInArrow(run, "k1 long, k2 long")


class Runs:
    """Sorted runs of (k1, k2, n documents) by level, below the shared folder. A run holds a key once; all have the same buckets."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _path(self, name: str) -> str:
        return f"{shared_root(self.spark)}/lumora/{name}"

    def _stored(self, rows: DataFrame) -> str:
        name = f"lumora_lines_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", self._path(name)).saveAsTable(name)
        return name

    def _dropped(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
        removed(self.spark, [self._path(name) for name in names])

    @property
    def tables(self) -> list[str]:
        """Names of the runs, newest first."""
        return [name for level in self.levels for name in reversed(level)]

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        n = lambda side: F.coalesce(F.col(f"{side}.n"), F.lit(0))
        return a.alias("a").join(b.hint("merge").alias("b"), ["k1", "k2"], "full").select("k1", "k2", (n("a") + n("b")).alias("n"))

    def add(self, keys: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        """A batch's keys (k1, k2; once a document) as a run of their own, without those that a run has as common."""
        own = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
        for name in self.tables:
            common = self.spark.table(name).where(F.col("n") >= least_docs).select("k1", "k2")
            own = own.join(common.hint("merge"), ["k1", "k2"], "left_anti")
        self._push(0, self._stored(own))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._compacted(old, 1)[0])

    def _compacted(self, names: list[str], most: int) -> list[str]:
        """Runs merged two by two, as only stored runs meet without a shuffle, until `most` are left."""
        names = list(names)
        while len(names) > most:
            two, names = names[:2], names[2:]
            names.insert(0, self._stored(self._merged(*map(self.spark.table, two))))
            self._dropped(two)
        return names

    def common(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """k1, k2, n: keys whose counts over all runs reach the bound (n: at least so many; exact below twice the bound)."""
        if not self.tables:
            return self.spark.createDataFrame([], "k1 long, k2 long, n long")
        left = self._compacted(self.tables, 2)
        self.levels = [*[[] for _ in self.levels[1:]], left[::-1]]
        return reduce(self._merged, [self.spark.table(n) for n in left]).where(F.col("n") >= least_docs)

    def drop(self) -> None:
        self._dropped(self.tables)
        self.levels = []


def _result(docs: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


def _rows(keys: pa.Array, kept: list[tuple[int, bytes, int]], schema: pa.Schema) -> pa.RecordBatch:
    columns = [keys, pa.array([n for n, _, _ in kept], pa.int64()), pa.array([d for _, _, d in kept], pa.int64()), pa.array([t for _, t, _ in kept], pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _without_held(docs: DataFrame, held: frozenset[bytes], key: str, text: str) -> DataFrame:
    """Lines whose key's hash is in `held` go; every task has the whole of it."""
    schema = _result(docs, key)
    arrow = to_arrow_schema(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in parts(found, "_text"):
            out = []
            for t in batch.column(1).to_pylist():
                lines = (t or b"").split(b"\n")
                stay = [line for line in lines if digest(line.strip().lower()) not in held]
                out.append((len(lines), t or b"" if len(stay) == len(lines) else b"\n".join(stay), len(lines) - len(stay)))
            yield _rows(batch.column(0), out, arrow)

    return docs.select(key, F.encode(text, "UTF-8").alias("_text")).mapInArrow(run, schema)


def _without_joined(docs: DataFrame, common: DataFrame, key: str, text: str, texts: int) -> DataFrame:
    """The same by joins: keys of distinct texts meet the common ones, and the lines' numbers go back to the texts."""
    name = [F.xxhash64(F.lit(k), F.coalesce(F.col(text), F.lit(""))).alias(f"t{k}") for k in (1, 2)]
    named = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *name)

    def numbered(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in parts(found, "_text"):
            keys = [keys_of(t) for t in batch.column(2).to_pylist()]
            sizes = [len(k) for k in keys]
            owner = [pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in (0, 1)]
            number = pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays([*owner, number, *_halves([xxhash.xxh3_128_digest(k) for ks in keys for k in ks])], names=["t1", "t2", "line", "k1", "k2"])

    lines = named.select("t1", "t2", F.encode("_text", "UTF-8").alias("_text")).mapInArrow(numbered, "t1 long, t2 long, line int, k1 long, k2 long")
    often = F.col("n") > max(LEAST_DOCS, texts // 10_000)  # fewer than 10,000 keys a line of the longest text
    hot, rest = common.where(often).select("k1", "k2", F.lit(True).alias("_hot")), common.where(~often).select("k1", "k2")
    marked = lines.join(F.broadcast(hot), ["k1", "k2"], "left")
    hits = marked.where("_hot").select("t1", "t2", "line").unionByName(marked.where("_hot is null").join(rest.hint("merge"), ["k1", "k2"]).select("t1", "t2", "line"))
    gone = hits.groupBy("t1", "t2").agg(F.collect_set("line").alias("_gone")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    schema = _result(docs, key)
    arrow = to_arrow_schema(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "_text"):
            out = []
            for t, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, drop = t.split(b"\n"), set(drop or ())
                out.append((len(lines), b"\n".join([x for k, x in enumerate(lines) if k not in drop]), len(drop)))
            yield _rows(batch.column(0), out, arrow)

    met = salted.join(gone.hint("merge"), ["t1", "t2", "_salt"], "left")
    return met.select(F.col("_key").alias(key), F.encode("_text", "UTF-8").alias("_text"), "_gone").mapInArrow(run, schema)


def without_common(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", most_held: int = MOST_HELD) -> DataFrame:
    """Per row of docs: key, n_lines (before dropping), n_dropped, kept (the lines that stay, joined by newline). common: k1, k2, n."""
    few = common.select("k1", "k2").limit(most_held + 1).toArrow()  # the bound is checked before anything is held
    if few.num_rows > most_held:
        return _without_joined(docs, common, key, text, docs.count())
    pairs = np.stack([few.column(c).to_numpy().astype("<i8") for c in ("k1", "k2")], axis=1)
    return _without_held(docs, frozenset(row.tobytes() for row in pairs), key, text)


def deduplicated(batches: list[DataFrame], docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs without the lines that are common over all batches, which come one after another."""
    runs = Runs(docs.sparkSession)
    try:
        for batch in batches:
            runs.add(document_keys(batch, text, least_chars), least_docs)
        common = written(runs.common(least_docs), "common-lines")
    finally:
        runs.drop()
    return without_common(docs, common, key, text)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
