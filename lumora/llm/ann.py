"""Approximate nearest neighbours with balanced posting lists.

1. Equal vectors are one class, which keeps its KEEP smallest ids: no other copy can be among the nearest when ties go to
   the smaller id.
2. Centroids, about one for LIST classes and MOST at most, are fitted on a bounded sample; clusters that get too much of
   the sample are split, so that lists are balanced.
3. Each class goes to the lists of its nearest centroid and, if it lies near a boundary, of up to COPIES centroids in all
   whose distance is within (1 + EDGE) times the nearest one's. The centroids are searched by a graph held in memory,
   best first, many vectors at once. Lists of more than SHARD members are dealt over shards.
4. A query probes the lists whose centroids are within a ratio of the nearest one's distance. The ratio, and the most
   lists a query may need, are taken from PROBES sample queries whose exact neighbours are found among all
   rows: what TARGET of those neighbours need.
5. Each shard gives each query its k + 1 nearest members, by double precision on the original vectors: first those of the FIRST
   nearest lists, whose worst score is then a bound that members of the other lists must reach to be given at all.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than the most frequent one. Rows with one vec_id and one vector count once. Fewer candidates than asked for
give fewer rows. Ties go to the smaller vec_id. Rows whose vec_id is null take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.llm.common import written

#: Classes for a centroid, centroids at most, and vectors that they are fitted on at most.
LIST, MOST, SAMPLE = 128, 8192, 30_000
#: Lists that a class goes to at most, and how near a further centroid must be.
COPIES, EDGE = 3, 0.08
#: Members of a list that one task row set holds.
SHARD = 4096
#: Sample queries, and the share of their exact neighbours that the probed lists must hold.
PROBES, TARGET = 100, 0.975
#: Lists whose members give a query its bound.
FIRST = 4
#: Neighbours of a centroid in the graph, and centroids kept open in a search.
DEGREE, BEAM = 16, 48


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the rows of q with those of x, pairwise, in double precision; each depends on its own rows only."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    return np.einsum("ij,ij->i", q, x) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x)))


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Balanced clusters of unit vectors: k-means, then clusters with over twice the mean size are split in two."""
    rng = np.random.default_rng(seed)
    count = min(count, len(sample))
    centre = sample[np.sort(rng.choice(len(sample), count, replace=False))]

    def nearest(c: np.ndarray) -> np.ndarray:
        return np.concatenate([(sample[k : k + 4096] @ c.T).argmax(axis=1) for k in range(0, len(sample), 4096)])

    for step in range(rounds):
        own = nearest(centre)
        size = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        centre = np.where((size > 0)[:, None], total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12), centre).astype(np.float32)
        if step == rounds - 3:
            for k in np.flatnonzero(size > 2 * len(sample) / len(centre)).tolist():
                rows = np.flatnonzero(own == k)
                centre = np.concatenate([centre, sample[rng.choice(rows, 1)]])
    return centre


class Graph:
    """A graph of centroids, each linked to its DEGREE nearest, and searched best first from a few entries."""

    def __init__(self, centre: np.ndarray):
        self.centre, n = centre, len(centre)
        degree = min(DEGREE, n - 1)
        self.links = np.zeros((n, 0), np.int64)
        if degree:
            near = []
            for k in range(0, n, 1024):
                s = centre[k : k + 1024] @ centre.T
                s[np.arange(len(s)), np.arange(k, k + len(s))] = -2
                near.append(np.argpartition(-s, degree - 1, axis=1)[:, :degree])
            # Two further links, along a ring, keep the graph in one piece.
            ring = np.arange(n)
            self.links = np.concatenate([*near], axis=0)
            self.links = np.concatenate([self.links, ((ring + 1) % n)[:, None], ((ring - 1) % n)[:, None]], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors q: the numbers of the `want` nearest centroids found, nearest first, and their cosines."""
        n = len(self.centre)
        want, beam = min(want, n), min(n, max(want, BEAM))
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), bool)
        at = np.tile(self.entries, (len(q), 1))
        s = np.einsum("qd,qkd->qk", q, self.centre[at])
        seen[rows, at] = True
        opened = np.zeros(at.shape, bool)
        while True:
            pick = np.argsort(np.where(opened, np.inf, -s), axis=1, kind="stable")[:, :4]
            fresh = ~np.take_along_axis(opened, pick, axis=1) & np.isfinite(np.take_along_axis(s, pick, axis=1))
            if not fresh.any():
                break
            opened[rows, pick] = True
            new = np.where(np.repeat(fresh, self.links.shape[1], axis=1), self.links[np.take_along_axis(at, pick, axis=1)].reshape(len(q), -1), 0)
            new = np.sort(new, axis=1)
            first = np.concatenate([np.ones((len(q), 1), bool), new[:, 1:] != new[:, :-1]], axis=1) & ~seen[rows, new]
            seen[rows, new] = True
            score = np.where(first, np.einsum("qd,qkd->qk", q, self.centre[new]), -np.inf)
            at, s, opened = np.concatenate([at, new], axis=1), np.concatenate([s, score], axis=1), np.concatenate([opened, ~first], axis=1)
            best = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            at, s, opened = (np.take_along_axis(x, best, axis=1) for x in (at, s, opened))
        return at[:, :want], s[:, :want]


def ordered(q: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a bounded number of unit vectors q: all centroids, nearest first, and their cosines."""
    s = q @ centre.T
    at = np.argsort(-s, axis=1, kind="stable")
    return at, np.take_along_axis(s, at, axis=1)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _routed(graph: Graph, copies: int, ratio: float):
    """Rows (id, vec) to rows (id, vec, list, place): one for each list within ratio times the nearest centroid's distance, nearest
    first."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                at, s = graph.search(_unit(_vectors(batch.column(1)).astype(np.float64)).astype(np.float32), copies)
                d = _distance(s)
                take = d <= d[:, :1] * ratio + 1e-6
                rows, cols = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(at[rows, cols].astype(np.int32)), pa.array(cols.astype(np.int32))], names=[*batch.schema.names, "list", "place"])

    return run


def _top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q (unit vectors) the k nearest rows of x, with some to spare for rounding: row of q, row of x."""
    s = q @ x.T
    want = min(len(x), 2 * k)
    at = np.argpartition(-s, want - 1, axis=1)[:, :want] if want < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    return np.repeat(np.arange(len(q)), want), at.ravel()


def _exact(queries: np.ndarray, k: int):
    """Each partition's nearest rows for a bounded set of queries (by brute force): (query, id, score)."""
    unit = _unit(queries.astype(np.float64))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                x = _vectors(batch.column(1))
                r, c = _top(unit, _unit(x.astype(np.float64)), batch.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), batch.column(0).take(pa.array(c)), batch.column(1).take(pa.array(c)), pa.array(cosines(queries[r], x[c]))], names=["query", "id", "vec", "score"])

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest other rows found for every row whose key is divisible by `every`: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    finite = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return empty
    rows = rows.where(F.size("vec") == width[0]["w"]).withColumn("cls", F.concat(F.lpad(F.hex(F.xxhash64("vec")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "vec")), 16, "0")))
    # A class keeps its k + 1 smallest ids (one may be the query's own); the partial limit comes before the shuffle.
    smallest = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("n") <= k + 1).dropDuplicates(["cls", "id"])
    kept = written(smallest.select("cls", "id", "n", F.when(F.col("n") == 1, F.col("vec")).alias("vec")), "ann-classes")
    classes = kept.where("n = 1").select("id", "vec")
    count = classes.count()
    share = min(1.0, 1.2 * SAMPLE / count)
    sample = classes.where((F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).toArrow()
    centre = fit_centroids(_unit(_vectors(sample.column("vec").combine_chunks())).astype(np.float32), max(1, min(MOST, math.ceil(count / LIST))))
    graph = Graph(centre)
    index = written(classes.mapInArrow(_routed(graph, COPIES, 1 + EDGE), "id long, vec array<double>, list int, place int"), "ann-lists")
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # at most 2 * MOST rows
    shards = np.ones(len(centre), np.int64)
    for at, n in sizes.items():
        shards[at] = -(-n // SHARD)

    # Probes: exact neighbours of some classes among all classes, and the lists that hold those.
    probes = sample.slice(0, 0) if not len(sample) else sample.take(pa.array(np.unique(np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(np.int64))))
    asked = _vectors(probes.column("vec").combine_chunks())
    best = classes.mapInArrow(_exact(asked, k + 1), "query long, id long, vec array<double>, score double").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1).select("query", "id", "vec").toArrow()
    lists, cos = ordered(_unit(asked).astype(np.float32), centre)
    d = _distance(cos)
    own = probes.column("id").to_numpy()
    place = np.empty((len(asked), len(centre) + 1), np.int64)
    place[:] = len(centre)
    np.put_along_axis(place, lists, np.tile(np.arange(lists.shape[1]), (len(asked), 1)), axis=1)
    q_of, ids = best.column("query").to_numpy(), best.column("id").to_numpy()
    other = ids != own[q_of]
    needed, ratios = [1], [1.0]
    if other.any():
        members, near = graph.search(_unit(_vectors(best.column("vec").combine_chunks())).astype(np.float32), COPIES)
        dm = _distance(near)
        there = np.where(dm <= dm[:, :1] * (1 + EDGE) + 1e-6, members, len(centre))
        at = np.minimum.reduce([place[q_of, there[:, c]] for c in range(there.shape[1])])
        at = np.minimum(at, lists.shape[1] - 1)[other]
        needed, ratios = at + 1, d[q_of[other], at] / np.maximum(d[q_of[other], 0], 1e-6)
    ratio = float(np.quantile(ratios, TARGET, method="higher")) + 1e-3
    most = int(min(len(centre), np.ceil(1.5 * np.quantile(needed, TARGET, method="higher")) + 2))

    # Each query class is searched once, whatever its number of copies.
    asking = rows.where(F.pmod("id", F.lit(every)) == 0).select("cls", F.col("id").alias("query_id")).distinct()
    heads = kept.where("n = 1").select("cls", "id", "vec").join(asking.select("cls").distinct(), "cls", "left_semi").select("id", "vec")
    probing = heads.mapInArrow(_routed(graph, most, ratio), "id long, vec array<double>, list int, place int")
    table = spark.createDataFrame([(i, int(n)) for i, n in enumerate(shards)], "list int, shards int")
    spread = index.join(F.broadcast(table), "list").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    probing = probing.join(F.broadcast(table), "list").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, x = _vectors(left.column("vec").combine_chunks()), _vectors(right.column("vec").combine_chunks())
            q_ids, x_ids, bound = left.column("id").to_numpy(), right.column("id").to_numpy(), left.column("bound").to_numpy()
            unit = _unit(x)
            for lo in range(0, len(q), 512):
                part = q[lo : lo + 512]
                r, c = _top(_unit(part), unit, x_ids, k + 1)
                score = cosines(part[r], x[c])
                order = np.lexsort((x_ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = (place <= k) & (score >= bound[lo:][r])
                out["query"].append(q_ids[lo:][r[keep]])
                out["id"].append(x_ids[c[keep]])
                out["score"].append(score[keep])
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    def met(asked_for: DataFrame) -> DataFrame:
        queries = asked_for.select("list", "shard", "id", "vec", "bound").groupBy("list", "shard")
        return queries.cogroup(spread.select("list", "shard", "id", "vec").groupBy("list", "shard")).applyInArrow(nearest, "query long, id long, score double").distinct()

    best_of = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    probing = written(probing.select("id", "vec", "list", "shard", "place"), "ann-probes")
    first = written(met(probing.where(F.col("place") < FIRST).withColumn("bound", F.lit(-2.0))).withColumn("r", F.row_number().over(best_of)).where(F.col("r") <= k + 1), "ann-first")
    bounds = first.where(F.col("r") == k + 1).select(F.col("query").alias("id"), F.col("score").alias("bound"))
    rest = met(probing.where(F.col("place") >= FIRST).join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0))))
    near = first.drop("r").union(rest).distinct().withColumn("r", F.row_number().over(best_of)).where(F.col("r") <= k + 1)
    ids_of = kept.select("cls", F.col("id").alias("vec_id"))
    heads_of = kept.where("n = 1").select("id", "cls")
    # From classes to their ids: the nearest k + 1 ids for each query class, then each query without its own id.
    by_class = near.join(heads_of, "id").join(ids_of, "cls").select("query", "vec_id", "score").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    lists_of = by_class.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))).alias("found"))
    answers = asking.join(heads_of.withColumnRenamed("id", "query"), "cls").join(lists_of, "query")
    own_out = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(own_out).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.m")).alias("score"))
