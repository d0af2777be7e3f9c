"""A stored index of vectors: lists around pivots, int8 quantisation with known errors, exact rescoring. It loses nothing.

* Pivots are a hash-chosen sample of the rows, about PER_ROOT times the root of their number and MOST_LISTS at most. A row lies in the list of its
  nearest pivot, with its angle to it; the table is sorted by both. If two directions are within an angle, so are their angles
  to any pivot; so a search skips lists, and parts of lists, by the triangle inequality.
* A row's direction is kept as int8 values with a scale, and the length of what that leaves out. A product of quantised directions is
  off by those lengths at most, so what can't reach the threshold is known without the vectors; what can is scored from the vectors, in
  double precision.

Rows whose vector is null, empty, zero, not finite, or of another length than the first pivot's are not in the index: they are like nothing.
Further columns stay, so that searches filter by them. Thresholds are above 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumora.checkpoints import written
from lumora.functions import vectors

MOST_LISTS, PER_ROOT = 16_384, 4
#: Rows that meet rows of one list as one block.
BLOCK = 4096
#: Room for rounding, in radians and in products.
SLACK = 1e-5
CODES = [("list", T.IntegerType()), ("angle", T.DoubleType()), ("q", T.BinaryType()), ("scale", T.DoubleType()), ("err", T.DoubleType())]
#: A row's number in the index.
ROW = "row"
#: Angles from rows to pivots that are in memory at once.
ANGLES = 1 << 20


def parts(batch: pa.RecordBatch, pivots: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose angles to all pivots are ANGLES at most (a row's own, if it has more)."""
    few = max(1, ANGLES // max(1, pivots))
    for lo in range(0, batch.num_rows, few):
        yield batch.slice(lo, few)


def directions(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and those as unit rows."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == width)
    x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), width)
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(n) & (n > 0)
    return fit[good], x[good] / n[good, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the lengths of what they leave out."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(np.square(unit - q * scale[:, None]).sum(axis=1))


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _codes(q: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in q], pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), width)


@dataclass(frozen=True)
class Index:
    """rows: id, the columns kept, vec, list, angle, q, scale, err, row. By list: how many rows, and their least and greatest angle."""

    rows: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    nearest: np.ndarray
    furthest: np.ndarray

    def reached(self, found: np.ndarray, angle: float) -> np.ndarray:
        """From angles to pivots (rows by lists): which lists can hold a direction within `angle`. A list's rows are nearer to its pivot than
        to any other, so a direction within the angle is at most twice that further from it than from its own nearest."""
        ring = (self.sizes > 0) & (found - self.furthest <= angle + SLACK) & (self.nearest - found <= angle + SLACK)
        return ring & (found - found.min(axis=1, keepdims=True) <= 2 * (angle + SLACK))

    def hits(self, query: list[float], threshold: float, limit: int, payload: Column | None = None) -> DataFrame:
        """The index's rows (columns kept, score) at or above the threshold, best first, ties by id; exactly, up to `limit`.

        First the codes alone are read, in the lists and angles that can hold a hit; then the vectors of what may be among the best.
        """
        kept = [c for c in self.rows.columns if c not in ("vec", ROW, *[n for n, _ in CODES])]
        q, width = np.asarray(query, np.float64), self.pivots.shape[1]
        length = float(np.sqrt(q @ q)) if len(q) == width else 0.0
        if not (np.isfinite(length) and length > 0):
            return self.rows.select(*kept, F.lit(0.0).alias("score")).limit(0)
        found, within = angles((q / length)[None], self.pivots)[0], float(np.arccos(np.clip(threshold, -1, 1)))
        lists = np.flatnonzero(self.reached(found[None], within)[0])
        to_pivot = F.get(F.array(*[F.lit(float(a)) for a in found]), F.col("list"))
        # What Spark pushes down: the lists, and the angles' outer bounds; then each list's own.
        near = self.rows.where(F.col("list").between(int(lists.min()), int(lists.max())) if len(lists) else F.lit(False))
        near = near.where(F.col("list").isin([int(x) for x in lists]) & F.col("angle").between(float(found[lists].min() - within - SLACK), float(found[lists].max() + within + SLACK))) if len(lists) else near
        near = near.where(F.abs(F.col("angle") - to_pivot) <= within + SLACK)
        near = near if payload is None else near.where(payload)
        unit = q / length

        def bounds(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                s = _unpacked(batch.column(2), width) @ unit * batch.column(3).to_numpy()
                err = batch.column(4).to_numpy() + SLACK
                keep = pa.array(s + err >= threshold)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s - err), pa.array(s + err)], names=["id", "list", "low", "high"]).filter(keep)

        kind = self.rows.schema["id"].dataType.simpleString()
        may = written(near.select("id", "list", "q", "scale", "err").mapInArrow(bounds, f"id {kind}, list int, low double, high double"), "index-bounds")
        least = may.orderBy(F.desc("low")).limit(limit).agg(F.min("low"), F.count(F.lit(1))).first()
        best = may.where(F.col("high") >= least[0]) if least[1] == limit else may
        chosen = near.join(best.select("id", "list").distinct(), ["id", "list"], "left_semi").select(*kept, "vec")
        return vectors.scored(chosen, query).drop("vec").where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(limit)

    def pairs(self, left: DataFrame, threshold: float, strict: bool = False, ordered: bool = True) -> DataFrame:
        """(left, right): candidates among left rows (id, row, vec) and the index's rows, by their numbers (row), as ids may repeat; every pair at
        the threshold is among them, once. ordered: only those of a lesser left id."""
        width, within = self.pivots.shape[1], float(np.arccos(np.clip(threshold, -1, 1)))

        def visits(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in found:
                for batch in parts(whole, len(pivots)):
                    fit, unit = directions(batch.column(2), width)
                    rows, lists = np.nonzero(self_reached(angles(unit, pivots), within))
                    q, scale, err = quantised(unit) if len(fit) else (np.zeros((0, width), np.int8), np.zeros(0), np.zeros(0))
                    at = pa.array(rows)
                    ids, own = (batch.column(k).take(pa.array(fit)) for k in (0, 1))
                    codes, scale, err = _codes(q), pa.array(scale), pa.array(err)
                    for lo in range(0, len(rows), 1 << 16):
                        some = at.slice(lo, 1 << 16)
                        yield pa.RecordBatch.from_arrays([ids.take(some), own.take(some), pa.array(lists[lo : lo + (1 << 16)].astype(np.int32)), codes.take(some), scale.take(some), err.take(some)], names=["id", "row", "list", "q", "scale", "err"])

        pivots, self_reached = self.pivots, Index(None, None, self.sizes, self.nearest, self.furthest).reached
        seen = written(left.where("id is not null").select(F.col("id").cast("long").alias("id"), "row", "vec").mapInArrow(visits, "id long, row long, list int, q binary, scale double, err double"), "index-visits")
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        spark = seen.sparkSession
        # Both tables have MOST_LISTS rows at most.
        own = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(self.sizes) if n], "list int, n long")
        shares = F.broadcast(seen.groupBy("list").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(own), "list").select("list", blocks(F.col("m")).alias("lefts"), blocks(F.col("n")).alias("rights")))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        l = seen.join(shares, "list").select("list", "id", "row", "q", "scale", "err", F.pmod(F.xxhash64("row"), "lefts").cast("int").alias("i"), each("rights").alias("j"))  # noqa: E741
        r = self.rows.where("id is not null").select("list", F.col("id").cast("long").alias("id"), "row", "q", "scale", "err").join(shares, "list").select("list", "id", "row", "q", "scale", "err", F.pmod(F.xxhash64("row"), "rights").cast("int").alias("j"), each("lefts").alias("i"))

        def near(a: pa.Table, b: pa.Table) -> pa.Table:
            out = ([], [])
            if a.num_rows and b.num_rows:
                x, y = ((_unpacked(t.column("q"), width) * t.column("scale").to_numpy()[:, None]).astype(np.float32) for t in (a, b))
                ex, ey, ia, ib = a.column("err").to_numpy(), b.column("err").to_numpy(), a.column("id").to_numpy(), b.column("id").to_numpy()
                ra, rb = a.column("row").to_numpy(), b.column("row").to_numpy()
                for lo in range(0, len(x), 512):
                    part, e = x[lo : lo + 512] @ y.T, ex[lo : lo + 512, None]
                    hit = part + e + (1 + e) * ey + SLACK >= threshold
                    if ordered:
                        hit &= ia[lo : lo + 512, None] < ib
                    p, q = np.nonzero(hit)
                    out[0].append(ra[lo:][p])
                    out[1].append(rb[q])
            join = lambda v: pa.array(np.concatenate(v) if v else [], pa.int64())
            return pa.table({"left": join(out[0]), "right": join(out[1])})

        # A row of the index lies in one list, so no pair meets twice.
        return l.groupBy("list", "i", "j").cogroup(r.groupBy("list", "i", "j")).applyInArrow(near, "left long, right long")


def built(rows: DataFrame, lists: int | None = None) -> Index:
    """The index of rows (id, vec, and columns to keep), written to the shared folder."""
    given = rows.where(F.size("vec") > 0)
    n = given.count()
    k = min(MOST_LISTS, lists or max(1, int(np.ceil(PER_ROOT * np.sqrt(n)))))
    sample = given.select("vec").orderBy(F.xxhash64("id", "vec")).limit(k).toArrow().column("vec").combine_chunks()  # MOST_LISTS rows at most
    width = int(sample.value_lengths()[0].as_py()) if len(sample) else 1
    pivots = np.unique(directions(sample, width)[1], axis=0) if len(sample) else np.zeros((0, width))
    pivots = pivots if len(pivots) else np.eye(1, width)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in CODES]])
    arrow, at = to_arrow_schema(schema), rows.columns.index("vec")

    def coded(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in parts(whole, len(pivots))):
            fit, unit = directions(batch.column(at), width)
            if not len(fit):
                continue
            by = angles(unit, pivots)
            nearest = by.argmin(axis=1)
            q, scale, err = quantised(unit)
            columns = [*batch.take(pa.array(fit)).columns, pa.array(nearest.astype(np.int32)), pa.array(by[np.arange(len(fit)), nearest]), _codes(q), pa.array(scale), pa.array(err)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    table = written(rows.mapInArrow(coded, schema).repartitionByRange("list", "angle").sortWithinPartitions("list", "angle").withColumn(ROW, F.monotonically_increasing_id()), "vector-index")
    sizes, nearest, furthest = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in table.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a list
        sizes[r["list"]], nearest[r["list"]], furthest[r["list"]] = r["n"], r["low"], r["high"]
    return Index(table, pivots, sizes, nearest, furthest)


def near_pairs(left: DataFrame, right: DataFrame, threshold: float, strict: bool = False, epsilon: float = vectors.EPSILON, ordered: bool = True) -> DataFrame:
    """(a, b, score) of left rows (id, vec) and right rows (id, vec) with cosine at or above the threshold, exactly; a pair of ids keeps its
    best score. ordered: a < b only. The index's candidates are scored from the vectors; only codes meet before that."""
    found = built(right.where("id is not null").select(F.col("id").cast("long").alias("id"), "vec"))
    own = written(left.where("id is not null").select(F.col("id").cast("long").alias("id"), "vec", F.monotonically_increasing_id().alias(ROW)), "index-left")
    may = found.pairs(own, threshold, strict, ordered)
    score = vectors.cosine(F.col("_l"), F.col("_r"), epsilon)
    met = may.join(own.select(F.col(ROW).alias("left"), F.col("id").alias("a"), F.col("vec").alias("_l")), "left").join(found.rows.select(F.col(ROW).alias("right"), F.col("id").alias("b"), F.col("vec").alias("_r")), "right")
    scored = met.select("a", "b", score.alias("score")).where(F.col("score") > threshold if strict else F.col("score") >= threshold)
    return scored.groupBy("a", "b").agg(F.max("score").alias("score"))
