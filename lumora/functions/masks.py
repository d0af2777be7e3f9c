"""Masks as runs: arrays of [offset, length]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUNS = "array<array<bigint>>"


def decoded(rle: Column, total: Column) -> Column:
    """The positions that are set, none at total or beyond."""
    runs = F.filter(rle, lambda r: (r[1] > 0) & (r[0] < total))
    return F.flatten(F.transform(runs, lambda r: F.sequence(r[0], F.least(r[0] + r[1], total) - 1)))


def area(rle: Column) -> Column:
    return F.aggregate(rle, F.lit(0).cast("bigint"), lambda s, r: s + r[1])


def parsed(text: Column) -> Column:
    """Runs from their JSON text; what isn't JSON is null."""
    return F.from_json(text, RUNS)


def encoded(bits: DataFrame, key: list[str], position: str = "pos") -> DataFrame:
    """Rows (key, position of a set bit) to one row for each key with its runs, by gaps and islands."""
    by_key = Window.partitionBy(*key).orderBy(position)
    islands = bits.select(*key, position).distinct().withColumn("_island", F.col(position) - F.row_number().over(by_key))
    runs = islands.groupBy(*key, "_island").agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_n"))), lambda r: F.array(r["_first"].cast("bigint"), r["_n"])).alias("rle"))
