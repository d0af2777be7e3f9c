"""Vectors: similarity, normalisation, and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = EPSILON, check_length: bool = True) -> Column:
    """0 for empty vectors and (if checked) for unequal lengths. With epsilon 0, a zero norm gives 0."""
    product = norm(a) * norm(b) + epsilon
    value = F.when(product > 0, dot(a, b) / product).otherwise(F.lit(0.0))
    bad = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(bad | (F.size(a) != F.size(b)) if check_length else bad, F.lit(0.0)).otherwise(value)


def normalized(a: Column, floor: float = EPSILON) -> Column:
    return F.transform(F.array(F.greatest(norm(a), F.lit(floor))), lambda n: F.transform(a, lambda x: x.cast("double") / n)).getItem(0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_of_hex(text: Column) -> Column:
    """An unsigned 64-bit hash in hex as a signed long; null where it isn't one."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(text, 16, -10).cast("bigint"))


def sign_hash(vec: Column, bits: int = 62) -> Column:
    """One bit for each of the first components that is 0 or more."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseOR(F.when(F.get(vec, i) >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))


def scored(df: DataFrame, query: list[float], vec: str = "vec", score: str = "score", epsilon: float = EPSILON) -> DataFrame:
    """df with the cosine of vec to one query vector, computed by Arrow batch. Vectors of another length, or null, get 0."""
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q))
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    arrow, at = to_arrow_schema(schema), df.columns.index(vec)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            column = batch.column(at)
            out = np.zeros(batch.num_rows)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(sizes == len(q))
            if len(fit) and len(q):
                x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
                out[fit] = np.einsum("ij,j->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * length + epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.nan_to_num(out))], schema=arrow)

    return df.mapInArrow(run, schema)


def page(embedding: DataFrame, after: object = None, size: int = 256, source: str | None = None) -> tuple[DataFrame, object]:
    """The next page of points by point_id, of one source if given, and the cursor for the one after (None at the end)."""
    rows = embedding if source is None else embedding.where(F.col("source") == source)
    rows = rows if after is None else rows.where(F.col("point_id") > F.lit(after))
    found = rows.orderBy("point_id").limit(size)
    ids = [r["point_id"] for r in found.select("point_id").collect()]  # `size` at most
    return found, max(ids) if len(ids) == size else None
