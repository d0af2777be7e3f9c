"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.checkpoints import written

__all__ = ["Interner", "bounded", "gather", "parts", "remainder", "texts_of", "trained", "written"]


def remainder(doc_id: str = "doc_id", mod: int = 5) -> Column:
    """crc32 of the id as text, modulo mod. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod


def texts_of(column: pa.Array) -> list[str]:
    """A batch's texts; null is empty."""
    return [t or "" for t in column.to_pylist()]


def parts(found: Iterator[pa.RecordBatch], text: str, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has `rows` rows at most and closes once its texts (strings or bytes) fill `size` bytes."""
    for batch in found:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)) + 1
            hi = min(batch.num_rows, lo + rows, max(lo + 1, full))
            yield batch.slice(lo, hi - lo)
            lo = hi


def bounded(sample: DataFrame, most: int) -> DataFrame:
    """Of a sample (doc_id, text and others; a bounded number of rows, one a doc_id), in the order of a hash of the id, the rows whose
    texts stay within `most` bytes in all."""
    sizes = sample.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    total, out = 0, []
    for key, n in zip(sizes.column("doc_id").to_pylist(), sizes.column("n").to_pylist(), strict=True):
        if total + n > most:
            out.append(key)
        else:
            total += n
    return sample.where(~F.col("doc_id").isin(out)) if out else sample


def trained(sample: DataFrame, given: str, fit: Callable[[list[str], list], object]) -> object:
    """fit(texts, given column) on a bounded sample, by doc_id, in one task: the driver gets the model, not the texts."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(found)
        rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending")]) if batches else None
        texts, values = (rows.column(c).to_pylist() if rows else [] for c in ("text", given))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, values))], pa.binary())], names=["model"])

    return pickle.loads(sample.select("doc_id", "text", given).coalesce(1).mapInArrow(run, "model binary").first()[0])


class Interner:
    """Collects documents' tokens into a block: distinct tokens, and each document as indexes into them."""

    def __init__(self, limit_bytes: int):
        self.limit = limit_bytes
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict = defaultdict(count().__next__)
        self.flat: list[np.ndarray] = []
        self.lens: list[int] = []
        self.bytes = 0

    def add(self, tokens: list, n_bytes: int) -> None:
        self.flat.append(np.fromiter(map(self.index.__getitem__, tokens), np.int32, len(tokens)))
        self.lens.append(len(tokens))
        self.bytes += n_bytes

    @property
    def full(self) -> bool:
        return self.bytes >= self.limit

    def indexes(self) -> np.ndarray:
        return np.concatenate(self.flat) if self.flat else np.zeros(0, np.int32)


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the ragged rows flat[offsets[i]:offsets[i+1]] for i in index; also returns their lengths."""
    starts = offsets[index].astype(np.int64)
    lens = offsets[index + 1].astype(np.int64) - starts
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
    return flat[at], lens
