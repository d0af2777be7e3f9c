"""Images read and decoded once, for several encoders."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumora.functions import tensors

#: Means and deviations of the red, green and blue channels that the vision encoder was trained with.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
SIDE = 256


def normalized(rgb: np.ndarray) -> np.ndarray:
    """(height, width, 3) bytes to (3, height, width) floats: shares of 255, less the channel's mean, by its deviation."""
    return ((rgb.astype(np.float32) / 255 - np.float32(MEANS)) / np.float32(DEVIATIONS)).transpose(2, 0, 1)


def squared(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Resized to a square, bilinear, in whole values again."""
    return np.clip(np.rint(np.stack([tensors.resized(rgb[:, :, k].astype(np.float64), side, side) for k in range(3)], axis=2)), 0, 255).astype(np.uint8)


def decoded(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes of a plain pixel map (P6, 255 values) or an uncompressed bitmap of 24 bits; other formats need a decoder of
    one's own, given to encoded()."""
    if data[:2] == b"P6":
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h, top = fields
        if top != 255:
            raise ValueError("pixel maps of 255 values only")
        return np.frombuffer(data, np.uint8, w * h * 3, at + 1).reshape(h, w, 3)
    if data[:2] == b"BM":
        begin, (w, h), (bits, packing) = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<HI", data[28:34])
        if bits != 24 or packing:
            raise ValueError("bitmaps of 24 bits only")
        wide = -(-w * 3 // 4) * 4
        rows = np.frombuffer(data, np.uint8, wide * abs(h), begin).reshape(abs(h), wide)[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1]
        return rows[::-1] if h > 0 else rows
    raise ValueError("unknown format")


def encoded(files: DataFrame, encoders: dict[str, Callable[[np.ndarray, bytes], np.ndarray]], decode: Callable[[bytes], np.ndarray] = decoded) -> DataFrame:
    """files (path, content) to path, error, and an array of floats for each encoder, which gets the decoded image and the file's bytes.

    Contents are read by the scan, once; a file is decoded once in its task, for all encoders. What can't be decoded has an error and
    nulls; an encoder that fails leaves its own column null, and says so in the error.
    """
    names = list(encoders)
    kinds = [pa.string(), pa.string(), *[pa.list_(pa.float32())] * len(names)]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in range(batch.num_rows):  # one file's pixels are in memory at a time
                path, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                errors, out = [], [None] * len(names)
                try:
                    image = decode(data)
                except Exception as e:  # noqa: BLE001 - one file's failure is its row's
                    errors.append(f"decode: {e}")
                else:
                    for k, name in enumerate(names):
                        try:
                            out[k] = np.asarray(encoders[name](image, data), np.float32).ravel()
                        except Exception as e:  # noqa: BLE001
                            errors.append(f"{name}: {e}")
                values = [path, "; ".join(errors) or None, *out]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["path", "error", *names])

    schema = ", ".join(["path string", "error string", *[f"`{n}` array<float>" for n in names]])
    return files.select("path", "content").mapInArrow(run, schema)
