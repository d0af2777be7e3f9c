"""Detector outputs are unpacked in small parts, without Python's numbers between; quick ways of the kernels give what the plain ones give."""

import numpy as np
import pyarrow as pa

from lumora.functions import tensors
from lumora.operators import detect


def test_parts_of_images_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0] * 50_000] * 64, pa.list_(pa.float32()))], names=["outputs"])
    parts = list(detect._images([batch]))
    assert sum(p.num_rows for p in parts) == 64 and max(p.nbytes for p in parts) <= 9 << 20


def test_tensors_are_the_lists():
    rows = pa.array([[[0.0]], [[1.5, None], None, []]], pa.list_(pa.list_(pa.float32())))
    a, b, c = detect._tensors(rows.slice(1)[0].values)
    assert a.dtype == np.float64 and a[0] == 1.5 and np.isnan(a[1]) and not len(b) and not len(c)


def test_runs_and_suppression_are_the_plain_ones(monkeypatch):
    rng = np.random.default_rng(5)
    for share in (0.0, 0.3, 0.9, 1.0):
        for x1, w, width in ((3, 5, 20), (0, 8, 8)):
            mask = rng.random((6, w)) < share
            at = [(y + 2) * width + x + x1 for y in range(6) for x in range(w) if mask[y, x]]
            want = []
            for k in at:
                if want and sum(want[-1]) == k:
                    want[-1][1] += 1
                else:
                    want.append([k, 1])
            assert tensors.runs_of(mask, x1, 2, width) == want
    for _ in range(50):
        boxes, scores = rng.integers(0, 12, (9, 4)).astype(float), rng.integers(0, 5, 9) / 4
        got = tensors.suppressed(boxes, scores, 0.3)
        with monkeypatch.context() as m:
            m.setattr(tensors, "FEW", 0)
            assert tensors.suppressed(boxes, scores, 0.3) == got


def test_masks_of_one_kind_need_no_resizing(monkeypatch):
    for sign in (1.0, -1.0):
        args = np.ones((2, 4, 4)), np.array([sign, sign]), 150, 120, (0, 64), 640 / 150, (10, 20, 60, 90)
        got = tensors.mask_in_box(*args)
        with monkeypatch.context() as m:
            m.setattr(tensors, "EDGE", 1.0)
            assert (tensors.mask_in_box(*args) == got).all() and got.shape == (70, 50) and got.all() == (sign > 0)
