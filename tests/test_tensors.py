"""Masks, records and faces out of tensors, against loops over pixels, anchors and cells."""

import math

import numpy as np
import pytest

from lumora.functions import tensors
from lumora.operators import detect


def loop_resize(src, dst_h, dst_w):
    src_h, src_w = len(src), len(src[0])
    out = [[0.0] * dst_w for _ in range(dst_h)]
    for y in range(dst_h):
        for x in range(dst_w):
            sy, sx = max((y + 0.5) * src_h / dst_h - 0.5, 0), max((x + 0.5) * src_w / dst_w - 0.5, 0)
            y0, x0 = min(int(sy), src_h - 1), min(int(sx), src_w - 1)
            y1, x1 = min(y0 + 1, src_h - 1), min(x0 + 1, src_w - 1)
            wy, wx = sy - y0, sx - x0
            out[y][x] = (src[y0][x0] * (1 - wx) + src[y0][x1] * wx) * (1 - wy) + (src[y1][x0] * (1 - wx) + src[y1][x1] * wx) * wy
    return out


def loop_mask(protos, coefficients, width, height, pads, ratio, box):
    """All pixels of the image, one by one, as the definition has them."""
    c, h, w = protos.shape
    small = [[1 / (1 + math.exp(-max(-88, min(88, sum(coefficients[k] * protos[k, y, x] for k in range(c)))))) for x in range(w)] for y in range(h)]
    square = loop_resize(small, tensors.INPUT, tensors.INPUT)
    inner_h, inner_w = math.floor(height * ratio + 0.5), math.floor(width * ratio + 0.5)
    whole = loop_resize([row[pads[0] : pads[0] + inner_w] for row in square[pads[1] : pads[1] + inner_h]], height, width)
    return {(y, x) for y in range(height) for x in range(width) if box[0] <= x < box[2] and box[1] <= y < box[3] and whole[y][x] > 0.5}


@pytest.mark.parametrize(("width", "height", "box"), [(40, 30, (3, 2, 31, 29)), (30, 40, (0, 0, 30, 40)), (33, 7, (32, 6, 33, 7)), (50, 50, (10, 10, 10, 20)), (20, 20, (-0, 5, 99, 99))])
def test_masks_are_the_loop(monkeypatch, width, height, box):
    monkeypatch.setattr(tensors, "INPUT", 64)
    rng = np.random.default_rng(width)
    protos, coefficients = rng.normal(size=(3, 9, 9)), rng.normal(size=3) * 3
    ratio, left, top = tensors.letterboxed(width, height, 64)
    mask = tensors.mask_in_box(protos, coefficients, width, height, (left, top), ratio, box)
    want = loop_mask(protos, coefficients, width, height, (left, top), ratio, box)
    ys, xs = np.nonzero(mask)
    assert {(y + box[1], x + box[0]) for y, x in zip(ys.tolist(), xs.tolist(), strict=True)} == want
    runs = tensors.runs_of(mask, box[0], box[1], width)
    assert sorted(k for a, n in runs for k in range(a, a + n)) == sorted(y * width + x for y, x in want)
    assert all(a + n < b for (a, n), (b, _) in zip(runs, runs[1:], strict=False))


def test_resizing_is_the_loop():
    rng = np.random.default_rng(1)
    for h, w, to_h, to_w in ((5, 7, 13, 4), (1, 1, 3, 3), (8, 2, 8, 2)):
        image = rng.normal(size=(h, w))
        assert np.allclose(tensors.resized(image, to_h, to_w), loop_resize(image.tolist(), to_h, to_w))


def test_runs_go_on_in_the_next_row():
    assert tensors.runs_of(np.ones((2, 4), bool), 0, 0, 4) == [[0, 8]] and tensors.runs_of(np.ones((2, 4), bool), 0, 0, 5) == [[0, 4], [5, 4]]
    assert tensors.runs_of(np.zeros((2, 4), bool), 0, 0, 4) == []


def test_records(spark):
    """Filter, suppression, unpadding, masks and runs, step by step, for several images."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for media in range(5):
        width, height = (int(v) for v in rng.integers(20, 60, 2))
        ratio, left, top = tensors.letterboxed(width, height)
        det = np.hstack([rng.uniform(0, 400, (12, 2)), rng.uniform(300, 640, (12, 2)), rng.random((12, 1)), rng.integers(0, 4, (12, 1)), rng.normal(size=(12, 2))]).astype(np.float32)
        protos = rng.normal(size=(2, 10, 10)).astype(np.float32)
        rows.append((media, det.ravel().tolist(), 8, protos.ravel().tolist(), 10, 10, width, height))
        kept = []
        for d in sorted((d for d in det.astype(float).tolist() if d[4] >= 0.25), key=lambda d: -d[4]):
            if all(_overlap(d, k) <= 0.45 for k in kept):
                kept.append(d)
        for n, d in enumerate(kept):
            box = [min(max((v - p) / ratio, 0), side) for v, p, side in zip(d[:4], (left, top, left, top), (width, height, width, height), strict=True)]
            mask = loop_mask(protos.astype(float), d[6:], width, height, (left, top), ratio, [int(v) for v in box]) if media < 1 else None
            want[media, n] = (("person", "cat")[int(d[5])] if d[5] < 2 else f"cls_{int(d[5])}", d[4], box, mask, width)
    rows += [(90, None, 8, [0.0] * 200, 10, 10, 5, 5), (91, [], 8, [0.0] * 200, 10, 10, 5, 5), (92, rows[0][1], 8, rows[0][3], 10, 10, 0, 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "media_id long, det array<float>, det_dim int, protos array<float>, proto_h int, proto_w int, width int, height int, conf string").repartition(3)
    got = {(r.media_id, r.obj_no): r for r in detect.records(df, 0.25, 0.45, ["person", "cat"]).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    for key, (name, conf, box, mask, width) in want.items():
        r = got[key]
        assert (r.class_name, r.conf) == (name, conf) and np.allclose([r.x1, r.y1, r.x2, r.y2], box)
        assert r.mask_area == sum(n for _, n in r.mask_rle)
        if mask is not None:
            assert {divmod(k, width) for a, n in r.mask_rle for k in range(a, a + n)} == mask
    assert detect.records(df.limit(0), 0.25, 0.45).count() == 0


def _overlap(a, b):
    w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0), max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    area = lambda d: max(d[2] - d[0], 0) * max(d[3] - d[1], 0)
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0


def layouts(found):
    """The same faces (cx, cy, w, h, five points; pixels of the input; score) in the three layouts, everything else at score 0.
    Grid and anchors each take the cell or anchor given with the face."""
    strides, n_anchor = (8, 16, 32), len(tensors.anchors())
    cells = [(tensors.FACE_W // s) * (tensors.FACE_H // s) for s in strides]
    cls, obj = [np.zeros(n) for n in cells], [np.ones(n) for n in cells]
    box, kps = [np.zeros((n, 4)) for n in cells], [np.zeros((n, 10)) for n in cells]
    loc, face, iou = np.zeros((n_anchor, 14)), np.zeros(n_anchor), np.ones(n_anchor)
    flat = []
    for k, (cx, cy, w, h, points, score) in enumerate(found):
        level, s = k % 3, strides[k % 3]
        col, row = int(cx // s), int(cy // s)
        at = row * (tensors.FACE_W // s) + col
        cls[level][at] = score**2
        box[level][at] = (cx / s - col, cy / s - row, math.log(w / s), math.log(h / s))
        kps[level][at] = [v / s - (row if i % 2 else col) for i, v in enumerate(points)]
        ax, ay, aw, ah = tensors.anchors()[37 * k + 5]
        face[37 * k + 5] = score**2
        loc[37 * k + 5, :4] = ((cx / 160 - ax) / aw / 0.1, (cy / 120 - ay) / ah / 0.1, math.log(w / 160 / aw) / 0.2, math.log(h / 120 / ah) / 0.2)
        loc[37 * k + 5, 4:] = [(v / (120 if i % 2 else 160) - (ay if i % 2 else ax)) / (ah if i % 2 else aw) / 0.1 for i, v in enumerate(points)]
        flat.append([cx - w / 2, cy - h / 2, w, h, *points, score])
    logits = np.stack([np.zeros(n_anchor), np.log(np.maximum(face, 1e-12) / np.maximum(1 - face, 1e-12))], axis=1)
    logits[:, 1] = np.where(face > 0, logits[:, 1] + 5, -30)
    logits[:, 0] = np.where(face > 0, 5, 0.5)
    pairs = np.stack([1 - face, face], axis=1)
    grid = [*cls, *obj, *[b.ravel() for b in box], *[p.ravel() for p in kps]]
    return {"grid": grid, "one": [loc.ravel(), face, iou], "pair": [loc.ravel(), pairs.ravel(), iou], "logits": [loc.ravel(), logits.ravel(), iou], "rows": [np.array([f for f in flat] + [[1.0] * 14 + [0.1]]).ravel()]}


def test_layouts_of_faces(spark):
    """One set of faces gives the same boxes in every layout."""
    found = [(30.0, 25.0, 20.0, 24.0, [22.0 + k for k in range(10)], 0.9), (100.5, 60.25, 40.0, 50.0, [80.0 + 3 * k for k in range(10)], 0.8), (130.0, 30.0, 16.0, 18.0, [125.0 + k for k in range(10)], 0.95), (103.0, 62.0, 40.0, 50.0, [1.0] * 10, 0.7)]
    rows = [(k, [o.tolist() for o in outputs], 320, 360) for k, outputs in enumerate(layouts(found).values())]
    rows += [(50, rows[0][1], 19, 100), (51, None, 320, 360), (52, [], 320, 360)]
    df = spark.createDataFrame(rows, "media_id long, outputs array<array<double>>, width int, height int")
    got = {}
    for r in detect.faces_of(df, 0.6).orderBy("media_id", "face_no").collect():
        got.setdefault(r.media_id, []).append([r.x, r.y, r.w, r.h, *r.landmarks, r.conf])
    want = [[(cx - w / 2) * 2, (cy - h / 2) * 3, w * 2, h * 3, *[v * (3 if i % 2 else 2) for i, v in enumerate(points)], score] for cx, cy, w, h, points, score in (found[2], found[0], found[1])]
    assert got.keys() == {0, 1, 2, 3, 4}
    for k in got:
        assert np.allclose(got[k], want, rtol=1e-4 if k == 3 else 1e-9), k


def test_unknown_layout():
    with pytest.raises(ValueError, match="layout"):
        tensors.faces([np.zeros(13)], 100, 100, 0.5)
    with pytest.raises(ValueError, match="anchors"):
        tensors.faces([np.zeros(28), np.zeros(2), np.zeros(2)], 100, 100, 0.5)
