"""Kernels over a model's output tensors: masks from prototypes, and the three layouts of face detections. One image at a time, in tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: What resizing can add to a mask's values or take from them, by rounding.
EDGE = 1e-6
#: Boxes up to which suppression is quicker with Python's numbers.
FEW = 16
#: Side of the square that the detector sees.
INPUT = 640
#: Fixed values of the face detector: its input, strides of the grid layout, and the anchors' strides, sizes and variances.
FACE_W, FACE_H = 160, 120
GRID_STRIDES = (8, 16, 32)
ANCHORS = ((8, (10, 16, 24)), (16, (32, 48)), (32, (64, 96)), (64, (128, 192, 256)))
CENTRE_VARIANCE, SIZE_VARIANCE = 0.1, 0.2
LANDMARKS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -88, 88)))


def _places(source: int, target: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For target places lo to hi (exclusive): the source places before and after, and the share of the latter, as a column."""
    at = np.maximum((np.arange(lo, hi) + 0.5) * source / target - 0.5, 0)
    low = np.minimum(at.astype(np.int64), source - 1)
    return low, np.minimum(low + 1, source - 1), (at - low)[:, None]


def _between(rows: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    low, high, share = places
    return rows[low] * (1 - share) + rows[high] * share


@lru_cache(16)
def _taps(source: int, target: int) -> np.ndarray:
    """The bilinear weights of all target places over source places: (target, source)."""
    return _between(np.eye(source), _places(source, target, 0, target))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, places taken at pixel centres, edges repeated."""
    return _taps(image.shape[0], height) @ image @ _taps(image.shape[1], width).T


def mask_in_box(protos: np.ndarray, coefficients: np.ndarray, width: int, height: int, pads: tuple[int, int], ratio: float, box: tuple[int, int, int, int]) -> np.ndarray:
    """The part of an object's mask that lies in its box (x1, y1, x2, y2; whole pixels, ends exclusive), as booleans.

    Prototypes (channels, h, w) times coefficients, through the sigmoid, resized to the input square, cut to the image without its
    pads (left, top), resized to the image, set where over one half. Both resizings act on rows and columns apart, so each is a product of
    two small matrices, and only the box's pixels are made.
    """
    x1, y1, x2, y2 = box[0], box[1], min(box[2], width), min(box[3], height)
    if x1 >= x2 or y1 >= y2:
        return np.zeros((max(0, y2 - y1), max(0, x2 - x1)), bool)
    mask = sigmoid((coefficients @ protos.reshape(len(protos), protos.shape[1] * protos.shape[2])).reshape(protos.shape[1:]))
    # Pixels lie between the mask's values.
    if mask.min() > 0.5 + EDGE or mask.max() < 0.5 - EDGE:
        return np.full((y2 - y1, x2 - x1), mask[0, 0] > 0.5)

    def both(source: int, side: int, pad: int, lo: int, hi: int) -> np.ndarray:
        inner = int(np.floor(side * ratio + 0.5))
        return _between(_taps(source, INPUT)[pad : pad + inner], _places(inner, side, lo, hi))

    return both(mask.shape[0], height, pads[1], y1, y2) @ mask @ both(mask.shape[1], width, pads[0], x1, x2).T > 0.5


def runs_of(mask: np.ndarray, x1: int, y1: int, width: int) -> list[list[int]]:
    """[offset, length] of the set pixels, row by row over the whole image, of a mask whose corner lies at (x1, y1). A run that
    reaches the end of a row goes on in the next."""
    if not mask.any():
        return []
    # With an unset pixel before the first and after each row, runs lie between changes.
    wide = np.zeros((mask.shape[0], mask.shape[1] + 1), bool)
    wide[:, :-1] = mask
    flat = wide.ravel()
    changes = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    changes = np.concatenate([[0], changes]) if flat[0] else changes
    first, n = changes[::2], changes[1::2] - changes[::2]
    y, x = np.divmod(first, wide.shape[1])
    at = (y + y1) * width + x + x1
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + n[:-1]]))
    return np.stack([at[new], np.add.reduceat(n, new)], axis=1).tolist()


def _few_suppressed(boxes: list[list[float]], order: list[int], threshold: float) -> list[int]:
    out = []
    for k in order:
        x1, y1, x2, y2 = boxes[k]
        area = max(x2 - x1, 0.0) * max(y2 - y1, 0.0)
        for i in out:
            u1, v1, u2, v2 = boxes[i]
            inter = max(min(x2, u2) - max(x1, u1), 0.0) * max(min(y2, v2) - max(y1, v1), 0.0)
            union = area + max(u2 - u1, 0.0) * max(v2 - v1, 0.0) - inter
            if (inter / union if union > 0 else 0.0) > threshold:
                break
        else:
            out.append(k)
    return out


def suppressed(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Greedy suppression over corner boxes: the indexes that stay, best first, equal scores in their order. Boxes whose
    corners are the wrong way round have no area, and a pair without area doesn't overlap."""
    if len(boxes) <= FEW and np.isfinite(boxes).all():
        return _few_suppressed(boxes.tolist(), np.argsort(-scores, kind="stable").tolist(), threshold)
    area = np.prod(np.maximum(boxes[:, 2:] - boxes[:, :2], 0), axis=1)
    live, out = np.argsort(-scores, kind="stable"), []
    while len(live):
        i, live = live[0], live[1:]
        out.append(int(i))
        sides = np.minimum(boxes[live, 2:], boxes[i, 2:]) - np.maximum(boxes[live, :2], boxes[i, :2])
        inter = np.prod(np.maximum(sides, 0), axis=1)
        union = area[live] + area[i] - inter
        live = live[np.where(union > 0, inter / np.where(union > 0, union, 1), 0) <= threshold]
    return out


def letterboxed(width: int, height: int, size: int = INPUT) -> tuple[float, int, int]:
    """Ratio, left pad and top pad (whole pixels) that fit an image into the square."""
    ratio = min(size / width, size / height)
    return ratio, (size - int(np.floor(width * ratio + 0.5))) // 2, (size - int(np.floor(height * ratio + 0.5))) // 2


def detections(raw: np.ndarray, protos: np.ndarray, width: int, height: int, confidence: float, overlap: float, pads: tuple[float, int, int] | None = None) -> list[tuple]:
    """Rows (x1, y1, x2, y2, conf, class, coefficients) of the detector's output to records (class, conf, box in the image, area, runs):
    confident ones, suppressed regardless of class, unpadded, with masks; best first. pads: ratio, left, top."""
    raw = raw[raw[:, 4] >= confidence]
    ratio, left, top = pads or letterboxed(width, height)
    out = []
    for k in suppressed(raw[:, :4], raw[:, 4], overlap):
        box = np.clip((raw[k, :4] - [left, top, left, top]) / ratio, 0, [width, height, width, height])
        whole = tuple(int(v) for v in box)
        mask = mask_in_box(protos, raw[k, 6:], width, height, (left, top), ratio, whole)
        out.append((int(raw[k, 5]), float(raw[k, 4]), tuple(map(float, box)), int(mask.sum()), runs_of(mask, whole[0], whole[1], width)))
    return out


@lru_cache(1)
def anchors() -> np.ndarray:
    """Centre x, centre y, width and height of each anchor, as shares of the face detector's input."""
    out = []
    for stride, sizes in ANCHORS:
        y, x, s = np.meshgrid(np.arange(FACE_H // stride), np.arange(FACE_W // stride), np.array(sizes), indexing="ij")
        out.append(np.stack([(x + 0.5) * stride / FACE_W, (y + 0.5) * stride / FACE_H, s / FACE_W, s / FACE_H], axis=-1).reshape(-1, 4))
    return np.concatenate(out)


def _score(face: np.ndarray, object_: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(face, 0, 1) * np.clip(object_, 0, 1))


def _from_grid(outputs: list[np.ndarray]) -> np.ndarray:
    """Four tensors a stride: class, object, box (dx, dy, log w, log h), landmarks; relative to the cells of a grid."""
    out = []
    for k, stride in enumerate(GRID_STRIDES):
        cols, rows = FACE_W // stride, FACE_H // stride
        cell = np.stack([np.tile(np.arange(cols), rows), np.repeat(np.arange(rows), cols)], axis=1).astype(float)
        box, marks = outputs[k + 6].reshape(-1, 4), outputs[k + 9].reshape(-1, LANDMARKS, 2)
        size = np.exp(box[:, 2:]) * stride
        points = ((marks + cell[:, None]) * stride).reshape(-1, 2 * LANDMARKS)
        out.append(np.hstack([(cell + box[:, :2]) * stride - size / 2, size, points, _score(outputs[k], outputs[k + 3])[:, None]]))
    return np.concatenate(out)


def _from_anchors(outputs: list[np.ndarray]) -> np.ndarray:
    """Offsets from anchors (14 a face), classes (one, or background and face as shares or logits), overlaps."""
    loc, prior, scale = outputs[0].reshape(-1, 14), anchors(), np.array([FACE_W, FACE_H])
    if len(prior) != len(loc):
        raise ValueError(f"{len(loc)} faces for {len(prior)} anchors")
    face = outputs[1]
    if len(face) != len(loc):
        pair = face.reshape(-1, 2)
        e = np.exp(pair - pair.max(axis=1, keepdims=True))
        face = np.where(((pair >= 0) & (pair <= 1)).all(axis=1), pair[:, 1], e[:, 1] / (e.sum(axis=1) + 1e-6))
    size = prior[:, 2:] * np.exp(loc[:, 2:4] * SIZE_VARIANCE)
    points = prior[:, None, :2] + loc[:, 4:].reshape(-1, LANDMARKS, 2) * CENTRE_VARIANCE * prior[:, None, 2:]
    corner = prior[:, :2] + loc[:, :2] * CENTRE_VARIANCE * prior[:, 2:] - size / 2
    return np.hstack([corner * scale, size * scale, (points * scale).reshape(-1, 2 * LANDMARKS), _score(face, outputs[2])[:, None]])


def layout_of(sizes: list[int]) -> str:
    """Which layout outputs of these lengths have: grid (12 tensors), anchors (3, by the anchors' number), rows (15 values a face)."""
    n = sizes[0] // 14 if sizes else 0
    if len(sizes) >= 4 * len(GRID_STRIDES):
        return "grid"
    if len(sizes) == 3 and sizes[0] % 14 == 0 and sizes[2] == n and sizes[1] in (n, 2 * n):
        return "anchors"
    if sizes and sizes[0] % 15 == 0:
        return "rows"
    raise ValueError(f"unknown layout of face outputs: {sizes}")


def faces(outputs: list[np.ndarray], width: int, height: int, threshold: float, overlap: float = 0.3) -> np.ndarray:
    """Faces of an image as rows of 15 values in its pixels: x, y, w, h, five landmarks, score; best first, suppressed."""
    kind = layout_of([len(o) for o in outputs])
    rows = _from_grid(outputs) if kind == "grid" else _from_anchors(outputs) if kind == "anchors" else outputs[0].reshape(-1, 15)
    rows = rows[rows[:, 14] >= threshold]
    rows = rows * np.append(np.tile([width / FACE_W, height / FACE_H], 2 + LANDMARKS), 1.0)
    return rows[suppressed(np.hstack([rows[:, :2], rows[:, :2] + rows[:, 2:4]]), rows[:, 14], overlap)]
