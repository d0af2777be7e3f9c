"""Detections: suppression, clustering of faces, and decoding of the face detector's grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.checkpoints import written
from lumora.functions import tensors
from lumora.functions.scalar import iou_boxes, iou_corners
from lumora.operators import graph

FACE_OVERLAP, FACE_LEADER = 0.3, 0.33
STRIDES = (8, 16, 32, 64)


def suppressed(detections: DataFrame, threshold: float, key: str = "media_id", order: str = "obj_no", corners: bool = False) -> DataFrame:
    """Greedy suppression by image: in descending confidence, a box goes if it overlaps a kept one by more than threshold.

    An image's boxes are folded in one expression; there are as many as a detector finds in one image. Ties go by order.
    """
    fields = [c for c in detections.columns if c != key]
    overlap = iou_corners if corners else iou_boxes
    row = F.struct((-F.col("conf")).alias("_by"), F.col(order).alias("_ord"), *fields)
    boxes = detections.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    empty = F.slice("_rows", 1, 0)
    keep = lambda kept, d: F.when(F.exists(kept, lambda k: F.coalesce(overlap(k, d) > threshold, F.lit(False))), kept).otherwise(F.concat(kept, F.array(d)))
    return boxes.select(key, F.explode(F.aggregate("_rows", empty, keep)).alias("_d")).select(key, *[F.col(f"_d.{c}").alias(c) for c in fields])


def leaders(faces: DataFrame, threshold: float = FACE_LEADER, rounds: int = 8) -> DataFrame:
    """Online leader clustering in the order of id: a face joins the most similar earlier leader above the threshold (strictly), else
    it leads. Returns id, leader, score (null for leaders).

    That is the first maximal independent set of the similarity graph in the order of ids, found in rounds: a face leads once
    all its earlier neighbours are known to follow, and follows once one of them leads. What `rounds` leave open, long chains
    of faces that only hang on their neighbours, is settled component by component, in order.
    """
    edges = written(graph.cosine_pairs(faces.select("id", "vec"), faces.select("id", "vec"), threshold, strict=True), "face-edges")
    state = written(faces.select("id").distinct().withColumn("role", F.lit(None).cast("string")), "face-roles")
    for _ in range(rounds):
        before = edges.select(F.col("b").alias("id"), F.col("a").alias("_a")).join(state.select(F.col("id").alias("_a"), F.col("role").alias("_r")), "_a")
        near = before.groupBy("id").agg(F.bool_or(F.coalesce(F.col("_r") == "leads", F.lit(False))).alias("_led"), F.bool_or(F.col("_r").isNull()).alias("_open"))
        role = F.when(F.col("role").isNotNull(), F.col("role")).when(F.coalesce("_led", F.lit(False)), F.lit("follows")).when(~F.coalesce("_open", F.lit(False)), F.lit("leads"))
        state = written(state.join(near, "id", "left").select("id", role.alias("role")), "face-roles")
        if not state.where(F.col("role").isNull()).limit(1).count():
            break
    else:
        state = _settled(state, edges)
    led = edges.join(state.where(F.col("role") == "leads").select(F.col("id").alias("a")), "a", "left_semi")
    best = led.groupBy(F.col("b").alias("id")).agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("_l"), F.max("score").alias("_s"))
    follows = F.col("role") == "follows"
    return state.join(best, "id", "left").select("id", F.when(follows, F.col("_l")).otherwise(F.col("id")).alias("leader"), F.when(follows, F.col("_s")).alias("score"))


def _settled(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Roles of the faces that have none yet. Those near an earlier leader follow. The earlier neighbours of the others are open
    too, or follow; so each component of the open ones is walked in the order of id, and only its edges are in memory."""
    led = edges.join(state.where("role = 'leads'").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("_led", F.lit("follows"))
    state = written(state.join(led, "id", "left").select("id", F.coalesce("role", "_led").alias("role")), "face-roles")
    open_ = state.where(F.col("role").isNull()).select("id")
    among = edges.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    roots = graph.components(among)

    def walk(rows: pa.Table) -> pa.Table:
        follows: set[int] = set()
        for a, b in sorted(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True)):
            if a not in follows:  # all of a's earlier neighbours were seen before it
                follows.add(b)
        ids = sorted({*rows.column("a").to_pylist(), *rows.column("b").to_pylist()})
        return pa.table({"id": pa.array(ids, pa.int64()), "new": pa.array(["follows" if k in follows else "leads" for k in ids])})

    found = among.join(roots.withColumnRenamed("id", "a"), "a").groupBy("root").applyInArrow(walk, "id long, new string")
    return written(state.join(found, "id", "left").select("id", F.coalesce("role", "new", F.lit("leads")).alias("role")), "face-roles")


def anchor_grid(sizes: DataFrame) -> DataFrame:
    """The face detector's grid for each input size (width, height): with stride, row, col, x, y (in pixels)."""
    side = lambda c: F.ceil(F.col(c) / F.col("stride")).cast("int")
    cells = sizes.select("width", "height", F.explode(F.array(*[F.lit(s) for s in STRIDES])).alias("stride"))
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), side("height") - 1)).alias("row"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), side("width") - 1)).alias("col")).select("*", (F.col("col") * F.col("stride")).alias("x"), (F.col("row") * F.col("stride")).alias("y"))


def anchors(spark: SparkSession, width: int, height: int) -> DataFrame:
    """The grid of one input size: stride, row, col, x, y."""
    return anchor_grid(spark.range(1).select(F.lit(width).alias("width"), F.lit(height).alias("height"))).drop("width", "height")


def _images(found: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of images in parts of about `size` bytes at most, so that tensors of a few are unpacked at once."""
    for batch in found:
        few = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for lo in range(0, batch.num_rows, few):
            yield batch.slice(lo, few)


def _floats(values: list | None) -> np.ndarray:
    return np.array(values or [], np.float64)


def _tensors(lists: pa.Array) -> list[np.ndarray]:
    """An image's lists of numbers as arrays, without Python's numbers between."""
    return [np.zeros(0) if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in lists]


RECORDS = "media_id long, obj_no int, class_name string, conf double, x1 double, y1 double, x2 double, y2 double, mask_area long, mask_rle array<array<bigint>>"


def records(raw: DataFrame, confidence: float, overlap: float, names: list[str] | None = None) -> DataFrame:
    """The detector's raw outputs to records, in one pass: confident detections, suppressed, unpadded, with masks as runs.

    raw: media_id, det (array<float>: rows of det_dim values, x1, y1, x2, y2 in the padded square, confidence, class, then a coefficient a
    prototype), det_dim, protos (array<float>: channels by height by width), proto_h, proto_w, width, height. Classes beyond `names` are
    cls_<number>. Images without a tensor, or of no size, give no record. An image is one task's work; a row holds all that it needs.
    """
    names = list(names or [])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _images(found):
            out = []
            for r in batch.to_pylist():
                if not (r["det"] and r["det_dim"] and r["width"] and r["height"]):
                    continue
                det, protos = _floats(r["det"]).reshape(-1, r["det_dim"]), _floats(r["protos"]).reshape(r["det_dim"] - 6, r["proto_h"], r["proto_w"])
                for k, (kind, conf, box, area, rle) in enumerate(tensors.detections(det, protos, r["width"], r["height"], confidence, overlap)):
                    out.append((r["media_id"], k, names[kind] if 0 <= kind < len(names) else f"cls_{kind}", conf, *box, area, rle))
            yield _batch(out, RECORD_TYPES)

    wanted = ["media_id", "det", "det_dim", "protos", "proto_h", "proto_w", "width", "height"]
    return raw.select(F.col("media_id").cast("long").alias("media_id"), *wanted[1:]).mapInArrow(run, RECORDS)


RECORD_TYPES = pa.schema([("media_id", pa.int64()), ("obj_no", pa.int32()), ("class_name", pa.string()), *[(c, pa.float64()) for c in ("conf", "x1", "y1", "x2", "y2")], ("mask_area", pa.int64()), ("mask_rle", pa.list_(pa.list_(pa.int64())))])
FACES = "media_id long, face_no int, conf double, x double, y double, w double, h double, landmarks array<double>"
FACE_TYPES = pa.schema([("media_id", pa.int64()), ("face_no", pa.int32()), *[(c, pa.float64()) for c in ("conf", "x", "y", "w", "h")], ("landmarks", pa.list_(pa.float64()))])
#: An image with a side below this has no faces.
FACE_SIDE = 20


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def faces_of(raw: DataFrame, threshold: float, overlap: float = FACE_OVERLAP) -> DataFrame:
    """The face detector's raw outputs to faces in the image's pixels, suppressed: media_id, face_no (best first), conf, x, y, w, h, landmarks
    (five points). raw: media_id, outputs (array<array<float>>, in any of three layouts, told by their lengths), width, height."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _images(found):
            out = []
            media, outputs, widths, heights = batch.columns
            for n, (id_, width, height) in enumerate(zip(media.to_pylist(), widths.to_pylist(), heights.to_pylist(), strict=True)):
                if outputs[n].is_valid and len(outputs[n]) and min(width or 0, height or 0) >= FACE_SIDE:
                    for k, f in enumerate(tensors.faces(_tensors(outputs[n].values), width, height, threshold, overlap).tolist()):
                        out.append((id_, k, f[14], *f[:4], f[4:14]))
            yield _batch(out, FACE_TYPES)

    return raw.select(F.col("media_id").cast("long").alias("media_id"), "outputs", "width", "height").mapInArrow(run, FACES)


def large_enough(w: Column, h: Column, least: int) -> Column:
    return F.least(w, h) >= least


def hit(objects: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (point_id, media_id, px, py) the first object whose box holds it."""
    box = F.struct("x", "y", "w", "h")
    held = points.join(objects, "media_id").where(F.col("px").between(box["x"], box["x"] + box["w"]) & F.col("py").between(box["y"], box["y"] + box["h"]))
    return held.groupBy("point_id").agg(F.min(F.struct("obj_no", "class_name")).alias("_o")).select("point_id", "_o.obj_no", "_o.class_name")
