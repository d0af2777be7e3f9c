"""Copies, artifacts, encoders and class names, against what lies in the folders and bytes."""

import json
import os
import struct

import numpy as np
from pyspark.sql import functions as F

from lumora.functions import labels
from lumora.operators import ingest
from lumora.sources import encode, library, placed


def test_listed_files_are_copied_once(spark, tmp_path):
    src, lib = tmp_path / "in put", tmp_path / "library"
    (src / "deep").mkdir(parents=True)
    lib.mkdir()
    (src / "a.jpg").write_bytes(b"a" * 3_000_000)
    (src / "b.MP4").write_bytes(b"b")
    (src / "deep" / "b.MP4").write_bytes(b"later")
    (src / "n.txt").write_bytes(b"n")
    (lib / "in.png").write_bytes(b"here")
    (lib / "b.MP4").write_bytes(b"B")  # another content of the same length
    paths = [str(src / "a.jpg"), str(src / "b.MP4"), str(src / "deep" / "b.MP4"), str(src / "n.txt"), str(lib / "in.png"), str(src / "gone.jpg"), f"file://{lib}/in.png"]
    out = placed.copied(spark, paths, str(lib))
    assert [r.action for r in out.orderBy("position").collect()] == ["copied", "copied", "copied", "unsupported", "present", "error", "present"]
    assert out.where("action = 'error'").first().message.startswith("FileNotFoundError")
    assert {p: (lib / p).read_bytes()[:5] for p in os.listdir(lib)} == {"a.jpg": b"aaaaa", "b.MP4": b"later", "in.png": b"here"}
    times = {p: os.stat(lib / p).st_mtime_ns for p in os.listdir(lib)}
    again = placed.copied(spark, [paths[0], paths[2], paths[4]], str(lib))
    assert {r.action for r in again.collect()} == {"present"} and times == {p: os.stat(lib / p).st_mtime_ns for p in os.listdir(lib)}
    there, final = placed.to_classify(out)
    found = library.with_hash(library.media_files(library.files(spark, str(lib)))).join(there.select("name").distinct(), "name", "left_semi")
    known = spark.createDataFrame([(1, "in.png", 4, "?", found.where("name = 'in.png'").first().sha256, True)], "id long, file_name string, file_size long, meta_modified_at string, file_sha256 string, processed boolean")
    actions = ingest.classified(found.select("path", "name", "size", "modified_at", "sha256"), known).select("path", "action").unionByName(final)
    assert ingest.summary(actions).first().asDict() == {"found": 5, "new": 2, "skipped": 2, "errors": 1}


def test_artifacts_read_back(spark, tmp_path):
    rows = [(1, "x/y", [[0, 4], [9, 1]], None, (0.5, ["a", None])), (2, "ü z", [], "t", (None, []))]
    df = spark.createDataFrame(rows, "n int, name string, rle array<array<bigint>>, note string, nested struct<score: double, tags: array<string>>")
    out = placed.artifacts(df, "name", str(tmp_path / "json")).collect()
    assert len(out) == 2 and all(os.path.getsize(r.path) == r.bytes for r in out) and len(os.listdir(tmp_path / "json")) == 2
    got = {d["n"]: d for d in (json.loads(open(r.path, encoding="utf-8").read()) for r in out)}
    assert got[1] == {"n": 1, "name": "x/y", "rle": [[0, 4], [9, 1]], "note": None, "nested": {"score": 0.5, "tags": ["a", None]}}
    back = spark.read.schema(df.schema).json(str(tmp_path / "json"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    placed.artifacts(df.where("n = 2").withColumn("note", F.lit("new")), "name", str(tmp_path / "json"))
    assert sorted(r.note or "" for r in spark.read.schema(df.schema).json(str(tmp_path / "json")).collect()) == ["", "new"]


def test_a_file_is_whole_or_not_there(tmp_path):
    def broken():
        yield b"half"
        raise RuntimeError

    try:
        placed.place(str(tmp_path / "f"), broken())
    except RuntimeError:
        pass
    assert os.listdir(tmp_path) == []


def bitmap(rgb):
    h, w, _ = rgb.shape
    rows = b"".join(bytes(row[:, ::-1].tobytes()).ljust(-(-w * 3 // 4) * 4, b"\0") for row in rgb[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_each_file_is_decoded_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"{k}": rng.integers(0, 256, (5 + k, 7, 3), np.uint8) for k in range(3)}
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rgb in images.items():
        h, w, _ = rgb.shape
        (folder / f"{k}.bmp").write_bytes(bitmap(rgb) if k != "1" else b"P6\n# made here\n%d %d\n255\n" % (w, h) + rgb.tobytes())
    (folder / "bad.bmp").write_bytes(b"BM?")
    calls = spark.sparkContext.accumulator(0)

    def decode(data):
        calls.add(1)
        return encode.decoded(data)

    def failing(rgb, data):
        raise ValueError("no model")

    encoders = {"mean": lambda rgb, data: rgb.mean(axis=(0, 1)), "chw": lambda rgb, data: encode.normalized(rgb), "size": lambda rgb, data: [len(data)], "broken": failing}
    got = {os.path.basename(r.path): r for r in encode.encoded(library.files(spark, str(folder)), encoders, decode).collect()}
    assert calls.value == 4 and got["bad.bmp"].error.startswith("decode:") and got["bad.bmp"]["mean"] is None
    for k, rgb in images.items():
        r = got[f"{k}.bmp"]
        assert np.allclose(r["mean"], rgb.mean(axis=(0, 1)), rtol=1e-6) and r["size"] == [os.path.getsize(folder / f"{k}.bmp")] and r["broken"] is None and r.error == "broken: no model"
        want = [(rgb[y, x, c] / 255 - encode.MEANS[c]) / encode.DEVIATIONS[c] for c in range(3) for y in range(rgb.shape[0]) for x in range(7)]
        assert np.allclose(r["chw"], want, atol=1e-6)
    assert encode.squared(images["2"]).shape == (256, 256, 3) and (encode.squared(np.full((3, 9, 3), 7, np.uint8)) == 7).all()


def test_class_names_in_a_model(spark):
    blobs = [b"\x00\xffnames{0: 'person', 1: 'fire hydrant', 3: 'caf\xc3\xa9'}\x80 {0: 'later'}", b"no dictionary", b"{0: 'open", b"{0: 'a', x: 'b', 2: 'c'}", None, b"{0: 'dup', 0: 'last'}"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(blobs)], "k int, content binary")
    got = {r.k: r.c for r in df.select("k", labels.model_classes(F.col("content")).alias("c")).collect()}
    none = [f"cls_{i}" for i in range(80)]
    assert got == {0: ["person", "fire hydrant", "cls_2", "café"], 1: none, 2: none, 3: ["a"], 4: none, 5: ["last"]}
