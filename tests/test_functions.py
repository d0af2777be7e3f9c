"""Goldens and properties of the scalar functions."""

import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumora.functions import labels, masks, scalar, text, vectors
from lumora.sources import library

DATES = {
    "2024-03-01T00:30:00+07:00": (2024, 3),
    "2024-03-01T00:30:00": (2024, 3),
    "2024-03-01T00:30:00.125": (2024, 3),
    "2024-03-01 00:30:00": (2024, 3),
    "2024-03-01": (2024, 3),
    "2024/03/15": (2024, 3),
    "1800-03-15": (1800, 3),
    "2024-02-31": (2024, 2),
    "1800/03/15": None,
    "2024-13-01": None,
    "2024-03x": None,
    "abc": None,
    None: None,
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_year_month(spark):
    rows = spark.createDataFrame([(d,) for d in DATES], "d string").select("d", scalar.year_month(F.col("d")).alias("ym")).collect()
    assert {r.d: (tuple(r.ym) if r.ym else None) for r in rows} == DATES


def test_month_falls_back(spark):
    assert tuple(one(spark, scalar.year_month_of(F.lit("x"), F.lit("2020-05-01")).alias("a"))[0]) == (2020, 5)
    assert tuple(one(spark, scalar.year_month_of(F.lit(None).cast("string"), F.lit("")).alias("a"))[0]) == (1970, 1)


def test_fractions_and_times(spark):
    got = one(spark, *[scalar.fraction(F.lit(x)) for x in ("30000/1001", "1/0", "25", "x/2", "1/2/3")], scalar.pts_time(F.lit("n:1 pts_time:3.25 pos")))
    assert [round(x, 3) if x is not None else None for x in got] == [29.97, None, 25.0, None, None, 3.25]


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b.tar.GZ",), ("x",), ("/a/.hidden",)], "p string").select(scalar.base_name(F.col("p")), scalar.stem(F.col("p")), scalar.extension(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("b.tar.GZ", "b.tar", "gz"), ("x", "x", ""), (".hidden", ".hidden", "")]


def test_text(spark):
    got = one(spark, text.normalized(F.lit("  ÁB 　 c\t")), scalar.without_colours(F.lit("\x1b[31mred\x1b[0m")), labels.display_label(F.lit(" dog ")), labels.display_label(F.lit(" ox ")))
    assert list(got) == ["áb c", "red", "chó", " ox "]
    assert len(labels.LABELS) == 80


def test_hash_of_hex(spark):
    got = one(spark, *[vectors.hash_of_hex(F.lit(x)) for x in ("ffffffffffffffff", "0a", "xyz", "1ffffffffffffffff")])
    assert list(got) == [-1, 10, None, None]


def test_cosine_edges(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    got = one(spark, vectors.cosine(a(1, 0), a(1, 0)), vectors.cosine(a(1, 0), a(1, 0, 0)), vectors.cosine(a(0, 0), a(1, 0), 0.0), vectors.cosine(F.array().cast("array<double>"), a(1)))
    assert [round(x, 6) for x in got] == [1.0, 0.0, 0.0, 0.0]


def test_scored_agrees_with_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [-2.0, 1.0])], "id int, vec array<float>")
    got = {r.id: round(r.score, 6) for r in vectors.scored(rows, [2.0, 1.0]).collect()}
    assert got == {1: 0.8, 2: 0.0, 3: 0.0, 4: 0.0, 5: -0.6}


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1))
def test_masks_round_trip(spark, bits):
    rows = spark.createDataFrame([(1, b) for b in bits], "id int, pos long")
    rle = masks.encoded(rows, ["id"]).first().rle
    assert {p for at, n in rle for p in range(at, at + n)} == bits
    assert all(b[0] > a[0] + a[1] for a, b in zip(rle, rle[1:], strict=False))
    back = spark.createDataFrame([(rle,)], f"rle {masks.RUNS}").select(masks.decoded(F.col("rle"), F.lit(30).cast("bigint")), masks.area(F.col("rle"))).first()
    assert set(back[0]) == {b for b in bits if b < 30} and back[1] == len(bits)


def test_mask_golden(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "id int, pos long")
    assert masks.encoded(rows, ["id"]).first().rle == [[1, 2], [4, 1]]
    assert one(spark, masks.parsed(F.lit("[[1,2],[4,1]]")), masks.parsed(F.lit("no")))[:] == ([[1, 2], [4, 1]], None)


def test_word_pieces():
    p = text.WordPieces(text.load_merges(["t h", "", "th e</w>", "a a", "i n", "in g</w>"]), text.load_vocabulary(["the 9", "th@@ 2", "the 1", "a 5"]))
    assert p.ranks["th", "e</w>"] == 2 and p.vocabulary["the"] == 4 and p.vocabulary["a"] == 6
    assert p.tokens("the a thing aaaa") == ["the", "a", "th@@", "ing", "aa@@", "a@@", "a"]
    ids, mask = p.encoded("the zz", 6)
    assert ids == [0, 4, 3, 3, 2, 1] and mask == [1, 1, 1, 1, 1, 0]
    cut, _ = p.encoded("the " * 70)
    assert len(cut) == 64 and 2 not in cut
    assert p.with_specials([7], [8]) == [0, 7, 2, 2, 8, 2, 2]


def test_dimensions():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 48, 64) + b"\0" * 12
    assert library._dimensions(png) == (640, 480) and library._dimensions(jpeg) == (64, 48) and library._dimensions(b"no") is None


def test_settings():
    assert library.Settings.from_env({"LUMORA_FACE_THRESHOLD": "7", "LUMORA_THREADS": "0", "LUMORA_SEARCH_LIMIT": "x"}) == library.Settings(face_threshold=1.0)


def test_library_scan(spark, tmp_path):
    for name, data in {"b.JPG": b"x", "a.thumb.jpg": b"", "sub/c.mp4": b"yy", "d.txt": b"", ".trash/e.jpg": b"", "f.debug.jpg": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.size, r.media_type, r.sha256) for r in library.with_hash(library.media_files(library.files(spark, str(tmp_path)))).collect()}
    assert got == {"b.JPG": (1, "image", hashlib.sha256(b"x").hexdigest()), "c.mp4": (2, "video", hashlib.sha256(b"yy").hexdigest())}


def test_pasted_and_people(spark, tmp_path):
    rows = spark.createDataFrame([("eA==", "PNG", 5), ("eA==", "gif", 6)], "data string, ext string, at long")
    assert [(r.name, bytes(r.content)) for r in library.pasted(rows).collect()] == [("paste_5.png", b"x")]
    (tmp_path / "ada").mkdir()
    (tmp_path / "ada/1.png").write_bytes(b"z")
    (tmp_path / "ada/note.txt").write_bytes(b"z")
    got = library.known_people(spark, str(tmp_path)).select("name", "face_id").collect()
    import uuid

    assert [tuple(r) for r in got] == [("ada", str(uuid.uuid5(uuid.NAMESPACE_DNS, "ada")))]


def test_probe_and_cuts(spark):
    rows = spark.createDataFrame([(1, "25/1", 10, 2.0), (2, "0/0", None, 1.0)], "media_id int, rate string, nb_frames int, duration double")
    assert [tuple(r) for r in library.probed(rows).orderBy("media_id").collect()] == [(1, 25.0, 50), (2, 30.0, 30)]
    lines = spark.createDataFrame([(1, "pts_time:1.5 x"), (1, "pts_time:1.5"), (1, "none")], "media_id int, value string")
    assert [tuple(r) for r in library.scene_cuts(lines, F.lit(25.0)).collect()] == [(1, 38)]


@pytest.mark.parametrize(("text_", "found"), [("/x/Screenshot_1.png", True), ("/x/scr_9.png", True), ("/x/my_screen_shot.png", True), ("/x/scream.png", False)])
def test_screenshots(spark, text_, found):
    from lumora.operators.timeline import screenshot

    assert one(spark, screenshot(F.lit(text_)))[0] is found
