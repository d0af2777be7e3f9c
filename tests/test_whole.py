"""Queries that once ran over a part of their tables, held against their SQL without that part's condition."""

import itertools
import re

import duckdb
import pytest

from lumora.operators import duplicates
from lumora.plans import registry
from tests.test_oracle import TABLES, rows

SEVENTH = ["f05_object_filter", "f06_face_filter", "f08_month_year", "f30_nested_predicates", "p12_nested_paths", "p08_boxes", "p05_thumbnails"]


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connected(sf_dir)


def same(spark, sf_dir, duck, name, part):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) and rows(got) == rows(duck.execute(re.sub(part, "true", registry.ORACLES[name])).df())


@pytest.mark.parametrize("name", SEVENTH)
def test_all_media(spark, sf_dir, duck, name):
    same(spark, sf_dir, duck, name, r"\b(media_)?id % 7 = 0")


def test_all_points(spark, sf_dir, duck):
    same(spark, sf_dir, duck, "j22_similar_points", r"[ab]\.point_id < 40")


@pytest.mark.parametrize("name", ["f18_text_box", "f20_gallery"])
def test_all_visible(spark, sf_dir, duck, name):
    same(spark, sf_dir, duck, name, r"\bid % 3 = 0")


def test_three_stages(spark):
    """Each stage's groups by its own SQL; a later group goes if the earlier ones cover all its members."""
    sf_dir, want, covered = "/root/testdata/sf0.01", [], set()  # sf0.001 has no equal content
    duck = connected(sf_dir)
    for kind, name in (("hash", "w01_mark_duplicates"), ("phash", "a11_hamming_groups"), ("semantic", "a11_cosine_groups")):
        groups = {}
        for r in duck.execute(registry.ORACLES[name]).df().itertuples():
            groups.setdefault(str(r.group_id), set()).add(int(r.media_id))
        kept = {g: m for g, m in groups.items() if not m <= covered}
        want += [(kind, g, i) for g, m in kept.items() for i in m]
        covered = covered.union(*kept.values())
    assert {w[0] for w in want} == {"hash", "phash", "semantic"}
    assert sorted(tuple(r) for r in registry.QUERIES["j19_duplicate_groups"](spark, sf_dir).collect()) == sorted(want)


def test_by_hash(spark):
    hashes = ["00000000000000ff", "0000000000000000", "FFFFFFFFFFFFFFFF", "fffffffffffffe00", "fffffffffffffff0", "0000ffff0000ffff", "0000ffff0000fffe", "0000ffff0000ffff", "zz", None, "00000000000000FF"]
    rows = [(i, h, "2020-01-01" if i == 7 else None, i == 6) for i, h in enumerate(hashes)]
    media = spark.createDataFrame(rows, "id long, file_phash string, deleted_at string, is_hidden boolean")
    assert {(r.group_id, r.media_id) for r in duplicates.by_hash(media).collect()} == {(0, 0), (0, 1), (0, 10), (2, 2), (2, 3), (2, 4)}
    seen = [(i, int(h, 16)) for i, h, gone, hidden in rows if not gone and not hidden and h and h != "zz"]
    assert [(i, j) for (i, x), (j, y) in itertools.combinations(seen, 2) if (x ^ y).bit_count() <= 8] == [(0, 1), (0, 10), (1, 10), (2, 4), (3, 4)]


def test_flags_of_all_media(spark, sf_dir, duck):
    same(spark, sf_dir, duck, "k04_flags", r"\bid < 60")
