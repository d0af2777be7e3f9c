"""Photos by person: right whatever the parts' number, and no task holds a table of all pairs."""

import contextlib
import io
import re

import pytest

from lumora.operators import people


@pytest.mark.parametrize("most", [20, 1_000_000])
def test_photos_meet_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(people, "ROWS", most, raising=False)
    given = [(m, f) for m in range(60) for f in (m % 7, m % 5, m % 7, None)] + [(None, 1), (999, 2), (3, None)]
    faces = spark.createDataFrame(given, "media_id long, face_id long").repartition(5)
    hidden, deleted = {m for m in range(60) if m % 4 == 0}, {m for m in range(60) if m % 9 == 0}
    media = spark.createDataFrame([(m, m in hidden, "2020-01-01" if m in deleted else None) for m in range(60)], "id long, is_hidden boolean, deleted_at string")
    person = spark.createDataFrame([(k, f"n{k}") for k in range(9)] + [(None, "none")], "face_id long, name string")
    found = people.photos_of(faces, media, person)
    seen = set(range(60)) - hidden - deleted
    want = {(k, len({m for m, f in given if f == k and m in seen} if k is not None else ())) for k in [*range(9), None]}
    assert {(r.face_id, r.photos) for r in found.collect()} == want
    with contextlib.redirect_stdout(io.StringIO()) as text:
        found.explain()
    # Pairs of media and face are not the keys of a hash table, and the parts' number follows the rows'.
    assert not [keys for keys in re.findall(r"HashAggregate\(keys=\[(.*?)\]", text.getvalue()) if "media_id" in keys]
    parts = {int(n) for n in re.findall(r"hashpartitioning\(media_id#\d+L, (\d+)\), REPARTITION_BY_NUM", text.getvalue())}
    assert most > len(given) or parts == {-(-len(given) // most)}
