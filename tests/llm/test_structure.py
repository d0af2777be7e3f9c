"""Repairs against a search over all edits, blocks against whole conversations, and hard inputs."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from lumora.llm import structure
from lumora.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import HARD

SOUND = re.compile(r"(s?(ua)+)?")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = VISIBLE.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, faults):
    """Dijkstra over (row, output so far's grammar position) with whole audits; ties by the audit."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, out = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out

        def go(more, edit, now, role, text, take, cost=cost, audit=audit, at=at, out=out):
            heapq.heappush(queue, (cost + more, audit + edit, at + take, now, out if edit == "D" else (*out, f"{role}:{text}")))

        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[after]
        go(2, "I", after, name, "", 0)
        if at < len(rows):
            _, role, text = rows[at]
            go(3, "D", state, role, text, 1)
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                go(2 + more, "R", after, name, text, 1)
                if role[:1] == after or (role[:1] == "s" and state == ""):
                    go(more, "K", role[:1], role, text, 1)
    raise AssertionError


def brute(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = faults_of(rows)
    cost, audit, out = search(rows, faults)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in rows]
    assert SOUND.fullmatch("".join(x[0] for x in out))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            out += [(conv, turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)] * (2 if d == 3 else 1)
    return out


def by_conversation(rows):
    out = collections.defaultdict(list)
    for conv, *rest in rows:
        out[conv].append(tuple(rest))
    return out


def random_rows(seed, n=60, most=12):
    rnd, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "And", "", " \t", "so it goes.", "why?", "a\nb", "É.", "\x1c", None]
    for conv in range(n):
        for _ in range(rnd.randrange(1, most)):
            rows.append((conv, rnd.choice([None, *range(8)]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "User", None]), rnd.choice(texts) if rnd.random() < 0.6 else f"t{rnd.random()}."))
    rows += [(None, 3, "user", "x."), (None, 1, "assistant", "y."), (10**12, 0, "system", "only")] + [(-5, i, "user" if i % 2 else "assistant", t) for i, t in HARD]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, step int").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_and_least(seed):
    for rows in by_conversation(random_rows(seed, 150)).values():
        ordered = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, cost, edits = structure.repaired(ordered)
        assert (*counts, cost, *structure.fingerprint(iter(edits))) == brute(rows)


@pytest.mark.parametrize(("long_rows", "long_bytes"), [(10_000, 1 << 30), (3, 1 << 30), (10_000, 40), (0, 0)])
def test_reports(spark, long_rows, long_bytes):
    """Short conversations in one go and long ones in blocks give the same."""
    rows = random_rows(9)
    got = {r[0]: tuple(r[1:]) for r in structure.reports(frame(spark, rows), long_rows, long_bytes).collect()}
    assert got == {conv: brute(held) for conv, held in by_conversation(rows).items()}


def test_one_conversation_over_many_blocks(spark):
    rnd = random.Random(4)
    rows = [(7, rnd.choice([None, *range(300)]), rnd.choice(["user", "assistant", "system"]), rnd.choice(["ok.", "ok.", "no", "", f"{k}."])) for k in range(900)] + [(7, 5, "user", "ok.")] * 40 + [(8, 1, "user", "a.")]
    df = frame(spark, rows)
    got = {r[0]: tuple(r[1:]) for r in structure.reports(df, 50).collect()}
    assert got == {conv: brute(held) for conv, held in by_conversation(rows).items()}
    blocks = structure._blocks(structure._clean(df.where("conv_id = 7")))
    assert blocks.select("block").distinct().count() > 1
    steps = structure.edits(df, 50).where("conv_id = 7").orderBy("step").collect()
    assert [r.step for r in steps] == list(range(len(steps))) and structure.fingerprint(((r.edit, r.role, r.text) for r in steps)) == got[7][-2:]
    assert sorted(tuple(r) for r in structure.edits(df).collect()) == sorted(tuple(r) for r in structure.edits(df, 50).collect())


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_structure"](spark, sf_dir).collect()}
    held = by_conversation(damage(rows))
    assert got == {conv: brute(held.get(conv, [])) for conv in {r[0] for r in rows}}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.execute(ORACLES["op11_structure"]).fetchall()} == got


def test_damage_of_hard_rows(spark):
    rows = random_rows(11, 80) + [(k, 0, "user", "gone.") for k in range(1000, 1100)]
    df = frame(spark, rows)
    got = collections.Counter(tuple(r) for r in structure.damaged(df).collect())
    assert got == collections.Counter(damage(rows))
    held = by_conversation(damage(rows))
    out = {r[0]: tuple(r[1:]) for r in structure.with_all(structure.reports(structure.damaged(df)), df).collect()}
    assert out == {conv: brute(held.get(conv, [])) for conv in {r[0] for r in rows}} and any(conv not in held for conv in out)


def test_long_text_and_nothing(spark):
    long = "word " * 400_000 + "end."
    got = structure.reports(frame(spark, [(1, 0, "user", long)])).first()
    assert (got.cost, got.audit) == (2, "KI") and got.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:".encode()).hexdigest()
    empty = frame(spark, [(1, 0, "user", "a")]).limit(0)
    assert structure.with_all(structure.reports(structure.damaged(empty)), empty).count() == 0 and structure.edits(empty).count() == 0
