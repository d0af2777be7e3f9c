"""Conversations brought back into their structure, by the cheapest edits.

Role initials of a sound conversation spell s?(ua)+ or nothing. Each row has a fault class: blank (nothing but white space),
duplicate (role and text came earlier in the conversation), truncated (its last character that isn't white space ends no
sentence), or none; the first that applies counts. Edits, by their initials: Keep (0), Rerole to user or assistant (2),
Delete (3; the only one for blank and duplicate rows), Insert an empty user or assistant row (2, anywhere). A truncated row that stays
costs 1 more.

A forward Viterbi pass goes over four states: nothing yet, after s, after u, after a. Each layer has, for each state, the least
(cost, audit), the audit being the edits' initials; it is closed by inserts, at most two in a row, since a third would come
back to a state at a higher cost. Audits are compared without being spelt out: before inserts, two audits of a layer end
with a row's edit and none begins with the other, so the order of the last layer and what a step adds give the order of this one.
An audit tells the path, as every state but the start has one way on; so equal (cost, audit) is one repair.

A conversation is walked in one task, as it comes out of a sort, while it has LONG rows and LONG_BYTES of text at most. The rows of
longer ones are sorted by range over all tasks; equal rows of one turn are one row with a number of copies (all but the first
are duplicates). Each block of rows gives the costs from each state into each, the blocks' tables are put together in order (a few
numbers a block), and then each block walks its rows from the state in which it is entered. Only the final audit and hash of a long
conversation, one row of the result, are written down by one task, which holds nothing but the hash and the audit.

Defined results: null role or text counts as one space. Rows go by turn (nulls first), then role, then text; repeated rows are
duplicates. A null conversation id is an id of its own. Gaps count missing turns between the least and the greatest, nulls
aside. An empty table gives no row. Columns other than the four named are ignored, whatever their names. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import parts, written

#: What counts as white space, and what ends a sentence.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Rows and bytes of text of a conversation that one task holds.
LONG, LONG_BYTES = 10_000, 64 << 20
#: Long conversations whose ids every task holds, at most; more are joined.
MOST_HELD = 100_000
SALTS = 16

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after the next user or assistant row.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEVER = 1 << 60

EDITS = "conv_id long, step long, edit string, role string, text string"
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"
REPORT = f"conv_id long, {STATS}, cost long, audit string, repaired_sha256 string"


@lru_cache(64)
def moves(initial: str, fault: int) -> tuple[tuple[int, int, int, str], ...]:
    """The ways over a row: (state before, state after, cost, edits with the inserts before them), the best of each two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for x in range(4):
        y = x
        for inserts in range(3):
            ways = [(y, DELETE, "D")]
            if fault in (OK, TRUNCATED):
                more = CUT_OFF if fault == TRUNCATED else 0
                ways.append((NEXT[y], REROLE + more, "R"))
                if initial == "s" and y == START:
                    ways.append((AFTER_S, more, "K"))
                elif initial == "ua"[NEXT[y] == AFTER_A]:
                    ways.append((NEXT[y], more, "K"))
            for z, cost, edit in ways:
                found = (INSERT * inserts + cost, "I" * inserts + edit)
                best[x, z] = min(found, best.get((x, z), found))
            y = NEXT[y]
    return tuple((x, z, cost, edits) for (x, z), (cost, edits) in sorted(best.items()))


#: A layer: for each state its cost, its audit's place in the order of audits, and the audit's length.
Layer = tuple[list[int], list[int], list[int]]


def entered(state: int) -> Layer:
    costs = [NEVER] * 4
    costs[state] = 0
    return costs, [0] * 4, [0] * 4


def step(layer: Layer, ways: tuple[tuple[int, int, int, str], ...]) -> tuple[Layer, list[tuple[int, str] | None]]:
    """The next layer, and for each of its states where it came from: (state before, edits)."""
    costs, order, sizes = layer
    best: list[tuple | None] = [None] * 4
    for x, z, cost, edits in ways:
        if costs[x] < NEVER:
            found = (costs[x] + cost, order[x], edits, x)
            if best[z] is None or found < best[z]:
                best[z] = found
    reached = [z for z in range(4) if best[z]]
    new: Layer = ([NEVER] * 4, [0] * 4, [0] * 4)
    for place, z in enumerate(sorted(reached, key=lambda z: best[z][1:3])):
        new[0][z], new[1][z], new[2][z] = best[z][0], place, sizes[best[z][3]] + len(best[z][2])
    return new, [(b[3], b[2]) if b else None for b in best]


def closed(layer: Layer) -> tuple[int, int, int]:
    """The best end: cost, state before the last inserts, number of those."""
    costs, order, _ = layer
    ends = []
    for x in range(4):
        y = x
        for inserts in range(3):
            if costs[x] < NEVER and y in (START, AFTER_A):
                ends.append((costs[x] + INSERT * inserts, order[x], inserts, x))
            y = NEXT[y]
    cost, _, inserts, x = min(ends)
    return cost, x, inserts


def backwards(trail: list[list[tuple[int, str] | None]], end: int) -> tuple[list[str], int]:
    """Each row's edits on the way that ends in the state, and the state it began in."""
    out = []
    for back in reversed(trail):
        end, edits = back[end]
        out.append(edits)
    return out[::-1], end


def written_out(rows: list[tuple[str, str]], edits: list[str], state: int, last: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every edit, in order; deleted rows as they were. last: inserts at the end."""
    name = ("", "", "user", "assistant")
    for (role, text), row_edits in zip(rows, edits, strict=True):
        for e in row_edits[:-1]:
            state = NEXT[state]
            yield e, name[state], ""
        e = row_edits[-1]
        if e == "D":
            yield e, role, text
            continue
        state = AFTER_S if e == "K" and role[:1] == "s" else NEXT[state]
        yield e, role if e == "K" else name[state], text
    for _ in range(last):
        state = NEXT[state]
        yield "I", name[state], ""


def fault_of(text: str, known: bool) -> int:
    """known: role and text came earlier."""
    bare = text.strip(WHITE)
    return BLANK if not bare else DUPLICATE if known else OK if bare[-1] in ENDS else TRUNCATED


class Seen:
    """Counts of a conversation or a block of it; blocks are put together in order."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.turns = [0] * 4, 0, 0
        self.least = self.most = self.first = self.last = None

    def row(self, turn: int | None, initial: str, fault: int, copies: int = 1) -> None:
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def then(self, other: Seen) -> None:
        """Adds the counts of the block that follows."""
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]
        self.illegal += other.illegal + (self.last is not None and other.first is not None and self.last + other.first not in LEGAL)
        self.turns += other.turns - (other.turns > 0 and self.most is not None and self.most == other.least)
        self.first, self.last = self.first if self.first is not None else other.first, other.last if other.last is not None else self.last
        self.least, self.most = self.least if self.least is not None else other.least, other.most if other.most is not None else self.most

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple[tuple[int, ...], int, list[tuple[str, str, str]]]:
    """A whole conversation's counts, its cost, and all edits (edit, role, text). rows: turn, role, text, in order."""
    seen, known, layer, trail = Seen(), set(), entered(START), []
    for turn, role, text in rows:
        fault = fault_of(text, (role, text) in known)
        known.add((role, text))
        seen.row(turn, role[:1], fault)
        layer, back = step(layer, moves(role[:1], fault))
        trail.append(back)
    cost, end, inserts = closed(layer)
    edits, _ = backwards(trail, end)
    return seen.counts(), cost, list(written_out([r[1:] for r in rows], edits, START, inserts))


def _groups(found: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, out of batches sorted by them: (key, the other columns' values)."""
    key, rows = None, []
    for batch in parts(found, "text"):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches, closed by number and by characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= 5000 or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in ddl.split(", ")])


def fingerprint(edits: Iterator[tuple[str, str, str]]) -> tuple[str, str]:
    """The audit, and the hash of the repaired rows as role:text, joined by newline; one row is held at a time."""
    h, audit, first = hashlib.sha256(), [], True
    for edit, role, text in edits:
        audit.append(edit)
        if edit != "D":
            h.update((("" if first else "\n") + role + ":" + text).encode())
            first = False
    return "".join(audit), h.hexdigest()


def _clean(df: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations that a task can hold, and the others' (None if there are none)."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    ids = written(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select(F.col("conv_id").alias("_id"), F.lit(True).alias("_long")), "long-conversations")
    n = ids.count()
    if not n:
        return rows, None
    marked = rows.join(F.broadcast(ids) if n <= MOST_HELD else ids, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return marked.where("_long is null").select(*rows.columns), marked.where("_long").select(*rows.columns)


def _sorted(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _short_edits(rows: DataFrame) -> DataFrame:
    arrow = _arrow(EDITS)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((conv, k, *e) for (conv,), held in _groups(found, 1) for k, e in enumerate(repaired(held)[2])), arrow)

    return _sorted(rows).mapInArrow(run, EDITS)


def _short_reports(rows: DataFrame) -> DataFrame:
    arrow = _arrow(REPORT)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reports() -> Iterator[tuple]:
            for (conv,), held in _groups(found, 1):
                counts, cost, edits = repaired(held)
                yield conv, *counts, cost, *fingerprint(iter(edits))

        yield from _batches(reports(), arrow)

    return _sorted(rows).mapInArrow(run, REPORT)


_BLOCK = "conv_id long, block int, costs array<long>, orders array<long>, sizes array<long>, faults array<long>, illegal long, turns long, least long, most long, first string, last string"
_ENTRY = f"conv_id long, block int, state int, leave int, inserts int, offset long, {STATS}, cost long"


def _blocks(rows: DataFrame) -> DataFrame:
    """Long conversations' rows in order, cut into blocks by range; equal rows of one turn are one row with copies. Written."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    named = same.withColumn("_name", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int").alias("_salt")
    # Only what comes at several turns is looked up, each name dealt over SALTS shares.
    first = named.groupBy("conv_id", "_name").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_c"), F.col("_name").alias("_m"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    met = named.withColumn("_salt", salt).join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_name") == F.col("_m")) & (F.col("_salt") == F.col("_s")), "left")
    known = F.coalesce(place > F.col("_first"), F.lit(False)).alias("known")
    flat = met.select("conv_id", "turn", "role", "text", "copies", known)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(flat.repartitionByRange(n, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text").withColumns({"block": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "conversation-blocks")


def _in_blocks(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "at")


def _copied(turn: int | None, role: str, text: str, copies: int, known: bool) -> tuple[int, int]:
    """A row's fault, and that of its further copies."""
    fault = fault_of(text, known)
    return fault, BLANK if fault == BLANK else DUPLICATE


def _tables(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's costs from every state into every state, with audits' orders and lengths, and its counts."""

    def rows() -> Iterator[tuple]:
        for (conv, block), held in _groups(found, 2):
            seen, layers = Seen(), [entered(x) for x in range(4)]
            for turn, role, text, copies, known in held:
                fault, again = _copied(turn, role, text, copies, known)
                seen.row(turn, role[:1], fault, copies)
                layers = [step(x, moves(role[:1], fault))[0] for x in layers]
                for _ in range(copies - 1):
                    layers = [step(x, moves(role[:1], again))[0] for x in layers]
            flat = [sum((layer[k] for layer in layers), []) for k in range(3)]
            yield conv, block, *flat, seen.faults, seen.illegal, seen.turns, seen.least, seen.most, seen.first, seen.last

    yield from _batches(rows(), _arrow(_BLOCK))


def _entries(table: pa.Table) -> pa.Table:
    """A conversation's blocks put together: the state in which each is entered and left, and how many edits come before it."""
    blocks = table.sort_by([("block", "ascending")]).to_pylist()
    seen, layer, came = Seen(), entered(START), []
    for b in blocks:
        one = Seen()
        one.faults, one.illegal, one.turns, one.least, one.most, one.first, one.last = (b[c] for c in ("faults", "illegal", "turns", "least", "most", "first", "last"))
        seen.then(one)
        best: list[tuple | None] = [None] * 4
        for x in range(4):
            for z in range(4):
                cost = b["costs"][4 * x + z]
                if layer[0][x] < NEVER and cost < NEVER:
                    found = (layer[0][x] + cost, layer[1][x], b["orders"][4 * x + z], x)
                    best[z] = min(found, best[z] or found)
        new: Layer = ([NEVER] * 4, [0] * 4, [0] * 4)
        for place, z in enumerate(sorted((z for z in range(4) if best[z]), key=lambda z: best[z][1:3])):
            x = best[z][3]
            new[0][z], new[1][z], new[2][z] = best[z][0], place, layer[2][x] + b["sizes"][4 * x + z]
        came.append([f and f[3] for f in best])
        layer = new
    cost, end, inserts = closed(layer)
    out, leave = [], end
    for b, back in zip(reversed(blocks), reversed(came), strict=True):
        state = back[leave]
        out.append([b["conv_id"], b["block"], state, leave, inserts if b is blocks[-1] else 0, b["sizes"][4 * state + leave], *seen.counts(), cost])
        leave = state
    offset = 0
    for row in reversed(out):
        row[5], offset = offset, offset + row[5]
    arrow = _arrow(_ENTRY)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)


def _walked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block, from the state in which it is entered to that in which it is left."""

    def rows() -> Iterator[tuple]:
        for (conv, _), held in _groups(found, 2):
            _, _, _, _, _, state, leave, inserts, offset = held[0]
            layer, trail, each = entered(state), [], []
            for turn, role, text, copies, known, *_ in held:
                for k, fault in enumerate(_copied(turn, role, text, copies, known)[: 1 if copies == 1 else 2]):
                    for _ in range(copies - 1 if k else 1):
                        layer, back = step(layer, moves(role[:1], fault))
                        trail.append(back)
                        each.append((role, text))
            edits, _ = backwards(trail, leave)
            for k, e in enumerate(written_out(each, edits, state, inserts)):
                yield conv, offset + k, *e

    yield from _batches(rows(), _arrow(EDITS))


def _long_edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of long conversations, and one row each with counts and cost."""
    blocks = _blocks(rows)
    tables = _in_blocks(blocks).select("conv_id", "block", "turn", "role", "text", "copies", "known").mapInArrow(_tables, _BLOCK)
    entries = written(tables.groupBy("conv_id").applyInArrow(_entries, _ENTRY), "conversation-entries")
    place = entries.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "state", "leave", "inserts", "offset")
    met = blocks.join(place, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    edits = _in_blocks(met).select("conv_id", "block", "turn", "role", "text", "copies", "known", "state", "leave", "inserts", "offset").mapInArrow(_walked, EDITS)
    return edits, entries.where("offset = 0").groupBy("conv_id").agg(*[F.first(c.split(" ")[0]).alias(c.split(" ")[0]) for c in STATS.split(", ")], F.first("cost").alias("cost"))


def edits(df: DataFrame, long_rows: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """All edits: conv_id, step (place in the audit), edit (K, R, D or I), role, text. Rows but D, by step, are the repaired conversation."""
    short, long = _split(_clean(df), long_rows, long_bytes)
    out = _short_edits(short)
    return out if long is None else out.unionByName(_long_edits(long)[0])


def reports(df: DataFrame, long_rows: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    short, long = _split(_clean(df), long_rows, long_bytes)
    out = _short_reports(short)
    if long is None:
        return out
    steps, counts = _long_edits(long)
    arrow = _arrow("conv_id long, audit string, repaired_sha256 string")

    def hashed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a task's conversations, sorted by step."""

        def streamed() -> Iterator[tuple]:
            yield from (row for batch in parts(found, "text") for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def rows() -> Iterator[tuple]:
            source = streamed()
            row = next(source, None)
            while row is not None:
                conv, nxt = row[0], [row]

                def own(conv=conv, nxt=nxt) -> Iterator[tuple]:
                    while nxt[0] is not None and nxt[0][0] == conv:
                        yield nxt[0][2:]
                        nxt[0] = next(source, None)

                yield conv, *fingerprint(own())
                row = nxt[0]

        yield from _batches(rows(), arrow)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = steps.repartition(n, "conv_id").sortWithinPartitions("conv_id", "step").mapInArrow(hashed, "conv_id long, audit string, repaired_sha256 string")
    met = counts.join(prints.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return out.unionByName(met.select(*out.columns))


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) after damage by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes
    the ends of sentences out of it, 3 repeats it, 4 sets its role to user. A null in the key is one space too."""
    key: Column = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], key.alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")


def with_all(found: DataFrame, df: DataFrame) -> DataFrame:
    """reports() with a row for each conversation of df, also those whose rows are all gone: zeros, an empty audit, the hash of nothing."""
    ids = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = ids.join(found.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return met.select("conv_id", *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "conv_id"])
