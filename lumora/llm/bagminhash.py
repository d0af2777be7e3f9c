"""Near-duplicates by BagMinHash.

A document is a bag of shingles of five words (lower case, split at white space). Documents whose weighted Jaccard
similarity, the sum of the lesser counts over the sum of the greater ones, is THRESHOLD or more are linked; a class
is a connected component of links.

1. Signatures. A shingle's weight is cut into levels (0,1], (1,2], (2,4], (4,8] and so on. Each level of each shingle has
   a Poisson process of points, the same in every document, whose rate is the level's width; a point has a time, a height
   in its level, which must not exceed the weight, and a register. A register keeps its earliest point, so two documents
   agree in a register with probability equal to their weighted Jaccard similarity. Only points up to a time at which
   all registers are very likely filled are made; a document with an empty register gets twice the time.
2. Bands. Documents that agree in a band of registers meet. Within such a meeting, whole signatures are compared, and pairs
   whose agreement is within SIGMAS deviations of THRESHOLD are joined into groups; only a spanning forest goes on.
3. Verification. Within each group the bags themselves are compared, exactly: an index on the rarest shingles (a pair at
   or above the threshold must share one of them) gives the pairs, and the sum of lesser counts decides. Again only a
   spanning forest of true links goes on, so rows never grow with the square of a group.
4. The components of those links are the classes.

Texts of the same words are one node from the start (copies aren't compared with each other), whatever their doc_ids; bands, groups and
nodes with very many rows are joined by a broadcast of at most HOTTEST keys. In a meeting or group of more than BLOCK members, all are first compared
with its least member alone. Those near it are linked by that, and need no comparison with one another, as only
components count; the others are cut into blocks, and block by block compared with all, each pair of blocks a task row
set of its own. So a dense group costs in proportion to its members, however many there are.

Defined results: rows with one doc_id and different texts are documents of their own, each with its own text's class. Documents without a word (null, empty, blank) are classes of their own. Documents of one to four words
have one shingle, all their words. Repeated rows are copies. The class id is the least doc_id of the class. Rows whose
doc_id is null take no part; an empty table gives no row. Other columns than the two named are ignored, whatever their
names. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import parts, texts_of, written
from lumora.operators.graph import components

WORDS, THRESHOLD = 5, 0.8
#: Registers; bands and registers in a band (a pair at the threshold meets with probability 1 - (1 - 0.8**4)**24, 0.999997).
REGISTERS, BANDS, ROWS = 128, 24, 4
#: Deviations below the threshold at which signatures still count as near.
SIGMAS = 4.5
#: Members of a meeting or group that are compared as one block; shares that the members of one key are dealt over.
BLOCK, SALTS = 512, 16
#: Names whose copies are joined by broadcast, at most: those of more than a HOTTEST-th of all rows.
HOTTEST = 10_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def bags(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """All texts' distinct shingles (sorted within a text), their counts, where each text's begin, and a 128-bit name of
    each text's words (None if it has none)."""
    import xxhash

    digest, name = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    shingles, counts, ends, names = [], [], [0], []
    for text in texts:
        split = text.lower().encode("utf-8").split()
        names.append(name(b" ".join(split)) if split else None)
        h = np.fromiter(map(digest, split), np.uint64, len(split))
        if len(h) >= words:
            s = h[: len(h) - words + 1].copy()
            for k in range(1, words):
                s *= _U(0x9E3779B97F4A7C15)
                s += h[k : len(h) - words + 1 + k]
        else:
            s = h[:0] if not len(h) else np.array([digest(b" ".join(split), seed=1)], np.uint64)
        s = np.sort(_mix(s))
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        shingles.append(s[new])
        counts.append(np.diff(np.append(new, len(s))))
        ends.append(ends[-1] + len(new))
    return np.concatenate([np.zeros(0, np.uint64), *shingles]), np.concatenate([np.zeros(0, np.int64), *counts]), np.array(ends), names


def signatures(shingles: np.ndarray, counts: np.ndarray, ends: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of 16-bit registers for each bag; equal values stand for equal earliest points. Empty bags have zeros."""
    n = len(ends) - 1
    best = np.full(n * registers, np.inf)
    doc = np.repeat(np.arange(n), np.diff(ends))
    weight = np.bincount(doc, counts, n)
    limit = registers * (np.log(registers) + 4) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        active = np.zeros(n, bool)
        active[todo] = True
        pick = np.flatnonzero(active[doc])
        d, x, c = doc[pick], shingles[pick], counts[pick]
        level = 0
        while len(d):
            # Level 0 is (0, 1], level k is (2**(k-1), 2**k].
            low, wide = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            state = _mix(x + _U((0x632BE59BD9B4E019 * (level + 1)) & (2**64 - 1)))
            dd, cc, t = d, c, np.zeros(len(d))
            while len(dd):
                state = _mix(state + _U(0x9E3779B97F4A7C15))
                t = t - np.log(((state >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / wide
                live = t <= limit[dd]
                dd, cc, t, state = dd[live], cc[live], t[live], state[live]
                if not len(dd):
                    break
                draw = _mix(state ^ _U(0xD6E8FEB86659FD93))
                at = dd * registers + ((draw >> _U(40)) % _U(registers)).astype(np.int64)
                if level:
                    fits = low + 1 + (draw & _U(wide - 1)).astype(np.int64) <= cc
                    np.minimum.at(best, at[fits], t[fits])
                else:
                    np.minimum.at(best, at, t)
            level += 1
            more = c > (1 << (level - 1))
            d, x, c = d[more], x[more], c[more]
        empty = ~np.isfinite(best.reshape(n, registers)).all(axis=1)
        todo = todo[empty[todo]]
        limit[todo] *= 2
    out = (_mix(best.view(np.uint64)) >> _U(48)).astype(np.uint16).reshape(n, registers)
    out[weight == 0] = 0
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (distinct shingles, sorted, and counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def near_by_signature(sigs: np.ndarray, sizes: np.ndarray, least: int, sides: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that agree in `least` registers or more, and whose sizes allow the threshold. sides:
    pairs on the same side, unless it is 0, are another block's work."""
    n = len(sigs)
    if n == 2:
        near = (sides[0] != sides[1] or sides[0] == 0) and sizes.min() >= THRESHOLD * sizes.max() - 1e-9 and (sigs[0] == sigs[1]).sum() >= least
        return [(0, 1)] if near else []
    root, out = np.arange(n), []
    # Members compare with all that aren't joined to them yet, those of small components first. Whoever had a turn has met
    # everyone, so it is over once those who still wait are in one component.
    waiting = np.ones(n, bool)
    while waiting.any():
        at = np.flatnonzero(waiting)
        if (root[at] == root[at[0]]).all():
            break
        i = int(at[np.argmin(np.bincount(root, minlength=n)[root[at]])])
        waiting[i] = False
        rest = np.flatnonzero((root != root[i]) & ((sides != sides[i]) | (sides == 0)))
        if not len(rest):
            continue
        fit = rest[np.minimum(sizes[rest], sizes[i]) >= THRESHOLD * np.maximum(sizes[rest], sizes[i]) - 1e-9]
        hit = fit[(sigs[fit] == sigs[i]).sum(axis=1) >= least] if len(fit) else fit
        for j in hit.tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out


def near_by_bags(all_bags: list[tuple[np.ndarray, np.ndarray]], threshold: float, sides: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at or above the threshold, exactly. sides: as above."""
    n = len(all_bags)
    if n == 2:
        return [(0, 1)] if (sides[0] != sides[1] or sides[0] == 0) and similarity(*all_bags) >= threshold - 1e-12 else []
    flat = np.concatenate([b[0] for b in all_bags])
    names, codes, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.empty(len(names), np.int64)
    order[np.lexsort((names, often))] = np.arange(len(names))
    codes, at = order[codes], 0
    coded = []
    for s, c in all_bags:
        k = codes[at : at + len(s)]
        by = np.argsort(k)
        coded.append((k[by], c[by]))
        at += len(s)
    sizes = np.array([int(c.sum()) for _, c in coded])
    forest, index, out = Forest(n), {}, []
    weights = np.zeros(len(names), np.int64)
    for i in np.argsort(sizes, kind="stable").tolist():
        s, c = coded[i]
        # A pair at the threshold shares at least threshold * size of i, so it meets among i's first tokens beyond that.
        spare = sizes[i] - int(np.ceil(threshold * sizes[i] - 1e-9)) + 1
        prefix = s[: int(np.searchsorted(np.cumsum(c), spare)) + 1].tolist()
        found = {j for w in prefix for j in index.get(w, ()) if sizes[j] >= threshold * sizes[i] - 1e-9}
        weights[s] = c
        for j in sorted(found):
            if (sides[i] == sides[j] and sides[i] != 0) or forest.find(i) == forest.find(j):
                continue
            both = int(np.minimum(weights[coded[j][0]], coded[j][1]).sum())
            if both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9 and forest.join(i, j):
                out.append((i, j))
        weights[s] = 0
        for w in prefix:
            index.setdefault(w, []).append(i)
    return out


def _signed(registers: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.string()), ("name", pa.binary()), ("size", pa.int64()), ("sig", pa.binary())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text", 400):
            shingles, counts, ends, names = bags(texts_of(batch.column(2)))
            sigs = signatures(shingles, counts, ends, registers)
            sizes = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(ends)), counts, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.binary()), pa.array(sizes), pa.array([s.tobytes() for s in sigs], pa.binary())], schema=schema)

    return run


def _grouped(found: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first columns, out of batches sorted by them."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in found:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        columns = [t.column(k).to_numpy() for k in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *cut.tolist(), t.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def _pairs_of(near: Callable[[pa.Table, np.ndarray], list[tuple[int, int]]], keys: int, id_at: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _grouped(found, keys):
            if group.num_rows < 2:
                continue
            ids = group.column(id_at).to_numpy()
            for i, j in near(group, group.column(id_at + 1).to_numpy()):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _starred(members: DataFrame, key: str, values: list[str], near: Callable[[list[pa.Array], list[pa.Array]], np.ndarray], name: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Members (key, n, rep, values) to rows for the comparison of blocks (key, _block, rep, _side, values), and links (a, b) of those
    near their key's least member (None if no key has over BLOCK members; most: what the largest has). _side is 0 where a block meets itself, else 1 or 2: which block of the pair."""
    rest = ["rep", *values]
    cold = members.where(F.col("n") <= BLOCK).select(key, F.lit(0).cast("long").alias("_block"), "rep", F.lit(0).alias("_side"), *values)
    if most <= BLOCK:
        return cold, None
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hot = written(members.where(F.col("n") > BLOCK).select(key, "n", *rest, salt), f"{name}-hot")
    least = hot.groupBy(key).agg(F.min(F.struct(*rest)).alias("l")).select(key, *[F.col(f"l.{c}").alias(f"l_{c}") for c in rest], salts)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hot.schema) + ", lead long"

    def flagged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hot_columns
        for batch in found:
            if batch.num_rows:
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                linked = near([column[c] for c in values], [column[f"l_{c}"] for c in values]) | (column["rep"].to_numpy() == column["l_rep"].to_numpy())
                yield pa.RecordBatch.from_arrays([*(column[c] for c in own), pa.array(column["l_rep"].to_numpy(), mask=~linked)], names=[*own, "lead"])

    hot_columns = hot.columns
    star = written(hot.join(least, [key, "salt"]).select(*hot.columns, *[f"l_{c}" for c in rest]).mapInArrow(flagged, schema), f"{name}-star")
    outside = star.groupBy(key).agg(F.count_if(F.col("lead").isNull()).alias("o")).where("o > 0").select(key, "o", salts)
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    out, all_ = blocks_of(F.col("o")), blocks_of(F.col("o")) + blocks_of(F.col("n") - F.col("o"))
    own = F.when(F.col("lead").isNull(), F.pmod(F.xxhash64("rep"), out)).otherwise(out + F.pmod(F.xxhash64("rep"), F.greatest(all_ - out, F.lit(1)))).cast("int")
    pair = lambda other: F.struct((F.least("own", other) * F.col("all") + F.greatest("own", other)).cast("long").alias("_block"), F.when(F.col("own") == other, 0).when(F.col("own") < other, 1).otherwise(2).alias("_side"))
    numbered = star.join(outside, [key, "salt"]).withColumns({"own": own, "all": all_.cast("long"), "last": F.when(F.col("lead").isNull(), all_).otherwise(out) - 1})
    met = numbered.select(key, *rest, F.inline(F.transform(F.sequence(F.lit(0), F.col("last")), pair))).select(key, "_block", "rep", "_side", *values)
    return cold.unionByName(met), star.where("lead is not null and lead <> rep").select(F.col("lead").alias("a"), F.col("rep").alias("b"))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, "rep")


def _bag(shingles: pa.Array, counts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingles[k].as_py(), "<u8"), np.frombuffer(counts[k].as_py(), "<u4").astype(np.int64)


def _with(rows: DataFrame, values: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """rows with the value of their key, from values (key, value, n rows of that key; total: all rows). Keys of more than a HOTTEST-th of
    all rows, and of 1000 at least, are fewer than HOTTEST; they are broadcast, so that their rows stay where they are."""
    most = max(1000, total // HOTTEST)
    hot = values.where(F.col("n") > most).select(key, F.col(value).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.where("_hot is null").select(*rows.columns).join(values.where(F.col("n") <= most).select(key, F.col(value).alias("_value")), key)
    return marked.where("_hot is not null").select(*rows.columns, F.col("_hot").alias(value)).unionByName(cold.select(*rows.columns, F.col("_value").alias(value)))


def text_hash(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def class_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, h (the text's hash), root (a number of the class; null without a word), class_id (the least
    doc_id of the class), one row for each row of docs that has a doc_id."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    signed = written(docs.mapInArrow(_signed(REGISTERS), "doc_id long, h string, name binary, size long, sig binary"), "signatures")
    # Texts of the same words are one node. Nodes are numbered in the order of their least rows, so a class's least node has its least doc_id.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = signed.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("doc_id", "h")).alias("_r"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    ordered = copies.select(F.col("_r.doc_id").alias("doc_id"), F.col("_r.h").alias("h"), "name", "n", "size", "sig").repartitionByRange(n, "doc_id", "name").sortWithinPartitions("doc_id", "name")
    reps = written(ordered.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.expr("sig").substr(k * width + 1, F.lit(width))))
    meetings = reps.select("rep", F.explode(bands).alias("band"))
    counts = written(meetings.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "meeting-sizes")
    most_and_all = lambda sizes: [x or 0 for x in sizes.agg(F.max("n"), F.sum("n")).first()]
    largest, total = most_and_all(counts)
    met = _with(meetings, counts.withColumn("members", F.col("n")), "band", "members", total).withColumnRenamed("members", "n").join(reps.select("rep", "size", "sig"), "rep").select("band", "n", "rep", "size", "sig")
    least = int(np.floor(REGISTERS * (threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / REGISTERS))))
    signature = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)

    def near_least_signature(own: list[pa.Array], other: list[pa.Array]) -> np.ndarray:
        a, b = own[0].to_numpy(), other[0].to_numpy()
        return (np.minimum(a, b) >= THRESHOLD * np.maximum(a, b) - 1e-9) & ((signature(own[1]) == signature(other[1])).sum(axis=1) >= least)

    def by_signature(group: pa.Table, sides: np.ndarray) -> list[tuple[int, int]]:
        return near_by_signature(signature(group.column(5)), group.column(4).to_numpy(), least, sides)

    rows, links = _starred(met, "band", ["size", "sig"], near_least_signature, "meetings", largest)
    near = _dealt(rows, ["band", "_block"]).mapInArrow(_pairs_of(by_signature, 2, 2), "a long, b long")
    groups = components(near.unionByName(links) if links else near)
    groups = written(groups.select(F.col("id").alias("rep"), F.col("root").alias("grp")), "groups")

    def sized(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(found, "text", 400):
            shingles, counts_, ends, _ = bags(texts_of(part.column(3)))
            cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*part.columns[:3], cut(shingles, "<u8"), cut(counts_, "<u4")], names=["rep", "grp", "n", "shingles", "counts"])

    sizes = written(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    largest, total = most_and_all(sizes)
    wanted = _with(groups, sizes.withColumn("members", F.col("n")), "grp", "members", total).withColumnRenamed("members", "n").join(reps.select("rep", "doc_id", "h"), "rep")
    # One plan at all sizes: the members' number has no bound, so they are never broadcast. A node's text is that of its least row.
    texts = docs.join(wanted.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("rep", "grp", "n", "text")
    full = written(texts.mapInArrow(sized, "rep long, grp long, n long, shingles binary, counts binary"), "bags")

    def near_least_bag(own: list[pa.Array], other: list[pa.Array]) -> np.ndarray:
        return np.array([similarity(_bag(*own, k), _bag(*other, k)) >= threshold - 1e-12 for k in range(len(own[0]))], bool)

    def by_bags(group: pa.Table, sides: np.ndarray) -> list[tuple[int, int]]:
        shingles, counts_ = group.column(4).combine_chunks(), group.column(5).combine_chunks()
        return near_by_bags([_bag(shingles, counts_, k) for k in range(group.num_rows)], threshold, sides)

    rows, links = _starred(full, "grp", ["shingles", "counts"], near_least_bag, "groups", largest)
    pairs = _dealt(rows, ["grp", "_block"]).mapInArrow(_pairs_of(by_bags, 2, 2), "a long, b long")
    roots = written(components(pairs.unionByName(links) if links else pairs).select(F.col("id").alias("rep"), "root"), "roots")
    # The doc_id of each root, dealt to its members.
    members = written(roots.groupBy(F.col("root").alias("rep")).agg(F.count(F.lit(1)).alias("n")).join(reps.select("rep", F.col("doc_id").alias("class_id")), "rep").withColumnRenamed("rep", "root"), "roots-of")
    linked = _with(roots, members, "root", "class_id", members.agg(F.sum("n")).first()[0] or 0)
    of_names = reps.select("rep", "name", "n", "doc_id").join(linked, "rep", "left").select("name", "n", F.struct(F.coalesce("root", "rep").alias("root"), F.coalesce("class_id", "doc_id").alias("class_id")).alias("class"))
    given = signed.select("doc_id", "h", "name")
    found = _with(given.where("name is not null"), of_names, "name", "class", signed.count()).select("doc_id", "h", "class.root", "class.class_id")
    return found.unionByName(given.where("name is null").select("doc_id", "h", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, class_id, one row for each row of docs that has a doc_id."""
    return class_rows(docs, threshold).select("doc_id", "class_id")


def heads(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h): the least row of each class, by doc_id, then the text's hash; and all rows without a word."""
    rows = class_rows(docs, threshold)
    first = rows.where("root is not null and doc_id = class_id").groupBy("root", "doc_id").agg(F.min("h").alias("h")).select("doc_id", "h")
    return first.unionByName(rows.where("root is null").select("doc_id", "h").distinct())
