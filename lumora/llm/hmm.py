"""Hidden Markov language model.

Tokens are words (A-Z lower-cased, split at ASCII white space), then one end. Words have classes, so that the model has
a bounded size for any vocabulary: the TOP most frequent words are classes of their own, all other words share BUCKETS
classes by the crc32 of their bytes, and the end is a class. A state emits a class; a word's share of its class is
(c + 0.5) / (C + 0.5 (V + 1)) by its count c and by the class's counts C of tokens and V of words in training, with one
share more for all unknown words.

1. Documents are gathered in blocks of bounded size that hold each distinct word once (one pass over the texts).
2. The exact counts of all words over the training rows are summed by word, and each block gets those of its words back.
3. Baum-Welch: scaled forward and backward recursions over whole training rows, in batches of rows of like length, with
   expected counts summed across partitions. Words become classes once, in a table that the rounds read. At every size
   WARM_ROUNDS rounds each take another one in SHARE of every block's rows; then ROUNDS rounds take all. Rows longer than CHUNK go by chunks: the forward values at the chunks' edges
   are kept, and the backward pass makes each chunk's own anew, so that memory is bounded and no chain is cut.
4. The scaled forward recursion gives the exact likelihood of each whole text.

Defined results: null text counts as empty, one token (the end). Repeated rows each give a row. Rows whose doc_id is null
count as those whose id is empty text. An empty table gives no row. Without training rows all counts are 0 and the states
are those of the start. Texts of any length are learnt from and scored whole. Words of equal counts are ranked by their
bytes. Words over LONGEST bytes stand by their beginning and their SHA-256 wherever the driver holds words. Other columns than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import Interner, parts, remainder, texts_of, written

#: States, single-word classes, shared classes, and the longest word (bytes) that stands for itself.
STATES, TOP, BUCKETS, LONGEST = 8, 2048, 2048, 64
#: Rounds over all training rows; rounds before, each over one row in SHARE.
ROUNDS, WARM_ROUNDS, SHARE = 2, 6, 16
#: Bytes of text in a block; time steps in a chunk, and tokens in a batch of the recursions and of their input.
BLOCK_BYTES, CHUNK, BATCH, GRID = 8 << 20, 512, 1 << 18, 1 << 21


@dataclass
class Model:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, classes)


def name_of(word: bytes) -> bytes:
    """What stands for a word in a table of classes: itself, or, as words can be as long as texts, its beginning and its hash (no
    shorter word is that long)."""
    return word if len(word) <= LONGEST else word[:LONGEST] + hashlib.sha256(word).digest()


def _name(word: str = "word") -> Column:
    return F.when(F.octet_length(word) <= LONGEST, F.col(word)).otherwise(F.concat(F.substring(word, 1, LONGEST), F.unhex(F.sha2(word, 256))))


def tokens(text: str) -> list[bytes]:
    """The words; bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8").lower().split()


def _packed(index: np.ndarray, width: int = 4) -> bytes:
    """Numbers of `width` bytes as compressed planes of bytes: the high ones, mostly zero, take next to nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(index.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def _unpacked(data: bytes, width: int = 4) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _pack(limit: int):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("lens", pa.binary()), ("index", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        block, ids, held = Interner(limit), [], []

        def flush() -> pa.RecordBatch:
            index, out = block.indexes(), np.array(held, bool)
            training = np.repeat(~out, block.lens)
            counts = np.bincount(index[training], minlength=len(block.index))
            # Frequent words get small numbers, which makes the indexes compress well.
            often = np.bincount(index, minlength=len(block.index))
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            words = list(block.index)
            row = [[part << 32 | number], [ids], [out.tobytes()], [np.array(block.lens, np.int32).tobytes()], [_packed(place[index])], [[words[k] for k in order.tolist()]], [counts[order]]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in parts(found, "text", 500):
            for key, text, out in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                block.add(tokens(text), len(text))
                ids.append(key)
                held.append(out)
                if block.full:
                    yield flush()
                    block.clear()
                    ids, held = [], []
                    number += 1
        if ids:
            yield flush()

    return run


def _batches(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like length together, so that rows times the longest (or a chunk of it) stay within bounds, or one row."""
    order = np.argsort(-lens, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, int(lens[order[at]]))
        n = max(1, min(BATCH // min(longest, CHUNK), GRID // longest))
        yield order[at : at + n]
        at += n


def _grid(seqs: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences (longest first) as columns of one array (time, row), and how many rows last at each time."""
    lens = np.array([len(seqs[r]) for r in rows])
    obs = np.zeros((int(lens.max()), len(rows)), np.int64)
    for k, r in enumerate(rows):
        obs[: lens[k], k] = seqs[r]
    return obs, np.searchsorted(-lens, -np.arange(1, len(obs) + 1), side="right")


def forward(model: Model, obs: np.ndarray, live: np.ndarray, before: np.ndarray | None = None, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log likelihood of each row, and the last scaled forward values (state, row) of rows that last to the end. before: the
    values before the first step, of a chunk that isn't the first. keep: gets all values, their scales, and what each step emits
    (state, time, row), so that each step works on whole lines of rows."""
    emit, onward = model.emit, np.ascontiguousarray(model.move.T)
    logs, a, size = np.zeros(obs.shape[1]), before, max(1, len(obs) if keep is not None else CHUNK)
    for lo in range(0, len(obs), size):
        part, n = obs[lo : lo + size], int(live[lo])
        emitted, scales = emit.take(part[:, :n], axis=1), np.ones((len(part), n), emit.dtype)
        alphas = np.zeros_like(emitted) if keep is not None else None
        for t in range(len(part)):
            n = int(live[lo + t])
            out = None if alphas is None else alphas[:, t, :n]
            a = np.multiply(model.start[:, None] if a is None else onward @ a[:, :n], emitted[:, t, :n], out=out)
            a /= np.add.reduce(a, axis=0, out=scales[t, :n])
        logs[: scales.shape[1]] += np.log(scales).sum(axis=0, dtype=np.float64)
        if keep is not None:
            keep["emitted"], keep["alphas"], keep["scales"] = emitted, alphas, scales
    return logs, a


def _backward(model: Model, live: np.ndarray, kept: dict, after: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Turns a chunk's forward values into the states' probabilities at each step, adds to moves, and gives what the step before
    the chunk needs. after: the same, of the chunk behind."""
    alphas, emitted = kept["alphas"], kept["emitted"]
    emitted /= kept["scales"]
    behind, m = np.ones_like(alphas), after.shape[1]
    moves += alphas[:, -1, :m] @ after.T
    for t in range(alphas.shape[1] - 1, -1, -1):
        n, b = int(live[t]), emitted[:, t]
        if m:
            b[:, :m] *= np.matmul(model.move, after, out=behind[:, t, :m])
        b[:, n:] = 0
        after, m = b[:, :n], n
    states = len(alphas)
    moves += alphas[:, :-1].reshape(states, -1) @ emitted[:, 1:].reshape(states, -1).T
    alphas *= behind
    return after


def expected(model: Model, obs: np.ndarray, live: np.ndarray, chunk: int = CHUNK, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions of a batch, and its log likelihood. Values within a chunk are of the given
    kind; sums are double."""
    states, size = model.emit.shape
    own = Model(*(x.astype(kind) for x in (model.start, model.move, model.emit)))
    cuts = [(lo, min(lo + chunk, len(obs))) for lo in range(0, len(obs), chunk)]
    edges: list[np.ndarray | None] = [None]
    for lo, hi in cuts[:-1]:
        edges.append(forward(own, obs[lo:hi, : int(live[lo])], live[lo:hi], edges[-1])[1])
    logs, moves, emits, after = 0.0, np.zeros((states, states)), np.zeros((states, size)), np.zeros((states, 0), kind)
    for (lo, hi), edge in zip(reversed(cuts), reversed(edges), strict=True):
        # Rows that end in an earlier chunk are no part of this one.
        part, n, kept = obs[lo:hi, : int(live[lo])], live[lo:hi], {}
        logs += float(forward(own, part, n, edge, kept)[0].sum())
        after = _backward(own, n, kept, after, moves)
        flat = part.ravel()
        emits += np.stack([np.bincount(flat, kept["alphas"][s].ravel(), size) for s in range(states)])
    return kept["alphas"][:, 0].sum(axis=1, dtype=np.float64), moves * model.move, emits, logs


def updated(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray) -> Model:
    """The next model from expected counts; emissions are smoothed towards the classes' shares."""
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    return Model(share(start + 1), share(moves + 1), share(emits + 20 * base))


def first_model(base: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = base * rng.gamma(2.0, 0.5, (states, len(base)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


class Classes:
    """Numbers of words' classes: single words first, then the shared ones, then the end."""

    def __init__(self, top: list[bytes], buckets: int = BUCKETS):
        self.single, self.buckets = {w: k for k, w in enumerate(top)}, buckets
        self.names, self.long = pa.array(top, pa.binary()), any(len(w) > LONGEST for w in top)
        self.end, self.size = len(top) + buckets, len(top) + buckets + 1

    def of(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """The classes of words, and of the end."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        n, crc = len(self.single), zlib.crc32
        out = np.full(len(words) + 1, self.end, np.int64)
        out[:-1] = pc.fill_null(pc.index_in(words, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        if self.long:
            for k in np.flatnonzero(pc.greater(pc.binary_length(words), LONGEST).to_numpy(zero_copy_only=False)).tolist():
                out[k] = self.single.get(name_of(words[k].as_py()), -1)
        shared = np.flatnonzero(out < 0)
        out[shared] = [n + crc(w) % self.buckets for w in words.take(pa.array(shared)).to_pylist()]
        return out


def _sequences(index: np.ndarray, lens: np.ndarray, classes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows' tokens as classes, each with its end."""
    at = np.concatenate([[0], np.cumsum(lens)])
    return [np.append(classes[index[at[r] : at[r + 1]]], classes[-1]) for r in rows]


def in_round(rows: np.ndarray, block: int, turn: int | None) -> np.ndarray:
    """The rows of a block that a round learns from: all, or, in the rounds before, one in SHARE, counted from another row in each
    block."""
    return rows if turn is None else rows[(rows + block + (block >> 32)) % SHARE == turn % SHARE]


def _classed(classes: Classes):
    """Blocks to the rows of each turn: their ids, and the training rows' tokens as classes, each row with its end."""
    schema = pa.schema([("turn", pa.int32()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("seqs", pa.binary())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for k in range(batch.num_rows):
                ids, block = batch.column(1)[k].values, batch.column(0)[k].as_py()
                held, lens = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in ((2, bool), (3, np.int32)))
                index, number = _unpacked(batch.column(4)[k].as_py()), classes.of(batch.column(5)[k].values)
                out = []
                for turn in range(SHARE):
                    rows = in_round(np.arange(len(lens)), block, turn)
                    seqs = _sequences(index, lens, number, rows[~held[rows]])
                    if len(rows):
                        flat = np.concatenate([np.zeros(0, np.int64), *seqs])
                        out.append((turn, ids.take(pa.array(rows)).to_pylist(), np.array([len(s) for s in seqs], np.int32).tobytes(), _packed(flat, 2)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _statistics(model: Model):
    states, size = model.emit.shape
    schema = pa.schema([("number", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emits, logs = np.zeros(states), np.zeros((states, states)), np.zeros((states, size)), 0.0
        seqs, size_now = [], 0

        def learn() -> None:
            nonlocal start, moves, emits, logs, seqs, size_now
            for rows in _batches(np.array([len(s) for s in seqs], np.int64)):
                a, b, c, d = expected(model, *_grid(seqs, rows))
                start, moves, emits, logs = start + a, moves + b, emits + c, logs + d
            seqs, size_now = [], 0

        for batch in found:
            for k in range(batch.num_rows):
                lens = np.frombuffer(batch.column(0)[k].as_py(), np.int32)
                flat = _unpacked(batch.column(1)[k].as_py(), 2)
                # Shares of blocks are put together, so that the recursions' batches are full.
                seqs += np.split(flat, np.cumsum(lens)[:-1]) if len(lens) else []
                size_now += len(flat)
                if size_now >= GRID // 2:
                    learn()
        learn()
        # One row for each state, so that sums come together in more places than one.
        rows = [np.concatenate([[logs if s == 0 else 0.0, start[s]], moves[s], emits[s]]) for s in range(states)]
        yield pa.RecordBatch.from_arrays([pa.array(range(states), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], schema=schema)

    return run


def _added(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in found:
        for k in range(batch.num_rows):
            number, sums = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy()
            total[number] = total[number] + sums if number in total else sums.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["number", "sums"])


def train_round(shares: DataFrame, model: Model, base: np.ndarray) -> tuple[Model, float]:
    """One round of Baum-Welch over shares of blocks (lens, seqs); the sums of a partition are one row for each state. Shares
    without a training row leave the model as it is."""
    states = len(model.start)
    schema = "number int, sums array<double>"
    sums = shares.select("lens", "seqs").mapInArrow(_statistics(model), schema)
    # Two levels, so that no task reads every partition's sums of a state unless there are few.
    some = sums.withColumn("part", F.spark_partition_id() % 16).repartition(16 * states, "number", "part").select("number", "sums").mapInArrow(_added, schema)
    got = some.repartition(states, "number").mapInArrow(_added, schema).collect()
    rows = {r["number"]: np.array(r["sums"]) for r in got}
    table = np.stack([rows[s] for s in range(states)])
    if not table[:, 1].any():
        return model, 0.0
    return updated(table[:, 1], table[:, 2 : 2 + states], table[:, 2 + states :], base), float(table[0, 0])


def _scored(model: Model, classes: Classes, class_tokens: np.ndarray, class_words: np.ndarray, total: int, distinct: int, end_count: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].values
                held, lens = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in ((1, bool), (2, np.int32)))
                index = _unpacked(batch.column(3)[k].as_py())
                at = batch.column(4)[k].values
                places = np.zeros(0, np.int64) if at is None else at.to_numpy()
                counts, number = np.zeros(len(places) + 1, np.int64), np.full(len(places) + 1, classes.end, np.int64)
                if len(places):
                    counts[places], number[places] = batch.column(5)[k].values.to_numpy(), batch.column(6)[k].values.to_numpy()
                counts[-1] = end_count
                base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
                # Share of its class; classes of one word hold nothing else.
                inside = np.where((number >= len(classes.single)) & (number != classes.end), np.log10((counts + 0.5) / (class_tokens[number] + 0.5 * (class_words[number] + 1))), 0.0)
                known = (counts > 0).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(lens)])
                over = np.concatenate([[0], np.cumsum(known[index])])
                add = lambda x: np.array([x[index[a:b]].sum() for a, b in zip(edge, edge[1:], strict=False)]) + x[-1]  # noqa: E731, B023
                seqs = _sequences(index, lens, number, np.arange(len(lens)))
                score = np.zeros(len(lens))
                for rows in _batches(lens.astype(np.int64) + 1):
                    score[rows] = forward(model, *_grid(seqs, rows))[0] / np.log(10)  # keeps no values, so rows of any length do
                n_known = over[edge[1:]] - over[edge[:-1]] + known[-1]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(lens.astype(np.int64) + 1), pa.array(n_known), pa.array(np.full(len(lens), total)), pa.array(add(base)), pa.array(score + add(inside))], schema=schema)

    return run


def score_documents(docs: DataFrame, fold: int = 1) -> DataFrame:
    """Trains on rows whose remainder isn't `fold` and scores all. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (the words' own likelihood) and score (the model's), both log10."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder() == fold).alias("held"))
    blocks = written(rows.mapInArrow(_pack(BLOCK_BYTES), "block long, ids array<long>, held binary, lens binary, index binary, words array<binary>, counts array<long>"), "blocks")
    by_word = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counts = written(by_word.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = rows.where(~F.col("held")).count()
    total, distinct = int(totals[0] or 0) + ends, int(totals[1]) + (ends > 0)
    top = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(TOP).select(_name().alias("word"), "c").collect()}
    classes = Classes(sorted(top), BUCKETS)
    # Counts by shared class: at most BUCKETS rows.
    singles = spark.createDataFrame([(w,) for w in top], "name binary")
    shared = counts.withColumn("name", _name()).join(F.broadcast(singles), "name", "left_anti").groupBy((F.crc32("word") % BUCKETS).cast("int").alias("bucket")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    class_tokens, class_words = np.zeros(classes.size), np.zeros(classes.size)
    for r in shared:
        class_tokens[len(top) + r["bucket"]], class_words[len(top) + r["bucket"]] = r["c"], r["v"]
    shares = class_tokens.copy()
    for w, k in classes.single.items():
        shares[k] = top[w]
    shares[classes.end] = ends
    base = (shares + 0.5) / (shares + 0.5).sum()
    model = first_model(base)
    shares = written(blocks.select("block", "ids", "held", "lens", "index", "words").mapInArrow(_classed(classes), "turn int, ids array<long>, lens binary, seqs binary"), "shares")
    for k in range(WARM_ROUNDS if ends else 0):
        model, _ = train_round(shares.where(F.col("turn") == k % SHARE), model, base)
    for _ in range(ROUNDS if ends else 0):
        model, _ = train_round(shares, model, base)
    # Each block gets its words' counts and classes back; the words themselves stay behind.
    # TOP words' counts are broadcast, so that only rarer words meet theirs by a shuffle.
    single = spark.createDataFrame([(w, k, top[w]) for w, k in classes.single.items()], "name binary, single int, often long")
    marked = by_word.select("block", "at", "word", _name().alias("name")).join(F.broadcast(single), "name", "left").drop("name")
    frequent = marked.where("single is not null").select("block", F.struct("at", F.col("often").alias("c"), F.col("single").alias("cls")).alias("x"))
    shared_cls = (F.lit(len(top)) + F.crc32("word") % BUCKETS).cast("int")
    rare = marked.where("single is null").join(counts, "word", "left").select("block", F.struct("at", F.coalesce("c", F.lit(0)).alias("c"), shared_cls.alias("cls")).alias("x"))
    known = frequent.unionByName(rare).groupBy("block").agg(F.collect_list("x").alias("x"))
    part = lambda field, kind: F.coalesce(F.col(f"x.{field}"), F.array().cast(kind)).alias(field)
    whole = blocks.select("block", "ids", "held", "lens", "index").join(known, "block", "left").select("ids", "held", "lens", "index", part("at", "array<int>"), part("c", "array<long>"), part("cls", "array<int>"))
    return whole.mapInArrow(_scored(model, classes, class_tokens, class_words, total, distinct, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
