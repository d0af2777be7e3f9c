"""Byte-level BPE.

Encoding has three narrow steps and no shuffle:

1. Each task splits its documents by the pattern and gathers blocks of bounded size; a block holds its distinct words
   once, each as an array of bytes with the ranks of the merges that it could take, and every document as indexes
   into them. An automaton finds the tokens that stand in a word.
2. Spark's higher-order functions fold those ranked merges over the bytes of every distinct word. The rank map is a literal:
   arrays that hold, at a rank, the pair that merges and the token that it makes. The fold's state is one character a token,
   so that a merge, which joins its pair wherever it stands, from the left, is a native replacement.
3. The documents' ids are put together from the words' ids. Decoding concatenates binary pieces: the ids' in a word, and
   then the words' in a document.

One pass in the order of ranks is the whole algorithm: the halves of a token have lower ranks than the token, so a
merge never makes a pair of a lower rank, and all places of a pair merge in one step, from the left.

Defined results: null text counts as empty; an empty text has no ids; repeated rows each give a row; other columns
than the two named are ignored, whatever their names; an empty table gives no row. Equal texts give equal ids. Text is
split whole, whatever its length.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumora.llm.common import Interner, gather, texts_of

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Words in either generation of a worker's memory, and the longest word that it remembers.
REMEMBERED, LONGEST = 50_000, 64
#: A token is held as one character: its rank above FIRST, or above HIGH where that would meet the surrogates.
FIRST, LAST, HIGH = 0x100, 0xD800, 0x10000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def char_of(rank: int) -> str:
    return chr(FIRST + rank) if FIRST + rank < LAST else chr(HIGH + rank)


def ranks_of(chars: str) -> np.ndarray:
    """The ranks of characters made by char_of."""
    codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(codes < LAST, codes - FIRST, codes - HIGH)


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that merge into this one; None if no merge makes it."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(found)
        if rank >= limit:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Merges:
    """A rank file's merges, as what the literals hold, and each merged token's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.pairs, self.made, self.tokens = [""] * size, [""] * size, [b""] * size
        ranked: dict[str, int] = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            if len(token) > 1 and (pair := halves(token, ranks)):
                ranked[token.decode("latin-1")] = rank
                self.pairs[rank] = char_of(ranks[pair[0]]) + char_of(ranks[pair[1]])
                self.made[rank] = char_of(rank)
        there = [b for b in range(256) if bytes([b]) in ranks]
        self.bytes, self.first = "".join(map(chr, there)), "".join(char_of(ranks[bytes([b])]) for b in there)
        self.finder = Finder(ranked)


class Finder:
    """Finds the ranks of the merges that words could take: those of the tokens that stand in them."""

    def __init__(self, ranked: dict[str, int]):
        self.ranked, self.key = ranked, hash(frozenset(ranked.items()))

    def ready(self) -> Finder:
        """This, or the equal one that the worker has from an earlier task, with its automaton and memory."""
        import ahocorasick

        if (got := _ready.get(self.key)) is None or got.ranked != self.ranked:
            self.old: dict[str, list[int]] = {}
            self.memory: dict[str, list[int]] = {}
            self.automaton = ahocorasick.Automaton()
            for token, rank in self.ranked.items():
                self.automaton.add_word(token, rank)
            if self.ranked:
                self.automaton.make_automaton()
            got = _ready[self.key] = self
        return got

    def __call__(self, word: str, data: bytes) -> list[int]:
        if (got := self.memory.get(word)) is None:
            if (got := self.old.get(word)) is None:
                got = sorted({rank for _, rank in self.automaton.iter(data.decode("latin-1"))}) if self.ranked else []
            if len(word) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.old, self.memory = self.memory, {}
                self.memory[word] = got
        return got


_ready: dict[int, Finder] = {}


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def folded(words: Column, merges: Column, literals: Merges) -> Column:
    """Words (arrays of bytes) as their tokens' characters: each word's ranked merges, folded over its bytes."""
    pairs, made = _literal(literals.pairs, "array<string>"), _literal(literals.made, "array<string>")
    start = lambda word: F.translate(F.decode(word, "ISO-8859-1"), literals.bytes, literals.first)
    return F.zip_with(words, merges, lambda word, ranks: F.aggregate(ranks, start(word), lambda s, r: F.replace(s, F.get(pairs, r), F.get(made, r))))


class Splitter:
    """Finds a pattern's matches. The standard library's matcher is several times as fast as the one that knows Unicode
    properties, so properties are written out as ranges for it; texts with characters beyond the first plane, whose ranges
    it would search one by one, go to the other."""

    def __init__(self, pattern: str):
        import regex

        # The rank files' library reads \\s as Unicode white space, which holds no separators U+001C to U+001F.
        full = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.full = regex.compile(full).findall
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

        def ranges(m: re.Match) -> str:
            runs = regex.findall(r"\p{%s}+" % m[2], plane)
            cuts = [(r[0], r[-1]) for run in runs for r in self._runs(run)]
            inside = "".join(f"\\u{ord(a):04x}-\\u{ord(b):04x}" for a, b in cuts)
            return inside if m[1] == "p" and _in_class(full, m.start()) else f"[{'^' * (m[1] == 'P')}{inside}]"

        self.quick = re.compile(re.sub(r"\\([pP])\{(\w+)\}", ranges, full)).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    @staticmethod
    def _runs(text: str) -> Iterator[str]:
        """Stretches of neighbouring code points."""
        at = 0
        for k in range(1, len(text) + 1):
            if k == len(text) or ord(text[k]) != ord(text[k - 1]) + 1:
                yield text[at:k]
                at = k

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.beyond(text) else self.quick(text)


def _in_class(pattern: str, at: int) -> bool:
    """Whether a place of a pattern is between brackets."""
    return pattern.rfind("[", 0, at) > pattern.rfind("]", 0, at)


def _pack(pattern: str, finder: Finder, id_type: pa.DataType, limit: int):
    schema = pa.schema([("ids", pa.list_(id_type)), ("lens", pa.binary()), ("index", pa.binary()), ("words", pa.list_(pa.binary())), ("merges", pa.list_(pa.list_(pa.int32())))])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks_in, block, ids = Splitter(pattern), finder.ready(), Interner(limit), []

        def flush() -> pa.RecordBatch:
            words, flat, ends = [], [], [0]
            for word in block.index:
                words.append(word.encode())
                flat += ranks_in(word, words[-1])
                ends.append(len(flat))
            merges = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            row = [ids], [np.array(block.lens, np.int32).tobytes()], [block.indexes().tobytes()], [words]
            columns = [pa.array(c, f.type) for c, f in zip(row, schema, strict=False)]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), merges)], schema=schema)

        for batch in found:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                block.add(find(text), len(text))
                ids.append(key)
                if block.full:
                    yield flush()
                    block.clear()
                    ids = []
        if ids:
            yield flush()

    return run


def decode(ids: Iterable[int], tokens: list[bytes]) -> bytes:
    """The bytes of ids: their pieces, one after another."""
    return b"".join(map(tokens.__getitem__, ids))


def _assemble(schema: pa.Schema, tokens: list[bytes]):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for k in range(batch.num_rows):
                keys = batch.column(0)[k].values
                lens = np.frombuffer(batch.column(1)[k].as_py(), np.int32)
                index = np.frombuffer(batch.column(2)[k].as_py(), np.int32)
                words = batch.column(3)[k].as_py()
                at = np.concatenate([[0], np.cumsum(lens)])
                w_ids = ranks_of("".join(words))
                w_off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                flat, ends = w_ids.tolist(), w_off.tolist()
                pieces = [decode(flat[a:b], tokens) for a, b in zip(ends, ends[1:], strict=False)]
                for lo in range(0, len(lens), 256):
                    hi = min(lo + 256, len(lens))
                    coded, decoded = [], []
                    for d in range(lo, hi):
                        own = index[at[d] : at[d + 1]]
                        coded.append(gather(w_ids, w_off, own)[0].astype("<u4").tobytes())
                        decoded.append(decode(own.tolist(), pieces))
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(coded, pa.binary()), pa.array(decoded, pa.binary())], schema=schema)

    return run


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns key, ids (little-endian unsigned 32-bit integers, as binary) and decoded (the bytes of those ids)."""
    key_type = df.schema[key].dataType
    arrow = to_arrow_type(key_type)
    merges = Merges(ranks)
    blocks = T.StructType([T.StructField("ids", T.ArrayType(key_type)), T.StructField("lens", T.BinaryType()), T.StructField("index", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("merges", T.ArrayType(T.ArrayType(T.IntegerType())))])
    packed = df.select(key, text).mapInArrow(_pack(pattern, merges.finder, arrow, block_bytes), blocks)
    coded = packed.select("ids", "lens", "index", folded(F.col("words"), F.col("merges"), merges).alias("words"))
    out = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return coded.mapInArrow(_assemble(pa.schema([(key, arrow), ("ids", pa.binary()), ("decoded", pa.binary())]), merges.tokens), out)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of encode()'s result."""
    return coded.select(
        key,
        F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
