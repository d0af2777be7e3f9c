"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised and cut into pieces of at most SIZE tokens. Only the histogram of piece lengths, which has SIZE
numbers at any size of input, goes to the driver:

1. Patterns of one to three lengths that fill a sequence exactly are enumerated, and non-negative least squares fits how
   often each is used to the histogram. The fit is rounded down, and never takes more pieces than there are.
2. What is left of the histogram is packed by best fit: the longest length left, then the longest that still
   fits, and so on; such a pattern is repeated as often as its lengths allow.

Both give patterns with repeat counts, which together use each piece exactly once. A piece's rank among the pieces of its
length (counted within shards, then shifted by the shards before) tells its sequence and its place.

Defined results: null text counts as empty, a piece of one token (the end). Repeated rows are documents of their own.
An empty table packs into nothing. Which of equal pieces goes where is settled by doc_id, piece and crc32. Texts are
tokenised whole, whatever their length; special tokens' strings in a text give their ids, as in the tokeniser's own call.
Other columns than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lumora.llm.common import parts, texts_of, written

#: Tokens in a sequence, and the id that ends a document.
SIZE, END = 2048, 0
#: Words, and parts of words, in either generation of a worker's memory, and the longest (bytes) that it remembers: some 150 MB in all.
REMEMBERED, PARTS, LONGEST = 300_000, 200_000, 64
#: Least pieces in a shard on average, and most shards of one length.
SHARD, SHARDS = 128, 2000

Pattern = tuple[tuple[int, ...], int]


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Tokenizer(dict):
    """The ids of words (bytes without ASCII white space) as bytes, little-endian, 32 bits.

    The tokeniser drops white space and never joins tokens across it, so a text's ids are those of its words, one
    after another; words that hold a special token's string take the whole tokeniser, which gives the special id. If
    the file has the usual steps (NFC, lower case, split by a pattern, bytes), a word that these steps change only in
    case goes straight to the merges, piece by piece; any other word, and any other file, takes the whole tokeniser.

    Memory is bounded: short words are remembered in two generations of REMEMBERED. When the young one is full it becomes
    the old one, whose words come back when they are met again, so frequent words stay.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer as Load

        super().__init__()
        self.of = Load.from_file(path)
        steps = json.loads(self.of.to_str())
        self.special = [t["content"].lower() for t in steps["added_tokens"]]
        self.first = re.compile("[" + re.escape("".join({t[0] for t in self.special})) + "]").search if self.special else lambda text: None
        # A special token with a blank in it would be torn by words: then texts take the whole tokeniser.
        self.by_words = not any(set(t) & set(" \t\n\r\v\f") for t in self.special)
        normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.find = None
        if normal == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["invert"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"]:
            self.find = regex.compile(split[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.chars, self.merge = _byte_chars(), self.of.model.tokenize
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _merged(self, part: str) -> bytes:
        found = self.merge(part if part.isascii() and part.isprintable() else part.encode("utf-8").decode("latin-1").translate(self.chars))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _part(self, part: str) -> bytes:
        if (ids := self.old_parts.get(part)) is None:
            ids = self._merged(part)
        if len(part) <= LONGEST:
            if len(self.parts) >= PARTS:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            text = word.decode("utf-8")
            low = text.lower()
            # Lower case depends on the place in a word for one letter only, capital sigma.
            plain = self.find and (text.isascii() or (unicodedata.is_normalized("NFC", text) and "\u03a3" not in text))
            if plain and not (self.first(low) and any(t in low for t in self.special)):
                parts = self.find(low)
                if len(parts) == 1 and parts[0] == low:
                    # The word is its one part, and is remembered as such.
                    ids = self._merged(low)
                else:
                    ids = b"".join([self.parts.get(part) or self._part(part) for part in parts])
            else:
                found = self.of.encode(text, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.by_words:
            return b"".join(map(self.__getitem__, text.encode("utf-8").split())) + END.to_bytes(4, "little")
        found = self.of.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found) + 1}I", *found, END)


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    """One for each worker, kept over its tasks."""
    return _loaded.get(path) or _loaded.setdefault(path, Tokenizer(path))


def pieces(docs: DataFrame, path: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; with keep_ids also ids (binary)."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)
    arrow = to_arrow_schema(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(path)
        for batch in parts(found, "text", 500):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), map(tokens.ids, texts_of(batch.column(1))), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] * keep_ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def enumerate_patterns(histogram: np.ndarray, size: int = SIZE, choices: int = 12) -> list[tuple[int, ...]]:
    """Patterns of one, two or three lengths that there are pieces of, and that fill a sequence exactly. For each longest
    length, the middle one of a triple takes `choices` values, spread over the pieces."""
    there = np.flatnonzero(histogram)
    has = np.zeros(size + 1, bool)
    has[there] = True
    found = {(size,)} if has[size] else set()
    found |= {(size - a, a) for a in there.tolist() if a <= size - a and a and has[size - a]}
    for a in there.tolist():
        room = size - a
        fit = there[(there <= a) & (there < room) & (2 * there >= room)]
        fit = fit[has[room - fit]] if len(fit) else fit
        if len(fit):
            spread = np.unique(np.searchsorted(np.cumsum(histogram[fit]), np.linspace(0, histogram[fit].sum(), choices, endpoint=False), side="right"))
            found |= {(a, int(b), room - int(b)) for b in fit[np.minimum(spread, len(fit) - 1)]}
    return sorted(found, reverse=True)


def fit_counts(histogram: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the patterns' uses against the histogram, by accelerated projected gradients.
    Each length's misfit is weighted by its tokens' root, so that long pieces, which are hard to place, fit first."""
    if not patterns:
        return np.zeros(0)
    rows = np.array([x for p in patterns for x in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    weight = np.sqrt(np.arange(len(histogram)) / len(histogram))
    apply = lambda x: np.bincount(rows, x[cols], len(histogram)) * weight
    back = lambda r: np.bincount(cols, (r * weight)[rows], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(apply(v))
        v /= np.linalg.norm(v) + 1e-300
    rate = 1 / (1.05 * np.linalg.norm(back(apply(v))) + 1e-12)
    x = y = np.zeros(len(patterns))
    t, goal = 1.0, histogram * weight
    for _ in range(rounds):
        new = np.maximum(0, y - rate * back(apply(y) - goal))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: np.ndarray, size: int = SIZE) -> list[Pattern]:
    """Patterns with repeat counts that use every piece of the histogram (by length, 0 to size) exactly once."""
    left = histogram.astype(np.int64).copy()
    out: list[Pattern] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min([times, *(int(left[x]) // n for x, n in need.items())])
        if times > 0:
            for x, n in need.items():
                left[x] -= times * n
            out.append((pattern, times))

    found = enumerate_patterns(left, size)
    uses = fit_counts(left, found)
    for k in np.argsort(-uses, kind="stable"):
        if uses[k] >= 1:
            take(found[k], int(uses[k]))
    while (there := np.flatnonzero(left)).size:
        longest = int(there[-1])
        pattern, room, used = [longest], size - longest, {longest: 1}
        for x in there[::-1].tolist():
            if x and x <= room:
                n = min(int(left[x]) - used.get(x, 0), room // x)
                if n > 0:
                    pattern += [x] * n
                    used[x] = used.get(x, 0) + n
                    room -= n * x
        take(tuple(pattern), int(left[longest]))
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, length, ids_crc32)."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    # Each length is dealt over shards by its own count, so that no length is one task's work.
    sizes = {length: max(SHARD, -(-n // SHARDS)) for length, n in counts.items()}
    shards = spark.createDataFrame([(length, -(-n // sizes[length])) for length, n in counts.items()], "length long, _shards long")
    sharded = cut.join(F.broadcast(shards), "length").withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_shards")).cast("int"))
    before = sharded.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        sharded.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32")))
        .join(before.select("length", "_shard", "_before"), ["length", "_shard"])
        .withColumn("_rank", F.col("_row") - 1 + F.coalesce("_before", F.lit(0)))
    )
    # Where each pattern's places take their pieces: of `length`, ranks from `first` on, `times` of them, as many to a sequence.
    slots, taken, sequence = [], np.zeros(size + 1, np.int64), 0
    for pattern, times in plan(histogram, size):
        offset = 0
        for length in pattern:
            slots.append((length, int(taken[length]), int(taken[length]) + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *slot in slots:
        by_length.setdefault(length, []).append(tuple(slot))
    rows = [(length, sorted(found)) for length, found in by_length.items()]
    table = spark.createDataFrame(rows, "length long, _slots array<struct<first:long,stop:long,sequence:long,offset:long>>")
    slot = F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["stop"])).getItem(0)
    return (
        ranked.join(F.broadcast(table), "length")
        .withColumn("_slot", slot)
        .withColumn("sequence_id", F.col("_slot.sequence") + F.col("_rank") - F.col("_slot.first"))
        .withColumn("offset", F.col("_slot.offset"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Tokenises, cuts and packs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, path, size), "pieces"), size)
