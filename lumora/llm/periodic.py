"""Periodic runs of words, and texts with the repetitions taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of at least
max(SHORTEST, 2 * q), which no neighbouring word extends keeping that period. For each text:

1. Lag counting. For every lag p up to half the length, the number of places whose word comes again p later. Frequent words
   (heavy: more than a bound that grows with the root of the length) are counted by exact FFT autocorrelation of their
   indicators, all lags at once; rare words (light) by the differences of their pairs of places.
2. A run of period p has at least max(SHORTEST - p, p) places in a row that match p later. Only lags with that many matches
   go on, in ascending order.
3. Island scan. Places in a row that match are an island; with its lag it is a stretch of that period. A sparse sample of
   places goes first, which rules most lags out. Matches that lie all within runs found already, whose period divides
   the lag, need no scan: their islands are put together from those runs. A stretch that a smaller period had is the same run.

A text's work stays in its row, and no row meets another: nothing is shuffled, and equal texts cost no one task more.
Memory is in proportion to one text; batches are closed by bytes.

Defined results: null, empty and blank texts have no words and no run. Words are split at [\\x20\\x09-\\x0D] only and compared
byte by byte. Repeated rows give equal rows; a null key stays; an empty table gives no row. Of the input only the two columns named
are read, so that others may have any name. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumora.llm.common import parts

SHORTEST = 12
#: A word is heavy if it comes more often than this, or than the root of the text's length.
HEAVY = 16
#: Numbers that the indicators of heavy words fill at once.
CELLS = 1 << 21
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def lag_matches(codes: np.ndarray, top: int) -> np.ndarray:
    """For lags 0 to top, how many places hold the word that comes again so much later; lag 0 counts as 0."""
    n = len(codes)
    often = np.bincount(codes)
    heavy = often > max(HEAVY, int(np.sqrt(n)))
    light = np.flatnonzero(((often > 1) & ~heavy)[codes])
    place = light[np.argsort(codes[light], kind="stable")]
    word, found = codes[place], []
    for j in range(1, int(often[word].max(initial=1))):
        same = word[j:] == word[:-j]
        d = (place[j:] - place[:-j])[same]
        found.append(d[d <= top])
    out = np.bincount(np.concatenate(found), minlength=top + 1) if found else np.zeros(top + 1, np.int64)
    words = np.flatnonzero(heavy)
    if len(words):
        wide = 1 << int(n + top).bit_length()  # no lag up to top wraps around
        power, step = 0.0, max(1, CELLS // wide)
        for lo in range(0, len(words), step):
            marks = np.zeros((len(words[lo : lo + step]), wide))
            marks[:, :n] = codes[None, :] == words[lo : lo + step, None]
            f = np.fft.rfft(marks)
            power = power + (f.real**2 + f.imag**2).sum(axis=0)
        out = out + np.rint(np.fft.irfft(power, wide)[: top + 1]).astype(np.int64)
    out[0] = 0
    return out


def _streaks(match: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and length of the stretches of at least `least` true values in a row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], match.view(np.int8), [0]])))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    keep = size >= least
    return list(zip(begin[keep].tolist(), size[keep].tolist(), strict=True))


def _scanned(codes: np.ndarray, p: int, least: int) -> list[tuple[int, int]]:
    """Islands of lag p with at least `least` places."""
    step = least // 8
    if step > 1:  # an island holds least // step sampled places in a row
        first = codes[: len(codes) - p : step]
        if not _streaks(first == codes[p::step][: len(first)], least // step):
            return []
    return _streaks(codes[:-p] == codes[p:], least)


def _explained(by_period: dict[int, list[tuple[int, int]]], p: int) -> tuple[list[tuple[int, int]], int]:
    """The places that match at lag p within the runs whose period divides p, as disjoint islands, and how many they are."""
    spans = sorted((a, a + size - p) for q, runs in by_period.items() if p % q == 0 for a, size in runs if size > p)
    islands: list[list[int]] = []
    for a, b in spans:
        if islands and a <= islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    return [(a, b - a) for a, b in islands], sum(b - a for a, b in islands)


def find_runs(codes: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's word numbers, by start, then period."""
    n, top = len(codes), len(codes) // 2
    if n < shortest or top < 1:
        return []
    lags = np.arange(top + 1)
    need = np.maximum(shortest - lags, np.maximum(lags, 1))
    matches = lag_matches(codes, top)
    seen: set[tuple[int, int]] = set()
    by_period: dict[int, list[tuple[int, int]]] = {}
    out = []
    for p in np.flatnonzero(matches >= need).tolist():
        least = int(need[p])
        islands, known = _explained(by_period, p) if by_period else ([], 0)
        if known < matches[p]:
            islands = _scanned(codes, p, least)
        for a, m in islands:
            if m >= least and (a, m + p) not in seen:
                seen.add((a, m + p))
                by_period.setdefault(p, []).append((a, m + p))
                out.append((a, m + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def analysed(text: bytes, shortest: int = SHORTEST) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """A text's number of words, its runs, and the words that stay, joined by one space."""
    words = text.split()
    index: dict[bytes, int] = {}
    put = index.setdefault
    runs = find_runs(np.fromiter([put(w, len(index)) for w in words], np.int64, len(words)), shortest)
    if runs:
        return len(words), runs, b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()])
    return len(words), runs, b" ".join(words)


def runs(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Per row: key, n_words, runs (array of start, length, period, by start, then period), collapsed (the text without repetitions)."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)
    run_type = arrow.field("runs").type

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "_text"):
            got = [analysed(t or b"", shortest) for t in batch.column(1).to_pylist()]
            listed = [[{"start": a, "length": m, "period": p} for a, m, p in g[1]] for g in got]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(listed, run_type), pa.array([g[2] for g in got], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(key, F.encode(text, "UTF-8").alias("_text")).mapInArrow(run, schema)


def with_planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text; of the n words of a row with crc32(doc_id) % 10 = 0, each word i from a on becomes word a + (i - a) % p, where
    g = crc32 // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8). A row without an id has the CRC of empty text."""
    n, a, p, g = (F.col(c) for c in ("_n", "_a", "_p", "_g"))
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    words = F.when(crc % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = df.select(doc_id, text, words.alias("_words"), F.floor(crc / 10).alias("_g")).withColumn("_n", F.greatest(F.coalesce(F.size("_words"), F.lit(0)), F.lit(0)))
    rows = rows.withColumn("_a", F.when(n > 0, g % n).cast("int")).withColumn("_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    cycle = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    words = F.slice(F.concat(F.slice("_words", F.lit(1), a), cycle), F.lit(1), n)
    return rows.select(doc_id, F.when(n > 0, F.array_join(words, " ")).otherwise(F.col(text)).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of runs()'s result."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("less_start"), (-r["period"]).alias("less_period")))).alias("_best")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select(key, F.size("runs").cast("long").alias("n_runs"), best, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, start, period = F.col("_best.length"), -F.col("_best.less_start"), -F.col("_best.less_period")
    return rows.select(key, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
