"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, every byte of it that is no letter becomes a blank, and its byte 3- and 4-grams (blanks mark
where words begin and end) are hashed into rows of an embedding table. The mean of the rows goes through a linear
softmax. Both layers are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As
both are linear, prediction adds up one row of class scores for each n-gram.

Rejection is calibrated on held-back rows of the sample, each taken whole and as a short snippet from anywhere in it: a
temperature is fitted to both, and a text is rejected if it has no letter, or if its probability is below the level that all but
REJECT of the held-back texts, and of their snippets, reach.

Defined results: null text, empty text and text without a letter give `und`, score 0, rejected. Repeated rows each
give a row, equal texts equal results. Without a labelled row there is no language, and all is `und`. Ties go to the
language that sorts first. An empty table gives no row. Very long texts are read whole, in pieces that overlap, so that the
pieces change nothing. Columns of the input that have a result's name are replaced; all others stay. A repeated doc_id is
learnt from once, by its least text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumora.llm.common import bounded, parts, remainder, trained, written

#: Rows of the embedding table, and its width.
BUCKETS, WIDTH = 1 << 16, 16
#: Bounds of what is learnt from: labelled rows, and their bytes of text.
SAMPLE, SAMPLE_BYTES = 5000, 64 << 20
#: Share of held-back texts, and of their snippets, that may fall below the rejection level.
REJECT = 0.001
UNKNOWN = "und"
#: Bytes that are worked on at once.
PIECE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    level: float = 0.0


def _clean(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed 3- and 4-grams that start at each byte but the last three: two rows of bucket numbers."""
    b = np.where(_LETTER[data], data, 32).astype(np.uint32)
    three = b[:-3] * np.uint32(0x9E3779B1) + b[1:-2] * np.uint32(0x85EBCA77) + b[2:-1] * np.uint32(0xC2B2AE3D)
    four = (three ^ (three >> np.uint32(15))) * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
    return np.stack([((three ^ (three >> np.uint32(13))) * np.uint32(0x2545F491)) >> np.uint32(16), (four * np.uint32(0x9E3779B1)) >> np.uint32(16)])


def sums(texts: list[bytes], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's summed class scores, and its number of n-grams."""
    total, count = np.zeros((len(texts), scores.shape[1])), np.zeros(len(texts))
    part: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal part, size
        if part:
            # A part's last three bytes only end n-grams; they begin the text's next part.
            lens = np.array([len(t) for _, t in part])
            data = np.frombuffer(b"".join(t for _, t in part) + b"   ", np.uint8)
            at = np.concatenate([[0], np.cumsum(lens)[:-1]])
            rows, own = np.array([k for k, _ in part]), lens - 3
            starts = np.ravel(np.column_stack([at, at + own]))
            for buckets in grams(data):
                np.add.at(total, rows, np.add.reduceat(scores[buckets], starts, axis=0, dtype=np.float64)[::2])
            np.add.at(count, rows, 2.0 * own)
        part, size = [], 0

    for k, text in enumerate(texts):
        text = b"   " + text + b"      "
        for lo in range(0, len(text) - 3, PIECE):
            part.append((k, text[lo : lo + PIECE + 3]))
            size += len(part[-1][1])
            if size >= PIECE:
                flush()
    flush()
    return total, count


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, each once, and the share of the n-grams that fall there."""
    text = b"   " + text + b"      "
    found = [np.unique(grams(np.frombuffer(text[lo : lo + PIECE + 3], np.uint8)), return_counts=True) for lo in range(0, len(text) - 3, PIECE)]
    if len(found) == 1:
        buckets, times = found[0]
    else:
        total = sum(np.bincount(b, n, BUCKETS) for b, n in found)
        buckets = np.flatnonzero(total)
        times = total[buckets]
    return buckets, (times / times.sum()).astype(np.float32)


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 2.0, seed: int = 7) -> Model:
    """Trains on whole texts and on short snippets of them, by all their n-grams; a tenth of the rows is held back for calibration."""
    names = sorted(set(langs))
    if not names:
        return Model()
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, langs)
    data = [_clean(t) for t in texts]
    order = rng.permutation(len(data))
    back = set(order[: len(data) // 10].tolist())
    train = [i for i in order if i not in back]
    table = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)

    def snippet(t: bytes, least: int, most: int) -> bytes:
        size = int(rng.integers(least, most))
        lo = int(rng.integers(0, max(1, len(t) - size)))
        return t[lo : lo + size]

    steps = max(1, epochs * len(train) // 64, 300 if train else 1)
    for step in range(steps if train else 0):
        picked = [train[k % len(train)] for k in range(step * 64, step * 64 + 64)]
        feats = [counted(snippet(data[i], 20, 400) if len(data[i]) > 40 and rng.random() < 0.7 else data[i]) for i in picked]
        mean = np.stack([part @ table[buckets] for buckets, part in feats])
        grad = softmax(mean @ weights + bias)
        grad[np.arange(64), y[picked]] -= 1
        now = rate * (1 - step / steps)
        back_to = (now * grad @ weights.T).astype(np.float32)
        weights -= now / 64 * (mean.T @ grad)
        bias -= now / 64 * grad.sum(0)
        for (buckets, part), change in zip(feats, back_to, strict=True):
            table[buckets] -= part[:, None] * change
    model = Model(names, table @ weights, bias)
    held = [i for i in sorted(back) if _clean(texts[i]).strip()]
    if held:
        total, count = sums([data[i] for i in held] + [snippet(data[i], 15, 200) for i in held], model.scores)
        logits = total / count[:, None] + bias
        spread = np.geomspace(0.05, 20, 60)
        loss = [-np.log(softmax(logits / t)[np.arange(2 * len(held)), y[held + held]] + 1e-12).mean() for t in spread]
        model.temperature = float(spread[int(np.argmin(loss))])
        best = softmax(logits / model.temperature).max(axis=1)
        model.level = float(min(0.5, np.quantile(best.reshape(2, -1), REJECT, axis=1).min()))
    return model


def sample_of(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most `size` labelled rows to learn from, spread evenly by a hash of the id; never a held-out row. One for each id."""
    rows = docs.where((remainder() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.text", "x.lang")


def train(docs: DataFrame, size: int = SAMPLE) -> Model:
    return trained(bounded(written(sample_of(docs, size), "langid-sample"), SAMPLE_BYTES), "lang", fit)


def predict(df: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """df with three more columns: <prefix>lang_pred, <prefix>score (the probability), <prefix>rejected."""
    df = df.drop(*(f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")))
    added = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}rejected", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *added])
    arrow, column = to_arrow_schema(schema), df.columns.index(text)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, text):
            texts = batch.column(column)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            if model.langs and letters.any():
                at = np.flatnonzero(letters)
                picked = [_clean(t) for t in texts.take(pa.array(at)).to_pylist()]
                total, count = sums(picked, model.scores)
                p = softmax((total / count[:, None] + model.bias) / model.temperature)
                best = p.argmax(axis=1)
                for k, b in zip(at, best, strict=True):
                    lang[k] = model.langs[b]
                score[at] = p.max(axis=1)
                rejected[at] = score[at] < model.level
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), pa.array(lang), pa.array(score), pa.array(rejected)], schema=arrow)

    return df.mapInArrow(run, schema)
