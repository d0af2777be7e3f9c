"""Toxicity by weak supervision.

1. Voters. On a bounded sample of labelled rows, words and word beginnings that speak for a class become lexicon
   voters; pattern voters look at shouting, exclamation marks, symbols and repeated words. A voter votes toxic, clean, or
   abstains.
2. Label model. A generative model of the votes, whose classes are clean and several kinds of toxic, is fitted by
   expectation-maximisation to the votes alone: no row's given label takes part, only the labels' share of toxic ones, as
   the prior. Voters that fire together (those of one language, say) make a kind, so that a row isn't held against by the silence
   of voters that could never speak there; each kind is two classes, of few and of many votes. The model estimates how often each voter speaks in each class, which is its
   accuracy, and which voters depend on one another: a spanning forest of the pairs with the most mutual information
   within the classes, along which a voter's rate depends on its neighbour's vote.
3. Classifier. A logistic regression on the presence of the lexicon's terms and on the patterns is fitted to the
   posterior labels, by gradient descent in numpy. Only it scores texts: an automaton finds the terms in the whole
   text, in one pass.

Defined results: null and empty text score as a text without any term. Repeated rows each give a row, equal texts
equal scores; a repeated doc_id is learnt from once, by its least text, as toxic if any of its labels says so. Without
labelled rows, or with an empty table of either kind, all scores are 0. A score of exactly 0.5 counts as toxic. Terms
that add equally much are taken in the order of their letters. Very long texts are read whole. Columns of the input
that have a result's name are replaced; all others stay.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumora.llm.common import bounded, parts, remainder, texts_of, trained, written

#: Labelled rows of either class that are learnt from, at most, and their bytes of text in all.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
#: Lengths of word beginnings that can be terms; how often a term must stand in a text.
BEGINNINGS, TIMES = (4, 5, 6, 7, 8), (1, 2, 3)
PATTERNS = 4
#: Words that speak for clean, at most.
CLEAN_WORDS = 20
#: Twice the mutual information of two voters, by rows and classes, from which they count as dependent.
DEPENDENT = 12.0
#: Clean texts that a word must stand in to speak for clean.
CLEAN = 50
_WORD, _CAPITAL = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Z]")
#: Spelling, whether it is a whole word (else a word's beginning), and how often it must stand.
Term = tuple[str, bool, int]


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(PATTERNS))
    bias: float = -30.0


def candidates(text: str) -> set[Term]:
    """The terms that a text holds."""
    words = Counter(_WORD.findall(text.lower()))
    begin: Counter[str] = Counter()
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) >= k:
                begin[w[:k]] += n
    return {(w, True, 1) for w in words} | {(w, False, least) for w, n in begin.items() for least in TIMES if n >= least}


def patterns(text: str) -> list[float]:
    """Shouting, exclamation marks, symbols, and line repetition, each from 0 to 1."""
    n = max(1, len(text))
    lines = text.split("\n")
    return [len(_CAPITAL.findall(text)) / n, min(1.0, 20 * text.count("!") / n), min(1.0, 5 * sum(map(text.count, "#$%&*")) / n), 1 - len(set(lines)) / len(lines)]


class Finder:
    """Finds a model's terms in texts."""

    def __init__(self, terms: list[Term]):
        import ahocorasick

        self.terms, self.automaton = terms, ahocorasick.Automaton()
        # Several terms can be spelt alike: words, beginnings, and other least numbers.
        same: dict[str, list[int]] = {}
        for k, (spelt, _, _) in enumerate(terms):
            same.setdefault(spelt, []).append(k)
        for spelt, numbers in same.items():
            self.automaton.add_word(spelt, (len(spelt), numbers))
        if terms:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int]:
        """The numbers of the terms that stand in the text."""
        if not self.terms:
            return []
        low, count = text.lower(), Counter()
        last = len(low) - 1
        for end, (n, numbers) in self.automaton.iter(low):
            if end == n - 1 or not low[end - n].isalpha():
                whole = end == last or not low[end + 1].isalpha()
                for k in numbers:
                    if whole or not self.terms[k][1]:
                        count[k] += 1
        return sorted(k for k, n in count.items() if n >= self.terms[k][2])


def _share(a: list[int], b: list[int]) -> float:
    both = len(set(a) & set(b))
    return both / max(1, len(a) + len(b) - both)


def _votes(present: np.ndarray, speaks: np.ndarray, pats: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains."""
    return np.concatenate([np.where(present, speaks, 0), np.where(pats > cuts, 1, 0)], axis=1).astype(np.int8)


def _kinds(fires: np.ndarray) -> np.ndarray:
    """A number for each voter: those that fire together, in a fifth of the rarer one's rows, and in three at least, have one."""
    n, both = fires.sum(0), fires.T @ fires
    edge = both >= np.maximum(3, 0.2 * np.minimum(n[:, None], n[None, :]))
    root, before = np.arange(len(n)), None
    while before is None or (root != before).any():
        before, root = root, np.minimum(root, np.where(edge, root, len(n)).min(axis=1, initial=len(n)))
    return root


def _forest(weight: np.ndarray) -> np.ndarray:
    """The parent of each node (-1: none) in the heaviest spanning forest over positive weights."""
    parent, done, best, via = np.full(len(weight), -1), np.zeros(len(weight), bool), np.zeros(len(weight)), np.full(len(weight), -1)
    for _ in range(len(weight)):
        at = int(np.argmax(np.where(done, -1, best)))
        done[at] = True
        if best[at] > 0:
            parent[at] = via[at]
        better = (weight[at] > best) & ~done
        best[better], via[better] = weight[at][better], at
    return parent


def _information(share: np.ndarray, one: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters within the classes."""
    total = np.zeros(pair.shape[1:])
    for w, p, ab in zip(share, one, pair, strict=True):
        a, b = p[:, None], p[None, :]
        for q, x, y in ((ab, a, b), (a - ab, a, 1 - b), (b - ab, 1 - a, b), (1 - a - b + ab, 1 - a, 1 - b)):
            q = np.maximum(q, 1e-12)
            total += w * q * np.log(q / np.maximum(x * y, 1e-12))
    np.fill_diagonal(total, 0)
    return total


def label_model(votes: np.ndarray, prior: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes; how often each voter speaks, by class (clean first); each voter's parent in the
    forest of dependences."""
    n, v = votes.shape
    fires, speaks, toxic_votes = (votes != 0).astype(np.float64), np.sign(votes.sum(0)), (votes > 0).sum(1)
    toxic = np.flatnonzero(speaks > 0)
    if not len(toxic):
        return np.full(n, prior), fires.mean(0)[None, :], np.full(v, -1)
    # The start takes rows with two votes for toxic, or with one if that is nearer to the prior.
    level = min((2, 1), key=lambda k: abs((toxic_votes >= k).mean() - prior))
    kind = np.full(v, -1)
    kind[toxic] = _kinds(fires[:, toxic][toxic_votes >= level])
    names = [k for k in np.unique(kind[toxic]) if (kind == k).sum() >= 3]
    spoke = np.stack([fires[:, kind == k].sum(1) for k in names], axis=1) if names else fires[:, toxic].sum(1)[:, None]
    strong = np.where(toxic_votes >= level, 0.9, np.where(toxic_votes == 1, 0.05, 0.0))[:, None]
    spoke = spoke + 1e-3
    kinds = strong * spoke / spoke.sum(1, keepdims=True)
    # Each kind is two classes, of rows with few votes and with many: a longer text gives all its voters more to find.
    many = (toxic_votes > np.median(toxic_votes[toxic_votes >= level]) if (toxic_votes >= level).any() else toxic_votes > level)[:, None]
    rows = np.concatenate([1 - strong, np.where(many, 0, kinds), np.where(many, kinds, 0)], axis=1)
    base, parent = fires.mean(0), np.full(v, -1)
    for step in range(rounds):
        size = rows.sum(0)
        share = np.concatenate([[1 - prior], prior * size[1:] / max(size[1:].sum(), 1e-9)])
        one = (rows.T @ fires + base) / (size[:, None] + 1)
        # Who speaks for clean does so no more often in what is toxic.
        one[1:, speaks < 0] = np.minimum(one[1:, speaks < 0], one[0, speaks < 0])
        one = np.clip(one, 1e-5, 1 - 1e-5)
        pair = np.stack([(fires * w[:, None]).T @ fires for w in rows.T])
        pair = (pair + one[:, :, None] * one[:, None, :]) / (size[:, None, None] + 1)
        if step % 5 == 0:
            info = _information(share, one, pair)
            parent = _forest(np.where(2 * n * info > DEPENDENT * len(share), info, 0))
        over = np.maximum(parent, 0)
        with_parent, log = fires[:, over] > 0, np.tile(np.log(np.maximum(share, 1e-9)), (n, 1))
        for c in range(len(share)):
            joint = pair[c][np.arange(v), over]
            on = np.where(parent >= 0, np.clip(joint / one[c][over], 1e-5, 1 - 1e-5), one[c])
            off = np.where(parent >= 0, np.clip((one[c] - joint) / (1 - one[c][over]), 1e-5, 1 - 1e-5), one[c])
            p = np.where(with_parent, on, off)
            log[:, c] += np.where(fires > 0, np.log(p), np.log(1 - p)).sum(axis=1)
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, rows = np.abs(new - rows).max(), new
        if moved < 1e-4:
            break
    return 1 - rows[:, 0], one, parent


def _number(term: Term) -> int:
    return zlib.crc32(f"{term[0]}|{term[1]}|{term[2]}".encode())


def _common(numbers: list[np.ndarray], least: float) -> np.ndarray:
    found, often = np.unique(np.concatenate([np.zeros(0, np.uint32), *numbers]), return_counts=True)
    return found[often >= least]


def _held(texts: list[str], y: np.ndarray, least: float) -> tuple[list[Term], list[np.ndarray]]:
    """The terms that stand in `least` toxic texts, and the words that stand in CLEAN clean ones (and the few that share a crc32
    with one of them); each text's, by number. Terms are counted by four bytes each first: all of them would fill the driver."""
    numbers = lambda terms: np.fromiter(map(_number, terms), np.uint32, len(terms))
    toxic = _common([numbers(candidates(t)) for t, x in zip(texts, y, strict=True) if x], least)
    clean = _common([numbers([w for w in candidates(t) if w[1]]) for t, x in zip(texts, y, strict=True) if not x], CLEAN)
    kept, index, rows = set(toxic.tolist()) | set(clean.tolist()), {}, []
    for t in texts:
        found = sorted(w for w in candidates(t) if _number(w) in kept)
        rows.append(np.array([index.setdefault(w, len(index)) for w in found], np.int32))
    return list(index), rows


def fit(texts: list[str], toxic: list[int], prior: float) -> Model:
    """prior: the share of toxic rows among those labelled (the sample may hold another)."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Model(bias=-30.0 if not y.any() else 30.0)
    least = max(3, 0.002 * y.sum())
    known, held = _held(texts, y, least)
    count = lambda picked: np.bincount(np.concatenate([np.zeros(0, np.int32), *[h for h, x in zip(held, picked, strict=True) if x]]), minlength=len(known))
    n1, n0 = count(y), count(~y)
    odds = np.log((n1 + 0.1) / (y.sum() + 0.2)) - np.log((n0 + 0.1) / ((~y).sum() + 0.2))
    # Greedy cover: the next voter is the term that adds most to the toxic rows that fewer than three voters speak for.
    strong = (odds > 2.5) & (n1 >= least)
    rows: dict[int, list[int]] = {w: [] for w in np.flatnonzero(strong).tolist()}
    for k in np.flatnonzero(y):
        for w in held[k][strong[held[k]]].tolist():
            rows[w].append(k)
    need, picked = np.full(len(y), 3), []
    gain = {w: len(r) * odds[w] for w, r in rows.items()}
    queue = [(-g, known[w], w) for w, g in gain.items()]
    heapq.heapify(queue)
    while queue:
        g, _, w = heapq.heappop(queue)
        now = -float(np.count_nonzero(need[rows[w]] > 0)) * odds[w]
        if now > g + 1e-9:  # it adds less than when it was queued
            if -now >= least * odds[w]:
                heapq.heappush(queue, (now, known[w], w))
            continue
        if any(known[v][0][:4] == known[w][0][:4] and _share(rows[v], rows[w]) > 0.8 for v in picked):
            continue  # another spelling of a voter that there is
        picked.append(w)
        need[rows[w]] -= 1
    words = [k for k, w in enumerate(known) if w[1] and n0[k] >= CLEAN]
    clean = sorted(words, key=lambda k: (np.log((n1[k] + 0.5) / y.sum()) - np.log(n0[k] / (~y).sum()), known[k]))[:CLEAN_WORDS]
    speaks = np.array([1] * len(picked) + [-1] * len(clean))
    terms = [known[k] for k in picked + clean]
    find = Finder(terms)
    present = np.zeros((len(texts), len(terms)), bool)
    for k, t in enumerate(texts):
        present[k, find(t)] = True
    pats = np.array([patterns(t) for t in texts])
    votes = _votes(present, speaks, pats, np.quantile(pats[~y], 0.99, axis=0))
    post, _, _ = label_model(votes, float(y.mean()))  # the sample's own share
    x = np.concatenate([present.astype(np.float64), pats], axis=1)
    balance = np.where(y, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    weights, bias = np.zeros(x.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, 1501):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -40, 40)))
        err = (p - post) * balance / len(y)
        grad = np.append(x.T @ err + 1e-4 * weights, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(terms, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learns from labelled rows that are not held out, at most `size` of either class, spread evenly by a hash."""
    known = labels.where((remainder() != 0) & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return Model()
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for c in (0, 1)]
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    sample = bounded(written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample"), SAMPLE_BYTES)
    prior = min(0.99, max(0.01, share))
    return trained(sample, "toxic", lambda texts, toxic: fit(texts, toxic, prior))


def predict(df: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """df with two more columns: <prefix>score (probability of toxic) and <prefix>predicted (1 from 0.5 on)."""
    df = df.drop(f"{prefix}score", f"{prefix}predicted")
    schema = T.StructType([*df.schema.fields, T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())])
    arrow, column = to_arrow_schema(schema), df.columns.index(text)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, w, n = Finder(model.terms), model.weights, len(model.terms)
        for batch in parts(found, text):
            score = np.array([model.bias + sum(w[k] for k in find(t)) + float(w[n:] @ patterns(t)) for t in texts_of(batch.column(column))])
            score = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())], schema=arrow)

    return df.mapInArrow(run, schema)
