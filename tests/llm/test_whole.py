"""Properties that hold over the whole of a large table, not only over its first rows."""

import numpy as np
import pyarrow as pa

from lumora.llm import ann, toxicity


def test_neighbours_of_late_rows(spark):
    """Clusters move with the id: rows of the last sixth find their neighbours as the others do."""
    rng = np.random.default_rng(4)
    n, width = 42_000, 32
    ids = np.arange(n)
    centre = rng.normal(size=(n // 30, width))
    centre[: n // 36, width // 2 :] = 0  # the last sixth's clusters lie in other dimensions
    centre[n // 36 :, : width // 2] = 0
    x = (ann._unit(centre)[ids // 30] + rng.normal(size=(n, width)) * 0.13).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(ids), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float32()))}))
    found = {}
    for r in ann.search(df, every=50).select("query_id", "vec_id").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    unit, recall = ann._unit(x.astype(np.float64)), {}
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -2
        recall[q] = len(found[q] & set(np.argpartition(-s, 5)[:5].tolist())) / 5
    late = np.mean([v for q, v in recall.items() if q >= n * 5 // 6])
    rest = np.mean([v for q, v in recall.items() if q < n * 5 // 6])
    assert rest > 0.9 and late > rest - 0.04, (late, rest)


def test_rare_toxic_word_is_learnt():
    """A word in 0.3 % of the toxic rows speaks for toxic, and the texts that only it marks are found."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    filler = lambda: " ".join(rng.choice(words, 12))
    toxic = [f"{filler()} {'wretched' if k >= 6 else 'zqblort'}" for k in range(2000)]
    model = toxicity.fit(toxic + [filler() for _ in range(2000)], [1] * 2000 + [0] * 2000, 0.5)
    assert any(t[0].startswith("zqbl") for t in model.terms)
    find = toxicity.Finder(model.terms)
    score = lambda t: model.bias + sum(model.weights[k] for k in find(t)) + float(model.weights[len(model.terms) :] @ toxicity.patterns(t))
    assert all(score(t) > 0 for t in toxic[:6])
