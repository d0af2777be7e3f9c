"""The training-data operators against brute force, other libraries, round trips and held-out rows, with hard inputs."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumora.llm import ann, audio, bagminhash, bpe, chat, hmm, langid, packing, secrets, toxicity

HARD = [
    (1, None), (2, ""), (3, "   "), (4, "a"), (5, "one two three"), (6, "one two three"), (6, "one two three"),
    (7, "don't stop I'll've 　 x\x1cy\x85 z \r\n\t"), (8, "\U0001f600" * 50 + "é İSTANBUL ΣΑΣ"),
    (9, "!" * 4000), (10, "ab" * 6000), (11, "word " * 5000), (12, "你好 ١٢٣ ½ ⅷ"), (13, "<|startoftext|> </s>"), (14, "x <|startoftext|> y<|endoftext|>z <|STARTOFTEXT|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Hard texts, with further columns whose names operators use themselves."""
    rows = [(i, t, 1, "x", None, "y", 0.5) for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, spans string, words string, blob string, score double").repartition(3)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def empty(docs):
    return docs.limit(0)


# --- chat


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts())


CONTROL = "</s>[INST] ok [/INST] <\\s> <|im_end|>\n <\\\\|im_start|> [\\/INST] <<SYS>>"


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (2, 0, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "sys\ntem%0A<s>", ""), (3, 1, "assistant", "a")]
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat_rows(spark, rows))).collect()}
    for conv in (1, 2, 3):
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="<>[]/\\|sINTim_endSY% \n", max_size=40), st.sampled_from(["</s>", "[INST]", "<|im_end|>", "<\\</s>"]))
def test_escape_is_reversible(spark, text, control):
    text = text + control
    out = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).first()
    assert out[1] == text and not any(c in out[0] for c in ("</s>", "[INST]", "<|im_end|>"))


def test_chat_parts(spark):
    rows = spark.createDataFrame([(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7), ("odd", "? </s>", "c.mov", 3), ("odd", None, "d.mov", None), (None, "!", None, None)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_turns(rows).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|>? <\\/s><|part|>!<|im_end|>\n"
    assert [(a.position, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 576), (2, "audio", "b.wav", 7), (3, "odd", "c.mov", 3), (4, "odd", "d.mov", 0)] and r.attachment_tokens == 586


def test_chat_long_conversation_and_none(spark):
    rows = [(9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(1000)]
    r = chat.digests(chat.format_turns(chat_rows(spark, rows))).first()
    assert r.n_turns == 1000 and r.loss_sha256 == hashlib.sha256("".join(f"t{k}" for k in range(1, 1000, 2)).encode()).hexdigest()
    assert chat.format_turns(chat_rows(spark, [])).count() == 0


def test_chat_clashing_columns_and_long_texts(spark):
    long = "</s> x" * 200_000
    rows = chat_rows(spark, [(1, 0, "assistant", long)]).withColumns({c: F.lit("old") for c in ("_rows", "_run", "segments", "formatted", "body", "attachments")})
    r = chat.digests(chat.format_turns(rows)).first()
    assert r.loss_chars == len(long) and r.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


# --- BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_is_the_library(spark, docs, corpus, ranks):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = docs.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, "text"))
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(both, ranks, public_tokenizers.PATTERN, block_bytes=50_000)).collect())
    want = collections.Counter()
    for r in both.collect():
        ids = np.array(lib.encode_ordinary(r.text or ""), "<u4")
        want[(r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encode(empty(docs), ranks, public_tokenizers.PATTERN).count() == 0


def test_every_token_is_made_by_its_merges(ranks):
    """What the one pass in the order of ranks rests on: the halves of a token come before it."""
    for token, rank in ranks.items():
        if len(token) > 1 and (pair := bpe.halves(token, ranks)):
            assert max(ranks[p] for p in pair) < rank


def test_splitter_is_the_pattern():
    import regex

    full = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    split = bpe.Splitter(public_tokenizers.PATTERN)
    assert all(split(t or "") == full(t or "") for _, t in HARD)
    every = "".join(f"a{chr(c)} {chr(c)}1" for c in range(0x2FFF))
    assert split(every) == full(every)


# --- secrets


def brute_spans(text):
    import re

    out = []
    for k, rule in enumerate(secrets.RULES):
        out += [(m.start(), k, rule.kind, m.end()) for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]
    return sorted(out)


SECRET = 'x password: "hunter22x" secret:token :abcdefg AKIA' + "A" * 16 + " " + "0a" * 12 + " é API_KEY=" + "0f" * 20 + " ghp_" + "a1" * 18 + " token=abc"


def test_secrets_are_brute_force(spark, docs, corpus):
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(50, SECRET), (51, SECRET), (52, "AKIA" + "Z" * 15)], "doc_id long, text string")).union(corpus.select(F.col("doc_id") + 1000, "text"))
    found, _ = secrets.scan_documents(rows)
    got = found.collect()
    assert len(got) == rows.count()
    for r in got:
        assert [(s.begin, s.kind_no, s.kind, s.end) for s in r.spans] == brute_spans(r.text or ""), r.doc_id
    d = {r.doc_id: r for r in secrets.digests(found).collect()}
    base = ",".join(f"{k}:{a}:{b}" for a, n, k, b in brute_spans(SECRET) if n < 3)
    assert d[50].base_sha256 == hashlib.sha256(base.encode()).hexdigest() == d[51].base_sha256 and d[50].n_access == 1 and d[1].spans == ""
    assert secrets.scan_documents(empty(docs))[0].count() == 0


def test_ledger_scans_only_what_is_new(spark):
    a = spark.createDataFrame([(1, SECRET), (2, "clean")], "doc_id long, text string")
    _, ledger = secrets.scan_documents(a, secrets.empty_ledger(a))
    # Findings that only the ledger can know show that a blob isn't scanned again.
    marked = ledger.withColumn("spans", F.when(F.size("spans") > 0, F.slice("spans", 1, 1)).otherwise(F.col("spans")))
    b = spark.createDataFrame([(3, SECRET), (4, "token=abcdefgh")], "doc_id long, text string")
    found, after = secrets.scan_documents(b, marked)
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {3: 1, 4: 1} and after.count() == 3
    newer = (*secrets.RULES[:-1], secrets.Rule("clean", "clean"))
    found, _ = secrets.scan_documents(a, after, newer)
    assert {r.doc_id: [s.kind for s in r.spans] for r in found.collect()}[2] == ["clean"]


def test_ledger_keeps_what_it_scanned_by_older_rules(spark):
    """Two commits: base rules on some, then all rules on all; each pair of blob and rule's version is scanned once."""
    rows = [(k, t) for k, t in enumerate([SECRET, "clean", SECRET, "ghp_" + "b2" * 18, "token=abcdefgh", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = secrets.commit(docs.where("doc_id < 2"), secrets.empty_ledger(docs), secrets.BASE)
    marked = first.withColumn("spans", F.filter("spans", lambda s: s["kind"] != "hex"))  # shows that base rules don't run again
    last = secrets.commit(docs, marked)
    assert last.count() == 5 and last.select(F.size("versions")).distinct().collect() == [(len(secrets.RULES),)]
    got = {r.doc_id: [(s.begin, s.kind) for s in r.spans] for r in secrets.findings(docs, last).collect()}
    want = {k: [(b, kind) for b, _, kind, _ in brute_spans(t or "") if not (t == SECRET and kind == "hex")] for k, t in rows}
    assert got == want and any(kind == "forge" for _, kind in got[0])


def test_findings_keep_clashing_columns_and_deal_copies(spark):
    rows = [(k, SECRET, "mine", "b", 1, {"a": 1}) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _blob string, salt int, m map<string,int>").withColumn("spans", F.lit("old")).withColumn("blob", F.lit("own"))
    found, _ = secrets.scan_documents(docs)
    out = found.collect()
    assert sorted(found.columns) == sorted(docs.columns) and len(out) == 300
    assert {(r._spans, r._blob, r.salt, r.blob) for r in out} == {("mine", "b", 1, "own")} and all(len(r.spans) == len(brute_spans(SECRET)) for r in out)


def test_redaction(spark):
    row = spark.createDataFrame([(1, "token=abcdefgh and " + "0a" * 15 + " end", "x")], "doc_id long, text string, keep string")
    r = secrets.scan_documents(row)[0].select(secrets.redacted(F.col("text"), F.col("spans")).alias("t"), "keep").first()
    assert r.t == "[SECRET] and [SECRET] end" and r.keep == "x"
    both = spark.createDataFrame([(1, "api_key=" + "0a" * 15)], "doc_id long, text string")
    assert secrets.scan_documents(both)[0].select(secrets.redacted(F.col("text"), F.col("spans"))).first()[0] == "[SECRET]"


# --- toxicity and language


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.predict(docs.select("doc_id", "text"), toxicity.train(docs, labels)).where(toxicity.remainder() == 0).join(labels, "doc_id").select("toxic", "predicted").toPandas()
    assert out[out.toxic == 1].predicted.mean() > 0.85 and out[out.toxic == 0].predicted.mean() < 0.01


def test_toxicity_hard_inputs(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 15)] + [(5, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.predict(docs, model, prefix="p_").collect()
    assert len(out) == len(HARD) and all(0 <= r.p_score <= 1 for r in out) and len({r.p_score for r in out if r.doc_id == 6}) == 1
    none = toxicity.train(docs, empty(labels))
    assert all(r.p_predicted == 0 for r in toxicity.predict(docs, none, prefix="p_").collect())
    assert toxicity.predict(empty(docs), model, prefix="p_").count() == 0


def _voted(rng, n, share, kinds, voters):
    """Rows of kinds whose voters fire together, with no given label: truth, votes."""
    y, of = rng.random(n) < share, rng.integers(0, kinds, n)
    rate = np.where(y[:, None] & (of[:, None] == np.arange(kinds).repeat(voters)), 0.35, 0.01)
    return y, (rng.random((n, kinds * voters)) < rate).astype(np.int8)


def test_label_model_finds_the_labels_from_votes_alone():
    y, votes = _voted(np.random.default_rng(0), 4000, 0.3, 3, 9)
    post, one, parent = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == y).mean() > 0.95 and abs(post.mean() - 0.3) < 0.03
    # The rates are those of the truth, 0.35 in a voter's own kind and 0.01 in what is clean; so is the posterior: a row of one vote.
    assert one[1:].max(axis=0).min() > 0.25 and one[0].max() < 0.03
    alone = votes.sum(axis=1) == 1
    assert abs(post[alone].mean() - y[alone].mean()) < 0.06


def test_label_model_finds_dependent_voters():
    rng = np.random.default_rng(1)
    y, votes = _voted(rng, 4000, 0.3, 1, 8)
    # A voter that repeats another one nearly always is its neighbour in the forest, and hardly moves the posterior.
    copy = np.where(rng.random(4000) < 0.97, votes[:, :1].T, 0).T
    more = np.concatenate([copy, votes], axis=1)
    post, _, parent = toxicity.label_model(more, 0.3)
    assert parent[0] == 1 or parent[1] == 0
    assert ((post > 0.5) == y).mean() > 0.9


def test_label_model_against_given_labels(spark):
    """The posterior comes from votes; how far it is from the labels that took no part."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = docs.where(F.col("text").isNotNull()).join(labels, "doc_id").where(toxicity.remainder() != 0).select("text", "toxic").toPandas()
    seen = {}

    def noted(votes, prior):
        seen["post"] = toxicity_label_model(votes, prior)
        return seen["post"]

    toxicity_label_model, toxicity.label_model = toxicity.label_model, noted
    try:
        toxicity.fit(got.text.tolist(), got.toxic.tolist(), float(got.toxic.mean()))
    finally:
        toxicity.label_model = toxicity_label_model
    said = seen["post"][0] > 0.5
    assert (said == (got.toxic == 1)).mean() > 0.97 and (said != (got.toxic == 1)).any()


def test_toxicity_sample_is_bounded_and_settled(spark, monkeypatch):
    rows = [(k, f"{'bad' if k % 2 else 'good'} word{k} " * 20) for k in range(60)] + [(1, "other text of one id")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    models = [toxicity.train(d, labels) for d in (docs, docs.repartition(7))]
    assert models[0].terms == models[1].terms and np.array_equal(models[0].weights, models[1].weights)
    sample = docs.dropDuplicates(["doc_id"])
    assert 0 < toxicity.bounded(sample, 2000).count() < 60 == toxicity.bounded(sample, 1 << 20).count()


def test_toxicity_scores_are_brute_force(spark, docs, corpus):
    """A trained model's scores, out of terms that are looked for one by one and patterns that are counted character by character."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(corpus, labels)
    hard = "zzqx zzqxbad ZZQX zzqxx! a$b#c\nzzqx\nzzqx\n" * 3 + "yzzqx"
    model.terms += [("zzqx", True, 1), ("zzqx", False, 3), ("zzqx", False, 99), ("zzqxb", False, 1), ("yzzqx", True, 1)]
    model.weights = np.concatenate([model.weights[: -toxicity.PATTERNS], [0.5, 0.25, 4.0, -0.125, 1.5], model.weights[-toxicity.PATTERNS :] + 0.1])
    both = docs.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, "text")).union(spark.createDataFrame([(900, hard), (901, "bad" + hard[:9])], "doc_id long, text string"))

    def plain(text):
        words = []
        for c in text.lower():  # runs of letters
            if c.isalpha():
                words = [*words[:-1], words[-1] + c] if words and words[-1] else [*words, c]
            elif words and words[-1]:
                words.append("")
        n, lines = max(1, len(text)), text.split("\n")
        shares = [sum("A" <= c <= "Z" for c in text) / n, min(1, 20 * sum(c == "!" for c in text) / n), min(1, 5 * sum(c in "#$%&*" for c in text) / n), 1 - len(set(lines)) / len(lines)]
        there = [sum(w == term if whole else w.startswith(term) for w in words) >= least for term, whole, least in model.terms]
        x = model.bias + sum(w for w, t in zip(model.weights, there, strict=False) if t) + sum(w * v for w, v in zip(model.weights[len(there) :], shares, strict=True))
        return 1 / (1 + math.exp(-min(40, max(-40, x))))

    out = toxicity.predict(both, model).collect()
    assert len(out) == len(HARD) + corpus.count() + 2
    assert all(r.score == pytest.approx(plain(r.text or ""), abs=1e-12) and r.predicted == (r.score >= 0.5) for r in out)


def test_results_replace_columns_of_their_names(spark, docs, corpus):
    clash = docs.withColumns({c: F.lit("old") for c in ("predicted", "lang_pred", "rejected")})
    model = langid.train(corpus)
    a = toxicity.predict(clash, toxicity.Model())
    b = langid.predict(clash, model)
    assert sorted(a.columns) == sorted(clash.columns) and a.where("predicted = 0").select("score", "spans").count() == len(HARD)
    assert sorted(b.columns) == sorted(clash.columns) and b.select("lang_pred", "rejected", "score").where("lang_pred = 'old'").count() == 0


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.train(docs), prefix="p_").where(langid.remainder() == 0).select("lang", "p_lang_pred", "p_rejected").toPandas()
    assert (out.lang == out.p_lang_pred).mean() > 0.98 and out.p_rejected.mean() < 0.02


def test_langid_hard_inputs(spark, docs, corpus):
    model = langid.train(corpus)
    out = {r.doc_id: r for r in langid.predict(docs, model, prefix="p_").collect()}
    assert all((out[i].p_lang_pred == "und") == (i in (1, 2, 3, 9)) for i in out) and out[1].p_rejected and out[9].p_score == 0
    assert {r.p_lang_pred for r in langid.predict(docs, langid.fit([], []), prefix="p_").collect()} == {"und"}
    assert langid.predict(empty(docs), model, prefix="p_").count() == 0
    long = "the and of that " * 200_000
    assert langid.sums([langid._clean(long)], model.scores)[1][0] > 2 * len(long)


def test_langid_scores_are_brute_force(spark, docs, corpus):
    """A trained model's probabilities, out of n-grams that are hashed one by one by plain numbers."""
    model = langid.train(corpus)
    cut = lambda x: x & 0xFFFFFFFF

    def plain(text):
        data = [32] * 3 + [c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()] + [32] * 6
        total, count = np.zeros(len(model.langs)), 0
        for k in range(len(data) - 3):
            three = cut(data[k] * 0x9E3779B1 + data[k + 1] * 0x85EBCA77 + data[k + 2] * 0xC2B2AE3D)
            four = cut(cut((three ^ three >> 15) * 0x27D4EB2F) + data[k + 3] * 0x165667B1)
            total += model.scores[cut((three ^ three >> 13) * 0x2545F491) >> 16].astype(float) + model.scores[cut(four * 0x9E3779B1) >> 16]
            count += 2
        p = np.exp((total / count + model.bias) / model.temperature)
        return p / p.sum()

    both = docs.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, "text").limit(60))
    for r in langid.predict(both, model, prefix="p_").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.p_lang_pred, r.p_score, r.p_rejected) == ("und", 0, True)
            continue
        p = plain(r.text)
        assert r.p_score == pytest.approx(p.max(), abs=1e-5) and p[model.langs.index(r.p_lang_pred)] == pytest.approx(p.max(), abs=1e-5)
        assert r.p_rejected == (r.p_score < model.level)


def test_langid_learns_from_whole_texts():
    """What tells two languages apart stands at the texts' ends only, behind more n-grams than were once drawn of a text."""
    same = "lorem ipsum dolor sit amet " * 40
    texts = [same + ("xqzw vkjy " if k % 2 else "ghbt pfrm ") * 30 for k in range(200)]
    model = langid.fit(texts, ["bb" if k % 2 else "aa" for k in range(200)])
    total, count = langid.sums([langid._clean(t) for t in texts[:20]], model.scores)
    assert [model.langs[k] for k in (total / count[:, None] + model.bias).argmax(axis=1)] == ["aa", "bb"] * 10
    assert 0 < model.level <= 0.5


def test_counted_is_every_n_gram(monkeypatch):
    text = b"the quick brown fox " * 50
    want = collections.Counter(langid.grams(np.frombuffer(b"   " + text + b"      ", np.uint8)).ravel().tolist())
    for piece in (1 << 20, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        buckets, share = langid.counted(text)
        assert dict(zip(buckets.tolist(), np.round(share * sum(want.values())).astype(int).tolist(), strict=True)) == want


# --- nearest neighbours


def vectors(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[5::60] = x[5]  # a hot vector
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_ann_recall_ties_and_scores(spark):
    x, df = vectors(spark)
    got = collections.defaultdict(list)
    for r in ann.search(df, every=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), 5):
        s = u @ u[q]
        best = sorted((-round(float(s[i]), 12), i) for i in range(len(x)) if i != q)[:5]
        assert len(got[q]) == 5 and all(abs(s[i] - c) < 1e-12 for i, c in got[q])
        hit += len({i for _, i in best} & {i for i, _ in got[q]})
    assert hit / len(got) / 5 > 0.95
    assert [i for i, _ in got[5]] == [65, 125, 185, 245, 305]


def test_ann_hard_inputs(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (3, [1.0, 1.0]), (4, [2.0, 2.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df).orderBy("query_id", "rank").collect()] == [(0, 1, 3), (0, 2, 4)]
    assert ann.search(df.limit(0)).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert ann.search(one).count() == 0


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(1)
    c = ann._unit(rng.normal(size=(900, 12))).astype(np.float32)
    q = ann._unit(rng.normal(size=(80, 12))).astype(np.float32)
    at, s = ann.Graph(c).search(q, 10)
    best = np.argsort(-(q @ c.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(at, best, strict=True)]) > 9.5 and (np.diff(s, axis=1) <= 1e-6).all()


# --- language model


@pytest.mark.parametrize("n", [1, 2, 3, 16, 47, 192])
def test_centroid_graph_at_small_sizes(n):
    """The graph is searched at every size; as long as its beam holds all centroids, what it finds is exact."""
    rng = np.random.default_rng(n)
    c, q = (ann._unit(rng.normal(size=(k, 12))).astype(np.float32) for k in (n, 30))
    at, s = ann.Graph(c).search(q, 5)
    want, cos = ann.ordered(q, c)
    assert at.shape == s.shape == (30, min(n, 5)) and np.allclose(s, np.take_along_axis(q @ c.T, at, axis=1), atol=1e-6)
    assert (at == want[:, :5]).all() if n <= ann.BEAM else (at == want[:, :5]).mean() > 0.95
    assert ann.Graph(c).search(q[:0], 5)[0].shape[0] == 0


def test_hmm_forward_and_counts_are_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    share = lambda *n: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(n))
    m = hmm.Model(share(3), share(3, 3), share(3, 6))
    seqs = [rng.integers(0, 6, n) for n in (5, 1, 4)]
    order = np.array([0, 2, 1])
    want, starts, moves, emits = [], np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6))
    for s in (seqs[k] for k in order):
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = np.array([m.start[z[0]] * m.emit[z[0], s[0]] * np.prod([m.move[z[i - 1], z[i]] * m.emit[z[i], s[i]] for i in range(1, len(s))]) for z in paths])
        want.append(math.log(p.sum()))
        for z, w in zip(paths, p / p.sum(), strict=True):
            starts[z[0]] += w
            for i, k in enumerate(z):
                emits[k, s[i]] += w
                if i:
                    moves[z[i - 1], k] += w
    grid = hmm._grid(seqs, order)
    assert np.allclose(hmm.forward(m, *grid)[0], want)
    for chunk in (1, 2, 3, 100):
        a, b, c, logs = hmm.expected(m, *grid, chunk, np.float64)
        assert np.allclose(a, starts) and np.allclose(b, moves) and np.allclose(c, emits) and np.isclose(logs, sum(want))


def test_hmm_score_is_the_models_likelihood(spark, monkeypatch):
    """The end-to-end score against a plain recursion, with the model and counts that the run itself came to."""
    seen = {}
    scored = hmm._scored
    monkeypatch.setattr(hmm, "_scored", lambda *x: seen.setdefault("args", x) and scored(*x))
    monkeypatch.setattr(hmm, "TOP", 3)
    monkeypatch.setattr(hmm, "BUCKETS", 2)
    rows = [(k, t) for k, t in enumerate(["a b a c d e", "b b a", "", None, "zz a unknown", "e d c b a A", "a b"] * 6)]
    out = {r.doc_id: r.score for r in hmm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    model, classes, tokens_of, words_of, total, distinct, ends = seen["args"]
    counts = collections.Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1 for w in hmm.tokens(t or ""))
    for k, t in rows:
        words = hmm.tokens(t or "")
        a, log = None, 0.0
        for n, c in enumerate(classes.of(words).tolist()):
            a = [sum((model.start[s] if a is None else a[r] * model.move[r, s]) for r in range(len(model.start) if a is not None else 1)) * model.emit[s, c] for s in range(len(model.start))]
            if len(classes.single) <= c != classes.end:
                log += math.log10((counts[words[n]] + 0.5) / (tokens_of[c] + 0.5 * (words_of[c] + 1)))
        assert out[k] == pytest.approx(math.log10(sum(a)) + log, abs=1e-9)


def test_hmm_training_takes_more_of_a_larger_corpus(spark, corpus, monkeypatch):
    """Every round's rows: a share of the blocks in the first ones, all in the last; no bound on either."""
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 5_000)
    seen, train_round = [], hmm.train_round
    monkeypatch.setattr(hmm, "train_round", lambda blocks, *x: seen.append(blocks.select(F.sum(F.size("ids"))).first()[0] or 0) or train_round(blocks, *x))
    twice = corpus.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 100_000, "text"))
    for df in (corpus, twice):
        hmm.score_documents(df)
    n = len(seen) // 2
    assert seen[n - 1] * 2 == seen[-1] == twice.count() and 1.5 * sum(seen[: n - 2]) < sum(seen[n:-2])


def test_hmm_rounds_share_rows_alike_at_every_size():
    """Each row is learnt from in one of SHARE turns, whatever the number of blocks and their size, and in each whole round."""
    for sizes in ([3], [100], [1] * 40, [1000, 7, 16]):
        turns = collections.Counter()
        for part, n in enumerate(sizes):
            rows, block = np.arange(n), part << 32 | part % 3
            assert (hmm.in_round(rows, block, None) == rows).all()
            shares = [hmm.in_round(rows, block, k) for k in range(hmm.SHARE)]
            assert sorted(np.concatenate(shares).tolist()) == rows.tolist()
            turns.update({k: len(x) for k, x in enumerate(shares)})
        assert max(turns.values()) - min(turns.values()) <= len(sizes)


def test_hmm_long_words_are_classes_of_their_own(spark, monkeypatch):
    seen, scored = {}, hmm._scored
    monkeypatch.setattr(hmm, "_scored", lambda *x: seen.setdefault("args", x) and scored(*x))
    monkeypatch.setattr(hmm, "TOP", 3)
    long, other = "w" * 64 + "x" * 100_000, "w" * 64 + "y" * 65
    df = spark.createDataFrame([(k, f"{long} {other} a {long} b{k}") for k in range(40)], "doc_id long, text string")
    out = hmm.score_documents(df).collect()
    classes = seen["args"][1]
    assert set(classes.single) == {hmm.name_of(long.encode()), hmm.name_of(other.encode()), b"a"} and all(len(w) <= 96 for w in classes.single)
    own = [classes.single[hmm.name_of(w.encode())] for w in (long, other)]
    assert classes.of([long.encode(), other.encode(), b"zz"]).tolist()[:2] == own and classes.of([b"w" * 64 + b"z" * 9])[0] >= 3
    assert len(out) == 40 and all(r.n_known >= 5 and math.isfinite(r.score) for r in out)


def test_hmm_documents(spark, docs, corpus):
    both = docs.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, "text"))
    rows = both.collect()
    out = hmm.score_documents(both).collect()
    words = lambda t: (t or "").encode().lower().split()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    counts = collections.Counter(w for r in train for w in words(r.text))
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    want = collections.Counter((r.doc_id, len(words(r.text)) + 1, sum(w in counts for w in words(r.text)) + 1, total, round(sum(base(counts[w]) for w in words(r.text)) + base(len(train)), 5)) for r in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    held = [r for r in out if r.held_out and r.n_tokens > 5 and r.doc_id > 1000]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score_documents(empty(docs)).count() == 0


# --- packing


def check_packed(rows, size):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_documents(spark, docs, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, "text"))
    out = packing.pack_documents(both, path).collect()
    want = collections.Counter()
    for r in both.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert check_packed(out, 2048) <= 1.02 * sum(r.length for r in out) / 2048 + 1
    assert packing.pack_documents(empty(docs), path).count() == 0


def test_packing_remembers_a_bounded_number_of_words(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"w{k % 7} x{k * j}" for k in range(200)) + " " + "y" * 500 for j in range(9)]
    want = [packing.Tokenizer(path).ids(t) for t in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "PARTS", 50)
    small = packing.Tokenizer(path)
    assert [small.ids(t) for t in texts] == want
    assert max(map(len, (small, small.old, small.parts, small.old_parts))) <= 50 and all(len(w) <= packing.LONGEST for w in small)


def test_packing_deals_a_hot_length_over_shards(spark):
    cut = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    out = packing.pack(cut).collect()
    assert len({r.doc_id for r in out}) == 3000 and check_packed(out, 2048) == 1500


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_each_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=65)
    used = collections.Counter()
    for pattern, times in packing.plan(histogram, 64):
        assert sum(pattern) <= 64 and times > 0
        for x in pattern:
            used[x] += times
    assert used == collections.Counter(lengths)


# --- audio


def test_audio_round_trip(spark, docs, corpus):
    both = docs.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, "text"))
    rows = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in audio.digests(audio.extract(both)).collect())
    want = collections.Counter()
    for r in both.collect():
        p, media = audio.payload_of(r.text), audio.to_wav(audio.payload_of(r.text))
        want[(r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    assert rows == want
    assert audio.extract(empty(docs)).count() == 0


def test_audio_equal_texts_equal_features(spark, corpus):
    twice = corpus.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, F.col("text")).orderBy(F.desc("doc_id")))
    out = audio.digests(audio.extract(twice)).toPandas()
    assert out.groupby("payload_sha256").feature.nunique().max() == 1


def test_wav_is_a_wav():
    import io
    import wave

    with wave.open(io.BytesIO(audio.to_wav(b"\x01\x80\xff")), "rb") as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(3)) == (audio.STORED_HZ, 1, 1, b"\x01\x80\xff")


@pytest.mark.parametrize(("up", "down"), [(1, 2), (5, 8), (3, 2), (1, 1)])
def test_resampling_is_its_definition(up, down):
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    m = max(up, down)
    t = np.arange(16 * m + 1) - 8 * m
    h = np.sinc(t / m) * np.blackman(len(t))
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    want = x if up == down else np.convolve(wide, h * up / h.sum())[8 * m :][: len(wide)][::down]
    assert np.allclose(audio.resample(x, up, down)[: len(want)], want, atol=1e-5)


def test_audio_segments_and_tensors():
    x = np.concatenate([np.zeros(1000), np.full(1000, 0.5), np.full(400, 0.15), np.zeros(600)]).astype(np.float32)
    assert audio.segments(x) == [(10, 24)]  # 0.15 is too low to begin, but not to go on
    tensors, spans, _ = audio.features(audio.to_wav(bytes(64)))
    assert tensors.shape == (1, audio.FRAMES, audio.MELS) and spans == [(0.0, 0.004)]


def test_log_mel_is_its_definition():
    x = np.random.default_rng(2).normal(size=730).astype(np.float32)
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / (audio.FRAME - 1)) for k in range(audio.FRAME)])
    to_mel, to_hz = (lambda f: 2595 * math.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = [to_hz(to_mel(20.0) + k * (to_mel(audio.HZ / 2) - to_mel(20.0)) / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    want = []
    for at in range(0, 701, audio.HOP):
        frame = np.zeros(audio.FRAME)
        part = x[at : at + audio.FRAME]
        frame[: len(part)] = part
        row = []
        power = [abs(sum(frame * window * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FFT))) ** 2 for k in range(audio.FFT // 2 + 1)]
        for m in range(audio.MELS):
            a, b, c = edges[m : m + 3]
            hz = [k * audio.HZ / audio.FFT for k in range(audio.FFT // 2 + 1)]
            energy = sum(p * max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, hz, strict=True))
            row.append(10 * math.log10(max(energy / audio.FRAME, 1e-8)))
        want.append(row)
    got = audio.log_mel(x)
    assert np.allclose(got, np.array(want)[: len(got)], atol=1e-2) and len(got) >= len(x) // audio.HOP - 1


def test_tensors_come_back_from_parquet(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    audio.extract(docs).write.parquet(f"{tmp_path}/audio")
    stored = pq.read_table(f"{tmp_path}/audio").to_pylist()
    assert len(stored) == len(HARD)
    for row in stored:
        table = audio.stored_tensors(row["tensors"])
        assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.int16(), [audio.FRAMES, audio.MELS])
        tensors, spans, _ = audio.features(row["media"])
        assert np.array_equal(table.column("tensor").combine_chunks().to_numpy_ndarray(), tensors)
        assert list(zip(table.column("begin").to_pylist(), table.column("end").to_pylist(), strict=True)) == spans


# --- near-duplicates


def bag(text):
    w = (text or "").lower().encode().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(rows):
    bags = [(i, bag(t)) for i, t in rows]
    up = {i: i for i, _ in bags}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and b and min(a.total(), b.total()) >= 0.8 * max(a.total(), b.total()):
                both = (a & b).total()
                if both >= 0.8 * (a.total() + b.total() - both) - 1e-9:
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in bags}


def test_near_duplicates_are_brute_force(spark, docs, corpus):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, t) for i, t in HARD]
    for n in range(60):
        words = list(base)
        for k in rng.choice(60, rng.integers(0, 6), replace=False):
            words[k] = f"v{n}{k}"
        rows.append((100 + n, " ".join(words)))
    rows += [(200 + k, "same line here now\n" * k) for k in (20, 22, 40)]
    rows += [(1000 + r.doc_id, r.text) for r in corpus.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("z"))
    got = {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()}
    assert got == brute_classes(list(dict(rows).items()))
    assert bagminhash.classes(empty(docs)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        x = np.sort(rng.integers(1, 2**63, int(rng.integers(1, 50))).astype(np.uint64))
        a = rng.integers(0, 9, len(x))
        b = np.where(rng.random(len(x)) < 0.8, a, rng.integers(0, 20, len(x)))
        if a.any() and b.any():
            p, q = (x[a > 0], a[a > 0]), (x[b > 0], b[b > 0])
            s = bagminhash.signatures(np.concatenate([p[0], q[0]]), np.concatenate([p[1], q[1]]), np.array([0, len(p[0]), len(p[0]) + len(q[0])]), 2048)
            errors.append((s[0] == s[1]).mean() - bagminhash.similarity(p, q))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.02


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = []
    for n in range(50):
        words = [f"w{k}" for k in range(50)]
        for k in rng.choice(50, rng.integers(0, 5), replace=False):
            words[k] = f"v{n}{k}"
        rows.append((n, " ".join(words)))
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_hot_groups_of_near_copies(spark, monkeypatch):
    """Groups and meetings over BLOCK: near their least member, or not; components across blocks; copies of one name over the bound."""
    monkeypatch.setattr(bagminhash, "BLOCK", 6)
    monkeypatch.setattr(bagminhash, "HOTTEST", 4)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for n in range(60):
        words, drift = list(base), n // 10
        for k in range(2 * drift):  # each ten drift from the ten before, so that the last are far from the first
            words[k * 5 % 120] = f"d{k}"
        words[int(rng.integers(0, 120))] = f"x{n}"
        rows.append((n, " ".join(words)))
    rows += [(100 + k, "the very same words in all of these") for k in range(30)] + [(200 + k, None) for k in range(20)]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_classes(rows)


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (9, a + " end")]
    got = sorted((r.doc_id, r.class_id) for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x for x in got if x[0] != 5] == [(1, 1), (7, 5), (7, 5), (9, 1)] and sorted(c for d, c in got if d == 5) == [1, 5]


def brute_row_classes(rows):
    """Each row's class id, rows being documents of their own whatever their ids: the least doc_id of its component."""
    heads = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    same = {}
    for k, (_, t) in enumerate(rows):  # texts of the same words are one node
        words = tuple((t or "").lower().encode().split())
        if words:
            same.setdefault(words, []).append(k)
    up = dict(heads)
    find = lambda k: k if up[k] == k else find(up[k])
    for ks in same.values():
        for k in ks[1:]:
            a, b = find(ks[0]), find(k)
            up[max(a, b)] = min(a, b)
    members = collections.defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    return members


def test_ids_that_repeat(spark):
    """Two nodes that share their least id don't become one class, and no text is lost."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(2, a), (5, a + " end"), (5, b), (9, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in bagminhash.classes(df).collect()) == [(2, 2), (5, 2), (5, 5), (9, 5)]
    kept = df.withColumn("h", bagminhash.text_hash()).join(bagminhash.heads(df), ["doc_id", "h"], "left_semi")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, a), (5, b)]


def test_random_ids_are_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdefgh"]
    rows = []
    for _ in range(150):
        words = str(rng.choice(texts)).split(" ")
        for k in rng.choice(40, rng.integers(0, 3), replace=False):
            words[k] = f"x{rng.integers(4)}"
        rows.append((int(rng.integers(12)), (" " if rng.random() < 0.8 else "  ").join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members = brute_row_classes(rows)
    want = collections.Counter((rows[k][0], min(rows[j][0] for j in ks)) for ks in members.values() for k in ks)
    assert collections.Counter((r.doc_id, r.class_id) for r in bagminhash.classes(df).collect()) == want
    least = {min((rows[k][0], hashlib.md5(rows[k][1].encode()).hexdigest()) for k in ks) for ks in members.values()}
    assert {tuple(r) for r in bagminhash.heads(df).collect()} == least


def test_order_of_commits_and_rules(spark):
    """Ledgers whose first commit has other rules, or another order of them, give the same digests."""
    rows = [(1, "-----BEGIN PRIVATE KEY----- token=abcdef12"), (2, "password: hunter22 AKIA" + "A" * 20 + " " + "0f" * 14), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in secrets.digests(secrets.findings(df, secrets.commit(df))).collect())
    for first, second in ((secrets.EXTRA, secrets.BASE), (secrets.RULES[::-1], secrets.RULES), (secrets.BASE[::-1], secrets.EXTRA)):
        ledger = secrets.commit(df, secrets.commit(df, secrets.empty_ledger(df), first), second)
        assert sorted(tuple(r) for r in secrets.digests(secrets.findings(df, ledger)).collect()) == want
