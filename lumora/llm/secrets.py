"""Secret scans over an incremental blob ledger, in DataFrame operations only.

A text is a blob, addressed by the SHA-256 of its content, whatever documents or versions hold it. The ledger has one
row for each blob that was scanned: the versions of the rules it was scanned by, and what they found. A scan takes from
the documents' blobs those that the ledger lacks for a rule's version, each once, runs only the rules missing, and gives
the ledger's next state; findings are joined back to all documents (or paths, or versions) that hold the blob.

A span is a kind with begin and end in code points. Both sides of a match are cut by the same pattern (the matches
themselves, and what lies between them), so begins are running sums of lengths.

Copies of a text are pre-aggregated to one blob before the shuffle. Joining back to documents is salted by the
document's whole row, so that the copies of one text don't meet in one task.

Defined results: null text counts as empty, which has no spans. Repeated rows each give a row with the same findings.
Rows with a null id stay; an empty table gives no row, and an empty ledger stays empty. Texts are scanned whole, whatever
their length. Kinds may overlap; spans go by begin, then by kind as listed. A column of the input that has the result's
name is replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import written


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose group (0: all) is shorter than `least` code points are dropped after the search."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        return self.kind + "@" + hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]


# The three base kinds, in the order in which equal begins are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds beyond the base: key blocks, signed web tokens, and prefixes that providers publish.
EXTRA = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = (*BASE, *EXTRA)
#: Shares that the rows of one blob are dealt over when findings are joined back.
SALTS = 16
#: A kind's place among all rules, whatever list it is scanned with; kinds of one's own come after them.
PLACES = {r.kind: k for k, r in enumerate(RULES)}
SPANS = "array<struct<begin:int,kind_no:int,kind:string,end:int>>"


def _gate(text: Column, rule: Rule) -> Column:
    """A cheap test that every text with a span of this rule passes."""
    need = {"assign": r"[:=]", "access": r"AKIA", "hex": r"[0-9a-f]{24}", "pem": "-----BEGIN ", "jwt": "eyJ", "forge": "gh[pousr]_", "chat": "xox"}.get(rule.kind)
    return text.rlike(need) if need else F.lit(True)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The rule's spans in the text: array<struct<begin, kind_no, kind, end>>."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    rows = F.zip_with(F.transform(found, F.length), F.transform(sized, F.length), lambda n, m: F.struct(n.alias("n"), m.alias("m")))
    rows = F.zip_with(rows, F.slice(F.transform(gaps, F.length), F.lit(1), F.size(found)), lambda r, g: F.struct(r["n"].alias("n"), r["m"].alias("m"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(s: Column, r: Column) -> Column:
        begin = s["at"] + r["g"]
        span = F.struct(begin.alias("begin"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), (begin + r["n"]).alias("end"))
        kept = F.when(r["m"] >= rule.least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((begin + r["n"]).alias("at"), kept.alias("spans"))

    return F.when(_gate(text, rule), F.aggregate(rows, start, step, lambda s: s["spans"])).otherwise(F.array().cast(SPANS))


def blob(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def empty_ledger(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(0).select(F.lit("").alias("blob"), F.array().cast("array<string>").alias("versions"), F.array().cast(SPANS).alias("spans"))


def scan(texts: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger's next state: blob, versions, spans. Rows of the ledger that the texts don't touch stay."""
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = texts.select(blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text")).groupBy("blob").agg(F.first("_text").alias("_text"))
    nothing = F.array().cast("array<string>")
    if ledger is None:
        seen = blobs.withColumn("versions", nothing).withColumn("spans", F.array().cast(SPANS))
    else:
        seen = blobs.join(ledger, "blob", "left").withColumns({"versions": F.coalesce("versions", nothing), "spans": F.coalesce("spans", F.array().cast(SPANS))})
    todo = seen.where(F.size(F.array_except(wanted, "versions")) > 0)
    new = [F.when(F.array_contains("versions", r.version), F.array().cast(SPANS)).otherwise(spans_of(F.col("_text"), r, PLACES.get(r.kind, len(RULES) + k))) for k, r in enumerate(rules)]
    # Spans of a rule's older version go when its new version is scanned.
    stale = F.filter("spans", lambda s: F.exists(F.array(*[F.lit(r.kind) for r in rules]), lambda k: (k == s["kind"]) & ~F.exists("versions", lambda v: F.array_contains(wanted, v) & (F.split_part(v, F.lit("@"), F.lit(1)) == k))))
    done = todo.select("blob", F.array_union(F.filter("versions", lambda v: ~F.exists(wanted, lambda w: F.split_part(w, F.lit("@"), F.lit(1)) == F.split_part(v, F.lit("@"), F.lit(1)))), wanted).alias("versions"), F.array_sort(F.concat(F.array_except("spans", stale), *new)).alias("spans"))
    if ledger is None:
        return done
    return ledger.join(done.select("blob"), "blob", "left_anti").unionByName(done)


def findings(docs: DataFrame, ledger: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs (documents, or paths, or versions of them) with their blobs' spans; an empty array where there is none. Only blobs
    with spans go into the join."""
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), blob(text).alias("blob"), F.pmod(F.xxhash64(*hashable), F.lit(SALTS)).alias("salt"))
    found = ledger.where(F.size("spans") > 0).select("blob", "spans", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() != name.lower()]
    return rows.join(found, ["blob", "salt"], "left").select(*kept, F.coalesce("spans", F.array().cast(SPANS)).alias(name))


def commit(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's next state after the texts of docs, written to the shared folder."""
    return written(scan(docs, ledger, rules), "blob-ledger")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans docs (column text) and gives (docs with spans, the ledger's next state)."""
    after = commit(docs, ledger, rules)
    return findings(docs, after), after


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the documents with spans."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(key, *[n(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        cut = F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["begin"] - s["at"]), F.lit(mark)).alias("out"), x["end"].alias("at"))
        longer = F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))
        return F.when((x["begin"] >= s["at"]) & ((s["at"] == 0) | (x["begin"] > s["at"])), cut).when(s["at"] == 0, cut).otherwise(longer)

    out = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)
