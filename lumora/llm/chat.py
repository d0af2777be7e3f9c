"""Chat formatting, in DataFrame operations only.

A message is an array of typed parts. A visitor flattens them, in order: text is escaped, and an image, audio or document
part becomes a placeholder, with its reference and its expanded number of tokens recorded as an attachment. A
template puts marks around each turn. A conversation is an array of segments, each under the loss mask or not; the
formatted string is the segments' texts, one after another.

Escaping is reversible: wherever a text has a control string, or one with backslashes after its first character, one more
backslash goes there; unescape() takes one out. So no text can hold a control string, and the formatted string
can be read back without doubt.

Defined results: a part of a type not listed here keeps its text, and gives the placeholder of OTHER if it has none; its
type, reference and tokens are recorded as an attachment, so nothing is lost. Null text and null role count as empty; turns go by turn (null first), then role, then text, so that ties
and repeated rows have one order; an empty table gives no conversation. Turns are put together in runs of RUN first,
so that a conversation with very many turns doesn't pass one task turn by turn. Texts of any length are formatted whole.
Other columns than the four named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns that are put together before a conversation is.
RUN = 256
# Strings that chat templates read as marks, by what follows their first character.
_AFTER_LESS = r"\|(?:im_start|im_end|image|audio|document|part|endoftext|startoftext)\|>|/?s>|</?SYS>>"
_AFTER_BRACKET = r"/?INST\]"
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|part|>"
#: Tokens that an attachment expands to where its part doesn't say.
TOKENS = {"image": 576, "audio": 250, "document": 1024}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(" + _AFTER_LESS + ")", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(" + _AFTER_BRACKET + ")", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(" + _AFTER_LESS + ")", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(" + _AFTER_BRACKET + ")", r"[$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: str = "text") -> Column:
    """Plain text as the one part of a message."""
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(PARTS)


def _visit(part: Column) -> Column:
    """One part as text."""
    out = F.when(F.coalesce(part["type"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(F.coalesce(escape(part["text"]), F.lit(OTHER)))


def _tokens(part: Column) -> Column:
    given = F.when(part["type"] == "image", TOKENS["image"])
    for kind in ("audio", "document"):
        given = given.when(part["type"] == kind, TOKENS[kind])
    return F.coalesce(part["tokens"], given.cast("int"), F.lit(0))


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, parts. Per conversation: conv_id, n_turns, segments (array<struct<text, loss>>), formatted,
    attachments (array<struct<turn, position, type, ref, tokens>>), attachment_tokens."""
    role = F.coalesce("role", F.lit(""))
    body = F.array_join(F.transform("parts", _visit), "")
    attached = F.filter(F.transform("parts", lambda p, k: F.struct(F.col("turn").alias("turn"), k.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["type"] != "text")
    row = F.struct(F.col("turn"), role.alias("role"), F.coalesce(body, F.lit("")).alias("body"), F.coalesce(attached, F.array().cast("array<struct<turn:bigint,position:int,type:string,ref:string,tokens:int>>")).alias("attached"))
    runs = turns.withColumn("turn", F.col("turn").cast("long")).groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("_run")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_run", "_rows"))).alias("_runs")).select("conv_id", F.flatten(F.transform("_runs", lambda r: r["_rows"])).alias("_rows"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "_rows",
            lambda r: F.array(
                segment(F.concat(F.lit(BEGIN), escape_role(r["role"]), F.lit(MIDDLE)), F.lit(False)),
                segment(r["body"], r["role"] == learn),
                segment(F.lit(END), F.lit(False)),
            ),
        )
    )
    attachments = F.flatten(F.transform("_rows", lambda r: r["attached"]))
    return (
        whole.select("conv_id", F.size("_rows").cast("long").alias("n_turns"), segments.alias("segments"), attachments.alias("attachments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))
    )


def read_back(formatted: Column) -> tuple[Column, Column]:
    """The roles and the texts (placeholders in place) of a formatted string."""
    turn = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
    take = lambda group, undo: F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(group)), undo)
    return take(1, unescape_role), take(2, unescape)


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns: turns from the formatted string, learnt text from the segments under the mask."""
    roles, texts = read_back(F.col("formatted"))
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = chats.withColumns({"_roles": roles, "_texts": texts, "_learnt": learnt})
    turns = F.array_join(F.zip_with("_roles", "_texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_roles").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
