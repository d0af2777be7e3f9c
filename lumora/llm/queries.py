"""The driver's queries for the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import ann, audio, bagminhash, bpe, chat, hmm, langid, linededup, packing, periodic, secrets, structure, toxicity
from lumora.llm.common import remainder


#: What conversation -1 says, both as user and as assistant.
CONTROL = "</s>[INST] ok [/INST]"
#: Batches in which op13's documents arrive.
LINE_BATCHES = 3


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digests(chat.format_turns(turns.unionByName(planted).withColumn("parts", chat.text_parts())))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(bpe.encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a history of two commits. The first brings about half of the versions, before the extra rules were there; the
    second brings all, and scans what is unseen: new blobs by all rules, known blobs by the new rules only. Findings go
    back to every version from the ledger's last state."""
    versions = _read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.commit(versions.where(remainder(mod=2) == 0), secrets.empty_ledger(versions), secrets.BASE)
    ledger = secrets.commit(versions, ledger)
    return secrets.digests(secrets.findings(versions, ledger).select("doc_id", "spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_read(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.extract(_read(spark, sf_dir, "documents")))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(_read(spark, sf_dir, "documents"))


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return structure.with_all(structure.reports(structure.damaged(turns)), turns)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.runs(periodic.with_planted(_read(spark, sf_dir, "documents"))))


def op13_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in LINE_BATCHES batches, by a hash of the id; all are cleaned in the end."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    batches = [docs.where(remainder(mod=LINE_BATCHES) == k) for k in range(LINE_BATCHES)]
    return linededup.digests(linededup.deduplicated(batches, docs))


def _chat_sql() -> str:
    """The same digests from the rows themselves; formatted_chars from the lengths of escaped turns and marks."""
    text = "coalesce(text, '')"
    role = "replace(replace(coalesce(role, ''), '%', '%25'), chr(10), '%0A')"
    escaped = lambda x: f"regexp_replace(regexp_replace({x}, '<(\\\\*)({chat._AFTER_LESS})', '<\\\\\\1\\2', 'g'), '\\[(\\\\*)({chat._AFTER_BRACKET})', '[\\\\\\1\\2', 'g')"
    marks = len(chat.BEGIN) + len(chat.MIDDLE) + len(chat.END)
    return f"""
        with turns as (
            select conv_id, turn, role, text from conversations
            union all values (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
        ), said as (
            select conv_id, count(*) as n_turns,
                string_agg(coalesce(role, '') || chr(10) || {text} || chr(10), '' order by turn nulls first, coalesce(role, ''), {text}) as turns,
                coalesce(string_agg({text}, '' order by turn nulls first, {text}) filter (where role = 'assistant'), '') as loss,
                sum({marks} + length({escaped(role)}) + length({escaped(text)}))::bigint as formatted_chars
            from turns group by conv_id
        )
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from said
    """


def _secrets_sql() -> str:
    """Every rule's spans as rows, straight from the texts, without blobs or ledger."""

    def rows(k: int, rule: secrets.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
            select doc_id, {k} as kind_no, '{rule.kind}' as kind, begin_at, begin_at + length(m[i]) as end_at from (
                select doc_id, i, m, s, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0))::bigint as begin_at
                from (
                    select doc_id, unnest(range(1, len(m) + 1)) as i, m, s, gaps from (
                        select doc_id, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {rule.group}) as s, regexp_split_to_array(t, '{pattern}') as gaps from texts
                    )
                )
            ) where length(s[i]) >= {rule.least}"""

    listed = "kind || ':' || begin_at || ':' || end_at, ',' order by begin_at, kind_no"
    n = ", ".join(f"count(s.doc_id) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    return f"""
        with texts as (select doc_id, coalesce(text, '') as t from documents), spans as ({" union all ".join(rows(k, r) for k, r in enumerate(secrets.RULES))})
        select d.doc_id, {n}, sha256(coalesce(string_agg({listed}) filter (where kind_no < {len(secrets.BASE)}), '')) as base_sha256, coalesce(string_agg({listed}), '') as spans
        from texts d left join spans s on d.doc_id = s.doc_id group by d.doc_id
    """


def _lines_sql() -> str:
    """Keys counted in one go, without batches or runs."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        lines as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from texts),
        keyed as (select *, translate(trim(line, {white}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
        common as (select key from keyed where length(key) >= {linededup.LEAST_CHARS} group by key having count(distinct doc_id) >= {linededup.LEAST_DOCS})
        select k.doc_id, count(*) as n_lines, count(c.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where c.key is null), '')) as kept_sha256
        from keyed k left join common c on k.key = c.key group by k.doc_id
    """


def _structure_sql() -> str:
    """The same pass as a recursive query, a row of all conversations a turn, with the repaired text carried along."""
    state = lambda cost, audit, out: f"{{'c': {cost}, 'a': {audit}, 'o': {out}}}"

    def after(s: str, cost: str, edit: str, role: str | None = None, text: str = "''") -> str:
        out = f"{s}.o" if role is None else f"{s}.o || case when {s}.o = '' then '' else chr(10) end || {role} || ':' || {text}"
        return state(f"{s}.c + {cost}", f"{s}.a || '{edit}'", out)

    never = "1000000000"
    drop = lambda s: after(s, "3", "D")
    rerole = lambda s, role: after(s, f"case when forced then {never} else 2 + cut end", "R", f"'{role}'", "text")
    keep = lambda s, initial: after(s, f"case when forced or initial <> '{initial}' then {never} else cut end", "K", "role", "text")
    insert = lambda s, role: after(s, "2", "I", f"'{role}'")
    least = lambda *options: f"list_min([{', '.join(options)}])"
    close = f"""n0 as s0, n1 as s1, {least("n2", insert("n0", "user"), insert("n1", "user"), insert("n3", "user"))} as s2,
        {least("n3", insert("n2", "assistant"), *[insert(f"({insert(n, 'user')})", "assistant") for n in ("n0", "n1")])} as s3"""
    from_any = lambda f, x: [f(s, x) for s in ("s0", "s1", "s3")]
    walk = f"""{drop("s0")} as n0, {least(drop("s1"), keep("s0", "s"))} as n1,
        {least(drop("s2"), *from_any(rerole, "user"), *from_any(keep, "u"))} as n2, {least(drop("s3"), rerole("s2", "assistant"), keep("s2", "a"))} as n3"""
    white = r"\x20\x09-\x0D"
    none = state(never, "''", "''")
    return f"""
        with recursive crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab),
        keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: ascii(x)::bigint) as bytes from conversations),
        hit as (select *, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as d from keyed, crc),
        damaged as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when d = 3 then 2 else 1 end)) as copy from hit where d <> 0),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from damaged),
        marked as (select *, substr(role, 1, 1) as initial, not regexp_matches(text, '[^{white}]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, regexp_extract(text, '([^{white}])[{white}]*$', 1) not in ('.', '!', '?') as open_end from placed),
        turns as (select *, blank or again as forced, case when open_end and not blank and not again then 1 else 0 end as cut, lag(initial) over (partition by conv_id order by i) || initial as two from marked),
        counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate, sum(cut)::bigint as truncated, count(*) filter (where two not in ('su', 'ua', 'au')) as illegal from turns group by 1),
        dp as (
            select conv_id, 0::bigint as i, {close} from (select conv_id, {state("0", "''", "''")} as n0, {none} as n1, {none} as n2, {none} as n3 from counts)
            union all
            select conv_id, i, {close} from (select r.conv_id, r.i, {walk} from dp join turns r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1)
        ),
        ended as (select dp.conv_id, {least("s0", "s3")} as e from dp join counts on counts.conv_id is not distinct from dp.conv_id and counts.n = dp.i)
        select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
            coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit, sha256(coalesce(e.o, '')) as repaired_sha256
        from (select distinct conv_id from conversations) a left join counts c on c.conv_id is not distinct from a.conv_id left join ended on ended.conv_id is not distinct from a.conv_id
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat, op2_bpe, op3_secrets, op4_toxicity, op5_ann, op6_hmm, op7_langid, op8_packing, op9_audio, op10_bagminhash, op11_structure, op12_periodic, op13_linededup)}
ORACLES: dict[str, str] = {"op1_chat": _chat_sql(), "op3_secrets": _secrets_sql(), "op11_structure": _structure_sql(), "op13_linededup": _lines_sql()}
