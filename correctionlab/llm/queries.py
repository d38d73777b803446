"""The queries of this folder over the test tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from correctionlab.llm import chat, circulant, content_sort, decontaminate, fill_middle, language_id, license_scan, mixing, pii, secret_scan, simhash, token_align, token_files
from correctionlab.llm.common import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    formatted = chat.format_chat(rows.select("conv_id", "turn", "role", F.array(part).alias("parts")))
    turns = chat.read_turns(F.col("formatted"))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_table(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def _of_kind(kind: str):
    return F.filter("base", lambda s: s["kind"] == kind)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.minhash_groups(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align_tokenizers(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restored(fill_middle.fill_in_middle(documents(spark, sf_dir)))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_chat_format, op3_secret_scan, op4_content_sort, op5_language_id, op6_decontamination, op7_token_frames, op8_mixing, op9_license_scan,
    op10_personal_data, op11_circulant_minhash, op12_token_alignment, op13_fill_in_middle)}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    known = {license_scan.normal(s): name for name, of in license_scan.SENTENCES.items() for s in of}
    table_of = ", ".join(f"({_sql_text(s)}, {_sql_text(n)})" for s, n in known.items())
    steps, last = [], "s"
    for k, (name, sequence) in enumerate(license_scan.RULES):
        needle = _sql_text("".join(f",{i}," for i in sequence))
        steps.append(f"r{k} as (select *, contains(rest, {needle}) as hit, replace(rest, {needle}, ';') as next from {last}), "
                     f"q{k} as (select * exclude (rest, hit, next, names), next as rest, case when hit then list_append(names, {_sql_text(name)}) else names end as names from r{k})")
        last = f"q{k}"
    return rf"""
with known(sentence, name) as (values {table_of}),
sentences as (
  select doc_id, rn, generate_subscripts(p, 1) as k, unnest(p) as sentence from (
    select doc_id, row_number() over () as rn, string_split_regex(coalesce(text, ''), '[.!?;]+[\x20\x09-\x0D]+|[\x0A\x0D]+') as p from documents)),
found as (
  select rn, string_agg(name, ',' order by k) as ids from (
    select rn, k, trim(regexp_replace(lower(sentence), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as sentence from sentences) join known using (sentence) group by rn),
s as (
  select d.doc_id, coalesce(f.ids, '') as sentences, case when f.ids is null then '' else ',' || replace(f.ids, ',', ',,') || ',' end as rest, []::varchar[] as names
  from (select distinct doc_id, rn from sentences) d left join found f using (rn)),
{", ".join(steps)}
select doc_id, sentences, array_to_string(list_sort(list_distinct(names)), ',') as licenses, len(list_distinct(names)) as n_licenses from {last}"""


ORACLES = {
    "op2_chat_format": r"""
with rows as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (select *, length(replace(replace(text, '%', '%0'), '<', '%1')) + length(role) + length('<turn>') + 1 + length('</turn>') + 1 as chars from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id""",
    "op4_content_sort": r"""
with n as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by content) as group_size,
  row_number() over w = 1 as kept, sha256(content) as text_sha256
from n window w as (partition by content order by chars desc, doc_id)""",
    "op9_license_scan": _license_sql(),
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (
  select doc_id, text, length(text) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as p, greatest(h1 % (n + 1), h2 % (n + 1)) as q,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
c as (select *, substring(text, 1, p) as prefix, substring(text, p + 1, q - p) as middle, substring(text, q + 1, n - q) as suffix from f)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from c""",
}
