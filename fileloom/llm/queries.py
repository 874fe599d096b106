"""The queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.llm import chat, decontam, html_extract, mixing, pii, quality, secret_scan, sharding, simhash, suffix_dedup
from fileloom.sources.tables import read_table as table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(secret_scan.labelled_findings()))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.train(docs, labels))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = spark.sql("select -1L as conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digest(chat.format_conversations(turns.unionByName(told)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "text_hash")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_pii, op4_suffix_dedup, op5_sharding, op6_chat_formatting, op7_decontamination, op8_html_extraction, op9_simhash, op10_mixing)}

_MARK = r"([\[<])(\\*)(/?(?:INST|ROLE|TURN|:)\]|/?s>)"

OP6 = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
runs as (
  select *, lag(role) over w is distinct from role as opens, lead(role) over w is distinct from role as closes,
    row_number() over w as k
  from turns window w as (partition by conv_id order by turn nulls first, role, text)),
pieces as (
  select *, length(regexp_replace(text, '{_MARK}', '\1\\\2\3', 'g'))
    + case when not opens then 6 when role = 'user' then 6 when role = 'assistant' then 3
           else 9 + length(regexp_replace(role, '{_MARK}', '\1\\\2\3', 'g')) end
    + case when not closes then 0 when role = 'user' then 7 when role = 'assistant' then 4 else 7 end as chars
  from runs)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from pieces group by conv_id
"""

_CASE = " ".join(f"when {k} then {float(w)!r}" for k, w in enumerate(mixing.WEIGHTS))
_COPIES = "least(floor(u + n * rate) - floor(u + (n - 1) * rate), 3)::bigint"

OP10 = rf"""
with sized as (
  select doc_id, coalesce(source, '') as src, (source is null)::int as nul,
    ('0x' || substr(md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 4))::int % {mixing.LANES} as lane,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
keyed as (select *, length(size::varchar) * 100 + substr(size::varchar, 1, 2)::int as band from sized),
sources as (select src, nul, sum(size)::bigint as source_size from keyed group by 1, 2),
weighed as (
  select *, source_size::double * 3 as full_size,
    case (row_number() over (order by nul, src) - 1) % {len(mixing.WEIGHTS)} {_CASE} end::double as weight from sources),
levels as (
  select *, (sum(source_size) over ())::double - coalesce(sum(full_size) over before, 0) as remaining,
    sum(weight) over () - coalesce(sum(weight) over before, 0) as rest, full_size / weight as ratio
  from weighed window before as (order by full_size / weight, nul, src rows between unbounded preceding and 1 preceding)),
level as (select remaining / rest as level from levels where ratio > remaining / rest order by ratio, nul, src limit 1),
goal as (
  select src, nul, source_size, least(full_size, coalesce((select level from level) * weight, full_size)) as target from levels),
placed as (
  select k.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size::double else 0 end as rate,
    ('0x' || substr(md5(k.src), 1, 5))::bigint / 1048576.0::double as u,
    row_number() over (partition by k.nul, k.src order by band, lane, size, doc_id nulls first) as n
  from keyed k join goal g using (src, nul))
select doc_id, size, source_size, target, {_COPIES} * size as taken from placed
"""

ORACLE_SQL = {"op6_chat_formatting": OP6, "op10_mixing": OP10}
