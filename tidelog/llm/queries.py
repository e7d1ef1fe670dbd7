"""The registered queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, fingerprint, mixing, neardup, quality, sharding, substring, tokenfile, toxicity, urlfilter
from tidelog.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urlfilter.RULES)
ORACLES["op1_url_filter"] = f"""
with rules(verdict, host, path) as (values {_RULE_ROWS}),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
fits as (
  select s.page_id, s.host as h, s.path as p, r.host || r.path as rule, r.verdict,
    row_number() over (partition by s.page_id order by length(r.host) desc, length(r.path) desc) as k
  from split s join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path))
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join (select * from fits where k = 1) f using (page_id)
"""


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


@query
def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, folder).withColumnRenamed("key", "doc_id")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


ORACLES["op7_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, len(words) as n_words, unnest(words) as word, generate_subscripts(words, 1) as i from w),
g as (select doc_id, n_words, word, i, case when i + 34 <= n_words then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 34 following) end as gram from p),
t as (select gram from g where gram is not null group by gram having count(*) > 1),
m as (select g.doc_id, g.n_words, g.word, g.i, max(case when t.gram is not null then 1 else 0 end) over (partition by g.doc_id order by g.i rows between 34 preceding and current row) as gone from g left join t on g.gram = t.gram),
k as (select doc_id, sum(gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '') as kept from m group by doc_id)
select w.doc_id, cast(len(w.words) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k using (doc_id)
"""


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents"))


@query
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))
