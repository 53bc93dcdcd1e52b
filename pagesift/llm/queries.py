"""The queries pN_... of the problems, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import contamination, contributor_cap, encoding, history, leximin, link_spam, mixture, near_duplicates, residue
from pagesift.session import scratch, table, written


P3_FOUND = r"""
with item as (
  select distinct i.batch_id, i.item_id, i.score, b.host_cap,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(trim(i.url, ' ' || chr(9) || chr(10) || chr(13) || chr(12288))), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[^:]*$', ''), '^www\.', '') as host
  from fetched_item i join search_batch b using (batch_id)
), placed as (
  select *, row_number() over (partition by batch_id, host order by case when isnan(score) then null else score end desc nulls last, item_id) as r
  from item where host <> ''
)
select distinct item_id from placed where r > host_cap
"""

P7_FOUND = r"""
with item as (
  select distinct item_id, regexp_replace(lower(translate(passage, WIDE, NARROW)), '[^\p{L}\p{Nd}\p{Nl}\p{No}]', '', 'g') as t from bench_item
), runs as (
  select distinct item_id, substr(t, i::bigint, 50) as run from item, unnest(range(1, length(t) - 48)) as u(i)
), doc as (
  select doc_id, regexp_replace(lower(translate(text, WIDE, NARROW)), '[^\p{L}\p{Nd}\p{Nl}\p{No}]', '', 'g') as t from documents
), own as (
  select doc_id, substr(t, i::bigint, 50) as run from doc, unnest(range(1, length(t) - 48)) as u(i)
)
select distinct item_id, doc_id from own join runs using (run)
""".replace("WIDE", "'" + "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])) + "'").replace("NARROW", "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'")

P5_LEXIMIN = """
with long as (
  select query, eval_id, unnest([1, 2, 3]) as c, unnest([authority, coverage, rel]) as v from eval_item where query is not null
), present as (
  select * from long where v is not null and not isnan(v) and v <> -1
), shares as (
  select query, c, v, (2 * sum(count(*)) over (partition by query, c order by v) - count(*)) / (2 * sum(count(*)) over (partition by query, c)) as p
  from present group by query, c, v
), placed as (
  select l.query, l.eval_id, coalesce(s.p, 0.0) as p from long l left join shares s on l.query = s.query and l.c = s.c and l.v = s.v
), vectors as (
  select query, eval_id, list_sort(list(p)) as ps from placed group by query, eval_id
)
select query, eval_id, ps[1] as p1, ps[2] as p2, ps[3] as p3,
  row_number() over (partition by query order by ps[1] desc, ps[2] desc, ps[3] desc, eval_id) as rank
from vectors
"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.History(spark, scratch(spark, "history")).accepted(table(spark, sf_dir, "ledger_entry")).select("entry_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "ledger_entry")).select("entry_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "fetched_item").select("batch_id", contributor_cap.host().alias("host"), "item_id", "score")
    capped = items.join(table(spark, sf_dir, "search_batch").select("batch_id", "host_cap"), "batch_id")
    return contributor_cap.over_cap(capped, ["batch_id", "host"], "host_cap", "item_id", "score").select("item_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.alike_entries(table(spark, sf_dir, "ledger_entry"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "ledger_entry"))


def p5_leximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leximin.leximin(table(spark, sf_dir, "eval_item"), "query", "eval_id", ["authority", "coverage", "rel"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(table(spark, sf_dir, "ledger_entry")).select("entry_id").distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(table(spark, sf_dir, "ledger_entry"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_item"))
    return found.where(F.col("run") >= contamination.LEAST_RUN).select("item_id", "doc_id")


def _vocabulary() -> str:
    return os.environ.get("PAGESIFT_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = written(mixture.token_counts(table(spark, sf_dir, "documents"), _vocabulary()), "tokens")
    return mixture.mix_sources(counted, table(spark, sf_dir, "source_mix"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_spam.stuffed(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_leximin": p5_leximin,
        "p6_found": p6_found,
        "p6_restored": p6_restored,
        "p7_found": p7_found,
        "p8_mixture": p8_mixture,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
    }


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND, "p5_leximin": P5_LEXIMIN, "p7_found": P7_FOUND}
