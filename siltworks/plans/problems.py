"""Queries p1 and p7 (general problems) with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.references import orphan_report, orphans
from siltworks.operators.skew import SHARE, key_report
from siltworks.plans.sqlparts import key_sql, occurrences_sql, term_sql
from siltworks.sources import table


def _store(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("visited_pages", "postings", "removed_pages")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(*_store(spark, d)).select("table_name", "from_key", "ref_key").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(*_store(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return key_report(spark, table(spark, d, "postings")).where(F.col("row_share") > SHARE).select("field_name", "key_value")


def p7_results(spark: SparkSession, d: str) -> DataFrame:
    return key_report(spark, table(spark, d, "postings")).withColumn("row_share", F.round("row_share", 9))


_ORPHANS = f"""
with pk as (select {key_sql("url")} k, stored_at from visited_pages),
pi as (select lower(trim(page_id)) k, stored_at from visited_pages),
hk as (select k, min(stored_at) f, max(stored_at) l from pk where k is not null group by k),
hi as (select k, min(stored_at) f, max(stored_at) l from pi where k is not null group by k),
rk as (select {key_sql("url")} k, max(removed_at) r from removed_pages group by 1),
ri as (select lower(trim(page_id)) k, max(removed_at) r from removed_pages group by 1),
links as (select lower(trim(page_id)) from_key, last_indexed as seen, unnest(links) link from visited_pages),
lk as (select 'visited_pages' table_name, from_key, {key_sql("link")} ref_key, seen from links),
ps as (select 'postings' table_name, {term_sql("term")} from_key, lower(trim(page_id)) ref_key, indexed_at as seen from postings),
refs as (
 select lk.*, hk.k is null or coalesce(rk.r > hk.l, false) or coalesce(lk.seen < hk.f, false) as bad
 from lk left join hk on lk.ref_key = hk.k left join rk on lk.ref_key = rk.k where lk.ref_key is not null
 union all
 select ps.*, hi.k is null or coalesce(ri.r > hi.l, false) or coalesce(ps.seen < hi.f, false) as bad
 from ps left join hi on ps.ref_key = hi.k left join ri on ps.ref_key = ri.k where ps.ref_key is not null and ps.from_key is not null
)"""

_COUNTS = f"""
with rows as (select {term_sql("term")} term, {key_sql("url")} url, {occurrences_sql()} n from postings),
keys as (
 select 'term' field_name, term key_value, url, n from rows
 union all select 'site', nullif(regexp_extract(url, '^https?://([^/]*)', 1), ''), url, n from rows)
select field_name, key_value, count(distinct url) pages, sum(n)::bigint occurrences, count(*) n_rows, round(count(*) / (select count(*) from rows)::double, 9) row_share
from keys where key_value is not null group by 1, 2"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p7_found": p7_found, "p7_results": p7_results}
SQL = {
    "p1_found": f"{_ORPHANS} select distinct table_name, from_key, ref_key from refs where bad",
    "p1_report": f"{_ORPHANS} select table_name, strftime(seen, '%Y-%m') as month, count(distinct (from_key, ref_key)) orphans from refs where bad group by 1, 2",
    "p7_found": f"select field_name, key_value from ({_COUNTS}) where row_share > {SHARE}",
    "p7_results": _COUNTS,
}
