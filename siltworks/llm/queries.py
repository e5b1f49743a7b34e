"""Queries of the problems tagged llm, with SQL where SQL can state them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import abuse, lines, packing, stuffing, terms, tokens
from siltworks.plans.sqlparts import key_sql, occurrences_sql, term_sql
from siltworks.sources import table


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.labelled_pages(table(spark, d, "visited_pages"), table(spark, d, "page_labels"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(_labelled(spark, d))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("page_id", "filler")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.furniture_lines(_labelled(spark, d))


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.main_text(table(spark, d, "visited_pages"), table(spark, d, "page_labels"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "visited_pages"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, d, "visited_pages"))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = lines.site_blocks(table(spark, d, "visited_pages"))
    return blocks.where("n_lines > 1").groupBy("site", "n_lines").agg(F.count("*").alias("blocks"), F.max("n_pages").alias("most_pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.characteristic_terms(spark, table(spark, d, "postings"))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.score_terms(spark, table(spark, d, "postings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "postings")).where("mark is not null").select("term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "postings"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p9_packed(spark, d))


_NEWEST = f"""
with rows as (select {term_sql("term")} term, {key_sql("url")} url, {occurrences_sql()} n, indexed_at from postings),
newest as (select url, term, arg_max(n, (indexed_at, n))::bigint n from rows where term is not null and url is not null group by 1, 2),
total as (select count(distinct url) n_pages from newest),
counts as (select term, count(*) df, sum(n)::bigint occurrences from newest group by 1)"""

_FORM = r"regexp_replace(trim(regexp_replace(lower({0}), '[ \t\r\x{{00A0}}]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g')"
_SITE = "regexp_extract({0}, '^https?://([^/]*)', 1)"
_SITE_LINES = f"""
with rows as (select {key_sql("url")} page, string_split(content, chr(10)) raw from visited_pages where content is not null),
own as (select distinct {_SITE.format("page")} site, page, {_FORM.format("l.x")} line from rows, unnest(raw) as l(x) where page is not null),
pages as (select {_SITE.format("page")} site, count(distinct page) n from rows where page is not null group by 1),
found as (select site, line from own join pages using (site) where line <> '' group by site, line, n having count(*) >= 3 and count(*) * 20 >= n)"""
_LINES = f"{_SITE_LINES} select site, line from found"
_CLEANED = f"""{_SITE_LINES},
per as (select site, list(line) lines from found group by 1),
all_rows as (select page_id, url, content, string_split(content, chr(10)) raw, {_SITE.format(key_sql("url"))} site from visited_pages),
cut as (select page_id, url, raw, content, list_filter(raw, lambda x: not coalesce(list_contains(lines, {_FORM.format("x")}), false)) kept from all_rows left join per using (site))
select page_id, url, case when content is not null then array_to_string(kept, chr(10)) end kept, (len(raw) - len(kept))::int removed from cut"""
_BLOCKS = f"""{_SITE_LINES},
texts as (select {_SITE.format("page")} site, page, list_filter(list_transform(raw, lambda x: {_FORM.format("x")}), lambda x: x <> '') f from rows where page is not null),
starts as (select site, page, f, unnest(range(1, len(f) + 1)) a from texts),
spans as (select site, page, f[a:e] b from (select *, unnest(range(a, len(f) + 1)) e from starts)),
frequent as (select site, b, count(distinct page) k from spans join pages using (site) group by site, b, n having k >= 3 and k * 20 >= n),
longer as (select site, b[1:len(b) - 1] b, max(k) m from frequent where len(b) > 1 group by 1, 2)
select site, len(frequent.b)::int n_lines, count(*) blocks, max(k) most_pages from frequent left join longer using (site, b) where len(frequent.b) > 1 and (m is null or m < k) group by 1, 2"""

QUERIES = {
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p3_found": p3_found,
    "p3_cleaned": p3_cleaned,
    "p3_blocks": p3_blocks,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_main_text": p6_main_text,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}
SQL = {
    "p3_found": _LINES,
    "p3_cleaned": _CLEANED,
    "p3_blocks": _BLOCKS,
    "p4_found": f"""{_NEWEST},
scored as (select url, term, n * ln((select n_pages from total) / (1 + df)) s from newest join counts using (term) where df >= 2),
top as (select *, max(s) over (partition by url) m from scored)
select url, min(term) term from top where s > m - 1e-9 group by url""",
    "p5_found": f"""{_NEWEST}
select term, case when df <= 2 then 'rare' else 'common' end mark from counts, total where df <= 2 or df * 4 > n_pages""",
    "p5_counts": f"""{_NEWEST}
select term, occurrences, df, case when df <= 2 then 'rare' when df * 4 > n_pages then 'common' end mark from counts, total""",
}
