"""Queries of the crawl, index, rank and search operators over whole tables, with their SQL."""

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import html, text, urls
from siltworks.functions.porter import stem_sql, with_stem
from siltworks.operators import crawl, graph, index, indexing, search, store, suggest
from siltworks.operators.postings import indexed
from siltworks.plans.sqlparts import key_sql
from siltworks.session import path_bytes, shared_folder
from siltworks.sources import table
from siltworks.streaming import incremental

QUERY, PHRASE, TERM, PREFIX = "quiet river museum", '"knows why"', "river", "the "
ROBOTS = "User-agent: *\nDisallow: /guides\nDisallow:\nUser-agent: OtherBot\nDisallow: /\nUser-agent: MyCrawler/1.0\nDisallow: /item/q"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- sources of the queries ----


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "visited_pages")


def _current(s: SparkSession, d: str) -> DataFrame:
    """The newest row with content of each crawl key, as ``url, title, content, links, page_rank, h1, h2, h3``."""
    p = _pages(s, d)
    rows = p.where("content is not null").withColumn("key", urls.page_key(p["url"])).where("key is not null")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("stored_at"), F.desc("page_id"), F.desc("crawled_at")))
    none = F.array().cast("array<string>")
    h1 = F.when(F.col("title").isNull(), none).otherwise(F.array("title"))
    return rows.withColumn("nth", nth).where("nth = 1").select(F.col("key").alias("url"), "title", "content", "links", "page_rank", F.lower(F.trim("page_id")).alias("page_id"), h1.alias("h1"), none.alias("h2"), none.alias("h3"))


_CURRENT = f"""cur as (
 select key as url, title, content, links, page_rank from (
  select *, row_number() over (partition by key order by stored_at desc, page_id desc, crawled_at desc) nth
  from (select *, {key_sql("url")} as key from visited_pages where content is not null) where key is not null) where nth = 1)"""

_S = r"[ \t\n\x0B\f\r]"


def _words(t: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    letters = rf"regexp_replace(lower({t}), '[^a-z \t\n\x0B\f\r]', '', 'g')"
    kept = f"list_filter(string_split_regex({letters}, '{_S}+'), lambda w: length(w) > 2 and w not in ({stop}))"
    return f"list_transform({kept}, lambda w: case when regexp_matches(w, '(ing|ed)$') then substring(w, 1, length(w) - 3) else w end)"


def _tokens(source: str, key: str, t: str) -> str:
    """CTEs toks(key, position, token), vocab(token, term), counted(key, position, term) and tfs(key, term, frequency, tf, positions)."""
    return f"""lists as (select {key}, list_filter({_words(t)}, lambda w: w <> '') l from {source}),
toks as (select * from (select {key}, unnest(l) token, generate_subscripts(l, 1) - 1 as position from lists) where length(token) > 2),
vocab as materialized ({stem_sql("select distinct token from toks", "token", "term")}),
counted as materialized (select {key}, position, token, term from toks join vocab using (token)),
tfs as (select {key}, term, count(*)::int frequency, count(*) / sum(count(*)) over (partition by {key}) tf, list_sort(list(position::int)) positions from counted group by 1, 2)"""


_DOC = _tokens("documents", "doc_id", "text")


def _snippets(source: str, key: str, t: str) -> str:
    """CTEs wl(key, words) and snips(key, term, at, snippet) of every raw word."""
    split = f"string_split_regex({t}, '{_S}+')"
    return f"""wl as materialized (select {key}, case when l[-1] = '' then l[:-2] else l end words from (select {key}, {split} l from {source} where {t} is not null)),
wx as materialized (select {key}, unnest(words) word, generate_subscripts(words, 1) - 1 as spot from wl),
wv as materialized ({stem_sql("select distinct lower(word) as lw from wx", "lw", "stem")}),
ws as materialized (select {key}, list(stem order by spot) stems from wx join wv on lower(word) = lw group by 1),
occ as (select {key}, words, stems, unnest(stems) term, generate_subscripts(stems, 1) - 1 as spot from wl join ws using ({key})),
cut as (select *, len(words) n, greatest(0, spot - 30) a, least(len(words), greatest(0, spot - 30) + 60) e from occ where length(term) > 0),
win as (select *, case when e - a < 60 then greatest(0, e - 60) else a end s from cut),
snips as (select {key}, term, spot, trim(case when s > 0 then '... ' else '' end || array_to_string(list_transform(range(s + 1, e + 1), lambda i: case when stems[i] = term then '<b>' || words[i] || '</b>' else words[i] end), ' ') || case when e < n then ' ...' else '' end, ' ') snippet from win)"""


# ---- urls ----


@query(f"select page_id, {key_sql('url')} as key from visited_pages")
def url_crawl_key(s, d):
    return _pages(s, d).select("page_id", urls.crawl_key(F.col("url")).alias("key"))


_INDEX_KEY = "case when url is null or url = '' or regexp_matches(url, '^(javascript:|mailto:|#)') then null else regexp_replace(split_part(case when regexp_matches(url, '^https?://') then url else 'https://' || url end, '#', 1), '/+$', '') end"


@query(f"select page_id, {_INDEX_KEY} as key from visited_pages")
def url_index_key(s, d):
    return _pages(s, d).select("page_id", urls.index_key(F.col("url")).alias("key"))


@query("select page_id, coalesce(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '/+$', ''), '') as key from visited_pages")
def url_rank_key(s, d):
    return _pages(s, d).select("page_id", urls.rank_key(F.col("url")).alias("key"))


def _domain(u: str) -> str:
    host = f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1), '^www\\.', '')"
    return f"lower(array_to_string(string_split({host}, '.')[-2:], '.'))"


@query(f"select page_id, {_domain('url')} as domain from visited_pages")
def url_domain(s, d):
    return _pages(s, d).select("page_id", urls.domain(F.col("url")).alias("domain"))


@query(f"select page_id, {_domain('url')} as base from visited_pages")
def url_base(s, d):
    return _pages(s, d).select("page_id", urls.base_url(F.col("url")).alias("base"))


@query("select page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#:]*)', 1) as base from visited_pages")
def url_robots_base(s, d):
    return _pages(s, d).select("page_id", urls.robots_base(F.col("url")).alias("base"))


@query(f"select page_id, link, {_domain('url')} = {_domain('link')} as same from (select page_id, url, unnest(links) link from visited_pages) where regexp_matches(link, '^(?i)https?://')")
def same_domain(s, d):
    rows = _pages(s, d).select("page_id", "url", F.explode("links").alias("link")).where(F.col("link").rlike("^(?i)https?://"))
    return rows.select("page_id", "link", urls.same_domain(F.col("url"), F.col("link")).alias("same"))


# ---- store ----


@query("select distinct url from visited_pages where url is not null")
def visited_distinct(s, d):
    return store.distinct_values(_pages(s, d), "url")


@query("select distinct fingerprint from visited_pages where fingerprint is not null")
def fingerprints_distinct(s, d):
    return store.distinct_values(_pages(s, d), "fingerprint")


@query("select distinct term from term_stats where term is not null")
def terms_distinct(s, d):
    return store.distinct_values(table(s, d, "term_stats"), "term")


@query("select count(*) as n from visited_pages")
def doc_count(s, d):
    return _pages(s, d).agg(F.count("*").alias("n"))


@query("select distinct p.url from (select url from pending where url is not null) p where p.url not in (select url from visited_pages where coalesce(is_indexed, false))")
def not_indexed(s, d):
    return store.not_indexed(table(s, d, "pending").where("url is not null"), _pages(s, d)).select("url").distinct()


@query("select url, unnest(links) as link from visited_pages")
def page_links_stored(s, d):
    return store.page_links(_pages(s, d))


@query("select term, url, frequency from postings where term in ('river', 'museum')")
def term_lookup(s, d):
    return store.lookup(table(s, d, "postings"), ["river", "museum"]).select("term", "url", "frequency")


@query("select t.term, coalesce(max(s.df), 0) as df from (select distinct term from postings where term is not null) t left join term_stats s on t.term = s.term group by 1")
def df_lookup(s, d):
    stats = table(s, d, "term_stats").groupBy("term").agg(F.max("df").alias("df"))
    return store.document_frequency(table(s, d, "postings").select("term").where("term is not null"), stats)


@query("select v.page_id, v.url, coalesce(c.is_indexed, v.is_indexed) as is_indexed from visited_pages v left join (select distinct url, true as is_indexed from pending where url is not null) c on v.url = c.url")
def pages_updated(s, d):
    changes = table(s, d, "pending").where("url is not null").select("url").distinct().withColumn("is_indexed", F.lit(True))
    return store.update_pages(_pages(s, d), changes, ["is_indexed"]).select("page_id", "url", "is_indexed")


@query("select url from pending")
def start_urls(s, d):
    return crawl.start_urls(table(s, d, "pending"), s.createDataFrame([("https://example.org/",)], "url string"))


# ---- html ----


def _html(s: SparkSession, d: str) -> DataFrame:
    """Pages of the store set as HTML, with what a parser must not trip over."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    t = esc(F.coalesce("title", F.lit("")))
    lines = F.array_join(F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("<br></p>"))), "\n")
    anchors = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit('<a class="x" href="'), esc(x), F.lit('">go</a>'))), " ")
    page = F.concat(F.lit("<html><head><title> "), t, F.lit('</title><script>f("</p>")</script></head><body class="b"><!-- <h4>no</h4> --><H1>'), t, F.lit("</H1><h2 class=x>"), t, F.lit(" &#8211; II</h2><H3>III&nbsp;&eacute; "), t, F.lit("</H3>"), lines, F.lit("<ul><li>it<b>em</b> <p>inner</p></li></ul>"), anchors, F.lit("</body></html>"))
    return _current(s, d).select("url", page.alias("html"))


def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'), ' ')"


_TITLE = _sq("coalesce(title, '')")
_SECOND, _THIRD = _sq("coalesce(title, '') || ' – II'"), _sq("'III é ' || coalesce(title, '')")


@query(f"with {_CURRENT} select url, {_TITLE} as title from cur")
def page_title(s, d):
    return _html(s, d).select("url", html.title(F.col("html")).alias("title"))


@query(f"with {_CURRENT} select url, [true, true, true] as headings, [{_TITLE}] as h1, [{_SECOND}] as h2, [{_THIRD}] as h3 from cur")
def page_headings(s, d):
    return _html(s, d).select("url", html.headings(F.col("html")).alias("headings"), *[html.heading_texts(F.col("html"), k).alias(f"h{k}") for k in (1, 2, 3)])


@query(f"with {_CURRENT} select url, links from cur where len(list_filter(links, lambda x: x is null or not regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:'))) = 0")
def page_links(s, d):
    plain = _current(s, d).where("not exists(links, x -> x is null or not x rlike '^[A-Za-z][A-Za-z0-9+.-]*:')").where("links is not null")
    return _html(s, d).join(plain.select("url"), "url", "left_semi").select("url", html.links(F.col("html"), F.col("url")).alias("links"))


@query()
def page_links_all(s, d):
    """As page_links, for every current page: blank, relative and fragment links are resolved against the page's key; a null is no anchor."""
    return _html(s, d).select("url", html.links(F.col("html"), F.col("url")).alias("links"))


@query(f"with {_CURRENT} select url, {_TITLE} || ' ' || {_SECOND} || ' ' || {_THIRD} || ' ' || array_to_string(list_transform(string_split(content, chr(10)), lambda l: {_sq('l')} || ' '), '') || 'item inner inner ' as content from cur")
def page_content(s, d):
    return html.block_text(_html(s, d), "url", "html")


@query(f"with {_CURRENT} select url, {_sq("coalesce(title, '') || ' ' || coalesce(title, '') || ' – II III é ' || coalesce(title, '') || ' ' || content || ' '")} || ' item inner' || case when len(links) > 0 then ' ' || array_to_string(list_transform(list_filter(links, lambda x: x is not null), lambda x: 'go'), ' ') else '' end as body from cur")
def page_text(s, d):
    return _html(s, d).select("url", html.full_text(F.col("html")).alias("body"))


@query(f"with {_CURRENT} select url, regexp_replace(regexp_replace(content, '\\r?\\n', ' ', 'g'), '<[^>]*>', '', 'g') as stripped from cur")
def tags_stripped(s, d):
    return _current(s, d).select("url", html.strip_tags(F.col("content")).alias("stripped"))


# ---- text ----

_FP = rf"regexp_replace(lower(regexp_replace(regexp_replace(strip_accents(coalesce(title, '') || coalesce(text, '')), '[^\x00-\x7f]', '', 'g'), '{_S}+', ' ', 'g')), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(f"select doc_id, to_base64(unhex(md5({_FP}))) as fingerprint from documents")
def fingerprint(s, d):
    return table(s, d, "documents").select("doc_id", text.fingerprint(F.col("title"), F.col("text")).alias("fingerprint"))


@query(f"select min(doc_id) as doc_id, fingerprint from (select doc_id, md5({_FP}) as fingerprint from documents) where fingerprint not in (select fingerprint from visited_pages where fingerprint is not null) group by 2")
def content_dedup(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("url"), F.md5(text.fingerprint_text(F.col("title"), F.col("text"))).alias("fingerprint"))
    return crawl.first_contents(rows, store.distinct_values(_pages(s, d), "fingerprint")).select(F.col("seq").alias("doc_id"), "fingerprint")


@query(f"select doc_id, trim(array_to_string({_words('text')}, ' '), ' ') as norm from documents")
def normalized_text(s, d):
    return table(s, d, "documents").select("doc_id", text.index_normalize(F.col("text")).alias("norm"))


@query(f"with {_DOC} select doc_id, position::int as position, token, term from counted")
def token_positions(s, d):
    return index.tokens(table(s, d, "documents"), "doc_id", "text")


@query(f"with {_DOC} select token, term from vocab")
def porter_vocab(s, d):
    words = table(s, d, "documents").select(F.explode(text.index_tokens(F.col("text"))).alias("token")).where("length(token) > 2").distinct()
    return with_stem(words, "token", "term")


@query(f"with {_DOC} select doc_id, term, frequency, round(tf, 9) tf, positions from tfs")
def term_tf(s, d):
    return index.term_frequencies(table(s, d, "documents"), "doc_id", "text").withColumn("tf", F.round("tf", 9))


@query(f"with {_DOC} select term, count(*) as df, round(ln((select count(*) from documents) / (1 + count(*))), 9) as idf from tfs group by 1")
def term_idf(s, d):
    docs = table(s, d, "documents")
    return index.term_stats(index.term_frequencies(docs, "doc_id", "text"), docs, "doc_id").withColumn("idf", F.round("idf", 9))


@query(f"with {_DOC}, st as (select term, ln((select count(*) from documents) / (1 + count(*))) as idf from tfs group by 1) select doc_id, term, round(tf * idf, 9) as tfidf from tfs join st using (term)")
def term_tfidf(s, d):
    docs = table(s, d, "documents")
    tf = index.term_frequencies(docs, "doc_id", "text")
    return tf.join(index.term_stats(tf, docs, "doc_id"), "term").select("doc_id", "term", F.round(F.col("tf") * F.col("idf"), 9).alias("tfidf"))


@query(f"with {_DOC} select count(*) as n from (select distinct term from counted)")
def vocab_size(s, d):
    return index.tokens(table(s, d, "documents"), "doc_id", "text").agg(F.count_distinct("term").alias("n"))


@query(f"with {_CURRENT}, {_tokens('cur', 'url', 'content')} select t.url, term, [coalesce(contains(lower(title), term), false), false, false] as headers from tfs t join cur using (url)")
def heading_flags(s, d):
    pages = _current(s, d)
    return index.heading_flags(pages, index.term_frequencies(pages, "url", "content"), "url", ("h1", "h2", "h3"))


_PAGE_INDEX = f"{_CURRENT}, {_tokens('cur', 'url', 'content')}, {_snippets('cur', 'url', 'content')}"


@query(f"with {_PAGE_INDEX} select url, term, list(snippet order by spot) as snippets from snips join tfs using (url, term) group by 1, 2")
def snippets60(s, d):
    pages = _current(s, d)
    return index.snippets(pages, index.term_frequencies(pages, "url", "content"), "url", "content")


@query(f"""with {_CURRENT}, {_snippets('cur', 'url', 'content')}, bare as materialized ({stem_sql("select distinct regexp_replace(lower(word), '[^a-z0-9_]', '', 'g') as b from wx", "b", "stem2")}),
bx as (select url, spot, array_to_string(words[greatest(spot - 34, 1) : spot + 36], ' ') near from wx join bare on regexp_replace(lower(word), '[^a-z0-9_]', '', 'g') = b join wl using (url) where stem2 = '{TERM}')
select url, string_agg('- ' || near, chr(10) order by spot) as snippet from bx group by 1""")
def snippet35(s, d):
    return index.wide_snippets(_current(s, d), "url", "content", TERM)


_CHARS = rf"""with {_CURRENT}, cw as (select url, unnest(l) word, generate_subscripts(l, 1) spot from (select url, regexp_extract_all(content, '\b\w+\b') l from cur)),
cv as materialized ({stem_sql("select distinct word as w from cw", "w", "stem3")}),
ch as (select url, list(word order by spot) hits from cw join cv on word = w where stem3 = '{TERM}' group by 1),
cp as (select url, content as t, hits, length(regexp_extract(content, '(?s)^(.*?)\b' || hits[1] || '\b', 1)) a from cur left join ch using (url)),
cb as (select *, greatest(0, a - 75) lo, least(length(t), a + length(hits[1]) + 75) hi from cp),
cs as (select *, case when lo > 0 then length(regexp_extract(t[1:lo + 1], '(?s)^(.* )', 1)) else 0 end s, hi + length(regexp_extract(t[hi + 1:], '(?s)^([^ ]*)', 1)) e from cb)
select url, case when hits is null then ' ' else case when s > 0 then '...' else '' end || list_reduce(list_prepend(t[s + 1:e], hits), lambda x, w: regexp_replace(x, '(?i)\b' || w || '\b', '<b>\0</b>', 'g')) || case when e < length(t) then '...' else '' end end as snippet from cs"""


@query(_CHARS)
def snippet_chars(s, d):
    return index.character_snippets(_current(s, d), "url", "content", TERM)


_NEEDLE = "is ready"
_EDGE = r"[ \t\n\x0B\f\r\x1c-\x1f.!?,;:()\[\]{}]"


@query(rf"""select doc_id, regexp_matches(text, '(\A|{_EDGE}){_NEEDLE}(\z|{_EDGE})') as found from documents where text is not null""")
def exact_sentence(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", text.contains_sentence(F.col("text"), _NEEDLE).alias("found"))


@query(rf"""select doc_id, case when regexp_matches(text, '(\A|{_EDGE}){_NEEDLE}(\z|{_EDGE})') then length(regexp_extract(text, '(?s)^(.*?(?:\A|{_EDGE})){_NEEDLE}(?:\z|{_EDGE})', 1)) else -1 end as at from documents where text is not null""")
def sentence_index(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", text.sentence_index(F.col("text"), _NEEDLE).alias("at"))


# ---- robots and crawl ----


def _robots(s: SparkSession, d: str, mode: str) -> DataFrame:
    bases = _pages(s, d).select(urls.robots_base(F.lower("url")).alias("base")).distinct()
    return crawl.robots_rules(bases.withColumn("text", F.lit(ROBOTS)), mode)


_BASES = "select distinct regexp_extract(lower(url), '^([a-z]+://[^/?#:]*)', 1) as base from visited_pages"


@query(f"select base, disallow from ({_BASES}), (values ('/guides'), ('/item/q')) r(disallow)")
def robots_rules(s, d):
    return _robots(s, d, "intended")


@query(f"select base, 'x' as disallow from ({_BASES}) where false")
def robots_rules_compat(s, d):
    return _robots(s, d, "compat")


@query(f"select page_id, url from visited_pages where not (regexp_extract(url, '^([A-Za-z]+://[^/?#:]*)', 1) in ({_BASES}) and regexp_matches(url, '^[a-z]+://[^/?#:]*(/guides|/item/q)'))")
def robots_filter(s, d):
    return crawl.allowed(_pages(s, d).select("page_id", "url"), _robots(s, d, "intended"))


_HTTP = "regexp_matches(url, '^(?i)https?://')"


@query(f"select distinct k as norm from (select {key_sql('url')} as k from pending where {_HTTP}) where k not in (select {key_sql('url')} from visited_pages)")
def url_dedup(s, d):
    frontier = table(s, d, "pending").where(F.col("url").rlike("^(?i)https?://")).select("url", F.xxhash64("url").alias("seq"))
    return crawl.unseen(frontier, _pages(s, d).select(urls.crawl_key(F.col("url")).alias("norm"))).select("norm")


@query(
    f"""with recursive {_CURRENT}, hops as materialized (select url, {key_sql('l')} as dst from (select url, unnest(links) as l from cur) where regexp_matches(l, '^(?i)https?://')),
walk as (select k as norm from (select {key_sql('url')} as k from pending where {_HTTP}) union select dst from walk join hops on walk.norm = hops.url)
select norm from walk join cur on norm = cur.url"""
)
def crawl_bfs(s, d):
    web = _current(s, d).select(F.col("url").alias("norm"), "title", "content", F.filter("links", lambda x: x.rlike("^(?i)https?://")).alias("links"))
    start = table(s, d, "pending").where(F.col("url").rlike("^(?i)https?://"))
    nothing = web.limit(0)
    rules = s.createDataFrame([], "base string, disallow string")
    got = crawl.crawl(start, web, rules, nothing, nothing.select(F.col("title").alias("fingerprint")), limit=2**31 - 1, dedup_content=False)
    return got.stored.select("norm")


def _crawl_sql(limit: int, rounds: int = 14) -> str:
    """A crawl by unrolled rounds; those behind the last page are empty."""
    fp = _FP.replace("text", "content")
    parts = [_CURRENT, f"web as materialized (select url as norm, to_base64(unhex(md5({fp}))) as print, title, content, links from cur)"]
    parts.append(f"gone as materialized (select distinct {key_sql('url')} as k from removed_pages where {_HTTP})")
    parts.append("prints0 as materialized (select distinct print from web where norm in (select k from gone))")
    parts.append(f"front0 as materialized (select url from pending where {_HTTP})")
    parts.append("seen0 as materialized (select k from gone)")
    parts.append("stored0 as materialized (select norm, 0 as depth from web where false)")
    blocked = f"regexp_extract(url, '^([A-Za-z]+://[^/?#:]*)', 1) in ({_BASES}) and regexp_matches(url, '^[a-z]+://[^/?#:]*(/guides|/item/q)')"
    for i in range(1, rounds + 1):
        parts.append(f"new{i} as materialized (select k, min(url) as url from (select {key_sql('url')} as k, url from front{i - 1}) where k is not null and k not in (select k from seen{i - 1}) and (select count(*) from stored{i - 1}) < {limit} group by 1)")
        parts.append(f"got{i} as materialized (select *, row_number() over (partition by print order by url) nth from new{i} join web on k = norm where not ({blocked}) and print not in (select print from prints{i - 1}))")
        parts.append(f"take{i} as materialized (select norm, print, links from got{i} where nth = 1 order by url, norm limit greatest(0, {limit} - (select count(*) from stored{i - 1})))")
        parts.append(f"seen{i} as materialized (select k from seen{i - 1} union all select k from new{i})")
        parts.append(f"prints{i} as materialized (select print from prints{i - 1} union all select print from take{i})")
        parts.append(f"stored{i} as materialized (select * from stored{i - 1} union all select norm, {i - 1} from take{i})")
        parts.append(f"front{i} as materialized (select url from (select unnest(links) as url from take{i}) where {_HTTP})")
    return f"with {', '.join(parts)} select norm, depth from stored{rounds}"


def _crawl(s: SparkSession, d: str, limit: int) -> crawl.Crawl:
    """From the frontier over the stored pages, with robots rules and content dedup; removed pages and their contents count as visited."""
    web = _current(s, d).select(F.col("url").alias("norm"), "title", "content", F.filter("links", lambda x: x.rlike("^(?i)https?://")).alias("links"))
    removed = table(s, d, "removed_pages").where(F.col("url").rlike("^(?i)https?://")).select(urls.crawl_key(F.col("url")).alias("norm")).distinct()
    known = web.join(removed, "norm", "left_semi").select(text.fingerprint(F.col("title"), F.col("content")).alias("fingerprint")).distinct()
    start = table(s, d, "pending").where(F.col("url").rlike("^(?i)https?://"))
    return crawl.crawl(start, web, _robots(s, d, "intended"), removed, known, limit=limit)


@query(_crawl_sql(2**31 - 1))
def crawl_dedup(s, d):
    return _crawl(s, d, 2**31 - 1).stored.select("norm", "depth")


@query(_crawl_sql(25))
def crawl_limited(s, d):
    """The page limit is the feature: the first 25 pages by round and address."""
    return _crawl(s, d, 25).stored.select("norm", "depth")


@query(f"with c as ({_crawl_sql(2**31 - 1)}) select count(*) as pages, count(distinct c.norm) as distinct_pages, sum(length(content))::bigint as characters from c join (with {_CURRENT} select url as norm, content from cur) w on c.norm = w.norm")
def crawl_stats(s, d):
    return crawl.crawl_stats(_crawl(s, d, 2**31 - 1).stored)


# ---- graph ----

_EDGES = f"""edges as materialized (
 select distinct src, dst from (select {_INDEX_KEY} as src, unnest(links) as link from visited_pages), lateral (select {_INDEX_KEY.replace("url", "link")} as dst)
 where src is not null and dst in (select url from visited_pages))"""


@query(f"with {_EDGES} select src, dst from edges")
def edges(s, d):
    return graph.link_graph(_pages(s, d))


@query(f"with {_EDGES} select coalesce(a.src, b.dst) as node, coalesce(o, 0) as out_degree, coalesce(i, 0) as in_degree from (select src, count(*) o from edges group by 1) a full join (select dst, count(*) i from edges group by 1) b on a.src = b.dst")
def degrees(s, d):
    return graph.degrees(graph.link_graph(_pages(s, d)))


@query(f"with {_EDGES} select distinct url as node from visited_pages where url is not null and url not in (select src from edges)")
def dangling(s, d):
    return graph.dangling(store.distinct_values(_pages(s, d), "url").withColumnRenamed("url", "node"), graph.link_graph(_pages(s, d)))


def _pagerank_sql(ctes: str, nodes: str, rounds: int = graph.ROUNDS) -> str:
    parts = [ctes, f"nodes as materialized ({nodes})", "size as (select count(*) as n from nodes)"]
    parts.append("e as materialized (select src, dst, count(*) over (partition by src) as o from edges where src in (select node from nodes) and dst in (select node from nodes))")
    parts.append("r0 as materialized (select node, 1.0::double / n as rank, 1.0::double as moved from nodes, size)")
    for i in range(1, rounds + 1):
        got = f"select dst, sum(rank / o) as got from e join r{i - 1} on src = node group by 1"
        lost = f"select coalesce(sum(rank), 0) as lost from r{i - 1} where node not in (select src from e)"
        new = f"select p.node, case when p.moved <= 1e-4 then p.rank else 0.15 / n + 0.85 * coalesce(got, 0) + 0.85 * lost / n end as rank, p.rank as old, p.moved as done from r{i - 1} p left join ({got}) g on p.node = g.dst, ({lost}), size"
        parts.append(f"r{i} as materialized (select node, rank, case when done <= 1e-4 then done else max(abs(rank - old)) over () end as moved from ({new}))")
    return f"with {', '.join(parts)} select node, round(rank, 9) as rank from r{rounds}"


@query(_pagerank_sql(_EDGES, "select distinct url as node from visited_pages where url is not null", 30))
def pagerank(s, d):
    pages = _pages(s, d)
    return graph.pagerank(store.distinct_values(pages, "url").withColumnRenamed("url", "node"), graph.link_graph(pages)).withColumn("rank", F.round("rank", 9))


@query(_pagerank_sql("edges as materialized (select distinct p_partkey % 25 as src, p_size % 25 as dst from part where p_partkey < 60 and p_partkey % 25 < 20)", "select unnest(range(25)) as node", 20))
def pagerank_part(s, d):
    part = table(s, d, "part").where("p_partkey < 60 and p_partkey % 25 < 20").selectExpr("p_partkey % 25 as src", "cast(p_size % 25 as bigint) as dst").distinct()
    return graph.pagerank(s.range(25).withColumnRenamed("id", "node"), part).withColumn("rank", F.round("rank", 9))


# ---- search ----


def _stored(s: SparkSession, d: str, mode: str = "compat") -> indexing.StoredIndex:
    """The index of the current pages in the session's shared folder; built by the first query that needs it."""
    path = f"{shared_folder(s)}/index-{mode}-{hashlib.md5(d.encode()).hexdigest()}"
    return indexing.open_index(s, path) or indexing.build_index(_current(s, d), path, mode)


def _lean_index(s: SparkSession, d: str, q: str, mode: str = "compat") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the stored index has on the query's terms: postings with snippets, statistics, pages."""
    stored = _stored(s, d, mode)
    terms = [r["term"] for r in search.query_terms(s, q, mode).collect()]
    return stored.hits(terms), stored.stats(terms), stored.part("pages")


@query(f"with {_CURRENT}, {_tokens('cur', 'url', 'content')} select 'postings' as part, count(*) as n from tfs union all select 'stats', count(distinct term) from tfs union all select 'pages', count(*) from cur union all select 'failed', 0")
def index_job(s, d):
    return indexing.part_sizes(_stored(s, d))


@query(f"with {_CURRENT}, {_tokens('cur', 'url', 'content')} select t.url, term, frequency, round(tf, 9) as tf, positions from tfs t where term in ('river', 'museum', 'quiet')")
def index_lookup(s, d):
    return _stored(s, d).hits(["river", "museum", "quiet"], snippets=False).select("url", "term", "frequency", F.round("tf", 9).alias("tf"), "positions")


def _search_sql(terms: str, words: str, where: str = "true") -> str:
    n = len(words)
    hit = " + ".join(f"contains(lower(title), '{w}')::int" for w in words)
    return f"""with {_PAGE_INDEX}, q as ({stem_sql(terms, "w", "term")}),
st as (select term, ln((select count(*) from cur) / (1 + count(*))) as idf from tfs group by 1),
sn as (select url, term, list(snippet order by spot) as snippets from snips join (select distinct term from q) using (term) group by 1, 2),
rows as (select t.*, title, coalesce(page_rank, 0.0) as pr, idf, sn.snippets, regexp_replace(regexp_replace(lower(trim(t.url)), '#.*$', ''), '/+$', '') as link from tfs t join (select distinct term from q) using (term) join st using (term) join cur using (url) left join sn on sn.url = t.url and sn.term = t.term where {where}),
comp as (select link, sum(tf * idf) as tfidf, max(pr) as page_rank, sum(coalesce({hit}, 0)) as title_matches, least(sum(case when contains(lower(title), term) then 0.45 else 0.0 end), 0.45)::double as heading, arg_min(title, (term, url)) as title, arg_max(coalesce(snippets, []), (term, url)) as snippets from rows group by 1),
ranked as (select *, 0.4 * (tfidf / max(tfidf) over ()) + 0.3 * (page_rank / max(page_rank) over ()) + 0.7 * title_matches / {n} + heading as score from comp)"""


_TERMS_SQL = "select unnest(list_filter(string_split_regex('quiet river museum', '[ _.!@#-]+'), lambda w: w <> '')) as w"
_TERM_SEARCH = _search_sql(_TERMS_SQL, [QUERY])


@query(f"{_TERM_SEARCH} select null::varchar as term, link as url, title, snippets[1] as snippet, null::varchar as id, round(score, 9) as score from ranked where len(snippets) > 0")
def search_term(s, d):
    return search.search(s, QUERY, *_lean_index(s, d, QUERY)).withColumn("score", F.round("score", 9))


@query(f"{_TERM_SEARCH} select link, round(tfidf, 9) as tfidf, round(page_rank, 9) as page_rank, title_matches::bigint as title_matches, heading from comp")
def score_components(s, d):
    postings, stats, pages = _lean_index(s, d, QUERY)
    hits = search.matching_postings(postings, search.query_terms(s, QUERY))
    rows = search.score_components(hits, stats, pages, text.title_words(QUERY))
    return rows.select("link", F.round("tfidf", 9).alias("tfidf"), F.round("page_rank", 9).alias("page_rank"), "title_matches", "heading")


@query(f"{_TERM_SEARCH} select link as url, round(score, 9) as score from ranked where len(snippets) > 0 order by ranked.score desc, link limit 10 offset 10")
def search_page2(s, d):
    return search.page_of(search.search(s, QUERY, *_lean_index(s, d, QUERY)), 2).select("url", F.round("score", 9).alias("score"))


@query(f"{_TERM_SEARCH} select count(*) as total from ranked where len(snippets) > 0")
def search_total(s, d):
    return search.total(search.search(s, QUERY, *_lean_index(s, d, QUERY)))


_IN_SNIPPET = rf"regexp_matches(replace(replace(x, '<b>', ''), '</b>', ''), '(\A|{_EDGE})knows why(\z|{_EDGE})')"
_PHRASE_SEARCH = _search_sql("select unnest(['knows', 'why']) as w", [PHRASE], f"len(list_filter(sn.snippets, lambda x: {_IN_SNIPPET})) > 0")


@query(
    f"""{_PHRASE_SEARCH}, found as (select *, replace(replace(list_filter(snippets, lambda x: {_IN_SNIPPET})[1], '<b>', ''), '</b>', '') as p from ranked),
placed as (select *, instr(p, 'knows why') as i from found)
select null::varchar as term, link as url, title, substring(p, 1, i - 1) || '<b>knows why</b>' || substring(p, case when i + 8 >= length(p) then length(p) else i + 9 end) as snippet, null::varchar as id, round(score, 9) as score from placed"""
)
def search_phrase(s, d):
    return search.search(s, PHRASE, *_lean_index(s, d, PHRASE[1:-1])).withColumn("score", F.round("score", 9))


@query(f"{_TERM_SEARCH} select term, url, title, list_filter(snippets, lambda x: x <> '')[1] as snippet from rows where len(list_filter(snippets, lambda x: x <> '')) > 0")
def unranked_results(s, d):
    return search.unranked(_lean_index(s, d, QUERY)[0])


@query(f"{_TERM_SEARCH} select count(*) as total, least(10, count(*))::int as shown from ranked where len(snippets) > 0")
def search_response(s, d):
    answer = search.response(search.search(s, QUERY, *_lean_index(s, d, QUERY)))
    return answer.select("total", F.size("results").alias("shown"))


@query()
def search_intended(s, d):
    return search.search(s, QUERY, *_lean_index(s, d, QUERY, "intended"), mode="intended").withColumn("score", F.round("score", 9))


@query()
def search_intended_phrase(s, d):
    return search.search(s, PHRASE, *_lean_index(s, d, PHRASE[1:-1], "intended"), mode="intended").withColumn("score", F.round("score", 9))


@query("""select term, url, title, list(distinct frequency order by frequency) as frequencies from (select lower(trim(term)) as term, url, title, frequency from postings) where term = 'river' group by 1, 2, 3""")
def postings_of_term(s, d):
    p = table(s, d, "postings").withColumn("term", F.lower(F.trim("term"))).where("term = 'river'")
    return p.groupBy("term", "url", "title").agg(F.array_sort(F.collect_set("frequency")).alias("frequencies"))


@query(f"with {_CURRENT}, {_tokens('cur', 'url', 'content')} select term, count(*) as df, round(ln((select count(*) from cur) / (1 + count(*))), 9) as idf, count(*)::int as n_pages from tfs group by 1")
def nested_index(s, d):
    pages = _current(s, d)
    postings = index.build_postings(pages, with_snippets=False)
    return index.nested_index(postings, index.term_stats(postings, pages)).select("term", "df", F.round("idf", 9).alias("idf"), F.size("pages").alias("n_pages"))


# ---- suggestions ----

_PAST = "past as (select arg_min(trim(title, ' '), doc_id) as query, count(*) as n, min(doc_id) as first_seq from documents where trim(title, ' ') <> '' group by lower(trim(title, ' ')))"


def _past(s: SparkSession, d: str) -> DataFrame:
    return suggest.history(table(s, d, "documents").select(F.col("title").alias("query"), F.col("doc_id").alias("seq")))


@query(f"with {_PAST} select * from past")
def query_log(s, d):
    return _past(s, d)


@query(f"with {_PAST} select * from past where starts_with(lower(query), '{PREFIX}') order by n desc, first_seq limit 5")
def suggestions(s, d):
    return suggest.suggest(_past(s, d), PREFIX.upper())


@query(f"with {_PAST} select query, case when instr(lower(query), 'the') > 0 then substring(query, 1, instr(lower(query), 'the') - 1) || '<b>' || substring(query, instr(lower(query), 'the'), 3) || '</b>' || substring(query, instr(lower(query), 'the') + 3) else query end as shown from past")
def suggestion_highlight(s, d):
    return _past(s, d).select("query", suggest.highlight(F.col("query"), "THE").alias("shown"))


@query(
    """with c as (select p as current, r as results, ceil(r / 10.0)::int as pages from range(1, 13) a(p), range(0, 130, 7) b(r)),
f as (select *, greatest(1, least(current - 1, pages - 2)) as first from c)
select current, results, case when pages > 0 then range(first, least(pages, first + 2) + 1) else [] end as buttons from f"""
)
def pager_window(s, d):
    rows = s.range(1, 13).withColumnRenamed("id", "current").crossJoin(s.range(0, 130, 7).withColumnRenamed("id", "results"))
    return rows.select("current", "results", suggest.pager(F.col("current").cast("int"), F.col("results")).alias("buttons"))


# ---- streaming ----


@query(f"with {_DOC} select term, count(*) as df from tfs group by 1")
def incremental_index(s, d):
    base = f"{shared_folder(s)}/stream-{s.range(1).select(F.uuid()).first()[0]}"
    schema = table(s, d, "documents").schema
    # two batches at least where the table has files for them
    size = max(1, min(incremental.BATCH_BYTES, path_bytes(s, f"{d}/documents.parquet") * 2 // 3))
    incremental.index_stream(s, f"{d}/documents.parque[t]", schema, f"{base}/index", f"{base}/log", "doc_id", "text", size).awaitTermination()
    # the index has each document's term once
    return s.read.parquet(f"{base}/index/postings").groupBy("term").agg(F.count("*").alias("df"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_counts(s, d):
    return incremental.event_counts(table(s, d, "events"))


@query(f"select lower(trim(term)) as term, {key_sql('url')} as url, coalesce(frequency, len(positions), 0)::bigint as occurrences from postings where nullif(lower(trim(term)), '') is not null and {key_sql('url')} is not null")
def postings_clean(s, d):
    return indexed(table(s, d, "postings")).select("term", "url", "occurrences")
