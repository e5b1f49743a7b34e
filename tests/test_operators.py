import math
import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltworks.operators import crawl, graph, index, indexing, references, search, skew, store, suggest
from siltworks.session import shared_folder
from siltworks.streaming import incremental


@pytest.mark.parametrize("at,first,last,pre,post", [(0, 0, 59, False, True), (10, 0, 59, False, True), (40, 10, 69, True, True), (69, 39, 98, True, True), (70, 40, 99, True, False), (99, 40, 99, True, False)])
def test_snippet_window(spark, at, first, last, pre, post):
    words = [f"w{i}" for i in range(100)]
    words[at] = "birds"
    df = spark.createDataFrame([("u", " ".join(words) + " ")], "url string, content string")
    got = index.snippets(df, spark.createDataFrame([("u", "bird")], "url string, term string"), "url", "content").first().snippets
    assert len(got) == 1
    s = got[0]
    assert s.startswith("... ") == pre and s.endswith(" ...") == post and s.endswith("...") == post and "<b>birds</b>" in s
    body = s.removeprefix("... ").removesuffix(" ...").split()
    assert len(body) == 60
    assert body[0] in (f"w{first}", "<b>birds</b>") and body[-1] in (f"w{last}", "<b>birds</b>")


def test_snippets_of_long_texts(spark, monkeypatch):
    """Windows across chunks equal those of the whole text; places of other chunks are bold, too."""
    words = ["bird" if i % 29 in (0, 3) else f"w{i}" for i in range(1300)]
    df = spark.createDataFrame([("u", "  " + " ".join(words) + " "), ("v", "one bird"), ("n", None), ("e", "")], "url string, content string")
    terms = spark.createDataFrame([("u", "bird"), ("u", "none"), ("v", "bird")], "url string, term string")
    text = ["", *words]
    want = []
    for i, w in enumerate(text):
        if w == "bird":
            a = max(0, i - 30)
            b = min(len(text), a + 60)
            a = max(0, b - 60) if b - a < 60 else a
            want.append((("... " if a else "") + " ".join(f"<b>{x}</b>" if x == "bird" else x for x in text[a:b]) + (" ..." if b < len(text) else "")).strip())
    for size in (64, 512):
        monkeypatch.setattr(index, "CHUNK", size)
        got = {r.url: r.snippets for r in index.snippets(df, terms, "url", "content").collect()}
        assert got == {"u": want, "v": ["one <b>bird</b>"]}


def test_character_snippets(spark):
    text = "aaaa bbbb cccc river dddd river eeee ffff"
    df = spark.createDataFrame([(1, text, "x"), (2, "no such word", "x"), (3, None, "x"), (4, "Rivers rivers river.", "x"), (5, "x" * 30 + "y river", "x")], "id int, t string, word string")
    got = {r.id: r.snippet for r in index.character_snippets(df, "id", "t", "river", 12).collect()}
    assert got[1] == "...cccc <b><b>river</b></b> dddd <b><b>river</b></b>..."
    assert got[2] == " " and got[3] == "" and got[4] == "<b>Rivers</b> <b>rivers</b> <b>river</b>."
    assert got[5] == "x" * 30 + "y <b>river</b>"


def test_stems_in_place_and_by_vocabulary(spark, monkeypatch):
    df = spark.createDataFrame([("a", "running dogs running"), ("b", None), ("c", "")], "id string, t string")
    one = sorted(map(str, index.tokens(df, "id", "t").collect()))
    monkeypatch.setattr(index, "VOCABULARY", 0)
    assert sorted(map(str, index.tokens(df, "id", "t").collect())) == one and len(one) == 3


GRAPHS = [
    ("ABCD", "AB AC BC CA CD", {"A": 0.234001774, "B": 0.186651222, "C": 0.345345229, "D": 0.234001774}),
    ("ABCD", "AA AB", {"A": 0.317454106, "B": 0.317454106, "C": 0.182545894, "D": 0.182545894}),
    ("ABC", "", {"A": 1 / 3, "B": 1 / 3, "C": 1 / 3}),
]


@pytest.mark.parametrize("nodes,edges,want", GRAPHS)
def test_pagerank(spark, nodes, edges, want):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame([tuple(x) for x in edges.split()], "src string, dst string")
    got = {r.node: r["rank"] for r in graph.pagerank(n, e).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_pagerank_of_nothing(spark):
    empty = spark.createDataFrame([], "node string")
    assert graph.pagerank(empty, spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.fixture(scope="module")
def small_index(spark):
    rows = [
        ("https://a.org/Birds", "Birds of Egypt", "Birds of Egypt Birds live near water and birds sing. ", 0.4, ["Birds of Egypt"], []),
        ("https://b.org/ducks", "Ducks guide", "Ducks guide Water birds Ducks swim in water. ", 0.3, ["Ducks guide"], ["Water birds"]),
        ("https://c.org/parser", "Parser", "Parser Parsing pages with selectors, water. ", 0.2, ["Parser"], []),
        ("https://d.org/cats", "Cats", "Cats Cats sleep all day long. ", 0.1, ["Cats"], []),
    ]
    pages = spark.createDataFrame(rows, "url string, title string, content string, page_rank double, h1 array<string>, h2 array<string>").withColumn("h3", F.array().cast("array<string>"))
    postings = index.build_postings(pages).cache()
    return postings, index.term_stats(postings, pages), pages


@pytest.mark.parametrize("q,want", [("birds", {"https://a.org/birds": 1.85, "https://b.org/ducks": 0.608333}), ("birds ducks", {"https://b.org/ducks": 1.075, "https://a.org/birds": 0.956227}), ("cats", {"https://d.org/cats": 1.85}), ("played", {}), ("  ", {})])
def test_search(spark, small_index, q, want):
    got = search.search(spark, q, *small_index).collect()
    assert {r.url: r.score for r in got} == pytest.approx(want, abs=1e-5)
    assert [r.url for r in got] == list(want)
    assert all(r.term is None and r.id is None for r in got)


def test_search_zero_idf_is_nan_or_zero(spark, small_index):
    got = search.search(spark, "water", *small_index).collect()
    assert {r.url for r in got} == {"https://a.org/birds", "https://b.org/ducks"} and all(math.isnan(r.score) for r in got)
    assert not any(math.isnan(r.score) for r in search.search(spark, "water", *small_index, mode="intended").collect())


def test_phrase_search(spark, small_index):
    got = search.search(spark, '"live near"', *small_index).collect()
    assert [r.url for r in got] == ["https://a.org/birds"] and "<b>live near</b>" in got[0].snippet
    assert search.search(spark, '"Live near"', *small_index).count() == 0


def test_intended_phrase_search_of_the_text(spark, small_index):
    """A phrase is found in the page's text beyond its snippets, with the page's id; blank queries have no results."""
    postings, stats, pages = small_index
    pages = pages.withColumn("page_id", F.concat(F.lit("id-"), F.col("title")))
    got = search.search(spark, '"live near water"', postings.withColumn("snippets", F.array(F.lit("elsewhere"))), stats, pages, mode="intended").collect()
    assert [(r.url, r.id, r.snippet) for r in got] == [("https://a.org/birds", "id-Birds of Egypt", "elsewhere")]
    assert search.search(spark, " \t", postings, stats, pages).count() == 0


def test_response_and_escaping(spark, small_index):
    one = search.response(search.search(spark, "birds ducks", *small_index), page=1, size=1).first()
    assert one.total == 2 and [r.url for r in one.results] == ["https://b.org/ducks"]
    df = spark.createDataFrame([('<script>"a" & <b>b</b>',)], "s string")
    assert df.select(search.escaped(F.col("s"))).first()[0] == "&lt;script&gt;&quot;a&quot; &amp; <b>b</b>"


def test_index_job(spark, tmp_path):
    rows = [("https://a.org/b", "Birds", "birds sing", 0.5, ["https://a.org/c"]), ("https://a.org/c", "Cats", "cats and birds", None, []), ("https://a.org/n", None, None, 0.1, None)]
    pages = spark.createDataFrame(rows, "url string, title string, content string, page_rank double, links array<string>")
    pages = pages.select("*", *[F.array().cast("array<string>").alias(h) for h in ("h1", "h2", "h3")])
    assert indexing.open_index(spark, str(tmp_path / "i")) is None
    indexing.build_index(pages, str(tmp_path / "i"), rank=True)
    stored = indexing.open_index(spark, str(tmp_path / "i"))
    assert {r.part: r.n for r in indexing.part_sizes(stored).collect()} == {"postings": 3, "stats": 2, "pages": 3, "failed": 1}
    hits = stored.hits(["bird"])
    assert {r.url: r.snippets for r in hits.collect()} == {"https://a.org/b": ["<b>birds</b> sing"], "https://a.org/c": ["cats and <b>birds</b>"]}
    plan = stored.hits(["bird", "cat"], snippets=False)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [bird,cat])]" in plan
    assert {r.term: r.df for r in stored.stats(["bird"]).collect()} == {"bird": 2}
    ranks = {r.url: r.page_rank for r in stored.part("pages").collect()}
    assert ranks["https://a.org/c"] > ranks["https://a.org/n"] > 0


def test_suggestions(spark):
    log = spark.createDataFrame([("Birds", 1), ("bird feeder", 2), ("birds", 3), ("cats", 4), (" ", 5), (None, 6)], "query string, seq long")
    past = suggest.history(log)
    assert {(r.query, r.n) for r in past.collect()} == {("Birds", 2), ("bird feeder", 1), ("cats", 1)}
    assert [r.query for r in suggest.suggest(past, "BI").collect()] == ["Birds", "bird feeder"]
    pages = spark.createDataFrame([(1, 95), (5, 95), (10, 95), (1, 0), (1, 7)], "p int, n int").select(suggest.pager(F.col("p"), F.col("n")).alias("b"))
    assert [r.b for r in pages.collect()] == [[1, 2, 3], [4, 5, 6], [8, 9, 10], [], [1]]


def test_robots(spark):
    files = spark.createDataFrame([("http://a.org", "User-agent: *\nDisallow: /private\nDisallow:\nUser-agent: OtherBot\nDisallow: /")], "base string, text string")
    rules = crawl.robots_rules(files, "intended")
    assert [r.disallow for r in rules.collect()] == ["/private"]
    assert crawl.robots_rules(files).count() == 0
    links = [("http://a.org" + p,) for p in ("/private/x", "/privateer", "/Private", "/public")] + [("http://b.org/private",)]
    assert {r.url for r in crawl.allowed(spark.createDataFrame(links, "url string"), rules).collect()} == {"http://a.org/Private", "http://a.org/public", "http://b.org/private"}


def test_crawl(spark, tmp_path):
    web = spark.createDataFrame(
        [("http://a.org", "A", "one", ["http://a.org/b/", "http://www.a.org/c?x"]), ("http://a.org/b", "B", "two", ["http://a.org/", "http://a.org/d"]), ("http://a.org/c", "B", "TWO", ["http://a.org/e"]), ("http://a.org/d", "D", "four", None), ("http://a.org/e", "E", "five", [])],
        "norm string, title string, content string, links array<string>",
    )
    start = spark.createDataFrame([("http://a.org",), ("http://A.org/",), (None,)], "url string")
    none = spark.createDataFrame([], "norm string, fingerprint string")
    rules = spark.createDataFrame([], "base string, disallow string")
    whole = crawl.crawl(start, web, rules, none, none)
    assert {(r.norm, r.depth) for r in whole.stored.collect()} == {("http://a.org", 0), ("http://a.org/b", 1), ("http://a.org/d", 2)}
    assert whole.frontier.count() == 0 and whole.seen.count() == 4
    assert crawl.crawl(start, web, rules, none, none, dedup_content=False).stored.count() == 5
    some = crawl.crawl(start, web, rules, none, none, limit=2, dedup_content=False)
    assert {r.norm for r in some.stored.collect()} == {"http://a.org", "http://a.org/b"}
    assert {r.url for r in some.frontier.collect()} == {"http://www.a.org/c?x", "http://a.org/d"}
    store.save_pending(some.frontier, str(tmp_path / "pending"))
    again = crawl.start_urls(spark.read.parquet(str(tmp_path / "pending")), start)
    prints = some.stored.select("fingerprint")
    rest = crawl.crawl(again, web, rules, some.seen.where("norm <> 'http://a.org/c'"), prints, dedup_content=False)
    assert {r.norm for r in rest.stored.collect()} == {"http://a.org/c", "http://a.org/d", "http://a.org/e"}
    seeded = crawl.start_urls(start.limit(0), store.seeds(spark, __file__).limit(1))
    assert seeded.count() == 1
    assert crawl.crawl(start.limit(0), web, rules, none, none).stored.count() == 0


def test_long_crawl(spark, monkeypatch):
    """A chain of pages longer than the rounds after which seen keys are rewritten; the limit cuts it."""
    web = spark.createDataFrame([(f"http://a.org/{i}", "t", str(i), [f"http://a.org/{i + 1}"]) for i in range(11)], "norm string, title string, content string, links array<string>")
    start, none = spark.createDataFrame([("http://a.org/0",)], "url string"), spark.createDataFrame([], "norm string, fingerprint string")
    rules = spark.createDataFrame([], "base string, disallow string")
    got = crawl.crawl(start, web, rules, none, none)
    assert {r.norm: r.depth for r in got.stored.collect()} == {f"http://a.org/{i}": i for i in range(11)}


def ref_tables(spark):
    ts = lambda *x: [F.col(c).cast("timestamp") for c in x]  # noqa: E731, F841
    refs = spark.createDataFrame([("a", "2024-01-05", "extra"), ("a", "2024-01-01", None), ("b", "2024-01-05", None), ("c", "2024-01-05", None), ("c", None, None), ("x", None, None), (None, "2024-01-05", None), ("a", "2024-01-05", "extra")], "key string, at string, suspect_note string").withColumn("at", F.col("at").cast("timestamp"))
    parents = spark.createDataFrame([("a", "2024-01-03"), ("a", "2024-01-09"), ("b", "2024-01-01"), ("c", "2024-01-06"), (None, "2024-01-01")], "key string, stored_at string").withColumn("stored_at", F.col("stored_at").cast("timestamp"))
    removals = spark.createDataFrame([("b", "2024-01-02"), ("a", "2024-01-05"), ("a", None)], "key string, removed_at string").withColumn("removed_at", F.col("removed_at").cast("timestamp"))
    return refs, parents, removals


def test_orphan_references(spark):
    refs, parents, removals = ref_tables(spark)
    got = sorted((r["key"], str(r["at"])[:10]) for r in references.orphan_references(refs, parents, removals).collect())
    assert got == [("a", "2024-01-01"), ("b", "2024-01-05"), ("c", "2024-01-05"), ("x", "None")]
    assert references.orphan_references(refs, parents.limit(0), removals).count() == 7
    assert references.orphan_references(refs.limit(0), parents, removals).count() == 0


def test_runs(spark, monkeypatch):
    """Keys beyond the run before them are orphans because of the run test alone."""
    name = lambda i: f"66a0000000000000{i:08x}"
    held = [name(i) for i in (1, 2, 3, 7, 8, 65535, 65536)] + ["http://a.org/b"]
    asked = [name(i) for i in (0, 2, 4, 8, 9, 65536, 65537, 200000)] + ["http://a.org/a", "http://a.org/b", "http://a.org/c"]
    parents = spark.createDataFrame([(k, "2024-01-01", False) for k in held], "key string, day string, gone boolean").select("key", F.col("day").cast("timestamp").alias("first_stored"), "gone")
    refs = spark.createDataFrame([(k, "2024-02-01") for k in asked], "key string, day string").select("key", F.col("day").cast("timestamp").alias("at"))
    got = {r.key: r.beyond for r in references.match_runs(refs.withColumnRenamed("at", "first_ref"), parents).collect()}
    assert got == {k: k not in held for k in asked}
    stored, none = parents.withColumnRenamed("first_stored", "stored_at"), spark.createDataFrame([], "key string, removed_at timestamp")
    assert {r.key for r in references.suspect_keys(refs, stored, none).collect()} == set(asked) - set(held)
    whole = references.match_runs
    monkeypatch.setattr(references, "match_runs", lambda a, p: whole(a, p).withColumn("beyond", F.lit(False)))
    assert {r.key for r in references.suspect_keys(refs, stored, none).collect()} < set(asked) - set(held)


def test_joins_of_measured_size(spark, monkeypatch):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, n int")
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3), (None, 4)], "k string, v int")
    want = {"hot": 500, "k3": 1}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        got = skew.sized_join(big, side, "k", F.col("n"), F.lit(8))
        assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == want and got.columns == ["k", "n", "v"]
        assert skew.sized_join(big, side, "k", F.col("n"), F.lit(8), "left").count() == 551
    assert skew.heavy_shards(skew.key_loads(big, "k"))["hot"] > 50
    assert skew.sized_join(big.limit(0), side, "k", F.col("n"), F.lit(8)).count() == 0


def test_balanced_counts_with_a_hot_key(spark):
    rows = [("hot", f"p{i % 900}", 1) for i in range(3000)] + [(f"k{i % 50}", f"p{i}", 2) for i in range(500)] + [(None, "p", 1), ("nul", None, 1)]
    df = spark.createDataFrame(rows, "k string, page string, n long").withColumn("slot", F.lit("clash"))
    plan = skew.plan_tasks(spark, skew.key_loads(df, "k"), 4)
    assert plan.shards["hot"] > 4 and max(plan.load) <= 1.3 * sum(plan.load) / 4
    got = {r.key_value: (r.pages, r.occurrences, r.n_rows) for r in skew.balanced_counts(df.drop("slot").withColumn("m", F.lit(1)), plan, "k", ("page",), "n", "m").collect()}
    assert got["hot"] == (900, 3000, 3000) and got["k7"] == (10, 20, 10) and got["nul"] == (0, 1, 1) and len(got) == 52
    side = spark.createDataFrame([("hot", 1), ("k7", 2), ("none", 3), (None, 4)], "k string, v int")
    joined = skew.fragment_replicate_join(df.select("k", "page"), side, plan, "k", F.col("page"))
    assert {r["k"]: r["count"] for r in joined.groupBy("k").count().collect()} == {"hot": 3000, "k7": 10}


def test_skew_of_nothing(spark):
    df = spark.createDataFrame([], "k string, page string, n long")
    plan = skew.plan_tasks(spark, skew.key_loads(df, "k"), 4)
    assert skew.balanced_counts(df.withColumn("m", F.lit(1)), plan, "k", ("page",), "n", "m").count() == 0
    p = spark.createDataFrame([], "term string, url string, frequency int, positions array<int>, indexed_at timestamp")
    assert skew.key_report(spark, p).count() == 0


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append_pages(spark.createDataFrame([("u", True), ("v", None)], "url string, is_indexed boolean"), path)
    pages = spark.read.parquet(path)
    asked = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    assert {r.url for r in store.not_indexed(asked, pages).collect()} == {"v", "w"}
    new = store.update_pages(pages, spark.createDataFrame([("v", True), ("zz", True)], "url string, is_indexed boolean"), ["is_indexed"])
    assert sorted(map(tuple, new.collect())) == [("u", True), ("v", True)]
    store.reset_pages(spark, path)
    assert spark.read.parquet(path).count() == 0
    (tmp_path / "seeds.txt").write_text("http://a.org\n\n http://b.org \n")
    assert [r.url for r in store.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["http://a.org", "http://b.org"]
    postings = spark.createDataFrame([("b", "u"), ("a", "v")], "term string, url string")
    store.save_postings(postings, str(tmp_path / "p"))
    assert store.lookup(spark.read.parquet(str(tmp_path / "p")), ["a"]).collect() == [Row(term="a", url="v")]


def test_incremental_index(spark, tmp_path):
    schema = "url string, content string"
    src = tmp_path / "in"
    spark.createDataFrame([("u", "birds sing"), ("v", "cats sleep")], schema).write.parquet(str(src / "1"))
    files = lambda: incremental.index_stream(spark, str(src / "*"), schema, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    files()
    spark.createDataFrame([("u", "birds again"), ("w", "birds fly"), (None, "x")], schema).write.parquet(str(src / "2"))
    files()
    df = {r.term: r.df for r in index.document_frequencies(spark.read.parquet(str(tmp_path / "i/postings"))).collect()}
    assert df["bird"] == 2 and df["cat"] == 1 and "again" not in df


def test_incremental_index_takes_many_small_files_as_one_batch(spark, tmp_path):
    schema = "url string, content string"
    for i in reversed(range(6)):
        path = tmp_path / "in" / f"{i}"
        spark.createDataFrame([(f"u{i}", "birds sing"), ("twice", f"{'abcdef'[i] * 4} flies")], schema).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 - i, 1_700_000_000 - i))  # the last file is the oldest
    for name, size, batches in (("whole", {}, 1), ("single", {"batch_bytes": 1}, 6)):
        at = tmp_path / name
        incremental.index_stream(spark, str(tmp_path / "in/*"), schema, str(at / "i"), str(at / "c"), **size).awaitTermination()
        assert len(list((at / "i/keys").glob("batch=*"))) == batches
        rows = spark.read.parquet(str(at / "i/postings")).collect()
        df = Counter(r.term for r in rows)
        assert df["bird"] == 6 and df["ffff"] == 1 and not {"aaaa", "bbbb", "cccc", "dddd", "eeee"} & set(df)
        assert {(r.frequency, r.tf) for r in rows if r.url == "twice"} == {(1, 0.5)}


def test_incremental_index_query_over_several_files(spark, tmp_path):
    from siltworks.plans.reference import incremental_index

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = set(Path(shared_folder(spark).removeprefix("file:")).glob("stream-*"))
    got = {tuple(r) for r in incremental_index(spark, str(tmp_path)).collect()}
    (new,) = set(Path(shared_folder(spark).removeprefix("file:")).glob("stream-*")) - before
    assert 2 <= len(list((new / "index/keys").glob("batch=*"))) < 4
    assert got == {tuple(r) for r in index.document_frequencies(index.term_frequencies(docs, "doc_id", "text"), "doc_id").collect()}


def test_crawl_dedup_goes_beyond_the_page_limit(spark, tmp_path):
    from siltworks.plans.reference import crawl_dedup

    n = crawl.LIMIT + 20
    i = F.col("id").cast("string")
    pages = spark.range(n).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/p"), i).alias("url"), F.concat(F.lit("T"), i).alias("title"), F.concat(F.lit("text "), i).alias("content"),
        F.array().cast("array<string>").alias("links"), F.lit(None).cast("double").alias("page_rank"), F.lit("2024-01-01").alias("stored_at"), F.lit("2024-01-01").alias("crawled_at"),
    )
    pages.write.parquet(f"{tmp_path}/visited_pages.parquet")
    pages.select("url").write.parquet(f"{tmp_path}/pending.parquet")
    pages.limit(0).write.parquet(f"{tmp_path}/removed_pages.parquet")
    assert crawl_dedup(spark, str(tmp_path)).count() == n
