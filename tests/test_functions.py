import itertools

import pytest
from pyspark.sql import functions as F

from siltworks.functions import html, porter, text, urls


def one(spark, col, **row):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(k, T.StringType()) for k in row])
    return spark.createDataFrame([tuple(row.values())], schema).select(col.alias("x")).first()["x"]


STEMS = (
    "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre disabled:disabl matting:mat mating:mate meeting:meet "
    "milling:mill messing:mess meetings:meet relational:relat happy:happi happiness:happi generalization:gener possibly:possibl "
    "psychology:psycholog controll:control university:univers umm:umm flies:fli ies:i as:as birds,:birds, played:plai"
)


def test_stems(spark):
    pairs = [p.split(":") for p in STEMS.split()]
    rows = porter.with_stem(spark.createDataFrame(pairs, "w string, s string"), "w", "t").collect()
    assert [(r.w, r.t) for r in rows] == [(r.w, r.s) for r in rows]


def test_stem_measure_against_letter_classes(spark):
    """The regular expressions for m agree with counting vowel-consonant runs letter by letter."""

    def measure(w):
        kinds, before = "", False
        for i, c in enumerate(w):
            cons = c not in "aeiou" and not (c == "y" and i > 0 and before)
            before = cons
            kinds += "c" if cons else "v"
        runs = "".join(k for k, _ in itertools.groupby(kinds))
        return runs.count("vc")

    words = ["".join(x) for n in range(1, 6) for x in itertools.product("abyx", repeat=n)]
    marked = F.replace(F.regexp_replace("w", "(^|[aeiou])y", "$1Y"), F.lit("yy"), F.lit("yY"))
    m = F.when(marked.rlike(porter.MANY), 2).when(marked.rlike(porter.ONE), 1).when(marked.rlike(porter.SOME), 2).otherwise(0)
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", m.alias("m")).collect():
        assert r.m == min(measure(r.w), 2), r.w


KEYS = [
    ("https://Www.ex.com//a///b/?q=1#f", "https://ex.com/a/b"),
    ("HTTP://WWW.Ex.com/", "http://ex.com"),
    ("http://u:p@ex.com:8080/a%2Bb+c%20d", "http://ex.com/a+b+c d"),
    ("/rel/x", "http:///rel/x"),
    ("//h.com/x", "http://h.com/x"),
    ("http://ex_a.com/p", "http:///p"),
    ("mailto:a@b.c", "mailto://"),
    ("javascript:void(0)", "javascript://"),
    ("http://ex.com/a|b", "ex.com/a|b"),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize("url,key", KEYS)
def test_crawl_key(spark, url, key):
    assert one(spark, urls.crawl_key(F.col("u")), u=url) == key


def test_page_key_and_others(spark):
    assert one(spark, urls.page_key(F.col("u")), u="mailto:x@y.z") is None
    assert one(spark, urls.page_key(F.col("u")), u="  ") is None
    assert one(spark, urls.page_key(F.col("u")), u=None) is None
    assert one(spark, urls.page_key(F.col("u")), u="HTTPS://www.A.org:443/x%41/") == "https://a.org/xA"
    assert one(spark, urls.index_key(F.col("u")), u="ex.com/a/#f") == "https://ex.com/a"
    assert one(spark, urls.index_key(F.col("u")), u="mailto:a@b") is None
    assert one(spark, urls.rank_key(F.col("u")), u=" https://A.org/X/#b ") == "https://a.org/x"
    assert one(spark, urls.rank_key(F.col("u")), u=None) == ""
    assert one(spark, urls.domain(F.col("u")), u="https://www.a.b.Co.uk/x") == "co.uk"
    assert one(spark, urls.same_domain(F.col("a"), F.col("b")), a="http://x.y.org", b="https://y.org/p") is True


def test_index_normalize(spark):
    got = one(spark, text.index_normalize(F.col("t")), t="Don't stop: the well-known Café was RED; singing birds played!")
    assert got == "dont stop wellknown caf was  sing birds pla"
    assert one(spark, text.index_tokens(F.col("t")), t="red bed") == []
    assert one(spark, text.index_tokens(F.col("t")), t=None) is None
    assert one(spark, text.light_stem(F.col("t"), "intended"), t="played") == "play"


TEXT = "Hello worlds! This is a test. hello again. hello!"


@pytest.mark.parametrize("needle,body,at", [("hello", TEXT, 30), ("Hello", TEXT, 0), ("world", TEXT, -1), (" test ", TEXT, 24), ("hello", 'say "hello"', -1), ("", "", 0), ("", "x", -1), ("a.c", "abc", -1)])
def test_sentence_index(spark, needle, body, at):
    assert one(spark, text.sentence_index(F.col("t"), needle), t=body) == at
    assert one(spark, text.contains_sentence(F.col("t"), needle), t=body) == (at >= 0)


def test_query_side(spark):
    assert one(spark, text.query_words(F.col("q")), q="Birds, well-known  'red'") == ["birds,", "well", "known", "red"]
    assert text.title_words("Two Words") == ["two words"] and text.title_words("Two-Words", "intended") == ["two", "words"]
    assert text.is_phrase('"a b"') and not text.is_phrase('""')
    assert one(spark, text.highlight_phrase(F.col("t"), "b c"), t="a <b>b</b> c d") == "a <b>b c</b> d"
    assert one(spark, text.highlight_phrase(F.col("t"), "b c"), t="a b c") == "a <b>b c</b>c"
    assert one(spark, text.highlight_phrase(F.col("t"), "b c", "intended"), t="a b c") == "a <b>b c</b>"
    assert one(spark, text.highlight_phrase(F.col("t"), "zz"), t="a b c") is None


def test_fingerprint_ignores_accents_case_and_spaces(spark):
    a = one(spark, text.fingerprint(F.col("t"), F.col("b")), t="Café", b=" the\nEND ")
    b = one(spark, text.fingerprint(F.col("t"), F.col("b")), t="CAFE", b=" The   end")
    assert a == b and one(spark, text.fingerprint(F.col("t"), F.col("b")), t=None, b=None)


PAGE = '<html><title>A &amp; B\n</title><body><!-- <h2>x</h2> --><h1>Head</h1><p>One <b>two</b>three<script>"</p>"</script><ul><li>item <p>inner</p></li></ul><a href="../c?x=1&amp;y=2">l</a><a href=\'//h.org/z\'>m</a></body></html>'


def test_html(spark):
    base = "https://a.org/b/d/e"
    assert one(spark, html.title(F.col("h")), h=PAGE) == "A & B"
    assert one(spark, html.headings(F.col("h")), h=PAGE) == [True, False, False]
    assert one(spark, html.hrefs(F.col("h")), h=PAGE) == ["../c?x=1&y=2", "//h.org/z"]
    assert one(spark, html.resolve(F.lit("/q"), F.col("b")), b=base) == "https://a.org/q"
    assert one(spark, html.resolve(F.lit("q"), F.col("b")), b=base) == "https://a.org/b/d/q"
    assert one(spark, html.resolve(F.lit("q"), F.col("b")), b="x") == ""
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, h string")
    got = {r.id: r.content for r in html.block_text(df, "id", "h").collect()}
    assert got == {1: "Head One twothree item inner inner ", 2: "", 3: ""}


def test_resolve_against_the_library(spark):
    from urllib.parse import urljoin

    bases = ["https://a.org", "https://a.org/b", "https://a.org/b/d/e", "http://h.a.org/b/d/"]
    given = ["", " ", "\t ", "#top", " #top ", "?x=1", "q", " q.html ", "d/q?r=/../s#t", "/q", "/", "//h.org/z", "../q", "../../../q", "./q", ".", "..", "d/../q", "/b/./c/../q", "https://x.org/y?z", "mailto:a@b.org", "javascript:void(0)"]
    rows = spark.createDataFrame([(b, x) for b in bases for x in given], "base string, link string")
    got = {(r.base, r.link): r.to for r in rows.select("base", "link", html.resolve(F.col("link"), F.col("base")).alias("to")).collect()}
    assert got == {(b, x): urljoin(b, x.strip()) for b in bases for x in given}


def test_page_links_of_every_page(spark, tmp_path):
    from urllib.parse import urljoin

    from siltworks.plans.reference import page_links_all

    links = {"a": ["https://x.org/1", None, " ", "#top"], "b/c": ["", "q?x=1", "../q", "/q", "//h.org/z", "?y=2"], "d": None, "e": [], "f": [None]}
    rows = [(i, f"https://a.org/{p}", "T", "text", v, None, "2024-01-01", "2024-01-01") for i, (p, v) in enumerate(links.items())]
    spark.createDataFrame(rows, "page_id long, url string, title string, content string, links array<string>, page_rank double, stored_at string, crawled_at string").write.parquet(f"{tmp_path}/visited_pages.parquet")
    got = {r.url: r.links for r in page_links_all(spark, str(tmp_path)).collect()}
    assert got == {u: [urljoin(u, x.strip()) for x in v or [] if x is not None] for u, v in ((f"https://a.org/{p}", v) for p, v in links.items())}


def test_entities_and_bare_links(spark):
    page = "<a href=http://a.org/x?a=1&amp;b=2>x</a> <a class=y href='../z'>z</a><a data-href=no>n</a> &#228;&#xE9;&eacute;&euro; &amp;lt; &nosuch; &#0; &lt"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    got = [r.l for r in df.select(html.hrefs(F.col("h")).alias("l")).collect()]
    assert got == [["http://a.org/x?a=1&b=2", "../z"], None, []]
    text = df.select(html.decode(F.col("h")).alias("t")).first().t
    assert text.endswith("äéé€ &lt; &nosuch; &#0; <")
