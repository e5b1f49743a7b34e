"""HTML functions on columns, without a DOM: a page is cut at its tags and a window keeps the open block."""

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Entities that are decoded even without their semicolon; &amp; must come last.
ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", " "), ("&#39;", "'"), ("&amp;?", "&"))
BLOCKS = ("h1", "h2", "h3", "p", "li")
_INVISIBLE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def _numbered(entity: Column) -> Column:
    """The character of ``&#228;`` or ``&#xe4;``; the entity itself where there is none."""
    digits = F.regexp_extract(entity, "(?i)^&#x?([0-9a-f]+);$", 1)
    code = F.when(F.length(digits) < 8, F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), char).otherwise(entity)


def _named(entity: Column) -> Column:
    """The character of a named entity of HTML 4; the entity itself where there is none."""
    own = {e.rstrip(";?") for e, _ in ENTITIES}
    names = F.create_map(*[F.lit(x) for n, c in name2codepoint.items() if f"&{n}" not in own for x in (f"&{n};", chr(c))])
    return F.coalesce(F.try_element_at(names, entity), entity)


def decode(text: Column) -> Column:
    """Numbered and named entities as characters. ``&amp;`` is decoded last, so nothing is decoded twice."""
    others = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)&#[0-9]+;|&#x[0-9a-f]+;|&[a-z][a-z0-9]*;"), F.lit(0)))
    known = F.filter(others, lambda e: e != "&amp;")
    replaced = F.aggregate(known, text, lambda t, e: F.replace(t, e, F.when(e.startswith("&#"), _numbered(e)).otherwise(_named(e))))
    out = F.when(text.rlike("&[#A-Za-z]"), replaced).otherwise(text)
    for e, c in ENTITIES:
        out = F.regexp_replace(out, e, c)
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def visible(html: Column) -> Column:
    """Without comments, scripts and styles."""
    return F.regexp_replace(html, _INVISIBLE, "")


def title(html: Column) -> Column:
    return squeeze(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def full_text(html: Column) -> Column:
    """Text of the body: block tags separate words, inline tags do not."""
    body = F.regexp_replace(visible(html), r"(?is)^.*?<body\b[^>]*>|</body>.*$", "")
    blocks = F.regexp_replace(body, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|th|table|section|article|nav|header|footer|blockquote|pre|form)\b[^>]*>", " ")
    return squeeze(decode(F.regexp_replace(blocks, r"<[^>]*>", "")))


def headings(html: Column) -> Column:
    """Presence of h1, h2 and h3."""
    return F.array(*[visible(html).rlike(rf"(?i)<h{k}\b") for k in (1, 2, 3)])


def heading_texts(html: Column, level: int) -> Column:
    raw = F.regexp_extract_all(visible(html), F.lit(rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>"), F.lit(1))
    return F.transform(raw, lambda x: squeeze(decode(F.regexp_replace(x, "<[^>]*>", ""))))


def hrefs(html: Column) -> Column:
    """The ``href`` of every anchor that has one, in double, single or no quotes."""
    raw = F.regexp_extract_all(visible(html), F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(raw, lambda x: decode(F.regexp_replace(x, r"""^["']|["']$""", "")))


def _without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments; those above the root vanish."""
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    open_end = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), open_end)).otherwise(path)


def resolve(link: Column, base: Column) -> Column:
    """Absolute form of a link on the page ``base``; ``''`` where there is none. Blanks around a link don't count."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(page, r"^https?://[^/]+", ""), "/[^/]*$", "")
    link = F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    way, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(root == "", "")
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, _without_dots(way), rest))
        .when(link.startswith("#") | (link == ""), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, F.lit("/"), way)), rest))
    )


def links(html: Column, base: Column) -> Column:
    return F.transform(hrefs(html), lambda x: resolve(x, base))


def strip_tags(text: Column) -> Column:
    """Delete tags from lines joined by spaces; scripts' text stays."""
    return F.regexp_replace(F.regexp_replace(text, "\r?\n", " "), r"(?i)<[^>]*>", "")


def block_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, content``: text of h1-h3, p and li in document order, a space behind each; p in li counts for both.

    The page is cut at ``<``; the running maximum over tags gives each piece its open block and its open list item. A
    block ends at its closing tag or at the next block's start; inline tags change nothing. Pages without blocks give
    an empty string; a null page gives one, too.
    """
    pieces = pages.select(F.col(key), F.posexplode(F.split(F.coalesce(visible(F.col(html)), F.lit("")), "<"))).withColumnRenamed("pos", "at")
    tag = F.lower(F.regexp_extract("col", r"^(/?[A-Za-z][A-Za-z0-9]*)", 1))
    text = F.when(F.col("at") == 0, "").otherwise(F.regexp_replace("col", r"^[^>]*>", ""))
    space = F.when(tag.rlike("^/?(br|div|ul|ol|table|tr|td|p|li|h[1-6])$"), " ").otherwise("")
    rows = pieces.select(key, "at", tag.alias("tag"), F.concat(space, text).alias("text"))
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    leaf = [b for b in BLOCKS if b != "li"]
    opens = F.when(F.col("tag").isin(*BLOCKS), F.struct("at", "tag")).when(F.col("tag").isin(*[f"/{b}" for b in BLOCKS]), F.struct("at", F.lit("").alias("tag")))
    item = F.when(F.col("tag") == "li", F.struct("at", "tag")).when(F.col("tag") == "/li", F.struct("at", F.lit("").alias("tag")))
    inside = rows.withColumn("block", F.last(opens, ignorenulls=True).over(order)).withColumn("item", F.last(item, ignorenulls=True).over(order))
    own = inside.where(F.col("block.tag").isin(*leaf)).select(key, F.col("block.at").alias("start"), "at", "text")
    listed = inside.where("item.tag = 'li'").select(key, F.col("item.at").alias("start"), "at", "text")
    texts = own.unionByName(listed).groupBy(key, "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("text"))
    joined = texts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: F.concat(squeeze(decode(x["text"])), F.lit(" "))), "").alias("content"))
    return pages.select(key).join(joined, key, "left").withColumn("content", F.coalesce("content", F.lit("")))
