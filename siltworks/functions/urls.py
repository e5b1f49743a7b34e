"""URL keys as native column expressions.

Three keys with different rules exist side by side: the crawl key (identity of a page in the store), the index key
(what the link graph and the postings use) and the rank key (what results are grouped and shown by).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# An address that is its own crawl key: lower-case host without www., no port, query, fragment, escape or empty segment.
_PLAIN = r"^https?+://(?!www\.)(?:[a-z0-9]++(?:-[a-z0-9]++)*+\.)++[a-z][a-z0-9]*+(?:/[A-Za-z0-9._~-]++)*+$"


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def crawl_key(url: Column) -> Column:
    """``scheme://host/path`` with decoded path; null and empty give ``''``.

    Query, fragment, port and user info vanish; one leading ``www.`` and one trailing slash are dropped; runs of
    slashes shrink. Text that is no URI is lower-cased and stripped of scheme, ``www.``, fragment and query.
    """
    host, path, scheme = _part(url, "HOST"), _part(url, "PATH"), _part(url, "PROTOCOL")
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path, F.lit(""))
    slashes = F.regexp_replace(F.regexp_replace(decoded, "/+", "/"), "/$", "")
    parsed = F.concat(
        F.lower(F.coalesce(scheme, F.lit("http"))),
        F.lit("://"),
        F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", ""),
        slashes,
    )
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"https?://", ""), r"www\.", "")
    fallback = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"#.*$", ""), r"\?.*$", ""), "/+$", "")
    return (
        F.when(url.isNull() | (url == ""), F.lit(""))
        .when(url.rlike(_PLAIN), url)
        .when(host.isNull() & path.isNull() & scheme.isNull(), fallback)
        .otherwise(parsed)
    )


def names_page(url: Column) -> Column:
    """Whether a value is an absolute http(s) address; as a filter it costs less than the key and keeps it from being computed twice."""
    return url.rlike(r"^(?i)https?://[^/?#\s]")


def page_key(url: Column) -> Column:
    """The crawl key of an absolute http(s) address; null for every value that names no page."""
    return F.when(names_page(url), crawl_key(url))


def site_of(key: Column) -> Column:
    """The host in a crawl key."""
    return F.regexp_extract(key, r"^https?://([^/]*)", 1)


def domain(url: Column) -> Column:
    """Host without ``www.``, cut to its last two labels; ``''`` where there is no host."""
    host, path, scheme = _part(url, "HOST"), _part(url, "PATH"), _part(url, "PROTOCOL")
    bare = F.regexp_replace(host, r"^www\.", "")
    cut = F.lower(F.when(F.size(F.split(bare, r"\.")) > 2, F.substring_index(bare, ".", -2)).otherwise(bare))
    no_uri = host.isNull() & path.isNull() & scheme.isNull()
    return (
        F.when(url.isNull() | (url == ""), F.lit(""))
        .when(no_uri, F.substring_index(crawl_key(url), "/", 1))
        .otherwise(F.coalesce(cut, F.lit("")))
    )


def base_url(url: Column) -> Column:
    """The domain, or the crawl key's start up to the first slash behind the domain where the key begins with it."""
    key, dom = crawl_key(url), domain(url)
    rest = F.substring(key, F.length(dom) + F.lit(1), F.length(key))
    return F.when(F.startswith(key, dom) & (dom != ""), F.concat(dom, F.substring_index(rest, "/", 1))).otherwise(dom)


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def index_key(url: Column) -> Column:
    """The key of postings and edges: scheme added, fragment and trailing slashes cut; null for what is no page."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    key = F.regexp_replace(F.substring_index(full, "#", 1), "/+$", "")
    bad = url.isNull() | (url == "") | url.rlike("^(javascript:|mailto:|#)")
    return F.when(~bad & key.rlike(r"^https?:(//[^/:?#]*(:[0-9]*)?([/?#].*)?)?$"), key)


def rank_key(url: Column) -> Column:
    """Trimmed, lower-cased, without fragment and trailing slashes; null gives ``''``. Shown as the result's link."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "/+$", ""), F.lit(""))


def robots_base(url: Column) -> Column:
    """``protocol://host`` without port; the value itself where it can't be parsed."""
    return F.coalesce(F.concat(_part(url, "PROTOCOL"), F.lit("://"), _part(url, "HOST")), url)
