"""Pieces of the SQL that several queries share."""


def key_sql(u: str) -> str:
    """The crawl key of an http(s) address in SQL; written for well-formed addresses."""
    path = f"url_decode(replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '+', '%2B'))"
    return (
        f"case when regexp_matches({u}, '^(?i)https?://[^/?#\\s]') then lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)) || '://' || "
        f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') || "
        f"regexp_replace(regexp_replace({path}, '/+', '/', 'g'), '/$', '') end"
    )


def term_sql(t: str) -> str:
    return f"nullif(lower(trim({t})), '')"


def occurrences_sql() -> str:
    return "coalesce(frequency, len(positions), 0)"
