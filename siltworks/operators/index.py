"""Inverted index: tokens, postings with positions and snippets, document frequencies, IDF, TF-IDF."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.porter import with_stem
from siltworks.functions.text import index_tokens, index_words, words_of

WINDOW = 60
#: Words of a text that one row of a snippet's job holds.
CHUNK = 512
#: A vocabulary of up to so many words is stemmed once and broadcast; of a larger one every occurrence is stemmed in place.
VOCABULARY = 500_000


def with_stems(rows: DataFrame, word: str, out: str) -> DataFrame:
    """Add the stem of a lower-case word: by a broadcast vocabulary where its estimated size allows, else in place. Null words have null stems."""
    if rows.agg(F.approx_count_distinct(word)).first()[0] > VOCABULARY:
        return with_stem(rows, word, out)
    return rows.join(F.broadcast(with_stem(rows.select(word).where(F.col(word).isNotNull()).distinct(), word, out)), word, "left")


def tokens(pages: DataFrame, key: str, text: str, mode: str = "compat") -> DataFrame:
    """``key, position, token, term``: every indexed token with its stem.

    Positions count all tokens of the normalized text; tokens of up to two letters hold a position but are no terms.
    """
    return stemmed_tokens(token_lists(pages, key, text, mode), key)


def token_lists(pages: DataFrame, key: str, text: str, mode: str = "compat") -> DataFrame:
    """``key, tokens``: the tokens of each page in order. Kept, they spare the passes of stemmed_tokens the texts."""
    return pages.select(key, index_tokens(F.col(text), mode).alias("tokens"))


def stemmed_tokens(lists: DataFrame, key: str) -> DataFrame:
    """``key, position, token, term`` of token_lists."""
    rows = lists.select(key, F.posexplode("tokens").alias("position", "token")).where("length(token) > 2")
    return with_stems(rows, "token", "term").select(key, "position", "token", "term")


def term_frequencies(pages: DataFrame, key: str, text: str, mode: str = "compat") -> DataFrame:
    """``key, term, frequency, tf, positions``: one row per page and stem; tf is the part of the page's counted tokens."""
    return frequencies_of(tokens(pages, key, text, mode), key)


def frequencies_of(stemmed: DataFrame, key: str) -> DataFrame:
    """``key, term, frequency, tf, positions`` of stemmed tokens."""
    found = stemmed.groupBy(key, "term").agg(F.count("*").cast("int").alias("frequency"), F.sort_array(F.collect_list("position")).alias("positions"))
    total = F.sum("frequency").over(Window.partitionBy(key))
    return found.select(key, "term", "frequency", (F.col("frequency") / total).alias("tf"), "positions")


def heading_flags(pages: DataFrame, terms: DataFrame, key: str, levels: tuple[str, str, str]) -> DataFrame:
    """``key, term, headers``: per level whether any heading's lower-case text contains the stem as a substring."""
    has = lambda c: F.coalesce(F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.col("term"))), F.lit(False))
    return terms.select(key, "term").join(pages.select(key, *levels), key).select(key, "term", F.array(*[has(c) for c in levels]).alias("headers"))


def raw_words(pages: DataFrame, key: str, text: str, mode: str = "compat") -> DataFrame:
    """``key, at, term``: the stem by which each raw word of a text is matched; words without one are left out.

    Compat stems the lower-case raw word with its punctuation; intended stems it as the index does.
    """
    raw = pages.select(key, F.posexplode(words_of(F.col(text))).alias("at", "word"))
    match = F.lower("word") if mode == "compat" else F.coalesce(F.try_element_at(index_words(F.col("word"), mode), F.lit(1)), F.lit(""))
    return with_stems(raw.select(key, "at", match.alias("match")).where("match <> ''"), "match", "term").select(key, "at", "term").where("term <> ''")


def word_chunks(pages: DataFrame, key: str, text: str, width: int = WINDOW) -> DataFrame:
    """``key, chunk, first, total, words``: CHUNK words of a text a row, with ``width`` words of both neighbours; ``first`` is the number of the first word held."""
    whole = pages.select(key, words_of(F.col(text)).alias("w")).where("size(w) > 0")
    rows = whole.select(key, "w", F.explode(F.sequence(F.lit(0), F.expr(f"(size(w) - 1) div {CHUNK}").cast("int"))).alias("chunk"))
    first = F.greatest(F.lit(0), F.col("chunk") * CHUNK - width)
    held = F.slice("w", first + 1, F.lit(CHUNK + 2 * width))
    return rows.select(key, "chunk", first.alias("first"), F.size("w").alias("total"), held.alias("words"))


def _window(at: Column, spots: Column, width: int) -> Column:
    """The window of ``width`` words around word ``at`` (0-based), moved inside the text, with the words at ``spots`` in bold.

    As the index writes them: a space behind every word, dots where the text goes on, blanks trimmed at the ends.
    """
    n, base = F.col("total"), F.col("first")
    start = F.greatest(F.lit(0), at - width // 2)
    end = F.least(n, start + width)
    start = F.when(end - start < width, F.greatest(F.lit(0), end - width)).otherwise(start)
    build = lambda s, e: F.trim(
        F.concat(
            F.when(s > 0, "... ").otherwise(""),
            F.array_join(
                F.transform(F.slice("words", s - base + 1, e - s), lambda w, i: F.when(F.array_contains(spots, s + i), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " "
            ),
            F.when(e < n, " ...").otherwise(""),
        )
    )
    bounds = F.array(F.struct(start.alias("s"), end.alias("e")))
    return F.element_at(F.transform(bounds, lambda b: build(b["s"], b["e"])), 1)


def snippets_at(chunks: DataFrame, places: DataFrame, key: str, width: int = WINDOW) -> DataFrame:
    """``key, term, snippets`` of ``places(key, term, at)``: one snippet per place, in text order, from the words of word_chunks.

    A chunk meets its places once, and windows are cut inside the row, so the work grows with the snippets' length only.
    """
    own = places.select(key, "term", "at", F.expr(f"at div {CHUNK}").cast("int").alias("chunk"))
    # words up to a window's width away are bold, too, so a chunk knows its neighbours' places of the same term
    near = own.withColumn("c", F.explode(F.array_distinct(F.array(*[F.expr(f"int((at + {d}) div {CHUNK})") for d in (-width, 0, width)])))).where("c >= 0")
    lists = near.groupBy(key, F.col("c").alias("chunk"), "term").agg(F.sort_array(F.collect_list("at")).alias("spots"))
    per_chunk = lists.groupBy(key, "chunk").agg(F.collect_list(F.struct("term", "spots")).alias("terms"))
    inside = lambda at: F.expr("chunk") == (at / CHUNK).cast("int")
    cut = lambda t: F.transform(F.filter(t["spots"], inside), lambda at: F.struct(at.alias("at"), _window(at, t["spots"], width).alias("snippet")))
    made = chunks.join(per_chunk, [key, "chunk"]).select(key, F.explode(F.transform("terms", lambda t: F.struct(t["term"].alias("term"), cut(t).alias("made")))).alias("x"))
    parts = made.select(key, "x.term", "x.made").where("size(made) > 0")
    return parts.groupBy(key, "term").agg(F.transform(F.array_sort(F.flatten(F.collect_list("made"))), lambda x: x["snippet"]).alias("snippets"))


def snippets(pages: DataFrame, terms: DataFrame, key: str, text: str, width: int = WINDOW, mode: str = "compat") -> DataFrame:
    """``key, term, snippets``: one snippet per occurrence of a term's stem among the raw words, in text order.

    ``terms(key, term)`` are the terms wanted. Texts are stemmed once and cut into chunks; texts of any length cost in
    proportion to it.
    """
    places = raw_words(pages, key, text, mode).join(terms.select(key, "term").distinct(), [key, "term"], "left_semi")
    return snippets_at(word_chunks(pages, key, text, width), places, key, width)


def wide_snippets(pages: DataFrame, key: str, text: str, term: str, around: int = 35) -> DataFrame:
    """``key, snippet``: windows of ``around`` words on both sides of each word whose bare stem is the term, one a line."""
    raw = pages.select(key, F.posexplode(words_of(F.col(text))).alias("at", "word"))
    rows = with_stems(raw.withColumn("bare", F.regexp_replace(F.lower("word"), r"\W", "")), "bare", "stem")
    w = Window.partitionBy(key).orderBy("at")
    near = rows.withColumn("near", F.array_join(F.collect_list("word").over(w.rowsBetween(-around, around)), " ")).where(F.col("stem") == term)
    line = F.transform(F.array_sort(F.collect_list(F.struct("at", "near"))), lambda x: F.concat(F.lit("- "), x["near"]))
    return near.groupBy(key).agg(F.array_join(line, "\n").alias("snippet"))


def character_snippets(pages: DataFrame, key: str, text: str, term: str, length: int = 150) -> DataFrame:
    """``key, snippet``: ``length`` characters around the first word whose stem (case kept) is the term.

    The start moves back behind the space at or before it, the end on to the next space, and cuts are marked. Every
    match of the text, wherever it stands, makes its spelling bold once more, whatever the case, so repeats nest. Texts
    without a match give a space, null texts an empty string.
    """
    words = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\b\w+\b"), F.lit(0))).alias("at", "word"))
    hit = with_stems(words, "word", "stem").where(F.col("stem") == term)
    spelled = hit.groupBy(key, F.lower("word").alias("w")).agg(F.count("*").cast("int").alias("n"), F.min(F.struct("at", "word")).alias("first"))
    first = spelled.groupBy(key).agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("w", "n"))).alias("hits")).select(key, "first.word", "hits")
    rows = pages.select(key, F.col(text).alias("text")).join(first, key, "left")
    at = F.regexp_instr("text", F.concat(F.lit(r"\b"), F.col("word"), F.lit(r"\b"))) - 1
    lo, hi = F.greatest(F.lit(0), at - length // 2), F.least(F.length("text"), at + F.length("word") + length // 2)
    before = F.substring("text", F.lit(1), lo + 1)
    start = F.when(lo > 0, F.when(F.contains(before, F.lit(" ")), F.length(before) - F.length(F.substring_index(before, " ", -1))).otherwise(0)).otherwise(0)
    after = F.substring(F.col("text"), hi + 1, F.length("text"))
    stop = F.when(hi < F.length("text"), hi + F.length(F.substring_index(after, " ", 1))).otherwise(hi)
    cut = F.substring(F.col("text"), start + 1, stop - start)
    # spellings never overlap, so those that differ by more than case can be marked one after the other
    bold = F.aggregate("hits", cut, lambda s, h: F.regexp_replace(s, F.concat(F.lit(r"(?i)\b"), h["w"], F.lit(r"\b")), F.concat(F.repeat(F.lit("<b>"), h["n"]), F.lit("$0"), F.repeat(F.lit("</b>"), h["n"]))))
    marked = F.concat(F.when(start > 0, "...").otherwise(""), bold, F.when(stop < F.length("text"), "...").otherwise(""))
    return rows.select(key, F.when(F.col("text").isNull(), "").when(F.col("word").isNull(), " ").otherwise(marked).alias("snippet"))


def document_frequencies(postings: DataFrame, key: str = "url") -> DataFrame:
    return postings.groupBy("term").agg(F.count_distinct(key).alias("df"))


def with_idf(stats: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Add ``idf`` = ln(N / (1 + df)); ``n_pages`` is one row. It is 0 at df = N - 1 and negative at df = N."""
    return stats.crossJoin(F.broadcast(n_pages)).withColumn("idf", F.when(F.col("n_pages") > 0, F.log(F.col("n_pages") / (1 + F.col("df"))))).drop("n_pages")


def term_stats(postings: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """``term, df, idf`` over all pages, indexed or not."""
    return with_idf(document_frequencies(postings, key), pages.agg(F.count("*").alias("n_pages")))


def build_postings(pages: DataFrame, mode: str = "compat", with_snippets: bool = True) -> DataFrame:
    """``term, url, title, frequency, tf, positions, headers, snippets`` of ``pages(url, title, content, h1, h2, h3)``.

    Null contents give no postings. Terms without a raw word of their stem have a null ``snippets``.
    """
    base = term_frequencies(pages, "url", "content", mode).join(pages.select("url", "title"), "url")
    flagged = base.join(heading_flags(pages, base, "url", ("h1", "h2", "h3")), ["url", "term"])
    out = ["term", "url", "title", "frequency", "tf", "positions", "headers"]
    if not with_snippets:
        return flagged.select(*out)
    return flagged.join(snippets(pages, base, "url", "content", mode=mode), ["url", "term"], "left").select(*out, "snippets")


def nested_index(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf, pages``: the index with its postings embedded, for export; hot terms make long arrays."""
    pages = F.array_sort(F.collect_list(F.struct("url", "frequency", "tf")))
    return postings.groupBy("term").agg(pages.alias("pages")).join(stats, "term").select("term", "df", "idf", "pages")
