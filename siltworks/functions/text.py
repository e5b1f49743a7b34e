"""Text functions of indexing and search as native column expressions."""

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never indexed.
STOP_WORDS = ("the", "is", "in", "at", "of", "on", "and", "a", "to", "an", "by", "for", "with", "it", "as")
#: Characters that separate words of a query, and characters that bound a sentence.
QUERY_SEPARATORS = r"""[\s\-_.!@#'"]+"""
BOUNDARY = r"\p{javaWhitespace}.!?,;:()\[\]{}"


def _ascii_bases() -> tuple[str, str]:
    """Every character whose canonical decomposition holds one ASCII character, and that character."""
    found = {}
    for code in range(0x80, 0x2FFFF):
        plain = [c for c in unicodedata.normalize("NFD", chr(code)) if c < "\x80"]
        if len(plain) == 1:
            found[chr(code)] = plain[0]
    return "".join(found), "".join(found.values())


_ACCENTED, _BASES = _ascii_bases()


def fingerprint_text(title: Column, body: Column) -> Column:
    """Title and body, decomposed, without non-ASCII characters, single-spaced, lower-cased, trimmed; null is empty."""
    whole = F.translate(F.concat(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), _ACCENTED, _BASES)
    spaced = F.regexp_replace(F.regexp_replace(whole, r"[^\x00-\x7f]", ""), r"[ \t\n\x0B\f\r]+", " ")
    return F.regexp_replace(F.lower(spaced), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def fingerprint(title: Column, body: Column) -> Column:
    """Base64 of the MD5 of the fingerprint text."""
    return F.base64(F.unhex(F.md5(fingerprint_text(title, body))))


def light_stem(word: Column, mode: str = "compat") -> Column:
    """Drop ``ing`` or, in compat mode with three letters as well, ``ed``."""
    if mode == "intended":
        return F.regexp_replace(word, "(ing|ed)$", "")
    return F.when(word.rlike("(ing|ed)$"), F.substring(word, F.lit(1), F.greatest(F.length(word) - 3, F.lit(0)))).otherwise(word)


def index_words(text: Column, mode: str = "compat") -> Column:
    """Array of light-stemmed words of more than two letters that are no stop words; may hold empty strings."""
    letters = F.regexp_replace(F.lower(text), r"[^a-z\s]", "")
    words = F.filter(F.split(letters, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.transform(words, lambda w: light_stem(w, mode))


def index_normalize(text: Column, mode: str = "compat") -> Column:
    """The words of index_words joined by spaces, trimmed; emptied words leave double spaces."""
    return F.trim(F.array_join(index_words(text, mode), " "))


def index_tokens(text: Column, mode: str = "compat") -> Column:
    """Tokens of the normalized text; an element's index is its position."""
    return F.filter(index_words(text, mode), lambda w: w != "")


def query_words(query: Column) -> Column:
    """Lower-cased words of a query; commas, question marks, colons and slashes belong to words."""
    return F.filter(F.split(F.lower(query), QUERY_SEPARATORS), lambda w: w != "")


def title_words(query: str, mode: str = "compat") -> list[str]:
    """What titles are searched for: in compat mode the whole lower-cased query counts as one word."""
    if mode == "intended":
        return [w for w in re.split(QUERY_SEPARATORS, query.lower()) if w]
    return re.split(r"""[\s\-_.!@#]+"'""", query.lower())


def is_phrase(query: str) -> bool:
    return len(query) > 2 and query[0] == query[-1] == '"'


def sentence_pattern(needle: str) -> str:
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return rf"(\A|[{BOUNDARY}]){quoted}(\z|[{BOUNDARY}])"


def contains_sentence(text: Column, needle: str) -> Column:
    """Whether the trimmed needle stands in the text between boundaries; case matters."""
    needle = needle.strip()
    return F.coalesce(text == "", F.lit(False)) if not needle else F.coalesce(text.rlike(sentence_pattern(needle)), F.lit(False))


def sentence_index(text: Column, needle: str) -> Column:
    """0-based place of the needle between boundaries, or -1; an empty needle is found at 0 of an empty text only."""
    needle = needle.strip()
    if not needle:
        return F.when(text == "", 0).otherwise(-1)
    at = F.regexp_instr(text, F.lit(sentence_pattern(needle)))
    shift = F.when(F.substring(text, at, F.lit(len(needle))) == needle, at - 1).otherwise(at)
    return F.when(F.coalesce(at, F.lit(0)) == 0, -1).otherwise(shift)


def strip_bold(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit(""))


def words_of(text: Column) -> Column:
    """Split at white space; a leading empty word stays, trailing ones go."""
    w = F.split(text, r"\s+")
    return F.when(F.element_at(w, -1) == "", F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)


def highlight_phrase(snippet: Column, phrase: str, mode: str = "compat") -> Column:
    """The first occurrence of the phrase in bold; compat repeats the last character where the phrase ends the text.

    Null where the phrase does not occur.
    """
    plain = strip_bold(snippet)
    at, n = F.instr(plain, phrase), len(phrase)
    end = at - 1 + n
    if mode != "intended":
        end = F.when(end >= F.length(plain), F.length(plain) - 1).otherwise(end)
    marked = F.concat(F.substring(plain, F.lit(1), at - 1), F.lit("<b>"), F.lit(phrase), F.lit("</b>"), F.substring(plain, end + 1, F.length(plain)))
    return F.when(at > 0, marked)
