"""The Porter stemmer as staged native columns, and the same stages as SQL text.

Consonant y is written Y once, at the start; a suffix edit never changes the class of a letter before it. With that,
the measure and the conditions of every rule are regular expressions. Each stage is a column (or a subquery) of its
own, so expressions stay small and no stage is computed twice.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V, C = "[aeiouy]", "[^aeiouy]"
SOME, MANY, ONE = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+{V}*$"
VOWEL, CVC = V, f"{C}{V}[^aeiouywxY]$"

# The published suffix tables, in rule order.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


class _Spark:
    """Builds stages from columns."""

    def ends(self, w: Column, s: str) -> Column:
        return w.endswith(s)

    def cut(self, w: Column, n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    def like(self, w: Column, r: str) -> Column:
        return w.rlike(r)

    def add(self, w: Column, s: str) -> Column:
        return F.concat(w, F.lit(s)) if s else w

    def both(self, a: Column, b: Column) -> Column:
        return a & b

    def either(self, a: Column, b: Column) -> Column:
        return a | b

    def no(self, a: Column) -> Column:
        return ~a

    def pick(self, cases: list[tuple[Column, Column]], other: Column) -> Column:
        out = None
        for c, v in cases:
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(other)

    def twin(self, w: Column) -> Column:
        return (F.length(w) > 1) & (F.lower(F.substring(w, -1, 1)) == F.lower(F.substring(w, -2, 1))) & w.rlike(f"{C}$")


class _Sql:
    """Builds stages as SQL."""

    def ends(self, w: str, s: str) -> str:
        return f"ends_with({w}, '{s}')"

    def cut(self, w: str, n: int) -> str:
        return f"substring({w}, 1, greatest(length({w}) - {n}, 0))"

    def like(self, w: str, r: str) -> str:
        return f"regexp_matches({w}, '{r}')"

    def add(self, w: str, s: str) -> str:
        return f"{w} || '{s}'" if s else w

    def both(self, a: str, b: str) -> str:
        return f"({a} and {b})"

    def either(self, a: str, b: str) -> str:
        return f"({a} or {b})"

    def no(self, a: str) -> str:
        return f"(not {a})"

    def pick(self, cases: list[tuple[str, str]], other: str) -> str:
        return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + f" else {other} end"

    def twin(self, w: str) -> str:
        return f"(length({w}) > 1 and lower({w}[-1]) = lower({w}[-2]) and regexp_matches({w}, '{C}$'))"


def _stages(b):
    """Functions of one word each, to be applied in order."""
    swap = lambda w, table: b.pick([(b.ends(w, s), b.pick([(b.like(b.cut(w, len(s)), SOME), b.add(b.cut(w, len(s)), r))], w)) for s, r in table], w)

    def plural(w):
        return b.pick([(b.ends(w, "sses"), b.cut(w, 2)), (b.ends(w, "ies"), b.cut(w, 2)), (b.ends(w, "ss"), w), (b.ends(w, "s"), b.cut(w, 1))], w)

    def past(w):
        """A trailing # marks words whose -ed or -ing went, for the next stage."""
        gone = lambda n: b.pick([(b.like(b.cut(w, n), VOWEL), b.add(b.cut(w, n), "#"))], w)
        return b.pick([(b.ends(w, "eed"), b.pick([(b.like(b.cut(w, 3), SOME), b.cut(w, 1))], w)), (b.ends(w, "ed"), gone(2)), (b.ends(w, "ing"), gone(3))], w)

    def repair(w):
        s = b.cut(w, 1)
        ends = lambda x: b.ends(w, x + "#")
        fixed = b.pick(
            [
                (b.either(ends("at"), b.either(ends("bl"), ends("iz"))), b.add(s, "e")),
                (b.twin(s), b.pick([(b.like(s, "[lsz]$"), s)], b.cut(s, 1))),
                (b.both(b.like(s, ONE), b.like(s, CVC)), b.add(s, "e")),
            ],
            s,
        )
        return b.pick([(b.ends(w, "#"), fixed)], w)

    def final_y(w):
        return b.pick([(b.both(b.like(w, "[yY]$"), b.like(b.cut(w, 1), VOWEL)), b.add(b.cut(w, 1), "i"))], w)

    def remove(w):
        cases = []
        for s in STEP4:
            hit = b.like(w, "[st]ion$") if s == "ion" else b.ends(w, s)
            cases.append((hit, b.pick([(b.like(b.cut(w, len(s)), MANY), b.cut(w, len(s)))], w)))
        return b.pick(cases, w)

    def final_e(w):
        s = b.cut(w, 1)
        goes = b.either(b.like(s, MANY), b.both(b.like(s, ONE), b.no(b.like(s, CVC))))
        return b.pick([(b.both(b.ends(w, "e"), goes), s)], w)

    def final_l(w):
        return b.pick([(b.both(b.ends(w, "ll"), b.like(w, MANY)), b.cut(w, 1))], w)

    return [plural, past, repair, final_y, lambda w: swap(w, STEP2), lambda w: swap(w, STEP3), remove, final_e, final_l]


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of up to two characters and nulls stay, as do words with a ``#``.

    Each stage is bound as a lambda's variable: the expression stays linear in the number of stages wherever the
    optimizer copies it, and no stage is computed twice.
    """
    plain = (F.length(word) <= 2) | word.contains("#")
    out = F.replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), F.lit("yy"), F.lit("yY"))
    for stage in _stages(_Spark()):
        out = F.element_at(F.transform(F.array(out), stage), 1)
    return F.when(plain, word).otherwise(F.replace(out, F.lit("Y"), F.lit("y")))


def with_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """Add the stem of a lower-case word."""
    return df.withColumn(out, stem(F.col(word)))


def stem_sql(source: str, word: str, out: str) -> str:
    """A query with all columns of ``source`` and the stem of ``word`` as ``out``."""
    marked = f"case when length({word}) > 2 and not contains({word}, '#') then replace(regexp_replace({word}, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY') end"
    q = f"select *, {marked} as stem_0 from ({source})"
    for i, stage in enumerate(_stages(_Sql())):
        q = f"select * exclude (stem_{i}), {stage(f'stem_{i}')} as stem_{i + 1} from ({q})"
    return f"select * exclude (stem_{i + 1}), coalesce(replace(stem_{i + 1}, 'Y', 'y'), {word}) as {out} from ({q})"
