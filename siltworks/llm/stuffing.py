"""Finds pages of keywords, link lists and product tags instead of written text, and the furniture of the others.

Each line's words become classes: common words stay themselves, others keep only their shape and whether they just
occurred; each line becomes a class of its length, end, list mark and the page's links per word. N-gram models over
both sequences, trained on pages of written text, give each block of lines a perplexity; blocks far off what written
text shows, above or below, are filler. A page whose filler holds more than half of its words, furniture apart, is a
case. Reviews err: a page that a model of the reviewed filler explains better than the model of written text, both
fitted without the page, is not trained on as written text.
"""

import itertools
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.urls import page_key, site_of
from siltworks.llm import mainbody
from siltworks.llm.lines import frequent_line_ids, line_form
from siltworks.llm.mainbody import MAIN, Classifier, Page
from siltworks.operators.skew import sized_join
from siltworks.session import remove_path, shared_folder

#: Lines that one task learns from at a time, on average: the line classifier is fitted to shards of so many.
SHARD_LINES = 200_000
COMMON, COMMON_SHARE = 250, 0.02
BLOCK_WORDS = 12
ORDER, BACK = 3, 3.0
FOLDS, ROUNDS = 5, 2
#: Part of the pages reviewed as 'ok' that is trusted: what the models tell apart less clearly isn't trained on.
CLEAR = 0.98
#: Part of the trusted pages without a review that the band may leave out at no cost.
FREE = 0.05
#: How far the band reaches beyond the perplexities of written text at most.
MARGIN = 0.1
#: Sites on which a masked line has to recur to be known as furniture anywhere.
LEAST_SITES = 4
#: Perplexities are binned for their quantiles, and so many upper ends of the band are tried.
BINS, HIGHS = 10_000, 200
#: Word classes that a task handles at a time.
PIECE = 500_000
#: Part of all titles that an opening begins at least.
OPENING_SHARE = 0.003
_TOKEN = re.compile(r"https?://\S+|#\w+|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]")
_LINE_END = re.compile(r"[.!?…:][\"”»'’)]*$")
_SHAPES = ("?", "#tag", "url", "0", *(a + b + c for a in ("", "again-") for b in ("Cap", "low") for c in ("", "-short")))


def word_count(line: str) -> int:
    return len(line.split())


def least_pages(pages: int) -> float:
    """Number of pages from which a word is common."""
    return max(3, COMMON_SHARE * pages)


def words_of(text: list[str]) -> set[str]:
    return {t.lower() for s in text for t in _TOKEN.findall(s)}


class Classes:
    """Word classes: common words and marks of the pages stay themselves, others keep their shape."""

    def __init__(self, df: dict[str, int], pages: int):
        """``df`` holds on how many of ``pages`` a word stands; words below the share may be left out."""
        least = least_pages(pages)
        known = sorted((w for w, n in df.items() if n >= least), key=lambda w: (-df[w], w))
        words = [w for w in known if w.isalpha()][:COMMON]
        marks = [w for w in known if not w[:1].isalnum() and len(w) == 1]
        self.words = {w: len(_SHAPES) + i for i, w in enumerate(words)}
        self.marks = {m: len(_SHAPES) + len(words) + i for i, m in enumerate(marks)}
        self.end = len(_SHAPES) + len(words) + len(marks)

    @property
    def size(self) -> int:
        return self.end + 1

    def of(self, line: str) -> list[int]:
        """Classes of a line's words, ending in a line break; looking back over its last 12 uncommon words only."""
        out, recent = [], []
        for t in _TOKEN.findall(line):
            w = t.lower()
            c = self.words.get(w)
            if c is None:
                first = t[0]
                if first.isalpha() and "://" not in t:
                    c = 4 + 4 * (w in recent) + 2 * (not first.isupper()) + (len(t) < 4)
                    recent.append(w)
                    if len(recent) > 12:
                        del recent[0]
                else:
                    c = 3 if first.isdigit() else 1 if first == "#" and len(t) > 1 else 2 if first.isalpha() else self.marks.get(t, 0)
            out.append(c)
        return [*out, self.end]


def line_class(line: str, words: int, density: int) -> int:
    """Class of a line by its length, its end, a list mark and how many links the page has for its words."""
    ends, marked = bool(_LINE_END.search(line)), bool(mainbody._BULLET.match(line))
    return ((density * 4 + min(int(math.log2(max(words, 1))), 3)) * 2 + ends) * 2 + marked


LINE_CLASSES = 8 * 4 * 2 * 2


def link_density(links: int, words: int) -> int:
    return min(int(math.log2(1 + 100 * links / max(words, 1))), 7)


#: Sorted keys and how often each occurs.
Counts = tuple[np.ndarray, np.ndarray]


def merged(counts: list[Counts]) -> Counts:
    """The sum of several counts."""
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in counts]), minlength=len(keys)).astype(np.int64)


def added(counts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> dict[int, Counts]:
    """The sum of ``(table, keys, numbers)`` by table."""
    by: dict[int, list[Counts]] = {}
    for table, keys, n in counts:
        by.setdefault(table, []).append((keys, n))
    return {t: merged(c) for t, c in by.items()}


class Grams:
    """N-gram counts over class sequences; probabilities by interpolation with the lower orders."""

    def __init__(self, size: int, counts: list[Counts]):
        """``counts`` holds the keys of the n-grams of each order and how often they occur."""
        self.size, self.total, self.counts = size, int(counts[0][1].sum()), counts
        self.before = [merged([(keys // size, n)]) for keys, n in counts[1:]]

    @staticmethod
    def keys(size: int, codes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """``first`` holds for each position where its sequence starts; no n-gram crosses a start."""
        at, out = np.arange(len(codes)), [codes.astype(np.int64)]
        for k in range(1, ORDER):
            whole, key = at - k >= first, np.full(len(codes), -1, np.int64)
            key[whole] = out[-1][at[whole] - 1] * size + codes[whole]
            out.append(key)
        return out

    @staticmethod
    def _count(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        known, n = table
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, n[at], 0)

    def cost(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Negative logarithm of the probability of each position."""
        keys = self.keys(self.size, codes, first)
        p = (self._count(self.counts[0], keys[0]) + 0.5) / (self.total + 0.5 * self.size)
        for k in range(1, ORDER):
            q = (self._count(self.counts[k], keys[k]) + BACK * p) / (self._count(self.before[k - 1], keys[k] // self.size) + BACK)
            p = np.where(keys[k] >= 0, q, p)
        return -np.log(p)


@dataclass
class Sequences:
    """Word and line classes of many pages, one after the other, and the blocks and pages that they belong to."""

    codes: np.ndarray
    #: Of each line its word classes, its class and its block.
    sizes: np.ndarray
    lines: np.ndarray
    line_block: np.ndarray
    #: Of each block its words and its page.
    words: np.ndarray
    page: np.ndarray
    pages: int

    def __post_init__(self):
        of_line = self.page[self.line_block]
        starts = lambda n: np.cumsum(n) - n
        self.block = np.repeat(self.line_block, self.sizes)
        self.first = starts(np.bincount(of_line, self.sizes, self.pages).astype(np.int64))[self.page[self.block]]
        self.line_first = starts(np.bincount(of_line, minlength=self.pages))[of_line]

    def only(self, chosen: np.ndarray) -> "Sequences":
        """The chosen pages, under their numbers."""
        use = chosen[self.page]
        of_line = use[self.line_block]
        codes = self.codes[np.repeat(of_line, self.sizes)]
        return Sequences(codes, self.sizes[of_line], self.lines[of_line], (np.cumsum(use) - 1)[self.line_block[of_line]], self.words[use], self.page[use], self.pages)

    def filler_share(self, bad: np.ndarray) -> np.ndarray:
        """Part of each page's words that are in bad blocks."""
        total = np.bincount(self.page, self.words, minlength=self.pages)
        return np.bincount(self.page, self.words * bad, minlength=self.pages) / np.maximum(total, 1)


def sequences(classes: Classes, pages: list[tuple[list[str], int]]) -> Sequences:
    """Of ``(main lines, links)``; long lines are blocks alone, short lines form blocks of BLOCK_WORDS words and more."""
    codes, sizes, lines, line_block, words, page = [], [], [], [], [], []
    for no, (text, links) in enumerate(pages):
        counts = [word_count(s) for s in text]
        density = link_density(links, sum(counts))
        full = True
        for s, n in zip(text, counts, strict=True):
            if full or n >= BLOCK_WORDS:
                words.append(0)
                page.append(no)
            words[-1] += n
            full = words[-1] >= BLOCK_WORDS
            own = classes.of(s)
            codes += own
            sizes.append(len(own))
            lines.append(line_class(s, n, density))
            line_block.append(len(words) - 1)
    return Sequences(*(np.array(x, np.int64) for x in (codes, sizes, lines, line_block, words, page)), len(pages))


@dataclass
class Part:
    """Some of the pages that are learned from, whether reviews call them written or filler, and what the fit holds them for."""

    seq: Sequences
    good: np.ndarray
    spam: np.ndarray
    fold: np.ndarray
    written: np.ndarray
    filler: np.ndarray
    #: Logarithm of the perplexity of each block.
    v: np.ndarray

    @property
    def has(self) -> np.ndarray:
        return np.bincount(self.seq.page, minlength=self.seq.pages) > 0


Step = Callable[[Part], Iterable[tuple[int, np.ndarray, np.ndarray]]]


class HeldPages:
    """Pages in one part in memory."""

    def __init__(self, part: Part):
        self.part = part

    def count(self, step: Step) -> dict[int, Counts]:
        """The sum of what the step counts in each part."""
        return added(step(self.part))

    def update(self, step: Callable[[Part], None]) -> None:
        """Let the step change what the parts hold their pages for."""
        step(self.part)


class Prose:
    """N-gram models of written text and the band of the perplexities that it shows."""

    def __init__(self, classes: Classes, counts: dict[int, Counts], tables: list[int]):
        """From the sum of the tables of gram_counts."""
        orders = [merged([counts[2 * ORDER * t + i] for t in tables if 2 * ORDER * t + i in counts]) for i in range(2 * ORDER)]
        self.classes = classes
        self.words, self.lines = Grams(classes.size, orders[:ORDER]), Grams(LINE_CLASSES, orders[ORDER:])
        self.low, self.high = 0.0, math.inf

    def costs(self, seq: Sequences) -> np.ndarray:
        """Total cost of each block."""
        n = len(seq.words)
        return np.bincount(seq.block, self.words.cost(seq.codes, seq.first), minlength=n) + np.bincount(seq.line_block, self.lines.cost(seq.lines, seq.line_first), minlength=n)

    def perplexity(self, seq: Sequences) -> np.ndarray:
        """Logarithm of the perplexity of each block."""
        return self.costs(seq) / np.maximum(np.bincount(seq.block, minlength=len(seq.words)), 1)

    def filler_shares(self, pages: list[tuple[list[str], int]]) -> np.ndarray:
        seq = sequences(self.classes, pages)
        v = self.perplexity(seq)
        return seq.filler_share((v > self.high) | (v < self.low))


def _best_cut(values: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the fewest good values above and bad values below it; the middle of the best range. Equal values stay together."""
    order = np.argsort(values, kind="stable")
    v, b = values[order], bad[order]
    wrong = np.concatenate([[0], np.cumsum(b)]) + np.concatenate([np.cumsum((~b)[::-1])[::-1], [0]])
    wrong[1:-1][v[1:] == v[:-1]] = len(v) + 1
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def gram_counts(classes: Classes, seq: Sequences, chosen: np.ndarray, table: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The n-grams of both sequences of the chosen pages, numbered for Prose."""
    own = seq.only(chosen)
    both = Grams.keys(classes.size, own.codes, own.first) + Grams.keys(LINE_CLASSES, own.lines, own.line_first)
    for i, keys in enumerate(both):
        yield 2 * ORDER * table + i, *np.unique(keys[keys >= 0], return_counts=True)


def _quantile(counts: Counts, q: float) -> float:
    """Of binned perplexities."""
    keys, n = counts
    return float(keys[np.searchsorted(np.cumsum(n), q * n.sum())] / BINS)


def fit_prose(pages: list[tuple[list[str], int]], labels: list[str | None]) -> Prose:
    """As fit_written, of pages in memory; ``labels`` are 'ok', 'spam' or None."""
    good = np.array([y == "ok" for y in labels], bool)
    spam = np.array([y == "spam" for y in labels], bool)
    known = [p for (p, _), y in zip(pages, labels, strict=True) if y != "spam" and p]
    classes = Classes(Counter(w for p in known for w in words_of(p)), len(known))
    seq = sequences(classes, pages)
    none = np.zeros(len(pages), bool)
    return fit_written(classes, HeldPages(Part(seq, good, spam, np.arange(len(pages)) % FOLDS, none, none, np.zeros(len(seq.words)))))


def fit_written(classes: Classes, pages: "HeldPages | StoredPages") -> Prose:
    """Models from the written pages' main lines, and the band that agrees best with the labels of all pages.

    Pages without a review, and reviews that contradict the text, are decided by how much better a model of filler
    explains a page than a model of written text, each fitted to other folds, over ROUNDS rounds, the first one on
    reviewed pages alone; the cut is where the reviews part best. Without a review of either kind nothing is filler.
    Every page takes part in every count; parts of the pages are counted apart and summed.
    """
    folds, n_written, n_filler, n_unseen = range(FOLDS), 2 * FOLDS * 2 * ORDER, 2 * FOLDS * 2 * ORDER + 1, 2 * FOLDS * 2 * ORDER + 2

    def tally(p: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for table, m in ((n_written, p.written), (n_filler, p.filler), (n_unseen, p.written & ~p.good)):
            yield table, np.zeros(1, np.int64), np.array([m.sum()])
        for kind, m in enumerate((p.written, p.filler)):
            for k in folds:
                yield from gram_counts(classes, p.seq, m & (p.fold == k), kind * FOLDS + k)

    def size(table: int) -> int:
        return int(counts[table][1].sum()) if table in counts else 0

    def without(kind: int, k: int) -> Prose:
        return Prose(classes, counts, [kind * FOLDS + j for j in folds if j != k])

    def decide_by_review(p: Part) -> None:
        p.written, p.filler = p.good & p.has, p.spam & p.has

    def decide_by_no_spam(p: Part) -> None:
        p.written, p.filler = p.has & ~p.spam, p.has & p.spam

    pages.update(decide_by_review)
    counts = pages.count(tally)
    if not size(n_written) or not size(n_filler):
        return Prose(classes, pages.count(lambda p: gram_counts(classes, p.seq, ~p.spam & p.has, 0)), [0])
    for _ in range(ROUNDS):
        models = [(without(0, k), without(1, k)) for k in folds]

        def apart(p: Part, use: np.ndarray, models: list[tuple[Prose, Prose]] = models) -> np.ndarray:
            out = np.zeros(p.seq.pages)
            for k, (written, filler) in enumerate(models):
                own = p.seq.only(use & (p.fold == k))
                tokens = np.maximum(np.bincount(own.page[own.block], minlength=own.pages), 1)
                out += np.bincount(own.page, written.costs(own) - filler.costs(own), minlength=own.pages) / tokens
            return out

        def of_reviewed(p: Part, apart: Callable = apart) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            x = apart(p, p.has & (p.good | p.spam))
            for table, m in enumerate((p.good, p.spam)):
                yield table, x[p.has & m].view(np.int64), np.ones((p.has & m).sum(), np.int64)

        reviewed = pages.count(of_reviewed)
        good, spam = (np.repeat(reviewed[t][0].view(float), reviewed[t][1]) for t in (0, 1))
        cut = _best_cut(np.concatenate([good, spam]), np.repeat([False, True], [len(good), len(spam)]))
        clear = min(cut, float(np.quantile(good, CLEAR)))

        def decide(p: Part, apart: Callable = apart, cut: float = cut, clear: float = clear) -> None:
            x = apart(p, p.has)
            p.written, p.filler = p.has & ~p.spam & (x <= clear), p.has & ~p.good & (x > max(cut, 0))

        pages.update(decide)
        counts = pages.count(tally)
        if not size(n_written) or not size(n_filler):
            pages.update(decide_by_no_spam)
            counts = pages.count(tally)
            break
    # written pages are judged by models of other pages, as all others will be
    models = [without(0, k) for k in folds]

    def judge(p: Part) -> None:
        p.v = np.zeros(len(p.seq.words))
        for k, m in enumerate(models):
            use = p.fold == k
            p.v[use[p.seq.page]] = m.perplexity(p.seq.only(use))

    pages.update(judge)

    def binned(p: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        bins = (p.v * BINS).astype(np.int64)
        for table, m in enumerate((p.written[p.seq.page], np.ones(len(bins), bool))):
            yield table, *np.unique(bins[m], return_counts=True)

    bins = pages.count(binned)
    of_written, of_all = bins[0], bins[1]
    lows = [(0.0, 0.0), *((x, _quantile(of_written, x)) for x in (0.001, 0.01))]
    highs = np.linspace(_quantile(of_written, 0.5), (of_all[0][-1] + 1) / BINS, HIGHS)

    def mistakes(p: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        found = [p.seq.filler_share((p.v > high) | (p.v < low)) > 0.5 for _, low in lows for high in highs]
        at = np.arange(len(found))
        yield 0, at, np.array([(p.filler & ~x).sum() + (p.written & p.good & x).sum() for x in found])
        yield 1, at, np.array([(p.written & ~p.good & x).sum() for x in found])

    wrong = pages.count(mistakes)
    # a part FREE of the pages without a review may be filler that no review is like
    errors = wrong[0][1] + np.maximum(0, wrong[1][1] - FREE * size(n_unseen))
    best = [(-float(errors[i * HIGHS + j]), -down, float(high), low) for i, (down, low) in enumerate(lows) for j, high in enumerate(highs)]
    top = max(b[:2] for b in best)
    same = [b for b in best if b[:2] == top]
    low, high = same[0][3], min((same[0][2] + same[-1][2]) / 2, same[0][2] + MARGIN)

    def kept(p: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return gram_counts(classes, p.seq, p.written & (p.good | (p.seq.filler_share((p.v > high) | (p.v < low)) <= 0.5)), 0)

    prose = Prose(classes, pages.count(kept), [0])
    prose.low, prose.high = low, high
    return prose


#: Columns of stored pages that are numbers one after the other, and their types.
_PACKED = {"codes": "<u2", "sizes": "<u4", "lines": "<u1", "line_block": "<u4", "words": "<u4", "v": "<f8"}
_STORED = "page_id string, label string, fold int, written boolean, filler boolean, " + ", ".join(f"{c} binary" for c in _PACKED)


def _split(values: np.ndarray, owner: np.ndarray, pages: int, kind: str) -> list[bytes]:
    """The values of each page as bytes; ``owner`` is sorted."""
    ends = np.searchsorted(owner, np.arange(pages), "right")
    whole = values.astype(kind)
    return [whole[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends, strict=True)]


def _packed(rows: pd.DataFrame, p: Part) -> pd.DataFrame:
    """``rows(page_id, label, fold)`` with their part."""
    q, n = p.seq, p.seq.pages
    of_line = q.page[q.line_block]
    within = q.line_block - (np.cumsum(np.bincount(q.page, minlength=n)) - np.bincount(q.page, minlength=n))[of_line]
    own = {"codes": (q.codes, q.page[q.block]), "sizes": (q.sizes, of_line), "lines": (q.lines, of_line), "line_block": (within, of_line), "words": (q.words, q.page), "v": (p.v, q.page)}
    first = {"page_id": rows["page_id"].to_numpy(), "label": rows["label"].to_numpy(), "fold": rows["fold"].to_numpy(), "written": p.written, "filler": p.filler}
    return pd.DataFrame(first | {c: _split(*x, n, _PACKED[c]) for c, x in own.items()})


def _unpacked(rows: pd.DataFrame) -> Part:
    own = {c: np.frombuffer(b"".join(rows[c]), kind) for c, kind in _PACKED.items()}
    length = lambda c: np.array([len(x) // np.dtype(_PACKED[c]).itemsize for x in rows[c]], np.int64)
    blocks, lines = length("words"), length("lines")
    line_block = own["line_block"].astype(np.int64) + np.repeat(np.cumsum(blocks) - blocks, lines)
    seq = Sequences(*(own[c].astype(np.int64) for c in ("codes", "sizes", "lines")), line_block, own["words"].astype(np.int64), np.repeat(np.arange(len(rows)), blocks), len(rows))
    flags = [(rows["label"] == y).to_numpy(bool) for y in ("ok", "spam")]
    return Part(seq, *flags, rows["fold"].to_numpy(), rows["written"].to_numpy(bool), rows["filler"].to_numpy(bool), own["v"].copy())


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """Each batch cut into runs of pages of about PIECE tokens."""
    for b in batches:
        piece = np.cumsum(b["codes"].map(len).to_numpy() // 2) // PIECE
        yield [x for _, x in b.groupby(piece)]


class StoredPages:
    """Pages whose sequences are written; a part is a piece of a batch of a task."""

    def __init__(self, rows: DataFrame):
        self.spark, self.path = rows.sparkSession, None
        self._write(rows)

    def _write(self, rows: DataFrame) -> None:
        old, self.path = self.path, f"{shared_folder(self.spark)}/sequences-{uuid.uuid4().hex}"
        rows.write.parquet(self.path)
        self.rows = self.spark.read.schema(_STORED).parquet(self.path)
        if old:
            remove_path(self.spark, old)

    def count(self, step: Step) -> dict[int, Counts]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pieces in _pieces(batches):
                for t, (keys, n) in added(x for piece in pieces for x in step(_unpacked(piece))).items():
                    yield pd.DataFrame({"t": np.full(len(keys), t, np.int32), "k": keys, "n": n})

        got = self.rows.mapInPandas(run, "t int, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n")).toArrow()
        t, k, n = (got[c].to_numpy() for c in ("t", "k", "n"))
        return added((int(x), k[t == x], n[t == x]) for x in np.unique(t))

    def update(self, step: Callable[[Part], None]) -> None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pieces in _pieces(batches):
                for piece in pieces:
                    part = _unpacked(piece)
                    step(part)
                    yield _packed(piece, part)

        self._write(self.rows.mapInPandas(run, _STORED))

    def remove(self) -> None:
        remove_path(self.spark, self.path)


def fit_stored(texts: DataFrame) -> Prose:
    """fit_written on all ``page_id, label, content, links, furniture``, row by row."""
    def main(b: pd.DataFrame) -> list[tuple[list[str], int]]:
        return [(main_lines(c, f), n) for c, f, n in zip(b["content"], b["furniture"], b["links"], strict=True)]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [t for t, _ in main(b[b["label"] != "spam"]) if t]
            # no token is empty: the empty one counts the pages
            df = Counter(w for t in known for w in words_of(t))
            df[""] = len(known)
            yield pd.DataFrame({"word": list(df.keys()), "n": list(df.values())})

    df = texts.mapInPandas(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
    n = next((r["n"] for r in df.where("word = ''").collect()), 0)
    classes = Classes({r["word"]: r["n"] for r in df.where((F.col("word") != "") & (F.col("n") >= least_pages(n))).collect()}, n)
    df.unpersist()

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                some = b.iloc[k : k + 500]
                seq = sequences(classes, main(some))
                none = np.zeros(len(some), bool)
                yield _packed(some, Part(seq, none, none, none, none, none, np.zeros(len(seq.words))))

    fold = F.pmod(F.xxhash64("page_id"), F.lit(FOLDS)).cast("int").alias("fold")
    pages = StoredPages(texts.select("page_id", "label", "content", "links", "furniture", fold).mapInPandas(coded, _STORED))
    prose = fit_written(classes, pages)
    pages.remove()
    return prose


def prepared(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``page_id, site, title, content, links, recurring``: rows with content; how many links they have, and for each line whether it recurs on its site.

    ``found`` is frequent_line_ids, written already. It is broadcast after a check of its size; beyond, the pages of
    sites with many are spread over several tasks each.
    """
    site = site_of(page_key(pages["url"]))
    web = F.filter(pages["links"], lambda x: x.rlike("^(?i)https?://"))
    rows = pages.where(pages["content"].isNotNull()).select(
        F.lower(F.trim(pages["page_id"])).alias("page_id"), site.alias("site"), F.xxhash64(site).alias("site_id"), "title", "content", F.greatest(F.size(web), F.lit(0)).alias("links")
    )
    hit = lambda x: F.coalesce((x != "") & F.array_contains("found", F.xxhash64(F.col("site"), x)), F.lit(False))
    flags = F.transform(F.transform(F.split("content", "\n"), line_form), hit)
    joined = sized_join(rows, found, "site_id", F.xxhash64("content"), F.size("found") * 8, how="left")
    return joined.select("page_id", "site", "title", "content", "links", flags.alias("recurring"))


def title_openings(pages: DataFrame) -> set[str]:
    """How titles begin: first words and second-and-third words of at least OPENING_SHARE of all titles, and of three; so few that the driver can have them."""
    t = F.trim(F.regexp_replace("title", "[ \\t\\r\\u00a0]+", " "))
    bare = F.regexp_replace(t, r"^(?:[*•»›\-–—·]|[0-9]{1,2}[.)])\s+", "")
    words = F.transform(F.slice(F.split(F.lower(bare), " "), 1, 3), lambda x: F.when(x.rlike("^[0-9]+$"), "0").otherwise(x))
    starts = pages.where(F.trim("title") != "").select(words.alias("w"))
    second = F.when(F.size("w") > 2, F.concat(F.lit("+"), F.array_join(F.slice("w", 2, 2), " ")))
    counts = starts.select(F.explode(F.array(F.col("w")[0], second)).alias("opening")).where("opening <> '0'").groupBy("opening").agg(F.count("*").alias("n"))
    enough = starts.agg(F.greatest(F.lit(3.0), F.count("*") * OPENING_SHARE).alias("least"))
    return {r["opening"] for r in counts.crossJoin(F.broadcast(enough)).where("n >= least").select("opening").collect()}


def _mask(line: Column) -> Column:
    """As mainbody.mask."""
    s = F.concat(F.lower(F.substring(line, 1, 1)), F.expr("substring(line, 2)"))
    s = F.regexp_replace(s, r"(?U)\S+@\S+|https?://\S+", "@")
    s = F.regexp_replace(s, r"(?U)\b[^\W\d_a-zß-ÿ]\w*(?: [^\W\d_a-zß-ÿ]\w*)*", "X")
    return F.regexp_replace(s, r"(?U)\d+", "0")


def recurring_forms(rows: DataFrame) -> set[str]:
    """The masked forms of lines that recur on at least LEAST_SITES sites each; so few that the driver can have them."""
    both = F.arrays_zip(F.split("content", "\n").alias("line"), F.col("recurring").alias("recurs"))
    lines = rows.select("site", F.explode(F.filter(both, lambda x: x["recurs"])).alias("x")).select("site", F.trim(F.regexp_replace("x.line", "[ \\t\\r\\u00a0]+", " ")).alias("line"))
    forms = lines.distinct().select("site", _mask(F.col("line")).alias("form")).where("trim(both ' X.|' from form) <> ''")
    return {r["form"] for r in forms.groupBy("form").agg(F.count_distinct("site").alias("n")).where(f"n >= {LEAST_SITES}").collect()}


def review_labels(labels: DataFrame) -> DataFrame:
    """``page_id, label`` of the pages whose reviewers agree by majority."""
    votes = labels.where(F.col("label").isin("spam", "ok")).groupBy(F.lower(F.trim("page_id")).alias("page_id")).agg(
        F.sum((F.col("label") == "spam").cast("int")).alias("spam"), F.count("*").alias("votes")
    )
    return votes.where("page_id is not null and spam * 2 <> votes").select("page_id", F.when(F.col("spam") * 2 > F.col("votes"), "spam").otherwise("ok").alias("label"))


def fit_classifier(rows: DataFrame, openings: set[str]) -> Classifier:
    """The line classifier, from every line of ``label, site, title, content, recurring`` that has a weak label.

    Equal lessons are counted; shards of about SHARD_LINES lines are learned from side by side, each by a hash of the
    lesson, and a feature's weight is the mean of the shards' by how much it occurs in each. Repeated lines of a site
    weigh less, see REPEAT_SHARE; none is left out.
    """
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast((recurring_forms(rows), openings))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, openings = known.value
        lessons = mainbody.Lessons(forms)
        for b in batches:
            n = Counter()
            for content, title, recurring, label in zip(b["content"], b["title"], b["recurring"], b["label"], strict=True):
                n.update(lessons.of(Page(content, title, recurring, openings), label == "spam"))
            for some in itertools.batched(n.items(), 50_000):
                lines = [int.from_bytes(blake2b(k[0].encode(errors="replace"), digest_size=8).digest(), "little", signed=True) for k, _ in some]
                yield pd.DataFrame({"line": lines, "recurs": [k[1] for k, _ in some], "main": [k[2] for k, _ in some], "features": [k[3] for k, _ in some], "n": [c for _, c in some]})

    path = f"{shared_folder(spark)}/lessons-{uuid.uuid4().hex}"
    given = rows.select("label", "title", "content", "recurring").mapInPandas(learn, "line long, recurs boolean, main boolean, features binary, n long")
    given.groupBy("line", "recurs", "main", "features").agg(F.sum("n").alias("n")).write.parquet(path)
    lessons = spark.read.parquet(path)
    most = max(float(mainbody.REPEATS), mainbody.REPEAT_SHARE * rows.count())
    # each on more than a part REPEAT_SHARE of the pages: few
    often = lessons.where("recurs").groupBy("line").agg(F.sum("n").alias("of_line")).where(F.col("of_line") > most)
    weighed = lessons.join(F.broadcast(often.withColumn("recurs", F.lit(True))), ["line", "recurs"], "left").withColumn("weight", F.col("n") * F.coalesce(F.lit(most) / F.col("of_line"), F.lit(1.0)))
    shards = max(1, -(-int(weighed.agg(F.sum(F.ceil("weight"))).first()[0] or 0) // SHARD_LINES))

    def fit(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["line", "features", "main", "recurs"])
        w, occurs = mainbody.train(list(some["features"]), some["main"].to_numpy(), some["weight"].to_numpy())
        at = np.flatnonzero(occurs)
        return pd.DataFrame({"feature": at, "w": w[at] * occurs[at], "n": occurs[at]})

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)")).cast("double")
    fitted = weighed.withColumn("shard", F.pmod(F.xxhash64("line", "features", "main"), F.lit(shards))).groupBy("shard").applyInPandas(fit, "feature long, w double, n double")
    weights = np.zeros(1 << mainbody.BITS)
    for r in fitted.groupBy("feature").agg((exact("w") / exact("n")).alias("w")).collect():
        weights[r["feature"]] = r["w"]
    remove_path(spark, path)
    return Classifier(weights)


def main_lines(content: str, furniture: Iterable[int]) -> list[str]:
    """The non-blank lines but those of the given numbers."""
    other = set(furniture)
    return [s for i, raw in enumerate(content.split("\n")) if i + 1 not in other and (s := mainbody.tidy(raw))]


def separated(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, mark, page_id, label, content, links, furniture`` of the rows with content; written.

    ``row`` is unique; rows of a page with equal ``mark`` are repeated.
    """
    spark = pages.sparkSession
    marked = prepared(pages, frequent_line_ids(pages)).withColumn("mark", F.xxhash64("site", "content", "title", "links", "recurring"))
    reviewed = sized_join(marked, review_labels(labels), "page_id", F.col("mark"), F.length("page_id") + 8, how="left")
    whole, parted = (f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("prepared", "separated"))
    reviewed.withColumn("row", F.monotonically_increasing_id()).write.parquet(whole)
    rows = spark.read.parquet(whole)
    openings = title_openings(pages)
    model = spark.sparkContext.broadcast((openings, fit_classifier(without_repeated(rows), openings)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        openings, classifier = model.value
        for b in batches:
            furniture = []
            for content, title, recurring in zip(b["content"], b["title"], b["recurring"], strict=True):
                p = Page(content, title, recurring, openings)
                furniture.append([n for n, k in zip(p.numbers, mainbody.label_lines(p, classifier), strict=True) if k != MAIN])
            yield b[["row", "mark", "page_id", "label", "content", "links"]].assign(furniture=furniture)

    schema = "row long, mark long, page_id string, label string, content string, links int, furniture array<long>"
    rows.select("row", "mark", "page_id", "label", "content", "links", "title", "recurring").mapInPandas(run, schema).write.parquet(parted)
    remove_path(spark, whole)
    return spark.read.parquet(parted)


def without_repeated(rows: DataFrame) -> DataFrame:
    """Separated rows, each once."""
    first = rows.groupBy("page_id", "mark").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    more = rows.select("page_id", "mark", "row").join(first, (rows["mark"] == first["mark"]) & rows["page_id"].eqNullSafe(first["page_id"]) & (rows["row"] > first["first"]), "left_semi")
    return rows.join(more.select("row"), "row", "left_anti")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, content, filler, furniture``: share of filler words and the numbers of the non-blank lines that aren't main text.

    One row per row with content. Whole contents are read. Null and blank contents have no lines; null titles and urls
    that name no page only take evidence away; repeated rows stay; an empty table gives no rows; without reviews no
    page is filler; further columns are not read.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "title", "content", "links") if "links" in pages.columns else pages.select("page_id", "url", "title", "content", F.array().cast("array<string>").alias("links"))
    rows = separated(pages, labels)
    model = spark.sparkContext.broadcast(fit_stored(without_repeated(rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prose = model.value
        for b in batches:
            main = [(main_lines(c, f), n) for c, f, n in zip(b["content"], b["furniture"], b["links"], strict=True)]
            share = np.concatenate([np.zeros(0), *(prose.filler_shares(main[k : k + 500]) for k in range(0, len(main), 500))])
            yield pd.DataFrame({"page_id": b["page_id"], "content": b["content"], "filler": share, "furniture": b["furniture"]})

    return rows.select("page_id", "content", "links", "furniture").mapInPandas(run, "page_id string, content string, filler double, furniture array<long>")


def main_text(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, main``: each row's content without its furniture lines; blank lines between main lines stay."""
    lines = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains("furniture", (i + 1).cast("long")))
    return labelled_pages(pages, labels).select("page_id", F.array_join(lines, "\n").alias("main"))


def stuffed_pages(labelled: DataFrame) -> DataFrame:
    """``page_id`` of the cases, distinct."""
    return labelled.where("filler > 0.5").select("page_id").distinct()


def furniture_lines(labelled: DataFrame) -> DataFrame:
    """``page_id, line_no``: lines that aren't main text, in pages that aren't filler; distinct."""
    per_page = labelled.withColumn("worst", F.max("filler").over(Window.partitionBy("page_id")))
    return per_page.where("worst <= 0.5").select("page_id", F.explode("furniture").alias("line_no")).distinct()
