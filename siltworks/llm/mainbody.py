"""Separates what an author wrote on a page from the page's furniture, line by line, by minimum cuts.

A logistic classifier prices each line as main text or furniture; adjacent lines, lines two apart and a list's heading
with its entries are tied by smoothness edges. A minimum cut of that graph labels the page. The classifier is trained
on the lines of all pages by weak supervision: lines that recur across their site, anything above the title and
lists of other pages under such lines are furniture; the title, sentences and what stands between sentences are main.
"""

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np

BITS = 16
#: The occurrences of one and the same recurring line weigh as much as this part of the pages together at most, and as much as REPEATS lines at least.
REPEAT_SHARE, REPEATS = 0.008, 40
ADJACENT, NEAR = 0.55, 0.2
#: Edge between a list's heading and an entry of a short list, and the number of entries at which it has halved.
LISTED, HALF = 1.6, 8
MAIN, FURNITURE = 1, 0
#: Entries of a memo of features or lines; a full memo starts anew.
MEMO = 400_000
#: Longer lines hardly recur and are not kept in the memo of lines.
REMEMBERED = 120

_BLANKS = re.compile("[ \t\r\u00a0]+")
_WORD = re.compile(r"[^\W\d_]+|\d+|[|·>»/#@:©?!.,]")
_BULLET = re.compile(r"^(?:[*•»›\-–—·]|\d{1,2}[.)])\s+")
_DIGITS = re.compile(r"\d+")
_NUMBER = re.compile("^[0-9]+$")
_DATE_END = re.compile(r"\s*\(\d{4}-\d\d-\d\d\)$")
_STOP_END = re.compile(r"[.!?…][\"”»'’)]*$")
_LABELLED = re.compile(r"^[^\W\d_]+(?: [^\W\d_]+)?\s?: (.+)$")
_SENTENCE_BREAK = re.compile(r"[.!?][\"”»'’)]*\s+\S")


def tidy(line: str) -> str:
    return _BLANKS.sub(" ", line).strip()


def opening(s: str) -> tuple[str, str]:
    """First word, and second and third word, of a headline, with numbers as 0."""
    w = ["0" if _NUMBER.match(x) else x for x in _BULLET.sub("", s).lower().split(" ")[:3]]
    return w[0], " ".join(w[1:3])


def looks_like_title(s: str, openings: set[str]) -> bool:
    """A short line that begins and ends as headlines do, with or without a list mark and a date."""
    t = _DATE_END.sub("", _BULLET.sub("", s))
    n = t.count(" ") + 1
    if not (3 <= n <= 18 and not _STOP_END.search(t) and (t[:1].isupper() or t[:1].isdigit()) and "|" not in t and t[-1:] != ":"):
        return False
    first, second = opening(t)
    return first in openings or f"+{second}" in openings


def looks_like_prose(s: str) -> bool:
    return not any(c in s for c in "|©@") and bool(_STOP_END.search(s)) and s.count(" ") >= 6


def is_tag_line(s: str) -> bool:
    """A label, a colon and a list of short entries."""
    m = _LABELLED.match(s)
    if not m or _STOP_END.search(s):
        return False
    entries = re.split(r"[,|·;/]", m.group(1))
    return len(entries) >= 3 and len(m.group(1).split()) <= 2.5 * len(entries)


class Page:
    """The non-blank lines of a page with the context that features and edges need."""

    def __init__(self, content: str, title: str | None, recurring: list[bool] | None, openings: set[str]):
        self.numbers, self.lines, self.recurs = [], [], []
        for i, raw in enumerate(content.split("\n")):
            s = tidy(raw)
            if s:
                self.numbers.append(i + 1)
                self.lines.append(s)
                self.recurs.append(bool(recurring[i]) if recurring is not None and i < len(recurring) else False)
        self.titles = [looks_like_title(s, openings) for s in self.lines]
        self.prose = [looks_like_prose(s) and not r for s, r in zip(self.lines, self.recurs, strict=True)]
        self.title_at = self._find_title(tidy(title or ""))
        self.last_prose = max((i for i, p in enumerate(self.prose) if p), default=-1)
        self.kinds = ["recurs" if r else "prose" if p else "title" if t else "other" for r, p, t in zip(self.recurs, self.prose, self.titles, strict=True)]
        self._find_runs()

    def _find_title(self, title: str) -> int:
        t = title.lower()
        fits = [i for i, s in enumerate(self.lines) if t and (s.lower() == t or t.startswith(s.lower() + " - "))]
        return fits[0] if fits else -1

    def _find_runs(self) -> None:
        """``runs[i]``: first and last line of the unbroken run of title-shaped lines around line i, else i twice.

        ``shares[i]`` is the run's part of all words of the page but those of recurring lines and of what stands above the title.
        """
        n = len(self.lines)
        words = [0 if r or i < self.title_at else s.count(" ") + 1 for i, (s, r) in enumerate(zip(self.lines, self.recurs, strict=True))]
        total = max(sum(words), 1)
        self.runs, self.shares = [(i, i) for i in range(n)], [0.0] * n
        listed = [t and not r and i != self.title_at for i, (t, r) in enumerate(zip(self.titles, self.recurs, strict=True))]
        a = 0
        while a < n:
            if not listed[a]:
                a += 1
                continue
            b = a
            while b + 1 < n and listed[b + 1]:
                b += 1
            self.runs[a : b + 1] = [(a, b)] * (b - a + 1)
            self.shares[a : b + 1] = [sum(words[a : b + 1]) / total] * (b - a + 1)
            a = b + 1

    def kind(self, i: int) -> str:
        return self.kinds[i] if 0 <= i < len(self.kinds) else "edge"

    def setting(self, i: int) -> tuple:
        """What surrounds line i, as far as features use it."""
        place = "own" if i == self.title_at else "above" if i < self.title_at else "inside" if i < self.last_prose else "below"
        a, b = self.runs[i]
        around = (self.kind(a - 1), self.kind(b + 1)) if self.titles[i] else ("", "")
        return place, self.titles[i], self.recurs[i], self.prose[i], self.kind(i - 1), self.kind(i + 1), int(math.log2(b - a + 1)), int(4 * self.shares[i]), *around

    def weak_labels(self, forms: set[str], spam: bool = False) -> list[int]:
        """1 main, 0 furniture, -1 unknown; ``forms`` are masked lines that recur on several sites.

        ``spam`` pages have reviews as such: what stands under their title is filler, which is no furniture either. A
        list of most of a page's words is furniture on no page that is only text, and stays unknown without a review.
        """
        out = []
        for i, s in enumerate(self.lines):
            y = -1
            if i == self.title_at or self.prose[i]:
                y = MAIN
            if is_tag_line(s) and not spam and i > self.last_prose:
                y = FURNITURE
            if i < self.title_at or i != self.title_at and (self.recurs[i] or mask(s) in forms):
                y = FURNITURE
            elif spam and y < 0 and (not self.titles[i] or self.shares[i] > 0.5):
                y = MAIN
            elif y < 0 and self.titles[i]:
                a, b = self.runs[i]
                before = self.recurs[a - 1] if a > 0 and a - 1 != self.title_at else False
                after = b + 1 >= len(self.lines) or self.recurs[b + 1]
                if before and (b > a or after) and self.shares[i] <= 0.5:
                    y = FURNITURE
                elif a == b and 0 < a and self.prose[a - 1] and b + 1 < len(self.lines) and self.prose[b + 1]:
                    y = MAIN
            elif y < 0 and self.title_at < i < self.last_prose and not any(c in s for c in "|©@·»>"):
                y = MAIN
            out.append(y)
        return out


def words_and_shape(s: str) -> tuple[list[str], list[str]]:
    """The words of a line, numbers as 0, and the features of the line by itself that are no single words or pairs."""
    body = _BULLET.sub("", s)
    words = _WORD.findall(_DIGITS.sub("0", body.lower()))
    n = len(words)
    mark = s[: len(s) - len(body)].strip()[:1]
    shape = [
        f"n{min(n, 12) if n < 12 else 12 + n // 12}",
        f"m{'0' if mark.isdigit() else mark}{body[:1].isupper()}{body[:1].islower()}",
        f"e{s[-1:] if not s[-1:].isalnum() else 'a'}",
        f"u{s.isupper()}",
        f"k{is_tag_line(s)}",
        f"s{bool(_SENTENCE_BREAK.search(s))}",
        f"f{' '.join(words[:2])}",
        f"z{' '.join(words[-2:])}",
    ]
    if n <= 8:
        shape.append(f"x{' '.join(words)}")
    return words, shape


def wording(s: str) -> list[str]:
    """Features of a line by itself, from the whole line."""
    words, shape = words_and_shape(s)
    return shape + ["w" + w for w in dict.fromkeys(words)] + [f"g{v} {w}" for v, w in dict.fromkeys(zip(words, words[1:], strict=False))]


def surroundings(setting: tuple, marked: bool) -> list[str]:
    """Features of a line's place on its page."""
    place, titled, recurs, prose, above, below, size, share, before, after = setting
    return [
        f"p{place}",
        f"p{place}t{titled}",
        f"r{recurs}",
        f"q{prose}",
        f"b{above}t{titled}",
        f"a{below}t{titled}",
        f"l{size}{before}{after}{marked}",
        f"l{size}{place}{marked}",
        f"h{share}{before}",
        f"h{share}{place}{marked}",
    ]


def bucket(feature: str) -> int:
    return crc32(feature.encode()) & ((1 << BITS) - 1)


class Memo(dict):
    """Values of a function of one argument; starts anew when full."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, k):
        if len(self) >= MEMO:
            self.clear()
        v = self[k] = self.of(k)
        return v


class Classifier:
    """Log odds of main text from the weights of hashed features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._reset()

    def _reset(self) -> None:
        weight = lambda f: float(self.weights[bucket(f)])
        self.feature = Memo(weight)
        self.word = Memo(lambda w: weight("w" + w))
        self.pair = Memo(lambda p: weight(f"g{p[0]} {p[1]}"))
        self.line = Memo(self._line)
        self.place = Memo(lambda k: sum([self.feature[f] for f in surroundings(*k)]))

    def _line(self, s: str) -> float:
        words, shape = words_and_shape(s)
        pairs = dict.fromkeys(zip(words, words[1:], strict=False))
        return sum(map(self.feature.__getitem__, shape)) + sum(map(self.word.__getitem__, dict.fromkeys(words))) + sum(map(self.pair.__getitem__, pairs))

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.weights = weights
        self._reset()

    def odds(self, page: Page) -> np.ndarray:
        line = lambda s: self.line[s] if len(s) < REMEMBERED else self._line(s)
        out = [line(s) + self.place[page.setting(i), bool(_BULLET.match(s))] for i, s in enumerate(page.lines)]
        return np.clip(np.array(out, float), -8, 8)


def mask(s: str) -> str:
    """A line with numbers, addresses and capitalised words blanked out."""
    s = re.sub(r"\S+@\S+|https?://\S+", "@", s)
    return re.sub(r"\d+", "0", re.sub(r"\b[^\W\d_a-zß-ÿ]\w*(?: [^\W\d_a-zß-ÿ]\w*)*", "X", s[:1].lower() + s[1:]))


class Lessons:
    """What the lines of pages teach: ``line, recurs, main, features`` of each line with a weak label."""

    def __init__(self, forms: set[str]):
        self.forms = forms
        code = Memo(bucket)
        self.line = Memo(lambda s: [code[f] for f in wording(s)])
        self.place = Memo(lambda k: [code[f] for f in surroundings(*k)])

    def of(self, page: Page, spam: bool) -> Iterator[tuple[str, bool, bool, bytes]]:
        for i, y in enumerate(page.weak_labels(self.forms, spam)):
            if y >= 0:
                s = page.lines[i]
                words = self.line[s] if len(s) < REMEMBERED else self.line.of(s)
                yield s, page.recurs[i], y == MAIN, np.array(words + self.place[page.setting(i), bool(_BULLET.match(s))], "<u2").tobytes()


def train(features: list[bytes], main: np.ndarray, weights: np.ndarray, epochs: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all features by adaptive gradient steps on lessons, and how much each feature occurs in them.

    A lesson of weight w is taken up ceil(w) times, each time with the same part of w.
    """
    w, scale = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    size = np.array([len(x) // 2 for x in features], np.int64)
    flat, starts = np.frombuffer(b"".join(features), "<u2"), np.cumsum(size) - size
    occurs = np.bincount(flat, np.repeat(weights, size), minlength=1 << BITS)
    times = np.ceil(weights).astype(np.int64)
    y, each = main.astype(float), weights / np.maximum(times, 1)
    taken = np.repeat(np.arange(len(features)), times)
    rng = np.random.default_rng(seed)
    # whether a line recurs is how it got its label: hidden half of the time, so that the words must do
    hide = bucket("rTrue")
    for _ in range(epochs):
        order = rng.permutation(taken)
        for k in range(0, len(order), 256):
            r = order[k : k + 256]
            who = np.repeat(np.arange(len(r)), size[r])
            f = flat[np.repeat(starts[r] - np.cumsum(size[r]) + size[r], size[r]) + np.arange(len(who))]
            x = np.where((f == hide) & (rng.random(len(f)) < 0.5), 0.0, 1.0)
            z = np.bincount(who, w[f] * x, minlength=len(r))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r]) * each[r])[who] * x + 1e-4 * w[f]
            at, back = np.unique(f, return_inverse=True)
            scale[at] += np.bincount(back, g * g)
            w[at] -= 0.25 * np.bincount(back, g) / np.sqrt(scale[at])
    return w, occurs


def minimum_cut(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels that minimise terminal costs and cut edges; odds > 0 is the price of not being main, < 0 of being it.

    Nodes whose terminal outweighs all their edges are settled first and passed on to their neighbours as terminal
    capacity; what remains goes through augmenting paths.
    """
    n = len(odds)
    t = odds.astype(float).copy()
    out = np.where(t > 0, MAIN, FURNITURE)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        links[a][b] = links[a].get(b, 0.0) + c
        links[b][a] = links[b].get(a, 0.0) + c
    todo, fixed = list(range(n)), [False] * n
    while todo:
        i = todo.pop()
        if fixed[i] or abs(t[i]) < sum(links[i].values()):
            continue
        fixed[i] = True
        out[i] = MAIN if t[i] > 0 else FURNITURE
        for j, c in links[i].items():
            t[j] += c if t[i] > 0 else -c
            del links[j][i]
            todo.append(j)
        links[i] = {}
    left = [i for i in range(n) if not fixed[i]]
    if not left:
        return out
    s, e = n, n + 1
    cap: dict[int, dict[int, float]] = {i: dict(links[i]) for i in left} | {s: {}, e: {}}
    for i in left:
        cap[i].setdefault(s, 0.0)
        cap[i][e] = max(-t[i], 0.0)
        cap[s][i] = max(t[i], 0.0)
        cap[e][i] = 0.0
    while True:
        came, queue = {s: s}, [s]
        for u in queue:
            for v, c in cap[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
            if e in came:
                break
        if e not in came:
            for i in left:
                out[i] = MAIN if i in came else FURNITURE
            return out
        path, v = [], e
        while v != s:
            path.append((came[v], v))
            v = came[v]
        flow = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= flow
            cap[b][a] = cap[b].get(a, 0.0) + flow


def label_lines(page: Page, classifier: Classifier) -> np.ndarray:
    """MAIN or FURNITURE for each non-blank line."""
    n = len(page.lines)
    if not n:
        return np.zeros(0, int)
    odds = classifier.odds(page)
    if page.title_at >= 0:
        odds[page.title_at] = 8
        odds[: page.title_at] = np.minimum(odds[: page.title_at], -3)
    edges = []
    for i in range(n - 1):
        gap = page.numbers[i + 1] - page.numbers[i]
        edges.append((i, i + 1, ADJACENT if gap == 1 else ADJACENT / 2))
        if i + 2 < n:
            edges.append((i, i + 2, NEAR))
        a, b = page.runs[i + 1]
        if page.titles[i + 1] and not page.recurs[i + 1] and a > 0 and a - 1 != page.title_at and (b > a or _BULLET.match(page.lines[i + 1])):
            edges.append((a - 1, i + 1, LISTED / (1 + ((b - a + 1) / HALF) ** 2)))
    return minimum_cut(odds, edges)
