"""Scores documents for abusive, hateful and sexual content.

A sentence is a bag of words, word pairs and character n-grams of words, hashed to buckets. Bucket embeddings are
averaged into a linear softmax over the four labels; embeddings and softmax are trained jointly in numpy on a bounded
sample of reviewed documents. Reviews name a document, not the sentence, so training alternates between fitting the
model and choosing the sentences that explain a document's label. A document's score is its worst sentence's.
"""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("clean", "abusive", "hateful", "sexual")
#: Reviewed documents, drawn by the hash of their id, that the model is fitted on at most.
REVIEWED = 8000
BITS, DIM = 17, 24
#: Bounds of the fit on that sample: harmless sentences used in a round, drawn at random with a fixed seed, and gradient steps of a fit.
EASY, STEPS = 16000, 400
LEAST = (0.5, 0.6, 0.5, 0.35)
NGRAMS = (3, 4, 5)
#: Bound of embeddings and softmax weights, and eight times that of a step.
WIDEST = 4.0
THRESHOLD = 0.3
BASE = np.uint64(0x100000001B3 | 1)

#: Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = str.maketrans("аеорсухівкмнтѕјԁɡαεορτυνικ", "aeopcyxibkmhtsjdgaeoptuvik")
SIGNS = str.maketrans("0134579@$", "oieastgas")

_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»'’)]*\s+|[\r\n]+")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_MARKS = re.compile("[̀-ͯ]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_·*] ?){2,}[^\W\d_](?![^\W_])|(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_MIXED = re.compile(r"[^\W\d_]+[\d@$][\w@$]*|[\d@$]+[^\W\d_][\w@$]*")
_RUNS = re.compile(r"([^\W\d_])\1{2,}")
_OTHER = re.compile(r"[^\w*\n]+|_+")
_STARS = re.compile(r"\*+")
_DIGITS = re.compile(r"\d+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def canonical(lines: str) -> str:
    """Undo common disguises in newline-separated sentences; every line stays one line of words and single spaces."""
    s = unicodedata.normalize("NFKD", _HIDDEN.sub("", lines)).lower()
    s = _MARKS.sub("", s).translate(LOOKALIKES)
    s = _SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m.group()), s)
    s = _MIXED.sub(lambda m: m.group().translate(SIGNS), s)
    s = _RUNS.sub(r"\1", s)
    return _DIGITS.sub("0", _STARS.sub("*", _OTHER.sub(" ", s)))


def features(lines: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, line number) of every feature of canonical lines, by rolling hashes over all of them at once."""
    text = "".join(f" {s.strip()} \n" for s in lines)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(7)) * up)])
    newline, space = chars == 10, chars == 32
    line = np.concatenate([[0], np.cumsum(newline)[:-1]])
    breaks = np.concatenate([[0], np.cumsum(newline | space)])

    def bucket(start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * down[start]
        h = (h ^ (h >> np.uint64(29)) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    out, owner = [], []
    for k in NGRAMS:
        start = np.arange(max(n - k + 1, 0))
        inner = breaks[start + k - 1] - breaks[start + 1]
        ok = (inner == 0) & ~newline[start] & ~newline[start + k - 1] & (~space[start] | ~space[start + k - 1])
        start = start[ok]
        out.append(bucket(start, start + k, k))
        owner.append(line[start])
    gaps = np.flatnonzero(space)
    word = (line[gaps[:-1]] == line[gaps[1:]]) & (gaps[1:] - gaps[:-1] > 1)
    a, b = gaps[:-1][word], gaps[1:][word]
    out.append(bucket(a, b + 1, 1))
    owner.append(line[a])
    pair = line[a[:-1]] == line[a[1:]] if len(a) else np.zeros(0, bool)
    out.append(bucket(a[:-1][pair], b[1:][pair] + 1, 2))
    owner.append(line[a[:-1]][pair])
    return np.concatenate(out), np.concatenate(owner)


def probabilities(table: np.ndarray, bias: np.ndarray, lines: list[str]) -> np.ndarray:
    """Label probabilities of canonical lines; ``table`` holds each bucket's contribution to the four logits."""
    idx, owner = features(lines)
    count = np.maximum(np.bincount(owner, minlength=len(lines)), 1)
    logits = np.stack([np.bincount(owner, table[idx, c], minlength=len(lines)) / count + bias[c] for c in range(len(LABELS))], 1)
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    def __init__(self, seed: int = 7, bits: int = BITS, dim: int = DIM):
        self.rng = np.random.default_rng(seed)
        self.e = self.rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        self.w = self.rng.normal(0, 0.3, (dim, len(LABELS))).astype(np.float32)
        self.b = np.zeros(len(LABELS), np.float32)

    def fit(self, idx: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 4.0, batch: int = 128) -> None:
        """Joint gradient descent on embeddings and softmax over sentences in compressed rows."""
        starts = np.concatenate([[0], ends[:-1]])
        target = np.eye(len(LABELS), dtype=np.float32)[y]
        weight = np.minimum(weight / weight.mean(), 8).astype(np.float32)
        steps, done = epochs * -(-len(y) // batch), 0
        for _ in range(epochs):
            order = self.rng.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k : k + batch]
                size = ends[rows] - starts[rows]
                at = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                f, seg = idx[at], np.concatenate([[0], np.cumsum(size)[:-1]])
                h = np.add.reduceat(self.e[f], seg, axis=0) / size[:, None]
                z = h @ self.w + self.b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                g = (p - target[rows]) * weight[rows, None]
                lr = rate * (1 - done / steps) + 0.05
                dh = (g @ self.w.T) * lr
                self.w -= min(lr, 1.0) / len(rows) * (h.T @ g)
                np.clip(self.w, -WIDEST, WIDEST, out=self.w)
                self.b -= lr / len(rows) * g.sum(0)
                by = np.argsort(f, kind="stable")
                head = np.flatnonzero(np.diff(f[by], prepend=-1))
                step = np.repeat((dh / size[:, None]).astype(np.float32), size, axis=0)[by]
                moved = np.clip(np.add.reduceat(step, head, axis=0), -WIDEST / 8, WIDEST / 8)
                self.e[f[by][head]] = np.clip(self.e[f[by][head]] - moved, -WIDEST, WIDEST)
                done += 1

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.e @ self.w).astype(np.float64), self.b.astype(np.float64)


def train(texts: list[str], labels: list[str], rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """``(table, bias)`` fitted to reviewed texts; without a text of another label than clean nothing is ever found.

    In each round two halves of the documents are scored by models of the other half, so that no sentence explains a
    label by having been learned with it. A reviewed document whose worst sentence stays harmless counts as a wrong
    review and leaves; so do sentences of clean documents that the other half is sure about.
    """
    where, seen = [], {}
    for d, t in enumerate(texts):
        s = sentences(t)
        for c in canonical("\n".join(x.replace("\n", " ") for x in s)).split("\n") if s else []:
            if c.strip():
                where.append((d, seen.setdefault(" ".join(c.split()), len(seen))))
    y_doc = np.array([LABELS.index(x) for x in labels])
    if not where or not (y_doc > 0).any():
        return np.zeros((1 << BITS, len(LABELS))), np.array([9.0, 0, 0, 0])
    pairs = np.unique(np.array(where), axis=0)
    lines = list(seen)
    idx, ends = _compressed(lines)
    pairs = pairs[np.diff(ends, prepend=0)[pairs[:, 1]] > 0]
    doc, sent = pairs[:, 0], pairs[:, 1]
    positive = y_doc[doc] > 0
    rng = np.random.default_rng(11)
    half = rng.integers(0, 2, len(texts))[doc]
    label, weight = y_doc[doc].copy(), np.ones(len(doc))
    weight[positive] = 1 / np.sqrt(np.bincount(doc)[doc[positive]])
    hard = np.zeros(len(doc), bool)

    def fit(rows: np.ndarray, most: float = 12) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[weight[rows] > 0]
        easy = (label[rows] == 0) & ~hard[rows]
        keep = ~easy
        keep[rng.permutation(np.flatnonzero(easy))[:EASY]] = True
        rows = rows[keep]
        bad = label[rows] > 0
        up = np.clip(0.4 / 0.6 * weight[rows][~bad].sum() / max(weight[rows][bad].sum(), 1e-9), 1, most)
        model = Model()
        steps = int(np.clip(len(rows) // 25, STEPS // 4, STEPS))
        model.fit(*_rows(idx, ends, sent[rows]), label[rows], (weight[rows] * np.where(bad, up, 1)).astype(np.float32), epochs=-(-steps * 128 // len(rows)))
        return model.tables()

    for r in range(rounds):
        harm = np.zeros(len(doc))
        for k in (0, 1):
            other, own = np.flatnonzero(half != k), np.flatnonzero(half == k)
            if len(other) and len(own):
                table, bias = fit(other, 12 if r else 4)
                used, back = np.unique(sent[own], return_inverse=True)
                harm[own] = _harm(table, bias, idx, ends, used)[back]
        top = np.zeros(len(texts))
        np.maximum.at(top, doc, harm)
        explains = positive & (harm >= np.maximum(0.7 * top[doc], LEAST[min(r, len(LEAST) - 1)]))
        label, weight = np.where(explains, y_doc[doc], 0), np.ones(len(doc))
        weight[positive & ~explains] = np.where(harm[positive & ~explains] < 0.1, 0.5, 0)
        weight[~positive & (harm > 0.97)] = 0
        hard = ~positive & (harm > 0.03)
        if not explains.any():
            break
    return fit(np.arange(len(doc)))


def _compressed(lines: list[str], chunk: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all lines one after the other, and where each line's end; hashed in chunks to save memory."""
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(lines), chunk):
        some = lines[k : k + chunk]
        idx, owner = features(some)
        parts.append(idx[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(some)))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def _harm(table: np.ndarray, bias: np.ndarray, idx: np.ndarray, ends: np.ndarray, rows: np.ndarray, chunk: int = 4000) -> np.ndarray:
    """Probability of any label but clean of lines in compressed form."""
    out = np.zeros(len(rows))
    for k in range(0, len(rows), chunk):
        part, last = _rows(idx, ends, rows[k : k + chunk])
        first = np.concatenate([[0], last[:-1]])
        z = np.add.reduceat(table[part], first, axis=0) / (last - first)[:, None] + bias
        e = np.exp(z - z.max(1, keepdims=True))
        out[k : k + chunk] = 1 - e[:, 0] / e.sum(1)
    return out


def _rows(idx: np.ndarray, ends: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], ends[:-1]])
    size = ends[sent] - starts[sent]
    at = np.repeat(starts[sent] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return idx[at], np.cumsum(size)


def reviewed_sample(documents: DataFrame, labels: DataFrame, most: int = REVIEWED) -> tuple[list[str], list[str]]:
    """Texts and majority labels of at most ``most`` reviewed documents, chosen by the hash of their id.

    Null and unknown labels are no reviews; a document whose reviewers tie is left out, as are null texts.
    """
    votes = labels.where(F.col("label").isin(*LABELS)).groupBy("doc_id", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("votes"))
    ranked = votes.withColumn("second", F.lead("votes").over(w)).withColumn("nth", F.row_number().over(w))
    sure = ranked.where("nth = 1 and (second is null or second < votes)").select("doc_id", "label")
    picked = sure.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]


def score_documents(documents: DataFrame, labels: DataFrame, reviewed: int = REVIEWED) -> DataFrame:
    """``doc_id, source, score, label``: one row per row of documents, score in 0..1, label of the worst sentence.

    Whole texts are scored. Null, empty and blank texts score 0 as clean; repeated rows stay; an empty or useless
    table of labels makes every score small; an empty table of documents gives no rows; other columns are not read.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(*reviewed_sample(documents, labels, reviewed)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bias = model.value
        for b in batches:
            score, label = np.zeros(len(b)), np.zeros(len(b), int)
            todo: list[tuple[int, list[str]]] = []
            size = 0

            def flush() -> None:
                if not todo:
                    return
                flat = "\n".join(x.replace("\n", " ") for _, s in todo for x in s)
                doc = np.repeat([i for i, _ in todo], [len(s) for _, s in todo])
                p = probabilities(table, bias, canonical(flat).split("\n"))
                bad = 1 - p[:, 0]
                order = np.lexsort((bad, doc))
                last = order[np.append(np.flatnonzero(np.diff(doc[order])), len(doc) - 1)]
                higher = bad[last] > score[doc[last]]
                score[doc[last[higher]]] = bad[last[higher]]
                label[doc[last[higher]]] = p[last[higher]].argmax(1)

            for i, t in enumerate(b["text"]):
                if t and (s := sentences(t)):
                    for k in range(0, len(s), 2000):
                        todo.append((i, s[k : k + 2000]))
                        size += sum(map(len, s[k : k + 2000]))
                        if size > 300_000:
                            flush()
                            todo, size = [], 0
            flush()
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": score, "label": [LABELS[k] for k in label]})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double, label string")


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, found, rate``; a null source is a source of its own."""
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("score") >= threshold).cast("long")).alias("found"))
    return out.withColumn("rate", F.col("found") / F.col("documents"))
