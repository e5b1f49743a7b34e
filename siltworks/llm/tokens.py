"""Encoding of texts by a public byte-level BPE vocabulary, merged in padded numpy matrices.

A text is split into pieces by the vocabulary's public pattern. Pieces not seen before by the worker are encoded
together: bucketed by length into padded matrices of byte ids, where every row merges its leftmost pair of minimum
rank in each round; the ranks come from a hashed pair table, and rows that have no pair left are taken out.
"""

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The vocabulary's published splitting pattern (a fixed value), with White_Space spelled out for \s.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE_BYTES = 48_000_000
LONG = 1024
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairTable:
    """Pairs of ids to (rank, merged id), by open addressing in one numpy array of a power-of-two size."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        size = 1 << int(np.ceil(np.log2(len(pairs) * 4)))
        self.mask = np.uint64(size - 1)
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        todo, step = np.arange(len(pairs)), 0
        while len(todo):
            at = self._slot(pairs[todo], step)
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            w = todo[won]
            self.keys[at[won]], self.rank[at[won]], self.merged[at[won]] = pairs[w], ranks[w], merged[w]
            todo, step = todo[~won], step + 1
        self.probes = step

    def _slot(self, pairs: np.ndarray, step: int) -> np.ndarray:
        h = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (((h >> np.uint64(32)) + np.uint64(step)) & self.mask).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        out = np.full(pairs.shape, -1, np.int64)
        todo = np.arange(len(pairs))
        for step in range(self.probes):
            at = self._slot(pairs[todo], step)
            hit = self.keys[at] == pairs[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (self.keys[at] != -1)]
            if not len(todo):
                break
        return out


class Encoder:
    """Encodes texts without special tokens; their strings are ordinary text. Null and empty texts give no ids."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int32)
        ends = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        left, right, merged = (np.array(x, np.int64) for x in zip(*ends, strict=True))
        self.table = PairTable(left << 20 | right, np.arange(len(ends), dtype=np.int32), merged.astype(np.int32))
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def __getstate__(self) -> dict:
        return {"byte_ids": self.byte_ids, "table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def split(self, text: str) -> list[str]:
        if not hasattr(self, "pattern"):
            self.pattern = regex.compile(PATTERN)
        return self.pattern.findall(text)

    def _pair_slots(self, m: np.ndarray) -> np.ndarray:
        pairs = m[:, :-1].astype(np.int64) << 20 | m[:, 1:].astype(np.int64)
        pairs[(m[:, :-1] < 0) | (m[:, 1:] < 0)] = -2
        slots = np.full(pairs.size, -1, np.int64)
        real = np.flatnonzero(pairs.ravel() >= 0)
        slots[real] = self.table.find(pairs.ravel()[real])
        return slots.reshape(pairs.shape)

    def _merge_matrix(self, m: np.ndarray) -> list[np.ndarray]:
        """Final ids of each row of a matrix padded with -1."""
        done: list[np.ndarray | None] = [None] * len(m)
        rows = np.arange(len(m))
        ranks_of = np.append(self.table.rank, NONE)
        while True:
            if m.shape[1] < 2:
                live = np.zeros(len(m), bool)
            else:
                slots = self._pair_slots(m)
                ranks = ranks_of[slots]
                at = ranks.argmin(1)
                live = ranks[np.arange(len(m)), at] != NONE
            for i in np.flatnonzero(~live):
                done[rows[i]] = m[i][m[i] >= 0]
            if not live.any():
                return done
            m, rows, at, slots = m[live], rows[live], at[live], slots[live]
            r, c = np.arange(len(m)), np.arange(m.shape[1])[None, :]
            new = self.table.merged[slots[r, at]]
            shifted = np.concatenate([m[:, 1:], np.full((len(m), 1), -1, np.int32)], 1)
            m = np.where(c > at[:, None], shifted, m)
            m[r, at] = new
            width = int((m >= 0).sum(1).max())
            m = m[:, :width]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for one very long piece, by a heap over a linked list."""
        n = len(ids)
        nxt, prv, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        arr = np.array(ids, np.int64)
        heap = []

        def look(a: int, b: int) -> tuple[int, int] | None:
            s = self.table.find(np.array([a << 20 | b]))[0]
            return None if s < 0 else (int(self.table.rank[s]), int(self.table.merged[s]))

        first = self.table.find(arr[:-1] << 20 | arr[1:]) if n > 1 else []
        for i, s in enumerate(first):
            if s >= 0:
                heap.append((int(self.table.rank[s]), i, ids[i], ids[i + 1], int(self.table.merged[s])))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (got := look(ids[p], ids[q])):
                    heapq.heappush(heap, (got[0], p, ids[p], ids[q], got[1]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces and remember them."""
        new = [(p, p.encode("utf-8", "replace")) for p in pieces]
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for p, raw in new:
            if len(raw) > LONG:
                self._keep(p, self._merge_long(self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()))
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for bits, group in groups.items():
            step = max(1, 2_000_000 >> max(bits, 1))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                sizes = np.array([len(raw) for _, raw in part])
                m = np.full((len(part), sizes.max()), -1, np.int32)
                m[np.arange(m.shape[1])[None, :] < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                for (p, _), ids in zip(part, self._merge_matrix(m), strict=True):
                    self._keep(p, ids.tolist())

    def _keep(self, piece: str, ids: list[int]) -> None:
        self.cache[piece] = tuple(ids)
        self.held += 120 + len(piece) * 2 + 8 * len(ids)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        if self.held > CACHE_BYTES:
            self._reset()
        split = [self.split(t) if t else [] for t in texts]
        unseen = {p for s in split for p in s if p not in self.cache}
        if unseen:
            self.learn(unseen)
        cache = self.cache
        return [[i for p in s for i in cache[p]] for s in split]


def _chunks(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids``: one row per row of documents; null and empty texts give an empty list.

    Special tokens' strings are ordinary text; repeated rows stay; whole texts are encoded whatever their length; an
    empty table gives no rows; other columns are not read. The vocabulary (50,000 pairs, a fixed size) is broadcast.
    """
    encoder = documents.sparkSession.sparkContext.broadcast(Encoder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _chunks(b.column(1).to_pylist()):
                ids = encoder.value.encode_batch(part)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"]
                )
                at += len(part)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of each row of documents."""
    return encode_documents(documents, path).select("doc_id", F.size("ids").alias("n_tokens"))
