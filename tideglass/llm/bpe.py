"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

The distinct pieces of a batch that are no single token and not known from earlier batches are
laid out as rows of padded id matrices, one matrix for each bucket of lengths.  In each round
every row merges its leftmost pair of least rank; ranks come from a hashed pair table, the row is
compacted by one column, and rows with no pair left leave the matrix.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, tidy

NONE = np.int32(2**31 - 1)
#: Pieces longer than this merge on a heap: the same merges in the same order, without quadratic work.
LONG = 1024
#: Cells of one matrix, characters of text in one step, and pieces remembered between steps.
CELLS, STEP_CHARS, REMEMBERED = 1 << 19, 1 << 20, 100_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder for a rank file; `pattern` splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.pieces = {i: t for t, i in ranks.items()}
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.width = np.uint64(max(ranks.values()) + 1)
        keys = np.array([a * int(self.width) + b for a, b in pairs], np.uint64)
        values = np.array(list(pairs.values()), np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # each round, one of the keys that want a free place gets it
            self.probes += 1
            free = self.values[at[left]] == NONE
            slots, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & self.mask
        self.known: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they do not merge; an id of -1 is padding."""
        keys = left.astype(np.uint64) * self.width + right.astype(np.uint64)
        keys[(left < 0) | (right < 0)] = np.uint64(2**64 - 2)
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        out = np.where(found == keys, out, NONE)
        open_ = np.flatnonzero((found != keys) & (self.values[at] != NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found, held = self.keys[at[open_]], self.values[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = held[hit]
            open_ = open_[~hit & (held != NONE)]
        return out

    def _matrix(self, rows: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of rows of similar length."""
        width = max(map(len, rows))
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        lengths = np.array([len(r) for r in rows])
        ids = np.where(np.arange(width) < lengths[:, None], self.singles[flat], np.int32(-1))
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        at, out = np.arange(len(rows)), [b""] * len(rows)
        while True:
            place = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(at), np.int64)
            best = ranks[np.arange(len(at)), place] if ranks.shape[1] else np.full(len(at), NONE)
            done = best == NONE
            if done.any():
                for row, k in zip(ids[done], at[done].tolist(), strict=True):
                    out[k] = row[row >= 0].astype("<u4").tobytes()
                keep = ~done
                ids, ranks, at, place, best = ids[keep], ranks[keep], at[keep], place[keep], best[keep]
            if not len(at):
                return out
            line = np.arange(len(at))
            ids[line, place] = best
            cut = np.ones(ids.shape, bool)
            cut[line, place + 1] = False
            ids = ids[cut].reshape(len(at), -1)  # compaction: one column less
            cut = np.ones(ranks.shape, bool)
            cut[line, np.minimum(place + 1, ranks.shape[1] - 1)] = False
            ranks = ranks[cut].reshape(len(at), -1)
            if not ranks.shape[1]:
                continue
            after = np.where(place + 1 < ids.shape[1], ids[line, np.minimum(place + 1, ids.shape[1] - 1)], np.int32(-1))
            right = self.rank(best, after)
            inside = place < ranks.shape[1]
            ranks[line[inside], place[inside]] = right[inside]
            inside = place > 0
            ranks[line[inside], place[inside] - 1] = self.rank(ids[line[inside], place[inside] - 1], best[inside])

    def _heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece: leftmost pair of least rank first."""
        ids = self.singles[np.frombuffer(piece, np.uint8)].tolist()
        n, pieces, get = len(ids), self.pieces, self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(pieces[ids[i]] + pieces[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get(pieces[r] + pieces[ids[k]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := get(pieces[ids[h]] + pieces[r])) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out, buckets = [b""] * len(pieces), {}
        for k, p in enumerate(pieces):
            if (i := self.ranks.get(p)) is not None:
                out[k] = i.to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = self._heap(p)
            elif p:
                buckets.setdefault(len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length(), []).append(k)
        for length, rows in buckets.items():
            step = max(1, CELLS // length)
            for i in range(0, len(rows), step):
                for k, ids in zip(rows[i : i + step], self._matrix([pieces[k] for k in rows[i : i + step]]), strict=True):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*split) - self.known.keys()) if split else []
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file (lines of base64 token and rank), one for each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return Codec(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, an array, if with_ids).

    Null text is the empty text: no tokens, digests of nothing.  Rows with equal or null ids each
    give a row; other columns are not read.  Texts and pieces may be of any length.
    """

    small_batches(docs)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts, ids = [t or "" for t in batch.column(1).to_pylist()], []
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= STEP_CHARS or i == len(texts) - 1:
                    ids += c.encode(texts[begin : i + 1])
                    begin, size = i + 1, 0
            out = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with an `ids` array; null ids give the empty text."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, text string")
