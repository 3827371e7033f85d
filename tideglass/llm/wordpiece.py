"""Greedy word-piece lengths by a linear longest-match automaton.

A trie of the vocabulary gets failure links; each link has the number of pieces that are popped on
it, computed once, so a word is counted in one pass over its bytes and no piece is built.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, steps, texts_of, tidy

#: Distinct words remembered between steps.
REMEMBERED = 400_000
UNKNOWN = 1 << 40

SCHEMA = "doc_id bigint, n_bytes bigint, n_words bigint, n_tokens bigint, n_unknown bigint"


class Automaton:
    """`first`: pieces that may start a word; `rest`: pieces that may follow one."""

    def __init__(self, first: set[bytes], rest: set[bytes]):
        step: dict[int, int] = {}  # node << 8 | byte: node
        ends = [False, False]  # node 0: start of a word, node 1: start of a later piece
        order: list[tuple[int, int, int]] = []
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for b in piece:
                    at = node << 8 | b
                    if at not in step:
                        step[at] = len(ends)
                        ends.append(False)
                        order.append((len(ends) - 1, node, b))
                    node = step[at]
                ends[node] = node > 1
        fail, pops = [-1] * len(ends), [0] * len(ends)
        children: dict[int, list[tuple[int, int]]] = {}
        for node, parent, b in order:
            children.setdefault(parent, []).append((node, b))
        level = [0, 1]
        while level:  # parents before children, shorter strings first
            below = []
            for u in level:
                for v, b in children.get(u, ()):
                    below.append(v)
                    if ends[v]:
                        fail[v], pops[v] = 1, 1
                        continue
                    z, popped = fail[u], pops[u]
                    while z >= 0 and (z << 8 | b) not in step:
                        popped += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = step[z << 8 | b], popped
            level = below
        self.step, self.fail, self.pops = step, fail, pops
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; UNKNOWN + 1 if some part of it matches no piece."""
        step, fail, pops = self.step.get, self.fail, self.pops
        node = n = 0
        for b in word:
            while (to := step(node << 8 | b)) is None:
                if fail[node] < 0:
                    return UNKNOWN + 1
                n += pops[node]
                node = fail[node]
            node = to
        while node != 1:
            if fail[node] < 0:
                return UNKNOWN + 1
            n += pops[node]
            node = fail[node]
        return n

    def counts(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """Words, tokens and unknown words of each text; an unknown word is one token."""
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set().union(*split) - known.keys() if split else ():
            known[w] = self.count(w)
        out = []
        for words in split:
            total = sum(map(known.__getitem__, words))
            out.append((len(words), total % UNKNOWN, total // UNKNOWN))
        return out


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """From a rank file: tokens after a space start a word, the others without a space continue one."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    return Automaton({t[1:] for t in tokens if t[:1] == b" " and t[1:]}, {t for t in tokens if t[:1] != b" "})


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_words, n_tokens, n_unknown by greedy longest match.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  A null text counts as empty: all zero.
    Repeated rows and null ids each give a row; other columns are not read; a word may be of any
    length, as the automaton is linear.
    """

    def run(batches):
        a = automaton(path)
        for batch in batches:
            texts, found = texts_of(batch.column(1)), []
            for i, j in steps(texts):
                found += a.counts(texts[i:j])
            n = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(n[:, k]) for k in range(3))], names)

    small_batches(docs)
    names = ["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
