"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions, and each decision has a tree of contexts: no byte before it, one, up
to `depth`, a parameter from 2 to 7.  A node's counts give a Krichevsky-Trofimov estimate; the weight of stopping at a node against
going deeper follows from the probabilities that both give to all training data (Willems, Shtarkov and
Tjalkens 1995), so a byte's probability mixes the estimates of all depths.

Training counts strings of a byte and its context in numpy, merges them by their last two context bytes, and computes each such
subtree on its own; the levels above are one fixed-size table.  The model lies in pack files in the
shared folder, in shards of bounded size; scoring holds one shard at a time, whatever the size of the model.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Pack, Ranges, crc_mod, partitions, shared_dir, small_batches, word_hashes, written

#: Greatest context length in bytes unless the caller says otherwise; a string of seven context bytes and the byte fits 64 bits.
DEPTH, MOST_DEPTH = 4, 7
EDGE = 0xFF  # no byte of UTF-8: stands before the first byte and is coded as the end
#: One shard of the model, in bytes of its pack files: what a Python worker holds.
SHARD_BYTES = 96 << 20
#: Words whose counts go to all tasks: those above the least count that at most so many words have.
MAX_COMMON = 1 << 20
CHUNK, FLUSH = 1 << 20, 4 << 20


def normal(text: bytes) -> bytes:
    """The token sequence that both models score: A-Z lower-cased, words joined by one space."""
    return b" ".join(text.lower().split())


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2, by Stirling's series at x + 8."""
    z, below = x + 8.0, np.ones_like(x)
    for i in range(8):
        below *= x + i
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z - np.log(below)


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log2 of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return (lgamma(zeros + 0.5) + lgamma(ones + 0.5) - 1.1447298858494002 - lgamma(zeros + ones + 1.0)) / np.log(2)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the weighted probability of nodes with children, and the weight of stopping at them."""
    own = block_probability(zeros, ones)
    whole = np.logaddexp2(own, below) - 1
    return whole, np.exp2(own - 1 - whole)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _up(keys: np.ndarray, shift: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of columns by parent: node keys are context bytes, latest first, then 8 bits of decision."""
    parent = (keys >> U(8 + shift) << U(8)) | (keys & U(255))
    got, back = np.unique(parent, return_inverse=True)
    return (got, back, *(np.bincount(back, c, len(got)) for c in columns))


def decisions(strings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys, zeros and ones of the deepest contexts; a string is the context bytes, latest first, and the byte itself."""
    context, byte = strings >> U(8) << U(8), strings & U(255)
    keys = np.concatenate([context | U(1 << j) | (byte >> U(8 - j)) for j in range(8)])
    bit = np.concatenate([(byte >> U(7 - j)) & U(1) for j in range(8)]).astype(bool)
    c = np.tile(counts.astype(np.float64), 8)
    got, back = np.unique(keys, return_inverse=True)
    return got, np.bincount(back, np.where(bit, 0, c), len(got)), np.bincount(back, np.where(bit, c, 0), len(got))


def subtree(strings: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> dict:
    """Of the strings with the same two latest context bytes: (keys, predictions of their paths from depth 2 on) of the nodes of depths `depth` to 2, and the counts of depth 2.

    A prediction at a shallower node is for contexts whose deeper part was never seen: there the estimate is 1/2.
    """
    keys, zeros, ones = decisions(strings, counts)
    whole, stop = block_probability(zeros, ones), np.ones(len(keys))
    found = [(keys, zeros, ones, stop, None)]  # with the place of each node of the level below
    for _ in range(depth - 2):
        keys, to, zeros, ones, below = _up(keys, 8, zeros, ones, whole)
        whole, stop = weigh(zeros, ones, below)
        found.append((keys, zeros, ones, stop, to))
    base, on, levels = np.zeros(len(keys)), np.ones(len(keys)), []
    for d, (keys_, zeros_, ones_, stop, to) in enumerate(reversed(found), 2):
        base, on = base + on * stop * _estimate(zeros_, ones_), on * (1 - stop)
        levels.append((keys_, base + on / 2))
        if to is not None and d < depth:
            base, on = base[to], on[to]
    return {"levels": levels[::-1], "k2": keys, "zeros": zeros, "ones": ones, "whole": whole}


def top(k2: np.ndarray, zeros: np.ndarray, ones: np.ndarray, whole: np.ndarray) -> dict[str, np.ndarray]:
    """Depth-1 nodes from all depth-2 nodes under them."""
    k1, _, z1, o1, below = _up(k2, 8, zeros, ones, whole)
    w1, stop = weigh(z1, o1, below)
    return {"k1": k1, "zeros": z1, "ones": o1, "whole": w1, "stop": stop}


def root(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables a, g [latest byte, decision]: the probability of a one is a + g * (prediction from depth 2 on)."""
    a, g = np.zeros((256, 256)), np.zeros((256, 256))
    if not len(t["k1"]):
        return a, g + 1.0
    k0, to0, z0, o0, below = _up(t["k1"], 8, t["zeros"], t["ones"], t["whole"])
    _, stop0 = weigh(z0, o0, below)
    place = (k0 & U(255)).astype(int)
    a[:, place], g[:, place] = (stop0 * _estimate(z0, o0))[None], (1 - stop0)[None]
    unseen = np.ones(256, bool)
    unseen[place] = False
    g[:, unseen] = 1.0  # a decision that never came up: 1/2 at every depth
    c, d = (t["k1"] >> U(8)).astype(int), (t["k1"] & U(255)).astype(int)
    a[c, d] += g[c, d] * t["stop"] * _estimate(t["zeros"], t["ones"])
    g[c, d] *= 1 - t["stop"]
    return a, g


def strings_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Strings (context bytes, latest first, then the byte) of every byte and end of the normal texts, and each text's first."""
    edge = bytes([EDGE]) * depth
    buf = np.frombuffer(edge + edge.join(t + bytes([EDGE]) for t in texts), np.uint8).astype(U)
    keys = buf[depth:].copy()
    for j in range(1, depth + 1):
        keys |= buf[depth - j : len(buf) - j] << U(8 * (depth + 1 - j))
    size = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate(([0], np.cumsum(size + depth)))[:-1]
    step = np.zeros(len(keys) + 1, np.int8)
    step[begin] += 1
    step[begin + size] -= 1
    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
    return keys[keep], np.concatenate(([0], np.cumsum(size)))[:-1]


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.add.reduceat(c, at)


def _chunks(texts: list[bytes], limit: int = CHUNK):
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _texts(batch, column: int) -> list[bytes]:
    return [normal(x or b"") for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


class Counts:
    """Sorted keys and counts of a task, merged at most `flush` new keys at a time."""

    def __init__(self):
        self.held, self.n, self.keys, self.counts = [], 0, np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, flush: int) -> None:
        self.held.append(keys)
        self.n += len(keys)
        if self.n >= flush:
            self.settle()

    def settle(self) -> None:
        if self.held:
            k, c = _count(np.concatenate(self.held))
            self.keys, self.counts = _merge([self.keys, k], [self.counts, c]) if len(self.keys) else (k, c)
            self.held, self.n = [], 0


def count_training(docs: DataFrame, salts: int, depth: int = DEPTH) -> DataFrame:
    """kind 0: strings by their two latest context bytes; kind 1: word hashes by their top bits, in about four buckets for each input split; kind 2: number of texts.  Packed keys and counts of each task."""
    level = max(6, (4 * partitions(docs) - 1).bit_length())

    def emit(batches):
        strings, words, n = Counts(), Counts(), 0

        def rows():
            strings.settle()
            words.settle()
            for kind, of, part in ((0, strings, (strings.keys >> U(8 * (depth - 1))).astype(np.int64)), (1, words, (words.keys >> U(64 - level)).astype(np.int64))):
                at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
                for k, c, p in zip(np.split(of.keys, at[1:]), np.split(of.counts, at[1:]), part[at].tolist(), strict=True) if len(part) else ():
                    yield kind, p, k.tobytes(), c.astype(np.int64).tobytes()
                of.keys, of.counts = of.keys[:0], of.counts[:0]

        def out():
            found = list(rows())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "part", "keys", "counts"])

        for batch in batches:
            texts = _texts(batch, 0)
            n += len(texts)
            for i, j in _chunks(texts):
                strings.add(strings_of(texts[i:j], depth)[0], FLUSH)
                words.add(word_hashes(texts[i:j])[0], FLUSH // 4)
                if len(words.keys) + len(strings.keys) > 4_000_000:
                    yield out()
        if len(strings.keys) or strings.held:
            yield out()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int32()), pa.array([np.zeros(1, U).tobytes()], pa.binary()), pa.array([np.array([n], np.int64).tobytes()], pa.binary())], ["kind", "part", "keys", "counts"])

    sent = docs.where(crc_mod("doc_id", 7) != 2).select("text").mapInArrow(emit, "kind int, part int, keys binary, counts binary")
    return written(sent.withColumn("salt", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(salts)).cast("int")), "counts")


def _merge_rows(table) -> tuple[np.ndarray, np.ndarray]:
    return _merge([np.frombuffer(x, U) for x in table["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])


def merged(counts: DataFrame) -> DataFrame:
    """A row for each kind and part; first by salt, so that one part's rows from many tasks meet in two steps."""

    def merge(key, table):
        k, c = _merge_rows(table)
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "keys": pa.array([k.tobytes()], pa.large_binary()).cast(pa.binary()), "counts": pa.array([c.tobytes()], pa.binary())})

    schema = "kind int, part int, keys binary, counts binary"
    once = counts.groupBy("kind", "part", "salt").applyInArrow(merge, schema)
    return once.groupBy("kind", "part").applyInArrow(merge, schema)


def train(strings: DataFrame, depth: int = DEPTH) -> dict:
    """The model: tables a and g, and the places of its parts by shard (at most 65,536 rows); parts are in pack files."""
    folder = f"{shared_dir(strings.sparkSession)}/ctw-{uuid.uuid4().hex}"

    def grow(batches):
        pack = None
        for batch in batches:
            pack = pack or Pack(folder, ".ctw")
            for part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = subtree(np.frombuffer(keys, U), np.frombuffer(counts, np.int64), depth)
                data = b"".join([np.array([len(k) for k, _ in t["levels"]], np.int64).tobytes()] + [x for k, v in t["levels"] for x in (k.tobytes(), v.astype(np.float32).tobytes())])
                tops = b"".join([t["k2"].tobytes(), t["zeros"].tobytes(), t["ones"].tobytes(), t["whole"].tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack.name], pa.string()), pa.array([pack.append(data)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([tops], pa.binary())], ["part", "file", "at", "length", "tops"])
        if pack:
            pack.close()

    parts = written(strings.select("part", "keys", "counts").mapInArrow(grow, "part int, file string, at bigint, length bigint, tops binary"), "ctw-parts")

    def level1(key, table):  # at most 256 parts of at most 255 nodes each
        columns = [np.frombuffer(x, np.uint8) for x in table["tops"].to_pylist()]
        cut = [np.split(x, 4) for x in columns]
        t = top(np.concatenate([x[0].view(U) for x in cut]), *(np.concatenate([x[i].view(np.float64) for x in cut]) for i in (1, 2, 3)))
        return pa.table({"k1": pa.array(t["k1"].view(np.int64))} | {k: pa.array(t[k]) for k in ("zeros", "ones", "whole", "stop")})

    high = parts.withColumn("latest", F.shiftright("part", 8)).groupBy("latest").applyInArrow(level1, "k1 bigint, zeros double, ones double, whole double, stop double").toPandas()
    t = {k: high[k].to_numpy() for k in ("zeros", "ones", "whole", "stop")} | {"k1": high["k1"].to_numpy().astype(np.int64).view(U)}
    a, g = root(t)
    shards, size = [[]], 0
    for r in parts.select("part", "file", "at", "length").orderBy("part").collect():  # at most 65,536 rows
        if size and size + r.length > SHARD_BYTES:
            shards.append([])
            size = 0
        shards[-1].append((r.part, r.file, r.at, r.length))
        size += r.length
    return {"id": folder, "a": a, "g": g, "shards": shards, "depth": depth}


class Shard:
    """A range of the model's parts, as sorted arrays, with the log10 probability of every string in it."""

    def __init__(self, model: dict, number: int):
        depth = model["depth"]
        ranges, found = Ranges(), [([], []) for _ in range(depth - 1)]
        places = model["shards"][number]
        for _, file, at, length in places:
            data, offset = ranges.read(file, at, length), 8 * len(found)
            for (keys, values), m in zip(found, np.frombuffer(data, np.int64, len(found)).tolist(), strict=True):
                keys.append(np.frombuffer(data, U, m, offset))
                values.append(np.frombuffer(data, np.float32, m, offset + 8 * m))
                offset += 12 * m
        #: (keys, predictions, bits by which a string is shifted to the level), deepest first
        self.levels = [(np.concatenate(k) if k else np.zeros(0, U), np.concatenate(v) if v else np.zeros(0, np.float32), 8 * i) for i, (k, v) in enumerate(found, 1)]
        self.a, self.g, self.latest = model["a"], model["g"], U(8 * depth)
        # strings seen in training: decisions that end a byte
        deepest = self.levels[0][0]
        last = deepest[(deepest & U(128)) != 0]
        self.strings = np.sort(np.concatenate([(last >> U(8) << U(8)) | ((last & U(127)) << U(1)) | U(bit) for bit in (0, 1)]))
        self.scores = self._slow(self.strings).astype(np.float32)

    def _slow(self, strings: np.ndarray) -> np.ndarray:
        """log10 probabilities by the eight decisions, each from the deepest node that was seen."""
        total, latest = np.zeros(len(strings)), (strings >> self.latest).astype(int)
        byte = strings & U(255)
        for j in range(8):
            decision = U(1 << j) | (byte >> U(8 - j))
            bit = ((byte >> U(7 - j)) & U(1)).astype(bool)
            v, open_ = np.full(len(strings), 0.5), np.arange(len(strings))
            for keys, values, shift in self.levels:
                if not len(keys) or not len(open_):
                    continue
                want = (strings[open_] >> U(shift) << U(8)) | decision[open_]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                v[open_[hit]] = values[at[hit]]
                open_ = open_[~hit]
            d = decision.astype(int)
            one = self.a[latest, d] + self.g[latest, d] * v
            total += np.log10(np.where(bit, one, 1 - one))
        return total

    def score(self, strings: np.ndarray) -> np.ndarray:
        """log10 probabilities of sorted strings."""
        if not len(self.strings):
            return self._slow(strings)
        at = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
        out = self.scores[at].astype(np.float64)
        miss = np.flatnonzero(self.strings[at] != strings)
        if len(miss):
            got, back = np.unique(strings[miss], return_inverse=True)
            out[miss] = self._slow(got)[back]
        return out


_held: dict = {}


def shard(model: dict, number: int) -> Shard:
    """The shard; a worker keeps the last one."""
    key = (model["id"], number)
    if key not in _held:
        _held.clear()
        _held[key] = Shard(model, number)
    return _held[key]


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each normal text."""
    strings, begin = strings_of(texts, model["depth"])
    order = np.argsort(strings)
    ranked = strings[order]
    out = np.empty(len(ranked))
    part = ranked >> U(8 * (model["depth"] - 1))
    last = len(model["shards"]) - 1
    low = 0
    for number, places in enumerate(model["shards"]):
        high = len(ranked) if number == last else int(np.searchsorted(part, U(places[-1][0]), "right"))
        if high > low:
            out[low:high] = shard(model, number).score(ranked[low:high])
        low = max(low, high)
    scores = np.empty(len(ranked))
    scores[order] = out
    return np.add.reduceat(scores, begin) if len(begin) else np.zeros(0)


def _common(words: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the words with the least count that at most MAX_COMMON words reach, and that count."""
    steps = [2**k for k in range(1, 50)]
    row = words.agg(*(F.sum((F.col("c") >= s).cast("bigint")).alias(f"n{s}") for s in steps)).first()
    least = next(s for s in steps if (row[f"n{s}"] or 0) <= MAX_COMMON)
    got = words.where(F.col("c") >= least).toArrow()  # at most MAX_COMMON rows
    h, c = got["h"].to_numpy().view(U), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], least


RESULT = "doc_id bigint, row_key bigint, held_out boolean, n_tokens bigint, n_known bigint, log_sum double, score double, code_bits_per_byte double, rare array<bigint>, rare_counts array<int>"


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bits_per_byte.

    Both models score the sequence of lower-cased words and an end; null and empty texts are just the end.
    Documents with crc32(doc_id as text) mod 7 of 2 are held out of training; null ids are not.  The base gives a token
    (c + 1) / (N + V + 1); without training rows N = V = c = 0, so it scores 0, and the tree gives 1/2 to every decision.
    `depth` is the greatest context length, 2 to MOST_DEPTH bytes.
    Repeated rows each give a row; extra columns are not read.
    """
    if not 2 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is {depth}; it goes from 2 to {MOST_DEPTH}")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    small_batches(docs)
    counts = written(merged(count_training(docs, max(1, int(partitions(docs) ** 0.5)), depth)), "merged")
    model = spark.sparkContext.broadcast(train(counts.where("kind = 0"), depth))

    def spread(batches):
        for batch in batches:
            for k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["h", "c"])

    words = written(counts.where("kind = 1").select("keys", "counts").mapInArrow(spread, "h bigint, c bigint"), "words")
    n_texts = sum(int(np.frombuffer(r.counts, np.int64).sum()) for r in counts.where("kind = 2").select("counts").collect())
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = size.n + n_texts, size.v + (n_texts > 0)
    often, often_counts, _ = _common(words)
    common = spark.sparkContext.broadcast((often, often_counts))

    def score(batches):
        hashes, known = common.value
        for batch in batches:
            ids, held, texts = batch.column(0).to_pylist(), batch.column(1), _texts(batch, 2)
            columns = [[] for _ in range(7)]
            for i, j in _chunks(texts):
                part = texts[i:j]
                scores = score_texts(model.value, part)
                words_, first = word_hashes(part)
                at = np.minimum(np.searchsorted(hashes, words_), max(0, len(hashes) - 1))
                hit = hashes[at] == words_ if len(hashes) else np.zeros(len(words_), bool)
                logs = np.where(hit, np.log10(known[at] + 1.0), 0.0) if len(hashes) else np.zeros(len(words_))
                logs, hits = np.concatenate(([0.0], np.cumsum(logs))), np.concatenate(([0], np.cumsum(hit)))
                for k, t in enumerate(part):
                    a, b = int(first[k]), int(first[k + 1])
                    rare, rare_counts = np.unique(words_[a:b][~hit[a:b]], return_counts=True)
                    for column, x in zip(columns, (xxhash.xxh3_64_intdigest(t, seed=(ids[i + k] or 0) & (2**64 - 1)) >> 1, b - a + 1, hits[b] - hits[a], logs[b] - logs[a], scores[k], rare.view(np.int64), rare_counts.astype(np.int32)), strict=True):
                        column.append(x)
            key, n, n_known, log_sum, scores, rare, rare_counts = columns
            bits = [-s / np.log10(2) / (len(t) + 1) for s, t in zip(scores, texts, strict=True)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, types[0]), held, *(pa.array(x, t) for x, t in zip((n, n_known, log_sum, scores, bits, rare, rare_counts), types[1:], strict=True))], [f.split()[0] for f in RESULT.split(", ")])

    table = written(docs.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "text").mapInArrow(score, RESULT), "lm-scores")
    # words that are not common: counts by a join, summed for each document
    rare = table.where(F.size("rare") > 0).groupBy("doc_id", "row_key").agg(F.first(F.arrays_zip("rare", "rare_counts")).alias("e")).select("doc_id", "row_key", F.explode("e").alias("e"))
    rare = rare.select("doc_id", "row_key", F.col("e.rare").alias("h"), F.col("e.rare_counts").cast("bigint").alias("k")).join(words, "h")
    sums = rare.groupBy("doc_id", "row_key").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more_log"))
    sums = written(sums.withColumnRenamed("doc_id", "sum_id").withColumnRenamed("row_key", "sum_key"), "lm-rare")
    both = table.drop("rare", "rare_counts").join(sums, F.col("doc_id").eqNullSafe(F.col("sum_id")) & (F.col("row_key") == F.col("sum_key")), "left")
    end = float(np.log10(n_texts + 1.0))
    every = float(np.log10(tokens + kinds + 1))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_texts > 0))).cast("bigint").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("more_log", F.lit(0.0)) + end - F.col("n_tokens") * every).alias("base_score"), "score", "code_bits_per_byte",
    )
