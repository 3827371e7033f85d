"""Shared pieces: the shared folder, byte-level word hashing and the repeat filter."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of a word and of the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideglass-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back.

    What led to it is then no longer needed, so its shuffle files go as well.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished, unreferenced stages now rather than at its next long GC."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from here on in the session: they bound what a Python worker holds at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow, with freed memory given back at the task's end: workers wait for the next task with what they hold."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def free(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes for no column of df to begin with it (in any case)."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(df: DataFrame) -> int:
    """Number of input splits, which follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` bytes each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit values by rule."""
    return mix64((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, U(_BASE)), np.full(n, U(_INVERSE))
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


IS_SPACE = _space_table()
LETTERS = random_table(256, 7)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the index of the first word of each text (and the end).

    A word's hash is a polynomial over its bytes, read from one running sum, so no word is built.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = 1 << max(20, int(len(buf) + 1).bit_length())
    up, down = _powers(size)
    space = IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    running = np.zeros(len(buf) + 1, U)
    np.cumsum(LETTERS[buf] * up[: len(buf)], out=running[1:])
    words = mix64((running[end] - running[begin]) * down[begin] + (end - begin).astype(U))
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return words, np.searchsorted(begin, starts)


class RepeatFilter:
    """A bitmap of 2**bits places, set where a key occurs at least twice in the data.

    It only spares work: a key that repeats always passes, so results do not depend on its
    size, which is fixed (16 MB at 27 bits) and so may be broadcast whatever the input.
    """

    def __init__(self, bitmap: np.ndarray, bits: int):
        self.bitmap, self.bits = bitmap, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> U(64 - self.bits)
        return (self.bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 != 0


def repeat_filter(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int = 27, flush: int = 500_000, least: int = 2):
    """Broadcast RepeatFilter of the uint64 keys that `keys` yields for df's batches (least=1: of all keys).

    Each task sends a key at most twice for every `flush` keys, dealt by the key's top bits, so a
    key in a third of all rows adds a row for each task only.
    """
    spark = df.sparkSession
    level = max(4, min(bits - 3, (4 * partitions(df) - 1).bit_length()))

    def emit(batches):
        held, n = [], 0

        def out():
            a = np.concatenate(held)
            held.clear()
            a.sort()
            keep = np.ones(len(a), bool)
            if least > 1:
                keep[2:] = a[2:] != a[:-2]
            else:
                keep[1:] = a[1:] != a[:-1]
            a = a[keep]
            cut = np.searchsorted(a, np.arange(1, 1 << level, dtype=U) << U(64 - level))
            parts = np.split(a, cut)
            full = [i for i, p in enumerate(parts) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for a in keys(batch):
                if len(a):
                    held.append(a)
                    n += len(a)
                if n >= flush:
                    yield out()
                    n = 0
        if n:
            yield out()

    def reduce(key, table):
        a = np.sort(np.concatenate([np.frombuffer(x, U) for x in table["payload"].to_pylist()]))
        if least > 1:
            a = a[1:][a[1:] == a[:-1]]
        bitmap = np.zeros(1 << (bits - level - 3), np.uint8)
        at = (a >> U(64 - bits)) & U((1 << (bits - level)) - 1)
        np.bitwise_or.at(bitmap, (at >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & U(7)).astype(np.uint8)))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([zlib.compress(bitmap.tobytes(), 1)], pa.binary())})

    def join(key, table):
        """The bitmaps of neighbouring buckets as one."""
        whole = np.zeros((1 << (level - high), 1 << (bits - level - 3)), np.uint8)
        for bucket, bitmap in zip(table["bucket"].to_pylist(), table["bitmap"].to_pylist(), strict=True):
            whole[bucket & ((1 << (level - high)) - 1)] = np.frombuffer(zlib.decompress(bitmap), np.uint8)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([zlib.compress(whole.tobytes(), 1)], pa.binary())})

    high = min(level, 8)
    sent = df.mapInArrow(tidy(emit), "bucket int, payload binary")
    rows = sent.groupBy("bucket").applyInArrow(reduce, "bucket int, bitmap binary")
    if level > high:
        rows = rows.groupBy(F.shiftright("bucket", level - high).alias("high")).applyInArrow(join, "bucket int, bitmap binary")
    whole = np.zeros((1 << high, 1 << (bits - high - 3)), np.uint8)
    for r in rows.collect():  # 256 rows at most, 2**bits bits in all
        whole[r.bucket] = np.frombuffer(zlib.decompress(r.bitmap), np.uint8)
    return spark.sparkContext.broadcast(RepeatFilter(whole.reshape(-1), bits))


class Pack:
    """A file in the shared folder to which a task appends blobs.

    Its name is new for each attempt of a task, and only rows of the attempt that succeeds name it, so
    a lost executor or a second attempt does no harm.  `folder` is a URI that pyarrow's file systems
    know (file, hdfs, s3, gs) or a path.
    """

    def __init__(self, folder: str, suffix: str):
        self.name = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.fs, path = open_fs(self.name)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.size = self.fs.open_output_stream(path, compression=None), 0

    def append(self, blob: bytes) -> int:
        """Offset of the blob."""
        self.file.write(blob)
        self.size += len(blob)
        return self.size - len(blob)

    def close(self) -> None:
        self.file.close()


def open_fs(name: str):
    import re

    from pyarrow import fs

    if re.match(r"file:/(?!//)", name):
        name = "file:///" + name[5:].lstrip("/")
    return fs.FileSystem.from_uri(name)


class Ranges:
    """Reads byte ranges of files in the shared folder; keeps the last few files open."""

    def __init__(self, keep: int = 16):
        self.open, self.keep = {}, keep

    def read(self, name: str, offset: int, length: int) -> bytes:
        file = self.open.get(name)
        if file is None:
            if len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open))).close()
            system, path = open_fs(name)
            file = self.open[name] = system.open_input_file(path)
        return file.read_at(length, offset)
