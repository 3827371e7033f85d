"""Media columns: payloads in content-defined chunks, each stored once.

A payload of 8-bit samples is cut by a rolling gear hash.  Chunks whose digest occurs once go straight into
pack files; of the others, Spark keeps one for each digest and packs those.  A medium is its ordered
chunk list; reading it back fetches the byte ranges, checks every chunk's digest and joins them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import cuts
from .common import Pack, Ranges, repeat_filter, shared_dir, small_batches, steps, texts_of, tidy, written

UNIT, PAD = 576, b"\xff"
BITS, LEAST, MOST = 11, 1024, 16384


def payload(text: bytes) -> bytes:
    """The text padded with bytes 255 up to a positive multiple of UNIT."""
    return text + PAD * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _chunks(payloads: list[bytes]) -> list[list[tuple[bytes, bytes]]]:
    """(SHA-256, bytes) of each payload's chunks."""
    out = []
    for p, ends in zip(payloads, cuts(payloads, BITS, LEAST, MOST, characters=False), strict=True):
        parts = [p[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        out.append([(hashlib.sha256(x).digest(), x) for x in parts])
    return out


def _keys(batch):
    texts = texts_of(batch.column(1))
    for i, j in steps(texts):
        yield np.frombuffer(b"".join(d[:8] for c in _chunks([payload(t) for t in texts[i:j]]) for d, _ in c), ">u8").astype(np.uint64)


MANIFEST = "medium bigint, doc_id bigint, n_bytes bigint, seq int, digest binary, file string, offset bigint, length int, blob binary"


def store(docs: DataFrame) -> DataFrame:
    """Writes the payloads of docs' texts; returns the manifest: a row for each chunk of each medium, with its place.

    Every row of docs is a medium of its own; `medium` is a random number and a count, new for each attempt of a task, and
    the manifest is written before it is read, so that only the attempts that succeeded are in it.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    small_batches(docs)
    repeats = repeat_filter(docs, _keys)

    def put(batches):
        pack, sent = None, set()
        medium = uuid.uuid4().int >> 65
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for i, j in steps(texts):
                rows = []
                found = _chunks([payload(t) for t in texts[i:j]])
                again = iter(repeats.value(np.frombuffer(b"".join(d[:8] for c in found for d, _ in c), ">u8").astype(np.uint64)).tolist())
                for k, chunks in enumerate(found, i):
                    medium = (medium + 1) % 2**63
                    for seq, (digest, x) in enumerate(chunks):
                        if next(again):  # kept once, after the shuffle
                            blob = squeeze(x) if digest not in sent else None
                            if len(sent) < 100_000:
                                sent.add(digest)
                            rows.append((medium, ids[k], len(texts[k]), seq, digest, None, None, None, blob))
                        else:
                            pack = pack or Pack(folder, ".pack")
                            blob = squeeze(x)
                            rows.append((medium, ids[k], len(texts[k]), seq, digest, pack.name, pack.append(blob), len(blob), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)
        if pack:
            pack.close()

    def put_shared(batches):
        pack = None
        for batch in batches:
            pack = pack or Pack(folder, ".pack")
            blobs = batch.column(1).to_pylist()
            places = [pack.append(b) for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.name] * len(blobs), pa.string()), pa.array(places, pa.int64()), pa.array([len(b) for b in blobs], pa.int32())], ["digest", "file", "offset", "length"])
        if pack:
            pack.close()

    rows = written(docs.mapInArrow(tidy(put), MANIFEST), "media-rows")
    shared = written(rows.where("blob is not null").select("digest", "blob").groupBy("digest").agg(F.first("blob").alias("blob")).mapInArrow(put_shared, "digest binary, file string, offset bigint, length int"), "media-shared")
    s = shared.select(F.col("digest").alias("d"), F.struct("file", "offset", "length").alias("place"))
    placed = rows.where("file is null").drop("blob", "file", "offset", "length").join(s, F.col("digest") == F.col("d")).select("medium", "doc_id", "n_bytes", "seq", "digest", "place.*")
    return rows.where("file is not null").drop("blob").unionByName(placed)


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
NAMES = ["medium", "doc_id", "n_bytes", "seq", "digest", "file", "offset", "length", "blob"]
OUT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks int"


def feature(samples: bytes) -> str:
    """Mean, deviation and mid-level crossings of the samples."""
    a = np.frombuffer(samples, np.uint8)
    high = a >= 128
    return f"mean={a.mean():.4f};dev={a.std():.4f};crossings={int((high[1:] != high[:-1]).sum())}"


def read_back(manifest: DataFrame) -> DataFrame:
    """Reconstructs each medium of a manifest from the store and describes it.

    The stored form is the medium's stored chunks in order, as they are in the pack files.  A chunk that is missing or whose
    digest does not match fails the job.
    """
    # a medium's chunk list is as long as its own text needs
    lists = manifest.groupBy("medium", "doc_id").agg(F.max("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("seq", "digest", "length", "file", "offset"))).alias("chunks")).drop("medium")

    def run(batches):
        ranges, expand = Ranges(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, n_bytes, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, stored, size = [], hashlib.sha256(), 0
                for seq, c in enumerate(chunks):
                    blob = ranges.read(c["file"], c["offset"], c["length"])
                    try:
                        parts.append(expand(blob, max_output_size=MOST))
                    except zstandard.ZstdError as e:
                        raise ValueError(f"chunk {seq} of document {doc_id} is damaged") from e
                    if c["seq"] != seq or hashlib.sha256(parts[-1]).digest() != c["digest"]:
                        raise ValueError(f"chunk {seq} of document {doc_id} is damaged or missing")
                    stored.update(blob)
                    size += len(blob)
                whole = b"".join(parts)
                if len(whole) != max(UNIT, -(-n_bytes // UNIT) * UNIT):
                    raise ValueError(f"the payload of document {doc_id} is not whole")
                rows.append((doc_id, n_bytes, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), size, stored.hexdigest(), feature(whole), len(parts)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return lists.mapInArrow(tidy(run), OUT)


def media_documents(docs: DataFrame) -> DataFrame:
    """Stores and reads back the payload of every row's text: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks.

    Null text is the empty text: one UNIT of padding.  Every row is a medium and gives a row, repeated rows and null ids too;
    equal texts give equal values.  Texts of any length are whole; an empty table gives an empty result; other columns are
    not read.
    """
    return read_back(store(docs))
