"""Substring deduplication: content-defined chunks, deduplicated by digest.

Texts are cut by a rolling gear hash into chunks of some fifty bytes.  A chunk whose digest
occurred before, in order of (doc_id, text, place), is a repeat; runs of repeats of at least `least_run` bytes
are removed, so a passage stays where it came first and goes where it comes again, whatever stands
around it.  Single short chunks that two texts share by chance stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunking import cuts
from .common import free, repeat_filter, small_batches, steps, texts_of, tidy, written

BITS, LEAST, MOST, LEAST_RUN = 5, 24, 512, 96
SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
ADDED = ("n_bytes", "removed_bytes", "spans", "first_ids")
#: A chunk's digest that is over one in so many of the chunks that pass the filter is joined by broadcast: there are at most so many.
HOT = 4096


def _row_key(doc_id, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=(doc_id or 0) & (2**64 - 1)) >> 1


def _digests(texts: list[bytes]) -> list[tuple[list[int], list[bytes]]]:
    digest = xxhash.xxh3_128_digest
    return [(ends, [digest(t[a:b]) for a, b in zip([0, *ends], ends, strict=False)]) for t, ends in zip(texts, cuts(texts, BITS, LEAST, MOST), strict=True)]


def _low(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, begin, end of every chunk that repeats an earlier one, and first_id, the document where that was."""

    def keys(batch):
        texts = texts_of(batch.column(1))
        for i, j in steps(texts):
            yield _low([d for _, ds in _digests(texts[i:j]) for d in ds])[:, 0].copy()

    repeats = repeat_filter(docs, keys)

    def emit(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for i, j in steps(texts):
                found = _digests(texts[i:j])
                flat = _low([d for _, ds in found for d in ds])
                n = [len(ends) for ends, _ in found]
                owner = np.repeat(np.arange(i, j), n)
                end = np.array([e for ends, _ in found for e in ends], np.int32)
                begin = np.array([b for ends, _ in found for b in [0, *ends][:-1]], np.int32)
                keep = np.flatnonzero(repeats.value(flat[:, 0]))
                if not len(keep):
                    continue
                row = {k: _row_key(ids[k], texts[k]) for k in set(owner[keep].tolist())}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in owner[keep].tolist()], pa.int64()), pa.array([row[k] for k in owner[keep].tolist()], pa.int64()),
                        pa.array(begin[keep]), pa.array(end[keep]), pa.array(flat[keep, 0].view(np.int64)), pa.array(flat[keep, 1].view(np.int64)),
                    ],
                    ["doc_id", "row_key", "begin", "end", "d1", "d2"],
                )

    chunks = written(docs.mapInArrow(tidy(emit), "doc_id bigint, row_key bigint, begin int, end int, d1 bigint, d2 bigint"), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "begin")
    first = chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("latest"), F.count(F.lit(1)).alias("n")).where("first != latest")
    first = written(first.select("d1", "d2", "first", "n"), "first-chunks")
    often = F.broadcast(first.where(F.col("n") * HOT > chunks.count()).select("d1", "d2", "first"))  # at most HOT rows
    rest = first.where(F.col("n") * HOT <= chunks.count()).select("d1", "d2", "first")
    joined = chunks.join(often, ["d1", "d2"]).unionByName(chunks.join(often, ["d1", "d2"], "left_anti").join(rest, ["d1", "d2"]))
    return joined.where(place != F.col("first")).select("doc_id", "row_key", "begin", "end", F.col("first.doc_id").alias("first_id")).distinct()


def dedup_substrings(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """The rows and columns of docs with repeated passages cut from text, and:

    n_bytes, removed_bytes (bigint), spans (array of struct<begin, end> in bytes of the old text),
    first_ids (sorted ids of the documents where what was cut came first).
    Rows of equal id and text are one document and get the same answer.  Null and empty texts stay
    as they are, with no span; null ids come last in the order of first occurrence.  A column of docs
    that is called like one of these is replaced; all others stay, whatever their names.
    """
    small_batches(docs)
    repeats = repeated_chunks(docs.select("doc_id", "text"))
    # runs of adjacent repeats; a document's own chunks only, so no group is larger than a text
    runs = repeats.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "first_id"))).alias("parts"))
    schema = "doc_id bigint, row_key bigint, spans array<struct<begin:int,end:int>>, first_ids array<bigint>"

    def merge(batches):
        for batch in batches:
            out, firsts = [], []
            for parts in batch.column(2).to_pylist():
                spans: list[dict] = []
                for p in parts:
                    if spans and spans[-1]["end"] == p["begin"]:
                        spans[-1]["end"] = p["end"]
                        spans[-1]["ids"].add(p["first_id"])
                    else:
                        spans.append({"begin": p["begin"], "end": p["end"], "ids": {p["first_id"]}})
                spans = [s for s in spans if s["end"] - s["begin"] >= least_run]
                firsts.append(sorted(set().union(*(s.pop("ids") for s in spans)) - {None}))
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, SPANS), pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "row_key", "spans", "first_ids"])

    spans = runs.mapInArrow(tidy(merge), schema).where(F.size("spans") > 0)
    rest = [c for c in docs.columns if c.lower() not in ADDED]
    key, own = free(docs, "row_key"), free(docs, "span_of")
    keyed = _with_row_key(docs.select(*rest), key)
    # only the few rows that lose a passage need a join with the texts
    s = spans.select(F.col("doc_id").alias(own), F.col("row_key").alias(f"{own}_key"), "spans", "first_ids")
    both = keyed.join(s, keyed["doc_id"].eqNullSafe(s[own]) & (keyed[key] == s[f"{own}_key"]), "left").drop(own, f"{own}_key", key)
    return _cut(both, rest)


def _with_row_key(docs: DataFrame, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(at_id).to_pylist(), texts_of(batch.column(at_text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_row_key(i, t) for i, t in zip(ids, texts, strict=True)], pa.int64())], [*batch.schema.names, name])

    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.mapInArrow(tidy(run), schema)


def _cut(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Cuts the spans out of the texts."""
    at, spans_at = docs.columns.index("text"), docs.columns.index("spans")

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(spans_at).to_pylist()
            new, gone, size = [], [], []
            for t, parts in zip(texts, spans, strict=True):
                kept, last = [], 0
                for p in parts or ():
                    kept.append(t[last : p["begin"]])
                    last = p["end"]
                new.append(t if t is None else b"".join([*kept, t[last:]]))
                size.append(len(t or b""))
                gone.append(size[-1] - len(new[-1] or b""))
            columns_ = list(batch.columns)
            columns_[at] = pa.array(new, pa.binary()).cast(pa.string())
            columns_[spans_at] = pa.array([p or [] for p in spans], SPANS)
            yield pa.RecordBatch.from_arrays([*columns_, pa.array(size, pa.int64()), pa.array(gone, pa.int64())], names)

    names = [*docs.columns, "n_bytes", "removed_bytes"]
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("removed_bytes", T.LongType())])).select(*columns, *ADDED)
