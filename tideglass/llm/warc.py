"""WARC archives with a two-level capture index.

Records are gzip members in archive files.  Captures are sorted by reversed-host URL key and page
into compressed blocks of lines; a sparse directory keeps the first key and place of each block.  A
lookup finds the index part by the parts' bounds, binary-searches the part's directory, expands one block, and
then reads the record's byte range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pack, Ranges, partitions, shared_dir, written

BLOCK_LINES, ARCHIVE_BYTES, LEVEL = 1000, 256 << 20, 4
DATE = "2000-01-01T00:00:00Z"
LEAST_REVISIT_BYTES = 0
#: A payload in more than one in so many of the rows whose payloads repeat is joined by broadcast.
HOT = 4096

CAPTURE = "key string, line string"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://A.example.com:80/x?y -> com,example,a)/x?y.  A URL that can't be split is its own key."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'' if page_id is None else f'{page_id:020d}'}".replace("\n", "%0A").replace("\t", "%09")


def _record_id(page_id, url) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {url}'.encode()).digest())}>"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, refers: tuple | None) -> bytes:
    """A record as a gzip member; refers: (page_id, url) of the response that a revisit stands for."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers else head + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_record_id(page_id, url)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(*refers)}", f"WARC-Refers-To-Target-URI: {_clean(refers[1] or '')}"]
        lines += [f"X-Refers-To-Page-Id: {refers[0]}"] if refers[0] is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = rest[: int(warc["Content-Length"])]
    head, _, body = body.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), body


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row of pages; returns the captures (key and JSON line), written to the shared folder.

    Of rows with equal payloads of at least `least` bytes, the one of least (page_id, url), null last, is the
    response and the others are revisits of it; of rows alike in these, too, one.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", html.alias("payload")).withColumn("same", F.sha2("payload", 256))
    who = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    # only payloads that occur again need a join
    rows_of = p.where(F.length("payload") >= least).groupBy("same", who.alias("who")).agg(F.count(F.lit(1)).alias("alike"))
    first = rows_of.groupBy("same").agg(F.min(F.struct("who", "alike")).alias("first"), F.sum("alike").alias("size")).where("size > 1").select(F.col("same").alias("again"), "first.who", "first.alike", "size")
    first = written(first, "first-captures")
    # a payload in a large share of the rows is joined by broadcast: there are at most HOT such, and none meets in one task
    n, alike = first.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("alike"), F.lit(0))).first()
    hot, rest = first.where(F.col("size") * HOT > n), first.where(F.col("size") * HOT <= n)
    same = F.col("same") == F.col("again")
    in_hot = p.join(F.broadcast(hot), same)
    others = p.join(F.broadcast(hot.select("again")), same, "left_anti").join(rest, same, "left")
    joined = in_hot.unionByName(others).withColumn("revisit", F.coalesce(who != F.col("who"), F.lit(False)))
    out = ["page_id", "url", "who", "revisit", "payload"]
    several = ~F.col("revisit") & (F.coalesce("alike", F.lit(1)) > 1)
    # rows alike in all: a row for each task, and then as many as there are, of which one is the response
    repeated = joined.where(several).groupBy("page_id", "url", "same").agg(F.count(F.lit(1)).alias("n"), F.first("who").alias("who"), F.first("payload").alias("payload"))
    repeated = repeated.select("page_id", "url", "who", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k"), "payload").withColumn("revisit", F.col("k") > 1)
    rows = joined.where(~several).select(*out).unionByName(repeated.select(*out)) if alike > 1 else joined.select(*out)
    rows = rows.select("page_id", "url", F.when(F.col("revisit"), F.col("who.page_id")).alias("first_id"), F.when(F.col("revisit"), F.col("who.url")).alias("first_url"), "revisit", "payload")

    def write(batches):
        pack = None
        for batch in batches:
            keys, lines = [], []
            for page_id, url, first_id, first_url, revisit, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack is None or pack.size > ARCHIVE_BYTES:
                    if pack:
                        pack.close()
                    pack = Pack(folder, ".warc.gz")
                member = record(page_id, url, payload, (first_id, first_url) if revisit else None)
                keys.append(capture_key(url, page_id))
                lines.append(json.dumps([pack.name, pack.append(member), len(member)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], ["key", "line"])
        if pack:
            pack.close()

    return written(rows.mapInArrow(write, CAPTURE), "captures")


class Index:
    """The parts of a capture index: first keys and directory places, in order; one row for each range partition."""

    def __init__(self, parts: list[tuple[str, str, int, int]]):
        self.parts = sorted(parts)
        self.first = [p[0] for p in self.parts]

    def part(self, key: str) -> int:
        """The part that holds a key; equal keys are never in two parts."""
        return max(0, bisect.bisect_right(self.first, key) - 1)


def build_index(captures: DataFrame, parts: int | None = None) -> Index:
    """Sorts the captures into range partitions, writes each one's blocks and then its directory."""
    folder = f"{shared_dir(captures.sparkSession)}/index-{uuid.uuid4().hex}"
    ordered = captures.repartitionByRange(parts or partitions(captures), "key").sortWithinPartitions("key")

    def write(batches):
        pack, directory, block, total = None, [], [], 0

        def flush():
            data = zlib.compress("\n".join(f"{k}\t{v}" for k, v in block).encode(), LEVEL)
            directory.append((block[0][0], pack.append(data), len(data)))
            block.clear()

        for batch in batches:
            for k, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pack = pack or Pack(folder, ".cdx")
                if len(block) >= BLOCK_LINES and k != block[-1][0]:  # one key's lines stay together
                    flush()
                block.append((k, line))
                total += 1
        if pack:
            flush()
            data = json.dumps(directory).encode()
            at = pack.append(data)
            pack.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([pack.name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], ["first", "file", "at", "length"])

    rows = ordered.mapInArrow(write, "first string, file string, at bigint, length bigint").collect()  # a row for each part
    return Index([tuple(r) for r in rows])


class Part:
    """Binary search in one part: its directory, then one block (the last one is kept)."""

    def __init__(self, ranges: Ranges, place: tuple[str, str, int, int]):
        self.ranges, self.file = ranges, place[1]
        self.directory = json.loads(ranges.read(place[1], place[2], place[3]))
        self.first = [d[0] for d in self.directory]
        self.held, self.keys, self.lines = -1, [], []

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of the captures of a key."""
        b = bisect.bisect_right(self.first, key) - 1
        if b < 0:
            return []
        if b != self.held:
            block = zlib.decompress(self.ranges.read(self.file, self.directory[b][1], self.directory[b][2])).decode().split("\n")
            self.held, self.keys, self.lines = b, [x.partition("\t")[0] for x in block], [x.partition("\t")[2] for x in block]
        i = bisect.bisect_left(self.keys, key)
        j = bisect.bisect_right(self.keys, key)
        return [tuple(json.loads(x)) for x in self.lines[i:j]]


def lookup(index: Index, keys: DataFrame) -> DataFrame:
    """Reads back the records of capture keys (column `key`) through the index."""
    if not index.parts:
        return keys.sparkSession.createDataFrame([], RESULT)
    parts = index  # a few strings for each part

    def route(batches):
        for batch in batches:
            k = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parts.part(x) for x in k], pa.int32())], ["key", "part"])

    def read(batches):
        ranges, part, at = Ranges(), None, None
        for batch in batches:
            out = []
            for key, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    part, at = Part(ranges, parts.parts[number]), number
                for place in part.find(key):
                    warc, http, payload = parse(ranges.read(*place))
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = warc["WARC-Type"] == "revisit"
                    n = int(http["Content-Length"])
                    if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the record at {place} is damaged")
                    refers = warc.get("X-Refers-To-Page-Id")
                    page = warc.get("X-Page-Id")
                    out.append((int(page) if page else None, n, digest, warc["WARC-Type"], int(refers) if refers else None))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    routed = keys.select("key").distinct().mapInArrow(route, "key string, part int")
    return routed.repartition(len(index.parts), "part").sortWithinPartitions("part", "key").mapInArrow(read, RESULT)


def archive_pages(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes and indexes a record for each row, then reads every one back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; a null or malformed URL is a key like any other; a null page_id
    comes last and gives null refers_to.  Of rows alike in id, URL and html one can be the response, the others revisit it.
    An empty table gives an empty result; extra columns are not read.  Fails if a row is not read back, or if what a revisit
    says of its payload is not that of the response it names.
    """
    captures = write_archives(pages, least)
    found = written(lookup(build_index(captures), captures), "records")
    if (there := found.count()) != (written_ := captures.count()):
        raise ValueError(f"{written_} records were written and {there} read back")
    claims = found.where("record_type = 'revisit' and refers_to is not null").select("refers_to", "payload_digest", "payload_bytes").distinct()
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    if not claims.join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").isEmpty():
        raise ValueError("a revisit names a response with another payload")
    return found
