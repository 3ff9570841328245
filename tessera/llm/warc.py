"""WARC archives with a two-level capture index.

Pages are sorted by their URL key, reversed host first, and written as WARC records, a gzip member each, in one archive per
task. Beside each archive lies its index: entries (key, id, offset, length) in compressed blocks, and a sparse directory with
the first key of each block. A list of archives by first key stands on top. A lookup searches the list, the directory and the
block by halves, then reads the record's range of bytes. Neighbouring ranges are read at once.

Of records with equal payloads of ``min_revisit`` bytes or more, that with the largest id is a response and the others revisit
it. Payloads are equal if SHA-256 and length are. The largest id of each payload comes from partial aggregation; it meets the
pages in the sorted stream, so pages are shuffled once, and neither a payload nor a host with a third of all pages is gathered.

Files are named anew by each attempt of a task and only those of attempts that ended well are listed, so a lost executor
leaves no half archive behind. They lie in the folder that driver and executors share, reached by its URI.

Defined results: a null payload counts as empty. Ids are kept as text and come back in their type; null ids come back as null,
empty ones as empty, and rows that tie in the largest id are all responses. A payload may be as long as a worker can hold. A null or malformed URL has a key of its own, made from its text.
Repeated rows are records each. All captures of one URL and id lie in one archive, so rows of one URL without ids, or with one id,
are written and looked up by one task, in a stream. Only the named columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

BLOCK = 2_000
#: Ranges of an archive closer than GAP bytes are read at once, up to RANGE bytes.
GAP, RANGE = 65_536, 8_000_000
DIRECTORY = "archive string, index string, first string, directory_at long, directory_bytes long, n long"
#: Queries that a task of a lookup answers at least, about.
LOOKED_UP = 500
URN = "urn:page-id:"


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: ``com,example,www)/path?query``."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?(.*)$"
    host, rest = F.lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
    return F.when(host == "", F.concat(F.lit(")"), text)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest))


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def marked(id_: Column) -> Column:
    """An id as text after a mark; no text at all for a null id, which is thus another than the empty id."""
    return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))


def record_id(id_: str) -> str:
    return f"<{URN}{quote(id_[1:], safe='')}>" if id_ else "<urn:no-page-id>"


def build_record(id_: str, url: str, payload: bytes, kind: str, refers_to: str | None, date: str) -> bytes:
    """A WARC record: a response has its payload, a revisit the HTTP headers only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(id_)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to or '')}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(member: bytes) -> dict:
    """Headers (names in lower case), HTTP headers and payload of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write archives and indexes under folder, a URI that all machines reach; returns the list of archives (DIRECTORY)."""
    spark = pages.sparkSession
    runtime.ship(spark)
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    base = pages.select(url_key(pages[url_col]).alias("key"), marked(pages[id_col]).alias("id"), pages[id_col].alias("raw"), F.sha2(payload, 256).alias("sha"), F.coalesce(pages[url_col], F.lit("")).alias("url"), payload.alias("payload"))
    narrow = base.select("key", "id", "raw", "sha", F.length("payload").alias("n"))
    largest = narrow.where(F.col("n") >= min_revisit).groupBy("sha", "n").agg(F.max("raw").alias("top"), F.count("*").alias("copies")).where("copies > 1").select(F.col("sha").alias("sha_"), F.col("n").alias("n_"), "top")
    revisits = narrow.join(largest, (F.col("sha") == F.col("sha_")) & (F.col("n") == F.col("n_"))).where(~F.col("raw").eqNullSafe(F.col("top")))
    marks = revisits.select("key", "id", "sha", F.lit(0).alias("tag"), marked(F.col("top")).alias("url"), F.lit(None).cast("binary").alias("payload")).distinct()
    stream = marks.unionByName(base.select("key", "id", "sha", F.lit(1).alias("tag"), "url", "payload"))
    ordered = stream.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "sha", "tag")

    def run(batches):
        store, root = _open(folder)
        name = uuid.uuid4().hex
        archive = index = None
        at = index_at = total = 0
        entries: list[list] = []
        directory: list[list] = []
        mark, first = None, ""

        def flush() -> int:
            nonlocal entries
            block = zlib.compress("\n".join(json.dumps(e) for e in entries).encode())
            index.write(block)
            directory.append([entries[0][0], entries[0][1], index_at, len(block)])
            entries = []
            return index_at + len(block)

        for batch in runtime.slices(batches, "payload", 16_000_000):
            columns = [c.to_pylist() for c in batch.columns]
            for key, id_, sha, tag, url, body in zip(*columns, strict=True):
                if not tag:
                    mark = (key, id_, sha, url)
                    continue
                if archive is None:
                    store.create_dir(root, recursive=True)
                    archive, index, first = store.open_output_stream(f"{root}/{name}.warc.gz", compression=None), store.open_output_stream(f"{root}/{name}.index", compression=None), json.dumps([key, id_])
                again = mark is not None and mark[:3] == (key, id_, sha)
                member = _member(build_record(id_, url, body, "revisit" if again else "response", mark[3] if again else None, date), level)
                archive.write(member)
                entries.append([key, id_, at, len(member)])
                at, total = at + len(member), total + 1
                if len(entries) == BLOCK:
                    index_at = flush()
        if archive is None:
            return
        if entries:
            index_at = flush()
        packed = zlib.compress("\n".join(json.dumps(d) for d in directory).encode())
        index.write(packed)
        archive.close(), index.close()
        yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "index": [f"{name}.index"], "first": [first], "directory_at": [index_at], "directory_bytes": [len(packed)], "n": [total]})

    return runtime.materialize(ordered.mapInArrow(run, DIRECTORY), "archives")


class Reader:
    """Finds captures in the archives of a folder; holds one directory, one block and one range of bytes at a time."""

    def __init__(self, folder: str, archives: list[dict]) -> None:
        self.store, self.root = _open(folder)
        self.archives = archives
        self.firsts = [self._order(*json.loads(a["first"])) for a in archives]
        self.part = self.block = -1
        self.files: dict[str, pa.NativeFile] = {}

    @staticmethod
    def _order(key: str, id_: str) -> tuple[bytes, bytes]:
        return key.encode(), id_.encode()

    def _read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.files:
            for f in self.files.values():
                f.close()
            self.files = {name: self.store.open_input_file(f"{self.root}/{name}")}
        f = self.files[name]
        f.seek(at)
        return f.read(size)

    def _enter(self, part: int, block: int) -> None:
        a = self.archives[part]
        if part != self.part:
            rows = zlib.decompress(self._read(a["index"], a["directory_at"], a["directory_bytes"])).decode().split("\n")
            self.directory = [json.loads(r) for r in rows]
            self.heads = [self._order(*d[:2]) for d in self.directory]
            self.part, self.block = part, -1
        if block != self.block:
            _, _, at, size = self.directory[block]
            self.entries = [json.loads(r) for r in zlib.decompress(self._read(a["index"], at, size)).decode().split("\n")]
            self.keys = [self._order(*e[:2]) for e in self.entries]
            self.block = block

    def find(self, key: str, id_: str, nth: int = 0) -> tuple[int, int, int] | None:
        """Archive, offset and length of the nth capture of a key and id. All captures of a pair lie in one archive."""
        want = self._order(key, id_)
        part = bisect.bisect_right(self.firsts, want) - 1
        if part < 0:
            return None
        self._enter(part, max(0, self.block if part == self.part else 0))
        block = max(0, bisect.bisect_left(self.heads, want) - 1)
        while block < len(self.directory):
            self._enter(part, block)
            at = bisect.bisect_left(self.keys, want)
            there = bisect.bisect_right(self.keys, want) - at
            if nth < there:
                return part, *self.entries[at + nth][2:]
            if at + there < len(self.keys):
                return None
            nth, block = nth - there, block + 1
        return None

    def records(self, places: list[tuple[int, int, int] | None]):
        """The record at each place, in that order; ranges that follow each other closely are read at once."""
        i = 0
        while i < len(places):
            if places[i] is None:
                yield None
                i += 1
                continue
            part, begin, size = places[i]
            j, end = i + 1, begin + size
            while j < len(places) and places[j] is not None and places[j][0] == part and 0 <= places[j][1] - end <= GAP and places[j][1] + places[j][2] - begin <= RANGE:
                end = places[j][1] + places[j][2]
                j += 1
            data = self._read(self.archives[part]["archive"], begin, end - begin)
            for _, at, n in places[i:j]:
                yield parse_record(data[at - begin : at - begin + n])
            i = j


def lookup(queries: DataFrame, archives: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", with_payload: bool = False) -> DataFrame:
    """The capture of each id and URL: ``id_col``, payload_bytes, payload_digest, record_type, refers_to (payload).

    archives: what ``write`` returned, a row for each task that wrote. A query repeated k times gets the first k captures of
    its id and URL; queries without a capture give no row.
    """
    spark = queries.sparkSession
    runtime.ship(spark)
    listed = sorted((r.asDict() for r in archives.collect()), key=lambda a: Reader._order(*json.loads(a["first"])))
    held = spark.sparkContext.broadcast(listed)
    kind = dict(queries.dtypes)[id_col]
    # narrow rows that make much reading: as many tasks as archives, where there are queries enough
    ranges = max(1, min(len(listed), -(-queries.count() // LOOKED_UP)))
    ordered = queries.select(url_key(queries[url_col]).alias("key"), marked(queries[id_col]).alias("id")).repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id")

    def run(batches):
        reader, last, nth = Reader(folder, held.value), None, 0
        for batch in batches:
            places, ids = [], batch.column(1).to_pylist()
            for pair in zip(batch.column(0).to_pylist(), ids, strict=True):
                nth = nth + 1 if pair == last else 0
                last = pair
                places.append(reader.find(*pair, nth))
            rows = []
            for id_, r in zip(ids, reader.records(places), strict=True):
                if r is None:
                    continue
                h = r["headers"]
                kind_ = h["warc-type"]
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if kind_ == "response" and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                    raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                target = unquote(h["warc-refers-to"][len(URN) + 1 : -1]) if kind_ == "revisit" else None
                rows.append((id_, int(r["http"]["content-length"]), digest, kind_, target, r["payload"] if with_payload and kind_ == "response" else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    out = ordered.mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    back = lambda c: F.expr(f"try_cast({c} as {kind})")
    return out.select(F.when(F.col("id") != "", back("substr(id, 2)")).alias(id_col), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"), *(["payload"] if with_payload else []))


def archive(pages: DataFrame, **settings) -> DataFrame:
    """Write all pages, then read all of them back through the index."""
    spark: SparkSession = pages.sparkSession
    folder = runtime.fresh_path(spark, "warc")
    archives = write(pages, folder, **settings)
    return lookup(pages, archives, folder)
