"""Operator 12, WARC archives: a writer that stores equal payloads once, and a salvage reader.

Writing. Each page is a record, its payload the html in UTF-8. Digests and lengths of all payloads are taken first; of
the records with equal payloads of MIN_REVISIT bytes or more, that with the largest page_id (then url) is the response,
and the others are revisits of it, which hold HTTP headers but no payload. So revisits are written from the table of
digests alone, and leave the stream of payloads by an anti join, which moves payloads only where there are too many
revisits to broadcast (Spark decides by the written table's size). Every task compresses each record as a gzip member of its
own, and begins another archive when one has ARCHIVE_BYTES. It names its archives anew on every attempt and returns a row
for each: the written table of these rows, not the folder, says which files belong to the archive, so that what lost or
repeated attempts leave behind is never read.

Reading. A task streams through an archive, compressed by member or plain. At each place it checks the member (its own
checksum and length) and the records in it (version line, header fields, Content-Length, closing blank lines, block
digest). Where a check fails, it searches on for the next gzip magic or version line from which everything checks, goes
on there, and logs the bytes between as a gap with the reason: later records are recovered, and no damaged byte passes for
a record. What is good and what is a gap cover each file without overlap. Not more than a record and a window is held.

A null html is an empty payload. Urls are written percent-encoded where they hold other than printable ASCII; a null url
is `about:blank`. Null page_ids are the smallest; rows that share a page_id are records of their own, and of rows that are
equal in page_id, url and a long enough html one at most is the response. Equal payloads are equal in SHA-1 and length. An
empty table gives no archive and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, slices

MIN_REVISIT, ARCHIVE_BYTES = 1000, 64 << 20
#: Bytes read at a time, and those that a member is first tried with.
WINDOW, FIRST = 1 << 20, 1 << 13
#: Header lines of a record may take so many bytes.
MAX_HEADER = 1 << 16
DATE = "1970-01-01T00:00:00Z"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_CANDIDATE = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
_ENCODED = re.compile(rb"[^\x21-\x7e]")

MANIFEST = "path string, records long, bytes long"
READ = "kind string, path string, offset long, length long, reason string, type string, record_id string, page_id long, refers_to string, refers_to_page long, url string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*keys) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(keys).encode('utf-8', 'surrogatepass')).digest(), version=4)}>"


def encoded(url: str | None) -> str:
    return _ENCODED.sub(lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode("utf-8", "surrogatepass")).decode()


def record(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record; fields without value are left out."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", base32_sha1(block)), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def page_record(name: str, page_id: int | None, url: str | None, digest: str, n_bytes: int, payload: bytes | None, to: tuple | None = None) -> bytes:
    """A response with its payload, or where to (its record's name, page_id, url) is given a revisit without."""
    fields = [("WARC-Target-URI", encoded(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
    if to is None:
        return record("response", name, fields, http_head(n_bytes) + payload)
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", to[0]), ("WARC-Refers-To-Target-URI", encoded(to[2])), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-ID", to[1])]
    return record("revisit", name, [*fields, *more], http_head(n_bytes))


def payloads_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, n_bytes, payload) of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"), "payload")


def shared_payloads(rows: DataFrame, least: int) -> DataFrame:
    """(page_id, url, digest, n_bytes, n, to, own): the distinct records whose payload of at least `least` bytes occurs more
    than once, how many rows each is, the record (page_id, url) that they revisit, and whether it is that.

    A payload of very many records is one row on the right side of the join, and its left rows are split by Spark's skew join.
    """
    index = materialize(rows.groupBy("page_id", "url", "digest", "n_bytes").agg(F.count("*").alias("n")), "payloads")
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "url")).alias("last")
    shared = index.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(last, F.sum("n").alias("all")).where("all > 1")
    marked = index.join(shared, ["digest", "n_bytes"]).withColumn("to", F.struct("last.page_id", "last.url"))
    return marked.select("page_id", "url", "digest", "n_bytes", "n", "to", F.expr("page_id <=> to.page_id and url <=> to.url").alias("own"))


#: Copies of one record that a task writes at a time.
COPIES = 1024


def records_of(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, digest, n_bytes, payload, to, copy) of every page; to is null for responses, payload for revisits."""
    rows = payloads_of(pages)
    shared = materialize(shared_payloads(rows, least), "shared-payloads")
    copies = F.col("n") - F.col("own").cast("int")
    begin = shared.where(copies > 0).withColumns({"copies": copies, "begin": F.explode(F.sequence(F.lit(0).cast("long"), copies - 1, F.lit(COPIES).cast("long")))})
    spread = begin.repartition("page_id", "url", "begin")  # ranges of copies, not copies
    no_payload, copy = F.lit(None).cast("binary").alias("payload"), F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + COPIES, F.col("copies")) - 1)).alias("copy")
    revisits = spread.select("page_id", "url", "digest", "n_bytes", no_payload, "to", copy)
    same, key = F.expr("a.page_id <=> b.page_id and a.url <=> b.url and a.digest = b.digest"), ["page_id", "url", "digest"]
    gone, repeated = shared.where(copies > 0).select(key).alias("b"), shared.where("own and n > 1").select(key).alias("b")
    alone = rows.alias("a").join(gone, same, "left_anti").select(rows.columns)
    once = rows.alias("a").join(repeated, same, "left_semi").groupBy(*key, "n_bytes").agg(F.first("payload").alias("payload"))
    to = F.lit(None).cast(shared.schema["to"].dataType).alias("to")
    return alone.unionByName(once).select("*", to, F.lit(None).cast("long").alias("copy")).unionByName(revisits)


def write_archives(pages: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES, least: int = MIN_REVISIT) -> DataFrame:
    """Writes pages as archives under out, and gives back their manifest (path, records, bytes), a table under out."""
    folder = f"{out}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        task, number, file, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, [0, 0]

        def close():
            file.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{task}-{number}.warc.gz", "records": done[0], "bytes": done[1]}], schema=_MANIFEST)

        for some in slices(batches):
            for page_id, url, digest, n_bytes, payload, to, copy in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if file is None:
                    store.create_dir(base, recursive=True)
                    file, done = store.open_output_stream(f"{base}/{task}-{number}.warc.gz", compression=None), [0, 0]
                    file.write(member(record("warcinfo", record_id(task, number), [("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n")))
                if to is None:  # one that others may refer to is named by what it is, others by where they are
                    name = record_id(page_id, url, digest) if n_bytes >= least else record_id(task, number, done[0])
                    data = page_record(name, page_id, url, digest, n_bytes, payload)
                else:
                    name = record_id(to["page_id"], to["url"], digest)
                    data = page_record(record_id(page_id, url, digest, copy), page_id, url, digest, n_bytes, None, (name, to["page_id"], to["url"]))
                data = member(data)
                file.write(data)
                done[0], done[1] = done[0] + 1, done[1] + len(data)
                if done[1] >= archive_bytes:
                    yield close()
                    file, number = None, number + 1
        if file is not None:
            yield close()

    records_of(pages, least).mapInArrow(run, MANIFEST).write.parquet(f"{out}/manifest")
    return read_manifest(pages.sparkSession, out)


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


class Damaged(Exception):
    """A check that failed; its text is the reason."""


class Window:
    """A file of which a stretch is held: bytes from any place on, read forward in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from place on, fewer only at the file's end."""
        n = min(n, self.size - place)
        if place < self.start or place > self.start + len(self.held):
            self.start, self.held = place, b""
        if place + n > self.start + len(self.held):
            self.held = self.held[place - self.start :]
            self.start = place
            self.file.seek(place + len(self.held))
            self.held += self.file.read(max(n - len(self.held), WINDOW))
        return self.held[place - self.start : place - self.start + n]


class Record(NamedTuple):
    fields: dict[str, str]
    block: bytes


def parse(data: bytes, place: int = 0) -> tuple[Record, int]:
    """The record at a place of data and where it ends. Damaged(`short`) where data ends before it does."""
    head_end = data.find(b"\r\n\r\n", place, place + MAX_HEADER)
    if head_end < 0:
        raise Damaged("short" if len(data) - place < MAX_HEADER else "header without end")
    lines = data[place:head_end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        raise Damaged("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    if not (fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit()) or "warc-type" not in fields:
        raise Damaged("no length or type")
    begin, end = head_end + 4, head_end + 4 + int(fields["content-length"])
    if len(data) < end + 4:
        raise Damaged("short")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no blank lines after the block")
    block = data[begin:end]
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want != base32_sha1(block):
        raise Damaged("block digest")
    return Record(fields, block), end + 4


def member_at(window: Window, place: int) -> tuple[bytes, int]:
    """What the gzip member at place holds, and where it ends; zlib checks its checksum and length."""
    unpack, out, at, step = zlib.decompressobj(31), [], place, FIRST
    while not unpack.eof:
        piece = window.at(at, step)
        if not piece:
            raise Damaged("member cut off")
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"member: {str(e).partition(': ')[2] or e}") from None
        at, step = at + len(piece), min(2 * step, WINDOW)
    return b"".join(out), at - len(unpack.unused_data)


def records_at(window: Window, place: int) -> tuple[list[Record], int]:
    """The records of the member at place, or the plain one there, and where it ends. All checks hold, or Damaged is raised."""
    head = window.at(place, len(VERSION))
    if head.startswith(MAGIC):
        data, end = member_at(window, place)
        got, at = [], 0
        while at < len(data):
            try:
                one, at = parse(data, at)
            except Damaged as e:
                raise Damaged("record cut off" if str(e) == "short" else str(e)) from None
            got.append(one)
        return got, end
    if head != VERSION:
        raise Damaged("neither member nor version line")
    n = FIRST
    while True:
        data = window.at(place, n)
        try:
            one, end = parse(data)
            return [one], place + end
        except Damaged as e:
            if str(e) != "short":
                raise
            if len(data) < n:
                raise Damaged("record cut off") from None
            head_end = data.find(b"\r\n\r\n")
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\r\n", data[: head_end + 4]) if head_end >= 0 else None
            need = head_end + 8 + int(length[1]) if length else 2 * n
            if place + need > window.size and length:
                raise Damaged("record cut off") from None
            n = max(need, n + 1)


def next_valid(window: Window, look: int) -> int:
    """The next place from which a member or plain record checks, or the file's end."""
    while look < window.size:
        piece = window.at(look, WINDOW)
        for m in _CANDIDATE.finditer(piece):
            try:
                records_at(window, look + m.start())
                return look + m.start()
            except Damaged:
                continue
        look += max(len(piece) - len(VERSION) + 1, 1)
    return window.size


def salvage(file, size: int) -> Iterator[tuple]:
    """("record", offset, length, Record) and ("gap", offset, length, reason), in the file's order, over all its bytes."""
    window, place = Window(file, size), 0
    while place < size:
        try:
            got, end = records_at(window, place)
        except Damaged as e:
            reason, begin = str(e), place
            place = next_valid(window, begin + 1)
            yield "gap", begin, place - begin, reason
            continue
        for one in got:
            yield "record", place, end - place, one
        place = end


def _long(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,18}", text) else None


def _hex(digest: str | None) -> str | None:
    try:
        return base64.b32decode(digest.removeprefix("sha1:")).hex() if digest and digest.startswith("sha1:") else None
    except ValueError:
        return None


def read_archives(archives: DataFrame, payloads: bool = True, strict: bool = False) -> DataFrame:
    """(kind, path, offset, length, reason, type, record_id, page_id, refers_to, refers_to_page, url, payload_digest,
    payload_bytes, payload): the records and gaps of the files in archives' column path.

    Digest and length of a response's payload are taken from the payload that was read; a revisit's from its headers.
    offset and length are the member's. Without payloads that column is null. A strict reader takes a gap for an error.
    """
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in READ.split(", "))])

    def row(path, kind, offset, length, what):
        out = {"kind": kind, "path": path, "offset": offset, "length": length}
        if kind == "gap":
            return out | {"reason": what}
        f, (head, _, payload) = what.fields, what.block.partition(b"\r\n\r\n")
        out |= {"type": f["warc-type"], "record_id": f.get("warc-record-id"), "page_id": _long(f.get("page-id")), "refers_to": f.get("warc-refers-to"), "refers_to_page": _long(f.get("refers-to-page-id")), "url": f.get("warc-target-uri")}
        if f["warc-type"] == "response":
            out |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload if payloads else None}
        elif f["warc-type"] == "revisit":
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
            out |= {"payload_digest": _hex(f.get("warc-payload-digest")), "payload_bytes": int(length[1]) if length else None}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    some, held = [], 0
                    for found in salvage(file, file.size()):
                        if strict and found[0] == "gap":
                            raise Damaged(f"{path}, bytes {found[1]} to {found[1] + found[2]}: {found[3]}")
                        some.append(row(path, *found))
                        held += len(some[-1].get("payload") or b"") + 256
                        if held >= WINDOW:
                            yield pa.RecordBatch.from_pylist(some, schema=schema)
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)

    n = max(archives.count(), archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("path").repartition(min(n, 100_000), "path").mapInArrow(run, READ)


def archive_and_read(pages: DataFrame, out: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from the archives that were written."""
    manifest = write_archives(pages, out or new_path(pages.sparkSession, "warc"))
    rows = read_archives(manifest, payloads=False, strict=True).where("kind = 'record' and type in ('response', 'revisit')")
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


#: The same in DuckDB's SQL.
ORACLE_SQL = """
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < last then last end as refers_to
from (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest, max(page_id) over (partition by h) as last
  from (select page_id, coalesce(html, '') as h from pages))
"""
