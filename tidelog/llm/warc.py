"""WARC archives: a writer with revisit records and a splittable reader.

The writer finds equal payloads by narrow rows (digest, page_id) and never shuffles a payload to do so: the pages whose payload
repeats one are known from a broadcast table of digests or, beyond BROADCAST_GROUPS of them, from a join on
the rows' places. Each task writes files of its own in a shared folder, one gzip member a record; a manifest lists the
files of the attempts that succeeded. The reader deals out byte ranges of the files. A task scans its range for gzip's
magic number, takes a place for a record only if the member decodes to a WARC header, and owns the records that
start inside its range, wherever they end; after a record it goes on right behind it. What lies inside a record of an
earlier range (a payload that is an archive itself) is no record of its own. So ranges of any size give every record exactly once.

Defined results: a null payload counts as empty; a null or empty target becomes the record's own id; of equal payloads of at
least MIN_REVISIT bytes those with the largest page_id are responses (repeated rows all of them, a null
page_id being smaller than any other) and the rest revisits; an empty table gives no records; bytes that are no
whole record are passed over. Payloads and headers may have any length: both sides work through them in blocks.
Columns of the pages beyond those named have no effect, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keep, shared_dir
from tidelog.llm.exact_dedup import located

MIN_REVISIT = 1000
MAX_FILE = 1 << 30
SPLIT = 32 << 20
MAX_TASKS = 50_000
BLOCK = 1 << 20
#: Digests of repeated payloads that are broadcast (40 bytes each).
BROADCAST_GROUPS = 100_000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, bytes long, records long"
RECORDS = "path string, offset long, length long, type string, record_id string, target string, refers_to string, headers map<string,string>, payload_bytes long, payload_digest string"


def member_parts(headers: list[tuple[str, str]], *blocks) -> Iterator[bytes]:
    """One record as a gzip member of its own, piece by piece. Blocks are bytes or buffers."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {sum(map(len, blocks))}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    yield pack.compress("\r\n".join(lines).encode() + END)
    for block in (*blocks, END):
        view = memoryview(block)
        for i in range(0, len(view), BLOCK):
            yield pack.compress(view[i : i + BLOCK])
    yield pack.flush()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"".join(member_parts(headers, block))


def page_parts(page_id: int | None, url: str | None, payload, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """A page's response record or, with refers_to, its revisit record: HTTP headers without the payload."""
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none:{digest}>"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe=PRINTABLE) if url else name[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member_parts(headers, http, *(() if refers_to is not None else (payload,)))


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    return b"".join(page_parts(page_id, url, payload, digest, refers_to))


def referring(spark: SparkSession, pages: DataFrame, columns: list[Column], folder: str, most: int = BROADCAST_GROUPS) -> DataFrame:
    """`columns` of the pages (page_id, url, payload) with refers_to, the page whose payload a page repeats."""
    same = F.unhex(F.sha2("payload", 256))
    large = F.length("payload") >= MIN_REVISIT
    rows = pages.select(*columns)
    groups = rows.filter(large).select(same.alias("same"), "page_id").groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    groups = keep(spark, groups.filter("n > 1 AND first IS NOT NULL").drop("n"), f"{folder}-groups")
    if groups.count() <= most:
        rows = rows.withColumn("same", F.when(large, same)).join(F.broadcast(groups), "same", "left")
        return rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    # Too many to broadcast: narrow rows find what they refer to, and the payloads meet that by their place, of which each is unique.
    rows = located(spark, rows, f"{folder}-pages")
    revisits = rows.filter(large).select(same.alias("same"), "page_id", "__file", "__row").join(groups, "same")
    revisits = revisits.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("__file", "__row", F.col("first").alias("refers_to"))
    return rows.join(revisits, ["__file", "__row"], "left").select("page_id", "url", "payload", "refers_to")


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", max_file: int = MAX_FILE, most: int = BROADCAST_GROUPS) -> DataFrame:
    """Writes a record for each page to files in `folder`; the MANIFEST of these files."""
    columns = [F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload")]
    rows = referring(spark, pages, columns, folder, most).withColumn("digest", F.sha1("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

        for batch in batches:
            ids, urls, payloads, refers, digests = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size, count = len(info), 0
                # The payload is a view of the batch, which Spark bounds in bytes; only compressed pieces are made.
                for raw in page_parts(ids[i].as_py(), urls[i].as_py(), payloads[i].as_buffer(), digests[i].as_py(), refers[i].as_py()):
                    out.write(raw)
                    size += len(raw)
                count += 1
                if size >= max_file:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return keep(spark, rows.mapInArrow(run, MANIFEST), f"{folder}-manifest")


class Window:
    """The bytes of a file, one block of which is held."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def get(self, at: int, n: int = BLOCK, least: int = 1) -> bytes:
        """Up to n bytes from `at` on, and `least` of them unless the file ends before."""
        if at >= self.size:
            return b""
        if not self.base <= at <= self.base + len(self.data) - least:
            self.file.seek(at)
            self.base, self.data = at, self.file.read(BLOCK)
        return self.data[at - self.base : at - self.base + n]

    def find(self, at: int, stop: int) -> int | None:
        """The first place of gzip's magic number in [at, stop)."""
        while at < stop:
            block = self.get(at, least=len(MAGIC))
            found = block.find(MAGIC)
            if found >= 0:
                return at + found if at + found < stop else None
            if len(block) < len(MAGIC):
                return None
            at += len(block) - len(MAGIC) + 1
        return None


def fields(head: bytes) -> dict[str, str]:
    """Header lines behind the first one, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


class Body:
    """Takes a record's block as it is decompressed: its length and, of a response, the payload's length and digest, and the payload if wanted."""

    def __init__(self, headers: dict[str, str], payload: bool) -> None:
        self.kind = headers.get("warc-type")
        self.http, self.inside = bytearray(), False
        self.length, self.sha, self.parts = 0, hashlib.sha1(), [] if payload else None

    def feed(self, data: bytes) -> None:
        if self.kind not in ("response", "revisit"):
            return
        if not self.inside:
            known = len(self.http)
            self.http += data
            cut = self.http.find(END, max(0, known - len(END) + 1))
            if cut < 0:
                return
            data, self.inside = bytes(self.http[cut + len(END) :]), True
            del self.http[cut:]
        self.length += len(data)
        self.sha.update(data)
        if self.parts is not None and data:
            self.parts.append(data)


def decode(source: Window, offset: int, payload: bool = False) -> tuple[dict[str, str], Body, int] | None:
    """Headers, body and end of the record at `offset`; None if there is none."""
    unpack, at, head, body, left = zlib.decompressobj(31), offset, bytearray(), None, 0
    try:
        while not unpack.eof:
            piece = unpack.unconsumed_tail
            if not piece:
                piece = source.get(at, 1 << 14 if body is None else BLOCK)
                at += len(piece)
                if not piece:
                    return None
            data = unpack.decompress(piece, BLOCK)
            if body is None:
                known = len(head)
                head += data
                if not head.startswith(VERSION[: len(head)]):
                    return None
                cut = head.find(END, max(0, known - len(END) + 1))
                if cut < 0:
                    continue
                headers = fields(bytes(head[:cut]))
                length = headers.get("content-length", "")
                if not length.isdigit():
                    return None
                body, left, data = Body(headers, payload), int(length), bytes(head[cut + len(END) :])
            body.feed(data[:left])
            left -= min(left, len(data))
    except zlib.error:
        return None
    if body is None or left:
        return None
    return headers, body, at - len(unpack.unused_data)


def records(file: pa.NativeFile, start: int, stop: int, payload: bool = False) -> Iterator[tuple[int, int, dict[str, str], Body]]:
    """(offset, end, headers, body) of the records that start in [start, stop)."""
    source, at = Window(file), start
    while (offset := source.find(at, stop)) is not None:
        record = decode(source, offset, payload)
        if record is None:
            at = offset + 1
            continue
        headers, body, at = record
        yield offset, at, headers, body


def described(path: str, start: int, offset: int, end: int, headers: dict[str, str], body: Body) -> dict:
    """A row of RECORDS. The length and digest of a response's payload are taken from its bytes, a revisit's from its headers."""
    length = digest = None
    stated = headers.get("warc-payload-digest", "").partition(":")[2]
    if body.kind == "response":
        length, digest = body.length, body.sha.hexdigest()
        if stated and len(stated) == 40 and stated != digest:
            raise ValueError(f"{path} at {offset}: the payload's digest is {digest}, not {stated}")
    elif body.kind == "revisit":
        length, digest = int(fields(bytes(body.http)).get("content-length", 0)), stated
    row = {"path": path, "start": start, "offset": offset, "length": end - offset, "type": body.kind, "record_id": headers.get("warc-record-id"), "target": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "headers": list(headers.items()), "payload_bytes": length, "payload_digest": digest}
    return row if body.parts is None else row | {"payload": b"".join(body.parts) if body.kind == "response" else None}


def outermost(raw: DataFrame, split: int) -> DataFrame:
    """`raw` without the records that lie inside one which starts in an earlier range. Such a record tells every range that it reaches
    into where it ends."""
    end = F.col("offset") + F.col("length")
    over = raw.filter(end > F.col("start") + split).select("path", F.explode(F.sequence(F.col("start") + split, end - 1, F.lit(split).cast("long"))).alias("start"), end.alias("end"))
    limits = over.groupBy("path", "start").agg(F.max("end").alias("limit"))
    return raw.join(limits, ["path", "start"], "left").filter(F.col("offset") >= F.coalesce("limit", F.lit(0))).select(*(c for c in raw.columns if c != "start"))


def read_archives(spark: SparkSession, manifest: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """The RECORDS of the files in `manifest` (path, bytes), with their payloads if wanted."""
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / F.lit(split)))).first()[0] or 1
    ranges = manifest.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.repartition(int(min(tasks, MAX_TASKS)))
    text = [pa.field(n, pa.string()) for n in ("type", "record_id", "target", "refers_to")]
    schema = pa.schema([pa.field("path", pa.string()), *(pa.field(n, pa.int64()) for n in ("start", "offset", "length")), *text, pa.field("headers", pa.map_(pa.string(), pa.string())), pa.field("payload_bytes", pa.int64()), pa.field("payload_digest", pa.string()), *([pa.field("payload", pa.binary())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    for offset, end, headers, body in records(file, row["start"], row["start"] + split, payload):
                        rows.append(described(row["path"], row["start"], offset, end, headers, body))
                        held += body.length if payload else 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    raw = keep(spark, ranges.mapInArrow(run, RECORDS.replace("offset", "start long, offset", 1) + ", payload binary" * payload), f"{shared_dir(spark)}/raw")
    return outermost(raw, split)


def whole(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """`found`, the records read without the warcinfo ones, if they are as many as the manifest has; else an error."""
    written, read = manifest.agg(F.sum("records")).first()[0] or 0, found.count()
    if read != written:
        raise ValueError(f"{read} records were read, {written} written")
    return found


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_dir(spark)
    manifest = write_archives(spark, pages, f"{path}/warc")
    found = read_archives(spark, manifest, payload=False).filter("type <> 'warcinfo'")
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    found = found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    return whole(manifest, found)


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS m FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
  CASE WHEN octet_length(b) < 1000 OR m IS NULL OR page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN octet_length(b) < 1000 OR m IS NULL OR page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to
FROM g
"""
