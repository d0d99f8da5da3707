"""WARC archives: writing pages as transactions, and assembling transactions from records.

Each page becomes three records that name each other by WARC-Concurrent-To: a response (or a revisit, if another
page has the same payload and comes before it), the request, and a metadata record with the page's id. Reading back
joins request, response and metadata records through those identifiers and yields one nested row per capture.

Record ids are version 8 UUIDs made of the page id, the kind of record and a hash of url and payload: they do not
depend on where or when a record is written.

Edge cases: null html is an empty payload; null urls are written as ``about:blank`` and null page ids as no id (such
a page precedes none, and its capture has a null page_id); among equal payloads and equal ids the smaller hash comes
first; fully repeated rows make equal records and come back as often as they were written; a record whose
identifiers lead to no response is a capture without response; a very long payload is held by one task at a time, while
it is written or read; columns besides page_id, url and html, whatever their names, are not looked at; an empty table
gives an empty table. An archive that is cut off is an error; files that the manifest does not name are never opened.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import scratch, table, with_small, written
from marginalia.llm.store import content, create, dealt
from marginalia.llm.workers import lean

FILE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REQUEST, METADATA = 0, 1, 2
RECORDS = "file string, offset long, record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields string, payload binary"


def record_id(page_id: int | None, mark: int, kind: int) -> str:
    """URN of a record; mark: 64-bit hash of url and payload, of which 55 bits are used."""
    n = (page_id or 0) & (1 << 64) - 1
    low = (n & 15) << 58 | (page_id is None) << 57 | kind << 55 | mark & (1 << 55) - 1
    return f"urn:uuid:{uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | low)}"


def _record(kind: str, rid: str, block: bytes, more: dict[str, str | None]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": DATE, **more, "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    pack = zlib.compressobj(6 if len(block) > 1024 else 1, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def _one_line(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def _transaction(page_id, url, html: bytes, mark: int, first_page, first_mark) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(html).digest()).decode()
    ids = [record_id(page_id, mark, k) for k in (RESPONSE, REQUEST, METADATA)]
    uri, head = _one_line(url), f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    revisit = first_mark is not None
    common = {"WARC-Target-URI": uri}
    linked = common | {"WARC-Concurrent-To": f"<{ids[0]}>"}
    main = {**common, "WARC-Payload-Digest": digest, "Content-Type": "application/http;msgtype=response"}
    if revisit:
        main |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(first_page, first_mark, RESPONSE)}>"}
    request = f"GET {uri} HTTP/1.1\r\nAccept: */*\r\n\r\n".encode()
    fields = f"pageId: {page_id}\r\n".encode() if page_id is not None else b""
    return (
        _record("revisit" if revisit else "response", ids[0], head if revisit else head + html, main)
        + _record("request", ids[1], request, linked | {"Content-Type": "application/http;msgtype=request"})
        + _record("metadata", ids[2], fields, linked | {"Content-Type": "application/warc-fields"})
    )


def _writer(folder: str, file_bytes: int):
    def run(batches):
        own, done, out, size, n = uuid.uuid4().hex, [], None, 0, 0
        for batch in lean(batches):
            for page_id, url, html, mark, first_page, first_mark in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, size, n = f"{folder}/{own}-{len(done):04d}.warc.gz", 0, 0
                    out = create(path)
                    out.write(_record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}", b"format: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"}))
                data = _transaction(page_id, url, html or b"", mark, first_page, first_mark)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["path", "n_pages"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url, html of pages to .warc.gz files under folder; returns the manifest (path, n_pages).

    Payloads meet as digests only: they are aggregated to the first page of each digest that occurs twice or more,
    and those are joined back to the pages while these are scanned for writing."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    rows = rows.withColumn("mark", F.xxhash64("url", "sha").bitwiseAND(F.lit((1 << 55) - 1)))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "mark")
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("sha", F.col("first.page_id").alias("first_page"), F.col("first.mark").alias("first_mark")), "firsts")
    rows = with_small(rows, firsts, ["sha"])
    itself = F.col("first_mark").eqNullSafe(F.col("mark")) & F.col("first_page").eqNullSafe(F.col("page_id"))
    revisit = F.col("first_mark").isNotNull() & ~itself & (F.col("size") >= min_bytes)
    rows = rows.select("page_id", "url", "html", "mark", F.when(revisit, F.col("first_page")).alias("first_page"), F.when(revisit, F.col("first_mark")).alias("first_mark"))
    return written(rows.mapInArrow(_writer(folder, file_bytes), "path string, n_pages long"), "warc-manifest")


_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")


def _records(raw: bytes):
    """(offset, bytes) of each record of a file of gzip members, or of one that is not compressed."""
    at, step = 0, 1 << 16
    cut_off = ValueError("a record of the archive is cut off")
    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            unpack, parts, to = zlib.decompressobj(31), [], at
            while not unpack.eof and to < len(raw):
                parts.append(unpack.decompress(raw[to : to + step]))
                to += step
            if not unpack.eof:
                raise cut_off
            after = min(to, len(raw)) - len(unpack.unused_data)
            yield at, b"".join(parts)
        else:
            end = raw.find(b"\r\n\r\n", at) + 4
            length = re.search(rb"(?i)\ncontent-length:\s*(\d+)", raw[at:end])
            if end < 4 or not length or end + int(length[1]) > len(raw):
                raise cut_off
            after = end + int(length[1]) + 4
            yield at, raw[at:after]
        at = after


def parse(raw: bytes):
    """(offset, headers by lower-case name, block) of each record."""
    for at, data in _records(raw):
        end = data.find(b"\r\n\r\n") + 4
        headers: dict[str, list[str]] = {}
        for k, v in _LINE.findall(data[:end]):
            headers.setdefault(k.decode().lower(), []).append(v.decode())
        yield at, headers, data[end : end + int(headers["content-length"][0])]


def _bare(values: list[str] | None) -> list[str] | None:
    return [x.strip("<>") for x in values] if values else None


def _row(file: str, at: int, h: dict, block: bytes, payloads: bool) -> tuple:
    kind, payload, fields = h["warc-type"][0], None, None
    digest = h.get("warc-payload-digest", [None])[0]
    digest, size = digest.removeprefix("sha1:") if digest else None, None
    if kind in ("response", "revisit"):
        end = block.find(b"\r\n\r\n") + 4
        if kind == "response":
            payload = block[end:]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif m := re.search(rb"(?i)\ncontent-length:\s*(\d+)", block[:end]):
            size = int(m[1])
    elif kind == "metadata":
        fields = block.decode(errors="replace")
    refers = _bare(h.get("warc-refers-to"))
    return file, at, _bare(h["warc-record-id"])[0], kind, _bare(h.get("warc-concurrent-to")), refers and refers[0], h.get("warc-target-uri", [None])[0], h.get("warc-date", [None])[0], digest, size, fields, payload if payloads else None


def _reader(payloads: bool):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        for batch in lean(batches):
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for at, headers, block in parse(content(path)):
                    if headers["warc-type"][0] != "warcinfo":
                        rows.append(_row(path.rsplit("/", 1)[-1], at, headers, block, payloads))
                        size += len(block)
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of RECORDS per record of the files in the manifest (a table with ``path``), warcinfo aside."""
    return dealt(manifest.select("path"), manifest.count()).mapInArrow(_reader(payloads), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: root (id of its response or revisit), response, request, metadata, and how many
    of each kind there are (of several, the smallest id stands in the row).

    A record belongs to the response that its concurrent-to identifiers name, that names it, or that a record it
    names belongs to. The payload is in the nested row if records have it. Only identifiers are shuffled to find out; aggregation combines before it shuffles."""
    main = F.col("type").isin("response", "revisit")
    # an id of one response may be in many records: the responses are made distinct, then only their ids are joined
    links = records.select("record_id", F.explode("concurrent_to").alias("to"), main.alias("is_main"))
    one_way = links.select(F.when(F.col("is_main"), F.col("to")).otherwise(F.col("record_id")).alias("rid"), F.when(F.col("is_main"), F.col("record_id")).otherwise(F.col("to")).alias("to")).distinct()
    roots = records.where(main).select(F.col("record_id").alias("root")).distinct()
    tried = one_way.join(roots, F.col("to") == F.col("root"), "left")
    direct = tried.where("root IS NOT NULL").select("rid", "root")
    onward = tried.where("root IS NULL").select("rid", "to").join(direct.select(F.col("rid").alias("via"), F.col("root")), F.col("to") == F.col("via")).select("rid", "root")
    owner = direct.unionByName(onward).groupBy("rid").agg(F.min("root").alias("root"))
    owned = records.where(~main).join(owner, F.col("record_id") == F.col("rid"), "left").drop("rid").withColumn("root", F.coalesce("root", "record_id"))
    rows = records.where(main).withColumn("root", F.col("record_id")).unionByName(owned.select(*records.columns, "root"))
    part = F.struct("record_id", "type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "fields", "file", "offset", *[c for c in ("payload",) if c in records.columns])

    def first(of):
        return F.min(F.when(of, part))

    request, metadata = F.col("type") == "request", F.col("type") == "metadata"
    return rows.groupBy("root").agg(
        first(main).alias("response"), first(request).alias("request"), first(metadata).alias("metadata"),
        F.count_if(main).alias("n_responses"), F.count_if(request).alias("n_requests"), F.count_if(metadata).alias("n_metadata"),
    )


def page_ids(captures: DataFrame) -> DataFrame:
    """captures with page_id, from the fields of the metadata record, and refers_to, the page_id of the capture whose
    response the WARC-Refers-To of a revisit names (null if that is in none of the archives)."""
    page = F.regexp_extract("metadata.fields", r"pageId: (-?\d+)", 1)
    out = captures.withColumn("page_id", F.when(page != "", page.cast("long"))).withColumn("__to", F.col("response.refers_to"))
    named = out.where("__to IS NOT NULL").select(F.col("__to").alias("root")).distinct()
    named = written(out.select("root", "page_id").join(named, "root", "left_semi").select(F.col("root").alias("__to"), F.col("page_id").alias("refers_to")), "referred")
    return with_small(out, named, ["__to"]).drop("__to")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    captures = written(assemble(written(read_archives(manifest, payloads=False).drop("payload"), "records")), "captures")
    out = page_ids(captures).where("response IS NOT NULL").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_responses").cast("int"))))
    return out.select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), "refers_to",
    )


OP2_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, '0x' || sha1(body) AS hex, sha1(body) AS sha FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || substr(sha, i::INT + 1, 1))::INT), 4, '0')), 'string_agg', '') AS bits FROM h),
d AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  list_sum(list_transform(range(0, 5), lambda j: substr(bits, (5 * i + j)::INT + 1, 1)::INT * [16, 8, 4, 2, 1][j + 1]))::INT + 1, 1)), 'string_agg', '') AS payload_digest FROM b),
m AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first OR payload_bytes < {MIN_REVISIT_BYTES} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first AND payload_bytes >= {MIN_REVISIT_BYTES} THEN first END AS refers_to
FROM m
"""
