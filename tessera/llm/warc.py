"""WARC archives with revisit resolution.

Headers go first: they are shuffled by payload digest, where the smallest page id of each digest becomes the response.
The digests that occur twice or more are joined with the records, by broadcast where their number is small; beyond, by
digest, where Spark may split a hot one, as the other side is a written table. Each record becomes a WARC/1.1 response,
or a revisit that refers to the response and holds no payload.

Archives are named ``*.warc.gz``; each begins with a warcinfo record, and every record is one gzip member. A task packs its
records into archives of at most ``ARCHIVE_BYTES``, counted as they are compressed, and hands each to Spark's writer as
one row, so archives land in whatever store the path names. That writer ends a row with a separator; the last byte of a
gzip member of less than 16 MiB is always zero, so this byte serves as one, and files hold nothing but members. Archives of
other writers are read too: a task reads an archive as a stream, record by record, by the lengths that it states.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.common import map_arrow, scratch_path, table, written

#: Payloads below so many bytes are stored again rather than referred to.
LEAST_BYTES = 100
#: Most bytes of an archive, or one record; a task holds a few times as much.
ARCHIVE_BYTES = 64 << 20
#: A member of so many bytes before compression or more does not end in a zero byte.
NO_ZERO = 1 << 24
#: Up to so many repeated digests (about 200 bytes each) are broadcast.
BROADCAST_DIGESTS = 100_000
CRLF = "\r\n"
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    """A gzip member without a time, so equal data make equal members."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def originals(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, first: struct of page_id, url and date) of the payloads of (page_id, url, date, payload_bytes, digest)
    that occur more than once: the record with the smallest page id.

    Counted map-side, so a payload that a third of all pages share is one row a task. A null page id is no response to
    refer to; a digest with such ids only has no first.
    """
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date")))
    g = heads.filter(F.col("payload_bytes") >= least).groupBy(F.col("digest").alias("of_digest")).agg(first.alias("first"), F.count("*").alias("n"))
    return g.filter("n > 1 and first is not null").drop("n")


def resolved(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``records`` (page_id, url, date, payload_bytes, digest, ...) with refers: the first record of the same payload for
    revisits, else null. A row that repeats the response's page id and payload is a response as well."""
    first = written(originals(records, least), "warc-originals")
    side = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    out = records.join(side, (F.col("digest") == F.col("of_digest")) & (F.col("payload_bytes") >= least), "left")
    again = F.col("page_id").isNull() | (F.col("first.page_id") < F.col("page_id"))
    return out.withColumn("refers", F.when(again, F.col("first"))).drop("of_digest", "first")


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page, F.lit(">"))


def one_line(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")


def record() -> Column:
    """The text of a record without its closing line breaks, from page_id, url, date, html, payload_bytes, digest, refers."""
    revisit = F.col("refers").isNotNull()
    # a page without an id gets one for its record; the reader knows it by the word
    own = F.coalesce(F.col("page_id").cast("string"), F.concat_ws(":", F.lit("none"), "digest", F.monotonically_increasing_id().cast("string")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    refers = F.concat(
        line("WARC-Refers-To", record_id(F.col("refers.page_id").cast("string"))),
        line("WARC-Refers-To-Target-URI", one_line(F.col("refers.url"))),
        line("WARC-Refers-To-Date", F.col("refers.date")),
        line("WARC-Profile", F.lit(PROFILE)),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(own)),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("html")))


def information(date: str, kind: str = "warcinfo") -> bytes:
    """A record about the archive, with its closing line breaks."""
    block = f"software: tessera{CRLF}format: WARC File Format 1.1{CRLF}".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(lines).encode() + block + (CRLF * 2).encode()


def packed(records, most: int, date: str):
    """Archives, each of at most ``most`` bytes or of one record, from the records (bytes) of a task in order.

    An archive never ends in a record of 16 MiB or more: a small metadata record follows that one.
    """
    parts: list[bytes] = []
    size = 0
    for record in records:
        made = member(record)
        if len(record) >= NO_ZERO:
            made += member(information(date, "metadata"))
        if parts and size + len(made) > most and len(parts) > 1:
            yield b"".join(parts)
            parts, size = [], 0
        if not parts:
            parts = [member(information(date))]
            size = len(parts[0])
        parts.append(made)
        size += len(made)
    if parts:
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, date: str | None = None, date_col: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record a row of ``pages`` (page_id, url, html) as WARC files under ``path``, a new folder that appears whole.

    Null html: an empty payload; null url: an empty target. Payloads under ``LEAST_BYTES`` are always responses. A row
    with a null page_id is a revisit where a page with an id has its payload, else a response. Dates are those of
    ``date_col``, ISO strings, and ``date`` where null or without one, by default the time of writing. An empty table
    writes no archive; extra columns are ignored.
    """
    spark = pages.sparkSession
    if scratch.exists(spark, path):
        raise ValueError(f"{path} exists")
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    when = F.lit(date) if date_col is None else F.coalesce(F.col(date_col), F.lit(date))
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", when.alias("date"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("digest"))
    rows = resolved(own).select(F.concat(record(), F.lit(CRLF * 2)).alias("value"))

    def archives(batches):
        import pyarrow as pa

        records = (v.as_py().encode() for batch in batches for v in batch.column(0))
        for data in packed(records, archive_bytes, date):
            yield pa.RecordBatch.from_arrays([pa.array([memoryview(data)[:-1]], pa.binary())], names=["value"])  # the writer adds the zero

    made = map_arrow(rows, archives, "value binary").select(F.col("value").cast("string").alias("value"))
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    made.write.option("lineSep", "\0").option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(staging)
    named(spark, staging)
    scratch.move(spark, staging, path)


def named(spark, folder: str) -> None:
    """Gives the files of a folder the names of archives, and deletes empty ones; only names pass the driver."""
    n = 0
    for name, size in scratch.files(spark, folder):
        if name.startswith("part-"):
            if size:
                scratch.move(spark, f"{folder}/{name}", f"{folder}/tessera-{n:08d}.warc.gz")
                n += 1
            else:
                scratch.delete(spark, f"{folder}/{name}")


def headers_of(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError(f"no header of a record: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


BEGINS = b"\r\n\r\nWARC/1."


def parse(pieces):
    """(headers, block) of each record of an archive, from its bytes cut at ``BEGINS``, in order; names in lower case.

    Where a block holds that text itself, its length tells to read on. Line breaks behind a record are left out.
    """
    held, missing = [], 0
    for nth, piece in enumerate(pieces):
        if held:
            held.append(piece)
            missing -= len(BEGINS) + len(piece)
            if missing > 0:
                continue
        record = BEGINS.join(held) if held else piece if nth == 0 else b"WARC/1." + piece
        held = []
        if not record.strip(b"\r\n"):
            continue
        head, _, rest = record.partition(b"\r\n\r\n")
        first, _, lines = head.partition(b"\r\n")
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no record where one should begin: {record[:60]!r}")
        headers = headers_of(lines)
        size = int(headers["content-length"])
        if len(rest) < size:
            held, missing = [record], size - len(rest)
            continue
        if rest[size:].strip(b"\r\n"):
            raise ValueError(f"record {headers.get('warc-record-id')} is longer than it says")
        yield headers, rest[:size]
    if held:
        raise ValueError("an archive ends inside a record")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, target_uri string, date string, refers_to_id string"


def _number(urn: str | None) -> int | None:
    """The page id of a record's name; null for a page without one, and for names of other writers."""
    own = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(own) if own.removeprefix("-").isdigit() else None


def agrees(payload: bytes, stated: str) -> bool:
    """Whether a payload has the stated digest; kinds that are not known agree."""
    kind, _, value = stated.partition(":")
    if kind.lower() == "sha256":
        return hashlib.sha256(payload).hexdigest() == value.lower()
    if kind.lower() == "sha1":
        own = hashlib.sha1(payload)
        return value.upper() == base64.b32encode(own.digest()).decode() or value.lower() == own.hexdigest()
    return True


def row_of(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A row of ``READ`` from a response, resource or revisit record."""
    kind, stated = headers["warc-type"], headers.get("warc-payload-digest", "")
    http, has_head, payload = block.partition(b"\r\n\r\n")
    if kind == "resource" or not headers.get("content-type", "application/http").startswith("application/http"):
        http, payload = b"", block
    lengths = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":", 1)[1].strip().isdigit()]
    if kind == "revisit":
        size, digest = lengths[-1] if lengths else None, stated.removeprefix("sha256:") or None
    else:
        own = bool(lengths) and (headers.get("warc-record-id") or "").startswith("<urn:page:")
        if not agrees(payload, stated) or (own and lengths[-1] != len(payload)):
            raise ValueError(f"payload of {headers.get('warc-record-id')} is damaged")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    refers = headers.get("warc-refers-to") if kind == "revisit" else None
    name = headers.get("warc-record-id")
    return _number(name), size, digest, kind, _number(refers), payload if payloads and kind != "revisit" else None, name, headers.get("warc-target-uri"), headers.get("warc-date"), refers


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """The response, resource and revisit records of the archives ``*.warc.gz`` under ``path``, of this writer or of others.

    A payload is what follows the HTTP headers, as it stands; it is null for revisits and unless asked for. It is digested
    by SHA-256; where the record states a digest that it does not have, the read fails. Records of other writers have no
    page_id; the digest of a revisit is then the stated one, with the name of its kind unless that is SHA-256.
    """
    raw = spark.read.option("lineSep", BEGINS.decode()).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*.warc.gz").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        import itertools

        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string())
        names = [c.split()[0] for c in READ.split(", ")]
        pieces = ((f, v.as_py()) for batch in batches for f, v in zip(batch.column(0).to_pylist(), batch.column(1)))
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for _, own in itertools.groupby(pieces, lambda x: x[0]):  # a compressed file is read by one task, in order
            for headers, block in parse(v for _, v in own):
                if headers.get("warc-type") in ("response", "resource", "revisit"):
                    rows.append(row_of(headers, block, payloads))
                    size += len(block) if payloads else 200
                    if size > 8 << 20:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    return map_arrow(raw, run, READ)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d AND payload_bytes >= {LEAST_BYTES}
"""
