"""Operator 11, legacy archive converter: ARC files of either version to WARC, and readers and writers of both.

An ARC file begins with a ``filedesc://`` record, whose block gives the version and names the fields of the header lines that follow; a
header line ends with the declared length of its block. The converter walks from header to header by these lengths and synthesises what
WARC has besides: a record identifier (a name-based UUID of archive and offset, so a task that runs again gives the same), an ISO timestamp,
the type and the digests of block and payload. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes one stays a response, the
others become revisits that refer to it.

Archives are gzip files in any folder Spark reads. gzip isn't split, so one task reads a file from end to end as lines and holds one record
at a time; files of concatenated members are read too. An archive that isn't compressed is handed to a task whole.
"""

from __future__ import annotations

import io
import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, few, join_groups, keep, read, shared_dir, small_batches

#: Smaller payloads are never revisits.
REVISIT_BYTES = 100

# Fields of a header line by version of the archive (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL, NO_DATE = "unknown:", "19700101000000"
RECORDS = "archive string, offset bigint, version int, url string, ip string, date string, mime string, head binary, payload binary, problem string"
WARC_RECORDS = "archive string, type string, record_id string, date string, uri string, refers_to string, payload_digest string, head binary, payload binary, problem string"


class Lines:
    """The bytes of one file, given as an iterator of its lines with their line feeds."""

    def __init__(self, lines: Iterator[bytes]):
        self._lines, self._rest, self.at = lines, b"", 0

    def readline(self) -> bytes:
        cut = self._rest.find(b"\n") + 1
        if cut:
            line, self._rest = self._rest[:cut], self._rest[cut:]
        else:
            line, self._rest = self._rest + next(self._lines, b""), b""
        self.at += len(line)
        return line

    def read(self, n: int) -> bytes:
        parts, have = [self._rest], len(self._rest)
        while have < n and (line := next(self._lines, b"")):
            parts.append(line)
            have += len(line)
        whole = b"".join(parts)
        out, self._rest = whole[:n], whole[n:]
        self.at += len(out)
        return out


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the empty line that ends it) and payload of an HTTP message; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def arc_records(f: Lines, archive: str) -> Iterator[tuple]:
    """Rows of ``RECORDS`` of one archive. A version block may stand anywhere, as in archives put together from several. Lines where a header
    is due that are none are passed over and given out together as one row with the problem ``header``; a block that the file cuts off has
    the problem ``short``."""
    version, fields, junk, junk_at = 1, len(ARC_FIELDS[1].split()), [], 0

    def passed() -> Iterator[tuple]:
        if junk:
            yield archive, junk_at, version, None, None, None, None, b"", b"".join(junk), "header"
            junk.clear()

    while line := (start := f.at, f.readline())[1]:
        if not line.strip():
            continue
        opens = line.startswith(b"filedesc://")
        for n in (len(ARC_FIELDS[1].split()), len(ARC_FIELDS[2].split())) if opens else (fields,):
            parts = line.strip().rsplit(b" ", n - 1)
            ok = len(parts) == n and re.fullmatch(rb"\d+", parts[-1]) and re.fullmatch(rb"\d{8,14}", parts[2])
            if ok:
                break
        if not ok:
            junk_at = junk_at if junk else start
            junk.append(line)
            continue
        yield from passed()
        size = int(parts[-1])
        block = f.read(size)
        if opens:
            said = block.split(b"\n")
            version = 2 if said[0].startswith(b"2") else 1
            fields = len(said[1].split()) if len(said) > 1 and said[1].startswith(b"URL ") else len(ARC_FIELDS[version].split())
        head, payload = (b"", block) if opens else split_http(block)
        yield archive, start, version, _text(parts[0]), _text(parts[1]), _text(parts[2]), _text(parts[3]), head, payload, None if len(block) == size else "short"
    yield from passed()


def warc_records(f: Lines, archive: str) -> Iterator[tuple]:
    """Rows of ``WARC_RECORDS`` of one archive; header names are taken in any case, folded lines joined. Lines where a record is due that don't
    begin one are passed over; a block that the file cuts off has the problem ``short``."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        last = ""
        while (line := f.readline()).strip():
            if line[:1] in b" \t" and last:
                fields[last] += " " + _text(line.strip())
            else:
                name, _, value = line.partition(b":")
                last = _text(name).strip().lower()
                fields[last] = _text(value.strip())
        said = fields.get("content-length", "")
        size = int(said) if said.isdigit() else 0
        block = f.read(size)
        kind = fields.get("warc-type")
        head, payload = split_http(block) if kind in ("response", "revisit") else (b"", block)
        yield (archive, kind, fields.get("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
               fields.get("warc-payload-digest"), head, payload, None if said.isdigit() and len(block) == size else "short")


def _read(spark: SparkSession, path: str, parse: Callable[[Lines, str], Iterator[tuple]], schema: str) -> DataFrame:
    small_batches(spark)
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

    def give(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for r in found:
            part.append(r)
            size += len(r[-2]) + len(r[-3])
            if size >= 1 << 23 or len(part) >= 2000:
                yield batch(part)
                part, size = [], 0
        if part:
            yield batch(part)

    def batch(part: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(zip(*part), schema.split(", "))], names)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = itertools.groupby(rows(batches), key=lambda r: r[0])
        yield from give(r for name, own in files for r in parse(Lines(line + b"\n" for _, line in own), name))

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from give(r for name, data in rows(batches) for r in parse(Lines(iter(io.BytesIO(data))), name))

    packed = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_name").alias("name"), F.col("value").cast("binary"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.[aw][r]*c").load(path).select(F.col("_metadata.file_name").alias("name"), "content")
    return packed.mapInArrow(lines, schema).unionByName(plain.mapInArrow(wholes, schema))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records (``RECORDS``) of the archives in a folder: ``*.gz``, and ``*.arc`` uncompressed."""
    return _read(spark, path, arc_records, RECORDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records (``WARC_RECORDS``) of the archives in a folder: ``*.gz``, and ``*.warc`` uncompressed."""
    return _read(spark, path, warc_records, WARC_RECORDS)


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """An ARC file of the given version for each partition of ``pages``: a version block, then a record a row, whose block is an HTTP response
    with the html in UTF-8 (null: empty). The id travels as the header ``X-Page-Id`` (none for a null id). White space and control characters
    in an url are percent-encoded; a null or empty url becomes ``unknown:``. A partition without rows gives a file without records, or none."""
    small_batches(pages.sparkSession)
    named = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8"))

    def header(url: str, mime: str, status: str, at: int, size: int, name: str) -> bytes:
        more = f" {status} - - {at} {name}" if version == 2 else ""
        return f"{url} 0.0.0.0 {date} {mime}{more} {size}\n".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name = 0, f"gridloom-{uuid.uuid4().hex}.arc"
        for b in batches:
            out = []
            if not at:
                block = f"{version} 0 gridloom\n{ARC_FIELDS[version]}\n\n".encode()
                out.append(header(f"filedesc://{name}", "text/plain", "200", 0, len(block), name) + block)
            for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                url = re.sub(r"[\x00-\x20\x7f\u0085   ]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url or NO_URL)
                own = f"X-Page-Id: {page}\r\n" if page is not None else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(html)}\r\n{own}\r\n".encode() + html
                at = at or len(out[0]) + 1
                out.append(header(url, "text/html", "200", at, len(block), name) + block)
                at += len(out[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _write(named.mapInArrow(run, "value binary"), path, "\n")


def _write(values: DataFrame, path: str, end: str) -> None:
    values.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 0).text(path)


def _uuid(name: Column) -> Column:
    h = F.sha1(name.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _timestamp(date: Column) -> Column:
    """ISO form of 14 digits; fewer are the beginning of them, and what isn't a time in the calendar counts as none."""
    full = F.rpad(date, 14, "0")
    time = F.coalesce(F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.lit(NO_DATE), F.lit("yyyyMMddHHmmss")))
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def synthesise(records: DataFrame) -> DataFrame:
    """ARC records with what WARC needs: record_id, warc_date, type, block_digest, payload_digest, page_id. Rows with the problem ``header`` are no
    records and go; a short block is kept and marked as truncated."""
    kind = F.when(F.col("url").startswith("filedesc://"), "warcinfo").when(F.octet_length("head") > 0, "response").otherwise("resource")
    page = F.regexp_extract(F.decode("head", "utf-8"), r"\r\nX-Page-Id: (-?\d+)\r\n", 1)
    return records.where("problem is null or problem <> 'header'").select(
        "*", _uuid(F.concat_ws("#", "archive", F.col("offset").cast("string"))).alias("record_id"), _timestamp(F.col("date")).alias("warc_date"), kind.alias("type"),
        F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.when(page != "", page.cast("long")).alias("page_id"))


def revisits(responses: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(record_id, first_id) of the records that repeat another's payload. ``responses`` (kept): record_id, page_id, digest, size. Of equal payloads
    of at least ``least`` bytes the one with the smallest page_id is the first (rows without one last, then the smallest record_id).
    Digests are counted before they are joined, and a digest that many records share is broadcast instead of shuffled."""
    large = responses.where(F.col("size") >= least)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    groups = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("members")).where("members > 1")
    groups = keep(groups.select("digest", F.col("first.record_id").alias("first_id"), "members"), "payloads")
    return join_groups(large.select("record_id", "digest"), groups, "digest", "members", responses.count()).where("record_id <> first_id").select("record_id", "first_id")


def convert(spark: SparkSession, arc: str, warc: str, least: int = REVISIT_BYTES) -> None:
    """Write the records of the ARC archives in one folder as WARC archives into another, repeated payloads as revisits.

    A revisit keeps its HTTP head, gives the digest of its payload and refers to the record that has it. The archives are read twice: for
    the digests alone, then for the records; payloads are only shuffled where there are too many revisits for a broadcast.
    """
    records = synthesise(read_arc(spark, arc))
    slim = keep(records.where("type = 'response' and problem is null").select("record_id", "page_id", "digest", "size"), "payload-digests")
    again = keep(revisits(slim, least), "revisits")
    joined = records.join(few(again), "record_id", "left")
    revisit = F.col("first_id").isNotNull()
    kind = F.when(revisit, "revisit").otherwise(F.col("type"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    mime = F.when(F.octet_length("head") > 0, "application/http; msgtype=response").when(F.col("type") == "warcinfo", "text/plain").otherwise(F.col("mime"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    only = lambda when, value: F.when(when, value)
    has_payload = kind.isin("response", "revisit", "resource")
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), line("WARC-Type", kind), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("warc_date")),
        only(F.col("type") != "warcinfo", line("WARC-Target-URI", F.col("url"))), only(F.col("type") == "warcinfo", line("WARC-Filename", F.col("archive"))), only(F.col("ip") != "0.0.0.0", line("WARC-IP-Address", F.col("ip"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))), only(has_payload, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))),
        only(revisit, line("WARC-Profile", F.lit(IDENTICAL))), only(revisit, line("WARC-Refers-To", F.col("first_id"))), only(F.col("problem") == "short", F.lit("WARC-Truncated: unspecified")),
        line("Content-Type", mime), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    _write(joined.select(F.concat(header.cast("binary"), block).alias("value")), warc, "\r\n\r\n")
    discard(slim, again)


def pages_of(spark: SparkSession, warc: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response and revisit in WARC archives; a digest is taken anew from a
    response's payload, and a revisit's record is looked up by its identifier."""
    rows = read_warc(spark, warc).where("type in ('response', 'revisit')")
    head = F.decode("head", "utf-8")
    page, length = (F.regexp_extract(head, rf"\r\n{name}: (-?\d+)\r\n", 1) for name in ("X-Page-Id", "Content-Length"))
    again = F.col("type") == "revisit"
    slim = keep(rows.select(
        "record_id", "refers_to", F.when(page != "", page.cast("long")).alias("page_id"), F.when(again, length.cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"), F.col("type").alias("record_type")), "records")
    counted = slim.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("members"))
    firsts = keep(counted.join(slim.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page")), "refers_to"), "referred")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    found = join_groups(slim.where("record_type = 'revisit'").select(*out, "refers_to"), firsts, "refers_to", "members", slim.count())
    return slim.where("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(found.select(*out, F.col("first_page").alias("refers_to")))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Pages written as ARC archives of either version (half the pages each, by a hash of the id), converted to WARC, and read back.

    One row per input row: page_id, payload_bytes, payload_digest, record_type, refers_to. A null or empty html is an empty payload. Of rows
    that repeat both id and payload one is the response and the others revisit it, under the same id; a null id is a response only where its
    payload has no other. An empty table gives an empty result; columns besides the three are ignored.
    """
    spark = pages.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2))
    for version in (1, 2):
        write_arc(pages.where(half == version - 1), f"{base}/arc/v={version}", version, id_col=id_col, url_col=url_col, html_col=html_col)
    convert(spark, f"{base}/arc/v=*", f"{base}/warc", least)
    done = spark.range(0)
    done.kept_path = f"{base}/arc"
    discard(done)
    return pages_of(spark, f"{base}/warc")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h) AS b, sha256(h) AS g FROM p),
     f AS (SELECT *, CASE WHEN b >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY g) ELSE page_id END AS first FROM s)
SELECT page_id, b AS payload_bytes, g AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
