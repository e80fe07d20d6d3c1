"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damaged files still hold.

write(): a record per page. Equal payloads of at least MIN_SHARED bytes are stored once, in the response with the
smallest page_id; the others become revisit records that refer to it. The smallest page_id of a digest is found by
partial sums of (digest, page_id) before any shuffle; the digests that several pages share are a saved table, of which few rows or hot rows
are broadcast, so that a payload is shuffled only where many digests are shared. Each record is a gzip member of its own. Executors pack
members into archives of at most ARCHIVE_BYTES and Spark's text sink writes each as one file, so files land where every executor can read them.

read(): each file is one row of Spark's binaryFile source. A record of any type must have a version line, a header block of
any length, a Content-Length that ends at a record boundary and, where given in a known algorithm, right block and payload
digests. The payload is what follows the HTTP header, or the block where there is none. A gzip member may hold several records. After
a failed check the reader looks for the next gzip member that inflates to a version line, or the next version line in plain files or inside
the member, reads on from there, and logs the bytes between as a quarantined gap.

Defined results: a null or empty payload is an empty response; null or odd urls are escaped into the header; texts and urls of any length
are kept whole (a record is held in memory); pages that repeat a page_id each have a record of their own, and where the smallest page_id of equal payloads
is repeated, each of its pages is a response; an empty table writes no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet, save, ship

#: Bytes from which equal payloads are stored once; most bytes of an archive before its last record.
MIN_SHARED, ARCHIVE_BYTES = 100, 8 << 20

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/(?:0\.\d+|1\.[01])\r?\n")
MEMBER = b"\x1f\x8b\x08"
#: Digest algorithms that are checked; others are taken as they are.
KNOWN = ("md5", "sha1", "sha256", "sha512")

#: An empty gzip member. The text sink ends each archive with it, and readers of concatenated members pass over it.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"

#: Kind 'record' has the fields of a record; kind 'gap' the bytes from..to of a file that no record covers, and why.
ROWS = "kind string, file string, start bigint, stop bigint, reason string, page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary"
_ROWS = pa.schema([("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def plan(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, payload (binary), digest, n_bytes, response_id: null where the page itself is the response."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("n_bytes"))
    shared = rows.where(F.col("n_bytes") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    met = meet(rows, save(shared, "digests"), "digest", "copies", F.xxhash64("page_id", "digest"), F.col("n_bytes") < min_shared)
    return met.select("page_id", "url", "payload", "digest", "n_bytes", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("response_id"))


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def record(page_id, url, payload: bytes, digest: str, n_bytes: int, response_id) -> bytes:
    """The bytes of a record: version line, headers, block, two line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    revisit = response_id is not None
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[1:1] = [f"WARC-Refers-To: <urn:page:{response_id}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "n_bytes", "response_id")]
        for k in range(batch.num_rows):
            parts.append(member(record(*[c[k].as_py() for c in columns])))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])


def write(pages: DataFrame, path: str, min_shared: int = MIN_SHARED) -> None:
    """Write pages (page_id, url, html) as archives under path."""
    ship(pages.sparkSession)
    archives = plan(pages, min_shared).mapInArrow(_archives, "archive binary")
    # a row is a whole archive: the sink writes its bytes as they are, then the empty member
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


class Bad(ValueError):
    """A check that failed; what it says is the gap's reason."""


def _differs(said: str, data: bytes) -> bool:
    """Whether a digest header (algorithm:value, in base 16, 32 or 64) of a known algorithm is not that of data."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in KNOWN:
        return False
    digest, value = hashlib.new(name, data, usedforsecurity=False).digest(), value.strip().rstrip("=")
    return digest.hex() != value.lower() and base64.b32encode(digest).decode().rstrip("=") != value.upper() and value not in (e(digest).decode().rstrip("=") for e in (base64.b64encode, base64.urlsafe_b64encode))


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at `at` of plain bytes, or Bad."""
    m = VERSION_LINE.match(data, at)
    if not m:
        raise Bad("no version line")
    head, begin = {}, m.end()
    while (end := data.find(b"\r\n", begin)) != begin:  # the first line that is no header ends the search
        if end < 0:
            raise Bad("header block does not end")
        name, colon, value = data[begin:end].partition(b":")
        if not colon:
            raise Bad("header line without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        begin = end + 2
    if not head.get("content-length", "").isdecimal():
        raise Bad("no content length")
    stop = end + 2 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("block does not end at a record boundary")
    block = data[end + 2 : stop]
    if _differs(head.get("warc-block-digest", ""), block):
        raise Bad("block digest differs")
    return head, block, stop + 4


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _row(head: dict, block: bytes, file: str, start: int, stop: int) -> dict:
    revisit = head.get("warc-type") == "revisit"
    kind = head.get("content-type", "")
    http = kind.lower().startswith("application/http") or (not kind and block.startswith(b"HTTP/"))
    cut = block.find(b"\r\n\r\n") if http else -1
    payload = b"" if revisit else block[cut + 4 :] if cut >= 0 else block
    said = head.get("warc-payload-digest", "")
    # chunks of a transfer are not part of what the digest is of
    if not revisit and not (cut >= 0 and b"\r\ntransfer-encoding:" in block[:cut].lower()) and _differs(said, payload):
        raise Bad("payload digest differs")
    length = head.get("x-payload-length", "")
    return {
        "kind": "record", "file": file, "start": start, "stop": stop, "reason": None, "page_id": _number(head.get("warc-record-id")), "record_type": head.get("warc-type"),
        "refers_to": _number(head.get("warc-refers-to")), "url": head.get("warc-target-uri"), "payload_bytes": int(length) if length.isdecimal() else len(payload), "payload_digest": said.removeprefix("sha256:") or None, "payload": payload,
    }


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """One gzip member: what it holds and where it ends. Its own checksum is checked here."""
    unpack = zlib.decompressobj(31)
    try:
        out = unpack.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise Bad(f"gzip member is damaged: {e}") from None
    if not unpack.eof:
        raise Bad("gzip member is cut off")
    return out, len(data) - len(unpack.unused_data)


def _gap(file: str, start: int, stop: int, reason: str) -> dict:
    return dict.fromkeys([f.name for f in _ROWS]) | {"kind": "gap", "file": file, "start": start, "stop": stop, "reason": reason}


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at `at` holds, and where it ends. Its end is found from a bounded view that grows, so a file costs its own
    size, not its square."""
    view = 1 << 16
    while True:
        try:
            plain, used = _inflate(data[at : at + view], 0)
        except Bad as e:
            if "cut off" not in str(e) or at + view >= len(data):
                raise
            view *= 4
        else:
            return plain, at + used


def _records(plain: bytes, file: str, start: int, stop: int) -> tuple[list[dict], str]:
    """Valid records of a member of bytes start..stop, and why others were passed over; Bad if none is valid."""
    found, why, at = [], "", 0
    while at < len(plain):
        try:
            head, block, end = _parse(plain, at)
            found.append(_row(head, block, file, start, stop))
            at = end
        except Bad as e:
            why = why or str(e)
            m = VERSION_LINE.search(plain, at + 1)
            at = m.start() if m else len(plain)
    if why and not found:
        raise Bad(why)
    return found, why


def salvage(data: bytes, file: str = "") -> Iterator[dict]:
    """Rows of ROWS for a file's bytes: its valid records in order, and the gaps between them.

    The records of one gzip member share its bytes start..stop. A member of which a part is damaged gives its valid records and a gap of
    the same bytes. Empty members count as part of what is around them.
    """
    at, gap, why = 0, None, ""
    next_member = next_line = -1  # each is searched for again only when it has been passed
    while at < len(data):
        hurt = ""
        try:
            if data.startswith(MEMBER, at):
                plain, stop = _member(data, at)
                rows, hurt = _records(plain, file, at, stop)
            else:
                head, block, stop = _parse(data, at)
                rows = [_row(head, block, file, at, stop)]
        except Bad as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            if next_member <= at:
                next_member = data.find(MEMBER, at + 1) % (len(data) + 1)
            if next_line <= at:
                m = VERSION_LINE.search(data, at + 1)
                next_line = m.start() if m else len(data)
            at = min(next_member, next_line)
            continue
        if rows and gap is not None:
            yield _gap(file, gap, at, why)
            gap = None
        yield from rows
        if hurt:
            yield _gap(file, at, stop, hurt)
        at = stop
    if gap is not None:
        yield _gap(file, gap, len(data), why)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """ROWS of all archives under path."""
    ship(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found, size = [], 0
                for row in salvage(batch.column("content")[k].as_py(), batch.column("path")[k].as_py()):
                    row["payload"] = row["payload"] if with_payload else None
                    found.append(row)
                    size += len(row["payload"] or b"")
                    if size > 4 << 20 or len(found) >= 2000:
                        yield pa.RecordBatch.from_pylist(found, _ROWS)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, _ROWS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(rows, ROWS)


ORACLE_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM rows WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""
