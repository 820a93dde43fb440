"""Web archives: a writer, and a reader that salvages what damage has left.

An archive is a run of gzip members, with one record or several in each, or of plain records.
Spark's own text sink writes the files, so its committer deals with lost and repeated tasks: the
rows are the members, and the line separator is an empty gzip member, which every gzip
reader skips (in plain files, it is the blank lines that end a record anyway).

The reader checks each record (member checksum, version line, header, length, block digest, or
payload digest where there is no block digest).  After a failed check it searches for the next
gzip magic or version line that begins a valid record, goes on there, and reports the bytes
between as a quarantined gap.  Inside a gzip member it does the same with version lines; of a
member that is cut or damaged it reads what can be inflated, and takes the records there whose
digest fits.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .shared import keyed_join, written

GZIP = b"\x1f\x8b\x08"
#: gzip of nothing, written out: header, an empty final block, checksum and length of zero
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: bytes of records after which the writer begins a new file; a reader's task takes a file whole
FILE_BYTES = 128 << 20
#: a header with more lines than this is none, so a false version line costs no more lines to reject; a line has any length
HEADER_LINES = 1000
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/[0-9]+\.[0-9]+\r\n")
_STEP, _FINE = 1 << 16, 256

WRITTEN = pa.schema([("roll", pa.int32()), ("value", pa.binary())])
READ = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("problem", pa.string()), ("gap_before", pa.bool_()),
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
READ_DDL = (
    "file string, start bigint, end bigint, inner_start bigint, inner_end bigint, problem string, gap_before boolean, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, kind: str = "response", refers_to: str | None = None) -> bytes:
    """A record's header and block, without the blank lines at its end."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {clean}"] * bool(clean) + [f"WARC-Refers-To: <urn:page:{refers_to}>"] * (refers_to is not None)
    lines += ["Content-Type: text/html", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    lines += ["WARC-Truncated: length"] * (kind == "revisit")
    block = b"" if kind == "revisit" else payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member; without a time, so that equal input gives equal bytes."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html", compress: bool = True, file_bytes: int = FILE_BYTES, torn_col: str | None = None) -> None:
    """Writes a response record for each row, its payload the html in UTF-8 (null: empty).

    Rows with a null id have "null" for it; repeated rows are written again; other columns
    are ignored; an empty table gives an archive folder without records.  A task begins a new
    file after file_bytes of payloads, so a file is never larger than that and one record.
    torn_col names a boolean column; where it is true, the first half of the record comes
    before the whole one, as a writer that was stopped and started again leaves it.
    """

    def run(batches):
        size = 0
        for part, block in B.blocks(batches, text_at=3):
            raw, (ids, urls, torn) = block.buf.tobytes(), (part.column(k).to_pylist() for k in range(3))
            rolls, out = [], []
            for k, (a, b) in enumerate(zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)):
                data = record("null" if ids[k] is None else ids[k], urls[k], raw[a:b])
                whole = member(data + _END) if compress else data
                rolls.append(size // file_bytes)
                out.append(whole[: len(whole) // 2] + whole if torn[k] else whole)
                size += b - a
            yield B.batch(WRITTEN, rolls, out)

    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    torn = F.coalesce(F.col(torn_col), F.lit(False)) if torn_col else F.lit(False)
    rows = pages.select(F.col(id_col).cast("string").alias("id"), url.alias("url"), torn.alias("torn"), F.col(html_col).cast("string").alias("html"))
    separator = EMPTY_MEMBER.decode("latin-1") if compress else "\r\n\r\n"
    # the sink copies the bytes of its strings as they are
    made = rows.mapInArrow(run, "roll int, value binary").select("roll", F.col("value").cast("string").alias("value"))
    made.write.partitionBy("roll").option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


@dataclass
class Found:
    """A record or a gap, at [start, end) of the file; of one in a gzip member, inner is its place in the inflated bytes."""

    start: int
    end: int
    problem: str | None = None
    headers: dict[str, str] | None = None
    payload: bytes = b""
    checked: bool = False  # a digest was declared, and fits
    inner: tuple[int, int] | None = None


def _fits(declared: str, data: bytes) -> bool | None:
    """Whether a declared digest (name:value, base32 or hex) is that of the data; None if it can't be told."""
    name, colon, value = declared.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    real, value = hashlib.new(name, data).digest(), value.strip()
    try:
        said = bytes.fromhex(value) if len(value) == 2 * len(real) else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (binascii.Error, ValueError):
        return False
    return said == real


def _unchunked(body: bytes) -> bytes | None:
    """The content of an HTTP body in chunks; None if it isn't one."""
    out, at = [], 0
    while (stop := body.find(b"\r\n", at, at + 64)) >= 0:
        try:
            size = int(body[at:stop].partition(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 4 + size
    return None


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """A block without the HTTP header that it may begin with."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        cuts = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
        if cuts:
            at, n = min(cuts)
            return block[at + n :]
        return b""
    return block


def _parse(data: bytes, at: int) -> tuple[Found | None, str]:
    """The plain record at this place, or why there is none."""
    if not (head := _VERSION.match(data, at)):
        return None, "no version line"
    headers, line_at, lines = {}, head.end(), 0
    while True:
        stop, lines = data.find(b"\r\n", line_at), lines + 1
        if stop < 0 or lines > HEADER_LINES:
            return None, "header without end"
        if stop == line_at:
            break
        name, colon, value = data[line_at:stop].partition(b":")
        if headers and data[line_at : line_at + 1] in (b" ", b"\t"):  # a folded line goes on with the one before
            headers[last] += " " + data[line_at:stop].strip().decode("utf-8", "replace")
        elif not colon:
            return None, "bad header line"
        else:
            last = name.strip().lower().decode("latin-1")
            headers[last] = value.strip().decode("utf-8", "replace")
        line_at = stop + 2
    if not headers.get("content-length", "").isdecimal():
        return None, "no content length"
    begin = stop + 2
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != _END:
        return None, "length does not fit"
    block = data[begin:end]
    payload = _payload(headers, block)
    fits = _fits(headers.get("warc-block-digest", ""), block)
    if fits is None and headers.get("warc-type") != "revisit" and "warc-truncated" not in headers:
        said = headers.get("warc-payload-digest", "")
        fits = _fits(said, payload)
        if fits is False and (plain := _unchunked(payload)) is not None:
            fits = _fits(said, plain)
    if fits is False:
        return None, "digest does not fit"
    return Found(at, end + 4, None, headers, payload, bool(fits)), ""


def _plain(data: bytes, at: int = 0) -> Iterator[Found]:
    """The plain records from here on and the gaps between them."""
    while at < len(data):
        found, why = _parse(data, at)
        if found is None:
            gap, at = at, at + 1
            while m := _VERSION.search(data, at):
                at = m.start()
                found, _ = _parse(data, at)
                if found:
                    break
                at += 1
            yield Found(gap, found.start if found else len(data), why)
            if found is None:
                return
        yield found
        at = found.end


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """The gzip member at this place: its content, its end, and why it can't be read to its end.

    Of a broken member the content goes on to a few bytes before the break; its end is None."""
    view = memoryview(data)

    def run(step: int) -> tuple[bytes, int | None, str]:
        d, out, k = zlib.decompressobj(31), [], at
        while not d.eof and k < len(data):
            try:
                out.append(d.decompress(view[k : k + step]))
            except zlib.error as e:
                return b"".join(out), None, f"gzip: {e}"[:80]
            k += step
        if not d.eof:
            return b"".join(out), None, "gzip: cut short"
        return b"".join(out), min(k, len(data)) - len(d.unused_data), ""

    content, end, why = run(_STEP)
    if end is None and why != "gzip: cut short" and (content or _promising(view[at : at + _STEP])):
        content, _, _ = run(_FINE)  # the step that broke is inflated again, in smaller ones
    return content, end, why


def _promising(head: memoryview) -> bool:
    """Whether a member's first bytes can be inflated at all to what begins like a record."""
    d = zlib.decompressobj(31)
    try:
        return d.decompress(head[:_FINE], 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _at(data: bytes, at: int) -> tuple[list[Found], int, str]:
    """What is valid at this place: records (or an empty member: no record, but an end), and where
    they end; or what a broken member still holds, with its own place as the end."""
    if not data.startswith(GZIP, at):
        found, why = _parse(data, at)
        return ([found], found.end, "") if found else ([], at, why)
    inner, end, why = _inflate(data, at)
    rows = list(_plain(inner))
    good = [f for f in rows if not f.problem and (end is not None or f.checked)]
    stop = end if end is not None else at
    if end is not None and inner and not good:
        return [], at, rows[0].problem
    kept = rows if end is not None else good
    return [Found(at, stop, f.problem, f.headers, f.payload, f.checked, (f.start, f.end)) for f in kept], stop, why


def salvage(data: bytes) -> Iterator[Found]:
    """The records of an archive file and the gaps between them, in order.

    Records and gaps cover the file: those of one gzip member share its place and tell theirs
    inside it.  A record from a broken member lies in the gap that follows it."""
    at, end = 0, len(data)
    while at < end:
        rows, after, why = _at(data, at)
        if after > at:
            yield from rows
            at = after
            continue
        gap, saved, at = at, rows, at + 1
        while m := _NEXT.search(data, at):
            at = m.start()
            rows, after, _ = _at(data, at)
            if after > at:
                break
            saved += rows
            at += 1
        else:
            rows, at, after = [], end, end
        for f in saved:
            f.end = at
            yield f
        yield Found(gap, at, why)
        yield from rows
        at = after


def _bare_id(value: str | None) -> str | None:
    return (value or "").strip("<>").removeprefix("urn:page:") or None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, glob: str | None = None) -> DataFrame:
    """A row for each record, and one with a `problem` for each quarantined gap.

    file, start and end give the bytes, inner_start and inner_end those inside a gzip member;
    gaps have null in all record columns, and gap_before marks records that come straight after
    one.  payload_digest is bare base32 SHA-1 (of the full payload; a revisit's is the one that it
    declares), payload_bytes is null for revisits.  Files of any name are read, also in folders
    below; glob narrows them.  A file is one task's, so Spark's limit for whole files (2 GB) is
    that of an archive.  A folder without files gives an empty result.
    """

    def run(batches):
        for part in batches:
            for name, content in zip(part.column(0), part.column(1), strict=True):
                rows, size, gap = [], 0, False
                for r in salvage(content.as_py()):
                    h = r.headers
                    revisit = bool(h) and h.get("warc-type") == "revisit"
                    said = (h or {}).get("warc-payload-digest", "").partition(":")[2].upper() or None
                    digest = None if h is None else said if revisit else sha1_base32(r.payload)
                    ids = [_bare_id((h or {}).get(k)) for k in ("warc-record-id", "warc-refers-to")]
                    rows.append((
                        name.as_py(), r.start, r.end, *(r.inner or (None, None)), r.problem, None if h is None else gap, ids[0], h and h.get("warc-type"), h and h.get("warc-target-uri"), ids[1],
                        digest, None if h is None or revisit else len(r.payload), r.payload if with_payload and h is not None else None,
                    ))
                    gap = h is None
                    size += len(r.payload) * with_payload + 300
                    if size > B.BLOCK_BYTES:
                        yield B.batch(READ, *map(list, zip(*rows, strict=True)))
                        rows, size = [], 0
                if rows:
                    yield B.batch(READ, *map(list, zip(*rows, strict=True)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path)
    return files.select("path", "content").mapInArrow(run, READ_DDL)


def gaps(records: DataFrame) -> DataFrame:
    """(file, start, end, inner_start, inner_end, problem): the quarantined gaps of read_archives' rows."""
    return records.where("problem is not null").select("file", "start", "end", "inner_start", "inner_end", "problem")


def with_revisits(records: DataFrame, id_col: str = "page_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Of the records with equal payloads, that with the largest id is the response and the
    others revisit it.

    An archive of this writer holds every payload, so a revisit is a relation of what was read,
    and no record is a revisit by itself; records that others wrote as revisits are taken by
    their declared digest.  Gap rows are left out (`gaps` lists them).  Ids that are no numbers, or
    missing, count as null: such a record revisits the response, or is the response if no record
    of its payload has a number.  Repeated records with the largest id are all responses.  An empty
    table gives an empty result.  A revisit that declares no digest refers to nothing.  Only ids and
    digests are shuffled; a digest with a large share of all records is not gathered in one task.
    """
    pages = written(records.where("problem is null").select(F.col("record_id").try_cast("bigint").alias(id_col), "payload_bytes", "payload_digest", *extra))
    known = pages.where("payload_digest is not null")
    best = written(known.groupBy("payload_digest").agg(F.max(id_col).alias("best"), F.count("*").alias("c")))
    own = F.col(id_col).eqNullSafe(F.col("best"))
    found = keyed_join(known, best, ["payload_digest"], "c").withColumns({"record_type": F.when(own, "response").otherwise("revisit"), "refers_to": F.when(~own, F.col("best"))})
    columns = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", *extra]
    blind = pages.where("payload_digest is null").withColumns({"record_type": F.lit("revisit"), "refers_to": F.lit(None).cast("bigint")})
    return found.select(*columns).unionByName(blind.select(*columns))
