"""WARC derivatives: response records become linked metadata and plain-text
conversion records.

A derived record refers to its response (``WARC-Refers-To``) and keeps the
target, the date and the response's payload digest; the metadata record holds
the source's WARC and HTTP headers as ``application/warc-fields``; the
conversion record holds the page as plain text.  Ids are name-based (from the
response's id and the kind), so a task that runs twice writes the same
records.  Everything works record by record in Arrow batches: no shuffle.

``record`` columns are whole serialised records (optionally gzip members),
which may be concatenated into an archive; ``split_records`` takes such bytes
back apart.  Archive files (``read_archives``) are opened inside the tasks and
inflated as far as the next record needs, so a task holds one record of a file.

Cases: a null url or html gives an empty target or payload; a null id is part
of the record's name like any other; repeated rows give equal records; bytes
that are no WARC record, are cut short or fail to inflate give one row with
``error`` set and what could be read (of bytes that are no record, the first
REST_BYTES), and never stop the job; a block of 2 GB or more, which no row can
hold, is passed over with such a row; a payload that is no text, or in an
encoding that is unknown or broken, has its metadata record, such a row and no
conversion; chunked and gzip or deflate payloads are undone first; markup that
does not nest is read as far as it goes; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Derived text handed back to Spark at a time.
BATCH_BYTES = 8 << 20
#: Read or inflated at a time.
PIECE_BYTES = 1 << 20
#: Headers end within so many bytes, and so much is kept of what is no record.
REST_BYTES = 16 << 20
#: A page inflates to so much at most.
TEXT_BYTES = 256 << 20
#: A row holds less than this.
ROW_BYTES = 1 << 31
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")      # the URL name space of RFC 4122
_BLOCKS = ("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main "
           "nav ol p pre section table td th title tr ul").split()
# every pattern ends at the next angle bracket or at the end of the page, so
# unclosed markup costs one scan, not one scan for each tag
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+>?"""
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*+>?", re.S | re.I)
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(_BLOCKS)})\b{_ATTRIBUTES}", re.I)
_TAG = re.compile(rf"</?[a-z]{_ATTRIBUTES}", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*name) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(map(str, name)))}>"


def serialised(headers: list[tuple[str, str]], block: bytes, compress: bool = False) -> bytes:
    lines = (f"{n}: {' '.join(v.splitlines())}\r\n" for n, v in headers)
    data = ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"
    if not compress:
        return data
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            n, v = line.split(":", 1)
            out.append((n.strip(), v.strip()))
    return out


class _Plain:
    """Plain bytes of a stream (gzip members one after another, or as they
    are), of which only what is asked for is held.  ``error`` tells why
    inflating stopped, ``member`` where the last member read starts."""

    def __init__(self, stream):
        self.held, self.at, self.error = b"", 0, ""
        self.passed, self.made, self.member = 0, 0, 0       # bytes before ``held``, inflated so far
        self._pieces = self._read(stream)

    def _read(self, stream):
        piece = stream.read(PIECE_BYTES)
        if piece[:2] != b"\x1f\x8b":
            while piece:
                yield piece
                piece = stream.read(PIECE_BYTES)
            return
        while piece[:2] == b"\x1f\x8b":
            z, self.member = zlib.decompressobj(31), self.made
            while piece and not z.eof:
                try:
                    out = z.decompress(piece, PIECE_BYTES)
                except zlib.error as e:
                    self.error = f"inflate: {e}"
                    return
                if out:
                    self.made += len(out)
                    yield out
                piece = z.unused_data if z.eof else z.unconsumed_tail or stream.read(PIECE_BYTES)
            if len(piece) < 2:
                piece += stream.read(PIECE_BYTES)
        if piece.strip(b"\0"):
            self.error, self.member = "inflate: no gzip member", self.made

    def fill(self, n: int) -> bool:
        """Hold ``n`` bytes, or all that are left; whether there are as many."""
        have = len(self.held) - self.at
        if have < n:
            parts = [self.held[self.at:]]
            while have < n and (piece := next(self._pieces, None)) is not None:
                parts.append(piece)
                have += len(piece)
            self.passed += self.at
            self.held, self.at = b"".join(parts), 0
        return have >= n

    def starts(self, mark: bytes) -> bool:
        self.fill(len(mark))
        return self.held.startswith(mark, self.at)

    def find(self, mark: bytes, most: int) -> int:
        """Place of ``mark`` in the next ``most`` bytes, else -1."""
        n = min(most, 4096)
        while True:
            whole = self.fill(n)
            found = self.held.find(mark, self.at, self.at + most)
            if found >= 0 or not whole or n >= most:
                return found - self.at if found >= 0 else -1
            n = min(most, max(4 * n, len(self.held) - self.at + 1))

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = self.held[self.at:self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> bool:
        """Pass over ``n`` bytes without holding them; whether there are as many."""
        while n and self.fill(1):
            n -= len(self.take(min(n, len(self.held) - self.at)))
        return not n


def split_records(data):
    """(headers, block, error) of every record in ``data`` (bytes, or a binary
    stream, of which one record at a time is held)."""
    plain = _Plain(io.BytesIO(data) if isinstance(data, bytes) else data)
    while plain.fill(1):
        start = plain.passed + plain.at
        if not plain.starts(b"WARC/"):
            yield [], plain.take(REST_BYTES), plain.error or "no record"
            return
        head_end = plain.find(b"\r\n\r\n", REST_BYTES)
        if head_end < 0:
            yield [], plain.take(REST_BYTES), plain.error or "cut in the header"
            return
        headers = _fields(plain.take(head_end + 4)[:-4].partition(b"\r\n")[2])
        length = next((v for n, v in headers if n.lower() == "content-length"), "")
        if not length.isdigit():
            yield headers, plain.take(REST_BYTES), plain.error or "no length"
            return
        if int(length) >= ROW_BYTES:
            block, error = b"", "block of 2 GB or more"
            whole = plain.skip(int(length))
        else:
            block, error = plain.take(int(length)), ""
            whole = len(block) == int(length)
        while plain.starts(b"\r\n"):        # reads on to the end of the record's member, which holds its check sum
            plain.take(2)
        broken = plain.error if start >= plain.member else ""
        yield headers, block, broken or (error if whole else "cut in the block")
        if broken or not whole:
            return
    if plain.error:
        yield [], b"", plain.error


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    if not block.startswith(b"HTTP/") or b"\r\n\r\n" not in block:
        return "", [], block
    head, payload = block.split(b"\r\n\r\n", 1)
    status, _, rest = head.partition(b"\r\n")
    return status.decode("latin-1"), _fields(rest), payload


class Undecodable(ValueError):
    """A payload that cannot become text; the message says why."""


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            raise Undecodable("broken chunks")
        if not int(size, 16):
            return b"".join(out)
        at = end + 2 + int(size, 16)
        if data[at:at + 2] != b"\r\n":
            raise Undecodable("broken chunks")
        out.append(data[end + 2:at])
        at += 2


def _inflated(data: bytes, wbits: int) -> bytes:
    z, out, size = zlib.decompressobj(wbits), [], 0
    rest = data
    try:
        while rest and not z.eof:
            out.append(z.decompress(rest, PIECE_BYTES))
            size += len(out[-1])
            if size > TEXT_BYTES:
                raise Undecodable(f"more than {TEXT_BYTES} bytes of text")
            rest = z.unconsumed_tail
    except zlib.error as e:
        raise Undecodable(f"content encoding: {e}") from e
    if not z.eof:
        raise Undecodable("content encoding: cut short")
    return b"".join(out)


def page_of(http: list[tuple[str, str]], payload: bytes) -> str:
    """The text of a response's payload: transfer and content encodings undone
    in the order of their headers, characters read as the header, the page's
    own ``<meta>`` or UTF-8 says.  Other media than text raise Undecodable."""
    fields: dict[str, str] = {}
    for n, v in http:
        fields[n.lower()] = f"{fields[n.lower()]},{v}" if n.lower() in fields else v
    media = fields.get("content-type", "text/html").split(";")[0].strip().lower()
    if not (media.startswith("text/") or media.endswith(("xml", "json", "javascript")) or not media):
        raise Undecodable(f"no text: {media}")
    listed = [x.strip().lower() for n in ("content-encoding", "transfer-encoding") for x in fields.get(n, "").split(",") if x.strip()]
    for coding in reversed(listed):
        if coding == "chunked":
            payload = _unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            payload = _inflated(payload, 31)
        elif coding == "deflate":
            payload = _inflated(payload, 15 if payload[:1] and payload[0] & 15 == 8 else -15)
        elif coding != "identity":
            raise Undecodable(f"content encoding {coding}")
    named = re.search(r"charset=[\"']?([\w-]+)", fields.get("content-type", ""))
    inside = re.search(rb"<meta[^>]{0,200}?charset=[\"']?([\w-]+)", payload[:4096], re.I)
    for charset in (named and named[1], inside and inside[1].decode()):
        try:
            if charset:
                return payload.decode(charset, "replace")
        except LookupError:                              # a name that is no encoding
            continue
    return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Text of an HTML page: one line per block element, white space joined."""
    text = _UNSEEN.sub(" ", page.replace("\r", " ").replace("\n", " "))     # source line breaks are spaces
    text = html.unescape(_TAG.sub("", _BLOCK_TAG.sub("\n", text)))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE,
              compress: bool = False) -> DataFrame:
    """(page_id, record): each page as a serialised WARC response record."""
    def run(batches):
        for batch in batches:
            out = []
            for k, u, h in zip(*[c.to_pylist() for c in batch.columns]):
                payload = (h or "").encode("utf-8", "surrogatepass")
                block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
                         + str(len(payload)).encode() + b"\r\n\r\n" + payload)
                out.append(serialised([
                    ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", k, u)), ("WARC-Date", date),
                    ("WARC-Target-URI", u or ""), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                    ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block, compress))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "record"])
    return pages.select(pages[f"`{key}`"].try_cast("long").alias("page_id"), pages[f"`{url}`"].alias("u"),
                        pages[f"`{page}`"].alias("h")).mapInArrow(run, "page_id long, record binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, record): archive files of any size, one row each.  ``record`` is
    the path again: ``derivatives`` opens the file in the task that has its row."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("path").alias("record"))


def _opened(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream(re.sub("^file:/*", "/", path), compression=None)
    system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_stream(name, compression=None)


_DERIVED = ("record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, "
            "content_length long, block_digest string, source_payload_digest string, digest_ok boolean, block string, "
            "record binary, error string")


def derivatives(archives: DataFrame, record: str = "record", compress: bool = False) -> DataFrame:
    """Metadata and conversion records of all response records in the bytes of
    column ``record``, or in the files that it names if it is a column of
    strings; records of other types are passed over.  ``digest_ok``
    tells whether the source's payload digest fits its payload."""
    names = [x.split()[0] for x in _DERIVED.split(", ")]
    in_files = isinstance(archives.select(record).schema[0].dataType, StringType)

    def derived(data):
        for headers, block, error in split_records(data):
            h = {n.lower(): v for n, v in headers}
            if error:
                yield (h.get("warc-record-id"), "error", None, h.get("warc-target-uri"), h.get("warc-date"), None, len(block),
                       None, h.get("warc-payload-digest"), None, None, None, error)
                continue
            if h.get("warc-type", "").lower() != "response":
                continue
            status, http, payload = http_parts(block)
            source, uri, date = h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h.get("warc-date", "")
            own = digest(payload)
            said = h.get("warc-payload-digest", own)
            try:
                page, problem = plain_text(page_of(http, payload)), None
            except Undecodable as e:
                page, problem = None, str(e)
            fields = [("source-status", status), *[(f"source-warc-{n}", v) for n, v in headers], *[(f"source-http-{n}", v) for n, v in http],
                      ("source-payload-digest", own), ("source-payload-length", str(len(payload)))]
            about = "".join(f"{n}: {v}\r\n" for n, v in fields)
            if problem:
                yield (source, "error", None, uri, date, None, len(block), None, said, said == own, None, None, problem)
            for kind, kind_type, text in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", page)):
                if text is None:
                    continue
                data = text.encode("utf-8", "replace")
                new = record_id(kind, source)
                head = [("WARC-Type", kind), ("WARC-Record-ID", new), ("WARC-Refers-To", source), ("WARC-Date", date),
                        ("WARC-Target-URI", uri), ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", said),
                        ("Content-Type", kind_type), ("Content-Length", str(len(data)))]
                yield (new, kind, source, uri, date, kind_type, len(data), digest(data), said, said == own,
                       data.decode(), serialised(head, data, compress), None)

    def run(batches):
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t])
                            for n, t in (x.split() for x in _DERIVED.split(", "))])

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names)
        held, size = [], 0
        for batch in batches:
            for one in batch.column(0):
                one = one.as_py() or b""
                for row in derived(_opened(one) if in_files and one else one):
                    held.append(row)
                    size += 2 * row[6]
                    if len(held) >= 1000 or size > BATCH_BYTES:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)
    return archives.select(record).mapInArrow(run, _DERIVED)
