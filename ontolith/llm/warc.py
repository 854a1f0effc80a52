"""WARC archives: writing, normalising monolithic gzip files, reading by offset index.

A monolithic archive is one gzip stream around all its records, so no record can be read without
inflating all before it. The normaliser inflates such a stream once, from front to back, and rewrites
each record as a gzip member of its own, with a sidecar index of the members' offsets. Everything is
streamed: a task holds one batch of pages or one piece of a record, however large the archive is.

Archives are files in a folder that all executors share, opened through ``pyarrow.fs`` by URI. File
names are new for each task attempt, and only the names that a finished attempt returns are used, so
that a lost executor's half-written files are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.llm.near import bound_batches
from ontolith.plans.shared import discard, fresh_path, remove, written

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # pages carry no time of their own
PIECE = 1 << 20
# Of payload, and of records, after which a task begins another archive.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 1 << 30, 100_000
_END = b"\r\n\r\n"
_WROTE = "path string, ordinal long, page_id long, digest string, payload_bytes long"
_INDEXED = "path string, records long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _create(uri: str) -> BinaryIO:
    fs, path = _located(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    name = (urn or "none>").rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def response(page_id: int | None, url: str | None, payload: bytes) -> tuple[bytes, str]:
    """A response record (head, block and end) and its payload's digest."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _urn(page_id)[1:-1]
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return _head(fields) + http + payload + _END, digest


def _gzip(level: int):  # noqa: ANN202
    return zlib.compressobj(level, zlib.DEFLATED, 31)


class Inflated:
    """Bytes of a gzip file of any number of members, read forward only."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.inflate, self.held = file, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data or self.file.read(PIECE)
                if not rest:
                    return False
                self.inflate = zlib.decompressobj(31)
            else:
                rest = self.inflate.unconsumed_tail or self.file.read(PIECE)
                if not rest:
                    raise ValueError("the archive ends inside a gzip member")
            got = self.inflate.decompress(rest, PIECE)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes:
        """All bytes up to and with ``mark``; nothing at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return b""
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record's block")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_file(source: str, target: str, revisits: dict[int, int | None] | None = None, level: int = 6) -> int:
    """Rewrite an archive with one gzip member for each record, and its index beside it.

    ``revisits`` names the ordinals of response records whose payload another page's record has: these
    become revisit records, which keep the HTTP head only. Returns the number of records. The index,
    ``target`` + ".idx", has a line for each record: offset, length, record id, type.
    """
    fs, path = _located(source)
    n = offset = 0
    with fs.open_input_stream(path, compression=None) as file, _create(target) as out, _create(f"{target}.idx") as index:
        stream = Inflated(file)
        while head := stream.until(_END).lstrip(b"\r\n"):
            fields, member, length = _fields(head), _gzip(level), 0
            kind, size = fields.get("warc-type", ""), int(fields["content-length"])
            if revisits and n in revisits and kind == "response":
                kind = "revisit"
                block = b""
                for piece in stream.pieces(size):
                    block = block if _END in block else block + piece
                block = block[: block.index(_END) + len(_END)]
                lines = [x for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:] if x and not x.lower().startswith(("warc-type:", "content-length:"))]
                names = [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines)]
                names = [("WARC-Type", "revisit"), *names, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(revisits[n])), ("Content-Length", str(len(block)))]
                parts: Iterator[bytes] = iter((_head(names), block))
            else:
                parts = (x for y in ([head], stream.pieces(size)) for x in y)
            for part in (*_drain(parts, member, out), member.compress(_END), member.flush()):
                length += out.write(part) if isinstance(part, bytes) else part
            for _ in stream.pieces(len(_END)):
                pass
            index.write(f"{offset} {length} {fields.get('warc-record-id', '-')} {kind}\n".encode())
            offset, n = offset + length, n + 1
    return n


def _drain(parts: Iterator[bytes], member, out: BinaryIO) -> list[int]:  # noqa: ANN001
    """Compress and write piece by piece; what was written counts for the member's length."""
    return [out.write(member.compress(x)) for x in parts]


def _lines(file: BinaryIO) -> Iterator[str]:
    rest = b""
    while piece := file.read(PIECE):
        *lines, rest = (rest + piece).split(b"\n")
        yield from (x.decode() for x in lines)
    if rest:
        yield rest.decode()


def read_file(path_uri: str) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """The records of a normalised archive, each found by the index and inflated alone.

    Responses are measured and hashed anew, and a digest that differs from the record's raises.
    """
    fs, path = _located(path_uri)
    with fs.open_input_stream(f"{path}.idx", compression=None) as index, fs.open_input_file(path) as file:
        for line in _lines(index):
            offset, length, _, _ = line.split(" ", 3)
            file.seek(int(offset))
            raw = zlib.decompress(file.read(int(length)), 31)
            head, _, rest = raw.partition(_END)
            fields = _fields(head)
            block = rest[: int(fields["content-length"])]
            http, _, payload = block.partition(_END)
            told = fields["warc-payload-digest"].removeprefix("sha1:")
            kind, size = fields["warc-type"], int(_fields(http)["content-length"])
            if kind == "response" and (len(payload) != size or base32_sha1(payload) != told):
                raise ValueError(f"{fields['warc-record-id']} in {path_uri} is damaged")
            yield _page(fields["warc-record-id"]), size, told, kind, _page(fields.get("warc-refers-to")) if kind == "revisit" else None


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write (page_id, url, html) as monolithic archives; one row for each record: see ``_WROTE``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, member, path, ordinal, filled = None, None, "", 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                if out is None:
                    path, member, ordinal, filled = f"{folder}/{uuid.uuid4().hex}.warc.gz", _gzip(level), 0, 0
                    out = _create(path)
                payload = (html or "").encode("utf-8", "surrogatepass")
                page = None if page_id is None else int(page_id)
                record, digest = response(page, url, payload)
                out.write(member.compress(record))
                rows.append((path, ordinal, page, digest, len(payload)))
                ordinal, filled = ordinal + 1, filled + len(payload)
                if filled >= ARCHIVE_BYTES or ordinal >= ARCHIVE_RECORDS:
                    out.write(member.flush())
                    out.close()
                    out = None
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _WROTE.split(", ")]).astype({"page_id": "Int64"})
        if out is not None:
            out.write(member.flush())
            out.close()

    ids = F.col("page_id").cast("long").cast("string").alias("page_id")  # pandas would make floats of nullable integers
    return written(pages.select(ids, "url", "html").mapInPandas(write, _WROTE), "wrote")


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """(path, revisits: array of (ordinal, refers_to)) -> (path, records) of normalised archives in ``folder``.

    One task for each archive; a row's array is bounded by its archive's records.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, revisits in zip(batch["path"], batch["revisits"], strict=True):
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                told = {} if revisits is None else {r["ordinal"]: r["refers_to"] for r in revisits}
                yield pd.DataFrame({"path": [target], "records": [normalise_file(path, target, told, level)]})

    return written(_one_each(archives).mapInPandas(rewrite, _INDEXED), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives; see ``_READ``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for row in read_file(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _one_each(archives.select("path")).mapInPandas(read, _READ)


def _one_each(archives: DataFrame) -> DataFrame:
    return archives.repartition(max(1, archives.count()))


def archive(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), normalise the archives, and read them back.

    One row for each row of ``pages``; see ``_READ``. A null html is an empty payload. Of records with
    equal payloads of at least ``least`` bytes the one with the smallest page_id is the response and the
    others revisit it; smaller payloads are all responses. A null page_id comes last and is a response
    if no numbered page has its payload; of rows that repeat the smallest page_id one is the response. An
    empty table gives no archive and no row. Other columns are ignored.

    Payloads are compressed where they are read and never shuffled; only their digests are. An archive has
    a bounded number of records. The monolithic archives go once they are rewritten.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or fresh_path(spark, "warc")
    wrote = write_archives(pages, f"{folder}/monolithic")
    place = F.struct("page_id", "path", "ordinal")
    same = wrote.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest", "payload_bytes").agg(F.min(place).alias("first"))
    again = wrote.join(same, ["digest", "payload_bytes"]).where(F.col("page_id").isNull() | (place != F.col("first")))
    revisits = again.groupBy("path").agg(F.collect_list(F.struct("ordinal", F.col("first.page_id").alias("refers_to"))).alias("revisits"))
    archives = written(wrote.select("path").distinct().join(revisits, "path", "left"), "archives")
    normal = normalise_archives(archives, f"{folder}/normalised")
    discard(wrote, archives)
    remove(spark, f"{folder}/monolithic")
    return read_archives(normal)


#: The same rows in SQL, but for the digest, which DuckDB has in hexadecimal only.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT p.page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, '0x' || sha1(p.h) AS x,
             CASE WHEN m.first IS NULL OR p.page_id = m.first THEN 'response' ELSE 'revisit' END AS record_type,
             CASE WHEN m.first IS NULL OR p.page_id = m.first THEN NULL ELSE m.first END AS refers_to
      FROM p JOIN m USING (h))
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 3 + 10 * g, 10))::BIGINT) >> (5 * (7 - k)))::BIGINT & 31)::INT, 1), '' ORDER BY g, k)
        FROM range(4) AS a(g), range(8) AS c(k)) AS payload_digest,
       record_type, refers_to
FROM b
"""
