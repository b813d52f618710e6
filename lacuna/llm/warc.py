"""WARC archives: written from pages, and read back whatever is left of them.

Each record is a gzip member of its own, so a bad byte costs one record. Tasks write hidden files of about
``FILE_BYTES`` bytes and tell their names in the table ``_manifest``; a second pass over that table makes its
files visible, so what a lost attempt wrote stays hidden and a repeated pass changes nothing. Of records with equal
payloads the one with the smallest id is a response, the others revisit it without a payload of their own.
Payloads under ``min_bytes`` are not compared.

The reader takes plain archives and such with one gzip member or one for each record. A record counts if
its version line, header, length and, where given, block digest hold. Where they do not, the
reader goes on to the next version line, or the next gzip member that shows one before it ends or breaks, whichever comes
first, and reports the bytes between as a gap. Of a broken member the records that come out whole count too, those with a digest that is right or missing.

Defined cases: a null payload is empty. A null id is no one's smallest unless all are null, and is written as an empty
name. Rows with equal ids are separate records; those with the smallest id are all responses. A file comes to its
task whole, so the writer bounds the bytes of a file, one long record aside; other archives must fit a task's memory. An empty file has no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
FILE_BYTES = 32 << 20
SALTS = 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32: 40 hexadecimal digits are eight times four digits to the base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def _with_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to)."""
    payload = F.coalesce("html", F.lit("")).alias("payload")
    rows = pages.select("page_id", "url", payload).withColumn("size", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary")))
    groups = (
        rows.where(F.col("size") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    # A payload may make up a third of all rows: each row looks in one of several copies of its group.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["digest", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "size", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) as WARC files into ``path``."""
    def name(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    # Line breaks would end a header.
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), F.when(revisit, sha1_base32(F.lit("").cast("binary"))).otherwise(F.col("digest"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(header, F.lit(END), block, F.lit(END)).cast("binary").alias("record")
    manifest = f"{path}/_manifest"
    rows = _with_roles(pages, min_bytes).select(record)
    rows.mapInArrow(_write_files(path), "file string, records long, bytes long").write.parquet(manifest)
    shown = pages.sparkSession.read.parquet(manifest).select("file").mapInArrow(_show_files(path), "file string")
    shown.write.format("noop").mode("overwrite").save()


def _write_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        out, name, records, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for record in batch.column("record"):
                member = gzip.compress(record.as_py(), 6, mtime=0)
                if out and size + len(member) > FILE_BYTES:
                    yield close()
                    out = None
                if not out:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{place}/.{name}", compression=None)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out:
            yield close()

    return run


def _show_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                hidden, shown = f"{place}/.{name}", f"{place}/{name}"
                # A repeated attempt finds it done.
                if system.get_file_info(hidden).type != FileType.NotFound:
                    system.move(hidden, shown)
                elif system.get_file_info(shown).type == FileType.NotFound:
                    raise FileNotFoundError(shown)
            yield batch

    return run


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_LINE = len(b"WARC/1.1\r\n")
_PIECE = 1 << 14


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, its end, what is wrong) of the record that begins at ``at``."""
    head = _VERSION.match(data, at)
    if not head:
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", head.end())
    if stop < 0:
        return None, at, "no end of header"
    fields = {}
    for line in data[head.end() : stop].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None, at, "broken header"
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, at, "no length"
    begin, end = stop + 4, stop + 4 + int(length)
    if end > len(data):
        return None, at, "cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no end of record"
    block = data[begin:end]
    claim = fields.get("warc-block-digest", "")
    if claim.startswith("sha1:") and claim[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return None, at, "wrong digest"
    return {"fields": fields, "block": block}, end + 4, ""


def _records(data: bytes, base: int = 0, exact: bool = True) -> Iterator[tuple]:
    """Records and gaps of plain data: ("record", start, end, record) or ("gap", start, end, reason)."""
    at = 0
    while at < len(data):
        found, end, wrong = _record(data, at)
        if found:
            yield ("record", base + at, base + end, found) if exact else ("record", base, base, found)
            at = end
            continue
        following = _VERSION.search(data, at + 1)
        stop = following.start() if following else len(data)
        yield ("gap", base + at, base + stop, wrong) if exact else ("gap", base, base, wrong)
        at = stop


def _pieces(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """What comes out of the gzip member at ``at``, piece by piece, and its end, which is 0 before the last piece."""
    opener, view = zlib.decompressobj(31), memoryview(data)
    while at < len(data) and not opener.eof:
        piece = opener.decompress(view[at : at + _PIECE])
        at = min(at + _PIECE, len(data))
        yield piece, at - len(opener.unused_data) if opener.eof else 0


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The contents of the gzip member at ``at`` and its end; None if it does not open whole."""
    out, end = [], 0
    try:
        for piece, end in _pieces(data, at):
            out.append(piece)
    except zlib.error:
        end = 0
    return (b"".join(out), end) if end else (None, at)


def _opens(data: bytes, at: int) -> bool:
    """Whether the gzip member at ``at``, broken or not, shows a version line; read no further than that."""
    tail = b""
    try:
        for piece, _ in _pieces(data, at):
            tail = tail[1 - _LINE :] + piece
            if _VERSION.search(tail):
                return True
    except zlib.error:
        # The piece that breaks may show one before it does.
        return bool(_VERSION.search(_part(data, at)[0]))
    return False


def _part(data: bytes, at: int) -> tuple[bytes, int]:
    """What comes out of the gzip member at ``at`` before it breaks, up to the last byte before the damage, and its place."""
    opener, out = zlib.decompressobj(31), []
    while at < len(data) and not opener.eof:
        before = opener.copy()
        try:
            out.append(opener.decompress(data[at : at + 4096]))
        except zlib.error:
            try:
                for i in range(at, min(at + 4096, len(data))):
                    out.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                at = i
                break
        at += 4096
    return b"".join(out), at


def _next(data: bytes, at: int, line: int) -> int:
    """Where the next version line from ``line`` on or the next gzip member with one begins, whichever comes first."""
    following = _VERSION.search(data, line)
    end = following.start() if following else len(data)
    stop = data.find(_GZIP, at, end)
    # A member's signature within other data does not open, or shows no version line.
    while stop >= 0:
        if _opens(data, stop):
            return stop
        stop = data.find(_GZIP, stop + 1, end)
    return end


def salvage(data: bytes) -> Iterator[tuple]:
    """All that holds in an archive, in order, and the gaps between; places are bytes of the file."""
    at = 0
    while at < len(data):
        if data.startswith(_GZIP, at):
            out, end = _member(data, at)
            if out is not None:
                for kind, _, _, what in _records(out, exact=False):
                    yield kind, at, end, what
                at = end
                continue
            wrong = "no whole member"
            # Stored blocks show version lines of records that came out already.
            part, line = _part(data, at)
            for kind, _, _, what in _records(part, exact=False):  # whole records before the damage
                if kind == "record":
                    yield kind, at, at, what
        else:
            found, end, wrong = _record(data, at)
            line = at + 1
            if found:
                yield "record", at, end, found
                at = end
                continue
        stop = _next(data, at + 1, max(at + 1, line))
        yield "gap", at, stop, wrong
        at = stop


READ = (
    "path string, kind string, start long, end long, reason string, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, block binary"
)


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row for each record and each gap of the archives in ``path``. Without ``blocks`` their contents stay out."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in READ.split(", ")]

    def row(path: str, kind: str, start: int, end: int, what) -> tuple:
        if kind == "gap":
            return (path, kind, start, end, what, None, None, None, None, None, None, None)
        f = what["fields"]
        digest, size = f.get("warc-payload-digest", ""), f.get("x-payload-length", "")
        size = int(size) if size.isdigit() else len(what["block"])
        return (
            path, kind, start, end, None, f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"),
            f.get("warc-refers-to"), digest.removeprefix("sha1:") or None, size, what["block"] if blocks else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                place, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                rows, held = [], 0
                for found in salvage(data):
                    rows.append(row(place, *found))
                    held += len(rows[-1][-1] or b"") + 200
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def page_of(name: Column) -> Column:
    """The id in a record's name."""
    number = F.regexp_extract(name, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(number != "", number.cast("long"))
