"""Legacy ARC archives converted to WARC: written, parsed by declared lengths, deduplicated, read back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import common

# The record header lines of the two ARC versions.
FIELDS_V1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_V2 = (
    "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARCHIVE_DATE = "20240101000000"

#: An archive takes no more records once it holds this many unpacked bytes, with so many for each ARC header.
ARCHIVE_BYTES, RECORD_BYTES = 64 << 20, 512
_CHUNK = 1 << 20
_PARSED = "file string, offset long, page_id {kind}, record_id string, payload_bytes long, payload_digest string"


def _write(records: Column, rows: DataFrame, path: str) -> None:
    """Records as archive files: each ends with the line feed that the text writer adds.

    A task writes its rows in the order of ``archive`` and ``n``, a file for each archive.
    """
    record = rows.select("archive", "n", records.cast("string").alias("value")).sortWithinPartitions("archive", "n")
    record.drop("n").write.partitionBy("archive").option("compression", "gzip").text(path)


def _rolled(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows with ``archive`` and ``n``: archive of the task, a new one once ``limit`` bytes are in, and place there."""
    schema = pa.schema([("archive", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, held = 0, 0, 0
        for batch in batches:
            archives, places = [], []
            for size in pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist():
                if held >= limit:
                    archive, n, held = archive + 1, 0, 0
                archives.append(archive)
                places.append(n)
                n, held = n + 1, held + size + RECORD_BYTES
            added = [pa.array(archives, schema.field(0).type), pa.array(places, schema.field(1).type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, archive int, n long")


def write_arc(pages: DataFrame, path: str, page_id: str, url: str, html: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC archives of the pages, versions 1 and 2 in turn by task, a new file after ``archive_bytes`` bytes.

    The body is an HTTP response with the page id in a header. White space in a URL is escaped, a
    null or empty URL becomes ``unknown:``, a null body is empty, a null id has no header.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\s\p{Cntrl}]", "%20")
    uri = F.when(uri == "", "unknown:").otherwise(uri)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.format_string("Content-Length: %d\r\n\r\n", F.octet_length(body)),
    )
    length = F.octet_length(http) + F.octet_length(body)
    v2 = F.spark_partition_id() % 2 == 1
    name = F.format_string("siftline-%05d-%05d.arc", F.spark_partition_id(), F.col("archive"))
    about = F.concat(
        F.when(v2, f"2 0 siftline\n{FIELDS_V2}\n").otherwise(f"1 0 siftline\n{FIELDS_V1}\n")
    )
    filedesc = F.concat(
        F.format_string(f"filedesc://%s 0.0.0.0 {ARCHIVE_DATE} text/plain ", name),
        F.when(v2, F.format_string("200 - - 0 %s ", name)).otherwise(""),
        F.octet_length(about).cast("string"),
        F.lit("\n"),
        about,
        F.lit("\n"),
    )
    line = F.concat(
        uri,
        F.lit(f" 0.0.0.0 {ARCHIVE_DATE} text/html "),
        F.when(v2, F.format_string("200 - - 0 %s ", name)).otherwise(""),
        length.cast("string"),
        F.lit("\n"),
    )
    head = F.concat(F.when(F.col("n") == 0, filedesc).otherwise(""), line, http)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    _write(F.concat(head.cast("binary"), body), _rolled(rows, "html", archive_bytes), path)


class _Stream:
    """Lines and runs of bytes of a gzip file, unpacked as they are asked for."""

    def __init__(self, packed: bytes) -> None:
        self._packed, self._at, self._gzip, self._ready = memoryview(packed), 0, zlib.decompressobj(31), bytearray()
        self.offset = 0

    def _more(self) -> bool:
        while self._at < len(self._packed):
            piece = self._packed[self._at : self._at + _CHUNK]
            out = self._gzip.decompress(piece)
            self._at += len(piece) - len(self._gzip.unused_data)
            if self._gzip.eof:
                self._gzip = zlib.decompressobj(31)
            if out:
                self._ready += out
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self._ready) < n and self._more():
            pass
        if len(self._ready) < n:
            raise ValueError(f"archive ends inside a record at byte {self.offset}")
        out = bytes(self._ready[:n])
        del self._ready[:n]
        self.offset += n
        return out

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        seen = 0
        while (at := self._ready.find(b"\n", seen)) < 0:
            seen = len(self._ready)
            if not self._more():
                return self.take(seen) if seen else None
        return self.take(at + 1)[:-1]


def _base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def arc_records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Header fields, body and offset of each record; the first record says which fields there are."""
    stream = _Stream(packed)
    fields: list[str] | None = None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        offset = stream.offset - len(line) - 1
        values = line.decode("utf-8", "replace").split(" ")
        body = stream.take(int(values[-1]))
        if fields is None:
            version, _, rest = body.decode("utf-8").partition("\n")
            fields = rest.split("\n", 1)[0].split(" ")
            if version.split(" ")[0] not in ("1", "2") or not values[0].startswith("filedesc://"):
                raise ValueError("not an ARC file of version 1 or 2")
            continue
        # a URL may hold spaces: the fields behind it are counted from the end
        cut = len(values) - len(fields) + 1
        yield dict(zip(fields, [" ".join(values[:cut]), *values[cut:]], strict=True)), body, offset


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The archives with their names: the files of a task differ in the folder of their archive only."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -2).alias("file"), "content")


def _parsed(name: str, packed: bytes) -> Iterator[tuple]:
    """Offset, id, fields, HTTP head, payload and page id (as text) of each record of an ARC file.

    A record that is no HTTP message (a name lookup, say) is payload as a whole. Ids are name-based: the file and the offset of a record decide them, so a task that runs again
    makes the same.
    """
    for fields, block, offset in arc_records(packed):
        http = block.startswith(b"HTTP/")
        head, sep, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}"))
        yield offset, record_id, fields, head + sep, body, _headers(head).get("x-page-id")


def read_arc(spark: SparkSession, path: str, page_id_type: str) -> DataFrame:
    """The records of ARC archives: place, page, WARC id, and size and digest of the payload."""
    schema = _PARSED.format(kind=page_id_type)
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(name: str, packed: bytes) -> Iterator[tuple]:
        for offset, record_id, _, _, body, page in _parsed(name, packed):
            yield name, offset, page, record_id, len(body), _base32(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = rows(batch.column("file")[i].as_py(), batch.column("content")[i].as_py())
                yield from _batches(found, names, schema)

    return _files(spark, path).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}


def _batches(rows: Iterator[tuple], names: list[str], schema: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about a slice of bytes; ids come as text and get their type."""
    kinds = [_ARROW[part.split()[1]] for part in schema.split(", ")]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = []
        for values, name, kind in zip(zip(*held, strict=True), names, kinds, strict=True):
            text = name in ("page_id", "refers_to")
            columns.append(pa.array(values, pa.string()).cast(kind) if text else pa.array(values, kind))
        return pa.RecordBatch.from_arrays(columns, names=names)

    for row in rows:
        held.append(row)
        size += 400 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > common.SLICE_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _warc(fields: list[tuple[str, str]], *block: bytes) -> bytes:
    """One record without its last line feed, which the text writer adds."""
    fields.append(("Content-Length", str(sum(map(len, block)))))
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return b"".join((head.encode(), *block, b"\r\n\r"))


def convert(
    spark: SparkSession, arc: str, decisions: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """The ARC archives below ``arc`` as WARC archives below ``path``, a new file after ``archive_bytes`` bytes.

    ``decisions`` has a row for each record that revisits another: ``file`` and ``offset`` of the
    record, ``refers_id`` and ``refers_to``. They are stored first, so that Spark knows their size: small
    ones are broadcast and no archive moves, others meet the packed archives by name. A revisit keeps
    the HTTP head and leaves out the payload. What is no HTTP message becomes a resource of its type.
    """
    per_file = decisions.groupBy("file").agg(F.collect_list(F.struct("offset", "refers_id", "refers_to")).alias("known"))
    per_file = common.stored(per_file, "revisits")
    files = _files(spark, arc).join(per_file, "file", "left").select("file", "content", "known")

    def about(name: str, offset: int) -> bytes:
        info = b"software: siftline\r\nformat: WARC File Format 1.0\r\n"
        stamp = str(uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {name}#{offset}"))
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{stamp}>"), ("WARC-Date", _date(ARCHIVE_DATE))]
        return _warc([*fields, ("Content-Type", "application/warc-fields")], info)

    def records(name: str, packed: bytes, known: dict) -> Iterator[tuple[int, bytes]]:
        for offset, record_id, arc_fields, head, body, _ in _parsed(name, packed):
            other = known.get(offset) if head else None
            kind = "application/http; msgtype=response" if head else arc_fields["Content-type"]
            fields = [
                ("WARC-Type", "revisit" if other else "response" if head else "resource"),
                ("WARC-Record-ID", f"<urn:uuid:{record_id}>"),
                ("WARC-Date", _date(arc_fields["Archive-date"])),
                ("WARC-Target-URI", arc_fields["URL"]),
                ("Content-Type", kind),
                ("WARC-Payload-Digest", f"sha1:{_base32(body)}"),
            ]
            if other:
                fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{other['refers_id']}>")]
                if other["refers_to"] is not None:
                    fields.append(("X-Refers-To-Page-Id", str(other["refers_to"])))
                yield offset, _warc(fields, head)
            else:
                yield offset, _warc([*fields, ("WARC-Block-Digest", f"sha1:{_base32(head + body)}")], head, body)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        archive, n, held = -1, 0, archive_bytes
        for batch in batches:
            for i in range(batch.num_rows):
                known = {d["offset"]: d for d in batch.column("known")[i].as_py() or ()}
                name = batch.column("file")[i].as_py()
                for offset, record in records(name, batch.column("content")[i].as_py(), known):
                    if held >= archive_bytes:
                        archive, n, held = archive + 1, 1, 0
                        yield archive, 0, about(name, offset)
                    yield archive, n, record
                    n, held = n + 1, held + len(record)

    schema = "archive int, n long, record binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(placed(batches), ["archive", "n", "record"], schema)

    _write(F.col("record"), files.mapInArrow(run, schema), path)


def _date(stamp: str) -> str:
    return f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"


def warc_records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each WARC record, by declared length."""
    stream = _Stream(packed)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {stream.offset}")
        lines = [line]
        while (line := stream.line()) is not None and line.strip():
            lines.append(line)
        head = _headers(b"\r\n".join(x.rstrip(b"\r") for x in lines))
        yield head, stream.take(int(head["content-length"]))


def read_warc(spark: SparkSession, path: str, page_id_type: str) -> DataFrame:
    """What the archives say of each page; a response's digest is taken anew and must agree."""
    schema = (
        f"page_id {page_id_type}, payload_bytes long, payload_digest string, record_type string, "
        f"refers_to {page_id_type}, record_id string"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(packed: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(packed):
            if fields["warc-type"] == "warcinfo":
                continue
            resource = fields["warc-type"] == "resource"
            head, _, body = (b"", b"", block) if resource else block.partition(b"\r\n\r\n")
            http, digest = _headers(head), fields["warc-payload-digest"].removeprefix("sha1:")
            whole = resource or fields["warc-type"] == "response"
            if whole and _base32(body) != digest:
                raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
            yield (
                http.get("x-page-id"),
                len(body) if whole else int(http["content-length"]),
                digest,
                fields["warc-type"],
                fields.get("x-refers-to-page-id"),
                fields["warc-record-id"].removeprefix("<urn:uuid:").removesuffix(">"),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batches(rows(batch.column("content")[i].as_py()), names, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_round_trip(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Pages written as ARC, converted to WARC with revisits, and read back from the WARC files.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page id
    (nulls last, then the record id) is the response. Null bodies are empty payloads, repeated rows
    are records of their own, an empty table gives no rows; only the three named columns are used.
    The archives stay in ``folder``, by default a new one in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or common.shared_folder(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    write_arc(pages, f"{folder}/arc", "page_id", "url", "html", archive_bytes)
    slim = read_arc(spark, f"{folder}/arc", kind).where(F.col("payload_bytes") >= min_bytes)
    first = (
        slim.groupBy("payload_digest")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "record_id")).alias("f"))
        .where("n > 1")
        .select("payload_digest", F.col("f.record_id").alias("refers_id"), F.col("f.page_id").alias("refers_to"))
    )
    decisions = slim.select("file", "offset", "record_id", "payload_digest").join(first, "payload_digest")
    convert(spark, f"{folder}/arc", decisions.where("record_id <> refers_id"), f"{folder}/warc", archive_bytes)
    return read_warc(spark, f"{folder}/warc", kind).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
