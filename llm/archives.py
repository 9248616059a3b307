"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

A package is a ZIP file whose members are stored, not compressed:
`archive/data.warc.gz` (each record is one gzip member) and `indexes/index.cdxj` (one line for each
record with its offset and length in that member).  The reader parses the end record, the ZIP64
records where they are needed, and the central directory, finds where the stored members
begin, and reads single records by range.

Packages lie in the shared folder of the session and are reached through `pyarrow.fs`, so any
storage that has a driver there works.  A task writes under a name of its own attempt and moves the
package when it is whole; a task that runs again replaces it by the same records.

*Duplicates.*  Of records with the same payload of at least `min_bytes` bytes, those with the largest
`page_id` are `response`, the others are `revisit` records without a payload that refer to it.

A null html is an empty payload.  A null `page_id` comes before all others, and a record that
refers to one refers to null.  Rows that repeat a payload with the largest id are all `response`; rows that
repeat another id are separate revisits.  A null url is empty.  An empty table gives no package and no
records.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its records have so many bytes.
PACKAGE_BYTES = 64 << 20
#: Records that are next to each other (by this many bytes) are read in one range.
RANGE_BYTES = 4 << 20

_DATE = "2000-01-01T00:00:00Z"


# -- writing ---------------------------------------------------------------------------------------


def warc_record(page: int | None, url: str, payload: bytes, digest: str, refers: tuple | None) -> bytes:
    """One record as a gzip member; `refers` is `(page id,)` for a revisit."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers:
        head.append(f"WARC-Refers-To: <urn:page:{'' if refers[0] is None else refers[0]}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if refers else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + packed.flush()


class Package:
    """Writes one package as a stream; only the index is held, until `close`."""

    def __init__(self, out, zip64: bool = True):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)
        self.at, self.lines = 0, []

    def add(self, record: bytes, url: str, page: int | None, digest: str) -> None:
        self.data.write(record)
        entry = {"url": url, "page": page, "digest": digest, "offset": self.at, "length": len(record)}
        self.lines.append(json.dumps(entry))
        self.at += len(record)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in self.lines))
        self.zip.close()


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write `(page_id, url, html, refers)` and give the paths of the packages, `(path, records)`.

    `refers` is a struct with the id that a revisit refers to, or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top)
        name, number = f"part-{context.partitionId():06d}", 0
        trial = f"trial-{context.taskAttemptId()}"
        package, out, written = None, None, []

        def close():
            nonlocal package, number
            package.close()
            out.close()
            path = f"{top}/{name}-{number:04d}.zip"
            fs.move(f"{top}/{trial}-{name}-{number:04d}", path)
            written.append((path, len(package.lines)))
            package, number = None, number + 1

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "refers"))
            for page, url, html, refers in zip(*columns):
                page, url, html, refers = page.as_py(), url.as_py() or "", (html.as_py() or "").encode(), refers.as_py()
                digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
                if package is None:
                    out = fs.open_output_stream(f"{top}/{trial}-{name}-{number:04d}")
                    package = Package(out)
                package.add(warc_record(page, url, html, digest, refers and (refers["page_id"],)), url, page, digest)
                if package.at >= package_bytes:
                    close()
        if package is not None:
            close()
        paths, counts = zip(*written) if written else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return records.mapInArrow(run, "path string, records long")


# -- reading ---------------------------------------------------------------------------------------


def members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """`name: (start, length, method)` of the members of a ZIP file, from its central directory.

    `file` has `seek` and `read`.  Reads the end of the file, the directory, and the local header of each
    member, never the members.
    """
    span = min(size, 22 + 0xFFFF + 20)
    file.seek(size - span)
    tail = file.read(span)
    # The end record is the last one whose comment ends with the file.
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != span:
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: it has no end record")
    count, length, start = struct.unpack_from("<H I I", tail, at + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", tail, at - 20 + 8)
        file.seek(where)
        end = file.read(56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP file: no ZIP64 end record where it should be")
        count, length, start = struct.unpack_from("<Q Q Q", end, 32)
    file.seek(start)
    directory = file.read(length)
    out, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP file: central directory")
        flags, method = struct.unpack_from("<H H", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<I I H H H", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<H H", extra, k)
            if kind == 1:  # the values that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + n
        file.seek(local)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"damaged ZIP file: no member where {name} should be")
        n_name, n_extra = struct.unpack_from("<H H", head, 26)
        out[name] = (local + 30 + n_name + n_extra, packed, method)
    return out


def _stored(found: dict, name: str) -> tuple[int, int]:
    start, length, method = found[name]
    if method != 0:
        raise ValueError(f"{name} is compressed; only stored members can be read by range")
    return start, length


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record."""
    plain = zlib.decompress(record, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda s: int(s[10:-1]) if s[10:-1] else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": None if fields["WARC-Type"] == "revisit" else body.partition(b"\r\n\r\n")[2],
    }


def read_index(paths: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`(path, start, lengths)`: ranges of neighbouring records in the packages, from their indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as file:
                    found = members(file, file.size())
                    data, _ = _stored(found, DATA)
                    start, length = _stored(found, INDEX)
                    file.seek(start)
                    begin, lengths, size = None, [], 0
                    for line in file.read(length).splitlines():
                        entry = json.loads(line)
                        if begin is None:
                            begin = entry["offset"]
                        lengths.append(entry["length"])
                        size += entry["length"]
                        if size >= range_bytes:
                            rows.append((path, data + begin, lengths))
                            begin, lengths, size = None, [], 0
                    if lengths:
                        rows.append((path, data + begin, lengths))
            columns = zip(*rows) if rows else ((), (), ())
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "start", "lengths"])

    return paths.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(ranges: DataFrame, folder: str) -> DataFrame:
    """The records in the ranges, with the digest and the length checked for those that hold a payload."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths"))):
                with fs.open_input_file(path) as file:
                    file.seek(start)
                    data = file.read(sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    x = parse_record(data[at : at + n])
                    at += n
                    if x["payload"] is not None:
                        digest = base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode()
                        if (len(x["payload"]), digest) != (x["payload_bytes"], x["payload_digest"]):
                            raise ValueError(f"damaged record of page {x['page_id']} in {path}")
                    rows.append(x)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

    return ranges.mapInArrow(run, RECORD)


def package_pages(pages: DataFrame, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write `pages (page_id, url, html)` to packages: `(path, records)` of each, and their folder."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    folder = folder or f"{scratch.folder}/packages"
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    # The largest id of each payload that is there more than once; one row for each.
    same = rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size")
    same = same.agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = rows.join(same.drop("times"), ["sha1", "size"], "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    refers = F.when(revisit, F.struct(F.col("largest").alias("page_id")))
    written = write_packages(rows.select("page_id", "url", "html", refers.alias("refers")), folder, package_bytes)
    return scratch.save(written, "manifest"), folder


def read_packages(paths: DataFrame, folder: str) -> DataFrame:
    """All records of the packages; ranges are dealt over all cores."""
    ranges = read_index(paths, folder)
    return read_records(ranges.repartition(F.xxhash64("path", "start")), folder)
