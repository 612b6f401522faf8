"""WARC archives: monolithic gzip files, normalised to a member per record with an offset index.

Pages are written as WARC records into files that are one gzip stream each. The normaliser
inflates such a file once, rewrites every record as a gzip member of its own and writes the
members' places to an index beside it, so that one record can be read without the others.

Files go to a folder all executors reach, under names no other attempt uses; a file counts
once the table that names it is written, so a lost task leaves no half-read archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import arrow_schema, keep, per_batch, ship
from tramline.sources.store import shared_folder

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
GZIP = 31  # zlib's window size for a gzip wrapper
LEVEL, READ, FILE_BYTES = 4, 1 << 20, 64 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.strip("<>").rsplit(":", 1)[1]
    return None if number == "null" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` that holds the HTTP head only.

    Blanks and other characters a header cannot hold are percent-encoded in the URL.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url:
        fields.insert(2, ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into records; holds one record and one chunk at a time."""
    buffer = bytearray()
    need = None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = bytes(buffer[:end]).decode().split("\r\n")
                size = next(int(v) for k, v in (x.split(": ", 1) for x in lines[1:]) if k == "Content-Length")
                need = end + 4 + size + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("archive ends within a record")


def _inflated(source) -> Iterator[bytes]:
    """Chunks of a gzip file's content, member after member."""
    inflate = zlib.decompressobj(GZIP)
    while data := source.read(READ):
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
    yield inflate.flush()


def _gzip():
    return zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)


def _files(folder: str):
    """The file system of a folder's address, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) into files of one gzip stream each; ``path`` and ``records`` of each.

    A task closes a file at ``file_bytes`` of records and starts the next.
    """
    ship(rows.sparkSession)
    schema = "path string, records long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out = squeeze = None
        size = count = 0

        def close() -> None:
            out.write(squeeze.flush())
            out.close()
            done.append((path, count))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, size, count = files.open_output_stream(path, compression=None), _gzip(), 0, 0
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out.write(squeeze.compress(data))
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records"]).cast(arrow_schema(schema))

    return rows.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInArrow(run, schema)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive (``path``) with a gzip member per record, and an index of JSON lines
    (offset, length, record id) beside it: ``path``, ``index_path`` and ``records`` of the new files."""

    def run(cols: dict) -> dict:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        out: dict = {"path": [], "index_path": [], "records": []}
        for path in cols["path"]:
            new = f"{root}/{uuid.uuid4().hex}.warc.gz"
            offset = count = 0
            with (
                files.open_input_stream(path, compression=None) as source,
                files.open_output_stream(new, compression=None) as target,
                files.open_output_stream(new + ".idx", compression=None) as index,
            ):
                for data in records_of(_inflated(source)):
                    squeeze = _gzip()
                    member = squeeze.compress(data) + squeeze.flush()
                    target.write(member)
                    name = parse(data)[0]["WARC-Record-ID"]
                    index.write(json.dumps({"offset": offset, "length": len(member), "id": name}).encode() + b"\n")
                    offset, count = offset + len(member), count + 1
            out["path"].append(new)
            out["index_path"].append(new + ".idx")
            out["records"].append(count)
        return out

    return per_batch(archives.select("path"), run, "path string, index_path string, records long")


READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each inflated on its own at the place the index names.

    The digest of a response is taken anew from its payload and must be the one it names.
    """
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(READ_BACK)
        for batch in batches:
            files, _ = _files(folder)
            for path, index_path in zip(*(batch.column(i).to_pylist() for i in range(2))):
                rows: list[tuple] = []
                with files.open_input_file(path) as archive, files.open_input_stream(index_path, compression=None) as index:
                    for line in _lines(index):
                        place = json.loads(line)
                        archive.seek(place["offset"])
                        rows.append(_row(zlib.decompress(archive.read(place["length"]), GZIP), place["id"]))
                        if len(rows) == 5000:
                            yield _batch(rows, kinds)
                            rows = []
                if rows:
                    yield _batch(rows, kinds)

    return archives.select("path", "index_path").mapInArrow(run, READ_BACK)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(READ):
        *lines, rest = (rest + data).split(b"\n")
        yield from lines


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


def _row(data: bytes, name: str) -> tuple:
    fields, http, payload = parse(data)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Record-ID"] != name:
        raise ValueError(f"the index names {name}, the record {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response" and (payload_digest(payload) != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"payload of {name} is damaged")
    refers = fields.get("WARC-Refers-To")
    return _page(name), int(http["Content-Length"]), digest, fields["WARC-Type"], _page(refers) if refers else None


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id with an equal payload, NULL for that itself.

    NULL html is an empty payload, and empty payloads equal each other. Rows that share the
    smallest page_id are all responses. A NULL page_id is never the smallest; where only such
    rows have a payload, all are responses.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    narrow = pages.select(F.col("page_id").cast("long").alias("_page"), digest.alias("_digest"))
    firsts = narrow.groupBy("_digest").agg(F.min("_page").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = narrow.distinct().join(firsts, "_digest").where("_first IS NOT NULL AND NOT (_page <=> _first)")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("_own"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_own") == F.col("_digest"))
    return rows.join(later, same, "left").select("page_id", "url", "html", F.col("_first").alias("refers_to"))


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, normalise them, and return what they hold:
    page_id, payload_bytes, payload_digest, record_type, refers_to, one row per page."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    written = keep(write_archives(with_first(pages), f"{folder}/whole"), "archives")
    files = max(1, written.count())
    better = keep(normalise(written.repartition(files, "path"), f"{folder}/records"), "normalised")
    return read_back(better.repartition(files, "path"), f"{folder}/records")
