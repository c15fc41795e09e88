"""Operator 1, WARC in seekable Zstandard bundles.

Records are grouped into frames of about FRAME bytes, each compressed on its own; a file ends with the seek table of the
seekable Zstandard format (a skippable frame). The index, written by Spark and so listing only files of tasks that
succeeded, maps every record to (file, frame, offset in the frame's bytes, length). Reading opens one frame at a time.

Defined cases: a null payload is the empty payload; a null url is written as an empty target URI; of records with equal
payloads of ``revisit_from`` bytes or more, that with the smallest id (a null id last) is a response and the others
revisit it, repeated rows of that id included; shorter payloads are always responses; other columns are ignored; an
empty table makes an empty index and no file.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, filesystem, new_folder, stage, table

#: Uncompressed bytes of a frame, about; a record is never split, so one longer than this has a frame of its own.
FRAME = 1 << 20
#: Compressed bytes after which a task begins another file.
FILE = 256 << 20
INDEX = "record_id long, file string, frame int, frame_at long, frame_bytes long, frame_size long, offset long, length long"

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1


def _clean(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def encode_record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, spare_id: str = "") -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's digest and length stand in the header."""
    name = str(record_id) if record_id is not None else f"null{spare_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length and content disagree")
    return fields, rest[:size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: (compressed, uncompressed) bytes of each."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, uncompressed) of each frame of an open seekable file."""
    file.seek(0, io.SEEK_END)
    end = file.tell()
    file.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", file.read(8 * count))
    out, at = [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """Writes one seekable file; rows() are its index rows once closed."""

    def __init__(self, folder: str, frame: int = FRAME) -> None:
        self.name, self.frame = f"{folder}/{uuid.uuid4().hex}.warc.zst", frame
        fs, path = filesystem(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.frames, self.open_rows, self.done, self.parts, self.size = fs.open_output_stream(path, compression=None), 0, [], [], [], [], 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, record_id, record: bytes) -> None:
        self.open_rows.append((record_id, self.size, len(record)))
        self.parts.append(record)
        self.size += len(record)
        if self.size >= self.frame:
            self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        packed = self.packer.compress(b"".join(self.parts))
        self.out.write(packed)
        self.done += [(i, self.name, len(self.frames), self.at, len(packed), self.size, o, n) for i, o, n in self.open_rows]
        self.frames.append((len(packed), self.size))
        self.at, self.parts, self.open_rows, self.size = self.at + len(packed), [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.done


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 5]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _writer(folder: str, frame: int):
    def run(batches):
        bundle, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                n += 1
                bundle = bundle or Bundle(folder, frame)
                bundle.add(row["id"], encode_record(row["id"], row["url"], (row["payload"] or "").encode("utf-8", "surrogatepass"), row["digest"], row["refers_to"], row["revisit"], f"-{uuid.uuid4().hex}"))
                if bundle.at >= FILE:
                    yield _rows(bundle.close())
                    bundle = None
        if bundle:
            yield _rows(bundle.close())
    return run


def write_archives(pages: DataFrame, revisit_from: int = 100, frame: int = FRAME, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the index, one row a record."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # Only payloads with copies are joined to anything; the groups are a small part of the digests.
    first = stage(first.where("copies > 1"), "first")
    rows = attach(rows, first, "digest", "copies", F.struct("id", "url"))
    # One response a group: of rows with the first id the others are repeats, and revisit it too.
    repeats = rows.where("id = first").groupBy("digest").count().where("count > 1")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("first")))
    if not stage(repeats, "repeats").isEmpty():
        from pyspark.sql import Window

        own = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.col("url").asc_nulls_last()))
        again = rows.where("id = first").withColumn("__n", own).withColumn("revisit", F.col("__n") > 1).withColumn("refers_to", F.when(F.col("__n") > 1, F.col("id"))).drop("__n")
        rows = rows.where("first is null or id is null or id <> first").unionByName(again)
    return stage(rows.select("id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(_writer(folder, frame), INDEX), "warc-index")


def _reader(batches):
    unpacker = zstandard.ZstdDecompressor()
    held, data, source, opened = None, b"", None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            at = (row["file"], row["frame_at"])
            if at != held:
                if opened != row["file"]:
                    if source:
                        source.close()
                    fs, path = filesystem(row["file"])
                    source, opened = fs.open_input_file(path), row["file"]
                source.seek(row["frame_at"])
                data, held = unpacker.decompress(source.read(row["frame_bytes"]), max_output_size=row["frame_size"]), at
            fields, block = decode_record(data[row["offset"]:row["offset"] + row["length"]])
            revisit = fields["WARC-Type"] == "revisit"
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(block).hexdigest()
            name = fields["WARC-Record-ID"][len("<urn:page:"):-1]
            refers = fields.get("WARC-Refers-To")
            out.append((None if name.startswith("null") else int(name), int(fields["WARC-Payload-Length"]) if revisit else len(block), digest, fields["WARC-Type"],
                        int(refers[len("<urn:page:"):-1]) if refers else None, fields["WARC-Target-URI"], None if revisit else block))
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=True)],
                                  ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that the index names, read back from their frames; a subset of the index reads only its frames."""
    out = index.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
    return out if payload else out.drop("payload")


def op1_warc_bundles(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
