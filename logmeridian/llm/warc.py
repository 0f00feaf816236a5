"""WARC archives with an embedded Zstandard dictionary: writer and reader.

Each archive file is filled by one task up to ``FILE_BYTES`` of records. A dictionary is built from
records spread evenly over the file, put in front in a skippable frame, and every record is compressed
alone, so any record can be read by itself with the dictionary of its file. Payloads that occur again
are written once, by the row with the largest id; the others are revisit records. Only digests and ids
are compared for that. A file counts only once its row is in the manifest, which Spark commits, so
files of lost or repeated task attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm.storage import arrow_ready, new_folder, shuffle_width, stash, table

FILE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 1 << 20
"""Bytes of records, taken evenly over a file, from which its dictionary is built."""
LEVEL = 3
SALTS = 16
WARC_DATE = "2024-01-01T00:00:00Z"

# The skippable frame that holds a dictionary, and the profile of a revisit record.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE_OR_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _uri(url: str | None) -> str:
    return _SPACE_OR_CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, str | None] | None) -> bytes:
    """One uncompressed record; with ``refers`` (id and URL of the response) a revisit without payload."""
    head = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": WARC_DATE,
        "WARC-Target-URI": _uri(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(refers[0], digest), "WARC-Refers-To-Target-URI": _uri(refers[1])}
        if refers[0] is not None:
            head["X-Refers-To-Page-Id"] = str(refers[0])
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers is None:
        block += payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; the sampled bytes themselves where there are too few for training."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample, size = [], 0
    for one in records[::step]:
        if size + len(one) <= 2 * SAMPLE_BYTES:
            sample.append(one)
            size += len(one)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[:DICTIONARY_BYTES]


def encode_file(records: list[bytes]) -> bytes:
    dictionary = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed, *(press.compress(r) for r in records)])


def decode_file(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        frame, parts = open_.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + 16384]
            if not len(chunk):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        length = int(fields["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
            raise ValueError("malformed record")
        yield fields, rest[:length]


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write one record per row below ``folder``; returns the manifest ``path, records``.

    The payload is the UTF-8 text, null counting as empty; equal payloads of any length share one
    response. Rows equal in id and payload are one response and revisits of it. A null id is smaller
    than all others and stays null; a null URL becomes ``urn:unknown``. Other columns are ignored.
    """
    spark = pages.sparkSession
    arrow_ready(spark)
    rows = (
        pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"))
        .withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    )
    best = (
        rows.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("b"))
        .select("sha", F.col("b.id").alias("to_id"), F.col("b.url").alias("to_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    dealt = rows.repartition(shuffle_width(spark), "sha", "salt")
    tagged = dealt.join(best, ["sha", "salt"]).select("id", "url", "payload", "sha", "to_id", "to_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        records, size, written = [], 0, set()

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(encode_file(records))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                digest = base32(row["sha"])
                response = row["id"] == row["to_id"] and (row["id"], digest) not in written
                if response:
                    written.add((row["id"], digest))
                one = encode_record(row["id"], row["url"], row["payload"].encode(), digest, None if response else (row["to_id"], row["to_url"]))
                records.append(one)
                size += len(one)
                if size >= FILE_BYTES:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    return stash(tagged.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload`` of every record.

    The digest of each response is computed anew and must match. A revisit has a null payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        number = lambda v: None if v is None else int(v)
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as stream:
                    data = stream.read()
                rows, seen = [], 0
                for head, block in decode_file(data):
                    seen += 1
                    payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and base32(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"payload digest differs in {path}")
                    size = int(head["X-Payload-Length"]) if payload is None else len(payload)
                    rows.append((number(head.get("X-Page-Id")), head["WARC-Target-URI"], head["WARC-Type"], digest, size, number(head.get("X-Refers-To-Page-Id")), payload))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if seen != count:
                    raise ValueError(f"{path} has {seen} records, the manifest says {count}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    width = shuffle_width(manifest.sparkSession)
    return manifest.repartition(width).mapInArrow(
        run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
