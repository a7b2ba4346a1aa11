"""Dictionary-compressed WARC archives.

Each page becomes a WARC/1.1 record with an HTTP head and, for a response, the page's
bytes; every record is a Zstandard frame of its own, so it can be read alone. The
dictionary is trained on records of a bounded sample (about ``SAMPLE`` pages, drawn by
the hash of their id, of at most ``SAMPLE_BYTES``) and leads every file in a skippable frame.

Files are written by Spark's text sink, whose rows here are raw frames and whose line
separator is an empty skippable frame, so a file is a plain sequence of frames. They go
to any file system that Spark writes, through its commit protocol: a lost executor
leaves no half archive. The sink starts a new file after a fixed number of records, about
``FILE_BYTES`` of payload by the mean, whatever the session asks for; the writer counts along
and leads each file with the dictionary and a warcinfo record. Files are read back as
binary files, so a reader's memory is one file and one record.

Of records with equal payloads (of at least ``min_bytes``), those with the smallest
page_id are responses and all others are revisits that refer to it, without payload.

Rows: null html is an empty payload; rows that repeat page_id and payload are alike,
all responses if theirs is the smallest id; a null page_id is never the smallest unless
it is the only one; a null url is left out. Every record has an id of its own: revisits
and what repeats a response add a random fragment to the page's.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import hash_below, materialise, scratch_dir

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"  # skippable frame that holds a WARC dictionary
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"  # empty skippable frame
TRAINED_MAGIC = b"\x37\xa4\x30\xec"
LEVEL = 6
DICTIONARY_BYTES = 64 << 10
SAMPLE, SAMPLE_BYTES = 512, 64 << 10
FILE_BYTES = 256 << 20
SOFTWARE = b"software: tessella\r\nformat: WARC File Format 1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str | None = None, fragment: str = ""
) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP head, with the full length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}{fragment}>",
        f"WARC-Date: {date or now()}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(date: str) -> bytes:
    """The record that leads a file."""
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(SOFTWARE)}\r\n\r\n".encode() + SOFTWARE + b"\r\n\r\n"


def parse(raw: bytes) -> dict | None:
    """Fields of a record, None of warcinfo; of a response the payload's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda f: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)(?:#[0-9a-f]+)?>", fields.get(f, ""))) else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest,
        "payload_bytes": size, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None,
    }


def _held(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    if not dictionary:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == TRAINED_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(dictionary, dict_type=kind)


def skippable(magic: bytes, content: bytes) -> bytes:
    return magic + len(content).to_bytes(4, "little") + content


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; too few samples serve as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def frames(content: bytes) -> Iterator[bytes]:
    """The decompressed records of one file; its memory is the file and one record."""
    view, at, dictionary = memoryview(content), 0, b""
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic[1:] == DICTIONARY_MAGIC[1:] and 0x50 <= magic[0] <= 0x5F:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                dictionary = bytes(view[at + 8 : at + 8 + size])
                reader = zstandard.ZstdDecompressor(dict_data=_held(dictionary))
            at += 8 + size
            continue
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            part = view[at : at + (1 << 15)]
            if not len(part):
                raise ValueError("a frame is cut short")
            out.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data if frame.eof else b"")
        yield b"".join(out)


def _writer(dictionary: bytes, date: str, records: int):
    """Over rows (page_id, url, html, refers_to, revisit, alone): a row of frames for each; every
    ``records``-th row from a task's first one starts a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(dictionary)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
        lead = [skippable(DICTIONARY_MAGIC, dictionary)] if held else []
        done = 0
        for batch in batches:
            out = []
            for page_id, url, html, refers_to, revisit, alone in zip(*batch.columns):
                fragment = "" if alone.as_py() else f"#{uuid.uuid4().hex}"
                raw = record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), refers_to.as_py(), revisit.as_py(), date, fragment)
                frame = press.compress(raw)
                if done % records == 0:
                    frame = SEPARATOR.encode("latin-1").join([*lead, press.compress(info(date)), frame])
                done += 1
                out.append(frame)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``, which must not exist."""
    date = date or now()
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.unhex(F.sha1(html)).alias("digest"),
    )
    times = keyed.filter(F.octet_length("html") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    copies = materialise(
        times.groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.min_by("n", "page_id").alias("firsts"), F.sum("n").alias("n"))
        .filter("n > 1")
        .select("digest", "first_id", "firsts")
    )
    count, held = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    sample = (
        keyed.filter(hash_below(F.xxhash64("page_id"), SAMPLE, count))
        .filter(F.octet_length("html") <= SAMPLE_BYTES)
        .select("page_id", "url", "html")
        .limit(2 * SAMPLE)
        .collect()
    )
    dictionary = train([record(r.page_id, r.url, r.html.encode("utf-8", "replace"), None, False, date) for r in sample]) if sample else b""
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    alone = F.col("page_id").isNotNull() & ~later & (F.coalesce("firsts", F.lit(1)) == 1) & (F.octet_length("html") >= min_bytes)
    rows = keyed.join(copies, "digest", "left").select(
        "page_id", "url", "html", F.when(later, F.col("first_id")).alias("refers_to"), later.alias("revisit"), alone.alias("alone")
    )
    records = max(1, int(file_bytes * count // held)) if held else 1 << 20
    packed = rows.mapInArrow(_writer(dictionary, date, records), "frame binary").select(F.col("frame").cast("string").alias("value"))
    packed.write.option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", records).text(folder)
    _rename(pages.sparkSession, folder)


def _rename(spark: SparkSession, folder: str) -> None:
    """part-*.txt becomes part-*.warc.zst; files without a frame go."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def settle(status) -> None:
        name = status.getPath().getName()
        if name.startswith("part-") and status.getLen() == 0:
            fs.delete(status.getPath(), False)
        elif name.startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.zst"))

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(settle, fs.listStatus(path)))


FIELDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _reader(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(
            ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"),
            (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()),
        ) if n in names])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in frames(content.as_py()):
                    found = parse(raw)
                    if found is None:
                        continue
                    rows.append({n: found[n] for n in schema.names})
                    size += len(raw) if "payload" in names else 200
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each record of the archives in ``folder``: ``FIELDS`` or those of ``columns``.
    Payloads of responses are checked against their digests in any case."""
    fields = [f for f in FIELDS.split(", ") if columns is None or f.split()[0] in columns]
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_reader([f.split()[0] for f in fields]), ", ".join(fields))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder, read everything back, remove the archives."""
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    try:
        archive(pages, folder, min_bytes)
        return materialise(read_archives(spark, folder, columns)).select(*columns)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
