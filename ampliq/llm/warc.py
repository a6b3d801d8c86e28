"""Dictionary-compressed WARC archives.

Each archive begins with a skippable frame (magic 0x184D2A5D) that embeds a Zstandard dictionary built from its first
records; every record is a Zstandard frame of its own, compressed with that dictionary. Spark's text writer lays the
frames down, so its commit protocol covers lost and repeated tasks on any file system: its line separator is an empty
skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded, fresh_path, short_batches, written

#: Magic numbers of the Zstandard format, and of the dictionary frame of zstd-compressed WARC.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame; it parts the frames of a file.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
#: A dictionary is built from the first records of an archive, up to so many bytes, and has at most so many itself.
TRAIN_BYTES, DICTIONARY_BYTES = 1 << 20, 64 << 10
#: Bytes handed to the decompressor at once.
STEP = 1 << 16
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits are attached to pages by id and digest; a date isn't in the data.
DATE = "1970-01-01T00:00:00Z"


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to: of equal payloads of at least ``least`` bytes the largest page_id is
    stored, others refer to it. Null html is an empty payload. Rows that share the largest page_id are all stored; a null
    page_id is always stored. Only ids and digests are grouped; pages stay where they are unless revisits are too many to broadcast.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digests = written(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n"))
                      .where((F.col("n") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    groups = written(digests.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1"), "payloads")
    again = attach(digests, groups, "digest", "size", digests.count()).where("page_id < last")
    again = bounded(written(again.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("last").alias("refers_to")).distinct(), "revisits"))
    with_digest = rows.withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    same = (F.col("page_id") == F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest"))
    return with_digest.join(again, same, "left").select("page_id", "url", "html", "payload_digest", "refers_to")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps no payload but its length and digest."""
    name = lambda page: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{digest}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name(page_id)}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the sampled records; None where they are too few or too alike to build one."""
    try:
        made = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples, k=1024, d=8)
    except zstandard.ZstdError:
        return None
    made.precompute_compress(level=3)
    return made


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive, in order; memory holds the training records."""
    held: list[bytes] = []
    size, press = 0, None

    def flush() -> Iterator[bytes]:
        nonlocal press
        chunk = 4096  # long records are sampled as pieces, as a dictionary serves the beginning of each frame most
        made = train([r[i:i + chunk] for r in held for i in range(0, len(r), chunk)])
        press = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True) if made else zstandard.ZstdCompressor(level=3, write_checksum=True)
        if made:
            raw = made.as_bytes()
            yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
        yield from map(press.compress, held)

    for r in records:
        if press is None:
            held.append(r)
            size += len(r)
            if size >= TRAIN_BYTES:
                yield from flush()
                held = []
        else:
            yield press.compress(r)
    if press is None and held:
        yield from flush()


def _write_part(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in part:
            html = batch.column("html").cast(pa.binary())
            for i in range(len(batch)):
                yield record_bytes(batch.column("page_id")[i].as_py(), batch.column("url")[i].as_py(), html[i].as_py(), batch.column("payload_digest")[i].as_py(), batch.column("refers_to")[i].as_py())

    held: list[bytes] = []
    size = 0
    for frame in frames(records()):
        held.append(frame)
        size += len(frame)
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])


def write_archives(records: DataFrame, path: str | None = None) -> str:
    """Writes ``records`` (page_id, url, html, payload_digest, refers_to), one archive per partition; returns the folder.

    Archives are as large as the input's partitions (spark.sql.files.maxPartitionBytes), so a reader can hold one.
    """
    spark = records.sparkSession
    short_batches(spark)
    path = path or fresh_path(spark, "warc")
    out = records.mapInArrow(_write_part, "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(path)
    return path


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, by walking its frames."""
    at, dictionary = 0, None
    view = memoryview(data)
    press = zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC and at == 0:
                dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
                press = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            one, pieces = press.decompressobj(), []
            while not one.eof:
                if at >= len(data):
                    raise ValueError("the archive ends within a frame")
                pieces.append(one.decompress(view[at:at + STEP]))
                at = min(at + STEP, len(data))
            at -= len(one.unused_data)
            head, _, rest = b"".join(pieces).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
            yield headers, rest[:int(headers["Content-Length"])]
        else:
            raise ValueError(f"no frame at byte {at}")


def _read_part(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "verified"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    for batch in part:
        for data in batch.column("content"):
            rows = []
            for h, block in parse_archive(data.as_py()):
                payload = block.partition(b"\r\n\r\n")[2]
                size, digest, stored = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "response"
                if stored:  # what is told about a stored payload is what was read
                    read = (len(payload), hashlib.sha1(payload).hexdigest())
                    if read != (size, digest):
                        raise ValueError(f"record {h.get('WARC-Record-ID', '')}: payload read as {read}, written as {(size, digest)}")
                rows.append((int(h["X-Page-Id"]) if "X-Page-Id" in h else None, size, digest, h["WARC-Type"],
                             int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, h.get("WARC-Target-URI", ""), stored))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified of each record in the archives of a folder.

    Length and digest of every stored payload are computed from what was read; a record whose header says otherwise stops the job.
    ``verified`` is true for these, false for a revisit, which stores no payload and repeats its response's. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_read_part, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, verified boolean")
