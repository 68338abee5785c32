"""WARC archives of Zstandard frames: written from pages with revisits for equal payloads, read back and validated.

An archive starts with a skippable frame that holds its dictionary, followed by one Zstandard frame per record. Archives
are rows (archive, content) of a table, so any store that Spark can write to holds them; read_archives() also takes
rows of Spark's binaryFile source.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import in_place, materialise, small, tidy

#: Magic numbers: the dictionary's skippable frame, a Zstandard frame, and the mask of all skippable frames.
DICTIONARY_FRAME, ZSTD_FRAME, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, 0x184D2A50
#: Bytes of records in an archive, of a dictionary, and of the records that it is trained from.
ARCHIVE, DICTIONARY, TRAINING = 8 << 20, 16 << 10, 512 << 10
#: Bytes that a record, and a dictionary, may inflate to.
MOST, MOST_DICTIONARY = 1 << 28, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response, or with `refers_to` a revisit, whose block ends after the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = f"urn:page:{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url}#{digest}").urn
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """The archive of some records; without a dictionary where there is too little to train one from."""
    sample, size = [], 0
    for r in records:
        if size >= TRAINING:
            break
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY, size // 4), sample)
    except (zstandard.ZstdError, ValueError):
        trained = None
    c = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    out = []
    if trained is not None:
        body = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
    return b"".join([*out, *map(c.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame at `at`, by its header and block sizes."""
    descriptor = data[at + 4]
    single = descriptor >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[descriptor >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("truncated frame")
        head = int.from_bytes(data[at : at + 3], "little")
        last = bool(head & 1)
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    at += 4 * (descriptor >> 2 & 1)
    if at > len(data):
        raise ValueError("truncated frame")
    return at


def inflate(frame: bytes, d: zstandard.ZstdDecompressor, most: int) -> bytes:
    """The content of a frame; ValueError beyond `most` bytes, before more than that is held."""
    said = zstandard.get_frame_parameters(frame).content_size
    unknown = said == zstandard.CONTENTSIZE_UNKNOWN
    if not unknown and said > most:
        raise ValueError(f"a frame of more than {most} bytes")
    if not unknown:
        return d.decompress(frame)
    parts, size = [], 0
    with d.stream_reader(frame) as reader:
        while part := reader.read(1 << 20):
            parts.append(part)
            size += len(part)
            if size > most:
                raise ValueError(f"a frame of more than {most} bytes")
    return b"".join(parts)


def _whole(text: str | bytes) -> int:
    """A number of 64 bits; ValueError for any other text."""
    if not re.fullmatch(r"-?[0-9]{1,19}", text if isinstance(text, str) else text.decode("ascii")) or not -(2**63) <= (n := int(text)) < 2**63:
        raise ValueError("a number beyond 64 bits, or none")
    return n


def parse_record(data: bytes) -> dict:
    """The fields of a record; raises ValueError where headers, numbers, lengths or the payload's digest don't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    if len(fields) != len(lines) - 1:
        raise ValueError("a header line is malformed or repeated")
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise ValueError(f"no {k}")
    n = _whole(fields["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("content-length differs from the block")
    kind = fields["warc-type"]
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not gap or not length or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = _whole(length[1])
    scheme, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if scheme != "sha1":
        raise ValueError("no payload digest")
    digest = base64.b32decode(digest)
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without a target")
    number = lambda name: _whole(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return {"record_id": fields["warc-record-id"], "page_id": number("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": number("warc-refers-to"), "payload_bytes": length, "payload_digest": digest.hex(), "payload": payload if kind == "response" else None, "error": None}


def parse_archive(content: bytes, most: int = MOST) -> Iterator[dict]:
    """The records of an archive. A record that doesn't hold, or inflates to more than `most` bytes, is a row with only `error`; a broken frame ends the archive so."""
    data, at, trained = memoryview(content), 0, None
    bad = lambda e: dict.fromkeys([f.split()[0] for f in RECORD.split(", ")]) | {"error": f"{type(e).__name__}: {e}"}
    d = zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            if at + 8 > len(data):
                raise ValueError("truncated frame")
            magic, size = struct.unpack("<II", data[at : at + 8])
            if magic & 0xFFFFFFF0 == SKIPPABLE:
                if at + 8 + size > len(data):
                    raise ValueError("truncated frame")
                if at == 0 and magic == DICTIONARY_FRAME:
                    body = bytes(data[8 : 8 + size])
                    if body[:4] == struct.pack("<I", ZSTD_FRAME):
                        body = inflate(body, zstandard.ZstdDecompressor(), MOST_DICTIONARY)
                    trained = zstandard.ZstdCompressionDict(body)
                    d = zstandard.ZstdDecompressor(dict_data=trained)
                at += 8 + size
                continue
            if magic != ZSTD_FRAME:
                raise ValueError("not a Zstandard frame")
            end = frame_end(data, at)
        except (ValueError, IndexError, zstandard.ZstdError) as e:
            yield bad(e)
            return
        try:
            yield parse_record(inflate(bytes(data[at:end]), d, most))
        except (ValueError, zstandard.ZstdError) as e:
            yield bad(e)
        at = end


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{k:05d}.warc.zst"], "content": pa.array([build_archive(held)], pa.binary())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(build_record(*row, date))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
                    k, held, size = k + 1, [], 0
        if held:
            yield flush()

    return run


def with_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least `least` bytes the largest id is a response, others refer to it.

    Payloads are equal when their SHA-256 digests are. Only ids and digests are shuffled; what a copy refers to is sent to
    the table that holds it.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = p.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    held = in_place(keyed, "warc-pages", keyed.count())
    narrow = held.where("key is not null").select("sender", "rid", "page_id", "key")
    top = materialise(narrow.groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("key", "top"), "warc-copies")
    refers = narrow.join(small(top), "key").where(~F.col("page_id").eqNullSafe(F.col("top"))).select("sender", "rid", F.col("top").alias("refers_to"))
    refers = materialise(refers, "warc-refers")
    return held.join(refers.hint("shuffle_hash"), ["sender", "rid"], "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, least: int = 1000, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(archive, content): a record per row of `pages`, in archives of some MB.

    Null payloads count as empty. A row without an id becomes a record named by its URL and digest, never the one that
    others refer to; rows that repeat the largest id of a group are all responses. An empty table gives no archives.
    """
    return with_revisits(pages, least, id_col, url_col, payload_col).mapInArrow(tidy(_write(date)), "archive string, content binary")


def _read(payloads: bool, most: int):
    schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, held, size = batch.column(0)[i].as_py(), [], 0
                for r in parse_archive(batch.column(1)[i].as_py() or b"", most):
                    if not payloads:
                        r["payload"] = None
                    held.append({"archive": name, **r})
                    size += len(r["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content", payloads: bool = True, most: int = MOST) -> DataFrame:
    """The records of archives, one row each (see RECORD); `error` tells what is wrong with one, also where it inflates to more than `most` bytes. Null contents hold none."""
    return archives.select(F.col(name_col).alias("archive"), F.col(content_col).alias("content")).mapInArrow(tidy(_read(payloads, most)), f"archive string, {RECORD}")
