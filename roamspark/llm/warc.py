"""WARC archives in Zstandard: a writer and a reader that work on archives as rows of bytes.

An archive is one leading skippable frame (magic 0x184D2A5D) with the dictionary, then one frame for each record. Without a dictionary
(too few sample bytes to train one) the skippable frame is left out, and the reader takes both kinds.
Archives are rows (archive, content), so that any store that Spark reads and writes can hold them; files of the format
are read through Spark's binaryFile source, whose path and content columns are those that read_archives takes.

Records: of equal payloads (SHA-256 and length) that with the smallest page id is a response, the others are revisits of it; payloads
of fewer than MIN_REVISIT bytes are all responses. A response's block is an HTTP head and the payload; a revisit's is the head alone, whose
Content-Length tells the length of the full payload, as WARC-Payload-Digest tells its digest.

The reader checks, and raises ValueError where they fail: frame magic and block structure, one whole record to a frame, the version line, header
syntax, the named fields, Content-Length against the block, and the digests of block and payload.

Defined results: a null or empty payload is an empty one; rows that share payload and least page id are all responses; a null id is never the least, unless
all of a payload's ids are null, which are responses then; an empty table gives no archives and no rows; columns besides id, url and payload are neither read nor returned; a payload of any length is one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
MIN_REVISIT = 0
LEVEL = 3
#: An archive is closed when it holds so many compressed bytes.
ARCHIVE_BYTES = 4 << 20
#: The dictionary is trained on the first SAMPLE_BYTES of each of at most SAMPLES payloads, those with the least hash of their id.
SAMPLES, SAMPLE_BYTES, DICT_BYTES = 256, 8192, 32 << 10
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*\Z")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or no bytes where the samples are too few or too short."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False) -> bytes:
    """The bytes of one record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    uri = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record, checked, with its payload (None of a revisit) and the payload's length."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"no WARC version line: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        if not (m := _FIELD.match(line)):
            raise ValueError(f"bad header line: {line[:60]!r}")
        fields[m[1].decode().lower()] = m[2].decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {fields['content-length']} does not fit a block of {len(rest) - 4} bytes")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not told:
        raise ValueError("no HTTP Content-Length")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != int(told[1]) or fields.get("warc-payload-digest") != f"sha1:{sha1_base32(payload)}"):
        raise ValueError("payload differs from its length or digest")
    return fields | {"payload": None if revisit else payload, "payload_bytes": int(told[1])}


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at a place ends, by its block headers."""
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError(f"no frame at byte {at}")
    checksum = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        if at + 3 > len(data):
            raise ValueError("frame cut short")
        word = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)  # a run-length block holds one byte
        if word & 1:
            if at + 4 * checksum > len(data):
                raise ValueError("frame cut short")
            return at + 4 * checksum


def records_of(content: bytes) -> Iterator[dict]:
    """The parsed records of one archive, a frame at a time."""
    at, known = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", content, 4)[0]
        if at > len(content):
            raise ValueError("dictionary cut short")
        body = content[8:at]
        if body[:4] == struct.pack("<I", FRAME):
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=64 << 20)
        known = zstandard.ZstdCompressionDict(body)
    decoder = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(content):
        end = frame_end(content, at)
        yield parse(decoder.decompress(content[at:end]))
        at = end


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, and the first page of each payload. Only digests are grouped; a hot digest is summed before the shuffle and its join can be split."""
    page = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    page = page.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "n_bytes": F.length("payload").cast("long")})
    first = page.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    out = page.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of planned() rows: archive (name), content (bytes)."""
    shared = records.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head = archive_head(shared.value)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None, write_checksum=True)
        part, number = TaskContext.get().partitionId(), 0
        frames, held = [head], len(head)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.zst"]), pa.array([b"".join(frames)], pa.binary())], names=["archive", "content"])

        for b in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                frames.append(packer.compress(record(page_id, url, payload, refers_to, revisit)))
                held += len(frames[-1])
                if held >= archive_bytes:
                    yield closed()
                    number, frames, held = number + 1, [head], len(head)
        if len(frames) > 1:
            yield closed()

    return records.mapInArrow(kit.tidy(run), "archive string, content binary")


READ = "archive string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (archive or path, content), every one validated."""
    name = "archive" if "archive" in archives.columns else "path"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [
                    (name, r["warc-type"], r["warc-record-id"], r.get("warc-target-uri"), r.get("warc-refers-to"), r["payload_bytes"], r.get("warc-payload-digest", "").removeprefix("sha1:"), r["payload"] if with_payload else None)
                    for r in records_of(content.as_py())
                ]
                columns = list(zip(*rows)) if rows else [[]] * 8
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: 8 if with_payload else 7], names=[*(x.split()[0] for x in READ.split(", ")), "payload"][: 8 if with_payload else 7])

    return archives.select(F.col(name).alias("archive"), "content").mapInArrow(kit.tidy(run), READ + (", payload binary" if with_payload else ""))


def dictionary_for(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    ids = pages.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLES).distinct()
    body = F.substring(F.col(payload_col).cast("binary"), 1, SAMPLE_BYTES)
    sample = pages.select(F.col(id_col).alias("id"), body.alias("b")).where("b is not null").join(F.broadcast(ids), "id", "left_semi").limit(4 * SAMPLES)
    return train(sorted(bytes(r.b) for r in sample.select("b").collect())[:SAMPLES])


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = kit.read_table(spark, sf_dir, "pages")
    archives = kit.staged(write_archives(planned(pages), dictionary_for(pages)), "warc")
    page = lambda c: F.expr(f"cast(nullif(regexp_extract({c}, '^<urn:page:(.*)>$', 1), '') as long)")
    return read_archives(archives).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def warc_records(spark, sf_dir: str) -> DataFrame:
    """op7_warc with -1 for no reference, as drivers differ in how they show a missing number."""
    return op7_warc(spark, sf_dir).withColumn("refers_to", F.coalesce("refers_to", F.lit(-1).cast("long")))


#: The records as SQL: SHA-1 as 160 bits, five to a sign.
ORACLE = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT DISTINCT h, list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), lambda a, b: a || b) AS bits FROM p),
b AS (SELECT h, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), lambda a, b: a || b) AS digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first ELSE -1 END AS refers_to FROM f JOIN b USING (h)
"""
