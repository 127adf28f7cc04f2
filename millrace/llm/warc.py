"""WARC archives in seekable Zstandard bundles.

Records are gathered into frames of about ``frame_bytes``, each an independent Zstandard frame; a bundle ends with the
public seekable format's footer (a skippable frame that lists every frame's compressed and plain size). The record map
gives for each record its bundle, frame, the frame's place in the bundle and the record's place in the frame, so one
record is read with one range read and one frame's decompression. Bundles are closed at about ``bundle_bytes``.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id is a response, the
others are revisits that refer to it and carry no payload. The pairs come from two aggregations over 32-byte digests; the
html is shuffled once, by page, so a payload that a third of all pages share is no hot key.

Null html: an empty payload. Rows equal in page_id and payload are the same capture: if theirs is the smallest id, each is
a response. Null page_id: kept, never referred to. Null url: the record names the page by its id. Empty table: no
records. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, put_file, small_batches, staged, work_dir

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: pages carry no time of capture.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit if refers_to is given."""
    digest = sha1_base32(payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{quote(str(page_id), safe='')}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Target-URI": target, "WARC-Date": DATE, "WARC-Record-ID": record_id(page_id, digest), "WARC-Payload-Digest": f"sha1:{digest}"}
    if page_id is not None:
        head["X-Page-ID"] = quote(str(page_id), safe="")
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": quote(str(refers_to), safe="")}
    block = http + (payload if refers_to is None else b"")
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, place after it) of the record at a place."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    n = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + n], end + 4 + n + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(f, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame, from the footer of an open bundle."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * entry)
    body, out, at = f.read(n * entry), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", body, i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


MAP = "bundle string, bytes long, page_id {id}, record_id string, frame int, frame_at long, frame_bytes long, record_at long, record_bytes long"


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 25, level: int = 3) -> DataFrame:
    """Writes the bundles under folder. Returns the record map, stored."""
    spark = pages.sparkSession
    small_batches(spark)
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = rows.withColumn("sha", F.sha2("html", 256))
    known = staged(marked.filter(F.octet_length("html") >= min_bytes).select("page_id", "sha"), "warc-digests")
    same = known.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    later = known.join(same, "sha").filter("page_id is null or page_id > first").select("page_id", "sha", "first").distinct()
    later = later.withColumns({"__p": F.coalesce(F.col("page_id").cast("string"), F.lit(""))}).select("__p", "sha", "first")
    rows = marked.withColumn("__p", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).join(later, ["__p", "sha"], "left").select("page_id", "url", "html", "first")

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=level)
        frame, waiting, held = [], [], 0  # the open frame's records, and where they are
        parts, sizes, done, at = [], [], [], 0  # the open bundle

        def close_frame():
            nonlocal frame, waiting, held, at
            plain = b"".join(frame)
            packed = pack.compress(plain)
            done.extend((*w, len(sizes), at, len(packed)) for w in waiting)
            parts.append(packed)
            sizes.append((len(packed), len(plain)))
            at += len(packed)
            frame, waiting, held = [], [], 0

        def close_bundle():
            nonlocal parts, sizes, done, at
            if frame:
                close_frame()
            uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            foot = seek_table(sizes)
            put_file(uri, [*parts, foot])
            ids, rid, r_at, r_n, k, f_at, f_n = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(ids)), pa.array([at + len(foot)] * len(ids), pa.int64()), pa.array(ids, id_kind), pa.array(rid), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (f_at, f_n, r_at, r_n)]],
                ["bundle", "bytes", "page_id", "record_id", "frame", "frame_at", "frame_bytes", "record_at", "record_bytes"],
            )
            parts, sizes, done, at = [], [], [], 0
            return out

        for b in batches:
            id_kind = b.column("page_id").type
            for page, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                one = record(page, url, payload, first)
                waiting.append((page, record_id(page, sha1_base32(payload)), held, len(one)))
                frame.append(one)
                held += len(one)
                if held >= frame_bytes:
                    close_frame()
                if at >= bundle_bytes:
                    yield close_bundle()
        if frame or parts:
            yield close_bundle()

    return staged(rows.mapInArrow(run, MAP.format(id=id_type)), "warc-map")


def read_archive(bundles: DataFrame, id_type: str = "bigint", frames_a_task: int = 64) -> DataFrame:
    """bundles: (bundle, bytes). Every record, read through the seek tables: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A response's payload is hashed again and must match its header."""

    def frames(batches):
        for b in batches:
            for uri, size in zip(b.column("bundle").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    table = frames_of(f, size)
                runs = [table[i : i + frames_a_task] for i in range(0, len(table), frames_a_task)]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(runs)), pa.array([r[0][0] for r in runs], pa.int64()), pa.array([[x[1] for x in r] for r in runs], pa.list_(pa.int64())), pa.array([[x[2] for x in r] for r in runs], pa.list_(pa.int64()))], ["bundle", "at", "packed", "plain"])

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for uri, at, packed, plain in zip(*(b.column(c).to_pylist() for c in ("bundle", "at", "packed", "plain")), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    for p, n in zip(packed, plain, strict=True):
                        data, spot, out = unpack.decompress(f.read(p), max_output_size=n), 0, []
                        while spot < n:
                            head, block, spot = parse(data, spot)
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            http, _, payload = block.partition(b"\r\n\r\n")
                            length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                            if head["WARC-Type"] == "response" and (sha1_base32(payload) != digest or len(payload) != length):
                                raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
                            ids = (None if (x := head.get(k)) is None else unquote(x) for k in ("X-Page-ID", "X-Refers-To-Page"))
                            out.append((next(ids), length, digest, head["WARC-Type"], next(ids)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spark = bundles.sparkSession
    n, size = bundles.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism  # a row stands for megabytes, so tasks are counted by the bundles' bytes
    runs = bundles.repartition(max(1, min(n, 4 * cores + n // 64)), "bundle").mapInArrow(frames, "bundle string, at long, packed array<long>, plain array<long>")
    runs = runs.repartition(int(max(1, size >> 26, min(4 * cores, size >> 20))), "bundle", "at")
    found = runs.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def read_record(row) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record of the map: one range read, one frame."""
    import zstandard

    fs, path = open_fs(row["bundle"])
    with fs.open_input_file(path) as f:
        f.seek(row["frame_at"])
        data = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(row["frame_bytes"]))
    head, block, _ = parse(data, row["record_at"])
    return head, block


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    written = write_archive(pages, work_dir(pages.sparkSession, "warc"), min_bytes)
    return read_archive(written.select("bundle", "bytes").distinct(), pages.schema["page_id"].dataType.simpleString())


SQL = r"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS h, MIN(page_id) OVER (PARTITION BY html) AS first FROM p),
v AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1) AS x FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((x[5 * i // 4 + 1] * 16 + x[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM v
"""
