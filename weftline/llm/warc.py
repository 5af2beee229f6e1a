"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a footer in the public seekable format (a skippable frame
with each frame's compressed and raw size) ends each bundle. An index row maps a record to bundle, frame and the
offset in that frame, so one record costs one read of the footer, or none, and one of its frame.

Equal payloads are stored once: of a group of equal payloads of at least ``min_bytes`` bytes the record with the
largest id is a response and the others are revisits that name it. Groups are found by digest and length, summed
before any shuffle; only the (id, digest) rows are joined with them.

Defined results: null html is the empty payload; rows that share the largest id of their group are all responses;
a null id is below every other, writes no id header and never is referred to while another row has an id; a null URL
writes no target header, an empty one an empty header; a URL with line ends is percent-encoded there and also written
whole, in base64, in a header of its own, so all URLs are read back as they were; no columns of ``pages`` but page_id, url and
html are read, whatever the others' names; an empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import attempt_name, open_file, shared_folder, small_batches, stored, write_file

#: Raw bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The header that has the base64 of a URL with line ends.
WHOLE_URL = "X-Target-URI-Base64"
#: Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id bigint, bundle string, frame bigint, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint"


def record_uuid(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(page_id & ((1 << 64) - 1)) | (0x57454654 << 64))}>"


def page_of(record_id: str) -> int:
    n = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int & ((1 << 64) - 1)
    return n - (1 << 64) if n >> 63 else n


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block ends after the HTTP header."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uuid(page_id) if page_id is not None else f'<urn:uuid:{uuid.UUID(int=0)}>'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}")
        if "\r" in url or "\n" in url:
            head.append(f"{WHOLE_URL}: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_uuid(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def url_of(head: dict[str, str]) -> str | None:
    if WHOLE_URL in head:
        return base64.b64decode(head[WHOLE_URL]).decode("utf-8", "surrogatepass")
    return head.get("WARC-Target-URI")


def parse_record(raw: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the offset behind the record."""
    raw = bytes(raw) if not isinstance(raw, bytes) else raw
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("WARC record doesn't end where it should")
    return head, raw[start:stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame of a random-access file."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    raw, out, at = f.read(8 * n), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f, at: int, packed: int, plain: int) -> bytes:
    f.seek(at)
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(packed))
    if len(raw) != plain:
        raise ValueError("frame and seek table differ")
    return raw


def read_record(bundle: str, frame: int, record_at: int) -> tuple[dict[str, str], bytes]:
    """Seek one record by its place in the index."""
    with open_file(bundle) as f:
        raw = read_frame(f, *read_seek_table(f)[frame])
    head, block, _ = parse_record(raw, record_at)
    return head, block


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, _refers_to) of ``pages``; _refers_to is null for responses.

    Digests are found without moving html; the join deals out (id, digest) rows, and html once, by id.
    """
    pages = pages.select("page_id", "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marks = pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    first = marks.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").drop("n")
    again = marks.join(first, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("_refers_to")).distinct()
    again = stored(again, "warc-roles")
    full = pages.withColumn("_sha1", F.sha1(payload))
    return full.join(again, full["page_id"].eqNullSafe(again["_id"]) & (full["_sha1"] == again["_digest"]), "left").drop("_id", "_digest", "_sha1")


def write_bundles(df: DataFrame, folder: str, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the rows (page_id, url, html, _refers_to) as bundles; returns the stored index."""
    small_batches(df.sparkSession)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        name, count = attempt_name(), 0
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        rows: list[tuple] = []
        waiting: list[tuple] = []
        buffer = bytearray()

        def close_frame():
            nonlocal waiting
            if not buffer:
                return
            packed = packer.compress(bytes(buffer))
            start = sum(a for a, _ in sizes)
            for page, at, n in waiting:
                rows.append((page, len(sizes), start, len(packed), at, n))
            frames.append(packed)
            sizes.append((len(packed), len(buffer)))
            buffer.clear()
            waiting = []

        def close_bundle():
            nonlocal frames, sizes, rows, count
            close_frame()
            if not frames:
                return None
            path = f"{folder}/{name}-{count:05d}.warc.zst"
            write_file(path, b"".join(frames) + seek_table(sizes))
            cols = list(zip(*rows))
            out = [pa.array(cols[0], pa.int64()), pa.array([path] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            frames, sizes, rows, count = [], [], [], count + 1
            return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                record = build_record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers)
                waiting.append((page, len(buffer), len(record)))
                buffer += record
                if len(buffer) >= frame_bytes:
                    close_frame()
                    if sum(a for a, _ in sizes) >= bundle_bytes:
                        yield close_bundle()
        last = close_bundle()
        if last is not None:
            yield last

    return stored(df.select("page_id", "url", "html", "_refers_to").mapInArrow(run, INDEX), "warc-index")


#: Frames of FRAME_BYTES that one task reads at a time.
FRAMES_A_TASK = 32

RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that ``index`` names, read frame by frame; payloads of responses are digested
    anew and must match their header."""

    def run(batches):
        for batch in batches:
            for bundle, frames in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(bundle) as f:
                    table = read_seek_table(f)
                    for k in sorted(frames):
                        raw, at, rows = read_frame(f, *table[k]), 0, []
                        while at < len(raw):
                            head, block, at = parse_record(raw, at)
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size = int(http.rpartition(b"Content-Length: ")[2])
                            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                            if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                                raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                            own, to = head["WARC-Record-ID"], head.get("WARC-Refers-To")
                            rows.append((None if uuid.UUID(own[10:-1]).int == 0 else page_of(own), size, digest, kind, page_of(to) if to else None, url_of(head)))
                        cols = list(zip(*rows))
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    # the same frame can stand in many index rows; the rows are few next to what they name, so their number says nothing
    frames = index.groupBy("bundle", (F.col("frame") / FRAMES_A_TASK).cast("long").alias("run")).agg(F.collect_set("frame").alias("frames"))
    tasks = index.select("bundle", (F.col("frame") / FRAMES_A_TASK).cast("long")).distinct().count()
    return frames.select("bundle", "run", "frames").repartition(max(1, min(tasks, 20_000)), "bundle", "run").select("bundle", "frames").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to bundles in ``folder``; returns the index."""
    return write_bundles(roles(pages, min_bytes), folder or shared_folder(pages.sparkSession, "warc"))
