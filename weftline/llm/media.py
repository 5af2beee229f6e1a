"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles, difference hashes.

Images live in a binary column. ``decode_image`` reads P1 to P6 and uncompressed BMP (1, 8, 24, 32 bits);
``area_resize`` averages areas exactly through an integral image, so shrinking and growing both work;
``tile_bytes`` is an NPY file of the resized luminance; ``difference_hash`` compares neighbours in a 9 x 8 tile.

Defined results: a null image gives null features; an image that can't be decoded raises ValueError in
``decode_image`` and gives null features in ``image_features``; an empty text becomes 64 zero bytes, one row.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import attempt_name, open_file, small_batches, write_file

#: Samples in a row of a stored payload.
ROW = 64
#: Height and width of a tile.
TILE = (16, 16)

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """``n`` numbers behind the magic and the offset after the last."""
    at, out = 2, []
    for _ in range(n):
        m = _TOKEN.match(data, at)
        if m is None:
            raise ValueError("truncated Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bits, color = kind in (1, 4), kind in (3, 6)
    head, at = _header(data, 2 if bits else 3)
    width, height = head[:2]
    top = 1 if bits else head[2]
    if width <= 0 or height <= 0 or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    n = width * height * (3 if color else 1)
    if kind == 1:
        plain = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.frombuffer(re.sub(rb"[^01]", b"", plain), np.uint8)[:n] - 48
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        row = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        flat = np.unpackbits(raw, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(flat) < n:
        raise ValueError("truncated Netpbm samples")
    if bits:
        flat = 1 - flat  # 1 is black
    flat = flat.astype(np.uint16 if top > 255 else np.uint8)
    return flat.reshape((height, width, 3) if color else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    start, head, width, height, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    if packing not in (0, 3) or bits not in (1, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("BMP kind not supported")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + rows * stride:
        raise ValueError("truncated BMP samples")
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits in (24, 32):
        step = bits // 8
        return np.ascontiguousarray(raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)[:, 2::-1]
    index = raw[:, :width] if bits == 8 else np.unpackbits(raw, axis=1)[:, :width]
    image = palette[index]
    gray = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return np.ascontiguousarray(image[:, :, 0] if gray else image)


def decode_image(data: bytes) -> np.ndarray:
    """Rows x columns, or rows x columns x RGB."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM" and len(data) >= 54:
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(payload: bytes, width: int = ROW) -> bytes:
    """``payload``, a multiple of ``width`` bytes, as the samples of a binary graymap."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(gray: np.ndarray) -> bytes:
    """An 8-bit BMP with a gray palette."""
    height, width = gray.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = gray[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 54 + 1024
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def luminance(image: np.ndarray) -> np.ndarray:
    """A gray image itself, whatever its type."""
    if image.ndim == 2:
        return image
    return image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


#: Rows of the integral image that exist at once, besides those that a resize needs.
STRIP = 4096


def _integral_rows(gray: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ``wanted`` (ascending) rows of the integral image, which is summed strip by strip."""
    rows, cols = gray.shape
    out, above = np.zeros((len(wanted), cols + 1)), np.zeros(cols + 1)
    for lo in range(0, rows, STRIP):
        strip = np.cumsum(gray[lo : lo + STRIP], axis=0, dtype=np.float64)
        np.cumsum(strip, axis=1, out=strip)
        strip += above[1:]
        here = (wanted > lo) & (wanted <= lo + len(strip))
        out[here, 1:] = strip[wanted[here] - lo - 1]
        above[1:] = strip[-1]
    return out


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area. The integral image is linear inside a sample, so cutting it at
    fractional places gives exact areas. Of the integral image no more than a strip and two rows a target row is held."""
    rows, cols = gray.shape

    def places(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, (at - low)[:, None]

    low, part = places(rows, height)
    wanted = np.unique(np.concatenate([low, low + 1]))
    whole = _integral_rows(gray, wanted)
    across = (whole[np.searchsorted(wanted, low)] * (1 - part) + whole[np.searchsorted(wanted, low + 1)] * part).T
    low, part = places(cols, width)
    corners = (across[low] * (1 - part) + across[low + 1] * part).T
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums / ((rows / height) * (cols / width))


def difference_hash(gray: np.ndarray) -> str:
    """64 bits: is a cell brighter than its left neighbour."""
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile_array(gray: np.ndarray, size: tuple[int, int] = TILE) -> np.ndarray:
    return np.ascontiguousarray(np.clip(np.round(area_resize(gray, *size)), 0, 65535), np.uint8 if gray.max(initial=0) < 256 else np.uint16)


def tile_bytes(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8 and its bytes filled with zeros to a positive multiple of ROW."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // ROW)) * ROW
    return len(raw), raw + bytes(n - len(raw))


def texts_to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text, null as empty, as a binary graymap in a media column."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            both = [payload_of(x) for x in batch.column(1).to_pylist()]
            media = pa.array([encode_pgm(p) for _, p in both], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in both], pa.int64()), media], ["key", "n_bytes", "media"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, tile_sha256 string, tile_file string, tile_row long"


def image_features(df: DataFrame, tiles_to: str | None = None) -> DataFrame:
    """For rows (key, n_bytes, media): the decoded samples' digests, difference hash and tile. With ``tiles_to``
    each task writes its tiles, stacked, as NPY files in that folder and names file and row; a file holds 8192 tiles."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)["key"]

    def one(media: bytes | None):
        if media is None:
            return None
        try:
            image = decode_image(media)
        except (ValueError, struct.error, IndexError):
            return None
        samples = image.tobytes()
        gray = luminance(image)
        tile = tile_array(gray)
        return samples, image.shape, difference_hash(gray), tile

    def run(batches):
        stack: list[np.ndarray] = []
        name, count = f"{tiles_to}/{attempt_name()}", 0

        def flush():
            nonlocal stack, count
            if stack and tiles_to:
                write_file(f"{name}-{count:05d}.npy", tile_bytes(np.stack(stack)))
                count += 1
            stack = []

        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                got = one(media)
                if got is None:
                    rows.append((None,) * 3 + ((None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())) + (None,) * 6)
                    continue
                samples, shape, mark, tile = got
                at = (f"{name}-{count:05d}.npy", len(stack)) if tiles_to else (None, None)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{mark}:{tile.astype(np.uint8).tobytes()[::37].hex()}", shape[0], shape[1], hashlib.sha256(tile_bytes(tile)).hexdigest(), *at))
                if stack and stack[0].dtype != tile.dtype:  # a file has one type
                    flush()
                    at = (f"{name}-{count:05d}.npy", 0) if tiles_to else (None, None)
                    rows[-1] = (*rows[-1][:-2], *at)
                stack.append(tile)
                if len(stack) >= 8192:
                    flush()
            cols = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["key", "n_bytes", *(x.split()[0] for x in FEATURES.split(", "))])
        flush()

    return df.select("key", "n_bytes", "media").mapInArrow(run, f"key {kind}, n_bytes long, {FEATURES}")


def read_tiles(features: DataFrame) -> DataFrame:
    """(tile_file, tile_row, tile_sha256) of the tiles in the files that ``features``, a stored table, names."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as f:
                    stack = np.load(io.BytesIO(f.read()))
                marks = [hashlib.sha256(tile_bytes(np.ascontiguousarray(t))).hexdigest() for t in stack]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(marks)), pa.array(range(len(marks)), pa.int64()), pa.array(marks)], ["tile_file", "tile_row", "tile_sha256"])

    files = features.where("tile_file is not null").select("tile_file").distinct()
    return files.repartition(max(1, min(files.count(), 4096)), "tile_file").mapInArrow(run, "tile_file string, tile_row long, tile_sha256 string")
