"""Token ids as one wavelet matrix per shard, in a compressed file that is read by ranges.

A file holds bit-planes from the highest bit down; at each plane the sequence is partitioned stably, zeros first, so
rank on the planes leads from a position to its symbol (access), from a symbol to its count before a position
(rank), and back from the k-th occurrence to its position (select). Planes are cut into blocks of BLOCK bits, each
compressed by itself unless that doesn't shorten it. The directory has two levels: ones before each block, and inside
it before each STEP bits; so a rank unpacks one block of 8 KB and counts less than STEP bits of it.

Layout, all little-endian: magic, length of the head, head (JSON), doc ids (int64), ends (int64, ids up to and with
each document), then per plane ones before each block (int64), block places (int64), ones in a block before each of its
steps (uint16), blocks.

The end id is also a token's id in some vocabularies, so ends are stored, not selected. Strings of the tokenizer's added
tokens get those tokens' ids, as the library gives them: a text that holds one is encoded by the library whole.

Shards follow the ids' order: rows are dealt out by ranges of the key and sorted, and each task closes a shard after
SHARD_TOKENS ids, so the files in order of (partition, number) are the ascending sequence. Defined results: null is
the empty text, of which only the end id is left; a null key comes first; rows that share a key stay separate rows,
in no fixed order among themselves unless their texts differ (they are sorted by text); an empty table has no shard.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.chunks import CHUNK
from weftline.llm.common import CACHES, attempt_name, open_file, shared_folder, small_batches, stored, write_file

MAGIC = b"WFWAVE01"
BLOCK, STEP = 1 << 16, 512
SHARD_TOKENS = 1_500_000
END_ID = 0


def build(ids: np.ndarray, keys: np.ndarray, ends: np.ndarray, level: int = 1, null_keys: int = 0) -> bytes:
    """The file of one sequence with its documents' keys and ends. The first ``null_keys`` of the keys are null."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    packer = zstandard.ZstdCompressor(level=level)
    zeros, sections = [], []
    for b in range(bits - 1, -1, -1):
        plane = (seq >> b & 1).astype(bool)
        zeros.append(int(len(plane) - np.count_nonzero(plane)))
        seq = np.concatenate([seq[~plane], seq[plane]])
        packed = np.packbits(plane)
        blocks = []
        whole = packed.tobytes()
        for at in range(0, len(whole), BLOCK // 8):
            raw = whole[at : at + BLOCK // 8]
            small = packer.compress(raw)
            blocks.append(small if len(small) < len(raw) else raw)
        places = np.cumsum([0, *map(len, blocks)])
        words = np.zeros((len(blocks), BLOCK // 64), np.uint64)
        words.view(np.uint8).reshape(-1)[: len(packed)] = packed
        steps = np.bitwise_count(words).reshape(len(blocks), BLOCK // STEP, STEP // 64).sum(axis=2, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(steps.sum(axis=1))])
        inner = (np.cumsum(steps, axis=1) - steps).astype("<u2")
        sections.append((before.astype("<i8").tobytes(), places.astype("<i8").tobytes(), inner.tobytes(), b"".join(blocks)))
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "block": BLOCK, "docs": len(keys), "null_keys": null_keys, "body": [len(s[3]) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, keys.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), *(x for s in sections for x in s)])


class WaveletFile:
    """Reads a file by ranges; blocks that were read are kept, at most ``keep`` of them."""

    def __init__(self, file, keep: int = 256):
        self.file, self.keep, self.held, self.whole = file, keep, {}, {}
        if self._at(0, 8) != MAGIC:
            raise ValueError("not a wavelet file")
        size = struct.unpack("<I", self._at(8, 4))[0]
        head = json.loads(self._at(12, size))
        self.n, self.bits, self.zeros, self.block, docs = head["n"], head["bits"], head["zeros"], head["block"], head["docs"]
        at = 12 + size
        self.keys, self.null_keys = np.frombuffer(self._at(at, 8 * docs), "<i8"), head["null_keys"]
        self.ends = np.frombuffer(self._at(at + 8 * docs, 8 * docs), "<i8")
        at += 16 * docs
        blocks = -(-self.n // self.block)
        self.before, self.places, self.inner, self.body = [], [], [], []
        for length in head["body"]:
            self.before.append(np.frombuffer(self._at(at, 8 * (blocks + 1)), "<i8"))
            self.places.append(np.frombuffer(self._at(at + 8 * (blocks + 1), 8 * (blocks + 1)), "<i8"))
            at += 16 * (blocks + 1)
            self.inner.append(np.frombuffer(self._at(at, 2 * blocks * (self.block // STEP)), "<u2").reshape(blocks, self.block // STEP))
            self.body.append(at + 2 * blocks * (self.block // STEP))
            at = self.body[-1] + length

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _bits(self, plane: int, k: int) -> np.ndarray:
        """The bits of a block; of a plane that was decoded they needn't be unpacked again."""
        if plane in self.whole:
            n = min(self.block, self.n - k * self.block)
            return np.unpackbits(np.frombuffer(self.whole[plane], np.uint8, -(-n // 8), k * self.block // 8), count=n)
        if (plane, k) not in self.held:
            if len(self.held) >= self.keep:
                self.held.pop(next(iter(self.held)))
            lo, hi = int(self.places[plane][k]), int(self.places[plane][k + 1])
            n = min(self.block, self.n - k * self.block)
            raw = self._at(self.body[plane] + lo, hi - lo)
            if hi - lo < -(-n // 8):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            self.held[plane, k] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
        return self.held[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        k, rest = divmod(i, self.block)
        out = int(self.before[plane][k])
        if not rest:
            return out
        step = rest // STEP
        return out + int(self.inner[plane][k][step]) + int(np.count_nonzero(self._bits(plane, k)[step * STEP : rest]))

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            k, rest = divmod(i, self.block)
            bit, ones = int(self._bits(p, k)[rest]), self._ones(p, i)
            out = out << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if symbol >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences in [lo, hi)."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def ranks(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol before each of ascending places: one pass over the planes' directories, in which only
        the blocks that hold a place are unpacked."""
        if symbol < 0 or symbol >> self.bits:
            return np.zeros(len(places), np.int64)
        at = np.concatenate([[0], places]).astype(np.int64)  # the first is where the symbol's range begins
        for p in range(self.bits):
            ones = self.before[p][at // self.block].copy()
            k, rest = at // self.block, at % self.block
            inside = np.flatnonzero(rest)
            step = rest[inside] // STEP
            ones[inside] += self.inner[p][k[inside], step]
            order = inside[np.argsort(k[inside], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(k[order])) + 1) if len(order) else ():
                bits = self._bits(p, int(k[part[0]]))
                low = rest[part] // STEP * STEP
                ones[part] += [np.count_nonzero(bits[a:b]) for a, b in zip(low.tolist(), rest[part].tolist())]
            at = self.zeros[p] + ones if symbol >> (self.bits - 1 - p) & 1 else at - ones
        return at[1:] - at[0]

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th, from 0, bit of that value."""
        ones = self.before[plane]
        upto = ones if bit else np.minimum(np.arange(len(ones)) * self.block, self.n) - ones
        block = int(np.searchsorted(upto, k, side="right")) - 1
        return block * self.block + int(np.flatnonzero(self._bits(plane, block) == bit)[k - int(upto[block])])

    def select(self, symbol: int, k: int) -> int:
        """The position of the k-th occurrence, from 0."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, symbol: int) -> Iterator[int]:
        for k in range(self.count(symbol)):
            yield self.select(symbol, k)

    def _plane(self, plane: int) -> np.ndarray:
        n = -(-self.n // self.block)
        whole = self._at(self.body[plane], int(self.places[plane][-1]))
        out = []
        for k in range(n):
            raw = whole[int(self.places[plane][k]) : int(self.places[plane][k + 1])]
            size = min(self.block, self.n - k * self.block)
            out.append(raw if len(raw) == -(-size // 8) else zstandard.ZstdDecompressor().decompressobj().decompress(raw))
        self.whole[plane] = b"".join(out)
        return np.unpackbits(np.frombuffer(self.whole[plane], np.uint8), count=self.n).view(bool)

    def decode(self) -> np.ndarray:
        """The whole sequence: partitions undone from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            ones, above = self._plane(p), np.empty_like(out)
            above[~ones] = out[: self.zeros[p]]
            above[ones] = out[self.zeros[p] :]
            out = above | (ones.astype(out.dtype) << (self.bits - 1 - p))
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        lo = int(self.ends[k - 1]) if k else 0
        return np.array([self.access(i) for i in range(lo, int(self.ends[k]))], np.uint32)


class Known(dict):
    """Encoded chunks; what is missing is encoded when it is asked for. A full one starts anew; long chunks aren't kept."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 1_200_000, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


class LibraryIds:
    """The tokenizers library's ids of texts as uint32 bytes, by chunks; texts with an added token's string are encoded whole. A
    chunk that is a word, which a byte-level tokenizer takes as one piece, goes to the library's model at once, in the
    characters that stand for its bytes there; any other chunk is a text of its own."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        own = Tokenizer.from_file(path)
        self.added = [t.content for t in own.get_added_tokens_decoder().values() if t.content]
        model, plain = own.model, own.normalizer is None and isinstance(own.pre_tokenizer, ByteLevel) and not own.pre_tokenizer.add_prefix_space
        letters, tokenize = dict(enumerate(_byte_letters())), model.tokenize
        space = letters[32]

        def encode(chunk: str) -> bytes:
            word = chunk[1:] if chunk[0] == " " else chunk
            if not plain or not word.isalpha():
                return self.whole(chunk)
            if not chunk.isascii():
                chunk = chunk.encode().decode("latin-1").translate(letters)
            elif len(word) < len(chunk):
                chunk = space + word
            return array("I", [t.id for t in tokenize(chunk)]).tobytes()

        self.own, self.known = own, Known(encode)
        CACHES.add(self)

    def whole(self, text: str) -> bytes:
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def clear(self) -> None:
        self.known.clear()

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        get = self.known.__getitem__
        return [self.whole(t) if any(x in t for x in self.added) else b"".join(map(get, CHUNK.findall(t))) for t in texts]


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: a printable one for itself, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


_TOKENIZERS: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = LibraryIds(path)
    return _TOKENIZERS[path]


MANIFEST = "partition int, number int, path string, docs bigint, tokens bigint"


def write_shards(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``df``, write its shards to ``folder`` in ascending order of ``key``; returns the stored manifest."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches):
        from pyspark import TaskContext

        own, name = library_ids(path), attempt_name()
        part, number = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], np.uint32).tobytes()
        ids: list[bytes] = []
        keys: list[int | None] = []  # nulls come first, as Spark sorts them
        sizes: list[int] = []

        def close():
            nonlocal ids, keys, sizes, number
            whole = np.frombuffer(b"".join(ids), np.uint32)
            uri = f"{folder}/{name}-{number:05d}.wave"
            write_file(uri, build(whole, np.array([k or 0 for k in keys], np.int64), np.cumsum(sizes), null_keys=keys.count(None)))
            row = pa.RecordBatch.from_pydict({"partition": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": [uri], "docs": [len(keys)], "tokens": [len(whole)]})
            ids, keys, sizes, number = [], [], [], number + 1
            return row

        total = 0
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), own(batch.column(1).to_pylist())):
                ids += (raw, end)
                keys.append(k)
                sizes.append(len(raw) // 4 + 1)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield close()
                    total = 0
        if keys:
            yield close()

    return stored(rows.mapInArrow(run, MANIFEST), "wavelet-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_end_ids) of every document, from the files; n_end_ids by rank: the end id,
    and the text's own tokens of this id."""
    spark = manifest.sparkSession
    sums = manifest.groupBy("partition").agg(F.sum("tokens").alias("n")).orderBy("partition").collect()  # a row per task of the writer
    bases = list(zip((r["partition"] for r in sums), itertools.accumulate([0, *(r["n"] for r in sums[:-1])])))
    before = F.sum("tokens").over(Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("own", F.coalesce(before, F.lit(0))).join(F.broadcast(spark.createDataFrame(bases, "partition int, first bigint")), "partition")
    placed = placed.select("path", (F.col("first") + F.col("own")).alias("base"))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(path) as f:
                    w = WaveletFile(f)
                    ids, ends = w.decode().astype("<u4"), w.ends
                    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    keys = pa.array(w.keys, pa.int64(), mask=np.arange(len(w.keys)) < w.null_keys)
                    upto = w.ranks(END_ID, ends.astype(np.int64))
                    cols = [keys, pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64()), pa.array(np.diff(upto, prepend=0))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids"])

    files = max(1, manifest.count())  # each task opens its own files
    return placed.select("path", "base").repartition(min(files, 4096), "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_end_ids bigint")


def encode_corpus(df: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    return write_shards(df, path, folder or shared_folder(df.sparkSession, "wavelet"))
