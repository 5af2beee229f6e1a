"""Byte-level BPE by ranks: encoding with a segment tree over byte positions, and decoding.

A tree's leaf i holds the rank of the pair that starts at live position i (with i in the low bits, so the minimum is
the leftmost of the least rank); the root names the next merge. A merge changes three leaves, its own, its left
neighbour's and that of the position it swallows, and each change walks up log2(n) nodes. Short pieces run side by
side, one tree per row of a numpy array; pieces over SIDE_BY_SIDE bytes have a tree of their own.

Defined results: null is the empty text, which has no ids and decodes to no bytes; texts of any length, without any
space too, take n log n steps; repeated texts give equal ids. A piece that is itself a token is that token.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.chunks import ChunkCache
from weftline.llm.common import small_batches

SIDE_BY_SIDE = 64
NONE = 1 << 40


class Ranks:
    """A rank file: token bytes to id. A pair merges if its bytes are a token; that token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens: list[bytes | None] = [None] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        pairs = []
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, i))
        both = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pair_keys = np.append(both[:, 0], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(both[:, 1], NONE)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = dict(pairs)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ids.get(p)
            if whole is not None:
                out[k] = np.array([whole], np.uint32)
            elif len(p) > SIDE_BY_SIDE:
                out[k] = np.array(self._tall(p), np.uint32)
            else:
                groups.setdefault(max(8, 1 << (len(p) - 1).bit_length()), []).append(k)
        for size, members in groups.items():
            for lo in range(0, len(members), 1 << 14):
                part = members[lo : lo + (1 << 14)]
                for k, ids in zip(part, self._wide([pieces[k] for k in part], size)):
                    out[k] = ids
        return out  # type: ignore[return-value]

    def _wide(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Pieces of up to ``size`` bytes, one tree per row."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        token = self.single[raw]
        place = np.arange(size)
        after = np.where(place + 1 < length[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE * size, dtype=np.int64)
        has = after[:, : size - 1] >= 0
        ranks = np.full((n, size), NONE, dtype=np.int64)
        ranks[:, : size - 1][has] = self.pair(token[:, :-1][has], token[:, 1:][has])
        tree[:, size:] = ranks * size + place
        node = size
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2

        def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            at = at + size
            tree[rows, at] = rank * size + (at - size)
            while (at := at >> 1)[0] >= 1:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        live = np.flatnonzero(tree[:, 1] < NONE * size)
        while len(live):
            top = tree[live, 1]
            i, rank = top % size, top // size
            j = after[live, i]
            k = after[live, j]
            h = before[live, i]
            token[live, i] = rank
            after[live, i] = k
            after[live, j] = -2  # swallowed
            put(live, j, np.full(len(live), NONE))
            right = k >= 0
            before[live[right], k[right]] = i[right]
            new = np.full(len(live), NONE)
            new[right] = self.pair(rank[right], token[live[right], k[right]])
            put(live, i, new)
            left = h >= 0
            if left.any():
                rows = live[left]
                put(rows, h[left], self.pair(token[rows, h[left]], rank[left]))
            live = live[tree[live, 1] < NONE * size]
        alive = (after != -2) & (place < length[:, None])
        flat = token[alive].astype(np.uint32)
        return np.split(flat, np.cumsum(alive.sum(axis=1))[:-1])

    def _tall(self, piece: bytes) -> list[int]:
        """One piece of any length. Its tree and links are lists of about six entries a byte, some 100 bytes in all: a match of
        10 MB, which only text without any break has, takes a gigabyte."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        none, pairs = NONE * size, self.pairs
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        def ranked(a: int, b: int) -> int:
            rank = pairs.get(token[a] << 32 | token[b])
            return none if rank is None else rank * size + a

        while tree[1] < none:
            i, rank = tree[1] % size, tree[1] // size
            j = after[i]
            k, h = after[j], before[i]
            token[i], after[i] = rank, k
            put(j, none)
            if k >= 0:
                before[k] = i
                put(i, ranked(i, k))
            else:
                put(i, none)
            if h >= 0:
                put(h, ranked(h, i))
        out, i = [], 0
        while i >= 0:
            out.append(token[i])
            i = after[i]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Coder:
    """Whole texts to ids: the pattern's matches are encoded separately."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.cut = regex.compile(pattern)
        self.cache = ChunkCache(self._encode_chunks, most=600_000)
        self.decimal = [str(i) for i in range(len(self.ranks.tokens))]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [[x.encode("utf-8", "surrogatepass") for x in self.cut.findall(c)] for c in chunks]
        pieces = list({p for x in cut for p in x})
        ids = dict(zip(pieces, (x.tobytes() for x in self.ranks.encode_pieces(pieces))))
        return [b"".join(ids[p] for p in x) for x in cut]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint32) for x in self.cache(t or "" for t in texts)]


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One coder, with its cache, per Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def with_ids(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with a column ids: array<int>; a column of this name is replaced."""
    from pyspark.sql import functions as F

    small_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids = coder(path, pattern).encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return df.withColumn("ids", encode(F.col(text)))


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with a binary column decoded; a column of this name is replaced."""
    from pyspark.sql import functions as F

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        ranks = coder(path, pattern).ranks
        return pa.array([None if x is None else ranks.decode(x) for x in lists.to_pylist()], pa.binary())

    return df.withColumn("decoded", decode(F.col(ids)))


def id_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, then decode those ids, without storing either."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            rows = []
            for ids in own.encode(batch.column(1).to_pylist()):
                listed = ids.tolist()
                joined = ",".join(map(own.decimal.__getitem__, listed))
                rows.append((len(listed), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(own.ranks.decode(listed)).hexdigest()))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
