"""Exact substring deduplication on the collection Burrows-Wheeler transform, built column by column.

A byte is removed if a WIDTH-byte string that covers it also starts in a document with a smaller id. Strings that
occur in one document only never need sorting, so the work comes in three steps:

1. Anchors. Of the K-byte strings in a window of WIDTH bytes the one with the least hash is the window's anchor (the
   leftmost on ties), which depends on the window's bytes only. So equal windows have equal anchors at equal
   places, every window belongs to one anchor, and windows of one anchor are a run of starts. Anchor hashes travel
   packed, 8 bytes each; those met in two or more documents come back per document. What a block of documents meets
   twice it knows at once, and sends one of them on for all.
2. Segments. The bytes under such an anchor's run of windows, WIDTH + WIDTH - K at most, are cut out and dealt to
   buckets by the anchor's hash. In a block, of equal segments only those of the smallest document are sent: the others
   go whole. The windows of an anchor that more than HOT documents hold are dealt one by one, by their own hashes.
3. Columns. A bucket's distinct segments are a collection of strings. Round t inserts the suffix of length t of each:
   one symbol per string into the BWT, at the place that last-to-first mapping gives, with the common prefix of each
   row and the row before, from the least common prefix since the symbol's last occurrence. Rows are read and
   written front to back once per round, chunk by chunk (``Rows``): in sequential files in the shared folder, but for
   collections of one chunk, which stay in memory. Rows whose common prefix is WIDTH or more hold one string; its
   smallest document decides which occurrences go.

Rounds are bounded by the segment length, not by the documents', however long these are. Equal texts are one document
from the start: of a copy everything goes if it has WIDTH bytes.

Defined results: null is the empty text; documents that share an id never remove anything from one another, and each
loses only what stands in it; a null id is kept whole and removes nothing; texts shorter than WIDTH are kept; an empty
table gives no rows. Only the columns key and text are read, and no name of another column matters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_broadcast, buffers, discard, fresh, release, shared_folder, small_batches, stored
from weftline.llm.nodes import SMALL_ROWS, digest_of, nodes_of

WIDTH, K = 50, 20
#: Bytes of text hashed at once, anchors in a block, segments in a block, bytes a bucket of anchors should get, and
#: segments that a bucket of segments should get.
SLICE_BYTES, BLOCK_ANCHORS, BLOCK_SEGMENTS, ANCHOR_BUCKET, SEGMENT_BUCKET = 64 << 10, 500_000, 200_000, 4 << 20, 32_000
#: Holders of an anchor above which its windows are dealt one by one.
HOT = 100_000
#: Rows of the transform in a chunk, which may grow to twice as many.
CHUNK_ROWS = 1 << 17
#: Rows up to which the places that last-to-first mapping leads to are held, when strings are found again; beyond it the
#: files are passed over once a round.
HELD_ROWS = 1 << 24

U64 = np.uint64
_C = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * _C[1]
    x = (x ^ (x >> U64(27))) * _C[2]
    return x ^ (x >> U64(31))


_BYTES = _mix(np.arange(1, 257, dtype=U64) * _C[0])
_POWERS = [int(_C[0])]
while len(_POWERS) < 8:
    _POWERS.append(_POWERS[-1] ** 2 % (1 << 64))


def _rolling(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring bytes: a polynomial over what the bytes are mapped to, by powers of two, mixed."""
    x, out, done = _BYTES[raw], None, 0
    for k, power in enumerate(_POWERS):
        size = 1 << k
        if n & size:
            if out is None:
                out, done = x, size
            else:
                m = min(len(out), len(x) - done)
                out, done = out[:m] * U64(power) + x[done : done + m], done + size
        if done == n:
            return _mix(out)
        x = x[:-size] * U64(power) + x[size:]


def anchors(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, first window, windows, place, hash) of each anchor of the documents that lie in ``text``; windows don't
    cross documents. ``text`` is below 16 MB: longer documents are cut by the caller."""
    none = np.empty(0, np.int64)
    if len(text) < WIDTH:
        return none, none, none, none, np.empty(0, U64)
    with np.errstate(over="ignore"):
        h = _rolling(np.frombuffer(text, np.uint8), K)
        placed = (h & ~U64(0xFFFFFF)) | np.arange(len(h), dtype=U64)
        span, size, least = WIDTH - K + 1, 1, placed
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    room = np.maximum(lengths - WIDTH + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), room)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(starts, room)
    if not len(window):
        return none, none, none, none, np.empty(0, U64)
    at = (least[window] & U64(0xFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    with np.errstate(over="ignore"):
        own = _mix(h[at[head]] * _C[2])  # the least of many hashes are small; these are even again
    return owner[head], window[head], np.diff(np.append(head, len(window))), at[head], own


def _slices(texts: list[bytes]) -> Iterator[tuple[list[int], bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, bytes, starts, lengths, offsets): groups of texts of about SLICE_BYTES; longer texts in pieces
    that share WIDTH - 1 bytes, so that every window is in one piece."""
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > SLICE_BYTES:
            for at in range(0, len(t) - WIDTH + 1, SLICE_BYTES):
                piece = t[at : at + SLICE_BYTES + WIDTH - 1]
                yield [i], piece, np.array([0]), np.array([len(piece)]), np.array([at])
            continue
        group.append(i)
        size += len(t)
        if size >= SLICE_BYTES:
            yield _joined(group, texts)
            group, size = [], 0
    if group:
        yield _joined(group, texts)


def _joined(group: list[int], texts: list[bytes]):
    lengths = np.array([len(texts[i]) for i in group])
    return group, b"".join(texts[i] for i in group), np.cumsum(lengths) - lengths, lengths, np.zeros(len(group), np.int64)


_ONE = [bytes([i]) for i in range(256)]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def _bytes_of(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


#: A packed anchor has 48 bits of its hash, and in the low 16 the holder's place in the row's table of nodes and whether
#: it stands for more holders, who know already.
PLACE, STANDS = U64(0x7FFF), U64(0x8000)


def _send_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, anchors, keys), packed; bucket -1 has anchors that a block met in two documents, with a key for each."""
    small_batches(docs.sparkSession)
    names, kinds = ["bucket", "anchors", "keys"], [pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        release()
        keys: list[int] = []
        packed: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal keys, packed, held
            if held:
                table = np.array(keys, np.int64)
                own = np.sort(np.concatenate(packed))
                packed = []
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]  # a document's anchor counts once
                mark = own & ~U64(0xFFFF)
                head = np.concatenate([[True], mark[1:] != mark[:-1]])
                met = ~(head & np.append(head[1:], True))
                rows = []
                if met.any():
                    rows.append((-1, mark[met].tobytes(), table[(own[met] & PLACE).astype(np.int64)].tobytes()))
                own = np.where(met, own | STANDS, own)[head]
                bucket = _bucket(own, buckets)
                for part in np.split(np.arange(len(own)), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
                    who, place = np.unique((own[part] & PLACE).astype(np.int64), return_inverse=True)
                    rows.append((int(bucket[part[0]]), (own[part] & ~PLACE | place.astype(U64)).tobytes(), table[who].tobytes()))
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)
            keys, packed, held = [], [], 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _bytes_of(batch.column(1).to_pylist())
            for group, text, starts, lengths, _ in _slices(texts):
                owner, _, _, _, h = anchors(text, starts, lengths)
                base = len(keys)
                keys += [ids[i] for i in group]
                packed.append(h & ~U64(0xFFFF) | (owner + base).astype(U64))
                held += len(h)
                if held >= BLOCK_ANCHORS or len(keys) > 30_000:
                    yield from flush()
        yield from flush()
        release()

    return docs.select("key", "text").mapInArrow(run, "bucket int, anchors binary, keys binary")


def _shared_anchors(packed: DataFrame) -> DataFrame:
    """(key, anchor): of each document the hashes (48 bits) that another document has too, a row each, so rows follow the
    text that is shared, whatever the number of buckets."""

    def met(batches):
        for batch in batches:
            for own, keys in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64)), pa.array(np.frombuffer(own.as_buffer(), np.int64))], ["key", "anchor"])

    def gather(table: pa.Table) -> pa.Table:
        release()
        tables = [np.frombuffer(x, np.int64) for x in buffers(table, "keys")]
        own = [np.frombuffer(x, U64) for x in buffers(table, "anchors")]
        base = np.cumsum([0, *map(len, tables[:-1])])
        doc = np.concatenate([t[(a & PLACE).astype(np.int64)] for t, a in zip(tables, own)]) if len(base) else np.empty(0, np.int64)
        h = np.concatenate(own)
        order = np.argsort(h & ~U64(0xFFFF), kind="stable")
        h, doc = h[order], doc[order]
        mark = h & ~U64(0xFFFF)
        head = np.concatenate([[True], mark[1:] != mark[:-1]])
        keep = ~(head & np.append(head[1:], True)) & (h & STANDS == 0)
        return pa.table([doc[keep], mark[keep].view(np.int64)], names=["key", "anchor"])

    known = packed.where("bucket < 0").select("anchors", "keys").mapInArrow(met, "key long, anchor long")
    return known.unionByName(packed.where("bucket >= 0").groupBy("bucket").applyInArrow(gather, "key long, anchor long"))


SEGMENTS = ("segments", "lengths", "which", "keys", "ids", "starts")


def _send_segments(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, segments, lengths, which, keys, ids, starts): a block's distinct segments, each with where it stands
    in its smallest document. Other documents' go whole: bucket -1 has these as (keys, begins as ids, ends as starts)."""
    small_batches(docs.sparkSession)
    names, kinds = ["bucket", *SEGMENTS], [pa.int32(), *[pa.binary()] * 6]

    def run(batches):
        known: dict[bytes, int] = {}
        which: list[int] = []
        places: list[tuple[np.ndarray, ...]] = []  # node, id, start, bucket of each occurrence

        def flush():
            nonlocal known, which, places
            if not which:
                return
            segments, at = list(known), np.array(which)
            node, own, start, bucket = (np.concatenate(x) for x in zip(*places))
            known, which, places = {}, [], []
            length = np.fromiter(map(len, segments), np.int64, len(segments))
            least, where = np.full(len(segments), np.iinfo(np.int64).max), np.empty(len(segments), np.int64)
            np.minimum.at(least, at, own)
            where[at] = bucket
            whole = own != least[at]
            if whole.any():
                yield row(-1, b"", b"", b"", node[whole].tobytes(), start[whole].tobytes(), (start + length[at] - 1)[whole].tobytes())
            at, node, own, start = (x[~whole] for x in (at, node, own, start))
            order = np.argsort(where, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            by = np.argsort(where[at], kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            for part in np.split(order, cuts):
                b = where[part[0]]
                lo, hi = np.searchsorted(where[at], [b, b + 1], sorter=by)
                mine = by[lo:hi]
                yield row(int(b), b"".join([segments[k] for k in part.tolist()]), length[part].astype(np.uint8).tobytes(), (rank[at[mine]] - rank[part[0]]).astype(np.int32).tobytes(), node[mine].tobytes(), own[mine].tobytes(), start[mine].tobytes())

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            nodes, ids = (np.asarray(batch.column(i)) for i in (0, 1))
            texts = _bytes_of(batch.column(2).to_pylist())
            wanted = [np.sort(x.values.to_numpy().view(U64)) for x in batch.column(3)]
            for group, text, starts, lengths, offsets in _slices(texts):
                owner, first, windows, anchor, h = anchors(text, starts, lengths)
                if not len(h):
                    continue
                mark = h & ~U64(0xFFFF)
                hit, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
                edges = np.searchsorted(owner, np.arange(len(group) + 1))
                for g, i in enumerate(group):
                    if (lo := edges[g]) < (hi := edges[g + 1]) and len(wanted[i]):
                        near = wanted[i][np.minimum(np.searchsorted(wanted[i], mark[lo:hi]), len(wanted[i]) - 1)]
                        hit[lo:hi] = near & ~U64(0xFFFF) == mark[lo:hi]
                        hot[lo:hi] = near & U64(1) == U64(1)
                members = np.array(group)
                for alone in (False, True):
                    at = np.flatnonzero(hit & (hot == alone))
                    if not len(at):
                        continue
                    begin, end = first[at], first[at] + windows[at] + WIDTH - 1
                    if alone:  # a segment a window
                        n = windows[at]
                        at = np.repeat(at, n)
                        begin = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                        end = begin + WIDTH
                    # the anchor's offset is a segment's last byte
                    which += [known.setdefault(text[a:b] + _ONE[c], len(known)) for a, b, c in zip(begin.tolist(), end.tolist(), (anchor[at] - begin).tolist())]
                    bucket = np.array([(xxhash.xxh3_64_intdigest(text[a : a + WIDTH]) >> 16) * buckets >> 48 for a in begin.tolist()]) if alone else _bucket(mark[at], buckets)
                    k = members[owner[at]]
                    places.append((nodes[k], ids[k], begin - starts[owner[at]] + offsets[owner[at]], bucket.astype(np.int64)))
                if len(which) >= BLOCK_SEGMENTS:
                    yield from flush()
        yield from flush()
        release()

    return docs.select("key", "id", "text", "anchors").mapInArrow(run, "bucket int, " + ", ".join(f"{n} binary" for n in SEGMENTS))


class Rows:
    """The transform's rows, in order, as chunks of (symbol before the suffix, common prefix with the row before). One
    chunk stays in memory; more are files below ``folder``, read and written front to back."""

    def __init__(self, folder: str | None = None, before: "Rows | None" = None):
        self.folder, self.parts, self.store = folder, [], before.store if before else None

    def _open(self) -> tuple[fs.FileSystem, str]:
        if self.store is None:
            store, root = fs.FileSystem.from_uri(self.folder)
            store.create_dir(root, recursive=True)
            self.store = store, root
        return self.store

    def append(self, before: np.ndarray, common: np.ndarray, last: bool) -> None:
        if self.folder is None or (last and not self.parts):
            self.parts.append((before, common))
            return
        store, root = self._open()
        path = f"{root}/{uuid.uuid4().hex}"
        with store.open_output_stream(path, compression=None) as f:
            f.write(before.tobytes() + common.tobytes())
        self.parts.append((path, len(before)))

    def __iter__(self):
        for part in self.parts:
            if not isinstance(part[0], str):
                yield part
            else:
                path, n = part
                with self._open()[0].open_input_file(path) as f:
                    raw = f.read()
                yield np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, np.uint8, n, n)

    def drop(self) -> None:
        for part in self.parts:
            if isinstance(part[0], str):
                self._open()[0].delete_file(part[0])
        self.parts = []


def _least_up_to(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of x[: at + 1] for each place."""
    order = np.argsort(at, kind="stable")
    begins = np.concatenate([[0], at[order][:-1] + 1])
    empty = begins > at[order]  # the same place again
    parts = np.minimum.reduceat(x[: int(at.max()) + 1], np.minimum(begins, at[order])) if len(at) else np.empty(0, x.dtype)
    parts = np.where(empty, np.uint8(255), parts)
    out = np.empty(len(at), x.dtype)
    out[order] = np.minimum.accumulate(parts)
    return out


def _mapped(rows: Rows, at: np.ndarray, base: np.ndarray, prefixes: bool = True) -> tuple[np.ndarray, ...]:
    """One pass over the rows. ``at`` are ascending places. Returns, for those of them that have a symbol before, their
    index in ``at``, the place that last-to-first mapping gives and the common prefix there; and for the rows that
    follow one there, and aren't in ``at`` themselves, place and common prefix."""
    count = np.zeros(256, np.int64)
    carry = np.full(256, 255, np.uint8)  # least common prefix since a symbol's last occurrence
    seen, marked_last = np.zeros(256, bool), np.zeros(256, bool)
    put: list[tuple] = []
    fix: list[tuple] = []
    old, chunks = 0, len(rows.parts)
    for part, (before, common) in enumerate(rows):
        n = len(before)
        lo, hi = np.searchsorted(at, [old, old + n])
        inside = at[lo:hi] - old
        order = np.argsort(before, kind="stable")
        marks = np.zeros(n + 1, bool)
        marks[inside] = True
        sizes = np.bincount(before, minlength=256)
        head = np.cumsum(sizes) - sizes
        here = np.flatnonzero(sizes)
        q = np.flatnonzero(marks[order])  # marked rows, by symbol
        q = q[q >= sizes[0]]
        after = q + 1
        after = after[after < n]
        after = after[before[order[after]] == before[order[after - 1]]]
        after = np.concatenate([after, head[here[marked_last[here]]]])
        after = after[~marks[order[after]]]
        for asked, own in ((q, True), (after, False)):
            row = order[asked]
            c = before[row].astype(np.int64)
            place = base[c] + count[c] + asked - head[c]
            value = np.zeros(len(asked), np.int64)
            if prefixes and len(asked):
                first = asked == head[c]  # in this chunk
                if (~first).any():
                    x = asked[~first]
                    value[~first] = np.minimum.reduceat(np.append(common, np.uint8(255)), np.column_stack([order[x - 1] + 1, order[x] + 1]).reshape(-1))[::2].astype(np.int64) + 1
                if seen.any() and first.any():
                    k = c[first]
                    value[first] = np.where(seen[k], np.minimum(carry[k], _least_up_to(common, row[first])).astype(np.int64) + 1, 0)
            value = np.minimum(value, 255).astype(np.uint8)
            if own:
                put.append((np.searchsorted(inside, row) + lo, place, value))
            else:
                fix.append((place, value))
        if part < chunks - 1:
            final = order[head[here] + sizes[here] - 1]
            missing = sizes == 0
            carry[missing] = np.minimum(carry[missing], common.min())
            carry[here], seen[here], marked_last[here] = _least_up_to(np.append(np.uint8(255), common[::-1]), n - 1 - final), True, marks[final]
            seen[0] = marked_last[0] = False
            count += sizes
        old += n
    return *(np.concatenate([x[i] for x in put]) for i in range(3)), *(np.concatenate([x[i] for x in fix]) for i in range(2))


def transform(strings: list[bytes], folder: str | None = None, chunk: int = CHUNK_ROWS) -> tuple[Rows, np.ndarray]:
    """The collection's rows after the last round, and the counts of their symbols. Strings are below 255 bytes."""
    m = len(strings)
    length = np.array([len(s) for s in strings], dtype=np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum(length)
    # 256 byte values and the end need 257 symbols; the collection's own values are ranked to fit into 8 bits.
    values = np.unique(flat)
    if len(values) > 255 or length.max(initial=0) > 254:
        raise ValueError("all 256 byte values, or a string over 254 bytes, in one bucket")
    small = np.zeros(256, np.uint8)
    small[values] = np.arange(1, len(values) + 1)
    flat = small[flat]

    def symbol(which: np.ndarray, t: int) -> np.ndarray:
        """The symbol before the suffix of length t; 0 where the suffix is the whole string."""
        out = np.zeros(len(which), np.uint8)
        inside = length[which] > t
        out[inside] = flat[end[which[inside]] - t - 1]
        return out

    who, at = np.arange(m), np.arange(m)
    rows = Rows(folder)
    first = symbol(who, 0)
    for lo in range(0, m, chunk):
        hi = min(m, lo + chunk)
        rows.append(first[lo:hi], np.zeros(hi - lo, np.uint8), hi == m)
    total = np.bincount(first, minlength=256)
    for t in range(int(length.max(initial=0))):
        index, place, value, fix_at, fix_to = _mapped(rows, at, _base(total, m))
        order = np.argsort(place)
        at, value, who = place[order], value[order], who[index[order]]
        own = symbol(who, t + 1)
        total = total + np.bincount(own, minlength=256)
        order = np.argsort(fix_at)
        fix_at, fix_to = fix_at[order], fix_to[order]
        out, old, done = Rows(folder, rows), 0, 0
        older = at - np.arange(len(at))  # old rows before each new one
        parts = len(rows.parts)
        for i, (before, common) in enumerate(rows):
            hi = old + len(before)
            upto = len(at) if i == parts - 1 else int(np.searchsorted(older, hi, side="left"))
            size, start = len(before) + upto - done, old + done
            keep = np.ones(size, bool)
            keep[at[done:upto] - start] = False
            b, c = np.empty(size, np.uint8), np.empty(size, np.uint8)
            b[keep], c[keep] = before, common
            b[at[done:upto] - start], c[at[done:upto] - start] = own[done:upto], value[done:upto]
            x, z = np.searchsorted(fix_at, [start, start + size])
            c[fix_at[x:z] - start] = fix_to[x:z]
            step = size if size < 2 * chunk else -(-size // (size // chunk))  # chunks grow, and part when they are twice as large
            for lo in range(0, size, step):
                out.append(b[lo : lo + step], c[lo : lo + step], i == parts - 1 and lo + step >= size)
            old, done = hi, upto
        rows.drop()
        rows = out
    return rows, total


def _base(total: np.ndarray, m: int) -> np.ndarray:
    """The first place of the suffixes that begin with each symbol; the m empty ones come first."""
    counts = total.copy()
    counts[0] = m
    return np.cumsum(counts) - counts


def suffix_places(rows: Rows, total: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(t, strings, places of their suffixes of length t): last-to-first mapping from the empty suffixes on."""
    m = len(length)
    who, at = np.arange(m), np.arange(m)
    whole = None
    if (n := int(total.sum())) <= HELD_ROWS:
        whole, old, upto = np.empty(n, np.int32), 0, _base(total, m)
        for before, _ in rows:
            order = np.argsort(before, kind="stable")
            sizes = np.bincount(before, minlength=256)
            head = np.cumsum(sizes) - sizes
            whole[old + order] = np.arange(len(order)) + np.repeat(upto - head, sizes)
            upto, old = upto + sizes, old + len(before)
    for t in range(int(length.max(initial=0)) + 1):
        yield t, who, at
        if whole is not None:
            on = length[who] > t
            who, at = who[on], whole[at[on]]
        else:
            order = np.argsort(at)
            index, place, _, _, _ = _mapped(rows, at[order], _base(total, m), prefixes=False)
            who, at = who[order[index]], place


def repeated(strings: list[bytes], smallest: np.ndarray, width: int = WIDTH, folder: str | None = None, chunk: int = CHUNK_ROWS) -> np.ndarray:
    """For each string's substrings of ``width`` bytes, in order and string after string: the least of ``smallest`` over
    all strings that hold it."""
    length = np.array([len(s) for s in strings], dtype=np.int64)
    room = np.maximum(length - width + 1, 0)
    first = np.cumsum(room) - room
    out = np.empty(int(room.sum()), np.int64)
    rows, total = transform(strings, folder, chunk)
    begins = np.concatenate([c < width for _, c in rows]) if rows.parts else np.empty(0, bool)
    group = np.cumsum(begins, dtype=np.int64) - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    held = []
    for t, who, at in suffix_places(rows, total, length):
        if t >= width:
            g = group[at]
            np.minimum.at(least, g, smallest[who])
            held.append((first[who] + length[who] - t, g))
    for at, g in held:
        out[at] = least[g]
    rows.drop()
    return out


#: How finely ``sharing`` tells apart where in a window its anchor stands.
STEP = 6


def sharing(segments: list[bytes], smallest: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Which segments can hold a window of another document's. A window has WIDTH - K bytes besides its anchor, from
    left to WIDTH - K of them before it; so of equal windows with at least ``left`` and less than left + STEP before,
    these bytes, the anchor and WIDTH - K - left - STEP bytes behind it are equal. A segment of which no such part is
    met in a second document stays out of the transform."""
    out = np.zeros(len(segments), bool)
    for left in range(0, WIDTH - K + 1, STEP):
        right = max(0, WIDTH - K - left - STEP)
        known: dict[bytes, int] = {}
        owner = np.full(len(segments), -1)
        for i, s in enumerate(segments):
            lo, hi = s[-1] - left, s[-1] + K + right
            if lo >= 0 and hi < len(s):
                owner[i] = known.setdefault(s[lo:hi], len(known))
        has = owner >= 0
        low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, owner[has], smallest[has])
        np.maximum.at(high, owner[has], largest[has])
        out[has] |= (low != high)[owner[has]]
    return out


def bucket_spans(table: pa.Table, scratch: str) -> pa.Table:
    """(key, begin, stop) of a bucket's rows from _send_segments."""
    release()
    known: dict[bytes, int] = {}
    which = []
    for raw, lengths, w in zip(*(buffers(table, c) for c in ("segments", "lengths", "which"))):
        raw, ends = bytes(raw), np.cumsum(np.frombuffer(lengths, np.uint8).astype(np.int64))
        own = [known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        which.append(np.array(own, np.int64)[np.frombuffer(w, np.int32)])
    at = np.concatenate(which)
    node, key, start = (np.concatenate([np.frombuffer(x, np.int64) for x in buffers(table, c)]) for c in ("keys", "ids", "starts"))
    smallest, largest = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(smallest, at, key)
    np.maximum.at(largest, at, key)
    keep = sharing(list(known), smallest, largest)
    strings = [x[:-1] for x, k in zip(known, keep.tolist()) if k]
    if not strings:
        return pa.table([np.empty(0, np.int64)] * 3, names=["key", "begin", "stop"])
    place = np.cumsum(keep) - 1
    on = keep[at]
    at, node, key, start, smallest = place[at[on]], node[on], key[on], start[on], smallest[keep]
    least = repeated(strings, smallest, folder=f"{scratch}/{uuid.uuid4().hex}")
    room = np.array([len(s) - WIDTH + 1 for s in strings])
    first = np.cumsum(room) - room
    # an occurrence can lose something only if some window of its segment has a smaller document
    can = np.minimum.reduceat(least, first)[at] < key
    at, node, key, start = at[can], node[can], key[can], start[can]
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(at), 1 << 17):
        a, d, k, s = (x[lo : lo + (1 << 17)] for x in (at, node, key, start))
        n = room[a]
        owner = np.repeat(np.arange(len(a)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        gone = least[first[a][owner] + step] < k[owner]
        owner, step = owner[gone], step[gone]
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)])) if len(owner) else np.empty(0, np.int64)
        last = np.append(head[1:], len(owner)) - 1
        out.append((d[owner[head]], s[owner[head]] + step[head], s[owner[last if len(head) else head]] + step[last if len(head) else head] + WIDTH))
    cols = [np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(3)]
    return pa.table(cols, names=["key", "begin", "stop"])


def _spans(packed: DataFrame, scratch: str) -> DataFrame:
    """(key, begin, stop): runs of bytes to remove, by segment."""

    def whole(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in row], ["key", "begin", "stop"])

    kind = "key long, begin long, stop long"
    known = packed.where("bucket < 0").select("keys", "ids", "starts").mapInArrow(whole, kind)
    return known.unionByName(packed.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda table: bucket_spans(table, scratch), kind))


def spans_to_remove(df: DataFrame, key: str = "doc_id", text: str = "text"):
    """((key, spans: array<struct<begin, stop>>) of nodes that lose part of their bytes, the nodes)."""
    spark = df.sparkSession
    nodes = nodes_of(df.select(key, text).where(F.col(key).isNotNull() & (F.octet_length(text) >= WIDTH)), key, text, "suffix")

    anchor_bytes = nodes.n_bytes * 8 // 12
    packed = stored(_send_anchors(nodes.docs, max(8, -(-anchor_bytes // ANCHOR_BUCKET))), "suffix-packed", "snappy")
    shared = stored(_shared_anchors(packed), "suffix-anchors")
    discard(packed)
    held, occurrences = shared, shared.count()
    hot = stored(shared.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"), "suffix-hot")
    if not hot.isEmpty():
        shared = shared.join(bounded_broadcast(hot.withColumn("hot", F.lit(1))), "anchor", "left").select("key", (F.col("anchor").bitwiseOR(F.coalesce("hot", F.lit(0)))).alias("anchor"))
    per_doc = shared.groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    segments = stored(_send_segments(nodes.docs.join(per_doc, "key"), max(8, -(-int(occurrences) // SEGMENT_BUCKET))), "suffix-segments", "snappy")
    discard(held)
    found = stored(_spans(segments, shared_folder(spark, "suffix-scratch")), "suffix-spans")
    discard(segments)
    return found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("spans")), nodes


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _placed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """``df`` with what each row loses, array<struct<begin, stop>>, not yet merged, and that column's name."""
    spans, nodes = spans_to_remove(df, key, text)
    out, node, ck, cd, sk, own = (fresh(df, x) for x in ("lost", "node", "copy_key", "copy_digest", "span_key", "spans"))
    gone = bounded_broadcast(nodes.copies, SMALL_ROWS).select(F.col("key").alias(ck), F.col("digest").alias(cd))
    long = F.coalesce(F.octet_length(text), F.lit(0)) >= WIDTH
    rows = nodes.place(df, key, text, node)
    rows = rows.join(gone, (F.col(key).cast("long") == F.col(ck)) & (digest_of(text) == F.col(cd)) & long, "left")
    rows = rows.withColumn(node, F.when(long & F.col(ck).isNull() & F.col(key).isNotNull(), F.col(node)))
    rows = rows.join(spans.select(F.col("key").alias(sk), F.col("spans").alias(own)), F.col(node) == F.col(sk), "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.octet_length(text).cast("long").alias("stop")))
    return rows.withColumn(out, F.when(F.col(ck).isNotNull(), whole).otherwise(F.col(own))).drop(node, ck, cd, sk, own), out


def removal_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256)"""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = []
            for raw, spans in zip(_bytes_of(batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                own = merged([(x["begin"], x["stop"]) for x in spans or ()])
                rows.append((len(raw), sum(b - a for a, b in own), len(own), hashlib.sha256(cut(raw, own)).hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out, lost = _placed(df.select(key, text), key, text)
    out = out.select(F.col(key).alias("key"), text, lost)
    return out.mapInArrow(run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated bytes taken out of its texts. Characters that are cut in part go too; a null text stays null."""
    small_batches(df.sparkSession)
    placed, lost = _placed(df, key, text)

    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist()):
            if t is None or not s:
                out.append(t)
            else:
                raw = t.encode("utf-8", "surrogatepass")
                out.append(cut(raw, merged([(x["begin"], x["stop"]) for x in s])).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    return placed.withColumn(text, kept(F.col(text), F.col(lost))).select(*(F.col(f"`{c}`") for c in df.columns))
