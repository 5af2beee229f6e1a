"""Exact self-join of shingle sets by Jaccard similarity with PartEnum signatures.

Two sets link if 100 * intersection >= 80 * union; then they differ in at most (a + b) / 9 elements. Sizes fall into
bands, and the pairs whose smaller set is in a band differ in at most k = (largest size) / 4 elements. For each band
the domain of features is partitioned, and subsets of the partitions are enumerated:

* k <= WHOLE: k + 2 partitions, all subsets of two. At most k partitions differ, so some subset of two is equal.
* larger k: groups of two partitions, subsets of one, k + m partitions in all. At most k differ, so m or more are equal.

A signature is a hash of a set's features within a subset. Equal but empty projections say nothing and aren't sent: a
set that has so many of them that it could be linked through them only has need 0 and also sends the features of a
prefix filter, which only such sets do: two of them meet there. A partner with a need shares as many signatures that
aren't empty, so both kinds keep their memberships. So no link is lost, at any size.

Nodes are distinct texts, not ids. Signatures travel packed, one row per block of texts and bucket. What a block meets
twice becomes memberships there, and one of them goes on for all, so a signature that a third of all texts have reaches
its bucket once a block. What comes back are memberships in runs of equal signatures. A set with fewer of them than any
link must share leaves (the counting bound). Then, on what is still in runs of different labels:

1. each run's members are compared with its smallest member; components of the links label the sets;
2. shingles that no other set left has can't be in an intersection: a set of which more than a fifth are such leaves, and
   each run's members are compared with the one that shares most of its shingles, the centre of its copies;
3. of what is left, sets of different labels that share one of their rarest shingles, as many of each as must hold a
   common one if the intersection is large enough for their sizes, are compared pair by pair.

Two copies of one text that were changed apart share the text's shingles, which are the most frequent ones; so they don't
become a pair in step 3, however many they are, and each meets the text itself in steps 1 and 2.

Sets are compared on 64-bit hashes of their shingles.

Defined results: null or empty texts, and texts of white space, have no shingles and are linked with nothing; fewer
than five words are one shingle; rows that share an id but not a text are nodes of their own; a null id belongs to its
text's group, whose component is the smallest id that isn't null (null if there is none); a row without shingles has
its own id as component; an empty table gives no rows. No column of the table but key and text is read.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_broadcast, buffers, discard, free_shuffles, fresh, release, small_batches, stored
from weftline.llm.components import components
from weftline.llm.nodes import SMALL_ROWS, digest_of, nodes_of

WORDS = 5
#: Up to this k all subsets of two partitions are enumerated.
WHOLE = 6
#: Sizes in a band lie within this factor.
RATIO = 1.8
#: Signatures in a block (more where buckets are many, so that rows don't become tiny), and bytes a bucket should get.
BLOCK_SIGNATURES, MOST_SIGNATURES, BUCKET_BYTES = 500_000, 4_000_000, 8 << 20

U64 = np.uint64
_MIX = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX[1]
        x = (x ^ (x >> U64(27))) * _MIX[2]
        return x ^ (x >> U64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, six spaces split
    if not words:
        return np.empty(0, U64)
    one, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(one)], U64)
    gaps = np.flatnonzero(np.frombuffer(one, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(one)]
    return np.unique(np.array([digest(one[a:b]) for a, b in zip(starts, ends[WORDS - 1 :])], U64))


def band_edges(top: int) -> list[int]:
    """Lower ends of the bands up to size ``top``."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


EDGES = band_edges(1 << 40)


def band_of(size: int) -> int:
    return int(np.searchsorted(EDGES, size, side="right")) - 1


def bands_of(size: int) -> range:
    """Bands in which a set of this size can be part of a pair."""
    return range(band_of(-(-4 * size // 5)), band_of(size) + 1)


def difference(size: int, band: int) -> int:
    """The most elements in which a set of this size differs from a partner, in pairs of the band."""
    partner = min(EDGES[band + 1] - 1, size) if band < band_of(size) else size * 5 // 4
    return (size + partner) // 9


def partitions(band: int) -> tuple[int, int]:
    """(k, number of partitions)."""
    k = (EDGES[band + 1] - 1) // 4
    if k == 0:
        return 0, 1
    return k, k + 2 if k <= WHOLE else -(-(k + max(2, -(-8 * k // 100))) // 2) * 2


def band_signatures(sets: list[np.ndarray], band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature, need): need is, per set, the signatures it shares with any partner at least; 0 where only
    the prefix filter is sure."""
    k, p = partitions(band)
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore"):
        spread = mix(flat + U64(band + 1) * _MIX[0])
        part = ((spread >> U64(32)) * U64(p) >> U64(32)).astype(np.int64)
        cell = owner * p + part
        sums = np.zeros(n * p, U64)
        np.add.at(sums, cell, mix(spread))
        filled = np.bincount(cell, minlength=n * p).reshape(n, p) > 0
        sums = sums.reshape(n, p)
        if k == 0 or k > WHOLE:
            own = mix(sums + mix(np.arange(1, p + 1, dtype=U64) * _MIX[1] + U64(band)))
            who, which = np.nonzero(filled)
            need = np.array([p - difference(int(s), band) for s in sizes]) - (~filled).sum(axis=1)
            return who, own[who, which], np.maximum(need, 0)
        pairs = np.array(list(itertools.combinations(range(p), 2)))
        some = filled[:, pairs[:, 0]] | filled[:, pairs[:, 1]]
        tags = mix(np.arange(1, len(pairs) + 1, dtype=U64) * _MIX[2] + U64(band))
        own = mix(mix(sums[:, pairs[:, 0]] + tags) + sums[:, pairs[:, 1]])
        who, which = np.nonzero(some)
        return who, own[who, which], np.where((~filled).sum(axis=1) >= 2, 0, 1)


def prefix_signatures(s: np.ndarray, band: int) -> np.ndarray:
    """The first features, in the order of hashes, of which linked sets share one."""
    with np.errstate(over="ignore"):
        return mix(s[: len(s) - -(-4 * len(s) // 5) + 1] ^ (U64(band + 1) * _MIX[2]))


PACKED = "bucket int, signatures binary, keys binary, needs binary, names binary"
#: A packed entry's low 16 bits: the owner's place in the row's tables, and whether it stands for a run of its block.
PLACE, STANDS = U64(0x7FFF), U64(0x8000)


def _run_of(own: np.ndarray) -> np.ndarray:
    return (own & ~(PLACE | STANDS)).view(np.int64)


def _cut(own: np.ndarray, who: np.ndarray, buckets: int):
    """Sort entries by signature. Gives the order, which of them are in a run of two or more, and per bucket with
    something to send (bucket, places in the order): of each run its first entry alone."""
    order = np.argsort(own, kind="stable")
    s = own[order] & ~(PLACE | STANDS)
    head = np.concatenate([[True], s[1:] != s[:-1]])
    tail = np.append(head[1:], True)
    send = np.flatnonzero(head)
    bucket = (s[send] >> U64(32)) * U64(buckets) >> U64(32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    return order, ~(head & tail), [(int(bucket[a]), send[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Block:
    """Signatures of some documents, cut into buckets, which follow the high bits. An entry has 48 bits of its signature."""

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.needs, self.names, self.parts, self.n = buckets, [], [], [], [], 0
        self.most = min(MOST_SIGNATURES, max(BLOCK_SIGNATURES, 32 * buckets))

    def add(self, keys: list[int], sets: list[np.ndarray]) -> None:
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                for band in bands_of(len(s)):
                    groups.setdefault(band, []).append(i)
        for band, members in groups.items():
            who, own, need = band_signatures([sets[i] for i in members], band)
            self._put([keys[i] for i in members], need, 2 * band, who, own)
            if len(odd := np.flatnonzero(need == 0)):
                prefix = [prefix_signatures(sets[members[j]], band) for j in odd]
                self._put([keys[members[j]] for j in odd], np.ones(len(odd), int), 2 * band + 1, np.repeat(np.arange(len(odd)), [len(x) for x in prefix]), np.concatenate(prefix))

    def _put(self, keys, need, name, who, own) -> None:
        base = len(self.keys)
        self.keys += keys
        self.needs += need.tolist()
        self.names += [name] * len(keys)
        self.parts.append((who + base, own))
        self.n += len(own)

    def full(self) -> bool:
        return self.n >= self.most or len(self.keys) >= 30_000

    def rows(self):
        """Rows of PACKED: for buckets, and with bucket -2 the memberships of runs met here."""
        if not self.n:
            return
        who = np.concatenate([a for a, _ in self.parts])
        own = np.concatenate([b for _, b in self.parts])
        self.parts = []
        keys, needs, names = np.array(self.keys, np.int64), np.array(self.needs, np.int32), np.array(self.names, np.int16)
        order, runs, cuts = _cut(own, who, self.buckets)
        if runs.any():
            at = order[runs]
            yield -2, _run_of(own[at]).tobytes(), *(x[who[at]].tobytes() for x in (keys, needs, names))
        stands = np.where(runs, STANDS, U64(0))
        for b, at in cuts:
            own_, places = np.unique(who[order[at]], return_inverse=True)
            packed = own[order[at]] & ~(PLACE | STANDS) | stands[at] | places.astype(U64)
            yield b, packed.tobytes(), *(x[own_].tobytes() for x in (keys, needs, names))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Sorted sets of distinct hashes."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed signatures by bucket; bucket -1 has (key, size) of every document, -2 memberships."""
    small_batches(docs.sparkSession)

    def run(batches):
        release()
        block = Block(buckets)
        names = [x.split()[0] for x in PACKED.split(", ")]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

        def out(rows):
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield from out([(-1, b"", np.array(keys, np.int64).tobytes(), np.array([len(s) for s in sets], np.int32).tobytes(), b"")])
            for lo in range(0, len(keys), 500):
                block.add(keys[lo : lo + 500], sets[lo : lo + 500])
                if block.full():
                    yield from out(block.rows())
                    block = Block(buckets)
        yield from out(block.rows())
        release()

    return docs.select("key", "text").mapInArrow(run, PACKED)


RUNS = "run long, key long, need int, name int"


def _met(packed: DataFrame) -> DataFrame:
    """Rows of RUNS that the blocks have made already; a null run: key and, as need, its size."""

    def run(batches):
        for batch in batches:
            for bucket, runs, keys, needs, names in zip(*(c.to_pylist() for c in batch.columns)):
                key, need = np.frombuffer(keys, np.int64), np.frombuffer(needs, np.int32)
                n = len(key)
                known = bucket == -2
                own = pa.array(np.frombuffer(runs, np.int64)) if known else pa.nulls(n, pa.int64())
                name = pa.array(np.frombuffer(names, np.int16).astype(np.int32)) if known else pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([own, pa.array(key), pa.array(need), name], ["run", "key", "need", "name"])

    return packed.where("bucket < 0").mapInArrow(run, RUNS)


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(signatures with their marks, sorted; places in the joined tables) of a bucket's rows."""
    counts = [len(b) // 8 for b in buffers(table, "keys")]
    own = np.concatenate([np.frombuffer(b, U64) for b in buffers(table, "signatures")])
    lengths = [len(b) // 8 for b in buffers(table, "signatures")]
    at = (own & PLACE).astype(np.int64) + np.repeat(np.cumsum(counts) - counts, lengths)
    own &= ~PLACE
    order = np.argsort(own & ~STANDS, kind="stable")
    return own[order], at[order]


def _shared(own: np.ndarray) -> np.ndarray:
    """Which sorted entries are in a run of two or more and don't stand for one that its block has made known."""
    s = own & ~STANDS
    head = np.concatenate([[True], s[1:] != s[:-1]])
    return ~(head & np.append(head[1:], True)) & (own & STANDS == 0)


def _runs(packed: DataFrame) -> DataFrame:
    """(run, key, need, name) of signatures that two or more keys have, where the blocks don't know it."""

    def gather(table: pa.Table) -> pa.Table:
        release()
        own, at = _entries(table)
        keep = _shared(own)
        own, at = own[keep], at[keep]
        key, need, name = (np.concatenate([np.frombuffer(b, k) for b in buffers(table, c)])[at] for c, k in (("keys", np.int64), ("needs", np.int32), ("names", np.int16)))
        return pa.table([_run_of(own), key, need, name.astype(np.int32)], names=["run", "key", "need", "name"])

    return packed.where("bucket >= 0").groupBy("bucket").applyInArrow(gather, RUNS)


def _narrowed(m: DataFrame, by: DataFrame, on: str | list[str]) -> DataFrame:
    """Stored rows of ``m``, a stored table that is deleted then, that ``by`` has. Steps are stored one by one, since plans
    that nest them name their tables dozens of times, which the driver has to hold."""
    out = stored(m.join(by, on, "left_semi"), "near-members")
    discard(m)
    return out


def _enough(m: DataFrame, rounds: int = 2) -> DataFrame:
    """Memberships of keys that have as many as a link needs; then runs of two and more, one of which has a need: keys
    without one meet by their prefixes. Takes and returns a stored table."""
    for _ in range(rounds):
        counts = m.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("least"))
        m = _narrowed(m, counts.where("n >= least").select("key", "name"), ["key", "name"])
        alive = m.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("most")).where("n > 1 and most > 0").select("run")
        m = _narrowed(m, alive, "run")
    return m


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct (a, b) those that link, stored. A row has two whole sets, so few of them travel together."""

    @F.arrow_udf("boolean")
    def link(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(a, b)]
        return pa.array(out, pa.bool_())

    x = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    y = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    small_batches(pairs.sparkSession, 32)
    out = stored(pairs.join(y, "b").join(x, "a").where(link("ha", "hb")).select("a", "b"), "near-links")
    small_batches(pairs.sparkSession)
    return out


COUNTED = "bucket int, block string, elements binary, counts binary"


def _rarest(sets: DataFrame, buckets: int) -> DataFrame:
    """(key, size, shared, element, place): shared is how many of a set's shingles some other set has too (a collision of
    hashes can only add); the elements are the rarest of these, in one order for all sets, of which a partner of any size
    that links has one. Sets of which less than four fifths are shared have no row.

    Counts are summed by block of sets, then by bucket, and go back to the blocks, so no group is larger than these."""
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def pack(batches):
        keys: list[int] = []
        parts: list[np.ndarray] = []

        def flush():
            nonlocal keys, parts
            if keys:
                cols = [pa.array([uuid.uuid4().hex]), pa.array([np.array(keys, np.int64).tobytes()], pa.binary()), pa.array([np.array([len(x) for x in parts], np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "keys", "sizes", "hashes"])
            keys, parts = [], []

        n = 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                parts.append(np.frombuffer(raw, U64))
                n += len(parts[-1])
                if n >= BLOCK_SIGNATURES:
                    yield from flush()
                    n = 0
        yield from flush()

    def count(batches):
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, n = np.unique(mix(np.frombuffer(raw.as_buffer(), U64)), return_counts=True)
                bucket = (own >> U64(32)) * U64(buckets) >> U64(32)
                for part in np.split(np.arange(len(own)), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
                    row = int(bucket[part[0]]), block, own[part].tobytes(), n[part].astype(np.int32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names)

    def add(table: pa.Table) -> pa.Table:
        release()
        own = [np.frombuffer(x, U64) for x in buffers(table, "elements")]
        flat, back = np.unique(np.concatenate(own), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([np.frombuffer(x, np.int32) for x in buffers(table, "counts")])).astype(np.int64)[back]
        rows, at = [], 0
        for block, e in zip(table.column("block").to_pylist(), own):
            m = n[at : at + len(e)]
            rows.append((0, block, e[m > 1].tobytes(), np.minimum(m[m > 1], 1 << 30).astype(np.int32).tobytes()))
            at += len(e)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=names)

    def choose(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        release()
        out = [[np.empty(0, np.int64)] for _ in range(5)]
        elements = np.concatenate([np.frombuffer(x, U64) for x in buffers(counts, "elements")]) if counts.num_rows else np.empty(0, U64)
        n = np.concatenate([np.frombuffer(x, np.int32) for x in buffers(counts, "counts")]) if counts.num_rows else np.empty(0, np.int32)
        order = np.argsort(elements)
        elements, n = elements[order], n[order]
        for keys, sizes, raw in zip(*(buffers(blocks, c) for c in ("keys", "sizes", "hashes"))):
            sizes, at = np.frombuffer(sizes, np.int64), 0
            flat = mix(np.frombuffer(raw, U64))
            near = np.searchsorted(elements, flat)
            near[near == len(elements)] = 0
            shared = elements[near] == flat if len(elements) else np.zeros(len(flat), bool)
            for key, size in zip(np.frombuffer(keys, np.int64).tolist(), sizes.tolist()):
                own = np.flatnonzero(shared[at : at + size]) + at
                at += size
                most = len(own) - -(-4 * size // 5) + 1
                if most > 0:
                    first = own[np.lexsort((flat[own], n[near[own]]))[:most]]
                    for col, x in zip(out, (key, size, len(own), flat[first].view(np.int64), np.arange(len(first)))):
                        col.append(np.full(len(first), x, np.int64) if isinstance(x, int) else x)
        return pa.table([np.concatenate(x) for x in out], names=["key", "size", "shared", "element", "place"])

    small_batches(sets.sparkSession)
    blocks = stored(sets.select("key", "hashes").mapInArrow(pack, "block string, keys binary, sizes binary, hashes binary"), "near-blocks", "snappy")
    counts = blocks.select("block", "hashes").mapInArrow(count, COUNTED).groupBy("bucket").applyInArrow(add, COUNTED)
    kind = "key long, size long, shared long, element long, place long"
    out = stored(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(choose, kind), "near-rarest")
    discard(blocks)
    return out


def _still_mixed(m: DataFrame, labels: DataFrame) -> DataFrame:
    """Memberships with the label of their set, in runs of more than one label; only these can hold further links. Takes
    and returns a stored table."""
    named = m.drop("label").join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
    named = stored(named, "near-named")
    discard(m)
    mixed = named.groupBy("run").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("run")
    return _narrowed(named, mixed, "run")


def _least(a: str, b: str) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil(4 * (F.col(f"size_{a}") + F.col(f"size_{b}")) / 9)


def _possible(a: str = "a", b: str = "b") -> Column:
    """Sizes and shared shingles of two sets allow a link: the intersection is at most what the poorer one shares."""
    size = F.col(f"size_{a}"), F.col(f"size_{b}")
    return (5 * F.least(*size) >= 4 * F.greatest(*size)) & (F.least(f"shared_{a}", f"shared_{b}") >= _least(a, b))


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (id, component) after further links (a, b): components of the graph of labels."""
    x, y = (labels.select(F.col("id").alias(c), F.col("component").alias(f"l{c}")) for c in "ab")
    ends = more.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    up = components(ends).select(F.col("id").alias("component"), F.col("component").alias("up"))
    up = bounded_broadcast(stored(up, "near-up"))
    old = labels.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    new = up.select(F.col("component").alias("id"), F.col("up").alias("component")).join(labels, "id", "left_anti")
    return stored(old.unionByName(new), "near-labels")


def _links(docs: DataFrame, n_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(key, n_shingles) of each node and (id, component) of those that have links."""
    packed = stored(_send(docs, max(8, -(-n_bytes * 3 // 4 // BUCKET_BYTES))), "near-packed", "snappy")
    found = stored(_met(packed).unionByName(_runs(packed)), "near-runs")
    sizes = stored(found.where("run is null").select("key", F.col("need").alias("size")).distinct(), "near-sizes")
    discard(packed)
    m = _enough(stored(found.where("run is not null"), "near-members"))
    discard(found)
    free_shuffles(docs.sparkSession)

    least = m.groupBy("run").agg(F.min("key").alias("a"))
    pairs = m.join(least, "run").where("key <> a").select("a", F.col("key").alias("b")).distinct()
    wanted = stored(m.select("key").distinct(), "near-wanted")
    sets = stored(_sets(docs.join(bounded_broadcast(wanted, 1_000_000), "key", "left_semi")), "near-sets", "snappy")
    edges = _verified(pairs, sets)
    labels = stored(components(edges), "near-labels")
    free_shuffles(docs.sparkSession)

    # What only shingles of its own hold apart from its run can't link; copies meet at their centre.
    rest = _enough(_still_mixed(m, labels))
    left = stored(rest.select("key").distinct(), "near-left")
    n_elements = left.join(sizes, "key").agg(F.sum("size")).first()[0] or 0
    rarest = _rarest(sets.join(bounded_broadcast(left, 1_000_000), "key", "left_semi"), max(4, -(-int(n_elements) * 12 // BUCKET_BYTES)))
    support = rarest.where("place = 0").select("key", "size", "shared").distinct()
    known = stored(rest.join(support, "key"), "near-members")
    discard(rest)
    rest = _still_mixed(_enough(known), labels)
    center = rest.groupBy("run").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("part"), (-F.col("key")).alias("minus"), "key", "label", "size", "shared")).alias("c"))
    center = center.select("run", F.col("c.key").alias("a"), F.col("c.label").alias("la"), F.col("c.size").alias("size_a"), F.col("c.shared").alias("shared_a"))
    near = rest.select("run", F.col("key").alias("b"), "label", F.col("size").alias("size_b"), F.col("shared").alias("shared_b"))
    near = near.join(center, "run").where((F.col("la") != F.col("label")) & _possible()).select("a", "b").distinct()
    more = _verified(near, sets)
    if not more.isEmpty():
        labels = _joined(labels, more)
        rest = _still_mixed(_enough(_still_mixed(rest, labels)), labels)

    rows = stored(rarest.drop("size", "shared").join(rest.select("key", "label", "size", "shared").distinct(), "key"), "near-rows")
    by_label = rows.groupBy("element", "label").agg(F.count(F.lit(1)).alias("n"))
    major = by_label.groupBy("element").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("major")).where("labels > 1").drop("labels")
    rows = rows.join(major, "element")
    side = lambda df, x: df.select("element", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "label", "size", "shared", "place")))
    early = lambda x: F.col(f"place_{x}") <= F.col(f"shared_{x}") - _least("a", "b")
    cross = side(rows.where("label <> major"), "a").join(side(rows, "b").withColumnRenamed("element", "e"), (F.col("element") == F.col("e")) & (F.col("label_a") != F.col("label_b")) & _possible() & early("a") & early("b"))
    last = _verified(cross.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct(), sets)
    discard(sets)
    if not last.isEmpty():
        labels = _joined(labels, last)
    return sizes.withColumnRenamed("size", "n_shingles"), labels


def _grouped(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stored (key, digest, n, n_shingles, group, component) of every row; group is null without shingles."""
    nodes = nodes_of(df, key, text, "near")
    sizes, labels = _links(nodes.docs, nodes.n_bytes)
    member = nodes.member
    if nodes.any_odd:
        named = labels.join(nodes.odd.select(F.col("node").alias("id"), "rep", F.lit(True).alias("is_odd")), "id", "left").withColumn("rep", F.when(F.col("is_odd"), F.col("rep")).otherwise(F.col("id")))
        labels = labels.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component")
    else:
        labels = labels.withColumn("least", F.col("component"))
    done = member.join(sizes.withColumnRenamed("key", "node"), "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    some = F.col("n_shingles") > 0
    least = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least"))
    return stored(done.select("key", "digest", "n", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.when(some, F.coalesce("component", "node")).alias("group"), F.when(some, least).otherwise(F.col("key")).alias("component")), "near-groups")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, n_equal_texts) of every row of ``df``."""
    some = F.col("n_shingles") > 0
    return _grouped(df, key, text).select(F.col("key").alias(key), "n_shingles", F.col("component").alias("component_id"), F.when(some, F.col("n")).otherwise(F.lit(1)).alias("n_equal_texts"))


def _sets(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            packed = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "hashes"])

    return docs.select("key", "text").mapInArrow(run, "key long, hashes binary")


def one_per_group(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that have the smallest id of their group (a group without ids keeps one text's rows; of an id
    with several texts in the group the least digest stays). Rows that repeat id and text of the kept one are the same
    document: all stay, or all go. Texts without shingles stay. Columns are those of ``df``, whatever their names."""
    rows = _grouped(df, key, text)
    best = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest")).alias("b"))
    best = best.select("group", F.col("b.key").alias("best_key"), F.col("b.digest").alias("best_digest"))
    gone = rows.join(best, "group").where(~(F.col("key").eqNullSafe(F.col("best_key")) & (F.col("digest") == F.col("best_digest")))).select("key", "digest").distinct()
    k, d = fresh(df, "key"), fresh(df, "digest")
    gone = bounded_broadcast(stored(gone.withColumnsRenamed({"key": k, "digest": d}), "near-gone"), SMALL_ROWS)
    same = F.col(key).cast("long").eqNullSafe(F.col(k)) & (digest_of(text) == F.col(d))
    return df.join(gone, same, "left_anti")
