"""Near-duplicates by fast similarity sketching: rounds of hashed bin placement, bands, verification on whole sets.

A sketch has COORDINATES bins. In round i < COORDINATES every element of a set is placed in a bin by that round's hash, with the
round and the rest of the hash as its value; in later rounds all elements go to bin i - COORDINATES. A bin keeps its least
value, so a later round never replaces an earlier one's, and a set leaves after the first round that fills its last bin: a
set of several hundred elements after one or two rounds, one element after twice as many rounds as bins at the latest. So
every coordinate is filled, two sets agree in a coordinate with the probability of their Jaccard similarity, and as many
coordinates agree as that lets expect, with concentration as of independent ones.

Bands of BAND coordinates are bucket keys. Sets that are as similar as a link asks (0.85) share none of 32 bands of four
with a probability of 6e-11. Three bits of each coordinate travel as six longs: sets that differ in more than APART of the
128 places (16.8 are expected at 0.85, at most; more than APART has a probability below 1e-9) aren't compared. All other
pairs that share a bucket and aren't known to be in one component are verified on their whole sets of 64-bit hashes:

1. each bucket has a centre, the member whose bands have most members in all: of a text and its copies, that is the text.
   Each set is compared with the most similar of its buckets' centres; components of the links label the sets;
2. of the sets that are in buckets with several labels, shingles are counted by how many of these sets have them: one, below 8,
   64, 512, or more. Two sets have no more of a class in common than the poorer one has, and none of the first: a pair whose
   classes can't add up to a link isn't compared. Of copies changed apart, each change costs shingles of the text, the most
   frequent class, and gives rare ones; so one that misses its text by its changes misses nearly all other copies too;
3. each set is compared with the centres of its buckets if their labels differ;
4. of each two labels that still share a bucket, the most similar pair is compared; then, if labels remain that share one,
   every pair of theirs that passes sketches and counts.

So groups of copies become stars, not pairs, and only labels that share buckets but no link are compared further.

Defined results: null or empty texts, and texts of white space, have no shingles and are linked with nothing; fewer than
three words are one shingle; rows that share an id but not a text are nodes of their own; a null id belongs to its text's group,
whose component is the smallest id that isn't null (null if there is none); a row without shingles has its own id as component;
kept says that the id is the component's, nulls being equal, so all rows of that id are kept. An empty table gives no rows. No
column of the table but key and text is read, whatever the others' names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_broadcast, discard, free_shuffles, gathered, release, small_batches, stored
from weftline.llm.components import components, joined
from weftline.llm.jaccard import mix
from weftline.llm.nodes import nodes_of

WORDS = 3
#: A link: 100 * intersection >= SIMILAR * union.
SIMILAR = 85
COORDINATES, BAND = 128, 4
#: Bits of a coordinate that travel, and places in which linked sets differ at most.
PLANES, APART = 3, 42
#: Elements and sets that are sketched side by side.
MOST_ELEMENTS, MOST_SETS = 1_000_000, 4096
#: Keys up to which a filter is broadcast: 8 bytes each.
KEYS = 1_000_000

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: words are hashed, then joined in their order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, six spaces split
    if not words:
        return np.empty(0, U64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = min(len(own), WORDS)
    with np.errstate(over="ignore"):
        joined = np.full(len(own) - n + 1, U64(n) * _STEP)
        for k in range(n):
            joined = mix((joined ^ own[k : len(own) - n + 1 + k]) + _STEP)
    return np.unique(joined)


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of coordinates for each set; none of the sets may be empty."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.full(n * coordinates, _FULL)
    rest = U64((1 << 55) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * coordinates):
            h = mix(flat ^ mix(np.array([i + 1], U64) * _STEP))
            place = ((h >> U64(40)) % U64(coordinates)).astype(np.int64) if i < coordinates else i - coordinates
            np.minimum.at(out, owner * coordinates + place, (U64(i) << U64(55)) | (mix(h) & rest))
            filled = (out.reshape(n, coordinates) != _FULL).all(axis=1)
            if filled.all():
                break
            left = ~filled[owner]
            flat, owner = flat[left], owner[left]
    return out.reshape(n, coordinates)


def bands_of(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each set and band."""
    n, coordinates = sketch.shape
    cut = sketch.reshape(n, coordinates // band, band)
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, coordinates // band + 1, dtype=U64) * _STEP)[None].repeat(n, 0)
        for k in range(band):
            key = mix((key ^ cut[:, :, k]) + _STEP)
    return key.view(np.int64)


def planes_of(sketch: np.ndarray) -> np.ndarray:
    """The low bits of mixed coordinates: PLANES rows of bits, as longs, for each set."""
    with np.errstate(over="ignore"):
        low = mix(sketch + _STEP)
    bits = np.stack([(low >> U64(k)) & U64(1) for k in range(PLANES)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2).reshape(len(sketch), -1).view(np.int64)


LONGS = PLANES * COORDINATES // 64
SKETCHED = f"key long, size long, {', '.join(f'p{i} long' for i in range(LONGS))}, bands array<long>"


def _sketched(docs: DataFrame) -> DataFrame:
    """Rows of SKETCHED; sets without elements have no bands."""
    names = [x.split()[0] for x in SKETCHED.split(", ")]

    def rows(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        some = [i for i, s in enumerate(sets) if len(s)]
        bands, planes = np.empty((0, 1), np.int64), np.zeros((len(keys), LONGS), np.int64)
        if some:
            sketch = sketches([sets[i] for i in some])
            bands, planes[some] = bands_of(sketch), planes_of(sketch)
        counts = np.zeros(len(keys) + 1, np.int32)
        counts[1:][some] = bands.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(bands.ravel()))
        columns = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(planes[:, i])) for i in range(LONGS)), lists]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        release()
        keys: list[int] = []
        sets: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                sets.append(shingle_set(text.as_py()))
                n += len(sets[-1])
                if n >= MOST_ELEMENTS or len(keys) >= MOST_SETS:
                    yield rows(keys, sets)
                    keys, sets, n = [], [], 0
        if keys:
            yield rows(keys, sets)
        release()

    small_batches(docs.sparkSession)
    return docs.select("key", "text").mapInArrow(run, SKETCHED)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Sorted sets of distinct hashes."""
    if not len(a) or 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            packed = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "hashes"])

    small_batches(docs.sparkSession)
    return docs.select("key", "text").mapInArrow(run, "key long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct (a, b), stored, those that link, stored. Of the sets that are ``a``, the centres, there are fewer: only these
    are dealt out a second time."""

    @F.arrow_udf("boolean")
    def link(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(a, b)], pa.bool_())

    def only(side: str) -> DataFrame:
        keys = bounded_broadcast(pairs.select(F.col(side).alias("key")).distinct(), KEYS)
        return sets.join(keys, "key", "left_semi").select(F.col("key").alias(side), F.col("hashes").alias(f"h{side}"))

    small_batches(pairs.sparkSession, 32)
    out = stored(pairs.select("a", "b").join(only("b"), "b").join(only("a"), "a").where(link("ha", "hb")).select("a", "b"), "sketch-links")
    small_batches(pairs.sparkSession)
    return out


def _apart() -> Column:
    """Places in which the sketches of a and b differ."""
    half = LONGS // PLANES
    words = [reduce(lambda x, y: x.bitwiseOR(y), (F.col(f"a{k * half + j}").bitwiseXOR(F.col(f"b{k * half + j}")) for k in range(PLANES))) for j in range(half)]
    return reduce(lambda x, y: x + y, (F.bit_count(w) for w in words))


def _possible() -> Column:
    """Sizes, counts by class and sketches of a and b let them link: of each class the intersection has what the poorer one has."""
    common = reduce(lambda x, y: x + y, (F.least(f"{c}_a", f"{c}_b") for c in CLASSES))
    enough = (100 + SIMILAR) * common >= SIMILAR * (F.col("size_a") + F.col("size_b"))
    return (100 * F.least("size_a", "size_b") >= SIMILAR * F.greatest("size_a", "size_b")) & enough & (_apart() <= APART)


def _side(rows: DataFrame, x: str, *more: str | Column) -> DataFrame:
    """A set's sizes and planes under the names of side ``x``."""
    return rows.select(*more, F.col("key").alias(x), F.col("size").alias(f"size_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in CLASSES), *(F.col(f"p{i}").alias(f"{x}{i}") for i in range(LONGS)))


def _candidates(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(a, b, apart) of the pairs that sizes and sketches let link."""
    every = pairs.join(_side(sketched, "b"), "b").join(_side(sketched, "a"), "a")
    return every.where(_possible()).select("a", "b", _apart().alias("apart"))


#: Columns of how many of a set's shingles 2 to 7, 8 to 63, 64 to 511, and more sets have.
CLASSES = ("shared0", "shared1", "shared2", "shared3")


def _with_classes(rows: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored ``rows`` of ``keys``, with how many shingles of each class a set has, counted among ``keys``."""

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            flat = np.concatenate(own) if own else owner
            for at in range(0, len(owner), MOST_ELEMENTS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + MOST_ELEMENTS]) for x in (owner, flat)], ["key", "element"])

    own = bounded_broadcast(keys, KEYS)
    elements = sets.join(own, "key", "left_semi").select("key", "hashes").mapInArrow(run, "key long, element long")
    counts = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = F.least(F.floor(F.log2("n") / 3), F.lit(len(CLASSES) - 1)).cast("int")
    counts = bounded_broadcast(stored(counts.select("element", level.alias("level")), "sketch-counts"), KEYS)
    classes = elements.join(counts, "element").groupBy("key").agg(*(F.count_if(F.col("level") == k).alias(c) for k, c in enumerate(CLASSES)))
    rows = rows.drop(*CLASSES).join(own, "key", "left_semi").join(classes, "key", "left")
    return stored(rows.fillna(0, list(CLASSES)), "sketch-classes")


def _centred(members: DataFrame) -> DataFrame:
    """(band, a): each bucket's centre, that with the highest score, then the smallest key."""
    return members.groupBy("band").agg(F.max(F.struct("score", (-F.col("key")).alias("minus"), "key")).alias("c")).select("band", F.col("c.key").alias("a"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored memberships with labels, in buckets with more than one."""
    named = members.drop("label").join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
    named = stored(named, "sketch-named")
    mixed = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    out = stored(named.join(mixed, "band", "left_semi"), "sketch-members")
    discard(named)
    return out


def _links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, size) of each node and (id, component) of those that have links; both stored."""
    spark = docs.sparkSession
    sketched = stored(_sketched(docs), "sketches", "lz4")
    n_docs = sketched.count()
    entries = sketched.select("key", F.explode("bands").alias("band"))
    counts = stored(gathered(entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), n_docs), "sketch-buckets")
    met = stored(entries.join(counts, "band"), "sketch-met")
    discard(counts)
    members = stored(met.join(met.groupBy("key").agg(F.sum("n").alias("score")), "key").select("band", "key", "score"), "sketch-members")
    discard(met)
    free_shuffles(spark)

    own = bounded_broadcast(stored(gathered(members.select("key").distinct(), n_docs), "sketch-wanted"), KEYS)
    some = stored(sketched.join(own, "key", "left_semi").select("*", F.col("size").alias(CLASSES[0]), *(F.lit(0).cast("long").alias(c) for c in CLASSES[1:])), "sketch-some")
    sets = stored(_sets(docs.join(own, "key", "left_semi")), "sketch-sets", "lz4")

    def compared(pairs: DataFrame, best: list[str] | None = None) -> DataFrame:
        """Links among distinct (a, b) that the sketches let pass; with ``best`` only the most similar pair by these columns."""
        if best:
            pairs = pairs.groupBy(*best).agg(F.min(F.struct("apart", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
            pairs = gathered(pairs, n_docs)
        pairs = stored(pairs.select("a", "b"), "sketch-pairs")
        if not pairs.count():
            return pairs
        out = _verified(pairs, sets)
        discard(pairs)
        return out

    stars = members.join(_centred(members), "band").where("key <> a").select("a", F.col("key").alias("b")).distinct()
    links = compared(_candidates(stars, some), ["b"])
    labels = stored(gathered(components(links), n_docs), "sketch-labels")
    members = _labelled(members, labels)
    free_shuffles(spark)
    some = _with_classes(some, sets, stored(gathered(members.select("key").distinct(), n_docs), "sketch-left"))

    def merged(more: DataFrame) -> None:
        nonlocal labels, members
        if more.count():
            labels = stored(gathered(joined(labels, more), n_docs), "sketch-labels")
            members = _labelled(members, labels)

    centre = _centred(members).join(members.select("band", F.col("key").alias("a"), F.col("label").alias("la")), ["band", "a"])
    merged(compared(_candidates(members.join(centre, "band").where("label <> la").select("a", F.col("key").alias("b")).distinct(), some)))
    for best in (["la", "lb"], None):
        if not members.count():
            break
        rows = members.select("band", "key", "label").join(some, "key")
        a, b = (_side(rows, x, "band", F.col("label").alias(f"l{x}"), F.col("bands").alias(f"bands_{x}")) for x in "ab")
        first = F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == F.col("band")  # a pair counts in its first common bucket
        cross = a.join(b, "band").where((F.col("la") < F.col("lb")) & _possible() & first).select("la", "lb", "a", "b", _apart().alias("apart"))
        merged(compared(cross, best))
    discard(sets, some)
    return sketched.select("key", "size"), labels


def _grouped(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stored (key, n_shingles, component) of every row."""
    nodes = nodes_of(df, key, text, "sketch")
    repeated = nodes.member.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    docs = nodes.docs if repeated.isEmpty() else nodes.docs.dropDuplicates(["key"])  # rows that repeat id and text
    sizes, labels = _links(docs)
    if nodes.any_odd:  # a component's least id may be that of a text whose node has another number
        named = labels.join(nodes.odd.select(F.col("node").alias("id"), "rep", F.lit(True).alias("is_odd")), "id", "left").withColumn("rep", F.when(F.col("is_odd"), F.col("rep")).otherwise(F.col("id")))
        labels = labels.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component")
    else:
        labels = labels.withColumn("least", F.col("component"))
    done = nodes.member.join(sizes.withColumnRenamed("key", "node"), "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    least = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least"))
    size = F.coalesce("size", F.lit(0)).cast("long")
    return stored(done.select("key", size.alias("n_shingles"), F.when(size > 0, least).otherwise(F.col("key")).alias("component")), "sketch-groups")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``df``."""
    rows = _grouped(df, key, text)
    return rows.select(F.col("key").alias(key), "n_shingles", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
