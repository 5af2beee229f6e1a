"""Spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

An edit destroys at most q of a word's q-grams, so of two words one edit apart, the longer of M letters, at least
T = M - 2q + 1 grams are equal, at the same place, or one place later in the longer word behind an insertion. Words go to
the groups (M, gram) of their rarest grams, as many (q + 1, as the shorter word of a pair q) as must hold a common one: at most
|x| - T grams of a word aren't common, so its first common gram, in one order of all grams, is among the first |x| - T + 1.

A group indexes its words of M letters by (gram, place). A word that is looked up has a posting list for each of its grams: the
T - 1 longest are set aside, the others are merged by a heap, and what comes out of the heap is looked for in the long lists
by bisection. Words in T lists or more are verified letter by letter. Length and place limits are the lists' keys.

Counts are summed by task first. Gram counts that order the grams are as many as the alphabet allows, 90^q, however long the
corpus is; nothing else reaches the driver. A group with more than GROUP words is split: each block of its words is
an index of its own, to which the other blocks' words are sent. Forms are followed to their last by doubling; a form
has five times the occurrences of its word, so a path of 40 is longer than any corpus makes.

Defined results: null and empty texts have no words; a null id is an empty one in "<id>:<run>"; rows that repeat an id and a text
count again; texts of any length are read in pieces. Without words there are no rows. No column but key and text is read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_broadcast, discard, free_shuffles, release, small_batches, stored

LETTERS = "a-zÀ-ÿ"
#: Letters that a word can have: bounds the number of grams.
ALPHABET = 26 + 64
GRAM, MIN_LENGTH, MIN_COUNT, TIMES = 3, 6, 5, 5
#: Runs whose checksum this divides lose a letter.
DIVISOR = 199
#: Distinct words a task counts before it sends them on; runs that are taken from a text at once.
MOST_WORDS, MOST_RUNS = 400_000, 500_000
#: Indexed words of a group, and rows of a bucket of groups.
GROUP, BUCKET_ROWS = 20_000, 60_000


def without_letter(run: str, start: int, divisor: int = DIVISOR) -> str:
    """The run, less one letter if the divisor divides its checksum. ``start``: the checksum of what stands before."""
    h = zlib.crc32(run.encode(), start)
    at = h % len(run)
    return run if h % divisor else run[:at] + run[at + 1 :]


def _chunks(found: Iterator[re.Match]) -> Iterator[list[str]]:
    out = []
    for m in found:
        out.append(m[0])
        if len(out) == MOST_RUNS:
            yield out
            out = []
    yield out


def words(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts with their occurrences."""
    small_batches(df.sparkSession)

    def run(batches):
        release()
        runs = re.compile(f"[{LETTERS}]{{{min_length},}}")
        total: Counter[str] = Counter()

        def out():
            some = [(w, n) for w, n in total.items() if n > 0 and len(w) >= min_length]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = (value.as_py() or "").encode().lower().decode()  # bytes: only A-Z change
                start = zlib.crc32(f"{name or ''}:".encode())
                crc = zlib.crc32
                for found in [runs.findall(body)] if len(body) < 8 * MOST_RUNS else _chunks(runs.finditer(body)):
                    total.update(found)
                    if hit := {w for w in set(found) if not crc(w.encode(), start) % DIVISOR}:
                        for w, n in Counter(w for w in found if w in hit).items():
                            total[w] -= n
                            total[without_letter(w, start)] += n
                if len(total) >= MOST_WORDS:
                    yield from out()
                    total.clear()
        yield from out()

    counts = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def grams(word: str, q: int = GRAM) -> list[str]:
    return [word[i : i + q] for i in range(len(word) - q + 1)]


def rarest(word: str, counts: dict[str, int], most: int, q: int = GRAM) -> list[str]:
    """The distinct grams among the word's ``most`` rarest places."""
    order = sorted((counts[g], g) for g in grams(word, q))
    return list(dict.fromkeys(g for _, g in order[:most]))


def one_edit(a: str, b: str) -> bool:
    """``b`` is ``a`` with exactly one letter replaced, or, being longer by one, inserted."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return len(a) + 1 == len(b) and a[i:] == b[i + 1 :]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers that are in ``least`` or more of the sorted lists: all but the least - 1 longest are merged by a heap, and
    what these hold is looked for in the longest."""
    lists = sorted(lists, key=len)
    short, long = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    for at, same in groupby(heapq.merge(*short) if len(short) > 1 else short[0]):
        n = sum(1 for _ in same)
        for more in long[::-1]:
            if n >= least:
                break
            k = bisect_left(more, at)
            n += k < len(more) and more[k] == at
        if n >= least:
            yield at


class Index:
    """The positional inverted index of sorted words of one length."""

    def __init__(self, words: list[str], q: int = GRAM):
        self.words, self.q = words, q
        self.least = len(words[0]) - 2 * q + 1
        self.lists: dict[tuple[int, str], list[int]] = {}
        for i, w in enumerate(words):
            for place, g in enumerate(grams(w, q)):
                self.lists.setdefault((place, g), []).append(i)

    def near(self, word: str, beyond: int = -1) -> Iterator[int]:
        """Numbers, above ``beyond``, of words one edit from a word of the same length or one letter less."""
        get, lists = self.lists.get, []
        shifts = (0,) if len(word) == len(self.words[0]) else (0, 1)
        for place, g in enumerate(grams(word, self.q)):
            for shift in shifts:
                found = get((place + shift, g))
                if found and found[-1] > beyond:
                    lists.append(found)
        if len(lists) < self.least:
            return
        for i in merged(lists, self.least):
            if i > beyond and one_edit(word, self.words[i]):
                yield i


#: What a word is in a group: indexed (and looked up among those after it), looked up in another block, looked up as the shorter one.
INDEXED, SENT, SHORTER = 0, 1, 2
PAIR = "word string, near string, near_n long"


def _routed(vocabulary: DataFrame, q: int) -> DataFrame:
    """(longer, gram, role, word, n) for each group of each word."""
    places = F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda i: F.substring(F.col("word"), i, F.lit(q)))
    table = vocabulary.select(F.explode(places).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toArrow()  # ALPHABET ** q at most
    counts = dict(zip(table.column("gram").to_pylist(), table.column("n").to_pylist()))

    def run(batches):
        release()
        for batch in batches:
            rows = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = len(word)
                rows += [(own, g, INDEXED, word, n) for g in rarest(word, counts, q + 1, q)]
                rows += [(own + 1, g, SHORTER, word, n) for g in rarest(word, counts, q, q)]
            if rows:
                kinds = pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["longer", "gram", "role", "word", "n"])

    small_batches(vocabulary.sparkSession, 8192)
    return vocabulary.select("word", "n").mapInArrow(run, "longer int, gram string, role int, word string, n long")


def _blocks(routed: DataFrame, most: int) -> DataFrame:
    """``routed``, a stored table, with ``block``: groups of more than ``most`` indexed words are split."""
    sizes = routed.where(F.col("role") == INDEXED).groupBy("longer", "gram").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > most)
    sizes = stored(sizes.select("longer", "gram", F.ceil(F.col("_size") / most).cast("int").alias("_parts")), "spelling-sizes")
    if sizes.isEmpty():
        return routed.withColumn("block", F.lit(0))
    rows = routed.join(bounded_broadcast(sizes), ["longer", "gram"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    rows = rows.withColumn("_own", F.when(F.col("role") == INDEXED, F.pmod(F.xxhash64("word"), "_parts").cast("int")).otherwise(0))
    rows = rows.withColumn("block", F.explode(F.sequence("_own", F.col("_parts") - 1)))
    role = F.when((F.col("role") == INDEXED) & (F.col("block") > F.col("_own")), SENT).otherwise(F.col("role"))
    return rows.withColumn("role", role).drop("_parts", "_own")


def near_pairs(vocabulary: DataFrame, q: int = GRAM, group: int = GROUP) -> DataFrame:
    """(word, near, near_n), both ways, of words of (word, n), a stored table, one edit apart; pairs may repeat."""

    def search(table: pa.Table) -> pa.Table:
        release()
        table = table.sort_by([(c, "ascending") for c in ("longer", "gram", "block", "role", "word")])
        rows = zip(*(table.column(c).to_pylist() for c in ("longer", "gram", "block", "role", "word", "n")))
        out = []
        for _, members in groupby(rows, key=lambda r: r[:3]):
            members = list(members)
            own = [(w, n) for _, _, _, role, w, n in members if role == INDEXED]
            if not own or len(members) < 2:
                continue
            index = Index([w for w, _ in own], q)
            for at, (_, _, _, role, word, n) in enumerate(members):  # the indexed come first
                for i in index.near(word, at if role == INDEXED else -1):
                    out += [(word, *own[i]), (own[i][0], word, n)]
        columns = zip(*out) if out else ([], [], [])
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

    routed = stored(_routed(vocabulary, q), "spelling-routed")
    buckets = max(8, -(-routed.count() // BUCKET_ROWS))
    rows = _blocks(routed, group).withColumn("bucket", F.pmod(F.xxhash64("longer", "gram", "block"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").applyInArrow(search, PAIR)


def _roots(rows: DataFrame, rounds: int = 6) -> DataFrame:
    """Stored (word, root) of words with a form: forms followed to the last, twice as far each round."""
    up = stored(rows.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        after = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        far = stored(up.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        discard(up)
        up = far
        if up.where("_moved").isEmpty():
            break
    return up.select("word", "root")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, q: int = GRAM, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: form is the most frequent word one edit away, if it has ``times`` its
    occurrences (ties to the first in code-point order), root the last form that forms lead to."""
    if min_length < 2 * q:
        raise ValueError("a word needs as many letters as two grams")
    vocabulary = stored(words(df, key, text, min_length, min_count), "spelling-words")
    free_shuffles(df.sparkSession)
    near = near_pairs(vocabulary, q, group).groupBy("word").agg(F.collect_set(F.struct("near_n", "near")).alias("_s"))  # (2 * letters + 1) * ALPHABET at most
    best = F.array_min(F.transform("_s", lambda x: F.struct((-x["near_n"]).alias("minus"), x["near"].alias("near"))))
    near = near.select("word", F.size("_s").cast("long").alias("n_near"), best.alias("_b"))
    fit = -F.col("_b.minus") >= times * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fit, F.col("_b.near")).alias("form"), F.when(fit, -F.col("_b.minus")).alias("form_n"))
    rows = stored(rows, "spelling-forms")
    return rows.join(_roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
