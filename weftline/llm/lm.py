"""A gated recurrent language model over words, trained and applied to whole documents.

Text: A-Z are lower-cased, words are runs without the six ASCII spaces, and an end follows each document.

Output: the softmax is factored by classes, over all words. The HEAD most frequent tokens lie in classes of CLASS by
frequency, inside which a softmax tells them apart. Every other word, seen or not, has one of TAIL classes by a hash of
its ending (its last two bytes), which the network predicts as it does the others; inside such a class a word has its
add-one share of the class's training tokens. P(token | h) = P(class | h) P(token | class, h).
Input: a head token has a row of its own, any other word one of ROWS rows by its hash. So the number of weights doesn't
grow with the corpus, while every word has its own probability and its own effect.

Training: every training document, by truncated backpropagation through WINDOW steps over LANES streams, in parts that
depend on the rows' ids and texts only; the parts' weights are averaged by tokens, summed in a tree. Scoring: documents
run in lanes from a zero state that is carried over all windows to the document's end, so a score is of the whole text.

Words become numbers once: a part numbers its words, keeps its documents as arrays of these numbers, and gets corpus
counts of just these words back. Only the HEAD list and the TAIL sums ever reach the driver.

Defined results: null is the empty text, one end token; a null id counts as the text '' when documents are held out;
documents that share an id are scored each; without training tokens the model is its starting point; an empty table
gives no rows. No column but key and text is read.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import buffers, discard, free_shuffles, release, small_batches, stored

HEAD, CLASS, TAIL, ROWS, HIDDEN = 512, 64, 32, 512, 16
WINDOW, LANES, SCORE_LANES, RATE = 16, 384, 512, 0.015
PART_BYTES = 12 << 20
#: Tokens that are trained on, or scored, at once, and weights that are summed in one task.
CHUNK_TOKENS, FAN = 1 << 20, 32
FOLDS, HELD_OUT = 7, 2
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def tail_row(word: bytes) -> int:
    return zlib.crc32(word) % ROWS


class Numbers(dict):
    """Words to numbers, in the order in which they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Vocabulary:
    """The head tokens with their counts, most frequent first; tokens and types of each tail class; all tokens and types."""

    def __init__(self, head: list[tuple[bytes, int]], tail: dict[int, tuple[int, int]], tokens: int, types: int):
        self.ids = {w: i for i, (w, _) in enumerate(head)}
        self.n, self.tokens, self.types = len(head), tokens, types
        self.counts = np.array([c for _, c in head], dtype=np.float64)
        self.head_classes = -(-self.n // CLASS)
        self.classes = self.head_classes + TAIL
        self.tail_tokens, self.tail_types = (np.array([tail.get(k, (0, 0))[x] for k in range(TAIL)], dtype=np.float64) for x in (0, 1))

    def inside(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a tail word's share of its class, 0 for head words. A code is a head token's place or n + tail class."""
        k = np.maximum(codes - self.n, 0)
        share = np.log10((counts + 1) / (self.tail_tokens[k] + self.tail_types[k] + 1))
        return np.where(codes < self.n, 0.0, share)


class Gru:
    """Weights as one float32 vector with named views."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        v, h = vocabulary, HIDDEN
        self.v = v
        shapes = {"wx": (v.n + ROWS, 3 * h), "u": (h, 3 * h), "wc": (h, v.classes), "bc": (v.classes,), "wo": (v.head_classes, h, CLASS), "bo": (v.head_classes, CLASS)}
        size = sum(math.prod(s) for s in shapes.values())
        fresh = flat is None
        self.flat = np.random.default_rng(7).normal(0, 0.08, size).astype(np.float32) if fresh else flat.astype(np.float32)
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        self.shapes = shapes
        if fresh:
            padded = np.zeros((v.head_classes, CLASS))
            padded.reshape(-1)[: v.n] = v.counts
            mass = np.concatenate([padded.sum(axis=1), v.tail_tokens])
            self.bc[:] = np.log((mass + 1) / (mass.sum() + v.classes))
            with np.errstate(divide="ignore"):
                self.bo[:] = np.where(padded > 0, np.log(np.maximum(padded, 1)), -30)
            self.wc[:] *= 0.1
            self.wo[:] *= 0.1

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """``x``: the tokens' input rows."""
        n = HIDDEN
        a = h @ self.u
        gates = 1 / (1 + np.exp(-(x[:, : 2 * n] + a[:, : 2 * n])))
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        return new + z * (h - new), (h, z, r, new, a[:, 2 * n :])

    def output(self, h: np.ndarray, codes: np.ndarray, grad: "Gru | None" = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(class) P(token in class) per row, without shares inside tail classes; with ``grad`` the
        gradients of its negated sum are added there and returned for h."""
        v = self.v
        rows = np.arange(len(codes))
        cls = np.where(codes < v.n, codes // CLASS, v.head_classes + codes - v.n)
        logits = h @ self.wc + self.bc
        logits -= logits.max(axis=1, keepdims=True)
        own = logits[rows, cls]
        e = np.exp(logits, out=logits)
        s = e.sum(axis=1)
        out = own - np.log(s)
        dh = None
        if grad is not None:
            e /= s[:, None]
            e[rows, cls] -= 1
            grad.wc += h.T @ e
            grad.bc += e.sum(axis=0)
            dh = e @ self.wc.T
        head = np.flatnonzero(codes < v.n)
        order = head[np.argsort(cls[head].astype(np.int16), kind="stable")]
        edges = np.searchsorted(cls[order], np.arange(v.head_classes + 1))
        for k in range(v.head_classes):
            part = order[edges[k] : edges[k + 1]]
            if not len(part):
                continue
            hk, own = h[part], codes[part] - k * CLASS
            logits = hk @ self.wo[k] + self.bo[k]
            logits -= logits.max(axis=1, keepdims=True)
            i = np.arange(len(part))
            at = logits[i, own]
            e = np.exp(logits, out=logits)
            s = e.sum(axis=1)
            out[part] += at - np.log(s)
            if grad is not None:
                e /= s[:, None]
                e[i, own] -= 1
                grad.wo[k] += hk.T @ e
                grad.bo[k] += e.sum(axis=0)
                dh[part] += e @ self.wo[k].T
        return out, dh

    def train(self, codes: np.ndarray, inputs: np.ndarray, starts: np.ndarray, memory: np.ndarray) -> None:
        """One pass over a stream of tokens, given by codes and input rows; ``starts`` marks the documents' first tokens,
        ``memory`` holds the optimizer's number of updates and moments (Adam)."""
        lanes = min(LANES, max(1, len(codes) // WINDOW))
        steps = len(codes) // lanes
        cut = lambda x: x[: lanes * steps].reshape(lanes, steps).T
        self._windows(cut(codes), cut(inputs), cut(starts), memory)
        if len(codes) > lanes * steps:  # fewer tokens than lanes
            self._windows(*(x[lanes * steps :][:, None] for x in (codes, inputs, starts)), memory)

    def gradient(self, codes: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple["Gru", np.ndarray, float]:
        """(gradients of the negated log-likelihood of a window of steps x lanes, the state after it, the likelihood)."""
        n = HIDDEN
        before, kept, tapes = [], [], []
        x = self.wx[inputs]
        for t in range(len(codes)):
            keep = ~fresh[t][:, None]
            h = state * keep
            before.append(h)
            kept.append(keep)
            state, tape = self.step(h, x[t])
            tapes.append(tape)
        grad = self.spare = getattr(self, "spare", None) or Gru(self.v, np.zeros_like(self.flat))
        grad.flat.fill(0)
        out, dh_out = self.output(np.concatenate(before), codes.reshape(-1), grad)
        dh_out = dh_out.reshape(len(codes), -1, n)
        carry = np.zeros_like(state)
        dx = np.empty((len(codes), state.shape[0], 3 * n), np.float32)
        da = np.empty_like(dx)
        for t in range(len(codes) - 1, -1, -1):
            h, z, r, new, an = tapes[t]
            dn = carry * (1 - z) * (1 - new * new)
            dx[t, :, :n] = carry * (h - new) * z * (1 - z)
            dx[t, :, n : 2 * n] = dn * an * r * (1 - r)
            dx[t, :, 2 * n :] = dn
            da[t, :, : 2 * n] = dx[t, :, : 2 * n]
            da[t, :, 2 * n :] = dn * r
            carry = (carry * z + da[t] @ self.u.T + dh_out[t]) * kept[t]
        grad.u += np.concatenate(before).T @ da.reshape(-1, 3 * n)
        flat = inputs.reshape(-1)
        order = np.argsort(flat.astype(np.int16), kind="stable")
        by_row = flat[order]
        head = np.flatnonzero(np.concatenate([[True], by_row[1:] != by_row[:-1]]))
        grad.wx[by_row[head]] = np.add.reduceat(dx.reshape(-1, 3 * n)[order], head, axis=0)
        return grad, state, float(out.sum())  # the gradients' arrays are used again by the next window

    def _windows(self, codes: np.ndarray, inputs: np.ndarray, begin: np.ndarray, memory: np.ndarray) -> None:
        state = np.zeros((codes.shape[1], HIDDEN), np.float32)
        for lo in range(0, len(codes), WINDOW):
            hi = lo + WINDOW
            grad, state, _ = self.gradient(codes[lo:hi], inputs[lo:hi], begin[lo:hi], state)
            g = grad.flat
            g *= np.float32(1 / codes[lo:hi].size)
            np.clip(g, -1, 1, out=g)
            memory[0] += 1
            first, second = memory[1 : 1 + len(g)], memory[1 + len(g) :]
            rate = RATE * math.sqrt(1 - 0.98 ** float(memory[0])) / (1 - 0.9 ** float(memory[0]))
            first *= np.float32(0.9)
            first += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.02)
            second *= np.float32(0.98)
            second += g
            np.sqrt(second, out=g)
            g += np.float32(1e-6)
            np.divide(first, g, out=g)
            g *= np.float32(rate)
            self.flat -= g

    def log10_tokens(self, streams: list[np.ndarray], codes_of: np.ndarray, inputs_of: np.ndarray) -> list[np.ndarray]:
        """For each document's tokens, numbers with codes and input rows, the model's log10, without tail shares."""
        out = [np.empty(len(s), np.float64) for s in streams]
        lanes: list[tuple[int, int, list[int]]] = [(0, i, []) for i in range(max(1, min(SCORE_LANES, len(streams))))]
        for i in sorted(range(len(streams)), key=lambda i: -len(streams[i])):
            n, k, own = heapq.heappop(lanes)
            own.append(i)
            heapq.heappush(lanes, (n + len(streams[i]), k, own))
        lanes.sort(key=lambda x: -x[0])
        long = max(lanes[0][0], 1)
        size = np.array([x[0] for x in lanes])
        # A lane's tokens and marks are laid out by time below; lanes are in order of length, so a step's active ones are first.
        joined = [np.concatenate([streams[i] for i in own]) if own else np.empty(0, np.int32) for _, _, own in lanes]
        begins = []
        for _, _, own in lanes:
            b = np.zeros(sum(len(streams[i]) for i in own), bool)
            if own:
                b[np.cumsum([0, *(len(streams[i]) for i in own[:-1])])] = True
            begins.append(b)
        values = [np.empty(len(j)) for j in joined]
        state = np.zeros((len(lanes), HIDDEN), np.float32)
        block = 64
        for lo in range(0, long, block):
            on = int(np.searchsorted(-size, -lo, side="left"))  # lanes longer than lo
            hi = min(lo + block, long)
            ids = np.zeros((hi - lo, on), np.int32)
            fresh = np.zeros((hi - lo, on), bool)
            live = np.zeros((hi - lo, on), bool)
            for k in range(on):
                part = joined[k][lo:hi]
                ids[: len(part), k], fresh[: len(part), k], live[: len(part), k] = part, begins[k][lo:hi], True
            before = np.empty((hi - lo, on, HIDDEN), np.float32)
            h, x = state[:on], self.wx[inputs_of[ids]]
            for t in range(hi - lo):
                h = h * ~fresh[t][:, None]
                before[t] = h
                h, _ = self.step(h, x[t])
            state = h
            got = np.empty((hi - lo, on))
            flat, codes = before[live], codes_of[ids[live]]
            got[live] = np.concatenate([self.output(flat[x : x + 2048], codes[x : x + 2048])[0] for x in range(0, len(codes), 2048)])
            for k in range(on):
                n = min(hi, len(joined[k])) - lo
                values[k][lo : lo + n] = got[:n, k]
        for (_, _, own), v in zip(lanes, values):
            at = 0
            for i in own:
                out[i][:] = v[at : at + len(streams[i])] / math.log(10)
                at += len(streams[i])
        return out


def held_out(key) -> F.Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


NUMBERED = "part int, keys binary, held binary, lengths binary, tokens binary, number int, word binary, n long"


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stored rows of two kinds: a part's documents, packed (keys, held, lengths, tokens: int32 numbers of the part's
    words); and a part's words (number, word, n), where n counts training tokens. Parts and their order depend on ids and
    texts only. Ids in keys are followed by a bit each, set where the id is null, if there is any such."""
    small_batches(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    n_bytes = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    parts = max(1, -(-int(n_bytes) // PART_BYTES))
    mark = F.xxhash64(F.col(key), body)
    rows = df.select(F.pmod(mark, F.lit(parts)).cast("int").alias("part"), F.col(key).cast("long").alias("key"), held_out(key).alias("held"), body.alias("text"), mark.alias("mark"))
    rows = rows.repartition(min(parts, 20_000), "part").sortWithinPartitions("part", "key", "mark").drop("mark")
    names = [x.split()[0] for x in NUMBERED.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.int32(), pa.binary(), pa.int64()]

    def run(batches):
        now: int | None = None
        numbers, counts = Numbers(), np.zeros(0, np.int64)
        keys: list[int | None] = []
        helds: list[bool] = []
        docs: list[np.ndarray] = []
        size = 0

        def packed():
            nonlocal keys, helds, docs, size, counts
            if keys:
                own = np.bincount(np.concatenate([np.empty(0, np.int32), *(x for x, h in zip(docs, helds) if not h)]), minlength=len(numbers))
                own[: len(counts)] += counts
                counts = own
                row = now, packed_keys(keys), np.array(helds, bool).tobytes(), np.array([len(x) for x in docs], np.int64).tobytes(), np.concatenate(docs).tobytes(), None, None, None
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)
            keys, helds, docs, size = [], [], [], 0

        def close():
            nonlocal numbers, counts
            yield from packed()
            if numbers:
                n = len(numbers)
                none = [pa.nulls(n, k) for k in kinds[1:5]]
                cols = [pa.array(np.full(n, now, np.int32)), *none, pa.array(np.arange(n, dtype=np.int32)), pa.array(list(numbers), pa.binary()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(cols, names)
            numbers, counts = Numbers(), np.zeros(0, np.int64)

        for batch in batches:
            for part, key, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    yield from close()
                    now = part
                own = words_of(text)
                own.append(END)
                docs.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                keys.append(key)
                helds.append(held)
                size += len(own)
                if size >= CHUNK_TOKENS:
                    yield from packed()
        yield from close()
        release()

    return stored(rows.mapInArrow(run, NUMBERED), "lm-numbered")


def packed_keys(keys: list[int | None]) -> bytes:
    none = np.array([k is None for k in keys])
    own = np.array([0 if k is None else k for k in keys], np.int64).tobytes()
    return own + np.packbits(none).tobytes() if none.any() else own


def keys_of(raw: bytes | memoryview, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which of them are null) of ``packed_keys``."""
    own, bits = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8)[8 * n :]
    return own, np.unpackbits(bits, count=n).astype(bool) if len(bits) else np.zeros(n, bool)


def _hash_of(word: Column, n: int) -> Column:
    return (F.crc32(word) % n).cast("int")


def counted(words: DataFrame) -> DataFrame:
    """Stored (part, number, c, tail, row, mark, word): a part's words with their corpus counts c, the hashes that stand for
    them, and, in one row of each word, the word. A word has at most a row a part, so no group is larger than that."""
    words = words.withColumn("mark", F.xxhash64("word"))
    every = Window.partitionBy("mark", "word")  # numbers are sorted faster than words; equal ones are told apart by the word
    rows = words.select("part", "number", "word", "mark", F.sum("n").over(every).alias("c"), (F.min("part").over(every) == F.col("part")).alias("one"))
    hashes = _hash_of(F.substring("word", -2, 2), TAIL).alias("tail"), _hash_of(F.col("word"), ROWS).alias("row")
    return stored(rows.select("part", "number", "c", *hashes, "mark", F.when(F.col("one"), F.col("word")).alias("word")), "lm-counted", "lz4")


def vocabulary_of(rows: DataFrame) -> Vocabulary:
    """From ``counted``: totals, the head, which is bounded by HEAD, and sums of the TAIL classes."""
    seen = rows.where("word is not null and c > 0")
    sums = seen.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    head = [(bytes(r["word"]), r["c"]) for r in seen.select("word", "c").orderBy(F.desc("c"), "word").limit(HEAD).collect()]
    tail = {r["tail"]: (r["c"], r["n"]) for r in sums}
    tokens, types = (sum(x[i] for x in tail.values()) for i in (0, 1))
    for w, c in head:
        k = tail_class(w)
        tail[k] = tail[k][0] - c, tail[k][1] - 1
    return Vocabulary(head, tail, tokens, types)


def coded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Stored (part, counts, codes, inputs): a row a part, arrays by its words' numbers."""
    v, spark = vocabulary, rows.sparkSession
    head = spark.createDataFrame([(bytearray(w), i) for w, i in v.ids.items()], "word binary, code int").select(F.xxhash64("word").alias("mark"), "code")

    def pack(table: pa.Table) -> pa.Table:
        release()
        order = np.argsort(table.column("number").to_numpy())
        cols = [table.column(c).to_numpy()[order].astype(k).tobytes() for c, k in (("c", np.int64), ("code", np.int32), ("input", np.int32))]
        return pa.table([table.column("part").slice(0, 1), *(pa.array([x], pa.binary()) for x in cols)], names=["part", "counts", "codes", "inputs"])

    own = rows.join(F.broadcast(head), "mark", "left").select("part", "number", "c", F.coalesce("code", F.lit(v.n) + F.col("tail")).alias("code"), F.coalesce("code", F.lit(v.n) + F.col("row")).alias("input"))
    return stored(own.groupBy("part").applyInArrow(pack, "part int, counts binary, codes binary, inputs binary"), "lm-coded")


def _documents(table: pa.Table):
    """((ids, which are null), held, starts, tokens) of each packed row, in order of the rows' first keys, so that any order of rows
    gives one result."""
    rows = []
    for keys, held, lengths, tokens in zip(*(buffers(table, c) for c in ("keys", "held", "lengths", "tokens"))):
        n = np.frombuffer(lengths, np.int64)
        rows.append((keys_of(keys, len(n)), np.frombuffer(held, bool), np.concatenate([[0], np.cumsum(n)]), np.frombuffer(tokens, np.int32)))
    end = lambda r, i: (not r[0][1][i], r[0][0][i])  # noqa: E731  null ids come first, as they were sorted
    return sorted(rows, key=lambda r: (end(r, 0), end(r, -1), zlib.crc32(r[3])))


def _add(tables: DataFrame) -> DataFrame:
    """Sums of up to FAN rows each."""

    def add(table: pa.Table) -> pa.Table:
        total, n, task = None, 0, None
        for k, raw, m in sorted(zip(table.column("task").to_pylist(), table.column("weights").to_pylist(), table.column("n").to_pylist())):
            x = np.frombuffer(raw, np.float64)
            total, n, task = x if total is None else total + x, n + m, k // FAN
        return pa.table({"task": pa.array([task], pa.int32()), "weights": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    return tables.groupBy(F.expr(f"task div {FAN}")).applyInArrow(add, "task int, weights binary, n long")


def trained(docs: DataFrame, codes: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The averaged weights after one pass over all training documents."""

    def learn(table: pa.Table, words: pa.Table) -> pa.Table:
        release()
        model = Gru(vocabulary)
        memory = np.zeros(1 + 2 * len(model.flat), np.float32)
        done = 0
        if table.num_rows:
            codes_of, inputs_of = (np.frombuffer(words.column(c)[0].as_buffer(), np.int32) for c in ("codes", "inputs"))
            for _, held, starts, tokens in _documents(table):
                begin = np.zeros(len(tokens), bool)
                begin[starts[:-1]] = True
                on = np.repeat(~held, np.diff(starts))
                own, begin = tokens[on], begin[on]
                if len(own):
                    model.train(codes_of[own], inputs_of[own], begin, memory)
                    done += len(own)
        rows = [words.column("part")[0].as_py()] if done else []
        return pa.table({"task": pa.array(rows, pa.int32()), "weights": pa.array([(model.flat.astype(np.float64) * done).tobytes() for _ in rows], pa.binary()), "n": pa.array([done for _ in rows], pa.int64())})

    tables = stored(docs.groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(learn, "task int, weights binary, n long"), "lm-weights")
    n = tables.agg(F.max("task")).first()[0]
    while n is not None and n > 0:
        tables, n = stored(_add(tables), "lm-weights"), n // FAN
    rows = tables.collect()  # one row at most
    return np.frombuffer(rows[0]["weights"], np.float64) / rows[0]["n"] if rows else Gru(vocabulary).flat.astype(np.float64)


SCORES = "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, codes: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    flat, v = weights.astype(np.float32), vocabulary

    def score(table: pa.Table, words: pa.Table) -> pa.Table:
        release()
        names = [x.split()[0] for x in SCORES.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        c = np.frombuffer(words.column("counts")[0].as_buffer(), np.int64)
        codes_of, inputs_of = (np.frombuffer(words.column(x)[0].as_buffer(), np.int32) for x in ("codes", "inputs"))
        base, inside, model = np.log10((c + 1) / (v.tokens + v.types + 1)), v.inside(codes_of, c), Gru(v, flat)
        out = []
        for keys, held, starts, tokens in _documents(table):
            got = np.concatenate(model.log10_tokens(np.split(tokens, starts[1:-1]), codes_of, inputs_of))
            of = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  each document has a token, its end
            out.append((pa.array(keys[0], mask=keys[1]), pa.array(held), np.diff(starts), of((c[tokens] > 0).astype(np.int64)), of(base[tokens]), of(got + inside[tokens])))
        return pa.concat_tables([pa.table([pa.array([], k) for k in kinds], names=names), *(pa.table([pa.array(x, k) if isinstance(x, np.ndarray) else x for x, k in zip(cols, kinds)], names=names) for cols in out)])

    return docs.groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(score, SCORES)


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score)"""
    rows = numbered(df, key, text)
    free_shuffles(df.sparkSession)
    docs = rows.where("number is null").select("part", "keys", "held", "lengths", "tokens")
    words = rows.where("number is not null").select("part", "number", "word", "n")
    counts = counted(words)
    free_shuffles(df.sparkSession)
    vocabulary = vocabulary_of(counts)
    codes = coded(counts, vocabulary)
    discard(counts)
    free_shuffles(df.sparkSession)
    weights = trained(docs, codes, vocabulary)
    free_shuffles(df.sparkSession)
    out = scored(docs, codes, vocabulary, weights)
    return out.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long")).withColumnRenamed("key", key)
