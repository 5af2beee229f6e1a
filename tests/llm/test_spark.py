"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns; and on none."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, common, jaccard, lm, media, mixing, quality, suffixes, warc, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, rep string, part int, bucket int, _copy int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    base, passage = words(120, 1), words(30, 2)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, None, "", " \n\t", base, " ".join(near), "one two", "One  TWO", "three", base.upper(), passage + " " + words(60, 3), words(60, 4) + "\n" + passage, words(5000, 5), "é" * 60 + passage, "x" * 3000,
        words(80, 6) + "\n" + "same line here\n" * 30, "🙂" * 20 + words(70, 7), words(90, 8),
    ]
    rows = [(i, t, ["en", None, "de"][i % 3], ["a", None, "b", "a"][i % 4], None, 9, "r", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[17], (None, base, "en", "a", 1, 9, "r", 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in corpus()]


def test_quality(docs, none):
    marked = quality.with_signals(docs)
    rows = quality.judged(marked, quality.limits(marked))
    got = {(r.doc_id, r.text): r for r in rows.collect()}
    for key, text in texts():
        r = got[key, text] if (key, text) in got else got[key, None]
        assert tuple(r._q_signals) == quality.signals_of(text)
        failed = r._q_signals[0] < 50 or 100 * r._q_signals[5] > 50 * r._q_signals[0]
        assert r._q_base_failed == failed and not (failed and r._q_kept)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 17").count() == 2
    assert quality.quality_filter(none).count() == 0


def test_sketch_quantiles_are_close(spark):
    values = sorted(random.Random(0).randint(0, 100_000) for _ in range(3000))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    s = df.selectExpr(f"{quality.bucket('v')} as bucket").groupBy("bucket").agg(F.count("*").alias("n")).withColumn("metric", F.lit("m"))
    q = quality.quantiles(s).first()
    for got, want in ((q.q25, values[749]), (q.q75, values[2249]), (q.q95, values[2849]), (q.q99, values[2969])):
        assert got <= want <= got * 33 / 32 + 1
    assert q.gap is None


def _limits(spark, metric, *groups):
    """(lo, hi) of a metric's rule over values, one list a group."""
    df = spark.createDataFrame([(i, v) for i, g in enumerate(groups) for v in g], "grp int, v long")
    s = df.selectExpr("grp", f"{quality.bucket('v')} as bucket").groupBy("grp", "bucket").agg(F.count("*").alias("n")).withColumn("metric", F.lit(metric))
    return [(r.lo, r.hi) for r in quality.fences(quality.quantiles(s, "grp"), 0).orderBy("grp").collect()]


def test_limits_follow_their_sketches(spark):
    zero = [0] * 900
    # an empty stretch below a tenth of all rows; the same with more of them; none; too many above it; nothing but zeros
    got = _limits(spark, "symbols", zero + [320] * 100, zero + [2048] * 200, list(range(64)) * 20, zero + [400] * 400, zero)
    assert [hi for _, hi in got] == [int((336 * 16) ** 0.5) - 16, int((2064 * 16) ** 0.5) - 16, 63 + quality.TAIL * (63 - 60), None, None]
    assert _limits(spark, "repeats", [0] * 940 + [10] * 40 + [40] * 20, zero) == [(None, 40 + quality.TAIL * 40 - quality.TAIL * 0 - quality.TAIL * 10), (None, None)]
    assert _limits(spark, "word_length", [40] * 300 + [50] * 400 + [60] * 300, [50] * 1000) == [(40 - quality.FENCE * 20, 60 + quality.FENCE * 20), (None, None)]


def test_quality_beside_clashing_names(spark):
    rows = [(i, words(60, i), "en", "a", "note", 1, 2) for i in range(5)] + [(9, "short", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _q_note string, _q_signals int, __Q_kept int")
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:5])


def test_near_duplicates(docs, none):
    sets, ids = [], []
    for key, text in texts():
        w = text.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
        ids.append(key)
    reach = {i: {i} for i in ids if i is not None}
    for _ in range(4):
        for i, a in zip(ids, sets):
            for j, b in zip(ids, sets):
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    reach[i] |= reach[j]
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(ids)
    size = dict(zip(ids, map(len, sets)))
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (size[r.doc_id], min(reach[r.doc_id]))
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in ids if i is not None and i == min(reach[i]))
    assert jaccard.near_duplicates(none).count() == 0


def test_near_copies_without_a_common_member(spark):
    """A chain: each links with its neighbours only."""
    base = words(100, 11).split()
    rows = []
    for i in range(12):
        own = list(base)
        for k in range(i):
            own[5 + 6 * k] = f"new{k}"
        rows.append((i, " ".join(own)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: r.component_id for r in got} == label


def test_copies_changed_apart_and_copies_of_these(spark):
    """A star of copies around one text, some too far from it; children that link with such a copy only; the text has the
    largest id. Labels against all pairs, and few pairs are looked at one by one."""
    r = random.Random(5)
    base = words(150, 12).split()

    def changed(own, n):
        own = list(own)
        for k in r.sample(range(len(own)), n):
            own[k] = "".join(r.choices("klmnop", k=6))
        return own

    copies = [changed(base, r.randint(1, 9)) for _ in range(70)]
    texts = [" ".join(c) for c in [*copies, *(changed(c, 1) for c in copies[:25]), base]]
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [jaccard.shingle_set(t) for t in texts]
    label = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.linked(sets[i], sets[j])]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert 5 < len(set(label)) < 60 and {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_near_copies_of_which_one_has_many_empty_partitions(spark):
    """5 and 6 shingles: in some pairs only one set has need 0, in some both, in some none."""
    rows, kinds = [], set()
    for i in range(200):
        long = words(10, 1000 + i)
        rows += [(2 * i, long.rsplit(" ", 1)[0]), (2 * i + 1, long)]
        a, b = (jaccard.shingle_set(t) for _, t in rows[-2:])
        for band in set(jaccard.bands_of(len(a))) & set(jaccard.bands_of(len(b))):
            kinds.add(tuple((jaccard.band_signatures([a, b], band)[2] > 0).tolist()))
    assert len(kinds) == 3  # never the longer one alone, which has all features of the other
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(400)}


def test_suffixes(docs, none):
    rows = texts()
    got = suffixes.removal_digests(docs).collect()
    assert len(got) == len(rows)
    have = {}
    for key, text in rows:
        raw = text.encode()
        for j in range(len(raw) - 49):
            if key is not None:
                have[raw[j : j + 50]] = min(have.get(raw[j : j + 50], 1 << 60), key)
    want = []
    for key, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 49):
            if key is not None and have[raw[j : j + 50]] < key:
                gone[j : j + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want.append((key, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows) and cut.where("doc_id = 1 and text is null").count() == 1
    assert suffixes.removal_digests(none).count() == 0


def test_windows_of_hot_anchors(docs, monkeypatch):
    want = sorted(map(tuple, suffixes.removal_digests(docs).collect()), key=repr)
    monkeypatch.setattr(suffixes, "HOT", 1)
    assert sorted(map(tuple, suffixes.removal_digests(docs).collect()), key=repr) == want


def test_long_texts_are_cut_into_slices(spark):
    shared = words(40, 21)
    rows = [(1, words(30_000, 22) + shared + words(30_000, 23)), (2, words(20_000, 24) + shared + words(25_000, 25))]
    got = {r.doc_id: r for r in suffixes.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_spans == 1 and got[2].n_removed >= len(shared)


def test_language_model(docs, none):
    rows = texts()
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    import collections
    import math

    tokens = [(k, t.encode().lower().split() + [b""]) for k, t in rows]
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    c = collections.Counter(w for k, ws in tokens if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    want = {k: (held(k), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in tokens}
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and r.score < 0
    assert lm.score_documents(none).count() == 0


def test_language_model_scores_are_those_of_a_plain_forward_pass(spark, monkeypatch):
    """The query's own weights, word by word in float64; and the same scores whatever the splits."""
    import math

    rows = [(i, words(30 + 5 * i, 300 + i) + " the end") for i in range(12)] + [(12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    plain = lm.scored
    monkeypatch.setattr(lm, "scored", lambda docs, codes, v, w: seen.update(v=v, w=w) or plain(docs, codes, v, w))
    monkeypatch.setattr(lm, "HEAD", 40)
    monkeypatch.setattr(lm, "PART_BYTES", 1000)
    got = {r.doc_id: r.score for r in lm.score_documents(df).collect()}
    again = {r.doc_id: r.score for r in lm.score_documents(df.repartition(5)).collect()}
    assert all(math.isclose(got[k], again[k], rel_tol=1e-9) for k in got)
    v, m = seen["v"], lm.Gru(seen["v"], seen["w"])
    counts = {}
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in (t or "").encode().split() + [b""]:
                counts[w] = counts.get(w, 0) + 1
    assert v.tokens == sum(counts.values()) and v.n == 40
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    n = lm.HIDDEN
    for k, t in rows:
        h, total = np.zeros(n), 0.0
        for w in (t or "").encode().split() + [b""]:
            p = soft(h @ m.wc.astype(float) + m.bc)
            if w in v.ids:
                c, i = divmod(v.ids[w], lm.CLASS)
                total += math.log10(p[c] * soft(h @ m.wo[c].astype(float) + m.bo[c])[i])
                x = m.wx[v.ids[w]]
            else:
                c = lm.tail_class(w)
                own = [a for a in counts if a not in v.ids and lm.tail_class(a) == c]
                total += math.log10(p[v.head_classes + c] * (counts.get(w, 0) + 1) / (sum(counts[a] for a in own) + len(own) + 1))
                x = m.wx[v.n + lm.tail_row(w)]
            a = h @ m.u.astype(float)
            z, r = 1 / (1 + np.exp(-(x[:n] + a[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + a[n : 2 * n])))
            h = (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :]) + z * h
        assert math.isclose(got[k], total, rel_tol=1e-4), k


def test_repeated_ids_with_different_texts(spark):
    """One id on two texts, ids that are null, and columns with the names that joins could have used."""
    a, b = words(60, 51), words(40, 52)
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (None, a), (None, b), (None, words(50, 53)), (9, None), (9, ""), (11, words(45, 54)), (11, words(45, 55)), (11, words(45, 54))]
    schema = "doc_id long, text string, spans int, _spans int, _key long, key long, digest string, _digest string, _gone int, _src int, _rate int, source string, node int, rep int, n int"
    df = spark.createDataFrame([(k, t, 1, 2, 3, 4, "x", "y", 5, 6, 7, "s", 8, 9, 10) for k, t in rows], schema)
    got = jaccard.near_duplicates(df).collect()
    sets = [jaccard.shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if jaccard.linked(x, y):
                    label[i] = label[j] = min(label[i], label[j])
    ids = lambda i: [k for (k, _), own in zip(rows, label) if own == label[i] and k is not None]
    want = [(k, len(s), (min(ids(i)) if ids(i) else None) if len(s) else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    kept = jaccard.one_per_group(df)
    assert kept.columns == df.columns
    have = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert have == sorted([(3, a), (5, b), (None, words(50, 53)), (9, None), (9, ""), *[(11, words(45, 54))] * 2, (11, words(45, 55))], key=repr)

    p, y = words(30, 61), words(40, 62)
    rows = [(3, p), (5, p + " " + words(5, 63)), (5, y), (6, y[:90]), (5, p), (None, p), (2, words(20, 64))]
    df = spark.createDataFrame([(k, t, 1, 2, 3, 4, "x", "y", 5, 6, 7, "s", 8, 9, 10) for k, t in rows], schema)
    cut = suffixes.without_repeats(df)
    assert cut.columns == df.columns
    want = [(3, p), (5, (p + " " + words(5, 63))[len(p) :]), (5, y), (6, ""), (5, ""), (None, p), (2, words(20, 64))]
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == sorted(want, key=repr)
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "_copies", "_copy", "_order"]
    assert bpe.with_ids(df, __import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN).count() == 7


def test_wavelet_shards(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    special = [(100, "before <|endoftext|> after!", "en", "a", 1, 9, "r", 1, 2, 3), (101, "!<|endoftext|>", "en", "a", 1, 9, "r", 1, 2, 3)]
    rows = sorted([*texts(), *((r[0], r[1]) for r in special)], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    docs = docs.unionByName(docs.sparkSession.createDataFrame(special, SCHEMA))
    manifest = wavelet.write_shards(docs, path, common.shared_folder(docs.sparkSession, "t"), shard_tokens=1000)
    assert manifest.count() >= 3
    got = sorted(map(tuple, wavelet.read_documents(manifest).collect()), key=lambda r: r[1])
    start, want = 0, []
    for key, text in rows:
        ids = own.encode(text, add_special_tokens=False).ids + [0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids.count(0)))
        start += len(ids)
    assert got == want
    assert wavelet.read_documents(wavelet.encode_corpus(none, path)).count() == 0


def test_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Ranks(path).ids, special_tokens={})
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.id_digests(docs, path, P.PATTERN).collect()), key=repr)
    want = []
    for key, text in texts():
        ids = lib.encode_ordinary(text)
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    both = bpe.decoded(bpe.with_ids(docs, path, P.PATTERN), path, P.PATTERN)
    assert both.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert bpe.with_ids(none, path, P.PATTERN).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs, {"a": 1.0, "b": 1.0, "gone": 5.0}, total=3.0)
    rows = out.collect()
    assert all(r.source in ("a", "b") for r in rows) and out.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "_copy"]
    counts = {}
    for r in rows:
        counts.setdefault((r.doc_id, r.text), []).append((r._copy, r._copies))
    for (key, _), seen in counts.items():
        times = 2 if key == 17 else 1
        assert sorted(c for c, _ in seen) == sorted(list(range(1, seen[0][1] + 1)) * times)
    again = mixing.mix(docs.repartition(7), {"a": 1.0, "b": 1.0, "gone": 5.0}, total=3.0).collect()
    key = lambda r: (str(r.doc_id), r._copy, r._copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0


def test_poisson_counts_have_the_mean(spark):
    df = spark.range(20_000).withColumn("rate", F.when(F.col("id") % 2 == 0, 0.3).otherwise(4.0))
    got = df.withColumn("n", mixing.poisson_count(mixing.hashed(5, F.col("id")) / mixing.SPAN, F.col("rate"))).groupBy("rate").agg(F.avg("n").alias("m"), F.var_pop("n").alias("v")).collect()
    for r in got:
        assert abs(r.m - r.rate) < 0.05 * r.rate + 0.01 and abs(r.v - r.rate) < 0.1 * r.rate


def test_small_sources_reach_their_share(spark):
    """A source of 1/101 of the characters needs rate 50.5, above one inversion's 16."""
    df = spark.range(40_400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 101 == 0, "small").otherwise("large").alias("source"), F.lit("x").alias("text"))
    rates = mixing.source_rates(df)
    assert {r.src: round(r.rate, 6) for r in rates.collect()} == {"small": 50.5, "large": 0.505}
    small = mixing.replicate(df, rates, 7).where("source = 'small'").groupBy("doc_id").agg(F.max("_copies").alias("n"), F.count("*").alias("rows"))
    r = small.agg(F.avg("n").alias("m"), F.var_pop("n").alias("v"), F.max(F.abs(F.col("n") - F.col("rows"))).alias("off")).first()
    assert abs(r.m - 50.5) < 1.5 and abs(r.v - 50.5) < 15 and r.off == 0
    assert mixing.source_rates(df, max_rate=16).agg(F.max("rate")).first()[0] == 16


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (5, None, "same"), (3, "http://c", None), (4, "u\nv", ""), (6, "http://d", "x" * 700_000), (7, "http://e", "é"), (7, "http://e", "é"), (None, "http://n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(warc.roles(pages), common.shared_folder(spark, "w"), frame_bytes=1000, bundle_bytes=600)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect())
    assert got == [(0, 5, "response", None), (1, 4, "revisit", 5), (2, 4, "revisit", 5), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 4, "response", None), (6, 700_000, "response", None), (7, 2, "response", None), (7, 2, "response", None)]
    for r in index.where("page_id in (5, 6)").collect():
        head, block = warc.read_record(r.bundle, r.frame, r.record_at)
        assert warc.page_of(head["WARC-Record-ID"]) == r.page_id and block.endswith(b"same" if r.page_id == 5 else b"x")
    long = warc.read_bundles(warc.archive(pages, min_bytes=5)).collect()
    assert {r.record_type for r in long} == {"response"}
    assert warc.read_bundles(warc.archive(pages.limit(0))).count() == 0
    urls = [None, "", "urn:none", "http://a/b c%0Dd", "http://a\r\nInjected: yes", "\n", " x ", "http://ü/é"]
    odd = spark.createDataFrame([(i, u, "x", 7, "d", "f") for i, u in enumerate(urls)], "page_id long, url string, html string, _refers_to int, digest string, first string")
    got = warc.read_bundles(warc.archive(odd)).collect()
    assert {r.page_id: r.url for r in got} == dict(enumerate(urls)) and {r.refers_to for r in got} == {None, 7}


def test_media(docs, none):
    held = common.stored(media.texts_to_media(docs), "m")
    rows = media.image_features(held, common.shared_folder(docs.sparkSession, "tiles")).collect()
    want = {}
    for key, text in texts():
        n, payload = media.payload_of(text)
        want[key] = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media.encode_pgm(payload)).hexdigest())
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == want[r.key]
    feats = common.stored(media.image_features(held, common.shared_folder(docs.sparkSession, "tiles")), "f")
    assert feats.count() == feats.drop("tile_sha256").join(media.read_tiles(feats), ["tile_file", "tile_row"]).count() == feats.join(media.read_tiles(feats), ["tile_file", "tile_row", "tile_sha256"]).count()
    one = rows[0]
    with common.open_file(one.tile_file) as f:
        tiles = np.load(__import__("io").BytesIO(f.read()))
    assert hashlib.sha256(media.tile_bytes(tiles[one.tile_row])).hexdigest() == one.tile_sha256
    bad = docs.sparkSession.createDataFrame([(1, 0, None), (2, 3, bytearray(b"GIF"))], "key long, n_bytes long, media binary")
    assert [r.feature for r in media.image_features(bad).collect()] == [None, None]
    assert media.image_features(media.texts_to_media(none)).count() == 0


def test_trees(spark):
    #      1 -> 2 -> 4
    #        -> 3        5 is a root whose parent is missing; 8 and 9 are a cycle
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "low", 0.0), (1, 3, 1, "assistant", "high", 9.0), (1, 4, 2, "user", "x", 0.0), (2, 5, 77, "user", "<|im_end|>\\n\\", 1.0), (3, 8, 9, "a", "b", 0.0), (3, 9, 8, "a", "b", 0.0), (3, 10, 8, "a", "hangs on the cycle", 0.0), (3, 11, None, "a", "alone", 0.0), (3, 12, 10, "a", "b", 0.0)]
    nodes = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    got = chat.format_trees(nodes, keep=2).orderBy("conv", "branch").select("conv", "leaf", "branch", "n_turns", chat.parse(F.col("formatted")).alias("t"), chat.loss_spans(F.col("formatted")).alias("s"), "formatted").collect()
    assert [(r.conv, r.leaf, r.branch, r.n_turns) for r in got] == [(1, 3, 1, 2), (1, 4, 2, 3), (2, 5, 1, 1), (3, 11, 1, 1)]
    assert [tuple(x) for x in got[2].t] == [("user", "<|im_end|>\\n\\")]
    assert [got[0].formatted[s.begin : s.begin + s.length] for s in got[0].s] == ["high"]


def test_turns(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "us\ner", None), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, 1, None, "<|x|>\\"), (2, None, "user", "")] + [(9, i, "user", str(i)) for i in range(40)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat.format_trees(chat.chain_of_turns(talks)).select("conv", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(chat.parse(F.col("formatted"))).alias("loss")).collect()}
    assert [tuple(x) for x in got[1].t] == [("us\ner", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")] and got[1].loss == "aab"
    assert [tuple(x) for x in got[None].t] == [("", "<|x|>\\")] and got[2].loss == ""
    assert [x.text for x in got[9].t] == [str(i) for i in range(40)]
    assert chat.format_trees(chat.chain_of_turns(talks.limit(0))).count() == 0
