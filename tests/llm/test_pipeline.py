"""The five stages on a small table, against a plain version of each."""

import hashlib
import math
import random

import corpus_pipeline
from weftline.llm import bpe, mixing


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def poisson(key, rate, seed=2011):
    digest = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:13], 16)
    u, k, p = digest(seed, key) / mixing.SPAN, 0, math.exp(-rate)
    cdf = p
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_stages(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    passage = words(60, 1)
    near = words(100, 2).split()
    near[50] = "changed"
    texts = [words(100, 2), " ".join(near), words(100, 2), words(80, 3) + " " + passage, passage + " " + words(90, 4), "too short", None, "again and again " * 40] + [words(70, 10 + i) for i in range(8)]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert i == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append(docs.collect())

    kept = [r for r in rows if r[0] not in (5, 6, 7)]  # short, null, repeating
    assert sorted(r.doc_id for r in seen[0]) == [r[0] for r in kept]
    kept = [r for r in kept if r[0] not in (1, 2)]  # near and exact copies of 0
    assert sorted(r.doc_id for r in seen[1]) == [r[0] for r in kept]
    cut, met = {}, set()
    for key, text, *_ in kept:
        gone = set()
        for j in range(len(text) - 49):
            if text[j : j + 50] in met:
                gone.update(range(j, j + 50))
        met |= {text[j : j + 50] for j in range(len(text) - 49)}
        cut[key] = "".join(c for j, c in enumerate(text) if j not in gone)
    assert {r.doc_id: r.text for r in seen[2]} == cut and all(r.n_chars == len(r.text) for r in seen[2])
    assert len(cut[4]) < len(texts[4]) - 200
    source = {r[0]: r[3] for r in rows}
    chars = {s: sum(len(t) for k, t in cut.items() if source[k] == s) for s in "ab"}
    want = sorted(k for k in cut for _ in range(poisson(k, sum(chars.values()) / 2 / chars[source[k]])))
    assert sorted(r.doc_id for r in seen[3]) == want
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Ranks(P.path("byte_bpe_multi_50k.tiktoken")).ids, special_tokens={})
    assert sorted(r.doc_id for r in seen[4]) == want
    assert all(r.round_trip and list(r.ids) == lib.encode_ordinary(cut[r.doc_id]) and r.n_tokens == len(r.ids) for r in seen[4])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_with_odd_rows_and_none(spark, tmp_path):
    """Null ids, texts, languages and sources, one id on two texts, rows twice, a long text; then an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, words(80, 41), "en", "a", 1), (1, words(80, 42), None, None, None), (None, words(80, 43), "en", None, 2), (None, None, None, None, None), (2, words(80, 44), "de", "b", 3), (2, words(80, 44), "de", "b", 3), (3, words(30_000, 45), None, "b", 4), (4, "", "", "", 0), (5, words(80, 41), "en", "a", 5)]
    for name, table in (("some", rows), ("none", [])):
        spark.createDataFrame(table, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        seen = []
        for i, (step, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path / name)).write.parquet(str(tmp_path / name / step))
            docs = spark.read.parquet(str(tmp_path / name / step))
            assert i == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
            seen.append(docs.collect())
        if not table:
            assert not any(seen)
            continue
        kept = [r for r in rows if r[1]]
        key = lambda r: (str(r[0]), r[1])
        assert sorted(map(key, seen[0])) == sorted(map(key, kept))
        assert sorted(map(key, seen[1])) == sorted(key(r) for r in kept if r[0] != 5) == sorted(map(key, seen[2]))
        assert {r.doc_id for r in seen[3]} <= {r[0] for r in kept} and len(seen[3]) == len(seen[4]) and all(r.round_trip for r in seen[4])
