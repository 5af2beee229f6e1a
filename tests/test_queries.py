"""Queries against DuckDB on the smallest tables; a selection, the rest runs in the driver."""

import glob
import math
import os
import random

import pytest

from tests.conftest import SF
from weftline.plans import files, oracle, oracle_files, queries

NAMES = ["passage_search_topk", "hit_flags", "clean_text", "dict_tokens", "find_all", "doc_vectors", "pair_similarity_stats", "chunk_gate", "cosine_matrix", "across_report", "across_summary", "shared_seeds_vec", "window_vectors", "random_pair_stats"]
FILES = ["csv_rows", "alignment_phrases", "clean_files", "vec_file", "dictionary_tokens", "removed_words", "whole_phrases"]


def norm(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [*NAMES, *FILES])
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    made, sql = (files.queries(), oracle_files.oracle_sql()) if name in FILES else (queries.queries(), oracle.oracle_sql())
    df = made[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql[name]})").fetchall()
    assert norm(map(tuple, df.select(*cols).collect())) == norm(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_extend_match_tries_every_place(spark, tmp_path):
    """A document has two parts of an item, the second of them twice."""
    r = random.Random(3)
    w = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    one, two = w[:20], w[40:60]
    item = " ".join([*one, *w[100:130], *two])
    doc = " ".join([*w[200:240], *two, *w[240:280], *one, *w[280:320], *two, *w[320:360]])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, doc)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{SF}/embeddings.parquet", f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["extend_match"](spark, str(tmp_path)).collect()
    for a, b in ((0, 100), (50, 40), (50, 160)):
        assert any(r.start_a - r.start_b == a - b and r.start_a < a + 20 and r.start_a + r.length_a > a for r in got), (a, b, got)
    for k, r in enumerate(sorted(got, key=lambda r: (r.i, r.j))):
        earlier = sorted(got, key=lambda r: (r.i, r.j))[:k]
        assert not any(e.start_a - e.start_b == r.i - r.j and e.start_a <= r.i < e.start_a + e.length_a for e in earlier)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
