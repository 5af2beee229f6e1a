"""Ids at both ends of their range beside null ones."""

from weftline.llm import common, lm, wavelet

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def rows(spark):
    return spark.createDataFrame([(LEAST, "one two"), (MOST, "three"), (None, "four five six"), (None, None), (0, "seven")], "doc_id long, text string")


def test_wavelet_keeps_ids_apart_from_null(spark):
    import public_tokenizers

    manifest = wavelet.write_shards(rows(spark), public_tokenizers.path("byte_bpe_50k.json"), common.shared_folder(spark, "t"))
    got = [r.doc_id for r in wavelet.read_documents(manifest).orderBy("start").collect()]
    assert got == [None, None, LEAST, 0, MOST]


def test_language_model_keeps_ids_apart_from_null(spark):
    got = {(r.doc_id, r.n_tokens) for r in lm.score_documents(rows(spark)).collect()}
    assert got == {(LEAST, 3), (MOST, 2), (None, 4), (None, 1), (0, 2)}
    packed = lm.packed_keys([LEAST, None, 0])
    assert [None if n else int(k) for k, n in zip(*lm.keys_of(packed, 3))] == [LEAST, None, 0]
    assert not lm.keys_of(lm.packed_keys([1, 2]), 2)[1].any()
