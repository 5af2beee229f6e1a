"""What runs without Spark, against brute force."""

import collections
import io
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import jaccard, lm, media, quality, suffixes, warc, wavelet


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", " "]), max_size=40))
def test_signals(parts):
    text = "".join(parts)
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in collections.Counter(grams).items() if n > 1}
    covered = {i + o for i, g in enumerate(grams) if g in twice for o in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \n")]
    got = quality.signals_of(text)
    assert got == (len(words), sum(map(len, words)), 0, len(lines), len(lines) - len(set(lines)), len(covered))


def test_signals_of_nothing():
    assert quality.signals_of(None) == quality.signals_of("") == (0,) * 6
    assert quality.signals_of("a#b %\x0b|c")[:3] == (3, 6, 3)


@pytest.mark.parametrize("n,m", [(0, 5), (1, 1), (700, 7), (300_000, 50_257), (3000, 70_000)])
def test_wavelet(n, m):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, m, n).astype(np.uint32)
    f = wavelet.WaveletFile(io.BytesIO(wavelet.build(ids, np.arange(2), np.array([n // 2, n]))))
    assert (f.decode() == ids).all()
    for i in rng.integers(0, max(n, 1), 5 if n else 0).tolist():
        s = int(ids[i])
        assert f.access(i) == s and f.count(s) == (ids == s).sum() and f.rank(s, i) == (ids[:i] == s).sum()
        assert f.select(s, f.rank(s, i)) == i
    places = np.sort(rng.integers(0, n + 1, 40))
    for s in {0, *ids[:3].tolist()}:
        before = np.concatenate([[0], np.cumsum(ids == s)])
        assert (f.ranks(s, places) == before[places]).all()
    assert f.count(m + 5) == 0
    with pytest.raises(IndexError):
        f.access(n)


def brute_links(sets):
    out = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                out.add((j, i))
    return out


@pytest.mark.parametrize("size", [1, 3, 4, 5, 7, 9, 12, 20, 27, 33, 60, 150, 400])
def test_partenum_loses_no_link(size):
    """Linked sets share as many signatures as each of them needs, or one of the prefix filter's."""
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = set(rng.integers(0, 1 << 63, size).tolist())
        b = set(a)
        for x in rng.permutation(sorted(a))[: int(rng.integers(0, size // 5 + 1))].tolist():
            b.discard(x)
            if rng.random() < 0.5:
                b.add(int(rng.integers(0, 1 << 63)))
        for _ in range(int(rng.integers(0, size // 6 + 1))):
            b.add(int(rng.integers(0, 1 << 63)))
        if not brute_links([a, b]) or a == b:
            continue
        sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
        ok = False
        for band in set(jaccard.bands_of(len(a))) & set(jaccard.bands_of(len(b))):
            who, own, need = jaccard.band_signatures(sets, band)
            common = len(set(own[who == 0].tolist()) & set(own[who == 1].tolist()))
            if min(need) > 0 and band == jaccard.band_of(min(len(a), len(b))):
                assert common >= max(need)
            ok |= 0 < max(need) <= common
            if (need == 0).all():
                p = [set(jaccard.prefix_signatures(s, band).tolist()) for s in sets]
                ok |= bool(p[0] & p[1])
        assert ok


def test_five_bytes_keep_links():
    s = jaccard.shingle_set(" ".join(str(i) for i in range(200)))
    assert len(s) == 196 and jaccard.linked(s, s)
    assert not jaccard.linked(np.empty(0, np.uint64), np.empty(0, np.uint64))
    assert len(jaccard.shingle_set("A b\tc")) == 1 and (jaccard.shingle_set("A b") == jaccard.shingle_set("a  B")).all()


@pytest.mark.parametrize("chunk", [10**6, 40])
def test_columns_against_sorting(chunk, tmp_path):
    random.seed(chunk)
    folder = f"file://{tmp_path}/rows"
    for _ in range(8):
        alphabet = random.choice([b"ab", b"a", b"abcd"])
        strings = [bytes(random.choice(alphabet) for _ in range(random.randint(1, 14))) for _ in range(random.randint(1, 12))]
        rows, total = suffixes.transform(strings, folder, chunk)
        common = np.concatenate([c for _, c in rows])
        name = np.zeros(len(common), int)
        for t, who, at in suffixes.suffix_places(rows, total, np.array([len(s) for s in strings])):
            name[at] = who * 256 + t
        got = [strings[n >> 8][len(strings[n >> 8]) - (n & 255) :] for n in name.tolist()]
        assert got == sorted(s[len(s) - t :] for s in strings for t in range(len(s) + 1))
        for a, b, c in zip(got, got[1:], common[1:].tolist()):
            assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        rows.drop()
        small = np.array([random.randint(0, 9) for _ in strings])
        least = collections.defaultdict(lambda: 99)
        for s, k in zip(strings, small.tolist()):
            for j in range(len(s) - 2):
                least[s[j : j + 3]] = min(least[s[j : j + 3]], k)
        assert suffixes.repeated(strings, small, 3, folder, chunk).tolist() == [least[s[j : j + 3]] for s in strings for j in range(len(s) - 2)]


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n).tolist()) for n in (0, 49, 50, 51, 500, 3)]
    lengths = np.array([len(t) for t in texts])
    owner, first, windows, place, _ = suffixes.anchors(b"".join(texts), np.cumsum(lengths) - lengths, lengths)
    assert collections.Counter(np.repeat(owner, windows).tolist()) == {2: 1, 3: 2, 4: 451}
    assert ((place >= first + windows - 1) & (place <= first + suffixes.WIDTH - suffixes.K)).all()


def test_a_bucket_of_the_intended_size_uses_files(tmp_path, monkeypatch):
    """A quarter of a bucket already: two documents have the same segments, in two blocks; chunks are files, and all go again."""
    import os

    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, size = suffixes.SEGMENT_BUCKET // 4, 79
    raw = rng.integers(97, 123, (n, size)).astype(np.uint8)
    segments = [bytes(x) + bytes([25]) for x in raw]
    which = np.arange(n, dtype=np.int32).tobytes()
    rows = [(b"".join(segments), np.full(n, size + 1, np.uint8).tobytes(), which, np.full(n, k, np.int64).tobytes(), np.full(n, k, np.int64).tobytes(), (np.arange(n) * 100).astype(np.int64).tobytes()) for k in (3, 8)]
    table = pa.table([pa.array(x, pa.binary()) for x in zip(*rows)], names=suffixes.SEGMENTS)
    written = []
    append = suffixes.Rows.append
    monkeypatch.setattr(suffixes.Rows, "append", lambda self, *x: append(self, *x) or written.append(isinstance(self.parts[-1][0], str)))
    got = suffixes.bucket_spans(table, f"file://{tmp_path}")
    assert sum(written) > 100
    assert got.column("key").to_pylist() == [8] * n and sorted(got.column("begin").to_pylist()) == [100 * i for i in range(n)]
    assert all(b - a == size for a, b in zip(got.column("begin").to_pylist(), got.column("stop").to_pylist()))
    assert not [f for _, _, names in os.walk(tmp_path) for f in names]


def small_vocabulary():
    return lm.Vocabulary([(str(i).encode(), 100 - i) for i in range(70)], {0: (40, 20), 5: (300, 110)}, 4955, 200)


def test_gru_lanes():
    rng = np.random.default_rng(0)
    v = small_vocabulary()
    m = lm.Gru(v)
    codes, inputs = np.arange(70 + lm.TAIL), np.concatenate([np.arange(70), 70 + np.arange(lm.TAIL) * 7])
    streams = [rng.integers(0, len(codes), n) for n in (5, 1, 200, 33)]
    lanes, alone = m.log10_tokens(streams, codes, inputs), [m.log10_tokens([s], codes, inputs)[0] for s in streams]
    assert max(np.abs(a - b).max() for a, b in zip(lanes, alone)) < 1e-5
    h = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every, _ = m.output(np.repeat(h, len(codes), axis=0), codes)
    assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-4)  # a tail class as a whole is one outcome
    # inside a tail class, seen words and one unseen share all
    share = v.inside(np.full(3, 75), np.array([0, 150, 148]))
    assert np.allclose(10**share, np.array([1, 151, 149]) / 411)
    once = [np.arange(70)] * 20
    before = sum(x.sum() for x in m.log10_tokens(once, codes, inputs))
    memory = np.zeros(1 + 2 * len(m.flat), np.float32)
    starts = np.zeros(1400, bool)
    starts[::70] = True
    for _ in range(10):
        m.train(np.tile(np.arange(70), 20), np.tile(np.arange(70), 20), starts, memory)
    assert sum(x.sum() for x in m.log10_tokens(once, codes, inputs)) > before


def test_gru_gradient():
    """Against central differences, with a document that begins inside the window and a state that is carried in."""
    rng = np.random.default_rng(1)
    m = lm.Gru(small_vocabulary())
    m.flat[:] = rng.normal(0, 0.3, len(m.flat))
    codes, inputs = rng.integers(0, 70 + lm.TAIL, (4, 3)), rng.integers(0, 90, (4, 3))
    fresh = np.zeros((4, 3), bool)
    fresh[2, 1] = True
    state = rng.normal(0, 0.5, (3, lm.HIDDEN)).astype(np.float32)
    grad = m.gradient(codes, inputs, fresh, state)[0].flat.copy()
    at = 0
    for name, shape in m.shapes.items():
        own = grad[at : at + math.prod(shape)]
        for i in np.argsort(-np.abs(own))[:4]:
            k, held, step = at + int(i), float(m.flat[at + i]), 1e-2
            sides = []
            for d in (step, -step):
                m.flat[k] = held + d
                sides.append(m.gradient(codes, inputs, fresh, state)[2])
            m.flat[k] = held
            assert math.isclose(-(sides[0] - sides[1]) / (2 * step), grad[k], rel_tol=0.02, abs_tol=0.01), name
        at += math.prod(shape)


@pytest.mark.parametrize("rows,cols", [(5, 7), (8, 9), (32, 32), (13, 64), (1, 64), (9000, 64)])
def test_areas_against_plain_means(rows, cols):
    """Fractional areas, by the overlap of each sample with each cell."""
    rng = np.random.default_rng(rows)
    gray = rng.integers(0, 256, (rows, cols)).astype(np.uint8)

    def shares(n, parts):
        edges = np.arange(parts + 1) * n / parts
        low, high = np.maximum(np.arange(n), edges[:-1, None]), np.minimum(np.arange(n) + 1, edges[1:, None])
        return np.maximum(high - low, 0)

    for h, w in ((8, 9), (3, 2), (32, 32)):
        want = shares(rows, h) @ gray.astype(float) @ shares(cols, w).T / (rows / h * cols / w)
        assert np.allclose(media.area_resize(gray, h, w), want)
    small = np.round(shares(rows, 8) @ gray.astype(float) @ shares(cols, 9).T / (rows / 8 * cols / 9), 6)
    bits = "".join("1" if b > a else "0" for r in small for a, b in zip(r, r[1:]))
    assert media.difference_hash(gray) == f"{int(bits, 2):016x}"


def test_images():
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (7, 9)).astype(np.uint8)
    assert (media.decode_image(media.encode_bmp(gray)) == gray).all()
    assert (media.decode_image(media.encode_pgm(gray.tobytes(), 9)) == gray).all()
    assert media.decode_image(b"P1\n# c\n2 2\n1 0\n0 1\n").tolist() == [[0, 1], [1, 0]]
    assert media.decode_image(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode_image(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 1, 0]]
    assert media.decode_image(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert np.allclose(media.area_resize(gray.astype(float), 7, 9), gray)
    assert np.allclose(media.area_resize(np.kron(gray, np.ones((3, 2))), 7, 9), gray)
    assert math.isclose(media.area_resize(gray.astype(float), 1, 1)[0, 0], gray.mean())
    for bad in (b"", b"P5", b"GIF89a", b"P5\n9 9\n255\nxx", b"BM" + bytes(60)):
        with pytest.raises((ValueError, IndexError)):
            media.decode_image(bad)
    assert media.payload_of(None) == (0, bytes(64)) and len(media.payload_of("x" * 65)[1]) == 128


def test_records_and_seek_table():
    for page, url, body, to in ((3, "http://a", b"x" * 10, None), (-1, None, b"", None), (None, "u\r\nv", b"q", 7)):
        raw = warc.build_record(page, url, body, to)
        head, block, end = warc.parse_record(b"zz" + raw, 2)
        assert end == len(raw) + 2 and head["WARC-Type"] == ("response" if to is None else "revisit")
        if page is not None:
            assert warc.page_of(head["WARC-Record-ID"]) == page
        assert to is None or warc.page_of(head["WARC-Refers-To"]) == to

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    f = File(b"abc" + warc.seek_table([(1, 10), (2, 20)]))
    assert warc.read_seek_table(f) == [(0, 1, 10), (1, 2, 20)]


def test_crc_is_of_little_endian_words():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
