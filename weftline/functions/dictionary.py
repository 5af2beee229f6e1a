"""Dictionaries of any origin and millions of terms: tables that the workers read, not lists in a closure.

A dictionary is stored once. Each Python worker reads it once and holds it as sorted bytes, some ten bytes a term beyond its own.
The longest term at a place is found by bisection: the last term not above the text there is it, or shares a prefix with the
text that holds it; so the search goes on with that prefix. Places are cut as by one pattern of all terms, longest first.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.tokenize import BRACKETS
from weftline.sources.shared import stored

#: Bytes of terms that every Python worker may hold.
MOST_BYTES = 512 << 20


def dictionary_of(terms: DataFrame, column: str = "term") -> DataFrame:
    """Stored (term): distinct terms without brackets and blanks."""
    rows = terms.select(F.translate(column, BRACKETS, "").alias("term")).where("term <> ''").distinct()
    out = stored(rows, "dictionary")
    size = out.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a dictionary of {size} bytes is more than a worker may hold")
    return out


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A term list, one a line."""
    return dictionary_of(spark.read.text(path), "value")


class Terms:
    """Sorted terms as bytes."""

    def __init__(self, terms: pa.Array):
        terms = pc.cast(terms, pa.large_binary())
        terms = terms.take(pc.sort_indices(terms))
        _, offsets, data = terms.buffers()
        self.ends = np.frombuffer(offsets, np.int64)[: len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
        self.data = memoryview(data) if data is not None else memoryview(b"")
        self.longest = int(np.diff(self.ends).max(initial=0))
        self.first: dict[bytes, tuple[int, int]] = {}  # the terms that begin with two bytes, or are one
        if len(terms):
            two = np.array([bytes(self.data[a : min(a + 2, b)]) for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist())], object)
            cuts = [0, *(np.flatnonzero(two[1:] != two[:-1]) + 1).tolist(), len(two)]
            self.first = {two[a]: (a, b) for a, b in zip(cuts, cuts[1:])}

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> bytes:
        return bytes(self.data[self.ends[i] : self.ends[i + 1]])

    def at(self, text: bytes, place: int) -> int:
        """The length of the longest term that begins at a place of a text; 0 if there is none."""
        s = text[place : place + self.longest]
        lo, hi = self.first.get(s[:2], (0, 0))
        while lo < hi:
            i = bisect_right(self, s, lo, hi) - 1
            if i < lo:
                break
            term = self[i]
            if s.startswith(term):
                return len(term)
            n = next(k for k, (a, b) in enumerate(zip(s, term)) if a != b)
            s = s[:n]
            if n < 2:
                break
        return int(text[place : place + 1] in self.first)  # a term of one byte

    def cut(self, text: str) -> Iterator[str]:
        raw, place = text.encode(), 0
        while place < len(raw):
            n = self.at(raw, place)
            if not n:
                lead = raw[place]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            yield raw[place : place + n].decode()
            place += n


_HELD: dict[str, Terms] = {}


def terms_at(path: str) -> Terms:
    if path not in _HELD:
        _HELD.clear()
        store, at = fs.FileSystem.from_uri(path)
        column = dataset.dataset(at, filesystem=store, format="parquet").to_table(columns=["term"]).column("term")
        _HELD[path] = Terms(column.combine_chunks() if column.num_chunks else pa.array([], pa.string()))
    return _HELD[path]


def tokenize_with(df: DataFrame, text: str, dictionary: DataFrame, out: str = "tokens") -> DataFrame:
    """``df`` with an array of words: at each place the longest term of ``dictionary``, else one character. Null stays null."""
    path = dictionary.stored_at

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        terms = terms_at(path)
        return pa.array([None if t is None else list(terms.cut(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return df.withColumn(out, cut(F.col(text)))
