"""Texts cut into chunks that a byte-level BPE encodes independently, so that repeated chunks are encoded once.

The pre-tokenizing pattern never joins what stands in two chunks: a chunk is a word of Latin letters with one space
before it, as the pattern itself would take it, any other run of non-space characters up to white space, or white
space as the pattern would take it. So a text's ids are its chunks' ids in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import filterfalse

from weftline.llm.common import CACHES

#: White space as Unicode's White_Space property has it; Python's own \s has four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters up to U+00FF; a word of them that ends before a stop or white space is one match of the pattern.
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
CHUNK = re.compile(f" ?[{LETTERS}]+(?=[,.;:!?|{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class ChunkCache:
    """Encoded chunks, at most ``most`` of them; a full cache starts anew. Chunks over ``longest`` characters
    aren't kept. Texts that hold one of ``added`` are encoded by ``whole``."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes] | None = None, added: Iterable[str] = (), most: int = 1_200_000, longest: int = 64):
        self.encode, self.most, self.longest, self.known = encode, most, longest, {}
        self.whole, self.added = whole, [x for x in added if x]
        CACHES.add(self)

    def clear(self) -> None:
        self.known.clear()

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        """The joined encoded chunks of each text."""
        texts = list(texts)
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not odd:
            return self._by_chunks(texts)
        out = self._by_chunks(["" if any(x in t for x in self.added) else t for t in texts])
        for i in odd:
            out[i] = self.whole(texts[i])
        return out

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        cut = [CHUNK.findall(t) for t in texts]
        known = self.known
        missing: set[str] = set()
        for chunks in cut:
            missing.update(filterfalse(known.__contains__, chunks))
        extra: dict[str, bytes] = {}
        if missing:
            if len(known) + len(missing) > self.most and known:
                known.clear()
                missing = {c for chunks in cut for c in chunks}
            order = list(missing)
            for c, ids in zip(order, self.encode(order)):
                (known if len(c) <= self.longest else extra)[c] = ids
        get = known.__getitem__
        if extra:
            get = lambda c: known[c] if c in known else extra[c]
        return [b"".join(map(get, chunks)) for chunks in cut]
