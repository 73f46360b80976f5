"""Token ids of whole texts through a cache of space-delimited pieces.

Byte-level vocabularies split a text by a pattern before any merge, and that pattern never matches
across a single space that stands between two visible characters. So the ids of a text are the ids
of its pieces one after another, and a piece that occurs again needs no second encoding.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from tidemark.llm.words import Words, mix, ragged

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: UTF-8 of white space other than single spaces and line ends: such texts are cut by the pattern below.
_OTHER = re.compile(b"[\t\x0b-\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_CUT = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_RUNS = (b"  ", b"\n ", b" \n")
#: First bytes of the above; without any of them the pattern need not be tried.
_HINTS = (b"\t", b"\x0b", b"\x0c", b"\r", b"\xc2", b"\xe1", b"\xe2", b"\xe3")
_BLANK = np.zeros(256, bool)
_BLANK[32] = True


class PieceCache:
    """Ids of pieces as little-endian unsigned 32-bit integers, kept for at most ``limit`` pieces.

    ``encode`` gets distinct pieces and gives the bytes of the ids of each; ``together``, if given, gets those that begin
    with a space before a visible character and end with one, which are the same one after another. The limit bounds memory
    only, results do not depend on it: when half of it is reached, pieces not seen since the last time go and the others stay.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 1_000_000,
                 together: Callable[[list[bytes]], list[bytes]] | None = None):
        self.encode, self.limit, self.together = encode, limit, together
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ids_of(self, pieces: list[bytes], plain: bool = False) -> list[bytes]:
        if 2 * len(self.known) > self.limit:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        asked = [x for x in (pieces if plain else dict.fromkeys(pieces)) if x not in known]
        new = []
        for x in asked:
            if (kept := before.get(x)) is None:
                new.append(x)
            else:
                known[x] = kept
        if plain and self.together:
            inside = [x for x in new if x[0] == 32 and x[-1] != 10]
            known.update(zip(inside, self.together(inside)))
            new = [x for x in new if x[0] != 32 or x[-1] == 10]
        if new:
            known.update(zip(new, self.encode([x.decode() for x in new])))
        return [known[x] for x in pieces]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if (text[:1] == b" " or text[-1:] == b" " or any(x in text for x in _RUNS)
                    or any(x in text for x in _HINTS) and _OTHER.search(text)):
                pieces = [x.encode() for x in _CUT.findall(text.decode())]
                out[i] = np.frombuffer(b"".join(self._ids_of(pieces)), "<u4")
            else:
                plain.append(i)
        # The rest have single spaces only: distinct pieces of all of them are found by their hashes.
        words = Words([texts[i] for i in plain], _BLANK)
        hashes = words.hashes()
        opening = words.first[words.first < words.last]
        hashes[opening] = mix(hashes[opening] ^ np.uint64(0x5851F42D4C957F2D))
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        leads = np.ones(len(words), bool)
        leads[opening] = False
        raw, starts, ends = words.raw, words.start[at], words.end[at]
        # All but the opening piece of a text begin with the space before them.
        pieces = [raw[a:b] for a, b in zip((starts - leads[at]).tolist(), ends.tolist())]
        ids = self._ids_of(list(pieces), True)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begins = np.cumsum(sizes) - sizes
        total = np.append(0, np.cumsum(sizes[which]))
        flat = flat[ragged(begins[which], sizes[which])]
        for i, a, b in zip(plain, total[words.first].tolist(), total[words.last].tolist()):
            out[i] = flat[a:b]
        return out
