"""Texts as segments that a tokenizer encodes apart from each other.

A space between two characters that are not white space is a safe boundary for both kinds of
tokenizer used here: neither has a token with a space anywhere but at its front. Texts are cut
at those spaces and a segment stands for itself with the space before it. Where white space
stands together, or at an end of the text, nothing is cut. Encoded segments are remembered up
to a bound, so a frequent word is encoded once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Segments that a worker remembers; ones longer than ``REMEMBERED_CHARS`` it never does.
REMEMBERED, REMEMBERED_CHARS = 300_000, 48
#: Characters handed to a tokenizer at once, and bytes of text looked at together.
BATCH_CHARS, SLICE_BYTES = 1 << 18, 4 << 20

# U+2581 stands for a space in sentencepiece models.
_SAFE = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ") + "▁"
_WHITE_ASCII = "".join(c for c in _WHITE if c.isascii())


def _is_odd(text: str) -> bool:
    """True if a space stands beside white space or at an end of the text."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return True
    there = _WHITE_ASCII if text.isascii() else set(text).intersection(_WHITE)
    return any(" " + c in text or c + " " in text for c in there)


def segments(text: str) -> list[str]:
    """The segments of a text; the one space before each but the first is left out."""
    if not text:
        return []
    return _SAFE.split(text) if _is_odd(text) else text.split(" ")


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``SLICE_BYTES`` together, with the number of the first."""
    i, held, size = 0, [], 0
    for k, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + len(text) > SLICE_BYTES:
            yield i, held
            i, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield i, held


class Memory(dict):
    """What ``encode`` gives for each segment; ``encode`` takes a list of segments.

    There are two generations. When the younger one is full it becomes the older, and what is
    asked for again moves over without being encoded again, so frequent segments stay.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable]):
        super().__init__()
        self.encode = encode
        self.older: dict = {}

    def learn(self, wanted: set[str]) -> None:
        """Encode what is not known yet, in batches balanced by their characters."""
        missing = wanted.difference(self)
        known = self.older.keys() & missing
        self.update((s, self.older[s]) for s in known)
        missing = sorted(missing - known, key=len)
        i = 0
        while i < len(missing):
            j, chars = i, 0
            while j < len(missing) and (j == i or chars + len(missing[j]) <= BATCH_CHARS):
                chars += len(missing[j])
                j += 1
            self.update(zip(missing[i:j], self.encode(missing[i:j]), strict=True))
            i = j

    def trim(self) -> None:
        """Forget long segments, and begin a generation if this one is full."""
        if len(self) > REMEMBERED:
            self.older = {s: v for s, v in self.items() if len(s) <= REMEMBERED_CHARS}
            self.clear()
        for s in [s for s in self if len(s) > REMEMBERED_CHARS]:
            del self[s]
