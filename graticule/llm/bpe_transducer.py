"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

The merges of a rank file decide which token may follow which: a row of tokens is the encoding of
its bytes exactly if each two neighbours, merged by rank on their own, stay those two tokens. So
each prefix of a text has one last token, and reading a byte only needs the tokens that end there.
The transducer guesses, at every place where some token can still begin, that one does: a guess is
a node of the tree of tokens, the token before it, and the tokens since the last one given out. A
state is the set of all guesses that the bytes leave open, so the machine is deterministic; tokens
with which all of them begin are certain and given out, and the state forgets them. A guess is
open for fewer bytes than the longest token has, so lookahead is bounded. States and moves are
made when first met.

Decoding looks tokens up in chunks and passes their bytes through a UTF-8 state machine, so a
character that is cut by a chunk waits for the next one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graticule.llm.segments import Memory, segments, slices
from graticule.llm.tables import id_and_text, reach_workers

#: Moves and checked neighbours that a worker keeps before it begins anew; nothing but time depends on them.
MOST_MOVES, MOST_NEIGHBOURS = 400_000, 300_000
#: Ids that the decoder takes at once.
CHUNK_IDS = 8192


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """Tokens of a few bytes by merging the neighbours of lowest rank, the first of equals, while one is under ``below``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        made = [ranks.get(parts[i] + parts[i + 1], below) for i in range(len(parts) - 1)]
        at = min(range(len(made)), key=made.__getitem__)
        if made[at] >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: A place where a token may begin: node of the tree of tokens reached since, rank of the token that ends there, ranks not yet given out.
_Open = tuple[int, int, tuple[int, ...]]


class Transducer:
    """Reads bytes of one piece of text and gives out ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack single bytes; some texts could not be encoded")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.none = max(self.token) + 1
        # The tree of tokens: 256 times a node plus a byte gives the next node; nodes that are tokens have their rank.
        self.tree: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.tree.setdefault(node << 8 | byte, len(self.tree) + 1)
            self.ends[node] = rank
        self.inner = {edge >> 8 for edge in self.tree}
        self.neighbours: dict[int, bool] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, float]] | None] = {}
        self._begin()

    def _begin(self) -> None:
        start: tuple[_Open, ...] = ((0, self.none, ()),)
        self.number: dict[tuple[_Open, ...], int] = {start: 0}
        #: Of each state its open places in order; the last is the end of what was read.
        self.held: list[tuple[_Open, ...]] = [start]
        #: By 256 times the state plus the byte: the next state and the ids given out.
        self.moves: dict[int, tuple[int, bytes]] = {}

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]] | None:
        """What lies at the left (0) or right (1) edge of a token while it is merged, from byte to token,
        and the rank that takes each away. None if merging its bytes does not end in the token."""
        if (token, side) not in self.edges:
            inner, found = token, [(token, float("inf"))]
            while len(inner) > 1 and found is not None:
                halves = merged(inner, self.ranks, self.ranks[inner])
                if len(halves) == 2:
                    found.append((halves[side], self.ranks[inner]))
                    inner = halves[side]
                elif merged(inner, self.ranks) == [inner]:
                    raise ValueError("the ranks are not in the order of their merges")
                else:
                    found = None
            self.edges[token, side] = found and found[::-1]
        return self.edges[token, side]

    def _stay_two(self, left: bytes, right: bytes) -> bool:
        """Whether no merge reaches over the boundary before its two sides are done."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = a[i], b[j]
            over = self.ranks.get(x + y, float("inf"))
            if over < x_goes and over <= y_goes and over != float("inf"):
                return False
            if x_goes == y_goes == float("inf"):
                return True
            i, j = (i + 1, j) if x_goes <= y_goes else (i, j + 1)

    def _may_follow(self, left: int, right: int) -> bool:
        if len(self.neighbours) >= MOST_NEIGHBOURS:
            self.neighbours.clear()
        after = self.token[right]
        known = self._edge(after, 0) is not None if left == self.none else self._stay_two(self.token[left], after)
        self.neighbours[left << 32 | right] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, bytes]:
        tree, ends, neighbours = self.tree, self.ends, self.neighbours
        found, still = None, []
        for node, left, way in self.held[state]:
            node = tree.get(node << 8 | byte)
            if node is None:
                continue  # no token has these bytes
            rank = ends.get(node)
            if rank is not None and found is None:  # else another token ends here already, and only one can
                known = neighbours.get(left << 32 | rank)
                if self._may_follow(left, rank) if known is None else known:
                    found = (0, rank, (*way, rank))
            if node in self.inner:
                still.append((node, left, way))
        still.append(found)
        given = b""
        if all(way for _, _, way in still):
            certain = 0
            for same in zip(*[way for _, _, way in still], strict=False):
                if same.count(same[0]) < len(same):
                    break
                certain += 1
            if certain:
                given = b"".join(rank.to_bytes(4, "little") for rank in still[0][2][:certain])
                still = [(node, left, way[certain:]) for node, left, way in still]
        key = tuple(still)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.held)
            self.held.append(key)
        return to, given

    def encode(self, piece: bytes) -> bytes:
        """The ids of one piece; a piece that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if len(self.moves) > MOST_MOVES:
            self._begin()
        moves, state, out = self.moves, 0, []
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self._move(state, byte)
            state, given = move
            if given:
                out.append(given)
        out += [rank.to_bytes(4, "little") for rank in self.held[state][-1][2]]
        return b"".join(out)


class Splitter:
    """Pieces of a text by a pattern, with letters and numbers as tiktoken's own tables know them."""

    def __init__(self, pattern: str):
        self.usual = self.narrow = regex.compile(pattern)
        newer = {name: self._newer(rf"\p{{{name}}}") for name in ("L", "N")}
        self.odd = regex.compile("[" + "".join(newer.values()) + "]") if any(newer.values()) else None
        if self.odd is not None:
            for name, ranges in newer.items():
                if ranges:
                    pattern = pattern.replace(rf" ?\p{{{name}}}+", rf" ?(?:(?![{ranges}])\p{{{name}}})+")
            self.narrow = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[%s])" % "".join(newer.values())))

    def _newer(self, pattern: str) -> str:
        """Ranges of the code points of a class that tiktoken's pattern engine does not count, asked in one text."""
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        wide = regex.findall(pattern, "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
        return self._ranges(sorted(set(wide).difference(bytes(probe.encode_ordinary("".join(wide))).decode())))

    @staticmethod
    def _ranges(chars: list[str]) -> str:
        codes = np.array([ord(c) for c in chars], dtype=np.int64)
        if not len(codes):
            return ""
        first = np.flatnonzero(np.diff(codes, prepend=-2) > 1)
        lasts = np.append(first[1:], len(codes)) - 1
        return "".join(rf"\U{codes[a]:08x}-\U{codes[b]:08x}" for a, b in zip(first, lasts, strict=True))

    def split(self, text: str) -> list[str]:
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            return self.narrow.findall(text)
        return self.usual.findall(text)


def _utf8_table() -> list[dict[int, int]]:
    """Moves of the machine: 0 between characters, 1 to 3 that many bytes to come, others after a lead byte with a narrower second."""
    tail = range(0x80, 0xC0)
    lead = {b: 0 for b in range(0x80)} | {b: 1 for b in range(0xC2, 0xE0)} | {b: 2 for b in range(0xE1, 0xF0)} | {b: 3 for b in range(0xF1, 0xF4)}
    lead |= {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
    second = [dict.fromkeys(range(0xA0, 0xC0), 1), dict.fromkeys(range(0x80, 0xA0), 1), dict.fromkeys(range(0x90, 0xC0), 2), dict.fromkeys(range(0x80, 0x90), 2)]
    return [lead, dict.fromkeys(tail, 0), dict.fromkeys(tail, 1), dict.fromkeys(tail, 2), *second]


_UTF8 = _utf8_table()


class Utf8Stream:
    """Text of a stream of bytes. Each longest beginning of a character that cannot go on gives U+FFFD."""

    def __init__(self) -> None:
        self.state, self.waiting = 0, b""

    def _walk(self, data: bytes) -> str:
        out, begin, state = [], 0, 0
        i = 0
        while i < len(data):
            to = _UTF8[state].get(data[i])
            if to is None:
                out.append("�")
                i += state == 0  # the byte that stops a character may begin the next one
                begin = i
                state = 0
                continue
            i += 1
            state = to
            if state == 0:
                out.append(data[begin:i].decode())
                begin = i
        self.state, self.waiting = state, data[begin:]
        return "".join(out)

    def feed(self, data: bytes) -> str:
        """The characters that are complete now."""
        data = self.waiting + data
        cut = next((i for i in range(len(data) - 1, max(-1, len(data) - 4), -1) if data[i] >= 0xC0), len(data))
        try:
            front = data[:cut].decode()
        except UnicodeDecodeError:
            return self._walk(data)
        return front + self._walk(data[cut:])

    def finish(self) -> str:
        """What is left at the end: U+FFFD for a character that was cut."""
        left, self.state, self.waiting = self.waiting, 0, b""
        return "�" if left else ""


def decode_stream(chunks: Iterable[bytes], tokens: list[bytes]) -> Iterator[tuple[bytes, str]]:
    """Bytes and complete characters of each chunk of ids, and of the end."""
    stream = Utf8Stream()
    for chunk in chunks:
        ids = np.frombuffer(chunk, dtype="<u4").tolist()
        if ids and max(ids) >= len(tokens):
            raise ValueError(f"id {max(ids)} is not in the vocabulary")
        data = b"".join(map(tokens.__getitem__, ids))
        yield data, stream.feed(data)
    yield b"", stream.finish()


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str) -> tuple[Memory, Memory]:
    """Ids of segments that follow a space, and of those that begin a text."""
    machine, splitter = Transducer(read_ranks(ranks_path)), Splitter(pattern)

    def encode(texts: list[str]) -> list[bytes]:
        return [b"".join([machine.encode(p.encode()) for p in splitter.split(t)]) for t in texts]

    return Memory(lambda batch: encode([" " + s for s in batch])), Memory(encode)


@lru_cache(maxsize=2)
def _tokens(ranks_path: str) -> list[bytes]:
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _read_back(ids: bytes, tokens: list[bytes]) -> tuple[bytes, str]:
    size = 4 * CHUNK_IDS
    own = list(decode_stream((ids[i : i + size] for i in range(0, len(ids), size)), tokens))
    return b"".join(x for x, _ in own), "".join(x for _, x in own)


def _rows(named: pa.Array, ids: list[bytes], tokens: list[bytes] | None) -> pa.RecordBatch:
    columns = {"doc_id": named, "ids": pa.array(ids, pa.binary())}
    if tokens is not None:
        back = [_read_back(x, tokens) for x in ids]
        columns |= {"decoded": pa.array([x for x, _ in back], pa.binary()), "text": pa.array([x for _, x in back], pa.string())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encode(docs: DataFrame, ranks_path: str, *, pattern: str = public_tokenizers.PATTERN, read_back: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each row: the ids of the whole text as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself; the pattern must begin a match at a space between two
    characters that are not white space, as those of byte-level vocabularies do. With ``read_back``
    the ids are decoded in the same pass, and the columns of ``decode`` follow. A null
    text is empty and has no ids, a null id stays null, repeated rows are encoded each by itself, an
    empty table gives an empty one, and other columns are not read. Length is not limited: a worker
    holds one slice of texts, or one longer text, and what it remembers is bounded. There is no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, front = _encoder(ranks_path, pattern)
        tokens = _tokens(ranks_path) if read_back else None
        for batch in batches:
            for first, held in slices(batch.column("text")):
                parts = [segments(t) for t in held]
                front.learn({p[0] for p in parts if p})
                later.learn(set().union(*[p[1:] for p in parts]))
                ids = [front[p[0]] + b"".join(map(later.__getitem__, p[1:])) if p else b"" for p in parts]
                front.trim()
                later.trim()
                yield _rows(batch.column("doc_id").slice(first, len(held)), ids, tokens)

    schema = "doc_id long, ids binary" + ", decoded binary, text string" * read_back
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, ids, decoded, text`` of each row of ``encode``.

    ``decoded`` has the bytes of the tokens. ``text`` has their characters, with U+FFFD for bytes
    that are no UTF-8. Null ids count as none; an id beyond the vocabulary stops the job.
    """
    reach_workers(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_path)
        for batch in batches:
            yield _rows(batch.column("doc_id"), [x.as_py() or b"" for x in batch.column("ids")], tokens)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary, text string")
