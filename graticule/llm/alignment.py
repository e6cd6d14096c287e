"""Alignment of two tokenizers' tokens over the same bytes, and how common each linked pair is.

The ends of each tokenizer's tokens, counted in bytes, are keys of a dictionary that gives the
number of tokens so far. Ends in both dictionaries cut the two lists of ids into groups, and the
tokens of a group are linked where their bytes overlap. Both tokenizers end a token before a space
between two characters that are not white space, so texts are cut there, what is found for a
segment is remembered, and a text is its segments in a row.

How many documents hold a pair is counted by blocks of texts: a block numbers its own pairs, so
each document is a short list of numbers, only the block's pairs go to the count of all, and the
counts come back to the block that asked for them. Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.packing import _byte_letters
from graticule.llm.segments import Memory, segments, slices
from graticule.llm.tables import id_and_text, stored

#: Characters of text in a block of documents that share a numbering of pairs.
BLOCK_CHARS = 12 << 20


class Aligned(NamedTuple):
    """Two encodings of the same bytes: groups as text, numbers of tokens and groups, links as 64-bit id pairs."""

    groups: str
    n_a: int
    n_b: int
    n_groups: int
    links: bytes


def pair_key(a: int, b: int) -> int:
    return a << 32 | b


def align_ids(ids_a: list[int], size_a: list[int], ids_b: list[int], size_b: list[int]) -> Aligned:
    """Groups and links of two lists of ids whose tokens have the given sizes and the same total."""
    end_a, end_b = list(accumulate(size_a)), list(accumulate(size_b))
    at_a, at_b = dict(zip(end_a, count(1))), dict(zip(end_b, count(1)))
    groups, links = [], []
    i = j = 0
    for end in sorted(at_a.keys() & at_b.keys()):
        to_i, to_j = at_a[end], at_b[end]
        groups.append(f"{','.join(map(str, ids_a[i:to_i]))}|{','.join(map(str, ids_b[j:to_j]))}")
        while i < to_i and j < to_j:  # the one that ends first gives way; both at the group's end
            links.append(pair_key(ids_a[i], ids_b[j]))
            step = end_a[i] - end_b[j]
            i, j = i + (step <= 0), j + (step >= 0)
    return Aligned(";".join(groups), len(ids_a), len(ids_b), len(groups), array("q", links).tobytes())


def _byte_level(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of texts as they are, and token bytes by id, of a byte-level file of the tokenizers library."""
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    table = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)], table


def _pieces(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """The same of a sentencepiece model, which adds the space itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"{path} has pieces that reach over a space; texts cannot be split there")
        table.append(bytes([int(piece[3:-1], 16)]) if own.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: own.encode(texts, num_threads=1), table


class Aligner:
    """Aligns texts with a space put before them; None for texts that either tokenizer does not give back."""

    def __init__(self, byte_level_path: str, piece_path: str):
        self.encode_a, self.bytes_a = _byte_level(byte_level_path)
        self.encode_b, self.bytes_b = _pieces(piece_path)
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        # Plain tuples of numbers and strings cost the garbage collector nothing.
        self.memory = Memory(lambda texts: [x and tuple(x) for x in self.whole(texts)])

    def whole(self, texts: list[str]) -> list[Aligned | None]:
        """Each text encoded as one."""
        found: list[Aligned | None] = []
        for text, ids_a, ids_b in zip(texts, self.encode_a([" " + t for t in texts]), self.encode_b(texts), strict=True):
            data = b" " + text.encode()
            same = b"".join([self.bytes_a[i] for i in ids_a]) == data == b"".join([self.bytes_b[i] for i in ids_b])
            found.append(align_ids(ids_a, [self.size_a[i] for i in ids_a], ids_b, [self.size_b[i] for i in ids_b]) if same else None)
        return found

    def texts(self, held: list[str]) -> Iterator[Aligned | None]:
        """Each text by its segments; whole if a segment is not given back on its own. An empty text gives None."""
        parts = [segments(t) for t in held]
        self.memory.learn(set().union(*parts))
        for text, own in zip(held, parts, strict=True):
            found = [self.memory[s] for s in own]
            if not found:
                yield None
            elif None in found:
                yield self.whole([text])[0]
            else:
                groups, n_a, n_b, n_groups, links = zip(*found, strict=True)
                yield Aligned(";".join(groups), sum(n_a), sum(n_b), sum(n_groups), b"".join(links))
        self.memory.trim()


@lru_cache(maxsize=2)
def _aligner(byte_level_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_level_path, piece_path)


def groups(docs: DataFrame, byte_level_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links`` of each row, in one pass without a shuffle.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` with the ids in order; ``links`` has the linked pairs as
    ``a << 32 | b``, repeats included. Rows as in ``alignments``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(byte_level_path, piece_path)
        for batch in batches:
            for first, held in slices(batch.column("text")):
                found = [x or Aligned("", 0, 0, 0, b"") for x in own.texts(held)]
                size = np.cumsum([0] + [len(x.links) // 8 for x in found])
                links = pa.array(np.frombuffer(b"".join(x.links for x in found), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(held)), *(pa.array([getattr(x, c) for x in found], pa.int64()) for c in ("n_a", "n_b", "n_groups")),
                     pa.array([x.groups for x in found], pa.string()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), links)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>")


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as their first bytes, then their second ones and so on, which packs better."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Numbers of the distinct pairs of some documents, and in how many of them each is."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.places: dict[int, int] = {}
        self.docs: list[np.ndarray] = []

    def add(self, links: bytes) -> tuple[bytes, bytes]:
        """Numbers of a document's distinct pairs, as steps from one to the next, and how often each is linked."""
        pairs, times = np.unique(np.frombuffer(links, dtype=np.int64), return_counts=True)
        known = self.places
        at = np.array([known.setdefault(p, len(known)) for p in pairs.tolist()], dtype=np.int64)
        self.docs.append(at)
        order = np.argsort(at)
        return _planes(np.diff(at[order], prepend=0)), _planes(times[order])


_FOUND = [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
          ("groups_sha256", pa.string()), ("steps", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("place", pa.int64()), ("docs", pa.int64())]
_FOUND_SCHEMA = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                 "steps binary, times binary, pair long, place long, docs long")


def _rows(n: int, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t)
                                       for c, t in _FOUND], names=[c for c, _ in _FOUND])


def _counted(docs: DataFrame, byte_level_path: str, piece_path: str, block_chars: int) -> DataFrame:
    """Rows of documents, and rows of each block's pairs, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(byte_level_path, piece_path)
        base, held_blocks = TaskContext.get().partitionId() << 32, 0
        block = _Block(base)

        def closed(done: _Block) -> Iterator[pa.RecordBatch]:
            if done.places:
                n = len(done.places)
                docs_of = np.bincount(np.concatenate(done.docs), minlength=n)
                for i in range(0, n, 1 << 16):
                    part = np.fromiter(done.places, np.int64, n)[i : i + (1 << 16)]
                    yield _rows(len(part), block=[done.number] * len(part), pair=part, place=np.arange(i, i + len(part)), docs=docs_of[i : i + len(part)])

        for batch in batches:
            for first, held in slices(batch.column("text")):
                rows = []
                for text, x in zip(held, own.texts(held), strict=True):
                    x = x or Aligned("", 0, 0, 0, b"")
                    digest = hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else ""
                    rows.append((x.n_a, x.n_b, x.n_groups, len(x.links) // 8, digest, *block.add(x.links)))
                    block.chars += len(text)
                n_a, n_b, n_groups, n_links, digest, steps, times = zip(*rows, strict=True)
                yield _rows(len(rows), block=[block.number] * len(rows), doc_id=batch.column("doc_id").slice(first, len(held)), n_a=n_a, n_b=n_b,
                            n_groups=n_groups, n_links=n_links, groups_sha256=digest, steps=steps, times=times)
                if block.chars > block_chars:
                    yield from closed(block)
                    held_blocks += 1
                    block = _Block(base + held_blocks)
        yield from closed(block)

    return id_and_text(docs, "doc_id", "text").mapInArrow(run, _FOUND_SCHEMA)


def _with_counts(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with what the counts of their pairs give."""
    n = pairs.num_rows
    counts, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    place = pairs.column("place").to_numpy()
    counts[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, total = [], []
    for steps, times in zip(docs.column("steps"), docs.column("times"), strict=True):
        at, often = np.cumsum(_of_planes(steps.as_py())), _of_planes(times.as_py())
        n_best.append(int((often * best[at]).sum()))
        total.append(int((often * counts[at]).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count, best`` from ``pair, docs``: documents that hold the pair, and if its first id has none that more hold."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftrightunsigned("pair", 32))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def alignments(docs: DataFrame, byte_level_path: str, piece_path: str, *, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of each row.

    A is a byte-level ``.json`` and encodes the text with a space before it; B is a sentencepiece
    ``.model``, which adds the space. Special tokens are neither added nor known. A pair's count is
    the number of rows that link it; ``n_best`` counts a row's links whose count is the highest of
    their A id, ties included, ``count_sum`` sums the counts over its links. A null or empty text,
    and one that B does not give back byte for byte, has zeros and no digest. A null id stays
    null, repeated rows are documents each by itself, an empty table gives an empty one, other
    columns are not read. Block size changes no result: a worker holds one block's pairs, and the
    second step one block's documents as numbers.
    """
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = stored(_counted(named, byte_level_path, piece_path, block_chars), "aligned")
    pairs = found.filter("pair is not null").select("block", "place", "pair", "docs")
    counts = stored(pair_counts(pairs), "pair_counts")
    asked = pairs.join(counts, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    rows = found.filter("pair is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(asked.groupBy("of_block")).applyInArrow(_with_counts, schema)
