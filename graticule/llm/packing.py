"""Best-fit packing of token sequences by length patterns and non-negative least squares.

Texts are encoded once, with a zero id at the end. Longer ones are cut into full pieces, the
first one shorter. Only piece lengths matter from there: their histogram has ``capacity`` bins
whatever the number of documents. Patterns of one to four lengths that fill a sequence are
enumerated, their repeat counts fitted to the histogram by non-negative least squares and
rounded down, and what is left is packed by best fit, lengths in falling order, on counts of
equal pieces. That gives each length a list of slots; pieces are ranked within their length and
take the slot of their rank.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.tables import id_and_text, stored

CAPACITY = 2048
#: Fixed value: the pattern of byte-level tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rounds of the fit; each visits every pattern once.
SWEEPS = 30
#: Parts that the ranks of one length are counted in.
RANK_PARTS = 256


def _byte_letters() -> str:
    """Byte-level vocabularies write a printable byte as itself, the others as U+0100 onwards."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


def _byte_ranks(plan: dict) -> dict[bytes, int] | None:
    """Ranks for a byte-level encoder that gives the ids of this tokenizer; None if it would not.

    It would if text goes unchanged to byte-level BPE by the usual pattern, and merges are in the
    order of the ids that they make: then the lowest id is the first merge.
    """
    before, model = plan["pre_tokenizer"] or {}, plan["model"]
    if plan["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
        return None
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if made != sorted(set(made)):
        return None
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    special = {t["content"] for t in plan["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return ranks if len(ranks) == len(made) + 256 else None


@lru_cache(maxsize=4)
def _ids(tokenizer_path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text, as the tokenizers library gives them for the file."""
    import tokenizers

    own = tokenizers.Tokenizer.from_file(tokenizer_path)
    plan = json.loads(own.to_str())
    ranks = _byte_ranks(plan)
    if ranks is None:
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    # The same vocabulary in an encoder without the library's bookkeeping, four times as fast.
    import tiktoken

    special = {t["content"]: t["id"] for t in plan["added_tokens"]}
    encoder = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return encoder.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its pattern runs out of stack on a million white-space characters
            return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def _encoded(texts: pa.Array, tokenizer_path: str) -> Iterator[bytes]:
    """The ids of each text and a zero, little-endian and unsigned."""
    ids = _ids(tokenizer_path)
    for text in texts:
        yield ids(text.as_py() or "").astype("<u4").tobytes() + b"\0\0\0\0"


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, in one pass."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, ids in enumerate(_encoded(batch.column("text"), tokenizer_path)):
                total = len(ids) // 4
                start, end, piece = 0, total % capacity or min(total, capacity), 0
                while start < total:
                    rows.append((i, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, schema)


def patterns(present: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of up to four of the lengths ``present``, in falling order within each.

    Every length alone; every pair that fills a sequence or comes nearest to it; for the third
    and fourth place a ladder of middle lengths, the last place again the nearest that fits.
    """
    lengths = np.sort(present)
    fits = lambda room: int(lengths[k]) if (k := int(np.searchsorted(lengths, room, side="right")) - 1) >= 0 else 0
    ladder = sorted({int(x) for x in lengths[np.linspace(0, len(lengths) - 1, min(24, len(lengths))).astype(int)]})
    found: set[tuple[int, ...]] = {(int(a),) for a in lengths}
    for a in map(int, lengths):
        if b := fits(capacity - a):
            found.add(tuple(sorted((a, b), reverse=True)))
        for b in ladder:
            if c := fits(capacity - a - b):
                found.add(tuple(sorted((a, b, c), reverse=True)))
                for d in ladder[::6]:
                    if e := fits(capacity - a - b - d):
                        found.add(tuple(sorted((a, b, d, e), reverse=True)))
    return sorted(found, key=lambda p: (-sum(p), len(p), p))


def fit_repeats(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts of the patterns: least squares under zero or more, by coordinate descent.

    Minimises the squared difference between the lengths used and the histogram. Fuller patterns
    come first, so of equally good fits the one with less room lost is found.
    """
    used = np.zeros(len(columns))
    left = histogram.astype(float).tolist()
    shapes = [[(length, p.count(length)) for length in set(p)] for p in columns]
    norms = [sum(k * k for _, k in s) for s in shapes]
    repeats = used.tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, shape in enumerate(shapes):
            step = sum(k * left[length] for length, k in shape) / norms[j]
            new = repeats[j] + step
            if new < 0:
                new = 0.0
            change = new - repeats[j]
            if change:
                repeats[j] = new
                moved = max(moved, abs(change))
                for length, k in shape:
                    left[length] -= k * change
        if moved < 0.25:
            break
    return np.array(repeats)


def pack_histogram(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for ``histogram[length]`` pieces of each length, as (lengths in order, repeats)."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    if left.any():
        columns = [p for p in patterns(np.flatnonzero(left), capacity) if sum(p) >= capacity - capacity // 128]
        for p, repeats in zip(columns, np.floor(fit_repeats(columns, left)).astype(np.int64), strict=True):
            n = min([int(repeats), *(int(left[length]) // p.count(length) for length in set(p))])
            if n > 0:
                out.append((p, n))
                for length in p:
                    left[length] -= n
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in falling order on counts: groups of equal sequences by the room they have left."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, dtype=bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = length + int(np.argmax(open_rooms[length:]))
            if not open_rooms[at]:
                each = capacity // length
                whole, rest = divmod(n, each)
                for size, count in ((each, whole), (rest, 1)):
                    if size and count:
                        room[capacity - size * length].append(((length,) * size, count))
                        open_rooms[capacity - size * length] = True
                break
            group, count = room[at].pop()
            take = min(count, n)
            if take < count:
                room[at].append((group, count - take))
            open_rooms[at] = bool(room[at])
            room[at - length].append(((*group, length), take))
            open_rooms[at - length] = True
            n -= take
    return [g for groups in room for g in groups]


def _slots(packed: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length in order: key of the first rank, first sequence number, offset."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for lengths, repeats in packed:
        offset = 0
        for length in lengths:
            rows.append((length, int(taken[length]), sequence, offset))
            taken[length] += repeats
            offset += length
        sequence += repeats
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return (table[:, 0] << np.int64(48)) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Place every text in sequences of at most ``capacity`` ids, as few as it can.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece. A null
    text is empty and takes one place (its zero). A null id stays null and repeated rows are
    packed each by itself. An empty table gives an empty one. Other columns are not read.

    What the driver holds is the histogram and the patterns, which are bounded by ``capacity``.
    Ranks within one length are counted in parts, so a frequent length is not one task.
    """
    cut = stored(pieces(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS)).cast("int")
    cut = cut.withColumn("part", part)
    sizes = cut.groupBy("length", "part").count()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    keys, firsts, sequences, offsets = _slots(pack_histogram(histogram, capacity), capacity)

    below = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "part", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (cut.withColumn("within", F.row_number().over(within) - 1)
              .join(before, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("before") + F.col("within")).cast("long").alias("rank")))

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << np.int64(48)) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
