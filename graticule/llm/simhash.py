"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments. By the pigeonhole principle two fingerprints within the
radius agree in some segment up to a small number of bits, so each fingerprint is stored under
its own segments and asked for under a small Hamming ball around each of them. The full distance
is verified inside the join. Equal fingerprints meet once, as one row of a table of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.components import components
from graticule.llm.tables import id_and_text, stored
from graticule.llm.textblocks import blocks

RADIUS, SEED, SHINGLE = 4, 42, 4
#: Shingles whose bits are counted together.
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one UTF-8 text, unsigned."""
    words = text.lower().split()  # on bytes: A-Z only, and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    stop = end[shingle - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(start), _CHUNK):
        spans = map(slice, start[i : i + _CHUNK], stop[i : i + _CHUNK])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(start)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, blob, print`` of each row: a hash of its text and its print as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(b.text(i), shingle) for b in blocks(batch.column("text")) for i in range(b.size)]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("blob"), prints], names=["doc_id", "blob", "print"])

    texts = id_and_text(docs, id_col, text_col).withColumn("blob", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, blob long, print long")


def segment_plan(radius: int, segments: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) per segment.

    With r = m * q + a, two prints within r differ in at most q bits in one of the first a + 1
    segments, or in at most q - 1 bits in one of the others: else they would differ in at least
    (a + 1) * (q + 1) + (m - a - 1) * q = r + 1 bits. A segment whose ball would be empty is
    not used.
    """
    q, a = divmod(radius, segments)
    plan, shift = [], 0
    for i in range(segments):
        width = bits // segments + (i < bits % segments)
        ball = q if i <= a else q - 1
        if ball >= 0:
            plan.append((shift, width, ball))
        shift += width
    return plan


def _masks(width: int, ball: int) -> list[int]:
    return [sum(1 << b for b in chosen) for k in range(ball + 1) for chosen in combinations(range(width), k)]


def links(prints: DataFrame, *, radius: int = RADIUS, segments: int = 3) -> DataFrame:
    """Pairs ``a < b`` of the distinct values ``print`` that differ in at most ``radius`` bits.

    A pair may come more than once. ``segments`` sets the trade between keys asked for and
    prints met under each key; near 64 / log2(number of prints) is best.
    """
    def under(n: int, key: Column) -> Column:
        return F.struct(F.lit(n).alias("segment"), key.alias("key"))

    def around(n: int, own: Column, masks: list[int]) -> Column:
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: under(n, own.bitwiseXOR(m)))

    stored_keys, asked = [], []
    for n, (shift, width, ball) in enumerate(segment_plan(radius, segments)):
        own = F.shiftrightunsigned("print", shift).bitwiseAND(F.lit((1 << width) - 1))
        stored_keys.append(under(n, own))
        asked.append(around(n, own, _masks(width, ball)))
    table = prints.select(F.col("print").alias("b"), F.explode(F.array(*stored_keys)).alias("k")).select("b", "k.*")
    query = prints.select(F.col("print").alias("a"), F.explode(F.concat(*asked)).alias("k")).select("a", "k.*")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return query.join(table, (query["segment"] == table["segment"]) & (query["key"] == table["key"]) & near).select("a", "b")


def groups(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, segments: int = 3,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, print, root`` of each row; ``root`` names its component by a print.

    Rows of one print are one class, so copies are never paired with each other; pairs are kept
    between classes only.
    """
    each = stored(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "prints")
    classes = each.select("print").distinct()
    found = components(links(classes, radius=radius, segments=segments))
    rooted = classes.join(found, classes["print"] == found["node"], "left").select("print", F.coalesce("root", "print").alias("root"))
    return stored(each.join(rooted, "print").select("doc_id", "blob", "print", "root"), "groups")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, segments: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Prints are taken over lower-cased ``shingle``-word shingles and linked at ``radius`` or fewer
    differing bits; a component is what links reach, named by its smallest id. Texts without
    words (empty or null) have print zero and link like others. Rows with the same id are
    separate documents of that id; a null id is never the name of a component that has another.
    An empty table gives an empty one. Other columns are not read.
    """
    each = groups(docs, radius=radius, shingle=shingle, segments=segments, id_col=id_col, text_col=text_col)
    names = each.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return each.join(names, "root").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, segments: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component: the smallest id, then text hash.

    Rows without an id stand after all others; of rows equal in id and text one stays.
    """
    each = groups(docs, radius=radius, shingle=shingle, segments=segments, id_col=id_col, text_col=text_col)
    least = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "blob")).alias("least"))
    chosen = least.select(F.col("least.doc_id").alias("chosen_id"), F.col("least.blob").alias("chosen_blob")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("own_id"),
                       F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("own_blob"))
    kept = rows.join(chosen, F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own_blob") == F.col("chosen_blob")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_blob"]).select("row.*")
