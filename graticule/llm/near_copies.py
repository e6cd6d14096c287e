"""Near copies: texts whose sets of five-word shingles are alike to a given share.

SimHash prints of the sets find candidates by the multi-index method of ``simhash``, at a radius
wide enough for that share; each candidate pair is then checked on the sets themselves. Texts of
one set are one node. Sets too different in size to be alike never meet: keys hold a class of sizes.

The print decides where a node is looked for; a longer sketch, one bit of each of many minima of
the set, is compared in the same join, so texts that are somewhat alike are no candidates. A large
group is not compared within itself. First every key has a few centres, more in each
round, and the nodes that ask for the key meet only those: candidates are in proportion to the
nodes. What verified pairs join is one root from then on. The last round compares all nodes of
different roots that a key brings together, so no pair within the radius is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.components import components
from graticule.llm.simhash import _masks, segment_plan
from graticule.llm.tables import id_and_text, stored
from graticule.llm.textblocks import blocks, mix

SIMILARITY, SHINGLE, SEED = 0.8, 5, 42
#: Differing bits, and segments of a print.
RADIUS, SEGMENTS = 15, 8
#: 64-bit words of a sketch, and standard deviations that a pair of the least similarity may lie beyond its mean.
SKETCH_WORDS, SKETCH_WIDTH = 8, 3.0
#: Centres of each key in the rounds before the last.
CENTRES = (1, 8)
#: Nodes, about, in each bucket of the pairs that are checked together.
BUCKET_NODES = 2000
_CHUNK = 1 << 15


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of one UTF-8 text, in order; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = min(shingle, len(words))
    spans = map(slice, (end - size)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64))


def print_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set, unsigned."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


#: Odd factors, one for each bit of a sketch.
_FACTORS = mix(np.arange(1, 64 * SKETCH_WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """One bit of the least product of a set's hashes with each factor, as signed 64-bit words.

    Two sets agree in a bit with probability (1 + similarity) / 2.
    """
    if not len(hashes):
        return np.zeros(SKETCH_WORDS, dtype=np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 18) // len(_FACTORS))
    for i in range(0, len(hashes), step):
        np.minimum(least, (hashes[i : i + step, None] * _FACTORS).min(axis=0), out=least)
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64)


def most_differing(similarity: float) -> int:
    """Differing bits that sketches of a pair of this similarity rarely pass."""
    n, p = 64 * SKETCH_WORDS, (1 - similarity) / 2
    return int(n * p + SKETCH_WIDTH * (n * p * (1 - p)) ** 0.5)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches a share."""
    if min(len(a), len(b)) / max(len(a), len(b), 1) < similarity:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _nodes(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, blob, node, print, size`` and the sketch of each row: hashes of its text and of its set."""
    names = ["node", "print", "size", *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for b in blocks(batch.column("text")):
                for i in range(b.size):
                    own = shingle_set(b.text(i), shingle)
                    found.append((*np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED), print_of(own), len(own)], dtype=np.uint64).view(np.int64), *sketch_of(own)))
            columns = np.array(found, dtype=np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("blob"), *(pa.array(c) for c in columns)], names=["doc_id", "blob", *names])

    texts = id_and_text(docs, id_col, text_col).withColumn("blob", F.xxhash64("text"))
    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in ["doc_id", "blob", *names]))


def candidates(nodes: DataFrame, *, radius: int = RADIUS, segments: int = SEGMENTS, similarity: float = SIMILARITY,
               centres: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of ``node, print, size, root`` and sketches: within the radius, of sizes and
    sketches that allow the similarity, and of different roots.

    With ``centres``, ``b`` is one of so many nodes of each key, and a pair may come again under
    another key; without, all pairs come once each.
    """
    plan = segment_plan(radius, segments)
    # A little wider than the share asks for, so rounding keeps sizes that allow it in neighbouring classes.
    size_class = F.floor(F.log("size") / F.lit(-np.log(similarity) * 1.0001 + 1e-9)).cast("long")

    def part(value: Column, n: int) -> Column:
        shift, width, _ = plan[n]
        return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))

    def key(n: int, of_class: Column, own: Column) -> Column:
        return F.shiftleft(F.lit(n).cast("long"), 54) + F.shiftleft(of_class + 1, 34) + own

    own = [part(F.col("print"), n) for n in range(len(plan))]
    asked = F.array(*[key(n, size_class, own[n].bitwiseXOR(F.lit(m))) for n, (_, width, ball) in enumerate(plan) for m in _masks(width, ball)])
    kept = F.array(*[key(n, size_class - k, own[n]) for n in range(len(plan)) for k in (0, 1)])
    held = nodes.filter("size > 0")
    told = ["print", "size", "root", *_SKETCH]
    query = held.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in told], F.explode(asked).alias("key"))
    table = held.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in told], F.explode(kept).alias("key_b"))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH])
    bits = F.col("print_a").bitwiseXOR(F.col("print_b"))
    near = (F.bit_count(bits) <= radius) & (F.col("root_a") != F.col("root_b")) & (F.least("size_a", "size_b") / F.greatest("size_a", "size_b") >= similarity) & (apart <= most_differing(similarity))
    if centres:
        place = F.xxhash64("b", F.lit(centres))
        chosen = table.groupBy("key_b", F.pmod(place, F.lit(centres)).alias("part")).agg(F.min_by(F.struct("b", *[f"{c}_b" for c in told]), place).alias("c"))
        return query.join(chosen.select("key_b", "c.*"), (F.col("key") == F.col("key_b")) & near).select("a", "b")
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    first = F.coalesce(*[F.when(F.bit_count(part(bits, n)) <= ball, F.lit(n).cast("long")) for n, (_, _, ball) in enumerate(plan)])
    return query.join(table, (F.col("key") == F.col("key_b")) & near & smaller & (first == F.shiftright("key", 54))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, *, similarity: float, shingle: int) -> DataFrame:
    """The pairs whose sets are alike; ``texts`` is ``node, text``.

    Pairs meet in blocks of two buckets of nodes, so a text is sent once to a block and not once
    for each of its pairs, and a block is bounded.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    buckets = max(16, -(-ends.count() // BUCKET_NODES))

    def bucket(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(buckets))

    placed = pairs.withColumn("block", bucket("a") * buckets + bucket("b"))
    ends = placed.select(F.col("a").alias("node"), "block").union(placed.select("b", "block")).distinct()
    held = ends.withColumnRenamed("block", "of_block").join(texts, "node")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {n: shingle_set(t.as_py().encode(), shingle) for n, t in zip(right.column("node").to_pylist(), right.column("text"), strict=True)}
        a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
        return left.select(["a", "b"]).filter(pa.array([alike(sets[x], sets[y], similarity) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return placed.groupBy("block").cogroup(held.groupBy("of_block")).applyInArrow(check, "a long, b long")


def one_of_each(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, centres: tuple[int, ...] = CENTRES,
                segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group of near copies: the smallest id, then text hash.

    A group is what pairs of ``similarity`` or more reach. Words are lower-cased (A-Z) and parted
    at ASCII white space; shorter texts count as one shingle. Texts without words, null ones among
    them, are one group. Rows without an id stand after all others; of rows equal in id and text
    one stays. An empty table gives an empty one, and all columns are kept whatever their names.
    A pair whose prints differ in more than the radius, or whose sketches differ in more than
    ``most_differing``, is missed; a test measures how many.
    """
    each = stored(_nodes(docs, shingle, id_col, text_col), "prints")
    told = ["print", "size", *_SKETCH]
    nodes = stored(each.groupBy("node").agg(*[F.min(c).alias(c) for c in told], F.min("blob").alias("chosen_blob")), "nodes")
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("own_blob", F.xxhash64("text"))
    rooted, links = nodes.withColumn("root", F.col("node")), None
    for many in (*centres, None):
        pairs = candidates(rooted, radius=radius, segments=segments, similarity=similarity, centres=many)
        pairs = stored(pairs.distinct() if many else pairs, "candidates")
        wanted = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi").select("node", "chosen_blob")
        own = stored(texts.join(wanted, F.col("own_blob") == F.col("chosen_blob")).dropDuplicates(["node"]).select("node", "text"), "pair_texts")
        found = stored(verified(pairs, own, similarity=similarity, shingle=shingle), "verified")
        links = found if links is None else links.union(found)
        roots = components(links).withColumnRenamed("root", "new_root")
        rooted = stored(nodes.join(roots, "node", "left").select("node", *told, F.coalesce("new_root", "node").alias("root")), "rooted")
    named = each.join(rooted.select("node", "root"), "node")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "blob")).alias("least"))
    chosen = least.select(F.col("least.doc_id").alias("chosen_id"), F.col("least.blob").alias("chosen_blob")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("own_id"),
                       F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("own_blob"))
    kept = rows.join(chosen, F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own_blob") == F.col("chosen_blob")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_blob"]).select("row.*")
