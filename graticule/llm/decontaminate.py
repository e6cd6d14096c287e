"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap checks.

Test items are cut into segments of at most ``SEGMENT`` words, so that a leaked segment lies
whole in one passage of twice that length. Segments are the documents of an inverted index whose
impacts are BM25 scores over the segment's own score: 1.0 is a passage that holds all of it, and
one threshold serves short and long segments alike. Postings are ordered by segment and cut into
blocks with their largest impact. Every passage of every training text is a query. Blocks whose
largest impacts cannot reach the threshold for a passage are passed over, for all passages of a
block of texts at once; in the others the postings are walked document at a time with the WAND
pivot. All segments at or above the threshold are found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.tables import id_and_text, reach_workers
from graticule.llm.textblocks import blocks

SEGMENT, SHINGLE = 32, 5
K1, B = 1.2, 0.75
#: Share of a segment's own score that a passage must reach; share of shingles that must occur.
THRESHOLD, OVERLAP = 0.6, 0.8
#: Postings in a block of the index, test items in an index.
BLOCK_SEGMENTS, SHARD_ITEMS = 4, 4096

_SENTENCE = re.compile(r"(?<=[.?!])\s+")
#: ASCII characters other than letters, digits and the underscore part words; others never do.
_PARTING = bytes(c if c >= 0x80 or chr(c).isalnum() or c == 0x5F else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return text.lower().encode().translate(_PARTING).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item before its last sentence, and those of it; one sentence has no answer."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def overlap(part: list[bytes], there: list[bytes]) -> float:
    """Share of the five-word shingles of ``part`` that ``there`` has; 1.0 for no words."""
    wanted = _shingles(part)
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    have = {tuple(there[i : i + n]) for i in range(len(there) - n + 1)}
    return len(wanted & have) / len(wanted)


@dataclass
class Index:
    """Impacts of a bounded number of test items; everything in it is broadcast."""

    items: list[tuple[int, str]]
    item_of: list[int]
    terms: dict[bytes, int]
    postings: list[list[tuple[int, float]]]
    #: Largest impact of each term (row; the last row is for words not known) in each block.
    block_max: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]], df: dict[bytes, int], n_segments: int, mean_size: float) -> Index:
        """``df``, ``n_segments`` and ``mean_size`` describe the segments of the whole benchmark."""
        item_of, bags = [], []
        for k, (_, text) in enumerate(items):
            for segment in segments_of(text):
                item_of.append(k)
                bags.append(Counter(segment))
        terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for s, bag in enumerate(bags):
            size = sum(bag.values())
            norm = K1 * (1 - B + B * size / mean_size)
            weight = {t: np.log1p((n_segments - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in bag.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                if t not in terms:
                    terms[t] = len(terms)
                    postings.append([])
                postings[terms[t]].append((s, float(w / own)))
        block_max = np.zeros((len(terms) + 1, max(1, -(-len(bags) // BLOCK_SEGMENTS))), dtype=np.float32)
        for t, listed in enumerate(postings):
            for s, w in listed:
                block_max[t, s // BLOCK_SEGMENTS] = max(block_max[t, s // BLOCK_SEGMENTS], w)
        return cls(items, item_of, terms, postings, block_max)

    def search(self, query: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Segments of a block that score ``threshold`` or more, by the WAND pivot."""
        lo, hi = block * BLOCK_SEGMENTS, (block + 1) * BLOCK_SEGMENTS
        lists = []
        for t in query:
            if bound := float(self.block_max[t, block]):
                lists.append([[p for p in self.postings[t] if lo <= p[0] < hi], 0, bound])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            total, pivot = 0.0, None
            for cursor in lists:
                total += cursor[2]
                if total >= threshold - 1e-6:
                    pivot = cursor[0][cursor[1]][0]
                    break
            if pivot is None:
                break
            if lists[0][0][lists[0][1]][0] == pivot:
                score = 0.0
                for cursor in lists:
                    if cursor[0][cursor[1]][0] == pivot:
                        score += cursor[0][cursor[1]][1]
                        cursor[1] += 1
                if score >= threshold:
                    found.append((pivot, score))
            else:
                for cursor in lists:
                    while cursor[1] < len(cursor[0]) and cursor[0][cursor[1]][0] < pivot:
                        cursor[1] += 1
            lists = [c for c in lists if c[1] < len(c[0])]
        return found


def segments_of(text: str) -> list[list[bytes]]:
    """An item's words in stretches of nearly equal length, ``SEGMENT`` at most."""
    words = words_of(text)
    n = -(-len(words) // SEGMENT)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def _passages(words: list[bytes], index: Index, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(segment, first word, score) of the passages of a text that reach the threshold."""
    number = np.fromiter(map(index.terms.get, words, repeat(-1)), np.int64, len(words))
    at = np.flatnonzero(number >= 0)
    if not len(at):
        return
    # A passage is two halves; each word stands in the one that begins with its half and in the
    # one that ends with it. Terms count once for each passage.
    half, n_terms = at // SEGMENT, len(index.terms)
    pair = np.unique(np.concatenate((half * n_terms + number[at], np.maximum(half - 1, 0) * n_terms + number[at])))
    passage, term = np.divmod(pair, n_terms)
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    bound = np.add.reduceat(index.block_max[term], first, axis=0)
    for p, block in zip(*np.nonzero(bound >= threshold - 1e-4), strict=True):
        query = term[first[p] : first[p + 1] if p + 1 < len(first) else None].tolist()
        for s, score in index.search(query, int(block), threshold):
            yield s, int(passage[first[p]]) * SEGMENT, score


def leaks_in(text: str, index: Index, threshold: float = THRESHOLD, least: float = OVERLAP) -> list[tuple[int, float, float, float]]:
    """(item, best score, question overlap, answer overlap) of the items that a text holds."""
    hits: defaultdict[int, list[tuple[int, float]]] = defaultdict(list)
    words, out = words_of(text), []
    for s, start, score in _passages(words, index, threshold):
        hits[index.item_of[s]].append((start, score))
    if not hits:
        return []
    for k, places in sorted(hits.items()):
        item, item_text = index.items[k]
        question, answer = question_and_answer(item_text)
        room = len(question) + len(answer)
        best = (-1.0, -1.0, 0.0, 0.0)
        for start in sorted({p[0] for p in places}):
            near = words[max(0, start - room) : start + 2 * SEGMENT + room]
            q, a = overlap(question, near), overlap(answer, near)
            best = max(best, (max(min(q, a), overlap(question + answer, near)), min(q, a), q, a))
        if best[0] >= least:
            out.append((item, max(score for _, score in places), *best[2:]))
    return out


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of at most ``SHARD_ITEMS`` items each; term statistics are of all items."""
    items = (benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
             .filter("item_id is not null and text is not null"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column("text").to_pylist():
                for segment in segments_of(text):
                    sizes.append(len(segment))
                    bags.append(sorted(set(segment)))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(bags, pa.list_(pa.binary()))], names=["size", "terms"])

    cuts = items.mapInArrow(cut, "size long, terms array<binary>")
    n_segments, mean_size = cuts.agg(F.count(F.lit(1)), F.avg("size")).head()
    if not n_segments:
        return
    df = cuts.select(F.explode("terms").alias("term")).groupBy("term").count()
    shards = max(1, -(-items.count() // (SHARD_ITEMS // 2)))
    for shard in range(shards):
        held = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        own = sorted((r["item_id"], r["text"]) for r in held.collect())
        terms = df.join(held.mapInArrow(cut, "size long, terms array<binary>").select(F.explode("terms").alias("term")).distinct(), "term")
        counts = {bytes(r["term"]): r["count"] for r in terms.collect()}
        if own:
            yield Index.build(own, counts, n_segments, mean_size)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                  least: float = OVERLAP) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: the test items that a text holds.

    A row means that a passage of the text reaches ``threshold`` of a segment's own BM25 score
    and that at least ``least`` of the five-word shingles of the item's question and of its
    answer (its last sentence; shorter parts count as one shingle), or of the item as a whole,
    stand around the passage. Case and punctuation do not matter. An item without words is never found; null texts, null ids of
    items and empty tables find nothing. A null document id stays null, and repeated rows of
    documents or items each count. Other columns are not read.

    Items are indexed in shards of a bounded number of items, and texts are read once per shard:
    a benchmark of a few thousand items is one pass without a shuffle.
    """
    docs = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def scan(index: Index) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for block in blocks(batch.column("text")):
                    for i in range(block.size):
                        rows += [(block.first + i, *x) for x in leaks_in(block.text(i).decode(), held.value, threshold, least)]
                at, *rest = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int64()),
                     *(pa.array(x, pa.float64()) for x in rest[1:])],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(run, schema)

    found = None
    for index in _indexes(benchmark, item_col, item_text_col):
        part = scan(index)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all their columns."""
    reach_workers(docs.sparkSession)
    for index in _indexes(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(text_col)
                keep = [not leaks_in(b.text(i).decode(), held.value, threshold, least) for b in blocks(texts) for i in range(b.size)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
