"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed words and of word shapes (length, capitals, marks, symbols,
repetition). Logarithms of the counts, weighted by inverse document frequency, are projected by a
truncated SVD that is fitted on a bounded sample of labelled texts. The sample's vectors are
broadcast; every document is compared with all of them by exact cosine products in blocks, and
its nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.tables import id_and_text
from graticule.llm.textblocks import Block, blocks

#: The largest number of labelled texts that are learnt from, and seen as neighbours.
SAMPLE = 4096
NEIGHBOURS, LATENT = 25, 48
#: Dimensions of word hashes and of shapes before the projection.
WORD_DIMS, SHAPE_DIMS = 512, 8 * 3 * 2 * 2 * 2 * 3
DIMS = WORD_DIMS + SHAPE_DIMS
#: Score of a text that has no neighbour (no words), and of all where no label is known.
UNKNOWN = 0.5
_LENGTHS = np.searchsorted([2, 3, 4, 6, 8, 11, 16], np.arange(17), side="right")
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LOWER = np.zeros(256, dtype=np.int64)
_LOWER[ord("a") : ord("z") + 1] = 1
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>@{}[]\\^~=_+")] = 1
_LOUD = np.zeros(256, dtype=np.int64)
_LOUD[list(b"!?")] = 1


def counts(block: Block) -> np.ndarray:
    """Features of each text: a row of ``DIMS`` counts."""
    start, end, text = block.words
    if not len(start):
        return np.zeros((block.size, DIMS))

    def inside(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[block.data])))
        return total[end] - total[start]

    upper, lower = inside(_UPPER), inside(_LOWER)
    capitals = np.where((upper > 1) & (lower == 0), 2, np.minimum(upper, 1))
    last = block.data[end - 1]
    mark = np.where(last == ord("."), 1, np.where(last == ord(","), 2, 0))
    again = np.zeros(len(start), dtype=np.int64)
    again[1:] = (block.hashes[1:] == block.hashes[:-1]) & (text[1:] == text[:-1])
    shape = _LENGTHS[np.minimum(end - start, 16)]
    for size, part in ((3, capitals), (2, np.minimum(inside(_SYMBOL), 1)), (2, np.minimum(inside(_LOUD), 1)), (2, again), (3, mark)):
        shape = shape * size + part
    word = (block.hashes % np.uint64(WORD_DIMS)).astype(np.int64)
    at = np.concatenate((text * DIMS + word, text * DIMS + WORD_DIMS + shape))
    return np.bincount(at, minlength=block.size * DIMS).reshape(block.size, DIMS).astype(float)


@dataclass
class Neighbours:
    """The fitted projection, and unit vectors and labels of the sample."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray) -> Neighbours:
        idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1
        weighted = cls._weighted(rows, idf)
        _, vectors = np.linalg.eigh(weighted.T @ weighted)
        projection = vectors[:, -LATENT:]
        return cls(idf, projection, cls._unit(weighted @ projection).astype(np.float32), labels.astype(np.float32))

    @staticmethod
    def _weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
        out = np.log1p(rows) * idf
        for part in (slice(0, WORD_DIMS), slice(WORD_DIMS, DIMS)):
            out[:, part] = Neighbours._unit(out[:, part])
        return out

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Label shares among the nearest of the sample, weighted by similarity."""
        latent = self._unit(self._weighted(rows, self.idf) @ self.projection).astype(np.float32)
        near = latent @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        chosen = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, chosen, axis=1), 0) ** 2
        total = weight.sum(axis=1)
        return np.where((total > 0) & (rows.sum(axis=1) > 0), (weight * self.labels[chosen]).sum(axis=1) / np.maximum(total, 1e-12), UNKNOWN).astype(float)


def held_out(id_col: Column) -> Column:
    """True for ids whose labels are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Neighbours | None:
    """Learn from at most ``sample`` labelled texts, the ones with the least hash of their id."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id")).limit(sample))
    chosen = {r["doc_id"]: r["label"] for r in known.collect()}
    if not chosen:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                for i, row in enumerate(counts(block)):
                    at = np.flatnonzero(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(block.first + i, 1), pa.array([at.tolist()], pa.list_(pa.int32())),
                         pa.array([row[at].tolist()], pa.list_(pa.float64()))], names=["doc_id", "at", "n"])

    # Repeated ids could make more rows than the sample; the first in hash order are taken.
    rows = (id_and_text(docs, id_col, text_col).join(wanted, "doc_id", "left_semi")
            .mapInArrow(run, "doc_id long, at array<int>, n array<double>")
            .orderBy(F.xxhash64("doc_id"), F.xxhash64("at", "n")).limit(sample).collect())
    if not rows:
        return None
    table = np.zeros((len(rows), DIMS))
    for i, r in enumerate(rows):
        table[i, r["at"]] = r["n"]
    return Neighbours.fit(table, np.array([chosen[r["doc_id"]] for r in rows]))


def score(docs: DataFrame, model: Neighbours | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each row, in one pass without a shuffle.

    The score is 0 to 1, higher for texts likelier to have label 1. Texts without words (empty
    or null), and all texts without a model, score 0.5. Only the text is read for the score.
    Ids may be null or repeat; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = scores_of(block, held.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.size), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def scores_of(block: Block, model: Neighbours | None) -> np.ndarray:
    return np.full(block.size, UNKNOWN) if model is None else model.scores(counts(block))
