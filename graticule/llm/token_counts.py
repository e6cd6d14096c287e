"""Token counts of whole texts: batched encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from graticule.llm.segments import Memory, segments, slices
from graticule.llm.tables import id_and_text

#: Counts above this are marked as over the limit.
TOKEN_LIMIT = 4096


@lru_cache(maxsize=4)
def _counter(model_path: str) -> tuple[Memory, Memory]:
    """Counts of segments that follow a space, and of those that begin a text."""
    if model_path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        inner = range(pieces.get_piece_size())
        if any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in inner):
            raise ValueError(f"{model_path} has pieces that reach over a space; texts cannot be split there")

        def count(batch: list[str]) -> list[int]:
            # The model itself puts a space before what it encodes.
            return [len(ids) for ids in pieces.encode(batch, num_threads=1)]

        memory = Memory(count)
        return memory, memory

    import tokenizers

    own = tokenizers.Tokenizer.from_file(model_path)

    def count_after_space(batch: list[str]) -> list[int]:
        return [len(e.ids) for e in own.encode_batch([" " + s for s in batch], add_special_tokens=False)]

    def count_at_start(batch: list[str]) -> list[int]:
        return [len(e.ids) for e in own.encode_batch(batch, add_special_tokens=False)]

    return Memory(count_after_space), Memory(count_at_start)


def _counts(texts: pa.Array, model_path: str) -> Iterator[tuple[int, int]]:
    later, first = _counter(model_path)
    for _, held in slices(texts):
        parts = [segments(t) for t in held]
        later.learn(set().union(*[p[1:] for p in parts]))
        first.learn({p[0] for p in parts if p})
        for text, p in zip(held, parts, strict=True):
            n = first[p[0]] + sum(map(later.__getitem__, p[1:])) if p else 0
            yield len(text.encode()), n
        later.trim()
        first.trim()


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, in one pass without a shuffle.

    ``model_path`` is a sentencepiece ``.model`` or a tokenizers ``.json``. Counts are those of
    the library for the whole text, without begin, end or added special tokens; strings of
    special tokens inside a text are handled as the library does by default. A null text counts
    as empty (0 tokens), a null id stays null, repeated rows are counted each by itself, and an
    empty table gives an empty one. Other columns are not read.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_counts(batch.column("text"), model_path))
            n = [x[1] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(count, schema)
