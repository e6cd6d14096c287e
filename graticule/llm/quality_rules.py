"""Quality rules by distribution divergence from language references.

Each text's histograms of character classes and of its language's common words are compared with
the reference of that language by Jensen-Shannon distance. Common words and references come from
all documents of the corpus. Texts too short for a stable histogram are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.tables import reach_workers, stored
from graticule.llm.textblocks import IS_SPACE, Block, blocks, mix, runs

#: Base rules: fewest words, and percent of words in repeated three-word windows.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Common words of a reference, and the share of all words a language needs to have its own.
COMMON, LEAST_SHARE = 48, 0.01
#: Largest distances kept (0 the same, 1 nothing in common), and the lengths they need.
CHAR_DISTANCE, WORD_DISTANCE = 0.30, 0.45
LEAST_CHARS, LEAST_COMMON_WORDS = 200, 50
#: Languages below the share, and null, are compared with the reference of the whole corpus.
POOLED = ""

SYMBOLS = b"#*$%&|<>"
#: Character classes: lower, upper, digit, white space, sentence marks, loud marks, symbols,
#: other ASCII, beyond ASCII. Bytes inside a UTF-8 sequence have no class.
CLASSES = 9
_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[IS_SPACE] = 3
_CLASS[list(b".,;:")] = 4
_CLASS[list(b"!?")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = CLASSES


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """The base columns of each text of a block."""
    start, end, text = block.words
    bytes_of = block.data
    inner = np.concatenate(([0], np.cumsum((bytes_of & 0xC0) == 0x80)))
    n_words = np.diff(block.bounds)
    word_chars = block.per_text((end - start) - (inner[end] - inner[start]))
    is_symbol = np.concatenate(([0], np.cumsum(np.isin(bytes_of, np.frombuffer(SYMBOLS, np.uint8)))))
    n_symbols = np.diff(is_symbol[block.offsets])
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
            "n_dup_lines": _dup_lines(block), "n_repeat_words": _repeat_words(block)}


def _keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))


def _repeat_words(block: Block) -> np.ndarray:
    text = block.words[2]
    covered = np.zeros(len(text), dtype=np.int64)
    if len(text) >= 3:
        at = np.flatnonzero(text[:-2] == text[2:])
        _, which, count = np.unique(_keyed(runs(block.hashes, 3)[at], text[at]), return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        for j in range(3):
            covered[twice + j] = 1
    return block.per_text(covered)


def _dup_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text; lines by word hashes and bytes."""
    out = np.zeros(block.size, dtype=np.int64)
    for i in range(block.size):
        held = block.text(i)
        if b"\n" in held:
            lines = [line for line in held.split(b"\n") if line.strip()]
            out[i] = len(lines) - len(set(lines))
    return out


def class_counts(block: Block) -> np.ndarray:
    """Characters of each class, a row per text."""
    text = np.repeat(np.arange(block.size), np.diff(block.offsets))
    both = np.bincount(text * (CLASSES + 1) + _CLASS[block.data], minlength=block.size * (CLASSES + 1))
    return both.reshape(block.size, CLASSES + 1)[:, :CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of rows of counts; an empty row is at distance 1."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    out = np.sqrt(np.clip(terms.sum(axis=1) / 2, 0, 1))
    return np.where((p.sum(axis=1) == 0) | (q.sum(axis=1) == 0), 1.0, out)


def _common_words(docs: DataFrame) -> dict[str, list[str]]:
    """The most frequent words of each language with enough of the corpus, and of all of it.

    At most ``1 / LEAST_SHARE`` languages can have the share, so the result is bounded.
    """
    words = docs.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    counts = stored(words.groupBy("lang", "word").count(), "words")
    sizes = counts.groupBy("lang").agg(F.sum("count").alias("n"))
    total = sizes.agg(F.sum("n")).head()[0] or 0
    large = [r["lang"] for r in sizes.filter(F.col("n") >= LEAST_SHARE * total).filter(F.col("lang") != POOLED).collect()]
    pooled = counts.groupBy("word").agg(F.sum("count").alias("count")).select(F.lit(POOLED).alias("lang"), "word", "count")
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    found: dict[str, list[str]] = {POOLED: []}
    for frame in (counts.filter(F.col("lang").isin(large)) if large else None, pooled.orderBy(F.desc("count"), "word").limit(COMMON)):
        if frame is None:
            continue
        top = frame.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= COMMON)
        for r in top.collect():
            found.setdefault(r["lang"], []).append(r["word"])
    return {lang: sorted(listed) for lang, listed in found.items()}


_FEATURES = ("doc_id long, ref string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, base_failed boolean, chars array<long>, words array<long>")


def _features(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    at = {lang: {w.encode(): i for i, w in enumerate(listed)} for lang, listed in common.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in blocks(batch.column("text")):
                base = base_counts(block)
                refs = [x if (x := langs[block.first + i]) in at else POOLED for i in range(block.size)]
                words = np.zeros((block.size, COMMON + 1), dtype=np.int64)
                for i, ref in enumerate(refs):
                    number = [n for n in map(at[ref].get, block.text(i).split()) if n is not None]
                    words[i, :COMMON] = np.bincount(number, minlength=COMMON) if number else 0
                    words[i, COMMON] = base["n_words"][i] - len(number)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.size), pa.array(refs, pa.string()),
                     *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                     pa.array(failed), pa.array(class_counts(block).tolist(), pa.list_(pa.int64())), pa.array(words.tolist(), pa.list_(pa.int64()))],
                    names=[x.split()[0] for x in _FEATURES.split(", ")])

    return docs.mapInArrow(run, _FEATURES)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  char_distance: float = CHAR_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """Base counts, distances and the verdict of each row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept``. A row is kept if the base rules pass and no distance
    that its length allows is above its limit. A null text has no words and fails the base; a
    null or rare language is compared with the whole corpus; ids may be null or repeat. If no
    text passes the base rules, there is no reference and none is kept. An empty table gives an
    empty one.
    """
    reach_workers(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit(POOLED)).alias("lang"))
    each = stored(_features(docs, _common_words(docs)), "features")

    def means(column: str, n: int) -> list:
        total = F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
        return [F.avg(F.col(column)[i] / total).alias(f"{column}{i}") for i in range(n)]

    sound = each.filter("not base_failed")
    sums = sound.groupBy("ref").agg(*means("chars", CLASSES), *means("words", COMMON + 1)).collect()
    references = {r["ref"]: (np.array(r[1 : CLASSES + 1], float), np.array(r[CLASSES + 1 :], float)) for r in sums}
    none = (np.zeros(CLASSES), np.zeros(COMMON + 1))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = [references.get(r, none) for r in batch.column("ref").to_pylist()]
            if not refs:
                continue
            near = []
            for k, column in enumerate(("chars", "words")):
                counts = np.array(batch.column(column).to_pylist(), dtype=float)
                near.append(js_distance(counts, np.array([r[k] for r in refs])))
            n_words = batch.column("n_words").to_numpy()
            far = (near[0] > char_distance) & (batch.column("word_chars").to_numpy() >= LEAST_CHARS)
            far |= (near[1] > word_distance) & (n_words >= LEAST_COMMON_WORDS)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *batch.columns[2:8], pa.array(near[0]), pa.array(near[1]), pa.array(~failed & ~far)],
                names=["doc_id", *batch.schema.names[2:8], "char_distance", "word_distance", "kept"])

    return each.mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                  "n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")
