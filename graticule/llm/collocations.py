"""Phrases whose words occur together more than their parts do, counted exactly with an FM-index per shard.

A shard is some documents as numbers of its own words, with a break between pieces. Three passes
count phrases over all shards, each only what the one before leaves open: words; pairs of frequent
words, from the index over the shard with a break for every other word; longer phrases, from the
index over what frequent pairs leave. A phrase that occurs ``least`` times consists of phrases that
do, so nothing is lost. Phrases of all shards are summed in buckets of bounded size, to which a
shard sends its own sorted and packed, and each shard gets back only what it has itself; nothing
is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.fm_index import enumerate_runs
from graticule.llm.tables import reach_workers, stored
from graticule.llm.textblocks import mix

LEAST, LONGEST, TOP, WITHIN_PERCENT, NO_LANG = 100, 5, 2000, 100, "und"
#: Bytes of text in a shard; words of text for each bucket that phrases are summed in. Results do not depend on them.
SHARD_BYTES, BUCKET_WORDS, LEAST_BUCKETS = 12 << 20, 1_000_000, 64

_PARTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")
_SHARD_SCHEMA = "shard long, symbols binary, words binary, lang_of binary, counts binary, size int, raw int, langs array<string>, n array<long>"


class _Words(dict):
    """Numbers of words, given when first asked for."""

    def __init__(self, taken: list[bytes], lang_of: list[int], lang: int):
        super().__init__({b"": -1, b"\n": 0})
        self.taken, self.lang_of, self.lang = taken, lang_of, lang

    def __missing__(self, word: bytes) -> int:
        self.taken.append(word)
        self.lang_of.append(self.lang)
        self[word] = len(self.taken)
        return len(self.taken)


def _zipped(values: bytes | np.ndarray) -> bytes:
    return pa.compress(values if isinstance(values, bytes) else values.tobytes(), codec="zstd", asbytes=True)


class _Shard:
    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.taken: list[bytes] = []
        self.lang_of: list[int] = []
        self.words: dict[str, _Words] = {}
        self.texts: list[np.ndarray] = []

    def add(self, text: bytes, lang: str) -> None:
        """Words of each lang have their own numbers, so phrases of two langs never meet."""
        if lang not in self.words:
            self.words[lang] = _Words(self.taken, self.lang_of, len(self.words))
        parts = text.lower().translate(_PARTS).replace(b"\n", b" \n ").split(b" ")
        numbers = np.array(list(map(self.words[lang].__getitem__, parts)), dtype=np.int32)
        self.texts += [numbers[numbers >= 0], np.zeros(1, dtype=np.int32)]
        self.bytes += len(text)

    def row(self) -> pa.RecordBatch:
        symbols = np.concatenate(self.texts) if self.texts else np.zeros(0, dtype=np.int32)
        again = np.zeros(len(symbols), dtype=bool)
        again[1:] = (symbols[1:] == 0) & (symbols[:-1] == 0)
        symbols = symbols[~again]
        count = np.bincount(symbols, minlength=len(self.taken) + 1)[1:]
        lang_of = np.array(self.lang_of, dtype=np.int32)
        n = np.bincount(lang_of, weights=count, minlength=len(self.words)).astype(np.int64)
        words = b"\n".join(self.taken)
        columns = [[self.number], [_numbers(symbols)], [_zipped(words)], [_numbers(lang_of)], [_numbers(count)], [len(symbols)], [len(words)], [list(self.words)], [n.tolist()]]
        types = [pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
        names = _SHARD_SCHEMA.replace(",", "").split()[::2]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _numbers(values: np.ndarray) -> bytes:
    """32-bit numbers by byte, packed."""
    return _zipped(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T))


def _of_numbers(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def _shards(docs: DataFrame, lang_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """A row for each shard: its symbols, its words with their counts, and how many words of each lang it has."""
    reach_workers(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                        F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard(number)
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                shard.add(text.as_py().encode(), lang.as_py())
                if shard.bytes >= shard_bytes:
                    yield shard.row()
                    number += 1
                    shard = _Shard(number)
        if shard.bytes:
            yield shard.row()

    return texts.mapInArrow(run, _SHARD_SCHEMA)


_DEALT_SCHEMA = "bucket int, shard long, langs array<string>, size int, raw int, words binary, lang_of binary, own binary, counts binary"


def _dealt_words(shards: DataFrame, buckets: int) -> DataFrame:
    """The words of each shard by buckets that all shards share."""
    names = _DEALT_SCHEMA.replace(",", "").split()[::2]
    types = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                raw = pa.decompress(shard["words"], shard["raw"], codec="zstd", asbytes=True)
                words = raw.split(b"\n") if raw else []
                lang_of, counts = _of_numbers(shard["lang_of"], len(words)), _of_numbers(shard["counts"], len(words))
                starts = [zlib.crc32(lang.encode()) for lang in shard["langs"]]
                spread = np.fromiter((zlib.crc32(w, starts[k]) for w, k in zip(words, lang_of.tolist(), strict=True)), np.int64, len(words)) % buckets
                order = np.argsort(spread, kind="stable")
                edges = np.append(np.flatnonzero(np.diff(spread[order], prepend=-1)), len(order)).tolist()
                rows = []
                for i, j in pairwise(edges):
                    at = order[i:j]
                    text = b"\n".join([words[k] for k in at.tolist()])
                    rows.append((int(spread[at[0]]), shard["shard"], shard["langs"], len(at), len(text), _zipped(text), _numbers(lang_of[at]), _numbers(at + 1), _numbers(counts[at])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return shards.select("shard", "words", "raw", "lang_of", "counts", "langs").mapInArrow(run, _DEALT_SCHEMA)


_SUMMED_WORDS_SCHEMA = "id long, lang string, word string, f long, shard long, rows int, told binary"


def _summed_words(least: int):
    """The frequent words of a bucket with numbers of their own, and for each shard the numbers of those that it holds."""
    def run(held: pa.Table) -> pa.Table:
        rows, totals, each = held.to_pylist(), {}, []
        for r in rows:
            words = pa.decompress(r["words"], r["raw"], codec="zstd", asbytes=True).split(b"\n")
            keys = [(r["langs"][k], w) for k, w in zip(_of_numbers(r["lang_of"], r["size"]).tolist(), words, strict=True)]
            each.append(keys)
            for key, n in zip(keys, _of_numbers(r["counts"], r["size"]).tolist(), strict=True):
                totals[key] = totals.get(key, 0) + n
        # Sorted, so a bucket that is summed again gives the same numbers.
        often = sorted(key for key, n in totals.items() if n >= least)
        base = rows[0]["bucket"] << 32
        number = {key: base + i for i, key in enumerate(often)}
        replies = []
        for r, keys in zip(rows, each, strict=True):
            own = _of_numbers(r["own"], r["size"])
            known = np.array([number.get(key, -1) for key in keys], dtype=np.int64)
            if (known >= 0).any():
                own, known = own[known >= 0], known[known >= 0]
                order = np.argsort(known)
                replies.append((r["shard"], len(own), _packed([known[order], own[order]])))
        n, m = len(often), len(replies)
        shard, size, data = zip(*replies, strict=True) if replies else ((), (), ())
        none_n, none_m = [None] * n, [None] * m
        return pa.table({
            "id": pa.array([*(number[k] for k in often), *none_m], pa.int64()), "lang": pa.array([*(k[0] for k in often), *none_m], pa.string()),
            "word": pa.array([*(k[1].decode() for k in often), *none_m], pa.string()), "f": pa.array([*(totals[k] for k in often), *none_m], pa.int64()),
            "shard": pa.array([*none_n, *shard], pa.int64()), "rows": pa.array([*none_n, *size], pa.int32()), "told": pa.array([*none_n, *data], pa.binary())})

    return run


def _told(told: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of numbers that buckets have sent to a shard."""
    parts = [_unpacked(data, rows, 2) for rows, data in zip(told.column("rows").to_pylist(), told.column(column).to_pylist(), strict=True) if data is not None]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(p[0] for p in parts)]), np.concatenate([none, *(p[1] for p in parts)])


def _symbols(shard: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's frequent words by rising number, 1 and more, with one break for what stands between them; and their global numbers."""
    symbols = _of_numbers(shard.column("symbols")[0].as_py(), shard.column("size")[0].as_py())
    known, own = _told(told, "told")
    order = np.argsort(own)
    own, known = own[order], known[order]
    number = np.zeros(int(max(symbols.max(initial=0), own.max(initial=0))) + 1, dtype=np.int64)
    number[own] = np.arange(1, len(own) + 1)
    symbols = number[symbols]
    return symbols[(symbols > 0) | np.concatenate(([False], symbols[:-1] > 0))], np.concatenate(([0], known))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, each as steps from one row to the next, by byte and packed."""
    steps = np.concatenate([np.diff(c, prepend=0) for c in columns]).astype("<i8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, rows * columns * 8, codec="zstd", asbytes=True), dtype=np.uint8)
    steps = np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel().reshape(columns, rows)
    return list(np.cumsum(steps, axis=1))


_PACKED_SCHEMA = "shard long, bucket int, size int, rows int, data binary"


def _packed_rows(shard: int, words: np.ndarray, count: np.ndarray, buckets: int) -> list[tuple]:
    """A shard's phrases of one length, by buckets that all shards share, each sorted and packed."""
    size = words.shape[1]
    spread = mix(words[:, 0].astype(np.uint64) * np.uint64(31) + words[:, 1].astype(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((*words.T[::-1], spread))
    words, count, spread = words[order], count[order], spread[order]
    edges = np.append(np.flatnonzero(np.diff(spread, prepend=np.uint64(buckets))), len(spread))
    return [(shard, int(spread[i]), size, int(j - i), _packed([*words[i:j].T, count[i:j]])) for i, j in pairwise(edges.tolist())]


def _packed_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "bucket", "size", "rows", "data"), columns, types, strict=True)})


def _pairs(buckets: int):
    """Pairs of frequent words of a shard, by their global numbers."""
    def run(shard: pa.Table, told: pa.Table) -> pa.Table:
        if not shard.num_rows or not told.num_rows:
            return _packed_table([])
        symbols, known = _symbols(shard, told)
        runs = enumerate_runs(symbols, 2)[0]
        return _packed_table(_packed_rows(shard.column("shard")[0].as_py(), known[runs.symbols], runs.count, buckets))

    return run


def _longer(buckets: int, longest: int):
    """Phrases of three and more words of a shard, within what its frequent pairs join."""
    def run(shard: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if shard.num_rows and told.num_rows:
            symbols, known = _symbols(shard, told)
            back = np.argsort(known[1:])
            width = np.int64(len(known))
            w1, w2 = (back[np.searchsorted(known[1:], w, sorter=back)] + 1 for w in _told(told, "pairs"))
            frequent = w1 * width + w2
            joined = np.zeros(len(symbols), dtype=bool)
            joined[:-1] = np.isin(symbols[:-1] * width + symbols[1:], frequent)
            # Each word that a frequent pair holds, and a break where the next pair is not one.
            kept = joined | np.concatenate(([False], joined[:-1]))
            symbols, ends = symbols[kept], ~joined[kept]
            spaced = np.insert(symbols, np.flatnonzero(ends) + 1, 0)
            for runs in enumerate_runs(spaced, longest)[1:]:
                rows += _packed_rows(shard.column("shard")[0].as_py(), known[runs.symbols], runs.count, buckets)
        return _packed_table(rows)

    return run


def _summed(least: int, longest: int, reply: bool):
    """The frequent phrases of a bucket, and with ``reply`` for each shard those that it holds."""
    def run(held: pa.Table) -> pa.Table:
        ids, totals, replies = [], [], []
        for size in range(2, longest + 1):
            parts = held.filter(pc.equal(held.column("size"), size))
            if not parts.num_rows:
                continue
            counts = parts.column("rows").to_pylist()
            each = [_unpacked(d, r, size + 1) for r, d in zip(counts, parts.column("data").to_pylist(), strict=True)]
            columns = [np.concatenate([e[i] for e in each]) for i in range(size + 1)]
            order = np.lexsort(columns[:size][::-1])
            new = np.zeros(len(order), dtype=bool)
            for c in columns[:size]:
                new |= np.diff(c[order], prepend=c[order[0]] - 1) != 0
            f = np.add.reduceat(columns[size][order], np.flatnonzero(new))
            often = f >= least
            first = order[np.flatnonzero(new)][often]
            ids += np.stack([c[first] for c in columns[:size]], axis=1).tolist()
            totals += f[often].tolist()
            if reply:
                kept = np.zeros(len(order), dtype=bool)
                kept[order] = often[np.cumsum(new) - 1]
                for shard, (i, j) in zip(parts.column("shard").to_pylist(), pairwise([0, *accumulate(counts)]), strict=True):
                    own = np.flatnonzero(kept[i:j]) + i
                    if len(own):
                        replies.append((shard, len(own), _packed([c[own] for c in columns[:size]])))
        n, m = len(ids), len(replies)
        shard, rows, data = zip(*replies, strict=True) if replies else ((), (), ())
        return pa.table({"ids": pa.array([*ids, *[None] * m], pa.list_(pa.int64())), "f": pa.array([*totals, *[None] * m], pa.int64()),
                         "shard": pa.array([*[None] * n, *shard], pa.int64()), "rows": pa.array([*[None] * n, *rows], pa.int32()), "pairs": pa.array([*[None] * n, *data], pa.binary())})

    return run


_SUMMED_SCHEMA = "ids array<long>, f long, shard long, rows int, pairs binary"


def phrase_counts(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, lang_col: str = "lang",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words ``id, lang, word, f`` and phrases ``ids, f`` of 2 and more that occur ``least`` times, and all words ``lang, n``.

    Counts are of all contiguous occurrences within pieces, overlaps included.
    """
    shards = stored(_shards(docs, lang_col, text_col, shard_bytes), "shards")
    totals = stored(shards.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy("x.langs").agg(F.sum("x.n").alias("n")).withColumnRenamed("langs", "lang"), "word_totals")
    total = int(totals.agg(F.sum("n")).head()[0] or 0)
    buckets = max(LEAST_BUCKETS, total // BUCKET_WORDS)
    summed = stored(_dealt_words(shards, buckets).groupBy("bucket").applyInArrow(_summed_words(least), _SUMMED_WORDS_SCHEMA), "frequent_words")
    words = summed.filter("id is not null").select("id", "lang", "word", "f")
    told = summed.filter("told is not null").select(F.col("shard").alias("of_shard"), "rows", "told")
    symbols = shards.select("shard", "symbols", "size").groupBy("shard")
    pairs = symbols.cogroup(told.groupBy("of_shard")).applyInArrow(_pairs(buckets), _PACKED_SCHEMA)
    frequent = stored(pairs.groupBy("bucket").applyInArrow(_summed(least, 2, True), _SUMMED_SCHEMA), "frequent_pairs")
    told_pairs = frequent.filter("pairs is not null").select(F.col("shard").alias("of_shard"), "rows", "pairs")
    more = symbols.cogroup(told.unionByName(told_pairs, allowMissingColumns=True).groupBy("of_shard")).applyInArrow(_longer(buckets, longest), _PACKED_SCHEMA)
    phrases = frequent.filter("f is not null").select("ids", "f")
    if longest > 2:
        phrases = phrases.union(more.groupBy("bucket").applyInArrow(_summed(least, longest, False), _SUMMED_SCHEMA).select("ids", "f"))
    return words, stored(phrases, "frequent_phrases"), totals


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, within_percent: int = WITHIN_PERCENT,
                 shard_bytes: int = SHARD_BYTES, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each lang's first ``top`` phrases by score (all if None).

    Words are lower-cased (A-Z) and parted by space and tab, within pieces between ``.,;:!?`` and
    line ends. A phrase of 2 to ``longest`` words occurs ``a`` times, ``least`` or more; the cut of
    lowest floor(1000 * a * n / (l * r)), the first of equals, gives ``l``, ``r`` and the score;
    ``n`` counts the lang's words. A phrase that lies in a longer one of at least
    ``within_percent`` of its count is left out. Equal scores stand by falling ``a``, then by the
    phrase's bytes. A null text is empty, a null lang is ``und``, repeated rows count each, an
    empty table gives an empty one, and other columns are not read.
    """
    words, phrases, totals = phrase_counts(docs, least=least, longest=longest, shard_bytes=shard_bytes, lang_col=lang_col, text_col=text_col)
    known = words.select(F.array("id").alias("ids"), "f").union(phrases)
    size = F.size("ids")
    # A longer phrase has no more occurrences than each one word longer than this one inside it, so those decide.
    inner = phrases.filter(size > 2).select(F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"), "f")
    widest = inner.groupBy("ids").agg(F.max("f").alias("widest"))
    kept = phrases.join(widest, "ids", "left").filter(F.col("widest").isNull() | (100 * F.col("widest") < within_percent * F.col("f"))).select("ids", F.col("f").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("front"), F.slice("ids", F.col("k") + 1, size).alias("back"))
    parts = (cuts.join(known.select(F.col("ids").alias("front"), F.col("f").alias("l")), "front")
             .join(known.select(F.col("ids").alias("back"), F.col("f").alias("r")), "back")
             .join(words.select(F.col("id"), "lang"), F.col("ids")[0] == F.col("id")).join(totals, "lang"))
    # Products pass 64 bits.
    score = F.expr("(cast(a as decimal(17,0)) * cast(1000 * n as decimal(20,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = parts.withColumn("score", score)
    best = scored.groupBy("lang", "ids").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best"))
    texts = (best.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "word"), "id")
             .groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    rows = best.join(texts, "ids").select("lang", "phrase", "best.*")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    found = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
