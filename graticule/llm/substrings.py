"""Removal of passages that also occur in an earlier document, by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one text. The steps:

1. Each window has an anchor, the ``GRAM``-word run of least hash inside it. Equal windows have
   equal anchors, and neighbours mostly share theirs, so a text has one anchor for some five
   words. Anchors of two or more documents are kept.
2. Windows with such an anchor are hashed whole; for those of two or more documents the place
   in an earlier one is kept.
3. Those places are gathered into phrases: stretches of ``STEP`` window starts of the
   earlier document. Each document gets the phrases that its confirmed windows lie in.
4. Documents are streamed in blocks of bounded size. A block compiles Aho-Corasick automata
   of the phrases that its documents need, one for each share of bounded size, finds every
   occurrence of their parts, and verifies words before and after. Only real equal words are removed.

No step holds more than a block of texts and its phrases; what two documents share is found by
grouping, so neither a pass per phrase nor a table of all phrases is needed anywhere.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.tables import drop_stored, id_and_text, stored
from graticule.llm.textblocks import Block, blocks, mix, runs

WINDOW, GRAM, STEP = 13, 5, 64
#: Words per automaton part: any window holds a whole one at a multiple of it.
PART = (WINDOW + 1) // 2
#: Bytes of texts of a block of step 4, and of the phrases of one automaton (one phrase at the least).
#: An automaton takes some 50 times the bytes of its phrases.
COVER_BYTES, SHARD_BYTES = 1 << 18, 1 << 18


def _windows(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word number of each window's start, and its anchor."""
    text = block.words[2]
    if len(text) < WINDOW:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    least, width, wanted = runs(block.hashes, GRAM), 1, WINDOW - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    start = np.flatnonzero(text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :])
    return start, least[start]


def _anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, anchor`` of every window, neighbours with one anchor once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text")):
                start, anchor = _windows(block)
                text = block.words[2][start]
                new = np.ones(len(start), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text[new] + block.first)), pa.array(anchor[new].view(np.int64))],
                    names=["doc_id", "anchor"])

    return docs.mapInArrow(run, "doc_id long, anchor long")


def _candidates(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``doc_id, anchor, win, at, source, piece`` of the windows whose anchor is shared.

    Of equal windows of one batch only the one of the smallest document goes on; for the others
    that one is an earlier occurrence already, so they come out with its ``source`` and ``piece``
    (and with a key of their own). A very frequent window is a few rows therefore.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("anchors"), batch.column("doc_id").to_numpy()
            rows: list[tuple[np.ndarray, ...]] = []
            for block in blocks(batch.column("text")):
                start, anchor = _windows(block)
                text, whole = block.words[2][start], runs(block.hashes, WINDOW)
                for i in range(block.size):
                    lo, hi = np.searchsorted(text, [i, i + 1])
                    known = np.asarray(lists[block.first + i].values, dtype=np.int64).view(np.uint64)
                    at = lo + np.flatnonzero(np.isin(anchor[lo:hi], known))
                    rows.append((np.full(len(at), ids[block.first + i]), anchor[at].view(np.int64), whole[start[at]].view(np.int64), start[at] - block.bounds[i]))
            if not rows:
                continue
            doc, anchor, win, at = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((at, doc, anchor, win))
            doc, anchor, win, at = doc[order], anchor[order], win[order], at[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (win[1:] != win[:-1]) | (anchor[1:] != anchor[:-1])
            least = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = doc > doc[least]
            local = np.unique(np.stack((doc[later], doc[least[later]], at[least[later]] // STEP), axis=1), axis=0)
            n, m = int(new.sum()), len(local)
            spread = mix(local[:, 0].astype(np.uint64) ^ mix(local[:, 1].astype(np.uint64)) ^ local[:, 2].astype(np.uint64)).view(np.int64)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((doc[new], local[:, 0]))), pa.array(np.concatenate((anchor[new], spread))),
                 pa.array(np.concatenate((win[new], spread))), pa.array(np.concatenate((at[new], np.zeros(m, np.int64))).astype(np.int32)),
                 pa.concat_arrays([none, pa.array(local[:, 1])]), pa.concat_arrays([none, pa.array(local[:, 2])]).cast(pa.int32())],
                names=["doc_id", "anchor", "win", "at", "source", "piece"])

    return docs.join(shared, "doc_id").select("doc_id", "text", "anchors").mapInArrow(
        run, "doc_id long, anchor long, win long, at int, source long, piece int")


def _needs(windows: DataFrame) -> DataFrame:
    """``doc_id, source, piece``: a stretch of an earlier document for each repeated window."""
    order = Window.partitionBy("anchor", "win").orderBy("doc_id", "at")
    placed = windows.select("doc_id", "source", "piece", F.first("doc_id").over(order).alias("first_doc"),
                            F.floor(F.first("at").over(order) / STEP).cast("int").alias("first_piece"))
    return (placed.filter("source is not null or first_doc < doc_id")
            .select("doc_id", F.coalesce("source", "first_doc").alias("source"),
                    F.when(F.col("source").isNotNull(), F.col("piece")).otherwise(F.col("first_piece")).alias("piece")).distinct())


def _phrases(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, piece, phrase``: the words of each wanted stretch, joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, piece, phrase = [], [], []
            for i, (doc, text, wanted_pieces) in enumerate(zip(*batch.columns, strict=True)):
                words = text.as_py().encode().split()
                for p in wanted_pieces.as_py():
                    held = words[p * STEP : (p + 1) * STEP + WINDOW - 1]
                    if len(held) >= WINDOW:
                        source.append(doc.as_py())
                        piece.append(p)
                        phrase.append(b" ".join(held).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(source, pa.int64()), pa.array(piece, pa.int32()), pa.array(phrase, pa.string())],
                names=["source", "piece", "phrase"])

    lists = wanted.select("source", "piece").distinct().groupBy("source").agg(F.collect_set("piece").alias("pieces"))
    return docs.join(lists, docs["doc_id"] == lists["source"]).select("doc_id", "text", "pieces").mapInArrow(
        run, "source long, piece int, phrase string")


class Shard:
    """The automaton of some phrases; each phrase comes with the id of the document it is from."""

    def __init__(self, phrases: set[tuple[int, str]]):
        self.numbers: defaultdict[bytes, int] = defaultdict(lambda: len(self.numbers))
        self.phrases = []
        parts: defaultdict[str, list[tuple[int, int]]] = defaultdict(list)
        for source, phrase in sorted(phrases):
            words = phrase.encode().split()
            for q in range(0, len(words) - PART + 1, PART):
                parts[f" {b' '.join(words[q : q + PART]).decode('latin-1')} "].append((len(self.phrases), q))
            self.phrases.append((source, np.array([self.numbers[w] for w in words])))
        self.automaton = ahocorasick.Automaton()
        for part, places in parts.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()

    def covered(self, words: list[bytes], doc: int, out: bytearray | None = None) -> bytearray:
        """1 for each word inside an occurrence of a window of an earlier document; added to ``out``."""
        out = bytearray(len(words)) if out is None else out
        if len(words) < WINDOW or not self.phrases:
            return out
        number = np.array([self.numbers.get(w, -1) for w in words])
        text = f" {b' '.join(words).decode('latin-1')} "
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        seen: set[tuple[int, int]] = set()
        for end, (length, places) in self.automaton.iter(text):
            p = int(np.searchsorted(begin, end - length + 1))
            lo, hi = max(0, p + PART - WINDOW), min(len(words), p + WINDOW)
            if out.find(0, lo, hi) < 0:
                continue
            for k, q in places:
                source, phrase = self.phrases[k]
                if source >= doc or (k, p - q) in seen:
                    continue
                seen.add((k, p - q))
                shift = p - q
                lo, hi = max(0, shift), min(len(words), shift + len(phrase))
                same = number[lo:hi] == phrase[lo - shift : hi - shift]
                ends = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
                for a, b in ends.reshape(-1, 2).tolist():
                    if b - a >= WINDOW:
                        out[lo + a : lo + b] = b"\1" * (b - a)
        return out


def _shares(phrases: set[tuple[int, str]]) -> Iterator[set[tuple[int, str]]]:
    """The phrases in shares of at most ``SHARD_BYTES``; each window lies whole in one phrase."""
    share: set[tuple[int, str]] = set()
    held = 0
    for phrase in sorted(phrases, key=lambda x: x[1]):
        if share and held + len(phrase[1]) > SHARD_BYTES:
            yield share
            share, held = set(), 0
        share.add(phrase)
        held += len(phrase[1])
    if share:
        yield share


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` from documents with their phrases."""
    for batch in batches:
        ids, lists = batch.column("doc_id"), batch.column("phrases")
        for block in blocks(batch.column("text"), COVER_BYTES):
            held = [(i, ids[block.first + i].as_py()) for i in range(block.size) if lists[block.first + i].is_valid]
            wanted = {(x["source"], x["phrase"]) for i, _ in held for x in lists[block.first + i].as_py()}
            words = {i: block.text(i).split() for i, _ in held}
            covers = {i: bytearray(len(words[i])) for i, _ in held}
            for share in _shares(wanted):
                shard = Shard(share)
                for i, doc in held:
                    shard.covered(words[i], doc, covers[i])
            n, gone, kept = [], [], []
            for i in range(block.size):
                left = words.pop(i) if i in covers else block.text(i).split()
                n.append(len(left))
                if i in covers:
                    left = [w for w, c in zip(left, covers[i], strict=True) if not c]
                gone.append(n[-1] - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.size), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` of each row.

    Words (runs of other than ASCII white space, unchanged) that lie in a window whose word
    sequence also starts in a document with a smaller id are removed; ``kept`` has the others
    joined by one space. Windows are judged on the input. A null text has no words, a text of
    fewer than 13 keeps them all. Rows with the same id are one document's: they never remove
    from each other. A row with a null id keeps all words and removes none. An empty table
    gives an empty one. Other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    named = docs.filter("doc_id is not null")
    anchors = stored(_anchors(named), "anchors")
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    shared = stored(anchors.join(several.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "shared")
    drop_stored(anchors)
    needs = stored(_needs(_candidates(named, shared)), "needs")
    phrases = _phrases(named, needs)
    lists = (needs.join(phrases, ["source", "piece"]).groupBy("doc_id")
             .agg(F.collect_list(F.struct("source", "phrase")).alias("phrases")))
    return docs.join(lists, "doc_id", "left").select("doc_id", "text", "phrases").mapInArrow(
        _without_repeats, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
