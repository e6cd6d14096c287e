"""Token counts and packing against the tokenizer libraries on whole texts."""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from graticule.llm import packing, segments, token_counts
from tests.llm.helpers import AWKWARD, empty, table

SF = "/root/testdata/sf0.001/documents.parquet"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> a <|endoftext|>b", "a  b", " lead", "trail ", "a\n\nb \n c", "don't we're 'tis", "日本語 テキスト a", "é́ ñ á b",
       "\t\tx y", "a\x1c b", "x\u0085 y", "▁ a▁ ▁b x ▁y", "<s> </s> <unk>", "x" * 5000, "a " * 5000, "word, word. Word\nword",
       "　ｗｉｄｅ   hard", "\U0001f600 \U0001f601‍\U0001f602", "a\0b \0 c"]


def rows(spark):
    real = [(r.doc_id + 1000, r.text, r.lang) for r in spark.read.parquet(SF).collect()]
    return [*AWKWARD, *((i, t, "en") for i, t in enumerate(ODD, 100)), *real]


@pytest.fixture(scope="module")
def pieces_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def bpe_library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(BPE)


@pytest.mark.parametrize("path", [PIECES, BPE, public_tokenizers.path("word_bpe_49k.json")])
def test_counts_are_those_of_the_library(spark, pieces_library, path):
    import tokenizers

    held = rows(spark)
    if path == PIECES:
        count = lambda t: len(pieces_library.encode(t))
    else:
        own = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(table(spark, held), path, limit=300).collect()
    wanted = Counter((i, len((t or "").encode()), n := count(t or ""), n > 300) for i, t, _ in held)
    assert Counter(map(tuple, got)) == wanted
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_memory_generations():
    calls = []
    memory = segments.Memory(lambda batch: calls.extend(batch) or [len(s) for s in batch])
    for step in range(6):
        wanted = {"often", *(f"{step}-{i}" for i in range(segments.REMEMBERED // 2))}
        memory.learn(wanted)
        assert all(memory[s] == len(s) for s in wanted)
        memory.trim()
    assert calls.count("often") == 1 and len(memory) + len(memory.older) <= 3 * segments.REMEMBERED


def check_packing(found, texts, library, capacity):
    """Every id in its place once, no gaps, nothing too long."""
    pieces, room = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        assert all(r.length == capacity for r in mine[1:]) and sum(r.length for r in mine) == len(ids)
        for r, start in zip(mine, np.cumsum([0, *(r.length for r in mine)]), strict=False):
            assert r.start == start and r.ids_crc32 == zlib.crc32(ids[start : start + r.length].tobytes())
    for placed in room.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(room), sum(r.length for r in found)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_is_whole_and_tight(spark, bpe_library, capacity):
    held = {i: (i, t, lang) for i, t, lang in rows(spark) if i not in (None, 3)}
    found = packing.pack(table(spark, held.values()), BPE, capacity=capacity).collect()
    sequences, total = check_packing(found, {i: r[1] for i, r in held.items()}, bpe_library, capacity)
    assert sequences <= 1.01 * total / capacity + 2
    assert packing.pack(empty(spark), BPE).count() == 0


def test_repeated_rows_are_packed_each(spark):
    held = [(None, "same", "en")] * 2 + [(3, "twice the same row", "fr")] * 5
    found = packing.pack(table(spark, held), BPE).collect()
    places = {(r.sequence_id, r.offset) for r in found}
    assert len(found) == len(places) == 7


@pytest.mark.parametrize("seed", range(8))
def test_histograms_of_any_shape(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([32, 500, 2048]))
    lengths = rng.integers(1, capacity + 1, size=rng.integers(1, 4000)) if seed % 2 else rng.choice([capacity, capacity // 2 + 1, 1], size=777)
    histogram = np.bincount(lengths, minlength=capacity + 1)
    used = np.zeros(capacity + 1, dtype=np.int64)
    packed = packing.pack_histogram(histogram, capacity)
    for group, repeats in packed:
        assert sum(group) <= capacity and repeats > 0
        np.add.at(used, list(group), repeats)
    assert (used == histogram).all()
    large = int((lengths > capacity // 2).sum())
    bound = max(large, -(-int(lengths.sum()) // capacity))
    assert sum(k for _, k in packed) <= 1.02 * bound + 2


def test_least_squares_fit_reaches_an_exact_mixture():
    columns = [(60, 40), (50, 50), (70, 30), (100,)]
    wanted = np.array([30, 12, 0, 5])
    histogram = np.zeros(101)
    for p, k in zip(columns, wanted, strict=True):
        for length in p:
            histogram[length] += k
    assert np.allclose(packing.fit_repeats(columns, histogram), wanted, atol=0.01)


def test_other_vocabularies_use_the_library():
    plan = json.loads(open(BPE).read())
    assert packing._byte_ranks(plan) is not None
    assert packing._byte_ranks({**plan, "normalizer": {"type": "Lowercase"}}) is None
    assert packing._byte_ranks(json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())) is None


def test_very_long_white_space_is_packed(spark, bpe_library):
    texts = {1: "a" + " " * 2_000_000 + "b", 2: "\n" * 1_100_000, 3: "an ordinary text"}
    found = packing.pack(table(spark, [(i, t, "en") for i, t in texts.items()]), BPE).collect()
    check_packing(found, texts, bpe_library, 2048)
