"""The transducer against tiktoken, and its decoder by exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from graticule.llm import bpe_transducer as bpe
from graticule.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, LONG, empty, table

PATH, SF = public_tokenizers.path("byte_bpe_50k.tiktoken"), "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def odd_texts(ranks):
    rng = random.Random(1)
    pool = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    newer = [chr(c) for c in (0x558, 0x58B, 0x88F, 0xC5C, 0x11DE0, 0x11DE5, 0x208F)]
    tokens = [t.decode("utf-8", "ignore") for t in ranks]
    for k in range(6000):
        n = rng.randint(0, 60)
        yield ("".join(rng.choice(["abcdefgh ' \n", "aA01 .-=_\t\n\r'sdlt", "aaab"][k % 3]) for _ in range(n)) if k % 6 < 3 else
               "".join(rng.choice(pool) for _ in range(n)) if k % 6 == 3 else
               "".join(rng.choice([*newer, "a", "1", " ", "!"]) for _ in range(n)) + rng.choice("-=ab *Ã\xc2 ") * rng.randint(1, 400) if k % 6 == 4 else
               "".join(rng.choice(tokens) for _ in range(3)))


def test_transducer_equals_library(ranks, library):
    machine, splitter = bpe.Transducer(ranks), bpe.Splitter(public_tokenizers.PATTERN)
    for text in odd_texts(ranks):
        assert ids(b"".join(machine.encode(p.encode()) for p in splitter.split(text))) == library.encode_ordinary(text), text
    waiting = max(len(way) for state in machine.held for _, _, way in state)
    assert waiting <= max(map(len, ranks)), "no more tokens wait than the longest one has bytes"


def test_states_begin_anew(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_MOVES", 50)
    monkeypatch.setattr(bpe, "MOST_NEIGHBOURS", 50)
    machine = bpe.Transducer(ranks)
    for text in ("unbelievable", "zyxwvut" * 30, " quick"):
        assert ids(machine.encode(text.encode())) == library._encode_single_piece(text)


def test_small_vocabularies():
    """Made-up tables of merges over two letters, some of which no merging reaches."""
    rng = random.Random(4)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(rng.randint(1, 14)):
            parts = [t for t in ranks if set(t) <= set(b"ab")]
            ranks.setdefault(rng.choice(parts) + rng.choice(parts), len(ranks))
        library = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        machine = bpe.Transducer(ranks)
        for _ in range(100):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 24)))
            try:
                got = ids(machine.encode(text.encode()))
            except ValueError as stopped:
                assert "order of their merges" in str(stopped)
                break
            assert got == library.encode_ordinary(text), (ranks, text)


def test_ranks_without_single_bytes():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Transducer({b"a": 0})


def test_utf8_machine_equals_library():
    rng = random.Random(6)
    for _ in range(5000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0x9F, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0]) for _ in range(rng.randint(0, 9)))
        stream, cut = bpe.Utf8Stream(), rng.randint(0, len(data))
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.finish() == data.decode("utf-8", "replace")


def test_characters_wait_for_their_bytes():
    stream = bpe.Utf8Stream()
    assert [stream.feed(bytes([b])) for b in "é\U0001f600x".encode()] == ["", "é", "", "", "", "\U0001f600", "x"]


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_level_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark, library):
    rows = [*AWKWARD, (7, " " * 1_200_000 + "x", "en"), (8, "y" * 50_000, "en"), (9, "\x1c   \u0085 a\r\n\r\n b", "en")]
    got = bpe.decode(bpe.encode(table(spark, rows), PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    for r in got:
        assert bytes(r.decoded).decode() == r.text and (r.doc_id == 7 or ids(bytes(r.ids)) == library.encode_ordinary(r.text))
    assert LONG in {r.text for r in got}
    assert bpe.encode(empty(spark), PATH).count() == 0


def test_decoding_ids_that_are_no_text(spark):
    lead = np.array([0xF0 - 0xF0], dtype="<u4")
    ranks = bpe.read_ranks(PATH)
    cut = np.array([ranks[b"\xe2"], ranks[b"a"]], dtype="<u4")
    frame = spark.createDataFrame([(1, bytearray(cut.tobytes())), (2, None), (3, bytearray(lead.tobytes()))], "doc_id long, ids binary")
    got = {r.doc_id: (bytes(r.decoded), r.text) for r in bpe.decode(frame, PATH).collect()}
    assert got[1] == (b"\xe2a", "�a") and got[2] == (b"", "") and got[3][1] == "!"
    beyond = spark.createDataFrame([(1, bytearray(np.array([50_256], dtype="<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(beyond, PATH).collect()
