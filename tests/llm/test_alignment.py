"""Token alignment against a plain version that encodes whole texts and compares all tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from graticule.llm import alignment
from graticule.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, empty, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(ids, pieces):
    at, out = 0, []
    for i, p in zip(ids, pieces, strict=True):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def plain(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    a, b = libraries
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))]
    byte_of = {c: ord(c) for c in letters} | {chr(0x100 + n): c for n, c in enumerate(c for c in range(256) if chr(c) not in letters)}
    each = []
    for text in texts:
        data = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        of_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(of_a) != data or b"".join(of_b) != data:
            each.append(([], [], ""))
            continue
        own_a, own_b = spans(ids_a, of_a), spans(ids_b, of_b)
        links = [(x, y) for x, s, e in own_a for y, t, f in own_b if s < f and t < e]
        both = sorted({e for *_, e in own_a} & {e for *_, e in own_b})
        cuts = [(0 if k == 0 else both[k - 1], e) for k, e in enumerate(both)]
        groups = ";".join(",".join(str(x) for x, t, f in own_a if s <= t and f <= e) + "|" + ",".join(str(x) for x, t, f in own_b if s <= t and f <= e) for s, e in cuts)
        each.append((own_a, own_b, groups, links))
    count = Counter(p for x in each if len(x) == 4 for p in set(x[3]))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for x in each:
        if len(x) == 3:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((len(x[0]), len(x[1]), x[2].count(";") + 1, len(x[3]), sum(count[p] == top[p[0]] for p in x[3]), sum(count[p] for p in x[3]),
                        hashlib.sha256(x[2].encode()).hexdigest()))
    return out


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_equals_plain(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = [d for d in docs if len(d.text or "") < 3000]  # the plain version compares all tokens with all
    frame = spark.createDataFrame([(d.doc_id, d.text) for d in short], "doc_id long, text string")
    want = sorted(((d.doc_id, *x) for d, x in zip(short, plain([d.text for d in short], libraries), strict=True)), key=str)
    for block in (1, 20_000, alignment.BLOCK_CHARS):
        assert found(alignment.alignments(frame, A, B, block_chars=block)) == want
    assert QUERIES["op11_cross_tokenizer_alignment"](spark, SF).count() == len(docs)


def test_odd_texts(spark, libraries):
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "▁", "\xa0", "<s>", "<|endoftext|>", "\U0001f44d", "ﬁ", "1", "​", "\t", "\x00", "x y", "<0x41>", "Straße", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(500)] + [None, "", " ", "<unk>", "▁", "a ▁b", "a b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(texts, libraries)
    assert found(alignment.alignments(frame, A, B, block_chars=400)) == sorted(((i, *x) for i, x in enumerate(want)), key=str)
    assert sum(x[0] == 0 for x in want) > 20 and sum(x[0] > 0 for x in want) > 100


def test_groups_and_links(spark):
    rows = alignment.groups(table(spark, [(1, "internationalisation of cats", "en"), (2, None, "en")]), A, B).orderBy("doc_id").collect()
    assert len(rows[0].groups.split(";")) == rows[0].n_groups and len(rows[0].links) == rows[0].n_a + rows[0].n_b - rows[0].n_groups
    assert rows[0].groups.split(";")[0].split("|")[0].split(",")[0] == str(rows[0].links[0] >> 32)
    assert (rows[1].n_a, rows[1].groups, rows[1].links) == (0, "", [])


def test_awkward_rows(spark, libraries):
    got = found(alignment.alignments(table(spark, AWKWARD), A, B))
    texts = [t for _, t, _ in AWKWARD]
    long = [i for i, t in enumerate(texts) if t and len(t) > 5000]
    assert len(got) == len(AWKWARD) and [r[0] for r in got].count(None) == 1
    for i in long:  # too long for the plain version; its digest has a group for each common end
        texts[i] = "word"
    want = {AWKWARD[i][0]: x for i, x in enumerate(plain(texts, libraries)) if i not in long}
    for r in got:
        if r[0] != 5:
            assert (r[1:5], r[7]) == (want[r[0]][:4], want[r[0]][6])
    assert alignment.alignments(empty(spark), A, B).count() == 0


def test_plane_order_round_trip():
    import numpy as np

    values = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert alignment._of_planes(alignment._planes(values)).tolist() == values.tolist()
