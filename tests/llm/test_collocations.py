"""Phrase mining and its index against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from graticule.llm import collocations
from graticule.llm.fm_index import FmIndex, enumerate_runs
from tests.llm.helpers import AWKWARD, empty, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000, within=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = {}
    held = [(lang, g) for (lang, g), a in f.items() if 2 <= len(g) and a >= least]
    for lang, g in held:
        a = f[lang, g]
        if any(other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) and 100 * f[lang, h] >= within * a for other, h in held):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, rank, p.decode(), -a, le, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, le, r) in enumerate(sorted(rows)[:top], 1))


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def made_up(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "a", "the", "of", "é", "stock", "exchange", "x\x00y", "Ä", "zz"]
    phrases = ["new York Stock exchange", "of the", "a\tlot of", "é é é é é é é", "one two three four five six"]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize(("least", "longest", "within", "shard"), [(5, 5, 100, 1 << 20), (3, 5, 100, 300), (2, 3, 60, 1), (4, 2, 100, 2000), (6, 4, 40, 900)])
def test_equals_plain(spark, least, longest, within, shard):
    rows = made_up(least)
    want = plain(rows, least, longest, within=within)
    assert len(want) > 10
    assert found(collocations.collocations(table(spark, rows), least=least, longest=longest, within_percent=within, shard_bytes=shard)) == want


def test_top_and_ties(spark):
    rows = [(i, "b a. d c. f e. h g", "en") for i in range(4)]
    got = found(collocations.collocations(table(spark, rows), least=3, top=3))
    assert [(r[1], r[2]) for r in got] == [(1, "b a"), (2, "d c"), (3, "f e")]
    assert len(found(collocations.collocations(table(spark, rows), least=3, top=None))) == 4


def test_awkward_rows(spark):
    rows = [*AWKWARD, (9, None, None), (10, ".,;", None)]
    want = plain([r for r in rows], 2)
    assert found(collocations.collocations(table(spark, rows), least=2)) == want and want
    assert found(collocations.collocations(empty(spark))) == []
    assert found(collocations.collocations(table(spark, [(1, "", "en"), (2, ". \n", None)]), least=1)) == []


def test_large_products(spark):
    rows = [(1, "a b " * 3000, "en")]
    n = 10**15
    words, phrases, totals = collocations.phrase_counts(table(spark, rows), least=2000)
    assert totals.collect()[0].n == 6000 and sorted(r.f for r in words.collect()) == [3000, 3000]
    got = spark.sql(f"select (cast({n}L as decimal(17,0)) * cast(1000 * {n}L as decimal(20,0))) div (cast(1000000L as decimal(18,0)) * cast({n}L as decimal(18,0))) as s").first().s
    assert got == 1000 * n * n // (10**6 * n)


def test_index_against_counting():
    rng = random.Random(1)
    for _ in range(200):
        text = [rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(0, 60))]
        longest = rng.randint(2, 5)
        for size, runs in zip(range(2, longest + 1), enumerate_runs(np.array(text, dtype=np.int64), longest), strict=True):
            want = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1) if 0 not in text[i : i + size])
            assert dict(zip(map(tuple, runs.symbols.tolist()), runs.count.tolist(), strict=True)) == want


def test_extensions_of_both_sides():
    text = np.array([1, 2, 3, 0, 4, 2, 3, 1, 2, 5])
    index = FmIndex(text, 3)
    twos = index.longer(index.single(), "right")
    at = twos.symbols.tolist().index([2, 3])
    one = type(twos)(*(c[at : at + 1] for c in twos))
    assert index.longer(one, "left").symbols.tolist() == [[1, 2, 3], [4, 2, 3]]
    assert index.longer(one, "right").symbols.tolist() == [[2, 3, 1]]
