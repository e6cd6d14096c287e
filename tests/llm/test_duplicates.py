"""SimHash groups, repeated passages and components against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import xxhash

from graticule.llm import components, simhash, substrings
from tests.llm.helpers import AWKWARD, LONG, empty, table

SF = "/root/testdata/sf0.001/documents.parquet"


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def variants(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 400))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_groups_equal_brute_force(spark):
    rows = [*AWKWARD, *((i, t, "en") for i, t in enumerate(variants(3), 100))]
    rows += [(r.doc_id + 1000, r.text, r.lang) for r in spark.read.parquet(SF).collect()]
    prints = [plain_print(t) for _, t, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(rows), near)
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    wanted = Counter((i, f"{p:016x}", least.get(r)) for (i, _, _), p, r in zip(rows, prints, root, strict=True))
    assert len(near) > 20
    assert Counter(map(tuple, simhash.near_duplicates(table(spark, rows)).collect())) == wanted
    assert simhash.near_duplicates(empty(spark)).count() == 0
    docs = table(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(Counter(r.doc_id for r in kept.collect()).items(), key=str) == sorted(
        Counter(least.get(r) for r in set(root)).items(), key=str)


@pytest.mark.parametrize(("radius", "segments"), [(4, 3), (4, 2), (3, 4), (4, 4), (0, 2), (5, 3), (2, 8)])
def test_segment_plan_loses_no_link(radius, segments):
    plan = simhash.segment_plan(radius, segments)
    assert all(0 <= ball for _, _, ball in plan)
    rng = random.Random(radius * 10 + segments)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any(((a ^ b) >> shift & ((1 << width) - 1)).bit_count() <= ball for shift, width, ball in plan)


def test_links_are_exact(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(60):
        a = rng.getrandbits(64)
        for _ in range(4):
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                b ^= 1 << bit
            prints.add(b - (1 << 64) if b >> 63 else b)
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    got = {(r.a, r.b) for r in simhash.links(frame).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 4}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 180)] + [(300, 200), (200, 250), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{k: 100 for k in range(101, 180)}, 250: 200, 300: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows):
    first, out = {}, Counter()
    words = [(t or "").encode().split() for _, t, _ in rows]
    for (doc, _, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 12 if doc is not None else 0):
            key = tuple(w[i : i + 13])
            first[key] = min(doc, first.get(key, doc))
    for (doc, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 12 if doc is not None else 0):
            if first[tuple(w[i : i + 13])] < doc:
                gone |= set(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[(doc, len(w), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(60)] + ["the", "of", "é", "the,"]
    shared = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 40, 90, 400)] + [["ha"] * 30]
    rows = []
    for doc in rng.sample(range(500), 40):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 30))]
            part = rng.choice(shared)
            a = rng.randint(0, len(part) // 2)
            text += part[a : rng.randint(a, len(part))]
        rows.append((doc, rng.choice([" ", "\n", "  "]).join(text), "en"))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_removal_equals_brute_force(spark, seed):
    rows = [(None if i is None else i + 600, t, lang) for i, t, lang in AWKWARD] + passages(seed)
    rows += [(900, LONG, "en"), (901, "ha " * 40, "en"), (902, "ha " * 40, "en"), (None, LONG, "en")]
    got = Counter(map(tuple, substrings.remove_repeats(table(spark, rows)).collect()))
    assert got == plain_removal(rows)


def test_removal_of_nothing(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0
    rows = [(1, "all different words here", "en"), (2, None, "en")]
    assert {r.n_removed for r in substrings.remove_repeats(table(spark, rows)).collect()} == {0}


def test_removal_with_more_phrases_than_one_automaton_holds(monkeypatch):
    """A text's phrases may be many times the text; no automaton takes more than its share."""
    rng = random.Random(5)
    sources = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(76)) for _ in range(200)]
    text = " ".join(s.rsplit(" ", 1 + i % 60)[0] for i, s in enumerate(sources))
    asked, shard = [], substrings.Shard
    monkeypatch.setattr(substrings, "SHARD_BYTES", 1 << 13)
    monkeypatch.setattr(substrings, "Shard", lambda phrases: asked.append(sum(len(p) for _, p in phrases)) or shard(phrases))
    phrases = [{"source": i, "phrase": s} for i, s in enumerate(sources)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([500, 501]), pa.array([text, "new " + sources[3]]),
         pa.array([phrases, None], pa.list_(pa.struct([("source", pa.int64()), ("phrase", pa.string())])))],
        names=["doc_id", "text", "phrases"])
    got = [r for out in substrings._without_repeats(iter([batch])) for r in out.to_pylist()]
    assert [(r["doc_id"], r["n_words"] - r["n_removed"]) for r in got] == [(500, 0), (501, 77)]
    assert len(asked) > 10 and max(asked) <= 1 << 13
