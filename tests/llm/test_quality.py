"""Quality rules, the neighbour classifier, contamination and URL rules."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graticule.llm import decontaminate, quality_knn, quality_rules, url_rules
from graticule.llm.textblocks import blocks
from tests.llm.helpers import AWKWARD, LONG, empty, table

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules -----------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_base_columns_equal_brute_force(spark):
    lines = "one line\n\n \none line\none  line\nother | <b> ünï &&\n" * 3
    rows = [*AWKWARD, (20, lines, "en"), (21, "\n\n\n", "en"), (22, "a b c a b c d", "en"), (23, "x x x x", "fr")]
    rows += [(r.doc_id + 1000, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = quality_rules.quality_rules(table(spark, rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got.collect()) == Counter((i, *plain_base(t)) for i, t, _ in rows)
    assert not any(r.kept and r.base_failed for r in got.collect())
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_verdicts_against_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    counts = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert counts[1, True] > 200 and counts.get((1, False), 0) <= 1 and counts.get((0, True), 0) <= 1 and counts[0, False] > 10


def test_distance_is_jensen_shannon():
    p, q = np.array([[4.0, 0, 0], [1, 1, 2], [0, 0, 0]]), np.array([[0, 2.0, 0], [1, 1, 2], [1, 0, 0]])
    assert np.allclose(quality_rules.js_distance(p, q), [1, 0, 1])
    a, b = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (a + b) / 2
    want = np.sqrt((sum(a * np.log2(a / m)) + sum(b * np.log2(b / m))) / 2)
    assert np.allclose(quality_rules.js_distance(a[None] * 7, b[None] * 3), want)


# -- classifier --------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_knn.fit(docs, labels)
    assert len(model.labels) <= quality_knn.SAMPLE
    scored = quality_knn.score(docs, model).withColumn("held_out", quality_knn.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_only_texts_and_learnt_labels_count(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_knn.fit(docs, labels, sample=64)
    turned = labels.withColumn("quality", F.when(quality_knn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality_knn.fit(docs.withColumn("lang", F.lit("zz")), turned, sample=64)
    assert len(model.labels) == 64 and np.allclose(model.labels, other.labels) and np.allclose(np.abs(model.vectors), np.abs(other.vectors), atol=1e-3)
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality_knn.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())


def test_awkward_texts_and_no_labels(spark):
    docs = table(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_knn.fit(docs, none) is None
    assert {r.score for r in quality_knn.score(docs, None).collect()} == {0.5}
    model = quality_knn.fit(docs, spark.createDataFrame([(3, 1), (3, 1), (5, 0), (6, None), (77, 1), (None, 0)], "doc_id long, quality int"))
    got = quality_knn.score(docs, model).collect()
    assert len(got) == len(AWKWARD) and all(r.score == 0.5 for r in got if r.doc_id in (1, 2, 4))
    assert quality_knn.score(empty(spark), model).count() == 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(4)
    rows, labels = rng.poisson(0.2, size=(300, quality_knn.DIMS)).astype(float), rng.integers(0, 2, 300).astype(float)
    model = quality_knn.Neighbours.fit(rows, labels)
    asked = rng.poisson(0.2, size=(20, quality_knn.DIMS)).astype(float)
    latent = model._unit(model._weighted(asked, model.idf) @ model.projection)
    for got, v in zip(model.scores(asked), latent, strict=True):
        near = model.vectors @ v
        best = np.argsort(-near)[: quality_knn.NEIGHBOURS]
        weight = np.maximum(near[best], 0) ** 2
        assert got == pytest.approx((weight * labels[best]).sum() / weight.sum(), abs=1e-4)


# -- contamination -----------------------------------------------------------------------------


def benchmark_items(rng, n=30):
    words = [f"term{i}" for i in range(900)] + ["the", "of", "and"] * 40
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 45))).capitalize() + ". "
             + " ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) + ".") for i in range(n)]


def plain_bm25(passage, segment, segments):
    n, mean = len(segments), sum(map(len, segments)) / len(segments)
    df = Counter(t for s in segments for t in set(s))
    bag = Counter(segment)
    norm = 1.2 * (1 - 0.75 + 0.75 * len(segment) / mean)
    weight = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + norm) for t, f in bag.items()}
    return sum(weight[t] for t in set(passage) & set(bag)) / sum(weight.values())


def test_all_passages_above_the_threshold_are_found():
    rng = random.Random(6)
    items = benchmark_items(rng)
    segments = [s for _, t in items for s in decontaminate.segments_of(t)]
    df = Counter(t for s in segments for t in set(s))
    index = decontaminate.Index.build(items, df, len(segments), sum(map(len, segments)) / len(segments))
    text = []
    for _ in range(40):
        s = rng.choice(segments)
        part = [w for w in s if rng.random() < rng.choice([0.3, 0.7, 1])]
        rng.shuffle(part)
        text += part + [b"filler%d" % rng.randint(0, 99) for _ in range(rng.randint(0, 30))]
    size = decontaminate.SEGMENT
    for threshold in (0.3, 0.6):
        got = {(s, start): score for s, start, score in decontaminate._passages(text, index, threshold)}
        want = {}
        for start in range(0, len(text), size):
            for k, s in enumerate(segments):
                score = plain_bm25(text[start : start + 2 * size], s, segments)
                if score >= threshold:
                    want[k, start] = score
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    items = benchmark_items(rng)
    filler = lambda n: " ".join(f"plain{rng.randint(0, 500)}" for _ in range(n))
    rows, want = list(AWKWARD), set()
    for i in range(60):
        item, text = rng.choice(items)
        kind = i % 4
        held = [text, text.upper().replace(". ", " --- "), " ".join(text.split()[: len(text.split()) // 2]), ""][kind]
        rows.append((100 + i, f"{filler(rng.randint(0, 90))} {held} {filler(rng.randint(0, 90))}", "en"))
        if kind < 2:
            want.add((100 + i, item))
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (None, "no id here")], "item_id long, text string")
    docs = table(spark, rows)
    got = decontaminate.decontaminate(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _, _ in rows if i not in {d for d, _ in want})
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_shards_find_what_one_index_finds(spark, monkeypatch):
    rng = random.Random(3)
    items = benchmark_items(rng)
    docs = table(spark, [(i, f"{LONG} {t} tail", "en") for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.decontaminate(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 16)
    parts = Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.decontaminate(docs, bench).collect())
    assert whole == parts and len(whole) == len(items)


def test_edited_copies_and_copies_without_the_last_sentence_are_leaks(spark):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    filler = lambda n: [b"plain%d" % rng.randint(0, 500) for _ in range(n)]
    rows, want = [], set()
    for item, text in items:
        whole = decontaminate.words_of(text)
        at = rng.randrange(len(whole))
        for held in (whole[:at] + [b"edited"] + whole[at + 1 :], decontaminate.question_and_answer(text)[0]):
            rows.append((len(rows), b" ".join(filler(rng.randint(0, 90)) + held + filler(rng.randint(0, 90))).decode(), "en"))
            if decontaminate.overlap(whole, held) >= 0.8:
                want.add((len(rows) - 1, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap) for r in decontaminate.decontaminate(table(spark, rows), bench).collect()}
    assert want <= set(got) and len(want) > 150 and any(min(got[x]) < 0.8 for x in want)
    assert not {i for i, _ in want} & {r.doc_id for r in decontaminate.clean(table(spark, rows), bench).collect()}


# -- urls --------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max((r.name for r in fits), key=len, default=None)


def test_listed_rules_equal_brute_force(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net/", "https://net/x",
            "https://mynet/x", "https://x.org/fr/", "https://x.org/fr", "https://example.com/de/1", "https://notexample.com/de/1", "ftp://a.b.example.com/de/?q",
            "https://ÄÖ.Net/ü", "https://u:p@h.net:80/en/", "https://example.net/en/", "https://example.net?x=/en/", "a://b://c.net/d", "https://x.com#frag/de/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "https://x.net/a"), (3, "https://x.net/a"), (3, "https://x.net/a")]
    rows += [(r.page_id + 100, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "'x' as rule")
    got = url_rules.judge(pages).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *plain_url(u)) for i, u in rows)
    verdict = {r.name: r.verdict for r in url_rules.RULES}
    assert all(r.verdict == verdict[r.rule] and r.mined is None for r in got if r.rule)
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules(spark):
    rng = random.Random(1)
    urls, labels = [], []
    for i in range(400):
        spam = i % 4 == 0
        url = f"https://{'promo' if spam else rng.choice(['blog', 'www'])}.s{i % 7}.example.com/{'buy' if spam else 'read'}/{i}?{'aff' if spam else 'page'}=1"
        urls.append(url)
        labels.append((url, "block" if spam else "allow", f"list{i % 3}"))
    labels += [(f"https://only.example.com/odd/{i}", "block", "list9") for i in range(60)]
    frame = spark.createDataFrame(labels, "url string, label string, source string")
    asked = [(1, "https://promo.new.example.com/buy/7?aff=2"), (2, "https://blog.new.example.com/read/7"), (3, "https://only.new.example.com/odd/1"), (4, "https://a.b/c")]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(asked, "page_id long, url string"), rules=(), labels=frame).collect()}
    assert got[1].verdict == "block" and got[1].mined and got[2].verdict == "allow"
    assert got[3].verdict == "block" and got[3].mined
    strict = url_rules.judge(spark.createDataFrame(asked, "page_id long, url string"), rules=(), labels=frame, min_sources=2)
    assert {r.page_id: r.verdict for r in strict.collect()}[3] == "allow", "one list's word alone is not evidence if two are asked for"
    assert got[4].verdict == "allow" and got[4].mined is None


def test_mined_rules_equal_enumeration(spark):
    """All token sets of a small table, tested one by one."""
    rng = random.Random(12)
    rows = [(sorted({f"path={rng.choice('abcd')}", f"host={rng.choice('xyz')}", f"key={rng.choice('pq')}"}), rng.choice(["allow", "block", "block"]), f"s{rng.randint(0, 2)}") for _ in range(60)]
    rows += [(["host=x", "path=2024"], "block", "s0")] * 8
    wanted = {}
    for size in (1, 2, 3):
        for part in {c for tokens, _, _ in rows for c in combinations(sorted(tokens), size)}:
            fits = [label for tokens, label, _ in rows if set(part) <= set(tokens)]
            for label in ("allow", "block"):
                n = fits.count(label)
                if n / len(rows) >= 0.03 and n / len(fits) >= 0.7:
                    wanted[part, label] = n / len(fits)
    lean = {k: c for k, c in wanted.items() if not any(label == k[1] and set(part) < set(k[0]) and d >= c - 1e-12 for (part, label), d in wanted.items())}
    frame = spark.createDataFrame(rows, "tokens array<string>, label string, source string")
    got = {(tuple(r.antecedent), r.label): r.confidence for r in url_rules.mine(frame, min_support=0.03, min_confidence=0.7).collect()}
    assert set(got) == set(lean) and len(lean) > 3 and (("path=2024",), "block") in got
    assert all(abs(got[k] - c) < 1e-9 for k, c in lean.items())


# -- blocks ------------------------------------------------------------------------------------


def test_blocks_hold_whole_texts_and_words():
    rng = random.Random(9)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab é\t\n\x0b \u00a0\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for limit in (1, 50, 10_000):
        rows = 0
        for block in blocks(pa.array(texts, pa.string()).slice(7), limit):
            start, end, text = block.words
            for i in range(block.size):
                own = (texts[7 + block.first + i] or "").encode()
                assert block.text(i) == own
                words = [block.data[a:b].tobytes() for a, b, t in zip(start, end, text, strict=True) if t == i]
                assert words == own.split() and block.bounds[i + 1] - block.bounds[i] == len(words)
            same = {}
            for a, b, h in zip(start, end, block.hashes, strict=True):
                assert same.setdefault(block.data[a:b].tobytes(), h) == h
            assert len(set(same.values())) == len(same)
            rows += block.size
        assert rows == len(texts) - 7
