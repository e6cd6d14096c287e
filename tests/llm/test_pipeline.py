"""The pipeline's stages against plain versions of what each decides."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from graticule.llm import near_copies, quality_knn
from graticule.llm.tables import stored
from tests.llm.helpers import AWKWARD, empty, table
from tests.llm.test_duplicates import roots

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_names(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "simhash_near_dedup", "decontamination", "personal_data", "best_fit_packing"]
    assert all(s.dtypes == steps[0].dtypes for s in steps[:-1])
    assert cp.ORACLE_SQL is None


def test_quality_stage_keeps_clean_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, before = rows(steps[1]), rows(steps[0])
    assert all(kept[i] == before[i] for i in kept)
    model = quality_knn.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in quality_knn.score(steps[0], model).collect()}
    assert set(kept) == {i for i, p in scored.items() if p == 1}
    assert sum(i not in kept for i, q in labels.items() if q == 1) <= 3
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 3


def similar_pairs(texts, least=0.8):
    """All pairs of different five-word sets of the given similarity, by common shingles."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().decode().split()) else set() for t in texts]
    places = {}
    for i, s in enumerate(sets):
        for x in s:
            places.setdefault(x, []).append(i)
    common = Counter((a, b) for held in places.values() for k, b in enumerate(held) for a in held[:k])
    return [(a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= least]


def test_dedup_stage_keeps_one_of_each_group(steps):
    before, kept = rows(steps[1]), rows(steps[2])
    ids = sorted(before)
    near = similar_pairs([before[i] for i in ids]) + [(a, a) for a in range(len(ids))]
    least = {}
    for i, r in zip(ids, roots(len(ids), near), strict=True):
        least[r] = min(i, least.get(r, i))
    assert kept == {i: before[i] for i in least.values()} and len(kept) < len(before)


def test_near_copies_recall_by_band(spark):
    """Pairs of each band of similarity that the stage brings together; texts of one pair are like no others."""
    rng = random.Random(8)
    texts, bands = [], {}
    while len(texts) < 1600:
        words = [f"w{rng.randint(0, 9000)}" for _ in range(rng.randint(40, 400))]
        copy = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 25))):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
        alike = jaccard(" ".join(words), " ".join(copy))
        if 0.8 <= alike < 1:
            bands.setdefault(int(alike * 20) / 20, []).append(len(texts) // 2)
            texts += [" ".join(words), " ".join(copy)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in near_copies.one_of_each(frame).collect()}
    found = {band: sum(2 * k + 1 not in kept for k in pairs) / len(pairs) for band, pairs in bands.items()}
    assert set(range(0, len(texts), 2)) <= kept and min(map(len, bands.values())) > 50
    assert found[0.8] >= 0.9 and all(share >= 0.98 for band, share in found.items() if band > 0.8), found


def test_near_copies_large_group_and_chains(spark):
    """A group that is alike in chains only, beside one in which all are alike: no link is lost, none is made."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    chain = []
    for step in range(40):  # each step changes three words for good; only neighbours are alike
        base = list(base)
        for j in range(3):
            base[(step * 15 + 5 * j) % 200] = f"c{step}_{j}"
        chain.append(" ".join(base))
    star = [f"s{i}" for i in range(150)]
    group = [" ".join(w if i != k else f"x{k}" for i, w in enumerate(star)) for k in range(120)]
    texts = [*chain, *group, *(" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(100)) for _ in range(30))]
    near = similar_pairs(texts)
    least = {}
    for i, r in enumerate(roots(len(texts), near)):
        least.setdefault(r, i)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in near_copies.one_of_each(frame).collect()} == set(least.values())
    assert len(set(least.values())) == 32


def test_near_copies_awkward_rows(spark):
    got = near_copies.one_of_each(table(spark, [*AWKWARD, (9, "", None), (0, "Twice THE same row", "xx")])).collect()
    assert Counter(r.doc_id for r in got) == {0: 1, 1: 1, None: 1, 5: 1, 6: 1} and "blob" in got[0].asDict()
    assert near_copies.one_of_each(empty(spark)).count() == 0


def test_candidates_lose_no_pair_within_the_radius(spark):
    rng = random.Random(10)
    sets = [np.unique(np.array([rng.randint(0, 2**63) for _ in range(60)], dtype=np.uint64))]
    for _ in range(150):
        own = sets[rng.randrange(len(sets))].copy()
        own[rng.randrange(len(own))] = rng.randint(0, 2**63)
        sets.append(np.unique(own))
    prints, sketches = [near_copies.print_of(s) for s in sets], [near_copies.sketch_of(s) for s in sets]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(i, signed(p), len(s), i, *map(int, k)) for i, (p, s, k) in enumerate(zip(prints, sets, sketches, strict=True))],
                                  ", ".join(f"{c} long" for c in ("node", "print", "size", "root", *(f"s{i}" for i in range(near_copies.SKETCH_WORDS)))))
    apart = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(sketches[a].view(np.uint64), sketches[b].view(np.uint64), strict=True))
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
            if (prints[a] ^ prints[b]).bit_count() <= 15 and apart(a, b) <= near_copies.most_differing(0.8) and min(len(sets[a]), len(sets[b])) / max(len(sets[a]), len(sets[b])) >= 0.8}
    got = [tuple(sorted(r)) for r in near_copies.candidates(nodes).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)
    some = {tuple(sorted(r)) for r in near_copies.candidates(nodes, centres=1).collect()}
    assert some and some <= want


def test_decontamination_stage(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, kept = rows(steps[2]), rows(steps[3])
    held = {i for i, t in before.items() if any(x in t for x in items)}
    assert held and not held & set(kept) and all(kept[i] == before[i] for i in kept)
    assert len(set(before) - held - set(kept)) <= 1


def test_personal_data_stage(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    changed = {i for i in before if before[i] != after[i]}
    assert changed and all("<" in after[i] for i in changed)
    assert all("@" not in t for t in after.values())
    assert sum("@" in t for t in before.values()) <= len(changed)


def test_packing_stage_places_every_document(steps):
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in steps[4].select("doc_id").collect()}
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.01 * sum(fill.values()) / 2048 + 2


def test_awkward_documents_go_through(spark, tmp_path):
    extra = [(i, t, lang, "s", 1) for i, t, lang in AWKWARD]
    frame = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    # Null, empty and white-space texts are one group; the repeated row is one document.
    assert Counter(r.doc_id for r in got if r.piece == 0) == {1: 1, None: 1, 3: 1, 5: 1, 6: 1}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "An item. Its answer.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_dedup_stage_removes_planted_near_copies(spark):
    rng = random.Random(5)
    texts, wanted = {}, set()
    for i in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        copy = list(base)
        least = rng.uniform(0.8, 0.95)
        while True:
            more = list(copy)
            more[rng.randrange(len(more))] = f"edit{rng.randint(0, 10**6)}"
            if jaccard(" ".join(base), " ".join(more)) < least:
                break
            copy = more
        far = [w if rng.random() > 0.06 else f"far{rng.randint(0, 10**6)}" for w in base]
        texts |= {10 * i: " ".join(base), 10 * i + 1: " ".join(copy).upper(), 10 * i + 2: " ".join(far)}
        wanted |= {10 * i} | ({10 * i + 2} if max(jaccard(texts[10 * i + 2], texts[10 * i + k]) for k in (0, 1)) < 0.8 else set())
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows(cp.near_duplicates(spark, frame, SF)) == {i: texts[i] for i in wanted} and len(wanted) > 100
