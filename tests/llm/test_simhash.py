import random

import brute
import pytest
from gridloom.llm import grouped, simhash
from gridloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, f0 long, component_id string"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 400))] for _ in range(60)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "ONE two three"), (1006, "x " * 30000)]
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        for j in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((100 + 5 * i + j, "  ".join(v).upper()))
    rows.append(rows[10])  # a row repeated whole
    return rows


@pytest.mark.parametrize(("hot", "block"), [(simhash.HOT, simhash.BLOCK), (3, 2)])
def test_groups_as_by_comparing_every_pair(spark, monkeypatch, hot, block):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(grouped, "ANCHORS", 1)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0, "clash") for d, t in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id, r.f0 & (2**64 - 1), r.component_id) for r in simhash.near_duplicate_groups(spark, df, words=4, radius=4).collect())
    prints = [brute.fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], prints, brute.groups([d for d, _ in rows], prints), strict=True))
    assert got == want


def test_pivots_never_discard_a_link():
    import numpy as np

    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**64, (200, 1), dtype=np.uint64)
    g = f ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in f], np.uint64)[:, None]
    assert np.abs(simhash.pivot_table(f) - simhash.pivot_table(g)).max() <= 4


def test_masks_lose_no_pair():
    for n in (10, 10**6, 10**9):
        masks = simhash.exact_masks(n, 4)
        rng = random.Random(n)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_near_stage_agrees_with_shingle_similarity(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark, df, words=5, similarity=0.8).collect()}
    sets = {d: brute.shingles(t, 5) for d, t in rows}
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if brute.jaccard(sets[a], sets[b]) >= 0.85]
    assert near and sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    by = {}
    for d, c in got.items():
        by.setdefault(c, []).append(d)
    for members in by.values():  # each member has a neighbour that is similar
        for d in members:
            assert len(members) == 1 or max(brute.jaccard(sets[d], sets[o]) for o in members if o != d) >= 0.7


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(spark, df, words=4, radius=4).collect() == []
    assert simhash.near_duplicate_groups(spark, df).collect() == []


def set_groups(sets, similarity):
    """The first set that links reach, by comparing every pair."""
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if brute.jaccard(a, sets[j]) >= similarity:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_similar_groups_as_by_comparing_every_pair():
    import numpy as np

    for seed in range(30):
        rng = random.Random(seed)
        sets = [set()]
        for _ in range(12):
            base = [rng.randrange(400) for _ in range(rng.randint(1, 40))]
            for _ in range(rng.randint(1, 6)):
                sets.append({x if rng.random() > 0.08 else rng.randrange(400) for x in base})
        rng.shuffle(sets)
        sets = [set(x) for x in dict.fromkeys(map(frozenset, sets))]
        got = simhash.similar_groups([np.array(sorted(x), np.uint64) for x in sets], 0.8)
        assert got.tolist() == set_groups(sets, 0.8)


def test_near_pairs_at_the_threshold(spark):
    """Pairs of a similarity from 0.8 to 0.83 are linked, those from 0.74 to 0.79 are not; of one word that is repeated, one shingle counts."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(240):
        w = [f"a{rng.randrange(10**9)}" for _ in range(rng.choice((24, 104, 404)))]
        lo, hi = (0.8, 0.83) if i % 2 else (0.74, 0.79)
        a = brute.shingles(" ".join(w), 5)
        for k in range(1, len(w)):
            v = w[:-k] + [f"b{rng.randrange(10**9)}" for _ in range(k)]
            if lo <= brute.jaccard(a, brute.shingles(" ".join(v), 5)) < hi:
                break
        else:
            continue
        want[i] = i % 2
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    line = "same " * 3000
    rows += [(10000 + i, line + " ".join(f"c{rng.randrange(10**9)}" for _ in range(60))) for i in range(2)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=0.8).collect()}
    assert got[10001] == 10001
    linked = {i: got[2 * i + 1] == 2 * i for i in want}
    assert not any(linked[i] for i in want if not want[i])
    near = [linked[i] for i in want if want[i]]
    assert len(near) > 60 and sum(near) >= 0.97 * len(near)
    print("recall", sum(near), len(near))


@pytest.mark.parametrize("anchors", [1, 64])
def test_blocks_lose_no_link(spark, monkeypatch, anchors):
    """Chains of numbers, cut into blocks of ten: every chain comes out whole, and alone."""
    monkeypatch.setattr(grouped, "ANCHORS", anchors)

    def near(columns):
        x = columns[0].to_pylist()
        root = list(range(len(x)))
        for i in range(len(x)):
            for j in range(i):
                if abs(x[i] - x[j]) <= 3:
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
        import numpy as np

        return np.array(root)

    chains = {0: range(0, 300, 3), 1: range(1000, 1040, 2), 2: range(2000, 2090, 3), 3: range(3000, 3004)}
    members = [(7, x, 1) for c in (0, 1, 2) for x in chains[c]] + [(8, x, 1) for x in chains[3]] + [(9, 5000, 1)]
    df = spark.createDataFrame(members, "g long, id long, w long").repartition(3)
    work = Scratch(spark, "test")
    links = grouped.group_links(spark, df, lambda x: x.withColumn("x", x.id), near, 10, work, "t")
    roots = {r.v: r.root for r in grouped.connected_components(spark, links, work, "all").collect()}
    assert roots == {x: c[0] for c in chains.values() for x in c}


def test_recall_of_near_pairs_in_documents(spark):
    """Of all pairs of documents of a similarity of 0.8 or more, compared one by one, at least 95 of 100 are linked, also of those below 0.85; no group joins what links do not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark, docs).collect()}
    pairs = list(brute.near_pairs(texts))
    for top in (0.85, 1.01):
        own = [got[a] == got[b] for a, b, j in pairs if j < top]
        assert sum(own) >= 0.95 * len(own), (top, sum(own), len(own))
    want = brute.near_groups(texts)
    assert all(want[i] == want[g] for i, g in got.items())
    print("recall", [(top, sum(got[a] == got[b] for a, b, j in pairs if j < top), sum(j < top for *_, j in pairs)) for top in (0.85, 1.01)])
