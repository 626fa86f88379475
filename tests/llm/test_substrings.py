import random

import brute
import numpy as np
import pytest
from gridloom.llm import substrings


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 50, 120, 400)]
    rows = [None, "", " \n\t", "one", " ".join(["same"] * 34), " ".join(["same"] * 35), " ".join(["same"] * 36), " ".join(["a", "b"] * 60), "x y " * 20000]
    for _ in range(80):
        w = text(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared) + text(rng.randint(0, 60))
        rows.append(rng.choice([" ", "\n", "  \t"]).join(w))
    rows.append(rows[12])
    return rows


@pytest.mark.parametrize("many", [substrings.MANY, 1])
def test_removes_what_brute_force_removes(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(rows)], "doc_id long, text string, kept string, rid int").repartition(3 * seed)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark, df, 35).collect()}
        assert [got[i] for i in range(len(rows))] == brute.repeats(rows, 35)


def test_kept_text_and_other_windows(spark):
    rows = corpus(7)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substrings.remove_repeats(spark, df, 50, with_text=True).collect()}
    want = brute.repeats(rows, 50)
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(rows))] == want
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in got.values())


def test_repeated_rows_under_one_id_and_empty_table(spark):
    t = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, "a b")], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in substrings.remove_repeats(spark, df, 35).collect()) == [(2, 0), (60, 60), (60, 60)]
    assert substrings.remove_repeats(spark, df.limit(0), 35).collect() == []


def test_a_task_tells_of_every_hash_that_it_meets_again(monkeypatch):
    """Whatever a task forgets: of a hash that it meets twice, a row that says so is sent, and others are known or sent."""
    rng = np.random.default_rng(1)
    for most in (1_000_000, 20):
        monkeypatch.setattr(substrings.Seen, "MOST", most)
        repeats, blocks, sent = substrings.Repeats(), [rng.integers(0, 300, 50).astype(np.int64) for _ in range(60)], []
        for b in blocks:
            send, known = repeats(b)
            assert (send | known).all()
            sent += zip(b[send].tolist(), known[send].tolist(), strict=True)
        every = np.concatenate(blocks).tolist()
        rows = {h: [k for x, k in sent if x == h] for h in set(every)}
        assert all(len(k) > 1 or k[0] == (every.count(h) > 1) for h, k in rows.items())
        if most > 300:
            assert max(map(len, rows.values())) <= 2
