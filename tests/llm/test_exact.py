import random

import brute
from gridloom.llm import exact


def rows():
    rng = random.Random(1)
    out = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a b"), (8, "x" * 300000), (9, "x" * 300000 + "\n"), (5, "ab"), (-3, "A b")]
    return out + [(100 + i, rng.choice(["p q", "pq ", "p\tq\n", "r", "ré", "日 本", "日本"])) for i in range(300)]


def test_as_by_brute_force_with_few_digests_a_memtable(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows()], "doc_id long, text string, entry int, kept string").repartition(4)
    for memtable in (2, 20000):
        got = sorted(tuple(r) for r in exact.exact_duplicates(spark, df, memtable).collect())
        assert got == brute.exact(rows())
    assert exact.exact_duplicates(spark, df.limit(0)).collect() == []


def test_null_identifiers(spark):
    got = exact.exact_duplicates(spark, spark.createDataFrame([(None, "a"), (4, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.group_size, r.kept, r.doc_id is None, r.keep_id is None) for r in got) == [(1, True, True, True), (2, False, True, False), (2, True, False, False)]


def test_hits_are_verified_byte_by_byte():
    index = exact.LsmIndex(memtable=1)
    a = index.put(b"d" * 32, b"one", 3, 1, 0)
    b = index.put(b"d" * 32, b"two", 3, 2, 1)
    assert a != b and index.put(b"d" * 32, b"one", 3, 3, 2) == a and index.put(b"e" * 32, b"one", 3, 3, 2) not in (a, b)
    assert index.put(b"d" * 32, b"two", 9, 9, 3) == b
