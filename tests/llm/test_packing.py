import random

import brute
import public_tokenizers
import pytest
from gridloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_pieces_tile_documents_and_sequences(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["cat", "Hund", "été", "\n"]) for _ in range(rng.choice([0, 1, 5, 200, 3000])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "word " * 50000), (3, rows[3][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, offset int").repartition(3)
    pieces = packing.pack_documents(df, PATH).select(*FIELDS).collect()
    padding = brute.check_packing(rows, [tuple(p) for p in pieces])
    assert padding < 0.01
    assert packing.pack_documents(df.limit(0), PATH).collect() == []


def test_last_sequences_end_at_powers_of_two():
    for seed in range(200):
        rng = random.Random(seed)
        p = packing.Packer((1024, 1024, 1024), cut=True)
        sizes = [rng.choice([1, 2, 30, 700, 1024, 5000]) for _ in range(rng.randint(0, 400))]
        placed = [x for i, n in enumerate(sizes) for x in p.put(i, n)] + list(p.finish())
        used, spans = {}, {}
        for key, start, length, seq, offset in placed:
            assert offset == used.get(seq, 0) and length > 0
            used[seq] = offset + length
            spans.setdefault(key, []).append((start, length))
        for i, n in enumerate(sizes):
            at = 0
            for start, length in sorted(spans[i]):
                assert start == at
                at += length
            assert at == n
        assert all(u <= 1024 for u in used.values())
        assert sum(u & (u - 1) != 0 for u in used.values()) <= 1


def test_instruction_examples_keep_all_three_limits(spark):
    rng = random.Random(4)
    rows = [(i, n := rng.randint(1, 900), min(700, rng.randint(0, n))) for i in range(2000)] + [(5000, 0, 0), (5001, None, None), (5002, 10, None)]
    df = spark.createDataFrame(rows, "example_id long, tokens int, loss_tokens int").repartition(2)
    got = packing.pack_examples(df, 1024, 6, 700).collect()
    size = {i: (n, loss or 0) for i, n, loss in rows if n}
    assert sorted(r.example_id for r in got) == sorted(size)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, *size[r.example_id]))
    for s in seqs.values():
        s.sort()
        assert len(s) <= 6 and sum(x[1] for x in s) <= 1024 and sum(x[2] for x in s) <= 700
        assert all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[0][0] == 0
    assert sum(n for n, _ in size.values()) > 0.9 * 1024 * len(seqs)


def test_an_example_beyond_a_limit_is_an_error():
    with pytest.raises(ValueError):
        list(packing.Packer((10, 2, 10), cut=False).put(0, 11))
