"""Registered queries over whole tables, against brute force."""

import brute
import pytest
from gridloom.llm import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]


def rows(spark, name, *cols):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, D).select(*cols).collect())


def test_op1(spark, documents):
    ids, prints = [d for d, _ in documents], [brute.fingerprint(t) for _, t in documents]
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], brute.groups(ids, prints), strict=True))
    assert rows(spark, "op1_simhash_groups", "doc_id", "fingerprint", "component_id") == want


def test_op2(spark, documents):
    want = sorted((d, *r) for (d, _), r in zip(documents, brute.repeats([t for _, t in documents]), strict=True))
    assert rows(spark, "op2_repeated_substrings", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op3(spark, documents):
    got = rows(spark, "op3_vector_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert brute.check_packing(documents, got) < 0.02


def test_op4(spark):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{D}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert rows(spark, "op4_chat_format", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(brute.chat(turns))


def test_op6(spark, documents):
    assert rows(spark, "op6_bpe_round_trip", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe(documents)
