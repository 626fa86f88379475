import random

import numpy as np
import public_tokenizers

import brute
from gridloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    bits = ["a", "the", "word", "don't", "I'LL", "é", "ß", "日本", "語", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "\x1f", "\x85", "​", "12", "²", "Ⅷ", "!!", "...", "'s", "<|endoftext|>", "<|endof", "🤦🏼‍♂️", "à ", "  ", "x" * 60, "é", "\x00", "ſ", "'S"]
    yield from ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "x" * 5000, " " * 3000, "word " * 3000]
    for _ in range(3000):
        yield "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))


def test_encodes_and_decodes_as_the_library():
    own, lib = bpe.ForcedBoundaryBpe(PATH, most=500), brute.tokenizer()
    for t in texts():
        ids = own.encode(t)
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False), repr(t)


def test_query_handles_nulls_empties_repeats_and_other_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hi there <|endoftext|> x", None), (3, "Hi there <|endoftext|> x", None), (4, "w " * 40000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.encode_documents(docs, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == brute.bpe([(d, t) for d, t, _ in rows])
    assert bpe.encode_documents(docs.limit(0), PATH).collect() == []
