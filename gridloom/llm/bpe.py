"""Byte-level BPE by forced-boundary splitting, and its inverse.

A pair of bytes that stands inside no token of the vocabulary is a certain cut: no merge crosses it, so what
lies on either side encodes alone. A byte before a space is such a pair but where vocabularies have tokens of
white space; a space between two characters that are not white also always begins a pre-token, and no merge
crosses pre-tokens either. So a text falls apart at its single spaces into fragments that encode independently;
a fragment is cut again into pre-tokens and at every other forced pair. Ids are kept as bytes
(little-endian 32-bit), so joining fragments is joining bytes. Fragments are remembered up to a fixed number of bytes.

Cases: null is an empty text, which has no ids; whole texts of any length; the string of a special token in a
text becomes its id, as the tokenizers library has it; truncation and padding of the file are not applied;
rows repeated whole give repeated rows; an empty table an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, blocks, tidy

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes of remembered fragments, in each of two generations of two stores of a worker.
CACHE = 48 << 20


class Loose(Exception):
    """A space stands beside white space: not every space begins a fragment."""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Fragments(dict):
    """Ids of fragments, those of at most LONGEST letters remembered in two generations of about `most` bytes.

    When the young generation is full it becomes the old one, from which fragments that occur again return."""

    LONGEST, OVERHEAD = 64, 160  # bytes of two objects and their place in a table

    def __init__(self, encode, most: int):
        self.encode, self.most, self.held, self.old = encode, most, 0, {}

    def __missing__(self, s):
        ids = self.old.pop(s, None)
        if ids is None:
            ids = self.encode(s)
            if len(s) > self.LONGEST:
                return ids
        self.held += len(s) + len(ids) + self.OVERHEAD
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[s] = ids
        return ids


class ForcedBoundaryBpe:
    """most: bytes of remembered fragments in each generation of its two stores."""

    def __init__(self, path: str, most: int = CACHE):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.special = {a["content"]: int(a["id"]) for a in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranks = {bytes([b]): ids.get(bytes([b]), b) for b in range(256)}
        for k, (a, b) in enumerate(merges):
            ranks.setdefault(bytes(letters[c] for c in a + b), 256 + k)
        if any(ids.get(t) != r for t, r in ranks.items()):
            raise ValueError("only vocabularies whose ids follow the merges are known here")
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        inside = np.zeros(65536, np.uint8)
        for t in raw.values():
            for a, b in zip(t, t[1:]):
                inside[a << 8 | b] = 1
        self.forced = (1 - inside).tobytes()
        pre = spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level pre-tokenizers with their usual pattern are known here")
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.pieces = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.spaced = _Fragments(lambda s: self._fragment(" " + s), most)
        self.short = _Fragments(self._piece, most)

    def _cut(self, b: bytes) -> list[bytes]:
        forced, out, start, last = self.forced, [], 0, b[0] if b else 0
        for i, x in enumerate(b):
            if i and forced[last << 8 | x]:
                out.append(b[start:i])
                start = i
            last = x
        out.append(b[start:])
        return out

    def _piece(self, s: str) -> bytes:
        """A pre-token: its forced fragments, each merged alone."""
        cut = self._cut(s.encode())
        if len(cut) == 1:
            return array("I", self.merge(cut[0])).tobytes()
        return b"".join([array("I", self.merge(f)).tobytes() for f in cut])

    def _fragment(self, s: str) -> bytes:
        """A space and what follows it up to the next space."""
        word = s[1:]
        if not word or word[0].isspace() or word[-1].isspace():
            raise Loose
        if word.isalpha():  # letters only: one pre-token
            return self._piece(s)
        if word[:-1].isalpha() and word[-1] in ".,":
            return self.spaced[word[:-1]] + self.short[word[-1]]
        return b"".join(map(self.short.__getitem__, self.pieces(s)))

    def _plain(self, s: str) -> bytes:
        if not s:
            return b""
        head, *rest = s.split(" ")
        pieces, short = self.pieces, self.short.__getitem__
        if not rest or not head[-1:].isspace():
            try:
                return b"".join(map(short, pieces(head))) + b"".join(map(self.spaced.__getitem__, rest))
            except Loose:
                pass
        return b"".join(map(short, pieces(s)))

    def encode(self, s: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not any(t in s for t in self.special):
            return self._plain(s)
        return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in self.at_special.split(s))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def load(path: str, most: int = CACHE) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path, most)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


@tidy
def _encode(batches, path, with_ids):
    bpe = load(path)
    for b in blocks(batches):
        n, kept, shas, back = [], [], [], []
        for t in b.column(1):
            ids = bpe.encode(t.as_py() or "")
            n.append(len(ids) // 4)
            kept.append(ids if with_ids else None)
            shas.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
        yield batch(_OUT, b.column(0), n, kept, shas, back)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of ids and of the decoded text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(partial(_encode, path=path, with_ids=with_ids), "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")
