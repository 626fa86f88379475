"""Brute-force versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SP = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SP}]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fingerprint(text, words=4):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, prints, radius=4):
    """component_id by comparing every pair."""
    f = np.array(prints, np.uint64)
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(f)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(f))]


def shingles(text, words):
    w = WORD.findall(lower(text or ""))
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_pairs(texts, similarity=0.8, words=5):
    """Pairs of documents (a dict of texts) whose sets of shingles are at least that similar, with the similarity."""
    sets = {i: shingles(t, words) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    common = Counter()
    for ids in holders.values():
        common.update(itertools.combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        j = n / (len(sets[a]) + len(sets[b]) - n) if sets[a] or sets[b] else 1.0
        if j >= similarity:
            yield a, b, j


def near_groups(texts, similarity=0.8, words=5):
    """The smallest document that links reach, for each."""
    least = {i: i for i in texts}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b, _ in near_pairs(texts, similarity, words):
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def repeats(rows, window=35):
    split = [WORD.findall(t or "") for t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def exact(rows):
    """rows: (doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, sha)."""
    by = {}
    for d, t in rows:
        by.setdefault(re.sub(f"[{SP}]", "", t or ""), []).append((-len(t or ""), d))
    out = []
    for norm, g in by.items():
        g.sort()
        out += [(d, g[0][1], len(g), i == 0, sha(norm)) for i, (_, d) in enumerate(g)]
    return sorted(out)


def line_dedup(rows, least=20, docs=3):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) >= docs and d != max(holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def bpe(rows):
    t = tokenizer()
    out = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def check_packing(rows, pieces, limit=1024):
    """Asserts that pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset) tile documents and sequences; returns the share of padding (to the limit, but none at a power of two)."""
    t = tokenizer()
    want = Counter()
    for d, text in rows:
        want[(d, np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())] += 1
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_seq.setdefault(p[5], []).append((p[6], p[2]))
    for (d, ids), k in want.items():
        own = sorted(by_doc[d], key=lambda p: p[1])
        n = len(ids) // 4
        if sum(w[0] == d for w in want) == 1:
            spots = Counter()
            for _, start, length, crc, total, *_ in own:
                assert total == n and length >= 1
                assert crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
                spots.update(range(start, start + length))
            assert spots == Counter({i: k for i in range(n)})
    used = size = 0
    for spans in by_seq.values():
        spans.sort()
        at = 0
        for offset, length in spans:
            assert offset == at
            at += length
        assert at <= limit
        used += at
        size += at if at & (at - 1) == 0 else limit
    return 1 - used / size if by_seq else 0.0


def top(vectors, every=50, k=5):
    """vectors: (vec_id, list) -> (query, rank, vec_id, score)."""
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            best = sorted(((-int(v @ w), i) for i, w in good if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def chat(rows):
    """rows: (conv_id, turn, role, text) -> (conv_id, n_turns, turns_sha, loss_chars, loss_sha)."""
    out = []
    order = sorted(rows, key=lambda r: (r[0], r[1] if r[1] is not None else -(10**9), r[2] or "", r[3] or ""))
    for c, g in itertools.groupby(order, key=lambda r: r[0]):
        g = list(g)
        loss = "".join(t or "" for _, _, r, t in g if r == "assistant")
        out.append((c, len(g), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in g)), len(loss), sha(loss)))
    return out
