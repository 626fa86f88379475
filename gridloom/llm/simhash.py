"""SimHash near-duplicate groups with pivot distance tables.

A fingerprint has one or more 64-bit words. Equal fingerprints are collapsed first, so copies cost nothing later.
Every distinct fingerprint is dealt to buckets by groups of its bits. With one word and radius r the groups are
all choices of m - r out of m blocks: two fingerprints that differ in at most r bits agree on one of them, so no
link is lost. Inside a bucket the pivot table (Hamming distances to fixed reference fingerprints) comes first:
by the triangle inequality a pair whose largest coordinate difference exceeds r cannot link; what survives is
verified on the bits. A bucket yields a spanning forest of its links and never the pairs themselves. Buckets
beyond HOT members are cut into blocks (see grouped), in the same way and without a lost link.

Wide fingerprints only find candidates, of sets of shingles (a repeated shingle counts once) and within a radius
that few pairs of the similarity exceed. What candidates connect is compared in blocks, by the shingle sets
themselves: by prefixes of their rarest shingles, that no similar pair lacks a common one of, then exactly.

Cases: null, empty or white text has no shingle and gets fingerprint zero, linked like any other; repeated
rows are copies; a null identifier is linked but names no component, unless no row of it has another; an empty
table gives an empty result; other columns of the input are not read."""

from __future__ import annotations

import itertools
import math
import random
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, among, blocks, release, remix, texts, tidy
from .components import connected_components
from .grouped import group_links

#: Members from which on a bucket is cut into blocks, and members of a block.
HOT, BLOCK = 4096, 16_384
#: Shingles of the sets that a task compares at once.
WEIGHT = 1_000_000
#: Members up to which buckets are worked on all at once.
FEW = 48
#: Reference fingerprints of the pivot table.
PIVOTS = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of so many words, lower-cased in A-Z; of all words where there are fewer."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    buf = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(buf, 42)], np.uint64)
    ends = list(itertools.accumulate(map(len, w)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.fromiter([h(buf[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=False)], np.uint64, len(w) - words + 1)


def fingerprint(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n = len(h)
    if n == 0:
        return 0
    b = h.view(np.uint8).reshape(n, 8)
    counts = np.unpackbits(b, axis=1, bitorder="little").sum(0, dtype=np.int64) if n < 200 else np.concatenate([np.bincount(b[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@tidy
def _set_fingerprints(batches, words, width, numbered, schema):
    """A row for each document: its number, doc_id, 128 bits that name its set of shingles, the set's size and fingerprint, and the text.

    numbered: doc_id is the number, and the text is left out."""
    rid = TaskContext.get().partitionId() << 40
    for b in blocks(batches):
        out = []
        for t in texts(b.column(1)):
            h = np.unique(shingle_hashes(t, words))
            raw = h.tobytes()
            out.append([xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2), len(h), *(fingerprint(h if k == 0 else remix(h, k)) for k in range(width))])
        f = np.array(out, np.uint64).reshape(-1, 3 + width).view(np.int64)
        own = b.column(0).cast(pa.int64())
        number = own if numbered else pa.array(np.arange(rid, rid + b.num_rows))
        cols = [number, own, *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(3 + width))]
        yield pa.RecordBatch.from_arrays(cols if numbered else [*cols, b.column(1).cast(pa.string())], schema=schema)
        rid += b.num_rows


@tidy
def _fingerprints(batches, words, width, schema):
    for b in blocks(batches):
        out = []
        for t in texts(b.column(1)):
            h = shingle_hashes(t, words)
            out.append([fingerprint(h if k == 0 else remix(h, k)) for k in range(width)])
        f = np.array(out, np.uint64).reshape(-1, width).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(width))], schema=schema)


def fingerprints(docs: DataFrame, words: int, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0 .. f{width-1}) for every row; words as fingerprints hold no sign."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"f{k}", pa.int64()) for k in range(width))])
    cols = ", ".join(f"f{k} long" for k in range(width))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_fingerprints, words=words, width=width, schema=schema), f"doc_id long, {cols}")


def block_masks(bits: int, blocks: int, agree: int) -> list[int]:
    """One mask for each choice of so many of the equal blocks of so many bits."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(own, agree)]


def exact_masks(n: int, radius: int) -> list[int]:
    """Masks by which no pair of 64-bit fingerprints within the radius is lost; the more rows, the more bits."""
    m = radius + 2
    while m < radius + 6 and n > 2 ** (64 * (m - radius) / m):
        m += 1
    return block_masks(64, m, m - radius)


def differ(similarity: float) -> float:
    """The share of bits in which fingerprints of large sets of that Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def differ_most(similarity: float) -> float:
    """The same for the sets, small ones included, of at least that similarity of which most bits differ."""

    def majority(common: int, more: int) -> float:  # a set and the same with more elements
        n = common + more
        return sum(math.comb(common, c) * math.comb(more, m) for c in range(common + 1) for m in range(more + 1) if (2 * c > common) != (2 * (c + m) > n)) / 2**n

    small = [majority(i, a) for i in range(1, 33) for a in range(1, i + 1) if i / (i + a) >= similarity]
    return max([differ(similarity), *small])


def band_masks(n: int, width: int, similarity: float, recall: float = 0.99) -> list[int]:
    """Random choices of bits of a wide fingerprint: enough of them that a pair of that similarity meets with this probability, over all distances it may have."""
    bits = max(16, math.ceil(math.log2(max(n, 2))) - 2)
    total, p = 64 * width, differ(similarity)
    share = [math.comb(total, d) * p**d * (1 - p) ** (total - d) for d in range(total + 1)]
    meet = [(1 - d / total) ** bits for d in range(total + 1)]
    count = 1
    while sum(s * (1 - m) ** count for s, m in zip(share, meet, strict=True)) > 1 - recall:
        count += 1
    rng = random.Random(7)
    return [sum(1 << i for i in rng.sample(range(64 * width), bits)) for _ in range(count)]


def radius_for(similarity: float, width: int) -> int:
    """Bits in which fingerprints of sets of that Jaccard similarity differ at most, but for about one pair in a thousand: mean and three standard deviations."""
    n, p = 64 * width, differ_most(similarity)
    return min(n, math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(df: DataFrame, masks: list[int], width: int) -> DataFrame:
    """A row for each fingerprint and mask: key is a hash of the mask's number and the masked bits (a clash of keys only costs time)."""
    cols = [f"f{k}" for k in range(width)]

    def key(i: int, mask: int):
        words = [(c, mask >> (64 * k) & 0xFFFFFFFFFFFFFFFF) for k, c in enumerate(cols)]
        return F.xxhash64(F.lit(i), *(F.col(c).bitwiseAND(F.lit(_signed(m)).cast("long")) for c, m in words if m))

    return df.select(*cols, F.explode(F.array(*(key(i, m) for i, m in enumerate(masks)))).alias("key"))


def pivots(width: int) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, (PIVOTS, width), dtype=np.uint64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def pivot_table(f: np.ndarray) -> np.ndarray:
    """Distances of fingerprints (n x width) to the references (n x PIVOTS)."""
    return np.stack([_distance(f, p) for p in pivots(f.shape[1])], 1)


def _run_links(f: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """A spanning forest of the links among the members of one bucket, as (member, members linked to it)."""
    found = []
    free = np.arange(1, len(f))
    stack = [0]
    while free.size:
        if not stack:
            stack, free = [int(free[0])], free[1:]
            continue
        x = stack.pop()
        hit = np.ones(free.size, bool)
        for j in range(0, PIVOTS, 4):  # a few coordinates discard most pairs
            if j == 0 or hit.any():
                at = np.flatnonzero(hit)
                hit[at] = np.abs(table[free[at], j : j + 4] - table[x, j : j + 4]).max(1, initial=0) <= radius
        at = np.flatnonzero(hit)
        at = at[_distance(f[free[at]], f[x]) <= radius]
        if at.size:
            found.append((x, free[at]))
            stack.extend(free[at].tolist())
            free = np.delete(free, at)
    return found


def _few_links(u: np.ndarray, left: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in buckets of a few members; left: members of the bucket after this one.

    All buckets at once: members are compared with the next, the next but one and so on."""
    table, found, k = pivot_table(u), [], 1
    live = np.flatnonzero(left >= 1)
    while live.size:
        at = live
        for j in range(0, PIVOTS, 4):  # a few coordinates discard most pairs
            at = at[np.abs(table[at, j : j + 4] - table[at + k, j : j + 4]).max(1, initial=0) <= radius]
        at = at[_distance(u[at], u[at + k]) <= radius]
        found += zip(at.tolist(), (at + k).tolist(), strict=True)
        k += 1
        live = live[left[live] >= k]
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            x = y
        return x

    forest = []
    for a, b in found:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append((a, b))
    return forest


@tidy
def _links(batches, width, radius, hot, schema):
    """Rows come sorted by key. Out: links (kind 0: a then b), and the rows of hot keys as they are (kind 1: a, and the key)."""

    def out(pairs, over, over_keys):
        a = np.concatenate([p[0] for p in pairs] + [over]) if pairs or len(over) else np.empty((0, width), np.int64)
        b = np.concatenate([p[1] for p in pairs] + [np.zeros_like(over)]) if len(a) else np.empty((0, width), np.int64)
        n = len(a) - len(over)
        kind = np.concatenate([np.zeros(n, np.int8), np.ones(len(over), np.int8)])
        keys = np.concatenate([np.zeros(n, np.int64), over_keys])
        cols = [np.ascontiguousarray(x[:, k]) for x in (a, b) for k in range(width)]
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys), *map(pa.array, cols)], schema=schema)

    def work(f, key, pairs):
        """Link all complete buckets of these sorted rows."""
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = ends - starts
        u = f.view(np.uint64)
        few = np.repeat(size <= FEW, size)
        at = np.flatnonzero(few)
        left = np.repeat(ends, size)[at] - at - 1  # stays right among these rows, as buckets stay whole
        forest = np.array(_few_links(u[at], left, radius), np.int64).reshape(-1, 2)
        if len(forest):
            pairs.append((f[at[forest[:, 0]]], f[at[forest[:, 1]]]))
        for s, e in zip(starts[size > FEW].tolist(), ends[size > FEW].tolist(), strict=True):
            run = u[s:e]
            for x, to in _run_links(run, pivot_table(run), radius):
                pairs.append((np.repeat(f[s + x][None], len(to), 0), f[s:e][to]))

    f, key, burning = np.empty((0, width), np.int64), np.empty(0, np.int64), None  # burning: the key whose rows pass through
    none = np.empty((0, width), np.int64), np.empty(0, np.int64)
    for b in batches:
        f = np.concatenate([f, np.stack([b.column(k).to_numpy() for k in range(width)], 1)])
        key = np.concatenate([key, b.column(width).to_numpy()])
        pairs, over = [], [none]
        if burning is not None:
            n = int(np.searchsorted(key != burning, True)) if (key != burning).any() else len(key)
            over.append((f[:n], key[:n]))
            f, key = f[n:], key[n:]
            burning = burning if not len(key) else None
        if len(key):
            last = int(np.flatnonzero(key == key[-1])[0])
            done_f, done_key, f, key = f[:last], key[:last], f[last:], key[last:]
            if hot and len(key) > hot:
                over.append((f, key))
                burning, f, key = key[-1], f[:0], key[:0]
            if len(done_key):
                if hot:
                    n = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(done_key) != 0])), [len(done_key)]]))
                    big = np.repeat(n > hot, n)
                    over.append((done_f[big], done_key[big]))
                    done_f, done_key = done_f[~big], done_key[~big]
                if len(done_key):
                    work(done_f, done_key, pairs)
        yield out(pairs, *(np.concatenate(x) for x in zip(*over, strict=True)))
    if len(key) > 1:
        pairs = []
        work(f, key, pairs)
        yield out(pairs, *none)


def _fingerprint_roots(columns, radius):
    """For each fingerprint (columns: its words) the first one that links reach from it."""
    f = np.stack([c.to_numpy() for c in columns], 1).view(np.uint64)
    root = np.arange(len(f))
    for x, to in _run_links(f, pivot_table(f), radius):
        root[to] = root[x]
    return root


def link_fingerprints(spark: SparkSession, distinct: DataFrame, masks: list[int], radius: int, width: int, work: Scratch) -> DataFrame:
    """Links (a, b) among distinct fingerprints (f0.., least), by least: enough of them to connect every group.

    Buckets beyond HOT are cut into blocks, so that no task holds or compares a whole one."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), *((f"{s}{k}", pa.int64()) for s in "ab" for k in range(width))])
    ddl = "kind byte, key long, " + ", ".join(f"{s}{k} long" for s in "ab" for k in range(width))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    f = [f"f{k}" for k in range(width)]
    rows = _keys(distinct, masks, width).repartition(parts, "key").sortWithinPartitions("key", *f)
    first = work.write(rows.mapInArrow(partial(_links, width=width, radius=radius, hot=HOT, schema=schema), ddl), "links")
    edges = _edges(first.where("kind = 0"), distinct, width)
    hot = first.where("kind = 1").select("key", *(F.col(f"a{k}").alias(f"f{k}") for k in range(width)))
    if hot.isEmpty():
        return edges
    members = work.write(hot.join(distinct, f).select(F.col("key").alias("g"), F.col("least").alias("id"), F.lit(1).cast("long").alias("w")), "hot")
    named = distinct.select(F.col("least").alias("id"), *f)
    return edges.union(group_links(spark, members, lambda x: x.join(named, "id"), partial(_fingerprint_roots, radius=radius), BLOCK, work, "hot"))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of these spans, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of distinct hashes, the first set that links of at least this Jaccard similarity reach from it; no link is lost."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    names, ids, often = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(names))  # rare ones first
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(m), size)
    ids = rank[ids]
    ids = ids[np.lexsort((ids, owner))]
    prefix = np.minimum(size, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)

    def index(of):
        """Members of the prefixes of these sets, in order, and whose they are."""
        at = _spans(begin[of], prefix[of])
        order = np.argsort(ids[at], kind="stable")
        return ids[at][order], owner[at][order]

    root, free, n_free = np.arange(m), np.ones(m, bool), m
    keys, whose = index(np.arange(m))
    built, mark = m, np.zeros(len(names), bool)
    for first in range(m):
        if not free[first]:
            continue
        free[first], n_free, stack = False, n_free - 1, [first]
        while stack and n_free:
            if 2 * n_free <= built:  # sets that are linked need no finding
                keys, whose = index(np.flatnonzero(free))
                built = n_free
            x = stack.pop()
            own = ids[begin[x] : begin[x] + size[x]]
            lo, hi = (np.searchsorted(keys, own[: prefix[x]], side) for side in ("left", "right"))
            c = whose[_spans(lo, hi - lo)]
            c = np.unique(c[free[c]])
            c = c[np.minimum(size[c], size[x]) / np.maximum(size[c], size[x]) >= similarity]
            if not len(c):
                continue
            mark[own] = True
            both = np.add.reduceat(mark[ids[_spans(begin[c], size[c])]].astype(np.int64), np.cumsum(size[c]) - size[c])
            mark[own] = False
            c = c[both / (size[c] + size[x] - both) >= similarity]
            root[c], free[c] = first, False
            n_free -= len(c)
            stack.extend(c.tolist())
    return root


def _set_roots(columns, words, similarity):
    """For each text the first one whose set of shingles links reach from its own."""
    sets = [np.unique(shingle_hashes(t, words)) for t in texts(columns[0])]
    return similar_groups(sets, similarity)


def _similar(spark: SparkSession, docs: DataFrame, words: int, similarity: float, width: int, numbered: bool, work: Scratch) -> DataFrame:
    """near_duplicate_groups by the similarity of shingle sets; docs: doc_id, text."""
    f = [f"f{k}" for k in range(width)]
    longs = ["rid", "doc_id", "s0", "s1", "size", *f]
    schema = pa.schema([*((c, pa.int64()) for c in longs), *([] if numbered else [("text", pa.string())])])
    ddl = ", ".join(f"{c} long" for c in longs) + ("" if numbered else ", text string")
    rows = work.write(docs.mapInArrow(partial(_set_fingerprints, words=words, width=width, numbered=numbered, schema=schema), ddl), "fingerprints")
    whole = docs.select(F.col("doc_id").alias("rid"), "text") if numbered else rows.select("rid", "text")
    sets = work.write(rows.groupBy("s0", "s1", *f).agg(F.min("doc_id").alias("id"), F.min("rid").alias("rep"), F.max("size").alias("size")), "sets")
    distinct = work.write(sets.groupBy(*f).agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("k")), "distinct")
    n = distinct.count()
    links = link_fingerprints(spark, distinct.select(*f, "least"), band_masks(n, width, similarity), radius_for(similarity, width), width, work)
    near = connected_components(spark, links, work).withColumnRenamed("v", "least")
    release(spark)
    # sets that are alone under a fingerprint without link need no comparison
    some = distinct.join(near, "least", "left").where("root is not null or k > 1").select(*f, F.coalesce("root", "least").alias("g"))
    members = work.write(sets.join(some, f).select("g", F.col("rep").alias("id"), F.greatest("size", F.lit(1)).alias("w")), "candidates")
    whole = among(whole.withColumnRenamed("rid", "id"), members, "id", work, "candidates-bitmaps")  # only candidates' texts are shuffled
    same = group_links(spark, members, lambda x: x.join(whole, "id"), partial(_set_roots, words=words, similarity=similarity), WEIGHT, work, "sets")
    roots = connected_components(spark, same, work, "sets-all").withColumnRenamed("v", "rep")
    named = work.write(sets.join(roots, "rep", "left").select("s0", "s1", "id", F.coalesce("root", "rep").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("s0", "s1", "component_id")
    out = rows.select("doc_id", "s0", "s1", *f).join(named, ["s0", "s1"]).select("doc_id", *f, "component_id")
    done = Scratch(spark, "simhash-groups").write(out, "groups")
    work.drop()  # with the texts
    release(spark)
    return done


def _edges(links: DataFrame, distinct: DataFrame, width: int) -> DataFrame:
    """Links by the names of their fingerprints: each is named by the smallest document that has it."""
    name = {s: distinct.select(*(F.col(f"f{k}").alias(f"{s}{k}") for k in range(width)), F.col("least").alias(s)) for s in "ab"}
    cols = [f"{s}{k}" for s in "ab" for k in range(width)]
    return links.select(*cols).distinct().join(name["a"], [f"a{k}" for k in range(width)]).join(name["b"], [f"b{k}" for k in range(width)]).select("a", "b")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, words: int = 5, radius: int | None = None, similarity: float = 0.8, width: int = 4, id_col: str = "doc_id", text_col: str = "text", numbered: bool = False) -> DataFrame:
    """(doc_id, f0.., component_id) for every row: component_id is the smallest doc_id that links reach.

    With a radius: one 64-bit word, and every link of at most so many bits. Without: links are pairs whose sets of
    word shingles have a Jaccard similarity of `similarity` or more, found by wide fingerprints of the sets.
    numbered: identifiers are unique, not null, and the same at every reading of docs, so that texts are not copied."""
    work = Scratch(spark, "simhash")
    if radius is None:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return _similar(spark, docs, words, similarity, width, numbered, work)
    fps = work.write(fingerprints(docs, words, 1, id_col, text_col), "fingerprints")
    # fingerprints get numbers of their own, as identifiers may be null
    distinct = work.write(fps.groupBy("f0").agg(F.min("doc_id").alias("id")).withColumn("least", F.monotonically_increasing_id()), "distinct")
    links = link_fingerprints(spark, distinct.select("f0", "least"), exact_masks(distinct.count(), radius), radius, 1, work)
    roots = connected_components(spark, links, work)
    named = distinct.join(roots.withColumnRenamed("v", "least"), "least", "left").select("f0", "id", F.coalesce("root", "least").alias("root"))
    named = work.write(named, "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    done = Scratch(spark, "simhash-groups").write(named.join(least, "root").select("f0", "component_id"), "groups")
    for name in ("links", "distinct", "named"):
        work.drop(name)
    return fps.join(done, ["f0"]).select("doc_id", "f0", "component_id")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = near_duplicate_groups(spark, docs, words=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
