"""Removal of long repeated word sequences by restricted recompression.

Words are named by 64-bit hashes. Rounds of recompression then merge runs of one symbol and, in pairs, a left
symbol with a right one (a bit of the name's hash says which it is); a new name is a hash of what it replaces, so
equal names mean equal words in every partition and no round needs a dictionary. Only symbols up to a round's
cap merge, so a boundary between symbols depends on a few words at either side: equal sequences keep the same
boundaries but near their ends. From the boundaries inside each window one is taken as its anchor (the least
hash of the adjoining symbols), so equal windows have equal anchors at equal places. One row for each anchor
is compared across the corpus by a hash of the words around it; only around anchors that recur are windows
digested, and compared in groups of one anchor hash by their digests. The anchor hash is made of one set of word
names and the digest of another, so across tasks equal windows agree in 128 independent bits; inside one task, where
repeats are combined first, in the 64 of the digest. This verification replaces a comparison of the words themselves.

What repeats inside one task is combined there before a shuffle: a task sends a hash twice at most, once when it
meets it and once when it meets it again, so a passage of a third of all documents sends two rows a task. An anchor
with very many different surroundings is compared window by window, dealt by digest. Tasks read their rows in the
order of the hashes and hold one group. Rows of the input get an own number (rid) when they are read.

Cases: null and empty texts have no words; fewer words than the window remove nothing; rows repeated whole are
repeats of each other, also under one doc_id; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
import itertools
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, blocks, mix, release, remix, texts, tidy, whole_groups

#: Caps of the rounds, in words: a round of runs, then rounds of pairs. CONTEXT words at either side settle a
#: boundary and the names of the symbols that adjoin it.
RUN_CAP, PAIR_CAPS, NAME_CAP = 1, (1, 1, 2), 4
CONTEXT = RUN_CAP + sum(PAIR_CAPS) + NAME_CAP

#: Rows of one anchor from which on its windows are compared one by one, dealt by digest.
MANY = 512

_ODD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


class WordNames(dict):
    """Two independent hashes of words (names and checks), remembered for about as many as MOST."""

    MOST = 100_000

    def __init__(self):
        self.hashes = array("Q"), array("Q")

    def __missing__(self, w: bytes) -> int:
        self[w] = k = len(self.hashes[0])
        self.hashes[0].append(xxhash.xxh64_intdigest(w, 7))
        self.hashes[1].append(xxhash.xxh64_intdigest(w, 8))
        return k

    def of(self, words, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.MOST:
            self.clear()
            self.hashes = array("Q"), array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return np.frombuffer(self.hashes[0], np.uint64)[at], np.frombuffer(self.hashes[1], np.uint64)[at]


class Seen:
    """Hashes that a task has met. Beyond MOST they are forgotten, and sent again: more rows, the same result."""

    MOST = 1_000_000

    def __init__(self):
        self.runs: list[np.ndarray] = []

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for r in self.runs:
            at = np.minimum(np.searchsorted(r, h), len(r) - 1)
            found |= r[at] == h
        return found

    def add(self, h: np.ndarray) -> None:
        """h: in order, and not yet there."""
        if len(h):
            self.runs.append(h)
        if len(self.runs) > 8:
            self.runs = [np.sort(np.concatenate(self.runs))]
            if len(self.runs[0]) > self.MOST:
                self.runs = []


class Repeats:
    """What a task is to send of the hashes of its blocks."""

    def __init__(self):
        self.once, self.told = Seen(), Seen()

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(send, known) for each place: whether its hash is to be compared with other tasks, and whether it is known to occur again."""
        u, spot, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        told = self.told.has(u)
        before = self.once.has(u) | told
        again = before | (count > 1)
        self.once.add(u[~before])
        self.told.add(u[again & ~told])
        send = np.zeros(len(h), bool)
        send[spot[~told]] = True
        return send, again[back]


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        return np.multiply.accumulate(p)


class Rolling:
    """Polynomial hashes modulo 2**64 of any runs of named words, from prefix sums."""

    def __init__(self, names: np.ndarray, base: int):
        self.inverse = _powers(pow(base, -1, 1 << 64), len(names) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(names * _powers(base, len(names)))])

    def __call__(self, start: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.inverse[start])


_BASE_A, _BASE_B = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def recompress(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after all rounds: their start, length and name. first marks words that begin a document."""
    at, length, sym, head = np.arange(len(names)), np.ones(len(names), np.int64), names, first
    for k, cap in enumerate((RUN_CAP, *PAIR_CAPS)):
        active = length <= cap
        joins = np.zeros(len(sym), bool)  # joins the symbol before it
        if k == 0:
            joins[1:] = (sym[1:] == sym[:-1]) & active[1:] & active[:-1] & ~head[1:]
            keep = np.flatnonzero(~joins)
            count = np.diff(np.append(keep, len(sym)))
            new = np.where(count > 1, remix(sym[keep] ^ mix(count.astype(np.uint64)), 100), sym[keep])
        else:
            right = (remix(sym, k) >> np.uint64(63)).astype(bool)
            joins[1:] = ~right[:-1] & right[1:] & active[1:] & active[:-1] & ~head[1:]
            keep = np.flatnonzero(~joins)
            new = sym[keep].copy()
            paired = np.flatnonzero(joins)
            spot = np.searchsorted(keep, paired) - 1
            new[spot] = remix(sym[paired - 1] * np.uint64(3) + remix(sym[paired], 50), 101)
        length = np.add.reduceat(length, keep) if len(keep) else length
        at, sym, head = at[keep], new, head[keep]
    return at, length, sym


def anchors(names: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, their anchors), as positions of words. first: where a word's document begins; last: where it ends."""
    n = len(names)
    span = window - 2 * CONTEXT + 1  # places in a window where an anchor can be
    if span < 2:
        raise ValueError(f"a window must have at least {2 * CONTEXT + 1} words")
    none = np.empty(0, np.int64)
    if n < window:
        return none, none
    head = first == np.arange(n)
    at, length, sym = recompress(names, head)
    short = np.where(length <= NAME_CAP, sym, np.uint64(_ODD))
    value = np.full(n, _M64, np.uint64)
    value[at[1:]] = remix(short[:-1] * np.uint64(5) + remix(short[1:], 60), 102) >> np.uint64(1)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    m = (value & ~low) | np.arange(n, dtype=np.uint64)  # the least hash; of equal ones the leftmost
    width, best = 1, m
    while 2 * width <= span:
        best, width = np.minimum(best[:-width], best[width:]), 2 * width
    if width < span:
        best = np.minimum(best[: n - span + 1], best[span - width : span - width + n - span + 1])
    start = np.flatnonzero(np.arange(n) + window <= last)
    return start, (best[start + CONTEXT] & low).astype(np.int64)


class Words:
    """Words of several texts, one after the other."""

    def __init__(self, docs: list[bytes], cache: WordNames):
        self.split = [d.split() for d in docs]
        self.counts = np.array([len(w) for w in self.split], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        n = int(self.begin[-1])
        self.names, self.checks = cache.of(itertools.chain.from_iterable(self.split), n)
        self.doc = np.repeat(np.arange(len(docs)), self.counts)
        self.first, self.last = np.repeat(self.begin[:-1], self.counts), np.repeat(self.begin[1:], self.counts)


_READ = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("packed", pa.binary()), ("h", pa.int64()), ("pos", pa.int32()), ("known", pa.bool_())])
_READ_DDL = "rid long, doc_id long, n_words long, sha string, packed binary, h long, pos int, known boolean"


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _with(b: pa.RecordBatch, carried: pa.Array | None) -> pa.RecordBatch:
    """The batch with a column of what its rows carry, if they carry anything."""
    return b if carried is None else b.append_column("row", carried)


@tidy
def _read(batches, window):
    """A row for each document (text packed), and one for each anchor; of anchors equal in a task, few are to be compared.

    A third column of the input is carried by the rows of documents."""
    cache, pack, rid, repeats = WordNames(), zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 40, Repeats()
    for b in blocks(batches, most=1_000_000):
        docs = texts(b.column(1))
        w = Words(docs, cache)
        n = len(docs)
        rids = np.arange(rid, rid + n)
        rid += n
        none = [None] * n
        row = b.column(2) if b.num_columns > 2 else None
        yield _with(batch(_READ, rids, b.column(0).cast(pa.int64()), w.counts, [_sha(x) for x in w.split], [pack.compress(d) for d in docs], none, none, none), row)
        at = np.unique(anchors(w.names, w.first, w.last, window)[1])
        h = Rolling(w.names, _BASE_B)(at - CONTEXT, 2 * CONTEXT).view(np.int64)
        send, known = repeats(h)
        # known: its like is in the task. Those to compare carry h.
        none = pa.nulls(len(h))
        anchored = batch(_READ, rids[w.doc[at]], none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.binary()), pa.array(h, mask=~send), (at - w.first[at]).astype(np.int32), known)
        yield _with(anchored, None if row is None else pa.nulls(len(h), row.type))


_MARK = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_MARK_DDL = "rid long, start int, n int"


@tidy
def _recurring(batches, keys):
    """Rows (keys.., rid, start, known), sorted by the keys: those whose keys occur again or are known to."""
    for t, starts in whole_groups(batches, keys):
        size = np.diff(np.append(starts, t.num_rows))
        ever = np.logical_or.reduceat(t.column(keys + 2).to_numpy(), starts)
        take = np.flatnonzero(np.repeat((size > 1) | ever, size))
        yield batch(_MARK, t.column(keys).to_numpy()[take], t.column(keys + 1).to_numpy()[take], np.ones(len(take), np.int32))


_WIN = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("digests", pa.binary()), ("flags", pa.binary())])
_WIN_DDL = "rid long, start int, n int, h long, digests binary, flags binary"


def _runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set places that no break begins within: their starts and lengths."""
    before = np.concatenate([[False], mask[:-1]])
    starts = np.flatnonzero(mask & (~before | breaks))
    after = np.concatenate([mask[1:], [False]])
    next_breaks = np.concatenate([breaks[1:], [True]])
    ends = np.flatnonzero(mask & (~after | next_breaks))
    return starts, ends - starts + 1


@tidy
def _windows(batches, window):
    """For windows at recurring anchors: known repeats as marks (h null), else digests to compare, by anchor.

    flags has a byte for each window of an anchor: 0 to compare, 1 known already but to compare, 2 without digest."""
    cache, unpack, repeats = WordNames(), zstandard.ZstdDecompressor(), Repeats()
    for b in blocks(batches, most=1_000_000):
        docs = [unpack.decompress(x) for x in b.column(1).to_pylist()]
        w = Words(docs, cache)
        start, anchor = anchors(w.names, w.first, w.last, window)
        want = np.zeros(len(w.names) + 1, bool)
        for i, p in enumerate(b.column(2).to_pylist()):
            want[w.begin[i] + np.array(p, np.int64)] = True
        take = want[anchor]
        start, anchor = start[take], anchor[take]
        if not len(start):
            continue
        d = Rolling(w.checks, _BASE_A)(start, window)
        send, known = repeats(d)
        flags = np.where(send, known.astype(np.uint8), np.uint8(2))
        rids = b.column(0).to_numpy()
        doc, pos = w.doc[start], (start - w.first[start]).astype(np.int32)
        breaks = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(doc) != 0)])
        s, n = _runs(known, breaks)
        if len(s):
            none = pa.nulls(len(s))
            yield batch(_WIN, rids[doc[s]], pos[s], n.astype(np.int32), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()))
        head = np.concatenate([[True], np.diff(anchor) != 0])
        own = np.flatnonzero(head)
        end = np.append(own[1:], len(d))
        live = np.add.reduceat(flags < 2, own) > 0
        own, end = own[live], end[live]
        h = Rolling(w.names, _BASE_B)(anchor[own] - CONTEXT, 2 * CONTEXT).view(np.int64)
        dig = [d[i:j][flags[i:j] < 2].tobytes() for i, j in zip(own.tolist(), end.tolist(), strict=True)]
        raw = flags.tobytes()
        yield batch(_WIN, rids[doc[own]], pos[own], (end - own).astype(np.int32), h, dig, [raw[i:j] for i, j in zip(own.tolist(), end.tolist(), strict=True)])


def _windows_of(t: pa.Table):
    """Of rows (h, rid, start, n, digests, flags) their windows: row, place in it, flag, and the digest where there is one."""
    d = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint64)
    flags = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8)
    n = t.column(3).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(flags)) - np.repeat(np.cumsum(n) - n, n), flags, d


@tidy
def _repeats(batches):
    """Rows (h, rid, start, n, digests, flags) sorted by h: runs of windows whose digest occurs again or is known to."""
    for t, _ in whole_groups(batches, 1):
        row, place, flags, d = _windows_of(t)
        has = flags < 2
        h = t.column(0).to_numpy()[row[has]]
        order = np.lexsort((d, h))
        sd, sh = d[order], h[order]
        group = np.cumsum(np.concatenate([[True], (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1])])) - 1
        again = np.bincount(group) > 1
        again |= np.bincount(group, weights=(flags[has] == 1)[order]) > 0
        mark = np.zeros(len(flags), bool)
        mark[np.flatnonzero(has)[order]] = again[group]
        s, k = _runs(mark & (flags == 0), place == 0)
        starts = t.column(2).to_numpy()
        yield batch(_MARK, t.column(1).to_numpy()[row[s]], (starts[row[s]] + place[s]).astype(np.int32), k.astype(np.int32))


_SINGLE = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("known", pa.bool_())])


@tidy
def _apart(batches):
    """Windows with a digest, a row each."""
    for b in batches:
        t = pa.Table.from_batches([b])
        row, place, flags, d = _windows_of(t)
        has = np.flatnonzero(flags < 2)
        at = row[has]
        yield batch(_SINGLE, t.column(0).to_numpy()[at], d.view(np.int64), t.column(1).to_numpy()[at], (t.column(2).to_numpy()[at] + place[has]).astype(np.int32), flags[has] == 1)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


@tidy
def _cut(batches, window, with_text):
    """doc_id, n_words, sha, packed, marks: the words that stay; where a row is carried, a text that keeps all words as it is."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        removed, shas, kept = [], [], []
        for sha, packed, starts, ns in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
            words = None
            if starts or with_text:
                text = unpack.decompress(packed)
                words = text.split()
            if starts:
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, np.array(starts), 1)
                np.add.at(cover, np.minimum(np.array(starts) + np.array(ns) + window - 1, len(words)), -1)
                stay = np.cumsum(cover)[:-1] == 0
                removed.append(len(words) - int(stay.sum()))
                words = list(itertools.compress(words, stay.tolist()))
                shas.append(_sha(words))
            else:
                removed.append(0)
                shas.append(sha)
            as_is = b.num_columns > 6 and not removed[-1]
            kept.append((text if as_is else b" ".join(words)).decode() if with_text else None)
        yield _with(batch(_OUT, b.column(0), b.column(1), removed, shas, kept), b.column(6) if b.num_columns > 6 else None)


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: Column | None = None, work: Scratch | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space).

    A word goes when a window of so many consecutive words covers it whose sequence also starts anywhere else.
    carry, a column of docs, comes with each row as `row`; a text that keeps all words is then kept as it is."""
    work = work or Scratch(spark, "substrings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def recurring(rows, *keys):
        rows = rows.select(*keys, "rid", "start", "known").repartition(parts, *keys).sortWithinPartitions(*keys)
        return rows.mapInArrow(partial(_recurring, keys=len(keys)), _MARK_DDL)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([] if carry is None else [carry.alias("row")]))
    own, own_ddl = docs.columns[2:], "" if carry is None else f", row {docs.schema['row'].dataType.simpleString()}"
    read = work.write(docs.mapInArrow(partial(_read, window=window), _READ_DDL + own_ddl), "read")
    spots = read.where("pos is not null")
    compared = recurring(spots.where("h is not null").withColumnRenamed("pos", "start"), "h").select("rid", F.col("start").alias("pos"))
    places = spots.where("h is null").select("rid", "pos").union(compared).groupBy("rid").agg(F.collect_list("pos").alias("places"))
    rows = read.where("packed is not null").select("rid", "doc_id", "n_words", "sha", "packed", *own)
    rows = work.write(rows.join(places, "rid", "left"), "rows")
    work.drop("read")
    release(spark)
    found = rows.where("places is not null").select("rid", "packed", "places").mapInArrow(partial(_windows, window=window), _WIN_DDL)
    found = work.write(found, "windows")
    to_compare = found.where("h is not null").select("h", "rid", "start", "n", "digests", "flags")
    hot = work.write(to_compare.groupBy("h").count().where(F.col("count") > MANY).select("h"), "hot")
    marks = found.where("h is null").select("rid", "start", "n")
    if not hot.isEmpty():
        single = to_compare.join(hot, "h", "left_semi").mapInArrow(_apart, "h long, d long, rid long, start int, known boolean")
        marks = marks.union(recurring(single, "h", "d"))
        to_compare = to_compare.join(hot, "h", "left_anti")
    marks = marks.union(to_compare.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_repeats, _MARK_DDL))
    marks = marks.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("m")).select("rid", F.col("m.start").alias("starts"), F.col("m.n").alias("ns"))
    marks = work.write(marks, "marks")
    work.drop("windows")
    release(spark)
    touched = rows.where("places is not null").join(marks, "rid", "left").select("doc_id", "n_words", "sha", "packed", "starts", "ns", *own)
    plain = rows.where("places is null").select("doc_id", "n_words", "sha", "packed", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("ns"), *own)
    return touched.union(plain).mapInArrow(partial(_cut, window=window, with_text=with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + own_ddl)


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(spark, docs, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")
