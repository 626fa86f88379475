"""Exact deduplication with a log-structured merge index.

A task keeps a memtable of digests. When it is full it is flushed as a run: digests in order, with a Bloom
filter; a later document asks the filters of the task's runs before it searches one. Runs of one size are merged
(compaction), so that a document asks few. An entry holds the best row so far (most code points, then smallest
identifier), a count, and the text, packed, so that every hit is verified byte by byte. When the runs of a task hold
more than BYTES they leave it, and it begins anew. Runs of all tasks are dealt by digest and merged in order, again
with verification. A group of copies of any size sends an entry for each task and each BYTES of it, never its rows,
and the merge holds one text of it and two numbers for each entry. Rows then learn what their entry became by a join
on (task, entry), which no group can make hot.

Cases: null counts as empty; texts of white space only equal the empty text; rows that repeat doc_id and text
are copies of which exactly one is kept; a null doc_id comes after any other; an empty table gives an empty result;
other columns are not read."""

from __future__ import annotations

import hashlib
import heapq
import itertools
from bisect import bisect_left
from functools import partial

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, batch, blocks, texts, tidy

_DROP = SPACES.encode()


#: Packed bytes that a task holds at most in its runs.
BYTES = 64 << 20


class Entry:
    __slots__ = ("best", "n", "number", "packed")

    def __init__(self, length, doc, row, packed, number):
        self.best, self.packed, self.number, self.n = self.order(length, doc, row), packed, number, 1

    @staticmethod
    def order(length, doc, row):
        return -length, doc is None, doc or 0, row

    def add(self, length, doc, row):
        self.n += 1
        self.best = min(self.best, self.order(length, doc, row))


class Run:
    """Digests in order, their entries, and a filter of ten bits a digest."""

    def __init__(self, digests: list[bytes], entries: list[list[Entry]]):
        self.digests, self.entries = digests, entries
        self.size = max(64, 10 * len(digests))
        self.bits = bytearray(self.size // 8 + 1)
        for d in self.digests:
            for p in self._places(d):
                self.bits[p >> 3] |= 1 << (p & 7)

    def _places(self, d: bytes):
        return [int.from_bytes(d[i : i + 8], "big") % self.size for i in (0, 8, 16, 24)]

    def get(self, d: bytes) -> list[Entry]:
        if all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(d)):
            i = bisect_left(self.digests, d)
            if i < len(self.digests) and self.digests[i] == d:
                return self.entries[i]
        return []


class LsmIndex:
    """memtable: digests until a flush. Texts of one digest that differ have an entry each."""

    def __init__(self, memtable: int = 20_000):
        self.most, self.table, self.runs, self.count, self.held = memtable, {}, [], 0, 0
        self.pack, self.unpack = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()

    def _entries(self, digest: bytes):
        yield self.table.get(digest, ())
        for r in reversed(self.runs):
            yield r.get(digest)

    def put(self, digest: bytes, text: bytes, length: int, doc: int | None, row: int) -> int:
        """The number of the text's entry."""
        for entries in self._entries(digest):
            for e in entries:
                if self.unpack.decompress(e.packed) == text:  # byte verification
                    e.add(length, doc, row)
                    return e.number
        if len(self.table) >= self.most:
            self.flush()
        entry = Entry(length, doc, row, self.pack.compress(text), self.count)
        self.table.setdefault(digest, []).append(entry)
        self.held += len(entry.packed)
        self.count += 1
        return self.count - 1

    def flush(self) -> None:
        """The memtable becomes a run; while the last two runs are of like size, they are merged."""
        if self.table:
            order = sorted(self.table)
            self.runs.append(Run(order, [self.table[d] for d in order]))
            self.table = {}
        while len(self.runs) > 1 and len(self.runs[-2].digests) <= 2 * len(self.runs[-1].digests):
            a, b = self.runs[-2:]
            digests, entries = [], []
            for d, own in heapq.merge(zip(a.digests, a.entries, strict=True), zip(b.digests, b.entries, strict=True), key=lambda x: x[0]):
                if digests and digests[-1] == d:  # different texts of one digest
                    entries[-1] = entries[-1] + own
                else:
                    digests.append(d)
                    entries.append(own)
            self.runs[-2:] = [Run(digests, entries)]

    def drain(self):
        """(digest, entry) of all runs, which are then empty; numbers of entries go on."""
        self.flush()
        runs, self.runs, self.held = self.runs, [], 0
        for run in runs:
            for d, entries in zip(run.digests, run.entries, strict=True):
                for e in entries:
                    yield d, e


_READ = pa.schema([("task", pa.int64()), ("entry", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("length", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
_READ_DDL = "task long, entry long, row long, doc_id long, digest binary, length long, n long, packed binary"


@tidy
def _index(batches, memtable):
    """A row for each document (digest null) and, as runs leave the task, each of their entries."""
    task, index, row = TaskContext.get().partitionId(), LsmIndex(memtable), 0

    def left():
        for part in itertools.batched(index.drain(), 2000):
            yield batch(_READ, *zip(*((task, e.number, e.best[3], None if e.best[1] else e.best[2], d, -e.best[0], e.n, e.packed) for d, e in part), strict=True))

    for b in blocks(batches):
        entries = []
        ids = b.column(0).to_pylist()
        for i, t in enumerate(texts(b.column(1))):
            norm = t.translate(None, _DROP)
            length = len(t) if t.isascii() else len(t.decode())
            entries.append(index.put(hashlib.sha256(norm).digest(), norm, length, ids[i], row + i))
        n = len(ids)
        none = pa.nulls(n)
        yield batch(_READ, [task] * n, entries, list(range(row, row + n)), b.column(0), *(none.cast(f.type) for f in list(_READ)[4:]))
        row += n
        if index.held > BYTES:
            yield from left()
    yield from left()


_MERGED = pa.schema([("task", pa.int64()), ("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_task", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
_MERGED_DDL = "task long, entry long, keep_id long, keep_task long, keep_row long, group_size long, text_sha256 string"


@tidy
def _compact(batches):
    """Entries in order of digest: those of one digest and equal bytes become one group."""
    unpack = zstandard.ZstdDecompressor()

    def groups(digest, kinds):
        for _, best, size, members in kinds:
            _, no_id, doc, task, row = best
            for t, e in members:
                yield t, e, None if no_id else doc, task, row, size, digest.hex()

    kinds, digest = [], None  # of a digest, for each text: [packed, order of the best row, rows, (task, entry) of its entries]
    for b in batches:
        out = []
        for task, entry, row, doc, d, length, n, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if d != digest:
                out += groups(digest, kinds)
                kinds, digest = [], d
            best = (-length, doc is None, doc or 0, task, row)
            own = next((k for k in kinds if k[0] == packed or unpack.decompress(k[0]) == unpack.decompress(packed)), None)
            if own is None:
                kinds.append([packed, best, n, [(task, entry)]])
            else:
                own[1], own[2] = min(own[1], best), own[2] + n
                own[3].append((task, entry))
            if len(out) > 10_000:
                yield batch(_MERGED, *zip(*out, strict=True))
                out = []
        if out:
            yield batch(_MERGED, *zip(*out, strict=True))
    if out := list(groups(digest, kinds)):
        yield batch(_MERGED, *zip(*out, strict=True))


def exact_duplicates(spark: SparkSession, docs: DataFrame, memtable: int = 20_000, id_col: str = "doc_id", text_col: str = "text", work: Scratch | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    The tables runs and index are written to work, whose owner may drop them when the rows have been read."""
    work = work or Scratch(spark, "exact")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = work.write(docs.mapInArrow(partial(_index, memtable=memtable), _READ_DDL), "runs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = read.where("digest is not null").repartition(parts, "digest").sortWithinPartitions("digest", "task", "entry")
    merged = work.write(entries.mapInArrow(_compact, _MERGED_DDL), "index")
    rows = read.where("digest is null").select("task", "entry", "row", "doc_id")
    kept = F.expr("keep_task = task and keep_row = row").alias("kept")
    return rows.join(merged, ["task", "entry"]).select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""
