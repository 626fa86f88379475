"""Vector bin packing of examples into training sequences.

An example has a demand for each of three limits: tokens, segments (a piece is one) and loss-bearing tokens. A
sequence is filled greedily: of the pieces that fit under all three limits the one with the largest dot product
of its demand and what is left in the sequence (both as shares of the limits) goes in. Where nothing fits and
examples may be cut, the largest is cut to fill what is left. Tasks pack alone: no shuffle, no open sequence is
shared, and a task holds a pool of POOL pieces. One sequence of a task at most ends unfilled for want of
pieces; others only where the limits on segments or loss leave nothing that fits. Where examples may be cut, the
last tokens of a task become sequences whose lengths are powers of two, which need no padding.

Cases: null is an empty text and has only the end id; texts longer than a sequence are cut; repeated rows are
packed each; an empty table gives an empty result; other columns are not read. A sequence is named by its task
(partition) and number there, so a rerun of a task gives the same rows."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE, load
from .common import batch, blocks, tidy

#: Pieces among which a task chooses.
POOL = 256
#: Pieces of a sequence at most, where documents are packed (their loss-bearing tokens are all their tokens).
SEGMENTS = 64


class Packer:
    """put() takes demands of one example and yields placed pieces (key, start, length, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool):
        self.limits, self.cut = np.array(limits, float), cut
        self.tokens, self.max_segments, self.max_loss = limits
        self.demand = np.zeros((POOL, 3))  # what the pool's pieces need
        self.keys: list[tuple | None] = [None] * POOL  # (key, start, length, loss)
        self.n, self.sequence = 0, 0
        self.left, self.room = self.limits.copy(), limits[0]  # room: tokens that the open sequence is to hold

    def _place(self, key, start, length, loss):
        offset = int(self.room - self.left[0])
        self.left -= (length, 1, loss)
        return key, start, length, self.sequence, offset

    def _close(self):
        if self.left[0] < self.room:
            self.sequence += 1
            self.left, self.room = self.limits.copy(), self.tokens

    def _shorten(self):
        """Where the pool no longer fills the open sequence, let it end at the largest power of two that is filled."""
        used = self.room - int(self.left[0])
        reach = used + int(self.demand[: self.n, 0].sum())
        room = 1 << (reach.bit_length() - 1)
        if self.room == self.tokens and used <= room and reach < self.tokens:
            self.left[0], self.room = room - used, room
            if used == room:
                self.sequence += 1
                self.left, self.room = self.limits.copy(), self.tokens

    def put(self, key, tokens: int, loss: int | None = None):
        """loss: loss-bearing tokens, at the end of the example; None: all."""
        loss = tokens if loss is None else loss
        start = 0
        if not self.cut and (tokens > self.tokens or loss > self.max_loss):
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, is beyond the limits and may not be cut")
        while tokens - start > self.tokens:  # full sequences of their own
            self._store(key, start, self.tokens, max(0, start + self.tokens - (tokens - loss)) - max(0, start - (tokens - loss)))
            yield from self._drain(POOL - 1)
            start += self.tokens
        if tokens > start:
            self._store(key, start, tokens - start, min(loss, tokens - start))
            yield from self._drain(POOL - 1)

    def _store(self, key, start, length, loss):
        self.keys[self.n] = (key, start, length, loss)
        self.demand[self.n] = (length, 1, loss)
        self.n += 1

    def _take(self, i):
        item = self.keys[i]
        self.n -= 1
        self.keys[i], self.demand[i] = self.keys[self.n], self.demand[self.n]
        return item

    def _drain(self, most: int):
        while self.n > most:
            if self.cut and most == 0:
                self._shorten()
            d = self.demand[: self.n]
            score = np.where((d <= self.left).all(1), d @ (self.left / self.limits**2), -1)
            i = int(score.argmax())
            if score[i] >= 0:
                yield self._place(*self._take(i))
            elif self.cut and self.left[0] >= 1 and self.left[1] >= 1:
                i = int(d[:, 0].argmax())
                key, start, length, loss = self._take(i)
                room = int(min(self.left[0], length - 1))
                free = length - loss  # tokens without loss come first
                room = int(min(room, free + self.left[2]))
                if room <= 0:
                    self._store(key, start, length, loss)
                    self._close()
                    continue
                part = max(0, room - free)
                yield self._place(key, start, room, part)
                self._store(key, start + room, length - room, loss - part)
            else:
                self._close()
            if self.left[0] == 0:
                self._close()

    def finish(self):
        yield from self._drain(0)


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@tidy
def _pack(batches, path, limits, end, with_ids, forget):
    bpe, packer = load(path, CACHE // 3 if forget else CACHE), Packer(limits, cut=True)
    base, tail = TaskContext.get().partitionId() << 32, np.uint32(end).tobytes()
    held: dict[int, list] = {}  # documents with pieces still to place: doc_id, ids, tokens left
    count = 0

    def rows(placed):
        out = []
        for key, start, length, sequence, offset in placed:
            doc = held[key]
            part = doc[1][4 * start : 4 * (start + length)]
            out.append((doc[0], start, length, zlib.crc32(part), len(doc[1]) // 4, base + sequence, offset, part if with_ids else None))
            doc[2] -= length
            if not doc[2]:
                del held[key]
        return out

    for b in blocks(batches):
        out = []
        for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = bpe.encode(t.as_py() or "") + tail
            held[count] = [doc_id, ids, len(ids) // 4]
            out += rows(packer.put(count, len(ids) // 4))
            count += 1
        if out:
            yield batch(_OUT, *zip(*out, strict=True))
    if out := rows(packer.finish()):
        yield batch(_OUT, *zip(*out, strict=True))
    if forget:
        load.cache_clear()


def pack_documents(docs: DataFrame, path: str, tokens: int = 1024, segments: int | None = None, loss_tokens: int | None = None, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, forget: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    forget: tasks remember fewer fragments and drop them and the vocabulary at their end, for executors that do other work, too.
    Documents are ids of their text and then the id `end`, all loss-bearing; a limit of None is that of tokens."""
    limits = (tokens, segments or tokens, loss_tokens or tokens)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(partial(_pack, path=path, limits=limits, end=end, with_ids=with_ids, forget=forget), _DDL)


_EXAMPLE = pa.schema([("example_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@tidy
def _pack_whole(batches, limits):
    packer, base, ids = Packer(limits, cut=False), TaskContext.get().partitionId() << 32, []

    def rows(placed):
        out = [(ids[key], base + sequence, offset) for key, _, _, sequence, offset in placed]
        return [batch(_EXAMPLE, *zip(*out, strict=True))] if out else []

    for b in batches:
        for i, tokens, loss in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if tokens:
                ids.append(i)
                yield from rows(packer.put(len(ids) - 1, tokens, loss))
    yield from rows(packer.finish())


def pack_examples(examples: DataFrame, tokens: int, segments: int, loss_tokens: int) -> DataFrame:
    """Whole instruction examples (example_id, tokens, loss_tokens) under all three limits: example_id, sequence_id, offset.

    An example beyond a limit is an error; one without tokens (or null) is not placed; null loss is none."""
    cols = [F.col(c).cast("long").alias(c) for c in ("example_id", "tokens")] + [F.coalesce(F.col("loss_tokens").cast("long"), F.lit(0)).alias("loss_tokens")]
    return examples.select(*cols).mapInArrow(partial(_pack_whole, limits=(tokens, segments, loss_tokens)), "example_id long, sequence_id long, offset long")


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), segments=SEGMENTS, with_ids=False).drop("ids")
