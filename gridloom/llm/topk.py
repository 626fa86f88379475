"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers. A vector's slice of significance b is a bitmap over its attributes: which
of them have bit b set (two's complement, the highest slice counts negative). The inner product of two vectors
is the sum over pairs of slices of 2^(a+b) times the bits set in their intersection, so it comes from AND, bit
counts and shifted additions. Slices of the candidates are added from the most significant down; after each, the
bits still to come bound every score from both sides, and rows whose upper bound falls below the k-th largest
lower bound leave. The boundary rows left at the end have exact scores; ties go to the smaller identifier.

The index is a table: a row for each block of candidates with its slices, packed, in the order of their identifiers.
It is written once and read by every search; queries come as blocks of integers, and each of them meets each block of
the index. Every such task returns k rows a query, and a second step merges them. Nothing is broadcast or collected.

Cases: vectors null, empty, or with null or non-finite components take no part; vectors of unequal length are
compared as if padded with zeros; a quantised component beyond 31 bits is an error, as scores are 64-bit integers;
repeated rows are candidates each; queries repeated whole are one query, and queries of one identifier with
different vectors have ranks of their own; a candidate is excluded by the query's identifier; rows without
identifier take no part; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy

#: Rows of a block of queries, and of candidates.
QUERY_BLOCK, ROW_BLOCK = 1024, 10_000


def slices(x: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps over attributes: (rows, bits, words) of 64 attributes each, least significant slice first."""
    n, d = x.shape
    words = -(-d // 64)
    padded = np.zeros((n, 64 * words), np.int64)
    padded[:, :d] = x
    out = np.empty((n, bits, words), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def bits_for(x: np.ndarray) -> int:
    """Bits of two's complement that hold all values."""
    if not x.size:
        return 1
    return int(max(int(x.max()), -int(x.min()) - 1, 0)).bit_length() + 1


def _weights(bits: int) -> list[int]:
    return [1 << b for b in range(bits - 1)] + [-(1 << (bits - 1))]


def _quantise(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of usable rows, their integers, shorter rows padded with zeros)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(row, weights=~np.isfinite(flat), minlength=len(lengths)) > 0
    good = np.flatnonzero((lengths > 0) & ~bad)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = ~bad[row]
    whole = np.floor(scale * flat[keep])
    if np.abs(whole).max(initial=0) >= 1 << 31:
        raise ValueError("a quantised component is beyond 31 bits")
    out[row[keep], place[keep]] = whole.astype(np.int64)
    return good, out[good]


def _chunks(batches, scale, size):
    """(identifiers, row numbers of their batch, quantised vectors, batch) of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            good, x = _quantise(part.column(1), scale)
            if len(good):
                yield part.column(0).to_numpy(zero_copy_only=False)[good].astype(np.int64), good, x, part


_QUERIES = pa.schema([("q_ids", pa.binary()), ("q_numbers", pa.binary()), ("q_values", pa.binary()), ("q_dims", pa.int32())])
_INDEX = pa.schema([("ids", pa.binary()), ("slices", pa.binary()), ("bits", pa.int32()), ("dims", pa.int32())])
_INDEX_DDL = "ids binary, slices binary, bits int, dims int"


@tidy
def _query_blocks(batches, scale, size):
    """Blocks of queries (identifier, vector, number)."""
    for ids, good, x, part in _chunks(batches, scale, size):
        numbers = part.column(2).to_numpy()[good]
        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([numbers.tobytes()]), pa.array([x.tobytes()]), pa.array([x.shape[1]], pa.int32())], schema=_QUERIES)


@tidy
def _index_blocks(batches, scale, size):
    """Blocks of the index: slices as (bits, words of 64 attributes, rows), rows in the order of identifiers."""
    for ids, _, x, _ in _chunks(batches, scale, size):
        order = np.argsort(ids, kind="stable")  # a smaller identifier wins a tie
        x, bits = x[order], bits_for(x)
        own = np.ascontiguousarray(slices(x, bits).transpose(1, 2, 0))
        yield pa.RecordBatch.from_arrays([pa.array([ids[order].tobytes()]), pa.array([own.tobytes()]), pa.array([bits], pa.int32()), pa.array([x.shape[1]], pa.int32())], schema=_INDEX)


def build_index(spark: SparkSession, rows: DataFrame, scale: float, work: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The bit-sliced index of rows, written: ids, slices, bits, dims."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null")
    return work.write(rows.repartition(parts).mapInArrow(partial(_index_blocks, scale=scale, size=ROW_BLOCK), _INDEX_DDL), "index")


def block_top_k(q: np.ndarray, q_ids: np.ndarray, xs: np.ndarray, x_ids: np.ndarray, k: int):
    """(identifiers, scores) of each query's k best rows of one block of the index (xs: its slices)."""
    xb, words = xs.shape[:2]
    d = max(q.shape[1], 64 * words)
    q = np.pad(q, ((0, 0), (0, d - q.shape[1])))[:, : 64 * words]  # beyond the block's attributes is nothing to add
    qb = bits_for(q)
    qs = slices(q, qb)
    qw, xw = _weights(qb), _weights(xb)
    top, low = np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)  # what one slice adds at most and at least
    for i in range(len(q)):
        rows = np.flatnonzero(x_ids != q_ids[i])
        score = np.zeros(len(rows), np.int64)
        full = len(rows) == len(x_ids)
        for b in range(xb - 1, -1, -1):
            part = np.zeros(len(rows), np.int32 if qb + 7 + d.bit_length() < 31 else np.int64)
            for w in range(words):
                own = xs[b, w] if full else xs[b, w][rows]
                for a in range(qb):
                    if qs[i, a, w]:
                        part += np.bitwise_count(own & qs[i, a, w]).astype(part.dtype) * part.dtype.type(qw[a])
            score += part.astype(np.int64) * xw[b]
            rest = (1 << b) - 1
            if b and len(rows) > 4 * k:
                kth = np.partition(score, len(score) - k)[len(score) - k] + rest * low[i]
                stay = score + rest * top[i] >= kth
                if 2 * stay.sum() < len(rows):
                    rows, score, full = rows[stay], score[stay], False
        best = np.lexsort((rows, -score))[:k]
        yield x_ids[rows[best]], score[best]


_HIT = pa.schema([("query_id", pa.int64()), ("number", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@tidy
def _search(batches, k):
    for b in batches:
        for q_ids, numbers, values, q_dims, ids, packed, bits, dims in zip(*(c.to_pylist() for c in b.columns), strict=True):
            q_ids, numbers, x_ids = (np.frombuffer(x, np.int64) for x in (q_ids, numbers, ids))
            q, xs = np.frombuffer(values, np.int64).reshape(-1, q_dims), np.frombuffer(packed, np.uint64).reshape(bits, -(-dims // 64), len(x_ids))
            hits = list(block_top_k(q, q_ids, xs, x_ids, k))
            n = [len(h[0]) for h in hits]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.repeat(numbers, n)), pa.array(np.concatenate([h[0] for h in hits])), pa.array(np.concatenate([h[1] for h in hits]))], schema=_HIT)


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int, scale: float, work: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of the index of largest inner product."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null").distinct()
    queries = work.write(queries.withColumn("number", F.monotonically_increasing_id()), "queries")
    q = queries.repartition(max(1, parts // 12)).mapInArrow(partial(_query_blocks, scale=scale, size=QUERY_BLOCK), "q_ids binary, q_numbers binary, q_values binary, q_dims int")
    pairs = q.crossJoin(index)  # of blocks: each query block is scored against each block of the index
    hits = pairs.mapInArrow(partial(_search, k=k), "query_id long, number long, vec_id long, score long")
    w = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(spark: SparkSession, queries: DataFrame, rows: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of largest inner product of floor(scale * x)."""
    work = Scratch(spark, "topk")
    index = build_index(spark, rows, scale, work, id_col, vector_col)
    return search(spark, index, queries, k, scale, work, id_col, vector_col)


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(spark, v.where("vec_id % 50 = 0"), v, k=5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), qs AS (
  SELECT row_number() OVER () AS number, * FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0)
), s AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM qs q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
