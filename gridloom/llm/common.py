"""Helpers shared by the operators: scratch tables, hashing, Arrow output."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of the class [\x20\x09-\x0D]; bytes.split() and bytes.strip() know the same six.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def remix(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes of 64-bit values."""
    return mix(x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and Spark runs in one process (tests), a temporary one is set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", place)
        atexit.register(lambda: __import__("shutil").rmtree(place[7:], ignore_errors=True))
    return place


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more, or all of them."""
        with contextlib.suppress(Exception):  # the session may have ended
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bitmaps of 4096 numbers, of about 1 KB each, that among() sends to executors at most.
CHUNKS = 1 << 16


def among(rows: DataFrame, numbers: DataFrame, column: str, work: Scratch, name: str) -> DataFrame:
    """The rows whose number in this bigint column is one of numbers (a column of that name). Rows keep their places: no row is shuffled.

    Numbers go to all executors as bitmaps: for 4096 numbers a map from word number to bits, of words with a one. They
    are few where numbers are dense, as those that tasks count up. Where there are more than CHUNKS, rows are shuffled."""
    words = numbers.groupBy(F.shiftright(column, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits"))
    entry = F.struct(F.expr("cast(at & 63 as int)").alias("word"), "bits")
    maps = work.write(words.groupBy(F.shiftright("at", 6).alias("chunk")).agg(F.map_from_entries(F.collect_list(entry)).alias("words")), name)
    if maps.count() > CHUNKS:
        return rows.join(numbers.select(column), column, "left_semi")
    bit = f"shiftright(try_element_at(words, cast(shiftright({column}, 6) & 63 as int)), cast({column} & 63 as int)) & 1L"
    return rows.join(F.broadcast(maps), (F.shiftright(column, 12) == F.col("chunk")) & (F.expr(bit) == 1), "left_semi")


def release(spark: SparkSession) -> None:
    """Ask the driver to notice which shuffles of earlier jobs nothing refers to, so that their files go."""
    import gc

    gc.collect()
    with contextlib.suppress(Exception):
        spark.sparkContext._jvm.System.gc()


@functools.cache
def _trim():
    """The C library's call that gives free memory back, or None where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def tidy(work):
    """For functions over batches: when one ends, Arrow and the C library give back what they hold for later, as Python workers live on."""

    @functools.wraps(work)
    def run(*args, **kwargs):
        try:
            yield from work(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := _trim()) is not None:
                trim(0)

    return run


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def blocks(batches, column: int = 1, most: int = 2_000_000):
    """Batches of at most so many bytes in this column, but one row at least."""
    for b in batches:
        size, start = 0, 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        for i in range(b.num_rows):
            if i > start and ends[i] - size > most:
                yield b.slice(start, i - start)
                start, size = i, ends[i - 1]
        if b.num_rows > start:
            yield b.slice(start)


def whole_groups(batches, keys: int):
    """Rows that come sorted by their first `keys` columns, as tables in which every group is whole: (table, starts of its groups).

    A table has the groups that a batch completes, so what is held is a batch and one group."""
    held: list[pa.RecordBatch] = []

    def out(rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        if t.num_rows:
            yield t, np.concatenate([[0], changes(t)])

    def changes(t):
        new = np.zeros(t.num_rows, bool)
        for k in range(keys):
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        at = changes(b)
        last = int(at[-1]) if len(at) else 0
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(keys)):
            yield from out([*held, b.slice(0, last)])
            held = []
        elif last:
            yield from out([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield from out(held)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
