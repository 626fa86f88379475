"""ArrayFrame: a multidimensional complex array as a relation keyed by its indices.

Columns are d<k> for every dimension whose size is not 1, then re and im (double). An absent row is a zero, so
masks, padding and scattered data cost nothing; operators that need every cell say so and call densify().
Index order is column-major: dimension 0 runs fastest. Sets of dimensions are bitmasks (flags)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANK = 16
READ, PHS1, PHS2, COIL, MAPS, TE, COEFF, COEFF2, ITER, CSHIFT, TIME, TIME2, LEVEL, SLICE, AVG, BATCH = range(RANK)


def normalise_dims(dims) -> tuple[int, ...]:
    dims = tuple(int(d) for d in dims)
    if len(dims) > RANK or any(d < 1 for d in dims):
        raise ValueError(f"at most {RANK} dimensions of size 1 or more: {dims}")
    return dims + (1,) * (RANK - len(dims))


def flag_dims(flags: int) -> list[int]:
    return [k for k in range(RANK) if flags >> k & 1]


def bitmask(*dims: int) -> int:
    return sum(1 << k for k in set(dims))


def strides(dims) -> list[int]:
    out, s = [], 1
    for d in dims:
        out.append(s if d > 1 else 0)
        s *= d
    return out


def key_type(size: int) -> str:
    """The type of an index column of a dimension of that size."""
    return "int" if size <= 1 << 31 else "bigint"


def ravel(dims, names=None) -> Column:
    """Column-major linear index over dims."""
    names = names or [f"d{k}" for k in range(len(dims))]
    terms = [F.col(n).cast("long") * s for n, d, s in zip(names, dims, strides(dims), strict=True) if d > 1]
    return sum(terms[1:], terms[0]) if terms else F.lit(0).cast("long")


def unravel(index: Column, dims) -> dict[int, Column]:
    """Index columns of the non-trivial dims from a linear index."""
    out, s = {}, 1
    for k, d in enumerate(dims):
        if d > 1:
            out[k] = F.pmod(F.call_function("div", index, F.lit(s)) if s > 1 else index, F.lit(d)).cast(key_type(d))
            s *= d
    return out


@dataclass(frozen=True)
class ArrayFrame:
    df: DataFrame
    dims: tuple[int, ...]

    @staticmethod
    def of(df: DataFrame, dims) -> ArrayFrame:
        dims = normalise_dims(dims)
        keys = [f"d{k}" for k, d in enumerate(dims) if d > 1]
        return ArrayFrame(df.select(*(F.col(c).cast(key_type(dims[int(c[1:])])).alias(c) for c in keys), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")), dims)

    @staticmethod
    def from_numpy(spark: SparkSession, a) -> ArrayFrame:
        import numpy as np
        import pyarrow as pa

        dims = normalise_dims(a.shape)
        flat = np.asarray(a, complex).ravel(order="F")
        idx = np.unravel_index(np.arange(flat.size), dims, order="F")
        cols = {f"d{k}": idx[k].astype(np.int32) for k, d in enumerate(dims) if d > 1}
        return ArrayFrame.of(spark.createDataFrame(pa.table(cols | {"re": flat.real.copy(), "im": flat.imag.copy()})), dims)

    def to_numpy(self):
        """The whole array on the driver; for small results."""
        import numpy as np

        t = self.df.toPandas()
        out = np.zeros(self.dims, complex)
        idx = tuple(t[f"d{k}"].to_numpy() if d > 1 else np.zeros(len(t), int) for k, d in enumerate(self.dims))
        np.add.at(out, idx, t["re"].to_numpy() + 1j * t["im"].to_numpy())
        while out.ndim > 1 and out.shape[-1] == 1:
            out = out[..., 0]
        return out

    @property
    def keys(self) -> list[str]:
        return [f"d{k}" for k, d in enumerate(self.dims) if d > 1]

    @property
    def size(self) -> int:
        return math.prod(self.dims)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def complement(self, flags: int) -> list[str]:
        return [f"d{k}" for k, d in enumerate(self.dims) if d > 1 and not flags >> k & 1]

    def selected(self, flags: int) -> list[int]:
        return [k for k, d in enumerate(self.dims) if d > 1 and flags >> k & 1]

    def extent(self, flags: int) -> int:
        return math.prod(d for k, d in enumerate(self.dims) if flags >> k & 1)

    def with_values(self, re: Column, im: Column) -> ArrayFrame:
        return ArrayFrame(self.df.select(*self.keys, re.cast("double").alias("re"), im.cast("double").alias("im")), self.dims)

    def replace_dims(self, **sizes: int) -> tuple[int, ...]:
        return tuple(sizes.get(f"d{k}", d) for k, d in enumerate(self.dims))

    def densify(self) -> ArrayFrame:
        """A row for every cell."""
        from .operators.generate import zeros

        grid = zeros(self.spark, self.dims).df.select(*self.keys)
        df = grid.join(self.df, self.keys, "left") if self.keys else self.df
        return ArrayFrame(df.select(*self.keys, F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im")), self.dims)

    def sparsify(self) -> ArrayFrame:
        return ArrayFrame(self.df.where("re <> 0 or im <> 0"), self.dims)


@dataclass(frozen=True)
class ArrayPair:
    """Two arrays of equal sizes over one table: re, im and re2, im2 of each cell, so that no join is needed to meet them."""

    df: DataFrame
    dims: tuple[int, ...]

    @property
    def keys(self) -> list[str]:
        return [f"d{k}" for k, d in enumerate(self.dims) if d > 1]

    @property
    def size(self) -> int:
        return math.prod(self.dims)

    @property
    def first(self) -> ArrayFrame:
        return ArrayFrame(self.df.select(*self.keys, "re", "im"), self.dims)

    @property
    def second(self) -> ArrayFrame:
        return ArrayFrame(self.df.select(*self.keys, F.col("re2").alias("re"), F.col("im2").alias("im")), self.dims)


def kept(df: DataFrame) -> DataFrame:
    """Rows written to the checkpoint folder of the session, so that rounds do not pile up; in place where there is none (tests)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gridloom-"))
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()
