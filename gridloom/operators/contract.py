"""Contraction: equality joins on shared dimensions, then sums. Products, matrix multiplication, convolution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..frame import ArrayFrame, ArrayPair, flag_dims
from ..functions import complex as C

#: Cells up to which one side of a contraction is broadcast; its size is known from its dims.
BROADCAST_CELLS = 1 << 16
#: Values of which a covariance is made on the driver at most.
MATRIX = 4096


def fmac(a: ArrayFrame | ArrayPair, b: ArrayFrame | None = None, squash: int = 0, conj: bool = False) -> ArrayFrame:
    """a * b (b conjugated on request, ones if missing), summed over the squashed dimensions; a may be a pair of both."""
    if isinstance(a, ArrayPair):
        other = (F.col("re2"), F.col("im2"))
        re, im = C.mul((F.col("re"), F.col("im")), C.conj(other) if conj else other)
        from .reduce import total

        out = ArrayFrame(a.df.select(*a.keys, re.alias("re"), im.alias("im")), a.dims)
        return total(out, squash) if out.selected(squash) else out
    if b is None:
        from .reduce import total

        return total(a, squash)
    for x, y in zip(a.dims, b.dims, strict=True):
        if x != y and 1 not in (x, y):
            raise ValueError("sizes are not compatible")
    shared = [k for k in a.keys if k in b.keys]
    left, right = a.df, b.df.withColumnsRenamed({"re": "re2", "im": "im2"})
    if b.size <= BROADCAST_CELLS:
        right = F.broadcast(right)
    elif a.size <= BROADCAST_CELLS:
        left = F.broadcast(left)
    both = left.join(right, shared) if shared else left.crossJoin(right)
    other = (F.col("re2"), F.col("im2"))
    re, im = C.mul((F.col("re"), F.col("im")), C.conj(other) if conj else other)
    dims = tuple(max(x, y) for x, y in zip(a.dims, b.dims, strict=True))
    out = ArrayFrame(both.select(*(f"d{k}" for k, d in enumerate(dims) if d > 1), re.alias("re"), im.alias("im")), dims)
    if not any(squash >> k & 1 and d > 1 for k, d in enumerate(dims)):
        return ArrayFrame(out.df, tuple(1 if k in flag_dims(squash) else d for k, d in enumerate(dims)))
    from .reduce import total

    return total(out, squash)


def fmac_with_statistics(a: ArrayPair, squash: int):
    """(index columns, product re and im, mean of the first array where it is not zero, n) in one aggregation over the squashed dimensions."""
    re, im = C.mul((F.col("re"), F.col("im")), (F.col("re2"), F.col("im2")))
    rest = [f"d{k}" for k, d in enumerate(a.dims) if d > 1 and not squash >> k & 1]
    n = F.count_if((F.col("re") != 0) | (F.col("im") != 0))
    return a.df.groupBy(*rest).agg(F.sum(re).alias("re"), F.sum(im).alias("im"), C.safe(F.sum("re"), n.cast("double")).alias("mean"), n.alias("n"))


def matmul(a, b):
    """(d0, d1) times (d1, d2), as (d0, d2)."""
    return fmac(a, b, squash=2)


def conv(a, kernel, flags: int):
    """Cyclic convolution with the kernel's centre (n // 2) as origin: a bounded number of shifted copies, then sums."""
    own = [k for k in flag_dims(flags) if a.dims[k] > 1]
    if any(kernel.dims[k] > 1 and k not in own and a.dims[k] != kernel.dims[k] for k in range(len(a.dims))):
        raise ValueError("sizes are not compatible")
    names = {f"d{k}": f"k{k}" for k in own if kernel.dims[k] > 1}
    right = kernel.df.withColumnsRenamed(names | {"re": "re2", "im": "im2"})
    right = F.broadcast(right) if kernel.size <= BROADCAST_CELLS else right
    shared = [k for k in a.keys if k in kernel.keys and k not in names]
    both = a.df.join(right, shared) if shared else a.df.crossJoin(right)
    re, im = C.mul((F.col("re"), F.col("im")), (F.col("re2"), F.col("im2")))
    cols = [F.pmod(F.col(f"d{k}") + F.col(f"k{k}") - kernel.dims[k] // 2, F.lit(a.dims[k])).cast("int").alias(f"d{k}") if f"d{k}" in names else F.col(f"d{k}") for k in range(len(a.dims)) if a.dims[k] > 1]
    df = both.select(*cols, re.alias("re"), im.alias("im")).groupBy(*a.keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return ArrayFrame(df, a.dims)


def covariance(a, sample_flags: int, centre: bool = True) -> np.ndarray:
    """Covariance (n - 1) of the one remaining dimension over the sampled ones; small, on the driver.

    A task adds up the matrix of the samples it holds, one triangle and block by block, and sends it once."""
    own = a.complement(sample_flags)
    if len(own) != 1:
        raise ValueError("one dimension must remain")
    k, n = int(own[0][1:]), a.extent(sample_flags)
    m = a.dims[k]
    if m > MATRIX:
        raise ValueError(f"a covariance of {m} values does not fit the driver")
    keys = [c for c in a.keys if c != own[0]]
    value = F.struct(F.col(own[0]).cast("int").alias("i"), "re", "im")
    rows = a.df.groupBy(*keys).agg(F.collect_list(value).alias("v")).select("v")

    def gram(batches):
        import pyarrow as pa

        out, mean = np.zeros((m, m), complex), np.zeros(m, complex)
        for b in batches:
            lists = b.column(0)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            i = flat.field("i").to_numpy()
            z = flat.field("re").to_numpy() + 1j * flat.field("im").to_numpy()
            for s in range(0, len(lists), 4096):
                at = slice(*np.searchsorted(row, [s, min(s + 4096, len(lists))]))
                x = np.zeros((min(4096, len(lists) - s), m), complex)
                x[row[at] - s, i[at]] = z[at]
                out += x.T @ x.conj()
                mean += x.sum(0)
        ij = np.argwhere(np.triu(np.ones((m, m), bool)) & (out != 0))
        found = out[ij[:, 0], ij[:, 1]]
        i, j = np.append(ij[:, 0], np.arange(m)), np.append(ij[:, 1], np.full(m, -1))
        z = np.append(found, mean)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(z.real), pa.array(z.imag)], names=["i", "j", "re", "im"])

    found = rows.mapInArrow(gram, "i int, j int, re double, im double").groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect()
    out, mean = np.zeros((m, m), complex), np.zeros(m, complex)
    for r in found:
        if r.j < 0:
            mean[r.i] = complex(r.re, r.im) / n
        else:
            out[r.i, r.j], out[r.j, r.i] = complex(r.re, r.im), complex(r.re, -r.im)
    return (out - n * np.outer(mean, mean.conj())) / (n - 1) if centre else out


def apply_matrix(a, m: np.ndarray, dim: int):
    """Multiplication along a dimension by a small matrix."""
    from ..frame import ArrayFrame as A

    spark = a.spark
    rows = [(int(i), int(j), float(z.real), float(z.imag)) for (i, j), z in np.ndenumerate(np.asarray(m, complex))]
    mat = F.broadcast(spark.createDataFrame(rows, f"o int, d{dim} int, re2 double, im2 double"))
    re, im = C.mul((F.col("re"), F.col("im")), (F.col("re2"), F.col("im2")))
    rest = a.complement(1 << dim)
    df = a.df.join(mat, f"d{dim}").groupBy(*rest, "o").agg(F.sum(re).alias("re"), F.sum(im).alias("im")).withColumnRenamed("o", f"d{dim}")
    dims = a.replace_dims(**{f"d{dim}": m.shape[0]})
    return A.of(df, dims)


def cc(a, dim: int, channels: int):
    """Compression of a dimension to its principal components: (array, matrix)."""
    c = covariance(a, ((1 << 16) - 1) ^ (1 << dim), centre=False)
    w, v = np.linalg.eigh(c)
    m = v[:, np.argsort(-w)][:, :channels].conj().T
    return apply_matrix(a, m, dim), m


def whiten(a, noise, dim: int):
    """Whitening of a dimension by the inverse Cholesky factor of a noise covariance."""
    c = covariance(noise, ((1 << 16) - 1) ^ (1 << dim))
    m = np.linalg.inv(np.linalg.cholesky(c))
    return apply_matrix(a, m, dim), m
