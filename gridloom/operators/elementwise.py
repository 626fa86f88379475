"""Point-wise operators: one projection each."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame, ArrayPair
from ..functions import complex as C


def _v():
    return F.col("re"), F.col("im")


def calc(a: ArrayFrame, name: str) -> ArrayFrame:
    if name not in C.FUNCTIONS:
        raise ValueError(f"unknown function {name}")
    a = a.densify() if name in C.NEEDS_ALL else a
    return a.with_values(*C.FUNCTIONS[name](_v()))


def cabs(a):
    return calc(a, "zabs")


def carg(a):
    return calc(a, "zarg")


def conj(a):
    return calc(a, "zconj")


def creal(a):
    return calc(a, "zreal")


def cpyphs(a):
    return calc(a, "zphsr")


def zexp(a, imaginary: bool = False):
    a = a.densify()
    return a.with_values(*(C.exp((-F.col("im"), F.col("re"))) if imaginary else C.exp(_v())))


def scale(a, factor):
    return a.with_values(*C.mul(_v(), C.cx(factor)))


def spow(a, exponent):
    return (a.densify() if exponent == 0 else a).with_values(*C.power(_v(), exponent))


def invert(a, regularisation: float = 0.0):
    """1/x with 1/0 = 0, or conj(x) / (|x|^2 + r)."""
    if regularisation:
        q = C.absq(_v()) + regularisation
        return a.with_values(F.col("re") / q, -F.col("im") / q)
    return a.with_values(*C.div(C.cx(1), _v()))


def compare(a, b, name: str):
    """A comparison or extreme of two arrays, cell by cell (absent cells are zeros)."""
    from .reduce import paired

    if name not in C.COMPARISONS:
        raise ValueError(f"unknown comparison {name}")
    p = paired(a.densify(), b)
    re, im = C.COMPARISONS[name](_v(), (F.col("re2"), F.col("im2")))
    return ArrayFrame(p.select(*a.keys, re.alias("re"), im.alias("im")), a.dims)


def saxpy(factor, x, y=None):
    """factor * x + y; x may be a pair of both."""
    if isinstance(x, ArrayPair):
        re, im = C.mul(_v(), C.cx(factor))
        return ArrayFrame(x.df.select(*x.keys, (re + F.col("re2")).alias("re"), (im + F.col("im2")).alias("im")), x.dims)
    if x.dims != y.dims:
        raise ValueError("sizes differ")
    both = scale(x, factor).df.unionByName(y.df)
    return ArrayFrame(both.groupBy(*x.keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im")), x.dims)


def fftmod(a, flags: int, inverse: bool = False):
    """The phase that moves the origin to the centre: exp of 2 pi i (k - c/2) c / n for each flagged dimension, c = n // 2."""
    angle = F.lit(0.0)
    for k in a.selected(flags):
        n = a.dims[k]
        c = n // 2
        angle = angle + (F.col(f"d{k}") - c / 2) * (2 * math.pi * c / n)
    return a.with_values(*C.mul(_v(), C.polar(F.lit(1.0), -angle if inverse else angle)))


def window_taper(a, flags: int, hann: bool = False):
    """Hamming or Hann weights over the flagged dimensions."""
    w = F.lit(1.0)
    for k in a.selected(flags):
        c = F.cos(F.col(f"d{k}") * (2 * math.pi / (a.dims[k] - 1)))
        w = w * (0.5 - 0.5 * c if hann else 0.54 - 0.46 * c)
    return a.with_values(F.col("re") * w, F.col("im") * w)


def _joined(a, flags: int, value):
    """The rows of a with a value aggregated over the flagged dimensions (column m): an aggregation and a join, no window."""
    from .contract import BROADCAST_CELLS

    rest = a.complement(flags)
    if not rest:
        return a.df.crossJoin(F.broadcast(a.df.agg(value.alias("m"))))
    known = a.df.groupBy(*rest).agg(value.alias("m"))
    small = math.prod(a.dims[int(c[1:])] for c in rest) <= BROADCAST_CELLS
    return a.df.join(F.broadcast(known) if small else known, rest)


def normalize(a, flags: int, l1: bool = False, ordered: bool = False):
    """Division by the norm over the flagged dimensions; 0/0 is 0.

    Ordered: norms are added in index order, each in one task, so that their last bits do not depend on files and tasks."""
    total = F.sum(C.mag(_v()) if l1 else C.absq(_v()))
    if ordered:
        w = Window.partitionBy(*a.complement(flags)).orderBy(*(f"d{k}" for k in reversed(a.selected(flags))))
        df = a.df.withColumn("m", total.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    else:
        df = _joined(a, flags, total)
    m = F.col("m") if l1 else F.sqrt("m")
    return ArrayFrame(df.select(*a.keys, C.safe(F.col("re"), m).alias("re"), C.safe(F.col("im"), m).alias("im")), a.dims)


def soft_threshold(a, level: float, joint: int = 0):
    """Magnitudes shrink by level; jointly: the norm over the flagged dimensions does."""
    df = _joined(a, joint, F.sqrt(F.sum(C.absq(_v())))) if joint else a.df.withColumn("m", C.mag(_v()))
    f = C.safe(F.greatest(F.col("m") - level, F.lit(0.0)), F.col("m"))
    return ArrayFrame(df.select(*a.keys, (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im")), a.dims)


def hard_threshold(a, level: float):
    keep = C.mag(_v()) > level
    return a.with_values(F.when(keep, F.col("re")).otherwise(0.0), F.when(keep, F.col("im")).otherwise(0.0))


def binary_threshold(a, level: float):
    return a.with_values(F.when(C.mag(_v()) > level, 1.0).otherwise(0.0), F.lit(0.0))


def top_k_mask(a, k: int, flags: int):
    """One where the magnitude is larger than the (k+1)-th largest over the flagged dimensions (ties there drop)."""
    rest = a.complement(flags)
    df = a.df.withColumn("m", C.mag(_v()))
    if rest:  # only k + 1 rows of a group and task are exchanged
        w = Window.partitionBy(*rest).orderBy(F.desc("m"))
        first = df.select(*rest, "m", F.row_number().over(w).alias("r")).where(F.col("r") <= k + 1)
        limit = first.groupBy(*rest).agg(F.max(F.when(F.col("r") == k + 1, F.col("m"))).alias("limit"))
        df = df.join(limit, rest)
    else:
        first = df.select("m").orderBy(F.desc("m")).limit(k + 1)
        df = df.crossJoin(F.broadcast(first.agg(F.when(F.count(F.lit(1)) == k + 1, F.min("m")).alias("limit"))))
    df = df.withColumn("limit", F.coalesce("limit", F.lit(0.0)))
    return ArrayFrame(df.select(*a.keys, F.when(F.col("m") > F.col("limit"), 1.0).otherwise(0.0).alias("re"), F.lit(0.0).alias("im")), a.dims)


def looklocker(a, threshold: float = 0.2, delay: float = 0.0):
    """T1 = M0 / (Mss R1*) + 2 delay from the coefficients (Mss, M0, R1*) in dim 6; 0 where Mss is below the threshold."""
    rest = a.complement(1 << 6)
    pick = lambda i: F.max(F.when(F.col("d6") == i, C.mag(_v())))
    df = a.df.groupBy(*rest).agg(pick(0).alias("mss"), pick(1).alias("m0"), pick(2).alias("r1s"))
    t1 = F.when(F.coalesce("mss", F.lit(0.0)) < threshold, 0.0).otherwise(C.safe(F.coalesce("m0", F.lit(0.0)), F.coalesce(F.col("mss") * F.col("r1s"), F.lit(0.0))) + 2 * delay)
    return ArrayFrame(df.select(*rest, t1.alias("re"), F.lit(0.0).alias("im")), a.replace_dims(d6=1))


def fovshift(a, **shift: float):
    """Linear phase of a shift of the field of view, in pixels of each dimension."""
    angle = F.lit(0.0)
    for name, s in shift.items():
        k = int(name[1:])
        if a.dims[k] > 1:
            angle = angle + (F.col(name) - a.dims[k] // 2) * (2 * math.pi * s / a.dims[k])
    return a.with_values(*C.mul(_v(), C.polar(F.lit(1.0), angle)))
