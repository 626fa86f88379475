"""Reductions over a set of dimensions: GROUP BY the others. Sums and counts combine before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..frame import ArrayFrame, ArrayPair, flag_dims
from ..functions import complex as C


def _v():
    return F.col("re"), F.col("im")


def _reduced(a: ArrayFrame, flags: int, re, im=None) -> ArrayFrame:
    rest = a.complement(flags)
    df = a.df.groupBy(*rest).agg(re.alias("re"), (F.max(F.lit(0.0)) if im is None else im).alias("im"))
    return ArrayFrame(df, a.replace_dims(**{f"d{k}": 1 for k in flag_dims(flags)}))


def total(a, flags: int):
    return _reduced(a, flags, F.sum("re"), F.sum("im"))


def avg(a, flags: int, nonzero: bool = False):
    """The mean over all cells, or over those that are not zero (0 where there is none)."""
    n = F.count_if((F.col("re") != 0) | (F.col("im") != 0)).cast("double") if nonzero else F.lit(float(a.extent(flags)))
    return _reduced(a, flags, C.safe(F.sum("re"), n), C.safe(F.sum("im"), n))


def var(a, flags: int):
    """Sample variance (n - 1) of complex values; absent cells count as zeros."""
    n = float(a.extent(flags))
    k = F.count(F.lit(1)).cast("double")
    part = lambda c: F.var_pop(c) * k + F.avg(c) * F.avg(c) * k * (n - k) / n  # noqa: E731  squares about the mean of all n
    return _reduced(a, flags, (part("re") + part("im")) / (n - 1))


def std(a, flags: int):
    v = var(a, flags)
    return v.with_values(F.sqrt("re"), F.lit(0.0))


def rss(a, flags: int):
    return _reduced(a, flags, F.sqrt(F.sum(C.absq(_v()))))


def mip(a, flags: int, minimum: bool = False, absolute: bool = False):
    """max(0, max of real parts), or the least real part, bounded by that maximum."""
    a = a.densify()
    x = C.mag(_v()) if absolute else F.col("re")
    top = F.greatest(F.lit(0.0), F.max(x))
    return _reduced(a, flags, F.least(F.min(x), top) if minimum else top)


def pattern(a, flags: int):
    """One where anything along the flagged dimensions is not zero."""
    return _reduced(a, flags, F.max(F.when((F.col("re") != 0) | (F.col("im") != 0), 1.0).otherwise(0.0)))


def reduce_sets(a, flag_sets):
    """Sums over several sets of dimensions in one pass: GROUPING SETS."""
    keys = a.keys
    sets = [[F.col(c) for c in a.complement(f)] for f in flag_sets]
    return a.df.groupingSets(sets, *map(F.col, keys)).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.grouping_id().alias("set"))


def paired(a, b=None):
    """Cells of two arrays of equal sizes side by side (or of a pair, as they are); absent ones are zeros."""
    if isinstance(a, ArrayPair):
        return a.df
    if a.dims != b.dims:
        raise ValueError("sizes differ")
    other = b.df.withColumnsRenamed({"re": "re2", "im": "im2"})
    df = a.df.join(other, a.keys, "full") if a.keys else a.df.crossJoin(other)
    return df.fillna(0.0, ["re", "im", "re2", "im2"])


def sdot(a, b=None) -> complex:
    """Sum of a conj(b)."""
    z = C.mul(_v(), C.conj((F.col("re2"), F.col("im2"))))
    r = paired(a, b).agg(F.sum(z[0]).alias("re"), F.sum(z[1]).alias("im")).first()
    return complex(r.re or 0, r.im or 0)


def nrmse(reference, a=None, scaled: bool = False) -> float:
    """Root mean square error over that of the reference; scaled: after the best complex scaling of a."""
    p = paired(reference, a)
    r, x = _v(), (F.col("re2"), F.col("im2"))
    z = C.mul(r, C.conj(x))
    s = p.agg(F.sum(C.absq(r)).alias("rr"), F.sum(C.absq(x)).alias("xx"), F.sum(z[0]).alias("zr"), F.sum(z[1]).alias("zi"), F.sum((r[0] - x[0]) ** 2 + (r[1] - x[1]) ** 2).alias("dd")).first()
    if not s.rr:
        return 0.0 if not s.dd else math.inf
    if scaled:
        return math.sqrt(max(0.0, s.rr - ((s.zr**2 + s.zi**2) / s.xx if s.xx else 0.0)) / s.rr)
    return math.sqrt(s.dd / s.rr)


def measure(reference, a=None) -> dict:
    """Mean squared errors (complex, and of magnitudes) and peak signal-to-noise ratio."""
    p = paired(reference, a)
    r, x = _v(), (F.col("re2"), F.col("im2"))
    s = p.agg(F.sum((r[0] - x[0]) ** 2 + (r[1] - x[1]) ** 2).alias("d"), F.sum((C.mag(r) - C.mag(x)) ** 2).alias("m"), F.max(C.mag(r)).alias("top")).first()
    n = reference.size
    mse, mag = s.d / n, s.m / n
    return {"mse": mse, "mse_mag": mag, "psnr": 20 * math.log10(s.top / math.sqrt(mag)) if mag else math.inf}


def roistat(roi, a, bessel: bool = False, by: int | None = None):
    """(count, sum, mean, std, var, energy) of a within each slice of a mask.

    Slices are the dimensions that only one of both has, or those flagged in `by` (of the mask)."""
    weights = roi.df.where("re <> 0").select(*roi.keys, F.col("re").alias("w"))
    shared = [k for k in roi.keys if k in a.keys]
    df = weights.join(a.df, shared) if shared else weights.crossJoin(a.df)
    groups = [k for k in dict.fromkeys([*roi.keys, *a.keys]) if (not (k in roi.keys and k in a.keys) if by is None else by >> int(k[1:]) & 1)]
    x = F.col("re") * F.col("w")
    v = F.var_samp(x) if bessel else F.var_pop(x)
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.sqrt(v).alias("std"), v.alias("var"), F.sum(x * x).alias("energy"))


def union(a, b):
    """Cells where either mask is not zero, as ones."""
    both = a.sparsify().df.unionByName(b.sparsify().df)
    return ArrayFrame(both.select(*a.keys).distinct().select(*a.keys, F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), a.dims)


def intersect(a, b):
    """Cells of a where the mask b is not zero."""
    return ArrayFrame(a.sparsify().df.join(b.sparsify().df.select(*a.keys), a.keys, "left_semi"), a.dims)


def subtract(a, b):
    """Cells of a where the mask b is zero."""
    return ArrayFrame(a.sparsify().df.join(b.sparsify().df.select(*a.keys), a.keys, "left_anti"), a.dims)


def confusion(a, b, classes: int):
    """Counts of cells by class in a (dim 0) and in b (dim 1); cells of neither are not counted."""
    p = a.df.join(b.df.select(*b.keys, F.col("re").alias("re2")), a.keys)
    df = p.groupBy(F.col("re").cast("int").alias("d0"), F.col("re2").cast("int").alias("d1")).agg(F.count(F.lit(1)).cast("double").alias("re"))
    return ArrayFrame.of(df.withColumn("im", F.lit(0.0)), [classes, classes])


def accuracy(a, b) -> float:
    """The share of cells of equal class."""
    r = a.df.join(b.df.select(*b.keys, F.col("re").alias("re2")), a.keys).agg(F.avg((F.col("re") == F.col("re2")).cast("double"))).first()
    return r[0] or 0.0


def dice(a, b, label: float = 1.0) -> float:
    """Twice the common cells of a label over the cells of it in both."""
    p = a.df.join(b.df.select(*b.keys, F.col("re").alias("re2")), a.keys, "full")
    x, y = F.coalesce(F.col("re") == label, F.lit(False)), F.coalesce(F.col("re2") == label, F.lit(False))
    r = p.agg(F.count_if(x & y).alias("both"), F.count_if(x).alias("x"), F.count_if(y).alias("y")).first()
    return 2 * r.both / (r.x + r.y) if r.x + r.y else 1.0


def cross_entropy(p, q) -> float:
    """Mean over cells of -log q where the one-hot p is one, categorical."""
    both = p.sparsify().df.select(*p.keys).join(q.df, p.keys, "left")
    r = both.agg(F.avg(-F.log(F.greatest(F.coalesce("re", F.lit(0.0)), F.lit(1e-30))))).first()
    return r[0] or 0.0


def norms(a) -> dict:
    """Sum and largest of magnitudes, root of squares, and mean absolute deviation from the mean real part."""
    m = C.mag(_v())
    s = a.df.agg(F.sum(m).alias("l1"), F.sum(C.absq(_v())).alias("l2"), F.max(m).alias("top"), F.sum("re").alias("total")).first()
    mean = (s.total or 0.0) / a.size
    mad = (a.densify().df.agg(F.sum(F.abs(F.col("re") - mean))).first()[0] or 0.0) / a.size
    return {"l1": s.l1 or 0.0, "l2": math.sqrt(s.l2 or 0.0), "max": s.top or 0.0, "mad": mad}


def percentile(a, flags: int, share: float):
    """The order statistic of magnitudes at a share of the cells of the flagged dimensions, interpolated."""
    a = a.densify()
    return _reduced(a, flags, F.percentile(C.mag(_v()), share))


def centre_of_mass(labels, weights=None):
    """(label, d<k>.., n): the mean place of the cells of each label that is not zero, weighted on request."""
    df = labels.sparsify().df.select(*labels.keys, F.col("re").alias("label"))
    if weights is not None:
        df = df.join(weights.df.select(*weights.keys, F.col("re").alias("w")), labels.keys)
    else:
        df = df.withColumn("w", F.lit(1.0))
    return df.groupBy("label").agg(*((F.sum(F.col(k) * F.col("w")) / F.sum("w")).alias(k) for k in labels.keys), F.count(F.lit(1)).alias("n"))


def mutual_information(a, b, bins: int, low: float = 0.0, high: float = 1.0) -> float:
    """Of the magnitudes of two arrays in a joint histogram of equal bins between low and high (values beyond are in the last ones)."""
    p = paired(a, b)
    at = lambda v: F.least(F.greatest(F.floor((C.mag(v) - low) * (bins / (high - low))), F.lit(0)), F.lit(bins - 1))
    h = p.groupBy(at(_v()).alias("i"), at((F.col("re2"), F.col("im2"))).alias("j")).agg(F.count(F.lit(1)).alias("n")).collect()
    n = sum(r.n for r in h)
    absent = a.size - n  # cells that neither has are zeros
    joint, left, right = {}, {}, {}
    zero = min(max(int((0.0 - low) * (bins / (high - low))), 0), bins - 1)
    for i, j, k in [(r.i, r.j, r.n) for r in h] + ([(zero, zero, absent)] if absent > 0 else []):
        joint[i, j] = joint.get((i, j), 0) + k
        left[i], right[j] = left.get(i, 0) + k, right.get(j, 0) + k
    return sum(k / a.size * math.log(k * a.size / (left[i] * right[j])) for (i, j), k in joint.items())


def ssim(reference, a, flags: int, window: int = 7) -> float:
    """Mean structural similarity of magnitudes over the valid windows of the flagged dimensions; range: the reference's largest."""
    from .window import moving_average

    p = paired(reference, a)
    x, y = C.mag(_v()), C.mag((F.col("re2"), F.col("im2")))
    top = p.agg(F.max(x)).first()[0] or 0.0
    keys, own, found = reference.keys, reference.selected(flags), None
    for name, value in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y)):
        m = ArrayFrame(p.select(*keys, value.alias("re"), F.lit(0.0).alias("im")), reference.dims)
        for k in own:
            m = moving_average(m, k, window)
        part = m.df.select(*m.keys, F.col("re").alias(name))
        found = part if found is None else found.join(part, m.keys)
    c1, c2, n = (0.01 * top) ** 2, (0.03 * top) ** 2, window ** len(own)
    f = n / (n - 1)
    vx, vy, vxy = (f * (F.col("xx") - F.col("x") ** 2), f * (F.col("yy") - F.col("y") ** 2), f * (F.col("xy") - F.col("x") * F.col("y")))
    s = (2 * F.col("x") * F.col("y") + c1) * (2 * vxy + c2) / ((F.col("x") ** 2 + F.col("y") ** 2 + c1) * (vx + vy + c2))
    return found.agg(F.avg(s)).first()[0]


def hist(a, component_dim: int, size: int):
    """Joint histogram of the components along a dimension: bin = ceil(size (x + 0.5)), kept in [0, size)."""
    n = a.dims[component_dim]
    rest = a.complement(1 << component_dim)
    bins = F.ceil(size * (F.col("re") + 0.5)).cast("int")
    if n == 1:
        df = a.df.select(bins.alias("d0")).where(f"d0 >= 0 and d0 < {size}").groupBy("d0").agg(F.count(F.lit(1)).cast("double").alias("re"))
    else:
        df = a.densify().df.groupBy(*rest).agg(*(F.max(F.when(F.col(f"d{component_dim}") == i, bins)).alias(f"b{i}") for i in range(n)))
        ok = " and ".join(f"b{i} >= 0 and b{i} < {size}" for i in range(n))
        df = df.where(ok).groupBy(*(F.col(f"b{i}").alias(f"d{i}") for i in range(n))).agg(F.count(F.lit(1)).cast("double").alias("re"))
    return ArrayFrame.of(df.withColumn("im", F.lit(0.0)), [size] * max(1, n))


def onehotenc(a, dim: int):
    """Class indices to one-hot along a dimension of size 1; the number of classes is the largest index and one."""
    n = int(a.df.agg(F.max("re")).first()[0]) + 1
    df = a.densify().df.select(*a.keys, F.col("re").cast("int").alias(f"d{dim}"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return ArrayFrame.of(df, a.replace_dims(**{f"d{dim}": n}))


def onehotdec(a, dim: int):
    """The index of the largest real part along a dimension; of equal ones the smallest."""
    return _reduced(a.densify(), 1 << dim, F.max_by(F.col(f"d{dim}").cast("double"), F.struct("re", (-F.col(f"d{dim}")).alias("i"))))
