"""Operators along one dimension in order: Spark windows over the other dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame, kept
from ..functions import complex as C


#: Cells of a stretch along a dimension that one window holds, and groups from which on whole lines are spread enough.
STRETCH, SPREAD = 1 << 16, 256


def _w(a: ArrayFrame, dim: int, stretched: bool = False):
    rest = a.complement(1 << dim) + (["stretch"] if stretched else [])
    return Window.partitionBy(*rest).orderBy(f"d{dim}")


def _with(a, dims, df):
    return ArrayFrame(df.select(*(f"d{k}" for k, d in enumerate(dims) if d > 1), "re", "im"), dims)


def _long(a: ArrayFrame, dim: int) -> bool:
    """Whether lines along dim are few and long, so that they are to be cut."""
    return a.dims[dim] > STRETCH and math.prod(a.dims[int(c[1:])] for c in a.complement(1 << dim)) < SPREAD


def _stretched(a: ArrayFrame, dim: int, before: int, after: int):
    """The rows of a in stretches along dim; so many rows before and after one come along (own false)."""
    i = F.col(f"d{dim}")
    at = F.call_function("div", i, F.lit(STRETCH))
    near = [F.struct(at.alias("s"), F.lit(True).alias("own"))]
    for step in range(1, math.ceil(max(before, after) / STRETCH) + 1):
        near.append(F.when((at - step >= 0) & (i < (at - step + 1) * STRETCH + after), F.struct((at - step).alias("s"), F.lit(False).alias("own"))))
        near.append(F.when(i >= (at + step) * STRETCH - before, F.struct((at + step).alias("s"), F.lit(False).alias("own"))))
    df = a.df.withColumn("place", F.explode(F.filter(F.array(*near), lambda x: x.isNotNull())))
    return df.select("*", F.col("place.s").alias("stretch"), F.col("place.own").alias("own")).drop("place")


def _over(a: ArrayFrame, dim: int, before: int, after: int, values):
    """values(window) over each cell's neighbourhood, as new columns; every cell once."""
    if _long(a, dim):
        return _stretched(a, dim, before, after).withColumns(values(_w(a, dim, True))).where("own")
    return a.df.withColumns(values(_w(a, dim)))


def moving_average(a, dim: int, length: int):
    """Means of the valid windows; the index is where the window starts."""
    a = a.densify()
    df = _over(a, dim, 0, length - 1, lambda w: {c: F.avg(c).over(w.rowsBetween(0, length - 1)) for c in ("re", "im")})
    return _with(a, a.replace_dims(**{f"d{dim}": a.dims[dim] - length + 1}), df.where(F.col(f"d{dim}") <= a.dims[dim] - length))


def moving_median(a, dim: int, length: int):
    """Medians by magnitude of the valid windows; of two middle values the mean."""
    a = a.densify()
    value = F.struct(C.mag((F.col("re"), F.col("im"))).alias("m"), F.col("re").alias("r"), F.col("im").alias("i"))
    df = _over(a, dim, 0, length - 1, lambda w: {"s": F.sort_array(F.collect_list(value).over(w.rowsBetween(0, length - 1)))})
    df = df.where(F.col(f"d{dim}") <= a.dims[dim] - length)
    lo, hi = F.col("s")[(length - 1) // 2], F.col("s")[length // 2]
    df = df.withColumns({"re": (lo["r"] + hi["r"]) / 2, "im": (lo["i"] + hi["i"]) / 2})
    return _with(a, a.replace_dims(**{f"d{dim}": a.dims[dim] - length + 1}), df)


def geometric_median(a, flags: int, iterations: int = 50):
    """The point of least sum of distances to the cells along the flagged dimensions, by Weiszfeld steps from their mean."""
    a = a.densify()
    rest = a.complement(flags)
    df = a.df.groupBy(*rest).agg(F.collect_list(F.struct("re", "im")).alias("p"))
    start = F.struct((F.aggregate("p", F.lit(0.0), lambda s, x: s + x["re"]) / F.size("p")).alias("x"), (F.aggregate("p", F.lit(0.0), lambda s, x: s + x["im"]) / F.size("p")).alias("y"))

    def move(at, _):
        none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))

        def add(s, q):
            w = 1 / F.greatest(F.hypot(q["re"] - at["x"], q["im"] - at["y"]), F.lit(1e-12))
            return F.struct((s["x"] + w * q["re"]).alias("x"), (s["y"] + w * q["im"]).alias("y"), (s["w"] + w).alias("w"))

        s = F.aggregate("p", none, add)
        return F.transform(F.array(s), lambda t: F.struct((t["x"] / t["w"]).alias("x"), (t["y"] / t["w"]).alias("y")))[0]

    df = df.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, move))
    return _with(a, a.replace_dims(**{f"d{k}": 1 for k in a.selected(flags)}), df.select(*rest, F.col("m.x").alias("re"), F.col("m.y").alias("im")))


def cumsum(a, dim: int):
    """Sums from the first cell on. Long lines: sums within stretches, and the sums of the stretches before."""
    a = a.densify()
    upto = (Window.unboundedPreceding, 0)
    if not _long(a, dim):
        w = _w(a, dim).rowsBetween(*upto)
        return _with(a, a.dims, a.df.withColumns({"re": F.sum("re").over(w), "im": F.sum("im").over(w)}))
    rest = a.complement(1 << dim)
    df = a.df.withColumn("stretch", F.call_function("div", F.col(f"d{dim}"), F.lit(STRETCH)))
    sums = df.groupBy(*rest, "stretch").agg(F.sum("re").alias("r"), F.sum("im").alias("i"))
    w = Window.partitionBy(*rest).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*rest, "stretch", *(F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in ("r", "i")))
    w = _w(a, dim, True).rowsBetween(*upto)
    df = df.join(before, [*rest, "stretch"]).withColumns({"re": F.col("r") + F.sum("re").over(w), "im": F.col("i") + F.sum("im").over(w)})
    return _with(a, a.dims, df)


def _difference(a, dim, step, zero):
    """x[i] - x[i + step]; at the end the other end's cell, or the cell itself."""
    from .index import circshift

    a = a.densify()
    shifted = F.lag if step < 0 else F.lead
    edge = 0 if step < 0 else a.dims[dim] - 1
    df = _over(a, dim, 1, 1, lambda w: {f"{c}2": shifted(c).over(w) for c in ("re", "im")})
    if zero or a.dims[dim] == 1:
        other = [F.coalesce(f"{c}2", c) for c in ("re", "im")]
        return _with(a, a.dims, df.select(*a.keys, (F.col("re") - other[0]).alias("re"), (F.col("im") - other[1]).alias("im")))
    last = circshift(ArrayFrame(a.df.where(F.col(f"d{dim}") == (a.dims[dim] - 1 - edge)), a.dims), dim, -step)
    ends = df.where(F.col(f"d{dim}") == edge).drop("re2", "im2").join(last.df.withColumnsRenamed({"re": "re2", "im": "im2"}), a.keys)
    df = df.where(F.col(f"d{dim}") != edge).select(*a.keys, "re", "im", "re2", "im2").unionByName(ends.select(*a.keys, "re", "im", "re2", "im2"))
    return _with(a, a.dims, df.select(*a.keys, (F.col("re") - F.col("re2")).alias("re"), (F.col("im") - F.col("im2")).alias("im")))


def forward_difference(a, dim: int, zero: bool = False):
    """x[i] - x[i-1]; the first wraps around, or is zero."""
    return _difference(a, dim, -1, zero)


def backward_difference(a, dim: int, zero: bool = False):
    """x[i] - x[i+1]; the last wraps around, or is zero."""
    return _difference(a, dim, 1, zero)


def gradient(a, flags: int, out_dim: int):
    """Cyclic forward differences x[i+1] - x[i] of every flagged dimension, side by side along out_dim."""
    from .elementwise import scale
    from .index import join

    return join(out_dim, *(scale(backward_difference(a, k), -1.0) for k in a.selected(flags)))


def detrend(a, dim: int):
    """Lines along dim without their mean and slope (least squares): sums, and a join on the other dimensions."""
    from .elementwise import _joined

    a = a.densify()
    n, x = a.dims[dim], F.col(f"d{dim}") - (a.dims[dim] - 1) / 2
    sums = F.struct(*(F.sum(F.col(c) * (x if k else 1.0)).alias(f"{c}{k}") for c in ("re", "im") for k in (0, 1)))
    df = _joined(a, 1 << dim, sums)
    spread = n * (n * n - 1) / 12 or 1.0
    fit = {c: F.col(c) - F.col(f"m.{c}0") / n - F.col(f"m.{c}1") / spread * x for c in ("re", "im")}
    return _with(a, a.dims, df.withColumns(fit))


def quadrature_bins(a, dim: int, pair_dim: int, bins: int, shift: float = 0.0):
    """Bins of the angle that two signals (places 0 and 1 of pair_dim) make, along dim: equal sectors, counted from `shift`."""
    rest = a.complement(1 << pair_dim)
    pick = lambda k: F.coalesce(F.max(F.when(F.col(f"d{pair_dim}") == k, F.col("re"))), F.lit(0.0))
    df = a.df.groupBy(*rest).agg(pick(0).alias("x"), pick(1).alias("y"))
    turn = F.pmod(F.atan2("y", "x") - shift, F.lit(2 * math.pi))
    at = F.least(F.floor(turn * (bins / (2 * math.pi))), F.lit(bins - 1))
    return _with(a, a.replace_dims(**{f"d{pair_dim}": 1}), df.select(*rest, at.cast("double").alias("re"), F.lit(0.0).alias("im")))


def amplitude_bins(a, dim: int, bins: int):
    """Bins of equal counts of the real part along dim: by rank, ties by index."""
    a = a.densify()
    w = Window.partitionBy(*a.complement(1 << dim)).orderBy("re", f"d{dim}")
    rank = F.call_function("div", (F.row_number().over(w) - 1) * bins, F.lit(a.dims[dim]))
    return _with(a, a.dims, a.df.select(*a.keys, rank.cast("double").alias("re"), F.lit(0.0).alias("im")))


def unwrap(a, dim: int, bound: float):
    """Jumps of the real part of more than half the bound are taken back."""
    a = a.densify()
    step = F.col("re") - F.coalesce(F.lag("re").over(_w(a, dim)), F.col("re"))
    turns = F.when(step > 0, -F.floor(step / bound + 0.5)).otherwise(-F.ceil(step / bound - 0.5))
    df = a.df.withColumn("t", turns)
    df = df.withColumns({"re": F.col("re") + bound * F.sum("t").over(_w(a, dim).rowsBetween(Window.unboundedPreceding, 0)), "im": F.lit(0.0)})
    return _with(a, a.dims, df)


def bin_labels(a, labels: ArrayFrame, dim: int, cluster_dim: int):
    """Cells along dim move to (their number among cells of their label, label): row_number per label."""
    w = Window.partitionBy("re").orderBy(f"d{dim}")
    lab = labels.densify().df.select(f"d{dim}", F.col("re").cast("int").alias("label"), (F.row_number().over(w) - 1).alias("n"))
    top = lab.agg(F.max("label"), F.max("n")).first()
    df = a.df.join(lab, f"d{dim}").drop(f"d{dim}").withColumns({f"d{dim}": F.col("n"), f"d{cluster_dim}": F.col("label")})
    dims = a.replace_dims(**{f"d{dim}": int(top[1]) + 1, f"d{cluster_dim}": int(top[0]) + 1})
    return ArrayFrame.of(df, dims)


def reorder(a, order: ArrayFrame, dim: int):
    """out[i] = a[order[i]] along dim: a gather join."""
    o = order.densify().df.select(F.col(f"d{dim}").alias("to"), F.col("re").cast("int").alias(f"d{dim}"))
    df = a.df.join(o, f"d{dim}").drop(f"d{dim}").withColumnRenamed("to", f"d{dim}")
    return ArrayFrame.of(df, a.replace_dims(**{f"d{dim}": order.dims[dim]}))


def hankel_gram(a, dim: int, window: int):
    """Gram matrix (window x window) of the lagged copies of a series."""
    x = a.df.select(F.col(f"d{dim}").alias("t"), "re", "im")
    lag = x.select("t", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("i"), "re", "im").withColumn("p", F.col("t") - F.col("i")).where((F.col("p") >= 0) & (F.col("p") <= a.dims[dim] - window))
    other = lag.select("p", F.col("i").alias("j"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    re, im = C.mul((F.col("re"), F.col("im")), C.conj((F.col("re2"), F.col("im2"))))
    df = lag.join(other, "p").groupBy(F.col("i").alias("d0"), F.col("j").alias("d1")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return ArrayFrame.of(df, [window, window])


def morph(a, flags: int, erode: bool = False, size: int = 3):
    """Binary dilation or erosion by a block of odd size, cyclic."""
    r, own = size // 2, a.selected(flags)
    df, dims = a.sparsify().df, a.dims
    for k in own:
        grown = df.withColumn("s", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn(f"d{k}", F.pmod(F.col(f"d{k}") + F.col("s"), F.lit(dims[k])).cast("int"))
        g = grown.groupBy(*a.keys).agg(F.count(F.lit(1)).alias("n"))
        df = g.where(F.col("n") >= (size if erode else 1)).select(*a.keys, F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return ArrayFrame(df, dims)


def morph_open(a, flags, size=3):
    return morph(morph(a, flags, True, size), flags, False, size)


def morph_close(a, flags, size=3):
    return morph(morph(a, flags, False, size), flags, True, size)


def morph_ball(a, flags: int, erode: bool = False, size: int = 3):
    """Binary dilation or erosion by a ball of odd diameter, cyclic: offsets within the radius."""
    import itertools

    own, r = a.selected(flags), size // 2
    at = [o for o in itertools.product(range(-r, r + 1), repeat=len(own)) if sum(x * x for x in o) <= r * r]
    offsets = F.array(*(F.array(*map(F.lit, o)) for o in at))
    grown = a.sparsify().df.withColumn("o", F.explode(offsets))
    grown = grown.select(*(F.pmod(F.col(c) + F.col("o")[own.index(int(c[1:]))], F.lit(a.dims[int(c[1:])])).cast("int").alias(c) if int(c[1:]) in own else F.col(c) for c in a.keys))
    found = grown.groupBy(*a.keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (len(at) if erode else 1))
    return ArrayFrame(found.select(*a.keys, F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), a.dims)


def label(a, flags: int, rounds: int = 64):
    """Connected regions of non-zero cells (neighbours along each flagged dimension), numbered from 1 by their first cell.

    Every cell takes the least cell of its neighbourhood and then the one that that cell has taken, until nothing
    changes; each round is written out (checkpoint)."""
    from ..frame import ravel

    keys = a.keys
    cells = a.sparsify().df.select(*keys, ravel(a.dims).alias("id"))
    steps, s = [], 1
    for k, d in enumerate(a.dims):
        if d > 1 and flags >> k & 1:
            steps.append((k, s))
        s *= d
    links = None
    for k, s in steps:
        moved = cells.select(*(F.col(c) + 1 if c == f"d{k}" else F.col(c) for c in keys), F.col("id").alias("other"))
        moved = moved.toDF(*keys, "other")
        part = cells.join(moved, keys).select("id", "other")
        links = part if links is None else links.union(part)
    links = links.union(links.select(F.col("other").alias("id"), F.col("id").alias("other")))
    links = kept(links)
    now = cells.select("id", F.col("id").alias("root"))
    for _ in range(rounds):
        near = links.join(now.select(F.col("id").alias("other"), F.col("root").alias("r")), "other").groupBy("id").agg(F.min("r").alias("r"))
        new = now.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        up = now.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = kept(new.join(up, "root").select("id", "old", F.least("root", "top").alias("root")))
        done = new.where("root <> old").isEmpty()
        now = new.select("id", "root")
        if done:
            break
    else:
        raise ValueError("more rounds are needed")
    first = now.select("root").distinct()
    number = first.withColumn("n", F.row_number().over(Window.orderBy("root")))  # of regions
    df = cells.join(now, "id").join(number, "root")
    return ArrayFrame(df.select(*keys, F.col("n").cast("double").alias("re"), F.lit(0.0).alias("im")), a.dims)
