"""Proximal operators and projections as plans over arrays: prox(x) = argmin 1/2 |z - x|^2 + level f(z)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions import complex as C
from . import algorithms as A
from . import elementwise, linops, reduce
from .linops import LinOp

D = F.col


def _v():
    return D("re"), D("im")


def zero(x: ArrayFrame, level: float = 0.0) -> ArrayFrame:
    """Of f = 0."""
    return x


def soft(x, level: float, joint: int = 0):
    """Of the l1 norm, or of norms over the flagged dimensions."""
    return elementwise.soft_threshold(x, level, joint)


def transformed_soft(x, level: float, transform: LinOp, joint: int = 0):
    """Of the l1 norm of a unitary transform."""
    return transform.adjoint(soft(transform(x), level, joint))


def wavelet_soft(x, level: float, flags: int, kind: str = "dau2", coarsest: int = 16):
    return transformed_soft(x, level, linops.wavelet(x.dims, flags, kind, coarsest))


def hard(x, level: float):
    """Of the number of cells that are not zero: smaller magnitudes than sqrt(2 level) go."""
    return elementwise.hard_threshold(x, math.sqrt(2 * level))


def largest(x, k: int, flags: int):
    """The k largest magnitudes over the flagged dimensions stay."""
    mask = elementwise.top_k_mask(x, k, flags).df.where("re <> 0").select(*x.keys)
    return ArrayFrame(x.df.join(mask, x.keys, "left_semi"), x.dims)


def least_squares(x, level: float, reference: ArrayFrame | None = None):
    """Of 1/2 |z - reference|^2."""
    if reference is not None:
        x = elementwise.saxpy(level, reference, x)
    return elementwise.scale(x, 1 / (1 + level))


def weighted_least_squares(x, level: float, reference: ArrayFrame, weights: ArrayFrame):
    """Of 1/2 |weights (z - reference)|^2."""
    p = reduce.paired(x.densify(), reference)
    w = weights.df.select(*weights.keys, D("re").alias("w"))
    p = p.join(w, weights.keys, "left") if weights.keys else p.crossJoin(F.broadcast(w))
    q = F.coalesce("w", F.lit(0.0)) ** 2 * level
    return ArrayFrame(p.select(*x.keys, ((D("re") + q * D("re2")) / (1 + q)).alias("re"), ((D("im") + q * D("im2")) / (1 + q)).alias("im")), x.dims)


def l2_norm(x, level: float, flags: int | None = None):
    """Of the (not squared) norm over dimensions; all by default."""
    return elementwise.soft_threshold(x, level, (1 << len(x.dims)) - 1 if flags is None else flags)


def _onto_ball(x, radius: float, flags: int, outside: bool):
    df = elementwise._joined(x, flags, F.sqrt(F.sum(C.absq(_v()))))
    f = C.safe(F.lit(float(radius)), D("m"))
    f = f if outside else F.least(F.lit(1.0), F.when(D("m") == 0, 1.0).otherwise(f))
    return ArrayFrame(df.select(*x.keys, (D("re") * f).alias("re"), (D("im") * f).alias("im")), x.dims)


def l2_ball(x, radius: float, centre: ArrayFrame | None = None, flags: int | None = None):
    """Projection onto a ball."""
    flags = (1 << len(x.dims)) - 1 if flags is None else flags
    if centre is None:
        return _onto_ball(x, radius, flags, False)
    return elementwise.saxpy(1.0, _onto_ball(elementwise.saxpy(-1.0, centre, x), radius, flags, False), centre)


def sphere(x, radius: float = 1.0, flags: int | None = None):
    """Projection onto a sphere; zero stays zero."""
    return _onto_ball(x, radius, (1 << len(x.dims)) - 1 if flags is None else flags, True)


def less_equal(x, bound: float):
    """Projection of real parts below a bound."""
    x = x.densify() if bound < 0 else x
    return x.with_values(F.least(D("re"), F.lit(float(bound))), F.lit(0.0))


def greater_equal(x, bound: float):
    x = x.densify() if bound > 0 else x
    return x.with_values(F.greatest(D("re"), F.lit(float(bound))), F.lit(0.0))


def minimum(x, bound: float):
    return greater_equal(x, bound)


def non_negative(x):
    return greater_equal(x, 0.0)


def real_positive(x):
    return non_negative(x)


def real_value(x):
    return elementwise.creal(x)


def mean_free(x, flags: int):
    """Projection onto arrays of mean zero over the flagged dimensions."""
    x = x.densify()
    df = elementwise._joined(x, flags, F.struct(F.avg("re").alias("r"), F.avg("im").alias("i")))
    return ArrayFrame(df.select(*x.keys, (D("re") - D("m.r")).alias("re"), (D("im") - D("m.i")).alias("im")), x.dims)


def smax(x, level: float, flags: int, iterations: int = 60):
    """Of the largest real part over the flagged dimensions: values above t become t, where t takes `level` off their sum (by bisection, all lines at once)."""
    x = elementwise.creal(x).densify()
    bounds = F.struct(F.min("re").alias("lo"), F.max("re").alias("hi"))
    df = elementwise._joined(x, flags, bounds).select(*x.keys, "re", (D("m.lo") - level).alias("lo"), D("m.hi").alias("hi"))
    rest = x.complement(flags)
    lines = df.groupBy(*rest).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("re").alias("v"))

    def halve(s, _):
        t = (s["lo"] + s["hi"]) / 2
        over = F.aggregate("v", F.lit(0.0), lambda acc, y: acc + F.greatest(y - t, F.lit(0.0)))
        return F.struct(F.when(over > level, t).otherwise(s["lo"]).alias("lo"), F.when(over > level, s["hi"]).otherwise(t).alias("hi"))

    cut = lines.select(*rest, F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.struct("lo", "hi"), halve)["hi"].alias("t"))
    both = df.join(cut, rest) if rest else df.crossJoin(F.broadcast(cut))
    return ArrayFrame(both.select(*x.keys, F.least("re", "t").alias("re"), F.lit(0.0).alias("im")), x.dims)


def normal_equations(x, level: float, op: LinOp, data: ArrayFrame, iterations: int = 20):
    """Of 1/2 |op z - data|^2, by conjugate gradients."""
    b = A.Vector(op.adjoint(data))
    right = A.Vector(x) + level * b
    return A.conjugate_gradients(lambda v: v + level * v.apply(op.normal.forward), right, iterations).a


def linear_equations(x, op: LinOp, data: ArrayFrame, iterations: int = 20):
    """Projection onto op z = data: x + op^H (op op^H)^-1 (data - op x)."""
    left = A.Vector(elementwise.saxpy(-1.0, op(x), data))
    y = A.conjugate_gradients(lambda v: v.apply(lambda a: op(op.adjoint(a))), left, iterations)
    return elementwise.saxpy(1.0, x, op.adjoint(y.a))


def affine(x, prox, factor: float, offset: ArrayFrame):
    """Of z -> f(factor z + offset), from the prox of f: prox(x, level)."""
    def of(level: float):
        y = elementwise.saxpy(factor, x, offset)
        z = prox(y, level * factor * factor)
        return elementwise.scale(elementwise.saxpy(-1.0, offset, z), 1 / factor)

    return of


def scaled(x, level: float, prox, factor: float):
    """Of factor times f."""
    return prox(x, level * factor)


def conjugate(x, level: float, prox):
    """Of the convex conjugate, by Moreau: x - level prox(x / level, 1 / level)."""
    inner = prox(elementwise.scale(x, 1 / level), 1 / level)
    return elementwise.saxpy(-level, inner, x)


def auto_normalised(x, level: float, prox):
    """prox of x over its largest magnitude, scaled back: the level is relative."""
    top = reduce.norms(x)["max"] or 1.0
    return elementwise.scale(prox(elementwise.scale(x, 1 / top), level), top)


def gradient_step(x, level: float, gradient):
    """A step along a gradient in place of a prox: x - level gradient(x)."""
    return elementwise.saxpy(-level, gradient(x), x)


CATALOGUE = {f.__name__: f for f in (zero, soft, transformed_soft, wavelet_soft, hard, largest, least_squares, weighted_least_squares, l2_norm, l2_ball, sphere, less_equal, greater_equal, minimum, non_negative, real_positive, real_value, mean_free, smax, normal_equations, linear_equations, affine, scaled, conjugate, auto_normalised, gradient_step)}
