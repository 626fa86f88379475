"""Nonlinear operators with derivatives: a forward plan, and at every array a linear operator with its adjoint.

A point-wise function has the derivative dx -> a dx + b conj(dx), where a and b are functions of the point; its adjoint
is dy -> conj(a) dy + b conj(dy). This covers functions of complex values that are not analytic, too."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..frame import ArrayFrame, normalise_dims
from ..functions import complex as C
from . import contract, elementwise, linops, reduce
from .linops import LinOp

D = F.col


def _v():
    return D("re"), D("im")


@dataclass(frozen=True)
class NlOp:
    domain: tuple[int, ...]
    codomain: tuple[int, ...]
    forward: Callable[[ArrayFrame], ArrayFrame]
    derivative: Callable[[ArrayFrame], LinOp]

    def __call__(self, x: ArrayFrame) -> ArrayFrame:
        if x.dims != self.domain:
            raise ValueError(f"sizes {self.domain} are needed, not {x.dims}")
        return self.forward(x)

    def __matmul__(self, other: NlOp | LinOp) -> NlOp:
        """self after other; the chain rule."""
        other = from_linop(other) if isinstance(other, LinOp) else other
        if other.codomain != self.domain:
            raise ValueError("sizes do not match")
        return NlOp(other.domain, self.codomain, lambda x: self.forward(other.forward(x)), lambda x: self.derivative(other.forward(x)) @ other.derivative(x))

    def __add__(self, other: NlOp) -> NlOp:
        return NlOp(self.domain, self.codomain, lambda x: elementwise.saxpy(1.0, self.forward(x), other.forward(x)), lambda x: self.derivative(x) + other.derivative(x))


def from_linop(op: LinOp) -> NlOp:
    return NlOp(op.domain, op.codomain, op.forward, lambda x: op)


def pointwise(dims, value: Callable, a: Callable, b: Callable | None = None, needs_all: bool = False) -> NlOp:
    """value, a and b: columns of a complex pair; needs_all: zero maps to something else."""
    d = normalise_dims(dims)
    full = (lambda x: x.densify()) if needs_all else (lambda x: x)

    def derivative(x):
        x = full(x)
        at = x.with_values(*a(_v()))
        straight = linops.cdiag(d, at)
        if b is None:
            return straight
        turned = x.with_values(*b(_v()))
        conj = LinOp(d, d, lambda v: contract.fmac(elementwise.conj(v), turned), lambda w: contract.fmac(elementwise.conj(w), turned))
        return straight + conj

    return NlOp(d, d, lambda x: full(x).with_values(*value(_v())), derivative)


def _half(z):
    return z[0] / 2, z[1] / 2


def axpbz(dims, a: complex, b: ArrayFrame, c: complex = 1.0) -> NlOp:
    """a x + c b for a fixed array b."""
    d = normalise_dims(dims)
    return NlOp(d, d, lambda x: elementwise.saxpy(a, x, elementwise.scale(b, c)), lambda x: linops.scale(d, a))


def sadd(dims, value: complex) -> NlOp:
    return pointwise(dims, lambda z: (z[0] + complex(value).real, z[1] + complex(value).imag), lambda z: C.cx(1), needs_all=True)


def const(dims, value: ArrayFrame) -> NlOp:
    """A fixed array, whatever the argument."""
    d = normalise_dims(dims)
    zero = lambda x: ArrayFrame(x.df.where("false"), x.dims)
    return NlOp(d, value.dims, lambda x: value, lambda x: LinOp(d, value.dims, lambda v: ArrayFrame(value.df.where("false"), value.dims), lambda w: zero(x)))


def inv(dims, ridge: float = 0.0) -> NlOp:
    """1/x, or conj(x) / (|x|^2 + ridge)."""
    if not ridge:
        one = lambda z: C.div(C.cx(1), z)
        return pointwise(dims, one, lambda z: tuple(-c for c in C.mul(one(z), one(z))))
    q = lambda z: C.absq(z) + ridge
    conj2 = lambda z: C.mul(C.conj(z), C.conj(z))
    return pointwise(dims, lambda z: (z[0] / q(z), -z[1] / q(z)), lambda z: tuple(-c / (q(z) * q(z)) for c in conj2(z)), lambda z: (ridge / (q(z) * q(z)), F.lit(0.0)))


def inv_reg(dims, ridge: float) -> NlOp:
    return inv(dims, ridge)


def div(dims, numerator: ArrayFrame, ridge: float = 0.0) -> NlOp:
    """A fixed array over the argument."""
    return from_linop(linops.cdiag(dims, numerator)) @ inv(dims, ridge)


def sqrt(dims) -> NlOp:
    root = lambda z: C.power(z, 0.5)
    return pointwise(dims, root, lambda z: _half(C.div(C.cx(1), root(z))))


def spow(dims, p: complex) -> NlOp:
    return pointwise(dims, lambda z: C.power(z, p), lambda z: C.mul(C.cx(p), C.power(z, complex(p) - 1)))


def exp(dims) -> NlOp:
    return pointwise(dims, C.exp, C.exp, needs_all=True)


def log(dims) -> NlOp:
    return pointwise(dims, C.log, lambda z: C.div(C.cx(1), z))


def sin(dims) -> NlOp:
    return pointwise(dims, C.FUNCTIONS["zsin"], C.FUNCTIONS["zcos"])


def cos(dims) -> NlOp:
    return pointwise(dims, C.FUNCTIONS["zcos"], lambda z: tuple(-c for c in C.FUNCTIONS["zsin"](z)), needs_all=True)


def sinh(dims) -> NlOp:
    return pointwise(dims, C.FUNCTIONS["zsinh"], C.FUNCTIONS["zcosh"])


def cosh(dims) -> NlOp:
    return pointwise(dims, C.FUNCTIONS["zcosh"], C.FUNCTIONS["zsinh"], needs_all=True)


def smoothed_abs(dims, small: float) -> NlOp:
    """sqrt(|x|^2 + small)."""
    m = lambda z: F.sqrt(C.absq(z) + small)
    at = lambda z: (C.safe(z[0], 2 * m(z)), C.safe(z[1], 2 * m(z)))
    return pointwise(dims, lambda z: (m(z), F.lit(0.0)), lambda z: C.conj(at(z)), at, needs_all=small > 0)


def abs_(dims) -> NlOp:
    return smoothed_abs(dims, 0.0)


def phase(dims) -> NlOp:
    """x / |x|; zero stays zero."""
    value = lambda z: (C.safe(z[0], C.mag(z)), C.safe(z[1], C.mag(z)))
    square = lambda z: C.mul(value(z), value(z))
    return pointwise(dims, value, lambda z: (C.safe(F.lit(0.5), C.mag(z)), F.lit(0.0)), lambda z: tuple(-C.safe(c, 2 * C.mag(z)) for c in square(z)))


def max_(dims, bound: float) -> NlOp:
    """The larger of the real part and a bound."""
    on = lambda z: (F.when(z[0] > bound, 0.5).otherwise(0.0), F.lit(0.0))
    return pointwise(dims, lambda z: (F.greatest(z[0], F.lit(float(bound))), F.lit(0.0)), on, on, needs_all=bound > 0)


def ss(dims, flags: int) -> NlOp:
    """Sums of squared magnitudes over dimensions."""
    d = normalise_dims(dims)
    add = linops.sum_(d, flags)

    def derivative(x):
        straight = linops.cdiag(d, elementwise.conj(x))
        turned = LinOp(d, d, lambda v: contract.fmac(elementwise.conj(v), x), lambda w: contract.fmac(elementwise.conj(w), x))
        return add @ (straight + turned)

    return NlOp(d, add.codomain, lambda x: add.forward(x.with_values(C.absq(_v()), F.lit(0.0))), derivative)


def rss(dims, flags: int) -> NlOp:
    inner = ss(dims, flags)
    return sqrt(inner.codomain) @ inner


def mse(dims, reference: ArrayFrame) -> NlOp:
    """The mean squared difference from a reference, as an array of one cell."""
    d = normalise_dims(dims)
    flags = (1 << len(d)) - 1
    return from_linop(linops.scale([1], 1 / math.prod(d))) @ ss(d, flags) @ axpbz(d, 1.0, reference, -1.0)


def nmse(dims, reference: ArrayFrame) -> NlOp:
    """The squared difference over the squared reference."""
    d = normalise_dims(dims)
    flags = (1 << len(d)) - 1
    size = reduce.norms(reference)["l2"] ** 2
    return from_linop(linops.scale([1], 1 / size)) @ ss(d, flags) @ axpbz(d, 1.0, reference, -1.0)


def nrmse(dims, reference: ArrayFrame) -> NlOp:
    return sqrt([1]) @ nmse(dims, reference)


def asum(dims, small: float = 0.0) -> NlOp:
    """The sum of magnitudes (smoothed on request): an l1 norm."""
    d = normalise_dims(dims)
    return from_linop(linops.sum_(d, (1 << len(d)) - 1)) @ smoothed_abs(d, small)


def mad(dims, reference: ArrayFrame, small: float = 0.0) -> NlOp:
    """The mean absolute difference from a reference."""
    d = normalise_dims(dims)
    return from_linop(linops.scale([1], 1 / math.prod(d))) @ asum(d, small) @ axpbz(d, 1.0, reference, -1.0)


@dataclass(frozen=True)
class Product:
    """The product of two arrays, summed over dimensions: a function of both; partial(i, x, y) is its derivative in one."""

    first: tuple[int, ...]
    second: tuple[int, ...]
    squash: int = 0

    def __call__(self, x: ArrayFrame, y: ArrayFrame) -> ArrayFrame:
        return contract.fmac(x, y, self.squash)

    def partial(self, i: int, x: ArrayFrame, y: ArrayFrame) -> LinOp:
        return linops.fmac(self.first, y, self.squash) if i == 0 else linops.fmac(self.second, x, self.squash)


def tenmul(first, second, squash: int = 0) -> Product:
    return Product(normalise_dims(first), normalise_dims(second), squash)


def norm_inverse(normal: LinOp, ridge: float, iterations: int = 20) -> NlOp:
    """(normal + ridge)^-1 by conjugate gradients: linear and its own adjoint."""
    from . import algorithms as A

    def solve(b):
        return A.conjugate_gradients(lambda v: v.apply(normal.forward) + ridge * v, A.Vector(b), iterations).a

    return from_linop(LinOp(normal.domain, normal.domain, solve, solve))


def sense_normal(op: LinOp) -> NlOp:
    """Adjoint after forward of a coil model."""
    return from_linop(op.normal)


CATALOGUE = {f.__name__.rstrip("_"): f for f in (axpbz, sadd, const, inv, inv_reg, div, sqrt, spow, exp, log, sin, cos, sinh, cosh, smoothed_abs, abs_, phase, max_, ss, rss, mse, nmse, nrmse, asum, mad, tenmul, norm_inverse, sense_normal)}
