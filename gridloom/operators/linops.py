"""Linear operators with their adjoints: pairs of plans over arrays, which chain, add up and have a normal operator."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..frame import ArrayFrame, flag_dims, normalise_dims

from . import contract, elementwise, generate, index, kernels, models, reduce, window

D = F.col


@dataclass(frozen=True)
class LinOp:
    """domain and codomain: sizes; forward and back map arrays from one to the other."""

    domain: tuple[int, ...]
    codomain: tuple[int, ...]
    forward: Callable[[ArrayFrame], ArrayFrame]
    back: Callable[[ArrayFrame], ArrayFrame]

    def __call__(self, x: ArrayFrame) -> ArrayFrame:
        if x.dims != self.domain:
            raise ValueError(f"sizes {self.domain} are needed, not {x.dims}")
        return self.forward(x)

    @property
    def adjoint(self) -> LinOp:
        return LinOp(self.codomain, self.domain, self.back, self.forward)

    def __matmul__(self, other: LinOp) -> LinOp:
        """self after other."""
        if other.codomain != self.domain:
            raise ValueError("sizes do not match")
        return LinOp(other.domain, self.codomain, lambda x: self.forward(other.forward(x)), lambda y: other.back(self.back(y)))

    def __add__(self, other: LinOp) -> LinOp:
        if (other.domain, other.codomain) != (self.domain, self.codomain):
            raise ValueError("sizes do not match")
        return LinOp(self.domain, self.codomain, lambda x: elementwise.saxpy(1.0, self.forward(x), other.forward(x)), lambda y: elementwise.saxpy(1.0, self.back(y), other.back(y)))

    def __rmul__(self, factor: complex) -> LinOp:
        return scale(self.codomain, factor) @ self

    @property
    def normal(self) -> LinOp:
        return self.adjoint @ self


def _own(dims) -> tuple[int, ...]:
    return normalise_dims(dims)


def _summed(a: ArrayFrame) -> ArrayFrame:
    """Rows of one index added up."""
    df = a.df.groupBy(*a.keys) if a.keys else a.df.groupBy()
    return ArrayFrame(df.agg(F.sum("re").alias("re"), F.sum("im").alias("im")), a.dims)


def identity(dims) -> LinOp:
    d = _own(dims)
    return LinOp(d, d, lambda x: x, lambda y: y)


def scale(dims, factor: complex) -> LinOp:
    d = _own(dims)
    return LinOp(d, d, lambda x: elementwise.scale(x, factor), lambda y: elementwise.scale(y, complex(factor).conjugate()))


def cdiag(dims, diagonal: ArrayFrame) -> LinOp:
    """Multiplication by an array, which may be of size 1 in some dimensions."""
    d = _own(dims)
    return LinOp(d, d, lambda x: contract.fmac(x, diagonal), lambda y: contract.fmac(y, diagonal, conj=True))


def rdiag(dims, diagonal: ArrayFrame) -> LinOp:
    """Multiplication by the real part of an array."""
    return cdiag(dims, elementwise.creal(diagonal))


def zconj(dims) -> LinOp:
    """Complex conjugation (linear over the reals)."""
    d = _own(dims)
    return LinOp(d, d, elementwise.conj, elementwise.conj)


def zreal(dims) -> LinOp:
    d = _own(dims)
    return LinOp(d, d, elementwise.creal, elementwise.creal)


realval = zreal


def decompose_complex(dims, dim: int) -> LinOp:
    """Real and imaginary part as two real arrays along a dimension of size 1."""
    d = _own(dims)
    out = tuple(2 if k == dim else n for k, n in enumerate(d))

    def forward(x):
        return index.join(dim, elementwise.creal(x), x.with_values(D("im"), F.lit(0.0)))

    def back(y):
        im = index.slice_(y, **{f"d{dim}": 1})
        return elementwise.saxpy(1.0, elementwise.creal(index.slice_(y, **{f"d{dim}": 0})), im.with_values(F.lit(0.0), D("re")))

    return LinOp(d, out, forward, back)


def copy_block(dims, out, **position: int) -> LinOp:
    """The block of size `out` at a position (0 where it is not given)."""
    d, o = _own(dims), _own(out)
    at = [position.get(f"d{k}", 0) for k in range(len(d))]

    def forward(x):
        for k in range(len(d)):
            if (d[k], at[k]) != (o[k], 0):
                x = index.extract(x, k, at[k], at[k] + o[k])
        return x

    def back(y):
        return index._project(y, d, {k: index._at(y, k) + at[k] for k in range(len(d)) if d[k] > 1})

    return LinOp(d, o, forward, back)


def extract(dims, dim: int, start: int, end: int) -> LinOp:
    d = _own(dims)
    return copy_block(d, tuple(end - start if k == dim else n for k, n in enumerate(d)), **{f"d{dim}": start})


def slice_(dims, **position: int) -> LinOp:
    d = _own(dims)
    return copy_block(d, tuple(1 if f"d{k}" in position else n for k, n in enumerate(d)), **position)


def slice_one(dims, dim: int, place: int) -> LinOp:
    return slice_(dims, **{f"d{dim}": place})


def resize(dims, where: str = "end", **sizes: int) -> LinOp:
    """Cut or filled up with zeros at the end, the front or around the centre."""
    d = _own(dims)
    o = tuple(sizes.get(f"d{k}", n) for k, n in enumerate(d))
    return LinOp(d, o, lambda x: index.resize(x, where, **sizes), lambda y: index.resize(y, where, **{c: d[int(c[1:])] for c in sizes}))


def expand(dims, **sizes: int) -> LinOp:
    if any(s < _own(dims)[int(c[1:])] for c, s in sizes.items()):
        raise ValueError("sizes must not be smaller")
    return resize(dims, "centre", **sizes)


def padding(dims, dim: int, before: int, after: int, kind: str = "zero") -> LinOp:
    """As index.pad; the adjoint adds every copy back to the cell it was made from."""
    d = _own(dims)
    n = d[dim]
    size = n - before - after if kind == "valid" else n + before + after
    o = tuple(size if k == dim else m for k, m in enumerate(d))

    def back(y):
        if kind == "valid":
            return index._project(y, d, {dim: index._at(y, dim) + before})
        start = before + after if kind == "causal" else (before + after) // 2 if kind == "same" else before
        if kind in index.PADDINGS:
            return _summed(index._project(y, d, {dim: index.PADDINGS[kind](index._at(y, dim).cast("int") - before, n)}))
        return index.extract(y, dim, start, start + n)

    return LinOp(d, o, lambda x: index.pad(x, dim, before, after, kind), back)


def reshape(dims, flags: int, sizes) -> LinOp:
    d = _own(dims)
    own = flag_dims(flags)
    o = tuple(dict(zip(own, sizes, strict=True)).get(k, n) for k, n in enumerate(d))
    return LinOp(d, o, lambda x: index.reshape(x, flags, sizes), lambda y: index.reshape(y, flags, [d[k] for k in own]))


def flatten(dims) -> LinOp:
    d = _own(dims)
    flags = (1 << len(d)) - 1
    return reshape(d, flags, [math.prod(d)] + [1] * (len(d) - 1))


def permute(dims, order) -> LinOp:
    d = _own(dims)
    order = [*order, *range(len(order), len(d))]
    inverse = [order.index(k) for k in range(len(d))]
    return LinOp(d, tuple(d[k] for k in order), lambda x: index.permute(x, order), lambda y: index.permute(y, inverse))


def transpose(dims, i: int, j: int) -> LinOp:
    order = list(range(16))
    order[i], order[j] = j, i
    return permute(dims, order)


def shift(dims, dim: int, by: int, cyclic: bool = True) -> LinOp:
    """Cells move along a dimension; what leaves comes in at the other end, or is lost."""
    d = _own(dims)
    n = d[dim]

    def move(x, by):
        if cyclic:
            return index.circshift(x, dim, by)
        new = index._at(x, dim) + by
        return index._project(x, d, {dim: new}, (new >= 0) & (new < n))

    return LinOp(d, d, lambda x: move(x, by), lambda y: move(y, -by))


def flip(dims, flags: int) -> LinOp:
    d = _own(dims)
    return LinOp(d, d, lambda x: index.flip(x, flags), lambda y: index.flip(y, flags))


def add_strided(dims, out: int, stride: int) -> LinOp:
    """Lines of dimension 0 are added up at places that are `stride` apart for every index of dimension 1; out: length of the sum."""
    d = _own(dims)
    o = _own([out])
    if (d[1] - 1) * stride + d[0] > out:
        raise ValueError("the sum is too short")

    def forward(x):
        return _summed(index._project(x, o, {0: index._at(x, 0) + index._at(x, 1) * stride}))

    def back(y):
        lines = y.df.withColumn("d1", F.explode(F.sequence(F.lit(0), F.lit(d[1] - 1)))).withColumn("p", index._at(y, 0) - D("d1") * stride)
        return index._project(ArrayFrame(lines, o), d, {0: D("p"), 1: D("d1")}, (D("p") >= 0) & (D("p") < d[0]))

    return LinOp(d, o, forward, back)


def hankelization(dims, dim: int, size: int, new_dim: int) -> LinOp:
    """out[i, w] = x[i + w] for windows of a size along a dimension."""
    d = _own(dims)
    n = d[dim] - size + 1
    o = tuple(n if k == dim else size if k == new_dim else m for k, m in enumerate(d))

    def forward(x):
        df = x.df.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("p", index._at(x, dim) - D("w"))
        return index._project(ArrayFrame(df, d), o, {dim: D("p"), new_dim: D("w")}, (D("p") >= 0) & (D("p") < n))

    def back(y):
        return _summed(index._project(y, d, {dim: index._at(y, dim) + index._at(y, new_dim)}))

    return LinOp(d, o, forward, back)


def matrix(dims, m: np.ndarray, dim: int) -> LinOp:
    """A small matrix along a dimension."""
    d, m = _own(dims), np.asarray(m)
    o = tuple(m.shape[0] if k == dim else n for k, n in enumerate(d))
    return LinOp(d, o, lambda x: contract.apply_matrix(x, m, dim), lambda y: contract.apply_matrix(y, m.conj().T, dim))


def matrix_chain(dims, matrices, dim: int) -> LinOp:
    """Matrices one after the other (the first is applied first), multiplied before anything moves."""
    m = np.asarray(matrices[0])
    for x in matrices[1:]:
        m = np.asarray(x) @ m
    return matrix(dims, m, dim)


def hadamard(dims, dim: int) -> LinOp:
    """The unitary Hadamard transform of a dimension whose size is a power of two."""
    n = _own(dims)[dim]
    if n & (n - 1):
        raise ValueError("a power of two is needed")
    m = np.ones((1, 1))
    while len(m) < n:
        m = np.block([[m, m], [m, -m]])
    return matrix(dims, m / math.sqrt(n), dim)


def fft(dims, flags: int, centred: bool = False, unitary: bool = True, inverse: bool = False) -> LinOp:
    d = _own(dims)
    n = math.prod(d[k] for k in flag_dims(flags))

    def back(y):
        return kernels.fft(y, flags, inverse=not inverse, unitary=unitary, centred=centred)

    if n < 1:
        raise ValueError("sizes must be positive")
    return LinOp(d, d, lambda x: kernels.fft(x, flags, inverse=inverse, unitary=unitary, centred=centred), back)


def ifft(dims, flags: int, **options) -> LinOp:
    return fft(dims, flags, inverse=True, **options)


def fftc(dims, flags: int) -> LinOp:
    return fft(dims, flags, centred=True)


def ifftc(dims, flags: int) -> LinOp:
    return fft(dims, flags, centred=True, inverse=True)


def wavelet(dims, flags: int, kind: str = "dau2", coarsest: int = 16) -> LinOp:
    d = _own(dims)
    return LinOp(d, d, lambda x: kernels.wavelet(x, flags, False, kind, coarsest), lambda y: kernels.wavelet(y, flags, True, kind, coarsest))


def cdf97(dims, flags: int) -> LinOp:
    """One split of the CDF 9/7 wavelet. It is nearly orthogonal; as usual its inverse stands for the adjoint."""
    d = _own(dims)
    return LinOp(d, d, lambda x: kernels.cdf97(x, flags), lambda y: kernels.cdf97(y, flags, inverse=True))


def conv(dims, kernel: ArrayFrame, flags: int) -> LinOp:
    """Cyclic convolution; the adjoint is that with the reflected, conjugated kernel."""
    d = _own(dims)
    turned = elementwise.conj(kernel)
    for k in flag_dims(flags):
        if kernel.dims[k] > 1:
            turned = index.flip(turned, 1 << k)
            if kernel.dims[k] % 2 == 0:  # the centre n // 2 of an even kernel stays where it is
                turned = index.resize(turned, "front", **{f"d{k}": kernel.dims[k] + 1})
    return LinOp(d, d, lambda x: contract.conv(x, kernel, flags), lambda y: contract.conv(y, turned, flags))


def conv_gaussian(spark, dims, flags: int, sigma: float) -> LinOp:
    """Cyclic convolution with a Gaussian of integral one, three standard deviations to either side."""
    d = _own(dims)
    op = identity(d)
    for k in flag_dims(flags):
        r = min(max(1, math.ceil(3 * sigma)), (d[k] - 1) // 2)
        w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
        line = generate.vec(spark, w / w.sum())
        op = conv(d, index.permute(line, [*range(1, k + 1), 0]) if k else line, 1 << k) @ op
    return op


def fmac(dims, tensor: ArrayFrame, squash: int) -> LinOp:
    """Multiplication by a tensor and sums over the squashed dimensions; the adjoint multiplies by its conjugate and sums over what is new."""
    d = _own(dims)
    whole = tuple(max(a, b) for a, b in zip(d, tensor.dims, strict=True))
    o = tuple(1 if squash >> k & 1 else n for k, n in enumerate(whole))
    new = sum(1 << k for k in range(len(d)) if whole[k] > 1 and d[k] == 1)
    missing = [k for k in range(len(d)) if d[k] > 1 and tensor.dims[k] == 1 and squash >> k & 1]

    def back(y):
        for k in missing:
            y = index.repmat(y, k, d[k])
        return contract.fmac(y, tensor, squash=new, conj=True)

    return LinOp(d, o, lambda x: contract.fmac(x, tensor, squash), back)


def sum_(dims, flags: int, factor: float = 1.0) -> LinOp:
    """Sums over dimensions, times a factor."""
    d = _own(dims)
    o = tuple(1 if flags >> k & 1 else n for k, n in enumerate(d))

    def back(y):
        for k in flag_dims(flags):
            y = index.repmat(y, k, d[k])
        return elementwise.scale(y, factor)

    return LinOp(d, o, lambda x: elementwise.scale(reduce.total(x, flags), factor), back)


def scaled_sum(dims, flags: int) -> LinOp:
    """Sums divided by the root of the number of cells, so that the adjoint keeps norms."""
    return sum_(dims, flags, 1 / math.sqrt(math.prod(_own(dims)[k] for k in flag_dims(flags))))


def avg(dims, flags: int) -> LinOp:
    return sum_(dims, flags, 1 / math.prod(_own(dims)[k] for k in flag_dims(flags)))


def repmat(dims, flags: int, **times: int) -> LinOp:
    d = _own(dims)
    big = tuple(times.get(f"d{k}", n) for k, n in enumerate(d))
    return sum_(big, flags).adjoint


def grad(dims, flags: int, out_dim: int) -> LinOp:
    """Cyclic forward differences of the flagged dimensions, side by side."""
    d = _own(dims)
    own = [k for k in flag_dims(flags) if d[k] > 1]
    o = tuple(len(own) if k == out_dim else n for k, n in enumerate(d))

    def back(y):
        total = None
        for i, k in enumerate(own):
            part = index.slice_(y, **{f"d{out_dim}": i}) if len(own) > 1 else y
            part = elementwise.saxpy(-1.0, part, index.circshift(part, k, 1))
            total = part if total is None else elementwise.saxpy(1.0, part, total)
        return total

    return LinOp(d, o, lambda x: window.gradient(x, flags, out_dim), back)


def casorati(dims, **kernel: int) -> LinOp:
    d = _own(dims)
    own = [int(c[1:]) for c in kernel]
    rows = math.prod(d[k] - kernel[f"d{k}"] + 1 for k in own)
    return LinOp(d, _own([rows, math.prod(kernel.values())]), lambda x: index.casorati(x, **kernel), lambda y: index.casorati_adjoint(y, d, **kernel))


def casorati_h(dims, **kernel: int) -> LinOp:
    return casorati(dims, **kernel).adjoint


def sampling(dims, pattern: ArrayFrame) -> LinOp:
    """Multiplication by a pattern, which may be of size 1 in some dimensions."""
    return cdiag(dims, reduce.pattern(pattern, 0))


def coil_maps(dims, maps: ArrayFrame, coil: int = 3) -> LinOp:
    """An image seen by every coil; the adjoint adds up over the coils."""
    d = _own(dims)
    o = tuple(maps.dims[k] if k == coil else n for k, n in enumerate(d))
    return LinOp(d, o, lambda x: contract.fmac(x, maps), lambda y: contract.fmac(y, maps, squash=1 << coil, conj=True))


def sense(dims, maps: ArrayFrame, pattern: ArrayFrame | None = None, flags: int = 7, coil: int = 3) -> LinOp:
    """Coil images, their transform, and sampling."""
    seen = coil_maps(dims, maps, coil)
    op = fftc(seen.codomain, flags) @ seen
    return op if pattern is None else sampling(op.codomain, pattern) @ op


def nudft(dims, traj: ArrayFrame) -> LinOp:
    """Direct non-uniform transform along a trajectory."""
    d = _own(dims)
    o = (1, *traj.dims[1:])
    return LinOp(d, o, lambda x: kernels.nudft(traj, x), lambda y: kernels.nudft_adjoint(traj, y, d))


def nufft(dims, traj: ArrayFrame, width: int = 6, oversampling: float = 2.0) -> LinOp:
    """Non-uniform transform by gridding."""
    from . import noncartesian as N

    d = _own(dims)
    o = (1, *traj.dims[1:])
    return LinOp(d, o, lambda x: N.nufft(traj, x, width, oversampling), lambda y: N.nufft_adjoint(traj, y, d, width, oversampling))


def interpolate(dims, points, order: int = 1) -> LinOp:
    """Values at n points (id, x0, x1, ..), as an array of n cells; the adjoint spreads them back with the same weights."""
    d = _own(dims)
    n = points.count()
    o = _own([n])

    def forward(x):
        found = models.interpolate(x, points, order)
        return ArrayFrame.of(found.select(D("id").alias("d0"), "re", "im"), o)

    def back(y):
        keys = [f"d{k}" for k, s in enumerate(d) if s > 1]
        probes = models.corners(points, keys, order)
        inside = F.lit(True)
        for c in keys:
            inside = inside & (D(c) >= 0) & (D(c) < d[int(c[1:])])
        values = y.df.select(D("d0").alias("id") if y.keys else F.lit(0).alias("id"), "re", "im")
        hit = probes.where(inside).join(values, "id")
        return ArrayFrame.of(hit.groupBy(*keys).agg(F.sum(D("w") * D("re")).alias("re"), F.sum(D("w") * D("im")).alias("im")), d)

    return LinOp(d, o, forward, back)


def interpolate_displacement(dims, displacement: ArrayFrame, order: int = 1) -> LinOp:
    """The image read at its own places plus a displacement (components along the last of its dimensions)."""
    d = _own(dims)
    keys = [f"d{k}" for k, s in enumerate(d) if s > 1]
    comp = max(k for k, s in enumerate(displacement.dims) if s > 1)
    by = displacement.densify().df.groupBy(*keys).agg(*(F.max(F.when(D(f"d{comp}") == i, D("re"))).alias(f"x{i}") for i in range(len(keys))))
    from ..frame import ravel, unravel

    points = by.select(ravel(d).alias("id"), *((D(f"x{i}") + D(c)).alias(f"x{i}") for i, c in enumerate(keys)))
    op = interpolate(d, points, order)

    def forward(x):
        y = op.forward(x)
        return ArrayFrame.of(y.df.select(*(c.alias(f"d{k}") for k, c in unravel(D("d0").cast("long"), d).items()), "re", "im"), d)

    def back(y):
        return op.back(index.flatten(y))

    return LinOp(d, d, forward, back)


def asl(dims, dim: int) -> LinOp:
    """Differences of label and control, which alternate along a dimension (control first)."""
    d = _own(dims)
    if d[dim] % 2:
        raise ValueError("an even number is needed")
    o = tuple(n // 2 if k == dim else n for k, n in enumerate(d))

    def sign(x):
        s = F.when(index._at(x, dim) % 2 == 0, 1.0).otherwise(-1.0)
        return x.with_values(D("re") * s, D("im") * s)

    def back(y):
        df = y.df.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
        return sign(index._project(ArrayFrame(df, o), d, {dim: index._at(y, dim) * 2 + D("p")}))

    return LinOp(d, o, lambda x: _summed(index._project(sign(x), o, {dim: F.call_function("div", index._at(x, dim), F.lit(2))})), back)


def coil_weights(dims, flags: int = 7, a: float = 220.0, b: float = 32.0) -> LinOp:
    """Smooth coils from their weighted spectra: multiplication by (1 + a |k|^2)^(-b/2), then the inverse transform."""
    d = _own(dims)

    def weigh(x):
        k2 = F.lit(0.0)
        for k in flag_dims(flags):
            if d[k] > 1:
                k2 = k2 + (D(f"d{k}") / d[k] - 0.5) ** 2
        w = F.pow(1 + a * k2, F.lit(-b / 2))
        return x.with_values(D("re") * w, D("im") * w)

    return fft(d, flags, centred=True, inverse=True) @ LinOp(d, d, weigh, weigh)


def norm_estimate(op: LinOp, x: ArrayFrame, iterations: int = 10) -> float:
    """The largest singular value, by power iteration from x."""
    from . import algorithms

    return math.sqrt(algorithms.power_iteration(lambda v: v.apply(op.normal), algorithms.Vector(x), iterations))


CATALOGUE = {f.__name__.rstrip("_"): f for f in (identity, scale, cdiag, rdiag, zconj, zreal, decompose_complex, copy_block, extract, slice_, slice_one, resize, expand, padding, reshape, flatten, permute, transpose, shift, flip, add_strided, hankelization, matrix, matrix_chain, hadamard, fft, ifft, fftc, ifftc, wavelet, cdf97, conv, conv_gaussian, fmac, sum_, scaled_sum, avg, repmat, grad, casorati, casorati_h, sampling, coil_maps, sense, nudft, nufft, interpolate, interpolate_displacement, asl, coil_weights)}

