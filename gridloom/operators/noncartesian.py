"""Non-uniform transforms by gridding: samples meet the cells of an oversampled grid around them in an equality join.

Values at the samples are sums over the cells within a kernel's width (an exponential of a semicircle); the adjoint
adds the samples up into the cells. The kernel's own transform is divided out of the image beforehand or afterwards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..frame import ArrayFrame, normalise_dims
from . import generate, index, kernels
from .contract import BROADCAST_CELLS, fmac

D = F.col


def _shape(width: int) -> float:
    return 2.3 * width


def _grid(dims, oversampling: float) -> dict[int, int]:
    """Sizes of the oversampled grid, even, of the dimensions that are transformed."""
    return {k: 2 * math.ceil(oversampling * dims[k] / 2) for k in (0, 1, 2) if dims[k] > 1}


def _roll_off(spark, dims, sizes, width: int) -> ArrayFrame:
    """What the kernel's transform takes away at every place of the image, inverted."""
    out = None
    t, w = np.polynomial.legendre.leggauss(200)
    phi = np.exp(_shape(width) * (np.sqrt(1 - t**2) - 1))
    for k, m in sizes.items():
        x = np.arange(dims[k]) - dims[k] // 2
        ft = width / 2 * (np.cos(math.pi * width * np.outer(x, t) / m) * (phi * w)).sum(1)
        line = generate.vec(spark, 1 / ft)
        line = index.permute(line, [*range(1, k + 1), 0]) if k else line
        out = line if out is None else fmac(out, line)
    return out


def _places(traj: ArrayFrame, dims, sizes, width: int):
    """(keys of a sample, g0.., w): the cells around every sample and their weights."""
    keys = [k for k in traj.keys if k != "d0"]
    pick = lambda c: F.coalesce(F.max(F.when(D("d0") == c, D("re"))), F.lit(0.0)).alias(f"k{c}")
    df = traj.densify().df.groupBy(*keys).agg(*(pick(c) for c in (0, 1, 2)))
    df = df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width ** len(sizes) - 1))))
    weight, s, cols = F.lit(1.0), 1, []
    for k, m in sizes.items():
        p = D(f"k{k}") * (m / dims[k]) + m // 2
        cell = F.ceil(p - width / 2) + F.pmod(F.call_function("div", D("j"), F.lit(s)), F.lit(width))
        z = 1 - ((cell - p) * (2 / width)) ** 2
        weight = weight * F.when(z >= 0, F.exp(_shape(width) * (F.sqrt(F.greatest(z, F.lit(0.0))) - 1))).otherwise(0.0)
        cols.append(F.pmod(cell, F.lit(m)).cast("int").alias(f"g{k}"))
        s *= width
    return keys, df.select(*keys, *cols, weight.alias("w"))


def nufft(traj: ArrayFrame, image: ArrayFrame, width: int = 6, oversampling: float = 2.0) -> ArrayFrame:
    """Values of the image's transform at a trajectory (dim 0: components in cycles per field of view); unitary scale. Dimensions of the image from the fourth on are kept."""
    sizes = _grid(image.dims, oversampling)
    keys, places = _places(traj, image.dims, sizes, width)
    other = [c for c in image.keys if int(c[1:]) not in sizes]
    if set(other) & set(keys):
        raise ValueError("a dimension is both in the image and in the trajectory")
    x = fmac(image, _roll_off(image.spark, image.dims, sizes, width))
    x = index.resize(x, "centre", **{f"d{k}": m for k, m in sizes.items()})
    grid = kernels.fft(x, sum(1 << k for k in sizes))
    cells = grid.df.select(*(D(f"d{k}").alias(f"g{k}") for k in sizes), *(D(c).alias(f"o{c}") for c in other), "re", "im")
    hit = places.join(F.broadcast(cells) if grid.size <= BROADCAST_CELLS else cells, [f"g{k}" for k in sizes])
    scale = 1 / math.sqrt(math.prod(image.dims[k] for k in sizes))
    sums = hit.groupBy(*keys, *(f"o{c}" for c in other)).agg((F.sum(D("w") * D("re")) * scale).alias("re"), (F.sum(D("w") * D("im")) * scale).alias("im"))
    dims = [1, *traj.dims[1:]]
    for c in other:
        dims[int(c[1:])] = image.dims[int(c[1:])]
    return ArrayFrame.of(sums.withColumnsRenamed({f"o{c}": c for c in other}), dims)


def nufft_adjoint(traj: ArrayFrame, samples: ArrayFrame, dims, width: int = 6, oversampling: float = 2.0) -> ArrayFrame:
    """The adjoint: an image of the given sizes from samples along a trajectory."""
    dims = normalise_dims(dims)
    sizes = _grid(dims, oversampling)
    keys, places = _places(traj, dims, sizes, width)
    other = [c for c in samples.keys if c not in keys]
    hit = places.join(samples.df, keys)
    sums = hit.groupBy(*(D(f"g{k}").alias(f"d{k}") for k in sizes), *other).agg(F.sum(D("w") * D("re")).alias("re"), F.sum(D("w") * D("im")).alias("im"))
    big = [sizes.get(k, dims[k]) for k in range(len(dims))]
    for c in other:
        big[int(c[1:])] = samples.dims[int(c[1:])]
    x = kernels.fft(ArrayFrame.of(sums, big), sum(1 << k for k in sizes), inverse=True)
    x = index.resize(x, "centre", **{f"d{k}": dims[k] for k in sizes})
    x = fmac(x, _roll_off(x.spark, dims, sizes, width))
    scale = 1 / math.sqrt(math.prod(dims[k] for k in sizes))
    return x.with_values(D("re") * scale, D("im") * scale)


def nufftbase(traj: ArrayFrame, dims) -> ArrayFrame:
    """The point-spread function on a grid of twice the size, by the adjoint of ones: the normal operator is a convolution with it."""
    dims = normalise_dims(dims)
    big = tuple(2 * d if k < 3 and d > 1 else d for k, d in enumerate(dims))
    twice = traj.with_values(D("re") * 2.0, D("im"))
    ones = generate.ones(traj.spark, [1, *traj.dims[1:]])
    x = nufft_adjoint(twice, ones, big)
    scale = math.sqrt(math.prod(b for b, d in zip(big, dims, strict=True) if b != d)) / math.prod(d for b, d in zip(big, dims, strict=True) if b != d)
    return x.with_values(D("re") * scale, D("im") * scale)


def nufft_inverse(traj: ArrayFrame, samples: ArrayFrame, dims, iterations: int = 10, ridge: float = 0.0) -> ArrayFrame:
    """Least squares by conjugate gradients, every step written out."""
    from . import algorithms as A

    normal = lambda x: A.Vector(nufft_adjoint(traj, nufft(traj, x.a), dims)) + ridge * x
    return A.conjugate_gradients(normal, A.Vector(nufft_adjoint(traj, samples, dims)), iterations).a


def grog_weights(kspace: ArrayFrame, dim: int, coil: int = 3) -> np.ndarray:
    """The matrix that takes all coils of a sample to those of its neighbour along a dimension, fitted over all pairs of neighbours (sums on the cluster)."""
    n, m = kspace.dims[dim], kspace.dims[coil]
    near = index.extract(kspace, dim, 1, n)
    here = index.extract(kspace, dim, 0, n - 1)
    both = index.join(coil, here, near)
    from .contract import covariance

    g = covariance(both, ((1 << 16) - 1) ^ (1 << coil), centre=False)
    return np.linalg.lstsq(g[:m, :m].T, g[m:, :m].T, rcond=None)[0].T


def grog(traj: ArrayFrame, samples: ArrayFrame, dims, matrices: dict[int, np.ndarray], coil: int = 3) -> ArrayFrame:
    """Samples moved to the cells next to them by fractional powers of the matrices of every axis, and averaged there.

    Offsets are taken in steps of 1/16 of a cell, so that matrices are few."""
    dims, steps = normalise_dims(dims), 16
    keys = [k for k in traj.keys if k != "d0"]
    axes = sorted(matrices)
    pick = lambda c: F.coalesce(F.max(F.when(D("d0") == c, D("re"))), F.lit(0.0)).alias(f"k{c}")
    pos = traj.densify().df.groupBy(*keys).agg(*(pick(c) for c in axes))
    cells = [(F.floor(D(f"k{k}") + 0.5)).alias(f"c{k}") for k in axes]
    pos = pos.select(*keys, *(f"k{k}" for k in axes), *cells)
    offs = [F.floor((D(f"c{k}") - D(f"k{k}")) * steps + 0.5).cast("int").alias(f"s{k}") for k in axes]
    df = samples.df.join(pos.select(*keys, *(f"c{k}" for k in axes), *offs), keys)
    for k in axes:
        w, v = np.linalg.eig(matrices[k])
        inv, rows = np.linalg.inv(v), []
        for s in range(-steps // 2, steps // 2 + 1):
            g = (v * w.astype(complex) ** (s / steps)) @ inv
            rows += [(s, int(j), int(i), float(z.real), float(z.imag)) for (i, j), z in np.ndenumerate(g)]
        mat = F.broadcast(samples.spark.createDataFrame(rows, f"s{k} int, d{coil} int, o int, re2 double, im2 double"))
        rest = [c for c in df.columns if c not in (f"d{coil}", "re", "im", f"s{k}")]
        df = df.join(mat, [f"s{k}", f"d{coil}"]).groupBy(*rest, "o").agg(F.sum(D("re") * D("re2") - D("im") * D("im2")).alias("re"), F.sum(D("re") * D("im2") + D("im") * D("re2")).alias("im")).withColumnRenamed("o", f"d{coil}")
    place = [(D(f"c{k}") + dims[k] // 2).cast("int").alias(f"d{k}") for k in axes]
    df = df.select(*place, f"d{coil}", "re", "im")
    for k in axes:
        df = df.where((D(f"d{k}") >= 0) & (D(f"d{k}") < dims[k]))
    out = [samples.dims[coil] if k == coil else d for k, d in enumerate(dims)]
    return ArrayFrame.of(df.groupBy(*(f"d{k}" for k in axes), f"d{coil}").agg(F.avg("re").alias("re"), F.avg("im").alias("im")), out)
