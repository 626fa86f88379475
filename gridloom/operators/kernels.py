"""Dense kernels on blocks: one numpy call for each index of the other dimensions (a group of bounded, known size)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..frame import ArrayFrame, flag_dims

#: Cells of a block that one task may hold.
BLOCK_CELLS = 1 << 24


def by(df, names: list[str]):
    """Groups by these columns; one group without any."""
    return df.groupBy(*names) if names else df.withColumn("whole", F.lit(0)).groupBy("whole")


def blockwise(a: ArrayFrame, flags: int, kernel: Callable[[np.ndarray], np.ndarray], sizes: dict[int, int] | None = None) -> ArrayFrame:
    """kernel over the flagged dimensions (in ascending order) for each index of the others; sizes: new sizes of flagged dimensions."""
    own = [k for k in flag_dims(flags) if a.dims[k] > 1 or (sizes or {}).get(k, 1) > 1]
    shape = [a.dims[k] for k in own]
    if int(np.prod(shape, dtype=np.int64)) > BLOCK_CELLS:
        raise ValueError("the block is too large for one task; transform one dimension at a time")
    dims = a.replace_dims(**{f"d{k}": s for k, s in (sizes or {}).items()})
    rest = a.complement(flags)
    out_own = [f"d{k}" for k in own if dims[k] > 1]

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(shape, complex)
        x[tuple(t[f"d{k}"].to_numpy() if d > 1 else 0 for k, d in zip(own, shape, strict=True))] = t["re"].to_numpy() + 1j * t["im"].to_numpy()
        y = kernel(x).reshape([dims[k] for k in own])
        at = np.indices(y.shape, dtype=np.int32).reshape(y.ndim, -1)
        cols = {c: np.full(y.size, key[i], np.int32) for i, c in enumerate(rest)}
        cols |= {f"d{k}": at[i] for i, k in enumerate(own) if dims[k] > 1}
        return pd.DataFrame(cols | {"re": y.real.ravel(), "im": y.imag.ravel()})

    schema = ", ".join([*(f"{c} int" for c in [*rest, *out_own]), "re double", "im double"])
    return ArrayFrame.of(by(a.df, rest).applyInPandas(run, schema), dims)


def fft(a, flags: int, inverse: bool = False, unitary: bool = False, centred: bool = True):
    """Fourier transform over the flagged dimensions; not normalised unless unitary. Large blocks go dimension by dimension."""
    own = a.selected(flags)
    if a.extent(flags) > BLOCK_CELLS // 16 and len(own) > 1:
        for k in own:
            a = fft(a, 1 << k, inverse, unitary, centred)
        return a

    def kernel(x):
        axes = tuple(range(x.ndim))
        x = np.fft.ifftshift(x, axes) if centred else x
        y = np.fft.ifftn(x, axes=axes) * x.size if inverse else np.fft.fftn(x, axes=axes)
        y = np.fft.fftshift(y, axes) if centred else y
        return y / np.sqrt(x.size) if unitary else y

    return blockwise(a, flags, kernel)


def _lift97(x: np.ndarray, inverse: bool) -> np.ndarray:
    """One-dimensional CDF 9/7 lifting along the first axis, all levels of one split; symmetric ends."""
    p1, u1, p2, u2, k = -1.586134342, -0.05298011854, 0.8829110762, 0.4435068522, 1.149604398
    n = len(x)
    half = (n + 1) // 2
    if n < 2:
        return x

    def predict(s, d, c):
        return d + c * (s[: len(d)] + np.concatenate([s[1:], s[-1:]])[: len(d)])

    def update(s, d, c):
        left = np.concatenate([d[:1], d])[: len(s)]
        right = np.concatenate([d, d[-1:]])[: len(s)]
        return s + c * (left + right)

    if not inverse:
        s, d = x[0::2], x[1::2]
        d = predict(s, d, p1)
        s = update(s, d, u1)
        d = predict(s, d, p2)
        s = update(s, d, u2)
        return np.concatenate([s / k, d * k])
    s, d = x[:half] * k, x[half:] / k
    s = update(s, d, -u2)
    d = predict(s, d, -p2)
    s = update(s, d, -u1)
    d = predict(s, d, -p1)
    out = np.empty_like(x)
    out[0::2], out[1::2] = s, d
    return out


def cdf97(a, flags: int, inverse: bool = False):
    """One split of the CDF 9/7 wavelet along each flagged dimension, coefficients sorted low to high."""

    def kernel(x):
        for i in range(x.ndim):
            x = np.moveaxis(_lift97(np.moveaxis(x, i, 0), inverse), 0, i)
        return x

    return blockwise(a, flags, kernel)


_FILTERS = {"haar": np.array([1, 1]) / np.sqrt(2), "dau2": np.array([0.4829629131445341, 0.8365163037378079, 0.2241438680420134, -0.1294095225512604])}


def _orthogonal(x: np.ndarray, h: np.ndarray, inverse: bool) -> np.ndarray:
    """A cyclic orthogonal filter bank along the first axis (even length)."""
    n = len(x)
    g = h[::-1] * (-1) ** np.arange(len(h))
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(h))) % n
    if not inverse:
        return np.concatenate([np.tensordot(x[at], f, ([1], [0])) if x.ndim == 1 else np.einsum("ij...,j->i...", x[at], f) for f in (h, g)])
    out = np.zeros_like(x)
    for part, f in ((x[: n // 2], h), (x[n // 2 :], g)):
        for j, c in enumerate(f):
            np.add.at(out, at[:, j], c * part)
    return out


def wavelet(a, flags: int, adjoint: bool = False, kind: str = "dau2", coarsest: int = 16):
    """Orthogonal wavelet transform over the flagged dimensions, down to the coarsest even size; adjoint = inverse."""
    h = _FILTERS[kind]

    def kernel(x):
        sizes, levels = list(x.shape), []
        while all(s % 2 == 0 and s // 2 >= coarsest for s in sizes):
            levels.append(tuple(slice(0, s) for s in sizes))
            sizes = [s // 2 for s in sizes]
        x = x.copy()
        for block in reversed(levels) if adjoint else levels:
            for i in range(x.ndim):
                x[block] = np.moveaxis(_orthogonal(np.moveaxis(x[block], i, 0), h, adjoint), 0, i)
        return x

    return blockwise(a, flags, kernel)


def fftrot(a, i: int, j: int, degrees: float):
    """Rotation in a plane by three shears in Fourier space."""
    t = np.deg2rad(degrees)

    def shear(x, axis, by):
        n, m = x.shape[axis], x.shape[1 - axis]
        k = np.fft.fftfreq(n)
        s = by * (np.arange(m) - m // 2)
        ph = np.exp(-2j * np.pi * np.outer(k, s))
        return np.fft.ifft(np.fft.fft(x, axis=axis) * (ph if axis == 0 else ph.T), axis=axis)

    def kernel(x):
        x = x if i < j else x.T
        x = shear(shear(shear(x, 0, -np.tan(t / 2)), 1, np.sin(t)), 0, -np.tan(t / 2))
        return x if i < j else x.T

    return blockwise(a, 1 << i | 1 << j, kernel)


def svd(a, economy: bool = True):
    """(U, singular values, V^H) of a matrix over dims 0 and 1, by the Gram matrix of its shorter side."""
    from .contract import apply_matrix, covariance

    m, n = a.dims[:2]
    if a.size != m * n:
        raise ValueError("a matrix is needed")
    if n > m:
        from .index import transpose

        v, s, uh = svd(transpose(a, 0, 1), economy)
        return transpose(uh, 0, 1), s, transpose(v, 0, 1)
    g = covariance(a, 1, centre=False).conj()  # A^H A, of the shorter side
    w, q = np.linalg.eigh(g)
    order = np.argsort(-w)
    s, q = np.sqrt(np.maximum(w[order], 0)), q[:, order]
    inv = np.divide(1, s, out=np.zeros_like(s), where=s > s[0] * 1e-12)
    u = apply_matrix(a, (q * inv).T, 1)
    return u, s, ArrayFrame.from_numpy(a.spark, q.conj().T)


def singular_threshold(a, level: float, flags: int):
    """Soft threshold of the singular values of each block (two flagged dimensions)."""

    def kernel(x):
        u, s, vh = np.linalg.svd(x, full_matrices=False)
        return (u * np.maximum(s - level, 0)) @ vh

    return blockwise(a, flags, kernel)


def nlmeans(a, flags: int, patch: int = 5, distance: int = 5, h: float = 0.04, spread: float | None = None):
    """Non-local means: every cell within the distance weighs exp(-d / (2 h^2)), d being the squared difference of the
    patches around both, weighed by a Gaussian (standard deviation spread) of norm one. Ends are reflected."""
    spread = ((patch - 1) / 4 if patch > 1 else 1.0) if spread is None else spread

    def kernel(x):
        r, n = patch // 2, x.ndim
        p = np.pad(x, r + distance, mode="reflect")
        at = np.arange(patch) - r
        g = np.exp(-sum(o**2 for o in np.meshgrid(*[at] * n, indexing="ij")) / (2 * spread**2))
        g /= np.sqrt((g**2).sum())
        total, weight = np.zeros_like(x), np.zeros(x.shape)
        own = tuple(slice(distance, distance + s + 2 * r) for s in x.shape)
        for shift in np.ndindex(*(2 * distance + 1,) * n):
            other = p[tuple(slice(k, k + s + 2 * r) for k, s in zip(shift, x.shape))]
            d2 = np.abs(p[own] - other) ** 2
            d = np.einsum(np.lib.stride_tricks.sliding_window_view(d2, (patch,) * n), list(range(2 * n)), g, list(range(n, 2 * n)), list(range(n)))
            w = np.exp(-d / (2 * h**2))
            total += w * other[tuple(slice(r, r + s) for s in x.shape)]
            weight += w
        return total / weight

    return blockwise(a, flags, kernel)


def rof(a, level: float, flags: int, iterations: int = 100):
    """Total-variation denoising, min 1/2 |x - y|^2 + level TV(x), by a dual projection on each block."""

    def kernel(y):
        def grad(x):
            return np.stack([np.roll(x, -1, i) - x for i in range(x.ndim)])

        def div(p):
            return sum(q - np.roll(q, 1, i) for i, q in enumerate(p))

        p = np.zeros((y.ndim, *y.shape), complex)
        for _ in range(iterations):
            g = grad(div(p) + y / level)
            p = p + g / (4 * y.ndim)
            p /= np.maximum(1, np.sqrt((np.abs(p) ** 2).sum(0)))
        return y + level * div(p)

    return blockwise(a, flags, kernel)


#: Cells of an image that direct transforms may have: every sample is summed over all of them.
DIRECT_CELLS = 1 << 16


def _phases(traj, dims, keys):
    """(columns of the places of samples, angle of sample and cell) of a direct transform; cells have columns x0, x1, x2."""
    if np.prod(dims[:3], dtype=np.int64) > DIRECT_CELLS:
        raise ValueError("the image is too large for a direct transform; use nufft")
    pick = lambda c: F.coalesce(F.max(F.when(F.col("d0") == c, F.col("re"))), F.lit(0.0)).alias(f"k{c}")
    pos = traj.densify().df.groupBy(*keys).agg(*(pick(c) for c in range(3)))
    angle = F.lit(0.0)
    for k in (0, 1, 2):
        if dims[k] > 1:
            angle = angle - F.col(f"k{k}") * (F.col(f"x{k}") - dims[k] // 2) * (2 * np.pi / dims[k])
    return pos, angle


def nudft(traj, image):
    """Direct non-uniform Fourier transform: every sample as a sum over all cells of a small image."""
    keys = [k for k in traj.keys if k != "d0"]
    pos, angle = _phases(traj, image.dims, keys)
    pix = image.df.withColumnsRenamed({k: f"x{k[1:]}" for k in image.keys})
    c, s, scale = F.cos(angle), F.sin(angle), 1 / np.sqrt(image.size)
    re, im = F.col("re"), F.col("im")
    df = pos.crossJoin(F.broadcast(pix)).groupBy(*keys).agg((F.sum(re * c - im * s) * scale).alias("re"), (F.sum(re * s + im * c) * scale).alias("im"))
    return ArrayFrame.of(df, (1, *traj.dims[1:]))


def nudft_adjoint(traj, samples, dims):
    """The adjoint of nudft: every cell of a small image as a sum over all samples."""
    from .generate import zeros

    dims = tuple(dims) + (1,) * (16 - len(dims))
    keys = [k for k in traj.keys if k != "d0"]
    pos, angle = _phases(traj, dims, keys)
    cells = zeros(traj.spark, dims)
    pix = cells.df.select(*(F.col(k).alias(f"x{k[1:]}") for k in cells.keys))
    c, s, scale = F.cos(angle), F.sin(angle), 1 / np.sqrt(cells.size)
    re, im = F.col("re"), F.col("im")
    both = pos.join(samples.df, keys).crossJoin(F.broadcast(pix))
    df = both.groupBy(*(F.col(f"x{k[1:]}").alias(k) for k in cells.keys)).agg((F.sum(re * c + im * s) * scale).alias("re"), (F.sum(im * c - re * s) * scale).alias("im"))
    return ArrayFrame.of(df, dims)
