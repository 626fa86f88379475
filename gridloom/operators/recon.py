"""Reconstruction and calibration: a problem for each index of the dimensions that loop (slices, frames), solved by one task.

The iterations of one problem stay inside a task, over arrays of bounded, known size; problems run side by side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame, flag_dims, normalise_dims
from . import algorithms as A
from .index import repmat
from .kernels import BLOCK_CELLS, blockwise, by

IMAGE, COIL = 7, 1 << 3


def together(inputs: list[ArrayFrame], flags: int, kernel: Callable[..., np.ndarray], dims) -> ArrayFrame:
    """kernel over the flagged dimensions of several arrays, for each index of the others; size 1 is repeated over a loop."""
    dims = normalise_dims(dims)
    loops = [k for k in range(16) if not flags >> k & 1 and max(a.dims[k] for a in inputs) > 1]
    own = [k for k in flag_dims(flags) if max([a.dims[k] for a in inputs] + [dims[k]]) > 1 or k == 3]  # one coil is an axis as well
    shapes, parts = [], None
    for i, a in enumerate(inputs):
        shapes.append([a.dims[k] for k in own])
        if np.prod(shapes[-1], dtype=np.int64) > BLOCK_CELLS:
            raise ValueError("a problem is too large for one task")
        for k in loops:
            if a.dims[k] == 1:
                a = repmat(a, k, max(x.dims[k] for x in inputs))
        cols = [F.col(f"d{k}") if a.dims[k] > 1 else F.lit(0).alias(f"d{k}") for k in (*loops, *own)]
        part = a.df.select(F.lit(i).alias("part"), *cols, "re", "im")
        parts = part if parts is None else parts.union(part)
    names, out_own = [f"d{k}" for k in loops], [k for k in own if dims[k] > 1]

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        arrays = []
        for i, shape in enumerate(shapes):
            p, x = t[t["part"] == i], np.zeros(shape, complex)
            x[tuple(p[f"d{k}"].to_numpy() for k in own)] = p["re"].to_numpy() + 1j * p["im"].to_numpy()
            arrays.append(x)
        y = np.asarray(kernel(*arrays), complex).reshape([dims[k] for k in own])
        at = np.indices(y.shape, dtype=np.int32).reshape(y.ndim, -1)
        cols = {c: np.full(y.size, key[i], np.int32) for i, c in enumerate(names)} | {f"d{k}": at[own.index(k)] for k in out_own}
        return pd.DataFrame(cols | {"re": y.real.ravel(), "im": y.imag.ravel()})

    schema = ", ".join([*(f"{c} int" for c in names), *(f"d{k} int" for k in out_own), "re double", "im double"])
    return ArrayFrame.of(by(parts, names).applyInPandas(run, schema), dims)


def _f(x, axes, inverse=False):
    x = np.fft.ifftshift(x, axes)
    return np.fft.fftshift((np.fft.ifftn if inverse else np.fft.fftn)(x, axes=axes, norm="ortho"), axes)


def _axes(kspace: ArrayFrame) -> tuple[tuple[int, ...], int]:
    """(axes of the image, axis of the coils) within a block."""
    own = [k for k in flag_dims(IMAGE | COIL) if kspace.dims[k] > 1 or k == 3]
    return tuple(i for i, k in enumerate(own) if k < 3), own.index(3)


conjugate_gradients = A.conjugate_gradients


def _haar(x, inverse=False, levels=3):
    """Orthonormal Haar transform over all axes, so many levels as the sizes allow."""
    sizes = [x.shape]
    while len(sizes) < levels + 1 and all(n % 2 == 0 or n == 1 for n in sizes[-1]) and max(sizes[-1]) > 1:
        sizes.append(tuple(max(1, n // 2) for n in sizes[-1]))
    x = x.copy()
    for s in reversed(sizes[:-1]) if inverse else sizes[:-1]:
        box = tuple(slice(n) for n in s)
        y = x[box]
        for ax in [i for i, n in enumerate(s) if n > 1]:
            h = y.shape[ax] // 2
            if inverse:
                lo, hi = np.take(y, range(h), ax), np.take(y, range(h, 2 * h), ax)
                y = np.stack([(lo + hi), (lo - hi)], ax + 1).reshape(y.shape) / np.sqrt(2)
            else:
                even, odd = np.take(y, range(0, 2 * h, 2), ax), np.take(y, range(1, 2 * h, 2), ax)
                y = np.concatenate([even + odd, even - odd], ax) / np.sqrt(2)
        x[box] = y
    return x


def soft(x, level):
    r = np.abs(x)
    return x * np.maximum(0, 1 - level / np.maximum(r, 1e-300))


def total_variation(x, level, iterations=40):
    """Proximal step of isotropic total variation by projections of its dual."""
    axes = [i for i, n in enumerate(x.shape) if n > 1]
    p = np.zeros((len(axes), *x.shape), complex)

    def back(p):
        return sum(q - np.roll(q, 1, ax) for q, ax in zip(p, axes, strict=True))

    for _ in range(iterations):
        u = x + level * back(p)
        g = np.stack([np.roll(u, -1, ax) - u for ax in axes])
        p = p + g / (4 * len(axes) * max(level, 1e-300))
        p /= np.maximum(1, np.sqrt((np.abs(p) ** 2).sum(0)))
    return x + level * back(p)


PROX = {"l1": soft, "wavelet": lambda x, t: _haar(soft(_haar(x), t), inverse=True), "tv": total_variation}


def pics(kspace: ArrayFrame, sens: ArrayFrame, regularisation: str = "l2", level: float = 0.0, iterations: int = 30, pattern: ArrayFrame | None = None) -> ArrayFrame:
    """Image of undersampled coil data: least squares with an l2 penalty (conjugate gradients), or l1, wavelet or tv (accelerated proximal gradient)."""
    axes, coil = _axes(kspace)

    def kernel(y, s, mask=None):
        mask = (np.abs(y).max(coil, keepdims=True) > 0) if mask is None else np.abs(mask) > 0
        forward = lambda x: mask * _f(s * x, axes)
        adjoint = lambda y: (s.conj() * _f(mask * y, axes, inverse=True)).sum(coil, keepdims=True)
        b = adjoint(y)
        if regularisation == "l2":
            return conjugate_gradients(lambda x: adjoint(forward(x)) + level * x, b, iterations)
        bound = max((np.abs(s) ** 2).sum(coil).max(), 1e-300)
        x = z = np.zeros_like(b)
        t = 1.0
        for _ in range(iterations):
            new = PROX[regularisation](z - (adjoint(forward(z)) - b) / bound, level / bound)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, x, t = new + (t - 1) / t2 * (new - x), new, t2
        return x

    return together([kspace, sens] + ([pattern] if pattern is not None else []), IMAGE | COIL, kernel, kspace.replace_dims(d3=1))


def low_rank_blocks(x, level: float, size: int, axes):
    """Soft singular values of every block of `size` cells a side over the image axes, as (cells, all other axes)."""
    x = x.copy()
    steps = [range(0, x.shape[ax], size) if x.shape[ax] > 1 else (0,) for ax in axes]
    for start in np.array(np.meshgrid(*steps, indexing="ij")).reshape(len(axes), -1).T:
        at = [slice(None)] * x.ndim
        for ax, i in zip(axes, start, strict=True):
            at[ax] = slice(i, i + size)
        block = x[tuple(at)]
        order = [*axes, *(i for i in range(x.ndim) if i not in axes)]
        turned = block.transpose(order)
        m = turned.reshape(int(np.prod(turned.shape[: len(axes)])), -1)
        u, w, vh = np.linalg.svd(m, full_matrices=False)
        x[tuple(at)] = ((u * np.maximum(w - level, 0)) @ vh).reshape(turned.shape).transpose(np.argsort(order))
    return x


def _keep_largest(x, k: int):
    r = np.abs(x).ravel()
    return x if k >= r.size else np.where(np.abs(x) > np.partition(r, r.size - k - 1)[r.size - k - 1], x, 0)


def penalty(code: str, level: float, axes, block: int = 8):
    """(transform, its adjoint, prox(v, step)) of a penalty: I l1, Q l2, W wavelet l1, H and N the k largest (of wavelets, of the image),
    T total variation, G second-order, C two parts, F l1 of the spectrum, L locally low rank, M the same at several sizes,
    R1 and R2 l1 and l2 of the imaginary part, S real and not negative."""
    same = lambda x: x
    diff = lambda x: np.stack([np.roll(x, -1, ax) - x for ax in axes if x.shape[ax] > 1])
    back = lambda p: sum(np.roll(q, 1, ax) - q for q, ax in zip(p, [ax for ax in axes if p.shape[ax + 1] > 1], strict=True))
    wav, unwav = _haar, lambda x: _haar(x, inverse=True)
    imaginary = lambda f: lambda v, t: v.real + 1j * f(v.imag, level * t)

    def joint(v, t):
        r = np.sqrt((np.abs(v) ** 2).sum(0))
        return v * np.maximum(0, 1 - level * t / np.maximum(r, 1e-300))

    def scales(v, t):
        sizes = [block * 2**k for k in range(3)]
        return sum(low_rank_blocks(v, level * t, s, axes) for s in sizes) / len(sizes)

    return {
        "I": (same, same, lambda v, t: soft(v, level * t)),
        "Q": (same, same, lambda v, t: v / (1 + level * t)),
        "W": (wav, unwav, lambda v, t: soft(v, level * t)),
        "H": (wav, unwav, lambda v, t: _keep_largest(v, int(level))),
        "N": (same, same, lambda v, t: _keep_largest(v, int(level))),
        "T": (diff, back, joint),
        "G": (same, same, lambda v, t: second_order_variation(v, level * t, iterations=50)),
        "C": (same, same, lambda v, t: two_part_variation(v, level * t, level * t, iterations=50)),
        "F": (lambda x: np.fft.fftn(x, axes=axes, norm="ortho"), lambda x: np.fft.ifftn(x, axes=axes, norm="ortho"), lambda v, t: soft(v, level * t)),
        "L": (same, same, lambda v, t: low_rank_blocks(v, level * t, block, axes)),
        "M": (same, same, scales),
        "R1": (same, same, imaginary(lambda x, t: np.sign(x) * np.maximum(np.abs(x) - t, 0))),
        "R2": (same, same, imaginary(lambda x, t: x / (1 + t))),
        "S": (same, same, lambda v, t: np.maximum(v.real, 0) + 0j),
    }[code]


def pics_penalties(kspace: ArrayFrame, sens: ArrayFrame, penalties: list[tuple[str, float]], solver: str = "admm", iterations: int = 50, rho: float = 0.5, joint: int = 0, pattern: ArrayFrame | None = None) -> ArrayFrame:
    """Image of undersampled coil data under several penalties (code, level) at once, by admm or primal-dual steps ("pridu"), or one of them by fista or ist.

    joint: further dimensions (frames) that are solved together, for the low-rank penalties."""
    if solver not in ("admm", "pridu", "fista", "ist"):
        raise ValueError(f"unknown solver {solver}")
    if solver in ("fista", "ist") and len(penalties) != 1:
        raise ValueError("fista and ist take one penalty")
    axes, coil = _axes(kspace)

    def kernel(y, s, mask=None):
        extra = y.ndim - s.ndim
        s = s.reshape(*s.shape, *[1] * extra) if extra > 0 else s
        mask = (np.abs(y).max(coil, keepdims=True) > 0) if mask is None else np.abs(mask) > 0
        adjoint = lambda r: (s.conj() * _f(mask * r, axes, inverse=True)).sum(coil, keepdims=True)
        normal = lambda x: adjoint(_f(s * x, axes))
        b = adjoint(y)
        terms = [penalty(code, level, axes) for code, level in penalties]
        if solver == "admm":
            return A.admm(normal, b, terms, 0 * b, rho, iterations)
        bound = max((np.abs(s) ** 2).sum(coil).max(), 1e-300)
        if solver == "pridu":
            # the data term by its gradient (Condat's form): all penalties are dual
            tau = 0.9 / (bound / 2 + sum(4.0 * max(1, len(axes)) for _ in terms))
            x, p = 0 * b, [0 * t(b) for t, _, _ in terms]
            for _ in range(iterations):
                new = x - tau * (normal(x) - b + sum(back(q) for (_, back, _), q in zip(terms, p, strict=True)))
                bar, x = 2 * new - x, new
                for i, (t, _, prox) in enumerate(terms):
                    v = p[i] + t(bar)
                    p[i] = v - prox(v, 1.0)
            return x
        t, back, prox = terms[0]
        solve = A.fista if solver == "fista" else A.ist
        return solve(lambda x: normal(x) - b, lambda x, step: back(prox(t(x), step)), 0 * b, 1 / bound, iterations)

    inputs = [kspace, sens] + ([pattern] if pattern is not None else [])
    return together(inputs, IMAGE | COIL | joint, kernel, kspace.replace_dims(d3=1))


def itsense(alpha: float, sens: ArrayFrame, kspace: ArrayFrame, pattern: ArrayFrame, iterations: int = 50) -> ArrayFrame:
    return pics(kspace, sens, "l2", alpha, iterations, pattern)


def pocsense(kspace: ArrayFrame, sens: ArrayFrame, iterations: int = 50) -> ArrayFrame:
    """k-space filled by projections in turn: onto what the coils allow, and onto the measured samples."""
    axes, coil = _axes(kspace)

    def kernel(y, s):
        mask, x = np.abs(y) > 0, y
        norm = np.maximum((np.abs(s) ** 2).sum(coil, keepdims=True), 1e-300)
        for _ in range(iterations):
            image = (s.conj() * _f(x, axes, inverse=True)).sum(coil, keepdims=True) / norm
            x = np.where(mask, y, _f(s * image, axes))
        return x

    return together([kspace, sens], IMAGE | COIL, kernel, kspace.dims)


def denoise(a: ArrayFrame, kind: str = "tv", level: float = 0.1, flags: int = IMAGE) -> ArrayFrame:
    return blockwise(a, flags, lambda x: PROX[kind](x, level))


def second_order_variation(f, level: float, ratio: float = 2.0, iterations: int = 200):
    """Second-order total generalised variation of one block by primal-dual steps."""
    axes = [i for i, n in enumerate(f.shape) if n > 1]
    d = lambda u: np.stack([np.roll(u, -1, ax) - u for ax in axes])
    dt = lambda p: sum(np.roll(q, 1, ax) - q for q, ax in zip(p, axes, strict=True))
    sym = lambda e: (e + e.swapaxes(0, 1)) / 2
    shrink = lambda p, r: p / np.maximum(1, np.sqrt((np.abs(p) ** 2).sum(tuple(range(p.ndim - f.ndim)))) / r)
    u, w = f.copy(), np.zeros((len(axes), *f.shape), complex)
    ub, wb, p, q = u, w, np.zeros_like(w), np.zeros((len(axes), *w.shape), complex)
    step = 1 / np.sqrt(4 * len(axes) + 5)
    for _ in range(iterations):
        p = shrink(p + step * (d(ub) - wb), level)
        q = shrink(q + step * sym(np.stack([d(x) for x in wb])), ratio * level)
        u2 = (u - step * dt(p) + step * f) / (1 + step)
        w2 = w + step * (p - np.stack([dt(x) for x in q]))
        ub, wb, u, w = 2 * u2 - u, 2 * w2 - w, u2, w2
    return u


def tgv(a: ArrayFrame, level: float, flags: int = 3, ratio: float = 2.0, iterations: int = 200) -> ArrayFrame:
    """Denoising by second-order total generalised variation."""
    return blockwise(a, flags, lambda f: second_order_variation(f, level, ratio, iterations))


def two_part_variation(f, level1: float, level2: float, weight: float = 4.0, iterations: int = 300):
    """A sum of two parts near f, one of small variation mainly along the first dimension, one along the others."""
    axes = [i for i, n in enumerate(f.shape) if n > 1]
    factors = [np.array([weight if i == 0 else 1.0 for i in range(len(axes))]), np.array([1.0 if i == 0 else weight for i in range(len(axes))])]
    grad = lambda u, c: np.stack([k * (np.roll(u, -1, ax) - u) for k, ax in zip(c, axes, strict=True)])
    back = lambda p, c: sum(k * (np.roll(q, 1, ax) - q) for k, q, ax in zip(c, p, axes, strict=True))
    shrink = lambda p, r: p / np.maximum(1, np.sqrt((np.abs(p) ** 2).sum(0)) / r)
    u = [f / 2, f / 2]
    bar, p = list(u), [np.zeros((len(axes), *f.shape), complex) for _ in u]
    step = 1 / np.sqrt(4 * len(axes) * weight**2 + 2)
    for _ in range(iterations):
        p = [shrink(q + step * grad(b, c), lv) for q, b, c, lv in zip(p, bar, factors, (level1, level2), strict=True)]
        new = [x - step * back(q, c) for x, q, c in zip(u, p, factors, strict=True)]
        off = (new[0] + new[1] - f) * step / (1 + 2 * step)
        new = [x - off for x in new]
        bar, u = [2 * n - o for n, o in zip(new, u, strict=True)], new
    return u[0] + u[1]


def ictv(a: ArrayFrame, level1: float, level2: float, flags: int = 3, weight: float = 4.0, iterations: int = 300) -> ArrayFrame:
    """Denoising by infimal convolution of two total variations."""
    return blockwise(a, flags, lambda f: two_part_variation(f, level1, level2, weight, iterations))


def lrmatrix(a: ArrayFrame, rows: int, columns: int, rank_level: float, iterations: int = 100) -> ArrayFrame:
    """Completion of a matrix (flags of its rows and of its columns) whose zeros are unknown, by soft singular values."""
    row_dims = [k for k in flag_dims(rows | columns) if a.dims[k] > 1]
    split = [i for i, k in enumerate(row_dims) if rows >> k & 1], [i for i, k in enumerate(row_dims) if columns >> k & 1]

    def kernel(y):
        order = [*split[0], *split[1]]
        m = y.transpose(order).reshape(int(np.prod([y.shape[i] for i in split[0]])), -1)
        known, x = m != 0, m
        for _ in range(iterations):
            u, s, v = np.linalg.svd(np.where(known, m, x), full_matrices=False)
            x = (u * np.maximum(s - rank_level * s[0], 0)) @ v
        return np.where(known, m, x).reshape([y.shape[i] for i in order]).transpose(np.argsort(order))

    return blockwise(a, rows | columns, kernel)


def _centre(x, axes, sizes):
    box = [slice(None)] * x.ndim
    for ax, n in zip(axes, sizes, strict=True):
        start = x.shape[ax] // 2 - n // 2
        box[ax] = slice(start, start + n)
    return tuple(box)


def caldir(kspace: ArrayFrame, size: int) -> ArrayFrame:
    """Coil maps from the centre of k-space: Kaiser window (beta 4), inverse transform, divided by the root of squares (0 stays 0)."""
    axes, coil = _axes(kspace)

    def kernel(y):
        sizes = [min(size, y.shape[ax]) for ax in axes]
        box, x = _centre(y, axes, sizes), np.zeros_like(y)
        x[box] = y[box]
        for ax, n in zip(axes, sizes, strict=True):
            shape = [1] * y.ndim
            shape[ax] = n
            x[box] = x[box] * np.kaiser(n, 4).reshape(shape)
        image = _f(x, axes, inverse=True)
        r = np.sqrt((np.abs(image) ** 2).sum(coil, keepdims=True))
        return np.divide(image, r, out=np.zeros_like(image), where=r > 0)

    return blockwise(kspace, IMAGE | COIL, kernel)


def ecalib(kspace: ArrayFrame, region: int = 24, kernel_size: int = 6, threshold: float = 0.001, crop: float = 0.8) -> ArrayFrame:
    """Coil maps as leading eigenvectors, at every voxel, of the operator that the calibration region's kernels define."""
    axes, coil = _axes(kspace)

    def kernel(y):
        y = np.moveaxis(y, coil, -1)
        space, c = tuple(range(y.ndim - 1)), y.shape[-1]
        shape = y.shape[:-1]
        sizes = [min(region, n) for n in shape]
        ks = [min(kernel_size, n) for n in sizes]
        cal = y[_centre(y, space, sizes)]
        win = np.lib.stride_tricks.sliding_window_view(cal, ks, axis=space)  # positions.., coil, kernel..
        rows = win.reshape(-1, c * int(np.prod(ks)))
        w, v = np.linalg.eigh(rows.conj().T @ rows)
        v = v[:, w > threshold**2 * w.max()] if w.max() > 0 else v[:, :0]
        cov = np.zeros((*shape, c, c), complex)
        for col in v.T:
            k = np.zeros((c, *shape), complex)
            k[(slice(None), *_centre(k[0], space, ks))] = col.reshape(c, *ks)
            img = np.stack([_f(x, space) for x in k], -1)
            cov += img[..., :, None] * img[..., None, :].conj()
        cov *= np.prod(shape) / np.prod(ks)
        val, vec = np.linalg.eigh(cov)
        lead = vec[..., -1].conj()
        lead = lead * np.exp(-1j * np.angle(lead[..., :1]))
        return np.moveaxis(lead * (val[..., -1:] > crop), -1, coil)

    return blockwise(kspace, IMAGE | COIL, kernel)


def noise_quantile(ratio: float, share: float) -> float:
    """Quantile of the Marchenko-Pastur law (columns by rows) for noise of variance 1."""
    low, high = (1 - np.sqrt(ratio)) ** 2, (1 + np.sqrt(ratio)) ** 2
    x = np.linspace(low, high, 20001)[1:-1]
    mass = np.cumsum(np.sqrt((high - x) * (x - low)) / (2 * np.pi * ratio * x)) * (x[1] - x[0])
    return float(x[min(len(x) - 1, np.searchsorted(mass + max(0.0, 1 - 1 / ratio), share))])


def estvar(kspace: ArrayFrame, region: int = 24, kernel_size: int = 6) -> float:
    """Variance of complex noise from the calibration matrix: the first quartile of its eigenvalues by that of the law for pure noise."""
    axes, coil = _axes(kspace)

    def kernel(y):
        y = np.moveaxis(y, coil, -1)
        space = tuple(range(y.ndim - 1))
        sizes = [min(region, n) for n in y.shape[:-1]]
        cal = y[_centre(y, space, sizes)]
        rows = np.lib.stride_tricks.sliding_window_view(cal, [min(kernel_size, n) for n in sizes], axis=space).reshape(-1, y.shape[-1] * int(np.prod([min(kernel_size, n) for n in sizes])))
        w = np.linalg.eigvalsh(rows.conj().T @ rows) / len(rows)
        return np.full((1,) * y.ndim, np.quantile(w, 0.25) / noise_quantile(rows.shape[1] / len(rows), 0.25))

    dims = kspace.replace_dims(d0=1, d1=1, d2=1, d3=1)
    return float(together([kspace], IMAGE | COIL, kernel, dims).df.agg(F.avg("re")).first()[0])


def rovir(wanted: ArrayFrame, unwanted: ArrayFrame, coil: int = 3) -> np.ndarray:
    """Rows are combinations of coils, first those with the most wanted for their unwanted energy; orthonormal."""
    from .contract import covariance

    flags = ((1 << 16) - 1) ^ (1 << coil)
    a, b = covariance(wanted, flags, centre=False), covariance(unwanted, flags, centre=False)
    l = np.linalg.inv(np.linalg.cholesky(b + 1e-12 * np.trace(b).real / len(b) * np.eye(len(b))))
    _, v = np.linalg.eigh(l @ a @ l.conj().T)
    q, _ = np.linalg.qr((l.conj().T @ v)[:, ::-1])
    return q.conj().T


def homodyne(kspace: ArrayFrame, dim: int, fraction: float) -> ArrayFrame:
    """Partial-Fourier image: samples without a mirror count twice, over the common centre the weight is a ramp; phase from the centre."""
    own = [k for k in flag_dims(IMAGE) if kspace.dims[k] > 1]
    axis, n = own.index(dim), kspace.dims[dim]
    last = int(np.floor(n * fraction))  # samples 0 .. last-1 are there
    first = n - last

    def kernel(y):
        axes = tuple(range(y.ndim))
        i = np.arange(n)
        inner = (i >= first) & (i < last)
        weight = np.where(i < first, 2.0, np.where(inner, 2 - (i - first + 0.5) * 2 / max(1, last - first), 0.0))
        shape = [1] * y.ndim
        shape[axis] = n
        phase = _f(y * inner.reshape(shape), axes, inverse=True)
        phase = phase / np.maximum(np.abs(phase), 1e-300)
        return (_f(y * weight.reshape(shape), axes, inverse=True) * phase.conj()).real * phase

    return blockwise(kspace, IMAGE, kernel)


def estshift(a: ArrayFrame, b: ArrayFrame, flags: int) -> dict[int, float]:
    """Shift of b against a along each flagged dimension, from a weighted fit of the phase of their spectra."""
    from .contract import fmac
    from .kernels import fft

    out = {}
    for k in a.selected(flags):
        n = a.dims[k]
        rest = ((1 << 16) - 1) ^ (1 << k)
        cross = fmac(fft(a, 1 << k), fft(b, 1 << k), squash=rest, conj=True).to_numpy().ravel()
        f = np.arange(n) - n // 2
        step = np.angle((cross[1:] * cross[:-1].conj()).sum())
        left = np.angle(cross * np.exp(-1j * step * f) * np.exp(-1j * np.angle((cross * np.exp(-1j * step * f)).sum())))
        w = np.abs(cross)
        out[k] = float((step + (w * f * left).sum() / max((w * f * f).sum(), 1e-300)) * n / (2 * np.pi))
    return out


def poisson(spark: SparkSession, y: int, z: int, distance: float = 2.0, density: float = 0.0, centre: int = 0, seed: int = 1, elliptical: bool = False) -> ArrayFrame:
    """A mask on dims 1 and 2 whose samples keep a distance that grows by `density` towards the edge; the centre is full. Dart throwing is sequential and runs on the driver."""
    rng = np.random.default_rng(seed)
    mask, taken = np.zeros((y, z), bool), np.zeros((y, z), bool)
    yy, zz = np.mgrid[:y, :z]
    r = np.sqrt(((yy - y // 2) / (y / 2)) ** 2 + ((zz - z // 2) / (z / 2)) ** 2)
    reach = distance * (1 + density * r)
    for at in rng.permutation(y * z):
        i, j = divmod(int(at), z)
        if taken[i, j]:
            continue
        mask[i, j] = True
        d = int(np.ceil(reach[i, j]))
        box = (slice(max(0, i - d), i + d + 1), slice(max(0, j - d), j + d + 1))
        taken[box] |= (yy[box] - i) ** 2 + (zz[box] - j) ** 2 < reach[i, j] ** 2
    if elliptical:
        mask &= r <= 1
    if centre:
        mask[_centre(mask, (0, 1), (min(centre, y), min(centre, z)))] = True
    return ArrayFrame.from_numpy(spark, mask[None].astype(float))


def _voxels(a: ArrayFrame, dim: int) -> DataFrame:
    """A row for each index of the other dimensions, with its samples along dim in order."""
    rest = a.complement(1 << dim)
    lists = F.sort_array(F.collect_list(F.struct(F.col(f"d{dim}").alias("i"), "re", "im")))
    return a.df.groupBy(*rest).agg(lists.alias("v"))


def mobafit(a: ArrayFrame, times, model: str = "mgre", dim: int = 5, out_dim: int = 6, iterations: int = 25) -> ArrayFrame:
    """Parameters of a signal model at every voxel, along out_dim; voxels of an Arrow batch are fitted together.

    mgre: r * exp(-R2 t) -> (r, R2). ir: |M| without sign: Mss - (Mss + M0) * exp(-R1 t) -> (Mss, M0, R1)."""
    t, n_par = np.asarray(times, float), {"mgre": 2, "ir": 3}[model]
    rest, size = a.complement(1 << dim), a.dims[dim]

    def values(p):
        if model == "mgre":
            e = np.exp(-p[:, 1:2] * t)
            return p[:, :1] * e, np.stack([e, -p[:, :1] * t * e], -1)
        e = np.exp(-p[:, 2:3] * t)
        return p[:, :1] - (p[:, :1] + p[:, 1:2]) * e, np.stack([1 - e, -e, (p[:, :1] + p[:, 1:2]) * t * e], -1)

    def fit(y):
        start = {"mgre": [np.abs(y).max(1), np.full(len(y), 1 / t.mean())], "ir": [y[:, -1], np.abs(y[:, 0]), np.full(len(y), 1 / t.mean())]}[model]
        p, damp = np.stack(start, 1), np.full(len(y), 1e-2)
        cost = ((y - values(p)[0]) ** 2).sum(1)
        for _ in range(iterations):
            f, j = values(p)
            jtj = np.einsum("vti,vtj->vij", j, j)
            scale = np.einsum("vii->vi", jtj) + 1e-12
            step = np.linalg.solve(jtj + damp[:, None, None] * scale[:, :, None] * np.eye(n_par), np.einsum("vti,vt->vi", j, y - f)[..., None])[..., 0]
            new = p + step
            c = ((y - values(new)[0]) ** 2).sum(1)
            better = c <= cost
            p, cost = np.where(better[:, None], new, p), np.where(better, c, cost)
            damp = np.where(better, damp / 5, damp * 5).clip(1e-12, 1e12)
        return p

    def run(batches):
        for b in batches:
            y = np.zeros((len(b), size))
            for r, v in enumerate(b["v"]):
                for s in v:
                    y[r, s["i"]] = s["re"]
            p = fit(y) if len(b) else np.zeros((0, n_par))
            yield pd.DataFrame({c: np.repeat(b[c].to_numpy(), n_par) for c in rest} | {f"d{out_dim}": np.tile(np.arange(n_par, dtype=np.int32), len(b)), "re": p.ravel(), "im": np.zeros(p.size)})

    schema = ", ".join([*(f"{c} int" for c in rest), f"d{out_dim} int", "re double", "im double"])
    return ArrayFrame.of(_voxels(a, dim).mapInPandas(run, schema), a.replace_dims(**{f"d{dim}": 1, f"d{out_dim}": n_par}))


def epg(parameters: DataFrame, echoes: int, spacing: float, flip_deg: float = 180.0) -> DataFrame:
    """Echo train of a spin-echo sequence by extended phase graphs: (id, echo, signal) from rows (id, t1, t2); rows of a batch together."""
    a = np.deg2rad(flip_deg)
    turn = np.array([[np.cos(a / 2) ** 2, np.sin(a / 2) ** 2, np.sin(a)], [np.sin(a / 2) ** 2, np.cos(a / 2) ** 2, -np.sin(a)], [-np.sin(a) / 2, np.sin(a) / 2, np.cos(a)]])

    def run(batches):
        for b in batches:
            n = len(b)
            e1, e2 = np.exp(-spacing / 2 / b["t1"].to_numpy())[:, None], np.exp(-spacing / 2 / b["t2"].to_numpy())[:, None]
            s = np.zeros((n, 3, 2 * echoes + 2))  # F+, F-, Z of every order; refocusing about the axis of the signal
            s[:, 0, 0] = s[:, 1, 0] = 1

            def wait(s):
                s = s.copy()
                s[:, :2] *= e2[:, None]
                s[:, 2] *= e1
                s[:, 2, 0] += 1 - e1[:, 0]
                plus = np.roll(s[:, 0], 1, 1)
                minus = np.roll(s[:, 1], -1, 1)
                minus[:, -1] = 0
                plus[:, 0] = minus[:, 0]
                s[:, 0], s[:, 1] = plus, minus
                return s

            out = []
            for _ in range(echoes):
                s = wait(np.einsum("ij,vjk->vik", turn, wait(s)))
                out.append(s[:, 0, 0])
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), echoes), "echo": np.tile(np.arange(echoes), n), "signal": np.stack(out, 1).ravel() if n else np.zeros(0)})

    return parameters.select("id", "t1", "t2").mapInPandas(run, "id long, echo int, signal double")
