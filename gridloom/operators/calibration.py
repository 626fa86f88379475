"""Calibration and joint estimation: local covariances of coils, their eigenvectors, image and coils together, motion.

What is local or linear are plans over cells; what iterates runs on one problem a task, for each index that loops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions import complex as C
from . import algorithms as A
from . import index, kernels
from .recon import COIL, IMAGE, PROX, _axes, _f, together

D = F.col


def coils(spark, sizes, n: int = 8, radius: float = 1.3, spread: float = 0.9) -> ArrayFrame:
    """Smooth maps (dim 3) of n loops around an object: size falls with the distance from the loop, phase turns with its angle."""
    from .generate import from_index

    sizes = (list(sizes) + [1, 1, 1])[:3]
    at = [(2 * D(f"d{k}") - s) / s if s > 1 else F.lit(0.0) for k, s in enumerate(sizes)]
    turn = D("d3") * (2 * math.pi / n) if n > 1 else F.lit(0.0)
    x, y = at[0] - radius * F.cos(turn), at[1] - radius * F.sin(turn)
    size = 1 / (1 + (x * x + y * y + at[2] * at[2]) / spread**2) ** 1.5
    angle = F.atan2(y, x)
    return from_index(spark, [*sizes, n], size * F.cos(angle), size * F.sin(angle))


def walsh(kspace: ArrayFrame, calibration: int = 24, block: int = 7, coil: int = 3) -> ArrayFrame:
    """Covariance of the coils around every pixel, from the calibration region: the upper triangle, packed by rows, along the coil dimension. Blocks are cyclic."""
    m = kspace.dims[coil]
    low = kspace
    for k in (0, 1, 2):
        low = index.resize(low, "centre", **{f"d{k}": min(calibration, kspace.dims[k])})
    for k in (0, 1, 2):
        low = index.resize(low, "centre", **{f"d{k}": kspace.dims[k]})
    image = kernels.fft(low, 7, inverse=True, unitary=True)
    rest = [c for c in image.keys if c != f"d{coil}"]
    a = image.df.withColumnRenamed(f"d{coil}", "i")
    b = image.df.withColumnsRenamed({f"d{coil}": "j", "re": "re2", "im": "im2"})
    both = a.join(b, rest).where("i <= j")
    re, im = C.mul((D("re"), D("im")), C.conj((D("re2"), D("im2"))))
    place = (D("i") * m - F.call_function("div", D("i") * (D("i") - 1), F.lit(2)) + D("j") - D("i")).cast("int").alias(f"d{coil}")
    out = ArrayFrame.of(both.select(*rest, place, re.alias("re"), im.alias("im")), image.replace_dims(**{f"d{coil}": m * (m + 1) // 2}))
    for k in (0, 1, 2):
        size = min(block, image.dims[k])
        if image.dims[k] > 1:  # cyclic sums over the block, one dimension at a time
            grown = out.df.withColumn("s", F.explode(F.sequence(F.lit(-(size // 2)), F.lit(size - 1 - size // 2))))
            grown = grown.withColumn(f"d{k}", F.pmod(D(f"d{k}") + D("s"), F.lit(image.dims[k])).cast("int"))
            out = ArrayFrame(grown.groupBy(*out.keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im")).select(*out.keys, "re", "im"), out.dims)
    return out


def ecaltwo(covariance: ArrayFrame, channels: int, maps: int = 1, coil: int = 3) -> tuple[ArrayFrame, ArrayFrame]:
    """(maps along dims coil and 4, eigenvalues along dim 4): the largest eigenvectors of every pixel's covariance (packed as walsh does), the first channel real."""
    rest = [c for c in covariance.keys if c != f"d{coil}"]
    df = covariance.df.groupBy(*rest).agg(F.collect_list(F.struct(D(f"d{coil}").alias("k"), "re", "im")).alias("v"))
    upper = np.array([(i, j) for i in range(channels) for j in range(i, channels)])

    def run(batches):
        import pandas as pd

        for p in batches:
            c = np.zeros((len(p), channels, channels), complex)
            for r, v in enumerate(p["v"]):
                for e in v:
                    i, j = upper[e["k"]]
                    c[r, i, j] = e["re"] + 1j * e["im"]
                    c[r, j, i] = c[r, i, j].conjugate()
            w, q = np.linalg.eigh(c)
            w, q = w[:, ::-1][:, :maps], q[:, :, ::-1][:, :, :maps]
            first = q[:, :1]
            q = q * np.where(np.abs(first) > 0, first.conj() / np.maximum(np.abs(first), 1e-300), 1)
            full = np.concatenate([q, w[:, None].astype(complex)], 1)  # the last "channel" holds eigenvalues
            at = np.indices(full.shape).reshape(3, -1)
            cols = {k: p[k].to_numpy()[at[0]] for k in rest}
            yield pd.DataFrame(cols | {"ch": at[1].astype(np.int32), "map": at[2].astype(np.int32), "re": full.real.ravel(), "im": full.imag.ravel()})

    out = df.mapInPandas(run, ", ".join([*(f"{c} int" for c in rest), "ch int", "map int", "re double", "im double"]))
    dims = covariance.replace_dims(**{f"d{coil}": channels, "d4": maps})
    vectors = ArrayFrame.of(out.where(f"ch < {channels}").withColumnsRenamed({"ch": f"d{coil}", "map": "d4"}), dims)
    values = ArrayFrame.of(out.where(f"ch = {channels}").drop("ch").withColumnRenamed("map", "d4"), covariance.replace_dims(**{f"d{coil}": 1, "d4": maps}))
    return vectors, values


def phasepole(maps: ArrayFrame, coil: int = 3, level: float = 0.5) -> ArrayFrame:
    """One at cells (dims 0 and 1) around which the phase turns in more than `level` of the coils: sums of wrapped differences around every square of four."""
    from .elementwise import carg

    phase = carg(maps).densify()
    keys = [c for c in phase.keys if c not in ("d0", "d1")]
    corner = lambda i, j, name: phase.df.select(*keys, (D("d0") - i).alias("d0"), (D("d1") - j).alias("d1"), D("re").alias(name))
    df = corner(0, 0, "a").join(corner(1, 0, "b"), [*keys, "d0", "d1"]).join(corner(1, 1, "c"), [*keys, "d0", "d1"]).join(corner(0, 1, "e"), [*keys, "d0", "d1"])
    wrap = lambda x: x - 2 * math.pi * F.floor(x / (2 * math.pi) + 0.5)
    turn = wrap(D("b") - D("a")) + wrap(D("c") - D("b")) + wrap(D("e") - D("c")) + wrap(D("a") - D("e"))
    rest = [c for c in keys if c != f"d{coil}"]
    found = df.groupBy(*rest, "d0", "d1").agg(F.sum((F.abs(turn) > math.pi).cast("double")).alias("n")).where(D("n") > level * maps.dims[coil])
    return ArrayFrame.of(found.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}), maps.replace_dims(**{f"d{coil}": 1}))


def _weights(shape, axes, a: float, b: float):
    k2 = sum((np.arange(shape[ax]).reshape([-1 if i == ax else 1 for i in range(len(shape))]) / shape[ax] - 0.5) ** 2 for ax in axes)
    return (1 + a * k2) ** (-b / 2)


def _joint(y, mask, axes, coil, rounds, start, a, b, reduction, cg, reference=None):
    """Image and coil spectra of one problem by regularised Gauss-Newton steps: (image, spectra)."""
    w = _weights(y.shape, axes, a, b)
    n = 1
    to_coils = lambda c: _f(w * c, axes, inverse=True)
    to_spectra = lambda s: w * _f(s, axes)
    split = lambda v: (v.take([0], coil), v.take(range(n, v.shape[coil]), coil))
    join = lambda i, c: np.concatenate([i, c], coil)

    def forward(v):
        i, c = split(v)
        return mask * _f(i * to_coils(c), axes)

    def derivative(v):
        i, c = split(v)
        s = to_coils(c)

        def d(u):
            di, dc = split(u)
            return mask * _f(di * s + i * to_coils(dc), axes)

        def dt(r):
            z = _f(mask * r, axes, inverse=True)
            return join((s.conj() * z).sum(coil, keepdims=True), to_spectra(i.conj() * z))

        return d, dt

    return split(A.irgnm(forward, derivative, y, start, rounds, 1.0, reduction, cg, reference))


def _first(y, coil):
    shape = list(y.shape)
    shape[coil] = 1
    return np.concatenate([np.ones(shape, complex), np.zeros(y.shape, complex)], coil)


def nlinv(kspace: ArrayFrame, rounds: int = 8, cg: int = 30, a: float = 220.0, b: float = 16.0, reduction: float = 0.5) -> ArrayFrame:
    """Image estimated together with smooth coils; it is scaled by the root of squares of the coils."""
    axes, coil = _axes(kspace)

    def kernel(y):
        scale = np.linalg.norm(y) / 100 or 1.0
        mask = (np.abs(y).max(coil, keepdims=True) > 0).astype(float)
        image, c = _joint(y / scale, mask, axes, coil, rounds, _first(y, coil), a, b, reduction, cg)
        s = _f(_weights(y.shape, axes, a, b) * c, axes, inverse=True)
        return scale * image * np.sqrt((np.abs(s) ** 2).sum(coil, keepdims=True))

    return together([kspace], IMAGE | COIL, kernel, kspace.replace_dims(d3=1))


def ncalib(kspace: ArrayFrame, rounds: int = 8, cg: int = 30, a: float = 220.0, b: float = 16.0, reduction: float = 0.5) -> ArrayFrame:
    """Coil maps of the joint estimate, of root of squares one."""
    axes, coil = _axes(kspace)

    def kernel(y):
        scale = np.linalg.norm(y) / 100 or 1.0
        mask = (np.abs(y).max(coil, keepdims=True) > 0).astype(float)
        _, c = _joint(y / scale, mask, axes, coil, rounds, _first(y, coil), a, b, reduction, cg)
        s = _f(_weights(y.shape, axes, a, b) * c, axes, inverse=True)
        return s / np.maximum(np.sqrt((np.abs(s) ** 2).sum(coil, keepdims=True)), 1e-300)

    return together([kspace], IMAGE | COIL, kernel, kspace.dims)


def rtnlinv(kspace: ArrayFrame, rounds: int = 6, cg: int = 20, time: int = 10, damping: float = 0.9, a: float = 220.0, b: float = 16.0) -> ArrayFrame:
    """A series (along time) of joint estimates, each of which starts near the one before. One series is one task."""
    axes, coil = _axes(kspace)
    n = kspace.dims[time]

    def kernel(y):
        frames = [y[..., t] for t in range(n)] if n > 1 else [y]
        scale, out, x = np.linalg.norm(frames[0]) / 100 or 1.0, [], None
        for f in frames:
            mask = (np.abs(f).max(coil, keepdims=True) > 0).astype(float)
            start = _first(f, coil) if x is None else x
            ref = 0 * start if x is None else damping * x
            i, c = _joint(f / scale, mask, axes, coil, rounds, start, a, b, 0.5, cg, ref)
            x = np.concatenate([i, c], coil)
            s = _f(_weights(f.shape, axes, a, b) * c, axes, inverse=True)
            out.append(scale * i * np.sqrt((np.abs(s) ** 2).sum(coil, keepdims=True)))
        return np.stack(out, -1) if n > 1 else out[0]

    return together([kspace], IMAGE | COIL | 1 << time, kernel, kspace.replace_dims(d3=1))


def sake(kspace: ArrayFrame, rank_share: float = 0.3, size: int = 5, iterations: int = 50) -> ArrayFrame:
    """Completion of k-space: the matrix of all blocks (all coils of a block side by side) is made low-rank, blocks are averaged, measured samples put back."""
    axes, coil = _axes(kspace)
    own = [ax for ax in axes if kspace.dims[ax] > 1] or list(axes)

    def kernel(y):
        mask, x = np.abs(y) > 0, y.copy()
        sizes = [min(size, y.shape[ax]) for ax in own]
        pos = [y.shape[ax] - s + 1 for ax, s in zip(own, sizes, strict=True)]
        count = np.zeros(y.shape)
        for o in np.ndindex(*sizes):
            at = [slice(None)] * y.ndim
            for ax, k, p in zip(own, o, pos, strict=True):
                at[ax] = slice(k, k + p)
            count[tuple(at)] += 1
        for _ in range(iterations):
            blocks = []
            for o in np.ndindex(*sizes):
                at = [slice(None)] * y.ndim
                for ax, k, p in zip(own, o, pos, strict=True):
                    at[ax] = slice(k, k + p)
                blocks.append(np.moveaxis(x[tuple(at)], coil, -1).reshape(-1, y.shape[coil]))
            m = np.concatenate(blocks, 1)
            w, q = np.linalg.eigh(m.conj().T @ m)
            q = q[:, -max(1, int(rank_share * len(w))) :]
            m = (m @ q) @ q.conj().T
            total = np.zeros_like(x)
            for i, o in enumerate(np.ndindex(*sizes)):
                at = [slice(None)] * y.ndim
                for ax, k, p in zip(own, o, pos, strict=True):
                    at[ax] = slice(k, k + p)
                part = m[:, i * y.shape[coil] : (i + 1) * y.shape[coil]]
                shape = [s for ax, s in enumerate(x[tuple(at)].shape) if ax != coil]
                total[tuple(at)] += np.moveaxis(part.reshape([*shape, y.shape[coil]]), -1, coil)
            x = np.where(mask, y, total / count)
        return x

    return together([kspace], IMAGE | COIL, kernel, kspace.dims)


def wave(kspace: ArrayFrame, sens: ArrayFrame, psf: ArrayFrame, level: float = 0.0, regularisation: str = "l2", iterations: int = 30) -> ArrayFrame:
    """Wave-encoded reconstruction: the read dimension (0) is longer in k-space, and the point-spread function acts in hybrid space."""
    axes, coil = _axes(kspace)
    read = kspace.dims[0]

    def kernel(y, s, p):
        mask = np.abs(y).max(coil, keepdims=True) > 0
        n = s.shape[0]
        lo = (read - n + 1) // 2 if (read - n) % 2 else (read - n) // 2
        others = tuple(ax for ax in axes if ax != 0)

        def forward(x):
            z = np.zeros((read, *(s * x).shape[1:]), complex)
            z[lo : lo + n] = s * x
            return mask * _f(p * _f(z, (0,)), others)

        def adjoint(r):
            z = _f(p.conj() * _f(mask * r, others, inverse=True), (0,), inverse=True)[lo : lo + n]
            return (s.conj() * z).sum(coil, keepdims=True)

        b = adjoint(y)
        if regularisation == "l2":
            return A.conjugate_gradients(lambda x: adjoint(forward(x)) + level * x, b, iterations)
        bound = max((np.abs(s) ** 2).sum(coil).max() * max(1e-300, np.abs(p).max() ** 2), 1e-300)
        return A.fista(lambda x: adjoint(forward(x)) - b, lambda x, t: PROX[regularisation](x, level * t), 0 * b, 1 / bound, iterations)

    dims = list(kspace.dims)
    dims[0], dims[3] = sens.dims[0], 1
    return together([kspace, sens, psf], IMAGE | COIL, kernel, dims)


def _look_locker(times):
    """Forward and derivative of Mss - (Mss + M0) exp(-t R1*), parameters along the last axis; rates are real, 0 to 50 / s."""

    def parts(v):
        return v[..., 0:1], v[..., 1:2], np.clip(v[..., 2:3].real, 0, 50)

    def forward(v):
        mss, m0, r = parts(v)
        return mss - (mss + m0) * np.exp(-times * r)

    def derivative(v):
        mss, m0, r = parts(v)
        e = np.exp(-times * r)
        j = [1 - e, -e, (mss + m0) * times * e]

        def d(u):
            return sum(j[k] * u[..., k : k + 1] for k in range(3))

        def dt(w):
            g = [(np.conj(j[k]) * w).sum(-1) for k in range(3)]
            return np.stack([g[0], g[1], g[2].real + 0j], -1)

        return d, dt

    return forward, derivative


def moba(kspace: ArrayFrame, sens: ArrayFrame, times, rounds: int = 10, cg: int = 20, reduction: float = 0.5) -> ArrayFrame:
    """Maps of (Mss, M0, R1*) along dim 6 straight from the k-space of an inversion-recovery series (times along dim 5)."""
    axes, coil = _axes(kspace)
    t = np.asarray(times, float)
    model, slope = _look_locker(t)

    def kernel(y, s):
        scale = np.linalg.norm(y) / 50 or 1.0
        y, s = y[..., 0] / scale, s[..., 0]  # without the axis of the parameters
        mask = np.abs(y).max(coil, keepdims=True) > 0
        to_k = lambda x: mask * _f(s * x, axes)
        back = lambda r: (s.conj() * _f(mask * r, axes, inverse=True)).sum(coil, keepdims=True)
        shape = list(y.shape[:-1])
        shape[coil] = 1
        start = np.zeros((*shape, 3), complex)
        start[..., 0], start[..., 1], start[..., 2] = 0.5, 1.0, 1.0

        def derivative(v):
            d, dt = slope(v)
            return (lambda u: to_k(d(u))), (lambda r: dt(back(r)))

        out = A.irgnm(lambda v: to_k(model(v)), derivative, y, start, rounds, 1.0, reduction, cg, least=1e-4)
        out[..., :2] *= scale
        return out[..., None, :]

    return together([kspace, sens], IMAGE | COIL | 1 << 5 | 1 << 6, kernel, kspace.replace_dims(d3=1, d5=1, d6=3))


def estdelay(traj: ArrayFrame, kspace: ArrayFrame, read: int = 1, spokes: int = 2) -> np.ndarray:
    """Gradient delays (sx, sy, sxy), in samples, of radial data: every spoke is compared with the one most opposed to it, reversed; the shifts are fitted by the directions."""
    keys = [k for k in traj.keys if k not in ("d0", f"d{read}", f"d{spokes}")]
    if keys:
        raise ValueError("one set of spokes is needed")
    n, m = traj.dims[read], traj.dims[spokes]
    if n * m > kernels.BLOCK_CELLS // 16:
        raise ValueError("too many spokes for one fit; take a part of them")
    ends = traj.df.where(D(f"d{read}") == n - 1).groupBy(f"d{spokes}").agg(*(F.max(F.when(D("d0") == c, D("re"))).alias(f"k{c}") for c in (0, 1))).orderBy(f"d{spokes}").collect()
    angle = np.array([math.atan2(r.k1 or 0.0, r.k0 or 0.0) for r in ends])
    low = kspace.densify().df.groupBy(f"d{read}", f"d{spokes}").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).toPandas()
    x = np.zeros((n, m), complex)
    x[low[f"d{read}"], low[f"d{spokes}"]] = low["re"] + 1j * low["im"]
    shifts, k = np.zeros(m), np.fft.fftfreq(n)
    near = np.abs(k) < 0.25
    for i in range(m):
        j = int(np.argmax(np.abs(np.exp(1j * angle) - np.exp(1j * angle[i]))))
        a, b = np.fft.fft(x[:, i]), np.fft.fft(x[::-1, j])
        cross = a * b.conj()
        order = np.argsort(k)
        phase, weight = np.unwrap(np.angle(cross[order])), np.abs(cross[order]) * near[order]
        phase = phase - phase[np.argmin(np.abs(k[order]))]
        denominator = (weight * k[order] ** 2).sum()
        shifts[i] = -(weight * k[order] * phase).sum() / denominator / (2 * np.pi) / 2 if denominator else 0.0
    basis = np.stack([np.cos(angle) ** 2, np.sin(angle) ** 2, 2 * np.sin(angle) * np.cos(angle)], 1)
    return np.linalg.lstsq(basis, shifts, rcond=None)[0]


def _read_at(image, places):
    """Linear interpolation of an image at places (dims, ...), zero outside, and nothing else."""
    low = np.floor(places).astype(int)
    t, out = places - low, 0
    for c in np.ndindex(*(2,) * image.ndim):
        at = [low[i] + c[i] for i in range(image.ndim)]
        ok = np.logical_and.reduce([(p >= 0) & (p < n) for p, n in zip(at, image.shape, strict=True)])
        w = np.prod([t[i] if c[i] else 1 - t[i] for i in range(image.ndim)], 0)
        out = out + np.where(ok, w * image[tuple(np.clip(p, 0, n - 1) for p, n in zip(at, image.shape, strict=True))], 0)
    return out


def affine_registration(fixed: np.ndarray, moving: np.ndarray, rigid: bool = False, iterations: int = 60) -> np.ndarray:
    """The matrix (dims x dims + 1) that takes places of fixed to those of moving, about the centre, by Gauss-Newton steps from coarse to fine."""
    fixed, moving = np.abs(fixed).astype(float), np.abs(moving).astype(float)
    d = fixed.ndim
    centre = (np.array(fixed.shape) - 1) / 2
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in fixed.shape], indexing="ij")) - centre.reshape(-1, *[1] * d)
    m = np.concatenate([np.eye(d), np.zeros((d, 1))], 1)

    def smooth(x, s):
        for ax in range(d):
            k = np.fft.fftfreq(x.shape[ax]).reshape([-1 if i == ax else 1 for i in range(d)])
            x = np.fft.ifft(np.fft.fft(x, axis=ax) * np.exp(-2 * (np.pi * k * s) ** 2), axis=ax).real
        return x

    for s in (4.0, 2.0, 1.0):
        f, g = smooth(fixed, s), smooth(moving, s)
        slopes = np.stack(np.gradient(g)) if d > 1 else np.gradient(g)[None]
        for _ in range(iterations // 3):
            at = np.einsum("ij,j...->i...", m[:, :d], grid) + (m[:, d] + centre).reshape(-1, *[1] * d)
            r = f - _read_at(g, at)
            q = np.stack([_read_at(x, at) for x in slopes])
            j = np.stack([q[i] * (grid[k] if k < d else 1) for i in range(d) for k in range(d + 1)]).reshape(d * (d + 1), -1)
            step = np.linalg.lstsq(j @ j.T + 1e-9 * np.eye(len(j)) * (j @ j.T).trace(), j @ r.ravel(), rcond=None)[0].reshape(d, d + 1)
            m = m + step
            if rigid:
                u, _, vh = np.linalg.svd(m[:, :d])
                m[:, :d] = u @ vh
            if np.abs(step).max() < 1e-6:
                break
    return m


def affinereg(fixed: ArrayFrame, moving: ArrayFrame, rigid: bool = False, flags: int = 7) -> ArrayFrame:
    """The matrix of every slice (dim 0: rows, dim 1: columns, the last one the shift)."""
    d = sum(fixed.dims[k] > 1 for k in range(3) if flags >> k & 1)

    def kernel(f, g):
        return affine_registration(f.squeeze(), g.squeeze(), rigid)

    return together([fixed, moving], flags, kernel, fixed.replace_dims(**{f"d{k}": (d, d + 1, 1)[k] for k in range(3)}))


def estmotion(fixed: ArrayFrame, moving: ArrayFrame, flags: int = 3, iterations: int = 100, smoothing: float = 1.5, out_dim: int = 4) -> ArrayFrame:
    """A displacement for every cell (components along out_dim) that takes moving onto fixed: forces along the slopes, smoothed after every step."""
    own = [k for k in range(16) if flags >> k & 1 and fixed.dims[k] > 1]

    def kernel(f, g):
        f, g = np.abs(f).squeeze(), np.abs(g).squeeze()
        d = f.ndim
        grid = np.stack(np.meshgrid(*[np.arange(n) for n in f.shape], indexing="ij")).astype(float)
        u, slopes = np.zeros_like(grid), np.stack(np.gradient(f)) if d > 1 else np.gradient(f)[None]
        for _ in range(iterations):
            r = f - _read_at(g, grid + u)
            u = u + slopes * r / np.maximum((slopes**2).sum(0) + r**2, 1e-12)
            for ax in range(d):
                k = np.fft.fftfreq(f.shape[ax]).reshape([-1 if i == ax else 1 for i in range(d)])
                u = np.fft.ifft(np.fft.fft(u, axis=ax + 1) * np.exp(-2 * (np.pi * k * smoothing) ** 2), axis=ax + 1).real
        return np.moveaxis(u, 0, -1)

    return together([fixed, moving], flags | 1 << out_dim, kernel, fixed.replace_dims(**{f"d{out_dim}": len(own)}))


def sample_posterior(kspace: ArrayFrame, sens: ArrayFrame, score, precision: float, step: float, iterations: int, seed: int = 0) -> ArrayFrame:
    """Images drawn by Langevin steps from what coil data and a prior (its score, on numpy arrays) say together."""
    axes, coil = _axes(kspace)

    def kernel(y, s):
        mask = np.abs(y).max(coil, keepdims=True) > 0
        adjoint = lambda r: (s.conj() * _f(mask * r, axes, inverse=True)).sum(coil, keepdims=True)
        rng = np.random.default_rng(seed)
        start = adjoint(y)
        total = lambda x: score(x) + precision * adjoint(y - mask * _f(s * x, axes))
        noise = lambda k: (rng.normal(size=start.shape) + 1j * rng.normal(size=start.shape)) / np.sqrt(2)
        return A.euler_maruyama(total, start, step, iterations, noise)

    return together([kspace, sens], IMAGE | COIL, kernel, kspace.replace_dims(d3=1))
