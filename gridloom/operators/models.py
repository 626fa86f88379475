"""Models and masks as column expressions: mixtures, iterated maps, cellular automata, rasters, pulses, trajectories."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions import complex as C
from .generate import from_index

D = F.col


def gmm(points: ArrayFrame, weights, means, variances, score: bool = False) -> ArrayFrame:
    """Density of a complex Gaussian mixture at every cell, or its score (gradient of the log density, by log-sum-exp weights)."""
    logs = []
    for w, m, v in zip(weights, means, variances, strict=True):
        m = complex(m)
        re, im = D("re") - m.real, D("im") - m.imag
        logs.append((F.lit(math.log(w / (math.pi * v))) - (re * re + im * im) / v, re * (-2 / v), im * (-2 / v)))
    top = F.greatest(*(x[0] for x in logs)) if len(logs) > 1 else logs[0][0]
    parts = [F.exp(x[0] - top) for x in logs]
    total = sum(parts[1:], parts[0])
    if not score:
        return points.with_values(F.exp(top) * total, F.lit(0.0))
    re, im = (sum((p * x[i] for p, x in zip(parts[1:], logs[1:], strict=True)), parts[0] * logs[0][i]) / total for i in (1, 2))
    return points.with_values(re, im)


def gmm_sample(spark: SparkSession, n: int, weights, means, variances, seed: int = 0) -> ArrayFrame:
    """n draws along dimension 0, each from its index and the seed alone, so that a rerun gives the same."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), D("d0")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    edges, at, pick = [], 0.0, uniform(0)
    for w in weights:
        at += w / sum(weights)
        edges.append(at)
    choose = lambda values: F.coalesce(*(F.when(pick < e, F.lit(float(v))) for e, v in zip(edges[:-1], values, strict=False)), F.lit(float(values[-1])))
    r = F.sqrt(-F.log(uniform(1)) * choose(variances))
    angle = uniform(2) * (2 * math.pi)
    return from_index(spark, [n], choose([complex(m).real for m in means]) + r * F.cos(angle), choose([complex(m).imag for m in means]) + r * F.sin(angle))


def mandelbrot(spark: SparkSession, size: int = 512, iterations: int = 20, limit: float = 16.0, zoom: float = 0.2, centre: complex = -0.4) -> ArrayFrame:
    """Iterations until |z|^2 exceeds the limit, on a grid around centre."""
    step = 1.0 / (zoom * size)
    x, y = centre.real + (D("d0") - size // 2) * step, centre.imag + (D("d1") - size // 2) * step
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))

    def move(s, _):
        a, b = s["a"] * s["a"] - s["b"] * s["b"] + x, 2 * s["a"] * s["b"] + y
        out = (s["a"] * s["a"] + s["b"] * s["b"]) > limit
        return F.struct(F.when(out, s["a"]).otherwise(a).alias("a"), F.when(out, s["b"]).otherwise(b).alias("b"), (s["n"] + F.when(out, 0).otherwise(1)).alias("n"))

    return from_index(spark, [size, size], F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, move, lambda s: s["n"].cast("double")))


def conway(a: ArrayFrame, generations: int = 1, periodic: bool = False) -> ArrayFrame:
    """Game of life on dims 0 and 1: live cells send a count to their neighbours, so empty space costs nothing."""
    nx, ny = a.dims[:2]
    cells = a.df.where("re <> 0").select("d0", "d1")
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for _ in range(generations):
        sent = cells.select("d0", "d1", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around))).alias("n"))
        x, y = D("d0") + D("n.i"), D("d1") + D("n.j")
        if periodic:
            x, y = F.pmod(x, F.lit(nx)), F.pmod(y, F.lit(ny))
        sent = sent.select(x.alias("d0"), y.alias("d1"), ((D("n.i") == 0) & (D("n.j") == 0)).cast("int").alias("own"))
        if not periodic:
            sent = sent.where((D("d0") >= 0) & (D("d0") < nx) & (D("d1") >= 0) & (D("d1") < ny))
        counts = sent.groupBy("d0", "d1").agg(F.sum("own").alias("own"), F.sum(1 - D("own")).alias("n"))
        cells = counts.where("n = 3 or (own = 1 and n = 2)").select("d0", "d1")
    return ArrayFrame.of(cells.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}), a.dims)


def pol2mask(spark: SparkSession, polygon, x: int, y: int) -> ArrayFrame:
    """Winding number of a polygon (list of (x, y)) around every cell; edges are few and become one expression."""
    total = F.lit(0.0)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        ux, uy, vx, vy = ax - D("d0"), ay - D("d1"), bx - D("d0"), by - D("d1")
        total = total + F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    return from_index(spark, [x, y], F.round(total / (2 * math.pi)))


def estdims(traj: ArrayFrame) -> list[int]:
    """Image sizes from the largest extent of a trajectory on each axis (dimension 0)."""
    found = {r[0]: r[1] for r in traj.df.groupBy("d0").agg(F.max(F.abs("re"))).collect()}
    return [max(1, 2 * math.ceil(found.get(k) or 0.0)) for k in range(3)]


def trajcor(traj: ArrayFrame, sx: float = 0.0, sy: float = 0.0, sxy: float = 0.0, read: int = 1) -> ArrayFrame:
    """Shifts every spoke along its direction by gradient delays (in samples) on both axes and their cross term."""
    rest = [k for k in traj.keys if k not in ("d0", f"d{read}")]
    last = F.struct(D(f"d{read}"), D("re"))
    ends = traj.df.groupBy(*rest, "d0").agg((F.max(last)["re"] - F.min(last)["re"]).alias("way"), (F.max(f"d{read}") - F.min(f"d{read}")).alias("n"))
    axis = lambda k: F.max(F.when(D("d0") == k, D("way") / D("n")))
    ways = ends.groupBy(*rest).agg(axis(0).alias("ux"), axis(1).alias("uy"))
    shift = F.when(D("d0") == 0, sx * D("ux") + sxy * D("uy")).when(D("d0") == 1, sy * D("uy") + sxy * D("ux")).otherwise(0.0)
    df = traj.df.join(ways, rest) if rest else traj.df.crossJoin(F.broadcast(ways))
    return ArrayFrame.of(df.select(*traj.keys, (D("re") + shift).alias("re"), "im"), traj.dims)


def pulse(spark: SparkSession, shape: str = "sinc", samples: int = 1000, duration: float = 0.001, flip: float = 1.0, bwtp: float = 4.0, alpha: float = 0.5) -> ArrayFrame:
    """An RF pulse along dimension 0, scaled so that its integral is the flip angle (radian)."""
    t = (D("d0") + 0.5) / samples - 0.5
    x = t * (bwtp * math.pi)
    taper = (1 - alpha) + alpha * F.cos(2 * math.pi * t)
    value = {"rect": F.lit(1.0), "sinc": F.when(F.abs(x) < 1e-12, 1.0).otherwise(F.sin(x) / x) * taper, "gauss": F.exp(-0.5 * (t * bwtp) * (t * bwtp) * (math.pi / 2)), "hypsec": 1 / F.cosh(t * 2 * math.pi)}[shape]
    a = from_index(spark, [samples], value)
    total = a.df.agg(F.sum("re")).first()[0] * duration / samples
    return a.with_values(D("re") * (flip / total), F.lit(0.0))


def bloch(spark: SparkSession, samples: int, step: float, t1: float, t2: float, offset: float = 0.0, inverted: bool = False) -> ArrayFrame:
    """Free relaxation after an excitation by 90 degrees (or an inversion): transverse value along dim 0, longitudinal in dim 1 = 1."""
    t = D("d0") * step
    along = 1 - (2.0 if inverted else 1.0) * F.exp(-t / t1)
    size = F.lit(0.0) if inverted else F.exp(-t / t2)
    return from_index(spark, [samples, 2], F.when(D("d1") == 0, size * F.cos(offset * t)).otherwise(along), F.when(D("d1") == 0, size * F.sin(offset * t)).otherwise(0.0))


def toraw(a: ArrayFrame, bits: int = 8):
    """Values clamped to [-1, 1] as unsigned integers of so many bits, in index order (column lin)."""
    from ..frame import ravel

    top = (1 << bits) - 1
    v = F.least(F.greatest(D("re"), F.lit(-1.0)), F.lit(1.0))
    return a.densify().df.select(ravel(a.dims).alias("lin"), F.floor((v + 1) / 2 * top + 0.5).cast("long").alias("sample"))


def _cubic(t):
    """Weights of the four cells around a place t beyond the second, of the Catmull-Rom cubic."""
    return [((2 - t) * t - 1) * t / 2, (t * t * (3 * t - 5) + 2) / 2, ((4 - 3 * t) * t + 1) * t / 2, (t - 1) * t * t / 2]


def corners(points, keys: list[str], order: int):
    """(id, index columns, w): the cells that points (id, x0, x1, ..) read and their weights: nearest (0), linear (1) or cubic (3)."""
    df = points.withColumn("w", F.lit(1.0))
    for i, k in enumerate(keys):
        x = D(f"x{i}")
        t = x - F.floor(x)
        if order == 0:
            df = df.withColumn(k, F.floor(x + 0.5).cast("int"))
            continue
        weights = {1: [1 - t, t], 3: _cubic(t)}[order]
        cells = F.array(*(F.struct((F.floor(x) + j - order // 2).cast("int").alias("at"), w.alias("by")) for j, w in enumerate(weights)))
        df = df.withColumn("c", F.explode(cells)).withColumns({k: D("c.at"), "w": D("w") * D("c.by")}).drop("c")
    return df.select("id", *keys, "w")


def interpolate(a: ArrayFrame, points, order: int = 1):
    """Values at points (columns id, x0, x1, ..; as many as a has dims) by the nearest cell, linearly or cubically; cells outside are zero."""
    hit = corners(points, a.keys, order).join(a.df, a.keys)
    sums = hit.groupBy("id").agg(F.sum(D("w") * D("re")).alias("re"), F.sum(D("w") * D("im")).alias("im"))
    return points.select("id").join(sums, "id", "left").select("id", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))


def fakeksp(image: ArrayFrame, sens: ArrayFrame, measured: ArrayFrame | None = None, flags: int = 7) -> ArrayFrame:
    """k-space of an image seen by every coil; measured samples replace what was computed."""
    from .contract import fmac
    from .kernels import fft

    k = fft(fmac(image, sens), flags, unitary=True)
    if measured is None:
        return k
    own = measured.sparsify().df.withColumnsRenamed({"re": "re2", "im": "im2"})
    return ArrayFrame.of(k.df.join(own, k.keys, "left").select(*k.keys, F.coalesce("re2", "re").alias("re"), F.coalesce("im2", "im").alias("im")), k.dims)


def psf(traj: ArrayFrame, x: int, y: int) -> ArrayFrame:
    """Response of a trajectory to one point: the adjoint transform of ones, at every cell of an x by y image."""
    from .generate import ones
    from .noncartesian import nufft_adjoint

    return nufft_adjoint(traj, ones(traj.spark, [1, *traj.dims[1:]]), [x, y])


def wavepsf(spark: SparkSession, samples: int, size: int, amplitude: float, cycles: int) -> ArrayFrame:
    """Phase that a sinusoidal gradient gives each position (dim 1) along the readout (dim 0)."""
    wave = amplitude * F.cos(2 * math.pi * cycles * D("d0") / samples)
    phase = wave * (D("d1") - size // 2)
    return from_index(spark, [samples, size], F.cos(phase), -F.sin(phase))


def rmfreq(series: ArrayFrame, angles: ArrayFrame, harmonics: int = 5, dim: int = 10) -> ArrayFrame:
    """A series along dim without what cos and sin of multiples of its angles explain (least squares; sums on the cluster, a small solve on the driver)."""
    import numpy as np

    k = f"d{dim}"
    df = series.df.join(angles.df.select(k, D("re").alias("angle")), k)
    basis = [f(n * D("angle")) for n in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    df = df.select(*series.keys, "re", "im", F.array(*basis).alias("b"))
    m = len(basis)
    cell = [(i, j) for i in range(m) for j in range(i, m)]
    sums = df.agg(*(F.sum(D("b")[i] * D("b")[j]) for i, j in cell), *(F.sum(D("b")[i] * D(c)) for c in ("re", "im") for i in range(m))).first()
    gram = np.zeros((m, m))
    for (i, j), v in zip(cell, sums[: len(cell)], strict=True):
        gram[i, j] = gram[j, i] = v
    x = np.linalg.lstsq(gram, np.array(sums[len(cell) :], float).reshape(2, m).T, rcond=None)[0]
    out = [D(c) - sum((D("b")[i] * float(x[i, n]) for i in range(1, m)), D("b")[0] * float(x[0, n])) for n, c in enumerate(("re", "im"))]
    return ArrayFrame.of(df.select(*series.keys, out[0].alias("re"), out[1].alias("im")), series.dims)


def estscaling(kspace: ArrayFrame, centre: int = 24, coil: int = 3, percentile: float = 0.9) -> float:
    """Scale from a low-resolution image: an order statistic of its root of squares, without interpolation."""
    from .index import resize
    from .kernels import fft
    from .reduce import rss

    low = resize(kspace, "centre", **{f"d{k}": min(centre, kspace.dims[k]) for k in (0, 1, 2)})
    r = rss(fft(low, 7, inverse=True), 1 << coil)
    n = r.size
    return float(r.densify().df.select("re").orderBy("re").offset(min(n - 1, int(percentile * n))).limit(1).first()[0])
