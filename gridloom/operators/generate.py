"""Arrays made from nothing but their indices: a range of linear indices and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame, flag_dims, normalise_dims, unravel

D = F.col


def from_index(spark: SparkSession, dims, re, im=None) -> ArrayFrame:
    """A cell for every index; re and im are columns over d0.. (or numbers)."""
    dims = normalise_dims(dims)
    grid = spark.range(math.prod(dims))
    grid = grid.select(*(c.alias(f"d{k}") for k, c in unravel(F.col("id"), dims).items()))
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return ArrayFrame.of(grid.withColumns({"re": as_col(re), "im": as_col(0.0 if im is None else im)}), dims)


def zeros(spark, dims):
    return from_index(spark, dims, 0.0)


def ones(spark, dims):
    return from_index(spark, dims, 1.0)


def vec(spark, values):
    rows = [(i, float(complex(v).real), float(complex(v).imag)) for i, v in enumerate(values)]
    return ArrayFrame.of(spark.createDataFrame(rows, "d0 int, re double, im double"), [len(rows)])


def delta(spark, rank: int, flags: int, size: int):
    """One where all flagged indices are equal; sparse."""
    own = flag_dims(flags)
    grid = spark.range(size).select(*(F.col("id").alias(f"d{k}") for k in own), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return ArrayFrame.of(grid, [size if k in own else 1 for k in range(max(rank, max(own) + 1))])


def index(spark, dim: int, size: int, end: bool = False, log: bool = False, low: float | None = None, high: float | None = None):
    """A counting vector along a dimension; between low and high (end: high included), or evenly in logarithm."""
    dims = [size if k == dim else 1 for k in range(dim + 1)]
    i = D(f"d{dim}").cast("double") if size > 1 else F.lit(0.0)
    low, high = (0.0 if low is None else low), (float(size) if high is None else high)
    if log:
        if low <= 0:
            raise ValueError("a logarithmic index needs a positive minimum")
        a, b = math.log(low), math.log(high)
        return from_index(spark, dims, F.exp(a + i * ((b - a) / (size - 1 if end else size))))
    return from_index(spark, dims, low + i * ((high - low) / (size - 1 if end else size)))


def poly(spark, length: int, coefficients):
    """Values of a polynomial at 0 .. length-1."""
    if len(coefficients) > length:
        raise ValueError("a polynomial needs at least as many points as coefficients")
    x, v = (D("d0").cast("double") if length > 1 else F.lit(0.0)), F.lit(0.0)
    for a in reversed(coefficients):
        v = v * x + F.lit(float(a))
    return from_index(spark, [length], v)


def upat(spark, y: int, z: int, every_y: int = 1, every_z: int = 1, centre: int = 0):
    """An undersampling pattern over dims 1 and 2 with a fully sampled centre."""
    sampled = (D("d1") % every_y == 0) & (D("d2") % every_z == 0)
    middle = (F.abs(2 * D("d1") - y) < 2 * centre) & (F.abs(2 * D("d2") - z) < 2 * centre)
    return from_index(spark, [1, y, z], F.when(sampled | middle, 1.0).otherwise(0.0))


def grid(spark, sizes, k_space: bool = False):
    """Coordinates of a grid: component c (dim 0, of 3) of each point, in units of samples or of 1/size."""
    sizes = (list(sizes) + [1, 1, 1])[:3]
    c = [(D(f"d{k + 1}") - n // 2).cast("double") / (1 if k_space or n == 1 else n) if n > 1 else F.lit(0.0) for k, n in enumerate(sizes)]
    return from_index(spark, [3, *sizes], F.when(D("d0") == 0, c[0]).when(D("d0") == 1, c[1]).otherwise(c[2]))


GOLDEN = (math.sqrt(5) + 1) / 2


def traj(spark, samples: int, spokes: int, radial: bool = False, golden: bool = False, double: bool = True, tiny: int = 1, delays: tuple[float, float, float] = (0.0, 0.0, 0.0)):
    """Trajectories (3 x samples x spokes): Cartesian lines, or spokes through the centre.

    tiny: number of the (tiny) golden angle; delays: shifts (x, y, xy) of spokes along their direction, in samples."""
    s, p = D("d1").cast("double"), D("d2").cast("double") if spokes > 1 else F.lit(0.0)
    if not radial:
        x, y = s - samples // 2, p - spokes // 2
    else:
        angle = p * (math.pi / (GOLDEN + tiny - 1) if golden else (math.pi if double else 2 * math.pi) / spokes)
        r = s + 0.5 - samples / 2
        c, t = F.cos(angle), F.sin(angle)
        x, y = r * c + delays[0] * c + delays[2] * t, r * t + delays[1] * t + delays[2] * c
    return from_index(spark, [3, samples, spokes], F.when(D("d0") == 0, x).when(D("d0") == 1, y).otherwise(0.0))


def raga(spark, spokes: int, increment: int, total: int | None = None):
    """Indices of a rational approximation of the golden-angle order."""
    return from_index(spark, [1, 1, spokes], F.pmod(D("d2").cast("long") * increment, F.lit(total or spokes)))


#: The ten ellipses of the modified head phantom (level, half axes, centre, turn in degrees).
ELLIPSES = ((1, .69, .92, 0, 0, 0), (-.8, .6624, .874, 0, -.0184, 0), (-.2, .11, .31, .22, 0, -18), (-.2, .16, .41, -.22, 0, 18), (.1, .21, .25, 0, .35, 0), (.1, .046, .046, 0, .1, 0), (.1, .046, .046, 0, -.1, 0), (.1, .046, .023, -.08, -.605, 0), (.1, .023, .023, 0, -.606, 0), (.1, .023, .046, .06, -.605, 0))


def phantom(spark, n: int = 128, coils: int = 1, k_space: bool = False):
    """The modified ten-ellipse head phantom on an n x n grid, seen by coils (dim 3) on request; k_space: its transform, from the ellipses themselves."""
    if coils > 1:
        from . import calibration, contract, kernels

        seen = contract.fmac(phantom(spark, n), calibration.coils(spark, [n, n], coils))
        return kernels.fft(seen, 3, unitary=True) if k_space else seen
    if k_space:
        return _phantom_spectrum(spark, n)
    x, y, v = (2 * D("d0") - n) / n, (n - 2 * D("d1")) / n, F.lit(0.0)
    for level, a, b, cx, cy, turn in ELLIPSES:
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        u, w = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
        v = v + F.when((u / a) ** 2 + (w / b) ** 2 <= 1, float(level)).otherwise(0.0)
    return from_index(spark, [n, n], v)


def _bessel_ratio(x):
    """J1(x) / x for x >= 0, by the usual polynomials below and above 3 (fixed values; error below 1e-7)."""
    low = (0.5, -0.56249985, 0.21093573, -0.03954289, 0.00443319, -0.00031761, 0.00001109)
    size = (0.79788456, 0.00000156, 0.01659667, 0.00017105, -0.00249511, 0.00113653, -0.00020033)
    turn = (-2.35619449, 0.12499612, 0.00005650, -0.00637879, 0.00074348, 0.00079824, -0.00029166)

    def poly(c, z):
        out = F.lit(c[-1])
        for a in reversed(c[:-1]):
            out = out * z + a
        return out

    far = F.greatest(x, F.lit(3.0))
    z = 3 / far
    return F.when(x <= 3, poly(low, (x / 3) ** 2)).otherwise(poly(size, z) * F.cos(far + poly(turn, z)) / F.sqrt(far) / far)


def _phantom_spectrum(spark, n: int):
    """Unitary transform of the ellipses: for each the ratio above at its stretched frequency, and the phase of its centre."""
    kx, ky, re, im = D("d0") - n // 2, -(D("d1") - n // 2), F.lit(0.0), F.lit(0.0)
    for level, a, b, cx, cy, turn in ELLIPSES:
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        u, w = a * (kx * c + ky * s), b * (ky * c - kx * s)
        size = _bessel_ratio(math.pi * F.sqrt(u * u + w * w)) * (2 * math.pi * a * b * level * n / 4)
        angle = (kx * cx + ky * cy) * -math.pi
        re, im = re + size * F.cos(angle), im + size * F.sin(angle)
    return from_index(spark, [n, n], re, im)


def signal_flash(spark, t1s, flip_deg: float, tr: float, repetitions: int):
    """Inversion-recovery spoiled gradient echo: relaxation towards the steady state, for each T1 (dim 6)."""
    t1 = F.element_at(F.array(*(F.lit(float(t)) for t in t1s)), D("d6") + 1) if len(t1s) > 1 else F.lit(float(t1s[0]))
    a = math.radians(flip_deg)
    r1s = 1 / t1 - math.log(math.cos(a)) / tr
    mss = (1 - F.exp(-tr / t1)) / (1 - math.cos(a) * F.exp(-tr / t1))
    t = D("d5") * tr
    return from_index(spark, [1, 1, 1, 1, 1, repetitions, len(t1s)], (mss - (mss + 1) * F.exp(-t * r1s)) * math.sin(a))


def noise(a: ArrayFrame, variance: float = 1.0, seed: int = 0, real: bool = False, uniform: bool = False, spikes: float = 1.0) -> ArrayFrame:
    """Adds Gaussian noise (or uniform, of the same variance) that depends only on seed and index, not on partitions; spikes: the share of cells that get it."""
    from ..frame import ravel

    a = a.densify()
    at = ravel(a.dims)
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), at), 11).cast("double") + 0.5) / float(1 << 53)
    s = math.sqrt(variance if real else variance / 2)
    if uniform:
        x, y = (unit(0) - 0.5) * math.sqrt(12), (unit(1) - 0.5) * math.sqrt(12)
    else:
        r, angle = F.sqrt(-2 * F.log(unit(0))), 2 * math.pi * unit(1)
        x, y = r * F.cos(angle), r * F.sin(angle)
    own = F.when(unit(2) < spikes, 1.0).otherwise(0.0) if spikes < 1 else F.lit(1.0)
    return a.with_values(D("re") + own * s * x, D("im") + (F.lit(0.0) if real else own * s * y))
