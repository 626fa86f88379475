"""Complex arithmetic on (re, im) pairs of columns. Division by zero is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = tuple[Column, Column]


def cx(v) -> Z:
    v = complex(v)
    return F.lit(v.real), F.lit(v.imag)


def mul(a: Z, b: Z) -> Z:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Z) -> Z:
    return a[0], -a[1]


def absq(a: Z) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def mag(a: Z) -> Column:
    return F.hypot(a[0], a[1])


def arg(a: Z) -> Column:
    return F.atan2(a[1], a[0])


def safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def div(a: Z, b: Z) -> Z:
    n, q = mul(a, conj(b)), absq(b)
    return safe(n[0], q), safe(n[1], q)


def polar(r: Column, angle: Column) -> Z:
    return r * F.cos(angle), r * F.sin(angle)


def exp(a: Z) -> Z:
    return polar(F.exp(a[0]), a[1])


def log(a: Z) -> Z:
    m = mag(a)
    return F.when(m == 0, float("-inf")).otherwise(F.log(F.when(m == 0, 1.0).otherwise(m))), arg(a)


def power(a: Z, p: complex) -> Z:
    """a ** p; zero stays zero unless p is zero."""
    p = complex(p)
    if p == 0:
        return cx(1)
    m, t = mag(a), arg(a)
    lm = F.log(F.when(m == 0, 1.0).otherwise(m))
    re, im = polar(F.exp(p.real * lm - p.imag * t), p.imag * lm + p.real * t)
    return F.when(m == 0, 0.0).otherwise(re), F.when(m == 0, 0.0).otherwise(im)


def phase(a: Z) -> Z:
    m = mag(a)
    return F.when(m == 0, 1.0).otherwise(safe(a[0], m)), safe(a[1], m)


def round_away(x: Column) -> Column:
    """Rounding to whole numbers, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


#: Comparisons of real parts, as 1 or 0, and element-wise extremes.
COMPARISONS = {
    "zless": lambda a, b: (F.when(a[0] < b[0], 1.0).otherwise(0.0), F.lit(0.0)),
    "zlessequal": lambda a, b: (F.when(a[0] <= b[0], 1.0).otherwise(0.0), F.lit(0.0)),
    "zgreat": lambda a, b: (F.when(a[0] > b[0], 1.0).otherwise(0.0), F.lit(0.0)),
    "zgreatequal": lambda a, b: (F.when(a[0] >= b[0], 1.0).otherwise(0.0), F.lit(0.0)),
    "zequal": lambda a, b: (F.when((a[0] == b[0]) & (a[1] == b[1]), 1.0).otherwise(0.0), F.lit(0.0)),
    "zmax": lambda a, b: (F.greatest(a[0], b[0]), F.lit(0.0)),
    "zmin": lambda a, b: (F.least(a[0], b[0]), F.lit(0.0)),
}

FUNCTIONS = {
    "zabs": lambda a: (mag(a), F.lit(0.0)),
    "zacosr": lambda a: (F.acos(a[0]), F.lit(0.0)),
    "zarg": lambda a: (arg(a), F.lit(0.0)),
    "zatanr": lambda a: (F.atan(a[0]), F.lit(0.0)),
    "zconj": conj,
    "zcos": lambda a: (F.cos(a[0]) * F.cosh(a[1]), -F.sin(a[0]) * F.sinh(a[1])),
    "zcosh": lambda a: (F.cosh(a[0]) * F.cos(a[1]), F.sinh(a[0]) * F.sin(a[1])),
    "zexp": exp,
    "zimag": lambda a: (a[1], F.lit(0.0)),
    "zlog": log,
    "zphsr": phase,
    "zreal": lambda a: (a[0], F.lit(0.0)),
    "zround": lambda a: (round_away(a[0]), round_away(a[1])),
    "zsin": lambda a: (F.sin(a[0]) * F.cosh(a[1]), F.cos(a[0]) * F.sinh(a[1])),
    "zsinh": lambda a: (F.sinh(a[0]) * F.cos(a[1]), F.cosh(a[0]) * F.sin(a[1])),
    "zsqrt": lambda a: power(a, 0.5),
    "zsetnanzero": lambda a: (F.when(F.isnan(a[0]) | F.isnan(a[1]), 0.0).otherwise(a[0]), F.when(F.isnan(a[0]) | F.isnan(a[1]), 0.0).otherwise(a[1])),
}
#: Those that map zero to something else, and so need every cell.
NEEDS_ALL = {"zacosr", "zcos", "zcosh", "zexp", "zlog", "zphsr"}
