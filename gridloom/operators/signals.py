"""Signals of magnetisation as column expressions: one projection for all times and tissues."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from .generate import from_index

D = F.col

# Published fat spectra (chemical shifts in ppm, amplitudes) and the proton's gyromagnetic ratio in Hz/T.
FAT_PPM = (-3.80, -3.40, -2.60, -1.94, -0.39, 0.60)
FAT_AMPLITUDES = ((0.087, 0.693, 0.128, 0.004, 0.039, 0.048), (0.086, 0.537, 0.165, 0.046, 0.052, 0.114))
GYRO = 42.577478518e6

TIMES, TISSUES = 5, 6  # dimensions


def _tissue(values):
    """A column with the value of each tissue (dim 6)."""
    values = [float(v) for v in np.atleast_1d(values)]
    return F.element_at(F.array(*map(F.lit, values)), D("d6") + 1) if len(values) > 1 else F.lit(values[0])


def _array(spark, n: int, tissues: int, re, im=None) -> ArrayFrame:
    return from_index(spark, [1] * TIMES + [n, tissues], re, im)


def _size(*values) -> int:
    return max(np.size(v) for v in values)


def _t(n: int):
    return D("d5").cast("double") if n > 1 else F.lit(0.0)


def tse(spark: SparkSession, n: int, t2=0.1, m0: float = 1.0, te: float = 0.01) -> ArrayFrame:
    """Turbo spin echo: decay with T2."""
    return _array(spark, n, _size(t2), m0 * F.exp(-_t(n) * te / _tissue(t2)))


def se(spark, n: int, t1=0.781, t2=0.1, m0: float = 1.0, te: float = 0.01, tr: float = 1000.0, ti: float = 0.0, inverted: bool = False, single: bool = False) -> ArrayFrame:
    """Spin echo, after an inversion on request (ti: step of the inversion time); single: one repetition."""
    r1, r2, k = 1 / _tissue(t1), 1 / _tissue(t2), F.lit(1.0) if single else _t(n)
    if inverted:
        s = (1 - 2 * F.exp(-r1 * ti * k)) * (1 - 2 * F.exp(-(tr - te / 2) * r1) + F.exp(-tr * r1)) * F.exp(-te * r2)
    else:
        s = (1 - 2 * F.exp(-(tr - k * te / 2) * r1) + F.exp(-tr * r1)) * F.exp(-k * te * r2)
    return _array(spark, n, _size(t1, t2), m0 * s)


def _relax(t1, m0, start, tr: float, flip: float, k, approximate: bool):
    """Recovery under a train of small flips from a start value."""
    r1s = 1 / t1 - math.log(math.cos(flip)) / tr
    steady = m0 * (1 / (t1 * r1s) if approximate else (1 - F.exp(-tr / t1)) / (1 - F.exp(-tr * r1s)))
    begin = -steady if start is None else start
    return steady - (steady - begin) * F.exp(-k * tr * r1s)


def look_locker(spark, n: int, t1=1.0, m0: float = 1.0, tr: float = 0.0041, flip: float = math.radians(8), inverted: bool = True, from_steady: bool = False, approximate: bool = False) -> ArrayFrame:
    start = None if from_steady else F.lit(-m0 if inverted else m0)
    return _array(spark, n, _size(t1), _relax(_tissue(t1), m0, start, tr, flip, _t(n), approximate))


def look_locker_reduced(spark, n: int, r1s=1.0, m0: float = 1.0, steady: float = 0.5, tr: float = 0.0041) -> ArrayFrame:
    """By the steady state and the effective rate."""
    return _array(spark, n, _size(r1s), steady - (steady + m0) * F.exp(-(_t(n) + 0.5) * tr * _tissue(r1s)))


def molli(spark, n: int, heartbeats: int, t1=1.0, m0: float = 1.0, tr: float = 0.0041, flip: float = math.radians(8), pause: float = 10.0, inverted: bool = True) -> ArrayFrame:
    """Look-Locker stretches of n / heartbeats samples with free recovery in between."""
    if n % heartbeats:
        raise ValueError("samples must be a multiple of the heartbeats")
    per, t = n // heartbeats, _tissue(t1)
    start = F.lit(-m0 if inverted else m0)
    value = None
    for beat in range(heartbeats):
        k = _t(n) - beat * per
        own = _relax(t, m0, start, tr, flip, k, False)
        value = own if value is None else F.when(_t(n) >= beat * per, own).otherwise(value)
        last = _relax(t, m0, start, tr, flip, F.lit(float(per - 1)), False)
        start = m0 + (last - m0) * F.exp(-pause / t)
    return _array(spark, n, _size(t1), value)


def ir_bssfp(spark, n: int, t1=1.0, t2=0.1, m0: float = 1.0, tr: float = 0.0045, flip: float = math.radians(45)) -> ArrayFrame:
    """Balanced steady-state precession after an inversion."""
    a, b = _tissue(t1), _tissue(t2)
    c, s = math.cos(flip / 2) ** 2, math.sin(flip / 2) ** 2
    steady = m0 * math.sin(flip) / ((a / b + 1) - math.cos(flip) * (a / b - 1))
    return _array(spark, n, _size(t1, t2), steady - (steady + m0 * math.sin(flip / 2)) * F.exp(-_t(n) * tr * (c / a + s / b)))


def fat_modulation(te, b0: float, spectrum: int = 1):
    """(re, im) of the sum over the fat peaks at an echo time (column)."""
    parts = [(a, te * (2 * math.pi * GYRO * b0 * p * 1e-6)) for p, a in zip(FAT_PPM, FAT_AMPLITUDES[spectrum], strict=True)]
    return sum((a * F.cos(x) for a, x in parts[1:]), parts[0][0] * F.cos(parts[0][1])), sum((a * F.sin(x) for a, x in parts[1:]), parts[0][0] * F.sin(parts[0][1]))


def mgre(spark, n: int, t2star=0.03, off_resonance=20.0, water: float = 1.0, fat: float = 0.0, te: float = 0.0016, b0: float = 3.0, spectrum: int = 1) -> ArrayFrame:
    """Multiple gradient echoes: water and fat, decay and off-resonance."""
    t = _t(n) * te
    re, im = fat_modulation(t, b0, spectrum)
    re, im = water + fat * re, fat * im
    size, angle = F.exp(-t / _tissue(t2star)), t * (2 * math.pi) * _tissue(off_resonance)
    c, s = F.cos(angle), F.sin(angle)
    return _array(spark, n, _size(t2star, off_resonance), size * (re * c - im * s), size * (re * s + im * c))


def hsfp(spark, angles, t1: float = 0.781, t2: float = 0.065, tr: float = 0.0045, beta: float = -1.0) -> ArrayFrame:
    """Hybrid-state free precession for a train of polar angles: running sums."""
    rows = [(i, abs(float(x))) for i, x in enumerate(angles)]
    df = spark.createDataFrame(rows, "d0 int, x double")
    w = Window.orderBy("d0")  # the train is a parameter, so it is short
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rate = F.sin("x") ** 2 / t2 + F.cos("x") ** 2 / t1
    df = df.withColumn("to", F.sum(rate).over(w))  # up to and with this angle
    df = df.withColumns({"a": F.coalesce(F.sum(rate).over(before), F.lit(0.0)), "s": F.coalesce(F.sum(F.cos("x") * F.exp(D("to") * tr)).over(before), F.lit(0.0)) * tr})
    whole = df.agg(F.exp(-F.sum(rate) * tr).alias("e"), (F.sum(F.cos("x") * F.exp(D("to") * tr)) * tr).alias("q"))
    df = df.crossJoin(F.broadcast(whole))
    r0 = beta / t1 * D("e") / (1 - beta * D("e")) * D("q")
    return ArrayFrame.of(df.select("d0", (F.exp(-D("a") * tr) * (r0 + D("s") / t1)).alias("re"), F.lit(0.0).alias("im")), [len(rows)])


MODELS = {"tse": tse, "se": se, "ir_look_locker": look_locker, "ir_look_locker_reduced": look_locker_reduced, "molli": molli, "ir_bssfp": ir_bssfp, "mgre": mgre, "hsfp": hsfp}


def simulate(spark, t1, t2, flip: float, tr: float, te: float, n: int, sequence: str = "bssfp", inverted: bool = True, off_resonance=0.0, spins: int = 1) -> ArrayFrame:
    """Bloch simulation by hard pulses: the transverse magnetisation at every echo (dim 5) of every tissue (dim 6).

    bssfp: alternating phases; flash: ideal spoiling. Several spins spread the off-resonance over one cycle of tr and
    are averaged. Tissues are rows, so that they run in parallel."""
    t1, t2, off = (np.broadcast_to(np.asarray(x, float), max(np.size(t1), np.size(t2), np.size(off_resonance))) for x in (t1, t2, off_resonance))
    rows = [(i, float(a), float(b), float(o)) for i, (a, b, o) in enumerate(zip(t1, t2, off, strict=True))]
    df = spark.createDataFrame(rows, "d6 int, t1 double, t2 double, off double")

    def run(batches):
        import pandas as pd

        for p in batches:
            a, b, o = (p[c].to_numpy()[:, None] for c in ("t1", "t2", "off"))
            w = 2 * np.pi * (o + np.arange(spins) / (spins * tr))
            m, mz = np.zeros(w.shape, complex), np.ones(w.shape) * (-1.0 if inverted else 1.0)
            out = np.zeros((len(p), n), complex)

            def wait(m, mz, t, a=a, b=b, w=w):
                return m * np.exp(-t / b + 1j * w * t), 1 + (mz - 1) * np.exp(-t / a)

            for k in range(n):
                turn = flip * (-1) ** k if sequence == "bssfp" else flip
                turn = turn / 2 if sequence == "bssfp" and k == 0 else turn
                y, x = m.imag, m.real  # rotation about the x axis
                m, mz = x + 1j * (y * np.cos(turn) + mz * np.sin(turn)), mz * np.cos(turn) - y * np.sin(turn)
                m, mz = wait(m, mz, te)
                out[:, k] = m.mean(1) * ((-1) ** k if sequence == "bssfp" else 1)
                m, mz = wait(m, mz, tr - te)
                if sequence == "flash":
                    m = np.zeros_like(m)
            yield pd.DataFrame({"d5": np.tile(np.arange(n, dtype=np.int32), len(p)), "d6": np.repeat(p["d6"].to_numpy(), n), "re": out.real.ravel(), "im": out.imag.ravel()})

    return ArrayFrame.of(df.mapInPandas(run, "d5 int, d6 int, re double, im double"), [1] * TIMES + [n, len(rows)])
