"""Iterative algorithms over anything that adds, scales and has a scalar product: numpy arrays, or arrays of the cluster.

Vector wraps an array of the cluster; whatever it becomes is written to the checkpoint folder, so that iterations do
not pile up in one plan and lost executors cost one step."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..frame import ArrayFrame, kept


class Vector:
    """An ArrayFrame with arithmetic."""

    def __init__(self, a: ArrayFrame):
        self.a = a

    def _new(self, a: ArrayFrame) -> Vector:
        return Vector(ArrayFrame(kept(a.df), a.dims))

    def apply(self, f: Callable[[ArrayFrame], ArrayFrame]) -> Vector:
        return self._new(f(self.a))

    def __add__(self, other):
        from .elementwise import saxpy

        return self._new(saxpy(1.0, self.a, other.a))

    def __sub__(self, other):
        from .elementwise import saxpy

        return self._new(saxpy(-1.0, other.a, self.a))

    def __rmul__(self, factor):
        from .elementwise import scale

        return Vector(scale(self.a, factor))

    def dot(self, other) -> float:
        """Real part of the scalar product."""
        from .reduce import sdot

        return sdot(self.a, other.a).real


def dot(x, y) -> float:
    return x.dot(y) if isinstance(x, Vector) else float(np.vdot(x, y).real)


def norm(x) -> float:
    return math.sqrt(max(0.0, dot(x, x)))


@dataclass
class Monitor:
    """Called with every step's number and state; keeps what `measure` says of it."""

    measure: Callable = norm

    def __post_init__(self):
        self.history: list[float] = []

    def __call__(self, step: int, x) -> None:
        self.history.append(self.measure(x))


def conjugate_gradients(normal, b, iterations: int, tolerance: float = 1e-9, start=None, monitor=None):
    """normal(x) = b for a positive operator."""
    x = 0.0 * b if start is None else start
    r = b if start is None else b - normal(start)
    p, rr = r, dot(r, r)
    first = rr
    for k in range(iterations):
        if rr <= tolerance**2 * first or rr == 0:
            break
        q = normal(p)
        step = rr / dot(p, q)
        x, r = x + step * p, r - step * q
        new = dot(r, r)
        p, rr = r + (new / rr) * p, new
        if monitor:
            monitor(k, x)
    return x


def batched_cg(normal, bs, iterations: int, tolerance: float = 1e-9):
    """The same operator for several right sides, one after the other."""
    return [conjugate_gradients(normal, b, iterations, tolerance) for b in bs]


def lsqr(forward, adjoint, y, iterations: int, ridge: float = 0.0, monitor=None):
    """Least squares with a ridge, by the normal equations."""
    return conjugate_gradients(lambda x: adjoint(forward(x)) + ridge * x, adjoint(y), iterations, monitor=monitor)


def landweber(forward, adjoint, y, step: float, iterations: int, project=None, start=None, monitor=None):
    x = 0.0 * adjoint(y) if start is None else start
    for k in range(iterations):
        x = x + step * adjoint(y - forward(x))
        x = project(x) if project else x
        if monitor:
            monitor(k, x)
    return x


def ist(gradient, prox, start, step: float, iterations: int, monitor=None):
    """Proximal gradient steps; prox(x, step)."""
    x = start
    for k in range(iterations):
        x = prox(x - step * gradient(x), step)
        if monitor:
            monitor(k, x)
    return x


def fista(gradient, prox, start, step: float, iterations: int, monitor=None):
    """Proximal gradient steps with Nesterov's extrapolation."""
    x = z = start
    t = 1.0
    for k in range(iterations):
        new = prox(z - step * gradient(z), step)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + ((t - 1) / t2) * (new - x), new, t2
        if monitor:
            monitor(k, x)
    return x


def niht(gradient, keep, start, step: float, iterations: int):
    """Normalised iterative hard thresholding: keep(x) leaves the k largest cells."""
    return ist(gradient, lambda x, _: keep(x), start, step, iterations)


def euler_maruyama(score, start, step: float, iterations: int, noise):
    """Langevin sampling: drift along the score and noise(k), standard normal."""
    x = start
    for k in range(iterations):
        x = x + step * score(x) + math.sqrt(2 * step) * noise(k)
    return x


def power_iteration(normal, start, iterations: int) -> float:
    """The largest eigenvalue of a positive operator."""
    x, value = start, 0.0
    for _ in range(iterations):
        x = (1 / norm(x)) * x
        y = normal(x)
        value, x = norm(y), y
        if not value:
            break
    return value


def irgnm(forward, derivative, y, start, iterations: int, alpha: float = 1.0, reduction: float = 0.5, inner: int = 20, reference=None, least: float = 0.0):
    """Iteratively regularised Gauss-Newton steps: derivative(x) gives the pair (forward, adjoint) of the linearisation."""
    x, ref = start, start if reference is None else reference
    for _ in range(iterations):
        d, dt = derivative(x)
        b = dt(y - forward(x) + d(x - ref))
        a = alpha
        x = ref + conjugate_gradients(lambda v, d=d, dt=dt, a=a: dt(d(v)) + a * v, b, inner)
        alpha = max(least, alpha * reduction)
    return x


def irgnm2(forward, derivative, y, start, iterations: int, solve, alpha: float = 1.0, reduction: float = 0.5):
    """The same with an inner solver of its own: solve(forward, adjoint, data, alpha, from)."""
    x = start
    for _ in range(iterations):
        d, dt = derivative(x)
        x = solve(d, dt, y - forward(x) + d(x), alpha, x)
        alpha *= reduction
    return x


def levenberg_marquardt(forward, derivative, y, start, iterations: int, damping: float = 1.0, inner: int = 20):
    """Damped Gauss-Newton steps; a step that does not help raises the damping."""
    x, r = start, y - forward(start)
    cost = dot(r, r)
    for _ in range(iterations):
        d, dt = derivative(x)
        step = conjugate_gradients(lambda v, d=d, dt=dt, a=damping: dt(d(v)) + a * v, dt(r), inner)
        new = x + step
        left = y - forward(new)
        now = dot(left, left)
        if now < cost:
            x, r, cost, damping = new, left, now, damping / 3
        else:
            damping *= 4
    return x


def alternating(solvers, start: list, rounds: int):
    """Minimisation over one part after the other: solvers[i](parts) gives part i."""
    parts = list(start)
    for _ in range(rounds):
        for i, solve in enumerate(solvers):
            parts[i] = solve(parts)
    return parts


def pocs(projections, start, iterations: int):
    x = start
    for _ in range(iterations):
        for p in projections:
            x = p(x)
    return x


def chambolle_pock(forward, adjoint, prox_dual, prox, start, sigma: float, tau: float, iterations: int, theta: float = 1.0, monitor=None):
    """Primal-dual steps for f(Kx) + g(x): prox_dual(p, sigma) is that of f's conjugate, prox(x, tau) that of g."""
    x = bar = start
    p = 0.0 * forward(start)
    for k in range(iterations):
        p = prox_dual(p + sigma * forward(bar), sigma)
        new = prox(x - tau * adjoint(p), tau)
        bar, x = new + theta * (new - x), new
        if monitor:
            monitor(k, x)
    return x


def admm(normal, b, terms, start, rho: float, iterations: int, inner: int = 10, monitor=None):
    """1/2 <x, N x> - <b, x> + sum g_i(T_i x): terms are (T, adjoint of T, prox of g(x, level))."""
    x = start
    z = [t(x) for t, _, _ in terms]
    u = [0.0 * v for v in z]
    for k in range(iterations):
        right = b
        for (_, back, _), v, w in zip(terms, z, u, strict=True):
            right = right + rho * back(v - w)

        def left(v):
            out = normal(v)
            for t, back, _ in terms:
                out = out + rho * back(t(v))
            return out

        x = conjugate_gradients(left, right, inner, start=x)
        for i, (t, _, prox) in enumerate(terms):
            tx = t(x)
            z[i] = prox(tx + u[i], 1 / rho)
            u[i] = u[i] + tx - z[i]
        if monitor:
            monitor(k, x)
    return x


def lad(forward, adjoint, y, start, weight, rounds: int, inner: int = 10, ridge: float = 0.0):
    """Least absolute deviations by reweighted least squares: weight(r, v) multiplies v by 1/|r| (bounded)."""
    x = start
    for _ in range(rounds):
        r = y - forward(x)
        x = conjugate_gradients(lambda v, r=r: adjoint(weight(r, forward(v))) + ridge * v, adjoint(weight(r, y)), inner)
    return x


def batches(n: int, size: int, seed: int = 0):
    """Endless batches of indices below n, each round in a new order."""
    rng = np.random.default_rng(seed)
    while True:
        order = rng.permutation(n)
        yield from (order[i : i + size] for i in range(0, n, size))


def sgd(gradient, start, rate: float, steps: int, momentum: float = 0.0, clip: float | None = None):
    """gradient(x, step) may look at a batch only."""
    x, v = start, 0.0 * start
    for k in range(steps):
        g = gradient(x, k)
        if clip is not None and norm(g) > clip:
            g = (clip / norm(g)) * g
        v = momentum * v - rate * g
        x = x + v
    return x


def adam(gradient, start: np.ndarray, rate: float, steps: int, beta1: float = 0.9, beta2: float = 0.999, small: float = 1e-8):
    x, m, v = start, np.zeros_like(start), np.zeros(start.shape)
    for k in range(1, steps + 1):
        g = gradient(x, k - 1)
        m, v = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * np.abs(g) ** 2
        x = x - rate * (m / (1 - beta1**k)) / (np.sqrt(v / (1 - beta2**k)) + small)
    return x


def adadelta(gradient, start: np.ndarray, steps: int, rho: float = 0.95, small: float = 1e-6, rate: float = 1.0):
    x, g2, d2 = start, np.zeros(start.shape), np.zeros(start.shape)
    for k in range(steps):
        g = gradient(x, k)
        g2 = rho * g2 + (1 - rho) * np.abs(g) ** 2
        d = np.sqrt(d2 + small) / np.sqrt(g2 + small) * g
        d2 = rho * d2 + (1 - rho) * np.abs(d) ** 2
        x = x - rate * d
    return x


def ipalm(gradients, proxes, start: list, steps: list[float], rounds: int, inertia: float = 0.5):
    """Inertial proximal alternating linearised minimisation: gradients[i](parts) is that of part i."""
    x, old = list(start), list(start)
    for _ in range(rounds):
        for i, (g, prox, step) in enumerate(zip(gradients, proxes, steps, strict=True)):
            y = x[i] + inertia * (x[i] - old[i])
            old[i] = x[i]
            x[i] = prox(y - step * g([*x[:i], y, *x[i + 1 :]]), step)
    return x


def lbfgs(value, gradient, start, iterations: int, memory: int = 8):
    """Limited-memory quasi-Newton steps with backtracking."""
    x, g, pairs = start, gradient(start), []
    for _ in range(iterations):
        q, scales = g, []
        for s, y in reversed(pairs):
            a = dot(s, q) / dot(s, y)
            q = q - a * y
            scales.append(a)
        if pairs:
            s, y = pairs[-1]
            q = (dot(s, y) / dot(y, y)) * q
        for (s, y), a in zip(pairs, reversed(scales), strict=True):
            q = q + (a - dot(y, q) / dot(s, y)) * s
        slope, f, t = dot(g, q), value(x), 1.0
        if slope <= 1e-300:
            break
        while value(x - t * q) > f - 1e-4 * t * slope and t > 1e-12:
            t /= 2
        new = x - t * q
        h = gradient(new)
        if dot(new - x, h - g) > 1e-300:
            pairs = [*pairs, (new - x, h - g)][-memory:]
        x, g = new, h
    return x


# The embedded Runge-Kutta pair of Dormand and Prince (stages, weights of order five, of order four).
_STAGES = ((), (1 / 5,), (3 / 40, 9 / 40), (44 / 45, -56 / 15, 32 / 9), (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729), (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656), (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84))
_FIFTH = (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0)
_FOURTH = (5179 / 57600, 0, 7571 / 16695, 393 / 640, -92097 / 339200, 187 / 2100, 1 / 40)


def ode(f, start: np.ndarray, begin: float, end: float, tolerance: float = 1e-6, step: float | None = None) -> np.ndarray:
    """The state at `end` of x' = f(t, x), with steps as long as the tolerance allows."""
    t, x = begin, np.array(start)
    h = step or (end - begin) / 100
    while t < end:
        h = min(h, end - t)
        k = []
        for row in _STAGES:
            k.append(f(t + h * sum(row), x + h * sum((a * b for a, b in zip(row, k, strict=True)), 0 * x)))
        better = x + h * sum(a * b for a, b in zip(_FIFTH, k, strict=True))
        error = float(np.abs(better - x - h * sum(a * b for a, b in zip(_FOURTH, k, strict=True))).max())
        if error <= tolerance or h < 1e-14 * max(1.0, abs(end)):
            t, x = t + h, better
        h *= min(5.0, max(0.2, 0.9 * (tolerance / error) ** 0.2 if error else 5.0))
    return x


ALGORITHMS = {f.__name__: f for f in (conjugate_gradients, batched_cg, lsqr, landweber, ist, fista, niht, euler_maruyama, power_iteration, irgnm, irgnm2, levenberg_marquardt, alternating, pocs, chambolle_pock, admm, lad, batches, sgd, adam, adadelta, ipalm, lbfgs, ode)}
