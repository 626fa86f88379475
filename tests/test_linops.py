"""Linear and nonlinear operators, proximal steps and algorithms against numpy and against their own adjoints."""

import numpy as np
import pytest
from gridloom.frame import ArrayFrame
from gridloom.operators import algorithms as A
from gridloom.operators import generate, index, kernels, linops, nlops, prox, window
from gridloom.operators import noncartesian as N

RNG = np.random.default_rng(3)


def z(*shape):
    return RNG.normal(size=shape) + 1j * RNG.normal(size=shape)


def dense(a):
    out = np.zeros(a.dims, complex)
    for r in a.df.collect():
        out[tuple(r[f"d{k}"] if d > 1 else 0 for k, d in enumerate(a.dims))] += complex(r.re, r.im)
    return out


def make(spark, x):
    return ArrayFrame.from_numpy(spark, x)


def cases(spark):
    d = [6, 4]
    own = {
        "identity": linops.identity(d), "scale": linops.scale(d, 2 - 1j), "cdiag": linops.cdiag(d, make(spark, z(6, 1))), "zreal": linops.zreal(d),
        "decompose": linops.decompose_complex(d, 2), "extract": linops.extract(d, 0, 1, 5), "slice": linops.slice_(d, d1=2), "resize": linops.resize(d, "centre", d0=9, d1=3),
        "pad_cyclic": linops.padding(d, 0, 2, 3, "cyclic"), "pad_symmetric": linops.padding(d, 0, 2, 3, "symmetric"), "pad_reflect": linops.padding(d, 1, 2, 2, "reflect"), "pad_causal": linops.padding(d, 0, 1, 1, "causal"), "pad_valid": linops.padding(d, 0, 1, 1, "valid"),
        "reshape": linops.reshape(d, 3, [8, 3]), "permute": linops.permute([2, 3, 4], [2, 0, 1]), "shift": linops.shift(d, 0, 2), "shift_zero": linops.shift(d, 0, -2, cyclic=False), "flip": linops.flip(d, 1),
        "add_strided": linops.add_strided(d, 20, 3), "hankel": linops.hankelization(d, 0, 3, 2), "matrix": linops.matrix(d, z(5, 6), 0), "chain": linops.matrix_chain(d, [z(5, 6), z(2, 5)], 0), "hadamard": linops.hadamard(d, 1),
        "fft": linops.fft(d, 3), "fftc": linops.fftc(d, 1), "ifft": linops.ifft(d, 2, unitary=False), "conv": linops.conv(d, make(spark, z(3)), 1), "conv_even": linops.conv(d, make(spark, z(4)), 1), "gauss": linops.conv_gaussian(spark, d, 2, 0.7),
        "fmac": linops.fmac(d, make(spark, z(1, 4, 3)), 2), "sum": linops.sum_(d, 1), "scaled_sum": linops.scaled_sum(d, 2), "avg": linops.avg(d, 3), "repmat": linops.repmat([6], 2, d1=3), "grad": linops.grad(d, 3, 2), "casorati": linops.casorati(d, d0=2, d1=3),
        "coils": linops.coil_maps(d, make(spark, z(6, 4, 1, 3))), "sampling": linops.sampling(d, make(spark, np.eye(6, 4))), "asl": linops.asl(d, 1), "weights": linops.coil_weights(d, 3, 2.0, 4.0),
    }
    points = spark.createDataFrame([(0, 1.25, 2.5), (1, -0.5, 0.0), (2, 4.9, 2.9), (3, 2.0, 3.0)], "id int, x0 double, x1 double")
    own["interpolate"] = linops.interpolate(d, points)
    own["cubic"] = linops.interpolate(d, points, 3)
    own["displaced"] = linops.interpolate_displacement(d, make(spark, RNG.uniform(-1, 1, (6, 4, 2))))
    traj = make(spark, np.concatenate([RNG.uniform(-3, 3, (1, 5)), RNG.uniform(-2, 2, (1, 5)), np.zeros((1, 5))])[:, :])
    own["nudft"], own["nufft"] = linops.nudft(d, traj), linops.nufft(d, traj)
    return own


def test_adjoints(spark):
    """<A x, y> = <x, A^H y> for every operator (real part: some are linear over the reals only)."""
    for name, op in cases(spark).items():
        x, y = z(*op.domain), z(*op.codomain)
        ax, aty = dense(op(make(spark, x))), dense(op.adjoint(make(spark, y)))
        left, right = np.vdot(y, ax).real, np.vdot(aty, x).real
        assert abs(left - right) < 1e-7 * max(1, abs(left)), (name, left, right)


def test_forward_values(spark):
    x = z(6, 4)
    a = make(spark, x)
    f = lambda op: dense(op(a)).squeeze()
    d = [6, 4]
    assert np.allclose(f(linops.padding(d, 0, 2, 3, "symmetric")), np.pad(x, ((2, 3), (0, 0)), "symmetric"))
    assert np.allclose(f(linops.padding(d, 0, 2, 3, "reflect")), np.pad(x, ((2, 3), (0, 0)), "reflect"))
    assert np.allclose(f(linops.padding(d, 0, 2, 3, "cyclic")), np.pad(x, ((2, 3), (0, 0)), "wrap"))
    assert np.allclose(f(linops.fft(d, 3)), np.fft.fftn(x, norm="ortho"))
    assert np.allclose(f(linops.grad(d, 3, 2))[..., 0], np.roll(x, -1, 0) - x)
    assert np.allclose(f(linops.asl(d, 1)), x[:, 0::2] - x[:, 1::2])
    assert np.allclose(f(linops.sum_(d, 1) @ linops.flip(d, 1)), x.sum(0))
    assert np.allclose(f(linops.scale(d, 2) + linops.identity(d)), 3 * x)
    assert np.allclose(f(linops.hankelization(d, 0, 3, 2))[1, :, 2], x[3])


def test_gridding_is_close_to_the_direct_sum(spark):
    n = 12
    x = z(n, n)
    t = np.concatenate([RNG.uniform(-6, 6, (2, 30)), np.zeros((1, 30))])
    a, traj = make(spark, x), make(spark, t)
    direct, grid = dense(kernels.nudft(traj, a)), dense(N.nufft(traj, a))
    assert np.abs(direct - grid).max() < 1e-4 * np.abs(direct).max()
    g = np.arange(n) - n // 2
    want = np.array([(x * np.exp(-2j * np.pi * (k[0] * g[:, None] + k[1] * g[None]) / n)).sum() for k in t.T]) / n
    assert np.allclose(direct.squeeze(), want)
    back, slow = dense(N.nufft_adjoint(traj, make(spark, direct.squeeze()[None]), [n, n])), dense(kernels.nudft_adjoint(traj, make(spark, direct.squeeze()[None]), [n, n]))
    assert np.abs(back - slow).max() < 1e-4 * np.abs(slow).max()


def test_derivatives(spark):
    """Derivatives against differences, and their adjoints."""
    d = [5]
    x, v, w = z(5) + 2, z(5), z(5)
    ref = make(spark, z(5))
    ops = [nlops.axpbz(d, 2j, ref), nlops.sadd(d, 3), nlops.inv(d), nlops.inv(d, 0.3), nlops.div(d, ref), nlops.sqrt(d), nlops.spow(d, 1.5), nlops.exp(d), nlops.log(d), nlops.sin(d), nlops.cos(d), nlops.sinh(d), nlops.cosh(d), nlops.abs_(d), nlops.smoothed_abs(d, 0.1), nlops.phase(d), nlops.ss(d, 1), nlops.rss(d, 1), nlops.mse(d, ref), nlops.mad(d, ref), nlops.sin(d) @ nlops.exp(d)]
    for i, op in enumerate(ops):
        e = 1e-6
        y = [dense(op(make(spark, x + s * e * v))).ravel() for s in (1, -1)]
        der = op.derivative(make(spark, x))
        got = dense(der(make(spark, v))).ravel()
        assert np.allclose(got, (y[0] - y[1]) / (2 * e), rtol=1e-4, atol=1e-5), i
        u = w[: got.size].reshape(der.codomain)
        assert abs(np.vdot(u.ravel(), got).real - np.vdot(dense(der.adjoint(make(spark, u))).ravel(), v).real) < 1e-6, i


def test_proximal_steps(spark):
    x = z(6, 3)
    a = make(spark, x)
    f = lambda b: dense(b).squeeze()
    n = np.linalg.norm(x)
    assert np.allclose(f(prox.l2_ball(a, 1.0)), x / n) and np.allclose(f(prox.l2_ball(a, 100.0)), x) and np.allclose(f(prox.sphere(a, 2.0)), 2 * x / n)
    assert np.allclose(f(prox.l2_norm(a, 0.5)), x * (1 - 0.5 / n))
    assert np.allclose(f(prox.mean_free(a, 1)), x - x.mean(0)) and np.allclose(f(prox.non_negative(a)), np.maximum(x.real, 0))
    assert np.allclose(f(prox.less_equal(a, -0.2)), np.minimum(x.real, -0.2))
    assert np.allclose(f(prox.least_squares(a, 2.0, a)), x)
    s = f(prox.conjugate(a, 0.7, prox.soft))
    assert np.allclose(s, x / np.maximum(1, np.abs(x)))
    t = f(prox.smax(a, 0.5, 1)).real
    for j in range(3):
        assert np.isclose((x.real[:, j] - t[:, j]).sum(), 0.5) and np.isclose(t[:, j].max(), t[:, j][x.real[:, j] > t[:, j]].max())
    m = z(4, 6)
    op = linops.matrix([6], m, 0)
    b, y = z(6), z(4)
    got = f(prox.normal_equations(make(spark, b), 0.3, op, make(spark, y)))
    assert np.allclose(got, np.linalg.solve(np.eye(6) + 0.3 * m.conj().T @ m, b + 0.3 * m.conj().T @ y), atol=1e-6)
    assert np.allclose(m @ f(prox.linear_equations(make(spark, b), op, make(spark, y))), y, atol=1e-6)
    assert np.allclose(f(prox.largest(a, 2, 1)), np.where(np.abs(x) > np.sort(np.abs(x), 0)[-3], x, 0))


def test_algorithms_in_memory():
    m = z(12, 5)
    want = z(5)
    y = m @ want
    fwd, adj = (lambda x: m @ x), (lambda r: m.conj().T @ r)
    top = np.linalg.norm(m, 2) ** 2
    assert np.allclose(A.lsqr(fwd, adj, y, 20), want) and np.allclose(A.landweber(fwd, adj, y, 1 / top, 4000), want, atol=1e-3)
    assert abs(A.power_iteration(lambda x: adj(fwd(x)), z(5), 200) - top) < 1e-3 * top
    grad, none = (lambda x: adj(fwd(x) - y)), (lambda x, t: x)
    for solve, steps in ((A.ist, 4000), (A.fista, 800)):
        assert np.allclose(solve(grad, none, 0 * want, 1 / top, steps), want, atol=1e-3)
    soft = lambda x, t: x * np.maximum(0, 1 - t / np.maximum(np.abs(x), 1e-30))
    lam = 3.0
    by_fista = A.fista(grad, lambda x, t: soft(x, lam * t), 0 * want, 1 / top, 3000)
    same = lambda x: x
    by_admm = A.admm(lambda x: adj(fwd(x)), adj(y), [(same, same, lambda v, t: soft(v, lam * t))], 0 * want, 5.0, 400)
    assert np.allclose(by_admm, by_fista, atol=1e-3)
    s = 1 / np.linalg.norm(m, 2)
    dual = lambda p, sig: (p - sig * y) / (1 + sig)
    by_cp = A.chambolle_pock(fwd, adj, dual, lambda x, t: soft(x, lam * t), 0 * want, s, s, 4000)
    assert np.allclose(by_cp, by_fista, atol=1e-3)
    f = lambda x: x**2
    lin = lambda x: ((lambda v: 2 * x * v), (lambda w: 2 * x * w))
    data = np.array([4.0, 9.0])
    assert np.allclose(A.irgnm(f, lin, data, np.ones(2), 25, least=1e-9), [2, 3], atol=1e-4)
    assert np.allclose(A.levenberg_marquardt(f, lin, data, np.ones(2), 40), [2, 3], atol=1e-6)
    bowl = lambda x: float(((x - 3) ** 2).sum())
    slope = lambda x, *_: 2 * (x - 3)
    assert np.allclose(A.lbfgs(bowl, slope, np.zeros(4), 50), 3, atol=1e-6)
    assert np.allclose(A.adam(slope, np.zeros(4), 0.1, 800), 3, atol=1e-2) and np.allclose(A.sgd(slope, np.zeros(4), 0.1, 200), 3, atol=1e-6)
    assert abs(A.adadelta(slope, np.zeros(1), 20000)[0] - 3) < 0.1
    clean = np.append(np.ones(20), 50.0)
    ones = np.ones((21, 1))
    lad = A.lad(lambda x: ones @ x, lambda r: ones.T @ r, clean, np.zeros(1), lambda r, v: v / np.maximum(np.abs(r), 1e-6), 60)
    assert abs(lad[0] - 1) < 1e-3
    parts = A.ipalm([lambda p: 2 * (p[0] - p[1]), lambda p: 2 * (p[1] - p[0]) + 2 * (p[1] - 5)], [none, none], [np.zeros(1), np.zeros(1)], [0.2, 0.2], 300)
    assert np.allclose(parts, 5, atol=1e-3)
    assert np.allclose(A.pocs([lambda x: np.maximum(x, 0), lambda x: x + (1 - x.sum()) / 2], np.array([3.0, -5.0]), 100).sum(), 1)
    b = A.batches(10, 3)
    assert sorted(np.concatenate([next(b) for _ in range(4)]).tolist()) == list(range(10))


def test_algorithms_on_the_cluster(spark):
    m = z(6, 3)
    op = linops.matrix([3], m, 0)
    want = z(3)
    data = A.Vector(make(spark, m @ want))
    got = A.lsqr(lambda x: x.apply(op), lambda y: y.apply(op.adjoint), data, 5)
    assert np.allclose(dense(got.a).ravel(), want, atol=1e-6)


def test_index_algebra(spark):
    x = RNG.normal(size=(4, 6))
    a = make(spark, x)
    assert index.compare(a, index.flip(index.flip(a, 3), 3)) and not index.compare(a, index.flip(a, 1))
    assert np.allclose(dense(index.shuffle_blocks(index.shuffle_blocks(a, 1, 3), 1, 3, adjoint=True)).squeeze(), x)
    assert np.allclose(dense(index.decompose(a, 1, 2, 2)).squeeze(), np.stack([x[:, 0::2], x[:, 1::2]], 2))
    mask = make(spark, (x > 0).astype(float))
    assert np.allclose(dense(index.mask_decompress(index.mask_compress(mask), mask.dims)).squeeze(), x > 0)
    assert np.allclose(np.diag(dense(index.fill_diagonal(a, 3, 9.0)).squeeze().real), 9)


def test_windows_and_labels(spark):
    x = RNG.normal(size=(30, 2))
    a = make(spark, x)
    t = np.arange(30)
    fit = np.stack([np.polyval(np.polyfit(t, x[:, j], 1), t) for j in range(2)], 1)
    assert np.allclose(dense(window.detrend(a, 0)).squeeze(), x - fit)
    g = dense(window.geometric_median(make(spark, np.array([0, 1, 1j, 100.0])), 1)).ravel()[0]
    assert abs(g - 1) < 0.1  # the point inside the triangle of the others
    grid = np.zeros((8, 8))
    grid[0, :3] = grid[5:, 6] = grid[3:6, 2] = grid[5, 3] = 1
    lab = dense(window.label(make(spark, grid), 3)).squeeze().real
    assert len(set(lab[grid > 0])) == 3 and lab[5, 3] == lab[3, 2] and lab[0, 0] == lab[0, 2] != lab[5, 6]


def test_long_lines_are_cut(spark, monkeypatch):
    monkeypatch.setattr(window, "STRETCH", 7)
    x = RNG.normal(size=40)
    a = make(spark, x)
    assert np.allclose(dense(window.cumsum(a, 0)).ravel(), np.cumsum(x))
    assert np.allclose(dense(window.moving_average(a, 0, 9)).ravel(), np.convolve(x, np.ones(9) / 9, "valid"))
    assert np.allclose(dense(window.moving_median(a, 0, 9)).ravel(), [sorted(x[i : i + 9], key=abs)[4] for i in range(32)])
    assert np.allclose(dense(window.forward_difference(a, 0)).ravel(), x - np.roll(x, 1)) and np.allclose(dense(window.backward_difference(a, 0)).ravel(), x - np.roll(x, -1))
    assert generate.ones(spark, [2]).size == 2


@pytest.mark.parametrize("value", [0.5, 1.5, 2.5, -0.5])
def test_rounding_is_away_from_zero(spark, value):
    from gridloom.operators import elementwise

    assert dense(elementwise.calc(make(spark, np.array([value, 1.0])), "zround")).ravel()[0].real == np.sign(value) * np.floor(abs(value) + 0.5)
