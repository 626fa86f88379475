"""Signals, calibration, joint estimation, penalties and formats against numpy."""

import math
import struct
import zlib

import numpy as np
import pytest
from gridloom import registry
from gridloom.frame import ArrayFrame
from gridloom.operators import calibration, recon, reduce, signals
from gridloom.sources import arrays

RNG = np.random.default_rng(5)


def dense(a):
    out = np.zeros(a.dims, complex)
    for r in a.df.collect():
        out[tuple(r[f"d{k}"] if d > 1 else 0 for k, d in enumerate(a.dims))] += complex(r.re, r.im)
    return out


def make(spark, x):
    return ArrayFrame.from_numpy(spark, x)


@pytest.fixture(scope="module")
def scan(spark):
    """A small image, smooth coils of root of squares one, and their k-space."""
    n, m = 16, 4
    x, y = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    image = ((x - 8) ** 2 + (y - 7) ** 2 < 30) * 1.0 + ((x - 6) ** 2 + (y - 9) ** 2 < 6) * 0.5
    maps = dense(calibration.coils(spark, [n, n], m)).reshape(n, n, 1, m)
    maps = maps / np.sqrt((np.abs(maps) ** 2).sum(3, keepdims=True))
    k = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(image[:, :, None, None] * maps, (0, 1)), axes=(0, 1), norm="ortho"), (0, 1))
    return image, maps, k


def test_signal_models(spark):
    t = np.arange(6)
    v = lambda a: dense(a).reshape(6, -1, order="F")
    assert np.allclose(v(signals.tse(spark, 6, [0.1, 0.2]))[:, 1], np.exp(-t * 0.01 / 0.2))
    r1s = 1 / 0.8 - math.log(math.cos(math.radians(8))) / 0.0041
    mss = (1 - math.exp(-0.0041 / 0.8)) / (1 - math.exp(-0.0041 * r1s))
    assert np.allclose(v(signals.look_locker(spark, 6, 0.8))[:, 0], mss - (mss + 1) * np.exp(-t * 0.0041 * r1s))
    z = v(signals.mgre(spark, 6, 0.05, 30.0))[:, 0]
    assert np.allclose(z, np.exp(-t * 0.0016 / 0.05 + 2j * np.pi * 30 * t * 0.0016))
    m = v(signals.molli(spark, 6, 2, 0.8, pause=0.5))[:, 0].real
    assert m[0] == -1 and np.isclose(m[3], 1 + (m[2] - 1) * math.exp(-0.5 / 0.8))
    s = v(signals.simulate(spark, [1.0, 0.5], [0.1, 0.05], math.radians(40), 0.005, 0.0025, 6, "flash", inverted=False))
    assert np.isclose(s[0, 0], 1j * math.sin(math.radians(40)) * math.exp(-0.0025 / 0.1))
    a = np.abs(RNG.normal(size=5))
    h = dense(signals.hsfp(spark, a)).ravel().real
    rate = np.sin(a) ** 2 / 0.065 + np.cos(a) ** 2 / 0.781
    up = np.cumsum(rate)
    part = np.concatenate([[0], np.cumsum(np.cos(a) * np.exp(up * 0.0045))]) * 0.0045
    whole = np.exp(-up[-1] * 0.0045)
    r0 = -1 / 0.781 * whole / (1 + whole) * part[-1]
    assert np.allclose(h, np.exp(-np.concatenate([[0], up[:-1]]) * 0.0045) * (r0 + part[:-1] / 0.781))


def test_walsh_and_eigenvectors(spark, scan):
    image, maps, k = scan
    cov = calibration.walsh(make(spark, k), 16, 3)
    got = dense(cov)[:, :, 0]
    seen = image[:, :, None] * maps[:, :, 0]
    want = sum(np.roll(np.roll(seen[..., 0] * seen[..., 2].conj(), i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1))
    assert np.allclose(got[:, :, 2].squeeze(), want)
    vec, val = calibration.ecaltwo(cov, 4)
    v, inside = dense(vec)[:, :, 0].squeeze(), image > 0
    assert np.abs((v * maps[:, :, 0].conj()).sum(2))[inside].min() > 0.98 and dense(val).real.max() > 0


def test_joint_estimation(spark, scan):
    image, maps, k = scan
    mask = np.zeros((16, 16, 1, 1))
    mask[::2] = 1
    mask[6:10] = 1
    got = np.abs(dense(calibration.nlinv(make(spark, k * mask))).squeeze())
    f = (got * image).sum() / (got**2).sum()
    assert np.linalg.norm(f * got - image) < 0.2 * np.linalg.norm(image)
    series = np.stack([k * mask, k * mask], -1).reshape(16, 16, 1, 4, 1, 1, 1, 1, 1, 1, 2)
    two = np.abs(dense(calibration.rtnlinv(make(spark, series), rounds=5)).squeeze())
    assert two.shape == (16, 16, 2) and np.linalg.norm(two[..., 1]) > 0


def test_penalties(spark, scan):
    image, maps, k = scan
    mask = (RNG.random((16, 16)) < 0.6)[:, :, None, None]
    y, s = make(spark, k * mask), make(spark, maps)
    error = lambda a: np.linalg.norm(dense(a).squeeze() - image) / np.linalg.norm(image)
    for codes, solver in (([("T", 0.01)], "admm"), ([("W", 0.01), ("R1", 0.01)], "admm"), ([("T", 0.01)], "pridu"), ([("I", 0.001)], "fista"), ([("S", 0.0), ("G", 0.003)], "admm")):
        assert error(recon.pics_penalties(y, s, codes, solver, 200 if solver == "pridu" else 40)) < 0.2, (codes, solver)
    x = RNG.normal(size=(8, 8, 1, 1)) + 0j
    for code in ("I", "Q", "W", "H", "N", "T", "G", "C", "F", "L", "M", "R1", "R2", "S"):
        t, back, prox = recon.penalty(code, 3.0, (0, 1))
        u = t(x)
        assert np.isclose(np.vdot(u, u).real, np.vdot(back(u), x).real) and prox(u, 0.1).shape == u.shape, code
    with pytest.raises(ValueError):
        recon.pics_penalties(y, s, [("T", 1.0), ("I", 1.0)], "fista").df.collect()


def test_completion_and_delays(spark, scan):
    _, _, k = scan
    mask = RNG.random((16, 16, 1, 1)) < 0.8
    mask[6:10, 6:10] = True
    got = dense(calibration.sake(make(spark, k * mask), 0.25, 3, 60)).reshape(k.shape)
    assert np.linalg.norm(got - k) < 0.6 * np.linalg.norm(k * ~mask)
    from gridloom.operators import generate

    traj = generate.traj(spark, 64, 12, radial=True, double=False)
    angle, r = 2 * np.pi * np.arange(12) / 12, np.arange(64) + 0.5 - 32
    shift = 0.4 * np.cos(angle) ** 2 - 0.3 * np.sin(angle) ** 2
    data = np.exp(-((r[:, None] - shift[None]) ** 2) / 50)[None]
    sx, sy, sxy = calibration.estdelay(traj, make(spark, data))
    assert abs(sx - 0.4) < 0.05 and abs(sy + 0.3) < 0.05 and abs(sxy) < 0.05


def test_motion(spark):
    x, y = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    blob = lambda u, v: np.exp(-((u - 15) ** 2) / 40 - (v - 17) ** 2 / 20)
    fixed, moving = make(spark, blob(x, y)), make(spark, blob(x - 1.5, y + 1.0))
    m = dense(calibration.affinereg(fixed, moving)).squeeze().real
    assert np.allclose(m[:, 2], [1.5, -1.0], atol=0.1) and np.allclose(m[:, :2], np.eye(2), atol=0.05)
    u = dense(calibration.estmotion(fixed, moving)).squeeze().real
    assert abs(u[15, 17, 0] - 1.5) < 0.5 and abs(u[15, 17, 1] + 1.0) < 0.5


def test_model_based_maps(spark):
    n, times = 8, np.array([0.05, 0.2, 0.5, 1.0, 2.0])
    image = np.zeros((n, n))
    image[2:6, 2:6] = 1
    series = image[..., None] * (0.7 - 1.7 * np.exp(-times * 1.4))
    k = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(series, (0, 1)), axes=(0, 1), norm="ortho"), (0, 1)).reshape(n, n, 1, 1, 1, 5)
    maps = dense(calibration.moba(make(spark, k), make(spark, np.ones((n, n, 1, 1))), times, rounds=14)).squeeze().real
    assert np.allclose(maps[3, 3], [0.7, 1.0, 1.4], rtol=0.1)


def test_poles_of_phase(spark):
    x, y = np.meshgrid(np.arange(8) - 3.5, np.arange(8) - 3.5, indexing="ij")
    a = (x + 1j * y)[:, :, None, None] * np.ones((1, 1, 1, 2))
    got = dense(calibration.phasepole(make(spark, a))).squeeze().real
    assert got[3, 3] == 1 and got.sum() == 1


def test_similarity_measures(spark):
    x = RNG.random((12, 12))
    a, b = make(spark, x), make(spark, x + 0.1 * RNG.random((12, 12)))
    assert np.isclose(reduce.ssim(a, a, 3), 1) and 0.5 < reduce.ssim(a, b, 3) < 1
    assert reduce.mutual_information(a, a, 8) > reduce.mutual_information(a, make(spark, RNG.random((12, 12))), 8) >= 0
    lab = make(spark, np.array([0, 1, 1, 2.0]))
    assert reduce.accuracy(lab, lab) == 1 and reduce.dice(lab, lab) == 1
    got = {r.label: (r.d0, r.n) for r in reduce.centre_of_mass(lab).collect()}
    assert got == {1.0: (1.5, 2), 2.0: (3.0, 1)}
    n = reduce.norms(make(spark, np.array([3, -4, 0.0])))
    assert (n["l1"], n["l2"], n["max"]) == (7, 5, 4) and np.isclose(n["mad"], np.mean(np.abs(np.array([3, -4, 0]) + 1 / 3)))


def test_formats(spark, tmp_path):
    x = RNG.normal(size=(4, 3)).astype(np.float32)
    x[1, 1] = 0
    a = make(spark, x)
    for name in ("a", "b.ra"):
        arrays.write_raw(a, f"{tmp_path}/{name}")
        assert np.allclose(dense(arrays.read_raw(spark, f"{tmp_path}/{name}")).squeeze(), x)
    arrays.write_many({"one": a, "two": a}, f"{tmp_path}/many")
    assert set(arrays.read_many(spark, f"{tmp_path}/many", ["one", "two"])) == {"one", "two"}
    with pytest.raises(Exception, match="(?i)exist"):
        arrays.write_parquet(a, f"{tmp_path}/many/one", overwrite=False)
    assert arrays.show(a).count("\n") == 2
    png = arrays.toimg(a).collect()[0].png
    assert bytes(png[:8]) == b"\x89PNG\r\n\x1a\n"
    at = png.index(b"IDAT")
    raw = zlib.decompress(bytes(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]]))
    assert len(raw) == 4 * (3 + 1) and raw[0] == 0
    mesh = b"\0" * 80 + struct.pack("<I", 1) + struct.pack("<12fH", *range(12), 0)
    (tmp_path / "m.stl").write_bytes(mesh)
    assert [(r.corner, r.x) for r in arrays.read_stl(spark, f"{tmp_path}/m.stl").collect()] == [(0, 3.0), (1, 6.0), (2, 9.0)]


def test_registry_takes_further_operators():
    registry.register("own_test_operator", lambda x: x + 1)
    assert registry.run("own_test_operator", 1) == 2 and registry.run("version")
    with pytest.raises(ValueError):
        registry.register("fft", None)
    del registry.OPERATORS["own_test_operator"]


def test_phantom_spectrum_is_that_of_the_image(spark):
    from gridloom.operators import generate, kernels

    image, k = generate.phantom(spark, 96), dense(generate.phantom(spark, 96, k_space=True)).squeeze()
    want = dense(kernels.fft(image, 3, unitary=True)).squeeze()
    assert np.linalg.norm(k[32:64, 32:64] - want[32:64, 32:64]) < 0.1 * np.linalg.norm(want)
    assert dense(generate.phantom(spark, 16, 3)).shape[3] == 3


def test_network_and_ode(spark):
    from gridloom.operators import algorithms as A
    from gridloom.operators import neural

    x = RNG.normal(size=(2, 400))
    y = (x[0] * x[1] > 0).astype(float)
    features = make(spark, x)
    net = neural.fit(features, make(spark, y[None]), 0, classes=True, hidden=(16,), steps=1500)
    out = dense(neural.apply(net, features)).squeeze().real
    assert (out.argmax(0) == y).mean() > 0.93 and np.allclose(out.sum(0), 1)
    turn = A.ode(lambda t, v: np.array([-v[1], v[0]]), np.array([1.0, 0.0]), 0.0, 2 * math.pi, 1e-9)
    assert np.allclose(turn, [1, 0], atol=1e-6)
