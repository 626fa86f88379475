import math

import numpy as np
from gridloom.frame import ArrayFrame
from gridloom.operators import kernels, models, recon
from test_arrays import near, vec


def phantom(n=32, coils=4, seed=0):
    y, x = np.mgrid[:n, :n] / n - 0.5
    image = ((x / 0.4) ** 2 + (y / 0.3) ** 2 < 1) + 0.5 * ((x - 0.1) ** 2 + y**2 < 0.01) + 0j
    s = np.stack([np.exp(-3 * ((x - 0.4 * math.cos(a)) ** 2 + (y - 0.4 * math.sin(a)) ** 2)) * np.exp(1j * (a + x)) for a in np.arange(coils) * 2 * math.pi / coils], -1)
    s /= np.sqrt((np.abs(s) ** 2).sum(-1, keepdims=True))
    return image[:, :, None, None], s[:, :, None, :]


def k_space(image, s):
    return recon._f(image * s, (0, 1))


def error(a, want):
    return np.linalg.norm(np.squeeze(a) - np.squeeze(want)) / np.linalg.norm(want)


def test_transforms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 6)) + 1j * rng.normal(size=(8, 6))
    a = ArrayFrame.from_numpy(spark, x)
    near(kernels.fft(a, 3, centred=False), np.fft.fft2(x))
    near(kernels.fft(kernels.fft(a, 3, unitary=True), 3, inverse=True, unitary=True), x)
    near(kernels.cdf97(kernels.cdf97(a, 3), 3, inverse=True), x)
    assert np.allclose(recon._haar(recon._haar(x), inverse=True), x) and np.isclose(np.linalg.norm(recon._haar(x)), np.linalg.norm(x))


def test_reconstructions_over_two_slices(spark):
    image, s = phantom()
    y = np.stack([k_space(image, s), k_space(2 * image, s)], -1)
    y[1::2] = 0
    y = y.reshape(32, 32, 1, 4, *(1,) * 9, 2)
    k, sens = ArrayFrame.from_numpy(spark, y), ArrayFrame.from_numpy(spark, s)
    got = recon.pics(k, sens, "l2", 1e-4, 60).to_numpy()
    assert error(got[..., 0], image) < 0.05 and error(got[..., 1], 2 * image) < 0.05
    one = ArrayFrame.from_numpy(spark, y[..., 0])
    for kind, level in (("tv", 1e-3), ("wavelet", 1e-3)):
        assert error(recon.pics(one, sens, kind, level, 60).to_numpy(), image) < 0.1, kind
    filled = recon.pocsense(one, sens, 100).to_numpy()
    assert error(filled, k_space(image, s)) < 0.15


def test_calibration(spark):
    image, s = phantom()
    k = ArrayFrame.from_numpy(spark, k_space(image, s))
    inside = np.abs(image[..., 0]) > 0
    relative = s * np.exp(-1j * np.angle(s[..., :1]))
    maps = recon.ecalib(k, 16, 4, 0.01, 0.5).to_numpy()
    assert np.abs(maps - relative)[inside].mean() < 0.1
    maps = recon.caldir(k, 16).to_numpy()
    assert np.abs((maps * s.conj()).sum(-1))[inside].mean() > 0.95
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(24, 24, 1, 4)) + 1j * rng.normal(size=(24, 24, 1, 4))
    assert 1.6 < recon.estvar(ArrayFrame.from_numpy(spark, noise)) < 2.4
    a, b = rng.normal(size=(10, 10, 1, 3)), rng.normal(size=(10, 10, 1, 3))
    a[..., 1] *= 10
    m = recon.rovir(ArrayFrame.from_numpy(spark, a), ArrayFrame.from_numpy(spark, b))
    assert np.allclose(m @ m.conj().T, np.eye(3), atol=1e-8) and abs(m[0, 1]) > 0.9


def test_denoising_completion_and_partial_fourier(spark):
    rng = np.random.default_rng(3)
    image, _ = phantom()
    noisy = image[..., 0, 0] + 0.2 * rng.normal(size=(32, 32))
    a = ArrayFrame.from_numpy(spark, noisy)
    for b in (recon.denoise(a, "tv", 0.2, 3), recon.tgv(a, 0.2, 3)):
        assert error(b.to_numpy(), image) < 0.7 * error(noisy, image)
    low = rng.normal(size=(20, 2)) @ rng.normal(size=(2, 20))
    holes = np.where(rng.random((20, 20)) < 0.7, low, 0)
    assert error(recon.lrmatrix(ArrayFrame.from_numpy(spark, holes), 1, 2, 0.01, 300).to_numpy(), low) < 0.15
    k = recon._f(image[..., 0, 0], (0, 1))
    k[20:] = 0
    got = recon.homodyne(ArrayFrame.from_numpy(spark, k), 0, 20 / 32).to_numpy()
    assert error(got, image) < error(recon._f(k, (0, 1), inverse=True), image)


def test_shift(spark):
    rng = np.random.default_rng(4)
    x = np.convolve(rng.normal(size=64), np.ones(5), "same")
    got = recon.estshift(vec(spark, *x), vec(spark, *np.roll(x, 3)), 1)[0]
    assert abs(abs(got) - 3) < 1e-6


def test_voxel_fits(spark):
    t = np.arange(1, 9) * 5.0
    r, d = np.linspace(1, 3, 12).reshape(3, 4), np.linspace(0.01, 0.1, 12).reshape(3, 4)
    y = (r[..., None] * np.exp(-d[..., None] * t)).reshape(3, 4, 1, 1, 1, 8)
    got = recon.mobafit(ArrayFrame.from_numpy(spark, y), t).to_numpy().reshape(3, 4, 2)
    assert np.allclose(got[..., 0], r, atol=1e-6) and np.allclose(got[..., 1], d, atol=1e-6)
    r1 = np.linspace(0.5, 2, 12).reshape(3, 4)
    t = np.linspace(0.05, 5, 20)
    y = (1.0 - 2.0 * np.exp(-r1[..., None] * t)).reshape(3, 4, 1, 1, 1, 20)
    got = recon.mobafit(ArrayFrame.from_numpy(spark, y), t, "ir", iterations=60).to_numpy().reshape(3, 4, 3)
    assert np.allclose(got[..., 2], r1, atol=1e-4)


def test_echo_train(spark):
    p = spark.createDataFrame([(1, 1.0, 0.1), (2, 0.8, 0.05)], "id long, t1 double, t2 double")
    got = {(r.id, r.echo): r.signal for r in recon.epg(p, 4, 0.01).collect()}
    assert all(np.isclose(got[1, e], math.exp(-(e + 1) * 0.1)) and np.isclose(got[2, e], math.exp(-(e + 1) * 0.2)) for e in range(4))
    first = [r.signal for r in recon.epg(p, 1, 0.01, 120).orderBy("id").collect()]
    assert np.isclose(first[0], math.sin(math.radians(60)) ** 2 * math.exp(-0.1))


def test_poisson_keeps_its_distance(spark):
    m = recon.poisson(spark, 30, 30, 3.0).to_numpy()[0]
    at = np.argwhere(m.real > 0)
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1)) + 100 * np.eye(len(at))
    assert len(at) > 50 and d.min() >= 3


def test_models(spark):
    p = models.gmm(vec(spark, 0.1 + 0.2j, 3), [0.5, 0.5], [0, 3], [1, 2]).to_numpy()
    want = [sum(0.5 / (math.pi * v) * math.exp(-abs(z - m) ** 2 / v) for m, v in ((0, 1), (3, 2))) for z in (0.1 + 0.2j, 3)]
    assert np.allclose(p, want)
    s = models.gmm(vec(spark, 1 + 1j), [1.0], [0], [2], score=True).to_numpy()
    assert np.allclose(s, -(1 + 1j))
    draws = models.gmm_sample(spark, 20000, [1.0], [0.1 + 0.2j], [4.0]).to_numpy()
    assert abs(draws.mean() - (0.1 + 0.2j)) < 0.05 and abs((np.abs(draws - draws.mean()) ** 2).mean() - 4) < 0.2
    blinker = np.zeros((5, 5))
    blinker[2, 1:4] = 1
    a = ArrayFrame.from_numpy(spark, blinker)
    near(models.conway(a), blinker.T)
    near(models.conway(a, 2, periodic=True), blinker)
    mask = models.pol2mask(spark, [(1.5, 1.5), (6.5, 1.5), (6.5, 4.5), (1.5, 4.5)], 9, 7).to_numpy()
    want = np.zeros((9, 7))
    want[2:7, 2:5] = 1
    assert np.array_equal(np.abs(mask), want)
    m = models.mandelbrot(spark, 32, 20).to_numpy().real
    assert m.max() == 20 and m.min() < 3
    q = models.pulse(spark, "sinc", 100, 0.002, 1.5).to_numpy()
    assert np.isclose(q.real.sum() * 0.002 / 100, 1.5)
    raw = [r.sample for r in models.toraw(vec(spark, -2, 0, 1)).orderBy("lin").collect()]
    assert raw == [0, 128, 255]


def test_interpolation_and_trajectories(spark):
    a = ArrayFrame.from_numpy(spark, np.arange(12.0).reshape(3, 4))
    pts = spark.createDataFrame([(0, 0.5, 1.25), (1, 2.0, 3.0), (2, 9.0, 9.0)], "id int, x0 double, x1 double")
    assert [r.re for r in models.interpolate(a, pts).orderBy("id").collect()] == [3.25, 11.0, 0.0]
    assert [r.re for r in models.interpolate(a, pts, 0).orderBy("id").collect()] == [5.0, 11.0, 0.0]
    t = np.zeros((3, 9, 1))
    t[0, :, 0] = np.arange(9) - 4
    traj = ArrayFrame.from_numpy(spark, t)
    assert models.estdims(traj) == [8, 1, 1]
    moved = models.trajcor(traj.densify(), sx=0.5).to_numpy().reshape(3, 9)
    assert np.allclose(moved[0], t[0, :, 0] + 0.5) and np.allclose(moved[1:], 0)
    t = np.stack(np.meshgrid(np.arange(8) - 4, np.arange(8) - 4, [0.0], indexing="ij")).reshape(3, 8, 8)
    spread = models.psf(ArrayFrame.from_numpy(spark, t).densify(), 8, 8).to_numpy()
    want = np.zeros((8, 8))
    want[4, 4] = 8
    assert np.allclose(spread, want, atol=1e-9)


def test_harmonics_are_removed(spark):
    angle = np.linspace(0, 20, 60)
    shape = (1,) * 10 + (60,)
    y = 0.3 * np.cos(angle) - 2 * np.sin(3 * angle)
    left = models.rmfreq(ArrayFrame.from_numpy(spark, y.reshape(shape)), ArrayFrame.from_numpy(spark, angle.reshape(shape)))
    assert np.abs(left.to_numpy()).max() < 1e-8
