import numpy as np
import pytest
from gridloom.frame import ArrayFrame, bitmask, flag_dims
from gridloom.operators import contract, elementwise, generate, index, reduce, window
from gridloom.registry import OPERATORS, run


def vec(spark, *values):
    return ArrayFrame.from_numpy(spark, np.array(values, complex))


def near(a, want):
    np.testing.assert_allclose(a.to_numpy().ravel(order="F"), np.asarray(want, complex).ravel(order="F"), atol=1e-9)


@pytest.fixture(scope="session")
def cube(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 5, 3)) + 1j * rng.normal(size=(4, 5, 3))
    return ArrayFrame.from_numpy(spark, x), x


def test_bitmasks():
    assert bitmask(0, 3) == 9 and flag_dims(9) == [0, 3]


def test_index_operators(spark, cube):
    a, x = cube
    near(index.flip(a, 0b11), x[::-1, ::-1])
    near(index.circshift(a, 1, 2), np.roll(x, 2, 1))
    near(index.transpose(a, 0, 2), x.swapaxes(0, 2))
    near(index.extract(a, 1, 1, 4), x[:, 1:4])
    near(index.slice_(a, d2=1), x[:, :, 1])
    near(index.flatten(a), x.ravel(order="F"))
    near(index.reshape(a, 0b11, [2, 10]), x.reshape(2, 10, 3, order="F"))
    near(index.repmat(index.slice_(a, d2=0), 2, 3), np.repeat(x[:, :, :1], 3, 2))
    near(index.join(1, a, a), np.concatenate([x, x], 1))
    near(index.resize(vec(spark, 1, 2, 3), "centre", d0=5), [0, 1, 2, 3, 0])
    near(index.resize(vec(spark, 1, 2, 3, 4), "centre", d0=2), [2, 3])
    near(index.circshift(vec(spark, 1, 2, 3, 4), 0, 1), [4, 1, 2, 3])
    near(index.crop(vec(spark, 1, 2, 3, 4), 0, 2), [2, 3])
    with pytest.raises(ValueError):
        index.reshape(a, 0b11, [3, 3])


def test_compress_and_back(spark):
    data, mask = vec(spark, 10, 11, 12, 13), vec(spark, 1, 0, 0, 1)
    packed = index.compress(data, mask)
    near(packed, [10, 13])
    near(index.decompress(packed, mask), [10, 0, 0, 13])


def test_element_operators(spark, cube):
    a, x = cube
    near(elementwise.cabs(a), np.abs(x))
    near(elementwise.carg(a), np.angle(x))
    near(elementwise.conj(a), x.conj())
    near(elementwise.creal(a), x.real)
    near(elementwise.zexp(a), np.exp(x))
    near(elementwise.scale(a, 2 - 1j), x * (2 - 1j))
    near(elementwise.saxpy(2j, a, a), 2j * x + x)
    near(elementwise.cpyphs(vec(spark, 0, 2, -3j)), [1, 1, -1j])
    near(elementwise.invert(vec(spark, 0, 2)), [0, 0.5])
    near(elementwise.soft_threshold(vec(spark, 3, -0.5, 4j), 1), [2, 0, 3j])
    near(elementwise.hard_threshold(vec(spark, 1, 2, 3), 2), [0, 0, 3])
    near(elementwise.top_k_mask(vec(spark, 5, 1, 4, 3), 2, 1), [1, 0, 1, 0])
    near(elementwise.top_k_mask(vec(spark, 5, 4, 4, 1), 2, 1), [1, 0, 0, 0])
    near(elementwise.normalize(a, 1), x / np.sqrt((np.abs(x) ** 2).sum(0)))


def test_ordered_norms(spark, cube):
    a, x = cube
    for flags, axes in ((1, 0), (0b101, (0, 2)), (0b111, None), (0, ())):
        near(elementwise.normalize(a, flags, ordered=True), x / np.sqrt((np.abs(x) ** 2).sum(axes, keepdims=True)))
        near(elementwise.normalize(a, flags, l1=True, ordered=True), x / np.abs(x).sum(axes, keepdims=True))
    near(elementwise.normalize(vec(spark, 0, 0), 1, ordered=True), [0, 0])


def test_reductions(spark, cube):
    a, x = cube
    near(reduce.total(a, 0b101), x.sum((0, 2)))
    near(reduce.avg(a, 0b1), x.mean(0))
    near(reduce.avg(vec(spark, 0, 2, 4, 0), 1, nonzero=True), [3])
    near(reduce.var(vec(spark, 1, 2, 3, 4), 1), [5 / 3])
    near(reduce.rss(a, 0b10), np.sqrt((np.abs(x) ** 2).sum(1)))
    near(reduce.mip(vec(spark, -3, -1), 1), [0])
    near(reduce.pattern(vec(spark, 0, 3), 0), [0, 1])
    assert abs(reduce.sdot(vec(spark, 1j), vec(spark, 1j)) - 1) < 1e-12
    assert reduce.nrmse(a, a) < 1e-12 and reduce.nrmse(a, elementwise.scale(a, 3j), scaled=True) < 1e-7


def test_contraction(spark, cube):
    a, x = cube
    near(contract.fmac(a, a, squash=0b11, conj=True), (np.abs(x) ** 2).sum((0, 1)))
    m = np.arange(6.0).reshape(2, 3) + 1j
    near(contract.apply_matrix(a, m, 2), np.einsum("xyz,cz->xyc", x, m))


def test_windows(spark):
    near(window.forward_difference(vec(spark, 1, 4, 9, 16), 0), [-15, 3, 5, 7])
    near(window.forward_difference(vec(spark, 1, 4, 9, 16), 0, zero=True), [0, 3, 5, 7])
    near(window.backward_difference(vec(spark, 1, 4, 9, 16), 0), [-3, -5, -7, 15])
    near(window.backward_difference(vec(spark, 1, 4, 9, 16), 0, zero=True), [-3, -5, -7, 0])
    near(window.cumsum(vec(spark, 1, 2, 3, 4), 0), [1, 3, 6, 10])
    near(window.moving_average(vec(spark, 1, 1, 1, 1, 0, 0, 0, 0), 0, 4), [1, 0.75, 0.5, 0.25, 0])
    near(window.moving_median(vec(spark, 1, 3, 2, 10), 0, 4), [2.5])
    near(window.moving_median(vec(spark, -5, 1, 2), 0, 3), [2])


def test_generators(spark):
    near(generate.ones(spark, [2, 3]), np.ones((2, 3)))
    near(generate.zeros(spark, [2]), [0, 0])
    near(generate.index(spark, 0, 4), [0, 1, 2, 3])
    near(generate.poly(spark, 3, [1, 0, 2]), [1, 3, 9])
    a = generate.ones(spark, [50, 40])
    assert np.array_equal(generate.noise(a, 1.0, 3).to_numpy(), generate.noise(a, 1.0, 3).to_numpy())


def test_registry_runs_by_name(spark):
    near(run("scale", vec(spark, 1, 2), 3), [3, 6])
    assert len(OPERATORS) > 110
    with pytest.raises(ValueError):
        run("none")


def test_empty_and_sparse_arrays(spark):
    none = ArrayFrame.of(vec(spark, 1, 2).df.limit(0), [2])
    near(none.densify(), [0, 0])
    near(elementwise.scale(none, 2), [0, 0])
    assert reduce.total(none, 1).df.count() <= 1
