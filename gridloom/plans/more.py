"""Further queries, each with its SQL: transforms, models, bins, linear operators and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions import complex as C
from ..operators import contract, elementwise, generate, index, kernels, linops, models, nlops, prox, reduce, signals, window
from ..streaming import slices
from . import views as V
from .catalog import CU, EM, EV, EZ, PG, D, U, cells, query, unit

#: cosh and sinh of the imaginary part, for the complex functions.
_CH, _SH = "(exp(im) + exp(-im)) / 2", "(exp(im) - exp(-im)) / 2"
_CX, _SX = "(exp(re) + exp(-re)) / 2", "(exp(re) - exp(-re)) / 2"
_ABS, _ARG = "sqrt(re * re + im * im)", "atan2(im, re)"
_FORMS = {
    "zabs": (_ABS, "0"), "zarg": (_ARG, "0"), "zconj": ("re", "-im"), "zreal": ("re", "0"), "zimag": ("im", "0"),
    "zacosr": ("acos(re)", "0"), "zatanr": ("atan(re)", "0"), "zexp": ("exp(re) * cos(im)", "exp(re) * sin(im)"), "zlog": (f"ln({_ABS})", _ARG),
    "zcos": (f"cos(re) * {_CH}", f"-sin(re) * {_SH}"), "zsin": (f"sin(re) * {_CH}", f"cos(re) * {_SH}"),
    "zcosh": (f"cos(im) * {_CX}", f"sin(im) * {_SX}"), "zsinh": (f"cos(im) * {_SX}", f"sin(im) * {_CX}"),
    "zphsr": (f"re / {_ABS}", f"im / {_ABS}"), "zsqrt": (f"sqrt({_ABS}) * cos({_ARG} / 2)", f"sqrt({_ABS}) * sin({_ARG} / 2)"),
    "zround": ("sign(re) * floor(abs(re) + 0.5)", "sign(im) * floor(abs(im) + 0.5)"),
}


@query(EZ + " UNION ALL ".join(f"SELECT '{k}' AS name, {U(f'sum({a})')} AS re, {U(f'sum({b})')} AS im FROM z WHERE re <> 0 OR im <> 0" for k, (a, b) in _FORMS.items()))
def calc_functions(spark, sf_dir):
    z, out = V.pairs(spark, sf_dir).sparsify(), None
    for name in _FORMS:
        a = z.with_values(*C.FUNCTIONS[name]((D("re"), D("im")))) if name in C.NEEDS_ALL else elementwise.calc(z, name)
        part = a.df.agg(F.sum("re").alias("re"), F.sum("im").alias("im")).select(F.lit(name).alias("name"), unit("re").alias("re"), unit("im").alias("im"))
        out = part if out is None else out.union(part)
    return out


@query(EZ + f"SELECT z.d1, CAST(k AS INTEGER) AS d0, {U('sum(re * cos(2 * pi() * k * d0 / 32) + im * sin(2 * pi() * k * d0 / 32)) / sqrt(32)')} AS re, {U('sum(im * cos(2 * pi() * k * d0 / 32) - re * sin(2 * pi() * k * d0 / 32)) / sqrt(32)')} AS im FROM z, range(32) t(k) GROUP BY 1, 2")
def fft_lines(spark, sf_dir):
    return cells(kernels.fft(V.pairs(spark, sf_dir), 1, unitary=True, centred=False), 4, im=True)


@query(EZ + f"SELECT z.d1, CAST(k AS INTEGER) AS d0, {U('sum(re * cos(2 * pi() * (k - 16) * (d0 - 16) / 32) - im * sin(2 * pi() * (k - 16) * (d0 - 16) / 32))')} AS re, {U('sum(im * cos(2 * pi() * (k - 16) * (d0 - 16) / 32) + re * sin(2 * pi() * (k - 16) * (d0 - 16) / 32))')} AS im FROM z, range(32) t(k) GROUP BY 1, 2")
def fft_inverse_centred(spark, sf_dir):
    return cells(kernels.fft(V.pairs(spark, sf_dir), 1, inverse=True), 4, im=True)


@query(EZ + f"SELECT d0, d1, {U('re * cos(pi() * (d0 - 8)) - im * sin(pi() * (d0 - 8))')} AS re, {U('re * sin(pi() * (d0 - 8)) + im * cos(pi() * (d0 - 8))')} AS im FROM z")
def fftmod_phase(spark, sf_dir):
    return cells(elementwise.fftmod(V.pairs(spark, sf_dir), 1), 4, im=True)


@query(PG + f"SELECT (d0 + 25) % 50 AS d0, {U('x', 2)} AS re FROM p")
def fftshift_index(spark, sf_dir):
    return cells(index.fftshift(V.part_grid(spark, sf_dir), 1), 2)


@query(PG + f"SELECT d0 - 10 AS d0, {U('x', 2)} AS re FROM p WHERE d0 BETWEEN 10 AND 39")
def crop_centre(spark, sf_dir):
    return cells(index.crop(V.part_grid(spark, sf_dir), 0, 30), 2)


@query("SELECT CAST(i AS INTEGER) AS d0, CAST(i AS INTEGER) AS d1, CAST(1 AS BIGINT) AS re FROM range(40) t(i)")
def delta_diagonal(spark, sf_dir):
    return cells(generate.delta(spark, 2, 3, 40), 0)


@query(EZ + f"SELECT d0, d1, {U('re')} AS re, {U('-im')} AS im FROM z")
def conj_values(spark, sf_dir):
    return cells(elementwise.conj(V.pairs(spark, sf_dir)), 4, im=True)


@query(EZ + f"SELECT d0, d1, {U('re')} AS re FROM z")
def creal_values(spark, sf_dir):
    return cells(elementwise.creal(V.pairs(spark, sf_dir)))


@query(EM + f"SELECT CAST(d1 AS INTEGER) AS d0, d0 AS d2, {U('x', 6)} AS re FROM m")
def permute_dims(spark, sf_dir):
    return cells(index.permute(V.embeddings(spark, sf_dir), [1, 2, 0]), 6)


@query(PG + f"SELECT CAST(i AS INTEGER) AS d0, {U('x', 2)} AS re FROM range(57) t(i) JOIN p ON p.d0 = CASE WHEN i < 4 THEN 3 - i WHEN i > 53 THEN 49 - (i - 54) ELSE i - 4 END")
def pad_symmetric(spark, sf_dir):
    return cells(index.pad(V.part_grid(spark, sf_dir), 0, 4, 3, "symmetric"), 2)


@query(PG + f"SELECT CAST(i AS INTEGER) AS d0, {U('x', 2)} AS re FROM range(57) t(i) JOIN p ON p.d0 = CASE WHEN i < 4 THEN 4 - i WHEN i > 53 THEN 48 - (i - 54) ELSE i - 4 END")
def pad_reflect(spark, sf_dir):
    return cells(index.pad(V.part_grid(spark, sf_dir), 0, 4, 3, "reflect"), 2)


@query(PG + f"SELECT CAST((d0 % 5) * 10 + d0 // 5 AS INTEGER) AS d0, {U('x', 2)} AS re FROM p")
def shuffle_index(spark, sf_dir):
    return cells(index.shuffle_blocks(V.part_grid(spark, sf_dir), 0, 5), 2)


@query(PG + f"SELECT CAST(d0 // 2 AS INTEGER) AS d0, CAST(d0 % 2 AS INTEGER) AS d3, {U('x', 2)} AS re FROM p")
def decompose_index(spark, sf_dir):
    return cells(index.decompose(V.part_grid(spark, sf_dir), 0, 2, 3), 2)


@query(CU + "SELECT CAST(d0 // 32 AS BIGINT) AS word, CAST(bit_or(CAST(1 AS BIGINT) << (d0 % 32)) AS BIGINT) AS bits FROM c WHERE x > 0 GROUP BY 1")
def mask_words(spark, sf_dir):
    a = V.customers(spark, sf_dir)
    return index.mask_compress(a.with_values((D("re") > 0).cast("double"), F.lit(0.0)))


@query(CU + f"SELECT d0, {U('CASE WHEN d0 BETWEEN 30 AND 79 THEN p.x ELSE c.x END', 2)} AS re FROM c LEFT JOIN (SELECT CAST(p_size - 1 AS INTEGER) AS i, avg(p_retailprice) AS x FROM part GROUP BY 1) p ON p.i = c.d0 - 30")
def copy_block(spark, sf_dir):
    return cells(index.copy_into(V.customers(spark, sf_dir), V.part_grid(spark, sf_dir), d0=30), 2)


@query(EV + ", s AS (SELECT *, x - coalesce(lag(x) OVER (PARTITION BY d1 ORDER BY d0), x) AS step FROM g), t AS (SELECT *, CASE WHEN step > 0 THEN -floor(step / 50 + 0.5) ELSE -ceil(step / 50 - 0.5) END AS n FROM s) " + f"SELECT d0, d1, {U('x + 50 * sum(n) OVER (PARTITION BY d1 ORDER BY d0)', 2)} AS re FROM t")
def unwrap_steps(spark, sf_dir):
    return cells(window.unwrap(V.events(spark, sf_dir), 0, 50.0), 2)


@query(CU + f"SELECT d0, {U('0.3 / (pi() * 250000) * exp(-power(x - 1000, 2) / 250000) + 0.7 / (pi() * 4000000) * exp(-(x * x + 1) / 4000000)', 12)} AS re FROM c")
def gmm_density(spark, sf_dir):
    return cells(models.gmm(V.customers(spark, sf_dir), [0.3, 0.7], [1000, 1j], [250000.0, 4000000.0]), 12)


@query(EM + ", n AS (SELECT max(d1) AS top FROM m), l AS (SELECT d0, d1 FROM m WHERE x > 0), s AS (SELECT l.d0 + i - 1 AS d0, l.d1 + j - 1 AS d1, CAST(i = 1 AND j = 1 AS INTEGER) AS own FROM l, range(3) a(i), range(3) b(j)), k AS (SELECT d0, d1, sum(own) AS own, sum(1 - own) AS n FROM s, n WHERE d0 BETWEEN 0 AND 63 AND d1 BETWEEN 0 AND top GROUP BY 1, 2) SELECT CAST(d0 AS INTEGER) AS d0, CAST(d1 AS INTEGER) AS d1, CAST(1 AS BIGINT) AS re FROM k WHERE n = 3 OR (own = 1 AND n = 2)")
def conway_step(spark, sf_dir):
    a = V.embeddings(spark, sf_dir)
    return cells(models.conway(a.with_values((D("re") > 0).cast("double"), F.lit(0.0))), 0)


@query("WITH v(k, x, y) AS (VALUES (0, 2.5, 3.5), (1, 15.5, 4.5), (2, 9.5, 17.5)), e AS (SELECT a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM v a JOIN v b ON b.k = (a.k + 1) % 3) SELECT CAST(i AS INTEGER) AS d0, CAST(j AS INTEGER) AS d1, CAST(round(sum(atan2((ax - i) * (qy - j) - (ay - j) * (qx - i), (ax - i) * (qx - i) + (ay - j) * (qy - j))) / (2 * pi())) AS BIGINT) AS re FROM range(20) s(i), range(20) t(j), e GROUP BY 1, 2")
def polygon_mask(spark, sf_dir):
    return cells(models.pol2mask(spark, [(2.5, 3.5), (15.5, 4.5), (9.5, 17.5)], 20, 20), 0)


@query(PG + f"SELECT CAST(i AS INTEGER) AS id, {U('coalesce(a.x, 0) * (1 - (i * 1.3 - floor(i * 1.3))) + coalesce(b.x, 0) * (i * 1.3 - floor(i * 1.3))', 5)} AS re FROM range(40) t(i) LEFT JOIN p a ON a.d0 = floor(i * 1.3) LEFT JOIN p b ON b.d0 = floor(i * 1.3) + 1")
def interpolate_linear(spark, sf_dir):
    points = spark.range(40).select(D("id").cast("int").alias("id"), (D("id") * 1.3).alias("x0"))
    return models.interpolate(V.part_grid(spark, sf_dir), points).select("id", unit("re", 5).alias("re"))


@query("SELECT CAST(2 * ceil(max(abs(i + 0.5 - 32))) AS BIGINT) AS x, CAST(2 * ceil(max(abs((i + 0.5 - 32) * sin(p * pi() / 5)))) AS BIGINT) AS y FROM range(64) s(i), range(5) t(p)")
def estimated_sizes(spark, sf_dir):
    x, y, _ = models.estdims(generate.traj(spark, 64, 5, radial=True))
    return spark.range(1).select(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"))


@query(f"SELECT CAST(s AS INTEGER) AS d1, CAST(p AS INTEGER) AS d2, {U('(s + 0.5 - 16) * cos(p * pi() / ((sqrt(5) + 1) / 2))')} AS x, {U('(s + 0.5 - 16) * sin(p * pi() / ((sqrt(5) + 1) / 2))')} AS y FROM range(32) a(s), range(13) b(p)")
def traj_golden(spark, sf_dir):
    a = generate.traj(spark, 32, 13, radial=True, golden=True)
    pick = lambda k: F.max(F.when(D("d0") == k, D("re")))
    return a.df.groupBy("d1", "d2").agg(pick(0).alias("x"), pick(1).alias("y")).select("d1", "d2", unit("x").alias("x"), unit("y").alias("y"))


@query("SELECT CAST(i AS INTEGER) AS d2, CAST((i * 233) % 377 AS BIGINT) AS re FROM range(377) t(i)")
def raga_order(spark, sf_dir):
    return cells(generate.raga(spark, 377, 233), 0)


@query(CU + f"SELECT d0, {U('CASE WHEN abs(x) / 5000 < 0.2 THEN 0 ELSE 2.0 / (abs(x) / 5000 * 1.5) + 0.06 END')} AS re FROM c WHERE x <> 0")
def looklocker_map(spark, sf_dir):
    a = V.customers(spark, sf_dir).sparsify()
    parts = a.df.select("d0", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in enumerate((F.abs("re") / 5000, F.lit(2.0), F.lit(1.5)))))).alias("p"))
    coefficients = ArrayFrame.of(parts.select("d0", D("p.k").alias("d6"), D("p.v").alias("re"), F.lit(0.0).alias("im")), a.replace_dims(d6=3))
    return cells(elementwise.looklocker(coefficients, delay=0.03))


@query(PG + f"SELECT d0, {U('x * cos(2 * pi() * 3.25 * (d0 - 25) / 50)', 2)} AS re, {U('x * sin(2 * pi() * 3.25 * (d0 - 25) / 50)', 2)} AS im FROM p")
def fovshift_phase(spark, sf_dir):
    return cells(elementwise.fovshift(V.part_grid(spark, sf_dir), d0=3.25), 2, im=True)


@query(EM + f"SELECT d0, d1, {U('x - avg(x) OVER w - (d0 - 31.5) * regr_slope(x, d0) OVER w', 6)} AS re FROM m WINDOW w AS (PARTITION BY d1)")
def detrend_lines(spark, sf_dir):
    return cells(window.detrend(V.embeddings(spark, sf_dir), 0), 6)


@query(EZ + "SELECT d0, d1, CAST(least(floor((CASE WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END) * 6 / (2 * pi())), 5) AS BIGINT) AS re FROM z")
def bins_of_angles(spark, sf_dir):
    z = V.pairs(spark, sf_dir)
    two = index.join(2, elementwise.creal(z), z.with_values(D("im"), F.lit(0.0)))
    return cells(window.quadrature_bins(two, 0, 2, 6), 0)


@query(EM + "SELECT d0, d1, CAST((row_number() OVER (PARTITION BY d1 ORDER BY x, d0) - 1) * 5 // 64 AS BIGINT) AS re FROM m")
def bins_of_amplitudes(spark, sf_dir):
    return cells(window.amplitude_bins(V.embeddings(spark, sf_dir), 0, 5), 0)


@query(EM + f"SELECT d1, {U('quantile_cont(abs(x), 0.9)', 6)} AS re FROM m GROUP BY d1")
def percentile_lines(spark, sf_dir):
    return cells(reduce.percentile(V.embeddings(spark, sf_dir), 1, 0.9), 6)


@query(EM + f"SELECT d1, CAST(d0 AS INTEGER) AS d0, {U('lead(x, 1, first) OVER (PARTITION BY d1 ORDER BY d0) - x', 6)} AS re FROM (SELECT *, first_value(x) OVER (PARTITION BY d1 ORDER BY d0) AS first FROM m)")
def gradient_lines(spark, sf_dir):
    return cells(window.gradient(V.embeddings(spark, sf_dir), 1, 2), 6)


@query(EM + f", l AS (SELECT vec_id, label FROM embeddings) SELECT CAST(label AS INTEGER) AS label, {U('sum(d1 * (1 + abs(x))) / sum(1 + abs(x))', 3)} AS place, count(*) AS n FROM m JOIN l ON l.vec_id = m.d1 WHERE d0 = 0 AND label <> 0 GROUP BY 1")
def centres_of_labels(spark, sf_dir):
    t = V.table(spark, sf_dir, "embeddings").select("vec_id", D("label").cast("double").alias("re"))
    labels = V.as_array(t, d0="vec_id")
    w = index.slice_(V.embeddings(spark, sf_dir), d0=0)
    w = index.permute(w, [1, 0])
    c = reduce.centre_of_mass(labels, w.with_values(1 + F.abs("re"), F.lit(0.0)))
    return c.select(D("label").cast("int").alias("label"), unit("d0", 3).alias("place"), "n")


@query("SELECT " + U("avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)", 6) + " AS accuracy, " + U("2.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 1) / (count(*) FILTER (WHERE quality = 1) + count(*) FILTER (WHERE toxic = 1))", 6) + " AS dice FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def label_scores(spark, sf_dir):
    t = V.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", D("quality").cast("double").alias("a"), D("toxic").cast("double").alias("b"))
    a, b = (V.as_array(t.select("doc_id", D(c).alias("re")), d0="doc_id") for c in "ab")
    return spark.range(1).select(unit(F.lit(reduce.accuracy(a, b)), 6).alias("accuracy"), unit(F.lit(reduce.dice(a, b)), 6).alias("dice"))


@query(EM + ", h AS (SELECT least(floor(abs(a.x) * 8), 7) AS i, least(floor(abs(b.x) * 8), 7) AS j, count(*) AS n FROM m a JOIN m b ON a.d1 = b.d1 AND a.d0 = 0 AND b.d0 = 1 GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM h), l AS (SELECT i, sum(n) AS n FROM h GROUP BY 1), r AS (SELECT j, sum(n) AS n FROM h GROUP BY 1) SELECT " + U("sum(h.n / t.n * ln(h.n * t.n / (l.n * r.n)))", 6) + " AS mi FROM h JOIN l USING (i) JOIN r USING (j), t")
def mutual_information(spark, sf_dir):
    a = V.embeddings(spark, sf_dir)
    x, y = index.slice_(a, d0=0), index.slice_(a, d0=1)
    rows = V.table(spark, sf_dir, "embeddings").count()
    # only as many places as there are vectors are compared
    x, y = (ArrayFrame(v.df, v.replace_dims(d1=rows)) for v in (x, y))
    return spark.range(1).select(unit(F.lit(reduce.mutual_information(x, y, 8)), 6).alias("mi"))


@query(EM + f"SELECT d1, CAST(k AS INTEGER) AS d0, {U('sum(CASE WHEN bit_count(CAST(k AS INTEGER) & d0) % 2 = 0 THEN x ELSE -x END) / 8', 6)} AS re FROM m, range(64) t(k) GROUP BY 1, 2")
def hadamard_lines(spark, sf_dir):
    a = V.embeddings(spark, sf_dir)
    return cells(linops.hadamard(a.dims, 0)(a), 6)


@query(EM + f"SELECT d1, CAST(d0 // 2 AS INTEGER) AS d0, {U('sum(CASE WHEN d0 % 2 = 0 THEN x ELSE -x END)', 6)} AS re FROM m GROUP BY 1, 2")
def asl_pairs(spark, sf_dir):
    a = V.embeddings(spark, sf_dir)
    return cells(linops.asl(a.dims, 0)(a), 6)


@query(PG + f"SELECT d0, {U('x * (least(d0, 4) - greatest(0, d0 - 45) + 1)', 2)} AS re FROM p")
def hankel_normal(spark, sf_dir):
    a = V.part_grid(spark, sf_dir)
    return cells(linops.hankelization(a.dims, 0, 5, 1).normal(a), 2)


@query(EM + f"SELECT d0, d1, {U('x - avg(x) OVER (PARTITION BY d1)', 6)} AS re FROM m")
def prox_mean_free(spark, sf_dir):
    return cells(prox.mean_free(V.embeddings(spark, sf_dir), 1), 6)


@query(EM + f"SELECT d0, d1, {U('x * least(1, 0.8 / sqrt(sum(x * x) OVER (PARTITION BY d1)))', 6)} AS re FROM m")
def prox_ball(spark, sf_dir):
    return cells(prox.l2_ball(V.embeddings(spark, sf_dir), 0.8, flags=1), 6)


@query(CU + f"SELECT d0, {U('greatest(-500, least(500, x))', 2)} AS re FROM c")
def prox_box(spark, sf_dir):
    return cells(prox.less_equal(prox.greater_equal(V.customers(spark, sf_dir), -500.0), 500.0), 2)


@query(EM + f"SELECT d1, {U('sum(2 * x * cos(d0))', 6)} AS re FROM m GROUP BY d1")
def derivative_of_squares(spark, sf_dir):
    a = V.embeddings(spark, sf_dir)
    return cells(nlops.ss(a.dims, 1).derivative(a)(a.with_values(F.cos("d0"), F.lit(0.0))), 6)


@query(EM + f"SELECT d1, CAST(d0 // 2 AS INTEGER) AS d0, {U('sum(x) / sqrt(2)', 6)} AS re FROM m GROUP BY 1, 2 UNION ALL SELECT d1, CAST(32 + d0 // 2 AS INTEGER), {U('sum(CASE WHEN d0 % 2 = 0 THEN x ELSE -x END) / sqrt(2)', 6)} FROM m GROUP BY 1, 2")
def wavelet_haar(spark, sf_dir):
    return cells(kernels.wavelet(V.embeddings(spark, sf_dir), 1, kind="haar", coarsest=32), 6)


@query(EM + f"SELECT d1, CAST(o AS INTEGER) AS d0, {U('sum(x * cos(o + d0))', 6)} AS re FROM m, range(4) t(o) GROUP BY 1, 2")
def matrix_apply(spark, sf_dir):
    m = np.cos(np.arange(4)[:, None] + np.arange(64)[None])
    return cells(contract.apply_matrix(V.embeddings(spark, sf_dir), m, 0), 6)


@query(PG + f"SELECT CAST(i AS INTEGER) AS d1, {U('sum(x * cos(2 * pi() * (i * 1.7 - 8) * (d0 - 25) / 50)) / sqrt(50)', 2)} AS re, {U('-sum(x * sin(2 * pi() * (i * 1.7 - 8) * (d0 - 25) / 50)) / sqrt(50)', 2)} AS im FROM p, range(10) t(i) GROUP BY 1")
def nudft_samples(spark, sf_dir):
    traj = generate.from_index(spark, [3, 10], F.when(D("d0") == 0, D("d1") * 1.7 - 8).otherwise(0.0))
    return cells(kernels.nudft(traj, V.part_grid(spark, sf_dir)), 2, im=True)


@query(CU + f", s AS (SELECT d0, d0 - row_number() OVER (ORDER BY d0) AS island FROM c WHERE x > 0), f AS (SELECT island, row_number() OVER (ORDER BY min(d0)) AS n FROM s GROUP BY 1) SELECT d0, CAST(n AS BIGINT) AS re FROM s JOIN f USING (island)")
def label_runs(spark, sf_dir):
    a = V.customers(spark, sf_dir)
    return cells(window.label(a.with_values((D("re") > 0).cast("double"), F.lit(0.0)), 1), 0)


@query("WITH o AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range(30) s(i), range(30) t(j) WHERE (i * 7 + j * 11) % 41 = 0), b AS (SELECT CAST(a - 2 AS INTEGER) AS a, CAST(c - 2 AS INTEGER) AS c FROM range(5) s(a), range(5) t(c) WHERE (a - 2) * (a - 2) + (c - 2) * (c - 2) <= 4) SELECT DISTINCT CAST((i + a + 30) % 30 AS INTEGER) AS d0, CAST((j + c + 30) % 30 AS INTEGER) AS d1, CAST(1 AS BIGINT) AS re FROM o, b")
def dilate_ball(spark, sf_dir):
    a = generate.from_index(spark, [30, 30], ((D("d0") * 7 + D("d1") * 11) % 41 == 0).cast("double"))
    return cells(window.morph_ball(a, 3, size=5), 0)


def _tissues(form: str, n: int, p: int = 6) -> str:
    return f"SELECT CAST(i AS INTEGER) AS d5, CAST(k AS INTEGER) AS d6, {U(form, p)} AS re FROM range({n}) s(i), (VALUES (0, 0.8, 0.1), (1, 1.4, 0.05)) t(k, t1, t2)"


@query(_tissues("exp(-i * 0.01 / t2)", 20))
def signal_tse(spark, sf_dir):
    return cells(signals.tse(spark, 20, [0.1, 0.05]), 6)


@query(_tissues("(1 - 2 * exp(-(1000 - i * 0.01 / 2) / t1) + exp(-1000 / t1)) * exp(-i * 0.01 / t2)", 20))
def signal_se(spark, sf_dir):
    return cells(signals.se(spark, 20, [0.8, 1.4], [0.1, 0.05]), 6)


_R1S = "(1 / t1 - ln(cos(radians(8))) / 0.0041)"
_MSS = f"((1 - exp(-0.0041 / t1)) / (1 - exp(-0.0041 * {_R1S})))"


@query(_tissues(f"{_MSS} - ({_MSS} + 1) * exp(-i * 0.0041 * {_R1S})", 50))
def signal_look_locker(spark, sf_dir):
    return cells(signals.look_locker(spark, 50, [0.8, 1.4]), 6)


_SS = "(sin(pi() / 4) / ((t1 / t2 + 1) - cos(pi() / 4) * (t1 / t2 - 1)))"


@query(_tissues(f"{_SS} - ({_SS} + sin(pi() / 8)) * exp(-i * 0.0045 * (power(cos(pi() / 8), 2) / t1 + power(sin(pi() / 8), 2) / t2))", 50))
def signal_ir_bssfp(spark, sf_dir):
    return cells(signals.ir_bssfp(spark, 50, [0.8, 1.4], [0.1, 0.05]), 6)


@query(_tissues("exp(-i * 0.0016 / t2) * cos(2 * pi() * 20 * i * 0.0016)", 16))
def signal_mgre(spark, sf_dir):
    return cells(signals.mgre(spark, 16, [0.1, 0.05]), 6)


@query(f"SELECT CAST(i AS INTEGER) AS d0, CAST(c AS INTEGER) AS d1, {U('CASE c WHEN 0 THEN exp(-i * 0.01 / 0.1) * cos(3 * i * 0.01) ELSE 1 - exp(-i * 0.01 / 0.8) END', 6)} AS re FROM range(40) s(i), range(2) t(c)")
def bloch_relaxation(spark, sf_dir):
    return cells(models.bloch(spark, 40, 0.01, 0.8, 0.1, 3.0), 6)


@query(PG + ", s AS (SELECT greatest(least(x / 2000, 1), -1) AS v, d0 FROM p) SELECT CAST(d0 AS BIGINT) AS lin, CAST(floor((v + 1) / 2 * 255 + 0.5) AS BIGINT) AS sample FROM s")
def raw_samples(spark, sf_dir):
    return models.toraw(elementwise.scale(V.part_grid(spark, sf_dir), 1 / 2000))


@query(f"SELECT CAST(s AS INTEGER) AS d0, CAST(y AS INTEGER) AS d1, {U('cos(0.2 * cos(2 * pi() * 3 * s / 40) * (y - 8))')} AS re, {U('-sin(0.2 * cos(2 * pi() * 3 * s / 40) * (y - 8))')} AS im FROM range(40) a(s), range(16) b(y)")
def wave_phase(spark, sf_dir):
    return cells(models.wavepsf(spark, 40, 16, 0.2, 3), 4, im=True)


@query(CU + ", n AS (SELECT max(d0) + 1 AS n FROM c) SELECT " + U("sum(abs(x))", 2) + " AS l1, " + U("sqrt(sum(x * x))", 2) + " AS l2, " + U("max(abs(x))", 2) + " AS top FROM c")
def norms_of_customers(spark, sf_dir):
    s = reduce.norms(V.customers(spark, sf_dir))
    return spark.range(1).select(unit(F.lit(s["l1"]), 2).alias("l1"), unit(F.lit(s["l2"]), 2).alias("l2"), unit(F.lit(s["max"]), 2).alias("top"))


@query(CU + ", s AS (SELECT CAST(s_suppkey AS INTEGER) AS d0, s_acctbal AS y FROM supplier) SELECT CAST(i AS INTEGER) AS d0, CAST(coalesce(x, 0) < coalesce(y, 0) AS BIGINT) AS re FROM range((SELECT greatest((SELECT max(d0) FROM c), (SELECT max(d0) FROM s)) + 1)) t(i) LEFT JOIN c ON c.d0 = i LEFT JOIN s ON s.d0 = i")
def compare_less(spark, sf_dir):
    c = V.customers(spark, sf_dir)
    s = V.as_array(V.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("re")), d0="s_suppkey")
    n = max(c.dims[0], s.dims[0])
    return cells(elementwise.compare(index.resize(c, d0=n), index.resize(s, d0=n), "zless"), 0)


@query("SELECT user_id, count(*) AS n, " + U("sum(value)", 2) + " AS total FROM events GROUP BY 1")
def stream_running_totals(spark, sf_dir):
    """A stream of the events, run until all are read."""
    path = f"{sf_dir}/events.parquet"
    stream = slices.read_slices(spark, path, spark.read.parquet(path).schema)
    return slices.collected(spark, slices.running_totals(stream, "user_id", "value")).select("user_id", "n", unit("total", 2).alias("total"))


