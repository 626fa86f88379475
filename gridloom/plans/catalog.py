"""Queries over the driver's tables, each with the SQL that gives the same rows.

Floating values are compared as whole multiples of a small unit (floor(x * 10^p + 0.5))."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..operators import contract, elementwise, generate, index, reduce, window
from ..streaming import slices
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

D = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def unit(c, p: int = 4):
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**p) + 0.5).cast("long")


def U(x: str, p: int = 4) -> str:
    return f"CAST(floor(({x}) * 1e{p} + 0.5) AS BIGINT)"


def cells(a: ArrayFrame, p: int = 4, im: bool = False, **names: str):
    """Rows of a real array (complex on request), index columns renamed."""
    cols = [D(k).alias(names.get(k, k)) for k in a.keys] + [unit("re", p).alias("re")] + ([unit("im", p).alias("im")] if im else [])
    return a.df.select(*cols)


LI = "WITH l AS (SELECT CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS d0, CAST(strpos('ANR', l_returnflag) - 1 AS INTEGER) AS d1, CAST(strpos('FO', l_linestatus) - 1 AS INTEGER) AS d2, CAST(l_orderkey AS INTEGER) AS d3, * FROM lineitem) "
ROWS = 0b1001  # the dimensions of lineitem beside flag and status
EV = "WITH e AS (SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS d0, CAST(user_id AS INTEGER) AS d1, value AS x FROM events), g AS (SELECT CAST(i AS INTEGER) AS d0, u.d1, coalesce(e.x, 0) AS x FROM range((SELECT max(d0) + 1 FROM e)) r(i) CROSS JOIN (SELECT CAST(v AS INTEGER) AS d1 FROM range((SELECT max(user_id) + 1 FROM events)) t(v)) u LEFT JOIN e ON e.d0 = r.i AND e.d1 = u.d1) "
EM = "WITH m AS (SELECT CAST(vec_id AS INTEGER) AS d1, CAST(unnest(range(len(embedding))) AS INTEGER) AS d0, unnest(embedding)::DOUBLE AS x FROM embeddings) "
EZ = "WITH z AS (SELECT CAST(vec_id AS INTEGER) AS d1, CAST(p AS INTEGER) AS d0, embedding[2 * p + 1]::DOUBLE AS re, embedding[2 * p + 2]::DOUBLE AS im FROM embeddings, range(32) t(p)) "
PG = "WITH p AS (SELECT CAST(p_size - 1 AS INTEGER) AS d0, avg(p_retailprice) AS x FROM part GROUP BY 1) "
CU = "WITH c AS (SELECT CAST(c_custkey AS INTEGER) AS d0, c_acctbal AS x FROM customer) "


def flagship(spark, sf_dir):
    """Price times discount factor contracted over rows, with statistics of the price over the same dimension."""
    pair = V.lineitem_pair(spark, sf_dir, "l_extendedprice", "1 - l_discount")
    both = contract.fmac_with_statistics(pair, ROWS)
    return both.select("d1", "d2", unit("re", 2).alias("revenue"), unit("mean", 2).alias("mean_price"))


query(LI + f"SELECT d1, d2, {U('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue, {U('avg(l_extendedprice)', 2)} AS mean_price FROM l GROUP BY d1, d2")(flagship)


@query(f"SELECT {U('sum(2.5)', 2)} AS total FROM range(1000)")
def ones_scale_sum(spark, sf_dir):
    a = elementwise.scale(generate.ones(spark, [10, 100]), 2.5)
    return reduce.total(a, 3).df.select(unit("re", 2).alias("total"))


@query("SELECT CAST(l_orderkey AS INTEGER) AS d0, " + U("sum(l_quantity)", 2) + " AS re FROM lineitem WHERE l_linenumber = 3 GROUP BY 1")
def slice_fixed(spark, sf_dir):
    t = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("re"))
    return cells(index.slice_(V.as_array(t, d0="l_orderkey", d1="l_linenumber"), d1=3), 2)


@query(CU + f"SELECT d0 - 20 AS d0, {U('x', 2)} AS re FROM c WHERE d0 >= 20 AND d0 < 90")
def extract_range(spark, sf_dir):
    return cells(index.extract(V.customers(spark, sf_dir), 0, 20, 90), 2)


@query(PG + f"SELECT 49 - d0 AS d0, {U('x', 2)} AS re FROM p")
def flip_index(spark, sf_dir):
    return cells(index.flip(V.part_grid(spark, sf_dir), 1), 2)


@query(PG + f"SELECT (d0 + 7) % 50 AS d0, {U('x', 2)} AS re FROM p")
def circshift_index(spark, sf_dir):
    return cells(index.circshift(V.part_grid(spark, sf_dir), 0, 7), 2)


@query(EM + f"SELECT d0 AS d1, d1 AS d0, {U('x', 6)} AS re FROM m")
def transpose_dims(spark, sf_dir):
    return cells(index.transpose(V.embeddings(spark, sf_dir), 0, 1), 6)


@query(EM + f"SELECT d1, CAST(d0 % 8 AS INTEGER) AS d0, CAST(d0 // 8 AS INTEGER) AS d2, {U('x', 6)} AS re FROM m")
def reshape_ravel(spark, sf_dir):
    a = index.transpose(V.embeddings(spark, sf_dir), 1, 3)
    b = index.reshape(a, 0b101, [8, 8])
    return cells(b, 6, d3="d1")


@query(EM + f"SELECT CAST(d0 + 64 * d1 AS INTEGER) AS d0, {U('x', 6)} AS re FROM m")
def squeeze_flatten(spark, sf_dir):
    return cells(index.flatten(index.squeeze(V.embeddings(spark, sf_dir))), 6)


@query(EV + f"SELECT d0 + 2 AS d0, d1, {U('x')} AS re FROM g WHERE d0 < 3 UNION ALL SELECT CAST(i AS INTEGER), d1, 0 FROM range(2) t(i), (SELECT DISTINCT d1 FROM g)")
def resize_front_pad(spark, sf_dir):
    a = index.resize(V.events(spark, sf_dir), d0=3)
    return cells(index.resize(a, "front", d0=5).densify())


@query(PG + f"SELECT CAST(i AS INTEGER) AS d0, {U('coalesce(x, 0)', 2)} AS re FROM range(61) t(i) LEFT JOIN p ON p.d0 = i - 5")
def resize_center_pad(spark, sf_dir):
    return cells(index.resize(V.part_grid(spark, sf_dir), "centre", d0=61).densify(), 2)


@query(CU + f", s AS (SELECT CAST(s_suppkey AS INTEGER) AS d0, s_acctbal AS x FROM supplier) SELECT d0, {U('x', 2)} AS re FROM c UNION ALL SELECT CAST(d0 + (SELECT max(d0) + 1 FROM c) AS INTEGER), {U('x', 2)} FROM s")
def join_concat(spark, sf_dir):
    s = V.as_array(V.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("re")), d0="s_suppkey")
    return cells(index.join(0, V.customers(spark, sf_dir), s), 2)


@query(PG + f"SELECT d0, CAST(i AS INTEGER) AS d1, {U('x', 2)} AS re FROM p, range(4) t(i)")
def repmat_cross(spark, sf_dir):
    return cells(index.repmat(V.part_grid(spark, sf_dir), 1, 4), 2)


@query(CU + f"SELECT d0, {U('sqrt(abs(x))')} AS root, {U('ln(abs(x))')} AS ln FROM c WHERE x <> 0")
def calc_abs_sqrt_log(spark, sf_dir):
    a = elementwise.cabs(V.customers(spark, sf_dir)).sparsify()
    root = elementwise.spow(a, 0.5).df.select("d0", unit("re").alias("root"))
    return root.join(a.with_values(F.log("re"), F.lit(0.0)).df.select("d0", unit("re").alias("ln")), "d0")


@query(EZ + f"SELECT d1, {U('sum(re * re + im * im)', 6)} AS re, {U('sum(re * im - im * re)', 6)} AS im FROM z GROUP BY d1")
def complex_mul_conj(spark, sf_dir):
    z = V.pairs(spark, sf_dir)
    return cells(contract.fmac(z, z, squash=1, conj=True), 6, im=True)


@query(EZ + f"SELECT d0, d1, {U('atan2(im, re)')} AS angle, {U('re / sqrt(re * re + im * im)')} AS re FROM z")
def carg_phase(spark, sf_dir):
    z = V.pairs(spark, sf_dir)
    angle = elementwise.carg(z).df.select("d0", "d1", unit("re").alias("angle"))
    return angle.join(elementwise.cpyphs(z.sparsify()).df.select("d0", "d1", unit("re").alias("re")), ["d0", "d1"])


@query(PG + f"SELECT d0, {U('exp(-x / 1000) * (0.54 - 0.46 * cos(2 * pi() * d0 / 49))', 6)} AS re FROM p")
def zexp_taper(spark, sf_dir):
    a = elementwise.zexp(elementwise.scale(V.part_grid(spark, sf_dir), -0.001))
    return cells(elementwise.window_taper(a, 1), 6)


@query(LI + f"SELECT d0, d1, d2, d3, {U('CASE WHEN l_discount = 0 THEN 0 ELSE 1 / l_discount END')} AS re FROM l")
def invert_guard(spark, sf_dir):
    return cells(elementwise.invert(V.lineitem(spark, sf_dir, "l_discount")))


@query(LI + f"SELECT d0, d1, d2, d3, {U('0.5 * l_extendedprice + l_quantity', 3)} AS re FROM l")
def saxpy_join(spark, sf_dir):
    return cells(elementwise.saxpy(0.5, V.lineitem_pair(spark, sf_dir, "l_extendedprice", "l_quantity")), 3)


@query(LI + f"SELECT d1, d2, {U('sum(l_extendedprice * (1 - l_discount))', 2)} AS re FROM l GROUP BY d1, d2")
def fmac_contract(spark, sf_dir):
    return cells(contract.fmac(V.lineitem_pair(spark, sf_dir, "l_extendedprice", "1 - l_discount"), squash=ROWS), 2)


@query("WITH s AS (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, k, sum(x) AS x FROM s GROUP BY 1, 2) SELECT CAST(a.label AS INTEGER) AS d0, CAST(b.label AS INTEGER) AS d2, " + U("sum(a.x * b.x)") + " AS re FROM m a JOIN m b USING (k) GROUP BY 1, 2")
def fmac_matmul(spark, sf_dir):
    t = V.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("re"))
    a = V.as_array(t, d0="label", d1="k")
    return cells(contract.matmul(a, index.transpose(a, 0, 2)))


@query(f"SELECT {U('sum(l_extendedprice * l_discount)', 2)} AS re FROM lineitem")
def sdot_global(spark, sf_dir):
    z = reduce.sdot(V.lineitem_pair(spark, sf_dir, "l_extendedprice", "l_discount"))
    return spark.range(1).select(unit(F.lit(z.real), 2).alias("re"))


@query(LI + f"SELECT d1, d2, {U('sum(l_quantity) * 1000 / (64 * (SELECT max(d3) + 1.0 FROM l))')} AS re FROM l GROUP BY d1, d2")
def avg_flags(spark, sf_dir):
    return cells(elementwise.scale(reduce.avg(V.lineitem(spark, sf_dir, "l_quantity"), ROWS), 1000.0))


@query(LI + f"SELECT d1, d2, {U('sum(l_discount) / count(*) FILTER (WHERE l_discount <> 0)', 6)} AS re FROM l GROUP BY d1, d2")
def wavg_nonzero(spark, sf_dir):
    return cells(reduce.avg(V.lineitem(spark, sf_dir, "l_discount"), ROWS, nonzero=True), 6)


@query(EM + f"SELECT d1, {U('var_samp(x)', 8)} AS var, {U('stddev_samp(x)', 8)} AS std FROM m GROUP BY d1")
def var_std_flags(spark, sf_dir):
    a = V.embeddings(spark, sf_dir)
    return reduce.var(a, 1).df.select("d1", unit("re", 8).alias("var")).join(reduce.std(a, 1).df.select("d1", unit("re", 8).alias("std")), "d1")


@query(EM + f"SELECT d1, {U('sqrt(sum(x * x))', 6)} AS re FROM m GROUP BY d1")
def rss_flags(spark, sf_dir):
    return cells(reduce.rss(V.embeddings(spark, sf_dir), 1), 6)


@query(EV + f"SELECT d0, d1, {U('x / sum(abs(x)) OVER (PARTITION BY d1)', 8)} AS re FROM e")
def normalize_l1(spark, sf_dir):
    return cells(elementwise.normalize(V.events(spark, sf_dir), 1, l1=True, ordered=True), 8)


@query(EM + f"SELECT d1, {U('greatest(0, max(x))', 6)} AS top, {U('least(min(x), greatest(0, max(x)))', 6)} AS low FROM m GROUP BY d1")
def mip_max_min(spark, sf_dir):
    a = V.embeddings(spark, sf_dir)
    both = reduce.mip(a, 1).df.select("d1", unit("re", 6).alias("top")).join(reduce.mip(a, 1, minimum=True).df.select("d1", unit("re", 6).alias("low")), "d1")
    return both.join(a.df.select("d1").distinct(), "d1")


@query("WITH b AS (SELECT CAST(ceil(32 * (embedding[1]::DOUBLE + 0.5)) AS INTEGER) AS d0 FROM embeddings) SELECT d0, CAST(count(*) AS BIGINT) AS re FROM b WHERE d0 >= 0 AND d0 < 32 GROUP BY 1")
def hist_bins(spark, sf_dir):
    return cells(reduce.hist(index.extract(V.embeddings(spark, sf_dir), 0, 0, 1), 0, 32), 0)


@query("WITH b AS (SELECT CAST(ceil(16 * (embedding[1]::DOUBLE + 0.5)) AS INTEGER) AS d0, CAST(ceil(16 * (embedding[2]::DOUBLE + 0.5)) AS INTEGER) AS d1 FROM embeddings) SELECT d0, d1, CAST(count(*) AS BIGINT) AS re FROM b WHERE d0 >= 0 AND d0 < 16 AND d1 >= 0 AND d1 < 16 GROUP BY 1, 2")
def hist_2d(spark, sf_dir):
    return cells(reduce.hist(index.extract(V.embeddings(spark, sf_dir), 0, 0, 2), 0, 16), 0)


@query(LI + f"SELECT d1, d2, count(*) AS n, {U('sum(l_quantity)', 2)} AS total, {U('avg(l_quantity)')} AS mean, {U('var_pop(l_quantity)')} AS var, {U('sum(l_quantity * l_quantity)', 2)} AS energy FROM l WHERE l_discount > 0.05 GROUP BY d1, d2")
def roistat_mask(spark, sf_dir):
    both = V.lineitem_pair(spark, sf_dir, "l_discount > 0.05", "l_quantity")
    s = reduce.roistat(both.first, both.second, by=0b110)
    return s.select("d1", "d2", D("count").alias("n"), unit("sum", 2).alias("total"), unit("mean").alias("mean"), unit("var").alias("var"), unit("energy", 2).alias("energy"))


@query(f"SELECT {U('sqrt(sum(power(l_extendedprice - 1400 * l_quantity, 2)) / sum(l_extendedprice * l_extendedprice))', 6)} AS nrmse, {U('sum(power(l_extendedprice - 1400 * l_quantity, 2)) / (64 * 6 * (SELECT max(l_orderkey) + 1.0 FROM lineitem))', 0)} // 1000 AS mse FROM lineitem")
def nrmse_measure(spark, sf_dir):
    p = V.lineitem_pair(spark, sf_dir, "l_extendedprice", "1400 * l_quantity")
    return spark.range(1).select(unit(F.lit(reduce.nrmse(p)), 6).alias("nrmse"), F.lit(int(reduce.measure(p)["mse"] + 0.5) // 1000).cast("long").alias("mse"))


@query(f"SELECT CAST(l_suppkey AS INTEGER) AS d1, CAST(max(CASE WHEN l_tax <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS re FROM lineitem GROUP BY 1")
def pattern_nonzero(spark, sf_dir):
    t = V.table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("i"), "l_suppkey", F.col("l_tax").alias("re"))
    return cells(reduce.pattern(V.as_array(t, d0="i", d1="l_suppkey"), 1), 0)


@query(CU + f"SELECT CAST(row_number() OVER (ORDER BY d0) - 1 AS INTEGER) AS d0, {U('x', 2)} AS re FROM c WHERE x > 0")
def compress_gather(spark, sf_dir):
    a = V.customers(spark, sf_dir)
    return cells(index.compress(a, a.with_values((D("re") > 0).cast("double"), F.lit(0.0))), 2)


@query(CU + f"SELECT d0, {U('x', 2)} AS re FROM c WHERE x > 0")
def decompress_scatter(spark, sf_dir):
    a = V.customers(spark, sf_dir)
    mask = a.with_values((D("re") > 0).cast("double"), F.lit(0.0))
    return cells(index.decompress(index.compress(a, mask), mask), 2)


@query(EV + f"SELECT d0, d1, {U('m')} AS re FROM (SELECT d0, d1, avg(x) OVER (PARTITION BY d1 ORDER BY d0 ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM g) WHERE d0 <= (SELECT max(d0) FROM g) - 4")
def moving_avg(spark, sf_dir):
    return cells(window.moving_average(V.events(spark, sf_dir), 0, 5))


@query(EV + f"SELECT d0, d1, {U('m')} AS re FROM (SELECT d0, d1, median(x) OVER (PARTITION BY d1 ORDER BY d0 ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM g) WHERE d0 <= (SELECT max(d0) FROM g) - 3")
def moving_median(spark, sf_dir):
    return cells(window.moving_median(V.events(spark, sf_dir), 0, 4))


@query(EV + f"SELECT d0, d1, {U('sum(x) OVER (PARTITION BY d1 ORDER BY d0)', 2)} AS re FROM g")
def cumsum(spark, sf_dir):
    return cells(window.cumsum(V.events(spark, sf_dir), 0), 2)


@query(EV + f"SELECT d0, d1, {U('x - coalesce(lag(x) OVER w, last_value(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))', 3)} AS re FROM g WINDOW w AS (PARTITION BY d1 ORDER BY d0)")
def fdiff_cyclic(spark, sf_dir):
    return cells(window.forward_difference(V.events(spark, sf_dir), 0), 3)


@query(EV + f"SELECT d0, d1, {U('coalesce(x - lead(x) OVER (PARTITION BY d1 ORDER BY d0), 0)', 3)} AS re FROM g")
def bdiff_zero(spark, sf_dir):
    return cells(window.backward_difference(V.events(spark, sf_dir), 0, zero=True), 3)


@query(LI + ", r AS (SELECT *, row_number() OVER (PARTITION BY d1, d2 ORDER BY l_quantity DESC) AS r FROM l), t AS (SELECT d1, d2, max(l_quantity) FILTER (WHERE r = 101) AS lim FROM r GROUP BY 1, 2) SELECT d0, d1, d2, d3, CAST(l_quantity > coalesce(lim, 0) AS BIGINT) AS re FROM l JOIN t USING (d1, d2)")
def topk_mask(spark, sf_dir):
    return cells(elementwise.top_k_mask(V.lineitem(spark, sf_dir, "l_quantity"), 100, ROWS), 0)


@query(CU + f"SELECT d0, {U('sign(x) * greatest(abs(x) - 1000, 0)', 2)} AS re FROM c")
def soft_threshold(spark, sf_dir):
    return cells(elementwise.soft_threshold(V.customers(spark, sf_dir), 1000.0), 2)


@query(EM + f"SELECT d0, d1, {U('x * greatest(n - 0.5, 0) / n', 6)} AS re FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY d1)) AS n FROM m)")
def joint_soft_threshold(spark, sf_dir):
    return cells(elementwise.soft_threshold(V.embeddings(spark, sf_dir), 0.5, joint=1), 6)


@query(CU + f"SELECT d0, CAST(abs(x) > 2000 AS BIGINT) AS mask, {U('CASE WHEN abs(x) > 2000 THEN x ELSE 0 END', 2)} AS re FROM c")
def hard_binary_threshold(spark, sf_dir):
    a = V.customers(spark, sf_dir)
    return cells(elementwise.hard_threshold(a, 2000.0), 2).join(elementwise.binary_threshold(a, 2000.0).df.select("d0", D("re").cast("long").alias("mask")), "d0")


@query("WITH e AS (SELECT event_id, value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS d1 FROM events) SELECT CAST(row_number() OVER (PARTITION BY d1 ORDER BY event_id) - 1 AS INTEGER) AS d0, d1, " + U("value") + " AS re FROM e")
def bin_label(spark, sf_dir):
    t = V.table(spark, sf_dir, "events")
    kinds = F.array(*(F.lit(r[0]) for r in t.select("event_type").distinct().orderBy("event_type").collect()))  # a few
    a = V.as_array(t.select("event_id", F.col("value").alias("re")), d0="event_id")
    labels = V.as_array(t.select("event_id", F.array_position(kinds, D("event_type")).cast("double").alias("re")), d0="event_id")
    found = window.bin_labels(a, labels, 0, 1)
    return found.df.where("d1 > 0").select("d0", (D("d1") - 1).cast("int").alias("d1"), unit("re").alias("re"))


@query(PG + f"SELECT q.d0, {U('p.x', 2)} AS re FROM (SELECT d0, (d0 * 7) % 50 AS s FROM p) q JOIN p ON p.d0 = q.s")
def bin_reorder(spark, sf_dir):
    a = V.part_grid(spark, sf_dir)
    order = generate.from_index(spark, [50], (D("d0") * 7) % 50)
    return cells(window.reorder(a, order, 0), 2)


@query("SELECT CAST(vec_id AS INTEGER) AS d0, CAST(i AS INTEGER) AS d1, CAST(i = label AS BIGINT) AS re FROM embeddings, range((SELECT max(label) + 1 FROM embeddings)) t(i) WHERE i = label")
def onehot_encode(spark, sf_dir):
    t = V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("re"))
    return cells(reduce.onehotenc(V.as_array(t, d0="vec_id"), 1), 0)


@query("SELECT CAST(vec_id AS INTEGER) AS d1, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS re FROM embeddings")
def onehot_decode_argmax(spark, sf_dir):
    return cells(reduce.onehotdec(V.embeddings(spark, sf_dir), 0), 0)


@query("SELECT CAST(quality AS INTEGER) AS d0, CAST(toxic AS INTEGER) AS d1, count(*) AS re FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    t = V.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", D("quality").cast("double").alias("a"), D("toxic").cast("double").alias("b"))
    a, b = (V.as_array(t.select("doc_id", D(c).alias("re")), d0="doc_id") for c in "ab")
    return cells(reduce.confusion(a, b, 2), 0)


@query(PG + f"SELECT CAST(p.d0 - w AS INTEGER) AS d0, CAST(w AS INTEGER) AS d1, {U('x', 2)} AS re FROM p, range(5) t(w) WHERE p.d0 - w BETWEEN 0 AND 45")
def casorati_window(spark, sf_dir):
    return cells(index.casorati(V.part_grid(spark, sf_dir), d0=5), 2)


@query(PG + f"SELECT CAST(i AS INTEGER) AS d0, CAST(j AS INTEGER) AS d1, {U('sum(a.x * b.x)', 0)} // 100 AS re FROM range(5) s(i), range(5) t(j), range(46) q(p), p a, p b WHERE a.d0 = q.p + i AND b.d0 = q.p + j GROUP BY 1, 2")
def hankel_gram(spark, sf_dir):
    a = window.hankel_gram(V.part_grid(spark, sf_dir), 0, 5)
    return a.df.select("d0", "d1", F.expr("cast(floor(re + 0.5) as bigint) div 100").alias("re"))


@query(PG + f"SELECT CAST((d0 + k + 49) % 50 AS INTEGER) AS d0, {U('sum(x * (k + 1))', 2)} AS re FROM p, range(3) t(k) GROUP BY 1")
def convolution_cyclic(spark, sf_dir):
    return cells(contract.conv(V.part_grid(spark, sf_dir), generate.vec(spark, [1, 2, 3]), 1), 2)


@query(PG + ", o AS (SELECT d0 FROM p WHERE d0 % 7 = 0) SELECT CAST((d0 + s + 49) % 50 AS INTEGER) AS d0, CAST(1 AS BIGINT) AS re FROM o, range(3) t(s) GROUP BY 1")
def morph_dilate(spark, sf_dir):
    a = V.part_grid(spark, sf_dir)
    return cells(window.morph(a.with_values((D("d0") % 7 == 0).cast("double"), F.lit(0.0)), 1), 0)


@query(PG + ", o AS (SELECT d0 FROM p WHERE d0 % 7 <> 0), c AS (SELECT CAST((d0 + s + 49) % 50 AS INTEGER) AS d0, count(*) AS n FROM o, range(3) t(s) GROUP BY 1) SELECT d0, CAST(1 AS BIGINT) AS re FROM c WHERE n = 3")
def morph_erode(spark, sf_dir):
    a = V.part_grid(spark, sf_dir)
    return cells(window.morph(a.with_values((D("d0") % 7 != 0).cast("double"), F.lit(0.0)), 1, erode=True), 0)


@query(f"SELECT CAST(i AS INTEGER) AS d0, {U('exp(ln(1) + i * (ln(1000) - ln(1)) / 20)')} AS re FROM range(20) t(i)")
def index_log_grid(spark, sf_dir):
    return cells(generate.index(spark, 0, 20, log=True, low=1.0, high=1000.0))


@query("SELECT CAST(i AS INTEGER) AS d0, CAST(1 + 2 * i + 3 * i * i AS BIGINT) AS re FROM range(100) t(i)")
def poly_eval(spark, sf_dir):
    return cells(generate.poly(spark, 100, [1, 2, 3]), 0)


@query("SELECT CAST(y AS INTEGER) AS d1, CAST(z AS INTEGER) AS d2, CAST((y % 4 = 0 AND z % 2 = 0) OR (abs(2 * y - 64) < 16 AND abs(2 * z - 64) < 16) AS BIGINT) AS re FROM range(64) a(y), range(64) b(z)")
def upat_mask(spark, sf_dir):
    return cells(generate.upat(spark, 64, 64, 4, 2, 8), 0)


@query(f"SELECT CAST(c AS INTEGER) AS d0, CAST(i AS INTEGER) AS d1, CAST(j AS INTEGER) AS d2, CAST(k AS INTEGER) AS d3, {U('CASE c WHEN 0 THEN (i - 4) / 8 WHEN 1 THEN (j - 4) / 8 ELSE (k - 2) / 4 END')} AS re FROM range(3) t(c), range(8) x(i), range(8) y(j), range(4) z(k)")
def grid_affine(spark, sf_dir):
    return cells(generate.grid(spark, [8, 8, 4]))


@query(LI + f"SELECT d1, d2, {U('sum(l_quantity)', 2)} AS total FROM l GROUP BY GROUPING SETS ((d1, d2), (d1), ())")
def reduce_sets(spark, sf_dir):
    a = V.lineitem(spark, sf_dir, "l_quantity")
    return reduce.reduce_sets(a, [ROWS, ROWS | 4, ROWS | 6]).select("d1", "d2", unit("re", 2).alias("total"))


@query("SELECT k, n FROM (SELECT 'union' AS k, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))")
def set_union_intersect_except(spark, sf_dir):
    t = V.table(spark, sf_dir, "customer").select("c_custkey").union(V.table(spark, sf_dir, "orders").select("o_custkey"))
    size = int(t.agg(F.max("c_custkey")).first()[0]) + 1
    mask = lambda name, c: ArrayFrame.of(V.table(spark, sf_dir, name).select(D(c).alias("d0")).distinct().withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}), [size])
    c, o = mask("customer", "c_custkey"), mask("orders", "o_custkey")
    n = lambda a, k: a.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n")
    return n(reduce.union(c, o), "union").union(n(reduce.intersect(c, o), "intersect")).union(n(reduce.subtract(c, o), "except"))


@query(f"SELECT time_bucket(INTERVAL 5 minutes, ts) AS start, count(*) AS n, {U('avg(value)')} AS mean FROM events GROUP BY 1")
def stream_tumbling(spark, sf_dir):
    t = slices.tumbling(V.table(spark, sf_dir, "events"), "ts", "5 minutes", "value")
    return t.select(D("start").cast("timestamp_ntz").alias("start"), "n", unit("mean").alias("mean"))


@query(f"SELECT time_bucket(INTERVAL 5 minutes, ts) - to_minutes(CAST(5 * k AS INTEGER)) AS start, count(*) AS n, {U('avg(value)')} AS mean FROM events, range(2) t(k) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    t = slices.sliding(V.table(spark, sf_dir, "events"), "ts", "10 minutes", "5 minutes", "value")
    return t.select(D("start").cast("timestamp_ntz").alias("start"), "n", unit("mean").alias("mean"))


@query("WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n, " + U("sum(value)", 2) + " AS total FROM s GROUP BY user_id, k")
def stream_session(spark, sf_dir):
    t = slices.sessions(V.table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes", "value")
    return t.select("user_id", D("start").cast("timestamp_ntz").alias("start"), "n", unit("total", 2).alias("total"))
