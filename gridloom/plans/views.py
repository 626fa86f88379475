"""The driver's tables as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame, ArrayPair, key_type, normalise_dims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_array(df: DataFrame, **columns: str) -> ArrayFrame:
    """Index columns d<k>=column; sizes from their largest values. re and im (optional) must be there."""
    if "im" not in df.columns:
        df = df.withColumn("im", F.lit(0.0))
    top = df.agg(*(F.max(c).alias(k) for k, c in columns.items())).first()
    dims = [1] * 16
    for k in columns:
        dims[int(k[1:])] = max(2, int(top[k] or 0) + 1)
    return ArrayFrame.of(df.select(*(F.col(c).cast("int").alias(k) for k, c in columns.items()), "re", "im"), dims)


#: Rows of one order with one flag and status that the view has room for.
SLOTS = 64


def _lineitem(spark, sf_dir, *values):
    """d0: row among those of its order, flag and status; d1: return flag (A, N, R); d2: line status (F, O); d3: order."""
    t = table(spark, sf_dir, "lineitem")
    orders = max(2, int(t.agg(F.max("l_orderkey")).first()[0] or 0) + 1)
    w = Window.partitionBy("l_orderkey", "l_returnflag", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    keys = [(F.row_number().over(w) - 1).alias("d0"), F.expr("instr('ANR', l_returnflag) - 1").alias("d1"), F.expr("instr('FO', l_linestatus) - 1").alias("d2"), F.col("l_orderkey").cast(key_type(orders)).alias("d3")]
    cols = [F.expr(f"cast({v} as double)").alias(c) for v, c in zip(values, ("re", "re2"), strict=False)]
    return t.select(*keys, *cols), normalise_dims([SLOTS, 3, 2, orders])


def lineitem(spark, sf_dir, value: str) -> ArrayFrame:
    df, dims = _lineitem(spark, sf_dir, value)
    return ArrayFrame(df.withColumn("im", F.lit(0.0)), dims)


def lineitem_pair(spark, sf_dir, first: str, second: str) -> ArrayPair:
    """Two values of the rows of lineitem."""
    df, dims = _lineitem(spark, sf_dir, first, second)
    return ArrayPair(df.withColumns({"im": F.lit(0.0), "im2": F.lit(0.0)}), dims)


def embeddings(spark, sf_dir) -> ArrayFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "re"))
    return as_array(t, d0="p", d1="vec_id")


def pairs(spark, sf_dir) -> ArrayFrame:
    """Even components are real, odd ones imaginary parts."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1)).alias("p"))
    t = t.select("vec_id", "p", F.expr("embedding[2 * p]").alias("re"), F.expr("embedding[2 * p + 1]").alias("im"))
    return as_array(t, d0="p", d1="vec_id")


def events(spark, sf_dir) -> ArrayFrame:
    t = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return as_array(t.select((F.row_number().over(w) - 1).alias("i"), "user_id", F.col("value").alias("re")), d0="i", d1="user_id")


def part_grid(spark, sf_dir) -> ArrayFrame:
    t = table(spark, sf_dir, "part").groupBy((F.col("p_size") - 1).alias("i")).agg(F.avg("p_retailprice").alias("re"))
    return ArrayFrame.of(t.select(F.col("i").alias("d0"), "re", F.lit(0.0).alias("im")), [50])


def customers(spark, sf_dir) -> ArrayFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("re"))
    return as_array(t, d0="c_custkey")
