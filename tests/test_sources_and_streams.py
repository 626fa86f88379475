import numpy as np
from gridloom.frame import ArrayFrame
from gridloom.operators import elementwise, reduce
from gridloom.sources import arrays
from gridloom.streaming import slices


def test_parquet_and_raw_files_round_trip(spark, tmp_path):
    x = (np.arange(24).reshape(2, 3, 4) + 1j).astype(np.complex64)
    a = ArrayFrame.from_numpy(spark, x)
    arrays.write_parquet(a, f"{tmp_path}/p")
    assert np.allclose(arrays.read_parquet(spark, f"{tmp_path}/p").to_numpy(), x)
    for name in ("a.ra", "a"):
        arrays.write_raw(a, f"{tmp_path}/{name}")
        assert np.allclose(arrays.read_raw(spark, f"{tmp_path}/{name}").to_numpy(), x), name


def test_loop_and_tee_over_slices(spark, tmp_path):
    x = np.arange(12.0).reshape(3, 4)
    ArrayFrame.from_numpy(spark, x).df.repartition(4, "d1").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    slices.loop(slices.read_slices(spark, f"{tmp_path}/in", schema), [3, 4], lambda a: elementwise.scale(a, 2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert np.allclose(ArrayFrame.of(spark.read.parquet(f"{tmp_path}/out"), [3, 4]).to_numpy(), 2 * x)
    slices.tee(slices.read_slices(spark, f"{tmp_path}/in", schema), [f"{tmp_path}/s{i}" for i in (1, 2)], f"{tmp_path}/cp2").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/s1").count() == spark.read.parquet(f"{tmp_path}/s2").count() == 12


def test_slices_that_come_apart_and_out_of_order(spark, tmp_path):
    rows = [(i, j, 10.0 * i + j, 0.0) for i in range(4) for j in range(3)]
    order = [rows[k] for k in (7, 0, 9, 3, 1, 10, 8, 4, 2, 11, 5, 6)]
    for k in range(4):
        spark.createDataFrame(order[3 * k : 3 * k + 3], "d2 int, d0 int, re double, im double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = slices.read_slices(spark, f"{tmp_path}/in", schema)
    seen = slices.loop_whole(stream, [3, 1, 4], 2, 3, lambda a: reduce.total(a, 1), f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/cp")
    seen.awaitTermination()
    got = sorted((r.d2, r.re) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(i, 30.0 * i + 3) for i in range(4)]
