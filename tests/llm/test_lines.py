import random

import brute
from gridloom.llm import lines
from pyspark.sql import functions as F


def test_as_by_brute_force(spark):
    rng = random.Random(5)
    pool = ["Subscribe to our newsletter now", "  subscribe to OUR newsletter now\t", "short", "", "exactly twenty chars", "nineteen characters", "Größe der Zeile über zwanzig", " subscribe to our newsletter now"]
    rows = [(i, "\n".join(rng.choice([*pool, f"a line of document {i} alone"]) for _ in range(rng.randint(1, 150)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "Subscribe to our newsletter now\n" * 3000), (504, "a\r\nb")]
    df = spark.createDataFrame([(d, t, "c", 3) for d, t in rows], "doc_id long, text string, words string, pos int").repartition(4)
    out = lines.drop_common_lines(spark, df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("s"))
    assert sorted(tuple(r) for r in out.collect()) == brute.line_dedup(rows)
    assert lines.drop_common_lines(spark, df.limit(0)).collect() == []


def test_repeated_rows_share_decisions(spark):
    line = "this line is said by everybody"
    rows = [(1, line), (1, line), (2, line), (3, line + "\nx")]
    out = lines.drop_common_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out) == [(1, 1, 1, ""), (1, 1, 1, ""), (2, 1, 1, ""), (3, 2, 0, line + "\nx")]


def test_no_python_in_the_plan(spark):
    plan = lines.op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
