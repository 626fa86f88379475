"""Every query of the array operators against its SQL, and the driver contract."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from gridloom.plans import catalog, more  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_norms_are_added_in_index_order(spark, tmp_path):
    """Quotients that end in half a unit: the last bit of the norm decides them, and the file is in another order than the index."""
    rows = []
    for u in range(12):
        cents = [4 + 8 * ((37 * i * i + 11 * i + 53 * u) % 181) for i in range(63)]
        rows += [(u, i, c / 100) for i, c in enumerate([*cents, 51200 - sum(cents)])]
    values = ", ".join(map(str, reversed(rows)))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 64 * u + i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, CAST(u AS BIGINT) AS user_id, CAST(v AS DOUBLE) AS value FROM (VALUES {values}) t(u, i, v)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalog.QUERIES["normalize_l1"](spark, str(tmp_path))
    want = con.execute(f"SELECT d0, d1, re FROM ({catalog.ORACLE_SQL['normalize_l1']})").fetchall()
    assert len(want) == len(rows) and sorted(map(tuple, df.select("d0", "d1", "re").collect())) == sorted(want)


def test_entry_imports_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    for name in ("__spark_entry__.py", "gridloom"):
        os.system(f"cp -r {root}/{name} {tmp_path}")
    os.system(f"rm -rf {tmp_path}/gridloom/llm")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
