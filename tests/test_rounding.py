"""Numbers of queries, to two places as their SQL rounds them."""

import math
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sylvan.queries import hundredths


def test_hundredths(spark):
    r = random.Random(3)
    numbers = [n / d for n in range(-60, 61) for d in (1, 3, 7, 8, 40, 200, 400, 1000)] + [r.uniform(-1e6, 1e6) for _ in range(500)] + [r.randrange(10**9) / 1000 for _ in range(500)]
    numbers += [0.0, -0.0, -0.001, 0.004999999999999999, 1e15 + 0.125, 2.0**53, 1e22, -1e306, 1.7e308, math.inf, -math.inf, math.nan]
    rows = list(enumerate(numbers))
    got = dict(spark.createDataFrame(rows, "i long, x double").select("i", hundredths(F.col("x"))).collect())
    c = duckdb.connect()
    for i, x in rows:
        want = c.execute("select round(?::double, 2)", [x]).fetchall()[0][0]
        assert struct.pack("d", got[i]) == struct.pack("d", want) or math.isnan(got[i]) and math.isnan(want), (x, got[i], want)


@pytest.mark.parametrize("name", ["q_div_zero", "q_arith", "q_div_mod"])
def test_long_orders(spark, tmp_path, name):
    """Orders of 60 lines: 23 / 40 is a half as a decimal, not as a double."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(5)
    lines = [(o, n, float(r.randint(0, 50))) for o in range(40) for n in range(1, 61)]
    table = {"l_orderkey": [x[0] for x in lines], "l_partkey": [x[1] for x in lines], "l_suppkey": [1] * len(lines), "l_linenumber": pa.array([x[1] for x in lines], pa.int32()), "l_quantity": [x[2] for x in lines], "l_extendedprice": [round(r.uniform(900, 99000), 2) for _ in lines]}
    table |= {"l_discount": [0.01] * len(lines), "l_tax": [0.02] * len(lines), "l_returnflag": ["R"] * len(lines)}
    pq.write_table(pa.table(table), tmp_path / "lineitem.parquet")
    orders = {"o_orderkey": list(range(40)), "o_orderstatus": ["F"] * 40, "o_totalprice": [1.0] * 40, "o_orderdate": ["1996-09-13"] * 40, "o_orderpriority": ["1-URGENT"] * 40}
    pq.write_table(pa.table(orders), tmp_path / "orders.parquet")
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select("doc_id", "pre", "value").collect()))
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = sorted(c.execute(f"select doc_id, pre, value from ({entry.oracle_sql()[name]})").fetchall())
    assert list(map(str, got)) == list(map(str, want))
