"""A few registered queries against their SQL twins; all of them have one."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["q_pos_n", "q_pos_last", "q_sum", "q_ancestor", "q_union", "q_string_value", "q_nodetests", "q_distinct_idiom", "q_sort_multi", "q_copy", "q_recursive_call", "q_error_rows", "q_output_decl", "q_xpath_eval", "q_ns_name", "q_parse_keep", "q_descendant_or_self"])
def test_twin(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = c.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_every_tree_query_has_a_twin():
    assert {q for q in entry.queries() if q.startswith("q_")} <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
