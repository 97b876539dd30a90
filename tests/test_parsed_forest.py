"""Plans over nodes that are parsed from texts: no join sends a side to all, steps from the roots need none, results stay."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sylvan.operators.stylesheet import parsed
from sylvan.operators.tree import Context, evaluate
from sylvan.plans import lift
from sylvan.plans.syntax import parse
from sylvan.sources.shred import shred
from tests.conftest import DATA

YARD = '<yard seg="a"><w n="1" seg="b"/><w seg="c"><x n="2"/></w><z n="1"/></yard>'
TEXTS = [(1, YARD), (2, "<yard/>"), (3, "<broken>"), (4, '<v n="7"/>')]


def source(spark):
    """The texts as a table of which Spark takes the size to be small."""
    return spark.range(len(TEXTS)).select((F.col("id") + 1).alias("doc_id"), F.element_at(F.array(*[F.lit(t) for _, t in TEXTS]), (F.col("id") + 1).cast("int")).alias("xml"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attribute_parent_broadcasts_nothing(spark):
    told = plan(entry.queries()["q_attribute_parent"](spark, DATA))
    assert "Broadcast" not in told and told.count("MapInArrow") == 3


@pytest.mark.parametrize("expr", ["count(/*)", "//none = //w/@n", "//w/@n = 1", "//w/@seg = //z/@n", "count(//w[x])", "count(//w[@n = 1])", "string(id('1'))", "string(//w)"])
def test_no_join_broadcasts(spark, expr):
    forest = shred(source(spark))
    assert "Broadcast" not in plan(lift.evaluate(forest, expr))


@pytest.mark.parametrize("expr", ["//@seg", "//@n[. = 1]", "//@n[1]", "//@n[2]", "//@*[2]", "(//@n)[2]", "//@n/..", "//@seg/../..", "//@seg/../@n", "/.", "/yard/w/..", "//w/@seg/ancestor::*", "//x/../.."])
def test_nodes(spark, expr):
    forest = shred(source(spark))
    found = lift.select(forest, expr).select("doc_id", "name", "value").where(F.col("doc_id") != 3).collect()
    want = [(d, n.name, n.value) for d, t in TEXTS if d != 3 for n in evaluate(parse(expr), Context(parsed(t)))]
    assert sorted((d, n or "", v or "") for d, n, v in found) == sorted((d, n or "", v or "") for d, n, v in want)


def test_select_first_joins_texts_of_first_nodes_only(spark):
    told = plan(entry.queries()["q_select_first"](spark, DATA))
    assert "Broadcast" not in told and told.index("LeftOuter") < told.index("min_by")


@pytest.mark.parametrize("expr", ["//w", "//*", "//@n", "//x/..", "//@seg/..", "//w[2] | //z", "/", "/*/*[last()]"])
def test_select_first(spark, expr):
    texts = [(1, '<yard seg="a">p<w n="1">q<z>r</z></w><w>s<x n="2"/>t</w><z n="1">u</z></yard>'), (2, "<yard/>"), (3, '<v n="7">k</v>')]
    found = lift.select_first(shred(spark.createDataFrame(texts, "doc_id long, xml string")), expr).select("doc_id", "name", "string_value").collect()
    nodes = [(d, evaluate(parse(expr), Context(parsed(t)))) for d, t in texts]
    want = [(d, min(n, key=lambda x: x.pre)) for d, n in nodes if n]
    assert sorted((d, n or "", v) for d, n, v in found) == [(d, n.name, n.text()) for d, n in want]
