"""Expressions over a small document, through the set-at-a-time plans and the per-document interpreter."""

import math

import pytest
from pyspark.sql import functions as F

from sylvan.operators.tree import Context, evaluate, to_string
from sylvan.operators.stylesheet import parsed
from sylvan.plans import lift
from sylvan.plans.syntax import Limits, XPathError, XPathSyntaxError, parse
from sylvan.sources.shred import shred

HARBOUR = """<harbour xml:lang="nl" tide="3.5">
<!--spring--><?radio channel 12?><?light?>
<quay code="n"><boat tons="12" flag="NL">Anna</boat><boat tons="7" flag="DK">Bo</boat><boat tons="31" flag="NL">Cato</boat><crane/></quay>
<quay code="s" lang="en-GB"><boat tons="7" flag="SE">  Dina
 of  Kiel </boat><or>1</or><div>6</div><mod>4</mod></quay>
<toll><fee>2.5</fee><fee>10</fee><fee>x</fee></toll></harbour>"""
CASES = [
    # paths, axes, node tests
    ("count(//boat)", 4.0), ("count(/harbour/*)", 3.0), ("count(/harbour/quay/*)", 8.0), ("string(//quay[2]/@code)", "s"), ("name(//boat[@tons = 31]/following-sibling::*)", "crane"), ("string(//crane/preceding-sibling::boat[1])", "Cato"),
    ("string(//crane/preceding-sibling::boat[last()])", "Anna"), ("count(//crane/following::*)", 9.0), ("count(//toll/preceding::boat)", 4.0), ("count(//fee/ancestor::*)", 2.0), ("count(//boat/..)", 2.0), ("count(//boat/ancestor-or-self::*)", 7.0), ("count(//quay/descendant-or-self::*)", 10.0),
    ("count(//@*)", 13.0), ("count(//boat/@flag)", 4.0), ("name(//@tide/..)", "harbour"), ("count(//namespace::*)", 0.0), ("count(/comment()) + count(//comment())", 1.0), ("string(//processing-instruction('radio'))", "channel 12"), ("count(//processing-instruction())", 2.0),
    ("count(//quay/node()[self::crane])", 1.0), ("count(/harbour/quay | //crane | //quay)", 3.0), ("count(/)", 1.0), ("count(//self::boat)", 4.0), ("count(//toll/fee/text())", 3.0),
    # predicates and positions
    ("string((//boat)[4]/@flag)", "SE"), ("count(//boat[1])", 2.0), ("count((//boat)[1])", 1.0), ("string(//boat[@flag = 'NL'][2])", "Cato"), ("string(//quay[1]/boat[position() = last()])", "Cato"), ("count((//boat)[position() mod 2 = 0])", 2.0), ("count(//quay[crane])", 1.0),
    ("count(//quay[not(crane)])", 1.0), ("count(//boat[@tons > 7 and @flag != 'DK'])", 2.0), ("count(//*[@code or @tons])", 6.0), ("count(//boat[not(@tons = preceding::boat/@tons)])", 3.0), ("count(//boat[. = 'Bo'])", 1.0),
    # comparisons of sets and scalars
    ("//boat/@tons = 31", True), ("//boat/@tons != 7", True), ("//boat/@tons < 7", False), ("12 >= //boat/@tons", True), ("//boat/@tons > //fee", True), ("//fee = //boat/@tons", False), ("//none = //boat", False), ("not(//none)", True), ("//crane = true()", True), ("//none = false()", True),
    # names that are operators elsewhere
    ("//or + //div div //mod - //or", 1.5), ("//div mod //mod", 2.0), ("1 or 0 and 0", True), ("2 - -1", 3.0), ("-(2 + 3) * 2", -10.0), ("7 mod -3", 1.0), ("-7 mod 3", -1.0), ("5 div 0", math.inf), ("string(-5 div 0)", "-Infinity"), ("0 div 0", math.nan),
    # functions
    ("sum(//boat/@tons)", 57.0), ("sum(//fee)", math.nan), ("sum(//none)", 0.0), ("sum('7')", math.nan), ("count(4)", 1.0), ("floor(-0.5)", -1.0), ("ceiling(2.01)", 3.0), ("round(-3.5)", -3.0), ("round(2.5)", 3.0), ("number(' 4.50 ')", 4.5), ("number('4e1')", math.nan), ("number(true()) + number('')", math.nan),
    ("concat('t', /harbour/@tide, 1 = 1)", "t3.5true"), ("substring('harbour', 0, 3)", "ha"), ("substring('harbour', 4)", "bour"), ("substring('harbour', 1.5, 2.6)", "arb"), ("substring('harbour', 2, 0 div 0)", ""), ("substring-before('12/07', '/')", "12"), ("substring-after('12/07', '-')", ""), ("substring-after('ab', '')", "ab"),
    ("translate('tide table', 'tdx ', 'TD')", "TiDeTable"), ("normalize-space(//quay[2]/boat)", "Dina of Kiel"), ("string-length(//quay[1]/boat[2])", 2.0), ("starts-with(//boat, 'An')", True), ("contains('quay', '')", True), ("boolean('false')", True), ("boolean(0 div 0)", False), ("string(1000000)", "1000000"), ("string(0.1 + 0.2)", "0.30000000000000004"), ("string(-0)", "0"),
    ("local-name(//@lang)", "lang"), ("namespace-uri(/harbour)", ""), ("count(//boat[lang('nl')])", 3.0), ("count(//boat[lang('EN')])", 1.0), ("string(/harbour/none)", ""), ("true() and not(false())", True),
]


@pytest.fixture(scope="module")
def forest(spark):
    f = shred(spark.createDataFrame([(1, HARBOUR)], "doc_id long, xml string"))
    f.all_nodes, f.docs = f.nodes.cache(), f.docs.cache()
    return f


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


@pytest.mark.parametrize("expr,wanted", CASES)
def test_interpreter(expr, wanted):
    assert same(evaluate(parse(expr), Context(parsed(HARBOUR))), wanted)


@pytest.mark.parametrize("expr,wanted", CASES[::3])
def test_plans(forest, expr, wanted):
    assert same(lift.evaluate(forest, expr).first().value, wanted)


@pytest.mark.parametrize("expr", ["[", "a b", "foo:bar()", "a[", "1 +", '"abc', "$__proto__", "$toString", "$ns:__proto__"])
def test_refused(expr):
    with pytest.raises((XPathSyntaxError, XPathError)):
        parse(expr)


@pytest.mark.parametrize("expr", ["contains('a')", "last(1)", "translate('a', 'b')", "concat()", "substring('a')", "not()"])
def test_numbers_of_arguments(expr):
    with pytest.raises(XPathSyntaxError, match="arguments at position 0"):
        parse(expr)


def test_limits(forest):
    few = Limits(depth=3, nodes=3, literal=4)
    for expr in ("((((1))))", "'abcde'"):
        with pytest.raises(XPathSyntaxError):
            parse(expr, few)
    assert evaluate(parse("count(//quay)"), Context(parsed(HARBOUR), most=100)) == 2
    with pytest.raises(XPathError):
        evaluate(parse("count(//boat)"), Context(parsed(HARBOUR), most=3))
    assert lift.evaluate(forest, "count(//quay)", limits=few).first().value == 2
    with pytest.raises(Exception, match="more than 3 nodes"):
        lift.evaluate(forest, "count(//boat)", limits=few).collect()


def test_unknown_names(forest):
    for expr in ("unknownFunction()", "$missing"):
        with pytest.raises(XPathError):
            evaluate(parse(expr), Context(parsed(HARBOUR)))
        with pytest.raises(XPathError):
            lift.evaluate(forest, expr)


def test_names_and_texts():
    assert evaluate(parse("count(/корень/элемент)"), Context(parsed("<корень><элемент/></корень>"))) == 1
    assert to_string(evaluate(parse("string(/r)"), Context(parsed("<r>Hello 🌍<![CDATA[ <World>]]></r>")))) == "Hello 🌍 <World>"
    doc = parsed('<r xmlns:n="u"><n:a/><b/></r>')
    assert evaluate(parse("count(/r/n:*)"), Context(doc, namespaces={"n": "u"})) == 1


def test_shredder_modes(spark):
    rows = spark.createDataFrame([(1, "<a/>"), (2, "<a>"), (3, None), (4, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>')], "doc_id long, xml string")
    assert shred(rows, mode="DROPMALFORMED").nodes.select("doc_id").distinct().count() == 1
    assert shred(rows).nodes.where(F.col("value").startswith("error")).count() == 2
    page = shred(spark.createDataFrame([(1, "<ul><li>a<li>b</ul><p>x<br>y<p>z")], "doc_id long, xml string"), html=True)
    assert lift.evaluate(page, "count(//li) * 10 + count(//p)").first().value == 22


def test_plan_shape(spark):
    from sylvan.sources.relational import order_tree
    from tests.conftest import DATA

    plan = lift.select(order_tree(spark, DATA), "/order/lineitem[1]/@qty")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_attributes_need_no_join(spark):
    from sylvan.sources.relational import order_tree
    from tests.conftest import DATA

    for expr in ("//lineitem/@qty", "//lineitem[@flag='R']/@price", "//lineitem[@flag='R' and (@qty > 40 or @n = 1)]/@n"):
        plan = lift.select(order_tree(spark, DATA), expr)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan, expr
