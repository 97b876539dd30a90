"""Stylesheets over tables: the plan gives what the per-document interpreter gives, on sheets drawn at random."""

import random

import pytest
from pyspark.sql import functions as F

from sylvan.api import Shape, Transformer, Unsupported

HEAD = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">'
SHOPS = [(1, "a<b", "x", None), (2, None, "", 'say "hi" & go'), (3, "é", "y\tz", "<text>"), (4, "B", None, "")]
GOODS = [(1, 1, "10", "k"), (1, 2, "9", "j"), (1, 3, "", None), (1, 4, "10", "K"), (3, 1, "abc", "é"), (3, 2, "-2.5", "z"), (3, 3, None, "a&b"), (2, 1, "7", "m")]


@pytest.fixture(scope="module")
def shops(spark):
    goods = spark.createDataFrame(GOODS, "doc_id long, place int, price string, tag string")
    shop = spark.createDataFrame(SHOPS, "doc_id long, name string, kind string, note string")
    inner = Shape(goods, "good", [("n", F.col("place").cast("string")), ("price", F.col("price")), ("tag", F.col("tag"))], ["doc_id"], ["place"])
    return Shape(shop, "shop", [("name", F.col("name")), ("kind", F.col("kind"))], ["doc_id"], text=F.col("note"), children=[inner])


def both(shops, body, params=None):
    out = []
    for tier in ("plan", "document"):
        t = Transformer().import_stylesheet(HEAD + body + "</xsl:stylesheet>")
        for k, v in (params or {}).items():
            t.set_parameter(None, k, v)
        out.append(sorted(tuple(map(str, r)) for r in t.transform(shops, tier=tier).collect()))
    return out


class Sheets:
    """Random templates for a shop and its goods, within what plans can do."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def pick(self, *options):
        x = self.r.choice(options)
        return x() if callable(x) else x

    def string(self, good):
        own = ("@n", "@price", "@tag", ".", "position()", "last()") if good else ("@name", "@kind", "name()", "good/@tag", "string(good/@price)", "count(good)", "sum(good[@price &gt; 0]/@price)", "good[2]/@tag", "good[last()]/@n")
        return self.pick(*own, "'lit &amp; &lt;'", "3 div 2", lambda: f"concat({self.string(good)}, '-', {self.string(good)})", lambda: f"substring({self.string(good)}, 1, 2)", lambda: f"string-length({self.string(good)})", lambda: f"normalize-space({self.string(good)})", lambda: f"translate({self.string(good)}, 'abk', 'AB')", "$p", "$q + 1")

    def test(self, good):
        return self.pick("@price &gt; 5", "@tag = 'k'", "@tag", "not(@price)", "@n mod 2 = 1", "position() = last()", lambda: f"{self.string(good)} = {self.string(good)}") if good else self.pick("good", "good/@price = '10'", "good/@price &gt; 9", "@name != 'B'", "@kind and @name", "count(good) &gt; 2", "not(good[@tag = 'z'])", "text()", lambda: f"contains({self.string(good)}, 'a')")

    def body(self, good, deep=0):
        return "".join(self.item(good, deep) for _ in range(self.r.randint(1, 3)))

    def item(self, good, deep):
        value = lambda: f'<xsl:value-of select="{self.string(good)}"/>'
        if deep > 2:
            return value()
        inner = lambda: self.body(good, deep + 1)
        return self.pick(
            value, "text", lambda: f'<e a="{{{self.string(good)}}}" b="{{{{x}}}}">{inner()}</e>', lambda: f'<e><xsl:attribute name="c">{value()}</xsl:attribute>{inner()}</e>', lambda: f'<e><xsl:if test="{self.test(good)}"><xsl:attribute name="d">1</xsl:attribute></xsl:if>{inner()}</e>',
            lambda: f'<xsl:if test="{self.test(good)}">{inner()}</xsl:if>', lambda: f'<xsl:choose><xsl:when test="{self.test(good)}">{inner()}</xsl:when><xsl:when test="{self.test(good)}">{inner()}</xsl:when><xsl:otherwise>{inner()}</xsl:otherwise></xsl:choose>',
            lambda: f"<xsl:comment>{value()}</xsl:comment>", lambda: '<xsl:processing-instruction name="p">' + value() + "</xsl:processing-instruction>", lambda: f'<xsl:variable name="v{deep}" select="{self.string(good)}"/><xsl:value-of select="$v{deep}"/>',
            '<xsl:call-template name="t"><xsl:with-param name="x" select="2 + 3"/></xsl:call-template>', '<xsl:copy-of select="."/>', "<xsl:copy>c</xsl:copy>", '<xsl:number format="01."/>' if good else '<xsl:number value="count(good)" format="(1)"/>',
            *(() if good else (lambda: f'<xsl:for-each select="good{self.where()}">{self.sorts()}{self.body(True, deep + 1)}</xsl:for-each>', lambda: f'<xsl:apply-templates select="good{self.where()}">{self.sorts()}</xsl:apply-templates>', "<xsl:apply-templates/>", '<xsl:apply-templates select="good" mode="m"/>')),
        )

    def where(self):
        return self.pick("", "", "[@price]", "[@price &gt; 5]", "[position() &lt; 3]", "[2]", "[last()]", "[@tag != 'k'][1]")

    def sorts(self):
        return "".join(self.pick("", '<xsl:sort select="@tag"/>', '<xsl:sort select="@price" data-type="number" order="descending"/>', '<xsl:sort select="@price"/>', '<xsl:sort select="@n" data-type="number"/>') for _ in range(2))

    def sheet(self):
        rules = f'<xsl:template match="shop">{self.body(False)}</xsl:template>'
        rules += self.pick("", lambda: f'<xsl:template match="good">{self.body(True, 1)}</xsl:template>', lambda: f'<xsl:template match="good[{self.pick("@tag", "@price = 10", "@n &gt; 1")}]">{self.body(True, 1)}</xsl:template>')
        rules += self.pick("", '<xsl:template match="text()">T</xsl:template>', '<xsl:template match="good" mode="m">M<xsl:value-of select="@n"/></xsl:template>')
        return '<xsl:param name="p"/><xsl:variable name="q" select="$p * 2"/>' + rules + '<xsl:template name="t"><xsl:param name="x"/><xsl:param name="y" select="$x + 1"/>[<xsl:value-of select="$y"/>]</xsl:template>' + self.pick("", "", '<xsl:output method="text"/>')


def test_random_sheets(shops):
    compiled = 0
    for seed in range(40):
        body = Sheets(seed).sheet()
        try:
            plan, document = both(shops, body, {"p": 3})
        except Unsupported:
            continue
        assert plan == document, (seed, body)
        compiled += 1
    assert compiled > 20


@pytest.mark.parametrize(
    "body",
    [
        "",
        '<xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template>',
        '<xsl:template match="/"><r><xsl:copy-of select="shop"/></r></xsl:template>',
        '<xsl:template match="@tag">#<xsl:value-of select="."/></xsl:template><xsl:template match="shop"><xsl:apply-templates select="@*"/><xsl:apply-templates/></xsl:template><xsl:template match="good"><xsl:apply-templates select="@tag|@n"/></xsl:template>',
        '<xsl:template match="shop[@kind]"><xsl:message>m<xsl:value-of select="@name"/></xsl:message>k</xsl:template><xsl:template match="shop" priority="-1"><xsl:message terminate="yes">stop</xsl:message></xsl:template>',
        '<xsl:template match="shop"><xsl:element name="{@name}">x</xsl:element></xsl:template>',
        '<xsl:attribute-set name="s"><xsl:attribute name="a"><xsl:value-of select="@kind"/></xsl:attribute></xsl:attribute-set><xsl:template match="shop"><e xsl:use-attribute-sets="s" z="1"/></xsl:template>',
        '<xsl:key name="k" match="good" use="@tag"/><xsl:template match="shop"><xsl:value-of select="concat(count(key(\'k\', \'k\')), sum(key(\'k\', \'j\')/@price))"/><xsl:for-each select="key(\'k\', \'K\')"><xsl:value-of select="@n"/></xsl:for-each></xsl:template>',
        '<xsl:template match="/shop/good[@price &gt; 8]">big</xsl:template><xsl:template match="//good">small</xsl:template>',
    ],
)
def test_sheets(shops, body):
    plan, document = both(shops, body)
    assert plan == document


def test_no_python_in_the_plan(shops):
    t = Transformer().import_stylesheet(HEAD + '<xsl:template match="shop"><xsl:for-each select="good"><xsl:sort select="@price"/><x n="{position()}"/></xsl:for-each></xsl:template></xsl:stylesheet>')
    plan = t.transform(shops)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("body", ['<xsl:key name="k" match="good" use="@n"/><xsl:template match="/"><xsl:value-of select="count(key(\'k\', 1 + 1))"/></xsl:template>', '<xsl:template name="r"><xsl:call-template name="r"/></xsl:template><xsl:template match="good[9]"><xsl:call-template name="r"/></xsl:template>', '<xsl:template match="/"><xsl:variable name="f"><a/></xsl:variable><xsl:value-of select="count($f/a)"/></xsl:template>'])
def test_other_sheets_run_per_document(shops, body):
    t = Transformer().import_stylesheet(HEAD + body + "</xsl:stylesheet>")
    with pytest.raises(Unsupported):
        t.transform(shops, tier="plan")
    assert all(r.xml is not None for r in t.transform(shops).collect())
