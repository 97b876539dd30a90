import pytest

from sylvan.api import Transformer
from sylvan.operators.stylesheet import Stylesheet, StylesheetError, format_number, parsed, serialize

HEAD = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">'
DOC = '<root><item g="b">B2</item><item g="a">A10</item><item g="a">C1</item></root>'


def run(body, doc=DOC, params=None, loader=None):
    s = Stylesheet(HEAD + body + "</xsl:stylesheet>", loader)
    return serialize(s.run(parsed(doc), params)[0], s.output)


@pytest.mark.parametrize(
    "body,wanted",
    [
        ("", "B2A10C1"),
        ('<xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template>', DOC),
        ('<xsl:template match="/"><xsl:for-each select="//item"><xsl:sort select="."/><xsl:value-of select="position()"/><xsl:value-of select="."/></xsl:for-each></xsl:template>', "1A102B23C1"),
        ('<xsl:key name="k" match="item" use="@g"/><xsl:template match="/"><xsl:value-of select="count(key(\'k\', \'a\'))"/></xsl:template>', "2"),
        ('<xsl:template match="item"><xsl:number format="i"/>;</xsl:template>', "i;ii;iii;"),
        ('<xsl:template match="item">1</xsl:template><xsl:template match="item">2</xsl:template>', "222"),
        ('<xsl:template match="root/item[2]">x</xsl:template><xsl:template match="item"/>', "x"),
        ('<xsl:template match="/"><xsl:variable name="f"><a>1</a><a>2</a></xsl:variable><xsl:value-of select="sum($f/a)"/></xsl:template>', "3"),
        ('<xsl:strip-space elements="*"/><xsl:template match="/"><a b="{{{1 + 1}}}"/></xsl:template>', '<a b="{2}"/>'),
    ],
)
def test_bodies(body, wanted):
    assert run(body) == wanted


def test_import_precedence_and_parameters():
    library = {"b": HEAD + '<xsl:template match="item">b</xsl:template></xsl:stylesheet>'}
    assert run('<xsl:import href="b"/><xsl:template match="item[1]">[<xsl:apply-imports/>]</xsl:template>', loader=lambda h, _: library[h]) == "[b]bb"
    assert run('<xsl:param name="p" select="1"/><xsl:template match="/"><xsl:value-of select="$p + 1"/></xsl:template>', params={"p": 41}) == "42"
    with pytest.raises(StylesheetError):
        run('<xsl:include href="x"/>', loader=lambda h, _: library[h])


def test_format_number():
    assert format_number(1234.5, "#,##0.00", {}) == "1,234.50"
    assert format_number(-0.256, "0.0%", {}) == "-25.6%"
    assert format_number(float("nan"), "0", {}) == "NaN"


def test_transformer(spark):
    t = Transformer().import_stylesheet(HEAD + '<xsl:param name="p"/><xsl:template match="/"><r><xsl:value-of select="$p"/></r></xsl:template><xsl:template name="loop"><xsl:call-template name="loop"/></xsl:template></xsl:stylesheet>')
    t.set_parameter(None, "p", "v")
    assert t.get_parameter(None, "p") == "v" and t.get_parameter(None, "q") == ""
    rows = {r.doc_id: r for r in t.transform(spark.createDataFrame([(1, "<a/>"), (2, "<a>"), (3, None)], "doc_id long, xml string"), mode="document").collect()}
    assert rows[1].xml == "<r>v</r>" and rows[2].xml is None and rows[2].error and rows[3].error
    t.remove_parameter(None, "p")
    t.reset()
    with pytest.raises(RuntimeError):
        t.transform(spark.createDataFrame([], "doc_id long, xml string"))


def test_stream(spark, tmp_path):
    from sylvan.streaming.transforms import document_stream, transform_stream

    spark.createDataFrame([(1, "<a>x</a>")], "doc_id long, xml string").write.parquet(str(tmp_path / "in"))
    t = Transformer().import_stylesheet(HEAD + "</xsl:stylesheet>")
    q = transform_stream(document_stream(spark, str(tmp_path / "in")), t, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [r.xml for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]
