"""Registered queries over XML text: a document per customer, with namespaces, comments, instructions and awkward names, each query with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.api import Limits, Transformer, register_function, register_sql
from sylvan.plans import lift
from sylvan.plans.syntax import XPathSyntaxError, parse
from sylvan.operators.stylesheet import resolve
from sylvan.queries import add
from sylvan.sources.shred import shred

NAMES = {"c": "urn:c", "d": "urn:d"}
HEAD = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:c="urn:c" xmlns:d="urn:d">'


def customer_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, xml, seg)``: c:customer(@id @nation @seg) / comment, two instructions, c:name, d:name, and, or, div, mod, list / b*, i* (as many as nation mod 5)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    parts = [
        '<c:customer xmlns:c="urn:c" xmlns:d="urn:d" id="', "c_custkey", '" nation="', "c_nationkey", '" seg="', "c_mktsegment", '"><!--n', "c_custkey", "--><?mark m", "c_custkey", "?><?other o?><c:name>", "c_name", "</c:name><d:name>", "c_mktsegment",
        "</d:name><and>2</and><or>3</or><div>8</div><mod>4</mod><list> <b>é</b> <b>z</b> <b>A</b> <b>", "c_mktsegment", "</b> </list>",
    ]
    shown = [F.col(x).cast("string") if x.startswith("c_") else F.lit(x) for x in parts]
    return c.select(F.col("c_custkey").alias("doc_id"), F.concat(*shown, F.expr("repeat('<i/>', c_nationkey % 5)"), F.lit("</c:customer>")).alias("xml"), F.col("c_mktsegment").alias("seg"))


def twin(sql: str, where: str = "true") -> str:
    return f"SELECT c_custkey AS doc_id, {sql} AS value FROM (SELECT *, c_custkey::VARCHAR AS id, c_nationkey AS n, c_mktsegment AS seg FROM customer) WHERE {where}"


def found(name: str, expr: str, sql: str, kind: str = "string") -> None:
    """An expression's value per customer, by a plan over the node table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lift.evaluate(shred(customer_xml(spark, sf_dir)), expr, namespaces=NAMES).select("doc_id", F.col("value").cast(kind).alias("value"))

    add(name, run, twin(sql))


def sheet(name: str, body: str, sql: str, head: str = HEAD, end: str = "</xsl:stylesheet>", make=Transformer, then=None, value=None, **more) -> None:
    """A stylesheet's result per customer; ``failed`` where there is an error."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = make().import_stylesheet(head + body + end, "http://here/main")
        if then:
            then(t)
        out = t.transform(customer_xml(spark, sf_dir), **more)
        return out.select("doc_id", (F.coalesce("xml", F.lit("failed")) if value is None else value()).alias("value"))

    add(name, run, twin(sql))


TOP = '<xsl:template match="/">{}</xsl:template>'

found("q_ns_wildcard", "count(/c:customer/c:*) + 10 * count(//d:*)", "11::DOUBLE", "double")
found("q_ns_name", "concat(/c:customer/d:name, '|', /c:customer/c:name, '|', /c:customer/name, '|', count(//e:name))", "seg || '|' || c_name || '|' || c_name || '|0'")
found("q_pi", "count(//processing-instruction())", "2::DOUBLE", "double")
found("q_pi_name", "string(//processing-instruction('mark'))", "'m' || id")
found("q_comment", "string(//comment())", "'n' || id")
found("q_keyword_names", "/c:customer/and + /c:customer/or * /c:customer/div div /c:customer/mod - /*/div mod /*/or", "6::DOUBLE", "double")
found("q_true_false", "true() and not(false()) and true() != false()", "true", "boolean")
found("q_translate_computed", "translate(c:customer/c:name, 'Customer', //and)", "translate(c_name, 'Customer', '2')")
found("q_attribute_parent", "name(//@seg/..)", "'c:customer'")
found("q_cast_nodes", "count(//i) = (/*/@nation mod 5)", "true", "boolean")


def first_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.select_first(shred(customer_xml(spark, sf_dir)), "//c:customer/*", namespaces=NAMES).select("doc_id", F.concat("name", F.lit(":"), "string_value").alias("value"))


add("q_select_first", first_nodes, twin("'c:name:' || c_name"))


def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_function("shout", lambda x: F.concat(F.upper(x), F.lit("!")), lambda x: x.upper() + "!")
    return lift.evaluate(shred(customer_xml(spark, sf_dir)), "shout(//c:name)", namespaces=NAMES).select("doc_id", "value")


add("q_register_function", own_function, twin("upper(c_name) || '!'"))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = customer_xml(spark, sf_dir)
    return docs.withColumn("xml", F.when(F.col("seg") == "BUILDING", F.replace("xml", F.lit("</list>"), F.lit(""))).otherwise(F.col("xml")))


add("q_parse_drop", lambda s, d: lift.evaluate(shred(broken(s, d), mode="DROPMALFORMED"), "string(/*/@id)").select("doc_id", "value"), twin("id", "seg <> 'BUILDING'"))
add("q_parse_keep", lambda s, d: lift.evaluate(shred(broken(s, d)), "count(/*)").select("doc_id", "value"), twin("CASE WHEN seg = 'BUILDING' THEN 0 ELSE 1 END::DOUBLE"))
add("q_parse_error_rows", lambda s, d: Transformer().import_stylesheet(HEAD + TOP.format("<xsl:value-of select=\"*/@id\"/>") + "</xsl:stylesheet>").transform(broken(s, d)).select("doc_id", F.coalesce("xml", F.regexp_extract("error", "^(mismatched tag)", 1)).alias("value")), twin("CASE WHEN seg = 'BUILDING' THEN 'mismatched tag' ELSE id END"))


def from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as one file each, read whole."""
    import tempfile

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    path = f"{top.rstrip('/')}/sylvan/regions-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    r.select(F.concat(F.lit('<region key="'), F.col("r_regionkey").cast("string"), F.lit('">\n<name>'), "r_name", F.lit("</name></region>")).alias("xml"), "r_regionkey").write.mode("overwrite").partitionBy("r_regionkey").text(path)
    files = spark.read.text(path, wholetext=True).select(F.col("r_regionkey").cast("long").alias("doc_id"), F.col("value").alias("xml"))
    return lift.evaluate(shred(files), "concat(/region/@key, normalize-space(/region))").select("doc_id", "value")


add("q_file_scan", from_files, "SELECT r_regionkey::BIGINT AS doc_id, r_regionkey || r_name AS value FROM region")


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark)
    customer_xml(spark, sf_dir).createOrReplaceTempView("customer_documents")
    return spark.sql("SELECT doc_id, ord, value FROM customer_documents, LATERAL xpath_eval(xml, '//list/b')")


add("q_xpath_eval", table_function, "SELECT c_custkey AS doc_id, ord, value FROM (SELECT c_custkey, unnest([1, 2, 3, 4])::BIGINT AS ord, unnest(['é', 'z', 'A', c_mktsegment]) AS value FROM customer)")


def syntax_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser says of bad expressions: the place of the fault."""
    rows = []
    for i, expr in enumerate(("a b", "1 +", "a[", "contains('a')", "@", "'open", "x::y")):
        try:
            parse(expr)
        except XPathSyntaxError as e:
            rows.append((i, e.position))
    return spark.createDataFrame(rows, "doc_id long, value long")


add("q_syntax_errors", syntax_errors, "SELECT unnest(range(0, 7))::BIGINT AS doc_id, unnest([2, 3, 2, 0, 1, 0, 0])::BIGINT AS value")

IF_BUILDING = '<xsl:if test="*/@seg = \'BUILDING\'">{}</xsl:if>ok'
FAILS = "CASE WHEN seg = 'BUILDING' THEN 'failed' ELSE 'ok' END"
sheet("q_error_rows", TOP.format(IF_BUILDING.format("<xsl:value-of select=\"contains('a')\"/>")), FAILS)
sheet("q_unknown_function", TOP.format(IF_BUILDING.format('<xsl:value-of select="nope(1)"/>')), FAILS)
sheet("q_unbound_variable", TOP.format(IF_BUILDING.format('<xsl:value-of select="$nope"/>')), FAILS)
sheet("q_endless_recursion", '<xsl:template name="r"><xsl:call-template name="r"/></xsl:template>' + TOP.format(IF_BUILDING.format('<xsl:call-template name="r"/>')), FAILS)
sheet("q_scalar_for_each", TOP.format(IF_BUILDING.format('<xsl:for-each select="1 + 1">x</xsl:for-each>')), FAILS)
sheet("q_sort_collate", TOP.format('<xsl:for-each select="//b"><xsl:sort select="."/><xsl:value-of select="."/></xsl:for-each>'), "'A' || CASE WHEN seg < 'E' THEN seg || 'é' ELSE 'é' || seg END || 'z'")
sheet("q_sort_case", TOP.format('<xsl:for-each select="//b[. != \'z\']"><xsl:sort select="." order="descending" case-order="lower-first" lang="fr"/><xsl:value-of select="."/></xsl:for-each>'), "CASE WHEN seg < 'E' THEN 'é' || seg ELSE seg || 'é' END || 'A'")
sheet("q_output_decl", '<xsl:output omit-xml-declaration="no" encoding="US-ASCII" doctype-system="c.dtd" cdata-section-elements="n"/>' + TOP.format('<r><n><xsl:value-of select="*/@seg"/></n><xsl:value-of select="//b"/></r>'), """'<?xml version="1.0" encoding="US-ASCII"?><!DOCTYPE r SYSTEM "c.dtd"><r><n><![CDATA[' || seg || ']]></n>&#233;</r>'""")
sheet("q_output_indent", '<xsl:output indent="yes"/>' + TOP.format('<r><a><xsl:value-of select="*/@id"/></a><b><c/></b></r>'), "'<r>' || chr(10) || '  <a>' || id || '</a>' || chr(10) || '  <b>' || chr(10) || '    <c/>' || chr(10) || '  </b>' || chr(10) || '</r>'")
sheet("q_output_html", '<xsl:output method="html" doctype-public="-//X//Y"/>' + TOP.format('<html><br/><p/><script>a &lt; <xsl:value-of select="*/@id"/></script></html>'), """'<!DOCTYPE html PUBLIC "-//X//Y"><html><br><p></p><script>a < ' || id || '</script></html>'""")
sheet("q_document_mode", TOP.format('<r/><xsl:if test="*/@seg = \'BUILDING\'"><s/></xsl:if>'), "CASE WHEN seg = 'BUILDING' THEN 'failed' ELSE '<r/>' END", mode="document")
sheet("q_pretty", TOP.format('<r><a><b/></a><c><xsl:value-of select="*/@id"/></c></r>'), "'<r>' || chr(10) || '  <a>' || chr(10) || '    <b/>' || chr(10) || '  </a>' || chr(10) || '  <c>' || id || '</c>' || chr(10) || '</r>'", indented=True)
sheet("q_literal_root", "<xsl:value-of select=\"*/@id\"/>", "'<o n=\"' || (2 + n) || '\">' || id || '</o>'", head='<o xsl:version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" n="{2 + */@nation}">', end="</o>")
sheet("q_decimal_format", '<xsl:decimal-format name="eu" decimal-separator="," grouping-separator="."/>' + TOP.format("<xsl:value-of select=\"format-number(*/@nation * 1234.5, '#.##0,00', 'eu')\"/>"), "replace(replace(replace(format('{:,.2f}', n * 1234.5::DOUBLE), ',', '_'), '.', ','), '_', '.')")
sheet("q_namespace_alias", '<xsl:namespace-alias stylesheet-prefix="d" result-prefix="c"/>' + TOP.format('<d:x id="{*/@id}"/>'), "'<c:x xmlns:c=\"urn:c\" id=\"' || id || '\"/>'")
sheet("q_strip_space", '<xsl:strip-space elements="*"/>' + TOP.format('<xsl:value-of select="count(//list/text())"/>'), "'0'")
sheet("q_preserve_space", '<xsl:strip-space elements="*"/><xsl:preserve-space elements="list"/>' + TOP.format('<xsl:value-of select="count(//list/text())"/>'), "'5'")
sheet("q_namespaces", TOP.format('<xsl:value-of select="concat(count(//c:name), name(/*), namespace-uri(/*), local-name(/*))"/>'), "'1c:customerurn:ccustomer'")
sheet("q_xsl_prefix", TOP.format('<xsl:value-of select="*/@id"/>'), "id", head='<xsl:stylesheet version="1.0" xmlns:xsl="urn:something-else">')
sheet("q_absolute_pattern", '<xsl:template match="/c:customer/list/b">[<xsl:value-of select="."/>]</xsl:template><xsl:template match="//i">.</xsl:template><xsl:template match="b|and|or|div|mod|c:name|d:name|comment()"/>', "' [é] [z] [A] [' || seg || '] ' || repeat('.', n % 5)")
sheet("q_parentless", '<xsl:template match="/">(<xsl:apply-templates select="*/@id"/>)</xsl:template><xsl:template match="@id">#<xsl:value-of select="."/></xsl:template><xsl:template match="c:customer">never</xsl:template>', "'(#' || id || ')'")
sheet("q_pattern_error", '<xsl:template match="b[nope(.)]">never</xsl:template><xsl:template match="b[">never</xsl:template><xsl:template match="b" priority="-2">b</xsl:template>' + TOP.format('<xsl:apply-templates select="//b"/>'), "'bbbb'")
sheet("q_fallback", TOP.format('<xsl:nonsense><xsl:fallback>f<xsl:value-of select="*/@id"/></xsl:fallback></xsl:nonsense><xsl:fallback>no</xsl:fallback>'), "'f' || id")
sheet("q_unknown_instruction", TOP.format('a<xsl:nonsense>x</xsl:nonsense>b'), "'ab: unknown instruction xsl:nonsense'", value=lambda: F.concat("xml", F.lit(": "), F.array_join("messages", ",")))
sheet("q_xml_space", TOP.format('<r xml:space="preserve"> <a/> </r><s> <a/> </s>'), "'<r xml:space=\"preserve\"> <a/> </r><s><a/></s>'")
sheet("q_number_any", '<xsl:template match="i"><xsl:number level="any" count="b|i" format="1."/></xsl:template><xsl:template match="c:customer"><xsl:apply-templates select="i"/></xsl:template>', "array_to_string(list_transform(range(5, 5 + n % 5), lambda x: x || '.'), '')")
sheet("q_number_multiple", '<xsl:template match="b"><xsl:number level="multiple" count="list|b" format="1.a "/></xsl:template><xsl:template match="c:customer"><xsl:apply-templates select="list/b"/></xsl:template>', "'1.a 1.b 1.c 1.d '")
sheet("q_current", TOP.format('<xsl:for-each select="//list/b"><xsl:value-of select="count(//b[. = current()])"/></xsl:for-each>'), "'1111'")
sheet("q_copy_attributes", TOP.format('<r><xsl:copy-of select="*/@*"/><xsl:copy-of select="//and"/></r>'), "'<r id=\"' || id || '\" nation=\"' || n || '\" seg=\"' || seg || '\"><and>2</and></r>'")
sheet("q_messages", TOP.format('<xsl:message>hi <xsl:value-of select="*/@id"/></xsl:message>x'), "'hi ' || id", value=lambda: F.array_join("messages", ","))
sheet("q_subtree_source", '<xsl:template match="list"><xsl:value-of select="concat(count(b), ../@id)"/></xsl:template>', "'4' || id", at="//list")

LIBRARY = {"http://here/lib/a": '<xsl:import href="b"/>', "http://here/lib/b": '<xsl:template match="/">b<xsl:value-of select="*/@id"/></xsl:template>'}
sheet("q_relative_uri", '<xsl:include href="lib/a"/>', "'b' || id", make=lambda: Transformer(loader=lambda href, base: HEAD + LIBRARY[resolve(href, base)] + "</xsl:stylesheet>"))
sheet("q_limit_nodes", TOP.format('<xsl:value-of select="count(/*/i)"/>'), "CASE WHEN n % 5 > 3 THEN 'failed' ELSE (n % 5)::VARCHAR END", make=lambda: Transformer(limits=Limits(nodes=3)))
sheet("q_limit_depth", TOP.format(IF_BUILDING.format('<xsl:value-of select="((((((1))))))"/>')), FAILS, make=lambda: Transformer(limits=Limits(depth=5)))
sheet("q_limit_literal", TOP.format(IF_BUILDING.format("<xsl:value-of select=\"'abcdefghij'\"/>")), FAILS, make=lambda: Transformer(limits=Limits(literal=9)))


def parameters(t: Transformer) -> None:
    """Set, read, removed, cleared and set again."""
    t.set_parameter(None, "p", "gone")
    t.set_parameter("urn:x", "p", "other")
    assert t.get_parameter(None, "p") == "gone" and t.get_parameter("urn:x", "p") == "other" and t.get_parameter(None, "q") == ""
    t.remove_parameter(None, "p")
    t.clear_parameters()
    t.set_parameter(None, "q", 7)


sheet("q_parameters", '<xsl:param name="p" select="\'default\'"/><xsl:param name="q"/>' + TOP.format('<xsl:value-of select="concat($p, $q + 1)"/>'), "'default8'", then=parameters)


def reset(t: Transformer) -> None:
    t.set_parameter(None, "q", 1)
    t.reset()
    t.import_stylesheet(HEAD + '<xsl:param name="q" select="0"/>' + TOP.format('<xsl:value-of select="concat($q, */@id)"/>') + "</xsl:stylesheet>")


sheet("q_reset", TOP.format("x"), "'0' || id", then=reset)
sheet("q_own_function_sheet", TOP.format('<xsl:value-of select="shout(*/@seg)"/>'), "seg || '!'", then=lambda t: register_function("shout", lambda x: F.concat(F.upper(x), F.lit("!")), lambda x: x.upper() + "!"))
