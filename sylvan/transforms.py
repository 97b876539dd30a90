"""Registered stylesheet queries over orders, by plans where the stylesheet allows it, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.api import Shape, Transformer
from sylvan.queries import LI, add
from sylvan.sources.relational import decimal, text

XSL = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">'


def order_shape(spark: SparkSession, sf_dir: str) -> Shape:
    """One document per order: order(@id @status @total)/lineitem(@n @part @qty @flag)*, in the order tree's order."""
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    lines = Shape(li.withColumnRenamed("l_orderkey", "doc_id"), "lineitem", [("n", text(F.col("l_linenumber"))), ("part", text(F.col("l_partkey"))), ("qty", decimal(F.col("l_quantity"))), ("flag", F.col("l_returnflag"))], ["doc_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return Shape(o.withColumnRenamed("o_orderkey", "doc_id"), "order", [("id", text(F.col("doc_id"))), ("status", F.col("o_orderstatus")), ("total", decimal(F.col("o_totalprice")))], ["doc_id"], children=[lines])


def sheet(name: str, body: str, sql: str, params: dict | None = None, library: dict[str, str] | None = None) -> None:
    """A stylesheet over all orders as (doc_id, value). ``sql``: a value per order, over ``t(doc_id, status, total, each(item expression))``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Transformer(loader=(lambda href, base: XSL + library[href] + "</xsl:stylesheet>") if library else None).import_stylesheet(XSL + body + "</xsl:stylesheet>")
        for k, v in (params or {}).items():
            t.set_parameter(None, k, v)
        return t.transform(order_shape(spark, sf_dir)).select("doc_id", F.coalesce("xml", "error").alias("value"))

    add(name, run, f"WITH {LI} SELECT o_orderkey AS doc_id, {sql} AS value FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_totalprice")


def each(expr: str, by: str = "i", where: str = "l_orderkey IS NOT NULL") -> str:
    return f"coalesce(string_agg({expr}, '' ORDER BY {by}) FILTER ({where}), '')"


TOTAL = "regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', '')"
ONE = '<xsl:template match="order">{}</xsl:template>'
EACH = '<xsl:for-each select="lineitem">{}</xsl:for-each>'
GIVES = '<lineitem n="\' || l_linenumber || \'" part="\' || l_partkey || \'" qty="\' || qty || \'" flag="\' || l_returnflag || \'"/>'
WHOLE = f"'<order id=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\" total=\"' || {TOTAL} || CASE WHEN count(l_orderkey) = 0 THEN '\"/>' ELSE '\">' || {each(chr(39) + GIVES + chr(39))} || '</order>' END"

sheet("q_valueof", ONE.format('<xsl:value-of select="@total * 2"/>'), "regexp_replace(printf('%.2f', o_totalprice * 2), '\\.?0+$', '')")
sheet("q_lre_avt", ONE.format('<o key="{@id}-{@status}" n="{{{count(lineitem)}}}"/>'), "'<o key=\"' || o_orderkey || '-' || o_orderstatus || '\" n=\"{' || count(l_orderkey) || '}\"/>'")
sheet("q_element_attr", ONE.format('<xsl:element name="s{@status}"><xsl:attribute name="id"><xsl:value-of select="@id"/></xsl:attribute>x</xsl:element>'), "'<s' || o_orderstatus || ' id=\"' || o_orderkey || '\">x</s' || o_orderstatus || '>'")
sheet("q_if", ONE.format('<r><xsl:if test="@total &gt; 1000">big</xsl:if></r>'), "CASE WHEN o_totalprice > 1000 THEN '<r>big</r>' ELSE '<r/>' END")
sheet("q_choose", ONE.format('<xsl:choose><xsl:when test="@status = \'F\'">done</xsl:when><xsl:when test="@status = \'O\'">open</xsl:when><xsl:otherwise>other</xsl:otherwise></xsl:choose>'), "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END")
sheet("q_foreach", ONE.format(EACH.format('<l n="{position()}" of="{last()}"><xsl:value-of select="@part"/></l>')), each("'<l n=\"' || i || '\" of=\"' || k || '\">' || l_partkey || '</l>'"))
sheet("q_sort_num", ONE.format(EACH.format('<xsl:sort select="@qty" data-type="number" order="descending"/><xsl:value-of select="@qty"/>,')), each("qty || ','", "l_quantity DESC, i"))
sheet("q_sort_text", ONE.format(EACH.format('<xsl:sort select="@flag"/><xsl:value-of select="@flag"/>')), each("l_returnflag", "l_returnflag, i"))
sheet("q_sort_multi", ONE.format(EACH.format('<xsl:sort select="@flag"/><xsl:sort select="@part" data-type="number"/><xsl:value-of select="concat(@flag, @part, \' \')"/>')), each("l_returnflag || l_partkey || ' '", "l_returnflag, l_partkey, i"))
sheet("q_apply", ONE.format('<o><xsl:apply-templates/></o>') + '<xsl:template match="lineitem"><l><xsl:value-of select="@n"/></l></xsl:template>', f"CASE WHEN count(l_orderkey) = 0 THEN '<o/>' ELSE '<o>' || {each(chr(39) + '<l>' + chr(39) + ' || l_linenumber || ' + chr(39) + '</l>' + chr(39))} || '</o>' END")
sheet("q_mode", ONE.format('<xsl:apply-templates select="lineitem" mode="a"/>|<xsl:apply-templates select="lineitem" mode="b"/>') + '<xsl:template match="lineitem" mode="a"><xsl:value-of select="@n"/></xsl:template><xsl:template match="lineitem" mode="b"><xsl:value-of select="@flag"/></xsl:template>', f"{each('l_linenumber::VARCHAR')} || '|' || {each('l_returnflag')}")
sheet("q_priority", '<xsl:template match="lineitem" priority="0.2">L</xsl:template><xsl:template match="*">-<xsl:apply-templates/></xsl:template><xsl:template match="lineitem[@flag=\'R\']">R</xsl:template>', f"'-' || {each('CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN ' + chr(39) + 'R' + chr(39) + ' ELSE ' + chr(39) + 'L' + chr(39) + ' END')}")
sheet("q_import", '<xsl:import href="base"/><xsl:template match="lineitem[@flag=\'R\']">(<xsl:apply-imports/>)</xsl:template>', each("CASE WHEN l_returnflag = 'R' THEN '(' || l_linenumber || ')' ELSE l_linenumber::VARCHAR END"), library={"base": '<xsl:include href="more"/>', "more": '<xsl:template match="lineitem"><xsl:value-of select="@n"/></xsl:template>'})
sheet("q_call", ONE.format('<xsl:call-template name="show"><xsl:with-param name="x" select="@id"/></xsl:call-template>') + '<xsl:template name="show"><xsl:param name="x"/><xsl:param name="y" select="\'-\'"/><xsl:value-of select="concat($y, $x)"/></xsl:template>', "'-' || o_orderkey")
sheet("q_params", '<xsl:param name="least" select="0"/><xsl:variable name="twice" select="$least * 2"/>' + ONE.format('<xsl:value-of select="count(lineitem[@qty &gt;= $twice])"/>'), "(count(*) FILTER (l_quantity >= 40))::VARCHAR", {"least": 20})
sheet("q_builtin", '<xsl:template match="lineitem">.</xsl:template>', each("'.'"))
sheet("q_copy", '<xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template>', WHOLE)
sheet("q_copyof", '<xsl:template match="/"><xsl:copy-of select="order"/></xsl:template>', WHOLE)
sheet("q_comment_pi", ONE.format('<xsl:comment>c<xsl:value-of select="@id"/></xsl:comment><xsl:processing-instruction name="p">d</xsl:processing-instruction>'), "'<!--c' || o_orderkey || '--><?p d?>'")
sheet("q_number_fmt", '<xsl:template match="lineitem"><xsl:number format="01"/><xsl:number format="a"/><xsl:number format="I"/>;</xsl:template>', each("lpad(i::VARCHAR, 2, '0') || chr((96 + i)::INTEGER) || ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][i] || ';'"))
sheet("q_key", '<xsl:key name="by" match="lineitem" use="@flag"/>' + ONE.format('<xsl:value-of select="count(key(\'by\', \'R\'))"/>'), "(count(*) FILTER (l_returnflag = 'R'))::VARCHAR")
sheet("q_attribute_set", '<xsl:attribute-set name="s"><xsl:attribute name="a">1</xsl:attribute></xsl:attribute-set>' + ONE.format('<x xsl:use-attribute-sets="s" b="{@id}"/>'), "'<x a=\"1\" b=\"' || o_orderkey || '\"/>'")
sheet("q_fragment_variable", ONE.format('<xsl:variable name="f">' + EACH.format('<v><xsl:value-of select="@qty"/></v>') + '</xsl:variable><xsl:value-of select="sum($f/v) &gt; 100"/>'), "CASE WHEN coalesce(sum(l_quantity), 0) > 100 THEN 'true' ELSE 'false' END")
sheet("q_message", ONE.format('<xsl:if test="@status = \'F\'"><xsl:message terminate="yes">stop</xsl:message></xsl:if>go'), "CASE WHEN o_orderstatus = 'F' THEN 'stop' ELSE 'go' END")
sheet("q_text_output", '<xsl:output method="text"/>' + ONE.format('<a>&lt;<xsl:text disable-output-escaping="yes">&amp;</xsl:text></a><xsl:value-of select="@id"/>'), "'<&' || o_orderkey")
sheet("q_recursive_call", ONE.format('<xsl:call-template name="join"><xsl:with-param name="rest" select="lineitem"/></xsl:call-template>') + '<xsl:template name="join"><xsl:param name="rest"/><xsl:if test="$rest"><xsl:value-of select="$rest[1]/@n"/><xsl:if test="count($rest) &gt; 1">,</xsl:if><xsl:call-template name="join"><xsl:with-param name="rest" select="$rest[position() &gt; 1]"/></xsl:call-template></xsl:if></xsl:template>', "coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY i) FILTER (l_orderkey IS NOT NULL), '')")
sheet("q_simplified", ONE.format('<xsl:number value="count(lineitem)" format="(1)"/>'), "'(' || count(l_orderkey) || ')'")
