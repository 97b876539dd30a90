"""Registered queries over the trees of the relational tables, pages and texts, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.plans import lift
from sylvan.session import tuned
from sylvan.sources.relational import Forest, conv_tree, geo_tree, order_tree
from sylvan.sources.shred import page_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def hundredths(c: Column) -> Column:
    """A number to two places as SQL's round() has it: the hundredfold, as a double, to a whole number, halves away from zero. Spark's rounds the number's decimal text, in which 0.575 is a half."""
    hundred = F.abs(c) * 100
    return F.when(hundred == float("inf"), c).otherwise(F.signum(c) * F.round(hundred) / 100)


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(tuned(spark), sf_dir)
    if sql:
        ORACLES[name] = sql


def nodes(name: str, tree, expr: str, sql: str, **more) -> None:
    """A node-set as (doc_id, pre, value): the string-value of each node."""
    add(name, lambda s, d: lift.select(tree(s, d), expr, **more).select("doc_id", F.col("pre").cast("long").alias("pre"), F.col("string_value").alias("value")), sql)


def value(name: str, tree, expr: str, sql: str | None, kind: str = "double", **more) -> None:
    """A value per document as (doc_id, value)."""
    shown = hundredths if kind == "double" else lambda c: c
    add(name, lambda s, d: lift.evaluate(tree(s, d), expr, **more).select("doc_id", shown(F.col("value").cast(kind)).alias("value")), sql)


def per_node(name: str, tree, path: str, expr: str, sql: str, kind: str = "string") -> None:
    """A value per node of ``path``."""

    def run(spark, sf_dir):
        forest = tree(spark, sf_dir)
        found = lift.select(forest, path, carry=expr).withColumn("iter", F.struct("doc_id", "pre")).drop("string_value")
        out = lift.evaluate(forest, expr, context=found)
        shown = hundredths(F.col("value").cast("double")) if kind == "double" else F.col("value").cast(kind)
        return out.select("doc_id", F.col("iter.pre").cast("long").alias("pre"), shown.alias("value"))

    add(name, run, sql)


def texts(spark: SparkSession, sf_dir: str) -> tuple[Forest, DataFrame]:
    """Each document's text as a document node with a text: ``.`` is the text."""
    from sylvan.sources.relational import DOCUMENT, node

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", node(F.lit(0), F.lit(0), F.lit(None), 0, DOCUMENT, None, te=F.length("text")).alias("n")).select("doc_id", "n.*")
    return Forest(rows, docs.select("doc_id", F.lit(None).cast("string").alias("uri"), "text")), docs


def on_text(name: str, expr: str, sql: str, kind: str = "string") -> None:
    value(name, lambda s, d: texts(s, d)[0], expr, f"SELECT doc_id, {sql} AS value FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)", kind)


# Line items with their place in the order's document, as the tree builder numbers them.
LI = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i,
 count(*) OVER (PARTITION BY l_orderkey) AS k, 7 + (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) * 9 AS pre,
 regexp_replace(printf('%.2f', l_quantity), '\\.?0+$', '') AS qty, regexp_replace(printf('%.2f', l_extendedprice), '\\.?0+$', '') AS price FROM lineitem)""".replace("\\\\", "\\")
# The geographic tree's nodes with their ranks.
GEO = """g0 AS (SELECT n_regionkey AS r, n_nationkey AS n, s_suppkey AS s, 4 AS size, 3 AS deep, s_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, n_nationkey, -1, 3, 2, n_name FROM nation UNION ALL SELECT r_regionkey, -1, -1, 3, 1, r_name FROM region),
g AS (SELECT *, (sum(size) OVER (ORDER BY r, n, s) - size + 2)::BIGINT AS pre FROM g0)"""


def li(name: str, expr: str, pre: str, val: str, where: str = "true") -> None:
    nodes(name, order_tree, expr, f"WITH {LI} SELECT l_orderkey AS doc_id, ({pre})::BIGINT AS pre, {val} AS value FROM li WHERE {where}")


li("q_child", "/order/lineitem", "pre", "''")
li("q_attribute", "//lineitem/@qty", "pre + 4", "qty")
li("q_self", "//lineitem/self::lineitem", "pre", "''")
li("q_pos_n", "/order/lineitem[1]/@qty", "pre + 4", "qty", "i = 1")
li("q_pos_last", "/order/lineitem[last()]/@qty", "pre + 4", "qty", "i = k")
li("q_pos_le", "/order/lineitem[position() <= 2]/@part", "pre + 2", "l_partkey::VARCHAR", "i <= 2")
li("q_pos_chain", "/order/lineitem[@flag='R'][2]/@n", "pre + 1", "l_linenumber::VARCHAR", "l_returnflag = 'R' AND (SELECT count(*) FROM li x WHERE x.l_orderkey = li.l_orderkey AND x.l_returnflag = 'R' AND x.i <= li.i) = 2")
li("q_filter_expr", "(//lineitem)[3]", "pre", "''", "i = 3")
li("q_pred_attr", "//lineitem[@flag='R']/@price", "pre + 5", "price", "l_returnflag = 'R'")
li("q_pred_and_or", "//lineitem[@flag='R' and (@qty > 40 or @n = 1)]/@n", "pre + 1", "l_linenumber::VARCHAR", "l_returnflag = 'R' AND (l_quantity > 40 OR l_linenumber = 1)")
li("q_rel_ops", "//lineitem[@qty >= 25][@qty < 30]/@qty", "pre + 4", "qty", "l_quantity >= 25 AND l_quantity < 30")
li("q_wildcard_attr", "//lineitem[@*[. = 'R']]/@flag", "pre + 8", "l_returnflag", "l_returnflag = 'R'")
li("q_preceding_sibling_pos", "/order/lineitem[last()]/preceding-sibling::lineitem[1]/@n", "pre + 1", "l_linenumber::VARCHAR", "i = k - 1")
ORD = "SELECT o_orderkey AS doc_id, 1::BIGINT AS pre, '' AS value FROM orders"
nodes("q_parent", order_tree, "//lineitem/..", f"{ORD} WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
nodes("q_pred_exists", order_tree, "/order[lineitem]", f"{ORD} WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
nodes("q_pred_not", order_tree, "/order[not(lineitem/@flag = 'R')]", f"{ORD} WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
nodes("q_nodeset_cmp_sets", order_tree, "/order[lineitem/@part = lineitem/@supp]", f"{ORD} WHERE EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_suppkey WHERE a.l_orderkey = o_orderkey)")
nodes("q_absolute_root", order_tree, "/", "SELECT o_orderkey AS doc_id, 0::BIGINT AS pre, '' AS value FROM orders")

PER = "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
value("q_count", order_tree, "count(/order/lineitem)", f"SELECT o_orderkey AS doc_id, count(l_orderkey)::DOUBLE AS value {PER}")
value("q_sum", order_tree, "sum(//lineitem/@qty)", f"SELECT o_orderkey AS doc_id, round(coalesce(sum(l_quantity), 0), 2)::DOUBLE AS value {PER}")
value("q_avg_idiom", order_tree, "sum(//lineitem/@qty) div count(//lineitem)", f"SELECT o_orderkey AS doc_id, CASE WHEN count(l_orderkey) = 0 THEN 'nan'::DOUBLE ELSE round(sum(l_quantity) / count(l_orderkey), 2)::DOUBLE END AS value {PER}")
value("q_ratio", order_tree, "count(//lineitem[@flag='R']) div count(//lineitem)", f"SELECT o_orderkey AS doc_id, CASE WHEN count(l_orderkey) = 0 THEN 'nan'::DOUBLE ELSE round(count(*) FILTER (l_returnflag = 'R') / count(l_orderkey), 2)::DOUBLE END AS value {PER}")
value("q_nodeset_cmp", order_tree, "//lineitem/@part = //lineitem/@supp", f"SELECT o_orderkey AS doc_id, EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_suppkey WHERE a.l_orderkey = o_orderkey) AS value FROM orders", "boolean")
value("q_nodeset_ne", order_tree, "//lineitem/@flag != 'R'", "SELECT o_orderkey AS doc_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') AS value FROM orders", "boolean")
value("q_nodeset_lt", order_tree, "//lineitem/@qty < /order/lineitem[1]/@qty", f"WITH {LI} SELECT o_orderkey AS doc_id, EXISTS (SELECT 1 FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.i = 1 AND a.l_quantity < b.l_quantity WHERE a.l_orderkey = o_orderkey) AS value FROM orders", "boolean")
value("q_names", order_tree, "concat(name(/*), '|', local-name(//lineitem), '|', namespace-uri(/*))", "SELECT o_orderkey AS doc_id, 'order|' || CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'lineitem' ELSE '' END || '|' AS value FROM orders", "string")
value("q_string_first", order_tree, "string(//lineitem/@part)", f"WITH {LI} SELECT o_orderkey AS doc_id, coalesce(l_partkey::VARCHAR, '') AS value FROM orders LEFT JOIN li ON l_orderkey = o_orderkey AND i = 1", "string")
value("q_id", order_tree, "count(id(/order/@id))", "SELECT o_orderkey AS doc_id, 1::DOUBLE AS value FROM orders")
value("q_namespace_empty", order_tree, "count(//namespace::*)", "SELECT o_orderkey AS doc_id, 0::DOUBLE AS value FROM orders")
value("q_variables", order_tree, "count(//lineitem[@qty > $least])", f"SELECT o_orderkey AS doc_id, (count(*) FILTER (l_quantity > 30))::DOUBLE AS value {PER}", variables={"least": 30})
value("q_logic", order_tree, "/order/@status = 'F' and not(//lineitem/@flag = 'R') or count(//lineitem) = 1", "SELECT o_orderkey AS doc_id, (o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) OR (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) = 1 AS value FROM orders", "boolean")
value("q_format_number", order_tree, "format-number(/order/@total, '#,##0.00')", "SELECT o_orderkey AS doc_id, format('{:,.2f}', o_totalprice) AS value FROM orders", "string")
value("q_generate_id", order_tree, "generate-id(/order)", "SELECT o_orderkey AS doc_id, 'd' || o_orderkey || 'n1' AS value FROM orders", "string")


def per_line(name: str, expr: str, sql: str, kind: str = "double") -> None:
    per_node(name, order_tree, "//lineitem", expr, f"WITH {LI} SELECT l_orderkey AS doc_id, pre::BIGINT AS pre, {sql} AS value FROM li", kind)


per_line("q_arith", "@price * (1 + @n) - @qty", "round(l_extendedprice * (1 + l_linenumber) - l_quantity, 2)")
per_line("q_div_mod", "(@qty div 7) + (@qty mod 7)", "round(l_quantity / 7 + l_quantity % 7, 2)")
per_line("q_div_zero", "@qty div (@n - 1)", "CASE WHEN l_linenumber = 1 THEN CASE WHEN l_quantity = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE round(l_quantity / (l_linenumber - 1), 2) END")
per_line("q_unary", "-@qty", "-l_quantity")
per_line("q_round", "round(@price) + floor(@price) + ceiling(@price)", "floor(l_extendedprice + 0.5) + floor(l_extendedprice) + ceil(l_extendedprice)")
per_line("q_bool_conv", "boolean(@qty > 20) = (number(@n) > 2)", "(l_quantity > 20) = (l_linenumber > 2)", "boolean")
per_line("q_num_conv", "number(@flag = 'R') + number(@qty)", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END + l_quantity")
per_line("q_nan", "number(@flag)", "'nan'::DOUBLE")
per_line("q_position_count", "count(preceding-sibling::lineitem) + 1", "i::DOUBLE")

nodes("q_descendant", geo_tree, "//supplier", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre, '' AS value FROM g WHERE deep = 3")
nodes("q_descendant_or_self", geo_tree, "/world/region/descendant-or-self::*[@name]", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre, '' AS value FROM g")
nodes("q_ancestor", geo_tree, "//supplier/ancestor::region/@name", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre + 2 AS pre, label AS value FROM g WHERE deep = 1 AND r IN (SELECT r FROM g WHERE deep = 3)")
nodes("q_ancestor_pos", geo_tree, "//supplier/ancestor::*[1]/@name", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre + 2 AS pre, label AS value FROM g WHERE deep = 2 AND n IN (SELECT n FROM g WHERE deep = 3)")
nodes("q_ancestor_or_self", geo_tree, "//nation/ancestor-or-self::*[@key]/@key", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre + 1 AS pre, (CASE WHEN deep = 1 THEN r ELSE n END)::VARCHAR AS value FROM g WHERE deep = 2 OR deep = 1 AND r IN (SELECT r FROM g WHERE deep = 2)")
nodes("q_union", geo_tree, "//nation/@name | //region/@name", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre + 2 AS pre, label AS value FROM g WHERE deep < 3")
nodes("q_following", geo_tree, "//region[@key='1']/following::nation/@name", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre + 2 AS pre, label AS value FROM g WHERE deep = 2 AND r > 1")
nodes("q_preceding", geo_tree, "//region[@key='3']/preceding::nation/@name", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre + 2 AS pre, label AS value FROM g WHERE deep = 2 AND r < 3")
nodes("q_following_sibling_pos", geo_tree, "//nation/following-sibling::nation[1]/@name", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre + 2 AS pre, label AS value FROM g WHERE deep = 2 AND (r, n) NOT IN (SELECT r, min(n) FROM g WHERE deep = 2 GROUP BY r)")
nodes("q_wildcard", geo_tree, "/world/*/*", f"WITH {GEO} SELECT 0::BIGINT AS doc_id, pre, '' AS value FROM g WHERE deep = 2")
nodes("q_distinct_idiom", order_tree, "//lineitem[not(@flag = preceding-sibling::lineitem/@flag)]/@flag", f"WITH {LI} SELECT l_orderkey AS doc_id, (min(pre) + 8)::BIGINT AS pre, l_returnflag AS value FROM li GROUP BY l_orderkey, l_returnflag")
nodes("q_max_idiom", order_tree, "/order[lineitem]/lineitem[not(../lineitem/@qty > @qty)]/@qty", f"WITH {LI} SELECT l_orderkey AS doc_id, (pre + 4)::BIGINT AS pre, qty AS value FROM li WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem x WHERE x.l_orderkey = li.l_orderkey)")

CONV = "c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, 3 + (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 4 AS pre FROM conversations)"
nodes("q_following_sibling", conv_tree, "/conversation/turn[@role='user']/following-sibling::turn", f"WITH {CONV} SELECT conv_id AS doc_id, pre::BIGINT AS pre, text AS value FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.conv_id = c.conv_id AND x.role = 'user' AND x.turn < c.turn)")
nodes("q_preceding_sibling_1", conv_tree, "//turn[@role='assistant']/preceding-sibling::turn[1]/@role", f"WITH {CONV} SELECT conv_id AS doc_id, (pre + 2)::BIGINT AS pre, role AS value FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.conv_id = c.conv_id AND x.role = 'assistant' AND x.i = c.i + 1)")
nodes("q_text", conv_tree, "//turn/text()", f"WITH {CONV} SELECT conv_id AS doc_id, (pre + 3)::BIGINT AS pre, text AS value FROM c")
value("q_string_value", conv_tree, "string(/conversation)", "SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS value FROM conversations GROUP BY conv_id", "string")

on_text("q_concat", "concat(substring(., 1, 3), '-', string-length(.) > 100)", "substr(t, 1, 3) || '-' || CASE WHEN length(t) > 100 THEN 'true' ELSE 'false' END")
on_text("q_starts", "starts-with(., 'The')", "starts_with(t, 'The')", "boolean")
on_text("q_contains", "contains(., 'license')", "contains(t, 'license')", "boolean")
on_text("q_sbefore", "substring-before(., ' ')", "CASE WHEN strpos(t, ' ') = 0 THEN '' ELSE substr(t, 1, strpos(t, ' ') - 1) END")
on_text("q_safter", "substring-after(., ' ')", "CASE WHEN strpos(t, ' ') = 0 THEN '' ELSE substr(t, strpos(t, ' ') + 1) END")
on_text("q_substring", "substring(., 2.5, 10)", "substr(t, 3, 10)")
on_text("q_strlen", "string-length(.)", "length(t)::DOUBLE", "double")
on_text("q_normspace", "normalize-space(.)", r"regexp_replace(regexp_replace(t, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g')")
on_text("q_translate", "translate(., 'aeiou', 'AEI')", "translate(t, 'aeiou', 'AEI')")

value("q_nodetests", page_tree, "count(//comment()) + 100 * count(//a) + 10000 * count(//@href)", "SELECT page_id AS doc_id, (len(regexp_extract_all(html, '<!--')) + 100 * len(regexp_extract_all(html, '<a ')) + 10000 * len(regexp_extract_all(html, ' href=')))::DOUBLE AS value FROM pages")
value("q_lang", page_tree, "count(//div[lang('fr')])", "SELECT page_id AS doc_id, CASE WHEN regexp_extract(html, '<html lang=\"(\\w+)\"', 1) = 'fr' THEN len(regexp_extract_all(html, '<div')) ELSE 0 END::DOUBLE AS value FROM pages".replace("\\\\", "\\"))
value("q_html_names", page_tree, "count(//meta/@charset) + count(/html/head/title)", "SELECT page_id AS doc_id, (len(regexp_extract_all(html, ' charset=')) + len(regexp_extract_all(html, '<title')))::DOUBLE AS value FROM pages")
