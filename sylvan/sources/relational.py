"""Trees over relational tables, by window arithmetic: no XML text is made or parsed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The node table: attributes follow their element; ``last`` is the largest rank in the subtree; ts and te bound the node's text in docs.text.
NODES = "doc_id long, pre int, last int, parent int, level int, kind tinyint, sib int, name string, local string, ns string, value string, ts int, te int"
COLUMNS = [c.split()[0] for c in NODES.split(", ")]
ELEMENT, ATTRIBUTE, TEXT, CDATA, PI, COMMENT, DOCUMENT = 1, 2, 3, 4, 7, 8, 9


@dataclass
class Part:
    """Rows of which each gives these nodes: kind, name, and their columns."""

    rows: DataFrame
    nodes: list[tuple[int, str | None, Column]]

    def owned(self, name: str) -> Column | None:
        """The attribute of this name of the rows' element; a row makes one element."""
        return next((c for kind, local, c in self.nodes if kind == ATTRIBUTE and local == name), None)


@dataclass
class Forest:
    """Documents as a node table, and their texts (None: they hold none). A forest over tables is kept in parts, so that a step makes only the nodes its test can take.

    ``carried`` names attributes whose place and value elements bring along, in columns ``@name#`` and ``@name`` (null: not there), so that no join is needed to look
    at them. ``rooted``: every node's document has a root here. ``parsed``: the nodes come out of texts, of which Spark's estimate counts some bytes each."""

    all_nodes: DataFrame | None = None
    docs: DataFrame | None = None
    parts: list[Part] | None = None
    carried: tuple[str, ...] = ()
    rooted: bool = False
    parsed: bool = False

    def carrying(self, names) -> Forest:
        """The forest whose elements bring these attributes along; a node table has them in rows of their own only."""
        return self if self.parts is None else replace(self, carried=tuple(sorted(set(names))))

    def narrowed(self, kinds: tuple[int, ...] | None, name: str | None) -> DataFrame:
        """The nodes of these kinds and this name (None: any); others may be there too."""
        if self.parts is None:
            return self.all_nodes
        out = None
        for p in self.parts:
            own = [c for kind, local, c in p.nodes if (kinds is None or kind in kinds) and (name is None or local == name)]
            if own:
                found = spread(p.rows, own, [(n, p.owned(n)) for n in self.carried])
                out = found if out is None else out.unionByName(found)
        return out if out is not None else spread(self.parts[0].rows, [self.parts[0].nodes[0][2]], [(n, None) for n in self.carried]).where(F.lit(False))

    def dealt(self, side: DataFrame) -> DataFrame:
        """A side of a join: dealt out by key where the nodes are parsed, as a broadcast that the estimate allows may be larger than the driver."""
        return side.hint("merge") if self.parsed else side

    @property
    def nodes(self) -> DataFrame:
        return self.narrowed(None, None)


def element(name: str, *args, **more) -> tuple[int, str, Column]:
    return ELEMENT, name, node(*args, ELEMENT, name, **more)


def attribute(name: str, pre: Column, parent: Column, level: int, value: Column) -> tuple[int, str, Column]:
    return ATTRIBUTE, name, node(pre, pre, parent, level, ATTRIBUTE, name, value)


def root(last: Column, **more) -> tuple[int, None, Column]:
    return DOCUMENT, None, node(F.lit(0), last, F.lit(None), 0, DOCUMENT, None, **more)


def node(pre: Column, last: Column, parent: Column, level: int, kind: int, name: str | None, value: Column | None = None, sib: Column | None = None, ts: Column | None = None, te: Column | None = None) -> Column:
    cols = dict(zip(COLUMNS[1:], (pre, last, parent, F.lit(level), F.lit(kind), sib if sib is not None else F.lit(None), F.lit(name), F.lit(name), F.lit("" if name else None), value if value is not None else F.lit(None), ts if ts is not None else F.lit(0), te if te is not None else F.lit(0))))
    kinds = {c.split()[0]: c.split()[1] for c in NODES.split(", ")}
    return F.struct(*[v.cast(kinds[k]).alias(k) for k, v in cols.items()])


def spread(rows: DataFrame, nodes: list[Column], carried: list[tuple[str, Column | None]] = ()) -> DataFrame:
    """Each row's nodes as rows; elements with the attributes they bring along."""
    one = nodes[0] if len(nodes) == 1 else F.explode(F.array(*nodes))
    more = [(f"@{n}{mark}", None if c is None else c[what], kind) for n, c in carried for mark, what, kind in (("#", "pre", "int"), ("", "value", "string"))]
    made = rows.select("doc_id", one.alias("n"), *[(F.lit(None) if c is None else c).cast(kind).alias(name) for name, c, kind in more])
    own = [F.when(F.col("n.kind") == ELEMENT, F.col(name)).alias(name) for name, _, _ in more]
    return made.select("doc_id", "n.*", *own)


def columns_of(df: DataFrame) -> list[str]:
    """The node columns, and those of the attributes that are brought along."""
    return [*COLUMNS, *[c for c in df.columns if c.startswith("@")]]


def text(c: Column) -> Column:
    return c.cast("string")


def order_tree(spark: SparkSession, sf_dir: str) -> Forest:
    """One document per order: order(@id @status @total @date @priority) / lineitem(@n @part @supp @qty @price @disc @tax @flag)*."""
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    head = [("id", "o_orderkey"), ("status", "o_orderstatus"), ("total", "o_totalprice"), ("date", "o_orderdate"), ("priority", "o_orderpriority")]
    item = [("n", "l_linenumber"), ("part", "l_partkey"), ("supp", "l_suppkey"), ("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"), ("tax", "l_tax"), ("flag", "l_returnflag")]
    shown = lambda c, t: F.date_format(c, "yyyy-MM-dd") if t == "timestamp" else decimal(F.col(c)) if t == "double" else text(F.col(c))
    w = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = li.withColumnRenamed("l_orderkey", "doc_id").withColumn("i", F.row_number().over(w))
    kinds = dict(o.dtypes) | dict(li.dtypes)
    count = lines.groupBy("doc_id").agg(F.count("*").alias("k"))
    a, b = len(head), len(item)
    orders = o.withColumnRenamed("o_orderkey", "doc_id").join(count, "doc_id", "left").withColumn("end", F.lit(1 + a) + F.coalesce("k", F.lit(0)) * (1 + b)).withColumn("o_orderkey", F.col("doc_id"))
    tops = [root(F.col("end")), element("order", F.lit(1), F.col("end"), F.lit(0), 1, sib=F.lit(1))]
    tops += [attribute(name, F.lit(1 + j), F.lit(1), 2, shown(c, kinds[c])) for j, (name, c) in enumerate(head, 1)]
    at = F.lit(2 + a) + (F.col("i") - 1) * (1 + b)
    leaves = [element("lineitem", at, at + b, F.lit(1), 2, sib=F.col("i"))]
    leaves += [attribute(name, at + j, at, 3, shown(c, kinds[c])) for j, (name, c) in enumerate(item, 1)]
    return Forest(parts=[Part(orders, tops), Part(lines, leaves)], rooted=True)


def decimal(c: Column) -> Column:
    """A double as XPath writes it; these tables hold no exponents."""
    return F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")


def geo_tree(spark: SparkSession, sf_dir: str) -> Forest:
    """One document: world / region(@key @name) / nation(@key @name) / supplier(@key @name @bal), by key.

    Suppliers are numbered within their nation; where nations and regions begin comes from the nations' counts, a table of the size of the nation table.
    """
    r, n, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier"))
    one = F.lit(0).cast("long").alias("doc_id")
    held = s.groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("k"))
    sized = n.join(held, n.n_nationkey == held.key, "left").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), "n_name", (3 + 4 * F.coalesce("k", F.lit(0))).alias("size"))
    heads = sized.select("r", "n", F.col("n_name").alias("label"), "size").unionByName(r.select(F.col("r_regionkey").alias("r"), F.lit(-1).alias("n"), F.col("r_name").alias("label"), F.lit(3).cast("long").alias("size")))
    order = Window.partitionBy(F.lit(0)).orderBy("r", "n")
    heads = heads.withColumn("pre", F.sum("size").over(order) - F.col("size") + 2).withColumn("end", F.col("pre") + F.col("size") - 1).withColumn("whole", F.max("end").over(Window.partitionBy(F.lit(0)))).withColumn("first", F.row_number().over(order) == 1)
    region = Window.partitionBy("r")
    heads = heads.withColumn("last", F.when(F.col("n") < 0, F.max("end").over(region)).otherwise(F.col("end"))).withColumn("up", F.when(F.col("n") < 0, F.lit(1)).otherwise(F.min("pre").over(region)))
    heads = heads.withColumn("sib", F.row_number().over(Window.partitionBy("up").orderBy("pre"))).withColumn("key", text(F.when(F.col("n") < 0, F.col("r")).otherwise(F.col("n")))).select(one, "*")
    nations = heads.where("n >= 0").select(F.col("n").alias("of"), F.col("pre").alias("up"))
    i = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = s.withColumn("sib", i).join(F.broadcast(nations), F.col("s_nationkey") == F.col("of")).withColumn("pre", F.col("up") + 3 + (F.col("sib") - 1) * 4)
    rows = rows.select(one, "pre", (F.col("pre") + 3).alias("last"), "up", "sib", text(F.col("s_suppkey")).alias("key"), F.col("s_name").alias("label"), decimal(F.col("s_acctbal")).alias("bal"))
    parts = [Part(heads.where("first"), [root(F.col("whole")), element("world", F.lit(1), F.col("whole"), F.lit(0), 1, sib=F.lit(1))])]
    for deep, name, own in ((1, "region", heads.where("n < 0")), (2, "nation", heads.where("n >= 0")), (3, "supplier", rows)):
        found = [element(name, F.col("pre"), F.col("last"), F.col("up"), deep + 1, sib=F.col("sib"))]
        found += [attribute(a, F.col("pre") + j, F.col("pre"), deep + 2, F.col(c)) for j, (a, c) in enumerate([("key", "key"), ("name", "label")] + ([("bal", "bal")] if deep == 3 else []), 1)]
        parts.append(Part(own, found))
    return Forest(parts=parts, rooted=True)


def conv_tree(spark: SparkSession, sf_dir: str) -> Forest:
    """One document per conversation: conversation(@id) / turn(@n @role) / text."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "doc_id")
    w = Window.partitionBy("doc_id").orderBy("turn")
    rows = c.withColumn("i", F.row_number().over(w)).withColumn("te", F.sum(F.length("text")).over(w)).withColumn("ts", F.col("te") - F.length("text"))
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.max("te").alias("te"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("text"))
    end = F.lit(2) + F.col("k") * 4
    tops = [root(end, te=F.col("te")), element("conversation", F.lit(1), end, F.lit(0), 1, sib=F.lit(1), te=F.col("te")), attribute("id", F.lit(2), F.lit(1), 2, text(F.col("doc_id")))]
    at = F.lit(3) + (F.col("i") - 1) * 4
    inner = {"ts": F.col("ts"), "te": F.col("te")}
    leaves = [element("turn", at, at + 3, F.lit(1), 2, sib=F.col("i"), **inner), attribute("n", at + 1, at, 3, text(F.col("turn"))), attribute("role", at + 2, at, 3, F.col("role"))]
    leaves.append((TEXT, None, node(at + 3, at + 3, at, 3, TEXT, None, F.col("text"), sib=F.lit(1), **inner)))
    return Forest(docs=docs.select("doc_id", F.lit(None).cast("string").alias("uri"), "text"), parts=[Part(docs, tops), Part(rows, leaves)], rooted=True)
