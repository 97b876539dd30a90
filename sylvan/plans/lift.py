"""Set-at-a-time evaluation: an expression becomes one DataFrame plan over all contexts of all documents (loop lifting).

A context table has one row per context: ``iter`` names it, the node columns say which node it is, and ``pos``/``size`` are there where an
expression asks for them. A node-set is a table ``(iter, node columns)`` without order; order is derived from ``pre`` where something asks for it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import scalars as sc
from sylvan.operators import axes
from sylvan.plans.syntax import ANY, USUAL, Binary, Call, Filter, Limits, Literal, Number, Path, Step, Test, Unary, Variable, XPathError, attribute_names, calls, parse, positional, simplified, type_of
from sylvan.sources.relational import ATTRIBUTE, COLUMNS, DOCUMENT, ELEMENT, Forest, columns_of

Value = tuple[DataFrame, Column, str]
#: Functions registered by the user: columns of the arguments as strings -> a string column.
REGISTERED: dict[str, Callable[..., Column]] = {}


#: The same for stylesheets, which run document by document: strings -> a string.
SCALARS: dict[str, Callable[..., str]] = {}


def register_function(name: str, builder: Callable[..., Column], scalar: Callable[..., str] | None = None) -> None:
    """Makes ``name(...)`` callable in expressions; builder gets string columns and returns one. ``scalar`` does the same for strings, for stylesheets."""
    from sylvan.plans.syntax import RESULTS

    REGISTERED[name] = builder
    if scalar:
        SCALARS[name] = scalar
    RESULTS["string"].add(name)


class Lifter:
    def __init__(self, forest: Forest, variables: dict | None = None, namespaces: dict[str, str] | None = None, whole: bool = False, limits: Limits = USUAL):
        self.forest, self.limits = forest, limits
        #: Whether the contexts at hand are the roots of all documents.
        self.whole = whole
        self.variables, self.namespaces = variables or {}, {"xml": "http://www.w3.org/XML/1998/namespace"} | (namespaces or {})
        self.fresh = (f"_{n}" for n in itertools.count())

    # node-sets

    def nodeset(self, context: DataFrame, tree) -> DataFrame:
        match tree:
            case Binary("|", a, b):
                for side in (a, b):
                    if type_of(side, self.variables) != "nodes":
                        raise XPathError("| joins node-sets only")
                left, right = (self.nodeset(context, side).select("iter", *COLUMNS) for side in (a, b))
                return left.unionByName(right).dropDuplicates(["iter", "doc_id", "pre"])
            case Path(start, steps):
                return self.path(context, start, simplified(steps, self.variables))
            case Filter(primary, predicates):
                found = self.nodeset(context, primary).withColumn("c_pre", F.lit(0))
                return self.filtered(found, predicates, False).drop("c_pre")
            case Call("id", (arg,)):
                return self.by_id(context, arg)
            case Variable(name):
                raise XPathError(f"variable {name} is not bound to a node-set here")
        raise XPathError(f"not a node-set: {tree}")

    def path(self, context: DataFrame, start, steps: tuple) -> DataFrame:
        one = False
        if start == "root" and steps and self.whole and self.forest.rooted and steps[0].axis in ("child", "descendant") and steps[0].test.kind == "name":
            now = self.filtered(axes.from_roots(self.forest, steps[0], self.namespaces), steps[0].predicates, False).drop("c_pre")
            return self.limited(self.stepped(now, steps[1:], False, steps[0].axis == "descendant"))
        if start == "root" and self.whole and self.forest.rooted and steps[:1] == (ANY,) and len(steps) > 1 and steps[1].axis == "attribute" and steps[1].test.kind == "name":
            now = self.filtered(axes.from_roots(self.forest, steps[1], self.namespaces), steps[1].predicates, False).drop("c_pre")
            return self.limited(self.stepped(now, steps[2:], False, False))
        if start == "root" and self.whole:
            now, one = context.select("iter", *columns_of(context)), True
        elif start == "root":
            at = context.select("iter", F.col("doc_id").alias("c_doc"))
            now = at.join(self.forest.dealt(self.forest.narrowed((DOCUMENT,), None).where(F.col("pre") == 0)), F.col("doc_id") == F.col("c_doc"))
            now, one = now.select("iter", *columns_of(now)), True
        elif start is None:
            now, one = context.select("iter", *columns_of(context)), True
        else:
            now = self.nodeset(context, start)
        return self.limited(self.stepped(now, steps, one, not one))

    def limited(self, found: DataFrame) -> DataFrame:
        """Raises where a path gives a context more nodes than the limit."""
        if self.limits.nodes is None:
            return found
        n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "iter"))
        told = F.raise_error(F.lit(f"a path gives more than {self.limits.nodes} nodes")).cast("boolean")
        return found.withColumn("__n", n).where(F.when(F.col("__n") > self.limits.nodes, told).otherwise(True)).drop("__n")

    def stepped(self, now: DataFrame, steps: tuple, one: bool, nested: bool) -> DataFrame:
        """The steps of a path; one: there is one node per context; nested: a node may stand inside another."""
        for s in steps:
            if s.axis in ("following", "preceding") and not any(positional(p, self.variables) for p in s.predicates) and nested:
                now = self.pruned(now, s.axis)
            found = self.filtered(axes.step(self.forest, now, s, self.namespaces), s.predicates, s.axis in axes.REVERSE)
            repeats = not one and s.axis not in axes.UNIQUE and not (s.axis in ("descendant", "descendant-or-self") and not nested)
            now = found.drop("c_pre")
            if repeats:
                now = now.dropDuplicates(["iter", "doc_id", "pre"])
            nested = nested or s.axis not in ("child", "attribute", "self", "parent")
            one = one and s.axis in ("self", "parent")
            nested = nested and s.axis not in ("attribute",) and not one
        return now

    def pruned(self, now: DataFrame, axis: str) -> DataFrame:
        """following:: of many contexts is that of the one that ends first, preceding:: that of the one that begins last."""
        columns = columns_of(now)
        kept = F.min_by(F.struct(*columns), "last") if axis == "following" else F.max_by(F.struct(*columns), "pre")
        return now.groupBy("doc_id", "iter").agg(kept.alias("n")).select("iter", "n.*")

    def filtered(self, found: DataFrame, predicates: tuple, backwards: bool) -> DataFrame:
        whole, self.whole = self.whole, False
        try:
            return self.holding(found, predicates, backwards)
        finally:
            self.whole = whole

    def holding(self, found: DataFrame, predicates: tuple, backwards: bool) -> DataFrame:
        for p in predicates:
            rows = found
            if positional(p, self.variables):
                part = Window.partitionBy("doc_id", "iter", "c_pre")
                if isinstance(p, Number):
                    rows = found.withColumn("pos", F.row_number().over(part.orderBy(F.desc("pre") if backwards else F.asc("pre"))))
                    found = rows.where(F.col("pos") == p.value).drop("pos") if p.value == int(p.value) else found.where(F.lit(False))
                    continue
                rows = rows.withColumn("pos", F.row_number().over(part.orderBy(F.desc("pre") if backwards else F.asc("pre"))))
                if calls(p, {"last"}):
                    rows = rows.withColumn("size", F.count(F.lit(1)).over(part))
            outer = next(self.fresh)
            rows = rows.withColumn(outer, F.col("iter")).withColumn("iter", F.struct(F.col("iter"), F.col("c_pre"), F.col("pre")))
            if type_of(p, self.variables) == "number":
                rows, value, _ = self.scalar(rows, p)
                rows = rows.where(F.col("pos") == value)
            else:
                rows = self.where(rows, p)
            found = rows.select(F.col(outer).alias("iter"), "c_pre", *columns_of(rows))
        return found

    def own(self, rows: DataFrame, tree) -> Column | None:
        """The value (null: not there) of an attribute of the context that its row brings along."""
        match tree:
            case Path(None, (Step("attribute", Test("name", name, None), ()),)) if f"@{name}" in rows.columns:
                return F.when(F.col(f"@{name}#").isNotNull(), F.coalesce(F.col(f"@{name}"), F.lit("")))
        return None

    def where(self, rows: DataFrame, p, keep: bool = True) -> DataFrame:
        """Rows for which a predicate holds (or doesn't): existence becomes a semi or anti join, unless the row itself can tell."""
        if (own := self.own(rows, p)) is not None:
            return rows.where(own.isNotNull() if keep else own.isNull())
        match p:
            case Binary("and", a, b) if keep:
                return self.where(self.where(rows, a), b)
            case Call("not", (a,)):
                return self.where(rows, a, not keep)
            case Call("boolean", (a,)):
                return self.where(rows, a, keep)
            case Binary("=" | "<" | "<=" | ">" | ">=" as op, a, b) if self.constant(b) and self.own(rows, a) is None and type_of(a, self.variables) == "nodes" and type_of(b, self.variables) != "boolean":
                return self.semi(rows, self.comparing(rows, op, a, b, False), keep)
            case Binary("=" | "<" | "<=" | ">" | ">=" as op, a, b) if self.constant(a) and self.own(rows, b) is None and type_of(b, self.variables) == "nodes" and type_of(a, self.variables) != "boolean":
                return self.semi(rows, self.comparing(rows, op, b, a, True), keep)
            case Binary(">" | "!=", Call("count", (a,)), Number(0.0)):
                return self.where(rows, a, keep)
            case Binary("=", Call("count", (a,)), Number(0.0)):
                return self.where(rows, a, not keep)
        if type_of(p, self.variables) == "nodes":
            return self.semi(rows, self.nodeset(self.context(rows), p), keep)
        rows, value, kind = self.scalar(rows, p)
        value = sc.boolean_of(value, kind)
        return rows.where(value if keep else ~value)

    def constant(self, tree) -> bool:
        return isinstance(tree, (Literal, Number)) or isinstance(tree, Variable) and type_of(tree, self.variables) != "nodes" or isinstance(tree, Unary) and self.constant(tree.operand)

    def context(self, rows: DataFrame) -> DataFrame:
        return rows.select("iter", *columns_of(rows))

    def comparing(self, rows: DataFrame, op: str, nodes, value, turned: bool) -> DataFrame:
        """Nodes of ``nodes`` that compare with a constant."""
        found, text = self.texts(self.nodeset(self.context(rows), nodes), nodes)
        _, other, kind = self.scalar(rows, value)
        if op == "=":
            return found.where(sc.equal(text, "string", other, kind))
        a, b = sc.number_of(text, "string"), sc.number_of(other, kind)
        return found.where(sc.order(op, b, a) if turned else sc.order(op, a, b))

    def semi(self, rows: DataFrame, hits: DataFrame, keep: bool) -> DataFrame:
        i, d = next(self.fresh), next(self.fresh)
        return rows.join(self.forest.dealt(hits.select(F.col("iter").alias(i), F.col("doc_id").alias(d))), (F.col("iter") == F.col(i)) & (F.col("doc_id") == F.col(d)), "left_semi" if keep else "left_anti")

    def by_id(self, context: DataFrame, arg) -> DataFrame:
        rows, value, kind = self.scalar(context, arg)
        wanted = rows.select("iter", F.col("doc_id").alias("c_doc"), F.explode(F.split(F.trim(sc.string_of(value, kind)), r"[ \t\r\n]+")).alias("c_id"))
        owners = self.forest.narrowed((ATTRIBUTE,), "id").where((F.col("kind") == ATTRIBUTE) & (F.col("local") == "id")).select(F.col("doc_id").alias("a_doc"), F.col("parent").alias("a_parent"), F.col("value").alias("a_value"))
        hit = wanted.join(self.forest.dealt(owners), (F.col("c_doc") == F.col("a_doc")) & (F.col("c_id") == F.col("a_value")))
        found = hit.join(self.forest.dealt(self.forest.narrowed((ELEMENT,), None)), (F.col("doc_id") == F.col("c_doc")) & (F.col("pre") == F.col("a_parent")))
        return found.select("iter", *columns_of(found)).dropDuplicates(["iter", "doc_id", "pre"])

    # string-values

    def leaf(self, tree) -> bool:
        """Whether all nodes of an expression keep their string-value in ``value``."""
        match tree:
            case Path(_, steps) if steps:
                return steps[-1].axis == "attribute" or steps[-1].test.kind in ("text", "comment", "processing-instruction")
            case Filter(primary):
                return self.leaf(primary)
            case Binary("|", a, b):
                return self.leaf(a) and self.leaf(b)
        return False

    def texts(self, found: DataFrame, tree) -> tuple[DataFrame, Column]:
        """The table with what the string-values need, and the string-value."""
        own = F.coalesce(F.col("value"), F.lit(""))
        if self.leaf(tree) or self.forest.docs is None:
            return found, own
        d, t = next(self.fresh), next(self.fresh)
        docs = self.forest.docs.select(F.col("doc_id").alias(d), F.col("text").alias(t))
        inner = F.coalesce(F.substring(F.col(t), F.col("ts") + 1, F.col("te") - F.col("ts")), F.lit(""))
        return found.join(self.forest.dealt(docs), F.col("doc_id") == F.col(d), "left"), F.when(F.col("kind").isin(ELEMENT, DOCUMENT), inner).otherwise(own)

    # scalars

    def joined(self, rows: DataFrame, groups: DataFrame, value: Column, default) -> tuple[DataFrame, Column]:
        """Adds one aggregate per context; contexts without nodes get the default."""
        i, d, v = next(self.fresh), next(self.fresh), next(self.fresh)
        made = groups.groupBy(F.col("doc_id").alias(d), F.col("iter").alias(i)).agg(value.alias(v))
        return rows.join(self.forest.dealt(made), (F.col("iter") == F.col(i)) & (F.col("doc_id") == F.col(d)), "left").drop(i, d), F.coalesce(F.col(v), default if isinstance(default, Column) else F.lit(default))

    def first(self, rows: DataFrame, tree, what: Column | None = None, default: str = "") -> Value:
        """Of the first node in document order: its string-value or another column."""
        if what is None and (own := self.own(rows, tree)) is not None:
            return rows, F.coalesce(own, F.lit(default)), "string"
        found = self.nodeset(self.context(rows), tree)
        if what is None:
            found, what = self.texts(found, tree)
        rows, col = self.joined(rows, found, F.min_by(F.coalesce(what, F.lit("")), "pre"), default)
        return rows, col, "string"

    def scalar(self, rows: DataFrame, tree) -> Value:
        """A value per context: the table, perhaps with more columns, the column, and its type."""
        match tree:
            case Literal(v):
                return rows, F.lit(v), "string"
            case Number(v):
                return rows, F.lit(v), "number"
            case Variable(name):
                if name not in self.variables:
                    raise XPathError(f"variable {name} is not bound")
                v = self.variables[name]
                return rows, F.lit(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v), type_of(tree, self.variables)
            case Unary(a):
                rows, col = self.number(rows, a)
                return rows, -col, "number"
            case Binary("and" | "or" as op, a, b):
                rows, left = self.boolean(rows, a)
                rows, right = self.boolean(rows, b)
                return rows, left & right if op == "and" else left | right, "boolean"
            case Binary("=" | "!=" | "<" | "<=" | ">" | ">=" as op, a, b):
                return self.compared(rows, op, a, b)
            case Binary("|"):
                return self.first(rows, tree)
            case Binary(op, a, b):
                rows, left = self.number(rows, a)
                rows, right = self.number(rows, b)
                return rows, sc.arithmetic(op, left, right), "number"
            case Call(name, args):
                return self.call(rows, name, args, tree)
        return self.first(rows, tree)

    def typed(self, rows: DataFrame, tree, kind: str) -> tuple[DataFrame, Column]:
        rows, col, has = self.scalar(rows, tree)
        return rows, sc.CONVERT[kind](col, has)

    def number(self, rows, tree):
        return self.typed(rows, tree, "number")

    def string(self, rows, tree):
        return self.typed(rows, tree, "string")

    def boolean(self, rows: DataFrame, tree) -> tuple[DataFrame, Column]:
        if (own := self.own(rows, tree)) is not None:
            return rows, own.isNotNull()
        if type_of(tree, self.variables) == "nodes":
            return self.joined(rows, self.nodeset(self.context(rows), tree), F.count(F.lit(1)) > 0, False)
        return self.typed(rows, tree, "boolean")

    def compared(self, rows: DataFrame, op: str, a, b) -> Value:
        ka, kb = (type_of(t, self.variables) for t in (a, b))
        if "nodes" in (ka, kb) and "boolean" in (ka, kb):
            rows, left = self.boolean(rows, a)
            rows, right = self.boolean(rows, b)
            return rows, self.plain(op, left, "boolean", right, "boolean"), "boolean"
        ours = [self.own(rows, t) for t in (a, b)]
        if all(o is not None or k != "nodes" for o, k in zip(ours, (ka, kb))) and "nodes" in (ka, kb):
            sides = []
            for o, t in zip(ours, (a, b)):
                if o is None:
                    rows, col, kind = self.scalar(rows, t)
                    sides.append((col, kind))
                else:
                    sides.append((o, "string"))
            return rows, F.coalesce(self.plain(op, *sides[0], *sides[1]), F.lit(False)) & (ours[0] if ours[0] is not None else F.lit(True)).isNotNull() & (ours[1] if ours[1] is not None else F.lit(True)).isNotNull(), "boolean"
        if ka == kb == "nodes":
            return self.both_sets(rows, op, a, b)
        if "nodes" in (ka, kb):
            nodes, other, turned = (a, b, False) if ka == "nodes" else (b, a, True)
            rows, value, kind = self.scalar(rows, other)
            i, d, v = next(self.fresh), next(self.fresh), next(self.fresh)
            found, text = self.texts(self.nodeset(self.context(rows), nodes), nodes)
            if not self.constant(other):
                found = found.join(self.forest.dealt(rows.select(F.col("iter").alias(i), F.col("doc_id").alias(d), value.alias(v))), (F.col("iter") == F.col(i)) & (F.col("doc_id") == F.col(d)))
                inner = F.col(v)
            else:
                inner = value
            told = self.plain(op, inner, kind, text, "string") if turned else self.plain(op, text, "string", inner, kind)
            rows, col = self.joined(rows, found.where(told), F.count(F.lit(1)) > 0, False)
            return rows, col, "boolean"
        rows, left, ka = self.scalar(rows, a)
        rows, right, kb = self.scalar(rows, b)
        return rows, self.plain(op, left, ka, right, kb), "boolean"

    def plain(self, op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
        if op in ("=", "!="):
            told = sc.equal(a, ka, b, kb)
            return told if op == "=" else ~told
        return sc.order(op, sc.number_of(a, ka), sc.number_of(b, kb))

    def both_sets(self, rows: DataFrame, op: str, a, b) -> Value:
        """Some pair compares: = by an equi-join on the string-values, the others by least and largest."""
        (fa, ta), (fb, tb) = (self.texts(self.nodeset(self.context(rows), t), t) for t in (a, b))
        if op == "=":
            i, d, v, x = (next(self.fresh) for _ in range(4))
            right = fb.select(F.col("iter").alias(i), F.col("doc_id").alias(d), tb.alias(v)).distinct()
            hit = fa.select("iter", "doc_id", ta.alias(x)).join(self.forest.dealt(right), (F.col("iter") == F.col(i)) & (F.col("doc_id") == F.col(d)) & (F.col(x) == F.col(v)), "left_semi")
            rows, col = self.joined(rows, hit, F.count(F.lit(1)) > 0, False)
            return rows, col, "boolean"
        if op == "!=":
            rows, la = self.joined(rows, fa, F.min(ta), F.lit(None))
            rows, ha = self.joined(rows, fa, F.max(ta), F.lit(None))
            rows, lb = self.joined(rows, fb, F.min(tb), F.lit(None))
            rows, hb = self.joined(rows, fb, F.max(tb), F.lit(None))
            return rows, F.coalesce((la != ha) | (lb != hb) | (la != lb), F.lit(False)), "boolean"
        na, nb = (F.when(~F.isnan(n), n) for n in (sc.number_of(ta, "string"), sc.number_of(tb, "string")))
        low = op in ("<", "<=")
        rows, left = self.joined(rows, fa, (F.min if low else F.max)(na), F.lit(None).cast("double"))
        rows, right = self.joined(rows, fb, (F.max if low else F.min)(nb), F.lit(None).cast("double"))
        told = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        return rows, F.coalesce(told, F.lit(False)), "boolean"

    def call(self, rows: DataFrame, name: str, args: tuple, tree) -> Value:
        here = Path(None, (Step("self", Test("node")),))
        strings = lambda rows, n=None: self.many(rows, args[:n] if n else args)
        match name, len(args):
            case "true" | "false", 0:
                return rows, F.lit(name == "true"), "boolean"
            case "position", 0:
                return rows, F.col("pos").cast("double") if "pos" in rows.columns else F.lit(1.0), "number"
            case "last", 0:
                return rows, F.col("size").cast("double") if "size" in rows.columns else F.lit(1.0), "number"
            case "count", 1:
                if type_of(args[0], self.variables) != "nodes":
                    return rows, F.lit(1.0), "number"
                if (own := self.own(rows, args[0])) is not None:
                    return rows, own.isNotNull().cast("double"), "number"
                rows, col = self.joined(rows, self.nodeset(self.context(rows), args[0]), F.count(F.lit(1)).cast("double"), 0.0)
                return rows, col, "number"
            case "sum", 1:
                if type_of(args[0], self.variables) != "nodes":
                    return rows, F.lit(float("nan")), "number"
                if (own := self.own(rows, args[0])) is not None:
                    return rows, F.when(own.isNull(), 0.0).otherwise(sc.number_of(own, "string")), "number"
                found, text = self.texts(self.nodeset(self.context(rows), args[0]), args[0])
                rows, col = self.joined(rows, found, F.sum(sc.number_of(text, "string")), 0.0)
                return rows, col, "number"
            case "local-name" | "namespace-uri" | "name", 0 | 1:
                what = F.col({"local-name": "local", "namespace-uri": "ns", "name": "name"}[name])
                if args:
                    return self.first(rows, args[0], what)
                return rows, F.coalesce(what, F.lit("")), "string"
            case "string", 0 | 1:
                rows, col = self.string(rows, args[0] if args else here)
                return rows, col, "string"
            case "number", 0 | 1:
                rows, col = self.number(rows, args[0] if args else here)
                return rows, col, "number"
            case "boolean", 1:
                rows, col = self.boolean(rows, args[0])
                return rows, col, "boolean"
            case "not", 1:
                rows, col = self.boolean(rows, args[0])
                return rows, ~col, "boolean"
            case "concat", n if n >= 1:
                rows, cols = strings(rows)
                return rows, F.concat(*cols), "string"
            case "starts-with" | "contains", 2:
                rows, (s, d) = strings(rows)
                return rows, F.startswith(s, d) if name == "starts-with" else F.contains(s, d), "boolean"
            case "substring-before" | "substring-after", 2:
                rows, (s, d) = strings(rows)
                return rows, (sc.substring_before if name.endswith("before") else sc.substring_after)(s, d), "string"
            case "substring", 2 | 3:
                rows, s = self.string(rows, args[0])
                rows, start = self.number(rows, args[1])
                size = None
                if len(args) == 3:
                    rows, size = self.number(rows, args[2])
                return rows, sc.substring(s, start, size), "string"
            case "string-length" | "normalize-space", 0 | 1:
                rows, s = self.string(rows, args[0] if args else here)
                return (rows, F.length(s).cast("double"), "number") if name == "string-length" else (rows, sc.normalize_space(s), "string")
            case "translate", 3:
                rows, cols = strings(rows)
                return rows, F.call_function("translate", *cols), "string"
            case "floor" | "ceiling" | "round", 1:
                rows, x = self.number(rows, args[0])
                return rows, {"floor": sc.floor_, "ceiling": sc.ceiling, "round": sc.round_}[name](x), "number"
            case "format-number", 2:
                rows, x = self.number(rows, args[0])
                if not isinstance(args[1], Literal):
                    raise XPathError("format-number() takes a literal pattern here")
                return rows, sc.format_number(x, args[1].value), "string"
            case "generate-id", 0 | 1:
                mark = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("n"), F.col("pre").cast("string"))
                return self.first(rows, args[0], mark) if args else (rows, mark, "string")
            case "lang", 1:
                return self.lang(rows, args[0])
            case "system-property", 1:
                return rows, F.lit("1.0" if isinstance(args[0], Literal) and args[0].value == "xsl:version" else ""), "string"
        if name in REGISTERED:
            rows, cols = strings(rows)
            return rows, F.coalesce(REGISTERED[name](*cols), F.lit("")), "string"
        if type_of(tree, self.variables) == "nodes":
            return self.first(rows, tree)
        raise XPathError(f"{name}() does not take {len(args)} arguments")

    def many(self, rows: DataFrame, trees: tuple) -> tuple[DataFrame, list[Column]]:
        out = []
        for t in trees:
            rows, col = self.string(rows, t)
            out.append(col)
        return rows, out

    def lang(self, rows: DataFrame, arg) -> Value:
        """The nearest xml:lang or lang, of the node or above, is the language asked for or one of its kinds."""
        rows, wanted = self.string(rows, arg)
        above = axes.step(self.forest, self.context(rows), Step("ancestor-or-self", Test("name", "*")), self.namespaces)
        marks = axes.step(self.forest, above.drop("c_pre"), Step("attribute", Test("name", "lang")), self.namespaces)
        rows, found = self.joined(rows, marks, F.max_by("value", F.struct("c_pre", F.col("name") == "xml:lang")), "")
        found, wanted = F.lower(found), F.lower(wanted)
        return rows, (F.col("kind") == ELEMENT) & (F.length(found) > 0) & ((found == wanted) | F.startswith(found, F.concat(wanted, F.lit("-")))), "boolean"


def contexts(forest: Forest) -> DataFrame:
    """One context per document: its root."""
    roots = forest.narrowed((DOCUMENT,), None).where(F.col("kind") == DOCUMENT)
    return roots.select(F.col("doc_id").alias("iter"), *columns_of(roots))


def select(forest: Forest, expr: str, variables: dict | None = None, namespaces: dict | None = None, context: DataFrame | None = None, carry: str | None = None, limits: Limits = USUAL) -> DataFrame:
    """A node-set per document: ``(iter, node columns, string_value)``, without order. The nodes can bring along what the expression ``carry`` will ask of them, as further columns."""
    tree = parse(expr, limits)
    forest = forest.carrying(attribute_names(tree) | (attribute_names(parse(carry, limits)) if carry else set()))
    lifter = Lifter(forest, variables, namespaces, context is None, limits)
    found, text = lifter.texts(lifter.nodeset(contexts(forest) if context is None else context, tree), tree)
    return found.select("iter", *(columns_of(found) if carry else COLUMNS), text.alias("string_value"))


def select_first(forest: Forest, expr: str, variables: dict | None = None, namespaces: dict | None = None) -> DataFrame:
    """The first node in document order per document that has one."""
    tree = parse(expr)
    forest = forest.carrying(attribute_names(tree))
    lifter = Lifter(forest, variables, namespaces, True)
    own = [c for c in COLUMNS if c != "doc_id"]
    found = lifter.nodeset(contexts(forest), tree).groupBy("doc_id", "iter").agg(F.min_by(F.struct(*own), "pre").alias("n")).select("iter", "doc_id", "n.*")
    found, text = lifter.texts(found, tree)
    return found.select("iter", "doc_id", *own, text.alias("string_value"))


def evaluate(forest: Forest, expr: str, variables: dict | None = None, namespaces: dict | None = None, context: DataFrame | None = None, limits: Limits = USUAL) -> DataFrame:
    """A number, string or truth per document: ``(iter, doc_id, value)``; of a node-set, the first node's string."""
    tree = parse(expr, limits)
    forest = forest.carrying(attribute_names(tree))
    lifter = Lifter(forest, variables, namespaces, context is None, limits)
    rows, value, _ = lifter.scalar(contexts(forest) if context is None else context, tree)
    return rows.select("iter", "doc_id", value.alias("value"))
