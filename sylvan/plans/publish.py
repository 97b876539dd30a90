"""Stylesheets over tables, compiled to one plan: what a template makes of a row is a string column, what it makes of child rows an ordered aggregate.

A ``Shape`` says which elements a table's rows are, so each template can be compiled for the node it meets: the rule, the children and the attributes are
known before any row is read, and only predicates are left as conditions. Recursion over the tree ends with the shapes. Stylesheets that need more (recursive
calls, keys, navigation into fragments, other documents) raise Unsupported, and the caller runs them document by document.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import scalars as sc
from sylvan.operators.stylesheet import ELEMENT_NAME, XSL, Stylesheet, arms, value_template
from sylvan.operators.tree import BLANKS, Node, ancestors
from sylvan.plans.lift import Lifter
from sylvan.plans.syntax import Binary, Call, Filter, Literal, Number, Path, Step, Test, Variable, XPathError, parse, positional, simplified, type_of
from sylvan.sources.relational import ATTRIBUTE, CDATA, COMMENT, DOCUMENT, ELEMENT, PI, TEXT

KINDS = {"number": 0.0, "string": "", "boolean": True}


class Unsupported(Exception):
    """A stylesheet that needs the per-document tier."""


@dataclass
class Shape:
    """Rows of which each is an element: its attributes and text (null, and for texts empty: not there), the columns that name it, those that order it among its siblings, and its children, whose rows have the key too."""

    rows: DataFrame
    name: str
    attributes: list[tuple[str, Column]]
    key: list[str]
    order: list[str] = field(default_factory=list)
    text: Column | None = None
    children: list[Shape] = field(default_factory=list)

    def texts(self) -> bool:
        return self.text is not None or any(c.texts() for c in self.children)


@dataclass
class Here:
    """The node that is being looked at: of which shape, and which of its nodes. ``pos`` and ``size`` give columns where a position is known."""

    shape: Shape
    kind: int
    name: str = ""
    above: Here | None = None
    pos: Callable | None = None
    size: Callable | None = None
    filtered: bool = False

    def value(self) -> Column:
        if self.kind == ATTRIBUTE:
            return dict(self.shape.attributes)[self.name]
        if self.kind != TEXT and any(c.texts() for c in self.shape.children):
            raise Unsupported("the text of an element with children that have some")
        return self.shape.text if self.shape.text is not None else F.lit(None).cast("string")

    def exists(self) -> Column:
        if self.kind in (ELEMENT, DOCUMENT):
            return F.lit(True)
        return self.value().isNotNull() & (self.value() != "") if self.kind == TEXT else self.value().isNotNull()

    def attribute(self, name: str) -> Here:
        return Here(self.shape, ATTRIBUTE, name, self)


@dataclass
class Group:
    """Child elements of a row, under predicates; ``leaf``: one of their attributes."""

    shape: Shape
    above: Here
    predicates: tuple = ()
    leaf: str | None = None


@dataclass
class Made:
    """What a body makes: attributes (name, value, condition) and content."""

    attributes: list = field(default_factory=list)
    content: list = field(default_factory=list)

    def text(self) -> Column:
        return F.concat(*self.content) if len(self.content) > 1 else self.content[0] if self.content else F.lit("")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def in_attribute(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


class Publisher(Lifter):
    def __init__(self, top: Shape, sheet: Stylesheet, parameters: dict):
        super().__init__(None, {}, sheet.namespaces)
        self.top, self.sheet, self.given = top, sheet, parameters
        o = sheet.output
        if o.method not in ("xml", "text") or o.declaration or o.indent or o.cdata or o.other.get("doctype-system") or o.other.get("encoding", "UTF-8").upper() != "UTF-8" or sheet.strip or sheet.limits.nodes is not None:
            raise Unsupported("output settings")
        self.plain_text = o.method == "text"
        self.bound: dict[str, Column] = {}
        #: Variables that differ from row to row, and whether the expression at hand looks at a node.
        self.local: set[str] = set()
        self.looks = False
        self.here: Here | None = None
        self.calls: list = []
        self.guards: list[Column] = []
        self.problems: list[tuple[Column, Column]] = []
        self.said: list[Column] = [F.array(F.lit(w)) for w in sheet.warnings]
        self.names = (f"__{n}" for n in itertools.count())

    def plan(self) -> DataFrame:
        """``(doc_id, xml, error, messages)``."""
        root = Here(self.top, DOCUMENT)
        rows = self.globals(self.top.rows, root)
        rows, made = self.applied(rows, [root], "", {}, None)
        rows = rows.withColumn("__xml", made.text())
        error = F.coalesce(*[F.when(g, m) for g, m in self.problems]) if self.problems else F.lit(None).cast("string")
        said = F.concat(*self.said) if self.said else F.array().cast("array<string>")
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(error.isNull(), F.col("__xml")).alias("xml"), error.alias("error"), said.alias("messages"))

    # expressions

    def at(self, here: Here, rows: DataFrame, tree, kind: str | None = None) -> tuple[DataFrame, Column, str]:
        before, self.here = self.here, here
        try:
            if kind == "boolean":
                return (*self.boolean(rows, tree), kind)
            rows, col, has = self.scalar(rows, tree)
            return (rows, sc.CONVERT[kind](col, has), kind) if kind else (rows, col, has)
        except (XPathError, KeyError) as e:
            raise Unsupported(str(e)) from None
        finally:
            self.here = before

    def string_at(self, here: Here, rows: DataFrame, tree) -> tuple[DataFrame, Column]:
        return self.at(here, rows, tree, "string")[:2]

    def targets(self, here: Here, tree) -> list:
        """The nodes of an expression: Here for one of this row, Group for child rows. In document order."""
        self.looks = True
        match tree:
            case Binary("|", a, b):
                found = self.targets(here, a) + self.targets(here, b)
                names = [n for n, _ in here.shape.attributes]
                rank = lambda t: (2, here.shape.children.index(t.shape)) if isinstance(t, Group) else (0, names.index(t.name)) if t.kind == ATTRIBUTE else (1, 0)
                if any(isinstance(t, Group) and t.shape not in here.shape.children or isinstance(t, Here) and t.shape is not here.shape for t in found) or any(isinstance(t, Here) and t.kind in (ELEMENT, DOCUMENT) for t in found) or len({str((type(t), getattr(t, "name", None), getattr(t, "shape", None) and t.shape.name)) for t in found}) < len(found):
                    raise Unsupported("a union of paths that may meet")
                return sorted(found, key=rank)
            case Path(None, steps) | Path("root", steps):
                now: list = [here if tree.start is None else Here(self.top, DOCUMENT)]
                if tree.start == "root" and here.shape is not self.top:
                    raise Unsupported("an absolute path from a child row")
                for s in simplified(steps, self.variables):
                    now = [x for t in now for x in self.step(t, s)]
                return now
            case Path(start, steps) if start is not None:
                now = self.targets(here, start)
                for s in steps:
                    now = [x for t in now for x in self.step(t, s)]
                return now
            case Call("key", (Literal(name), Literal() as wanted)):
                return self.keyed(here, name, wanted)
        raise Unsupported(f"the nodes of {tree}")

    def keyed(self, here: Here, name: str, wanted: Literal) -> list:
        """key() with a literal value, for child rows of the document's element by one of their attributes: a predicate on them."""
        own = Here(self.top, ELEMENT, self.top.name, Here(self.top, DOCUMENT))
        match self.sheet.keys.get(name):
            case [([Path(None, (Step("child", Test("name", child, None), ()),))], Path(None, (Step("attribute", Test("name", _, None), ()),)) as use)] if here.shape is self.top and child not in ("*", self.top.name) and not any(c.children for c in self.top.children):
                return [Group(c, own, (Binary("=", use, wanted),)) for c in self.top.children if c.name == child]
        raise Unsupported("keys of this kind")

    def step(self, t, s: Step) -> list:
        if isinstance(t, Group):
            if s.axis == "attribute" and s.test.kind == "name" and s.test.local != "*" and not s.predicates and t.leaf is None:
                return [Group(t.shape, t.above, t.predicates, s.test.local)] if s.test.local in dict(t.shape.attributes) else []
            if s.axis == "self" and s.test.kind == "node" and not s.predicates:
                return [t]
            raise Unsupported("a path beyond child rows")
        if s.test.prefix is not None:
            raise Unsupported("prefixes")
        named = lambda name: s.test.kind == "node" or s.test.kind == "name" and s.test.local in ("*", name)
        inner = t.kind in (ELEMENT, DOCUMENT)
        match s.axis:
            case "self":
                found = [t] if s.test.kind == "node" or t.kind in (ELEMENT, ATTRIBUTE) and s.test.kind == "name" and s.test.local in ("*", t.name) else []
            case "attribute":
                found = [t.attribute(n) for n, _ in t.shape.attributes if named(n)] if t.kind == ELEMENT else []
            case "parent" if t.above is not None and (t.kind != ELEMENT or t.above.shape is t.shape):
                found = [t.above] if t.above.kind == ELEMENT and named(t.above.name) or s.test.kind == "node" else []
            case "child" | "descendant" if t.kind == DOCUMENT:
                own = Here(t.shape, ELEMENT, t.shape.name, t)
                found = [own] if named(t.shape.name) else []
                if s.axis == "descendant":
                    if found and t.shape.children:
                        raise Unsupported("descendants of several kinds")
                    found = found or self.step(own, Step("descendant", s.test))
            case "child" | "descendant" if inner:
                if s.axis == "descendant" and any(c.children for c in t.shape.children):
                    raise Unsupported("descendants of several kinds")
                found = [Here(t.shape, TEXT, "", t)] if t.shape.text is not None and s.test.kind in ("node", "text") else []
                found += [Group(c, t) for c in t.shape.children if named(c.name)]
            case "child" | "descendant" | "namespace":
                found = []
            case _:
                raise Unsupported(f"the axis {s.axis}")
        if s.predicates:
            if len(found) != 1 or not isinstance(found[0], Group):
                raise Unsupported("a predicate on other nodes than child rows")
            found = [Group(found[0].shape, found[0].above, s.predicates)]
        return found

    def inner(self, g: Group) -> tuple[DataFrame, Here]:
        """The child rows of a group, and the node that each is."""
        rows, here = g.shape.rows, Here(g.shape, ELEMENT, g.shape.name, g.above, filtered=bool(g.predicates))
        for p in g.predicates:
            if positional(p, self.variables):
                w = Window.partitionBy(*g.above.shape.key)
                pos, size = next(self.names), next(self.names)
                rows = rows.withColumn(pos, F.row_number().over(w.orderBy(*g.shape.order)))
                if "last" in str(p):
                    rows = rows.withColumn(size, F.count(F.lit(1)).over(w))
                own = Here(g.shape, ELEMENT, g.shape.name, g.above, lambda r, pos=pos: (r, F.col(pos).cast("double")), lambda r, size=size: (r, F.col(size).cast("double")))
                if type_of(p, self.variables) == "number":
                    rows, v, _ = self.at(own, rows, p, "number")
                    rows = rows.where(F.col(pos) == v)
                    continue
            else:
                own = here
            rows, v, _ = self.at(own, rows, p, "boolean")
            rows = rows.where(v)
        return rows, here

    def over(self, rows: DataFrame, g: Group, what: Callable, default) -> tuple[DataFrame, Column]:
        """Adds an aggregate of a group's rows; what(value of the leaf or null, order) gives it."""
        if g.above.shape is not self.here.shape:
            raise Unsupported("the rows of another element")
        inner, here = self.inner(g)
        leaf = here.attribute(g.leaf).value() if g.leaf else here.value()
        if g.leaf:
            inner = inner.where(leaf.isNotNull())
        v, key = next(self.names), [next(self.names) for _ in g.above.shape.key]
        made = inner.groupBy(*[F.col(k).alias(x) for k, x in zip(g.above.shape.key, key)]).agg(what(leaf, F.struct(*g.shape.order)).alias(v))
        joined = rows.join(made, [F.col(k) == F.col(x) for k, x in zip(g.above.shape.key, key)], "left").drop(*key)
        return joined, F.coalesce(F.col(v), F.lit(default)) if default is not None else F.col(v)

    def first(self, rows: DataFrame, tree, what: Column | None = None, default: str = "") -> tuple:
        found = self.targets(self.here, tree)
        if what is not None:
            raise Unsupported("names of other nodes")
        if not found:
            return rows, F.lit(default), "string"
        out = []
        for t in found:
            if isinstance(t, Here):
                out.append(t.value() if t.kind in (ATTRIBUTE, TEXT) else F.coalesce(t.value(), F.lit("")))
            else:
                rows, col = self.over(rows, t, lambda leaf, order: F.min_by(F.coalesce(leaf, F.lit("")), order), None)
                out.append(col)
        return rows, F.coalesce(*out, F.lit(default)), "string"

    def boolean(self, rows: DataFrame, tree) -> tuple[DataFrame, Column]:
        if type_of(tree, self.variables) != "nodes":
            return self.typed(rows, tree, "boolean")
        out = F.lit(False)
        for t in self.targets(self.here, tree):
            if isinstance(t, Here):
                out = out | t.exists()
            else:
                rows, col = self.over(rows, t, lambda leaf, order: F.count(F.lit(1)) > 0, False)
                out = out | col
        return rows, out

    def scalar(self, rows: DataFrame, tree) -> tuple:
        if isinstance(tree, Variable):
            if tree.name not in self.bound:
                raise Unsupported(f"variable {tree.name}")
            self.looks |= tree.name in self.local
            return rows, self.bound[tree.name], type_of(tree, self.variables)
        return super().scalar(rows, tree)

    def compared(self, rows: DataFrame, op: str, a, b) -> tuple:
        ka, kb = (type_of(t, self.variables) for t in (a, b))
        if "nodes" not in (ka, kb) or "boolean" in (ka, kb):
            return super().compared(rows, op, a, b)
        left, right = (self.targets(self.here, t) if k == "nodes" else None for t, k in ((a, ka), (b, kb)))
        if any(isinstance(t, Group) for t in (left or []) + (right or [])):
            if left is not None and right is not None or not self.constant(b if left is not None else a):
                raise Unsupported("child rows compared with what isn't constant")
        out = F.lit(False)
        for x in left if left is not None else [None]:
            for y in right if right is not None else [None]:
                group = x if isinstance(x, Group) else y if isinstance(y, Group) else None
                if group:
                    rows, value, kind = self.scalar(rows, b if group is x else a)
                    told = lambda leaf, order: F.max(F.coalesce(self.plain(op, leaf, "string", value, kind) if group is x else self.plain(op, value, kind, leaf, "string"), F.lit(False)))  # noqa: B023, E731
                    rows, col = self.over(rows, group, lambda leaf, order: told(F.coalesce(leaf, F.lit("")), order), False)  # noqa: B023
                    out = out | col
                    continue
                sides = []
                for t, tree in ((x, a), (y, b)):
                    if t is not None:
                        sides.append((F.coalesce(t.value(), F.lit("")), "string", t.exists()))
                    else:
                        rows, col, kind = self.scalar(rows, tree)
                        sides.append((col, kind, F.lit(True)))
                (va, ta, ea), (vb, tb, eb) = sides
                out = out | (ea & eb & self.plain(op, va, ta, vb, tb))
        return rows, out, "boolean"

    def constant(self, tree) -> bool:
        return isinstance(tree, (Literal, Number))

    def call(self, rows: DataFrame, name: str, args: tuple, tree) -> tuple:
        if name in ("position", "last"):
            self.looks = True
            how = self.here.pos if name == "position" else self.here.size
            if how is None:
                raise Unsupported(f"{name}() of these nodes")
            return (*how(rows), "number")
        if name in ("count", "sum") and type_of(args[0], self.variables) == "nodes":
            out = F.lit(0.0)
            for t in self.targets(self.here, args[0]):
                if isinstance(t, Here):
                    out = out + F.when(t.exists(), 1.0 if name == "count" else sc.number_of(F.coalesce(t.value(), F.lit("")), "string")).otherwise(0.0)
                else:
                    agg = (lambda leaf, order: F.count(F.lit(1)).cast("double")) if name == "count" else (lambda leaf, order: F.sum(sc.number_of(F.coalesce(leaf, F.lit("")), "string")))
                    rows, col = self.over(rows, t, agg, 0.0)
                    out = out + col
            return rows, out, "number"
        if name in ("name", "local-name", "namespace-uri"):
            self.looks = True
            found = self.targets(self.here, args[0]) if args else [self.here]
            if len(found) != 1 or not isinstance(found[0], Here):
                raise Unsupported("names of child rows")
            t = found[0]
            return rows, F.when(t.exists(), "" if name == "namespace-uri" or t.kind not in (ELEMENT, ATTRIBUTE) else t.name).otherwise(""), "string"
        if name in ("id", "current", "document", "lang", "generate-id"):
            raise Unsupported(f"{name}()")
        if name in ("string", "number", "string-length", "normalize-space") and not args:
            args = (Path(None, (Step("self", Test("node")),)),)
        return super().call(rows, name, args, tree)

    # templates

    def globals(self, rows: DataFrame, root: Here) -> DataFrame:
        waiting = dict(self.sheet.globals)
        for _ in range(len(waiting)):
            for name, (_, n) in list(waiting.items()):
                if n.local == "param" and name in self.given:
                    v = self.given[name]
                    self.bind(name, F.lit(v if isinstance(v, (bool, str)) else float(v)), "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number")
                elif n.children:
                    continue
                else:
                    try:
                        rows, *made = self.valued(root, rows, parse(n.attribute("select", "''"), self.sheet.limits))
                    except Unsupported:
                        continue
                    self.bind(name, *made)
                del waiting[name]
        return rows

    def valued(self, here: Here, rows: DataFrame, tree) -> tuple[DataFrame, Column, str, bool]:
        """A value with its type, and whether it differs from row to row."""
        self.looks = False
        rows, col, kind = self.at(here, rows, tree)
        return rows, col, kind, self.looks

    def bind(self, name: str, col: Column, kind: str, local: bool = False) -> None:
        self.bound[name], self.variables[name] = col, KINDS[kind]
        (self.local.add if local else self.local.discard)(name)

    def scoped(self):
        """What is bound now, to come back to."""
        return dict(self.bound), dict(self.variables), set(self.local)

    def back(self, kept) -> None:
        self.bound, self.variables, self.local = kept

    def unbind(self, names) -> None:
        for name in list(names):
            self.bound.pop(name, None)
            self.variables.pop(name, None)

    def pattern(self, rows: DataFrame, n: Here, arm) -> tuple[DataFrame, Column | None]:
        """The condition under which a node matches, or None if it never does."""
        if not isinstance(arm, Path) or arm.start not in (None, "root"):
            raise Unsupported("a pattern with a function")
        steps, cond, at = list(arm.steps), F.lit(True), n
        while steps:
            s = steps.pop()
            if s.test.prefix is not None:
                raise Unsupported("prefixes")
            if s.axis == "descendant-or-self" and s.test.kind == "node" and not s.predicates:
                if not steps:
                    return rows, cond  # any depth below the root
                raise Unsupported("// inside a pattern")
            if at is None or at.kind == DOCUMENT or (s.axis == "attribute") != (at.kind == ATTRIBUTE):
                return rows, None
            fits = s.test.kind == "node" or s.test.kind == "text" and at.kind == TEXT or s.test.kind == "name" and at.kind in (ELEMENT, ATTRIBUTE) and s.test.local in ("*", at.name)
            if not fits:
                return rows, None
            for p in s.predicates:
                if positional(p, self.variables) or at.shape is not n.shape:
                    raise Unsupported("a position in a pattern")
                rows, v, _ = self.at(at, rows, p, "boolean")
                cond = cond & v
            at = at.above
        if arm.start == "root" and (at is None or at.kind != DOCUMENT):
            return rows, None
        if not arm.steps and arm.start == "root":
            return rows, cond if n.kind == DOCUMENT else None
        return rows, cond

    def applied(self, rows: DataFrame, targets: list, mode: str, params: dict, sorts) -> tuple[DataFrame, Made]:
        made, alone = Made(), len(targets) == 1
        if sorts and not alone:
            raise Unsupported("nodes of several kinds in an order")
        for t in targets:
            if isinstance(t, Here):
                rows, more = self.one(rows, single(t, alone), mode, params, None)
                if t.kind in (ATTRIBUTE, TEXT):
                    more = conditional(more, t.exists())
            else:
                if any(local for _, _, local in params.values()):
                    raise Unsupported("parameters of child rows")
                rows, more = self.each(rows, t, sorts, lambda r, h: self.one(r, h, mode, params, None), alone)
            merged(made, more)
        return rows, made

    def one(self, rows: DataFrame, n: Here, mode: str, params: dict, below: int | None) -> tuple[DataFrame, Made]:
        """What the rules make of a node: of those that may match, the first whose condition holds."""
        options: list[tuple[Column | None, Made]] = []
        passed: list[Column] = []
        for r in self.sheet.rules:
            if r.mode != mode or below is not None and r.precedence >= below:
                continue
            rows, cond = self.pattern(rows, n, r.arm)
            if cond is None:
                continue
            plain = not any(s.predicates for s in r.arm.steps)
            guard = [~c for c in passed] + ([] if plain else [cond])
            rows, made = self.template(rows, n, r.body, params, r, guard)
            options.append((None if plain else cond, made))
            if plain:
                break
            passed.append(cond)
        if not options or options[-1][0] is not None:
            if n.kind in (ELEMENT, DOCUMENT):
                kept, self.here = self.here, n
                rows, made = self.applied(rows, self.children(n), mode, {}, None)
                self.here = kept
            else:
                made = Made()
                merged(made, Made([], [self.shown(F.coalesce(n.value(), F.lit("")))]) if n.kind in (TEXT, ATTRIBUTE) else Made())
            options.append((None, made))
        return rows, chosen(options)

    def children(self, n: Here) -> list:
        return self.targets(n, Path(None, (Step("child", Test("node")),)))

    def template(self, rows: DataFrame, n: Here, body: Node, params: dict, rule, guard: list) -> tuple[DataFrame, Made]:
        if sum(b is body and h == (id(n.shape), n.kind, n.name) for b, h in self.calls) or len(self.calls) > 60:
            raise Unsupported("a template that comes back to itself")
        kept, before = self.scoped(), self.guards
        self.calls.append((body, (id(n.shape), n.kind, n.name)))
        self.unbind(set(self.bound) - set(self.sheet.globals))
        self.guards = before + guard
        try:
            return self.body(rows, n, body, {"params": params, "rule": rule})
        finally:
            self.calls.pop()
            self.guards = before
            self.back(kept)

    def body(self, rows: DataFrame, n: Here, parent: Node, how: dict) -> tuple[DataFrame, Made]:
        made, kept = Made(), self.scoped()
        for x in parent.children:
            if x.kind in (TEXT, CDATA):
                if x.value.strip(BLANKS) or any(a.attribute("xml:space") == "preserve" for a in ancestors(x)):
                    made.content.append(self.shown(F.lit(x.value)))
            elif x.kind == ELEMENT:
                rows, more = self.instruction(rows, n, x, how) if x.ns == XSL else self.literal(rows, n, x, how)
                merged(made, more)
        self.back(kept)
        return rows, made

    def shown(self, c: Column) -> Column:
        return c if self.plain_text else escaped(c)

    def fill(self, rows: DataFrame, n: Here, text: str) -> tuple[DataFrame, Column]:
        parts = []
        for p in value_template(text):
            if isinstance(p, str):
                parts.append(F.lit(p))
            else:
                rows, col = self.string_at(n, rows, p)
                parts.append(col)
        return rows, F.concat(*parts) if parts else F.lit("")

    def element(self, rows, n, name: Column | str, content: Node, how: dict, sets: str | None, attributes: list) -> tuple[DataFrame, Made]:
        inside = Made()
        for s in (sets or "").split():
            for own in self.sheet.sets.get(s, []):
                if own.attribute("use-attribute-sets"):
                    raise Unsupported("attribute sets of attribute sets")
                rows, more = self.body(rows, n, own, how)
                merged(inside, more)
        for a, v in attributes:
            rows, col = self.fill(rows, n, v)
            merged(inside, Made([(a, col, None)]))
        rows, more = self.body(rows, n, content, how)
        merged(inside, more)
        return rows, self.tag(name, inside)

    def tag(self, name: Column | str, inside: Made) -> Made:
        if self.plain_text:
            return Made([], inside.content)
        if len({a for a, _, _ in inside.attributes}) < len(inside.attributes):
            raise Unsupported("an attribute set twice")
        parts = []
        for a, v, cond in inside.attributes:
            part = F.concat(F.lit(f' {a}="'), in_attribute(v), F.lit('"'))
            parts.append(part if cond is None else F.when(cond, part).otherwise(F.lit("")))
        name = F.lit(name) if isinstance(name, str) else name
        head = F.concat(F.lit("<"), name, *parts)
        if not inside.content:
            return Made([], [head, F.lit("/>")])
        inner = inside.text()
        return Made([], [head, F.when(inner == "", F.lit("/>")).otherwise(F.concat(F.lit(">"), inner, F.lit("</"), name, F.lit(">")))])

    def literal(self, rows: DataFrame, n: Here, x: Node, how: dict) -> tuple[DataFrame, Made]:
        if ":" in x.name or x.ns or self.sheet.alias:
            raise Unsupported("namespaces")
        sets = next((a.value for a in x.attributes if a.ns == XSL and a.local == "use-attribute-sets"), None)
        if any(":" in a.name and a.ns != XSL for a in x.attributes):
            raise Unsupported("namespaces")
        return self.element(rows, n, x.name, x, how, sets, [(a.name, a.value) for a in x.attributes if a.ns != XSL])

    def top_only(self, n: Here, what: str) -> None:
        if n.shape is not self.top:
            raise Unsupported(f"{what} for child rows")

    def instruction(self, rows: DataFrame, n: Here, x: Node, how: dict) -> tuple[DataFrame, Made]:
        read = lambda name, default=None: parse(x.attribute(name, default), self.sheet.limits)
        match x.local:
            case "apply-templates":
                rows, params = self.params(rows, n, x)
                sorts = [c for c in x.children if c.kind == ELEMENT and c.local == "sort"]
                kept, self.here = self.here, n
                rows, made = self.applied(rows, self.targets(n, read("select", "node()")), x.attribute("mode", ""), params, sorts)
                self.here = kept
                return rows, made
            case "apply-imports":
                rule = how["rule"]
                return self.one(rows, n, rule.mode if rule else "", {}, rule.precedence) if rule else (rows, Made())
            case "call-template":
                if x.attribute("name") not in self.sheet.named:
                    raise Unsupported("no such template")
                rows, params = self.params(rows, n, x)
                body = self.sheet.named[x.attribute("name")][1]
                if any(b is body for b, _ in self.calls):
                    raise Unsupported("a template that comes back to itself")
                return self.template(rows, n, body, params, how["rule"], [])
            case "for-each":
                sorts, found = [c for c in x.children if c.kind == ELEMENT and c.local == "sort"], self.targets(n, read("select"))
                made = Made()
                for t in found:
                    if isinstance(t, Group):
                        if len(found) > 1:
                            raise Unsupported("several kinds of nodes in one loop")
                        rows, more = self.each(rows, t, sorts, lambda r, h: self.body(r, h, x, how), True)
                    else:
                        rows, more = self.body(rows, single(t, len(found) == 1), x, how)
                        more = conditional(more, t.exists()) if t.kind in (ATTRIBUTE, TEXT) else more
                    merged(made, more)
                return rows, made
            case "value-of":
                rows, col = self.string_at(n, rows, read("select", "."))
                return rows, Made([], [col if x.attribute("disable-output-escaping") == "yes" else self.shown(col)])
            case "text":
                return rows, Made([], [F.lit(x.text()) if x.attribute("disable-output-escaping") == "yes" else self.shown(F.lit(x.text()))])
            case "element":
                if x.attribute("namespace") is not None:
                    raise Unsupported("namespaces")
                rows, name = self.fill(rows, n, x.attribute("name"))
                if "{" in x.attribute("name"):
                    self.top_only(n, "computed names")
                    self.problems.append((self.guard(~F.regexp_like(name, F.lit(f"^(?:{ELEMENT_NAME})$"))), F.concat(F.lit("'"), name, F.lit("' is no element name"))))
                elif ":" in x.attribute("name") or not re.fullmatch(ELEMENT_NAME, x.attribute("name")):
                    raise Unsupported("namespaces")
                return self.element(rows, n, name, x, how, x.attribute("use-attribute-sets"), [])
            case "attribute":
                if "{" in x.attribute("name") or ":" in x.attribute("name") or x.attribute("namespace") is not None:
                    raise Unsupported("computed names of attributes")
                rows, v = self.content(rows, n, x, how)
                return rows, Made([(x.attribute("name"), v, None)])
            case "comment":
                rows, v = self.content(rows, n, x, how)
                return rows, Made([], [] if self.plain_text else [F.lit("<!--"), F.regexp_replace(v, "-(?=-|$)", "- "), F.lit("-->")])
            case "processing-instruction":
                rows, name = self.fill(rows, n, x.attribute("name"))
                rows, v = self.content(rows, n, x, how)
                v = F.replace(v, F.lit("?>"), F.lit("? >"))
                return rows, Made([], [] if self.plain_text else [F.lit("<?"), name, F.when(v == "", "").otherwise(F.concat(F.lit(" "), v)), F.lit("?>")])
            case "if":
                rows, cond, _ = self.at(n, rows, read("test"), "boolean")
                self.guards.append(cond)
                rows, made = self.body(rows, n, x, how)
                self.guards.pop()
                return rows, conditional(made, cond)
            case "choose":
                options, before = [], self.guards
                for c in [c for c in x.children if c.kind == ELEMENT]:
                    cond = None
                    if c.local == "when":
                        rows, cond, _ = self.at(n, rows, parse(c.attribute("test"), self.sheet.limits), "boolean")
                    self.guards = [*self.guards, *([cond] if cond is not None else [])]
                    rows, made = self.body(rows, n, c, how)
                    options.append((cond, made))
                    self.guards = [*before, *[~o for o, _ in options if o is not None]]
                self.guards = before
                return rows, chosen([*options, (None, Made())] if options[-1][0] is not None else options)
            case "copy":
                if n.kind == ELEMENT:
                    return self.element(rows, n, n.name, x, how, x.attribute("use-attribute-sets"), [])
                if n.kind == DOCUMENT:
                    return self.body(rows, n, x, how)
                return rows, self.copied(n)
            case "copy-of":
                tree = read("select")
                if type_of(tree, self.variables) != "nodes":
                    rows, col = self.string_at(n, rows, tree)
                    return rows, Made([], [self.shown(col)])
                made, kept = Made(), self.here
                self.here = n
                for t in self.targets(n, tree):
                    rows, more = self.each(rows, t, [], self.deep, True) if isinstance(t, Group) and t.leaf is None else self.deep(rows, t)
                    merged(made, more)
                self.here = kept
                return rows, made
            case "variable":
                if x.children:
                    raise Unsupported("variables that are fragments")
                tree = read("select", "''")
                if type_of(tree, self.variables) == "nodes":
                    raise Unsupported("variables that are nodes")
                rows, *value = self.valued(n, rows, tree)
                self.bind(x.attribute("name"), *value)
                return rows, Made()
            case "param":
                name = x.attribute("name")
                if name in how["params"]:
                    self.bind(name, *how["params"][name])
                    return rows, Made()
                if x.children:
                    raise Unsupported("parameters that are fragments")
                rows, *value = self.valued(n, rows, read("select", "''"))
                self.bind(name, *value)
                return rows, Made()
            case "number":
                return self.numbered(rows, n, x)
            case "message":
                self.top_only(n, "messages")
                rows, v = self.content(rows, n, x, how)
                self.said.append(F.when(self.guard(), F.array(v)).otherwise(F.array().cast("array<string>")))
                if x.attribute("terminate") == "yes":
                    self.problems.append((self.guard(), v))
                return rows, Made()
            case "sort" | "with-param" | "fallback":
                return rows, Made()
        raise Unsupported(f"xsl:{x.local}")

    def guard(self, *more: Column) -> Column:
        out = F.lit(True)
        for c in [*self.guards, *more]:
            out = out & F.coalesce(c, F.lit(False))
        return out

    def content(self, rows: DataFrame, n: Here, x: Node, how: dict) -> tuple[DataFrame, Column]:
        """The text that a body makes."""
        before, self.plain_text = self.plain_text, True
        rows, made = self.body(rows, n, x, how)
        self.plain_text = before
        return rows, made.text()

    def params(self, rows: DataFrame, n: Here, x: Node) -> tuple[DataFrame, dict]:
        out = {}
        for c in x.children:
            if c.kind == ELEMENT and c.local == "with-param":
                if c.children:
                    raise Unsupported("parameters that are fragments")
                tree = parse(c.attribute("select", "''"), self.sheet.limits)
                if type_of(tree, self.variables) == "nodes":
                    found = self.targets(n, tree)
                    if len(found) != 1 or not isinstance(found[0], Here) or found[0].kind != ATTRIBUTE:
                        raise Unsupported("parameters that are nodes")
                    out[c.attribute("name")] = F.coalesce(found[0].value(), F.lit("")), "string", True
                    if self.kept_as_nodes(c):
                        raise Unsupported("parameters that are nodes")
                else:
                    rows, *value = self.valued(n, rows, tree)
                    out[c.attribute("name")] = tuple(value)
        return rows, out

    def kept_as_nodes(self, c: Node) -> bool:
        """Whether a parameter that is one attribute may be asked for more than its text: its truth, number or order, a comparison (where no node is not the empty text), or a path from it."""
        x = rf"\${re.escape(c.attribute('name'))}(?![\w.-])"
        more = re.compile(rf"(?:count|sum|boolean|not|name|local-name|namespace-uri)\(\s*{x}|{x}\s*[/\[|=!<>]|[=<>]\s*{x}|(?:^|\b(?:and|or)\b)\s*{x}\s*(?:$|\b(?:and|or)\b)")
        bodies = [body for _, body in self.sheet.named.values()] + [r.body for r in self.sheet.rules]
        return any(more.search(a.value) for body in bodies for n in _inside(body) for a in n.attributes)

    def each(self, rows: DataFrame, g: Group, sorts, make: Callable, alone: bool) -> tuple[DataFrame, Made]:
        """The child rows' results, joined in order. Positions are known where these rows are all that is listed."""
        if g.leaf is not None:
            raise Unsupported("attributes of child rows as nodes")
        scope = self.scoped()
        self.unbind(self.local)
        inner, here = self.inner(g)
        keys, shape = g.above.shape.key, g.shape
        by = [F.col(c) for c in shape.order]
        kept, self.here = self.here, here
        for s in reversed(sorts or []):
            down, number = s.attribute("order", "ascending") == "descending", s.attribute("data-type", "text") == "number"
            if any("{" in a.value for a in s.attributes if a.name != "select"):
                raise Unsupported("computed sort orders")
            inner, v = self.string_at(here, inner, parse(s.attribute("select", "."), self.sheet.limits))
            if number:
                v = F.coalesce(F.regexp_extract(v, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))
            else:
                v = F.collate(F.lower(v) if s.attribute("case-order") == "lower-first" else F.upper(v), "UNICODE")
            name = next(self.names)
            inner = inner.withColumn(name, v)
            by = [F.desc(name) if down else F.asc(name), *by]
        part = Window.partitionBy(*keys)
        pos, size = next(self.names), next(self.names)
        place = lambda r: (r if pos in r.columns else r.withColumn(pos, F.row_number().over(part.orderBy(*by)).cast("double")), F.col(pos))
        count = lambda r: (r if size in r.columns else r.withColumn(size, F.count(F.lit(1)).over(part).cast("double")), F.col(size))
        if alone:
            here.pos, here.size = place, count
        calls = self.calls
        inner, made = make(inner, here)
        self.calls, self.here = calls, kept
        self.back(scope)
        if made.attributes:
            raise Unsupported("attributes from child rows")
        if sorts:
            inner, order = place(inner)
            order = [order]
        else:
            order = [F.col(c) for c in shape.order]
        v, key = next(self.names), [next(self.names) for _ in keys]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], made.text().alias("x")))), lambda r: r["x"]), "")
        whole = inner.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, key)]).agg(joined.alias(v))
        rows = rows.join(whole, [F.col(k) == F.col(x) for k, x in zip(keys, key)], "left").drop(*key)
        return rows, Made([], [F.coalesce(F.col(v), F.lit(""))])

    def copied(self, n: Here) -> Made:
        if n.kind == ATTRIBUTE:
            return Made([(n.name, F.coalesce(n.value(), F.lit("")), n.exists())])
        return Made([], [self.shown(F.coalesce(n.value(), F.lit("")))])

    def deep(self, rows: DataFrame, n: Here) -> tuple[DataFrame, Made]:
        if n.kind not in (ELEMENT, DOCUMENT):
            return rows, self.copied(n)
        inside, kept = Made(), self.here
        self.here = n
        if n.kind == ELEMENT:
            for name, _ in n.shape.attributes:
                merged(inside, self.copied(n.attribute(name)))
        for t in self.children(n):
            rows, more = self.each(rows, t, [], self.deep, True) if isinstance(t, Group) else self.deep(rows, t)
            if isinstance(t, Here) and t.kind == TEXT:
                more = conditional(more, t.exists())
            merged(inside, more)
        self.here = kept
        return rows, self.tag(n.name, inside) if n.kind == ELEMENT else inside

    def numbered(self, rows: DataFrame, n: Here, x: Node) -> tuple[DataFrame, Made]:
        form = re.fullmatch(r"([^\w{]*)(\w+)([^\w{]*)", x.attribute("format", "1"))
        if not form or form[2].lstrip("0") not in ("1", "a", "A", "i", "I") or x.attribute("level", "single") != "single" or x.attribute("count") or x.attribute("from"):
            raise Unsupported("numbers of this kind")
        if x.attribute("value") is not None:
            rows, v, _ = self.at(n, rows, parse(x.attribute("value"), self.sheet.limits), "number")
            number = sc.round_(v)
            if form[2].lstrip("0") != "1":
                raise Unsupported("values as letters")
            shown = F.when(F.isnan(v) | (F.abs(v) == float("inf")), sc.string_of(v, "number")).otherwise(F.concat(F.lit(form[1]), F.lpad(sc.string_of(number, "number"), len(form[2]), "0") if len(form[2]) > 1 else sc.string_of(number, "number"), F.lit(form[3])))
            return rows, Made([], [self.shown(shown)])
        if n.kind != ELEMENT or n.shape is self.top:
            return rows, Made([], [self.shown(F.lit(form[1] + form[2][:-1] + form[2][-1] + form[3]))])
        if len([c for c in n.above.shape.children if c.name == n.name]) != 1:
            raise Unsupported("numbers of several kinds of rows")
        if n.filtered:
            raise Unsupported("numbers among rows that were filtered")
        place = next(self.names)
        rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*n.above.shape.key).orderBy(*n.shape.order)))
        return rows, Made([], [self.shown(F.concat(F.lit(form[1]), numeral(F.col(place), form[2]), F.lit(form[3])))])


def single(t: Here, alone: bool) -> Here:
    """A node that is the only one of its list knows its position."""
    one = (lambda r: (r, F.lit(1.0))) if alone else None
    return Here(t.shape, t.kind, t.name, t.above, one, one)


def numeral(n: Column, form: str) -> Column:
    last = form[-1]
    if last == "1":
        shown = n.cast("string")
        return F.when(F.length(shown) < len(form), F.lpad(shown, len(form), "0")).otherwise(shown) if len(form) > 1 else shown
    if last in "aA":
        first = ord(last)
        letter = lambda k: F.char((k % 26 + first).cast("int"))
        return F.when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(F.floor((n - 27) / 26)), letter((n - 1) % 26))).otherwise(n.cast("string"))
    rest, out = n, F.lit("")
    for value, text in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out = F.concat(out, F.repeat(F.lit(text if last == "I" else text.lower()), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def _inside(n: Node):
    for c in n.children:
        yield c
        yield from _inside(c)


def merged(into: Made, more: Made) -> None:
    if more.attributes and into.content:
        raise Unsupported("attributes after content")
    into.attributes += more.attributes
    into.content += more.content


def conditional(made: Made, cond: Column) -> Made:
    cond = F.coalesce(cond, F.lit(False))
    return Made([(a, v, cond if c is None else c & cond) for a, v, c in made.attributes], [F.when(cond, made.text()).otherwise(F.lit(""))] if made.content else [])


def chosen(options: list[tuple[Column | None, Made]]) -> Made:
    """The first option whose condition holds; the last has none."""
    if len(options) == 1:
        return options[0][1]
    if any(m.attributes for _, m in options):
        out, open_ = Made(), F.lit(True)
        for cond, m in options:
            holds = open_ if cond is None else open_ & F.coalesce(cond, F.lit(False))
            part = conditional(m, holds)
            out.attributes += part.attributes
            out.content += part.content
            if cond is not None:
                open_ = open_ & ~F.coalesce(cond, F.lit(False))
        return out
    col = None
    for cond, m in options[:-1]:
        cond = F.coalesce(cond, F.lit(False))
        col = F.when(cond, m.text()) if col is None else col.when(cond, m.text())
    return Made([], [col.otherwise(options[-1][1].text())]) if any(m.content for _, m in options) else Made()


def publish(top: Shape, sheet: Stylesheet, parameters: dict) -> DataFrame:
    """``(doc_id, xml, error, messages)``; raises Unsupported where the stylesheet needs the per-document tier."""
    return Publisher(top, sheet, parameters).plan()


def written(top: Shape) -> DataFrame:
    """``(doc_id, xml)``: the shape's documents as text."""
    copy = Stylesheet(f'<x:stylesheet version="1.0" xmlns:x="{XSL}"><x:template match="/"><x:copy-of select="*"/></x:template></x:stylesheet>')
    return publish(top, copy, {}).select("doc_id", "xml")
