"""XSLT 1.0 stylesheets: compiled once on the driver, run per document inside Arrow batches.

A document that fails gives its message and no output; it never stops the others. Template recursion is bounded by ``DEEPEST``.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.parsers import expat

from sylvan.functions.scalars import number_text
from sylvan.operators.tree import BLANKS, FRAGMENT, Context, Node, ancestors, build, descendants, evaluate, holding, ordered, passes, renumber, to_boolean, to_number, to_string
from sylvan.functions.collation import sort_key
from sylvan.plans.syntax import USUAL, Binary, Call, Limits, Path, parse
from sylvan.sources.relational import ATTRIBUTE, CDATA, COMMENT, DOCUMENT, ELEMENT, PI, TEXT
from sylvan.sources.shred import VOID, html_rows, xml_rows

XSL = "http://www.w3.org/1999/XSL/Transform"
DEEPEST = 400
ELEMENT_NAME = r"[^\s<>&\"'=/]+"
ABSOLUTE = re.compile(r"https?://|/")


class StylesheetError(ValueError):
    pass


class Terminated(StylesheetError):
    """xsl:message with terminate="yes"."""


@dataclass
class Rule:
    arm: object
    body: Node
    mode: str
    priority: float
    precedence: int
    order: int


@dataclass
class Output:
    """Settings of xsl:output. A declaration is written only where the stylesheet asks for one, as results are fragments."""

    method: str = "xml"
    declaration: bool = False
    indent: bool = False
    other: dict = field(default_factory=dict)
    cdata: frozenset = frozenset()


def namespaces_of(text: str) -> dict[str, str]:
    """Prefixes declared on the root element."""
    found, depth = {}, [0]
    p = expat.ParserCreate(namespace_separator=" ")

    def declared(prefix, uri):
        if prefix and not depth[0]:
            found[prefix] = uri or ""

    def opened(*_):
        depth[0] += 1

    p.StartNamespaceDeclHandler, p.StartElementHandler = declared, opened
    p.Parse(text, True)
    return found


def resolve(href: str, base: str | None) -> str:
    if ABSOLUTE.match(href) or not base:
        return href
    return base[: base.rfind("/") + 1] + href


def default_priority(arm) -> float:
    """-0.5 for kind tests, -0.25 for p:*, 0 for names, 0.5 for all else."""
    if isinstance(arm, Path) and arm.start is None and len(arm.steps) == 1 and not arm.steps[0].predicates and arm.steps[0].axis in ("child", "attribute"):
        t = arm.steps[0].test
        if t.kind == "name":
            return 0.0 if t.local != "*" else -0.25 if t.prefix else -0.5
        return 0.0 if t.kind == "processing-instruction" and t.local is not None else -0.5
    return 0.5


def arms(tree) -> list:
    return [*arms(tree.left), *arms(tree.right)] if isinstance(tree, Binary) and tree.op == "|" else [tree]


def value_template(text: str) -> list:
    """Literal parts and expressions of an attribute value template."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if text[at : at + 2] in ("{{", "}}"):
            out.append(c)
            at += 2
        elif c == "{":
            m = re.compile(r"""(?:[^'"}]|"[^"]*"|'[^']*')*""").match(text, at + 1)
            if m.end() >= len(text) or text[m.end()] != "}":
                raise StylesheetError(f"unclosed {{ in {text!r}")
            out.append(parse(m.group()))
            at = m.end() + 1
        elif c == "}":
            raise StylesheetError(f"lone }} in {text!r}")
        else:
            m = re.compile(r"[^{}]+").match(text, at)
            out.append(m.group())
            at = m.end()
    return out


# Attributes without which an instruction or declaration means nothing.
REQUIRED = {
    "if": ("test",), "when": ("test",), "copy-of": ("select",), "call-template": ("name",), "element": ("name",), "attribute": ("name",), "processing-instruction": ("name",), "with-param": ("name",), "variable": ("name",),
    "param": ("name",), "key": ("name", "match", "use"), "attribute-set": ("name",), "namespace-alias": ("stylesheet-prefix", "result-prefix"), "strip-space": ("elements",), "preserve-space": ("elements",), "include": ("href",), "import": ("href",),
}


def checked(n: Node) -> None:
    """Raises unless xsl elements have the attributes they need; an element with the literal prefix xsl counts as one whatever its namespace."""
    for x in [n, *descendants(n)]:
        if x.kind == ELEMENT and x.name.startswith("xsl:"):
            x.ns = XSL
        if x.kind == ELEMENT and x.ns == XSL:
            for a in x.attributes:
                if a.name.startswith("xsl:"):
                    a.ns = XSL
            if missing := [a for a in REQUIRED.get(x.local, ()) if x.attribute(a) is None]:
                raise StylesheetError(f"xsl:{x.local} needs {missing[0]}")
            if x.local == "choose":
                own = [c.local for c in x.children if c.kind == ELEMENT]
                if "when" not in own or "otherwise" in own[:-1]:
                    raise StylesheetError("xsl:choose needs an xsl:when, and xsl:otherwise comes last")


class Stylesheet:
    INSTRUCTIONS = {"apply-templates", "apply-imports", "call-template", "value-of", "text", "element", "attribute", "if", "choose", "for-each", "copy", "copy-of", "variable", "param", "comment", "processing-instruction", "number", "message", "fallback"}

    def __init__(self, text: str, loader: Callable[[str, str | None], str] | None = None, uri: str | None = None, limits: Limits = USUAL):
        self.loader, self.limits = loader, limits
        self.warnings: list[str] = []
        self.functions: dict[str, Callable[..., str]] = {}
        self.rules: list[Rule] = []
        self.named: dict[str, tuple[int, Node]] = {}
        self.globals: dict[str, tuple[int, Node]] = {}
        self.sets: dict[str, list[Node]] = {}
        self.keys: dict[str, list[tuple]] = {}
        self.formats: dict[str, dict] = {}
        self.alias: dict[str, str] = {}
        self.strip: list[tuple[str, bool]] = []
        self.output, self.namespaces = Output(), {"xml": "http://www.w3.org/XML/1998/namespace"}
        self.templates: dict[str, list] = {}
        #: The rules that a node may match, by mode, kind, name and namespace.
        self.possible: dict[tuple, list[Rule]] = {}
        self.precedence = 0
        self.load(text, uri, [])
        self.rules.sort(key=lambda r: (-r.precedence, -r.priority, -r.order))

    # compiling

    def load(self, text: str, uri: str | None, open_: list[str]) -> None:
        top = build(xml_rows(text))
        root = next(c for c in top.children if c.kind == ELEMENT)
        self.namespaces |= namespaces_of(text)
        checked(root)
        if root.ns != XSL:
            if not any(a.ns == XSL and a.local == "version" for a in root.attributes):
                raise StylesheetError("neither a stylesheet nor a literal result element with xsl:version")
            self.precedence += 1
            self.rules.append(Rule(Path("root"), top, "", 0.5, self.precedence, len(self.rules)))
            return
        if root.local not in ("stylesheet", "transform"):
            raise StylesheetError(f"xsl:{root.local} is not a stylesheet")
        self.part(root, uri, open_)

    def fetch(self, n: Node, uri: str | None, open_: list[str]) -> tuple[Node, str, list[str]]:
        href = n.attribute("href")
        if not href or self.loader is None:
            raise StylesheetError(f"xsl:{n.local} needs an href and a loader")
        full = resolve(href, uri)
        if full in open_:
            raise StylesheetError(f"{full} includes itself")
        try:
            text = self.loader(href, uri)
            self.namespaces |= namespaces_of(text)
            root = next(c for c in build(xml_rows(text)).children if c.kind == ELEMENT)
            checked(root)
            return root, full, [*open_, full]
        except (OSError, KeyError, ValueError) as e:
            raise StylesheetError(f"can't load {full}: {e}") from None

    def part(self, root: Node, uri: str | None, open_: list[str]) -> None:
        own = [c for c in self.included(root, uri, open_)]
        for n, at, opened in own:
            if n.local == "import":
                self.part(*self.fetch(n, at, opened))
        self.precedence += 1
        for n, _, _ in own:
            if n.local != "import":
                self.declare(n)

    def included(self, root: Node, uri: str | None, open_: list[str]):
        """Declarations in order, with included ones in their place."""
        for n in root.children:
            if n.kind != ELEMENT or n.ns != XSL:
                continue
            if n.local == "include":
                yield from self.included(*self.fetch(n, uri, open_))
            else:
                yield n, uri, open_

    def declare(self, n: Node) -> None:
        match n.local:
            case "template":
                for arm in self.pattern(n.attribute("match")) if n.attribute("match") else []:
                    p = n.attribute("priority")
                    self.rules.append(Rule(arm, n, n.attribute("mode", ""), float(p) if p else default_priority(arm), self.precedence, len(self.rules)))
                if n.attribute("name"):
                    self.named[n.attribute("name")] = (self.precedence, n)
            case "variable" | "param":
                self.globals[n.attribute("name")] = (self.precedence, n)
            case "output":
                o = self.output.other | {a.name: a.value for a in n.attributes}
                asked = "omit-xml-declaration" in o or "standalone" in o or "version" in o
                cdata = self.output.cdata | frozenset(o.get("cdata-section-elements", "").split())
                self.output = Output(o.get("method", "xml"), asked and o.get("omit-xml-declaration", "no") == "no", o.get("indent") == "yes", o, cdata)
            case "key":
                self.keys.setdefault(n.attribute("name"), []).append((arms(parse(n.attribute("match"))), parse(n.attribute("use"))))
            case "decimal-format":
                self.formats[n.attribute("name", "")] = {a.name: a.value for a in n.attributes}
            case "namespace-alias":
                self.alias[n.attribute("stylesheet-prefix")] = n.attribute("result-prefix")
            case "attribute-set":
                self.sets.setdefault(n.attribute("name"), []).append(n)
            case "strip-space" | "preserve-space":
                self.strip += [(name, n.local == "strip-space") for name in n.attribute("elements", "").split()]

    def pattern(self, text: str) -> list:
        """The arms of a pattern; one that can't be read matches nothing, and a warning says so."""
        try:
            return arms(parse(text, self.limits))
        except ValueError as e:
            self.warnings.append(f"pattern {text!r} matches nothing: {e}")
            return []

    # running

    def run(self, top: Node, parameters: dict | None = None, said: list[str] | None = None) -> tuple[Node, list[str]]:
        """The result fragment of one document, and its messages, which go to ``said`` as they come."""
        return Run(self, top, parameters or {}, said).result()


class Run:
    def __init__(self, sheet: Stylesheet, top: Node, parameters: dict, said: list[str] | None = None):
        self.sheet, self.top, self.parameters = sheet, top, parameters
        self.INSTRUCTIONS = sheet.INSTRUCTIONS
        self.messages: list[str] = [] if said is None else said
        self.depth, self.indexes, self.values, self.pending = 0, {}, Globals(self), set()
        if sheet.strip:
            self.stripped(top)
            renumber(top)

    def stripped(self, n: Node) -> None:
        drop = False
        for name, strips in self.sheet.strip:
            if name in ("*", n.name) or name.endswith(":*") and n.name.startswith(name[:-1]):
                drop = strips
        if drop:
            n.children = [c for c in n.children if c.kind != TEXT or c.value.strip(BLANKS) or preserved(c)]
            for i, c in enumerate(n.children):
                c.at = i
        for c in n.children:
            self.stripped(c)

    def result(self) -> tuple[Node, list[str]]:
        self.messages += self.sheet.warnings
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEEPEST))  # a template call takes up to a dozen frames
        out = Node(FRAGMENT)
        self.apply(self.context(self.top), [self.top], "", {}, out)
        return out, self.messages

    def context(self, n: Node, pos: int = 1, size: int = 1, variables=None) -> Context:
        return Context(n, pos, size, self.values if variables is None else variables, self.sheet.namespaces, n, self, self.sheet.limits.nodes)

    def eval(self, expr: str, ctx: Context):
        return evaluate(parse(expr, self.sheet.limits), ctx)

    def fill(self, text: str, ctx: Context) -> str:
        if "{" not in text and "}" not in text:
            return text
        if text not in self.sheet.templates:
            self.sheet.templates[text] = value_template(text)
        return "".join(p if isinstance(p, str) else to_string(evaluate(p, ctx)) for p in self.sheet.templates[text])

    # rules

    def matches(self, arm, n: Node) -> bool:
        """An error in a pattern's predicate counts as no match."""
        try:
            return self.matched(arm, n)
        except ValueError:
            return False

    def matched(self, arm, n: Node) -> bool:
        if isinstance(arm, Path):
            if arm.start not in (None, "root"):
                return any(m is n for m in evaluate(arm, self.context(self.top)))
            return self.steps(n, arm.steps, arm.start == "root")
        return isinstance(arm, Call) and any(m is n for m in evaluate(arm, self.context(self.top)))

    def steps(self, n: Node | None, steps: tuple, rooted: bool) -> bool:
        if not steps:
            return n is not None and (not rooted or n.kind == DOCUMENT)
        s, rest = steps[-1], steps[:-1]
        if s.axis == "descendant-or-self" and s.test.kind == "node":
            return n is not None and any(self.steps(a, rest, rooted) for a in [n, *ancestors(n)]) if rest or rooted else True
        if n is None or n.kind == DOCUMENT or (s.axis == "attribute") != (n.kind == ATTRIBUTE) or not passes(n, s.axis, s.test, self.sheet.namespaces):
            return False
        if s.predicates:
            pool = [n] if n.parent is None else n.parent.attributes if n.kind == ATTRIBUTE else n.parent.children
            pool = [c for c in pool if passes(c, s.axis, s.test, self.sheet.namespaces)]
            if not any(c is n for c in holding(pool, s.predicates, self.context(n))):
                return False
        return self.steps(n.parent, rest, rooted) if rest or rooted else True

    def rule(self, n: Node, mode: str, below: int | None = None) -> Rule | None:
        key = (mode, n.kind, n.name, n.ns)
        if (own := self.sheet.possible.get(key)) is None:
            own = self.sheet.possible[key] = [r for r in self.sheet.rules if r.mode == mode and self.possible(r.arm, n)]
        for r in own:
            if (below is None or r.precedence < below) and self.matches(r.arm, n):
                return r
        return None

    def possible(self, arm, n: Node) -> bool:
        """Whether a node of this kind and name may match, by the last step's test alone."""
        if not isinstance(arm, Path) or not arm.steps or arm.start not in (None, "root"):
            return True
        s = arm.steps[-1]
        if s.axis == "descendant-or-self":
            return True
        return (s.axis == "attribute") == (n.kind == ATTRIBUTE) and n.kind != DOCUMENT and passes(n, s.axis, s.test, self.sheet.namespaces)

    def apply(self, ctx: Context, nodes: list[Node], mode: str, params: dict, out: Node) -> None:
        for i, n in enumerate(nodes, 1):
            self.one(n, i, len(nodes), mode, params, out, self.rule(n, mode))

    def one(self, n: Node, pos: int, size: int, mode: str, params: dict, out: Node, rule: Rule | None) -> None:
        if rule is not None:
            self.template(rule.body, self.context(n, pos, size), params, out, rule)
        elif n.kind in (ELEMENT, DOCUMENT, FRAGMENT):
            self.apply(self.context(n), n.children, mode, {}, out)
        elif n.kind in (TEXT, CDATA, ATTRIBUTE):
            self.text(out, n.value)

    def template(self, body: Node, ctx: Context, params: dict, out: Node, rule: Rule | None = None) -> None:
        self.depth += 1
        if self.depth > DEEPEST:
            raise StylesheetError(f"templates call each other more than {DEEPEST} deep")
        ctx.variables = Scope(self.values)
        ctx.variables.rule = rule
        ctx.variables.given = params
        self.body(body, ctx, out)
        self.depth -= 1

    def body(self, parent: Node, ctx: Context, out: Node) -> None:
        scope = ctx.variables
        ctx.variables = Scope(scope)
        for n in parent.children:
            if n.kind in (TEXT, CDATA):
                if n.value.strip(BLANKS) or preserved(n):
                    self.text(out, n.value)
            elif n.kind == ELEMENT:
                self.instruction(n, ctx, out) if n.ns == XSL else self.literal(n, ctx, out)
        ctx.variables = scope

    # output

    def text(self, out: Node, value: str, raw: bool = False) -> None:
        if value:
            if out.children and out.children[-1].kind == TEXT and out.children[-1].raw == raw:
                out.children[-1].value += value
            else:
                out.add(Node(TEXT, value=value)).raw = raw

    def put_attribute(self, out: Node, name: str, ns: str, value: str) -> None:
        if out.kind != ELEMENT or out.children:
            return
        out.attributes = [a for a in out.attributes if a.name != name]
        out.add(Node(ATTRIBUTE, name, name.rpartition(":")[2], ns, value))

    def copied(self, n: Node, out: Node) -> None:
        if n.kind in (DOCUMENT, FRAGMENT):
            for c in n.children:
                self.copied(c, out)
        elif n.kind == ATTRIBUTE:
            self.put_attribute(out, n.name, n.ns, n.value)
        elif n.kind in (TEXT, CDATA):
            self.text(out, n.value, n.raw)
        else:
            made = out.add(Node(n.kind, n.name, n.local, n.ns, n.value))
            for a in n.attributes:
                made.add(Node(ATTRIBUTE, a.name, a.local, a.ns, a.value))
            for c in n.children:
                self.copied(c, made)

    def use_sets(self, names: str | None, ctx: Context, out: Node, open_: tuple = ()) -> None:
        for name in (names or "").split():
            if name in open_:
                raise StylesheetError(f"attribute set {name} uses itself")
            for s in self.sheet.sets.get(name, []):
                self.use_sets(s.attribute("use-attribute-sets"), ctx, out, (*open_, name))
                own = ctx.variables
                ctx.variables = Scope(self.values)
                for a in s.children:
                    if a.kind == ELEMENT:
                        self.instruction(a, ctx, out)
                ctx.variables = own

    def literal(self, n: Node, ctx: Context, out: Node) -> None:
        prefix, _, local = n.name.rpartition(":")
        ns, name = n.ns, n.name
        if (prefix or "#default") in self.sheet.alias:
            prefix = self.sheet.alias[prefix or "#default"]
            prefix = "" if prefix == "#default" else prefix
            name, ns = f"{prefix}:{local}" if prefix else local, self.sheet.namespaces.get(prefix, "")
        made = out.add(Node(ELEMENT, name, local, ns))
        self.use_sets(next((a.value for a in n.attributes if a.ns == XSL and a.local == "use-attribute-sets"), None), ctx, made)
        for a in n.attributes:
            if a.ns != XSL:
                self.put_attribute(made, a.name, a.ns, self.fill(a.value, ctx))
        self.body(n, ctx, made)

    # instructions

    def nodes(self, n: Node, ctx: Context, default: str) -> list[Node]:
        found = self.eval(n.attribute("select", default), ctx)
        if not isinstance(found, list):
            raise StylesheetError(f"xsl:{n.local} takes a node-set")
        return self.sorted(n, found, ctx)

    def sorted(self, n: Node, found: list[Node], ctx: Context) -> list[Node]:
        for s in [c for c in n.children if c.kind == ELEMENT and c.local == "sort"][::-1]:
            key = parse(s.attribute("select", "."))
            values = [to_string(evaluate(key, ctx.at(x, ctx.pos, ctx.size, current=x))) for x in found]
            if self.fill(s.attribute("data-type", "text"), ctx) == "number":
                keyed = [leading(v) for v in values]
            else:
                lower = self.fill(s.attribute("case-order", "upper-first"), ctx) == "lower-first"
                keyed = [sort_key(v.lower() if lower else v.upper()) for v in values]
            order = sorted(range(len(found)), key=keyed.__getitem__, reverse=self.fill(s.attribute("order", "ascending"), ctx) == "descending")
            if self.fill(s.attribute("order", "ascending"), ctx) == "descending":  # ties stay in their order
                order = sorted(range(len(found) - 1, -1, -1), key=keyed.__getitem__)[::-1]
            found = [found[i] for i in order]
        return found

    def params(self, n: Node, ctx: Context) -> dict:
        return {c.attribute("name"): self.value(c, ctx) for c in n.children if c.kind == ELEMENT and c.local == "with-param"}

    def value(self, n: Node, ctx: Context):
        if n.attribute("select") is not None:
            return self.eval(n.attribute("select"), ctx)
        if not n.children:
            return ""
        made = Node(FRAGMENT)
        self.body(n, ctx, made)
        renumber(made)
        return [made]

    def content(self, n: Node, ctx: Context) -> str:
        made = Node(FRAGMENT)
        self.body(n, ctx, made)
        return made.text()

    def instruction(self, n: Node, ctx: Context, out: Node) -> None:
        match n.local:
            case "apply-templates":
                params = self.params(n, ctx)
                self.apply(ctx, self.nodes(n, ctx, "node()"), n.attribute("mode", ""), params, out)
            case "apply-imports":
                own = ctx.variables.find("rule")
                self.one(ctx.node, ctx.pos, ctx.size, own.mode if own else "", {}, out, self.rule(ctx.node, own.mode, own.precedence) if own else None)
            case "call-template":
                if n.attribute("name") not in self.sheet.named:
                    raise StylesheetError(f"no template is named {n.attribute('name')}")
                self.template(self.sheet.named[n.attribute("name")][1], ctx.at(ctx.node, ctx.pos, ctx.size), self.params(n, ctx), out, ctx.variables.find("rule"))
            case "for-each":
                found = self.nodes(n, ctx, ".")
                for i, x in enumerate(found, 1):
                    self.body(n, ctx.at(x, i, len(found), current=x), out)
            case "value-of":
                self.text(out, to_string(self.eval(n.attribute("select", "."), ctx)), n.attribute("disable-output-escaping") == "yes")
            case "text":
                self.text(out, n.text(), n.attribute("disable-output-escaping") == "yes")
            case "element":
                name = self.fill(n.attribute("name", ""), ctx)
                ns = self.fill(n.attribute("namespace"), ctx) if n.attribute("namespace") is not None else self.sheet.namespaces.get(name.rpartition(":")[0], "")
                if not re.fullmatch(ELEMENT_NAME, name):
                    raise StylesheetError(f"{name!r} is no element name")
                made = out.add(Node(ELEMENT, name, name.rpartition(":")[2], ns))
                self.use_sets(n.attribute("use-attribute-sets"), ctx, made)
                self.body(n, ctx, made)
            case "attribute":
                name = self.fill(n.attribute("name", ""), ctx)
                self.put_attribute(out, name, self.fill(n.attribute("namespace", self.sheet.namespaces.get(name.rpartition(":")[0], "")), ctx), self.content(n, ctx))
            case "comment":
                out.add(Node(COMMENT, value=re.sub(r"-(?=-|$)", "- ", self.content(n, ctx))))
            case "processing-instruction":
                name = self.fill(n.attribute("name", ""), ctx)
                out.add(Node(PI, name, name, "", self.content(n, ctx).replace("?>", "? >")))
            case "if":
                if to_boolean(self.eval(n.attribute("test"), ctx)):
                    self.body(n, ctx, out)
            case "choose":
                for c in [c for c in n.children if c.kind == ELEMENT]:
                    if c.local == "otherwise" or to_boolean(self.eval(c.attribute("test"), ctx)):
                        self.body(c, ctx, out)
                        break
            case "copy":
                x = ctx.node
                if x.kind == ELEMENT:
                    made = out.add(Node(ELEMENT, x.name, x.local, x.ns))
                    self.use_sets(n.attribute("use-attribute-sets"), ctx, made)
                    self.body(n, ctx, made)
                elif x.kind in (DOCUMENT, FRAGMENT):
                    self.body(n, ctx, out)
                else:
                    self.copied(x, out)
            case "copy-of":
                v = self.eval(n.attribute("select"), ctx)
                for x in v if isinstance(v, list) else []:
                    self.copied(x, out)
                if not isinstance(v, list):
                    self.text(out, to_string(v))
            case "variable":
                ctx.variables[n.attribute("name")] = self.value(n, ctx)
            case "param":
                given, name = ctx.variables.find("given") or {}, n.attribute("name")
                ctx.variables[name] = given[name] if name in given else self.value(n, ctx)
            case "number":
                self.text(out, self.numbered(n, ctx))
            case "message":
                said = self.content(n, ctx)
                self.messages.append(said)
                if n.attribute("terminate") == "yes":
                    raise Terminated(said)
            case "sort" | "with-param" | "fallback":
                pass
            case other:
                self.messages.append(f"unknown instruction xsl:{other}")
                for c in n.children:
                    if c.kind == ELEMENT and c.ns == XSL and c.local == "fallback":
                        self.body(c, ctx, out)

    def numbered(self, n: Node, ctx: Context) -> str:
        form = self.fill(n.attribute("format", "1"), ctx)
        if n.attribute("value") is not None:
            v = to_number(self.eval(n.attribute("value"), ctx))
            return to_string(v) if math.isnan(v) or math.isinf(v) else self.formatted([int(math.floor(v + 0.5))], form)
        x = ctx.node
        count = arms(parse(n.attribute("count"))) if n.attribute("count") else None
        stop = arms(parse(n.attribute("from"))) if n.attribute("from") else []
        counts = lambda y: any(self.matches(a, y) for a in count) if count else y.kind == x.kind and y.name == x.name
        chain = []
        for a in [x, *ancestors(x)]:
            if a is not x and any(self.matches(p, a) for p in stop):
                break
            chain.append(a)
        level = n.attribute("level", "single")
        place = lambda y: self.before(y, n, counts)
        if level == "any":
            begin = max((y.pre for y in [self.top, *descendants(self.top)] if y.pre < x.pre and any(self.matches(p, y) for p in stop)), default=-1)
            numbers = [sum(counts(y) for y in descendants(self.top) if begin < y.pre <= x.pre)]
        elif level == "multiple":
            numbers = [place(y) for y in chain[::-1] if counts(y)]
        else:
            numbers = [place(y) for y in chain if counts(y)][:1]
        return self.formatted(numbers, form)

    def before(self, y: Node, n: Node, counts) -> int:
        """One more than the siblings before y that count; worked out once for all children of a parent."""
        if y.parent is None or y.kind == ATTRIBUTE:
            return 1
        key = ("number", id(n), id(y.parent), y.name if n.attribute("count") is None else None)
        if key not in self.indexes:
            seen, out = 1, []
            for z in y.parent.children:
                out.append(seen)
                seen += counts(z)
            self.indexes[key] = out
        return self.indexes[key][y.at]

    def formatted(self, numbers: list[int], form: str) -> str:
        forms, between = re.findall(r"\w+", form) or ["1"], re.split(r"\w+", form)
        out = between[0]
        for i, v in enumerate(numbers):
            if i:
                out += (between[i] if i < len(between) - 1 else between[-2] if len(between) > 2 else ".") or "."
            out += number_text(v, forms[min(i, len(forms) - 1)]) if v > 0 or forms[min(i, len(forms) - 1)].isdigit() else str(v)
        return out + (between[-1] if len(between) > 1 else "")

    # functions that need the stylesheet

    def function(self, name: str, args: list, ctx: Context):
        if name == "key":
            index = self.index(to_string(args[0]))
            wanted = [n.text() for n in args[1]] if isinstance(args[1], list) else [to_string(args[1])]
            return ordered([n for w in wanted for n in index.get(w, [])])
        if name == "document":
            if self.sheet.loader is None:
                raise StylesheetError("document() needs a loader")
            wanted = to_string(args[0])
            if ("doc", wanted) not in self.indexes:
                self.indexes["doc", wanted] = build(xml_rows(self.sheet.loader(wanted, None)))
            return [self.indexes["doc", wanted]]
        return format_number(to_number(args[0]), to_string(args[1]), self.sheet.formats.get(to_string(args[2]) if len(args) > 2 else "", {}))

    def index(self, name: str) -> dict[str, list[Node]]:
        if name not in self.sheet.keys:
            raise StylesheetError(f"no key is named {name}")
        if name not in self.indexes:
            found: dict[str, list[Node]] = {}
            self.indexes[name] = found
            for x in [self.top, *descendants(self.top)]:
                for y in [x, *x.attributes]:
                    for match, use in self.sheet.keys[name]:
                        if any(self.matches(a, y) for a in match):
                            v = evaluate(use, self.context(y))
                            for w in {n.text() for n in v} if isinstance(v, list) else {to_string(v)}:
                                found.setdefault(w, []).append(y)
        return self.indexes[name]


class Scope(dict):
    """Variables of a template or block; what isn't here is looked for outside."""

    def __init__(self, outer):
        super().__init__()
        self.outer, self.rule, self.given = outer, None, None

    def __contains__(self, name):
        return super().__contains__(name) or name in self.outer

    def __missing__(self, name):
        return self.outer[name]

    def find(self, what: str):
        own = getattr(self, what)
        return own if own is not None else self.outer.find(what)


class Globals(dict):
    """Global variables and parameters, evaluated when first asked for, so in any order; a circle is an error."""

    def __init__(self, run: Run):
        super().__init__()
        self.run = run

    def __contains__(self, name):
        return super().__contains__(name) or name in self.run.sheet.globals

    def __missing__(self, name):
        run, n = self.run, self.run.sheet.globals[name][1]
        if n.local == "param" and name in run.parameters:
            v = run.parameters[name]
            self[name] = v if isinstance(v, (bool, str)) else float(v)
        else:
            if name in run.pending:
                raise StylesheetError(f"variable {name} depends on itself")
            run.pending.add(name)
            self[name] = run.value(n, run.context(run.top, variables=Scope(self)))
            run.pending.discard(name)
        return self[name]

    def find(self, what: str):
        return None


def leading(text: str) -> float:
    """The number at a text's start, 0 if there is none."""
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text)
    return float(m[1]) if m else 0.0


def format_number(x: float, pattern: str, named: dict) -> str:
    """format-number() with a decimal format's signs; halves go to even."""
    from decimal import ROUND_HALF_EVEN, Decimal

    sign = {"decimal-separator": ".", "grouping-separator": ",", "infinity": "Infinity", "minus-sign": "-", "NaN": "NaN", "percent": "%", "per-mille": "‰", "zero-digit": "0", "digit": "#", "pattern-separator": ";"} | named
    if math.isnan(x):
        return sign["NaN"]
    positive, _, negative = pattern.partition(sign["pattern-separator"])
    active = {sign[k] for k in ("decimal-separator", "grouping-separator", "zero-digit", "digit")}
    sub = negative if x < 0 and negative else positive
    places = [i for i, c in enumerate(sub) if c in active]
    head, tail = (sub[: places[0]], sub[places[-1] + 1 :]) if places else (sub, "")
    core = [c for i, c in enumerate(positive) if c in active]
    lead = sign["minus-sign"] if x < 0 and not negative else ""
    if math.isinf(x):
        return lead + head + sign["infinity"] + tail
    whole, _, part = "".join(core).partition(sign["decimal-separator"])
    times = 100 if sign["percent"] in positive else 1000 if sign["per-mille"] in positive else 1
    value = (abs(Decimal(repr(x))) * times).quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_EVEN)
    i, _, d = f"{value:f}".partition(".")
    while len(d) > part.count(sign["zero-digit"]) and d.endswith("0"):
        d = d[:-1]
    least = whole.count(sign["zero-digit"])
    i = i.lstrip("0").rjust(least, "0")
    if sign["grouping-separator"] in whole:
        n = len(whole) - whole.rfind(sign["grouping-separator"]) - 1
        i = sign["grouping-separator"].join([i[max(0, k - n) : k] for k in range(len(i), 0, -n)][::-1]) if n else i
    shown = "".join(chr(ord(sign["zero-digit"]) + int(c)) if c.isdigit() else c for c in i) + (sign["decimal-separator"] + d if d else "")
    return lead + head + (shown or sign["zero-digit"]) + tail


def preserved(n: Node) -> bool:
    """Whether xml:space says that the white space here stays."""
    return next((a.attribute("xml:space") for a in ancestors(n) if a.attribute("xml:space") is not None), "") == "preserve"


def serialize(top: Node, output: Output) -> str:
    """The fragment as text, by the output settings. Letters that the encoding lacks become character references."""
    if output.method == "text":
        return top.text()
    html, out = output.method == "html", []
    declared_type = [False]

    def doctype(n: Node) -> None:
        public, system = output.other.get("doctype-public"), output.other.get("doctype-system")
        if declared_type[0] or not (system or public and html):
            return
        declared_type[0] = True
        out.append(f"<!DOCTYPE {n.name}" + (f' PUBLIC "{public}"' if public else " SYSTEM") + (f' "{system}"' if system else "") + ">" + ("\n" if output.indent else ""))

    def write(n: Node, known: dict, deep: int) -> None:
        if n.kind in (TEXT, CDATA):
            raw = n.raw or html and n.parent is not None and n.parent.name.lower() in ("script", "style")
            if not html and n.parent is not None and n.parent.name in output.cdata:
                out.append("<![CDATA[" + n.value.replace("]]>", "]]]]><![CDATA[>") + "]]>")
            else:
                out.append(n.value if raw else n.value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif n.kind == COMMENT:
            out.append(f"<!--{n.value}-->")
        elif n.kind == PI:
            out.append(f"<?{n.name} {n.value}{'>' if html else '?>'}" if n.value else f"<?{n.name}{'>' if html else '?>'}")
        elif n.kind == ELEMENT:
            if not deep:
                doctype(n)
            own = dict(known)
            declared = []
            for x in [n, *n.attributes]:
                prefix = x.name.rpartition(":")[0]
                if prefix != "xml" and (x.kind == ELEMENT or prefix) and own.get(prefix, "") != x.ns:
                    own[prefix] = x.ns
                    declared.append((f"xmlns:{prefix}" if prefix else "xmlns", x.ns))
            pairs = [*declared, *[(a.name, a.value) for a in n.attributes]]
            shown = "".join(f' {k}="{escaped(v)}"' for k, v in pairs)
            if not n.children and not (html and n.name.lower() not in VOID):
                out.append(f"<{n.name}{shown}>" if html else f"<{n.name}{shown}/>")
                return
            out.append(f"<{n.name}{shown}>")
            inside(n, own, deep + 1)
            out.append(f"</{n.name}>")
        else:
            inside(n, known, deep)

    def inside(n: Node, known: dict, deep: int) -> None:
        """Children; on lines of their own if indenting is asked for and none of them is text."""
        apart = output.indent and not any(c.kind in (TEXT, CDATA) for c in n.children)
        for i, c in enumerate(n.children):
            if apart and (deep or i):
                out.append("\n" + "  " * deep)
            write(c, known, deep)
        if apart and deep and n.children:
            out.append("\n" + "  " * (deep - 1))

    write(top, {}, 0)
    text = "".join(out)
    encoding = output.other.get("encoding", "UTF-8")
    if encoding.upper() not in ("UTF-8", "UTF-16"):
        try:
            text = text.encode(encoding, "xmlcharrefreplace").decode(encoding)
        except LookupError:
            raise StylesheetError(f"unknown encoding {encoding}") from None
    if output.declaration and not html:
        alone = f' standalone="{output.other["standalone"]}"' if "standalone" in output.other else ""
        text = f'<?xml version="{output.other.get("version", "1.0")}" encoding="{encoding}"{alone}?>' + ("\n" if output.indent else "") + text
    return text


def escaped(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;")


def pretty(xml: str) -> str:
    """Each tag on a line of its own, two blanks a level."""
    deep, out = 0, []
    for line in re.sub(r">\s*<", ">\n<", xml).split("\n"):
        line = line.strip()
        if line.startswith("</"):
            deep -= 1
        out.append("  " * max(deep, 0) + line)
        if re.match(r"<[^/?!][^>]*[^/]>$|<[^/?!]>$", line) and "</" not in line:
            deep += 1
    return "\n".join(x for x in out if x.strip())


def parsed(text: str, html: bool = False) -> Node:
    return build(html_rows(text) if html else xml_rows(text))
