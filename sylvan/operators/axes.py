"""Axis steps as joins over the interval-encoded node table. Every join carries doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.plans.syntax import Step, Test
from sylvan.sources.relational import ATTRIBUTE, CDATA, COMMENT, DOCUMENT, ELEMENT, PI, TEXT, Forest, columns_of

REVERSE = {"ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}
#: Axes that give no node twice, for distinct contexts of one document.
UNIQUE = {"child", "attribute", "self"}


def matches(axis: str, test: Test, namespaces: dict[str, str]) -> Column:
    """The node test as a condition on a candidate. An unknown prefix matches nothing; a name without prefix matches in any namespace."""
    c = F.col
    if test.kind == "node":
        return F.lit(True)
    if test.kind == "text":
        return c("kind").isin(TEXT, CDATA)
    if test.kind == "comment":
        return c("kind") == COMMENT
    if test.kind == "processing-instruction":
        return (c("kind") == PI) if test.local is None else (c("kind") == PI) & (c("name") == test.local)
    out = c("kind") == (ATTRIBUTE if axis == "attribute" else ELEMENT)
    if test.prefix is not None:
        if test.prefix not in namespaces:
            return F.lit(False)
        out &= c("ns") == namespaces[test.prefix]
    return out if test.local == "*" else out & (c("local") == test.local)


def reaches(axis: str) -> tuple[Column, Column]:
    """What a candidate must be by itself, and how it stands to the context (columns c_*)."""
    c = F.col
    plain = c("kind") != ATTRIBUTE
    inside = (c("pre") > c("c_pre")) & (c("pre") <= c("c_last"))
    around = (c("pre") < c("c_pre")) & (c("last") >= c("c_pre"))
    same = c("pre") == c("c_pre")
    return {
        "child": (plain, c("parent") == c("c_pre")),
        "attribute": (c("kind") == ATTRIBUTE, c("parent") == c("c_pre")),
        "parent": (c("kind").isin(ELEMENT, DOCUMENT), c("pre") == c("c_parent")),
        "descendant": (plain, inside),
        "descendant-or-self": (F.lit(True), (inside & plain) | same),
        "ancestor": (plain, around),
        "ancestor-or-self": (F.lit(True), (around & plain) | same),
        "following-sibling": (plain, (c("parent") == c("c_parent")) & (c("sib") > c("c_sib"))),
        "preceding-sibling": (plain, (c("parent") == c("c_parent")) & (c("sib") < c("c_sib"))),
        "following": (plain, c("pre") > c("c_last")),
        "preceding": (plain, c("last") < c("c_pre")),
    }[axis]


def candidates(forest: Forest, s: Step) -> DataFrame:
    """The part of the forest from which the step's test can take nodes."""
    t = s.test
    if t.kind == "name":
        return forest.narrowed((ATTRIBUTE,) if s.axis == "attribute" else (ELEMENT,), None if t.local == "*" else t.local)
    if t.kind != "node":
        return forest.narrowed({"text": (TEXT, CDATA), "comment": (COMMENT,), "processing-instruction": (PI,)}[t.kind], None)
    return forest.nodes


def step(forest: Forest, context: DataFrame, s: Step, namespaces: dict[str, str]) -> DataFrame:
    """``context(iter, node columns)`` -> ``(iter, c_pre, node columns)``: the step's candidates before its predicates."""
    test = matches(s.axis, s.test, namespaces)
    if s.axis == "attribute" and s.test.kind == "name" and s.test.prefix is None and f"@{s.test.local}" in context.columns:
        return brought(context, s.test.local)
    if s.axis == "self":
        return context.where(test).select("iter", F.col("pre").alias("c_pre"), *columns_of(context))
    if s.axis == "namespace":
        return context.where(F.lit(False)).select("iter", F.col("pre").alias("c_pre"), *columns_of(context))
    own, related = reaches(s.axis)
    left = context.select("iter", F.col("doc_id").alias("c_doc"), *[F.col(c).alias(f"c_{c}") for c in ("pre", "last", "parent", "sib")])
    right = candidates(forest, s).where(own & test)
    return left.join(forest.dealt(right), (F.col("doc_id") == F.col("c_doc")) & related).select("iter", "c_pre", *columns_of(right))


def brought(context: DataFrame, name: str) -> DataFrame:
    """The attribute step where elements bring the attribute along: a projection."""
    at, value = F.col(f"@{name}#"), F.col(f"@{name}")
    made = {"doc_id": F.col("doc_id"), "pre": at, "last": at, "parent": F.col("pre"), "level": (F.col("level") + 1).cast("int"), "kind": F.lit(ATTRIBUTE).cast("tinyint"), "sib": F.lit(None).cast("int"), "name": F.lit(name), "local": F.lit(name), "ns": F.lit(""), "value": value, "ts": F.lit(0), "te": F.lit(0)}
    return context.where(at.isNotNull()).select("iter", F.col("pre").alias("c_pre"), *[c.alias(k) for k, c in made.items()])


def from_roots(forest: Forest, s: Step, namespaces: dict[str, str]) -> DataFrame:
    """A child or descendant step from the roots of all documents of a rooted forest, or the attributes of all elements: no join, as every node is below its root."""
    own, _ = reaches(s.axis)
    near = F.col("parent") == 0 if s.axis == "child" else F.col("pre") > 0
    found = candidates(forest, s).where(own & matches(s.axis, s.test, namespaces) & near)
    return found.select(F.col("doc_id").alias("iter"), (F.col("parent") if s.axis == "attribute" else F.lit(0)).alias("c_pre"), *columns_of(found))
