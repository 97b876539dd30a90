"""The class a user works with: a stylesheet, its parameters, and transforms of DataFrames of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sylvan.operators.stylesheet import Stylesheet, pretty, serialize
from sylvan.operators.tree import Context, build, evaluate, to_string
from sylvan.plans.lift import evaluate as evaluate_xpath
from sylvan.plans.lift import SCALARS, register_function, select, select_first
from sylvan.plans.publish import Shape, Unsupported, publish, written
from sylvan.plans.syntax import USUAL, Limits, parse
from sylvan.sources.relational import ELEMENT
from sylvan.sources.shred import html_rows, shred, xml_rows

__all__ = ["Limits", "Shape", "Transformer", "Unsupported", "evaluate_xpath", "parse", "per_document", "pretty", "register_function", "register_sql", "select", "select_first", "shred"]
SCHEMA = "doc_id long, xml string, error string, messages array<string>"


class Transformer:
    """Imports a stylesheet once and applies it to every row of a table of documents."""

    def __init__(self, loader: Callable[[str, str | None], str] | None = None, limits: Limits = USUAL):
        self.loader, self.limits, self.text, self.uri = loader, limits, None, None
        self.sheet: Stylesheet | None = None
        self.parameters: dict[str, object] = {}

    def import_stylesheet(self, xml: str, uri: str | None = None) -> Transformer:
        self.sheet = Stylesheet(xml, self.loader, uri, self.limits)
        self.text, self.uri = xml, uri
        return self

    @staticmethod
    def key(ns: str | None, name: str) -> str:
        if not isinstance(name, str) or not name:
            raise TypeError("a parameter has a name")
        return f"{{{ns}}}{name}" if ns else name

    def set_parameter(self, ns: str | None, name: str, value) -> None:
        if value is None or not isinstance(value, (str, bool, int, float)):
            raise TypeError("a parameter is a string, a number or a truth value")
        self.parameters[self.key(ns, name)] = value

    def get_parameter(self, ns: str | None, name: str):
        return self.parameters.get(self.key(ns, name), "")

    def remove_parameter(self, ns: str | None, name: str) -> None:
        self.parameters.pop(self.key(ns, name), None)

    def clear_parameters(self) -> None:
        self.parameters.clear()

    def reset(self) -> None:
        self.sheet, self.text = None, None
        self.parameters.clear()

    def transform(self, docs: DataFrame | Shape, text: str = "xml", mode: str = "fragment", html: bool = False, at: str | None = None, indented: bool = False, tier: str | None = None) -> DataFrame:
        """``docs(doc_id, text column)`` -> ``(doc_id, xml, error, messages)``; works on streams too.

        A document that can't be parsed or transformed, whatever the reason, has a null xml and its message; mode "document" asks for a single root element.
        ``at`` is an expression whose first node is the source instead of the document; ``indented`` puts each tag on a line of its own.

        A ``Shape`` (tables as documents) is transformed by one plan without Python if the stylesheet allows it, else it is written as text first. ``tier``
        "plan" insists on the plan (and raises Unsupported), "document" on the other way.
        """
        if self.sheet is None:
            raise RuntimeError("no stylesheet is imported")
        if mode not in ("fragment", "document"):
            raise ValueError(f"unknown mode {mode}")
        if isinstance(docs, Shape):
            if tier != "document" and mode == "fragment" and not at and not indented:
                try:
                    return publish(docs, self.sheet, self.parameters)
                except Unsupported:
                    if tier == "plan":
                        raise
            docs, text, html = written(docs), "xml", False
        self.sheet.functions = dict(SCALARS)
        sheet, parameters, start = self.sheet, dict(self.parameters), at and parse(at, self.limits)

        def one(value: str | None) -> tuple:
            if value is None:
                return None, "no document", []
            said: list[str] = []
            try:
                top = build(html_rows(value) if html else xml_rows(value))
                if start:
                    found = evaluate(start, Context(top, namespaces=sheet.namespaces))
                    if not isinstance(found, list) or not found:
                        return None, "no node is the source", said
                    top = found[0]
                out, _ = sheet.run(top, parameters, said)
                if mode == "document" and sum(c.kind == ELEMENT for c in out.children) != 1:
                    return None, "the result has not one root element", said
                shown = serialize(out, sheet.output)
                return pretty(shown) if indented else shown, None, said
            except Exception as e:  # whatever a document meets is its own error, never the job's
                return None, str(e) if isinstance(e, ValueError) and str(e) else f"{type(e).__name__}: {e}", said

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                cols = list(zip(*map(one, batch.column(1).to_pylist()))) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string()))], ["doc_id", "xml", "error", "messages"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("xml")).mapInArrow(run, SCHEMA)


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to rows of about ``most`` bytes of text (column 1), one row at least, so that memory follows the slice."""
    for batch in batches:
        size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)))
        a = 0
        while a < batch.num_rows or not batch.num_rows and a == 0:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right"))) if batch.num_rows else 1
            yield batch.slice(a, b - a)
            a = b


def per_document(docs: DataFrame, expr: str, text: str = "xml", html: bool = False, variables: dict | None = None, namespaces: dict | None = None, limits: Limits = USUAL) -> DataFrame:
    """``docs(doc_id, text column)`` -> ``(doc_id, value)``: an expression's string per document, without a node table."""
    tree = parse(expr, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if v is None else to_string(evaluate(tree, Context(build(html_rows(v) if html else xml_rows(v)), variables=variables or {}, namespaces=namespaces or {}, most=limits.nodes))) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("xml")).mapInArrow(run, "doc_id long, value string")


class XPathRows:
    """``xpath_eval(xml, expr)`` in SQL: the nodes of an expression in document order, or its one value."""

    def eval(self, xml: str, expr: str):
        if xml is None or expr is None:
            return
        found = evaluate(parse(expr), Context(build(xml_rows(xml))))
        for i, x in enumerate(found if isinstance(found, list) else [found], 1):
            yield i, x.name if isinstance(found, list) else None, x.text() if isinstance(found, list) else to_string(x)


def register_sql(spark: SparkSession) -> None:
    """Makes ``xpath_eval`` callable as a table function in SQL."""
    spark.udtf.register("xpath_eval", udtf(XPathRows, returnType="ord long, name string, value string", useArrow=True))
