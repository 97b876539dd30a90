"""XML and HTML text to the node table, in Arrow batches; one document is one row, and rows are independent."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.session import written_once
from sylvan.sources.relational import ATTRIBUTE, COLUMNS, COMMENT, DOCUMENT, ELEMENT, NODES, PI, TEXT, Forest

# HTML elements without content, and those whose start ends an open one of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
XML_NS = "http://www.w3.org/XML/1998/namespace"
SPLIT = "\x01"


class Builder:
    """Collects one document's nodes in document order; adjacent texts are one node."""

    def __init__(self) -> None:
        self.rows: list[list] = [[0, 0, None, 0, DOCUMENT, None, None, None, None, None, 0, 0]]
        self.open, self.count, self.text, self.at = [0], [0], [], 0

    def add(self, kind: int, name=None, local=None, ns=None, value=None) -> int:
        self.flush()
        return self.put(kind, name, local, ns, value)

    def put(self, kind, name, local, ns, value) -> int:
        self.count[-1] += 1
        pre = len(self.rows)
        self.rows.append([pre, pre, self.open[-1], len(self.open), kind, self.count[-1], name, local, ns, value, self.at, self.at])
        return pre

    def start(self, name: str, local: str, ns: str, attributes: list[tuple]) -> None:
        pre = self.add(ELEMENT, name, local, ns)
        for a_name, a_local, a_ns, value in attributes:
            at = len(self.rows)
            self.rows.append([at, at, pre, len(self.open) + 1, ATTRIBUTE, None, a_name, a_local, a_ns, value, self.at, self.at])
        self.open.append(pre)
        self.count.append(0)

    def end(self) -> None:
        self.flush()
        row = self.rows[self.open.pop()]
        self.count.pop()
        row[1], row[11] = len(self.rows) - 1, self.at

    def chars(self, data: str) -> None:
        self.text.append(data)

    def flush(self) -> None:
        if self.text:
            data, self.text = "".join(self.text), []
            if len(self.open) > 1 and data:
                pre = self.put(TEXT, None, None, None, data)
                self.at += len(data)
                self.rows[pre][11] = self.at

    def done(self) -> list[list]:
        while len(self.open) > 1:
            self.end()
        self.flush()
        self.rows[0][1], self.rows[0][11] = len(self.rows) - 1, self.at
        return self.rows


def xml_rows(text: str) -> list[list]:
    """Rows of a well-formed document; raises ValueError with the place otherwise. Declarations of entities are refused."""
    b = Builder()
    p = expat.ParserCreate(namespace_separator=SPLIT)
    p.namespace_prefixes = True
    p.ordered_attributes = True
    p.buffer_text = True

    def name(raw: str) -> tuple[str, str, str]:
        parts = raw.split(SPLIT)
        if len(parts) == 1:
            return raw, raw, ""
        ns, local = parts[0], parts[1]
        prefix = parts[2] if len(parts) > 2 else "xml" if ns == XML_NS else ""
        return f"{prefix}:{local}" if prefix else local, local, ns

    def refuse(*_):
        raise ValueError("entity declarations are not allowed")

    p.StartElementHandler = lambda tag, atts: b.start(*name(tag), [(*name(k), v) for k, v in zip(atts[::2], atts[1::2])])
    p.EndElementHandler = lambda _: b.end()
    p.CharacterDataHandler = b.chars
    p.CommentHandler = lambda data: b.add(COMMENT, value=data)
    p.ProcessingInstructionHandler = lambda target, data: b.add(PI, target, target, "", data)
    p.EntityDeclHandler = refuse
    try:
        p.Parse(text, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from None
    return b.done()


class Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.b, self.names = Builder(), []

    def close_to(self, n: int) -> None:
        while len(self.names) > n:
            self.names.pop()
            self.b.end()

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in closes:
                self.close_to(i)
                break
            if self.names[i] in ("ul", "ol", "table", "div", "body", "article", "nav", "footer"):
                break
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        self.b.start(tag, tag, "", [(k, k, "", v) for k, v in seen.items()])
        self.names.append(tag)
        if tag in VOID:
            self.close_to(len(self.names) - 1)

    def handle_endtag(self, tag):
        if tag in self.names:
            self.close_to(len(self.names) - 1 - self.names[::-1].index(tag))

    def handle_data(self, data):
        self.b.chars(data)

    def handle_comment(self, data):
        self.b.add(COMMENT, value=data)

    def handle_pi(self, data):
        target, _, rest = data.partition(" ")
        self.b.add(PI, target, target, "", rest)


def html_rows(text: str) -> list[list]:
    """Rows of any text, by the rules for unclosed elements above."""
    parser = Html()
    parser.feed(text)
    parser.close()
    return parser.b.done()


ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.string() if c in ("name", "local", "ns", "value") else pa.int8() if c == "kind" else pa.int32()) for c in COLUMNS[1:]]])


def shred(source: DataFrame, text: str = "xml", html: bool = False, mode: str = "PERMISSIVE", once: bool = False) -> Forest:
    """``source(doc_id, text column, ...)`` -> nodes and texts. ``once`` writes the node table, so that plans of several steps parse a text once.

    What can't be parsed: FAILFAST raises, DROPMALFORMED drops it, PERMISSIVE keeps a document row alone, whose value is the message. A null text gives no row.
    """

    def rows_of(value: str) -> list[list]:
        try:
            return html_rows(value) if html else xml_rows(value)
        except ValueError as e:
            if mode == "FAILFAST":
                raise
            return [] if mode == "DROPMALFORMED" else [[0, 0, None, 0, DOCUMENT, None, None, None, None, f"error: {e}", 0, 0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [[doc, *r] for r in rows_of(value)]
                if len(out) > 50_000:
                    yield as_batch(out)
                    out = []
            yield as_batch(out)

    def as_batch(rows):
        cols = list(zip(*rows)) or [()] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)

    rows = source.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("xml")).where("xml is not null").mapInArrow(run, NODES)
    rows = written_once(rows, "nodes") if once else rows
    docs = rows.where(F.col("kind") == TEXT).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("text"))
    return Forest(rows, docs.select("doc_id", F.lit(None).cast("string").alias("uri"), "text"), rooted=True, parsed=True)


def page_tree(spark, sf_dir: str) -> Forest:
    """One document per page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("page_id", "doc_id")
    return shred(pages, "html", html=True, once=True)
