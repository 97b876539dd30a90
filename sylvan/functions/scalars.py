"""XPath conversions, operators and functions as Spark columns.

No SQL null leaves a column built here: a missing string is '', a missing number NaN, a missing truth false. Comparisons guard NaN, which
Spark takes for equal to itself and above all numbers; division and modulo never raise.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NUMBER = r"^[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*$"


def number_of(c: Column, kind: str) -> Column:
    if kind == "number":
        return c
    if kind == "boolean":
        return F.when(c, 1.0).otherwise(0.0)
    return F.when(c.rlike(NUMBER), F.regexp_replace(c, r"[ \t\r\n]+", "").try_cast("double")).otherwise(float("nan"))


def string_of(c: Column, kind: str) -> Column:
    if kind == "string":
        return c
    if kind == "boolean":
        return F.when(c, "true").otherwise("false")
    whole = c.cast("decimal(38,0)").cast("string")
    text = c.cast("string")
    plain = F.when(text.rlike("E"), F.regexp_replace(F.rtrim(F.format_string("%.20f", c)), r"\.?0+$", "")).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return F.when(F.isnan(c), "NaN").when(c == INF, "Infinity").when(c == -INF, "-Infinity").when(c == 0, "0").when((F.abs(c) < 1e21) & (c == F.rint(c)), F.when(F.abs(c) < 1e37, whole)).otherwise(plain)


def boolean_of(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c
    return (c != 0) & ~F.isnan(c) if kind == "number" else F.length(c) > 0


CONVERT = {"number": number_of, "string": string_of, "boolean": boolean_of}


def equal(a: Column, ka: str, b: Column, kb: str) -> Column:
    """= of two scalars: booleans decide, then numbers, then strings."""
    if "boolean" in (ka, kb):
        return boolean_of(a, ka) == boolean_of(b, kb)
    if "number" in (ka, kb):
        return order("=", number_of(a, ka), number_of(b, kb))
    return a == b


def order(op: str, a: Column, b: Column) -> Column:
    told = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[op]
    return ~F.isnan(a) & ~F.isnan(b) & told


def arithmetic(op: str, a: Column, b: Column) -> Column:
    nan = F.lit(float("nan"))
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "div":
        minus = F.startswith(b.cast("string"), F.lit("-"))
        return F.when(b == 0, F.when((a == 0) | F.isnan(a), nan).when((a > 0) != minus, INF).otherwise(-INF)).otherwise(F.try_divide(a, b))
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), nan).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b))


def floor_(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def ceiling(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**53, F.ceil(x).cast("double")).otherwise(x)


def round_(x: Column) -> Column:
    """Halves go up."""
    low = floor_(x)
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(low + F.when(x - low >= 0.5, 1.0).otherwise(0.0))


def position_of(s: Column, d: Column) -> Column:
    return F.position(d, s)


def substring_before(s: Column, d: Column) -> Column:
    at = position_of(s, d)
    return F.when(at == 0, "").otherwise(F.left(s, at - 1))


def substring_after(s: Column, d: Column) -> Column:
    at = position_of(s, d)
    return F.when(at == 0, "").otherwise(F.substring(s, at + F.length(d), F.length(s) + 1))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at places p with round(start) <= p < round(start) + round(length)."""
    size = F.length(s).cast("double")
    first = round_(start)
    stop = size + 1 if length is None else first + round_(length)
    begin, end = F.greatest(first, F.lit(1.0)), F.least(stop, size + 1)
    ok = ~F.isnan(first) & ~F.isnan(stop) & (end > begin)
    return F.when(ok, F.substring(s, begin.cast("int"), (end - begin).cast("int"))).otherwise("")


def normalize_space(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"[ \t\r\n]+", " "), "^ | $", "")


def format_number(x: Column, pattern: str) -> Column:
    """The common part of format-number(): grouping, least and most decimals, least whole digits, percent, a negative sub-pattern's affixes; halves to even."""
    positive, _, negative = pattern.partition(";")
    body = [i for i, c in enumerate(positive) if c in "#0,."]
    head, tail, core = (positive[: body[0]], positive[body[-1] + 1 :], positive[body[0] : body[-1] + 1]) if body else (positive, "", "0")
    whole, _, part = core.partition(".")
    least, most = part.count("0"), len(part)
    digits = max(1, whole.count("0")) if whole.count("0") or not part else 0
    group = len(whole) - whole.rfind(",") - 1 if "," in whole else 0
    scaled = F.abs(x) * (100 if "%" in positive else 1000 if "‰" in positive else 1)
    text = F.bround(scaled.cast("decimal(30,12)"), most).cast(f"decimal(30,{most})").cast("string") if most else F.bround(scaled.cast("decimal(30,12)"), 0).cast("decimal(30,0)").cast("string")
    i, d = F.substring_index(text, ".", 1), F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise("")
    d = F.when(F.length(d) > least, F.concat(F.left(d, F.lit(least)), F.regexp_replace(F.substring(d, F.lit(least + 1), F.length(d)), "0+$", ""))).otherwise(d) if most > least else d
    i = F.when(F.length(i) < digits, F.lpad(i, digits, "0")).otherwise(F.when(i == "0", "").otherwise(i) if not digits else i)
    i = F.regexp_replace(i, rf"(?<=\d)(?=(\d{{{group}}})+$)", ",") if group else i
    shown = F.concat(i, F.when(F.length(d) > 0, F.concat(F.lit("."), d)).otherwise(""))
    minus = [c for c in negative if c not in "#0,."]
    left, right = ("".join(minus[: 1]), "".join(minus[1:])) if negative else ("-" + head, tail)
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == INF, F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(F.when(x < 0, F.concat(F.lit(left), shown, F.lit(right))).otherwise(F.concat(F.lit(head), shown, F.lit(tail))))


@functools.cache
def roman_pairs() -> tuple:
    # Roman numerals by size.
    return ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def number_text(n: int, form: str) -> str:
    """A whole number in the style of xsl:number's formats 1, 01, a, A, i, I."""
    if form in ("a", "A"):
        out = chr(97 + (n - 1) % 26)
        return out if form == "a" else out.upper()
    if form in ("i", "I"):
        out = ""
        for size, sign in roman_pairs():
            out, n = out + sign * (n // size), n % size
        return out.lower() if form == "i" else out
    return str(n).zfill(len(form)) if form.isdigit() else str(n)


def number_column(n: Column, form: str) -> Column:
    """number_text() of a long column."""
    if form in ("a", "A"):
        return F.char((F.pmod(n - 1, F.lit(26)) + (97 if form == "a" else 65)).cast("int"))
    if form in ("i", "I"):
        pairs = F.array(*[F.struct(F.lit(size).cast("long").alias("n"), F.lit(sign).alias("s")) for size, sign in roman_pairs()])
        start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
        done = F.aggregate(pairs, start, lambda acc, p: F.struct((acc["n"] % p["n"]).alias("n"), F.concat(acc["s"], F.repeat(p["s"], F.floor(acc["n"] / p["n"]).cast("int"))).alias("s")))["s"]
        return F.lower(done) if form == "i" else done
    return F.when(F.length(n.cast("string")) < len(form), F.lpad(n.cast("string"), len(form), "0")).otherwise(n.cast("string"))


def js_text(x: float) -> str:
    """A number's text, for the interpreter."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    from decimal import Decimal

    return format(Decimal(repr(x)), "f") if 1e-7 < abs(x) < 1e21 else repr(x).replace("e-0", "e-")
