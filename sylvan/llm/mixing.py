"""Mixing sources to target weights by soft domain membership, in DataFrame functions alone.

A classifier fitted on a bounded sample of the labels table predicts for every document the posteriors of three domains: clean, low (quality
0) and toxic. Rates r_d >= 0 are then fitted by regularised least squares:

    min_r  1/2 sum_k ((sum_d r_d n_d p_dk - t_k) / T)^2 + ridge/2 sum_d n_d/T (r_d - 1)^2

n_d: tokens, p_dk: posteriors, t_k: target tokens. With rows weighted by n_d/T the gradient of r_d is sum_k p_dk s_k + ridge (r_d - 1), s_k the residual of
domain k, so a projected-gradient step needs three numbers and its outcome one aggregate with one row. The ridge only chooses among rates that meet the targets.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.shared import cut

DOMAINS = ("clean", "low", "toxic")
TARGET = {"clean": 0.90, "low": 0.07, "toxic": 0.03}
#: Labelled documents to fit on at most, marker words a domain, documents that a marker stands in at least.
SAMPLE, MARKERS, SUPPORT = 20_000, 64, 5
#: Totals within CLOSE of their target shares count as met; a projected gradient under FLAT counts as none; steps whose rates are worked out in one go.
RIDGE, CLOSE, FLAT, STEPS, TOGETHER = 1e-8, 1e-4, 1e-6, 2000, 24
SPACES = r"[\x20\x09-\x0D]+"
FEATURES = ("log_words", "distinct", "letters", "word_length", "lines")


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACES), lambda w: w != "")


def domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def sample(labels: DataFrame) -> DataFrame:
    """At most SAMPLE labelled ids with their domain: those with the smallest hash. Null ids and labels teach nothing; the largest label of a repeated id counts."""
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumn("domain", domain())
    return rows.where("domain is not null").select("l_id", "domain").orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE)


def markers(docs: DataFrame, known: DataFrame) -> dict[str, list[str]]:
    """Words that speak most for each domain but clean, by the smoothed log odds of documents that hold them."""
    text = docs.join(F.broadcast(known), docs.doc_id == known.l_id).select("domain", F.array_distinct(words()).alias("ws"))
    size = {r[0]: r[1] for r in text.groupBy("domain").count().collect()}
    total = sum(size.values())
    seen = cut(text.select("domain", F.explode("ws").alias("w")).groupBy("w").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS], F.count("*").alias("n")).where(F.col("n") >= SUPPORT), "markers")
    out = {}
    for d in DOMAINS[1:]:
        own, other = size.get(d, 0), total - size.get(d, 0)
        odds = F.log((F.col(d) + 0.5) / (own + 1.0)) - F.log((F.col("n") - F.col(d) + 0.5) / (other + 1.0))
        best = seen.where(F.col(d) >= SUPPORT).select("w", odds.alias("odds")).where("odds > 1").orderBy(F.desc("odds"), "w").limit(MARKERS)
        out[d] = [r.w for r in best.collect()] if own and other else []
    return out


def holds(marks: list[str]) -> Column:
    return F.exists("ws", lambda w: w.isin(marks)) if marks else F.lit(False)


def features(docs: DataFrame, marked: dict[str, list[str]]) -> DataFrame:
    """``(doc_id, n_tokens, features, one 0/1 column per list of markers)``, from whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("ws"), F.length(text).alias("chars"), F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("alpha"), F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("d_lines"))
    n = F.size("ws")
    has = [holds(m) for m in marked.values()]
    return rows.select(
        "doc_id", n.cast("long").alias("n_tokens"), F.log1p(n).alias("log_words"), (F.size(F.array_distinct("ws")) / F.greatest(n, F.lit(1))).alias("distinct"), (F.col("alpha") / F.greatest("chars", F.lit(1))).alias("letters"),
        (F.col("chars") / F.greatest(n, F.lit(1))).alias("word_length"), (F.col("d_lines") / F.col("n_lines")).alias("lines"), *[h.cast("int").alias(f"has_{d}") for d, h in zip(marked, has)],
    )


def posteriors(table: DataFrame, known: DataFrame) -> list[Column]:
    """Naive Bayes: Gaussian on the features, Bernoulli on the markers; uniform if nothing is labelled."""
    flags = [c for c in table.columns if c.startswith("has_")]
    stats = table.join(F.broadcast(known), table.doc_id == known.l_id).groupBy("domain").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*FEATURES, *flags)], *[F.var_pop(c).alias(f"v_{c}") for c in FEATURES]).collect()
    found = {r.domain: r for r in stats}
    total = sum(r.n for r in stats)
    if not total:
        return [F.lit(1 / len(DOMAINS)) for _ in DOMAINS]
    logs = []
    for d in DOMAINS:
        if d not in found:
            logs.append(F.lit(-1e3))
            continue
        r = found[d].asDict()
        s = F.lit(math.log(r["n"] / total))
        for c in FEATURES:
            v = r[f"v_{c}"] + 1e-4
            s = s - (F.col(c) - r[c]) ** 2 / (2 * v) - 0.5 * math.log(v)
        for c in flags:
            p = (r[c] * r["n"] + 0.5) / (r["n"] + 1)
            s = s + F.when(F.col(c) == 1, math.log(p)).otherwise(math.log(1 - p))
        logs.append(s)
    top = F.greatest(*logs)
    parts = [F.exp(F.greatest(x - top, F.lit(-700.0))) for x in logs]
    return [x / sum(parts[1:], parts[0]) for x in parts]


def stepped(r: Column, s: np.ndarray, a: float, ridge: float) -> Column:
    """The rate after a step of length a down the gradient, projected on what isn't negative."""
    pull = sum((F.col(f"p_{d}") * float(a * v) for d, v in zip(DOMAINS, s)), F.lit(0.0))
    return F.greatest(F.lit(0.0), r * (1 - a * ridge) - pull + a * ridge)


def fitted(table: DataFrame, target: dict[str, float], ridge: float = RIDGE, flat: float = FLAT) -> tuple[DataFrame, dict[str, float]]:
    """``table(n_tokens, p_clean, p_low, p_toxic, ...)`` with the ``rate`` by which the expected token totals meet the target shares, and the shares they reach.

    Spectral projected gradient (Birgin, Martinez, Raydan, 2000): one aggregate with one row a step, until no rate's projected gradient is over ``flat``. Raises if it
    is after STEPS steps; warns if rates that meet the targets don't exist. Where there are no tokens all rates are 1.
    """
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return table.withColumn("rate", F.lit(1.0)), {}
    share, p, r = np.array([target[d] for d in DOMAINS]), [F.col(f"p_{d}") for d in DOMAINS], F.col("rate")
    weight = F.col("n_tokens") / F.lit(float(total))
    now, length, past, steps = table.withColumn("rate", F.lit(1.0)), 1.0, [], 0
    start = now.agg(*[F.sum(weight * x) for x in p]).first()
    s = np.array(start) - share
    past.append(s @ s / 2)
    for done in range(1, STEPS + 1):
        moved = now.withColumn("next", stepped(r, s, length, ridge))
        d = F.col("next") - r
        row = moved.agg(F.max(F.abs(r - stepped(r, s, 1.0, ridge))), F.sum(weight * d * d), F.sum(weight * (F.col("next") - 1) * (F.col("next") - 1)), *[F.sum(weight * F.col("next") * x) for x in p]).first()
        if row[0] < flat:
            reached = dict(zip(DOMAINS, (s + share).tolist()))
            if np.abs(s).max() >= CLOSE:
                logging.getLogger(__name__).warning("targets not met; shares of tokens: %s", reached)
            return now, reached
        after = np.array(row[3:]) - share
        value = after @ after / 2 + ridge / 2 * row[2]
        if value > max(past[-8:]) - 1e-4 / length * row[1] + 1e-18:
            length /= 2
            continue
        curve = (after - s) @ (after - s) + ridge * row[1]
        now, s = moved.withColumn("rate", F.col("next")).drop("next"), after
        past.append(value)
        length = min(1e6, max(1e-6, row[1] / curve)) if curve > 0 else 1.0
        steps += 1
        if steps % TOGETHER == 0:
            now = cut(now, "rates")
    raise ValueError(f"the rates' fit did not converge: projected gradient {row[0]} after {done} steps")


def fit_rates(table: DataFrame, target: dict[str, float], ridge: float = RIDGE) -> DataFrame:
    return fitted(table, target, ridge)[0]


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, toxic)`` -> ``(doc_id, n_tokens, p_clean, p_low, p_toxic, rate)``, one row per input row.

    A null or empty text has no tokens and bears on no total; its rate follows its posteriors. Repeated rows count as often as they stand there. With
    no label the posteriors are uniform. An empty table gives an empty one. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = cut(sample(labels), "labelled")
    table = cut(features(docs, markers(docs, known)), "features")
    p = [F.round(x, 9).alias(f"p_{d}") for x, d in zip(posteriors(table, known), DOMAINS)]
    table = cut(table.select("doc_id", "n_tokens", *p), "posteriors")
    return fit_rates(table, target).withColumn("rate", F.round("rate", 6))


def dealt(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET) -> DataFrame:
    """Documents as often as their rate says: floor(rate), and once more with the chance of the rest, drawn from the id's hash. Rows without an id stay once."""
    rates = mix(docs, labels, target).groupBy("doc_id").agg(F.max("rate").alias("rate")).withColumnRenamed("doc_id", "id")
    draw = F.pmod(F.xxhash64("row.doc_id"), F.lit(1_000_000)) / 1_000_000
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(rates, F.col("row.doc_id").cast("long") == F.col("id"), "left")
    copies = F.coalesce(F.floor(F.col("rate") + draw), F.lit(1)).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("row.*")
