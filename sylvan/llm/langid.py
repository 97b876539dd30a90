"""Language identification with hyperdimensional profiles.

Every letter has a fixed random +-1 vector. A letter trigram abc is bound as rho(rho(a)) * rho(b) * c, rho a rotation by one; a
document bundles (adds) its trigrams' vectors. A language's prototype bundles its training documents, each scaled by the norm of its trigram
counts; as binding depends on the trigram alone, tasks sum the trigrams' weights and bind each trigram once. A document takes the language of the
closest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import text as tx
from sylvan.llm.shared import bounded, crc_mod

DIM = 4096
#: Texts bundled at once, and trigrams bound at once: memory is these times DIM.
ROWS, BOUND = 512, 2048
#: Entries of a table of texts by trigrams, and trigrams of a language that a task sums before it binds them.
TABLE, KEYS = 8_000_000, 300_000
#: Documents' weights are whole numbers of this scale, so that sums do not depend on their order.
SCALE = 1 << 24
UNKNOWN = "und"


@cache
def alpha() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def letter(code: int) -> np.ndarray:
    """The letter's +-1 vector, drawn from its code point alone."""
    x = tx.mix(np.arange(DIM // 64, dtype=np.uint64) + np.array([code * 1_000_003 + 17], np.uint64) * tx.A)
    return (np.unpackbits(x.view(np.uint8)).astype(np.int8) * 2 - 1)[:DIM]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whether each has a letter, the trigrams' letters as one number, where each text's begin (one entry more), and the letters. Words are parted by one blank, which is a letter here."""
    codes = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    code = np.concatenate(codes)
    is_letter = alpha()[code]
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    has = np.bincount(doc[is_letter], minlength=len(texts)) > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] | (doc[1:] != doc[:-1])
    keep[0] = True
    code, doc = np.where(is_letter, code, 32)[keep], doc[keep]
    known = np.zeros(0x110000, bool)
    known[code] = True
    letters = np.flatnonzero(known)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    code, k = number[code], len(letters)
    gram = (code[:-2] * k + code[1:-1]) * k + code[2:]
    inside = doc[2:] == doc[:-2]
    return has, gram[inside], np.searchsorted(doc[:-2][inside], np.arange(len(texts) + 1)), letters


def numbered(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of k letters, and the number of each trigram among them."""
    if k**3 > 4_000_000:
        return np.unique(gram, return_inverse=True)
    used = np.zeros(k**3, bool)
    used[gram] = True
    ids = np.flatnonzero(used)
    where = np.zeros(k**3, np.int64)
    where[ids] = np.arange(len(ids))
    return ids, where[gram]


def bind(ids: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The +-1 vectors of trigrams."""
    k = len(letters)
    third, second, first = ids % k, ids // k % k, ids // (k * k)
    vectors = np.stack([letter(int(c)) for c in letters])
    out = np.roll(vectors, 2, 1)[first]
    out *= np.roll(vectors, 1, 1)[second]
    out *= vectors[third]
    return out


@cache
def held() -> np.ndarray:
    """A worker's room for bound vectors."""
    return np.zeros((BOUND, DIM), np.float32)


def counted(gram: np.ndarray, edge: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose trigrams begin at ``edge``: the distinct trigrams, each trigram's number among them, and its text."""
    ids, g = numbered(gram[edge[0] : edge[-1]], k)
    return ids, g, np.repeat(np.arange(len(edge) - 1), np.diff(edge))


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One bundle per text, whether the text has a letter, and its number of distinct trigrams."""
    has, gram, edge, letters = trigrams(texts)
    out, distinct = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    ids, g, doc = counted(gram, edge, len(letters))
    for i in range(0, len(ids), BOUND):  # so many trigrams at a time, whatever the alphabet
        part = ids[i : i + BOUND]
        own = np.flatnonzero((g >= i) & (g < i + len(part))) if len(ids) > BOUND else slice(None)
        counts = np.bincount(doc[own] * len(part) + g[own] - i, minlength=len(texts) * len(part)).reshape(len(texts), -1)
        distinct += np.count_nonzero(counts, axis=1)
        bound = held()[: len(part)]
        np.copyto(bound, bind(part, letters))
        out += counts.astype(np.float32) @ bound
    return out, has, distinct


class Profiles:
    """Sums of languages' unit trigram profiles, as sums by trigram; they go into the prototype when there are many."""

    def __init__(self) -> None:
        self.grams: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.bundled: dict[str, np.ndarray] = {}

    def add(self, texts: list[str | None], langs: np.ndarray) -> None:
        has, gram, edge, letters = trigrams(texts)
        k = len(letters)
        ids, g, doc = counted(gram, edge, k)
        at = np.bincount(doc * len(ids) + g, minlength=len(texts) * len(ids)).reshape(len(texts), -1) if len(ids) * len(texts) <= TABLE else None
        if at is None:  # an alphabet of many letters: pairs that stand there only
            pair, n = np.unique(doc * len(ids) + g, return_counts=True)
            d, g = pair // len(ids), pair % len(ids)
        else:
            d, g = np.nonzero(at)
            n = at[d, g]
        norm = np.sqrt(np.bincount(d, n.astype(np.float64) ** 2, minlength=len(texts)))
        weight = np.rint(SCALE * n / norm[d]).astype(np.int64)
        code = (letters[ids // (k * k)] << 42) | (letters[ids // k % k] << 21) | letters[ids % k]
        for lang in set(langs.tolist()):
            own = np.flatnonzero(((langs == lang) & has)[d])
            total = np.bincount(g[own], weight[own], minlength=len(ids))  # whole numbers, far below 2**53
            some = np.flatnonzero(total)
            keys, sums = self.grams.get(lang, (code[:0], total[:0]))
            keys, back = np.unique(np.r_[keys, code[some]], return_inverse=True)
            self.grams[lang] = keys, np.bincount(back, np.r_[sums, total[some]], minlength=len(keys))
            if len(keys) > KEYS:
                self.bundle(lang)

    def bundle(self, lang: str) -> None:
        keys, sums = self.grams.pop(lang)
        letters, number = np.unique(np.r_[keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], return_inverse=True)
        first, second, third = number.reshape(3, -1)
        ids, out = (first * len(letters) + second) * len(letters) + third, self.bundled.get(lang, np.zeros(DIM))
        for i in range(0, len(ids), BOUND):
            out = out + sums[i : i + BOUND] @ bind(ids[i : i + BOUND], letters)
        self.bundled[lang] = out

    def prototypes(self) -> dict[str, np.ndarray]:
        for lang in list(self.grams):
            self.bundle(lang)
        return self.bundled


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x.astype(np.float64), axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros(x.shape), where=norm > 0)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    data, at = tx.raw(column)
    for first, end in tx.slices(data, at, 1 << 20):
        for a in range(first, end, ROWS):
            b = min(a + ROWS, end)
            yield a, b, column.slice(a, b - a).to_pylist()


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """``labelled(text, lang)`` -> prototypes. Null languages and texts without letters teach nothing. The sums have one row per language and dimension, whatever the input's size."""

    def run(batches):
        profiles = Profiles()
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for a, b, texts in blocks(batch.column(0)):
                profiles.add(texts, lang[a:b])
        for name, v in profiles.prototypes().items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM)), pa.array(v.astype(np.int64))], ["lang", "dim", "v"])

    rows = bounded(labelled).where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, dim long, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(DIM))[r.dim] = r.v
    return {k: out[k] for k in sorted(out) if out[k].any()}


def predict(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], nested: bool = False) -> DataFrame:
    """Columns ``keep`` of docs (``nested``: the first of them, a struct, has the text) with ``lang_pred``, ``score``, the cosine cut to 0..1, and ``n_grams``, the text's distinct trigrams.

    ``und`` with score 0 where text is null, has no letter, or there is no prototype. Equal cosines: the first language by name.
    """
    names, prototypes = list(model), unit(np.stack(list(model.values()))) if model else np.zeros((0, DIM))
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            pred, score, n_grams = [], [], []
            column = batch.column(0).field("text") if nested else batch.column(0)
            for _, _, texts in blocks(column):
                x, has, distinct = bundles(texts)
                n_grams += distinct.tolist()
                if names:
                    cos = np.round(np.concatenate([unit(x[i : i + 64]) @ prototypes.T for i in range(0, len(x), 64)]), 9)
                    best = cos.argmax(1)
                    pred += [names[i] if h else UNKNOWN for i, h in zip(best, has)]
                    score += np.where(has, np.clip(cos.max(1), 0, 1), 0).tolist()
                else:
                    pred += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[not nested :], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n_grams, pa.int64())], names=[*batch.schema.names[not nested :], "lang_pred", "score", "n_grams"])

    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    return bounded(docs).select(*([] if nested else [F.col("text").alias("__text")]), *keep).mapInArrow(run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_grams", LongType())]))


def identify(docs: DataFrame, holdout: int = 5) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``(doc_id, held_out, lang_pred, score)``: learns from documents whose crc32(doc_id) mod ``holdout`` is not 0.

    One row per input row; repeated rows repeat. An empty table gives an empty one. Other columns are not read.
    """
    held = (crc_mod("doc_id", holdout) == 0).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(rows, train(rows.where("not held_out")), ["doc_id", "held_out"]).drop("n_grams")
