"""License notices: exact phrases, and a fuzzy search for short notices.

Fuzzy: a notice that may hold k errors is split into k + 1 pieces, one of which must stand exactly in any match (pigeonhole). The
pieces are searched as exact seeds in the text's words; around each hit the regex library's bounded-error matching verifies the
whole notice and reports its span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import text as tx
from sylvan.llm.shared import bounded

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of the fuzzy search: words, label, errors allowed (letters inserted, deleted or replaced).
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("apache license version 2 0", "apache", 2),
    ("licensed under cc by", "cc-by", 1),
    ("creative commons attribution", "cc-by", 3),
    ("licensed under the mit license", "mit", 2),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge", "mit", 4),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under the bsd license", "bsd", 2),
    ("boost software license", "bsl", 2),
    ("gnu free documentation license", "gfdl", 3),
    ("all rights reserved", "all-rights-reserved", 2),
)
#: Windows whose outcome a worker keeps at most.
KNOWN = 100_000

KEPT = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


@cache
def compiled(notices: tuple) -> list[tuple]:
    """For each notice its label, length, errors, seeds with their offsets, pattern, and what windows of text gave."""
    import regex

    out = []
    for words, label, errors in notices:
        phrase = words.encode()
        edges = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
        pieces = [(a, phrase[a:b]) for a, b in zip(edges, edges[1:])]
        out.append((label, len(phrase), errors, pieces, regex.compile(b"(?b)(?<= )(?:" + regex.escape(phrase, special_only=True) + b"){e<=%d}(?= )" % errors), {}))
    return out


def places(line: bytes, needle: bytes) -> list[int]:
    """Where needle stands in line, overlaps included."""
    out, at = [], line.find(needle)
    while at >= 0:
        out.append(at)
        at = line.find(needle, at + 1)
    return out


def fuzzy(line: bytes, blank: np.ndarray, notices: tuple) -> list[tuple[str, int, int, int, float]]:
    """Matches in blank-joined words with a blank at both ends, whose places are given: label, first word, words, errors, similarity. Windows of equal bytes are verified once."""
    found: dict[tuple, tuple] = {}
    for label, size, errors, pieces, pattern, known in compiled(notices):
        if not (seen := [at - offset for offset, seed in pieces for at in places(line, seed)]):
            continue
        starts, hits = np.unique(seen), []
        for begin, end in zip(np.maximum(0, starts - errors - 1).tolist(), (starts + size + errors + 1).tolist()):
            window = line[begin:end]
            if window not in known:
                if len(known) >= KNOWN:
                    known.clear()
                m = pattern.search(window)
                known[window] = m and (m.start(), m.group().count(b" ") + 1, sum(m.fuzzy_counts))
            if (hit := known[window]) is not None:
                hits.append((begin + hit[0], hit[1], hit[2]))
        words = np.searchsorted(blank, [h[0] for h in hits]) - 1
        for first, (_, n, wrong) in zip(words.tolist(), hits):
            if (label, first) not in found or found[label, first][3] > wrong:
                found[label, first] = (label, first, n, wrong, 1 - wrong / size)
    return sorted(found.values(), key=lambda x: (x[1], x[0]))


def scan(data: bytes, notices: tuple = NOTICES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, matches of one text's bytes."""
    words = data.translate(KEPT).split()
    line = b" " + b" ".join(words) + b" "
    blank = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20) if words else np.zeros(0, np.int64)
    hits, labels = [], set()
    for phrase, label in BASE.items():
        if at := places(line, b" " + phrase.encode() + b" "):
            hits += np.searchsorted(blank, at).tolist()
            labels.add(label)
    near = fuzzy(line, blank, notices)
    score = 1.0 if hits else max((m[4] for m in near), default=0.0)
    every = labels | {m[0] for m in near}
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, [dict(zip(("label", "first_word", "n_words", "errors", "similarity"), m)) for m in near]


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, first_word: long, n_words: long, errors: long, similarity: double>>"


def scan_licenses(docs: DataFrame, keep: list[str], notices: tuple = NOTICES) -> DataFrame:
    """Columns ``keep`` of docs with word count, base hits, labels, score and the fuzzy matches' spans; ``notices`` are (words, label, errors allowed).

    Null and empty texts have no words and no labels, score 0. One row per input row, so repeated rows repeat; an empty table gives an empty one. Of
    matches of a label that begin at one word the one with the fewest errors counts. Other columns are not read.
    """
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(SCAN).names
    match = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int64()), ("similarity", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), match]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.raw(batch.column(0))
            cols = list(zip(*(scan(data[a:b].tobytes(), notices) for a, b in zip(at[:-1], at[1:])))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*batch.schema.names[1:], *names])

    schema = StructType([*[docs.schema[c] for c in keep], *StructType.fromDDL(SCAN).fields])
    return bounded(docs).select(F.col("text").cast("string").alias("__text"), *keep).mapInArrow(run, schema)
