"""SimHash near-duplicates with a generalised pigeonhole index.

Fingerprint: lower-cased (A-Z) words, 3-word shingles with repeats, XXH64 (seed 42); a bit is 1 if set in over half of the
hashes. Linking (Qin et al., "GPH: Similarity Search in Hamming Space", ICDE 2018): correlated bits are grouped into m
partitions; thresholds T_i with sum T_i = tau - m + 1 are allotted by dynamic programming on estimated candidate counts; two
fingerprints within tau bits agree to within T_i bits on some partition i. T_i = -1 leaves a partition out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import text as tx
from sylvan.llm.components import components
from sylvan.llm.shared import bounded, cut

SHINGLE, TAU, SEED = 3, 3, 42
#: Costs of one index entry and of one candidate check, in the same unit.
ENTRY, CHECK = 1.0, 0.02
BLOCK = 2048
BITS = np.array([[(v >> k) & 1 for k in range(8)] for v in range(256)], np.int64)


def fingerprint(data: bytes) -> int:
    """The fingerprint of one text's bytes; no word gives 0."""
    words = data.translate(bytes(tx.LOWER)).split()
    if not words:
        return 0
    line, f = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return f(line, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: -SHINGLE]]]
    h = np.fromiter([f(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], np.uint64, len(starts))
    bytes8 = h.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(bytes8[:, k], minlength=256) @ BITS
        for b in np.flatnonzero(2 * ones > len(h)):
            out |= 1 << (8 * k + int(b))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long)``; a null text has no words. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.raw(batch.column(1))
            fps = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often bits i and j are both 1, over all distinct fingerprints: a 64 x 64 table, whatever the input's size."""

    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            x = unpack(np.asarray(batch.column(0)).view(np.uint64)).astype(np.float64)
            total += x.T @ x
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], ["i", "j", "n"])

    out = np.zeros((64, 64))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def unpack(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped(both: np.ndarray, n: float, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each takes the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = list(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, out))) // (m - k)
        group = [max(left, key=lambda b: (abs(p[b] - 0.5), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (r[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0..most of these bits, bits taken as independent."""
    d = np.zeros(most + 1)
    d[0] = 1
    for q in 2 * p * (1 - p):
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return np.cumsum(d).tolist()


def plan(both: np.ndarray, n: float, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The cheapest partitions and thresholds for n fingerprints: for each m, a dynamic programme over the sum of thresholds."""
    p, best = np.diag(both) / max(n, 1), None
    for m in range(2, 9):
        groups = grouped(both, n, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            near = within(p[g], tau)
            nxt: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, ts) in table.items():
                for t in range(-1, min(2, tau) + 1):
                    extra = 0.0 if t < 0 else ENTRY * n * comb(len(g), t) + CHECK * n * n / 2 * near[t] * comb(len(g), t) ** 0.5
                    if total + t not in nxt or cost + extra < nxt[total + t][0]:
                        nxt[total + t] = (cost + extra, [*ts, t])
            table = nxt
        if (want := tau - m + 1) in table and (best is None or table[want][0] < best[0]):
            best = (table[want][0], [(g, t) for g, t in zip(groups, table[want][1]) if t >= 0])
    return best[1]


def keys(x: np.ndarray, parts: list[tuple[list[int], int]]) -> Iterator[np.ndarray]:
    """Index keys: for threshold t, a partition's bits with each t of them blanked; within t bits means one key in common."""
    from itertools import combinations

    for i, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        for j, gone in enumerate(combinations(bits, t)):
            keep = np.uint64(mask & ~sum(1 << b for b in gone))
            yield tx.mix((x & keep) ^ tx.mix(np.full(1, 4099 * i + j + 1, np.uint64)))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each vertex's smallest reachable vertex, for links a-b on 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            return label
        label = new


def bucket_links(key: np.ndarray, x: np.ndarray, tau: int) -> np.ndarray:
    """For rows sorted by key, the root of each row among rows of its key linked within tau bits: a forest, not all pairs."""
    n = len(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    pa_, pb_ = [], []
    small = np.repeat(size <= BLOCK, size)
    d = 1
    rows = np.flatnonzero(np.repeat(size > 1, size) & small)
    last = np.repeat(first + size, size)
    while len(rows := rows[rows + d < last[rows]]):
        near = rows[np.bitwise_count(x[rows] ^ x[rows + d]) <= tau]
        pa_.append(near)
        pb_.append(near + d)
        d += 1
    root = forest(np.concatenate(pa_), np.concatenate(pb_), n) if pa_ else np.arange(n)
    for s, k in zip(first[size > BLOCK].tolist(), size[size > BLOCK].tolist()):
        local = np.arange(k)
        for i in range(0, k, BLOCK):
            for j in range(i, k, BLOCK):
                if j > i and (local[i : i + BLOCK] == local[i]).all() and (local[j : j + BLOCK] == local[i]).all():
                    continue  # one component already: no pair in here joins anything
                a, b = np.nonzero(np.bitwise_count(x[s + i : s + min(i + BLOCK, k), None] ^ x[None, s + j : s + min(j + BLOCK, k)]) <= tau)
                a, b = a + i, b + j
                if (diff := local[a] != local[b]).any():
                    local = local[forest(local[a[diff]], local[b[diff]], k)[local]]
                    local = forest(np.arange(k), local, k)
        root[s : s + k] = s + local
    return root


def linked(groups: DataFrame, parts: list[tuple[list[int], int]], tau: int = TAU) -> DataFrame:
    """``groups(fp, rep)``, fp distinct -> links ``(a, b)`` between reps that keep every component whole."""

    def spread(batches):
        for batch in batches:
            x, rep = np.asarray(batch.column(0)).view(np.uint64), batch.column(1)
            for k in keys(x, parts):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column(0), rep], ["key", "fp", "rep"])

    def join(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns)]
            stop = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            held = [c[stop:] for c in now]
            if stop:
                yield out([c[:stop] for c in now])
        if len(held[0]):
            yield out(held)

    def out(cols):
        root = bucket_links(cols[0], cols[1].view(np.uint64), tau)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(cols[2][own]), pa.array(cols[2][root[own]])], ["a", "b"])

    spreaded = groups.select("fp", "rep").mapInArrow(spread, "key long, fp long, rep long")
    return spreaded.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id, kept)``, one row per input row.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows give repeated rows. Rows with a null
    doc_id come back with a null component. An empty table gives an empty one.
    """
    fps = cut(fingerprints(docs), "fingerprints")
    groups = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-groups")
    n = groups.count()
    out = fps
    if n > 1:
        parts = plan(bit_counts(groups), n, tau)
        comp = components(linked(groups, parts, tau))
        groups = groups.join(comp, groups.rep == comp.vertex, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    else:
        groups = groups.withColumnRenamed("rep", "component_id")
    out = out.join(groups, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def representatives(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the rows of docs that stay, one of each component: that with the smallest doc_id.

    Rows without a doc_id stand in no component and all stay. Of rows that share the smallest doc_id one stays, the one with the smallest hash of
    its text and then of all its columns' texts. Other columns, of any names, come back as they were.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    found = near_duplicates(docs, tau).where("doc_id is not null")
    ids = cut(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("stays"), F.collect_set(F.when(F.col("kept"), F.col("fingerprint"))).alias("fps")).where("stays"), "representatives")
    once = rows.join(ids.where("n = 1").select("doc_id"), F.col("id") == F.col("doc_id"), "left_semi").select("row")
    out = rows.where("id is null").select("row").unionByName(once)
    if not (several := ids.where("n > 1")).isEmpty():
        again = rows.join(several.select("doc_id", "fps"), F.col("id") == F.col("doc_id")).select("id", "row", "fps")
        told = fingerprinted(again)
        order = F.struct(F.xxhash64("row.text"), F.xxhash64(F.to_json("row")))
        out = out.unionByName(told.where(F.array_contains("fps", F.col("fingerprint"))).groupBy("id").agg(F.min_by("row", order).alias("row")).select("row"))
    return out.select("row.*")


def fingerprinted(rows: DataFrame) -> DataFrame:
    """``rows(id, row, fps)`` with the ``fingerprint`` of ``row.text``."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.raw(batch.column(0))
            told = [f"{fingerprint(data[a:b].tobytes()):016x}" for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(told, pa.string())], names=[*batch.schema.names[1:], "fingerprint"])

    return rows.select(F.col("row.text").cast("string").alias("text"), *rows.columns).mapInArrow(run, StructType([*rows.schema.fields, StructField("fingerprint", StringType())]))
