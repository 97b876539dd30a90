"""An n-gram language model in an Elias-Fano trie.

Levels (Pibiri, Venturini, "Efficient Data Structures for Massive N-Gram Datasets", SIGIR 2017): level 1 is the vocabulary in hash order; on
level k the successors of each context follow one another, their starts are monotone pointers, and a successor is kept as its rank
among the successors of the context without its first word. Both sequences are Elias-Fano coded; discounted probabilities and back-off
weights are quantised to 16 bits on one fixed scale. Each level is written by Spark tasks as shard files in the shared folder and memory-mapped
by the workers that score.

Smoothing: absolute discounting, interpolated: P(w|h) = max(c(hw) - D, 0)/c(h) + L(h) P(w|h'), down to P(w) = (c+1)/(N+V+1). Every n-gram that
training saw is kept, those that end a text too.

Texts are hashed once; the ids of their words go to a table from which all levels are counted and scores are made. Counts travel as one packed
row per task and shard. A shard takes contexts of about ``MASS`` tokens; the successors of a context with more are split over shards of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from sylvan.llm import text as tx
from sylvan.llm.eliasfano import EliasFano
from sylvan.llm.files import get, put
from sylvan.llm.shared import bounded, crc_mod, cut, fresh_path

ORDER, DISCOUNT = 3, 0.75
#: The token at a text's end, also the context at its start; a hash no word is likely to have.
END = np.uint64(0xE0F0E0F0E0F0E0F1)
#: Distinct n-grams that a task sums up before it passes them on; tokens that follow the contexts of a shard, about; bytes of text for a shard of the vocabulary.
HELD, MASS, BYTES = 1_200_000, 2_000_000, 48 << 20
#: Bytes of text, and of word ids, worked on at once.
TEXTS, IDS = 2 << 20, 1 << 20
#: Probabilities are kept as so many steps a factor of two: the relative error is under 2**(1/2048) - 1, or 0.034 %.
STEPS = 1024
_models: dict[str, Model] = {}


# probabilities and counts


def code(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-STEPS * np.log2(p)), 65535).astype(np.uint16)


VALUES = np.exp2(-np.arange(65536) / STEPS)


def value(codes: np.ndarray) -> np.ndarray:
    """What codes stand for; unquantised values are floats."""
    return VALUES[codes] if codes.dtype == np.uint16 else codes


def small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and those that don't fit with their places."""
    large = np.flatnonzero(counts > 255)
    return [np.minimum(counts, 255).astype(np.uint8), large, counts[large].astype(np.int64)]


def slice_of(parts: list[np.ndarray], low: int, high: int) -> np.ndarray:
    out = parts[0][low:high].astype(np.int64)
    a, b = np.searchsorted(parts[1], (low, high))
    out[parts[1][a:b] - low] = parts[2][a:b]
    return out


def at_places(parts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = parts[0][at].astype(np.int64)
    if len(parts[1]) and (over := np.flatnonzero(out == 255)).size:
        i = np.minimum(np.searchsorted(parts[1], at[over]), len(parts[1]) - 1)
        out[over] = np.where(parts[1][i] == at[over], parts[2][i], 255)
    return out


# counting


def planes(x: np.ndarray) -> bytes:
    """Non-negative integers as their lowest bytes, then the next ones, as many as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(blob: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    width = blob[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob[1 : 1 + n * width], np.uint8).reshape(width, n).T
    return out.view("<u8").ravel(), blob[1 + n * width :]


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and their counts."""
    return len(keys).to_bytes(8, "little") + planes(np.diff(keys, prepend=keys.dtype.type(0))) + planes(counts)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    steps, rest = from_planes(memoryview(blob)[8:], n)
    counts, _ = from_planes(rest, n)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray] | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys of one or two columns in order, and their counts (None: one each)."""
    n = len(keys[0])
    if not n:
        return keys, np.zeros(0, np.int64)
    span = int(keys[1].max()) + 1 if len(keys) == 2 else 1
    if len(keys) == 2 and (int(keys[0].max()) + 1) * span < 1 << 63:
        one = keys[0] * span + keys[1]
    else:
        one = keys[0] if len(keys) == 1 else None
    if one is not None and counts is None:
        one = np.sort(one)
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        got, total = one[first], np.diff(np.r_[first, n])
    elif one is not None:
        order = np.argsort(one)
        one = one[order]
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        got, total = one[first], np.add.reduceat(np.concatenate(counts)[order], first)
    else:
        order = np.lexsort((keys[1], keys[0]))
        a, b = keys[0][order], keys[1][order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return [a[first], b[first]], np.add.reduceat(np.ones(n, np.int64) if counts is None else np.concatenate(counts)[order], first)
    return [got] if len(keys) == 1 else [got // span, got % span], total


class Sums:
    """Counts by key, summed in a task and passed on, packed by shard, when there are many; place(*keys) gives each key's shard and its key in the shard."""

    def __init__(self, place) -> None:
        self.place, self.parts, self.size = place, [], 0

    def add(self, *keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys[0]):
            self.parts.append(summed(list(keys), None))
            self.size += len(self.parts[-1][1])
        if self.size > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = summed([np.concatenate(c) for c in zip(*[k for k, _ in self.parts])], [n for _, n in self.parts])
            shard, key = self.place(*keys)
            if (shard[1:] < shard[:-1]).any():
                order = np.argsort(shard, kind="stable")
                shard, key, counts = shard[order], key[order], counts[order]
            edge = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            blobs = [packed(key[a:b], counts[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "counts"])
        self.parts, self.size = [], 0


def shards_of(counted: DataFrame, n: int, build) -> list[tuple]:
    """``(shard int, counts binary)`` -> what build(shard, keys, counts) tells of each shard, as ``(shard, n, widest, starts, split, mass)``, in order of shards.

    A task handles one shard at a time. What comes back has a few numbers a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            keys, counts = summed([np.concatenate([k for k, _ in held])], [c for _, c in held])
            told = build(now, keys[0], counts)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, len(counts), *told), (pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3))], ["shard", "n", "widest", "starts", "split", "mass"])

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != now:
                    if held:
                        yield done()
                    now, held = shard, []
                held.append(unpacked(blob.as_py()))
        if held:
            yield done()

    ordered = counted.repartitionById(n, F.col("shard"))
    told = ordered.sortWithinPartitions("shard").mapInArrow(run, "shard int, n long, widest long, starts array<long>, split array<long>, mass array<long>")
    return sorted(tuple(r) for r in told.collect())


def starts_of(mass: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts at which the next level's shards begin, over how many shards each start is split (more than one for a single context with a mass over ``most``), and the mass of those."""
    hot = mass > most
    before = np.cumsum(np.where(hot, 0, mass)) - np.where(hot, 0, mass)
    begins = np.r_[True, before[1:] // most != before[:-1] // most] | hot | np.r_[False, hot[:-1]]
    at = np.flatnonzero(begins)
    return at, np.where(hot[at], -(-mass[at] // most), 1), np.where(hot[at], mass[at], 0)


# the model


class Vocabulary:
    """Level 1: sorted word hashes and counts; a word's id is its place."""

    def __init__(self, shards: list[list[np.ndarray]]):
        self.hashes, self.counts = [s[0] for s in shards], [s[1:] for s in shards]
        self.first = np.r_[0, np.cumsum([len(h) for h in self.hashes])].astype(np.int64)
        self.bounds = np.array([h[0] for h in self.hashes[1:]], np.uint64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not seen in training) and counts."""
        if not self.hashes:
            return np.full(len(h), -1), np.zeros(len(h), np.int64)
        unique, back = np.unique(h, return_inverse=True)
        edge = np.r_[0, np.searchsorted(unique, self.bounds), len(unique)]
        ids, counts = np.full(len(unique), -1), np.zeros(len(unique), np.int64)
        for s in np.flatnonzero(np.diff(edge)).tolist():
            own = slice(edge[s], edge[s + 1])
            at = np.minimum(np.searchsorted(self.hashes[s], unique[own]), len(self.hashes[s]) - 1)
            hit = np.flatnonzero(self.hashes[s][at] == unique[own])
            at = at[hit]
            ids[edge[s] + hit] = at + self.first[s]
            counts[edge[s] + hit] = at_places(self.counts[s], at)
        return ids[back], counts[back]

    def count(self, ids: np.ndarray) -> np.ndarray:
        unique, back = np.unique(ids, return_inverse=True)
        edge, counts = np.searchsorted(unique, self.first), np.zeros(len(unique), np.int64)
        for s in np.flatnonzero(np.diff(edge)).tolist():
            own = slice(edge[s], edge[s + 1])
            counts[own] = at_places(self.counts[s], unique[own] - self.first[s])
        return counts[back]


class Places:
    """Which shard of a level holds which contexts: ``starts`` in order, each split over ``split`` shards by word."""

    def __init__(self, starts: np.ndarray, split: np.ndarray):
        self.starts, self.split = starts, split
        self.first = np.r_[0, np.cumsum(split)].astype(np.int64)

    def shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        e = np.searchsorted(self.starts, context, "right") - 1
        out = self.first[e]
        if (hot := np.flatnonzero(self.split[e] > 1)).size:
            out = out + 0
            out[hot] += (tx.mix(word[hot].astype(np.uint64)) % self.split[e[hot]].astype(np.uint64)).astype(np.int64)
        return out


class Level:
    """Level k >= 2: for contexts (places on level k-1) their successors, pointers, probabilities and back-off weights."""

    def __init__(self, facts: dict, files: list[list[np.ndarray]]):
        self.span, self.places = facts["span"], Places(facts["starts"], facts["split"])
        self.low = np.repeat(facts["starts"], facts["split"])
        self.first, self.before, self.hot = facts["first"], facts["before"], facts["hot"]
        self.seq = [EliasFano.from_arrays(*s[0:5]) if s else None for s in files]
        self.pointers = [EliasFano.from_arrays(*s[5:10]) if s else None for s in files]
        self.prob, self.rest = [s[10] if s else None for s in files], [s[11] if s else None for s in files]

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """For (context place, successor), -1 for none: place on this level, rank among the context's successors, discounted probability, weight of what is below.

        Each distinct pair is searched once, in order, so that neighbouring searches touch neighbouring memory.
        """
        n = len(context)
        place, rank, prob, rest = np.full(n, -1), np.full(n, -1), np.zeros(n), np.ones(n)
        asked = np.flatnonzero(context >= 0)
        if not len(asked):
            return place, rank, prob, rest
        c, w = context[asked], word[asked]
        order = np.argsort(c * (self.span + 1) + w) if int(c.max() + 1) * (self.span + 1) < 1 << 62 else np.lexsort((w, c))
        c, w = c[order], w[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]
        back = np.cumsum(new) - 1
        c, w = c[new], w[new]
        found = [np.full(len(c), -1), np.full(len(c), -1), np.zeros(len(c)), np.ones(len(c))]
        shard = self.places.shard(c, np.maximum(w, 0))
        if (shard[1:] < shard[:-1]).any():
            by = np.argsort(shard, kind="stable")
        else:
            by = None
        line = shard if by is None else shard[by]
        edge = np.r_[np.flatnonzero(np.r_[True, line[1:] != line[:-1]]), len(line)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            s, own = int(line[a]), np.arange(a, b) if by is None else by[a:b]
            if self.seq[s] is None:
                continue
            own_c, own_w = c[own] - self.low[s], w[own]
            inside = own_c < len(self.rest[s])
            own, own_c, own_w = own[inside], own_c[inside], own_w[inside]
            found[3][own] = value(self.rest[s][own_c])
            known = np.flatnonzero(own_w >= 0)
            own, own_c, own_w = own[known], own_c[known], own_w[known]
            at = self.seq[s].find(own_c * self.span + own_w)
            hit = np.flatnonzero(at >= 0)
            own, own_c, at = own[hit], own_c[hit], at[hit]
            found[0][own] = at + self.first[s]
            found[1][own] = at - self.pointers[s].get(own_c) + self.before[s]
            found[2][own] = value(self.prob[s][at])
        if len(self.hot[0]):  # contexts that are split have their weight in the facts
            i = np.minimum(np.searchsorted(self.hot[0], c), len(self.hot[0]) - 1)
            found[3] = np.where(self.hot[0][i] == c, self.hot[1][i], found[3])
        for whole, part in zip((place, rank, prob, rest), found):
            whole[asked[order]] = part[back]
        return place, rank, prob, rest


class Model:
    def __init__(self, path: str, facts: dict):
        self.facts = facts
        self.vocabulary = Vocabulary([get(f"{path}/1/{s:06d}") for s in facts["vocabulary"]])
        self.levels = [Level(f, [get(f"{path}/{k}/{s:06d}") if n else [] for s, n in enumerate(f["n"].tolist())]) for k, f in enumerate(facts["levels"], 2)]

    def grams(self, ids: np.ndarray, age: np.ndarray) -> list[tuple]:
        """For tokens with these ids and ages(), level by level: what find() gives for the n-gram that ends at each token."""
        place, rank, found = ids, ids, []
        for k, level in enumerate(self.levels, 2):
            context = np.r_[-1, place[:-1]]
            context[age < k - 1] = -1
            found.append(level.find(context, rank))
            place, rank = found[-1][:2]
        return found


def loaded(path: str, facts: dict) -> Model:
    """The worker's mapping of a model; training maps the levels that are ready."""
    name = f"{path}/{len(facts['levels'])}"
    if name not in _models:
        _models.clear()
        _models[name] = Model(path, facts)
    return _models[name]


# texts and their ids


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, end row, token hashes with an END after every text, and the place of each text's end (a 0 before)."""
    for a, b, data, starts, ends, row in tx.words_of(column, True, TEXTS):
        h = tx.hashes(data, starts, ends)
        at = row + np.arange(len(row))
        out = np.full(len(h) + len(row) - 1, END)
        inner = np.ones(len(out), bool)
        inner[at[1:] - 1] = False
        out[inner] = h
        yield a, b, out, at


def id_slices(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows of packed ids: first row, end row, ids with the END's id before the first text and after every one, and the places of those."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for a, b in tx.slices(whole, at, IDS):
        part = whole[at[a] : at[b]].reshape(-1, width)
        wide = np.zeros((len(part) + 1, 8), np.uint8)
        wide[1:, :width] = part
        wide[0] = wide[-1]
        yield a, b, wide.view("<i8").ravel() - 1, (at[a : b + 1] - at[a]) // width


def ages(at: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each token has before it in its text, the opening END among them. An END between two texts counts as the end of the first."""
    begins = np.zeros(n, np.int64)
    begins[at[:-1]] = at[:-1]
    return np.arange(n) - np.r_[0, np.maximum.accumulate(begins)[:-1]] if n else begins


def per_text(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums per text, each over the text's own tokens."""
    return np.add.reduceat(x, at[:-1]) if len(at) > 1 else x[:0]


def vocabulary(rows: DataFrame, most: int = MASS, each: int = BYTES) -> tuple[str, dict]:
    """``rows(text)`` -> folder of the model, and its facts so far. Shards take contexts of ``most`` tokens, and the words of ``each`` bytes of text, about."""
    path = fresh_path(rows.sparkSession, "lm")
    size = bounded(rows).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 << (int(size) // each).bit_length()
    bits = np.uint64(64 - n.bit_length() + 1)

    def place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> bits).astype(np.int64) if n > 1 else np.zeros(len(h), np.int64), h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(place)
        for batch in batches:
            for _, _, h, _ in tokens(batch.column(0)):
                yield from sums.add(h)
        yield from sums.flush()

    def build(shard: int, h: np.ndarray, counts: np.ndarray) -> tuple:
        put(f"{path}/1/{shard:06d}", [h, *small(counts)])
        return int(counts.sum()), *(x.tolist() for x in starts_of(counts, most))

    told = shards_of(rows.select("text").mapInArrow(run, "shard int, counts binary"), n, build)
    types = sum(t[1] for t in told)
    return path, {"tokens": sum(t[2] for t in told), "types": types, "width": max(1, (types.bit_length() + 7) // 8), "vocabulary": [t[0] for t in told], "most": most, "levels": [], "next": layout(told)}


def layout(told: list[tuple]) -> dict:
    """Where the next level's shards begin, from what the shards of this level tell."""
    first = np.r_[0, np.cumsum([t[1] for t in told])].astype(np.int64)
    starts = np.concatenate([np.array(t[3], np.int64) + f for t, f in zip(told, first)] or [np.zeros(0, np.int64)])
    split, mass = (np.concatenate([np.array(t[k], np.int64) for t in told] or [np.zeros(0, np.int64)]) for k in (4, 5))
    return {"starts": starts, "split": split, "mass": mass, "files": np.array([t[0] for t in told], np.int64), "first": first}


def coded(rows: DataFrame, path: str, facts: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of rows with ``n_tokens``, ``n_known``, ``base_score`` and ``ids``, one more than the words' places in the vocabulary, packed."""
    width, total = facts["width"], facts["tokens"] + facts["types"] + 1
    names = ["n_tokens", "n_known", "base_score", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path, facts).vocabulary
        for batch in batches:
            for a, b, h, at in tokens(batch.column(0)):
                ids, counts = words.find(h)
                raw = np.ascontiguousarray((ids + 1).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width])
                blob = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at * width), pa.py_buffer(raw)]).cast(pa.binary())
                base = per_text(np.log10((counts + 1) / total), at)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[1:]], pa.array(np.diff(at)), pa.array(per_text((counts > 0).astype(np.int64), at)), pa.array(base), blob], names=[*batch.schema.names[1:], *names])

    kinds = [LongType(), LongType(), DoubleType(), BinaryType()]
    return rows.select(F.col("text").alias("__text"), *keep).mapInArrow(run, StructType([*[rows.schema[c] for c in keep], *map(StructField, names, kinds)]))


def grow(ids: DataFrame, path: str, facts: dict, order: int, quantised: bool) -> dict:
    """The facts with one more level, counted from ``ids(ids)``. Only levels under ``order`` keep their counts, the next level's masses."""
    known, k, nxt, most = {x: y for x, y in facts.items() if x != "next"}, len(facts["levels"]) + 2, facts["next"], facts["most"]
    span = int(facts["levels"][-1]["widest"] if k > 2 else facts["types"])
    where = Places(nxt["starts"], nxt["split"])
    low = np.repeat(nxt["starts"], nxt["split"])
    hot = np.repeat(nxt["mass"], nxt["split"])
    n = len(low)

    def place(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = where.shard(context, word)
        return shard, (context - low[shard]) * span + word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = loaded(path, known), Sums(place)
        for batch in batches:
            for _, _, own, at in id_slices(batch.column(0), known["width"]):
                age = ages(at, len(own))
                last = model.grams(own, age)[-1][:2] if k > 2 else (own, own)
                context = np.r_[-1, last[0][:-1]]
                ok = (age >= k - 1) & (context >= 0) & (last[1] >= 0)
                yield from sums.add(context[ok], last[1][ok])
        yield from sums.flush()

    ends = np.r_[nxt["starts"][1:], nxt["first"][-1]]
    high = np.repeat(ends, nxt["split"])
    file = np.searchsorted(nxt["first"], low, "right") - 1

    def build(shard: int, key: np.ndarray, counts: np.ndarray) -> tuple:
        key = key.astype(np.int64)
        a, b, f = int(low[shard]), int(high[shard]), int(file[shard])
        parts = get(f"{path}/{k - 1}/{nxt['files'][f]:06d}")
        mass = slice_of(parts[1:4] if k == 2 else parts[12:15], a - int(nxt["first"][f]), b - int(nxt["first"][f]))
        context = key // span
        edge = np.searchsorted(context, np.arange(b - a + 1))
        many = np.diff(edge)
        prob = (counts - DISCOUNT) / mass[context]
        rest = np.where(many > 0, DISCOUNT * many / np.maximum(mass, 1), 1.0)
        arrays = [*EliasFano.of(key, (b - a) * span).arrays(), *EliasFano.of(edge[:-1], len(key) + 1).arrays(), *((code(prob), code(rest)) if quantised else (prob, rest)), *(small(counts) if k < order else [])]
        put(f"{path}/{k}/{shard:06d}", arrays)
        return int(many.max()), *(x.tolist() for x in starts_of(counts, most))

    told = shards_of(ids.select("ids").mapInArrow(run, "shard int, counts binary"), n, build)
    sizes = np.zeros(n, np.int64)
    sizes[[t[0] for t in told]] = [t[1] for t in told]
    first = np.r_[0, np.cumsum(sizes)]
    before = np.where(hot > 0, first[:-1] - np.repeat(first[where.first[:-1]], nxt["split"]), 0)
    whole = np.add.reduceat(sizes, where.first[:-1]) if n else sizes
    over = np.flatnonzero(nxt["mass"] > 0)
    rests = np.where(whole[over] > 0, DISCOUNT * whole[over] / np.maximum(nxt["mass"][over], 1), 1.0)
    widest = max([t[2] for t in told] + whole[over].tolist(), default=1)
    level = {"span": span, "starts": nxt["starts"], "split": nxt["split"], "n": sizes, "first": first[:-1], "before": before, "hot": (nxt["starts"][over], rests), "widest": widest}
    return {**known, "levels": [*facts["levels"], level], "next": layout(told)}


def train(ids: DataFrame, path: str, facts: dict, order: int = ORDER, quantised: bool = True) -> dict:
    """The facts with the levels 2 to ``order``, counted from ``ids(ids)``, those that coded() gives for the training texts."""
    while len(facts["levels"]) + 1 < order and len(facts["next"]["starts"]):
        facts = grow(ids, path, facts, order, quantised)
    return {x: y for x, y in facts.items() if x != "next"}


def score(coded: DataFrame, path: str, facts: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of what coded() gives with ``train_tokens`` and ``score``, the model's log10 probability of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = loaded(path, facts), facts["tokens"] + facts["types"] + 1
        for batch in batches:
            for a, b, ids, at in id_slices(batch.column(0), facts["width"]):
                p = (model.vocabulary.count(ids) + 1) / total
                for _, _, prob, rest in model.grams(ids, ages(at, len(ids))):
                    p = prob + rest * p
                own = per_text(np.log10(np.minimum(p[1:], 1)), at)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[1:]], pa.array(np.full(b - a, facts["tokens"])), pa.array(own)], names=[*batch.schema.names[1:], "train_tokens", "score"])

    return coded.select("ids", *keep).mapInArrow(run, StructType([*[coded.schema[c] for c in keep], StructField("train_tokens", LongType()), StructField("score", DoubleType())]))


def train_and_score(docs: DataFrame, modulus: int = 7, held: int = 2, quantised: bool = True, most: int = MASS, each: int = BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``: learns from documents whose crc32(doc_id) mod ``modulus`` isn't ``held``.

    A null text counts as empty: one token, its END. One row per input row; repeated rows count as often as they stand there. An empty table gives an
    empty one, and with nothing to learn from every token has probability 1. Other columns are not read. Each token's log10 probability is off by less
    than 0.0005 by the quantisation (three factors of at most 2**(1/2048)); ``quantised=False`` keeps doubles.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    path, facts = vocabulary(rows.where("not held_out"), most, each)
    ids = cut(coded(rows, path, facts, ["doc_id", "held_out"]), "ids")
    facts = train(ids.where("not held_out"), path, facts, quantised=quantised)
    out = score(ids, path, facts, ["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
