"""Substring dedup over a de Bruijn graph of word k-mers.

Edges are windows of ``K`` consecutive words between (K-1)-word nodes. As in minimiser-partitioned compaction (Chikhi, Limasset,
Medvedev, "Compacting de Bruijn graphs from sequencing data quickly and in low memory", 2016) a reading is cut into chains of
consecutive edges with one minimiser, and only these chains are shuffled. In a bucket each edge gets the first coordinate at
which it occurs (smallest doc_id, then position); a chain of repeated edges whose successors in the reading are also the successors
at that first coordinate has no branch and becomes one path. Paths are glued across buckets by document, and every path is
verified at its source coordinates: a digest of the words there, joined to the path, must equal the digest of the path's own words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.llm import text as tx
from sylvan.llm.shared import bounded, cut

#: Words in a window, and in the k-mers from which a window's minimiser is taken.
K, ANCHOR = 13, 6
#: Bytes of a window's hash that a chain carries; with its minimiser's 64 bits they tell windows apart.
CHECK = 6
#: at: first window << 32 | windows. checks: CHECK bytes per window; for paths that are settled already (windows < 0) the source coordinate.
CHAIN = "key long, doc long, at long, checks binary"
PATH = "doc long, start int, n int, own_doc long, own_start int"


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    out, done = x, 1
    while done < n:
        step = min(done, n - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def runs(same_as_before: np.ndarray) -> np.ndarray:
    """Where runs begin."""
    begins = ~same_as_before
    if len(begins):
        begins[0] = True
    return np.flatnonzero(begins)


def first_coordinate(order: np.ndarray, new: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in ``order``, where groups begin at ``new``: each row's group's smallest (doc, pos)."""
    d, p = doc[order], pos[order]
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(d, first)
    size = np.diff(np.r_[first, len(d)])
    low_all = np.repeat(low, size)
    at = np.repeat(np.minimum.reduceat(np.where(d == low_all, p, np.iinfo(np.int32).max), first), size)
    own_doc, own_pos = np.empty_like(d), np.empty_like(p)
    own_doc[order], own_pos[order] = low_all, at
    return own_doc, own_pos


def paths(doc, pos, own_doc, own_pos, keep) -> list[np.ndarray]:
    """Nonbranching paths of the kept edges, which stand in reading order: doc, start, n, own_doc, own_start."""
    doc, pos, own_doc, own_pos = (c[keep] for c in (doc, pos, own_doc, own_pos))
    if not len(doc):
        return [doc, pos, pos, own_doc, own_pos]
    joined = np.zeros(len(doc), bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (own_doc[1:] == own_doc[:-1]) & (own_pos[1:] == own_pos[:-1] + 1)
    b = runs(joined)
    return [doc[b], pos[b], np.diff(np.r_[b, len(doc)]).astype(np.int32), own_doc[b], own_pos[b]]


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of edges by minimiser. Of edges that a slice holds in several documents only the first document's go on; the paths of the others are settled here."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for a, b, data, starts, ends, row in tx.words_of(batch.column(1), lower=False):
            count = np.diff(row)
            if not (count >= K).any():
                continue
            h = tx.hashes(data, starts, ends)
            edge, low = tx.grams(h, K), sliding_min(tx.grams(h, ANCHOR), K - ANCHOR + 1)
            doc_row = np.repeat(np.arange(b - a), count)
            pos = (np.arange(len(h)) - row[doc_row]).astype(np.int32)
            ok = np.flatnonzero(pos[: len(edge)] + K <= count[doc_row[: len(edge)]])
            edge, low, doc, pos = edge[ok], low[ok], ids[a:b][doc_row[ok]], pos[ok]
            order = np.argsort(edge, kind="stable")
            sorted_edge = edge[order]
            own_doc, own_pos = first_coordinate(order, np.r_[True, sorted_edge[1:] != sorted_edge[:-1]], doc, pos)
            later = own_doc < doc
            found = paths(doc, pos, own_doc, own_pos, later)
            n = len(found[0])
            if n:
                source = np.zeros(n, [("doc", "<i8"), ("start", "<i4")])
                source["doc"], source["start"] = found[3], found[4]
                yield chain_rows(tx.mix(found[0].astype(np.uint64)), found[0], found[1], -found[2], source, np.arange(n + 1) * 12)
            keep = ~later
            doc, pos, low, check = doc[keep], pos[keep], low[keep], edge[keep].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK]
            if not len(doc):
                continue
            same = np.zeros(len(doc), bool)
            same[1:] = (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1)
            at = runs(same)
            size = np.diff(np.r_[at, len(doc)]).astype(np.int32)
            yield chain_rows(low[at], doc[at], pos[at], size, check, np.r_[at, len(doc)] * CHECK)


def chain_rows(key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, blob: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    checks = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(blob).view(np.uint8).ravel())])
    at = start.astype(np.int64) << 32 | n.astype(np.int64) & 0xFFFFFFFF
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(at), checks], ["key", "doc", "at", "checks"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser: finds repeated edges and emits the paths of all but their first document. Keeps one bucket over batch ends."""
    names = ["doc", "start", "n", "own_doc", "own_start"]
    held: pa.Table | None = None
    for batch in batches:
        at = batch.column(2).to_numpy()
        settled = pa.array(at.astype(np.int32) < 0)
        if (known := batch.filter(settled)).num_rows:
            source = np.frombuffer(b"".join(known.column(3).to_pylist()), [("doc", "<i8"), ("start", "<i4")])
            at = known.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([known.column(1), pa.array((at >> 32).astype(np.int32)), pa.array(-at.astype(np.int32)), pa.array(source["doc"].copy()), pa.array(source["start"].copy())], names)
        rows = pa.Table.from_batches([batch.filter(pc.invert(settled))])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        key = rows.column(0).to_numpy()
        stop = int(np.searchsorted(key, key[-1], "left"))
        if stop:
            yield from repeated(rows.slice(0, stop), names)
        held = rows.slice(stop)
    if held is not None and held.num_rows:
        yield from repeated(held, names)


def repeated(rows: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    key, doc, at = (rows.column(k).to_numpy() for k in range(3))
    start, n = (at >> 32).astype(np.int32), at.astype(np.int32)
    shared = np.zeros(len(key), bool)  # a bucket of one row repeats nothing in another document
    shared[1:] |= key[1:] == key[:-1]
    shared[:-1] |= key[1:] == key[:-1]
    if not shared.any():
        return
    rows = rows.filter(pa.array(shared))
    key, doc, start, n = key[shared], doc[shared], start[shared], n[shared]
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    wide[:, :CHECK] = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, CHECK)
    check = wide.view("<u8").ravel()
    row = np.repeat(np.arange(len(key)), n)
    pos = (start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    doc, key = doc[row], key[row]
    order = np.lexsort((check, key))
    c, k = check[order], key[order]
    own_doc, own_pos = first_coordinate(order, np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])], doc, pos)
    found = paths(doc, pos, own_doc, own_pos, own_doc < doc)
    if len(found[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)


def digest_of(words: list[bytes], start: int, n: int) -> bytes | None:
    """A digest of the words of n windows, None where the text is shorter."""
    return None if start + n + K - 1 > len(words) else hashlib.blake2b(b" ".join(words[start : start + n + K - 1]), digest_size=12).digest()


def at_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = tx.raw(batch.column(1))
        out: list[tuple] = []
        for doc, a, b, wanted in zip(batch.column(0).to_pylist(), at[:-1], at[1:], batch.column(2).to_pylist()):
            words = data[a:b].tobytes().split()
            out += [(doc, x["own_start"], x["n"], digest_of(words, x["own_start"], x["n"])) for x in wanted]
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["own_doc", "own_start", "n", "digest"])


def without_repeats(layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.raw(batch.column(1))
            n_words, n_removed, kept = [], [], []
            for a, b, wanted in zip(at[:-1], at[1:], batch.column(2).to_pylist()):
                whole = data[a:b].tobytes()
                words = whole.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for x in wanted or ():
                    if x["digest"] is not None and digest_of(words, x["start"], x["n"]) == x["digest"]:
                        gone[x["start"]] += 1
                        gone[x["start"] + x["n"] + K - 1] -= 1
                left = np.cumsum(gone)[:-1] == 0
                n_words.append(len(words))
                n_removed.append(int(len(words) - left.sum()))
                if not layout:
                    kept.append(b" ".join(words if left.all() else [words[i] for i in np.flatnonzero(left)]).decode())
                elif left.all():
                    kept.append(whole.decode())
                else:
                    starts, _, _ = tx.spans(data[a:b], np.array([0, b - a]))
                    edges = np.r_[starts, b - a]
                    kept.append(b"".join([whole[edges[i] : edges[i + 1]] for i in np.flatnonzero(left)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", *batch.schema.names[3:], "n_words", "n_removed", "kept_text"])

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> glued paths ``(doc, start, n, own_doc, own_start)``: n windows from word ``start`` on that also start at the source coordinate of a document with a smaller id."""
    found = docs.select("doc_id", "text").mapInArrow(chains, CHAIN).repartition("key").sortWithinPartitions("key").mapInArrow(settle, PATH)
    several = cut(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if several.isEmpty():
        return glued(found)
    # Coordinates of ids with several readings don't say which one: their paths are not glued, each is verified by itself.
    marked = found
    for c in ("doc", "own_doc"):
        marked = marked.join(several.select(F.col("doc_id").alias(f"of_{c}")), F.col(c) == F.col(f"of_{c}"), "left")
    marked = cut(marked.withColumn("loose", F.col("of_doc").isNotNull() | F.col("of_own_doc").isNotNull()).drop("of_doc", "of_own_doc"), "paths")
    return glued(marked.where("not loose").drop("loose")).unionByName(marked.where("loose").drop("loose").distinct())


def glued(found: DataFrame) -> DataFrame:
    """Paths that go on where the one before ends, in the reading and at the source, as one."""
    w = Window.partitionBy("doc").orderBy("start", "own_doc", "own_start")
    before = lambda c: F.lag(c).over(w)
    joined = (F.col("start") == before("start") + before("n")) & (F.col("own_doc") == before("own_doc")) & (F.col("own_start") == before("own_start") + before("n"))
    runs_ = found.withColumn("opens", F.when(joined, 0).otherwise(1)).withColumn("path", F.sum("opens").over(w))
    return runs_.groupBy("doc", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("own_doc").alias("own_doc"), F.min("own_start").alias("own_start")).drop("path")


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_words, n_removed, kept_text)``, one row per input row; columns ``keep`` of any names come back in a struct ``row``.

    A window of 13 consecutive words is repeated if it also starts in a document with a smaller doc_id; words that a repeated
    window covers go. Null and empty texts have no words. Rows that share a doc_id count as one document's readings, and each gets
    its own row and is judged by its own text; a null doc_id takes no part and keeps its words. Other columns are not read. An empty table gives an empty one.
    kept_text has one blank between words, or with ``layout`` the blanks and lines of the text, which then stays as it is if nothing goes.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*keep).alias("row")] if keep else []))
    texts = rows.select("doc_id", "text")
    spans = cut(repeated_spans(texts.where("doc_id is not null")), "spans")
    sources = spans.groupBy(F.col("own_doc").alias("src")).agg(F.collect_set(F.struct("own_start", "n")).alias("wanted"))
    digests = texts.join(sources, texts.doc_id == sources.src).select("doc_id", "text", "wanted").mapInArrow(at_source, "own_doc long, own_start int, n int, digest binary")
    checked = spans.join(digests, ["own_doc", "own_start", "n"]).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("start", "n", "digest")).alias("__spans"))
    extra = ["row"] if keep else []
    schema = StructType([StructField("doc_id", LongType()), *[rows.schema[c] for c in extra], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    return rows.join(checked, rows.doc_id == checked["__doc"], "left").select("doc_id", "text", "__spans", *extra).mapInArrow(without_repeats(layout), schema)
