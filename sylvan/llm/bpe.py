"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts a text into chunks wherever the hash of the last ``WINDOW`` bytes is 0 modulo ``SPREAD``, so copies and shared
passages are cut alike. Chunks are named by a digest of their bytes. Those that stand more than once in the whole table are encoded once, by the document
with the smallest id that holds them, into a store of sorted shard files in the shared folder, which the workers that encode documents map; all
other chunks are encoded where they stand. Digests travel, texts don't.

A cut may fall inside a word, where encoding the sides apart is wrong, so a chunk keeps its whole words' encodings and its ends are left open. A join is
repaired by encoding anew from the left chunk's last whole word to the right chunk's first one: it holds if the outcome begins and ends
exactly with what the two chunks have for these words. If not, or if a chunk has no two whole words, the two are taken as one chunk, encoded anew.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import text as tx
from sylvan.llm.files import get
from sylvan.llm.files import put as put_file
from sylvan.llm.shared import bounded, cut, fresh_path

WINDOW, SPREAD = 16, 512
#: Entries after which a worker's cache of pre-tokens or words starts anew, and chunks in a shard of the store, about.
PIECES, WORDS, SHARD = 250_000, 50_000, 20_000
#: Texts of these letters need no normaliser but lower-casing, and no splitter but this one; all others go through the whole tokenizer.
PLAIN = re.compile("[ \t\n\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \t\n\ra-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
#: Blanks at which no normaliser, pre-tokenizer or merge looks across.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
BLANKS, WORD = re.compile(rb"[ \t\n\r]"), re.compile(rb"[^ \t\n\r]+")
_workers: dict[str, Encoder] = {}


class Encoder:
    """The tokenizer of one file, with a cache of pre-tokens and words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bpe, self.level = self.tokenizer.model, byte_names()
        steps = json.loads(self.tokenizer.to_str())
        #: Whether the file has the normaliser and splitter that PLAIN and PIECE stand for, and decodes to names parted by blanks.
        self.plain = '"type":"Lowercase"' in (told := json.dumps(steps["normalizer"], separators=(",", ":"))) and '"NFC"' in told and steps["decoder"] is None and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if steps["normalizer"] and steps["pre_tokenizer"] and steps["pre_tokenizer"]["type"] == "Sequence" else False
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Caches pre-tokens. When the cache is full it becomes the old one, from which those still in use come back."""
        if len(self.pieces) > PIECES:
            self.pieces, self.old = {}, self.pieces
        for piece in pieces:
            if (found := self.old.get(piece)) is None:
                tokens = self.bpe.tokenize(piece if piece.isascii() else "".join([self.level[b] for b in piece.encode()]))
                found = array("I", [t.id for t in tokens]).tobytes(), " ".join([t.value for t in tokens]).encode()
            self.pieces[piece] = found

    def learn_words(self, words: list[bytes]) -> None:
        """Caches words that need the whole tokenizer."""
        if len(self.words) + len(words) > WORDS:
            self.words.clear()
        for word, e in zip(words, self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)):
            self.words[word] = np.array(e.ids, "<u4").tobytes(), self.decode(e.ids)

    def decode(self, ids: list[int]) -> bytes:
        return self.tokenizer.decode(ids, skip_special_tokens=False).encode()

    def stretch(self, data: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text of bytes that begin and end at blanks or at the text's ends."""
        if self.plain and b"<|" not in data and PLAIN(text := data.decode()):
            pieces = PIECE(text.lower())
            known = self.pieces
            try:
                found = [known[p] for p in pieces]
            except KeyError:
                self.learn({p for p in pieces if p not in known})
                if known is not self.pieces:  # the cache was turned over
                    self.learn({p for p in pieces if p not in self.pieces})
                found = [self.pieces[p] for p in pieces]
        else:
            words = data.split()
            if any(w not in self.words for w in words):
                self.learn_words([w for w in set(words) if w not in self.words])
            if any(w not in self.words for w in words):  # the cache began anew
                self.learn_words(list(set(words)))
            found = [self.words[w] for w in words]
        return b"".join([i for i, _ in found]), b" ".join([d for i, d in found if i])

    def chunk(self, data: bytes) -> tuple[bytes, ...] | None:
        """Ids and decoded text of a chunk's first whole word, of those between, and of the last one; None if there are not two."""
        left, right = blank_after(data), blank_before(data)
        inner = data[left:right].split()
        if len(inner) < 2:
            return None
        return (*self.stretch(inner[0]), *self.stretch(b" ".join(inner[1:-1])), *self.stretch(inner[-1]))

    def encode(self, data: bytes, cuts: list[int], known: list[tuple | None]) -> tuple[bytes, bytes]:
        """Ids and decoded text of a text's bytes, cut into chunks at ``cuts``; ``known`` has the chunks' encodings from the store, or None."""
        edge = [0, *cuts, len(data)]
        ids, names = [], []
        at, entry = None, None  # the last chunk that was taken in, and its encoding
        k, last = 0, len(edge) - 1
        while k < last:
            a, b = edge[k], edge[k + 1]
            own, more = known[k] or self.chunk(data[a:b]), 1
            join = own and self.join(data, at, entry, (a, b), own)
            while not join and k + 1 < last:  # no whole words here, or no agreement: one chunk with the next ones
                k = min(last - 1, max(k + 1, bisect_left(edge, two_words(data, a)) - 1) if own is None else k + more)
                more *= 2
                b = edge[k + 1]
                own = self.chunk(data[a:b])
                join = own and self.join(data, at, entry, (a, b), own)
            if not join:  # nor with all that follows: one with what came before, or the whole text
                begin = 0 if at is None else after_words(data, *at)
                put(ids, names, *self.stretch(data[begin:]))
                return b"".join(ids), b" ".join(names)
            put(ids, names, *join)
            for i in (0, 2, 4):
                put(ids, names, own[i], own[i + 1])
            at, entry = (a, b), own
            k += 1
        if at is not None:
            put(ids, names, *self.stretch(data[after_words(data, *at) :]))
        return b"".join(ids), b" ".join(names)

    def join(self, data: bytes, at: tuple | None, entry: tuple | None, to: tuple, own: tuple) -> tuple[bytes, bytes] | None:
        """What stands between the last whole word of the chunk ``at`` and the first one of the chunk ``to``, if encoding from one to the other agrees with both."""
        a = 0 if at is None else last_word(data, *at)
        b = first_word_end(data, *to)
        found, told = self.stretch(data[a:b])
        before, after = (b"", b"") if entry is None else entry[4:6], own[0:2]
        if len(found) < len(before[0]) + len(after[0]) or not found.startswith(before[0]) or not found.endswith(after[0]):
            return None
        names = told.split(b" ")
        return found[len(before[0]) : len(found) - len(after[0])], b" ".join(names[len(before[0]) // 4 : len(names) - len(after[0]) // 4])


def put(ids: list[bytes], names: list[bytes], more: bytes, told: bytes) -> None:
    if more:
        ids.append(more)
        names.append(told)


def byte_names() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def blank_after(data: bytes, a: int = 0, b: int | None = None) -> int:
    """The first blank in [a, b), else b."""
    b = len(data) if b is None else b
    return min((i for c in (b" ", b"\n", b"\t", b"\r") if (i := data.find(c, a, b)) >= 0), default=b)


def blank_before(data: bytes, a: int = 0, b: int | None = None) -> int:
    """Just after the last blank in [a, b), else a."""
    return max(max(data.rfind(c, a, len(data) if b is None else b) for c in (b" ", b"\n", b"\t", b"\r")) + 1, a)


def two_words(data: bytes, a: int) -> int:
    """Past the blank after the second whole word from a on, else past the end."""
    at = BLANKS.search(data, a)
    for _ in range(2):
        at = at and WORD.search(data, at.end())
    return at.end() + 1 if at else len(data) + 1


def after_words(data: bytes, a: int, b: int) -> int:
    """Where the last whole word of the chunk [a, b) ends."""
    return a + len(data[a : blank_before(data, a, b)].rstrip(b" \n\t\r"))


def last_word(data: bytes, a: int, b: int) -> int:
    """Where it begins."""
    return blank_before(data, a, after_words(data, a, b))


def first_word_end(data: bytes, a: int, b: int) -> int:
    """Where the first whole word of the chunk [a, b) ends."""
    gap = blank_after(data, a, b)
    begin = b - len(data[gap:b].lstrip(b" \n\t\r"))
    return blank_after(data, begin, b)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last WINDOW bytes cuts."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) ^ np.uint32(0x85EBCA6B)
    step = 1
    while step < WINDOW:
        h = h[:-step] * np.uint32(0x01000193 ** step & 0xFFFFFFFF) + h[step:]
        step *= 2
    return np.flatnonzero((h >> np.uint32(13)) % SPREAD == 0) + WINDOW


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def chunked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list[int], list[list[int]], np.ndarray]]:
    """For each slice of rows (texts in column 0): first row, end row, bytes, where the texts begin (one entry more), where each is cut, and the chunks' digests, two numbers a chunk."""
    data, at = tx.raw(batch.column(0))
    for r0, r1 in tx.slices(data, at):
        part = data[at[r0] : at[r1]]
        places, whole, edge = cuts(part), part.tobytes(), (at[r0 : r1 + 1] - at[r0]).tolist()
        inner = []
        for a, b in zip(edge, edge[1:]):
            own = places[np.searchsorted(places, a, "right") : np.searchsorted(places, b, "left")]
            inner.append((own[own - WINDOW >= a] - a).tolist())
        digests = []
        for a, b, own in zip(edge, edge[1:], inner):
            if own:  # a text in one piece has no chunks to share
                ends = [a, *[a + c for c in own], b]
                digests += [hashlib.blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(ends, ends[1:])]
        yield r0, r1, whole, edge, inner, np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


class Store:
    """Sorted shards of chunk digests with a number or an encoding each."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.shards = path, bits, {}

    def shard(self, s: int) -> list[np.ndarray]:
        if s not in self.shards:
            self.shards[s] = get(f"{self.path}/{s:06d}")
        return self.shards[s]

    def find(self, digests: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], int]]:
        """Of the digests that the store has: their number, shard, and place there."""
        high = digests[:, 0]
        order = np.argsort(high)
        shard = (high[order] >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(order), np.int64)
        for s in np.unique(shard).tolist():
            own, held = order[shard == s], self.shard(s)
            at = np.minimum(np.searchsorted(held[0], high[own]), max(0, len(held[0]) - 1))
            hit = held[0][at] == high[own] if len(held[0]) else np.zeros(len(own), bool)
            for k, i in zip(own[hit].tolist(), at[hit].tolist()):
                while i < len(held[0]) and held[0][i] == high[k] and held[1][i] != digests[k, 1]:
                    i += 1
                if i < len(held[0]) and held[0][i] == high[k]:
                    yield k, held, i


def stored(rows: DataFrame, what: str, bits: int) -> Store:
    """``(high long, low long, value long or binary)`` -> a store in the shared folder; of equal digests one row counts."""
    path = fresh_path(rows.sparkSession, what)
    binary = dict(rows.dtypes)["value"] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        high, low = (np.concatenate([b.column(k).to_numpy().view(np.uint64) for b in tables] or [np.zeros(0, np.uint64)]) for k in (0, 1))
        order = np.lexsort((low, high))
        order = order[np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]] if len(order) else order
        if binary:
            blobs = [x for b in tables for x in b.column(2).to_pylist()]
            blobs = [blobs[i] for i in order.tolist()]
            values = [np.r_[0, np.cumsum([len(x) for x in blobs])].astype(np.int64), np.frombuffer(b"".join(blobs), np.uint8)]
        else:
            values = [np.concatenate([b.column(2).to_numpy() for b in tables] or [np.zeros(0, np.int64)])[order]]
        put_file(f"{path}/{TaskContext.get().partitionId():06d}", [high[order], low[order], *values])
        yield pa.RecordBatch.from_arrays([pa.array([len(order)])], ["n"])

    shard = F.shiftrightunsigned("high", 64 - bits).cast("int") if bits else F.lit(0)
    rows.repartitionById(1 << bits, shard).select("high", "low", "value").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return Store(path, bits)


def shared_chunks(docs: DataFrame, path: str, id_: str) -> Store:
    """The encodings of all chunks that stand more than once in ``docs(text, id)``. Each is encoded by the document with the smallest id that holds it; rows without an id encode none."""
    texts = bounded(docs).select(F.col("text").cast("string").alias("text"), F.col(id_).cast("long").alias("doc"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, _, _, inner, digests in chunked(batch):
                doc = batch.column(1).slice(r0, r1 - r0).take(pa.array(np.repeat(np.arange(r1 - r0), [len(c) + 1 if c else 0 for c in inner])))
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)), doc], ["high", "low", "doc"])

    seen = texts.mapInArrow(named, "high long, low long, doc long").groupBy("high", "low").agg(F.count("*").alias("n"), F.min("doc").alias("value"))
    owners = cut(seen.where("n > 1 and value is not null").drop("n"), "chunks")
    bits = max(0, (owners.count() // SHARD).bit_length())
    owner = stored(owners, "chunk-owners", bits)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for r0, r1, whole, edge, inner, digests in chunked(batch):
                ends = [(r, a + x, a + y) for r, (a, b, own) in enumerate(zip(edge, edge[1:], inner)) if own for x, y in zip([0, *own], [*own, b - a])]
                docs_ = batch.column(1).slice(r0, r1 - r0).to_pylist()
                out = {}
                for k, held, i in owner.find(digests):
                    r, a, b = ends[k]
                    if docs_[r] == held[2][i] and (entry := e.chunk(whole[a:b])):
                        out[digests[k].tobytes()] = np.array([len(x) for x in entry], "<u4").tobytes() + b"".join(entry)
                if out:
                    names = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(list(out.values()), pa.binary())], ["high", "low", "value"])

    return stored(texts.mapInArrow(encoded, "high long, low long, value binary"), "chunk-store", bits)


def entry_of(held: list[np.ndarray], i: int) -> tuple[bytes, ...]:
    blob = held[3][held[2][i] : held[2][i + 1]].tobytes()
    size, at, out = np.frombuffer(blob[:24], "<u4").tolist(), 24, []
    for n in size:
        out.append(blob[at : at + n])
        at += n
    return tuple(out)


def encode_decode(docs: DataFrame, path: str, keep: list[str], digests: bool = True, id_: str = "doc_id") -> DataFrame:
    """Columns ``keep`` of docs with ``n_tokens`` and, for digests, ``ids_sha256`` and ``decoded_sha256``, else ``ids`` and ``decoded``.

    Null and empty texts have no tokens. One row per input row, in any order, so repeated rows repeat; an empty table gives an empty one. The column ``id_`` only
    says who encodes a shared chunk; rows may share an id or have none.
    """
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    store = shared_chunks(docs, path, id_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for _, _, whole, edge, inner, named in chunked(batch):
                known: list[tuple | None] = [None] * len(named)
                for k, held, i in store.find(named):
                    known[k] = entry_of(held, i)
                at = 0
                for a, b, own in zip(edge, edge[1:], inner):
                    if own:
                        found, back = e.encode(whole[a:b], own, known[at : at + len(own) + 1])
                        at += len(own) + 1
                    else:
                        found, back = e.stretch(whole[a:b])
                    n.append(len(found) // 4)
                    ids.append(hashlib.sha256(found).hexdigest() if digests else np.frombuffer(found, "<u4").astype(np.int64))
                    decoded.append(hashlib.sha256(back).hexdigest() if digests else back.decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int64())), pa.array(decoded, pa.string())], names=[*batch.schema.names[1:], *names])

    schema = StructType([*[docs.schema[c] for c in keep], *[StructField(c, t) for c, t in zip(names, (LongType(), StringType() if digests else ArrayType(LongType()), StringType()))]])
    return docs.select(F.col("text").cast("string").alias("__text"), *keep).mapInArrow(run, schema)
