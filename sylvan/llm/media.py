"""MPEG transport streams as a media column (ISO/IEC 13818-1).

Writing: the payload is cut into access units of ``UNIT`` bytes, each one PES packet of a private stream with a timestamp; every 8th unit is
a random-access point with a clock reference. A stream opens with a program association and a program map table. Reading:
both tables are parsed and their CRCs checked, continuity counters are checked, PES packets are reassembled, and timestamps and random-access
points are stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import text as tx
from sylvan.llm.shared import bounded

# Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, PROGRAM, PRIVATE_STREAM, PRIVATE_TYPE = 0, 0x1000, 0x100, 1, 0xBD, 0x06
CLOCK = 90_000

UNIT, ACCESS, STEP = 4096, 8, 3600
ALIGN = 64
PES_HEAD = 14


@cache
def crc_table() -> list[int]:
    out = []
    for v in range(256):
        c = v << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c, table = 0xFFFFFFFF, crc_table()
    for v in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ v]
    return c


def section(table: int, body: bytes) -> bytes:
    """A section with its header and CRC."""
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + PROGRAM.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + data).ljust(PACKET, b"\xff")


@cache
def tables() -> bytes:
    pat = section(0, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(2, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    return table_packet(PAT_PID, pat) + table_packet(PMT_PID, pmt)


@cache
def layout(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packets of one unit of ``size`` bytes without its data, and the places of the PES header and of the data in them."""
    left, packets, places = PES_HEAD + size, [], []
    while left:
        first = not packets
        room = PACKET - 4 - (8 if first else 0)
        take = min(left, room)
        field = PACKET - 4 - take
        head = bytearray([SYNC, (0x40 if first else 0) | STREAM_PID >> 8, STREAM_PID & 255, 0x30 if field else 0x10])
        if field == 1:
            head.append(0)
        elif field:
            head += bytes([field - 1, 0x10 if first else 0]) + b"\xff" * (field - 2)
        places.append(np.arange(take) + len(packets) * PACKET + PACKET - take)
        packets.append(bytes(head).ljust(PACKET, b"\0"))
        left -= take
    at = np.concatenate(places)
    return np.frombuffer(b"".join(packets), np.uint8), at[:PES_HEAD], at[PES_HEAD:]


def stamp(pts: np.ndarray) -> np.ndarray:
    """Five bytes of a 33-bit timestamp."""
    return np.stack([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 255 | 1, pts >> 7 & 255, pts << 1 & 255 | 1], -1).astype(np.uint8)


def write(payload: bytes) -> bytes:
    """A transport stream with the payload, whose length is a positive multiple of 64."""
    data, out, counter = np.frombuffer(payload, np.uint8), [tables()], 0
    full = len(data) // UNIT
    for start, n, size in ((0, full, UNIT), (full * UNIT, int(len(data) > full * UNIT), len(data) - full * UNIT)):
        if not n:
            continue
        base, head, body = layout(size)
        x = np.tile(base, (n, 1))
        x[:, body] = data[start : start + n * size].reshape(n, size)
        number = np.arange(n) + start // UNIT
        pts = number.astype(np.int64) * STEP & (1 << 33) - 1
        length = size + PES_HEAD - 6
        x[:, head[:9]] = np.array([0, 0, 1, PRIVATE_STREAM, length >> 8, length & 255, 0x84, 0x80, 5], np.uint8)
        x[:, head[9:]] = stamp(pts)
        x[:, 5] |= np.where(number % ACCESS == 0, 0x40, 0).astype(np.uint8)
        clock = np.stack([pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, pts * 0], -1)
        x[:, 6:12] = clock
        per = x.shape[1] // PACKET
        count = (counter + np.arange(n * per)) & 15
        packets = x.reshape(-1, PACKET)
        packets[:, 3] |= count.astype(np.uint8)
        counter += n * per
        out.append(packets.tobytes())
    return b"".join(out)


def parse_section(packet: np.ndarray, table: int) -> bytes:
    """The body of the section in a packet."""
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[min(at, PACKET - 1)]
    length = int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF
    whole = raw[at : at + 3 + length]
    if whole[0] != table or crc32_mpeg(whole):
        raise ValueError("not the table that is expected here, or damaged")
    return whole[8:-4]


def first_of(packets: np.ndarray, pid: np.ndarray, wanted: int) -> np.ndarray:
    found = np.flatnonzero(pid == wanted)
    if not len(found):
        raise ValueError(f"no packet of PID {wanted}")
    return packets[found[0]]


def read(media: bytes) -> dict:
    """Payload, timestamps, random-access points and counts of a transport stream; raises ValueError if it is damaged."""
    if len(media) % PACKET or not media:
        raise ValueError("not whole packets")
    x = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (x[:, 0] != SYNC).any() or (x[:, 1] & 0x80).any():
        raise ValueError("sync byte or error bit")
    pid = (x[:, 1].astype(np.int32) & 0x1F) << 8 | x[:, 2]
    pat = parse_section(first_of(x, pid, PAT_PID), 0)
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(pat), 4)}
    program, map_pid = next(((n, p) for n, p in programs.items() if n), (0, -1))
    pmt = parse_section(first_of(x, pid, map_pid), 2)
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    if len(pmt) < at + 5:
        raise ValueError("the program has no stream")
    kind, stream = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    own = x[pid == stream]
    if not len(own) or not own[0, 1] & 0x40:
        raise ValueError("the stream has no packets or doesn't open with a start")
    with_data = (own[:, 3] & 0x10) > 0
    jumps = int((np.diff((own[with_data, 3] & 15).astype(np.int16)) % 16 != 1).sum())
    has_field = (own[:, 3] & 0x20) > 0
    begin = np.where(has_field, 5 + own[:, 4].astype(np.int32), 4)
    begin[~with_data] = PACKET
    flags = np.where(has_field & (own[:, 4] > 0), own[:, 5], 0)
    opens = (own[:, 1] & 0x40) > 0
    body = own[np.arange(PACKET) >= begin[:, None]]
    edge = np.r_[0, np.cumsum(PACKET - begin)]
    starts = edge[:-1][opens]
    ends = np.r_[starts[1:], edge[-1]]
    if (starts + PES_HEAD > len(body)).any():
        raise ValueError("an elementary packet without its header")
    heads = body[starts[:, None] + np.arange(PES_HEAD)].astype(np.int64)
    if jumps or (heads[:, :3] != (0, 0, 1)).any() or (heads[:, 4] << 8 | heads[:, 5] != ends - starts - 6).any():
        raise ValueError("lost packets or a broken elementary packet")
    pts = (heads[:, 9] >> 1 & 7) << 30 | heads[:, 10] << 22 | heads[:, 11] >> 1 << 15 | heads[:, 12] << 7 | heads[:, 13] >> 1
    keep = np.ones(len(body), bool)
    for k in range(int(heads[:, 8].max()) + 9):
        keep[starts[heads[:, 8] + 9 > k] + k] = False
    return {"payload": body[keep].tobytes(), "pts": pts, "access": np.flatnonzero(flags[opens] & 0x40), "program": program, "type": int(kind), "pid": stream, "packets": len(x), "jumps": jumps}


def padded(data: bytes) -> bytes:
    return data.ljust(max(ALIGN, -(-len(data) // ALIGN) * ALIGN), b"\0")


def store(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with ``n_bytes`` and the ``media`` column, a transport stream of each text (null: empty). One row per input row, so repeated rows repeat."""
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.raw(batch.column(0))
            for a, b in tx.slices(data, at):
                media = [write(padded(data[i:j].tobytes())) for i, j in zip(at[a:b], at[a + 1 : b + 1])]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[1:]], pa.array(np.diff(at[a : b + 1])), pa.array(media, pa.binary())], names=[*batch.schema.names[1:], "n_bytes", "media"])

    return bounded(docs).select(F.col("text").cast("string").alias("__text"), *keep).mapInArrow(run, StructType([*[docs.schema[c] for c in keep], StructField("n_bytes", LongType()), StructField("media", BinaryType())]))


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, timestamps array<long>, access_points array<long>, error string"


def inspect(stored: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of a table with a ``media`` column, with what reading each stream back gives: digests, timestamps and random-access points.

    ``feature`` joins program, stream type and PID, packets, units, access points, last timestamp in seconds, and mean and entropy of
    the payload's bytes. A null stream gives nulls, a damaged one nulls and its ``error``. One row per input row, so repeated rows repeat; an empty table gives an empty one.
    """
    from pyspark.sql.types import StructType

    names = [c.split()[0] for c in READ.split(", ")]

    def row(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(names)
        try:
            r = read(media)
        except ValueError as e:
            return (*(None,) * (len(names) - 1), str(e))
        p = r["payload"]
        share = np.bincount(np.frombuffer(p, np.uint8), minlength=256) / len(p)
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
        feature = f"program={r['program']};type={r['type']};pid={r['pid']};packets={r['packets']};units={len(r['pts'])};access={len(r['access'])};seconds={r['pts'][-1] / CLOCK:.2f};mean={share @ np.arange(256):.3f};entropy={entropy:.4f}"
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(r["pts"]), r["pts"], r["access"], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            cols = list(zip(*(row(m.as_py()) for m in batch.column(0)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*batch.schema.names[1:], *names])

    schema = StructType([*[stored.schema[c] for c in keep], *StructType.fromDDL(READ).fields])
    return stored.select(F.col("media").alias("__media"), *keep).mapInArrow(run, schema)
