"""WARC archives: writing with revisit records, and reading by verified boundary chains.

Reading: every task splits its byte range at the record magic and emits, for each candidate record, its offset and the offset where
its successor must begin (header, Content-Length and the closing blank lines). Pointer jumping from offset 0 of each file keeps only the
candidates that the chain reaches, so the magic inside a payload is never taken for a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.llm.shared import cut, fresh_path

# Fixed values of the format.
MAGIC, BREAK, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID = "urn:sylvan:page:"
#: Records in a file at most, and rows of repeated payloads or odd segments up to which they are broadcast (about 100 bytes a row).
PER_FILE, FEW = 20_000, 20_000


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32."""
    hexed, out = F.sha1(payload), []
    for part in range(4):
        n = F.conv(F.substring(hexed, part * 10 + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*out)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``(record string)``.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response, the others are revisits; smaller ones are
    all responses. A null html is empty, a null url is about:blank; line breaks, tabs, blanks and NUL in a url are written as %XX. Rows
    that repeat the response's page_id are responses too; a null page_id is never the response of others.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("about:blank")).alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("same"), F.octet_length(body).cast("long").alias("size"))
    # Only payloads that stand more than once matter here; while they are few they go to the pages, not the pages to them.
    firsts = cut(rows.groupBy(F.col("same").alias("f_same")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    joined = rows.join(F.broadcast(firsts) if firsts.count() <= FEW else firsts, F.col("same") == F.col("f_same"), "left")
    revisit = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.col("url")
    for code in (0x00, 0x09, 0x0A, 0x0D, 0x20):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = [
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("html").cast("binary")), F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    ]
    return joined.select(F.concat(*head).alias("record"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes uncompressed archives: Spark's text sink with the records' closing blank lines as separator."""
    records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).text(path)


def field(head: Column, name: str) -> Column:
    """A header field's value, or null."""
    got = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)\r\n", 1)
    return F.when(got != "", got)


def with_header(rows: DataFrame) -> DataFrame:
    """Rows with ``value``, the text after a magic -> also ``head``, ``head_bytes``, ``length``."""
    at = F.instr("value", END)
    rows = rows.withColumn("head", F.when(at > 0, F.substring(F.col("value"), F.lit(1), at + 3)))
    return rows.withColumn("head_bytes", F.octet_length("head").cast("long")).withColumn("length", field(F.col("head"), "Content-Length").try_cast("long"))


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]


def with_fields(rows: DataFrame) -> DataFrame:
    """Rows with header columns and the whole record (or null) in ``value`` -> also the record's fields, read from its bytes."""
    block = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + 1).cast("int"), F.col("length").cast("int"))
    rows = rows.withColumn("body", block)
    blank = F.instr(F.col("body").cast("string"), END)
    rows = rows.withColumn("http", F.substring(F.col("body").cast("string"), F.lit(1), blank + 3)).withColumn("payload", F.expr("substring(body, octet_length(http) + 1)"))
    kind = field(F.col("head"), "WARC-Type")
    page = lambda name: F.regexp_extract(field(F.col("head"), name), rf"^<{ID}(-?\d+)>$", 1).try_cast("long")
    full = kind == "response"
    return rows.withColumns({
        "page_id": page("WARC-Record-ID"),
        "payload_bytes": F.when(full, F.octet_length("payload").cast("long")).otherwise(field(F.col("http"), "Content-Length").try_cast("long")),
        "payload_digest": F.when(full, base32_sha1(F.col("payload"))).otherwise(F.regexp_extract(F.col("head"), r"WARC-Payload-Digest: sha1:([A-Z2-7]+)", 1)),
        "record_type": kind,
        "refers_to": page("WARC-Refers-To"),
        "url": field(F.col("head"), "WARC-Target-URI"),
    })


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives' bytes between magics, with their place: file, byte range of the task, and order in it."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")


def offsets(segs: DataFrame) -> DataFrame:
    """Segments with ``size`` -> also ``at``, the byte at which the magic before the segment begins (null before the first), and ``end``, the file's size."""
    w = Window.partitionBy("file").orderBy("block", "nth")
    size = F.sum(F.col("size") + len(MAGIC))
    return segs.withColumn("at", size.over(w.rowsBetween(Window.unboundedPreceding, -1)) - len(MAGIC)).withColumn("end", size.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - len(MAGIC))


def reached(candidates: DataFrame) -> DataFrame:
    """``(file, at, next)`` -> the ``(file, at)`` on the chain from offset 0 of each file, by pointer jumping: after k rounds a jump spans 2^k records."""
    jump = candidates.select("file", "at", "next")
    found = cut(candidates.where("at = 0").select("file", "at"), "reached")
    seen = found.count()
    while True:
        ahead = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        step = found.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        step = step.join(candidates.select("file", "at"), ["file", "at"], "left_semi")
        found = cut(found.unionByName(step).distinct(), "reached")
        if (now := found.count()) == seen:
            return found
        seen = now
        jump = cut(jump.join(ahead, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jumps")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archives under ``path`` -> ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)``, one row per record.

    Digests and sizes of responses are those of the bytes read. Raises if a file's chain doesn't end at the file's end. No file gives no row.
    """
    rows = with_header(segments(spark, path)).withColumn("size", F.octet_length("value").cast("long"))
    rows = rows.withColumn("whole", F.coalesce(F.col("size") == F.col("head_bytes") + F.col("length") + len(END), F.lit(False)))
    rows = with_fields(rows.withColumn("value", F.when(F.col("whole"), F.col("value"))))
    segs = cut(rows.select("file", "block", "nth", "size", "whole", "head_bytes", "length", *FIELDS), "segments")
    placed = offsets(segs).withColumn("next", F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END))
    placed = cut(placed, "placed")
    candidates = placed.where("at is not null and next is not null and next > at and next <= end")
    chain = reached(candidates)
    kept = placed.join(chain, ["file", "at"])
    last = kept.groupBy("file").agg(F.max("next").alias("next"), F.first("end").alias("end"))
    ends = placed.groupBy("file").agg(F.max("end").alias("size_")).where("size_ > 0").join(last, "file", "left").where("next is null or next <> size_")
    if not ends.isEmpty():
        raise ValueError("an archive's record chain doesn't end at the file's end")
    out = kept.where("whole").select(*FIELDS)
    odd = kept.where("not whole").select("file", F.col("at").alias("start"), F.col("next").alias("stop"))
    if not odd.isEmpty():
        out = out.unionByName(reassembled(spark, path, odd).select(*FIELDS))
    return out


def reassembled(spark: SparkSession, path: str, odd: DataFrame) -> DataFrame:
    """Records ``odd(file, start, stop)`` whose payload holds the magic: their files are read again, placed anew by byte offset, and the segments of each record joined in order.

    Raises unless every record comes back with all of its bytes."""
    odd = cut(odd, "odd")
    files = odd.select("file").distinct()
    texts = segments(spark, path).join(F.broadcast(files) if files.count() <= FEW else files, "file", "left_semi")
    placed = offsets(texts.withColumn("size", F.octet_length("value").cast("long")))
    w = Window.partitionBy("file").orderBy("at")
    marked = placed.join(odd.withColumn("at", F.col("start")), ["file", "at"], "left").withColumn("start", F.last("start", True).over(w)).withColumn("stop", F.last("stop", True).over(w))
    inside = marked.where("at >= start and at < stop").groupBy("file", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = cut(inside.select("start", "stop", F.array_join(F.col("parts.value"), MAGIC).alias("value")), "reassembled")
    if whole.where(F.octet_length("value") + len(MAGIC) != F.col("stop") - F.col("start")).count() or whole.count() != odd.count():
        raise ValueError("a record came back without some of its bytes")
    return with_fields(with_header(whole))
