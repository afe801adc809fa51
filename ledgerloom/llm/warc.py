"""WARC (operator 8): archives written from and read into a chunked record table.

A payload becomes rows (record, chunk number) of at most ``CHUNK`` bytes. Each row is one WARC record of its
own: the first of type ``response``, the others ``continuation`` records as the standard's segmentation
has them, so neither writing nor reading ever holds a record larger than a chunk. Of equal payloads
(SHA-256) the smallest page id is the ``response``; the others are ``revisit`` records without
payload that refer to it. Spark's text writer puts the rows into gzip files, its text
reader cuts them again at the record boundary; a chunk that would contain that boundary is cut inside it.

Reading checks each record's length and SHA-1 against its header. Records of one chunk are checked where they are read;
the chunks of larger ones are brought together by record, sorted by number, and streamed through an incremental digest.

A null payload is empty. A null page id never is the smallest one, unless a payload has no other. Rows
that repeat a page id and its payload are responses both.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import stage
from ledgerloom.session import new_path

CHUNK = 1 << 16
HELD = 1 << 22  # bytes of chunks that leave a task at a time
DIGESTED = 1 << 20
FEW_IDS = 1 << 20  # revisits up to this many are sent to every task
VERSION = "WARC/1.1\r\n"
BOUNDARY = "\r\n\r\n" + VERSION
def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _cuts(data: memoryview, chunk: int) -> list[int]:
    """Where chunks end: after ``chunk`` bytes or up to three less, between characters, and inside each record boundary that would stand in,
    or start, a chunk."""
    first_line = VERSION.strip().encode()  # what ends a record completes it
    ends, at = [], 0
    while at < len(data):
        end = min(at + chunk, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        held = bytes(data[at:end])
        found = held.find(first_line)
        while found >= 0:
            if held[max(found - 4, 0) : found] in (b"", b"\r\n", b"\r\n\r\n"):
                ends.append(at + found + 2)
            found = held.find(first_line, found + 1)
        ends.append(end)
        at = end
    return ends or [0]


def _chunk_rows(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk. A payload is read twice where it lies, once for its digest and once for its chunks, and never copied whole."""
    kept = ["record", "page_id", "url", "record_type", "refers_to", "date"]
    names = [*kept, "payload_bytes", "payload_digest", "chunks", "chunk_no", "chunk"]
    for batch in batches:
        facts = batch.select(kept)
        rows: list[int] = []
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sizes, digests, counts, numbers, chunks = zip(*out, strict=True)
            columns = [*facts.take(pa.array(rows)).columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(counts, pa.int32()), pa.array(numbers, pa.int32())]
            made = pa.RecordBatch.from_arrays([*columns, pa.array(chunks, pa.binary()).view(pa.string())], names)
            rows.clear()
            out.clear()
            return made

        payloads, again = batch.column("payload").cast(pa.large_binary()), batch.column("refers_to").is_valid().to_pylist()
        for i, payload in enumerate(payloads):
            data = memoryview(payload.as_buffer())
            digest = hashlib.sha1()
            for at in range(0, len(data), DIGESTED):
                digest.update(data[at : at + DIGESTED])
            code = base64.b32encode(digest.digest()).decode()
            ends = [0] if again[i] else _cuts(data, chunk)
            at = 0
            for number, end in enumerate(ends):
                rows.append(i)
                out.append((len(data), code, len(ends), number, bytes(data[at:end])))
                held, at = held + end - at, end
                if held > HELD:
                    yield flush()
                    held = 0
        if out:
            yield flush()


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """The chunked record table: one row per record and chunk, with its headers' values."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    facts = stage(rows.select("page_id", "key"), "warc-keys")
    firsts = facts.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stage(firsts.select("key", "first"), "warc-firsts")
    again = facts.join(firsts, "key").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    again = stage(again.select(F.col("page_id").alias("_id"), F.col("key").alias("_key"), "first").distinct(), "warc-revisits")
    small = again.count() <= FEW_IDS
    joined = rows.join(F.broadcast(again) if small else again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    # Before the chunks are spread: the number tells rows apart, and a record's chunks share it.
    page = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).cast("binary"))
    joined = joined.withColumn("record", F.concat(page, F.lit("-"), F.monotonically_increasing_id()))
    joined = joined.withColumn("record_type", F.when(F.col("first").isNull(), "response").otherwise("revisit"))
    kept = joined.select("record", "page_id", "url", "record_type", F.col("first").alias("refers_to"), F.lit(date).alias("date"), "payload")
    schema = "record string, page_id long, url string, record_type string, refers_to long, date string, payload_bytes long, payload_digest string, chunks int, chunk_no int, chunk string"
    size = CHUNK
    return kept.mapInArrow(lambda it: _chunk_rows(it, size), schema)


def _line(name: str, value: Column, when: Column | None = None) -> Column:
    line = F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " "))
    line = F.concat(line, F.lit("\r\n"))
    return line if when is None else F.when(when, line).otherwise("")


def write(table: DataFrame, path: str) -> str:
    """The record table as gzip files of WARC records."""
    later = F.col("chunk_no") > 0
    urn = F.concat(F.lit("<urn:record:"), F.col("record"))
    kind = F.when(later, "continuation").otherwise(F.col("record_type"))
    head = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(urn, F.lit("/"), F.col("chunk_no"), F.lit(">"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Payload-Length", F.col("payload_bytes")),
        _line("WARC-Page-ID", F.col("page_id"), F.col("page_id").isNotNull()),
        _line("WARC-Refers-To-Page-ID", F.col("refers_to"), F.col("refers_to").isNotNull()),
        _line("WARC-Segment-Number", F.col("chunk_no") + 1),
        _line("WARC-Segment-Count", F.col("chunks")),
        _line("WARC-Segment-Origin-ID", F.concat(urn, F.lit("/0>")), later),
        _line("WARC-Segment-Total-Length", F.col("payload_bytes"), later & (F.col("chunk_no") + 1 == F.col("chunks"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.octet_length("chunk"),
    )
    text = F.concat(head, F.lit("\r\n\r\n"), F.col("chunk"), F.lit("\r\n\r"))
    out = table.select(text.alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.option("lineSep", "\n").text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table out of archives. A record whose length differs from its header stops the job."""
    raw = spark.read.option("lineSep", BOUNDARY).text(path)
    # Only the first record of a file still has its first line.
    text = F.when(F.startswith("value", F.lit(VERSION)), F.col("value").substr(F.lit(len(VERSION) + 1), F.char_length("value")))
    text = text.otherwise(F.col("value"))
    split = F.instr("text", "\r\n\r\n")
    rows = raw.select(text.alias("text")).withColumn("cut", split)
    rows = rows.select(F.col("text").substr(F.lit(1), F.col("cut") - 1).alias("head"), F.col("text").substr(F.col("cut") + 4, F.char_length("text")).alias("rest"))

    def value(name: str) -> Column:
        return F.regexp_extract("head", rf"(?:\A|\r\n){name}: ([^\r\n]*)", 1)

    rows = rows.select(
        F.regexp_extract("head", r"(?:\A|\r\n)WARC-Record-ID: <urn:record:([^/]*)/", 1).alias("record"),
        (value("WARC-Segment-Number").cast("int") - 1).alias("chunk_no"), value("WARC-Segment-Count").cast("int").alias("chunks"),
        value("WARC-Type").alias("kind"), value("WARC-Target-URI").alias("url"),
        F.regexp_replace(value("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        value("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        F.nullif(value("WARC-Page-ID"), F.lit("")).cast("long").alias("page_id"),
        F.nullif(value("WARC-Refers-To-Page-ID"), F.lit("")).cast("long").alias("refers_to"),
        value("Content-Length").cast("int").alias("length"), "rest",
    )
    # The last record of a file still has its end; nothing else may follow the declared length.
    body = F.substring(F.col("rest").cast("binary"), F.lit(1), F.col("length"))
    extra = F.octet_length("rest") - F.col("length")
    whole = F.when(extra.isin(0, 2, 4), body).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record"))))
    return rows.select("record", "chunk_no", "chunks", "kind", "url", "payload_digest", "payload_bytes", "page_id", "refers_to", whole.alias("chunk"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and SHA-1 of each record from its chunks in order; only a digest is carried from chunk to chunk."""
    record, digest, size = None, hashlib.sha1(), 0
    for batch in batches:
        out: list[tuple] = []
        for name, no, chunks, chunk in zip(*(batch.column(c) for c in ("record", "chunk_no", "chunks", "chunk")), strict=True):
            if name.as_py() != record:
                record, digest, size = name.as_py(), hashlib.sha1(), 0
            digest.update(chunk.as_buffer())
            size += len(chunk.as_buffer())
            if no.as_py() + 1 == chunks.as_py():
                out.append((record, size, base64.b32encode(digest.digest()).decode()))
        names, sizes, digests = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["record", "seen_bytes", "seen_digest"])


def payloads(table: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, checked against its chunks."""
    facts = ["record", "page_id", "payload_bytes", "payload_digest", "refers_to"]
    single = table.where("chunks = 1").withColumns({
        "seen_bytes": F.when(F.col("kind") == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("chunk").cast("long")),
        "seen_digest": F.when(F.col("kind") == "revisit", F.col("payload_digest")).otherwise(base32_sha1(F.col("chunk"))),
    }).select(*facts, F.col("kind").alias("record_type"), "seen_bytes", "seen_digest")
    several = table.where("chunks > 1")
    parts = several.select("record", "chunk_no", "chunks", "chunk").repartition("record").sortWithinPartitions("record", "chunk_no")
    seen = parts.mapInArrow(_digests, "record string, seen_bytes long, seen_digest string")
    heads = several.where("chunk_no = 0").select(*facts, F.col("kind").alias("record_type"))
    rows = single.unionByName(heads.join(seen, "record", "left"))
    good = F.col("seen_bytes").eqNullSafe(F.col("payload_bytes")) & F.col("seen_digest").eqNullSafe(F.col("payload_digest"))
    digest = F.when(good, F.col("seen_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs in record "), F.col("record"))))
    return rows.select("page_id", F.col("seen_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives of ``pages``, read them back, and return what they hold."""
    spark = pages.sparkSession
    path = write(records(pages, id_col, url_col, payload_col), new_path(spark, "warc"))
    return payloads(read(spark, path))
