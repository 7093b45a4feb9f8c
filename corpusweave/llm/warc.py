"""WARC archives: writing, and reading with a verified chain of record boundaries.

Archives are written by Spark's text writer (its committer keeps retried tasks from leaving halves), one record per row, gzip-compressed as a
file. They are read by Spark's text reader with the sign ``WARC/1.`` as line separator, so files of any store, compressed or
not, are read in splits. What follows each sign is a fragment, and may or may not start a record: payloads can hold the sign.

Boundary chain: tasks emit for each fragment that parses as a record's head the offset of its start and that of its successor. Offsets count
from the start of the split; the splits' lengths, one row per split, turn them into file offsets. Within a split the pointers are
followed to where they leave it, and pointer jumping over these exits, from the start of each file, finds where the true chain
enters each split. Only records on that chain are kept; heads inside payloads aren't on it. A record cut into several fragments by signs in its payload is put
together from them, also over splits.

Null payloads are written as empty. A file that doesn't start with a record yields none; nothing after a broken link of the chain is returned, and
a record cut off by its file's end is not one. Empty tables give an archive without records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.session import cut, new_table_path

SIGN = "WARC/1."
#: Smallest payload for which a revisit record is written instead of the payload.
REVISIT_FROM = 100
MAX_JUMPS = 64
FIXED_DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = re.compile(rb"^content-length[ \t]*:[ \t]*([0-9]{1,18})[ \t]*\r?$", re.I | re.M)


# ---- writing

def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, digest, first: the smallest page_id with this payload, null where that is the page itself or the payload is
    short. The payload travels with its row once; the other side of the join has one row per payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    seen = rows.filter(F.col("bytes") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = seen.filter("n > 1").drop("n")
    return rows.join(repeated, "digest", "left").withColumn("first", F.when(F.col("first") != F.col("page_id"), F.col("first")))


def records(rows: DataFrame) -> DataFrame:
    """The bytes of one WARC record per row, without the line break that ends it. Every record carries the digest and length of the full payload."""
    revisit = F.col("first").isNotNull()
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))

    def line(name: str, *value) -> Column:
        return F.concat(F.lit(f"{name}: "), *[v if not isinstance(v, str) else F.lit(v) for v in value], F.lit("\r\n"))

    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit(f"{SIGN}1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", "<urn:page:", F.coalesce(F.col("page_id").cast("string"), F.lit("")), ">"), line("WARC-Date", FIXED_DATE),
        F.when(url != "", line("WARC-Target-URI", url)).otherwise(""), line("WARC-Payload-Digest", "sha256:", F.col("digest")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", PROFILE), line("WARC-Refers-To", "<urn:page:", F.col("first").cast("string"), ">"))).otherwise(""),
        line("Content-Type", "text/html; charset=utf-8"), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"))
    # the writer puts a string's bytes out as they are, and the line separator after them
    return rows.select(F.concat(head.cast("binary"), body, F.lit(b"\r\n")).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    records(with_revisits(pages)).write.option("lineSep", "\r\n").option("compression", compression).text(path)


# ---- reading

FRAGMENT = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("head", pa.string()),
    ("payload_bytes", pa.int64()), ("digest", pa.string()), ("content", pa.binary()),
])
KINDS = "file string, block long, at long, size long, next long, head string, payload_bytes long, digest string, content binary"


def _parse(raw: bytes) -> tuple[int, int, str] | None:
    """Length of the head, of the payload, and the head of a fragment, if it may start a record."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"[01]\r\n", raw):
        return None
    length = LENGTH.search(raw, 0, end + 2)
    return (end + 4, int(length[1]), raw[3:end].decode("utf-8", "replace")) if length else None


def fragments(spark: SparkSession, path: str, wanted: bytes | None = None) -> DataFrame:
    """One row per fragment: ``at`` and ``size``, its place among the bytes of its split, each with the sign that ends it; ``next``: where the record
    ends if it is one, counted alike; ``digest`` of the payload if the fragment holds it all. With ``wanted``, a filter of places (see ``places``), those
    fragments have their content and others are left out."""
    sign = len(SIGN)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            columns, rows = [batch.column(name) for name in ("file", "block", "value")], []
            for i in range(batch.num_rows):
                file, block, raw = (c[i].as_py() for c in columns)
                first = (file, block) != split
                if first:
                    split, at = (file, block), 0
                if wanted is not None:
                    if holds(wanted, file, block, at):
                        rows.append((file, block, at, len(raw) + sign, None, None, None, None, raw))
                else:
                    found = None if first and block == 0 else _parse(raw)  # no sign stands before a file's first fragment
                    body, payload_bytes, head = found or (None, None, None)
                    whole = found and body + payload_bytes + 4 <= len(raw)
                    digest = hashlib.sha256(memoryview(raw)[body:body + payload_bytes]).hexdigest() if whole else None
                    rows.append((file, block, at, len(raw) + sign, at + body + payload_bytes + 4 if found else None, head, payload_bytes, digest, None))
                at += len(raw) + sign
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FRAGMENT, strict=True)], schema=FRAGMENT)

    lines = spark.read.option("lineSep", SIGN).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(work, KINDS)


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Inside one split: for each candidate, where its chain leaves the split, and the last record before that; a chain that breaks leaves nowhere."""
    rows = rows.sort_values("start", kind="stable")
    starts, after, end = rows["start"].tolist(), rows["next"].tolist(), int(rows["high"].iloc[0])
    ways: dict[int, tuple[int, int]] = {}
    for start, to in zip(reversed(starts), reversed(after), strict=True):  # pointers only go forward
        if to >= end:
            ways[start] = (to, start)
        elif to in ways:
            ways[start] = ways[to]
    out = [(rows["file"].iloc[0], start, *way) for start, way in ways.items()]
    return pd.DataFrame(out, columns=["file", "start", "leaves", "last"])


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Inside one split, along the chain from where it enters: the record that each fragment is part of, if any."""
    rows = rows.sort_values("start", kind="stable")
    entry, owner, until = (None if pd.isna(x := rows[c].iloc[0]) else int(x) for c in ("entry", "owner", "until"))
    records = []
    for start, to in zip(rows["start"].tolist(), rows["next"].tolist(), strict=True):
        if start == entry and not pd.isna(to):
            owner, until, entry = start, int(to), int(to)
        records.append(owner if owner is not None and start < until else None)
    return rows[["file", "block", "at", "start", "next"]].assign(record=pd.array(records, "Int64"))


def chain(found: DataFrame) -> DataFrame:
    """file, block, at, start, next (offsets in the file; next is null for what can't be a record), record: the start of the record on the verified chain
    that a fragment belongs to, null for none."""
    by_file = Window.partitionBy("file")  # rows of splits and of chain entries: as many as a file has splits
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("size"))
    base = F.coalesce(F.sum("size").over(by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a fragment starts with the sign before it, so a split's fragments start in [low, high)
    splits = cut(sizes.withColumn("low", base - len(SIGN)).select("file", "block", "low", (F.col("low") + F.col("size")).alias("high")))
    placed = found.join(splits, ["file", "block"]).select(
        "file", "block", "at", (F.col("at") + F.col("low")).alias("start"), (F.col("next") + F.col("low") + len(SIGN)).alias("next"), "high")
    exits = cut(placed.filter("next IS NOT NULL").groupBy("file", "block").applyInPandas(_exits, "file string, start long, leaves long, last long"))
    ends = splits.groupBy("file").agg(F.max("high").alias("end"))

    entries = cut(splits.filter("block = 0").select("file", F.lit(0).cast("long").alias("start")))
    targets = exits.select("file", F.col("leaves").alias("start")).union(entries).distinct()
    jumps = exits.join(targets, ["file", "start"], "left_semi").select("file", "start", "leaves")
    for _ in range(MAX_JUMPS):  # after k rounds: entries within 2^k splits of the file's start, pointers over 2^k splits
        jumps = cut(jumps)
        if jumps.isEmpty():
            break
        reached = entries.join(jumps, ["file", "start"]).select("file", F.col("leaves").alias("start"))
        entries = cut(entries.union(reached).distinct())
        ahead = jumps.select("file", F.col("start").alias("leaves"), F.col("leaves").alias("further"))
        jumps = jumps.join(ahead, ["file", "leaves"]).select("file", "start", F.col("further").alias("leaves"))

    # records that cross from one split into others; one that would reach over the file's end is cut off, and none
    crossing = entries.join(exits, ["file", "start"]).join(ends, "file").filter("leaves <= end").select("file", F.col("last").alias("owner"), F.col("leaves").alias("until"))
    cut_off = entries.join(exits, ["file", "start"]).join(ends, "file").filter("leaves > end").select("file", F.col("last").alias("record"))
    events = splits.select("file", F.col("low").alias("pos"), F.lit(1).alias("kind"), "block", F.lit(None).cast("long").alias("owner"), F.lit(None).cast("long").alias("until"))
    events = events.union(crossing.select("file", "owner", F.lit(0), F.lit(None).cast("long"), "owner", "until"))
    events = events.union(entries.select("file", "start", F.lit(2), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")))
    so_far = by_file.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = cut(events.select("file", "pos", "kind", F.last("block", True).over(so_far).alias("block"), F.last("owner", True).over(so_far).alias("owner"),
                             F.last("until", True).over(so_far).alias("until")))
    enters = seen.filter("kind = 2").groupBy("file", "block").agg(F.min("pos").alias("entry"))
    reaching = seen.filter("kind = 1 AND until > pos").select("file", "block", "owner", "until")
    given = placed.join(enters, ["file", "block"], "left").join(reaching, ["file", "block"], "left")
    walked = given.groupBy("file", "block").applyInPandas(_walk, "file string, block long, at long, start long, next long, record long")
    return walked.join(cut_off, ["file", "record"], "left_anti")


# ---- a filter of places, of fixed size: what a task must look at more closely

FILTER_BITS = 1 << 20


def _place(file, block, at) -> str:
    return f"{file}|{block}|{at}"


def holds(bits: bytes, file: str, block: int, at: int) -> bool:
    bit = xxhash.xxh64_intdigest(_place(file, block, at).encode(), 42) % FILTER_BITS
    return bool(bits[bit >> 3] >> (bit & 7) & 1)


def places(rows: DataFrame) -> bytes:
    """A bitmap of ``FILTER_BITS`` over the hashes of file, block and at: at most that many small rows come to the driver."""
    hashed = F.xxhash64(F.concat_ws("|", "file", F.col("block").cast("string"), F.col("at").cast("string")))
    bits = bytearray(FILTER_BITS // 8)
    for (bit,) in rows.select(hashed.bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")).distinct().collect():
        bits[bit >> 3] |= 1 << (bit & 7)
    return bytes(bits)


def index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of the archives under ``path``: file, start, next, head (header lines), payload_bytes, digest (SHA-256 of the payload, null
    if it lies in several fragments). And the fragments that records are made of, for ``payloads``."""
    table = new_table_path(spark, "warc-fragments")
    fragments(spark, path).drop("content").write.parquet(table)
    found = spark.read.parquet(table)
    parts = cut(chain(found).filter("record IS NOT NULL"))
    heads = parts.filter("start = record").drop("record")
    rows = found.drop("size", "next").join(heads, ["file", "block", "at"])
    return rows.select("file", "start", "next", "head", "payload_bytes", "digest"), parts


def payloads(spark: SparkSession, path: str, wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """file, start, payload of the records ``wanted[file, start]``, put together from their fragments; other texts aren't shuffled."""
    of = parts.join(wanted.select("file", F.col("start").alias("record")), ["file", "record"], "left_semi").select("file", "block", "at", "start", "record")
    of = cut(of)
    content = fragments(spark, path, places(of)).select("file", "block", "at", "content")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        raw = SIGN.encode().join(rows.sort_values("start")["content"])
        body, length, _ = _parse(raw)
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "start": [rows["record"].iloc[0]], "payload": [raw[body:body + length]]})

    return content.join(of, ["file", "block", "at"]).groupBy("file", "record").applyInPandas(join, "file string, start long, payload binary")


def _field(name: str, pattern: str = "(.*)") -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}[ \t]*:[ \t]*{pattern}[ \t]*\r?$", 1)
    return F.when(found != "", found)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that ``write_archives`` wrote, from the archives alone."""
    records_found, parts = index(spark, path)
    records_found = cut(records_found)
    split = records_found.filter("digest IS NULL")
    whole = payloads(spark, path, split, parts).select("file", "start", F.sha2("payload", 256).alias("joined"))
    found = records_found.join(whole, ["file", "start"], "left")
    revisit = F.lower(_field("WARC-Type")) == "revisit"
    return found.select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        F.when(revisit, _field("X-Payload-Length", "([0-9]+)").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, _field("WARC-Payload-Digest", "sha256:([0-9a-f]+)")).otherwise(F.coalesce("digest", "joined")).alias("payload_digest"),
        F.lower(_field("WARC-Type")).alias("record_type"), _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = new_table_path(spark, "warc")
    write_archives(pages, path)
    return read_back(spark, path)
