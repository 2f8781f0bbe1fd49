"""WARC archives: a native writer and a chunk-parallel reader with boundary-chain verification."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridrel.llm.common import new_path, shuffle_width, stash

MAGIC, GAP, END = b"WARC/1.", b"\r\n\r\n", "\r\n"
CHUNK = 8 << 20
#: Bytes read past a chunk at first, for a header that crosses its end.
HEAD = 64 << 10
#: Duplicate payload groups up to so many are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The RFC 4648 base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*(?=\r\n)", re.I)


def base32_of(digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal digits: eight groups of 20 bits."""
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", least: int = 0) -> None:
    """One record per row of pages (page_id, url, html), the html's UTF-8 bytes as HTTP payload.

    Of rows with equal payloads of at least `least` bytes those with the largest page_id are
    responses and the others revisits without payload; a null html is an empty payload, a null
    page_id counts as the smallest.  Rows that repeat the largest id are responses all.  Line
    breaks are removed from urls; a null url gives no target header.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.octet_length(payload).alias("size"), F.sha1(payload).alias("sha1"))
    rows = rows.withColumn("digest", base32_of(F.col("sha1"))).drop("sha1")
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    groups = stash(groups, "warc-groups")
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))

    def uid(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.0{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "), uid("page_id"), F.lit(f"{END}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{END}WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{END}WARC-Refers-To: "), uid("kept"))).otherwise(""),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "), length.cast("string"), F.lit(END + END),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", GAP.decode()).text(path)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    found, inner = fs.FileSystem.from_uri(path)
    return found.open_input_file(inner)


def _header(data: bytes, at: int) -> tuple[int, int] | None:
    """(end of the header, length of the block) of a record at `at`; None if it isn't one."""
    stop = data.find(GAP, at)
    if stop < 0 or not (m := _LENGTH.search(data, at, stop + 2)):
        return None
    return stop + len(GAP), int(m[1])


def candidates(data: bytes, start: int, end: int) -> dict[int, int]:
    """Offsets in [start, end) that look like records, each with its successor; data begins at start."""
    out, at = {}, data.find(MAGIC, 0, end - start + len(MAGIC) - 1)
    while at >= 0:
        if found := _header(data, at):
            out[start + at] = start + found[0] + found[1] + len(GAP)
        at = data.find(MAGIC, at + 1, end - start + len(MAGIC) - 1)
    return out


def _read(handle, start: int, end: int, size: int) -> bytes:
    """[start, end) and enough after it to complete a header that begins inside."""
    more = HEAD
    while True:
        data = handle.read_at(min(end + more, size) - start, start)
        last = data.rfind(MAGIC, 0, end - start + len(MAGIC) - 1)
        if end + more >= size or last < 0 or data.find(GAP, last) >= 0:
            return data
        more *= 4


CHAIN = "path string, off long, exit long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate of a chunk, where its chain leaves the chunk; broken chains are left out."""
    for batch in batches:
        for row in batch.to_pylist():
            end = min(row["start"] + row["chunk"], row["length"])
            with _open(row["path"]) as handle:
                nxt = candidates(_read(handle, row["start"], end, row["length"]), row["start"], end)
            leave: dict[int, int | None] = {}
            for off in sorted(nxt, reverse=True):
                to = nxt[off]
                leave[off] = to if to >= end else leave.get(to)
            offs = [o for o, to in leave.items() if to is not None]
            yield pa.RecordBatch.from_pydict({"path": [row["path"]] * len(offs), "off": offs, "exit": [leave[o] for o in offs]}, schema=pa.schema([("path", pa.string()), ("off", pa.int64()), ("exit", pa.int64())]))


RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
RECORD_DDL = "path string, offset long, headers map<string,string>, http_headers map<string,string>, payload binary"


def _fields(head: bytes) -> list[tuple[str, str]]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if colon:
            found[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    return list(found.items())


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses the chunk's reachable records one after another from its verified entry."""
    for batch in batches:
        for row in batch.to_pylist():
            at, end, size = row["off"], min(row["start"] + row["chunk"], row["length"]), row["length"]
            with _open(row["path"]) as handle:
                data, base = _read(handle, at, end, size), at
                rows: list[dict] = []
                held = 0
                while at < end:
                    found = _header(data, at - base) if data.startswith(MAGIC, at - base) else None
                    if not found:
                        break
                    body, length = found
                    block = data[body : body + length]
                    if len(block) < length:
                        block += handle.read_at(length - len(block), base + len(data))
                    if len(block) < length:
                        break
                    head, http, payload = data[at - base : body - len(GAP)], b"", block
                    fields = _fields(head)
                    if dict(fields).get("content-type", "").startswith("application/http") and GAP in block:
                        http, _, payload = block.partition(GAP)
                    rows.append({"path": row["path"], "offset": at, "headers": fields, "http_headers": _fields(http), "payload": payload})
                    held += len(payload)
                    at = base + body + length + len(GAP)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Records of uncompressed archives: path, offset, headers, http_headers (keys in lower case), payload.

    Tasks read chunks and emit every offset with the magic and a header of known length together
    with where its successor chain leaves the chunk.  Pointer jumping from offset 0 of each file
    doubles the distance in every round, so a file of n chunks takes log2(n) rounds; only chunks'
    entries that are reached that way are parsed.  Magic inside payloads is never reached.  A
    record cut off at the end of a file, and what follows a broken record, is left out.  Files
    without records, and empty files, give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start")).withColumn("chunk", F.lit(chunk).cast("long"))
    chunks = stash(chunks.repartition(shuffle_width(spark), "path", "start"), "warc-chunks")
    jumps = stash(chunks.repartition(shuffle_width(spark), "path", "start").mapInArrow(_chain, CHAIN), "warc-chain")
    longest = chunks.groupBy("path").count().agg(F.max("count")).first()[0] or 1
    reached = chunks.where("start = 0").select("path", F.lit(0).cast("long").alias("off"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = reached.join(jumps, ["path", "off"]).select("path", F.col("exit").alias("off"))
        reached = stash(reached.union(further).distinct(), "warc-reached")
        two = jumps.alias("a").join(jumps.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.exit") == F.col("b.off")), "left")
        jumps = stash(two.select("a.path", "a.off", F.coalesce("b.exit", "a.exit").alias("exit")), "warc-chain")
    entries = reached.withColumn("start", (F.floor(F.col("off") / chunk) * chunk).cast("long")).join(chunks, ["path", "start"])
    one = Window.partitionBy("path", "start").orderBy("off")
    entries = entries.withColumn("first", F.row_number().over(one)).where("first = 1").select("path", "off", "start", "length", "chunk")
    # few small rows that each stand for a chunk: dealt out one by one, else they would be merged into one task
    return entries.repartition(shuffle_width(spark)).mapInArrow(_records, RECORD_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in shared storage, reads them back, and describes each record.

    Per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to.  Nulls, empty
    payloads and repeated rows are as in write_warc(); other columns are not read.  No pages, no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    got = read_warc(spark, path)
    ident = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(.*)>", 1), F.lit("null")).cast("long")
    revisit = F.col("record_type") == "revisit"
    got = got.select(
        F.col("headers")["warc-type"].alias("record_type"), F.col("headers")["warc-record-id"].alias("id"), F.col("headers")["warc-refers-to"].alias("to"),
        F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha1:", "").alias("said"), F.col("http_headers")["content-length"].cast("long").alias("said_bytes"),
        F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"),
    )
    got = got.withColumn("digest", base32_of(F.col("sha1")))
    return got.select(
        ident("id").alias("page_id"), F.when(revisit, F.col("said_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("said")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", F.when(revisit, ident("to")).alias("refers_to"),
    )
