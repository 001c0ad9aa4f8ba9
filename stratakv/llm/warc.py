"""WARC archives: written by Spark's own writer, read back with boundary-chain verification.

Archives are plain WARC 1.1 files in the shared folder, cut by bytes: records go to archives by classes
of their size, so that no archive of several records exceeds ``archive_bytes`` by more than headers, and
a record beyond that size has an archive of its own. Reading holds one archive in a task at a time. A
payload above ``MAX_PAYLOAD`` does not fit a row of Spark's file reader and is refused with an error
before anything is written. A reader's tasks look at pieces of an
archive and emit, for every place that looks like a record header, the offset that its lengths lead
to. Within a piece these links are followed to the first offset beyond it; between pieces pointer
jumping from offset 0 doubles the distance each round. Only records on the chain from the start of
the file are kept, so a header inside a payload is never taken for a record. Headers longer than
``header_limit`` are read from their archive in slices that grow until they hold the header. An
archive whose chain does not lead to its end raises an error.

Defined cases: a null html is an empty payload; a null page_id is a record of its own that nothing
refers to; rows with the same page_id each give a row; line breaks in a url become spaces; an empty
table gives an empty result; extra columns are ignored. Payloads are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, written

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MAGIC = b"WARC/1."
BREAK = "\r\n\r\n"

#: A table of duplicate payloads up to this many rows (40 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of the largest payload: a task holds a few copies of it while it writes or reads it.
MAX_PAYLOAD = 256 << 20

RECORD = "path string, base long, off long, nxt long, start long, size long, kind string, page_id string, refers_to string, claimed string, digest string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits at a time through radix 32."""
    sha = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*pieces), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, records_per_archive: int = 2000, archive_bytes: int = 64 << 20, date: str = "2026-01-01T00:00:00Z") -> None:
    """One record per page. Of equal payloads of at least ``min_bytes``, the one with the largest page_id is a response and the others revisit it.

    An archive has at most ``records_per_archive`` records.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", " "), F.lit("")).alias("url"), html.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "bytes": F.octet_length("payload").cast("long") + F.octet_length("url")})
    # Size classes: so many records of a class as fit an archive.
    bounds = [max(1, archive_bytes // records_per_archive)]
    while bounds[-1] < archive_bytes:
        bounds.append(min(archive_bytes, bounds[-1] * 16))
    found = rows.agg(F.max("size").alias("most"), *[F.count_if((F.col("bytes") > low) & (F.col("bytes") <= high)).alias(f"n{k}") for k, (low, high) in enumerate(_ranges(bounds))]).first()
    if (found.most or 0) > MAX_PAYLOAD:
        raise ValueError(f"a payload of {found.most} bytes is more than {MAX_PAYLOAD}")
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    again = rows.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(again, "warc-duplicates")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, ["digest", "size"], "left")
    revisit = F.col("page_id") < F.col("first_id")
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    fields = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first_id")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(BREAK), block,
    ]
    for k, (low, high) in enumerate(_ranges(bounds)):
        if found[f"n{k}"] or not k:
            part = rows.where((F.col("bytes") > low) & (F.col("bytes") <= high)).select(F.concat(*fields).alias("value"))
            part.write.option("lineSep", BREAK).option("maxRecordsPerFile", max(1, min(records_per_archive, archive_bytes // high))).text(f"{folder}/size={k}")


def _ranges(bounds: list[int]) -> list[tuple[int, int]]:
    return list(zip([-1, *bounds], [*bounds, 2**62], strict=True))


_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]+)[ \t]*$", re.I | re.M)


def _field(header: bytes, name: bytes) -> str | None:
    m = re.search(rb"^" + name + rb":[ \t]*([^\r\n]*)", header, re.I | re.M)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record(path: str, base: int, data: bytes, at: int, limit: int) -> tuple | None:
    """What is at ``at``: a record with the offset it leads to, one without offset where its headers go on beyond the limit, or None."""
    stop = data.find(b"\r\n\r\n", at, at + limit)
    header = data[at:stop] if stop >= 0 else b""
    length = _LENGTH.search(header.replace(b"\r\n", b"\n"))
    if stop >= 0 and not (length and (kind := _field(header, b"WARC-Type"))):
        return None
    if stop >= 0:
        block, size = stop + 4, int(length[1])
        inner = data.find(b"\r\n\r\n", block, block + min(size, limit))
    if stop < 0 or inner < 0 and block + size > min(len(data), block + limit):
        return path, base, base + at, *[None] * 8
    start = inner + 4 if inner >= 0 else block
    bytes_ = max(0, block + size - start)
    whole = start + bytes_ <= len(data)
    digest = base64.b32encode(hashlib.sha1(data[start : start + bytes_]).digest()).decode() if whole else None
    ids = [(_field(header, x) or "").removeprefix("<urn:page:").removesuffix(">") or None for x in (b"WARC-Record-ID", b"WARC-Refers-To")]
    claimed = (_field(header, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
    return path, base, base + at, base + block + size + 4, base + start, bytes_, kind, ids[0], ids[1], claimed, digest


def candidates(path: str, base: int, data: bytes, piece: int, limit: int) -> Iterator[tuple]:
    """Everything in the first ``piece`` bytes that looks like a record, with the offset it leads to.

    One whose headers go on beyond the limit has no offset, and must follow the end of a record.
    """
    at = data.find(MAGIC, 0, piece + len(MAGIC) - 1)
    while 0 <= at < piece:
        found = record(path, base, data, at, limit)
        if found and (found[3] is not None or at < 4 or data[at - 4 : at] == b"\r\n\r\n"):
            yield found
        at = data.find(MAGIC, at + 1, piece + len(MAGIC) - 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 5]
    names = ["path", "base", "off", "nxt", "start", "size", "kind", "page_id", "refers_to", "claimed", "digest"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_records(spark: SparkSession, folder: str, *, piece: int = 4 << 20, overlap: int = 1 << 20, header_limit: int = 1 << 16) -> DataFrame:
    """The records on the chain from the start of each archive, with the digest of the payload that was read."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    cut = F.transform(F.sequence(F.lit(0), F.col("length") - 1, F.lit(piece)), lambda b: F.struct(b.cast("long").alias("base"), F.substring(F.col("content"), b.cast("int") + 1, F.lit(piece + overlap)).alias("data")))
    pieces = files.where("length > 0").select("path", F.explode(cut).alias("x")).select("path", "x.base", "x.data")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _batch(list(candidates(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), piece, header_limit)))

    found = written(pieces.mapInArrow(look, RECORD), "warc-candidates")
    long = found.where("nxt is null")
    found = found.where("nxt is not null")
    if not long.isEmpty():
        found = found.unionByName(_long_headers(files, long, header_limit))
    reached = written(found.join(on_chain(found, piece), ["path", "off"], "left_semi"), "warc-reached")
    ends = reached.groupBy("path").agg(F.max("nxt").alias("end"))
    broken = files.where("length > 0").select("path", "length").join(ends, "path", "left").where("end is null or end <> length").first()
    if broken:
        raise ValueError(f"the records of {broken.path} lead to {broken.end or 0} of {broken.length} bytes")
    open_ = reached.where("digest is null")
    if open_.isEmpty():
        return reached
    return reached.where("digest is not null").unionByName(_long_payloads(files, open_))


def _holding(files: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    """The archives that hold some of the records, each with these columns of all of them."""
    paths = records.select("path").distinct()
    if paths.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        files = files.join(F.broadcast(paths), "path", "left_semi")
    return files.select("path", "length", "content").join(records.groupBy("path").agg(F.collect_list(F.struct(*columns)).alias("all")), "path")


def _long_headers(files: DataFrame, records: DataFrame, limit: int) -> DataFrame:
    """The candidates whose headers go on beyond the limit, from slices of their archives, four times as long each round."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, base, off, data, last = (batch.column(c)[k].as_py() for c in range(5))
                found = record(path, off, data, 0, len(data))
                # Without an end in the rest of the archive, it is no record.
                yield _batch([(path, base, *found[2:])] if found and (found[3] is not None or not last) else [])

    done = None
    while True:
        limit *= 4
        size = lambda r, n=limit: F.least(F.lit(n), F.col("length") - r["off"])
        cut = F.transform("all", lambda r: F.struct(r["base"].alias("base"), r["off"].alias("off"), F.substring(F.col("content"), (r["off"] + 1).cast("int"), size(r).cast("int")).alias("data"), (r["off"] + size(r) >= F.col("length")).alias("last")))
        slices = _holding(files, records, "base", "off").select("path", F.explode(cut).alias("x")).select("path", "x.*")
        found = written(slices.mapInArrow(look, RECORD), "warc-candidates")
        whole, records = found.where("nxt is not null"), found.where("nxt is null")
        done = whole if done is None else done.unionByName(whole)
        if records.isEmpty():
            return done


def _long_payloads(files: DataFrame, records: DataFrame) -> DataFrame:
    """Digests of payloads that reach beyond the bytes a piece has, from the archives that hold such."""
    spans = _holding(files, records, *[c for c in records.columns if c not in ("path", "digest")])
    done = spans.select("path", F.explode(F.transform("all", lambda r: F.struct(r.alias("r"), base32_sha1(F.substring(F.col("content"), (r["start"] + 1).cast("int"), r["size"].cast("int"))).alias("digest")))).alias("x"))
    return done.select("path", "x.r.*", "x.digest").select(*records.columns)


def on_chain(found: DataFrame, piece: int) -> DataFrame:
    """(path, off) of the candidates that the chain from offset 0 reaches."""
    links = found.groupBy("path", "base").agg(F.collect_list(F.struct("off", "nxt")).alias("links"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, base, pairs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                leaves: dict[int, int | None] = {}
                for p in sorted(pairs, key=lambda p: -p["off"]):
                    leaves[p["off"]] = p["nxt"] if p["nxt"] >= base + piece else leaves.get(p["nxt"])
                out += [(path, a, b) for a, b in leaves.items() if b is not None]
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["path", "off", "nxt"])

    # Links whose end no candidate starts at leave the archive; the rest jump between pieces.
    starts = found.select("path", F.col("off").alias("nxt"))
    jumps = written(links.mapInArrow(exits, "path string, off long, nxt long").join(starts, ["path", "nxt"], "left_semi").select("path", "off", "nxt"), "warc-jumps")
    reached = found.where("off = 0").select("path", "off")
    most = jumps.groupBy("path").agg(F.count_distinct("nxt").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        more = reached.join(jumps, ["path", "off"]).select("path", F.col("nxt").alias("off"))
        reached = written(reached.union(more).distinct(), "warc-reached")
        ahead = jumps.select("path", F.col("off").alias("nxt"), F.col("nxt").alias("far"))
        jumps = written(jumps.join(ahead, ["path", "nxt"]).select("path", "off", F.col("far").alias("nxt")), "warc-jumps")
    # Within a piece, the chain is followed from where it enters.
    entries = reached.withColumn("base", F.expr(f"off div {piece} * {piece}")).groupBy("path", "base").agg(F.min("off").alias("entry"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, pairs, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ahead = {p["off"]: p["nxt"] for p in pairs}
                while at in ahead:
                    out.append((path, at))
                    at = ahead[at]
            columns = list(zip(*out, strict=True)) if out else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["path", "off"])

    return links.join(entries, ["path", "base"]).select("path", "links", "entry").mapInArrow(follow, "path string, off long")


def pages_through_archives(pages: DataFrame, **options) -> DataFrame:
    """Write the pages, read the archives, and return what the records say of each page."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/stratakv/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **options)
    records = written(read_records(spark, folder), "warc-records")
    ident = lambda c: F.col(c).try_cast("long").alias(c)
    wrong = F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("path"), F.lit(" at "), F.col("off").cast("string")))
    checked = F.when(F.col("digest") == F.col("claimed"), F.col("digest")).otherwise(wrong)
    responses = records.where("kind = 'response'").select(ident("page_id"), F.col("size").alias("payload_bytes"), checked.alias("payload_digest"))
    revisits = records.where("kind = 'revisit'").select(ident("page_id"), ident("refers_to"), "claimed")
    first = responses.where("page_id is not null").dropDuplicates(["page_id", "payload_digest"]).withColumnRenamed("page_id", "refers_to")
    again = revisits.join(first, (revisits.refers_to == first.refers_to) & (revisits.claimed == first.payload_digest)).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), revisits.refers_to)
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)
