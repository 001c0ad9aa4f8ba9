"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words, counted in Spark.

Every window of every document is hashed twice: polynomials in 64-bit word hashes to two bases, all
windows of a slice of documents at once from prefix sums. The first hash's high bits choose a bucket;
its low 16 bits and the 64 of the second go there in packed blocks (ten bytes a window, and two for
its distance from the slice's last window in the bucket), and each bucket counts its hashes by
sorting. So windows are held equal by 80 bits and those of the bucket's number: with 10^13 windows in
10^6 buckets less than one false repetition in a thousand runs is to be expected. A bucket answers to
the slice with the windows that are repeated; with the slice's table of documents they merge into
maximal removal intervals.

A slice is named by a hash of its documents' keys and lengths, so a task that runs again names it
alike; an answer to a slice that no task describes is an error. Windows that repeat within one slice
are known at once and are sent once, so a passage that a third of all documents hold sends one hash a
slice, not one a document. The number of buckets follows
the input, so a bucket's size does not, and buckets are dealt to as many tasks.

Defined cases: a null text has no words; a text shorter than a window keeps all its words; rows with
the same id and text are repetitions of each other and get the same result, and null ids are told
apart by their texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import left_join_sparse
from .common import Words, byte_texts, column, mix, sliced, small_batches, written

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
SECOND_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 2**64))

#: Characters of text for each bucket: about 1.4 million windows.
BUCKET_CHARS = 8_000_000
#: Characters of text for each part in which the answers for documents meet.
PART_CHARS = 64_000_000

#: Bytes of text whose windows a task hashes at a time.
SLICE_BYTES = 2 << 20

#: Bytes of a window's hash in a block.
HASH_BYTES = 10

#: Kinds of rows between mappers, buckets and parts.
HASHES, KNOWN, REPEATED, TABLE = range(4)
BLOCK = "bucket int, slice long, kind int, hashes binary, data binary"


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, size: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``size`` words. ``up``, ``down``: powers of the base and of its inverse."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def row_keys(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, text, and a key that names the pair."""
    small_batches(docs.sparkSession)
    rows = docs.select(*more, column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def ranks(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs (hash, more) stand together, and where in it a new pair begins."""
    order = np.argsort(hashes, kind="stable")
    ranked, extra = hashes[order], more[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    if (~first[1:] & (extra[1:] != extra[:-1])).any():  # one hash, but different pairs
        order = np.lexsort((more, hashes))
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, first


def _blocks(slice_: int, hashes: np.ndarray, second: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Rows of BLOCK for the windows of one slice: hashes by bucket, and those already known to repeat."""
    low = hashes.astype(np.uint16)
    order, first = ranks(second, low)
    counts = np.diff(np.append(np.flatnonzero(first), len(order)))
    repeated = np.zeros(len(hashes), bool)
    repeated[order] = np.repeat(counts > 1, counts)
    sent = np.zeros(len(hashes), bool)
    sent[order[first]] = True
    if repeated.any():
        yield slice_ % n_buckets, slice_, REPEATED, None, np.flatnonzero(repeated).astype(np.uint32).tobytes()
    bucket = ((hashes >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int32)
    # A known repetition needs no answer, but counts for others: it goes in a block of its own.
    for kind, wanted in ((HASHES, sent & ~repeated), (KNOWN, sent & repeated)):
        chosen = np.flatnonzero(wanted)
        chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
        edges = np.flatnonzero(np.diff(bucket[chosen], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = chosen[a:b]
            yield int(bucket[own[0]]), slice_, kind, second[own].tobytes() + low[own].tobytes(), _gaps(own) if kind == HASHES else None


def _gaps(places: np.ndarray) -> bytes:
    """Distances between rising places, two bytes each; a larger one as 65,535 and four bytes at the end."""
    steps = np.diff(places, prepend=0)
    large = steps >= 65_535
    return np.where(large, 65_535, steps).astype(np.uint16).tobytes() + steps[large].astype(np.uint32).tobytes()


def _places(gaps: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(gaps, np.uint16, n).astype(np.int64)
    steps[steps == 65_535] = np.frombuffer(gaps, np.uint32, offset=2 * n)
    return np.cumsum(steps)


def repeated_intervals(rows: DataFrame, size: int, n_buckets: int, n_parts: int) -> DataFrame:
    """(key, removed): for documents with windows that occur again, the maximal intervals of words that those cover.

    Buckets count windows; their answers meet by documents, dealt into ``n_parts`` parts.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = [np.empty(0, np.uint64)] * 4
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in sliced(batches, 1, SLICE_BYTES):
            words = Words(batch.column(1))
            if (need := len(words.hash)) > len(up[0]):
                up = [powers(x, need) for x in (BASE, BASE_INVERSE, SECOND, SECOND_INVERSE)]
            lengths = np.maximum(words.count - size + 1, 0)
            table = batch.column(0).to_numpy().tobytes() + lengths.astype(np.int64).tobytes()
            slice_ = xxhash.xxh3_64_intdigest(table) >> 1
            starts = np.repeat(words.bounds[:-1], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            pair = (window_hashes(words.hash, size, *up[k : k + 2])[starts] for k in (0, 2))
            out = [(slice_ % n_buckets, slice_, TABLE, None, table), *_blocks(slice_, *pair, n_buckets)]
            # Blocks go on in small record batches, so that Arrow's copy stays small.
            for k in range(0, len(out), 128):
                part = list(zip(*out[k : k + 128], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names=["bucket", "slice", "kind", "hashes", "data"])

    def counted(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, bytes]] = []
        blocks, hashes, more = [], [], []
        for slice_, kind, packed, data in zip(frame["slice"], frame["kind"], frame["hashes"], frame["data"], strict=True):
            if kind in (REPEATED, TABLE):
                out.append((slice_ % n_parts, slice_, kind, data))
                continue
            n = len(packed) // HASH_BYTES
            blocks.append((slice_, kind, data, n))
            hashes.append(np.frombuffer(packed, np.uint64, n))
            more.append(np.frombuffer(packed, np.uint16, n, 8 * n))
        if blocks:
            flags = np.repeat([b[1] == KNOWN for b in blocks], [b[3] for b in blocks])
            order, first = ranks(np.concatenate(hashes), np.concatenate(more))
            hashes.clear()
            same = ~first[1:]
            flags[order[1:][same]] = True
            flags[order[:-1][same]] = True
            at = 0
            for slice_, kind, data, n in blocks:
                own, at = flags[at : at + n], at + n
                if kind == HASHES and own.any():
                    out.append((slice_ % n_parts, slice_, REPEATED, _places(data, n)[own].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["part", "slice", "kind", "data"])

    def merged(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows_: list[tuple[int, list[int]]] = []
        for slice_, own in frame.groupby("slice"):
            tables = own["data"][own["kind"] == TABLE]
            answers = own["data"][own["kind"] == REPEATED]
            if not len(answers):
                continue
            if not len(tables):
                raise RuntimeError(f"answers for slice {slice_}, which no task has described")
            keys, lengths = np.frombuffer(tables.iloc[0], np.int64).reshape(2, -1)
            ends = np.cumsum(lengths)
            found = np.unique(np.concatenate([np.frombuffer(a, np.uint32) for a in answers]).astype(np.int64))
            doc = np.searchsorted(ends, found, side="right")
            places = found - (ends - lengths)[doc]
            edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
            rows_ += [(keys[doc[a]], intervals(places[a:b], size).ravel().tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(rows_, columns=["key", "removed"])

    blocks = rows.select("key", "text").mapInArrow(hashed, BLOCK)
    answers = blocks.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(counted, "part int, slice long, kind int, data binary")
    # Rows with one key hold one text, so their answers are equal.
    return answers.repartition(n_parts, "part").groupBy("part").applyInPandas(merged, "key long, removed array<int>").dropDuplicates(["key"])


def intervals(places: np.ndarray, size: int) -> np.ndarray:
    """Maximal [start, end) word intervals that windows starting at ``places`` cover."""
    starts = np.unique(places).astype(np.int64)
    if not len(starts):
        return np.empty((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > size)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + size], 1)


def substring_dedup(docs: DataFrame, *, size: int = 35, id_col: str = "doc_id", text_col: str = "text", chars: int | None = None) -> DataFrame:
    """doc_id, n_words, removed intervals as flat [start, end, ...] word numbers, and the kept words joined by spaces."""
    rows = row_keys(docs, id_col, text_col)
    total = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) if chars is None else chars
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = min(2**20, max(least, -(-total // BUCKET_CHARS)))
    n_parts = min(2**16, max(least, -(-total // PART_CHARS)))
    # Written, since the answers are small and the blocks behind them are not.
    found = written(repeated_intervals(rows, size, n_buckets, n_parts), "repeated-intervals")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "removed", "kept_text"]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            for part in sliced([batch], 1, SLICE_BYTES):
                out = []
                for text, spans in zip(byte_texts(part.column(1)), part.column(3).to_pylist(), strict=True):
                    words, kept, at = text.split(), [], 0
                    spans = spans or []
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        kept += words[at:a]
                        at = b
                    out.append((len(words), spans, b" ".join(kept + words[at:]).decode("utf-8", "replace")))
                columns = list(zip(*out, strict=True)) if out else [()] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    return left_join_sparse(rows, found, cut, "doc_id long, n_words long, removed array<int>, kept_text string")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns from the operator's result."""
    removed = F.aggregate("removed", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("sign")), lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"].cast("long"))
    return result.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["digest", "intervals", "repeated_intervals", "row_keys", "substring_dedup", "window_hashes"]
