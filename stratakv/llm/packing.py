"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Bins are kept in order of their residual room, each with a bitmap of the sources and one of the
duplicate clusters that it holds. A document starts at the smallest residual that is large enough
(the successor of its size) and goes on to the next larger one until a bin has neither its source
nor its cluster; without one it opens a bin. Documents come in order of falling size.

Documents are dealt by a hash into shards of about ``shard_docs`` documents, and each shard is packed
alone: no key, source or cluster can gather more than a shard in one task. A document longer than a
bin fills whole bins, and its rest is packed like any other piece.

A cluster is what the column ``cluster_col`` names (component ids of the n-gram join, say); without it,
documents of the same words without regard to ASCII case are a cluster. Of two pieces that are
compatible with a document, the tightest takes it; ties go to the bin that was opened first.

Defined cases: a null or empty text has no words and takes no bin (piece 0, bin null); a null source
conflicts with nothing, and neither does a null cluster; repeated rows are packed each on its own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, Words, column, sliced, small_batches

SCHEMA = "doc_id long, n_words long, piece int, start_word long, piece_words long, bin string, bin_room long"


def pack(items: list[tuple[int, str | None, str | None]], capacity: int) -> list[tuple[int, int]]:
    """For items (size, source, cluster) in order of packing: the bin and the room it had before."""
    sources: dict[str, int] = {}
    clusters: dict[str, int] = {}
    held: list[list[int]] = []  # bitmaps of sources and clusters by bin
    open_bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    out = []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 0 if cluster is None else 1 << clusters.setdefault(cluster, len(clusters))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (held[open_bins[at][1]][0] & s or held[open_bins[at][1]][1] & c):
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        if room > size:
            insort(open_bins, (room - size, b))
        out.append((b, room))
    return out


def measured(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, cluster_col: str | None = None) -> DataFrame:
    """doc_id, number of words, source, a hash of the words without regard to ASCII case, and the cluster; texts stay where they are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SLICE_BYTES):
            words = Words(batch.column(1), LOWER)
            same = [xxhash.xxh3_64_intdigest(words.of(words.hash, d).tobytes()) - 2**63 if n else None for d, n in enumerate(words.count.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words.count, pa.int64()), pa.array(same, pa.int64()), batch.column(3)], names=["doc_id", "source", "n_words", "same", "named"])

    named = F.lit(None).cast("string") if cluster_col is None else column(cluster_col).cast("string")
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"), column(source_col).cast("string").alias("source"), named.alias("named"))
    found = rows.mapInArrow(run, "doc_id long, source string, n_words long, same long, named string")
    cluster = F.col("same").cast("string") if cluster_col is None else F.col("named")
    return found.select("doc_id", "source", "n_words", F.col("same").cast("string").alias("same"), cluster.alias("cluster"))


def best_fit(docs: DataFrame, *, capacity: int = 2048, shard_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, total: int | None = None) -> DataFrame:
    """A row per piece of a document with its bin. ``total``: the number of documents, if it is known."""
    shards = max(1, -(-(docs.count() if total is None else total) // shard_docs))
    rows = measured(docs, id_col=id_col, text_col=text_col, source_col=source_col, cluster_col=cluster_col)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "same", F.lit(7)), F.lit(shards)).cast("int"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pieces, rest = [], []
        frame = frame.sort_values(["n_words", "doc_id", "same", "cluster", "source"], ascending=[False, True, True, True, True], na_position="last", kind="stable")
        shard, whole = int(key[0]), 0
        for doc, source, n, cluster in zip(frame.doc_id, frame.source, frame.n_words, frame.cluster, strict=True):
            doc = None if pd.isna(doc) else int(doc)
            n, full = int(n), int(n) // capacity
            if not n:
                pieces.append((doc, 0, 0, 0, 0, None, None))
            for k in range(full):
                pieces.append((doc, n, k, k * capacity, capacity, f"{shard}-w{whole}", capacity))
                whole += 1
            if n % capacity:
                rest.append((n % capacity, None if pd.isna(source) else source, None if pd.isna(cluster) else cluster, doc, n, full))
        rest.sort(key=lambda r: -r[0])
        for (size, _, _, doc, n, full), (b, room) in zip(rest, pack([r[:3] for r in rest], capacity), strict=True):
            pieces.append((doc, n, full, full * capacity, size, f"{shard}-{b}", room))
        names = ["doc_id", "n_words", "piece", "start_word", "piece_words", "bin", "bin_room"]
        return pd.DataFrame({c: pd.array(v, "Int64") if c != "bin" else list(v) for c, v in zip(names, zip(*pieces, strict=True), strict=True)}) if pieces else pd.DataFrame({c: [] for c in names})

    # The nullable columns go as nullable integers, so that no id passes through a float.
    typed = lambda key, frame: run(key, frame.astype({"doc_id": "Int64"}))
    safe = rows.select("shard", F.col("doc_id").cast("string").alias("doc_id"), "source", "n_words", "same", "cluster")
    return safe.groupBy("shard").applyInPandas(typed, SCHEMA)
