"""Sorted files and their metadata as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom, keycodec
from .ranges import next_keys, range_join, running_total

#: Files of a block of overlap_pairs(), which writes out at most the square of it from one row.
OVERLAP_BLOCK = 256
#: Of a row of filter_negatives(): keys, and bits of filters unless one file has more.
KEY_BLOCK, TILE_BITS = 16_384, 1 << 21


def file_properties(records: DataFrame) -> DataFrame:
    """Entries and bounds of each file (records carry file_number)."""
    return records.groupBy("file_number").agg(F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.max("seq").alias("largest_seq"))


def sorted_run(records: DataFrame) -> DataFrame:
    """Records with their encoded key, in its order within each partition."""
    return records.withColumn("internal_key", keycodec.internal_key(F.col("key"), F.col("seq"), F.col("kind"))).sortWithinPartitions("internal_key")


def probes(lookups: DataFrame, files: DataFrame, hits: DataFrame) -> DataFrame:
    """Files that a newest-first search of level 0 asks for each key: those whose range holds it, from the newest down to the one that has it.

    ``hits`` has (key, hit_file). No key meets a file: file numbers fall into stretches of powers of
    two, all from the hit on are at most one stretch of each size, and in a stretch the ranges that
    hold a key are those begun less those ended, by running totals.
    """
    keys = lookups.select("key").distinct()
    sound = files.where("smallest <= largest").select("file_number", "smallest", "largest")
    ends = sound.agg(F.min("file_number").alias("first"), F.max("file_number").alias("last")).first()
    if ends.first is None:
        return keys.select("key", F.lit(0).cast("long").alias("probes"))
    top = (ends.last - ends.first).bit_length()
    number, size = F.col("file_number") - ends.first, F.col("size")
    edges = F.array(F.struct(F.col("smallest").alias("at"), F.lit(0).alias("place"), F.lit(1).alias("weight")), F.struct(F.col("largest").alias("at"), F.lit(2).alias("place"), F.lit(-1).alias("weight")))
    sizes = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("size")
    begun = sound.select(number.alias("number"), F.explode(edges).alias("edge")).select("number", "edge.*", sizes)
    begun = begun.groupBy("size", F.expr("shiftright(number, size)").alias("stretch"), "at", "place").agg(F.sum("weight").alias("weight"))
    # All numbers from n on: n itself, and of each size the stretch right of n's where n's is a left half.
    start = keys.where("key is not null").join(hits.hint("merge"), "key", "left").select("key", F.greatest(F.coalesce("hit_file", F.lit(0)) - ends.first, F.lit(0)).cast("long").alias("number")).where(F.col("number") <= ends.last - ends.first)
    right = start.select("key", "number", F.explode(F.sequence(F.lit(-1), F.lit(top - 1))).alias("size")).where("size < 0 or shiftright(number, greatest(size, 0)) % 2 = 0") if top else start.withColumn("size", F.lit(-1))
    asked = right.select(F.greatest(size, F.lit(0)).alias("size"), F.when(size < 0, F.col("number")).otherwise(F.expr("shiftright(number, greatest(size, 0))") + 1).alias("stretch"), F.col("key").alias("at"), F.lit(1).alias("place"), F.lit(0).cast("long").alias("weight"))
    held = running_total(begun.unionByName(asked), "size", "stretch").where("place = 1").groupBy(F.col("at").alias("key")).agg(F.sum("total").alias("probes"))
    return keys.join(held.hint("merge"), "key", "left").select("key", F.coalesce("probes", F.lit(0)).cast("long").alias("probes"))


def overlap_pairs(files: DataFrame) -> DataFrame:
    """Pairs of files whose key ranges meet, each once and none compared in vain.

    In the order of their starts, a file meets those after it that start before its end: a span of
    places. Spans are cut at blocks of OVERLAP_BLOCK places, and blocks meet spans in tiles of at most
    that many files each way, dealt to all tasks; only there are pairs written out.
    """
    numbered = files.select("file_number", "smallest", "largest")
    edge = lambda at, place, number, weight: F.struct(F.col(at).alias("at"), F.struct(F.lit(place).alias("kind"), number.alias("number")).alias("place"), F.lit(weight).cast("long").alias("weight"))
    edges = F.array(edge("smallest", 0, F.col("file_number"), 1), F.when(F.col("smallest") <= F.col("largest"), edge("largest", 1, F.col("file_number"), 0)))
    total = running_total(numbered.select(F.explode(edges).alias("edge")).where("edge.at is not null").select("edge.*"))
    at = total.groupBy(F.col("place.number").alias("file_number")).agg(*[F.max(F.when(F.col("place.kind") == k, F.col("total") - 1)).alias(n) for k, n in ((0, "own"), (1, "last"))]).where("own is not null")
    at = at.withColumn("block", F.floor(F.col("own") / OVERLAP_BLOCK))
    members = at.groupBy(F.col("block").alias("other")).agg(F.transform(F.sort_array(F.collect_list(F.struct("own", "file_number"))), lambda m: m["file_number"]).alias("members"))
    spans = at.where("last > own").withColumn("other", F.explode(F.sequence(F.floor((F.col("own") + 1) / OVERLAP_BLOCK), F.floor(F.col("last") / OVERLAP_BLOCK))))
    begin = F.col("other") * OVERLAP_BLOCK
    span = F.struct(F.col("file_number").alias("one"), (F.greatest(F.col("own") + 1 - begin, F.lit(0)) + 1).cast("int").alias("first"), F.least(F.col("last") - begin + 1, F.lit(OVERLAP_BLOCK)).cast("int").alias("end"))
    tiles = spans.groupBy("block", "other").agg(F.collect_list(span).alias("spans")).join(members.hint("merge"), "other")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = tiles.repartition(tasks, "block", "other").select("members", F.inline("spans")).select("one", F.explode(F.slice("members", F.col("first"), F.col("end") - F.col("first") + 1)).alias("two"))
    return met.select(F.least("one", "two").alias("file_a"), F.greatest("one", "two").alias("file_b"))


def level_violations(files: DataFrame) -> DataFrame:
    """Neighbours of a level above 0 that overlap: such a level must be sorted and disjoint."""
    order = Window.partitionBy("level").orderBy("smallest", "file_number")
    return files.where("level > 0").withColumn("before", F.lag("largest").over(order)).where(F.col("before") >= F.col("smallest")).drop("before")


def candidates_by_level(lookups: DataFrame, files: DataFrame) -> DataFrame:
    """For levels above 0, at most one file of each level for each key, by its range."""
    return range_join(lookups.select("key"), files.where("level > 0")).select("key", "level", "file_number")


def lower_bound(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The first key at or after each target, null past the end."""
    return next_keys(records.select("key"), targets)


def filter_bits(records: DataFrame, bits_per_key: int) -> DataFrame:
    """The Bloom filter of each file in words of 64 bits; sizes follow the number of entries, as stored.

    A file's records meet in one task, as its filter is one value.
    """
    count = bloom.probe_count(bits_per_key)
    size = F.ceil(F.greatest(F.lit(64), F.count("*") * bits_per_key) / 8).cast("long") * 8

    @F.arrow_udf("array<long>")
    def build(keys: pa.Array, bits: pa.Array) -> pa.Array:
        low, step = bloom.hashes_of(keys.flatten().cast(pa.binary()))
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(keys).to_numpy())])
        words = [bloom.build_words(low[a:b], step[a:b], n, count) for a, b, n in zip(at, at[1:], bits.to_pylist())]
        ends = np.cumsum([0] + [len(w) for w in words]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate(words) if words else np.array([], np.int64))

    kept = records.groupBy("file_number").agg(size.alias("bits"), F.collect_set("key").alias("keys"))
    return kept.select("file_number", "bits", build("keys", "bits").alias("words"))


def filter_check(lookups: DataFrame, filters: DataFrame, bits_per_key: int) -> DataFrame:
    """lookups (file_number, key, ...) with ``maybe``: whether the file's filter lets the key pass.

    Lookups meet their file's filter row by row, so nothing is held but one filter.
    """
    maybe = bloom.may_contain(F.col("key"), F.col("words"), F.col("bits"), bloom.probe_count(bits_per_key))
    return lookups.join(filters.hint("merge"), "file_number").select(*lookups.columns, maybe.alias("maybe"))


def filter_negatives(keys: DataFrame, files: DataFrame, filters: DataFrame, bits_per_key: int) -> DataFrame:
    """(file_number, checks, useful_negatives): how many of the keys each file's range holds, and how many of these its filter turns away.

    The keys lie in order in blocks of KEY_BLOCK, as their hashes; a file asks a span of places. Blocks
    meet groups of files of at most TILE_BITS bits (or one file) in rows that are dealt to all tasks.
    """
    count = bloom.probe_count(bits_per_key)
    edge = lambda at, place, number, weight: F.struct(at.alias("at"), F.struct(F.lit(place).alias("kind"), number.cast("long").alias("number")).alias("place"), F.lit(weight).cast("long").alias("weight"))
    ends = F.array(edge(F.col("smallest"), 0, F.col("file_number"), 0), edge(F.col("largest"), 2, F.col("file_number"), 0))
    asked = files.where("smallest <= largest").select(F.explode(ends).alias("edge")).select("edge.*")
    total = running_total(keys.where("key is not null").select("key").distinct().select(edge(F.col("key"), 1, F.lit(0), 1).alias("edge")).select("edge.*").unionByName(asked))
    key = total.where("place.kind = 1").select((F.col("total") - 1).alias("own"), bloom.start_and_step(F.col("at")).alias("h"))
    blocks = key.groupBy(F.floor(F.col("own") / KEY_BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("own", "h"))).alias("k")).select("block", F.col("k.h.low").alias("low"), F.col("k.h.step").alias("step"))
    at = total.where("place.kind <> 1").groupBy(F.col("place.number").alias("file_number")).agg(*[F.max(F.when(F.col("place.kind") == k, F.col("total"))).alias(n) for k, n in ((0, "begin"), (2, "end"))])
    spans = at.where("begin < end").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / KEY_BLOCK), F.floor((F.col("end") - 1) / KEY_BLOCK))))
    start = F.col("block") * KEY_BLOCK
    width = F.ceil(F.log2(F.col("bits").cast("double"))).cast("int")
    group = F.floor(F.col("file_number") / F.greatest(F.lit(1), F.expr(f"shiftright({TILE_BITS}, least(width, 31))")))
    span = F.struct("file_number", F.greatest(F.col("begin") - start, F.lit(0)).alias("begin"), F.least(F.col("end") - start, F.lit(KEY_BLOCK)).alias("end"), "bits", "words")
    tiles = spans.join(filters.hint("merge"), "file_number").withColumn("width", width).groupBy("block", "width", group.alias("group")).agg(F.collect_list(span).alias("spans"))
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.join(blocks.hint("merge"), "block").repartition(tasks, "block", "width", "group").select("spans", "low", "step")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                spans, low, step = (batch.column(c)[i].values for c in range(3))
                low, step = low.to_numpy().astype(np.uint64), step.to_numpy().astype(np.uint64)
                number, begin, end, bits = (spans.field(c).to_numpy() for c in range(4))
                words = [w.values.to_numpy() for w in spans.field(4)]
                missed = [bloom.count_negatives(low[b:e], step[b:e], w, n, count) for b, e, n, w in zip(begin, end, bits, words)]
                yield pa.RecordBatch.from_pydict({"file_number": number, "checks": end - begin, "useful_negatives": np.array(missed, np.int64)})

    found = dealt.mapInArrow(ask, "file_number long, checks long, useful_negatives long")
    return found.groupBy("file_number").agg(F.sum("checks").alias("checks"), F.sum("useful_negatives").alias("useful_negatives"))
