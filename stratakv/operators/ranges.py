"""Joins of keys with ranges of keys as equi-joins on buckets of the key space."""

from __future__ import annotations

from bisect import bisect_right
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the key space, about: their bounds go to every task. Any bounds give right results.
MAX_CUTS = 4096
#: Targets of a lower-bound search that go to every task at a time.
BLOCK_TARGETS = 100_000


def _bounds(ranges: DataFrame, low: str) -> list[bytes]:
    """Starts of ranges in order; of more than MAX_CUTS, about as many, chosen by a hash."""
    starts = ranges.select(F.col(low).alias("at")).where("at is not null").distinct()
    step = -(-max(1, starts.count()) // MAX_CUTS)
    return sorted(bytes(r.at) for r in starts.where(F.pmod(F.xxhash64("at"), F.lit(step)) == 0).collect())


def _bucket(key: Column, bounds: list[bytes]) -> Column:
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(bounds, bytes(k)), na_action="ignore").astype("Int32")

    return place(key)


def range_join(points: DataFrame, ranges: DataFrame, point: str = "key", low: str = "smallest", high: str = "largest") -> DataFrame:
    """Pairs of a row of ``points`` and one of ``ranges`` with ``low <= point <= high``; the column names differ.

    A point lies in one bucket and a range has each bucket once, so every pair comes up once. Neither
    side is broadcast; rows with a null meet nothing.
    """
    bounds = _bounds(ranges, low)
    placed = points.withColumn("bucket__", _bucket(F.col(point), bounds))
    spread = ranges.where(F.col(low) <= F.col(high)).withColumns({"from__": _bucket(F.col(low), bounds), "to__": _bucket(F.col(high), bounds)})
    spread = spread.withColumn("bucket__", F.explode(F.sequence("from__", "to__"))).drop("from__", "to__")
    return placed.join(spread, "bucket__").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("bucket__")


def running_total(rows: DataFrame, *group: str) -> DataFrame:
    """rows (at, place, weight, ...) with ``total``: the sum of the weights of a group's rows up to this one, by ``at`` and then ``place``.

    ``place`` tells equal ``at`` apart. Summed in buckets of the key space; only one row for each
    bucket is summed across them, so no task holds a whole group and nothing is broadcast.
    """
    part = [*group, "bucket__"]
    placed = rows.withColumn("bucket__", _bucket(F.col("at"), _bounds(rows, "at")))
    sums = placed.groupBy(*part).agg(F.sum("weight").alias("sum__"))
    before = Window.partitionBy(*group).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("before__"))
    so_far = Window.partitionBy(*part).orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    added = placed.withColumn("total", F.sum("weight").over(so_far)).join(sums.hint("merge"), part)
    return added.withColumn("total", F.col("total") + F.col("before__")).drop("bucket__", "before__")


def next_keys(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, key): the least key at or after each target, null past the end and for a null target.

    In blocks of targets: each key goes to the last target at or before it, a target keeps its least
    key, and the least of all later targets is carried back in one order of the block.
    """
    asked = targets.select("target").distinct()
    out = asked.where("target is null").select("target", F.lit(None).cast("binary").alias("key"))
    rows = asked.where("target is not null").orderBy("target").toLocalIterator()
    while block := [bytes(r.target) for r in islice(rows, BLOCK_TARGETS)]:
        least = keys.select("key", (_bucket(F.col("key"), block) - 1).alias("place")).where("place >= 0").groupBy("place").agg(F.min("key").alias("least"))
        places = keys.sparkSession.createDataFrame(list(enumerate(block)), "place int, target binary")
        later = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
        out = out.unionByName(places.join(least, "place", "left").select("target", F.min("least").over(later).alias("key")))
    return out


__all__ = ["next_keys", "range_join", "running_total"]
