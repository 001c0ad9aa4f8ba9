"""Multi-version reads as DataFrame operators over an operation log or its folded records.

All of them group by key (or key and sequence), so one shuffle on the key serves each, and the
aggregates combine before it: a key with a third of all operations sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = ["key", "seq", "kind", "value", "expires_at_unix_ms"]


def _payload() -> Column:
    return F.struct("kind", "value", "expires_at_unix_ms")


def fold(log: DataFrame) -> DataFrame:
    """One record for each (key, seq): the last operation of the batch wins."""
    return log.groupBy("key", "seq").agg(F.max_by(_payload(), "op_index").alias("r")).select("key", "seq", "r.*")


def newest(records: DataFrame, at: int | None = None) -> DataFrame:
    """The newest record of each key with ``seq <= at``, tombstones included."""
    seen = records if at is None else records.where(F.col("seq") <= at)
    return seen.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(_payload(), "seq").alias("r")).select("key", "seq", "r.*")


def state(records: DataFrame, at: int | None = None) -> DataFrame:
    """Visible keys and values."""
    return newest(records, at).where("kind = 1")


def state_of_log(log: DataFrame, at: int | None = None) -> DataFrame:
    """fold() and state() in one aggregation: the largest (seq, op_index) of a key wins."""
    seen = log if at is None else log.where(F.col("seq") <= at)
    return seen.groupBy("key").agg(F.max_by(F.struct("seq", "kind", "value"), F.struct("seq", "op_index")).alias("r")).select("key", "r.*").where("kind = 1")


def get(records: DataFrame, key: bytes, at: int | None = None) -> DataFrame:
    """The visible value of one key; the key and sequence reach the scan as filters."""
    return state(records.where(F.col("key") == F.lit(key)), at)


def exact(records: DataFrame, key: bytes, seq: int, kind: int) -> DataFrame:
    """The record of exactly this key, sequence and kind; all three reach the scan as filters."""
    return records.where((F.col("key") == F.lit(key)) & (F.col("seq") == F.lit(seq)) & (F.col("kind") == F.lit(kind)))


def multi_get(records: DataFrame, keys: DataFrame, at: int | None = None) -> DataFrame:
    """EXTENSION: visible values of the keys in a DataFrame; absent keys have a null value."""
    found = state(records.join(keys.select("key").distinct(), "key", "left_semi"), at)
    return keys.select("key").distinct().join(found.select("key", "seq", "value"), "key", "left")


def as_of(records: DataFrame, lookups: DataFrame) -> DataFrame:
    """For each (key, snapshot_seq) the newest record at or before it, without a pair for every version.

    Versions and lookups of a key are put in one order and the last version is carried forward.
    """
    versions = records.select("key", F.col("seq").alias("at"), F.lit(0).alias("side"), F.struct("seq", "kind", "value").alias("r"))
    asked = lookups.select("key", F.col("snapshot_seq").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(versions.schema["r"].dataType).alias("r"))
    order = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = versions.unionByName(asked).withColumn("last", F.last("r", ignorenulls=True).over(order))
    return both.where("side = 1").select("key", F.col("at").alias("snapshot_seq"), "last.*")


def history(records: DataFrame) -> DataFrame:
    """All versions with their age: 1 is the newest of its key."""
    return records.withColumn("age", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))))


def sequence_gaps(log: DataFrame) -> DataFrame:
    """Sequences that do not follow the one before: an anti-join, so no single task sees them all."""
    seqs = log.select("seq").distinct()
    before = seqs.select((F.col("seq") + 1).alias("seq"))
    first = seqs.agg(F.min("seq").alias("first"))
    return seqs.join(before, "seq", "left_anti").join(F.broadcast(first)).where("seq > first").select("seq")


def payload_bytes(log: DataFrame) -> DataFrame:
    """Payload of each batch: key and value bytes, for deletes the key alone."""
    return log.groupBy("seq").agg(F.count("*").alias("ops"), F.sum(F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))).cast("long").alias("payload_bytes"))


def range_scan(records: DataFrame, low: bytes | None, high: bytes | None, at: int | None = None) -> DataFrame:
    """EXTENSION: visible rows with ``low <= key < high``; bounds of None are open."""
    seen = records
    if low is not None:
        seen = seen.where(F.col("key") >= F.lit(low))
    if high is not None:
        seen = seen.where(F.col("key") < F.lit(high))
    return state(seen, at)


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key after all keys with the prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def prefix_scan(records: DataFrame, prefix: bytes, at: int | None = None) -> DataFrame:
    """EXTENSION: visible rows whose key begins with the prefix, as a range that the scan can prune."""
    return range_scan(records, prefix, prefix_end(prefix), at)


def unexpired(records: DataFrame, now_ms: int, at: int | None = None) -> DataFrame:
    """EXTENSION: visible rows that have not expired; parity reads ignore expiration."""
    return state(records, at).where(F.col("expires_at_unix_ms").isNull() | (F.col("expires_at_unix_ms") > now_ms))


def compact(records: DataFrame, snapshots: list[int]) -> DataFrame:
    """EXTENSION: the versions that the snapshots or the latest read still need.

    A version is needed if a snapshot lies at or after it and before the next version of its key; the
    newest always is.
    """
    bounds = F.array(*[F.lit(s).cast("long") for s in sorted(snapshots)]) if snapshots else F.array().cast("array<long>")
    after = F.lead("seq").over(Window.partitionBy("key").orderBy("seq"))
    needed = F.exists(bounds, lambda s: (s >= F.col("seq")) & (s < F.col("next_seq")))
    return records.withColumn("next_seq", after).where(F.col("next_seq").isNull() | needed).drop("next_seq")
