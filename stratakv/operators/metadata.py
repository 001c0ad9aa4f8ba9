"""The append-only metadata log and the write-ahead log as tables: checks and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("next_file_number", "last_sequence", "log_number", "active_log_number", "wal_sequence")


def derived_edits(files: DataFrame) -> DataFrame:
    """One edit for each flushed file, in order: what the metadata log holds after such a load."""
    n = F.col("file_number")
    return files.select((n - 1).alias("edit_no"), (n + 1).alias("next_file_number"), F.col("largest_seq").alias("last_sequence"), (n + 1).alias("log_number"), (n + 1).alias("active_log_number"), F.col("largest_seq").alias("wal_sequence"), n.alias("added"))


def counter_violations(edits: DataFrame) -> DataFrame:
    """Edits in which a counter goes back: one ordered pass in one task, over one row for each flush or compaction of a store."""
    order = Window.orderBy("edit_no")
    bad = None
    for c in COUNTERS:
        back = F.coalesce(F.lag(c).over(order) > F.col(c), F.lit(False))
        bad = back if bad is None else bad | back
    return edits.withColumn("bad", bad).where("bad").drop("bad")


def reused_numbers(added: DataFrame) -> DataFrame:
    """File numbers that more than one edit adds."""
    return added.groupBy("file_number").agg(F.count("*").alias("times")).where("times > 1")


def live_files(events: DataFrame) -> DataFrame:
    """Files added and not deleted; in one edit deletes come before adds. events: (edit_no, op, file_number)."""
    rank = F.col("edit_no") * 2 + F.when(F.col("op") == "add", 1).otherwise(0)
    return events.groupBy("file_number").agg(F.max_by("op", rank).alias("op")).where("op = 'add'").select("file_number")


def orphans(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Files in the directory that the metadata does not know."""
    return listing.join(live, "file_number", "left_anti")


def retired_wals(log: DataFrame, flushed_seq: int) -> DataFrame:
    """Segments whose every batch is in a flushed file."""
    return log.groupBy("wal_number").agg(F.max("seq").alias("last_seq")).where(F.col("last_seq") <= flushed_seq)


def oldest_required_wal(log: DataFrame, flushed_seq: int) -> DataFrame:
    return log.where(F.col("seq") > flushed_seq).agg(F.min("wal_number").alias("oldest_wal"))


#: Event numbers are below 2**EVENT_BITS.
EVENT_BITS = 62


def oldest_active(events: DataFrame) -> DataFrame:
    """The least snapshot sequence still held after each event (event_no, seq, delta), null if none is.

    Running counts give the stretches of events in which a sequence is held. A stretch is cut into
    aligned stretches of powers of two, each of which keeps its least sequence; an event looks up those
    that it lies in. Both are equi-joins, and no task sees more than one sequence's events.
    """
    by_event = Window.partitionBy("seq").orderBy("event_no")
    counted = events.groupBy("seq", "event_no").agg(F.sum("delta").alias("delta"))
    held = counted.select("seq", "event_no", F.sum("delta").over(by_event).alias("held"), F.coalesce(F.lead("event_no").over(by_event), F.lit(2**EVENT_BITS)).alias("until")).where("held > 0")
    pieces = []
    for k in range(EVENT_BITS):
        first, end = F.shiftright(F.col("event_no") + (2**k - 1), k), F.shiftright("until", k)
        piece = lambda odd, node, k=k, some=first < end: F.when(some & (odd % 2 == 1), F.struct(F.lit(k).alias("level"), node.alias("node")))
        pieces += [piece(first, first), piece(end, end - 1)]
    cut = held.select("seq", F.explode(F.array_compact(F.array(*pieces))).alias("x"))
    least = cut.groupBy("x.level", "x.node").agg(F.min("seq").alias("seq"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("event_no", k).alias("node")) for k in range(EVENT_BITS)])
    asked = events.select("event_no").distinct().select("event_no", F.explode(levels).alias("x")).select("event_no", "x.level", "x.node")
    return asked.join(least, ["level", "node"], "left").groupBy("event_no").agg(F.min("seq").alias("oldest_active"))
