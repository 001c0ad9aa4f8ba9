"""Operation logs over the driver's tables (columns: wal_number, seq, op_index, kind, key, value, expires_at_unix_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPS_PER_BATCH, BATCHES_PER_FILE, FIRST_FILE = 8, 50, 2
DAY_MS = 86_400_000


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events a batch; an error deletes its user's key, a signup expires after a day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    seq = F.floor(F.col("event_id") / OPS_PER_BATCH).cast("long") + 1
    error = F.col("event_type") == "error"
    expires = F.when(F.col("event_type") == "signup", F.unix_millis(F.col("ts").cast("timestamp")) + DAY_MS)
    return e.select(
        (F.floor((seq - 1) / BATCHES_PER_FILE) + FIRST_FILE).cast("long").alias("wal_number"), seq.alias("seq"), (F.col("event_id") % OPS_PER_BATCH).cast("long").alias("op_index"),
        F.when(error, 0).otherwise(1).cast("byte").alias("kind"), F.format_string("user:%08d", "user_id").cast("binary").alias("key"),
        F.when(~error, F.col("value")).alias("value"), expires.alias("expires_at_unix_ms"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key as puts to their customer's key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    seq = F.floor(F.col("o_orderkey") / OPS_PER_BATCH).cast("long") + 1
    return o.select((F.floor((seq - 1) / BATCHES_PER_FILE) + FIRST_FILE).cast("long").alias("wal_number"), seq.alias("seq"), (F.col("o_orderkey") % OPS_PER_BATCH).cast("long").alias("op_index"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).cast("byte").alias("kind"), F.format_string("cust:%08d", "o_custkey").cast("binary").alias("key"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("value"), F.lit(None).cast("long").alias("expires_at_unix_ms"))
