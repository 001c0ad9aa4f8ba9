"""EXTENSION: operation logs from Structured Streaming, as a table or into a store.

As a table, each micro-batch becomes one committed batch: its sequence is the batch id plus one, and its
rows go to a segment of that number. A batch that runs again after a failure writes the same segment, so
the log holds every batch once.

Into a store, each micro-batch is one WriteBatch with the store's checks, and carries the batch id under
a key of its own. Both commit together, so a batch that runs again is known and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Engine, InvalidArgument, WriteBatch

#: Key under which a store keeps the last batch of a stream, before the stream's name.
PROGRESS = b"\x00stream:"


def ingest(ops: DataFrame, log_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of (op_index, kind, key, value, expires_at_unix_ms) to a log. ``trigger``: as in trigger()."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("seq", F.lit(batch_id + 1).cast("long"))
        rows.write.mode("overwrite").parquet(f"{log_path}/wal_number={batch_id + 1}")

    writer = ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_into(db: Engine, ops: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Commit a stream of (op_index, kind, key, value, expires_at_unix_ms) to a store, each micro-batch once.

    ``name`` tells streams of one store apart. Rows reach the driver one partition at a time, as every
    write of a store does; a micro-batch beyond ``max_batch_bytes`` is refused and fails the stream.
    """
    progress = PROGRESS + name.encode()

    def commit(rows: DataFrame, batch_id: int) -> None:
        done = db.get(progress)
        if done is not None and int(done) >= batch_id:
            return
        batch, size = WriteBatch(), 0
        for r in rows.orderBy("op_index").toLocalIterator():
            key, value = bytes(r.key), None if r.value is None else r.value.encode() if isinstance(r.value, str) else bytes(r.value)
            if (size := size + len(key) + len(value or b"")) > db.options.max_batch_bytes:
                raise InvalidArgument(f"micro-batch {batch_id} exceeds max_batch_bytes {db.options.max_batch_bytes}")
            if not r.kind:
                batch.delete(key)
            elif r.expires_at_unix_ms is None:
                batch.put(key, value or b"")
            else:
                batch.put_with_expiration(key, value or b"", r.expires_at_unix_ms)
        db.write(batch.put(progress, b"%d" % batch_id))

    writer = ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
