import shutil

import pytest

from stratakv.operators import mvcc
from stratakv.store import Engine, Options
from stratakv.streaming.ingest import PROGRESS, ingest, ingest_into


def test_ingest_commits_each_batch_once(spark, tmp_path):
    schema = "op_index long, kind byte, key binary, value string, expires_at_unix_ms long"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for n in range(2):
        spark.createDataFrame([(0, 1, b"k", f"v{n}", None), (1, 1, b"only%d" % n, "x", None)], schema).coalesce(1).write.mode("append").parquet(source)
        query = ingest(spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "cp"))
        query.awaitTermination()
    records = mvcc.fold(spark.read.parquet(log))
    assert sorted(r.seq for r in records.where("key = cast('k' as binary)").collect()) == [1, 2]
    assert {bytes(r.key): r.value for r in mvcc.state(records).collect()} == {b"k": "v1", b"only0": "x", b"only1": "x"}


def test_ingest_into_a_store(spark, tmp_path):
    """Batches are checked, readable at once, and not taken twice when a stream starts over from an older checkpoint."""
    schema = "op_index long, kind byte, key binary, value string, expires_at_unix_ms long"
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")

    def run(db):
        ingest_into(db, spark.readStream.schema(schema).parquet(source), "s", checkpoint).awaitTermination()

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    with Engine(spark, Options(tmp_path / "db", max_batch_bytes=100)) as db:
        add((0, 1, b"k", "one", None), (1, 1, b"t", "x", 5), (2, 1, b"k", "two", None))
        run(db)
        shutil.copytree(checkpoint, tmp_path / "old")
        add((0, 0, b"t", None, None))
        run(db)
        assert (db.get(b"k"), db.get(b"t"), db.get(PROGRESS + b"s"), db.last_sequence) == (b"two", None, b"1", 2)
        shutil.rmtree(checkpoint)
        shutil.copytree(tmp_path / "old", checkpoint)
        run(db)
        assert db.last_sequence == 2
        add((0, 1, b"k", "x" * 200, None))
        with pytest.raises(Exception, match="max_batch_bytes"):
            run(db)
        assert db.get(b"k") == b"two"
