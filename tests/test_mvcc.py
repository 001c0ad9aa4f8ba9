"""Reads over small logs against a dictionary model."""

import random
from collections import Counter

from pyspark.sql import functions as F

from stratakv.operators import files, metadata, mvcc, ranges

LOG = "wal_number long, seq long, op_index long, kind byte, key binary, value string, expires_at_unix_ms long"


def log(spark, ops):
    return spark.createDataFrame([(1, s, i, int(v is not None), k, v, None) for s, i, k, v in ops], LOG)


def visible(df):
    return {bytes(r.key): r.value for r in df.collect()}


def test_last_operation_wins(spark):
    records = mvcc.fold(log(spark, [(7, 0, b"k", None), (7, 1, b"k", "last")])).collect()
    assert [(r.seq, r.kind, r.value) for r in records] == [(7, 1, "last")]


def test_snapshots_and_tombstones(spark):
    records = mvcc.fold(log(spark, [(1, 0, b"k", "old"), (2, 0, b"k", "new"), (3, 0, b"k", None)]))
    assert [visible(mvcc.state(records, s)) for s in (0, 1, 2, 3)] == [{}, {b"k": "old"}, {b"k": "new"}, {}]
    assert mvcc.newest(records).first().kind == 0


def test_boundary_version_is_found(spark):
    """A version far below the snapshot is visible however the files are cut."""
    records = mvcc.fold(log(spark, [(1, 0, b"k", "first"), (528, 0, b"k", "second")]))
    assert visible(mvcc.get(records, b"k", 517)) == {b"k": "first"}


def test_random_against_model(spark):
    rnd = random.Random(7)
    keys = [bytes([rnd.randrange(3)] * rnd.randrange(3)) for _ in range(6)]
    ops = [(s, i, rnd.choice(keys), rnd.choice([None, "x", "y", f"v{s}"])) for s in range(1, 40) for i in range(rnd.randrange(1, 4))]
    df = log(spark, ops)
    records = mvcc.fold(df)
    asked = [0, 5, 17, 39]
    for at in asked:
        model = {}
        for s, _, k, v in ops:
            if s <= at:
                model[k] = v
        expected = {k: v for k, v in model.items() if v is not None}
        assert visible(mvcc.state(records, at)) == expected
        assert visible(mvcc.state_of_log(df, at)) == expected
        kept = mvcc.compact(records, asked)
        assert visible(mvcc.state(kept, at)) == expected
    lookups = spark.createDataFrame([(k, s) for k in set(keys) for s in asked], "key binary, snapshot_seq long")
    found = {(bytes(r.key), r.snapshot_seq): r.value for r in mvcc.as_of(records, lookups).where("kind = 1").collect()}
    for at in asked:
        assert {k: v for (k, s), v in found.items() if s == at} == visible(mvcc.state(records, at))


def test_prefix_end():
    assert [mvcc.prefix_end(p) for p in (b"a", b"a\xff", b"\xff\xff", b"")] == [b"b", b"b", None, None]


def test_scans(spark):
    records = mvcc.fold(log(spark, [(1, i, k, "v") for i, k in enumerate([b"a", b"ab", b"b", b"\xff", b"\xff\xff"])]))
    assert sorted(visible(mvcc.range_scan(records, b"ab", b"\xff"))) == [b"ab", b"b"]
    assert sorted(visible(mvcc.prefix_scan(records, b"a"))) == [b"a", b"ab"]
    assert sorted(visible(mvcc.prefix_scan(records, b"\xff"))) == [b"\xff", b"\xff\xff"]


def test_gap(spark):
    assert [r.seq for r in mvcc.sequence_gaps(log(spark, [(1, 0, b"k", "x"), (3, 0, b"k", "x")])).collect()] == [3]


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "r")
    mvcc.fold(log(spark, [(1, 0, b"k", "x")])).write.parquet(path)
    plan = mvcc.get(spark.read.parquet(path), b"k", 5)._jdf.queryExecution().toString()
    assert "EqualTo(key" in plan and "LessThanOrEqual(seq,5)" in plan


def test_levels_and_files(spark):
    f = spark.createDataFrame([(1, 2, b"a", b"m"), (1, 3, b"m", b"z"), (2, 4, b"a", b"c"), (2, 5, b"d", b"f")], "level int, file_number long, smallest binary, largest binary")
    assert [(r.level, r.file_number) for r in files.level_violations(f).collect()] == [(1, 3)]
    assert {(r.file_a, r.file_b) for r in files.overlap_pairs(f).collect()} == {(2, 3), (2, 4), (2, 5)}


def test_metadata_checks(spark):
    edits = spark.createDataFrame([(1, 10, 20, 1, 1, 0), (2, 9, 20, 1, 1, 0), (3, 10, 19, 1, 1, 0)], "edit_no long, next_file_number long, last_sequence long, log_number long, active_log_number long, wal_sequence long")
    assert [r.edit_no for r in metadata.counter_violations(edits).collect()] == [2, 3]
    live = spark.createDataFrame([(1, "add", 2), (1, "add", 3), (2, "delete", 2), (3, "delete", 3), (3, "add", 4)], "edit_no long, op string, file_number long")
    assert {r.file_number for r in metadata.live_files(live).collect()} == {4}
    empty = edits.where("false")
    assert metadata.counter_violations(empty).count() == 0


def test_empty_log(spark):
    empty = log(spark, [(1, 0, b"k", "x")]).where("false")
    records = mvcc.fold(empty)
    assert mvcc.state(records).count() == mvcc.history(records).count() == mvcc.sequence_gaps(empty).count() == 0


def test_expiration(spark):
    df = log(spark, [(1, 0, b"a", "x"), (1, 1, b"b", "y")]).withColumn("expires_at_unix_ms", F.when(F.col("key") == b"a", 100).cast("long"))
    records = mvcc.fold(df)
    assert sorted(visible(mvcc.unexpired(records, 100))) == [b"b"]
    assert sorted(visible(mvcc.state(records))) == [b"a", b"b"]


def test_range_join_is_that_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(1)
    key = lambda: bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(4)))
    points = [(k, key()) for k in range(80)] + [(80, None)]
    bounds = [(n, *sorted((key(), key()))) for n in range(40)] + [(40, b"b", b"a"), (41, None, b"z")]
    p, r = spark.createDataFrame(points, "id long, key binary"), spark.createDataFrame(bounds, "file_number long, smallest binary, largest binary")
    expected = sorted((i, n) for i, k in points for n, a, b in bounds if k is not None and a is not None and a <= k <= b)
    for cuts in (4096, 5):
        monkeypatch.setattr(ranges, "MAX_CUTS", cuts)
        joined = ranges.range_join(p, r)
        assert sorted((x.id, x.file_number) for x in joined.collect()) == expected
        assert "NestedLoop" not in joined._jdf.queryExecution().toString()
    assert ranges.range_join(p, r.where("false")).count() == ranges.range_join(p.where("false"), r).count() == 0


def test_lower_bound_in_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    key = lambda: bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(5)))
    keys, targets = [(key(),) for _ in range(60)], [(key(),) for _ in range(40)] + [(None,), (b"\xff" * 9,)]
    expected = {t: min((k for (k,) in keys if k >= t), default=None) if t is not None else None for (t,) in targets}
    records, asked = spark.createDataFrame(keys, "key binary"), spark.createDataFrame(targets, "target binary")
    for block in (100_000, 7):
        monkeypatch.setattr(ranges, "BLOCK_TARGETS", block)
        got = {None if r.target is None else bytes(r.target): None if r.key is None else bytes(r.key) for r in files.lower_bound(records, asked).collect()}
        assert got == expected
    assert files.lower_bound(records.where("false"), asked).where("key is not null").count() == files.lower_bound(records, asked.where("false")).count() == 0


def test_oldest_active_is_that_of_running_counts(spark):
    rnd = random.Random(3)
    held, events, expected = Counter(), [], {}
    for n in sorted(rnd.sample(range(2000), 150)):
        free = [s for s, c in held.items() if c]
        seq, delta = (rnd.choice(free), -1) if free and rnd.random() < 0.55 else (rnd.randrange(30), 1)
        held[seq] += delta
        events.append((n, seq, delta))
        expected[n] = min((s for s, c in held.items() if c), default=None)
    df = spark.createDataFrame(events, "event_no long, seq long, delta int")
    assert {r.event_no: r.oldest_active for r in metadata.oldest_active(df).collect()} == expected and None in expected.values()
    assert metadata.oldest_active(df.where("false")).count() == 0


def test_probes_of_keys_outside(spark):
    f = spark.createDataFrame([(2, b"a", b"m"), (3, b"g", b"z")], "file_number long, smallest binary, largest binary")
    asked, hits = spark.createDataFrame([(b"0",), (b"h",), (b"z",), (b"h",)], "key binary"), spark.createDataFrame([(b"h", 3)], "key binary, hit_file long")
    assert {bytes(r.key): r.probes for r in files.probes(asked, f, hits).collect()} == {b"0": 0, b"h": 1, b"z": 1}
