"""The durable store: commit order, recovery, limits, failures and statistics."""

import threading

import pytest

from stratakv.store import ClosedError, CorruptionError, Engine, InvalidArgument, IoError, LockedError, Options, WriteBatch, WriteStall, errors
from stratakv.store import engine, manifest
from stratakv.store.fs import FileSystem
from stratakv.store.manifest import FileMeta, Version, VersionEdit, VersionSet, name, number_of
from stratakv.store.records import frame, frames
from stratakv.store.stats import BlockCache, ReadStats


@pytest.fixture
def store(spark, tmp_path):
    engines = []

    def open_(fs=None, where="db", **options):
        e = Engine(spark, Options(tmp_path / where, **options), fs)
        engines.append(e)
        return e

    yield open_
    for e in engines:
        try:
            e.close()
        except errors.StoreError:
            pass


class Failing(FileSystem):
    """Fails or blocks the chosen operations."""

    def __init__(self):
        self.fail, self.events, self.gate = set(), [], None

    def write(self, file, data):
        self._note("write", file.name)
        super().write(file, data)

    def sync(self, file):
        self._note("sync", file.name)
        super().sync(file)

    def install(self, temporary, path):
        if self.gate and str(path).endswith(".sst"):
            self.gate.wait(30)
        self._note("install", path)
        super().install(temporary, path)

    def remove(self, path):
        self._note("remove", path)
        super().remove(path)

    def _note(self, what, path):
        self.events.append((what, str(path).rsplit(".", 1)[-1] if "." in str(path).rsplit("/", 1)[-1] else str(path).rsplit("/", 1)[-1]))
        if (what, self.events[-1][1]) in self.fail:
            raise IoError(what, path, "injected")


def test_batches_and_snapshots(store):
    db = store()
    before = db.snapshot()
    assert db.write(WriteBatch().put(b"a", b"1").put(b"b", b"2").delete(b"c").put(b"", b"")) == 1
    assert before.get(b"a") is None and before.get(b"b") is None
    assert (db.get(b"a"), db.get(b"b"), db.get(b"c"), db.get(b"")) == (b"1", b"2", None, b"")
    with db.snapshot() as s:
        db.put(b"a", b"new")
        assert (s.get(b"a"), db.get(b"a")) == (b"1", b"new")
        assert db.oldest_active() == 0
    before.release()
    assert db.oldest_active() is None


def test_flush_reopen_and_tombstone(store):
    db = store()
    db.put(b"a\x00z", b"old")
    s1 = db.last_sequence
    db.flush()
    db.put(b"a\x00z", b"new")
    db.flush()
    assert (db.get(b"a\x00z"), db.get_at(b"a\x00z", s1)) == (b"new", b"old")
    db.delete(b"a\x00z")
    db.flush()
    db.close()
    db = store()
    assert db.get(b"a\x00z") is None
    assert db.get_at(b"a\x00z", 2) == b"new"
    assert db.last_sequence == 3
    assert [r.kind for r in db.records().orderBy("seq").collect()] == [1, 1, 0]


def test_unflushed_writes_survive(store):
    db = store(durability="buffered")
    db.put(b"k", b"v")
    db.close()
    db = store()
    assert db.get(b"k") == b"v"
    db.put(b"k", b"w")
    db.close()
    assert store().get(b"k") == b"w"


def test_torn_tail_and_damage(store, tmp_path):
    db = store()
    db.put(b"a", b"1")
    db.put(b"b", b"2")
    wal = tmp_path / "db" / name(db._memtable.wal, "wal")
    db._release()  # as a crash: nothing is noted
    data = wal.read_bytes()
    wal.write_bytes(data[:-3])
    db._closed = True
    again = store()
    assert (again.get(b"a"), again.get(b"b")) == (b"1", None)
    again.put(b"b", b"3")
    again.close()
    assert store(where="db").get(b"b") == b"3"


def test_gap_and_missing_log(spark, tmp_path, store):
    db = store()
    db.put(b"a", b"1")
    wal = tmp_path / "db" / name(db._memtable.wal, "wal")
    db.close()
    good = wal.read_bytes()
    wal.write_bytes(good + frame({"seq": 3, "ops": [["61", "62", None]]}))
    with pytest.raises(CorruptionError, match="expected sequence 2, found 3 in"):
        store()
    wal.write_bytes(good[:10] + b"x" + good[11:])
    with pytest.raises(CorruptionError, match="checksum mismatch"):
        store()
    wal.unlink()
    with pytest.raises(CorruptionError, match="missing required WAL"):
        store()


def test_lock(store):
    store()
    with pytest.raises(LockedError, match="database is locked"):
        store()


def test_closed(store):
    db = store()
    db.close()
    db.close()
    for action in (lambda: db.put(b"a", b"b"), lambda: db.write(WriteBatch()), lambda: db.get(b"a"), db.snapshot, db.flush, db.sync):
        with pytest.raises(ClosedError, match="^database is closed$"):
            action()


def test_limits(store):
    db = store(max_key_bytes=16, max_value_bytes=4, max_batch_bytes=30)
    for batch, message in ((WriteBatch(), "cannot write an empty batch"), (WriteBatch().put(b"k" * 17, b""), "key length 17 exceeds max_key_bytes 16"), (WriteBatch().put(b"k", b"12345"), "value length 5 exceeds max_value_bytes 4"), (WriteBatch().delete(b"k" * 16).delete(b"k" * 15), "write batch payload 31 exceeds max_batch_bytes 30")):
        with pytest.raises(InvalidArgument, match=message):
            db.write(batch)
    with pytest.raises(InvalidArgument, match="key length 17"):
        db.get(b"k" * 17)
    assert db.last_sequence == 0
    with pytest.raises(InvalidArgument, match="block_bytes must be greater than zero"):
        Options("/tmp/none", block_bytes=0).validated()


def test_batch_accounting():
    b = WriteBatch().put(b"alpha", b"one").delete(b"beta").put_with_expiration(b"gamma", b"three", 1234)
    assert (len(b), b.approximate_bytes(), b.is_empty()) == (3, 22, False) or b.approximate_bytes() == sum(map(len, (b"alpha", b"one", b"beta", b"gamma", b"three")))
    assert [(o.key, o.kind, o.expires_at_unix_ms) for o in b.operations()] == [(b"alpha", 1, None), (b"beta", 0, None), (b"gamma", 1, 1234)]


def test_stall_and_order(store):
    fs = Failing()
    fs.gate = threading.Event()
    db = store(fs, memtable_bytes=1, max_immutable_memtables=1)
    db.put(b"a", b"1")
    with pytest.raises(WriteStall, match="write stalled with 1 immutable memtables"):
        db.put(b"b", b"2")
    fs.gate.set()
    db.flush()
    db.put(b"b", b"2")
    db.flush()
    assert (db.get(b"a"), db.get(b"b")) == (b"1", b"2")
    assert fs.events.index(("install", "sst")) < fs.events.index(("remove", "wal"))


def test_write_failure_is_terminal(store):
    fs = Failing()
    db = store(fs)
    db.put(b"a", b"1")
    fs.fail = {("sync", "wal")}
    with pytest.raises(IoError):
        db.put(b"a", b"2")
    fs.fail = set()
    with pytest.raises(IoError):
        db.put(b"a", b"3")
    assert db.get(b"a") == b"1"
    for _ in range(2):
        with pytest.raises(IoError):
            db.close()


def test_background_failure_blocks_reads(store):
    fs = Failing()
    db = store(fs)
    db.put(b"a", b"1")
    fs.fail = {("install", "sst")}
    with pytest.raises(IoError):
        db.flush()
    for action in (lambda: db.get(b"a"), lambda: db.put(b"a", b"2"), db.snapshot):
        with pytest.raises(IoError):
            action()


def test_orphans_go(store, tmp_path):
    db = store()
    db.put(b"a", b"1")
    db.flush()
    db.close()
    stray = tmp_path / "db" / "000099.sst"
    stray.write_bytes(b"x")
    db = store()
    assert not stray.exists() and db.get(b"a") == b"1"


def test_statistics(store, spark):
    db = store()
    db.put(b"k", b"v")
    db.flush()
    assert (db.get(b"k"), db.get(b"outside")) == (b"v", None)
    s = db.stats()
    assert (s.point_reads, s.sstable_probes, s.read_amplification()) == (2, 1, 0.5)
    assert s.frame(spark).first().read_amplification == 0.5
    db.write(WriteBatch().put(b"a", b"").put(b"z", b""))
    db.flush()
    for i in range(20):
        db.get(b"m%d" % i)
    assert s.bloom_useful_negatives > 0
    assert ReadStats().read_amplification() == 0


def test_damaged_table_raises(store, tmp_path):
    db = store()
    db.write(WriteBatch().put(b"k" * 50, b"value" * 50))
    db.flush()
    number = db._set.version.levels[0][0].number
    path = tmp_path / "db" / name(number, "sst")
    data = bytearray(path.read_bytes())
    data[data.index(b"valuevalue") + 3] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(CorruptionError):
        db.get(b"k" * 50)


def test_scan_compact_and_bulk_reads(store, spark):
    db = store(now_ms=lambda: 1000)
    for i in range(4):
        db.write(WriteBatch().put(b"a", b"%d" % i).put(b"b%d" % i, b"x"))
        db.flush()
    db.write(WriteBatch().delete(b"b0").put_with_expiration(b"t", b"x", 1000))
    held = db.snapshot()
    db.put(b"a", b"last")
    db.compact()
    assert [len(files) for files in db._set.version.levels] == [0, 1, 0, 0, 0, 0, 0]
    assert (db.get(b"a"), held.get(b"a")) == (b"last", b"3")
    assert [bytes(r.key) for r in db.scan(b"b", b"c").collect()] == [b"b1", b"b2", b"b3"]
    assert [bytes(r.key) for r in db.scan_prefix(b"b2").collect()] == [b"b2"]
    assert b"t" not in [bytes(r.key) for r in db.unexpired().collect()]
    keys = spark.createDataFrame([(b"a",), (b"none",)], "key binary")
    assert {bytes(r.key): r.value and bytes(r.value) for r in db.multi_get(keys).collect()} == {b"a": b"last", b"none": None}
    assert db.stats().level_table_probes[1] >= 2


def test_compaction_into_disjoint_files(store, tmp_path):
    """Small targets give several sorted files of level 1; reads, snapshots and a second compaction agree."""
    db = store(target_sstable_bytes=3000)
    for i in range(3):
        batch = WriteBatch()
        for k in range(200):
            batch.put(b"key%03d" % k, b"%d-" % i + b"x" * 20)
        db.write(batch)
        db.flush()
    held = db.snapshot()
    db.put(b"key007", b"new")
    db.compact()
    level1 = db._set.version.levels[1]
    assert len(level1) > 2 and not db._set.version.levels[0]
    assert all(a.largest < b.smallest for a, b in zip(level1, level1[1:], strict=False)) and sum(f.entries for f in level1) == 201
    assert (db.get(b"key007"), held.get(b"key007"), db.get(b"key199")[:1], db.get(b"zzz")) == (b"new", b"2-" + b"x" * 20, b"2", None)
    held.release()
    db.compact()
    assert sum(f.entries for f in db._set.version.levels[1]) == db.state().count() == 200
    numbers = {f.number for _, f in db._set.version.files()}
    assert {n for p in (tmp_path / "db").iterdir() if (n := number_of(p.name, "sst"))} == numbers
    db.close()
    assert store(target_sstable_bytes=3000).get(b"key007") == b"new"


def test_exact_records_and_table_filters(store):
    db = store()
    db.put(b"k", b"one")
    db.write(WriteBatch().delete(b"k").put_with_expiration(b"m", b"two", 77))
    db.flush()
    ((_, f),) = db._set.version.files()
    assert db.get_exact(f.number, b"k", 1, 1) == (b"one", None) and db.get_exact(f.number, b"k", 2, 0) == (None, None)
    assert db.get_exact(f.number, b"m", 2, 1) == (b"two", 77)
    assert db.get_exact(f.number, b"k", 1, 0) is db.get_exact(f.number, b"k", 3, 1) is None
    assert db.may_contain(f.number, b"k") and db.may_contain(f.number, b"m") and not db.may_contain(f.number, b"zz")
    with pytest.raises(InvalidArgument):
        db.may_contain(99, b"k")


def test_read_cache(store):
    """A second read of a key asks no file's data; counters show it; older snapshots are not served newer versions."""
    db = store()
    db.put(b"k", b"one")
    first = db.snapshot()
    db.put(b"k", b"two")
    db.delete(b"gone")
    db.flush()
    assert [db.get(b"k"), db.get(b"k"), db.get(b"gone"), first.get(b"k"), first.get(b"k"), db.get(b"k")] == [b"two", b"two", None, b"one", b"one", b"two"]
    data = db.cache.snapshot()["data"]
    assert data["hits"] >= 2 and data["admissions"] >= 2 and data["usage"] > 0 and db.cache.snapshot()["metadata"]["admissions"] == 1


def test_tables_and_edits_are_checked(store, tmp_path, monkeypatch):
    db = store()
    table = engine.MemTable(1)
    with pytest.raises(InvalidArgument, match="at least one"):
        db.build_table(table, 90)
    table.rows = {b"k": [(2, 1, b"", None), (2, 1, b"", None)]}
    with pytest.raises(InvalidArgument, match="rise"):
        db.build_table(table, 90)
    db.put(b"k", b"v")
    db.flush()
    monkeypatch.setattr(manifest, "MAX_EDIT", 10)
    with pytest.raises(InvalidArgument, match="exceeds"):
        db._set.apply(VersionEdit())
    monkeypatch.undo()
    db.close()
    path = next((tmp_path / "db").glob("*.sst"))
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(CorruptionError, match="size"):
        store()


def test_an_option_without_effect_warns(tmp_path):
    with pytest.warns(UserWarning, match="restart_interval"):
        Options(tmp_path, restart_interval=8).validated()


def test_versions():
    m = lambda n, a, b: FileMeta(n, 1, a, b)
    old = Version().apply(VersionEdit().add_file(0, m(2, b"a", b"m")).add_file(0, m(3, b"h", b"z")))
    assert [f.number for f in old.levels[0]] == [3, 2]
    new = old.apply(VersionEdit().delete_file(0, 2))
    assert [f.number for f in new.levels[0]] == [3] and len(old.levels[0]) == 2
    with pytest.raises(InvalidArgument, match="overlap"):
        Version().apply(VersionEdit().add_file(1, m(2, b"a", b"m")).add_file(1, m(3, b"m", b"z")))
    three = Version().apply(VersionEdit().add_file(1, m(3, b"a", b"b")).add_file(1, m(2, b"m", b"n")).add_file(1, m(1, b"y", b"z")))
    assert [(level, f.number) for level, f in three.candidates(b"m")] == [(1, 2)]
    for bad in ((0, 1, b"a", b"b"), (1, 0, b"a", b"b"), (1, 1, b"b", b"a")):
        with pytest.raises(InvalidArgument):
            FileMeta(*bad)


def test_metadata_log(tmp_path):
    fs = FileSystem()
    s = VersionSet.create(tmp_path, fs)
    s.apply(VersionEdit().set(next_file_number=10, last_sequence=20))
    for back in ({"next_file_number": 9}, {"last_sequence": 19}, {"log_number": 3}, {"log_number": 4, "active_log_number": 3}, {"log_number": 10, "active_log_number": 10}):
        with pytest.raises(InvalidArgument):
            s.apply(VersionEdit().set(**back))
    (tmp_path / name(2, "sst")).write_bytes(b"x")
    s.apply(VersionEdit().add_file(0, FileMeta(2, 1, b"a", b"b")))
    s.apply(VersionEdit().delete_file(0, 2))
    with pytest.raises(InvalidArgument, match="already used"):
        s.apply(VersionEdit().add_file(0, FileMeta(2, 1, b"a", b"b")))
    s.close()
    manifest = tmp_path / "MANIFEST-000001"
    whole = manifest.read_bytes()
    manifest.write_bytes(whole + b"torn")
    s = VersionSet.recover(tmp_path, fs)
    assert s.counters["last_sequence"] == 20 and manifest.read_bytes() == whole
    s.close()
    manifest.write_bytes(whole[:-4] + b"x" + whole[-3:])
    with pytest.raises(CorruptionError):
        VersionSet.recover(tmp_path, fs)


def test_names_and_frames():
    assert (name(7, "wal"), name(1234567, "sst"), name(1, "manifest")) == ("000007.wal", "1234567.sst", "MANIFEST-000001")
    assert [number_of(n, "wal") for n in ("000007.wal", "7.wal", "0000007.wal", "000000.wal", "000007.sst")] == [7, None, None, None, None]
    data = frame({"a": 1}) + frame({"a": 2})
    assert [r for r, _ in frames(data, "x", "WAL")] == [{"a": 1}, {"a": 2}]
    assert [r for r, _ in frames(data[:-1], "x", "WAL")] == [{"a": 1}]
    import json
    import zlib

    body = json.dumps({"v": 9}).encode()
    with pytest.raises(errors.UnsupportedFormat, match="unsupported WAL format version 9"):
        list(frames(b"%08x " % zlib.crc32(body) + body + b"\n", "x", "WAL"))


def test_cache():
    c = BlockCache(100)
    assert (c.metadata.capacity, c.data.capacity) == (20, 80)
    assert c.data.insert(("f", 0), "a", 50) and c.data.insert(("f", 1), "b", 40)
    assert (c.data.get(("f", 0)), c.data.get(("f", 1)), c.data.evictions, c.data.usage) == (None, "b", 1, 40)
    assert not c.data.insert(("f", 1), "c", 81) and c.data.get(("f", 1)) == "b"
    with pytest.raises(InvalidArgument):
        BlockCache(0)


def test_messages():
    assert str(errors.IoError("read", "/x", "gone")) == "read failed for /x: gone"
    assert str(errors.CorruptionError("a", "b")) == "corruption in a: b"
    assert str(errors.BackgroundError("x")) == "background worker failed: x"
