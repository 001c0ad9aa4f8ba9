"""Files and their ranges where all ranges meet: the work may not grow with the pairs of keys and files."""

import random

import pytest

from stratakv.functions import bloom
from stratakv.operators import files, ranges


@pytest.fixture
def few_cuts(monkeypatch):
    monkeypatch.setattr(ranges, "MAX_CUTS", 3)


def some_files(rnd, numbers):
    key = lambda: bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(4)))
    return [(n, *sorted((key(), key()))) for n in numbers], [key() for _ in range(60)]


def without_pairs(monkeypatch):
    def refuse(*_):
        raise AssertionError("a row for each key and file")

    monkeypatch.setattr(files, "range_join", refuse)


@pytest.mark.parametrize("numbers", [range(5, 45), [7], [3, 1000, 1001]])
def test_probes_without_a_row_for_each_key_and_file(spark, few_cuts, monkeypatch, numbers):
    rnd = random.Random(4)
    fs, keys = some_files(rnd, numbers)
    hits = {k: rnd.randrange(60) for k in sorted(set(keys)) if rnd.random() < 0.7}
    without_pairs(monkeypatch)
    f, asked = spark.createDataFrame(fs, "file_number long, smallest binary, largest binary"), spark.createDataFrame([(k,) for k in keys], "key binary")
    got = files.probes(asked, f, spark.createDataFrame(list(hits.items()), "key binary, hit_file long"))
    assert {bytes(r.key): r.probes for r in got.collect()} == {k: sum(a <= k <= b and n >= hits.get(k, 0) for n, a, b in fs) for k in keys}


@pytest.mark.parametrize("block", [256, 3])
def test_overlap_pairs_come_up_once_and_without_a_join_of_ranges(spark, few_cuts, monkeypatch, block):
    fs, _ = some_files(random.Random(5), range(40))
    fs += [(40 + n, b"", b"\xff" * 3) for n in range(9)] + [(50, b"aaaa", b"aaaa")]
    without_pairs(monkeypatch)
    monkeypatch.setattr(files, "OVERLAP_BLOCK", block, raising=False)
    f = spark.createDataFrame(fs, "file_number long, smallest binary, largest binary")
    expected = sorted((i, j) for i, a, b in fs for j, c, d in fs if i < j and a <= d and c <= b)
    assert sorted((r.file_a, r.file_b) for r in files.overlap_pairs(f).collect()) == expected
    assert files.overlap_pairs(f.where("false")).count() == 0


def stored(spark, numbers):
    fs, keys = some_files(random.Random(6), numbers)
    held = {n: sorted({k for k in keys[n % 5 :: 3] if a <= k <= b} | {a, b}) for n, a, b in fs}
    return fs, sorted(set(keys)), held, spark.createDataFrame([(n, k) for n, ks in held.items() for k in ks * (1 + 40 * (n % 7 == 0))], "file_number long, key binary")


def python_filters(held, repeats=lambda n: 1 + 40 * (n % 7 == 0)):
    count = bloom.probe_count(10)
    sizes = {n: bloom.bit_count(len(ks) * repeats(n), 10) for n, ks in held.items()}
    return {n: bloom.Filter.build((b for k in ks for b in bloom.probes_of(k, sizes[n], count)), sizes[n], count) for n, ks in held.items()}


@pytest.mark.parametrize("block, tile", [(16_384, 1 << 21), (4, 256)])
def test_filter_negatives_are_those_of_each_key_and_file(spark, few_cuts, monkeypatch, block, tile):
    fs, keys, held, records = stored(spark, range(30))
    monkeypatch.setattr(files, "KEY_BLOCK", block, raising=False)
    monkeypatch.setattr(files, "TILE_BITS", tile, raising=False)
    without_pairs(monkeypatch)
    f = spark.createDataFrame(fs, "file_number long, smallest binary, largest binary")
    got = files.filter_negatives(spark.createDataFrame([(k,) for k in keys], "key binary"), f, files.filter_bits(records, 10), 10)
    filters = python_filters(held)
    inside = {n: [k for k in keys if a <= k <= b] for n, a, b in fs}
    expected = {n: (len(ks), sum(not filters[n].may_contain(k) for k in ks)) for n, ks in inside.items() if ks}
    assert {r.file_number: (r.checks, r.useful_negatives) for r in got.collect()} == expected and any(m for _, m in expected.values())


def test_filter_check_has_one_row_for_a_lookup_and_hashes_it_once(spark):
    _, keys, held, records = stored(spark, range(30))
    asked = spark.createDataFrame([(n, k) for n in held for k in [*keys, b"", b"absent", b"\xff\x00" * 40]], "file_number long, key binary")
    filters, lookups = python_filters(held), files.filter_check(asked, files.filter_bits(records, 10), 10)
    assert all(r.maybe == filters[r.file_number].may_contain(bytes(r.key)) for r in lookups.collect())
    plan = lookups._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("aggregate(") == 1
