"""Golden bytes, order and rejections of the versioned key; the filter's arithmetic in both forms."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratakv.functions import bloom, keycodec


def encode(rows):
    return rows.select("*", keycodec.internal_key(F.col("key"), F.col("seq"), F.col("kind")).alias("k"))


def test_golden_bytes(spark):
    df = spark.createDataFrame([(b"a\x00b", 7, 1)], "key binary, seq long, kind byte")
    assert encode(df).first().k.hex() == "6100ff620000fffffffffffffff801"


def model(key, seq, kind):
    return key.replace(b"\x00", b"\x00\xff") + b"\x00\x00" + (2**64 - 1 - seq).to_bytes(8, "big") + bytes([kind])


def test_round_trip_and_order(spark):
    keys = [b"", b"\x00", b"\x00\x00", b"\x00\x01", b"\x01", b"a", b"aa", b"b", b"\xff", b"\x00\xff", b"\xff\x00", b"a\x00"]
    rows = list(itertools.product(keys, [0, 1, 7, 2**40, keycodec.MAX_SEQUENCE], [0, 1]))
    df = encode(spark.createDataFrame(rows, "key binary, seq long, kind byte"))
    out = df.select("*", keycodec.decode_user_key(F.col("k")).alias("u"), keycodec.decode_sequence(F.col("k")).alias("s"), keycodec.decode_kind(F.col("k")).alias("d")).collect()
    for r in out:
        assert bytes(r.k) == model(bytes(r.key), r.seq, r.kind)
        assert (bytes(r.u), r.s, r.d) == (bytes(r.key), r.seq, r.kind)
    by_bytes = [(bytes(r.key), r.seq, r.kind) for r in df.orderBy("k").collect()]
    assert by_bytes == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))


@pytest.mark.parametrize("hexed", ["", "00", "6100ff620000fffffffffffffff802", "61fffffffffffffff801", "610001620000fffffffffffffff801", "610000fffffffffffff801", "610000fffffffffffffff80100", "610000000000000000000001"])
def test_malformed(spark, hexed):
    df = spark.createDataFrame([(bytes.fromhex(hexed),)], "k binary")
    assert not df.select(keycodec.is_valid(F.col("k"))).first()[0]
    with pytest.raises(Exception, match="malformed"):
        df.select(keycodec.decode_user_key(F.col("k"))).collect()


def test_out_of_range(spark):
    for seq, kind in ((-1, 1), (2**63 - 1, 1), (1, 2)):
        with pytest.raises(Exception, match="out of range"):
            encode(spark.createDataFrame([(b"a", seq, kind)], "key binary, seq long, kind byte")).collect()


def test_filter_agrees_with_driver(spark):
    keys = [b"", b"a", b"\x00\xff", *(f"user:{i:08d}".encode() for i in range(200))]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    for r in df.select("key", bloom.probes(F.col("key"), F.lit(5000), 6).alias("p")).collect():
        assert list(r.p) == bloom.probes_of(bytes(r.key), 5000, 6)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(max_size=20), min_size=1, max_size=60), st.integers(1, 20))
def test_no_false_negatives(keys, per_key):
    bits, count = bloom.bit_count(len(keys), per_key), bloom.probe_count(per_key)
    built = bloom.Filter.build((b for k in keys for b in bloom.probes_of(k, bits, count)), bits, count)
    assert all(built.may_contain(k) for k in keys)


def test_filter_sizes():
    assert (bloom.bit_count(1, 10), bloom.bit_count(500, 10), bloom.probe_count(10), bloom.probe_count(1), bloom.probe_count(100)) == (64, 5000, 6, 1, 30)
    for bad in (b"", b"\x01", b"\x00\x00", b"\x00\x1f"):
        with pytest.raises(ValueError):
            bloom.Filter(bad)
