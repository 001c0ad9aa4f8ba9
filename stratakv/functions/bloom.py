"""Bloom filter over user keys as Catalyst expressions, and the same arithmetic for the driver and for arrays.

Keys hash by FNV-1a to 64 bits, kept as two 32-bit limbs because overflow raises an error. Probe j
is (low + j * step) mod 2**32 mod bits, where step is the upper limb rotated right by 17, made odd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a offset basis in two limbs, low part of the prime 2**40 + 435, bits kept of a product.
BASIS_HIGH, BASIS_LOW, PRIME_LOW, MASK = 3421674724, 2216829733, 435, 0xFFFFFFFF


def bit_count(entries: int, bits_per_key: int) -> int:
    """At least 64, rounded up to whole bytes."""
    return -(-max(64, entries * bits_per_key) // 8) * 8


def probe_count(bits_per_key: int) -> int:
    return min(30, max(1, bits_per_key * 69 // 100))


def fnv_limbs(key: Column) -> Column:
    """struct(high, low) of the FNV-1a hash of a binary column."""
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("high"), F.lit(BASIS_LOW).cast("long").alias("low"))
    at = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        x = h["low"].bitwiseXOR(F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("long"))
        wide = x * PRIME_LOW
        high = (h["high"] * PRIME_LOW + F.shiftright(wide, 32) + F.shiftleft(x, 8)).bitwiseAND(F.lit(MASK))
        return F.struct(high.alias("high"), wide.bitwiseAND(F.lit(MASK)).alias("low"))

    return F.aggregate(at, start, step)


def start_and_step(key: Column) -> Column:
    """struct(low, step) of the double hashing: where a key's probes start and how far apart they lie."""

    def split(h: Column) -> Column:
        turned = F.shiftright(h["high"], 17).bitwiseOR(F.shiftleft(h["high"].bitwiseAND(F.lit(131071)), 15)).bitwiseAND(F.lit(MASK)).bitwiseOR(F.lit(1))
        return F.struct(h["low"].alias("low"), turned.alias("step"))

    return once(fnv_limbs(key), split)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out a single time, however often it is used: Spark would repeat it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def probes(key: Column, bits: Column, count: int) -> Column:
    """The bit numbers that a key sets."""
    return once(start_and_step(key), lambda h: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: (h["low"] + j * h["step"]).bitwiseAND(F.lit(MASK)) % bits))


def may_contain(key: Column, words: Column, bits: Column, count: int) -> Column:
    """False only for keys that were never added. ``words``: the filter in words of 64 bits, lowest bit first."""
    return F.forall(probes(key, bits, count), lambda b: F.getbit(words[F.shiftright(b, 6).cast("int")], (b % 64).cast("int")) == 1)


def hashes_of(keys: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The start and step of many keys, byte by byte over all of them."""
    if not len(keys):
        return np.array([], np.uint64), np.array([], np.uint64)
    at = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4).astype(np.int64)
    data, size = np.frombuffer(keys.buffers()[2] or b"", np.uint8), np.diff(at)
    h = np.full(len(keys), BASIS_HIGH << 32 | BASIS_LOW, np.uint64)
    rows = np.arange(len(keys))
    for i in range(int(size.max(initial=0))):
        rows = rows[size[rows] > i]
        h[rows] = (h[rows] ^ data[at[rows] + i]) * np.uint64(2**40 + PRIME_LOW)
    low, high = h & np.uint64(MASK), h >> np.uint64(32)
    return low, (high >> np.uint64(17) | high << np.uint64(15)) & np.uint64(MASK) | np.uint64(1)


def build_words(low: np.ndarray, step: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The filter of keys in words of 64 bits."""
    on = np.zeros(-(-bits // 64) * 64, np.uint8)
    for j in range(count):
        on[(low + np.uint64(j) * step & np.uint64(MASK)) % np.uint64(bits)] = 1
    return np.packbits(on, bitorder="little").view("<i8")


def count_negatives(low: np.ndarray, step: np.ndarray, words: np.ndarray, bits: int, count: int) -> int:
    """How many of the keys the filter turns away; a probe is made only of keys that passed those before."""
    octets, left = words.view(np.uint8), len(low)
    for j in range(count):
        bit = (low + np.uint64(j) * step & np.uint64(MASK)) % np.uint64(bits)
        passed = (octets[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        low, step = low[passed], step[passed]
    return left - len(low)


def probes_of(key: bytes, bits: int, count: int) -> list[int]:
    """The driver's form of probes()."""
    h = BASIS_HIGH << 32 | BASIS_LOW
    for b in key:
        h = (h ^ b) * (2**40 + PRIME_LOW) % 2**64
    low, high = h & MASK, h >> 32
    step = (high >> 17 | high << 15) & MASK | 1
    return [((low + j * step) & MASK) % bits for j in range(count)]


class Filter:
    """A built filter: packed bits and the number of probes in the last byte."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 2 or not 1 <= data[-1] <= 30:
            raise ValueError("a filter has bits, and 1 to 30 probes")
        self.data, self.count, self.bits = data, data[-1], (len(data) - 1) * 8

    @classmethod
    def build(cls, set_bits: Iterable[int], bits: int, count: int) -> Filter:
        packed = bytearray(bits // 8)
        for b in set_bits:
            packed[b // 8] |= 1 << b % 8
        return cls(bytes(packed) + bytes([count]))

    def may_contain(self, key: bytes) -> bool:
        return all(self.data[b // 8] >> b % 8 & 1 for b in probes_of(key, self.bits, self.count))
