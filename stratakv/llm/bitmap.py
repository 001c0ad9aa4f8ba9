"""A bitmap of hashed keys of a fixed size: says "no" for sure and "perhaps" otherwise."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

#: 8 MB, whatever the number of keys; more keys only make "perhaps" more frequent.
BITS = 1 << 26
#: Beyond so many keys a bitmap says "perhaps" too often, and joins take its place.
MAX_KEYS = 1 << 24


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (bits.bit_length() - 1))


def bitmap_of(keys: DataFrame, bits: int = BITS, key: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> bytes:
    """Compressed bitmap of a column of longs without nulls; ``bits`` is a power of two.

    ``key`` makes the longs of a batch's rows in the same step, if they are no column. Every task marks
    its own keys, four tasks join these bitmaps, and the driver joins those four.
    """
    small_batches(keys.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(np.ascontiguousarray(key(batch) if key else batch.column(0).to_numpy()), bits)
            np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield from _packed(marks)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for k in range(batch.num_rows):
                marks |= np.frombuffer(zlib.decompress(batch.column(0)[k].as_py()), np.uint8)
        yield from _packed(marks)

    marks = np.zeros(bits // 8, np.uint8)
    for (part,) in keys.mapInArrow(run, "marks binary").repartition(4).mapInArrow(join, "marks binary").collect():
        marks |= np.frombuffer(zlib.decompress(part), np.uint8)
    return zlib.compress(marks.tobytes(), 1)


def _packed(marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    if marks.any():
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(marks.tobytes(), 1)], pa.binary())], names=["marks"])


class Bitmap:
    def __init__(self, packed: bytes) -> None:
        self.marks = np.frombuffer(zlib.decompress(packed), np.uint8)
        self.bits = len(self.marks) * 8

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.int64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _places(np.ascontiguousarray(keys), self.bits)
        return (self.marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def left_join_sparse(rows: DataFrame, found: DataFrame, finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, key: str = "key") -> DataFrame:
    """rows left-joined with ``found`` (key and one column of array<int>) and put through ``finish``, where few rows have a partner.

    A bitmap of the partners' keys goes to every task. Rows that have none for sure skip the shuffle,
    and are picked and finished in one step, so that a task has one Python worker. Where many rows have
    a partner, all are joined. ``found`` is a written table.
    """
    if found.count() > MAX_KEYS:
        return rows.join(found.hint("merge"), key, "left").select(*rows.columns, *[c for c in found.columns if c != key]).mapInArrow(finish, schema)
    marks = rows.sparkSession.sparkContext.broadcast(bitmap_of(found.select(key)))
    at, names, (extra,) = rows.columns.index(key), rows.columns, [c for c in found.columns if c != key]

    def picked(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        known = Bitmap(marks.value)
        for batch in batches:
            yield batch.filter(pa.array(known.has(batch.column(at).to_numpy()) == wanted))

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return picked(batches, True)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in picked(batches, False):
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield from finish(iter([pa.RecordBatch.from_arrays([*batch.columns, none], names=[*names, extra])]))

    # A merge join puts the two Python steps into different stages, and so a task has one worker.
    joined = rows.mapInArrow(joining, rows.schema).join(found.hint("merge"), key, "left").select(*names, extra)
    return joined.mapInArrow(finish, schema).unionByName(rows.mapInArrow(alone, schema))
