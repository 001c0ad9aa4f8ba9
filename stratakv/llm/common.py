"""Shared pieces: words as bytes, word hashes, tables written to the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII capitals to small letters, everything else as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Nothing changes.
SAME = bytes(range(256))
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 1 << 20
#: Bytes of a record batch between Spark and Python, unless the session sets its own; Spark's default is 64 MB.
BATCH_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and multiply; constants of public mixers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte value, and the multiplier between the bytes of a word.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x2545F4914F6CDD1D)


def hash_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray = _BYTES) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, start + size), a byte of all runs at a time."""
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    active, at, k = np.arange(len(start)), start, 0
    while len(active):
        out[active] = out[active] * _STEP + numbers[data[at + k]]
        k += 1
        on = size[active] > k
        active, at = active[on], at[on]
    return mix(out)


class Words:
    """The words of a column of texts, as positions and hashes in arrays: no Python object for each word.

    ``fold`` maps bytes before anything else (capitals, punctuation); words are what ASCII white space
    separates. ``bounds[d]`` to ``bounds[d + 1]`` are the words of text d; null texts have none.
    """

    def __init__(self, column: pa.Array, fold: bytes = SAME) -> None:
        if column.null_count:
            column = pc.fill_null(column, "")
        _, offsets, values = column.buffers()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        offset = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(values, np.uint8)[offset[0] : offset[-1]] if values is not None else np.empty(0, np.uint8)
        self.offset = offset - offset[0]
        table = np.frombuffer(fold, np.uint8)
        space = np.isin(np.arange(256), list(SPACES))[table]
        inside = np.append(~space[self.data], False)
        # A text's end separates words too.
        before = np.append(False, inside[:-1])
        edge = self.offset[:-1][self.offset[:-1] < len(self.data)]
        first = inside & ~before
        first[edge] = inside[edge]
        last = before & ~inside
        last[edge] = before[edge]
        self.start, end = np.flatnonzero(first), np.flatnonzero(last)
        self.size = end - self.start
        self.hash = hash_runs(self.data, self.start, self.size, _BYTES[table])
        self.bounds = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.bounds)

    def lines(self) -> np.ndarray:
        """For each word the number of its line in its text, from 0."""
        breaks = np.flatnonzero(self.data == 10)
        return np.searchsorted(breaks, self.start) - np.repeat(np.searchsorted(breaks, self.offset[:-1]), self.count)

    def of(self, values: np.ndarray, d: int, size: int = 1) -> np.ndarray:
        """Text d's part of an array with a value for each word, without those of its last size - 1 words."""
        return values[self.bounds[d] : max(self.bounds[d], self.bounds[d + 1] - size + 1)]

    def shingles(self, size: int):
        """For each text the hashes of its runs of ``size`` words; with fewer words, one for all of them."""
        flat = shingle_hashes(self.hash, size) if len(self.hash) >= size else np.empty(0, np.uint64)
        for d, n in enumerate(self.count.tolist()):
            yield self.of(flat, d, size) if n >= size else shingle_hashes(self.of(self.hash, d), size)


def word_hashes(text: bytes, fold: bytes = SAME) -> np.ndarray:
    return Words(pa.array([text], pa.binary()), fold).hash


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; with fewer words, one for the whole sequence."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def byte_texts(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of that column's strings, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.columns[column]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // limit
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)
        del batch
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, and keeps what it once had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the record batches between Spark and Python, unless the session has a bound of its own.

    Plans take the setting when they run, so it stays set for the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _DEFAULT_BATCH:
        spark.conf.set(key, str(BATCH_BYTES))


_DEFAULT_BATCH = "67108864b"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as the session names it.

    Where it names none, a session on one machine gets a temporary one; on a cluster this is an error,
    since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratakv-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of the tables that scratch() deletes when it ends, innermost last.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows written once as a table in the shared folder and read back: cuts the lineage and survives lost executors.

    ``keep``: it outlives scratch().
    """
    path = f"{shared_folder(df.sparkSession)}/stratakv/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete tables that written() has made; only when everything that reads them is itself written."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that written() makes meanwhile; save what rests on them before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def clear_shared(spark: SparkSession) -> None:
    """Delete what written() has left in the shared folder; only after all results that rest on it are saved."""
    _delete(spark, f"{shared_folder(spark)}/stratakv")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def new_name(wanted: str, *taken: str) -> str:
    """A name like the wanted one that is not among those taken (names compare without case)."""
    known = {x.lower() for x in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def drop_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the columns that a result column of the same name replaces (names compare without case)."""
    taken = {x.lower() for x in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in taken])


def with_results(df: DataFrame, text_col: str, results: T.StructType, make: Callable[[], Callable[[list[bytes]], list[list]]], prefix: str = "") -> DataFrame:
    """All columns of ``df`` and those computed from its texts, batch by batch, without a shuffle.

    ``make`` is called once in each task and returns a function from texts to result columns, whose
    names get the prefix. Result columns replace input columns of the same name.
    """
    results = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in results])
    names = results.fieldNames()
    kept = drop_clashes(df, names)
    at = len(kept.columns)
    # Python functions over batches take plain names alone, so columns go by number on the way.
    wide = df.select(*[column(c).alias(f"c{k}") for k, c in enumerate(kept.columns)], column(text_col).cast("string").alias("text"))
    small_batches(df.sparkSession)
    kinds = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in sliced(batches, at, SLICE_BYTES):
            columns = compute(byte_texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], *[pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)]],
                names=[*batch.schema.names[:at], *[f"r{k}" for k in range(len(names))]],
            )

    made = T.StructType([*wide.schema.fields[:at], *[T.StructField(f"r{k}", f.dataType) for k, f in enumerate(results)]])
    return wide.mapInArrow(run, made).toDF(*kept.columns, *names)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind.simpleString()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
