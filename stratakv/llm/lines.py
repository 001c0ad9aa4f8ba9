"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words. A line within the edit bound of a line that occurs earlier in the corpus,
or equal to one, is removed; only the earliest stays. The bound is relative: one word edit (a word
replaced, added or left out) for ``min_words`` words or more, and so none for fewer, where one word is
a large part of a line. Order is by doc_id, then by
the text's key, then by line; whether a line is removed depends on the input alone, not on what else
is removed.

Equal lines are found by their hash. For the rest every line gives the hashes of all sequences with
one word left out, and its own. Two lines within the bound share one of these: with the same word
position left out on both sides, or with nothing left out on one. The keys of a bucket meet as packed
blocks, and each line learns its earliest partner; no pairs of a group are listed. Lines with an equal
variant within one slice of a task answer each other there, and only the earliest of them goes on: a
template that a third of all lines follow sends one entry a slice. The partners' and the line's words
are then compared, and the edit distance decides; a line's candidates from all its variants count.

Two sure tests keep the join small: only the first occurrence of a line takes part, and only if half
of it (its first or last words) also begins or ends another line; one edit leaves a half as it was.
Both come as bitmaps of a fixed size that can only let too much pass; where there are more lines than
these hold, a join with the table of lines tells the documents which of theirs take part.

Defined cases: a null text has no lines; lines without words are never removed; rows with the same
id and text count as one document and get the same result; rows with a null doc_id come last in the
order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmap import MAX_KEYS, Bitmap, bitmap_of, left_join_sparse
from .common import Words, byte_texts, column, mix, sliced, written
from .substrings import BASE, BASE_INVERSE, powers, row_keys

LENGTH = np.uint64(0xD6E8FEB86659FD93)
HEAD, TAIL = np.uint64(1), np.uint64(2)
SLICE_BYTES = 1 << 20
#: Variant keys for each bucket.
BUCKET_KEYS = 2_000_000
WHOLE = 2**32 - 1


class Hashed:
    """The lines with words of a column of texts, and hashes of any run of a line's words."""

    def __init__(self, column: pa.Array) -> None:
        words = Words(column)
        n, text, line = len(words.hash), np.repeat(np.arange(len(words.count)), words.count), words.lines()
        new = np.ones(n, bool)
        new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], n) if n else self.start
        self.row, self.line, self.count = text[self.start], line[self.start], self.end - self.start
        self.down = powers(BASE_INVERSE, n + 2)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * powers(BASE, n), out=self.sums[1:])

    def run(self, a: np.ndarray, b: np.ndarray, kind: np.uint64 = np.uint64(0)) -> np.ndarray:
        """Hashes of the word runs [a, b); kinds never meet."""
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * LENGTH + kind)

    def whole(self) -> np.ndarray:
        return self.run(self.start, self.end)

    def halves(self, chosen: np.ndarray) -> np.ndarray:
        """Four keys a line: first and last words, for half of the length and of one less."""
        a, b, n = self.start[chosen], self.end[chosen], self.count[chosen]
        return np.stack([x for m in (n // 2, (n - 1) // 2) for x in (self.run(a, a + m, HEAD), self.run(b - m, b, TAIL))], 1)

    def variants(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, word left out, key) of the chosen lines with each word left out, and with none."""
        n = self.count[chosen]
        owner = np.repeat(chosen, n)
        out = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = self.start[owner], self.end[owner]
        at = a + out
        rest = (self.sums[at] - self.sums[a]) * self.down[a] + (self.sums[b] - self.sums[at + 1]) * self.down[a + 1]
        keys = mix(rest + (b - a - 1).astype(np.uint64) * LENGTH)
        return np.append(owner, chosen), np.append(out, np.full(len(chosen), WHOLE)), np.append(keys, self.run(self.start[chosen], self.end[chosen]))


def occurrence(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash that names a line of a document, for bitmaps."""
    return mix(key.view(np.uint64) + line.astype(np.uint64) * LENGTH).view(np.int64)


def line_table(rows: DataFrame, min_words: int) -> DataFrame:
    """A row per line with words: key, rank (doc_id, nulls last), line, whole, occ, and its half keys if it is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, SLICE_BYTES):
            keys, ranks = (batch.column(i).to_numpy() for i in range(2))
            h = Hashed(batch.column(2))
            long_ = np.flatnonzero(h.count >= min_words)
            flat = h.halves(long_).view(np.int64).ravel()
            offsets = np.append(0, np.cumsum(np.where(h.count >= min_words, 4, 0))).astype(np.int32)
            whole = h.whole().view(np.int64)
            own = keys[h.row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(ranks[h.row]), pa.array(h.line.astype(np.int32)), pa.array(whole), pa.array(occurrence(own, h.line)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["key", "rank", "line", "whole", "occ", "halves"],
            )

    return rows.select("key", "rank", "text").mapInArrow(run, "key long, rank long, line int, whole long, occ long, halves array<long>")


BLOCK = "bucket int, kind int, data binary"
PARTNERS = "key long, line int, other_key long, other_line int"
_PAIR = np.dtype([("key", "<i8"), ("line", "<i4"), ("other_key", "<i8"), ("other_line", "<i4")])
_ENTRY = np.dtype([("key", "<u8"), ("row", "<i8"), ("rank", "<i8"), ("line", "<u4"), ("out", "<u4")])
ENTRIES, PAIRS = range(2)


def partners(rows: DataFrame, marks: tuple[bytes, bytes] | None, n_buckets: int, min_words: int) -> DataFrame:
    """(key, line, other_key, other_line): for each variant of a line the earliest earlier line with an equal one, if there is one.

    ``marks``: bitmaps of the lines that come first and of the halves that lines share; without them,
    ``rows`` have the lines that take part in a column ``lines``.
    """
    spread = rows.sparkSession.sparkContext.broadcast(marks) if marks else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, halves = map(Bitmap, spread.value) if spread else (None, None)
        for batch in sliced(batches, 2, SLICE_BYTES):
            keys, ranks = (batch.column(i).to_numpy() for i in range(2))
            h = Hashed(batch.column(2))
            if spread:
                able = np.flatnonzero((h.count >= min_words) & firsts.has(occurrence(keys[h.row], h.line)))
                able = able[halves.has(h.halves(able).view(np.int64).ravel()).reshape(-1, 4).any(1)]
            else:
                asked = batch.column(3)
                pairs = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy()) * 2**32 + asked.flatten().to_numpy()
                able = np.flatnonzero(np.isin(h.row * 2**32 + h.line, pairs))
            # A few lines at a time, so that a slice's variants stay small.
            for part in np.split(able, np.flatnonzero(np.diff(np.cumsum(h.count[able]) // 100_000)) + 1):
                if not len(part):
                    continue
                owner, out, variants = h.variants(part)
                entries = np.empty(len(owner), _ENTRY)
                entries["key"], entries["row"], entries["rank"], entries["line"], entries["out"] = variants, keys[h.row[owner]], ranks[h.row[owner]], h.line[owner], out
                entries, known = reduced(entries)
                bucket = ((entries["key"] >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                entries, bucket = entries[order], bucket[order]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                out = [(int(bucket[a]), ENTRIES, pack(entries[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                if len(known):
                    out.append((int(bucket[0]), PAIRS, known.tobytes()))
                for k in range(0, len(out), 64):
                    columns = zip(*out[k : k + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])

    def meet(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        known = [np.frombuffer(d, _PAIR) for d in frame["data"][frame["kind"] == PAIRS]]
        entries = [unpack(d) for d in frame["data"][frame["kind"] == ENTRIES]]
        found = np.unique(np.concatenate([*known, *([earliest(np.concatenate(entries))] if entries else [])]))
        return pd.DataFrame({n: found[n] for n in _PAIR.names})

    blocks = rows.select("key", "rank", "text", *([] if marks else ["lines"])).mapInArrow(emit, BLOCK)
    return blocks.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(meet, PARTNERS)


def reduced(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest entry of each (key, word left out), and the pairs that the others make with it.

    Whatever meets one of the others meets the earliest too, which is older.
    """
    e = e[np.lexsort((e["line"], e["row"], e["rank"], e["out"], e["key"]))]
    first = np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["out"][1:] != e["out"][:-1]))
    earliest_ = e[first][np.cumsum(first) - 1]
    other = ~first & ((e["row"] != earliest_["row"]) | (e["line"] != earliest_["line"]))
    return e[first], np.unique(_pairs(e[other], earliest_[other]))


def _pairs(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = np.empty(len(own), _PAIR)
    out["key"], out["line"], out["other_key"], out["other_line"] = own["row"], own["line"], other["row"], other["line"]
    return out


def pack(entries: np.ndarray) -> bytes:
    """Entries with the documents named once: their number, keys, ranks and sizes, then lines, words and keys."""
    start = np.flatnonzero(np.append(True, (entries["row"][1:] != entries["row"][:-1]) | (entries["rank"][1:] != entries["rank"][:-1])))
    sizes = np.diff(np.append(start, len(entries))).astype(np.uint32)
    head = np.array([len(start), len(entries)], np.uint32)
    return b"".join(x.tobytes() for x in (head, entries["row"][start], entries["rank"][start], sizes, entries["line"], entries["out"], entries["key"]))


def unpack(data: bytes) -> np.ndarray:
    docs, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    out, at = np.empty(n, _ENTRY), 8
    parts = []
    for kind, count in ((np.int64, docs), (np.int64, docs), (np.uint32, docs), (np.uint32, n), (np.uint32, n), (np.uint64, n)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    out["row"], out["rank"] = np.repeat(parts[0], parts[2]), np.repeat(parts[1], parts[2])
    out["line"], out["out"], out["key"] = parts[3:]
    return out


def earliest(e: np.ndarray) -> np.ndarray:
    """For entries with an earlier partner of an equal key: that partner, the earliest of them.

    A whole line goes with every other entry of its key; one with a word left out goes with whole
    lines and with those that leave out the same position.
    """
    by_age = np.lexsort((e["line"], e["row"], e["rank"]))
    e = e[by_age]
    new = np.append(True, (e["rank"][1:] != e["rank"][:-1]) | (e["row"][1:] != e["row"][:-1]) | (e["line"][1:] != e["line"][:-1]))
    age = np.cumsum(new)  # the same for entries of one line
    never = len(e) + 1

    def least(chosen: np.ndarray, groups: np.ndarray) -> np.ndarray:
        found = np.full(groups.max() + 1 if len(groups) else 0, never)
        np.minimum.at(found, groups[chosen], age[chosen])
        return found[groups]

    _, group = np.unique(e["key"], return_inverse=True)
    whole = e["out"] == WHOLE
    _, place = np.unique(group.astype(np.uint64) * np.uint64(WHOLE + 1) + e["out"].astype(np.uint64), return_inverse=True)
    best = np.minimum(least(whole, group), np.where(whole, least(~whole, group), least(~whole, place)))
    hit = np.flatnonzero(best < age)
    first = np.flatnonzero(new)
    return _pairs(e[hit], e[first[best[hit] - 1]])


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word replaced, added or left out makes the sequences equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, line) of the pairs whose lines are within one edit, by their words."""
    wanted = written(pairs.select("key", "line").union(pairs.select("other_key", "other_line")).distinct(), "wanted-lines")

    def named(batch: pa.RecordBatch) -> np.ndarray:
        return occurrence(np.ascontiguousarray(batch.column(0).to_numpy()), batch.column(1).to_numpy())

    few, share = wanted.count() <= MAX_KEYS, rows.sparkSession.sparkContext.broadcast
    marks, needed = (share(bitmap_of(wanted.select("key").distinct())), share(bitmap_of(wanted.select("key", "line"), key=named))) if few else (None, None)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lines = (Bitmap(marks.value), Bitmap(needed.value)) if few else (None, None)
        for batch in sliced(batches, 1, SLICE_BYTES):
            picked = batch.filter(pa.array(docs.has(batch.column(0).to_numpy()))) if few else batch
            out = [(k, n, line) for k, t in zip(picked.column(0).to_pylist(), byte_texts(picked.column(1)), strict=True) for n, line in enumerate(t.split(b"\n")) if line.split()]
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["key", "line", "words"])
            yield made.filter(pa.array(lines.has(occurrence(np.array(columns[0], np.int64), np.array(columns[1], np.int64))))) if few else made

    picked = rows if few else rows.join(wanted.select("key").distinct(), "key", "left_semi")
    found = picked.select("key", "text").mapInArrow(texts, "key long, line int, words binary")
    found = found if few else found.join(wanted, ["key", "line"], "left_semi")
    found = written(found.dropDuplicates(["key", "line"]), "line-texts")
    other = found.select(F.col("key").alias("other_key"), F.col("line").alias("other_line"), F.col("words").alias("others"))
    both = pairs.join(found, ["key", "line"]).join(other, ["other_key", "other_line"]).select("key", "line", "words", "others")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([within_one_edit(x.split(), y.split()) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return both.mapInArrow(compare, "key long, line int")


def removed_lines(rows: DataFrame, min_words: int) -> DataFrame:
    """(key, line) of every line that goes."""
    lines = written(line_table(rows, min_words), "lines")
    age = F.struct("rank", "key", "line")
    firsts = written(lines.groupBy("whole").agg(F.min(F.struct("rank", "key", "line", "occ")).alias("first")), "first-lines")
    equal = lines.select("whole", age.alias("own")).join(firsts, "whole").where(F.col("own") > F.struct("first.rank", "first.key", "first.line")).select("own.key", "own.line")
    halves = lines.where("size(halves) > 0").select("whole", F.explode("halves").alias("half")).groupBy("half").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    able = lines.where("size(halves) > 0").select(F.sum(F.lit(60.0))).first()[0] or 0.0
    n_buckets = int(min(2**20, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), able // BUCKET_KEYS + 1)))
    if firsts.count() <= MAX_KEYS:
        found = partners(rows, (bitmap_of(firsts.select("first.occ")), bitmap_of(halves.select("half"))), n_buckets, min_words)
    else:
        own = lines.where("size(halves) > 0").select("key", "line", "occ", F.explode("halves").alias("half")).join(halves.select("half"), "half", "left_semi")
        chosen = own.join(firsts.select("first.occ"), "occ", "left_semi").groupBy("key").agg(F.collect_set("line").alias("lines"))
        found = partners(rows.join(chosen, "key"), None, n_buckets, min_words)
    pairs = written(found.distinct(), "line-pairs")
    return equal.union(verified(rows, pairs))


def line_dedup(docs: DataFrame, *, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines (with words), removed line numbers from 0, and the text that is left, for every row.

    ``carry``: columns of the input to go along, in a struct named ``rest``.
    """
    rest = F.struct(*[column(c) for c in carry or []]) if carry else F.lit(None).cast("int")
    own = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), rest.alias("rest"))
    rows = row_keys(own, "doc_id", "text", "rest").withColumn("rank", F.coalesce("doc_id", F.lit(2**63 - 1)))
    gone = removed_lines(rows, min_words).groupBy("key").agg(F.array_sort(F.collect_set("line")).alias("removed"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch], batch.schema.get_field_index("text"), SLICE_BYTES):
                of = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                out = []
                for text, removed in zip(byte_texts(of("text")), of("removed").to_pylist(), strict=True):
                    split, gone_ = text.split(b"\n"), set(removed or ())
                    left = b"\n".join(x for k, x in enumerate(split) if k not in gone_) if removed else text
                    out.append((sum(bool(x.split()) for x in split), removed or [], left.decode("utf-8", "replace")))
                columns = list(zip(*out, strict=True)) if out else [()] * 3
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([of("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], of("rest")], names=["doc_id", "n_lines", "removed", "text", "rest"])

    result = T.StructType().add("doc_id", "long").add("n_lines", "long").add("removed", T.ArrayType(T.IntegerType())).add("text", "string").add(rows.schema["rest"])
    out = left_join_sparse(rows, written(gone, "removed-lines"), cut, result)
    return out if carry else out.drop("rest")


def digest(result: DataFrame) -> DataFrame:
    """The result with the removed lines as a comma-joined string and the remaining text as a digest."""
    return result.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
