"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact weighted verification.

Texts and items become words (ASCII letters in small form; other ASCII punctuation separates) and
shingles of five words. A shingle weighs 1 + ln(items / items that hold it) for each
occurrence; shingles that no item holds weigh the most. For each distinct item length, the windows
of that many words of a document get 64-bit SimHash fingerprints. Fingerprints are cut into four
blocks of 16 bits: one within ``radius`` of an item's lies, in at least one block, within
``radius // 4`` bits of it. So each block's index is asked for all values that near, which finds every
item within the radius and few others. Candidates are verified by the weighted Jaccard similarity of
the shingle multisets, ``min_similarity`` or more.

Windows whose known shingles weigh too little to reach the similarity with any item of that length
cannot pass the verification, and get no fingerprint. The items are read in blocks of at most
``block_items`` items and ``block_bytes`` bytes, one pass over the documents for each block. Weights
are those of the whole benchmark: shingles of a single item weigh as much as unknown ones, so a block
needs the counts of those that several items hold, 16 bytes each, which one aggregation gives.
Results do not depend on the blocks. Beside these counts, what is broadcast is bounded however large
the benchmark is.

Defined cases: a null or empty text has no windows; a null or wordless item matches nothing; an item
of fewer than five words is one shingle of all its words; repeated documents or items each count;
rows with a null doc_id are reported with a null doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, column, mix, shingle_hashes, sliced, small_batches, word_hashes, written

SHINGLE = 5
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, end_word long, n_windows long"

#: Capitals to small letters, and ASCII characters that are neither letters nor digits to spaces.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))

#: The table that says "perhaps known" has 2**TABLE_BITS places (4 MB).
TABLE_BITS = 22

#: Blocks of a fingerprint, and the bits of each.
BLOCKS, BLOCK_BITS = 4, 16
#: Windows whose lookups are made at a time.
LOOKUP_WINDOWS = 512

#: No shingles that several items hold.
NONE = (np.empty(0, np.uint64), np.empty(0, np.int64))


def bits_of(values: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each value: 1.0 for a set bit, -1.0 for a clear one."""
    return np.unpackbits(np.ascontiguousarray(mix(values)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def pack_signs(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def flips(radius: int) -> np.ndarray:
    """All values of a block's bits with at most ``radius`` set ones."""
    values = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    return values[np.bitwise_count(values) <= radius]


def held_by(values: np.ndarray, several: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many items hold each shingle, 1 for those that are not among the shingles of several items."""
    shingles, counts = several
    if not len(shingles):
        return np.ones(len(values), np.int64)
    at = np.minimum(np.searchsorted(shingles, values), len(shingles) - 1)
    return np.where(shingles[at] == values, counts[at], 1)


class Items:
    """The fingerprints, weights and block lookups of one block of benchmark items.

    ``holders`` counts the items that hold each shingle of the block, ``others`` (sorted shingles and
    their counts) those of shingles that several items hold, whatever their block.
    """

    def __init__(self, items: list[tuple[int, bytes]], total: int, holders: dict[int, int], radius: int, others: tuple[np.ndarray, np.ndarray] = NONE) -> None:
        self.radius, self.top = radius, 1 + math.log(max(1, total))
        self.total, self.others = total, others
        self.weights = {h: 1 + math.log(total / n) for h, n in holders.items()}
        self.values = np.sort(np.fromiter(holders, np.uint64, len(holders)))
        self.perhaps = np.zeros(1 << TABLE_BITS, bool)
        self.perhaps[(self.values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.by_length: dict[int, dict] = {}
        for item, text in items:
            words = word_hashes(text, FOLD)
            if not len(words):
                continue
            counts = Counter(shingle_hashes(words, SHINGLE).tolist())
            weight = sum(self.weights[h] * n for h, n in counts.items())
            values = np.fromiter(counts, np.uint64, len(counts))
            sums = (bits_of(values) * np.array([self.weights[h] * n for h, n in counts.items()])[:, None]).sum(0, keepdims=True)
            own = self.by_length.setdefault(len(words), {"ids": [], "counts": [], "weights": [], "prints": []})
            for k, v in (("ids", item), ("counts", counts), ("weights", weight), ("prints", int(pack_signs(sums)[0]))):
                own[k].append(v)
        self.flips = flips(radius // BLOCKS)
        for own in self.by_length.values():
            own["prints"] = np.array(own["prints"], np.uint64)
            parts = own["prints"].view(np.uint16).reshape(-1, BLOCKS)
            own["index"] = []
            for k in range(BLOCKS):
                order = np.argsort(parts[:, k], kind="stable")
                own["index"].append((order, parts[order, k]))

    def weigh(self, values: list[int]) -> np.ndarray:
        """The weight of each shingle over the whole benchmark."""
        out = np.array([self.weights.get(v, 0.0) for v in values])
        rest = np.flatnonzero(out == 0)
        if len(rest):
            counts = held_by(np.array([values[k] for k in rest.tolist()], np.uint64), self.others)
            out[rest] = [1 + math.log(self.total / n) if n > 1 else self.top for n in counts.tolist()]
        return out

    def known(self, values: np.ndarray) -> np.ndarray:
        """Where the values are shingles of items: a small table first, then a search."""
        hit = np.flatnonzero(self.perhaps[(values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(hit):
            return hit
        found = self.values[np.minimum(np.searchsorted(self.values, values[hit]), len(self.values) - 1)]
        return hit[found == values[hit]]

    def worth(self, words: Words) -> np.ndarray:
        """The texts with a shingle that some item holds."""
        found = np.zeros(len(words.count), bool)
        for size in {min(SHINGLE, n) for n in self.by_length}:
            if len(words.hash) < size:
                continue
            hit = self.known(shingle_hashes(words.hash, size))
            text = np.searchsorted(words.bounds, hit, side="right") - 1
            found[text[hit + size <= words.bounds[text + 1]]] = True
        return np.flatnonzero(found)

    def candidates(self, prints: np.ndarray, own: dict) -> np.ndarray:
        """Sorted numbers window * items + item of the pairs that agree in a block but for few bits."""
        found, n = [np.empty(0, np.int64)], len(own["ids"])
        for k, (order, values) in enumerate(own["index"]):
            asked = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS)[:, k]
            if n <= len(self.flips):  # fewer items than values to ask for: each item is looked at instead
                a, b = np.nonzero(np.bitwise_count(asked[:, None] ^ values[None, :]) <= self.radius // BLOCKS)
            else:
                probes = (asked[:, None] ^ self.flips[None, :]).ravel()
                low, high = np.searchsorted(values, probes), np.searchsorted(values, probes, side="right")
                count = high - low
                a = np.repeat(np.arange(len(probes)) // len(self.flips), count)
                b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            found.append(a.astype(np.int64) * n + order[b])
        return np.unique(np.concatenate(found))

    def near(self, prints: np.ndarray, own: dict) -> Iterator[tuple[int, int]]:
        """(window, item) of all pairs within the radius, found by blocks."""
        n = len(own["ids"])
        for k in range(0, len(prints), LOOKUP_WINDOWS):
            some = prints[k : k + LOOKUP_WINDOWS]
            a, b = np.divmod(self.candidates(some, own), n)
            close = popcount(some[a] ^ own["prints"][b]) <= self.radius
            yield from zip((a[close] + k).tolist(), b[close].tolist(), strict=True)


def matches(hashes: np.ndarray, items: Items, least: float) -> list[tuple[int, float, int, int, int]]:
    """(item, best similarity, its first and end word, windows that pass) for one document's word hashes."""
    best: dict[int, list] = {}
    grams: dict[int, np.ndarray] = {}
    for length, own in items.by_length.items():
        if length > len(hashes):
            continue
        size = min(SHINGLE, length)
        if size not in grams:
            grams[size] = shingle_hashes(hashes, size)
        values = grams[size]
        hit = items.known(values)
        if not len(hit):
            continue
        weight = np.zeros(len(values) + 1)
        weight[hit + 1] = [items.weights.get(v, 0.0) for v in values[hit].tolist()]
        sums = np.cumsum(weight)
        n = length - size + 1
        # An intersection of least * union is at least this share of either side.
        need = least * min(own["weights"]) - 1e-9
        starts = np.flatnonzero(sums[n:] - sums[:-n] >= need)
        for k in range(0, len(starts), 4096):
            part = starts[k : k + 4096]
            for w, i in items.near(fingerprints(values, part, n, items), own):
                start = int(part[w])
                inside = Counter(values[start : start + n].tolist())
                similarity = weighted_jaccard(inside, own["counts"][i], items)
                if similarity >= least:
                    entry = best.setdefault((length, i), [own["ids"][i], 0.0, 0, 0, 0])
                    entry[4] += 1
                    if similarity > entry[1]:
                        entry[1:4] = similarity, start, start + length
    return [tuple(x) for x in best.values()]


def fingerprints(values: np.ndarray, starts: np.ndarray, n: int, items: Items) -> np.ndarray:
    """SimHash of the n shingles from each start; runs of near starts share their running sums."""
    out = np.empty(len(starts), np.uint64)
    cut = np.flatnonzero(np.diff(starts) > n) + 1
    for run in np.split(np.arange(len(starts)), cut):
        low, high = int(starts[run[0]]), int(starts[run[-1]]) + n
        own = values[low:high]
        weights = items.weigh(own.tolist())
        sums = np.zeros((len(own) + 1, 64))
        np.cumsum(bits_of(own) * weights[:, None], axis=0, out=sums[1:])
        at = starts[run] - low
        out[run] = pack_signs(sums[at + n] - sums[at])
    return out


def weighted_jaccard(a: Counter, b: Counter, items: Items) -> float:
    union = a | b
    weights = dict(zip(union, items.weigh(list(union)).tolist(), strict=True))
    both = sum(weights[h] * min(n, b[h]) for h, n in a.items() if h in b)
    either = sum(weights[h] * n for h, n in union.items())
    return both / either if either else 0.0


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items as they are stored, read one partition at a time, in blocks of a bounded size."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if item is None or text is None:
            continue
        value = text.encode("utf-8", "surrogatepass")
        if block and (len(block) >= block_items or size + len(value) > block_bytes):
            yield block
            block, size = [], 0
        block.append((item, value))
        size += len(value)
    if block:
        yield block


def several_items(benchmark: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than one item holds, sorted, and how many items hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, SLICE_BYTES):
            own = [np.unique(x) for x in Words(batch.column(0), FOLD).shingles(SHINGLE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.uint64).view(np.int64))], names=["h"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("text").cast("string"))
    found = items.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    shingles = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found.column("n").to_numpy()[order]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_similarity: float = 0.8, radius: int = 19, block_items: int = 20_000, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and item that some window of the document resembles.

    Weights are those of all items, however the items are dealt to blocks.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(docs.sparkSession, benchmark, block_items, block_bytes):
        found = rows.mapInArrow(_finder(block, radius, min_similarity), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, *, min_similarity: float = 0.8, radius: int = 19, block_items: int = 20_000, block_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window resembles an item; no shuffle.

    Of several blocks each reads what the one before it has left, written to the shared folder.
    """
    for k, block in enumerate(_blocks(docs.sparkSession, benchmark, block_items, block_bytes)):
        left = written(docs, "without-block") if k else docs
        # Python functions over batches take plain names alone, so columns go by number on the way.
        rows = left.select(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], column(text_col).cast("string").alias("text"))
        docs = rows.mapInArrow(_keeper(block, radius, min_similarity), rows.drop("text").schema).toDF(*docs.columns)
    return docs


class _Block:
    """A block of items on its way to the executors, with what its weights need of the others."""

    def __init__(self, spark: SparkSession, block: list[tuple[int, bytes]], total: int, several: Broadcast | None) -> None:
        self.shared, self.total, self.several = spark.sparkContext.broadcast(block), total, several

    def items(self, radius: int) -> Items:
        holders = Counter(h for _, text in self.shared.value for h in set(shingle_hashes(word_hashes(text, FOLD), SHINGLE).tolist()))
        others = self.several.value if self.several else NONE
        if self.several:
            own = np.fromiter(holders, np.uint64, len(holders))
            holders = dict(zip(own.tolist(), held_by(own, others).tolist(), strict=True))
        return Items(self.shared.value, self.total, holders, radius, others)


def _blocks(spark: SparkSession, benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[_Block]:
    small_batches(spark)
    blocks = item_blocks(benchmark, block_items, block_bytes)
    ahead = list(islice(blocks, 2))
    total, several = len(ahead[0]) if ahead else 0, None
    if len(ahead) > 1:
        total = benchmark.where("item_id is not null and text is not null").count()
        several = spark.sparkContext.broadcast(several_items(benchmark))
    for block in chain(ahead, blocks):
        yield _Block(spark, block, total, several)


def _finder(block: _Block, radius: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.items(radius)
        kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 3]
        for batch in sliced(batches, 1, SLICE_BYTES):
            out, ids, words = [], batch.column(0), Words(batch.column(1), FOLD)
            for d in items.worth(words).tolist():
                out += [(ids[d].as_py(), *m) for m in matches(words.of(words.hash, d), items, least)]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "end_word", "n_windows"])

    return run


def _keeper(block: _Block, radius: int, least: float):
    """Batches without the rows that match; their last column is the text and does not go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.items(radius)
        for batch in sliced(batches, -1, SLICE_BYTES):
            words = Words(batch.column(batch.num_columns - 1), FOLD)
            stays = np.ones(batch.num_rows, bool)
            for d in items.worth(words).tolist():
                stays[d] = not matches(words.of(words.hash, d), items, least)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield rest.filter(pa.array(stays))

    return run
