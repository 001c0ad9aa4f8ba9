"""N-gram Jaccard join: a grouped prefix join that keeps every link and never lists a group's pairs.

A document's set holds the 64-bit hashes of its distinct word shingles; equal sets are one class.
Sets are ordered by (frequent, hash): with n elements and a bound t, two linked sets share an element
of their first n - ceil(t * n) + 1. Classes with the same prefix and size form a group, and only
groups are joined on prefix elements.

A bucket (prefix element, size band) names its earliest group as pivot, and each group goes to the
earliest pivot that shares a tenth of its prefix. In this star every member is verified against the
pivot with whole sets. Two members that both link to the pivot are connected already. For any other
pair of the star there is a short cut that loses nothing: if u is not linked to the pivot and v links
to u, then the differences of u and v to the pivot share an element. (With disjoint differences
|u ^ v| = |u ^ p| + |v ^ p| and |u | v| <= |u | p| + |v ^ p|, so the distance of u and v exceeds the
bound as that of u and p does.) So only members with common differences are compared, by counting in
inverted lists. Stars of any size are cut into chunks; between chunks only the members that are not
linked to the pivot are asked of all others, and where there are none, nothing moves.

All groups of one star have it in common, so pairs of different stars are pairs of groups: they are
joined bucket by bucket with size and position filters and checked on their prefixes. Only the pairs
of groups that are left are expanded to members, whose sets are verified.

Defined cases: null or wordless texts have an empty set and link with nothing; rows with a null id
take part and come last in the order, and a component of such rows alone has a null id; repeated rows
and equal texts are one class; a text with fewer words than a shingle is one shingle of all its words;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import MAX_KEYS, Bitmap, bitmap_of
from .common import LOWER, SLICE_BYTES, Words, column, freed, sliced, small_batches, written
from .components import connected

#: Frequent elements that are put last in the order; at most so many are broadcast (8 bytes each).
MAX_FREQUENT = 1 << 20
#: An element in fewer documents than this never counts as frequent.
LEAST_FREQUENT = 16
#: Members and set elements of one chunk of a star.
CHUNK_MEMBERS, CHUNK_ELEMENTS = 2048, 2_000_000
#: Low elements over which a task counts frequent ones at a time.
COUNT_ELEMENTS = 400_000
#: Where a null id stands in the order.
LAST = 2**63 - 1


class Rule:
    """Shingle size and the bound ``num / den`` on the Jaccard similarity, in whole numbers."""

    def __init__(self, shingle: int, num: int, den: int) -> None:
        self.shingle, self.num, self.den = shingle, num, den

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def prefix(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1

    def first(self, elements: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
        """The prefix of a sorted set in the order (frequent, hash), and how many of it are rare."""
        size, last = self.prefix(len(elements)), np.zeros(len(elements), bool)
        if len(frequent):
            last = frequent[np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)] == elements
        rare = elements[~last]
        return np.concatenate([rare, elements[last]])[:size], min(size, len(rare))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's set, sorted."""
    return map(np.unique, Words(column, LOWER).shingles(size))


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the elements that hash to it: two sets differ in at least as many elements as bits."""
    counts = np.bincount((elements >> np.uint64(24) & np.uint64(255)).astype(np.int64), minlength=256)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def identity(values: np.ndarray, seed: int) -> tuple[int, int]:
    """A 128-bit hash as an id and what tells equal ids apart."""
    high, low = divmod(xxhash.xxh3_128_intdigest(values.tobytes(), seed=seed), 2**64)
    return low - 2**63, high - 2**63


def class_id(elements: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """The id of a set's class; of an id that different sets share, mixed with the other half of its hash."""
    cid, check = identity(elements, len(elements))
    return cid ^ check if cid in shared else cid


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return rows.withColumns(dict(zip(("key", "key2"), row_name("doc_id", "text"), strict=True)))


def row_name(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text together."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(doc_id, whole), F.xxhash64(whole, F.lit(1), doc_id)


def frequent_elements(rows: DataFrame, rule: Rule) -> np.ndarray:
    """Elements of the low part of the hash order, where prefixes lie, that many documents hold.

    Documents are counted over the whole table; an element that occurs once
    in a stretch of the table is not counted there. Any choice gives right results, a good one gives short buckets.
    """
    low = np.uint64(int(2**64 * min(0.999, 1.25 * (1 - rule.num / rule.den))))

    def counted(seen: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(seen) if seen else np.empty(0, np.uint64), return_counts=True)
        keep = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["e", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = [], 0
        for batch in sliced(batches, 0, SLICE_BYTES):
            for s in shingle_sets(batch.column(0), rule.shingle):
                seen.append(s[s < low])
                size += len(seen[-1])
            if size > COUNT_ELEMENTS:
                yield counted(seen)
                seen, size = [], 0
        yield counted(seen)

    counts = written(rows.select("text").mapInArrow(run, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT), "frequent")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # No more than MAX_FREQUENT elements can each have that share of the total.
    most = counts.where(F.col("n") >= max(LEAST_FREQUENT, -(-total // MAX_FREQUENT))).select("e").toPandas()
    freed(counts)
    return np.sort(most["e"].to_numpy(np.int64).view(np.uint64))


def signatures(rows: DataFrame, rule: Rule, frequent: Broadcast) -> DataFrame:
    """doc_id, set size, class, group and prefix of every document; sets stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SLICE_BYTES):
            out = []
            for elements in shingle_sets(batch.column(1), rule.shingle):
                n = len(elements)
                if not n:
                    out.append((0, *[None] * 7))
                    continue
                prefix, rare = rule.first(elements, frequent.value)
                out.append((n, *identity(elements, n), *identity(prefix, n), rare, prefix.view(np.int64), parity_bits(elements)))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "key", "key2", "n", "cid", "check", "grp", "grp_check", "rare", "prefix", "bits"])

    return rows.select("doc_id", "text", "key", "key2").mapInArrow(run, "doc_id long, key long, key2 long, n int, cid long, check long, grp long, grp_check long, rare int, prefix array<long>, bits array<long>")


def told_apart(signed: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """The signatures with different ids for different sets and prefixes, and the class ids that were shared.

    64 bits are shared by a few dozen of 10^10 sets, so these come to the driver; where there are none,
    as a rule, nothing changes.
    """
    found = {}
    for c, check in (("cid", "check"), ("grp", "grp_check")):
        twice = signed.where("n > 0").groupBy(c).agg(F.min(check).alias("a"), F.max(check).alias("b")).where("a <> b")
        found[c] = frozenset(r[0] for r in twice.select(c).collect())
        if found[c]:
            signed = signed.withColumn(c, F.when(F.col(c).isin(list(found[c])), F.col(c).bitwiseXOR(F.col(check))).otherwise(F.col(c)))
    return signed.drop("check", "grp_check"), found["cid"]


def sets_of(rows: DataFrame, rule: Rule, keys: DataFrame, most: int, shared: frozenset[int]) -> DataFrame:
    """(cid, n, elements) of the rows whose keys, ``most`` at most, are asked for, and of a few more.

    Few keys pick their rows by a bitmap without a shuffle, many by a join.
    """
    packed = rows.sparkSession.sparkContext.broadcast(bitmap_of(keys)) if most <= MAX_KEYS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Bitmap(packed.value) if packed else None
        for batch in sliced(batches, 1, SLICE_BYTES):
            picked = batch.filter(pa.array(marks.has(batch.column(0).to_numpy()))) if marks else batch
            sets = [s for s in shingle_sets(picked.column(1), rule.shingle) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s, shared) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "n", "elements"])

    asked = rows if packed else rows.join(keys.distinct(), "key", "left_semi")
    return asked.select("key", "text").mapInArrow(run, "cid long, n int, elements binary")


def _differences(member: np.ndarray, pivot: np.ndarray) -> tuple[int, np.ndarray]:
    """Size of the intersection, and the elements of exactly one of the two sets."""
    both = np.intersect1d(member, pivot, assume_unique=True)
    return len(both), np.setxor1d(member, pivot, assume_unique=True)


def star_links(cids: list[int], sizes: list[int], tied: list[bool], differences: list[np.ndarray], rule: Rule, home: np.ndarray | None = None, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a star's pairs of which one at least is not tied to the pivot.

    ``asked``: if given, members that it marks are asked of all that it does not mark and that have
    another ``home``. Differences are symmetric, so the size of
    u ^ v follows from the common ones alone.
    """
    free = np.flatnonzero(~np.array(tied, bool) if asked is None else asked).tolist()
    if not free or len(cids) < 2:
        return []
    lengths = np.array([len(d) for d in differences])
    flat = np.concatenate(differences)
    owner = np.repeat(np.arange(len(cids)), lengths)
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    lists, bounds = owner[order], np.append(0, np.cumsum(np.bincount(column)))
    starts = np.append(0, np.cumsum(lengths))
    n = np.array(sizes)
    links = []
    for u in free:
        own = column[starts[u] : starts[u + 1]]
        if not len(own):
            continue
        common = np.bincount(np.concatenate([lists[bounds[c] : bounds[c + 1]] for c in own]), minlength=len(cids))
        apart = lengths[u] + lengths - 2 * common
        both = (n[u] + n - apart) // 2
        near = (common > 0) & (rule.den * both >= rule.num * (n[u] + n - both))
        near[u] = False
        if asked is not None:
            near &= ~asked & (home != home[u])
        links += [(cids[u], cids[v]) for v in np.flatnonzero(near)]
    return links


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few links with the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for a, b in links:
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            kept.append((a, b))
    return kept


STAR = "a long, b long, pivot long, pivot_size int, size int, tied boolean, differences binary"


def _star(rule: Rule):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pivot, chunks = int(key[0]), int(frame["chunks"].iloc[0])
        sets = {int(c): np.frombuffer(e, np.uint64) for c, e in zip(frame["cid"], frame["elements"], strict=True)}
        center = sets.pop(pivot, None)
        out: list[tuple] = []
        if center is not None:
            cids, sizes, tied, differences = [], [], [], []
            for c, s in sets.items():
                both, apart = _differences(s, center)
                cids.append(c)
                sizes.append(len(s))
                tied.append(rule.linked(both, len(s), len(center)))
                differences.append(apart)
            found = [(c, pivot) for c, t in zip(cids, tied, strict=True) if t] + star_links(cids, sizes, tied, differences, rule)
            out = [(a, b, None, None, None, None, None) for a, b in _forest(found)]
            if chunks > 1:
                out += [(c, None, pivot, len(center), n, t, d.tobytes()) for c, n, t, d in zip(cids, sizes, tied, differences, strict=True)]
        return _frame(out)

    return run


def _asked_chunk(rule: Rule):
    def run(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cids = [int(c) for c in frame["a"]]
        differences = [np.frombuffer(d, np.uint64) for d in frame["differences"]]
        links = star_links(cids, [int(n) for n in frame["size"]], [], differences, rule, frame["home"].to_numpy(), frame["asked"].to_numpy(bool))
        return pd.DataFrame(_forest(links), columns=["a", "b"], dtype="int64")

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in STAR.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    kinds = ["Int64", "Int64", "Int64", "Int32", "Int32", "boolean", None]
    return pd.DataFrame({c: pd.array(list(v), k) if k else list(v) for c, v, k in zip(names, columns, kinds, strict=True)})


def star_edges(rows: DataFrame, rule: Rule, classes: DataFrame, stars: DataFrame, shared: frozenset[int]) -> DataFrame:
    """Edges within stars. ``stars``: (cid, pivot) with the members; ``classes``: (cid, rep, n)."""
    sizes = stars.join(classes.select("cid", "n"), "cid").groupBy("pivot").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_MEMBERS), F.ceil(F.col("elements") / CHUNK_ELEMENTS), F.lit(1)).cast("int")
    sizes = sizes.select("pivot", chunks.alias("chunks"))
    members = stars.join(sizes, "pivot").select("cid", "pivot", "chunks", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk"))
    centers = sizes.select(F.col("pivot").alias("cid"), "pivot", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    wanted = written(members.union(centers), "stars")
    keys = wanted.select("cid").distinct().join(classes, "cid").select("rep.key")
    filled = wanted.join(sets_of(rows, rule, keys, wanted.count(), shared).select("cid", "elements").dropDuplicates(["cid"]), "cid")
    found = written(filled.groupBy("pivot", "chunk").applyInPandas(_star(rule), STAR), "star-links")
    # Stars of several chunks: members that are not tied, dealt anew, are asked of every chunk.
    large = found.where("pivot is not null").join(sizes, "pivot").withColumn("home", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
    free = large.where("not tied").groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / CHUNK_MEMBERS), F.ceil(F.sum(F.octet_length("differences")) / (8 * CHUNK_ELEMENTS))).cast("int").alias("parts"))
    large = large.join(free, "pivot")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ("pivot", "a", "home", "size", "differences")
    residents = large.select(*fields, F.lit(False).alias("asked"), F.col("home").alias("chunk"), every("parts").alias("part"))
    guests = large.where("not tied").select(*fields, F.lit(True).alias("asked"), F.pmod(F.xxhash64("a", F.lit(1)), F.col("parts")).cast("int").alias("part"), every("chunks").alias("chunk"))
    across = residents.unionByName(guests).groupBy("pivot", "chunk", "part").applyInPandas(_asked_chunk(rule), "a long, b long")
    return found.where("pivot is null").select("a", "b").union(across)


def cross_edges(rows: DataFrame, rule: Rule, classes: DataFrame, groups: DataFrame, postings: DataFrame, stars: DataFrame, shared: frozenset[int]) -> DataFrame:
    """Edges between members of different stars, from pairs of groups that share a prefix element.

    Only buckets with several stars matter. In each, the star with the most groups meets the others
    and not itself, so a bucket costs its size times the number of its other groups. Groups are
    filtered by size, position and prefix, and only then expanded to their members.
    """
    num, den = rule.num, rule.den
    own = classes.join(stars, "cid", "left").select("grp", "cid", "rep", "bits", F.coalesce("pivot", "cid").alias("star"))
    # All members of a group are in one star.
    by_group = own.groupBy("grp").agg(F.min("star").alias("star")).join(groups.select("grp", "n"), "grp")
    placed = postings.select("e", "grp", "pos").join(by_group, "grp")
    mixed = placed.groupBy("e").agg(F.min("star").alias("a"), F.max("star").alias("b")).where("a <> b").select("e")
    # The largest partner for which an overlap that begins at this position can be enough.
    reach = (F.floor((F.col("n") - F.col("pos")) * (num + den) / num) - F.col("n")).cast("int")
    placed = written(placed.join(mixed, "e", "left_semi").select("e", "grp", "star", "n", reach.alias("reach")), "mixed-postings")
    most = placed.groupBy("e", "star").agg(F.count("*").alias("k")).groupBy("e").agg(F.max_by("star", F.struct("k", "star")).alias("most"))
    full = placed.join(most, "e").select("e", "grp", "star", "n", "reach", (F.col("star") == F.col("most")).alias("main"))
    fields = ("grp", "star", "n", "reach", "main")
    one, two = (full.select("e", *[F.col(c).alias(f"{c}{k}") for c in fields]) for k in (1, 2))
    once = F.col("main2") | (F.col("grp1") < F.col("grp2"))
    sizes = (F.least("n1", "n2") * den >= F.greatest("n1", "n2") * num) & (F.col("n2") <= F.col("reach1")) & (F.col("n1") <= F.col("reach2"))
    pairs = one.where("not main1").join(two, "e").where(once & (F.col("star1") != F.col("star2")) & sizes).select(F.least("grp1", "grp2").alias("grp1"), F.greatest("grp1", "grp2").alias("grp2")).distinct()
    near = _prefix_check(pairs, groups, rule)
    member = lambda k: own.select(*[F.col(c).alias(f"{c}{k}") for c in ("grp", "cid", "rep", "bits", "star")])
    odd = sum((F.bit_count(F.col("bits1")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(4)), F.lit(0))
    close = odd * (den + num) <= (den - num) * (F.col("n1") + F.col("n2"))
    # A pivot has met the members of its own star.
    apart = (F.col("star1") != F.col("cid2")) & (F.col("star2") != F.col("cid1"))
    expanded = near.join(member(1), "grp1").join(member(2), "grp2").where(close & apart)
    expanded = written(expanded.select("cid1", "cid2", F.col("rep1.key").alias("key1"), F.col("rep2.key").alias("key2")), "member-pairs")
    keys = expanded.select(F.col("key1").alias("key")).union(expanded.select("key2")).distinct()
    sets = written(sets_of(rows, rule, keys, 2 * expanded.count(), shared).select("cid", "elements").dropDuplicates(["cid"]), "cross-sets")
    both = expanded.join(sets.select(F.col("cid").alias("cid1"), F.col("elements").alias("x")), "cid1").join(sets.select(F.col("cid").alias("cid2"), F.col("elements").alias("y")), "cid2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for k in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                keep.append(rule.linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (a, b)], names=["a", "b"])

    return both.select("cid1", "cid2", "x", "y").mapInArrow(verify, "a long, b long")


def _prefix_check(pairs: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """(grp1, grp2, n1, n2) of the pairs whose prefixes do not already hold more differences than a link allows.

    A set's rare elements are known up to the last one of its prefix, or all of them if the prefix
    goes beyond them. Where both sets are known, an element that only one has is a true difference.
    """
    side = lambda k: groups.select(*[F.col(c).alias(f"{c}{k}") for c in ("grp", "n", "rare", "prefix")])
    both = pairs.join(side(1), "grp1").join(side(2), "grp2").select("grp1", "grp2", "n1", "n2", "rare1", "rare2", "prefix1", "prefix2")

    def known(n: int, rare: int, prefix: np.ndarray) -> int:
        return 2**64 - 1 if rare < len(prefix) or len(prefix) == n else int(prefix[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n1, n2, r1, r2 = (batch.column(i).to_pylist() for i in range(2, 6))
            for k in range(batch.num_rows):
                x, y = (batch.column(i)[k].values.to_numpy().view(np.uint64) for i in (6, 7))
                most = np.uint64(min(known(n1[k], r1[k], x), known(n2[k], r2[k], y)))
                x, y = x[: r1[k]], y[: r2[k]]
                apart = len(np.setxor1d(x[x <= most], y[y <= most], assume_unique=True))
                # linked: apart <= (den - num) / (den + num) * (n1 + n2)
                keep.append(apart * (rule.den + rule.num) <= (rule.den - rule.num) * (n1[k] + n2[k]))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(4)], names=["grp1", "grp2", "n1", "n2"])

    return both.mapInArrow(run, "grp1 long, grp2 long, n1 int, n2 int")


def ngram_components(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for every row.

    ``keeper`` marks the row that stays if one document of each component does (repeated rows are all
    marked), and every row with an empty set; ``key`` and ``key2`` are row_name() of the row.
    """
    rule, rows = Rule(shingle, num, den), _rows(docs, id_col, text_col)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_elements(rows, rule))
    signed, shared = told_apart(written(signatures(rows, rule, frequent), "signatures"))
    able = signed.where("n > 0").withColumn("rep", F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "key", "key2"))
    one = lambda *names: [F.first(c).alias(c) for c in names]
    classes = written(able.groupBy("cid").agg(F.min("rep").alias("rep"), *one("n", "grp", "bits")), "classes")
    heads = classes.groupBy("grp").agg(F.min(F.struct("rep.rank", "cid")).alias("head"), F.count("*").alias("m"), *one("n"))
    prefixes = able.select("grp", "rare", "prefix").groupBy("grp").agg(*one("rare", "prefix"))
    groups = written(prefixes.join(heads, "grp"), "groups")
    postings = groups.select("grp", F.posexplode("prefix").alias("pos", "e"))
    several = postings.groupBy("e").agg(F.count("*").alias("k")).where("k > 1").select("e")
    postings = written(postings.join(several, "e", "left_semi"), "shared-postings")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    small = groups.select("grp", "head", F.size("prefix").alias("width"), band.alias("band"))
    placed = postings.select("e", "grp").join(small, "grp").select("e", "grp", "head", "width", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    pivots = placed.groupBy("e", "band").agg(F.min("head").alias("pivot"))
    near = placed.join(pivots, ["e", "band"]).where("pivot.cid <> head.cid").groupBy("grp", "width", "pivot").agg(F.count("*").alias("shared"))
    chosen = near.where(F.col("shared") * 10 >= F.col("width")).groupBy("grp").agg(F.min("pivot").alias("pivot"))
    # A group of several classes without a pivot is a star around its head.
    to = groups.select("grp", "head", "m").join(chosen, "grp", "left").where("pivot is not null or m > 1").select("grp", F.coalesce("pivot", "head").alias("pivot"))
    stars = classes.select("grp", "cid").join(to, "grp").select("cid", F.col("pivot.cid").alias("pivot")).where("cid <> pivot")
    stars = written(stars, "assigned")
    edges = star_edges(rows, rule, classes, stars, shared).union(cross_edges(rows, rule, classes, groups, postings, stars, shared))
    roots = connected(edges)
    labels = classes.join(roots, classes.cid == roots.node, "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    by_class = labels.join(labels.groupBy("root").agg(F.min("rep").alias("head")), "root").select("cid", "head")
    named = signed.select("doc_id", "key", "key2", F.col("n").cast("long").alias("n_shingles"), "cid").join(by_class, "cid", "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).when(F.col("head.rank") < LAST, F.col("head.rank")).otherwise(F.col("doc_id"))
    keeper = F.coalesce((F.col("key") == F.col("head.key")) & (F.col("key2") == F.col("head.key2")), F.lit(True))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), keeper.alias("keeper"), "key", "key2")
