"""Operators on whole corpora against plain versions, with nulls, ties, long texts, clashes and empty tables."""

import base64
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratakv.llm import bitmap, components, decontam, lines, neardup, packing, substrings, warc

from . import brute


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def edited(rnd, base, vocabulary, most):
    w = list(base)
    for _ in range(rnd.randrange(most + 1)):
        k, how = rnd.randrange(len(w)), rnd.randrange(3)
        if how == 0:
            w[k] = rnd.choice(vocabulary)
        elif how == 1:
            w.insert(k, rnd.choice(vocabulary))
        elif len(w) > 2:
            del w[k]
    return w


ODD = [(900, ""), (901, None), (902, "a b"), (903, "A  b"), (904, "x"), (905, " \n"), (906, "lone " * 3000)]


def near_rows(seed, n):
    rnd = random.Random(seed)
    v = [f"w{k}" for k in range(300)]
    base = [rnd.choice(v) for _ in range(150)]
    rows = [(k, " ".join(edited(rnd, base, v, 8))) for k in range(n)]
    other = rows[-1][1].split()
    rows += [(n + k, "  ".join(edited(rnd, other, v, 18))) for k in range(n // 2)]
    return rows + [(2 * n + k, rows[k % 7][1]) for k in range(20)] + ODD


@pytest.mark.parametrize(("size", "num", "members", "most"), [(3, 90, 2048, 1 << 24), (5, 80, 40, 0)])
def test_ngram_components(spark, monkeypatch, size, num, members, most):
    """In small chunks, and with joins in the place of bitmaps, too."""
    monkeypatch.setattr(neardup, "CHUNK_MEMBERS", members)
    monkeypatch.setattr(neardup, "MAX_KEYS", most)
    rows = near_rows(5, 160)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.ngram_components(frame(spark, rows), shingle=size, num=num, den=100).collect()}
    assert got == brute.components(rows, size, num, 100)


def test_ids_that_sets_share(spark, monkeypatch):
    """Sets and prefixes whose first 64 bits collide are told apart by the others."""
    narrow = lambda values, seed, whole=neardup.identity: (whole(values, seed)[0] % 7, whole(values, seed)[1])
    rows = near_rows(6, 30)
    rule = neardup.Rule(3, 90, 100)
    schema = "n int, cid long, check long, grp long, grp_check long, tag string"
    sets = [next(neardup.shingle_sets(pa.array([t or ""]), 3)) for _, t in rows]
    table = [(len(s), *(narrow(s, len(s)) + narrow(rule.first(s, s[:0])[0], len(s)) if len(s) else (None,) * 4), s.tobytes().hex()) for s in sets]
    signed, shared = neardup.told_apart(spark.createDataFrame(table, schema))
    own = {r.tag: r.cid for r in signed.where("n > 0").collect()}
    assert len(shared) == 7 and len(set(own.values())) == len(own)
    monkeypatch.setattr(neardup, "identity", narrow)
    assert all(neardup.class_id(s, shared) == own[s.tobytes().hex()] for s in sets if len(s))


def test_ngram_nulls_repeats_clashes(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "q r s t u"), (None, "a b c d"), (2, "A B C D"), (3, None)]
    df = frame(spark, rows).withColumn("key", F.lit("k")).withColumn("n", F.lit(0))
    out = neardup.ngram_components(df, shingle=3, num=90).collect()
    assert sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in out) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (1, 3, 1), (2, 2, 1), (3, 0, 3)]
    assert sorted((r.doc_id or -1) for r in out if r.keeper) == [1, 1, 1, 3]
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "A b c d"), (None, "x y z")], "doc_id long, text string")
    out = neardup.ngram_components(nulls, shingle=3, num=90).collect()
    assert [r.component_id for r in out] == [None] * 3 and sum(r.keeper for r in out) == 2
    assert neardup.ngram_components(df.where("false"), shingle=3, num=90).count() == 0


def test_links_between_chunks():
    """Members that are not tied to the pivot, asked of those in other chunks, give the links of all pairs."""
    import numpy as np

    rng, rule = np.random.default_rng(4), neardup.Rule(3, 90, 100)
    pivot = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    shared = rng.integers(0, 2**63, 12).astype(np.uint64)
    sets = [np.unique(np.concatenate([pivot[rng.random(100) > rng.choice([0.01, 0.06])], shared[rng.random(12) > 0.4]])) for _ in range(60)]
    linked = lambda a, b: rule.linked(len(np.intersect1d(a, b)), len(a), len(b))
    tied = [linked(s, pivot) for s in sets]
    differences, home = [np.setxor1d(s, pivot) for s in sets], np.arange(60) % 4
    want = {(i, j) for i in range(60) for j in range(i) if home[i] != home[j] and not (tied[i] and tied[j]) and linked(sets[i], sets[j])}
    free = [i for i in range(60) if not tied[i]]
    got = set()
    for chunk in range(4):
        members = [i for i in range(60) if home[i] == chunk] + free
        asked = np.array([False] * 15 + [True] * len(free))
        links = neardup.star_links(members, [len(sets[i]) for i in members], [], [differences[i] for i in members], rule, home[members], asked)
        got |= {(max(p), min(p)) for p in links}
    assert want and 0 < sum(tied) < 60 and got == want


def test_connected(spark):
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap(spark):
    rnd = random.Random(8)
    keys = [rnd.randrange(-(2**63), 2**63) for _ in range(500)]
    marks = bitmap.Bitmap(bitmap.bitmap_of(spark.createDataFrame([(k,) for k in keys[:250]], "k long"), 1 << 16))
    assert all(k in marks for k in keys[:250]) and sum(k in marks for k in keys[250:]) < 30
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "key long, t string")
    found = spark.createDataFrame([(k, [1]) for k in keys[:250]], "key long, n array<int>")
    joined = bitmap.left_join_sparse(rows, found, lambda batches: batches, "key long, t string, n array<int>")
    assert {r.key: r.n for r in joined.collect()} == {k: [1] if i < 250 else None for i, k in enumerate(keys)}


def line_rows(seed, n):
    rnd = random.Random(seed)
    v = "a b c d e f g h".split()
    bases = [[rnd.choice(v) for _ in range(rnd.randrange(3, 14))] for _ in range(15)]
    rows = [(k, " \n".join(" ".join(edited(rnd, rnd.choice(bases), v, 2)) for _ in range(rnd.randrange(1, 5)))) for k in range(n)]
    return rows + ODD


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_line_dedup(spark, monkeypatch, most):
    """Also where there are too many lines for bitmaps, and joins take their place."""
    for module in (lines, bitmap):
        monkeypatch.setattr(module, "MAX_KEYS", most)
    rows = line_rows(9, 120)
    expected = brute.line_dedup(rows, 8)
    for r in lines.line_dedup(frame(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        assert list(r.removed) == expected[r.doc_id]
        assert r.text == ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in r.removed))
        assert r.n_lines == sum(bool(brute.words(x)) for x in text.split("\n"))


def test_line_dedup_nulls_repeats_clashes(spark):
    one, near = "one two three four five six seven eight nine", "one two three four five six seven ate nine"
    rows = [(None, one), (5, near), (5, near), (4, None), (6, f"{one}\n{one}")]
    df = frame(spark, rows).withColumn("key", F.lit("mine")).withColumn("rank", F.col("doc_id")).withColumn("removed", F.lit(2))
    out = lines.line_dedup(df, carry=df.columns)
    assert sorted(((r.doc_id or -1), list(r.removed), r.rest.key) for r in out.collect()) == [(-1, [0], "mine"), (4, [], "mine"), (5, [], "mine"), (5, [], "mine"), (6, [0, 1], "mine")]
    assert lines.line_dedup(df.where("false")).count() == 0


def test_lines_of_a_template(spark):
    """Thousands of lines that differ in one word send one entry a slice for each variant, and all but the earliest go."""
    import numpy as np

    rows = [(k, f"total for account number w{k} is due on the first day") for k in range(3000)] + [(5000, "total for account number is due on the first day")]
    got = {r.doc_id: list(r.removed) for r in lines.line_dedup(frame(spark, rows, 7)).collect()}
    assert got == {k: [0] if k else [] for k, _ in rows}
    entries = np.zeros(1000, lines._ENTRY)
    entries["key"], entries["row"], entries["out"] = np.arange(1000) % 3, np.arange(1000), np.arange(1000) % 2
    sent, known = lines.reduced(entries)
    assert len(sent) == 6 and len(known) == 994 and set(known["other_key"]) == set(range(6))


def test_lines_of_any_length(spark):
    """Word positions beyond two bytes do not meet by chance."""
    long = [f"w{k}" for k in range(70_000)]
    other = list(long)
    other[69_000] = "changed"
    rows = [(0, " ".join(long)), (1, " ".join(other)), (2, " ".join(long[:1] + long[2:])), (3, " ".join(["x", *other]))]
    assert {r.doc_id: list(r.removed) for r in lines.line_dedup(frame(spark, rows, 2)).collect()} == {0: [], 1: [0], 2: [0], 3: [0]}


def test_one_edit():
    rnd = random.Random(10)
    for _ in range(2000):
        a = [rnd.choice(b"xy") for _ in range(rnd.randrange(6))]
        b = [rnd.choice(b"xy") for _ in range(rnd.randrange(6))]
        assert lines.within_one_edit(a, b) == brute.one_edit(a, b)


def test_substring_dedup(spark):
    rnd = random.Random(11)
    v = [f"w{k}" for k in range(40)]
    passages = [[rnd.choice(v) for _ in range(rnd.randrange(4, 30))] for _ in range(8)]
    rows = []
    for k in range(80):
        w = []
        for _ in range(rnd.randrange(5)):
            w += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(v) for _ in range(rnd.randrange(12))]
        rows.append((k, " \n".join(w)))
    rows += ODD
    expected = brute.substring_dedup(rows, 6)
    out = substrings.substring_dedup(frame(spark, rows), size=6).cache()
    for r in out.collect():
        w, kept = expected[r.doc_id]
        assert (r.n_words, r.kept_text) == (len(w), " ".join(kept))
    for r in substrings.digest(out).collect():
        w, kept = expected[r.doc_id]
        assert (r.n_removed, r.kept_sha256) == (len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_ranks_tell_pairs_apart():
    import numpy as np

    rnd = random.Random(17)
    a, b = np.array([rnd.randrange(4) for _ in range(200)], np.uint64), np.array([rnd.randrange(3) for _ in range(200)], np.uint16)
    for more in (b, np.zeros(200, np.uint16)):
        order, first = substrings.ranks(a, more)
        seen = [(a[k], more[k]) for k in order]
        assert [k == 0 or seen[k] != seen[k - 1] for k in range(200)] == first.tolist() and first.sum() == len(set(seen))
    assert [len(x) for x in substrings.ranks(a[:0], b[:0])] == [0, 0]


def test_substring_nulls_repeats_clashes(spark):
    text = " ".join(f"w{k}" for k in range(8))
    df = frame(spark, [(1, text), (1, text), (None, "solo " + text), (None, None)]).withColumn("key", F.lit("x")).withColumn("removed", F.lit(0))
    got = sorted(((r.doc_id or -1), r.n_words, r.kept_text) for r in substrings.substring_dedup(df, size=5).collect())
    assert got == [(-1, 0, ""), (-1, 9, "solo"), (1, 8, ""), (1, 8, "")]
    assert substrings.substring_dedup(df.where("false")).count() == 0


def contaminated(docs, items, least):
    """Pairs by comparing every window of an item's length with it."""
    import math
    from collections import Counter

    words = lambda t: brute.LETTERS.findall((t or "").translate(brute.SMALL))
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    known = {i: words(t) for i, t in items if t is not None and words(t)}
    n = len([1 for _, t in items if t is not None])
    held = Counter(g for w in known.values() for g in grams(w))
    holders = Counter(g for w in known.values() for g in set(grams(w)))
    weigh = lambda g: 1 + math.log(n / holders[g]) if g in held else 1 + math.log(n)
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in known.items():
            own = grams(x)
            for k in range(len(w) - len(x) + 1):
                a = grams(w[k : k + len(x)])
                top = sum(weigh(g) * min(c, own[g]) for g, c in a.items() if g in own)
                whole = sum(weigh(g) * c for g, c in (a | own).items())
                if top >= least * whole - 1e-12:
                    out[d, i] = max(out.get((d, i), 0), top / whole)
    return out


def test_decontamination(spark):
    rnd = random.Random(12)
    v = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rnd.choice(v) for _ in range(rnd.randrange(12, 60)))) for k in range(30)] + [(40, None), (41, "!!"), (42, "three short words"), (43, "Z")]
    docs = []
    for k in range(120):
        w = [rnd.choice(v) for _ in range(rnd.randrange(80))]
        if k % 2:
            piece = edited(rnd, rnd.choice(items[:30])[1].split(), v, k % 8 // 2)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in piece]
        docs.append((k, " ".join(w)))
    docs += [*ODD, (999, "here are three short, words!")]
    expected = contaminated(docs, items, 0.8)
    df = frame(spark, docs).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.decontaminate(df, bench).collect()}
    assert set(got) <= set(expected) and all(abs(got[p] - expected[p]) < 1e-9 for p in got)
    # The radius is a bound on fingerprints, which stand for similarity with high probability.
    assert len(got) >= 0.99 * len(expected) and (999, 42) in got
    assert all(p in got for p, s in expected.items() if s > 0.85)
    assert decontam.decontaminate(df, bench.where("false")).count() == decontam.decontaminate(df.where("false"), bench).count() == 0


def test_clean_rows(spark):
    """Rows without a match stay with all their columns, whatever these are called and however items are cut."""
    rnd = random.Random(23)
    items = [(k, " ".join(f"i{k}x{rnd.randrange(50)}" for _ in range(20))) for k in range(9)] + [(None, "a b"), (50, None)]
    docs = [(k, ("some words " + items[k % 9][1] if k % 3 == 0 else f"only {k} own words") if k % 7 else None, k) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, extra long").withColumnRenamed("extra", "a.`b").withColumn("Text_", F.struct(F.lit(1))).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(d[0] for d in docs if d[1] is None or d[0] % 3)
    for n in (20_000, 4):
        got = decontam.clean(df, bench, block_items=n)
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == want
    assert decontam.clean(df, bench.where("false")).count() == 60 and decontam.clean(df.where("false"), bench).count() == 0


def test_recall_at_the_bound(spark):
    """Windows of a similarity just above the bound are found in 99 of 100 cases or more."""
    rnd = random.Random(29)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(60))) for k in range(40)]
    docs = []
    for k in range(400):
        w = items[k % 40][1].split()
        # One changed word of 60 costs five shingles of 56 on either side; two far ones leave a similarity of about 0.7.
        for at in rnd.sample([0, 1, 2, 57, 58, 59], 2) if k % 2 else [rnd.randrange(5, 55)]:
            w[at] = f"other{k}y{at}"
        docs.append((k, " ".join(["before"] * 3 + w + ["after"] * 3)))
    expected = {p for p, x in contaminated(docs, items, 0.8).items() if x < 0.9}
    got = {(r.doc_id, r.item_id) for r in decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expected) > 100 and len(expected & got) >= 0.99 * len(expected)


def test_items_in_blocks(spark):
    bench = spark.createDataFrame([(k, f"item number {k} with some words of its own a{k} b{k} c{k}") for k in range(25)], "item_id long, text string")
    docs = bench.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    got = {(r.doc_id, r.item_id) for r in decontam.decontaminate(docs, bench, block_items=10).where("similarity > 0.99").collect()}
    assert got == {(k, k) for k in range(25)}


def test_blocks_find_all_within_radius():
    import numpy as np

    rnd = random.Random(13)
    texts = [(k, " ".join(f"x{rnd.randrange(50)}" for _ in range(12)).encode()) for k in range(20)]
    from collections import Counter

    from stratakv.llm.common import shingle_hashes, word_hashes

    holders = Counter(h for _, t in texts for h in set(shingle_hashes(word_hashes(t, decontam.FOLD), 5).tolist()))
    for radius in (3, 15, 19):
        own = decontam.Items(texts, 20, holders, radius)
        table = own.by_length[12]
        prints = np.array([rnd.getrandbits(64) for _ in range(300)] + [int(p) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(24))) for p in table["prints"] for _ in range(30)], np.uint64)
        expected = {(a, b) for a in range(len(prints)) for b in range(20) if int(prints[a] ^ table["prints"][b]).bit_count() <= radius}
        assert set(own.near(prints, table)) == expected
        # Few of all random pairs are candidates.
        assert len(own.candidates(prints[:300], table)) / (300 * 20) < {3: 0.001, 15: 0.07, 19: 0.2}[radius]


def test_lookups_by_value_are_those_by_item():
    import numpy as np

    rng = np.random.default_rng(3)
    own = decontam.Items([], 1, {}, 7)
    prints, items = rng.integers(0, 2**64, 200, np.uint64), rng.integers(0, 2**64, 500, np.uint64)
    items[:50] = prints[:50] ^ np.uint64(0b1011)
    parts = items.view(np.uint16).reshape(-1, 4)
    orders = [np.argsort(parts[:, k], kind="stable") for k in range(4)]
    table = {"ids": list(range(500)), "prints": items, "index": [(o, parts[o, k]) for k, o in enumerate(orders)]}
    by_value = own.candidates(prints, table)
    assert len(own.flips) == 17
    own.flips = np.zeros(501, np.uint16)
    assert np.array_equal(own.candidates(prints, table), by_value)
    assert {(k, k) for k in range(50)} <= set(own.near(prints, table))


def test_decontamination_does_not_depend_on_blocks(spark):
    """Shingles that items of other blocks hold weigh the same in every block."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    shared = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = [" ".join([*(word() for _ in range(60)), *([shared[k % 4]] if k >= 20 else [])]) for k in range(60)]
    bench = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (61, None)], "item_id long, text string")
    docs = [(k, " ".join([*texts[k].split()[: 60 - n], *shared[k % 4].split()[:n]])) for k in range(20) for n in (4, 6, 8, 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = [sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.n_windows) for r in decontam.decontaminate(df, b, min_similarity=0.6, block_items=n).collect()) for b, n in ((bench, 20_000), (bench, 7), (bench.orderBy(F.desc("item_id")), 7))]
    assert len(found[0]) > 20 and found[0] == found[1] == found[2]


def test_packing_is_best_fit():
    rnd = random.Random(14)
    for _ in range(50):
        items = sorted(((rnd.randrange(1, 40), rnd.choice([None, "a", "b", "c", "d"]), rnd.choice([None, 1, 2, 3])) for _ in range(60)), key=lambda x: -x[0])
        assert [b for b, _ in packing.pack(items, 40)] == brute.best_fit(items, 40)


def test_packing_rows(spark):
    rnd = random.Random(15)
    rows = [(k, "w " * rnd.choice([0, 1, 5, 9, 10, 11, 35]), rnd.choice(["a", "b", None])) for k in range(200)] + [(None, "x y", "a"), (None, "x y", "a"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("bin", F.lit(1)).withColumn("shard", F.lit(1))
    out = packing.best_fit(df, capacity=10, shard_docs=40).collect()
    words = {}
    for r in out:
        words.setdefault(r.bin, []).append(r)
    assert all(sum(r.piece_words for r in pieces) <= 10 for b, pieces in words.items() if b)
    source = {k: s for k, _, s in rows if k is not None}
    for b, pieces in words.items():
        said = [source[r.doc_id] for r in pieces if b and r.doc_id is not None and source[r.doc_id]]
        assert len(said) == len(set(said))
    for k, t, _ in rows[:200]:
        if k != 3:
            assert sum(r.piece_words for r in out if r.doc_id == k) == len(t.split())
    assert sum(r.doc_id is None for r in out) == 2
    assert packing.best_fit(df.where("false")).count() == 0


def test_packing_by_given_clusters(spark):
    """Clusters of a column, such as component ids of the n-gram join, keep near copies of other sources apart."""
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(k, base + f" end{k}", f"s{k}") for k in range(6)] + [(10 + k, " ".join(f"v{k}x{j}" for j in range(40)), f"s{k}") for k in range(6)] + [(20, None, "s"), (21, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    groups = neardup.ngram_components(docs).select("doc_id", F.col("component_id").alias("the.cluster"))
    together = {}
    for r in packing.best_fit(docs.join(groups, "doc_id"), capacity=400, cluster_col="the.cluster").collect():
        together.setdefault(r.bin, []).append(r.doc_id)
    assert all(sum(d < 6 for d in ids) <= 1 for ids in together.values()) and len(together[None]) == 1
    alone = packing.best_fit(docs, capacity=400).where("doc_id < 6").select("bin").distinct().count()
    assert alone < 6


def page(k):
    return f"<html>{k} é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n</html>"


PAGES = [(k, f"http://x/{k}\nInjected: yes", page(k % 40)) for k in range(120)] + [(200, None, None), (201, "u", ""), (202, "u", "x" * 300_000), (203, "u", "WARC/1.1\r\n" * 50), (None, "u", "only"), (300, "u", "tie"), (300, "u", "tie"), (299, "u", "tie")]


def expected_pages():
    out = []
    for k, _, html in PAGES:
        body = (html or "").encode()
        top = max((j for j, _, h in PAGES if j is not None and (h or "") == (html or "")), default=None)
        again = k is not None and k < top
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_warc(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit(0)).withColumn("size", F.lit(0))
    assert sorted(map(tuple, warc.pages_through_archives(df, records_per_archive=30).collect()), key=str) == expected_pages()
    assert warc.pages_through_archives(df.where("false")).count() == 0


@pytest.mark.parametrize(("piece", "overlap"), [(4096, 2048), (700, 600)])
def test_warc_small_pieces(spark, tmp_path, piece, overlap):
    """Chains over many pieces, records over several, payloads longer than what a task sees."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder, records_per_archive=70)
    records = warc.read_records(spark, folder, piece=piece, overlap=overlap, header_limit=600).collect()
    assert len(records) == len(PAGES)
    assert sorted(r.page_id for r in records if r.kind == "response" and r.page_id != "null") == sorted(str(p[0]) for p in expected_pages() if p[3] == "response" and p[0] is not None)
    assert all(r.digest == r.claimed for r in records if r.kind == "response")


@pytest.mark.parametrize("size", [70_000, 1_500_000])
def test_warc_long_headers(spark, size):
    """A header of any length is read, first in its archive or between others, and with record headers in the url."""
    long = ("data:," + "WARC/1.1 Content-Length: 3 " * size)[:size]
    pages = [(k, long if k in (0, 7) else f"http://x/{k}", page(k) if k % 3 else "same") for k in range(30)] + [(30, "u" * 70_000, "y" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.payload_digest for r in warc.pages_through_archives(df, records_per_archive=20).collect()}
    assert got == {k: base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() for k, _, html in pages}


def test_warc_archives_are_cut_by_bytes(spark, tmp_path):
    """Pages of all sizes: no archive of several records beyond the bound, none lost, one longer than the bound alone."""
    pages = [(k, f"http://x/{k}", chr(97 + k % 26) * size) for k, size in enumerate([10] * 50 + [3_000] * 40 + [60_000] * 12 + [900_000, 5_000_000])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder, records_per_archive=20, archive_bytes=200_000)
    sizes = [(p.stat().st_size, p.read_bytes().count(b"WARC-Record-ID")) for p in tmp_path.rglob("part-*.txt")]
    assert all(n <= 20 and (n == 1 or size < 200_000 + 1000 * n) for size, n in sizes)
    assert warc.read_records(spark, folder).count() == len(pages)


def test_warc_huge_page(spark, monkeypatch):
    """A page of 100 MB is read back whole; one that Spark's rows cannot hold is refused before writing."""
    big = spark.range(1).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789"), 10_000_000).alias("html"))
    df = big.unionByName(spark.createDataFrame([(2, "v", "small")], "page_id long, url string, html string"))
    sha = hashlib.sha1(b"0123456789" * 10_000_000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.pages_through_archives(df).collect()}
    assert got[1] == (100_000_000, base64.b32encode(sha.digest()).decode()) and got[2][0] == 5
    monkeypatch.setattr(warc, "MAX_PAYLOAD", 100)
    with pytest.raises(ValueError, match="100000000"):
        warc.pages_through_archives(df)


def test_warc_broken_chain(spark, tmp_path):
    """An archive whose records do not lead to its end is an error, not a shorter result."""
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    for name, data in (("whole", whole * 2), ("cut", whole + whole[:-6]), ("none", b"no archive"), ("gap", whole + b"x" + whole)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
    assert warc.read_records(spark, f"file://{tmp_path}/whole").count() == 2
    for name in ("cut", "none", "gap"):
        with pytest.raises(ValueError, match="a.warc"):
            warc.read_records(spark, f"file://{tmp_path}/{name}")
