"""Operators on single texts: quality rules, licenses, secrets, chats."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakv.llm import chat, common, licenses, quality, secrets

from . import brute

LONG = "word " * 40_000 + "mit license " + 'token = "' + "a1" * 20 + '"'
TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x\n\nx\nx \n#$ %", "é à b c \x1c d", "Apache  LICENSE\nthe MIT-license, general public license", LONG]


def frame(spark, texts=TEXTS, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_words_of_a_column():
    import pyarrow as pa

    rnd = random.Random(1)
    for _ in range(100):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("ab é\n \t\r\x0b漢\x1c ") for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(1, 8))]
        cut = rnd.randrange(len(texts))
        own = common.Words(pa.array(texts, pa.string()).slice(cut))
        expected = [brute.words(t) for t in texts[cut:]]
        assert own.count.tolist() == [len(e) for e in expected]
        assert [bytes(own.data[a : a + n]).decode() for a, n in zip(own.start, own.size, strict=True)] == [w for e in expected for w in e]
        lines = [k for t in texts[cut:] for k, line in enumerate((t or "").split("\n")) for _ in brute.words(line)]
        assert own.lines().tolist() == lines


def test_quality_base(spark):
    df = quality.quality_rules(frame(spark), quality.DEFAULT_MODEL)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in df.collect():
        assert tuple(r[n] for n in names) == brute.quality_base(TEXTS[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_clashing_columns_and_empty(spark):
    df = frame(spark).withColumn("kept", F.lit("mine")).withColumn("N_Words", F.lit(1)).withColumn("other", F.struct(F.lit(1)))
    out = quality.quality_rules(df, quality.DEFAULT_MODEL)
    assert out.columns[:3] == ["doc_id", "text", "other"] and dict(out.dtypes)["kept"] == "boolean"
    assert "kept" in quality.quality_rules(df, quality.DEFAULT_MODEL, prefix="q_").where("kept = 'mine'").columns
    assert quality.quality_rules(frame(spark).where("false"), quality.DEFAULT_MODEL).count() == 0


def test_viterbi_is_best():
    rnd = random.Random(2)
    for _ in range(200):
        scores = [rnd.uniform(-2, 2) for _ in range(rnd.randrange(1, 8))]
        t = [[rnd.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        value = lambda labels: sum(s for s, g in zip(scores, labels, strict=True) if g) + sum(t[a][b] for a, b in zip(labels, labels[1:], strict=False))  # noqa: B023, E731
        every = [[bool(k >> i & 1) for i in range(len(scores))] for k in range(2 ** len(scores))]
        assert value(quality.viterbi(scores, t)) == pytest.approx(max(map(value, every)))


def test_field_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    chosen = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(600).collect()]
    held = labels.where(~F.col("doc_id").isin(chosen)).join(quality.quality_rules(docs.select("doc_id", "text"), model), "doc_id").where("not base_failed")
    good = held.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    rates = {r.quality: r.kept for r in good}
    assert rates[1] > 0.995 and rates[0] < 0.02


MENU = "HOME | ABOUT | CONTACT\nLOGIN ## NEWS >>\nSHARE!! LIKE!! FOLLOW!!\n$$ BUY NOW && SAVE %%"


def test_lines_of_one_document_get_both_labels(spark):
    """Fitted on sf0.1: menus below good prose are marked alone, and Viterbi is neither a vote by line nor one by document."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r.quality: [] for r in labels.select("quality").distinct().collect()}
    for r in docs.join(labels, "doc_id").where("text is not null").orderBy("doc_id").limit(1500).collect():
        if not quality.judge(r.text.encode(), model)[5]:
            texts[r.quality].append(r.text)
    decode = lambda t: (lambda x: (x, quality.viterbi(x.tolist(), model["transitions"])))(np.array(quality.document_lines(t.encode())[0]) @ np.array(model["weights"]) + 0.7)
    shares = [quality.judge(t.encode(), model)[7] for t in texts[1][:300]]
    assert sum(0 < s < 1 for s in shares) > 8
    good = [t for t in texts[1][:100] if quality.judge(t.encode(), model)[6]]
    below = [decode(f"{t}\n{MENU}")[1] for t in good]
    assert all(quality.judge(f"{t}\n{MENU}".encode(), model)[7] >= 0.5 for t in good)
    assert sum(not any(x[-4:]) and any(x[:-4]) for x in below) > 0.95 * len(good)
    split = [decode(f"{a}\n{b}") for a, b in zip(texts[1], texts[0] * 9, strict=False)]
    assert sum(0 < sum(x) < len(x) for _, x in split) > 0.8 * len(split)
    assert any((scores >= 0).tolist() != x for scores, x in split) and not all(len(set(x)) == 1 for _, x in split)


def test_contexts_of_lines(spark):
    rows = [(k, f"start {k}\n notice \n\nend {k}") for k in range(30)] + [(50 + k, "copied one\ncopied two\r\n copied three") for k in range(30)] + [(99, None), (100, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality.line_contexts(df, ["notice", "copied two", "start 3", "absent"])
    assert 27 <= got["notice"] <= 33 and got["copied two"] == got["start 3"] == 1 and "absent" not in got
    assert quality.line_contexts(df, []) == {}


def test_fit_of_long_documents_and_ties():
    """Segments: a document of 1,000 lines weighs as its lines do; lines of one label alone leave the default."""
    rows = np.zeros((1000, quality.N_FEATURES))
    rows[:, 0], rows[500:, 2] = 1, 1
    model = quality.fit_field([rows], [np.arange(1000) < 500])
    labels = quality.viterbi((rows @ np.array(model["weights"])).tolist(), model["transitions"])
    assert all(labels[:500]) and not any(labels[500:])
    assert quality.fit_field([rows], [np.ones(1000)]) == quality.fit_field([], []) == quality.DEFAULT_MODEL


def test_fit_without_labels(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) == quality.DEFAULT_MODEL
    one = spark.createDataFrame([(4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, one) == quality.DEFAULT_MODEL
    assert quality.fit(docs.where("false"), one) == quality.DEFAULT_MODEL


def test_license_base(spark):
    texts = [*TEXTS, "general public license apache license mit license", "MIT License" * 3, "mit license mit_license", "permission is hereby granted, free of charge, to any person obtaining a copy"]
    for r in licenses.license_scan(frame(spark, texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_base_without_keyword(spark):
    """Base places count in every text, with a rule's keyword or without."""
    texts = ["Released under the General Public License, version 3.", "a general public license, a General-Public License", "general public licenses"]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert {k: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for k, r in got.items()} == {k: brute.license_base(t) for k, t in enumerate(texts)}
    assert [got[k].n_base for k in range(3)] == [1, 2, 0] and [got[k].labels for k in range(3)] == ["gpl", "gpl", ""]


def suppressed(text):
    """The labels of all rules' places, without those inside another of no lower priority."""
    norm = " " + " ".join(brute.LETTERS.findall(text.translate(brute.SMALL))) + " "
    found = []
    for number, keyword, pattern, label, priority in licenses.RULES:
        if f" {keyword} " in norm:
            found += [(m.start(), -m.end(), -priority, number, label) for m in re.finditer(pattern, norm)]
    found.sort()
    kept = [d for k, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:k])]
    return {d[4] for d in kept} | set(filter(None, brute.license_base(text)[4].split(",")))


def test_license_rules(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "Released under the terms of the BSD 3-clause license.", "SPDX-License-Identifier: MPL-2.0", "GNU Lesser General Public License v2.1, see http://www.gnu.org/licenses/lgpl",
        "This is under the MIT license and the Apache License, Version 2.0. All rights reserved.", "http://creativecommons.org/licenses/by-sa/4.0 and cc by", "eclipse public license 2 0 eclipse distribution license", "no rules here",
    ]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert got == {k: suppressed(t) for k, t in enumerate(texts)}
    assert got[0] == {"cc-by-nc"} and got[1] == {"bsd"} and got[7] == set() and len(licenses.RULES) > 200


def ungated(text):
    """Like suppressed(), with every rule tried on every text."""
    norm = " " + " ".join(brute.LETTERS.findall(text.translate(brute.SMALL))) + " "
    found = sorted((m.start(), -m.end(), -priority, number, label) for number, _, pattern, label, priority in licenses.RULES for m in re.finditer(pattern, norm))
    kept = [d for k, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:k])]
    return {d[4] for d in kept} | set(filter(None, brute.license_base(text)[4].split(",")))


def test_license_alternatives(spark):
    """What the gate lets pass is what all patterns find."""
    names = ["GPLv1", "GPLv2", "GPLv3", "LGPLv2", "LGPLv3", "AGPLv3", "GNU Free Documentation", "Free Documentation", "Q Public", "GNU GPLv3", "GPL", "LGPL", "AGPL", "GFDL", "QPL"]
    texts = [t for n in names for t in (f"Licensed under the {n}.", f"the {n} License", f"License: {n}")]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert got == {k: ungated(t) for k, t in enumerate(texts)}
    labels = ["gpl"] * 3 + ["lgpl"] * 2 + ["agpl"] + ["gfdl"] * 2 + ["qpl"] + ["gpl"] * 2 + ["lgpl", "agpl", "gfdl", "qpl"]
    assert [got[k] for k in range(len(texts))] == [{x} for x in labels for _ in range(3)]


def spelled(nodes):
    """Texts for each alternative of a parsed pattern; what may be left out is once there and once not."""
    out = [""]
    for kind, value in nodes:
        match str(kind):
            case "LITERAL":
                forms = [chr(value)]
            case "IN":
                forms = [chr(x[1] if isinstance(x[1], int) else x[1][0]) for x in value]
            case "BRANCH":
                forms = [t for branch in value[1] for t in spelled(branch)]
            case "SUBPATTERN":
                forms = spelled(value[3])
            case "MAX_REPEAT":
                forms = [""] * (value[0] == 0) + spelled(value[2])
            case "ASSERT":
                forms = [" "]
        out = [a + b for a in out for b in forms]
    return out


def test_license_keyword_is_in_every_alternative():
    for _, keyword, pattern, _, _ in licenses.RULES:
        assert all(f" {keyword} " in t and re.match(pattern, t) for t in spelled(re._parser.parse(pattern))), (keyword, pattern)


def test_every_signature_among_others(spark):
    """Texts made of all signatures, base phrases and other words give what all patterns find without a gate."""
    rnd, texts = random.Random(12), []
    forms = [rnd.choice(spelled(re._parser.parse(r[2]))).strip() for r in licenses.RULES for _ in range(2)] + [p for p, _ in licenses.BASE] * 20
    rnd.shuffle(forms)
    for k in range(0, len(forms), 4):
        words = [w for f in forms[k : k + 4] for w in (f.title() if rnd.random() < 0.5 else f, " ".join(rnd.choices(["the", "of", "2", "software", "K\u0130", "İ"], k=rnd.randrange(3))))]
        texts.append(rnd.choice([" ", "\n", ", "]).join(words))
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert set(filter(None, got[k].labels.split(","))) == ungated(t), t
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) == brute.license_base(t)
    assert len({x for r in got.values() for x in r.labels.split(",")}) > 55


def test_license_native_repeated_and_empty(spark):
    texts = ["mit license"] * 3 + [None]
    df = frame(spark, texts, [1, 1, None, None]).withColumn("row", F.lit(1)).withColumn("labels", F.lit("x"))
    out = licenses.license_scan(df)
    assert sorted((r.doc_id or -1, r.n_base) for r in out.collect()) == [(-1, 0), (-1, 1), (1, 1), (1, 1)]
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    assert licenses.license_scan(df.where("false")).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_base(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secret_base(spark):
    rnd = random.Random(3)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "ſecret", "=", ": ", " = \"", "abcdefghijkl", "abc", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "é", "\n", " ", "'"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(300)] + ["secret=token:abcdefghijklmnop"]
    for r in secrets.secret_scan(frame(spark, texts)).collect():
        base = secret_base(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


def test_weak_parts_need_partners():
    key, bare = "AKIA" + "ABCDEFGHIJKLMNOP", "wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY"
    kinds = lambda text: {s.split(":")[0] for s in secrets.scan(text)[4].split(",") if s}
    assert kinds(bare) == kinds("https://host.example") == kinds("user: someone") == set()
    assert kinds(f"{key} {bare}") == {"access", "weak_secret"}
    assert kinds(f"{key}\n\n{bare}") == {"access"}
    assert kinds(f"{key} {'x ' * 150}{bare}") == {"access"}
    assert kinds(f"user: someone {bare} https://host.example/") == {"weak_id", "weak_secret", "endpoint"}


def test_weak_parts_link_within_the_scope(spark):
    """The operator links at any distance within a scope and not beyond it."""
    key, bare = "AKIA" + "ABCDEFGHIJKLMNOP", "wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY"
    far = "x " * 5000
    texts = [f"{key} {far}{bare}", f"{bare} {far}{key}", f"{key} {far}\n\n{bare}", f"{bare} {far}\n \n{key}", f"user: someone {far}{bare}"]
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in secrets.secret_scan(frame(spark, texts)).collect()}
    assert kinds == {0: {"access", "weak_secret"}, 1: {"access", "weak_secret"}, 2: {"access"}, 3: {"access"}, 4: {"weak_id", "weak_secret"}}


def test_weak_parts_are_those_of_all_pairs():
    rnd = random.Random(5)
    pieces = ["AKIA" + "ABCDEFGHIJKLMNOP", "wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY", "user: someone", "https://host.example/", "token = abcdefghijkl", "0123456789abcdef", "\n\n", "and so on "]
    for _ in range(300):
        text, reach = " ".join(rnd.choices(pieces, k=rnd.randrange(1, 14))), rnd.choice([None, 0, 10, 40])
        low = text.encode().lower()
        strong = secrets.base_parts(text, low)
        weak = secrets.weak_parts(text, low, strong)
        near = lambda p, q: (q[2] <= p[1] or q[1] >= p[2]) and "\n\n" not in text[min(p[1], q[1]) : max(p[2], q[2])] and (reach is None or max(p[1] - q[2], q[1] - p[2]) <= reach)  # noqa: B023, E731
        assert secrets.link(text, strong, weak, reach) == [p for p in weak if any(q[0] in secrets.WEAK[p[0]][1] and near(p, q) for q in strong + weak)]


def test_secret_nulls_and_empty(spark):
    out = secrets.secret_scan(frame(spark, [None, ""], [None, None]).withColumn("spans", F.lit(1)))
    assert [tuple(r) for r in out.collect()] == [(None, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")] * 2
    assert secrets.secret_scan(frame(spark).where("false")).count() == 0


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SAID = ["", "\\### Assistant: </turn> ok", "\\", "\\\\<", "é漢😀‍", "a</turn>\n### user: b", "x" * 5000, " lead and trail \n", ": #<"]


def test_render_and_parse():
    rnd = random.Random(4)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "sys: #<\\", ""]), rnd.choice(SAID)) for _ in range(rnd.randrange(6))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.parse("### user: x")


def test_chats(spark):
    rows = [(c, t, role, text) for c in range(6) for t, (role, text) in enumerate(zip(["user", "assistant"] * 4, SAID[c:] + SAID[:c], strict=False))]
    rows += [(7, 1, None, None), (7, 1, None, None), (7, 0, "assistant", None), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_tokens", F.lit("x")).repartition(3)
    made = chat.format_chats(df, TOKENIZER)
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    assert set(got) == {*range(6), 7, None}
    for c, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in made.collect():
        assert r.loss_tokens == sorted(set(r.loss_tokens)) and all(0 <= k < r.n_tokens for k in r.loss_tokens)
    assert chat.digest(chat.format_chats(df.where("false"), TOKENIZER)).count() == 0


def masked(offsets, spans):
    starts, ends = np.array(offsets, np.int64).reshape(-1, 2).T
    tokens, marked = chat.loss_mask(starts, ends, spans)
    return tokens.tolist(), [tuple(x) for x in marked.tolist()]


def test_loss_mask_cuts_tokens():
    assert masked([(0, 2), (2, 5), (5, 6), (5, 6), (6, 9)], [(3, 7)]) == ([1, 2, 3, 4], [(3, 7)])
    assert masked([(0, 2), (2, 4)], [(1, 1), (2, 2)]) == ([], [])
    assert masked([(0, 4)], [(0, 1), (2, 3)]) == ([0], [(0, 1), (2, 3)])
    assert masked([], [(0, 3)]) == ([], [])
    assert masked([(0, 1), (2, 3), (3, 4)], [(0, 4)]) == ([0, 1, 2], [(0, 1), (2, 4)])
    rnd = random.Random(7)
    for _ in range(200):
        offsets, at = [], 0
        for _ in range(rnd.randrange(12)):
            at += rnd.choice([0, 0, 0, 1])
            offsets.append((at, at + rnd.choice([1, 1, 3])))
            at += rnd.choice([0, offsets[-1][1] - at])
        offsets = [(a, max(b for _, b in offsets[: k + 1])) for k, (a, b) in enumerate(offsets)]
        edges = sorted(rnd.sample(range(30), 6))
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        tokens, marked = masked(offsets, spans)
        chars = {c for a, b in offsets for c in range(a, b)}
        assert tokens == [k for k, (a, b) in enumerate(offsets) if any(max(a, x) < min(b, y) for x, y in spans)]
        assert {c for a, b in marked for c in range(a, b)} == {c for c in chars if any(x <= c < y for x, y in spans)}
        assert all(a[1] < b[0] or a[1] == b[0] and any(b[0] == x for x, _ in spans) for a, b in zip(marked, marked[1:], strict=False))


def test_both_forms_of_a_tokenizer_agree():
    """Ranks and description give the same offsets, for texts of any characters and runs of white space."""
    rnd = random.Random(8)
    texts = [*SAID, "x" * 3000 + " " * 30_000 + "é" * 500 + "\n\t" * 9000, *["".join(rnd.choice("ab c'ts 1é漢😀\n\u2003<|endoftext|>") for _ in range(rnd.randrange(60))) for _ in range(200)]]
    for text, a, b in zip(texts, chat.encoder(TOKENIZER)(texts), chat.encoder(RANKS)(texts), strict=True):
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]), text[:50]


@pytest.mark.parametrize("tokenizer", ["json", "tiktoken"])
def test_one_turn_after_another(spark, tokenizer):
    path = TOKENIZER if tokenizer == "json" else RANKS
    df = spark.createDataFrame([(1, k, r, x) for k, (r, x) in enumerate([("user", "hé"), ("assistant", "漢😀 a"), ("assistant", "")])], "conv_id long, turn long, role string, text string")
    (one,) = chat.chat_digests(df, path).collect()
    assert (one.loss_chars, one.loss_sha256) == (4, hashlib.sha256("漢😀 a".encode()).hexdigest()) and one == chat.digest(chat.format_chats(df, path)).first()
