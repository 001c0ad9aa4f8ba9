"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Lines with at least one word form a sequence; each has a small feature vector. Viterbi decoding
gives the best label sequence, and a document is kept if the share of its words on content lines
reaches ``min_content``. Losing content costs more than keeping boilerplate: ``content_bias`` is added
to the content score of each line.

The field is fitted on the lines of at most ``max_docs`` labelled documents, whole ones. A line is
boilerplate if it stands between ``min_contexts`` or more different pairs of neighbours somewhere in
the corpus (menus and notices do; a copied passage keeps its neighbours), or if it occurs in documents
of low quality alone; all others are content. So both labels meet within one document.

Defined cases: a null or empty text has no words and fails the base rules (kept is false); repeated
rows are judged alike, each on its own; an empty table gives an empty result; input columns with the
name of a result column are replaced. Whole texts are read, however long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, with_results

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
DIGITS = b"0123456789"
MARKS = b"!|"

N_FEATURES = 10

#: Lines of a segment when fitting.
SEGMENT = 64
#: So many line hashes (8 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_LINES = 200_000

RESULT = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())]
)

#: Used where there are no labelled rows: symbol-heavy, capital and repetitive lines are boilerplate.
DEFAULT_MODEL = {
    "weights": [1.0, 0.5, -5.0, -4.0, -2.0, 1.0, 0.3, -0.5, -4.0, 1.0],
    "transitions": [[0.5, -0.5], [-0.5, 0.5]],
}


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    """Numbers near 0 to 1 that describe one line with words."""
    n = len(words)
    chars = sum(map(len, words))
    letters = len(line) - len(line.translate(None, LETTERS))
    return [
        1.0,
        min(n, 64) / 64,
        min(1.0, (len(line) - len(line.translate(None, SYMBOLS))) / n),
        (len(line) - len(line.translate(None, UPPER))) / max(1, letters),
        (len(line) - len(line.translate(None, DIGITS))) / chars,
        len(set(words)) / n,
        float(words[-1][-1:] in b".!?"),
        float(seen),
        min(1.0, (len(line) - len(line.translate(None, MARKS))) / n),
        float(n >= 24),
    ]


def document_lines(text: bytes) -> tuple[list[list[float]], list[int], list[bytes], int]:
    """Features and word counts of the lines with words, all words, and how many lines repeat an earlier one."""
    rows, sizes, everything, seen, repeated = [], [], [], set(), 0
    for line in text.split(b"\n"):
        if not (words := line.split()):
            continue
        old = line in seen
        repeated += old
        seen.add(line)
        rows.append(line_features(line, words, old))
        sizes.append(len(words))
        everything += words
    return rows, sizes, everything, repeated


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    key, most = ids[:n], len(numbers)
    for k in range(1, size):
        if most * len(numbers) >= 2**62:  # renumbered, so that a key never leaves 64 bits
            key, most = np.unique(key, return_inverse=True)[1], n
        key, most = key * len(numbers) + ids[k : k + n], most * len(numbers)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def viterbi(scores: list[float], transitions: list[list[float]]) -> list[bool]:
    """The best sequence of labels (true: content) for content scores against 0 for boilerplate."""
    (bb, bc), (cb, cc) = transitions
    bad, good, back = 0.0, scores[0], []
    for s in scores[1:]:
        from_bad_b, from_good_b = bad + bb, good + cb
        from_bad_c, from_good_c = bad + bc, good + cc
        back.append((from_good_b > from_bad_b, from_good_c >= from_bad_c))
        bad = max(from_bad_b, from_good_b)
        good = s + max(from_bad_c, from_good_c)
    label = good >= bad
    labels = [label]
    for b, c in reversed(back):
        label = c if label else b
        labels.append(label)
    return labels[::-1]


def fit_field(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, rate: float = 0.15, penalty: float = 1e-3) -> dict:
    """Maximise the regularised log-likelihood of the label sequences with forward-backward gradients.

    Sequences go in segments of SEGMENT lines, so that one very long document does not pad all others.
    Without lines of both labels the default model stands.
    """
    cut = [(s[k : k + SEGMENT], y[k : k + SEGMENT]) for s, y in zip(sequences, labels, strict=True) for k in range(0, len(s), SEGMENT)]
    if len({int(v) for _, own in cut for v in own}) < 2:
        return DEFAULT_MODEL
    longest = max(len(s) for s, _ in cut)
    x = np.zeros((len(cut), longest, N_FEATURES))
    mask, y = np.zeros((len(cut), longest), bool), np.zeros((len(cut), longest))
    for i, (s, own) in enumerate(cut):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = s, own, True
    pairs_of = lambda a, b: (mask[:, 1:] & (y[:, :-1] == a) & (y[:, 1:] == b)).sum()
    gold_pairs = np.array([[pairs_of(a, b) for b in (0, 1)] for a in (0, 1)], float)
    w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    moments = [np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)]
    for step in range(1, steps + 1):
        node = np.stack([np.zeros(mask.shape), x @ w], 2)
        forward = np.zeros_like(node)
        forward[:, 0] = node[:, 0]
        for k in range(1, longest):
            forward[:, k] = node[:, k] + np.logaddexp(forward[:, k - 1, :1] + t[0], forward[:, k - 1, 1:] + t[1])
            forward[:, k] = np.where(mask[:, k, None], forward[:, k], forward[:, k - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros_like(node)
        pairs = np.zeros((2, 2))
        for k in range(longest - 2, -1, -1):
            ahead = node[:, k + 1] + backward[:, k + 1]
            joint = forward[:, k, :, None] + t[None] + ahead[:, None, :] - total[:, None, None]
            pairs += np.where(mask[:, k + 1, None, None], np.exp(np.minimum(joint, 0)), 0).sum(0)
            step_back = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
            backward[:, k] = np.where(mask[:, k + 1, None], step_back, backward[:, k + 1])
        content = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0))
        gradient = np.concatenate([((mask * (y - content))[:, :, None] * x).sum((0, 1)), (gold_pairs - pairs).ravel()]) / len(cut)
        gradient -= penalty * np.concatenate([w, t.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w, t = w + move[:N_FEATURES], t + move[N_FEATURES:].reshape(2, 2)
    return {"weights": w.tolist(), "transitions": t.tolist()}


def line_contexts(docs: DataFrame, lines: list[str], text_col: str = "text") -> dict[str, int]:
    """How many different pairs of neighbours each of the lines has in all documents, about (a sketch of a fixed size).

    Lines without words are left out. Only hashes of lines leave a document, and only those of ``lines``.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.xxhash64("line").alias("h"))
    split = F.filter(F.transform(F.split(F.col(f"`{text_col}`").cast("string"), "\n"), lambda x: F.xxhash64(F.trim(x, F.lit(SPACES.decode())))), lambda h: h != F.xxhash64(F.lit("")))
    hashed = docs.select(split.alias("lines"))
    near = F.transform("lines", lambda h, i: F.struct(h.alias("h"), F.xxhash64(F.get("lines", i - 1), F.get("lines", i + 1)).alias("context")))
    # A line that a third of all documents hold shuffles nothing but sketches, where the lines asked for are few.
    asked = F.broadcast(wanted.select("h")) if len(lines) <= BROADCAST_LINES else wanted.select("h")
    found = hashed.select(F.explode(near).alias("x")).select("x.h", "x.context").join(asked, "h", "left_semi").groupBy("h").agg(F.approx_count_distinct("context").alias("n"))
    return {r.line: r.n for r in wanted.join(found, "h").select("line", "n").collect()}


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = 600, min_contexts: int = 4) -> dict:
    """Fit on at most ``max_docs`` labelled documents, chosen by a hash of their id; contexts are counted in all documents."""
    chosen = {r[0]: r[1] for r in labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()}
    if not chosen:
        return DEFAULT_MODEL
    sample = docs.where(F.col("doc_id").isin(list(chosen))).select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").dropDuplicates(["doc_id"]).collect()
    texts = {r.doc_id: [x.strip(SPACES).decode() for x in r.text.encode().split(b"\n") if x.split()] for r in sample}
    good = {x for d, own in texts.items() if chosen[d] != 0 for x in own}
    several = line_contexts(docs, sorted({x for own in texts.values() for x in own}))
    sequences, classes = [], []
    for doc_id, text in sorted(sample):
        if own := texts[doc_id]:
            sequences.append(np.array(document_lines(text.encode())[0]))
            classes.append(np.array([several.get(x, 0) < min_contexts and x in good for x in own], int))
    return fit_field(sequences, classes)


def judge(text: bytes, model: dict, *, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5, content_bias: float = 0.7) -> tuple:
    """Base counts and verdict of one text, in the order of RESULT."""
    rows, sizes, words, dup_lines = document_lines(text)
    solid = text.translate(None, SPACES)
    n, repeats = len(words), repeat_words(words)
    failed = n < min_words or 100 * repeats > max_repeat_percent * n
    share = 0.0
    if rows:
        labels = viterbi((np.array(rows) @ np.array(model["weights"]) + content_bias).tolist(), model["transitions"])
        share = sum(s for s, good in zip(sizes, labels, strict=True) if good) / n
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    return n, len(solid.decode("utf-8", "replace")), symbols, dup_lines, repeats, failed, not failed and share >= min_content, share


def quality_rules(docs: DataFrame, model: dict, *, text_col: str = "text", prefix: str = "", **rules) -> DataFrame:
    """All columns of ``docs`` and those of RESULT (with ``prefix``), in one pass without a shuffle. ``rules``: as in judge()."""

    def make():
        def compute(texts: list[bytes]) -> list[list]:
            judged = [judge(t, model, **rules) for t in texts]
            return [list(c) for c in zip(*judged, strict=True)] if judged else [[] for _ in RESULT]

        return compute

    return with_results(docs, text_col, RESULT, make, prefix)


__all__ = ["DEFAULT_MODEL", "RESULT", "byte_texts", "fit", "fit_field", "judge", "quality_rules", "viterbi"]
