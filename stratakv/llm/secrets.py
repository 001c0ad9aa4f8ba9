"""Secret scans with multipart credential linking.

Each text gives typed parts with character spans: assignments of secrets, access identifiers, long
hexadecimal runs, and weaker parts (identifiers, bare secret-like strings, endpoints) that alone
prove nothing. Within a scope (paragraphs, cut at blank lines) the sorted weak candidates are
interval-joined with the sorted complementary parts by binary search: a weak candidate is reported
only if a part that complements it lies in the same scope, at any distance unless a ``reach`` in
characters is given.

Defined cases: a null or empty text has no spans, and base_sha256 is that of the empty string; equal
or null ids each give their own row; an empty table gives an empty result; extra columns are
ignored. Texts are scanned whole, in one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, column, sliced, small_batches

#: Fixed values of the base contract, in its order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Cheap tests of the lower-cased bytes; a text that has none cannot match the pattern.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Weak parts by kind: pattern and the kinds that complement it.
WEAK = {
    "weak_id": (re.compile(r"(?<![A-Za-z0-9_])(?:client_id|user(?:name)?|login|account_id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.I | re.A), ("assign", "weak_secret", "hex")),
    "weak_secret": (re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_]*[0-9])(?=[a-z0-9+/_]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A), ("access", "weak_id", "endpoint")),
    "endpoint": (re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", re.I | re.A), ("assign", "access", "weak_secret")),
}
WEAK_WORDS = {"weak_id": (b"client_id", b"user", b"login", b"account_id"), "endpoint": (b"://",)}
ORDER = {k: i for i, k in enumerate(["assign", "access", "hex", *WEAK])}
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_parts(text: str, low: bytes) -> list[tuple[str, int, int]]:
    """Matches of the base kinds that are long enough."""
    parts = []
    if any(w in low for w in ASSIGN_WORDS):
        parts += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        parts += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return parts + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def weak_parts(text: str, low: bytes, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates; a kind is left out where nothing that complements it is there."""
    parts: list[tuple[str, int, int]] = []
    for kind in ("weak_id", "endpoint", "weak_secret"):
        pattern, others = WEAK[kind]
        if kind == "weak_secret" and not any(k in others for k, _, _ in strong + parts):
            continue
        if kind not in WEAK_WORDS or any(w in low for w in WEAK_WORDS[kind]):
            parts += [(kind, *m.span()) for m in pattern.finditer(text)]
    return parts


def link(text: str, strong: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], reach: int | None) -> list[tuple[str, int, int]]:
    """The weak parts with a complementary part in the same scope, within ``reach`` characters if it is not None."""
    if not weak:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    reach = len(text) if reach is None else reach
    # Parts of a kind do not overlap, so their starts and ends are both sorted.
    starts: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for kind, a, b in sorted(strong + weak, key=lambda p: p[1]):
        starts.setdefault(kind, []).append(a)
        ends.setdefault(kind, []).append(b)
    kept = []
    for kind, a, b in weak:
        k = bisect_left(cuts, a)
        low, high = (cuts[k - 1] if k else 0), (cuts[k] if k < len(cuts) else len(text))
        for other in WEAK[kind][1]:
            x, y = starts.get(other, []), ends.get(other, [])
            before, after = bisect_right(y, a) - 1, bisect_left(x, b)
            if (before >= 0 and x[before] >= low and y[before] >= a - reach) or (after < len(x) and x[after] <= min(high, b + reach)):
                kept.append((kind, a, b))
                break
    return kept


def scan(text: str, reach: int | None = 200) -> tuple[int, int, int, str, str]:
    low = text.encode("utf-8", "surrogatepass").lower()
    base = sorted(base_parts(text, low), key=lambda p: (p[1], ORDER[p[0]]))
    found = sorted(base + link(text, base, weak_parts(text, low, base), reach), key=lambda p: (p[1], ORDER[p[0]]))
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    counts = [sum(p[0] == k for p in base) for k in ("assign", "access", "hex")]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in found))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """A row per document with the counts, the digest of the base spans and all spans; weak parts link within the whole scope unless a reach is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        for batch in sliced(batches, 1, SLICE_BYTES):
            rows = [scan(t or "", reach) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    small_batches(docs.sparkSession)
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
