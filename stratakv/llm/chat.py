"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is ``### role: text</turn>`` and a newline. In roles and
texts a backslash goes before every backslash, ``<``, ``#`` and (in roles) ``:``, so that control
strings inside a text never read as markers and the rendering can be undone. The rendering is
encoded once with character offsets; the sorted turn spans are intersected with the sorted token
spans by binary search, which gives the tokens under the loss and the characters of each that count.

Defined cases: a null role or text is empty; turns are ordered by (turn, role, text) with null
first, repeated rows are kept; a null conv_id is a conversation of its own; an empty table gives an
empty result; extra columns are ignored. Conversations are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
_TEXT = re.compile(r"[\\<#]")
_ROLE = re.compile(r"[\\<#:]")
_UNDO = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\<#:]|\\.)*): ((?:[^\\<#]|\\.)*)</turn>\n", re.S)

#: A fixed value: how byte-level vocabularies of ranks split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Conversations that a task formats at a time; Arrow's batches have a bounded size too.
AT_ONCE = 64

SCHEMA = "conv_id long, formatted string, n_tokens long, loss_tokens array<int>, loss_spans array<int>"


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that ``loss_role`` says, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = HEAD + _ROLE.sub(r"\\\g<0>", role) + MIDDLE
        body = _TEXT.sub(r"\\\g<0>", text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that meet a span, and the characters under the loss as merged spans, one row each.

    ``starts`` and ``ends`` are the tokens' sorted character offsets; spans are sorted and apart. A token
    that reaches over a span's edge counts only within the span; several tokens of one character count
    it once.
    """
    tokens, marked = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
    for a, b in spans:
        k = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b))
        x, y = np.maximum(starts[k], a), np.minimum(ends[k], b)
        k, x, y = k[x < y], x[x < y], y[x < y]
        if not len(k):
            continue
        reach = np.maximum.accumulate(y)
        new = np.append(True, x[1:] > reach[:-1])
        tokens.append(k)
        marked.append(np.stack([x[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]], 1))
    return np.unique(np.concatenate(tokens)), np.concatenate(marked)


def gather(conversations: DataFrame) -> DataFrame:
    """A row per conversation with its ordered turns."""
    small_batches(conversations.sparkSession)
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))


def format_chats(conversations: DataFrame, tokenizer: str, *, loss_role: str = "assistant") -> DataFrame:
    """conv_id, the formatted text, its token count, the tokens under the loss and their characters (start, end, start, ...).

    ``tokenizer`` is the path of a tokenizer file that every executor can open (a JSON description, or
    ranks in a .tiktoken file), or the JSON itself.
    """

    return gather(conversations).mapInArrow(_formatter(tokenizer, loss_role), SCHEMA)


def _formatter(tokenizer: str, loss_role: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            rendered = [render(list(zip(r, t, strict=True)), loss_role) for r, t in zip(roles, texts, strict=True)]
            rows = []
            for (text, spans), (starts, ends) in zip(rendered, encode([x for x, _ in rendered]), strict=True):
                tokens, marked = loss_mask(starts, ends, spans)
                rows.append((text, len(starts), tokens, marked.ravel()))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["conv_id", "formatted", "n_tokens", "loss_tokens", "loss_spans"])

    return run


def encoder(tokenizer: str) -> Callable[[list[str]], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """A function from texts to the character offsets of their tokens, starts and ends."""
    return _ranked(tokenizer) if tokenizer.endswith(".tiktoken") else _described(tokenizer)


def _described(tokenizer: str) -> Callable[[list[str]], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """A tokenizer that a JSON document describes."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_str(tokenizer) if tokenizer.lstrip().startswith("{") else Tokenizer.from_file(tokenizer)
    loaded.encode_special_tokens = True

    def encode(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for e in loaded.encode_batch(texts, add_special_tokens=False):
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            yield offsets[:, 0], offsets[:, 1]

    return encode


def _ranked(path: str) -> Callable[[list[str]], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """A byte-level vocabulary of ranks; offsets follow from the tokens' bytes."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    loaded = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, run = regex.compile(PATTERN), regex.compile(r"\s{10000}")

    def ids(text: str) -> list[int]:
        if run.search(text):  # the library's own splitting recurses over white space
            return [i for piece in pieces.findall(text) for i in loaded._encode_single_piece(piece)]
        return loaded.encode_ordinary(text)

    def encode(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for text in texts:
            after = np.cumsum(sizes[np.array(ids(text), np.int64)])
            before = np.append(0, after[:-1]) if len(after) else after
            if not text.isascii():  # a token may begin or end within a character
                chars = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)
                before, after = chars[before] - 1, chars[after - 1]
            yield before, after

    return encode


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def chat_digests(conversations: DataFrame, tokenizer: str, *, loss_role: str = "assistant") -> DataFrame:
    """digest() of format_chats(), in one Python step."""
    make, read = _formatter(tokenizer, loss_role), _digester()
    return gather(conversations).mapInArrow(lambda batches: read(make(batches)), DIGEST)


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the formatted text and the characters under the loss."""
    return formatted.mapInArrow(_digester(), DIGEST)


def _digester() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))
            rows = []
            for text, marks in zip(texts, spans, strict=True):
                turns = parse(text)
                loss = unescape("".join(text[a:b] for a, b in zip(marks[::2], marks[1::2], strict=True)))
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], batch.column(batch.schema.get_field_index("n_tokens"))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    return run
