"""Framing of append-only logs: one line a record, with its CRC; a record is whole or absent."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from .errors import CorruptionError, UnsupportedFormat

VERSION = 1


def frame(record: dict) -> bytes:
    body = json.dumps({"v": VERSION} | record, separators=(",", ":")).encode()
    return b"%08x " % zlib.crc32(body) + body + b"\n"


def frames(data: bytes, context: object, kind: str) -> Iterator[tuple[dict, int]]:
    """Records and the offsets after them. A last line without its end is a torn write and is left out; any other damage is an error."""
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        line = data[at:end]
        try:
            crc, body = int(line[:8], 16), line[9:]
        except ValueError:
            raise CorruptionError(context, f"malformed record at {at}") from None
        if line[8:9] != b" " or zlib.crc32(body) != crc:
            raise CorruptionError(context, f"checksum mismatch at {at}")
        try:
            record = json.loads(body)
            version = record.pop("v")
        except (ValueError, KeyError, AttributeError):
            raise CorruptionError(context, f"malformed record at {at}") from None
        if version != VERSION:
            raise UnsupportedFormat(kind, version)
        at = end + 1
        yield record, at
