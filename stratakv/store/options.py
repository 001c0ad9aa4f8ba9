"""Configuration of a store; every number must be greater than zero."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from .errors import InvalidArgument

MIB = 1 << 20


@dataclass
class Options:
    """``durability``: "sync" makes each write durable, "buffered" waits for sync() or close().

    ``target_sstable_bytes`` sizes the files of a compaction; a flush writes one file for each
    memtable. ``restart_interval`` has no effect, since Parquet has its own encodings.
    """

    path: Path | str
    durability: str = "sync"
    memtable_bytes: int = 64 * MIB
    target_sstable_bytes: int = 64 * MIB
    block_bytes: int = 4096
    restart_interval: int = 16
    bloom_bits_per_key: int = 10
    block_cache_bytes: int = 64 * MIB
    max_immutable_memtables: int = 4
    max_key_bytes: int = MIB
    max_value_bytes: int = 64 * MIB
    max_batch_bytes: int = 64 * MIB
    compression: str = "none"
    now_ms: Callable[[], int] | None = None

    def validated(self) -> Options:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int) and value <= 0:
                raise InvalidArgument(f"{f.name} must be greater than zero")
        if self.durability not in ("sync", "buffered"):
            raise InvalidArgument("durability is sync or buffered")
        if self.restart_interval != type(self).restart_interval:
            warnings.warn("restart_interval has no effect", stacklevel=3)
        self.path = Path(self.path)
        return self
