"""The durable store: a thin driver-side layer that owns commit order, locking and recovery."""

from .batch import WriteBatch
from .engine import Engine, Snapshot
from .errors import BackgroundError, ClosedError, CorruptionError, InvalidArgument, IoError, LockedError, StoreError, UnsupportedFormat, WriteStall
from .options import Options

__all__ = ["BackgroundError", "ClosedError", "CorruptionError", "Engine", "InvalidArgument", "IoError", "LockedError", "Options", "Snapshot", "StoreError", "UnsupportedFormat", "WriteBatch", "WriteStall"]
