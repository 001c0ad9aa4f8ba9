"""Errors of the store and their exact messages (fixed values of the contract)."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all errors of the store."""


class InvalidArgument(StoreError):
    def __init__(self, what: str) -> None:
        super().__init__(f"invalid argument: {what}")


class IoError(StoreError):
    def __init__(self, operation: str, path: object, source: object) -> None:
        super().__init__(f"{operation} failed for {path}: {source}")


class CorruptionError(StoreError):
    def __init__(self, context: object, detail: str) -> None:
        super().__init__(f"corruption in {context}: {detail}")


class UnsupportedFormat(StoreError):
    def __init__(self, kind: str, version: object) -> None:
        super().__init__(f"unsupported {kind} format version {version}")


class LockedError(StoreError):
    def __init__(self, path: object) -> None:
        super().__init__(f"database is locked: {path}")


class ClosedError(StoreError):
    def __init__(self) -> None:
        super().__init__("database is closed")


class BackgroundError(StoreError):
    def __init__(self, what: object) -> None:
        super().__init__(f"background worker failed: {what}")


class WriteStall(StoreError):
    def __init__(self, waiting: int) -> None:
        super().__init__(f"write stalled with {waiting} immutable memtables")
