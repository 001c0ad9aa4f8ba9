"""Ordered batches of writes that commit together."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import InvalidArgument
from .options import Options


@dataclass(frozen=True)
class Op:
    """A put, or a delete where ``value`` is None."""

    key: bytes
    value: bytes | None
    expires_at_unix_ms: int | None = None

    @property
    def kind(self) -> int:
        return int(self.value is not None)


@dataclass
class WriteBatch:
    _ops: list[Op] = field(default_factory=list)

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self._ops.append(Op(bytes(key), bytes(value)))
        return self

    def put_with_expiration(self, key: bytes, value: bytes, expires_at_unix_ms: int) -> WriteBatch:
        self._ops.append(Op(bytes(key), bytes(value), expires_at_unix_ms))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self._ops.append(Op(bytes(key), None))
        return self

    def __len__(self) -> int:
        return len(self._ops)

    def is_empty(self) -> bool:
        return not self._ops

    def approximate_bytes(self) -> int:
        """Key and value bytes; a delete counts its key."""
        return sum(len(o.key) + len(o.value or b"") for o in self._ops)

    def operations(self) -> tuple[Op, ...]:
        return tuple(self._ops)

    def check(self, options: Options) -> None:
        if not self._ops:
            raise InvalidArgument("cannot write an empty batch")
        if (n := self.approximate_bytes()) > options.max_batch_bytes:
            raise InvalidArgument(f"write batch payload {n} exceeds max_batch_bytes {options.max_batch_bytes}")
        for o in self._ops:
            for kind, data, name in (("key", o.key, "max_key_bytes"), ("value", o.value or b"", "max_value_bytes")):
                if len(data) > (most := getattr(options, name)):
                    raise InvalidArgument(f"{kind} length {len(data)} exceeds {name} {most}")
