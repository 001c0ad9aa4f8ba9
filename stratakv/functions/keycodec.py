"""The order-preserving versioned key as Catalyst expressions.

An encoded key is the user key with every 00 byte followed by ff, the terminator 00 00, the
complement of the sequence number as eight big-endian bytes and the kind. Byte order of encoded keys
is user key ascending, sequence descending, kind ascending.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETION, VALUE = 0, 1
#: The largest sequence a BIGINT column can carry; the value after it is reserved.
MAX_SEQUENCE = 2**63 - 2


def _pairs(hexed: Column) -> Column:
    return F.regexp_replace(hexed, "(..)", "$1,")


def escape_hex(key: Column) -> Column:
    """Upper-case hex of the escaped user key with its terminator."""
    return F.concat(F.regexp_replace(F.regexp_replace(_pairs(F.hex(key)), "00,", "00FF,"), ",", ""), F.lit("0000"))


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """The encoded key as BINARY; a sequence out of range or another kind raises an error."""
    bad = (seq < 0) | (seq > MAX_SEQUENCE) | ~kind.isin(DELETION, VALUE)
    good = F.unhex(F.concat(escape_hex(key), F.hex(F.bitwise_not(seq.cast("long"))), F.lpad(F.hex(kind.cast("long")), 2, "0")))
    return F.when(~bad, good).otherwise(F.raise_error(F.lit("sequence or kind out of range")).cast("binary"))


def internal_key_hex(key: Column, seq: Column, kind: Column) -> Column:
    return F.lower(F.hex(internal_key(key, seq, kind)))


def _body(encoded: Column) -> Column:
    """Hex of the escaped user key and terminator: all but the nine bytes of the trailer."""
    hexed = F.hex(encoded)
    return F.substring(hexed, F.lit(1), F.length(hexed) - 18)


def is_valid(encoded: Column) -> Column:
    """Whether the bytes are one whole encoded key: escapes followed by 00 or ff, one terminator, a trailer."""
    trailer = F.substring(F.hex(encoded), F.length(F.hex(encoded)) - 17, F.lit(18))
    pairs = _pairs(_body(encoded))
    return (F.octet_length(encoded) >= 11) & pairs.rlike("^(?:00,FF,|(?!00,)..,)*00,00,$") & trailer.rlike("^(?!0000000000000000).{16}0[01]$")


def _checked(encoded: Column, value: Column, kind: str) -> Column:
    return F.when(is_valid(encoded), value).otherwise(F.raise_error(F.lit("malformed internal key")).cast(kind))


def decode_user_key(encoded: Column) -> Column:
    pairs = _pairs(_body(encoded))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(pairs, "00,00,$", ""), "00,FF,", "00,"), ",", "")
    return _checked(encoded, F.unhex(plain), "binary")


def decode_sequence(encoded: Column) -> Column:
    """From two halves, since the complement does not fit a signed conversion."""
    hexed = F.hex(encoded)
    half = lambda start: F.conv(F.substring(hexed, F.length(hexed) - start, F.lit(8)), 16, 10).cast("long")
    high, low = F.lit(0xFFFFFFFF) - half(17), F.lit(0xFFFFFFFF) - half(9)
    return _checked(encoded, F.shiftleft(high, 32).bitwiseOR(low), "long")


def decode_kind(encoded: Column) -> Column:
    hexed = F.hex(encoded)
    return _checked(encoded, F.conv(F.substring(hexed, F.length(hexed) - 1, F.lit(2)), 16, 10).cast("byte"), "byte")
