"""The binary changeset format, without Spark.

A table header is "T", the number of columns, a byte for each that says whether it is in the key, the name and a zero
byte. An entry is its operation, an indirect flag, the old values unless it is an insert, and the new ones unless it is
a delete. A value is a tag and its payload. Numbers of columns and lengths are variable-length: seven bits a byte, most
significant first, at most nine bytes of which the ninth gives eight bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from .model import OP_CODES, OP_NAMES, RowsyncError

# Tags of values in the file.
UNDEFINED, INTEGER, DOUBLE, TEXT, BLOB, NULL = 0, 1, 2, 3, 4, 5
MAX_COLUMNS = 65536


class _Undefined:
    """An unchanged cell; not the same as null."""

    def __repr__(self) -> str:
        return "UNCHANGED"


UNCHANGED = _Undefined()


@dataclass
class Entry:
    table: str
    keys: tuple[bool, ...]
    op: str
    old: list
    new: list


def put_varint(n: int) -> bytes:
    if n < 0 or n >= 1 << 64:
        raise RowsyncError("a length is out of range")
    if n >= 1 << 56:
        head = n >> 8
        return bytes([(head >> 7 * k) & 127 | 128 for k in range(7, -1, -1)]) + bytes([n & 255])
    groups = [n & 127]
    while n := n >> 7:
        groups.append(n & 127 | 128)
    return bytes(reversed(groups))


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    for k in range(9):
        if at >= len(data):
            raise RowsyncError(f"the changeset ends inside a number at {at}")
        b, at = data[at], at + 1
        if k == 8:
            return n << 8 | b, at
        n = n << 7 | b & 127
        if b < 128:
            return n, at
    raise AssertionError


def put_value(v) -> bytes:
    if v is UNCHANGED:
        return bytes([UNDEFINED])
    if v is None:
        return bytes([NULL])
    if isinstance(v, (bool, int)):
        return struct.pack(">Bq", INTEGER, int(v))
    if isinstance(v, float):
        return struct.pack(">Bd", DOUBLE, v)
    tag, raw = (BLOB, bytes(v)) if isinstance(v, (bytes, bytearray)) else (TEXT, str(v).encode())
    return bytes([tag]) + put_varint(len(raw)) + raw


def get_value(data: bytes, at: int) -> tuple[object, int]:
    if at >= len(data):
        raise RowsyncError(f"the changeset ends before a value at {at}")
    tag, at = data[at], at + 1
    if tag == UNDEFINED:
        return UNCHANGED, at
    if tag == NULL:
        return None, at
    if tag in (INTEGER, DOUBLE):
        if at + 8 > len(data):
            raise RowsyncError(f"the changeset ends inside a value at {at}")
        return struct.unpack_from(">q" if tag == INTEGER else ">d", data, at)[0], at + 8
    if tag in (TEXT, BLOB):
        n, at = get_varint(data, at)
        if at + n > len(data):
            raise RowsyncError(f"the changeset ends inside a value at {at}")
        raw = data[at : at + n]
        return (raw.decode() if tag == TEXT else raw), at + n
    raise RowsyncError(f"unknown value tag {tag} at {at - 1}")


def encode_header(table: str, keys: tuple[bool, ...]) -> bytes:
    return b"T" + put_varint(len(keys)) + bytes(map(int, keys)) + table.encode() + b"\0"


def encode_entry(e: Entry) -> bytes:
    sides = [x for x, on in ((e.old, e.op != "insert"), (e.new, e.op != "delete")) if on]
    if any(len(x) != len(e.keys) for x in sides):
        raise RowsyncError("an entry has a wrong number of values")
    return bytes([OP_CODES[e.op], 0]) + b"".join(put_value(v) for x in sides for v in x)


def encode(entries: Iterator[Entry]) -> Iterator[bytes]:
    """Parts of a changeset file; a header where the table changes."""
    table = None
    for e in entries:
        if e.table != table:
            table = e.table
            yield encode_header(e.table, e.keys)
        yield encode_entry(e)


def decode(data: bytes) -> Iterator[Entry]:
    at, table, keys = 0, None, ()
    while at < len(data):
        code, at = data[at], at + 1
        if code == 0x54:
            n, at = get_varint(data, at)
            if not 0 < n <= MAX_COLUMNS:
                raise RowsyncError(f"a table has {n} columns at {at}")
            end = data.find(b"\0", at + n)
            if end < 0:
                raise RowsyncError(f"the changeset ends inside a table header at {at}")
            keys, table, at = tuple(b == 1 for b in data[at : at + n]), data[at + n : end].decode(), end + 1
        elif code in OP_NAMES and table is not None:
            at += 1
            op, sides = OP_NAMES[code], {"old": [], "new": []}
            for side in ("old", "new"):
                if (side, op) not in (("old", "insert"), ("new", "delete")):
                    for _ in keys:
                        v, at = get_value(data, at)
                        sides[side].append(v)
            yield Entry(table, keys, op, sides["old"], sides["new"])
        else:
            raise RowsyncError(f"unknown operation {code} at {at - 1}")
