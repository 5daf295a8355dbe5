"""Geometry blobs: a header ("GP", version, flags, srs id, envelope), then well-known binary."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans import ship

# Bytes of an envelope by its code.
ENVELOPE_BYTES = (0, 32, 48, 48, 64)


def size_of_header(blob: bytes) -> int:
    """``header_size`` of one blob on the driver."""
    return 8 + ENVELOPE_BYTES[blob[3] >> 1 & 7]


def header_size(blob: Column) -> Column:
    flags = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int")
    code = F.shiftright(flags.bitwiseAND(14), 1)
    return 8 + F.coalesce(F.get(F.array(*map(F.lit, ENVELOPE_BYTES)), code), F.lit(0))


def to_wkb(blob: Column) -> Column:
    """The blob without its header; null for null or for what is no such blob."""
    return F.when((F.length(blob) > 8) & (F.substring(blob, 1, 2) == F.lit(b"GP")), F.substring(blob, header_size(blob) + 1, F.length(blob)))


def _walk(data: bytes, at: int, box: list, top: bool = True) -> tuple[int, int, bool]:
    """Read the geometry at ``at``; widen ``box``, a list of [min, max] for x, y, z; return (end, type, has z)."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    kind, dims = code % 1000, code // 1000
    z, width = dims in (1, 3), 2 + (dims in (1, 3)) + (dims in (2, 3))
    at += 5

    def points(n: int, at: int) -> int:
        for _ in range(n):
            p = struct.unpack_from(f"{order}{width}d", data, at)
            at += 8 * width
            for k in range(2 + z):
                if p[k] == p[k]:
                    box[k][0], box[k][1] = min(box[k][0], p[k]), max(box[k][1], p[k])
        return at

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == 1:
        at = points(1, at)
    elif kind == 2:
        n, at = count(at)
        at = points(n, at)
    elif kind == 3:
        rings, at = count(at)
        for _ in range(rings):
            n, at = count(at)
            at = points(n, at)
    elif kind in (4, 5, 6, 7):
        n, at = count(at)
        for _ in range(n):
            at, _, _ = _walk(data, at, box, False)
    else:
        raise ValueError(f"geometry type {code} is not supported")
    return at, kind, z


def bounds(blob: bytes) -> tuple[float, float, float, float] | None:
    """(least x, greatest x, least y, greatest y) of a geometry blob, from its envelope if it has one; None if it is empty."""
    code = blob[3] >> 1 & 7
    if blob[3] >> 4 & 1:
        return None
    if code:
        return struct.unpack_from("<4d" if blob[3] & 1 else ">4d", blob, 8)
    box = [[float("inf"), float("-inf")] for _ in range(3)]
    _walk(blob, 8, box)
    return None if box[0][0] > box[0][1] else (*box[0], *box[1])


def with_header(wkb: bytes | None, srs_id: int) -> bytes | None:
    """Header and well-known binary: points have no envelope; others x, y and z bounds; measures are left out."""
    if not wkb:
        return None
    box = [[float("inf"), float("-inf")] for _ in range(3)]
    _, kind, z = _walk(wkb, 0, box)
    empty = box[0][0] > box[0][1]
    code = 0 if kind == 1 or empty else 2 if z else 1
    flags = 1 | code << 1 | empty << 4
    bounds = [v for b in box[: 2 + z] for v in b] if code else []
    return b"GP" + struct.pack(f"<BBi{len(bounds)}d", 0, flags, srs_id, *bounds) + wkb


def from_wkb(wkb: Column, srs_id: int) -> Column:
    """``with_header`` as a column. The envelope needs a walk over the bytes, so this runs in Python, by Arrow batches."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: with_header(bytes(x), srs_id) if x is not None else None)

    return run(wkb)
