"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_datetime(c: Column, kind: T.DataType) -> Column:
    """A value to compare datetimes by: rounded to milliseconds, text in any spelling of the same instant.

    Text that is no datetime is compared as it is.
    """
    to_ms = lambda x: F.date_trunc("MILLISECOND", x + F.expr("INTERVAL 500 MICROSECOND"))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.date_format(to_ms(c.try_cast("timestamp")), "yyyy-MM-dd HH:mm:ss.SSS"), c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return to_ms(c)
    return c


def iso_micros(c: Column) -> Column:
    """A timestamp as text with microseconds, the way the interchange format carries it."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def text_key_hash(c: Column) -> Column:
    """33 * h + byte over the UTF-8 bytes, wrapped to 32 bits with a sign."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)(?=.)", "$1 "), " "), lambda x: F.conv(x, 16, 10).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, b: (h * 33 + F.coalesce(b, F.lit(0).cast("long"))) % (1 << 32))
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
