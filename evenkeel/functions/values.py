"""Value specifications: which fields an update carries and how two values of a key are merged.

Merges must be commutative and associative; absent keys have the defaults. A field's merge is one of
``MERGES`` or any aggregate function of one column with these properties, such as ``F.bit_xor``, whose
result merges again as its input does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MERGES = ("sum", "wrap64", "wrap32", "min", "max", "bit_or")
TWO_64, TWO_32 = 1 << 64, 1 << 32


@dataclass(frozen=True)
class Field:
    name: str
    merge: str | Callable[[Column], Column]
    default: int = 0
    type: str = "bigint"

    def __post_init__(self):
        if not callable(self.merge) and self.merge not in MERGES:
            raise ValueError(f"{self.merge}: not one of {MERGES}")

    def aggregate(self) -> Column:
        c = F.col(self.name)
        if callable(self.merge):
            return self.merge(c).cast(self.type).alias(self.name)
        if self.merge == "wrap64":
            # Exact for all unsigned 64-bit magnitudes and any number of rows: both halves are summed apart.
            whole, half = c.cast("decimal(20,0)"), F.lit(str(TWO_32)).cast("decimal(20,0)")
            low = F.pmod(whole, half).cast("bigint")
            high = ((whole - F.pmod(whole, half)) / half).cast("bigint")
            wide = lambda x: F.sum(x.cast("decimal(18,0)")).cast("decimal(38,0)")
            top = F.pmod(wide(high), F.lit(str(TWO_32)).cast("decimal(38,0)"))
            total = (top * F.lit(str(TWO_32)).cast("decimal(12,0)")).cast("decimal(38,0)") + wide(low)
            return F.pmod(total, F.lit(str(TWO_64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias(self.name)
        if self.merge == "wrap32":
            return F.pmod(F.sum(c.cast("bigint")), F.lit(TWO_32).cast("bigint")).alias(self.name)
        if self.merge == "sum":
            return F.sum(c).alias(self.name)
        return {"min": F.min, "max": F.max, "bit_or": F.bit_or}[self.merge](c).cast(self.type).alias(self.name)

    def absent(self) -> Column:
        return F.lit(self.default).cast("decimal(20,0)" if self.merge == "wrap64" else self.type)


@dataclass(frozen=True)
class ValueSpec:
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def aggregates(self) -> list[Column]:
        return [f.aggregate() for f in self.fields]

    def or_default(self) -> list[Column]:
        return [F.coalesce(F.col(f.name), f.absent()).alias(f.name) for f in self.fields]


def counter(name: str = "value", wrap: bool = False) -> ValueSpec:
    return ValueSpec((Field(name, "wrap64" if wrap else "sum"),))


FLOW = ValueSpec((Field("packet_count", "sum"), Field("byte_sum", "sum"), Field("first_seen", "min", (1 << 63) - 1), Field("last_seen", "max"), Field("record_count", "wrap32"), Field("tcp_flags", "bit_or", 0, "int")))
CONVERSATION = ValueSpec((Field("frames", "sum"), Field("bytes", "sum"), Field("start_ts_us", "min", (1 << 63) - 1), Field("last_ts_us", "max")))
