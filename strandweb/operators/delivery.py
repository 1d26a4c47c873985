"""Exactly one copy of each message that was delivered at least once.

The copy that is kept is the first delivery: the smallest number in the order of arrival, then the earliest time of
receipt (none before any), then a hash of the row as tie-break. These three make the rank struct, packed into one
38-digit decimal: its order is that of the struct, and unlike a struct it is updated in place, so ``min_by`` runs as a
hash aggregation with partial states on the map side. An identity that holds a third of all rows sends one state for each map task.

Defined cases: a message with a null in any identifying column, or without number, has no identity and stays out of both
results; of rows with one number and one time the tie-break decides, so the kept copy does not depend on the
partitioning; whole repeated rows are copies like any other; times before 1700 or after 2200 rank as those years; extra
columns are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the packed rank: time of receipt in microseconds since 1700 (0: none), and tie-break. The number has 64, 126 in all.
TIME_BITS, TIE_BITS = 54, 8
_OFFSET_US, _SPAN_US = 8_520_336_000_000_000, 15_778_800_000_000_000


def _identified(identity: dict[str, Column], number: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in identity.values()), number.isNotNull())


def _tie(df: DataFrame) -> Column:
    """Hash of the row; ``to_json`` also takes maps and other columns that can't be hashed."""
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    other = [F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema if f.name not in plain]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain], *other)


def packed_rank(df: DataFrame, number: str, time: str | None) -> Column:
    """``(number, time, tie-break)`` as one decimal of 38 digits, in the same order."""
    at = F.lit(0).cast("long")
    if time:
        since = F.unix_micros(F.col(f"`{time}`")) + _OFFSET_US
        at = F.when(F.col(f"`{time}`").isNotNull(), F.greatest(F.lit(0), F.least(since, F.lit(_SPAN_US))) + 1).otherwise(at)
    low = at * (1 << TIE_BITS) + F.pmod(_tie(df), F.lit(1 << TIE_BITS))  # below 2**62
    high = F.col(f"`{number}`").cast("decimal(19,0)") * F.lit(1 << (TIME_BITS + TIE_BITS)).cast("decimal(19,0)")
    return (high + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def _kept(df: DataFrame, identity: dict[str, Column], number: str, time: str | None) -> DataFrame:
    """``message, rank`` of the kept copy of each identity."""
    known = df.where(_identified(identity, F.col(f"`{number}`")))
    ranked = known.select(F.col(f"`{number}`").cast("long").alias("message"), packed_rank(df, number, time).alias("rank"), *[c.alias(f"__id_{k}") for k, c in identity.items()])
    kept = ranked.groupBy(*[f"__id_{k}" for k in identity]).agg(F.min_by("message", "rank").alias("message"), F.min("rank").alias("rank"))
    return kept.select("message", "rank")


def first_copies(df: DataFrame, identity: dict[str, Column], number: str, time: str | None = None) -> DataFrame:
    """One row per identity, with the columns of ``df``: the copy of lowest rank.

    The aggregation moves identities and ranks only; the rows are then picked by number, which spreads evenly whatever
    the identities are. Of rows that agree in number and rank one is taken.
    """
    kept = _kept(df, identity, number, time).select(F.col("message").alias("__message"), F.col("rank").alias("__kept"))
    rows = df.where(_identified(identity, F.col(f"`{number}`"))).withColumns({"__number": F.col(f"`{number}`").cast("long"), "__rank": packed_rank(df, number, time)})
    same = (F.col("__number") == F.col("__message")) & (F.col("__rank") == F.col("__kept"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["__number"]).select(*[F.col(f"`{c}`") for c in df.columns])


def surplus_copies(df: DataFrame, identity: dict[str, Column], number: str, time: str | None = None) -> DataFrame:
    """``number`` (a unique column) of each copy but the kept one of its identity.

    An anti join of the numbers with those of the kept copies. Messages without number or identity are no copies.
    """
    known = df.where(_identified(identity, F.col(f"`{number}`"))).select(F.col(f"`{number}`").cast("long").alias("message"))
    kept = _kept(df, identity, number, time).select("message")
    return known.join(kept, "message", "left_anti").select(F.col("message").alias(number))
