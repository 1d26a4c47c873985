"""Per-key results when a handful of keys hold most rows: multi-level tree aggregation.

Every input split is a chunk of bounded size. Its rows are combined locally (Spark's partial aggregate), and the partial
states climb a tree: in round ``k`` the states of one key are grouped by ``leaf div fan_in**k``, so a reducer never
receives more than about ``fan_in`` partial states of any key, however hot the key is. After ``ceil(log_fan_in(chunks))``
rounds one state for each key is left.

Defined cases: a null key is no key and gives no row; an empty input gives no rows; repeated rows count as often as they
occur, except in :func:`distinct_members_per_key`, where a (member, key) pair counts once; other columns are ignored, and
columns named like the helper columns do no harm, as only keys and values are selected before they are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweb.session import input_chunks

FAN_IN = 32
#: Two rounds at least, so that a wrong size estimate can't put all partial states of a hot key on one reducer.
LEAST_ROUNDS = 2


def tree_sum(df: DataFrame, key: Column, value: Column, fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """``(key, total)``: the sum of ``value`` for each non-null ``key``, by tree aggregation.

    ``chunks`` is the number of input splits; by default it is estimated from the plan's input bytes.
    """
    chunks = chunks or input_chunks(df)
    rounds = max(LEAST_ROUNDS, math.ceil(math.log(max(chunks, 2), fan_in)))
    leaves = fan_in**rounds
    state = df.select(key.alias("key"), value.cast("long").alias("total"), F.pmod(F.spark_partition_id(), F.lit(leaves)).cast("long").alias("leaf"))
    state = state.where(F.col("key").isNotNull())
    for level in range(1, rounds):
        state = state.groupBy("key", F.expr(f"leaf div {fan_in**level}").alias("node")).agg(F.sum("total").alias("total"))
        state = state.select("key", "total", (F.col("node") * fan_in**level).alias("leaf"))
    return state.groupBy("key").agg(F.sum("total").alias("total"))


def rows_per_key(df: DataFrame, key: Column, **tree: int) -> DataFrame:
    """``(key, total)``: the number of rows of each non-null key."""
    return tree_sum(df, key, F.lit(1), **tree)


#: So many repeated member ids are broadcast at most (a few MB); beyond it the join shuffles.
BROADCAST_IDS = 100_000


def member_pairs(df: DataFrame, member: str, keys: str) -> DataFrame:
    """Distinct ``(member, key)`` pairs of the array column ``keys``; null members and null elements give none.

    Elements that repeat within a row are dropped in place. Only members that occur in several rows need a shuffle
    over their pairs; it is by member and key, so neither a hot key nor a hot member meets in one task. Whether there
    are such members is asked first, over the ids alone, so that the arrays aren't shuffled where ids are unique.
    """
    rows = df.select(F.col(member).alias("member"), F.col(keys).alias("keys")).where(F.col("member").isNotNull() & (F.size("keys") > 0))
    repeated = rows.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("member")
    pairs = lambda d: d.select("member", F.explode(F.array_distinct("keys")).alias("key")).where(F.col("key").isNotNull())
    few = repeated.limit(BROADCAST_IDS + 1).count()
    if not few:
        return pairs(rows)
    if few <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    return pairs(rows.join(repeated, "member", "left_anti")).unionByName(pairs(rows.join(repeated, "member", "left_semi")).distinct())


def distinct_members_per_key(df: DataFrame, member: str, keys: str, **tree: int) -> DataFrame:
    """``(key, total)``: in how many distinct members' arrays each key occurs."""
    return tree_sum(member_pairs(df, member, keys), F.col("key"), F.lit(1), **({"chunks": input_chunks(df)} | tree))


def url_host(url: Column) -> Column:
    """Host of a url: what lies between the first ``://`` and the next ``/ ? #``, without port, in lower case; else null."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"://([^/?#]*)", 1), r":[0-9]*$", ""))
    return F.when(host != "", host)
