"""Equi-joins whose keys may meet very many rows on both sides; rows dealt once for several steps."""

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.plans.storage import settled

#: Rows of output that a key's share of the join may make in one task; keys that may be broadcast; entries of a scope's table that a row may carry.
ROWS, BROADCAST_KEYS, ENTRIES = 1_000_000, 100_000, 1_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """The inner join of left and right, which share no columns but the keys.

    Both sides' rows are counted by key first. A key that makes more than so many rows is split: the side with more of its rows
    is dealt out to salts by a hash of the whole row, the other side's rows go to each salt. Other keys are joined as they are.
    """
    limit = ROWS if rows is None else rows
    count = lambda side, name: side.groupBy(*keys).agg(F.count("*").alias(name))
    met = count(left, "_left").join(count(right, "_right"), keys)
    salts = F.ceil(F.col("_left") * F.col("_right") / limit).cast("int")
    heavy = met.where(F.col("_left") * F.col("_right") > limit).select(
        *keys,
        F.when(F.col("_left") >= F.col("_right"), F.least(salts, F.col("_left").cast("int"))).otherwise(1).alias("_by_left"),
        F.when(F.col("_left") < F.col("_right"), F.least(salts, F.col("_right").cast("int"))).otherwise(1).alias("_by_right"),
    )
    heavy = settled(heavy)
    n_heavy = heavy.count()
    if not n_heavy:
        return left.join(right, keys)
    known = F.broadcast(heavy) if n_heavy <= BROADCAST_KEYS else heavy
    dealt = lambda side, n: F.pmod(F.xxhash64(*side.columns), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = left.join(known, keys).withColumn("_l", dealt(left, "_by_left")).withColumn("_r", each("_by_right")).drop("_by_left", "_by_right")
    rights = right.join(known, keys).withColumn("_r", dealt(right, "_by_right")).withColumn("_l", each("_by_left")).drop("_by_left", "_by_right")
    split = lefts.join(rights, [*keys, "_l", "_r"]).drop("_l", "_r")
    return left.join(known, keys, "left_anti").join(right, keys).unionByName(split)


def dealt(rows: DataFrame, key: str, n_rows: int, each: int) -> DataFrame:
    """rows dealt by a key once, to as many tasks as n_rows need at this many a task; later steps whose keys begin with it shuffle no more."""
    return rows.repartition(max(math.ceil(n_rows / each), rows.sparkSession.sparkContext.defaultParallelism), key)


def crowded(rows: DataFrame, scope: str, most: int) -> DataFrame | None:
    """The scopes that have more rows than this, or none."""
    found = settled(rows.groupBy(scope).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(scope))
    return None if found.isEmpty() else found


def parted(rows: DataFrame, scope: str, apart: list[DataFrame | None]) -> tuple[DataFrame, DataFrame | None]:
    """rows of the other scopes, and rows of the scopes in these lists."""
    found = [x for x in apart if x is not None]
    if not found:
        return rows, None
    all_ = functools.reduce(DataFrame.unionByName, found).distinct()
    all_ = F.broadcast(all_) if all_.count() <= BROADCAST_KEYS else all_
    return rows.join(all_, scope, "left_anti"), rows.join(all_, scope, "left_semi")


def as_maps(table: DataFrame, scope: str, key: str, value: str, name: str) -> DataFrame:
    """(scope, name): each scope's table as one map, for rows that are dealt by scope and look up several keys without another shuffle."""
    return table.where(F.col(key).isNotNull()).groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
