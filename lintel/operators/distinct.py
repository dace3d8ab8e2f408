"""Expensive expressions of columns with few different values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.plans.storage import settled

#: Different values that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def with_distinct(rows: DataFrame, columns: list[str], **derived: Column) -> DataFrame:
    """rows with derived columns, each worked out once for every different combination of these columns and joined back.

    A column that rows have already is replaced.
    """
    named = {f"_by_{c}": F.col(c) for c in columns}
    keys = settled(rows.select(*columns).distinct().select(*(c.alias(k) for k, c in named.items()), *(c.alias(f"_new_{k}") for k, c in derived.items())))
    same = F.lit(True)
    for k, c in named.items():
        same = same & c.eqNullSafe(F.col(k))
    joined = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, same)
    kept = [c for c in rows.columns if c not in derived]
    return joined.select(*kept, *(F.col(f"_new_{k}").alias(k) for k in derived))


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a value that is worked out once, however often later columns and filters read it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
