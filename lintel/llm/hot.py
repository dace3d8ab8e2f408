"""Joins of rows whose key may be that of very many others, with a table that has each key once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.storage import checkpointed

#: Rows of one key from which it counts as hot, and hot keys that are broadcast: if there are more, those with most rows.
HOT, BROADCAST_KEYS = 200, 100_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that very many rows have, a small table; none if there are none."""
    return hottest(rows.groupBy(key).agg(F.count("*").alias("n")), key)


def hottest(counts: DataFrame, key: str) -> DataFrame | None:
    """The keys with most rows of a table of keys and numbers of rows n, a small table; none if no key is hot."""
    hot = checkpointed(counts.where(F.col("n") >= HOT).orderBy(F.col("n").desc(), key).limit(BROADCAST_KEYS).select(key))
    return None if hot.isEmpty() else hot


def looked_up(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with their key's row of table. Rows of hot keys stay where they are and get it by broadcast; only the others are shuffled."""
    if hot is None:
        return rows.join(table, key)
    known = F.broadcast(hot)
    own = F.broadcast(checkpointed(table.join(known, key, "left_semi")))
    return rows.join(own, key).unionByName(rows.join(known, key, "left_anti").join(table, key))
