"""Places in a total order over all rows, without one task or array that holds them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.plans.storage import settled


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their places from 1 in this order: dealt by ranges of it, numbered within each range, moved by the sizes of the ranges before.

    The sizes are a row for each partition. Rows that tie in the whole order have some order among themselves.
    """
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    dealt = settled(rows.select("*", *(c.alias(k) for k, c in keys.items())).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # as many rows as partitions
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, within + F.col("_before")).select(*rows.columns, name)
