"""Tables that must outlive a task, in the folder every executor sees."""

from pyspark.sql import DataFrame, SparkSession

from lintel.plans.storage import remove_table, settled, shared_folder, write_table

__all__ = ["checkpointed", "held", "release", "remove_table", "shared_folder", "write_table", "written"]

#: Tables that frames may still read.
_HELD: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    return settled(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a Parquet table to the shared folder and read again; it stays until it is released."""
    path = write_table(df, name)
    _HELD.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held() -> int:
    """How many tables of written() there are, for release()."""
    return len(_HELD)


def release(spark: SparkSession, since: int) -> None:
    """Deletes the tables of written() but for the first so many: for a caller that has written what it made of its own."""
    while len(_HELD) > since:
        remove_table(spark, _HELD.pop())
