"""Two witnesses of one record: confirm, fill, report conflicts, add; keep-one rules."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.normalise import compare_value, filled_count, is_blank, text
from lintel.operators.skew import dealt

#: What must hold something, twice at least, for a door that only the second witness has to be added.
PHYSICAL = ("door_width", "door_height", "door_material", "door_type", "frame_type", "fire_rating")


def filled(primary: Column, witness: Column) -> Column:
    """The primary's value, or the witness's where that is blank and this is not."""
    return F.when(is_blank(primary) & ~is_blank(witness), witness).otherwise(primary)


def conflict(name: str, primary: Column, witness: Column) -> Column:
    """A note of two values that disagree in letters or digits, else null."""
    differ = ~is_blank(primary) & ~is_blank(witness) & (compare_value(primary) != compare_value(witness))
    return F.when(differ, F.concat(F.lit(f"{name}: text='"), primary, F.lit("' direct_pdf='"), witness, F.lit("'")))


def reconciled(primary: DataFrame, witness: DataFrame, keys: list[str], fields: list[str], least: int = 2) -> DataFrame:
    """Primary rows, filled and marked from the witness row of the same key, and the witness's own rows that have
    at least this many physical fields. Both sides have one row for each key."""
    ours, theirs = primary.alias("p"), witness.alias("w")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"p.{k}") == F.col(f"w.{k}"))
    joined = ours.join(theirs, same, "full_outer")
    both = F.col(f"p.{keys[0]}").isNotNull() & F.col(f"w.{keys[0]}").isNotNull()
    added = F.col(f"p.{keys[0]}").isNull()
    notes = F.array_compact(F.array(*(conflict(f, F.col(f"p.{f}"), F.col(f"w.{f}")) for f in fields)))
    score = filled_count(*(F.col(f"w.{f}") for f in PHYSICAL if f in fields))
    gained = sum(((is_blank(F.col(f"p.{f}")) & ~is_blank(F.col(f"w.{f}"))).cast("int") for f in fields), F.lit(0))
    decision = F.when(added, "direct_pdf_added").when(both & (F.size(notes) > 0), "direct_pdf_conflict;direct_pdf_confirmed").when(both, "direct_pdf_confirmed").otherwise("")
    return joined.where(~added | (score >= least)).select(
        *(F.coalesce(f"p.{k}", f"w.{k}").alias(k) for k in keys),
        *(F.when(added, F.col(f"w.{f}")).when(both, filled(F.col(f"p.{f}"), F.col(f"w.{f}"))).otherwise(F.col(f"p.{f}")).alias(f) for f in fields),
        F.when(both, F.array_join(notes, "; ")).otherwise("").alias("hybrid_conflicts"),
        decision.alias("hybrid_decision"),
        F.when(both, gained).otherwise(0).cast("int").alias("fields_filled"),
    )


def merge_metrics(merged: DataFrame) -> DataFrame:
    """How many rows were confirmed, added, in conflict, and how many fields were filled."""
    d = F.col("hybrid_decision")
    return merged.agg(F.count_if(d.contains("confirmed")).alias("confirmed"), F.count_if(d == "direct_pdf_added").alias("added"), F.count_if(d.contains("conflict")).alias("in_conflict"), F.sum("fields_filled").cast("long").alias("fields_filled"))


#: Rows of a task that sorts whole rows by key.
ROWS = 200_000


def richest(rows: DataFrame, key: Column, order: list[Column], fields: list[str], n_rows: int | None = None) -> DataFrame:
    """Of each key, blank ones left out, the row with most fields; the first of equals. Where the number of rows is given, they are
    dealt to as many tasks as sort them in memory."""
    window = Window.partitionBy("_key").orderBy(filled_count(*(F.col(f) for f in fields)).desc(), *order)
    keyed = rows.withColumn("_key", key).where("_key <> ''")
    keyed = keyed if n_rows is None else dealt(keyed, "_key", n_rows, ROWS)
    return keyed.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_key", "_nth")


def first_of(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in this order; W6 and W7 with the order turned round."""
    named = {f"_key{i}": k for i, k in enumerate(keys)}
    window = Window.partitionBy(*named).orderBy(*order)
    return rows.withColumns(named).withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop(*named, "_nth")


def upserted(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The updates' values where they have one, the base's otherwise; rows of either side stay."""
    joined = base.alias("b").join(updates.alias("u"), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(f"u.{c}", f"b.{c}").alias(c) for c in base.columns if c not in keys))


def door_key(c: Column) -> Column:
    return F.upper(text(c))
