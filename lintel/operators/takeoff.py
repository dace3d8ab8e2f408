"""Doors against hardware: join status, back-fill, aggregate, project quantities."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.normalise import join_id, quantity, status_join_id, strip
from lintel.functions.predicates import is_component, is_real_door
from lintel.operators.distinct import with_distinct
from lintel.plans.storage import settled

DIMENSIONS = ("door_width", "door_height", "frame_width", "frame_height")
PHYSICAL = ("door_thickness", "door_material", "door_finish", "frame_material", "frame_finish", "fire_rating")


def plausible_components(components: DataFrame) -> DataFrame:
    """components that are hardware."""
    c = {k: F.col(k) for k in ("description", "hardware_set_id", "catalog_number", "manufacturer_code", "notes", "qty_raw")}
    return components.where(is_component(c["description"], c["hardware_set_id"], c["catalog_number"], c["manufacturer_code"], c["notes"], quantity(c["qty_raw"]), c["qty_raw"]))


def with_join_status(doors: DataFrame, components: DataFrame) -> DataFrame:
    """hardware_set_clean and hardware_set_join_status; the set ids of all projects count together.

    The ids are one row each before they meet the doors; Spark broadcasts them if they are small.
    """
    ids = settled(components.select(status_join_id(F.col("hardware_set_id")).alias("id")).where("id <> ''").distinct().withColumn("known", F.lit(True)))
    joined = with_distinct(doors, ["hardware_set"], hardware_set_clean=status_join_id(F.col("hardware_set"))).join(ids, F.col("hardware_set_clean") == F.col("id"), "left")
    unknown = "not_checked_no_hardware_components" if ids.isEmpty() else "unmatched"
    status = F.when(F.col("hardware_set_clean") == "", "missing").when(F.col("known"), "matched").otherwise(unknown)
    return joined.withColumn("hardware_set_join_status", status).drop("id", "known")


def backfilled(doors: DataFrame, components: DataFrame) -> DataFrame:
    """Blank sets take the project's component set whose id is the door number, else the project's only set."""
    parts = components.where(F.col("hardware_set_id").isNotNull())
    by_number = parts.select("project_id", join_id(F.col("hardware_set_id")).alias("id"), strip(F.col("hardware_set_id")).alias("raw"), "row_key").where("id <> ''")
    by_number = by_number.groupBy("project_id", "id").agg(F.min_by("raw", F.struct("row_key", "raw")).alias("by_number"))
    only = parts.groupBy("project_id").agg(F.count_distinct("hardware_set_id").alias("n"), F.min("hardware_set_id").alias("only_set")).where("n = 1").drop("n")
    blank = F.coalesce(strip(F.col("hardware_set")), F.lit("")) == ""
    joined = doors.withColumn("id", join_id(F.col("door_number"))).join(by_number, ["project_id", "id"], "left").join(only, "project_id", "left")
    return joined.withColumn("hardware_set", F.when(blank, F.coalesce("by_number", "only_set", "hardware_set")).otherwise(F.col("hardware_set"))).drop("id", "by_number", "only_set")


def real_doors(doors: DataFrame) -> DataFrame:
    """without the doors that hardware lists only name."""
    have = lambda names: [F.col(c) for c in names if c in doors.columns]
    return doors.where(is_real_door(F.col("door_number"), F.col("source_file"), have(DIMENSIONS), have(PHYSICAL)))


def most_complete(doors: DataFrame, order: tuple[str, ...] = ("source_file", "page", "row_key")) -> DataFrame:
    """Of each (project, door number) the row with most columns filled; ties go by these columns, then by all."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in doors.columns), F.lit(0))
    rest = [F.col(c) for c in doors.columns if c not in order]
    window = Window.partitionBy("project_id", "door_number").orderBy(filled.desc(), *order, *rest)
    return doors.withColumn("nth", F.row_number().over(window)).where("nth = 1").drop("nth")


def door_aggregate(doors: DataFrame) -> DataFrame:
    """A1: counts of a project's doors by set; doors (is_pair, door_leaves) that match a set."""
    return (
        doors.where((F.col("hardware_set_clean") != "") & (F.col("hardware_set_join_status") == "matched"))
        .groupBy("project_id", F.col("hardware_set_clean").alias("hardware_set_id"))
        .agg(F.count("door_number").alias("total_doors"), F.count_if(~F.col("is_pair")).alias("unit_doors"), F.count_if("is_pair").alias("pair_doors"), F.sum("door_leaves").cast("long").alias("door_leaves"))
    )


def project_quantities(aggregate: DataFrame, components: DataFrame) -> DataFrame:
    """Each component of each set that doors use, with quantity times doors (not leaves)."""
    parts = components.withColumn("hardware_set_id", status_join_id(F.col("hardware_set_id")))
    per_set = F.coalesce(quantity(F.col("qty_raw")), F.lit(0)).cast("long")
    joined = aggregate.join(parts.select("project_id", "hardware_set_id", "description", "catalog_number", "finish_code", "manufacturer_code", "qty_raw"), ["project_id", "hardware_set_id"], "left")
    return joined.withColumn("qty_per_set", per_set).withColumn("total_qty_project", F.col("qty_per_set") * F.col("total_doors")).drop("qty_raw")
