"""Rescue of pages whose schedules gave less than their text shows, over recorded answers, by additive merges."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.normalise import reference_id, text
from lintel.functions.pages import judged
from lintel.operators import gates
from lintel.operators.reconcile import first_of, richest
from lintel.plans.storage import settled

#: What a richer row of a mark holds more of.
FIELDS = ("door_width", "door_height", "door_material")
PAGE = "page_id"


def _counted(pages: DataFrame, doors: DataFrame, parts: DataFrame) -> DataFrame:
    """pages with what was found on them so far: doors, different marks, doors with a size or material, components, named sets."""
    sized = F.lit(False)
    for c in FIELDS:
        sized = sized | (text(F.col(c)) != "")
    mark = F.nullif(F.upper(text(F.col("door_number"))), F.lit(""))
    d = doors.groupBy(PAGE).agg(F.count("*").alias("n_doors"), F.count_distinct(mark).alias("n_marks"), F.count_if(sized).alias("n_sized"))
    named = F.upper(text(F.col("hardware_set_id")))
    p = parts.groupBy(PAGE).agg(F.count("*").alias("n_parts"), F.count_distinct(F.when(~named.isin("", "?"), named)).alias("n_sets"))
    return pages.join(d, PAGE, "left").join(p, PAGE, "left").fillna(0, ["n_doors", "n_marks", "n_sized", "n_parts", "n_sets"])


def _added(rows: DataFrame, answers: DataFrame, open_: DataFrame, origin: str, merge) -> DataFrame:
    """rows, merged on open pages with the answers of their kind; an answer's rows are marked with where they come from."""
    open_ = settled(open_)
    kept = rows.join(open_, PAGE, "left_anti")
    more = answers.join(open_, PAGE, "left_semi").select(*(c for c in rows.columns if c != "origin"), F.lit(origin).alias("origin"))
    stage = F.when(F.col("origin") == origin, 1).otherwise(0)
    return settled(kept.unionByName(merge(rows.join(open_, PAGE, "left_semi").unionByName(more), stage)))  # the next step reads it several times


def _richer_doors(rows: DataFrame, stage) -> DataFrame:
    key = F.when(text(F.col("door_number")) != "", F.concat_ws("|", F.col(PAGE).cast("string"), F.upper(text(F.col("door_number"))))).otherwise("")
    return richest(rows, key, [stage, F.col("row_no")], list(FIELDS))


def _first_parts(rows: DataFrame, stage) -> DataFrame:
    keys = [F.col(PAGE), F.upper(text(F.col("hardware_set_id"))), F.upper(text(F.col("description")))]
    return first_of(rows, keys, [stage, F.col("row_no")])


def rescued(pages: DataFrame, doors: DataFrame, parts: DataFrame, door_answers: DataFrame, part_answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Doors and components with what recorded answers add where a page's evidence asks for it, each row with its origin.

    pages: page_id, kind, e (its evidence), crops, door_crops, hardware_crops. doors: page_id, row_no, door_number, hardware_set and
    FIELDS. parts: page_id, row_no, hardware_set_id, description. Answers are rows of the same kind with a step: page or crop, and for parts
    repair, with the rank of the crop that they come from.

    The gates F15 to F18 are asked one after the other, each with the counts that the merges before it left; doors keep the richest row of
    a mark (W3), components the first of a set and description (W4). Then sets that doors of the page name and no component has (J19) are
    taken from the first crop whose answer has them. Nothing is taken away but rows of a mark that a richer one replaces, so the steps are the
    whole fixpoint: components name no further sets.
    """
    doors, parts = (settled(x.withColumn("origin", F.lit("extracted"))) for x in (doors, parts))
    e, kind = F.col("e"), F.col("kind")
    j = judged(e)

    def open_(gate) -> DataFrame:
        return _counted(pages, doors, parts).where(F.coalesce(gate, F.lit(False))).select(PAGE)

    n = {c: F.col(f"n_{c}") for c in ("doors", "marks", "sized", "parts", "sets")}
    of = lambda answers, step: answers.where(F.col("step") == step)
    doors = _added(doors, of(door_answers, "page"), open_(gates.needs_door_rescue(kind, e, j, n["doors"], n["marks"])), "page", _richer_doors)
    crop = gates.needs_crop_door_rescue(kind, e, j, n["doors"], n["marks"], n["sized"], n["parts"], F.col("crops"), F.col("door_crops"))
    doors = _added(doors, of(door_answers, "crop"), open_(crop), "crop", _richer_doors)
    parts = _added(parts, of(part_answers, "page"), open_(gates.needs_hardware_rescue(kind, e, j, n["parts"], n["sets"])), "page", _first_parts)
    crop = gates.needs_crop_hardware_rescue(kind, e, j, n["parts"], n["sets"], F.col("crops"), F.col("hardware_crops"))
    parts = _added(parts, of(part_answers, "crop"), open_(crop), "crop", _first_parts)

    set_id = lambda c: reference_id(F.col(c))
    wanted = doors.select(PAGE, set_id("hardware_set").alias("set_id")).where("set_id <> ''").distinct()
    missing = wanted.join(parts.select(PAGE, set_id("hardware_set_id").alias("set_id")), [PAGE, "set_id"], "left_anti")
    able = _counted(pages, doors, parts).where((F.col("hardware_crops") > 0) & ((n["parts"] > 0) | j["is_hardware_schedule"] | kind.isin(gates.HARDWARE, gates.MIXED))).select(PAGE)
    offered = of(part_answers, "repair").withColumn("set_id", set_id("hardware_set_id")).join(missing, [PAGE, "set_id"], "left_semi").join(able, PAGE, "left_semi")
    first = F.min("rank").over(Window.partitionBy(PAGE, "set_id"))
    repairs = offered.withColumn("first", first).where(F.col("rank") == F.col("first"))
    parts = _added(parts, repairs, repairs.select(PAGE).distinct(), "repair", _first_parts)
    return doors, parts
