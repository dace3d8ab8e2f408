"""Rescue over recorded answers, on pages made by hand."""

import pytest
from pyspark.sql import functions as F

from lintel.functions.pages import evidence
from lintel.operators import rescue

DOORS = "page_id int, row_no int, door_number string, hardware_set string, door_width string, door_height string, door_material string"
PARTS = "page_id int, row_no int, hardware_set_id string, description string"
SCHEDULE = "DOOR SCHEDULE\n" + "\n".join(f"| {100 + k} | 3'-0\" | 7'-0\" | HM |" for k in range(8))
SETS = "HARDWARE SETS\n" + "\n".join(f"HARDWARE SET NO. {k}\n3 EA HINGE\n1 CLOSER\n1 LOCKSET" for k in range(1, 5))


@pytest.fixture(scope="module")
def found(spark):
    pages = [(1, "door_schedule", SCHEDULE, 0, 0, 0), (2, "door_schedule", "a page of nothing", 0, 0, 0), (3, "hardware_set", SETS, 1, 0, 1), (4, "mixed", SETS, 2, 0, 2), (5, "door_schedule", SCHEDULE, 2, 2, 0)]
    frame = spark.createDataFrame(pages, "page_id int, kind string, body string, crops int, door_crops int, hardware_crops int").withColumn("e", evidence(F.col("body"))).drop("body")
    doors = [(1, 0, "100", "1", None, None, None), (1, 1, "", "1", "3", None, None), (2, 0, "100", "1", None, None, None), (4, 0, "A1", "SET 9", None, None, None), (4, 1, "A2", "8.0", None, None, None), (5, 0, "100", "1", None, None, None)]
    parts = [(4, 0, "1", "HINGE"), (4, 1, "2", "HINGE"), (4, 2, "3", "HINGE")]
    door_answers = [(p, n, f"{100 + n}", "2", "3", "7", None, "page") for p in (1, 2) for n in range(3)] + [(5, 0, "100", None, None, None, "HM", "crop"), (5, 1, "101", None, None, None, "WD", "crop"), (1, 9, "900", None, "3", "7", "HM", "crop")]
    part_answers = [(3, 0, "1", "HINGE", "page", 0), (3, 1, "set 1", "hinge", "page", 0), (3, 2, "1", " hinge ", "page", 0), (4, 0, "9", "LOCK", "repair", 2), (4, 1, "HW-9", "BOLT", "repair", 1), (4, 2, "9", "STOP", "repair", 1), (4, 3, "7", "NOT ASKED", "repair", 1), (1, 0, "1", "LOCK", "repair", 1)]
    out = rescue.rescued(frame, spark.createDataFrame(doors, DOORS), spark.createDataFrame(parts, PARTS), spark.createDataFrame(door_answers, DOORS + ", step string"), spark.createDataFrame(part_answers, PARTS + ", step string, rank int"))
    return [sorted(map(tuple, x.collect()), key=str) for x in out]


def test_richer_doors_replace_poorer_ones_on_open_pages(found):
    doors = {(r[0], r[2]): (r[3], r[4], r[7]) for r in found[0]}
    assert {k: v for k, v in doors.items() if k[0] == 1} == {(1, f"{100 + n}"): ("2", "3", "page") for n in range(3)}  # a blank mark goes, no crops are asked
    assert doors[2, "100"] == ("1", None, "extracted") and (2, "101") not in doors
    assert doors[5, "100"] == (None, None, "crop") and doors[5, "101"] == (None, None, "crop")


def test_components_are_added_once(found):
    parts = [(r[0], r[2], r[3], r[4]) for r in found[1]]
    assert [p for p in parts if p[0] == 3] == [(3, "1", "HINGE", "page"), (3, "set 1", "hinge", "page")]


def test_missing_sets_come_from_the_first_crop_that_has_them(found):
    repaired = sorted((r[0], r[2], r[3]) for r in found[1] if r[4] == "repair")
    assert repaired == [(4, "9", "STOP"), (4, "HW-9", "BOLT")]
