"""Normalisers, predicates and page signals on known cases."""

import pytest
from pyspark.sql import functions as F

from lintel.functions import normalise as N
from lintel.functions import pages as G
from lintel.functions import predicates as P


def values(spark, cases, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
    return [r.r for r in frame.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("build", "cases"),
    [
        (N.blank_if_unknown, {"N/A": None, "not shown": None, "HM": "HM", " x ": "x", None: None}),
        (N.set_id, {"Set 1": "1", "1.0": "1", None: "?", "set": "?", "No. 7": "7"}),
        (N.quantity, {"LOT": None, "3 EA": 3, "0": 1, "": None, None: None, "none of 4": 4}),
        (N.unit, {"each": "EA", "PRS": "PAIR", "": None, None: "EA", "box": "EA"}),
        (N.door_hardware_set, {"HW 5": "5", "-": None, "—": None, "set": None}),
        (N.fire_rating, {"NONE": None, "none": "none", "45 MIN": "45 MIN"}),
        (N.join_id, {"HARDWARE SET 5": "SET 5", "7.0": "7", "Group #7": "7", "N/A": "", "HW-3": "3"}),
        (N.reference_id, {"Set 5.0": "5", "Group 7.0": "7", None: ""}),
        (N.set_label, {"Hardware Set #7.0": "7", "HW-12A": "12A", ".5": "5", "a--b": "a-b"}),
        (N.set_key, {"Set 007": "7", "B | A": "A | B", "Hardware Group No. 4": "4", "hw-3": "3", "": ""}),
        (N.ocr_dimension, {"3'O\"": "3'-0\"", "3.0": "3'-0\"", "x": "x", "": None}),
        (N.ocr_door_mark, {"1O1": "101", "|O1": "101", "LOBBY": "LOBBY"}),
        (N.project_id, {"Project 12 x": "project_12", "Site A-B": "site_a_b", "!!": "unknown"}),
        (N.project_name, {"Untitled": None, "untitled project": None, "Tower": "Tower"}),
        (N.level_side, {"Level 1": "level_1", "Level 12": "above", "Level 21": "level_1", "roof": "above", None: None}),
        (P.is_door_mark, {"101A": True, "D1": True, "1": True, "RESTROOM": False, "KITCHEN": False, None: False}),
        (P.is_quote_file, {"P26_quote.pdf": True, "proposal.pdf": True, "Door Schedule.pdf": False}),
        (P.is_finish_code, {"626": True, "US26D, 630": True, "": False, "BRASS": False}),
        (P.is_hardware_dimension, {"4 1/2\"": True, "36\"": False, "3'-0\"": False, "1.75": True, "12": False}),
        (G.unstuttered, {"MMAARRKK\nok": "MARK\nok", "aabc": "aabc"}),
        (G.unreversed, {"TES ERAWDRAH": "HARDWARE SET", "EPYT ROOD": "DOOR TYPE"}),
        (G.unprivate, {"": "DOOR", "plain": "plain"}),
    ],
)
def test_values(spark, build, cases):
    assert values(spark, list(cases), build) == list(cases.values())


def test_pairs(spark):
    frame = spark.createDataFrame([("6'-0\"", None, True), ("3'-0\"", None, False), ("3'-0\" x 3'-0\"", None, True), (None, "DBL", True), ("72", None, True), ("36", "A", False)], "w string, t string, e boolean")
    assert frame.where(N.is_pair(F.col("w"), F.col("t")) != F.col("e")).count() == 0


def test_from_to_and_sizes(spark):
    assert [tuple(r) for r in values(spark, ["HALL to ROOM", "A / B - C", "LOBBY", None], N.from_to)] == [("HALL", "ROOM"), ("A", "B / C"), ("", "LOBBY"), ("", "")]
    assert [tuple(r) for r in values(spark, ["3'-0\" x 7'-0\"", "(2) 3.0 7.0", "x"], N.size_pair)] == [("3'-0\"", "7'-0\""), ("3'-0\"", "7'-0\""), (None, None)]


def test_components(spark):
    rows = [
        ("surface closer", "1", None, None, None, None, True), ("ELECTRIC STRIKE", "1", "6211", None, None, "1", True), ("HARDWARE SET 4", "4", None, None, None, None, False), ("Set #3", "3", None, None, None, "1", False),
        ("DOOR SCHEDULE", "1", None, None, None, "1", False), ("TRASH CAN", "1", "x", None, None, "1", False), ("RESTROOM", "1", None, None, None, "1", False), ("101A", "1", None, None, None, "1", False),
        ("hinge", "1", None, "ABC Corp", None, "1", False), ("widget", "1", None, None, None, None, False), ("widget", "1", "C-9", None, None, None, True), (None, "1", "C-9", None, None, None, False), ("CPT / VCT", "1", "a", None, None, "1", False),
    ]
    frame = spark.createDataFrame(rows, "d string, s string, c string, m string, n string, q string, e boolean")
    got = frame.withColumn("got", P.is_component(F.col("d"), F.col("s"), F.col("c"), F.col("m"), F.col("n"), N.quantity(F.col("q")), F.col("q")))
    assert [r.d for r in got.where("got <> e").collect()] == []


def test_page_evidence(spark):
    body = "DOOR SCHEDULE\nD101A | 3'-0\" | 7'-0\" | HM\n[107] | 3'-0\" | 7'-0\" | WD\nbuilt 1998"
    row = spark.createDataFrame([(body,), (None,)], "b string").select(G.evidence(F.col("b")).alias("e")).select("e.*", *(c.alias(k) for k, c in G.judged(F.col("e")).items())).collect()
    assert row[0].real_door_numbers >= 2 and row[0].dimensions >= 4 and row[0].is_door_schedule and row[0].expected_door_rows == 2
    assert row[1].text_length == 0 and row[1].confidence == 0


def test_canonical_row(spark):
    frame = spark.sql("SELECT map('Mark', '101', 'WIDTH', '3', 'door width', '4', 'colour', 'red') AS m")
    row = frame.select(N.canonical_row(F.col("m")).alias("r")).first().r
    assert row.fields == {"door_number": "101", "door_width": "4"} and row.extra == {"colour": "red"}
