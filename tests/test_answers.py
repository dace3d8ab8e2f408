"""Rows in nested answers, and door rows from OCR words."""

import json

from pyspark.sql import functions as F

from lintel.operators import answers, ocr


def test_nested_rows(spark):
    row, part = {"mark": "1", "w": "3"}, {"set": "4"}
    cases = [
        ([row, 5, part], [row, part]), ([], []), ([1, 2], None), ({"door_number": "7"}, [{"door_number": "7"}]), ({"a": 1, "rows": [row]}, [row]), ({"Door Schedule": {"Doors": [row, part]}}, [row, part]),
        ({"a": {"b": {"c": {"d": [row]}}}}, [row]), ({"a": {"b": {"c": {"d": {"e": [row]}}}}}, None), ({"a": "x", "b": [1]}, None), ({"x": {"y": 1}, "z": {"w": [part]}}, [part]), ("plain", None), (None, None),
    ]
    frame = spark.createDataFrame([(i, json.dumps(c) if c is not None else None) for i, (c, _) in enumerate(cases)], "i int, answer string")
    found = {r.i: r.rows for r in frame.select("i", answers.found_rows(F.col("answer")).alias("rows")).collect()}
    assert [None if found[i] is None else [json.loads(x) for x in found[i]] for i in range(len(cases))] == [want for _, want in cases]


def test_named_rows(spark):
    row = {"mark": "1"}
    cases = [({"Door Rows": [row], "x": [{"set": "2"}]}, [row]), ({"a": {"b": {"door_rows": {"deep": [row]}}}}, [row]), ({"other": [row]}, []), ({"door-rows": "none", "a": {"doorRows": [row]}}, [row]), ([row], [])]
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, answer string")
    found = {r.i: [json.loads(x) for x in r.rows] for r in frame.select("i", answers.named_rows(F.col("answer"), ["doorrows"]).alias("rows")).collect()}
    assert [found[i] for i in range(len(cases))] == [want for _, want in cases]


ITEMS = "page_id int, y int, x int, text string"


def test_tables_that_run_across(spark):
    words = [(1, 50, 100, "NUMBER"), (1, 52, 300, "ROOM NAME"), (1, 50, 600, "SIZE"), (1, 48, 800, "TYPE"), (1, 50, 1000, "HARDWARE"), (1, 50, 1200, "RATING"), (1, 10, 100, "DOOR SCHEDULE")]
    for i, mark in enumerate(["101", "1O2", "193", "104", "105"]):
        y = 104 + 40 * i
        words += [(1, y, 105, mark), (1, y + 2, 108, mark), (1, y + 3, 310, "HALL"), (1, y, 340, f"{i}A"), (1, y - 2, 590, "3'-O\" X 7'-0\""), (1, y, 805, "a"), (1, y, 1005, f"{i}"), (1, y, 1205, "45 MIN")]
    words += [(2, 50, 100, "NUMBER"), (2, 50, 600, "SIZE"), (2, 50, 800, "TYPE"), (2, 90, 100, "101"), (3, 1, 1, "x")]
    rows = sorted(tuple(r) for r in ocr.horizontal_rows(spark.createDataFrame(words, ITEMS)).collect())
    assert rows == [(1, f"10{i + 1}", f"HALL {i}A", "3'-0\"", "7'-0\"", "A", f"{i}", "45 MIN", None) for i in range(5)]


def test_tables_on_their_side(spark):
    words = [(1, 20, 400, "NO."), (1, 22, 100, "101"), (1, 18, 200, "102a"), (1, 20, 500, "103"), (1, 60, 110, "HALL"), (1, 70, 190, "LOBBY"), (1, 200, 400, "WIDTH"), (1, 205, 95, "3'-0\""), (1, 210, 205, "3O-0"), (1, 300, 400, "HEIGHT"), (1, 300, 100, "7'-0\""),
             (1, 400, 400, "HARDWARE"), (1, 410, 100, "4b"), (1, 410, 200, "none"), (1, 405, 101, "SET 9"), (2, 20, 400, "NO."), (2, 20, 100, "101")]
    rows = {r.door_number: r for r in ocr.vertical_rows(spark.createDataFrame(words, ITEMS)).collect()}
    assert set(rows) == {"101", "102A"}
    assert (rows["101"].room_name, rows["101"].door_width, rows["101"].door_height, rows["101"].hardware_set) == ("HALL", "3'-0\"", "7'-0\"", "4B")
    assert (rows["102A"].room_name, rows["102A"].door_width, rows["102A"].hardware_set) == ("LOBBY", "30'-0\"", None)
