"""Hardware layouts and row validation."""

import pytest

from lintel.operators import hardware, validate

# Sheets of each layout, made for these tests.
VENDOR = """
Part 8 | DOOR HARDWARE SCHEDULE | Hardware Sets |
Set #61 - STORE - WITH DEADBOLT |
3 Hinge | TA2714 5 x 4 1/2 | US32D HA |
1 Deadbolt | B60-P x 12 | SP28, 28AN FL |
2 Closer | 4110EDA | 691 | NO |
Set #62 - SLIDING PARTITION |
2 Pull Handle | 77 | US26 | HA |
"""
SMALL = """
DOOR HARDWARE SCHEDULE
Hardware Sets
Set #5 - LARGE STORE
1 SET Seals | 160V | 627 | NGP
"""
GRID = """
HARDWARE SCHEDULE
SET: 2.0 | SET: 9.0
3 EA. BUTT HINGE | 1 EA. MORTISE LOCK
1 EA. RIM EXIT DEVICE, LESS DOGGING | 2 EA. SILENCER
1 EA. OVERHEAD STOP | 1 EA. WALL BUMPER
305 | 2'-8" | 6'-8" | 1 3/8" | B | FLUSH | STAIN | OAK | 12
"""
GROUPS = """
Hardware Group No. 02.B | Hardware Group No. 11 | Hardware Group No. 20 | REVISIONS
Provide each PR door(s) with the following: | Provide each SGL door(s) with the following: | Provide each SGL door(s) with the following: | DOOR SCHEDULE
QTY DESCRIPTION | CATALOG NUMBER | FINISH MFR. | QTY DESCRIPTION | CATALOG NUMBER | FINISH MFR. | QTY DESCRIPTION | CATALOG NUMBER | FINISH MFR. | Mark | Room Name
2 EA PIVOT HINGE | 7215 OFFSET TO SUIT | 630 IVE | 4 EA HINGE | 3CB1 5 X 4.5 | 626 IVE | 4 EA HINGE | 3CB1 5 X 4.5 | 626 IVE | 040 | FOYER
1 EA FIRE EXIT HARDWARE | PA-98-L | 630 VON | 1 EA STOREROOM LOCK | L9080P 07B | 630 SCH | 1 EA PRIVACY LOCK | L9040 07B L583-363 | 630 SCH | 041 | BOILER ROOM
1 EA RIM CYLINDER | AS EXISTING "BLUE KEY" | BLU | 1 EA FLOOR STOP | FS439 | 626 IVE | 1 EA SURFACE CLOSER | 4040XP EDA X PLATE | 689 LCN
"""


@pytest.fixture(scope="module")
def parts(spark):
    pages = spark.createDataFrame(list(enumerate([VENDOR, SMALL, GRID, GROUPS, "SET 1\n1 EA HINGE", "", None])), "page_id int, body string")
    found: dict = {}
    for r in hardware.page_components(pages).orderBy("page_id", "at").collect():
        found.setdefault(r.page_id, []).append(r)
    return found


def test_vendor_lists(parts):
    rows = {(r.hardware_set_id, r.description): r for r in parts[0]}
    assert len(rows) == 4 and {r.layout for r in parts[0]} == {"vendor"}
    hinge = rows["61", "Hinge"]
    assert (hinge.qty, hinge.catalog_number, hinge.finish_code, hinge.manufacturer_code) == (3, "TA2714 5 x 4 1/2", "US32D", "HA")
    assert (rows["61", "Deadbolt"].finish_code, rows["61", "Deadbolt"].manufacturer_code) == ("SP28, 28AN", "FL")
    assert (rows["61", "Closer"].catalog_number, rows["61", "Closer"].finish_code) == ("4110EDA", "691")
    assert (rows["62", "Pull Handle"].catalog_number, rows["62", "Pull Handle"].hardware_set_name) == ("77", "SLIDING PARTITION")
    assert [(r.unit, r.catalog_number) for r in parts[1]] == [("SET", "160V")]


def test_grid_columns(parts):
    by_set: dict = {}
    for r in parts[2]:
        by_set.setdefault(r.hardware_set_id, []).append(r.description)
    assert by_set == {"2": ["BUTT HINGE", "RIM EXIT DEVICE, LESS DOGGING", "OVERHEAD STOP"], "9": ["MORTISE LOCK", "SILENCER", "WALL BUMPER"]}


def test_group_columns(parts):
    rows = {(r.hardware_set_id, r.description): r for r in parts[3]}
    assert len(rows) == 9
    assert rows["02.B", "PIVOT HINGE"].catalog_number == "7215 OFFSET TO SUIT"
    assert rows["11", "STOREROOM LOCK"].manufacturer_code == "SCH"
    assert rows["20", "SURFACE CLOSER"].finish_code == "689"
    assert not {4, 5, 6} & set(parts)


def test_validated_doors(spark):
    schema = "page int, door_number string, door_width string, door_type string, hardware_set string, fire_rating string, extra_fields map<string,string>"
    rows = [(1, " 101A ", "6'-0\"", "n/a", "HW-4.0", "NONE", {"door_type": "A", "door_width": "9'", "note": "x", "gone": "TBD", "remarks": "r"}), (2, "RESTROOM", None, None, None, None, None), (3, "NUMBER", None, None, None, None, None), (4, "D2", None, "PAIR", None, "45 MIN", None), (5, None, None, None, None, None, None), (6, "103", None, None, "-", None, {"door_width": "6'-0\""})]
    found = {r.page: r for r in validate.validated_doors(spark.createDataFrame(rows, schema), "page").collect()}
    assert set(found) == {1, 4, 6}
    one = found[1]
    assert (one.door_number, one.door_type, one.door_width, one.hardware_set, one.fire_rating, one.remarks, one.is_pair, one.extra_fields) == ("101A", "A", "6'-0\"", "4", None, "r", True, {"note": "x"})
    assert (found[4].is_pair, found[4].door_leaves, found[4].fire_rating) == (True, 2, "45 MIN")
    assert (found[6].door_width, found[6].is_pair, found[6].hardware_set) == (None, False, None)
    flat = validate.flattened(validate.validated_doors(spark.createDataFrame(rows[:1], schema), "page"), ["note", "door_type"])
    assert validate.reordered(flat, ["note", "none", "door_number"]).columns[:3] == ["note", "door_number", "page"]


def test_validated_components(spark):
    schema = "page int, hardware_set_id string, description string, qty string, unit string, catalog_number string"
    rows = [(1, "SET 5.0", "HINGE", "3 EA", None, "5BB1"), (2, "5", "Description", "1", None, None), (3, None, None, None, None, None), (4, "5", "GLASS PANEL / DOOR & FRAME TO BE PAINTED", "1", None, None), (5, None, "closer", "LOT", "prs", None)]
    found = [tuple(r)[:7] for r in validate.validated_components(spark.createDataFrame(rows, schema), "page").orderBy("page").collect()]
    assert found == [(1, "5", None, 3, "3 EA", "EA", "HINGE"), (5, "?", None, None, "LOT", "PAIR", "closer")]
