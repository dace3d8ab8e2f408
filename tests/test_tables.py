"""Table parsers on rows of each shape."""

import pytest

from lintel.operators import tables

# Sheets of each shape, made for these tests.
OPENINGS = """
[Source: pdfplumber_rows]
DOORS AND HARDWARE, WEST WING
Opening List
Opening | Hdw Set | Label | Door Type | Frame Type
E204 | 31 | 45 | P | M
E205A | 8 |  | Q | N
W17 | 31 | 90 | P | M
"""
REPEATED = """
[Source: pdfplumber_rows]
NO | TYPE | SIZE | FRAME | HDWR
K310 | C | 2'-8" x 6'-8" | WD | 14
K311 | C | 2'-8" x 6'-8" | WD | K311
K312 | C | 2'-8" x 6'-8" | WD | 9
"""
PACKED = """
[Source: pdfplumber_rows]
DOOR SCHEDULE
TAG ROOM | STATUS | DESCRIPTION | WIDTH HEIGHT THICKNESS TYPE | FRAME | MATERIAL | STILE | HARDWARE SET STATUS | REMARKS
6 | LOADING DOCK NEW | NEW PAIR OF STEEL | 7' - 0" 8' - 0" 0' - 2" B | SEE A610 | STEEL | HM | NARROW (3") 12 | NEW | 5,6
7 | ARCHIVE | NEW SINGLE WOOD | 2' - 10" 6' - 8" 0' - 1 3/8" D | SEE A610 | WOOD | WD | WIDE (6") 9B | NEW
9 | KITCHEN | NEW COOK'S ENTRY | 3' - 4" 7' - 2" 0' - 1 3/4" E | F2 (SEE A611) 5 | H.M. | - | 15 | NEW
"""
FORMAL = """
[Source: pdfplumber_rows]
305C | DRIVEWAY | FOYER | 7' - 0" 6' - 8" | 0' - 1 3/4" STEEL | DD | GG | STEEL | 4 | GG | A7.10/03 | A7.10/04 | A7.10/05 | 6 | K.P. CONTROL | No. | Date

[Source: pdfplumber_tables]
=== TABLE (4x22) ===
|  |  | 305A | OLD STAIR | FOYER | 7' - 0" | 6' - 8" | 0' - 1 3/4" | HM | CC | PT | HM | 3 | PT |  |  |  | 60 MIN. | 21 | RATED OPENING |  |  |
|  |  | 305C | DRIVEWAY | FOYER | 2' - 8" | 6' - 8" | 0' - 1 3/4" | STEEL | DD | GG | STEEL | 4 | GG | A7.10/03 | A7.10/04 | A7.10/05 |  | 6 | K.P. CONTROL |  |  |
| GENERAL NOTES | 7 | 318B | STORE | SOUTH FOYER | 2' - 6" | 6' - 8" | 0' - 1 3/8" | SC | B | PLAM | WD | 2 | PT | A7.10/11 | A7.10/12 | A7.10/13 |  | 27 |  |  |  |
| 422 | MUSIC 5 | EG | 2'-6" | 7'-6" | 1 3/8" | SCWD | VEN-01 | GL2 | F7B | STEEL | PAINT | GL2 | 02/A8.10 | 09/A8.10 | - | 58T | KLMN |  |  |  |
"""
COMPACT = """
[Source: pdfplumber_rows]
FRAMED OPENING WITHOUT A LEAF | 610A | E | 5'-0" x 7'-2" | E | E | HOLD OPEN ON BOTH SIDES

[Source: pdfplumber_tables]
=== TABLE (4x5) ===
| 611A | B2 | 2'-8" x 6'-10" | WD | HW-12 |
| 612A | B2 | 2'-8" x 6'-10" | WD | HW-7 |
| 613B | E | 2'-6" x 6'-8" | E | E |
| 614A 'E' STAYS AS IT IS. | B2 | 2'-8" x 6'-10" | WD | HW-7 |
"""
TRUNCATED = """
[Source: pdfplumber_rows]
531 | LIBRARY | H4 : EXT | 2'-8" | 6'-8" | 1 3/8" | SCWD VEN-02 | GL3 | F9C | STEEL | PAINT | GL3 | 02/A8.1
"""
STREAM = "DOOR SCHEDULE\n201 | WIDTH | STAIR\n6'-0\" | 7'-0\" | HM | HW-7 | 202\nOFFICE | 3'-0\" | 7'-0\" | 1999 | x | HDWR 8 |"
EMBEDDED = "OFFICE 301 | x | 3'-0\" x 7'-0\" | HM | HW-9\nHINGE 302 | x | 3'-0\" x 7'-0\" | HM | HW-9"


@pytest.fixture(scope="module")
def doors(spark):
    texts = [OPENINGS, REPEATED, PACKED, FORMAL, COMPACT, TRUNCATED, STREAM, EMBEDDED, "", None, "a | b"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id int, body string")
    found: dict = {}
    for r in tables.table_doors(pages).collect():
        assert r.door_number not in found.setdefault(r.page_id, {})
        found[r.page_id][r.door_number] = r
    return found


def test_opening_list(doors):
    rows = doors[0]
    assert set(rows) == {"E204", "E205A", "W17"} and {r.table_shape for r in rows.values()} == {"opening_list"}
    assert {k: (r.hardware_set, r.door_type, r.frame_type) for k, r in rows.items()} == {"E204": ("31", "P", "M"), "E205A": ("8", "Q", "N"), "W17": ("31", "P", "M")}


def test_mark_is_not_its_own_set(doors):
    assert [doors[1][k].hardware_set for k in ("K310", "K311", "K312")] == ["14", None, "9"]


def test_packed_dimensions(doors):
    rows = doors[2]
    assert {k: (r.room_name, r.door_width, r.door_height, r.door_thickness, r.door_type, r.hardware_set, r.is_pair) for k, r in rows.items()} == {
        "6": ("LOADING DOCK", "7' - 0\"", "8' - 0\"", "0' - 2\"", "B", "12", True),
        "7": ("ARCHIVE", "2' - 10\"", "6' - 8\"", "0' - 1 3/8\"", "D", "9B", False),
        "9": ("KITCHEN", "3' - 4\"", "7' - 2\"", "0' - 1 3/4\"", "E", "15", False),
    }


def test_formal_columns(doors):
    rows = doors[3]
    assert set(rows) == {"305A", "305C", "318B", "422"}  # 7 is a note's number
    assert (rows["305A"].hardware_set, rows["305A"].fire_rating, rows["305A"].is_pair) == ("21", "60 MIN.", True)
    assert (rows["305C"].frame_type, rows["305C"].hardware_set, rows["305C"].head_jamb_sill_detail) == ("4", "6", "A7.10/03 / A7.10/04 / A7.10/05")
    assert (rows["318B"].room_name, rows["318B"].hardware_set, rows["422"].hardware_set, rows["422"].door_width) == ("SOUTH FOYER", "27", "58T", "2'-6\"")


def test_compact_columns(doors):
    rows = doors[4]
    assert (rows["610A"].door_type, rows["610A"].hardware_set, rows["610A"].remarks) == ("E", None, "HOLD OPEN ON BOTH SIDES")
    assert [(rows[k].door_type, rows[k].door_width, rows[k].door_height, rows[k].hardware_set) for k in ("611A", "612A")] == [("B2", "2'-8\"", "6'-10\"", s) for s in ("12", "7")]
    assert (rows["613B"].hardware_set, rows["613B"].explicit_blank) == (None, True)
    assert (rows["614A"].remarks, rows["614A"].hardware_set) == ("E' STAYS AS IT IS.", "7")


def test_loose_rows(doors):
    assert (doors[5]["531"].door_width, doors[5]["531"].hardware_set) == ("2'-8\"", None)
    rows = doors[6]
    assert {k: (r.room_name, r.door_width, r.door_height, r.hardware_set, r.is_pair) for k, r in rows.items()} == {"201": ("STAIR", "6'-0\"", "7'-0\"", "7", True), "202": ("OFFICE", "3'-0\"", "7'-0\"", "8", False)}
    assert {k: (r.room_name, r.hardware_set) for k, r in doors[7].items()} == {"301": ("OFFICE", "9")}
    assert not {8, 9, 10} & set(doors)


def test_table_fields_win(spark):
    pages = spark.createDataFrame([(1, COMPACT)], "page_id int, body string")
    schema = "page_id int, door_number string, room_name string, door_width string, door_height string, door_type string, frame_type string, frame_material string, hardware_set string"
    rows = spark.createDataFrame([(1, "611a", "3'-0\"", "9", "6'-10\"", "B2", "WD", "WD", "8"), (1, "613B", "HALL", None, None, None, None, None, "exist"), (1, "999", "door general notes.", "1", None, None, None, None, "E")], schema)
    found = {r.door_number: r for r in tables.with_table_fields(rows, tables.table_doors(pages)).collect()}
    assert (found["611a"].door_width, found["611a"].hardware_set, found["611a"].room_name, found["611a"].changed) == ("2'-8\"", "12", None, 3)
    assert (found["613B"].hardware_set, found["613B"].door_width, found["613B"].room_name, found["613B"].changed) == (None, "2'-6\"", "HALL", 6)
    assert (found["999"].room_name, found["999"].hardware_set, found["999"].changed) == (None, "E", 1)
