"""Relational operators on small cases."""

from collections import Counter

import pytest

from lintel.functions import vocabulary as V
from lintel.operators import bid, layout, mapping, parse, reconcile, reports, rules, skew, takeoff

DOORS = "project_id string, source_file string, page int, door_number string, hardware_set string, door_width string, door_height string, door_type string, door_material string, frame_type string, fire_rating string, level_area string, remarks string, row_key long"
PARTS = "project_id string, hardware_set_id string, description string, catalog_number string, finish_code string, manufacturer_code string, qty_raw string, notes string, row_key long"


def door(number, set_, key=0, project="p", **more):
    row = dict(project_id=project, source_file="Door Schedule.pdf", page=1, door_number=number, hardware_set=set_, door_width="3'-0\"", door_height="7'-0\"", door_type=None, door_material=None, frame_type=None, fire_rating=None, level_area=None, remarks=None, row_key=key)
    return tuple((row | more).values())


def part(set_, description, qty, key=0, project="p", **more):
    row = dict(project_id=project, hardware_set_id=set_, description=description, catalog_number=None, finish_code=None, manufacturer_code=None, qty_raw=qty, notes=None, row_key=key)
    return tuple((row | more).values())


def test_worked_example(spark):
    """Three single doors on one set with 3 hinges, 1 lock, 1 stop need 9, 3 and 3."""
    doors = spark.createDataFrame([door(f"10{i}", "HW-103", i) for i in range(3)], DOORS)
    parts = spark.createDataFrame([part("103.0", "HINGE", "3", 1), part("Set 103", "LOCK", "1", 2), part("103", "WALL STOP", "1", 3), part("104", "HINGE", "3", 4)], PARTS)
    status = takeoff.with_join_status(doors, parts)
    whole = takeoff.door_aggregate(status.selectExpr("*", "false as is_pair", "1 as door_leaves"))
    found = takeoff.project_quantities(whole, parts)
    assert {(r.description, r.total_qty_project) for r in found.collect()} == {("HINGE", 9), ("LOCK", 3), ("WALL STOP", 3)}


def test_join_status(spark):
    doors = spark.createDataFrame([door("1", "HW-5"), door("2", "9"), door("3", ""), door("4", None)], DOORS)
    parts = spark.createDataFrame([part("5.0", "HINGE", "1", project="other")], PARTS)
    states = lambda p: {r.door_number: r.hardware_set_join_status for r in takeoff.with_join_status(doors, p).collect()}
    assert states(parts) == {"1": "matched", "2": "unmatched", "3": "missing", "4": "missing"}
    assert set(states(parts.limit(0)).values()) == {"not_checked_no_hardware_components", "missing"}


def test_backfill(spark):
    doors = spark.createDataFrame([door("203", None, 1), door("204", "", 2), door("C710AM", None, 3), door("1", "7", 4), door("9", None, 5, "q")], DOORS)
    parts = spark.createDataFrame([part("203", "HINGE", "1", 1), part("C710AM", "LOCK", "1", 2), part("Set 4", "LOCK", "1", 3, "q")], PARTS)
    assert {r.door_number: r.hardware_set for r in takeoff.backfilled(doors, parts).collect()} == {"203": "203", "204": "", "C710AM": "C710AM", "1": "7", "9": "Set 4"}


def test_reconcile(spark):
    fields = ["door_width", "door_height", "hardware_set"]
    schema = "door_key string, door_width string, door_height string, hardware_set string"
    ours = spark.createDataFrame([("101", "3'-0\"", None, "1"), ("105", "3'-0\"", None, "1")], schema)
    theirs = spark.createDataFrame([("101", "3'-0\"", "7'-0\"", "10"), ("102", "3'-0\"", "7'-0\"", "1"), ("103", "3'-0\"", None, None)], schema)
    merged = reconcile.reconciled(ours, theirs, ["door_key"], fields)
    rows = {r.door_key: r for r in merged.collect()}
    assert set(rows) == {"101", "102", "105"}
    assert (rows["101"].hardware_set, rows["101"].door_height, rows["101"].fields_filled) == ("1", "7'-0\"", 1)
    assert rows["101"].hybrid_conflicts == "hardware_set: text='1' direct_pdf='10'"
    assert tuple(reconcile.merge_metrics(merged).first()) == (1, 1, 1, 1)


def test_mapping(spark):
    doors = spark.createDataFrame(
        [door("1", "HW-1", 1), door("2", "9", 2), door("3", None, 3), door("4", "1", 4, remarks="NIC"), door("5", "1", 5, remarks="existing to remain"), door("6", None, 6, door_type="coiling"), door("7", "1 & 2", 7), door("8", "1, 9", 8), door("2A", None, 9)], DOORS
    )
    parts = spark.createDataFrame([part("Set 1", "HINGE", "3", 1), part("1.0", "LOCK", "1", 2), part("1.0", "hinge", "3", 3), part("2", "CLOSER", "1", 4), part("2A", "STOP", "1", 5)], PARTS)
    items = mapping.set_items(parts)
    sets = mapping.set_table(parts, items)
    found = mapping.mapped(mapping.resolved(doors, mapping.set_lookup(sets, ["project_id"])), sets, items)
    rows: dict = {}
    for r in found.collect():
        rows.setdefault(r.door_mark, []).append((r.status, r.description))
    assert sorted(rows["1"]) == [("OK", "HINGE"), ("OK", "LOCK")]
    assert rows["2"][0][0] == "FAILED_EXTRACTION_REVIEW_REQUIRED" and rows["3"][0][0] == "NO_HW_SET" and rows["4"][0][0] == "BY_OTHERS"
    assert rows["5"][0][0] == "EXISTING_TO_REMAIN" and rows["6"][0][0] == "COILING_SYSTEM"
    assert sorted(d for _, d in rows["7"]) == ["CLOSER", "HINGE", "LOCK"]
    assert rows["8"][0][0] == "FAILED_EXTRACTION_REVIEW_REQUIRED" and rows["2A"] == [("OK", "STOP")]


def test_mapping_stays_in_its_project(spark):
    """Two projects with sets of one name keep their items; a compound label takes its sets in order, or fails whole."""
    other = lambda row: ("q", *row[1:])
    doors = spark.createDataFrame([door("1", "1", 1), other(door("1", "1", 2)), door("2", "2 and 1", 3), other(door("2", "1 & 2", 4)), other(door("3", "3", 5))], DOORS)
    parts = spark.createDataFrame([part("1", "HINGE", "3", 1), part("2", "LOCK", "1", 2), part("2", "CLOSER", "1", 3), other(part("1", "STOP", "1", 4)), other(part("3", "HARDWARE SET", None, 5))], PARTS)
    items = mapping.set_items(parts)
    sets = mapping.set_table(parts, items)
    found = mapping.mapped(mapping.resolved(doors, mapping.set_lookup(sets, ["project_id"])), sets, items).collect()
    rows = {(r.project_id, r.door_mark, r.item_no): (r.status, r.description) for r in found}
    absent, empty = (V.STATUS_NOTES[k] for k in ("ABSENT", "EMPTY"))
    failed = "FAILED_EXTRACTION_REVIEW_REQUIRED"
    assert rows == {("p", "1", 1): ("OK", "HINGE"), ("q", "1", 1): ("OK", "STOP"), ("p", "2", 1): ("OK", "LOCK"), ("p", "2", 2): ("OK", "CLOSER"), ("p", "2", 3): ("OK", "HINGE"), ("q", "2", None): (failed, absent), ("q", "3", None): (failed, empty)}


@pytest.mark.parametrize("limit", [1, 6, 40, 10**9])
def test_spread_join(spark, limit):
    """Whatever is split, the join is the join: hot keys on either side, on both, repeated rows, nulls, empty sides."""
    left = [(k % 3, i, "x") for k in (0, 0, 0, 0, 1, 2, 3, 5) for i in range(9)] + [(None, 1, "n"), (4, 0, "x"), (4, 0, "x")]
    right = [(k, j) for k, n in ((0, 2), (1, 30), (2, 11), (4, 1), (9, 4)) for j in range(n)] + [(None, 5)]
    lefts, rights = spark.createDataFrame(left, "k int, i int, c string"), spark.createDataFrame(right, "k int, j int")
    want = Counter((a[0], a[1], a[2], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0])
    assert Counter(map(tuple, skew.spread_join(lefts, rights, ["k"], limit).select("k", "i", "c", "j").collect())) == want
    assert skew.spread_join(lefts.limit(0), rights, ["k"], limit).collect() == []


def test_bid_overrides_of_zero_count(spark):
    projects = spark.createDataFrame([("p", 50.0, 60.0, 0.5, 100.0, 10.0, 5.0, 250.0, 10.0, 20.0, 25.0, 8.0, 10.0, True, False, True, True, 2, 1)], "project_id string, distance_miles double, wage_scale_carpenter double, gas_allowance_per_mile double, hotel_allowance_per_day double, meal_allowance_per_day double, parking_allowance_per_day double, tool_mobilization_allowance double, labor_burden_pct double, overhead_pct double, profit_markup_pct double, sales_tax_pct double, material_markup_pct double, drug_testing boolean, parking_required boolean, outstation_stay boolean, apply_tax_to_equipment boolean, doors_level_1 int, doors_above_level_1 int")
    rows = spark.createDataFrame([("p", 4, 30.0, 100.0, None, 0.0), ("p", 2, 60.0, 50.0, 0.0, None), ("p", 1, None, None, None, None)], "project_id string, total_qty_project int, install_time_mins double, default_unit_price double, override_install_time_mins double, override_unit_price double")
    r = bid.bids(projects, rows).first()
    labor = 2 * 60 + 25 + 110 + 150
    before = labor * 1.1 * 1.2 * 1.25
    unload = (2 * 25 + 35) / 60 * (before / 2) + 250
    assert (r.total_man_hours, r.raw_material_cost, r.allowances) == (2.0, 100.0, 285.0)
    assert abs(r.total_labor_bid - (before + unload * 1.08)) < 0.011 and abs(r.total_bid - (before + unload * 1.08 + 110 * 1.08)) < 0.011


def test_risks_and_marks(spark):
    doors = spark.createDataFrame([door(str(i), None, i) for i in range(10)], DOORS)
    parts = spark.createDataFrame([], PARTS)
    sets = mapping.set_table(parts, mapping.set_items(parts))
    row = rules.risks(mapping.resolved(doors, mapping.set_lookup(sets, ["project_id"])), sets).first()
    assert (row.category, row.n, row.openings) == ("Hardware mapping", 10, "0, 1, 2, 3, 4, 5, 6, 7, ...+2 more")


def test_triage(spark):
    schema = "run_id string, status string, pdf_name string, doors int, hardware int, duplicate_doors int, missing_width int, missing_height int, missing_hw_set int, crop_count int, crop_rescue_attempt_pages int, crop_door_added int, crop_hw_added int"
    runs = spark.createDataFrame([("a", "ok", "Door Schedule.pdf", 10, 4, 0, 6, 0, 9, 0, 0, 0, 0), ("b", "error", "x.pdf", 0, 0, 0, 0, 0, 0, 1, 1, 0, 0), ("c", "ok", "Door Schedule.pdf", 5, 5, 0, 0, 0, 0, 0, 0, 0, 0)], schema)
    rows = {r.run_id: r for r in reports.triaged(runs).collect()}
    assert (rows["a"].severity, rows["a"].issues) == ("medium", "missing_width_gt_50pct;missing_hw_set_gt_80pct")
    assert rows["b"].severity == "high" and rows["b"].failure_taxonomy == "table detection failure;wrong page classification;low-confidence skip;OCR failure;rotated text failure"
    assert (rows["c"].severity, rows["c"].failure_taxonomy) == ("ok", "")


def test_layout(spark):
    boxes = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.5, 0.0, 10.0, 10.0), (1, 0, 3, 20.0, 0.0, 30.0, 10.0), (1, 90, 4, 0.0, 0.0, 10.0, 10.0)], "page_id int, rotation int, box_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in layout.distinct_rectangles(boxes).collect()) == [1, 3, 4]
    anchors = spark.createDataFrame([(1, 1, 5.0, 0.0), (1, 2, 50.0, 100.0)], "page_id int, anchor_id int, x double, y double")
    items = spark.createDataFrame([(1, 4.0, 3.0, "near"), (1, 9.0, 1.0, "far"), (1, 5.0, 40.0, "below")], "page_id int, x double, y double, text string")
    assert {(r.anchor_id, r.text) for r in layout.nearest_values(anchors, items, 10.0).collect()} == {(1, "near")}
    marks = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 9, 3, 7, 5])], "page_id int, pos int, number int")
    assert [r.number for r in layout.repaired_sequence(marks).orderBy("pos").collect()] == [1, 2, 3, 4, 5]


def test_parsers(spark):
    body = "| D101A | 3'-0\" | 7'-0\" | HM | 109 |\n| NAME | x |\nSET NO. 103\n3 EA HINGE 5BB1 626 IVE\n1 CLOSER 4040XP\nplain"
    pages = spark.createDataFrame([(1, body)], "page_id int, body string")
    rows = parse.carried_sets(pages).orderBy("line_no").select("hardware_set_id", parse.component_fields(parse.F.col("line")).alias("c")).select("hardware_set_id", "c.*").collect()
    assert [tuple(r) for r in rows] == [("103", 3, "EA", "HINGE 5BB1", "626", "IVE"), ("103", 1, None, "CLOSER 4040XP", None, None)]
    answers = spark.createDataFrame([(1, '```json\n[{"mark": "A",}, {"mark": "B"}\n```')], "answer_id int, answer string")
    assert [r.mark for r in parse.json_rows(answers, "mark: string").orderBy("row_no").collect()] == ["A", "B"]
    table = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "", "y"), (1, 2, "b", "z")], "table_id int, row_no int, first string, rest string")
    assert [(r["first"], r.rest) for r in parse.merged_split_rows(table).orderBy("row_no").collect()] == [("a", "x y"), ("b", "z")]


def _many(spark):
    """Doors of two projects whose sets are named by themselves, by type, remarks, mark or not at all."""
    doors = [door(str(i), [f"HW-{i % 3}", None, "9", "0 and 1"][i % 4], i, "pq"[i % 2], door_type=["1", "x"][i % 2], remarks=["set 2", None, "NIC"][i % 3]) for i in range(40)]
    parts = [part(f"Set {i % 3}", f"HINGE {i}", "2", i, "pq"[i // 6]) for i in range(12)]
    parts = spark.createDataFrame(parts, PARTS)
    items = mapping.set_items(parts)
    return spark.createDataFrame(doors, DOORS), items, mapping.set_table(parts, items)


def test_resolved_looks_up_in_one_shuffle(spark):
    """However many keys a door has, it meets its project's sets by project alone; crowded projects give the same."""
    doors, items, sets = _many(spark)
    lookup = mapping.set_lookup(sets, ["project_id"])
    found = mapping.resolved(doors, lookup)
    for more in ({"entries": 1}, {"rows_apart": 1}):
        assert Counter(mapping.resolved(doors, lookup, **more).select(found.columns).collect()) == Counter(found.collect())
    whole = mapping.mapped(found, sets, items)
    assert Counter(mapping.mapped(found, sets, items, entries=1).collect()) == Counter(whole.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mapping.resolved(doors, lookup)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "key_own" in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and "key_" in x]


def test_mapped_groups_count_openings_once(spark):
    doors, items, sets = _many(spark)
    found = mapping.resolved(doors, mapping.set_lookup(sets, ["project_id"]))
    want = Counter((r.project_id, r.hardware_set, r.description, r.status) for r in mapping.mapped(found, sets, items).collect())
    got = Counter()
    for r in mapping.mapped_groups(found, sets, items).collect():
        got[r.project_id, r.hardware_set, r.description, r.status] += r.n
    assert got == want


def test_richest_deals_rows_by_their_number(spark):
    """Tasks grow in number, not in size."""
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 3, None), ("", 4, "x")], "mark string, n int, w string")
    found = reconcile.richest(rows, rows.mark, [rows.n], ["w"], 9 * reconcile.ROWS)
    assert {(r.mark, r.n) for r in found.collect()} == {("a", 2), ("b", 3)}
    assert ", 9), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_browser_findings_of_crowded_projects(spark):
    columns = "project_id string, mark string, set_label string, fire_rating string, door_type string, opening_type string, room_or_location string, remarks string, interior_or_exterior string, glazing string, confidence double, width string, height string"
    doors = [(p, f"D{i:02}", [None, "1", "2"][i % 3], "45 MIN" if i % 2 else "-", "A5", None, "STAIR 2" if i < 4 else "hall", "KP at wall" if i == 7 else "exit device" if i == 8 else None, None, "none", None, "3", None if i == 5 else "7") for p in ("p", "q") for i in range(20)]
    doors = spark.createDataFrame(doors, columns).repartition(3)
    sets = spark.createDataFrame([("p", "1", [1], None), ("q", "2", [1], "voided"), ("q", "1", [], None)], "project_id string, set_label string, items array<int>, note string")
    context = rules.contexts(spark.createDataFrame([("p", None, None, None, {"KP": "card reader"}), ("q", None, None, None, None)], "project_id string, general_notes array<string>, hardware_preamble array<string>, keying_notes array<string>, legend map<string,string>"))
    found = {tuple(r) for r in rules.browser_findings(doors, sets, context).collect()}
    assert found == {tuple(r) for r in rules.browser_findings(doors, sets, context, entries=0, rows_apart=2).collect()}
    openings = {(r[0], r[3]): r[4:] for r in found}
    assert openings["p", "Fire-rated openings"] == (10, "D01, D03, D05, D07, D09, D11, D13, D15, ...+2 more")
    assert openings["p", "Hardware set definitions"] == (6, "D02, D05, D08, D11, D14, D17") and openings["q", "Hardware set definitions"][0] == 7
    assert openings["p", "Access control / electrified"] == (1, "D07") and ("q", "Access control / electrified") not in openings
    assert openings["q", "Stair enclosures"] == (2, "D01, D03") and openings["q", "Voided hardware set"][0] == 1 and openings["p", "Schedule completeness"] == (1, "D05")
