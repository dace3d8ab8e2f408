"""Page types, gates and merges on small cases."""

import pytest
from pyspark.sql import functions as F

from lintel.functions import classify, pages
from lintel.functions import vocabulary as V
from lintel.operators import gates, merge, rescue, summaries
from lintel.plans import page_queries, report_queries

OPENINGS = "\nSection 08711 | DOOR HARDWARE SCHEDULE\nOpening List\nOpening\nHdw Set\nOpening Label\nDoor Type\nFrame Type\nD101A\n109\nH\nH\nD101B\n103\nI\nI\nD102A\n101\nA\nA\nD102B\n101\nA\nA\n"
CODES = "\nSection 08711 | DOOR HARDWARE SCHEDULE\nManufacturer List\nCode\nName\nHA\nHager\n"


def test_page_types(spark):
    texts = [(OPENINGS, "HARDWARE"), (CODES, "HARDWARE"), ("plumbing only", "DOOR"), ("door 101", "door"), ("door 101", None), ("SET 1 door\n3 HINGE\n1 CLOSER", "x"), ("HW 4 door\nWALL STOP, FLOOR STOP", "DOOR SCHEDULE")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "page_id int, body string, answer string")
    kinds = [r.kind for r in rows.select("page_id", classify.page_type(F.col("body"), F.col("answer")).alias("kind")).orderBy("page_id").collect()]
    assert kinds == ["door_schedule", "other", "other", "door_schedule", "other", "hardware_set", "mixed"]
    back = rows.select("page_id", classify.backstopped(F.lit("other"), F.col("body")).alias("kind"), classify.signals(F.col("body"))["real_doors"].alias("n")).orderBy("page_id").collect()
    assert back[0].kind == "mixed" and back[0].n >= 4 and back[2].kind == "other"
    assert [r[0] for r in spark.createDataFrame([("HARDWARE SET DESCRIPTIONS 3 HINGE",)], "b string").select(classify.backstopped(F.lit("other"), F.col("b"))).collect()] == ["hardware_set"]


def _gate(spark, kind, doors=0, unique=0, physical=0, parts=0, sets=0, crops=2, door_crops=2, **evidence):
    fields = ("real_door_numbers", "row_lines", "dimensions", "cad_shorthand", "schedule_headers", "hw_set_headers", "hw_components", "title_block_markers", "cid_garbage", "broken_columns", "text_length")
    one = spark.range(1).select(F.struct(*(F.lit(evidence.get(f, 0)).alias(f) for f in fields)).alias("e"), F.lit(kind).alias("kind"))
    e, n = F.col("e"), lambda x: F.lit(x)
    j = pages.judged(e)
    row = one.select(
        gates.needs_crop_door_rescue(F.col("kind"), e, j, n(doors), n(unique), n(physical), n(parts), n(crops), n(door_crops)).alias("door"),
        gates.needs_crop_hardware_rescue(F.col("kind"), e, j, n(parts), n(sets), n(crops), n(door_crops)).alias("hardware"),
    ).first()
    return row.door, row.hardware


def test_crop_gates(spark):
    assert _gate(spark, "mixed", doors=1, unique=1, physical=1, real_door_numbers=8, hw_components=6, text_length=1000) == (True, True)
    assert not _gate(spark, "hardware_set", real_door_numbers=8, dimensions=8, hw_components=6, text_length=1000)[0]
    assert not _gate(spark, "mixed", doors=12, unique=12, physical=12, parts=60, sets=1, real_door_numbers=80, dimensions=80, row_lines=80, hw_components=100, text_length=30000)[0]
    assert _gate(spark, "mixed", crops=0, door_crops=0) == (False, False)


def test_visible_rows(spark):
    rows = [("101A", "4", "x", "MARK 101A HALL"), ("1O1", "HM", "x", "see 101 here"), ("205", "4", "x", "nothing"), ("205", "4", "tile_rotated_door_schedule_cw", "DOOR SCHEDULE MARK WIDTH"), ("HM", "4", "x", "HM"), ("A1.5", "4", "x", "A1x5"), ("7", "A1", "x", None)]
    found = gates.visible_rows(spark.createDataFrame(rows, "door_number string, hardware_set string, source string, search string")).collect()
    assert [(r.door_number, r.hardware_set) for r in found] == [("101A", "4"), ("1O1", None), ("205", "4"), ("7", "A1")]


def test_merged_backends(spark):
    table = "| 101 | 3'-0\" | HM |\n" * 4
    plain = "plain words and more of them, " * 100
    merge_ = lambda *c, limit=14000: spark.range(1).select(classify.merged_backends(*(F.lit(x) for x in c), limit).alias("b")).first().b
    text = merge_(None, table, plain, "short", "image " * 20)
    assert text.startswith("[Source: pdfplumber_tables]\n| 101") and text.endswith("[Source: plain_text]\n" + plain.strip())
    assert "img2table" in text and text.index("pdfplumber_tables") < text.index("img2table")
    cut = merge_(None, table, plain, None, None, limit=6000)
    assert len(cut) <= 6000 and "[...text trimmed...]" in cut
    assert merge_(None, None, None, None, None) == ""


def test_references_and_sets(spark):
    doors = spark.createDataFrame([("p", "5"), ("p", "HW-10.0"), ("p", "A"), ("p", "2"), ("p", None)], "project_id string, hardware_set string")
    parts = spark.createDataFrame([("p", "SET 5.0"), ("q", "2")], "project_id string, hardware_set_id string")
    assert [tuple(r) for r in merge.missing_references(doors, parts, "project_id").collect()] == [("p", "2, 10, A")]
    item = "hardware_set string, row_key int, qty string, unit string, desc string, part string, mfr string, finish string"
    ours = spark.createDataFrame([("Set 1", 1, "1", "EA", "HINGE", None, None, None), ("OFFICE | LOBBY", 2, "1", "EA", "LOCK", None, None, None)], item)
    theirs = spark.createDataFrame([("1.0", 3, "1", "ea", "hinge", None, None, None), ("HW-1", 4, "2", "EA", "STOP", None, None, None), ("office", 5, "1", "EA", "SEAL", None, None, None), ("7", 6, "1", "EA", "BOLT", None, None, None), ("8", 7, "1", "EA", "PULL", None, None, None)], item)
    merged = lambda allowed: sorted((r.set_key, r.desc, r.origin) for r in merge.merged_sets(ours, theirs, spark.createDataFrame(allowed, "hardware_set string")).collect())
    assert merged([("7",)]) == sorted([("1", "HINGE", "ours"), ("1", "STOP", "rescued"), ("7", "BOLT", "rescued"), ("LOBBY | OFFICE", "LOCK", "ours"), ("LOBBY | OFFICE", "SEAL", "rescued")])
    assert ("8", "PULL", "rescued") in merged([])


def test_short_reports(spark):
    empty = spark.createDataFrame([], "description string, install_time_mins int, unit_price double")
    assert [r.description for r in summaries.proposal_sheets(empty)["labour"].collect()] == ["No items"]
    assert summaries.next_number(spark.createDataFrame([], "id string"), 2024).first().next_id == "P-2024-001"
    assert summaries.proposal_totals(spark.createDataFrame([], "status string, total double")).first().win_rate == 0


@pytest.mark.parametrize("name", ["f15_rescue_gates", "r21_rescued_rows"])
def test_pages_are_read_once(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(page_queries, "settled", lambda df: seen.append(df) or df)
    monkeypatch.setattr(rescue, "rescued", lambda pages, doors, parts, *_: (doors.withColumn("origin", F.lit("")), parts.withColumn("origin", F.lit(""))))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    df = page_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = (seen or [df])[0]._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [plan.count(p) for p in (V.PAGE_COMPONENT, V.PAGE_TITLE, V.PAGE_HEADER, V.SET_HEADER, V.CAD_SIZE)] == [1] * 5
    assert plan.count(V.DOOR_NUMBER) == 2  # the page's marks, and its lines with one


def test_canonical_doors_work_out_a_mark_once(spark):
    columns = ["mark", "room_or_location", "width", "height", "door_type", "door_material", "frame_type", "frame_material", "hardware_set", "fire_rating", "remarks", "confidence"]
    rows = [(" 101a ", None, "3'-0\"", None), ("A", "hall", None, None), ("A", None, None, None), ("B2", None, None, None), ("hinge 4", "hall", "3", "7"), ("102", "hall", '4 1/2"', "7'"), ("103", "x", "36", "12 1/2"), ("mark", "x", "3'", None)]
    frame = spark.createDataFrame([r + (None,) * 8 for r in rows], ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in columns))
    found = gates.canonical_doors(frame)
    assert [(r.mark, r.size.width, r.confidence) for r in found.collect()] == [("101a", "3'-0\"", 0.7), ("A", None, 0.7), ("103", "36", 0.7)]
    plan = report_queries.p26_canonical_doors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and plan.count("HINGE 4") == 1
