"""Door rows from words that OCR found on crops: tables that run across, and tables turned on their side."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import ocr_dimension, ocr_door_mark, size_pair, squeeze, strip
from lintel.functions.predicates import any_of
from lintel.operators.layout import repaired_sequence
from lintel.operators.merge import distinct_near_rows

LEAST_ROWS = 4
#: Height of the bins on which rows and words of a page meet.
BIN = 40
_LABELS = ("number", "room", "size", "type", "hardware", "rating", "remarks")


def looks_like_mark(c: Column) -> Column:
    """A word that reads like a door mark once OCR's slips are mended, and like no type label."""
    mark = ocr_door_mark(c)
    return (mark != "") & ~mark.rlike(V.TYPE_LABEL) & mark.rlike(r"^(?:R\d{2,4}[A-Z]?|[A-Z]?\d{1,4}[A-Z]?)$")


def header_label(c: Column) -> Column:
    """What a header's word names, else null."""
    plain = strip(F.regexp_replace(F.upper(c), "[^A-Z0-9# ]", ""))
    out = F.lit(None).cast("string")
    for label, words in V.HEADER_WORDS.items():
        out = F.when(plain.isin(words), label).otherwise(out)
    return out


def best_header(items: DataFrame) -> DataFrame:
    """(page_id, header_y and the left edge of each label) of the header line with most different labels within 14 of its height, the
    topmost of equals; it names number and size, and room, type or hardware."""
    words = items.withColumn("label", header_label(F.col("text"))).where("label is not null").select("page_id", "y", "x", "label")
    around = words.select("page_id", F.col("y").alias("near_y"), F.col("label").alias("near"))
    # Header words are few: one row for each label that a page shows.
    lines = words.select("page_id", "y").distinct().join(around, "page_id").where(F.abs(F.col("near_y") - F.col("y")) <= 14).groupBy("page_id", "y").agg(F.collect_set("near").alias("labels"))
    has = lambda x: F.array_contains("labels", x)
    good = lines.where(has("number") & has("size") & (has("room") | has("type") | has("hardware")))
    header = good.groupBy("page_id").agg(F.min(F.struct((-F.size("labels")).alias("k"), "y")).alias("h")).select("page_id", F.col("h.y").alias("header_y"))
    met = header.join(words, "page_id").where(F.abs(F.col("y") - F.col("header_y")) <= 18)
    return met.groupBy("page_id", "header_y").agg(*(F.min(F.when(F.col("label") == k, F.col("x"))).alias(f"{k}_x") for k in _LABELS)).where("size_x is not null")


def _edges(header: DataFrame) -> DataFrame:
    """Left and right edges of the columns under a header; those without a label lie at usual distances from their neighbours."""
    steps = [
        ("number_x", F.coalesce("number_x", F.lit(80))), ("type_x", F.coalesce("type_x", F.col("size_x") + 260)), ("hardware_x", F.coalesce("hardware_x", F.col("type_x") + 180)), ("rating_x", F.coalesce("rating_x", F.col("hardware_x") + 200)),
        ("remarks_x", F.coalesce("remarks_x", F.col("rating_x") + 220)), ("number_right", F.least(F.coalesce(F.col("room_x") - 20, F.col("number_x") + 150), F.col("number_x") + 180)), ("room_left", F.greatest(F.lit(0), F.col("number_right"))),
        ("size_left", F.greatest(F.col("number_right") + 50, F.col("size_x") - 100)), ("size_right", F.greatest(F.col("size_left") + 120, F.col("type_x") - 25)), ("type_left", F.greatest("size_right", F.col("type_x") - 40)),
        ("type_right", F.greatest(F.col("type_left") + 60, F.col("hardware_x") - 35)), ("hardware_left", F.greatest("type_right", F.col("hardware_x") - 60)), ("hardware_right", F.greatest(F.col("hardware_left") + 70, F.col("rating_x") - 35)),
        ("rating_left", F.greatest("hardware_right", F.col("rating_x") - 55)), ("rating_right", F.greatest(F.col("rating_left") + 70, F.col("remarks_x") - 30)),
    ]
    for name, value in steps:
        header = header.withColumn(name, value)
    return header


def horizontal_rows(items: DataFrame) -> DataFrame:
    """Doors of pages of OCR words (page_id, y, x, text) under one header line, each mark a row; pages with fewer than LEAST_ROWS rows give none.

    Marks that stand at about one height are one; a number between two that leave one out is mended. A row needs a room and a readable size.
    """
    edges = _edges(best_header(items))
    words = items.join(edges, "page_id")
    marks = words.where((F.col("y") > F.col("header_y") + 12) & (F.col("x") <= F.col("number_right")) & (F.col("x") >= F.greatest(F.lit(0), F.col("number_x") - 90)) & looks_like_mark(F.col("text")))
    marks = distinct_near_rows(marks.select("page_id", "y", "x", ocr_door_mark(F.col("text")).alias("mark")))
    marks = marks.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).where(F.col("n") >= LEAST_ROWS).drop("n")
    order = Window.partitionBy("page_id").orderBy("y", "x", "mark")
    marks = marks.withColumn("pos", F.row_number().over(order))
    # Only numbers between two others are mended: runs of them are sequences of their own.
    run = F.sum((~F.col("mark").rlike(r"^\d+$")).cast("int")).over(order)
    numbered = marks.withColumn("run", F.concat_ws("/", "page_id", run)).where(F.col("mark").rlike(r"^\d+$"))
    mended = repaired_sequence(numbered.select(F.col("run").alias("page_id"), "pos", F.col("mark").cast("long").alias("number")))
    mended = numbered.join(mended.select(F.col("page_id").alias("run"), "pos", "number"), ["run", "pos"])
    width = F.greatest(F.lit(2), F.length("mark"))
    fixed = mended.select("page_id", "pos", F.when(F.col("number") != F.col("mark").cast("long"), F.lpad(F.col("number").cast("string"), width, "0")).alias("fixed"))
    marks = marks.join(fixed, ["page_id", "pos"], "left").withColumn("mark", F.coalesce("fixed", "mark")).drop("fixed")
    near = marks.select("page_id", F.col("pos"), F.col("mark").alias("door_number"), F.col("y").alias("row_y"), F.explode(F.array(*(F.floor(F.col("y") / BIN) + k for k in (-1, 0, 1)))).alias("bin"))
    met = near.join(words.withColumn("bin", F.floor(F.col("y") / BIN)), ["page_id", "bin"]).where(F.abs(F.col("y") - F.col("row_y")) <= 10)
    upper = strip(F.upper("text"))
    in_room = (F.col("x") >= F.col("room_left")) & (F.col("x") < F.col("size_left")) & ~upper.isin([*V.OCR_HEADER, "X", "EXT", "INT"]) & ~upper.rlike(r"\d+\s*['.-]\s*\d+")
    between = lambda lo, hi: (F.col("x") >= F.col(lo)) & (F.col("x") < F.col(hi))
    bands = {"room": in_room, "size": between("size_left", "size_right"), "type": between("type_left", "type_right"), "hardware": between("hardware_left", "hardware_right"), "rating": between("rating_left", "rating_right"), "remarks": F.col("x") >= F.col("rating_right")}
    said = lambda k: strip(squeeze(F.array_join(F.col(f"{k}.text"), " ")), " .:-")
    rows = met.groupBy("page_id", "pos", "door_number").agg(*(F.array_sort(F.collect_list(F.when(test, F.struct("x", "text")))).alias(k) for k, test in bands.items()))
    rows = rows.select("page_id", "pos", "door_number", *(said(k).alias(k) for k in bands)).withColumn("pair", size_pair(F.col("size")))
    kept = lambda c: F.when((F.col(c) != "") & ~F.upper(c).isin(V.OCR_HEADER), F.col(c))
    set_ = F.regexp_replace(F.upper("hardware"), "[^A-Z0-9.-]", "")
    good = rows.where((F.col("room") != "") & F.col("pair.width").isNotNull()).select(
        "page_id", "door_number", F.col("room").alias("room_name"), F.col("pair.width").alias("door_width"), F.col("pair.height").alias("door_height"), F.upper(kept("type")).alias("door_type"),
        F.when(set_.rlike(r"^(?:[A-Z]?\d+[A-Z]?|[A-Z])$"), set_).alias("hardware_set"), kept("rating").alias("fire_rating"), kept("remarks").alias("remarks"),
    )
    return good.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).where(F.col("n") >= LEAST_ROWS).drop("n")


def vertical_rows(items: DataFrame) -> DataFrame:
    """Doors of pages of OCR words whose marks stand in one line left of 'NO.', each door a column; a page needs two marks.

    A door's field is the word nearest to its mark in x within the field's band of heights, the topmost and leftmost of equals.
    """
    upper = F.upper("text")
    heights = [F.min(F.when(upper.contains(k), F.col("y"))).alias(f"{k.lower()}_y") for k in ("TYPE", "WIDTH", "HEIGHT", "THICKNESS", "HARDWARE")]
    page = items.groupBy("page_id").agg(F.min(F.when(upper.isin(V.NUMBER_WORDS), F.struct("y", "x"))).alias("no"), *heights).where("no is not null")
    words = items.join(page, "page_id")
    marks = words.where((F.abs(F.col("y") - F.col("no.y")) <= 8) & (F.col("x") < F.col("no.x")) & strip(F.col("text")).rlike(r"(?i)^\d{2,4}[A-Z]?$"))
    marks = marks.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).where("n >= 2").select("page_id", F.col("x").alias("mark_x"), F.upper(strip(F.col("text"))).alias("door_number"), "no", *(f"{k}_y" for k in ("type", "width", "height", "thickness", "hardware")))
    bands = {"room_name": (F.col("no.y") + 18, F.col("no.y") + 85), "door_type": (F.col("type_y") - 8, F.col("type_y") + 25), "door_width": (F.col("width_y") - 4, F.col("width_y") + 25), "door_height": (F.col("height_y") - 4, F.col("height_y") + 25),
             "door_thickness": (F.col("thickness_y") - 4, F.col("thickness_y") + 25), "hardware_set": (F.col("hardware_y") - 4, F.col("hardware_y") + 35)}
    fields = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), lo.alias("low"), hi.alias("high")) for k, (lo, hi) in bands.items()))).alias("b")
    wanted = marks.select("page_id", "mark_x", "door_number", fields).select("page_id", "mark_x", "door_number", "b.*").where("low is not null")
    wanted = wanted.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor(F.col("high") / BIN))))
    excluded = F.lit(False)
    for field, words_ in V.OCR_EXCLUDED.items():
        excluded = excluded | ((F.col("field") == field) & F.upper("text").rlike(r"\b(?:" + "|".join(words_) + r")\b"))
    met = wanted.join(items.withColumn("bin", F.floor(F.col("y") / BIN)), ["page_id", "bin"]).where((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high")) & ~excluded & ~any_of(F.upper("text"), V.OCR_NOISE))
    best = met.groupBy("page_id", "mark_x", "door_number", "field").agg(F.min(F.struct(F.abs(F.col("x") - F.col("mark_x")).alias("d"), "y", "x", "text")).alias("v"))
    values = best.groupBy("page_id", "mark_x", "door_number").agg(*(F.max(F.when(F.col("field") == k, F.col("v.text"))).alias(k) for k in bands))
    rows = marks.select("page_id", "mark_x", "door_number").distinct().join(values, ["page_id", "mark_x", "door_number"], "left")
    set_ = F.upper(strip(F.col("hardware_set")))
    return rows.select("page_id", "door_number", "room_name", "door_type", ocr_dimension(F.col("door_width")).alias("door_width"), ocr_dimension(F.col("door_height")).alias("door_height"), "door_thickness", F.when(set_.rlike(r"^\d+[A-Z]?$"), set_).alias("hardware_set"))
