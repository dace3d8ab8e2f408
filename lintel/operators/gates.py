"""Gates: whether rows, pages, tables or files need another look. Columns where one row decides, aggregates where many do."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.classify import DOOR, HARDWARE, MIXED
from lintel.functions.normalise import is_blank, join_id, ocr_door_mark, set_key, text
from lintel.functions.predicates import any_of, is_hardware_dimension, is_quote_file, remains
from lintel.operators.distinct import held


def schedule_doors(doors: DataFrame) -> DataFrame:
    """doors of files that are no quotes or proposals; their hardware is kept by leaving it alone."""
    return doors.where(~F.coalesce(is_quote_file(F.col("source_file")), F.lit(False)))


def cell_counts(cells: Column) -> dict[str, Column]:
    """What F14 counts in an array of cells: filled ones, their characters and their glyph codes."""
    full = F.filter(F.transform(cells, lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))), lambda c: c != "")
    chars = F.aggregate(full, F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    codes = F.aggregate(full, F.lit(0).cast("long"), lambda a, c: a + F.regexp_count(c, F.lit(V.CID)))
    return {"filled": F.size(full), "chars": chars, "codes": codes}


def is_quality_table() -> Column:
    """F14 on a table's counts: n rows, most columns, total cells, filled, chars, codes."""
    sparse = (F.col("total") > 0) & (F.col("filled") / F.col("total") < 0.15)
    short = (F.col("filled") > 0) & (F.col("chars") / F.col("filled") < 1.5)
    garbled = (F.col("chars") > 0) & (F.col("codes") * 5 / F.col("chars") > 0.3)
    return (F.col("n") >= 2) & (F.col("columns") <= 40) & ~F.coalesce(sparse, F.lit(False)) & ~F.coalesce(short, F.lit(False)) & ~F.coalesce(garbled, F.lit(False))


def quality_tables(tables: DataFrame) -> DataFrame:
    """(table_id, is_good) of table rows (table_id, cells): two rows or more, up to 40 columns, filled, with words and without glyph codes."""
    counted = (F.sum(c).alias(k) for k, c in cell_counts(F.col("cells")).items())
    sums = tables.groupBy("table_id").agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("columns"), F.sum(F.size("cells")).alias("total"), *counted)
    return sums.select("table_id", is_quality_table().alias("is_good"))


def needs_door_rescue(kind: Column, e: Column, judged: dict[str, Column], doors: Column, unique: Column) -> Column:
    """doors: rows found on the page, unique: different marks among them; e, judged: the page's evidence and what it says."""
    expected = judged["expected_door_rows"]
    empty = (unique == 0) & ((expected >= 5) | ((expected >= 3) & (e["dimensions"] >= 3)))
    severe = (expected >= 20) & (unique < expected * 0.3) & (expected - unique >= 10)
    small = expected.between(3, 14) & (unique > 0) & (unique < expected)
    gap = (expected >= 15) & (unique > 0) & (unique < expected * 0.8) & (expected - unique >= 2)
    open_ = (kind != HARDWARE) & (kind.isin(DOOR, MIXED) | judged["is_door_schedule"]) & (judged["is_door_schedule"] | (doors > 0))
    return open_ & (empty | severe | small | gap)


def needs_hardware_rescue(kind: Column, e: Column, judged: dict[str, Column], rows: Column, sets: Column) -> Column:
    """F16: rows: components found on the page, sets: different named sets among them."""
    open_ = (kind.isin(HARDWARE, MIXED) | judged["is_hardware_schedule"]) & (judged["is_hardware_schedule"] | (rows > 0))
    return open_ & (((judged["expected_hw_sets"] >= 2) & (sets == 0)) | ((e["hw_components"] >= 8) & (rows < 3)))


def needs_crop_door_rescue(kind: Column, e: Column, judged: dict[str, Column], doors: Column, unique: Column, physical: Column, hardware: Column, crops: Column, door_crops: Column) -> Column:
    """physical: doors with a size or material; crops: all crops of the page, door_crops: those of doors or mixed."""
    schedule = kind.isin(DOOR, MIXED)
    whole = ((unique >= 20) & (physical >= F.greatest(F.lit(20), F.floor(unique * 0.8)))) | ((kind == MIXED) & (hardware >= 50) & (unique >= 10) & (physical >= 10))
    few = schedule & (door_crops >= 2) & (unique < 3) & ((e["real_door_numbers"] >= 5) | (e["schedule_headers"] >= 2))
    bare = (doors > 0) & (physical == 0) & (door_crops > 0)
    return (kind != HARDWARE) & (crops > 0) & ~whole & (needs_door_rescue(kind, e, judged, doors, unique) | (schedule & (doors == 0) & (door_crops > 0)) | few | bare)


def needs_crop_hardware_rescue(kind: Column, e: Column, judged: dict[str, Column], rows: Column, sets: Column, crops: Column, hardware_crops: Column) -> Column:
    """F18."""
    schedule = kind.isin(HARDWARE, MIXED)
    none = (rows == 0) & (schedule | (e["hw_components"] >= 2) | (e["hw_set_headers"] >= 1))
    few = schedule & (hardware_crops >= 2) & (rows < 2) & (e["hw_components"] >= 4)
    return (crops > 0) & (needs_hardware_rescue(kind, e, judged, rows, sets) | ((hardware_crops > 0) & (schedule | judged["is_hardware_schedule"]) & (none | few)))


def incomplete_sets(doors: DataFrame, sets: DataFrame, group: str, truncated: Column | None = None) -> DataFrame:
    """(group, needs_rescue) from the sets that doors (group, hardware_set) name and sets (group, hardware_set, n_items, status) hold."""
    named = doors.select(group, set_key(F.col("hardware_set")).alias("key")).where("key <> ''").distinct()
    held = sets.select(group, set_key(F.col("hardware_set")).alias("key"), F.coalesce("n_items", F.lit(0)).alias("n_items"), (~F.lower(F.coalesce("status", F.lit(""))).isin(V.CLOSED_SET)).alias("active"))
    by_key = held.groupBy(group, "key").agg(F.max("n_items").alias("most"))
    open_ = named.join(by_key, [group, "key"], "left").groupBy(group).agg(F.count("*").alias("named"), F.count_if(F.coalesce("most", F.lit(0)) == 0).alias("empty"))
    total = held.groupBy(group).agg(F.sum("n_items").alias("items"), F.count_if("active").alias("active"), F.count_if(F.col("active") & (F.col("n_items") <= 1)).alias("single"))
    rows = open_.join(total, group, "left").fillna(0, ["items", "active", "single"])
    n, items, empty = F.col("named"), F.col("items"), F.col("empty")
    few = (n >= 3) & (items < F.greatest(F.lit(4), F.floor(n / 2)))
    thin = (n >= 5) & (F.col("active") > 0) & (items <= F.col("active") * 2) & (F.col("single") >= F.greatest(F.lit(3), F.floor(F.col("active") / 2)))
    cut = (truncated if truncated is not None else F.lit(False)) & (empty > 0)
    return rows.select(group, (cut | ((empty > 0) & (items == 0)) | few | thin | ((empty > 0) & (n >= 3))).alias("needs_rescue"))


def missing_fields(files: DataFrame, doors: DataFrame, group: str) -> DataFrame:
    """(group, needs_rescue) of files (group, text) with their doors (group, hardware_set)."""
    counts = doors.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.coalesce("hardware_set", F.lit("")) == "").alias("missing"))
    rows = files.join(counts, group, "left").fillna(0, ["n", "missing"])
    upper = F.upper(F.coalesce("text", F.lit("")))
    short = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r\x0b\x0c"))) < 200
    none = (F.col("n") == 0) & (short | any_of(upper, ["DOOR SCHEDULE", "DOOR SCHED", "OPENING LIST"]))
    many = (F.col("n") >= 3) & (F.col("missing") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2)))
    return rows.select(group, (none | (many & (short | any_of(upper, ["HARDWARE SET", "HW SET", "HARDWARE GROUP", "HDWR SET"])))).alias("needs_rescue"))


def wants_witness(files: DataFrame, doors: DataFrame, parts: DataFrame, group: str, mode: str) -> DataFrame:
    """(group, wants_witness): whether files need a second reading; doors (door_width, door_height, table_shape), parts (hardware_set_id)."""
    if mode != "rescue":
        return files.select(group, F.lit(mode == "always").alias("wants_witness"))
    d = doors.groupBy(group).agg(F.count("*").alias("doors"), F.count_if(F.col("table_shape") == "opening_list").alias("listed"), F.count_if(is_blank(F.col("door_width")) | is_blank(F.col("door_height"))).alias("unsized"))
    h = parts.groupBy(group).agg(F.count("*").alias("parts"), F.count_distinct(F.nullif(join_id(F.col("hardware_set_id")), F.lit(""))).alias("sets"))
    rows = files.select(group).join(d, group, "left").join(h, group, "left").fillna(0)
    n, parts_ = F.col("doors"), F.col("parts")
    listed = (n > 0) & (parts_ >= 3) & (F.col("listed") >= F.greatest(F.lit(3), F.floor(n * 0.8)))
    unsized = (n > 0) & (F.col("unsized") / F.greatest(n, F.lit(1)) > 0.5)
    return rows.select(group, (((n == 0) & (parts_ == 0)) | (~listed & (unsized | ((parts_ > 0) & (parts_ < 3) & (F.col("sets") <= 1))))).alias("wants_witness"))


def gaps(e: Column, judged: dict[str, Column], unique: Column, rows: Column, sets: Column) -> Column:
    """(door_gap, hw_gap): what the evidence expects beyond the different marks, and beyond the components and sets (a set counts three)."""
    zero = F.lit(0)
    hardware = F.greatest(F.greatest(zero, judged["expected_hw_sets"] - sets) * 3, F.greatest(zero, e["hw_components"] - rows))
    return F.struct(F.greatest(zero, judged["expected_door_rows"] - unique).cast("long").alias("door_gap"), hardware.cast("long").alias("hw_gap"))


def is_trusted_crop(source: Column, search: Column) -> Column:
    """Crops turned upright whose text has a schedule's title and its columns."""
    return F.lower(source).contains("rotated_door_schedule") & search.contains("DOOR SCHEDULE") & search.rlike(r"\b(?:NO\.?|DOOR NO\.?|MARK)\b") & search.rlike(r"\b(?:WIDTH|HEIGHT|HARDWARE|SET)\b")


def visible_rows(rows: DataFrame) -> DataFrame:
    """crop door rows (door_number, hardware_set, source, search: the crop's text) whose mark stands in that text, as printed or as OCR reads it.

    Type and profile labels are no marks, and as a set are none. Rows of trusted crops, or of crops without text, need not be seen.
    """
    mark, said = F.upper(text(F.col("door_number"))), F.upper(F.coalesce("search", F.lit("")))
    printed = F.regexp_like(said, F.concat(F.lit(r"(?<![A-Z0-9])\Q"), mark, F.lit(r"\E(?![A-Z0-9])")))
    read = F.array_contains(F.transform(F.regexp_extract_all(said, F.lit("[A-Z0-9!|]+"), F.lit(0)), ocr_door_mark), ocr_door_mark(mark))
    kept = (mark != "") & ~mark.rlike(V.TYPE_LABEL) & (printed | read | F.coalesce(is_trusted_crop(F.col("source"), said), F.lit(False)))
    set_ = F.when(~F.upper(text(F.col("hardware_set"))).rlike(V.TYPE_LABEL), F.col("hardware_set"))
    return rows.where((said == "") | kept).withColumn("hardware_set", F.when(said == "", F.col("hardware_set")).otherwise(set_))


def canonical_doors(rows: DataFrame) -> DataFrame:
    """Door rows of a model that are doors, with size, stays-as-it-is and confidence (0.7 if not given).

    Dropped: placeholders and headings, component words, long marks, room names, hinge sizes, single letters without place or size,
    and rows with a mark alone.
    """
    meaning = ("door_material", "door_type", "frame_type", "hardware_set", "fire_rating", "remarks")
    given = {c: text(F.col(c)).alias(c) for c in ("mark", "room_or_location", "width", "height", *meaning)}
    t = lambda c: F.col(f"_t.{c}")
    # Each text is worked out once; the tests read it from there, those of few rows last.
    read = held(rows, "_t", F.struct(*given.values(), F.upper(given["mark"]).alias("upper")))
    upper = t("upper")
    bare = (t("room_or_location") == "") & (t("width") == "") & (t("height") == "")
    meaningful = F.lit(False)
    for c in meaning:
        meaningful = meaningful | (t(c) != "")
    size = lambda c: t(c).rlike(r"^\d") & is_hardware_dimension(t(c))
    noise = upper.isin(V.NO_MARK) | (F.length(t("mark")) > 15) | upper.isin(V.ROOM_MARKS) | any_of(upper, V.COMPONENT_ROWS)
    noise = noise | (bare & (upper.rlike("^[A-Z]$") | ~meaningful)) | size("width") | size("height")
    kept = held(read, "_noise", F.coalesce(noise, F.lit(False))).where("not _noise")
    stays = F.coalesce(remains("remarks", "door_material", "door_type", "frame_material", "room_or_location"), F.lit(False))
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    others = [c for c in rows.columns if c not in ("mark", "width", "height", "confidence")]
    return kept.select(
        t("mark").alias("mark"), *(blank(c) if rows.schema[c].dataType.simpleString() == "string" else F.col(c) for c in others),
        F.struct(blank("width"), blank("height")).alias("size"), stays.alias("existing_to_remain"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"),
    )


def crop_priority(source: Column, text_: Column) -> Column:
    """T4: 0 to 9, how likely a crop holds hardware sets."""
    source, said = F.upper(F.coalesce(source, F.lit(""))), F.upper(F.coalesce(text_, F.lit("")))
    header, parts = said.rlike(V.CROP_SET), said.rlike(V.CROP_PARTS)
    return (
        F.when(header & parts, 9).when(header, 8).when(parts & said.contains("HARDWARE"), 7).when(said.rlike(V.CROP_DOORS), 0).when(source.contains("DOOR HARDWARE"), 5)
        .when(any_of(source, ["HARDWARE SET", "HARDWARE SCHEDULE", "HDWR SET", "HW SET"]), 4).when(any_of(said, ["HARDWARE SET DESCRIPTIONS", "DOOR HARDWARE"]), 3)
        .when(any_of(said, ["HARDWARE SET", "HARDWARE SCHEDULE", "HW SET"]), 2).otherwise(1)
    )


def repair_rank(source: Column) -> Column:
    """Order of crops when a set is looked for: columns, then right corners, then the rest (by confidence within)."""
    lower = F.lower(F.coalesce(source, F.lit("")))
    return F.when(lower.contains("column"), 0).when(any_of(lower, ["upper-right", "lower-right"]), 1).otherwise(2)
