"""Project and run reports: counters, fill rates, triage, rollups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.normalise import qa_join_id, status_join_id, text
from lintel.functions.predicates import any_of, is_quote_file


def per_project_files(doors: DataFrame) -> DataFrame:
    """A3: files and doors of each project."""
    return doors.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("source_file")), ";").alias("files"), F.count("*").alias("doors"))


def large_sets(components: DataFrame, least: int = 15) -> DataFrame:
    """A4: sets with many items; rows without a set are no group."""
    return components.where("hardware_set_id is not null").groupBy("project_id", "hardware_set_id").agg(F.count("*").alias("items")).where(F.col("items") >= least)


def join_evidence(doors: DataFrame, components: DataFrame) -> DataFrame:
    """A5: for each project, how many of its doors' references its own components can answer."""
    ids = components.select("project_id", qa_join_id(F.col("hardware_set_id")).alias("id"))
    sets = ids.where("id <> ''").distinct().withColumn("known", F.lit(True))
    refs = doors.select("project_id", qa_join_id(F.col("hardware_set")).alias("id")).join(sets, ["project_id", "id"], "left")
    counted = refs.groupBy("project_id").agg(
        F.count("*").alias("doors"), F.count_if(F.col("id") != "").alias("door_refs"), F.count_if(F.col("id") == "").alias("missing_refs"),
        F.count_if(F.col("known").isNotNull()).alias("joinable_refs"), F.count_if((F.col("id") != "") & F.col("known").isNull()).alias("unmatched_refs"),
    )
    hardware = ids.groupBy("project_id").agg(F.count("*").alias("hardware"), F.count_distinct(F.when(F.col("id") != "", F.col("id"))).alias("set_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counted.join(hardware, "project_id", "full_outer").select("project_id", *(zero(c) for c in ("doors", "hardware", "set_count", "door_refs", "missing_refs", "joinable_refs", "unmatched_refs")))


def null_counters(doors: DataFrame) -> DataFrame:
    """Missing values and repeated doors of each file."""
    return doors.groupBy("source_file").agg(
        F.count("*").alias("doors"), (F.count("*") - F.count_distinct("project_id", F.coalesce("door_number", F.lit("")))).alias("duplicate_doors"), F.count_if(F.col("door_number").isNull()).alias("missing_door_number"),
        F.count_if(F.col("door_width").isNull()).alias("missing_width"), F.count_if(F.col("door_height").isNull()).alias("missing_height"), F.count_if(text(F.col("hardware_set")) == "").alias("missing_hw_set"),
    )


def fill_rates(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Per cent of rows that have each column, and their mean, by group; rounded to one place."""
    rate = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 1)
    filled = rows.groupBy(by).agg(*(rate(c).alias(f"fill_{c}") for c in columns))
    return filled.withColumn("schema_score", F.round(sum((F.col(f"fill_{c}") for c in columns), F.lit(0.0)) / len(columns), 1))


def core_completeness(doors: DataFrame) -> DataFrame:
    """Share of doors with all four core fields, and projects that have no set at all."""
    full = F.col("door_number").isNotNull() & F.col("door_width").isNotNull() & F.col("door_height").isNotNull() & F.col("hardware_set").isNotNull()
    return doors.groupBy("project_id").agg(F.count("*").alias("doors"), F.count_if(full).alias("complete"), F.round(F.avg(full.cast("int")) * 100, 1).alias("complete_pct"), F.bool_and(F.col("hardware_set").isNull()).alias("all_missing"))


def repeated_doors(doors: DataFrame) -> DataFrame:
    """Doors of a project that stand more than once."""
    return doors.groupBy("project_id", "door_number").agg(F.count("*").alias("n")).where("n > 1")


def issues(project_hardware: Column | None = None) -> Column:
    """What is wrong with a run, in order; columns of a run report."""
    name, doors, hardware = F.lower("pdf_name"), F.col("doors"), F.col("hardware")
    related = F.lit(0) if project_hardware is None else project_hardware
    schedule = ~is_quote_file(F.col("pdf_name")) & any_of(name, ["door", "opening"])
    only_hardware = any_of(name, ["hardware", "division 08", "division_08"]) & ~any_of(name, ["door schedule", "door & hardware", "door_hardware"])
    share = lambda c: F.col(c) / F.greatest(doors, F.lit(1))
    has, bare = doors > 0, hardware == 0
    without = F.when((doors == 0) & bare, "zero_extract").when((doors == 0) & ~only_hardware, "no_doors").when(bare & name.contains("hardware"), F.when(related > 0, "hardware_in_related_pdf").otherwise("no_hardware"))
    marks = [
        F.when(F.col("status") != "ok", "pipeline_error"), without, F.when(F.col("duplicate_doors") > 0, "duplicate_doors"),
        F.when(has & (share("missing_width") > 0.5), "missing_width_gt_50pct"), F.when(has & (share("missing_height") > 0.5), "missing_height_gt_50pct"),
        F.when(has & (share("missing_hw_set") > 0.8), F.when(schedule, "missing_hw_set_gt_80pct").when(is_quote_file(F.col("pdf_name")), "door_rows_on_non_schedule_pdf")),
    ]
    return F.array_compact(F.array(*marks))


def severity(found: Column) -> Column:
    """High, medium or ok."""
    high = F.arrays_overlap(found, F.array(*(F.lit(x) for x in ("pipeline_error", "zero_extract", "no_doors"))))
    return F.when(high, "high").when(F.exists(found, lambda x: x != "hardware_in_related_pdf"), "medium").otherwise("ok")


def taxonomy(found: Column) -> Column:
    """Kinds of failure behind the issues, in order, each once."""
    has = lambda *names: F.arrays_overlap(found, F.array(*(F.lit(n) for n in names)))
    name, crops, doors, hardware = F.lower("pdf_name"), F.col("crop_count"), F.col("doors"), F.col("hardware")
    sized = has("missing_width_gt_50pct", "missing_height_gt_50pct")
    rules = [
        (has("pipeline_error"), ["table detection failure"]),
        (has("zero_extract", "no_doors"), ["table detection failure"]),
        (has("zero_extract", "no_doors") & (crops > 0), ["wrong page classification"]),
        (has("zero_extract", "no_doors") & (crops <= 0), ["OCR failure"]),
        (has("no_hardware") & name.contains("hardware"), ["bad hardware-set join", "bad schema mapping"]),
        (has("duplicate_doors"), ["duplicate record"]),
        (sized, ["unit / dimension normalization issue", "bad schema mapping"]),
        (has("missing_hw_set_gt_80pct"), ["bad hardware-set join"]),
        (has("hardware_in_related_pdf"), ["cross-PDF join required"]),
        (has("door_rows_on_non_schedule_pdf"), ["wrong page classification"]),
        ((F.col("crop_rescue_attempt_pages") > 0) & (F.col("crop_door_added") + F.col("crop_hw_added") == 0), ["low-confidence skip"]),
        ((crops > 0) & (doors == 0) & (hardware == 0), ["OCR failure", "rotated text failure"]),
        ((F.col("duplicate_doors") == 0) & (doors > 0) & sized, ["merged-cell failure", "row segmentation failure"]),
        ((hardware > 0) & (doors == 0) & ~name.contains("hardware"), ["wrong page classification"]),
    ]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.array(*(F.lit(n) for n in names))).otherwise(none) for test, names in rules))))


def triaged(runs: DataFrame) -> DataFrame:
    """Runs with issues, severity and failure_taxonomy."""
    rows = runs.withColumn("found", issues())
    return rows.withColumn("severity", severity(F.col("found"))).withColumn("failure_taxonomy", F.array_join(taxonomy(F.col("found")), ";")).withColumn("issues", F.array_join("found", ";")).drop("found")


def triage_summary(runs: DataFrame) -> DataFrame:
    """Runs by status, severity and kind of failure."""
    rows = triaged(runs)
    kinds = rows.select(F.explode(F.filter(F.split("failure_taxonomy", ";"), lambda x: x != "")).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit("taxonomy").alias("kind"), "value", "n")
    own = rows.groupingSets([[F.col("status")], [F.col("severity")]], F.col("status"), F.col("severity"))
    counts = own.agg(F.count("*").alias("n"), F.grouping("status").alias("by_severity"))
    counts = counts.select(F.when(F.col("by_severity") == 1, "severity").otherwise("status").alias("kind"), F.coalesce("status", "severity").alias("value"), "n")
    return counts.unionByName(kinds)


def rollup(doors: DataFrame) -> DataFrame:
    """A project's conditional counts in one pass; doors with set_label and risk_level."""
    says = lambda c, pattern: (text(F.col(c)) != "") & ~text(F.col(c)).rlike(pattern)
    return doors.groupBy("project_id").agg(
        F.count("*").alias("total_openings"), F.count_distinct("set_label").alias("sets_referenced"),
        *(F.count_if(F.col("risk_level") == r).alias(f"{r}_risk") for r in ("high", "medium", "low")),
        F.count_if(says("access", r"(?i)^(no|none|n/a|null|-)$")).alias("access_control"), F.count_if(says("fire_rating", r"(?i)^(none|non|n/a|null|-)$")).alias("fire_rated"),
    )


def one_way_counts(doors: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Counts by each of these columns alone, in one pass; columns: name and the bucket of a blank value."""
    named = doors.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(bucket)).alias(c) for c, bucket in columns.items()))
    names = list(columns)
    counts = named.groupingSets([[F.col(c)] for c in names], *(F.col(c) for c in names)).agg(F.count("*").alias("n"))
    dimension = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in names))
    return counts.select(dimension.alias("dimension"), F.coalesce(*names).alias("value"), "n")


def item_takeoff(mapping: DataFrame) -> DataFrame:
    """Quantity of each item over all openings (n in a row), by description, part and finish whatever their case; no quantity counts 1."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    number = F.col("qty").try_cast("double")
    amount = F.when(F.coalesce(number, F.lit(0.0)) == 0, 1.0).otherwise(number)
    return (
        mapping.where("status = 'OK'").groupBy(low("description").alias("item"), low("catalog_number").alias("part"), low("finish").alias("finish"))
        .agg(F.sum(amount * F.col("n")).alias("qty"), F.count_distinct("hardware_set").alias("sets"), F.array_join(F.array_sort(F.collect_set("hardware_set")), ";").alias("set_ids"))
    )


def validation(doors: DataFrame, sets: DataFrame) -> DataFrame:
    """A project's failed mappings, doors with missing fields, and its status."""
    content = sets.select("project_id", F.col("hardware_set").alias("set_label"), F.lit(True).alias("there"), (F.col("n_items") > 0).alias("full"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = F.col("set_label").isNull() | blank("door_width") | blank("door_height") | blank("door_material")
    # Doors of a label are counted before they meet the sets.
    rows = doors.groupBy("project_id", "set_label").agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing")).join(content, ["project_id", "set_label"], "left")
    code = F.when(F.col("set_label").isNull(), None).when(F.col("there").isNull(), "HW_SET_MISSING_FROM_SPEC").when(~F.col("full"), "HW_SET_NO_ITEMS")
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counts = rows.groupBy("project_id").agg(F.sum("n").alias("doors"), of(code.isNotNull()).alias("failed_mappings"), F.sum("n_missing").alias("doors_with_missing_fields"), of(F.col("set_label").isNotNull()).alias("with_set"))
    status = F.when((F.col("with_set") == 0) | (F.col("failed_mappings") > F.col("doors") * 0.3), "REVIEW_REQUIRED").otherwise("OK")
    return counts.withColumn("status", status).drop("with_set")


def set_state(components: DataFrame, doors: DataFrame) -> DataFrame:
    """Every set that doors or components name, how often, and whether it is missing or an orphan."""
    used = doors.select(status_join_id(F.col("hardware_set")).alias("set_id")).where("set_id <> ''").groupBy("set_id").agg(F.count("*").alias("doors"))
    have = components.select(status_join_id(F.col("hardware_set_id")).alias("set_id")).where("set_id <> ''").groupBy("set_id").agg(F.count("*").alias("items"))
    state = F.when(F.col("items").isNull(), "missing").when(F.col("doors").isNull(), "orphan").otherwise("used")
    return used.join(have, "set_id", "full_outer").select("set_id", F.coalesce("doors", F.lit(0)).alias("doors"), F.coalesce("items", F.lit(0)).alias("items"), state.alias("state"))


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of rows in this order, with the total and the number of pages; size is held between 1 and 100."""
    size, total = max(1, min(100, size)), rows.count()
    shown = rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
    return shown.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(-(-total // size)).cast("long")})
