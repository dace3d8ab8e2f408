"""Outputs: named datasets, per-project replacement, delimited schedules, append-only logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.normalise import from_to
from lintel.plans.storage import settled

#: Columns of the flat schedule, in order.
SCHEDULE = [
    "Section", "Opening Number", "Floor", "From", "To", "Quantity", "Hand", "Door Width", "Door Height", "Door Thickness", "Door Material", "Door Type", "Door Series", "Door Core",
    "Door Finish", "Door Glass", "Door Label", "Door Notes", "Frame Material", "Frame Type", "Frame Profile", "Frame Throat", "Frame Finish", "Frame Label", "Frame Notes", "Hardware Set", "Remarks", "Source Page",
]


def schedule_rows(doors: DataFrame) -> DataFrame:
    """The flat schedule of doors; columns that they lack are blank."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in doors.columns else F.lit("")
    sides = from_to(has("room_or_location"))
    given = {
        "Opening Number": has("door_number"), "From": sides["from"], "To": sides["to"], "Quantity": F.lit("1"), "Door Width": has("door_width"), "Door Height": has("door_height"), "Door Thickness": has("door_thickness"),
        "Door Material": has("door_material"), "Door Type": has("door_type"), "Door Finish": has("door_finish"), "Door Glass": has("glazing"), "Door Label": has("fire_rating"), "Frame Material": has("frame_material"),
        "Frame Type": has("frame_type"), "Frame Finish": has("frame_finish"), "Frame Label": has("fire_rating"), "Hardware Set": has("hardware_set"), "Remarks": has("remarks"), "Source Page": has("page"),
    }
    return doors.select(*(given.get(c, F.lit("")).alias(c) for c in SCHEDULE))


def csv_field(c: Column, delimiter: str = ",") -> Column:
    """A field on one line, in quotes where it holds a separator, tab or quote."""
    s = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "))
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.contains(delimiter) | s.rlike('[",\r\t]'), quoted).otherwise(s)


def schedule_lines(doors: DataFrame, delimiter: str = ",") -> DataFrame:
    """The flat schedule as lines of text, without the header."""
    rows = schedule_rows(doors)
    return rows.select(F.concat_ws(delimiter, *(csv_field(F.col(f"`{c}`"), delimiter) for c in SCHEDULE)).alias("line"))


def write_schedule(doors: DataFrame, path: str, delimiter: str = ",") -> None:
    """The schedule with CRLF line ends, a header in each part file."""
    rows = schedule_rows(doors)
    rows.write.mode("overwrite").option("header", True).option("sep", delimiter).option("lineSep", "\r\n").option("encoding", "UTF-8").csv(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """K1, K9: one Parquet dataset for each named sheet; empty ones keep their columns."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv_sets(sheets: dict[str, DataFrame], folder: str) -> None:
    """K2: one CSV dataset for each sheet that has rows."""
    for name, rows in sheets.items():
        if not rows.isEmpty():
            rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


#: Folders of an estimations table, fixed for its life: a project has one, many projects share it.
PARTS = 64


def replace_projects(estimations: DataFrame, path: str) -> None:
    """K3: the rows of the projects that these rows hold, replaced; other projects stay.

    Projects lie in a fixed number of folders (project_part), so that files and folders do not grow with projects; the folders that
    these rows touch are written anew with what their other projects had.
    """
    spark = estimations.sparkSession
    rows = estimations.withColumn("project_part", F.pmod(F.xxhash64("project_id"), F.lit(PARTS)).cast("int"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched = [r.project_part for r in rows.select("project_part").distinct().collect()]
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("project_part").isin(touched))
        new = rows.select(F.col("project_id").alias("_new")).distinct()
        rows = rows.unionByName(settled(old.join(new, F.col("project_id").eqNullSafe(F.col("_new")), "left_anti")))
    rows.repartition(PARTS, "project_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_part").parquet(path)


def append_log(events: DataFrame, path: str) -> None:
    """Events added as JSON lines."""
    events.write.mode("append").json(path)


def write_witness(rows: DataFrame, path: str) -> None:
    """K8: rows as one JSON object a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


#: Levels of a run's log; others are info.
LEVELS = ("info", "ok", "warn", "error")


def run_children(runs: DataFrame, most: int = 1000) -> dict[str, DataFrame]:
    """K5: the six child tables of nested runs: logs, doors, sets, items, rfis and audit; each row with its run and its place there.

    runs: run_id, source_filename, logs (kind, level, stage, text, message), doors (mark, hardware_set, risk_level, confidence), sets
    (hardware_set, status, items), rfis (priority, severity, category, question, issue, source, where). A run keeps its first log rows; of two
    names for one thing the first that is given counts.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    either = lambda *c: F.coalesce(*map(given, c))
    each = lambda rows, c, no, *keys: rows.select("run_id", *keys, F.posexplode(c).alias(no, "x")).where("x is not null")
    logs = each(runs.withColumn("logs", F.slice("logs", 1, most)), "logs", "log_no")
    level = either("x.kind", "x.level")
    sets = each(runs, "sets", "set_no")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {
        "logs": logs.select("run_id", "log_no", F.when(level.isin(*LEVELS), level).otherwise("info").alias("level"), "x.stage", F.coalesce(either("x.text", "x.message"), F.lit("")).alias("message")),
        "doors": each(runs, "doors", "door_no").select("run_id", "door_no", F.col("x.mark").alias("door_mark"), "x.hardware_set", "x.risk_level", F.col("x.confidence").cast("string").alias("confidence")),
        "sets": sets.select("run_id", "set_no", "x.hardware_set", "x.status"),
        "items": sets.select("run_id", "set_no", F.posexplode("x.items").alias("at", "i")).where("i is not null").select(
            "run_id", "set_no", "at", text("i.item_no").alias("item_no"), text("i.qty").alias("qty"), either("i.desc", "i.description").alias("description"), either("i.part", "i.catalog_number").alias("catalog_number"), either("i.mfr", "i.manufacturer").alias("manufacturer"), "i.finish",
        ),
        "rfis": each(runs, "rfis", "rfi_no").select("run_id", "rfi_no", either("x.priority", "x.severity").alias("priority"), "x.category", either("x.question", "x.issue").alias("question"), either("x.source", "x.where").alias("source")),
        "audit": runs.select("run_id", F.lit("runs.create").alias("action"), F.lit("pdf_run").alias("entity"), F.to_json(F.struct("source_filename")).alias("payload")),
    }
