"""Inputs: file discovery, run logs, master lists, delimited chunks."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions.normalise import project_id
from lintel.sources.listing import Listing

#: Headers of a master list that mean each field, in order of preference.
MASTER_HEADERS = {"description": ("description", "component", "item"), "category": ("category", "type"), "install_time_mins": ("time", "mins", "install"), "default_unit_price": ("price", "cost", "rate")}


def listed(spark: SparkSession, folder: str, suffix: str = "", stream: bool = False) -> DataFrame:
    """The files below a folder by the listing data source, one task for each subfolder; as a stream, new files once."""
    spark.dataSource.register(Listing)
    reader = (spark.readStream if stream else spark.read).format("listing").option("suffix", suffix)
    return reader.load(folder)


def inventory(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files below a folder of any file system that Spark reads, with project and a stable id; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length", "modificationTime")
    return identified(files, folder)


def identified(files: DataFrame, folder: str) -> DataFrame:
    """Files (path) below a folder with their name, project and stable id."""
    relative = F.replace("path", F.lit(folder.rstrip("/") + "/"), F.lit(""))
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.element_at(F.split("path", "/"), -2)
    return files.withColumn("file_name", name).withColumn("project_id", F.when(relative.contains("/"), project_id(parent)).otherwise(project_id(name))).withColumn("file_id", F.sha1(F.lower(relative)))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of run logs, one JSON object a line, with the columns that all events share."""
    return spark.read.schema("event string, ts timestamp, elapsed_s double, pdf_name string, run_id string, page int, doors int, hardware int, status string, error string").json(path)


def run_summaries(events: DataFrame) -> DataFrame:
    """Each run's first and last event."""
    order = F.struct("ts", "event")
    return events.groupBy("run_id").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.min_by("event", order).alias("first_event"), F.max_by("event", order).alias("last_event"))


def chunks(spark: SparkSession, pattern: str) -> DataFrame:
    """Delimited chunk files as one table; all columns as text."""
    return spark.read.option("header", True).csv(pattern)


def master_list(spark: SparkSession, path: str) -> DataFrame:
    """A master list whose headers are matched by the words in them."""
    given = spark.read.option("header", True).csv(path)
    found = {}
    for field, words in MASTER_HEADERS.items():
        found[field] = next((c for w in words for c in given.columns if w in c.lower() and c not in found.values()), None)
    if found["description"] is None:
        raise ValueError(f"no description among {given.columns}")
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) if c else F.lit(0.0)
    words = lambda c: F.btrim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")
    rows = given.select(words(found["description"]).alias("description"), words(found["category"]).alias("category"), number(found["install_time_mins"]).alias("install_time_mins"), number(found["default_unit_price"]).alias("default_unit_price"))
    return rows.where("description <> ''")


def sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sheet's dataset in this schema; an empty one where there is none or it cannot be read as such."""
    try:
        found = spark.read.parquet(path)
        names = [c.split()[0] for c in schema.split(", ")]
        return found.select(names).to(spark.createDataFrame([], schema).schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)
