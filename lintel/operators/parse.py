"""Page texts to rows: pipe tables, carried headers, component tokens, chunks, sections, JSON answers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import squeeze, strip
from lintel.functions.pages import salvaged_json, split_row


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line) of pages (page_id, body)."""
    return pages.select("page_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))


def table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, cell_no, cell) of all pipe rows."""
    lines = page_lines(pages).where(F.col("line").contains("|"))
    return lines.select("page_id", "line_no", F.posexplode(split_row(F.col("line"))).alias("cell_no", "cell"))


def carried_sets(pages: DataFrame) -> DataFrame:
    """Component lines with the set header that they stand under, the last one above them on the page."""
    header = F.when(F.col("line").rlike(r"(?i)^\s*(?:HARDWARE\s+)?(?:SET|GROUP)\b\s*(?:NO\.?|#)?\s*\S+"), F.regexp_extract("line", r"(?i)(?:SET|GROUP)\b\s*(?:NO\.?|#)?\s*([A-Za-z0-9.-]+)", 1))
    above = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = page_lines(pages).withColumn("header", header).withColumn("hardware_set_id", F.last("header", ignorenulls=True).over(above))
    return rows.where(F.col("header").isNull() & F.col("line").rlike("(?i)" + V.COMPONENT_WORDS)).select("page_id", "line_no", "hardware_set_id", "line")


def component_fields(c: Column) -> Column:
    """Quantity, unit, description and finish of a component line."""
    form = r"(?i)^\s*(\d+)\s+(?:(EA|EACH|PR|PAIR|SET)\b\.?\s+)?(.+?)(?:\s+((?:US)?\d{2,3}[A-Z]{0,2}))?(?:\s+([A-Z]{3}))?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, form, k), F.lit(""))
    return F.struct(part(1).try_cast("int").alias("qty"), F.upper(part(2)).alias("unit"), squeeze(F.upper(part(3))).alias("description"), part(4).alias("finish_code"), part(5).alias("manufacturer_code"))


def page_context(rows: DataFrame, file: str, order: str, columns: list[str]) -> DataFrame:
    """Each row with the last value of these columns on this or an earlier page of its file, as last_<column>."""
    so_far = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(so_far) for c in columns})


def merged_split_rows(rows: DataFrame) -> DataFrame:
    """Table rows (table_id, row_no, first, rest); a row without a first cell goes on from the row above."""
    up_to = Window.partitionBy("table_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("group", F.count_if(F.coalesce(F.btrim("first"), F.lit("")) != "").over(up_to))
    parts = grouped.groupBy("table_id", "group").agg(F.min("row_no").alias("row_no"), F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("row_no", "rest"))).alias("parts"))
    return parts.select("table_id", "row_no", "first", F.array_join(F.col("parts.rest"), " ").alias("rest"))


def sections(docs: DataFrame, mark: str = "## ") -> DataFrame:
    """(doc_id, section_no, section) of texts cut at a mark, blank ones left out."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", mark)).alias("section_no", "section"))
    return cut.where(F.btrim("section") != "").select("doc_id", "section_no", F.btrim("section").alias("section"))


def json_rows(answers: DataFrame, fields: str) -> DataFrame:
    """Rows of a JSON array in each answer (answer_id, answer), without thinking and code fences; a broken one is mended, a truncated one cut back to its last whole row."""
    bare = F.regexp_replace("answer", r"(?s)<think>.*?</think>|```(?:json)?", "")
    whole = F.regexp_extract(bare, r"(?s)(\[.*)", 1)
    read = lambda text: F.from_json(text, f"array<struct<{fields}>>")
    parsed = F.coalesce(read(whole), *map(read, salvaged_json(whole)))
    return answers.select("answer_id", F.posexplode(parsed).alias("row_no", "row")).select("answer_id", "row_no", "row.*")


def continuation(pages: DataFrame) -> DataFrame:
    """Pages (file, page, page_type, body) that go on from the page before: a schedule before, no header in the first line."""
    before = F.lag("page_type").over(Window.partitionBy("file").orderBy("page"))
    first = strip(F.element_at(F.split("body", "\n"), 1))
    return pages.withColumn("is_continuation", F.coalesce(before.isin("door_schedule", "hardware_set", "mixed") & ~first.rlike(V.PAGE_HEADER), F.lit(False)))
