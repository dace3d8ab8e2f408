"""Texts of documents from the texts of their pages: best of several readings, joined in order, cut at a budget."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import strip
from lintel.functions.pages import squeezed_tables, unreversed
from lintel.operators.distinct import held
from lintel.operators.gates import cell_counts, is_quality_table


def _within(pages: DataFrame, limit: int, marker: int = 0) -> DataFrame:
    """pages (doc_id, page, text) with chunk: what of each page's text the budget of its document leaves, null where nothing; a
    marker of so many characters before each page but the first counts.

    What stands before a page is a prefix sum of sizes, so a text is cut before any document is put together.
    """
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("left", limit - F.coalesce(F.sum(F.length("text") + marker).over(before), F.lit(0)))
    return rows.withColumn("chunk", F.when(F.col("left") + marker > 0, F.substring("text", F.lit(1), F.greatest(F.col("left"), F.lit(0)).cast("int"))))


def _joined(rows: DataFrame, marker: str) -> DataFrame:
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("page", "chunk")))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.col("parts.chunk"), marker).alias("text"))


def document_text(pages: DataFrame, limit: int = 45_000) -> DataFrame:
    """Each document's pages (doc_id, page, text) in order, a line break between them, as many characters of them as the limit; empty pages are left out."""
    rows = _within(pages.withColumn("text", F.coalesce("text", F.lit(""))), limit)
    rows = rows.withColumn("chunk", F.when(F.col("chunk") != "", F.col("chunk")))
    return _joined(rows, "\n").select("doc_id", F.substring(unreversed(strip(F.col("text"))), 1, limit).alias("text"))


def page_text(plain: Column, layout: Column, markdown: Column) -> Column:
    """The layout reading of a page, unless it is blank or loses a door or hardware signal that the plain one has; else the markdown
    reading, unless it is blank; else the plain one. Table spaces are squeezed in the first two."""
    loses = lambda pattern: plain.rlike(pattern) & ~layout.rlike(pattern)
    fits = (strip(layout) != "") & ~loses(V.DOOR_SIGNAL) & ~loses(V.HARDWARE_SIGNAL)
    return F.when(F.coalesce(fits, F.lit(False)), squeezed_tables(strip(layout))).when(strip(markdown) != "", squeezed_tables(markdown)).otherwise(plain)


def document_markdown(pages: DataFrame, limit: int = 120_000) -> DataFrame:
    """Each document's pages (doc_id, page, text) in order with a page-break marker between them, backward words turned round, cut at the limit."""
    fixed = pages.withColumn("text", unreversed(F.coalesce("text", F.lit(""))))
    rows = _within(fixed, limit, len(V.PAGE_BREAK))
    return _joined(rows, V.PAGE_BREAK).select("doc_id", F.substring("text", 1, limit).alias("text"))


def best_tables(rows: DataFrame, strategies: list[str]) -> DataFrame:
    """Of several extractions of each page's tables, rows (page_id, strategy, table_no, row_no, cells), the one with most filled cells in
    good tables of two rows or more; the earlier strategy wins ties. Empty rows and columns go first. (page_id, strategy, score, text)

    A page's text is one value, so its rows come together; rows that are dealt by page_id already are not shuffled again.
    """
    table = ["page_id", "strategy", "table_no"]
    read = rows.select(*table, "row_no", F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))).alias("cells"))
    parts = read.groupBy(*table, "row_no").agg(F.collect_list("cells").alias("parts")).where(F.exists(F.flatten("parts"), lambda c: c != ""))
    grids = parts.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("row_no", "parts"))).alias("lines"))
    # Columns with a filled cell: the grid has these in every row, blanks where a row is shorter or empty there.
    places = lambda p: F.filter(F.transform(p, lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull())
    used = F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten("lines.parts"), places))))
    grids = held(grids, "used", used)
    there = lambda parts, i: F.filter(F.transform(parts, lambda p: F.get(p, i)), lambda c: c.isNotNull())
    several = lambda parts, i: F.when(F.size(there(parts, i)) > 0, F.array_sort(there(parts, i))).otherwise(F.array(F.lit("")))
    cells = lambda parts, i: F.when(F.size(parts) == 1, F.array(F.coalesce(F.get(F.get(parts, F.lit(0)), i), F.lit("")))).otherwise(several(parts, i))
    grids = held(grids, "grid", F.transform("lines", lambda x: F.flatten(F.transform("used", lambda i: cells(x["parts"], i))))).drop("lines", "used")
    counted = {"n": F.size("grid"), "columns": F.array_max(F.transform("grid", F.size)), "total": F.size("flat"), **cell_counts(F.col("flat"))}
    counted = held(held(grids, "flat", F.flatten("grid")), "counts", F.struct(*(c.alias(k) for k, c in counted.items()))).select(*table, "grid", "counts.*")
    shown = lambda line: F.concat(F.lit("| "), F.array_join(F.transform(line, lambda c: F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, V.CELL_LENGTH)), " | "), F.lit(" |"))
    text = F.concat(F.format_string("=== TABLE (%d×%d) ===\n", "n", "columns"), F.array_join(F.transform("grid", shown), "\n"))
    good = counted.where(is_quality_table()).select(*table, F.col("filled").cast("long").alias("filled"), text.alias("text"))
    read = good.groupBy("page_id", "strategy").agg(F.sum("filled").alias("score"), F.array_sort(F.collect_list(F.struct("table_no", "text"))).alias("tables"))
    rank = F.array_position(F.array(*(F.lit(s) for s in strategies)), F.col("strategy"))
    best = read.groupBy("page_id").agg(F.max_by(F.struct("strategy", "score", "tables"), F.struct("score", -rank)).alias("best"))
    return best.select("page_id", "best.strategy", "best.score", F.array_join(F.col("best.tables.text"), "\n\n").alias("text"))


def optical_lines(boxes: DataFrame) -> DataFrame:
    """The lines of each page from read boxes (page_id, x0, y0, x1, y1, confidence, text): sure ones by rows of 15 of their middle's height,
    halves to even, and from left to right; four spaces between them."""
    rows = boxes.where(F.col("confidence") >= V.LEAST_CONFIDENCE).withColumn("row", F.bround((F.col("y0") + F.col("y1")) / 2 / V.ROW_HEIGHT, 0).cast("long"))
    lines = rows.groupBy("page_id", "row").agg(F.array_sort(F.collect_list(F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), "text"))).alias("parts"))
    lines = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row", F.array_join(F.col("parts.text"), "    ").alias("line")))).alias("lines"))
    return lines.select("page_id", F.concat(F.lit("=== PURE OPTICAL TEXT SEQUENCE ===\n"), F.array_join(F.col("lines.line"), "\n")).alias("text"))


def _by_model(model: Column, rules: list[tuple[str, int]], usual: int) -> Column:
    name, found = F.lower(F.coalesce(model, F.lit(""))), F.lit(usual)
    for pattern, n in reversed(rules):
        found = F.when(name.rlike(pattern), n).otherwise(found)
    return found


def output_budget(model: Column, system: Column, user: Column, has_image: Column) -> Column:
    """Tokens that an answer may have: what the model's context leaves after the prompt (four characters a token) and a reserve,
    within the model's own cap, 512 at least."""
    chars = F.length(F.coalesce(system, F.lit(""))) + F.length(F.coalesce(user, F.lit("")))
    prompt = F.greatest(F.lit(1), F.floor(chars / 4)) + F.when(has_image, V.IMAGE_TOKENS).otherwise(0)
    left = _by_model(model, V.CONTEXT_TOKENS, V.USUAL_CONTEXT) - prompt - V.RESERVED_TOKENS
    return F.greatest(F.lit(V.LEAST_TOKENS), F.least(_by_model(model, V.OUTPUT_TOKENS, V.USUAL_OUTPUT), left)).cast("int")
