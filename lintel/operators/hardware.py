"""Hardware components of page texts in three layouts, and the choice among them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import bound, squeeze, strip
from lintel.functions.pages import split_row
from lintel.functions.predicates import any_of, is_finish_code
from lintel.operators.validate import validated_components

FIELDS = ["hardware_set_id", "hardware_set_name", "qty_raw", "unit", "description", "catalog_number", "finish_code", "manufacturer_code"]
LEAST_ROWS = 3
EXTRAS = 4


def _amount(c: Column, form: str) -> Column:
    """(qty_raw, unit, description) of a cell of this form: quantity, unit if given, description."""
    unit = F.upper(F.coalesce(F.nullif(F.regexp_extract(c, form, 2), F.lit("")), F.lit("EA")))
    return F.when(c.rlike(form), F.struct(F.regexp_extract(c, form, 1).alias("qty_raw"), F.when(unit == "PR", "PAIR").otherwise(unit).alias("unit"), strip(F.regexp_extract(c, form, 3), " .").alias("description")))


def cell_component(c: Column) -> Column:
    """(qty_raw, unit, description) of a grid's cell that counts a component, else null; sizes alone are none."""
    sized = lambda d: d.rlike("\\d+\\s*['’]\\s*-\\s*\\d+|\\d+/\\d+\"") & ~any_of(F.upper(d), V.STRONG_COMPONENTS)
    read = _amount(strip(squeeze(F.coalesce(c, F.lit(""))), " ."), V.GRID_COMPONENT)
    return bound(read, lambda x: F.when(any_of(F.upper(x["description"]), V.CELL_COMPONENTS) & ~sized(x["description"]), x))


def finish_and_maker(c: Column, any_maker: bool = False) -> Column:
    """(finish, maker) of a cell that ends in a known maker (or any of three capitals) behind a finish code, else nulls."""
    words = F.split(F.upper(squeeze(c)), " ")  # no pattern over all words: its groups would nest as deep as a text is long
    both = bound(words, lambda w: F.struct(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ").alias("finish"), F.element_at(w, -1).alias("maker")))
    none = F.struct(F.lit(None).cast("string").alias("finish"), F.lit(None).cast("string").alias("maker"))
    known = lambda m: m.isin(V.VENDOR_MAKERS) | (m.rlike("^[A-Z]{3}$") if any_maker else F.lit(False))
    return bound(both, lambda x: F.when((x["finish"] != "") & known(x["maker"]) & is_finish_code(x["finish"]), x).otherwise(none))


def _lines(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "body", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "line"))


def group_rows(pages: DataFrame) -> DataFrame:
    """Side-by-side 'Hardware Group No.' columns of three cells: component, catalog number, finish and maker."""
    rows = _lines(pages.where(F.col("body").rlike(V.GROUP_HEADER))).select("page_id", "line_no", split_row(F.col("line")).alias("cells")).where(F.size("cells") > 0)
    headers = F.filter(F.transform("cells", lambda c: F.rtrim(F.regexp_extract(F.coalesce(c, F.lit("")), V.GROUP_HEADER, 1), F.lit("."))), lambda h: h != "")
    above = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("headers", F.when(F.size(headers) > 0, headers)).withColumn("groups", F.last("headers", ignorenulls=True).over(above))
    rows = rows.where(F.col("headers").isNull() & F.col("groups").isNotNull() & (F.size("cells") >= 3 * F.size("groups")))
    rows = rows.select("page_id", "line_no", "cells", F.posexplode("groups").alias("k", "hardware_set_id"))
    cell = lambda i: F.get("cells", F.col("k") * 3 + i)
    rows = rows.withColumn("c", cell_component(cell(0))).where("c is not null").withColumn("f", finish_and_maker(F.coalesce(cell(2), F.lit("")), True))
    finish = F.when(F.col("f.maker").isNotNull(), F.col("f.finish")).otherwise(cell(2))
    return rows.select("page_id", (F.col("line_no") * 1000 + F.col("k")).alias("at"), "hardware_set_id", F.lit(None).cast("string").alias("hardware_set_name"), "c.*", cell(1).alias("catalog_number"), finish.alias("finish_code"), F.col("f.maker").alias("manufacturer_code"))


def grid_rows(pages: DataFrame) -> DataFrame:
    """Sets in columns: a component belongs to the last set header above it in its column, or else to the last one read."""
    rows = _lines(pages.where(F.col("body").rlike(V.GRID_PAGE)))
    cells = F.when(F.col("line").contains("|"), split_row(F.col("line"))).otherwise(F.array(strip(F.col("line"))))
    rows = rows.select("page_id", "line_no", F.upper("line").alias("said"), F.posexplode(cells).alias("column", "cell"))
    rows = rows.withColumn("header", F.nullif(F.rtrim(F.regexp_extract(F.coalesce("cell", F.lit("")), V.GRID_HEADER, 1), F.lit(".")), F.lit("")))
    begins = F.col("said").contains("HARDWARE SCHEDULE") | F.col("said").contains("HARDWARE SET") | F.col("header").isNotNull()
    page = Window.partitionBy("page_id")
    up_to = lambda *by: Window.partitionBy("page_id", *by).orderBy("line_no", "column").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first_line", F.min(F.when(begins, F.col("line_no"))).over(page)).where("line_no >= first_line")
    rows = rows.withColumn("any_set", F.last("header", ignorenulls=True).over(up_to())).withColumn("own_set", F.last("header", ignorenulls=True).over(up_to("column")))
    rows = rows.withColumn("hardware_set_id", F.coalesce("own_set", "any_set")).where("header is null and hardware_set_id is not null")
    rows = rows.withColumn("c", cell_component(F.col("cell"))).where("c is not null")
    none = F.lit(None).cast("string")
    rows = rows.select("page_id", (F.col("line_no") * 1000 + F.col("column")).alias("at"), "hardware_set_id", none.alias("hardware_set_name"), "c.*", none.alias("catalog_number"), none.alias("finish_code"), none.alias("manufacturer_code"))
    return rows.withColumn("n", F.count("*").over(page)).where(F.col("n") >= LEAST_ROWS).drop("n")


def _placed(extras: Column) -> Column:
    """(catalog, finish, maker) of the tokens behind a component, each taken for the first thing that it can be."""
    text = lambda c: c.cast("string")
    start = F.struct(text(F.lit(None)).alias("catalog"), text(F.lit(None)).alias("finish"), text(F.lit(None)).alias("maker"))

    def step(a: Column, x: Column) -> Column:
        upper = F.upper(x)

        def placed(both: Column) -> Column:
            joined = both["maker"].isNotNull() & a["catalog"].isNotNull()
            maker = ~joined & upper.isin(V.VENDOR_MAKERS) & a["maker"].isNull()
            catalog = ~joined & ~maker & a["catalog"].isNull()
            finish = ~joined & ~maker & ~catalog & is_finish_code(upper) & a["finish"].isNull()
            return F.struct(
                F.when(catalog, x).otherwise(a["catalog"]).alias("catalog"), F.when(joined, F.coalesce(a["finish"], both["finish"])).when(finish, upper).otherwise(a["finish"]).alias("finish"),
                F.when(joined, F.coalesce(a["maker"], both["maker"])).when(maker, upper).otherwise(a["maker"]).alias("maker"),
            )

        return bound(finish_and_maker(x), placed)

    return F.aggregate(extras, start, step)


def vendor_rows(pages: DataFrame) -> DataFrame:
    """A stream of cells: set headers, counted components, and up to EXTRAS cells behind each that say what it is."""
    tokens = F.filter(F.transform(F.split("body", r"\s*\|\s*|\r?\n+"), squeeze), lambda t: t != "")
    rows = pages.where(F.col("body").rlike(V.VENDOR_PAGE)).select("page_id", F.col("body").rlike(V.HARDWARE_TITLE).alias("titled"), F.posexplode(tokens).alias("at", "token"))
    header = F.when(F.col("token").rlike(V.VENDOR_HEADER), F.struct(F.regexp_extract("token", V.VENDOR_HEADER, 1).alias("id"), F.nullif(strip(F.regexp_extract("token", V.VENDOR_HEADER, 2)), F.lit("")).alias("name")))
    counted = bound(_amount(F.col("token"), V.VENDOR_COMPONENT), lambda x: F.when(any_of(F.upper(x["description"]), V.VENDOR_COMPONENTS), x))
    rows = rows.withColumn("header", header).withColumn("c", F.when(F.col("header").isNull(), counted))
    rows = rows.withColumn("stop", F.col("header").isNotNull() | F.col("c").isNotNull() | F.upper("token").startswith("NOTE"))
    order = Window.partitionBy("page_id").orderBy("at")
    ahead = F.array(*(F.struct(F.lead("token", k).over(order).alias("token"), F.coalesce(F.lead("stop", k).over(order), F.lit(True)).alias("stop")) for k in range(1, EXTRAS + 1)))
    rows = rows.withColumn("ahead", ahead).withColumn("set", F.last("header", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("c is not null and set is not null")
    stop = F.array_position(F.col("ahead.stop"), True)
    extras = F.when(stop == 0, F.col("ahead.token")).otherwise(F.slice("ahead.token", F.lit(1), F.greatest(F.lit(0), stop - 1).cast("int")))
    rows = rows.withColumn("x", _placed(extras)).withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).where((F.col("n") >= LEAST_ROWS) | F.col("titled"))
    return rows.select("page_id", F.col("at").cast("long").alias("at"), F.col("set.id").alias("hardware_set_id"), F.col("set.name").alias("hardware_set_name"), "c.*", F.col("x.catalog").alias("catalog_number"), F.col("x.finish").alias("finish_code"), F.col("x.maker").alias("manufacturer_code"))


def page_components(pages: DataFrame) -> DataFrame:
    """Validated components of pages (page_id, body), of the layout that gives most of them.

    Group columns win ties; a page that writes 'SET: n' is a grid if that gives any; else a grid must give more than a vendor's list.
    """
    page = Window.partitionBy("page_id")
    groups = group_rows(pages).withColumn("n", F.count("*").over(page)).where(F.col("n") >= LEAST_ROWS).drop("n")
    found = [x.withColumn("layout", F.lit(name)) for name, x in (("group", groups), ("grid", grid_rows(pages)), ("vendor", vendor_rows(pages)))]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).withColumn("qty", F.when(F.col("qty_raw").rlike(r"^\d+$"), F.col("qty_raw")))
    good = validated_components(rows, "page_id", "layout", "at")
    n = lambda name: F.count_if(F.col("layout") == name).over(page)
    said = pages.select("page_id", F.col("body").rlike(V.GRID_SET).alias("says_set"))
    good = good.withColumns({f"n_{x}": n(x) for x in ("group", "grid", "vendor")}).join(said, "page_id")
    best = (
        F.when((F.col("n_group") > 0) & (F.col("n_group") >= F.greatest("n_grid", "n_vendor")), "group")
        .when(F.col("says_set") & (F.col("n_grid") > 0), "grid")
        .when(F.col("n_grid") > F.col("n_vendor"), "grid")
        .otherwise("vendor")
    )
    return good.where(F.col("layout") == best).select("page_id", "layout", "at", *FIELDS, "qty")
