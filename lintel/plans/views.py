"""Domain relations built from the driver's tables by fixed expressions, so that SQL can build the same ones."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dirty values that normalisers meet; {n} is a number.
SAMPLES = [
    "HW-{n}", "Set {n}.0", "  hardware set {n} ", "HARDWARE SET {n}", "Group #{n}", "hdwr {n}A", "#{n}", "No. {n}", "SET NO. {n}", "FHW-{n}", "hw set #{n}", "Opening No. {n}",
    "{n}.0", "0{n}", ".{n}", "N/A", "not shown", "none", "NONE", "", " ", "--", "----", "?", "TBD", "LOT", "{n} EA", "EACH", "pr", "Sets", "AS REQ", "Varies", "existing", "NIC",
    "3'-0\"", "6' - 0\"", "3'-0\" x 3'-0\"", "{n}", "72\"", "30/30", "4 1/2\"", "1.75", "3'O\"", "3’-0\" X 7’-0\"", "(2) 3'-0\"x7'-0\"", "D{n}A", "101!", "|O1", "IO{n}", "RESTROOM",
    "PASASAGE w/ lever | {n}", "B / {n} / A", "office | storage", "CORRIDOR - ROOM {n}", "LOBBY to HALL", "Level {n}", "level none", "45 MIN", "Untitled project", "Project", "Tower {n}",
    "Project-{n} rev", "plain file", "p26_quote.pdf", "proposal {n}.pdf", "Door Schedule.pdf", "Division 8 Hardware.pdf", "/data/pdfs/a{n}.pdf", "/data/site {n}/b.pdf", "US26D, 630", "626", "BRASS",
    "[Source: native_text] x [Source: ocr] y [Source: ocr]", "VISION LLM EXTRACTION {n}", "a;b;a", "direct_pdf_confirmed", "OpenAI gpt-4o Call {n} (doors) sending PDF/data to model. done",
    "missing hardware set {n}", "card reader at opening", "panic device", "fire-rated door", "storefront threshold", "automatic operator", "lead time {n} weeks", "paint finish", "ETR {n}", "see note {n}",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, other): dirty texts, with null among them."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    samples = F.array(*(F.lit(s) for s in SAMPLES))
    pick = lambda k, n: F.replace(F.element_at(samples, (k % len(SAMPLES) + 1).cast("int")), F.lit("{n}"), n.cast("string"))
    value = pick(F.col("l_partkey") + F.col("l_suppkey"), F.col("l_suppkey") % 97)
    other = pick(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.col("l_suppkey") % 97)
    return rows.select(F.when(F.col("l_partkey") % 13 != 0, value).alias("value"), F.when(F.col("l_suppkey") % 11 != 0, other).alias("other")).distinct()


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door schedule rows from lineitem."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('project_', l_orderkey div 400) as project_id",
        "case l_linenumber % 5 when 0 then 'Division 8 HARDWARE.pdf' when 1 then 'Door and Hardware.pdf' else 'Door Schedule.pdf' end as source_file",
        "l_linenumber as page",
        "concat(l_orderkey, chr(64 + l_linenumber)) as door_number",
        "case l_suppkey % 6 when 0 then concat('HW-', l_partkey % 40) when 1 then concat('Set ', l_partkey % 40, '.0') when 2 then '' when 4 then 'N/A' when 5 then concat(' hardware set ', l_partkey % 40, ' ') end as hardware_set",
        "case floor(l_quantity) % 6 when 0 then '3''-0\"' when 1 then '6''-0\"' when 2 then concat(24 + cast(floor(l_quantity) as int), '') when 3 then '3''-0\" x 3''-0\"' when 4 then 'N/A' end as door_width",
        "case floor(l_quantity) % 4 when 0 then '7''-0\"' when 1 then '8''-0\"' when 2 then '' end as door_height",
        "case l_returnflag when 'A' then 'A5' when 'R' then 'PR-FLUSH' end as door_type",
        "case when l_partkey % 3 = 0 then 'HM' when l_partkey % 7 = 0 then 'WD by others' end as door_material",
        "case when l_partkey % 4 = 1 then 'HM' when l_partkey % 4 = 2 then 'ALUM' end as frame_type",
        "case l_suppkey % 5 when 0 then '45 MIN' when 1 then '----' when 2 then 'NONE' when 3 then 'none' end as fire_rating",
        "case when l_linenumber = 7 then null when l_linenumber = 6 then 'Level 12' else concat('Level ', l_linenumber) end as level_area",
        "case when l_partkey % 17 = 0 then 'existing to remain' when l_partkey % 19 = 0 then 'coiling shutter' when l_partkey % 23 = 0 then 'card reader' when l_partkey % 29 = 0 then concat('set ', l_partkey % 40) end as remarks",
        "l_partkey as row_key",
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardware component rows from part."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('project_', p_partkey div 50) as project_id",
        "case p_partkey % 4 when 0 then concat('SET ', p_partkey % 37) when 1 then concat('HW-', p_partkey % 37) when 2 then concat(p_partkey % 37, '.0') else concat('Group #', p_partkey % 37) end as hardware_set_id",
        "case p_size % 8 when 0 then 'HINGE' when 1 then 'surface closer' when 2 then 'Mortise lock' when 3 then 'HARDWARE SET' when 4 then 'SEE NOTE 4' when 5 then 'TRASH CAN' when 6 then 'kick plate' else p_name end as description",
        "case when p_partkey % 5 > 0 then p_brand end as catalog_number",
        "case p_partkey % 3 when 0 then '626' when 1 then 'US26D, 630' end as finish_code",
        "case when p_partkey % 6 = 0 then 'IVE' when p_partkey % 6 = 1 then 'ABC Corp' end as manufacturer_code",
        "case p_size % 5 when 0 then 'LOT' when 1 then '0' when 2 then '3 EA' when 3 then cast(p_size as string) end as qty_raw",
        "case p_size % 4 when 0 then 'each' when 1 then 'PRS' when 2 then '' end as unit",
        "cast(null as string) as notes",
        "p_retailprice as price",
        "p_partkey as row_key",
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost parameters of projects from customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('project_', c_custkey - 1) as project_id",
        "cast(c_custkey % 90 as double) as distance_miles",
        "case when c_custkey % 9 > 0 then 40.0D + c_custkey end as wage_scale_carpenter",
        "0.5D as gas_allowance_per_mile", "120.0D as hotel_allowance_per_day", "45.0D as meal_allowance_per_day", "18.0D as parking_allowance_per_day", "250.0D as tool_mobilization_allowance",
        "12.0D as labor_burden_pct", "32.0D as overhead_pct", "case when c_custkey % 7 > 0 then 25.0D end as profit_markup_pct", "8.25D as sales_tax_pct", "10.0D as material_markup_pct",
        "c_custkey % 2 = 0 as drug_testing", "c_custkey % 3 = 0 as parking_required", "c_custkey % 4 = 0 as outstation_stay", "c_custkey % 5 = 0 as apply_tax_to_equipment",
    )


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master components from part: price and time by description; a description may repeat."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id",
        "case p_partkey % 5 when 0 then 'Hinge ' when 1 then 'SURFACE CLOSER' when 2 then 'kick plate' else p_name end as description",
        "cast(5 + p_partkey % 40 as double) as install_time_mins",
        "p_retailprice as default_unit_price",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of extraction runs from orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('run_', o_orderkey % 5000) as run_id",
        "case o_orderstatus when 'F' then 'ok' when 'O' then 'ok' else 'error' end as status",
        "concat(case o_orderkey % 6 when 0 then 'Door Schedule ' when 1 then 'Division 08 hardware ' when 2 then 'proposal ' when 3 then 'p26_' when 4 then 'hardware sets ' else 'plan ' end, o_custkey, '.pdf') as pdf_name",
        "cast(o_custkey % 40 as int) as doors",
        "cast(o_orderkey % 7 * (o_custkey % 5) as int) as hardware",
        "cast(o_custkey % 3 as int) as duplicate_doors",
        "cast(o_orderkey % 30 as int) as missing_width",
        "cast(o_orderkey % 20 as int) as missing_height",
        "cast(o_custkey % 39 as int) as missing_hw_set",
        "cast(o_orderkey % 2 as int) as crop_count",
        "cast(o_orderkey % 3 as int) as crop_rescue_attempt_pages",
        "cast(o_orderkey % 11 % 3 as int) as crop_door_added",
        "cast(o_orderkey % 13 % 2 as int) as crop_hw_added",
        "o_orderdate as completed_at",
        "o_orderkey as row_key",
    )


#: Schedule lines planted into page texts, so that page signals have something to find; {n} is a number.
LINES = [
    "DOOR SCHEDULE | DOOR NO. | FIRE RATING", "| 1{n} | 3'-0\" | 7'-0\" | HM |", "| D1{n}A | 6'-0\" x 7'-0\" | ALUM | SET 4 |", "HARDWARE SET NO. {n}", "3 EA HINGE 5BB1 626 IVE", "1 CLOSER 4040XP", "LOCKSET and door stop",
    "DRAWN BY: x  CHECKED BY: y  SHEET NO 4", "(cid:12)(cid:7)", "DOO | R SCH | EDULE", "3070 x 7000", "built 1998 in 2004", "plain line {n}", "MMAARRKK", "TES ERAWDRAH", "",
]


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, body): ten schedule lines for each page, chosen by its number, and the page's whole markup."""
    lines = F.array(*(F.lit(s) for s in LINES))
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    line = lambda i: F.replace(F.element_at(lines, ((F.col("page_id") * (i + 1) + i * i) % len(LINES) + 1).cast("int")), F.lit("{n}"), (F.col("page_id") % 83).cast("string"))
    return pages.select("page_id", F.concat_ws("\n", *(line(i) for i in range(10)), "html").alias("body"))
