"""Estimation: master prices, labour and material, the bid, proposal lines."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.normalise import level_side, text

#: Miles beyond which gas is paid, the drug test, minutes to unload a door on level 1 and above.
GAS_FROM_MILES, DRUG_TEST, UNLOAD_FIRST, UNLOAD_ABOVE = 40, 150.0, 25, 35
LABOR_A_DOOR = 85


def cents(c: Column) -> Column:
    """An amount to the cent, halves up, by the same arithmetic in every engine."""
    return F.floor(c * 100 + 0.5) / 100


def with_master(estimations: DataFrame, masters: DataFrame) -> DataFrame:
    """The master component of the same description; the last of equals wins."""
    last = Window.partitionBy("key").orderBy(F.col("id").desc())
    lookup = masters.where("description is not null").withColumn("key", F.lower(text(F.col("description")))).withColumn("nth", F.row_number().over(last)).where("nth = 1")
    lookup = lookup.select("key", F.col("id").alias("mapped_master_id"), "install_time_mins", "default_unit_price")
    return estimations.withColumn("key", F.lower(text(F.col("description")))).join(lookup, "key", "left").drop("key")


def levels(doors: DataFrame) -> DataFrame:
    """P49 by project: doors on level 1 and above it."""
    side = level_side(F.col("level_area"))
    return doors.groupBy("project_id").agg(F.count_if(side == "level_1").alias("doors_level_1"), F.count_if(side == "above").alias("doors_above_level_1"))


def bids(projects: DataFrame, estimations: DataFrame) -> DataFrame:
    """The bid of each project, 14 amounts rounded to cents. An override counts even if it is 0."""
    minutes = F.coalesce("override_install_time_mins", "install_time_mins", F.lit(0.0))
    price = F.coalesce("override_unit_price", "default_unit_price", F.lit(0.0))
    totals = estimations.groupBy("project_id").agg(F.sum(F.col("total_qty_project") * minutes).alias("minutes"), F.sum(F.col("total_qty_project") * price).alias("material"))
    rows = projects.join(totals, "project_id", "left")
    number = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    share = lambda name: number(name) / 100.0
    where = lambda flag, amount: F.when(F.col(flag), amount).otherwise(F.lit(0.0))
    steps: dict[str, Column] = {
        "hours": number("minutes") / 60.0,
        "base": F.col("hours") * number("wage_scale_carpenter"),
        "gas": F.when(number("distance_miles") > GAS_FROM_MILES, number("distance_miles") * number("gas_allowance_per_mile")).otherwise(0.0),
        "allow": F.col("gas") + where("outstation_stay", number("hotel_allowance_per_day") + number("meal_allowance_per_day")) + where("parking_required", number("parking_allowance_per_day")) + where("drug_testing", F.lit(DRUG_TEST)),
        "labor": F.col("base") + F.col("allow"),
        "burden": F.col("labor") * share("labor_burden_pct"),
        "over": (F.col("labor") + F.col("burden")) * share("overhead_pct"),
        "mark": (F.col("labor") + F.col("burden") + F.col("over")) * share("profit_markup_pct"),
        "before": F.col("labor") + F.col("burden") + F.col("over") + F.col("mark"),
        "rate": F.when(F.col("hours") > 0, F.col("before") / F.when(F.col("hours") > 0, F.col("hours"))).otherwise(number("wage_scale_carpenter")),
        "unload": (F.coalesce("doors_level_1", F.lit(0)) * UNLOAD_FIRST + F.coalesce("doors_above_level_1", F.lit(0)) * UNLOAD_ABOVE) / 60.0 * F.col("rate") + number("tool_mobilization_allowance"),
        "unload_tax": where("apply_tax_to_equipment", F.col("unload") * share("sales_tax_pct")),
        "labor_bid": F.col("before") + F.col("unload") + F.col("unload_tax"),
        "goods": number("material"),
        "goods_mark": F.col("goods") * share("material_markup_pct"),
        "goods_tax": (F.col("goods") + F.col("goods_mark")) * share("sales_tax_pct"),
        "goods_bid": F.col("goods") + F.col("goods_mark") + F.col("goods_tax"),
    }
    for name, step in steps.items():
        rows = rows.withColumn(name, step)
    amounts = {
        "total_man_hours": "hours", "base_labor_cost": "base", "allowances": "allow", "labor_burden": "burden", "overhead": "over", "labor_markup": "mark", "offload_cost": "unload",
        "equipment_tax": "unload_tax", "total_labor_bid": "labor_bid", "raw_material_cost": "goods", "material_markup": "goods_mark", "sales_tax": "goods_tax", "total_material_bid": "goods_bid",
    }
    return rows.select("project_id", *(cents(F.col(v)).alias(k) for k, v in amounts.items()), cents(F.col("labor_bid") + F.col("goods_bid")).alias("total_bid"))


def proposal_totals(doors: DataFrame, prices: DataFrame, markup: str) -> DataFrame:
    """Subtotal, labour at a fixed amount a door, markup and total by project; prices (hardware_set_id, set_price decimal).

    Money is decimal, so the result does not depend on the order of the sums. markup: a share as text, such as "0.15".
    """
    used = doors.groupBy("project_id", "hardware_set_clean").agg(F.count("*").alias("n"))
    priced = used.join(prices.withColumnRenamed("hardware_set_id", "hardware_set_clean"), "hardware_set_clean", "left")
    amount = F.when(F.col("hardware_set_clean") != "", F.col("n").cast("decimal(10,0)") * F.coalesce("set_price", F.lit(0))).otherwise(0).cast("decimal(24,2)")
    sums = priced.groupBy("project_id").agg(F.sum(amount).alias("subtotal"), F.sum("n").alias("n"))
    sums = sums.withColumn("labor", F.col("n") * LABOR_A_DOOR).withColumn("extra", F.round(F.col("subtotal") * F.lit(Decimal(markup)), 2))
    return sums.select("project_id", F.col("subtotal").cast("double").alias("subtotal"), "labor", F.col("extra").cast("double").alias("markup_amount"), (F.col("subtotal") + F.col("extra") + F.col("labor")).cast("double").alias("total"))
