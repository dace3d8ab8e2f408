"""Sets, lists and findings of several sources as one."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.normalise import alias_keys, reference_id, set_key, set_label, text
from lintel.operators.mapping import set_lookup


def natural_order(key: Column) -> list[Column]:
    """Sort columns of ids: numbers first, by value, then texts."""
    number = F.when(key.rlike(r"^\d+$"), key.try_cast("long"))
    return [F.when(number.isNull(), 1).otherwise(0), F.coalesce(number, F.lit(0)), key]


def missing_references(doors: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """(group, missing): the set ids that doors name and no component has, in natural order."""
    named = doors.select(group, reference_id(F.col("hardware_set")).alias("set_id")).where("set_id <> ''").distinct()
    missing = named.join(parts.select(group, reference_id(F.col("hardware_set_id")).alias("set_id")).distinct(), [group, "set_id"], "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(natural_order(F.col("set_id")))))))
    return missing.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["k2"]), ", ").alias("missing"))


def distinct_texts(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose text is the first of its kind in the group, whatever its case and the space around it; blank ones go."""
    key = F.lower(text(F.col(value)))
    first = Window.partitionBy(group, key).orderBy(*order)
    return rows.where(key != "").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def in_common(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """The different keys that both sides have, by a semi-join: neither side's keys are gathered."""
    return one.select(*keys).distinct().join(two.select(*keys), keys, "left_semi")


def merged_legends(left: Column, right: Column) -> Column:
    """One map of two, keys in capitals, the right side's value where both have one; blank values go."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = F.concat(F.map_entries(F.coalesce(left, none)), F.map_entries(F.coalesce(right, none)))
    clean = F.filter(F.transform(entries, lambda e: F.struct(F.upper(text(e["key"])).alias("key"), text(e["value"]).alias("value"))), lambda e: e["value"] != "")

    def last(all_: Column) -> Column:
        return F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"])))

    return F.transform(F.array(clean), last)[0]


def signed_findings(first: DataFrame, second: DataFrame) -> DataFrame:
    """U8: findings (project_id, category, severity, openings) of both, each signature once, the first source's form kept; open unless they say otherwise.

    The signature is category and severity in lower case and the sorted openings.
    """
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)), allowMissingColumns=True)
    marks = F.array_join(F.array_sort(F.coalesce("openings", F.array().cast("array<string>"))), ",")
    once = Window.partitionBy("project_id", F.lower(text(F.col("category"))), F.lower(text(F.col("severity"))), marks).orderBy("side", "issue")
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("Open")) if "status" in both.columns else F.lit("Open")
    return both.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth").withColumn("status", status)


def with_missing_sets(sets: DataFrame, doors: DataFrame) -> DataFrame:
    """Each project's sets (project_id, hardware_set, status, confidence, n_items), and one of status missing for each label that only its doors name."""
    place = ["project_id", "hardware_set"]
    absent = doors.select(*place).where("hardware_set <> ''").distinct().join(sets.select(*place), place, "left_anti")
    added = absent.select(*place, F.lit("missing").alias("status"), F.lit(0.3).alias("confidence"), F.lit(0).alias("n_items"))
    return sets.select(*place, "status", "confidence", "n_items").unionByName(added)


def merged_sets(ours: DataFrame, theirs: DataFrame, allowed: DataFrame) -> DataFrame:
    """The items (hardware_set, row_key, qty, unit, desc, part, mfr, finish) of our sets and of rescued ones.

    A rescued set joins ours of its key, or of an alias that only one of ours has; else it is new, if one of its keys is allowed
    (hardware_set) or nothing is named there. An item that its set has already is not added. origin: ours or rescued.
    """
    keyed = lambda df: df.withColumn("set_key", set_key(F.col("hardware_set"))).where("set_key <> ''")
    known = keyed(ours).groupBy("set_key").agg(F.min_by(set_label(F.col("hardware_set")), "row_key").alias("hardware_set"))
    labels = keyed(theirs).select("hardware_set", "set_key").distinct()
    keys = labels.select("hardware_set", "set_key", F.explode(F.concat(F.array("set_key"), alias_keys(F.col("hardware_set")))).alias("key"), F.monotonically_increasing_id().alias("no"))
    found = set_lookup(known, []).withColumnRenamed("hardware_set", "target").join(known.select(F.col("hardware_set").alias("target"), F.col("set_key").alias("target_key")), "target")
    exact = labels.join(found.select(F.col("key").alias("set_key"), F.col("target_key").alias("by_key")), "set_key", "left")
    alias = keys.join(found, "key").groupBy("hardware_set").agg(F.min("target_key").alias("by_alias"))
    permitted = allowed.select(F.explode(F.concat(F.array(set_key(F.col("hardware_set"))), alias_keys(F.col("hardware_set")))).alias("key")).where("key <> ''").distinct()
    any_named = permitted.agg((F.count("*") > 0).alias("restricted"))
    good = keys.join(permitted, "key", "left_semi").select("hardware_set").distinct().withColumn("permitted", F.lit(True))
    target = exact.join(alias, "hardware_set", "left").join(good, "hardware_set", "left").join(F.broadcast(any_named))  # one row
    target = target.withColumn("to", F.coalesce("by_key", "by_alias", F.when(F.coalesce("permitted", F.lit(False)) | ~F.col("restricted"), F.col("set_key")))).where("to is not null").select("hardware_set", "to")
    items = keyed(ours).select(F.col("set_key").alias("to"), *_ITEM, "row_key", F.lit("ours").alias("origin")).unionByName(theirs.join(target, "hardware_set").select("to", *_ITEM, "row_key", F.lit("rescued").alias("origin")))
    same = Window.partitionBy("to", *(F.lower(text(F.col(c))) for c in _ITEM)).orderBy("origin", "row_key")
    kept = items.withColumn("nth", F.row_number().over(same)).where((F.col("origin") == "ours") | (F.col("nth") == 1))
    return kept.select(F.col("to").alias("set_key"), *_ITEM, "row_key", "origin")


_ITEM = ["qty", "unit", "desc", "part", "mfr", "finish"]


def merged_runs(doors: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Doors (side, row_key, mark, ...) and sets (side, row_key, hardware_set, ...) of two runs as those of one: each mark and each set
    name once, whatever its case, the first run's form kept. Mapping and findings follow from these as for any run."""
    pick = lambda df, c: df.where(text(F.col(c)) != "").withColumn("nth", F.row_number().over(Window.partitionBy(F.upper(text(F.col(c)))).orderBy("side", "row_key"))).where("nth = 1").drop("nth")
    return pick(doors, "mark"), pick(sets, "hardware_set")


def distinct_near_rows(items: DataFrame) -> DataFrame:
    """Marks (page_id, y, x, mark) at about the same height once a page, the first by y and x. Halves round to even, as heights are binned."""
    once = Window.partitionBy("page_id", F.bround(F.col("y") / 8), "mark").orderBy("y", "x")
    return items.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")


def in_bands(rows: DataFrame, items: DataFrame, bands: dict[str, tuple[Column, Column]], height: float = 10) -> DataFrame:
    """Rows (page_id, row_id, y) with what stands in each band of columns near their height: the texts of items (page_id, x, y, text), by x.

    Rows and items meet on bins of the height, so no page's rows meet all its items.
    """
    bin_ = lambda y, k: (F.floor(y / height) + k).cast("long")
    spread = rows.select("page_id", "row_id", F.col("y").alias("row_y"), F.explode(F.array(*(bin_(F.col("y"), k) for k in (-1, 0, 1)))).alias("bin"))
    met = spread.join(items.withColumn("bin", bin_(F.col("y"), 0)), ["page_id", "bin"]).where(F.abs(F.col("y") - F.col("row_y")) <= height)
    held = [F.array_sort(F.collect_list(F.when((F.col("x") >= lo) & (F.col("x") < hi), F.struct("x", "text")))).alias(name) for name, (lo, hi) in bands.items()]
    return met.groupBy("page_id", "row_id").agg(*held).select("page_id", "row_id", *(F.array_join(F.col(f"{n}.text"), " ").alias(n) for n in bands))
