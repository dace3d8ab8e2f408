"""Openings to the items of their hardware sets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import alias_keys, is_placeholder_label, set_key, set_label
from lintel.functions.predicates import any_of, is_set_item, remains
from lintel.operators.distinct import held, with_distinct
from lintel.operators.skew import ENTRIES, ROWS, as_maps, crowded, dealt, parted, spread_join
from lintel.plans.storage import settled

#: Openings of a task.
OPENINGS = 200_000


def set_items(components: DataFrame) -> DataFrame:
    """The items of each project's sets as rows, each once, numbered in order: (project_id, set_key, item_no, row_key, desc, part, mfr, finish, qty)."""
    item = is_set_item(F.col("description"), F.col("hardware_set_id"), F.col("catalog_number"), F.col("manufacturer_code"), F.col("notes"), F.col("qty_raw"))
    good = components.where(~is_placeholder_label(F.col("hardware_set_id")) & item)
    rows = with_distinct(good, ["hardware_set_id"], set_key=set_key(F.col("hardware_set_id")))
    fields = {"row_key": F.col("row_key"), "desc": F.col("description"), "part": F.col("catalog_number"), "mfr": F.col("manufacturer_code"), "finish": F.col("finish_code"), "qty": F.col("qty_raw")}
    same = [F.lower(F.btrim("description")).alias("same_desc"), F.lower(F.btrim(F.coalesce("catalog_number", F.lit("")))).alias("same_part")]
    once = rows.groupBy("project_id", "set_key", *same).agg(F.min_by(F.struct(*(c.alias(k) for k, c in fields.items())), "row_key").alias("item"))
    return once.select("project_id", "set_key", F.row_number().over(Window.partitionBy("project_id", "set_key").orderBy("item.row_key")).alias("item_no"), "item.*")


def set_table(components: DataFrame, items: DataFrame) -> DataFrame:
    """The directory of each project's sets: (project_id, set_key, hardware_set, n_items); the label is the set's first one."""
    good = components.where(~is_placeholder_label(F.col("hardware_set_id")))
    rows = with_distinct(good, ["hardware_set_id"], set_key=set_key(F.col("hardware_set_id")), label=set_label(F.col("hardware_set_id")))
    labels = rows.groupBy("project_id", "set_key").agg(F.min_by("label", "row_key").alias("hardware_set"))
    counts = items.groupBy("project_id", "set_key").agg(F.count("*").alias("n_items"))
    return labels.join(counts, ["project_id", "set_key"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("int"))


def set_lookup(sets: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, key, hardware_set): a set's own key, or an alias that only one set of its scope has."""
    alias = sets.select(*scope, "set_key", "hardware_set", F.explode(alias_keys(F.col("hardware_set"))).alias("key"))
    single = alias.groupBy(*scope, "key").agg(F.count_distinct("set_key").alias("n"), F.min("hardware_set").alias("by_alias")).where("n = 1").drop("n")
    own = sets.select(*scope, F.col("set_key").alias("key"), F.col("hardware_set").alias("exact"))
    return own.join(single, [*scope, "key"], "full_outer").select(*scope, "key", F.coalesce("exact", "by_alias").alias("hardware_set"))


def resolved(doors: DataFrame, lookup: DataFrame, entries: int = ENTRIES, rows_apart: int = ROWS) -> DataFrame:
    """Doors with set_label: their own set's label as their project's lookup has it, or for doors without one the set that the
    door type, frame type, remarks or mark names, in this order; resolved_from says which.

    Doors are dealt by project once and look up all their keys in its map. Projects with more entries or doors than these are
    joined key by key.
    """
    own = F.when(~is_placeholder_label(F.col("hardware_set")), set_label(F.col("hardware_set")))
    short = lambda c: F.when(F.length(F.btrim(c)) <= 15, set_key(F.col(c)))
    said = F.regexp_extract(F.coalesce("remarks", F.lit("")), r"(?i)\b(?:group|set|hw(?:\s*set)?|type|spec)\s*#?\s*([a-z0-9]+)\b", 1)
    # Labels and types have few different values; marks have many, and only those of doors without a label are looked up.
    rows = with_distinct(doors, ["hardware_set"], own_label=own, key_own=set_key(own))
    rows = with_distinct(rows, ["door_type"], key_door_type=short("door_type"))
    rows = with_distinct(rows, ["frame_type"], key_frame_type=short("frame_type"))
    rows = with_distinct(rows, ["remarks"], key_remarks=set_key(said))
    names = ["own", "door_type", "frame_type", "remarks", "mark"]
    projects = settled(doors.groupBy("project_id").agg(F.count("*").alias("n")))
    n_rows = projects.agg(F.sum("n")).first()[0] or 0
    hot = projects.where(F.col("n") > rows_apart).select("project_id")
    usual, apart = parted(rows, "project_id", [None if hot.isEmpty() else hot, crowded(lookup, "project_id", entries)])
    usual = dealt(usual, "project_id", n_rows, OPENINGS).join(as_maps(lookup, "project_id", "key", "hardware_set", "known"), "project_id", "left")
    unset = F.col("own_label").isNull()
    key = lambda name: set_key(F.col("door_number")) if name == "mark" else F.col(f"key_{name}")
    asked = lambda name: F.when(~unset if name == "own" else unset, F.col("known")[key(name)]).alias(f"by_{name}")
    kept = [c for c in usual.columns if c != "known" and not c.startswith("key_")]
    rows = held(usual, "by", F.struct(*map(asked, names))).select(*kept, "by.*")
    if apart is not None:
        apart = apart.withColumn("key_mark", F.when(unset, set_key(F.col("door_number"))))
        for name in names:
            found = lookup.select("project_id", F.col("key").alias(f"key_{name}"), F.col("hardware_set").alias(f"by_{name}"))
            apart = apart.join(found, ["project_id", f"key_{name}"], "left").drop(f"key_{name}")
        rows = rows.unionByName(apart.select(*rows.columns))
    guesses = [n for n in names if n != "own"]
    label = F.when(F.col("own_label").isNotNull(), F.coalesce("by_own", "own_label")).otherwise(F.coalesce(*(f"by_{n}" for n in guesses)))
    origin = F.when(F.col("own_label").isNotNull(), "own").otherwise(F.coalesce(*(F.when(F.col(f"by_{n}").isNotNull(), n) for n in guesses)))
    return rows.withColumn("set_label", label).withColumn("resolved_from", origin).drop("own_label", *(f"by_{n}" for n in names))


def label_items(labels: DataFrame, sets: DataFrame, items: DataFrame) -> DataFrame:
    """What each label (project_id, set_label) stands for, as rows: the items of its set, or of all sets that a compound
    label names if each has items, else one row without an item. there: whether the set is in its project's directory."""
    place = ["project_id", "set_label"]
    parts = F.filter(F.transform(F.split("set_label", r"(?i)\s*(?:,|&|\band\b)\s*"), lambda p: F.btrim(p)), lambda p: p != "")
    named = sets.select("project_id", F.col("hardware_set").alias("part_set"), "set_key", "n_items")
    lookup = set_lookup(sets, ["project_id"]).select("project_id", F.col("key").alias("part_key"), F.col("hardware_set").alias("part_set"))
    cut = labels.select(*place, F.posexplode(parts).alias("nth", "part")).withColumn("part_key", set_key(F.col("part")))
    cut = cut.join(lookup, ["project_id", "part_key"], "left").join(named, ["project_id", "part_set"], "left")
    whole = Window.partitionBy(*place)
    before = whole.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    full = F.bool_and(F.coalesce("n_items", F.lit(0)) > 0).over(whole) & (F.count("*").over(whole) > 1)
    compound = cut.select(*place, "set_key", F.coalesce(F.sum("n_items").over(before), F.lit(0)).alias("offset"), full.alias("full")).where("full").drop("full")
    direct = labels.join(compound.select(*place).distinct(), place, "left_anti").join(named.withColumnRenamed("part_set", "set_label"), place, "left")
    listed = compound.unionByName(direct.where("n_items > 0").select(*place, "set_key", F.lit(0).cast("long").alias("offset")))
    held = spread_join(listed, items, ["project_id", "set_key"])
    fields = ["desc", "part", "mfr", "finish", "qty"]
    none = direct.where(F.coalesce("n_items", F.lit(0)) <= 0).select(*place, F.lit(None).cast("int").alias("item_no"), *(F.lit(None).cast("string").alias(c) for c in fields), F.col("set_key").isNotNull().alias("there"))
    return held.select(*place, (F.col("item_no") + F.col("offset")).cast("int").alias("item_no"), *fields, F.lit(True).alias("there")).unionByName(none)


def _openings(doors: DataFrame) -> DataFrame:
    """Openings (project_id, door_mark, row_key, set_label) with the kind that their words alone decide, if any."""
    words = lambda *c: F.upper(F.concat_ws(" ", *c))
    # 'NIC' counts anywhere, inside MECHANICAL too.
    by_others = any_of(words("door_material", "door_type", "frame_type", "remarks"), V.BY_OTHERS)
    coiling = any_of(words("door_material", "door_type", "remarks"), V.COILING)
    kind = F.when(by_others, "BY_OTHERS").when(remains("remarks", "door_material", "door_type"), "EXISTING_TO_REMAIN").when(F.col("set_label").isNull() & coiling, "COILING_SYSTEM").when(F.col("set_label").isNull(), "NO_HW_SET")
    return doors.select("project_id", F.col("door_number").alias("door_mark"), "row_key", "set_label", kind.alias("kind"))


def _mapped(rows: DataFrame, joined: DataFrame, out: list[str]) -> DataFrame:
    """The rows of J9, from openings of a kind and from openings with the items of their label."""
    joined = joined.unionByName(rows.where("kind is not null"), allowMissingColumns=True)
    got = F.col("item_no").isNotNull()
    status = F.when(F.col("kind").isNotNull(), F.col("kind")).when(got, "OK").otherwise("FAILED_EXTRACTION_REVIEW_REQUIRED")
    note = F.when(got, F.col("desc")).when(F.col("there"), V.STATUS_NOTES["EMPTY"]).otherwise(V.STATUS_NOTES["ABSENT"])
    for name in ("BY_OTHERS", "EXISTING_TO_REMAIN", "COILING_SYSTEM", "NO_HW_SET"):
        note = F.when(F.col("kind") == name, V.STATUS_NOTES[name]).otherwise(note)
    shown = F.when(~F.coalesce(F.col("kind").isin("BY_OTHERS", "COILING_SYSTEM", "NO_HW_SET"), F.lit(False)), F.col("set_label"))
    return joined.select(
        *out, shown.alias("hardware_set"), "item_no", "qty", note.alias("description"),
        F.col("part").alias("catalog_number"), F.col("mfr").alias("manufacturer"), "finish", status.alias("status"),
    )


def mapped(doors: DataFrame, sets: DataFrame, items: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """A row for each item of each opening, and one status row for an opening that has none; doors from resolved().

    Status, the first that holds: BY_OTHERS, EXISTING_TO_REMAIN, COILING_SYSTEM, NO_HW_SET, OK with items (of several
    sets, if all of the sets that a compound label names have items), FAILED_EXTRACTION_REVIEW_REQUIRED.

    Openings meet the sets of their own project alone, so rows grow with openings; they find their label in its project's map, as
    they are dealt by project. Projects with more items than these are joined by label, and a label that very many share is split.
    """
    rows, place = settled(_openings(doors)), ["project_id", "set_label"]  # their labels first, then their items
    content = settled(label_items(rows.where("kind is null").select(*place).distinct(), sets, items))
    open_, apart = parted(rows.where("kind is null"), "project_id", [crowded(content, "project_id", entries)])
    fields = [c for c in content.columns if c not in place]
    lists = content.groupBy(*place).agg(F.collect_list(F.struct(*fields)).alias("found"))
    joined = open_.join(as_maps(lists, "project_id", "set_label", "found", "known"), "project_id", "left").select(*rows.columns, F.explode(F.col("known")[F.col("set_label")]).alias("x")).select(*rows.columns, "x.*")
    if apart is not None:
        joined = joined.unionByName(spread_join(apart, content, place))
    return _mapped(rows, joined, ["project_id", "door_mark", "row_key"])


def mapped_groups(doors: DataFrame, sets: DataFrame, items: DataFrame) -> DataFrame:
    """J9 without marks: openings of a project that share label and kind are one, with their number n, so items meet them once."""
    place = ["project_id", "set_label"]
    groups = settled(_openings(doors).groupBy(*place, "kind").agg(F.count("*").alias("n")))
    open_ = groups.where("kind is null")
    joined = open_.join(label_items(open_.select(*place), sets, items), place)
    return _mapped(groups, joined, ["project_id", "n"])


def noted_openings(doors: DataFrame, notes: DataFrame) -> DataFrame:
    """Doors (row_key, remarks) whose remarks name a note (number, note) that says that the opening stays."""
    said = doors.select("row_key", F.explode(F.regexp_extract_all(F.coalesce("remarks", F.lit("")), F.lit(r"\d+"), F.lit(0))).alias("number"))
    upper = F.upper("note")
    stays = (upper.contains("EXISTING") & (upper.contains("REMAIN") | upper.contains("HARDWARE"))) | upper.contains("ETR")
    return said.join(notes, "number").groupBy("row_key").agg(F.bool_or(stays).alias("existing_to_remain"))
