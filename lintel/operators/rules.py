"""Risks and questions by rule, from the doors of each project."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import text
from lintel.operators.distinct import held
from lintel.operators.skew import ENTRIES, ROWS, as_maps, crowded, dealt, parted
from lintel.plans.storage import settled


#: Marks that a finding shows; doors of a task.
SHOWN, DOORS = 8, 200_000


def marks(head: Column, n: Column) -> Column:
    """The first marks of a list, and how many more there are."""
    more = F.concat(F.lit(", ...+"), (n - F.size(head)).cast("string"), F.lit(" more"))
    return F.concat(F.array_join(head, ", "), F.when(n > F.size(head), more).otherwise(""))


def headed(held: DataFrame, group: list[str], mark: str) -> DataFrame:
    """(group, n, head): how many rows a group has and its first marks. Each task counts and keeps the first of its own rows, so a group of
    very many rows sends few; rows that are dealt by one of these columns are not shuffled again."""
    own = Window.partitionBy(*group, "_task")
    rows = held.withColumn("_task", F.spark_partition_id())
    rows = rows.withColumns({"_n": F.count("*").over(own), "_nth": F.row_number().over(own.orderBy(mark))}).where(F.col("_nth") <= SHOWN)
    first = F.slice(F.sort_array(F.collect_list(F.struct(mark))), 1, SHOWN)
    head = F.array_compact(F.transform(first, lambda x: x[mark]))
    return rows.groupBy(*group).agg(F.sum(F.when(F.col("_nth") == 1, F.col("_n"))).alias("n"), head.alias("head"))


def risks(doors: DataFrame, sets: DataFrame) -> DataFrame:
    """Rules over each project's openings, all in one pass; doors from resolved(). {n} in an issue is the number of openings."""
    content = sets.where("n_items > 0").select("project_id", F.col("hardware_set").alias("set_label"), F.lit(True).alias("full")).distinct()
    usual, apart = parted(doors, "project_id", [crowded(content, "project_id", ENTRIES)])
    rows = usual.join(as_maps(content, "project_id", "set_label", "full", "known"), "project_id", "left").withColumn("full", F.col("known")[F.col("set_label")]).drop("known")
    if apart is not None:
        rows = rows.unionByName(apart.join(content, ["project_id", "set_label"], "left").select(*rows.columns))
    said = F.concat_ws(" ", "remarks", "door_type")
    rated = (F.coalesce("fire_rating", F.lit("")) != "") & ~F.col("fire_rating").rlike(r"(?i)^(-|none|non|n/a)$")
    families = [
        (F.col("set_label").isNull(), "high", "Hardware mapping", "{n} opening(s) have no hardware set assigned in the schedule."),
        (F.col("set_label").isNotNull() & ~F.coalesce("full", F.lit(False)), "high", "Hardware set definitions", "{n} opening(s) reference a hardware set without line items."),
        (rated, "medium", "Fire-rated openings", "{n} fire-rated opening(s) require coordinated UL-listed door, frame and hardware assemblies."),
        (said.rlike(V.ACCESS_WORDS), "high", "Access control / electrified", "{n} opening(s) involve electrified or access-control hardware."),
    ]
    holds = F.array_compact(F.array(*(F.when(test, F.lit(i)) for i, (test, *_) in enumerate(families))))
    held = rows.select("project_id", "door_number", F.explode(holds).alias("family"))
    found = headed(held, ["project_id", "family"], "door_number")
    rule = F.element_at(F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(c).alias("category"), F.lit(n).alias("note")) for _, s, c, n in families)), F.col("family") + 1)
    found = found.withColumn("rule", rule)
    return found.select("project_id", "rule.severity", "rule.category", "n", F.replace("rule.note", F.lit("{n}"), F.col("n").cast("string")).alias("issue"), marks(F.col("head"), F.col("n")).alias("openings"))


def merged_findings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Findings (category, issue) of both, each once whatever its case, the first source's form kept; with an id."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    once = Window.partitionBy(F.lower(text(F.col("category"))), F.lower(text(F.col("issue")))).orderBy("side", "category", "issue")
    return both.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")


def numbered_findings(findings: DataFrame, group: str) -> DataFrame:
    """Findings by severity (high, medium, low, others), numbered RFI-001 and on within each group."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    nth = F.row_number().over(Window.partitionBy(group).orderBy(rank, "category", "issue"))
    return findings.withColumn("rfi_no", F.format_string("RFI-%03d", nth))


def contexts(projects: DataFrame) -> DataFrame:
    """What the notes of a project (project_id, general_notes, hardware_preamble, keying_notes: arrays; legend: a map) already answer:
    who brings power and cabling, the keying, and the abbreviations of its legend that mean electrified hardware."""
    none = F.array().cast("array<string>")
    keying = F.coalesce("keying_notes", none)
    said = F.array_join(F.concat(F.coalesce("general_notes", none), F.coalesce("hardware_preamble", none), keying), " \n ")
    power = said.rlike(V.POWER_BY_EC[0]) | said.rlike(V.POWER_BY_EC[1])
    short = F.map_keys(F.map_filter(F.coalesce("legend", F.map_from_arrays(none, none)), lambda _, v: v.rlike(V.LEGEND_ACCESS)))
    return projects.select(
        "project_id", (power & said.rlike(V.CABLING_BY_OTHERS)).alias("split_settled"), ((F.size(keying) > 0) & F.array_join(keying, " ").rlike(V.KEYING_DEFINED)).alias("keying_settled"), short.alias("abbreviations"),
    )


def _first_held(rows: DataFrame, own: list[str], n_families: int) -> DataFrame:
    """(project_id, family, n, head) as headed(), of rows (project_id, mark, bits) that hold several families each, one bit for each: a row is
    sorted once for all of them, and only first marks and a task's totals leave its task."""
    window = Window.partitionBy(*own).orderBy("mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bit = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    last = F.lead(F.lit(1)).over(Window.partitionBy(*own).orderBy("mark")).isNull().alias("last")
    so_far = rows.select("project_id", "mark", "bits", last, *(F.sum(bit(i).cast("long")).over(window).alias(f"n{i}") for i in range(n_families)))

    def entry(i: int) -> Column:
        n, first = F.col(f"n{i}"), bit(i) & (F.col(f"n{i}") <= SHOWN)
        return F.when(first | (F.col("last") & (n > 0)), F.struct(F.lit(i).alias("family"), F.when(first, F.struct("mark")).alias("first"), F.when(F.col("last"), n).alias("n")))

    entries = so_far.select("project_id", F.explode(F.array_compact(F.array(*map(entry, range(n_families))))).alias("x")).select("project_id", "x.*")
    head = F.slice(F.sort_array(F.collect_list("first")), 1, SHOWN)
    return entries.groupBy("project_id", "family").agg(F.sum("n").alias("n"), F.array_compact(F.transform(head, lambda x: x["mark"])).alias("head"))


def browser_findings(doors: DataFrame, sets: DataFrame, context: DataFrame, entries: int = ENTRIES, rows_apart: int = ROWS) -> DataFrame:
    """Risks and questions of each project by 18 families of rules: (project_id, kind, severity, category, n, openings).

    doors: project_id, mark, set_label, fire_rating, door_type, opening_type, room_or_location, remarks, interior_or_exterior, glazing,
    confidence, width, height. sets: project_id, set_label, items, note. context: from contexts(). A door holds each family once; the
    families that look at a project as a whole (voided sets, keying, completeness, lead time) come from its counts. Questions
    that the project's notes answer are left out.

    A door's texts are read before it is dealt: its mark, label and the families that it holds as bits go to its project's task, which looks
    up sets and abbreviations. Projects with more sets or doors than these are joined by label and counted in several tasks.
    """
    full = sets.groupBy("project_id", "set_label").agg(F.max(F.size(F.coalesce("items", F.array()))).alias("n_items"))
    content = settled(full.where("n_items > 0").select("project_id", "set_label", F.lit(True).alias("full")))
    context, counts = settled(context), settled(doors.groupBy("project_id").agg(F.count("*").alias("doors")))
    words = lambda *c: F.concat_ws(" ", *c)
    fire = (F.coalesce("fire_rating", F.lit("")) != "") & (F.col("fire_rating") != "-") & ~F.col("fire_rating").rlike(r"(?i)^non|^n/a$")
    said = F.struct(words("remarks", "door_type", "room_or_location").alias("usual"), words("room_or_location", "remarks").alias("place"), words("remarks", "door_type", "opening_type").alias("leaves"), F.coalesce(fire, F.lit(False)).alias("fire"))
    usual, rated = F.col("said.usual"), F.col("said.fire")
    tests = {
        "Fire-rated openings": rated, "Fire / smoke rating": rated, "Stair enclosures": rated & usual.rlike(V.STAIR_WORDS),
        "Exterior / weather": (F.col("interior_or_exterior") == "Exterior") | F.col("said.place").rlike(V.EXTERIOR_WORDS), "Access control / electrified": usual.rlike(V.ELECTRIFIED_WORDS),
        "ADA / automatic operators": usual.rlike(V.OPERATOR_WORDS), "Egress / exit devices": usual.rlike(V.PANIC_WORDS), "Pair / double-leaf openings": F.col("said.leaves").rlike(V.PAIR_OPENINGS),
        "High-security openings": usual.rlike(V.SECURITY_WORDS), "Acoustic / STC-rated": usual.rlike(V.ACOUSTIC_WORDS), "Existing conditions": usual.rlike(V.EXISTING_WORDS),
        "Glazing / vision lites": (F.coalesce("glazing", F.lit("")) != "") & ~F.col("glazing").rlike(r"(?i)^(none|-|n/a)$"), "Schedule legibility": F.coalesce("confidence", F.lit(1.0)) < 0.6,
        "Schedule completeness": (F.coalesce("width", F.lit("")) == "") | (F.coalesce("height", F.lit("")) == ""),
    }
    names = [*tests, "Hardware mapping", "Hardware set definitions"]
    mask = lambda given: sum((F.when(F.coalesce(test, F.lit(False)), F.lit(1 << names.index(k))).otherwise(F.lit(0)) for k, test in given.items()), F.lit(0))
    read = held(held(doors, "said", said), "bits", mask(tests)).select("project_id", "mark", "set_label", "bits", "said.usual")

    n_rows = counts.agg(F.sum("doors")).first()[0] or 0
    hot = counts.where(F.col("doors") > rows_apart).select("project_id")
    rows, apart = parted(read, "project_id", [None if hot.isEmpty() else hot, crowded(content, "project_id", entries)])
    rows = dealt(rows, "project_id", n_rows, DOORS).join(as_maps(content, "project_id", "set_label", "full", "known"), "project_id", "left").withColumn("full", F.col("known")[F.col("set_label")]).drop("known")

    def held_by(x: DataFrame) -> DataFrame:
        # A text holds an abbreviation only where it has its letters; the pattern is made for those alone.
        letters = lambda a: F.upper("usual").contains(F.upper(a)) & F.regexp_like("usual", F.concat(F.lit(r"(?i)\b\Q"), a, F.lit(r"\E\b")))
        access = 1 << names.index("Access control / electrified")
        labelled = (F.col("bits").bitwiseAND(F.lit(access)) == 0) & (F.size(F.coalesce("abbreviations", F.array().cast("array<string>"))) > 0) & F.exists("abbreviations", letters)
        unset = F.coalesce("set_label", F.lit("")) == ""
        more = mask({"Hardware mapping": unset, "Hardware set definitions": ~unset & ~F.coalesce("full", F.lit(False)), "Access control / electrified": labelled})
        joined = x.join(context.select("project_id", "abbreviations"), "project_id", "left")
        return joined.select("project_id", "mark", (F.col("bits") + more).alias("bits")).where("bits <> 0")

    first = _first_held(held_by(rows), ["project_id"], len(names))
    if apart is not None:
        apart = held_by(apart.join(content, ["project_id", "set_label"], "left")).withColumn("task", F.spark_partition_id())
        first = first.unionByName(_first_held(apart, ["project_id", "task"], len(names)))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("family") + 1)
    found = first.select("project_id", name.alias("family"), "n", marks(F.col("head"), F.col("n")).alias("openings"))
    voided = sets.where(F.coalesce("note", F.lit("")).rlike(V.VOIDED_WORDS)).groupBy("project_id").agg(F.count_distinct("set_label").alias("n")).select("project_id", F.lit("Voided hardware set").alias("family"), "n", F.lit("").alias("openings"))
    whole = counts.select("project_id", F.explode(F.array_compact(F.array(F.lit("Submittal / lead time"), F.when(F.col("doors") >= 5, "Keying / cylinders")))).alias("family"), F.lit(0).cast("long").alias("n"), F.lit("").alias("openings"))
    all_ = found.unionByName(voided).unionByName(whole).join(counts, "project_id").join(context.select("project_id", "split_settled", "keying_settled"), "project_id", "left")
    complete = (F.col("family") == "Schedule completeness") & (F.col("n") >= F.col("doors"))
    answered = (F.col("family") == "Keying / cylinders") & F.coalesce("keying_settled", F.lit(False))
    kinds = F.create_map(*(F.lit(x) for name, (risk, rfi) in V.FAMILIES.items() for x in (name, f"{risk}|{rfi}")))
    severity = F.split(kinds[F.col("family")], r"\|")
    settled_rfi = (F.col("family") == "Access control / electrified") & F.coalesce("split_settled", F.lit(False))
    kind = F.explode(F.array(F.struct(F.lit("risk").alias("kind"), severity[0].alias("severity")), F.struct(F.lit("rfi").alias("kind"), F.when(~settled_rfi, severity[1]).otherwise("").alias("severity"))))
    out = all_.where(~complete & ~answered).select("project_id", "family", "n", "openings", kind.alias("k"))
    return out.where("k.severity <> ''").select("project_id", "k.kind", "k.severity", F.col("family").alias("category"), "n", "openings")
