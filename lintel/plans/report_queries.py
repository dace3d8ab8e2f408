"""Queries of short reports, merges and row filters, each with its SQL."""

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import normalise as N
from lintel.functions import pages as G
from lintel.functions import vocabulary as V
from lintel.operators import answers, gates, mapping, merge, ocr, ordinals, parse, reconcile, reports, rules, summaries, takeoff, validate
from lintel.operators.distinct import with_distinct
from lintel.plans import oracle as O
from lintel.plans import views
from lintel.plans.storage import shared_folder
from lintel.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark, sf_dir):
    return views.table(spark, sf_dir, "orders")


@query("SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS total_value, count(*) FILTER (o_custkey % 5 < 3) AS active, count(*) FILTER (o_custkey % 5 = 3) AS won, CAST(floor(count(*) FILTER (o_custkey % 5 = 3) * 100 / count(*) FILTER (o_custkey % 5 >= 3) + 0.5) AS BIGINT) AS win_rate FROM orders")
def a16_proposal_totals(spark, sf_dir):
    states = F.array(*(F.lit(s) for s in ("Draft", "Sent", "In Review", "Accepted", "Lost")))
    proposals = _orders(spark, sf_dir).select(F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.element_at(states, (F.col("o_custkey") % 5 + 1).cast("int")).alias("status"))
    return summaries.proposal_totals(proposals).withColumn("total_value", F.col("total_value").cast("double"))


@query("SELECT round(avg(60 + o_orderkey % 41), 1) AS mean_score, count(*) AS n, count(*) FILTER (60 + o_orderkey % 41 < 90) AS failed FROM orders")
def a19_accuracy(spark, sf_dir):
    return summaries.accuracy(_orders(spark, sf_dir).select((F.col("o_orderkey") % 41 + 60).alias("score")))


@query("""SELECT 'file_' || (user_id % 500) AS pdf_name, CAST(sum(coalesce(CASE WHEN event_id % 7 > 0 THEN event_id % 4 END, 0)) AS BIGINT) AS crop_count, count(*) FILTER (event_id % 3 = 0) AS crop_rescue_attempt_pages, count(*) FILTER (event_id % 6 = 0) AS crop_rescue_pages,
  CAST(sum(event_id % 5) AS BIGINT) AS crop_door_added, CAST(sum(event_id % 2) AS BIGINT) AS crop_hw_added FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1""")
def a21_crop_metrics(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("kind"))  # one row
    k = F.col("event_id")
    events = e.join(F.broadcast(kind)).select(
        F.concat(F.lit("file_"), F.col("user_id") % 500).alias("pdf_name"), F.when(F.col("event_type") == F.col("kind"), "page_extracted").otherwise("other").alias("event"),
        F.when(k % 7 > 0, k % 4).alias("crop_count"), (k % 3 == 0).alias("attempted"), (k % 6 == 0).alias("rescued"), (k % 5).alias("door_added"), (k % 2).alias("hw_added"),
    )
    return summaries.crop_metrics(events)


@query(O.chain(O.RUNS, O.TRIAGE, select="SELECT severity, count(*) AS n, string_agg(run_id, ',' ORDER BY run_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC, row_key DESC) AS nth FROM kinds JOIN (SELECT row_key, completed_at FROM runs) USING (row_key)) WHERE nth = 1 GROUP BY severity"))
def a22_tiers(spark, sf_dir):
    last = reconcile.first_of(views.runs(spark, sf_dir), [F.col("run_id")], [F.col("completed_at").desc(), F.col("row_key").desc()])
    return summaries.tiers(reports.triaged(last))


_ONE = "SELECT run_id, status, severity, doors, hardware FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY completed_at, row_key) AS nth FROM kinds JOIN (SELECT row_key, doors, hardware, completed_at FROM runs) USING (row_key)) WHERE nth = 1"
_NOW = "SELECT run_id, status, doors, hardware FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC, row_key DESC) AS nth FROM runs) WHERE nth = 1 AND row_key % 11 > 0"


@query(O.chain(O.RUNS, O.TRIAGE, f"b AS ({_ONE})", f"c AS ({_NOW})", select="""SELECT run_id, failure FROM (SELECT run_id, unnest([CASE WHEN c.run_id IS NULL THEN 'missing in current run' END, CASE WHEN b.status = 'ok' AND c.status <> 'ok' THEN 'status regressed to ' || c.status END,
  CASE WHEN severity = 'ok' AND c.doors < b.doors THEN 'doors ' || c.doors || ' < baseline ' || b.doors END, CASE WHEN severity = 'ok' AND c.hardware < b.hardware THEN 'hardware ' || c.hardware || ' < baseline ' || b.hardware END,
  CASE WHEN b.run_id IN ('run_7', 'run_8', 'run_9') AND severity = 'high' AND c.doors + c.hardware < b.doors + b.hardware THEN 'total rows ' || (c.doors + c.hardware) || ' < baseline ' || (b.doors + b.hardware) END]) AS failure FROM b LEFT JOIN c USING (run_id)) WHERE failure IS NOT NULL"""))
def j25_regressions(spark, sf_dir):
    runs = views.runs(spark, sf_dir)
    first = reports.triaged(reconcile.first_of(runs, [F.col("run_id")], [F.col("completed_at"), F.col("row_key")]))
    now = reconcile.first_of(runs, [F.col("run_id")], [F.col("completed_at").desc(), F.col("row_key").desc()]).where("row_key % 11 > 0")
    return summaries.regressions(first.select("run_id", "status", "severity", "doors", "hardware"), now, ["run_7", "run_8", "run_9"])


@query("SELECT printf('P-1995-%03d', coalesce(max(CASE WHEN year(o_orderdate) = 1995 THEN o_orderkey % 700 END), 0) + 1) AS next_id FROM orders")
def a25_next_number(spark, sf_dir):
    ids = _orders(spark, sf_dir).select(F.format_string("P-%d-%03d", F.year("o_orderdate"), (F.col("o_orderkey") % 700).cast("int")).alias("id"))
    return summaries.next_number(ids, 1995)


@query(O.chain(O.DOORS, select="SELECT project_id, door_number, row_key, remarks FROM doors WHERE (contains(lower(door_number), 'set') OR contains(lower(coalesce(level_area, '')), 'set') OR contains(lower(coalesce(hardware_set, '')), 'set') OR contains(lower(coalesce(remarks, '')), 'set')) AND row_key % 5 = 1"))
def f22_found_doors(spark, sf_dir):
    risk = F.when(F.col("row_key") % 5 == 0, "High").when(F.col("row_key") % 5 == 1, "LOW")
    doors = views.doors(spark, sf_dir).select("project_id", "door_number", "row_key", "remarks", "hardware_set", F.col("door_number").alias("mark"), F.col("level_area").alias("room_or_location"), F.lit(None).cast("string").alias("special_conditions"), risk.alias("risk_level"))
    return summaries.found_doors(doors, "SET", "low").select("project_id", "door_number", "row_key", "remarks")


@query(O.chain(O.COMPONENTS, O.SETS, select="SELECT project_id, set_key, hardware_set FROM sets_ WHERE contains(lower(hardware_set), 'clos') OR len(list_filter(coalesce(items, []), lambda i: contains(lower(coalesce(i.desc, '')), 'clos') OR contains(lower(coalesce(i.part, '')), 'clos'))) > 0"))
def f23_found_sets(spark, sf_dir):
    items = mapping.set_items(views.components(spark, sf_dir))
    return summaries.found_sets(mapping.set_table(views.components(spark, sf_dir), items), items, "Clos").select("project_id", "set_key", "hardware_set")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 3 = 2")
def f24_own_rows(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("*", (F.col("o_custkey") % 4).alias("organization_id"), (F.col("o_orderkey") % 3).alias("user_id"))
    return summaries.own_rows(rows, F.lit(1), F.lit(2)).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 1)")
def j23_tenant_logs(spark, sf_dir):
    runs = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_nationkey") % 3).alias("organization_id"))
    logs = views.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").cast("long").alias("run_id"))
    return summaries.tenant_logs(logs, runs, F.lit(1)).select("event_id", "user_id")


@query(O.chain(O.COMPONENTS, select=f"SELECT row_key, t[1:180] AS text FROM (SELECT row_key, hardware_set_id || ' ' || description || ' ' || coalesce(catalog_number, '') AS t FROM parts) WHERE {O.has('t', 'trash|kick plate', 'i')} OR {O.has('t', '^set [0-9]$', 'i')}"))
def f29_forbidden(spark, sf_dir):
    return summaries.forbidden(views.components(spark, sf_dir), ["hardware_set_id", "description", "catalog_number"], ["trash|KICK PLATE", "^set [0-9]$"])


@query("""SELECT user_id, event_id, priority, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, confidence DESC, event_id) AS nth FROM (SELECT *, max(priority) OVER (PARTITION BY user_id) AS most FROM (SELECT user_id, event_id, event_id % 10 AS priority, round(value, 3) AS confidence FROM events))
  WHERE most < 7 OR priority >= 7) WHERE nth <= 8""")
def t3_best_crops(spark, sf_dir):
    crops = views.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("crop_id"), (F.col("event_id") % 10).alias("priority"), F.round("value", 3).alias("confidence"))
    return summaries.best_crops(crops, "user_id", 8).select("user_id", "event_id", "priority", "nth")


@query(O.chain(O.RUNS, select="SELECT run_id, row_key, completed_at FROM runs ORDER BY completed_at DESC, row_key DESC LIMIT 20"))
def t8_recent_runs(spark, sf_dir):
    return summaries.recent(views.runs(spark, sf_dir).select("run_id", "row_key", "completed_at"), 20)


@query(O.chain(O.DOORS, select="SELECT door_material, n, CAST(row_number() OVER (ORDER BY n DESC, door_material) AS INT) AS place FROM (SELECT coalesce(door_material, 'Unspecified') AS door_material, count(*) AS n FROM doors GROUP BY 1)"))
def t9_sorted_counts(spark, sf_dir):
    """The one-way counts in the order of a sheet, largest first; a handful of rows."""
    counts = reports.one_way_counts(views.doors(spark, sf_dir), {"door_material": "Unspecified"}).select(F.col("value").alias("door_material"), "n")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "door_material", "n")))
    return counts.agg(ordered.alias("rows")).select(F.posexplode("rows").alias("at", "r")).select("r.door_material", "r.n", (F.col("at") + 1).alias("place"))


@query(O.chain(O.RUNS, select="SELECT run_id, row_key FROM runs ORDER BY sha256('42:' || row_key), row_key LIMIT 25"))
def t11_shuffled_runs(spark, sf_dir):
    return summaries.shuffled(views.runs(spark, sf_dir).select("run_id", "row_key"), "row_key", 42, 25)


@query(O.chain(O.DOORS, O.COMPONENTS, select=f"""SELECT project_id, string_agg(set_id, ', ' ORDER BY CASE WHEN {O.has('set_id', '^[0-9]+$')} THEN 0 ELSE 1 END, coalesce(TRY_CAST(set_id AS BIGINT), 0), set_id) AS missing FROM (SELECT project_id, {O.reference_id('hardware_set')} AS set_id FROM doors
  EXCEPT SELECT project_id, {O.reference_id('hardware_set_id')} FROM parts) WHERE set_id <> '' GROUP BY project_id"""))
def t2_missing_references(spark, sf_dir):
    return merge.missing_references(views.doors(spark, sf_dir), views.components(spark, sf_dir), "project_id")


@query(O.chain(O.DIRTY, select=f"SELECT value, CAST(row_number() OVER (ORDER BY CASE WHEN {O.has('value', '^[0-9]+$')} THEN 0 ELSE 1 END, CASE WHEN {O.has('value', '^[0-9]+$')} THEN CAST(value AS BIGINT) ELSE 0 END, value) AS BIGINT) AS place FROM (SELECT DISTINCT value FROM (SELECT value FROM raw UNION ALL SELECT p_name FROM part UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer) WHERE value IS NOT NULL)"))
def t1_natural_order(spark, sf_dir):
    """Places of the different values in natural order: dirty values, and the names of all parts and customers."""
    names = [views.dirty(spark, sf_dir).select("value"), views.table(spark, sf_dir, "part").select("p_name"), views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"))]
    values = functools.reduce(DataFrame.union, names).where("value is not null").distinct()
    return ordinals.numbered(values, merge.natural_order(F.col("value")))


@query(f"SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower({O.txt('text')}) ORDER BY turn) AS nth FROM (SELECT conv_id, turn + n AS turn, pad || role || ' ' || coalesce(text, '') || pad AS text FROM conversations, (SELECT unnest([0, 1000]) AS n, unnest(['', ' ']) AS pad) WHERE n = 0 OR turn % 2 = 0)) WHERE nth = 1")
def u4_distinct_texts(spark, sf_dir):
    """Whole turns, half of them said again with space around them, each once a conversation."""
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    turns = turns.unionByName(turns.where("turn % 2 = 0").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text")))
    return merge.distinct_texts(turns, "conv_id", ["turn"], "text")


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'A=' || CASE o_orderkey % 2 WHEN 0 THEN 'door' ELSE 'frame' END || ';B=x' WHEN 1 THEN 'A=' || CASE o_orderkey % 2 WHEN 0 THEN 'door' ELSE 'left' END || ';B=x' ELSE 'A=left;B=x' END AS legend FROM orders")
def u5_merged_legends(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    left = F.create_map(F.lit(" a "), F.lit("left"), F.lit("b"), F.lit(" x "), F.lit("c"), F.lit("  "))
    right = F.when(c % 3 == 0, F.create_map(F.lit("A"), F.when(k % 2 == 0, "door").otherwise("frame"))).when(c % 3 == 1, F.create_map(F.lit("a"), F.when(k % 2 == 0, "door").otherwise("")))
    merged = F.map_entries(merge.merged_legends(left, right))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.array_sort(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("legend"))


@query(O.chain(O.DOORS, select="""SELECT project_id, count(*) AS sets FROM (SELECT project_id, hardware_set FROM doors WHERE source_file = 'Door and Hardware.pdf' AND hardware_set <> '' INTERSECT SELECT project_id, hardware_set FROM doors WHERE source_file = 'Division 8 HARDWARE.pdf') GROUP BY project_id"""))
def u7_files_that_meet(spark, sf_dir):
    """Projects whose two hardware files name sets in common, and how many."""
    doors = views.doors(spark, sf_dir).where("hardware_set <> ''")
    one, two = (doors.where(F.col("source_file") == name) for name in ("Door and Hardware.pdf", "Division 8 HARDWARE.pdf"))
    return merge.in_common(one, two, ["project_id", "hardware_set"]).groupBy("project_id").agg(F.count("*").alias("sets"))


@query(O.chain(O.DOORS, select="SELECT 'doors' AS origin, source_file, count(*) AS n FROM doors GROUP BY 2 UNION ALL SELECT 'parts', CAST(NULL AS VARCHAR), count(*) FROM part"))
def u1_all_rows(spark, sf_dir):
    doors = views.doors(spark, sf_dir).select(F.lit("doors").alias("origin"), "source_file")
    both = doors.unionByName(views.components(spark, sf_dir).select(F.lit("parts").alias("origin")), allowMissingColumns=True)
    return both.groupBy("origin", "source_file").agg(F.count("*").alias("n"))


@query(O.chain(O.DOORS, O.RUNS, select="SELECT source_file AS file FROM doors UNION SELECT pdf_name FROM runs"))
def u2_all_files(spark, sf_dir):
    return views.doors(spark, sf_dir).select(F.col("source_file").alias("file")).union(views.runs(spark, sf_dir).select("pdf_name")).distinct()


_FINDING = "SELECT project_id, {c} AS category, {s} AS severity, [door_number] AS openings, {i} AS issue, row_key FROM doors WHERE {w}"


@query(O.chain(O.DOORS, "both_ AS (" + _FINDING.format(c="CASE row_key % 3 WHEN 0 THEN 'Fire ' ELSE 'size' END", s="'HIGH'", i="'m' || row_key", w="row_key % 2 = 0").replace("row_key FROM", "0 AS side FROM") + " UNION ALL " + _FINDING.format(c="CASE row_key % 3 WHEN 0 THEN 'fire' ELSE 'Size' END", s="'high'", i="'r' || row_key", w="row_key % 5 > 0").replace("row_key FROM", "1 AS side FROM") + ")", select="SELECT project_id, category, severity, openings[1] AS opening, issue, 'Open' AS status FROM (SELECT *, row_number() OVER (PARTITION BY project_id, lower(trim(category)), lower(severity), openings[1] ORDER BY side, issue) AS nth FROM both_) WHERE nth = 1"))
def u8_signed_findings(spark, sf_dir):
    doors = views.doors(spark, sf_dir)
    row = lambda fire, size, severity, lead: [F.when(F.col("row_key") % 3 == 0, fire).otherwise(size).alias("category"), F.lit(severity).alias("severity"), F.array("door_number").alias("openings"), F.concat(F.lit(lead), "row_key").alias("issue")]
    ours = doors.where("row_key % 2 = 0").select("project_id", *row("Fire ", "size", "HIGH", "m"))
    theirs = doors.where("row_key % 5 > 0").select("project_id", *row("fire", "Size", "high", "r"))
    return merge.signed_findings(ours, theirs).select("project_id", "category", "severity", F.col("openings")[0].alias("opening"), "issue", "status")


@query(O.chain(*O._ALL, select="SELECT project_id, hardware_set, 'found' AS status, 1.0::DOUBLE AS confidence, CAST(coalesce(len(items), 0) AS INT) AS n_items FROM sets_ UNION ALL SELECT DISTINCT project_id, set_label, 'missing', 0.3::DOUBLE, 0 FROM found WHERE set_label <> '' AND NOT EXISTS (SELECT 1 FROM sets_ WHERE sets_.project_id = found.project_id AND hardware_set = set_label)"))
def j14_with_missing_sets(spark, sf_dir):
    from lintel.plans import queries

    sets = queries._sets(spark, sf_dir)
    held = sets.select("project_id", "hardware_set", F.lit("found").alias("status"), F.lit(1.0).alias("confidence"), "n_items")
    return merge.with_missing_sets(held, queries._resolved(spark, sf_dir, sets).select("project_id", F.col("set_label").alias("hardware_set")))


@query(O.chain(O.COMPONENTS, select="""SELECT row_key, hardware_set_id, side FROM (SELECT *, row_number() OVER (PARTITION BY upper(trim(hardware_set_id)) ORDER BY side, row_key) AS nth FROM (SELECT row_key, lower(hardware_set_id) AS hardware_set_id, 1 AS side FROM parts WHERE row_key % 3 > 0
  UNION ALL SELECT row_key, hardware_set_id, 0 FROM parts WHERE row_key % 3 = 0)) WHERE nth = 1"""))
def r23_merged_runs(spark, sf_dir):
    """The sets of two runs as one: a third of the components is the first run's, the rest, in lower case, the second's."""
    parts = views.components(spark, sf_dir)
    side = F.when(F.col("row_key") % 3 == 0, 0).otherwise(1)
    rows = parts.select(side.alias("side"), "row_key", F.when(side == 0, F.col("hardware_set_id")).otherwise(F.lower("hardware_set_id")).alias("hardware_set"))
    doors = views.doors(spark, sf_dir).select(F.lit(0).alias("side"), "row_key", F.col("door_number").alias("mark"))
    return merge.merged_runs(doors, rows)[1].select("row_key", F.col("hardware_set").alias("hardware_set_id"), "side")


@query("SELECT page_id, y, x, mark FROM (SELECT *, row_number() OVER (PARTITION BY page_id, round_even(y / 8, 0), mark ORDER BY y, x) AS nth FROM (SELECT event_id // 200 AS page_id, CAST(event_id % 23 * 5 AS DOUBLE) AS y, CAST(event_id AS DOUBLE) AS x, 'D' || event_id % 7 AS mark FROM events)) WHERE nth = 1")
def w16_near_rows(spark, sf_dir):
    k = F.col("event_id")
    items = views.table(spark, sf_dir, "events").select(F.floor(k / 200).alias("page_id"), (k % 23 * 5).cast("double").alias("y"), k.cast("double").alias("x"), F.concat(F.lit("D"), k % 7).alias("mark"))
    return merge.distinct_near_rows(items)


@query("""WITH i AS (SELECT event_id // 200 AS page_id, CAST(event_id % 37 * 3 AS DOUBLE) AS x, CAST(event_id * 7 % 200 AS DOUBLE) AS y, event_id FROM events)
SELECT r.page_id, r.event_id AS row_id, coalesce(string_agg(CAST(i.event_id AS VARCHAR), ' ' ORDER BY i.x, CAST(i.event_id AS VARCHAR)) FILTER (i.x >= 0 AND i.x < 30), '') AS room, coalesce(string_agg(CAST(i.event_id AS VARCHAR), ' ' ORDER BY i.x, CAST(i.event_id AS VARCHAR)) FILTER (i.x >= 30 AND i.x < 80), '') AS size
FROM i r JOIN i ON r.page_id = i.page_id AND abs(i.y - r.y) <= 10 WHERE r.event_id % 20 = 0 GROUP BY ALL""")
def j28_bands(spark, sf_dir):
    """What stands beside every twentieth item, which is taken as a row's mark."""
    k = F.col("event_id")
    items = views.table(spark, sf_dir, "events").select(F.floor(k / 200).alias("page_id"), (k % 37 * 3).cast("double").alias("x"), (k * 7 % 200).cast("double").alias("y"), k.cast("string").alias("text"), k.alias("row_id"))
    return merge.in_bands(items.where("row_id % 20 = 0").select("page_id", "row_id", "y"), items.drop("row_id"), {"room": (F.lit(0), F.lit(30)), "size": (F.lit(30), F.lit(80))})


@query(O.chain(O.DOORS, O.COMPONENTS, select="SELECT d.source_file, count(*) AS doors, coalesce(any_value(n), 0) AS hardware FROM doors d LEFT JOIN (SELECT CASE row_key % 3 WHEN 0 THEN 'Door Schedule.pdf' WHEN 1 THEN 'Division 8 HARDWARE.pdf' END AS source_file, count(*) AS n FROM parts GROUP BY 1) USING (source_file) GROUP BY 1"))
def j21_project_stats(spark, sf_dir):
    """Counts of components beside each file's doors."""
    named = F.when(F.col("row_key") % 3 == 0, "Door Schedule.pdf").when(F.col("row_key") % 3 == 1, "Division 8 HARDWARE.pdf")
    stats = views.components(spark, sf_dir).groupBy(named.alias("source_file")).agg(F.count("*").alias("hardware"))
    report = views.doors(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("doors"))
    return report.join(stats, "source_file", "left").fillna(0, ["hardware"])


@query(O.chain(O.DOORS, select="SELECT project_id, door_number, row_key, 'x.pdf' AS source_file, 'DIRECT_PDF' AS page_type, 'openai_direct_pdf' AS source_method, 0.72::DOUBLE AS source_confidence, 'x.pdf#direct-pdf' AS source_location, CASE WHEN row_key % 2 = 0 THEN 'direct_pdf_added' ELSE 'direct_pdf_confirmed' END AS verification_flags, CASE WHEN row_key % 2 = 0 THEN 'direct_pdf_added' ELSE 'direct_pdf_confirmed' END AS hybrid_decision FROM doors"))
def p39_tagged_witness(spark, sf_dir):
    rows = views.doors(spark, sf_dir).select("project_id", "door_number", "row_key")
    return summaries.tagged_witness(rows, F.lit("x.pdf"), F.col("project_id"), F.when(F.col("row_key") % 2 == 0, "direct_pdf_added").otherwise("direct_pdf_confirmed"))


@query(O.chain(O.COMPONENTS, O.SETS, select="SELECT project_id, hardware_set AS id, coalesce(CASE WHEN length(set_key) = 1 THEN 'note ' || set_key END, hardware_set) AS name, CAST(coalesce(len(items), 0) AS INT) AS n_items, coalesce(list_sum(list_transform(items, lambda i: CASE WHEN coalesce(TRY_CAST(i.qty AS DOUBLE), 0) = 0 THEN 1.0 ELSE TRY_CAST(i.qty AS DOUBLE) END)), 0)::DOUBLE AS qty FROM sets_"))
def p44_legacy_sets(spark, sf_dir):
    items = mapping.set_items(views.components(spark, sf_dir))
    sets = mapping.set_table(views.components(spark, sf_dir), items).withColumn("estimator_note", F.when(F.length("set_key") == 1, F.concat(F.lit("note "), "set_key")))
    return summaries.legacy_sets(sets, items).select("project_id", "id", "name", F.size("items").alias("n_items"), F.aggregate("items", F.lit(0.0), lambda a, i: a + i["qty"]).alias("qty"))


@query("""SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'P-' || o_orderkey END, substr('run_' || o_orderkey, 1, 8)) AS id, coalesce(nullif(CASE WHEN o_custkey % 3 > 0 THEN CASE o_custkey % 3 WHEN 1 THEN '' ELSE 'a ' || o_orderstatus END END, ''), 'user ' || o_custkey) AS client, CAST(coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 40 END, 7) AS INT) AS doors,
  CASE WHEN o_orderstatus = 'F' THEN 'In Review' ELSE 'Draft' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'REVIEW_REQUIRED' ELSE 'OK' END AS extraction_status, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS date FROM orders""")
def p45_proposal_index(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = _orders(spark, sf_dir).select(
        F.when(k % 4 == 0, F.concat(F.lit("P-"), k)).alias("proposal_id"), F.concat(F.lit("run_"), k).alias("run_id"), F.when(c % 3 == 1, "").when(c % 3 == 2, F.concat(F.lit("a "), "o_orderstatus")).alias("architect"),
        F.concat(F.lit("user "), c).alias("user_email"), F.when(c % 2 == 0, (c % 40).cast("int")).alias("door_count"), F.lit(7).alias("openings_found"), F.when(F.col("o_orderstatus") == "F", "review_required").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"),
    )
    return summaries.proposal_index(runs)


@query(O.chain(O.COMPONENTS, select="SELECT 'HW-' || hardware_set_id AS set, catalog_number AS part, description, CAST(row_key % 4 AS INT) AS qty, CAST(row_key % 7 AS INT) AS n_sets, CAST(row_key % 4 * (row_key % 7) AS INT) AS total_qty, CAST(coalesce(CASE WHEN row_key % 5 > 0 THEN CAST(price AS DECIMAL(12, 2)) END, 0) * (row_key % 4 * (row_key % 7)) AS DOUBLE) AS extended FROM parts"))
def k11_extended_lines(spark, sf_dir):
    k = F.col("row_key")
    item = F.struct(F.col("catalog_number").alias("part"), F.col("description").alias("desc"), (k % 4).cast("int").alias("qty"), F.when(k % 5 > 0, F.col("price").cast("decimal(12,2)")).alias("price"))
    lines = views.components(spark, sf_dir).select(F.col("hardware_set_id").alias("set_id"), (k % 7).cast("int").alias("n_sets"), item.alias("item"))
    return summaries.extended_lines(lines).withColumn("extended", F.col("extended").cast("double"))


@query(O.chain(O.COMPONENTS, select="SELECT 'labour' AS sheet, description, row_key FROM parts WHERE row_key % 3 > 0 UNION ALL SELECT 'supply', 'No items', NULL"))
def k4_proposal_sheets(spark, sf_dir):
    lines = views.components(spark, sf_dir).select("description", "row_key", (F.col("row_key") % 3).alias("install_time_mins"), F.lit(0.0).alias("unit_price"))
    sheets = [x.select(F.lit(n).alias("sheet"), "description", "row_key") for n, x in summaries.proposal_sheets(lines).items()]
    return sheets[0].unionByName(sheets[1])


@query("SELECT event_id, user_id FROM events WHERE event_id % 9 > 0 AND (SELECT max(ts) FROM events) < ts + INTERVAL 14 DAY")
def m3_live_sessions(spark, sf_dir):
    sessions = views.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("issued_at"), F.when(F.col("event_id") % 9 == 0, True).alias("revoked"))
    now = sessions.agg(F.max("issued_at").alias("now"))  # one row
    return summaries.live_sessions(sessions.join(F.broadcast(now)), F.col("now")).select("event_id", "user_id")


@query(O.chain(O.DOORS, select=f"SELECT * FROM doors WHERE NOT (contains(lower({O.txt('source_file')}), 'proposal') OR {O.has(f'lower({O.txt("source_file")})', '^p[0-9]{2,}[_-]')})").replace("FROM doors WHERE", "FROM (SELECT * REPLACE (CASE row_key % 5 WHEN 0 THEN 'P26_0' || row_key || '.pdf' WHEN 1 THEN 'Proposal.pdf' ELSE source_file END AS source_file) FROM doors) WHERE").replace("SELECT * FROM (", "SELECT project_id, door_number, row_key, source_file FROM ("))
def f7_schedule_doors(spark, sf_dir):
    doors = views.doors(spark, sf_dir).withColumn("source_file", F.when(F.col("row_key") % 5 == 0, F.concat(F.lit("P26_0"), "row_key", F.lit(".pdf"))).when(F.col("row_key") % 5 == 1, "Proposal.pdf").otherwise(F.col("source_file")))
    return gates.schedule_doors(doors).select("project_id", "door_number", "row_key", "source_file")




@query(O.chain(O.DOORS, O.COMPONENTS, f"""n AS (SELECT DISTINCT project_id, {O.set_key('hardware_set')} AS key FROM doors WHERE coalesce({O.set_key('hardware_set')}, '') <> ''),
h AS (SELECT project_id, {O.set_key('hardware_set_id')} AS key, row_key % 3 AS n_items, row_key % 4 > 0 AS active FROM parts),
o AS (SELECT project_id, count(*) AS named, count(*) FILTER (coalesce(most, 0) = 0) AS e FROM n LEFT JOIN (SELECT project_id, key, max(n_items) AS most FROM h GROUP BY ALL) USING (project_id, key) GROUP BY 1),
t AS (SELECT project_id, sum(n_items) AS items, count(*) FILTER (active) AS active, count(*) FILTER (active AND n_items <= 1) AS single FROM h GROUP BY 1)""", select="""SELECT project_id, (e > 0 AND items = 0) OR (named >= 3 AND items < greatest(4, named // 2)) OR (named >= 5 AND active > 0 AND items <= active * 2 AND single >= greatest(3, active // 2)) OR (e > 0 AND named >= 3) AS needs_rescue
  FROM (SELECT project_id, named, e, coalesce(items, 0) AS items, coalesce(active, 0) AS active, coalesce(single, 0) AS single FROM o LEFT JOIN t USING (project_id))"""))
def f19_incomplete_sets(spark, sf_dir):
    sets = views.components(spark, sf_dir).select("project_id", F.col("hardware_set_id").alias("hardware_set"), (F.col("row_key") % 3).alias("n_items"), F.when(F.col("row_key") % 4 == 0, "Voided").alias("status"))
    return gates.incomplete_sets(views.doors(spark, sf_dir), sets, "project_id")


@query("""WITH d AS (SELECT k - k % 4 AS doc_id, count(*) AS n, count(*) FILTER (l_partkey % 3 > 0) AS missing FROM (SELECT l_partkey, l_orderkey % (SELECT count(*) FROM documents) AS k FROM lineitem) GROUP BY 1)
SELECT doc_id, (n = 0 AND (short OR keyed)) OR (n >= 3 AND missing >= greatest(3, n // 2) AND (short OR named)) AS needs_rescue FROM (SELECT doc_id, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 200 AS short,
  contains(upper(coalesce(text, '')), 'DOOR SCHED') OR contains(upper(coalesce(text, '')), 'OPENING LIST') AS keyed, contains(upper(coalesce(text, '')), 'HARDWARE SET') OR contains(upper(coalesce(text, '')), 'HW SET') OR contains(upper(coalesce(text, '')), 'HARDWARE GROUP') OR contains(upper(coalesce(text, '')), 'HDWR SET') AS named
  FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' door schedule hw set' ELSE text END AS text FROM documents) LEFT JOIN d USING (doc_id))""")
def f20_missing_fields(spark, sf_dir):
    """Every line is a door of one document in four; a third of the documents say that they are schedules."""
    files = views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" door schedule hw set"))).otherwise(F.col("text")).alias("text"))
    n = files.agg(F.count("*").alias("n"))  # one row
    key = F.col("l_orderkey") % F.col("n")
    doors = views.table(spark, sf_dir, "lineitem").join(F.broadcast(n)).select((key - key % 4).alias("doc_id"), F.when(F.col("l_partkey") % 3 == 0, "4").otherwise("").alias("hardware_set"))
    return gates.missing_fields(files, doors, "doc_id")


@query(O.chain(O.DOORS, O.COMPONENTS, f"""f AS (SELECT DISTINCT project_id FROM doors UNION SELECT 'project_none'), d AS (SELECT project_id, count(*) AS doors, count(*) FILTER (row_key % 3 = 0) AS listed, count(*) FILTER (upper({O.txt('door_width')}) IN ({O.listed(V.BLANK)}) OR upper({O.txt('door_height')}) IN ({O.listed(V.BLANK)})) AS unsized FROM doors GROUP BY 1),
h AS (SELECT 'project_' || CAST(floor(sqrt(row_key)) AS BIGINT) AS project_id, count(*) AS parts, count(DISTINCT nullif({O.join_id('hardware_set_id', V.BLANK)}, '')) AS sets FROM parts GROUP BY 1)""", select="""SELECT project_id, (doors = 0 AND parts = 0) OR (NOT (doors > 0 AND parts >= 3 AND listed >= greatest(3, floor(doors * 0.8))) AND ((doors > 0 AND unsized / greatest(doors, 1) > 0.5) OR (parts > 0 AND parts < 3 AND sets <= 1))) AS wants_witness
  FROM (SELECT project_id, coalesce(doors, 0) AS doors, coalesce(listed, 0) AS listed, coalesce(unsized, 0) AS unsized, coalesce(parts, 0) AS parts, coalesce(sets, 0) AS sets FROM f LEFT JOIN d USING (project_id) LEFT JOIN h USING (project_id))"""))
def f21_witness_gate(spark, sf_dir):
    doors = views.doors(spark, sf_dir).withColumn("table_shape", F.when(F.col("row_key") % 3 == 0, "opening_list"))
    files = doors.select("project_id").distinct().union(spark.range(1).select(F.lit("project_none")))
    parts = views.components(spark, sf_dir).withColumn("project_id", F.concat(F.lit("project_"), F.floor(F.sqrt("row_key"))))  # from few parts to many
    return gates.wants_witness(files, doors, parts, "project_id", "rescue")


@query(f"""WITH t AS (SELECT l_orderkey AS table_id, CASE WHEN l_orderkey % 9 = 0 THEN list_transform(range(45), lambda i: 'ab') WHEN l_orderkey % 9 = 1 THEN ['a', 'b', ' c '] WHEN l_orderkey % 9 = 2 THEN ['(cid:12)(cid:7)', 'x'] WHEN l_orderkey % 9 = 3 THEN ['', '', NULL, '', ' ', '', '', 'word'] ELSE ['D' || l_partkey, l_returnflag, NULL] END AS cells FROM lineitem),
s AS (SELECT table_id, count(*) AS n, max(len(cells)) AS columns_, sum(len(cells)) AS total, sum(len(list_filter(cells, lambda c: trim(coalesce(c, '')) <> ''))) AS filled, sum(length(array_to_string(list_transform(cells, lambda c: trim(coalesce(c, ''))), ''))) AS chars, sum(len(regexp_extract_all(array_to_string(list_transform(cells, lambda c: trim(coalesce(c, ''))), ' '), '\\(cid:[0-9]+\\)'))) AS codes FROM t GROUP BY 1)
SELECT table_id, n >= 2 AND columns_ <= 40 AND NOT coalesce(total > 0 AND filled / total < 0.15, false) AND NOT coalesce(filled > 0 AND chars / filled < 1.5, false) AND NOT coalesce(chars > 0 AND codes * 5 / chars > 0.3, false) AS is_good FROM s""")
def f14_quality_tables(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") % 9
    texts = lambda *v: F.array(*(F.lit(x).cast("string") for x in v))
    cells = F.when(k == 0, F.array_repeat(F.lit("ab"), 45)).when(k == 1, texts("a", "b", " c ")).when(k == 2, texts("(cid:12)(cid:7)", "x")).when(k == 3, texts("", "", None, "", " ", "", "", "word")).otherwise(F.array(F.concat(F.lit("D"), "l_partkey"), "l_returnflag", F.lit(None).cast("string")))
    return gates.quality_tables(lines.select(F.col("l_orderkey").alias("table_id"), cells.alias("cells")))


@query(O.chain(O.DIRTY, select=f"""SELECT value, other, CASE WHEN h AND i THEN 9 WHEN h THEN 8 WHEN i AND contains(t, 'HARDWARE') THEN 7 WHEN {O.has('t', V.CROP_DOORS)} THEN 0 WHEN contains(s, 'DOOR HARDWARE') THEN 5 WHEN contains(s, 'HARDWARE SET') OR contains(s, 'HARDWARE SCHEDULE') OR contains(s, 'HDWR SET') OR contains(s, 'HW SET') THEN 4
  WHEN contains(t, 'HARDWARE SET DESCRIPTIONS') OR contains(t, 'DOOR HARDWARE') THEN 3 WHEN contains(t, 'HARDWARE SET') OR contains(t, 'HARDWARE SCHEDULE') OR contains(t, 'HW SET') THEN 2 ELSE 1 END AS priority, CASE WHEN contains(lower(s), 'column') THEN 0 WHEN contains(lower(s), 'upper-right') OR contains(lower(s), 'lower-right') THEN 1 ELSE 2 END AS repair_rank
  FROM (SELECT value, other, s, t, {O.has('t', V.CROP_SET)} AS h, {O.has('t', V.CROP_PARTS)} AS i FROM (SELECT value, other, upper(coalesce(other, '')) AS s, upper(coalesce(value, '') || ' ' || coalesce(other, '')) AS t FROM raw))"""))
def t4_crop_priority(spark, sf_dir):
    rows = views.dirty(spark, sf_dir)
    said = F.concat(F.coalesce("value", F.lit("")), F.lit(" "), F.coalesce("other", F.lit("")))
    return rows.select("value", "other", gates.crop_priority(F.col("other"), said).alias("priority"), gates.repair_rank(F.col("other")).alias("repair_rank"))


_GIVEN = {c: O.known(c) for c in ("door_number", "door_width", "door_type", "hardware_set", "fire_rating", "remarks", "extra")}


@query(O.chain(O.DIRTY, f"""rows_ AS (SELECT value AS door_number, other AS door_width, CASE WHEN length(other) % 3 = 0 THEN value END AS door_type, other AS hardware_set, CASE WHEN length(value) % 2 = 0 THEN other END AS fire_rating, CASE WHEN length(value) % 4 = 1 THEN value END AS remarks, CASE WHEN length(value) % 2 = 1 THEN value END AS extra FROM raw),
g AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _GIVEN.items())}, extra AS extra_raw, extra IS NOT NULL AS has_extra FROM rows_)""", select=f"""SELECT trim(door_number) AS door_number, door_width, coalesce(door_type, CASE WHEN has_extra THEN extra END) AS door_type,
  (SELECT CASE WHEN s NOT IN ('', '—', '-') THEN s END FROM (SELECT {O.strip(O.sub(O.strip('x'), '^(?:set|hs|hw|hdwr|#)\\s*', '', 'i'))} AS s FROM (SELECT nullif(CASE WHEN hardware_set IS NULL OR lower(hardware_set) IN ('', 'none', 'null', 'undefined', 'n/a') THEN '' ELSE {O.sub("trim(" + O.sub(O.strip('upper(hardware_set)'), '^(?:HW[.\\-\\s]*|HARDWARE[.\\-\\s]*|SET[.\\-\\s]*|GROUP[.\\-\\s]*)', '', '') + ", '. -')", '^([0-9]+)[.]0$', '\\1', '')} END, '') AS x))) AS hardware_set,
  CASE WHEN {O.strip('coalesce(fire_rating, CASE WHEN has_extra THEN extra END)')} NOT IN ({O.listed(V.NO_FIRE_RATING)}) THEN {O.strip('coalesce(fire_rating, CASE WHEN has_extra THEN extra END)')} END AS fire_rating, remarks, coalesce({O.pair('door_width', 'door_type')}, false) AS is_pair, CASE WHEN has_extra THEN extra END AS note
  FROM g WHERE coalesce(trim(door_number), '') <> '' AND {O.door_mark('trim(door_number)')} AND upper(trim(door_number)) NOT IN ({O.listed(V.DOOR_HEADINGS)})"""))
def p13_validated_doors(spark, sf_dir):
    v, o = F.col("value"), F.col("other")
    extra = F.when(F.length(v) % 2 == 1, F.create_map(F.lit("door_type"), v, F.lit("fire_rating"), v, F.lit("door_width"), v, F.lit("note"), v))
    rows = views.dirty(spark, sf_dir).select(
        v.alias("door_number"), o.alias("door_width"), F.when(F.length(o) % 3 == 0, v).alias("door_type"), o.alias("hardware_set"), F.when(F.length(v) % 2 == 0, o).alias("fire_rating"), F.when(F.length(v) % 4 == 1, v).alias("remarks"), extra.alias("extra_fields"),
    )
    found = validate.validated_doors(rows)
    return found.select("door_number", "door_width", "door_type", "hardware_set", "fire_rating", "remarks", "is_pair", F.col("extra_fields")["note"].alias("note"))


_P14 = {c: f"coalesce({O.known(c)}, '')" for c in ("description", "catalog_number", "manufacturer_code")}
_HW = f"CASE WHEN hardware_set_id IS NULL OR lower(hardware_set_id) IN ('', 'none', 'null', 'undefined', 'n/a') THEN '' ELSE {O.sub('trim(' + O.sub(O.strip('upper(hardware_set_id)'), '^(?:HW[.\\-\\s]*|HARDWARE[.\\-\\s]*|SET[.\\-\\s]*|GROUP[.\\-\\s]*)', '', '') + ', chr(46) || chr(32) || chr(45))', '^([0-9]+)[.]0$', '\\1', '')} END"


@query(O.chain(O.COMPONENTS, f"c0 AS (SELECT row_key, {_HW} AS hardware_set_id, description, catalog_number, manufacturer_code, notes, qty_raw, unit FROM parts)", f"c1 AS (SELECT * FROM c0 WHERE (hardware_set_id <> '' OR coalesce({O.known('description')}, '') <> '') AND upper(coalesce({O.known('description')}, '')) NOT IN ({O.listed(V.COMPONENT_HEADINGS)}) AND {O.component(O.FIELDS)})", select=f"""SELECT row_key, CASE WHEN s = '' THEN '?' ELSE s END AS hardware_set_id, {O.quantity(O.known('qty_raw'))} AS qty, {O.known('qty_raw')} AS qty_raw, {O.unit('(' + O.known('unit') + ')')} AS unit, description
  FROM (SELECT *, {O.sub(O.strip(O.sub(O.txt('hardware_set_id'), '^(?:set|hs|hw|hdwr|group|#|no[.]?)\\s*', '', 'i')), '^([0-9]+)[.]0$', '\\1', '')} AS s FROM c1)"""))
def p14_validated_components(spark, sf_dir):
    rows = views.components(spark, sf_dir).withColumn("qty", F.col("qty_raw"))
    return validate.validated_components(rows, "row_key").select("row_key", "hardware_set_id", "qty", "qty_raw", "unit", "description")


@query(O.chain(O.DOORS, "x AS (SELECT project_id, door_number, door_type, hardware_set, CASE WHEN row_key % 2 = 0 THEN 'n' || row_key END AS note, CASE WHEN row_key % 3 = 0 THEN 's' END AS swing FROM doors)", select="SELECT note, door_number, swing, project_id, door_type, hardware_set FROM x"))
def p31_flattened(spark, sf_dir):
    k = F.col("row_key")
    entries = F.array_compact(F.array(F.when(k % 2 == 0, F.struct(F.lit("note"), F.concat(F.lit("n"), k))), F.when(k % 3 == 0, F.struct(F.lit("swing"), F.lit("s")))))
    rows = views.doors(spark, sf_dir).select("project_id", "door_number", "door_type", "hardware_set", F.map_from_entries(entries).alias("extra_fields"))
    return validate.reordered(validate.flattened(rows, ["note", "swing", "door_type"]), ["note", "colour", "door_number", "swing"])


@query(O.chain(O.DOORS, f"""m AS (SELECT project_id, CASE row_key % 9 WHEN 0 THEN 'HINGE 4' WHEN 1 THEN 'MARK' WHEN 2 THEN 'A' WHEN 3 THEN 'Lobby' ELSE door_number END AS mark, CASE WHEN row_key % 4 = 1 THEN level_area END AS room, CASE row_key % 7 WHEN 0 THEN '4 1/2"' WHEN 1 THEN '' ELSE door_width END AS width, door_height AS height, door_type, door_material, frame_type, hardware_set, fire_rating, remarks, row_key FROM doors)""", select=f"""SELECT row_key, {O.txt('mark')} AS mark, nullif(width, '') AS width, {O.has("concat_ws(' ', remarks, door_material, door_type, room)", r"existing[\s_-]*to[\s_-]*remain|\bETR\b|e\.t\.r\.", "i")} AS existing_to_remain, CASE WHEN row_key % 2 = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence
  FROM m WHERE upper({O.txt('mark')}) NOT IN ({O.listed(V.NO_MARK)}) AND NOT {O.contains_any(f"upper({O.txt('mark')})", V.COMPONENT_ROWS)} AND length({O.txt('mark')}) <= 15 AND upper({O.txt('mark')}) NOT IN ({O.listed(V.ROOM_MARKS)}) AND NOT coalesce(width = '4 1/2"', false)
  AND NOT ({O.txt('room')} = '' AND {O.txt('width')} = '' AND {O.txt('height')} = '' AND ({O.has(f"upper({O.txt('mark')})", '^[A-Z]$')} OR concat({O.txt('door_material')}, {O.txt('door_type')}, {O.txt('frame_type')}, {O.txt('hardware_set')}, {O.txt('fire_rating')}, {O.txt('remarks')}) = ''))"""))
def p26_canonical_doors(spark, sf_dir):
    k = F.col("row_key")
    mark = F.when(k % 9 == 0, "HINGE 4").when(k % 9 == 1, "MARK").when(k % 9 == 2, "A").when(k % 9 == 3, "Lobby").otherwise(F.col("door_number"))
    rows = views.doors(spark, sf_dir).select(
        mark.alias("mark"), F.when(k % 4 == 1, F.col("level_area")).alias("room_or_location"), F.when(k % 7 == 0, '4 1/2"').when(k % 7 == 1, "").otherwise(F.col("door_width")).alias("width"), F.col("door_height").alias("height"),
        "door_type", "door_material", "frame_type", F.lit(None).cast("string").alias("frame_material"), "hardware_set", "fire_rating", "remarks", "row_key", F.when(k % 2 == 0, 0.9).alias("confidence"),
    )
    return gates.canonical_doors(rows).select("row_key", "mark", "size.width", "existing_to_remain", "confidence")


@query(O.chain(O.DIRTY, "r AS (SELECT value, other, CASE WHEN length(value) % 3 = 0 THEN 'tile_rotated_door_schedule_cw' ELSE 'x' END AS source, upper(coalesce(CASE WHEN length(value) % 5 > 0 THEN coalesce(other, '') || ' [' || coalesce(value, '') || '] door schedule mark width' END, '')) AS said FROM raw)", select=rf"""SELECT value, other, CASE WHEN said <> '' AND {O.has(f'upper({O.txt("other")})', V.TYPE_LABEL)} THEN NULL ELSE other END AS hardware_set FROM (SELECT *, upper({O.txt('value')}) AS m FROM r) WHERE said = '' OR (m <> '' AND NOT {O.has('m', V.TYPE_LABEL)} AND (contains(source, 'rotated') OR true))"""))
def f13_visible_rows(spark, sf_dir):
    """Marks that stand in their crop's text, as all of these do that have a text."""
    v, o = F.col("value"), F.col("other")
    said = F.when(F.length(v) % 5 > 0, F.concat(F.coalesce(o, F.lit("")), F.lit(" ["), F.coalesce(v, F.lit("")), F.lit("] door schedule mark width")))
    rows = views.dirty(spark, sf_dir).select(v, o, v.alias("door_number"), o.alias("hardware_set"), F.when(F.length(v) % 3 == 0, "tile_rotated_door_schedule_cw").otherwise("x").alias("source"), said.alias("search"))
    return gates.visible_rows(rows).select("value", "other", "hardware_set")


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' SET #12A hw 7 Hardware Set No. 3' ELSE ' door 1204B' END AS text FROM documents)
SELECT doc_id, CAST(length(text) AS INT) AS total_chars, length(trim(text, {O.WS})) < 300 AS is_scanned, coalesce((SELECT string_agg(DISTINCT d, ',' ORDER BY d) FROM (SELECT unnest(regexp_extract_all(text, '\\b([0-9]{{3,4}}[A-Za-z]?)\\b', 1)) AS d) WHERE CAST(regexp_extract(d, '^([0-9]+)', 1) AS INT) >= 100 AND CAST(regexp_extract(d, '^([0-9]+)', 1) AS INT) NOT BETWEEN 1900 AND 2099), '') AS door_numbers,
  coalesce((SELECT string_agg(DISTINCT upper(d), ',' ORDER BY upper(d)) FROM (SELECT unnest(list_concat({', '.join(f"regexp_extract_all(text, {O.text(p)}, 1)" for p in V.TRUTH_SETS[:2])}, regexp_extract_all(text, {O.text(V.TRUTH_SETS[2])}, 1))) AS d)), '') AS set_ids FROM t""")
def s21_ground_truth(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " SET #12A hw 7 Hardware Set No. 3").otherwise(" door 1204B"))
    return docs.select("doc_id", summaries.ground_truth(text).alias("t")).select("doc_id", "t.*")


_ROOM = "CASE row_key % 11 WHEN 0 THEN 'STAIR 2' WHEN 1 THEN 'exit to exterior' WHEN 2 THEN 'SERVER room' WHEN 3 THEN 'KP lobby' ELSE level_area END"
_SAID = "CASE row_key % 13 WHEN 0 THEN 'STC 50, AO' WHEN 1 THEN 'exit device pair' WHEN 2 THEN 'relocate' ELSE remarks END"
_USUAL = "concat_ws(' ', said, door_type, room)"
_FIRE18 = f"coalesce(fire_rating, '') <> '' AND fire_rating <> '-' AND NOT {O.has('fire_rating', '^non|^n/a$', 'i')}"
_TESTS18 = {
    "Hardware mapping": "coalesce(set_label, '') = ''", "Hardware set definitions": "coalesce(set_label, '') <> '' AND coalesce(n_items, 0) = 0", "Fire-rated openings": _FIRE18, "Fire / smoke rating": _FIRE18,
    "Stair enclosures": f"{_FIRE18} AND {O.has(_USUAL, V.STAIR_WORDS)}", "Exterior / weather": f"row_key % 17 = 0 OR {O.has("concat_ws(' ', room, said)", V.EXTERIOR_WORDS)}",
    "Access control / electrified": f"{O.has(_USUAL, V.ELECTRIFIED_WORDS)} OR (project_no % 3 = 0 AND {O.has(_USUAL, '(?i)' + chr(92) + 'bKP' + chr(92) + 'b')})", "ADA / automatic operators": O.has(_USUAL, V.OPERATOR_WORDS), "Egress / exit devices": O.has(_USUAL, V.PANIC_WORDS),
    "Pair / double-leaf openings": O.has("concat_ws(' ', said, door_type)", V.PAIR_OPENINGS), "High-security openings": O.has(_USUAL, V.SECURITY_WORDS), "Acoustic / STC-rated": O.has(_USUAL, V.ACOUSTIC_WORDS), "Existing conditions": O.has(_USUAL, V.EXISTING_WORDS),
    "Glazing / vision lites": "row_key % 6 = 1", "Schedule legibility": "row_key % 10 < 6", "Schedule completeness": "coalesce(door_width, '') = '' OR coalesce(door_height, '') = ''",
}
_HELD18 = " UNION ALL ".join(f"SELECT project_id, project_no, door_number AS mark, {O.text(k)} AS family FROM d18 WHERE {v}" for k, v in _TESTS18.items())
_KINDS18 = ", ".join(f"({O.text(k)}, '{kind}', '{s}')" for k, pair in V.FAMILIES.items() for kind, s in zip(("risk", "rfi"), pair) if s)


@query(O.chain(O.DOORS, O.COMPONENTS, f"""s18 AS (SELECT project_id, {O.join_id('hardware_set_id', V.BLANK)} AS set_label, max(row_key % 3) AS n_items, bool_or(row_key % 23 = 0) AS voided FROM parts GROUP BY ALL),
d18 AS (SELECT doors.*, {_ROOM} AS room, {_SAID} AS said, {O.join_id('hardware_set', V.BLANK)} AS set_label, n_items, CAST(substr(doors.project_id, 9) AS INT) AS project_no FROM doors LEFT JOIN s18 ON doors.project_id = s18.project_id AND {O.join_id('hardware_set', V.BLANK)} = s18.set_label),
h18 AS ({_HELD18}), c18 AS (SELECT project_id, any_value(project_no) AS project_no, count(*) AS doors FROM d18 GROUP BY 1),
f18 AS (SELECT project_id, family, count(*) AS n, list_sort(list(mark))[1:8] AS head FROM h18 GROUP BY ALL UNION ALL SELECT project_id, 'Voided hardware set', count(*), [] FROM s18 WHERE voided GROUP BY 1 UNION ALL SELECT project_id, 'Submittal / lead time', 0, [] FROM c18 UNION ALL SELECT project_id, 'Keying / cylinders', 0, [] FROM c18 WHERE doors >= 5)""",
    select=f"""SELECT f.project_id, k.kind, k.severity, family AS category, n, array_to_string(head, ', ') || CASE WHEN n > len(head) AND len(head) > 0 THEN ', ...+' || (n - len(head)) || ' more' ELSE '' END AS openings FROM f18 f JOIN c18 c USING (project_id) JOIN (VALUES {_KINDS18}) k(f_, kind, severity) ON f.family = k.f_
  WHERE NOT (family = 'Schedule completeness' AND n >= doors) AND NOT (family = 'Keying / cylinders' AND project_no % 2 = 0) AND NOT (family = 'Access control / electrified' AND k.kind = 'rfi' AND project_no % 4 = 0)"""))
def r18_browser_findings(spark, sf_dir):
    k, none = F.col("row_key"), F.lit(None).cast("string")
    room = F.when(k % 11 == 0, "STAIR 2").when(k % 11 == 1, "exit to exterior").when(k % 11 == 2, "SERVER room").when(k % 11 == 3, "KP lobby").otherwise(F.col("level_area"))
    said = F.when(k % 13 == 0, "STC 50, AO").when(k % 13 == 1, "exit device pair").when(k % 13 == 2, "relocate").otherwise(F.col("remarks"))
    doors = with_distinct(views.doors(spark, sf_dir), ["hardware_set"], set_label=N.join_id(F.col("hardware_set"))).select(
        "project_id", F.col("door_number").alias("mark"), "set_label", "fire_rating", "door_type", none.alias("opening_type"), room.alias("room_or_location"), said.alias("remarks"), F.when(k % 17 == 0, "Exterior").alias("interior_or_exterior"),
        F.when(k % 6 == 1, "tempered").when(k % 6 == 2, "none").alias("glazing"), ((k % 10) / 10).alias("confidence"), F.col("door_width").alias("width"), F.col("door_height").alias("height"),
    )
    sets = views.components(spark, sf_dir).select("project_id", N.join_id(F.col("hardware_set_id")).alias("set_label"), F.array_repeat(F.lit(1), (k % 3).cast("int")).alias("items"), F.when(k % 23 == 0, "crossed out").alias("note"))
    number = F.substring("project_id", 9, 9).cast("int")
    texts = lambda test, x: F.when(test, F.array(F.lit(x)))
    context = rules.contexts(doors.select("project_id").distinct().select(
        "project_id", texts(number % 4 == 0, "EC to provide all 120 V power. Low-voltage cabling by others.").alias("general_notes"), texts(F.lit(False), "").alias("hardware_preamble"), texts(number % 2 == 0, "SFIC cores, restricted").alias("keying_notes"),
        F.when(number % 3 == 0, F.create_map(F.lit("KP"), F.lit("card reader"), F.lit("NO"), F.lit("normally open"))).alias("legend"),
    ))
    return rules.browser_findings(doors, sets, context)


@query(O.chain(O.DIRTY, select=f"SELECT value, other, concat_ws(';', 'a=' || {O.known('value')}, 'b=' || {O.known('other')}) AS result FROM raw"))
def p2_extra_fields(spark, sf_dir):
    clean = N.clean_extra_fields(F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("other")))
    entries = F.array_sort(F.transform(F.map_entries(clean), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return views.dirty(spark, sf_dir).withColumn("result", F.array_join(entries, ";"))


@query(O.chain(O.DIRTY, select="SELECT value, other, CASE WHEN coalesce(value, '') = '' THEN '0' ELSE '1' || value END AS result FROM raw"))
def p28_string_list(spark, sf_dir):
    listed = N.string_list(F.col("value"))
    return views.dirty(spark, sf_dir).withColumn("result", F.concat(F.size(listed).cast("string"), F.coalesce(F.get(listed, F.lit(0)), F.lit(""))))


@query(O.chain(O.DOORS, select=f"SELECT project_id, door_number, row_key, {' + '.join(f'(NOT {O.blank(c)})::INT' for c in ('door_width', 'door_height', 'door_type', 'fire_rating'))} AS filled FROM doors"))
def p40_filled_fields(spark, sf_dir):
    return views.doors(spark, sf_dir).select("project_id", "door_number", "row_key", N.filled_count(*(F.col(c) for c in ("door_width", "door_height", "door_type", "fire_rating"))).alias("filled"))


@query(O.chain(O.PAGES, select="SELECT page_id, CASE WHEN page_id % 2 = 0 THEN body ELSE replace(body, 'Z', chr(61530)) END AS body FROM bodies"))
def x2_private_text(spark, sf_dir):
    """Pages of which every other one is wholly in private-use code points, which are read, and the rest has one letter so, which stays."""
    plain, private = "".join(chr(i) for i in range(1, 256)), "".join(chr(0xF000 + i) for i in range(1, 256))
    body = F.when(F.col("page_id") % 2 == 0, F.translate("body", plain, private)).otherwise(F.translate("body", "Z", chr(0xF05A)))
    return views.page_texts(spark, sf_dir).select("page_id", G.unprivate(body).alias("body"))


@query(O.chain(O.PAGES, select=f"""SELECT page_id, coalesce(before IN ('door_schedule', 'hardware_set', 'mixed') AND NOT {O.has(O.strip('string_split(body, chr(10))[1]'), V.PAGE_HEADER)}, false) AS is_continuation
  FROM (SELECT *, lag(kind) OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS before FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'door_schedule' WHEN 1 THEN 'other' WHEN 2 THEN 'mixed' ELSE 'hardware_set' END AS kind FROM bodies))"""))
def x21_continuations(spark, sf_dir):
    k = F.col("page_id")
    kind = F.when(k % 4 == 0, "door_schedule").when(k % 4 == 1, "other").when(k % 4 == 2, "mixed").otherwise("hardware_set")
    pages = views.page_texts(spark, sf_dir).select(F.floor(k / 10).alias("file"), k.alias("page"), "page_id", kind.alias("page_type"), "body")
    return parse.continuation(pages).select("page_id", "is_continuation")


@query("""WITH t AS (SELECT l_orderkey AS table_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 10000000 + l_suppkey * 100 + CAST(floor(l_quantity) AS BIGINT) AS row_no, CASE WHEN l_partkey % 3 > 0 THEN 'D' || l_linenumber ELSE ' ' END AS first_, l_returnflag || l_linenumber AS rest FROM lineitem)
SELECT table_id, min(row_no) AS row_no, max(first_) AS first, string_agg(rest, ' ' ORDER BY row_no, rest) AS rest FROM (SELECT *, count(*) FILTER (trim(first_) <> '') OVER (PARTITION BY table_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS g FROM t) GROUP BY table_id, g""")
def w13_merged_rows(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.expr("l_linenumber * 1000000000000 + l_partkey * 10000000 + l_suppkey * 100 + cast(floor(l_quantity) as bigint)").alias("row_no"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("D"), n)).otherwise(" ").alias("first"), F.concat("l_returnflag", n).alias("rest"))
    return parse.merged_split_rows(rows)


@query(O.chain(O.RUNS, select="SELECT DISTINCT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM runs WHERE row_key % 5 = 0)"))
def f27_new_runs(spark, sf_dir):
    """Runs that no earlier list has; a fifth of the rows is that list."""
    runs = views.runs(spark, sf_dir)
    return runs.select("run_id").distinct().join(runs.where("row_key % 5 = 0").select("run_id").distinct(), "run_id", "left_anti")


@query(O.chain(O.COMPONENTS, O.GOOD, select=f"SELECT project_id, set_id, sum(q * p)::DOUBLE AS set_price FROM (SELECT project_id, {O.join_id('hardware_set_id', V.BLANK)} AS set_id, coalesce({O.quantity('qty_raw')}, 1) AS q, CAST(price AS DECIMAL(18, 2)) AS p FROM good) GROUP BY ALL"))
def a14_set_prices(spark, sf_dir):
    """The price of each set of a project: quantities, one if not given, times unit prices."""
    good = takeoff.plausible_components(views.components(spark, sf_dir))
    price = F.coalesce(N.quantity(F.col("qty_raw")), F.lit(1)) * F.col("price").cast("decimal(18,2)")
    return good.groupBy("project_id", N.join_id(F.col("hardware_set_id")).alias("set_id")).agg(F.sum(price).cast("double").alias("set_price"))


@query(O.chain(*O._ALL, select="SELECT DISTINCT found.project_id, set_label FROM found JOIN sets_ ON set_label = sets_.hardware_set AND found.project_id = sets_.project_id WHERE coalesce(len(items), 0) = 0"))
def j20_empty_references(spark, sf_dir):
    """Sets that doors of their project name and that have no items."""
    from lintel.plans import queries

    sets = queries._sets(spark, sf_dir)
    named = queries._resolved(spark, sf_dir, sets).select("project_id", "set_label").distinct()
    return named.join(sets.where("n_items = 0").select("project_id", F.col("hardware_set").alias("set_label")), ["project_id", "set_label"], "left_semi")


@query(O.chain(*O._ALL, select="SELECT project_id, set_label, n AS doors, item.desc AS description, item.part AS part, item.qty AS qty FROM (SELECT project_id, set_label, count(*) AS n FROM found WHERE set_label IS NOT NULL GROUP BY ALL) JOIN (SELECT project_id, hardware_set AS set_label, unnest(items) AS item FROM sets_) USING (project_id, set_label)"))
def j24_takeoff_lines(spark, sf_dir):
    """Each item of each set that doors of its project name, with the number of those doors."""
    from lintel.plans import queries

    items = queries._items(spark, sf_dir)
    sets = queries._sets(spark, sf_dir, items)
    place = ["project_id", "set_label"]
    named = queries._resolved(spark, sf_dir, sets).where("set_label is not null").groupBy(*place).agg(F.count("*").alias("doors"))
    labelled = sets.select("project_id", "set_key", F.col("hardware_set").alias("set_label")).join(items, ["project_id", "set_key"])
    return named.join(labelled, place).select(*place, "doors", F.col("desc").alias("description"), "part", "qty")


@query(O.chain(O.COMPONENTS, f"""i17 AS (SELECT {O.set_key('hardware_set_id')} AS set_key, description AS "desc", coalesce(catalog_number, '') AS part, coalesce(qty_raw, '') AS qty, row_key % 3 = 0 AS rescued, row_key FROM parts), o17 AS (SELECT DISTINCT set_key FROM i17 WHERE NOT rescued),
t17 AS (SELECT i17.*, o17.set_key IS NOT NULL AS known FROM i17 LEFT JOIN o17 USING (set_key)), k17 AS (SELECT *, row_number() OVER (PARTITION BY set_key, lower(trim("desc")), lower(trim(part)), lower(trim(qty)) ORDER BY rescued, row_key) AS nth FROM t17 WHERE NOT rescued OR known OR set_key IN ('1', '2', '3'))""",
    select="SELECT set_key, \"desc\", row_key, CASE WHEN rescued THEN 'rescued' ELSE 'ours' END AS origin FROM k17 WHERE NOT rescued OR nth = 1"))
def j17_merged_sets(spark, sf_dir):
    """A third of the components is the rescued side; sets that ours lack are taken for three ids."""
    none = F.lit(None).cast("string")
    items = views.components(spark, sf_dir).select(F.col("hardware_set_id").alias("hardware_set"), "row_key", F.col("qty_raw").alias("qty"), none.alias("unit"), F.col("description").alias("desc"), F.col("catalog_number").alias("part"), none.alias("mfr"), none.alias("finish"))
    allowed = spark.createDataFrame([("1",), ("Set 2",), ("HW-3",)], "hardware_set string")
    return merge.merged_sets(items.where("row_key % 3 > 0"), items.where("row_key % 3 = 0"), allowed).select("set_key", "desc", "row_key", "origin")


def _stored(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(O.chain(O.COMPONENTS, select="SELECT row_key, project_id, CASE WHEN row_key // 50 = 1 THEN 'new' ELSE 'old' END AS version FROM parts WHERE NOT (row_key // 50 = 1 AND row_key % 2 = 0)"))
def k3_replaced_projects(spark, sf_dir):
    """Estimations written, then those of one project replaced by half of its rows, and read again."""
    path, rows = _stored(spark, "estimations"), views.components(spark, sf_dir).select("row_key", "project_id")
    sinks.replace_projects(rows.withColumn("version", F.lit("old")), path)
    sinks.replace_projects(rows.where("row_key div 50 = 1 and row_key % 2 = 1").withColumn("version", F.lit("new")), path)
    return spark.read.parquet(path).select("row_key", "version", "project_id")


@query("""WITH r AS (SELECT 'run_' || o_orderkey AS run_id, * FROM orders), l AS (SELECT l_orderkey, l_partkey, (l_partkey * 100003 + l_suppkey) * 10 + l_linenumber AS k, l_suppkey % 3 AS s, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber),
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS no, row_number() OVER (PARTITION BY l_orderkey, s ORDER BY k) - 1 AS in_set, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY s) - 1 AS set_no FROM l)
SELECT run_id, 'logs' AS child, i AS no, CASE WHEN i % 3 = 0 THEN 'warn' ELSE 'info' END AS a, 'm' || i AS b FROM (SELECT run_id, unnest(range(least(o_custkey % 4, 2))) AS i FROM r)
UNION ALL SELECT 'run_' || l_orderkey, 'doors', no, 'D' || l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END FROM d
UNION ALL SELECT DISTINCT 'run_' || l_orderkey, 'sets', set_no, 'S' || s, 'found' FROM d
UNION ALL SELECT 'run_' || l_orderkey, 'items', set_no * 1000 + in_set, CAST(CAST(l_quantity AS INT) AS VARCHAR), CASE WHEN l_partkey % 4 = 0 THEN 'other ' ELSE 'item ' END || l_partkey FROM d
UNION ALL SELECT run_id, 'rfis', 0, CASE WHEN o_custkey % 2 = 0 THEN 'low' ELSE o_orderstatus END, CASE WHEN o_custkey % 3 = 0 THEN 'asked' ELSE 'issue ' || o_custkey END FROM r WHERE o_custkey % 5 > 0
UNION ALL SELECT run_id, 'audit', 0, 'runs.create', '{"source_filename":"plan ' || o_custkey || '.pdf"}' FROM r""")
def k5_run_logs(spark, sf_dir):
    """All child rows of runs with nested results, one run for each order, its lines as doors and as items of sets; two log rows kept."""
    order, none = F.col("l_orderkey"), F.lit(None).cast("string")
    lines = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_returnflag", "l_quantity", "l_discount")))
    lines = lines.withColumn("k", (F.col("l_partkey") * 100_003 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).withColumn("s", F.col("l_suppkey") % 3)
    door = F.struct("k", F.concat(F.lit("D"), "l_partkey").alias("mark"), F.concat(F.lit("S"), "s").alias("hardware_set"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("risk_level"), F.col("l_discount").cast("double").alias("confidence"))
    name = F.concat(F.lit("item "), "l_partkey")
    odd = F.col("l_partkey") % 4 == 0
    item = F.struct("k", none.alias("item_no"), F.col("l_quantity").cast("int").alias("qty"), F.when(~odd, name).otherwise("").alias("desc"), F.when(odd, F.concat(F.lit("other "), "l_partkey")).otherwise(name).alias("description"), none.alias("part"), none.alias("catalog_number"), none.alias("mfr"), none.alias("manufacturer"), none.alias("finish"))
    doors = lines.groupBy(order.alias("o_orderkey")).agg(F.array_sort(F.collect_list(door)).alias("doors"))
    held = lines.groupBy(order.alias("o_orderkey"), "s").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sets = held.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("s", F.concat(F.lit("S"), "s").alias("hardware_set"), F.lit("found").alias("status"), "items"))).alias("sets"))
    c = F.col("o_custkey")
    log = lambda i: F.struct(none.alias("kind"), F.when(i % 3 == 0, "warn").when(i % 3 == 1, "odd").otherwise("info").alias("level"), none.alias("stage"), F.lit("").alias("text"), F.concat(F.lit("m"), i).alias("message"))
    logs = F.when(c % 4 > 0, F.transform(F.sequence(F.lit(0), (c % 4 - 1).cast("int")), log))
    rfi = F.struct(F.when(c % 2 == 0, "low").alias("priority"), F.col("o_orderstatus").alias("severity"), none.alias("category"), F.when(c % 3 == 0, "asked").otherwise("").alias("question"), F.concat(F.lit("issue "), c).alias("issue"), none.alias("source"), none.alias("where"))
    runs = _orders(spark, sf_dir).join(doors, "o_orderkey", "left").join(sets, "o_orderkey", "left").select(
        F.concat(F.lit("run_"), "o_orderkey").alias("run_id"), F.concat(F.lit("plan "), c, F.lit(".pdf")).alias("source_filename"), logs.alias("logs"), "doors", "sets", F.when(c % 5 > 0, F.array(rfi)).alias("rfis"),
    )
    shown = {"logs": ("log_no", "level", "message"), "doors": ("door_no", "door_mark", "risk_level"), "sets": ("set_no", "hardware_set", "status"), "items": (F.col("set_no") * 1000 + F.col("at"), "qty", "description"), "rfis": ("rfi_no", "priority", "question"), "audit": (F.lit(0), "action", "payload")}
    col = lambda x: F.col(x) if isinstance(x, str) else x
    tables = sinks.run_children(runs, most=2)
    parts = [tables[n].select("run_id", F.lit(n).alias("child"), col(no).cast("long").alias("no"), F.col(a).alias("a"), F.col(b).alias("b")) for n, (no, a, b) in shown.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("SELECT event_id, event_type, n FROM events, (SELECT unnest([1, 2]) AS n)")
def k6_appended_log(spark, sf_dir):
    """Events appended twice to a log, and read again."""
    path, rows = _stored(spark, "log"), views.table(spark, sf_dir, "events").select("event_id", "event_type")
    for n in (1, 2):
        sinks.append_log(rows.withColumn("n", F.lit(n)), path)
    return spark.read.schema("event_id long, event_type string, n int").json(path)


@query(O.chain(O.DOORS, select="SELECT project_id, door_number, row_key FROM doors"))
def k8_witness_file(spark, sf_dir):
    """Witness rows written as JSON lines, and read again."""
    path = _stored(spark, "witness")
    sinks.write_witness(views.doors(spark, sf_dir).select("project_id", "door_number", "row_key"), path)
    return spark.read.schema("project_id string, door_number string, row_key long").json(path)


@query(O.chain(O.DOORS, O.COMPONENTS, select="SELECT 'doors' AS sheet, count(*) AS n, count(DISTINCT project_id) AS projects FROM doors UNION ALL SELECT 'components', count(*), count(DISTINCT project_id) FROM parts UNION ALL SELECT 'set csv', count(*), count(DISTINCT project_id) FROM parts"))
def k1_sheets(spark, sf_dir):
    """A workbook's sheets as datasets, the CSV set of those that have rows, and what each holds when read again."""
    folder, csv = _stored(spark, "sheets"), _stored(spark, "csv")
    doors, parts = views.doors(spark, sf_dir).select("project_id", "row_key"), views.components(spark, sf_dir).select("project_id", "row_key")
    sinks.write_sheets({"doors": doors, "components": parts}, folder)
    sinks.write_csv_sets({"components": parts, "none": parts.limit(0)}, csv)
    held = [("doors", spark.read.parquet(f"{folder}/doors")), ("components", spark.read.parquet(f"{folder}/components")), ("set csv", files.chunks(spark, f"{csv}/*"))]
    out = [x.agg(F.count("*").alias("n"), F.count_distinct("project_id").alias("projects")).select(F.lit(n).alias("sheet"), "n", "projects") for n, x in held]
    return out[0].union(out[1]).union(out[2])



@query("SELECT event_id AS answer_id, CAST(r AS INT) AS row_no, CASE r WHEN 0 THEN 'D' || user_id ELSE 'E' END AS mark FROM events, (SELECT unnest([0, 1]) AS r) WHERE event_id % 3 > 0 OR r = 0")
def r15_nested_rows(spark, sf_dir):
    """Rows of answers in three nestings: a list of objects under two keys, under one, and an object that is a row."""
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    row = F.concat(F.lit('{"mark": "D'), u, F.lit('"}'))
    two = F.concat(F.lit('[' ), row, F.lit(', {"mark": "E"}]'))
    text = F.when(k % 3 == 0, F.concat(F.lit('{"door": 1, "mark": "D'), u, F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('{"n": "x", "rows": '), two, F.lit("}"))).otherwise(F.concat(F.lit('{"Door Schedule": {"Doors": '), two, F.lit("}}")))
    rows = views.table(spark, sf_dir, "events").select(k.alias("answer_id"), F.posexplode(answers.found_rows(text)).alias("row_no", "row"))
    return rows.select("answer_id", "row_no", F.get_json_object("row", "$.mark").alias("mark"))


@query("SELECT event_id AS answer_id, CAST(r AS INT) AS row_no, CASE r WHEN 0 THEN 'D' || user_id ELSE 'E' END AS mark FROM events, (SELECT unnest([0, 1]) AS r) WHERE event_id % 2 = 0")
def r16_named_rows(spark, sf_dir):
    """Rows under a named key, which every other answer has, spelt its own way and nested."""
    two = F.concat(F.lit('[{"mark": "D'), F.col("user_id").cast("string"), F.lit('"}, {"mark": "E"}]'))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": {"Door Rows": '), two, F.lit("}}"))).otherwise(F.concat(F.lit('{"a": {"others": '), two, F.lit("}}")))
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("answer_id"), F.posexplode(answers.named_rows(text, ["doorrows"])).alias("row_no", "row"))
    return rows.select("answer_id", "row_no", F.get_json_object("row", "$.mark").alias("mark"))


@query("""WITH w AS (SELECT DISTINCT event_id // 200 AS p FROM events), l AS (SELECT p, 20 + p % 50 AS y, 100 + p % 30 AS n, CASE WHEN p % 3 = 0 THEN 300 + p % 7 END AS r, 600 + p % 20 AS s, CASE WHEN p % 4 > 0 THEN 800 + p % 10 END AS t FROM w
  UNION ALL SELECT p, 320 + p % 50, 90, CASE WHEN p % 5 = 0 THEN 250 END, 500, CASE WHEN p % 5 < 2 THEN 700 END FROM w)
SELECT p AS page_id, CAST(y AS INT) AS header_y, CAST(n AS INT) AS number_x, CAST(r AS VARCHAR) AS room_x, CAST(s AS INT) AS size_x, CAST(t AS INT) AS type_x FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY -((r IS NOT NULL)::INT + (t IS NOT NULL)::INT), y) AS nth FROM l WHERE r IS NOT NULL OR t IS NOT NULL) WHERE nth = 1""")
def t14_best_headers(spark, sf_dir):
    """The header line of each page: two lines of labels in places of their own, now the one and now the other with more of them."""
    pages = views.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 200).alias("page_id")).distinct()
    top = (F.lit(20) + F.col("page_id") % 50).cast("int")
    word = lambda dy, x, t: F.struct((top + dy).cast("int").alias("y"), x.cast("int").alias("x"), F.lit(t).alias("text"))
    p = F.col("page_id")
    when = lambda test, w: F.when(test, w)
    words = [
        word(0, 100 + p % 30, "NUMBER"), when(p % 3 == 0, word(0, 300 + p % 7, "ROOM")), word(0, 600 + p % 20, "SIZE"), when(p % 4 > 0, word(0, 800 + p % 10, "TYPE")), word(5, F.lit(90), "hall"),
        word(300, F.lit(90), "NO."), when(p % 5 == 0, word(300, F.lit(250), "ROOM")), word(300, F.lit(500), "SIZE"), when(p % 5 < 2, word(300, F.lit(700), "TYPE")),
    ]
    items = pages.select("page_id", F.explode(F.array_compact(F.array(*words))).alias("w")).select("page_id", "w.*")
    return ocr.best_header(items).select("page_id", "header_y", "number_x", F.col("room_x").cast("string").alias("room_x"), "size_x", "type_x")


@query("SELECT event_id // 200 AS page_id, CAST(101 + r AS VARCHAR) AS door_number, 'HALL' AS room_name, '3''-0\"' AS door_width, '7''-0\"' AS door_height, CAST(r AS VARCHAR) AS hardware_set FROM events, (SELECT unnest(range(5)) AS r) GROUP BY ALL")
def r11_horizontal_rows(spark, sf_dir):
    """Five doors under each page's header, one number misread."""
    pages = views.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 200).alias("page_id")).distinct()
    words = [(50, 100, "NUMBER"), (50, 300, "ROOM"), (50, 600, "SIZE"), (50, 800, "TYPE"), (50, 1000, "HARDWARE")]
    for i, mark in enumerate(["101", "1O2", "193", "104", "105"]):
        words += [(104 + 40 * i, 105, mark), (105 + 40 * i, 310, "HALL"), (104 + 40 * i, 590, "3'-O\" X 7'-0\""), (104 + 40 * i, 1005, str(i))]
    items = pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(t).alias("text")) for y, x, t in words))).alias("w")).select("page_id", "w.*")
    return ocr.horizontal_rows(items).select("page_id", "door_number", "room_name", "door_width", "door_height", "hardware_set")


@query("SELECT event_id // 200 AS page_id, CAST(101 + r AS VARCHAR) AS door_number, 'R' || r AS room_name, (2 + r) || '''-0\"' AS door_width, CAST(4 + r AS VARCHAR) AS hardware_set FROM events, (SELECT unnest(range(4)) AS r) GROUP BY ALL")
def r12_vertical_rows(spark, sf_dir):
    """Four doors in columns on each page."""
    pages = views.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 200).alias("page_id")).distinct()
    words = [(20, 900, "NO."), (200, 900, "WIDTH"), (400, 900, "HARDWARE SET")]
    for i in range(4):
        words += [(22, 100 + 100 * i, str(101 + i)), (60, 105 + 100 * i, f"R{i}"), (205, 95 + 100 * i, f"{2 + i}.O"), (410, 100 + 100 * i, str(4 + i))]
    items = pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(t).alias("text")) for y, x, t in words))).alias("w")).select("page_id", "w.*")
    return ocr.vertical_rows(items).select("page_id", "door_number", "room_name", "door_width", "hardware_set")


@query("SELECT n_nationkey, n_name FROM nation")
def s18_sheets(spark, sf_dir):
    """Three sheets: one that is there, one that is not, and one without the columns."""
    read = lambda name, schema: files.sheet(spark, f"{sf_dir}/{name}.parquet", schema)
    rows = [read(n, "n_nationkey long, n_name string") for n in ("nation", "no_such_sheet", "region")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
