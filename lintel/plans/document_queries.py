"""Queries of document texts, extracted tables, broken answers and sessions, each with its SQL."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.operators import parse, summaries, texts
from lintel.operators.skew import dealt
from lintel.plans import oracle as O
from lintel.plans import views
from lintel.plans.storage import remove_table, settled, shared_folder
from lintel.sources import files
from lintel.streaming import state

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


def _unreversed(x: str) -> str:
    return O._UNREVERSED.replace("body", x, 1)


def _squeezed(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda x: CASE WHEN contains(x, '|') THEN regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g') ELSE x END), chr(10))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ten pages each: the pages' whole markup with planted lines, now and then none."""
    pages = views.page_texts(spark, sf_dir)
    return pages.select(F.floor(F.col("page_id") / 10).alias("doc_id"), (F.col("page_id") % 10).alias("page"), F.when(F.col("page_id") % 11 > 0, F.col("body")).alias("text"))


_PAGES = (O.PAGES, "p AS (SELECT page_id // 10 AS doc_id, page_id % 10 AS page, CASE WHEN page_id % 11 > 0 THEN body ELSE '' END AS text FROM bodies)")
_BEFORE = "b AS (SELECT *, coalesce(sum({size}) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source})"


@query(O.chain(*_PAGES, _BEFORE.format(size="length(text)", source="p"), select=f"SELECT doc_id, left({_unreversed(O.strip('t'))}, 9000) AS text FROM (SELECT doc_id, coalesce(string_agg(substr(text, 1, CAST(9000 - before AS BIGINT)), chr(10) ORDER BY page) FILTER (before < 9000 AND text <> ''), '') AS t FROM b GROUP BY doc_id)"))
def s10_document_text(spark, sf_dir):
    return texts.document_text(_pages(spark, sf_dir), 9000)


_MARK = O.text(V.PAGE_BREAK).replace("\n", "' || chr(10) || '")


@query(O.chain(*_PAGES, f"u AS (SELECT doc_id, page, {_unreversed('text')} AS text FROM p)", select=f"SELECT doc_id, left(string_agg(text, {_MARK} ORDER BY page), 12000) AS text FROM u GROUP BY doc_id"))
def s13_document_markdown(spark, sf_dir):
    return texts.document_markdown(_pages(spark, sf_dir), 12_000)


@query(O.chain(O.PAGES, "r AS (SELECT page_id, body, CASE page_id % 4 WHEN 0 THEN replace(body, 'DOOR SCHEDULE', '') WHEN 1 THEN '  ' WHEN 2 THEN replace(replace(body, '|', '|   '), 'HARDWARE SET', '') ELSE '  ' || replace(body, '|', '   |') END AS layout, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE '# page' || chr(10) || body END AS markdown FROM bodies)",
    select=f"SELECT page_id, CASE WHEN {O.strip('layout')} <> '' AND NOT (regexp_matches(body, {O.text(V.DOOR_SIGNAL)}) AND NOT regexp_matches(layout, {O.text(V.DOOR_SIGNAL)})) AND NOT (regexp_matches(body, {O.text(V.HARDWARE_SIGNAL)}) AND NOT regexp_matches(layout, {O.text(V.HARDWARE_SIGNAL)})) THEN {_squeezed(O.strip('layout'))} WHEN {O.strip('markdown')} <> '' THEN {_squeezed('markdown')} ELSE body END AS text FROM r"))
def s11_page_text(spark, sf_dir):
    """Three readings of each page: the layout one loses a heading, or is blank; the markdown one may be blank."""
    body, k = F.col("body"), F.col("page_id") % 4
    layout = F.when(k == 0, F.replace(body, F.lit("DOOR SCHEDULE"), F.lit(""))).when(k == 1, "  ").when(k == 2, F.replace(F.replace(body, F.lit("|"), F.lit("|   ")), F.lit("HARDWARE SET"), F.lit(""))).otherwise(F.concat(F.lit("  "), F.replace(body, F.lit("|"), F.lit("   |"))))
    markdown = F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.concat(F.lit("# page\n"), body))
    return views.page_texts(spark, sf_dir).select("page_id", texts.page_text(body, layout, markdown).alias("text"))


_STRATEGIES = ["usual", "text", "lines"]
_LINES = 200_000  # a task's
_CELL4 = ["CASE WHEN k % 5 = 0 THEN ' ' ELSE 'D' || l_partkey END", "CASE WHEN k % 3 = 0 THEN '' ELSE l_linestatus || l_returnflag END", "''", "CASE WHEN k % 7 = 0 THEN l_comment END"]


@query(O.chain(f"""l AS (SELECT *, repeat('word ', q) AS l_comment, unnest([0, 1, 2]) AS s FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_linestatus, l_returnflag, CAST(l_quantity AS INT) AS q FROM lineitem)),
c AS (SELECT l_orderkey AS page_id, s, l_linenumber % 2 AS table_no, ((l_linenumber * 10000019 + l_partkey) * 100 + q) * 9 + ascii(l_linestatus) % 3 * 3 + ascii(l_returnflag) % 3 AS row_no, unnest(range(4)) AS col_no, trim(coalesce(unnest([{', '.join(_CELL4)}]), '')) AS cell FROM (SELECT *, l_partkey + s * (l_orderkey % 3) AS k FROM l)),
f AS (SELECT * FROM c WHERE cell <> ''), rw AS (SELECT DISTINCT page_id, s, table_no, row_no FROM f), cl AS (SELECT DISTINCT page_id, s, table_no, col_no FROM f),
g AS (SELECT page_id, s, table_no, row_no, list(cell ORDER BY col_no) AS cells FROM rw JOIN cl USING (page_id, s, table_no) JOIN c USING (page_id, s, table_no, row_no, col_no) GROUP BY ALL),
m AS (SELECT page_id, s, table_no, count(*) AS n, max(len(cells)) AS cols, sum(len(list_filter(cells, lambda x: x <> ''))) AS filled, sum(len(cells)) AS total, sum(length(array_to_string(cells, ''))) AS chars,
  string_agg('| ' || array_to_string(list_transform(cells, lambda x: left(x, 80)), ' | ') || ' |', chr(10) ORDER BY row_no) AS body FROM g GROUP BY ALL),
q AS (SELECT page_id, s, sum(filled) AS score, string_agg('=== TABLE (' || n || '×' || cols || ') ===' || chr(10) || body, chr(10) || chr(10) ORDER BY table_no) AS text FROM m WHERE n >= 2 AND filled / total >= 0.15 AND chars / filled >= 1.5 GROUP BY ALL)""",
    select="SELECT page_id, ['usual', 'text', 'lines'][s + 1] AS strategy, CAST(score AS BIGINT) AS score, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, s) AS nth FROM q) WHERE nth = 1"))
def s4_best_tables(spark, sf_dir):
    """Each order's lines as the rows of two tables, read in three ways that lose other cells."""
    table = views.table(spark, sf_dir, "lineitem")
    lines = table.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    lines = dealt(lines, "l_orderkey", table.count(), _LINES).distinct()  # an order's lines before they are read three times
    lines = lines.withColumn("s", F.explode(F.array(*map(F.lit, range(3))))).withColumn("k", F.col("l_partkey") + F.col("s") * (F.col("l_orderkey") % 3))
    none = F.lit(None).cast("string")
    cells = F.array(F.when(F.col("k") % 5 == 0, " ").otherwise(F.concat(F.lit("D"), "l_partkey")), F.when(F.col("k") % 3 == 0, "").otherwise(F.concat("l_linestatus", "l_returnflag")), F.lit(""), F.when(F.col("k") % 7 == 0, F.repeat(F.lit("word "), F.col("q"))).otherwise(none))
    rows = lines.select(F.col("l_orderkey").alias("page_id"), F.element_at(F.array(*map(F.lit, _STRATEGIES)), F.col("s") + 1).alias("strategy"), (F.col("l_linenumber") % 2).alias("table_no"), (((F.col("l_linenumber").cast("long") * 10000019 + F.col("l_partkey")) * 100 + F.col("q")) * 9 + F.ascii("l_linestatus") % 3 * 3 + F.ascii("l_returnflag") % 3).alias("row_no"), cells.alias("cells"))
    return texts.best_tables(rows, _STRATEGIES)


@query(O.chain(O.BOXES, r"""o AS (SELECT page_id, CAST(round_even((y0 + y1) / 2 / 15, 0) AS BIGINT) AS "row", (x0 + x1) / 2 AS x, event_type || box_id AS word FROM boxes JOIN events ON box_id = event_id WHERE event_id % 10 >= 3)""",
    select="""SELECT page_id, '=== PURE OPTICAL TEXT SEQUENCE ===' || chr(10) || string_agg(line, chr(10) ORDER BY "row") AS text FROM (SELECT page_id, "row", string_agg(word, '    ' ORDER BY x, word) AS line FROM o GROUP BY ALL) GROUP BY page_id"""))
def s6_optical_lines(spark, sf_dir):
    k = F.col("event_id")
    sides = {"x0": k % 37 * 3, "y0": k % 23 * 5, "x1": k % 37 * 3 + 30, "y1": k % 23 * 5 + 20}
    boxes = views.table(spark, sf_dir, "events").select(F.floor(k / 200).alias("page_id"), *(v.cast("double").alias(n) for n, v in sides.items()), (k % 10 / 10).alias("confidence"), F.concat("event_type", k.cast("string")).alias("text"))
    return texts.optical_lines(boxes)


_MODELS = ["gpt-5-mini", "Qwen3-VL:8b", "llama3.1", "mistral-small", "", "llama-3.3-70b", "qwen2.5:14b"]
_NAMED = f"[{', '.join(map(O.text, _MODELS))}][conv_id % {len(_MODELS)} + 1]"


def _rules(rules: list[tuple[str, int]], usual: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(m), {O.text(p)}) THEN {n}" for p, n in rules) + f" ELSE {usual} END"


@query(f"""SELECT conv_id, turn, CAST(greatest(512, least({_rules(V.OUTPUT_TOKENS, V.USUAL_OUTPUT)}, {_rules(V.CONTEXT_TOKENS, V.USUAL_CONTEXT)} - greatest(1, (length(role) + length(t)) // 4) - CASE WHEN turn % 2 = 0 THEN 1200 ELSE 0 END - 768)) AS INT) AS tokens
FROM (SELECT *, {_NAMED} AS m, repeat(coalesce(text, ''), CAST(1 + conv_id % 40 AS INT)) AS t FROM conversations)""")
def x26_output_budget(spark, sf_dir):
    """Turns, repeated to prompts of all lengths, for models of several names."""
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("conv_id") % len(_MODELS) + 1).cast("int"))
    prompt = F.repeat(F.coalesce("text", F.lit("")), (1 + F.col("conv_id") % 40).cast("int"))
    turns = views.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", texts.output_budget(model, F.col("role"), prompt, F.col("turn") % 2 == 0).alias("tokens"))


# Each answer is three rows, cut after event_id % (length + 1) characters. Of a row, what is whole counts: all of it, or its mark alone.
_ROW26 = """'{"mark":"D' || user_id || '","note":"' || event_type || ' }], {\\"' || event_id || '"}'"""


@query(f"""WITH t AS (SELECT event_id, user_id, event_type, length({_ROW26}) AS n, length('{{"mark":"D' || user_id || '"') AS m FROM events),
c AS (SELECT *, event_id % (3 * n + 4 + 1) AS cut, unnest([0, 1, 2]) AS k FROM t), r AS (SELECT *, cut - 1 - k * (n + 1) AS got FROM c)
SELECT event_id AS answer_id, CAST(k AS INT) AS row_no, 'D' || user_id AS mark, CASE WHEN got >= n - 1 THEN event_type || ' }}], {{"' || event_id END AS note FROM r WHERE got >= n - 1 OR got = m""")
def s26_salvaged_rows(spark, sf_dir):
    """Answers cut off anywhere, with brackets and quotes inside strings."""
    row = F.concat(F.lit('{"mark":"D'), "user_id", F.lit('","note":"'), "event_type", F.lit(' }], {\\"'), "event_id", F.lit('"}'))
    whole = F.concat(F.lit("["), row, F.lit(","), row, F.lit(","), row, F.lit("]"))
    events = views.table(spark, sf_dir, "events").withColumn("whole", whole)
    answers = events.select(F.col("event_id").alias("answer_id"), F.substring("whole", F.lit(1), (F.col("event_id") % (F.length("whole") + 1)).cast("int")).alias("answer"))
    return parse.json_rows(answers, "mark: string, note: string")


@query("""WITH s AS (SELECT event_id AS session_id, user_id, 'tok' || user_id || '-' || event_id % 3 AS token, ts AS issued, least(ts + INTERVAL 14 DAY, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 30 HOUR END) AS ends FROM events WHERE event_id % 5 = 0)
SELECT e.event_id AS request_id, arg_max(session_id, (issued, session_id)) AS session_id, arg_max(s.user_id, (issued, session_id)) AS user_id FROM events e JOIN s ON s.token = 'tok' || e.user_id || '-' || e.event_id % 4 AND e.ts >= issued AND e.ts < ends WHERE s.user_id % 6 <> 0 GROUP BY e.event_id""")
def j22_valid_requests(spark, sf_dir):
    """A fifth of the events open sessions of 14 days, some of which are revoked; all events are requests."""
    events, day = views.table(spark, sf_dir, "events"), lambda n: F.expr(f"INTERVAL {n} HOUR")
    token = lambda n: F.concat(F.lit("tok"), "user_id", F.lit("-"), F.col("event_id") % n)
    sessions = events.where("event_id % 5 = 0").select(F.col("event_id").alias("session_id"), "user_id", F.sha2(token(3), 256).alias("token_hash"), F.col("ts").alias("issued_at"), (F.col("ts") + day(336)).alias("expires_at"), F.when(F.col("event_id") % 7 == 0, F.col("ts") + day(30)).alias("revoked_at"))
    users = events.select("user_id", F.when(F.col("user_id") % 6 == 0, "disabled").otherwise("active").alias("status")).distinct()
    return summaries.valid_requests(events.select(F.col("event_id").alias("request_id"), token(4).alias("token"), "ts"), sessions, users)


@query("""WITH e AS (SELECT event_id, user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts FROM events),
n AS (SELECT *, CASE WHEN status IN ('completed', 'failed') AND coalesce(lead(ts) OVER w > ts + INTERVAL 6 HOUR, true) THEN ts + INTERVAL 6 HOUR END AS expired_at FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
l AS (SELECT *, coalesce(count(expired_at) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM n)
SELECT job_id, status, ts AS finished_at, expired_at, n_events FROM (SELECT *, count(*) OVER (PARTITION BY job_id, life) AS n_events FROM l) WHERE expired_at < (SELECT max(ts) FROM events)""")
def m2_expired_jobs(spark, sf_dir):
    """Each user's events as those of a job, until the last event of all."""
    events = views.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    now = events.agg(F.max("ts").alias("now"))
    jobs = events.select(F.col("user_id").alias("job_id"), "event_id", status.alias("status"), "ts")
    return state.expired_jobs(jobs, F.lit(now.first()["now"]))


@query("SELECT 'source=' || source AS folder, 1::BIGINT AS files, 'source' || replace(source, '_', '') AS key, true AS filled FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def s14_listed_files(spark, sf_dir):
    """The folders that documents are written to, one for each source, listed by the data source; the folder is deleted afterwards."""
    docs, path = views.table(spark, sf_dir, "documents").where("source IS NOT NULL"), f"{shared_folder(spark).rstrip('/')}/listed-{uuid.uuid4().hex}"
    docs.select("source", "text").repartition("source").write.option("maxRecordsPerFile", 0).partitionBy("source").parquet(path)
    found = files.identified(files.listed(spark, path, ".parquet"), path)
    folder = F.element_at(F.split("path", "/"), -2)
    counted = settled(found.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), (F.min("length") > 0).alias("filled")))
    remove_table(spark, path)
    return counted.select("folder", "files", F.regexp_replace("folder", "[^A-Za-z0-9]", "").alias("key"), "filled")
