"""Short reports over proposals, runs, logs and catalogues."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import text


def proposal_totals(proposals: DataFrame) -> DataFrame:
    """Total value, open proposals, won ones, and the win rate in whole percent of those that are decided."""
    decided, won = F.count_if(F.col("status").isin("Accepted", "Lost")), F.count_if(F.col("status") == "Accepted")
    return proposals.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_value"), F.count_if(F.col("status").isin("Draft", "Sent", "In Review")).alias("active"), won.alias("won"),
        F.when(decided > 0, F.floor(won * 100 / decided + 0.5)).otherwise(0).cast("long").alias("win_rate"),
    )


def accuracy(scores: DataFrame) -> DataFrame:
    """Mean score to one place, rows, and rows below 90."""
    return scores.agg(F.round(F.avg("score"), 1).alias("mean_score"), F.count("*").alias("n"), F.count_if(F.col("score") < 90).alias("failed"))


def crop_metrics(events: DataFrame) -> DataFrame:
    """Crop counts of each file from its page events (pdf_name, event, crop_count, attempted, rescued, door_added, hw_added)."""
    pages = events.where("event = 'page_extracted'")
    return pages.groupBy("pdf_name").agg(
        F.sum(F.coalesce("crop_count", F.lit(0))).alias("crop_count"), F.count_if("attempted").alias("crop_rescue_attempt_pages"), F.count_if("rescued").alias("crop_rescue_pages"),
        F.sum(F.coalesce("door_added", F.lit(0))).alias("crop_door_added"), F.sum(F.coalesce("hw_added", F.lit(0))).alias("crop_hw_added"),
    )


def tiers(scored: DataFrame) -> DataFrame:
    """(severity, n, ids): the runs of each severity."""
    return scored.groupBy("severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("run_id")), ",").alias("ids"))


def regressions(baseline: DataFrame, current: DataFrame, strict: list[str] = ()) -> DataFrame:
    """(run_id, failure) of runs that a baseline has (run_id, status, severity, doors, hardware) and that went missing, fell back or lost rows."""
    now = current.select("run_id", F.lit(True).alias("there"), F.col("status").alias("now_status"), F.coalesce("doors", F.lit(0)).alias("now_doors"), F.coalesce("hardware", F.lit(0)).alias("now_hardware"))
    rows = baseline.join(now, "run_id", "left")
    there, held = F.coalesce("there", F.lit(False)), F.col("severity") == "ok"
    before, after = F.col("doors") + F.col("hardware"), F.col("now_doors") + F.col("now_hardware")
    failures = [
        F.when(~there, F.lit("missing in current run")),
        F.when(there & (F.col("status") == "ok") & (F.col("now_status") != "ok"), F.concat(F.lit("status regressed to "), "now_status")),
        F.when(there & held & (F.col("now_doors") < F.col("doors")), F.concat_ws(" ", F.lit("doors"), "now_doors", F.lit("< baseline"), "doors")),
        F.when(there & held & (F.col("now_hardware") < F.col("hardware")), F.concat_ws(" ", F.lit("hardware"), "now_hardware", F.lit("< baseline"), "hardware")),
        F.when(there & F.col("run_id").isin(*strict) & (F.col("severity") == "high") & (after < before), F.concat_ws(" ", F.lit("total rows"), after, F.lit("< baseline"), before)) if strict else F.lit(None).cast("string"),
    ]
    return rows.select("run_id", F.explode(F.array_compact(F.array(*failures))).alias("failure"))


def next_number(proposals: DataFrame, year: int) -> DataFrame:
    """The next free proposal id of a year, P-<year>-001 and on."""
    last = F.max(F.when(F.col("id").startswith(f"P-{year}"), F.coalesce(F.get(F.split("id", "-"), F.lit(2)).try_cast("int"), F.lit(0))))
    return proposals.agg(F.format_string(f"P-{year}-%03d", F.coalesce(last, F.lit(0)) + 1).alias("next_id"))


def found_doors(doors: DataFrame, words: str, risk: str = "all") -> DataFrame:
    """doors whose mark, room, set or remarks contain the words, in any case, and that have the risk (all: any)."""
    said = [F.lower(F.coalesce(c, F.lit(""))) for c in ("mark", "room_or_location", "hardware_set", "special_conditions", "remarks")]
    hit = F.lit(words == "")
    for c in said:
        hit = hit | c.contains(words.lower())
    return doors.where(hit & (F.lit(risk == "all") | (F.lower(F.coalesce("risk_level", F.lit(""))) == risk)))


def found_sets(sets: DataFrame, items: DataFrame, words: str) -> DataFrame:
    """sets (project_id, set_key, hardware_set) whose label, or an item's description or part, contains the words in any case."""
    low, own = words.lower(), F.lower("hardware_set").contains(words.lower())
    inside = F.lower(F.coalesce("desc", F.lit(""))).contains(low) | F.lower(F.coalesce("part", F.lit(""))).contains(low)
    by_item = items.where(inside).select("project_id", "set_key").distinct()
    return sets.where(own).unionByName(sets.where(~own).join(by_item, ["project_id", "set_key"], "left_semi").select(sets.columns))


def own_rows(rows: DataFrame, organization: Column, user: Column) -> DataFrame:
    """rows of an organization's user."""
    return rows.where((F.col("organization_id") == organization) & (F.col("user_id") == user))


def tenant_logs(logs: DataFrame, runs: DataFrame, organization: Column) -> DataFrame:
    """Logs (run_id, ...) of the runs of an organization."""
    return logs.join(runs.where(F.col("organization_id") == organization).select("run_id"), "run_id", "left_semi")


def forbidden(rows: DataFrame, columns: list[str], patterns: list[str]) -> DataFrame:
    """(row_key, text): rows whose texts, space-joined, match a forbidden pattern in any case; 180 characters of each."""
    said = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | said.rlike(f"(?i){p}")
    return rows.where(hit).select("row_key", F.substring(said, 1, 180).alias("text"))


def best_crops(crops: DataFrame, group: str, limit: int, shortlist: int = 7) -> DataFrame:
    """The top crops (priority, confidence, crop_id) of each group; only those of the short list's priority if there is one."""
    most = F.max("priority").over(Window.partitionBy(group))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.col("priority").desc(), F.col("confidence").desc(), "crop_id"))
    return crops.withColumn("most", most).where((F.col("most") < shortlist) | (F.col("priority") >= shortlist)).withColumn("nth", nth).where(F.col("nth") <= limit).drop("most")


def recent(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs; ties go to the larger key."""
    return runs.orderBy(F.col("completed_at").desc(), F.col("row_key").desc()).limit(limit)


def shuffled(rows: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """A reproducible sample: the first rows in the order of a seeded hash of their key."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), key).limit(limit)


def ground_truth(c: Column) -> Column:
    """What a document's raw text shows: its length, whether it is a scan (hardly any text), its different door numbers (100 to 9999, no
    years) and the different set ids that it names, both sorted."""
    c = F.coalesce(c, F.lit(""))
    number = lambda t: F.regexp_extract(t, r"^(\d+)", 1).cast("int")
    doors = F.filter(F.regexp_extract_all(c, F.lit(r"\b(\d{3,4}[A-Za-z]?)\b"), F.lit(1)), lambda t: (number(t) >= 100) & ~number(t).between(1900, 2099))
    sets = F.transform(F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in V.TRUTH_SETS)), lambda t: F.upper(t))
    return F.struct(
        F.length(c).alias("total_chars"), (F.length(F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))) < 300).alias("is_scanned"), F.array_join(F.array_sort(F.array_distinct(doors)), ",").alias("door_numbers"),
        F.array_join(F.array_sort(F.array_distinct(sets)), ",").alias("set_ids"),
    )


def tagged_witness(rows: DataFrame, pdf_name: Column, project_id: Column, decision: Column) -> DataFrame:
    """Rows of a direct reading with where they come from; what they carry of these columns is overwritten."""
    tags = {
        "project_id": project_id, "source_file": pdf_name, "page_type": F.lit("DIRECT_PDF"), "source_method": F.lit("openai_direct_pdf"), "source_confidence": F.lit(0.72),
        "source_location": F.concat(pdf_name, F.lit("#direct-pdf")), "verification_flags": decision, "hybrid_decision": decision,
    }
    return rows.withColumns(tags)


def legacy_sets(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Each project's sets in the older form: name from the note or the label, and items whose quantity is 1 where it is no number or zero."""
    amount = F.coalesce(F.nullif(F.col("qty").try_cast("double"), F.lit(0.0)), F.lit(1.0))
    item = F.struct("item_no", amount.alias("qty"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("desc", "part", "mfr", "finish")))
    held = items.groupBy("project_id", "set_key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    named = sets.select("project_id", "set_key", F.col("hardware_set").alias("id"), F.coalesce("estimator_note", "hardware_set").alias("name"))
    return named.join(held, ["project_id", "set_key"], "left").select("project_id", "id", "name", F.coalesce("items", F.array()).alias("items"))


def valid_requests(requests: DataFrame, sessions: DataFrame, users: DataFrame, bin_s: int = 86_400) -> DataFrame:
    """Requests (request_id, token, ts) of live sessions of active users: (request_id, session_id, user_id), the session issued last.

    sessions: session_id, user_id, token_hash, issued_at, expires_at, revoked_at. Only the hashes of tokens are stored and compared. A
    session stands in a bin for each stretch of time that it lives in, a request in one: an equi-join on (hash, bin), so that a token
    in long use does not meet its whole history. users: user_id, status.
    """
    at = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bin_s)
    ends = F.least("expires_at", F.coalesce("revoked_at", "expires_at"))
    live = sessions.withColumn("ends_at", ends).where("ends_at > issued_at")
    binned = live.select("session_id", "user_id", "token_hash", "issued_at", "ends_at", F.explode(F.sequence(at("issued_at"), at("ends_at"))).alias("bin"))
    asked = requests.select("request_id", "ts", F.sha2("token", 256).alias("token_hash"), at("ts").alias("bin"))
    met = asked.join(binned, ["token_hash", "bin"]).where((F.col("ts") >= F.col("issued_at")) & (F.col("ts") < F.col("ends_at")))
    active = met.join(users.where("status = 'active'").select("user_id"), "user_id")
    latest = active.groupBy("request_id").agg(F.max_by(F.struct("session_id", "user_id"), F.struct("issued_at", "session_id")).alias("s"))
    return latest.select("request_id", "s.session_id", "s.user_id")


def proposal_index(runs: DataFrame) -> DataFrame:
    """A run as a row of the proposal list: its id, client, doors, status and day."""
    review = F.col("status") == "review_required"
    given = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c), F.lit(""))
    return runs.select(
        F.coalesce("proposal_id", F.substring("run_id", 1, 8), F.lit("RUN")).alias("id"), given("architect", "user_email").alias("client"), F.coalesce("door_count", "openings_found", F.lit(0)).alias("doors"),
        F.when(review, "In Review").otherwise("Draft").alias("status"), F.when(review, "REVIEW_REQUIRED").otherwise("OK").alias("extraction_status"), F.substring(F.col("created_at").cast("string"), 1, 10).alias("date"),
    )


def extended_lines(lines: DataFrame) -> DataFrame:
    """Proposal lines (set_id, n_sets, item) with total quantity and extended price; items without a price extend to 0."""
    qty = F.col("item.qty") * F.col("n_sets")
    return lines.select(F.concat(F.lit("HW-"), "set_id").alias("set"), F.col("item.part").alias("part"), F.col("item.desc").alias("description"), F.col("item.qty").alias("qty"), "n_sets", qty.alias("total_qty"), (F.coalesce("item.price", F.lit(0)) * qty).alias("extended"))


def proposal_sheets(lines: DataFrame) -> dict[str, DataFrame]:
    """K4: the labour sheet (lines with time) and the supply sheet (lines with a price) of a proposal; an empty one says so in one row."""
    note = lines.sparkSession.createDataFrame([("No items",)], "description string")

    def sheet(rows: DataFrame) -> DataFrame:
        none = rows.agg(F.count("*").alias("n")).where("n = 0").join(note).select("description")  # one row at most
        return rows.unionByName(none, allowMissingColumns=True)

    return {"labour": sheet(lines.where("install_time_mins > 0")), "supply": sheet(lines.where("unit_price > 0"))}


def live_sessions(sessions: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """M3: sessions (issued_at, revoked) that are not revoked and not older than their term."""
    return sessions.where(~F.coalesce("revoked", F.lit(False)) & (now < F.col("issued_at") + F.expr(f"interval {days} days")))
