"""Sources, sinks and streams."""

import datetime as dt
import os

from lintel.sources import files, sinks
from lintel.streaming import state


def test_inventory(spark, tmp_path):
    (tmp_path / "Project 7").mkdir()
    for name in ("top 3.pdf", "Project 7/a.pdf", "Project 7/b.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = {r.file_name: r.project_id for r in files.inventory(spark, f"file:{tmp_path}").collect()}
    assert rows == {"top%203.pdf": "top203pdf", "a.pdf": "project_7"} or rows == {"top 3.pdf": "top_3pdf", "a.pdf": "project_7"}


def test_run_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    events = spark.createDataFrame([("start", dt.datetime(2026, 1, 1), "r1"), ("finish", dt.datetime(2026, 1, 2), "r1"), ("start", dt.datetime(2026, 1, 1), "r2")], "event string, ts timestamp, run_id string")
    sinks.append_log(events.limit(1), path)
    sinks.append_log(events.where("event = 'finish' or run_id = 'r2'"), path)
    rows = {r.run_id: (r.events, r.first_event, r.last_event) for r in files.run_summaries(files.run_log(spark, path)).collect()}
    assert rows == {"r1": (2, "start", "finish"), "r2": (1, "start", "start")}


def test_master_list(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Item Description,Unit Price,Install mins,Category\nHINGE,4.5,12,door\n,1,1,x\nLOCK,,,\n")
    rows = {r.description: (r.install_time_mins, r.default_unit_price, r.category) for r in files.master_list(spark, f"{tmp_path}/m.csv").collect()}
    assert rows == {"HINGE": (12.0, 4.5, "door"), "LOCK": (0.0, 0.0, None)}


def test_replace_projects(spark, tmp_path):
    path = f"{tmp_path}/est"
    sinks.replace_projects(spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, n int"), path)
    sinks.replace_projects(spark.createDataFrame([("a", 9)], "project_id string, n int"), path)
    assert {(r.project_id, r.n) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_replace_projects_keeps_folders_few(spark, tmp_path):
    """Folders and files do not grow with projects; projects that share a folder with a replaced one stay, null is a project too."""
    path, n = f"{tmp_path}/est", 3 * sinks.PARTS
    sinks.replace_projects(spark.range(2 * n).selectExpr(f"nullif(concat('p', id % {n}), 'p1') as project_id", "id as n").repartition(4), path)
    assert len(list((tmp_path / "est").rglob("*.parquet"))) <= sinks.PARTS
    sinks.replace_projects(spark.createDataFrame([("p0", -1), (None, -2)], "project_id string, n long"), path)
    want = {(None if i % n == 1 else f"p{i % n}", i) for i in range(2 * n) if i % n > 1} | {("p0", -1), (None, -2)}
    found = [(r.project_id, r.n) for r in spark.read.parquet(path).collect()]
    assert set(found) == want and len(found) == len(want)


def test_schedule(spark, tmp_path):
    doors = spark.createDataFrame([("101", "say \"x\",\ny", "HALL to LOBBY")], "door_number string, remarks string, room_or_location string")
    line = sinks.schedule_lines(doors).first().line
    assert line.count(",") == 28 and line.startswith(",101,,HALL,LOBBY,1,") and '"say ""x"", y"' in line
    sinks.write_schedule(doors, f"{tmp_path}/s")
    sinks.write_sheets({"doors": doors, "none": doors.limit(0)}, f"{tmp_path}/w")
    sinks.write_csv_sets({"doors": doors, "none": doors.limit(0)}, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/w/none").count() == 0 and [p.name for p in (tmp_path / "c").iterdir()] == ["doors"]
    assert b"\r\n" in next((tmp_path / "s").glob("*.csv")).read_bytes()


def test_run_children(spark):
    logs = [("loud", None, "s", "", "a"), (None, "warn", None, "b", "x"), None, ("ok", "error", None, None, None), (None, None, None, "z", None)]
    items = [(None, 2, "", "hinge", "p1", "p2", None, "m", "626"), None]
    run = ("r", "f.pdf", logs, [("101", "1", "high", 0.5), None], [("1", "found", items), ("2", None, None)], [(None, "high", "c", "", "why", None, "sheet"), ("low", "x", None, "q", "i", "s", "w")])
    schema = (
        "run_id string, source_filename string, logs array<struct<kind:string,level:string,stage:string,text:string,message:string>>, doors array<struct<mark:string,hardware_set:string,risk_level:string,confidence:double>>, "
        "sets array<struct<hardware_set:string,status:string,items:array<struct<item_no:string,qty:int,desc:string,description:string,part:string,catalog_number:string,mfr:string,manufacturer:string,finish:string>>>>, "
        "rfis array<struct<priority:string,severity:string,category:string,question:string,issue:string,source:string,where:string>>"
    )
    runs = spark.createDataFrame([run, ("empty", None, None, None, None, None)], schema)
    got = {k: sorted(tuple(r)[1:] for r in t.where("run_id = 'r'").collect()) for k, t in sinks.run_children(runs, most=4).items()}
    assert got == {
        "logs": [(0, "info", "s", "a"), (1, "warn", None, "b"), (3, "ok", None, "")],
        "doors": [(0, "101", "1", "high", "0.5")],
        "sets": [(0, "1", "found"), (1, "2", None)],
        "items": [(0, 0, "", "2", "hinge", "p1", "m", "626")],
        "rfis": [(0, "high", "c", "why", "sheet"), (1, "low", None, "q", "s")],
        "audit": [("runs.create", "pdf_run", '{"source_filename":"f.pdf"}')],
    }
    assert {k: t.where("run_id = 'empty'").count() for k, t in sinks.run_children(runs).items()} == {"logs": 0, "doors": 0, "sets": 0, "items": 0, "rfis": 0, "audit": 1}


def events(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=m), u, "x", 1.0) for i, (u, m) in enumerate([(1, 0), (1, 10), (1, 20), (1, 59), (1, 61), (1, 71), (2, 0)])]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_rate_limit_ignores_what_it_rejects(spark):
    rows = state.rate_limited(events(spark), limit=2).orderBy("event_id").collect()
    assert [r.allowed for r in rows] == [True, True, False, False, True, True, True]
    assert rows[2].retry_after == 40 * 60


def test_rate_limit_stream_agrees_with_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a timeout would ask for batches for ever
    frame = events(spark)
    frame.where("event_id < 3").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    run = state.rate_limited_stream(stream, limit=2).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        run.processAllAvailable()
        frame.where("event_id >= 3").coalesce(1).write.mode("append").parquet(source)
        run.processAllAvailable()
    finally:
        run.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r.event_id, r.allowed) for r in spark.table("limited").collect()}
    assert got == {(r.event_id, r.allowed) for r in state.rate_limited(frame, limit=2).collect()}


def test_windows_and_sessions(spark):
    assert sum(r.n for r in state.event_windows(events(spark)).collect()) == 7
    assert sorted((r.user_id, r.n) for r in state.sessions(events(spark), "15 minutes").collect()) == [(1, 3), (1, 3), (2, 1)]


def test_listing(spark, tmp_path):
    """Top level and subfolders of any depth, one suffix; nothing where there is no folder."""
    for name in ("b.pdf", "Project 7/a.pdf", "Project 7/deep/c.pdf", "Project 7/d.txt", "x/e.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    for folder in (f"{tmp_path}", f"file://{tmp_path}/", f"file:{tmp_path}"):
        found = files.identified(files.listed(spark, folder, ".pdf"), folder.rstrip("/")).collect()
        assert {(r.file_name, r.length) for r in found} == {("b.pdf", 2), ("a.pdf", 2), ("c.pdf", 2), ("e.pdf", 2)}
        assert len({r.file_id for r in found}) == 4
    assert files.listed(spark, f"{tmp_path}", ".pdf").rdd.getNumPartitions() == 3
    assert files.listed(spark, f"{tmp_path}/none").collect() == []


def test_listing_stream(spark, tmp_path):
    """New files come in once, also over a restart."""
    source, seen = tmp_path / "in", []
    source.mkdir()

    def run():
        stream = files.listed(spark, str(source), stream=True)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    for k, names in enumerate((["a", "b"], ["c"], [])):
        for name in names:
            (source / name).write_bytes(b"x")
            os.utime(source / name, ns=(10**18 + k, 10**18 + k))
        seen += names
        assert run() == sorted(seen)


def test_expired_jobs_stream(spark, tmp_path):
    """What the stream says, over restarts, is what the batch says; late events within the watermark count."""
    start = dt.datetime(2026, 1, 1)
    steps = [(1, "running", 0), (1, "completed", 60), (2, "failed", 10), (2, "running", 200), (3, "completed", 5), (3, "failed", 380), (3, "running", 381), (4, "completed", 30), (4, "completed", 30 + 360), (5, "running", 0), (1, "running", 500), (1, "failed", 700)]
    rows = [(j, k, s, start + dt.timedelta(minutes=m)) for k, (j, s, m) in enumerate(sorted(steps, key=lambda x: (x[2] // 100, -x[2])))]
    schema = "job_id long, event_id long, status string, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(4):
            own = rows[part * 4 : part * 4 + 4] if part < 3 else [(9, 99, "running", start + dt.timedelta(days=2)), (8, 98, "running", start + dt.timedelta(days=2))]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
            stream = state.expired_jobs_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), "100 minutes")
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            query.awaitTermination(180)
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    frame = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, state.expired_jobs(frame, state.F.lit(start + dt.timedelta(days=2))).collect()))
    assert got == want
    assert [(j, s, n) for j, s, *_, n in want] == [(1, "completed", 2), (1, "failed", 2), (3, "completed", 1), (4, "completed", 2)]
