"""Document texts, extracted tables, broken answers and sessions on cases made by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.pages import salvaged_json
from lintel.operators import parse, summaries, texts
from lintel.operators.skew import dealt


def rows_of(spark, answers):
    frame = spark.createDataFrame(list(enumerate(answers)), "answer_id int, answer string")
    found: dict = {k: [] for k in range(len(answers))}
    for r in parse.json_rows(frame, "mark: string, width: string").orderBy("answer_id", "row_no").collect():
        found[r.answer_id].append((r.mark, r.width))
    return list(found.values())


def test_truncated_answers(spark):
    answers = [
        '[{"mark":"D1","width":"3"},{"mark":"E',
        '[{"mark":"D1","width":"a } b"},{"mark":"E { ["},{"mark"',
        '<think>[1</think>```json\n[{"mark": "D1",}, {"mark": "D2"\n```',
        '[{"mark":"a,]","width":"3"},]',
        '[{"mark":"q\\"]}","width":"3"},{"mark":"\\',
        '[{"mark":"D1"}] and more ]}',
        '[{"mark":"E', "[", "no rows", "", '[{"mark":"D1","width":"3"},{"mark":"D2","width":12',
    ]
    assert rows_of(spark, answers) == [[("D1", "3")], [("D1", "a } b"), ("E { [", None)], [("D1", None), ("D2", None)], [("a,]", "3")], [('q"]}', "3")], [("D1", None)], [], [], [], [], [("D1", "3")]]


def test_salvaged_objects_at_every_cut(spark):
    """Whatever the cut, the mended text is JSON, and it holds all objects that were whole."""
    whole = json.dumps({"doors": [{"m": 'a"}'}, {"m": "b[", "n": [1, {"x": "]"}]}, {"m": "c\\"}], "ok": True, "sets": []})
    cuts = spark.createDataFrame([(k, whole[:k]) for k in range(1, len(whole) + 1)], "k int, text string")
    closed, cut = salvaged_json(F.col("text"))
    for r in cuts.select("k", "text", closed.alias("closed"), cut.alias("cut")).collect():
        if r.cut is not None:
            held = json.loads(r.cut)
            ends = [whole.index(e) + len(e) for e in ('{"m": "a\\"}"}', '{"m": "b[", "n": [1, {"x": "]"}]}', '{"m": "c\\\\"}')]
            assert len([d for d in held.get("doors", []) if d]) >= sum(e <= r.k for e in ends), r.text
    assert json.loads(cuts.where(F.length("text") == len(whole)).select(closed).first()[0]) == json.loads(whole)


def test_very_long_strings(spark):
    text = '[{"mark":"' + "x\\\\" * 300_000 + '","width":"1"},{"mark":"' + "{" * 100_000
    assert [len(m) for m, _ in rows_of(spark, [text])[0]] == [600_000]


@pytest.mark.parametrize("limit", [0, 1, 7, 30, 1000])
def test_documents(spark, limit):
    rng = random.Random(limit)
    docs = {d: [rng.choice(["", None, "abc", "TES ERAWDRAH", "  é\n", "x" * 9]) for _ in range(rng.randint(1, 6))] for d in range(25)}
    frame = spark.createDataFrame([(d, p, t) for d, pages in docs.items() for p, t in enumerate(pages)], "doc_id int, page int, text string").repartition(3)

    def plain(pages):
        chunks, total = [], 0
        for t in pages:
            if t and total < limit:
                chunks.append(t[: limit - total])
                total += len(chunks[-1])
        return "\n".join(chunks).strip().replace("TES ERAWDRAH", "HARDWARE SET").replace("ERAWDRAH", "HARDWARE")[:limit]

    assert {r.doc_id: r.text for r in texts.document_text(frame, limit).collect()} == {d: plain(p) for d, p in docs.items()}
    marked = lambda pages: V.PAGE_BREAK.join((t or "").replace("TES ERAWDRAH", "HARDWARE SET") for t in pages)[:limit]
    assert {r.doc_id: r.text for r in texts.document_markdown(frame, limit).collect()} == {d: marked(p) for d, p in docs.items()}


def test_page_text(spark):
    rows = [("Door Schedule", "| a   b |", "m"), ("Door Schedule", "door schedule |  x", " "), ("hw set 3", "x", " "), ("x", "\n ", "m |   n"), ("x", None, None), ("plain", "  y ", "z")]
    frame = spark.createDataFrame(rows, "p string, l string, m string")
    assert [r[0] for r in frame.select(texts.page_text(F.col("p"), F.col("l"), F.col("m"))).collect()] == ["m", "door schedule | x", "hw set 3", "m | n", "x", "y"]


def test_best_tables(spark):
    """Equal scores: the earlier way; poor tables do not count; empty rows and columns go."""
    grid = lambda strategy, table, *rows: [(1, strategy, table, k, list(r)) for k, r in enumerate(rows)]
    rows = grid("text", 0, ["aa", "", "bb"], ["", " ", None], ["cc", "", "dd"]) + grid("usual", 0, ["ee", "ff"], ["gg", "h\nh"]) + grid("lines", 0, ["(cid:12)", "(cid:13)"], ["(cid:1)", "(cid:2)"], ["(cid:1)", "(cid:2)"]) + grid("lines", 1, ["one row"])
    found = texts.best_tables(spark.createDataFrame(rows, "page_id int, strategy string, table_no int, row_no int, cells array<string>"), ["usual", "text", "lines"]).collect()
    assert [tuple(r) for r in found] == [(1, "usual", 4, "=== TABLE (2×2) ===\n| ee | ff |\n| gg | h h |")]
    more = grid("text", 1, ["x1", "x2"], ["x3", "x4"])
    found = texts.best_tables(spark.createDataFrame(rows + more, "page_id int, strategy string, table_no int, row_no int, cells array<string>"), ["usual", "text", "lines"]).collect()
    assert [tuple(r) for r in found] == [(1, "text", 8, "=== TABLE (2×2) ===\n| aa | bb |\n| cc | dd |\n\n=== TABLE (2×2) ===\n| x1 | x2 |\n| x3 | x4 |")]


def test_best_tables_shuffles_dealt_rows_once(spark):
    """Rows that share a number are one line; a short row has blanks."""
    rows = [(1, "usual", 0, 0, ["bb", "", "cc"]), (1, "usual", 0, 0, ["aa"]), (1, "usual", 0, 1, ["dd"])]
    frame = spark.createDataFrame(rows, "page_id int, strategy string, table_no int, row_no int, cells array<string>")
    found = texts.best_tables(dealt(frame, "page_id", 3, 2), ["usual"])
    assert [tuple(r) for r in found.collect()] == [(1, "usual", 4, "=== TABLE (2×3) ===\n| aa | bb | cc |\n| dd |  |")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_output_budget(spark):
    rows = [("gpt-5", "s" * 40, "u" * 40, False), ("unknown", "", "u" * 28_000, False), ("qwen2.5", None, "u" * 110_000, True), ("QWEN3-VL", "", "", True), (None, "", "u" * 99_999, False)]
    frame = spark.createDataFrame(rows, "m string, s string, u string, i boolean")
    assert [r[0] for r in frame.select(texts.output_budget(*map(F.col, "msui"))).collect()] == [12000, 512, 32768 - 27500 - 1200 - 768, 4096, 512]


def test_valid_requests(spark):
    at = lambda h: F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(h) * 3600)
    sessions = [(1, 1, "t1", 0, 336, None), (2, 1, "t1", 50, 386, 60), (3, 2, "t2", 0, 336, 0), (4, 3, "t3", 0, 336, None), (5, 1, "t1", 55, 56, None)]
    frame = spark.createDataFrame(sessions, "session_id int, user_id int, t string, i int, e int, r int")
    frame = frame.select("session_id", "user_id", F.sha2("t", 256).alias("token_hash"), at(0).alias("z"), *((F.timestamp_seconds(1_700_000_000 + F.col(c) * 3600)).alias(n) for c, n in (("i", "issued_at"), ("e", "expires_at"), ("r", "revoked_at")))).drop("z")
    users = spark.createDataFrame([(1, "active"), (2, "active"), (3, "disabled")], "user_id int, status string")
    asked = [(1, "t1", 0), (2, "t1", 51), (3, "t1", 55), (4, "t1", 56), (5, "t1", 60), (6, "t1", 336), (7, "t2", 1), (8, "t3", 1), (9, "t9", 1), (10, None, 1)]
    requests = spark.createDataFrame(asked, "request_id int, token string, h int").select("request_id", "token", F.timestamp_seconds(1_700_000_000 + F.col("h") * 3600).alias("ts"))
    for bin_s in (1800, 86_400, 10**7):
        assert {(r.request_id, r.session_id, r.user_id) for r in summaries.valid_requests(requests, frame, users, bin_s).collect()} == {(1, 1, 1), (2, 2, 1), (3, 5, 1), (4, 2, 1), (5, 1, 1)}
