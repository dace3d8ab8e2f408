"""What kind of page a text is, and how good an extraction of it, as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import bound
from lintel.functions.pages import evidence_of, judged, read, rows_with
from lintel.functions.predicates import any_of

DOOR, HARDWARE, MIXED, OTHER = "door_schedule", "hardware_set", "mixed", "other"


def _said(c: Column, words: list[str]) -> Column:
    """How many of these words the text contains."""
    return sum((c.contains(w).cast("int") for w in words), F.lit(0))


def _year(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int").between(1900, 2099), F.lit(False))


def _signals(r: Column) -> Column:
    upper = r["upper"]
    return F.struct(
        F.size(F.filter(r["marks"], lambda m: ~_year(m))).alias("real_doors"), r["dimensions"].alias("dimensions"), rows_with(r, V.SIGNAL_ROW_WORDS).alias("row_lines"), _said(upper, V.SIGNAL_HEADERS).alias("table_headers"),
        _said(upper, V.SIGNAL_HARDWARE).alias("hw_keywords"), _said(upper, V.SIGNAL_TITLES).alias("title_block_markers"),
    )


def signals(c: Column) -> Column:
    """The lighter counts of a page as one struct; words count once each, marks every time."""
    return bound(read(c), _signals)


def is_fragmented(c: Column) -> Column:
    """Tables cut into many tiny cells, or headers cut by a pipe; a text without table lines is none."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: F.ltrim(x).startswith("|"))
    broken = F.lit(False)
    for p in V.BROKEN_COLUMNS:
        broken = broken | c.rlike(p)

    def test(head: Column) -> Column:
        pipes = F.aggregate(head, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"\|")))
        narrow = F.regexp_count(c, F.lit(r"\|\s*[A-Z0-9\"'./-]{1,3}\s*(?=\|)"))
        return (F.size(head) > 0) & (broken | ((pipes / F.greatest(F.size(head), F.lit(1)) >= 18) & (narrow >= 25)))

    return F.coalesce(bound(F.slice(lines, 1, 20), test), F.lit(False))


def content_score(c: Column) -> Column:
    """How much a text has that a schedule has, less its garbage."""
    text = F.coalesce(c, F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))

    def score(s: Column) -> Column:
        gains = count(r"\b\d{3,4}[A-Za-z]?\b") * 3.0 + count(r"\d+'-\d+\"") * 2.0 + count(V.SCORED_HARDWARE) * 5.0 + count("===") * 1.0 + count(r"\|") * 0.1
        gains = gains + s["real_doors"] * 2.0 + s["dimensions"] * 1.5 + s["row_lines"] * 4.0 + s["table_headers"] * 1.5 + s["hw_keywords"] * 3.0
        whole = gains * F.when(is_fragmented(text), 0.45).otherwise(1.0) - count(V.CID) * 10.0 - count(r"[^\x20-\x7E\n\r\t]") * 0.5
        return F.greatest(F.lit(0.0), whole * F.when(F.length(text) < 100, 0.5).otherwise(1.0))

    return F.when(text == "", 0.0).otherwise(bound(signals(text), score))


def _page_type(r: Column, answer: Column) -> Column:
    upper = r["upper"]
    marks = F.size(F.array_distinct(r["marks"]))
    set_column, blocks = any_of(upper, V.SET_COLUMNS), upper.rlike(V.SET_BLOCKS)
    components = F.regexp_count(upper, F.lit(V.PAGE_PARTS)) >= 2
    said = F.upper(answer)
    later = (F.regexp_count(upper, F.lit(V.LATER_PARTS)) >= 2) & upper.rlike(V.LATER_SETS)
    answered = F.when(said.contains("MIXED") | said.contains("BOTH"), MIXED).when(said.contains("DOOR"), F.when(later, MIXED).otherwise(DOOR)).when(said.contains("HARDWARE") | said.contains("HDWR"), HARDWARE).otherwise(OTHER)
    plain = (r["dimensions"] < 2) & (rows_with(r, V.SIGNAL_ROW_WORDS) < 2) & (F.size(F.filter(r["marks"], lambda m: ~_year(m))) < 4)
    prose = (_said(upper, V.SPEC_PROSE) >= 3) & ~blocks & ~(set_column & (marks >= 4)) & plain
    return (
        F.when(~any_of(upper, V.SCHEDULE_TERMS), OTHER)
        .when(upper.contains("OPENING LIST") & set_column & (marks >= 4), DOOR)
        .when(upper.rlike(V.SET_DESCRIPTIONS), HARDWARE)
        .when(prose, OTHER)
        .when(upper.rlike(r"\b(?:MANUFACTURER|OPTION|FINISH)\s+LIST\b") & ~blocks, OTHER)
        .when(blocks & components, F.when(r["dimensions"] >= 2, MIXED).otherwise(HARDWARE))
        .otherwise(answered)
    )


def _backstopped(kind: Column, r: Column, e: Column) -> Column:
    upper = r["upper"]
    sized = r["text"].rlike("\\d+['’]\\s*-?\\s*\\d+\"")
    numbers = F.size(F.filter(F.regexp_extract_all(r["text"], F.lit(r"\b\d{2,4}[A-Za-z]?\b"), F.lit(0)), lambda m: ~_year(m)))

    def kept(n: Column) -> Column:
        doors, sized = n["doors"], n["sized"]
        j = judged(e)
        signs = j["is_door_schedule"] | j["is_hardware_schedule"] | (any_of(upper, V.BACKSTOP_WORDS) & ((doors >= 2) | sized)) | ((doors >= 5) & sized) | ((doors >= 3) & any_of(upper, V.BACKSTOP_PARTS))
        return F.when(upper.rlike(V.SET_DESCRIPTIONS) & ~sized, HARDWARE).when(signs, MIXED).otherwise(kind)

    return F.when(kind != OTHER, kind).otherwise(bound(F.struct(numbers.alias("doors"), sized.alias("sized")), kept))


def page_type(c: Column, answer: Column) -> Column:
    """The type that fixed rules give, else what the recorded answer of a model says; without one, other.

    A door page with components and set headers in its full text is mixed.
    """
    return bound(read(c), lambda r: _page_type(r, answer))


def backstopped(kind: Column, c: Column) -> Column:
    """Pages called other that have the signs of a schedule are mixed, or hardware if they describe sets without a size."""
    return F.when(kind != OTHER, kind).otherwise(bound(read(c), lambda r: bound(evidence_of(r), lambda e: _backstopped(kind, r, e))))


def classified(c: Column, answer: Column) -> Column:
    """X10, X19 and X20 of a page that is read once: (kind, e), its type after the backstop and its evidence."""

    def both(r: Column) -> Column:
        found = F.struct(_page_type(r, answer).alias("type"), evidence_of(r).alias("e"))
        return bound(found, lambda x: F.struct(_backstopped(x["type"], r, x["e"]).alias("kind"), x["e"].alias("e")))

    return bound(read(c), both)


def is_native_text(c: Column) -> Column:
    """Whether a document's own text is good enough: long, in the trade's words, and with a schedule's heading."""
    text = F.coalesce(c, F.lit(""))
    words = sum((text.rlike(rf"(?i)\b{w}\b").cast("int") for w in V.NATIVE_WORDS), F.lit(0))
    return (F.length(F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))) >= 2500) & (words >= 3) & (text.rlike(V.NATIVE_DOORS) | text.rlike(V.NATIVE_HARDWARE))


def is_page_skipped(c: Column, kind: Column, is_continuation: Column, crops: Column) -> Column:
    """F8: pages with hardly any text, and other pages that go on from nothing and have no crops."""
    return (F.length(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))) < 30) | ((kind == OTHER) & ~is_continuation & (crops == 0))


def merged_backends(markdown: Column, tables: Column, plain: Column, rows: Column, images: Column, limit: int = 14000) -> Column:
    """One text of what several extractors give of a page: tables by score within a budget, then the plain text, head and tail."""
    names = ["pymupdf4llm", "pdfplumber_tables", "pdfplumber_rows", "img2table"]
    given = F.struct(*(F.coalesce(c, F.lit("")).alias(k) for k, c in zip(["md", "tables", "plain", "rows", "images"], [markdown, tables, plain, rows, images])))

    def merged(g: Column) -> Column:
        scores = F.struct(content_score(g["md"]).alias("md"), content_score(g["tables"]).alias("tables"), (content_score(g["rows"]) + 12.0).alias("rows"), (content_score(g["images"]) * 0.5).alias("images"), is_fragmented(g["tables"]).alias("cut"))
        return bound(scores, lambda s: joined(g, s))

    def joined(g: Column, s: Column) -> Column:
        good = F.greatest(s["md"], s["tables"]) > 30
        ranked = [s["md"], s["tables"] * F.when(s["cut"], 0.4).otherwise(1.0), s["rows"] + F.when(s["cut"], 20.0).otherwise(0.0), F.when(good, 0.0).otherwise(s["images"])]
        sources = F.array(*(F.struct((-r).alias("rank"), F.lit(i).alias("at"), F.lit(n).alias("name"), g[k].alias("text")) for i, (n, r, k) in enumerate(zip(names, ranked, ["md", "tables", "rows", "images"]))))
        reserve = F.when(F.length(g["plain"]) > 200, F.lit(min(5000, limit // 3))).otherwise(0)
        reserve = F.when(s["cut"] & (reserve > 0), F.least(F.lit(limit // 2), reserve + 1500)).otherwise(reserve)

        def step(a: Column, x: Column) -> Column:
            used = (F.length(x["text"]) > 50) & (a["left"] > 0)
            chunk = F.substring(x["text"], F.lit(1), a["left"])
            return F.when(used, F.struct((a["left"] - F.length(chunk) - 50).alias("left"), F.concat(a["parts"], F.array(F.concat(F.lit("[Source: "), x["name"], F.lit("]\n"), chunk))).alias("parts"))).otherwise(a)

        start = F.struct((F.lit(limit) - reserve).cast("int").alias("left"), F.array().cast("array<string>").alias("parts"))
        parts = F.aggregate(F.array_sort(sources), start, step, lambda a: a["parts"])
        budget, n = F.greatest(reserve, F.lit(500)), F.length(g["plain"])
        head = F.least(F.lit(1800), F.floor(budget / 2)).cast("int")
        tail = F.greatest(F.lit(400), budget - head - 32)
        ends = F.concat(F.substring(g["plain"], F.lit(1), head), F.lit("\n\n[...text trimmed...]\n\n"), F.substring(g["plain"], n - tail + 1, tail))
        text = F.when(n <= budget, g["plain"]).when(budget >= 1600, ends).otherwise(F.substring(g["plain"], F.lit(1), budget))
        all_ = F.concat(parts, F.when(n > 100, F.array(F.concat(F.lit("[Source: plain_text]\n"), text))).otherwise(F.array().cast("array<string>")))
        return F.substring(F.btrim(F.array_join(all_, "\n\n"), F.lit(" \t\n\r\x0b\x0c")), 1, limit)

    return bound(given, merged)
