"""Signals and repairs of page texts as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import bound, strip
from lintel.functions.predicates import any_of

_SIGNALS = {"dimensions": V.DIMENSION, "cad_shorthand": V.CAD_SIZE, "schedule_headers": V.PAGE_HEADER, "hw_set_headers": V.SET_HEADER, "hw_components": V.PAGE_COMPONENT, "title_block_markers": V.PAGE_TITLE, "cid_garbage": V.CID}

# Words that drawings print backwards, and what they say, replaced one after the other.
REVERSED_WORDS = {
    "EPYT ROOD": "DOOR TYPE", "TES ERAWDRAH": "HARDWARE SET", "ERAWDRAH": "HARDWARE", "SSENKCIHT ROOD": "DOOR THICKNESS", "SSENKCIHT": "THICKNESS", "WOLLOH LATEM": "HOLLOW METAL",
    "MUNIMULA": "ALUMINUM", "SSALG": "GLASS", "LATEM": "METAL", "STNEMMOC": "COMMENTS", "SELUDEHCS": "SCHEDULES", "TNORFEROTS": "STOREFRONT", "SEPYT ROOD": "DOOR TYPES", "SEPYT": "TYPES",
    "ECNEREFER": "REFERENCE", "ELUDEHCS": "SCHEDULE", "ROTCAF-U": "U-FACTOR", "CGHS": "SHGC", "ETIL ROODTUO": "OUTDOOR LITE", "ETIL ROODNI": "INDOOR LITE", "ECAPS RIA": "AIR SPACE",
    "ROIRETXE": "EXTERIOR", "ROIRETNI": "INTERIOR", "ECAFRUS": "SURFACE", "KCALB": "BLACK", "NOITATNEIRO": "ORIENTATION", "REENWAK": "WAKEENER", "RETNEC": "CENTER", "DEZALG": "GLAZED",
    "LEDOM": "MODEL", "noitpircseD": "Description", "etaD": "Date", "TNEILC": "CLIENT", "SETADPU": "UPDATES", "XENOCA": "ACONEX", "NOITACOL": "LOCATION", ".ON": "NO.", "SKRAMER": "REMARKS",
    "EZIS": "SIZE", "THGIEH": "HEIGHT", "DAEH": "HEAD", "BMAJ": "JAMB", "DLOHSERHT": "THRESHOLD", "NOITAVELE": "ELEVATION", "SETON": "NOTES",
}


def unreversed(c: Column) -> Column:
    """Backward words turned round, in order."""
    for wrong, right in REVERSED_WORDS.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def unprivate(c: Column) -> Column:
    """Text in private-use code points as plain text, where they are a tenth of it or more."""
    private = "".join(chr(0xF000 + i) for i in range(1, 256))
    plain = "".join(chr(i) for i in range(1, 256))
    share = F.regexp_count(c, F.lit(r"[\x{F000}-\x{F0FF}]")) / F.length(c)
    return F.when(share >= 0.1, F.translate(c, private, plain)).otherwise(c)


def unstuttered(c: Column) -> Column:
    """Lines in which every character stands twice, once."""
    def line(x: Column) -> Column:
        bare = F.btrim(x)
        letters = F.regexp_count(bare, F.lit(r"\p{L}"))
        lead = F.regexp_extract(x, r"^(\s*)", 1)
        doubled = (F.length(bare) >= 4) & (letters > F.length(bare) * 0.6) & (F.regexp_replace(bare, r"(.)\1", "") == "")
        return F.when(doubled, F.concat(lead, F.regexp_replace(bare, r"(.)\1", "$1"))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def squeezed_tables(c: Column) -> Column:
    """Runs of spaces as one in lines with a pipe, other lines as they are."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.contains("|"), F.regexp_replace(x, "[ \t]{2,}", " ")).otherwise(x)), "\n")


def is_gibberish(c: Column) -> Column:
    """In a text of 100 characters or more: glyph codes, or too few letters and digits, or too few vowels."""
    alnum = F.regexp_count(c, F.lit("[A-Za-z0-9]"))
    vowels = F.regexp_count(c, F.lit("[AEIOUaeiou]"))
    poor = (alnum / F.length(c) < 0.35) | (vowels / F.greatest(F.lit(1), alnum) < 0.05)
    return F.when(F.coalesce(F.length(c), F.lit(0)) < 100, F.lit(False)).otherwise((F.regexp_count(c, F.lit("cid:")) > 20) | poor)


def read(c: Column) -> Column:
    """What several signals of a page read, each worked out once, as one struct: its text (null as empty), that in capitals, its marks, its
    dimensions, and its lines with a mark. To be bound before use."""
    given = F.coalesce(c, F.lit(""))
    # Two digits stand in every mark, so that most lines need no closer look.
    marked = lambda text: F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(r"\d\d") & x.rlike(V.DOOR_NUMBER))
    lines = lambda text: F.transform(marked(text), lambda x: F.struct(F.upper(x).alias("upper"), x.rlike(V.DIMENSION).alias("sized")))
    return bound(
        given,
        lambda t: F.struct(
            t.alias("text"), F.upper(t).alias("upper"), F.regexp_extract_all(t, F.lit(V.DOOR_NUMBER), F.lit(0)).alias("marks"), F.regexp_count(t, F.lit(V.DIMENSION)).alias("dimensions"), lines(t).alias("lines"),
        ),
    )


def rows_with(r: Column, words: list[str]) -> Column:
    """How many lines of a page that was read have a mark and a dimension or one of these words."""
    return F.size(F.filter(r["lines"], lambda x: x["sized"] | any_of(x["upper"], words)))


def _door_numbers(marks: Column) -> Column:
    found = F.transform(marks, lambda t: F.btrim(t, F.lit("[]")))
    year = lambda t: F.regexp_extract(t, r"(\d+)", 1).try_cast("int").between(1900, 2099)
    return F.array_distinct(F.filter(found, lambda t: ~year(t)))


def door_numbers(c: Column) -> Column:
    """The different door numbers of a page; years are none."""
    return _door_numbers(F.regexp_extract_all(c, F.lit(V.DOOR_NUMBER), F.lit(0)))


def row_lines(c: Column) -> Column:
    """Lines with a door number and a dimension or a schedule word."""
    return F.when(c.isNotNull(), bound(read(c), lambda r: rows_with(r, V.ROW_WORDS)))


def evidence_of(r: Column) -> Column:
    """X10 of a page that was read."""
    c = r["text"]
    broken = F.when(c.contains("|"), sum((c.rlike(p).cast("int") for p in V.BROKEN_COLUMNS), F.lit(0))).otherwise(0)
    counts = [(r["dimensions"] if k == "dimensions" else F.regexp_count(c, F.lit(p))).alias(k) for k, p in _SIGNALS.items()]
    return F.struct(F.size(_door_numbers(r["marks"])).alias("real_door_numbers"), rows_with(r, V.ROW_WORDS).alias("row_lines"), *counts, broken.alias("broken_columns"), F.length(c).alias("text_length"))


def evidence(c: Column) -> Column:
    """All counts of a page as one struct."""
    return bound(read(c), evidence_of)


def judged(e: Column) -> dict[str, Column]:
    """What a page's evidence says. Its thresholds and weights are fixed values, which results depend on."""
    door = (e["row_lines"] >= 2) | ((e["real_door_numbers"] >= 4) & (e["schedule_headers"] >= 3)) | ((e["dimensions"] >= 3) & (e["real_door_numbers"] >= 3))
    hardware = (e["hw_set_headers"] >= 1) & (e["hw_components"] >= 3)
    body = (e["row_lines"] >= 2) | (e["dimensions"] >= 2) | (e["hw_components"] >= 3) | (e["hw_set_headers"] >= 1)
    title = (e["title_block_markers"] >= 2) & ~body & (e["real_door_numbers"] <= 3)
    corrupt = (e["text_length"] > 0) & ((e["cid_garbage"] / F.greatest(e["text_length"], F.lit(1)) > 0.05) | (e["broken_columns"] >= 1))
    sized = F.greatest(F.floor(e["dimensions"] / 3), e["cad_shorthand"])
    weak = F.when(sized > 0, F.least(e["real_door_numbers"], sized)).otherwise(0)
    rows = F.when(e["row_lines"] >= 3, F.when(weak >= e["row_lines"] * 2, F.floor((e["row_lines"] + weak) / 2)).otherwise(e["row_lines"])).otherwise(F.greatest(e["row_lines"], weak))
    sets = F.when(e["hw_components"] < 3, 0).otherwise(F.greatest(F.lit(1), e["hw_set_headers"]))
    gains = e["row_lines"] * 4.0 + e["dimensions"] * 1.5 + e["schedule_headers"] * 1.5 + e["hw_components"] * 2.0 + e["hw_set_headers"] * 3.0 + F.least(e["real_door_numbers"], F.lit(50)) * 0.5
    losses = e["cid_garbage"] * 2.0 + e["broken_columns"] * 8.0 + F.when(title, e["title_block_markers"] * 1.0).otherwise(0.0)
    score = F.when(e["text_length"] <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (gains - losses) / 60.0)))
    return {
        "is_door_schedule": door, "is_hardware_schedule": hardware, "is_title_block_only": title, "is_corrupt": corrupt,
        "expected_door_rows": rows.cast("long"), "expected_hw_sets": sets.cast("long"), "confidence": score,
    }


def chunk_lines(c: Column, limit: int) -> Column:
    """Lines packed in order into chunks of up to limit characters; a longer line is a chunk of its own."""
    none = F.array().cast("array<string>")
    packed = F.aggregate(
        F.split(c, "\n"),
        F.struct(none.alias("done"), F.lit(None).cast("string").alias("open")),
        lambda a, x: F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), x.alias("open")))
        .when(F.length(a["open"]) + 1 + F.length(x) <= limit, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit("\n"), x).alias("open")))
        .otherwise(F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), x.alias("open"))),
    )
    return F.concat(packed["done"], F.array(packed["open"]))


def split_row(c: Column) -> Column:
    """The cells of a pipe row, blank ones null."""
    cells = F.split(F.btrim(F.btrim(c), F.lit("|")), r"\|")
    return F.when(c.contains("|"), F.transform(cells, lambda x: F.nullif(F.btrim(x), F.lit("")))).otherwise(F.array().cast("array<string>"))


#: Pieces of a JSON text: a string, whole or broken off, a bracket, or what stands between. Possessive, so that no matcher recurses.
_JSON_PIECES = r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}\[\]]|[^"{}\[\]]++'


def salvaged_json(c: Column) -> tuple[Column, Column]:
    """A broken JSON text mended in two ways: its open brackets closed in order where it ends with a whole value, and cut back to
    the last whole object or list with the brackets around it closed; null where a way does not apply.

    One fold over strings, brackets and the rest: brackets inside strings do not count, commas before a closing bracket go,
    what follows the first whole value is dropped.
    """
    state = lambda stack, cut, held, done: F.struct(stack.alias("stack"), cut.alias("cut"), held.alias("held"), done.alias("done"))

    def step(a: Column, x: Column) -> Column:
        opens, closes = x["piece"].isin("{", "["), x["piece"].isin("}", "]")
        popped = F.substring(a["stack"], F.lit(1), F.length(a["stack"]) - 1)
        return F.when(a["done"], a).when(opens, state(F.concat(a["stack"], x["piece"]), a["cut"], a["held"], a["done"])).when(closes, state(popped, x["at"], popped, popped == "")).otherwise(a)

    def closed(pieces: Column, n: Column, stack: Column) -> Column:
        kept = F.slice(pieces, F.lit(1), n)
        before_end = lambda x, i: F.coalesce(F.get(kept, i + 1).isin("}", "]"), i + 1 == n) & ~x.startswith('"')
        text = F.array_join(F.transform(kept, lambda x, i: F.when(before_end(x, i), F.regexp_replace(x, r",\s*$", "")).otherwise(x)), "")
        return F.concat(text, F.reverse(F.translate(stack, "{[", "}]")))

    def mended(pieces: Column) -> Column:
        numbered = F.transform(pieces, lambda x, i: F.struct(x.alias("piece"), (i + 1).alias("at")))
        zero = state(F.lit(""), F.lit(0), F.lit(""), F.lit(False))
        last = F.get(pieces, F.size(pieces) - 1)
        whole = last.isin("}", "]") | (last.startswith('"') & last.endswith('"') & (F.length(last) > 1))
        return bound(
            F.aggregate(numbered, zero, step),
            lambda a: F.struct(
                F.when(a["done"], closed(pieces, a["cut"], F.lit(""))).when(whole, closed(pieces, F.size(pieces), a["stack"])).alias("closed"),
                F.when(a["cut"] > 0, closed(pieces, a["cut"], a["held"])).alias("cut"),
            ),
        )

    found = bound(F.regexp_extract_all(strip(c), F.lit(_JSON_PIECES), F.lit(0)), mended)
    return found["closed"], found["cut"]
