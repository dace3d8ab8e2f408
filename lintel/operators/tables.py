"""Door rows of pipe tables: five table shapes, each a test and a projection of one line's cells, and the choice among them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import bound, squeeze, strip, text
from lintel.functions.pages import split_row
from lintel.functions.predicates import any_of, is_mark_token, is_self_reference, is_set_token

FIELDS = [
    "door_number", "from_room", "room_name", "door_type", "door_width", "door_height", "door_thickness", "door_material", "door_finish", "frame_type", "frame_material", "frame_finish",
    "head_jamb_sill_detail", "fire_rating", "hardware_set", "remarks", "keyed_notes",
]
#: Rows that a shape must give before it is believed.
LEAST_ROWS = 3
_CELLS = "array<string>"


def is_dimension(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(f"^{V.TABLE_DIMENSION}$"), F.lit(False))


def dimensions(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(V.TABLE_DIMENSION), F.lit(0))


def both_dimensions(c: Column) -> Column:
    """[width, height] of a cell 'W x H', else null."""
    form = f"({V.TABLE_DIMENSION})\\s*[xX]\\s*({V.TABLE_DIMENSION})"
    return F.when(c.rlike(form), F.array(F.regexp_extract(c, form, 1), F.regexp_extract(c, form, 2)))


def marked(c: Column, leading: bool = False) -> Column:
    """(mark, note) of a cell that is a door mark, with a keyed note's number or, if leading, any text behind it; else null."""

    def read(s: Column, form: str, note: Callable[[Column], Column]) -> Column:
        mark = F.regexp_extract(s, form, 1)
        return F.when(s.rlike(form) & is_mark_token(mark), F.struct(mark.alias("mark"), F.nullif(note(F.regexp_extract(s, form, 2)), F.lit("")).alias("note")))

    exact = lambda s: read(s, V.MARK_CELL, lambda n: n)
    either = lambda s: F.coalesce(exact(s), read(s, V.MARK_LEAD, lambda n: strip(n, " '\"-:;")))
    return bound(text(c), either if leading else exact)


def best_mark(cells: Column) -> Column:
    """(score, at, mark, note) of the most likely door mark in the first six cells; at: minus its place. Null if there is none.

    Dimensions behind a mark speak for it; a mark right behind it, or the word NOTE before it, against it.
    """

    def scored(c: Column, i: Column) -> Column:
        tail = F.slice(cells, i + 2, F.lit(9))
        following = F.get(F.filter(tail, lambda x: x.isNotNull()), F.lit(0))
        before = F.when(i > 0, F.get(cells, i - 1))

        def score(m: Column) -> Column:
            points = F.size(F.filter(tail, is_dimension)) * 4
            points = points + F.when(following.isNull(), 0).when(marked(following).isNotNull(), -8).otherwise(4)
            points = points + F.when(m["mark"].rlike("[A-Za-z]"), 2).when(m["mark"].rlike(r"^\d{3,4}$"), 1).otherwise(0)
            return points - F.when(before.rlike(r"(?i)\bNOTES?\b"), 4).otherwise(0)

        return bound(marked(c), lambda m: F.when(m.isNotNull(), F.struct(score(m).alias("score"), (-i).alias("at"), m["mark"].alias("mark"), m["note"].alias("note"))))

    return F.array_max(F.filter(F.transform(F.slice(cells, 1, 6), scored), lambda x: x.isNotNull()))


def fire_rating_cell(c: Column) -> Column:
    """A cell that names minutes or hours, else null."""
    return F.when(c.rlike(r"(?i)\b(?:MIN|HR|HOUR)\b"), strip(c))


def set_from_tail(tail: Column) -> Column:
    """The set of a row whose cells have lost their columns: at its place, behind a rating or a detail, or the last that reads like one."""
    at = lambda i: F.get(tail, F.lit(i))
    good = lambda c: F.coalesce(is_set_token(c), F.lit(False))
    rated = r"(?i)\b(?:\d+\s*(?:MIN|HR)|\d+\s*HOUR)\.?\s+([A-Z]?\d{1,2}[A-Z]?)\b"
    detail = r"(?i)^[A-Z]\d+(?:\.\d+)?/\d+$"

    def beside(c: Column, i: Column) -> Column:
        later = F.get(F.filter(F.slice(tail, i + 2, F.lit(4)), good), F.lit(0))
        return F.when(c.rlike(rated), F.regexp_extract(c, rated, 1)).when(strip(c).rlike(detail), strip(later))

    placed = F.when(fire_rating_cell(at(15)).isNotNull() & good(at(16)), strip(at(16))).when(good(at(15)), strip(at(15))).when(good(at(16)), strip(at(16)))
    near = F.get(F.filter(F.transform(tail, beside), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(placed, near, strip(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(tail, good)), -1)))


def named_set(cells: Column) -> Column:
    """The first set that a cell names behind HW, HDWR or HARDWARE."""
    form = r"(?i)\b(?:HW|HDWR|HARDWARE)\s*[-#:]?\s*([A-Z0-9.-]+)\b"
    found = F.filter(F.transform(cells, lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), form, 1)), lambda s: is_set_token(s))
    return F.get(found, F.lit(0))


def _wide(width: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | width.startswith(s)
    return F.coalesce(out, F.lit(False))


def _row(shape: str, pair: Column, explicit_blank: Column | None = None, **fields: Column) -> Column:
    """One door: blank fields null."""
    named = [F.nullif(fields.get(k, F.lit(None)).cast("string"), F.lit("")).alias(k) for k in FIELDS]
    blank = (F.lit(False) if explicit_blank is None else explicit_blank).alias("explicit_blank")
    return F.struct(F.lit(shape).alias("table_shape"), *named, blank, pair.alias("is_pair"), F.when(pair, 2).otherwise(1).alias("door_leaves"))


def table_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line, cells, source and what the page says) of the pipe lines of pages (page_id, body)."""
    # A source's header stands in a line of its own and holds until the next.
    blocks = pages.select("page_id", F.upper("body").alias("said"), F.posexplode(F.split("body", r"(?m)^(?=\[Source: )")).alias("block_no", "block"))
    opening = F.col("said").contains("OPENING LIST") & any_of(F.col("said"), V.SET_COLUMNS)
    source = F.regexp_extract("block", r"^\[Source: ([^\]\n]*)\][ \t\r]*(?:\n|$)", 1)
    lines = blocks.select("page_id", "block_no", source.alias("source"), opening.alias("is_opening_list"), F.posexplode(F.split("block", r"\r\n|\r|\n")).alias("at", "line"))
    lines = lines.where(F.col("line").contains("|"))
    return lines.select("page_id", (F.col("block_no").cast("long") * 1_000_000 + F.col("at")).alias("line_no"), "source", "is_opening_list", "line", split_row(F.col("line")).alias("cells"))


def compact_row(cells: Column, found: Column) -> Column:
    """R2: mark, type, 'W x H', frame, set and remarks; found: (at, mark, note) of the first mark with both dimensions two cells on."""
    get = lambda i: F.get(cells, found["at"] + i)
    size, raw = both_dimensions(get(2)), text(get(4))
    prefixed = r"(?i)^HW[\s#.-]*(.+)$"
    inner = strip(F.regexp_extract(raw, prefixed, 1))
    stays = ~raw.rlike(prefixed) & F.upper(raw).isin(V.EXISTING_SET)
    set_ = F.when(raw.rlike(prefixed), F.when(is_set_token(inner), inner)).when(~stays & is_set_token(raw), raw)
    frame, pair = text(get(3)), _wide(size[0], ["6'", "7'", "8'"])
    row = _row("compact", pair, stays, door_number=found["mark"], door_type=text(get(1)), door_width=size[0], door_height=size[1], frame_type=frame, frame_material=frame, hardware_set=set_, remarks=F.coalesce(found["note"], text(get(5))))
    return F.when(found.isNotNull(), row)


def _compact_mark(cells: Column) -> Column:
    at = lambda c, i: bound(marked(c, True), lambda m: F.when(m.isNotNull(), F.struct(i.alias("at"), m["mark"].alias("mark"), m["note"].alias("note"))))
    fits = lambda x: x.isNotNull() & (F.size(cells) - x["at"] >= 5) & both_dimensions(F.get(cells, x["at"] + 2)).isNotNull()
    return F.get(F.filter(F.transform(cells, at), fits), F.lit(0))


def formal_row(cells: Column, best: Column) -> Column:
    """The 17-column schedule: fixed places behind the mark."""
    tail = F.slice(cells, 1 - best["at"], F.size(cells))

    def row(t: Column) -> Column:
        get = lambda i: F.get(t, F.lit(i))
        pair = _wide(strip(get(3)), ["6'", "7'", "8'"])
        fields = _columns(t, best) | {"door_width": get(3), "door_height": get(4), "door_thickness": get(5), "fire_rating": fire_rating_cell(get(15)), "hardware_set": set_from_tail(t)}
        return F.when((F.size(t) >= 17) & is_dimension(get(3)) & is_dimension(get(4)), _row("formal", pair, **fields))

    return F.when((F.size(cells) >= 17) & best.isNotNull(), bound(tail, row))


def _columns(tail: Column, best: Column) -> dict[str, Column]:
    get = lambda i: F.get(tail, F.lit(i))
    places = {"from_room": 1, "room_name": 2, "door_material": 6, "door_type": 7, "door_finish": 8, "frame_material": 9, "frame_type": 10, "frame_finish": 11, "remarks": 17}
    return {k: get(i) for k, i in places.items()} | {"door_number": best["mark"], "keyed_notes": best["note"], "head_jamb_sill_detail": F.array_join(F.array_compact(F.slice(tail, 13, 3)), " / ")}


def opening_row(cells: Column, is_opening_list: Column) -> Column:
    """An opening list: mark, set, and the types in the last cells."""
    n = F.size(cells)
    kind = F.when(n >= 4, F.get(cells, n - 2)).when(n == 3, F.get(cells, F.lit(2)))
    good = is_opening_list & (n >= 2) & is_mark_token(F.get(cells, F.lit(0))) & is_set_token(F.get(cells, F.lit(1)))
    return F.when(good, _row("opening_list", F.lit(False), door_number=F.get(cells, F.lit(0)), hardware_set=F.get(cells, F.lit(1)), door_type=kind, frame_type=F.when(n >= 4, F.get(cells, n - 1))))


def packed_row(cells: Column) -> Column:
    """Width, height, thickness and type in one cell; the last cell behind it that ends in a set id names the set."""
    number = text(F.get(cells, F.lit(0)))
    year = F.regexp_extract(number, r"^(\d+)", 1).try_cast("int").between(1900, 2099)
    is_number = is_mark_token(number) | (number.rlike(r"(?i)^\d{1,4}[A-Z]?$") & ~F.coalesce(year, F.lit(False)))
    sized = F.filter(F.transform(F.slice(cells, 3, 5), lambda c, i: F.struct((i + 2).alias("at"), c.alias("cell"), dimensions(c).alias("dims"))), lambda x: F.size(x["dims"]) >= 2)
    ends = r"(?i)(?:^|\s)([A-Z]?\d{1,3}[A-Z]?|\d{1,2}\.\d)\s*$"
    said = text(F.get(cells, F.lit(1)))
    room = strip(F.regexp_replace(said, r"(?i)\s+(?:NEW|EXISTING|EXIST)\s*$", ""))

    def row(x: Column) -> Column:
        rest = F.aggregate(x["dims"], x["cell"], lambda a, d: F.replace(a, d, F.lit(" ")))
        named = F.filter(F.slice(cells, x["at"] + 2, F.lit(7)), lambda c: F.coalesce(~F.upper(c).isin(V.STATUS_WORDS) & ~c.contains(",") & ~is_dimension(c) & c.rlike(ends), F.lit(False)))
        sets = F.filter(F.transform(named, lambda c: F.regexp_extract(c, ends, 1)), is_set_token)
        pair = _wide(strip(x["dims"][0]), ["6'", "7'", "8'"])
        return _row(
            "packed_dimension", pair, door_number=number, room_name=F.when(room != "", room).otherwise(said), door_width=x["dims"][0], door_height=x["dims"][1], door_thickness=F.get(x["dims"], F.lit(2)),
            door_type=strip(squeeze(rest), " -"), hardware_set=F.get(sets, F.size(sets) - 1),
        )

    return F.when((F.size(cells) >= 7) & is_number, bound(F.get(sized, F.lit(0)), lambda x: F.when(x.isNotNull(), row(x))))


def general_row(line: Column, cells: Column, best: Column) -> Column:
    """Any row with a mark and two dimensions."""
    tail = F.slice(cells, 1 - best["at"], F.size(cells))
    pair_cell = lambda t: F.get(F.filter(F.transform(t, both_dimensions), lambda x: x.isNotNull()), F.lit(0))

    def row(t: Column, d: Column) -> Column:
        wide = _wide(strip(d[0]), ["6'"])
        fields = _columns(t, best) | {"door_width": d[0], "door_height": d[1], "door_thickness": F.coalesce(F.get(d, F.lit(2)), F.get(t, F.lit(5))), "fire_rating": F.get(t, F.lit(15)), "hardware_set": F.when(F.size(t) > 15, set_from_tail(t))}
        return F.when(F.size(d) >= 2, _row("general", wide, **fields))

    sized = lambda t: bound(F.coalesce(pair_cell(t), dimensions(line)), lambda d: row(t, d))
    return F.when((F.size(cells) >= 4) & best.isNotNull() & ~any_of(F.upper(line), V.COMPONENT_ROWS), bound(tail, sized))


def embedded_row(line: Column, cells: Column) -> Column:
    """A first cell that ends in a mark, with the room before it, and 'W x H' anywhere."""
    first = text(F.get(cells, F.lit(0)))
    form = r"\b([A-Za-z]{0,3}\d{2,4}[A-Za-z]?)\b\s*$"
    mark = F.regexp_extract(first, form, 1)
    year = F.regexp_extract(mark, r"(\d+)", 1).try_cast("int").between(1900, 2099)
    lead = strip(F.substring(first, F.lit(1), F.length(first) - F.length(F.regexp_substr(first, F.lit(form)))), " -:/")
    room = F.when(is_mark_token(first) | (lead == ""), text(F.get(cells, F.lit(1)))).otherwise(lead)
    size = F.get(F.filter(F.transform(cells, both_dimensions), lambda x: x.isNotNull()), F.lit(0))
    good = (F.size(cells) >= 4) & ~any_of(F.upper(line), V.COMPONENT_ROWS) & (is_mark_token(first) | (first.rlike(form) & ~F.coalesce(year, F.lit(False))))
    number = F.when(is_mark_token(first), first).otherwise(mark)
    set_ = named_set(F.slice(cells, 4, F.size(cells)))
    return F.when(good, bound(size, lambda d: F.when(d.isNotNull(), _row("embedded", _wide(d[0], ["2 @", "6'"]), door_number=number, room_name=room, door_width=d[0], door_height=d[1], hardware_set=set_))))


def stream_rows(pages: DataFrame) -> DataFrame:
    """Doors of schedules whose rows have run together: a mark with two dimensions among the nine cells behind it."""
    per_line = F.transform(F.split("body", r"\r\n|\r|\n"), split_row)
    cells = pages.where(F.upper("body").contains("DOOR SCHEDULE")).select("page_id", F.filter(F.flatten(per_line), lambda c: c.isNotNull()).alias("cells"))
    marks = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("at"), c.alias("mark"))), lambda x: is_mark_token(x["mark"]) & ~F.upper(x["mark"]).isin(V.TABLE_WORDS))
    ahead = cells.select("page_id", F.explode(F.transform(marks, lambda x: F.struct(x["at"].alias("at"), x["mark"].alias("mark"), F.slice("cells", x["at"] + 2, F.lit(9)).alias("ahead")))).alias("x")).select("page_id", "x.*")
    ahead = ahead.withColumn("dims", F.filter("ahead", is_dimension)).where(F.size("dims") >= 2)
    first = F.array_position("ahead", F.get("dims", F.lit(0)))
    between = F.filter(F.slice("ahead", F.lit(1), (first - 1).cast("int")), lambda c: ~is_mark_token(c) & ~F.upper(c).isin(V.TABLE_WORDS))
    width = F.get("dims", F.lit(0))
    row = _row("stream", _wide(width, ["2 @", "6'"]), door_number=F.col("mark"), room_name=F.array_join(between, " "), door_width=width, door_height=F.get("dims", F.lit(1)), hardware_set=named_set(F.col("ahead")))
    return ahead.select("page_id", F.col("at").cast("long").alias("line_no"), row.alias("row"))


def parsed_rows(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, table_shape, fields): what each shape finds in each line, before any choice."""
    lines = table_lines(pages)
    lines = lines.withColumn("best", best_mark(F.col("cells"))).withColumn("first", F.when(F.col("source").isin(V.TABLE_SOURCES), _compact_mark(F.col("cells"))))
    line, cells, best = F.col("line"), F.col("cells"), F.col("best")
    formal = F.when(F.col("source") == V.TABLE_SOURCES[0], formal_row(cells, best))
    shapes = [compact_row(cells, F.col("first")), formal, opening_row(cells, F.col("is_opening_list")), packed_row(cells), general_row(line, cells, best), embedded_row(line, cells)]
    found = lines.select("page_id", "line_no", F.explode(F.array_compact(F.array(*shapes))).alias("row"))
    return found.unionByName(stream_rows(pages)).select("page_id", "line_no", "row.*")


def table_doors(pages: DataFrame) -> DataFrame:
    """Doors of pages (page_id, body), each once a page, its richest row; of the first shape that gives LEAST_ROWS doors
    (compact, formal, opening list, packed), else of all rows with a mark and dimensions."""
    page = Window.partitionBy("page_id")
    rows = parsed_rows(pages)
    counted = lambda shape: F.count_if(F.col("table_shape") == shape).over(page)
    rows = rows.withColumn("n_general", counted("general")).withColumn("n_embedded", F.when(F.col("n_general") < LEAST_ROWS, counted("embedded")).otherwise(0))
    loose = (F.col("table_shape") == "general") | ((F.col("table_shape") == "embedded") & (F.col("n_general") < LEAST_ROWS)) | ((F.col("table_shape") == "stream") & (F.col("n_general") + F.col("n_embedded") < LEAST_ROWS))
    strict = F.col("table_shape").isin(V.TABLE_SHAPES)
    rows = rows.where(loose | strict).withColumn("family", F.when(strict, F.col("table_shape")).otherwise("loose"))
    filled = sum(((F.coalesce(F.col(k), F.lit("N/A")) != "N/A").cast("int") for k in FIELDS), F.lit(0))
    rank = F.when(F.col("table_shape") == "stream", 2).when(F.col("table_shape") == "embedded", 1).otherwise(0)
    richest = Window.partitionBy("page_id", "family", F.upper("door_number")).orderBy(filled.desc(), rank, "line_no")
    once = rows.withColumn("nth", F.row_number().over(richest)).where("nth = 1")
    enough = [F.when(F.count_if(F.col("family") == s).over(page) >= LEAST_ROWS, s) for s in V.TABLE_SHAPES]
    chosen = once.withColumn("chosen", F.coalesce(*enough, F.lit("loose"))).where("family = chosen")
    own = (F.col("family") != "opening_list") & is_self_reference(F.col("door_number"), F.col("hardware_set"))
    return chosen.withColumn("hardware_set", F.when(~own, F.col("hardware_set"))).select("page_id", "table_shape", *FIELDS, "explicit_blank", "is_pair", "door_leaves")


def is_bad_room(c: Column) -> Column:
    """A room name that is a dimension or a heading."""
    plain = strip(F.regexp_replace(F.upper(text(c)), r"\s+", " "), " .:-")
    return F.coalesce(both_dimensions(c).isNotNull() | is_dimension(c) | plain.isin(V.BAD_ROOMS), F.lit(False))


def with_table_fields(doors: DataFrame, table: DataFrame) -> DataFrame:
    """Doors (page_id, door_number, ...) with what compact and formal table rows say about them.

    Sizes, types and set of the table win; a set that the table leaves out on purpose goes if it only says that the door
    exists; room names that are none go. changed counts the fields that changed.
    """
    fields = ["door_width", "door_height", "door_type", "frame_type", "frame_material"]
    key = lambda c: F.upper(text(F.col(c)))
    trusted = table.where(F.col("table_shape").isin("compact", "formal")).groupBy("page_id", key("door_number").alias("mark"))
    trusted = trusted.agg(F.max(F.struct(*(F.col(f).alias(f"table_{f}") for f in [*fields, "hardware_set"]), "explicit_blank")).alias("t")).select("page_id", "mark", F.lit(True).alias("met"), "t.*")
    rows = doors.withColumn("mark", key("door_number")).join(trusted, ["page_id", "mark"], "left")
    bad = is_bad_room(F.col("room_name"))
    stays = F.col("table_hardware_set").isNull() & F.coalesce(F.col("explicit_blank"), F.lit(False)) & F.coalesce(key("hardware_set").isin(V.EXISTING_SET[:3]), F.lit(False))
    new = {f: F.coalesce(f"table_{f}", f) for f in fields} | {"hardware_set": F.when(~stays, F.coalesce("table_hardware_set", "hardware_set")), "room_name": F.when(~bad, F.col("room_name"))}
    changed = sum((~v.eqNullSafe(F.col(k))).cast("int") for k, v in new.items())
    return rows.select("*", changed.alias("changed"), F.struct(*(v.alias(k) for k, v in new.items())).alias("new")).select("page_id", *(F.col(f"new.{c}").alias(c) if c in new else F.col(c) for c in doors.columns if c != "page_id"), "changed")
