"""Queries over whole page texts: tables, hardware layouts, classification and gates, each with its SQL."""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import classify as C
from lintel.functions import pages as G
from lintel.functions import vocabulary as V
from lintel.operators import gates, hardware, rescue, tables
from lintel.operators.distinct import held
from lintel.plans import oracle as O
from lintel.plans import views
from lintel.plans.report_queries import Query
from lintel.plans.storage import settled

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, and its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Planted pages, by page_id; {n} is a number of its own for each page. Each is followed by the page's whole markup.
_TABLES = [
    "[Source: pdfplumber_rows]\nFRAMED OPENING | 6{n} | E | 5'-0\" x 7'-2\" | E | E | NOTE\n[Source: pdfplumber_tables]\n| 611A | B2 | 2'-8\" x 6'-10\" | WD | HW-{n} |\n| 612A | B2 | 2'-8\" x 6'-10\" | WD | existing |\n| 613B note 'x' | B2 | 7'-4\" x 6'-10\" | WD | K613B |\n| K614 | C | 2'-6\" x 6'-8\" | HM | K614 |",
    "[Source: pdfplumber_tables]\n|  |  | 305A | STAIR | FOYER | 7' - 0\" | 6' - 8\" | 0' - 1 3/4\" | HM | CC | PT | HM | 3 | PT |  |  |  | 60 MIN. | {n} | LABEL |  |  |\n|  |  | 305C | YARD | FOYER | 2' - 8\" | 6' - 8\" | 0' - 1 3/4\" | STEEL | DD | GG | STEEL | 4 | GG | A7.10/03 | A7.10/04 | A7.10/05 |  | 6 | K.P. |  |  |\n"
    "| GENERAL NOTES | 7 | 318B | STORE | SOUTH | 2' - 6\" | 6' - 8\" | 0' - 1 3/8\" | SC | B | PLAM | WD | 2 | PT | A7.10/11 | A7.10/12 | A7.10/13 |  | 27 |  |  |  |\n| 422 12 | MUSIC {n} | EG | 2'-6\" | 7'-6\" | 1 3/8\" | SCWD | V-01 | GL2 | F7B | STEEL | PAINT | GL2 | 02/A8.10 | 09/A8.10 | - | 58T | KLMN |  |  |  |",
    "Opening List\nOpening | Hdw Set | Label | Door Type | Frame Type\nE204 | 31 | 45 | P | M{n}\nE205A | 8 |  | Q | N\nW17 | W17 | 90 | P | M\nW18 | {n} | R\n1998 | 3 | x",
    "DOOR SCHEDULE\n6 | LOADING DOCK NEW | NEW PAIR | 7' - 0\" 8' - 0\" 0' - 2\" B | SEE A610 | STEEL | HM | NARROW (3\") {n} | NEW | 5,6\n7 | ARCHIVE | NEW SINGLE | 2' - 10\" 6' - 8\" 0' - 1 3/8\" D | SEE A610 | WOOD | WD | WIDE (6\") 9B | NEW\n9 | KITCHEN | NEW | 3' - 4\" 7' - 2\" E | F2 (SEE A611) 5 | H.M. | - | 15 | NEW",
    "DOOR SCHEDULE\n701 | WIDTH | LANDING\n7'-0\" | 6'-8\" | WD | HW-3 | 702\nATTIC | 2'-8\" | 6'-8\" | 1998 | x | HDWR {n}\nROOM 801 | x | 2'-6\" x 6'-8\" | WD | HW-5",
    "531 | LIBRARY | H4 : EXT | 2'-8\" | 6'-8\" | 1 3/8\" | SCWD | GL3 | F9C | STEEL | PAINT | GL3 | 02/A8.1\n532 | B{n} | 533 | 2'-8\" | 6'-8\" | 1\n5{n} | HINGE | x | 3'-6\" x 3'-6\"",
]
_PARTS = [
    "DOOR HARDWARE SCHEDULE | Hardware Sets |\nSet #6{n} - STORE - WITH DEADBOLT |\n3 Hinge | TA2714 5 x 4 | US32D HA |\n1 Deadbolt | B60-P | SP28, 28AN FL |\n2 Closer | 4110EDA | 691 | NO |\nNOTE: y\nSet #62 - SLIDING\n2 Pull Handle | 77 | US26 | HA |",
    "HARDWARE SCHEDULE\nSET: {n}.0 | SET: 9.0\n3 EA. BUTT HINGE | 1 EA. MORTISE LOCK\n1 EA. RIM EXIT DEVICE | 2 EA. SILENCER | 1 PR BOLT\n1 EA. OVERHEAD STOP | 1 EA. WALL BUMPER\n305 | 2'-8\" | 6'-8\" | 1 3/8\"",
    "Hardware Group No. 02.B | Hardware Group No. {n} | LOG\nProvide | Provide\n2 EA PIVOT HINGE | 7215 | 630 IVE | 4 EA HINGE | 3CB1 5 | 626 IVE | 040\n1 EA RIM CYLINDER | MATCH | BLU | 1 EA FLOOR STOP | FS439 | 626 LCN\n1 EA CLOSER | 4040XP",
    "Hardware Sets\nSet #{n}\n1 SET Seals | 160V | 627 | NGP",
    "SET 5\n1 EA HINGE",
]


def _planted(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """(page_id, body): a planted text and the whole markup of each page."""
    held = F.array(*(F.lit(t) for t in texts))
    text = F.replace(F.element_at(held, (F.col("page_id") % len(texts) + 1).cast("int")), F.lit("{n}"), (F.col("page_id") % 83).cast("string"))
    return views.table(spark, sf_dir, "pages").select("page_id", F.concat(text, F.lit("\n"), F.coalesce("html", F.lit(""))).alias("body"))


def _planted_sql(texts: list[str]) -> str:
    return f"bodies AS (SELECT page_id, replace(held[CAST(page_id % {len(texts)} + 1 AS INT)], '{{n}}', CAST(page_id % 83 AS VARCHAR)) || chr(10) || coalesce(html, '') AS body FROM pages, (SELECT [{O.listed(texts)}] AS held))"


_D = V.TABLE_DIMENSION
_PAIR = f"({_D})\\s*[xX]\\s*({_D})"


def _tok(x: str) -> str:
    """Whether a cell reads like a door mark."""
    return f"(upper({x}) NOT IN ('', 'MARK', 'DOOR', 'NO', 'NUMBER') AND {O.has(x, '^(?:[0-9]{2,4}[A-Za-z]?|[A-Za-z]{1,3}[0-9]{2,4}[A-Za-z]?)$')} AND NOT ({O.has(x, '^[0-9]{2,4}[A-Za-z]?$')} AND coalesce(TRY_CAST(regexp_extract({x}, '^([0-9]+)', 1) AS INT) BETWEEN 1900 AND 2099, false)))"


def _set_tok(x: str) -> str:
    return f"(NOT {O.has(x, '[/' + chr(39) + chr(34) + ']')} AND {O.has(x, '^(?:[A-Z]?[0-9]{1,4}[A-Z]{0,3}(?:-[A-Z0-9]+)?|[A-Z]+-?[0-9]{1,4}[A-Z0-9-]*|[0-9]{1,2}[.][0-9])$', 'i')})"


def _ex(x: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract({x}, {O.text(pattern)}, {group}" + (f", '{flags}')" if flags else ")")


_FIRE = r"\b(?:MIN|HR|HOUR)\b"
_RATED = r"\b(?:[0-9]+\s*(?:MIN|HR)|[0-9]+\s*HOUR)\.?\s+([A-Z]?[0-9]{1,2}[A-Z]?)\b"
_NAMED = r"\b(?:HW|HDWR|HARDWARE)\s*[-#:]?\s*([A-Z0-9.-]+)\b"
_ENDS = r"(?:^|\s)([A-Z]?[0-9]{1,3}[A-Z]?|[0-9]{1,2}\.[0-9])\s*$"
_WIDE3 = "(starts_with(trim(door_width), '6''') OR starts_with(trim(door_width), '7''') OR starts_with(trim(door_width), '8'''))"

#: Lines, cells and marks of page bodies, relationally: one row for each cell.
_CELLS = rf"""
lines0 AS (SELECT page_id, body, unnest(string_split(replace(body, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(body, chr(13), ''), chr(10)), 1) AS ln FROM bodies),
lines1 AS (SELECT *, last_value(nullif(regexp_extract(line, '^\[Source: ([^\]]*)\]\s*$', 1), '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ln) AS source FROM lines0),
lines AS (SELECT page_id, ln, line, source, upper(body) AS said, list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: nullif(trim(x), '')) AS cells FROM lines1 WHERE contains(line, '|')),
cells AS (SELECT page_id, ln, line, source, len(cells) AS n, unnest(cells) AS c, CAST(unnest(range(len(cells))) AS INT) AS i FROM lines),
cell AS (SELECT *, coalesce({O.has('c', f'^{_D}$')}, false) AS dim, {O.has('c', _PAIR)} AS both_, coalesce({_set_tok('c')}, false) AS is_set,
  CASE WHEN {O.has('c', V.MARK_CELL)} AND {_tok(_ex('c', V.MARK_CELL))} THEN {_ex('c', V.MARK_CELL)} END AS mark, nullif({_ex('c', V.MARK_CELL, 2)}, '') AS note,
  CASE WHEN {O.has('c', V.MARK_LEAD)} AND {_tok(_ex('c', V.MARK_LEAD))} THEN {_ex('c', V.MARK_LEAD)} END AS lead_mark, nullif(trim({_ex('c', V.MARK_LEAD, 2)}, ' ''"-:;'), '') AS lead_note FROM cells),
best0 AS (SELECT a.page_id, a.ln, a.i, a.mark, a.note, 4 * count(*) FILTER (b.dim AND b.i BETWEEN a.i + 1 AND a.i + 9) + CASE WHEN min(b.i) FILTER (b.c IS NOT NULL AND b.i BETWEEN a.i + 1 AND a.i + 9) IS NULL THEN 0
    WHEN arg_min(b.mark IS NOT NULL, b.i) FILTER (b.c IS NOT NULL AND b.i BETWEEN a.i + 1 AND a.i + 9) THEN -8 ELSE 4 END
    + CASE WHEN {O.has('a.mark', '[A-Za-z]')} THEN 2 WHEN {O.has('a.mark', '^[0-9]{3,4}$')} THEN 1 ELSE 0 END - CASE WHEN coalesce(bool_or({O.has('b.c', r'\bNOTES?\b', 'i')}) FILTER (b.i = a.i - 1), false) THEN 4 ELSE 0 END AS score
  FROM cell a JOIN cell b ON a.page_id = b.page_id AND a.ln = b.ln WHERE a.i < 6 AND a.mark IS NOT NULL GROUP BY a.page_id, a.ln, a.i, a.mark, a.note),
best AS (SELECT page_id, ln, arg_max(i, (score, -i)) AS spot, arg_max(mark, (score, -i)) AS mark, arg_max(coalesce(note, ''), (score, -i)) AS note FROM best0 GROUP BY ALL)"""

_OPENING = f"contains(said, 'OPENING LIST') AND {O.contains_any('said', V.SET_COLUMNS)}"


def _fields(shape: str, given: dict[str, str], where: str, source: str, pair: str, blank: str = "false") -> str:
    """One shape's rows from a relation, blank fields null."""
    named = ", ".join(f"nullif({given.get(f, 'CAST(NULL AS VARCHAR)')}, '') AS {f}" for f in tables.FIELDS)
    return f"SELECT page_id, ln, '{shape}' AS table_shape, {named}, {blank} AS explicit_blank, {pair} AS pair_ FROM {source} WHERE {where}"


_COLUMNS = {"from_room": "t[2]", "room_name": "t[3]", "door_material": "t[7]", "door_type": "t[8]", "door_finish": "t[9]", "frame_material": "t[10]", "frame_type": "t[11]", "frame_finish": "t[12]", "remarks": "t[18]", "door_number": "mark", "keyed_notes": "note", "head_jamb_sill_detail": "array_to_string(list_filter(t[13:15], lambda x: x IS NOT NULL), ' / ')"}
_SHAPES = rf"""
compact0 AS (SELECT a.page_id, a.ln, min(a.i) AS spot FROM cell a JOIN cell s ON a.page_id = s.page_id AND a.ln = s.ln AND s.i = a.i + 2 AND s.both_ WHERE coalesce(a.mark, a.lead_mark) IS NOT NULL AND a.n - a.i >= 5 AND a.source IN ({O.listed(V.TABLE_SOURCES)}) GROUP BY ALL),
compact1 AS (SELECT l.page_id, l.ln, coalesce(c.mark, c.lead_mark) AS mark, CASE WHEN c.mark IS NOT NULL THEN c.note ELSE c.lead_note END AS note, l.cells[spot + 1:] AS t FROM compact0 JOIN lines l USING (page_id, ln) JOIN cell c ON c.page_id = l.page_id AND c.ln = l.ln AND c.i = spot),
compact2 AS (SELECT *, coalesce(t[5], '') AS raw, {_ex('t[3]', _PAIR, 1)} AS door_width, {_ex('t[3]', _PAIR, 2)} AS h FROM compact1),
compact3 AS (SELECT *, CASE WHEN {O.has('raw', r'^HW[\s#.-]*.+$', 'i')} THEN CASE WHEN {_set_tok(_ex('raw', r'^HW[\s#.-]*(.+)$', 1, 'i'))} THEN {_ex('raw', r'^HW[\s#.-]*(.+)$', 1, 'i')} END WHEN upper(raw) IN ({O.listed(V.EXISTING_SET)}) THEN NULL WHEN {_set_tok('raw')} THEN raw END AS hw,
  NOT {O.has('raw', r'^HW[\s#.-]*.+$', 'i')} AND upper(raw) IN ({O.listed(V.EXISTING_SET)}) AS stays FROM compact2),
tails AS (SELECT l.page_id, l.ln, l.line, l.source, b.mark, nullif(b.note, '') AS note, l.cells[b.spot + 1:] AS t, len(l.cells) AS n FROM lines l JOIN best b USING (page_id, ln)),
near0 AS (SELECT c.page_id, c.ln, c.i - b.spot AS k, CASE WHEN {O.has('c.c', _RATED, 'i')} THEN {_ex('c.c', _RATED, 1, 'i')} WHEN {O.has('c.c', r'^[A-Z][0-9]+(?:\.[0-9]+)?/[0-9]+$', 'i')} THEN (SELECT arg_min(s.c, s.i) FROM cell s WHERE s.page_id = c.page_id AND s.ln = c.ln AND s.is_set AND s.i BETWEEN c.i + 1 AND c.i + 4) END AS hw
  FROM cell c JOIN best b USING (page_id, ln) WHERE c.i >= b.spot),
near AS (SELECT page_id, ln, arg_min(hw, k) AS hw FROM near0 WHERE hw IS NOT NULL GROUP BY ALL),
last_ AS (SELECT c.page_id, c.ln, arg_max(c.c, c.i) AS hw FROM cell c JOIN best b USING (page_id, ln) WHERE c.i >= b.spot AND c.is_set GROUP BY ALL),
tailed AS (SELECT a.*, CASE WHEN {O.has('t[16]', _FIRE, 'i')} AND {_set_tok('t[17]')} THEN t[17] WHEN {_set_tok('t[16]')} THEN t[16] WHEN {_set_tok('t[17]')} THEN t[17] ELSE coalesce(near.hw, last_.hw) END AS hw FROM tails a LEFT JOIN near USING (page_id, ln) LEFT JOIN last_ USING (page_id, ln)),
formal AS (SELECT *, t[4] AS door_width FROM tailed WHERE source = 'pdfplumber_tables' AND n >= 17 AND len(t) >= 17 AND {O.has('t[4]', f'^{_D}$')} AND {O.has('t[5]', f'^{_D}$')}),
packed0 AS (SELECT l.page_id, l.ln, l.cells, min(c.i) AS spot FROM lines l JOIN cell c USING (page_id, ln) WHERE len(l.cells) >= 7 AND c.i BETWEEN 2 AND 6 AND len(regexp_extract_all(c.c, {O.text(_D)})) >= 2
  AND ({_tok('l.cells[1]')} OR ({O.has('l.cells[1]', '^[0-9]{1,4}[A-Z]?$', 'i')} AND NOT coalesce(TRY_CAST(regexp_extract(l.cells[1], '^([0-9]+)', 1) AS INT) BETWEEN 1900 AND 2099, false))) GROUP BY ALL),
packed1 AS (SELECT *, cells[spot + 1] AS dc, regexp_extract_all(cells[spot + 1], {O.text(_D)}) AS d, list_filter(list_transform(list_filter(cells[spot + 2:spot + 8], lambda x: x IS NOT NULL AND upper(x) NOT IN ({O.listed(V.STATUS_WORDS)}) AND NOT contains(x, ',') AND NOT {O.has('x', f'^{_D}$')} AND {O.has('x', _ENDS, 'i')}), lambda x: {_ex('x', _ENDS, 1, 'i')}), lambda x: {_set_tok('x')}) AS sets,
  coalesce(cells[2], '') AS said FROM packed0),
packed AS (SELECT *, d[1] AS door_width, nullif(trim({O.sub('said', r'\s+(?:NEW|EXISTING|EXIST)\s*$', '', 'i')}), '') AS room FROM packed1),
general0 AS (SELECT *, coalesce((SELECT [{_ex('c.c', _PAIR, 1)}, {_ex('c.c', _PAIR, 2)}] FROM cell c WHERE c.page_id = x.page_id AND c.ln = x.ln AND c.both_ AND c.i >= (SELECT spot FROM best b WHERE b.page_id = x.page_id AND b.ln = x.ln) ORDER BY c.i LIMIT 1), regexp_extract_all(line, {O.text(_D)})) AS d FROM tailed x WHERE n >= 4 AND NOT {O.contains_any('upper(line)', V.COMPONENT_ROWS)}),
general AS (SELECT *, d[1] AS door_width FROM general0 WHERE len(d) >= 2),
embedded0 AS (SELECT l.page_id, l.ln, l.cells, coalesce(l.cells[1], '') AS f, {_ex("coalesce(l.cells[1], '')", r'\b([A-Za-z]{0,3}[0-9]{2,4}[A-Za-z]?)\b\s*$')} AS m, arg_min([{_ex('c.c', _PAIR, 1)}, {_ex('c.c', _PAIR, 2)}], c.i) AS d FROM lines l JOIN cell c USING (page_id, ln) WHERE c.both_ AND len(l.cells) >= 4 AND NOT {O.contains_any('upper(l.line)', V.COMPONENT_ROWS)} GROUP BY ALL),
embedded AS (SELECT *, d[1] AS door_width, CASE WHEN {_tok('f')} THEN f ELSE m END AS mark, CASE WHEN {_tok('f')} THEN '' ELSE trim(left(f, length(f) - length(m)), ' -:/') END AS lead_, list_filter(list_transform(cells[4:], lambda x: {_ex("coalesce(x, '')", _NAMED, 1, 'i')}), lambda x: x <> '' AND {_set_tok('x')})[1] AS hw FROM embedded0
  WHERE {_tok('f')} OR (m <> '' AND NOT coalesce(TRY_CAST(regexp_extract(m, '([0-9]+)', 1) AS INT) BETWEEN 1900 AND 2099, false))),
flow AS (SELECT page_id, c, dim, row_number() OVER (PARTITION BY page_id ORDER BY ln, i) AS p FROM cell JOIN (SELECT page_id FROM bodies WHERE contains(upper(body), 'DOOR SCHEDULE')) USING (page_id) WHERE c IS NOT NULL),
stream0 AS (SELECT a.page_id, a.p AS ln, a.c AS mark, list(b.c ORDER BY b.p) AS ahead, list(b.c ORDER BY b.p) FILTER (b.dim) AS d, min(b.p) FILTER (b.dim) - a.p AS first_ FROM flow a JOIN flow b ON a.page_id = b.page_id AND b.p BETWEEN a.p + 1 AND a.p + 9 WHERE {_tok('a.c')} AND upper(a.c) NOT IN ({O.listed(V.TABLE_WORDS)}) GROUP BY a.page_id, a.p, a.c),
stream AS (SELECT *, d[1] AS door_width, array_to_string(list_filter(ahead[1:first_ - 1], lambda x: NOT {_tok('x')} AND upper(x) NOT IN ({O.listed(V.TABLE_WORDS)})), ' ') AS room, list_filter(list_transform(ahead, lambda x: {_ex('x', _NAMED, 1, 'i')}), lambda x: x <> '' AND {_set_tok('x')})[1] AS hw FROM stream0 WHERE len(d) >= 2),
shapes AS ({" UNION ALL ".join([
    _fields("compact", {"door_number": "mark", "door_type": "t[2]", "door_width": "door_width", "door_height": "h", "frame_type": "t[4]", "frame_material": "t[4]", "hardware_set": "hw", "remarks": "coalesce(note, t[6])"}, "true", "compact3", _WIDE3, "stays"),
    _fields("formal", _COLUMNS | {"door_width": "t[4]", "door_height": "t[5]", "door_thickness": "t[6]", "fire_rating": f"CASE WHEN {O.has('t[16]', _FIRE, 'i')} THEN t[16] END", "hardware_set": "hw"}, "true", "formal", _WIDE3),
    _fields("opening_list", {"door_number": "cells[1]", "hardware_set": "cells[2]", "door_type": "CASE WHEN len(cells) >= 4 THEN cells[len(cells) - 1] WHEN len(cells) = 3 THEN cells[3] END", "frame_type": "CASE WHEN len(cells) >= 4 THEN cells[len(cells)] END"}, f"{_OPENING} AND len(cells) >= 2 AND {_tok('cells[1]')} AND {_set_tok('cells[2]')}", "lines", "false"),
    _fields("packed_dimension", {"door_number": "cells[1]", "room_name": "coalesce(room, said)", "door_width": "d[1]", "door_height": "d[2]", "door_thickness": "d[3]", "door_type": f"trim({O.sub('list_reduce(list_concat([dc], d), lambda a, x: replace(a, x, chr(32)))', chr(92) + 's+', ' ')}, ' -')", "hardware_set": "sets[len(sets)]"}, "true", "packed", _WIDE3),
    _fields("general", _COLUMNS | {"door_width": "d[1]", "door_height": "d[2]", "door_thickness": "coalesce(d[3], t[6])", "fire_rating": "t[16]", "hardware_set": "CASE WHEN len(t) > 15 THEN hw END"}, "true", "general", "starts_with(trim(door_width), '6''')"),
    _fields("embedded", {"door_number": "mark", "room_name": "coalesce(nullif(lead_, ''), cells[2])", "door_width": "d[1]", "door_height": "d[2]", "hardware_set": "hw"}, "true", "embedded", "(starts_with(door_width, '2 @') OR starts_with(door_width, '6'''))"),
    _fields("stream", {"door_number": "mark", "room_name": "room", "door_width": "d[1]", "door_height": "d[2]", "hardware_set": "hw"}, "true", "stream", "(starts_with(door_width, '2 @') OR starts_with(door_width, '6'''))"),
])})"""  # fmt: skip
_OUT = "page_id, table_shape, " + ", ".join(tables.FIELDS) + ", explicit_blank, is_pair, door_leaves"
_STRICT = O.listed(V.TABLE_SHAPES)
_CHOICE = f"""
loose0 AS (SELECT *, count(*) FILTER (table_shape = 'general') OVER (PARTITION BY page_id) AS g, count(*) FILTER (table_shape = 'embedded') OVER (PARTITION BY page_id) AS e FROM shapes),
loose1 AS (SELECT *, CASE WHEN table_shape IN ({_STRICT}) THEN table_shape ELSE 'loose' END AS family FROM loose0 WHERE table_shape IN ({_STRICT}) OR table_shape = 'general' OR (table_shape = 'embedded' AND g < 3) OR (table_shape = 'stream' AND g + CASE WHEN g < 3 THEN e ELSE 0 END < 3)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, family, upper(door_number) ORDER BY {' + '.join(f"(coalesce({f}, 'N/A') <> 'N/A')::INT" for f in tables.FIELDS)} DESC, CASE table_shape WHEN 'stream' THEN 2 WHEN 'embedded' THEN 1 ELSE 0 END, ln) AS nth FROM loose1) WHERE nth = 1),
picked AS (SELECT *, coalesce({', '.join(f"CASE WHEN count(*) FILTER (family = '{s}') OVER (PARTITION BY page_id) >= 3 THEN '{s}' END" for s in V.TABLE_SHAPES)}, 'loose') AS chosen FROM once)"""


@query(O.chain(_planted_sql(_TABLES), _CELLS, _SHAPES, _CHOICE, select=f"""SELECT {_OUT.replace('hardware_set', "CASE WHEN family = 'opening_list' OR NOT (upper(regexp_replace(coalesce(hardware_set, ''), chr(92) || 's+', '', 'g')) = upper(regexp_replace(door_number, chr(92) || 's+', '', 'g')) AND regexp_matches(upper(door_number), '[A-Z]')) THEN hardware_set END AS hardware_set").replace('is_pair, door_leaves', 'pair_ AS is_pair, CAST(CASE WHEN pair_ THEN 2 ELSE 1 END AS INT) AS door_leaves')} FROM picked WHERE family = chosen"""))
def r6_table_doors(spark, sf_dir):
    return tables.table_doors(_planted(spark, sf_dir, _TABLES))


def _shape(name: str, shape: str, columns: list[str]) -> None:
    """A query of what one shape finds, before any choice."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.parsed_rows(_planted(spark, sf_dir, _TABLES)).where(F.col("table_shape") == shape).select("page_id", *columns, "is_pair")

    QUERIES[name] = run
    SQL[name] = O.chain(_planted_sql(_TABLES), _CELLS, _SHAPES, select=f"SELECT page_id, {', '.join(columns)}, pair_ AS is_pair FROM shapes WHERE table_shape = '{shape}'")


_shape("r2_compact_rows", "compact", ["door_number", "door_type", "door_width", "door_height", "frame_type", "hardware_set", "remarks", "explicit_blank"])
_shape("r3_formal_rows", "formal", tables.FIELDS)
_shape("r4_packed_rows", "packed_dimension", ["door_number", "room_name", "door_width", "door_height", "door_thickness", "door_type", "hardware_set"])
_shape("r5_opening_rows", "opening_list", ["door_number", "hardware_set", "door_type", "frame_type"])
_shape("r7_general_rows", "general", tables.FIELDS)
_shape("w11_stream_rows", "stream", ["door_number", "room_name", "door_width", "door_height", "hardware_set"])


_CODE = r"^(?:(?:US)?[0-9]{3}[A-Z]{0,2}|(?:US)?[0-9]{2}[A-Z]{1,2}|(?:US)?[A-Z]{2}[0-9]{2,4}[A-Z]?)$"


def _finish(x: str) -> str:
    return f"({x} <> '' AND len(list_filter(regexp_split_to_array({x}, '\\s*,\\s*'), lambda p: p <> '' AND NOT {O.has('p', _CODE)})) = 0)"


def _both(x: str, any_maker: bool) -> tuple[str, str]:
    """SQL of the finish and the maker of a cell that ends in a maker behind a finish code, else null."""
    form = r"^\s*(\S+(?:\s+\S+)*)\s+(\S+)\s*$"
    finish, maker = f"upper({O.squeeze(_ex(x, form, 1))})", f"upper({_ex(x, form, 2)})"
    good = f"{O.has(x, form)} AND ({maker} IN ({O.listed(V.VENDOR_MAKERS)}){' OR ' + O.has(maker, '^[A-Z]{3}$') if any_maker else ''}) AND {_finish(finish)}"
    return f"CASE WHEN {good} THEN {finish} END", f"CASE WHEN {good} THEN {maker} END"


def _counted(x: str, form: str, words: list[str], sized: bool) -> str:
    """SQL of a struct of quantity, unit and description of a cell that counts a component, else null."""
    description, unit = f"trim({_ex(x, form, 3)}, ' .')", f"coalesce(nullif(upper({_ex(x, form, 2)}), ''), 'EA')"
    size = "[0-9]+\\s*['’]\\s*-\\s*[0-9]+|[0-9]+/[0-9]+\""
    bare = f" AND NOT ({O.has(description, size)} AND NOT {O.contains_any(f'upper({description})', V.STRONG_COMPONENTS)})" if sized else ""
    return f"CASE WHEN {O.has(x, form)} AND {O.contains_any(f'upper({description})', words)}{bare} THEN {{'q': {_ex(x, form, 1)}, 'u': CASE {unit} WHEN 'PR' THEN 'PAIR' ELSE {unit} END, 'd': {description}}} END"


_CELL = "trim(" + O.squeeze("coalesce(c, '')") + ", ' .')"
_LINES = """
lines0 AS (SELECT page_id, body, unnest(string_split(replace(body, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(body, chr(13), ''), chr(10)), 1) - 1 AS ln FROM bodies),
rows_ AS (SELECT page_id, body, ln, line, CASE WHEN contains(line, '|') THEN list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: nullif(trim(x), '')) END AS cells FROM lines0)"""
_PLACED = ",\n".join(
    f"""p{k} AS (SELECT * REPLACE (CASE WHEN NOT j AND NOT m AND catalog IS NULL THEN e ELSE catalog END AS catalog, CASE WHEN j THEN coalesce(finish, bf) WHEN NOT j AND NOT m AND catalog IS NOT NULL AND finish IS NULL AND {_finish('ue')} THEN ue ELSE finish END AS finish,
  CASE WHEN j THEN coalesce(maker, bm) WHEN m THEN ue ELSE maker END AS maker) FROM (SELECT *, coalesce(bm IS NOT NULL AND catalog IS NOT NULL, false) AS j, NOT coalesce(bm IS NOT NULL AND catalog IS NOT NULL, false) AND coalesce(ue IN ({O.listed(V.VENDOR_MAKERS)}), false) AND maker IS NULL AS m
  FROM (SELECT * EXCLUDE (e, ue, bf, bm, j, m), extras[{k}] AS e, upper(extras[{k}]) AS ue, {_both(f'extras[{k}]', False)[0]} AS bf, {_both(f'extras[{k}]', False)[1]} AS bm FROM p{k - 1})))"""
    for k in range(1, hardware.EXTRAS + 1)
)
_HARDWARE = rf"""
h0 AS (SELECT page_id, ln, cells, list_filter(list_transform(cells, lambda c: rtrim({_ex("coalesce(c, '')", V.GROUP_HEADER)}, '.')), lambda h: h <> '') AS hs FROM rows_ WHERE cells IS NOT NULL AND {O.has('body', V.GROUP_HEADER)}),
h1 AS (SELECT *, last_value(CASE WHEN len(hs) > 0 THEN hs END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ln) AS gs FROM h0),
h2 AS (SELECT page_id, ln, cells, unnest(gs) AS hardware_set_id, CAST(unnest(range(len(gs))) AS INT) AS k FROM h1 WHERE len(hs) = 0 AND gs IS NOT NULL AND len(cells) >= 3 * len(gs)),
h3 AS (SELECT *, cells[3 * k + 1] AS c, cells[3 * k + 2] AS catalog, cells[3 * k + 3] AS f FROM h2),
h4 AS (SELECT page_id, ln * 1000 + k AS pos, hardware_set_id, {_counted(_CELL, V.GRID_COMPONENT, V.CELL_COMPONENTS, True)} AS x, catalog, CASE WHEN {_both("coalesce(f, '')", True)[1]} IS NOT NULL THEN {_both("coalesce(f, '')", True)[0]} ELSE f END AS finish, {_both("coalesce(f, '')", True)[1]} AS maker FROM h3),
groups_ AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM h4 WHERE x IS NOT NULL) WHERE n >= 3),
g0 AS (SELECT page_id, ln, upper(line) AS said, unnest(coalesce(cells, [trim(line, {O.WS})])) AS c, CAST(unnest(range(len(coalesce(cells, [''])))) AS INT) AS col FROM rows_ WHERE {O.has('body', V.GRID_PAGE)}),
g1 AS (SELECT *, nullif(rtrim({_ex("coalesce(c, '')", V.GRID_HEADER)}, '.'), '') AS header FROM g0),
g2 AS (SELECT *, min(ln) FILTER (contains(said, 'HARDWARE SCHEDULE') OR contains(said, 'HARDWARE SET') OR header IS NOT NULL) OVER (PARTITION BY page_id) AS first_ FROM g1),
g3 AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ln, col) AS any_, last_value(header IGNORE NULLS) OVER (PARTITION BY page_id, col ORDER BY ln) AS own FROM g2 WHERE ln >= first_),
g4 AS (SELECT page_id, ln * 1000 + col AS pos, coalesce(own, any_) AS hardware_set_id, {_counted(_CELL, V.GRID_COMPONENT, V.CELL_COMPONENTS, True)} AS x FROM g3 WHERE header IS NULL AND coalesce(own, any_) IS NOT NULL),
grid AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM g4 WHERE x IS NOT NULL) WHERE n >= 3),
v0 AS (SELECT page_id, {O.has('body', V.HARDWARE_TITLE)} AS titled, list_filter(list_transform(regexp_split_to_array(body, '\s*\|\s*|\r?\n+'), lambda t: {O.squeeze('t')}), lambda t: t <> '') AS ts FROM bodies WHERE {O.has('body', V.VENDOR_PAGE)}),
v1 AS (SELECT page_id, titled, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS pos FROM v0),
v2 AS (SELECT *, CASE WHEN {O.has('t', V.VENDOR_HEADER)} THEN {{'id': {_ex('t', V.VENDOR_HEADER)}, 'name': nullif({O.strip(_ex('t', V.VENDOR_HEADER, 2))}, '')}} END AS header, CASE WHEN NOT {O.has('t', V.VENDOR_HEADER)} THEN {_counted('t', V.VENDOR_COMPONENT, V.VENDOR_COMPONENTS, False)} END AS x FROM v1),
v3 AS (SELECT *, header IS NOT NULL OR x IS NOT NULL OR starts_with(upper(t), 'NOTE') AS stop FROM v2),
v4 AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS held, {', '.join(f"lead(t, {k}) OVER o AS t{k}, coalesce(lead(stop, {k}) OVER o, true) AS s{k}" for k in range(1, hardware.EXTRAS + 1))} FROM v3 WINDOW o AS (PARTITION BY page_id ORDER BY pos)),
v5 AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM v4 WHERE x IS NOT NULL AND held IS NOT NULL),
p0 AS (SELECT page_id, pos, held, x, CASE WHEN s1 THEN [] WHEN s2 THEN [t1] WHEN s3 THEN [t1, t2] WHEN s4 THEN [t1, t2, t3] ELSE [t1, t2, t3, t4] END AS extras, CAST(NULL AS VARCHAR) AS catalog, CAST(NULL AS VARCHAR) AS finish, CAST(NULL AS VARCHAR) AS maker, NULL AS e, NULL AS ue, NULL AS bf, NULL AS bm, NULL AS j, NULL AS m FROM v5 WHERE n >= 3 OR titled),
{_PLACED},
every AS (SELECT page_id, 'group' AS layout, pos, hardware_set_id, NULL AS hardware_set_name, x, catalog AS catalog_number, finish AS finish_code, maker AS manufacturer_code FROM groups_ UNION ALL SELECT page_id, 'grid', pos, hardware_set_id, NULL, x, NULL, NULL, NULL FROM grid
  UNION ALL SELECT page_id, 'vendor', pos, held.id, held.name, x, catalog, finish, maker FROM p{hardware.EXTRAS})"""
_VALID = f"""
q0 AS (SELECT page_id, layout, pos, CASE WHEN lower(hardware_set_id) IN ('', 'none', 'null', 'undefined', 'n/a') THEN '' ELSE {O.sub('trim(' + O.sub(O.strip('upper(hardware_set_id)'), '^(?:HW[.\\-\\s]*|HARDWARE[.\\-\\s]*|SET[.\\-\\s]*|GROUP[.\\-\\s]*)', '', '') + ", '. -')", '^([0-9]+)[.]0$', '\\1', '')} END AS hardware_set_id, hardware_set_name, x.d AS description, catalog_number, finish_code, manufacturer_code, NULL AS notes, x.q AS qty_raw, x.u AS unit FROM every),
q1 AS (SELECT * FROM q0 WHERE upper(description) NOT IN ({O.listed(V.COMPONENT_HEADINGS)}) AND {O.component(O.FIELDS)}),
q2 AS (SELECT *, count(*) FILTER (layout = 'group') OVER (PARTITION BY page_id) AS ng, count(*) FILTER (layout = 'grid') OVER (PARTITION BY page_id) AS nr, count(*) FILTER (layout = 'vendor') OVER (PARTITION BY page_id) AS nv FROM q1),
q3 AS (SELECT q2.*, CASE WHEN ng > 0 AND ng >= greatest(nr, nv) THEN 'group' WHEN {O.has('body', V.GRID_SET)} AND nr > 0 THEN 'grid' WHEN nr > nv THEN 'grid' ELSE 'vendor' END AS best_ FROM q2 JOIN bodies USING (page_id))"""


@query(O.chain(_planted_sql(_PARTS), _LINES, _HARDWARE, _VALID, select=f"""SELECT page_id, layout, CAST(pos AS BIGINT) AS pos, {O.sub(O.strip(O.sub('hardware_set_id', '^(?:set|hs|hw|hdwr|group|#|no[.]?)\\s*', '', 'i')), '^([0-9]+)[.]0$', '\\1', '')} AS hardware_set_id, {O.known('hardware_set_name')} AS hardware_set_name, qty_raw, unit, {O.known('description')} AS description, {O.known('catalog_number')} AS catalog_number, {O.known('finish_code')} AS finish_code,
  {O.known('manufacturer_code')} AS manufacturer_code, CASE WHEN {O.has('qty_raw', '^[0-9]+$')} THEN greatest(1, CAST(qty_raw AS BIGINT)) END AS qty FROM q3 WHERE layout = best_"""))
def r10_page_components(spark, sf_dir):
    return hardware.page_components(_planted(spark, sf_dir, _PARTS)).withColumnRenamed("at", "pos")


_RAW = "hardware_set_id, x.q AS qty_raw, x.u AS unit, x.d AS description"


@query(O.chain(_planted_sql(_PARTS), _LINES, _HARDWARE, select=f"SELECT page_id, CAST(pos AS BIGINT) AS pos, {_RAW}, catalog AS catalog_number, finish AS finish_code, maker AS manufacturer_code FROM h4 WHERE x IS NOT NULL"))
def r8_group_rows(spark, sf_dir):
    return hardware.group_rows(_planted(spark, sf_dir, _PARTS)).withColumn("pos", F.col("at").cast("long")).drop("at", "hardware_set_name")


@query(O.chain(_planted_sql(_PARTS), _LINES, _HARDWARE, select=f"SELECT page_id, CAST(pos AS BIGINT) AS pos, {_RAW} FROM grid"))
def w9_grid_rows(spark, sf_dir):
    return hardware.grid_rows(_planted(spark, sf_dir, _PARTS)).select("page_id", F.col("at").cast("long").alias("pos"), "hardware_set_id", "qty_raw", "unit", "description")


@query(O.chain(_planted_sql(_PARTS), _LINES, _HARDWARE, select=f"SELECT page_id, CAST(pos AS BIGINT) AS pos, held.id AS hardware_set_id, held.name AS hardware_set_name, x.q AS qty_raw, x.u AS unit, x.d AS description, catalog AS catalog_number, finish AS finish_code, maker AS manufacturer_code FROM p{hardware.EXTRAS}"))
def r9_vendor_rows(spark, sf_dir):
    return hardware.vendor_rows(_planted(spark, sf_dir, _PARTS)).withColumnRenamed("at", "pos")


#: Planted pages of every kind that the classifier tells apart; both groups above come after these.
_KINDS = [
    "nothing of the trade at all {n}", "DOOR HARDWARE SCHEDULE\nOpening List\nOpening\nHdw Set\nE204\n31\nE205A\n8\nW170\n31\nW18{n}\n5", "HARDWARE SET DESCRIPTIONS\nset {n}",
    "PART 1 GENERAL\nSUBMITTALS and door hardware schedule\nWARRANTY of frames, KEYING", "Manufacturer List\nhinge door codes {n}", "HARDWARE SETS\nSET 1\n3 HINGE\n1 CLOSER\n3'-0\" x 7'-0\"\n4'-0\"", "SET NO. {n}\n3 HINGE\n1 CLOSER 4040",
    "door types 101 102 103 104\nBUTT HINGE, WALL STOP\nSET #4 {n}", "DRAWN BY door SHEET NO 4 CITY 1{n}", "| DOO | R | SCH | EDULE |\n| 101 | 3'-0\" | HM |\n| 102 | 3'-0\" | WD |",
    "| " + " | ".join("A" for _ in range(30)) + " |\n| " + " | ".join("B1" for _ in range(30)) + " |\nframe 2{n}", "(cid:3)(cid:4) opening ‹›", "door 10", "",
]
_ANSWERS = ["MIXED", "door schedule page", "Hardware", "other", None, "both kinds"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, body, answer): planted pages of every kind, with a recorded answer."""
    answers = F.array(*(F.lit(a).cast("string") for a in _ANSWERS))
    return _planted(spark, sf_dir, [*_KINDS, *_TABLES, *_PARTS]).withColumn("answer", F.element_at(answers, (F.col("page_id") % len(_ANSWERS) + 1).cast("int")))


_BODIES = _planted_sql([*_KINDS, *_TABLES, *_PARTS]) + f", asked AS (SELECT *, [{', '.join('NULL' if a is None else O.text(a) for a in _ANSWERS)}][CAST(page_id % {len(_ANSWERS)} + 1 AS INT)] AS answer FROM bodies)"


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {O.text(pattern)}))"


def _said(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {O.text(w)})::INT" for w in words) + ")"


#: Marks stand alone among letters and digits; this engine's patterns cannot look around them, so its runs are taken apart.
_RUN = "^[A-Za-z]{0,3}[0-9]{2,4}[A-Za-z]?$"


def _runs(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda r: {O.has('r', _RUN)})"


def _unyear(runs: str) -> str:
    return f"list_filter({runs}, lambda r: NOT (CAST(regexp_extract(r, '([0-9]+)', 1) AS INT) BETWEEN 1900 AND 2099))"


def _line_count(words: list[str]) -> str:
    return f"len(list_filter(string_split(replace(body, chr(13), ''), chr(10)), lambda x: len({_runs('x')}) > 0 AND ({O.has('x', V.DIMENSION)} OR {O.contains_any('upper(x)', words)})))"


_BROKEN = " + ".join(f"{O.has('body', p)}::INT" for p in V.BROKEN_COLUMNS)
_SIGNALS = f"""
sig AS (SELECT *, len(list_filter(list_distinct({_unyear(_runs('body'))}), lambda r: true)) AS distinct_doors, len(list_distinct({_runs('body')})) AS marks, len({_unyear(_runs('body'))}) AS real_doors, {_n('body', V.DIMENSION)} AS dimensions, {_line_count(V.SIGNAL_ROW_WORDS)} AS row_lines, {_said('u', V.SIGNAL_HEADERS)} AS table_headers, {_said('u', V.SIGNAL_HARDWARE)} AS hw_keywords,
  {_said('u', V.SIGNAL_TITLES)} AS title_block_markers, list_filter(string_split(replace(body, chr(13), ''), chr(10)), lambda x: starts_with(ltrim(x), '|'))[1:20] AS head FROM (SELECT *, upper(body) AS u FROM asked)),
cut AS (SELECT *, len(head) > 0 AND ({_BROKEN} > 0 OR (len(array_to_string(head, '')) - len(replace(array_to_string(head, ''), '|', ''))) / greatest(len(head), 1) >= 18 AND list_sum(list_transform(list_filter(string_split(body, chr(10)), lambda x: contains(x, '|')), lambda x: len(list_filter(string_split(x, '|')[2:-2], lambda c: {O.has('c', r'''^\s*[A-Z0-9"'./-]{1,3}\s*$''')})))) >= 25) AS fragmented FROM sig),
scored AS (SELECT *, CASE WHEN body = '' THEN 0.0 ELSE greatest(0.0, (({_n('body', r'\b[0-9]{3,4}[A-Za-z]?\b')} * 3.0 + {_n('body', chr(91) + "0-9]+'-[0-9]+" + chr(34))} * 2.0 + {_n('body', V.SCORED_HARDWARE)} * 5.0 + {_n('body', '===')} * 1.0 + {_n('body', '[|]')} * 0.1 + real_doors * 2.0 + dimensions * 1.5 + row_lines * 4.0 + table_headers * 1.5 + hw_keywords * 3.0) * CASE WHEN fragmented THEN 0.45 ELSE 1.0 END
  - {_n('body', V.CID)} * 10.0 - {_n('body', '[^' + chr(92) + 'x20-' + chr(92) + 'x7E' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 't]')} * 0.5) * CASE WHEN length(body) < 100 THEN 0.5 ELSE 1.0 END) END AS score FROM cut)"""


@query(O.chain(_BODIES, _SIGNALS, select="SELECT page_id, CAST(real_doors AS INT) AS real_doors, CAST(dimensions AS INT) AS dimensions, CAST(row_lines AS INT) AS row_lines, table_headers, hw_keywords, title_block_markers, fragmented, round(score::DOUBLE, 4) AS score FROM scored"))
def x16_page_signals(spark, sf_dir):
    body = F.col("body")
    return _pages(spark, sf_dir).select("page_id", C.signals(body).alias("s"), C.is_fragmented(body).alias("fragmented"), F.round(C.content_score(body), 4).alias("score")).select("page_id", "s.*", "fragmented", "score")


_MIXED_LATER = f"{_n('u', V.LATER_PARTS)} >= 2 AND {O.has('u', V.LATER_SETS)}"
_CLASS = f"""
kinds AS (SELECT *, CASE WHEN NOT {O.contains_any('u', V.SCHEDULE_TERMS)} THEN 'other' WHEN contains(u, 'OPENING LIST') AND {O.contains_any('u', V.SET_COLUMNS)} AND marks >= 4 THEN 'door_schedule' WHEN {O.has('u', V.SET_DESCRIPTIONS)} THEN 'hardware_set'
  WHEN {_said('u', V.SPEC_PROSE)} >= 3 AND NOT {O.has('u', V.SET_BLOCKS)} AND NOT ({O.contains_any('u', V.SET_COLUMNS)} AND marks >= 4) AND dimensions < 2 AND row_lines < 2 AND real_doors < 4 THEN 'other' WHEN {O.has('u', r'\b(?:MANUFACTURER|OPTION|FINISH)\s+LIST\b')} AND NOT {O.has('u', V.SET_BLOCKS)} THEN 'other'
  WHEN {O.has('u', V.SET_BLOCKS)} AND {_n('u', V.PAGE_PARTS)} >= 2 THEN CASE WHEN dimensions >= 2 THEN 'mixed' ELSE 'hardware_set' END WHEN answer IS NULL THEN 'other' WHEN contains(upper(answer), 'MIXED') OR contains(upper(answer), 'BOTH') THEN 'mixed' WHEN contains(upper(answer), 'DOOR') THEN CASE WHEN {_MIXED_LATER} THEN 'mixed' ELSE 'door_schedule' END
  WHEN contains(upper(answer), 'HARDWARE') OR contains(upper(answer), 'HDWR') THEN 'hardware_set' ELSE 'other' END AS kind FROM scored),
ev AS (SELECT *, {_line_count(V.ROW_WORDS)} AS e_rows, {_n('body', V.PAGE_HEADER)} AS e_headers, {_n('body', V.SET_HEADER)} AS e_sets, {_n('body', V.PAGE_COMPONENT)} AS e_parts, {_n('body', V.PAGE_TITLE)} AS e_title, {_n('body', V.CID)} AS e_cid, {_n('body', V.CAD_SIZE)} AS e_cad, {_BROKEN} AS e_broken, length(body) AS e_len, distinct_doors AS e_doors, dimensions AS e_dims FROM kinds),
jd AS (SELECT *, (e_rows >= 2 OR (e_doors >= 4 AND e_headers >= 3) OR (e_dims >= 3 AND e_doors >= 3)) AS is_door, (e_sets >= 1 AND e_parts >= 3) AS is_hw, greatest(e_dims // 3, e_cad) AS sized FROM ev),
jj AS (SELECT *, CASE WHEN e_rows >= 3 THEN CASE WHEN weak >= e_rows * 2 THEN (e_rows + weak) // 2 ELSE e_rows END ELSE greatest(e_rows, weak) END AS expected_rows, CASE WHEN e_parts < 3 THEN 0 ELSE greatest(1, e_sets) END AS expected_sets FROM (SELECT *, CASE WHEN sized > 0 THEN least(e_doors, sized) ELSE 0 END AS weak FROM jd)),
backed AS (SELECT *, CASE WHEN kind <> 'other' THEN kind WHEN {O.has('u', V.SET_DESCRIPTIONS)} AND NOT sized_ THEN 'hardware_set' WHEN is_door OR is_hw OR ({O.contains_any('u', V.BACKSTOP_WORDS)} AND (nums >= 2 OR sized_)) OR (nums >= 5 AND sized_) OR (nums >= 3 AND {O.contains_any('u', V.BACKSTOP_PARTS)}) THEN 'mixed' ELSE kind END AS final_kind
  FROM (SELECT *, {O.has('body', "[0-9]+['’]\\s*-?\\s*[0-9]+" + chr(34))} AS sized_, len(list_filter(regexp_extract_all(body, {O.text(r'\b[0-9]{2,4}[A-Za-z]?\b')}), lambda r: NOT (CAST(regexp_extract(r, '([0-9]+)', 1) AS INT) BETWEEN 1900 AND 2099))) AS nums FROM jj))"""


@query(O.chain(_BODIES, _SIGNALS, _CLASS, select="SELECT page_id, kind AS page_type, final_kind AS backstopped FROM backed"))
def x19_page_types(spark, sf_dir):
    typed = _pages(spark, sf_dir).withColumn("page_type", C.page_type(F.col("body"), F.col("answer")))
    return typed.select("page_id", "page_type", C.backstopped(F.col("page_type"), F.col("body")).alias("backstopped"))


@query(O.chain(_BODIES, select=f"""SELECT page_id, length(trim(body, {O.WS})) >= 2500 AND {' + '.join(f"{O.has('body', chr(92) + 'b' + w + chr(92) + 'b', 'i')}::INT" for w in V.NATIVE_WORDS)} >= 3 AND ({O.has('body', V.NATIVE_DOORS)} OR {O.has('body', V.NATIVE_HARDWARE)}) AS native FROM bodies"""))
def x25_native_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.is_native_text(F.col("body")).alias("native"))


@query()
def x18_merged_backends(spark, sf_dir):
    """A page's markup, tables, plain text, rows and images as one text of 14,000 characters; tested by hand on small cases."""
    pages, body = _pages(spark, sf_dir), F.col("body")
    lines = F.filter(F.split(body, "\n"), lambda x: x.contains("|"))
    return pages.select("page_id", C.merged_backends(F.lit(None).cast("string"), F.array_join(lines, "\n"), body, F.array_join(F.transform(lines, lambda x: F.replace(x, F.lit("|"), F.lit(" "))), "\n"), F.lit("")).alias("body"))


_RESCUE = """
cnt AS (SELECT *, page_id % 30 AS doors, page_id % 30 % 25 AS unique_, page_id % 30 % 25 * (page_id % 2) AS physical, page_id % 5 AS parts, page_id % 3 AS sets, page_id % 4 AS crops, page_id % 4 * (page_id % 2) AS door_crops FROM backed),
f15 AS (SELECT *, final_kind <> 'hardware_set' AND (final_kind IN ('door_schedule', 'mixed') OR is_door) AND (is_door OR doors > 0) AND ((unique_ = 0 AND (expected_rows >= 5 OR (expected_rows >= 3 AND e_dims >= 3))) OR (expected_rows >= 20 AND unique_ < expected_rows * 0.3 AND expected_rows - unique_ >= 10)
  OR (expected_rows BETWEEN 3 AND 14 AND unique_ > 0 AND unique_ < expected_rows) OR (expected_rows >= 15 AND unique_ > 0 AND unique_ < expected_rows * 0.8 AND expected_rows - unique_ >= 2)) AS door_rescue,
  (final_kind IN ('hardware_set', 'mixed') OR is_hw) AND (is_hw OR parts > 0) AND ((expected_sets >= 2 AND sets = 0) OR (e_parts >= 8 AND parts < 3)) AS hardware_rescue FROM cnt)"""


@query(O.chain(_BODIES, _SIGNALS, _CLASS, _RESCUE, select="""SELECT page_id, door_rescue, hardware_rescue, final_kind <> 'hardware_set' AND crops > 0 AND NOT ((unique_ >= 20 AND physical >= greatest(20, floor(unique_ * 0.8))) OR (final_kind = 'mixed' AND parts >= 50 AND unique_ >= 10 AND physical >= 10)) AND (door_rescue OR (final_kind IN ('door_schedule', 'mixed') AND doors = 0 AND door_crops > 0)
  OR (final_kind IN ('door_schedule', 'mixed') AND door_crops >= 2 AND unique_ < 3 AND (e_doors >= 5 OR e_headers >= 2)) OR (doors > 0 AND physical = 0 AND door_crops > 0)) AS crop_door_rescue, crops > 0 AND (hardware_rescue OR (door_crops > 0 AND (final_kind IN ('hardware_set', 'mixed') OR is_hw) AND ((parts = 0 AND (final_kind IN ('hardware_set', 'mixed') OR e_parts >= 2 OR e_sets >= 1))
  OR (final_kind IN ('hardware_set', 'mixed') AND door_crops >= 2 AND parts < 2 AND e_parts >= 4)))) AS crop_hardware_rescue, CAST(greatest(0, expected_rows - unique_) AS BIGINT) AS door_gap, CAST(greatest(greatest(0, expected_sets - sets) * 3, greatest(0, e_parts - parts)) AS BIGINT) AS hw_gap,
  length(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 30 OR (final_kind = 'other' AND page_id % 2 > 0 AND crops = 0) AS skipped FROM f15"""))
def f15_rescue_gates(spark, sf_dir):
    """F8, F15 to F18 and A27 on every page, with counts of what was found on it."""
    k = F.col("page_id")
    pages = held(_pages(spark, sf_dir), "c", C.classified(F.col("body"), F.col("answer"))).select("page_id", "body", "c.*")
    e, j, kind = F.col("e"), G.judged(F.col("e")), F.col("kind")
    doors, unique, parts, sets, crops = k % 30, k % 30 % 25, k % 5, k % 3, k % 4
    physical, door_crops = unique * (k % 2), crops * (k % 2)
    return pages.select(
        "page_id", gates.needs_door_rescue(kind, e, j, doors, unique).alias("door_rescue"), gates.needs_hardware_rescue(kind, e, j, parts, sets).alias("hardware_rescue"),
        gates.needs_crop_door_rescue(kind, e, j, doors, unique, physical, parts, crops, door_crops).alias("crop_door_rescue"), gates.needs_crop_hardware_rescue(kind, e, j, parts, sets, crops, door_crops).alias("crop_hardware_rescue"),
        gates.gaps(e, j, unique, parts, sets).alias("g"), C.is_page_skipped(F.col("body"), kind, k % 2 == 0, crops).alias("skipped"),
    ).select("*", "g.*").drop("g")


@query(O.chain(_planted_sql(_TABLES), _CELLS, _SHAPES, _CHOICE, f"""t AS (SELECT page_id, upper(door_number) AS m, door_width, door_height, door_type, frame_type, frame_material, hardware_set, explicit_blank FROM picked WHERE family = chosen AND table_shape IN ('compact', 'formal')),
d AS (SELECT page_id, n AS door_number, CASE WHEN n = '611A' THEN '3''-0" x 8''-0"' WHEN n = '612A' THEN 'Door General Notes' ELSE 'HALL' END AS room_name, CASE WHEN page_id % 2 = 0 THEN '9' END AS door_width, 'existing' AS hardware_set FROM pages, (SELECT unnest(['611A', '612A', '318b', '422', '999']) AS n))""",
    select="""SELECT d.page_id, d.door_number, CASE WHEN d.door_number IN ('611A', '612A') THEN NULL ELSE room_name END AS room_name, coalesce(t.door_width, d.door_width) AS door_width, CASE WHEN t.hardware_set IS NULL AND coalesce(explicit_blank, false) THEN NULL ELSE coalesce(t.hardware_set, d.hardware_set) END AS hardware_set FROM d LEFT JOIN t ON d.page_id = t.page_id AND upper(d.door_number) = t.m"""))
def j18_table_fields(spark, sf_dir):
    pages = _planted(spark, sf_dir, _TABLES)
    none = F.lit(None).cast("string")
    room = F.when(F.col("door_number") == "611A", "3'-0\" x 8'-0\"").when(F.col("door_number") == "612A", "Door General Notes").otherwise("HALL")
    doors = pages.select("page_id", F.explode(F.array(*(F.lit(m) for m in ("611A", "612A", "318b", "422", "999")))).alias("door_number")).select(
        "page_id", "door_number", room.alias("room_name"), F.when(F.col("page_id") % 2 == 0, "9").alias("door_width"), none.alias("door_height"), none.alias("door_type"), none.alias("frame_type"), none.alias("frame_material"), F.lit("existing").alias("hardware_set"),
    )
    return tables.with_table_fields(doors, tables.table_doors(pages)).select("page_id", "door_number", "room_name", "door_width", "hardware_set")


_BODY = "(e_rows >= 2 OR e_dims >= 2 OR e_parts >= 3 OR e_sets >= 1)"
_TITLE_ONLY = f"(e_title >= 2 AND NOT {_BODY} AND e_doors <= 3)"
SQL["x10_page_evidence"] = O.chain(
    O.PAGES, "asked AS (SELECT *, NULL AS answer FROM bodies)", _SIGNALS, _CLASS,
    select=f"""SELECT page_id, CAST(e_doors AS INT) AS real_door_numbers, CAST(e_rows AS INT) AS row_lines, e_dims AS dimensions, e_cad AS cad_shorthand, e_headers AS schedule_headers, e_sets AS hw_set_headers, e_parts AS hw_components, e_title AS title_block_markers, e_cid AS cid_garbage, e_broken AS broken_columns, e_len AS text_length,
  is_door AS is_door_schedule, is_hw AS is_hardware_schedule, {_TITLE_ONLY} AS is_title_block_only, e_len > 0 AND (e_cid / greatest(e_len, 1) > 0.05 OR e_broken >= 1) AS is_corrupt, expected_rows AS expected_door_rows, expected_sets AS expected_hw_sets,
  CASE WHEN e_len <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (e_rows * 4.0 + e_dims * 1.5 + e_headers * 1.5 + e_parts * 2.0 + e_sets * 3.0 + least(e_doors, 50) * 0.5 - (e_cid * 2.0 + e_broken * 8.0 + CASE WHEN {_TITLE_ONLY} THEN e_title * 1.0 ELSE 0.0 END)) / 60.0)) END::DOUBLE AS confidence FROM jj""",
)


# Doors and components of each page, and recorded answers, from the page's number.
_DOORS21 = {"door_number": "CASE WHEN i % 4 = 3 THEN '' ELSE concat('D', i % 6) END", "hardware_set": "concat('S', i % 3, '.0')", "door_width": "CASE WHEN (page_id + i) % 3 = 0 THEN '3' END", "door_height": "CAST(NULL AS STRING)", "door_material": "CAST(NULL AS STRING)"}
_MORE21 = {"door_number": "concat('d', i)", "hardware_set": "concat('Set ', i % 5)", "door_width": "CASE WHEN i % 2 = 0 THEN '3' END", "door_height": "CASE WHEN i % 3 > 0 THEN '7' END", "door_material": "CAST(NULL AS STRING)"}
_CROP21 = _MORE21 | {"door_number": "concat('D', i + 2)", "door_material": "'HM'", "hardware_set": "concat('HW-', i % 6)"}
_PARTS21 = {"hardware_set_id": "concat('S', i % 2)", "description": "concat('item ', i % 3)"}
_MORE_PARTS21 = {"hardware_set_id": "concat('S', i % 3)", "description": "concat('ITEM ', i % 5)"}


def _made21(n: str, fields: dict[str, str], **more: str) -> dict[str, str]:
    return {"page_id": "page_id", "row_no": "i"} | fields | more | {"n": n}


_DOOR_ROWS21 = _made21("page_id % 9", _DOORS21)
_DOOR_ANSWERS21 = [_made21("page_id % 26", _MORE21, step="'page'"), _made21("page_id % 14", _CROP21, step="'crop'")]
_PART_ROWS21 = _made21("page_id % 4", _PARTS21)
_PART_ANSWERS21 = [_made21("page_id % 12", _MORE_PARTS21, step="'page'", rank="0"), _made21("page_id % 7", _MORE_PARTS21, step="'crop'", rank="0"), _made21("page_id % 15", {"hardware_set_id": "concat('S', i % 7)", "description": "concat('repaired ', i)"}, step="'repair'", rank="(page_id + i) % 3")]


def _rows21(pages: DataFrame, made: dict[str, str]) -> DataFrame:
    counted = pages.selectExpr("page_id", f"explode(sequence(0, cast({made['n']} as int))) as i").where(f"i < {made['n']}")
    return counted.selectExpr(*(f"{v} as {k}" for k, v in made.items() if k != "n"))


def _sql21(*made: dict[str, str]) -> str:
    one = lambda m: f"SELECT {', '.join(f'{v} AS {k}' for k, v in m.items() if k != 'n')} FROM (SELECT page_id, unnest(range({m['n']})) AS i FROM pages)"
    return " UNION ALL ".join(map(one, made)).replace("STRING", "VARCHAR")


_RICH21 = " + ".join(f"(coalesce(trim({c}), '') NOT IN ({O.listed(V.BLANK)}))::INT" for c in ("door_width", "door_height", "door_material"))


def _sized21(p: str = "") -> str:
    return " OR ".join(f"coalesce(trim({p}{c}), '') <> ''" for c in ("door_width", "door_height", "door_material"))


def _counts21(name: str, doors: str, parts: str) -> str:
    return f"""{name} AS (SELECT b.*, page_id % 4 AS crops, page_id % 4 * (page_id % 2) AS door_crops, coalesce(dn, 0) AS doors, coalesce(un, 0) AS unique_, coalesce(sz, 0) AS physical, coalesce(pn, 0) AS parts, coalesce(sn, 0) AS sets FROM backed b
  LEFT JOIN (SELECT page_id, count(*) AS dn, count(DISTINCT nullif(upper(trim(door_number)), '')) AS un, count(*) FILTER ({_sized21()}) AS sz FROM {doors} GROUP BY 1) USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS pn, count(DISTINCT nullif(upper(trim(hardware_set_id)), '')) AS sn FROM {parts} GROUP BY 1) USING (page_id))"""


_DOOR_GATE21 = """(final_kind <> 'hardware_set' AND (final_kind IN ('door_schedule', 'mixed') OR is_door) AND (is_door OR doors > 0) AND ((unique_ = 0 AND (expected_rows >= 5 OR (expected_rows >= 3 AND e_dims >= 3))) OR (expected_rows >= 20 AND unique_ < expected_rows * 0.3 AND expected_rows - unique_ >= 10)
  OR (expected_rows BETWEEN 3 AND 14 AND unique_ > 0 AND unique_ < expected_rows) OR (expected_rows >= 15 AND unique_ > 0 AND unique_ < expected_rows * 0.8 AND expected_rows - unique_ >= 2)))"""
_HW_GATE21 = "((final_kind IN ('hardware_set', 'mixed') OR is_hw) AND (is_hw OR parts > 0) AND ((expected_sets >= 2 AND sets = 0) OR (e_parts >= 8 AND parts < 3)))"
_CROP_GATE21 = f"""(final_kind <> 'hardware_set' AND crops > 0 AND NOT ((unique_ >= 20 AND physical >= greatest(20, floor(unique_ * 0.8))) OR (final_kind = 'mixed' AND parts >= 50 AND unique_ >= 10 AND physical >= 10)) AND ({_DOOR_GATE21} OR (final_kind IN ('door_schedule', 'mixed') AND doors = 0 AND door_crops > 0)
  OR (final_kind IN ('door_schedule', 'mixed') AND door_crops >= 2 AND unique_ < 3 AND (e_doors >= 5 OR e_headers >= 2)) OR (doors > 0 AND physical = 0 AND door_crops > 0)))"""
_CROP_HW_GATE21 = f"""(crops > 0 AND ({_HW_GATE21} OR (door_crops > 0 AND (final_kind IN ('hardware_set', 'mixed') OR is_hw) AND ((parts = 0 AND (final_kind IN ('hardware_set', 'mixed') OR e_parts >= 2 OR e_sets >= 1)) OR (final_kind IN ('hardware_set', 'mixed') AND door_crops >= 2 AND parts < 2 AND e_parts >= 4)))))"""


def _merged21(name: str, rows: str, answers: str, step: str, counts: str, gate: str, doors: bool) -> str:
    key = "upper(trim(door_number))" if doors else "upper(trim(hardware_set_id)), upper(trim(description))"
    order = f"{_RICH21} DESC, later, row_no" if doors else "later, row_no"
    blank = " AND coalesce(trim(door_number), '') <> ''" if doors else ""
    fields = "page_id, row_no, " + ", ".join(_DOORS21 if doors else _PARTS21)
    return f"""{name}_open AS (SELECT page_id FROM {counts} WHERE coalesce({gate}, false)),
{name} AS (SELECT * FROM {rows} WHERE page_id NOT IN (SELECT page_id FROM {name}_open) UNION ALL SELECT * EXCLUDE (later, nth) FROM (SELECT *, row_number() OVER (PARTITION BY page_id, {key} ORDER BY {order}) AS nth FROM (SELECT *, 0 AS later FROM {rows} UNION ALL SELECT {fields}, '{step}' AS origin, 1 FROM {answers} WHERE step = '{step}') WHERE page_id IN (SELECT page_id FROM {name}_open){blank}) WHERE nth = 1)"""


_R21 = [
    f"da AS ({_sql21(*_DOOR_ANSWERS21)})", f"pa AS ({_sql21(*_PART_ANSWERS21)})", f"d0 AS (SELECT *, 'extracted' AS origin FROM ({_sql21(_DOOR_ROWS21)}))", f"p0 AS (SELECT *, 'extracted' AS origin FROM ({_sql21(_PART_ROWS21)}))",
    _counts21("c1", "d0", "p0"), _merged21("d1", "d0", "da", "page", "c1", _DOOR_GATE21, True), _counts21("c2", "d1", "p0"), _merged21("d2", "d1", "da", "crop", "c2", _CROP_GATE21, True),
    _counts21("c3", "d2", "p0"), _merged21("p1", "p0", "pa", "page", "c3", _HW_GATE21, False), _counts21("c4", "d2", "p1"), _merged21("p2", "p1", "pa", "crop", "c4", _CROP_HW_GATE21, False), _counts21("c5", "d2", "p2"),
    f"need AS (SELECT DISTINCT page_id, {O.reference_id('hardware_set')} AS set_id FROM d2 EXCEPT SELECT page_id, {O.reference_id('hardware_set_id')} FROM p2)",
    f"offered AS (SELECT pa.*, min(rank) OVER (PARTITION BY page_id, set_id) AS first_ FROM (SELECT *, {O.reference_id('hardware_set_id')} AS set_id FROM pa WHERE step = 'repair') pa JOIN need USING (page_id, set_id) JOIN c5 USING (page_id) WHERE set_id <> '' AND door_crops > 0 AND (parts > 0 OR is_hw OR final_kind IN ('hardware_set', 'mixed')))",
    "repairs AS (SELECT * FROM offered WHERE rank = first_)", _merged21("p3", "p2", "repairs", "repair", "(SELECT DISTINCT page_id FROM repairs)", "true", False),
]


@query(O.chain(_BODIES, _SIGNALS, _CLASS, *_R21, select="SELECT page_id, 'door' AS kind, row_no, door_number AS name, coalesce(hardware_set, '') AS detail, origin FROM d2 UNION ALL SELECT page_id, 'component', row_no, hardware_set_id, description, origin FROM p3"))
def r21_rescued_rows(spark, sf_dir):
    """Doors and components of every page, few or many, and what answers of three steps add to them."""
    k = F.col("page_id")
    pages = held(_pages(spark, sf_dir), "c", C.classified(F.col("body"), F.col("answer"))).select("page_id", "c.kind", "c.e", (k % 4).alias("crops"), (k % 4 * (k % 2)).alias("door_crops"), (k % 4 * (k % 2)).alias("hardware_crops"))
    pages = settled(pages)  # asked for its evidence by every gate
    ids = views.table(spark, sf_dir, "pages").select("page_id")
    union = lambda made: functools.reduce(DataFrame.unionByName, (_rows21(ids, m) for m in made))
    doors, parts = rescue.rescued(pages, _rows21(ids, _DOOR_ROWS21), _rows21(ids, _PART_ROWS21), union(_DOOR_ANSWERS21), union(_PART_ANSWERS21))
    found = doors.select("page_id", F.lit("door").alias("kind"), "row_no", F.col("door_number").alias("name"), F.coalesce("hardware_set", F.lit("")).alias("detail"), "origin")
    return found.unionByName(parts.select("page_id", F.lit("component").alias("kind"), "row_no", F.col("hardware_set_id").alias("name"), F.col("description").alias("detail"), "origin"))
