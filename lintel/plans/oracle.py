"""The registered queries as SQL for an independent engine."""

from lintel.functions import vocabulary as V
from lintel.functions.pages import REVERSED_WORDS
from lintel.plans import views
from lintel.sources.sinks import SCHEDULE


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return ", ".join(text(v) for v in values)


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DIRTY = f"""
raw AS (SELECT DISTINCT CASE WHEN l_partkey % 13 <> 0 THEN replace(samples[CAST((l_partkey + l_suppkey) % {len(views.SAMPLES)} + 1 AS INT)], '{{n}}', CAST(l_suppkey % 97 AS VARCHAR)) END AS value,
  CASE WHEN l_suppkey % 11 <> 0 THEN replace(samples[CAST((l_partkey * 7 + l_linenumber) % {len(views.SAMPLES)} + 1 AS INT)], '{{n}}', CAST(l_suppkey % 97 AS VARCHAR)) END AS other
  FROM lineitem, (SELECT [{listed(views.SAMPLES)}] AS samples))"""
DOORS = """
doors AS (SELECT 'project_' || (l_orderkey // 400) AS project_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'Division 8 HARDWARE.pdf' WHEN 1 THEN 'Door and Hardware.pdf' ELSE 'Door Schedule.pdf' END AS source_file, l_linenumber AS page, l_orderkey || chr(64 + l_linenumber) AS door_number,
  CASE l_suppkey % 6 WHEN 0 THEN 'HW-' || (l_partkey % 40) WHEN 1 THEN 'Set ' || (l_partkey % 40) || '.0' WHEN 2 THEN '' WHEN 4 THEN 'N/A' WHEN 5 THEN ' hardware set ' || (l_partkey % 40) || ' ' END AS hardware_set,
  CASE CAST(floor(l_quantity) AS INT) % 6 WHEN 0 THEN '3''-0"' WHEN 1 THEN '6''-0"' WHEN 2 THEN '' || (24 + CAST(floor(l_quantity) AS INT)) WHEN 3 THEN '3''-0" x 3''-0"' WHEN 4 THEN 'N/A' END AS door_width,
  CASE CAST(floor(l_quantity) AS INT) % 4 WHEN 0 THEN '7''-0"' WHEN 1 THEN '8''-0"' WHEN 2 THEN '' END AS door_height,
  CASE l_returnflag WHEN 'A' THEN 'A5' WHEN 'R' THEN 'PR-FLUSH' END AS door_type, CASE WHEN l_partkey % 3 = 0 THEN 'HM' WHEN l_partkey % 7 = 0 THEN 'WD by others' END AS door_material,
  CASE WHEN l_partkey % 4 = 1 THEN 'HM' WHEN l_partkey % 4 = 2 THEN 'ALUM' END AS frame_type, CASE l_suppkey % 5 WHEN 0 THEN '45 MIN' WHEN 1 THEN '----' WHEN 2 THEN 'NONE' WHEN 3 THEN 'none' END AS fire_rating,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'Level 12' ELSE 'Level ' || l_linenumber END AS level_area,
  CASE WHEN l_partkey % 17 = 0 THEN 'existing to remain' WHEN l_partkey % 19 = 0 THEN 'coiling shutter' WHEN l_partkey % 23 = 0 THEN 'card reader' WHEN l_partkey % 29 = 0 THEN 'set ' || (l_partkey % 40) END AS remarks, l_partkey AS row_key
  FROM lineitem)"""
COMPONENTS = """
parts AS (SELECT 'project_' || (p_partkey // 50) AS project_id,
  CASE p_partkey % 4 WHEN 0 THEN 'SET ' || (p_partkey % 37) WHEN 1 THEN 'HW-' || (p_partkey % 37) WHEN 2 THEN (p_partkey % 37) || '.0' ELSE 'Group #' || (p_partkey % 37) END AS hardware_set_id,
  CASE p_size % 8 WHEN 0 THEN 'HINGE' WHEN 1 THEN 'surface closer' WHEN 2 THEN 'Mortise lock' WHEN 3 THEN 'HARDWARE SET' WHEN 4 THEN 'SEE NOTE 4' WHEN 5 THEN 'TRASH CAN' WHEN 6 THEN 'kick plate' ELSE p_name END AS description,
  CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS catalog_number, CASE p_partkey % 3 WHEN 0 THEN '626' WHEN 1 THEN 'US26D, 630' END AS finish_code,
  CASE WHEN p_partkey % 6 = 0 THEN 'IVE' WHEN p_partkey % 6 = 1 THEN 'ABC Corp' END AS manufacturer_code,
  CASE p_size % 5 WHEN 0 THEN 'LOT' WHEN 1 THEN '0' WHEN 2 THEN '3 EA' WHEN 3 THEN CAST(p_size AS VARCHAR) END AS qty_raw,
  CASE p_size % 4 WHEN 0 THEN 'each' WHEN 1 THEN 'PRS' WHEN 2 THEN '' END AS unit, CAST(NULL AS VARCHAR) AS notes, p_retailprice AS price, p_partkey AS row_key FROM part)"""


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def txt(x: str) -> str:
    return strip(f"coalesce({x}, '')")


def sub(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(by)}, '{flags}')"


def has(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {text(pattern)}, '{flags}')" if flags else f"regexp_matches({x}, {text(pattern)})"


def known(x: str) -> str:
    return f"CASE WHEN upper({strip(x)}) NOT IN ({listed(V.UNKNOWN)}) THEN {strip(x)} END"


_PREFIX = r"^(?:HW|HDWR|HARDWARE|SET|GROUP)[\s.#:-]*"


def unzero(x: str) -> str:
    return f"CASE WHEN ends_with({x}, '.0') THEN left({x}, length({x}) - 2) ELSE {x} END"


def join_id(x: str, blanks: list[str]) -> str:
    s = f"upper({txt(x)})"
    return f"CASE WHEN {s} IN ({listed(blanks)}) THEN '' ELSE {strip(sub(unzero(s), _PREFIX, '', ''))} END"


def reference_id(x: str) -> str:
    s = f"upper({txt(x)})"
    return f"CASE WHEN {s} IN ({listed(V.BLANK_REF)}) THEN '' ELSE {unzero(strip(sub(s, _PREFIX, '', '')))} END"


def squeeze(x: str) -> str:
    return strip(sub(x, r"\s+", " "))


def label(x: str) -> str:
    s = sub(squeeze(sub(txt(x), "^(?:" + "|".join(V.LABEL_PREFIXES) + ")", "", "i")), "-{2,}", "-")
    return sub(sub(s, r"^(\d+)\.0+$", r"\1", ""), r"^\.(\d+)$", r"\1", "")


def label_text(x: str) -> str:
    return squeeze(sub(sub(sub(txt(x), r"\bPASASAGE\b", "PASSAGE", "gi"), r"\bw\s*/\s*", " ", "gi"), r"\s*([|/])\s*", r" \1 "))


def compact_key(x: str) -> str:
    return sub(squeeze(sub(f"upper({label_text(x)})", "[^A-Z0-9]+", " ")), r"^0*(\d+)(?:\.0+)?$", r"\1", "")


def set_key(x: str) -> str:
    """The key of an expression that is already a label's text without prefix, in one scalar subquery."""
    return f"""(SELECT CASE WHEN lab = '' THEN '' WHEN {has('s', r'^0*[0-9]+(?:[.]0+)?$')} THEN regexp_extract(s, '^0*([0-9]+)', 1) WHEN {has('s', r'^[.][0-9]+$')} THEN s[2:]
      WHEN contains(s, '|') AND len(parts) > 0 THEN array_to_string(parts, ' | ') WHEN s = '' THEN upper(f) ELSE s END
      FROM (SELECT *, list_sort(list_filter(list_transform(string_split(s, '|'), lambda p: {compact_key('p')}), lambda p: p <> '')) AS parts
      FROM (SELECT *, upper({squeeze(sub('f', '^(?:' + '|'.join(V.KEY_PREFIXES) + ')', '', 'i'))}) AS s FROM (SELECT lab, {label_text('lab')} AS f FROM (SELECT {label(x)} AS lab)))))"""


def quantity(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN upper({s}) NOT IN ({listed(V.NO_QTY)}) AND {has(s, '[0-9]')} THEN greatest(1, TRY_CAST(regexp_extract({s}, '[0-9]+') AS BIGINT)) END"


def unit(x: str) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in V.UNITS.items())
    return f"CASE WHEN {x} IS NULL THEN 'EA' WHEN upper({strip(x)}) IN ({listed(V.NO_UNIT)}) THEN NULL ELSE CASE upper({strip(x)}) {cases} ELSE 'EA' END END"


def pair(width: str, kind: str) -> str:
    by_type = " OR ".join(f"contains(upper(coalesce({kind}, '')), {text(w)})" for w in V.PAIR_WORDS)
    w = txt(width)
    imperial = "([0-9]+)\\s*['’]\\s*-?\\s*([0-9]+)"
    return f"""({by_type} OR {has(w, '[0-9].*[x/&].*[0-9]', 'i')} OR coalesce(TRY_CAST(regexp_extract({w}, {text(imperial)}, 1) AS BIGINT) * 12 + TRY_CAST(regexp_extract({w}, {text(imperial)}, 2) AS BIGINT) >= 60, false)
      OR coalesce(TRY_CAST(regexp_extract({w}, '^([0-9]+)(?:\\s*")?$', 1) AS BIGINT) >= 60, false))"""


def door_mark(x: str) -> str:
    given = f"coalesce({known(x)}, '')"
    s = f"trim({sub(f'upper({given})', r'\s+', ' ')}, ' .:-')"
    return f"({given} <> '' AND {s} NOT IN ({listed(V.ROOM_NAMES)}) AND length({s}) <= 20 AND CASE WHEN {has(s, '[0-9]')} THEN {has(s, V.DOOR_MARK)} ELSE {has(s, '^[A-Z]{1,2}$')} END)"


def component(row: dict[str, str]) -> str:
    """F1 on the columns description, hardware_set_id, catalog_number, manufacturer_code, notes and qty_raw."""
    k = {c: f"coalesce({known(c)}, '')" for c in row}
    starts = " OR ".join(f"starts_with(d, {text(s)})" for s in V.NOTE_STARTS)
    return f"""(SELECT NOT (d = '' OR d IN ({listed(V.HEADINGS)}) OR {has('d', V.SET_TITLE)} OR {has('upper(m)', V.MADE_UP_MAKERS)} OR {has('w', V.EQUIPMENT_NOISE)} OR {has('d', V.SCHEDULE_NOISE)} OR {has('w', V.SCHEDULE_NOISE)} OR {starts})
      AND ({has('d', V.COMPONENT_WORDS)} OR NOT ({has('w', V.ACCESS_NOISE)} OR {has('d', V.FINISH_NOISE)} OR {has('w', V.FINISH_NOISE)} OR d IN ({listed(V.ROOM_NAMES)}) OR {has('d', r'\bSIDELIGHTS?\b')}
      OR (h IN ({listed(V.NO_SET_ID)}) AND c = '' AND m = '') OR {door_mark('d')} OR {has('h', '^E[0-9]+[A-Z]?$')} OR NOT (c <> '' OR m <> '' OR coalesce(q <> 0, false) OR r <> '')))
      FROM (SELECT trim({sub(f"upper({k['description']})", r'\s+', ' ')}, ' .:-') AS d, trim({sub(f"upper({k['hardware_set_id']})", r'\s+', ' ')}, ' .:-') AS h, {k['catalog_number']} AS c, {k['manufacturer_code']} AS m, {k['qty_raw']} AS r, {quantity('qty_raw')} AS q,
      upper({k['description']}) || ' ' || upper({k['catalog_number']}) || ' ' || upper({k['manufacturer_code']}) || ' ' || upper({k['notes']}) AS w))"""


FIELDS = {c: c for c in ("description", "hardware_set_id", "catalog_number", "manufacturer_code", "notes", "qty_raw")}
GOOD = f"good AS (SELECT * FROM parts WHERE {component(FIELDS)})"
STATUS = f"""
ids AS (SELECT DISTINCT {join_id('hardware_set_id', V.BLANK_STATUS)} AS id FROM good WHERE {join_id('hardware_set_id', V.BLANK_STATUS)} <> ''),
clean AS (SELECT *, {join_id('hardware_set', V.BLANK_STATUS)} AS hardware_set_clean FROM doors),
checked AS (SELECT clean.*, CASE WHEN hardware_set_clean = '' THEN 'missing' WHEN (SELECT count(*) FROM ids) = 0 THEN 'not_checked_no_hardware_components' WHEN id IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS hardware_set_join_status
  FROM clean LEFT JOIN ids ON hardware_set_clean = id)"""
AGGREGATE = f"""
agg AS (SELECT project_id, hardware_set_clean AS hardware_set_id, count(door_number) AS total_doors, count(*) FILTER (NOT p) AS unit_doors, count(*) FILTER (p) AS pair_doors, CAST(sum(CASE WHEN p THEN 2 ELSE 1 END) AS BIGINT) AS door_leaves
  FROM (SELECT *, {pair('door_width', 'door_type')} AS p FROM checked) WHERE hardware_set_clean <> '' AND hardware_set_join_status = 'matched' GROUP BY ALL)"""
QUANTITY = f"""
quantities AS (SELECT a.project_id, a.hardware_set_id, total_doors, unit_doors, pair_doors, door_leaves, description, catalog_number, finish_code, manufacturer_code, coalesce({quantity('qty_raw')}, 0) AS qty_per_set, coalesce({quantity('qty_raw')}, 0) * total_doors AS total_qty_project
  FROM agg a LEFT JOIN (SELECT *, {join_id('hardware_set_id', V.BLANK_STATUS)} AS own_id FROM good) g ON a.project_id = g.project_id AND a.hardware_set_id = g.own_id)"""


def scalar(**columns: str) -> str:
    """A query of these expressions over the dirty values."""
    return f"WITH {DIRTY} SELECT value, other, " + ", ".join(f"{x} AS {k}" for k, x in columns.items()) + " FROM raw"


def chain(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + " " + select


def case(x: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, p)} THEN {text(n)}" for p, n in rules) + f" ELSE {text(other)} END"


_LEVEL = "lower(level_area)"
_SLUG = sub(sub("lower(value)", r"[\s_-]+", "_"), "[^a-z0-9_]", "")
_OCR = "translate(upper(translate(g, '’` ', '''''')), 'OI', '01')"
_DIM = "regexp_extract(s, {p}, 1) || '''-' || regexp_extract(s, {p}, 2) || '\"'"
_FORMS = ["^([0-9]+)'-?([0-9]+)\"?$", "^([0-9]+)[.'-]([0-9]+)$", "^([0-9]+)['-]([0-9]+)\"?$"]
_MARK = sub("upper(coalesce(value, ''))", "[^A-Z0-9!|]", "")

SQL: dict[str, str] = {
    "p1_blank_if_unknown": scalar(result=known("value")),
    "p3_door_number": scalar(result=txt("value")),
    "p4_door_hardware_set": scalar(result=f"(SELECT CASE WHEN s NOT IN ('', '—', '-') THEN s END FROM (SELECT {strip(sub(strip('value'), '^(?:set|hs|hw|hdwr|#)\\s*', '', 'i'))} AS s))"),
    "p5_fire_rating": scalar(result=f"CASE WHEN {strip('value')} NOT IN ({listed(V.NO_FIRE_RATING)}) THEN {strip('value')} END"),
    "p6_set_id": scalar(result=f"(SELECT CASE WHEN s = '' THEN '?' ELSE s END FROM (SELECT {sub(strip(sub(txt('value'), '^(?:set|hs|hw|hdwr|group|#|no[.]?)\\s*', '', 'i')), '^([0-9]+)[.]0$', '\\1', '')} AS s))"),
    "p7_quantity": scalar(result=quantity("value")),
    "p8_unit": scalar(result=unit("value")),
    "p9_pair": scalar(result=pair("value", "other")),
    "p10_extracted_set_id": scalar(result=f"CASE WHEN value IS NULL OR lower(value) IN ('', 'none', 'null', 'undefined', 'n/a') THEN '' ELSE {sub('trim(' + sub(strip('upper(value)'), '^(?:HW[.\\-\\s]*|HARDWARE[.\\-\\s]*|SET[.\\-\\s]*|GROUP[.\\-\\s]*)', '', '') + ", '. -')", '^([0-9]+)[.]0$', '\\1', '')} END"),
    "p15_blank": scalar(result=f"upper({txt('value')}) IN ({listed(V.BLANK)})"),
    "p16_join_id": scalar(result=join_id("value", V.BLANK)),
    "p17_status_join_id": scalar(result=join_id("value", V.BLANK_STATUS)),
    "p18_reference_id": scalar(result=reference_id("value")),
    "p19_qa_join_id": scalar(result=join_id("value", V.BLANK_QA)),
    "p20_set_label": scalar(result=label("value")),
    "p21_set_key": scalar(result=set_key("value")),
    "p23_compact_key": scalar(result=compact_key("value")),
    "p24_label_text": scalar(result=label_text("value")),
    "p25_placeholder_label": scalar(result=f"(SELECT lab = '' OR upper({sub('lab', '[\\s._:/\\\\|()-]+', '')}) IN ({listed(V.PLACEHOLDER_COMPACT)}) OR upper({squeeze('lab')}) IN ({listed(V.PLACEHOLDER_TEXT)}) FROM (SELECT {label('value')} AS lab))"),
    "p29_compare_value": scalar(result=f"CASE WHEN upper({txt('value')}) IN ({listed(V.BLANK)}) THEN '' ELSE {sub('upper(value)', '[^A-Z0-9]+', '')} END"),
    "p30_component_key": scalar(result=f"{join_id('value', V.BLANK)} || '|' || CASE WHEN upper({txt('other')}) <> '' THEN upper({txt('other')}) ELSE {strip(sub('upper(' + txt('value') + ')', '\\s+', ' '))} END"),
    "p35_append_token": scalar(result="(SELECT array_to_string(CASE WHEN list_contains(p, 'direct_pdf_confirmed') THEN p ELSE list_append(p, 'direct_pdf_confirmed') END, ';') FROM (SELECT list_filter(string_split(coalesce(value, ''), ';'), lambda x: x <> '') AS p))"),
    "p36_ocr_dimension": scalar(result=f"(SELECT CASE WHEN g = '' THEN NULL " + " ".join(f"WHEN {has('s', p)} THEN {_DIM.format(p=text(p))}" for p in _FORMS) + f" ELSE g END FROM (SELECT g, {_OCR} AS s FROM (SELECT {txt('value')} AS g)))"),
    "p38_ocr_door_mark": scalar(result=f"(SELECT CASE WHEN {has('s', '[0-9]')} THEN translate(s, 'OI', '01') ELSE s END FROM (SELECT translate({_MARK}, '!|', '11') AS s))"),
    "p43_category": scalar(result=case("lower(coalesce(value, ''))", V.CATEGORIES, V.OTHER_CATEGORY)),
    "p46_public_message": scalar(result=sub(sub(sub(sub("coalesce(value, '')", r"\bOpenAI\b", "analysis service", "gi"), r"\bgpt[-\w.]*\b", "analysis engine", "gi"), r"\bCall\s+\d+\s*\([^)]+\)", "Analysis step", "gi"), r"sending PDF/data to [^.]+", "processing document data", "gi")),
    "p47_project_name": scalar(result=f"CASE WHEN NOT {has(txt('value'), '^(?:untitled(?: project)?|project)?$', 'i')} THEN {txt('value')} END"),
    "p48_project_key": scalar(result="CASE WHEN lower(parent) = 'pdfs' THEN '__top_level__' ELSE parent END").replace("FROM raw", "FROM (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN len(string_split(value, '/')) >= 2 THEN string_split(value, '/')[-2] ELSE '' END AS parent FROM raw)"),
    "s2_project_id": scalar(result=f"CASE WHEN {has('value', '[Pp]roject\\s*[-_]?\\s*[0-9]+')} THEN 'project_' || regexp_extract(value, '[Pp]roject\\s*[-_]?\\s*([0-9]+)', 1) WHEN {_SLUG} <> '' THEN {_SLUG} WHEN {has('value', '[0-9]')} THEN 'project_' || regexp_extract(value, '[0-9]+') ELSE 'unknown' END"),
    "f3_door_mark": scalar(result=door_mark("value")),
    "f9_self_reference": scalar(result=f"(SELECT m = s AND {has('m', '[A-Z]')} FROM (SELECT upper({sub("coalesce(value, '')", '\\s+', '')}) AS m, upper({sub("coalesce(other, '')", '\\s+', '')}) AS s))"),
    "f10_mark_token": scalar(result=f"(SELECT upper(s) NOT IN ('', 'MARK', 'DOOR', 'NO', 'NUMBER') AND {has('s', '^(?:[0-9]{2,4}[A-Za-z]?|[A-Za-z]{1,3}[0-9]{2,4}[A-Za-z]?)$')} AND NOT ({has('s', '^[0-9]{2,4}[A-Za-z]?$')} AND coalesce(TRY_CAST(regexp_extract(s, '^[0-9]+') AS INT) BETWEEN 1900 AND 2099, false)) FROM (SELECT {txt('value')} AS s))"),
    "f12_finish_code": scalar(result=f"(SELECT s <> '' AND len(list_filter(regexp_split_to_array(s, '\\s*,\\s*'), lambda p: p <> '' AND NOT {has('p', '^(?:(?:US)?[0-9]{3}[A-Z]{0,2}|(?:US)?[0-9]{2}[A-Z]{1,2}|(?:US)?[A-Z]{2}[0-9]{2,4}[A-Z]?)$')})) = 0 FROM (SELECT upper({txt('value')}) AS s))"),
    "x23_file_class": scalar(result=f"(SELECT CASE WHEN (contains(s, 'HARDWARE') OR contains(s, 'DIVISION') OR contains(s, 'DIV 8') OR contains(s, 'DIV8')) AND NOT (contains(s, 'DOOR') OR contains(s, 'SCHEDULE') OR contains(s, 'OPENING')) THEN 'hardware' ELSE 'both' END FROM (SELECT upper({txt('value')}) AS s))"),
    "x24_quote_file": scalar(result=f"contains(lower({txt('value')}), 'proposal') OR {has(f'lower({txt("value")})', '^p[0-9]{2,}[_-]')}"),
    "f1_components": chain(COMPONENTS, GOOD, select="SELECT project_id, row_key, description, hardware_set_id FROM good"),
    "j2_join_status": chain(DOORS, COMPONENTS, GOOD, STATUS, select="SELECT project_id, door_number, row_key, hardware_set, hardware_set_clean, hardware_set_join_status FROM checked"),
    "a1_door_aggregate": chain(DOORS, COMPONENTS, GOOD, STATUS, AGGREGATE, select="SELECT * FROM agg"),
    "a2_project_quantities": chain(DOORS, COMPONENTS, GOOD, STATUS, AGGREGATE, QUANTITY, select="SELECT * FROM quantities"),
    "f5_real_doors": chain(DOORS, select="""SELECT project_id, door_number, source_file, row_key FROM doors WHERE (door_width IS NOT NULL OR door_height IS NOT NULL OR door_material IS NOT NULL OR fire_rating IS NOT NULL OR door_number = '')
      AND NOT (contains(upper(source_file), 'HARDWARE') AND NOT contains(upper(source_file), 'DOOR') AND door_width IS NULL AND door_height IS NULL)"""),
    "w1_most_complete_door": chain(DOORS, select="""SELECT * EXCLUDE (n, nth) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, door_number ORDER BY n DESC, source_file, page, row_key, hardware_set NULLS FIRST, door_width NULLS FIRST, door_height NULLS FIRST, door_type NULLS FIRST, door_material NULLS FIRST, frame_type NULLS FIRST, fire_rating NULLS FIRST, level_area NULLS FIRST, remarks NULLS FIRST) AS nth
      FROM (SELECT *, (hardware_set IS NOT NULL)::INT + (door_width IS NOT NULL)::INT + (door_height IS NOT NULL)::INT + (door_type IS NOT NULL)::INT + (door_material IS NOT NULL)::INT + (frame_type IS NOT NULL)::INT + (fire_rating IS NOT NULL)::INT + (level_area IS NOT NULL)::INT + (remarks IS NOT NULL)::INT AS n FROM doors)) WHERE nth = 1"""),
    "a3_project_files": chain(DOORS, select="SELECT project_id, array_to_string(list_sort(list(DISTINCT source_file)), ';') AS files, count(*) AS doors FROM doors GROUP BY project_id"),
    "a4_large_sets": chain(COMPONENTS, select="SELECT project_id, 'S' || row_key * row_key % 5 AS hardware_set_id, count(*) AS items FROM parts GROUP BY ALL HAVING count(*) >= 15"),
    "a5_join_evidence": chain(DOORS, COMPONENTS, f"h AS (SELECT project_id, {join_id('hardware_set_id', V.BLANK_QA)} AS id FROM parts), r AS (SELECT project_id, {join_id('hardware_set', V.BLANK_QA)} AS id FROM doors)", select="""
      SELECT project_id, coalesce(doors, 0) AS doors, coalesce(hardware, 0) AS hardware, coalesce(set_count, 0) AS set_count, coalesce(door_refs, 0) AS door_refs, coalesce(missing_refs, 0) AS missing_refs, coalesce(joinable_refs, 0) AS joinable_refs, coalesce(unmatched_refs, 0) AS unmatched_refs
      FROM (SELECT r.project_id, count(*) AS doors, count(*) FILTER (r.id <> '') AS door_refs, count(*) FILTER (r.id = '') AS missing_refs, count(k.id) AS joinable_refs, count(*) FILTER (r.id <> '' AND k.id IS NULL) AS unmatched_refs
      FROM r LEFT JOIN (SELECT DISTINCT project_id, id FROM h WHERE id <> '') k ON r.project_id = k.project_id AND r.id = k.id GROUP BY r.project_id) FULL JOIN (SELECT project_id, count(*) AS hardware, count(DISTINCT nullif(id, '')) AS set_count FROM h GROUP BY project_id) USING (project_id)"""),
    "a6_null_counters": chain(DOORS, select=f"SELECT source_file, count(*) AS doors, count(*) - count(DISTINCT (project_id, door_number)) AS duplicate_doors, count(*) FILTER (door_number IS NULL) AS missing_door_number, count(*) FILTER (door_width IS NULL) AS missing_width, count(*) FILTER (door_height IS NULL) AS missing_height, count(*) FILTER ({txt('hardware_set')} = '') AS missing_hw_set FROM doors GROUP BY source_file"),
    "a7_fill_rates": chain(DOORS, select="SELECT *, round((fill_door_number + fill_door_width + fill_door_height + fill_hardware_set + fill_fire_rating + fill_door_type) / 6, 1) AS schema_score FROM (SELECT project_id, " + ", ".join(f"round(avg(({c} IS NOT NULL)::INT) * 100, 1) AS fill_{c}" for c in ("door_number", "door_width", "door_height", "hardware_set", "fire_rating", "door_type")) + " FROM doors GROUP BY project_id)"),
    "a12_one_way_counts": chain(DOORS, select="SELECT 'door_material' AS dimension, coalesce(nullif(door_material, ''), 'Unspecified') AS value, count(*) AS n FROM doors GROUP BY 2 UNION ALL SELECT 'door_type', coalesce(nullif(door_type, ''), 'Unspecified'), count(*) FROM doors GROUP BY 2 UNION ALL SELECT 'fire_rating', coalesce(nullif(fire_rating, ''), 'Not rated'), count(*) FROM doors GROUP BY 2"),
    "a18_set_state": chain(DOORS, COMPONENTS, select=f"""SELECT set_id, coalesce(doors, 0) AS doors, coalesce(items, 0) AS items, CASE WHEN items IS NULL THEN 'missing' WHEN doors IS NULL THEN 'orphan' ELSE 'used' END AS state
      FROM (SELECT {join_id('hardware_set', V.BLANK_STATUS)} AS set_id, count(*) AS doors FROM doors GROUP BY 1 HAVING set_id <> '') FULL JOIN (SELECT {join_id('hardware_set_id', V.BLANK_STATUS)} AS set_id, count(*) AS items FROM parts GROUP BY 1 HAVING set_id <> '') USING (set_id)"""),
    "a20_core_completeness": chain(DOORS, select="SELECT project_id, count(*) AS doors, count(*) FILTER (door_number IS NOT NULL AND door_width IS NOT NULL AND door_height IS NOT NULL AND hardware_set IS NOT NULL) AS complete, round(avg((door_number IS NOT NULL AND door_width IS NOT NULL AND door_height IS NOT NULL AND hardware_set IS NOT NULL)::INT) * 100, 1) AS complete_pct, bool_and(hardware_set IS NULL) AS all_missing FROM doors GROUP BY project_id"),
    "a20_repeated_doors": chain(DOORS, select="SELECT project_id, door_number, count(*) AS n FROM doors GROUP BY ALL HAVING count(*) > 1"),
    "p49_levels": chain(DOORS, select=f"SELECT project_id, count(*) FILTER ({_LEVEL} LIKE '%1%' AND {_LEVEL} NOT LIKE '%10%' AND {_LEVEL} NOT LIKE '%11%' AND {_LEVEL} NOT LIKE '%12%') AS doors_level_1, count(*) FILTER (coalesce({_LEVEL}, '') <> '' AND NOT ({_LEVEL} LIKE '%1%' AND {_LEVEL} NOT LIKE '%10%' AND {_LEVEL} NOT LIKE '%11%' AND {_LEVEL} NOT LIKE '%12%')) AS doors_above_level_1 FROM doors GROUP BY project_id"),
    "j19_missing_sets": chain(DOORS, COMPONENTS, select=f"SELECT DISTINCT project_id, set_id FROM (SELECT project_id, {reference_id('hardware_set')} AS set_id FROM doors EXCEPT SELECT project_id, {reference_id('hardware_set_id')} FROM parts) WHERE set_id <> ''"),
    "t5_nearest_vectors": """SELECT query_id, vec_id, round(distance, 4) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CAST(p[1] - p[2] AS DOUBLE) * CAST(p[1] - p[2] AS DOUBLE))) AS distance FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= 3""",
    "x_event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "x27_sections": "SELECT doc_id, n - 1 AS section_no, trim(s) AS section FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS n FROM documents) WHERE trim(s) <> ''",
}


def placeholder(x: str) -> str:
    return f"(SELECT lab = '' OR upper({sub('lab', r'[\s._:/\\|()-]+', '')}) IN ({listed(V.PLACEHOLDER_COMPACT)}) OR upper({squeeze('lab')}) IN ({listed(V.PLACEHOLDER_TEXT)}) FROM (SELECT {label(x)} AS lab))"


def words_of(*columns: str) -> str:
    return "upper(concat_ws(' ', " + ", ".join(columns) + "))"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def aliases(source: str, keep: str, x: str) -> str:
    """CTEs ending in aliases (keep, key): the keys that a label answers to; keep: a column that stands for the row."""
    return f"""
al0 AS (SELECT {keep}, {label_text('lab')} AS f FROM (SELECT {keep}, {label(x)} AS lab FROM {source}) WHERE lab <> ''),
al1 AS (SELECT {keep}, f AS q FROM al0 UNION ALL SELECT {keep}, q FROM (SELECT {keep}, {strip('p')} AS q FROM (SELECT {keep}, unnest(regexp_split_to_array(f, '\\s*[|/]\\s*')) AS p FROM al0)) WHERE length(q) >= 3 OR {has('q', '^[0-9]+$')}),
aliases AS (SELECT DISTINCT * FROM (SELECT {keep}, {set_key('q')} AS key FROM al1 UNION ALL SELECT {keep}, array_to_string(list_sort(regexp_extract_all(upper(f), '[A-Z0-9]+')), ' ') FROM al0) WHERE key <> '')"""


_ITEM_STARTS = " OR ".join(f"starts_with(d, {text(s)})" for s in V.NOTE_STARTS)
SETS = f"""
keyed AS (SELECT *, {set_key('hardware_set_id')} AS set_key, {label('hardware_set_id')} AS lab,
  trim({sub(f"upper({txt('description')})", r'\s+', ' ')}, ' .:-') AS d, trim({sub(f"upper({txt('hardware_set_id')})", r'\s+', ' ')}, ' .:-') AS h, {txt('catalog_number')} AS c, {txt('manufacturer_code')} AS m,
  upper(coalesce(description, '')) || ' ' || upper(coalesce(catalog_number, '')) || ' ' || upper(coalesce(manufacturer_code, '')) || ' ' || upper(coalesce(notes, '')) AS w FROM parts WHERE NOT {placeholder('hardware_set_id')}),
labels_ AS (SELECT project_id, set_key, arg_min(lab, row_key) AS hardware_set FROM keyed GROUP BY project_id, set_key),
items_ AS (SELECT *, row_number() OVER (PARTITION BY project_id, set_key, lower(trim(description)), lower(trim(coalesce(catalog_number, ''))) ORDER BY row_key) AS nth FROM keyed
  WHERE NOT (d = '' OR d IN ({listed(V.HEADINGS)}) OR {has('d', V.SET_TITLE)} OR {has('upper(m)', V.MADE_UP_MAKERS)} OR {has('w', V.EQUIPMENT_NOISE)} OR {has('d', V.SCHEDULE_NOISE)} OR {has('w', V.SCHEDULE_NOISE)} OR {_ITEM_STARTS})
  AND ({has('d', V.COMPONENT_WORDS)} OR NOT ({has('w', V.ACCESS_NOISE)} OR {has('d', V.FINISH_NOISE)} OR {has('w', V.FINISH_NOISE)} OR d IN ({listed(V.ROOM_NAMES)}) OR {has('d', r'\bSIDELIGHTS?\b')} OR (h IN ({listed(V.NO_SET_ID)}) AND c = '' AND m = '') OR NOT (c <> '' OR m <> '' OR coalesce(qty_raw, '') <> '')))),
sets_ AS (SELECT project_id, set_key, hardware_set, items FROM labels_ LEFT JOIN (SELECT project_id, set_key, list({{'row_key': row_key, 'desc': description, 'part': catalog_number, 'mfr': manufacturer_code, 'finish': finish_code, 'qty': qty_raw}} ORDER BY row_key) AS items FROM items_ WHERE nth = 1 GROUP BY project_id, set_key) USING (project_id, set_key)),{aliases('sets_', 'project_id, set_key, hardware_set', 'hardware_set')},
lookup AS (SELECT project_id, key, coalesce(exact, by_alias) AS hardware_set FROM (SELECT project_id, set_key AS key, hardware_set AS exact FROM sets_) FULL JOIN (SELECT project_id, key, min(hardware_set) AS by_alias FROM aliases GROUP BY project_id, key HAVING count(DISTINCT set_key) = 1) USING (project_id, key))"""


def _short(c: str) -> str:
    return f"CASE WHEN length(trim({c})) <= 15 THEN {set_key(c)} END"


RESOLVED = f"""
wanted AS (SELECT *, {set_key('own_label')} AS k0, {_short('door_type')} AS k1, {_short('frame_type')} AS k2, {set_key(r"regexp_extract(coalesce(remarks, ''), '(?i)\b(?:group|set|hw(?:\s*set)?|type|spec)\s*#?\s*([a-z0-9]+)\b', 1)")} AS k3, {set_key('door_number')} AS k4
  FROM (SELECT *, CASE WHEN NOT {placeholder('hardware_set')} THEN {label('hardware_set')} END AS own_label FROM doors)),
found AS (SELECT w.* EXCLUDE (own_label, k0, k1, k2, k3, k4), CASE WHEN own_label IS NOT NULL THEN coalesce(l0.hardware_set, own_label) ELSE coalesce(l1.hardware_set, l2.hardware_set, l3.hardware_set, l4.hardware_set) END AS set_label,
  CASE WHEN own_label IS NOT NULL THEN 'own' WHEN l1.hardware_set IS NOT NULL THEN 'door_type' WHEN l2.hardware_set IS NOT NULL THEN 'frame_type' WHEN l3.hardware_set IS NOT NULL THEN 'remarks' WHEN l4.hardware_set IS NOT NULL THEN 'mark' END AS resolved_from
  FROM wanted w LEFT JOIN lookup l0 ON k0 = l0.key AND w.project_id = l0.project_id LEFT JOIN lookup l1 ON k1 = l1.key AND w.project_id = l1.project_id LEFT JOIN lookup l2 ON k2 = l2.key AND w.project_id = l2.project_id LEFT JOIN lookup l3 ON k3 = l3.key AND w.project_id = l3.project_id LEFT JOIN lookup l4 ON k4 = l4.key AND w.project_id = l4.project_id)"""
_REMAINS = has("concat_ws(' ', remarks, door_material, door_type)", r"existing[\s_-]*to[\s_-]*remain|\bETR\b|e\.t\.r\.", "i")
_NOTE = " ".join(f"WHEN kind = '{k}' THEN {text(V.STATUS_NOTES[k])}" for k in ("BY_OTHERS", "EXISTING_TO_REMAIN", "COILING_SYSTEM", "NO_HW_SET"))
MAPPED = f"""
kinds AS (SELECT *, CASE WHEN {contains_any(words_of('door_material', 'door_type', 'frame_type', 'remarks'), V.BY_OTHERS)} THEN 'BY_OTHERS' WHEN {_REMAINS} THEN 'EXISTING_TO_REMAIN'
  WHEN set_label IS NULL AND {contains_any(words_of('door_material', 'door_type', 'remarks'), V.COILING)} THEN 'COILING_SYSTEM' WHEN set_label IS NULL THEN 'NO_HW_SET' END AS kind FROM found),
opened AS (SELECT k.*, s.hardware_set IS NOT NULL AS there, items FROM kinds k LEFT JOIN sets_ s ON kind IS NULL AND k.set_label = s.hardware_set AND k.project_id = s.project_id),
spread AS (SELECT *, unnest(items) AS item, generate_subscripts(items, 1) AS item_no FROM opened WHERE kind IS NULL AND len(items) > 0
  UNION ALL SELECT *, NULL, NULL FROM opened WHERE kind IS NOT NULL OR coalesce(len(items), 0) = 0),
mapping AS (SELECT project_id, door_number AS door_mark, row_key, CASE WHEN coalesce(kind, '') NOT IN ('BY_OTHERS', 'COILING_SYSTEM', 'NO_HW_SET') THEN set_label END AS hardware_set, item_no, item.qty AS qty,
  CASE {_NOTE} WHEN item IS NOT NULL THEN item.desc WHEN there THEN {text(V.STATUS_NOTES['EMPTY'])} ELSE {text(V.STATUS_NOTES['ABSENT'])} END AS description, item.part AS catalog_number, item.mfr AS manufacturer, item.finish AS finish,
  CASE WHEN kind IS NOT NULL THEN kind WHEN item IS NOT NULL THEN 'OK' ELSE 'FAILED_EXTRACTION_REVIEW_REQUIRED' END AS status FROM spread)"""
_ALL = (DOORS, COMPONENTS, SETS, RESOLVED)

MASTERS = """
masters AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Hinge ' WHEN 1 THEN 'SURFACE CLOSER' WHEN 2 THEN 'kick plate' ELSE p_name END AS description, CAST(5 + p_partkey % 40 AS DOUBLE) AS install_time_mins, p_retailprice AS default_unit_price FROM part),
prices AS (SELECT lower(trim(description)) AS key, max(id) AS mapped_master_id, arg_max(install_time_mins, id) AS install_time_mins, arg_max(default_unit_price, id) AS default_unit_price FROM masters GROUP BY 1)"""
PROJECTS = """
projects AS (SELECT 'project_' || (c_custkey - 1) AS project_id, CAST(c_custkey % 90 AS DOUBLE) AS miles, CASE WHEN c_custkey % 9 > 0 THEN 40.0 + c_custkey ELSE 0.0 END AS wage, CASE WHEN c_custkey % 7 > 0 THEN 25.0 ELSE 0.0 END AS profit,
  c_custkey % 2 = 0 AS drug, c_custkey % 3 = 0 AS parking, c_custkey % 4 = 0 AS outstation, c_custkey % 5 = 0 AS taxed FROM customer)"""
_LEVELS = SQL["p49_levels"].partition("SELECT project_id, count")[2]
BID = f"""
levels AS (SELECT project_id, count{_LEVELS}),
work AS (SELECT project_id, sum(total_qty_project * coalesce(CASE WHEN hardware_set_id = '7' THEN 12.5::DOUBLE END, install_time_mins, 0)) AS minutes, sum(total_qty_project * coalesce(CASE WHEN hardware_set_id = '5' THEN 0.0::DOUBLE END, default_unit_price, 0)) AS material
  FROM quantities LEFT JOIN prices ON lower({txt('description')}) = key GROUP BY project_id),
b0 AS (SELECT project_id, coalesce(minutes, 0) / 60.0::DOUBLE AS hours, coalesce(material, 0)::DOUBLE AS goods, wage::DOUBLE AS wage, profit::DOUBLE AS profit, taxed, coalesce(doors_level_1, 0) AS l1, coalesce(doors_above_level_1, 0) AS l2,
  (CASE WHEN miles > 40 THEN miles * 0.5 ELSE 0 END + CASE WHEN outstation THEN 165 ELSE 0 END + CASE WHEN parking THEN 18 ELSE 0 END + CASE WHEN drug THEN 150 ELSE 0 END)::DOUBLE AS allow FROM projects LEFT JOIN work USING (project_id) LEFT JOIN levels USING (project_id)),
b1 AS (SELECT *, hours * wage AS base, hours * wage + allow AS labor FROM b0), b2 AS (SELECT *, labor * 0.12::DOUBLE AS burden FROM b1), b3 AS (SELECT *, (labor + burden) * 0.32::DOUBLE AS over_ FROM b2),
b4 AS (SELECT *, (labor + burden + over_) * (profit / 100) AS mark FROM b3), b5 AS (SELECT *, labor + burden + over_ + mark AS before_ FROM b4),
b6 AS (SELECT *, (l1 * 25 + l2 * 35) / 60.0::DOUBLE * CASE WHEN hours > 0 THEN before_ / hours ELSE wage END + 250 AS unload FROM b5),
b7 AS (SELECT *, CASE WHEN taxed THEN unload * 0.0825::DOUBLE ELSE 0 END AS unload_tax, goods * 0.1::DOUBLE AS goods_mark, (goods + goods * 0.1::DOUBLE) * 0.0825::DOUBLE AS goods_tax FROM b6)"""
RUNS = """
runs AS (SELECT 'run_' || (o_orderkey % 5000) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'ok' ELSE 'error' END AS status,
  (CASE o_orderkey % 6 WHEN 0 THEN 'Door Schedule ' WHEN 1 THEN 'Division 08 hardware ' WHEN 2 THEN 'proposal ' WHEN 3 THEN 'p26_' WHEN 4 THEN 'hardware sets ' ELSE 'plan ' END) || o_custkey || '.pdf' AS pdf_name, CAST(o_custkey % 40 AS INT) AS doors,
  CAST(o_orderkey % 7 * (o_custkey % 5) AS INT) AS hardware, o_custkey % 3 AS duplicate_doors, o_orderkey % 30 AS missing_width, o_orderkey % 20 AS missing_height, o_custkey % 39 AS missing_hw_set, o_orderkey % 2 AS crop_count, o_orderkey % 3 AS crop_rescue_attempt_pages,
  o_orderkey % 11 % 3 AS crop_door_added, o_orderkey % 13 % 2 AS crop_hw_added, o_orderdate AS completed_at, o_orderkey AS row_key FROM orders)"""
_QUOTE = f"(contains(lower({txt('pdf_name')}), 'proposal') OR {has(f'lower({txt("pdf_name")})', '^p[0-9]{2,}[_-]')})"
TRIAGE = f"""
marked AS (SELECT *, list_filter([CASE WHEN status <> 'ok' THEN 'pipeline_error' END,
  CASE WHEN doors = 0 AND hardware = 0 THEN 'zero_extract' WHEN doors = 0 AND NOT ({contains_any('n', ['hardware', 'division 08', 'division_08'])} AND NOT {contains_any('n', ['door schedule', 'door & hardware', 'door_hardware'])}) THEN 'no_doors' WHEN hardware = 0 AND contains(n, 'hardware') THEN 'no_hardware' END,
  CASE WHEN duplicate_doors > 0 THEN 'duplicate_doors' END, CASE WHEN doors > 0 AND missing_width / doors > 0.5 THEN 'missing_width_gt_50pct' END, CASE WHEN doors > 0 AND missing_height / doors > 0.5 THEN 'missing_height_gt_50pct' END,
  CASE WHEN doors > 0 AND missing_hw_set / doors > 0.8 THEN CASE WHEN NOT {_QUOTE} AND {contains_any('n', ['door', 'opening'])} THEN 'missing_hw_set_gt_80pct' WHEN {_QUOTE} THEN 'door_rows_on_non_schedule_pdf' END END], lambda x: x IS NOT NULL) AS i
  FROM (SELECT *, lower(pdf_name) AS n FROM runs)),
sized AS (SELECT *, list_has_any(i, ['zero_extract', 'no_doors']) AS nothing, list_has_any(i, ['missing_width_gt_50pct', 'missing_height_gt_50pct']) AS s FROM marked),
triage AS (SELECT row_key, run_id, status, array_to_string(i, ';') AS issues, CASE WHEN list_has_any(i, ['pipeline_error', 'zero_extract', 'no_doors']) THEN 'high' WHEN len(i) > 0 THEN 'medium' ELSE 'ok' END AS severity,
  list_filter([CASE WHEN list_contains(i, 'pipeline_error') OR nothing THEN 'table detection failure' END, CASE WHEN nothing AND crop_count > 0 THEN 'wrong page classification' END, CASE WHEN nothing AND crop_count <= 0 THEN 'OCR failure' END,
  CASE WHEN list_contains(i, 'no_hardware') THEN 'bad hardware-set join' END, CASE WHEN list_contains(i, 'no_hardware') THEN 'bad schema mapping' END, CASE WHEN list_contains(i, 'duplicate_doors') THEN 'duplicate record' END,
  CASE WHEN s THEN 'unit / dimension normalization issue' END, CASE WHEN s THEN 'bad schema mapping' END, CASE WHEN list_contains(i, 'missing_hw_set_gt_80pct') THEN 'bad hardware-set join' END, CASE WHEN list_contains(i, 'door_rows_on_non_schedule_pdf') THEN 'wrong page classification' END,
  CASE WHEN crop_rescue_attempt_pages > 0 AND crop_door_added + crop_hw_added = 0 THEN 'low-confidence skip' END, CASE WHEN crop_count > 0 AND doors = 0 AND hardware = 0 THEN 'OCR failure' END, CASE WHEN crop_count > 0 AND doors = 0 AND hardware = 0 THEN 'rotated text failure' END,
  CASE WHEN duplicate_doors = 0 AND doors > 0 AND s THEN 'merged-cell failure' END, CASE WHEN duplicate_doors = 0 AND doors > 0 AND s THEN 'row segmentation failure' END, CASE WHEN hardware > 0 AND doors = 0 AND NOT contains(n, 'hardware') THEN 'wrong page classification' END], lambda x: x IS NOT NULL) AS kinds FROM sized),
kinds AS (SELECT * EXCLUDE (kinds), array_to_string(list_filter(kinds, lambda x, p: list_position(kinds, x) = p), ';') AS failure_taxonomy FROM triage)"""
PAGES = f"""
bodies AS (SELECT page_id, concat_ws(chr(10), {', '.join(f"replace(lines[CAST((page_id * {i + 1} + {i * i}) % {len(views.LINES)} + 1 AS INT)], '{{n}}', CAST(page_id % 83 AS VARCHAR))" for i in range(10))}, html) AS body FROM pages, (SELECT [{listed(views.LINES)}] AS lines))"""
BOXES = """
boxes AS (SELECT event_id // 200 AS page_id, event_id % 2 * 90 AS rotation, event_id AS box_id, CAST(event_id % 37 * 3 AS DOUBLE) AS x0, CAST(event_id % 23 * 5 AS DOUBLE) AS y0, CAST(event_id % 37 * 3 + 30 AS DOUBLE) AS x1, CAST(event_id % 23 * 5 + 20 AS DOUBLE) AS y1 FROM events)"""
_FIELDS = ("door_width", "door_height", "door_type", "door_material", "frame_type", "fire_rating", "hardware_set")
_BEST = SQL["w1_most_complete_door"].partition("SELECT * EXCLUDE (n, nth)")
WITNESS = f"""
best AS (SELECT * EXCLUDE (n, nth){_BEST[2]}),
ours AS (SELECT project_id, upper({txt('door_number')}) AS door_key, {', '.join(_FIELDS)} FROM best WHERE page % 4 <> 3),
theirs AS (SELECT project_id, upper({txt('door_number')}) AS door_key, {', '.join(f"CASE row_key % 5 WHEN 0 THEN 'other' WHEN 1 THEN '7''-0\"' ELSE {c} END AS {c}" for c in _FIELDS)} FROM best WHERE page % 4 >= 2)"""


def blank(x: str) -> str:
    return f"upper({txt(x)}) IN ({listed(V.BLANK)})"


def _compared(x: str) -> str:
    return sub(f"upper({x})", "[^A-Z0-9]+", "")


_CONFLICTS = ", ".join(f"CASE WHEN NOT {blank('p.' + c)} AND NOT {blank('w.' + c)} AND {_compared('p.' + c)} <> {_compared('w.' + c)} THEN '{c}: text=''' || p.{c} || ''' direct_pdf=''' || w.{c} || '''' END" for c in _FIELDS)
_SCORE = " + ".join(f"(NOT {blank('w.' + c)})::INT" for c in ("door_width", "door_height", "door_material", "door_type", "frame_type", "fire_rating"))
MERGED = f"""
joined AS (SELECT coalesce(p.project_id, w.project_id) AS project_id, coalesce(p.door_key, w.door_key) AS door_key, {', '.join(f"CASE WHEN p.project_id IS NULL THEN w.{c} WHEN w.project_id IS NOT NULL AND {blank('p.' + c)} AND NOT {blank('w.' + c)} THEN w.{c} ELSE p.{c} END AS {c}" for c in _FIELDS)},
  CASE WHEN p.project_id IS NULL OR w.project_id IS NULL THEN '' ELSE array_to_string(list_filter([{_CONFLICTS}], lambda x: x IS NOT NULL), '; ') END AS hybrid_conflicts, p.project_id IS NULL AS added, p.project_id IS NOT NULL AND w.project_id IS NOT NULL AS both_, {_SCORE} AS score,
  {' + '.join(f"({blank('p.' + c)} AND NOT {blank('w.' + c)})::INT" for c in _FIELDS)} AS gained FROM ours p FULL JOIN theirs w ON p.project_id = w.project_id AND p.door_key = w.door_key),
merged AS (SELECT * EXCLUDE (added, both_, score, gained), CASE WHEN added THEN 'direct_pdf_added' WHEN both_ AND hybrid_conflicts <> '' THEN 'direct_pdf_conflict;direct_pdf_confirmed' WHEN both_ THEN 'direct_pdf_confirmed' ELSE '' END AS hybrid_decision, CASE WHEN both_ THEN CAST(gained AS INT) ELSE 0 END AS fields_filled FROM joined WHERE NOT added OR score >= 2)"""
_BID_OUT = "project_id, " + ", ".join(f"floor(({v}) * 100 + 0.5) / 100 AS {k}" for k, v in {"total_man_hours": "hours", "base_labor_cost": "base", "allowances": "allow", "labor_burden": "burden", "overhead": "over_", "labor_markup": "mark", "offload_cost": "unload", "equipment_tax": "unload_tax", "total_labor_bid": "before_ + unload + unload_tax", "raw_material_cost": "goods", "material_markup": "goods_mark", "sales_tax": "goods_tax", "total_material_bid": "goods + goods_mark + goods_tax", "total_bid": "before_ + unload + unload_tax + (goods + goods_mark + goods_tax)"}.items())
_RISKS = [
    ("set_label IS NULL", "high", "Hardware mapping", "opening(s) have no hardware set assigned in the schedule."),
    ("set_label IS NOT NULL AND coalesce(len(items), 0) = 0", "high", "Hardware set definitions", "opening(s) reference a hardware set without line items."),
    (f"coalesce(fire_rating, '') <> '' AND NOT {has('fire_rating', '^(-|none|non|n/a)$', 'i')}", "medium", "Fire-rated openings", "fire-rated opening(s) require coordinated UL-listed door, frame and hardware assemblies."),
    (has("concat_ws(' ', remarks, door_type)", V.ACCESS_WORDS), "high", "Access control / electrified", "opening(s) involve electrified or access-control hardware."),
]
RISKS = "tagged AS (SELECT f.*, items FROM found f LEFT JOIN sets_ s ON f.set_label = s.hardware_set AND f.project_id = s.project_id), risks AS (" + " UNION ALL ".join(f"SELECT project_id, '{s}' AS severity, '{c}' AS category, count(*) AS n, count(*) || ' {t}' AS issue, list_sort(list(door_number)) AS all_ FROM tagged WHERE {test} GROUP BY project_id" for test, s, c, t in _RISKS) + ")"
_CELLS = "list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: nullif(trim(x), ''))"

SQL |= {
    "p22_alias_keys": chain(DIRTY, aliases("(SELECT DISTINCT value FROM raw WHERE value IS NOT NULL)", "value", "value"), select="SELECT value, other, coalesce(k, '') AS result FROM raw LEFT JOIN (SELECT value, string_agg(key, '; ' ORDER BY key) AS k FROM aliases GROUP BY value) USING (value)"),
    "p33_source_methods": scalar(result=f"(SELECT CASE WHEN len(u) = 0 THEN 'unknown' ELSE array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ';') END FROM (SELECT list_concat(list_filter(list_transform(regexp_extract_all(coalesce(value, ''), '\\[Source:\\s*([^\\]]+)\\]', 1), lambda x: {strip('x')}), lambda x: x <> ''), CASE WHEN contains(coalesce(value, ''), 'VISION LLM EXTRACTION') THEN ['vision_llm'] ELSE [] END) AS u))"),
    "p34_flags": scalar(result=f"(SELECT array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ';') FROM (SELECT list_filter([nullif(value, ''), CASE WHEN other IS NOT NULL THEN 'door_rescue' END, CASE WHEN {blank('other')} THEN 'crop_rescue' END], lambda x: x IS NOT NULL) AS u))"),
    "p41_from_to": scalar(result=f"(SELECT CASE WHEN len(p) >= 2 THEN p[1] || ' => ' || array_to_string(p[2:], ' / ') ELSE ' => ' || s END FROM (SELECT s, regexp_split_to_array(s, '(?i)\\s*(?:/|→|—|–|-|\\bto\\b)\\s*') AS p FROM (SELECT {txt('value')} AS s)))"),
    "f4_hardware_dimension": scalar(result="(SELECT NOT regexp_matches(s, '[0-9]\\s*[''’]') AND coalesce(CASE WHEN regexp_matches(s, '^[0-9]+\\s+[0-9]+/[0-9]+\\s*\"?$') THEN TRY_CAST(regexp_extract(s, '^([0-9]+)', 1) AS DOUBLE) + TRY_CAST(regexp_extract(s, '([0-9]+)/', 1) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(s, '/([0-9]+)', 1) AS DOUBLE), 0) WHEN regexp_matches(s, '^([0-9]+|[0-9]+[.][0-9]+)\\s*\"?$') THEN TRY_CAST(regexp_extract(s, '^[0-9.]+') AS DOUBLE) END < 12, false) FROM (SELECT " + txt("value") + " AS s))"),
    "f11_set_token": scalar(result=f"(SELECT NOT regexp_matches(s, '[/''\"]') AND {has('s', '^(?:[A-Z]?[0-9]{1,4}[A-Z]{0,3}(?:-[A-Z0-9]+)?|[A-Z]+-?[0-9]{1,4}[A-Z0-9-]*|[0-9]{1,2}[.][0-9])$', 'i')} FROM (SELECT {txt('value')} AS s))"),
    "j5_master_prices": chain(COMPONENTS, MASTERS, select=f"SELECT row_key, description, mapped_master_id, install_time_mins, default_unit_price FROM parts LEFT JOIN prices ON lower({txt('description')}) = key"),
    "a15_bids": chain(DOORS, COMPONENTS, GOOD, STATUS, AGGREGATE, QUANTITY, MASTERS, PROJECTS, BID, select=f"SELECT {_BID_OUT} FROM b7"),
    "a13_proposal_totals": chain(DOORS, COMPONENTS, GOOD, STATUS, select=f"""SELECT project_id, sum(amount)::DOUBLE AS subtotal, sum(n)::BIGINT * 85 AS labor, CAST(CAST(sum(amount) * 0.15 AS DECIMAL(30, 4)) AS DECIMAL(30, 2))::DOUBLE AS markup_amount, (sum(amount) + sum(n) * 85 + CAST(CAST(sum(amount) * 0.15 AS DECIMAL(30, 4)) AS DECIMAL(30, 2)))::DOUBLE AS total FROM (SELECT project_id, hardware_set_clean, n, CASE WHEN hardware_set_clean <> '' THEN n * coalesce(p, 0) ELSE 0 END::DECIMAL(24, 2) AS amount
      FROM (SELECT project_id, hardware_set_clean, count(*) AS n FROM checked GROUP BY ALL) LEFT JOIN (SELECT {join_id('hardware_set_id', V.BLANK_STATUS)} AS id, sum(CAST(price AS DECIMAL(18, 2))) AS p FROM good GROUP BY 1) ON hardware_set_clean = id) GROUP BY project_id"""),
    "j3_backfilled_sets": chain(DOORS, COMPONENTS, GOOD, select=f"""SELECT d.project_id, door_number, row_key, CASE WHEN {txt('hardware_set')} = '' THEN coalesce(raw, only_set, hardware_set) ELSE hardware_set END AS hardware_set FROM doors d
      LEFT JOIN (SELECT project_id, {join_id('hardware_set_id', V.BLANK)} AS id, arg_min({strip('hardware_set_id')}, row_key) AS raw FROM good GROUP BY ALL HAVING id <> '') b ON d.project_id = b.project_id AND {join_id('door_number', V.BLANK)} = b.id
      LEFT JOIN (SELECT project_id, min(hardware_set_id) AS only_set FROM good GROUP BY project_id HAVING count(DISTINCT hardware_set_id) = 1) o ON d.project_id = o.project_id"""),
    "j6_reconciled_doors": chain(DOORS, WITNESS, MERGED, select="SELECT * FROM merged"),
    "j6_merge_metrics": chain(DOORS, WITNESS, MERGED, select="SELECT count(*) FILTER (contains(hybrid_decision, 'confirmed')) AS confirmed, count(*) FILTER (hybrid_decision = 'direct_pdf_added') AS added, count(*) FILTER (contains(hybrid_decision, 'conflict')) AS in_conflict, CAST(sum(fields_filled) AS BIGINT) AS fields_filled FROM merged"),
    "j16_upserted": chain(DOORS, WITNESS, select="SELECT project_id, door_key, " + ", ".join(f"coalesce(w.{c}, p.{c}) AS {c}" for c in _FIELDS) + " FROM ours p FULL JOIN theirs w USING (project_id, door_key)"),
    "w4_first_component": chain(COMPONENTS, select=f"SELECT row_key, hardware_set_id, description FROM (SELECT *, row_number() OVER (PARTITION BY {join_id('hardware_set_id', V.BLANK)}, upper({txt('description')}) ORDER BY row_key) AS nth FROM parts) WHERE nth = 1"),
    "w7_last_run": chain(RUNS, select="SELECT run_id, row_key, status, doors FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC, row_key DESC) AS nth FROM runs) WHERE nth = 1"),
    "f28_open_runs": chain(RUNS, select="SELECT DISTINCT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'ok')"),
    "w5_set_table": chain(COMPONENTS, SETS, select="SELECT project_id, set_key, hardware_set, CAST(coalesce(len(items), 0) AS INT) AS n_items, array_to_string(list_transform(items, lambda x: x.desc), ';') AS item_list FROM sets_"),
    "j11_set_lookup": chain(COMPONENTS, SETS, select="SELECT * FROM lookup"),
    "j12_resolved_doors": chain(*_ALL, select="SELECT project_id, door_number, row_key, hardware_set, set_label, resolved_from FROM found"),
    "j9_mapping": chain(*_ALL, MAPPED, select="SELECT * FROM mapping"),
    "j9_status_counts": chain(*_ALL, MAPPED, select="SELECT status, count(*) AS n FROM mapping GROUP BY status"),
    "j15_noted_openings": chain(DOORS, select="SELECT row_key, bool_or(i % 4 IN (0, 2)) AS existing_to_remain FROM (SELECT row_key, unnest(regexp_extract_all(coalesce(remarks, ''), '[0-9]+')) AS number FROM doors) JOIN (SELECT i, CAST(i AS VARCHAR) AS number FROM range(40) t(i)) USING (number) GROUP BY row_key"),
    "a10_rollup": chain(*_ALL, select="SELECT project_id, count(*) AS total_openings, count(DISTINCT set_label) AS sets_referenced, count(*) FILTER (row_key % 5 = 0) AS high_risk, count(*) FILTER (row_key % 5 > 1) AS medium_risk, count(*) FILTER (row_key % 5 = 1) AS low_risk, count(*) FILTER (row_key % 6 = 1) AS access_control, count(*) FILTER (trim(coalesce(fire_rating, '')) <> '' AND NOT regexp_matches(fire_rating, '^(none|non|n/a|null|-)$', 'i')) AS fire_rated FROM found GROUP BY project_id"),
    "a11_item_takeoff": chain(*_ALL, MAPPED, select="SELECT lower(coalesce(description, '')) AS item, lower(coalesce(catalog_number, '')) AS part, lower(coalesce(finish, '')) AS finish, sum(CASE WHEN coalesce(TRY_CAST(qty AS DOUBLE), 0) = 0 THEN 1.0::DOUBLE ELSE TRY_CAST(qty AS DOUBLE) END) AS qty, count(DISTINCT hardware_set) AS sets, array_to_string(list_sort(list(DISTINCT hardware_set)), ';') AS set_ids FROM mapping WHERE status = 'OK' GROUP BY 1, 2, 3"),
    "a24_validation": chain(*_ALL, select="SELECT *, CASE WHEN with_set = 0 OR failed_mappings > doors * 0.3 THEN 'REVIEW_REQUIRED' ELSE 'OK' END AS status FROM (SELECT f.project_id, count(*) AS doors, count(*) FILTER (set_label IS NOT NULL AND coalesce(len(items), 0) = 0) AS failed_mappings, count(*) FILTER (set_label IS NULL OR coalesce(door_width, '') = '' OR coalesce(door_height, '') = '' OR coalesce(door_material, '') = '') AS doors_with_missing_fields, count(set_label) AS with_set FROM found f LEFT JOIN sets_ s ON f.set_label = s.hardware_set AND f.project_id = s.project_id GROUP BY f.project_id)").replace("SELECT *, CASE WHEN with_set", "SELECT * EXCLUDE (with_set), CASE WHEN with_set"),
    "r17_risks": chain(*_ALL, RISKS, select="SELECT project_id, severity, category, n, issue, array_to_string(all_[1:8], ', ') || CASE WHEN len(all_) > 8 THEN ', ...+' || (len(all_) - 8) || ' more' ELSE '' END AS openings FROM risks"),
    "w14_numbered_findings": chain(*_ALL, RISKS, select="SELECT project_id, printf('RFI-%03d', row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, category, issue)) AS rfi_no, severity, category, n FROM risks"),
    "r19_triage": chain(RUNS, TRIAGE, select="SELECT row_key, run_id, issues, severity, failure_taxonomy FROM kinds"),
    "a9_triage_summary": chain(RUNS, TRIAGE, select="SELECT 'status' AS kind, status AS value, count(*) AS n FROM kinds GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM kinds GROUP BY 2 UNION ALL SELECT 'taxonomy', v, count(*) FROM (SELECT unnest(string_split(failure_taxonomy, ';')) AS v FROM kinds) WHERE v <> '' GROUP BY 2"),
    "t7_page_of_runs": chain(RUNS, select="SELECT run_id, row_key, completed_at, (SELECT count(*) FROM runs) AS total, CAST(ceil((SELECT count(*) FROM runs) / 25) AS BIGINT) AS pages FROM runs ORDER BY completed_at DESC, row_key LIMIT 25 OFFSET 50"),
    "x4_gibberish": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 100 THEN false ELSE len(regexp_extract_all(text, 'cid:')) > 20 OR a / length(text) < 0.35 OR len(regexp_extract_all(text, '[AEIOUaeiou]')) / greatest(1, a) < 0.05 END AS gibberish FROM (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS a FROM documents)",
    "x6_squeezed_tables": chain(PAGES, select="SELECT page_id, array_to_string(list_transform(string_split(replace(body, ' | ', '   |  '), chr(10)), lambda x: CASE WHEN contains(x, '|') THEN regexp_replace(x, '[ \\t]{2,}', ' ', 'g') ELSE x END), chr(10)) AS body FROM bodies"),
    "r1_table_cells": chain(PAGES, select=f"SELECT page_id, line_no, CAST(unnest(range(len(c))) AS INT) AS cell_no, unnest(c) AS cell FROM (SELECT page_id, line_no, {_CELLS} AS c FROM (SELECT page_id, unnest(string_split(body, chr(10))) AS line, CAST(generate_subscripts(string_split(body, chr(10)), 1) - 1 AS INT) AS line_no FROM bodies) WHERE contains(line, '|'))"),
    "w8_carried_sets": chain(PAGES, select=f"""SELECT page_id, line_no, hardware_set_id, line FROM (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no) AS hardware_set_id
      FROM (SELECT *, CASE WHEN {has('line', r'^\s*(?:HARDWARE\s+)?(?:SET|GROUP)\b\s*(?:NO\.?|#)?\s*\S+', 'i')} THEN regexp_extract(line, '(?i)(?:SET|GROUP)\\b\\s*(?:NO\\.?|#)?\\s*([A-Za-z0-9.-]+)', 1) END AS header
      FROM (SELECT page_id, unnest(string_split(body, chr(10))) AS line, CAST(generate_subscripts(string_split(body, chr(10)), 1) - 1 AS INT) AS line_no FROM bodies))) WHERE header IS NULL AND {has('line', V.COMPONENT_WORDS, 'i')}"""),
    "w12_page_context": "SELECT conv_id, turn, mark, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_mark FROM (SELECT *, CASE WHEN role = 'user' THEN text END AS mark FROM conversations)",
    "s9_text_rows": chain(BOXES, "words AS (SELECT *, CASE WHEN box_id % 7 = 0 THEN 0.0 ELSE 5.0 + page_id % 9 + box_id % 3 END AS tall FROM (SELECT * REPLACE (CASE WHEN box_id % 1000 < 15 THEN -1 - box_id // 1000 ELSE page_id END AS page_id) FROM boxes))", select="""SELECT page_id, "row", string_agg(CASE WHEN before IS NULL THEN word WHEN x0 - before > gap THEN '  |  ' || word ELSE ' ' || word END, '' ORDER BY x0, x1, word) AS line FROM (SELECT *, lag(x1) OVER (PARTITION BY page_id, "row" ORDER BY x0, x1, word) AS before
      FROM (SELECT page_id, x0, x1, trim(w) AS word, CAST(round_even(y0 / greatest(3, least(8, h * 0.8)), 0) AS BIGINT) AS "row", greatest(12, least(30, h * 2.4)) AS gap
      FROM (SELECT *, CASE WHEN box_id % 11 = 0 THEN ' ' ELSE ' w' || box_id || ' ' END AS w FROM words) JOIN (SELECT page_id, coalesce(quantile_cont(tall, 0.5) FILTER (tall > 0), 6) AS h, count(*) AS n FROM words GROUP BY page_id) USING (page_id) WHERE n >= 20 AND trim(w) <> '')) GROUP BY page_id, "row\""""),
    "j27_nearest_values": chain(BOXES, select="SELECT page_id, anchor_id, arg_min(text, (d, iy, ix, text)) AS text FROM (SELECT a.page_id, a.box_id AS anchor_id, CAST(b.box_id AS VARCHAR) AS text, abs(b.x0 - a.x1) AS d, b.y0 AS iy, b.x0 AS ix FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND abs(b.y0 - a.y1) <= 12 WHERE a.box_id % 20 = 0) GROUP BY ALL").replace("GROUP BY ALL", "GROUP BY page_id, anchor_id"),
    "j29_segments": chain(BOXES, "i AS (SELECT page_id, y0 + box_id % 5 AS y, x0 AS x, CASE WHEN box_id % 60 = 0 THEN 'SET ' ELSE 'item ' END || box_id AS text FROM boxes)", "h AS (SELECT page_id, y AS from_y, text AS header, coalesce(lead(y) OVER (PARTITION BY page_id ORDER BY y, text), 1e18) AS to_y FROM i WHERE starts_with(text, 'SET '))", select="SELECT page_id, header, y, x, text FROM i JOIN h USING (page_id) WHERE NOT starts_with(text, 'SET ') AND y >= from_y + 4 AND y < to_y - 2"),
    "x_sessions": "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
}

_NAMES = [n for group in V.FIELD_NAMES.values() for n in group] + ["colour", "swing"]
_FIELD = " ".join(f"WHEN lower(trim(value)) IN ({listed(names)}) THEN '{field}'" for field, names in V.FIELD_NAMES.items())
SQL |= {
    "p11_field_name": f"SELECT value, CASE {_FIELD} END AS result FROM (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN ' ' || upper(n) ELSE n END AS value FROM (SELECT l_suppkey, names[CAST(l_partkey % {len(_NAMES)} + 1 AS INT)] AS n FROM lineitem, (SELECT [{listed(_NAMES)}] AS names)))",
    "s19_run_summaries": "SELECT run_id, count(*) AS events, min(ts) AS started, max(ts) AS ended, arg_min(event, (ts, event)) AS first_event, arg_max(event, (ts, event)) AS last_event FROM (SELECT CAST(user_id AS VARCHAR) AS run_id, ts, event_type || '-' || event_id AS event FROM events) GROUP BY run_id",
}

# Text repairs, chunks and component lines of page texts; schedule lines; the richest door of a mark.
_UNREVERSED = "body"
for _wrong, _right in REVERSED_WORDS.items():
    _UNREVERSED = f"replace({_UNREVERSED}, {text(_wrong)}, {text(_right)})"
_DOUBLED = rf"length(b) >= 4 AND length(b) % 2 = 0 AND len(list_filter(range(1, length(b), 2), lambda i: b[i] <> b[i + 1])) = 0 AND len(regexp_extract_all(b, '\p{{L}}')) > length(b) * 0.6"
_PAGE_LINES = "ls AS (SELECT page_id, unnest(string_split(body, chr(10))) AS line, CAST(generate_subscripts(string_split(body, chr(10)), 1) - 1 AS INT) AS line_no FROM bodies)"
_COMPONENT_LINE = text(r"(?i)^\s*([0-9]+)\s+(?:(EA|EACH|PR|PAIR|SET)\b\.?\s+)?(.+?)(?:\s+((?:US)?[0-9]{2,3}[A-Z]{0,2}))?(?:\s+([A-Z]{3}))?\s*$")
_W8 = SQL["w8_carried_sets"].partition("SELECT page_id, line_no, hardware_set_id, line FROM")
_BIG = text("^([^Xx×]*)[Xx×](.*)$")
_READ = "^[0-9]{1,2}'-[0-9]{1,2}\"$"


def _part(k: int) -> str:
    return f"nullif(regexp_extract(line, {_COMPONENT_LINE}, {k}), '')"


def _side(x: str) -> str:
    forms = " ".join(f"WHEN {has('s', p)} THEN {_DIM.format(p=text(p))}" for p in _FORMS)
    return f"(SELECT CASE WHEN g = '' THEN NULL {forms} ELSE g END FROM (SELECT g, {_OCR} AS s FROM (SELECT {txt(x)} AS g)))"


def _csv(x: str) -> str:
    s = rf"trim(regexp_replace(coalesce({x}, ''), '\r?\n', ' ', 'g'))"
    return f"""CASE WHEN {has(s, '[",' + chr(13) + chr(9) + ']')} THEN '"' || replace({s}, '"', '""') || '"' ELSE {s} END"""


_LINE = {
    "Opening Number": "door_number", "From": "CASE WHEN row_key % 2 = 0 THEN 'HALL' ELSE '' END", "To": "CASE WHEN row_key % 2 = 0 THEN 'ROOM ' || page ELSE '' END", "Quantity": "'1'", "Door Width": "door_width", "Door Height": "door_height",
    "Door Material": "door_material", "Door Type": "door_type", "Door Label": "fire_rating", "Frame Type": "frame_type", "Frame Label": "fire_rating", "Hardware Set": "hardware_set", "Remarks": "remarks", "Source Page": "CAST(page AS VARCHAR)",
}
_DOOR_COLUMNS = ["project_id", "source_file", "door_number", "hardware_set", "door_width", "door_height", "door_type", "door_material", "frame_type", "fire_rating", "level_area", "remarks"]
SQL |= {
    "x1_unreversed": chain(PAGES, select=f"SELECT page_id, {_UNREVERSED} AS body FROM bodies"),
    "x3_unstuttered": chain(PAGES, _PAGE_LINES, select=rf"SELECT page_id, string_agg(CASE WHEN {_DOUBLED} THEN lead_ || array_to_string(list_transform(range(1, length(b), 2), lambda i: b[i]), '') ELSE line END, chr(10) ORDER BY line_no) AS body FROM (SELECT *, trim(line) AS b, regexp_extract(line, '^(\s*)', 1) AS lead_ FROM ls) GROUP BY page_id"),
    "x22_chunks": chain(PAGES, _PAGE_LINES, """pk AS (SELECT page_id, line_no, line AS chunk, 0 AS no FROM ls WHERE line_no = 0 UNION ALL SELECT ls.page_id, ls.line_no, CASE WHEN length(chunk) + 1 + length(line) <= 80 THEN chunk || chr(10) || line ELSE line END, CASE WHEN length(chunk) + 1 + length(line) <= 80 THEN no ELSE no + 1 END
      FROM pk JOIN ls ON pk.page_id = ls.page_id AND ls.line_no = pk.line_no + 1)""", select="SELECT page_id, no AS chunk_no, arg_max(chunk, line_no) AS chunk FROM pk GROUP BY page_id, no").replace("WITH ", "WITH RECURSIVE ", 1),
    "r9_component_fields": f"{_W8[0]}SELECT page_id, line_no, hardware_set_id, TRY_CAST({_part(1)} AS INT) AS qty, upper({_part(2)}) AS unit, {squeeze(f'upper({_part(3)})')} AS description, {_part(4)} AS finish_code, {_part(5)} AS manufacturer_code FROM{_W8[2]}",
    "r13_json_rows": "SELECT event_id AS answer_id, CAST(r AS INT) AS row_no, CASE r WHEN 0 THEN 'D' || user_id ELSE 'E' END AS mark, CASE r WHEN 0 THEN '3' END AS width FROM events, (SELECT unnest([0, 1]) AS r)",
    "k10_schedule_lines": chain(DOORS, select="SELECT concat_ws(',', " + ", ".join(_csv(_LINE.get(c, "''")) for c in SCHEDULE) + ") AS line FROM doors"),
    "p37_size_pair": chain(
        DIRTY, rf"s0 AS (SELECT value, other, regexp_replace(translate(upper(replace({txt('value')}, '`', chr(39))), 'OI', '01'), '^\s*\([0-9]+\)\s*', '') AS s FROM raw)",
        rf"s1 AS (SELECT *, CASE WHEN regexp_matches(s, '[Xx×]') THEN [regexp_extract(regexp_replace(s, '\s+', '', 'g'), {_BIG}, 1), regexp_extract(regexp_replace(s, '\s+', '', 'g'), {_BIG}, 2)] ELSE regexp_extract_all(s, {text(chr(91) + '0-9]+' + chr(92) + 's*[' + chr(39) + '.-]' + chr(92) + 's*[0-9]+' + chr(92) + 's*' + chr(34) + '?')}) END AS p FROM s0)",
        f"s2 AS (SELECT value, other, {_side('p[1]')} AS w, {_side('p[2]')} AS h, len(p) AS n FROM s1)", select=f"SELECT value, other, CASE WHEN n >= 2 AND {has('w', _READ)} AND {has('h', _READ)} THEN w || ' x ' || h ELSE '' END AS result FROM s2",
    ),
    "w2_richest_door": chain(DOORS, select=f"SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY upper({txt('door_number')}) ORDER BY {' + '.join(f'(NOT {blank(c)})::INT' for c in ('door_width', 'door_height', 'door_type', 'fire_rating'))} DESC, page, row_key, {', '.join(c + ' NULLS FIRST' for c in _DOOR_COLUMNS)}) AS nth FROM doors WHERE {txt('door_number')} <> '') WHERE nth = 1"),
}

# Folds in order, as recursion over places.
_IOU = "greatest(0, least(s.x1, k.x1) - greatest(s.x0, k.x0)) * greatest(0, least(s.y1, k.y1) - greatest(s.y0, k.y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
SQL |= {
    "w10_repaired_sequence": """WITH RECURSIVE s AS (SELECT *, row_number() OVER w AS i, lead(number) OVER w AS nxt FROM (SELECT event_id // 200 AS page_id, event_id AS pos, event_id % 4 + event_id % 3 AS number FROM events) WINDOW w AS (PARTITION BY page_id ORDER BY pos, number)),
      r AS (SELECT page_id, pos, number, i FROM s WHERE i = 1 UNION ALL SELECT s.page_id, s.pos, CASE WHEN s.nxt = r.number + 2 AND s.number <> r.number + 1 THEN r.number + 1 ELSE s.number END, s.i FROM r JOIN s ON s.page_id = r.page_id AND s.i = r.i + 1) SELECT page_id, pos, number FROM r""",
    "m1_rate_limit": """WITH RECURSIVE s AS (SELECT event_id, user_id, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      r AS (SELECT event_id, user_id, ts, i, true AS allowed, 0 AS retry_after, [t] AS recent FROM s WHERE i = 1 UNION ALL SELECT event_id, user_id, ts, i, len(kept) < 2, CAST(CASE WHEN len(kept) < 2 THEN 0 ELSE trunc(greatest(1, 3600 - (t - kept[1]))) END AS INT), CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END
      FROM (SELECT s.*, list_filter(r.recent, lambda x: x >= s.t - 3600) AS kept FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)) SELECT event_id, user_id, ts, allowed, retry_after FROM r""",
    "j26_distinct_rectangles": chain(BOXES, "s AS (SELECT *, row_number() OVER (PARTITION BY page_id, rotation ORDER BY box_id, x0, y0) AS i, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} AS b FROM boxes)", f"""r AS (SELECT page_id, rotation, i, true AS kept_, [b] AS held FROM s WHERE i = 1 UNION ALL SELECT page_id, rotation, i, fresh, CASE WHEN fresh THEN list_append(held, b) ELSE held END
      FROM (SELECT s.page_id, s.rotation, s.i, s.b, r.held, len(list_filter(r.held, lambda k: {_IOU} > 0.75 * ({_AREA.format('s')} + {_AREA.format('k')} - {_IOU}))) = 0 AS fresh FROM r JOIN s ON s.page_id = r.page_id AND s.rotation = r.rotation AND s.i = r.i + 1))""", select="SELECT page_id, rotation, box_id, x0, y0, x1, y1 FROM s JOIN r USING (page_id, rotation, i) WHERE kept_").replace("WITH ", "WITH RECURSIVE ", 1),
}
