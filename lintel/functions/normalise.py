"""Normalisers and key builders: Column in, Column out, no Python at run time.

White space is the ASCII kind throughout. Each cleaner keeps the placeholder list of the place that it serves.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V

_SPACE = " \t\n\r\x0b\x0c"


def bound(c: Column, build: Callable[[Column], Column]) -> Column:
    """build(c) with c computed once, however often build uses it; plain reuse would repeat the whole expression."""
    return F.transform(F.array(c), build)[0]


def strip(c: Column, chars: str = _SPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def text(c: Column) -> Column:
    """Null as the empty text, else without space at the ends."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def blank_if_unknown(c: Column) -> Column:
    """Placeholders become null."""
    return bound(strip(c), lambda s: F.when(~F.upper(s).isin(V.UNKNOWN), s))


def clean_extra_fields(c: Column) -> Column:
    """Map entries with a value."""
    return F.map_filter(F.transform_values(F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda _, v: blank_if_unknown(v)), lambda _, v: v.isNotNull())


def door_number(c: Column) -> Column:
    """P3."""
    return text(c)


def door_hardware_set(c: Column) -> Column:
    """A door's set without its prefix; dashes are null."""
    return bound(strip(F.regexp_replace(strip(c), r"(?i)^(?:set|hs|hw|hdwr|#)\s*", "")), lambda s: F.when(~s.isin("", "—", "-"), s))


def fire_rating(c: Column) -> Column:
    """P5: case counts, so 'none' stays."""
    s = strip(c)
    return F.when(~s.isin(V.NO_FIRE_RATING), s)


def set_id(c: Column) -> Column:
    """A component's set id; nothing left gives '?'."""
    s = strip(F.regexp_replace(text(c), r"(?i)^(?:set|hs|hw|hdwr|group|#|no\.?)\s*", ""))
    return bound(F.regexp_replace(s, r"^(\d+)\.0$", "$1"), lambda x: F.when(x == "", "?").otherwise(x))


def quantity(c: Column) -> Column:
    """The first number in the text, 1 at least; LOT and the like are null."""
    number = lambda s: F.regexp_substr(s, F.lit(r"\d+")).try_cast("long")
    return bound(strip(c.cast("string")), lambda s: F.when(~F.upper(s).isin(V.NO_QTY) & number(s).isNotNull(), F.greatest(F.lit(1), number(s))))


def unit(c: Column) -> Column:
    """EA, PAIR or SET; an unknown one is EA, a blank one null, null is EA."""

    def canon(s: Column) -> Column:
        known = F.lit("EA")
        for name, kind in V.UNITS.items():
            known = F.when(s == name, kind).otherwise(known)
        return F.when(s.isNull(), "EA").when(~s.isin(V.NO_UNIT), known)

    return bound(F.upper(strip(c)), canon)


def is_pair(width: Column, door_type: Column) -> Column:
    """By the type's words, two widths, or a width of 60 inches or more."""

    def named(kind: Column) -> Column:
        out = F.lit(False)
        for word in V.PAIR_WORDS:
            out = out | kind.contains(word)
        return out

    def wide(w: Column) -> Column:
        imperial = r"(\d+)\s*['’]\s*-?\s*(\d+)"
        feet, inches = (F.regexp_extract(w, imperial, k).try_cast("long") for k in (1, 2))
        plain = F.regexp_extract(w, r'^(\d+)(?:\s*")?$', 1).try_cast("long")
        return w.rlike(r"(?i)\d.*[x/&].*\d") | F.coalesce(feet * 12 + inches >= 60, F.lit(False)) | F.coalesce(plain >= 60, F.lit(False))

    return bound(F.upper(F.coalesce(door_type, F.lit(""))), named) | bound(text(width), wide)


def extracted_set_id(c: Column) -> Column:
    """P10: set id of a row read by a model."""
    s = F.regexp_replace(strip(F.upper(c)), r"^(?:HW[.\-\s]*|HARDWARE[.\-\s]*|SET[.\-\s]*|GROUP[.\-\s]*)", "")
    s = F.regexp_replace(strip(s, ". -"), r"^(\d+)\.0$", "$1")
    return F.when(c.isNull() | F.lower(c).isin("", "none", "null", "undefined", "n/a"), "").otherwise(s)


def _id_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:HW|HDWR|HARDWARE|SET|GROUP)[\s.#:-]*", "")


def _without_zero(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\.0\z", "")


def _join_id(c: Column, blanks: list[str]) -> Column:
    return bound(F.upper(text(c)), lambda s: F.when(s.isin(blanks), "").otherwise(strip(_id_prefix(_without_zero(s)))))


def is_blank(c: Column) -> Column:
    """P15."""
    return F.upper(text(c)).isin(V.BLANK)


def join_id(c: Column) -> Column:
    """P16: '.0' goes first, then one prefix, so HARDWARE SET 5 is SET 5."""
    return _join_id(c, V.BLANK)


def status_join_id(c: Column) -> Column:
    """As join_id, with the list that the status step has."""
    return _join_id(c, V.BLANK_STATUS)


def reference_id(c: Column) -> Column:
    """The prefix goes first, then '.0'."""
    return bound(F.upper(text(c)), lambda s: F.when(s.isin(V.BLANK_REF), "").otherwise(_without_zero(strip(_id_prefix(s)))))


def qa_join_id(c: Column) -> Column:
    """As join_id, with the list of the QA report."""
    return _join_id(c, V.BLANK_QA)


def set_label(c: Column) -> Column:
    """P20: a set label without its prefix, spaces and dashes collapsed."""
    s = F.regexp_replace(text(c), "(?i)^(?:" + "|".join(V.LABEL_PREFIXES) + ")", "")
    s = F.regexp_replace(squeeze(s), "-{2,}", "-")
    return F.regexp_replace(F.regexp_replace(s, r"^(\d+)\.0+$", "$1"), r"^\.(\d+)$", "$1")


def label_text(c: Column) -> Column:
    """One spelling of a label's text."""
    s = F.regexp_replace(F.regexp_replace(text(c), r"(?i)\bPASASAGE\b", "PASSAGE"), r"(?i)\bw\s*/\s*", " ")
    return squeeze(F.regexp_replace(s, r"\s*([|/])\s*", " $1 "))


def compact_key(c: Column) -> Column:
    """Letters and digits only; a number without leading zeros."""
    s = squeeze(F.regexp_replace(F.upper(label_text(c)), "[^A-Z0-9]+", " "))
    return F.regexp_replace(s, r"^0*(\d+)(?:\.0+)?$", "$1")


def set_key(c: Column) -> Column:
    """The key that two labels of one set share; parts between pipes are sorted."""

    def key(full: Column) -> Column:
        return bound(F.upper(squeeze(F.regexp_replace(full, "(?i)^(?:" + "|".join(V.KEY_PREFIXES) + ")", ""))), lambda s: canon(s, full))

    def canon(s: Column, full: Column) -> Column:
        parts = F.array_sort(F.filter(F.transform(F.split(s, r"\|"), compact_key), lambda p: p != ""))
        return (
            F.when(s.rlike(r"^0*\d+(?:\.0+)?$"), F.regexp_extract(s, r"^0*(\d+)", 1))
            .when(s.rlike(r"^\.\d+$"), F.substring(s, F.lit(2), F.length(s)))
            .when(s.contains("|"), bound(F.array_join(parts, " | "), lambda p: F.when(p == "", s).otherwise(p)))
            .when(s == "", F.upper(full))
            .otherwise(s)
        )

    return bound(set_label(c), lambda label: F.when(label == "", "").otherwise(bound(label_text(label), key)))


def alias_keys(c: Column) -> Column:
    """The whole label's key, those of its parts, and its words in order."""

    def keys(whole: Column) -> Column:
        parts = F.filter(F.transform(F.split(whole, r"\s*[|/]\s*"), lambda p: strip(p)), lambda p: (F.length(p) >= 3) | p.rlike(r"^\d+$"))
        loose = F.array_join(F.array_sort(F.regexp_extract_all(F.upper(whole), F.lit("[A-Z0-9]+"), F.lit(0))), " ")
        found = F.concat(F.transform(F.concat(F.array(whole), parts), set_key), F.array(loose))
        return F.array_sort(F.array_distinct(F.filter(found, lambda k: k != "")))

    none = F.array().cast("array<string>")
    return bound(set_label(c), lambda label: F.when(label == "", none).otherwise(bound(label_text(label), keys)))


def is_placeholder_label(c: Column) -> Column:
    """P25: labels that name no set."""

    def named(label: Column) -> Column:
        compact = F.upper(F.regexp_replace(label, r"[\s._:/\\|()-]+", ""))
        return (label == "") | compact.isin(V.PLACEHOLDER_COMPACT) | F.upper(squeeze(label)).isin(V.PLACEHOLDER_TEXT)

    return bound(set_label(c), named)


def string_list(c: Column) -> Column:
    """A text as a list of one, a blank one as an empty list."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def compare_value(c: Column) -> Column:
    """What two witnesses must agree on."""
    return F.when(is_blank(c), "").otherwise(F.regexp_replace(F.upper(c.cast("string")), "[^A-Z0-9]+", ""))


def component_key(set_: Column, catalog: Column, description: Column) -> Column:
    """Set, and catalog number or else description."""
    part = bound(F.upper(text(catalog)), lambda p: F.when(p != "", p).otherwise(strip(F.regexp_replace(F.upper(text(description)), r"\s+", " "))))
    return F.concat_ws("|", join_id(set_), part)



def source_methods(c: Column) -> Column:
    """The methods named in [Source: x] marks, in order."""
    s = F.coalesce(c, F.lit(""))
    named = F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"\[Source:\s*([^\]]+)\]"), F.lit(1)), lambda m: strip(m)), lambda m: m != "")
    vision = F.when(s.contains("VISION LLM EXTRACTION"), F.array(F.lit("vision_llm"))).otherwise(F.array().cast("array<string>"))
    all_ = F.array_distinct(F.concat(named, vision))
    return F.when(F.size(all_) == 0, "unknown").otherwise(F.array_join(all_, ";"))


def flags(anomaly: Column, **set_: Column) -> Column:
    """The anomaly and the names of the flags that are set, in order, each once."""
    marks = [F.when(F.coalesce(anomaly, F.lit("")) != "", anomaly), *(F.when(c, F.lit(k)) for k, c in set_.items())]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*marks))), ";")


def append_token(c: Column, token: Column | str) -> Column:
    """A token added to a semicolon list unless it is there."""
    token = F.lit(token) if isinstance(token, str) else token
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: p != "")
    return F.array_join(F.when(F.array_contains(parts, token), parts).otherwise(F.concat(parts, F.array(token))), ";")


def ocr_dimension(c: Column) -> Column:
    """Feet and inches as read by OCR, in one form; null if blank, as given if unreadable."""
    forms = [r"^(\d+)'-?(\d+)\"?$", r"^(\d+)[.'-](\d+)$", r"^(\d+)['-](\d+)\"?$"]

    def read(s: Column, given: Column) -> Column:
        out = given
        for form in forms[::-1]:
            out = F.when(s.rlike(form), F.concat(F.regexp_extract(s, form, 1), F.lit("'-"), F.regexp_extract(s, form, 2), F.lit('"'))).otherwise(out)
        return out

    bare = lambda given: F.translate(F.upper(F.translate(given, "’` ", "''")), "OI", "01")
    return bound(text(c), lambda given: F.when(given != "", bound(bare(given), lambda s: read(s, given))))


def size_pair(c: Column) -> Column:
    """Width and height of 'W x H', both null unless both are readable."""

    def sides(s: Column) -> Column:
        cut = F.split(F.regexp_replace(s, r"\s+", ""), "[Xx×]", 2)
        dims = F.regexp_extract_all(s, F.lit(r"\d+\s*['.-]\s*\d+\s*\"?"), F.lit(0))
        return F.transform(F.when(s.rlike("[Xx×]"), cut).otherwise(dims), ocr_dimension)

    def pair(p: Column) -> Column:
        good = F.forall(F.slice(p, 1, 2), lambda x: F.coalesce(x.rlike("^\\d{1,2}'-\\d{1,2}\"$"), F.lit(False))) & (F.size(p) >= 2)
        return F.struct(F.when(good, F.get(p, F.lit(0))).alias("width"), F.when(good, F.get(p, F.lit(1))).alias("height"))

    s = F.translate(F.upper(F.replace(text(c), F.lit("`"), F.lit("'"))), "OI", "01")
    return bound(bound(F.regexp_replace(s, r"^\s*\(\d+\)\s*", ""), sides), pair)


def ocr_door_mark(c: Column) -> Column:
    """OCR's ! and | are 1; with a digit anywhere, O is 0 and I is 1."""
    s = F.translate(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9!|]", ""), "!|", "11")
    return F.when(s.rlike(r"\d"), F.translate(s, "OI", "01")).otherwise(s)


def filled_count(*columns: Column) -> Column:
    """How many of these columns hold something."""
    return sum(((~is_blank(c)).cast("int") for c in columns), F.lit(0))


def from_to(c: Column) -> Column:
    """A location's two sides."""
    parts = F.split(text(c), r"(?i)\s*(?:/|→|—|–|-|\bto\b)\s*")
    two = F.size(parts) >= 2
    return F.struct(F.when(two, F.get(parts, F.lit(0))).otherwise("").alias("from"), F.when(two, F.array_join(F.slice(parts, 2, F.size(parts) - 1), " / ")).otherwise(text(c)).alias("to"))


def category(c: Column) -> Column:
    """The first category whose words appear."""
    s = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(V.OTHER_CATEGORY)
    for pattern, name in V.CATEGORIES[::-1]:
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def public_message(c: Column) -> Column:
    """A log message without the names of services and models."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\bOpenAI\b", "analysis service")
    s = F.regexp_replace(s, r"(?i)\bgpt[-\w.]*\b", "analysis engine")
    s = F.regexp_replace(s, r"(?i)\bCall\s+\d+\s*\([^)]+\)", "Analysis step")
    return F.regexp_replace(s, r"(?i)sending PDF/data to [^.]+", "processing document data")


def project_name(c: Column) -> Column:
    """Names that say nothing are null."""
    s = text(c)
    return F.when(~s.rlike(r"(?i)^(?:untitled(?: project)?|project)?$"), s)


def project_key(c: Column) -> Column:
    """A path's folder."""
    parts = F.split(c, "/")
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")
    return F.when(c.isNull(), None).when(F.lower(parent) == "pdfs", "__top_level__").otherwise(parent)


def level_side(c: Column) -> Column:
    """P49: 'level_1' if the text has a 1 and none of 10, 11, 12; null without a level. (Level 21 is level 1 by this rule.)"""
    s = F.lower(c)
    first = s.contains("1") & ~s.contains("10") & ~s.contains("11") & ~s.contains("12")
    return F.when(F.coalesce(s, F.lit("")) == "", None).when(first, "level_1").otherwise("above")


def project_id(c: Column) -> Column:
    """S2: 'project N' as project_N, else a slug, else unknown."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s_-]+", "_"), "[^a-z0-9_]", "")
    number = matched(c, r"[Pp]roject\s*[-_]?\s*(\d+)")
    bare = matched(c, r"(\d+)")
    return F.when(number.isNotNull(), F.concat(F.lit("project_"), number)).when(slug != "", slug).when(bare.isNotNull(), F.concat(F.lit("project_"), bare)).otherwise("unknown")


def field_name(c: Column) -> Column:
    """The field that a column name means, null if none."""
    name = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for field, names in V.FIELD_NAMES.items():
        out = F.when(name.isin(names), field).otherwise(out)
    return out


def canonical_row(c: Column) -> Column:
    """A map of named values as struct of fields (the last of equal ones) and extra (what no field means)."""
    entries = F.map_entries(c)
    named = F.filter(F.transform(entries, lambda e: F.struct(bound(e["key"], field_name).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    last = F.map_from_entries(F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"])))
    return F.struct(last.alias("fields"), F.map_filter(c, lambda k, _: bound(k, field_name).isNull()).alias("extra"))
