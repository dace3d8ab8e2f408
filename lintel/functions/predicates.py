"""Row filters as boolean Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import blank_if_unknown, bound, strip, text


def _words(*columns: Column) -> Column:
    return F.concat_ws(" ", *(F.upper(F.coalesce(blank_if_unknown(c), F.lit(""))) for c in columns))


def _starts(c: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | c.startswith(s)
    return out


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words, anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def is_door_mark(c: Column) -> Column:
    """short marks with digits in a usual form, or one or two letters; room names are none."""

    def fits(s: Column) -> Column:
        form = F.when(s.rlike(r"\d"), s.rlike(V.DOOR_MARK)).otherwise(s.rlike("^[A-Z]{1,2}$"))
        return ~s.isin(V.ROOM_NAMES) & (F.length(s) <= 20) & form

    given = F.coalesce(blank_if_unknown(c), F.lit(""))
    return bound(given, lambda g: (g != "") & bound(_plain(g), fits))


def _plain(c: Column) -> Column:
    return strip(F.regexp_replace(F.upper(c), r"\s+", " "), " .:-")


def _component(description: Column, set_id: Column, catalog: Column, maker: Column, words: Column, evidence: Column, marks: bool) -> Column:
    given = F.struct(_plain(description).alias("d"), _plain(set_id).alias("set"), catalog.alias("catalog"), maker.alias("maker"), words.alias("words"), evidence.alias("evidence"))

    def test(x: Column) -> Column:
        d, w, set_ = x["d"], x["words"], x["set"]
        # Rejected whatever the description names.
        noise = (d == "") | d.isin(V.HEADINGS) | d.rlike(V.SET_TITLE) | F.upper(x["maker"]).rlike(V.MADE_UP_MAKERS) | w.rlike(V.EQUIPMENT_NOISE)
        noise = noise | d.rlike(V.SCHEDULE_NOISE) | w.rlike(V.SCHEDULE_NOISE) | _starts(d, V.NOTE_STARTS)
        # Rejected unless the description names a component.
        weak = w.rlike(V.ACCESS_NOISE) | d.rlike(V.FINISH_NOISE) | w.rlike(V.FINISH_NOISE) | d.isin(V.ROOM_NAMES) | d.rlike(r"\bSIDELIGHTS?\b")
        weak = weak | (set_.isin(V.NO_SET_ID) & (x["catalog"] == "") & (x["maker"] == "")) | ~x["evidence"]
        if marks:
            weak = weak | is_door_mark(d) | set_.rlike(r"^E\d+[A-Z]?$")
        return ~noise & (d.rlike(V.COMPONENT_WORDS) | ~weak)

    return bound(given, test)


def is_component(description: Column, set_id: Column, catalog: Column, maker: Column, notes: Column, qty: Column, qty_raw: Column) -> Column:
    """whether a component row is hardware and no heading, note, room, mark or piece of equipment."""
    known = lambda c: F.coalesce(blank_if_unknown(c), F.lit(""))
    evidence = (known(catalog) != "") | (known(maker) != "") | F.coalesce(qty != 0, F.lit(False)) | (known(qty_raw) != "")
    return _component(known(description), known(set_id), known(catalog), known(maker), _words(description, catalog, maker, notes), evidence, True)


def is_set_item(description: Column, set_id: Column, part: Column, maker: Column, notes: Column, qty: Column) -> Column:
    """the test for items of nested sets: placeholders count as text, marks and E-numbers are let through."""
    words = F.concat_ws(" ", *(F.upper(F.coalesce(c, F.lit(""))) for c in (description, part, maker, notes)))
    evidence = (text(part) != "") | (text(maker) != "") | (F.coalesce(qty.cast("string"), F.lit("")) != "")
    return _component(text(description), text(set_id), text(part), text(maker), words, evidence, False)


def is_hardware_dimension(c: Column) -> Column:
    """a bare size below 12 inches, which a door is not."""
    s = text(c)
    whole = F.regexp_extract(s, V.INCHES_WHOLE, 1).try_cast("double")
    decimal = F.regexp_extract(s, V.INCHES_DECIMAL, 1).try_cast("double")
    over, under = (F.regexp_extract(s, V.INCHES_FRACTION, k).try_cast("double") for k in (1, 2))
    mixed = F.when(s.rlike(V.INCHES_FRACTION), F.when(under != 0, whole + over / under)).otherwise(whole)
    return ~s.rlike(r"\d\s*['’]") & F.coalesce(F.coalesce(mixed, decimal) < 12, F.lit(False))


def is_self_reference(mark: Column, set_: Column) -> Column:
    """a set id that only repeats the door's mark, if that has a letter."""
    m, s = (F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")) for x in (mark, set_))
    return (m == s) & m.rlike("[A-Z]")


def is_mark_token(c: Column) -> Column:
    """a cell that reads like a door mark; years do not."""
    s = text(c)
    year = s.rlike(r"^\d{2,4}[A-Za-z]?$") & F.regexp_extract(s, r"^(\d+)", 1).try_cast("int").between(1900, 2099)
    return ~F.upper(s).isin(V.NO_MARK_TOKEN) & s.rlike(V.MARK_TOKEN) & ~F.coalesce(year, F.lit(False))


def is_set_token(c: Column) -> Column:
    """a cell that reads like a hardware set id and no dimension."""
    s = text(c)
    return ~s.rlike(r"[/'\"]") & s.rlike(V.SET_TOKEN)


def is_finish_code(c: Column) -> Column:
    """a finish code, or several between commas."""
    s = F.upper(text(c))
    return (s != "") & F.forall(F.filter(F.split(s, r"\s*,\s*"), lambda p: p != ""), lambda p: p.rlike(V.FINISH_CODE))


def is_quote_file(c: Column) -> Column:
    """A proposal or quote by its name."""
    s = F.lower(text(c))
    return s.contains("proposal") | s.rlike(r"^p\d{2,}[_-]")


def file_class(c: Column) -> Column:
    """Hardware, or both kinds of schedule."""
    s = F.upper(text(c))
    door, hardware = any_of(s, ["DOOR", "SCHEDULE", "OPENING"]), any_of(s, ["HARDWARE", "DIVISION", "DIV 8", "DIV8"])
    return F.when(hardware & ~door, "hardware").otherwise("both")


def has_dimension(*dimensions: Column) -> Column:
    out = F.lit(False)
    for d in dimensions:
        out = out | d.isNotNull()
    return out


def is_real_door(number: Column, source_file: Column, dimensions: list[Column], physical: list[Column]) -> Column:
    """a door with a dimension or a material; from hardware-only files, with a dimension."""
    sized = has_dimension(*dimensions)
    name = F.upper(F.coalesce(source_file, F.lit("")))
    hardware_only = name.contains("HARDWARE") & ~name.contains("DOOR")
    return (sized | has_dimension(*physical) | (text(number) == "")) & ~(hardware_only & ~sized)


def remains(*columns: Column) -> Column:
    """Whether an opening's texts say that it stays as it is."""
    return F.concat_ws(" ", *columns).rlike(r"(?i)existing[\s_-]*to[\s_-]*remain|\bETR\b|e\.t\.r\.")
