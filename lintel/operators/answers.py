"""Rows inside JSON answers of any nesting, as Columns: a value is looked at as a list or a map of JSON texts, level by level."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.functions.normalise import bound

#: Levels of nested objects that are searched for rows, and for a named value.
ROW_DEPTH, NAME_DEPTH = 3, 4
_NONE = "array<string>"


def _is(c: Column, mark: str) -> Column:
    return F.coalesce(F.ltrim(c).startswith(mark), F.lit(False))


def _list(c: Column) -> Column:
    return F.when(_is(c, "["), F.from_json(c, "array<string>"))


def _map(c: Column) -> Column:
    return F.when(_is(c, "{"), F.from_json(c, "map<string,string>"))


def _objects(rows: Column) -> Column:
    """A list whose first element is an object: its objects; an empty one: none; else null."""
    return F.when(F.size(rows) == 0, rows).when(_is(F.get(rows, F.lit(0)), "{"), F.filter(rows, lambda r: _is(r, "{")))


def found_rows(c: Column, depth: int = ROW_DEPTH) -> Column:
    """The rows, as JSON texts, of a list of objects, of an object that is itself a row, of the first list of objects among its
    values, or else of the first nested object that has any; null if there are none."""

    def in_map(m: Column) -> Column:
        own = F.exists(F.map_keys(m), lambda k: F.lower(k).isin(V.ROW_KEYS))
        lists = F.filter(F.transform(F.map_values(m), _list), lambda x: F.coalesce(_is(F.get(x, F.lit(0)), "{"), F.lit(False)))
        out = F.when(own, F.array(c)).when(F.size(lists) > 0, _objects(F.get(lists, F.lit(0))))
        if depth:
            nested = F.filter(F.transform(F.filter(F.map_values(m), lambda v: _is(v, "{")), lambda v: found_rows(v, depth - 1)), lambda r: r.isNotNull())
            out = out.otherwise(F.get(nested, F.lit(0)))
        return out

    return F.when(_is(c, "["), bound(_list(c), _objects)).when(_is(c, "{"), bound(_map(c), in_map))


def named_rows(c: Column, wanted: list[str], depth: int = NAME_DEPTH) -> Column:
    """The rows under the first key that is wanted (letters and digits, in lower case), searched level by level; an empty list if there are none."""
    name = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]+", "")

    def in_map(m: Column) -> Column:
        hits = F.filter(F.transform(F.filter(F.map_entries(m), lambda e: name(e["key"]).isin(wanted)), lambda e: found_rows(e["value"])), lambda r: r.isNotNull())
        out = F.get(hits, F.lit(0))
        if depth:
            deeper = F.filter(F.transform(F.filter(F.map_values(m), lambda v: _is(v, "{")), lambda v: named_rows(v, wanted, depth - 1)), lambda r: F.size(r) > 0)
            out = F.coalesce(out, F.get(deeper, F.lit(0)))
        return F.coalesce(out, F.array().cast(_NONE))

    return F.coalesce(F.when(_is(c, "{"), bound(_map(c), in_map)), F.array().cast(_NONE))
