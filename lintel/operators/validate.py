"""Rows as extracted to rows of the schema: placeholders out, fields promoted, rows that are none dropped."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import normalise as N
from lintel.functions import predicates as P
from lintel.functions import vocabulary as V


def _given(df: DataFrame, name: str) -> Column:
    """A column with placeholders as null; null where the frame lacks it."""
    return N.blank_if_unknown(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")


def _extra(df: DataFrame) -> Column:
    return F.col("extra_fields") if "extra_fields" in df.columns else F.lit(None).cast("map<string,string>")


def validated_doors(rows: DataFrame, *keys: str) -> DataFrame:
    """Door rows in the schema of V.DOOR_FIELDS behind the key columns.

    A field that is empty takes its value from extra_fields; what may be promoted leaves them either way. Pair and width go by
    the row's own width and type, not by promoted ones. A row needs a plausible mark that is no heading.
    """
    own = {f: _given(rows, f) for f in V.DOOR_FIELDS}
    extra = _extra(rows)
    named = rows.select(*keys, F.struct(*(c.alias(f) for f, c in own.items())).alias("own"), extra.alias("extra"))
    number = N.text(F.col("own.door_number"))
    named = named.where((number != "") & P.is_door_mark(number) & ~F.upper(number).isin(V.DOOR_HEADINGS))
    value = lambda f: F.col(f"own.{f}")
    promoted = lambda f: F.coalesce(value(f), N.blank_if_unknown(F.col("extra")[f])) if f in V.PROMOTED and f != "door_width" else value(f)
    fields = {f: promoted(f) for f in V.DOOR_FIELDS} | {"door_number": number}
    fields["hardware_set"] = N.door_hardware_set(F.nullif(N.extracted_set_id(promoted("hardware_set")), F.lit("")))
    fields["fire_rating"] = N.fire_rating(promoted("fire_rating"))
    pair = P.F.coalesce(N.is_pair(value("door_width"), value("door_type")), F.lit(False))
    rest = N.clean_extra_fields(F.map_filter(F.col("extra"), lambda k, _: ~k.isin(V.PROMOTED)))
    return named.select(*keys, *(c.alias(f) for f, c in fields.items()), pair.alias("is_pair"), F.when(pair, 2).otherwise(1).alias("door_leaves"), rest.alias("extra_fields"))


def validated_components(rows: DataFrame, *keys: str) -> DataFrame:
    """Component rows in the schema of V.COMPONENT_FIELDS behind the key columns; those that are no hardware go."""
    own = {f: _given(rows, f) for f in V.COMPONENT_FIELDS} | {"hardware_set_id": N.extracted_set_id(_given(rows, "hardware_set_id"))}
    named = rows.select(*keys, F.struct(*(c.alias(f) for f, c in own.items())).alias("own"), _extra(rows).alias("extra"))
    value = lambda f: F.col(f"own.{f}")
    description, raw = N.text(value("description")), F.coalesce(value("qty_raw"), value("qty"))
    keep = ((value("hardware_set_id") != "") | (description != "")) & ~F.upper(description).isin(V.COMPONENT_HEADINGS)
    plausible = P.is_component(description, value("hardware_set_id"), value("catalog_number"), value("manufacturer_code"), value("notes"), N.quantity(value("qty")), raw)
    fields = {f: value(f) for f in V.COMPONENT_FIELDS} | {
        "hardware_set_id": N.set_id(value("hardware_set_id")), "qty": N.quantity(value("qty")), "qty_raw": N.strip(raw), "unit": N.unit(value("unit")),
        "description": F.when(description != "", description).otherwise("-"),
    }
    return named.where(keep & F.coalesce(plausible, F.lit(False))).select(*keys, *(c.alias(f) for f, c in fields.items()), N.clean_extra_fields(F.col("extra")).alias("extra_fields"))


def flattened(rows: DataFrame, names: list[str]) -> DataFrame:
    """Named entries of extra_fields as columns; a column of that name that is there stays."""
    return rows.withColumns({n: F.col("extra_fields")[n] for n in names if n not in rows.columns}).drop("extra_fields")


def reordered(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted columns first, in their order, those that are there; the others behind them."""
    first = [c for c in wanted if c in rows.columns]
    return rows.select(*first, *(c for c in rows.columns if c not in first))
