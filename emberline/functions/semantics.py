"""Small value rules shared by every operator: falsy fallbacks, safe casts, cell keys, number text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy_text(*columns: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def truthy_number(*columns: Column) -> Column:
    """First column that is neither null nor zero: a measured 0 counts as missing here."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in columns])


def member(properties: Column, name: str) -> Column:
    """Value behind ``name`` (told apart by case) of a VARIANT object, as a VARIANT; null where it is absent."""
    return F.try_variant_get(properties, f"$['{name}']", "variant")


def variant_text(value: Column) -> Column:
    """A VARIANT as text: strings as they are, anything else as JSON; null for a JSON null."""
    return F.try_variant_get(value, "$", "string")


def filled(value: Column) -> Column:
    """Whether a VARIANT holds something: no null, no empty text, list or object, no number 0, no false.

    A text "0" does hold something.
    """
    kind, text = F.schema_of_variant(value), variant_text(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), False)
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )


def first_filled(properties: Column, *names: str) -> Column:
    """The first of the members ``names`` that holds something, as a VARIANT."""
    values = [member(properties, name) for name in names]
    return F.coalesce(*[F.when(filled(v), v) for v in values])


def number_or_null(text: Column) -> Column:
    """Text as DOUBLE, null when it is no number.

    Java would read ``10f`` and ``10d`` as numbers; with these letters replaced they are none.
    """
    return F.translate(text, "dDfF", "xxxx").try_cast("double")


def variant_number(value: Column) -> Column:
    """A VARIANT as DOUBLE: numbers, true as 1, texts that are numbers; null for anything else."""
    kind, text = F.schema_of_variant(value), variant_text(value)
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(kind == "BOOLEAN", (text == "true").cast("double")).when(~nested, number_or_null(F.trim(text)))


def cell_index(degrees: Column, per_degree: int = 100) -> Column:
    """Nearest 1/``per_degree``-degree cell as BIGINT; null where there is no finite coordinate."""
    return F.when(F.abs(degrees) < 1e6, F.floor(degrees * float(per_degree) + 0.5))


def cell_id(lon: Column, lat: Column, per_degree: int = 100) -> Column:
    """Both cell indexes in one BIGINT, so that joins and shuffles carry a single key."""
    return cell_index(lon, per_degree) * 4294967296 + cell_index(lat, per_degree)


def utc_naive(moment: dt.datetime) -> dt.datetime:
    """The UTC wall time of ``moment``; a moment without zone is taken as UTC."""
    return moment.astimezone(dt.timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def utc_literal(moment: dt.datetime) -> Column:
    """``moment`` as a zone-free constant, whatever the session's time zone."""
    return F.expr(f"timestamp_ntz'{utc_naive(moment).isoformat(sep=' ')}'")


def whole(value: Column) -> Column:
    """Nearest whole number, halves up, as BIGINT."""
    return F.floor(value + 0.5)


def grouped(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(value, 0)


def plain_number(value: Column) -> Column:
    """A number as a browser prints it: no ``.0`` behind whole numbers."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def literal(value) -> str:
    """A constant as SQL text."""
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"double('{value}')" if value in (float("inf"), float("-inf")) else f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def equal_lookup(key: Column, table: dict, default) -> Column:
    """Value behind ``key`` in a small fixed table, ``default`` for everything else.

    The table is a constant map, which keeps the generated code short however many entries it has.
    """
    entries = F.expr(f"map({', '.join(literal(part) for pair in table.items() for part in pair)})")
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def range_case(value: str, ranges: list[tuple[float, float, object]], default) -> str:
    """SQL text: result of the first half-open range ``[low, high)`` that holds ``value``; null stays null."""
    arms = [f"when {value} is null then null"]
    for low, high, found in ranges:
        above = f"{value} >= {literal(float(low))} and " if low != float("-inf") else ""
        arms.append(f"when {above}{value} < {literal(float(high))} then {literal(found)}")
    return f"case {' '.join(arms)} else {literal(default)} end"
