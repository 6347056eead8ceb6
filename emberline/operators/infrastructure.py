"""Critical infrastructure from tagged map elements."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import tables
from emberline.functions.semantics import equal_lookup, literal, truthy_number, truthy_text
from emberline.operators.space import within_bbox

Category = tuple[str, str, str, str]


def parse_bbox(text: str) -> dict[str, float]:
    """``west,south,east,north`` text to named bounds."""
    west, south, east, north = (float(part) for part in text.split(","))
    return {"west": west, "south": south, "east": east, "north": north}


def bbox_columns(text: Column) -> list[Column]:
    """The same for a column of such texts."""
    parts = F.split(text, ",")
    return [
        F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(name)
        for i, name in enumerate(("west", "south", "east", "north"))
    ]


def keep_element_types(df: DataFrame) -> DataFrame:
    """Nodes and ways; relations have no single place."""
    return df.where(F.col("type").isin("node", "way"))


def with_place(df: DataFrame) -> DataFrame:
    """``lat``/``lon`` of an element: its own for a node, its centre for a way."""
    node, way = F.col("type") == "node", F.col("type") == "way"
    places = {axis: F.when(node, F.col(axis)).when(way, F.col("center")[axis]) for axis in ("lat", "lon")}
    return df.withColumns(places)


def drop_null_coords(df: DataFrame, falsy: bool = False) -> DataFrame:
    """Elements with a place. ``falsy`` drops latitude 0 as well and looks at the latitude only."""
    if falsy:
        return df.where(truthy_number(F.col("lat")).isNotNull())
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def _has(category: Category) -> str:
    key, value, *_ = category
    return f"tags[{literal(key)}] = {literal(value)}"


def has_any_tag(df: DataFrame, categories: list[Category] = tables.INFRA_CATEGORIES) -> DataFrame:
    """Elements tagged with at least one category."""
    return df.where(" or ".join(_has(c) for c in categories))


def category_of(categories: list[Category]) -> Column:
    """0-based place of the first category an element matches; null for none."""
    return F.expr(f"case {' '.join(f'when {_has(c)} then {i}' for i, c in enumerate(categories))} end")


def _label(place: Column, categories: list[Category], default: str) -> Column:
    return equal_lookup(place, {i: c[2] for i, c in enumerate(categories)}, default)


def _color(place: Column, categories: list[Category]) -> Column:
    return equal_lookup(place, {i: c[3] for i, c in enumerate(categories)}, tables.INFRA_OTHER[1])


def normalize(elements: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Elements (type, id, lat, lon, center, tags) to the infrastructure layer.

    Elements of no category keep the type ``Other``; select the categories first with ``has_any_tag``.
    """
    placed = drop_null_coords(with_place(keep_element_types(elements)))
    typed = placed.withColumn("_category", category_of(tables.INFRA_CATEGORIES))
    typed = typed.withColumn("_label", _label(F.col("_category"), tables.INFRA_CATEGORIES, tables.INFRA_OTHER[0]))

    def text(*names: str) -> Column:
        return F.expr(f"coalesce({', '.join(f'tags[{literal(name)}]' for name in names)}, '')")

    return typed.select(
        *keep,
        "lon",
        "lat",
        F.expr("coalesce(nullif(tags['name'], ''), nullif(tags['name:en'], ''), nullif(tags['name:es'], ''), _label) as name"),
        F.col("_label").alias("type"),
        _color(F.col("_category"), tables.INFRA_CATEGORIES).alias("color"),
        icon(F.col("_label")).alias("icon"),
        F.col("id").alias("osm_id"),
        F.col("type").alias("osm_type"),
        text("addr:street").alias("address"),
        text("phone", "contact:phone").alias("phone"),
        text("operator").alias("operator"),
        text("capacity").alias("capacity"),
        text("emergency").alias("emergency"),
        F.lit("OpenStreetMap").alias("source"),
        F.expr("concat('https://www.openstreetmap.org/', type, '/', cast(id as string)) as osm_url"),
    )


def icon(label: Column) -> Column:
    return equal_lookup(label, tables.INFRA_ICONS, tables.INFRA_OTHER_ICON)


def viewport(elements: DataFrame, bounds: dict[str, float], zoom: int, keep: Iterable[str] = ()) -> DataFrame:
    """Elements of the five map categories inside the view; empty when zoomed out too far.

    Bounds are rounded to four decimals. A latitude of exactly 0 is dropped, as on the map.
    """
    rounded = {side: round(value, 4) for side, value in bounds.items()}
    chosen = has_any_tag(keep_element_types(elements), tables.VIEWPORT_CATEGORIES)
    placed = within_bbox(drop_null_coords(with_place(chosen), falsy=True), **rounded)
    placed = placed.where(F.lit(zoom >= tables.VIEWPORT_MIN_ZOOM))
    typed = placed.withColumn("_category", category_of(tables.VIEWPORT_CATEGORIES))
    kind = F.col("_category")
    named = truthy_text(F.col("tags")["name"], F.col("tags")["name:es"])
    return typed.select(
        *keep,
        "lon",
        "lat",
        F.coalesce(named, _label(kind, tables.VIEWPORT_CATEGORIES, "Unknown")).alias("name"),
        _label(kind, tables.VIEWPORT_CATEGORIES, tables.INFRA_OTHER[0]).alias("type"),
        _color(kind, tables.VIEWPORT_CATEGORIES).alias("color"),
    )


def count_by_type(df: DataFrame) -> DataFrame:
    """Elements per type, most frequent first."""
    return df.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def type_counts(df: DataFrame) -> DataFrame:
    """One row with the total and a map of type to count. There are at most 13 types."""
    counts = df.groupBy("type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("type", "n")))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(entries).alias("by_type")
    )
