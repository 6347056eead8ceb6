"""Fire perimeters of two agencies: normalisation, union, totals, ranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import tables
from emberline.functions.semantics import first_filled, grouped, member, truthy_text, variant_number, variant_text, whole


def _constants(values: tuple[str, str, str]) -> list[Column]:
    return [F.lit(v).alias(n) for n, v in zip(("country", "source", "source_url"), values)]


def normalize_usa(features: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Rows with ``geometry`` and the ``properties`` struct of the USA feed to the perimeter layer."""
    p = F.col("properties")
    return features.select(
        *keep,
        "geometry",
        F.coalesce(p["poly_IncidentName"], F.lit("Unknown Fire")).alias("name"),
        p["poly_GISAcres"].alias("acres"),
        F.round(F.coalesce(p["poly_GISAcres"], F.lit(0.0)) * tables.HECTARES_PER_ACRE, 1).alias("hectares"),
        p["poly_CreateDate"].alias("date_created"),
        p["poly_DateCurrent"].alias("date_updated"),
        F.coalesce(p["poly_PerimeterCategory"], F.lit("")).alias("category"),
        F.coalesce(p["irwin_FireBehaviorGeneral"], F.lit("")).alias("behavior"),
        *_constants(tables.USA_SOURCE),
    )


def _stated(properties: Column, name: str, otherwise: str) -> Column:
    """``name`` if it holds something, else ``otherwise`` as it stands: absent is empty text, a JSON null is null."""
    last = member(properties, otherwise)
    return F.coalesce(variant_text(first_filled(properties, name)), F.when(last.isNull(), "").otherwise(variant_text(last)))


def normalize_mexico(features: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Rows with ``geometry`` and the ``properties`` of the Mexico feed to the perimeter layer.

    ``properties`` is a VARIANT with the values as the feed types them, or a map of texts. The feed spells its keys in
    several ways and the first spelling that holds something counts: a number 0 gives way to the next one, a text "0"
    does not. An area that is no number is 0.
    """
    if not isinstance(features.schema["properties"].dataType, T.VariantType):
        features = features.withColumn("properties", F.to_variant_object("properties"))
    p = F.col("properties")
    named = features.select(
        *keep,
        "geometry",
        F.coalesce(variant_text(first_filled(p, "NOMBRE", "nombre", "INCENDIO")), F.lit("Incendio Activo")).alias("name"),
        F.coalesce(variant_number(first_filled(p, "SUPERFICIE", "superficie", "HA")), F.lit(0.0)).alias("_ha"),
        _stated(p, "FECHA", "fecha").alias("date_updated"),
        _stated(p, "ESTADO", "estado").alias("state"),
        _stated(p, "MUNICIPIO", "municipio").alias("municipality"),
    )
    return named.select(
        *keep,
        "geometry",
        "name",
        F.round("_ha", 1).alias("hectares"),
        F.round(F.col("_ha") * tables.ACRES_PER_HECTARE, 1).alias("acres"),
        "date_updated",
        "state",
        "municipality",
        *_constants(tables.MEXICO_SOURCE),
    )


def unify(usa: DataFrame, mexico: DataFrame) -> DataFrame:
    """Both agencies in one layer; columns only one of them has are null for the other."""
    return usa.unionByName(mexico, allowMissingColumns=True)


def top_perimeters(df: DataFrame, id_column: str, n: int = 200, acres: str = "acres") -> DataFrame:
    """The ``n`` largest by acres, ties to the lowest id."""
    return df.orderBy(F.desc_nulls_last(acres), id_column).limit(n)


def first_perimeters(df: DataFrame, id_column: str, n: int = 200) -> DataFrame:
    """One page of ``n`` perimeters; id order makes it the same page every time."""
    return df.orderBy(id_column).limit(n)


def total_hectares(hectares: Column) -> Column:
    """Sum of one-decimal areas, added as decimals so that the order of addition cannot matter."""
    return F.coalesce(F.sum(hectares.cast("decimal(20,1)")), F.lit(0)).cast("double")


def perimeter_totals(df: DataFrame) -> DataFrame:
    """Fires and hectares over all and per country."""
    return df.agg(
        F.count("*").alias("total_fires"),
        total_hectares(F.col("hectares")).alias("total_hectares"),
        F.count_if(F.col("country") == "USA").alias("usa_fires"),
        F.count_if(F.col("country") == "Mexico").alias("mexico_fires"),
    )


def totals_by_country(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(
        F.count("*").alias("fires"), total_hectares(F.col("hectares")).alias("hectares")
    )


def largest_fire(df: DataFrame, *ids: str) -> DataFrame:
    """The whole row of the largest fire above 0 hectares, ties to the lowest ids."""
    return df.where("hectares > 0").orderBy(F.desc("hectares"), *ids).limit(1)


def fire_card(df: DataFrame) -> DataFrame:
    """Name, area, country and source of a fire as the panel prints them."""
    return df.select(
        "name",
        F.concat(grouped(whole(F.coalesce("hectares", F.lit(0.0)))), F.lit(" ha")).alias("area"),
        F.coalesce(truthy_text(F.col("country")), F.lit("N/A")).alias("country"),
        F.coalesce(truthy_text(F.col("source")), F.lit("N/A")).alias("source"),
    )


def area_text(hectares: Column) -> Column:
    """One-decimal area with separators, ``N/A`` for none."""
    text = F.concat(F.regexp_replace(F.format_number(hectares, 1), r"\.0$", ""), F.lit(" ha"))
    return F.when(hectares != 0, text).otherwise("N/A")

