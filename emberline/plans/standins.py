"""Inputs of every feed derived from the driver's tables.

The SQL texts run unchanged in Spark and in DuckDB, so a query and its oracle start from the same rows.
Nested inputs (weather responses, tagged elements, agency properties) are shaped from them in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import use_all_cores

FORECAST_LENGTH = 5

HOT_RAW = """
select event_id,
  case when event_id % 3 = 0 then 'MODIS_NRT' else 'VIIRS_SNPP_NRT' end source_name,
  cast((user_id*173 + event_id % 40) % 18000 as double)/100e0 - 90e0 + 0.003e0 latitude,
  cast((user_id*311 + event_id % 40) % 36000 as double)/100e0 - 180e0 + 0.002e0 longitude,
  case when event_id % 97 = 0 then '' else cast(value as string) end frp,
  case when event_type='error' then 'l' when event_type='view' then 'h' else 'n' end confidence,
  cast(cast(ts as date) as string) acq_date,
  lpad(cast(hour(ts)*100+minute(ts) as string),4,'0') acq_time,
  case when hour(ts) between 6 and 17 then 'D' else 'N' end daynight
from {events}
"""

WX_RAW = """
select event_id point_id,
  cast((user_id*10)%170 as double)/10e0*1e0+14e0 lat, -118e0+cast(event_id%33 as double) lon,
  cast((event_id*7)%400 as double)/10e0 temp_c, cast(5+(event_id*13)%95 as double) rh_pct,
  cast((event_id*17)%450 as double)/10e0 wind_kmh, cast((event_id*29)%360 as double) wind_dir_deg,
  case when event_id%4=0 then cast(event_id%83 as double)/10e0 else 0e0 end rain_mm,
  ts fetched_at
from {events}
"""

WFIGS_RAW = """
select o_orderkey id,
  case when o_orderkey%41=0 then cast(null as string) else 'Fire '||cast(o_orderkey as string) end incident_name,
  case when o_orderkey%50=0 then cast(null as double) else o_totalprice end gis_acres,
  cast(o_orderdate as string) create_date, cast(o_orderdate as string) update_date,
  o_orderstatus category, o_orderpriority behavior
from {orders}
"""

CONAFOR_RAW = """
select s_suppkey id,
  case when s_suppkey%4=0 then s_name when s_suppkey%4=1 then '' end nombre_upper,
  case when s_suppkey%4=1 then s_name end nombre_lower,
  case when s_suppkey%4=2 then s_name end incendio,
  case when s_suppkey%5=0 then 'n/d' when s_suppkey%5=1 then cast(null as string) else cast(s_acctbal as string) end superficie,
  cast(s_nationkey as string) estado
from {supplier}
"""

# Features as they land, one JSON text each. Values come in the types and spellings that the feeds have.
_SHAPE = """'{{"type":"Feature","geometry":' || case when $id%4=0 then 'null'
    when $id%4=1 then '{{"type":"MultiPolygon","coordinates":[[[[' || cast($id%90 as string) || ',1],[2.5,3],[4,5.5],[' || cast($id%90 as string) || ',1]]],[[[7,8],[9,8],[9,9],[7,8]]]]}}'
    else '{{"type":"Polygon","coordinates":[[[' || cast($id%90 as string) || ',1],[2.5,3],[4,-5.5],[' || cast($id%90 as string) || ',1]]]}}' end"""

WFIGS_JSON = f"""
select o_orderkey id, {_SHAPE.replace('$id', 'o_orderkey')} || ',"properties":{{{{"poly_CreateDate":"' || cast(o_orderdate as string) || '"'
  || case when o_orderkey%41=0 then '' else ',"poly_IncidentName":"Fire }}}}]{{{{[ ' || cast(o_orderkey as string) || '"' end
  || case when o_orderkey%50=0 then '' else ',"poly_GISAcres":' || cast(o_orderkey%9000 as string) || '.5' end
  || case when o_orderkey%3=0 then ',"poly_PerimeterCategory":""' when o_orderkey%3=1 then ',"poly_PerimeterCategory":"' || o_orderstatus || '"' else '' end
  || '}}}}}}}}' value
from {{orders}}
"""

CONAFOR_JSON = f"""
select s_suppkey id, {_SHAPE.replace('$id', 's_suppkey')} || ',"properties":{{{{"ESTADO":"' || cast(s_nationkey as string) || '"'
  || case s_suppkey%5 when 0 then ',"NOMBRE":"' || s_name || '"' when 1 then ',"NOMBRE":"","nombre":"' || s_name || '"'
    when 2 then ',"NOMBRE":0,"nombre":null,"INCENDIO":"' || s_name || '"' when 3 then ',"nombre":' || cast(s_suppkey as string) else '' end
  || case s_suppkey%8 when 0 then ',"SUPERFICIE":0,"superficie":"12.34"' when 1 then ',"SUPERFICIE":"0","superficie":"12.34"'
    when 2 then ',"SUPERFICIE":"","HA":' || cast(s_nationkey as string) when 3 then ',"SUPERFICIE":null,"superficie":"n/d","HA":5'
    when 4 then ',"HA":' || cast(s_suppkey as string) || '.25' when 5 then ',"SUPERFICIE":false,"superficie":[],"HA":"7.25"'
    when 6 then ',"SUPERFICIE":true' else '' end
  || case s_suppkey%7 when 0 then ',"FECHA":"2024"' when 1 then ',"FECHA":"","fecha":null' when 2 then ',"FECHA":0,"fecha":20240131' else '' end
  || '}}}}}}}}' value
from {{supplier}}
"""

POWER_BANDS = """
select s_suppkey band, cast((s_suppkey*37)%150 as double)*4e0 low,
  cast((s_suppkey*37)%150 as double)*4e0 + cast((s_suppkey%6)*(s_suppkey%5)*3 as double) high
from {supplier} where s_suppkey%10 < 7
"""

OSM_RAW = """
select c_custkey id,
  case when c_custkey%10=0 then 'relation' when c_custkey%10<5 then 'way' else 'node' end el_type,
  case when c_custkey%23=0 then cast(null as double) else 14e0+cast((c_custkey*37)%190 as double)/10e0 end lat,
  -118e0+cast((c_custkey*91)%320 as double)/10e0 lon,
  case c_mktsegment when 'BUILDING' then 'hospital' when 'AUTOMOBILE' then 'fuel' when 'MACHINERY' then 'fire_station'
    when 'HOUSEHOLD' then 'school' end amenity,
  case when c_custkey%6=0 then 'substation' when c_custkey%6=1 then 'solar' end power,
  case when c_custkey%3=0 then c_name when c_custkey%3=1 then '' end name,
  case when c_custkey%7=0 then 'EN '||c_name end name_en,
  case when c_custkey%5=0 then 'P'||cast(c_custkey as string) when c_custkey%5=1 then '' end phone,
  case when c_custkey%5<3 then 'C'||cast(c_custkey as string) end contact_phone
from {customer}
"""

LAYER_ATTEMPTS = """
select event_id attempt_id, ts attempted_at,
  case event_type when 'click' then 'hotspots' when 'view' then 'weather' when 'error' then 'fwi'
    when 'purchase' then 'perimeters' else 'infrastructure' end layer,
  case when event_id%4=0 then 'HTTP 503' end error, case when event_id%4<>0 then ts end generated_at
from {events}
"""

PLACES_RAW = """
select c_custkey id,
  case when c_custkey%4=0 then '' when c_custkey%4=1 then cast(null as string) else c_name end name,
  n_name city, r_name country, c_name||', '||n_name||', '||r_name||', Earth' display_name
from {customer} join {nation} on c_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, HOT_RAW, "events")


def weather_responses(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Weather responses as they land: a ``current`` struct and ``daily`` parallel arrays.

    ``spread`` deals a small input out to all cores, for work that is heavy per row.
    """
    events = table(spark, sf_dir, "events")
    flat = spark.sql(WX_RAW, events=use_all_cores(events) if spread else events)

    def per_day(text: str) -> str:
        return f"array({', '.join(text.format(d=d) for d in range(FORECAST_LENGTH))})"

    daily = {
        "time": "cast(date_add(cast(fetched_at as date), {d}) as string)",
        "temperature_2m_max": "if((point_id + {d}) % 29 = 0, 0D, temp_c + 1.5D * {d} - 2D)",
        "relative_humidity_2m_min": "if((point_id + {d}) % 31 <> 0, 5D + cast((point_id * 13 + {d} * 11) % 95 as double), null)",
        "wind_speed_10m_max": "cast((point_id * 17 + {d} * 53) % 450 as double) / 10D",
        "precipitation_sum": "if((point_id + {d}) % 3 = 0, cast((point_id + {d}) % 83 as double) / 10D, 0D)",
    }
    return flat.selectExpr(
        "point_id",
        "lat",
        "lon",
        "fetched_at",
        "struct(temp_c as temperature_2m, rh_pct as relative_humidity_2m, wind_kmh as wind_speed_10m,"
        " wind_dir_deg as wind_direction_10m, rain_mm as precipitation) as current",
        f"struct({', '.join(f'{per_day(text)} as {name}' for name, text in daily.items())}) as daily",
    )


def responses_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed with some responses lacking their current readings."""
    return weather_responses(spark, sf_dir).withColumn(
        "current", F.expr("if(point_id % 101 <> 0, current, null)")
    )


def weather_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``point_id`` and the response as JSON text ``value``, every 103rd cut short."""
    fields = "struct(lat, lon, date_format(fetched_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") as fetched_at, current, daily)"
    return responses_with_gaps(spark, sf_dir).selectExpr("point_id", f"to_json({fields}) as whole").selectExpr(
        "point_id", "if(point_id % 103 = 0, substring(whole, 1, 20), whole) as value"
    )


def power_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, POWER_BANDS, "supplier")


NO_SHAPE = "cast(null as struct<type: string, coordinates: string>) as geometry"


def usa_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, WFIGS_RAW, "orders").selectExpr(
        "id",
        NO_SHAPE,
        "struct(incident_name as poly_IncidentName, gis_acres as poly_GISAcres, create_date as poly_CreateDate,"
        " update_date as poly_DateCurrent, category as poly_PerimeterCategory,"
        " behavior as irwin_FireBehaviorGeneral) as properties",
    )


def mexico_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "NOMBRE": "nombre_upper",
        "nombre": "nombre_lower",
        "INCENDIO": "incendio",
        "SUPERFICIE": "superficie",
        "ESTADO": "estado",
    }
    raw = _view(spark, sf_dir, CONAFOR_RAW, "supplier")
    return raw.selectExpr("id", NO_SHAPE, f"{_present(columns)} as properties")


def usa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` and the JSON text ``value`` of each feature."""
    return _view(spark, sf_dir, WFIGS_JSON, "orders")


def mexico_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CONAFOR_JSON, "supplier")


def osm_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "amenity": "amenity",
        "power": "power",
        "name": "name",
        "name:en": "name_en",
        "phone": "phone",
        "contact:phone": "contact_phone",
    }
    return _view(spark, sf_dir, OSM_RAW, "customer").selectExpr(
        "el_type as type",
        "id",
        "if(el_type = 'way', null, lat) as lat",
        "if(el_type = 'way', null, lon) as lon",
        "if(el_type = 'way', struct(lat, lon), null) as center",
        f"{_present(columns)} as tags",
    )


def _present(columns: dict[str, str]) -> str:
    """Map of the columns that are not null."""
    pairs = ", ".join(f"'{key}', {column}" for key, column in columns.items())
    return f"map_filter(map({pairs}), (k, v) -> v is not null)"


def layer_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LAYER_ATTEMPTS, "events")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PLACES_RAW, "customer", "nation", "region")
