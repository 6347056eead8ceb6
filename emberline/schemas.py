"""Declared schemas of every input file and output layer. Nothing is inferred: an empty layer is legal."""

from __future__ import annotations

from pyspark.sql import types as T


STRING, DOUBLE, BIGINT, INT, TIMESTAMP = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    """Nullable struct of the given fields, in order."""
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


# Documented column order of the two satellite feeds. Columns are read by name.
VIIRS_COLUMNS = [
    "latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite",
    "confidence", "version", "bright_ti5", "frp", "daynight",
]
MODIS_COLUMNS = [
    "latitude", "longitude", "brightness", "scan", "track", "acq_date", "acq_time", "satellite",
    "instrument", "confidence", "version", "bright_t31", "frp", "daynight",
]

WEATHER_RESPONSE = struct(
    lat=DOUBLE,
    lon=DOUBLE,
    fetched_at=TIMESTAMP,
    current=struct(
        temperature_2m=DOUBLE,
        relative_humidity_2m=DOUBLE,
        wind_speed_10m=DOUBLE,
        wind_direction_10m=DOUBLE,
        precipitation=DOUBLE,
    ),
    daily=struct(
        time=T.ArrayType(STRING),
        temperature_2m_max=T.ArrayType(DOUBLE),
        relative_humidity_2m_min=T.ArrayType(DOUBLE),
        wind_speed_10m_max=T.ArrayType(DOUBLE),
        precipitation_sum=T.ArrayType(DOUBLE),
    ),
    _corrupt_record=STRING,
)

WEATHER_ITEM = T.StructType([field for field in WEATHER_RESPONSE if field.name != "_corrupt_record"])

# Coordinates stay raw JSON text: polygons and multipolygons nest to different depths.
SHAPE = struct(type=STRING, coordinates=STRING)
POINT = struct(type=STRING, coordinates=T.ArrayType(DOUBLE))

USA_FEATURE = struct(
    geometry=SHAPE,
    properties=struct(
        poly_IncidentName=STRING,
        poly_GISAcres=DOUBLE,
        poly_CreateDate=STRING,
        poly_DateCurrent=STRING,
        poly_PerimeterCategory=STRING,
        irwin_FireBehaviorGeneral=STRING,
    ),
)

# Property names differ only by case between records, so they have to be map keys, not columns. As read from JSON
# the values keep their types, for a number 0 is empty where a text "0" is not.
MEXICO_FEATURE = struct(geometry=SHAPE, properties=T.MapType(STRING, STRING))
MEXICO_JSON_FEATURE = struct(geometry=SHAPE, properties=T.VariantType())

OSM_ELEMENT = struct(
    type=STRING,
    id=BIGINT,
    lat=DOUBLE,
    lon=DOUBLE,
    center=struct(lat=DOUBLE, lon=DOUBLE),
    tags=T.MapType(STRING, STRING),
)

FORECAST = T.ArrayType(
    struct(
        date=STRING,
        fwi=DOUBLE,
        risk_class=STRING,
        risk_label=STRING,
        color=STRING,
        temp_max=DOUBLE,
        rh_min=DOUBLE,
        wind_max=DOUBLE,
        rain=DOUBLE,
    )
)

LAYER_PROPERTIES = {
    "hotspots": struct(
        source=STRING,
        resolution_m=INT,
        frp=DOUBLE,
        intensity=STRING,
        confidence=STRING,
        acq_datetime=STRING,
        daynight=STRING,
    ),
    "weather": struct(
        temp_c=DOUBLE,
        rh_pct=DOUBLE,
        wind_kmh=DOUBLE,
        wind_dir_deg=DOUBLE,
        rain_mm=DOUBLE,
        fetched_at=TIMESTAMP,
    ),
    "fwi": struct(
        lat=DOUBLE,
        lon=DOUBLE,
        temp_c=DOUBLE,
        rh_pct=DOUBLE,
        wind_kmh=DOUBLE,
        wind_dir_deg=DOUBLE,
        rain_mm=DOUBLE,
        fwi=DOUBLE,
        risk_class=STRING,
        risk_label=STRING,
        risk_color=STRING,
        trend=STRING,
        forecast=FORECAST,
        fetched_at=TIMESTAMP,
    ),
    "perimeters": struct(
        name=STRING,
        acres=DOUBLE,
        hectares=DOUBLE,
        date_created=STRING,
        date_updated=STRING,
        category=STRING,
        behavior=STRING,
        country=STRING,
        source=STRING,
        source_url=STRING,
        state=STRING,
        municipality=STRING,
    ),
    "infrastructure": struct(
        name=STRING,
        type=STRING,
        color=STRING,
        icon=STRING,
        osm_id=BIGINT,
        osm_type=STRING,
        address=STRING,
        phone=STRING,
        operator=STRING,
        capacity=STRING,
        emergency=STRING,
        source=STRING,
        osm_url=STRING,
    ),
}

LAYER_NAMES = list(LAYER_PROPERTIES)
POLYGON_LAYERS = {"perimeters"}


def feature_schema(layer: str) -> T.StructType:
    """One GeoJSON feature of ``layer``."""
    return struct(
        type=STRING, geometry=SHAPE if layer in POLYGON_LAYERS else POINT, properties=LAYER_PROPERTIES[layer]
    )


def layer_schema(layer: str) -> T.StructType:
    """The flat table behind ``layer``: its geometry columns, then its properties."""
    place = {"geometry": SHAPE} if layer in POLYGON_LAYERS else {"lon": DOUBLE, "lat": DOUBLE}
    rest = {field.name: field.dataType for field in LAYER_PROPERTIES[layer] if field.name not in place}
    return struct(**place, **rest)


def collection_schema(feature: T.StructType, items: str = "features") -> T.StructType:
    """A whole JSON document holding an array of ``feature``; documents that do not parse are kept as text."""
    return struct(**{items: T.ArrayType(feature)}, _corrupt_record=STRING)


ATTEMPTS = struct(
    attempt_id=BIGINT,
    attempted_at=TIMESTAMP,
    layer=STRING,
    generated_at=STRING,
    error=STRING,
    data_path=STRING,
)
