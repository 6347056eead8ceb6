"""Registries, class tables, colours, labels and constants the results depend on."""

from __future__ import annotations

# Satellite feeds as (name, label, resolution in metres), in scan order.
SENSORS = [
    ("VIIRS_SNPP_NRT", "VIIRS (Suomi NPP)", 375),
    ("MODIS_NRT", "MODIS (Terra/Aqua)", 1000),
]

# Radiative power limits in megawatts.
INTENSITY_RANGES = [
    (float("-inf"), 10, "low"),
    (10, 50, "moderate"),
    (50, 200, "high"),
]
INTENSITY_SCALE = {
    "low": "FRP < 10 MW",
    "moderate": "FRP 10–50 MW",
    "high": "FRP 50–200 MW",
    "extreme": "FRP > 200 MW",
}
INTENSITY_COLORS = {
    "low": "#FFEE88",
    "moderate": "#FF9900",
    "high": "#FF4400",
    "extreme": "#AA0000",
    "unknown": "#FF6600",
}
MARKER_RADIUS = [(float("-inf"), 10, 4), (10, 50, 6), (50, 200, 9)]

# Fire danger classes as (low, high, class, colour, label).
FWI_CLASSES = [
    (0, 5, "low", "#38A800", "Low"),
    (5, 12, "moderate", "#FFFF00", "Moderate"),
    (12, 20, "high", "#FFAA00", "High"),
    (20, 30, "very_high", "#FF0000", "Very High"),
    (30, 999, "extreme", "#7A0000", "Extreme"),
]
FWI_MAP_COLORS = {
    "low": "#38A800",
    "moderate": "#FFFF00",
    "high": "#FFAA00",
    "very_high": "#FF0000",
    "extreme": "#7A0000",
    "unknown": "#888888",
}
FWI_PANEL_LABELS = {
    "low": "LOW",
    "moderate": "MODERATE",
    "high": "HIGH",
    "very_high": "VERY HIGH",
    "extreme": "EXTREME",
}
FWI_PANEL_COLORS = {
    "low": "#38A800",
    "moderate": "#CCCC00",
    "high": "#FFAA00",
    "very_high": "#FF4400",
    "extreme": "#AA0000",
}

# Weather defaults where a response leaves a field out.
WEATHER_DEFAULTS = {"temp_c": 20.0, "rh_pct": 50.0, "wind_kmh": 10.0, "wind_dir_deg": 0.0, "rain_mm": 0.0}

# Sampling grid in degrees.
GRID_LAT = (14.0, 33.0)
GRID_LON = (-118.0, -86.0)
GRID_STEP = 10.0

# Unit factors.
HECTARES_PER_ACRE = 0.404686
ACRES_PER_HECTARE = 2.47105

# Infrastructure categories as (tag key, tag value, label, colour), in order of priority.
INFRA_CATEGORIES = [
    ("amenity", "hospital", "Hospital", "#FF4444"),
    ("amenity", "clinic", "Clinic", "#FF8888"),
    ("amenity", "fire_station", "Fire Station", "#FF6600"),
    ("amenity", "police", "Police Station", "#0044FF"),
    ("amenity", "school", "School (shelter)", "#AA44FF"),
    ("power", "substation", "Power Substation", "#FFAA00"),
    ("power", "plant", "Power Plant", "#FF8800"),
    ("man_made", "tower", "Tower", "#666666"),
    ("aeroway", "aerodrome", "Airport/Airfield", "#44AAFF"),
    ("amenity", "fuel", "Fuel Station", "#FFDD00"),
    ("landuse", "reservoir", "Water Reservoir", "#0088FF"),
    ("natural", "water", "Water Body", "#4488FF"),
]
VIEWPORT_CATEGORIES = [
    ("amenity", "hospital", "Hospital", "#FF4444"),
    ("amenity", "fire_station", "Fire Station", "#FF6600"),
    ("amenity", "police", "Police Station", "#0044FF"),
    ("power", "substation", "Power Substation", "#FFAA00"),
    ("aeroway", "aerodrome", "Airport", "#44AAFF"),
]
INFRA_OTHER = ("Other", "#888888")
INFRA_ICONS = {
    "Hospital": "🏥",
    "Clinic": "🏥",
    "Fire Station": "🚒",
    "Police Station": "👮",
    "Power Substation": "⚡",
    "Power Plant": "⚡",
    "Airport/Airfield": "✈️",
    "Fuel Station": "⛽",
    "Tower": "📡",
    "School (shelter)": "🏫",
    "Water Reservoir": "💧",
    "Water Body": "💧",
}
INFRA_OTHER_ICON = "📍"
INFRA_BBOX = "-118,14,-86,33"
VIEWPORT_MIN_ZOOM = 7

# Monitored layers as (layer, label, icon, expected freshness).
LAYER_LABELS = [
    ("hotspots", "FIRMS Hotspots", "FIRMS", "< 3 hrs"),
    ("weather", "Weather / FWI", "MET", "Hourly"),
    ("fwi", "FWI Grid", "FWI", "Hourly"),
    ("perimeters", "Fire Perimeters", "PERIM", "< 6 hrs"),
]

# Panel colours per freshness status as (background, dot, text).
FRESHNESS_COLORS = {
    "green": ("#1a4a1a", "#44ff44", "#aaffaa"),
    "amber": ("#4a3a00", "#ffcc00", "#ffeeaa"),
    "red": ("#4a0000", "#ff4444", "#ffaaaa"),
    "unknown": ("#2a2a2a", "#888888", "#aaaaaa"),
}

# Source texts carried in layer metadata.
METADATA_TEXT = {
    "hotspots": {
        "source": "NASA FIRMS (VIIRS SNPP + MODIS NRT)",
        "api_url": "https://firms.modaps.eosdis.nasa.gov/api/",
        "coverage": "Global",
        "description": "Active fire hotspots detected by NASA satellite sensors. FRP = Fire Radiative Power in "
        "megawatts (MW). Higher FRP = more intense fire. Data latency: < 3 hours globally.",
    },
    "weather": {
        "source": "Open-Meteo API (https://open-meteo.com/)",
        "description": "Current meteorological conditions at global grid points.",
    },
    "fwi": {
        "source": "Computed from Open-Meteo data using Canadian Forest Service FWI System",
        "description": "Fire Weather Index (FWI) grid. FWI integrates temperature, relative humidity, wind speed, "
        "and precipitation into a single fire danger rating. Higher values indicate greater fire danger.",
    },
    "perimeters": {
        "source_usa": "NIFC WFIGS — https://data-nifc.opendata.arcgis.com/",
        "source_mexico": "CONAFOR SNIGF — https://snigf.cnf.gob.mx/",
        "description": "Active wildfire perimeter polygons. Each polygon represents the confirmed burned area "
        "boundary of an active or recently contained fire. Area in hectares and acres provided.",
    },
    "infrastructure": {
        "source": "OpenStreetMap via Overpass API",
        "license": "ODbL — © OpenStreetMap contributors",
        "description": "Critical infrastructure relevant to wildfire emergency response. Includes hospitals, fire "
        "stations, police, power infrastructure, and water resources. Used for vulnerability assessment.",
    },
}
USA_SOURCE = ("USA", "NIFC WFIGS", "https://data-nifc.opendata.arcgis.com/")
MEXICO_SOURCE = ("Mexico", "CONAFOR", "https://snigf.cnf.gob.mx/")

# Sentences of the panels; braces take a count or an area.
SITUATION_TEXT = {
    "loading": "Loading fire detection data...",
    "none": "No active fire detections in current view.",
    "detections": "{} active fire detections globally. ",
    "extreme": "{} extreme-intensity detections require immediate attention. ",
    "perimeters": "{} active fire perimeters covering {} ha.",
}
ALERT_TEXT = {
    "loading": "Computing FWI...",
    "extreme": "{} zone(s) at EXTREME fire danger. ",
    "escalating": "{} zone(s) escalating. ",
    "advice": "Consider pre-positioning resources.",
    "very_high": "{} zone(s) at VERY HIGH fire danger. Monitor conditions closely.",
    "calm": "Current fire weather conditions are within manageable range.",
}
