"""Published fire danger rows: readings, index, class and trend of one run."""

# The published rows as they are.
# lat, lon, temperature, humidity, wind, rain, index, class, trend
CURRENT = [
    (14.0, -118.0, 28.5, 76.0, 16.0, 0.0, 9.9, "moderate", "steady"),
    (14.0, -108.0, 29.0, 82.0, 18.9, 0.0, 10.4, "moderate", "steady"),
    (14.0, -98.0, 30.6, 74.0, 8.4, 0.0, 7.1, "moderate", "steady"),
    (14.0, -88.0, 24.9, 46.0, 13.1, 0.1, 12.6, "high", "de-escalating"),
    (24.0, -118.0, 20.6, 85.0, 21.6, 0.0, 10.1, "moderate", "escalating"),
    (24.0, -108.0, 29.3, 72.0, 9.8, 0.0, 7.5, "moderate", "escalating"),
    (24.0, -98.0, 31.3, 61.0, 19.1, 0.0, 14.3, "high", "escalating"),
    (24.0, -88.0, 28.8, 76.0, 11.4, 0.0, 8.1, "moderate", "escalating"),
]

# per cell in the order above: five days of temperature, humidity, wind, rain, index, class
FORECAST = [
    [(29.1, 72, 25.3, 0.9, 13.4, "high"), (29.2, 76, 27.5, 2.0, 11.8, "moderate"), (29.4, 76, 31.7, 0.6, 16.6, "high"),
     (29.0, 79, 32.2, 8.2, 10.2, "moderate"), (28.4, 79, 32.9, 6.2, 10.7, "moderate")],
    [(29.4, 79, 20.2, 0, 11.7, "moderate"), (29.8, 77, 24.0, 0.1, 13.7, "high"), (29.0, 82, 21.8, 0.4, 11.7, "moderate"),
     (29.3, 76, 28.4, 10.1, 8.5, "moderate"), (29.5, 75, 15.6, 3.6, 5.3, "moderate")],
    [(31.2, 65, 9.7, 0.4, 8.9, "moderate"), (30.7, 72, 21.9, 2.7, 9.4, "moderate"), (30.3, 74, 22.1, 1.7, 10.3, "moderate"),
     (30.3, 72, 15.4, 3.4, 5.8, "moderate"), (30.4, 70, 26.6, 7.8, 9.1, "moderate")],
    [(26.2, 41, 13.3, 1.4, 8.9, "moderate"), (27.4, 30, 15.2, 0, 18.4, "high"), (27.2, 31, 11.2, 0.8, 12.5, "high"),
     (24.9, 47, 10.7, 18.6, 1.4, "low"), (21.2, 69, 10.8, 9.9, 1.6, "low")],
    [(20.6, 82, 23.9, 0, 11.7, "moderate"), (21.0, 86, 29.8, 0, 13.7, "high"), (21.9, 86, 21.1, 0.1, 9.8, "moderate"),
     (21.4, 83, 26.2, 0, 12.6, "high"), (20.8, 82, 26.5, 0, 12.9, "high")],
    [(29.4, 72, 17.4, 0, 10.5, "moderate"), (29.3, 76, 17.1, 0, 10.4, "moderate"), (29.5, 67, 12.8, 0, 9.5, "moderate"),
     (29.2, 68, 20.0, 0, 12.5, "high"), (28.8, 72, 23.5, 0, 13.4, "high")],
    [(31.4, 58, 23.9, 1.4, 15.7, "high"), (32.2, 58, 21.6, 0.6, 16.6, "high"), (33.0, 55, 22.4, 0.4, 18.6, "high"),
     (33.6, 49, 22.0, 0, 20.5, "very_high"), (33.2, 54, 18.9, 1.2, 14.6, "high")],
    [(28.8, 73, 18.5, 0, 11.0, "moderate"), (28.8, 75, 15.5, 0, 9.7, "moderate"), (28.7, 71, 16.3, 1.0, 8.9, "moderate"),
     (28.6, 69, 19.9, 0, 12.1, "high"), (28.7, 70, 24.2, 0, 14.1, "high")],
]


def responses():
    """The rows as landed weather responses (JSON-ready)."""
    for (lat, lon, temp, rh, wind, rain, *_), days in zip(CURRENT, FORECAST):
        yield {
            "lat": lat,
            "lon": lon,
            "fetched_at": "2026-07-02T20:36:48.950077+00:00",
            "current": {
                "temperature_2m": temp,
                "relative_humidity_2m": rh,
                "wind_speed_10m": wind,
                "wind_direction_10m": 121,
                "precipitation": rain,
            },
            "daily": {
                "time": [f"2026-07-0{2 + i}" for i in range(5)],
                "temperature_2m_max": [d[0] for d in days],
                "relative_humidity_2m_min": [d[1] for d in days],
                "wind_speed_10m_max": [d[2] for d in days],
                "precipitation_sum": [d[3] for d in days],
            },
        }
