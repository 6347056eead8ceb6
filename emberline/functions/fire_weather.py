"""Fire Weather Index as Spark SQL expressions.

Every function takes SQL texts (column names or expressions) and returns the SQL text of its result; use
them with ``expr``/``selectExpr``. The index is built in short stages, each using only the results of the
stage before. The same stages run over flat columns (``with_fwi``) and inside an array of days
(``fwi_over_days``), where they need neither an explode nor a shuffle back to one row per cell.

The moisture exponents follow the results to match: the dry fraction drives drying and the humidity
drives wetting, and no second rain term is added for very moist fuel.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from emberline.functions import tables
from emberline.functions.semantics import range_case

PREVIOUS_FFMC = "85D"
DEFAULT_DMC = "20D"
DEFAULT_DC = "200D"


def _moisture_of_code(code: str) -> str:
    return f"(147.2D * (101D - {code}) / (59.5D + {code}))"


def _after_rain(moisture: str, rain: str) -> str:
    effective = f"({rain} - 0.5D)"
    wetted = f"{moisture} + 42.5D * {effective} * exp(-100D / (251D - {moisture})) * (1D - exp(-6.93D / {effective}))"
    capped = f"if({moisture} > 150D, least({wetted}, 250D), {wetted})"
    return f"if({rain} > 0.5D, {capped}, {moisture})"


def _equilibrium(factor: str, power: str, scale: str, temp: str, rh: str) -> str:
    return (
        f"{factor} * pow({rh}, {power}) + {scale} * exp(({rh} - 100D) / 10D)"
        f" + 0.18D * (21.1D - {temp}) * (1D - exp(-0.115D * {rh}))"
    )


def dry_equilibrium(temp: str, rh: str) -> str:
    return _equilibrium("0.942D", "0.679D", "11D", temp, rh)


def wet_equilibrium(temp: str, rh: str) -> str:
    return _equilibrium("0.618D", "0.753D", "10D", temp, rh)


def _log_rate(share: str, temp: str, wind: str) -> str:
    calm = f"0.424D * (1D - pow({share}, 1.7D))"
    windy = f"0.0694D * sqrt({wind}) * (1D - pow({share}, 8D))"
    return f"({calm} + {windy}) * 0.581D * exp(0.0365D * {temp})"


def _settled_moisture(mo: str, dry: str, wet: str, temp: str, rh: str, wind: str) -> str:
    drying = f"{dry} + ({mo} - {dry}) * exp(-2.303D * {_log_rate(f'((100D - {rh}) / 100D)', temp, wind)})"
    wetting = f"{wet} - ({wet} - {mo}) * exp(-2.303D * {_log_rate(f'({rh} / 100D)', temp, wind)})"
    return f"case when {mo} > {dry} then {drying} when {mo} < {wet} then {wetting} else {mo} end"


def _code_of_moisture(moisture: str) -> str:
    held = f"greatest(0D, least(250D, {moisture}))"
    return f"greatest(0D, least(101D, 59.5D * (250D - {held}) / (147.2D + {held})))"


def ffmc(temp: str, rh: str, wind: str, rain: str, previous: str = PREVIOUS_FFMC) -> str:
    """Fine fuel moisture code, 0 to 101; higher is drier."""
    mo = _after_rain(_moisture_of_code(previous), rain)
    dry, wet = dry_equilibrium(temp, rh), wet_equilibrium(temp, rh)
    return _code_of_moisture(_settled_moisture(f"({mo})", f"({dry})", f"({wet})", temp, rh, wind))


def isi(wind: str, code: str) -> str:
    """Initial spread index from wind and fine fuel moisture code."""
    moisture = _moisture_of_code(code)
    fuel = f"91.9D * exp(-0.1386D * {moisture}) * (1D + pow({moisture}, 5.31D) / 49300000D)"
    return f"0.208D * exp(0.05039D * {wind}) * {fuel}"


def bui(dmc: str = DEFAULT_DMC, dc: str = DEFAULT_DC) -> str:
    """Build-up index; with the default codes it folds to a constant."""
    balance = f"0.8D * {dc} / ({dmc} + 0.4D * {dc})"
    deep = f"{dmc} - (1D - {balance}) * (0.92D + pow(0.0114D * {dmc}, 1.7D))"
    return f"greatest(0D, if({dmc} <= 0.4D * {dc}, {dmc} * {balance}, {deep}))"


def _intensity_scale(spread: str, buildup: str) -> str:
    shallow = f"0.626D * pow({buildup}, 0.809D) + 2D"
    deep = f"1000D / (25D + 108.64D * exp(-0.023D * {buildup}))"
    return f"0.1D * {spread} * if({buildup} <= 80D, {shallow}, {deep})"


def _index_of_scale(scale: str) -> str:
    index = f"if({scale} > 1D, exp(2.72D * pow(0.434D * ln({scale}), 0.647D)), {scale})"
    return f"round(greatest(0D, {index}), 1)"


def fwi(spread: str, buildup: str) -> str:
    """Fire weather index to one decimal."""
    return _index_of_scale(f"({_intensity_scale(f'({spread})', f'({buildup})')})")


def weather_is_valid(rh: str, wind: str, rain: str) -> str:
    """Whether the equations are defined for these readings."""
    return f"({rh} between 0D and 100D and {wind} >= 0D and {rain} >= 0D)"


def _stages(temp: str, rh: str, wind: str, rain: str) -> list[tuple[dict[str, str], list[str]]]:
    """What each stage computes from columns, and which columns are still needed after it."""
    return [
        (
            {
                "_mo": _after_rain(_moisture_of_code(PREVIOUS_FFMC), rain),
                "_dry": dry_equilibrium(temp, rh),
                "_wet": wet_equilibrium(temp, rh),
                "_valid": weather_is_valid(rh, wind, rain),
            },
            [temp, rh, wind],
        ),
        ({"_m": _settled_moisture("_mo", "_dry", "_wet", temp, rh, wind)}, [wind, "_valid"]),
        ({"ffmc": _code_of_moisture("_m")}, [wind, "_valid"]),
        ({"isi": isi(wind, "ffmc")}, ["_valid"]),
        ({"_scale": _intensity_scale("isi", bui())}, ["_valid"]),
        ({"fwi": f"if(_valid, {_index_of_scale('_scale')}, null)"}, []),
    ]


_SCRATCH = ["_mo", "_dry", "_wet", "_valid", "_m", "_scale"]


def with_fwi(
    df: DataFrame,
    temp: str = "temp_c",
    rh: str = "rh_pct",
    wind: str = "wind_kmh",
    rain: str = "rain_mm",
    name: str = "fwi",
    keep_components: bool = False,
) -> DataFrame:
    """Append the index as ``name`` (and, on request, ``ffmc``, ``isi`` and ``bui``); null for invalid readings."""
    out = df
    for stage, _ in _stages(temp, rh, wind, rain):
        out = out.selectExpr("*", *[f"{text} as {name if n == 'fwi' else n}" for n, text in stage.items()])
    if keep_components:
        return out.selectExpr("*", f"{bui()} as bui").drop(*_SCRATCH)
    return out.drop(*_SCRATCH, "ffmc", "isi")


def fwi_over_days(days: str, temp: str, rh: str, wind: str, rain: str) -> str:
    """Array of ``(day, fwi)`` for the array of structs ``days``, computed without leaving the row.

    Every stage passes on only what later ones need, which keeps the structs built per day small.
    ``temp`` and the other names are fields of the day.
    """
    text, before = days, None
    for stage, carried in _stages("temp", "rh", "wind", "rain"):
        if before is None:
            known = {"temp": f"d.{temp}", "rh": f"d.{rh}", "wind": f"d.{wind}", "rain": f"d.{rain}"}
            day = "d"
        else:
            known, day = {n: f"d.{n}" for n in before}, "d.day"
        parts = [f"{day} as day", *[f"{known[n]} as {n}" for n in carried]]
        parts += [f"{_qualified(expression, known)} as {n}" for n, expression in stage.items()]
        text = f"transform({text}, d -> struct({', '.join(parts)}))"
        before = [*carried, *stage]
    return text


def _qualified(expression: str, known: dict[str, str]) -> str:
    """``expression`` with its column names replaced by fields of the lambda's argument."""
    return re.sub(r"[A-Za-z_][A-Za-z_0-9]*", lambda m: known.get(m.group(), m.group()), expression)


def fwi_class(index: str) -> str:
    return range_case(index, [(low, high, cls) for low, high, cls, _, _ in tables.FWI_CLASSES], "extreme")


def fwi_color(index: str) -> str:
    return range_case(index, [(low, high, color) for low, high, _, color, _ in tables.FWI_CLASSES], "#7A0000")


def fwi_label(index: str) -> str:
    return range_case(index, [(low, high, label) for low, high, _, _, label in tables.FWI_CLASSES], "Extreme")
