"""The same queries as SQL for DuckDB, over the same stand-in texts."""

from __future__ import annotations

from emberline.functions import tables
from emberline.plans import standins

_TABLES = {name: name for name in ("events", "orders", "supplier", "customer", "nation", "region")}


def _cte(name: str, text: str) -> str:
    return f"{name} as ({text.format(**_TABLES).strip()})"


HOT_RAW = _cte("hot_raw", standins.HOT_RAW)
WX_RAW = _cte("wx_raw", standins.WX_RAW)
WFIGS_RAW = _cte("wfigs_raw", standins.WFIGS_RAW)
CONAFOR_RAW = _cte("conafor_raw", standins.CONAFOR_RAW)
OSM_RAW = _cte("osm_raw", standins.OSM_RAW)
ATTEMPTS = _cte("attempts", standins.LAYER_ATTEMPTS)
PLACES = _cte("places", standins.PLACES_RAW)

HOT = f"""{HOT_RAW}, hot_typed as (
  select event_id, longitude lon, latitude lat,
    case when source_name = 'VIIRS_SNPP_NRT' then 'VIIRS (Suomi NPP)' else 'MODIS (Terra/Aqua)' end source,
    case when source_name = 'VIIRS_SNPP_NRT' then 375 else 1000 end resolution_m,
    try_cast(frp as double) frp, confidence, acq_date,
    acq_date || ' ' || acq_time[1:2] || ':' || acq_time[3:4] || 'Z' acq_datetime,
    cast(acq_date || ' ' || acq_time[1:2] || ':' || acq_time[3:4] || ':00' as timestamp) acq_ts,
    case when daynight = 'D' then 'Day' else 'Night' end daynight,
    cast(floor(longitude*100e0+0.5e0) as bigint) kx, cast(floor(latitude*100e0+0.5e0) as bigint) ky
  from hot_raw where latitude is not null and longitude is not null),
hot as (select *, case when frp is null then 'unknown' when frp < 10 then 'low' when frp < 50 then 'moderate'
    when frp < 200 then 'high' else 'extreme' end intensity from hot_typed),
deduped as (select * from hot m where source like '%VIIRS%' or not exists (
    select 1 from hot v where v.source like '%VIIRS%' and v.kx = m.kx and v.ky = m.ky))"""


def _fwi_steps(source: str, out: str, t: str, h: str, w: str, p: str) -> str:
    """The index over ``source`` in CTE steps, ending in ``out`` (all columns plus ffmc, isi, bui, fwi)."""
    drying = "(1e0-pow((100e0-%s)/100e0,1.7e0))" % h
    return f"""{out}_1 as (select *, 147.2e0*(101e0-85e0)/(59.5e0+85e0) m0,
    0.942e0*pow({h},0.679e0)+11e0*exp(({h}-100e0)/10e0)+0.18e0*(21.1e0-{t})*(1e0-exp(-0.115e0*{h})) ed,
    0.618e0*pow({h},0.753e0)+10e0*exp(({h}-100e0)/10e0)+0.18e0*(21.1e0-{t})*(1e0-exp(-0.115e0*{h})) ew
  from {source}),
{out}_2 as (select *, case when {p} > 0.5e0
    then m0+42.5e0*({p}-0.5e0)*exp(-100e0/(251e0-m0))*(1e0-exp(-6.93e0/({p}-0.5e0))) else m0 end mo from {out}_1),
{out}_3 as (select *, case
    when mo > ed then ed+(mo-ed)*exp(-2.303e0*(0.424e0*{drying}+0.0694e0*sqrt({w})*(1e0-pow((100e0-{h})/100e0,8e0)))*0.581e0*exp(0.0365e0*{t}))
    when mo < ew then ew-(ew-mo)*exp(-2.303e0*(0.424e0*(1e0-pow({h}/100e0,1.7e0))+0.0694e0*sqrt({w})*(1e0-pow({h}/100e0,8e0)))*0.581e0*exp(0.0365e0*{t}))
    else mo end m from {out}_2),
{out}_4 as (select *, greatest(0e0,least(101e0,59.5e0*(250e0-greatest(0e0,least(250e0,m)))/(147.2e0+greatest(0e0,least(250e0,m))))) ffmc from {out}_3),
{out}_5 as (select *, 147.2e0*(101e0-ffmc)/(59.5e0+ffmc) fm, 0.8e0*20e0*200e0/(20e0+0.4e0*200e0) bui from {out}_4),
{out}_6 as (select *, 0.208e0*exp(0.05039e0*{w})*91.9e0*exp(-0.1386e0*fm)*(1e0+pow(fm,5.31e0)/49300000e0) isi from {out}_5),
{out}_7 as (select *, 0.1e0*isi*(0.626e0*pow(bui,0.809e0)+2e0) b from {out}_6),
{out} as (select *, round(greatest(0e0,case when b > 1e0 then exp(2.72e0*pow(0.434e0*ln(b),0.647e0)) else b end),1) fwi from {out}_7)"""


def _fwi_case(position: int, default: str) -> str:
    arms = " ".join(f"when fwi >= {row[0]} and fwi < {row[1]} then '{row[position]}'" for row in tables.FWI_CLASSES)
    return f"case {arms} else '{default}' end"


RISK_CLASS, RISK_COLOR, RISK_LABEL = _fwi_case(2, "extreme"), _fwi_case(3, "#7A0000"), _fwi_case(4, "Extreme")

WX = f"{WX_RAW}, {_fwi_steps('wx_raw', 'wx', 'temp_c', 'rh_pct', 'wind_kmh', 'rain_mm')}"
DAYS = f"""wx_daily as (
  select w.point_id, w.temp_c, w.rh_pct, w.wind_kmh, d.day_i, cast(cast(fetched_at as date) + cast(d.day_i as int) as varchar) date,
    case when (w.point_id+d.day_i)%29=0 then 0e0 else w.temp_c+1.5e0*d.day_i-2e0 end t_raw,
    case when (w.point_id+d.day_i)%31=0 then cast(null as double) else 5e0+cast((w.point_id*13+d.day_i*11)%95 as double) end h_raw,
    cast((w.point_id*17+d.day_i*53)%450 as double)/10e0 w_raw,
    case when (w.point_id+d.day_i)%3=0 then cast((w.point_id+d.day_i)%83 as double)/10e0 else 0e0 end p_raw
  from wx_raw w cross join (select unnest(range(5)) day_i) d),
wx_day as (select point_id, day_i, date, coalesce(nullif(t_raw,0),temp_c) temp_max, coalesce(nullif(h_raw,0),rh_pct) rh_min,
    coalesce(nullif(w_raw,0),wind_kmh) wind_max, coalesce(nullif(p_raw,0),0e0) rain from wx_daily),
{_fwi_steps('wx_day', 'fc', 'temp_max', 'rh_min', 'wind_max', 'rain')},
per_point as (select point_id, max(case when day_i=3 then fwi end) later,
    string_agg(concat_ws(':', date, cast(fwi as varchar), {RISK_CLASS}, cast(temp_max as varchar), cast(rh_min as varchar),
      cast(wind_max as varchar), cast(rain as varchar)), '|' order by day_i) forecast, count(*) n_days
  from fc group by point_id),
trended as (select wx.*, forecast, n_days, {RISK_CLASS} risk_class, {RISK_LABEL} risk_label, {RISK_COLOR} risk_color,
    case when later > fwi*1.2e0 then 'escalating' when later < fwi*0.8e0 then 'de-escalating' else 'steady' end trend
  from wx join per_point using (point_id))"""
WX_TREND = f"{WX}, {DAYS}"

_PLACED = """case when {id}%4=0 then null when {id}%4=1 then 'MultiPolygon' else 'Polygon' end shape,
  case when {id}%4=0 then null when {id}%4=1
    then '[[[[' || {id}%90 || ',1],[2.5,3],[4,5.5],[' || {id}%90 || ',1]]],[[[7,8],[9,8],[9,9],[7,8]]]]'
    else '[[[' || {id}%90 || ',1],[2.5,3],[4,-5.5],[' || {id}%90 || ',1]]]' end coordinates"""

#: What the JSON texts of the features say, from the columns they are made of.
PARSED = f"""with usa as (select o_orderkey id, 'USA' country,
    case when o_orderkey%41=0 then 'Unknown Fire' else 'Fire }}]{{[ ' || o_orderkey end "name",
    case when o_orderkey%50<>0 then o_orderkey%9000+0.5e0 end acres, cast(o_orderdate as varchar) date_created, cast(null as varchar) date_updated,
    case when o_orderkey%3=1 then o_orderstatus else '' end category, cast(null as varchar) state, cast(null as varchar) municipality,
    {_PLACED.format(id='o_orderkey')} from orders),
mexico as (select s_suppkey id, 'Mexico' country,
    case when s_suppkey%5=3 then cast(s_suppkey as varchar) when s_suppkey%5=4 then 'Incendio Activo' else s_name end "name",
    cast(case s_suppkey%8 when 0 then 12.34e0 when 2 then s_nationkey when 4 then s_suppkey+0.25e0 when 5 then 7.25e0 when 6 then 1 else 0 end as double) ha,
    cast(null as varchar) date_created, case s_suppkey%7 when 0 then '2024' when 1 then null when 2 then '20240131' else '' end date_updated,
    cast(null as varchar) category, cast(s_nationkey as varchar) state, '' municipality, {_PLACED.format(id='s_suppkey')} from supplier)
select id, country, "name", acres, round(coalesce(acres,0e0)*0.404686e0,1) hectares, date_created, date_updated, category, state, municipality, shape, coordinates from usa
union all
select id, country, "name", round(ha*2.47105e0,1), round(ha,1), date_created, date_updated, category, state, municipality, shape, coordinates from mexico"""

#: The same with the envelopes of the shapes.
ENVELOPES = f"""with parsed as ({PARSED}), placed as (select *, cast(id%90 as double) x from parsed)
select id, country, "name", acres, hectares, date_updated, state, shape, coordinates,
  cast(case id%4 when 0 then 0 when 1 then 8 else 4 end as bigint) n_vertices, case when id%4<>0 then least(x,2.5e0) end west,
  case when id%4=1 then 1e0 when id%4>1 then -5.5e0 end south, case when id%4=1 then greatest(x,9e0) when id%4>1 then greatest(x,4e0) end east,
  case when id%4=1 then 9e0 when id%4>1 then 3e0 end north from placed"""

PERIM = f"""{WFIGS_RAW}, {CONAFOR_RAW},
usa as (select id, coalesce(incident_name,'Unknown Fire') as name, gis_acres acres,
    round(coalesce(gis_acres,0e0)*0.404686e0,1) hectares, create_date date_created, update_date date_updated,
    category, behavior, 'USA' country, 'NIFC WFIGS' source, 'https://data-nifc.opendata.arcgis.com/' source_url,
    cast(null as varchar) state, cast(null as varchar) municipality from wfigs_raw),
mex_raw as (select id, coalesce(nullif(nombre_upper,''),nullif(nombre_lower,''),nullif(incendio,''),'Incendio Activo') as name,
    coalesce(try_cast(nullif(superficie,'') as double),0e0) ha, coalesce(estado,'') state from conafor_raw),
mexico as (select id, name, round(ha*2.47105e0,1) acres, round(ha,1) hectares, cast(null as varchar) date_created, '' date_updated,
    cast(null as varchar) category, cast(null as varchar) behavior, 'Mexico' country, 'CONAFOR' source,
    'https://snigf.cnf.gob.mx/' source_url, state, '' municipality from mex_raw),
perim as (select * from usa union all by name select * from mexico)"""

_PAIRS = [(k, v, label, color) for k, v, label, color in tables.INFRA_CATEGORIES if k in ("amenity", "power")]


def _tag_case(result: int, categories: list, default: str) -> str:
    arms = " ".join(f"when {c[0]}='{c[1]}' then '{c[result]}'" for c in categories if c[0] in ("amenity", "power"))
    return f"case {arms} else {default} end"


_ANY = " or ".join(f"{k}='{v}'" for k, v, *_ in _PAIRS)
_ICONS = " ".join(f"when '{k}' then '{v}'" for k, v in tables.INFRA_ICONS.items())
INFRA = f"""{OSM_RAW}, infra_typed as (select *, {_tag_case(2, tables.INFRA_CATEGORIES, "'Other'")} type,
    {_tag_case(3, tables.INFRA_CATEGORIES, "'#888888'")} color, coalesce({_ANY}, false) tagged
  from osm_raw where el_type in ('node','way') and lat is not null and lon is not null),
infra as (select lon, lat, coalesce(nullif(name,''),nullif(name_en,''),type) as name, type, color,
    case type {_ICONS} else '{tables.INFRA_OTHER_ICON}' end icon, id osm_id, el_type osm_type, '' address,
    coalesce(phone, contact_phone, '') phone, '' as operator, '' capacity, '' emergency, 'OpenStreetMap' source,
    'https://www.openstreetmap.org/' || el_type || '/' || cast(id as varchar) osm_url, tagged from infra_typed)"""
_INFRA_COLUMNS = (
    "lon, lat, name, type, color, icon, osm_id, osm_type, address, phone, operator, capacity, emergency, source, osm_url"
)

STATUS = f"""{ATTEMPTS}, latest as (select layer, max(attempted_at) attempted_at,
    arg_max(generated_at, (attempted_at, attempt_id)) filter (where error is null) generated_at,
    arg_max(coalesce(error,''), (attempted_at, attempt_id)) last_error from attempts group by layer),
aged as (select layer, generated_at, nullif(last_error,'') error, attempted_at,
    cast(trunc(epoch(timestamp '2024-01-31 00:00:00' - generated_at)) as bigint) age_seconds from latest),
status as (select *, case when error is not null or generated_at is null then 'unknown' when age_seconds < 3600 then 'green'
    when age_seconds < 21600 then 'amber' else 'red' end freshness,
    case when generated_at is null then 'Unknown'
      when age_seconds < 3600 then cast(age_seconds//60 as varchar) || ' min ago'
      when age_seconds < 86400 then cast(age_seconds//3600 as varchar) || ' hr ago'
      else cast(age_seconds//86400 as varchar) || case when age_seconds//86400 > 1 then ' days ago' else ' day ago' end end age
  from aged)"""

_LABELS = ", ".join(str(row) for row in tables.LAYER_LABELS)
_DISPLAY = (
    "case when hectares is null or hectares = 0 then 'N/A' "
    "else regexp_replace(format('{:,.1f}', hectares), '\\.0$', '') || ' ha' end"
)
_HOT_COLORS = " ".join(f"when '{k}' then '{v}'" for k, v in tables.INTENSITY_COLORS.items())
_RADIUS = "case when frp is null or frp < 10 then 4 when frp < 50 then 6 when frp < 200 then 9 else 13 end"


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts)


ORACLES = {
    "hotspot_normalize": f"""{_with(HOT)} select event_id, lon, lat, source, resolution_m, frp, intensity, confidence,
        acq_datetime, daynight from hot""",
    "hotspot_dedup": f"{_with(HOT)} select event_id, lon, lat, source, frp, intensity from deduped",
    "hotspot_dedup_daily": f"""{_with(HOT)} select event_id, source, acq_datetime from hot m where source like '%VIIRS%' or not exists (
        select 1 from hot v where v.source like '%VIIRS%' and v.kx = m.kx and v.ky = m.ky and v.acq_date = m.acq_date)""",
    "hotspot_dedup_tiles": f"{_with(HOT)} select event_id, lon, lat, source, frp, intensity from deduped",
    "hotspot_dedup_tiles_daily": f"""{_with(HOT)} select event_id, source, acq_datetime from hot m where source like '%VIIRS%' or not exists (
        select 1 from hot v where v.source like '%VIIRS%' and v.kx = m.kx and v.ky = m.ky and v.acq_date = m.acq_date)""",
    "hotspot_by_intensity": f"{_with(HOT)} select intensity, count(*) n from deduped group by intensity order by intensity",
    "hotspot_lookback": f"""{_with(HOT)} select event_id, source, intensity, acq_datetime from hot
        where acq_ts > timestamp '2024-01-30 00:00:00' and acq_ts <= timestamp '2024-01-31 00:00:00'""",
    "hotspot_world": f"""{_with(HOT)} select source, count(*) n from hot where lat between -90 and 90
        and lon between -180 and 180 group by source order by source""",
    "hotspot_map_view": f"""{_with(HOT)} select event_id, lon, lat, frp,
        case when frp is null or frp = 0 then 'N/A' else regexp_replace(cast(frp as varchar), '\\.0$', '') || ' MW' end frp_label,
        intensity, source, acq_datetime, confidence, case intensity {_HOT_COLORS} end color, {_RADIUS} radius
        from hot where intensity <> 'low'""",
    "hotspot_decimate": f"""{_with(HOT)}, placed as (select *, row_number() over (order by event_id) - 1 i from hot where intensity <> 'low')
        select event_id, lon, lat, intensity from placed where intensity in ('extreme','high')
        or (intensity = 'moderate' and i % 3 = 0) or (intensity not in ('extreme','high','moderate') and i % 8 = 0)""",
    "fwi_components": f"{_with(WX)} select point_id, round(ffmc,3) ffmc, round(isi,3) isi, round(bui,3) bui, fwi from wx",
    "fwi_now": f"""{_with(WX)} select point_id, lat, lon, fwi, {RISK_CLASS} risk_class, {RISK_LABEL} risk_label,
        {RISK_COLOR} risk_color from wx""",
    "fwi_class_rangejoin": f"""{_with(WX)}, classes(low, high, risk_class, risk_color, risk_label) as
        (values {", ".join(str(row) for row in tables.FWI_CLASSES)})
        select coalesce(risk_class,'extreme') risk_class, coalesce(risk_label,'Extreme') risk_label,
          coalesce(risk_color,'#7A0000') risk_color, count(*) n, min(fwi) lowest, max(fwi) highest
        from wx left join classes on fwi >= low and fwi < high group by 1, 2, 3""",
    "fwi_forecast": f"""{_with(WX_TREND)} select point_id, cast(day_i as integer) day_i, date, temp_max, rh_min, wind_max, rain, fwi,
        {RISK_CLASS} risk_class, {RISK_LABEL} risk_label, {RISK_COLOR} color from fc""",
    "fwi_trend": f"{_with(WX_TREND)} select point_id, fwi, n_days, trend from trended",
    "fwi_layer": f"""{_with(WX_TREND)} select point_id, lon, lat, temp_c, rh_pct, wind_kmh, wind_dir_deg, rain_mm, fwi,
        risk_class, risk_label, risk_color, trend, forecast, fetched_at from trended""",
    "fwi_rejected": f"""{_with(WX_RAW)} select case when point_id % 7 = 0 then 'rejected' else 'accepted' end outcome,
        count(*) n from wx_raw group by 1""",
    "weather_layer": f"""{_with(WX_RAW)} select point_id, lon, lat, temp_c, rh_pct, wind_kmh, wind_dir_deg, rain_mm, fetched_at
        from wx_raw where point_id % 101 <> 0""",
    "grid_points": f"""{_with(WX_RAW)}, grid as (select i*4+j cell_no, round(14e0+i*10e0,1) lat, round(-118e0+j*10e0,1) lon
          from (select unnest(range(2)) i) cross join (select unnest(range(4)) j))
        select cell_no, g.lat, g.lon, count(point_id) n_records, count(point_id) = 0 missing
        from grid g left join wx_raw w on floor(w.lat*10e0+0.5e0) = floor(g.lat*10e0+0.5e0)
          and floor(w.lon*10e0+0.5e0) = floor(g.lon*10e0+0.5e0) group by 1, 2, 3""",
    "grid_weather_join": f"""{_with(WX_RAW)}, grid as (select i*321+j cell_no, round(14e0+i*0.1e0,1) lat, round(-118e0+j*0.1e0,1) lon
          from (select unnest(range(191)) i) cross join (select unnest(range(321)) j)),
        newest as (select floor(lat*10e0+0.5e0) ky, floor(lon*10e0+0.5e0) kx, count(*) n_records, max(point_id) point_id
          from wx_raw group by 1, 2)
        select cell_no, g.lat, g.lon, n_records, w.point_id, temp_c, rh_pct, wind_kmh, rain_mm from grid g
        join newest n on n.ky = floor(g.lat*10e0+0.5e0) and n.kx = floor(g.lon*10e0+0.5e0)
        join wx_raw w on w.point_id = n.point_id""",
    "fwi_map_view": f"""{_with(WX_TREND)} select point_id, lon, lat, fwi, risk_class, risk_label, temp_c, rh_pct, wind_kmh, trend,
        risk_color color from trended""",
    "max_fwi_zone": f"""{_with(WX)} select point_id, lat, lon, fwi, {RISK_CLASS} risk_class,
        upper({RISK_LABEL}) panel_label, case {RISK_CLASS} when 'low' then '#38A800' when 'moderate' then '#CCCC00'
          when 'high' then '#FFAA00' when 'very_high' then '#FF4400' else '#AA0000' end panel_color
        from wx where fwi > 0 order by fwi desc, point_id limit 1""",
    "prefire_summary": f"""{_with(WX_TREND)}, counted as (select count_if(risk_class='extreme') extreme_zones,
          count_if(risk_class='very_high') very_high_zones, count_if(trend='escalating') escalating_zones from trended)
        select cast(extreme_zones as bigint) extreme_zones, cast(very_high_zones as bigint) very_high_zones,
          cast(escalating_zones as bigint) escalating_zones,
          case when extreme_zones > 0 then '#AA0000' else '#38A800' end extreme_color,
          case when very_high_zones > 0 then '#FF4400' else '#38A800' end very_high_color,
          case when escalating_zones > 0 then '#FF8800' else '#38A800' end escalating_color,
          case when extreme_zones > 0 then extreme_zones || ' zone(s) at EXTREME fire danger. ' ||
              case when escalating_zones > 0 then escalating_zones || ' zone(s) escalating. ' else '' end ||
              'Consider pre-positioning resources.'
            when very_high_zones > 0 then very_high_zones || ' zone(s) at VERY HIGH fire danger. Monitor conditions closely.'
            else 'Current fire weather conditions are within manageable range.' end alert from counted""",
    "perimeters_unified": f"{_with(PERIM)} select * from perim",
    "perimeter_parse": PARSED,
    "layer_roundtrip": ENVELOPES,
    "perimeter_in_view": f"""select id, country, west, south, east, north from ({ENVELOPES}) t
        where west <= 50 and east >= 40 and south <= 0 and north >= -5.5e0""",
    "weather_parse": f"""{_with(WX_RAW)} select point_id, lon, lat, temp_c, rh_pct, wind_kmh, wind_dir_deg, rain_mm, fetched_at
        from wx_raw where point_id % 101 <> 0 and point_id % 103 <> 0""",
    "frp_band_rangejoin": f"""{_with(HOT + ', ' + _cte("bands", standins.POWER_BANDS))}
        select event_id, frp, band, low, high from hot left join bands on frp >= low and frp < high
        qualify row_number() over (partition by event_id order by band) = 1""",
    "perimeter_top200": f"{_with(PERIM)} select id, name, acres, hectares from usa order by acres desc nulls last, id limit 200",
    "perimeter_first200": f"{_with(PERIM)} select id, name, acres, hectares from mexico order by id limit 200",
    "perimeter_totals": f"""{_with(PERIM)} select count(*) total_fires, cast(sum(cast(hectares as decimal(20,1))) as double) total_hectares,
        cast(count_if(country='USA') as bigint) usa_fires, cast(count_if(country='Mexico') as bigint) mexico_fires from perim""",
    "perimeter_by_country": f"""{_with(PERIM)} select country, count(*) fires,
        cast(sum(cast(hectares as decimal(20,1))) as double) hectares from perim group by country""",
    "perimeter_map_view": f"""{_with(PERIM)} select id, name, {_DISPLAY} area, country,
        coalesce(nullif(date_updated,''),'N/A') updated, source from perim""",
    "largest_fire": f"""{_with(PERIM)} select id, name, hectares, acres, country, source from perim where hectares > 0
        order by hectares desc, id, country limit 1""",
    "largest_fire_card": f"""{_with(PERIM)} select name, format('{{:,}}', cast(floor(hectares+0.5e0) as bigint)) || ' ha' area,
        country, source from perim where hectares > 0 order by hectares desc, id, country limit 1""",
    "infra_normalize": f"{_with(INFRA)} select {_INFRA_COLUMNS} from infra",
    "infra_by_type": f"{_with(INFRA)} select type, count(*) n from infra where tagged group by type order by n desc, type",
    "infra_type_map": f"""{_with(INFRA)}, counts as (select type, count(*) n from infra group by type)
        select cast(sum(n) as bigint) total, string_agg(type || '=' || n, '|' order by type) by_type from counts""",
    "infra_viewport": f"""{_with(OSM_RAW)}, typed as (select *, {_tag_case(2, tables.VIEWPORT_CATEGORIES, "null")} type,
          {_tag_case(3, tables.VIEWPORT_CATEGORIES, "null")} color from osm_raw where el_type in ('node','way') and lat <> 0
          and lat between 18 and 28 and lon between -110 and -95)
        select id, lon, lat, coalesce(nullif(name,''), type) as name, type, color from typed where type is not null""",
    "infra_bbox": f"""{_with(INFRA)} select osm_id, type, lon, lat from infra where tagged
        and lat between 14 and 33 and lon between -118 and -86""",
    "infra_map_view": f"{_with(INFRA)} select osm_id, lon, lat, name, type, color, icon from infra",
    "active_fire_summary": f"""{_with(HOT, PERIM)},
        h as (select count(*) total_detections, cast(count_if(intensity='extreme') as bigint) extreme_detections,
          cast(count_if(intensity='high') as bigint) high_detections from deduped),
        p as (select count(*) total_perimeters, cast(sum(cast(hectares as decimal(20,1))) as double) total_hectares from perim),
        top as (select name, hectares, country, source from perim where hectares > 0 order by hectares desc, id limit 1),
        t as (select *, format('{{:,}}', cast(floor(total_hectares+0.5e0) as bigint)) area from h, p)
        select total_detections, extreme_detections, high_detections, total_perimeters, total_hectares,
          format('{{:,}}', total_detections) || ' active fire detections' badge,
          case when total_hectares > 0 then area || ' ha' else 'N/A' end total_area, top.name largest_name,
          format('{{:,}}', cast(floor(top.hectares+0.5e0) as bigint)) || ' ha' largest_area,
          top.country largest_country, top.source largest_source,
          case when total_detections = 0 then 'No active fire detections in current view.' else
            format('{{:,}}', total_detections) || ' active fire detections globally. ' ||
            case when extreme_detections > 0 then extreme_detections ||
              ' extreme-intensity detections require immediate attention. ' else '' end ||
            case when total_perimeters > 0 then total_perimeters || ' active fire perimeters covering ' || area || ' ha.' else '' end
          end situation from t, top""",
    "layer_last_good": f"{_with(STATUS)} select layer, generated_at, error, attempted_at, age_seconds, freshness, age from status",
    "layer_freshness": f"""{_with(STATUS)}, labels(layer, label, icon, expected) as (values {_LABELS}),
        colors(freshness, background, dot, text_color) as
          (values {", ".join(str((k, *v)) for k, v in tables.FRESHNESS_COLORS.items())}),
        shown as (select l.layer, label, icon, expected, coalesce(freshness,'unknown') freshness, coalesce(age,'Unknown') age
          from labels l left join status s on s.layer = l.layer)
        select layer, label, icon, expected, freshness, age, background, dot, text_color,
          label || ': updated ' || age || ' (expected: ' || expected || ')' title from shown join colors using (freshness)""",
    "layer_errors": f"{_with(STATUS)} select layer, layer || ': ' || error message from status where error is not null",
    "layer_status_flags": f"""{_with(STATUS)} select coalesce(bool_or(error is not null), false) any_error,
        count(*) = 0 all_loading, 5 - count(*) layers_loading from status""",
    "layer_metadata": f"""{_with(HOT, WX_RAW, PERIM, INFRA)},
        kinds as (select type, count(*) n from infra group by type)
        select 'hotspots' layer, '2024-01-31T00:00:00+00:00' generated_at, '{tables.METADATA_TEXT["hotspots"]["source"]}' source,
          count(*) total, '{"|".join(f"{k}={v}" for k, v in tables.INTENSITY_SCALE.items())}' details from deduped
        union all select 'weather', '2024-01-31T00:00:00+00:00', '{tables.METADATA_TEXT["weather"]["source"]}',
          count(*) filter (where point_id % 101 <> 0), 'errors=' || count(*) filter (where point_id % 101 = 0) from wx_raw
        union all select 'fwi', '2024-01-31T00:00:00+00:00', '{tables.METADATA_TEXT["fwi"]["source"]}', count(*),
          '{"|".join(f"{c}:{low}–{high}:{color}" for low, high, c, color, _ in tables.FWI_CLASSES)}' from wx_raw
        union all select 'perimeters', '2024-01-31T00:00:00+00:00',
          '{tables.METADATA_TEXT["perimeters"]["source_usa"]}; {tables.METADATA_TEXT["perimeters"]["source_mexico"]}', count(*),
          'usa=' || count_if(country='USA') || '|mexico=' || count_if(country='Mexico') || '|ha=' || sum(cast(hectares as decimal(20,1)))
          from perim
        union all select 'infrastructure', '2024-01-31T00:00:00+00:00', '{tables.METADATA_TEXT["infrastructure"]["source"]}',
          cast(sum(n) as bigint), string_agg(type || '=' || n, '|' order by type) from kinds""",
    "place_label": f"""{_with(PLACES)} select id, concat_ws(', ', nullif(name,''), nullif(city,''), nullif(country,'')) as label,
        array_to_string(string_split(display_name, ',')[1:3], ',') short_name,
        string_split(display_name, ',')[1] search_text from places""",
    "geojson_features": f"""{_with(HOT)} select event_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' ||
        cast(lon as varchar) || ',' || cast(lat as varchar) || ']}},"properties":' || cast(json_object('source', source,
        'resolution_m', resolution_m, 'frp', frp, 'intensity', intensity, 'confidence', confidence,
        'acq_datetime', acq_datetime, 'daynight', daynight) as varchar) || '}}' feature from deduped""",
}


ORACLES["active_fire_from_parts"] = ORACLES["active_fire_summary"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
