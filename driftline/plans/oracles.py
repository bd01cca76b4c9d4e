"""DuckDB SQL for the trajectory queries: common table expressions that the queries' own text builds on."""

from __future__ import annotations

from driftline.functions.geodesic import FLAT, ITERATIONS, A, B


def inverse(source: str, name: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Common table expressions ending in ``name``: ``source`` with the geodesic distance ``d``."""
    f, c = repr(FLAT), []
    c.append(
        f"{name}_0 as (select *, radians({lon2} - {lon1}) as l_, radians({lon2} - {lon1}) as lam_, atan((1 - {f}) * tan(radians({lat1}))) as u1_, atan((1 - {f}) * tan(radians({lat2}))) as u2_ from {source})"
    )
    for i in range(ITERATIONS):
        c.append(
            f"{name}_{i}a as (select *, sqrt(pow(cos(u2_) * sin(lam_), 2) + pow(cos(u1_) * sin(u2_) - sin(u1_) * cos(u2_) * cos(lam_), 2)) as ss_, "
            f"sin(u1_) * sin(u2_) + cos(u1_) * cos(u2_) * cos(lam_) as cs_ from {name}_{i})"
        )
        c.append(f"{name}_{i}b as (select *, atan2(ss_, cs_) as sig_, case when ss_ = 0 then 0 else cos(u1_) * cos(u2_) * sin(lam_) / ss_ end as sa_ from {name}_{i}a)")
        c.append(
            f"{name}_{i}c as (select *, 1 - sa_ * sa_ as c2a_, case when 1 - sa_ * sa_ = 0 then 0 else cs_ - 2 * sin(u1_) * sin(u2_) / (1 - sa_ * sa_) end as c2m_, "
            f"{f} / 16 * (1 - sa_ * sa_) * (4 + {f} * (4 - 3 * (1 - sa_ * sa_))) as c_ from {name}_{i}b)"
        )
        drop = "lam_, ss_, cs_, sig_, sa_, c2a_, c2m_, c_" if i + 1 < ITERATIONS else "lam_"
        c.append(f"{name}_{i + 1} as (select * exclude ({drop}), l_ + (1 - c_) * {f} * sa_ * (sig_ + c_ * ss_ * (c2m_ + c_ * cs_ * (-1 + 2 * c2m_ * c2m_))) as lam_ from {name}_{i}c)")
    c.append(
        f"{name}_s as (select *, 1 + w_ / 16384 * (4096 + w_ * (-768 + w_ * (320 - 175 * w_))) as a_, w_ / 1024 * (256 + w_ * (-128 + w_ * (74 - 47 * w_))) as b_ "
        f"from (select *, c2a_ * {(A * A - B * B) / (B * B)!r} as w_ from {name}_{ITERATIONS}))"
    )
    c.append(
        f"{name} as (select *, case when ss_ = 0 then 0 else {B!r} * a_ * (sig_ - b_ * ss_ * (c2m_ + b_ / 4 * (cs_ * (-1 + 2 * c2m_ * c2m_) "
        f"- b_ / 6 * c2m_ * (-3 + 4 * ss_ * ss_) * (-3 + 4 * c2m_ * c2m_)))) end as d from {name}_s)"
    )
    return ",\n".join(c)


_VIEW = """
  select 219000000 + user_id as mmsi, 1704067200 + q as ts_s, event_id as seq,
    55e0 + 2e0 * tri / 43200e0 + case when event_id % 97 = 0 then 5e-1 else 0e0 end as lat,
    6e0 + (user_id % 10) + 5e-1 * tri / 43200e0 as lon,
    case when user_id % 7 = 0 then floor(value * 100e0 / 60e0) / 100e0 else floor(value * 100e0 / 8e0) / 100e0 end as sog,
    (event_id * 37 % 3600) / 10e0 as cog,
    case when event_id % 11 = 0 then null else event_id * 13 % 360 end as heading,
    case when event_id % 13 = 0 then null else (event_id * 7 % 41 - 20) / 1e0 end as rot,
    case event_type when 'click' then 'Under way using engine' when 'view' then 'Under way sailing' when 'signup' then 'Moored'
      when 'purchase' then 'Engaged in fishing' else 'no such status' end as nav_text,
    case user_id % 8 when 0 then 'Cargo' when 1 then 'Tanker' when 2 then 'Fishing' when 3 then 'Sailing' when 4 then 'Pleasure'
      when 5 then 'Passenger' when 6 then 'Tug' else (case when event_id % 3 = 0 then 'Cargo' else 'Undefined' end) end as ship_text,
    date '1970-01-01' + cast(floor((1704067200 + q) / 86400e0) as int) as file_date
  from (select *, case when p < 43200 then p else 86400 - p end as tri
    from (select *, (q + user_id * 3571) % 86400 as p
      from (select *, cast(floor((cast(floor(epoch(ts)) as bigint) - 1704067200) / 20e0) as bigint) as q from events)))
"""

# Fixed values, written out again so that the queries' own tables are compared with them.
_NAV = """case nav_text when 'Under way using engine' then 0 when 'At anchor' then 1 when 'Not under command' then 2 when 'Restricted maneuverability' then 3
  when 'Constrained by her draught' then 4 when 'Moored' then 5 when 'Aground' then 6 when 'Engaged in fishing' then 7 when 'Under way sailing' then 8 else 15 end"""
_SHIP = """case ship_text when 'Cargo' then 70 when 'Tanker' then 80 when 'Fishing' then 30 when 'Passenger' then 60 when 'Tug' then 52 when 'Sailing' then 37
  when 'Pleasure' then 36 else 0 end"""

_OK = "lat between 54 and 59 and lon between 5 and 17 and sog between 0 and 30 and cog between 0 and 360"

CTES = f"""
raw as ({_VIEW}),
ais as (select *, {_NAV} as nav_status, {_SHIP} as vessel_type from raw),
msg as (select * from ais where {_OK}),
gapped as (select *, ts_s - lag(ts_s) over (partition by mmsi order by ts_s, seq) as gap_s from msg),
voy as (select *, cast(sum(case when gap_s > 7200 then 1 else 0 end) over (partition by mmsi order by ts_s, seq rows unbounded preceding) as bigint) as voyage from gapped),
vstat as (select mmsi, voyage, count(*) as n, min(ts_s) as t0, max(ts_s) as tn from voy group by all),
longstat as (select * from vstat where n >= 20 and tn - t0 >= 14400),
longv as (select voy.* from voy join longstat using (mmsi, voyage)),
idx as (select *, cast(row_number() over (partition by mmsi, voyage order by ts_s, seq) - 1 as integer) as idx from longv),
ends as (select mmsi, voyage, arg_min(lat, (ts_s, seq)) as lat1, arg_min(lon, (ts_s, seq)) as lon1, arg_max(lat, (ts_s, seq)) as lat2, arg_max(lon, (ts_s, seq)) as lon2 from longv group by all),
{inverse("ends", "disp", "lat1", "lon1", "lat2", "lon2")},
legs as (select mmsi, voyage, lat, lon, lead(lat) over w as lat2, lead(lon) over w as lon2 from longv window w as (partition by mmsi, voyage order by ts_s, seq)),
{inverse("legs", "leg", "lat", "lon", "lat2", "lon2")},
pathl as (
  select p.mmsi, p.voyage, length, disp.d as displacement, case when disp.d > 0 then length / disp.d else 1e0 end as length_over_displacement
  from (select mmsi, voyage, coalesce(sum(d), 0e0) as length from leg group by all) p join disp using (mmsi, voyage)),
nearp as (
  select x.mmsi, x.voyage, x.idx as a, y.idx as b, y.ts_s - x.ts_s as dt, x.lat, x.lon, y.lat as lat2, y.lon as lon2
  from idx x join idx y on x.mmsi = y.mmsi and x.voyage = y.voyage and y.idx - x.idx between 1 and 4 and y.ts_s - x.ts_s > 2),
{inverse("nearp", "edge", "lat", "lon", "lat2", "lon2")},
edges as (select mmsi, voyage, a, b from edge where d / dt > 30 * 0.514444e0),
stated as (
  select mmsi, voyage, nav_status as nav, count(*) as c from longv where nav_status <> 15 group by all),
moded as (select mmsi, voyage, arg_min(nav, (-c, nav)) as nav from stated group by all),
feat as (
  select mmsi, voyage, avg(sog) as speed_avg, max(sog) as speed_max, stddev_pop(sog) as speed_std, coalesce(any_value(nav), 15) as nav_status,
         cast(max(ts_s) - min(ts_s) as double) as duration, cast(hour(make_timestamp(min(ts_s) * 1000000)) as integer) as hour_start, cast(month(make_timestamp(min(ts_s) * 1000000)) as integer) as month,
         max(lat) as lat_max, min(lat) as lat_min, max(lon) as lon_max, min(lon) as lon_min, avg(lat) as lat_mean, avg(lon) as lon_mean,
         median(lat) as lat_median, median(lon) as lon_median, stddev_pop(cog) as cog_std
  from longv left join moded using (mmsi, voyage) group by mmsi, voyage),
typed as (
  select file_date, mmsi, arg_min(vessel_type, (-c, vessel_type)) as vessel_type
  from (select file_date, mmsi, vessel_type, count(*) as c from msg where vessel_type <> 0 group by all) group by file_date, mmsi),
types as (select mmsi, arg_max(vessel_type, file_date) as vessel_type from typed group by mmsi),
lab as (
  select feat.*, case when (mmsi + voyage) % 9 = 0 then -1 else cast(mmsi % 5 as integer) end as label,
         coalesce(types.vessel_type, 59) as vessel_type from feat left join types using (mmsi)),
labc as (
  select *, case when vessel_type between 70 and 78 then 'Cargo' when vessel_type between 80 and 88 then 'Tanker' when vessel_type = 30 then 'Fishing'
    when vessel_type in (36, 37) then 'Sailing/Pleasure' else 'Other' end as vessel_class from lab),
classes as (select unnest(['Cargo', 'Tanker', 'Fishing', 'Sailing/Pleasure', 'Other']) as vessel_class),
stat as (
  select feature, avg(v) as m, stddev_samp(v) as s from (unpivot labc on speed_avg, speed_std, speed_max, duration, lat_mean, lon_mean, cog_std into name feature value v) group by feature),
prof as (
  select label, feature, avg((v - m) / s) as z
  from (unpivot (select * from labc where label <> -1) on speed_avg, speed_std, speed_max, duration, lat_mean, lon_mean, cog_std into name feature value v) join stat using (feature) group by label, feature),
brk as (select *, lead(ts_s) over w as ts2, lead(sog) over w as sog2, lead(cog) over w as cog2, lead(heading) over w as heading2, lead(rot) over w as rot2, lead(nav_status) over w as nav2
        from longv window w as (partition by mmsi, voyage order by ts_s, seq)),
fine as (select mmsi, voyage from brk group by all having coalesce(max(ts2 - ts_s), 0) <= 7200),
grid as (select mmsi, voyage, t0, unnest(range(t0, tn, 300)) as t from longstat semi join fine using (mmsi, voyage)),
tick as (
  select grid.mmsi, grid.voyage, cast((t - grid.t0) / 300 as bigint) as tick, t, sog + (sog2 - sog) * ((t - ts_s) / (ts2 - ts_s)) as sog, cog + (cog2 - cog) * ((t - ts_s) / (ts2 - ts_s)) as cog,
         heading + (heading2 - heading) * ((t - ts_s) / (ts2 - ts_s)) as heading, rot + (rot2 - rot) * ((t - ts_s) / (ts2 - ts_s)) as rot,
         case when t - ts_s <= ts2 - t then nav_status else nav2 end as nav_status
  from grid join brk on brk.mmsi = grid.mmsi and brk.voyage = grid.voyage and ts_s <= t and t < ts2),
chunked as (select *, cast(tick // 288 as integer) as chunk, cast(tick % 288 as integer) as step from tick),
chstat as (
  select *, cast(row_number() over (partition by mmsi order by voyage, chunk) - 1 as integer) as k
  from (select mmsi, voyage, chunk, count(*) as n_ticks, avg(case when sog < 2 then 1 else 0 end) as slow_share from chunked group by all) where n_ticks >= 48),
vec as (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
cen as (select label, pos, avg(cast(v as double)) as mean, count(*) as n from vec group by all),
vdist as (select vec_id, label, sqrt(sum(pow(cast(v as double) - mean, 2))) as dist from vec join cen using (label, pos) group by all),
rad as (select label, avg(dist) as radius from vdist group by label),
cgap as (
  select x.label as i, y.label as j, sqrt(sum(pow(x.mean - y.mean, 2))) as d, any_value(x.n) as ni, any_value(y.n) as nj
  from cen x join cen y on x.pos = y.pos and x.label <> y.label group by all)
"""


def direct(source: str, name: str, lat: str, lon: str, azimuth: str, distance: str) -> str:
    """Common table expressions ending in ``name``: ``source`` with the point (``to_lat``, ``to_lon``) reached by the direct formula."""
    f, c = repr(FLAT), []
    turn = "b_ * sin({s}) * (cos(2 * s1_ + {s}) + b_ / 4 * (cos({s}) * (-1 + 2 * pow(cos(2 * s1_ + {s}), 2)) - b_ / 6 * cos(2 * s1_ + {s}) * (-3 + 4 * pow(sin({s}), 2)) * (-3 + 4 * pow(cos(2 * s1_ + {s}), 2))))"
    c.append(f"{name}_p as (select *, (1 - {f}) * tan(radians({lat})) as tu_, {azimuth} as az_ from {source})")
    c.append(f"{name}_q as (select *, 1 / sqrt(1 + tu_ * tu_) as cu_, tu_ / sqrt(1 + tu_ * tu_) as su_, atan2(tu_, cos(az_)) as s1_, sin(az_) / sqrt(1 + tu_ * tu_) as sa_ from {name}_p)")
    c.append(f"{name}_r as (select *, 1 - sa_ * sa_ as ca_, (1 - sa_ * sa_) * {(A * A - B * B) / (B * B)!r} as w_ from {name}_q)")
    c.append(f"{name}_t as (select *, 1 + w_ / 16384 * (4096 + w_ * (-768 + w_ * (320 - 175 * w_))) as a_, w_ / 1024 * (256 + w_ * (-128 + w_ * (74 - 47 * w_))) as b_ from {name}_r)")
    c.append(f"{name}_u0 as (select *, {distance} / ({B!r} * a_) as g_, {distance} / ({B!r} * a_) as sig_ from {name}_t)")
    for i in range(ITERATIONS):
        c.append(f"{name}_u{i + 1} as materialized (select * exclude (sig_), g_ + {turn.format(s='sig_')} as sig_ from {name}_u{i})")
    c.append(f"{name}_v as (select *, {f} / 16 * ca_ * (4 + {f} * (4 - 3 * ca_)) as c_, cos(2 * s1_ + sig_) as m_ from {name}_u{ITERATIONS})")
    c.append(
        f"{name} as (select *, degrees(atan2(su_ * cos(sig_) + cu_ * sin(sig_) * cos(az_), (1 - {f}) * sqrt(sa_ * sa_ + pow(su_ * sin(sig_) - cu_ * cos(sig_) * cos(az_), 2)))) as to_lat, "
        f"{lon} + degrees(atan2(sin(sig_) * sin(az_), cu_ * cos(sig_) - su_ * sin(sig_) * cos(az_)) - (1 - c_) * {f} * sa_ * (sig_ + c_ * sin(sig_) * (m_ + c_ * cos(sig_) * (-1 + 2 * m_ * m_)))) as to_lon from {name}_v)"
    )
    return ",\n".join(c)


#: The greedy choice, one removal of every voyage at a time.
_WORST = "select mmsi, voyage, arg_min(node, (-c, node)) as worst from (select mmsi, voyage, node, count(*) as c from (select mmsi, voyage, unnest([a, b]) as node from {src}) group by all) group by all"
GREEDY = f"""turns(step, mmsi, voyage, a, b, worst) as (
  select 0, mmsi, voyage, a, b, worst from edges join ({_WORST.format(src="edges")}) using (mmsi, voyage)
  union all
  select step + 1, mmsi, voyage, a, b, w.worst from (select step, mmsi, voyage, a, b from turns where a <> worst and b <> worst)
  join ({_WORST.format(src="turns where a <> worst and b <> worst")}) w using (mmsi, voyage)),
bad as (select distinct mmsi, voyage, cast(worst as integer) as idx from turns),
cleaned as (select idx.* from idx anti join bad using (mmsi, voyage, idx))"""


def sampling(source: str, p: str) -> str:
    """Ticks of ``source`` with positions (``{p}at``), its chunks (``{p}chstat``) and what is lost (``{p}fine``); names begin with ``p``."""
    between = lambda c: f"{c} + ({c}2 - {c}) * ((t - ts_s) / (ts2 - ts_s)) as {c}"
    azimuth = "atan2(cos(u2_) * sin(lam_), cos(u1_) * sin(u2_) - sin(u1_) * cos(u2_) * cos(lam_))"
    return f"""
{p}brk as (select mmsi, voyage, ts_s, lat, lon, sog, cog, heading, rot, nav_status, lead(ts_s) over w as ts2, lead(lat) over w as lat2, lead(lon) over w as lon2, lead(sog) over w as sog2,
    lead(cog) over w as cog2, lead(heading) over w as heading2, lead(rot) over w as rot2, lead(nav_status) over w as nav2 from {source} window w as (partition by mmsi, voyage order by ts_s, seq)),
{p}fine as (select mmsi, voyage from {p}brk group by all having coalesce(max(ts2 - ts_s), 0) <= 7200),
{p}grid as (select mmsi, voyage, t0, unnest(range(t0, tn, 300)) as t from (select mmsi, voyage, min(ts_s) as t0, max(ts_s) as tn from {source} group by all) semi join {p}fine using (mmsi, voyage)),
{p}tick as (select g.mmsi, g.voyage, cast((t - g.t0) / 300 as bigint) as tick, t, lat, lon, lat2, lon2, (t - ts_s) / (ts2 - ts_s) as share, {", ".join(between(c) for c in ("sog", "cog", "heading", "rot"))},
    case when t - ts_s <= ts2 - t then nav_status else nav2 end as nav_status from {p}grid g join {p}brk b on b.mmsi = g.mmsi and b.voyage = g.voyage and ts_s <= t and t < ts2),
{inverse(f"{p}tick", f"{p}geo", "lat", "lon", "lat2", "lon2")},
{p}way as (select mmsi, voyage, tick, t, lat, lon, sog, cog, heading, rot, nav_status, d, d * share as part, {azimuth} as azimuth from {p}geo),
{direct(f"{p}way", f"{p}there", "lat", "lon", "azimuth", "part")},
{p}at as (select mmsi, voyage, tick, t, case when d = 0 then lat else to_lat end as lat, case when d = 0 then lon else to_lon end as lon, sog, cog, heading, rot, nav_status from {p}there),
{p}chstat as (select *, cast(row_number() over (partition by mmsi order by voyage, chunk) - 1 as integer) as k from (
    select mmsi, voyage, cast(tick // 288 as integer) as chunk, count(*) as n_ticks, avg(case when sog < 2 then 1 else 0 end) as slow_share from {p}tick group by all) where n_ticks >= 48)"""


#: A sample of 150 vectors by hash, merged by Ward's rule; at 30 clusters those of one point go.
MERGES = """smp as (select cast(nth as integer) as nth, vec_id, embedding from (select *, row_number() over (order by md5(vec_id || ':42'), vec_id) - 1 as nth from embeddings) where nth < 150),
sized as (select count(*) as n from smp),
steps(step, x, y, d, nx, ny, bx, bz, bd, bn) as (
  select 0, x, y, d, 1, 1, arg_min(x, (d, x, y)) over (), arg_min(y, (d, x, y)) over (), min(d) over (), 2 from (
    select a.nth as x, b.nth as y, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::double - z[2]::double, 2))) / 2 as d from smp a join smp b on a.nth < b.nth)
  union all
  select step, x, y, d, nx, ny, arg_min(x, (d, x, y)) over (), arg_min(y, (d, x, y)) over (), min(d) over (), arg_min(nx + ny, (d, x, y)) over () from (
    select step + 1 as step, x, y, d, nx, ny from steps where x not in (bx, bz) and y not in (bx, bz)
    union all
    select step + 1, o, n + step, ((m + na) * da + (m + nb) * db - m * bd) / (m + na + nb), m, na + nb from (
      select step, any_value(bd) as bd, any_value(n) as n, case when x in (bx, bz) then y else x end as o, any_value(case when x in (bx, bz) then ny else nx end) as m,
        max(case when x = bx or y = bx then d end) as da, max(case when x = bz or y = bz then d end) as db,
        max(case when x = bx then nx when y = bx then ny end) as na, max(case when x = bz then nx when y = bz then ny end) as nb
      from steps, sized where (x in (bx, bz)) <> (y in (bx, bz)) group by step, o))
  where step <> (select n - n // 5 from sized) or (nx > 1 and ny > 1)),
merges as (select distinct step, bx as c1, bz as c2, bd as dist, bn as size from steps)"""

_LOST = """lost as (select nth from smp where nth not in (select c1 from merges) and nth not in (select c2 from merges))"""

DENDROGRAM = f"""{MERGES},
{_LOST},
live as (select nth, row_number() over (order by nth) - 1 as r from smp where nth not in (select nth from lost)),
renamed as (select step, a.name as c1, b.name as c2, dist, size, max(step) over () as last
  from merges join (select nth as old, r as name from live union all select n + step, step + (select count(*) from live) from merges, sized) a on a.old = c1
  join (select nth as old, r as name from live union all select n + step, step + (select count(*) from live) from merges, sized) b on b.old = c2)"""


def _way(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(z[1] - z[2], 2))))"


def labels(ks: tuple[int, ...]) -> str:
    """The sample's labels ``grp`` (k, nth, label, v) for each number of clusters."""
    return f"""{MERGES},
{_LOST},
ks as (select unnest({list(ks)}) as k),
up(k, p, name) as (
  select k, nth, nth from smp, ks
  union all
  select up.k, p, n + step from up join merges on name in (c1, c2), sized where step < n - (select count(*) from lost) - up.k),
grp as (select k, p as nth, cast(dense_rank() over (partition by k order by name) - 1 as integer) as label, embedding::double[] as v
  from (select k, p, max(name) as name from up where p not in (select nth from lost) group by k, p) join smp on nth = p)"""


def assigned(ks: tuple[int, ...], compression: float = 0.6, most: int = 20) -> str:
    """``near`` (k, vec_id, label, d): each vector's nearest of up to ``most`` representatives a cluster, chosen farthest first."""
    return f"""{labels(ks)},
mid as (select k, label, list(m order by pos) as c, any_value(size) as size from (
  select k, label, pos, avg(x) as m, count(*) as size from (select k, label, generate_subscripts(v, 1) as pos, unnest(v) as x from grp) group by all) group by k, label),
ff(step, k, label, nth, v, d, pick) as (
  select 0, k, label, nth, v, d, arg_max(nth, (d, -nth)) over (partition by k, label) from (select g.k, g.label, g.nth, g.v, {_way("g.v", "c")} as d from grp g join mid using (k, label) where size > {most})
  union all
  select step, k, label, nth, v, d, arg_max(nth, (d, -nth)) over (partition by k, label) from (
    select f.step + 1 as step, f.k, f.label, f.nth, f.v, case when f.step = 0 then {_way("f.v", "p.v")} else least(f.d, {_way("f.v", "p.v")}) end as d
    from ff f join grp p on p.k = f.k and p.nth = f.pick where f.step < {most - 1})),
reps as (select k, label, list_transform(list_zip(v, c), lambda z: z[1] + {compression!r} * (z[2] - z[1])) as x from grp join mid using (k, label)
  where size <= {most} or (k, nth) in (select k, pick from ff)),
near as (select k, vec_id, arg_min(label, (d, label)) as label, min(d) as d from (select r.k, vec_id, r.label, {_way("embedding::double[]", "r.x")} as d from embeddings, reps r) group by k, vec_id)"""


def evaluated(ks: tuple[int, ...], threshold: float) -> str:
    """``index_of`` (k, w, noise): the Davies-Bouldin index and the share of noise beyond the threshold."""
    return f"""{assigned(ks)},
lab3 as (select k, vec_id, case when d > {threshold!r} then -1 else near.label end as label, embedding::double[] as v from near join embeddings using (vec_id)),
cen3 as (select k, label, list(m order by pos) as c from (select k, label, pos, avg(x) as m from (select k, label, generate_subscripts(v, 1) as pos, unnest(v) as x from lab3 where label <> -1) group by all) group by k, label),
rad3 as (select k, label, c, avg({_way("v", "c")}) as r from lab3 join cen3 using (k, label) group by k, label, c),
index_of as (select k, avg(w) as w from (
  select x.k, x.label, coalesce(max((x.r + y.r) / nullif({_way("x.c", "y.c")}, 0)), 0) as w from rad3 x left join rad3 y on x.k = y.k and x.label <> y.label group by x.k, x.label) group by k)"""


def on(sql: str, more: str = "") -> str:
    return f"with {'recursive ' if 'union all' in more else ''}{CTES}{', ' + more if more else ''}\n{sql}"
