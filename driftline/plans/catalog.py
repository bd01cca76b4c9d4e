"""Every registered trajectory query with its oracle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.geodesic import with_direct, with_inverse
from driftline.functions.hashing import first_by_hash
from driftline.functions.vectors import norm, normalised
from driftline.operators import cells, layout, neighbours, slots, spanning
from driftline.operators import clustering as C
from driftline.operators import counters as N
from driftline.operators import encoding as X
from driftline.operators import evaluation as E
from driftline.operators import features as P
from driftline.operators import frames as G
from driftline.operators import ingest as I
from driftline.operators import outliers as O
from driftline.operators import sketches as K
from driftline.operators import voyages as V
from driftline.operators.asof import asof_join
from driftline.schema import LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, MAX_LEN, SPEED_MAX
from driftline.sources import ais

from .oracles import DENDROGRAM, GREEDY, MERGES, assigned, direct, evaluated, inverse, labels, on, sampling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle's last part."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = on(sql, more)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return I.in_range(ais.from_events(spark, d))


def long_voyages(spark: SparkSession, d: str) -> DataFrame:
    return V.long_messages(messages(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def rounded(df: DataFrame, places: int = 6, *names: str) -> DataFrame:
    """Doubles rounded for comparison."""
    chosen = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, places) for n in chosen})


def _r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) as {n}" for n in names)


MESSAGE = ("mmsi", "ts_s", "seq", "lat", "lon", "sog", "cog", "heading", "rot", "nav_status", "vessel_type")

# Ingest


@query("ais_scan", "select mmsi, ts_s, seq, lat, lon, sog, cog, heading, rot, nav_text, ship_text from raw")
def _(s: SparkSession, d: str) -> DataFrame:
    return ais.from_events(s, d).select("mmsi", "ts_s", "seq", "lat", "lon", "sog", "cog", "heading", "rot", "nav_text", "ship_text")


@query("parse_ts", "select event_id, cast(floor(epoch(ts)) as bigint) as ts_s from events")
def _(s: SparkSession, d: str) -> DataFrame:
    text = F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy HH:mm:ss").alias("# Timestamp")
    raw = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id"), text)
    return raw.select("event_id", F.unix_timestamp(F.try_to_timestamp("# Timestamp", F.lit("dd/MM/yyyy HH:mm:ss"))).alias("ts_s"))


@query("nav_code", "select seq, nav_text, nav_status from ais")
def _(s: SparkSession, d: str) -> DataFrame:
    return ais.from_events(s, d).select("seq", "nav_text", "nav_status")


@query("ship_code", "select seq, ship_text, vessel_type from ais")
def _(s: SparkSession, d: str) -> DataFrame:
    return ais.from_events(s, d).select("seq", "ship_text", "vessel_type")


@query("range_filter", f"select {', '.join(MESSAGE)} from msg")
def _(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).select(*MESSAGE)


@query("day_filter", "select seq, mmsi, ts_s, file_date from msg where ts_s >= epoch(file_date) and ts_s < epoch(file_date) + 86400")
def _(s: SparkSession, d: str) -> DataFrame:
    return I.in_range(ais.from_events(s, d), own_day=True).select("seq", "mmsi", "ts_s", "file_date")


@query("project", "select lat, lon, sog, cog, heading, rot, nav_status, ts_s, mmsi from msg")
def _(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).select("lat", "lon", "sog", "cog", "heading", "rot", "nav_status", "ts_s", "mmsi")


@query("vessel_type_daily", "select file_date, mmsi, vessel_type from typed")
def _(s: SparkSession, d: str) -> DataFrame:
    return I.vessel_type_daily(messages(s, d))


@query("vessel_type_combined", "select mmsi, vessel_type from types")
def _(s: SparkSession, d: str) -> DataFrame:
    return I.vessel_type_combined(I.vessel_type_daily(messages(s, d)))


@query(
    "ingest_stats",
    """select file_date, count(*) as n_raw, count(*) filter (lat between 54 and 59 and lon between 5 and 17 and sog between 0 and 30 and cog between 0 and 360) as n_in_range,
    count(distinct mmsi) as n_vessels, count(distinct case when vessel_type <> 0 then mmsi end) as n_typed_vessels from ais group by file_date""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return I.ingest_stats(ais.from_events(s, d))


@query("vessel_union", "select distinct mmsi from ais where vessel_type <> 0")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = ais.from_events(s, d).filter("vessel_type <> 0")
    return rows.filter("seq % 2 = 0").select("mmsi").union(rows.filter("seq % 2 <> 0").select("mmsi")).distinct()


@query("tracks", "select mmsi, count(*) as n, list(seq order by ts_s, seq) as seqs from msg group by mmsi")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("ts_s", "seq")))
    return messages(s, d).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), rows.alias("r")).select("mmsi", "n", F.col("r.seq").alias("seqs"))


@query("track_merge", "select mmsi, seq, cast(row_number() over (partition by mmsi order by ts_s, seq) as bigint) as place from msg")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = messages(s, d)
    both = rows.filter("ts_s % 2 = 0").unionByName(rows.filter("ts_s % 2 <> 0"))
    return both.select("mmsi", "seq", F.row_number().over(V.by_vessel()).cast("long").alias("place"))


@query(
    "refilter_stats",
    "select mmsi, count(*) as num_messages, count(*) filter (not (lat between 54 and 59 and lon between 5 and 17 and sog <= 30)) as num_discarded from ais group by mmsi",
)
def _(s: SparkSession, d: str) -> DataFrame:
    ok = F.col("lat").between(LAT_MIN, LAT_MAX) & F.col("lon").between(LON_MIN, LON_MAX) & (F.col("sog") <= SPEED_MAX)
    return ais.from_events(s, d).groupBy("mmsi").agg(F.count(F.lit(1)).alias("num_messages"), F.count(F.when(~ok, 1)).alias("num_discarded"))


# Voyages


@query("gaps", "select mmsi, seq, gap_s from gapped")
def _(s: SparkSession, d: str) -> DataFrame:
    return V.gaps(messages(s, d)).select("mmsi", "seq", "gap_s")


@query("voyage_split", "select mmsi, seq, voyage from voy")
def _(s: SparkSession, d: str) -> DataFrame:
    return V.split(messages(s, d)).select("mmsi", "seq", "voyage")


@query("voyages_long", "select mmsi, voyage, n, t0, tn from longstat")
def _(s: SparkSession, d: str) -> DataFrame:
    return slots.stats(messages(s, d), only_long=True)


@query("speed_edges", "select mmsi, voyage, a, b from edges")
def _(s: SparkSession, d: str) -> DataFrame:
    return V.speed_edges(long_voyages(s, d))


@query("koyak", "select mmsi, voyage, idx from bad", GREEDY)
def _(s: SparkSession, d: str) -> DataFrame:
    return O.flagged(long_voyages(s, d))


@query("outlier_clean", "select mmsi, voyage, ts_s, seq, lat, lon, sog, cog from cleaned", GREEDY)
def _(s: SparkSession, d: str) -> DataFrame:
    return O.clean(long_voyages(s, d)).select("mmsi", "voyage", "ts_s", "seq", "lat", "lon", "sog", "cog")


@query("ticks", "select mmsi, voyage, t from tick")
def _(s: SparkSession, d: str) -> DataFrame:
    return V.at_ticks(V.long_brackets(messages(s, d))).select("mmsi", "voyage", "t")


@query("resample", f"select mmsi, voyage, tick, t, {_r('sog', 'cog', 'heading', 'rot', places=9)}, nav_status from tick")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = V.linear(V.at_ticks(V.long_brackets(messages(s, d))))
    return rounded(rows.select("mmsi", "voyage", "tick", "t", "sog", "cog", "heading", "rot", "nav_status"), 9)


_MOVING = ("sog", "cog", "heading", "rot")


@query("resample_positions", f"select mmsi, voyage, tick, t, {_r('lat', 'lon', places=7)}, {_r(*_MOVING, places=9)}, nav_status from l_at", sampling("longv", "l_"))
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(V.positions(V.long_brackets(messages(s, d))), 7, "lat", "lon"), 9, *_MOVING)


@query("resplit", "select mmsi, voyage, chunk, n_ticks, k from chstat")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = V.linear(V.at_ticks(V.long_brackets(messages(s, d))))
    return V.chunk_stats(V.chunks(rows)).select("mmsi", "voyage", "chunk", "n_ticks", "k")


@query("low_speed", "select mmsi, voyage, chunk, k, round(slow_share, 6) as slow_share from chstat where slow_share > 8e-1")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = V.linear(V.at_ticks(V.long_brackets(messages(s, d))))
    return rounded(V.chunk_stats(V.chunks(rows)).filter("slow_share > 0.8").select("mmsi", "voyage", "chunk", "k", "slow_share"))


@query("normalize", f"select seq, {_r('lat', 'lon', 'sog', 'cog', places=9)} from (select seq, (lat - 54) / 5e0 as lat, (lon - 5) / 12e0 as lon, least(sog, 30) / 30e0 as sog, cog / 360e0 as cog from msg)")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(V.normalise(messages(s, d)).select("seq", "lat", "lon", "sog", "cog"), 9)


@query("denormalize", f"select seq, {_r('lat', 'lon', 'sog', 'cog', places=9)} from msg")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(V.denormalise(V.normalise(messages(s, d))).select("seq", "lat", "lon", "sog", "cog"), 9)


_PROCESSED = """select mmsi, t, tick, k, cast(tick % 288 as integer) as step, nav_status, round((lat - 54) / 5e0, 7) as lat, round((lon - 5) / 12e0, 7) as lon,
 round(least(sog, 30) / 30e0, 9) as sog, round(cog / 360e0, 9) as cog, round(heading, 9) as heading, round(rot, 9) as rot
 from c_at join c_chstat using (mmsi, voyage) where chunk = tick // 288 and slow_share <= 8e-1"""


@query("processed_voyages", _PROCESSED, f"{GREEDY}, {sampling('cleaned', 'c_')}")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = V.processed(O.clean(long_voyages(s, d)))
    return rounded(rounded(rows, 7, "lat", "lon"), 9, *_MOVING)


@query(
    "reduce_stats",
    """select cast((select count(*) from ais) as bigint) as num_raw, cast((select count(*) from msg) as bigint) as num_messages, cast((select count(distinct mmsi) from msg) as bigint) as num_vessels,
    cast((select count(*) from vstat) as bigint) as num_initial_voyages, cast((select count(*) from longstat) as bigint) as num_voyages_after_duration_filter""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    raw = ais.from_events(s, d)
    by_voyage = slots.stats(I.in_range(raw))
    long = (F.col("n") >= 20) & (F.col("tn") - F.col("t0") >= 14400)
    counts = by_voyage.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_messages"), F.count_distinct("mmsi").alias("num_vessels"), F.count(F.lit(1)).alias("num_initial_voyages"), F.count(F.when(long, 1)).alias("num_voyages_after_duration_filter"))
    return raw.agg(F.count(F.lit(1)).alias("num_raw")).crossJoin(F.broadcast(counts))  # one row each


_COUNTERS = {
    "num_segments": "select count(*) from (select distinct mmsi, file_date from msg)",
    "num_messages": "select count(*) from msg",
    "num_discarded_filtered": "select (select count(*) from ais) - (select count(*) from msg)",
    "num_initial_voyages": "select count(*) from vstat",
    "num_voyages_after_duration_filter": "select count(*) from longstat",
    "num_messages_removed": "select count(*) from bad",
    "num_voyages_after_outlier_removal": "select count(*) from (select distinct mmsi, voyage from cleaned)",
    "num_outlier_removal_errors": "select (select count(*) from longstat) - (select count(*) from (select distinct mmsi, voyage from cleaned))",
    "num_voyages_after_sampling": "select count(*) from c_fine",
    "num_sampling_errors": "select (select count(*) from (select distinct mmsi, voyage from cleaned)) - (select count(*) from c_fine)",
    "num_resampled_rows": "select count(*) from c_tick",
    "num_final_voyages": "select count(*) from c_chstat where slow_share <= 8e-1",
    "num_final_rows": "select coalesce(sum(n_ticks), 0) from c_chstat where slow_share <= 8e-1",
}
_LATER = tuple(_COUNTERS)[4:7] + ("num_voyages_after_sampling", "num_resampled_rows", "num_final_voyages", "num_final_rows")


def _counted(names: tuple[str, ...]) -> str:
    return " union all ".join(f"select '{n}' as counter, cast(({_COUNTERS[n]}) as bigint) as value" for n in names)


def _stages(s: SparkSession, d: str) -> DataFrame:
    return N.stacked(N.of_reports(ais.from_events(s, d))).unionByName(N.stacked(N.of_voyages(long_voyages(s, d))))


@query("reduce_stages", _counted(_LATER), f"{GREEDY}, {sampling('cleaned', 'c_')}")
def _(s: SparkSession, d: str) -> DataFrame:
    """The counters of the steps behind the split into voyages, one row for each."""
    return _stages(s, d).filter(F.col("counter").isin(*_LATER))


@query("stage_counters", _counted(tuple(_COUNTERS)), f"{GREEDY}, {sampling('cleaned', 'c_')}")
def _(s: SparkSession, d: str) -> DataFrame:
    """All counters, summed over vessels; two passes over the reports."""
    return _stages(s, d)


# Summaries by day


@query(
    "sketch_union",
    """select d.file_date, count(*) as n_messages, true as vessels_in_bound, true as median_in_bound
    from (select distinct file_date from msg) d join msg m on m.file_date between d.file_date - 2 and d.file_date group by d.file_date""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Three days at a time, from a sketch of each: messages, and whether vessels and the median speed are as near to exact ones as the bounds say."""
    rows = messages(s, d)
    three = K.rolling(K.daily(rows), 3).select("file_date", K.n_values("sogs").alias("n_messages"), K.n_vessels().alias("_n"), K.quantile("sogs", 0.5).alias("_m"))
    # each message counts for three days; the exact figures are only there to be compared with
    exact = rows.select(F.explode(F.sequence("file_date", F.date_add("file_date", 2))).alias("file_date"), "mmsi", "sog").join(three.select("file_date", "_m"), "file_date")
    exact = exact.groupBy("file_date").agg(F.count_distinct("mmsi").alias("_v"), F.avg((F.col("sog") < F.col("_m")).cast("int")).alias("_below"), F.avg((F.col("sog") <= F.col("_m")).cast("int")).alias("_upto"))
    near = F.abs(F.col("_n") - F.col("_v")) <= F.greatest(F.col("_v") * K.COUNT_ERROR, F.lit(1.0))
    return three.join(exact, "file_date").select("file_date", "n_messages", near.alias("vessels_in_bound"), ((F.col("_below") <= 0.5 + K.RANK_ERROR) & (F.col("_upto") >= 0.5 - K.RANK_ERROR)).alias("median_in_bound"))


# Tables in time order


@query(
    "asof_join",
    """select l.mmsi, l.ts_s, l.seq, l.nav_status, r.ts_s as ts_s_right, r.seq as seq_right, r.lat, r.lon
    from (select * from msg where seq % 3 = 0) l asof left join (select * from msg where seq % 3 <> 0 qualify row_number() over (partition by mmsi, ts_s order by seq desc) = 1) r on l.mmsi = r.mmsi and l.ts_s >= r.ts_s""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Every third message with the last position of the others at or before it; of those at one time, the one with the largest number."""
    rows = messages(s, d)
    left = rows.filter("seq % 3 = 0").select("mmsi", "ts_s", "seq", "nav_status")
    return asof_join(left, rows.filter("seq % 3 <> 0").select("mmsi", "ts_s", "seq", "lat", "lon"), "mmsi", order="seq")


@query(
    "asof_join_last_view",
    """select o.event_id, o.user_id, o.s as at_s, p.event_id as view_id, p.value from (select *, cast(floor(epoch(ts)) as bigint) as s from events where event_type = 'purchase') o
    asof join (select *, cast(floor(epoch(ts)) as bigint) as s from events where event_type = 'view' qualify row_number() over (partition by user_id, cast(floor(epoch(ts)) as bigint) order by event_id desc) = 1) p
    on o.user_id = p.user_id and o.s > p.s where o.s - p.s <= 86400""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Each purchase with its user's last view strictly before it and at most a day old."""
    rows = s.read.parquet(f"{d}/events.parquet").withColumn("at_s", F.unix_seconds(F.col("ts").cast("timestamp")))
    buys = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "at_s")
    views = rows.filter("event_type = 'view'").select("user_id", "at_s", F.col("event_id").alias("view_id"), "value")
    return asof_join(buys, views, "user_id", "at_s", "view_id", "inner", strict=True, tolerance=86400, slot=21600).drop("at_s_right")


# Geodesics


@query("geodesic_inverse", "select mmsi, voyage, round(d, 3) as distance from disp")
def _(s: SparkSession, d: str) -> DataFrame:
    return P.displacement(long_voyages(s, d)).select("mmsi", "voyage", F.round("displacement", 3).alias("distance"))


@query("geodesic_direct", f"select seq, {_r('to_lat', 'to_lon', places=8)}, round(d, 3) as distance from back", "goal as (select *, radians(cog) as azimuth, 1234.5e0 + seq % 1000 as gone from msg), " + direct("goal", "there", "lat", "lon", "azimuth", "gone") + ", " + inverse("there", "back", "lat", "lon", "to_lat", "to_lon"))
def _(s: SparkSession, d: str) -> DataFrame:
    """Points reached by the direct formula, and the distance back to the start."""
    rows = messages(s, d).select("seq", "lat", "lon", F.radians(F.col("cog")).alias("az"), (F.lit(1234.5) + F.col("seq") % 1000).alias("gone"))
    there = with_direct(rows, "lat", "lon", "az", "gone", "to_lat", "to_lon")
    back = with_inverse(there, "lat", "lon", "to_lat", "to_lon", "distance")
    return rounded(rounded(back.select("seq", "to_lat", "to_lon", "distance"), 8, "to_lat", "to_lon"), 3, "distance")


# Features and the dataset view

_FEATURES = ("speed_avg", "speed_max", "speed_std", "duration", "lat_max", "lat_min", "lon_max", "lon_min", "lat_mean", "lon_mean", "lat_median", "lon_median", "cog_std")


@query("features", f"select mmsi, voyage, nav_status, hour_start, month, {_r(*_FEATURES)}, {_r('length', 'displacement', places=3)}, round(length_over_displacement, 6) as length_over_displacement from feat join pathl using (mmsi, voyage)")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = P.features(long_voyages(s, d))
    return rounded(rounded(rows, 6, *_FEATURES, "length_over_displacement"), 3, "length", "displacement")


@query("displacement", "select mmsi, voyage, round(d, 3) as displacement from disp")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.displacement(long_voyages(s, d)), 3)


@query("path_length", f"select mmsi, voyage, {_r('length', 'displacement', places=3)}, round(length_over_displacement, 6) as length_over_displacement from pathl")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(P.path_length(long_voyages(s, d)), 3, "length", "displacement"), 6, "length_over_displacement")


@query("sample_index", "select mmsi, k, mmsi || '_' || k || '_processed.pkl' as file_name, cast(row_number() over (order by mmsi || '_' || k || '_processed.pkl') - 1 as bigint) as sample_idx from (select mmsi, cast(voyage as integer) as k from vstat)")
def _(s: SparkSession, d: str) -> DataFrame:
    return P.sample_index(slots.stats(messages(s, d)).select("mmsi", F.col("voyage").cast("int").alias("k")))


#: A feature in millionths, and a row of four as text.
_MILLIONTHS = "cast(floor(cast(cast(least({x}, 0.9999e0) as float) as double) * 1e6 + 5e-1) as bigint)"
_ROW = " || ',' || ".join(_MILLIONTHS.format(x=x) for x in ("(lat - 54) / 5e0", "(lon - 5) / 12e0", "least(sog, 30) / 30e0", "cog / 360e0"))
_ITEMS = f"""items as (select cast(mmsi as integer) as mmsi, voyage, cast(count(*) as integer) as seqlen, cast(arg_min(ts_s, (ts_s, seq)) as integer) as time_start,
  list({_ROW} order by ts_s, seq) as body from longv group by mmsi, voyage),
toks as (select *, list_concat(list_concat(['-1000000,-1000000,-1000000,-1000000'], body[1:{MAX_LEN - 2}]), ['-2000000,-2000000,-2000000,-2000000']) as tokens from items)"""


def _items(s: SparkSession, d: str) -> DataFrame:
    return P.sample_items(V.normalise(long_voyages(s, d)))


def _digest(rows: str) -> Column:
    """The MD5 of an array of rows, in millionths."""
    number = lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("bigint").cast("string")
    return F.md5(F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, number), ",")), ";").cast("binary"))


@query("sample_items", "select mmsi, voyage, seqlen, time_start, md5(array_to_string(body, ';')) as features from items", _ITEMS)
def _(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("mmsi", "voyage", "seqlen", "time_start", _digest("features").alias("features"))


@query("sample_lookup", "select mmsi, voyage, seqlen, time_start from items order by mmsi, voyage limit 1", _ITEMS)
def _(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    first = items.select("mmsi", "voyage", "time_start").orderBy("mmsi", "voyage").first()
    return P.sample_lookup(items, first["mmsi"], first["time_start"]).select("mmsi", "voyage", "seqlen", "time_start")


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return P.token_sequences(_items(s, d), MAX_LEN)


@query("token_seq", "select mmsi, voyage, cast(len(tokens) as integer) as n_tokens, md5(array_to_string(tokens, ';')) as tokens from toks", _ITEMS)
def _(s: SparkSession, d: str) -> DataFrame:
    return _tokens(s, d).select("mmsi", "voyage", F.size("tokens").alias("n_tokens"), _digest("tokens").alias("tokens"))


@query(
    "pad_mask",
    """select mmsi, voyage, cast(longest as integer) as padded, md5(array_to_string(tokens, ';') || repeat(';0,0,0,0', longest - len(tokens))) as input_features, repeat('1', len(tokens)) || repeat('0', longest - len(tokens)) as attention_mask
    from (select *, max(len(tokens)) over (partition by voyage % 3) as longest from toks)""",
    _ITEMS,
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = P.padded(_tokens(s, d).withColumn("batch", F.col("voyage") % 3), "batch")
    return rows.select("mmsi", "voyage", F.size("input_features").alias("padded"), _digest("input_features").alias("input_features"), F.array_join("attention_mask", "").alias("attention_mask"))


_CHOSEN = "i > 0 and i < len(tokens) - 1 and (mmsi::bigint * 7919 + voyage * 104729 + i * 31 + 42) % 100 < 15"


@query(
    "mtm_mask",
    f"""select mmsi, voyage, md5(array_to_string(list_transform(range(0, len(tokens)), lambda i: case when {_CHOSEN} then '0,0,0,0' else tokens[i + 1] end), ';')) as masked,
    md5(array_to_string(list_transform(range(0, len(tokens)), lambda i: case when {_CHOSEN} then tokens[i + 1] else '-100000000,-100000000,-100000000,-100000000' end), ';')) as labels from toks""",
    _ITEMS,
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = P.masked_tokens(_tokens(s, d).withColumn("mmsi", F.col("mmsi").cast("long")))
    return rows.select(F.col("mmsi").cast("int").alias("mmsi"), "voyage", _digest("masked").alias("masked"), _digest("labels").alias("labels"))


_EMBEDDED = f"""emb as (select mmsi, time_start, list_transform(range(1, 5), lambda i: list_sum(list_transform(tokens, lambda t: cast(string_split(t, ',')[i] as double) / 1e6)) / len(tokens)) as v from toks)"""


@query("encoder_embeddings", "select mmsi, time_start, " + ", ".join(f"round(v[{i + 1}] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 3) as e{i}" for i in range(4)) + " from emb", f"{_ITEMS}, {_EMBEDDED}")
def _(s: SparkSession, d: str) -> DataFrame:
    """Batch inference through the encoder interface, with the plainest encoder."""
    rows = X.embeddings(_tokens(s, d), X.mean_step)
    return rounded(rows.select("mmsi", "time_start", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)]), 3)


@query("encoder_transformer")
def _(s: SparkSession, d: str) -> DataFrame:
    """Batch inference by a small untrained transformer: published weights would be read from a file."""
    return X.embeddings(_tokens(s, d), X.Transformer.random(X.Config(hidden_size=32, layers=2, heads=4, intermediate_size=64)))


@query("subset", f"select {', '.join(MESSAGE)} from msg semi join (select mmsi from (select distinct mmsi from msg) order by md5(mmsi || ':42'), mmsi limit 50) using (mmsi)")
def _(s: SparkSession, d: str) -> DataFrame:
    """The reports of 50 vessels in hash order: a sampling operator."""
    rows = messages(s, d)
    chosen = first_by_hash(rows.select("mmsi").distinct(), 50, "mmsi", seed=42).select("mmsi")
    return rows.join(F.broadcast(chosen), "mmsi", "left_semi").select(*MESSAGE)  # at most 50 rows


_SPLIT = """run as (select mmsi, n, sum(n) over (order by o, mmsi) - n as before, total, cast(floor(total * 1e-1) as bigint) as part
  from (select mmsi, count(*) as n, min(md5(mmsi || ':' || voyage || ':42')) as o from vstat group by mmsi), (select count(*) as total from vstat))"""


@query("split", "select mmsi, n, case when before < total - 2 * part then 'train' when before - (select min(before) from run where before >= total - 2 * part) < part then 'val' else 'test' end as split from run", _SPLIT)
def _(s: SparkSession, d: str) -> DataFrame:
    return P.split_vessels(slots.stats(messages(s, d)).select("mmsi", F.col("voyage").cast("int").alias("k")))


# Evaluation


def labelled(s: SparkSession, d: str) -> DataFrame:
    """Features of the long voyages under a fixed labelling, with vessel types and classes."""
    rows = P.speed_and_status(long_voyages(s, d))
    label = F.when((F.col("mmsi") + F.col("voyage")) % 9 == 0, -1).otherwise((F.col("mmsi") % 5).cast("int"))
    return E.with_types(rows.withColumn("label", label), I.vessel_type_combined(I.vessel_type_daily(messages(s, d))))


@query("type_lookup", "select mmsi, voyage, vessel_type from lab")
def _(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).select("mmsi", "voyage", "vessel_type")


@query("vessel_class", "select mmsi, voyage, vessel_class from labc")
def _(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).select("mmsi", "voyage", "vessel_class")


@query("labelled_features", f"select mmsi, voyage, label, vessel_type, {_r('speed_avg', 'lat_mean', 'lon_mean', 'cog_std')} from lab")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(labelled(s, d).select("mmsi", "voyage", "label", "vessel_type", "speed_avg", "lat_mean", "lon_mean", "cog_std"))


@query("noise_anti", "select mmsi, voyage from lab where label <> -1")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d).select("mmsi", "voyage", "label")
    return rows.join(rows.filter("label = -1"), ["mmsi", "voyage"], "left_anti").select("mmsi", "voyage")


@query("relabel", "select mmsi, voyage, cast(dense_rank() over (order by label) - 1 as integer) as label from lab where label in (1, 3, 4)")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d).filter(F.col("label").isin(1, 3, 4)).select("mmsi", "voyage", F.col("label").alias("old"))
    # a row for each cluster
    names = rows.select("old").distinct().withColumn("label", (F.dense_rank().over(V.Window.orderBy("old")) - 1).cast("int"))
    return rows.join(F.broadcast(names), "old").select("mmsi", "voyage", "label")


@query("zscore_profile", "select label, " + ", ".join(f"round(max(z) filter (feature = '{f}'), 6) as {f}" for f in E.PROFILE) + " from prof group by label")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.profile(labelled(s, d)))


@query("feature_importance", "select feature, round(stddev_samp(z), 6) as importance from prof group by feature order by importance desc, feature")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.importance(labelled(s, d)))


_LABC2 = """lab2 as (select labc.*, displacement, length_over_displacement, cast(mmsi % 3 as integer) as other from labc join pathl using (mmsi, voyage)),
scored as (unpivot lab2 on speed_avg, speed_std, speed_max, duration, displacement, length_over_displacement, cog_std, lat_mean, lon_mean into name feature value v),
facts as (select feature, avg(v) as m, stddev_samp(v) as s from scored group by feature),
spread as (
  select feature, stddev_samp(z) as x from (select label, feature, avg((v - m) / s) as z from scored join facts using (feature) where label <> -1 group by label, feature) group by feature
  union all
  select feature, stddev_samp(z) as x from (select other, feature, avg((v - m) / s) as z from scored join facts using (feature) group by other, feature) group by feature)"""


@query("feature_importance_max", "select cast(row_number() over (order by max(x) desc, feature) as integer) as rank, feature, round(max(x), 6) as importance from spread group by feature", _LABC2)
def _(s: SparkSession, d: str) -> DataFrame:
    """Over two clusterings, sorted; the rank makes the order visible."""
    label = F.when((F.col("mmsi") + F.col("voyage")) % 9 == 0, -1).otherwise((F.col("mmsi") % 5).cast("int"))
    rows = P.features(long_voyages(s, d)).withColumns({"label": label, "other": (F.col("mmsi") % 3).cast("int")})
    return rounded(E.greatest_importance(rows, ("label", "other"), E.COMPARED))


@query(
    "lollipop_frame",
    "select label, cast(row_number() over (partition by label order by z, feature) as integer) as rank, feature, round(z, 6) as score, z >= 0 as positive from prof",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(G.lollipop(E.profile(labelled(s, d)), E.PROFILE))


@query(
    "trajectory_frame",
    """select mmsi, voyage as k, cast(idx as integer) as place, round(lat, 7) as lat, round(lon, 7) as lon, cast(mmsi % 5 as integer) as label, idx = 0 as is_start,
    row_number() over (partition by mmsi, voyage order by idx desc) = 1 as is_end, round(1 / cos(radians(avg(lat) over ())), 9) as aspect from idx""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    steps = V.normalise(V.indexed(long_voyages(s, d))).withColumnsRenamed({"voyage": "k", "idx": "step"}).withColumn("label", (F.col("mmsi") % 5).cast("int"))
    return rounded(rounded(G.trajectories(steps), 7, "lat", "lon"), 9, "aspect")


_SHARES = """sh as (
  select label, classes.vessel_class, avg(case when labc.vessel_class = classes.vessel_class then 1e0 else 0e0 end) as share from labc, classes where label <> -1 group by all),
ov as (select classes.vessel_class, avg(case when labc.vessel_class = classes.vessel_class then 1e0 else 0e0 end) as overall from labc, classes where label <> -1 group by all)"""


@query("share_diff", "select label, vessel_class, round(share - overall, 6) as difference from sh join ov using (vessel_class)", _SHARES)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.share_difference(labelled(s, d)))


@query("pmi_cluster", "select label, vessel_class, round(log2(case when share > 0 then share else 1e-6 end / case when overall > 0 then overall else 1e-6 end), 6) as pmi from sh join ov using (vessel_class)", _SHARES)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.pointwise_information(labelled(s, d)))


@query("noise_pct", "select round(100e0 * count(*) filter (label = -1) / count(*), 6) as noise_pct from lab")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.noise_percent(labelled(s, d)))


@query(
    "noise_zscore",
    """select feature, round((avg(v) filter (label = -1) - avg(v) filter (label <> -1)) / stddev_samp(v) filter (label <> -1), 6) as z
    from (unpivot labc on speed_avg, speed_std, speed_max, duration, lat_mean, lon_mean, cog_std into name feature value v) group by feature""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.noise_scores(labelled(s, d)))


@query(
    "noise_pmi",
    """select vessel_class, round(log2(case when n > 0 then n else 1e-6 end / case when k > 0 then k else 1e-6 end), 6) as pmi from (
    select classes.vessel_class, avg(case when labc.vessel_class = classes.vessel_class then 1e0 else 0e0 end) filter (label = -1) as n,
      avg(case when labc.vessel_class = classes.vessel_class then 1e0 else 0e0 end) filter (label <> -1) as k from labc, classes group by all)""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.noise_information(labelled(s, d)))


def _losses(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).select("label", F.col("speed_std").alias("loss"), (F.col("mmsi") % 32 + 1).alias("n"))


@query("group_loss", "select label, round(sum(speed_std * (mmsi % 32 + 1)) / sum(mmsi % 32 + 1), 6) as loss from lab group by label")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.group_loss(_losses(s, d), "label"))


@query(
    "rcr",
    """select round((sum(speed_std * (mmsi % 32 + 1)) filter (label = -1) / sum(mmsi % 32 + 1) filter (label = -1))
    / (sum(speed_std * (mmsi % 32 + 1)) filter (label <> -1) / sum(mmsi % 32 + 1) filter (label <> -1) + 1e-9), 6) as rcr from lab""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.reconstruction_ratio(_losses(s, d)))


@query("masked_mse", "select round(avg((pow((lat - 54) / 5e0 - 5e-1, 2) + pow((lon - 5) / 12e0 - 5e-1, 2)) / 2), 6) as mse from longv where seq % 7 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = V.normalise(long_voyages(s, d))
    hidden = F.col("seq") % 7 == 0
    label = lambda c: F.when(hidden, F.col(c)).otherwise(F.lit(-100.0))
    return rounded(E.masked_mse(rows.select(F.array(F.lit(0.5), F.lit(0.5)).alias("prediction"), F.array(label("lat"), label("lon")).alias("labels"))))


# Vectors and clusters


@query("embeddings_scan", "select vec_id, label, cast(len(embedding) as integer) as size, round(cast(embedding[1] as double), 6) as first_value from embeddings")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(vectors(s, d).select("vec_id", "label", F.size("embedding").alias("size"), F.get("embedding", F.lit(0)).cast("double").alias("first_value")))


@query("l2_normalize", "select vec_id, round(sqrt(sum(pow(cast(v as double), 2))), 6) as length, 1e0 as new_length from vec group by vec_id")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = vectors(s, d).withColumn("length", norm("embedding")).withColumn("u", normalised("embedding", "length"))
    return rows.select("vec_id", F.round("length", 6).alias("length"), F.round(norm("u"), 6).alias("new_length"))


@query("centroids", "select label, cast(pos as integer) as pos, round(mean, 6) as mean, n from cen")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.parts(vectors(s, d)))


@query("radii", "select label, round(radius, 6) as radius from rad")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.radii(vectors(s, d)))


@query("davies_bouldin", "select round(avg(w), 6) as davies_bouldin from (select i, max((x.radius + y.radius) / d) as w from cgap join rad x on x.label = i join rad y on y.label = j group by i)")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.davies_bouldin(vectors(s, d)))


_WARD = "select i, j, round(d * d * ni * nj / (ni + nj), 6) as ward from cgap where i < j"


@query("linkage_ward", _WARD)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.ward(vectors(s, d)))


@query("closest_pair", f"select i, j, ward from ({_WARD}) order by ward, i, j limit 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.ward(vectors(s, d))).orderBy("ward", "i", "j").limit(1)


_PAIRS = """paird as (select x.label as i, y.label as j, sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: pow(z[1]::double - z[2]::double, 2)))) as d
  from embeddings x join embeddings y on x.label < y.label)"""


@query("linkage_single", "select i, j, round(min(d), 6) as single from paird group by all", _PAIRS)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.pair_singles(vectors(s, d)))


@query("linkage_average", "select i, j, round(avg(d), 6) as average from paird group by all", _PAIRS)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.pair_linkages(vectors(s, d)).select("i", "j", "average"))


@query("exemplars", "select label, rank, vec_id from (select label, vec_id, cast(row_number() over (partition by label order by dist, vec_id) as integer) as rank from vdist) where rank <= 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return E.exemplars(vectors(s, d)).select("label", "rank", "vec_id")


@query("first_rep", "select label, arg_max(vec_id, (dist, -vec_id)) as vec_id, round(max(dist), 6) as dist from vdist group by label")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = C.with_centroid_distance(vectors(s, d))
    return rounded(rows.groupBy("label").agg(F.max_by("vec_id", F.struct("dist", -F.col("vec_id"))).alias("vec_id"), F.max("dist").alias("dist")))


_FIRST = "fr as (select label, arg_max(vec_id, (dist, -vec_id)) as vec_id from vdist group by label)"
_TO_FIRST = _FIRST + """, tofirst as (select x.label, x.vec_id, sqrt(sum(pow(x.v::double - y.v::double, 2))) as d from vec x join fr on fr.label = x.label join vec y on y.vec_id = fr.vec_id and y.pos = x.pos group by all)"""


def _first_reps(rows: DataFrame) -> DataFrame:
    from driftline.functions.vectors import distance

    far = C.with_centroid_distance(rows)
    first = far.groupBy("label").agg(F.max_by("embedding", F.struct("dist", -F.col("vec_id"))).alias("rep"))
    return far.join(first, "label").withColumn("d", distance("embedding", "rep"))  # a row for each cluster


@query("farthest_first", "select label, arg_max(vec_id, (d, -vec_id)) as vec_id, round(max(d), 6) as dist from tofirst group by label", _TO_FIRST)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _first_reps(vectors(s, d))
    return rounded(rows.groupBy("label").agg(F.max_by("vec_id", F.struct("d", -F.col("vec_id"))).alias("vec_id"), F.max("d").alias("dist")))


_SHRUNK = """shrunk as (select vec.label, vec_id, vec.pos, v::double + 2e-1 * (mean - v::double) as x from vec join cen on cen.label = vec.label and cen.pos = vec.pos
  where (vec.label, vec_id) in (select label, vec_id from (select label, vec_id, row_number() over (partition by label order by dist desc, vec_id) as r from vdist) where r <= 3))"""


def _reps(rows: DataFrame) -> DataFrame:
    """The three members farthest from each centroid, drawn a fifth of the way towards it."""
    w = V.Window.partitionBy("label").orderBy(F.desc("dist"), "vec_id")
    far = C.with_centroid_distance(rows).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return far.select("label", "vec_id", F.zip_with("embedding", "centroid", lambda x, c: x.cast("double") + 0.2 * (c - x.cast("double"))).alias("x"))


@query("shrink_reps", "select label, vec_id, cast(pos as integer) as pos, round(x, 6) as x from shrunk", _SHRUNK)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(_reps(vectors(s, d)).select("label", "vec_id", F.posexplode("x").alias("pos", "x")))


_NEAREST = _SHRUNK + """, near as (select vec.vec_id, shrunk.label as c, shrunk.vec_id as r, sqrt(sum(pow(v::double - x, 2))) as d from vec join shrunk on shrunk.pos = vec.pos group by all),
best as (select vec_id, arg_min(c, (d, c)) as c, min(d) as d from near group by vec_id)"""


def _assigned(s: SparkSession, d: str, threshold: float | None) -> DataFrame:
    rows = vectors(s, d)
    reps = [(r["label"], np.array(r["x"])) for r in _reps(rows).orderBy("label", "vec_id").collect()]  # three a cluster
    return C.assign(rows, reps, threshold)


@query("cure_assign", "select vec_id, case when d > 1.1e0 then -1 else c end as label, round(d, 6) as dist from best", _NEAREST)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(_assigned(s, d, 1.1))


@query(
    "noise_grid",
    """select 10 as n_clusters, threshold, round(100e0 * count(*) filter (d > threshold) / count(*), 6) as noise_pct
    from best, (select unnest([0.9e0, 1.0e0, 1.1e0, 1.2e0]) as threshold) group by threshold""",
    _NEAREST,
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _assigned(s, d, None).select(F.lit(10).alias("n_clusters"), "dist")
    return rounded(E.noise_grid(rows, [0.9, 1.0, 1.1, 1.2]), 6, "noise_pct")


@query("nearest_by_cells", "select vec_id, case when d > 1.1e0 then -1 else c end as label, round(d, 6) as dist from best", _NEAREST)
def _(s: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest representative, searched by cells, the representatives being a table of any size."""
    rows = vectors(s, d)
    reps = _reps(rows).select(F.col("vec_id").alias("rep_id"), "label", F.col("x").alias("embedding"))
    return rounded(cells.nearest(rows, reps, 1.1).drop("measured"))


_TREE_CUT = 1.0


@query(
    "single_linkage",
    "select vec_id, least(vec_id, coalesce(low, vec_id)) as label from embeddings left join (select a as vec_id, min(b) as low from reached group by a) using (vec_id)",
    f"""close as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.vec_id <> y.vec_id
      where sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: pow(z[1]::double - z[2]::double, 2)))) <= {_TREE_CUT}e0),
    reached(a, b) as (select a, b from close union select reached.a, close.b from reached join close on reached.b = close.a) /* union all */""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Single linkage of all vectors up to a distance, from the minimum spanning tree."""
    rows = vectors(s, d)
    return spanning.cut_at(spanning.spanning_tree(rows, up_to=_TREE_CUT), rows, _TREE_CUT)


def _cure(s: SparkSession, d: str) -> C.Cure:
    return C.Cure(sample_size=150, linkage="ward", n_representatives=20, compression=0.6, pruning_fraction=0.2, pruning_min_size=1).fit(vectors(s, d))


@query("cure_sample", "select vec_id, nth from smp", MERGES)
def _(s: SparkSession, d: str) -> DataFrame:
    return C.Cure(sample_size=150).sampled(vectors(s, d)).select("vec_id", "nth")


@query("cure_predict", "select vec_id, case when d > 1.2e0 then -1 else label end as label, round(d, 6) as dist from near", assigned((5,)))
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(_cure(s, d).predict(vectors(s, d), 5, 1.2))


_KS = tuple(range(2, 13, 2))
_THRESHOLDS = [0.2, 0.22, 0.24, 0.26, 0.28, 0.3]


@query(
    "noise_grid_whole",
    f"""select cast(k as integer) as n_clusters, threshold, round(100e0 * count(*) filter (d > threshold) / count(*), 6) as noise_pct
    from near, (select unnest({[f"{t}e0" for t in _THRESHOLDS]}) as threshold) group by k, threshold""".replace("'", ""),
    assigned(_KS),
)
def _(s: SparkSession, d: str) -> DataFrame:
    """The noise for 2, 4, .., 12 clusters of the fitted model and all thresholds."""
    model = _cure(s, d)
    near = C.assign_each(vectors(s, d), {k: model.representatives(k) for k in _KS}, None).select("n_clusters", "dist")
    return rounded(E.noise_grid(near, _THRESHOLDS), 6, "noise_pct")


@query("ahc_merges", "select cast(step as integer) as step, cast(c1 as integer) as c1, cast(c2 as integer) as c2, round(dist, 6) as dist, cast(size as integer) as size from merges", MERGES)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(_cure(s, d).model.linkage_frame(s))


@query("ahc_labels", "select smp.nth, coalesce(label, -1) as label from smp left join grp using (nth)", labels((5,)))
def _(s: SparkSession, d: str) -> DataFrame:
    found = _cure(s, d).model.labels(5)
    return s.createDataFrame([(i, int(x)) for i, x in enumerate(found)], "nth int, label int")


@query("dendrogram", "select cast(step - greatest(last - 29, 0) as integer) as step, cast(c1 as integer) as c1, cast(c2 as integer) as c2, round(dist, 6) as dist, cast(size as integer) as size from renamed where step > last - 30", DENDROGRAM)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(_cure(s, d).model.dendrogram_frame(s, 30))


@query("cure_labels", "select vec_id, label from near", assigned((5,)))
def _(s: SparkSession, d: str) -> DataFrame:
    """The labels of the rows that the model was fitted on."""
    return _cure(s, d).labels(5)


@query(
    "cure_evaluate",
    "select cast(k as integer) as n_clusters, round(w, 6) as davies_bouldin, round(noise, 6) as noise_pct from index_of join (select k, 100e0 * count(*) filter (label = -1) / count(*) as noise from lab3 group by k) using (k)",
    evaluated((2, 5, 10, 20), 1.2),
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Davies-Bouldin index and noise for 2, 5, 10 and 20 clusters."""
    model = _cure(s, d)
    model.threshold = 1.2
    return rounded(model.evaluate(vectors(s, d)))


@query("scatter_frame")
def _(s: SparkSession, d: str) -> DataFrame:
    """Two principal components: linear, whereas the usual plot bends the space."""
    return rounded(G.scatter(vectors(s, d)))


@query(
    "neighbour_recall",
    """select id as vec_id, count(*) as n_exact, round(max(dist), 6) as far, true as recall_reached from (
      select x.vec_id as id, sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: pow(z[1]::double - z[2]::double, 2)))) as dist,
        row_number() over (partition by x.vec_id order by dist, y.vec_id) as place
      from embeddings x join embeddings y on x.vec_id <> y.vec_id where x.vec_id % 20 = 0) where place <= 15 group by id""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """The graph of all vectors' 15 nearest, measured by the vectors whose id is divisible by 20: the furthest exact neighbour, and whether nine tenths of all are found."""
    rows = vectors(s, d)
    found = neighbours.recall(neighbours.graph(rows), neighbours.exact(rows.filter("vec_id % 20 = 0"), rows))
    share = found.agg((F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recall_reached"))  # one row
    return rounded(found.select(F.col("id").alias("vec_id"), "n_exact", "far").crossJoin(F.broadcast(share)))


@query("layout_frame")
def _(s: SparkSession, d: str) -> DataFrame:
    """The plane in which neighbours stay neighbours, with the labels of the points."""
    rows = vectors(s, d)
    return rounded(layout.layout(rows).join(rows.select("vec_id", "label"), "vec_id").select("vec_id", "label", "x", "y"))
