"""Parsing, cleaning, time grid and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.names import clean_cooler_key, clean_probe_label, height_u
from gridcast.functions.scalars import mask_zero, to_number
from gridcast.operators import align, clean, grid
from gridcast.sources.dict_lines import bad_lines, parse_lines, sensor_rows
from registry import views as v
from registry.views import r6, secs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# The sensor label of a user, and the cooler key of an event, in both engines.
PROBE_SQL = """CASE WHEN user_id = 0 THEN 'Temperature (1)' ELSE
  'Temperature (Cabin ' || (1 + (user_id // 12) % 3) || ' - Back - ' || (20 + 2 * (user_id % 12)) || 'U)' END"""
# Fixed test labels: raw cooler keys by event type.
COOLER_KEYS = {
    "click": "airIRG2GroupStatusAirFlowMetric[L/s]",
    "view": "airIRG2GroupStatusAirFlowUS[CFM]",
    "error": "airIRG2RDT2StatusSupplyAirTempMetric[C]",
    "purchase": "airIRG2RDT2StatusCoolDemand[kW/h]",
    "signup": "Door / Open state [bool]",
}
COOLER_NAMES = {
    "click": "airflow_lps",
    "view": "airflow_cfm",
    "error": "supply_air_c",
    "purchase": "cool_demand_kwh",
    "signup": "door__per__open_state",
}


def probe_label():
    u = F.col("user_id")
    cabin = (1 + F.expr("user_id div 12") % 3).cast("string")
    height = (20 + 2 * (u % 12)).cast("string")
    placed = F.concat(
        F.lit("Temperature (Cabin "), cabin, F.lit(" - Back - "), height, F.lit("U)")
    )
    return F.when(u == 0, "Temperature (1)").otherwise(placed)


def cooler_key():
    pairs = [x for k, name in COOLER_KEYS.items() for x in (F.lit(k), F.lit(name))]
    return F.create_map(*pairs)[F.col("event_type")]


# Literals of the second channel of a log line, by event_id % 8: as written, and the text they stand for.
NOTES = (
    ("'offset: +5, x'", "offset: +5, x"), ("'a, ]'", "a, ]"), ("'ratio: None, x'", "ratio: None, x"), ("None", None),
    ("+2.5", "2.5"), ("1_000", "1000"), ("0x1f", "31"), (r"'it\'s 1_0: .5,}'", "it's 1_0: .5,}"),
)
NOTE_VALUES = {4: 2.5, 5: 1000.0, 6: 31.0}


def probe_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines: the label twice (the last value wins) around a note in one of the spellings of ``NOTES``."""
    quote = F.lit("'")
    label = F.concat(quote, probe_label(), quote)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.concat(
        F.lit("{'"), stamp, F.lit("': [{"), label, F.lit(": -1.5}, {'Note': "),
        F.get(F.array(*[F.lit(written) for written, _ in NOTES]), F.col("event_id") % len(NOTES)), F.lit("}, {"), label, F.lit(": '"), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("'}]}"),
    )
    blank = F.when(F.col("event_id") % 11 == 0, "  ").when(F.col("event_id") % 13 == 0, "{broken: +1, 'a, ]'")
    return v.events(spark, sf).select("event_id", F.coalesce(blank, line).alias("line"))


def bad_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events with zero, missing and non-numeric readings and dead channels."""
    e = F.col("event_id")
    raw = (
        F.when(e % 17 == 0, "0.0").when(e % 19 == 0, "n/a").when(e % 23 == 0, F.lit(None))
        .otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    )
    dead = F.when(F.col("user_id") % 7 == 3, "0").otherwise(raw)
    name = F.when(F.col("user_id") % 7 == 5, F.concat(F.lit("unused_"), F.col("user_id"))).otherwise(
        F.concat(F.lit("probe_"), F.col("user_id"))
    )
    return v.events(spark, sf).select("event_id", "ts", "user_id", name.alias("channel"), dead.alias("raw"))


BAD_SQL = """bad AS (SELECT event_id, ts, user_id,
  CASE WHEN user_id % 7 = 5 THEN 'unused_' || user_id ELSE 'probe_' || user_id END AS channel,
  CASE WHEN user_id % 7 = 3 THEN '0' WHEN event_id % 17 = 0 THEN '0.0' WHEN event_id % 19 = 0 THEN 'n/a'
    WHEN event_id % 23 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS raw FROM events)"""


def _sql_text(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


NOTE_SQL = " ".join(f"WHEN {i} THEN {_sql_text(text)}" for i, (_, text) in enumerate(NOTES))
NOTE_VALUE_SQL = " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in NOTE_VALUES.items())


@query(f"""SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t, channel, value, text FROM (
  SELECT event_id, ts, 'note' AS channel, CASE event_id % {len(NOTES)} {NOTE_VALUE_SQL} END AS value,
    CASE event_id % {len(NOTES)} {NOTE_SQL} END AS text FROM events
  UNION ALL SELECT event_id, ts, CASE WHEN user_id = 0 THEN 'temp_unused_channel' ELSE
    'temp_cabin' || (1 + (user_id // 12) % 3) || '_back_' || (20 + 2 * (user_id % 12)) || 'u_c' END,
    CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE), CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) FROM events)
  WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""")
def parse_dict_lines(spark, sf):
    rows = sensor_rows(parse_lines(probe_lines(spark, sf)), clean_probe_label, text="text")
    return rows.select("event_id", secs().alias("t"), "channel", "value", "text")


@query("SELECT event_id, '{broken: +1, ''a, ]''' AS line FROM events WHERE event_id % 11 <> 0 AND event_id % 13 = 0")
def quarantine_lines(spark, sf):
    return bad_lines(parse_lines(probe_lines(spark, sf)))


@query("SELECT channel, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM (SELECT value, CASE event_type "
       + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in COOLER_NAMES.items())
       + " END AS channel FROM events) GROUP BY channel")
def clean_cooler_keys(spark, sf):
    named = v.events(spark, sf).select(clean_cooler_key(cooler_key()).alias("channel"), "value")
    return named.groupBy("channel").agg(
        F.count("*").alias("n"), (F.round(F.sum("value"), 2) + 0.0).alias("total")
    )


@query("""SELECT event_id, CASE WHEN user_id = 0 THEN 'temp_unused_channel' ELSE
    'temp_cabin' || (1 + (user_id // 12) % 3) || '_back_' || (20 + 2 * (user_id % 12)) || 'u_c' END AS channel,
    CASE WHEN user_id > 0 THEN 20 + 2 * (user_id % 12) END::INT AS u FROM events""")
def clean_probe_labels(spark, sf):
    named = v.events(spark, sf).select("event_id", clean_probe_label(probe_label()).alias("channel"))
    return named.withColumn("u", height_u(F.col("channel")))


WIDE = ["click", "view", "error", "purchase", "signup"]


@query("SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS t, "
       + ", ".join(f"max(value) FILTER (event_type = '{c}') AS {c}" for c in WIDE)
       + " FROM events GROUP BY ALL")
def pivot_channels(spark, sf):
    hourly = v.events(spark, sf).withColumn("t", secs(F.date_trunc("hour", "ts")))
    return clean.to_wide(hourly, ["user_id", "t"], WIDE, "event_type")


@query(f"WITH {BAD_SQL}, num AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS value FROM bad) "
       "SELECT event_id, channel, value FROM num WHERE channel IN (SELECT channel FROM num GROUP BY channel "
       "HAVING sum(abs(coalesce(value, 0))) > 0 AND channel NOT LIKE '%unused%')")
def drop_dead_channels(spark, sf):
    rows = bad_readings(spark, sf).withColumn("value", to_number(F.col("raw")))
    return clean.drop_dead_channels(rows.select("event_id", "channel", "value"))


@query(f"WITH {BAD_SQL} SELECT event_id, nullif(TRY_CAST(raw AS DOUBLE), 0.0) AS value FROM bad")
def mask_zero_readings(spark, sf):
    rows = bad_readings(spark, sf)
    return rows.select("event_id", mask_zero(to_number(F.col("raw"))).alias("value"))


@query("""SELECT event_id, event_type AS channel FROM events e WHERE event_type <> 'view'
  OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'click')""")
def drop_duplicate_unit(spark, sf):
    rows = v.events(spark, sf).select("event_id", "user_id", F.col("event_type").alias("channel"))
    return clean.drop_duplicate_unit(rows, "view", "click", keys=["user_id"]).select("event_id", "channel")


@query(f"WITH {v.RACKS_SQL} SELECT rack, CAST(t AS BIGINT) AS t FROM racks_raw WHERE t_low IS NOT NULL OR t_high IS NOT NULL")
def drop_empty_rows(spark, sf):
    raw = grid.resample_mean(v.shipments(spark, sf), v.RACKS_RAW, v.TARGETS)
    return grid.drop_empty_rows(raw, v.TARGETS).select("rack", secs().alias("t"))


@query(f"WITH {v.FLEET_SQL} SELECT user_id, CAST(t AS BIGINT) AS t, {v.rs('value')} AS value FROM fleet")
def resample_mean(spark, sf):
    return v.fleet(spark, sf).select("user_id", secs().alias("t"), r6("value").alias("value"))


@query(f"WITH {v.FLEET_SQL}, {v.ffill_sql('filled', 'fleet', 'user_id', ['value'], 2)} "
       f"SELECT user_id, CAST(t AS BIGINT) AS t, {v.rs('value')} AS value FROM filled")
def ffill_limit(spark, sf):
    out = grid.ffill(v.fleet(spark, sf), v.FLEET, ["value"], 2)
    return out.select("user_id", secs().alias("t"), r6("value").alias("value"))


def interp_sql(name: str, source: str, key: str, limit: int) -> str:
    part = f"PARTITION BY {key} ORDER BY b"
    return f"""{name}_n AS (SELECT {key}, b, t, value,
  last_value(CASE WHEN value IS NOT NULL THEN b END IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pb,
  last_value(value IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN b END IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb,
  first_value(value IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM {source}),
{name} AS (SELECT {key}, b, t, CASE WHEN value IS NOT NULL THEN value WHEN pb IS NULL OR b - pb > {limit} THEN NULL
  WHEN nb IS NULL THEN pv ELSE pv + (nv - pv) * ((b - pb)::DOUBLE / (nb - pb)) END AS value FROM {name}_n)"""


@query(f"WITH {v.FLEET_SQL}, {interp_sql('filled', 'fleet', 'user_id', 3)} "
       f"SELECT user_id, CAST(t AS BIGINT) AS t, {v.rs('value')} AS value FROM filled")
def interpolate_limit(spark, sf):
    out = grid.interpolate(v.fleet(spark, sf), v.FLEET, ["value"], 3)
    return out.select("user_id", secs().alias("t"), r6("value").alias("value"))


def _kept(df):
    return df.select("user_id", secs().alias("t"), r6("value").alias("value"))


KEPT_SQL = f"SELECT user_id, CAST(t AS BIGINT) AS t, {v.rs('value')} AS value FROM {{}} WHERE value IS NOT NULL"


@query(f"WITH {v.FLEET_SQL}, {v.ffill_sql('f', 'fleet', 'user_id', ['value'], 6)} " + KEPT_SQL.format("f"))
def resample_clean_strict(spark, sf):
    return _kept(grid.resample_and_clean(v.events(spark, sf), v.EVENTS, ["value"], strict=True))


@query(f"WITH {v.FLEET_SQL}, {v.ffill_sql('f', 'fleet', 'user_id', ['value'], 6)}, {interp_sql('g', 'f', 'user_id', 6)} "
       + KEPT_SQL.format("g"))
def resample_clean_interp(spark, sf):
    return _kept(grid.resample_and_clean(v.events(spark, sf), v.EVENTS, ["value"]))


@query(f"WITH {v.FLEET_SQL}, {interp_sql('g', 'fleet', 'user_id', 3)} " + KEPT_SQL.format("g"))
def resample_interp(spark, sf):
    return _kept(grid.resample_with_interpolation(v.events(spark, sf), v.EVENTS, ["value"]))


@query(f"WITH {v.FLEET_SQL} " + KEPT_SQL.format("fleet"))
def resample_interp_strict(spark, sf):
    return _kept(grid.resample_with_interpolation(v.events(spark, sf), v.EVENTS, ["value"], strict=True))


@query("""WITH d AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY l_suppkey ORDER BY ts) AS us
    FROM (SELECT l_suppkey, l_shipdate AS ts FROM lineitem)),
  off AS (SELECT us / 1e6 AS interval_s, count(*) AS n FROM d WHERE us IS NOT NULL AND abs(us / 1e6 - 86400) > 3600 GROUP BY 1)
  SELECT interval_s, n, (SELECT sum(n) FROM off)::BIGINT AS n_off FROM off ORDER BY n DESC, interval_s LIMIT 5""")
def cadence_report(spark, sf):
    spec = v.RACKS_RAW.replace(bucket_s=90 * v.DAY)
    return grid.cadence_report(v.shipments(spark, sf), spec, expected_s=86400, tolerance_s=3600)


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn = floor(n * 0.5)""")
def row_at_position(spark, sf):
    out = grid.row_at_position(v.events(spark, sf), v.EVENTS, 0.5, tie=["event_id"])
    return out.select("user_id", "event_id", "value")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn
  FROM events) WHERE rn <= 10""")
def first_n_rows(spark, sf):
    return grid.first_rows(v.events(spark, sf), v.EVENTS, 10).select("user_id", "event_id")


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS t, value FROM events""")
def as_timestamp(spark, sf):
    text = F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    raw = v.events(spark, sf).select("event_id", "value", text.alias("DateTime"))
    return grid.as_timestamp(raw).select("event_id", secs().alias("t"), "value")


@query("""SELECT channel, count(*) AS n FROM (SELECT CASE event_type """
       + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in COOLER_NAMES.items())
       + """ END AS channel FROM events) WHERE channel IN ('airflow_lps', 'cool_demand_kwh', 'supply_air_c') GROUP BY channel""")
def select_channels(spark, sf):
    named = v.events(spark, sf).select(clean_cooler_key(cooler_key()).alias("channel"))
    return named.where(clean.is_feature_channel(F.col("channel"))).groupBy("channel").agg(F.count("*").alias("n"))


@query("""SELECT channel, count(*) AS n FROM (SELECT 'temp_cabin' || (1 + (user_id // 12) % 3) || '_back_' ||
  (20 + 2 * (user_id % 12)) || 'u_c' AS channel FROM events WHERE user_id <> 0) GROUP BY channel""")
def select_targets(spark, sf):
    named = v.events(spark, sf).select(clean_probe_label(probe_label()).alias("channel"))
    return named.where(clean.is_target_channel(F.col("channel"))).groupBy("channel").agg(F.count("*").alias("n"))


@query(f"""WITH {v.TYPES_SQL}, a AS (SELECT t, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view,
    max(value) FILTER (event_type = 'error') AS error FROM types_grid WHERE event_type IN ('click', 'view', 'error') GROUP BY t),
  p AS (SELECT t, max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'signup') AS signup
    FROM types_grid WHERE event_type IN ('purchase', 'signup') GROUP BY t)
  SELECT CAST(a.t AS BIGINT) AS t, {v.r6_list(WIDE)}
  FROM a JOIN p ON a.t = p.t""")
def join_feeds(spark, sf):
    rows = v.types_grid(spark, sf)
    feeds = WIDE[:3], WIDE[3:]
    a, b = (clean.to_wide(rows.where(F.col("event_type").isin(*names)), ["ts"], names, "event_type") for names in feeds)
    out = align.join_feeds(a, b)
    return out.select(secs().alias("t"), *[r6(c).alias(c) for c in WIDE])


@query("""SELECT l_returnflag, round(sum(l_extendedprice), 2) + 0.0 AS total FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_returnflag""")
def scan_pruned(spark, sf):
    df = v.table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01 00:00:00'")
    return df.groupBy("l_returnflag").agg((F.round(F.sum("l_extendedprice"), 2) + 0.0).alias("total"))


@query("""WITH ev AS (SELECT l_suppkey AS k, l_shipdate AS ts, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
  rq AS (SELECT o_orderkey AS req, o_custkey % (SELECT count(*) FROM supplier) AS k, o_orderdate AS ts FROM orders),
  p AS (SELECT rq.req, rq.ts, ev.ts AS pts, ev.value AS pv FROM rq ASOF LEFT JOIN ev ON rq.k = ev.k AND rq.ts >= ev.ts),
  n AS (SELECT rq.req, ev.ts AS nts, ev.value AS nv FROM rq ASOF LEFT JOIN ev ON rq.k = ev.k AND rq.ts <= ev.ts)
  SELECT p.req, epoch(CASE WHEN pts IS NULL OR (nts IS NOT NULL AND nts - p.ts <= p.ts - pts) THEN nts ELSE pts END)::BIGINT AS t,
    CASE WHEN pts IS NULL OR (nts IS NOT NULL AND nts - p.ts <= p.ts - pts) THEN nv ELSE pv END AS value
  FROM p JOIN n ON p.req = n.req""")
def nearest_asof(spark, sf):
    # the busiest reading of a rack per day, asked for by every order
    series = (
        v.table(spark, sf, "lineitem")
        .select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_extendedprice").alias("value"))
        .groupBy("k", "ts").agg(F.max("value").alias("value"))
    )
    racks = v.table(spark, sf, "supplier").agg(F.count("*").alias("n")).first()["n"]
    asked = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("req"),
        (F.col("o_custkey") % racks).alias("k"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    out = align.nearest_in_time(asked, series, ["value"], bucket_s=30 * v.DAY, keys=["k"])
    return out.select("req", secs("matched_ts").alias("t"), "value")


@query("""SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def time_slice(spark, sf):
    out = align.time_slice(v.events(spark, sf), "2024-01-10 00:00:00", "2024-01-20 12:00:00")
    return out.select("event_id", "value")
