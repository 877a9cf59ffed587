"""Model, profile, sink and whole-table queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridcast.operators import evaluate, features, models, profile, stats
from gridcast.operators.grid import resample_channels
from gridcast.plans import forecast, ingest
from gridcast.plans.storage import materialize, scratch_path
from gridcast.sources import sinks, tables
from gridcast.spec import SeriesSpec
from registry import views as v
from registry.grid import cooler_key, probe_label, probe_lines
from registry.learn import XY, XY_CTE, YS, k_ahead
from registry.score import MODEL_SQL, PRED, model_predictions, predictions_of, rounded
from registry.views import rs, secs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- probes: one column per cabin and height --------------------------------

HOURLY = SeriesSpec((), "ts", step_s=3600)
HEIGHTS = range(20, 44, 2)
PLACES = [(cabin, u) for cabin in (1, 2, 3) for u in HEIGHTS]
PROBES = [f"temp_cabin{cabin}_back_{u}u_c" for cabin, u in PLACES]


def probe_table(spark, sf):
    """(ts, one column per probe): hourly means, empty hours kept."""
    from gridcast.functions.names import clean_probe_label

    rows = v.events(spark, sf).select("ts", clean_probe_label(probe_label()).alias("channel"), "value")
    return resample_channels(rows.where(F.col("channel").isin(*PROBES)), HOURLY, {c: c for c in PROBES}, "channel", "value")


PROBE_ROWS_SQL = """probe_rows AS (SELECT ts, value, 'cabin' || (1 + (user_id // 12) % 3) AS cabin, 20 + 2 * (user_id % 12) AS u FROM events
  WHERE user_id <> 0)"""
PROBE_SQL = PROBE_ROWS_SQL + """, probe_span AS (SELECT unnest(range(min(epoch_us(ts)) // 3600000000, max(epoch_us(ts)) // 3600000000 + 1)) AS b FROM probe_rows),
probe_mean AS (SELECT epoch_us(ts) // 3600000000 AS b, cabin, u, avg(value) AS c FROM probe_rows GROUP BY ALL)"""


@query(f"WITH {PROBE_SQL}, u AS (SELECT unnest(range(20, 44, 2)) AS U), k AS (SELECT 'cabin' || unnest(range(1, 4)) AS cabin) "
       f"SELECT s.b * 3600 AS t, k.cabin, u.U::INT AS U, {rs('m.c')} AS temperature_c "
       "FROM probe_span s CROSS JOIN u CROSS JOIN k LEFT JOIN probe_mean m ON m.b = s.b AND m.u = u.U AND m.cabin = k.cabin")
def profile_matrix(spark, sf):
    out = profile.profile_matrix(probe_table(spark, sf), with_cabin=True)
    return rounded(out, ["temperature_c"], secs().alias("t"), "cabin", "U")


@query(f"WITH {PROBE_SQL} SELECT cabin, u::INT AS U, {rs('avg(c)')} AS temperature_c FROM probe_mean "
       "WHERE b * 3600 BETWEEN epoch(TIMESTAMP '2024-01-10') AND epoch(TIMESTAMP '2024-01-20') GROUP BY cabin, u")
def profile_avg(spark, sf):
    out = profile.profile_mean(probe_table(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00", with_cabin=True)
    return rounded(out, ["temperature_c"], "cabin", "U")


@query(f"""WITH {PROBE_SQL}, rq AS (SELECT event_id, epoch_us(ts) AS x FROM events),
  n AS (SELECT event_id, least(greatest(CAST(floor((x + 1800000000) / 3600000000.0) AS BIGINT), (SELECT min(b) FROM probe_span)), (SELECT max(b) FROM probe_span)) AS b FROM rq)
  SELECT event_id, n.b * 3600 AS t, cabin, u::INT AS U, {rs('c')} AS temperature_c FROM n JOIN probe_mean m ON m.b = n.b""")
def profile_at(spark, sf):
    asked = v.events(spark, sf).select("event_id", "ts")
    out = profile.profile_at(probe_table(spark, sf), asked, bucket_s=6 * 3600, with_cabin=True)
    return rounded(out, ["temperature_c"], "event_id", secs("matched_ts").alias("t"), "cabin", "U")


# Measured points: the mean price of each line number; computed profile: the mean
# price of each quantity and day, by a height made of both.
@query(f"""WITH dense AS (SELECT l_quantity / 10 + l_tax AS z, avg(l_extendedprice) AS c FROM lineitem GROUP BY 1),
  points AS (SELECT o_custkey AS id, avg(o_totalprice) / 100000 AS z, max(o_totalprice) AS m FROM orders GROUP BY 1),
  p AS (SELECT points.*, dense.z AS pz, dense.c AS pc FROM points ASOF LEFT JOIN dense ON points.z >= dense.z),
  n AS (SELECT points.id, dense.z AS nz, dense.c AS nc FROM points ASOF LEFT JOIN dense ON points.z <= dense.z)
  SELECT p.id, {rs('CASE WHEN pz IS NULL OR nz - z <= z - pz THEN nz ELSE pz END')} AS matched_z,
    {rs('CASE WHEN pz IS NULL OR nz - z <= z - pz THEN nc ELSE pc END - m')} AS error FROM p JOIN n ON p.id = n.id""")
def design_compare(spark, sf):
    dense = v.table(spark, sf, "lineitem").groupBy((F.col("l_quantity") / 10 + F.col("l_tax")).alias("z")).agg(F.avg("l_extendedprice").alias("computed"))
    points = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        (F.avg("o_totalprice") / 100000).alias("z"), F.max("o_totalprice").alias("measured"))
    out = profile.compare_with_dense(points, dense, width=0.5)
    return rounded(out, ["matched_z", "error"], "id")


@query(f"SELECT l_suppkey AS id, {rs('avg(l_tax) - avg(l_discount)')} AS difference FROM lineitem GROUP BY 1")
def design_difference(spark, sf):
    points = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.avg("l_discount").alias("previous"), F.avg("l_tax").alias("retrofitted"))
    return rounded(profile.design_difference(points, "previous", "retrofitted"), ["difference"], "id")


# --- the two logs to one merged table ---------------------------------------

# Events of type view are the airflow in a second unit, which the feed drops (B8).
COOLER_EVENTS = {"click": "airflow_lps", "error": "supply_air_c", "purchase": "cool_demand_kwh", "signup": "door__per__open_state"}
COOLERS = list(COOLER_EVENTS.values())
FEATURES = COOLERS[:3]  # a door is not among the features of the merged table
HOUR_US = 3_600_000_000
COOL_SQL = f"""WITH cool_rows AS (SELECT ts, event_type, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS value FROM events
  WHERE event_type <> 'view'),
cool_all AS (SELECT unnest(range(min(epoch_us(ts)) // {HOUR_US}, max(epoch_us(ts)) // {HOUR_US} + 1)) AS b FROM cool_rows),
cool_mean AS (SELECT epoch_us(ts) // {HOUR_US} AS b, {", ".join(f"avg(value) FILTER (event_type = '{e}') AS {c}" for e, c in COOLER_EVENTS.items())}
  FROM cool_rows GROUP BY 1),
cool_grid AS (SELECT 0 AS one, s.b, s.b * 3600 AS t, {", ".join(COOLERS)} FROM cool_all s LEFT JOIN cool_mean m ON s.b = m.b),
{v.ffill_sql("cool", "cool_grid", "one", COOLERS, 1)}"""


def cooler_lines(spark, sf):
    value = F.col("value").cast("decimal(12,2)").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat(F.lit("{'"), stamp, F.lit("': [{'"), cooler_key(), F.lit("': "), value, F.lit("}]}"))
    return v.events(spark, sf).select(line.alias("line"))


@query(f"{COOL_SQL} SELECT CAST(t AS BIGINT) AS t, {v.r6_list(COOLERS)} FROM cool")
def cooler_feed(spark, sf):
    lines = cooler_lines(spark, sf)
    return rounded(ingest.cooler_feed(lines, HOURLY, COOLERS), COOLERS, secs().alias("t"))


INGEST_SQL = f"""{COOL_SQL},
pr AS (SELECT date_trunc('second', ts) AS ts, user_id, (user_id // 12) % 3 AS cabin, 20 + 2 * (user_id % 12) AS u,
  nullif(CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE), 0) AS value FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0),
pr_all AS (SELECT unnest(range(min(epoch_us(ts)) // 3600000000, max(epoch_us(ts)) // 3600000000 + 1)) AS b FROM pr WHERE user_id <> 0),
pr_mean AS (SELECT epoch_us(ts) // 3600000000 AS b, {", ".join(f"avg(value) FILTER (cabin = {cabin - 1} AND u = {u}) AS {c}" for (cabin, u), c in zip(PLACES, PROBES))} FROM pr WHERE user_id <> 0 GROUP BY 1),
pr_grid AS (SELECT 0 AS one, s.b, s.b * 3600 AS t, {", ".join(PROBES)} FROM pr_all s LEFT JOIN pr_mean m ON s.b = m.b),
{v.ffill_sql("probes", "pr_grid", "one", PROBES, 1)},
mg AS (SELECT 0 AS one, cool.b, cool.t, {", ".join([*FEATURES, *PROBES])} FROM cool JOIN probes ON cool.b = probes.b
  WHERE {" OR ".join(f"{p} IS NOT NULL" for p in PROBES)}),
ff AS (SELECT t, {", ".join(PROBES)}, {", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS {c}" for c in FEATURES)} FROM mg),
st AS (SELECT {", ".join(f"avg({p}) AS {p}_m, stddev_pop({p}) AS {p}_s" for p in PROBES)} FROM ff)
SELECT CAST(t AS BIGINT) AS t, {v.r6_list(FEATURES)}, {", ".join(f"{rs(p)} AS {p}, {rs(f'({p} - {p}_m) / CASE WHEN {p}_s = 0 THEN 1 ELSE {p}_s END')} AS {p}_z" for p in PROBES)} FROM ff, st"""


@query(INGEST_SQL)
def merged_table(spark, sf):
    cool = ingest.cooler_feed(cooler_lines(spark, sf), HOURLY, COOLERS)
    probes = ingest.probe_feed(probe_lines(spark, sf), HOURLY, PROBES)
    out, feats, targets = ingest.merge_feeds(cool, probes, HOURLY)
    return rounded(out, [*feats, *targets, *[f"{t}_z" for t in targets]], secs().alias("t"))


# --- models -------------------------------------------------------------------

@query()
def rf_forecast(spark, sf):
    """Forest skill per target on the test split."""
    ds = k_ahead(spark, sf)
    out = forecast.forecast(ds, v.racks(spark, sf), v.RACKS, n_trees=10, max_depth=5)
    return out.skill


@query()
def rf_importance_topk(spark, sf):
    forest = models.fit_forest(k_ahead(spark, sf), n_trees=5, max_depth=4)
    return models.top_importance(spark, forest, 10)


@query()
def rf_registry_roundtrip(spark, sf):
    """A forest saved, loaded and scored again."""
    ds = k_ahead(spark, sf)
    forest = models.fit_forest(ds, n_trees=5, max_depth=4)
    path = scratch_path(spark, "forest")
    models.save_forest(spark, forest, path)
    loaded = models.load_forest(spark, path)
    models.check_compatible(loaded, ds.features, ds.targets)
    return evaluate.metrics(models.score_dataset(loaded, ds, ["rack", "ts", "split"]), ["split"])


KEPT_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS name, var_pop(least(greatest({c}, {c}_lo), {c}_hi)) AS variance FROM xy, q WHERE split = 'train'"
    for i, c in enumerate(XY)
)


@query(XY_CTE + ", q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in XY)
       + f" FROM xy WHERE split = 'train'), kept AS ({KEPT_SQL}) SELECT sha256(string_agg(name, '|' ORDER BY i)) AS feature_fingerprint, "
       f"sha256('{'|'.join(v.TARGETS)}') AS target_fingerprint FROM kept WHERE variance >= 1e-8")
def registry_fingerprint(spark, sf):
    ds = k_ahead(spark, sf)
    row = models.registry_row(spark, models.Forest({}, ds.features, ds.targets, ds.scaler, ds.bounds, ds.k, ds.cadence_s))
    return row.select("feature_fingerprint", "target_fingerprint")


def network(n_in: int, hidden: int, n_out: int) -> models.Dense:
    """Fixed test weights: a small number from the two indexes."""
    def layer(a, b, k):
        return np.array([[((3 * i + 7 * j + k) % 11 - 5) / 10 for j in range(b)] for i in range(a)])

    return models.Dense(
        [layer(n_in, hidden, 1), layer(hidden, hidden, 2), layer(hidden, n_out, 3)],
        [np.full(hidden, 0.1), np.full(hidden, -0.1), np.full(n_out, 0.5)],
        "relu",
    )


NET = network(len(v.EXOG) + 4, 4, len(v.TARGETS))


def layer_sql(prefix: str, inputs: list[str], w, b, relu: bool) -> dict[str, str]:
    out = {}
    for j in range(w.shape[1]):
        dot = " + ".join(f"{x} * ({w[i, j]!r})".replace("np.float64(", "(") for i, x in enumerate(inputs))
        e = f"{dot} + ({float(b[j])!r})"
        out[f"{prefix}{j}"] = f"greatest({e}, 0.0)" if relu else e
    return out


EMB = {f"e{fn}{i}": f"{fn}(2 * pi() * i * {10.0 ** (-3 + 6 * i)!r})" for fn in ("cos", "sin") for i in range(2)}
H1 = layer_sql("h", [*v.EXOG, *EMB], NET.weights[0], NET.biases[0], True)
H2 = layer_sql("g", list(H1), NET.weights[1], NET.biases[1], True)
OUT = layer_sql("o", list(H2), NET.weights[2], NET.biases[2], False)


@query(f"WITH {v.RACKS_SQL}, i AS (SELECT rack, t, {', '.join(v.EXOG)}, row_number() OVER (PARTITION BY rack ORDER BY t) - 1 AS i FROM racks), "
       f"e AS (SELECT *, {v.select_list(EMB)} FROM i WHERE fan IS NOT NULL AND supply IS NOT NULL AND load IS NOT NULL), "
       f"l1 AS (SELECT rack, t, {v.select_list(H1)} FROM e), l2 AS (SELECT rack, t, {v.select_list(H2)} FROM l1), l3 AS (SELECT rack, t, {v.select_list(OUT)} FROM l2) "
       f"SELECT rack, CAST(t AS BIGINT) AS t, {rs('o0')} AS p_t_low, {rs('o1')} AS p_t_high FROM l3")
def mlp_score(spark, sf):
    rows = features.time_index(v.racks(spark, sf), v.RACKS_RAW).dropna(how="any", subset=v.EXOG)
    out = models.dense_predictions(rows, NET, v.EXOG, v.TARGETS, features.fourier_time(F.col("t_idx"), 2))
    return rounded(out, ["p_t_low", "p_t_high"], "rack", secs().alias("t"))


# --- sinks ----------------------------------------------------------------------

RACK_COLS = [*v.EXOG, *v.TARGETS]
RACK_SQL = f"WITH {v.RACKS_SQL} SELECT rack, CAST(t AS BIGINT) AS t, {v.r6_list(RACK_COLS)} FROM racks"


@query(RACK_SQL)
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "merged")
    sinks.write_merged(v.racks(spark, sf).withColumn("year", F.year("ts")), path, ["year"], ["parquet"])
    back = tables.read_table(spark, f"{path}/parquet", ["rack", "ts", *RACK_COLS])
    return rounded(back, RACK_COLS, "rack", secs().alias("t"))


@query(f"WITH {v.RACKS_SQL} SELECT CAST(rack AS DOUBLE) AS rack, CAST(t AS DOUBLE) AS t, {v.r6_list(RACK_COLS)} FROM racks")
def csv_profile(spark, sf):
    path = scratch_path(spark, "merged")
    rows = v.racks(spark, sf).select("rack", secs().alias("t"), *RACK_COLS)
    sinks.write_merged(rows, path, formats=["csv"])
    back = tables.read_numeric_csv(spark, f"{path}/csv", ["rack", "t", *RACK_COLS])
    return rounded(back, RACK_COLS, "rack", "t")


@query(XY_CTE + " " + " UNION ALL ".join(
    f"SELECT rack, '{c}' AS \"column\", {rs(f'avg({c})')} AS mean, {rs(f'CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END')} AS std "
    f"FROM xy WHERE split = 'train' GROUP BY rack" for c in YS))
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "stats")
    fitted = stats.scaler_fit(v.xy(spark, sf).where("split = 'train'"), YS, ["rack"])
    sinks.write_stats(fitted, path)
    back = sinks.read_stats(spark, path, fitted.schema)
    return rounded(back, ["mean", "std"], "rack", "column")


@query(f"{PRED} SELECT split, target, {rs('avg(abs(y_true - y_pred))')} AS MAE FROM pred GROUP BY ALL")
def metrics_csv(spark, sf):
    path = scratch_path(spark, "metrics")
    table = evaluate.per_target(evaluate.metrics(v.predictions(spark, sf), ["split"]))
    sinks.write_metrics(table.select("split", "target", "MAE"), path)
    back = spark.read.csv(path, header=True, schema="split string, target string, MAE double")
    return rounded(back, ["MAE"], "split", "target")


@query(f"WITH {v.RACKS_SQL}, {MODEL_SQL} SELECT rack, CAST(t AS BIGINT) AS t, target, {v.r6_list(['y_true', 'y_pred'])} FROM model")
def prediction_cache(spark, sf):
    """The second call finds what the first one wrote."""
    path = scratch_path(spark, "cache")
    # stored, as means taken twice may differ in the last bit, and with them the key of the content
    rows = materialize(v.racks(spark, sf))

    def refuse(_):
        raise AssertionError("the cache was missed")

    key = ["rack", "ts", *v.EXOG, *v.TARGETS]
    sinks.cached_predictions(rows, path, "all", "mean3", key, predictions_of)
    out = sinks.cached_predictions(rows, path, "all", "mean3", key, refuse)
    return rounded(out, ["y_true", "y_pred"], "rack", secs().alias("t"), "target")
