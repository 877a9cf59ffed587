"""Feature, split, statistics and dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import align, features, split, stats
from gridcast.plans import dataset
from registry import views as v
from registry.views import r6, rs, secs

QUERIES: dict = {}
SQL: dict[str, str] = {}

LAGS, ROLLS = features.LAGS, features.ROLLS
XY = features.feature_names(v.EXOG)
YS = [f"y_{t}" for t in v.TARGETS]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def shown(df, keys, cols):
    return df.select(*keys, secs().alias("t"), *[r6(c).alias(c) for c in cols])


def fleet_sql(exprs: dict[str, str]) -> str:
    """Window expressions over the hourly fleet, filled by two."""
    return (
        f"WITH {v.FLEET_SQL}, {v.ffill_sql('filled', 'fleet', 'user_id', ['value'], 2)}, "
        f"w AS (SELECT user_id, t, {v.select_list(exprs)} FROM filled) "
        f"SELECT user_id, CAST(t AS BIGINT) AS t, {v.r6_list(exprs)} FROM w"
    )


def filled_fleet(spark, sf):
    from gridcast.operators.grid import ffill

    return ffill(v.fleet(spark, sf), v.FLEET, ["value"], 2)


LAG_EXPRS = {f"value_lag{n}": v.lag_sql("value", n, "user_id") for n in LAGS}
ROLL_EXPRS = {
    kind: {f"value_roll{n}_{kind}": v.roll_sql("value", n, kind, "user_id") for n in ROLLS}
    for kind in ("mean", "std", "delta")
}


@query(fleet_sql(LAG_EXPRS))
def lag_features(spark, sf):
    return shown(features.add_lags(filled_fleet(spark, sf), v.FLEET, ["value"]), ["user_id"], LAG_EXPRS)


def _rolls(spark, sf, kind):
    out = features.add_rolls(filled_fleet(spark, sf), v.FLEET, ["value"], kinds=[kind])
    return shown(out, ["user_id"], ROLL_EXPRS[kind])


@query(fleet_sql(ROLL_EXPRS["mean"]))
def rolling_mean(spark, sf):
    return _rolls(spark, sf, "mean")


@query(fleet_sql(ROLL_EXPRS["std"]))
def rolling_std(spark, sf):
    return _rolls(spark, sf, "std")


@query(fleet_sql(ROLL_EXPRS["delta"]))
def rolling_delta(spark, sf):
    return _rolls(spark, sf, "delta")


@query(fleet_sql({"y_value": v.lead_sql("value", 12, "user_id")}))
def k_ahead_label(spark, sf):
    out = features.add_labels(filled_fleet(spark, sf), v.FLEET, ["value"], 12)
    return shown(out, ["user_id"], ["y_value"])


TARGET_LAGS = {f"{c}_lag{n}": v.lag_sql(c, n, "rack") for c in v.TARGETS for n in (1, 3)}


@query(f"WITH {v.RACKS_SQL}, w AS (SELECT rack, t, {v.select_list(TARGET_LAGS)} FROM racks) "
       f"SELECT rack, CAST(t AS BIGINT) AS t, {v.r6_list(TARGET_LAGS)} FROM w")
def target_lags(spark, sf):
    out = features.add_lags(v.racks(spark, sf), v.RACKS, v.TARGETS, (1, 3))
    return shown(out, ["rack"], TARGET_LAGS)


def racks_sql(exprs: dict[str, str], complete: bool) -> str:
    where = " WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in exprs) if complete else ""
    return (
        f"WITH {v.RACKS_SQL}, w AS (SELECT rack, t, {v.select_list(exprs)} FROM racks) "
        f"SELECT rack, CAST(t AS BIGINT) AS t, {v.r6_list(exprs)} FROM w{where}"
    )


@query(racks_sql(v.features_sql(v.EXOG, LAGS, ROLLS, "rack"), True))
def official_features(spark, sf):
    out = features.official_features(v.racks(spark, sf), v.RACKS, v.EXOG, targets=v.TARGETS)
    return shown(out, ["rack"], XY)


# The second feature family: lags 1/3/5/10 and one current target as a feature.
SECOND = v.features_sql(v.EXOG, (1, 3, 5, 10), ROLLS, "rack") | {"t_low": "t_low"}


@query(racks_sql(SECOND, True))
def second_features(spark, sf):
    out = features.features_from_list(v.racks(spark, sf), v.RACKS, list(SECOND))
    return shown(out.dropna(how="any", subset=list(SECOND)), ["rack"], SECOND)


SUPERVISED = (
    v.features_sql(v.EXOG, LAGS, ROLLS, "rack")
    | TARGET_LAGS
    | {f"y_{c}": v.lead_sql(c, 3, "rack") for c in v.TARGETS}
)


@query(racks_sql(SUPERVISED, True))
def supervised_dataset(spark, sf):
    out = features.supervised(v.racks(spark, sf), v.RACKS, v.EXOG, v.TARGETS, k=3, target_lags=(1, 3))
    return shown(out, ["rack"], SUPERVISED)


NAMED = {
    "load": "load",
    "fan_roll6_std": v.roll_sql("fan", 6, "std", "rack"),
    "supply_lag2": v.lag_sql("supply", 2, "rack"),
    "fan_roll4_delta": v.roll_sql("fan", 4, "delta", "rack"),
}


@query(racks_sql(NAMED, False))
def features_from_list(spark, sf):
    names = [*NAMED, "nosuch_lag3"]
    return shown(features.features_from_list(v.racks(spark, sf), v.RACKS, names), ["rack"], NAMED)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t_idx FROM events")
def time_index(spark, sf):
    out = features.time_index(v.events(spark, sf), v.EVENTS)
    return out.select("user_id", "event_id", "t_idx")


T_IDX_SQL = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events"
FOURIER = {
    f"t_{fn}{i}": f"{fn}(2 * pi() * i * {10.0 ** (-3 + 6 * i / 15)!r}::DOUBLE)" for fn in ("cos", "sin") for i in range(8)
}


@query(f"WITH e AS ({T_IDX_SQL}) SELECT user_id, event_id, "
       + ", ".join(f"{rs(x)} AS {n}" for n, x in FOURIER.items()) + " FROM e")
def fourier_time(spark, sf):
    out = features.time_index(v.events(spark, sf), v.EVENTS)
    emb = out.select("user_id", "event_id", *features.time_embedding(F.col("t_idx"), "fourier"))
    return emb.select("user_id", "event_id", *[r6(n).alias(n) for n in FOURIER])


SINUS = {f"t_emb{i}": f"sin(i * exp(-ln(10000.0) * {i}.0 / 16))" for i in range(16)} | {
    f"t_emb{16 + i}": f"cos(i * exp(-ln(10000.0) * {i}.0 / 16))" for i in range(16)
}


@query(f"WITH e AS ({T_IDX_SQL}) SELECT user_id, event_id, "
       + ", ".join(f"{rs(x)} AS {n}" for n, x in SINUS.items()) + " FROM e")
def sinusoidal_time(spark, sf):
    out = features.time_index(v.events(spark, sf), v.EVENTS)
    emb = out.select("user_id", "event_id", *features.time_embedding(F.col("t_idx"), "sinusoidal"))
    return emb.select("user_id", "event_id", *[r6(n).alias(n) for n in SINUS])


@query("""SELECT user_id, event_id, CASE WHEN rn < floor(n * 0.7) THEN 'train'
    WHEN rn < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def time_split(spark, sf):
    return split.time_split(v.events(spark, sf), v.EVENTS).select("user_id", "event_id", "split")


@query("""SELECT event_id, CASE WHEN rn < floor(n * 0.7) THEN 'train'
    WHEN rn < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split,
    CAST(rn - CASE WHEN rn < floor(n * 0.7) THEN 0 WHEN rn < floor(n * 0.7) + floor(n * 0.15) THEN floor(n * 0.7)
      ELSE floor(n * 0.7) + floor(n * 0.15) END AS BIGINT) AS t_idx
  FROM (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM events)""")
def time_split_rows(spark, sf):
    # one series without keys, cut by row
    out = split.time_split_by_row(v.events(spark, sf), v.EVENTS.replace(keys=()))
    return out.select("event_id", "split", "t_idx")


XY_CTE = f"WITH {v.RACKS_SQL}, {v.xy_sql()}"


def train(spark, sf):
    return v.xy(spark, sf).where("split = 'train'")


@query(XY_CTE + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {rs(f'quantile_cont({c}, 0.01)')} AS low, {rs(f'quantile_cont({c}, 0.99)')} AS high "
    f"FROM xy WHERE split = 'train'" for c in XY))
def winsor_bounds(spark, sf):
    out = stats.winsor_bounds(train(spark, sf), XY)
    return out.select("column", r6("low").alias("low"), r6("high").alias("high"))


@query("SELECT " + ", ".join(
    f"{rs(f'quantile_cont({c}, {q})')} AS {c}_{n}" for c in ("l_extendedprice", "l_quantity") for n, q in (("lo", 0.01), ("hi", 0.99))
) + " FROM lineitem")
def exact_quantiles(spark, sf):
    """Bounds of the raw readings by narrowing, as for tables too large for one buffer."""
    cols = ["l_extendedprice", "l_quantity"]
    out = stats.quantiles(v.table(spark, sf, "lineitem"), cols, [0.01, 0.99])
    return out.select(*[r6(F.col(c)[i]).alias(f"{c}_{n}") for c in cols for i, n in enumerate(("lo", "hi"))])


@query(XY_CTE + f", q AS (SELECT rack, {', '.join(f'quantile_cont({c}, 0.05) AS {c}_lo, quantile_cont({c}, 0.95) AS {c}_hi' for c in v.EXOG)} "
       "FROM xy WHERE split = 'train' GROUP BY rack) SELECT xy.rack, CAST(t AS BIGINT) AS t, "
       + ", ".join(f"{rs(f'least(greatest({c}, {c}_lo), {c}_hi)')} AS {c}" for c in v.EXOG) + " FROM xy JOIN q ON xy.rack = q.rack")
def winsorize(spark, sf):
    # bounds of each rack's own training rows
    rows = v.xy(spark, sf)
    bounds = stats.winsor_bounds(rows.where("split = 'train'"), v.EXOG, 0.05, 0.95, keys=["rack"])
    return shown(stats.winsorize(rows, bounds, v.EXOG, keys=["rack"]), ["rack"], v.EXOG)


@query(XY_CTE + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {rs(f'var_pop({c})')} AS variance, coalesce(var_pop({c}) >= 1e-8, false) AS kept "
    f"FROM (SELECT *, 5.0::DOUBLE AS flat FROM xy) WHERE split = 'train'" for c in [*XY, "flat"]))
def low_variance(spark, sf):
    out = stats.low_variance_table(train(spark, sf).withColumn("flat", F.lit(5.0)), [*XY, "flat"])
    return out.select("column", r6("variance").alias("variance"), "kept")


@query(XY_CTE + " " + " UNION ALL ".join(
    f"SELECT rack, '{c}' AS \"column\", {rs(f'avg({c})')} AS mean, {rs(f'CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END')} AS std "
    f"FROM (SELECT *, 5.0::DOUBLE AS flat FROM xy) WHERE split = 'train' GROUP BY rack" for c in [*YS, "flat"]))
def scaler_fit(spark, sf):
    out = stats.scaler_fit(train(spark, sf).withColumn("flat", F.lit(5.0)), [*YS, "flat"], keys=["rack"])
    return out.select("rack", "column", r6("mean").alias("mean"), r6("std").alias("std"))


SCALED_CTE = XY_CTE + ", s AS (SELECT rack, " + ", ".join(
    f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s" for c in YS
) + " FROM xy WHERE split = 'train' GROUP BY rack)"


@query(SCALED_CTE + " SELECT xy.rack, CAST(t AS BIGINT) AS t, "
       + ", ".join(f"{rs(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in YS) + " FROM xy JOIN s ON xy.rack = s.rack")
def scaler_transform(spark, sf):
    rows = v.xy(spark, sf)
    fitted = stats.scaler_fit(rows.where("split = 'train'"), YS, keys=["rack"])
    return shown(stats.scaler_transform(rows, fitted, YS, keys=["rack"]), ["rack"], YS)


@query(XY_CTE + " SELECT rack, CAST(t AS BIGINT) AS t, "
       + ", ".join(f"{rs(c)} AS {c}, {rs(c)} AS {c}_arr" for c in YS) + " FROM xy")
def scaler_roundtrip(spark, sf):
    rows = v.xy(spark, sf)
    fitted = stats.pooled(stats.scaler_fit(rows.where("split = 'train'"), YS))
    scaled = stats.scaler_transform(rows, fitted, YS)
    arr = stats.scaler_inverse_array(F.array(*YS), fitted, YS)
    scaled = scaled.withColumns({f"{c}_arr": arr[i] for i, c in enumerate(YS)})
    return shown(stats.scaler_inverse(scaled, fitted, YS), ["rack"], [*YS, *[f"{c}_arr" for c in YS]])


@query(f"WITH {v.RACKS_SQL}, s AS (SELECT rack, " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in v.TARGETS)
       + " FROM racks GROUP BY rack) SELECT racks.rack, CAST(t AS BIGINT) AS t, "
       + ", ".join(f"{rs(f'({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1.0 ELSE {c}_s END')} AS {c}_z" for c in v.TARGETS)
       + " FROM racks JOIN s ON racks.rack = s.rack")
def zscore_full(spark, sf):
    out = stats.zscore_full(v.racks(spark, sf), v.TARGETS, ["rack"])
    return shown(out, ["rack"], [f"{c}_z" for c in v.TARGETS])


def k_ahead(spark, sf, k=3):
    return dataset.prepare_k_ahead(v.racks(spark, sf), v.RACKS, v.EXOG, v.TARGETS, k=k)


K_AHEAD_CTE = (
    XY_CTE
    + ", q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in XY)
    + " FROM xy WHERE split = 'train'), s AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in YS)
    + " FROM xy WHERE split = 'train'), ds AS (SELECT rack, CAST(t AS BIGINT) AS t, split, "
    + ", ".join(f"least(greatest({c}, {c}_lo), {c}_hi) AS {c}" for c in XY) + ", "
    + ", ".join(f"({c} - {c}_m) / {c}_s AS {c}" for c in YS) + " FROM xy, q, s)"
)


@query(K_AHEAD_CTE + f" SELECT rack, t, split, {v.r6_list([*XY, *YS])} FROM ds")
def k_ahead_dataset(spark, sf):
    out = k_ahead(spark, sf).rows
    return out.select("rack", secs().alias("t"), "split", *[r6(c).alias(c) for c in [*XY, *YS]])


@query(XY_CTE + f" SELECT split, count(*) AS n, {len(XY)}::BIGINT AS n_features, 2::BIGINT AS n_targets, 3::BIGINT AS k_ahead FROM xy GROUP BY split")
def split_counts(spark, sf):
    out = k_ahead(spark, sf).counts()
    return out.select("split", "n", *[F.col(c).cast("long").alias(c) for c in ("n_features", "n_targets", "k_ahead")])


@query(K_AHEAD_CTE + f" SELECT rack, t, {len(XY)}::BIGINT AS width, unnest(range(0, {len(XY) + len(YS)})) AS place, unnest(["
       + ", ".join(f"floor(CAST({c} AS FLOAT) * 1000.0::DOUBLE + 0.5001) / 1000" for c in [*XY, *YS]) + "]) AS value FROM ds")
def feature_arrays(spark, sf):
    """Every cell of both arrays: first the features, then the labels."""
    out = dataset.feature_arrays(k_ahead(spark, sf))
    cells = out.select("rack", secs().alias("t"), F.size("X").cast("long").alias("width"), F.posexplode(F.concat("X", "y")).alias("place", "value"))
    near = F.floor(F.col("value").cast("double") * 1000 + 0.5001) / 1000
    return cells.select("rack", "t", "width", F.col("place").cast("long").alias("place"), near.alias("value"))


@query(f"WITH {v.RACKS_SQL}, x AS (SELECT rack, t, {v.lag_sql('fan', 1, 'rack')} AS fan_lag1 FROM racks), "
       f"y AS (SELECT rack, t, {v.lead_sql('t_low', 3, 'rack')} AS y_t_low FROM racks) "
       f"SELECT x.rack, CAST(x.t AS BIGINT) AS t, {v.r6_list(['fan_lag1', 'y_t_low'])} FROM x JOIN y ON x.rack = y.rack AND x.t = y.t "
       "WHERE fan_lag1 IS NOT NULL AND y_t_low IS NOT NULL")
def align_xy(spark, sf):
    racks = v.racks(spark, sf)
    x = features.add_lags(racks, v.RACKS, ["fan"], [1]).select("rack", "ts", "fan_lag1")
    y = features.add_labels(racks, v.RACKS, ["t_low"], 3).select("rack", "ts", "y_t_low")
    out = align.align_xy(x, y, ["fan_lag1", "y_t_low"], ["rack"])
    return shown(out, ["rack"], ["fan_lag1", "y_t_low"])
