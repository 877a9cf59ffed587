"""Telemetry views over the given tables, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators.features import supervised
from gridcast.operators.grid import ffill, resample_mean
from gridcast.operators.split import time_split
from gridcast.plans.storage import materialize
from gridcast.spec import SeriesSpec

DAY = 86_400
# 1995-01-01: where the 30-day bins of the rack table start
RACK_ORIGIN_US = 788_918_400 * 1_000_000
EXOG = ["fan", "supply", "load"]
TARGETS = ["t_low", "t_high"]

EVENTS = SeriesSpec(("user_id",), "ts", step_s=3600, bucket_s=6 * 3600)
FLEET = EVENTS.replace(gap_free=True)
TYPES = SeriesSpec(("event_type",), "ts", step_s=3600)
RACKS_RAW = SeriesSpec(("rack",), "ts", step_s=30 * DAY, origin_us=RACK_ORIGIN_US)
RACKS = RACKS_RAW.replace(gap_free=True)


def r6(c: Column | str) -> Column:
    """Six places. The 0.50001 keeps values that end in an exact half off the edge,
    where the last bit of a sum would decide the rounding."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.50001) / 1e6


def rs(x: str) -> str:
    """``r6`` in SQL."""
    return f"floor(({x}) * 1e6 + 0.50001) / 1e6"


def secs(c: Column | str = "ts") -> Column:
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def fleet(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, ts, value): hourly mean per user, empty hours kept."""
    return resample_mean(events(spark, sf), EVENTS, ["value"])


def types_grid(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, ts, value): hourly mean per type, forward-filled by one."""
    grid = resample_mean(events(spark, sf), TYPES, ["value"])
    return ffill(grid, TYPES.replace(gap_free=True), ["value"], 1)


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """One reading per line item: the supplier is the rack."""
    df = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice") / 1000
    return df.select(
        F.col("l_suppkey").alias("rack"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("fan"),
        (F.col("l_discount") * 100).alias("supply"),
        (F.col("l_tax") * 100).alias("load"),
        (price * (1 - F.col("l_discount"))).alias("t_low"),
        (price * (1 + F.col("l_tax"))).alias("t_high"),
    )


def racks(spark: SparkSession, sf: str) -> DataFrame:
    """(rack, ts, fan, supply, load, t_low, t_high): 30-day means, filled by one."""
    cols = [*EXOG, *TARGETS]
    grid = resample_mean(shipments(spark, sf), RACKS_RAW, cols)
    return ffill(grid, RACKS, cols, 1)


def xy(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """Complete rows of features and labels, with the split."""
    ds = materialize(supervised(racks(spark, sf), RACKS, EXOG, TARGETS, k=k))
    return time_split(ds, RACKS_RAW)


def predictions(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """(rack, ts, target, y_true, y_pred, split): k-step persistence, long form."""
    from gridcast.operators.evaluate import persistence_series

    return persistence_series(racks(spark, sf), RACKS, TARGETS, k)


# --- the same views as DuckDB common tables -------------------------------

def grid_sql(name: str, key: str, source: str, step: int, cols: list[str], origin: int = 0) -> str:
    """Mean per bin, every bin between first and last kept: (key, b, cols)."""
    avgs = ", ".join(f"avg({c}) AS {c}" for c in cols)
    picked = ", ".join(f"m.{c}" for c in cols)
    return f"""
{name}_rows AS (SELECT *, CAST(floor((epoch_us(ts) - {origin}::BIGINT * 1000000) / ({step}::BIGINT * 1000000)) AS BIGINT) AS b
  FROM {source} WHERE ts IS NOT NULL),
{name}_mean AS (SELECT {key}, b, {avgs} FROM {name}_rows GROUP BY {key}, b),
{name}_span AS (SELECT {key}, unnest(range(min(b), max(b) + 1)) AS b FROM {name}_mean GROUP BY {key}),
{name} AS (SELECT s.{key}, s.b, s.b * {step} + {origin} AS t, {picked}
  FROM {name}_span s LEFT JOIN {name}_mean m ON s.{key} = m.{key} AND s.b = m.b)"""


def ffill_sql(name: str, source: str, key: str, cols: list[str], n: int, keep: str = "b, t") -> str:
    filled = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY b ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) AS {c}"
        for c in cols
    )
    return f"{name} AS (SELECT {key}, {keep}, {filled} FROM {source})"


SHIPMENTS_SQL = """shipments AS (SELECT l_suppkey AS rack, l_shipdate AS ts, l_quantity AS fan,
  l_discount * 100 AS supply, l_tax * 100 AS load,
  l_extendedprice / 1000 * (1 - l_discount) AS t_low,
  l_extendedprice / 1000 * (1 + l_tax) AS t_high FROM lineitem)"""

FLEET_SQL = grid_sql("fleet", "user_id", "events", 3600, ["value"])
TYPES_SQL = (
    grid_sql("types_raw", "event_type", "events", 3600, ["value"])
    + ",\n"
    + ffill_sql("types_grid", "types_raw", "event_type", ["value"], 1)
)
RACKS_SQL = (
    SHIPMENTS_SQL
    + ","
    + grid_sql("racks_raw", "rack", "shipments", 30 * DAY, [*EXOG, *TARGETS], RACK_ORIGIN_US // 1_000_000)
    + ",\n"
    + ffill_sql("racks", "racks_raw", "rack", [*EXOG, *TARGETS], 1)
)


def lag_sql(c: str, n: int, key: str) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY {key} ORDER BY b)"


def roll_sql(c: str, n: int, kind: str, key: str) -> str:
    if kind == "delta":
        return f"{c} - {lag_sql(c, n, key)}"
    frame = f"OVER (PARTITION BY {key} ORDER BY b ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    stat = "avg" if kind == "mean" else "stddev_pop"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {stat}({c}) {frame} END"


def features_sql(cols: list[str], lags, rolls, key: str) -> dict[str, str]:
    out = {c: c for c in cols}
    out |= {f"{c}_lag{n}": lag_sql(c, n, key) for c in cols for n in lags}
    out |= {f"{c}_roll{n}_{k}": roll_sql(c, n, k, key) for c in cols for n in rolls for k in ("mean", "std", "delta")}
    return out


def lead_sql(c: str, k: int, key: str) -> str:
    return f"lead({c}, {k}) OVER (PARTITION BY {key} ORDER BY b)"


def select_list(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def r6_list(names) -> str:
    return ", ".join(f"{rs(n)} AS {n}" for n in names)


def xy_sql(k: int = 3) -> str:
    """``xy``: complete rows with the split; needs ``racks``."""
    feats = features_sql(EXOG, (1, 3, 6, 12), (3, 6, 12), "rack")
    labels = {f"y_{c}": lead_sql(c, k, "rack") for c in TARGETS}
    present = " AND ".join(f"{n} IS NOT NULL" for n in [*feats, *labels])
    return f"""xy_all AS (SELECT rack, t, b, {select_list(feats | labels)} FROM racks),
xy_ok AS (SELECT *, row_number() OVER (PARTITION BY rack ORDER BY t) - 1 AS rn, count(*) OVER (PARTITION BY rack) AS n
  FROM xy_all WHERE {present}),
xy AS (SELECT *, CASE WHEN rn < floor(n * 0.7) THEN 'train'
  WHEN rn < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM xy_ok)"""


def predictions_sql(k: int = 3) -> str:
    """``pred``: persistence over the series; needs ``racks``."""
    per = " UNION ALL ".join(
        f"SELECT rack, t, split, '{c}' AS target, {c} AS y_pred, {c}_f AS y_true FROM pred_w WHERE {c}_f IS NOT NULL AND {c} IS NOT NULL"
        for c in TARGETS
    )
    leads = ", ".join(f"{lead_sql(c, k, 'rack')} AS {c}_f" for c in TARGETS)
    return f"""pred_n AS (SELECT *, row_number() OVER (PARTITION BY rack ORDER BY b) - 1 AS rn,
  count(*) OVER (PARTITION BY rack) AS n, {leads} FROM racks),
pred_w AS (SELECT *, CASE WHEN rn < floor(n * 0.7) THEN 'train'
  WHEN rn < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM pred_n),
pred AS ({per})"""
