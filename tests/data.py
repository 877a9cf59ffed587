"""Small hand-made series."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridcast import SeriesSpec

T0 = datetime(2024, 1, 1)
STEP = SeriesSpec(("k",), "ts", step_s=10, gap_free=True, chunk_rows=4)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def series(spark, values, key="a", step=10, name="v"):
    rows = [(key, at(i * step), None if x is None else float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, f"k string, ts timestamp, {name} double")


def values(df, col, order="ts"):
    return [r[col] for r in df.orderBy("k", order).collect()]


def skewed(spark, hot=600, others=12, each=100):
    """One key holds a third of the rows; the readings are gappy and irregular."""
    hot_rows = spark.range(hot).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    rest = spark.range(others * each).select(
        F.concat(F.lit("k"), (F.col("id") % others).cast("string")).alias("k"), F.expr(f"id div {others}").alias("i")
    )
    v = F.when(F.pmod(F.xxhash64("k", "i"), F.lit(5)) != 0, F.pmod(F.xxhash64("i", "k"), F.lit(1000)) / 7)
    u = F.when(F.pmod(F.xxhash64("k", "i"), F.lit(17)) < 3, F.pmod(F.xxhash64("i"), F.lit(100)).cast("double"))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 10)
    return hot_rows.unionByName(rest).select("k", ts.alias("ts"), v.alias("v"), u.alias("u"))
