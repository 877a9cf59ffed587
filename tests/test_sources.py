"""Log lines, names, files."""

import pytest
from pyspark.sql import functions as F

from gridcast.functions import names
from gridcast.operators import clean, features, profile
from gridcast.plans import ingest
from gridcast.plans.storage import scratch_path
from gridcast.sources import sinks, tables
from gridcast.sources.dict_lines import bad_lines, parse_lines, read_log, sensor_rows
from gridcast.spec import SeriesSpec
from tests.data import at, series

LINES = [
    "{'2024-01-01 00:00:07': [{'Temperature (Cabin 3 - Back - 24U)': 21.5}, {'Temperature (1)': 0.0}]}",
    "",
    "   ",
    "{}",
    "not a dict",
    "{'2024-01-01 00:00:09': [{'Temperature (Cabin 3 - Back - 24U)': None}, {'Temperature (cabin 3 - back - 24u)': '22.5'}]}",
    "{'2024-01-01 00:00:41': [{'Temperature (Cabin 3 - Back - 24U)': 20}, {'Temperature (Cabin 3 - Back - 24U)': None}]}",
    "{'yesterday': [{'Temperature (2)': 1}]}",
    '{"2024-01-01 00:00:50": [{"It\'s": True}]}',
]


def parsed(spark):
    return parse_lines(spark.createDataFrame([(x,) for x in LINES], "line string"))


def test_last_value_of_a_channel_wins(spark):
    rows = sensor_rows(parsed(spark), names.clean_probe_label).orderBy("ts", "channel").collect()
    assert [(r.ts, r.channel, r.value) for r in rows] == [
        (at(7), "temp_cabin3_back_24u_c", 21.5),
        (at(7), "temp_unused_channel", 0.0),
        (at(9), "temp_cabin3_back_24u_c", 22.5),
        (at(41), "temp_cabin3_back_24u_c", None),
        (at(50), "it_s", None),
    ]


WRITTEN = [  # values of a line, and the text they stand for
    ("'offset: +5, x'", "offset: +5, x"), ("'a, ]'", "a, ]"), ("'ratio: None, x'", "ratio: None, x"), ('"say \'x\', 1_0"', "say 'x', 1_0"),
    (r"'it\'s \x41\101\u0041\U0001F600 \q\\\n'", "it's AAA\U0001f600 \\q\\\n"), ("'a\tb'", "a\tb"), ("'{[('", "{[("), ("'\\\\'", "\\"), ("''", ""),
    ("None", None), ("True", "true"), ("+2.0", "2.0"), ("- 5", "-5"), (".5", "0.5"), ("-5.", "-5.0"), ("5.e3", "5000.0"), ("1_000", "1000"),
    ("0x1F", "31"), ("-0b101", "-5"), ("0o17", "15"), ("00", "0"), ("01.5", "1.5"), ("1" * 62, "1" * 62), ("0x1" + "0" * 16, "1.8446744073709552E19"),
]
NOT_WRITTEN = ["1 2", "012", "'x", "1__0", "1_", "[1", "x", "'a' 1", "0x", "+'a'"]


def test_values_as_written(spark):
    lines = [f"{{'2024-01-01 00:00:01': [{{'k: +1, None': {w}}}, ]}}" for w in [w for w, _ in WRITTEN] + NOT_WRITTEN]
    got = sensor_rows(parse_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")), lambda c: c, text="text")
    rows = {r.i: r for r in got.collect()}
    assert [(rows[i].channel, rows[i].text) for i in range(len(WRITTEN))] == [("k: +1, None", text) for _, text in WRITTEN]
    assert sorted(rows) == list(range(len(WRITTEN)))
    assert [rows[i].value for i, (w, _) in enumerate(WRITTEN) if w in ("+2.0", "- 5", "1_000", "0x1F")] == [2.0, -5.0, 1000.0, 31.0]


def test_a_line_with_thousands_of_escapes(spark):
    line = "{'2024-01-01 00:00:01': ({'k': '" + "\\'x" * 20_000 + "'},)}"
    (row,) = sensor_rows(parse_lines(spark.createDataFrame([(line,)], "line string")), lambda c: c, text="text").collect()
    assert row.text == "'x" * 20_000


def test_bad_lines_are_kept_apart_or_stop_the_job(spark):
    assert sorted(r.line for r in bad_lines(parsed(spark)).collect()) == [LINES[4], LINES[7]]
    with pytest.raises(Exception, match="bad sensor line"):
        sensor_rows(parsed(spark), names.clean_probe_label, "FAILFAST").collect()


@pytest.mark.parametrize("label,want", [
    ("Temperature (Cabin 3 - Back - 24U)", "temp_cabin3_back_24u_c"),
    ("  Temperature (Cabin  12-Front -2U) ", "temp_cabin12_front_2u_c"),
    ("Temperature (1)", "temp_unused_channel"),
    ("Temperature (2)", "temp_2_pos__u__c"),
    ("Outer Temperature / x", "outer_temp_x"),
])
def test_probe_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "s string")
    assert df.select(names.clean_probe_label(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("key,want", [
    ("airIRG2GroupStatusAirFlowMetric[L/s]", "airflow_lps"),
    ("airIRG2GroupStatusAirFlowUS[CFM]", "airflow_cfm"),
    ("airIRG2RDT2StatusEvaporatorFanSpeed[%]", "evap_fan_speed_pct"),
    ("group_status_cooloutput", "cool_output_kwh"),
    ("Door / Open", "door__per__open"),
])
def test_cooler_keys(spark, key, want):
    df = spark.createDataFrame([(key,)], "s string")
    assert df.select(names.clean_cooler_key(F.col("s"))).first()[0] == want


def test_channel_selection():
    assert clean.feature_columns(["x", "suction_c", "airflow_lps"]) == ["airflow_lps", "suction_c"]
    assert clean.feature_columns(["my_suction", "an_airflow", "x"]) == ["an_airflow", "my_suction"]
    assert clean.target_columns(["temp_cabin3_back_24u_c", "temp_cabin3_z", "x"]) == ["temp_cabin3_back_24u_c"]
    assert profile.probe_columns(["temp_cabin3_back_42u_c", "temp_cabin3_back_20u_c", "temp_c", "x_22u_c"], "CABIN3") == [
        "temp_cabin3_back_20u_c", "temp_cabin3_back_42u_c"]


def test_112_feature_names():
    base = [f"c{i}" for i in range(8)]
    got = features.feature_names(base)
    assert len(got) == 112 and got[8:12] == ["c0_lag1", "c0_lag3", "c0_lag6", "c0_lag12"]
    assert got[40:43] == ["c0_roll3_mean", "c0_roll3_std", "c0_roll3_delta"]
    assert len(features.feature_names(base[:4], (1, 3, 5, 10))) == 56


def test_dead_channels_per_entity(spark):
    rows = [("a", "x", 0.0), ("a", "x", None), ("b", "x", 1.0), ("b", "unused_1", 5.0)]
    df = spark.createDataFrame(rows, "k string, channel string, value double")
    assert [tuple(r) for r in clean.drop_dead_channels(df, ["k"]).collect()] == [("b", "x", 1.0)]


def test_duplicate_unit(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "airflow_cfm double, airflow_lps double")
    assert clean.drop_duplicate_unit(df).columns == ["airflow_lps"]
    assert clean.drop_duplicate_unit(df.drop("airflow_lps"), twin="airflow_lps").columns == ["airflow_cfm"]


def test_two_logs_to_one_table(spark):
    place = scratch_path(spark, "logs")
    cool = [(f"{{'2024-01-01 00:00:{s:02d}': [{{'airIRG2RDT2StatusSupplyAirTempMetric[C]': {s}}}, {{'airIRG2GroupStatusAirFlowUS[CFM]': 3}}]}}",) for s in (1, 11, 31)]
    probe = [(f"{{'2024-01-01 00:00:{s:02d}': [{{'Temperature (Cabin 3 - Back - 24U)': {t}}}]}}",) for s, t in ((2, 20.0), (13, 0.0), (32, 22.0))]
    spark.createDataFrame(cool, "l string").write.text(f"{place}/cool")
    spark.createDataFrame(probe, "l string").write.text(f"{place}/probe")
    spec = SeriesSpec((), "ts", step_s=10)
    target = "temp_cabin3_back_24u_c"
    out, feats, targets = ingest.merge_feeds(
        ingest.cooler_feed(read_log(spark, f"{place}/cool"), spec, ["supply_air_c"]),
        ingest.probe_feed(read_log(spark, f"{place}/probe"), spec, [target]),
        spec,
    )
    assert (feats, targets) == (["supply_air_c"], [target])
    rows = out.orderBy("ts").collect()
    # the zero is missing and filled; bin 20 has no target and drops out
    assert [(r.ts, r.supply_air_c, r[target]) for r in rows] == [(at(0), 1.0, 20.0), (at(10), 11.0, 20.0), (at(30), 31.0, 22.0)]
    assert sum(r[f"{target}_z"] for r in rows) == pytest.approx(0)


def test_csv_header_is_missing_data(spark):
    place = scratch_path(spark, "csv")
    spark.createDataFrame([("Height (U),Z (m),Z (m)",), ("20,0.979,0.979",), ("22,,1.0679",)], "l string").coalesce(1).write.text(place)
    rows = tables.read_numeric_csv(spark, place, ["u", "z", "z2"]).orderBy("u").collect()
    assert [tuple(r) for r in rows] == [(20.0, 0.979, 0.979), (22.0, None, 1.0679)]


def test_nan_is_read_as_missing(spark):
    place = scratch_path(spark, "nan")
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(place)
    df = tables.read_table(spark, place, ["v"])
    assert df.agg(F.avg("v"), F.count("v")).first() == (1.0, 1)
    with pytest.raises(KeyError):
        tables.read_table(spark, place, ["w"])


def test_cache_is_keyed_by_content(spark):
    place = scratch_path(spark, "cache")
    calls = []

    def score(df):
        calls.append(1)
        return df.withColumn("p", F.col("v") + 1)

    a, b = series(spark, [1, 2, 3]), series(spark, [1, 2, 4])
    for df in (a, a, b):
        got = sinks.cached_predictions(df, place, "test", "m", ["k", "ts", "v"], score)
    assert len(calls) == 2 and sorted(r.p for r in got.collect()) == [2.0, 3.0, 5.0]


def test_spec_row(spark):
    row = sinks.dataset_spec(spark, "10s", ["a"], ["b"]).first()
    assert row.target_cols_normalized == ["b_z"] and row.notes == []


def test_prediction_cache_is_found_though_means_vary(spark, monkeypatch):
    """Means of the same rows may differ in the last bit from one run to the next, as their sums are shuffled."""
    from random import random

    from registry import serve, views

    exact = views.racks
    noise = F.udf(lambda x: x if x is None else x * (1 + random() * 1e-12), "double").asNondeterministic()
    monkeypatch.setattr(views, "racks", lambda spark, sf: exact(spark, sf).withColumn("load", noise("load")))
    day = F.timestamp_seconds(F.lit(788_918_400) + F.col("id") * 10 * 86_400)
    numbers = [(F.col("id") % 13 + i).cast("double").alias(c) for i, c in enumerate(("l_extendedprice", "l_discount", "l_tax", "l_quantity"))]
    sf = scratch_path(spark, "tables")
    spark.range(200).select((F.col("id") % 2).alias("l_suppkey"), day.alias("l_shipdate"), *numbers).write.parquet(f"{sf}/lineitem.parquet")
    assert serve.prediction_cache(spark, sf).count() == serve.model_predictions(spark, sf).count() > 0
