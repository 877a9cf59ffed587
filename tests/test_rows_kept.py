"""No operator loses rows silently."""

import pytest
from pyspark.sql import functions as F

from gridcast.operators import audit, evaluate, models
from gridcast.sources.dict_lines import bad_lines, parse_lines, sensor_rows


@pytest.fixture(scope="module")
def forest(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i) for i in range(40)], "a double, b double, y double")
    fitted = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows)
    model = RandomForestRegressor(featuresCol="x", labelCol="y", predictionCol="p_t", numTrees=3, seed=1).fit(fitted)
    model.setFeaturesCol(models._X)
    return models.Forest({"t": model}, ["a", "b"], ["t"], {}, {}, 1, None)


def test_predict_keeps_rows_with_missing_features(spark, forest):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, None), (float("nan"), 1.0)], "a double, b double")
    got = models.predict(forest, rows).collect()
    assert len(got) == 4
    assert [r["p_t"] is None for r in sorted(got, key=lambda r: str(r["a"]) + str(r["b"]))].count(True) == 3
    with pytest.raises(ValueError):
        models.sample_check(forest, rows)
    models.sample_check(forest, rows.limit(1))


def test_horizon_without_a_first_step(spark):
    rows = [("s1", "t", 0, 1.0, 2.0), ("s1", "t", 1, 1.0, 2.0), ("s2", "t", 1, 1.0, 6.0)]
    table = spark.createDataFrame(rows, "scenario_id string, target string, step int, y_true double, y_pred double")
    got = evaluate.horizon_metrics(table, (2,)).first()
    assert got["mae"] == pytest.approx(7 / 3) and got["drift"] == pytest.approx(1.0)


def test_target_without_coefficients_is_an_error(spark):
    thermal = {"t": audit.Thermal(100.0, 0.05, -0.03, 0.01)}
    rows = spark.createDataFrame([("t", 1.0, 2.0, 1.0, 1.0, 1.0), ("u", 1.0, 2.0, 1.0, 1.0, 1.0)], "target string, y_now double, y_pred double, s double, f double, l double")
    assert audit.physics_residual(rows.where("target = 't'"), thermal, "s", "f", "l").count() == 2
    with pytest.raises(Exception, match="no coefficients for target: u"):
        audit.physics_residual(rows, thermal, "s", "f", "l").collect()


def test_number_spellings(spark):
    items = "{'a': .5}, {'b': 5.}, {'c': +2.0}, {'d': 1_000}, {'e_1_2': -.25}, {'f': 1_0.5}, {'g': None}, {'h': '7'}, {'i': -3.},"
    line = "{'2024-01-01 00:00:00': [" + items + "]}"
    parsed = parse_lines(spark.createDataFrame([(line,), ("{broken",)], "line string"))
    got = {r["channel"]: r["value"] for r in sensor_rows(parsed, lambda c: c).collect()}
    assert got == {"a": 0.5, "b": 5.0, "c": 2.0, "d": 1000.0, "e_1_2": -0.25, "f": 10.5, "g": None, "h": 7.0, "i": -3.0}
    assert [r["line"] for r in bad_lines(parsed).select(F.col("line")).collect()] == ["{broken"]
