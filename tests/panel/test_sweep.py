"""Scenarios, predictors, order statistics and venue queries."""

import math
from datetime import date

import pytest

from hindcast.operators import distribution, stress, validation
from hindcast.operators.stress import Scenario

from test_whole import both


@pytest.fixture
def calendar(spark):
    days = [date(2020, 1, 6 + i) for i in range(20)] + [date(2020, 2, 3 + i) for i in range(20)] + [date(2020, 3, 2 + i) for i in range(30)]
    return spark.createDataFrame(list(enumerate(days)), "session_idx int, session_date date")


def test_windows_clamp_ignore_and_skip(spark, calendar):
    listed = [
        Scenario("plain", "base"),
        Scenario("inside", "window", "2020-03-25", "2020-03-27"),
        Scenario("unmet", "window", "2031-01-01", "2032-01-01"),
        Scenario("late", "window", "2020-03-01", "2020-03-31"),
    ]
    rows = {r.scenario: r for r in stress.scenario_spans(calendar, 69, 5, listed).collect()}
    assert (rows["plain"].j_low, rows["plain"].j_high, rows["plain"].skipped) == (60, 64, False)
    assert (rows["inside"].j_low, rows["inside"].j_high, rows["inside"].skipped) == (63, 64, True)  # its end is session 65
    assert (rows["unmet"].j_low, rows["unmet"].j_high, rows["unmet"].skipped) == (60, 64, False)
    assert rows["late"].skipped
    moved = stress.scenario_spans(calendar, 69, 5, [Scenario("far", "window", "2031-01-07", "2031-01-08")], years_back=11).collect()[0]
    assert (moved.j_low, moved.j_high) == (60, 2)


def test_shocks_replace_shift_and_clip(spark, calendar):
    listed = [Scenario("plain", "base"), Scenario("moved", "shock", z={"a": 2.0, "gone": 1.0}, raw={"b": 9.0})]
    z = spark.createDataFrame([("a", 2.5), ("b", 0.5), ("c", -1.0)], "feature string, z float")
    stats = spark.createDataFrame([(f, 1.0, 4.0) for f in ("a", "b", "c", "gone", "never")], "feature string, mu double, sd double")
    made = stress.scenario_queries(z, stats, stress.scenario_spans(calendar, 69, 5, listed), listed).collect()
    found = {(r.query_id, r.feature): r.z for r in made}
    assert found == {(0, "a"): 2.5, (0, "b"): 0.5, (0, "c"): -1.0, (1, "a"): 3.0, (1, "b"): 2.0, (1, "c"): -1.0, (1, "gone"): 1.0}
    assert {(r.j_low, r.j_high) for r in made} == {(60, 64)}


def test_report_has_every_scenario(spark, calendar):
    listed = [Scenario("plain", "base"), Scenario("other", "shock"), Scenario("none", "shock")]
    states = spark.createDataFrame([(0, 0.1, -0.2), (0, 0.3, -0.4), (1, 0.5, -0.5), (1, None, None)], "query_id long, fwd double, mae double")
    rows = {r.scenario: r for r in stress.scenario_report(stress.scenario_spans(calendar, 69, 5, listed), states, "fwd").collect()}
    assert (rows["other"].n, rows["other"].median, rows["other"].d_median, rows["other"].d_mae_median) == (1, 0.5, 0.3, -0.2)
    assert (rows["none"].n, rows["none"].median, rows["none"].d_median) == (0, None, None)


@pytest.mark.parametrize("n", [1, 2, 9, 50])
def test_conformal_scale_by_rank(spark, n):
    scores = [((i * 37) % 11) / 7 for i in range(n)]  # with ties
    row = distribution.conformal_scale(spark.createDataFrame([("x", s) for s in scores] + [("x", None)], "k string, s double"), ["k"], "s").first()
    level = min(1.0, math.ceil((n + 1) * 0.8) / n)
    ordered, at = sorted(scores), (n - 1) * level
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    assert row.n == n and row.scale == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_frozen_scores_use_calibration_alone(spark):
    rows = [("calibration", "p", 0.0, 1.0, float(y)) for y in range(1, 11)] + [("test", "p", 0.0, 1.0, 8.0), ("test", "p", 0.0, 1.0, 99.0), ("test", "p", 0.0, 0.0, 1.0), ("test", "analog_raw", 0.0, 2.0, 1.0)]
    found = {r.predictor: r for r in validation.frozen_scores(spark.createDataFrame(rows, "era string, predictor string, centre double, half double, y double")).collect()}
    assert (found["p"].n, found["p"].coverage) == (2, 0.5) and found["p"].scale == pytest.approx(9.1)  # ceil(8.8) / 10 of ten scores
    assert (found["analog_raw"].scale, found["analog_raw"].coverage, found["analog_raw"].width) == (1.0, 1.0, 4.0)
    empty = validation.frozen_scores(spark.createDataFrame([], "era string, predictor string, centre double, half double, y double"))
    assert empty.collect() == []


@pytest.mark.parametrize("name", ["scenario_deltas", "predictor_rows", "composed_blocks"])
def test_sweep_equals_its_sql(spark, name):
    assert both(spark, name) or name == "composed_blocks"  # the smallest tables have no overnight blocks


@pytest.mark.parametrize("name", ["cross_venue", "venue_priority", "venue_sets", "last_event", "session_on_or_before", "unsupported_numerals"])
def test_venues_equal_their_sql(spark, name):
    rows = both(spark, name)
    if name == "venue_sets":
        assert {r.coverage for r in rows} >= {"both", "uncovered"}
