"""Panel operators on hand-made rows with values computed by hand."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from hindcast.functions import scalar
from hindcast.operators import closed, distribution, panel, retrieval, sentiment, validation
from hindcast.sources import readers
from hindcast.streaming import candles as streaming

D = dt.date


def calendar(spark, dates):
    return spark.createDataFrame(list(enumerate(dates)), "session_idx int, session_date date")


def test_asof_carries_forward_and_in(spark):
    days = calendar(spark, [D(2024, 1, i) for i in (2, 3, 4, 5, 8)])
    series = spark.createDataFrame([("s", D(2023, 12, 29), 1.0), ("s", D(2024, 1, 4), 2.0), ("t", D(2024, 1, 5), 9.0)], "series_id string, obs_date date, value double")
    got = {(r.series_id, r.session_idx): r.value for r in panel.asof(days, series).collect() if r.value is not None}
    assert got == {("s", 0): 1, ("s", 1): 1, ("s", 2): 2, ("s", 3): 2, ("s", 4): 2, ("t", 3): 9, ("t", 4): 9}


def test_date_clusters_compare_with_the_last_kept(spark):
    rows = spark.createDataFrame([("e", D(2024, 1, i)) for i in (1, 6, 7, 8, 14)] + [("e", D(2024, 1, 1)), ("f", None)], "entity string, d date")
    got = sorted(r.d.day for r in panel.date_clusters(rows, 6).filter("entity = 'e' and d is not null").distinct().collect())
    assert got == [1, 8]


def test_quantiles_interpolate(spark):
    rows = spark.createDataFrame([("k", x) for x in (1.0, 2.0, 4.0, 10.0, None)], "k string, x double")
    row = distribution.summarize(rows, ["k"], "x").first()
    assert (row.n, round(row.p10, 9), row.p50, round(row.p90, 9)) == (4, 1.3, 3.0, 8.2)


def test_greedy_keeps_apart(spark):
    pool = [(1, "a", 100), (1, "a", 105), (1, "b", 100), (1, "c", 100), (1, "a", 110), (1, "d", 7)]
    rows = spark.createDataFrame([(q, e, j, 0.5, i + 1) for i, (q, e, j) in enumerate(pool)], "query_id long, entity string, session_idx int, dist double, rn int")
    got = [(r.entity, r.session_idx) for r in retrieval.greedy(rows, 4).orderBy("rn").collect()]
    assert got == [("a", 100), ("b", 100), ("a", 110), ("d", 7)]


def test_breach_is_strict(spark):
    rows = spark.createDataFrame([("k", -0.10), ("k", -0.11), ("k", None)], "k string, mae double")
    row = distribution.breach_shares(rows, ["k"], "mae").first()
    assert (row.n, row.breach_10, row.breach_05) == (2, 0.5, 1.0)


@pytest.mark.parametrize("hours, kinds", [(11, []), (12, ["overnight"]), (47, ["overnight"]), (48, ["weekend"])])
def test_closed_blocks_thresholds(spark, hours, kinds):
    friday = dt.datetime(2024, 1, 5, 20)  # the last open hour of a week
    rows = [("x", friday + dt.timedelta(hours=i), 100.0 + i, 101.0 + i, 99.0 + i, 1.0) for i in range(hours + 1)]
    rows += [("x", rows[-1][1] + dt.timedelta(hours=3), 50.0, 50.0, 50.0, 1.0)]  # behind a gap: in no block
    hourly = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, c double, hi double, lo double, qv double")
    got = closed.closed_blocks(hourly).collect()
    assert [(r.kind, r.hours, r.exit) for r in got] == [(k, hours, 100.0 + hours) for k in kinds]


def test_auc_with_ties_and_one_outcome(spark):
    rows = spark.createDataFrame([("k", 0.1, 0), ("k", 0.5, 0), ("k", 0.5, 1), ("k", 0.9, 1), ("one", 0.3, 1)], "k string, p double, y int")
    got = {r.k: r.auc for r in validation.auc(rows, ["k"], "p", "y").collect()}
    assert got == {"k": 0.875, "one": None}


def test_snap_horizon_has_both_tie_rules(spark):
    row = spark.createDataFrame([(15.0, 100.0, None)], "x double, y double, z double").select(
        scalar.snap_horizon(F.col("x"), True).alias("a"), scalar.snap_horizon(F.col("x"), False).alias("b"), scalar.snap_horizon(F.col("y"), True).alias("c"), scalar.snap_horizon(F.col("z"), True).alias("d")
    ).first()
    assert tuple(row) == (20, 10, 60, 5)


def test_headlines_without_time_come_last(spark):
    rows = spark.createDataFrame([(1, "Rates up!", None), (2, "rates  UP", dt.datetime(2024, 1, 2)), (3, "Oil", dt.datetime(2024, 1, 1))], "pos int, title string, published_at timestamp_ntz")
    assert [(r.pos, r["rank"]) for r in sentiment.rank_headlines(rows, 5).orderBy("rank").collect()] == [(3, 1), (1, 2)]


def test_latest_percentile_evaluates_a_series_once(spark):
    """Sums in another order differ in their last bits: a value that each evaluation makes anew stands for them."""
    noise = F.udf(lambda x: x + random.random() * 1e-6 if x is not None else None, "double").asNondeterministic()
    rows = [(f"s{i}", D(2020, 1, 1 + j), float(j)) for i in range(40) for j in range(3)] + [("gap", D(2020, 1, 1), 1.0), ("gap", D(2020, 1, 2), 2.0), ("gap", D(2020, 1, 3), None), ("none", D(2020, 1, 1), None)]
    series = spark.createDataFrame(rows, "series_id string, obs_date date, value double").repartition(3).withColumn("value", noise("value"))
    for rows in (1250, None):
        found = {r.series_id: r.percentile for r in sentiment.latest_percentile(series, rows).collect()}
        assert found == {f"s{i}": 100.0 for i in range(40)} | {"gap": 50.0, "none": 0.0}
    long = spark.range(1300).selectExpr("'s' series_id", "date_add(date'2000-01-01', cast(id as int)) obs_date", "cast(1300 - id as double) + if(id = 1299, 1200, 0) value")
    assert sentiment.latest_percentile(long, None).first().percentile == 100 * 1199 / 1299



def test_readers(spark, tmp_path):
    good = {"entity": "e", "session_date": "2024-01-02", "o": 1, "h": 2, "l": 1, "c": 2, "a": 2, "v": None}
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in (good, good | {"a": None})))
    assert readers.read_prices(spark, f"file://{tmp_path}/p.json").count() == 1
    (tmp_path / "s.csv").write_text("DATE,X\n2024-01-02,4.5\n2024-01-03,.\n2024-01-04,\nbad,1\n")
    assert [tuple(r) for r in readers.read_series(spark, f"file://{tmp_path}/s.csv", "x").collect()] == [("x", D(2024, 1, 2), 4.5)]
    pages = spark.createDataFrame([(1, "monetary20240131 monetary20240203 monetary20241399"), (2, None)], "page_id int, html string")
    assert [r.event_date for r in readers.weekday_dates(pages).collect()] == [D(2024, 1, 31)]
    one, two = (spark.createDataFrame(rows, "k string, d int") for rows in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert sorted(tuple(r) for r in readers.first_source(one, two, "k").collect()) == [("a", 1), ("b", 3)]


def test_streamed_candles_equal_batch_ones(spark, tmp_path):
    start = dt.datetime(2024, 1, 2, 13)
    rows = [("x", start + dt.timedelta(minutes=7 * i), i, float(i % 5)) for i in range(60)]
    ticks = spark.createDataFrame(rows, "instrument string, at timestamp, seq int, value double")
    ticks.write.parquet(f"{tmp_path}/ticks")
    stream = streaming.hourly_candles(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("candles_test").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    columns = ["instrument", "ts", "c", "hi", "lo", "qv"]
    batch = closed.candles(ticks).select(*columns)
    assert sorted(map(tuple, spark.table("candles_test").select(*columns).collect())) == sorted(map(tuple, batch.collect()))


def test_nearest_vectors_equal_all_pairs(spark):
    import random

    rng = random.Random(12)
    rows = [(i, [rng.choice([0.0, 1.0, rng.random()]) for _ in range(3)]) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)]  # equal vectors: ties go to the smaller id
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.nearest_vectors(df, df.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id"), 4).collect()}
    vectors = {r.vec_id: r.v for r in df.collect()}
    for q in range(0, 70, 7):
        order = sorted((sum((a - b) ** 2 for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        assert [got[q, rank] for rank in (1, 2, 3, 4)] == [i for _, i in order[:4]]
    assert retrieval.nearest_vectors(df, df.filter("false").withColumnRenamed("vec_id", "query_id"), 4).count() == 0
