"""Queries that answer for every entity, session and feature, against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from hindcast.plans.tables import Panel
from hindcast.schema import FEATURES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    return Panel(spark, TABLES)


def both(spark, name):
    """Rows of a query, found equal to its SQL's."""
    con = duckdb.connect()
    for path in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    made = entry.queries()[name](spark, TABLES)
    rows = made.collect()
    told = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=key) == sorted(told.fetchall(), key=key)
    assert made.columns == columns
    return rows


def test_nearest_date_has_all_entities_and_dates(spark, whole):
    rows = both(spark, "nearest_date_join")
    assert {(r.entity, r.d) for r in rows} == {(r.entity, str(r.event_date)) for r in whole.entity_events.collect()}
    assert len({r.nearest[-2:] for r in rows if r.nearest}) > 20


def test_unconditional_band_answers_every_session(spark, whole):
    seen = {}
    for r in whole.grid.filter("a is not null").select("entity", "session_idx").collect():
        seen.setdefault(r.entity, set()).add(r.session_idx)
    rows = both(spark, "unconditional_band")
    for name, own in seen.items():
        answered = {r.q for r in rows if r.entity == name}
        assert not answered or answered == {q for q in own if q >= min(answered)}
    assert len({r.q % 60 for r in rows}) == 60


def test_path_fan_follows_the_chosen(spark, whole):
    from hindcast.plans.queries import chosen

    rows, most = both(spark, "path_fan"), chosen(whole).count()
    assert {r.t for r in rows} == {1, 2, 3, 4, 5} and all(r.n <= most for r in rows)


def test_statistics_have_all_features(spark):
    assert {r.feature for r in both(spark, "expanding_stats")} == set(FEATURES)


def test_every_feature_is_in_a_query(spark):
    rows = both(spark, "macro_levels")
    assert all(any(r[f] is not None for r in rows) for f in ("vix", "slope", "d_rate90", "bei_chg20", "hy_chg20", "fng"))


def test_scores_of_real_bands(spark):
    rows = {r.entity: r for r in both(spark, "unconditional_by_symbol")}
    assert rows and all(0 <= r.coverage <= 1 and r.n >= 10 for r in rows.values())
    assert {r.entity for r in both(spark, "unconditional_direction")} >= set(rows)


def test_groups_of_the_chosen_add_up(spark):
    sums = {}
    for r in both(spark, "chosen_groups"):
        sums[r.kind] = sums.get(r.kind, 0) + r.n
    assert len(set(sums.values())) <= 1


def test_queries_share_a_panel_until_a_file_changes(spark, tmp_path):
    import shutil

    for name in ("lineitem", "part", "orders", "events"):
        shutil.copy(f"{TABLES}/{name}.parquet", tmp_path)
    one = Panel.of(spark, str(tmp_path))
    assert Panel.of(spark, str(tmp_path)) is one and Panel.of(spark, str(tmp_path), "day") is not one
    made = one.once("sessions", lambda p: p.calendar)
    assert one.once("sessions", lambda p: None) is made
    shutil.copy(f"{TABLES}/part.parquet", tmp_path / "orders.parquet")
    assert Panel.of(spark, str(tmp_path)) is not one
