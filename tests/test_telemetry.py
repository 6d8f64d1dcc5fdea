from datetime import datetime

import pytest

from plumbline.operators import telemetry as op
from plumbline.schemas import EVENTS, RATE_CARD

START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)
INSIDE = datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def events(spark):
    def build(*items):
        rows = [(str(i), kind, slug, "", "1.0", ts, ts, payload) for i, (kind, payload, ts, slug) in
                enumerate((*item, *(INSIDE, "p")[len(item) - 2:]) for item in items)]
        return spark.createDataFrame(rows, EVENTS)

    return build


def test_ci_passes_only_on_explicit_true(events, rows):
    df = events(("ci.run", '{"tests_passed": true}'), ("ci.run", '{"tests_passed": "true"}'), ("ci.run", "{}"),
                ("ci.run", '{"tests_passed": null}'), ("ci.run", '{"tests_passed": false}'), ("tool.executed", '{"tests_passed": true}'))
    assert rows(op.ci_stats(df)) == [(5, 2, 3)]


@pytest.mark.parametrize("passed, total, even, up", [(1, 8, 12, 13), (3, 8, 38, 38), (0, 0, None, None), (5, 5, 100, 100)])
def test_pass_rate_rounding(spark, rows, passed, total, even, up):
    stats = spark.createDataFrame([(total, passed, total - passed)], "total bigint, passed bigint, failed bigint")
    assert rows(op.ci_pass_rate(stats.select("total", "passed", "failed"))) == [(total, passed, total - passed, even, up)]


def test_blank_keys_are_relabelled_after_grouping(events):
    df = events(*[("skill.invoked", p) for p in ('{"skill_name": ""}', "{}", "{}", '{"skill_name": "unknown"}', '{"skill_name": "a"}')])
    assert sorted(tuple(r) for r in op.top_skills(df).collect()) == [("a", 1), ("unknown", 1), ("unknown", 1), ("unknown", 2)]


def test_total_cost_covers_listed_models_only(events, rows):
    calls = [("skill.invoked", f'{{"model": "m{i:02d}", "estimated_cost_usd": 1.5}}') for i in range(12)]
    assert rows(op.total_cost(events(*calls))) == [(15.0, 18.0)]


def test_cost_that_is_no_number_keeps_the_row(events, rows):
    df = events(("skill.invoked", '{"model": "m", "estimated_cost_usd": "abc"}'), ("skill.invoked", '{"model": "m", "estimated_cost_usd": 2}'))
    assert rows(op.top_models(df)) == [("m", 2, 2.0)]


def test_window_bounds_are_included(events, rows):
    df = events(("ci.run", "{}", START), ("ci.run", "{}", END), ("ci.run", "{}", datetime(2024, 1, 25, 0, 0, 1)))
    assert rows(op.events_total(op.events_filter(df, start=START, end=END, event_type="", project_slug=None))) == [(2,)]


def test_rollup_cost_is_null_where_no_cost_belongs(events, rows):
    cost = '{"estimated_cost_usd": 3}'
    rollup = op.daily_rollup(events(("ci.run", cost), ("ci.run", cost), ("skill.invoked", cost)))
    assert [(r[1], r[3], r[4]) for r in rows(rollup)] == [("ci.run", 2, None), ("skill.invoked", 1, 3)]


def test_summary_without_events(events):
    row = op.summary(events(("ci.run", "{}", datetime(2020, 1, 1))), start=START, end=END).first().asDict(recursive=True)
    assert row["ci_runs"] == {"total": 0, "passed": 0, "failed": 0}
    assert row["top_skills"] == [] and row["top_models"] == [] and row["total_cost_usd"] == 0.0


def test_summary_of_one_project(events):
    df = events(("skill.invoked", '{"skill_name": "s", "model": "m", "estimated_cost_usd": 1}', INSIDE, "a"),
                ("skill.invoked", '{"skill_name": "s"}', INSIDE, "a"), ("skill.invoked", "{}", INSIDE, "b"))
    row = op.summary(df, start=START, end=END, project_slug="a").first().asDict(recursive=True)
    assert row["skills_invoked"] == 2 and row["top_skills"] == [{"skill_name": "s", "count": 2}]
    assert row["top_models"] == [{"model": "unknown", "count": 1, "total_cost_usd": 0.0}, {"model": "m", "count": 1, "total_cost_usd": 1.0}]


def test_known_costs(spark, rows):
    card = spark.createDataFrame([("a", "x", 3.0, 15.0)], RATE_CARD)
    usage = spark.createDataFrame([("a", 1_000_000, 1_000_000), ("a", 1000, 500), ("b", 1, 1)], "model string, input_tokens bigint, output_tokens bigint")
    assert [r[3] for r in rows(op.estimate_cost(usage, card))] == [0.0105, 18.0, None]


@pytest.mark.parametrize("limit, offset", [(0, 0), (1001, 0), (1, -1)])
def test_page_bounds(limit, offset):
    with pytest.raises(ValueError):
        op.page_bounds(limit, offset)


def test_default_window():
    now = datetime(2024, 3, 31, 12)
    assert op.default_window(now) == (datetime(2024, 3, 1, 12), now)
    assert op.whole_days("2024-01-01", "2024-01-02")[1] == datetime(2024, 1, 2, 23, 59, 59)
