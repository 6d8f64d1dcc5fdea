import json
from datetime import date, datetime

import pytest

from plumbline.operators.telemetry import daily_rollup, events_filter, top_models
from plumbline.streaming import alerts, ingest


def event(**changes):
    base = {"event_type": "ci.run", "project_slug": "p", "timestamp": "2024-01-10T10:00:00Z", "payload": {"tests_passed": True}}
    return json.dumps({k: v for k, v in {**base, **changes}.items() if v is not None})


@pytest.mark.parametrize("text, reason", [
    (event(), None),
    (event(event_type="unknown.type"), "unknown_event_type"),
    (event(timestamp=None), "missing_field"),
    (event(payload=None), "missing_field"),
    (event(event_type="unknown.type", project_slug=None), "missing_field"),
    (event(timestamp="yesterday-ish"), "invalid_field"),
    (event(payload=[1]), "invalid_field"),
    ("{broken", "malformed_json"),
    ("", "malformed_json"),
])
def test_reasons(spark, text, reason):
    assert ingest.validate(spark.createDataFrame([(text,)], "value string")).first()["reason"] == reason


def test_defaults_and_zone(spark):
    row = ingest.enrich(ingest.validate(spark.createDataFrame([(event(timestamp="2024-01-10T10:00:00+02:00"),)], "value string"))).first()
    assert row["github_username"] == "" and row["schema_version"] == "1.0"
    assert row["event_ts"] == datetime(2024, 1, 10, 8) and row["id"] and json.loads(row["payload"]) == {"tests_passed": True}


def _post(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def _stream(spark, folder):
    return spark.readStream.schema("value string").text(str(folder))


def _plain(df):
    return sorted((r["project_slug"], r["event_type"], str(r["day"]), r["event_count"], r["daily_cost_usd"]) for r in df.collect())


def test_late_file_changes_its_own_day(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    paid = {"estimated_cost_usd": 0.1}
    _post(inbox, "1.json", event(), event(event_type="skill.invoked", payload=paid), event(event_type="nope"), "{broken")
    ingest.start_ingest(_stream(spark, inbox), store).awaitTermination()
    _post(inbox, "2.json", event(timestamp="2023-12-20T00:00:00Z"), event(event_type="skill.invoked", payload=paid))
    ingest.start_ingest(_stream(spark, inbox), store).awaitTermination()
    stored = ingest.read_events(spark, store)
    assert stored.count() == 4 and stored.where("event_date = DATE '2023-12-20'").count() == 1
    assert sorted(r["reason"] for r in ingest.read_dead(spark, store).collect()) == ["malformed_json", "unknown_event_type"]
    assert _plain(ingest.read_rollup(spark, store)) == _plain(daily_rollup(stored))

    # A report over the store leaves out other days and reads single parsed fields, not the JSON.
    inside = events_filter(stored, start=datetime(2024, 1, 1), end=datetime(2024, 1, 31))
    plan = top_models(inside)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "payload" not in plan and [tuple(r) for r in top_models(inside).collect()] == [("unknown", 2, 0.2)]

    before = _plain(ingest.read_rollup(spark, store))
    assert ingest.compact(spark, store) == 1 == ingest.compact(spark, store)
    assert _plain(ingest.read_rollup(spark, store)) == before and ingest.read_events(spark, store).count() == 4


def test_a_day_is_read_from_its_live_parts_alone(spark, tmp_path):
    store = str(tmp_path / "store")
    days = [f"2024-01-{d:02d}T10:00:00Z" for d in range(1, 6)]
    batch = lambda n: spark.createDataFrame([(event(timestamp=t, project_slug=f"p{n}"),) for t in days + days[:n]], "value string")

    def opened(**period):
        return {f.split("/part=")[0][-10:] + "/" + f.split("/part=")[1].split("/")[0] for f in ingest.read_events(spark, store, **period).inputFiles()}

    for n in range(7):
        ingest.store_batch(batch(n % 4), n, store, compact_every=3)
    day = {"start": date(2024, 1, 2), "end": date(2024, 1, 2)}
    assert opened(**day) == {"2024-01-02/c5", "2024-01-02/b6"} and len(opened()) == 10
    before, rollup = ingest.read_events(spark, store), _plain(ingest.read_rollup(spark, store))
    count = sum(len(days) + n % 4 for n in range(7))
    assert before.count() == count and rollup == _plain(daily_rollup(before))
    for n in (5, 6, 0):  # folded in already, last, folded in already
        ingest.store_batch(batch(n % 4), n, store, compact_every=3)
    before = ingest.read_events(spark, store)
    assert before.count() == count and _plain(ingest.read_rollup(spark, store)) == rollup
    assert ingest.compact(spark, store) == 6 and opened(**day) == {"2024-01-02/c6"}
    assert before.count() == count == ingest.read_events(spark, store).count() and _plain(ingest.read_rollup(spark, store)) == rollup
    assert ingest.read_events(spark, store, start=date(2025, 1, 1)).count() == 0


def test_a_store_without_accepted_events(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.store_batch(spark.createDataFrame([("{broken",)], "value string"), 0, store)
    assert ingest.read_events(spark, store).count() == ingest.read_rollup(spark, store).count() == 0 and ingest.read_dead(spark, store).count() == 1
    ingest.compact(spark, store)
    assert ingest.read_events(spark, store).count() == 0


def test_replayed_batch_counts_once(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = spark.createDataFrame([(event(),), (event(),)], "value string")
    ingest.store_batch(batch, 0, store)
    ingest.store_batch(batch, 0, store)
    assert ingest.read_events(spark, store).count() == 2
    assert [r["event_count"] for r in ingest.read_rollup(spark, store).collect()] == [2]


def test_budget_alerts_fire_once(spark, tmp_path):
    store, inbox = str(tmp_path / "store"), tmp_path / "in"
    schema = "org string, ts timestamp_ntz, cost_usd decimal(18,6)"

    def spend(*amounts):
        rows = [("o", datetime(2024, 1, 3), a) for a in amounts]
        spark.createDataFrame(rows, "org string, ts timestamp_ntz, cost double").selectExpr("org", "ts", "CAST(cost AS DECIMAL(18,6)) AS cost_usd").coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        alerts.start_budget_alerts(stream, store, monthly_budget_usd=100.0).awaitTermination()

    spend(50.0)
    spend(35.0)
    spend(5.0)
    spend(20.0)
    found = lambda: sorted((r["org"], r["threshold"], r["spend_usd"], r["month"]) for r in alerts.read_budget_alerts(spark, store).collect())
    crossed = [("o", 0.8, 85.0, date(2024, 1, 1)), ("o", 1.0, 110.0, date(2024, 1, 1))]
    assert found() == crossed
    # The last batch is run again, as after a crash before it was marked as done.
    commits = sorted((tmp_path / "store" / "_progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    alerts.start_budget_alerts(spark.readStream.schema(schema).parquet(str(inbox)), store, monthly_budget_usd=100.0).awaitTermination()
    assert found() == crossed
    spend(-60.0)
    spend(45.0)  # crossed again
    assert found() == sorted([*crossed, ("o", 0.8, 95.0, date(2024, 1, 1))])


def test_degraded_tools_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    rows = [("s", "t", datetime(2024, 1, 1, 0, i), i % 2 == 0) for i in range(10)] + [("s", "t", datetime(2024, 1, 1, 1, 0), False)]
    rows.append(("s", "t", datetime(2024, 1, 2), False))
    schema = "server string, tool string, ts timestamp, error boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(inbox))
    stream = alerts.degraded_tools(spark.readStream.schema(schema).parquet(str(inbox)), window="1 hour", lateness="10 minutes", threshold=0.4)
    query = stream.writeStream.format("memory").queryName("degraded").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["calls"], r["errors"]) for r in spark.table("degraded").collect()] == [(10, 5)]
