"""Tables in one row group: their lines are made and parsed by all tasks."""

from datetime import datetime, timedelta

import pytest

from flowguard.catalog import parsing, streams, tables

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
KINDS = ["view", "click", "purchase", "signup", "error"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 50, KINDS[i % 5], i / 7, f'{{"k": {i % 90}}}') for i in range(900)]
    rows += [(7, None, 1, "view", 1.0, '{"k": 1}'), (None, datetime(2024, 1, 2), 1, "view", 1.0, '{"k": 1}')] + rows[:20]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{place}/events.parquet")
    return place


def test_parsing_is_dealt_out(spark, folder):
    for query in (parsing.events_prepared, parsing.parse_ipv6):
        found = query(spark, folder)
        assert found.rdd.getNumPartitions() >= 4
    read = tables.fw_of(tables.table(spark, folder, "events"))
    assert sorted(map(str, tables.lines(spark, folder).select("event_id").collect())) == sorted(map(str, read.select("event_id").collect()))


def test_a_filter_on_lines_stays_above_the_exchange(spark, folder):
    frame = tables.lines(spark, folder).where("value <> ''")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "filterlog[" in plan and "filterlog[" not in below


def test_landed_files_are_made_by_all_tasks(spark, folder):
    context = spark.sparkContext
    context.setJobGroup("landing", "landing")
    landed, _, _ = streams._landed(spark, folder)
    context.setJobGroup("", "")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("landing") for s in tracker.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) >= 4
    files = spark.read.text(landed).selectExpr("_metadata.file_path AS file", "value")
    assert files.select("file").distinct().count() == 3
    # rows without an id belong to no third
    wanted = tables.lines(spark, folder).where("value IS NOT NULL AND event_id IS NOT NULL").select("value")
    assert sorted(r.value for r in files.collect()) == sorted(r.value for r in wanted.collect())
