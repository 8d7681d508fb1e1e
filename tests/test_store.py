"""The live store: late files, redone batches, flushes and metrics."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_live import line

from flowguard.operators.events import prepare_events
from flowguard.operators.parse import parse_filterlog
from flowguard.operators.windows import window_features
from flowguard.sources.logs import read_lines
from flowguard.streaming import store as S

BASE = datetime(2024, 3, 1, 12, 0, 0)
COLUMNS = ["window_id", "event_count", "bytes", "protocol", "destination_ip_sample", "common_destination_ports", "tcp_flags_summary", "blocked_count"]


def text(seed, seconds):
    rng = random.Random(seed)
    return [line(BASE + timedelta(seconds=s), f"10.0.0.{rng.randint(0, 3)}", f"8.8.8.{rng.randint(0, 2)}", rng.choice([53, 80, 443]), rng.choice(["pass", "block"]), rng.choice("SA"), rng.randint(40, 90)) for s in seconds]


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines))


def batch(spark, folder):
    events = prepare_events(parse_filterlog(read_lines(spark, str(folder)), default_year=2024, keep=("read_order",)), keep=("read_order",))
    return sorted(map(tuple, window_features(events, 30, sequence_col="read_order").select("window_id", "event_count", "bytes", "blocked_count").collect()))


def stored(spark, store):
    return sorted(map(tuple, S.read_windows(spark, store).select("window_id", "event_count", "bytes", "blocked_count").collect()))


@pytest.fixture
def setup(spark, tmp_path):
    store = S.LiveStore(str(tmp_path / "store"), 30)
    return tmp_path / "in", store, str(tmp_path / "mark")


def follow(spark, folder, store, mark):
    S.follow(spark, str(folder), store, mark, lambda w: w, default_year=2024, finite=True, files_per_trigger=1).awaitTermination()


def test_late_files_lose_nothing(spark, setup):
    folder, store, mark = setup
    land(folder, "a.log", text(1, range(200, 300)))
    follow(spark, folder, store, mark)
    first = S.read_windows(spark, store).count()
    assert 0 < first < len(batch(spark, folder))
    land(folder, "b.log", text(2, range(0, 260)) + ["", "not a filter line"])
    follow(spark, folder, store, mark)
    S.flush(spark, store, lambda w: w)
    assert stored(spark, store) == batch(spark, folder)
    rows = {r.version: r for r in S.ledger(spark, store).collect()}
    assert [rows[v].status for v in sorted(rows)] == ["ok", "ok", "flushed"] and rows[2].windows_revised > 0
    assert sum(r.windows_generated for r in rows.values()) == len(stored(spark, store)) and rows[3].windows_pending == 0
    assert [rows[v].lines_new for v in (0, 2)] == [100, 262] and rows[2].files_new == 1
    S.flush(spark, store, lambda w: w)
    assert S.ledger(spark, store).count() == 3
    land(folder, "c.log", text(3, range(290, 400)))
    follow(spark, folder, store, mark)
    S.flush(spark, store, lambda w: w)
    assert stored(spark, store) == batch(spark, folder)


@pytest.mark.parametrize("part", ["_commit", "_write_windows"])
def test_a_batch_that_stops_halfway_shows_once(spark, setup, monkeypatch, part):
    folder, store, mark = setup
    land(folder, "a.log", text(4, range(0, 200)))
    follow(spark, folder, store, mark)
    before = stored(spark, store)
    land(folder, "b.log", text(5, range(100, 350)))
    real = getattr(S, part)

    def stops(*args):
        if part == "_write_windows":
            real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(S, part, stops)
    with pytest.raises(Exception, match="lost"):
        follow(spark, folder, store, mark)
    assert stored(spark, store) == before
    assert [r.status for r in S.failures(spark, store).collect()] == ["error"]
    monkeypatch.setattr(S, part, real)
    follow(spark, folder, store, mark)
    S.flush(spark, store, lambda w: w)
    assert stored(spark, store) == batch(spark, folder)
    versions = S.read_versions(spark, store)
    assert versions.count() == versions.select("window_id", "version").distinct().count()
    assert S.failures(spark, store).count() == 0


def test_a_committed_batch_is_left_alone(spark, setup):
    folder, store, mark = setup
    land(folder, "a.log", text(6, range(0, 100)))
    follow(spark, folder, store, mark)
    write = S.write_batch(store, lambda w: w, default_year=2024)
    lines = spark.createDataFrame([("x", "p", BASE, 0)], "value string, source_path string, modified timestamp, block long")
    write(lines, 0)
    assert S.ledger(spark, store).count() == 1 and S.ledger(spark, store).first().lines_new == 100


def test_a_delay_keeps_windows_open(spark, setup):
    folder, store, mark = setup
    land(folder, "a.log", text(7, range(0, 300)))
    held = S.LiveStore(store.root, 30, 120)
    follow(spark, folder, held, mark)
    row = S.ledger(spark, held).first()
    newest = BASE + timedelta(seconds=270)
    assert row.newest == newest and S.read_windows(spark, held).agg(F.max("window_start")).first()[0] == newest - timedelta(seconds=150)
    assert row.windows_pending > 0 and row.windows_pending + row.windows_generated == len(batch(spark, folder))
