import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.operators.events import prepare_events
from flowguard.operators.forest import ForestConfig
from flowguard.operators.parse import parse_filterlog
from flowguard.operators.reports import live_records, row_reports, scenario_summary
from flowguard.operators.windows import window_features
from flowguard.plans.batch import analyse_lines, fit_models, score_records, score_windows
from flowguard.sources import sinks
from flowguard.sources.logs import read_lines
from flowguard.streaming.live import replay, run_metrics, split_closed, start_live

BASE = datetime(2024, 3, 1, 12, 0, 0)


def line(at, source, target, port, action="block", flag="S", size=44, proto="tcp"):
    number = {"tcp": 6, "udp": 17}[proto]
    tail = f"{proto},{size},{source},{target},40000,{port},0"
    tail += f",{flag},1,,1024,," if proto == "tcp" else ""
    return f"{at:%b %d %H:%M:%S} fw01 filterlog[9]: 5,,,1,em0,match,{action},in,4,0x0,,64,0,0,none,{number},{tail}"


def scenario(name):
    rng = random.Random(name)
    at = lambda i: BASE + timedelta(seconds=i)
    if name == "port_scan":
        return [line(at(i // 60), "10.0.0.66", "192.168.1.1", 1000 + i, size=60) for i in range(200)]
    if name == "brute_force":
        return [line(at(i // 4), "10.0.0.77", "192.168.1.9", 22, flag="PA", size=90) for i in range(16)]
    if name == "syn_flood":
        return [line(at(i // 30), "10.0.0.88", "192.168.1.2", 80, size=44) for i in range(90)]
    return [
        line(at(i), f"10.0.1.{i % 9}", "8.8.8.8", rng.choice([53, 443]), "pass", "A", rng.randint(60, 90), rng.choice(["udp", "tcp"]))
        for i in range(300)
    ]


NAMES = ["normal_firewall", "port_scan", "brute_force", "syn_flood"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text) for i, text in enumerate(scenario("normal_firewall"))]
    df = spark.createDataFrame(rows, "n long, value string")
    events = prepare_events(parse_filterlog(df, default_year=2024, line_number_col="n"), keep=("line_number",))
    return fit_models(window_features(events, 5, sequence_col="line_number"), ForestConfig(n_estimators=30))


@pytest.fixture(scope="module")
def scored(spark, model):
    parts = None
    for name in NAMES:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(scenario(name))], "n long, value string")
        part = analyse_lines(df, model, default_year=2024, line_number_col="n", window=5).withColumn("scenario", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts.cache()


def test_scenarios(spark, scored):
    lines = spark.createDataFrame([(n,) for n in NAMES for _ in scenario(n)], "scenario string")
    rows = {r.scenario: r for r in scenario_summary(scored, lines).collect()}
    assert rows["normal_firewall"].observation == V.OBSERVATIONS["calm"]
    for name in NAMES[1:]:
        assert rows[name].dominant_attack_type == name
        assert rows[name].dominant_final_label == "anomaly" and rows[name].dominant_risk_level == "high"
        assert rows[name].observation == f"Cenario preservou o tipo {name} com risco dominante high."
    assert rows["port_scan"].parsed_lines == 200


def test_scores_are_bounded(scored):
    row = scored.agg(
        *[F.min(c).alias(f"lo_{c}") for c in ("score_if_normalized", "score_ae_normalized", "ensemble_score", "confidence")],
        *[F.max(c).alias(f"hi_{c}") for c in ("score_if_normalized", "score_ae_normalized", "ensemble_score", "confidence")],
    ).first()
    assert all(0.0 <= v <= 1.0 for v in row)


def test_reports_nest_modules(scored):
    r = row_reports(scored).first()
    assert set(V.FEATURES) == set(r.features.asDict())
    assert r.ai_support.signals.criteria_version == "ai_support_v1"
    assert r.decision_engine.decision_source


def test_structured_records(spark, model):
    rows = spark.createDataFrame(
        [(7000.0, 900000.0, 7000.0, 128.0, 3.0), (3.0, 240.0, 3.0, 80.0, 1.0)],
        "connections double, bytes double, packets double, packet_size double, ports double",
    )
    got = {r.connections: r.heuristic_attack_type for r in score_records(rows, model).collect()}
    assert got == {7000.0: "ddos", 3.0: "normal"}


def test_insert_is_idempotent(spark, scored, tmp_path):
    target = str(tmp_path / "live")
    records = live_records(scored.where("scenario = 'port_scan'"), source_path="/var/log/filter.log", execution_id="e1", created_at="2024-03-01 12:00:00")
    n = records.count()
    first = sinks.insert_new_windows(records.unionByName(records), target)
    assert first == {"saved": n, "skipped_duplicates": n, "errors": 0}
    broken = records.limit(1).withColumn("window_uid", F.lit(None).cast("string"))
    again = sinks.insert_new_windows(records.unionByName(broken), target)
    assert again == {"saved": 0, "skipped_duplicates": n, "errors": 1}
    assert spark.read.parquet(target).count() == n


def test_stream_equals_batch(spark, model, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = scenario("normal_firewall")
    (folder / "a.log").write_text("\n".join(text[:150]) + "\n")
    (folder / "b.log").write_text("\n".join(text[150:]) + "\n")
    options = dict(default_year=2024, window=5, finite=True)
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    query = start_live(spark, str(folder), target, mark, model, **options)
    query.awaitTermination()
    assert run_metrics(query).agg(F.sum("lines_new")).first()[0] == 300
    batch = replay(spark, str(folder), model, default_year=2024, window=5)
    last = BASE + timedelta(seconds=299)
    names = ["window_id", "final_label", "attack_type"]
    want = sorted(tuple(r) for r in batch.where(F.col("window_end") <= F.lit(last)).select(*names).collect())
    got = sorted(tuple(r) for r in spark.read.parquet(target).select(*names).collect())
    assert got == want and len(got) > 100
    closing = BASE + timedelta(seconds=400)
    (folder / "c.log").write_text(line(closing, "10.0.9.9", "8.8.8.8", 53, "pass", "A") + "\n")
    start_live(spark, str(folder), target, mark, model, **options).awaitTermination()
    everything = batch.select("window_id").count()
    assert spark.read.parquet(target).count() == everything


def test_split_closed(spark):
    rows = [(BASE + timedelta(seconds=s),) for s in (0, 61, 62, 125)]
    df = spark.createDataFrame(rows, "timestamp timestamp")
    closed, pending = split_closed(df, 60)
    assert (closed.count(), pending.count()) == (3, 1)
    closed, pending = split_closed(df, 60, flush=True)
    assert (closed.count(), pending.count()) == (4, 0)


def test_line_numbers_count_blanks(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\nthree\n")
    (tmp_path / "b.log").write_text("".join(f"{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read_lines(spark, str(tmp_path), line_numbers=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r.line_number: r.value for r in rows if r.source_path.endswith("a.log")}
    b = {r.line_number: r.value for r in rows if r.source_path.endswith("b.log")}
    assert a == {1: "one", 2: "", 3: "three"}
    assert b == {i + 1: str(i) for i in range(2000)}


def test_invalid_utf8_is_replaced(spark, tmp_path):
    Path(tmp_path / "x.log").write_bytes(b"Jan  5 10:00:00 fw01 sshd[1]: caf\xe9\n")
    df = parse_filterlog(read_lines(spark, str(tmp_path)), default_year=2024)
    assert df.first().syslog_message == "caf�"


def test_model_round_trip(spark, model, scored, tmp_path):
    sinks.save_model(spark, model, str(tmp_path), "m1")
    loaded = sinks.load_model(spark, str(tmp_path), "m1")
    windows = scored.where("scenario = 'syn_flood'").select(*V.WINDOW_METADATA, *V.FEATURES)
    names = ["window_id", "score_if", "score_ae", "confidence"]
    a = sorted(tuple(r) for r in score_windows(windows, model).select(*names).collect())
    b = sorted(tuple(r) for r in score_windows(windows, loaded).select(*names).collect())
    assert a == b


def test_exports(spark, scored, tmp_path):
    rows = scored.withColumns({"id": F.lit(1), "execution_id": F.lit("e"), "dst_ip": F.lit('a"b'), "dst_port": F.lit("22")})
    sinks.export_history(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in Path(tmp_path / "csv").glob("part*"))
    header = text.splitlines()[0]
    assert header.startswith('"ID","Janela","Execução"') and header.count(",") == 18
    assert '"a""b"' in text and "Varredura de Portas" in text
    with pytest.raises(ValueError):
        sinks.export_history(rows.where("false"), str(tmp_path / "none"))
    sinks.write_csv(row_reports(scored), str(tmp_path / "reports"))
    sinks.write_report(row_reports(scored), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == scored.count()


def test_replace_analysis(spark, tmp_path):
    head = lambda n: spark.createDataFrame([("a", n)], "analysis_id string, total int")
    rows = lambda k: spark.createDataFrame([("a", i) for i in range(k)], "analysis_id string, id int")
    folder = str(tmp_path)
    sinks.replace_analysis(head(3), rows(3), folder)
    other = spark.createDataFrame([("b", 1)], "analysis_id string, id int")
    sinks.replace_analysis(spark.createDataFrame([("b", 9)], "analysis_id string, total int"), other, folder)
    sinks.replace_analysis(head(2), rows(2), folder)
    assert spark.read.parquet(f"{folder}/results").count() == 3
    assert {r.analysis_id: r.total for r in spark.read.parquet(f"{folder}/analyses").collect()} == {"a": 2, "b": 9}


def test_replace_analysis_with_no_results(spark, tmp_path):
    head = spark.createDataFrame([("a", 1)], "analysis_id string, total int")
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "analysis_id string, id int")
    folder = str(tmp_path)
    sinks.replace_analysis(head, rows, folder)
    assert sinks.read_analyses(spark, folder, "results").count() == 2
    sinks.replace_analysis(head, rows.limit(0), folder)
    assert sinks.read_analyses(spark, folder, "results").count() == 0
    assert sinks.read_analyses(spark, folder, "analyses").columns == ["analysis_id", "total"]
    sinks.replace_analysis(head, rows, folder)
    assert sinks.read_analyses(spark, folder, "results").count() == 2
