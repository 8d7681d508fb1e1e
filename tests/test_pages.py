"""Pages by key and by stored ranges, and the trigram search, against plain versions."""

import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowguard.functions.display import fold, folded
from flowguard.operators import pages, search
from flowguard.operators.parse import parse_filterlog

BASE = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, BASE + timedelta(hours=i % 17) if i % 11 else None, f"Text {i} Ação {'ÉÈ' * (i % 3)} x{i % 7}") for i in range(500)]
    return spark.createDataFrame(data, "id long, t timestamp, body string").repartition(5).cache()


def ordered(rows):
    return [r.id for r in sorted(rows.collect(), key=lambda r: (r.t is not None, r.t or BASE, r.id), reverse=True)]


def test_seeks_follow_one_another(rows):
    want, seen, last = ordered(rows), [], None
    for _ in range(6):
        page = pages.seek_page(rows, ["t", "id"], last, 90).collect()
        seen += [r.id for r in page]
        last = (page[-1].t, page[-1].id) if page else last
    assert seen == want
    assert pages.seek_page(rows, ["t", "id"], last, 90).count() == 0


def test_numbered_pages_read_only_their_parts(spark, rows, tmp_path):
    path, want = str(tmp_path / "p"), ordered(rows)
    pages.write_ranges(rows, path, ["t", "id"], parts=10)
    for offset in (0, 37, 240, 470, 499, 500, 9000):
        assert [r.id for r in pages.read_page(spark, path, ["t", "id"], 60, offset).collect()] == want[offset : offset + 60]
    assert pages.total_rows(spark, path) == 500
    late = pages.read_page(spark, path, ["t", "id"], 10, 300)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "(part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pages.write_ranges(rows.where("id < 20"), path, ["t", "id"], parts=3)
    assert pages.total_rows(spark, path) == 20
    pages.write_ranges(rows.limit(0), path, ["t", "id"], parts=3)
    assert pages.read_page(spark, path, ["t", "id"]).count() == 0 and pages.total_rows(spark, path) == 0


@pytest.mark.parametrize("query", ["acao", "AÇÃO é", "x3", "ée", "éèéè", "text 49", "  ", "", "x", "nothing here", "Text 499"])
def test_trigrams_find_what_contains_finds(spark, rows, tmp_path, query):
    path = str(tmp_path / "s")
    search.write_index(rows, path, "id", ["id", "body"])
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    want = {r.id for r in rows.collect() if not query.strip() or plain(query) in plain(f"{r.id} {r.body}")}
    assert {r.id for r in search.find_rows(rows, path, "id", query).collect()} == want


def test_an_empty_table_is_searched(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    search.write_index(rows.limit(0), path, "id", ["id", "body"])
    assert search.find_rows(rows, path, "id", "text").count() == 0


def test_folding_follows_the_decomposition(spark):
    texts = ["Ação", "ÇÜÉ", "naïve Ñandú", "Ὀδύσσεια", "plain", "Ёж", "é", "ǅ", ""]
    want = ["".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).lower() for t in texts]
    assert [fold(t) for t in texts] == want
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", folded(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == want


def test_filters_on_kept_columns_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(40).select(F.concat(F.lit("Jan  5 10:00:0"), F.col("id") % 10, F.lit(" fw01 sshd[1]: x")).alias("value"), (F.col("id") % 4).alias("day")).write.partitionBy("day").parquet(path)
    parsed = parse_filterlog(spark.read.parquet(path), default_year=2024, keep=("day",)).where("day = 2 AND parse_status = 'failed'")
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "(day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert parsed.count() == 10
