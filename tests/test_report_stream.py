import os

import pytest
from pyspark.errors import StreamingQueryException

from shelfcast.plans.report import run_report
from shelfcast.sources import sales as src
from shelfcast.sources import tpch
from shelfcast.streaming.ingest import start_ingest

SF = "/root/testdata/sf0.001"


def test_stream_ingest_matches_batch(spark, tmp_path):
    dirty = tpch.dirty_source(spark, SF)
    dirty.repartition(3).write.option("header", True).csv(str(tmp_path / "in"))
    q = start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    streamed = src.read_snapshot(spark, str(tmp_path / "snap"))
    batch = src.load_sales(dirty)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_stream_refuses_a_shuffled_header(spark, tmp_path):
    cols = list(src.REQUIRED_COLUMNS)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(",".join(cols[:6] + ["Qty", "Price", "Sum"]) + "\nS,03.02.2024,a,d,M,G,2,10,20\n")
    q = start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "ck"))
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(120)
    assert not (tmp_path / "snap").exists() or not [f for f in os.listdir(tmp_path / "snap") if "sale_month" in f]


def test_report_writes_all_tables(spark, tmp_path):
    names = run_report(spark, tpch.sales_view(spark, SF), str(tmp_path / "out"))
    for n in names + ["forecast_csv", "snapshot"]:
        assert os.path.isdir(tmp_path / "out" / n), n
    fc = spark.read.parquet(str(tmp_path / "out" / "forecast"))
    assert fc.filter("is_future").count() > 0
    hits = spark.read.parquet(str(tmp_path / "out" / "rule_hits"))
    assert hits.count() > 0
