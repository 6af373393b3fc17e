import json

from pyspark.sql import functions as F

from quillmine.operators import chunking
from quillmine.streaming import jobs


def test_ingest_in_batches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    kind = "document_id long, text string, title string"
    for n in range(2):
        (source / f"{n}.json").write_text(json.dumps({"document_id": n, "text": f"# Part {n}\n\nalpha beta gamma delta epsilon.", "title": "Doc"}))
        jobs.ingest(spark, str(source), kind, chunking.chunked, target, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert sorted((r["document_id"], r["title"], r["batch"]) for r in rows) == [(0, "Part 0", 0), (1, "Part 1", 1)]


def test_daily_searches(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    jobs.run_daily_searches(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), jobs.fresh_checkpoint(str(tmp_path))).awaitTermination()
    got = {(str(r["day"]), r["event_type"]): r["searches"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    want = {(str(r["day"]), r["event_type"]): r["count"] for r in events.groupBy(day.alias("day"), "event_type").count().collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 0.8 * len(want)
