import json

import pytest

from trailmill.sources import readers, writers
from trailmill.streaming import sessions as streams


def test_flat_events(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("session_id,event_name,event_at,product_id\n1,page_viewed,2024-01-01T00:00:01Z,007\n,page_viewed,2024-01-01T00:00:01Z,1\n2,page_viewed,never,1\n")
    rows = readers.flat_events(spark, str(p), ["session_id", "event_name", "event_at", "product_id"]).collect()
    assert [(r.session_id, r.product_id, r.ts_ms) for r in rows] == [("1", "007", 1704067201000)]


def test_catalog_needs_its_columns(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("product_handle,price\na,1\n")
    with pytest.raises(readers.MissingColumns):
        readers.product_catalog(spark, str(p))
    p.write_text("product_handle,product_title,product_type,price\na,A,t,1.5\na,A2,t,2\nb,,t,3\nc,C,t,x\n")
    assert [(r.product_handle, r.price) for r in readers.product_catalog(spark, str(p)).orderBy("product_handle").collect()] == [("a", 1.5), ("c", None)]


def test_timelines(spark, tmp_path):
    p = tmp_path / "t.json"
    one = {"link": "https://x/player/p/u/s1", "timestamp": "2024-01-01T00:00:00Z", "timeline": [{"url": "/a", "duration": 5, "start": "01:02", "timelineEvents": []}, {"url": "/b", "start": "bad", "timelineEvents": None}]}
    p.write_text(json.dumps([one, one]))
    rows = readers.timelines(spark, str(p)).orderBy("page").collect()
    assert [(r.session_id, r.url, r.ts_ms) for r in rows] == [("s1", "/a", 1704067262000), ("s1", "/b", 1704067200000)]


def test_run_files_and_lines(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "session_data.json").write_text(json.dumps([{"session_id": run, "timestamp": "t", "url": "/"}]))
    (tmp_path / "all.json").write_text("[]")
    assert sorted(r.run for r in readers.run_files(spark, str(tmp_path)).collect()) == ["r1", "r2"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"session_id":"a"}\n\n{broken\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(bad), "session_id string").collect()
    assert readers.json_lines(spark, str(bad), "session_id string", strict=False).where("session_id = 'a'").count() == 1


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("Valid: Recall@5=0.9 MRR@5=0.5\nTest: Recall@5=0.2 MRR@5=0.1\nTest: Recall@5=0.3 MRR@5=0.2\n")
    (tmp_path / "b.log").write_text("Valid: Recall@5=0.4 MRR@5=0.3\nValid: Recall@5=0.6 MRR@5=0.2\n")
    got = {r.file[-5]: (r.recall, r.mrr) for r in readers.test_lines(spark, str(tmp_path)).collect()}
    assert got == {"a": (0.3, 0.2), "b": (0.6, 0.2)}


def test_external_projection(spark, tmp_path):
    row = {c: "1" for c in readers.RAW_FIELDS} | {"secret": "x"}
    df = spark.createDataFrame([row])
    assert writers.external(df).columns == readers.EXTERNAL_FIELDS
    writers.clickstream_csv(df, str(tmp_path / "raw"), str(tmp_path / "ext"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ext")).columns == readers.EXTERNAL_FIELDS
    assert "secret" not in spark.read.option("header", True).csv(str(tmp_path / "raw")).columns


def test_dataset_checks(spark, tmp_path):
    train = spark.createDataFrame([(1, 1)], "session long, label long")
    vocab = spark.createDataFrame([(5, 1)], "item long, id long")
    assert writers.dataset(train, train.withColumn("session", train.session + 1), vocab, str(tmp_path / "d")) == {"train": 1, "test": 1, "vocab": 1}
    with pytest.raises(ValueError):
        writers.dataset(train, train, vocab, str(tmp_path / "d"))


def test_first_outcomes(spark):
    df = spark.createDataFrame([("m", "c", 1, 7, 2, 0.0, 0.0, 0.0, 0.0), ("m", "c", 1, 7, 1, 1.0, 0.5, 1.0, 0.5)], "method string, condition string, seed int, example int, arrival int, hit10 double, rr10 double, hit5 double, rr5 double")
    assert [tuple(r) for r in writers.first_outcomes(df).collect()] == [("m", "c", 1, 7, 1.0, 0.5, 1.0, 0.5)]
    with pytest.raises(ValueError):
        writers.first_outcomes(df.withColumn("hit5", df.hit5 + 3))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, 1.0), (1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:10:00", 1, 2.0), (3, "2024-01-01 02:00:00", 1, 4.0), (4, "2024-01-03 00:00:00", 2, 8.0)], "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "value", "'e' event_type")
    rows.coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(src))
    assert streams.run_available(streams.deduplicated(stream()), "once", "append").count() == 4
    got = streams.run_available(streams.session_windows(streams.deduplicated(stream(), "1 hour"), delay=None), "closed", "append").orderBy("start").collect()
    assert [(r.n, r.value) for r in got][:2] == [(2, 3.0), (1, 4.0)]
    assert streams.run_available(streams.running_statistics(stream()), "stats", "complete").first()["n"] == 5
