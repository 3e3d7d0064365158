"""Streams give what the batch operators give."""

import datetime as dt

from tesserine.operators.timeline import merge_observations as batch_merge
from tesserine.streaming import timeline as st

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "key string, at timestamp, text string"


def at(s):
    return BASE + dt.timedelta(seconds=s)


def test_staged_progress(spark):
    df = spark.createDataFrame([("Searching for x",), ("Scraping y",), ("?",)], "line string")
    got = [r["stage"] for r in st.staged_progress(df, "line", [("^Search", "search"), ("Scrap", "scrape")]).collect()]
    assert got == ["search", "scrape", None]


def drain(spark, tmp_path, data, build, files=2):
    src = tmp_path / "in"
    size = max(1, len(data) // files)
    for i in range(0, len(data), size):
        spark.createDataFrame(data[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = build(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table("out")


def test_merge_of_a_stream(spark, tmp_path):
    data = [("v", at(0), "Flood in town"), ("w", at(5), "other"), ("v", at(30), "flood in town"), ("v", at(70), "Flood in town")]
    last = [("z", at(10_000), "end")]
    got = drain(spark, tmp_path, [*data, *last], lambda s: st.merge_observations(s, "key", "at", "text", delay="0 seconds"), files=5)
    want = batch_merge(spark.createDataFrame(data, SCHEMA), "key", "at", "text")
    assert sorted(map(tuple, got.filter("key <> 'z'").collect())) == sorted(map(tuple, want.collect()))


def test_interval_join_of_streams(spark, tmp_path):
    data = [("v", at(0), "a"), ("v", at(3), "b"), ("v", at(7), "c")]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "j"))
    a = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "j"))
    b = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "j")).withColumnsRenamed({"at": "at2", "text": "text2"})
    q = st.interval_join(a, b, "key", "at", "at2", 3).writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["text"], r["text2"]) for r in spark.table("joined").collect()) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]
