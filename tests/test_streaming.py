import datetime as dt

from pyspark.sql import functions as F

from stratalog.operators import buckets as B
from stratalog.streaming import buckets as S

T0 = dt.datetime(2024, 3, 1, 10, 0)


def test_stream_equals_batch_and_reruns_change_nothing(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=(i * 7) % 400), "error" if i % 3 else "info") for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, ts timestamp_ntz, level string")
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("ord < 120").select("ord", F.col("ts").cast("timestamp").alias("ts"), "level").write.parquet(source)
    for turn in range(2):
        stream = spark.readStream.schema("ord long, ts timestamp, level string").parquet(source)
        S.upsert_stream(stream, table, str(tmp_path / "check")).awaitTermination()
        if not turn:
            df.where("ord >= 120").select("ord", F.col("ts").cast("timestamp").alias("ts"), "level").write.mode("append").parquet(source)
    want = {(r.start_time, r.total_events, r.error_count) for r in B.count_levels(B.assign(df)).collect()}
    assert {(r.start_time, r.total_events, r.error_count) for r in spark.read.parquet(table).collect()} == want


def test_late_share(spark):
    rows = [(0, T0), (1, T0 + dt.timedelta(hours=9)), (2, T0), (3, T0 + dt.timedelta(hours=9))]
    r = S.late_share(spark.createDataFrame(rows, "ord long, ts timestamp_ntz")).first()
    assert (r.late, r.events, r.level) == (1, 4, "error")
