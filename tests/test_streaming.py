from pyspark.sql import functions as F

from loomline.operators.intervals import sessions
from loomline.plans.queries_time import MINUTE, points
from loomline.streaming.sessions import finished, stream_counts, stream_sessions

SF = "/root/testdata/sf0.001"


def test_streamed_sessions_close_as_the_watermark_passes_them(spark, tmp_path):
    """Events come in three files in the order of time; two far events at the end move the watermark past all others."""
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    cuts = [r.t for r in events.select(F.explode(F.percentile_approx(F.col("ts"), F.array(F.lit(0.33), F.lit(0.66)))).alias("t")).collect()]
    parts = [events.where(F.col("ts") <= cuts[0]), events.where((F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1])), events.where(F.col("ts") > cuts[1])]
    parts += [events.select(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr(f"interval {d} days")).alias("ts")) for d in (9, 19)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = finished(stream_sessions(stream, "user_id", "ts", "30 minutes", "1 hour"), str(tmp_path / "s"))
    want = sessions(points(spark, SF), "user_id", "t", 30 * MINUTE, "event_id")
    milli = lambda t: int(t.timestamp() * 1000 + 1e-3)
    streamed = sorted((r.user_id, milli(r.first), milli(r.last), r.n) for r in got.where("user_id >= 0").collect())
    assert streamed == sorted((r.user_id, r.start, r.end, r.n) for r in want.collect()) and len(streamed) > 100
    open_ = finished(stream_sessions(stream, "user_id", "ts", "30 minutes", "365 days"), str(tmp_path / "o"))
    assert open_.count() == 0  # nothing is closed before the watermark


def test_streamed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = finished(stream_counts(stream, "user_id", "ts", "1 day", "0 seconds"), str(tmp_path / "c")).collect()
    want = {(r.start, r.user_id): r.n for r in stream_counts(events, "user_id", "ts", "1 day", "0 seconds").collect()}
    assert got and all(want[r.start, r.user_id] == r.n for r in got)
