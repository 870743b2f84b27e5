"""A stream of chunk readings, stopped and taken up again, against the batch."""

import tempfile

import pytest
from pyspark.sql import functions as F

from loomline.operators import seams
from loomline.plans import queries_recut as R
from loomline.streaming import resume as S

STEP = R.STEP * R.WORD_MS
CHUNK = "rec long, sent long, begins double, lasts double, last boolean, fingerprint map<string,string>, tokens array<struct<word:string,at:double,until:double>>"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, was)


def run(spark, source, sink, mark):
    """All files that are there now, one in a batch, then stop."""
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
    out = S.resumed_chunks(stream, float(STEP), float(R.OVERLAP), float(R.LEAST))
    q = out.writeStream.format("parquet").option("checkpointLocation", mark).option("path", sink).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_a_stream_stopped_half_way_and_restarted_equals_the_batch(rocks):
    spark, top = rocks, tempfile.mkdtemp()
    read = R.readings(spark, "/root/testdata/sf0.001").where("conv_id < 6").withColumn("conv_id", F.col("conv_id").cast("long"))
    ends = read.groupBy("conv_id").agg(F.max("chunk").alias("end"))
    token = F.struct("i", "word", F.col("at").cast("double").alias("at"), F.col("until").cast("double").alias("until"))
    rows = read.groupBy("conv_id", "chunk", "begins", "lasts").agg(F.sort_array(F.collect_list(token)).alias("tokens")).join(ends, "conv_id").select(
        F.col("conv_id").alias("rec"), F.col("chunk").cast("long").alias("sent"), F.col("begins").cast("double").alias("begins"), F.col("lasts").cast("double").alias("lasts"),
        (F.col("chunk") == F.col("end")).alias("last"), F.create_map(F.lit("model_id"), F.lit("m1")).alias("fingerprint"), F.transform("tokens", lambda t: t.dropFields("i")).alias("tokens"),
    ).toPandas()
    last = int(rows["sent"].max())
    assert last >= 2
    schema = spark.createDataFrame([], CHUNK).schema
    put = lambda part: spark.createDataFrame([tuple(r) for r in part.itertuples(index=False)], schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
    half = rows[rows["sent"] <= last // 2]
    put(half[half["sent"] % 2 == 1]) if (half["sent"] % 2 == 1).any() else None  # odd chunks first: they wait for those before them
    put(half[half["sent"] % 2 == 0])
    run(spark, f"{top}/in", f"{top}/out", f"{top}/mark")
    first = spark.read.parquet(f"{top}/out").count()
    put(half)  # sent again: skipped
    put(rows[rows["sent"] > last // 2])
    run(spark, f"{top}/in", f"{top}/out", f"{top}/mark")
    got = spark.read.schema(S.OUT).parquet(f"{top}/out")
    assert 0 < first < got.count() and got.where("note IS NOT NULL OR run <> 0").count() == 0
    batch = seams.chunk_loop(read, "conv_id", R.OVERLAP, R.LEAST)
    both = [sorted(tuple(r) for r in df.collect()) for df in (got.select("rec", "place", "word", "start", "end"), batch.select(F.col("conv_id").alias("rec"), "place", "word", "start", "end"))]
    assert both[0] == both[1]


def test_another_run_starts_over_and_says_why(rocks):
    spark, top = rocks, tempfile.mkdtemp()
    said = lambda text: [(w, 1000.0 * i, 1000.0 * i + 500) for i, w in enumerate(text.split())]
    rows = [(1, 0, 0.0, 60000.0, False, {"model_id": "a", "language": "en"}, said("old words")), (1, 1, 0.0, 60000.0, True, {"model_id": "b", "language": "en"}, said("new words here"))]
    for r in rows:
        spark.createDataFrame([r], CHUNK).coalesce(1).write.mode("append").parquet(f"{top}/in")
        run(spark, f"{top}/in", f"{top}/out", f"{top}/mark")
    got = [tuple(r) for r in spark.read.schema(S.OUT).parquet(f"{top}/out").orderBy("run", "place").collect()]
    assert [(r[1], r[2], r[3]) for r in got if r[6] is None and r[1] == 1] == [(1, 0, "new"), (1, 1, "words"), (1, 2, "here")]
    assert [r[6] for r in got if r[6]] == ["started over: another model (model_id)"]


def test_what_differs_is_named(spark):
    cases = [
        ({"schema": "1", "model_id": "a"}, {"schema": "1", "model_id": "a"}, None),
        ({"schema": "1", "model_id": "a"}, {"schema": "2", "model_id": "b"}, "written in another format (schema)"),
        ({"schema": "1", "model_id": "a", "beam": "4"}, {"schema": "1", "model_id": "b", "prompt": "x"}, "another engine (beam); another model (model_id); another prompt (prompt)"),
        ({}, {"language": "ur"}, "another language (language)"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a map<string,string>, b map<string,string>")
    got = {r.i: r.m for r in df.select("i", S.mismatch_of(F.col("a"), F.col("b")).alias("m")).collect()}
    for i, (a, b, want) in enumerate(cases):
        assert S.mismatch(a, b) == want == got[i]
