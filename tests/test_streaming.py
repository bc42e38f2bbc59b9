from pyspark.sql import functions as F

from engramite.sources.versions import Table
from engramite.streaming import windows as st


def run(stream, name, mode, folder):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination()


def source(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(3, "ts").write.mode("overwrite").parquet(str(folder))
    return events


def test_windows_match_batch(spark, sf, tmp_path):
    events = source(spark, sf, tmp_path / "in")
    run(st.tumbling(st.read_events(spark, str(tmp_path / "in"), 10), "1 hour", "60 days"), "tumbling", "complete", tmp_path / "c1")
    batch = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("tumbling").select("window.start", "event_type", "n").collect())) == sorted(map(tuple, batch.select("window.start", "event_type", "n").collect()))


def test_sessions_and_sliding_run(spark, sf, tmp_path):
    events = source(spark, sf, tmp_path / "in")
    run(st.sliding(st.read_events(spark, str(tmp_path / "in"), 10), "7 days", "1 day", "60 days"), "sliding", "complete", tmp_path / "c2")
    assert spark.table("sliding").agg(F.sum("n")).first()[0] == 7 * events.count()
    run(st.sessions(st.read_events(spark, str(tmp_path / "in"), 10), "15 minutes", "60 days"), "sessions", "complete", tmp_path / "c3")
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == events.count()


def test_state_is_bounded_fold(spark, sf, tmp_path):
    events = source(spark, sf, tmp_path / "in")
    run(st.keep_latest(st.read_events(spark, str(tmp_path / "in"), 10), most=3, late="60 days"), "folded", "update", tmp_path / "c4")
    last = spark.table("folded").groupBy("user_id").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("folded").where(F.size(F.split("latest", ",")) > 3).count() == 0


def test_upsert_batches(spark, sf, tmp_path):
    events = source(spark, sf, tmp_path / "in")
    stream = lambda: st.upsert_batches(st.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), ["user_id"], "ts", str(tmp_path / "c5"))
    stream().awaitTermination()
    table = Table(spark, str(tmp_path / "out"), ["user_id"])
    want = {r.user_id: r.ts for r in events.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert {r.user_id: r.ts for r in table.read().collect()} == want and len(table.versions()) > 1
    before = table.version()
    stream().awaitTermination()  # a restart from the checkpoint has nothing to do
    assert table.version() == before
    assert table.add(table.read().limit(1), before.done[0]).number == before.number  # a batch that is run again is not committed again
