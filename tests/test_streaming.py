"""Replays of files against the batch forms."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import ensemble as E
from seriesforge.operators import series as S
from seriesforge.streaming import jobs as J

DATA = "/root/testdata/sf0.001"


def replay(spark, df, make, mode="append"):
    q = make(df).writeStream.outputMode(mode).format("memory").queryName("out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("SELECT * FROM out").collect()
    q.stop()
    return rows


def test_daily_counts(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), "value")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = {(r.entity, str(r.day)): r.n for r in replay(spark, stream, J.daily, "complete")}
    want = {(r.entity, str(r.day)): r["count"] for r in e.groupBy("entity", F.to_date("ts").alias("day")).count().collect()}
    assert got == want


def test_ema_and_cusum(spark, tmp_path):
    x = [float((i * 7) % 5) + (30 if i > 60 else 0) for i in range(100)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "entity string, idx long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted((r.idx, r.ema) for r in replay(spark, stream, lambda s: J.ema(s, 5)))
    want = pd.Series(x).ewm(span=5, adjust=False).mean()
    assert len(got) == 100 and all(abs(v - want[i]) < 1e-9 for i, v in got)
    alarms = replay(spark, stream, J.cusum)
    assert alarms and min(a.idx for a in alarms if a.idx > 55) <= 63


def run(spark, made, out, checkpoint):
    q = made.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


SCORED = "entity string, model string, seq long, predicted double, actual double, confidence double"


def scored(n=400):
    r = random.Random(3)
    return [(r.choice("ab"), r.choice(["fourier", "hmm", "dtw"]), i, r.random() * 4, r.random(), r.random()) for i in range(n)]


def test_weights_go_on_after_a_restart(spark, tmp_path):
    """Three runs, each from the checkpoint of the one before; after each, the weights are those of the batch form over all rows so far."""
    df = spark.createDataFrame(scored(), SCORED)
    made = lambda: J.meta_weights(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), keep=40)
    (tmp_path / "in").mkdir()
    for hi in (100, 260, 399):
        lo = {100: -1, 260: 100, 399: 260}[hi]
        df.where((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, made(), tmp_path / "out", tmp_path / "check")
        got = spark.read.parquet(str(tmp_path / "out"))
        for entity in "ab":
            mine = got.where(F.col("entity") == entity)
            last = mine.agg(F.max("seq")).first()[0]
            weights = {r.model: r.weight for r in mine.where(F.col("seq") == last).collect()}
            batch = {r.model: r.weight for r in E.meta_weights(df.where((F.col("entity") == entity) & (F.col("seq") <= hi)), 40).collect()}
            assert weights == pytest.approx(batch)
    state = spark.read.format("statestore").option("stateVarName", "errors").load(str(tmp_path / "check"))
    rows = state.select("key.entity", "list_element.*") if "list_element" in state.columns else state.select("key.entity", F.explode("list_value").alias("e")).select("entity", "e.*")
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == [("entity", "string"), ("model", "string"), ("seq", "bigint"), ("error", "double")]
    want = {(r.entity, r.model, r.seq) for r in df.withColumn("k", F.expr("row_number() OVER (PARTITION BY entity, model ORDER BY seq DESC)")).where("k <= 40").collect()}
    assert {(r.entity, r.model, r.seq) for r in rows.collect()} == want


def test_idle_entities_lose_their_errors(spark, tmp_path):
    import time

    df = spark.createDataFrame(scored(50), SCORED)
    df.where("entity = 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    made = J.meta_weights(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), idle_ms=3000, forget_ms=60_000)
    q = made.writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.sql("SELECT * FROM idle WHERE seq = -1").count():
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.sql("SELECT * FROM idle")
    assert {r.model: r.weight for r in rows.where("entity = 'a' and seq = -1").collect()} == E.WEIGHTS
    assert rows.where("entity = 'a' and seq >= 0").count() == 3


def test_means_and_alarms_over_a_restart_like_in_one_run(spark, tmp_path):
    r = random.Random(1)
    rows = [(e, i, r.gauss(0, 1) + (6 if i > 120 else 0), i) for e in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "entity string, idx long, value double, seq long")
    for name, make in (("ema", lambda x: J.ema(x, 9)), ("cusum", J.cusum)):
        whole, cut = tmp_path / f"{name}-whole", tmp_path / f"{name}-cut"
        df.coalesce(1).write.parquet(str(whole / "in"))
        run(spark, make(spark.readStream.schema(df.schema).parquet(str(whole / "in"))), whole / "out", whole / "check")
        for lo, hi in ((-1, 77), (77, 200)):
            df.where((F.col("idx") > lo) & (F.col("idx") <= hi)).coalesce(1).write.mode("append").parquet(str(cut / "in"))
            run(spark, make(spark.readStream.schema(df.schema).parquet(str(cut / "in"))), cut / "out", cut / "check")
        a, b = (sorted(tuple(x) for x in spark.read.parquet(str(p / "out")).collect()) for p in (whole, cut))
        assert a == b and a


def test_bursts_like_the_batch_form(spark, tmp_path):
    """Events whole days apart, up to seven of them, are one burst in both forms."""
    r = random.Random(2)
    days = {e: sorted(r.sample(range(900), 60)) + [1000, 1007, 1014, 1022, 1030, 1031, 1032] for e in "ab"}
    df = spark.createDataFrame([(e, d) for e, ds in days.items() for d in ds], "entity string, day int").select("entity", F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, day)").alias("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(x.entity, str(x.start)[:10], x.n) for x in replay(spark, stream, lambda e: J.bursts(e, "7 days 1 second"), "complete")}
    want = {(x.entity, str(x.start)[:10], x.n) for x in S.bursts(df, 7, 3).collect()}
    assert got == want and ("a", "2022-09-27", 3) in got


def test_another_state_store_is_refused(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' AS entity", "value AS idx", "CAST(value AS double) AS value")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "other")
    try:
        with pytest.raises(ValueError, match="stateStore"):
            J.ema(stream)
    finally:
        spark.conf.set(name, before)
