from quantflume.functions import series
from quantflume.operators import backtest
from quantflume.sources import bars
from quantflume.streaming import bars as live


def test_streamed_bars_and_state_equal_the_batch(spark, sf_dir, tmp_path):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("'ALL' symbol", "cast(ts as timestamp) ts", "event_id", "value price", "value size").where("event_id < 3000")
    src = f"{tmp_path}/ticks"
    ticks.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 700).parquet(src)
    stream = live.tumbling_bars(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(src), "1 hour", "10 minutes", tick_id="event_id")
    done = stream.writeStream.format("parquet").option("path", f"{tmp_path}/bars").option("checkpointLocation", f"{tmp_path}/c1").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    got = {r.bar_ms: r for r in spark.read.parquet(f"{tmp_path}/bars").collect()}
    want = {r.bar_ms: r for r in bars.event_bars(spark, sf_dir, bars.HOUR).collect()}
    last = max(got)
    assert len(got) > 100 and all((got[k].open, got[k].close, got[k].trades) == (want[k].open, want[k].close, want[k].trades) for k in got if k < last)

    table = spark.read.parquet(f"{tmp_path}/bars")
    state = live.running_state(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/bars"), 0.05, 0.10)
    run = state.writeStream.format("memory").queryName("running_state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    streamed = {r.bar_ms: r for r in spark.table("running_state").collect()}
    batch = series.ema(table, "close", "ema")
    batch = backtest.circuit_breaker(batch.withColumn("ret", series.pct_change("close")), 0.10)
    for r in batch.collect():
        assert abs(streamed[r.bar_ms].ema - r.ema) < 1e-9
        assert abs(streamed[r.bar_ms].traded - r.ret_cb) < 1e-9
