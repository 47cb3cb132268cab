import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weir.functions.records import header_value
from weir.operators import cdc
from weir.plans import loans, telemetry, wealth
from weir.session import shared_dir
from weir.streaming import latency, sinks
from weir.streaming.monitor import city_monitor, monitor_batch, monitor_stream, monitor_table
from weir.streaming.tables import (
    append_new, compact, full_refresh, read_scd1, read_sums, stream_scd1, stream_sums)
from weir.streaming.windows import sliding_stats
from weir.tables import load, with_instant


def as_stream(spark, df, parts=1):
    """A streamed table of the rows, one file per trigger."""
    path = shared_dir(spark, "stream")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination()
    return query


def test_sliding_windows_equal_the_batch(spark, data):
    e = with_instant(load(spark, data, "events"), "ts").select("ts", "value")
    q = sinks.to_memory(sliding_stats(as_stream(spark, e, 3), "ts", "value", "1 hour", "10 minutes"), "windows", shared_dir(spark, "ck"))
    finish(q)
    latest = spark.table("windows").groupBy("window_start").agg(F.max(F.struct("n", "min_value", "max_value")).alias("m"))
    want = sliding_stats(e, "ts", "value", "1 hour", "10 minutes")
    assert rows(latest, "window_start", "m.*") == rows(want, "window_start", "n", "min_value", "max_value")


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    folder, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    def run(*times):
        df = spark.createDataFrame([(t, 1.0) for t in times], "s STRING, value DOUBLE").select(F.to_timestamp("s").alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        append_new(sliding_stats(stream, "ts", "value", "10 seconds", "10 seconds", watermark="10 seconds"), str(tmp_path / "out"), ck)
    run("2024-01-01 00:00:05", "2024-01-01 00:01:00")
    run("2024-01-01 00:00:06")                  # its window is closed
    run("2024-01-01 00:02:00")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(out, F.col("window_start").cast("string"), "n") == [("2024-01-01 00:00:00", 1), ("2024-01-01 00:01:00", 1)]


def test_monitor_stream_equals_the_batch(spark, data):
    s = with_instant(telemetry.sensors(spark, data), "ts").orderBy("ts")
    stream = as_stream(spark, s.coalesce(1).sortWithinPartitions("ts"), 1)
    q = sinks.to_memory(monitor_stream(stream, "city", "ts", "event_id"), "monitor", shared_dir(spark, "ck"))
    finish(q)
    cols = ["event_id", "city", F.round("hourly_avg_temp", 6), "high_temp_count", "alerts"]
    got, want = spark.table("monitor"), monitor_batch(s, "city", "ts", "event_id")
    assert got.count() == s.count()
    # rows reach a key's state in shuffle order, so compare what does not depend on it
    last = lambda df: df.groupBy("city").agg(F.max("high_temp_count").alias("n"), F.count("*").alias("rows"))
    assert rows(last(got)) == rows(last(want))
    assert rows(got, "event_id", "alerts") == rows(want, "event_id", "alerts")
    assert len(cols) == 5


@pytest.mark.parametrize("rows_in", [0, 7, 5_000])
def test_monitor_of_a_hot_city_holds_a_few_rows(monkeypatch, rows_in):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(rows_in)
    table = pd.DataFrame({
        "city": "x", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 900, rows_in), "s"),
        "event_id": rng.permutation(rows_in), "temperature": rng.integers(10, 40, rows_in) * 1.0})

    class State:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, value):
            self.kept = value

    def run(**sizes):
        processor = city_monitor("ts", "event_id", list(table.columns), **sizes)
        processor.state = State()
        parts = [table.iloc[i:i + 50] for i in range(0, rows_in, 50)]
        out = [p for half in (parts[:60], parts[60:]) if half for p in processor.handleInputRows(("x",), iter(half), None)]
        return out, processor.state.kept

    whole, state = run()
    seen, concat = [], pd.concat
    monkeypatch.setattr(pd, "concat", lambda frames, **kw: seen.append(sum(map(len, frames))) or concat(frames, **kw))
    sliced, same = run(chunk=100, block=20, fan=4)
    monkeypatch.undo()
    assert state == same and max(seen, default=0) <= 20 * 20
    if rows_in:
        pd.testing.assert_frame_equal(concat(sliced).reset_index(drop=True), concat(whole).reset_index(drop=True))
        assert len(concat(sliced)) == rows_in


def test_monitor_state_carries_over_batches(spark, tmp_path):
    folder, ck, seen = str(tmp_path / "in"), str(tmp_path / "ck"), []
    first_hot = [("x", 1, 20.0), ("x", 2, 30.0), ("x", 3, 28.0)]
    def run(batch):
        df = spark.createDataFrame(batch, "city STRING, sec INT, temperature DOUBLE").select(
            "city", F.timestamp_seconds("sec").alias("ts"), "temperature", F.lit(80.0).alias("humidity"),
            F.lit(1.0).alias("co2_level"), F.lit(36.0).alias("pm25_level"))
        df.coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(folder)
        out = monitor_stream(spark.readStream.schema(df.schema).parquet(folder), "city", "ts", "temperature")
        finish(sinks.to_batches(out, lambda b, i: seen.extend(b.orderBy("ts").collect()), ck, "update"))
    run(first_hot)
    run([("x", 4, 27.0), ("x", 5, 10.0)])
    got = [(r.temperature, round(r.daily_avg_temp, 4), r.temperature_trend, r.high_temp_count) for r in seen]
    assert got == [
        (20.0, 20.0, "stable", 0), (30.0, 30.0, "stable", 1), (28.0, round(86 / 3, 4), "stable", 2),
        (27.0, round((85 + 27) / 4, 4), "stable", 3), (10.0, round(95 / 4, 4), "falling", 3)]
    # humidity exactly at its limit raises nothing; pm2.5 is judged by its own value
    assert seen[0].alerts == "High pm25_level alert: 36.0 µg/m³;"
    assert seen[1].alerts == "High temperature alert: 30.0 °C;High pm25_level alert: 36.0 µg/m³;"


def test_stream_static_join_equals_the_batch(spark, data, tmp_path):
    orders = load(spark, data, "orders").select("o_orderkey", "o_orderpriority")
    code = F.left("o_orderpriority", F.lit(1)).cast("int")
    append_new(loans.enrich(as_stream(spark, orders, 2), loans.treatments(spark), code), str(tmp_path / "t"), str(tmp_path / "c"))
    want = loans.enrich(orders, loans.treatments(spark), code)
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(want)


def test_running_sum_in_update_mode(spark, data):
    p = wealth.portfolio(spark, data).withColumn("portfolio_value", F.floor("portfolio_value").cast("double"))
    finish(sinks.to_memory(wealth.net_worth_of(as_stream(spark, p, 3)), "worth", shared_dir(spark, "ck")))
    latest = spark.table("worth").groupBy("customer_id").agg(F.max("total_net_worth").alias("w"))
    assert rows(latest) == rows(wealth.net_worth_of(p))


def test_streamed_scd1_is_safe_to_repeat(spark, data, tmp_path):
    changes = load(spark, data, "events").select("user_id", "event_id", "event_type", "value")
    path = str(tmp_path / "t")
    finish(stream_scd1(as_stream(spark, changes, 4), path, ["user_id"], "event_id", str(tmp_path / "c1")))
    want = cdc.scd1(changes, ["user_id"], "event_id", "event_type = 'error'")
    now = lambda where: read_scd1(spark, where, ["user_id"], "event_id", "event_type = 'error'")
    assert rows(now(path)) == rows(want)
    # a second run from the beginning replaces the batches it wrote before
    finish(stream_scd1(as_stream(spark, changes, 4), path, ["user_id"], "event_id", str(tmp_path / "c2")))
    assert rows(now(path)) == rows(want)
    compact(read_scd1(spark, path, ["user_id"], "event_id"), str(tmp_path / "folded"))
    assert rows(now(str(tmp_path / "folded"))) == rows(want)


def test_streamed_sums(spark, data, tmp_path):
    o = load(spark, data, "orders").select("o_custkey", F.floor("o_totalprice").alias("price"))
    finish(stream_sums(as_stream(spark, o, 3), str(tmp_path / "t"), ["o_custkey"], ["price"], str(tmp_path / "c")))
    want = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    assert rows(read_sums(spark, str(tmp_path / "t"), ["o_custkey"], ["price"])) == rows(want)


def test_incremental_run_and_full_refresh(spark, tmp_path):
    src, table, ck = (str(tmp_path / n) for n in ("s", "t", "c"))
    spark.range(4).write.parquet(src)
    stream = lambda: spark.readStream.schema("id LONG").parquet(src)
    append_new(stream(), table, ck)
    spark.range(4, 6).write.mode("append").parquet(src)
    append_new(stream(), table, ck)
    append_new(stream(), table, ck)
    assert rows(spark.read.parquet(table)) == [(i,) for i in range(6)]
    full_refresh(stream(), str(tmp_path / "t2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 6


def test_triggers_and_console(spark, data):
    assert sinks.trigger_options("processing_time", "1 second") == {"processingTime": "1 second"}
    with pytest.raises(ValueError):
        sinks.trigger_options("hourly")
    finish(sinks.to_console(as_stream(spark, load(spark, data, "region")), shared_dir(spark, "ck"), "append"))


def test_rate_source_progress_and_latency(spark):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 50).option("numPartitions", 2).load()
    readings = rate.select("timestamp", (F.col("value") % 40).cast("double").alias("temperature"))
    kept = []

    def write(batch, batch_id):
        kept.extend(latency.row_latency(latency.tag_for_latency(batch, "processingtime0", batch_id)).collect())

    q = sinks.to_batches(readings, write, shared_dir(spark, "ck"), trigger=sinks.trigger_options("processing_time"))
    reports = latency.collect_progress(q, 3, timeout=60)
    assert not q.isActive and len(reports) == 3
    out = latency.progress_rows(spark, reports)
    assert [r.batch_id for r in out.orderBy("batch_id").collect()] == [0, 1, 2]
    assert all(r.latency >= 0 and r.triggertype == "processingtime0" for r in kept)


def test_progress_with_latencies_and_state(spark):
    report = {
        "batchId": 4, "numInputRows": 10, "processedRowsPerSecond": 2.5,
        "latencies": {"e2eLatencyMs": {"P50": 1, "P90": 2, "P95": 3, "P99": 4}},
        "stateOperators": [{"operatorName": "tws", "numRowsTotal": 7, "customMetrics": {"x": 1}}]}
    r = latency.progress_rows(spark, [report, {"batchId": 5}]).orderBy("batch_id").collect()
    assert r[0].latencies.e2eLatencyMs.P99 == 4 and r[0].latencies.processingLatencyMs is None
    assert r[0].stateOperators[0].customMetrics == {"x": 1} and r[1].latencies is None


def test_message_payload_and_headers(spark):
    df = spark.createDataFrame([(1, "a")], "id INT, s STRING")
    out = sinks.with_headers(df.select(sinks.payload("id", "s")), runId=F.lit("r1"), batchId=F.lit(7))
    got = out.select("value", header_value("headers", "batchId").alias("b"), header_value("headers", "none").alias("n")).first()
    assert tuple(got) == ('{"id":1,"s":"a"}', "7", None)


def test_bus_needs_its_connector(spark, data):
    with pytest.raises(Exception, match="(?i)kafka"):
        sinks.to_bus(as_stream(spark, load(spark, data, "region").select(sinks.payload("r_name"))), "h:1", "t", shared_dir(spark, "ck"))


@pytest.mark.parametrize("max_rows", [20, None])
def test_monitor_table_carries_its_state(spark, tmp_path, max_rows):
    """Two batches, the second partly older than the first, against the definition."""
    every = spark.range(400).select(
        "id", (F.col("id") % 3).cast("int").alias("city"), F.timestamp_seconds(F.abs(F.xxhash64("id")) % 500).alias("ts"),
        (F.abs(F.xxhash64("id", F.lit(3))) % 400 / 8).alias("temperature"), F.lit(1.0).alias("humidity"),
        F.lit(1.0).alias("co2_level"), F.lit(1.0).alias("pm25_level"))
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in ("id < 150", "id >= 150"):
        every.filter(part).write.mode("append").parquet(folder)
        finish(monitor_table(spark.readStream.schema(every.schema).parquet(folder), out, "city", "ts", "id", ck, max_rows))
    state, want = {}, []
    for batch in ("id < 150", "id >= 150"):
        for r in sorted(every.filter(batch).collect(), key=lambda r: (r.ts, r.id)):
            hot = state.setdefault(r.city, [])
            if r.temperature > 25:
                hot.append((r.ts, r.temperature))
            mean = (sum(t for _, t in hot) + r.temperature) / (len(hot) + 1)
            last = sorted(hot, key=lambda h: h[0])[-1][1] if hot else r.temperature
            trend = "rising" if r.temperature > last else "falling" if r.temperature < last else "stable"
            want.append((r.id, mean, trend, len(hot)))
    got = spark.read.parquet(out + "/rows").select("id", "hourly_avg_temp", "temperature_trend", "high_temp_count")
    assert [(g[0], round(g[1], 9), *g[2:]) for g in rows(got)] == [(w[0], round(w[1], 9), *w[2:]) for w in sorted(want, key=repr)]


@pytest.mark.parametrize("rows_per_batch", [7, 10_000])
def test_monitor_stream_does_not_depend_on_the_arrow_batch(spark, rows_per_batch):
    """300 rows of one city, out of order, in one micro-batch."""
    rng = random.Random(3)
    rows = [(i, 1, rng.randrange(200), float(rng.randrange(10, 40))) for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, city long, s long, temperature double").select(
        "event_id", "city", F.timestamp_seconds("s").alias("ts"), "temperature", F.lit(1.0).alias("humidity"),
        F.lit(1.0).alias("co2_level"), F.lit(1.0).alias("pm25_level"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        name = f"monitor_{rows_per_batch}"
        sinks.to_memory(monitor_stream(as_stream(spark, frame.coalesce(1), 1), "city", "ts", "event_id"), name,
                        shared_dir(spark, "ck")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    cols = ["event_id", "hourly_avg_temp", "temperature_trend", "high_temp_count"]
    want = {r.event_id: tuple(r) for r in monitor_batch(frame, "city", "ts", "event_id").select(*cols).collect()}
    got = {r.event_id: tuple(r) for r in spark.table(name).select(*cols).collect()}
    assert got == want


def test_snapshot_stream_takes_late_names_and_keeps_its_offset(tmp_path, monkeypatch):
    from weir.sources import state_vectors as sv

    def put(name, at):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, ns=(at, at))

    manifest = str(tmp_path / "taken")
    reader = sv.SnapshotStreamReader(str(tmp_path), manifest)
    put("b.json", 1000)
    first = reader.latestOffset()
    put("a.json", 1000)
    put("0.json", 2000)
    put("old.json", 1)                             # copied with its time: earlier than all that was taken
    second = reader.latestOffset()
    taken = lambda start, end: sorted(os.path.basename(f) for p in reader.partitions(start, end) for f in p.files)
    assert taken(reader.initialOffset(), first) == ["b.json"]
    assert taken(first, second) == ["0.json", "a.json", "old.json"] and taken(second, reader.latestOffset()) == []
    # another start: what was given out is the same, what comes in between is taken once
    put("c.json", 5)
    again = sv.SnapshotStreamReader(str(tmp_path), manifest)
    third = again.latestOffset()
    assert taken(second, third) == ["c.json"] and taken(first, third) == ["0.json", "a.json", "c.json", "old.json"]
    assert reader.latestOffset() == third
    monkeypatch.setattr(sv, "_snapshots", lambda path: (_ for _ in ()).throw(OSError("away")))
    assert reader.latestOffset() == third
    with pytest.raises(OSError):
        sv.SnapshotStreamReader(str(tmp_path), manifest).latestOffset()


def test_slow_progress_is_an_error(spark):
    q = sinks.to_memory(spark.readStream.format("rate").load(), "slow", shared_dir(spark, "ck"), "append",
                        sinks.trigger_options("processing_time", "1 hour"))
    with pytest.raises(TimeoutError):
        latency.collect_progress(q, 50, timeout=1)


def test_full_refresh_replaces(spark, tmp_path):
    table, checkpoint, source = (str(tmp_path / n) for n in "tcs")
    spark.range(5).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    append_new(stream(), table, checkpoint)
    full_refresh(stream().filter("id > 2"), table, checkpoint)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [3, 4]


def test_joined_streams_let_go_of_what_is_over(spark, tmp_path):
    from weir.streaming.pairs import bounded_join

    sizes = []
    for run in range(3):
        days = spark.range(run * 20, run * 20 + 20).withColumn("t", F.timestamp_seconds((F.col("id") + 1) * 86_400))
        days.select(F.col("id").alias("k"), "t").write.mode("append").parquet(str(tmp_path / "l"))
        days.filter("id % 2 = 0").select(F.col("id").alias("k"), "t", F.lit(1).alias("x")).write.mode("append").parquet(str(tmp_path / "r"))
        left = spark.readStream.schema("k long, t timestamp").parquet(str(tmp_path / "l"))
        right = spark.readStream.schema("k long, t timestamp, x int").parquet(str(tmp_path / "r"))
        joined = bounded_join(left.withColumnRenamed("t", "a"), right.withColumnRenamed("t", "b"), ["k"], "a", "b", "2 DAYS", "0 seconds")
        q = sinks.start(joined.select("k", "x"), "parquet", str(tmp_path / "c"), path=str(tmp_path / "out"))
        q.awaitTermination()
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    got = {r.k: r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 60 days: rows without a partner come out once two days have passed
    assert all(got[k] == 1 for k in range(0, 60, 2)) and all(got[k] is None for k in range(1, 55, 2)) and 59 not in got
    assert max(sizes) < 20


def test_copies_are_taken_once_and_leave_the_state(spark, tmp_path):
    from weir.streaming.pairs import first_of_copies

    sizes = []
    for run in range(3):
        days = spark.range(run * 20, run * 20 + 20).withColumn("t", F.timestamp_seconds((F.col("id") + 1) * 86_400))
        copies = days.unionAll(spark.range(max(0, run * 20 - 5), run * 20).withColumn("t", F.timestamp_seconds((F.col("id") + 1) * 86_400)))
        copies.unionAll(copies).write.mode("append").parquet(str(tmp_path / "l"))
        stream = spark.readStream.schema("id long, t timestamp").parquet(str(tmp_path / "l"))
        q = sinks.start(first_of_copies(stream, ["id"], "t", "10 days"), "parquet", str(tmp_path / "c"), path=str(tmp_path / "out"))
        q.awaitTermination()
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))
    assert max(sizes) <= 25
