"""Environment monitor: threshold alerts and a per-city average, trend and hot count.

A reading above the temperature limit joins its city's state before the state is read, so a
hot reading counts twice in its own average.  The state keeps count, sum and the newest hot
reading instead of the whole list; the results are the same and the state does not grow.
"""

from __future__ import annotations

import pickle
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weir.functions.fixed_values import ALERT_LIMITS
from weir.operators.ordered import HOT, SEG, null_safe_left_join, segment
from weir.session import remove_folder
from weir.streaming.sinks import to_batches

_HOT = ALERT_LIMITS["temperature"]
_UNITS = {"temperature": "°C", "humidity": "%", "co2_level": "ppm", "pm25_level": "µg/m³"}


def alerts() -> Column:
    """All alerts of a reading, each ended by ``;`` (empty if there is none).

    Each limit is compared with its own measure, pm2.5 included.
    """
    def one(name: str) -> Column:
        text = F.concat(F.lit(f"High {name} alert: "), F.col(name).cast("string"), F.lit(f" {_UNITS[name]};"))
        return F.when(F.col(name) > ALERT_LIMITS[name], text).otherwise("")

    return F.concat(*[one(n) for n in ALERT_LIMITS])


def monitor_batch(
    df: DataFrame, key: str, at: str, unique: str, max_rows: int | None = None, state: DataFrame | None = None,
) -> DataFrame:
    """The monitor over a table, readings taken in order of ``(at, unique)`` per key.

    A hot key is cut into time segments; count, sum and newest hot reading are carried over.
    ``state`` (see ``next_state``) holds what earlier tables left behind.
    """
    s = segment(df, [key], [at, unique], max_rows)
    upto = s.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = s.window.rowsBetween(Window.unboundedPreceding, -1)
    temp = F.col("temperature")
    hot = temp > _HOT
    hot_value, hot_reading = F.when(hot, temp), F.when(hot, F.struct(F.col(at).alias("at"), temp.alias("value")))
    rows = s.df.withColumns({
        "_cnt": F.count(hot_value).over(upto),
        "_sum": F.coalesce(F.sum(hot_value).over(upto), F.lit(0.0)),
        "_last": F.last(hot_reading, ignorenulls=True).over(before),
    })
    if s.split:
        earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        rows = s.carry(
            rows, {"_n": F.count(hot_value), "_s": F.sum(hot_value),
             "_l": F.max(F.when(hot, F.struct(F.col(at), F.col(unique), hot_reading.alias("r"))))},
            {"_c0": lambda w: F.sum("_n").over(earlier(w)),
             "_s0": lambda w: F.sum("_s").over(earlier(w)),
             "_l0": lambda w: F.last("_l.r", ignorenulls=True).over(earlier(w))},
        ).withColumns({
            "_cnt": F.col("_cnt") + F.coalesce("_c0", F.lit(0)),
            "_sum": F.col("_sum") + F.coalesce("_s0", F.lit(0.0)),
            "_last": F.coalesce("_last", "_l0")}).drop("_c0", "_s0", "_l0")
    if state is not None:
        kept = state.select(key, F.col("n").alias("_n0"), F.col("total").alias("_t0"),
                            F.struct("last.at", "last.value").alias("_k0"), F.col("last").isNotNull().alias("_has"))
        older = F.col("_has") & (F.col("_last").isNull() | (F.col("_k0.at") > F.col("_last.at")))
        rows = null_safe_left_join(rows, kept, [key]).withColumns({
            "_cnt": F.col("_cnt") + F.coalesce("_n0", F.lit(0)),
            "_sum": F.col("_sum") + F.coalesce("_t0", F.lit(0.0)),
            "_last": F.when(older, F.col("_k0")).otherwise(F.col("_last"))}).drop("_n0", "_t0", "_k0", "_has")
    avg = (F.col("_sum") + temp) / (F.col("_cnt") + 1)
    is_newest = F.col("_last").isNull() | (hot & (F.col(at) >= F.col("_last.at")))
    trend = (
        F.when(is_newest | (temp == F.col("_last.value")), "stable")
        .when(temp > F.col("_last.value"), "rising").otherwise("falling"))
    return rows.withColumns({
        "hourly_avg_temp": avg, "daily_avg_temp": avg, "temperature_trend": trend,
        "high_temp_count": F.col("_cnt").cast("int"), "alerts": alerts(),
    }).drop("_cnt", "_sum", "_last", SEG, HOT)


def next_state(df: DataFrame, key: str, at: str, unique: str, state: DataFrame | None = None) -> DataFrame:
    """Per key the hot count, hot sum and newest hot reading after ``df`` (combined before the
    shuffle; one row per key)."""
    new = df.filter(F.col("temperature") > _HOT).select(
        key, F.lit(1).cast("long").alias("n"), F.col("temperature").alias("total"),
        F.struct(F.col(at).alias("at"), F.lit(1).alias("late"), F.col(unique).cast("long").alias("unique"),
                 F.col("temperature").alias("value")).alias("last"))
    if state is not None:
        new = new.unionByName(state.withColumn("last", F.col("last").withField("late", F.lit(0))))
    return new.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))


def monitor_table(stream: DataFrame, path: str, key: str, at: str, unique: str, checkpoint: str, max_rows=None) -> StreamingQuery:
    """The monitor over a stream whose keys may be hot: every micro-batch is monitored as a
    table, a hot key in parallel, with the state of the batch before.

    Rows go to ``path/rows``, the state after each batch to ``path/state``; a repeated batch
    reads the same earlier state and replaces its own output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{path}/state/{batch_id - 1}") if batch_id else None
        batch = batch.persist()                 # taken from the source once, used three times
        rows = monitor_batch(batch, key, at, unique, max_rows, state)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch_no={batch_id}")
        next_state(batch, key, at, unique, state).write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
        batch.unpersist()
        if batch_id > 1:
            remove_folder(spark, f"{path}/state/{batch_id - 2}")     # no batch reads it any more

    return to_batches(stream, write, checkpoint)


def city_monitor(at: str, unique: str, columns: list[str], chunk: int = 200_000, block: int = 10_000,
                 fan: int = 16) -> StatefulProcessor:
    """Processor with the state (hot count, hot sum, newest hot time, its value) per key.

    A key's rows of one micro-batch are taken in order of ``(at, unique)`` however many Arrow
    batches they come in.  More than ``chunk`` rows are sorted through temporary files and worked on
    slice by slice, with the four numbers carried over: a task holds ``chunk`` rows, or ``fan`` blocks
    of ``block`` rows from each of the levels that merge ``fan`` files.  The class is made here so that
    it travels with the job: the driver's helper process, which looks at the processor first, does not
    see the package.
    """
    never = -(2**62)
    order = [at, unique, "_nth"]

    def stored(frames):
        """A sorted run in a file of its own, in blocks, and the way to read it once."""
        file = tempfile.TemporaryFile()
        for pdf in frames:
            for i in range(0, len(pdf), block):
                pickle.dump(pdf.iloc[i:i + block], file)
        end = file.tell()
        file.seek(0)
        while_left = lambda: file.tell() < end

        def read():
            with file:
                while while_left():
                    part = pickle.load(file)
                    yield part, while_left()

        return read()

    def merged(runs):
        """The rows of sorted runs in order, in slices: up to where the first run needs its next block."""
        pool, wanted = [], range(len(runs))
        while True:
            for r in wanted:
                part, more = next(runs[r])
                ends = np.full(len(part), -1)
                ends[-1] = r if more else -1
                pool.append(part.assign(_end=ends))
            rows = pd.concat(pool).sort_values(order, kind="stable")
            ends = rows["_end"].to_numpy()
            places = np.flatnonzero(ends >= 0)
            upto = places[0] + 1 if len(places) else len(rows)
            yield rows.iloc[:upto].drop(columns="_end")
            if not len(places):
                return
            pool, wanted = [rows.iloc[upto:]], [ends[places[0]]]

    def in_order(frames):
        """All rows sorted, in slices; every ``fan`` runs of a level become one of the next."""
        levels, held, size, nth = [[]], [], 0, 0
        for pdf in frames:
            held.append(pdf.assign(_nth=np.arange(nth, nth + len(pdf))))
            nth, size = nth + len(pdf), size + len(pdf)
            if size >= chunk:
                levels[0].append(stored([pd.concat(held).sort_values(order, kind="stable")]))
                held, size = [], 0
                for i, level in enumerate(levels):
                    if len(level) == fan:
                        if i + 1 == len(levels):
                            levels.append([])
                        levels[i + 1].append(stored(merged(level)))
                        level.clear()
        runs = [run for level in levels for run in level]
        last = [pd.concat(held).sort_values(order, kind="stable")] if size else []
        if not runs:
            yield from last
        else:
            yield from merged(runs + ([stored(last)] if last else []))

    class CityMonitor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("hot", "n LONG, total DOUBLE, at_us LONG, value DOUBLE")

        def handleInputRows(self, key, rows, timerValues):
            n, total, newest, value = self.state.get() if self.state.exists() else (0, 0.0, never, float("nan"))
            for pdf in in_order(rows):
                out = pdf[columns].copy()
                temp = pdf["temperature"].to_numpy(dtype="float64")
                when = pdf[at].to_numpy().astype("datetime64[us]").astype("int64")
                hot = temp > _HOT
                counts, sums = n + np.cumsum(hot), total + np.cumsum(np.where(hot, temp, 0.0))
                # newest hot reading so far: the state first, then every hot row that is not older
                times = np.concatenate(([newest], np.where(hot, when, never)))
                values = np.concatenate(([value], temp))
                peak = np.maximum.accumulate(times)
                is_peak = np.concatenate(([True], hot & (times[1:] >= peak[:-1])))
                last = values[np.maximum.accumulate(np.where(is_peak, np.arange(len(values)), 0))][1:]
                out["hourly_avg_temp"] = out["daily_avg_temp"] = (sums + temp) / (counts + 1)
                out["temperature_trend"] = np.select([temp > last, temp < last], ["rising", "falling"], "stable")
                out["high_temp_count"] = counts.astype("int32")
                n, total = int(counts[-1]), float(sums[-1])
                newest, value = int(peak[-1]), float(last[-1])
                yield out
            self.state.update((n, total, newest, value))

        def close(self) -> None:
            pass

    return CityMonitor()


def monitor_stream(df: DataFrame, key: str, at: str, unique: str) -> DataFrame:
    """The monitor over a stream (update mode; RocksDB state store).

    A key is handled by one task at a time, in bounded memory: use ``monitor_table`` where keys may be hot.
    """
    cols = df.columns
    added = "hourly_avg_temp DOUBLE, daily_avg_temp DOUBLE, temperature_trend STRING, high_temp_count INT"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = df.groupBy(key).transformWithStateInPandas(
        city_monitor(at, unique, cols), outputStructType=f"{fields}, {added}",
        outputMode="Update", timeMode="None")
    return rows.withColumn("alerts", alerts())
