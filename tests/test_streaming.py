"""Stream = batch, also across a restart in the middle."""

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.catalog import streaming as catalog
from candlewick.operators import adaptive as A
from candlewick.operators import gate as H
from candlewick.operators import volume as V
from candlewick.streaming import engines as E
from candlewick.streaming import flows as L
from test_operators import bars, rows_of, walk


def _land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_restart_continues_from_stored_state(spark, tmp_path):
    L.configure(spark)
    b = bars(spark, walk(120) + walk(80, 3, "BBB")).cache()
    landing, sink, mark = (str(tmp_path / n) for n in ("landing", "sink", "mark"))
    middle = b.agg(F.percentile_approx("interval_start", 0.5)).first()[0]
    for keep in (F.col("interval_start") <= F.lit(middle), F.col("interval_start") > F.lit(middle)):
        _land(b.filter(keep), landing)
        L.run_to_parquet(L.stream_volume(L.read_bar_stream(spark, landing, b.schema)), sink, mark)
    cols = ["symbol", "rn", F.round("v_n", 12), "indicator", "transition"]
    batch = V.volume_events(b)
    assert rows_of(spark.read.parquet(sink).fillna("-").fillna(0.0), *cols) == rows_of(batch.fillna("-").fillna(0.0), *cols)


def test_decisions_stream_equals_batch(spark, tmp_path):
    L.configure(spark)
    b = bars(spark, walk(90)).cache()
    landing, sink, mark = (str(tmp_path / n) for n in ("landing", "sink", "mark"))
    _land(b.filter(F.col("interval_start") < "2024-01-02 15:30:00"), landing)
    _land(b.filter(F.col("interval_start") >= "2024-01-02 15:30:00"), landing)
    L.run_to_parquet(L.stream_decisions(L.read_bar_stream(spark, landing, b.schema)), sink, mark)
    cols = ["rn", F.round("c", 12), "side", "emitter_position", F.round("forward_half_life", 9)]
    assert rows_of(spark.read.parquet(sink).fillna("-"), *cols) == rows_of(A.decisions(b).fillna("-"), *cols)


def test_gated_stream_equals_batch_with_unreadable_late_repeated_and_reset_rows(spark, tmp_path):
    L.configure(spark)
    b = bars(spark, walk(120) + walk(70, 3, "BBB")).withColumn("arrival", F.row_number().over(Window.orderBy("interval_start", "symbol")).cast("long") * 10)
    again = b.filter("arrival % 170 = 0").withColumn("arrival", F.col("arrival") + 5)
    late = b.filter("arrival % 210 = 0").withColumn("arrival", F.col("arrival") + 92)
    blind = b.filter("arrival % 130 = 0").withColumns({"arrival": F.col("arrival") + 3, "close": F.lit(float("nan")), "interval_start": F.col("interval_start") + F.expr("INTERVAL 20 SECONDS")})
    nowhen = b.filter("arrival % 500 = 0").withColumns({"arrival": F.col("arrival") + 4, "interval_start": F.lit(None).cast("timestamp")})
    a = b.unionByName(again).unionByName(late).unionByName(blind).unionByName(nowhen)
    a = a.withColumns({"infer": F.col("arrival") % 90 != 0, "proven_missing": F.col("arrival").isin(*range(1300, 1480, 10))}).cache()
    resets = spark.createDataFrame([("AAA", 700), ("BBB", 701), ("AAA", 1500)], "symbol string, arrival long")
    paths = {n: str(tmp_path / n) for n in ("arrivals", "resets", "sink", "mark")}
    for low, high in ((0, 605), (605, 1200), (1200, 10**6)):  # restarted twice
        for df, n in ((a, "arrivals"), (resets, "resets")):
            _land(df.filter((F.col("arrival") >= low) & (F.col("arrival") < high)), paths[n])
        flow = L.stream_gate(L.read_bar_stream(spark, paths["arrivals"], a.schema), L.read_bar_stream(spark, paths["resets"], resets.schema))
        L.run_to_parquet(L.stream_outcomes(flow), paths["sink"], paths["mark"])
    want = H.decision_outcomes(H.gate(H.with_reset_epoch(a, resets)))
    numbers = [F.round(c, 9).alias(c) for c in ("c", "strength", "uncertainty")]
    cols = ["symbol", "epoch", "interval_start", "market_snapshot_id", "side", "path_direction", "emitter_position", "skip_reason", "arrival", "model_status", "rule_path",
            "accepted_sequence", "skip_detail", "event_id"]
    got = spark.read.parquet(paths["sink"]).select(*cols, *numbers)
    want = want.select(*cols, *numbers)
    assert got.count() == a.count()
    assert [got.exceptAll(want).collect(), want.exceptAll(got).collect()] == [[], []]
    assert {r.skip_reason for r in got.collect()} >= {"INFER_OFF", "DUPLICATE_OR_REGRESSION", "INVALID_INPUT", "INPUT_GAP", "STATE_DISCONTINUOUS", "INITIALIZING", None}


def test_window_forgets_what_it_evicts_also_across_a_restart(spark, tmp_path):
    L.configure(spark)
    b = bars(spark, [(m, 10 + m, 5) for m in (3, 4, 5, 6, 1, 1, 4, 7, 3)]).withColumn("is_backfilled", F.col("close") == 11)
    rows = b.collect()
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*b.schema.fields, T.StructField("arrival", T.LongType())]))
    nowhen = numbered.filter("arrival = 2").withColumns({"interval_start": F.lit(None).cast("timestamp"), "arrival": F.lit(20).cast("long")})
    landing, sink, mark = (str(tmp_path / n) for n in ("landing", "sink", "mark"))
    for part in (numbered.filter("arrival < 5"), numbered.filter("arrival >= 5").unionByName(nowhen)):
        _land(part, landing)
        L.run_to_parquet(L.stream_window(L.read_bar_stream(spark, landing, numbered.schema), 3), sink, mark)
    minute = lambda t: None if t is None else round((t.timestamp() - rows[0].interval_start.timestamp()) / 60) + 3
    got = [(r.arrival, minute(r.interval_start), r.accepted, minute(r.evicted), r.held) for r in spark.read.parquet(sink).orderBy("arrival").collect()]
    assert got == [
        (0, 3, True, None, 1), (1, 4, True, None, 2), (2, 5, True, None, 3), (3, 6, True, 3, 3),
        (4, 1, True, 1, 3), (5, 1, True, 1, 3),  # older than all: goes at once, and may come again
        (6, 4, False, None, 3), (7, 7, True, 4, 3), (8, 3, True, 3, 3), (20, None, False, None, 3),
    ]


def test_missing_beats_count_without_a_row(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    beat = lambda name, m: (name, start + timedelta(minutes=m))
    slices = [[beat("a", 0), beat("b", 0), beat("a", 1)], [beat("b", m) for m in range(1, 8)], [beat("a", 9), beat("b", 9), beat("b", 9), (None, start)]]
    schema = "symbol string, beat timestamp"

    def run(parts, name):
        path = str(tmp_path / name)
        L.configure(spark)
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
            flow = L.stream_feed_watch(L.read_bar_stream(spark, f"{path}/in", T.StructType.fromDDL(schema)), 120, "30 seconds")
            L.run_to_parquet(flow, f"{path}/out", f"{path}/checkpoint")
        got = spark.read.parquet(f"{path}/out").filter("symbol IS NOT NULL").collect()
        return sorted((r.symbol, int((r["at"] - start.replace(tzinfo=None)).total_seconds() // 60), r.misses, r.component) for r in got)

    whole = run([sum(slices, [])], "one")
    assert run(slices, "three") == whole
    assert [x[1:3] for x in whole if x[0] == "a"] == [(0, 0), (1, 0), (3, 1), (5, 2), (7, 3), (9, 0)]
    assert [x[1:3] for x in whole if x[0] == "b"] == [*((m, 0) for m in range(8)), (9, 0)]
    assert {x[3] for x in whole if x[2] >= 3} == {"UNAVAILABLE"}


class _Handle:
    """What the feed watch asks of its state, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return self.timers

    def deleteTimer(self, timer):
        self.timers = [t for t in self.timers if t != timer]

    def registerTimer(self, timer):
        self.timers = [*self.timers, timer]


def test_feed_watch_tells_many_beats_in_few_frames():
    every, at, beats = 60, 0, []
    for n in range(40_000):
        at += (1 + n * n % 17 * 13) * 1_000_000
        beats.append(at)
    want, last = [], None
    for beat in beats:
        moments = range(last + every * 1_000_000, beat, every * 1_000_000) if last is not None else ()
        want += [*((m, n + 1) for n, m in enumerate(moments)), (beat, 0)]
        last = beat
    engine, frames = E.FeedWatch(every), []
    engine.init(_Handle())
    for part in (beats[:7], beats[3:20_000], beats[20_000:]):  # the second repeats some of the first
        frames += engine.handleInputRows(("a",), iter([pd.DataFrame({"beat": pd.to_datetime(part, unit="us")})]), None)
    assert len(frames) < 10
    got = pd.concat(frames)
    assert sorted(zip(got["at"].astype("datetime64[us]").astype("int64"), got["misses"])) == sorted(want)


def test_live_tail_aggregates_the_ticks_once(spark, monkeypatch):
    read = []
    made = V.volume_events
    monkeypatch.setattr(V, "volume_events", lambda b: (read.extend(b.inputFiles()), made(b))[1])
    assert catalog.live_tail()(spark, "/root/testdata/sf0.001").count() > 0
    assert read and not any(f.endswith("events.parquet") for f in read)
