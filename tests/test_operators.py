"""Small cases for single operators, and invariance under the row layout."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import adaptive as A
from candlewick.operators import gate as H
from candlewick.operators import ingest as I
from candlewick.operators import price as P
from candlewick.operators import price_kernel as K
from candlewick.operators import transitions as T
from candlewick.operators import volume as V
from candlewick.operators.kernels import _first_rows
from candlewick.operators.segments import Layout
from candlewick.sources.feeds import decode_feed_json, read_bars_csv
from candlewick.sources.ticks import with_bar_fields
from candlewick.sources.transition_sink import read_slice, write_by_day, write_log
from candlewick.sources.transition_text import BLOCK_START, parse_footer, parse_transitions_text

T0 = datetime(2024, 1, 2, 14, 30, tzinfo=timezone.utc)


def bars(spark, rows, symbol="AAA"):
    """rows: (minute, close, volume) with optional symbol in front."""
    full = [(symbol, *r) if len(r) == 3 else r for r in rows]
    data = [(s, T0 + timedelta(minutes=m), float(c), float(c), float(c), float(c), int(v)) for s, m, c, v in full]
    df = spark.createDataFrame(data, "symbol string, interval_start timestamp, open double, high double, low double, close double, volume long")
    return with_bar_fields(df, source="CSV")


def walk(n, seed=7, symbol="AAA"):
    rng = np.random.default_rng(seed)
    price = 100 + np.cumsum(rng.normal(0, 0.3, n))
    minute = np.cumsum(rng.integers(1, 4, n))
    return [(symbol, int(m), float(p), int(v)) for m, p, v in zip(minute, price, rng.integers(0, 500, n))]


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- volume -------------------------------------------------------------------


def test_volume_first_available_rows(spark):
    out = V.volume_events(bars(spark, [(m, 10, 100 + m) for m in range(30)])).orderBy("rn").collect()
    first = {c: next(r.rn for r in out if r[c] is not None) for c in ("v_n", "v1", "interval_mean")}
    assert first == {"v_n": 15, "v1": 17, "interval_mean": 29}
    assert out[0].status == "MATURING" and out[28].status == "AVAILABLE"


def test_volume_zero_median_poisons_the_mean(spark):
    volumes = [10] * 29 + [0] * 8 + [10] * 30
    out = V.volume_events(bars(spark, [(m, 10, v) for m, v in enumerate(volumes)])).orderBy("rn").collect()
    poisoned = [r.rn for r in out if r.reason == "UNDEFINED_VN"]
    assert poisoned == list(range(37, 45))
    assert all(r.interval_mean is None for r in out if 37 <= r.rn <= 58)
    assert out[58].interval_mean == 1.0  # row 59: fifteen good values again
    assert out[58].transition == "PENDING_AMBER"  # RED from before the gap is remembered


@pytest.mark.parametrize(
    "raw, shown, texts",
    [
        ("GGRR", "GGAR", ["STABLE", "STABLE", "PENDING_RED", "CONFIRMED_RED"]),
        ("GRGG", "GAAG", ["STABLE", "PENDING_RED", "PENDING_GREEN", "CONFIRMED_GREEN"]),
        ("GGAA", "GGAA", ["STABLE", "STABLE", "PENDING_AMBER", "STABLE"]),
        ("GRAR", "GAAA", ["STABLE", "PENDING_RED", "STABLE", "PENDING_RED"]),
        ("AGRG", "AAAA", ["STABLE", "PENDING_GREEN", "PENDING_RED", "PENDING_GREEN"]),
    ],
)
def test_confirmation_sequences(spark, raw, shown, texts):
    name = {"G": "GREEN", "A": "AMBER", "R": "RED", ".": None}
    spread = ".".join(raw)  # an undefined row between any two
    df = spark.createDataFrame(
        [("AAA", T0 + timedelta(minutes=i), i + 1, i // 2, name[c]) for i, c in enumerate(spread)],
        "symbol string, interval_start timestamp, rn long, seg long, raw_color string",
    ).withColumn("_k", F.struct("symbol"))
    out = V.confirm_color(df, Layout.of(["symbol"])).orderBy("rn").collect()
    out = [r for r in out if r.raw_color]
    assert [r.indicator for r in out] == [name[c] for c in shown]
    assert [r.transition for r in out] == texts


# --- layouts give the same rows --------------------------------------------------


@pytest.mark.parametrize("rows", [64, 97])
def test_volume_is_independent_of_segments(spark, rows):
    b = bars(spark, walk(400) + walk(30, 3, "BBB"))
    cols = ["symbol", "rn", "v_n", "v1", "v2", "interval_mean", "indicator", "transition", "reason"]
    one = rows_of(V.volume_events(b), *cols)
    assert one == rows_of(V.volume_events(b, Layout.of(["symbol"], rows=rows)), *cols)


def test_price_is_independent_of_segments(spark):
    b = bars(spark, walk(300) + walk(60, 3, "BBB"))
    cols = ["symbol", "rn", "status", "emission.color", "cockpit.cockpit_color", "cockpit.candidate_age", "cockpit.persistence_count"]
    assert rows_of(P.price_events(b), *cols) == rows_of(P.price_events(b, Layout.of(["symbol"], rows=60)), *cols)


def test_decisions_are_independent_of_segments(spark):
    b = bars(spark, walk(2600))
    cols = ["rn", "side", "emitter_position", "model_health", F.round("c", 10), F.round("forward_half_life", 7), F.round("ref_alpha", 10)]
    one = rows_of(A.decisions(b).fillna("-", ["side", "emitter_position"]), *cols)
    split = A.decisions(b, Layout.of(["symbol"], rows=64)).fillna("-", ["side", "emitter_position"])
    assert one == rows_of(split, *cols)


@pytest.mark.parametrize("run, cols", [
    (V.volume_events, ["rn", "v_n", "interval_mean", "indicator", "transition"]),
    (P.price_events, ["rn", "status", "emission.p1", "emission.color", "cockpit.cockpit_color"]),
    (A.decisions, ["rn", "c", "strength", "side", "emitter_position"]),
])
def test_null_symbol_is_a_history_of_its_own(spark, run, cols):
    alone, named = bars(spark, walk(80)), bars(spark, walk(80, 3, "BBB"))
    nameless = bars(spark, walk(90, 5, "CCC")).withColumn("symbol", F.lit(None).cast("string"))
    both = run(nameless.unionByName(alone).unionByName(named))
    for symbol, single in (("AAA", run(alone)), ("BBB", run(named)), (None, run(nameless))):
        got = both.filter(F.col("symbol").eqNullSafe(F.lit(symbol)))
        assert list(map(repr, rows_of(got, *cols))) == list(map(repr, rows_of(single, *cols)))


def test_null_times_keep_their_rows(spark):
    b = bars(spark, walk(40)).withColumn("arrival", F.monotonically_increasing_id())
    odd = b.limit(3).withColumns({"interval_start": F.lit(None).cast("timestamp"), "arrival": F.col("arrival") + 10**15})
    nameless = odd.withColumns({"symbol": F.lit(None).cast("string"), "arrival": F.col("arrival") * 2})
    every = b.unionByName(odd).unionByName(nameless)
    assert V.volume_events(every).count() == 46 and P.price_events(every).count() == 46
    g = H.gate(every)
    assert g.count() == 46 and g.filter("committed").count() == 40
    out = H.decision_outcomes(g)
    assert out.count() == 46 and out.filter("side IS NOT NULL").count() == 25
    assert I.resolve_revisions_exact(every).count() == 42 == I.resolve_revisions(every).count()
    merged, counts = I.gap_fill(every.filter("interval_start IS NOT NULL"), nameless.withColumn("interval_start", F.lit(T0)), F.lit(T0))
    assert merged.count() == 41 and counts.collect()[0].symbol is None


def test_segment_borders_between_null_and_named_keys():
    key = pa.array([{"symbol": s} for s in (None, None, "A", "A", "B", None)], pa.struct([("symbol", pa.string())]))
    table = pa.table({"_k": key, "seg": [0, 0, 0, 1, 1, 1]})
    assert _first_rows(table, ["_k", "seg"]).tolist() == [0, 2, 3, 4, 5]
    assert _first_rows(pa.table({"symbol": [None, None, "A", "A", "B"]}), ["symbol"]).tolist() == [0, 2, 4]


def test_scans_equal_loops():
    rng = np.random.default_rng(4)
    position = np.concatenate([np.arange(300), np.arange(1), np.arange(77)])
    start, n = position == 0, len(position)
    price, step = 100 + np.cumsum(rng.normal(0, 0.3, n)), rng.uniform(0.7, 1.35, n)
    price[100:190] = price[100]
    away, scale = A._gap_and_scale(price, start, position, 0.0, 1.0)
    products = A._composed_products(step, position, 15.0, 900.0)
    ref = spread = half = None
    for i in range(n):
        ref = price[i] if start[i] else ref + A.REF_ALPHA * (price[i] - ref)
        spread = 1.0 if start[i] else max(0.95 * spread + 0.05 * abs(price[i] - ref), A.MIN_SCALE)
        half = min(900.0, max(15.0, step[i] * (120.0 if start[i] else half)))
        assert np.isclose(price[i] + away[i], ref, rtol=1e-12) and np.isclose(scale[i], spread, rtol=1e-9)
        assert np.isclose(min(products[2][i], max(products[1][i], products[0][i] * 120.0)), half, rtol=1e-12)


def test_price_frames_against_lstsq():
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(-900, 0, (50, K.POINTS)), axis=1)
    x[:, -1] = 0
    y = rng.normal(100, 5, x.shape)
    slope, curve, full = K.parabola(x, y)
    assert full.all()
    for i in range(len(x)):
        a, b, _ = np.linalg.lstsq(np.stack([x[i] ** 2, x[i], np.ones(K.POINTS)], axis=1), y[i], rcond=None)[0]
        assert np.isclose(slope[i], b, rtol=1e-8, atol=1e-10) and np.isclose(curve[i], 2 * a, rtol=1e-8, atol=1e-12)


def test_parabola_needs_distinct_times():
    x = np.linspace(-14, 0, K.POINTS)[None].copy()
    x[0, 3] = x[0, 4]
    assert not K.parabola(x, np.ones_like(x))[2][0]


# --- ingestion -------------------------------------------------------------------


def revision(spark, kinds):
    b = bars(spark, [(0, 10 + i, 5) for i in range(len(kinds))]).withColumn("arrival", F.col("close").cast("long"))
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("arrival") - 10).cast("int"))
    return b.withColumns(
        {
            "quality_status": F.when(kind == "P", "PARTIAL").when(kind == "R", "RECONSTRUCTED").otherwise("COMPLETE"),
            "is_final": kind != "P",
            "is_backfilled": kind == "R",
        }
    )


@pytest.mark.parametrize("kinds, winner", [("PP", 1), ("PC", 1), ("CP", 0), ("CR", 0), ("RC", 1), ("RP", 0), ("CC", 1), ("PRCP", 2), ("RPR", 2)])
def test_revision_rules(spark, kinds, winner):
    a = revision(spark, list(kinds))
    assert rows_of(I.resolve_revisions(a), "close") == [(10.0 + winner,)]
    assert rows_of(I.resolve_revisions_exact(a), "close") == [(10.0 + winner,)]


def test_exact_mode_keeps_partial_with_equal_values(spark):
    a = revision(spark, ["P", "C"]).withColumns({c: F.lit(10.0) for c in ("open", "high", "low", "close")}).withColumn("market_snapshot_id", F.lit("same"))
    assert rows_of(I.resolve_revisions(a), "quality_status") == [("COMPLETE",)]
    assert rows_of(I.resolve_revisions_exact(a), "quality_status") == [("PARTIAL",)]


def test_continuity_classes(spark):
    b = bars(spark, [(0, 1, 1), (1, 1, 1), (4, 1, 1), (4, 1, 1), (2, 1, 1), (5, 1, 1)]).withColumn("arrival", F.monotonically_increasing_id())
    order = b.coalesce(1).withColumn("arrival", F.monotonically_increasing_id())
    got = [r.continuity for r in I.classify_arrivals(order).orderBy("arrival").collect()]
    assert sorted(got) == sorted(["first", "normal", "irregular", "duplicate", "regression", "normal"])


def test_gate_latches_after_a_proven_loss(spark):
    b = bars(spark, [(m, 10, 1) for m in (0, 1, 5, 6, 7)]).withColumn("arrival", F.unix_seconds("interval_start"))
    g = H.gate(b.withColumn("proven_missing", F.col("interval_start") == F.lit(T0 + timedelta(minutes=5)))).orderBy("arrival").collect()
    assert [r.gate for r in g] == ["PASS", "PASS", "INPUT_GAP", "STATE_DISCONTINUOUS", "STATE_DISCONTINUOUS"]
    assert g[2].gate_detail.endswith("elapsed=4m0s proven_missing_eligible")


def test_feed_frames(spark):
    good = '{"T":"b","S":"AAA","o":1,"h":2,"l":1,"c":2,"v":"7","t":"2024-01-02T14:30:00Z","n":3}'
    frames = [
        f"[{good}]",
        '[{"T":"u","S":"AAA","o":1,"h":2,"l":1,"c":2,"v":7.9,"t":"2024-01-02 14:31:00"}, {"T":"success","msg":"connected"}]',
        '[{"T":"b","S":"AAA","o":1,"h":0.5,"l":1,"c":2,"v":7,"t":"2024-01-02T14:32:00Z"}]',  # high below low
        '[{"T":"b","S":"AAA","o":"1","h":2,"l":1,"c":2,"v":7,"t":"2024-01-02T14:33:00Z"}]',  # quoted price
        '[{"T":"b","S":"AAA","o":1,"h":2,"l":1,"c":2,"v":-7,"t":"2024-01-02T14:34:00Z"}]',  # negative volume
        "not json",
    ]
    out = decode_feed_json(spark.createDataFrame([(f,) for f in frames], "value string"), "ALPACA_IEX")
    assert rows_of(out, "quality_status", "volume", "event_count", "is_final") == [("COMPLETE", 7, 3, True), ("PARTIAL", 7, 0, False)]


def test_csv_bad_row_aborts(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    (tmp_path / "aaa_one.csv").write_text(head + "2024-01-02 14:30:00,1,2,1,2,5\n")
    assert rows_of(read_bars_csv(spark, str(tmp_path / "aaa_one.csv")), "symbol", "volume") == [("AAA", 5)]
    (tmp_path / "bad.csv").write_text(head + "soon,1,2,1,2,5\n")
    with pytest.raises(Exception, match="unreadable bar timestamp"):
        read_bars_csv(spark, str(tmp_path / "bad.csv"), "AAA").collect()


# --- transitions -----------------------------------------------------------------


def test_transitions_reset_and_numbering(spark):
    codes = [("HEALTHY", 0), ("HEALTHY", 0), ("FAILED", 0), ("FAILED", 1), ("HEALTHY", 1)]
    df = spark.createDataFrame([(i, c, e) for i, (c, e) in enumerate(codes)], "position long, c string, epoch int")
    ev = T.stage_events(df, "P01_MARKET_FEED", F.lit(""), F.col("position"), T.feed_state_row(F.col("c")))
    ev = ev.join(df.select("position", "epoch"), "position")
    out = T.transitions(ev).orderBy("sequence").collect()
    assert [(r.sequence, r.previous.code if r.previous else None, r.current.code) for r in out] == [
        (1, None, "HEALTHY"), (2, "HEALTHY", "FAILED"), (3, None, "FAILED"), (4, "FAILED", "HEALTHY"),
    ]
    assert out[0].transition_id == "P01_MARKET_FEED:GLOBAL:1"


def test_symbol_requests():
    with pytest.raises(ValueError):
        S.symbol_filter(None, ["AAA", " "])


def published(spark):
    from candlewick.plans import changes as C
    from candlewick.sources.ticks import event_bars

    outcomes = C.decision_events(event_bars(spark, "/root/testdata/sf0.001"))
    return T.transitions(outcomes).cache()


def test_rank_rule_equals_singular_values(spark):
    random = np.random.default_rng(5)
    near, far = -(10 ** random.uniform(0, 9, 3000)), 10 ** random.uniform(0, 9, 3000)
    rows = [(float(b - g), float(b)) for b, g in zip(near, far)]
    rows += [(-float(t) - 1, -1.0) for t in np.geomspace(1e6, 1e8, 60)] + [(-float(t) - 1, -float(t)) for t in np.geomspace(1e6, 1e8, 60)]
    df = spark.createDataFrame(rows, "a double, b double").select("a", "b", V.full_rank(F.col("a"), F.col("b")).alias("full"))
    seen = set()
    for a, b, full in df.collect():
        sizes = np.linalg.svd(np.array([[1, a, a * a], [1, b, b * b], [1, 0, 0]]), compute_uv=False)
        margin = sizes[2] / (3 * np.finfo(float).eps * sizes[0])
        if not 0.2 < margin < 5:  # nearer to the border the library's own rounding decides
            assert full == (margin > 1), (a, b)
            seen.add(full)
    assert seen == {True, False}


def test_log_counts_what_it_writes_and_refuses(spark, tmp_path):
    changes = published(spark)
    broken = changes.withColumn("transition_id", F.when(F.col("sequence") != 2, F.col("transition_id")))
    broken = broken.withColumn("reason_code", F.when(F.col("sequence") == 3, F.concat(F.lit("x\n"), F.lit(BLOCK_START))).otherwise(F.col("reason_code")))
    path = str(tmp_path / "log")
    write_log(broken.repartition(3), path)
    want = rows_of(changes.select("transition_id", "sequence"), "transition_id", "sequence")
    counts = parse_footer(spark, f"{path}/footer").collect()
    refused = [sum(s == n for _, s in want) for n in (2, 3)]
    assert [tuple(r) for r in counts] == [(len(want) - sum(refused), *refused)] and min(refused) > 0
    read = parse_transitions_text(spark, f"{path}/blocks").select("transition_id", "sequence").collect()
    assert sorted(tuple(r) for r in read) == sorted(t for t in want if t[1] not in (2, 3))
    write_log(changes.limit(0), str(tmp_path / "none"))
    assert [tuple(r) for r in parse_footer(spark, str(tmp_path / "none/footer")).collect()] == [(0, 0, 0)]


def test_slice_opens_only_the_days_it_needs(spark, tmp_path):
    changes, path = published(spark), str(tmp_path / "days")
    write_by_day(changes, path)
    first, last = changes.agg(F.min("effective_time"), F.max("effective_time")).first()
    cut = F.lit(last)
    got = read_slice(spark, path, cut)
    assert sorted(r.transition_id for r in got.collect()) == sorted(r.transition_id for r in changes.filter(F.col("effective_time") >= cut).collect())
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(effective_day" in plan
    opened = {r[0] for r in got.select("_metadata.file_path").collect()}
    assert all(last.strftime("%Y-%m-%d") in name for name in opened) and first.date() < last.date()
