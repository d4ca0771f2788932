"""Keyed state for streams: the batch kernels, continued from stored values.

One state per symbol, a few hundred numbers, kept by Spark's state store.  Rows of
a micro-batch are sorted by event time inside the handler, because Spark promises
no order within a key; a row at or before the last accepted one becomes a typed
skip instead of disturbing the models.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlewick.operators import adaptive as A
from candlewick.operators import price_kernel as K
from candlewick.operators import volume as V
from candlewick.operators.kernels import Block

DUPLICATE = "DUPLICATE_OR_REGRESSION"


_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def layout(text: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no session, so workers can import it."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))])


class KeyedFold(StatefulProcessor):
    """State is one JSON text per key; subclasses give ``fresh`` and ``advance``."""

    order: tuple[str, ...] = ("interval_start",)
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "json string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(list(self.order), kind="stable", ignore_index=True)
        state = json.loads(self._state.get()[0]) if self._state.exists() else self.fresh()
        state, out = self.advance(state, batch)
        self._state.update((json.dumps(state),))
        if len(out):
            yield out[self.columns]

    def close(self) -> None:
        pass

    def fresh(self) -> dict:
        raise NotImplementedError

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        raise NotImplementedError


class CompositeFold(KeyedFold):
    """Scalars in one typed value state, the last values of bounded sequences in list states."""

    scalars: str
    rings: dict[str, str] = {}  # name -> type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._names = layout(self.scalars).fieldNames()
        self._value = handle.getValueState("scalars", layout(self.scalars))
        self._lists = {name: handle.getListState(name, layout(f"{name} {kind}")) for name, kind in self.rings.items()}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(list(self.order), kind="stable", ignore_index=True)
        state = self.fresh()
        if self._value.exists():
            state |= dict(zip(self._names, self._value.get()))
            state |= {name: [v[0] for v in held.get()] for name, held in self._lists.items() if held.exists()}
        state, out = self.advance(state, batch)
        self._value.update(tuple(state[n] for n in self._names))
        for name, held in self._lists.items():
            if state[name]:
                held.put([(v,) for v in state[name]])
            else:
                held.clear()
        if len(out):
            yield out[self.columns]


def accept(rows: pd.DataFrame, last: int | None) -> tuple[np.ndarray, int | None]:
    """Mask of rows strictly later than everything accepted before them."""
    stamps = rows["interval_start"].astype("datetime64[us]").astype("int64").to_numpy()
    running = np.maximum.accumulate(np.concatenate([[last if last is not None else np.iinfo("int64").min], stamps]))
    return stamps > running[:-1], int(running[-1])


def _nullable(values: np.ndarray) -> np.ndarray:
    out = values.astype(object)
    out[np.isnan(values)] = None
    return out


def _with_skips(rows: pd.DataFrame, keep: np.ndarray, made: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Accepted rows with their results, the others with a reason."""
    made = made.assign(skip_reason=None)
    late = rows.loc[~keep].assign(skip_reason=DUPLICATE).reindex(columns=names)
    return made.reindex(columns=names) if late.empty else pd.concat([made.reindex(columns=names).astype(object), late.astype(object)])


class BarWindow(StatefulProcessor):
    """The newest ``limit`` bars of a symbol under the revision rules, in a map state by start time.

    Rows come in the order of their arrival.  A bar that the window does not hold is put in its place and
    the oldest one goes, even if that is the new one; what has gone is forgotten, so that it may come again.
    One that it holds is replaced unless it repeats the held one, would take finality back, or is a repair of a live one.
    """

    order = ("arrival", "interval_start")
    held = layout("arrival long, market_snapshot_id string, is_final boolean, is_backfilled boolean, live boolean, facts string")
    schema = layout("symbol string, interval_start timestamp, arrival long, accepted boolean, evicted timestamp, held long")

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._bars = handle.getMapState("bars", layout("start long"), self.held)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(list(self.order), kind="stable", ignore_index=True)
        before = {k[0]: tuple(v) for k, v in self._bars.iterator()}
        window, names, out = dict(before), self.held.fieldNames(), []
        starts = batch["interval_start"].astype("datetime64[us]").astype("int64")
        for start, known, values in zip(starts.tolist(), batch["interval_start"].notna().tolist(), batch[names].itertuples(index=False, name=None)):
            gone = None
            accepted = known and (start not in window or self.supersedes(window[start], values))
            if accepted:
                window[start] = values
                if len(window) > self.limit:
                    gone = min(window)
                    del window[gone]
            out.append((accepted, gone, len(window)))
        for start in before.keys() - window.keys():
            self._bars.removeKey((start,))
        for start, values in window.items():
            if before.get(start) != values:
                self._bars.updateValue((start,), values)
        accepted, gone, size = zip(*out)
        evicted = pd.to_datetime(pd.Series(gone, dtype="Int64"), unit="us")
        yield batch.assign(accepted=accepted, evicted=evicted, held=size)[self.schema.fieldNames()]

    @staticmethod
    def supersedes(old: tuple, new: tuple) -> bool:
        _, old_id, old_final, _, old_live, old_facts = old
        _, new_id, new_final, new_repair, _, new_facts = new
        same = bool(old_id) and old_id == new_id or old_facts == new_facts
        return not (same or old_final and not new_final or old_live and new_repair)

    def close(self) -> None:
        pass


class AdaptiveState(KeyedFold):
    """Per-row model state (same columns as the batch kernel)."""

    schema = T.StructType(
        [
            T.StructField("symbol", T.StringType()),
            T.StructField("interval_start", T.TimestampType()),
            T.StructField("rn", T.LongType()),
            T.StructField("event_time", T.DoubleType()),
            T.StructField("skip_reason", T.StringType()),
            T.StructField("block_start", T.BooleanType()),
            *A.STATE_FIELDS,
        ]
    )
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"n": 0, "last": None, "carried": None}

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        refused = rows["skip_reason"].notna() if "skip_reason" in rows else pd.Series(False, rows.index)
        parts = [rows.loc[refused].reindex(columns=self.columns).astype(object)]  # not for the model: passed on
        rows = rows.loc[~refused].drop(columns="skip_reason", errors="ignore").reset_index(drop=True)
        if len(rows):
            state, made = self.step(state, rows)
            parts.append(made.astype(object))
        return state, pd.concat(parts)

    def step(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        keep, last = accept(rows, state["last"])
        new = rows.loc[keep].reset_index(drop=True)
        if new.empty:
            return state, _with_skips(rows, keep, new, self.columns)
        new["rn"] = state["n"] + 1 + np.arange(len(new))
        new["halo"] = False
        block = Block(pa.Table.from_pandas(new, preserve_index=False), np.array([0]))
        results = A.adaptive_kernel(block, state["carried"])
        made = new.assign(block_start=np.arange(len(new)) == 0, **results)
        end = made.iloc[-1]
        carried = {name: float(end[name]) for name in A.CARRIED}
        return {"n": int(end["rn"]), "last": last, "carried": carried}, _with_skips(rows, keep, made, self.columns)


class Decide(KeyedFold):
    """Context of the previous 15 scores, decision, position, half-life, rate, health."""

    order = ("rn",)
    passed = ("symbol", "interval_start", "skip_reason")  # of a row that the model has refused
    schema = layout(
        "symbol string, interval_start timestamp, rn long, c double, path_direction string, side string, emitter_position string, "
        "prior_median_c double, up_count long, down_count long, forward_half_life double, ref_alpha double, model_health string, skip_reason string"
    )
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"scores": [], "paths": [], "position": "FLAT", "half": A.HALF_LIFE[0], "rate": A.RATE[0], "gap": False, "poor": False}

    def advance(self, s: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        out = []
        for row in rows.to_dict("records"):
            if isinstance(row["skip_reason"], str):  # refused by the model: passed on as it is
                out.append({name: row[name] for name in self.passed})
                continue
            # The composed steps count from the start of the upstream block.
            if row["block_start"]:
                s["half0"], s["rate0"] = s["half"], s["rate"]
            s["half"] = min(row["half_hi"], max(row["half_lo"], row["half_gain"] * s["half0"]))
            s["rate"] = min(row["rate_hi"], max(row["rate_lo"], s["rate0"] + row["rate_shift"]))
            left = s["rate0"] + row["rate_min"] < A.RATE[1] or s["rate0"] + row["rate_max"] > A.RATE[2]
            s["gap"] |= bool(row["data_gap"])
            s["poor"] |= left or row["clipped"] > 0
            up, down = s["paths"].count("UPWARD"), s["paths"].count("DOWNWARD")
            side = median = None
            if len(s["scores"]) == A.CONTEXT:
                median = sorted(s["scores"])[A.CONTEXT // 2]
                good = row["h"] == 1 and row["c"] >= median
                side = "HOLD"
                if good and row["path_direction"] == "UPWARD" and up >= down:
                    side, s["position"] = "BUY", "LONG"
                elif good and row["path_direction"] == "DOWNWARD" and down >= up:
                    side, s["position"] = "SELL", "SHORT"
            s["scores"] = (s["scores"] + [row["c"]])[-A.CONTEXT :]
            s["paths"] = (s["paths"] + [row["path_direction"]])[-A.CONTEXT :]
            health = (
                "DEGRADED_DATA" if s["gap"] else "DEGRADED_NUMERICAL" if s["poor"] else "PERTURBED" if row["perturbation_magnitude"] > 0.7 else "HEALTHY"
            )
            out.append(
                {
                    **row, "side": side, "emitter_position": s["position"] if side else None, "prior_median_c": median, "up_count": up,
                    "down_count": down, "forward_half_life": s["half"], "ref_alpha": s["rate"], "model_health": health,
                    "skip_reason": None if side else "INITIALIZING",
                }
            )
        return s, pd.DataFrame(out).reindex(columns=self.columns)


class Gate(CompositeFold):
    """What the gate of an arrival looks at: epoch, last committed time, the step from it, a proven gap, the latch.

    Rows are arrivals (kind 1) and resets (kind 0), in the order of their arrival numbers; a reset forgets all.
    """

    order = ("arrival", "kind")
    scalars = "epoch long, last long, latched boolean"
    extra = "arrival long, market_snapshot_id string, price double, v_raw double, eligible boolean, infer boolean, may_commit boolean"
    schema = layout(f"symbol string, interval_start timestamp, {extra}, epoch long, last_start timestamp, step string, gap boolean, latched boolean")
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"epoch": 0, "last": None, "latched": False}

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        parts, resets = [], (rows["kind"] == 0).to_numpy()
        for _, part in rows.groupby(np.cumsum(resets)):
            if part["kind"].iloc[0] == 0:
                state = {"epoch": int(part["arrival"].iloc[0]), "last": None, "latched": False}
                part = part.iloc[1:]
            if len(part):
                state, made = self._within(state, part)
                parts.append(made)
        return state, pd.concat(parts) if parts else pd.DataFrame(columns=self.columns)

    @staticmethod
    def _within(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        none = np.iinfo("int64").min
        known = rows["interval_start"].notna().to_numpy()
        at = np.where(known, rows["interval_start"].astype("datetime64[us]").astype("int64").to_numpy(), none)
        commit = rows["may_commit"].to_numpy(bool)
        first = none if state["last"] is None else state["last"]
        running = np.maximum.accumulate(np.concatenate([[first], np.where(commit, at, none)]))
        last, minute = running[:-1], 60_000_000
        elapsed = at - np.where(last == none, at, last)
        step = np.select(
            [~known | (at % minute != 0), last == none, elapsed == 0, elapsed < 0, elapsed == minute],
            ["unaligned", "first", "duplicate", "regression", "normal"], "irregular",
        )
        gap = rows["infer"].to_numpy(bool) & rows["eligible"].to_numpy(bool) & (step == "irregular") & rows["proven_missing"].to_numpy(bool)
        before = np.logical_or.accumulate(np.concatenate([[state["latched"]], gap]))
        stamps = pd.Series(pd.to_datetime(np.where(last == none, 0, last), unit="us"), index=rows.index).where(last != none)
        made = rows.assign(epoch=state["epoch"], last_start=stamps, step=step, gap=gap, latched=before[:-1])
        end = None if running[-1] == none else int(running[-1])
        return {"epoch": state["epoch"], "last": end, "latched": bool(before[-1])}, made


class GatedState(AdaptiveState):
    """Model state of the committed arrivals, afresh in every epoch; other arrivals pass with their reason."""

    order = ("arrival",)
    schema = T.StructType([*AdaptiveState.schema.fields, *layout("arrival long, epoch long, market_snapshot_id string, skip_detail string").fields])
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"epoch": None, "model": super().fresh()}

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        parts = []
        for epoch, part in rows.groupby("epoch", sort=True):  # epochs rise with the arrivals
            if epoch != state["epoch"]:
                state = {"epoch": int(epoch), "model": super().fresh()}
            state["model"], made = super().advance(state["model"], part)
            parts.append(made)
        return state, pd.concat(parts)


class GatedDecide(CompositeFold, Decide):
    """Decisions of the committed arrivals, afresh in every epoch."""

    order = ("arrival",)
    passed = ("symbol", "interval_start", "arrival", "epoch", "market_snapshot_id", "skip_reason", "skip_detail")
    scalars = "epoch long, position string, half double, rate double, half0 double, rate0 double, gap boolean, poor boolean"
    rings = {"scores": "double", "paths": "string"}
    schema = T.StructType([*Decide.schema.fields, *layout("arrival long, epoch long, market_snapshot_id string, skip_detail string, strength double, uncertainty double").fields])
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return Decide.fresh(self) | {"epoch": None, "half0": A.HALF_LIFE[0], "rate0": A.RATE[0]}

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        parts = []
        for epoch, part in rows.groupby("epoch", sort=True):
            if epoch != state["epoch"]:
                state = self.fresh() | {"epoch": int(epoch)}
            state, made = Decide.advance(self, state, part)
            parts.append(made.astype(object))
        return state, pd.concat(parts)


class PriceNumbers(KeyedFold):
    """Price kernel on the stored tail plus the new rows."""

    schema = T.StructType(
        [
            T.StructField("symbol", T.StringType()),
            T.StructField("interval_start", T.TimestampType()),
            T.StructField("rn", T.LongType()),
            T.StructField("skip_reason", T.StringType()),
            *K.FIELDS,
        ]
    )
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"n": 0, "last": None, "minutes": [], "close": []}

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        keep, last = accept(rows, state["last"])
        new = rows.loc[keep].reset_index(drop=True)
        if new.empty:
            return state, _with_skips(rows, keep, new, self.columns)
        minutes = np.concatenate([state["minutes"], new["minutes"].to_numpy()])
        close = np.concatenate([state["close"], new["close"].to_numpy()])
        n, total = state["n"], state["n"] + len(new)
        rn = np.arange(total - len(close) + 1, total + 1)
        block = Block(pa.table({"minutes": minutes, "close": close, "rn": rn}), np.array([0]))
        results = {k: (_nullable(v[-len(new) :]) if v.dtype.kind == "f" else v[-len(new) :]) for k, v in K.price_kernel(block).items()}
        made = new.assign(rn=n + 1 + np.arange(len(new)), **results)
        state = {"n": total, "last": last, "minutes": minutes[-K.HALO :].tolist(), "close": close[-K.HALO :].tolist()}
        return state, _with_skips(rows, keep, made, self.columns)


class PriceColors(KeyedFold):
    """Debounced colour and cockpit state, one emitted row after the other."""

    order = ("rn",)
    schema = layout(
        "symbol string, interval_start timestamp, rn long, raw_color string, color string, cockpit_color string, refined_state string, "
        "turn_candidate string, candidate_age long, persistence_count long, status string, skip_reason string"
    )
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"color": None, "cockpit": None, "opposing": None, "opposing_n": 0, "candidate": None, "candidate_n": 0}

    def advance(self, s: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        reverse = {("GREEN", "RED"), ("RED", "GREEN")}
        shade = {"UP": "GREEN", "DOWN": "RED"}
        out = []
        for row in rows.to_dict("records"):
            if row["status"] not in ("EMITTED", "RK45_FAILURE"):  # a typed skip
                out.append({name: row[name] for name in ("symbol", "interval_start", "rn", "status", "skip_reason")})
                continue
            raw, direction = row["raw_color"], row["raw_direction"]
            color = "AMBER" if (s["color"], raw) in reverse else raw
            opposing, candidate = row["opposing"] or None, row["crossing"] or row["slowing"] or None
            opposing_n = 0 if opposing is None else s["opposing_n"] + 1 if opposing == s["opposing"] else 1
            candidate_n = 0 if candidate is None else s["candidate_n"] + 1 if candidate == s["candidate"] else 1
            turned = candidate is None and (s["cockpit"], shade.get(direction)) in reverse
            if not row["usable"]:
                cockpit, refined = "INVALID", "INVALID"
            elif direction == "NEAR_ZERO":
                cockpit, refined = "AMBER", "NEAR_STATIONARY"
            elif candidate is not None:
                cockpit, refined = "AMBER", f"TURN_{candidate}_CANDIDATE"
            elif turned:
                cockpit, refined = "AMBER", "DIRECTION_CHANGE_TRANSITION"
            else:
                cockpit, refined = shade[direction], row["motion"]
            s = {"color": color, "cockpit": cockpit, "opposing": opposing, "opposing_n": opposing_n, "candidate": candidate, "candidate_n": candidate_n}
            out.append(
                {
                    **row, "color": color, "cockpit_color": cockpit, "refined_state": refined, "turn_candidate": candidate or "NONE",
                    "candidate_age": candidate_n, "persistence_count": opposing_n,
                }
            )
        return s, pd.DataFrame(out).reindex(columns=self.columns)


class VolumeActivity(KeyedFold):
    """Volume features and confirmed colour per row."""

    schema = layout(
        "symbol string, interval_start timestamp, rn long, skip_reason string, v_raw double, v_n double, interval_mean double, "
        "v1 double, v2 double, raw_color string, indicator string, transition string"
    )
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"n": 0, "last": None, "at": [], "v": [], "p1": None, "p2": None}

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        keep, last = accept(rows, state["last"])
        new = rows.loc[keep].reset_index(drop=True)
        if new.empty:
            return state, _with_skips(rows, keep, new, self.columns)
        at = np.concatenate([state["at"], new["interval_start"].astype("datetime64[us]").astype("int64").to_numpy() / 6e7])
        v = np.concatenate([state["v"], new["v_raw"].to_numpy()])
        size, fresh_rows = len(v), len(new)
        v_n, mean = np.full(size, np.nan), np.full(size, np.nan)
        with np.errstate(all="ignore"):
            if size >= V.RAW_WINDOW:
                median = np.sort(np.lib.stride_tricks.sliding_window_view(v, V.RAW_WINDOW), axis=1)[:, 7]
                v_n[V.RAW_WINDOW - 1 :] = np.where(median > 0, v[V.RAW_WINDOW - 1 :] / median, np.nan)
            if size >= V.MEAN_WINDOW:
                mean[V.MEAN_WINDOW - 1 :] = np.lib.stride_tricks.sliding_window_view(v_n, V.MEAN_WINDOW).mean(axis=1)
            v1, v2 = np.full(size, np.nan), np.full(size, np.nan)
            if size >= V.FIT_POINTS:
                x0, x1 = at[:-2] - at[2:], at[1:-1] - at[2:]
                f01, f12 = (v_n[1:-1] - v_n[:-2]) / (x1 - x0), (v_n[2:] - v_n[1:-1]) / (-x1)
                design = np.stack([np.stack([np.ones(len(x0)), x, x * x], axis=1) for x in (x0, x1, np.zeros(len(x0)))], axis=1)
                full = np.linalg.matrix_rank(design) == V.FIT_POINTS  # same cutoff: 3 * eps * largest
                a = np.where(full, (f12 - f01) / (-x0), np.nan)
                v1[2:], v2[2:] = f12 - a * x1, 2.0 * a
        p1, p2, labels = state["p1"], state["p2"], []
        for m in mean[-fresh_rows:].tolist():
            raw = None if np.isnan(m) else "GREEN" if m >= V.UPPER else "RED" if m <= V.LOWER else "AMBER"
            shown = text = None
            if raw is not None:
                waiting = p1 is not None and p2 is not None and p1 != p2
                shown = raw if p1 is None or raw == p1 else "AMBER"
                if p1 is None or (raw == p1 and not (waiting and raw != "AMBER")) or (raw != p1 and raw == "AMBER" and waiting):
                    text = "STABLE"
                else:
                    text = f"{'CONFIRMED' if raw == p1 else 'PENDING'}_{raw}"
                p1, p2 = raw, p1
            labels.append((raw, shown, text))
        made = new.assign(
            rn=state["n"] + 1 + np.arange(fresh_rows),
            **{name: _nullable(x[-fresh_rows:]) for name, x in (("v_n", v_n), ("interval_mean", mean), ("v1", v1), ("v2", v2))},
            **dict(zip(("raw_color", "indicator", "transition"), zip(*labels))),
        )
        tail = V.HALO
        state = {"n": state["n"] + fresh_rows, "last": last, "at": at[-tail:].tolist(), "v": v[-tail:].tolist(), "p1": p1, "p2": p2}
        return state, _with_skips(rows, keep, made, self.columns)


class Changes(KeyedFold):
    """Publish a row only when the compared state differs from the last published one."""

    order = ("position",)
    schema = layout(
        "stage_id string, entity_id string, position long, sequence long, transition_id string, prev_code string, code string"
    )
    columns = schema.fieldNames()

    def fresh(self) -> dict:
        return {"n": 0, "compared": None, "code": None}

    def advance(self, s: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        out = []
        for row in rows.to_dict("records"):
            if row["compared"] == s["compared"]:
                continue
            n = s["n"] + 1
            out.append({**row, "sequence": n, "transition_id": f"{row['stage_id']}:{row['entity_id']}:{n}", "prev_code": s["code"]})
            s = {"n": n, "compared": row["compared"], "code": row["code"]}
        return s, pd.DataFrame(out, columns=[*rows.columns, "sequence", "transition_id", "prev_code"])


def _micros(column: pd.Series) -> np.ndarray:
    return column.astype("datetime64[us]").astype("int64").to_numpy()


class Tail(StatefulProcessor):
    """Live events behind a stored snapshot: what the snapshot or an earlier event already told is not told again.

    State of a symbol: the time of its newest event and the ids told at that time.  It begins as the snapshot's row.
    """

    def __init__(self, names: list[str], schema: T.StructType):
        self.names, self.schema = names, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._told = handle.getValueState("told", "at long, ids string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._told.update((int(_micros(initialState["interval_start"])[0]), json.dumps(initialState["event_id"].tolist())))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, ids = None, []
        if self._told.exists():
            at, ids = self._told.get()[0], json.loads(self._told.get()[1])
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["interval_start", "event_id"], kind="stable", ignore_index=True)
        batch = batch[batch["interval_start"].notna()].drop_duplicates(["interval_start", "event_id"])
        start = _micros(batch["interval_start"])
        new = np.ones(len(batch), bool) if at is None else (start > at) | ((start == at) & ~batch["event_id"].isin(ids).to_numpy())
        batch, start = batch[new], start[new]
        if len(batch):
            newest = int(start[-1])
            told = batch["event_id"][start == newest].tolist()
            self._told.update((newest, json.dumps(told + (ids if newest == at else []))))
            yield batch[self.names]

    def close(self) -> None:
        pass


class FeedWatch(StatefulProcessor):
    """A row per heartbeat and per moment at which one was due; the timer speaks where no row comes.

    ``misses`` counts the moments missed since the last beat.  Which rows result depends on the beats and the
    last watermark only, not on how beats fall into micro-batches.
    """

    schema = layout("symbol string, at timestamp, misses long")
    #: Beats told in one frame; a frame of its own for every beat costs far more than its rows.
    BLOCK = 16_384

    def __init__(self, every_seconds: int):
        self.every = every_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "beat long, misses long")

    def _row(self, key: Any, at: np.ndarray, misses: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"symbol": key[0], "at": pd.to_datetime(at, unit="us"), "misses": misses})

    def _missed(self, key: Any, beat: int, misses: int, before: int) -> tuple[int, pd.DataFrame]:
        """Moments due after ``beat`` and before ``before`` that were not told yet."""
        due = max((before - beat - 1) // self.every, misses)
        numbers = np.arange(misses + 1, due + 1)
        return due, self._row(key, beat + numbers * self.every, numbers)

    def _between(self, key: Any, told: np.ndarray, misses: int, beats: np.ndarray) -> pd.DataFrame:
        """Each of ``beats`` and the moments missed since the one before it in ``told``; of the first of these, ``misses`` are told."""
        known = np.zeros(len(beats), "int64")
        known[:1] = misses
        due = np.maximum((beats - told - 1) // self.every, known)
        missed = due - known
        first = np.cumsum(missed) - missed
        numbers = np.arange(missed.sum()) - np.repeat(first - known, missed) + 1
        at = np.repeat(told, missed) + numbers * self.every
        return self._row(key, np.concatenate([at, beats]), np.concatenate([numbers, np.zeros(len(beats), "int64")]))

    def _wait(self, beat: int, misses: int) -> None:
        self._seen.update((beat, misses))
        self._handle.registerTimer(-(-(beat + (misses + 1) * self.every) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        beats = np.unique(_micros(pd.concat([r["beat"].dropna() for r in rows])))
        last, misses = self._seen.get() if self._seen.exists() else (None, 0)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if last is not None:
            beats = beats[beats > last + misses * self.every]
        elif len(beats):
            last, beats = int(beats[0]), beats[1:]
            yield self._row(key, np.array([last]), np.array([0]))
        for start in range(0, len(beats), self.BLOCK):
            block = beats[start : start + self.BLOCK]
            yield self._between(key, np.concatenate([[last], block[:-1]]), misses, block)
            last, misses = int(block[-1]), 0
        if last is not None:
            self._wait(last, misses)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, misses = self._seen.get()
        misses, missed = self._missed(key, last, misses, timerValues.getCurrentWatermarkInMs() * 1000 + 1)
        self._wait(last, misses)
        yield missed

    def close(self) -> None:
        pass
