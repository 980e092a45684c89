"""Per-run logic on the record stream (K1–K3).

State is keyed by run.  Rows of a micro-batch are ordered by ``source_index``
before use; the batch is bounded by the source's files per trigger.  A row at or
below the last index seen comes out flagged ``late`` and changes no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("source_index", kind="stable").reset_index(drop=True)


class _Segments(StatefulProcessor):
    def __init__(self, min_confidence: float):
        self.min_confidence = min_confidence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("segment", "last bigint, segment bigint, length bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, segment, length = self.state.get() if self.state.exists() else (-1, 0, 0)
        frame = _ordered(rows)
        late = frame["source_index"] <= last
        live = frame[~late].copy()
        conf = live["position_confidence"]
        live["rejected"] = conf.isna() | (conf < self.min_confidence)
        live["segment"] = segment + live["rejected"].cumsum()
        kept = (~live["rejected"]).astype(int)
        live["length"] = kept.groupby(live["segment"]).cumsum() + np.where(live["segment"] == segment, length, 0)
        live.loc[live["rejected"], "length"] = 0
        if len(live):
            tail = live.iloc[-1]
            self.state.update((int(tail["source_index"]), int(tail["segment"]), int(tail["length"])))
        out = pd.concat([live.assign(late=False), frame[late].assign(rejected=False, late=True)])
        yield _shaped(out.assign(run_id=key[0]), SEGMENT_ROWS)

    def close(self) -> None:
        pass


class _Drift(StatefulProcessor):
    def __init__(self, mode: str, min_conf: float):
        self.mode, self.min_conf = mode, min_conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", "last bigint, x bigint, y bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, *drift = self.state.get() if self.state.exists() else (-1, 0, 0)
        frame = _ordered(rows)
        late = frame["source_index"] <= last
        live = frame[~late].copy()
        hit = live["task_type"] == "CORRECTION"
        if self.mode != "accumulate":
            hit &= live["confidence"] >= self.min_conf
        for axis, start, moved in zip("xy", drift, ("dx", "dy")):
            if self.mode == "replace":
                after = (-live[moved]).where(hit).ffill().fillna(start)
            else:
                after = start + live[moved].where(hit, 0).cumsum()
            live[f"drift_{axis}"] = after.shift(1, fill_value=start).astype("int64")
            live[f"{axis}_drifted"] = live[f"{axis}_target"] + live[f"drift_{axis}"]
            drift["xy".index(axis)] = int(after.iloc[-1]) if len(live) else start
        if len(live):
            self.state.update((int(live["source_index"].iloc[-1]), *drift))
        old = frame[late]
        old = old.assign(x_drifted=old["x_target"], y_drifted=old["y_target"], late=True)
        yield _shaped(pd.concat([live.assign(late=False), old]).assign(run_id=key[0]), DRIFT_ROWS)

    def close(self) -> None:
        pass


class _Windows(StatefulProcessor):
    def __init__(self, window: int, min_conf: float | None):
        self.window, self.min_conf = window, min_conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "source_index bigint, tx double, ty double, ax double, ay double")
        self.last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past = [tuple(r) for r in self.history.get()] if self.history.exists() else []
        last = self.last.get()[0] if self.last.exists() else -1
        out = []
        for r in _ordered(rows).itertuples(index=False):
            if r.source_index <= last:
                continue
            last = r.source_index
            if self.min_conf is not None and r.confidence < self.min_conf and len(past) < self.window:
                continue
            past.append((r.source_index, float(r.x_target_abs), float(r.y_target_abs),
                         float(r.x_actual_abs), float(r.y_actual_abs)))
            past = past[-(self.window + 1):]
            if len(past) == self.window + 1:
                x0, y0 = past[1][1], past[1][2]
                out += [(key[0], r.source_index, k, t[1] - x0, t[2] - y0, a[3] - x0, a[4] - y0)
                        for k, (t, a) in enumerate(zip(past[1:], past[:-1]))]
        if past:
            self.history.put(past)
        self.last.update((int(last),))
        yield pd.DataFrame(out, columns=_names(WINDOW_ROWS))

    def close(self) -> None:
        pass


SEGMENT_ROWS = ("run_id string, source_index bigint, step bigint, position_confidence double, segment bigint, "
                "length bigint, rejected boolean, late boolean")
DRIFT_ROWS = ("run_id string, source_index bigint, x_drifted bigint, y_drifted bigint, drift_x bigint, "
              "drift_y bigint, late boolean")
WINDOW_ROWS = "run_id string, source_index bigint, k bigint, tx double, ty double, ax double, ay double"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _shaped(frame: pd.DataFrame, schema: str) -> pd.DataFrame:
    whole = [f.split()[0] for f in schema.split(", ") if f.endswith("bigint")]
    return frame.reindex(columns=_names(schema)).astype({c: "Int64" for c in whole})


def _run(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def stream_segments(stream: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """K1: every record with its running segment id and its length so far."""
    return _run(stream, _Segments(min_confidence), SEGMENT_ROWS)


def stream_drift(stream: DataFrame, mode: str = "accumulate", min_conf: float = 0.0) -> DataFrame:
    """K2: every task row with the drift in force before it."""
    if mode not in ("accumulate", "accumulate_gated", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    return _run(stream, _Drift(mode, min_conf), DRIFT_ROWS)


def stream_windows(stream: DataFrame, window: int, min_conf: float | None = None) -> DataFrame:
    """K3: the entries of each full model window; low-confidence rows are skipped while it first fills."""
    return _run(stream, _Windows(window, min_conf), WINDOW_ROWS)
