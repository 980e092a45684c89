"""Streams give the batch rows when the same log is replayed file by file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stagelog.operators import features as Fe, segments as S
from stagelog.sources.logs import read_steps_stream
from stagelog.streaming.report import replay, stream_report
from stagelog.streaming.stateful import stream_drift, stream_segments, stream_windows, use_rocksdb

TASK = ("run_id string, source_index bigint, task_type string, x_target bigint, y_target bigint, dx bigint, dy bigint, confidence double")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    use_rocksdb(spark)
    rng = random.Random(4)
    rows = [{"run_id": run, "source_index": i, "event_time": f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00.000Z", "step": i,
             "x_target_abs": rng.randint(-99, 99), "y_target_abs": rng.randint(-99, 99), "x_actual_abs": rng.randint(-99, 99),
             "y_actual_abs": rng.randint(-99, 99), "confidence": rng.random(),
             "position_confidence": rng.choice([None, rng.random(), rng.random()])} for i in range(90) for run in "ab"]
    folder = tmp_path_factory.mktemp("log")
    for k in range(3):
        part = rows[k * 60: (k + 1) * 60]
        rng.shuffle(part)
        (folder / f"part{k}.json").write_text("\n".join(json.dumps(r) for r in part))
    import os
    for k in range(3):
        os.utime(folder / f"part{k}.json", (1_700_000_000 + 60 * k,) * 2)
    from stagelog.schema import STREAM_STEP
    return str(folder), spark.read.schema(STREAM_STEP).json(str(folder))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_segments(spark, log):
    got = replay(stream_segments(read_steps_stream(spark, log[0]), 0.5))
    want = S.mark_segments(log[1], min_confidence=0.5)
    cols = ("run_id", "source_index", "segment", "rejected")
    assert rows(got, *cols) == rows(want, *cols)
    lengths = {(r.run_id, r.segment): r.n for r in got.where("NOT rejected").groupBy("run_id", "segment").agg(F.max("length").alias("n")).collect()}
    counts = {(r.run_id, r.segment): r.records for r in S.segment_summary(want).collect()}
    assert lengths == counts


def test_windows(spark, log):
    got = replay(stream_windows(read_steps_stream(spark, log[0]), 4))
    want = Fe.model_windows(log[1], 4).select("run_id", "source_index", F.posexplode("window").alias("k", "e")).select(
        "run_id", "source_index", F.col("k").cast("bigint").alias("k"), "e.*")
    cols = ("run_id", "source_index", "k", "tx", "ty", "ax", "ay")
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("mode", ["accumulate", "accumulate_gated", "replace"])
def test_drift(spark, log, mode):
    kind = F.when(F.col("source_index") % 3 == 0, "CORRECTION").otherwise("EXPOSURE")
    cols = ["run_id", "source_index", kind.alias("task_type"), F.col("x_target_abs").alias("x_target"), F.col("y_target_abs").alias("y_target"),
            F.col("x_actual_abs").alias("dx"), F.col("y_actual_abs").alias("dy"), "confidence"]
    got = replay(stream_drift(read_steps_stream(spark, log[0]).select(*cols), mode, 0.5))
    want = Fe.accumulate_drift(log[1].select(*cols), mode, 0.5)
    out = ("run_id", "source_index", "drift_x", "drift_y", "x_drifted", "y_drifted")
    assert rows(got, *out) == rows(want, *out)


def test_late_rows_are_flagged(spark, log, tmp_path):
    import os
    (tmp_path / "1.json").write_text("\n".join(json.dumps({"run_id": "a", "source_index": i, "position_confidence": 0.9}) for i in (3, 4)))
    (tmp_path / "2.json").write_text("\n".join(json.dumps({"run_id": "a", "source_index": i, "position_confidence": 0.9}) for i in (2, 5)))
    for k in (1, 2):
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k,) * 2)
    got = replay(stream_segments(read_steps_stream(spark, str(tmp_path)), 0.5))
    assert rows(got, "source_index", "late", "length") == [(2, True, None), (3, False, 1), (4, False, 2), (5, False, 3)]


def test_report(spark, log):
    got = replay(stream_report(read_steps_stream(spark, log[0]), "5 minutes", "30 minutes"))
    counts = {(r.run_id, r.window_start.minute): r.n for r in got.collect()}
    assert counts == {(run, m): 30 for run in "ab" for m in (0, 30)}
