"""Tailed logs and the live report against batch results: torn lines, restarts, late references, repeated batches."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from stagelog.operators.quality import agreement_report
from stagelog.queries import QUERIES, streams  # noqa: F401
from stagelog.schema import STREAM_STEP
from stagelog.sources import tail
from stagelog.sources.versions import VersionedTable, committed
from stagelog.streaming.live import LiveReport, follow


def drain(stream, home):
    """Rows written so far, after everything there is now was taken."""
    stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/progress").trigger(
        availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_ranges_own_the_lines_that_start_in_them(size, tmp_path):
    text = "a\n\nbb\r\nlonger line of text\n" + "x" * 200 + "\nä€\nlast\ntorn"
    (tmp_path / "log").write_bytes(text.encode())
    data = text.encode()
    with open(tmp_path / "log", "rb") as file:
        stop = tail.complete_until(file, 0, len(data))
        assert stop == data.rindex(b"\n") + 1 and tail.complete_until(file, stop, len(data)) == stop
        for first in (0, 2, 3):  # starts of lines
            want, at = [], first
            for line in data[first:stop].split(b"\n")[:-1]:
                want.append((at, line))
                at += len(line) + 1
            got = [x for b in range(first, stop, size) for x in tail.lines_in(file, b, min(b + size, stop), stop, first)]
            assert got == want


def test_long_lines_are_found_across_blocks(tmp_path):
    data = b"y" * (3 * tail.BLOCK) + b"\n" + b"z" * (2 * tail.BLOCK + 5) + b"\nend"
    (tmp_path / "log").write_bytes(data)
    with open(tmp_path / "log", "rb") as file:
        stop = tail.complete_until(file, 0, len(data))
        assert stop == len(data) - 3
        ranges = [(b, min(b + 1000, stop)) for b in range(0, stop, 1000)]
        got = [x for b, e in ranges for x in tail.lines_in(file, b, e, stop)]
    assert [(at, len(line)) for at, line in got] == [(0, 3 * tail.BLOCK), (3 * tail.BLOCK + 1, 2 * tail.BLOCK + 5)]


def test_appended_lines_arrive_once(spark, tmp_path):
    log, home = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    (log / "_hidden").write_text("no\n")
    first = log / "a.jsonl"
    first.write_text("one\ntwo\nthr")
    stream = tail.tail_lines(spark, str(log), range_bytes=3)
    assert sorted(r.value for r in drain(stream, home).collect()) == ["one", "two"]
    assert drain(stream, home).count() == 2  # nothing new
    with open(first, "a") as f:
        f.write("ee\nfour\n")
    (log / "b.jsonl").write_text("five\nsix")
    rows = drain(tail.tail_lines(spark, str(log), range_bytes=3), home).collect()  # as after a restart
    assert sorted(r.value for r in rows) == ["five", "four", "one", "three", "two"]
    assert {r.value: r.offset for r in rows} == {"one": 0, "two": 4, "three": 8, "four": 14, "five": 0}
    (log / "b.jsonl").write_text("five\nsix\n")
    assert sorted(r.value for r in drain(stream, home).collect()) == ["five", "four", "one", "six", "three", "two"]
    first.write_text("one\n")
    with pytest.raises(Exception, match="shrunk"):
        drain(stream, home)


def test_no_folder_and_empty_files(spark, tmp_path):
    stream = tail.tail_lines(spark, str(tmp_path / "none"))
    assert drain(stream, str(tmp_path / "out")).count() == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty").write_text("")
    assert drain(stream, str(tmp_path / "out")).count() == 0


def test_malformed_records(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a").write_text('{"run_id": "r", "step": 1}\n\n  \n{"run_id": \n{"run_id": "s", "step": 2}\n')
    rows = drain(tail.tail_steps(spark, str(tmp_path / "log"), mode="permissive"), str(tmp_path / "out")).collect()
    assert sorted((r.run_id, r.step) for r in rows) == [("r", 1), ("s", 2)]
    with pytest.raises(Exception, match="malformed record"):
        drain(tail.tail_steps(spark, str(tmp_path / "log")), str(tmp_path / "strict"))
    with pytest.raises(ValueError):
        tail.tail_steps(spark, "x", mode="lax")


def record(rng, run, i):
    return {"run_id": run, "source_index": i, "event_time": f"2024-01-0{1 + i // 50}T{i % 24:02d}:00:00.000Z", "step": i,
            **{f"{a}_{k}_abs": rng.randint(-10**6, 10**6) for a in "xy" for k in ("target", "actual")}}


@pytest.fixture(scope="module")
def steps():
    rng = random.Random(2)
    rows = [record(rng, run, i) for run, n in (("a", 120), ("b", 30), ("alone", 1), ("pair", 2)) for i in range(n)]
    rows += [record(rng, "lost", i) for i in range(3, 9)]  # never a reference
    for r in rows:
        if r["run_id"] == "b":  # follows its targets
            r["x_actual_abs"], r["y_actual_abs"] = r["x_target_abs"] + rng.randint(-9, 9), r["y_target_abs"] + 5
    rows.append({**rows[5], "source_index": 5000, "event_time": None})
    rng.shuffle(rows)
    return rows


def figures(df, *keys):
    names = ("n", "x_agree", "y_agree", "x_r", "y_r", "x_mae", "y_mae", "x_agree_pct", "y_agree_pct", "verdict")
    return {tuple(r[k] for k in keys): [round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names] for r in df.collect()}


def test_live_report_equals_the_batch_report(spark, tmp_path, steps):
    log, report = tmp_path / "log", LiveReport(spark, str(tmp_path / "live"), window="1 day", every=2)
    log.mkdir()
    for k in range(5):  # appended to two files in turn, each time up to a torn line
        text = "".join(json.dumps(r) + "\n" for r in steps[k::5])
        with open(log / f"{k % 2}.json", "a") as f:
            f.write(text)
        follow(tail.tail_steps(spark, str(log), range_bytes=500), report)
    whole = spark.read.schema(STREAM_STEP).json(str(log))
    assert whole.count() == len(steps)
    assert figures(report.runs(), "run_id") == figures(agreement_report(whole), "run_id")
    day = F.window("event_time", "1 day")["start"]
    starts = whole.where("step = 0").select("run_id", F.col("x_target_abs").alias("rx"), F.col("y_target_abs").alias("ry"))
    # per window: the same report with each run's reference repeated in each of its windows
    dated = whole.where("event_time is not null").withColumn("window_start", day)
    marks = dated.select("run_id", "window_start").distinct().join(starts, "run_id").select(
        "run_id", "window_start", F.lit(-1).cast("bigint").alias("source_index"), F.lit(-1).cast("bigint").alias("step"), F.col("rx").alias("x_target_abs"),
        F.col("ry").alias("y_target_abs"), F.col("rx").alias("x_actual_abs"), F.col("ry").alias("y_actual_abs"))
    both = dated.where("step <> 0").select(*marks.columns).unionByName(marks)
    want = figures(agreement_report(both, ref_step=-1, by=("run_id", "window_start")), "run_id", "window_start")
    got = figures(report.windows().where("window_start is not null"), "run_id", "window_start")
    assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in want.items() if v[0]}
    assert figures(report.windows().where("window_start is null"), "run_id")[("a",)][0] == 1
    kept = committed(spark, f"{report.path}/states")
    assert len(kept) <= 2 * report.every + 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path, steps):
    frame = spark.createDataFrame(spark.sparkContext.emptyRDD(), STREAM_STEP)
    schema = frame.schema
    (tmp_path / "rows").mkdir()
    for k in range(2):
        (tmp_path / "rows" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in steps[k::2]))
    parts = [spark.read.schema(schema).json(str(tmp_path / "rows" / f"{k}.json")) for k in range(2)]
    report = LiveReport(spark, str(tmp_path / "live"), window="1 day", every=2)
    report.update(parts[0], 0)
    report.update(parts[1], 1)
    before = figures(report.windows(), "run_id", "window_start")
    report.update(parts[1], 1)
    assert figures(report.windows(), "run_id", "window_start") == before
    report.update(parts[0].limit(0), 2)
    assert figures(report.windows(), "run_id", "window_start") == before
    assert LiveReport(spark, str(tmp_path / "new")).runs().count() == 0


def test_versions(spark, tmp_path):
    schema = spark.createDataFrame([("k", 1)], "key string, value bigint").schema
    table = VersionedTable(spark, str(tmp_path / "t"), ["key"], schema, every=3)
    for n in range(11):
        table.write(n, spark.createDataFrame([(f"k{n % 4}", n), ("all", n)], schema))
        assert {r.key: r.value for r in table.latest().collect()} == {"all": n} | {f"k{m % 4}": m for m in range(max(0, n - 3), n + 1)}
        assert {r.key: r.value for r in table.latest(n).collect()} == ({"all": n - 1} | {f"k{m % 4}": m for m in range(max(0, n - 4), n)} if n else {})
    os.remove(tmp_path / "t" / "batch=10" / "_SUCCESS")  # a write that did not end
    assert {r.key: r.value for r in table.latest().collect()}["all"] == 9


@pytest.mark.parametrize("name", ["streamed_segments", "streamed_drift", "streamed_windows"])
def test_streams_read_a_table_that_is_a_folder(spark, tmp_path, name):
    source = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(source).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    assert QUERIES[name](spark, str(tmp_path)).count() == QUERIES[name](spark, os.path.dirname(source)).count()
