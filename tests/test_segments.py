"""Segmentation: the published golden case, rejection rules, writing."""

import json

import pytest

from stagelog.operators import segments as S

# Rejected record numbers and segment lengths of the golden log.
REJECTED = [int(v) for v in """56 94 178 184 203 328 343 355 373 376 433 458 621 683 756 798 824 907 922
1058 1077 1113 1231 1235 1279 1315 1319 1335 1415 1432 1442 1453 1455 1462 1505
1542 1688 1715 1776 1781 1871 1905 1984 2109 2153 2163 2354 2393 2405 2492 2532
2567 2608 2622 2632 2672 2689 2763 2821 2905 2975 2997 3032""".split()]
LENGTHS = [int(v) for v in """56 37 83 5 18 124 14 11 17 2 56 24 162 61 72 41 25 82 14 135 18 35 117 3
43 35 3 15 79 16 9 10 1 6 42 36 145 26 60 4 89 33 78 124 43 9 190 38 11
86 39 34 40 13 9 39 16 73 57 83 69 21 34 3""".split()]

SCHEMA = "run_id string, source_index bigint, step bigint, img_path string, position_confidence double"


def log(frame, confidences, run="r"):
    return frame([(run, i, i, f"temp\\a_{i}.bmp", c) for i, c in enumerate(confidences)], SCHEMA)


@pytest.mark.parametrize("width", [50, 1 << 20])
def test_golden_manifest(frame, width):
    bad = set(REJECTED)
    steps = log(frame, [0.5 if i in bad else 0.95 for i in range(3036)], "log_clean")
    marked = S.mark_segments(steps, min_confidence=0.7, width=width)
    summary = S.segment_summary(marked, 1, width)
    plan = sorted(S.plan_segments(summary).collect(), key=lambda r: r.part)
    assert [r.records for r in plan] == LENGTHS
    assert (plan[0].segment_file, plan[-1].segment_file) == (
        "log_clean_part001_steps0000-0055", "log_clean_part064_steps3033-3035")
    head = S.build_manifest(marked, summary, 0.7).first()
    assert (head.input_records, head.discarded_count, head.segment_count, head.written_records) == (3036, 63, 64, 2973)
    assert max(LENGTHS) == 190 and min(LENGTHS) == 1
    rows, discarded = S.segment_runs(steps, min_confidence=0.7, width=width)
    assert rows.count() == 2973
    assert sorted(r.source_index for r in discarded.collect()) == REJECTED
    assert [tuple(r) for r in S.discard_reasons(discarded).collect()] == [("log_clean", "below-threshold", 63)]


def test_rules(frame):
    nan = float("nan")
    steps = log(frame, [0.9, nan, None, 0.8, 0.79, 0.95, 0.96])
    rows, discarded = S.segment_runs(steps, min_confidence=0.8, min_length=2, confidence_field="score")
    assert sorted((r.source_index, r.part) for r in rows.collect()) == [(0, 1), (1, 1), (5, 2), (6, 2)]
    assert "score" in rows.columns and "position_confidence" not in rows.columns
    assert sorted((r.source_index, r.reason) for r in discarded.collect()) == [(2, "missing-position"), (4, "below-threshold")]
    plain, _ = S.segment_runs(steps, min_confidence=0.8, confidence_field=None)
    assert "position_confidence" not in plain.columns
    marked = S.mark_segments(steps, min_confidence=0.8)
    short = [r for r in S.segment_summary(marked, 2).collect() if r.part is None]
    assert [(r.records, r.first_step, r.last_step) for r in short] == [(1, 3, 3)]


def test_step_gap_does_not_close_a_segment(frame):
    steps = frame([("r", 0, 0, "a", 0.9), ("r", 1, 7, "b", 0.9), ("r", 2, 3, "c", 0.9)], SCHEMA)
    out = S.segment_summary(S.mark_segments(steps)).collect()
    assert [(r.records, r.first_step, r.last_step) for r in out] == [(3, 0, 3)]


def test_arguments(frame):
    steps = log(frame, [0.9])
    with pytest.raises(ValueError):
        S.mark_segments(steps, min_confidence=1.5)
    with pytest.raises(ValueError):
        S.segment_summary(S.mark_segments(steps), 0)


def test_write_refuses_to_overwrite(spark, frame, tmp_path):
    steps = log(frame, [0.9, 0.9, 0.1, 0.9])
    rows, discarded = S.segment_runs(steps)
    summary = S.segment_summary(S.mark_segments(steps))
    plan, out = S.plan_segments(summary), str(tmp_path / "segments")
    S.write_segments(rows, plan, out)
    folder = tmp_path / "segments" / "run_id=r"
    lines = [json.loads(x) for p in sorted((folder / "segment_file=r_part001_steps0000-0001").glob("*.json"))
             for x in p.read_text().splitlines()]
    assert [x["step"] for x in lines] == [0, 1] and lines[0]["position_confidence"] == 0.9
    assert sorted(p.name for p in folder.iterdir()) == [
        "segment_file=r_part001_steps0000-0001", "segment_file=r_part002_steps0003-0003"]
    with pytest.raises(Exception, match="(?i)already exists"):
        S.write_segments(rows, plan, out)
    S.write_segments(rows, plan, out, overwrite=True)
    head = S.build_manifest(S.mark_segments(steps), summary)
    S.write_manifest(head, S.manifest_entries(discarded, summary), str(tmp_path / "manifest"))
    kept = spark.read.json(str(tmp_path / "manifest" / "entries"))
    assert sorted(r.section for r in kept.collect()) == ["discarded_records", "segments", "segments"]
