"""Scalar rules: labels, units, roundings, recalculation identity, agreement verdicts."""

import pytest
from pyspark.sql import functions as F

from stagelog.functions import rows as R, units as U
from stagelog.operators import quality as Q


def values(frame, rows, schema, column):
    return [r[0] for r in frame(rows, schema).select(column.alias("v")).collect()]


def test_names_and_labels(frame):
    paths = [("temp/a.bmp",), ("temp\\b c.bmp",), ("d.bmp",), ("x/y\\z.png",)]
    assert values(frame, paths, "p string", U.filename(F.col("p"))) == ["a.bmp", "b c.bmp", "d.bmp", "z.png"]
    got = values(frame, [("7",), ("-7",), ("12345",), ("end now!",), ("a.b-c_d",)], "p string", U.safe_label(F.col("p")))
    assert got == ["0007", "-007", "12345", "end_now_", "a.b-c_d"]


def test_units(frame):
    got = values(frame, [("15nm",), (" 15 nm",), ("1.5um",), ("-0.9mm",), ("2e-1 um",)], "p string", U.to_nm(F.col("p")))
    assert got == [15, 15, 1500, -900000, 200]
    for bad in ("1.5nm", "3", "3cm", ""):
        with pytest.raises(Exception, match="not a length"):
            values(frame, [(bad,)], "p string", U.to_nm(F.col("p")))
    assert values(frame, [("1.5nm",)], "p string", U.to_nm(F.col("p"), strict=False)) == [None]
    assert values(frame, [("45deg",), ("3.141592653589793rad",)], "p string", U.to_degrees(F.col("p"))) == [45.0, 180.0]


def test_three_roundings(frame):
    assert values(frame, [(0.5,), (-0.5,), (1.5,), (2.5,)], "p double", U.px_to_nm(F.col("p"), 1.0)) == [1, -1, 2, 3]
    half = U.mosaic_to_nm(F.col("p"), F.lit(0), F.lit(0), 1, 1.0)
    assert values(frame, [(0.5,), (1.5,), (2.5,)], "p double", half) == [0, 2, 2]
    moved = U.rotate_move(frame([(100, 135.0)], "move bigint, r_target double")).first()
    assert (moved.x_move, moved.y_move) == (-70, 70)


def test_steps_and_flags(frame):
    out = R.normalise_steps(frame([("3", "0.9980"), ("end", "x")], "step string, confidence string")).collect()
    assert [(r.step, r.is_final, r.confidence) for r in out] == [(3, False, 0.998), (None, True, None)]
    s = R.match_status(frame([(0.8,), (0.79996,)], "confidence double")).collect()
    assert [(r.status, r.confidence) for r in s] == [("OK", 0.8), ("LOW", 0.8)]
    g = R.gate_command(frame([(5.0, 1, 1, 9, 9), (6.0, 1, 1, 9, 9)],
                             "error_nm double, x_target bigint, y_target bigint, x_command bigint, y_command bigint"), 5)
    assert [(r.compensated, r.x_command) for r in g.collect()] == [(True, 9), (False, 1)]
    assert values(frame, [(1152.0,), (1153.0,)], "p double", R.overlaps(F.col("p"), F.lit(0), 1280, 1280)) == [True, False]


def test_recalculation_identity(frame):
    """Largest difference to the published formula is zero."""
    px = [(1897, 1776)] + [(1897 + 7 * i - 300, 1776 - 11 * i + 500) for i in range(1, 200)]
    steps = frame([("r", i, i, f"a_{i}.bmp", -17250 if i == 0 else 0, -37800 if i == 0 else 0, 5, 6) for i in range(200)] + [
        ("r", 200, 200, "missing.bmp", 1, 2, 3, 4)],
        "run_id string, source_index bigint, step bigint, img_path string, x_target_abs bigint, y_target_abs bigint, x_actual_abs bigint, y_actual_abs bigint")
    old = [("r", "a_0.bmp", 0, 1, 1, 1, 1, 0.1)]
    pos = frame(old + [("r", f"a_{i}.bmp", i + 1, x, y, 10, 10, 0.9) for i, (x, y) in enumerate(px)],
                "run_id string, filename string, entry bigint, x bigint, y bigint, w bigint, h bigint, confidence double")
    out = {r.source_index: r for r in Q.recalculate_positions(steps, pos).collect()}
    for i, (x, y) in enumerate(px):
        assert out[i].x_actual_abs == round(-17250 - (x - 1897) * 12.40234)
        assert out[i].y_actual_abs == round(-37800 + (y - 1776) * 12.40234)
    assert (out[0].x_actual_abs, out[0].y_actual_abs) == (-17250, -37800)
    assert not out[200].updated and (out[200].x_actual_abs, out[200].y_actual_abs) == (3, 4)
    c = Q.update_counts(Q.recalculate_positions(steps, pos)).first()
    assert (c.updated, c.skipped) == (200, 1)
    with pytest.raises(Exception, match="no located reference"):
        Q.recalculate_positions(steps, pos.where("filename <> 'a_0.bmp'")).collect()


AGREE = "run_id string, source_index bigint, step bigint, x_target_abs bigint, y_target_abs bigint, x_actual_abs bigint, y_actual_abs bigint"


def test_agreement(frame):
    def run(name, rows):
        return [(name, i, i, *r) for i, r in enumerate(rows)]

    ramp = [(100 * i, -50 * i) for i in range(6)]
    rows = (run("perfect", [(x, y, x, y) for x, y in ramp]) + run("flat", [(5, y, 5, y) for _, y in ramp])
            + run("single", [(0, 0, 0, 0), (1, 1, 1, 1)]) + run("inverted", [(x, y, -x, y) for x, y in ramp])
            + run("zero", [(0, 0, 0, 0)] * 4) + run("alone", [(0, 0, 0, 0)]) + [("lost", 0, 5, 1, 1, 1, 1), ("lost", 1, 6, 1, 1, 1, 1)])
    out = {r.run_id: r for r in Q.agreement_report(frame(rows, AGREE)).collect()}
    p = out["perfect"]
    assert (p.n, p.x_agree, p.y_agree, p.verdict, p.x_mae) == (5, 5, 5, "GOOD", 0.0) and p.x_r == pytest.approx(1)
    assert out["flat"].x_r == 0.0 and out["flat"].verdict == "LOW"
    assert out["single"].verdict == "INSUFFICIENT"
    assert out["inverted"].verdict == "LOW" and out["inverted"].x_agree == 0
    for run in ("alone", "lost"):
        assert (out[run].n, out[run].verdict, out[run].x_mae) == (0, "INSUFFICIENT", None)
    assert (out["zero"].x_agree, out["zero"].verdict) == (0, "LOW")


def test_layout_anchor_without_image(frame):
    steps = frame([("r", 0, "a.bmp", 1000, 2000), ("r", 1, "b.bmp", 1000 - 1240, 2000 + 2480)],
                  "run_id string, source_index bigint, img_path string, x_target_abs bigint, y_target_abs bigint")
    images = frame([("r", "b.bmp")], "run_id string, filename string")
    rows = Q.layout_px(steps, images, nm_per_px=12.4).collect()
    assert [(r.tile_id, r.x_px, r.y_px) for r in rows] == [(0, pytest.approx(100), pytest.approx(200))]
    have, lack = Q.split_by_image(steps, images)
    assert ([r.filename for r in have.collect()], [r.filename for r in lack.collect()]) == (["b.bmp"], ["a.bmp"])


def test_placement(frame):
    pos = frame([("r", "b.bmp", -10, 5, 100, 50, 0.95), ("r", "a.bmp", 150, 90, 100, 50, 0.5), ("r", "c.bmp", 500, 0, 100, 50, 0.9)],
                "run_id string, filename string, x bigint, y bigint, w bigint, h bigint, confidence double")
    out = {r.filename: r for r in R.clip_placement(pos, 200, 100).collect()}
    assert set(out) == {"a.bmp", "b.bmp"}
    b = out["b.bmp"]
    assert (b.dst_x1, b.dst_x2, b.src_x1, b.src_x2) == (0, 90, 10, 100)
    names = sorted(r.output_name for r in Q.number_placements(pos).collect())
    assert names == ["0001_LOW_0.5000_a", "0002_OK_0.9500_b", "0003_OK_0.9000_c"]
