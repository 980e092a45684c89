"""Trajectory counts, schedule example and random plans, default filling."""

import random

import pytest

from stagelog.operators import scoring as Sc
from stagelog.plans import schedule as Sch, trajectories as Tr


def points(df):
    return [(r.x_nm, r.y_nm) for r in sorted(df.collect(), key=lambda r: r.seq)]


def test_lines_and_loops(frame):
    saw = points(Tr.sawtooth(frame([(1, "x", 10, 20, 1000, 300, 2)], "plan_id int, axis string, x0 bigint, y0 bigint, range_nm bigint, step_nm bigint, reps int")))
    assert len(saw) == 2 * 4 * 2 and saw[:5] == [(310, 20), (610, 20), (910, 20), (1210, 20), (910, 20)] and saw[7] == (10, 20)
    loop = frame([(1, "y", 0, 0, [(200, 100), (100, 100)])], "plan_id int, axis string, x0 bigint, y0 bigint, pairs array<struct<major:bigint,minor:bigint>>")
    ys = [y for _, y in points(Tr.major_minor(loop))]
    assert ys == [100, 200, 100, 0, -100, -200, -100, 0, 100, 0, -100, 0]
    from pyspark.sql import functions as F
    ys = [y for _, y in points(Tr.major_minor(loop.withColumn("first_offset", F.lit(100))))]
    assert ys[:5] == [100, 200, 300, 200, 100] and ys[-4:] == [100, 0, -100, 0]
    warm = frame([(1, "x", 5, 6, 50, False), (2, "y", 5, 6, 50, True)], "plan_id int, axis string, x0 bigint, y0 bigint, range_nm bigint, reset boolean")
    assert sorted(points(Tr.loop_warmup(warm))) == [(-45, 6), (5, 56)]
    back = frame([(1, 0, 0, 70, -70, 3)], "plan_id int, x0 bigint, y0 bigint, x_move bigint, y_move bigint, n int")
    rows = sorted(Tr.step_out_and_back(back).collect(), key=lambda r: r.seq)
    assert [r.x_nm for r in rows] == [70, 140, 210, 140, 70, 0, 0] and [r.step for r in rows] == ["0", "1", "2", "3", "4", "5", "final"]


def test_square_and_circle(frame):
    schema = "plan_id int, x0 bigint, y0 bigint, range_nm bigint, n int"
    sq = points(Tr.square(frame([(1, 0, 0, 100, 2)], schema)))
    assert sq == [(0, 0), (0, 50), (0, 100), (50, 100), (100, 100), (100, 50), (100, 0), (50, 0)]
    assert points(Tr.square(frame([(1, 0, 0, -100, 2)], schema)))[:4] == [(0, 0), (0, -50), (0, -100), (-50, -100)]
    with pytest.raises(Exception, match="divisible"):
        Tr.square(frame([(1, 0, 0, 101, 2)], schema)).collect()
    c = points(Tr.circle(frame([(1, 0, 0, 1000, 8, False)], "plan_id int, x0 bigint, y0 bigint, radius_nm bigint, n int, clockwise boolean")))
    assert len(c) == 9 and c[0] == c[8] == (1000, 0) and c[1] == (707, 707)
    c = points(Tr.circle(frame([(1, 0, 0, 1000, 8, True)], "plan_id int, x0 bigint, y0 bigint, radius_nm bigint, n int, clockwise boolean")))
    assert c[1] == (707, -707)


def test_pieces_keep_every_point(frame, monkeypatch):
    monkeypatch.setattr(Tr, "PIECE", 5)
    saw = frame([(1, "x", 0, 0, 1000, 100, 3), (2, "x", 0, 0, 0, 100, 3)], "plan_id int, axis string, x0 bigint, y0 bigint, range_nm bigint, step_nm bigint, reps int")
    rows = Tr.sawtooth(saw).collect()
    assert sorted(r.seq for r in rows) == list(range(60)) and {r.plan_id for r in rows} == {1}


def test_random_plans(frame):
    plan = frame([(1, 10, 20, 500, 300)], "plan_id int, x0 bigint, y0 bigint, radius_nm bigint, n int")
    walk = points(Tr.random_walk(plan, seed=3, min_radius=50))
    assert len(walk) == 301 and walk[0] == (10, 20) and walk == points(Tr.random_walk(plan, seed=3, min_radius=50))
    radii = [((x - 10) ** 2 + (y - 20) ** 2) ** 0.5 for x, y in walk[1:]]
    assert 48 <= min(radii) and max(radii) <= 500 and max(radii) > 400
    poi = frame([(1, [(1, 2), (3, 4)], 50)], "plan_id int, points array<struct<x:bigint,y:bigint>>, n int")
    assert set(points(Tr.poi_jumps(poi))) == {(1, 2), (3, 4)}


def test_warmups_and_grids(spark, frame):
    plan = frame([(1, 0, 0, 5)], "plan_id int, x0 bigint, y0 bigint, n int")
    s = points(Tr.spiral_warmup(plan))
    assert len(s) == 5 and s[0] == (2000, 0) and (s[4][0] ** 2 + s[4][1] ** 2) ** 0.5 == pytest.approx(3000, abs=2)
    with pytest.raises(Exception, match="two points"):
        Tr.spiral_warmup(frame([(1, 0, 0, 1)], "plan_id int, x0 bigint, y0 bigint, n int")).collect()
    assert points(Tr.linear_warmup(plan))[0] == (3000, -3000) and points(Tr.linear_warmup(plan))[-1] == (0, 0)
    assert points(Tr.linear_warmup(plan, 2000, -1, 1))[0] == (-2000, 2000)
    assert points(Tr.linear_warmup(frame([(1, 7, 8, 0)], "plan_id int, x0 bigint, y0 bigint, n int"))) == [(7, 8)]
    grid = frame([(1, [0.0, 45.0, 90.0, 135.0], [-1, 0, 1], [-1, 0, 1])], "plan_id int, angles array<double>, xs array<bigint>, ys array<bigint>")
    assert Tr.angle_grid(grid).count() == 36
    assert Tr.candidate_grid(spark).count() == 10000
    small = Tr.candidate_grid(spark, -15, 15, 10).orderBy("ord").collect()
    assert len(small) == 900 and (small[0].ox, small[0].oy, small[1].oy, small[-1].ox) == (-150, -150, -140, 140)


def carried_timer(exposures, interval):
    out, since = [], 0
    for step, left in enumerate(exposures):
        out.append((step, "UPDATE_REFERENCE", None))
        while left > 0:
            chunk = min(left, interval - since)
            out.append((step, "EXPOSURE", float(chunk)))
            left, since = left - chunk, since + chunk
            if since >= interval:
                out.append((step, "CORRECTION", None))
                since = 0
    return out


def test_schedule(frame):
    rng = random.Random(1)
    plans = {0: ([5, 7], 4), **{k: ([rng.randint(0, 30) for _ in range(rng.randint(1, 6))], 4) for k in range(1, 60)}}
    rows = [(p, i, e) for p, (xs, _) in plans.items() for i, e in enumerate(xs)]
    got = Sch.expand_schedule(frame(rows, "plan_id int, step_idx bigint, exposure_s bigint"), 4).collect()
    for p, (xs, interval) in plans.items():
        mine = [(r.step_idx, r.task_type, r.exposure_s) for r in sorted((r for r in got if r.plan_id == p), key=lambda r: (r.step_idx, r.seq))]
        assert mine == carried_timer(xs, interval)
    with pytest.raises(ValueError):
        Sch.expand_schedule(frame(rows, "plan_id int, step_idx bigint, exposure_s bigint"), 0)


def test_defaults(frame):
    x = frame([(1, 0, 500, None), (1, 1, None, None)], "plan_id int, step_idx int, exposure_mag bigint, correction_mag bigint")
    d = frame([(1, 100, 200)], "plan_id int, exposure_mag bigint, correction_mag bigint")
    mags = frame([(100,), (200,), (500,)], "mag bigint")
    out = sorted((r.step_idx, r.exposure_mag, r.correction_mag) for r in Sch.fill_defaults(x, d, mags).collect())
    assert out == [(0, 500, 200), (1, 100, 200)]
    with pytest.raises(Exception, match="no focus settings"):
        Sch.fill_defaults(x, d, mags.where("mag <> 500")).collect()


def test_best_command(frame):
    w = [(0.0, 0.0, 0.0, 0.0), (100.0, 0.0, 10.0, 20.0)]
    df = frame([("r", 1, 0.0, 0.0, 100, 0, w)],
               "run_id string, source_index bigint, ref_x double, ref_y double, x_target bigint, y_target bigint, window array<struct<tx:double,ty:double,ax:double,ay:double>>")

    def play(t):
        return t[:, -1, :2] - 30

    row = Sc.best_command(df, play, step_nm=10, lo=-5, hi=5).first()
    assert (row.x_command, row.y_command, row.error_nm) == (130, 30, 0)
    tie = Sc.best_command(df, lambda t: t[:, -1, :2] * 0 + 7, step_nm=10, lo=-5, hi=5).first()
    assert (tie.x_command, tie.y_command) == (50, -50)
    loaded = Sc.best_command(df, lambda: play, step_nm=10, lo=-5, hi=5, loader=True).first()
    assert loaded == row
    scored = Sc.score_windows(df, lambda t: t[:, -1, :2] * 2, mean=5.0, scale=10.0).first()
    assert (scored.x_predicted, scored.y_predicted) == (195.0, -5.0)
