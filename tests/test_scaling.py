"""What keeps single steps in proportion to their input."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stagelog.operators import cluster as C, scoring as Sc
from stagelog.sources import logs as L
from stagelog.sources.sinks import in_ranges, write_positions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_sorted(spark, frame):
    rows = [("a", 1, 0, 0, 3.0), ("a", 2, 7, -4, -120.0), (None, 3, 5, 5, 0.0), ("b", 4, 1, 1, None), ("b", 5, None, 2, 1.0), ("c", 6, 10, 0, 0.0)]
    targets = frame(rows, "run_id string, source_index bigint, x_target bigint, y_target bigint, ax double")
    # a whole column of candidates has the same error: the first of them wins
    found = Sc.best_command_expr(targets, ["run_id", "source_index"], F.col("x_command") + F.col("ax"), F.col("y_target").cast("double"), 100, -2, 2)
    assert "SortAggregate" not in plan(found)
    got = {r.source_index: (r.run_id, r.x_command, r.y_command, r.error_nm) for r in found.collect()}
    assert got == {1: ("a", 0, -200, 3), 2: ("a", 107, -204, 20), 3: (None, 5, -195, 0), 4: ("b", -199, -199, None),
                   5: ("b", None, -198, None), 6: ("c", 10, -200, 0)}


def test_one_large_group_does_not_send_small_ones_to_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    g = np.repeat([0, 1, 2], [400, 30, 20])
    pts, q = rng.normal(0, 2.0, (450, 2)), rng.integers(1, 9, 450).astype(float)
    df = spark.createDataFrame(pd.DataFrame(dict(g=g, o=np.arange(450), x=pts[:, 0], y=pts[:, 1], q=q)))
    seen, by_cells = [], C._by_cells

    def watched(points, *more):
        seen.append({r.g for r in points.select("g").distinct().collect()})
        return by_cells(points, *more)

    monkeypatch.setattr(C, "_by_cells", watched)
    monkeypatch.setattr(C, "_TOGETHER", 100)
    got = {r.g: r for r in C.agreement_cluster(df, ["g"], "x", "y", "q", "q", 1.5, 3, "o").collect()}
    assert seen == [{0}]
    for k in range(3):
        at = np.flatnonzero(g == k)
        p, w = pts[at], q[at]
        near = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) <= 1.5
        best = max(range(len(at)), key=lambda a: (near[a].sum(), w[near[a]].sum(), -a))
        m = near[best]
        assert got[k].support == m.sum()
        assert np.allclose((got[k].x, got[k].y), (p[m] * w[m, None]).sum(0) / w[m].sum())


def test_groups_in_place_are_those_by_cells_with_repeated_rows(spark):
    rng = np.random.default_rng(8)
    pts = pd.DataFrame(dict(g=np.repeat([0, 1], 60), o=np.tile(np.arange(60), 2), px=rng.normal(0, 2, 120), py=rng.normal(0, 2, 120),
                            q=rng.integers(1, 9, 120).astype(float), wt=1.0))
    pts = spark.createDataFrame(pd.concat([pts, pts[::7], pts[::11].assign(px=0.3)]))

    def rows(found):
        return {tuple(r) for r in found.select("g", "so", "sx", "sy", "support", "quality").collect()}

    assert rows(C._in_place(pts, ["g"], 1.5, 3)) == rows(C._by_cells(pts, ["g"], 1.5, 3))


def test_small_runs_are_written_by_many_tasks(spark, frame):
    rows = spark.range(80).selectExpr("concat('r', id) AS run_id", "id AS source_index")
    used = in_ranges(rows, "run_id", "source_index").select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1 and used <= 8


def test_entries_go_on_over_the_files_of_a_run(spark, tmp_path):
    schema = "run_id string, filename string, entry bigint, x bigint, y bigint, w bigint, h bigint, confidence double"
    rows = [("r", f"{i}.bmp", i, i, -i, 10, 20, 0.5) for i in range(40)] + [("r", "7.bmp", 40, 99, 0, 10, 20, 0.5)]
    write_positions(spark.createDataFrame(rows, schema), str(tmp_path / "p"))
    assert len(list((tmp_path / "p" / "run_id=r").glob("*.txt"))) > 1
    back = L.read_positions(spark, str(tmp_path / "p/*/*.txt"), run_from="folder").select("filename", "entry", "x").collect()
    assert sorted((r.entry, r.filename, r.x) for r in back) == [(r[2], r[1], r[3]) for r in rows]
