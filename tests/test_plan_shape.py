"""Physical plans: no run in one task, no Cartesian product, pruned scans."""

import re

import pytest
from pyspark.sql import functions as F

from stagelog import adapters as A
from stagelog.operators import features as Fe, graph as G, quality as Q, segments as S
from stagelog.operators.pairs import nearest_earlier
from stagelog.queries import QUERIES
import __spark_entry__  # noqa: F401  (registers the queries)

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = ["trusted_stretches", "segmented_records", "agreement_report", "model_windows", "segment_windows", "accumulated_drift",
         "running_reference", "reference_pairs", "cadence", "commanded_layout", "exposure_schedule", "error_percentiles", "edge_residuals"]


@pytest.mark.parametrize("name", BATCH)
def test_no_single_partition_window_or_cartesian(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window \[[^\n]*\n(?:[^\n]*Sort[^\n]*\n)?[^\n]*Exchange SinglePartition", text)


def test_row_windows_are_keyed_by_chunk(spark):
    steps = A.steps_from_events(A.table(spark, SF, "events"))
    for df in (S.mark_segments(steps, min_confidence=0.3), Fe.approach_direction(steps), Q.cadence(steps)):
        for line in plan(df).splitlines():
            if "Exchange hashpartitioning(run_id" in line and "__chunk" not in line:
                # Only the small per-chunk table may be keyed by run alone.
                assert "source_index" not in line


def test_pairs_join_on_grid_cells(spark):
    layout = A.layout_from_embeddings(A.table(spark, SF, "embeddings")).selectExpr("run_id", "tile_id", "x_px AS x", "y_px AS y")
    text = plan(nearest_earlier(layout, ["run_id"], 4, 1629.0))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "cx#" in text


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    events = A.table(spark, SF, "events").where(F.col("event_id") > 10)
    text = plan(Q.confidence_profile(A.steps_from_events(events)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "value" not in schema and "event_type" not in schema
    assert "GreaterThan(event_id,10)" in text


def test_triangles_have_no_nested_loop(spark, frame):
    edges = frame([("a", i, j, 0.0, 0.0) for j in range(6) for i in range(j)], "run_id string, i bigint, j bigint, dx double, dy double")
    text = plan(G.triangles(edges))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert G.triangles(edges).count() == 20
