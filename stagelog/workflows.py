"""Whole jobs made of the operators: recalculate a log and segment it; place tiles and draw their mosaic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stagelog.operators import graph as G, growth as Gr, mosaic as M, quality as Q, segments as S
from stagelog.session import cut_lineage


@dataclass
class Recalculated:
    """Records of the segments with their new positions, discarded records, updated and skipped counts, agreement of the whole log."""

    rows: DataFrame
    summary: DataFrame
    discarded: DataFrame
    counts: DataFrame
    agreement: DataFrame


def recalculate_and_segment(
    steps: DataFrame, positions: DataFrame, *, min_confidence: float = 0.8, min_length: int = 1, missing_reference: str = "keep",
) -> Recalculated:
    """Replace a log's actual places by measured ones, then cut it where the measurement is not trusted.

    The recalculated log is written once and read by every part of the result.  A record is rejected when its
    position's confidence is below ``min_confidence`` or it has none, whatever confidence the log itself states.
    """
    new = cut_lineage(Q.recalculate_positions(steps, positions, missing_reference=missing_reference))
    plain = new.drop("position", "position_confidence", "filename")
    marked = S.mark_segments(plain, positions, min_confidence)
    rows, discarded = S.segment_runs(plain, positions, min_confidence, min_length)
    return Recalculated(rows, S.segment_summary(marked, min_length), discarded, Q.update_counts(new), Q.agreement_report(new))


@dataclass
class Stitched:
    """Accepted poses with their degree, accepted edges, mosaic blocks, distances from the commanded places."""

    poses: DataFrame
    edges: DataFrame
    mosaic: DataFrame
    corrections: DataFrame


def stitch(tiles: DataFrame, targets: DataFrame, edges: DataFrame, *, block: int = 512, blend: str = "feather", **growth) -> Stitched:
    """From measured edges to a mosaic: cycle support, growth from seed triangles, refinement, blending.

    ``tiles`` hold ``run_id, tile_id, w, h, pixels``, ``targets`` the commanded ``x, y`` in pixels, ``edges`` what
    registration gave.  Runs whose tiles differ in shape are an error, which names some of them.  ``growth`` goes to
    :func:`grow_components`.  A run in which nothing can be placed has no rows.
    """
    odd = Q.shape_report(tiles).where("NOT uniform").select("run_id").limit(5).collect()
    if odd:
        raise ValueError(f"tiles of different shapes in runs {sorted(str(r['run_id']) for r in odd)}")
    kept, triangles = G.cycle_filter(edges)
    at = cut_lineage(targets.select("run_id", "tile_id", "x", "y"))
    placed, live = Gr.grow_components(at, kept, triangles, **growth)
    poses, accepted = Gr.refine_consensus(at, placed, live)
    poses = cut_lineage(poses)
    return Stitched(poses, accepted, M.compose_mosaic(tiles, poses, block=block, blend=blend), Q.correction_summary(poses, at))
