"""Queries over tile layouts, registration graphs and image tiles made from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from stagelog import adapters as A
from stagelog.functions.rows import predicted_overlap
from stagelog.operators import graph as G, growth as Gr, mosaic as M, quality as Q, solve as So
from stagelog.operators.locate import locate_tiles
from stagelog.operators.pairs import neighbor_pairs
from stagelog.operators.pixels import preprocess_tiles
from stagelog.operators.registration import CircularParams, register_pairs
from stagelog.queries import query
from stagelog.schema import NM_PER_PX
from stagelog.session import cut_lineage
from stagelog.sources.tiles import tiles_from_vectors

W = H = A.TILE_W
B = "bigint"


def layout(spark, folder):
    return A.layout_from_embeddings(A.table(spark, folder, "embeddings"))


def pairs(spark, folder):
    return cut_lineage(neighbor_pairs(layout(spark, folder), W, H))


_PAIRS_SQL = f"""{A.LAYOUT_SQL}, dirs AS (SELECT *, coalesce(sign(x_px - lag(x_px) OVER w), 0) AS dx0, coalesce(sign(y_px - lag(y_px) OVER w), 0) AS dy0
  FROM layout WINDOW w AS (PARTITION BY run_id ORDER BY tile_id)),
cand AS (SELECT a.run_id, b.tile_id AS i, a.tile_id AS j, a.x_px-b.x_px AS dx, a.y_px-b.y_px AS dy,
  (a.x_px-b.x_px)*(a.x_px-b.x_px)+(a.y_px-b.y_px)*(a.y_px-b.y_px) AS d2, a.dx0 = b.dx0 AND a.dy0 = b.dy0 AS same, a.tile_id - b.tile_id <= 30 AS recent
  FROM dirs a JOIN dirs b ON a.run_id = b.run_id AND b.tile_id < a.tile_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, j ORDER BY d2, i) AS r1,
  row_number() OVER (PARTITION BY run_id, j, same ORDER BY d2, i) AS r2, row_number() OVER (PARTITION BY run_id, j, recent ORDER BY d2, i) AS r3 FROM cand),
pairs AS MATERIALIZED (SELECT run_id, i, j, dx, dy FROM ranked WHERE (r1 <= 4 OR (same AND r2 <= 6) OR (recent AND r3 <= 2)) AND {W}-abs(dx) >= 128 AND {H}-abs(dy) >= 128)"""


@query("neighbor_pairs", f"WITH {_PAIRS_SQL} SELECT run_id, i, j, dx, dy FROM pairs")
def neighbor_pairs_query(spark, folder):
    return neighbor_pairs(layout(spark, folder), W, H)


@query("predicted_overlaps", f"""WITH {_PAIRS_SQL} SELECT run_id, i, j, greatest(CAST(0 AS DOUBLE), -dx) AS x1, least(CAST({W} AS DOUBLE), {W}-dx) AS x2,
  greatest(CAST(0 AS DOUBLE), -dy) AS y1, least(CAST({H} AS DOUBLE), {H}-dy) AS y2 FROM pairs""")
def predicted_overlaps(spark, folder):
    return predicted_overlap(pairs(spark, folder), W, H).select(
        "run_id", "i", "j", *[(F.col(c) + 0.0).alias(c) for c in ("x1", "x2", "y1", "y2")])


def edges(spark, folder):
    """Pairs with a small deterministic error, every seventh one far off."""
    i, j = F.col("i"), F.col("j")
    off = F.when((i * 13 + j * 7) % 7 == 0, 50.0).otherwise(0.0)
    noise = ((i * 31 + j * 17) % 5 - 2).cast("double") / 4.0
    return pairs(spark, folder).select(
        "run_id", "i", "j", (F.col("dx") + noise + off).alias("dx"), (F.col("dy") - noise).alias("dy"),
        (F.lit(0.8) + ((i + j) % 10).cast("double") / 64.0).alias("score"), F.lit(0.1).alias("peak_margin"),
        (((i + 2 * j) % 16 + 1).cast("double") / 16.0).alias("base_weight"))


_EDGES_SQL = f"""{_PAIRS_SQL}, edges AS MATERIALIZED (SELECT run_id, i, j,
  dx + CAST((i*31+j*17)%5-2 AS DOUBLE)/4 + CASE WHEN (i*13+j*7)%7=0 THEN CAST(50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS dx, dy - CAST((i*31+j*17)%5-2 AS DOUBLE)/4 AS dy,
  CAST((i+2*j)%16+1 AS DOUBLE)/16 AS base_weight FROM pairs)"""

_TRI_SQL = f"""{_EDGES_SQL}, tri AS MATERIALIZED (SELECT a.run_id, a.i AS l, a.j AS m, b.j AS r, sqrt((a.dx+b.dx-c.dx)*(a.dx+b.dx-c.dx)+(a.dy+b.dy-c.dy)*(a.dy+b.dy-c.dy)) AS closure_error
  FROM edges a JOIN edges b ON a.run_id = b.run_id AND a.j = b.i JOIN edges c ON a.run_id = c.run_id AND c.i = a.i AND c.j = b.j),
good AS (SELECT * FROM tri WHERE closure_error <= 1.5),
sides AS (SELECT run_id, l AS i, m AS j, closure_error AS e FROM good UNION ALL SELECT run_id, m, r, closure_error FROM good UNION ALL SELECT run_id, l, r, closure_error FROM good),
sup AS MATERIALIZED (SELECT run_id, i, j, count(*) AS cycle_support, quantile_cont(e, 0.5) AS cycle_error_median FROM sides GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@query("registration_triangles", f"WITH {_TRI_SQL} SELECT run_id, l, m, r, round(closure_error, 6) AS closure_error FROM tri")
def registration_triangles(spark, folder):
    out = G.triangles(cut_lineage(edges(spark, folder)), None)
    return out.withColumn("closure_error", F.round("closure_error", 6))


@query("cycle_supported_edges", f"""WITH {_TRI_SQL} SELECT run_id, i, j, cycle_support, round(cycle_error_median, 6) AS cycle_error_median,
  round(base_weight*least(CAST(2 AS DOUBLE), CAST(1 AS DOUBLE)+CAST(0.15 AS DOUBLE)*cycle_support), 6) AS base_weight FROM edges JOIN sup USING (run_id, i, j)""")
def cycle_supported_edges(spark, folder):
    kept, _ = G.cycle_filter(edges(spark, folder))
    return kept.select("run_id", "i", "j", "cycle_support", F.round("cycle_error_median", 6).alias("cycle_error_median"),
                       F.round("base_weight", 6).alias("base_weight"))


@query("retained_triangles", f"""WITH {_TRI_SQL} SELECT g.run_id, l, m, r FROM good g WHERE EXISTS (SELECT 1 FROM sup s WHERE s.run_id = g.run_id AND s.i = l AND s.j = m)
  AND EXISTS (SELECT 1 FROM sup s WHERE s.run_id = g.run_id AND s.i = m AND s.j = r) AND EXISTS (SELECT 1 FROM sup s WHERE s.run_id = g.run_id AND s.i = l AND s.j = r)""")
def retained_triangles(spark, folder):
    _, tri = G.cycle_filter(edges(spark, folder))
    return tri.select("run_id", "l", "m", "r")


@query("seed_triangles", f"""WITH {_TRI_SQL}, kept AS (SELECT run_id, i, j, cycle_support + 3*base_weight*least(CAST(2 AS DOUBLE), CAST(1 AS DOUBLE)+CAST(0.15 AS DOUBLE)*cycle_support) AS v FROM edges JOIN sup USING (run_id, i, j)),
q AS (SELECT g.run_id, l, m, r, round(a.v+b.v+c.v-closure_error, 6) AS quality FROM good g JOIN kept a ON a.run_id = g.run_id AND a.i = l AND a.j = m
  JOIN kept b ON b.run_id = g.run_id AND b.i = m AND b.j = r JOIN kept c ON c.run_id = g.run_id AND c.i = l AND c.j = r),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY quality DESC, l, m, r) AS place FROM q)
SELECT run_id, l, m, r, quality, place FROM n WHERE place <= 80""")
def seed_triangles(spark, folder):
    """the 80 best triangles of each run."""
    kept, tri = G.cycle_filter(edges(spark, folder))
    kept, tri = cut_lineage(kept), cut_lineage(tri)
    ranked = Gr.triangle_quality(kept, tri).withColumn("quality", F.round("quality", 6)).withColumn(
        "place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("quality"), "l", "m", "r")))
    return ranked.where("place <= 80").select("run_id", "l", "m", "r", "quality", F.col("place").cast(B).alias("place"))


@query("tile_degrees", f"""WITH {_EDGES_SQL}, e AS (SELECT run_id, i AS tile_id FROM edges UNION ALL SELECT run_id, j FROM edges)
SELECT run_id, tile_id, count(*) AS degree FROM e GROUP BY 1, 2""")
def tile_degrees(spark, folder):
    return G.degrees(edges(spark, folder))


@query("registration_weights", f"""WITH {_EDGES_SQL} SELECT run_id, i, j, round(s*s*s*s*greatest(CAST(0.2 AS DOUBLE), base_weight)*least(CAST(1 AS DOUBLE), CAST(j%4+1 AS DOUBLE)/3), 6) AS weight
FROM (SELECT *, CAST(0.8 AS DOUBLE)+CAST((i+j)%10 AS DOUBLE)/64 AS s FROM edges)""")
def registration_weights(spark, folder):
    """G7 with the edge's own numbers as area and support."""
    w = G.edge_weight(F.col("score"), F.col("base_weight"), (F.col("j") % 4 + 1).cast("double"))
    return edges(spark, folder).select("run_id", "i", "j", F.round(w, 6).alias("weight"))


def targets(spark, folder):
    return layout(spark, folder).select("run_id", "tile_id", F.col("x_px").alias("x"), F.col("y_px").alias("y"))


_RES_SQL = f"""{_EDGES_SQL}, res AS MATERIALIZED (SELECT e.run_id, e.i, e.j, sqrt((b.x_px-a.x_px-e.dx)*(b.x_px-a.x_px-e.dx)+(b.y_px-a.y_px-e.dy)*(b.y_px-a.y_px-e.dy)) AS residual
  FROM edges e JOIN layout a ON a.run_id = e.run_id AND a.tile_id = e.i JOIN layout b ON b.run_id = e.run_id AND b.tile_id = e.j)"""


@query("edge_residuals", f"WITH {_RES_SQL} SELECT run_id, i, j, round(residual, 6) AS residual FROM res")
def edge_residuals(spark, folder):
    out = G.edge_residuals(edges(spark, folder), targets(spark, folder))
    return out.select("run_id", "i", "j", F.round("residual", 6).alias("residual"))


@query("edge_residual_summary", f"WITH {_RES_SQL} SELECT run_id, round(quantile_cont(residual, 0.5), 6) AS median, round(quantile_cont(residual, 0.9), 6) AS p90 FROM res GROUP BY 1")
def edge_residual_summary(spark, folder):
    out = Q.residual_summary(G.edge_residuals(edges(spark, folder), targets(spark, folder)))
    return out.select("run_id", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


def _peel_sql(rounds: int) -> str:
    parts = ["e0 AS MATERIALIZED (SELECT run_id, i, j FROM res WHERE residual <= 1.5)"]
    for n in range(rounds):
        parts.append(f"""d{n} AS MATERIALIZED (SELECT run_id, t FROM (SELECT run_id, i AS t FROM e{n} UNION ALL SELECT run_id, j FROM e{n}) GROUP BY 1, 2 HAVING count(*) >= 3)""")
        parts.append(f"""e{n + 1} AS MATERIALIZED (SELECT e.* FROM e{n} e JOIN d{n} a ON a.run_id = e.run_id AND a.t = e.i JOIN d{n} b ON b.run_id = e.run_id AND b.t = e.j)""")
    return ", ".join(parts)


@query("consensus_core", f"""WITH {_RES_SQL}, {_peel_sql(40)}
SELECT run_id, t AS tile_id, count(*) AS degree FROM (SELECT run_id, i AS t FROM e40 UNION ALL SELECT run_id, j FROM e40) GROUP BY 1, 2""")
def consensus_core(spark, folder):
    """G1 around the commanded layout."""
    return G.consensus_core(targets(spark, folder), cut_lineage(edges(spark, folder)))[0]


_REACH_SQL = f"""RECURSIVE {_RES_SQL}, near AS MATERIALIZED (SELECT run_id, i, j FROM res WHERE residual <= 1.5),
both_ways AS MATERIALIZED (SELECT run_id, i AS a, j AS b FROM near UNION ALL SELECT run_id, j, i FROM near),
reach AS (SELECT DISTINCT run_id, a AS tile_id, a AS root FROM both_ways UNION SELECT r.run_id, b.b, r.root FROM reach r JOIN both_ways b ON b.run_id = r.run_id AND b.a = r.tile_id),
comp AS MATERIALIZED (SELECT run_id, tile_id, min(root) AS component FROM reach GROUP BY 1, 2)"""


def _agreeing(spark, folder):
    e = G.edge_residuals(edges(spark, folder), targets(spark, folder))
    return e.where(F.col("residual") <= 1.5)


@query("connected_components", f"WITH {_REACH_SQL} SELECT run_id, tile_id, component FROM comp")
def connected_components(spark, folder):
    return G.connected_components(_agreeing(spark, folder))


@query("largest_component", f"""WITH {_REACH_SQL}, n AS (SELECT run_id, component, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, component) AS rn FROM comp GROUP BY 1, 2)
SELECT c.run_id, c.tile_id FROM comp c JOIN n ON n.run_id = c.run_id AND n.component = c.component WHERE rn = 1""")
def largest_component(spark, folder):
    return G.largest_component(cut_lineage(G.connected_components(_agreeing(spark, folder))))


@query("canvas_extent", f"""WITH {A.LAYOUT_SQL} SELECT run_id, CAST(floor(min(x_px)) AS BIGINT) AS min_x, CAST(floor(min(y_px)) AS BIGINT) AS min_y, CAST(ceil(max(x_px)) AS BIGINT) AS max_x,
  CAST(ceil(max(y_px)) AS BIGINT) AS max_y, CAST(ceil(max(x_px))-floor(min(x_px))+{W}+64 AS BIGINT) AS canvas_w, CAST(ceil(max(y_px))-floor(min(y_px))+{H}+64 AS BIGINT) AS canvas_h FROM layout GROUP BY 1""")
def canvas_extent(spark, folder):
    return Q.canvas_extent(targets(spark, folder), W, H)


@query("correction_summary", f"""WITH {A.LAYOUT_SQL}, m AS (SELECT run_id, sqrt(CAST((tile_id*31%401-200)*(tile_id*31%401-200) + (tile_id*17%301-150)*(tile_id*17%301-150) AS DOUBLE))/CAST(4 AS DOUBLE)
  *CAST({NM_PER_PX} AS DOUBLE) AS d FROM layout)
SELECT run_id, count(*) AS tiles, round(quantile_cont(d, 0.5), 6) AS median_nm, round(quantile_cont(d, 0.9), 6) AS p90_nm, round(max(d), 6) AS max_nm,
  count(*) FILTER (d > 500) AS beyond FROM m GROUP BY 1""")
def correction_summary(spark, folder):
    """How far placed tiles lie from where they were sent."""
    t = F.col("tile_id")
    moved = targets(spark, folder).withColumns({"x": F.col("x") + (t * 31 % 401 - 200) / 4.0, "y": F.col("y") + (t * 17 % 301 - 150) / 4.0})
    out = Q.correction_summary(moved, targets(spark, folder), limit_nm=500.0)
    return out.withColumns({c: F.round(c, 6) for c in ("median_nm", "p90_nm", "max_nm")})


def _rounded_poses(df, *more):
    return df.select("run_id", "tile_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), *more)


@query("solved_poses")
def solved_poses(spark, folder):
    """G4 over the noisy graph of every run."""
    return _rounded_poses(So.solve_poses(targets(spark, folder), edges(spark, folder)))


def _grown(spark, folder):
    kept, tri = G.cycle_filter(edges(spark, folder))
    at = cut_lineage(targets(spark, folder))
    return at, *Gr.grow_components(at, kept, tri)


@query("grown_component")
def grown_component(spark, folder):
    """G3 from the best seed triangles of every run."""
    return _rounded_poses(_grown(spark, folder)[1])


@query("refined_consensus")
def refined_consensus(spark, folder):
    """G5 after G3."""
    at, poses, live = _grown(spark, folder)
    return _rounded_poses(Gr.refine_consensus(at, poses, live)[0], "degree")


SIDE, LOW, HIGH = 8, -0.5, 0.5


def tiles(spark, folder):
    """Every 64-number vector as an 8 × 8 grey tile."""
    at = layout(spark, folder).select("run_id", "tile_id", "vec_id")
    vectors = A.table(spark, folder, "embeddings").select("vec_id", "embedding").join(at, "vec_id").drop("vec_id")
    return tiles_from_vectors(vectors, SIDE, "embedding", LOW, HIGH)


def chained(spark, folder):
    """Each tile against the one before it, no shift expected."""
    t = layout(spark, folder).where("tile_id > 0")
    return t.select("run_id", (F.col("tile_id") - 1).alias("i"), F.col("tile_id").alias("j"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))


@query("circular_registration", f"""WITH {A.LAYOUT_SQL}, px AS (SELECT l.run_id, l.tile_id, k-1 AS k, greatest(CAST(0 AS DOUBLE), least(CAST(255 AS DOUBLE),
    round_even((CAST(embedding[k] AS DOUBLE)-CAST({LOW} AS DOUBLE))/CAST({HIGH - LOW} AS DOUBLE)*CAST(255 AS DOUBLE), 0))) AS v FROM embeddings e JOIN layout l USING (vec_id), range(1, 65) t(k)),
s AS (SELECT a-1 AS dx, b-1 AS dy, b*3+a AS o FROM range(3) x(a), range(3) y(b)),
c AS (SELECT p.run_id, p.tile_id AS i, q.tile_id AS j, dx, dy, o, count(*) AS n, sum(p.v*q.v) AS pq, sum(p.v) AS sp, sum(q.v) AS sq, sum(p.v*p.v) AS pp, sum(q.v*q.v) AS qq
  FROM s, px p JOIN px q ON q.run_id = p.run_id AND q.tile_id = p.tile_id + 1
  WHERE q.k = ((p.k // 8 - dy + 8) % 8) * 8 + (p.k % 8 - dx + 8) % 8 GROUP BY 1, 2, 3, 4, 5, 6),
g AS (SELECT *, (n*pq-sp*sq)/sqrt((n*pp-sp*sp)*(n*qq-sq*sq)) AS corr FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, j ORDER BY round(corr, 10) DESC, o) AS rn FROM g)
SELECT run_id, i, j, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, round(corr, 6) AS score FROM r WHERE rn = 1""")
def circular_registration(spark, folder):
    """H5 over shifts of at most one pixel."""
    out = register_pairs(chained(spark, folder), tiles(spark, folder), "circular", CircularParams(1, 1))
    return out.select("run_id", "i", "j", (F.col("dx") + 0.0).alias("dx"), (F.col("dy") + 0.0).alias("dy"), F.round("score", 6).alias("score"))


@query("phase_registration")
def phase_registration(spark, folder):
    """H4 + H7: shift, response and the size of the surface."""
    out = register_pairs(chained(spark, folder), tiles(spark, folder), "phase", keep_surface=True)
    return out.select("run_id", "i", "j", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "score")],
                      F.size("surface").cast(B).alias("cells"))


@query("preprocessed_tiles")
def preprocessed_tiles(spark, folder):
    """H6: blur, gradient, taper and scale of every tile."""
    chain = [{"op": "median", "k": 3}, {"op": "gaussian"}, {"op": "sobel"}, {"op": "tukey", "alpha": 0.25}, {"op": "normalize"}]
    return preprocess_tiles(tiles(spark, folder), chain).select(
        "run_id", "tile_id", F.length("pixels").cast(B).alias("bytes"), F.crc32("pixels").alias("checksum"))


def _small_poses(spark, folder):
    at = layout(spark, folder)
    return at.select("run_id", "tile_id", (F.col("vec_id") * 7919 % 61).cast("double").alias("x"),
                     (F.col("vec_id") * 104729 % 61).cast("double").alias("y"))


def _mosaic(spark, folder, blend="feather"):
    return M.compose_mosaic(tiles(spark, folder), _small_poses(spark, folder), block=32, feather=3, blend=blend)


_MOSAIC_SQL = f"""WITH {A.LAYOUT_SQL}, pose AS (SELECT *, vec_id*7919%61 AS x, vec_id*104729%61 AS y FROM layout),
low AS (SELECT run_id, min(x) AS mx, min(y) AS my FROM pose GROUP BY 1),
px AS (SELECT l.run_id, l.tile_id, x-mx+32+(k-1)%8 AS cx, y-my+32+(k-1)//8 AS cy, least(least((k-1)%8+1, 8-(k-1)%8), least((k-1)//8+1, 8-(k-1)//8), 3) AS w,
  CAST(greatest(0, least(255, round_even((CAST(embedding[k] AS DOUBLE)-CAST({LOW} AS DOUBLE))/CAST({HIGH - LOW} AS DOUBLE)*CAST(255 AS DOUBLE), 0))) AS BIGINT) AS v
  FROM embeddings e JOIN pose l USING (vec_id) JOIN low USING (run_id), range(1, 65) t(k)),
feather AS (SELECT run_id, cx, cy, CAST(sum(w*v) AS BIGINT) // CAST(sum(w) AS BIGINT) AS v, count(*) AS n FROM px GROUP BY 1, 2, 3),
sharp AS (SELECT run_id, cx, cy, min_by(v, {{'a': -w, 'b': tile_id}}) AS v FROM px GROUP BY 1, 2, 3)"""


def _sum_of_bytes(column):
    """Sum of a body's bytes: its hex digits as numbers."""
    digits = F.expr(f"transform(sequence(0, length({column}) - 1), k -> cast(conv(hex(substring({column}, k + 1, 1)), 16, 10) as bigint))")
    return F.aggregate(digits, F.lit(0).cast(B), lambda a, d: a + d)


@query("feather_mosaic", _MOSAIC_SQL + """ SELECT run_id, cx//32 AS bx, cy//32 AS by, count(*) AS covered, count(*) FILTER (n > 1) AS overlapped,
  CAST(sum(v) AS BIGINT) AS grey, min(cx) AS "left", max(cx) AS "right", min(cy) AS top, max(cy) AS bottom FROM feather GROUP BY 1, 2, 3""")
def feather_mosaic(spark, folder):
    """H8 feathered: block statistics and grey sums."""
    return _mosaic(spark, folder).select("run_id", "bx", "by", "covered", "overlapped", _sum_of_bytes("pixels").alias("grey"),
                                         "left", "right", "top", "bottom")


@query("sharp_mosaic", _MOSAIC_SQL + """ SELECT run_id, cx//32 AS bx, cy//32 AS by, count(*) AS covered, CAST(sum(v) AS BIGINT) AS grey FROM sharp GROUP BY 1, 2, 3""")
def sharp_mosaic(spark, folder):
    """H8 sharp: each pixel from the tile furthest from its edge."""
    return _mosaic(spark, folder, "sharp").select("run_id", "bx", "by", "covered", _sum_of_bytes("pixels").alias("grey"))


@query("mosaic_coverage", _MOSAIC_SQL + """ SELECT run_id, cx//32 AS bx, cy//32 AS by, count(*) AS covered, count(*) FILTER (n > 1) AS overlapped,
  CAST(count(*) AS DOUBLE)/1024 AS covered_share, CAST(count(*) FILTER (n > 1) AS DOUBLE)/1024 AS overlapped_share FROM feather GROUP BY 1, 2, 3""")
def mosaic_coverage(spark, folder):
    return M.coverage(_mosaic(spark, folder))


@query("mosaic_crop", _MOSAIC_SQL + """ SELECT run_id, greatest(0, min(cx)-10) AS x1, max(cx)+11 AS x2, greatest(0, min(cy)-10) AS y1, max(cy)+11 AS y2 FROM feather GROUP BY 1""")
def mosaic_crop(spark, folder):
    return M.crop_extent(_mosaic(spark, folder))


@query("located_tiles")
def located_tiles(spark, folder):
    """H2: every tile searched in its run's own mosaic."""
    return locate_tiles(tiles(spark, folder), cut_lineage(_mosaic(spark, folder)), 32, SIDE, SIDE)
