"""Pairs, cycles, cores, components, clusters, solving and growth against brute force."""

import inspect

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagelog.operators import cluster as C, graph as G, growth as Gr, solve as So
from stagelog.operators.pairs import neighbor_pairs


def brute_pairs(pts, w, h, m=128):
    d = np.zeros_like(pts)
    d[1:] = np.sign(np.diff(pts, axis=0))
    out = set()
    for j in range(1, len(pts)):
        dist = ((pts[:j] - pts[j]) ** 2).sum(1)

        def near(pool, k):
            return sorted(pool, key=lambda i: (dist[i], i))[:k]

        chosen = set(near(range(j), 4)) | set(near([i for i in range(j) if (d[i] == d[j]).all()], 6)) | set(near(range(max(0, j - 30), j), 2))
        out |= {(i, j) for i in chosen if (np.abs(pts[i] - pts[j]) <= (w - m, h - m)).all()}
    return out


@pytest.mark.parametrize("cell_limit", [256, 6])
def test_pairs(spark, cell_limit):
    rng = np.random.default_rng(1)
    runs = {"spread": rng.integers(0, 6000, (90, 2)).astype(float),
            "crowded": rng.permutation(np.vstack([rng.integers(0, 40, (60, 2)), rng.integers(0, 3000, (20, 2)), np.full((40, 2), 7)])).astype(float),
            "two": np.array([[0.0, 0.0], [1152.0, 0.0]]), "one": np.zeros((1, 2))}
    df = spark.createDataFrame(pd.DataFrame([(r, i, *p) for r, a in runs.items() for i, p in enumerate(a)], columns=["run_id", "tile_id", "x_px", "y_px"]))
    got = neighbor_pairs(df, 1280, 1280, cell_limit=cell_limit, width=50).collect()
    for run, pts in runs.items():
        assert {(r.i, r.j) for r in got if r.run_id == run} == brute_pairs(pts, 1280, 1280)


def graph(spark, n=14, noise=0.0, outliers=0.0, seed=3, density=0.8):
    rng = np.random.default_rng(seed)
    true = rng.uniform(0, 1500, (n, 2))
    cmd = true + rng.normal(0, 60, (n, 2))
    rows = []
    for j in range(n):
        for i in range(j):
            if rng.random() < density:
                d = true[j] - true[i] + rng.normal(0, noise, 2) + (rng.normal(0, 200, 2) if rng.random() < outliers else 0)
                rows.append(("a", i, j, d[0], d[1], 0.9, 0.1, float(rng.uniform(0.2, 0.8))))
    e = pd.DataFrame(rows, columns=["run_id", "i", "j", "dx", "dy", "score", "peak_margin", "base_weight"])
    t = pd.DataFrame([("a", i, *cmd[i]) for i in range(n)], columns=["run_id", "tile_id", "x", "y"])
    return true, t, e, spark.createDataFrame(t), spark.createDataFrame(e)


def test_cycles(spark):
    _, _, e, _, edges = graph(spark, noise=0.3, outliers=0.2)
    look = {(r.i, r.j): np.array([r.dx, r.dy]) for r in e.itertuples()}
    tri, errors = set(), {}
    for (l, m) in look:
        for (m2, r) in look:
            if m2 == m and (l, r) in look:
                err = np.hypot(*(look[l, m] + look[m, r] - look[l, r]))
                if err <= 1.5:
                    tri.add((l, m, r))
                    for side in ((l, m), (m, r), (l, r)):
                        errors.setdefault(side, []).append(err)
    keep = {k: v for k, v in errors.items() if len(v) >= 3}
    kept, left = G.cycle_filter(edges)
    got = {(r.i, r.j): r for r in kept.collect()}
    assert set(got) == set(keep)
    base = {(r.i, r.j): r.base_weight for r in e.itertuples()}
    for k, v in keep.items():
        assert got[k].cycle_support == len(v) and got[k].cycle_error_median == pytest.approx(np.median(v))
        assert got[k].base_weight == pytest.approx(base[k] * min(2, 1 + 0.15 * len(v)))
    assert {(r.l, r.m, r.r) for r in left.collect()} == {t for t in tri if {(t[0], t[1]), (t[1], t[2]), (t[0], t[2])} <= set(keep)}


def test_core_and_components(spark, frame):
    clique = [("a", i, j) for j in range(5) for i in range(j)]
    chain = [("a", i, i + 1) for i in range(4, 12)]
    other = [("a", 20 + i, 20 + j) for j in range(4) for i in range(j)] + [("b", 1, 2)]
    edges = frame([(r, i, j, float(j - i), 0.0) for r, i, j in clique + chain + other], "run_id string, i bigint, j bigint, dx double, dy double")
    poses = frame([(r, t, float(t), 0.0) for r in "ab" for t in range(30)], "run_id string, tile_id bigint, x double, y double")
    tiles, core = G.consensus_core(poses, edges, 3)
    assert {(r.tile_id, r.degree) for r in tiles.collect()} == {(t, 4) for t in range(5)} | {(20 + t, 3) for t in range(4)}
    assert core.count() == 16
    comp = {(r.run_id, r.tile_id): r.component for r in G.connected_components(edges).collect()}
    assert {comp["a", t] for t in range(13)} == {0} and {comp["a", 20 + t] for t in range(4)} == {20} and comp["b", 2] == 1
    big = G.largest_component(G.connected_components(core)).collect()
    assert sorted(r.tile_id for r in big) == [0, 1, 2, 3, 4]
    off = poses.selectExpr("run_id", "tile_id", "x * 3 AS x", "y")
    everything, all_edges = G.consensus_core(off, edges, 0)
    assert everything.count() == 60 and all_edges.count() == edges.count() and everything.first().degree == 0
    assert G.consensus_core(off, edges, 3)[1].count() == 0
    lone = G.connected_components(edges.limit(0))
    assert lone.count() == 0


@pytest.mark.parametrize("pair_limit", [1000, 0])
def test_cluster(spark, pair_limit):
    rng = np.random.default_rng(5)
    pts = rng.normal(0, 1.2, (240, 2))
    g = np.repeat([0, 1, 2], 80)
    pts[g == 1] *= 0.1
    q = rng.integers(1, 9, 240).astype(float)
    df = spark.createDataFrame(pd.DataFrame(dict(g=g, o=np.tile(np.arange(80), 3), x=pts[:, 0], y=pts[:, 1], q=q)))
    got = {r.g: r for r in C.agreement_cluster(df, ["g"], "x", "y", "q", "q", 1.5, 3, "o", pair_limit).collect()}
    for k in range(3):
        p, w = pts[g == k], q[g == k]
        near = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) <= 1.5
        best = max(range(80), key=lambda a: (near[a].sum(), w[near[a]].sum(), -a))
        m = near[best]
        assert got[k].support == m.sum()
        assert np.allclose((got[k].x, got[k].y), (p[m] * w[m, None]).sum(0) / w[m].sum())
    assert C.agreement_cluster(df, ["g"], "x", "y", "q", "q", 1e-9, 3, "o", pair_limit).count() == 0


def dense_solve(t, e, prior=0.02, anchor=2.0, rounds=5, huber=6.0):
    n = len(t)
    target = t[["x", "y"]].to_numpy()
    pw = np.full(n, prior)
    pw[0] = anchor
    robust = np.ones(len(e))
    for _ in range(rounds):
        a, b = np.diag(pw), pw[:, None] * target
        for k, r in enumerate(e.itertuples()):
            w = r.base_weight * robust[k]
            a[r.i, r.i] += w; a[r.j, r.j] += w; a[r.i, r.j] -= w; a[r.j, r.i] -= w
            b[r.i] -= w * np.array([r.dx, r.dy]); b[r.j] += w * np.array([r.dx, r.dy])
        pose = np.linalg.solve(a, b)
        gap = pose[e.j] - pose[e.i] - e[["dx", "dy"]].to_numpy()
        robust = np.minimum(1, huber / np.maximum(np.hypot(*gap.T), 1e-9))
    return pose


def as_array(df, t):
    out = df.toPandas().sort_values("tile_id")
    assert len(out) == len(t)
    return out[["x", "y"]].to_numpy(), out["converged"]


def test_solve(spark):
    _, t, e, tiles, edges = graph(spark, noise=0.3, outliers=0.1)
    for rounds in (1, 5):
        want = dense_solve(t, e, rounds=rounds)
        got, done = as_array(So.solve_poses(tiles, edges, irls=rounds), t)
        assert np.abs(got - want).max() < 1e-6 and done.all()
    still, done = as_array(So.solve_poses(tiles, edges.limit(0)), t)
    assert np.allclose(still, t[["x", "y"]]) and done.all()


@pytest.mark.parametrize("limits", [dict(local_edges=0), dict(block=4), dict(block=9)])
def test_solve_by_levels_agrees(spark, limits):
    """One, two and more levels of blocks give what the dense solve gives."""
    _, t, e, tiles, edges = graph(spark, noise=0.3, outliers=0.1)
    want = dense_solve(t, e, rounds=2)
    got, done = as_array(So.solve_poses(tiles, edges, irls=2, **limits), t)
    assert np.abs(got - want).max() < 1e-4 and done.all()


def test_solve_says_where_it_did_not_converge(spark):
    _, t, e, tiles, edges = graph(spark, noise=0.3, outliers=0.1)
    _, done = as_array(So.solve_poses(tiles, edges, irls=1, block=4, cg_iters=1), t)
    assert not done.any()


@pytest.mark.parametrize("block", [512, 4])
def test_solve_of_what_nothing_holds(spark, block):
    """Without a pull, differences are those of the measured ones and the mean stays where commanded."""
    _, t, e, tiles, edges = graph(spark, noise=0.0, outliers=0.0)
    got, done = as_array(So.solve_poses(tiles, edges, prior=0.0, anchor=0.0, irls=1, block=block, tol=1e-9), t)
    gap = got[e["j"]] - got[e["i"]] - e[["dx", "dy"]].to_numpy()
    assert np.abs(gap).max() < 1e-4 and done.all()
    assert np.abs(got.mean(0) - t[["x", "y"]].to_numpy().mean(0)).max() < 1e-4


def sequential_growth(t, edges, seed, k=3):
    """One seed, one tile at a time, in breadth-first order."""
    look = {}
    for r in edges.itertuples():
        look.setdefault(r.i, {})[r.j] = np.array([r.dx, r.dy])
        look.setdefault(r.j, {})[r.i] = -np.array([r.dx, r.dy])
    target = t[["x", "y"]].to_numpy()
    pos = {seed[0]: target[seed[0]]}
    for s in seed[1:]:
        pos[s] = pos[seed[0]] + look[seed[0]][s]
    changed = True
    while changed:
        changed = False
        for node in look:
            if node in pos:
                continue
            offers = np.array([pos[n] - look[node][n] for n in look[node] if n in pos])
            if len(offers) < k:
                continue
            near = np.hypot(*(offers[:, None] - offers[None]).transpose(2, 0, 1)) <= 1.5
            best = near[near.sum(1).argmax()]
            if best.sum() >= k and np.linalg.norm(offers[best].mean(0) - target[node]) <= 6000 / 12.40234:
                pos[node] = offers[best].mean(0)
                changed = True
    return pos


def test_growth_and_refinement(spark):
    true, t, e, tiles, edges = graph(spark, n=16, outliers=0.1, seed=8)
    kept, tri = G.cycle_filter(edges)
    poses, live = Gr.grow_components(tiles, kept, tri)
    got = {r.tile_id: np.array([r.x, r.y]) for r in poses.collect()}
    pk, pt = kept.toPandas(), Gr.triangle_quality(kept, tri).toPandas().sort_values("quality", ascending=False)
    want = max((sequential_growth(t, pk, (r.l, r.m, r.r)) for r in pt.head(5).itertuples()), key=len)
    assert set(got) == set(want) and len(got) >= 10
    shift = {k: got[k] - true[k] for k in got}
    assert np.ptp(np.array(list(shift.values())), axis=0).max() < 1e-6
    refined, final = Gr.refine_consensus(tiles, poses, live)
    rows = refined.collect()
    assert {r.tile_id for r in rows} <= set(got) and min(r.degree for r in rows) >= 3
    first = min(r.tile_id for r in rows)
    for r in rows:
        base = next(x for x in rows if x.tile_id == first)
        assert np.allclose((r.x - base.x, r.y - base.y), true[r.tile_id] - true[first], atol=1e-3)
    assert final.count() >= 3 * len(rows) / 2
    nothing, none = Gr.grow_components(tiles, kept.limit(0), tri.limit(0))
    assert nothing.count() == 0 and none.count() == 0


def test_growth_tries_every_seed(spark):
    """The largest set wins although more than 80 smaller ones have better seeds."""
    cliques = [(4 * c, 4) for c in range(90)] + [(360, 7)]
    rows = [("a", start + i, start + j, float(j - i), 0.0, 0.9, 0.1, 0.8 if n == 4 else 0.2, 9 if n == 4 else 1, 0.0)
            for start, n in cliques for j in range(n) for i in range(j)]
    edges = spark.createDataFrame(
        rows, "run_id string, i bigint, j bigint, dx double, dy double, score double, peak_margin double, base_weight double, "
        "cycle_support bigint, cycle_error_median double")
    tiles = spark.createDataFrame([("a", t, float(t), 0.0) for t in range(367)], "run_id string, tile_id bigint, x double, y double")
    tri = spark.createDataFrame(
        [("a", s + i, s + j, s + k, 0.0) for s, n in cliques for k in range(n) for j in range(k) for i in range(j)],
        "run_id string, l bigint, m bigint, r bigint, closure_error double")
    poses, live = Gr.grow_components(tiles, edges, tri)
    assert sorted(r.tile_id for r in poses.collect()) == list(range(360, 367)) and live.count() == 21
    capped, _ = Gr.grow_components(tiles, edges, tri, max_seeds=80)
    assert capped.count() == 4


def test_growth_of_bounded_parts_needs_no_rounds(spark, monkeypatch):
    """a part that a task can hold is grown there, and gives what rounds of joins give."""
    _, t, e, tiles, edges = graph(spark, n=16, outliers=0.1, seed=8)
    kept, tri = G.cycle_filter(edges)

    def rows(poses):
        return sorted((r.run_id, r.tile_id, round(r.x, 6), round(r.y, 6)) for r in poses.collect())

    by_rounds, live = Gr.grow_components(tiles, kept, tri, local_edges=0)
    want = rows(by_rounds), live.count()
    monkeypatch.setattr(Gr, "_grow", lambda *_: 1 / 0)
    monkeypatch.setattr(Gr, "_PAIRS", 64)
    poses, live = Gr.grow_components(tiles, kept, tri)
    assert (rows(poses), live.count()) == want and len(want[0]) >= 10


def test_growth_of_repeated_edges_goes_by_rounds(spark):
    """what the growth in one task does not read as the joins do is left to them."""
    _, t, e, tiles, edges = graph(spark, n=16, outliers=0.1, seed=8)
    links = edges.select("run_id", F.lit(0).alias("component"), F.col("i").alias("src"), F.col("j").alias("dst"), "dx", "dy", "base_weight")
    links = links.unionByName(links.select("run_id", "component", F.col("dst").alias("src"), F.col("src").alias("dst"), "dx", "dy", "base_weight"))
    at = tiles.withColumn("component", F.lit(0))
    tri = G.triangles(edges).withColumn("component", F.lit(0))
    assert Gr._fit_a_task(at, links, tri, 10_000).count() == 1
    assert Gr._fit_a_task(at, links, tri, 10).count() == 0
    assert Gr._fit_a_task(at, links.unionByName(links.limit(1)), tri, 10_000).count() == 0
    assert Gr._fit_a_task(at.unionByName(at.limit(1)), links, tri, 10_000).count() == 0


def test_solve_of_bounded_parts_needs_no_joins(spark, monkeypatch):
    """parts of several blocks are solved in one task while their edges are bounded."""
    _, t, e, tiles, edges = graph(spark, noise=0.3, outliers=0.1)
    want = dense_solve(t, e, rounds=1)
    spread, done = as_array(So.solve_poses(tiles, edges, irls=1, block=4, local_edges=0), t)
    assert np.abs(spread - want).max() < 1e-4 and done.all()
    want = dense_solve(t, e, rounds=5)
    monkeypatch.setattr(So, "_by_levels", lambda *_: 1 / 0)
    for block in (4, 9):
        got, done = as_array(So.solve_poses(tiles, edges, block=block), t)
        assert np.abs(got - want).max() < 1e-6 and done.all()


def test_triangles_are_joined_without_broadcast(spark):
    """What grows with the edges does not pass through the driver."""
    _, t, e, tiles, edges = graph(spark)
    plan = G.triangles(edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_part_of_many_edges_needs_no_rounds(spark):
    """half a million edges and triangles are still one task's; rounds of joins over them took thousands of jobs."""
    t = spark.range(84_000).select(F.lit("a").alias("run_id"), F.lit(0).cast("bigint").alias("component"), F.col("id").alias("src"))
    links = t.withColumn("d", F.explode(F.array(*[F.lit(s) for s in (-3, -2, -1, 1, 2, 3)]))).select(
        "run_id", "component", "src", (F.col("src") + F.col("d")).alias("dst"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("base_weight"))
    at = t.withColumnRenamed("src", "tile_id")
    tri = t.withColumnRenamed("src", "l")
    most = inspect.signature(Gr.grow_components).parameters["local_edges"].default
    assert Gr._fit_a_task(at, links, tri, most).count() == 1


def test_growth_in_a_task_orders_seeds_and_skips_missing_places():
    """Seeds go by quality, then corners, those without a quality last; a seed whose first tile has no place is not tried."""
    def table(**columns):
        rows = max(len(c) for c in columns.values())
        kinds = dict(kind=pa.int8(), a=pa.int64(), b=pa.int64(), c=pa.int64(), x=pa.float64(), y=pa.float64(), w=pa.float64())
        zeros = {n: [0] * rows for n in kinds}
        return pa.table({"run_id": ["a"] * rows, "component": pa.array([0] * rows, pa.int64())} | {n: pa.array((zeros | columns)[n], k) for n, k in kinds.items()})

    places = table(kind=[0] * 7, a=[*range(7)], x=[None if n == 4 else float(n) for n in range(7)])
    ends = [(i, j) for s, n in ((0, 4), (4, 3)) for j in range(s, s + n) for i in range(s, j)]
    links = table(kind=[1] * len(ends), a=[i for i, _ in ends], b=[j for _, j in ends], x=[float(j - i) for i, j in ends], w=[1.0] * len(ends))
    corners = [(0, 1, 3), (4, 5, 6), (0, 1, 2), (1, 2, 3)]
    seeds = table(kind=[2] * 4, a=[c[0] for c in corners], b=[c[1] for c in corners], c=[c[2] for c in corners], x=[2.0, 9.0, 2.0, None])
    got = Gr._largest_grown(pa.concat_tables([seeds, links, places]), 3, 1.5, 100.0, 1.5).to_pandas()
    assert sorted(got.tile_id) == [0, 1, 2, 3] and set(got.seed) == {2} and set(got.quality) == {2.0}
    assert dict(zip(got.tile_id, got.x)) == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}
