"""Component growth and consensus refinement."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from stagelog.functions.rows import distance
from stagelog.operators.cluster import agreement_cluster
from stagelog.operators.graph import (
    connected_components, consensus_core, degrees, edge_residuals, keep_edges, largest_component)
from stagelog.operators.solve import solve_poses
from stagelog.schema import (
    AGREE_PX, MAX_CORRECTION_NM, MAX_RESIDUAL_PX, MIN_NEIGHBOURS, NM_PER_PX, POSE_ANCHOR)
from stagelog.session import cut_lineage, release

_KEYS = ["run_id", "component"]
_SEED = [*_KEYS, "seed"]
_DEGREE = 512  # links of a tile, for components that a task takes whole
_HELD = 3_000_000  # edges and triangles of a component that a task takes whole: about 200 bytes each
_PAIRS = 1 << 21  # pairs of offers compared together
_GROWN = "run_id string, component bigint, seed int, tile_id bigint, x double, y double, quality double, wave int"


def triangle_quality(edges: DataFrame, tri: DataFrame) -> DataFrame:
    """support and weight of a triangle's three edges minus its closure error."""
    value = F.col("cycle_support") + 3.0 * F.col("base_weight")
    for a, b in ("lm", "mr", "lr"):
        tri = tri.join(edges.select("run_id", F.col("i").alias(a), F.col("j").alias(b), value.alias(a + b)).hint("merge"), ["run_id", a, b])
    return tri.withColumn("quality", F.col("lm") + F.col("mr") + F.col("lr") - F.col("closure_error")).drop("lm", "mr", "lr")


def _grow(seeds: DataFrame, tiles: DataFrame, links: DataFrame, k: int, agree_px: float, limit_px: float) -> DataFrame:
    """Grow every seed triangle on its own until no tile can be added to any of them."""
    at = tiles.select(*_KEYS, "tile_id", "x", "y")
    first = seeds.join(at.withColumnRenamed("tile_id", "l"), [*_KEYS, "l"])
    accepted = first.select(*_SEED, F.col("l").alias("tile_id"), "x", "y")
    for other in "mr":
        step = links.select(*_KEYS, F.col("src").alias("l"), F.col("dst").alias(other), "dx", "dy")
        accepted = accepted.unionByName(first.join(step, [*_KEYS, "l", other]).select(
            *_SEED, F.col(other).alias("tile_id"), (F.col("x") + F.col("dx")).alias("x"),
            (F.col("y") + F.col("dy")).alias("y")))
    accepted = fresh = cut_lineage(accepted)
    into = links.select(*_KEYS, "src", "dst", "dx", "dy", "base_weight")
    while True:
        known = accepted.select(*_SEED, F.col("tile_id").alias("dst"))
        exposed = (
            fresh.select(*_SEED, F.col("tile_id").alias("src")).join(into.select(*_KEYS, "src", "dst"), [*_KEYS, "src"])
            .select(*_SEED, "dst").distinct().join(known, [*_SEED, "dst"], "left_anti"))
        offers = cut_lineage(
            exposed.join(into, [*_KEYS, "dst"])
            .join(accepted.select(*_SEED, F.col("tile_id").alias("src"), "x", "y"), [*_SEED, "src"])
            .select(*_SEED, F.col("dst").alias("tile_id"), "src", (F.col("x") + F.col("dx")).alias("ox"),
                    (F.col("y") + F.col("dy")).alias("oy"), "base_weight"))
        agreed = agreement_cluster(
            offers, [*_SEED, "tile_id"], "ox", "oy", "base_weight", "base_weight", agree_px, k, "src")
        wanted = at.select(*_KEYS, "tile_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
        older, fresh = [offers, fresh, accepted], cut_lineage(
            agreed.join(wanted, [*_KEYS, "tile_id"])
            .where(distance(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")) <= limit_px)
            .select(*_SEED, "tile_id", "x", "y"))
        if fresh.isEmpty():
            return accepted
        accepted = cut_lineage(accepted.unionByName(fresh))
        for frame in older:
            release(frame)


def _attempted(seeds: DataFrame, grown: DataFrame) -> DataFrame:
    """The seeds of a batch that are really tried: not inside the set of an earlier tried one."""
    earlier = seeds.select(*_KEYS, F.col("seed").alias("by"))
    inside = seeds.select(*_SEED, "l", "m", "r").join(earlier, _KEYS).where(F.col("by") < F.col("seed"))
    for corner in "lmr":
        inside = inside.join(grown.select(*_KEYS, F.col("seed").alias("by"), F.col("tile_id").alias(corner)),
                             [*_KEYS, "by", corner], "left_semi")
    covered = inside.groupBy(*_SEED).agg(F.collect_set("by").alias("by"))
    none = F.array().cast("array<int>")
    in_order = seeds.select(*_SEED).join(covered, _SEED, "left").groupBy(*_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("seed", F.coalesce("by", none).alias("by")))).alias("s"))
    tried = F.aggregate("s", none, lambda done, e: F.when(F.arrays_overlap(done, e["by"]), done).otherwise(
        F.concat(done, F.array(e["seed"]))))
    return in_order.select(*_KEYS, F.explode(tried).alias("seed"))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of so many from each start, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _agreed(group: np.ndarray, ox: np.ndarray, oy: np.ndarray, w: np.ndarray, src: np.ndarray, radius: float, k: int) -> tuple[np.ndarray, ...]:
    """:func:`agreement_cluster` of offers sorted by group: the groups with ``k`` agreeing ones, and where they put their tile."""
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(cut, len(group)))
    piece = np.cumsum(size * size) // _PAIRS
    found = []
    for p in np.unique(piece):
        own = np.flatnonzero(piece == p)
        seeds = _ranges(cut[own], size[own])
        per = np.repeat(size[own], size[own])
        left, right = np.repeat(seeds, per), _ranges(np.repeat(cut[own], size[own]), per)
        near = np.sqrt((ox[right] - ox[left]) ** 2 + (oy[right] - oy[left]) ** 2) <= radius
        left, right = left[near], right[near]
        first = seeds[0]
        support = np.bincount(left - first, minlength=len(seeds))
        quality = np.round(np.bincount(left - first, w[right], len(seeds)), 9)
        order = np.lexsort([src[seeds], -quality, -support, group[seeds]])
        best = order[np.append(True, group[seeds][order][1:] != group[seeds][order][:-1])]
        best = best[support[best] >= k]
        place = np.full(len(seeds), -1)
        place[best] = np.arange(len(best))
        at = place[left - first]
        right, at = right[at >= 0], at[at >= 0]
        weight = np.bincount(at, w[right], len(best))
        weight = np.where(weight != 0, weight, np.nan)
        found.append((group[seeds[best]], *[np.bincount(at, o[right] * w[right], len(best)) / weight for o in (ox, oy)]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _largest_grown(rows: pa.Table, k: int, agree_px: float, limit_px: float, max_residual: float) -> pa.Table:
    """The largest set of one component: every seed is grown, best first, but those inside a set already grown.

    ``rows`` has the tiles (kind 0: id, place), edges (1: both ends, displacement, weight) and triangles (2: corners, quality).
    """
    run, component = rows["run_id"][0].as_py(), rows["component"][0].as_py()
    kind = rows["kind"].to_numpy()

    def of(number: int, *names: str) -> list[np.ndarray]:
        own = kind == number
        return [rows[c].to_numpy()[own] for c in names]

    tile, *target_at = of(0, "a", "x", "y")
    first_end, other_end, shift_x, shift_y, weight = of(1, "a", "b", "x", "y", "w")
    *corner, value = of(2, "a", "b", "c", "x")
    del rows, kind
    ids = np.unique(np.concatenate([tile, first_end, other_end]))
    n = len(ids)
    target = np.full((2, n), np.nan)
    target[:, np.searchsorted(ids, tile)] = target_at
    i, j = (np.searchsorted(ids, e) for e in (first_end, other_end))
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort([src, dst])
    src, dst = src[order], dst[order]
    dx, dy = (np.concatenate([e, -e])[order] for e in (shift_x, shift_y))
    w = np.concatenate([weight] * 2)[order]
    links = np.bincount(dst, minlength=n)
    start = np.cumsum(links) - links
    link = dst * n + src  # sorted
    worst = np.where(np.isnan(value), np.inf, -value)
    order = np.lexsort([*corner[::-1], worst])
    value = value[order]
    l, m, r = (np.searchsorted(ids, c[order]) for c in corner)
    del first_end, other_end, shift_x, shift_y, weight, corner, worst, order
    by_l = np.argsort(l, kind="stable")
    corners = np.bincount(l, minlength=n)
    first = np.cumsum(corners) - corners
    inside = np.zeros(len(l), bool)
    placed, x, y = np.zeros(n, bool), np.zeros(n), np.zeros(n)
    best, most = None, (0, 0)
    for seed in range(len(l)):
        if inside[seed] or np.isnan(target[0, l[seed]]):
            continue
        fresh = np.array([l[seed], m[seed], r[seed]])
        step = np.searchsorted(link, fresh[1:] * n + fresh[0])
        x[fresh] = target[0, fresh[0]] + np.append(0.0, dx[step])
        y[fresh] = target[1, fresh[0]] + np.append(0.0, dy[step])
        placed[fresh] = True
        members = [fresh]
        while len(fresh):
            near = src[_ranges(start[fresh], links[fresh])]
            exposed = np.unique(near[~placed[near]])
            at = _ranges(start[exposed], links[exposed])
            at = at[placed[src[at]]]
            if not len(at):
                break
            cut = np.flatnonzero(np.append(True, dst[at][1:] != dst[at][:-1]))
            offers = np.diff(np.append(cut, len(at)))
            at = at[np.repeat(offers >= k, offers)]
            if not len(at):
                break
            tile, nx, ny = _agreed(dst[at], x[src[at]] + dx[at], y[src[at]] + dy[at], w[at], src[at], agree_px, k)
            near = np.sqrt((nx - target[0, tile]) ** 2 + (ny - target[1, tile]) ** 2) <= limit_px
            fresh = tile[near]
            x[fresh], y[fresh], placed[fresh] = nx[near], ny[near], True
            members.append(fresh)
        members = np.concatenate(members)
        own = by_l[_ranges(first[members], corners[members])]
        inside[own[placed[m[own]] & placed[r[own]]]] = True
        if len(members) >= most[0]:
            at = _ranges(start[members], links[members])
            at = at[placed[src[at]]]
            gap = np.sqrt((x[dst[at]] - x[src[at]] - dx[at]) ** 2 + (y[dst[at]] - y[src[at]] - dy[at]) ** 2)
            size = (len(members), int((gap <= max_residual).sum()))
            if size > most:
                most, best = size, (seed, members, x[members], y[members])
        placed[members] = False
    if best is None:
        best = (0, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    seed, members, x, y = best
    grown = len(members)
    out = {"run_id": pa.array([run] * grown, pa.string()), "component": np.full(grown, component, np.int64), "seed": np.full(grown, seed + 1, np.int32),
           "tile_id": ids[members], "x": x, "y": y, "quality": np.full(grown, value[seed] if len(value) else 0.0), "wave": np.zeros(grown, np.int32)}
    return pa.table(out)


def _fit_a_task(at: DataFrame, links: DataFrame, tri: DataFrame, local_edges: int) -> DataFrame:
    """The components that one task can hold: of bounded size, and without repeated tiles or edges."""
    ends = links.groupBy(*_KEYS, "src", "dst").agg(F.count("*").alias("n"), F.count_if(F.isnull(F.col("dx") + F.col("dy") + F.col("base_weight"))).alias("bare"))
    ends = ends.groupBy(*_KEYS, "src").agg(F.sum("n").alias("degree"), F.max("n").alias("copies"), F.max("bare").alias("bare"))
    ends = ends.groupBy(*_KEYS).agg(F.sum("degree").alias("ends"), F.max("degree").alias("degree"), F.max("copies").alias("copies"), F.max("bare").alias("bare"))
    twice = at.groupBy(*_KEYS, "tile_id").count().where("count > 1").select(*_KEYS).distinct()
    many = tri.groupBy(*_KEYS).agg(F.count("*").alias("triangles"))
    fit = (F.col("ends") / 2 + F.col("triangles") <= local_edges) & (F.col("degree") <= _DEGREE) & (F.col("copies") == 1) & (F.col("bare") == 0)
    return ends.join(many, _KEYS).where(fit).select(*_KEYS).join(twice, _KEYS, "left_anti")


def _grow_whole(at: DataFrame, edges: DataFrame, tri: DataFrame, **limits) -> DataFrame:
    """The largest set of every component, one task a component."""
    zero, no_id = F.lit(0.0), F.lit(0).cast("bigint")
    rows = at.select(*_KEYS, F.lit(0).cast("byte").alias("kind"), F.col("tile_id").alias("a"), no_id.alias("b"), no_id.alias("c"), "x", "y", zero.alias("w"))
    rows = rows.unionByName(edges.select(*_KEYS, F.lit(1).cast("byte").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), no_id.alias("c"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("base_weight").alias("w")))
    rows = rows.unionByName(tri.select(*_KEYS, F.lit(2).cast("byte").alias("kind"), F.col("l").alias("a"), F.col("m").alias("b"), F.col("r").alias("c"), F.col("quality").alias("x"), zero.alias("y"), zero.alias("w")))
    return rows.groupBy(*_KEYS).applyInArrow(lambda df: _largest_grown(df, **limits), _GROWN)


def grow_components(
    tiles: DataFrame, edges: DataFrame, triangles: DataFrame, k: int = MIN_NEIGHBOURS,
    agree_px: float = AGREE_PX, max_correction_nm: float = MAX_CORRECTION_NM, max_seeds: int | None = None,
    max_residual: float = MAX_RESIDUAL_PX, nm_per_px: float = NM_PER_PX, batch: int = 16,
    local_edges: int = _HELD,
) -> tuple[DataFrame, DataFrame]:
    """The run's largest set of tiles that can be placed from one seed triangle.

    A tile joins when at least ``k`` placed neighbours agree on its position and
    that lies near its commanded place, one level of neighbours per round; the result does not depend on
    the order of edges.  Connected parts of at most ``local_edges`` edges and triangles, counted together, grow in one
    task each, all larger ones together as joins.  Seeds are tried best first, skipping triangles inside a
    set already grown, until no triangle is left: the best of each part alone,
    then ``batch`` at a time, twice as many each round, of which those inside
    another's set do not count as tried.  ``max_seeds`` ends it after so many
    tries per run (the source's number is ``MAX_SEEDS``); larger sets may be lost.
    """
    edges = cut_lineage(edges)
    comp = cut_lineage(connected_components(edges))
    at = cut_lineage(tiles.join(comp, ["run_id", "tile_id"]))
    back = edges.select("run_id", F.col("j").alias("src"), F.col("i").alias("dst"), (-F.col("dx")).alias("dx"),
                        (-F.col("dy")).alias("dy"), "base_weight", F.lit(False).alias("forward"))
    links = edges.select("run_id", F.col("i").alias("src"), F.col("j").alias("dst"), "dx", "dy", "base_weight",
                         F.lit(True).alias("forward")).unionByName(back)
    links = cut_lineage(links.join(comp.withColumnRenamed("tile_id", "src"), ["run_id", "src"]))
    open_tri = cut_lineage(triangle_quality(edges, triangles).join(comp.withColumnRenamed("tile_id", "l"), ["run_id", "l"]))
    limit_px = max_correction_nm / nm_per_px
    best_first = W.partitionBy(*_KEYS).orderBy(F.col("quality").desc(), "l", "m", "r")
    tries: list[DataFrame] = []
    if max_seeds is None:  # the limit counts the tries of a whole run
        fit = cut_lineage(_fit_a_task(at, links, open_tri, local_edges))
        own = [df.join(fit, _KEYS, "left_semi") for df in (at, links.where("forward"), open_tri)]
        tries.append(cut_lineage(_grow_whole(*own, k=k, agree_px=agree_px, limit_px=limit_px, max_residual=max_residual)))
        open_tri = cut_lineage(open_tri.join(fit, _KEYS, "left_anti"))
    for wave in count():
        many = batch << min(wave - 1, 6) if wave else 1
        seeds = cut_lineage(
            open_tri.withColumn("seed", F.row_number().over(best_first)).where(F.col("seed") <= many)
            .select(*_SEED, "l", "m", "r", "quality"))
        if seeds.isEmpty():
            break
        grown = _grow(seeds, at, links, k, agree_px, limit_px)
        grown = cut_lineage(
            grown.join(_attempted(seeds, grown), _SEED, "left_semi").join(seeds.select(*_SEED, "quality"), _SEED)
            .withColumn("wave", F.lit(wave)))
        tries.append(grown)
        inside = open_tri.select(*_KEYS, "l", "m", "r").join(
            grown.select(*_SEED, F.col("tile_id").alias("l")), [*_KEYS, "l"])
        for corner in "mr":
            inside = inside.join(grown.select(*_SEED, F.col("tile_id").alias(corner)), [*_SEED, corner], "left_semi")
        left = open_tri.join(inside.select("run_id", "l", "m", "r").distinct(), ["run_id", "l", "m", "r"], "left_anti")
        if max_seeds is not None:
            spent = tries[0].select(*_KEYS, "wave", "seed").distinct()
            for t in tries[1:]:
                spent = spent.unionByName(t.select(*_KEYS, "wave", "seed").distinct())
            spent = spent.groupBy(*_KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= max_seeds)
            left = left.join(spent, _KEYS, "left_anti")
        older, open_tri = open_tri, cut_lineage(left)
        release(older)
    none = tiles.select("run_id", "tile_id", "x", "y").limit(0)
    if not tries:
        return none, edges.limit(0)
    every = tries[0]
    for t in tries[1:]:
        every = every.unionByName(t)
    every = cut_lineage(every)
    key = [*_KEYS, "wave", "seed"]
    fits = edge_residuals(
        edges.join(comp.withColumnRenamed("tile_id", "i"), ["run_id", "i"])
        .join(every.select(*key, F.col("tile_id").alias("i")), ["run_id", "component", "i"]),
        every, tuple(key)).where(F.col("residual") <= max_residual)
    fits = cut_lineage(fits)
    score = every.groupBy(*key, "quality").agg(F.count("*").alias("tiles")).join(
        fits.groupBy(*key).agg(F.count("*").alias("edges")), key, "left").fillna(0, ["edges"])
    if max_seeds is not None:
        tried = W.partitionBy("run_id").orderBy(F.col("quality").desc(), "component", "wave", "seed")
        score = score.withColumn("turn", F.row_number().over(tried)).where(F.col("turn") <= max_seeds)
    earliest = [F.col("quality"), *[-F.col(c) for c in ("component", "wave", "seed")]]
    winner = score.groupBy("run_id").agg(F.max_by(
        F.struct("component", "wave", "seed"), F.struct("tiles", "edges", *earliest)).alias("w")
    ).select("run_id", "w.*")
    return (
        every.join(winner, key, "left_semi").select("run_id", "tile_id", "x", "y"),
        fits.join(winner, key, "left_semi").select(*edges.columns))


def refine_consensus(
    tiles: DataFrame, poses: DataFrame, edges: DataFrame, k: int = MIN_NEIGHBOURS,
    max_residual: float = MAX_RESIDUAL_PX, rounds: int = 2, anchor: float = POSE_ANCHOR,
    local_edges: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Prune to the core, keep its largest component, re-solve it, twice; then a last prune.

    Returns accepted poses with their degree, and the accepted edges.
    """
    extra = {} if local_edges is None else {"local_edges": local_edges}
    current, live = poses.select("run_id", "tile_id", "x", "y"), edges
    for _ in range(rounds):
        _, core = consensus_core(current, live, k, max_residual)
        main = cut_lineage(largest_component(connected_components(core)))
        live = cut_lineage(keep_edges(core, main))
        targets = tiles.select("run_id", "tile_id", "x", "y").join(main, ["run_id", "tile_id"], "left_semi")
        current = cut_lineage(solve_poses(targets, live, prior=0.0, anchor=anchor, **extra).drop("converged"))
    _, final = consensus_core(current, live, k, max_residual)
    deg = degrees(final)
    return current.join(deg, ["run_id", "tile_id"]), final
