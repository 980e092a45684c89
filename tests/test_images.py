"""Registration, preprocessing, mosaics and locating on a seeded texture."""

import numpy as np
import pytest

from stagelog.operators import locate as L, mosaic as M, pixels as PX, registration as R

POS = [(100, 100), (230, 140), (160, 260), (300, 300)]
SIDE = 420


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(5)
    big = rng.integers(0, 256, (900, 900)).astype(float)
    big = ((big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + np.roll(big, (1, 1), (0, 1))) / 4).astype(np.uint8)
    rows = [("a", k, SIDE, SIDE, big[y: y + SIDE, x: x + SIDE].tobytes()) for k, (x, y) in enumerate(POS)]
    tiles = spark.createDataFrame(rows, "run_id string, tile_id bigint, w int, h int, pixels binary").cache()
    poses = spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(POS)],
                                  "run_id string, tile_id bigint, x double, y double")
    return big, tiles, poses


def expected(spark, error):
    rng = np.random.default_rng(2)
    rows = [("a", i, j, *(float(POS[j][a] - POS[i][a] + rng.integers(-error, error + 1)) for a in (0, 1)))
            for j in range(4) for i in range(j)]
    return spark.createDataFrame(rows, "run_id string, i bigint, j bigint, dx double, dy double")


def shift(r):
    return tuple(POS[r.j][a] - POS[r.i][a] for a in (0, 1))


def test_normalised_correlation_matches_direct():
    rng = np.random.default_rng(1)
    image, t = rng.integers(0, 256, (23, 31)), rng.integers(0, 256, (7, 9))
    image[:8, :10] = 5
    got = R.zero_mean_ncc(image, t)
    for y in range(17):
        for x in range(23):
            w = image[y: y + 7, x: x + 9].astype(float)
            want = 0.0 if w.std() == 0 else np.corrcoef(w.ravel(), t.ravel())[0, 1]
            assert got[y, x] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("method, params, tolerance", [
    ("phase", None, 0.1), ("circular", R.CircularParams(150, 150), 0)])
def test_other_methods_agree_on_the_sign(spark, scene, method, params, tolerance):
    near = expected(spark, 0).where("(i = 0 AND j = 1) OR (i = 2 AND j = 3)")
    got = R.register_pairs(near, scene[1], method, params).collect()
    assert len(got) == 2
    for r in got:
        assert (r.dx, r.dy) == pytest.approx(shift(r), abs=tolerance)


def test_phase_surface(spark, scene):
    r = R.register_pairs(expected(spark, 0).where("j = 1"), scene[1], "phase", keep_surface=True).first()
    s = np.array(r.surface).reshape(SIDE, SIDE)
    y, x = np.unravel_index(s.argmax(), s.shape)
    assert (SIDE // 2 - x, SIDE // 2 - y) == shift(r)


def test_circular_matches_direct():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (12, 10)), rng.integers(0, 256, (12, 10))
    p = R.CircularParams(3, 2, ignore=(1, 1, 2, 3))
    got = R.register_circular(a, b, p)
    x, y, w, h = p.ignore
    a, b = a.copy(), b.copy()
    a[y: y + h + 1, x: x + w + 1] = b[y: y + h + 1, x: x + w + 1] = 0
    scores = {(dx, dy): np.corrcoef(a.ravel(), np.roll(b, (dy, dx), (0, 1)).ravel())[0, 1] for dy in range(-2, 3) for dx in range(-3, 4)}
    best = max(scores, key=scores.get)
    assert (got["dx"], got["dy"]) == best and got["score"] == pytest.approx(scores[best])
    assert R.register_circular(np.zeros((4, 4)), np.zeros((4, 4)), R.CircularParams()) == dict(dx=0.0, dy=0.0, score=-1.0)


def test_preprocessing(scene, spark):
    image = np.arange(81, dtype=np.uint8).reshape(9, 9)
    assert PX.median(image, 3)[4, 4] == image[4, 4] and PX.median(image, 1) is image
    assert PX.sobel(image)[4, 4] == 40 and (PX.gaussian5(np.full((6, 6), 9, np.uint8)) == 9).all()
    assert (PX.blackman(np.full((9, 9), 100, np.uint8), 5) == 100).all()
    assert PX.tukey(11, 0.5)[0] == 0 and PX.tukey(11, 0.5)[5] == 1 and (PX.tukey(5, 0) == 1).all()
    out = PX.preprocess_tiles(scene[1], [{"op": "gaussian"}, {"op": "normalize"}]).first()
    body = PX.as_array(out.pixels, SIDE, SIDE)
    assert body.dtype == np.float32 and 0 <= body.min() and body.max() <= 1
    with pytest.raises(ValueError):
        PX.apply_step(image, {"op": "sharpen"})


@pytest.mark.parametrize("blend, limit", [("feather", 64), ("feather", 2), ("sharp", 64), ("sharp", 2)])
def test_mosaic(scene, blend, limit):
    big, tiles, poses = scene
    canvas, weight = np.zeros((700, 700)), np.zeros((700, 700))
    for x, y in POS:
        canvas[y - 68: y - 68 + SIDE, x - 68: x - 68 + SIDE] = big[y: y + SIDE, x: x + SIDE]
        weight[y - 68: y - 68 + SIDE, x - 68: x - 68 + SIDE] += 1
    blocks = M.compose_mosaic(tiles, poses, block=256, blend=blend, group_limit=limit).collect()
    assert sum(r.covered for r in blocks) == (weight > 0).sum()
    if blend == "feather":
        assert sum(r.overlapped for r in blocks) == (weight > 1).sum()
    for r in blocks:
        part = np.zeros((256, 256))
        cut = canvas[r.by * 256: r.by * 256 + 256, r.bx * 256: r.bx * 256 + 256]
        part[: cut.shape[0], : cut.shape[1]] = cut
        assert (PX.as_array(r.pixels, 256, 256) == part).all()


def test_feather_weights_and_ties(spark):
    tiles = spark.createDataFrame([("a", 0, 4, 4, bytes([10] * 16)), ("a", 1, 4, 4, bytes([20] * 16))],
                                  "run_id string, tile_id bigint, w int, h int, pixels binary")
    poses = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0)], "run_id string, tile_id bigint, x double, y double")
    b = M.compose_mosaic(tiles, poses, block=8, feather=64, margin=0).first()
    row = PX.as_array(b.pixels, 8, 8)[1]
    assert list(row[:5]) == [10, (2 * 10 + 20) // 3, 15, (10 + 2 * 20) // 3, 20]
    s = M.compose_mosaic(tiles, poses, block=8, feather=64, margin=0, blend="sharp").first()
    assert list(PX.as_array(s.pixels, 8, 8)[1][:5]) == [10, 10, 10, 20, 20]


def test_locate(spark, scene):
    _, tiles, poses = scene
    blocks = M.compose_mosaic(tiles, poses, block=256)
    got = {r.tile_id: r for r in L.locate_tiles(tiles, blocks, 256, SIDE, SIDE).collect()}
    for k, (x, y) in enumerate(POS):
        assert (got[k].x, got[k].y) == (x - 68, y - 68) and got[k].confidence > 0.95
    exact = {r.tile_id: r for r in L.locate_tiles(tiles, blocks, 256, SIDE, SIDE, blur=False).collect()}
    assert exact[1].confidence == 1.0
    small = L.locate_tiles(tiles, blocks.where("bx = 0 AND by = 0"), 256, SIDE, SIDE).collect()
    assert len(small) == 4 and all(r.x is None and r.confidence is None for r in small)


def test_locate_in_an_image(spark, scene):
    big, tiles, _ = scene
    image = spark.createDataFrame([("a", 780, 770, big[:770, :780].tobytes())], "run_id string, w int, h int, pixels binary")
    blocks, size = L.cut_blocks(image, 256)
    got = {r.tile_id: (r.x, r.y) for r in L.locate_tiles(tiles, blocks, 256, SIDE, SIDE, blur=False, size=size).collect()}
    assert got == dict(enumerate(POS))
