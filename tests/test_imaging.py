"""Raster transforms against plain loops, and the queries that use them."""

import numpy as np

from quillon.operators import imaging as im
from quillon.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_components_match_a_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.45
        label, seen, n = im.components(mask), np.zeros_like(mask), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            n, todo, own = n + 1, [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                own.append(label[a, b])
                for c in range(max(0, a - 1), min(9, a + 2)):
                    for d in range(max(0, b - 1), min(11, b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            assert len(set(own)) == 1
        assert len(np.unique(label[mask])) == n and (label[~mask] == 0).all()


def test_warp_of_the_whole_is_the_same():
    img = np.random.default_rng(2).random((8, 8))
    assert np.allclose(im.warp(img, [(0, 0), (7, 0), (7, 7), (0, 7)], 8, 8), img)
    h = im.homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(2, 3), (5, 2), (6, 7), (1, 6)])
    u = h @ np.array([1, 1, 1.0])
    assert np.allclose(u[:2] / u[2], (6, 7))


def test_structure_and_texture():
    img = np.random.default_rng(3).random((16, 16))
    assert abs(im.structure(img, img) - 1) < 1e-9 and im.structure(img, 1 - img) < -0.8
    wave = np.sin(2 * np.pi * np.arange(32) / 8)[None, :] * np.ones((32, 1))
    f, direction, _ = im.texture_peak(wave)
    assert abs(f - 0.125) < 1e-9 and direction in (0.0, 180.0)
    assert np.argmax(im.band_energy(wave)) == 1 and im.band_energy(np.ones((8, 8))) is None


def test_quads():
    quad = im.order_quad(np.array([[300, 420], [10, 0], [300, 0], [10, 420]]))
    assert quad.tolist() == [[10, 0], [300, 0], [300, 420], [10, 420]]
    assert im.quad_score(quad, 320 * 430) > 0.9 and im.quad_score(quad, 10**8) is None


def test_raster_queries(spark):
    rows = {r.vec_id: np.array(r.embedding, float).reshape(8, 8) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    for r in catalog.band_energy(spark, DATA).collect():
        assert np.allclose(r.bands, im.band_energy(rows[r.vec_id]), atol=1e-5)
    for r in catalog.sharpness(spark, DATA).collect():
        assert abs(r.sharpness - im.laplacian_variance(rows[r.vec_id])) < 1e-5
    for r in catalog.structure_of_next(spark, DATA).collect():
        assert abs(r.structure - im.structure(rows[r.f], rows[r.g])) < 1e-5
    assert catalog.rectified(spark, DATA).count() == len(rows)
    found = {}
    for r in catalog.bright_regions(spark, DATA).collect():
        found.setdefault(r.vec_id, []).append(r["size"])
    assert {k: sorted(v) for k, v in found.items()} == {k: s for k, img in rows.items() if (s := sorted(int(n) for n in np.bincount(im.components(img >= 0.1).ravel())[1:] if n >= 3))}
