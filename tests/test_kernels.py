import struct
import zlib

import numpy as np
import pytest

from tessella.functions import kernels as K

R = np.random.default_rng(0)


def test_flat_pictures():
    flat = np.full((20, 30, 3), 128, np.uint8)
    assert K.laplacian_variance(K.luminance(flat)) < 1e-6 and K.gradient_energy(K.luminance(flat)) < 1e-6
    assert abs(K.exposure(flat)["mean_luminance"] - 128) < 1e-3
    assert K.illumination(flat)["relative_luminance_range"] < 1e-6
    assert K.color_cast(flat)["cast_magnitude"] < 0.01
    assert K.color_cast(K.channel_cast(flat, (1.1, 1.0, 0.9)))["cast_magnitude"] > 5


def test_blur_lowers_focus():
    sharp = R.integers(0, 256, (64, 64)).astype(float)
    assert K.laplacian_variance(K.area_resize(sharp, 16, 16)) < K.laplacian_variance(sharp)
    assert np.allclose(K.area_resize(sharp, 64, 64), sharp) and np.isclose(K.area_resize(sharp, 7, 5).mean(), sharp.mean(), rtol=0.02)


@pytest.mark.parametrize("eight", [True, False])
def test_components_match_flood_fill(eight):
    for _ in range(20):
        m = (R.random((12, 15)) < 0.45).astype(np.uint8)
        want, n = np.zeros(m.shape, int), 0
        near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (eight or not a or not b)]
        for y, x in zip(*np.nonzero(m), strict=True):
            if not want[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < 12 and 0 <= j < 15 and m[i, j] and not want[i, j]:
                        want[i, j] = n
                        todo += [(i + a, j + b) for a, b in near]
        got = K.components(m, eight)
        assert len(np.unique(got[got > 0])) == n and all(len(np.unique(got[want == k])) == 1 for k in range(1, n + 1))


def test_holes_boxes_and_borders():
    m = np.zeros((10, 10), np.uint8)
    m[2:8, 0:6] = 1
    m[4, 3] = 0
    assert K.holes(m).sum() == 1 and K.bounding_box(m) == (0, 2, 6, 8)
    assert K.border_touch(m)["left_touch_ratio"] == 0.6 and K.border_touch(m)["top_touch_ratio"] == 0
    assert K.border_touch(m * 0)["left_touch_ratio"] is None
    assert K.occlusion(np.zeros((10, 10, 3), np.uint8), m)["hole_ratio"] == 1 / 36
    assert K.geometry(m)["component_count"] == 1 and K.geometry(m * 0)["extent"] is None
    two = m.copy()
    two[9, 9] = 1
    assert (K.largest_component(two) == m).all()


def test_letterbox_and_back():
    m = (R.random((30, 50)) < 0.5).astype(np.uint8)
    m = np.kron(m, np.ones((4, 4), np.uint8))
    boxed, place = K.letterboxed(m, 400, 400)
    assert place == (80, 0, 240, 400)
    assert (K.unletterboxed(boxed.astype(float), place, *m.shape) == m).mean() > 0.98


def test_colors_and_hash():
    assert np.allclose(K.to_lab(np.array([[[255, 255, 255]]], np.uint8)), [100, 0, 0], atol=0.02)
    assert np.allclose(K.to_hsv(np.array([[[0, 255, 0], [0, 0, 255]]], np.uint8))[..., 0], [120, 240])
    p = R.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert K.difference_hash(p) == K.difference_hash(np.kron(p, np.ones((2, 2, 1), np.uint8))) and len(K.difference_hash(p)) == 16


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def test_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(7, 9))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x06\x01\x00")
    (tmp_path / "c.jpg").write_bytes(b"nothing")
    got = {r.path[-5:]: r for r in K.inspected(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["b.jpg"].format, got["b.jpg"].width) == (7, 9, "jpeg", 6)
    assert got["c.jpg"].error and got["c.jpg"].md5
    p = R.integers(0, 256, (32, 32, 3)).astype(np.uint8).tobytes()
    df = spark.createDataFrame([("1", 32, 32, p, None), ("2", 5, 5, p, None), ("3", 32, 32, None, None)], "sample_id string, width int, height int, pixels binary, mask binary")
    out = {r.sample_id: r for r in K.features(df).collect()}
    assert out["1"].error is None and out["1"].blur_score > 0 and out["2"].error and out["3"].blur_score is None
