"""Image vectors: by hand for simple pictures, and through Spark's image source."""

import struct
import zlib

import numpy as np
import pytest

from matchloom.functions import images as I
from matchloom.sources.items import read_images


def png(rgb: np.ndarray) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def canvas(*boxes) -> np.ndarray:
    g = np.zeros((224, 224), np.uint8)
    for y, x, h, w, value in boxes:
        g[y : y + h, x : x + w] = value
    return g


def test_shapes():
    n, area, length, most, most_length, roundness = I.shapes(canvas((10, 10, 10, 20, 255), (100, 100, 5, 5, 255)))
    assert (n, most, most_length) == (2, 9 * 19, 2 * (9 + 19)) and area == (9 * 19 + 16) / 2 and length == (56 + 16) / 2
    assert roundness == pytest.approx(4 * np.pi * 171 / 56**2)


def test_shapes_inside_a_ring_are_not_outer():
    assert I.shapes(canvas((10, 10, 50, 50, 255), (15, 15, 40, 40, 0), (30, 30, 5, 5, 255)))[:2].tolist() == [1, 49 * 49]


def test_shapes_at_the_border_points_and_none():
    assert I.shapes(canvas((0, 0, 224, 224, 255)))[3:5].tolist() == [223 * 223, 4 * 223]
    assert I.shapes(canvas((5, 5, 1, 1, 255))).tolist() == [1, 0, 0, 0, 0, 0]
    assert I.shapes(canvas((5, 5, 1, 4, 255)))[4] == 6
    assert not I.shapes(canvas()).any()


def test_edges_lie_on_the_border_of_a_box():
    e = I.edge_map(canvas((56, 56, 112, 112, 255)))
    rows, cols = np.nonzero(e)
    assert e.any() and not e[60:160, 60:160].any() and rows.min() >= 54 and cols.max() <= 169
    assert I.edges(canvas()).tolist() == [0] * 17


def test_flat_image():
    rgb = np.full((224, 224, 3), (255, 0, 0), np.uint8)
    v = I.vector(rgb)
    assert len(v) == sum(I.DIMS.values()) == 184 and np.isfinite(v).all()
    assert v[[0, 63, 95]].tolist() == [1, 1, 1]  # Hue 0, full saturation and value.
    assert v[96:100].tolist() == [255, 0, 0, 1]
    assert v[116:119].tolist() == [255, 0, 0]
    assert v[151:161].tolist() == [0, 0, 0, 0, 1, 0, 1, 0, 1, 0]


def test_colors_and_hue():
    rgb = np.zeros((224, 224, 3), np.uint8)
    rgb[:56], rgb[56:] = (0, 255, 0), (0, 0, 255)
    assert I.dominant_colors(rgb)[:8] == pytest.approx([0, 0, 255, 0.75, 0, 255, 0, 0.25])
    assert I.hsv(rgb)[[0, 223], 0, 0].tolist() == [60, 120]


def test_image_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in I.image_features(read_images(spark, tmp_path.as_uri())).collect()}
    assert rows["b.png"].image_features is None and rows["b.png"].image_feature_dims is None
    got = np.array(rows["a.png"].image_features)
    bgr = rgb[:, :, ::-1].tobytes()
    assert got == pytest.approx(I.vector(I.decode(40, 30, 3, bgr))) and rows["a.png"].image_feature_dims["lbp"] == 26
    assert np.array_equal(I.decode(224, 224, 3, np.full((224, 224, 3), (1, 2, 3), np.uint8).tobytes())[0, 0], [3, 2, 1])
