"""Vectors of decoded images: an Arrow-batched function over Spark's image source, NumPy inside.

The vector has 184 numbers: histograms of hue, saturation and value (96), dominant colours (20), colour moments (9), local
binary patterns (26), co-occurrence (10), edges (17) and shapes (6). An image that can't be decoded gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from .sift import DIMS as SIFT_DIMS
from .sift import sift

SIDE = 224
DIMS = {"color_histogram": 96, "dominant_colors": 20, "color_moments": 9, "lbp": 26, "glcm": 10, "edges": 17, "shapes": 6}


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB bytes of shape (SIDE, SIDE, 3) from the image source's row-wise BGR, BGRA or grey bytes, resized bilinearly."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    a = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]
    at = lambda n: np.clip((np.arange(SIDE) + 0.5) * n / SIDE - 0.5, 0, n - 1)
    y, x = at(height), at(width)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 to 179), saturation and value as bytes."""
    c = rgb.astype(np.float64)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    v = c.max(axis=-1)
    d = v - c.min(axis=-1)
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    s = np.where(v == 0, 0, d * 255 / np.where(v == 0, 1, v))
    return np.stack([np.rint(np.where(d == 0, 0, h) % 180) % 180, np.rint(s), v], axis=-1)


def color_histogram(rgb: np.ndarray, bins: int = 32) -> np.ndarray:
    """A histogram per channel, each of unit L2 norm."""
    c = hsv(rgb)
    counts = [np.histogram(c[..., i], bins, (0, top))[0].astype(float) for i, top in enumerate((180, 256, 256))]
    return np.concatenate([x / np.linalg.norm(x) for x in counts])


def dominant_colors(rgb: np.ndarray, k: int = 5, starts: int = 10, rounds: int = 30) -> np.ndarray:
    """Red, green, blue and share of ``k`` clusters by share; equal pixels are clustered once, with their number as weight."""
    points, weight = np.unique(rgb.reshape(-1, 3), axis=0, return_counts=True)
    points, rng, best = points.astype(float), np.random.default_rng(42), None
    square = (points * points).sum(axis=1)[:, None]
    for _ in range(starts):
        centers = points[[rng.choice(len(points), p=weight / weight.sum())]]
        near = ((points - centers[0]) ** 2).sum(axis=1)
        while len(centers) < k:
            mass = near * weight
            new = points[rng.choice(len(points), p=mass / mass.sum())] if mass.sum() > 0 else points[0]
            centers = np.vstack([centers, new])
            near = np.minimum(near, ((points - new) ** 2).sum(axis=1))
        for _ in range(rounds):
            apart = square - 2 * points @ centers.T + (centers * centers).sum(axis=1)
            label = apart.argmin(axis=1)
            share = np.bincount(label, weight, k)
            sums = np.stack([np.bincount(label, weight * points[:, c], k) for c in range(3)], axis=1)
            moved = np.where(share[:, None] > 0, sums / np.maximum(share, 1)[:, None], centers)
            if np.allclose(moved, centers):
                break
            centers = moved
        inertia = (apart.min(axis=1) * weight).sum()
        if best is None or inertia < best[0]:
            best = inertia, centers, share / share.sum()
    order = np.argsort(-best[2], kind="stable")
    return np.column_stack([best[1], best[2]])[order].ravel()


def color_moments(rgb: np.ndarray) -> np.ndarray:
    """Mean, population deviation and skewness (0 without deviation) by channel."""
    c = rgb.reshape(-1, 3).astype(float)
    mean, std = c.mean(axis=0), c.std(axis=0)
    skew = np.where(std > 0, (((c - mean) / np.where(std > 0, std, 1)) ** 3).mean(axis=0), 0)
    return np.stack([mean, std, skew], axis=1).ravel()


def local_binary_patterns(g: np.ndarray, points: int = 24, radius: int = 3) -> np.ndarray:
    """Shares of uniform patterns by their number of brighter neighbours; what isn't uniform is the last bin."""
    n, pad = len(g), np.pad(g.astype(float), radius + 1)
    signs = []
    for a in 2 * np.pi * np.arange(points) / points:
        dy, dx = np.round(-radius * np.sin(a), 5), np.round(radius * np.cos(a), 5)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        part = lambda y, x: pad[radius + 1 + y : radius + 1 + y + n, radius + 1 + x : radius + 1 + x + n]
        value = (part(y0, x0) * (1 - fx) + part(y0, x0 + 1) * fx) * (1 - fy) if fy < 1 else 0
        value = value + ((part(y0 + 1, x0) * (1 - fx) + part(y0 + 1, x0 + 1) * fx) * fy if fy > 0 else 0)
        signs.append(value - g >= 0)
    s = np.stack(signs)
    changes = (s != np.roll(s, 1, axis=0)).sum(axis=0)
    counts = np.bincount(np.where(changes <= 2, s.sum(axis=0), points + 1).ravel(), minlength=points + 2)
    return counts / (counts.sum() + 1e-7)


def cooccurrence(g: np.ndarray) -> np.ndarray:
    """Mean and deviation over four directions of contrast, dissimilarity, homogeneity, energy and correlation at distance 1."""
    i, j = np.indices((256, 256))
    out = []
    for a, b in ((g[:, :-1], g[:, 1:]), (g[:-1, :-1], g[1:, 1:]), (g[:-1], g[1:]), (g[:-1, 1:], g[1:, :-1])):
        p = np.bincount(a.ravel().astype(int) * 256 + b.ravel(), minlength=65536).reshape(256, 256).astype(float)
        p = (p + p.T) / (2 * p.sum())
        mean = (i * p).sum()
        var = ((i - mean) ** 2 * p).sum()
        corr = ((i - mean) * (j - mean) * p).sum() / var if var > 1e-15 else 1.0
        out.append([((i - j) ** 2 * p).sum(), (abs(i - j) * p).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p * p).sum()), corr])
    return np.stack([np.mean(out, axis=0), np.std(out, axis=0)], axis=1).ravel()


def _flood(free: bytearray, places: list[int], steps: tuple[int, ...]) -> list[int]:
    """Takes from ``free`` all that hangs together with ``places``; each place is visited once."""
    out = [i for i in places if free[i]]
    for i in out:
        free[i] = 0
    for i in out:  # It grows while it is read.
        for step in steps:
            if free[i + step]:
                free[i + step] = 0
                out.append(i + step)
    return out


def _steps(width: int) -> tuple[int, ...]:
    """To the four neighbours, then to the four on the diagonals."""
    return 1, -1, width, -width, width + 1, width - 1, -width + 1, -width - 1


def edge_map(g: np.ndarray, low: int = 100, high: int = 200) -> np.ndarray:
    """Sobel gradients (L1 norm), non-maximum suppression in four directions, hysteresis."""
    p = np.pad(g.astype(float), 1, mode="edge")
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = abs(dx) + abs(dy)
    q, n = np.pad(m, 1), len(g)
    at = lambda y, x: q[1 + y : 1 + y + n, 1 + x : 1 + x + n]
    flat, steep = abs(dy) < abs(dx) * np.tan(np.pi / 8), abs(dy) > abs(dx) * np.tan(3 * np.pi / 8)
    rising = dx * dy < 0
    before = np.select([flat, steep, rising], [at(0, -1), at(-1, 0), at(-1, 1)], at(-1, -1))
    after = np.select([flat, steep, rising], [at(0, 1), at(1, 0), at(1, -1)], at(1, 1))
    thin = (m > before) & np.where(flat | steep, m >= after, m > after)
    weak, strong = np.pad(thin & (m > low), 1), np.pad(thin & (m > high), 1)
    kept = np.zeros(weak.size, bool)
    kept[_flood(bytearray(weak.tobytes()), np.flatnonzero(strong).tolist(), _steps(weak.shape[1]))] = True
    return kept.reshape(weak.shape)[1:-1, 1:-1]


def edges(g: np.ndarray, grid: int = 4) -> np.ndarray:
    """The share of edge pixels in the image and in each cell of the grid."""
    e = edge_map(g)
    size = SIDE // grid
    return np.concatenate([[e.mean()], e.reshape(grid, size, grid, size).mean(axis=(1, 3)).ravel()])


#: Neighbours clockwise from the east, as (row, column).
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _outline(mask: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """The outer border of the region of padded ``mask`` whose first pixel in reading order is ``start``, by Moore tracing."""
    at, back, path, moves = start, 4, [], set()
    while True:
        for turn in range(1, 9):
            d = (back + turn) % 8
            to = at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]
            if mask[to]:
                break
        else:
            return [start]
        if (at, d) in moves:
            return path
        moves.add((at, d))
        path.append(at)
        # The neighbour that was looked at before, as seen from the new pixel.
        at, back = to, (d + 6 - d % 2) % 8


def shapes(g: np.ndarray, threshold: int = 127) -> np.ndarray:
    """Number of outer outlines, mean area and perimeter, the largest one's area, perimeter and circularity; zeros without any."""
    mask = np.pad(g > threshold, 2)
    if not mask.any():
        return np.zeros(6)
    width, ground = mask.shape[1], ~mask
    ground[[0, -1]] = ground[:, [0, -1]] = False
    solid = np.ones(mask.size, bool)
    solid[_flood(bytearray(ground.tobytes()), [width + 1], _steps(width)[:4])] = False
    solid = solid.reshape(mask.shape)
    solid[[0, -1]] = solid[:, [0, -1]] = False
    free, found = bytearray(solid.tobytes()), []
    for i in np.flatnonzero(solid).tolist():
        if free[i]:
            _flood(free, [i], _steps(width))
            path = np.array(_outline(solid, divmod(i, width)), float)
            step = np.roll(path, -1, axis=0)
            area = abs((path[:, 0] * step[:, 1] - path[:, 1] * step[:, 0]).sum()) / 2
            found.append((area, np.hypot(*(step - path).T).sum()))
    area, length = np.array(found).T
    most = area.argmax()
    round_ = 4 * np.pi * area[most] / length[most] ** 2 if length[most] > 0 else 0
    return np.array([len(found), area.mean(), length.mean(), area[most], length[most], round_])


def vector(rgb: np.ndarray, include_sift: bool = False) -> np.ndarray:
    """184 numbers, and with ``include_sift`` 128 more."""
    g = gray(rgb)
    more = [sift(g)] if include_sift else []
    return np.concatenate([color_histogram(rgb), dominant_colors(rgb), color_moments(rgb), local_binary_patterns(g), cooccurrence(g), edges(g), shapes(g), *more])


def image_result(image: Column | str, include_sift: bool = False) -> Column:
    """A struct (vector, error) for a struct of the image source: one of both is null. A broken image costs its row, not the task."""
    ship(SparkSession.active())

    @F.pandas_udf("struct<vector: array<double>, error: string>")
    def one(images: pd.DataFrame) -> pd.DataFrame:
        vectors, errors = [], []
        for h, w, c, data in zip(images["height"], images["width"], images["nChannels"], images["data"]):
            made = error = None
            if data is None or pd.isna(h):
                error = "there is no image file"
            elif h <= 0 or w <= 0:
                error = "the file can't be decoded as an image"
            else:
                try:
                    made = vector(decode(int(h), int(w), int(c), data), include_sift).tolist()
                except Exception as e:  # whatever is wrong with one image, the others go on and the message is kept
                    error = f"{type(e).__name__}: {e}"
            vectors.append(made)
            errors.append(error)
        return pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return one(image)


def image_vector(image: Column | str) -> Column:
    """184 numbers for a struct of the image source; null where it can't be made."""
    return image_result(image)["vector"]


def dims(include_sift: bool = False) -> Column:
    """The parts of a vector and their widths."""
    return F.create_map(*(F.lit(x) for pair in (DIMS | ({"sift": SIFT_DIMS} if include_sift else {})).items() for x in pair))


def image_features(images: DataFrame, include_sift: bool = False) -> DataFrame:
    """(path, image_features, image_feature_dims, error) for the rows of the image source."""
    made = images.select(F.col("image.origin").alias("path"), image_result("image", include_sift).alias("made"))
    return made.select("path", F.col("made.vector").alias("image_features"), F.when(F.col("made.vector").isNotNull(), dims(include_sift)).alias("image_feature_dims"), F.col("made.error").alias("error"))
