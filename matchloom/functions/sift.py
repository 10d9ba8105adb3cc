"""Scale-invariant keypoints of a grey picture (Lowe, 2004) in NumPy: extrema of differences of Gaussians, orientations, descriptors.

The vector is the mean of the descriptors of the strongest keypoints: 128 numbers, zeros where there is none.
"""

from __future__ import annotations

import numpy as np

#: Fixed by the method: scales of an octave, blur of the first scale, least contrast, largest ratio of curvatures, bins.
SCALES, SIGMA, CONTRAST, EDGE, BINS = 3, 1.6, 0.04, 10.0, 36
DIMS = 128


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur along both axes; the border is mirrored."""
    r = max(1, int(np.ceil(4 * sigma)))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        size = a.shape[axis]
        at = np.abs(np.arange(-r, size + r))
        at = np.where(at % (2 * size) < size, at % (2 * size), 2 * size - 1 - at % (2 * size))
        wide = np.take(a, at, axis=axis)
        a = sum(w * np.take(wide, np.arange(k, k + size), axis=axis) for k, w in enumerate(kernel))
    return a


def octaves(gray: np.ndarray) -> list[np.ndarray]:
    """Per octave: SCALES + 3 blurred pictures, each octave at half the size of the one before."""
    base = blur(gray.astype(float) / 255, np.sqrt(SIGMA**2 - 0.5**2))
    step, out = 2 ** (1 / SCALES), []
    while min(base.shape) >= 16:
        stack = [base]
        for k in range(1, SCALES + 3):
            before = SIGMA * step ** (k - 1)
            stack.append(blur(stack[-1], before * np.sqrt(step**2 - 1)))
        out.append(np.stack(stack))
        base = stack[SCALES][::2, ::2]
    return out


def extrema(dog: np.ndarray) -> np.ndarray:
    """(scale, row, column) where a difference is larger, or smaller, than its 26 neighbours, strong, and no edge."""
    mid = dog[1:-1, 1:-1, 1:-1]
    shift = lambda s, y, x: dog[1 + s : dog.shape[0] - 1 + s, 1 + y : dog.shape[1] - 1 + y, 1 + x : dog.shape[2] - 1 + x]
    others = [shift(s, y, x) for s in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (s, y, x) != (0, 0, 0)]
    found = ((mid > np.max(others, axis=0)) | (mid < np.min(others, axis=0))) & (np.abs(mid) > CONTRAST / SCALES)
    dyy, dxx = shift(0, 1, 0) + shift(0, -1, 0) - 2 * mid, shift(0, 0, 1) + shift(0, 0, -1) - 2 * mid
    dxy = (shift(0, 1, 1) + shift(0, -1, -1) - shift(0, 1, -1) - shift(0, -1, 1)) / 4
    det = dxx * dyy - dxy * dxy
    found &= (det > 0) & ((dxx + dyy) ** 2 * EDGE < (EDGE + 1) ** 2 * det)
    return np.argwhere(found) + 1


def _patch(grad: tuple[np.ndarray, np.ndarray], y: int, x: int, r: int) -> tuple[np.ndarray, ...]:
    """Places around a keypoint, with the size and angle of their gradients."""
    dy, dx = grad
    ys, xs = np.mgrid[max(0, y - r) : min(dy.shape[0], y + r + 1), max(0, x - r) : min(dy.shape[1], x + r + 1)]
    gy, gx = dy[ys, xs].ravel(), dx[ys, xs].ravel()
    return (ys - y).ravel().astype(float), (xs - x).ravel().astype(float), np.hypot(gy, gx), np.arctan2(gy, gx) % (2 * np.pi)


def orientations(grad, y: int, x: int, sigma: float) -> list[float]:
    """Angles of the peaks of a histogram of gradients, those of at least 0.8 of the highest."""
    oy, ox, size, angle = _patch(grad, y, x, int(round(4.5 * sigma)))
    weight = size * np.exp(-(oy**2 + ox**2) / (2 * (1.5 * sigma) ** 2))
    hist = np.bincount((angle * BINS / (2 * np.pi)).round().astype(int) % BINS, weight, BINS)
    for _ in range(2):
        hist = (np.roll(hist, 1) + 2 * hist + np.roll(hist, -1)) / 4
    left, right = np.roll(hist, 1), np.roll(hist, -1)
    peaks = np.flatnonzero((hist > left) & (hist > right) & (hist >= 0.8 * hist.max()))
    return [float((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * hist[k] + right[k])) * 2 * np.pi / BINS) for k in peaks]


def descriptor(grad, y: int, x: int, sigma: float, turn: float) -> np.ndarray:
    """Gradients in 4 x 4 cells and 8 directions, relative to ``turn``; each is shared among its neighbouring cells and directions."""
    width = 3 * sigma
    oy, ox, size, angle = _patch(grad, y, x, int(round(width * np.sqrt(2) * 2.5)))
    c, s = np.cos(turn), np.sin(turn)
    u, v = (c * ox + s * oy) / width + 1.5, (c * oy - s * ox) / width + 1.5
    near = (u > -1) & (u < 4) & (v > -1) & (v < 4)
    u, v, size, angle = u[near], v[near], size[near], angle[near]
    weight = size * np.exp(-((u - 1.5) ** 2 + (v - 1.5) ** 2) / 8)
    d = ((angle - turn) % (2 * np.pi)) * 8 / (2 * np.pi)
    out = np.zeros((6, 6, 8))
    iu, iv, i = np.floor(u).astype(int), np.floor(v).astype(int), np.floor(d).astype(int)
    for a in (0, 1):
        for b in (0, 1):
            for k in (0, 1):
                share = np.abs(1 - a - (u - iu)) * np.abs(1 - b - (v - iv)) * np.abs(1 - k - (d - i))
                np.add.at(out, (iv + b + 1, iu + a + 1, (i + k) % 8), weight * share)
    vec = out[1:5, 1:5].ravel()
    norm = np.linalg.norm(vec)
    if norm == 0:
        return vec
    vec = np.minimum(vec / norm, 0.2)
    return np.minimum(np.rint(512 * vec / np.linalg.norm(vec)), 255)


def keypoints(gray: np.ndarray, most: int = 100) -> list[tuple[float, float, float, float, np.ndarray]]:
    """(row, column, scale, angle, descriptor) of the ``most`` strongest, by the difference's size; in the picture's own coordinates."""
    found = []
    for o, stack in enumerate(octaves(gray)):
        dog = np.diff(stack, axis=0)
        grads = {}
        for s, y, x in extrema(dog):
            if s not in grads:
                grads[s] = np.gradient(stack[s])
            sigma = SIGMA * 2 ** (s / SCALES)
            found += [(abs(dog[s, y, x]), o, s, y, x, sigma, grads[s], turn) for turn in orientations(grads[s], y, x, sigma)]
    found.sort(key=lambda f: -f[0])
    return [(float(y * 2**o), float(x * 2**o), sigma * 2**o, turn, descriptor(grad, y, x, sigma, turn)) for _, o, s, y, x, sigma, grad, turn in found[:most]]


def sift(gray: np.ndarray, most: int = 100) -> np.ndarray:
    """The mean descriptor."""
    points = keypoints(gray, most)
    return np.mean([p[4] for p in points], axis=0) if points else np.zeros(DIMS)
