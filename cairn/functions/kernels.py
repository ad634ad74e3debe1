"""Raster and outline kernels in NumPy, for the few operators that no relational form suits. Each works on one object's cells.

An outline runs through the centres of boundary pixels, so areas and lengths are those of the polygon it forms. Where several
outlines exist the one with the largest area counts.
"""

from __future__ import annotations

from collections import deque

import numpy as np

_RING = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def shift_any(image: np.ndarray, offsets) -> np.ndarray:
    """Dilation of a boolean image by a set of (du, dv)."""
    out = np.zeros_like(image)
    h, w = image.shape
    for du, dv in offsets:
        out[max(0, dv) : h + min(0, dv), max(0, du) : w + min(0, du)] |= image[max(0, -dv) : h + min(0, -dv), max(0, -du) : w + min(0, -du)]
    return out


def closed(image: np.ndarray, offsets) -> np.ndarray:
    return ~shift_any(~shift_any(image, offsets), offsets)


def opened(image: np.ndarray, offsets) -> np.ndarray:
    return shift_any(~shift_any(~image, offsets), offsets)


def rasterise(p: np.ndarray, pad: int, most: int, disc: bool, resolution: float = 0.003) -> np.ndarray | None:
    """Occupancy of 2-D points on a grid that starts at their minimum; None for fewer than 10 finite points or a side over `most`.

    With disc every point covers its four neighbours too and the image is closed by a cross; else it is closed and opened by a square.
    """
    p = p[np.isfinite(p).all(axis=1)] if len(p) else p
    if len(p) < 10:
        return None
    cell = ((p - p.min(axis=0)) / resolution).astype(np.int64)
    w, h = (cell.max(axis=0) + pad).tolist()
    if max(w, h) > most:
        return None
    image = np.zeros((h, w), bool)
    image[cell[:, 1], cell[:, 0]] = True
    cross, block = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return closed(shift_any(image, cross), cross) if disc else opened(closed(image, block), block)


def labelled(image: np.ndarray, neighbours: int = 8) -> tuple[np.ndarray, int]:
    """Labels 1 to n of the connected parts, in the order of their first pixel by rows."""
    out, n, (h, w) = np.zeros(image.shape, np.int64), 0, image.shape
    ring = _RING if neighbours == 8 else _RING[::2]
    for v, u in zip(*np.nonzero(image), strict=True):
        if out[v, u]:
            continue
        n += 1
        out[v, u] = n
        todo = deque([(u, v)])
        while todo:
            x, y = todo.popleft()
            for du, dv in ring:
                a, b = x + du, y + dv
                if 0 <= a < w and 0 <= b < h and image[b, a] and not out[b, a]:
                    out[b, a] = n
                    todo.append((a, b))
    return out, n


def outline(image: np.ndarray) -> np.ndarray:
    """The outer boundary of a single part as (n, 2) of u, v, followed clockwise from its first pixel."""
    pad = np.pad(image, 1)
    v, u = (int(x[0]) for x in np.nonzero(pad))
    path, at, back, first = [(u, v)], (u, v), 4, None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            du, dv = _RING[d]
            if pad[at[1] + dv, at[0] + du]:
                break
        else:
            break
        if at == path[0] and first is not None and d == first and len(path) > 1:
            path.pop()
            break
        if first is None:
            first = d
        at, back = (at[0] + du, at[1] + dv), (d + 4) % 8
        path.append(at)
    return np.array(path) - 1


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(float), p[:, 1].astype(float)
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def polygon_length(p: np.ndarray) -> float:
    return float(np.hypot(*(p - np.roll(p, -1, axis=0)).T).sum()) if len(p) > 1 else 0.0


def largest_outline(image: np.ndarray) -> np.ndarray | None:
    labels, n = labelled(image)
    paths = [outline(labels == k) for k in range(1, n + 1)]
    return max(paths, key=polygon_area, default=None)


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed polygon without the corners that lie within the tolerance of the line between their neighbours kept so far."""
    if len(p) < 3:
        return p
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))

    def keep(i: int, j: int) -> list[int]:
        span = p[i : j + 1] if j < len(p) else np.vstack([p[i:], p[:1]])
        a, b = span[0].astype(float), span[-1].astype(float)
        length = np.hypot(*(b - a))
        off = span - a
        d = np.abs(off[:, 0] * (b - a)[1] - off[:, 1] * (b - a)[0]) / length if length else np.hypot(*off.T)
        k = int(np.argmax(d))
        return keep(i, i + k) + [i + k] + keep(i + k, j) if d[k] > tolerance and 0 < k < len(span) - 1 else []

    return p[[0, *keep(0, far), far, *keep(far, len(p))]]


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    q = np.unique(p, axis=0).astype(float)
    if len(q) < 3:
        return q

    def half(points) -> list:
        out: list = []
        for c in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(half(q) + half(q[::-1]))


def least_rectangle(p: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(corners, width, height, angle in degrees) of the rectangle of least area around points; one side lies along the hull."""
    c = hull(p)
    edges = np.roll(c, -1, axis=0) - c
    best = None
    for a in sorted({round(float(np.arctan2(e[1], e[0])) % (np.pi / 2), 12) for e in edges if e.any()} or {0.0}):
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        q = c @ turn.T
        low, high = q.min(axis=0), q.max(axis=0)
        size = high - low
        if best is None or size.prod() < best[0] - 1e-12:
            corners = np.array([low, (high[0], low[1]), high, (low[0], high[1])]) @ turn
            best = (size.prod(), corners, float(size[0]), float(size[1]), float(np.degrees(a)))
    return best[1:]


def filled(p: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels inside or on a polygon, by crossings along rows; an edge touches the rows that it spans and no others."""
    inside, on, across = np.zeros((h, w), bool), np.zeros((h, w), bool), np.arange(w)
    for a, b in zip(p.astype(float), np.roll(p, -1, axis=0).astype(float), strict=True):
        low, high = np.ceil(np.minimum(a, b) - 1e-9).astype(int).clip(0), (np.floor(np.maximum(a, b) + 1e-9).astype(int) + 1).clip(0)
        u, v = across[None, low[0] : high[0]], np.arange(low[1], min(h, high[1]))[:, None]
        cross = (b[0] - a[0]) * (v - a[1]) - (b[1] - a[1]) * (u - a[0])
        on[low[1] : high[1], low[0] : high[0]] |= np.abs(cross) < 1e-9
        if a[1] != b[1]:
            v = np.arange(max(0, int(np.ceil(min(a[1], b[1])))), min(h, int(np.ceil(max(a[1], b[1])))))[:, None]
            if len(v):
                inside[v[0, 0] : v[-1, 0] + 1] ^= across < (b[0] - a[0]) * (v - a[1]) / (b[1] - a[1]) + a[0]
    return inside | on


def contour_features(image: np.ndarray) -> dict:
    """Circularity, aspect ratio of the box, corners and fill of the largest outline, with `valid`."""
    none = {"valid": False, "circularity": 0.0, "aspect_ratio": 0.0, "corners": 0, "rectangularity": 0.0, "line_support": 0.0}
    path = largest_outline(image) if image.any() else None
    if path is None:
        return none
    area, length = polygon_area(path), polygon_length(path)
    if area <= 1.0 or length <= 1e-6:
        return none
    w, h = (np.ptp(path, axis=0) + 1).tolist()
    corners = simplified(path, 0.02 * length)
    # Line support: the share of the outline that lies on straight runs of a sensible length.
    runs = np.hypot(*(corners - np.roll(corners, -1, axis=0)).T)
    straight = float(runs[runs >= max(8, int(0.15 * max(w, h)))].sum())
    return {"valid": True, "circularity": 4 * np.pi * area / length**2, "aspect_ratio": max(w, h) / max(1.0, min(w, h)), "corners": len(corners), "rectangularity": area / max(w * h, 1), "line_support": min(straight / max(length, 1.0), 1.0)}


def projection_features(p: np.ndarray) -> dict:
    """contour_features() of the occupancy of 2-D points, with the ratio of their principal variances (999 if there are too few)."""
    p = p[np.isfinite(p).all(axis=1)] if len(p) else p
    out = contour_features(np.zeros((1, 1), bool)) | {"pca_ratio": 999.0}
    if len(p) < 10:
        return out
    low, high = np.linalg.eigvalsh(np.cov(p.T))
    out["pca_ratio"] = float(high / max(low, 1e-6))
    image = rasterise(p, 3, 2048, disc=False)
    return out if image is None else out | contour_features(image)


def rectangle_fit(p: np.ndarray) -> dict:
    """How well a rotated rectangle covers the occupancy of 2-D points: iou and the score (iou - 0.45) / 0.45, clipped."""
    image = rasterise(p, 5, 4096, disc=True)
    path = largest_outline(image) if image is not None and image.any() else None
    if path is None or polygon_area(path) <= 1.0:
        return {"valid": False, "iou": 0.0, "score": 0.0, "nrmse": 1e9, "w": 0.0, "h": 0.0, "angle": 0.0}
    corners, w, h, angle = least_rectangle(path)
    low = np.minimum(path.min(axis=0), np.floor(corners.min(axis=0)).astype(int))
    size = np.maximum(path.max(axis=0), np.ceil(corners.max(axis=0)).astype(int)) - low + 1
    a = filled(path - low, int(size[1]), int(size[0]))
    b = filled(np.trunc(corners) - low, int(size[1]), int(size[0]))
    iou = float((a & b).sum() / max(1, (a | b).sum()))
    return {"valid": True, "iou": iou, "score": float(np.clip((iou - 0.45) / 0.45, 0, 1)), "nrmse": 1 - iou, "w": w, "h": h, "angle": angle}


def circle_fit(p: np.ndarray) -> dict:
    """Least-squares circle of 2-D points: radius, nrmse and the score 1 - nrmse / 0.18, clipped; invalid under 8 points."""
    if len(p) < 8:
        return {"valid": False, "score": 0.0, "nrmse": 1e9, "radius": 0.0}
    m = p.mean(axis=0)
    q = p - m
    s = (q * q).sum(axis=1)
    c, *_ = np.linalg.lstsq(2 * q, s - s.mean(), rcond=None)
    r = float(np.sqrt(max(c @ c + s.mean(), 0)))
    rmse = float(np.sqrt(np.mean((np.hypot(*(q - c).T) - r) ** 2)))
    nrmse = rmse / max(r, 1e-6)
    return {"valid": True, "score": float(np.clip(1 - nrmse / 0.18, 0, 1)), "nrmse": nrmse, "radius": r}


def distance(image: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every pixel to the nearest background; large where there is none."""
    h, w = image.shape
    far = float(h + w)
    line = np.where(image, far, 0.0)
    for u in range(1, w):
        line[:, u] = np.minimum(line[:, u], line[:, u - 1] + 1)
    for u in range(w - 2, -1, -1):
        line[:, u] = np.minimum(line[:, u], line[:, u + 1] + 1)
    out = np.full((h, w), np.inf)
    for dv in range(-h + 1, h):
        src, dst = slice(max(0, -dv), h - max(0, dv)), slice(max(0, dv), h - max(0, -dv))
        out[dst] = np.minimum(out[dst], line[src] ** 2 + dv * dv)
    return np.sqrt(out)
