"""Split of merged objects: kernels over the points of one object in one frame, which the image size bounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import SplitConfig
from . import rules
from .kernels import closed, distance, labelled, shift_any
from .rules import Numbers

_SQUARE3 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
_SQUARE5 = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]


@dataclass
class Camera:
    k: tuple[float, float, float, float]
    h: int
    w: int

    def pixels(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """u, v, rounded half to even, and whether they lie in the image and in front."""
        fx, fy, cx, cy = self.k
        z = np.maximum(p[:, 2], 1e-6)
        u, v = np.rint(fx * p[:, 0] / z + cx).astype(int), np.rint(fy * p[:, 1] / z + cy).astype(int)
        return u, v, (p[:, 2] > 1e-6) & (u >= 0) & (u < self.w) & (v >= 0) & (v < self.h)

    def mask(self, p: np.ndarray) -> np.ndarray:
        """Pixels of points, dilated and closed by a square of 5."""
        u, v, ok = self.pixels(p)
        out = np.zeros((self.h, self.w), bool)
        out[v[ok], u[ok]] = True
        return closed(shift_any(out, _SQUARE5), _SQUARE5)


def voxel_mean(p: np.ndarray, edge: float) -> np.ndarray:
    if edge <= 0 or not len(p):
        return p
    cell = np.floor((p[:, :3] - p[:, :3].min(axis=0) + edge / 2) / edge).astype(int)
    _, where, n = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
    out = np.zeros((len(n), p.shape[1]))
    np.add.at(out, where.ravel(), p)
    return out / n[:, None]


#: Pairs that a kernel holds at a time.
PORTION = 1_000_000


class _Cells:
    """Points by cells of a grid of the given edge: the cells' numbers `ids`, and which points lie in each."""

    def __init__(self, p: np.ndarray, edge: float, reach: int = 1):
        cell = np.floor((p[:, :3] - p[:, :3].min(axis=0)) / edge).astype(np.int64) + reach
        side = cell.max(axis=0) + reach + 1
        self.step, self.reach = np.array([side[1] * side[2], side[2], 1]), reach
        self.key = cell @ self.step
        self.order = np.argsort(self.key, kind="stable")
        self.ids, self.starts, self.counts = np.unique(self.key[self.order], return_index=True, return_counts=True)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of cells in ids, and how many points each holds, 0 for one that isn't there."""
        at = np.minimum(np.searchsorted(self.ids, keys), len(self.ids) - 1)
        return at, np.where(self.ids[at] == keys, self.counts[at], 0)

    def moves(self) -> np.ndarray:
        return np.array([(np.array(o) - self.reach) @ self.step for o in np.ndindex(*[2 * self.reach + 1] * 3)])

    def points(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first n points of each cell, one cell after the other."""
        return self.order[np.repeat(self.starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _portions(n: np.ndarray):
    """Slices of n that add up to PORTION or hold one entry."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
        yield slice(at, stop)
        at = stop


def near_pairs(p: np.ndarray, radius: float, block: int = 20_000, own: np.ndarray | None = None):
    """(a, b, distance) of all ordered pairs a != b at most radius apart, in portions; a point is compared with those of its cell and the 26 around it.

    own: the points that are wanted as a, all if None. A portion has all pairs of its points: of `block` points at most, and of no more than PORTION candidates.
    """
    own = np.arange(len(p)) if own is None else own
    if len(p) < 2 or not len(own):
        return
    cells = _Cells(p, radius)
    moves, total = cells.moves(), np.zeros(len(own), np.int64)
    for m in moves:
        total += cells.at(cells.key[own] + m)[1]
    for part in _portions(np.maximum(total, -(-PORTION // block))):
        some, out = own[part], []
        for m in moves:
            at, n = cells.at(cells.key[some] + m)
            a, b = np.repeat(some, n), cells.points(at, n)
            d = np.linalg.norm(p[a, :3] - p[b, :3], axis=1)
            ok = (d <= radius) & (a != b)
            out.append((a[ok], b[ok], d[ok]))
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def knn(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the k-th neighbour, and the mean of the distances to the first k; 1e6 for a point that is alone.

    Points without k neighbours within a radius are looked at again with twice the radius, so it only sets the cost. It begins where a point's cell has
    some k points, on average over the points. Of equal points k + 1 are looked at; all of them have the same neighbours.
    """
    n, k = len(p), min(k, len(p) - 1)
    kth, mean = np.full(n, 1e6), np.full(n, 1e6)
    if k < 1:
        return kth, mean
    _, where, copies = np.unique(p[:, :3], axis=0, return_inverse=True, return_counts=True)
    where = where.ravel()
    if copies.max() > k + 1:
        order = np.argsort(where, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(copies) - copies, copies)
        held = np.flatnonzero(rank <= k)
        some = knn(p[held], k)
        first = np.empty(len(copies), np.int64)
        first[where[held]] = np.arange(len(held))
        return some[0][first[where]], some[1][first[where]]
    reach = float(np.linalg.norm(np.ptp(p[:, :3], axis=0)))
    radius = max(reach, 1e-9)
    while radius > reach / 2**16 and (_Cells(p, radius).counts ** 2.0).sum() > (k + 1) * n:
        radius /= 2
    todo = np.arange(n)
    while todo.size:
        last = radius >= reach
        done = np.zeros(n, bool)
        for a, _, d in near_pairs(p, max(radius, 1e-9) * (1 + 1e-9), own=todo):
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            ids, first, have = np.unique(a, return_index=True, return_counts=True)
            full = have >= k
            near = d[first[full][:, None] + np.arange(k)]
            kth[ids[full]], mean[ids[full]] = near[:, -1], near.mean(axis=1)
            done[ids[full]] = True
        if last:
            break
        todo, radius = todo[~done[todo]], 2 * radius
    return kth, mean


def _spread(label: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The least label of each node's component."""
    while True:
        before = label.copy()
        np.minimum.at(label, e[0], label[e[1]])
        np.minimum.at(label, e[1], label[e[0]])
        label = label[label]
        if np.array_equal(before, label):
            return label


def sets_meet(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    """Whether a point of a and one of b are at most radius apart; those next to the other set's box come first."""
    for _ in range(2):
        off = np.maximum(b.min(axis=0) - a, a - b.max(axis=0)).clip(0)
        far = (off * off).sum(axis=1)
        near = np.flatnonzero(far <= radius * radius * (1 + 1e-9))
        if not len(near):
            return False
        a, b = b, a[near[np.argsort(far[near], kind="stable")]]
    size = 32
    for i in range(0, len(a), size):
        for j in range(0, len(b), PORTION // size if i else size):
            d = a[i : i + size, None] - b[None, j : j + (PORTION // size if i else size)]
            if ((d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]) <= radius * radius).any():
                return True
    return False


#: Share of the radius that the edge of a cell has whose points are all near each other.
CLIQUE = (1 - 1e-9) / 3**0.5


def components(p: np.ndarray, radius: float, core: np.ndarray | None = None) -> np.ndarray:
    """The least index of each point's component in the graph of points at most radius apart; only core points link.

    Cells are so small that their points are one component; two cells at most two apart link if some of their points do, and are only asked if they are not
    in one component yet. So no list of pairs is made, however dense the points are.
    """
    label = np.arange(len(p))
    some = label if core is None else np.flatnonzero(core)
    if len(some) < 2:
        return label
    q = np.ascontiguousarray(p[some, :3])
    cells = _Cells(q, radius * CLIQUE, 2)
    pairs = []
    for m in cells.moves():
        if m > 0:
            at, n = cells.at(cells.ids + m)
            pairs.append(np.stack([np.flatnonzero(n), at[n > 0]]))
    pairs, known = np.hstack(pairs), np.arange(len(cells.ids))
    for most in (1, 8, None):  # that many points of either cell first; all in the end
        pairs = pairs[:, known[pairs[0]] != known[pairs[1]]]
        if most:
            na, nb = (np.minimum(cells.counts[c], most) for c in pairs)
            hit = np.zeros(pairs.shape[1], bool)
            for part in _portions(na * nb):
                a = cells.points(pairs[0, part], na[part])
                each = np.repeat(nb[part], na[part])
                b = cells.points(np.repeat(pairs[1, part], na[part]), each)
                ok = np.linalg.norm(q[np.repeat(a, each)] - q[b], axis=1) <= radius
                of = np.repeat(np.arange(part.start, part.stop), (na * nb)[part])
                hit[of[ok]] = True
            known = _spread(known, known[pairs[:, hit]])
            pairs = pairs[:, ~hit]
            continue
        own = lambda c: q[cells.order[cells.starts[c] : cells.starts[c] + cells.counts[c]]]
        for a, b in pairs.T.tolist():
            if known[a] != known[b] and sets_meet(own(a), own(b), radius):
                low, high = sorted((known[a], known[b]))
                known[known == high] = low
    part = np.empty(len(q), np.int64)
    part[cells.order] = np.repeat(known, cells.counts)
    least = np.full(len(cells.ids), len(p))
    np.minimum.at(least, part, some)
    label[some] = least[part]
    return label


def clusters(p: np.ndarray, radius: float, least: int) -> list[np.ndarray]:
    """Index arrays of the components with at least `least` points, largest first."""
    label = components(p, radius)
    ids, n = np.unique(label, return_counts=True)
    return [np.flatnonzero(label == i) for i, k in sorted(zip(ids, n, strict=True), key=lambda x: (-x[1], x[0])) if k >= least]


def dbscan(p: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels of density clusters, -1 for noise; a border point goes to its nearest core point, the first among equals."""
    if not len(p):
        return np.zeros(0, int)
    cells = _Cells(p, eps * CLIQUE)
    core = np.zeros(len(p), bool)
    core[cells.order] = np.repeat(cells.counts >= least, cells.counts)
    few = np.flatnonzero(~core)
    near = np.ones(len(p), int)
    for a, _, _ in near_pairs(p, eps, own=few):
        near += np.bincount(a, minlength=len(p))
    core[few] = near[few] >= least
    label = np.where(core, components(p, eps, core), -1)
    out = label.copy()
    for a, b, d in near_pairs(p, eps, own=np.flatnonzero(~core)):
        a, b, d = a[core[b]], b[core[b]], d[core[b]]
        order = np.lexsort((b, d, a))
        ids, first = np.unique(a[order], return_index=True)
        out[ids] = label[b[order][first]]
    return out


def denoise(p: np.ndarray, voxel: float = 0.003, k: int = 20, std_ratio: float = 1.5, keep: str = "largest", ratio: float = 0.15, eps: float | None = None, least: int | None = None) -> np.ndarray:
    """Voxel means, without statistical outliers, and of the density clusters the largest, those of at least ratio times its size, or all."""
    p = voxel_mean(p, voxel)
    if len(p) > k:
        mean = knn(p, k)[1]
        p = p[mean <= mean.mean() + std_ratio * mean.std(ddof=1)]
    if keep == "all" or not len(p):
        return p
    label = dbscan(p, eps or max(3 * voxel, 0.008), least or max(10, min(k, 20)))
    ids, n = np.unique(label[label >= 0], return_counts=True)
    if not len(ids):
        return p
    chosen = ids[n >= (n.max() if keep == "largest" else ratio * n.max())]
    return p[np.isin(label, chosen[:1] if keep == "largest" else chosen)]


def extent(p: np.ndarray) -> np.ndarray:
    return np.subtract(*np.quantile(p[:, :3], [0.95, 0.05], axis=0)) if len(p) else np.zeros(3)


def scales(p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(p[:, :3].T))[::-1], 1e-12)) if len(p) >= 10 else np.zeros(3)


def density(p: np.ndarray) -> float:
    return len(p) / float(np.maximum(extent(p), 1e-4).prod()) if len(p) >= 10 else 0.0


def bad_shape(p: np.ndarray) -> bool:
    s = np.maximum(scales(p), 1e-6)
    return len(p) < 20 or bool(s[0] / s[1] > 8 and s[1] / s[2] > 6)


def can_split(p: np.ndarray, least: int, size: float) -> bool:
    return bool(rules.can_split(Numbers, len(p), float(extent(p).max()), *(float(x) for x in scales(p)), least, size))


def largest_ratio(mask: np.ndarray, depth: np.ndarray | None = None, step: float = 0.01) -> float:
    """The share of the mask's pixels in its largest part; with a depth, neighbours link only across small steps of a valid depth."""
    if depth is None:
        labels, n = labelled(mask)
        sizes = np.bincount(labels[labels > 0], minlength=n + 1)
        return float(sizes.max() / sizes.sum()) if sizes.sum() else 0.0
    v, u = np.nonzero(mask & (depth > 1e-6))
    if not len(v):
        return 0.0
    ids = np.full(mask.shape, -1)
    ids[v, u] = np.arange(len(v))
    label, pad = np.arange(len(v)), np.pad(ids, 1, constant_values=-1)
    edges = []
    for du, dv in ((1, 0), (0, 1), (1, 1), (-1, 1)):
        other = pad[v + 1 + dv, u + 1 + du]
        a = np.flatnonzero(other >= 0)
        b = other[a]
        ok = np.abs(depth[v[a], u[a]] - depth[v[b], u[b]]) <= step
        edges.append(np.stack([a[ok], b[ok]]))
    e = np.hstack(edges)
    while True:
        before = label.copy()
        np.minimum.at(label, e[0], label[e[1]])
        np.minimum.at(label, e[1], label[e[0]])
        label = label[label]
        if np.array_equal(before, label):
            return float(np.bincount(label).max() / len(label))


def quality(p: np.ndarray, mask: np.ndarray, cfg: SplitConfig, depth: np.ndarray | None) -> float:
    """How much a cluster looks like one object; large negative values name what it fails."""
    d, connected = density(p), largest_ratio(mask)
    deep = largest_ratio(mask, depth, cfg.depth_jump) if depth is not None else None
    return rules.quality(Numbers, len(p), bad_shape(p), d, connected, deep, cfg.min_density, cfg.min_connectivity, cfg.min_depth_connectivity)


def gradient(depth: np.ndarray) -> np.ndarray:
    d = np.pad(depth, 1)
    h, w = depth.shape
    at = lambda du, dv: d[1 + dv : 1 + dv + h, 1 + du : 1 + du + w]
    gx = sum(s * (at(1, dv) - at(-1, dv)) for dv, s in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(s * (at(du, 1) - at(du, -1)) for du, s in ((-1, 1), (0, 2), (1, 1)))
    return np.nan_to_num(np.hypot(gx, gy), posinf=0, neginf=0)


def boundary_score(grad: np.ndarray | None, full: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> float:
    if grad is None:
        return 0.0
    r = (size | 1) // 2
    around = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    line = shift_any(a, around) & shift_any(b, around) & full
    if line.sum() < 20:
        return 0.0
    g = grad[line]
    return float((0.5 * g.mean() + 0.5 * np.quantile(g, 0.9)) / (grad[full].mean() + 1e-6))


def least_gap(a: np.ndarray, b: np.ndarray, most: int = 300, seed: int = 0) -> float:
    """The least distance between seeded samples of two clusters."""
    if not (len(a) and len(b)):
        return 1e9
    rng = np.random.default_rng(seed)
    a, b = (x[rng.choice(len(x), min(most, len(x)), replace=False), :3] for x in (a, b))
    return float(np.linalg.norm(a[:, None] - b[None], axis=2).min())


#: What a split is refused for, in the order of the gates.
GATES = ("less_than_two_clusters", "too_few_total_points", "cluster_too_small", "second_cluster_ratio_too_small", "center_dist_too_small", "gap_dist_too_small", "mask1_area_too_small", "mask2_area_too_small")


def gates(cfg: SplitConfig, clusters, total, n1, n2, center, gap, area1, area2) -> list:
    """Whether each of GATES refuses a split, for numbers or columns: the second cluster is held against the whole object's points."""
    return [
        clusters < 2, total < cfg.min_points, (n1 < cfg.min_points_each) | (n2 < cfg.min_points_each), n2 < total * cfg.min_second_ratio,
        center < cfg.min_center_distance, gap < cfg.min_gap, area1 < cfg.min_mask_area, area2 < cfg.min_mask_area,
    ]


def evaluate(full: np.ndarray, parts: list[np.ndarray], camera: Camera, cfg: SplitConfig, depth: np.ndarray | None, grad: np.ndarray | None) -> tuple[bool, float, str]:
    """Whether a split in two is better than the whole, its gain, and the gate that it failed."""
    a, b = (list(parts) + [full[:0]] * 2)[:2]
    both = len(a) and len(b)
    center = float(np.linalg.norm(np.median(a[:, :3], axis=0) - np.median(b[:, :3], axis=0))) if both else 0.0
    ma, mb, whole = camera.mask(a), camera.mask(b), camera.mask(full)
    refused = gates(cfg, len(parts), len(full), len(a), len(b), center, least_gap(a, b), ma.sum(), mb.sum())
    if any(refused):
        return False, -1e9, GATES[[bool(x) for x in refused].index(True)]
    gain = quality(a, ma, cfg, depth) + quality(b, mb, cfg, depth) - quality(full, whole, cfg, depth)
    if depth is not None:
        score = boundary_score(grad, whole, ma, mb, cfg.boundary_kernel)
        gain += 2.5 * score if score >= cfg.min_boundary_score else -1.25
        ra, rb, rw = (largest_ratio(m, depth, cfg.depth_jump) for m in (ma, mb, whole))
        gain += 1.5 * (ra + rb - rw)
    return gain > cfg.min_gain, gain, "" if gain > cfg.min_gain else "gain_too_small"


def by_neck(p: np.ndarray, cfg: SplitConfig) -> list[np.ndarray]:
    """The two largest parts that remain when sparse points, such as those of a neck, are left out."""
    d = 1 / (knn(p, cfg.knn_k)[1] + 1e-6)
    dense = p[d >= np.quantile(d, cfg.low_density_percentile / 100) * cfg.density_factor]
    if len(dense) < max(2 * cfg.min_points_each, 100):
        return []
    return [denoise(dense[i], cfg.voxel, cfg.neighbours, cfg.std_ratio) for i in clusters(dense, cfg.radius, cfg.min_points_each)[:2]]


def by_mask(p: np.ndarray, mask: np.ndarray, camera: Camera, cfg: SplitConfig, depth: np.ndarray | None) -> list[np.ndarray]:
    """The parts of an object whose mask has two broad places, each point by the nearer one."""
    if depth is None or not mask.any():
        return []
    d = np.where(mask, distance(mask), 0)
    labels, n = labelled(d >= cfg.peak_ratio * d.max())
    peaks = [(int((labels == k).sum()), k) for k in range(1, n + 1)]
    peaks = sorted((x for x in peaks if x[0] >= cfg.min_peak_area), key=lambda x: (-x[0], x[1]))[:2]
    if len(peaks) < 2:
        return []
    middle = [np.array([c.mean() for c in np.nonzero(labels == k)[::-1]]) for _, k in peaks]
    v, u = np.mgrid[0 : mask.shape[0], 0 : mask.shape[1]]
    da, db = ((u - m[0]) ** 2 + (v - m[1]) ** 2 for m in middle)
    ma, mb = closed(mask & (da <= db), _SQUARE3), closed(mask & (da > db), _SQUARE3)
    if min(ma.sum(), mb.sum()) < cfg.min_mask_area:
        return []
    pu, pv, ok = camera.pixels(p)
    pu, pv = pu.clip(0, camera.w - 1), pv.clip(0, camera.h - 1)
    ina, inb = ma[pv, pu] & ok, mb[pv, pu] & ok
    mids = [np.array([c.mean() for c in np.nonzero(m)[::-1]]) for m in (ma, mb)]
    nearer = (pu - mids[0][0]) ** 2 + (pv - mids[0][1]) ** 2 <= (pu - mids[1][0]) ** 2 + (pv - mids[1][1]) ** 2
    sides = [p[ina & (~inb | nearer)], p[inb & (~ina | ~nearer)]]
    return [denoise(s, cfg.voxel, cfg.neighbours, cfg.std_ratio) for s in sides if len(s)]


def split(p: np.ndarray, mask: np.ndarray, camera: Camera, cfg: SplitConfig, depth: np.ndarray | None, grad: np.ndarray | None, level: int = 0) -> list[np.ndarray]:
    """The object as one or more clusters, split again up to cfg.max_depth times. The choice between ways to split doesn't look at the gradient."""
    least, size = (cfg.min_points, cfg.min_extent) if not level else (cfg.recursive_min_points, cfg.recursive_min_extent)
    if level >= cfg.max_depth or not can_split(p, least, size):
        return [p]
    ways = [parts for parts in (by_neck(p, cfg), by_mask(p, mask, camera, cfg, depth)) if parts]
    scored = [(evaluate(p, parts, camera, cfg, depth, None), parts) for parts in ways]
    accepted = [(e[1], i) for i, (e, _) in enumerate(scored) if e[0]]
    if not accepted:
        return [p]
    parts = scored[max(accepted, key=lambda x: (x[0], -x[1]))[1]][1]
    if not evaluate(p, parts, camera, cfg, depth, grad)[0]:
        return [p]
    return [q for part in parts[:2] for q in split(part, camera.mask(part), camera, cfg, depth, grad, level + 1)]


def refine(p: np.ndarray, mask: np.ndarray, camera: Camera, cfg: SplitConfig, depth: np.ndarray | None, edges: bool = True) -> list[tuple[np.ndarray, str]]:
    """Clusters of one object with how each came about: split, refined_single, fallback_no_secondary_split or final_fallback. edges: whether the depth's gradient has a say in a split."""
    whole = denoise(p, cfg.voxel, cfg.neighbours, cfg.std_ratio)
    if not cfg.enable or not can_split(whole, cfg.min_points, cfg.min_extent):
        return [(whole, "fallback_no_secondary_split")]
    parts = split(whole, mask, camera, cfg, depth, gradient(depth) if depth is not None and edges else None)
    kept = []
    for q in parts:
        m = camera.mask(q)
        good = m.sum() >= cfg.min_mask_area and largest_ratio(m) >= cfg.min_connectivity and not bad_shape(q) and density(q) >= cfg.min_density
        if good and (depth is None or largest_ratio(m, depth, cfg.depth_jump) >= cfg.min_depth_connectivity):
            kept.append((q, "split" if len(parts) > 1 else "refined_single"))
    return kept or [(whole, "final_fallback")]
