"""The watershed's spanning forest against flooding one pixel after the other."""

import heapq

import numpy as np
import pytest

from cairn.operators import watershed

RING = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def flooded(colour, markers, mask):
    """Always over the first edge, by step and pixel numbers, from flooded to dry."""
    (h, w), out, heap = mask.shape, np.where(mask, markers, 0), []

    def spread(u, v):
        for du, dv in RING:
            a, b = u + du, v + dv
            if 0 <= a < w and 0 <= b < h and mask[b, a] and not out[b, a]:
                ends = sorted((v * w + u, b * w + a))
                heapq.heappush(heap, (int(np.abs(colour[b, a] - colour[v, u]).max()), *ends, a, b, int(out[v, u])))

    for v, u in zip(*np.nonzero(out), strict=True):
        spread(int(u), int(v))
    while heap:
        *_, u, v, label = heapq.heappop(heap)
        if not out[v, u]:
            out[v, u] = label
            spread(u, v)
    return out


@pytest.mark.parametrize("levels", [2, 5, 200])
def test_forest_equals_flooding(spark, levels):
    pick = np.random.default_rng(levels)
    h, w, rows, seeds, want = 11, 13, [], [], {}
    for f in range(2):
        mask, colour = pick.random((h, w)) < 0.8, pick.integers(0, levels, (h, w, 3))
        markers = np.zeros((h, w), int)
        for k in range(3):
            v, u = (int(x) for x in pick.choice(np.argwhere(mask)))
            markers[v, u] = 3 * f + k + 1
        out = flooded(colour, markers, mask)
        for v, u in zip(*np.nonzero(mask), strict=True):
            number = f * h * w + int(v) * w + int(u)
            rows.append((f, number, int(u), int(v), *map(int, colour[v, u])))
            if markers[v, u]:
                seeds.append((number, int(markers[v, u])))
            if out[v, u]:
                want[number] = int(out[v, u])
    pixels = spark.createDataFrame(rows, "f int, id long, u int, v int, r int, g int, b int")
    got = watershed.flood(watershed._pixel_edges(pixels, "f"), spark.createDataFrame(seeds, "id long, label long"))
    assert {r.id: r.label for r in got.collect()} == want


def test_discs_and_reasons(spark):
    v, u = np.mgrid[0:60, 0:110]
    two = ((u - 28) ** 2 + (v - 30) ** 2 <= 24**2) | ((u - 80) ** 2 + (v - 30) ** 2 <= 24**2) | ((abs(v - 30) < 3) & (u > 28) & (u < 80))
    images = {"two": two, "one": two & (u < 50), "few": two & (u < 10), "off": np.roll(two, 5, axis=1)}
    rows = [(k, int(a), int(b), 0, 0, 0) for k, image in images.items() for b, a in zip(*np.nonzero(image), strict=True)]
    got = watershed.watershed_split(spark.createDataFrame(rows, "k string, u int, v int, r int, g int, b int"), ["k"], 60, 120).collect()
    parts = {(r.k, r.part): 0 for r in got}
    for r in got:
        parts[r.k, r.part] += 1
    assert {(r.k, r.reason) for r in got} == {("two", "watershed_split"), ("off", "watershed_split"), ("one", "peak_components<2"), ("few", "mask_too_small")}
    assert set(parts) == {("two", 1), ("two", 2), ("off", 1), ("off", 2), ("one", 1), ("few", 1)}
    assert parts["two", 1] + parts["two", 2] == two.sum() and min(parts["two", 1], parts["two", 2]) > 1500


def test_no_pixels(spark):
    assert watershed.watershed_split(spark.createDataFrame([], "k string, u int, v int, r int, g int, b int"), ["k"], 8, 8).isEmpty()
