"""Polygons on grids against point-in-polygon, segment-in-cell and area by brute force."""

import numpy as np
import pytest

from gridloom.operators import polygons

GRID = (-3.0, -2.0, 0.5)
ROWS, COLS = 24, 26


def star(rng, x, y, r, n):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    d = r * rng.uniform(0.4, 1, n)
    return [(float(x + k * np.cos(t)), float(y + k * np.sin(t))) for t, k in zip(a, d)]


def made(seed):
    """Random star polygons, one with a hole, one with two parts, one on the grid's own lines."""
    rng = np.random.default_rng(seed)
    out = {1: [star(rng, 2, 2, 4, 9)], 2: [star(rng, 3, 3, 4, 30), star(rng, 3, 3, 1.2, 6)], 3: [star(rng, 0, 0, 1.4, 5), star(rng, 6, 6, 2, 7)]}
    out[4] = [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.5), (0.0, 1.5)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0)]]
    out[5] = [[(1.01, 1.01), (1.02, 1.01), (1.02, 1.02)]]  # within one cell, around no centre
    return out


def frame(spark, polys):
    return spark.createDataFrame([(p, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for p, rings in polys.items()], "id int, rings array<array<struct<x: double, y: double>>>")


def segments(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]


def inside(rings, x, y):
    odd = False
    for (x1, y1), (x2, y2) in segments(rings):
        if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
            odd = not odd
    return odd


def runs_through(a, b, x, y, size):
    """Whether the segment has a point in the closed cell, by cutting it at the cell's sides."""
    (x1, y1), (x2, y2) = a, b
    t0, t1 = 0.0, 1.0
    for p, d, lo in ((x1, x2 - x1, x), (y1, y2 - y1, y)):
        if d == 0:
            if not lo <= p <= lo + size:
                return False
        else:
            u, v = sorted(((lo - p) / d, (lo + size - p) / d))
            t0, t1 = max(t0, u), min(t1, v)
    return t0 <= t1


@pytest.mark.parametrize("seed", range(3))
def test_cells_against_brute_force(spark, seed):
    polys = made(seed)
    edge = polygons.edges(frame(spark, polys), ["id"], "rings")
    west, south, size = GRID
    centre = lambda r, c: (west + (c + 0.5) * size, south + (r + 0.5) * size)
    got = {(r["id"], r["row"], r["col"]) for r in polygons.cells_inside(edge, ["id"], GRID).collect()}
    assert got == {(p, r, c) for p, rings in polys.items() for r in range(-8, ROWS) for c in range(-8, COLS) if inside(rings, *centre(r, c))}
    touched = {(r["id"], r["row"], r["col"]) for r in polygons.cells_touched(edge, ["id"], GRID).collect()}
    for p, rings in polys.items():
        for r in range(-8, ROWS):
            for c in range(-8, COLS):
                x, y = west + c * size, south + r * size
                by_edge = any(runs_through(a, b, x, y, size) for a, b in segments(rings))
                if inside(rings, *centre(r, c)) or any(runs_through(a, b, x + 1e-9, y + 1e-9, size - 2e-9) for a, b in segments(rings)):
                    assert (p, r, c) in touched
                elif not by_edge:
                    assert (p, r, c) not in touched  # cells that only share a side or corner may count
    assert {x for x in touched if x[0] == 5} == {(5, 6, 8)} and not any(x[0] == 5 for x in got)


def test_masks(spark):
    polys = {4: made(0)[4]}
    edge = polygons.edges(frame(spark, polys), ["id"], "rings")
    cells = spark.createDataFrame([(0.25, 0.25), (0.75, 0.75), (1.75, 1.25), (2.75, 0.25), (None, 1.0)], "x double, y double")
    assert sorted(tuple(r) for r in polygons.mask_cells(cells, edge, ["id"], GRID, "x", "y", False).collect()) == [(0.25, 0.25), (1.75, 1.25)]  # the hole is out
    assert (0.75, 0.75) in {tuple(r) for r in polygons.mask_cells(cells, edge, ["id"], GRID, "x", "y").collect()}  # but its cell is touched by its edge
    assert polygons.cells_touched(edge.limit(0), ["id"], GRID).count() == 0


@pytest.mark.parametrize("source,target", [((0.0, 0.0, 1.0), (0.0, 0.0, 3.0)), ((-1.0, 0.5, 1.0), (-1.3, 0.2, 2.5)), ((0.0, 0.0, 2.0), (0.0, 0.0, 0.7))])
def test_majority_against_brute_force(spark, source, target):
    rng = np.random.default_rng(4)
    cells = [(r, c, int(rng.integers(3)) if rng.random() > 0.1 else None) for r in range(9) for c in range(8)]
    df = spark.createDataFrame(cells, "r int, c int, code int")
    areas = {}
    for r, c, code in cells:
        if code is None:
            continue
        x0, y0 = source[0] + c * source[2], source[1] + r * source[2]
        for i in range(-3, 40):
            for j in range(-3, 40):
                u, v = target[0] + j * target[2], target[1] + i * target[2]
                dx, dy = min(x0 + source[2], u + target[2]) - max(x0, u), min(y0 + source[2], v + target[2]) - max(y0, v)
                if dx > 1e-9 and dy > 1e-9:
                    areas.setdefault((i, j), {}).setdefault(code, 0.0)
                    areas[i, j][code] += dx * dy
    got = {(r["row"], r["col"]): r for r in polygons.majority_by_area(df, "code", "r", "c", source, target).collect()}
    assert set(got) == set(areas)
    for k, a in areas.items():
        best = min(a, key=lambda code: (-round(a[code], 6), code))
        assert got[k]["code"] == best and got[k]["share"] == pytest.approx(a[best] / sum(a.values()))
