"""Rectilinear shapes with whole-number corners, and what is true about them by counting unit cells."""

import random

# name -> (polygons as (exterior, holes), unit cells)
_SQUARE = ([([(0, 0), (3, 0), (3, 3), (0, 3)], [])], {(x, y) for x in range(3) for y in range(3)})
_ELL = (
    [([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)], [])],
    {(x, y) for x in range(3) for y in range(3) if x == 0 or y == 0},
)
_RING = (
    [([(0, 0), (3, 0), (3, 3), (0, 3)], [[(1, 1), (2, 1), (2, 2), (1, 2)]])],
    {(x, y) for x in range(3) for y in range(3)} - {(1, 1)},
)
_UNIT = ([([(0, 0), (1, 0), (1, 1), (0, 1)], [])], {(0, 0)})
_BAR = ([([(0, 0), (5, 0), (5, 1), (0, 1)], [])], {(x, 0) for x in range(5)})
_YOU = (
    [([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)], [])],
    {(x, y) for x in range(3) for y in range(3) if not (x == 1 and y > 0)},
)
_PAIR = (
    [([(0, 0), (1, 0), (1, 1), (0, 1)], []), ([(2, 2), (4, 2), (4, 4), (2, 4)], [])],
    {(0, 0)} | {(x, y) for x in (2, 3) for y in (2, 3)},
)
_ISLAND = (
    [
        ([(0, 0), (5, 0), (5, 5), (0, 5)], [[(1, 1), (4, 1), (4, 4), (1, 4)]]),
        ([(2, 2), (3, 2), (3, 3), (2, 3)], []),
    ],
    ({(x, y) for x in range(5) for y in range(5)} - {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)}) | {(2, 2)},
)
TEMPLATES = [_SQUARE, _ELL, _RING, _UNIT, _BAR, _YOU, _PAIR, _ISLAND]


def placed(template, dx, dy):
    polygons, cells = template
    move = lambda ring: [(x + dx, y + dy) for x, y in ring]
    return [(move(e), [move(h) for h in holes]) for e, holes in polygons], {(x + dx, y + dy) for x, y in cells}


def random_shapes(n, extent, seed):
    rng = random.Random(seed)
    return {
        f"s{i:03d}": placed(rng.choice(TEMPLATES), rng.randrange(extent), rng.randrange(extent)) for i in range(n)
    }


def geometry(polygons):
    """Unclosed rings in arbitrary direction, as the loader may get them."""
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in (e, *holes)] for e, holes in polygons]


def touch(a, b):
    """Closed cells meet and no cell is shared."""
    if a & b:
        return False
    return any(abs(x - u) <= 1 and abs(y - v) <= 1 for x, y in a for u, v in b)


def contains(cells, x, y):
    return any(cx <= x <= cx + 1 and cy <= y <= cy + 1 for cx, cy in cells)


SCHEMA = "geoid string, raw array<array<array<struct<x:double,y:double>>>>"
