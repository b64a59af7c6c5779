"""Planar geometry as built-in column expressions.

A geometry is ``array<polygon>``, a polygon is ``array<ring>`` (ring 0 is the exterior, the
rest are holes) and a ring is a closed ``array<struct<x,y>>``. The longer expressions are SQL
templates: they parse in one call and stay readable, and everything runs inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY_DDL = "array<array<array<struct<x:double,y:double>>>>"


def point(x: Column, y: Column) -> Column:
    """A point, or null when a coordinate is unknown."""
    return F.when(
        x.isNotNull() & y.isNotNull(),
        F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")),
    )


def _vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*vertices: tuple[Column, Column]) -> Column:
    """Closed ring through the given corners."""
    corners = [_vertex(x, y) for x, y in vertices]
    return F.array(*corners, corners[0])


def rectangle_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise rectangle."""
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def polygon(exterior: Column, *holes: Column) -> Column:
    """Geometry of one polygon."""
    return F.array(F.array(exterior, *holes))


# --- rings and edges -------------------------------------------------------------------------

_STEPS = "zip_with(slice({r}, 1, size({r}) - 1), slice({r}, 2, size({r}) - 1), (p, q) -> {body})"


def _signed_area(r: str) -> str:
    """Shoelace sum relative to the first vertex, which keeps the products small."""
    body = f"((p.x - {r}[0].x) * (q.y - {r}[0].y) - (q.x - {r}[0].x) * (p.y - {r}[0].y)) / 2D"
    return f"aggregate({_STEPS.format(r=r, body=body)}, 0D, (s, v) -> s + v)"


def normalise(geometry: str) -> Column:
    """Close rings, drop repeated vertices and rings without area, turn exteriors
    counter-clockwise and holes clockwise."""
    closed = "if(r[0] = r[size(r) - 1], r, concat(r, array(r[0])))"
    distinct = f"filter({closed}, (v, i) -> i = 0 OR v != ({closed})[i - 1])"
    cleaned = f"""
        transform({geometry}, poly ->
          filter(transform(filter(poly, r -> size(r) > 2), r -> {distinct}), r -> size(r) > 3))"""
    turned = f"""
        transform({cleaned}, poly -> transform(poly, (r, i) ->
          if(({_signed_area("r")} > 0D) = (i = 0), r, reverse(r))))"""
    return F.expr(f"filter({turned}, poly -> size(poly) > 0)")


def edges(geometry: str) -> Column:
    """All directed edges as ``array<struct<ring,pos,x0,y0,x1,y1>>``; rings count over all polygons."""
    edge = "named_struct('x0', p.x, 'y0', p.y, 'x1', q.x, 'y1', q.y)"
    return F.expr(f"""
        flatten(transform(flatten({geometry}), (r, i) -> transform(
          {_STEPS.format(r="r", body=edge)},
          (e, j) -> named_struct('ring', i, 'pos', j, 'x0', e.x0, 'y0', e.y0, 'x1', e.x1, 'y1', e.y1))))""")


def ring_starts(geometry: str) -> Column:
    """One vertex of every ring: ``array<struct<ring,x,y>>``."""
    return F.expr(f"transform(flatten({geometry}), (r, i) -> named_struct('ring', i, 'x', r[0].x, 'y', r[0].y))")


_AREA = f"""
    aggregate({{g}}, 0D, (total, poly) -> total + aggregate(
      transform(poly, (r, i) -> if(i = 0, 1D, -1D) * abs({_signed_area("r")})),
      0D, (s, v) -> s + v))"""


def planar_area(geometry: str) -> Column:
    """Exteriors minus holes, in the square of the coordinate unit."""
    return F.expr(_AREA.format(g=geometry))


def digest(geometry: str) -> Column:
    """What two shapes can be compared by without their vertices: ``struct<n_rings,n_edges,area,min_x,min_y,max_x,max_y,
    vertices>``, the last being the sum of the hashes of all vertices, whatever their order. Null without a shape."""
    points = f"flatten(transform(flatten({geometry}), r -> slice(r, 1, size(r) - 1)))"
    box = ", ".join(f"'{f}_{c}', array_{f}(transform({points}, p -> p.{c}))" for f in ("min", "max") for c in "xy")
    vertex = "CAST(conv(substring(md5(concat(string(p.x), ' ', string(p.y))), 1, 12), 16, 10) AS BIGINT)"
    return F.expr(f"""
        CASE WHEN {geometry} IS NOT NULL THEN named_struct('n_rings', size(flatten({geometry})), 'n_edges', size({points}),
          'area', {_AREA.format(g=geometry)}, {box},
          'vertices', aggregate(transform({points}, p -> {vertex}), 0L, (s, v) -> s + v)) END""")


# --- orientation -----------------------------------------------------------------------------

# The splitter of Dekker's product (2^27 + 1) and the error bound under which the
# sign of a 2x2 determinant in doubles is not certain (Shewchuk 1997).
_SPLITTER = "134217729D"
_UNCERTAIN = "3.3306690738754716E-16D"


def bind(values: dict[str, str], name: str, body: str) -> str:
    """Evaluate ``body`` with the named values in scope, so that each is computed once."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), {name} -> {body})[0]"


def _diff_tail(a: str, b: str, d: str) -> str:
    """Rounding error of ``d = a - b``."""
    return f"(({a} - ({d} + ({a} - {d}))) + (({a} - {d}) - {b}))"


def _high(v: str) -> str:
    return f"({_SPLITTER} * {v} - ({_SPLITTER} * {v} - {v}))"


def _product_tail(p: str, a: str, ah: str, b: str, bh: str) -> str:
    """Rounding error of ``p = a * b``, with the high halves of both factors."""
    al, bl = f"({a} - {ah})", f"({b} - {bh})"
    return f"({al} * {bl} - ((({p} - {ah} * {bh}) - {al} * {bh}) - {ah} * {bl}))"


def _precise_determinant(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """(ax - cx)(by - cy) - (ay - cy)(bx - cx) with the error of every step carried along."""
    tails = {
        "l": f"({_product_tail('h.l', 'd.u', 'h.u', 'd.v', 'h.v')}"
             f" + (d.u * {_diff_tail(by, cy, 'd.v')} + {_diff_tail(ax, cx, 'd.u')} * d.v))",
        "r": f"({_product_tail('h.r', 'd.w', 'h.w', 'd.z', 'h.z')}"
             f" + (d.w * {_diff_tail(bx, cx, 'd.z')} + {_diff_tail(ay, cy, 'd.w')} * d.z))",
        "s": "(h.l - h.r)",
    }
    total = bind(tails, "t", f"t.s + ({_diff_tail('h.l', 'h.r', 't.s')} + (t.l - t.r))")
    halves = {k: _high(f"d.{k}") for k in "uvwz"} | {"l": "d.u * d.v", "r": "d.w * d.z"}
    differences = {"u": f"({ax} - {cx})", "v": f"({by} - {cy})", "w": f"({ay} - {cy})", "z": f"({bx} - {cx})"}
    return bind(differences, "d", bind(halves, "h", total))


def orientation(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """Sign of the turn a, b, c: 1 left, -1 right, 0 on the line.

    Plain doubles decide clear cases, and a difference of 0 is always exact, which settles shared
    vertices and axis-parallel edges. Else, near the line, the determinant is redone with the
    rounding errors of every step carried along, so that vertices stored on a slanted border are
    found there.
    """
    left, right = f"({ax} - {cx}) * ({by} - {cy})", f"({ay} - {cy}) * ({bx} - {cx})"
    return (
        f"(CASE WHEN abs({left} - {right}) > {_UNCERTAIN} * (abs({left}) + abs({right}))"
        f" THEN sign({left} - {right})"
        f" WHEN ({ax} = {cx} OR {by} = {cy}) AND ({ay} = {cy} OR {bx} = {cx}) THEN 0D"
        f" ELSE sign({_precise_determinant(ax, ay, bx, by, cx, cy)}) END)"
    )


# --- point in polygon ------------------------------------------------------------------------

OUTSIDE, INSIDE, ON_BORDER = 0, 1, 2


def locate(x: str, y: str, edge_array: str) -> str:
    """0 outside, 1 inside, 2 on the border: even-odd count of the edges straight above the point.

    ``edge_array`` only has to hold the edges whose x-range contains ``x``.
    """
    side = bind({"side": orientation("e.x0", "e.y0", "e.x1", "e.y1", x, y)}, "o", "{}")
    straddles = f"((e.x0 > {x}) != (e.x1 > {x}))"
    code = f"""
        CASE WHEN {y} > greatest(e.y0, e.y1) OR {x} < least(e.x0, e.x1) OR {x} > greatest(e.x0, e.x1) THEN 0
             WHEN {y} < least(e.y0, e.y1) THEN if({straddles}, 1, 0)
             ELSE {side.format(f"if(o.side = 0D, 2, if(o.side * sign(e.x1 - e.x0) < 0D AND {straddles}, 1, 0))")}
        END"""
    return f"""
        aggregate(transform({edge_array}, e -> {code}), 0,
          (s, c) -> CASE WHEN s = 2 OR c = 2 THEN 2 ELSE s ^ c END)"""


def shifted_side(edge: str, x: str, y: str) -> str:
    """Side of a point that is moved right and up by next to nothing, up by far less than right: 1 left of the edge or
    -1 right of it, never 0."""
    turn = orientation(f"{edge}.x0", f"{edge}.y0", f"{edge}.x1", f"{edge}.y1", "q.x", "q.y")
    moved = f"CASE WHEN {edge}.y0 != {edge}.y1 THEN sign({edge}.y0 - {edge}.y1) ELSE sign({edge}.x1 - {edge}.x0) END"
    return bind({"x": x, "y": y}, "q", bind({"side": turn}, "o", f"if(o.side != 0D, o.side, {moved})"))


def locate_in_cell(x: str, y: str, edge_array: str, inside: str, left: str, low: str) -> str:
    """0 outside, 1 inside, 2 on the border, from the edges that run through the point's cell.

    ``inside`` (0 or 1) says where the cell's lower left corner ``left, low`` lies, moved as in :func:`shifted_side`. The
    path from there leads along the lower side of the cell to below the point, then up; each edge across it changes sides.
    """
    turn = orientation("e.x0", "e.y0", "e.x1", "e.y1", "q.x", "q.y")
    moved = "CASE WHEN e.y0 != e.y1 THEN sign(e.y0 - e.y1) ELSE sign(e.x1 - e.x0) END"
    ends = f"array(named_struct('x', {x}, 'y', {y}), named_struct('x', {x}, 'y', c.low), named_struct('x', c.left, 'y', c.low))"
    turns = f"transform({ends}, q -> {turn})"
    in_box = f"{x} BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND {y} BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1)"
    up, along = f"(e.x0 > {x}) != (e.x1 > {x})", "(e.y0 > c.low) != (e.y1 > c.low)"
    sides = f"transform(t.v, v -> if(v != 0D, v, {moved}))"
    crossed = bind({"v": sides}, "s", f"cast({up} AND s.v[0] != s.v[1] AS int) ^ cast({along} AND s.v[1] != s.v[2] AS int)")
    code = f"""
        CASE WHEN NOT ({in_box} OR {up} OR {along}) THEN 0
             ELSE {bind({"v": turns}, "t", f"if({in_box} AND t.v[0] = 0D, 2, {crossed})")} END"""
    return bind({"left": left, "low": low}, "c", f"""
        aggregate(transform({edge_array}, e -> {code}), {inside},
          (s, v) -> CASE WHEN s = 2 OR v = 2 THEN 2 ELSE s ^ v END)""")


# --- contact of two edges --------------------------------------------------------------------

TOUCH_POINT, SHARED_OPPOSED, SHARED_ALIGNED, CROSSING = 0, 1, 2, 3


def _position(edge: str, x: str, y: str) -> str:
    """Parameter of a point of an edge's line along the longer axis of the edge."""
    dx, dy = f"({edge}.x1 - {edge}.x0)", f"({edge}.y1 - {edge}.y0)"
    return f"(CASE WHEN abs{dx} >= abs{dy} THEN ({x} - {edge}.x0) / {dx} ELSE ({y} - {edge}.y0) / {dy} END)"


def turn_signs(a: str, b: str) -> dict[str, Column]:
    """Side of each end of one edge relative to the other: columns ``a0 a1 b0 b1``."""
    return {
        "a0": F.expr(orientation(f"{b}.x0", f"{b}.y0", f"{b}.x1", f"{b}.y1", f"{a}.x0", f"{a}.y0")),
        "a1": F.expr(orientation(f"{b}.x0", f"{b}.y0", f"{b}.x1", f"{b}.y1", f"{a}.x1", f"{a}.y1")),
        "b0": F.expr(orientation(f"{a}.x0", f"{a}.y0", f"{a}.x1", f"{a}.y1", f"{b}.x0", f"{b}.y0")),
        "b1": F.expr(orientation(f"{a}.x0", f"{a}.y0", f"{a}.x1", f"{a}.y1", f"{b}.x1", f"{b}.y1")),
    }


def contact(a: str, b: str, a0: str, a1: str, b0: str, b1: str) -> str:
    """How edge ``a`` meets edge ``b``: ``struct<lo,hi,kind>`` along ``a``, or null.

    The four signs are the columns of :func:`turn_signs`. A shared stretch has two positions;
    every other contact has one.
    """
    start, end = _position(a, f"{b}.x0", f"{b}.y0"), _position(a, f"{b}.x1", f"{b}.y1")
    lo, hi = f"greatest(0D, least({start}, {end}))", f"least(1D, greatest({start}, {end}))"
    shared = f"""
        CASE WHEN {lo} < {hi} THEN named_struct('lo', {lo}, 'hi', {hi},
                  'kind', if({end} > {start}, {SHARED_ALIGNED}, {SHARED_OPPOSED}))
             WHEN {lo} = {hi} THEN named_struct('lo', {lo}, 'hi', {hi}, 'kind', {TOUCH_POINT}) END"""

    def at(position: str) -> str:
        return f"named_struct('lo', {position}, 'hi', {position}, 'kind', {TOUCH_POINT})"

    return f"""
        CASE WHEN {a0} = 0D AND {a1} = 0D THEN {shared}
             WHEN {a0} * {a1} > 0D OR {b0} * {b1} > 0D THEN NULL
             WHEN {a0} = 0D THEN {at("0D")}
             WHEN {a1} = 0D THEN {at("1D")}
             WHEN {b0} = 0D THEN {at(start)}
             WHEN {b1} = 0D THEN {at(end)}
             ELSE named_struct('lo', 0D, 'hi', 0D, 'kind', {CROSSING}) END"""


# --- transverse Mercator ---------------------------------------------------------------------

# GRS80 ellipsoid, UTM scale and false easting, central meridian of zone 14.
SEMI_MAJOR_AXIS = 6378137.0
INVERSE_FLATTENING = 298.257222101
SCALE_ON_MERIDIAN = 0.9996
FALSE_EASTING = 500000.0
ZONE_14_MERIDIAN = -99.0

# Krueger series in the third flattening n, by multiple angle; each list holds the
# coefficients of n^1 .. n^6 (Karney 2011, eq. 35).
KRUEGER = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
    [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
    [0, 0, 0, 0, 0, 212378941 / 319334400],
]


def utm_parameters() -> dict[str, float | list[float]]:
    flattening = 1.0 / INVERSE_FLATTENING
    n = flattening / (2.0 - flattening)
    return {
        "eccentricity": math.sqrt(flattening * (2.0 - flattening)),
        "radius": SCALE_ON_MERIDIAN * SEMI_MAJOR_AXIS / (1.0 + n) * (1.0 + n**2 / 4 + n**4 / 64 + n**6 / 256),
        "alpha": [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in KRUEGER],
    }


def project_points(points: str, meridian: float = ZONE_14_MERIDIAN) -> str:
    """Project ``array<struct<x,y>>`` from lon/lat degrees to metres, one short step at a time."""
    p = utm_parameters()
    e = f"{p['eccentricity']!r}D"
    tangent = f"transform({points}, v -> named_struct('l', radians(v.x - ({meridian!r}D)), 't', tan(radians(v.y))))"
    shrink = f"sinh({e} * atanh({e} * v.t / sqrt(1D + v.t * v.t)))"
    shrunk = f"transform({tangent}, v -> named_struct('l', v.l, 't', v.t, 's', {shrink}))"
    conformal = f"transform({shrunk}, v -> named_struct('l', v.l, 't', v.t * sqrt(1D + v.s * v.s) - v.s * sqrt(1D + v.t * v.t)))"
    sphere = f"""
        transform({conformal}, v -> named_struct('n', atan2(v.t, cos(v.l)),
          'e', asinh(sin(v.l) / sqrt(v.t * v.t + cos(v.l) * cos(v.l)))))"""
    east = " + ".join(f"{a!r}D * cos({2 * j}D * v.n) * sinh({2 * j}D * v.e)" for j, a in enumerate(p["alpha"], 1))
    north = " + ".join(f"{a!r}D * sin({2 * j}D * v.n) * cosh({2 * j}D * v.e)" for j, a in enumerate(p["alpha"], 1))
    radius = f"{p['radius']!r}D"
    return f"""
        transform({sphere}, v -> named_struct('x', {FALSE_EASTING!r}D + {radius} * (v.e + {east}),
          'y', {radius} * (v.n + {north})))"""


def project_geometry(geometry: str, meridian: float = ZONE_14_MERIDIAN) -> str:
    return f"transform({geometry}, poly -> transform(poly, r -> {project_points('r', meridian)}))"


def utm_area(geometry: str) -> Column:
    """Area in square metres in UTM zone 14 north."""
    return planar_area(project_geometry(geometry))
