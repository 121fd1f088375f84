"""Mesh cases of a cell by rule: which surface pieces separate its inside corners from the others.

A corner's bit is 1 << (x + 2 y + 4 z).  Surfaces cut crossed edges at their
middle, since masks are binary.  On each face crossed edges are joined in pairs;
where all four edges of a face are crossed, inside corners are kept apart.  The
joined edges form closed loops, which are cut into fans of triangles; of the
fans around a loop's points the one that encloses most is taken.
Coordinates are doubled, so that middles are integers.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

Point = tuple[int, int, int]


def corner(bit: int) -> Point:
    return bit & 1, bit >> 1 & 1, bit >> 2 & 1


def _face_cycles() -> list[list[int]]:
    """The four corners of each face in cyclic order."""
    out = []
    for axis, side in product(range(3), (0, 1)):
        u, v = (a for a in range(3) if a != axis)
        ring = []
        for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
            place = [0, 0, 0]
            place[axis], place[u], place[v] = side, a, b
            ring.append(place[0] + 2 * place[1] + 4 * place[2])
        out.append(ring)
    return out


def _face_links(ring: list[int], inside: set[int], apart: bool) -> list[tuple[frozenset, frozenset]]:
    """Pairs of crossed edges of a face that a surface joins."""
    edges = [frozenset((ring[k], ring[(k + 1) % 4])) for k in range(4)]
    crossed = [k for k in range(4) if len(edges[k] & inside) == 1]
    if len(crossed) == 2:
        return [(edges[crossed[0]], edges[crossed[1]])]
    if len(crossed) == 4:
        # the two edges at each corner of one kind are joined
        return [(edges[k - 1], edges[k]) for k in range(4) if (ring[k] in inside) == apart]
    return []


def middle(edge: frozenset) -> Point:
    a, b = (corner(c) for c in edge)
    return tuple(p + q for p, q in zip(a, b, strict=True))


def _loops(links: list[tuple[frozenset, frozenset]]) -> list[list[frozenset]]:
    near: dict[frozenset, list[frozenset]] = {}
    for a, b in links:
        near.setdefault(a, []).append(b), near.setdefault(b, []).append(a)
    loops, left = [], set(near)
    while left:
        start = min(left, key=lambda e: sorted(e))
        loop, at, before = [start], near[start][0], start
        while at != start:
            loop.append(at)
            one, two = near[at]
            at, before = (two if one == before else one), at
        left -= set(loop)
        loops.append(loop)
    return loops


def _outward(loop: list[frozenset], inside: set[int]) -> list[Point]:
    """The loop's points, turned so that its normal points away from the inside."""
    points = [middle(e) for e in loop]
    normal = [0, 0, 0]
    for p, q in zip(points, points[1:] + points[:1], strict=True):
        for k in range(3):
            i, j = (k + 1) % 3, (k + 2) % 3
            normal[k] += p[i] * q[j] - p[j] * q[i]
    away = [0, 0, 0]
    for e in loop:
        (a,), (b,) = e & inside, e - inside
        for k in range(3):
            away[k] += corner(b)[k] - corner(a)[k]
    return points if sum(n * w for n, w in zip(normal, away, strict=True)) > 0 else points[::-1]


@lru_cache
def cube_triangles(case: int, apart: bool = True) -> tuple[tuple[Point, Point, Point], ...]:
    """Triangles of one of the 256 cases."""
    inside = {b for b in range(8) if case >> b & 1}
    out = []
    for loop in _loops([x for ring in _face_cycles() for x in _face_links(ring, inside, apart)]):
        p = _outward(loop, inside)
        fans = [[(p[s], p[(s + k) % len(p)], p[(s + k + 1) % len(p)]) for k in range(1, len(p) - 1)] for s in range(len(p))]
        out += max(fans, key=lambda fan: sum(_volume(t) for t in fan))
    return tuple(out)


def _volume(t: tuple[Point, Point, Point]) -> int:
    """Six times the signed volume between a triangle and the cell's centre, in doubled coordinates."""
    (a, b, c), (d, e, f), (g, h, i) = ([v - 1 for v in p] for p in t)
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


@lru_cache
def square_segments(case: int, apart: bool = True) -> tuple[tuple[Point, Point], ...]:
    """Segments of one of the 16 cases of a square cell, inside on the left."""
    ring = [0, 1, 3, 2]
    inside = {b for b in range(4) if case >> b & 1}
    out = []
    for a, b in _face_links(ring, inside, apart):
        p, q = middle(a), middle(b)
        (i,) = a & inside
        x, y, _ = (2 * c for c in corner(i))
        left = (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) > 0
        out.append((p, q) if left else (q, p))
    return tuple(out)
