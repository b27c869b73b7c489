"""Delaunay triangulation of the points of one tile, with exact decisions.

Points go in one after another: the triangles whose circle holds the new point
make room for a fan around it. Outside, the hull's edges form triangles with a
point at infinity, so no large helper triangle bends the hull. Signs are taken
in floating point where its error bound allows, else in fractions. Points on
one circle are told apart as if the point with the lowest index stood a little
higher on the paraboloid than the next one; so the triangles depend on the
points and the order of their indexes only, and tiles that share points agree.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

FAR = -1  # the point at infinity


def turn(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    """Above 0 if a, b, c turn left, below if right, 0 if they lie on a line: exact."""
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    d = left - right
    if abs(d) > 3.4e-16 * (abs(left) + abs(right)):
        return d
    if d == 0 and ((ax == bx and ay == by) or (ax == bx == cx) or (ay == by == cy)):
        return 0.0
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    e = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return float((e > 0) - (e < 0))


def insertion_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Random rounds of doubling size, each in strips to and fro: short walks and few triangles that are made in vain."""
    n = len(x)
    dealt = np.random.default_rng(1).permutation(n)
    rank = lambda v: (v - v.min()) / max(float(np.ptp(v)), 1e-300)
    u, v = rank(x), rank(y)
    out, low = [], 0
    while low < n:
        part = dealt[low : max(2 * low, 16)]
        strips = max(1, int(np.sqrt(len(part) / 2)))
        strip = np.minimum((u[part] * strips).astype(np.int64), strips - 1)
        out.append(part[np.lexsort((np.where(strip % 2, -v[part], v[part]), strip))])
        low += len(part)
    return np.concatenate(out)


class Triangles:
    """``apex[a, b]`` is c for each triangle a, b, c that turns left; the hull's edges have FAR on their outside. None if all points lie on a line."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x.tolist(), y.tolist()
        self.apex: dict[tuple[int, int], int] = {}
        order = insertion_order(x, y).tolist() if len(x) else []
        third = next((k for k in range(2, len(order)) if self._turn(order[0], order[1], order[k])), None)
        self.flat = third is None
        if third is None:
            return
        order.insert(2, order.pop(third))
        a, b, c = order[:3]
        if self._turn(a, b, c) < 0:
            b, c = c, b
        self._add(a, b, c)
        for i, j in ((a, b), (b, c), (c, a)):
            self._add(j, i, FAR)
        at = (a, b)
        for p in order[3:]:
            at = self._insert(p, at)

    def _turn(self, a: int, b: int, c: int) -> float:
        x, y = self.x, self.y
        return turn(x[a], y[a], x[b], y[b], x[c], y[c])

    def _add(self, a: int, b: int, c: int) -> None:
        self.apex[a, b], self.apex[b, c], self.apex[c, a] = c, a, b

    def _inside(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether p lies in the circle of a, b, c, or outside the hull's edge where one of them is at infinity."""
        if FAR in (a, b, c):
            while c != FAR:
                a, b, c = b, c, a
            s = self._turn(a, b, p)
            if s:
                return s > 0
            x, y = self.x, self.y
            return min(x[a], x[b]) <= x[p] <= max(x[a], x[b]) and min(y[a], y[b]) <= y[p] <= max(y[a], y[b])
        x, y = self.x, self.y
        px, py = x[p], y[p]
        ax, ay, bx, by, cx, cy = x[a] - px, y[a] - py, x[b] - px, y[b] - py, x[c] - px, y[c] - py
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
        d = a2 * (bc - cb) + b2 * (ca - ac) + c2 * (ab - ba)
        if abs(d) > 1.2e-15 * (a2 * (abs(bc) + abs(cb)) + b2 * (abs(ca) + abs(ac)) + c2 * (abs(ab) + abs(ba))):
            return d > 0
        return self._inside_exact(a, b, c, p)

    def _inside_exact(self, a: int, b: int, c: int, p: int) -> bool:
        f = lambda i: (Fraction(self.x[i]) - Fraction(self.x[p]), Fraction(self.y[i]) - Fraction(self.y[p]))
        (ax, ay), (bx, by), (cx, cy) = f(a), f(b), f(c)
        d = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        if d:
            return d > 0
        # on the circle: the sign of the lowest point's height in the determinant decides, and no three of the four are on a line
        low = min(a, b, c, p)
        if low == p:
            return False  # its own height lifts it out of the circle
        if low == a:
            return self._turn(b, c, p) > 0
        return self._turn(c, a, p) > 0 if low == b else self._turn(a, b, p) > 0

    def _insert(self, p: int, at: tuple[int, int]) -> tuple[int, int]:
        apex = self.apex
        a, b = at
        if apex[a, b] == FAR:
            a, b = b, a
        while True:  # walk to the triangle that holds p, or out over the hull's edge that p sees
            c = apex[a, b]
            if FAR in (a, b, c):
                break
            if self._turn(a, b, p) < 0:
                a, b = b, a
            elif self._turn(b, c, p) < 0:
                a, b = c, b
            elif self._turn(c, a, p) < 0:
                a, b = a, c
            else:
                break
        edges = [(a, b), (b, c), (c, a)]
        for e in edges:
            del apex[e]
        rim = []
        while edges:
            a, b = edges.pop()
            c = apex.get((b, a))
            if c is None:  # its triangle went by another edge
                continue
            if self._inside(b, a, c, p):
                del apex[b, a], apex[a, c], apex[c, b]
                edges += [(a, c), (c, b)]
            else:
                rim.append((a, b))
        for a, b in rim:
            self._add(a, b, p)
        return next((e for e in rim if FAR not in e), rim[0])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b, c of every triangle in its three turns."""
        keys = np.array(list(self.apex), np.int64).reshape(-1, 2)
        return keys[:, 0], keys[:, 1], np.fromiter(self.apex.values(), np.int64, len(self.apex))


def certain(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, rim: tuple[float, float, float, float]) -> np.ndarray:
    """Which triangles have their whole circle within the rim (x0, y0, x1, y1), so that no point beyond it can undo them."""
    bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
    left, right = bx * cy, by * cx
    area = 2 * (left - right)
    with np.errstate(divide="ignore", invalid="ignore"):
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * b2 - by * c2) / area, (bx * c2 - cx * b2) / area
        r = np.hypot(ux, uy)
        far = r * (1 + 1e-6) + 1e-12 * (np.abs(x[a]) + np.abs(y[a]) + r)
        px, py = x[a] + ux, y[a] + uy
        held = (px - far > rim[0]) & (py - far > rim[1]) & (px + far < rim[2]) & (py + far < rim[3])
    return held & (np.abs(area) > 1e-8 * (np.abs(left) + np.abs(right))) & (a != FAR) & (b != FAR) & (c != FAR)


def line_edges(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of the edges between neighbours of points on one line."""
    order = np.lexsort((y, x))
    return np.concatenate([order[:-1], order[1:]]), np.concatenate([order[1:], order[:-1]])
