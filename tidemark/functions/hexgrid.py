"""Cell ids and positions: where a cell lies, the cell of a position, neighbours, disks, rings and boundaries.

All are column expressions over 64-bit ids; the grid's tables come from ``icosahedron``. A
position is projected to its nearest face and rounded to the lattice of the asked level; the
digits are what is left at each level on the way up. A neighbour is found on the digits alone:
the cell's lattice point within its base cell is stepped and taken up again, and where that
leaves the base cell, the digits turn with the next one's frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import cells
from tidemark.functions import icosahedron as ico

_ROOT7 = math.sqrt(7)
_HEAD = 1 << 59  # the mode of a cell id


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


@cache
def _literal(values: tuple) -> str:
    return "array(" + ", ".join(f"{v!r}D" if isinstance(v, float) else str(v) for v in values) + ")"


def _table(values: list) -> Column:
    return F.expr(_literal(tuple(values)))


def _at(values: list, index: Column) -> Column:
    """An entry of a table, counted from 0."""
    return F.get(_table(values), index.cast("int"))


def _levels(res: Column) -> Column:
    """1 up to a resolution; empty for 0."""
    return F.slice(_table(list(range(1, cells.FINEST + 1))), F.lit(1), res)


def _odd(level: Column) -> Column:
    return level.bitwiseAND(1) == 1


def _pair(i: Column, j: Column) -> Column:
    return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))


def _finer(p: Column, odd: Column) -> Column:
    """A lattice point one level down; odd levels are turned one way, even ones back."""
    return _pair(F.when(odd, 2 * p["i"] + p["j"]).otherwise(3 * p["i"] - p["j"]), F.when(odd, 3 * p["j"] - p["i"]).otherwise(p["i"] + 2 * p["j"]))


def _coarser(p: Column, odd: Column) -> Column:
    """The lattice point one level up that a point belongs to."""
    i = F.when(odd, 3 * p["i"] - p["j"]).otherwise(2 * p["i"] + p["j"])
    j = F.when(odd, p["i"] + 2 * p["j"]).otherwise(3 * p["j"] - p["i"])
    return _pair(F.round(i / 7.0), F.round(j / 7.0))


_DIGIT_OF_STEP = [0] * 9
for _t, (_i, _j) in enumerate(ico.STEPS):
    _DIGIT_OF_STEP[3 * (_i + 1) + _j + 1] = ico.DIGIT_OF_TURN[_t]
_TURN = [-1] + [ico.TURN_OF_DIGIT[d] for d in range(1, 7)]
_STEP_I, _STEP_J = ([0] + [ico.STEPS[ico.TURN_OF_DIGIT[d]][k] for d in range(1, 7)] for k in (0, 1))
_TURNED = [0 if d == 0 else ico.DIGIT_OF_TURN[(ico.TURN_OF_DIGIT[d] + t) % 6] for t in range(6) for d in range(7)]
_PLACES, _NEIGHBOURS = ico.places(), ico.neighbours()
_PENTAGON = [b.pentagon for b in ico.BASE_CELLS]


def _digit(cell: Column, level: Column) -> Column:
    return F.call_function("shiftrightunsigned", cell, (3 * (cells.FINEST - level)).cast("int")).bitwiseAND(7).cast("int")


def _put(digit: Column, level: Column) -> Column:
    return F.call_function("shiftleft", digit.cast("long"), (3 * (cells.FINEST - level)).cast("int"))


def _up(p: Column, res: Column) -> Column:
    """A lattice point as (i, j) at the coarsest level and the digits, in their places, on the way there."""
    start = F.struct(p["i"].alias("i"), p["j"].alias("j"), F.lit(0).cast("long").alias("digits"))

    def step(s: Column, level: Column) -> Column:
        odd = _odd(level)

        def rest(q: Column) -> Column:
            back = _finer(q, odd)
            digit = _at(_DIGIT_OF_STEP, 3 * (s["i"] - back["i"] + 1) + s["j"] - back["j"] + 1)
            return F.struct(q["i"].alias("i"), q["j"].alias("j"), (s["digits"] + _put(digit, level)).alias("digits"))

        return _let(_coarser(s, odd), rest)

    return F.aggregate(F.reverse(_levels(res)), start, step)


def _down(cell: Column, res: Column) -> Column:
    """The lattice point of a cell, from its base cell."""
    zero = _pair(F.lit(0), F.lit(0))

    def step(p: Column, level: Column) -> Column:
        return _let(F.struct(_finer(p, _odd(level)).alias("q"), _digit(cell, level).alias("d")), lambda x: _pair(x["q"]["i"] + _at(_STEP_I, x["d"]), x["q"]["j"] + _at(_STEP_J, x["d"])))

    return F.aggregate(_levels(res), zero, step)


def _lead(digits: Column, res: Column) -> Column:
    """The first digit that is not 0, or 0."""
    return F.aggregate(_levels(res), F.lit(0), lambda found, level: F.when(found != 0, found).otherwise(_digit(digits, level)))


def _turned(digits: Column, res: Column, turn: Column) -> Column:
    return F.aggregate(_levels(res), F.lit(0).cast("long"), lambda out, level: out + _put(_at(_TURNED, F.pmod(turn, F.lit(6)) * 7 + _digit(digits, level)), level))


def _id(base: Column, digits: Column, res: Column) -> Column:
    unused = F.call_function("shiftleft", F.lit(1).cast("long"), (3 * (cells.FINEST - res)).cast("int")) - 1
    return F.lit(_HEAD) + F.call_function("shiftleft", res.cast("long"), F.lit(52)) + F.call_function("shiftleft", base.cast("long"), F.lit(45)) + digits + unused


def _entered(base: Column, mend: Column, digits: Column, res: Column) -> Column:
    """The id with digits in a base cell's frame; in a pentagon the missing leading digit is turned past."""
    return _let(F.when((mend != 0) & (_lead(digits, res) == 1), _turned(digits, res, mend)).otherwise(digits), lambda d: _id(base, d, res))


def cell_at(lat: Column, lng: Column, res: Column | int) -> Column:
    """The cell of a level at a position in degrees; null for nulls and for what is no position."""
    res = F.lit(res) if isinstance(res, int) else res

    def of_point(p: Column) -> Column:
        faces = F.array(*(F.struct((p["x"] * c[0] + p["y"] * c[1] + p["z"] * c[2]).alias("dot"), F.lit(-f).alias("minus")) for f, (c, _, _) in enumerate(ico.FRAMES)))
        return _let(F.array_max(faces), lambda near: on_face(p, near))

    def axis(p: Column, face: Column, k: int) -> Column:
        return p["x"] * _at([f[k][0] for f in ico.FRAMES], face) + p["y"] * _at([f[k][1] for f in ico.FRAMES], face) + p["z"] * _at([f[k][2] for f in ico.FRAMES], face)

    def on_face(p: Column, near: Column) -> Column:
        face, scale = -near["minus"], _at([_ROOT7**r / ico.UNIT for r in range(16)], res) / near["dot"]
        flat = F.struct((axis(p, face, 1) * scale).alias("x"), (axis(p, face, 2) * scale).alias("y"), face.alias("face"))
        return _let(flat, on_lattice)

    def on_lattice(z: Column) -> Column:
        turn = [(r % 2) * ico.ALPHA for r in range(16)]
        c, s = _at([math.cos(t) for t in turn], res), _at([math.sin(t) for t in turn], res)
        x, y = z["x"] * c + z["y"] * s, z["y"] * c - z["x"] * s
        # in the basis of 1 and W: r along W, q along 1; the third coordinate makes the sum 0
        r = y / (math.sqrt(3) / 2)
        return _let(F.struct((x - r / 2).alias("q"), r.alias("r")), lambda h: rounded(h, z["face"]))

    def rounded(h: Column, face: Column) -> Column:
        whole = F.struct(F.round(h["q"]).alias("q"), F.round(h["r"]).alias("r"), F.round(-h["q"] - h["r"]).alias("s"))

        def nearest(n: Column) -> Column:
            dq, dr, ds = F.abs(n["q"] - h["q"]), F.abs(n["r"] - h["r"]), F.abs(n["s"] + h["q"] + h["r"])
            q = F.when((dq > dr) & (dq > ds), -n["r"] - n["s"]).otherwise(n["q"])
            r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -n["q"] - n["s"]).otherwise(n["r"])
            return _let(_pair(q + r, r), lambda p: _let(_up(p, res), lambda up: named(up, face)))

        return _let(whole, nearest)

    def named(up: Column, face: Column) -> Column:
        at = face * 25 + (up["i"] + 2) * 5 + up["j"] + 2
        found = F.struct(_at([p.base for p in _PLACES], at).alias("base"), _at([p.turn for p in _PLACES], at).alias("turn"), _at([p.mend for p in _PLACES], at).alias("mend"))
        return _let(found, lambda f: _let(_turned(up["digits"], res, f["turn"]), lambda d: _entered(f["base"], f["mend"], d, res)))

    a, b = F.radians(lat), F.radians(lng)
    point = F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))
    good = lat.between(-90, 90) & F.abs(lng).between(0, 1e6) & res.between(0, cells.FINEST)
    return F.when(good, _let(point, of_point))


def neighbour(cell: Column, turn: Column | int) -> Column:
    """The neighbour one step along W^turn of the cell's own base cell; null where a pentagon has none.

    Steps of two cells of different base cells need not point the same way.
    """
    turn = F.lit(turn) if isinstance(turn, int) else turn

    def start(c: Column) -> Column:
        return _let(_down(c["cell"], c["res"]), lambda p: _let(_up(_pair(p["i"] + _at([s[0] for s in ico.STEPS], turn), p["j"] + _at([s[1] for s in ico.STEPS], turn)), c["res"]), lambda up: settle(c, up)))

    def settle(c: Column, up: Column) -> Column:
        """Within a pentagon's frame, what falls into its gap is turned to the gap's other side."""
        pentagon = _at(_PENTAGON, c["base"])
        old = F.when(pentagon, _lead(c["cell"], c["res"])).otherwise(0)
        step = _at(_DIGIT_OF_STEP, 3 * (up["i"] + 1) + up["j"] + 1)
        way = F.struct(up["digits"].alias("digits"), step.alias("step"), pentagon.alias("pentagon"), old.alias("old"), F.when(step != 0, step).otherwise(_lead(up["digits"], c["res"])).alias("new"))

        def mended(w: Column) -> Column:
            gap = w["pentagon"] & (w["new"] == 1)
            by = F.when(~gap, 0).when(w["old"] == ico.DIGIT_OF_TURN[ico.JK], 1).when(w["old"] == ico.DIGIT_OF_TURN[ico.IK], -1)
            return F.when(by.isNotNull(), _let(F.struct(_at(_TURNED, F.pmod(by, F.lit(6)) * 7 + w["step"]).alias("step"), _turned(w["digits"], c["res"], by).alias("digits")), lambda s: cross(c, s)))

        return _let(way, mended)

    def cross(c: Column, s: Column) -> Column:
        at = c["base"] * 6 + _at(_TURN, s["step"])
        there = F.struct(_at([p.base for p in _NEIGHBOURS], at).alias("base"), _at([p.turn for p in _NEIGHBOURS], at).alias("turn"), _at([p.mend for p in _NEIGHBOURS], at).alias("mend"))
        moved = _let(there, lambda t: F.when(t["base"] >= 0, _let(_turned(s["digits"], c["res"], t["turn"]), lambda d: _entered(t["base"], t["mend"], d, c["res"]))))
        return F.when(s["step"] == 0, _id(c["base"], s["digits"], c["res"])).otherwise(moved)

    return F.when(cell.isNotNull(), _let(F.struct(cell.alias("cell"), cells.resolution(cell).alias("res"), cells.base_cell(cell).alias("base")), start))


def neighbours(cell: Column) -> Column:
    """The six cells, or five, that touch a cell."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(_table(list(range(6))), lambda t: neighbour(cell, t)))))


def rings(cell: Column, k: int) -> Column:
    """Cells by their distance, 0 to k: an array of sorted arrays."""

    def grow(held: Column, _: Column) -> Column:
        last, before = F.element_at(held, -1), F.when(F.size(held) > 1, F.element_at(held, -2)).otherwise(F.array(F.lit(0).cast("long")))
        around = F.array_distinct(F.flatten(F.transform(last, neighbours)))
        return F.concat(held, F.array(F.array_sort(F.array_except(F.array_except(around, last), before))))

    return F.aggregate(F.slice(_table(list(range(1, k + 1))), 1, k) if k else F.array().cast("array<int>"), F.array(F.array(cell)), grow)


def ring(cell: Column, k: int) -> Column:
    """Cells at distance k."""
    return F.element_at(rings(cell, k), -1)


def disk(cell: Column, k: int) -> Column:
    """Cells no farther than k, sorted."""
    return F.array_sort(F.flatten(rings(cell, k)))


_HOPS = [h for row in ico.HOPS for h in row]
_SECTOR = [ico.SECTORS[n].get(ico.TURN_OF_DIGIT[d]) if b.pentagon and d else None for n, b in enumerate(ico.BASE_CELLS) for d in range(7)]
_COS, _SIN = ([f(t * math.pi / 3) for t in range(6)] for f in (math.cos, math.sin))


def _spun(z: Column, turn: Column, x: Column, y: Column, face: Column) -> Column:
    """A position turned by W^turn and moved, on another face."""
    c, s = _at(_COS, turn), _at(_SIN, turn)
    return F.struct((z["x"] * c - z["y"] * s + x).alias("x"), (z["x"] * s + z["y"] * c + y).alias("y"), face.cast("int").alias("face"))


def _hopped(z: Column) -> Column:
    """The same place on the neighbouring face, if it lies beyond an edge."""
    over = F.array(*(F.struct((z["x"] * _COS[t] + z["y"] * _SIN[t]).alias("over"), F.lit(k).alias("edge")) for k, t in enumerate((1, 3, 5))))

    def move(most: Column) -> Column:
        at = z["face"] * 3 + most["edge"]
        there = _spun(z, _at([h.turn for h in _HOPS], at), _at([h.shift.real for h in _HOPS], at), _at([h.shift.imag for h in _HOPS], at), _at([h.face for h in _HOPS], at))
        return F.when(most["over"] > 1 + 1e-9, there).otherwise(z)

    return _let(F.array_max(over), move)


def _on_face(cell: Column, dx: Column, dy: Column, lead: Column | None = None) -> Column:
    """Where a cell's centre lies, moved by (dx, dy) of its level's lattice, as (x, y, face).

    ``lead``: the digit towards which a pentagon's own place is moved.
    """

    def start(c: Column) -> Column:
        def flat(p: Column) -> Column:
            x, y = p["i"] - 0.5 * p["j"] + dx, p["j"] * (math.sqrt(3) / 2) + dy
            turn = [(r % 2) * ico.ALPHA for r in range(16)]
            k, s = _at([math.cos(t) / _ROOT7**r for r, t in enumerate(turn)], c["res"]), _at([math.sin(t) / _ROOT7**r for r, t in enumerate(turn)], c["res"])
            return F.struct((x * k - y * s).alias("x"), (x * s + y * k).alias("y"), F.lit(0).alias("face"))

        return _let(_let(_down(c["cell"], c["res"]), flat), lambda z: settle(c, z))

    def settle(c: Column, z: Column) -> Column:
        home = [ico.plane(b.i, b.j) for b in ico.BASE_CELLS]
        plain = F.struct((z["x"] + _at([h.real for h in home], c["base"])).alias("x"), (z["y"] + _at([h.imag for h in home], c["base"])).alias("y"), _at([b.face for b in ico.BASE_CELLS], c["base"]).alias("face"))
        at = c["base"] * 7 + F.when(_at(_PENTAGON, c["base"]), _lead(c["cell"], c["res"]) if lead is None else lead).otherwise(0)
        sector = _spun(z, _at([s.turn if s else 0 for s in _SECTOR], at), _at([s.corner.real if s else 0.0 for s in _SECTOR], at), _at([s.corner.imag if s else 0.0 for s in _SECTOR], at), _at([s.face if s else 0 for s in _SECTOR], at))
        return _let(F.when(_at([s is not None for s in _SECTOR], at), sector).otherwise(plain), _hopped)

    return _let(F.struct(cell.alias("cell"), cells.resolution(cell).alias("res"), cells.base_cell(cell).alias("base")), start)


def _position(z: Column) -> Column:
    """(lat, lng) in degrees of a place on a face."""

    def of(p: Column) -> Column:
        return F.struct(F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lng"))

    def axis(k: int) -> Column:
        return _at([f.centre[k] for f in ico.FRAMES], z["face"]) + ico.UNIT * (z["x"] * _at([f.along[k] for f in ico.FRAMES], z["face"]) + z["y"] * _at([f.across[k] for f in ico.FRAMES], z["face"]))

    return _let(F.struct(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z")), of)


def center(cell: Column) -> Column:
    """(lat, lng) of a cell's centre in degrees."""
    return F.when(cell.isNotNull(), _let(_on_face(cell, F.lit(0.0), F.lit(0.0)), _position))


def boundary(cell: Column) -> Column:
    """Corners of a cell as an array of (lat, lng), counterclockwise; a pentagon has five.

    Where a cell lies over an edge of the icosahedron its sides bend there; the bends are not among the corners.
    """
    reach = 1 / math.sqrt(3)
    x, y = ([reach * f(math.pi / 6 + k * math.pi / 3) for k in range(6)] for f in (math.cos, math.sin))
    toward = [4, 6, 2, 3, 0, 4]  # the digit on whose side of a pentagon a corner lies; none where its gap is

    def corner(k: Column, lead: Column | None = None) -> Column:
        return _let(_let(_on_face(cell, _at(x, k), _at(y, k), lead), _hopped), _position)

    whole = F.transform(_table(list(range(6))), lambda k: corner(k))
    five = F.transform(_table([k for k in range(6) if toward[k]]), lambda k: corner(k, _at(toward, k)))
    return F.when(cells.is_pentagon(cell), five).when(cell.isNotNull(), whole)


def around(cell: Column) -> Column:
    """The neighbours of a cell in order, counterclockwise; corner k of the boundary lies between the k-th and the next."""
    return F.array_compact(F.transform(_table(list(range(6))), lambda t: neighbour(cell, t)))
