"""The hexagonal grid's geometry: faces, base cells and how they fit together, worked out from few fixed values.

Positions on a face are complex numbers in units of the coarsest cells' spacing, the first axis
along 1; W is a turn by 60 degrees. A face's corners lie at 2, 2 W^2 and 2 W^4. Lattice points
are integers (i, j) for i + j W^2. Base cells are numbered from north to south; those within a
face belong to it, those on an edge or corner have their home given.
"""

from __future__ import annotations

import cmath
import math
from typing import NamedTuple

UNIT = 0.38196601125010500003  # spacing of the coarsest cells on a face, as a tangent: fixed value
ALPHA = math.asin(math.sqrt(3 / 28))  # turn of the lattice between a level and the next

#: Latitude and longitude of the faces' centres, and the azimuth of their first axes, in radians.
FACES = [
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882), (1.307747883455638156, 2.536945009877921159, 5.760339081714187279), (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913), (0.491715428198773866, 0.401988202911306943, 6.130269123335111400), (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874), (0.427370518328979641, -1.888876200336285401, 3.532912002790141181), (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391), (0.079066118549212831, 2.408163140208925497, 5.930472956509811562), (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361), (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365), (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325), (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316), (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436), (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
]
#: Home faces of the base cells on edges, and of the pentagons at the corners.
EDGE_HOMES = {
    1: 2, 5: 1, 11: 1, 13: 3, 19: 2, 22: 0, 28: 4, 30: 0, 35: 11, 39: 6, 40: 7, 43: 3, 52: 10, 53: 4, 54: 12,
    67: 5, 68: 16, 69: 8, 78: 15, 81: 14, 82: 13, 86: 9, 91: 17, 93: 16, 99: 17, 102: 19, 108: 15, 110: 18, 116: 18, 120: 19,
}
PENTAGON_HOMES = {4: 0, 14: 11, 24: 10, 38: 12, 49: 14, 58: 13, 63: 6, 72: 7, 83: 5, 97: 8, 107: 9, 117: 19}

#: Digit of a step by W^0 to W^5, and the turn of each digit; digit 0 is the centre.
DIGIT_OF_TURN = [4, 6, 2, 3, 1, 5]
TURN_OF_DIGIT = {d: t for t, d in enumerate(DIGIT_OF_TURN)}
STEPS = [(1, 0), (1, 1), (0, 1), (-1, 0), (-1, -1), (0, -1)]  # W^0 to W^5 as (i, j)
JK, IK = 3, 5  # turns of the digits on either side of the one that pentagons lack


def power(t: int) -> complex:
    return cmath.exp(1j * math.pi / 3 * (t % 6))


def plane(i: float, j: float) -> complex:
    return complex(i - 0.5 * j, j * math.sqrt(3) / 2)


class Face(NamedTuple):
    centre: tuple[float, float, float]
    along: tuple[float, float, float]  # the first axis
    across: tuple[float, float, float]  # 90 degrees to its left


def _frame(lat: float, lng: float, azimuth: float) -> Face:
    centre = (math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat))
    north = (-math.sin(lat) * math.cos(lng), -math.sin(lat) * math.sin(lng), math.cos(lat))
    east = (-math.sin(lng), math.cos(lng), 0.0)
    mixed = lambda a, b: tuple(a * n + b * e for n, e in zip(north, east, strict=True))
    return Face(centre, mixed(math.cos(azimuth), math.sin(azimuth)), mixed(math.sin(azimuth), -math.cos(azimuth)))


FRAMES = [_frame(*f) for f in FACES]


def on_sphere(face: int, z: complex) -> tuple[float, float, float]:
    f = FRAMES[face]
    p = [c + UNIT * (z.real * a + z.imag * b) for c, a, b in zip(*f, strict=True)]
    size = math.sqrt(sum(x * x for x in p))
    return tuple(x / size for x in p)


def _near(p, q) -> bool:
    return sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) < 1e-6


class Hop(NamedTuple):
    """To a neighbouring face: a position z there is z W^turn + shift."""

    face: int
    turn: int
    shift: complex


def _hops() -> list[list[Hop]]:
    """For each face the neighbour beyond the edges whose normals are W, W^3 and W^5."""
    corners = [[on_sphere(f, 2 * power(2 * k)) for k in range(3)] for f in range(20)]
    out = []
    for f in range(20):
        row = []
        for a, b in ((0, 1), (1, 2), (2, 0)):
            for g in range(20):
                at = [next((k for k in range(3) if _near(corners[g][k], corners[f][c])), None) for c in (a, b)]
                if g != f and None not in at:
                    (za, zb), (ya, yb) = [[2 * power(2 * k) for k in pair] for pair in ((a, b), at)]
                    turn = round(cmath.phase((yb - ya) / (zb - za)) / (math.pi / 3)) % 6
                    row.append(Hop(g, turn, ya - power(turn) * za))
        out.append(row)
    return out


HOPS = _hops()


def beyond(z: complex) -> int | None:
    """Which edge of its face a position lies beyond, if any."""
    over = [(z * power(-t)).real for t in (1, 3, 5)]
    most = max(range(3), key=over.__getitem__)
    return most if over[most] > 1 + 1e-6 else None


class BaseCell(NamedTuple):
    face: int
    i: int
    j: int
    pentagon: bool


def _base_cells() -> list[BaseCell]:
    found: list[tuple[tuple, list[tuple[int, int, int]]]] = []
    for f in range(20):
        for i in range(-2, 3):
            for j in range(-2, 3):
                z = plane(i, j)
                if beyond(z) is None:
                    p = on_sphere(f, z)
                    same = next((e for e in found if _near(e[0], p)), None)
                    same[1].append((f, i, j)) if same else found.append((p, [(f, i, j)]))
    found.sort(key=lambda e: -e[0][2])
    homes = EDGE_HOMES | PENTAGON_HOMES
    return [BaseCell(*next(x for x in places if len(places) == 1 or x[0] == homes[n]), len(places) == 5) for n, (_, places) in enumerate(found)]


BASE_CELLS = _base_cells()
_POINTS = [on_sphere(b.face, plane(b.i, b.j)) for b in BASE_CELLS]


class Sector(NamedTuple):
    """One of the five faces around a pentagon: where the pentagon lies there, and the turn from the pentagon's frame."""

    face: int
    turn: int
    corner: complex


def _sectors(base: BaseCell) -> dict[int, Sector]:
    """By the turn of the leading digit, clockwise from the home face, which lies towards W^3."""
    out, face, turn, z = {}, base.face, 0, plane(base.i, base.j)
    for n in range(5):
        out[(JK - n) % 6] = Sector(face, turn % 6, z)
        inward = round(cmath.phase(-z) / (math.pi / 3)) % 6  # the face's middle, seen from the corner
        edge = next(k for k, t in enumerate((1, 3, 5)) if abs(cmath.phase(cmath.exp(1j * (inward * math.pi / 3 - math.pi / 6)) / power(t))) > 1 and (z * power(-t)).real > 0.99 and (t - inward) % 6 in (4, 5))
        hop = HOPS[face][edge]
        face, turn, z = hop.face, turn + hop.turn, z * power(hop.turn) + hop.shift
    return out


SECTORS = {n: _sectors(b) for n, b in enumerate(BASE_CELLS) if b.pentagon}


class Place(NamedTuple):
    """The base cell at a position, the turn to its frame, and how far to turn further if that makes a pentagon's leading digit the missing one."""

    base: int
    turn: int
    mend: int


def place(face: int, z: complex) -> Place:
    edge = beyond(z)
    if edge is not None:
        hop = HOPS[face][edge]
        there = place(hop.face, z * power(hop.turn) + hop.shift)
        return Place(there.base, (hop.turn + there.turn) % 6, there.mend)
    p = on_sphere(face, z)
    n = next(k for k, q in enumerate(_POINTS) if _near(p, q))
    base = BASE_CELLS[n]
    if base.pentagon:
        lead, sector = next((t, s) for t, s in SECTORS[n].items() if s.face == face)
        return Place(n, -sector.turn % 6, {JK: 1, IK: -1}.get(lead, 0))
    if base.face == face:
        return Place(n, 0, 0)
    return Place(n, next(h.turn for h in HOPS[face] if h.face == base.face), 0)


def places() -> list[Place]:
    """For each face and (i, j) from -2 to 2; positions far beyond an edge, which no point of the face reaches, are those of their nearest."""
    out = []
    for f in range(20):
        for i in range(-2, 3):
            for j in range(-2, 3):
                z = plane(i, j)
                out.append(place(f, z) if abs(z) < 2.01 else Place(-1, 0, 0))
    return out


def neighbours() -> list[Place]:
    """For each base cell and step W^0 to W^5 what lies there; -1 where a pentagon has nothing."""
    out = []
    for n, b in enumerate(BASE_CELLS):
        for t in range(6):
            if not b.pentagon:
                out.append(place(b.face, plane(b.i, b.j) + power(t)))
            elif t in SECTORS[n]:
                s = SECTORS[n][t]
                there = place(s.face, s.corner + power(t + s.turn))
                out.append(Place(there.base, (s.turn + there.turn) % 6, there.mend))
            else:
                out.append(Place(-1, 0, 0))
    return out
