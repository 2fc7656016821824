"""Column expressions for periodic boxes, quaternions and cell shapes. Quaternions are structs (w, x, y, z)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(x: Column, length: float) -> Column:
    """Into [0, length)."""
    return F.pmod(x, F.lit(float(length)))


def min_image(d: Column, length: float) -> Column:
    """The shortest periodic image of a difference (ties to even, as rint does)."""
    return d - F.rint(d / F.lit(float(length))) * F.lit(float(length))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: formulas that use their arguments often grow fast when nested."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free(d: Column, length: float) -> Column:
    """A difference along an axis without periodicity."""
    return d


def square_distance(dx: Column, dy: Column, dz: Column) -> Column:
    return dx * dx + dy * dy + dz * dz


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def quat_mul(p: Column, q: Column) -> Column:
    return quat(
        p.w * q.w - p.x * q.x - p.y * q.y - p.z * q.z,
        p.w * q.x + p.x * q.w + p.y * q.z - p.z * q.y,
        p.w * q.y - p.x * q.z + p.y * q.w + p.z * q.x,
        p.w * q.z + p.x * q.y - p.y * q.x + p.z * q.w,
    )


def quat_conj(q: Column) -> Column:
    return quat(q.w, -q.x, -q.y, -q.z)


def quat_canonical(q: Column) -> Column:
    """The one of q and -q whose first non-zero part is positive."""
    negative = (q.w < 0) | ((q.w == 0) & ((q.x < 0) | ((q.x == 0) & ((q.y < 0) | ((q.y == 0) & (q.z < 0))))))
    return F.when(negative, quat(-q.w, -q.x, -q.y, -q.z)).otherwise(q)


def quat_matrix(q: Column) -> list[Column]:
    """Nine entries of the rotation, row by row."""
    w, x, y, z = q.w, q.x, q.y, q.z
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def matrix_quat(r: list[Column]) -> Column:
    """Quaternion of a rotation matrix (nine entries by row): the largest part by its square, the others by quotients."""
    squares = [1 + r[0] + r[4] + r[8], 1 + r[0] - r[4] - r[8], 1 - r[0] + r[4] - r[8], 1 - r[0] - r[4] + r[8]]
    rows = [
        [squares[0], r[7] - r[5], r[2] - r[6], r[3] - r[1]],
        [r[7] - r[5], squares[1], r[1] + r[3], r[2] + r[6]],
        [r[2] - r[6], r[1] + r[3], squares[2], r[5] + r[7]],
        [r[3] - r[1], r[2] + r[6], r[5] + r[7], squares[3]],
    ]
    top, out = F.greatest(*squares), None
    for square, row in zip(squares, rows, strict=True):
        one = quat(*[c / (2 * F.sqrt(top)) for c in row])
        out = F.when(square == top, one) if out is None else out.when(square == top, one)
    return let(out, quat_canonical)


def axis_angle(q: Column) -> Column:
    """(x, y, z, angle): unit axis and degrees in [0, 180]; the identity has the axis z."""
    size = F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z)
    sign, angle = F.when(q.w < 0, -1.0).otherwise(1.0), quat_angle(q.w)
    still = (angle < F.lit(IDENTITY)) | (size == 0)
    parts = [F.when(still, F.lit(float(c == "z"))).otherwise(sign * q[c] / F.nullif(size, F.lit(0.0))).alias(c) for c in "xyz"]
    return F.struct(*parts, F.when(still, 0.0).otherwise(angle).alias("angle"))


def from_axis_angle(x: Column, y: Column, z: Column, degrees: Column) -> Column:
    """Null for a zero axis."""
    size, half = F.nullif(F.sqrt(x * x + y * y + z * z), F.lit(0.0)), F.radians(degrees) / 2
    return F.when(size.isNotNull(), quat(F.cos(half), *[F.sin(half) * c / size for c in (x, y, z)]))


def bunge(q: Column) -> Column:
    """(phi1, Phi, phi2) in degrees, turns about z, x, z; where Phi is 0 or 180, phi2 is 0."""
    r = quat_matrix(q)
    tilt = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r[8])))
    flat, turn = F.sin(tilt) < F.lit(1e-7), F.lit(360.0)
    first = F.when(flat, F.atan2(r[3], r[0])).otherwise(F.atan2(r[2], -r[5]))
    last = F.when(flat, F.lit(0.0)).otherwise(F.atan2(r[6], r[7]))
    return F.struct(F.pmod(F.degrees(first), turn).alias("phi1"), F.degrees(tilt).alias("Phi"), F.pmod(F.degrees(last), turn).alias("phi2"))


def from_bunge(phi1: Column, tilt: Column, phi2: Column) -> Column:
    total, gap, half = F.radians(phi1 + phi2) / 2, F.radians(phi1 - phi2) / 2, F.radians(tilt) / 2
    found = quat(F.cos(half) * F.cos(total), F.sin(half) * F.cos(gap), F.sin(half) * F.sin(gap), F.cos(half) * F.sin(total))
    return let(found, quat_canonical)


IDENTITY = 1e-6


def class_deviation(p: Column, q: Column, symmetry: Column) -> Column:
    """Degrees between two misorientations up to symmetry on both sides and exchange of the two crystals.

    The scalar part of conj(p) a q b is the dot of p and a q b; exchange turns q into its conjugate.
    """

    def best(base: Column) -> Column:
        def turned(left: Column) -> Column:
            return F.array_max(F.transform(symmetry, lambda b: F.abs(left.w * b.w - left.x * b.x - left.y * b.y - left.z * b.z)))

        return F.array_max(F.transform(symmetry, lambda a: let(quat_mul(quat_conj(p), a), lambda m: let(quat_mul(m, base), turned))))

    return quat_angle(let(q, lambda base: F.greatest(best(base), let(quat_conj(base), best))))


def lab_axis(p: Column, q: Column, symmetry: Column) -> Column:
    """(x, y, z, angle): the smallest rotation that takes crystal p to crystal q, in the frame of the sample."""
    back = quat_conj(p)
    turn = F.transform(symmetry, lambda s: let(quat_mul(q, s), lambda m: quat_mul(m, back)))
    best = F.array_max(F.transform(turn, lambda m: F.struct(F.abs(m.w).alias("size"), m.alias("m"))))
    return let(best, lambda b: axis_angle(b.m))


def rotate(q: Column, x: Column, y: Column, z: Column) -> list[Column]:
    r = quat_matrix(q)
    return [r[3 * k] * x + r[3 * k + 1] * y + r[3 * k + 2] * z for k in range(3)]


def rotate_back(q: Column, x: Column, y: Column, z: Column) -> list[Column]:
    r = quat_matrix(q)
    return [r[k] * x + r[k + 3] * y + r[k + 6] * z for k in range(3)]


def curvature(phi: dict[tuple[int, int, int], Column], h: float) -> Column:
    """(mean, gauss, ok) of the level set of `phi`, its values at the 19 offsets with at most two steps of h; 0 where the slope is under 0.1."""
    at = lambda *o: phi[o]
    unit = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    minus = [tuple(-c for c in u) for u in unit]
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    g = [(at(*unit[k]) - at(*minus[k])) / (2 * h) for k in range(3)]
    second = [(at(*unit[k]) - 2 * at(0, 0, 0) + at(*minus[k])) / (h * h) for k in range(3)]
    mixed = {
        (a, b): (at(*add(unit[a], unit[b])) - at(*add(unit[a], minus[b])) - at(*add(minus[a], unit[b])) + at(*add(minus[a], minus[b]))) / (4 * h * h)
        for a, b in ((0, 1), (0, 2), (1, 2))
    }
    m = lambda a, b: second[a] if a == b else mixed[min(a, b), max(a, b)]
    square = g[0] * g[0] + g[1] * g[1] + g[2] * g[2]
    size = F.sqrt(square)
    along = sum((g[a] * m(a, b) * g[b] for a in range(3) for b in range(3)), F.lit(0.0))
    cofactor = lambda a, b: m((a + 1) % 3, (b + 1) % 3) * m((a + 2) % 3, (b + 2) % 3) - m((a + 1) % 3, (b + 2) % 3) * m((a + 2) % 3, (b + 1) % 3)
    bulge = sum((g[a] * cofactor(b, a) * g[b] for a in range(3) for b in range(3)), F.lit(0.0))
    ok = size > F.lit(0.1)
    mean = F.when(ok, (along - square * (second[0] + second[1] + second[2])) / (2 * square * size)).otherwise(0.0)
    return F.struct(mean.alias("mean"), F.when(ok, bulge / (square * square)).otherwise(0.0).alias("gauss"), ok.alias("ok"))


STENCIL = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(a) + abs(b) + abs(c) < 3]


def quat_angle(w: Column) -> Column:
    """Rotation angle in degrees from a scalar part."""
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(w))))


def disorientation_angle(p: Column, q: Column, symmetry: Column) -> Column:
    """Smallest angle between two orientations over a symmetry group (an array of quaternions)."""
    best = lambda m: F.array_max(F.transform(symmetry, lambda s: F.abs(m.w * s.w - m.x * s.x - m.y * s.y - m.z * s.z)))
    return quat_angle(let(quat_mul(quat_conj(p), q), best))


def equivalent_diameter(volume: Column) -> Column:
    return F.cbrt(6 * volume / F.lit(3.141592653589793))


def sphericity(volume: Column, area: Column) -> Column:
    return F.cbrt(F.lit(3.141592653589793)) * F.pow(6 * volume, F.lit(2.0 / 3.0)) / area


def family_of_space_group(n: Column) -> Column:
    """Crystal family by the ranges of the international numbers."""
    bounds = [(2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic")]
    out = None
    for top, name in bounds:
        out = F.when(n <= top, name) if out is None else out.when(n <= top, name)
    return out


def rationalize(x: Column, y: Column, z: Column, top: int = 12) -> Column:
    """(hkl, deviation): the integer direction of entries up to `top`, without a common factor, nearest to a direction, and the
    angle to it in degrees. Scales 1 to `top` are tried in turn, and a later one must be nearer by more than 1e-8 degrees or, as
    near, have a smaller largest entry. (0, 0, 0) and null for a zero vector."""
    v = F.array(x, y, z)
    size = F.sqrt(x * x + y * y + z * z)
    biggest = F.nullif(F.greatest(F.abs(x), F.abs(y), F.abs(z)), F.lit(0.0))

    def scaled(k: Column) -> Column:
        ints = F.transform(v, lambda c: F.rint(c / biggest * k).cast("int"))
        return let(ints, lambda n: F.struct(n.alias("n"), _common(n).alias("g")))

    def judged(s: Column) -> Column:
        hkl = F.transform(s.n, lambda c: (c / s.g).cast("int"))

        def angle(n: Column) -> Column:
            dot = F.aggregate(F.zip_with(n, v, lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
            norm = F.sqrt(F.aggregate(n, F.lit(0.0), lambda a, c: a + c * c))
            miss = F.degrees(F.acos(F.least(F.lit(1.0), dot / (norm * size))))
            return F.struct(n.alias("hkl"), miss.alias("deviation"), F.array_max(F.transform(n, lambda c: F.abs(c))).alias("most"))

        return let(hkl, angle)

    tried = F.transform(F.sequence(F.lit(1), F.lit(top)), lambda k: let(scaled(k), judged))

    def better(best: Column, one: Column) -> Column:
        near = one.deviation < best.deviation - F.lit(1e-8)
        same = (F.abs(one.deviation - best.deviation) <= F.lit(1e-8)) & (one.most < best.most)
        return F.when(near | same, one).otherwise(best)

    found = let(tried, lambda t: F.aggregate(F.slice(t, 2, top), F.get(t, F.lit(0)), better))
    none = F.struct(F.array(F.lit(0), F.lit(0), F.lit(0)).alias("hkl"), F.lit(None).cast("double").alias("deviation"))
    return F.when(biggest.isNull(), none).otherwise(let(found, lambda b: F.struct(b.hkl.alias("hkl"), b.deviation.alias("deviation"))))


def _common(n: Column) -> Column:
    """Greatest common divisor of the entries, up to 12."""
    fits = F.filter(F.sequence(F.lit(12), F.lit(1), F.lit(-1)), lambda g: F.forall(n, lambda c: c % g == 0))
    return F.get(fits, F.lit(0))


def normalized(q: Column) -> Column:
    """Of length 1; null for a zero quaternion."""
    size = F.nullif(F.sqrt(q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z), F.lit(0.0))
    return F.when(size.isNotNull(), quat(q.w / size, q.x / size, q.y / size, q.z / size))


def mat_vec(m: tuple[tuple[float, ...], ...], v: list[Column]) -> list[Column]:
    return [F.lit(r[0]) * v[0] + F.lit(r[1]) * v[1] + F.lit(r[2]) * v[2] for r in m]


def plane_indices(n: list[Column], cell: tuple[tuple[float, ...], ...], top: int = 12) -> Column:
    """Plane of a normal in the crystal's frame: components along the lattice vectors (columns of `cell`)."""
    return rationalize(*mat_vec(tuple(zip(*cell, strict=True)), n), top)


def direction_indices(d: list[Column], inverse: tuple[tuple[float, ...], ...], top: int = 12) -> Column:
    """Direction in the crystal's frame, in lattice vectors; `inverse` is the inverse of the cell."""
    return rationalize(*mat_vec(inverse, d), top)


def two_sided(p: Column, q: Column, symmetry: Column) -> Column:
    """(angle, x, y, z): smallest rotation between two orientations over symmetry on both sides and exchange of the two, axis in
    the crystal's frame; of equal angles (to 1e-9 degrees) the first in order of exchange, left and right operation."""

    def all_of(m: Column) -> Column:
        def both(base: Column) -> Column:
            return F.flatten(F.transform(symmetry, lambda a: let(quat_mul(a, base), lambda am: F.transform(symmetry, lambda b: quat_mul(am, b)))))

        return F.concat(both(m), let(quat_conj(m), both))

    turns = let(quat_mul(quat_conj(p), q), all_of)
    best = let(turns, lambda t: let(F.array_max(F.transform(t, lambda m: F.abs(m.w))), lambda w: F.get(F.filter(t, lambda m: F.abs(m.w) >= w - F.lit(1e-12)), F.lit(0))))
    return let(best, axis_angle)
