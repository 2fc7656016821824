"""Queries on orientations and interfaces: axes, Euler angles, coincidence classes, reports, kernels, curvature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import grid, kernel, stats
from . import tables as T
from .registry import DIS, FACES, GRID, IMAGE, QUATS, SYM, VOXELS, _volumes, _voxels, query
from .tables import BOX

# Coincidence labels, their sigma, angle and axis.
CSL = (
    ("3", 3, 60.0, (1, 1, 1)), ("5", 5, 36.87, (1, 0, 0)), ("7", 7, 38.21, (1, 1, 1)), ("9", 9, 38.94, (1, 1, 0)), ("11", 11, 50.48, (1, 1, 0)),
    ("13a", 13, 22.62, (1, 0, 0)), ("13b", 13, 27.8, (1, 1, 1)), ("15", 15, 48.19, (2, 1, 0)), ("17a", 17, 28.07, (1, 0, 0)), ("17b", 17, 61.93, (2, 2, 1)),
    ("19a", 19, 26.53, (1, 1, 0)), ("19b", 19, 46.83, (1, 1, 1)), ("21a", 21, 21.79, (1, 1, 1)), ("21b", 21, 44.42, (2, 1, 1)), ("23", 23, 40.45, (3, 1, 1)),
    ("25a", 25, 16.26, (1, 0, 0)), ("25b", 25, 51.68, (3, 3, 1)), ("27a", 27, 31.59, (1, 1, 0)), ("27b", 27, 35.43, (2, 1, 0)), ("29a", 29, 43.6, (1, 0, 0)),
)
R6 = lambda c, name: F.round(c, 6).alias(name)


@query(
    f"WITH {QUATS}, m AS (SELECT *, 1-2*(y*y+z*z) AS r11, 2*(x*y+w*z) AS r21, 2*(x*z+w*y) AS r13, 2*(y*z-w*x) AS r23, 2*(x*z-w*y) AS r31, 2*(y*z+w*x) AS r32,"
    " 1-2*(x*x+y*y) AS r33 FROM quats), e AS (SELECT grain, degrees(atan2(r13, -r23)) AS a, degrees(acos(greatest(-1.0, least(1.0, r33)))) AS b, degrees(atan2(r31, r32)) AS c FROM m)"
    " SELECT grain, round(a - 360*floor(a/360), 6) AS phi1, round(b, 6) AS tilt, round(c - 360*floor(c/360), 6) AS phi2 FROM e"
)
def euler_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.quats(spark, sf_dir).withColumn("e", G.bunge(F.col("q")))
    return e.select("grain", R6(F.col("e.phi1"), "phi1"), R6(F.col("e.Phi"), "tilt"), R6(F.col("e.phi2"), "phi2"))


@query(
    f"WITH {QUATS}, a AS (SELECT grain, sqrt(x*x+y*y+z*z) AS s, CASE WHEN w < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g, w, x, y, z FROM quats)"
    " SELECT grain, round(g*x/s, 6) AS x, round(g*y/s, 6) AS y, round(g*z/s, 6) AS z, round(degrees(2*acos(least(1.0, abs(w)))), 6) AS angle FROM a"
)
def axis_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.quats(spark, sf_dir).withColumn("a", G.axis_angle(F.col("q")))
    return a.select("grain", *[R6(F.col(f"a.{c}"), c) for c in ("x", "y", "z", "angle")])


@query(
    f"WITH {QUATS}, c AS (SELECT grain, CASE WHEN w < 0 OR (w = 0 AND (x < 0 OR (x = 0 AND (y < 0 OR (y = 0 AND z < 0))))) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s, w, x, y, z FROM quats)"
    " SELECT grain, " + ", ".join(f"round(s*{c}, 6) + 0.0 AS {c}" for c in "wxyz") + " FROM c"
)
def rotation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientations through their matrices and back, then through their Euler angles and back, sign canonical."""
    q = T.quats(spark, sf_dir).withColumn("q", G.let(F.array(*G.quat_matrix(F.col("q"))), lambda r: G.matrix_quat([r[k] for k in range(9)]))).withColumn("e", G.bunge(F.col("q")))
    q = q.withColumn("q", G.from_bunge(F.col("e.phi1"), F.col("e.Phi"), F.col("e.phi2")))
    return q.select("grain", *[(F.round(F.col(f"q.{c}"), 6) + 0.0).alias(c) for c in "wxyz"])


@query(
    f"WITH {QUATS}, t AS (SELECT p.grain AS grain, q.grain AS other, p.w*q.w-p.x*q.x-p.y*q.y-p.z*q.z AS w, p.w*q.x+p.x*q.w+p.y*q.z-p.z*q.y AS x, p.w*q.y-p.x*q.z+p.y*q.w+p.z*q.x AS y,"
    " p.w*q.z+p.x*q.y-p.y*q.x+p.z*q.w AS z FROM quats p JOIN quats q ON q.grain = (p.grain + 1) % 25) SELECT grain, other, " + ", ".join(f"round({c}, 6) AS {c}" for c in "wxyz") + " FROM t"
)
def quaternion_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.quats(spark, sf_dir)
    both = q.select("grain", F.col("q").alias("p"), F.pmod(F.col("grain") + 1, F.lit(25)).alias("other")).join(q.select(F.col("grain").alias("other"), "q"), "other")
    m = both.withColumn("m", G.quat_mul(F.col("p"), F.col("q")))
    return m.select("grain", "other", *[R6(F.col(f"m.{c}"), c) for c in "wxyz"])


def _turn(label: str, angle: float, axis: tuple[int, int, int]) -> tuple[float, ...]:
    import math

    size, half = math.sqrt(sum(c * c for c in axis)), math.radians(angle) / 2
    return (math.cos(half), *[math.sin(half) * c / size for c in axis])


CSL_SQL = "csl(label, sigma, theta, cw, cx, cy, cz) AS (VALUES " + ", ".join(
    f"('{a}', {b}, {t}::DOUBLE, " + ", ".join(f"{c!r}::DOUBLE" for c in _turn(a, t, x)) + ")" for a, b, t, x in CSL
) + ")"


def _sql_mul(out: str, p: str, q: str) -> str:
    """Parts of the product of the quaternions named by format strings p and q ('{}' stands for the part)."""
    a, b = {c: p.format(c) for c in "wxyz"}, {c: q.format(c) for c in "wxyz"}
    parts = {
        "w": f"{a['w']}*{b['w']}-({a['x']})*{b['x']}-({a['y']})*{b['y']}-({a['z']})*{b['z']}",
        "x": f"{a['w']}*{b['x']}+({a['x']})*{b['w']}+({a['y']})*{b['z']}-({a['z']})*{b['y']}",
        "y": f"{a['w']}*{b['y']}-({a['x']})*{b['z']}+({a['y']})*{b['w']}+({a['z']})*{b['x']}",
        "z": f"{a['w']}*{b['z']}+({a['x']})*{b['y']}-({a['y']})*{b['x']}+({a['z']})*{b['w']}",
    }
    return ", ".join(f"{v} AS {out}{k}" for k, v in parts.items())


CLASSES = (
    f"{DIS}, {CSL_SQL}, near AS (SELECT m.*, csl.* FROM m JOIN dis USING (grain_i, grain_j) JOIN csl ON abs(angle-theta) <= 15/sqrt(sigma)),"
    " base AS (SELECT grain_i, grain_j, label, sigma, cw, cx, cy, cz, w AS bw, x AS bx, y AS by_, z AS bz FROM near UNION ALL SELECT grain_i, grain_j, label, sigma, cw, cx, cy, cz, w, -x, -y, -z FROM near),"
    " l1 AS (SELECT grain_i, grain_j, label, sigma, bw, bx, by_, bz, cw*sw+cx*sx+cy*sy+cz*sz AS lw, cw*sx-cx*sw-cy*sz+cz*sy AS lx, cw*sy+cx*sz-cy*sw-cz*sx AS ly, cw*sz-cx*sy+cy*sx-cz*sw AS lz FROM base, sym),"
    " l2 AS (SELECT grain_i, grain_j, label, sigma, lw*bw-lx*bx-ly*by_-lz*bz AS vw, lw*bx+lx*bw+ly*bz-lz*by_ AS vx, lw*by_-lx*bz+ly*bw+lz*bx AS vy, lw*bz+lx*by_-ly*bx+lz*bw AS vz FROM l1),"
    " dev AS (SELECT grain_i, grain_j, label, sigma, degrees(2*acos(least(1.0, max(abs(vw*sw-vx*sx-vy*sy-vz*sz))))) AS dev FROM l2, sym GROUP BY 1, 2, 3, 4),"
    " hit AS (SELECT grain_i, grain_j, label, row_number() OVER (PARTITION BY grain_i, grain_j ORDER BY sigma, label) AS n FROM dev WHERE dev <= 15/sqrt(sigma))"
)


def _csl(p: Column, q: Column) -> Column:
    """Label of the smallest sigma whose class lies within Brandon's tolerance of the misorientation, or ''."""
    sym = T.cubic_symmetry()
    rows = [F.struct(F.lit(b).alias("sigma"), F.lit(a).alias("label"), F.lit(t).alias("theta"), G.quat(*[F.lit(c) for c in _turn(a, t, x)]).alias("c")) for a, b, t, x in CSL]
    near = F.filter(F.array(*rows), lambda s: F.abs(F.col("angle") - s.theta) <= 15 / F.sqrt(s.sigma))
    hit = lambda m: F.filter(near, lambda s: G.class_deviation(s.c, m, sym) <= 15 / F.sqrt(s.sigma))
    best = lambda m: F.array_min(F.transform(hit(m), lambda s: F.struct(s.sigma.alias("sigma"), s.label.alias("label"))))
    return F.coalesce(G.let(G.quat_mul(G.quat_conj(p), q), best).label, F.lit(""))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = T.quats(spark, sf_dir), T.quats(spark, sf_dir)
    both = p.select(F.col("grain").alias("grain_i"), F.col("q").alias("p")).join(q.select(F.col("grain").alias("grain_j"), "q"), F.expr("grain_i < grain_j"))
    return both.withColumn("angle", G.disorientation_angle(F.col("p"), F.col("q"), T.cubic_symmetry()))


@query(f"{CLASSES} SELECT dis.grain_i, dis.grain_j, coalesce(label, '') AS csl FROM dis LEFT JOIN hit ON hit.grain_i=dis.grain_i AND hit.grain_j=dis.grain_j AND n=1")
def coincidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest sigma by the deviation of whole classes: symmetry on both sides and exchange."""
    return _pairs(spark, sf_dir).select("grain_i", "grain_j", _csl(F.col("p"), F.col("q")).alias("csl"))


NORMALS = (
    f"sf AS (SELECT axis, least(v.grain, u.grain) AS grain_i, greatest(v.grain, u.grain) AS grain_j, CASE WHEN v.grain < u.grain THEN 1 ELSE -1 END AS sign FROM voxels v"
    " CROSS JOIN (VALUES ('i',1,0,0),('j',0,1,0),('k',0,0,1)) s(axis,di,dj,dk)"
    f" JOIN voxels u ON u.i=(v.i+di)%{GRID} AND u.j=(v.j+dj)%{GRID} AND u.k=(v.k+dk)%{GRID} WHERE v.grain<>u.grain),"
    " net AS (SELECT grain_i, grain_j, count(*) AS n, " + ", ".join(f"sum(CASE WHEN axis='{a}' THEN sign ELSE 0 END)::DOUBLE AS s{a}" for a in "ijk") + " FROM sf GROUP BY 1, 2),"
    " dir AS (SELECT *, CASE WHEN sqrt(si*si+sj*sj+sk*sk)/n >= 1e-6 THEN sqrt(si*si+sj*sj+sk*sk) END AS size FROM net),"
    " nrm AS (SELECT d.grain_i, d.grain_j, n*1.5625::DOUBLE AS area, si/size AS nx, sj/size AS ny, sk/size AS nz, coalesce(sqrt(sum(power(degrees(acos(greatest(-1.0, least(1.0,"
    " sign*(CASE axis WHEN 'i' THEN si WHEN 'j' THEN sj ELSE sk END)/size)))), 2))/n), 90.0) AS spread FROM dir d JOIN sf USING (grain_i, grain_j) GROUP BY d.grain_i, d.grain_j, n, si, sj, sk, size)"
)


@query(f"WITH {VOXELS}, {NORMALS} SELECT grain_i, grain_j, round(area, 6) AS area, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(spread, 5) AS spread FROM nrm")
def interface_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.normals(_voxels(spark, sf_dir), GRID, 1.5625)
    return found.select("grain_i", "grain_j", *[R6(F.col(c), c) for c in ("area", "nx", "ny", "nz")], F.round("spread", 5).alias("spread"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per interface: geometry, misorientation (null across phases), character, coincidence label, phases."""
    s = T.seeds(spark, sf_dir)
    side = lambda k: s.select(F.col("grain").alias(f"grain_{k}"), F.col("phase").alias(f"phase_{k}"), *[F.col(f"s{c}").alias(f"{c}{k}") for c in "xyz"])
    both = grid.normals(_voxels(spark, sf_dir), GRID, 1.5625).join(_pairs(spark, sf_dir), ["grain_i", "grain_j"]).join(side("i"), "grain_i").join(side("j"), "grain_j")
    same, flat = F.col("phase_i") == F.col("phase_j"), F.col("nx").isNull()
    both = both.withColumn("axis", G.lab_axis(F.col("p"), F.col("q"), T.cubic_symmetry()))
    cosine = F.abs(F.col("axis.x") * F.col("nx") + F.col("axis.y") * F.col("ny") + F.col("axis.z") * F.col("nz"))
    both = both.withColumn("psi", F.when(same & ~flat & (F.col("angle") >= G.IDENTITY), F.degrees(F.acos(F.least(F.lit(1.0), cosine)))))
    kind = F.when(flat, "undefined").when(~same, "interphase").when(F.col("psi").isNull(), "undefined").when(F.col("psi") < 15, "twist").when(F.col("psi") > 75, "tilt").otherwise("mixed")
    apart = F.sqrt(G.square_distance(*[G.min_image(F.col(f"{c}j") - F.col(f"{c}i"), BOX) for c in "xyz"]))
    return both.select(
        "grain_i", "grain_j", apart.alias("seed_distance"), F.when(same, F.col("angle")).alias("misorientation"), "area", "nx", "ny", "nz", "spread",
        kind.alias("character"), "psi", F.when(same, _csl(F.col("p"), F.col("q"))).otherwise("").alias("csl"), "phase_i", "phase_j",
    )


# The lab rotation q s conj(p), by its largest scalar part.
REPORT = (
    f"{CLASSES}, {VOXELS}, {NORMALS}, t1 AS (SELECT a.grain AS grain_i, b.grain AS grain_j, a.w AS pw, a.x AS px, a.y AS py, a.z AS pz, "
    + _sql_mul("t", "b.{}", "s{}") + " FROM quats a JOIN quats b ON a.grain < b.grain, sym),"
    " t2 AS (SELECT grain_i, grain_j, tw*pw+tx*px+ty*py+tz*pz AS w, -tw*px+tx*pw-ty*pz+tz*py AS x, -tw*py+tx*pz+ty*pw-tz*px AS y, -tw*pz-tx*py+ty*px+tz*pw AS z FROM t1),"
    " ax AS (SELECT grain_i, grain_j, arg_max(x/sqrt(x*x+y*y+z*z), abs(w)) AS x, arg_max(y/sqrt(x*x+y*y+z*z), abs(w)) AS y, arg_max(z/sqrt(x*x+y*y+z*z), abs(w)) AS z FROM t2 GROUP BY 1, 2),"
    " rep AS (SELECT nrm.*, angle, coalesce(label, '') AS label, u.phase AS phase_i, v.phase AS phase_j, sqrt(" + " + ".join("power({}, 2)".format(IMAGE.format(f"(v.s{c} - u.s{c})")) for c in "xyz") + ") AS seed_distance,"
    " CASE WHEN u.phase = v.phase THEN degrees(acos(least(1.0, abs(ax.x*nx+ax.y*ny+ax.z*nz)))) END AS psi FROM nrm JOIN dis USING (grain_i, grain_j) JOIN ax USING (grain_i, grain_j)"
    " LEFT JOIN hit ON hit.grain_i=nrm.grain_i AND hit.grain_j=nrm.grain_j AND hit.n=1 JOIN seeds u ON u.grain=nrm.grain_i JOIN seeds v ON v.grain=nrm.grain_j),"
    " report AS (SELECT grain_i, grain_j, seed_distance, CASE WHEN phase_i=phase_j THEN angle END AS misorientation, area, nx, ny, nz, spread, CASE WHEN nx IS NULL THEN 'undefined'"
    " WHEN phase_i<>phase_j THEN 'interphase' WHEN psi IS NULL THEN 'undefined' WHEN psi < 15 THEN 'twist' WHEN psi > 75 THEN 'tilt' ELSE 'mixed' END AS character, psi,"
    " CASE WHEN phase_i=phase_j THEN label ELSE '' END AS csl, phase_i, phase_j FROM rep)"
)


@query(
    f"{REPORT} SELECT grain_i, grain_j, round(seed_distance, 6) AS seed_distance, round(misorientation, 6) AS misorientation, round(area, 6) AS area, round(nx, 6) AS nx, round(ny, 6) AS ny,"
    " round(nz, 6) AS nz, round(spread, 5) AS spread, character, round(psi, 5) AS psi, csl, phase_i, phase_j FROM report"
)
def boundary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _report(spark, sf_dir)
    digits = {"seed_distance": 6, "misorientation": 6, "area": 6, "nx": 6, "ny": 6, "nz": 6, "spread": 5, "psi": 5}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


@query(
    f"{REPORT}, k(character) AS (VALUES ('twist'), ('tilt'), ('mixed'), ('undefined'), ('interphase')) SELECT k.character, count(r.grain_i) AS n, round(coalesce(sum(r.area), 0)/(SELECT sum(area) FROM report), 6)"
    " AS area_fraction FROM k LEFT JOIN report r ON r.character=k.character GROUP BY 1"
)
def character_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and share of area of each character, those without an interface included."""
    kinds = ("twist", "tilt", "mixed", "undefined", "interphase")
    sums = [x for k in kinds for x in (F.count_if(F.col("character") == k).alias(f"n_{k}"), F.sum(F.when(F.col("character") == k, F.col("area")).otherwise(0.0)).alias(f"a_{k}"))]
    one = _report(spark, sf_dir).agg(F.sum("area").alias("t"), *sums)
    rows = F.array(*[F.struct(F.lit(k).alias("character"), F.col(f"n_{k}").alias("n"), F.round(F.col(f"a_{k}") / F.col("t"), 6).alias("area_fraction")) for k in kinds])
    return one.select(F.inline(rows))


SPHERICITY = "cbrt(pi())*power(6*volume, 2.0/3.0)/surface"
_SHAPE = (
    f"WITH {VOXELS}, {FACES}, vol AS (SELECT seeds.grain, phase, count(v.i)*1.953125::DOUBLE AS volume FROM seeds LEFT JOIN voxels v ON v.grain=seeds.grain GROUP BY 1, 2),"
    " sur AS (SELECT g AS grain, count(*)*1.5625::DOUBLE AS surface FROM (SELECT grain_i AS g FROM faces UNION ALL SELECT grain_j FROM faces) GROUP BY 1),"
    " deg AS (SELECT g AS grain, count(*) AS n_neighbors FROM (SELECT DISTINCT grain_i AS g, grain_j AS o FROM faces UNION SELECT DISTINCT grain_j, grain_i FROM faces) GROUP BY 1)"
)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = _voxels(spark, sf_dir)
    edges = grid.faces(voxels, GRID).select("grain_i", "grain_j").distinct()
    degree = edges.select(F.explode(F.array("grain_i", "grain_j")).alias("grain")).groupBy("grain").agg(F.count("*").alias("n_neighbors"))
    out = _volumes(spark, sf_dir).join(grid.surface(voxels, GRID, 1.5625), "grain", "left").join(degree, "grain", "left")
    return out.withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)))


@query(
    f"{_SHAPE}, {QUATS} SELECT vol.grain, phase, round(volume, 6) AS volume, round(volume/(SELECT sum(volume) FROM vol), 6) AS fraction, coalesce(n_neighbors, 0) AS n_neighbors,"
    f" round(surface, 6) AS surface, round(cbrt(6*volume/pi()), 6) AS diameter, round({SPHERICITY}, 6) AS sphericity, round(degrees(2*acos(least(1.0, abs(w)))), 6) AS angle"
    " FROM vol LEFT JOIN sur USING (grain) LEFT JOIN deg USING (grain) JOIN quats USING (grain)"
)
def grain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _shapes(spark, sf_dir)
    total = F.broadcast(shapes.agg(F.sum("volume").alias("t")))
    out = shapes.crossJoin(total).join(T.quats(spark, sf_dir), "grain")
    v, a = F.col("volume"), F.col("surface")
    return out.select(
        "grain", "phase", R6(v, "volume"), R6(v / F.col("t"), "fraction"), "n_neighbors", R6(a, "surface"), R6(G.equivalent_diameter(v), "diameter"),
        R6(G.sphericity(v, a), "sphericity"), R6(G.quat_angle(F.col("q.w")), "angle"),
    )


@query(f"{_SHAPE} SELECT concat('n_grains_with_', coalesce(n_neighbors, 0), '_faces') AS key, count(*) AS n FROM vol LEFT JOIN deg USING (grain) GROUP BY 1")
def topology_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("n_grains_with_"), F.col("n_neighbors").cast("string"), F.lit("_faces"))
    return _shapes(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


HALF = 20.0


@query(
    f"WITH {QUATS}, {SYM}, g AS (SELECT p.grain AS grain_i, q.grain AS grain_j, avg(power(abs((p.w*q.w+p.x*q.x+p.y*q.y+p.z*q.z)*sw-(p.w*q.x-p.x*q.w-p.y*q.z+p.z*q.y)*sx"
    f"-(p.w*q.y+p.x*q.z-p.y*q.w-p.z*q.x)*sy-(p.w*q.z-p.x*q.y+p.y*q.x-p.z*q.w)*sz), {2 * kernel.degree(HALF)}))*{kernel.norm(kernel.degree(HALF))!r}::DOUBLE AS k FROM quats p, quats q, sym GROUP BY 1, 2)"
    " SELECT grain_i, grain_j, round(k, 6) AS k FROM g"
)
def orientation_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De la Vallee Poussin kernel between all orientations, averaged over the symmetry group."""
    return kernel.gram(T.quats(spark, sf_dir), T.cubic_symmetry(), HALF).select("grain_i", "grain_j", R6(F.col("k"), "k"))


@query(
    f"WITH {VOXELS}, {QUATS}, {SYM}, vol AS (SELECT seeds.grain, count(v.i)::DOUBLE AS n FROM seeds LEFT JOIN voxels v ON v.grain=seeds.grain GROUP BY 1),"
    " d AS (SELECT grain, n/(SELECT sum(n) FROM vol) - 1.0::DOUBLE/(SELECT count(*) FROM vol) AS d FROM vol),"
    " g AS (SELECT p.grain AS grain_i, q.grain AS grain_j, avg(power(abs((p.w*q.w+p.x*q.x+p.y*q.y+p.z*q.z)*sw-(p.w*q.x-p.x*q.w-p.y*q.z+p.z*q.y)*sx"
    f"-(p.w*q.y+p.x*q.z-p.y*q.w-p.z*q.x)*sy-(p.w*q.z-p.x*q.y+p.y*q.x-p.z*q.w)*sz), {2 * kernel.degree(HALF)}))*{kernel.norm(kernel.degree(HALF))!r}::DOUBLE AS k FROM quats p, quats q, sym GROUP BY 1, 2)"
    " SELECT round(sqrt(greatest(sum(a.d*k*b.d), 0.0)), 6) AS mmd FROM g JOIN d a ON a.grain=grain_i JOIN d b ON b.grain=grain_j"
)
def kernel_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrepancy between volume weights and equal weights of the orientations."""
    v = _volumes(spark, sf_dir)
    total = F.broadcast(v.agg(F.sum("volume").alias("t"), F.count("*").alias("n")))
    d = v.crossJoin(total).select("grain", (F.col("volume") / F.col("t") - 1 / F.col("n")).alias("d"))
    return kernel.discrepancy(d, kernel.gram(T.quats(spark, sf_dir), T.cubic_symmetry(), HALF)).select(R6(F.col("mmd"), "mmd"))


@query()
def discrepancy_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the discrepancy when the same volumes are dealt to the orientations at random, 256 times."""
    v = _volumes(spark, sf_dir).select("grain", F.col("volume").alias("v"))
    return kernel.null_discrepancy(v, kernel.gram(T.quats(spark, sf_dir), T.cubic_symmetry(), HALF), 256)


@query(
    f"{REPORT} SELECT round(sum(CASE WHEN csl='3' THEN area ELSE 0 END)/sum(area), 6) AS sigma3_class, round(sum(CASE WHEN abs(misorientation-60) <= 15/sqrt(3) THEN area ELSE 0 END)/sum(area), 6) AS sigma3_window,"
    " round(sum(misorientation*area)/sum(CASE WHEN misorientation IS NOT NULL THEN area END), 6) AS mean_angle FROM report"
)
def sigma3_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of area in the angle window of sigma 3 beside the share of its true class."""
    area, mis = F.col("area"), F.col("misorientation")
    part = lambda c: F.sum(F.when(c, area).otherwise(0.0)) / F.sum(area)
    return _report(spark, sf_dir).agg(
        R6(part(F.col("csl") == "3"), "sigma3_class"), R6(part(F.abs(mis - 60) <= 15 / F.sqrt(F.lit(3.0))), "sigma3_window"),
        R6(F.sum(mis * area) / F.sum(F.when(mis.isNotNull(), area)), "mean_angle"),
    )


_FIT = (
    f"WITH {VOXELS}, vol AS (SELECT grain, count(*)*1.953125::DOUBLE AS volume FROM voxels GROUP BY 1), l AS (SELECT ln(cbrt(6*volume/pi())) AS x FROM vol),"
    " f AS (SELECT avg(x) AS mu, stddev_samp(x) AS sigma, count(*) AS n FROM l), r AS (SELECT x, mu, sigma, n, row_number() OVER (ORDER BY x) AS k FROM l, f),"
    " t AS (SELECT *, (x-mu)/sigma/sqrt(2.0::DOUBLE) AS u, 1/(1+0.3275911::DOUBLE*abs((x-mu)/sigma/sqrt(2.0::DOUBLE))) AS t FROM r),"
    " c AS (SELECT *, 0.5*(1+sign(u)*(1-t*(0.254829592::DOUBLE+t*(-0.284496736::DOUBLE+t*(1.421413741::DOUBLE+t*(-1.453152027::DOUBLE+t*1.061405429::DOUBLE))))*exp(-u*u))) AS cdf FROM t)"
)


@query(f"{_FIT} SELECT round(any_value(mu), 6) AS mu, round(any_value(sigma), 6) AS sigma, round(max(greatest(k/n::DOUBLE-cdf, cdf-(k-1)/n::DOUBLE)), 6) AS ks FROM c")
def lognormal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of the diameters and the Kolmogorov-Smirnov distance to it."""
    d = _volumes(spark, sf_dir).where("volume > 0").select(F.log(G.equivalent_diameter(F.col("volume"))).alias("x"))
    return stats.lognormal_distance(d).select(R6(F.col("mu"), "mu"), R6(F.col("sigma"), "sigma"), R6(F.col("ks"), "ks"))


@query()
def interface_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted curvatures of interfaces of additive cells, from 19 margins round the middle of each face."""
    return _curvature(spark, sf_dir).groupBy("grain_i", "grain_j").agg(*_weighted())


def _weighted() -> list[Column]:
    ok, area = F.col("c.ok"), F.lit(1.5625)
    n = F.count_if(ok)
    mean = lambda c: F.when(n > 0, F.sum(F.when(ok, c)) / n)
    out = [(F.count("*") * area).alias("area"), n.alias("n_samples"), (F.count("*") - n).alias("n_dropped"), R6(mean(F.col("c.mean")), "h_mean"), R6(mean(F.abs("c.mean")), "h_abs_mean")]
    return [*out, R6(F.stddev_pop(F.when(ok, F.col("c.mean"))), "h_std"), R6(mean(F.col("c.gauss")), "k_mean"), R6(F.stddev_pop(F.when(ok, F.col("c.gauss"))), "k_std")]


def _curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, s = BOX / GRID, T.seeds(spark, sf_dir)
    at = {c: (F.col(a) + 0.5 + F.when(F.col("axis") == a, 0.5).otherwise(0.0)) * h for a, c in zip("ijk", "xyz", strict=True)}
    side = lambda k: s.select(F.col("grain").alias(f"grain_{k}"), F.col("w").alias(f"w{k}"), *[F.col(f"s{c}").alias(f"{c}{k}") for c in "xyz"])
    from ..operators import assign as A

    voxels = A.assign(grid.centers(spark, GRID, BOX), s, BOX, A.additive).select("i", "j", "k", "grain")
    rows = grid.faces(voxels, GRID).select("grain_i", "grain_j", *[c.alias(n) for n, c in at.items()]).join(F.broadcast(side("i")), "grain_i").join(F.broadcast(side("j")), "grain_j")

    def gap(off: tuple[int, int, int]) -> Column:
        d = {k: F.sqrt(G.square_distance(*[G.min_image(F.col(c) + o * h - F.col(f"{c}{k}"), BOX) for c, o in zip("xyz", off, strict=True)])) - F.col(f"w{k}") for k in "ij"}
        return (d["j"] - d["i"]) / 2

    # The stencil is one array, so that each margin is an expression of its own and not repeated in the formulas.
    rows = rows.withColumn("phi", F.array(*[gap(off) for off in G.STENCIL]))
    return rows.select("grain_i", "grain_j", G.curvature({off: F.col("phi")[n] for n, off in enumerate(G.STENCIL)}, h).alias("c"))


@query()
def gauss_bonnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of Gauss curvature over the surface of each grain, every face counted for both of its grains."""
    one = _curvature(spark, sf_dir).select(F.explode(F.array("grain_i", "grain_j")).alias("grain"), "c")
    return one.groupBy("grain").agg(R6(F.sum(F.col("c.gauss") * F.lit(1.5625)), "total"), F.count_if("c.ok").alias("n_samples"))
