"""Queries on orientation sets, images of points, imported fields, and the table of quality gates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import assign as A
from ..operators import graph, grid, replicas, stats, texture
from . import tables as T
from .registry import _BUCKETS, _VOL, EUCLID, FACES, GRID, IMAGE, MIS, ORACLE, QUATS, QUERIES, SEEDS, SYM, VOXELS, _disorientations, _volumes, _voxels, query
from .tables import BOX

R6 = lambda c, name: F.round(c, 6).alias(name)
BINS, WIDTH, REFERENCE = 32, 2.0, 3989

# --- Misorientations ---------------------------------------------------------------------------------------

_EDGES = f"a AS (SELECT grain_i, grain_j, count(*)*1.5625::DOUBLE AS area FROM faces GROUP BY 1, 2), e AS (SELECT m.*, area FROM m JOIN a USING (grain_i, grain_j))"
_TWO = (
    f"WITH {VOXELS}, {FACES}, {QUATS}, {SYM}, {MIS}, {_EDGES}, b0 AS (SELECT grain_i, grain_j, w, x, y, z FROM e UNION ALL SELECT grain_i, grain_j, w, -x, -y, -z FROM e),"
    " l AS (SELECT grain_i, grain_j, sw*w-sx*x-sy*y-sz*z AS w, sw*x+sx*w+sy*z-sz*y AS x, sw*y-sx*z+sy*w+sz*x AS y, sw*z+sx*y-sy*x+sz*w AS z FROM b0, sym),"
    " r AS (SELECT grain_i, grain_j, abs(w*sw-x*sx-y*sy-z*sz) AS c FROM l, sym), t AS (SELECT grain_i, grain_j, max(c) AS c FROM r GROUP BY 1, 2)"
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.areas(_voxels(spark, sf_dir), GRID, 1.5625)


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces with both orientations (p, q)."""
    q = T.quats(spark, sf_dir)
    side = lambda k, n: q.select(F.col("grain").alias(f"grain_{k}"), F.col("q").alias(n))
    return _edges(spark, sf_dir).join(side("i", "p"), "grain_i").join(side("j", "q"), "grain_j")


@query(f"{_TWO} SELECT grain_i, grain_j, round(degrees(2*acos(least(1.0, c))), 5) AS angle, round(1.0::DOUBLE, 5) AS axis_size FROM t")
def two_sided_disorientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest rotation over symmetry on both sides and exchange, of each interface; its axis is a unit vector."""
    found = _oriented(spark, sf_dir).select("grain_i", "grain_j", G.two_sided(F.col("p"), F.col("q"), T.cubic_symmetry()).alias("t"))
    size = F.sqrt(F.col("t.x") * F.col("t.x") + F.col("t.y") * F.col("t.y") + F.col("t.z") * F.col("t.z"))
    return found.select("grain_i", "grain_j", F.round("t.angle", 5).alias("angle"), F.round(size, 5).alias("axis_size"))


@query()
def boundary_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis of each interface's misorientation as integers, and the planes of its mean normal in both crystals, with deviations."""
    both = _oriented(spark, sf_dir).join(grid.normals(_voxels(spark, sf_dir), GRID, 1.5625).select("grain_i", "grain_j", "nx", "ny", "nz"), ["grain_i", "grain_j"])
    both = both.withColumn("t", G.two_sided(F.col("p"), F.col("q"), T.cubic_symmetry()))
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    unit = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    plane = lambda k: F.when(F.col("nx").isNotNull(), G.plane_indices(G.rotate_back(F.col(k), *n), unit))
    both = both.withColumn("uvw", G.rationalize(F.col("t.x"), F.col("t.y"), F.col("t.z"))).withColumn("hi", plane("p")).withColumn("hj", plane("q"))
    told = lambda c, name: [F.array_join(F.col(f"{c}.hkl").cast("array<string>"), " ").alias(name), F.round(f"{c}.deviation", 4).alias(f"{name}_deviation")]
    return both.select("grain_i", "grain_j", *told("uvw", "axis"), *told("hi", "plane_i"), *told("hj", "plane_j"))


_LATTICE = tuple(0.8191725133961645 if k == 0 else 0.6710436067037893 if k == 1 else 0.5497004779019703 for k in range(3))
_REF = (
    "u AS (SELECT id, " + ", ".join(f"id*{s}::DOUBLE - floor(id*{s}::DOUBLE) AS u{k}" for k, s in enumerate(_LATTICE, 1)) + f" FROM range({REFERENCE}) r(id)),"
    " rq AS (SELECT id, sqrt(u1)*cos(2*pi()*u3) AS w, sqrt(1-u1)*sin(2*pi()*u2) AS x, sqrt(1-u1)*cos(2*pi()*u2) AS y, sqrt(u1)*sin(2*pi()*u3) AS z FROM u),"
    " ra AS (SELECT id, degrees(2*acos(least(1.0, max(abs(w*sw-x*sx-y*sy-z*sz))))) AS angle FROM rq, sym GROUP BY id),"
    f" rh AS (SELECT greatest(least(floor(angle/{WIDTH})::INT, {BINS - 1}), 0) AS bin, count(*)/{REFERENCE}.0::DOUBLE AS m FROM ra GROUP BY 1)"
)


def _reference(spark: SparkSession) -> DataFrame:
    angles = texture.reference_angles(spark, T.cubic_symmetry(), REFERENCE)
    return stats.masses(angles, stats.clipped_bin(F.col("angle"), 0.0, WIDTH, BINS), F.lit(1.0), BINS)


_TOP = 63.0
_LOW, _HIGH = 60 - 15 / math.sqrt(3), min(60 + 15 / math.sqrt(3), _TOP)


@query(
    f"WITH {VOXELS}, {FACES}, {QUATS}, {SYM}, {MIS}, {_EDGES}, an AS (SELECT grain_i, grain_j, any_value(area) AS area, degrees(2*acos(least(1.0, max(abs(w*sw-x*sx-y*sy-z*sz))))) AS angle FROM e, sym GROUP BY 1, 2),"
    f" h AS (SELECT greatest(least(floor(angle/{WIDTH})::INT, {BINS - 1}), 0) AS bin, sum(area) AS a, count(*)::DOUBLE AS n FROM an GROUP BY 1), {_REF}"
    f" SELECT s.bin::INT AS bin, (s.bin+0.5)*{WIDTH}::DOUBLE AS bin_center, round(coalesce(a, 0)/(SELECT sum(a) FROM h)/{WIDTH}, 6) AS area_weighted_density,"
    f" round(coalesce(n, 0)/(SELECT sum(n) FROM h)/{WIDTH}, 6) AS number_density, round(coalesce(m, 0)/{WIDTH}, 6) AS reference_density,"
    f" round((0.7::DOUBLE*coalesce(m, 0) + 0.3::DOUBLE/{_HIGH - _LOW!r}::DOUBLE*greatest(0.0, least((s.bin+1)*{WIDTH}::DOUBLE, {_HIGH!r}::DOUBLE) - greatest(s.bin*{WIDTH}::DOUBLE, {_LOW!r}::DOUBLE)))/{WIDTH}, 6) AS target_density"
    f" FROM range({BINS}) s(bin) LEFT JOIN h ON h.bin=s.bin LEFT JOIN rh ON rh.bin=s.bin"
)
def misorientation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of disorientations by area and by number, of the uniform reference, and of a target rich in twins."""
    found = _disorientations(spark, sf_dir, _edges(spark, sf_dir))
    at = stats.clipped_bin(F.col("angle"), 0.0, WIDTH, BINS)
    area, number = stats.masses(found, at, F.col("area"), BINS), stats.masses(found, at, F.lit(1.0), BINS)
    ref = _reference(spark)
    target = texture.enriched(ref, 0.3, WIDTH, _TOP)
    out = area.withColumnRenamed("mass", "a").join(number.withColumnRenamed("mass", "n"), "bin").join(ref.withColumnRenamed("mass", "r"), "bin").join(target.withColumnRenamed("mass", "t"), "bin")
    density = lambda c, name: R6(F.col(c) / F.lit(WIDTH), name)
    return out.select("bin", ((F.col("bin") + 0.5) * F.lit(WIDTH)).alias("bin_center"), density("a", "area_weighted_density"), density("n", "number_density"), density("r", "reference_density"), density("t", "target_density"))


@query("SELECT 'distribution_nears_target' AS gate, true AS passed")
def annealed_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swapping orientations lessens the distance to the target distribution, and takes each orientation once."""
    target = np.array([r.mass for r in texture.enriched(_reference(spark), 0.3, WIDTH, _TOP).orderBy("bin").collect()])
    order, first, best = texture.anneal(_edges(spark, sf_dir), T.quats(spark, sf_dir), np.array(T.cubic_group()), target, WIDTH, steps=600)
    ok = best <= first and sorted(order.values()) == sorted(order)
    return spark.createDataFrame([("distribution_nears_target", bool(ok))], "gate string, passed boolean")


# --- Classes and components --------------------------------------------------------------------------------

_CANON = "cq AS (SELECT grain, " + ", ".join(f"round(CASE WHEN w < 0 OR (w = 0 AND (x < 0 OR (x = 0 AND (y < 0 OR (y = 0 AND z < 0))))) THEN -{c} ELSE {c} END, 1) AS {c}" for c in "wxyz") + " FROM quats)"


@query(f"WITH {QUATS}, {_CANON} SELECT grain, (dense_rank() OVER (ORDER BY w, x, y, z) - 1)::INT AS class FROM cq")
def exact_orientation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of equal orientations (here after rounding to one digit, so that some are equal)."""
    return texture.exact_classes(T.quats(spark, sf_dir), 1).select("grain", F.col("class").cast("int").alias("class"))


@query(f"{_VOL}, {QUATS}, {_CANON}, cl AS (SELECT grain, (dense_rank() OVER (ORDER BY w, x, y, z) - 1)::INT AS class FROM cq) SELECT class, round(sum(volume)/(SELECT sum(volume) FROM vol), 6) AS mass FROM vol JOIN cl USING (grain) GROUP BY 1")
def orientation_class_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = texture.exact_classes(T.quats(spark, sf_dir), 1).select("grain", F.col("class").cast("int").alias("class"))
    return texture.class_masses(_volumes(spark, sf_dir).select("grain", "volume"), of).select("class", R6(F.col("mass"), "mass"))


_PARTS = (("fibre", 0.5), ("cube", 0.3), ("random", 0.2))


@query(
    "WITH RECURSIVE c AS (SELECT n_nationkey::INT AS grain, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation), n AS (SELECT count(*)::DOUBLE AS n FROM c),"
    " s(k, l0, l1, l2, part, grain) AS (SELECT 0::BIGINT, n*0.5::DOUBLE, n*0.3::DOUBLE, n*0.2::DOUBLE, -1, -1 FROM n UNION ALL SELECT c.k, CASE WHEN b=0 THEN l0-1 ELSE l0 END,"
    " CASE WHEN b=1 THEN l1-1 ELSE l1 END, CASE WHEN b=2 THEN l2-1 ELSE l2 END, b, c.grain FROM s JOIN c ON c.k=s.k+1, LATERAL (SELECT CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS b))"
    " SELECT part AS component, count(*) AS n FROM s WHERE part >= 0 GROUP BY 1"
)
def texture_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grains by component when three components get their shares of the number of grains."""
    unit = [tuple(map(float, q)) for q in (texture.between((1, 1, 1), (0, 0, 1)), (1, 0, 0, 0))]
    center = [G.quat(*[F.lit(c) for c in q]) for q in unit]
    parts = [("fibre", 0.5, center[0], 0.1), ("cube", 0.3, center[1], 0.2), ("random", 0.2, None, 0.0)]
    grains = T.seeds(spark, sf_dir).select("grain", F.lit(1.0).alias("volume"))
    found = texture.components(grains, parts).where(F.abs(F.sqrt(F.col("q.w") ** 2 + F.col("q.x") ** 2 + F.col("q.y") ** 2 + F.col("q.z") ** 2) - 1) < 1e-9)
    return found.groupBy("component").agg(F.count("*").alias("n"))


ORACLE["orientation_classes"] = (
    f"WITH RECURSIVE {QUATS}, {SYM}, {MIS}, nr AS (SELECT grain_i AS a, grain_j AS b FROM m, sym GROUP BY 1, 2 HAVING degrees(2*acos(least(1.0, max(abs(w*sw-x*sx-y*sy-z*sz))))) <= 12),"
    " ed AS (SELECT a, b FROM nr UNION SELECT b, a FROM nr), r AS (SELECT grain, grain AS root FROM quats UNION SELECT ed.b, r.root FROM r JOIN ed ON ed.a=r.grain)"
    " SELECT grain, min(root) AS component FROM r GROUP BY 1"
)
ORACLE["overlap_removal"] = (
    f"{_BUCKETS.replace('WITH ', 'WITH RECURSIVE ')}, l AS MATERIALIZED (SELECT i, j, row_number() OVER (ORDER BY i, j) AS k FROM p WHERE {EUCLID} <= 0.25),"
    " s(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT l.k, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, j) END FROM s JOIN l ON l.k=s.k+1)"
    " SELECT unnest(gone) AS id FROM (SELECT gone FROM s ORDER BY k DESC LIMIT 1)"
)
ORACLE["interstitial_sites"] = (
    f"{_BUCKETS.replace('WITH ', 'WITH RECURSIVE ')}, n AS (SELECT i AS id FROM p WHERE {EUCLID} < 0.25 AND j % 2 = 0 AND i % 2 = 1 UNION SELECT j FROM p WHERE {EUCLID} < 0.25 AND i % 2 = 0 AND j % 2 = 1),"
    " fr AS (SELECT id FROM pts WHERE id % 2 = 1 AND id NOT IN (SELECT id FROM n)),"
    f" l AS MATERIALIZED (SELECT i, j, row_number() OVER (ORDER BY i, j) AS k FROM p WHERE {EUCLID} < 0.25 AND i IN (SELECT id FROM fr) AND j IN (SELECT id FROM fr)),"
    " s(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT l.k, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, j) END FROM s JOIN l ON l.k=s.k+1)"
    " SELECT id FROM fr WHERE id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM s ORDER BY k DESC LIMIT 1))"
)

# --- Images, graphs, imported fields -----------------------------------------------------------------------

_STEP = "(VALUES (-1),(0),(1))"


@query(
    f"WITH {SEEDS} SELECT grain, a.v AS ix, b.v AS iy, c.v AS iz, c.v <> 0 AS mirrored, round(sx+a.v*20.0::DOUBLE, 6) AS sx, round(sy+b.v*20.0::DOUBLE, 6) AS sy,"
    f" round(CASE c.v WHEN -1 THEN -sz WHEN 1 THEN 40.0::DOUBLE-sz ELSE sz END, 6) AS sz FROM seeds, {_STEP} a(v), {_STEP} b(v), {_STEP} c(v)"
)
def seed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images over two periodic axes, mirror images in the walls of the third."""
    found = replicas.replicated(T.seeds(spark, sf_dir).select("grain", "sx", "sy", "sz"), (BOX,) * 3, (True, True, False))
    return found.select("grain", "ix", "iy", "iz", "mirrored", *[R6(F.col(c), c) for c in ("sx", "sy", "sz")])


@query(
    "WITH " + ", ".join([
        "p0 AS (SELECT * FROM (SELECT id, (id*7919 % 99991)/4999.55::DOUBLE AS x, (id*104729 % 99989)/4999.45::DOUBLE AS y, (id*1299709 % 99971)/4998.55::DOUBLE AS z, false AS ghost FROM (SELECT DISTINCT o_orderkey::BIGINT AS id FROM orders)))",
        "p1 AS (SELECT * FROM p0 UNION ALL SELECT id, x+20.0::DOUBLE, y, z, true FROM p0 WHERE x < 0.5::DOUBLE UNION ALL SELECT id, x-20.0::DOUBLE, y, z, true FROM p0 WHERE x >= 19.5::DOUBLE)",
        "p2 AS (SELECT * FROM p1 UNION ALL SELECT id, x, y, z+20.0::DOUBLE, true FROM p1 WHERE z < 0.5::DOUBLE UNION ALL SELECT id, x, y, z-20.0::DOUBLE, true FROM p1 WHERE z >= 19.5::DOUBLE)",
    ]) + " SELECT id, ghost, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM p2"
)
def ghost_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and their images within half a unit of the box, over the first and the third axis."""
    found = replicas.ghosts(T.few_points(spark, sf_dir), 0.5, (BOX,) * 3, (True, False, True))
    return found.select("id", "ghost", *[R6(F.col(c), c) for c in "xyz"])


_DIST = "ds AS (SELECT a.grain AS grain_i, b.grain AS grain_j, sqrt(" + "+".join(f"pow({IMAGE.format(f'a.s{c}-b.s{c}')}, 2)" for c in "xyz") + ") AS d FROM seeds a JOIN seeds b ON a.grain < b.grain)"


@query(f"WITH {SEEDS}, {_DIST} SELECT grain_i, grain_j, round(d, 6) AS d FROM ds")
def seed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicas.distances(T.seeds(spark, sf_dir), BOX).select("grain_i", "grain_j", R6(F.col("d"), "d"))


@query(f"WITH {VOXELS}, {FACES}, {_DIST} SELECT grain_i, grain_j FROM ds JOIN seeds a ON a.grain=grain_i JOIN seeds b ON b.grain=grain_j WHERE d <= (1+a.w)*2 + (1+b.w)*2 + 0.5 UNION SELECT grain_i, grain_j FROM faces")
def conflict_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that may meet: by their radii and a slack, or as they are neighbours."""
    s = T.seeds(spark, sf_dir)
    return replicas.conflicts(s, s.select("grain", ((1 + F.col("w")) * 2).alias("radius")), _edges(spark, sf_dir), 0.5, BOX)


@query("SELECT 'colours_differ' AS gate, true AS passed, count(*)::BIGINT AS n_nodes FROM nation")
def graph_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy colours of the graph of neighbours: no interface joins two of one colour."""
    nodes = [r.grain for r in T.seeds(spark, sf_dir).select("grain").collect()]
    edges = [(r.grain_i, r.grain_j) for r in _edges(spark, sf_dir).collect()]
    color = replicas.colored(edges, nodes)
    return spark.createDataFrame([("colours_differ", all(color[a] != color[b] for a, b in edges), len(color))], "gate string, passed boolean, n_nodes long")


_CENTER = f"WITH {VOXELS}, vx AS (SELECT grain, (i+0.5)*1.25::DOUBLE AS x, (j+0.5)*1.25::DOUBLE AS y, (k+0.5)*1.25::DOUBLE AS z FROM voxels), cc AS (SELECT grain, " + ", ".join(
    f"CASE WHEN sqrt(pow(avg(sin({c}*pi()/10)), 2)+pow(avg(cos({c}*pi()/10)), 2)) > 1e-9 THEN atan2(avg(sin({c}*pi()/10)), avg(cos({c}*pi()/10)))*10/pi() - floor(atan2(avg(sin({c}*pi()/10)), avg(cos({c}*pi()/10)))*10/pi()/20)*20 ELSE avg({c}) END AS c{c}"
    for c in "xyz"
) + " FROM vx GROUP BY 1)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voxels(spark, sf_dir)
    return v.select("grain", *[((F.col(a) + 0.5) * F.lit(1.25)).alias(c) for a, c in zip("ijk", "xyz", strict=True)])


@query(f"{_CENTER}, rr AS (SELECT grain, sqrt(max(" + "+".join(f"pow({IMAGE.format(f'vx.{c}-cc.c{c}')}, 2)" for c in "xyz") + ")) AS reach FROM vx JOIN cc USING (grain) GROUP BY 1) SELECT grain, round(cx, 5) AS cx, round(cy, 5) AS cy, round(cz, 5) AS cz, round(reach, 5) AS reach FROM cc JOIN rr USING (grain)")
def imported_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of a label field's grains on the circle of each axis, and the farthest voxel of each."""
    v = _places(spark, sf_dir)
    center = replicas.circular_centroids(v, (BOX,) * 3, (True, True, True))
    found = center.join(replicas.farthest(v, center, BOX), "grain")
    return found.select("grain", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "cz", "reach")])


@query(
    "WITH s AS (SELECT l_orderkey*10+l_linenumber AS h FROM lineitem), u AS (SELECT (h*48271+11)%99991/99991.0::DOUBLE AS u FROM s)"
    " SELECT CASE WHEN u < 0.25::DOUBLE THEN 'Al' WHEN u < 0.75::DOUBLE THEN 'Cu' WHEN u < 0.875::DOUBLE THEN 'Ni' ELSE '' END AS species, count(*) AS n FROM u GROUP BY 1"
)
def site_occupants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species of sites by the running sums of their occupancies; the rest is vacant."""
    h = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    u = T.read(spark, sf_dir, "lineitem").select(((h * 48271 + 11) % 99991 / F.lit(99991.0)).alias("u"))
    named = F.coalesce(replicas.occupant(F.col("u"), {"Cu": 0.5, "Al": 0.25, "Ni": 0.125}), F.lit(""))
    return u.groupBy(named.alias("species")).agg(F.count("*").alias("n"))


# --- Quality gates -----------------------------------------------------------------------------------------

#: gate -> (what is measured, threshold, whether it must be at most the threshold (else: report only), hard)
GATES = {
    "G3": ("relative error of the sum of volumes", 1e-6, True), "G5": ("components beyond the first, as a share of voxels", 0.005, False),
    "G9": ("largest drift of a species' share", 0.01, False), "G11": ("largest relative error of a volume against its target", 0.5, False),
    "G12": ("distance of the misorientation distribution from its target", 2.0, False), "G13": ("error of the Hurst exponent", 0.15, False),
    "G15": ("largest phase share less what its cells can fill", 1.0, True), "G19": ("share of relabelled voxels", 0.02, False),
    "G24": ("largest volume error after a warp", 0.1, False), "G25": ("total variation of component shares", 0.1, False),
    "G26": ("total variation of atoms against volume by phase", 0.1, False),
}


def verdicts(measured: DataFrame) -> DataFrame:
    """(gate, passed, measured, threshold, severity) of a table (gate, measured): at most the threshold passes; a null measure
    does not."""
    rows = [(g, float(t), "require" if hard else "record") for g, (_, t, hard) in GATES.items()]
    known = F.broadcast(measured.sparkSession.createDataFrame(rows, "gate string, threshold double, severity string"))
    return measured.join(known, "gate").select("gate", F.coalesce(F.col("measured") <= F.col("threshold"), F.lit(False)).alias("passed"), F.round("measured", 6).alias("measured"), "threshold", "severity")


_WORST = "SELECT greatest(abs(sum(CASE WHEN s='A' THEN b-a END)), abs(sum(CASE WHEN s='N' THEN b-a END)), abs(sum(CASE WHEN s='R' THEN b-a END))) AS m"


@query(
    f"{_VOL}, g AS (SELECT 'G3' AS gate, abs(sum(volume)-8000)/8000 AS measured FROM vol"
    " UNION ALL SELECT 'G9', max(abs(x)) FROM (SELECT count(*) FILTER (l_linestatus='F')/(SELECT count(*) FROM lineitem WHERE l_linestatus='F')::DOUBLE - count(*)/(SELECT count(*) FROM lineitem)::DOUBLE AS x FROM lineitem GROUP BY l_returnflag)"
    " UNION ALL SELECT 'G11', max(abs(volume-320)/320) FROM vol"
    " UNION ALL SELECT 'G15', max(v)/8000 FROM (SELECT sum(volume) AS v FROM vol GROUP BY phase)"
    " UNION ALL SELECT 'G26', sum(abs(n/25.0::DOUBLE - v/8000))/2 FROM (SELECT count(*) AS n, sum(volume) AS v FROM vol GROUP BY phase)),"
    " t(gate, threshold, severity) AS (VALUES " + ", ".join(f"('{g}', {t!r}::DOUBLE, '{'require' if hard else 'record'}')" for g, (_, t, hard) in GATES.items()) + ")"
    " SELECT gate, coalesce(measured <= threshold, false) AS passed, round(measured, 6) AS measured, threshold, severity FROM g JOIN t USING (gate)"
)
def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates measured on the stand-ins, in one table with thresholds and verdicts."""
    v = _volumes(spark, sf_dir)
    phase = v.groupBy("phase").agg(F.sum("volume").alias("v"), F.count("*").alias("n"))
    lines = T.read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("b"))
    total = F.broadcast(lines.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))
    volume, n = F.lit(BOX**3), F.broadcast(v.agg(F.count("*").alias("all")))
    row = lambda gate, df, m: df.agg(m.alias("measured")).select(F.lit(gate).alias("gate"), "measured")
    found = (
        row("G3", v, F.abs(F.sum("volume") - volume) / volume)
        .union(row("G9", lines.crossJoin(total), F.max(F.abs(F.col("b") / F.col("tb") - F.col("a") / F.col("ta")))))
        .union(row("G11", v.crossJoin(n), F.max(F.abs(F.col("volume") - volume / F.col("all")) / (volume / F.col("all")))))
        .union(row("G15", phase, F.max(F.col("v") / volume)))
        .union(row("G26", phase.crossJoin(n), F.sum(F.abs(F.col("n") / F.col("all") - F.col("v") / volume)) / 2))
    )
    return verdicts(found)


@query("SELECT gate, true AS passed FROM (VALUES ('G13'), ('hard_core'), ('G2'), ('G14')) t(gate)")
def generator_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators on the driver keep their promises: a field's exponent, seeds' distances, groups that are closed, whole boxes."""
    field = replicas.random_field(48, BOX, 5, "self_affine", hurst=0.6)
    seeds = replicas.hard_seeds(60, (BOX,) * 3, 2.0, 3)
    d = seeds[:, None] - seeds[None]
    d -= np.rint(d / BOX) * BOX
    near = np.linalg.norm(d, axis=2)[np.triu_indices(len(seeds), 1)].min()
    closed = all(_closed(texture.group(f)) for f in ("cubic", "hexagonal", "trigonal", "tetragonal", "orthorhombic", "monoclinic", "triclinic"))
    whole = replicas.misfit(np.diag([BOX] * 3), np.diag([2.0, 4.0, 5.0])) < 1e-9
    rows = [("G13", abs(replicas.hurst(field, BOX) - 0.6) <= 0.15), ("hard_core", bool(near >= 2.0)), ("G2", closed), ("G14", whole)]
    return spark.createDataFrame([(g, bool(p)) for g, p in rows], "gate string, passed boolean")


def _closed(quats: list[tuple[float, ...]]) -> bool:
    """Whether products of a group's rotations are its own, up to sign."""
    q = np.array(quats)
    for a in q:
        m = np.array([[a[0], -a[1], -a[2], -a[3]], [a[1], a[0], -a[3], a[2]], [a[2], a[3], a[0], -a[1]], [a[3], -a[2], a[1], a[0]]])
        if (np.abs((q @ m.T) @ q.T).max(axis=1) < 1 - 1e-9).any():
            return False
    return True
