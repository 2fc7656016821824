"""All queries by name, and the SQL that says what they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import assign as A
from ..operators import grid, pairs, stats
from . import tables as T
from .tables import BOX

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
GRID = 16


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- SQL pieces --------------------------------------------------------------------------------------------

D = "::DOUBLE"
PTS = (
    "SELECT id, (id*7919 % 99991)/4999.55::DOUBLE AS x, (id*104729 % 99989)/4999.45::DOUBLE AS y,"
    " (id*1299709 % 99971)/4998.55::DOUBLE AS z FROM ({})"
)
POINTS = "pts AS (" + PTS.format("SELECT DISTINCT (l_orderkey*10+l_linenumber)::BIGINT AS id FROM lineitem") + ")"
FEW = "pts AS (" + PTS.format("SELECT DISTINCT o_orderkey::BIGINT AS id FROM orders") + ")"
SEEDS = (
    "seeds AS (SELECT n_nationkey::INT AS grain, ((n_nationkey::BIGINT*37+11)%101)/5.05::DOUBLE AS sx, ((n_nationkey::BIGINT*59+23)%103)/5.15::DOUBLE AS sy,"
    " ((n_nationkey::BIGINT*83+41)%107)/5.35::DOUBLE AS sz, ((n_nationkey::BIGINT*29+7)%31)/31.0::DOUBLE AS w, 1+((n_nationkey::BIGINT*13)%17)/17.0::DOUBLE AS m11,"
    " 1+((n_nationkey::BIGINT*19)%23)/23.0::DOUBLE AS m22, 1+((n_nationkey::BIGINT*7)%29)/29.0::DOUBLE AS m33, n_regionkey::INT AS phase FROM nation)"
)
IMAGE = "({0}) - round_even(({0})/20.0::DOUBLE, 0)*20.0::DOUBLE"
OFFSETS = "offs AS (SELECT " + ", ".join(f"{IMAGE.format(f'{c} - s{c}')} AS d{c}" for c in "xyz") + ", pts.*, seeds.* FROM pts, seeds)"
EUCLID, POWER, ADDITIVE = "dx*dx + dy*dy + dz*dz", "(dx*dx + dy*dy + dz*dz) - w", "sqrt(dx*dx + dy*dy + dz*dz) - w"
ANISO = "sqrt(m11*dx*dx + m22*dy*dy + m33*dz*dz)"
VOXELS = (
    f"pts AS (SELECT ((i+0.5)*1.25)::DOUBLE AS x, ((j+0.5)*1.25)::DOUBLE AS y, ((k+0.5)*1.25)::DOUBLE AS z, i::INT AS i, j::INT AS j, k::INT AS k"
    f" FROM range({GRID}) a(i), range({GRID}) b(j), range({GRID}) c(k)), {SEEDS}, {OFFSETS},"
    f" voxels AS (SELECT i, j, k, arg_min(grain, ({EUCLID}, grain)) AS grain FROM offs GROUP BY i, j, k)"
)
FACES = (
    "faces AS (SELECT axis, v.i, v.j, v.k, least(v.grain, u.grain) AS grain_i, greatest(v.grain, u.grain) AS grain_j FROM voxels v"
    " CROSS JOIN (VALUES ('i',1,0,0),('j',0,1,0),('k',0,0,1)) s(axis,di,dj,dk)"
    f" JOIN voxels u ON u.i=(v.i+di)%{GRID} AND u.j=(v.j+dj)%{GRID} AND u.k=(v.k+dk)%{GRID} WHERE v.grain<>u.grain)"
)


def _assigned(measure: str) -> str:
    return (
        f"WITH {POINTS}, {SEEDS}, {OFFSETS}, m AS (SELECT id, grain, {measure} AS d FROM offs), r AS (SELECT *, row_number() OVER (PARTITION BY id"
        " ORDER BY d, grain) AS n FROM m) SELECT id, grain, round(d, 6) AS d FROM r WHERE n = 1"
    )


def _assign(measure) -> object:  # noqa: ANN001
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = A.assign(T.points(spark, sf_dir), T.seeds(spark, sf_dir), BOX, measure)
        return found.select("id", "grain", F.round("d", 6).alias("d"))

    return run


for _name, _measure, _sql in (
    ("assign_points", A.euclid, EUCLID),
    ("assign_power", A.power, POWER),
    ("assign_additive", A.additive, ADDITIVE),
    ("assign_anisotropic", A.anisotropic, ANISO),
):
    QUERIES[_name], ORACLE[_name] = _assign(_measure), _assigned(_sql)


@query(
    f"WITH {POINTS}, {SEEDS}, {OFFSETS}, r AS (SELECT id, arg_min(grain, ({ADDITIVE}, grain)) AS grain, min({ADDITIVE}, 2) AS two FROM offs GROUP BY id)"
    " SELECT id, grain, round((two[2] - two[1])/2, 6) AS margin FROM r"
)
def runner_up_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.margin(T.points(spark, sf_dir), T.seeds(spark, sf_dir), BOX)
    return found.select("id", "grain", F.round("margin", 6).alias("margin"))


@query(
    f"WITH {POINTS}, {SEEDS}, {OFFSETS}, r AS (SELECT id, grain, {EUCLID} AS d, row_number() OVER (PARTITION BY id ORDER BY {EUCLID}, grain) AS n FROM offs)"
    " SELECT seeds.grain, count(r.id) AS n_atoms, coalesce(round(max(r.d), 6), 0.0) AS reach FROM seeds LEFT JOIN r ON seeds.grain=r.grain AND n=1 GROUP BY 1"
)
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.assign(T.points(spark, sf_dir), T.seeds(spark, sf_dir), BOX).groupBy("grain").agg(F.count("id").alias("n"), F.max("d").alias("d"))
    spine = T.seeds(spark, sf_dir).select("grain")
    return spine.join(found, "grain", "left").select("grain", F.coalesce("n", F.lit(0)).alias("n_atoms"), F.coalesce(F.round("d", 6), F.lit(0.0)).alias("reach"))


CUTOFF = 0.5
_BUCKETS = (
    f"WITH {FEW}, b AS (SELECT *, least(floor(x/0.5)::INT, 39) AS cx, least(floor(y/0.5)::INT, 39) AS cy, least(floor(z/0.5)::INT, 39) AS cz FROM pts),"
    " o AS (SELECT a.v AS ox, b.v AS oy, c.v AS oz FROM (VALUES (-1),(0),(1)) a(v), (VALUES (-1),(0),(1)) b(v), (VALUES (-1),(0),(1)) c(v)),"
    " e AS (SELECT id, x, y, z, (cx+ox+40)%40 AS cx, (cy+oy+40)%40 AS cy, (cz+oz+40)%40 AS cz FROM b, o),"
    " p AS (SELECT e.id AS i, q.id AS j, " + ", ".join(f"{IMAGE.format(f'e.{c} - q.{c}')} AS d{c}" for c in "xyz") + " FROM e JOIN b q USING (cx, cy, cz) WHERE e.id < q.id)"
)


@query(f"{_BUCKETS} SELECT i, j, round({EUCLID}, 6) AS d2 FROM p WHERE {EUCLID} <= 0.25")
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.range_pairs(T.few_points(spark, sf_dir), CUTOFF, BOX).select("i", "j", F.round("d2", 6).alias("d2"))


@query(
    f"{_BUCKETS}, n AS (SELECT i AS id FROM p WHERE {EUCLID} < 0.25 AND j % 2 = 0 AND i % 2 = 1 UNION SELECT j FROM p WHERE {EUCLID} < 0.25 AND i % 2 = 0 AND j % 2 = 1)"
    " SELECT id, round(x, 6) AS x FROM pts WHERE id % 2 = 1 AND id NOT IN (SELECT id FROM n)"
)
def far_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd points with no even point nearer than the cutoff."""
    every = T.few_points(spark, sf_dir)
    return pairs.far_from(every.where("id % 2 = 1"), every.where("id % 2 = 0"), CUTOFF, BOX).select("id", F.round("x", 6).alias("x"))


@query()
def overlap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids deleted when, of each close pair in order, the one of higher id goes."""
    import numpy as np

    T.shared(spark)
    points = T.few_points(spark, sf_dir)
    higher = lambda k, others, ranks: np.zeros(len(others), dtype=bool)
    return pairs.losers_of(points, CUTOFF, BOX, False, (), higher, lambda: pairs.range_pairs(points, CUTOFF, BOX).withColumn("loser", F.col("j")))


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assign(grid.centers(spark, GRID, BOX), T.seeds(spark, sf_dir), BOX).select("i", "j", "k", "grain")


@query(f"WITH {VOXELS} SELECT seeds.grain, round(count(v.i)*1.953125::DOUBLE, 6) AS volume FROM seeds LEFT JOIN voxels v ON v.grain=seeds.grain GROUP BY 1")
def voxel_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.volumes(_voxels(spark, sf_dir), 1.953125, T.seeds(spark, sf_dir)).select("grain", F.round("volume", 6).alias("volume"))


@query(f"WITH {VOXELS}, {FACES} SELECT grain_i, grain_j, round(count(*)*1.5625::DOUBLE, 6) AS area FROM faces GROUP BY 1, 2")
def interface_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.areas(_voxels(spark, sf_dir), GRID, 1.5625).select("grain_i", "grain_j", F.round("area", 6).alias("area"))


@query(
    f"WITH {VOXELS}, {FACES}, e AS (SELECT DISTINCT grain_i, grain_j FROM faces), d AS (SELECT grain_i AS g FROM e UNION ALL SELECT grain_j FROM e)"
    " SELECT seeds.grain, count(g) AS n_neighbors, coalesce((SELECT string_agg(n::VARCHAR, ';' ORDER BY n) FROM (SELECT grain_j AS n FROM e WHERE grain_i=seeds.grain"
    " UNION SELECT grain_i FROM e WHERE grain_j=seeds.grain)), '') AS adjacent FROM seeds LEFT JOIN d ON g=grain GROUP BY 1"
)
def adjacency_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = grid.faces(_voxels(spark, sf_dir), GRID).select("grain_i", "grain_j").distinct()
    both = edges.union(edges.select("grain_j", "grain_i")).toDF("grain", "other")
    found = both.groupBy("grain").agg(F.count("other").alias("n_neighbors"), F.array_join(F.array_sort(F.collect_set("other")).cast("array<string>"), ";").alias("adjacent"))
    spine = T.seeds(spark, sf_dir).select("grain")
    return spine.join(found, "grain", "left").select("grain", F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"), F.coalesce("adjacent", F.lit("")).alias("adjacent"))


@query(
    f"WITH {VOXELS}, {FACES} SELECT i, j, k FROM faces UNION SELECT CASE axis WHEN 'i' THEN (i+1)%{GRID} ELSE i END, CASE axis WHEN 'j' THEN (j+1)%{GRID} ELSE j END,"
    f" CASE axis WHEN 'k' THEN (k+1)%{GRID} ELSE k END FROM faces"
)
def boundary_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.boundary(_voxels(spark, sf_dir), GRID)


def _triple_sql(axis: str, a: str, b: str) -> str:
    return (
        f"SELECT '{axis}' AS axis, count(*) AS n_edges FROM (SELECT v.{axis}, (v.{a}-da+{GRID})%{GRID} AS p, (v.{b}-db+{GRID})%{GRID} AS q, count(DISTINCT grain) AS m"
        " FROM voxels v, (VALUES (0),(1)) s(da), (VALUES (0),(1)) t(db) GROUP BY 1, 2, 3) WHERE m >= 3"
    )


@query(f"WITH {VOXELS} " + " UNION ALL ".join(_triple_sql(*x) for x in ("ijk", "jik", "kij")))
def triple_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.triple_lines(_voxels(spark, sf_dir), GRID)


QUATS = (
    "q0 AS (SELECT n_nationkey::INT AS grain, " + ", ".join(f"((n_nationkey::BIGINT*{p}+{r})%{q} - {s})::DOUBLE AS {c}" for c, p, r, q, s in T.QUAT) + " FROM nation),"
    " quats AS (SELECT grain, " + ", ".join(f"{c}/sqrt(w*w+x*x+y*y+z*z) AS {c}" for c in "wxyz") + " FROM q0)"
)
SYM = "sym(sw,sx,sy,sz) AS (VALUES " + ", ".join("(" + ", ".join(f"{c!r}::DOUBLE" for c in q) + ")" for q in T.cubic_group()) + ")"
MIS = (
    "m AS (SELECT p.grain AS grain_i, q.grain AS grain_j, p.w*q.w+p.x*q.x+p.y*q.y+p.z*q.z AS w, p.w*q.x-p.x*q.w-p.y*q.z+p.z*q.y AS x,"
    " p.w*q.y+p.x*q.z-p.y*q.w-p.z*q.x AS y, p.w*q.z-p.x*q.y+p.y*q.x-p.z*q.w AS z FROM quats p JOIN quats q ON p.grain < q.grain)"
)
DIS = f"WITH {QUATS}, {SYM}, {MIS}, dis AS (SELECT grain_i, grain_j, degrees(2*acos(least(1.0, max(abs(w*sw-x*sx-y*sy-z*sz))))) AS angle FROM m, sym GROUP BY 1, 2)"


def _disorientations(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """Angles of the pairs of `edges` (grain_i, grain_j, ...), or of all pairs."""
    p = T.quats(spark, sf_dir).select(F.col("grain").alias("grain_i"), F.col("q").alias("p"))
    q = T.quats(spark, sf_dir).select(F.col("grain").alias("grain_j"), "q")
    both = p.join(q, F.expr("grain_i < grain_j")) if edges is None else edges.join(p, "grain_i").join(q, "grain_j")
    kept = ["grain_i", "grain_j", *[c for c in (edges.columns if edges is not None else []) if c not in ("grain_i", "grain_j")]]
    return both.select(*kept, G.disorientation_angle(F.col("p"), F.col("q"), T.cubic_symmetry()).alias("angle"))


@query(f"{DIS} SELECT grain_i, grain_j, round(angle, 6) AS angle FROM dis")
def disorientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disorientations(spark, sf_dir).select("grain_i", "grain_j", F.round("angle", 6).alias("angle"))


@query(
    f"{DIS}, b AS (SELECT greatest(least(floor(angle/3.25)::INT, 19), 0) AS bin, count(*)::DOUBLE AS n FROM dis GROUP BY 1)"
    " SELECT s.bin::INT AS bin, round(coalesce(n, 0)/(SELECT sum(n) FROM b), 6) AS mass FROM range(20) s(bin) LEFT JOIN b ON b.bin=s.bin"
)
def disorientation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _disorientations(spark, sf_dir)
    return stats.masses(found, stats.clipped_bin(F.col("angle"), 0.0, 3.25, 20), F.lit(1.0), 20).select("bin", F.round("mass", 6).alias("mass"))


@query(
    f"{DIS}, h AS (SELECT greatest(least(floor(angle/3.25)::INT, 19), 0) AS bin, count(*)::DOUBLE AS n, sum(grain_i+1)::DOUBLE AS v FROM dis GROUP BY 1),"
    " t AS (SELECT n/sum(n) OVER () AS p, v/sum(v) OVER () AS q FROM h) SELECT round(sum((p-q)*(p-q)/(p+q)), 6) AS chi2, round(sum(abs(p-q))/2, 6) AS tv FROM t WHERE p+q > 0"
)
def histogram_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _disorientations(spark, sf_dir)
    bin_ = stats.clipped_bin(F.col("angle"), 0.0, 3.25, 20)
    p, q = stats.masses(found, bin_, F.lit(1.0), 20), stats.masses(found, bin_, (F.col("grain_i") + 1).cast("double"), 20)
    return stats.chi_square_distance(p, q).crossJoin(stats.total_variation(p, q, "bin")).select(F.round("chi2", 6).alias("chi2"), F.round("tv", 6).alias("tv"))


# Coincidence labels, their sigma and angle.
CSL = (("3", 3, 60.0), ("5", 5, 36.87), ("7", 7, 38.21), ("9", 9, 38.94), ("11", 11, 50.48), ("13a", 13, 22.62), ("13b", 13, 27.8), ("15", 15, 48.19))


@query(
    f"{DIS}, csl(label, sigma, theta) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in CSL) + "), hit AS (SELECT grain_i, grain_j, label, sigma,"
    " row_number() OVER (PARTITION BY grain_i, grain_j ORDER BY sigma, label) AS n FROM dis JOIN csl ON abs(angle-theta) <= 15/sqrt(sigma))"
    " SELECT dis.grain_i, dis.grain_j, coalesce(label, '') AS csl FROM dis LEFT JOIN hit ON dis.grain_i=hit.grain_i AND dis.grain_j=hit.grain_j AND n=1"
)
def csl_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest sigma whose angle is within Brandon's tolerance."""
    sigmas = F.array(*[F.struct(F.lit(b).alias("sigma"), F.lit(a).alias("label"), F.lit(c).alias("theta")) for a, b, c in CSL])
    near = F.filter(sigmas, lambda s: F.abs(F.col("angle") - s.theta) <= 15 / F.sqrt(s.sigma))
    return _disorientations(spark, sf_dir).select("grain_i", "grain_j", F.coalesce(F.array_min(near).label, F.lit("")).alias("csl"))


@query(
    f"WITH {QUATS} SELECT grain, round(1-2*(y*y+z*z), 6) AS r11, round(2*(x*y-w*z), 6) AS r12, round(2*(x*z+w*y), 6) AS r13, round(2*(y*z+w*x), 6) AS r32,"
    " round(1-2*(x*x+y*y), 6) AS r33, round(degrees(2*acos(least(1.0, abs(w)))), 6) AS angle FROM quats"
)
def rotation_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = G.quat_matrix(F.col("q"))
    cols = {"r11": r[0], "r12": r[1], "r13": r[2], "r32": r[7], "r33": r[8], "angle": G.quat_angle(F.col("q.w"))}
    return T.quats(spark, sf_dir).select("grain", *[F.round(c, 6).alias(n) for n, c in cols.items()])


_MILLER = (
    f"{QUATS}, k AS (SELECT grain, x, y, z, s::INT AS s, round_even(x/m*s, 0)::INT AS a, round_even(y/m*s, 0)::INT AS b, round_even(z/m*s, 0)::INT AS c FROM"
    " (SELECT *, greatest(abs(x), abs(y), abs(z)) AS m FROM quats), range(1, 13) r(s)),"
    " g AS (SELECT *, gcd(gcd(a, b), c)::INT AS g FROM k), r AS (SELECT grain, s, a//g AS a, b//g AS b, c//g AS c, x, y, z FROM g),"
    " dv AS (SELECT grain, s, a, b, c, greatest(abs(a), abs(b), abs(c)) AS most, degrees(acos(least(1.0, (a*x+b*y+c*z)/(sqrt((a*a+b*b+c*c)::DOUBLE)*sqrt(x*x+y*y+z*z))))) AS dev FROM r),"
    " st AS (SELECT grain, s, a, b, c, most, dev FROM dv WHERE s = 1 UNION ALL"
    " SELECT st.grain, dv.s, CASE WHEN w THEN dv.a ELSE st.a END, CASE WHEN w THEN dv.b ELSE st.b END, CASE WHEN w THEN dv.c ELSE st.c END, CASE WHEN w THEN dv.most ELSE st.most END, CASE WHEN w THEN dv.dev ELSE st.dev END"
    " FROM st JOIN dv ON dv.grain=st.grain AND dv.s=st.s+1, LATERAL (SELECT dv.dev < st.dev-1e-8 OR (abs(dv.dev-st.dev) <= 1e-8 AND dv.most < st.most) AS w))"
)


@query(f"WITH RECURSIVE {_MILLER} SELECT grain, concat(a, ' ', b, ' ', c) AS hkl, round(dev, 5) AS deviation FROM st WHERE s = 12")
def miller_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer direction nearest to each orientation's axis, and the angle to it."""
    found = T.quats(spark, sf_dir).select("grain", G.rationalize(F.col("q.x"), F.col("q.y"), F.col("q.z")).alias("r"))
    return found.select("grain", F.array_join(F.col("r.hkl").cast("array<string>"), " ").alias("hkl"), F.round("r.deviation", 5).alias("deviation"))


_VOL = f"WITH {VOXELS}, vol AS (SELECT grain, phase, count(v.i)*1.953125::DOUBLE AS volume FROM seeds LEFT JOIN voxels v USING (grain) GROUP BY 1, 2)"


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.volumes(_voxels(spark, sf_dir), 1.953125, T.seeds(spark, sf_dir)).join(T.seeds(spark, sf_dir).select("grain", "phase"), "grain")


@query(
    f"{_VOL}, d AS (SELECT phase, cbrt(6*volume/pi()) AS d FROM vol WHERE volume > 0) SELECT coalesce(phase, -1)::INT AS phase, count(*) AS n, round(avg(d), 6) AS mean,"
    " round(stddev_samp(d), 6) AS std, round(min(d), 6) AS low, round(max(d), 6) AS high, round(avg(ln(d)), 6) AS mu, round(stddev_samp(ln(d)), 6) AS sigma"
    " FROM d GROUP BY GROUPING SETS ((), (phase))"
)
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diameters over all cells (phase -1) and by phase, as grouping sets."""
    d = _volumes(spark, sf_dir).where("volume > 0").select("phase", G.equivalent_diameter(F.col("volume")).alias("d"))
    out = d.rollup("phase").agg(*stats.size_summary(F.col("d")))
    return out.select(F.coalesce("phase", F.lit(-1)).alias("phase"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high", "mu", "sigma")])


@query(f"{_VOL} SELECT phase, round(sum(volume)/(SELECT sum(volume) FROM vol), 6) AS fraction FROM vol GROUP BY 1")
def phase_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _volumes(spark, sf_dir).groupBy("phase").agg(F.sum("volume").alias("v"))
    return found.crossJoin(F.broadcast(found.agg(F.sum("v").alias("t")))).select("phase", F.round(F.col("v") / F.col("t"), 6).alias("fraction"))


@query(
    f"{_VOL} SELECT round(pow(sum(volume), 2)/sum(volume*volume), 6) AS effective, round(sum(abs(volume/t - 1.0/n))/2, 6) AS gap FROM vol,"
    " (SELECT sum(volume) AS t, count(*) AS n FROM vol)"
)
def count_volume_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kish's effective number of cells, and the distance of volume weights from equal ones."""
    v = _volumes(spark, sf_dir)
    total = F.broadcast(v.agg(F.sum("volume").alias("t"), F.count("*").alias("n")))
    gap = F.sum(F.abs(F.col("volume") / F.col("t") - 1 / F.col("n"))) / 2
    return v.crossJoin(total).agg(F.round(stats.effective_size(F.col("volume")), 6).alias("effective"), F.round(gap, 6).alias("gap"))


@query(
    f"{_VOL} SELECT 'size' AS section, 'n_cells' AS key, count(*)::VARCHAR AS value FROM vol UNION ALL SELECT 'size', 'n_empty', count(*)::VARCHAR FROM vol WHERE volume = 0"
    " UNION ALL SELECT 'phase', 'n_phases', count(DISTINCT phase)::VARCHAR FROM vol"
)
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (section, key, value) rows from one pass."""
    one = _volumes(spark, sf_dir).agg(F.count("*").alias("a"), F.count_if(F.col("volume") == 0).alias("b"), F.countDistinct("phase").alias("c"))
    return one.selectExpr("stack(3, 'size', 'n_cells', cast(a as string), 'size', 'n_empty', cast(b as string), 'phase', 'n_phases', cast(c as string)) as (section, key, value)")


@query(
    f"WITH {VOXELS}, {FACES}, {QUATS}, {SYM}, {MIS}, dis AS (SELECT grain_i, grain_j, degrees(2*acos(least(1.0, max(abs(w*sw-x*sx-y*sy-z*sz))))) AS angle FROM m, sym GROUP BY 1, 2),"
    " a AS (SELECT grain_i, grain_j, count(*)*1.5625::DOUBLE AS area FROM faces GROUP BY 1, 2) SELECT round(sum(area*angle)/sum(area), 6) AS mean_angle,"
    " round(sum(CASE WHEN angle < 15 THEN area ELSE 0 END)/sum(area), 6) AS low_fraction, count(*) AS n_boundaries FROM a JOIN dis USING (grain_i, grain_j)"
)
def boundary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted angle and low-angle share of the interfaces."""
    both = _disorientations(spark, sf_dir, grid.areas(_voxels(spark, sf_dir), GRID, 1.5625))
    low = F.sum(F.when(F.col("angle") < 15, F.col("area")).otherwise(0.0)) / F.sum("area")
    return both.agg(F.round(stats.weighted_mean(F.col("angle"), F.col("area")), 6).alias("mean_angle"), F.round(low, 6).alias("low_fraction"), F.count("*").alias("n_boundaries"))


@query(
    "SELECT l_returnflag AS species, (dense_rank() OVER (ORDER BY l_returnflag))::INT AS type_id, count(*) AS n, round(count(*)/(SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share"
    " FROM lineitem GROUP BY 1"
)
def species_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species with their ids in order of name, counts and shares (a few rows after aggregation)."""
    from pyspark.sql import Window

    found = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("species")).agg(F.count("*").alias("n"))
    total = F.broadcast(found.agg(F.sum("n").alias("t")))
    rank = F.dense_rank().over(Window.orderBy("species")).cast("int")
    return found.crossJoin(total).select("species", rank.alias("type_id"), "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def _gate(name: str, passed: Column, measured: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), passed.alias("passed"), F.round(measured.cast("double"), 6).alias("measured"))


@query(
    f"{_VOL} SELECT 'volume_sum' AS gate, abs(sum(volume)-8000) <= 0.008 AS passed, round(sum(volume), 6) AS measured FROM vol"
    " UNION ALL SELECT 'no_empty_cell', count(*) = 0, round(count(*)::DOUBLE, 6) FROM vol WHERE volume = 0"
    " UNION ALL SELECT 'largest_share', max(volume)/sum(volume) <= 0.25, round(max(volume)/sum(volume), 6) FROM vol"
)
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared rules over the cell volumes, measured in one pass."""
    one = _volumes(spark, sf_dir).agg(F.sum("volume").alias("s"), F.count_if(F.col("volume") == 0).alias("e"), F.max("volume").alias("m"))
    share = F.col("m") / F.col("s")
    gates = F.array(
        _gate("volume_sum", F.abs(F.col("s") - 8000) <= 0.008, F.col("s")), _gate("no_empty_cell", F.col("e") == 0, F.col("e")), _gate("largest_share", share <= 0.25, share)
    )
    return one.select(F.inline(gates))
