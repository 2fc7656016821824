"""Queries on fields, shells, label grids that fall apart, doping, phases, filling and textures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import assign as A
from ..operators import crystal, doping, fields, graph, grid
from . import tables as T
from .registry import CUTOFF, EUCLID, GRID, IMAGE, OFFSETS, POINTS, SEEDS, VOXELS, _volumes, _voxels, query
from .tables import BOX

NODES, AMPLITUDE, COLORS, SHELL = 8, 0.5, 4, 0.4
R6 = lambda c, name: F.round(c, 6).alias(name)

# --- Fields ------------------------------------------------------------------------------------------------

_WAVES = ((37, 11, 101), (59, 23, 103), (83, 41, 107), (29, 7, 109))


def _field(spark: SparkSession, names: list[str]) -> DataFrame:
    node = spark.range(NODES**3).withColumn("node", F.col("id"))
    axes = [F.expr(f"cast(id div {NODES**2} as int) as i"), F.expr(f"cast(id div {NODES} % {NODES} as int) as j"), F.expr(f"cast(id % {NODES} as int) as k")]
    return node.select(*axes, *[((F.col("id") * p + r) % q / F.lit(float(q)) - F.lit(0.5)).alias(c) for c, (p, r, q) in zip(names, _WAVES, strict=False)])


def _field_sql(names: list[str]) -> str:
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    node = "(((bx+{0})%8)*8+(by_+{1})%8)*8+(bz+{2})%8"
    values = lambda p, r, q, at: f"((({at})*{p}+{r})%{q}/{float(q)}::DOUBLE - 0.5::DOUBLE)"
    share = lambda o: "*".join(f"t{x}" if k else f"(1-t{x})" for x, k in zip("xyz", o, strict=True))
    cols = ", ".join(" + ".join(f"{values(*w, node.format(*o))}*({share(o)})" for o in corners) + f" AS {n}" for n, w in zip(names, _WAVES, strict=False))
    return (
        "g AS (SELECT id, x, y, z, floor(x/2.5)::BIGINT AS bx, floor(y/2.5)::BIGINT AS by_, floor(z/2.5)::BIGINT AS bz, x/2.5::DOUBLE-floor(x/2.5) AS tx, y/2.5::DOUBLE-floor(y/2.5) AS ty, z/2.5::DOUBLE-floor(z/2.5) AS tz FROM pts),"
        f" fld AS (SELECT id, x, y, z, {cols} FROM g)"
    )


@query(
    f"WITH {POINTS}, {SEEDS}, {_field_sql(['ux', 'uy', 'uz'])}, w AS (SELECT id, x+ux AS x, y+uy AS y, z+uz AS z FROM fld), {OFFSETS.replace('FROM pts, seeds', 'FROM w pts, seeds')},"
    f" r AS (SELECT id, grain, {EUCLID} AS d, row_number() OVER (PARTITION BY id ORDER BY {EUCLID}, grain) AS n FROM offs) SELECT id, grain, round(d, 6) AS d FROM r WHERE n = 1"
)
def assign_warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fields.warped(T.points(spark, sf_dir), T.seeds(spark, sf_dir), _field(spark, ["ux", "uy", "uz"]), NODES, BOX)
    return found.select("id", "grain", R6(F.col("d"), "d"))


@query(
    f"WITH {POINTS}, {SEEDS}, {_field_sql(['e0', 'e1', 'e2', 'e3'])}, offs AS (SELECT " + ", ".join(f"{IMAGE.format(f'{c} - s{c}')} AS d{c}" for c in "xyz") + ", fld.*, seeds.* FROM fld, seeds),"
    f" m AS (SELECT id, grain, sqrt({EUCLID}) - 0.5*(CASE grain%4 WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END) AS d FROM offs),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, grain) AS n FROM m) SELECT id, grain, round(d, 6) AS d FROM r WHERE n = 1"
)
def assign_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.seeds(spark, sf_dir).withColumn("color", F.col("grain") % COLORS)
    found = fields.perturbed(T.points(spark, sf_dir), cells, _field(spark, [f"e{k}" for k in range(COLORS)]), NODES, BOX, AMPLITUDE, COLORS)
    return found.select("id", "grain", R6(F.col("d"), "d"))


_SHELL = (
    f"WITH {POINTS}, {SEEDS}, {OFFSETS}, r AS (SELECT id, arg_min(grain, (sqrt({EUCLID}), grain)) AS grain, min(sqrt({EUCLID}), 2) AS two FROM offs GROUP BY id),"
    " mg AS (SELECT id, grain, (two[2] - two[1])/2 AS margin FROM r)"
)


@query(f"{_SHELL} SELECT id, grain, round(margin, 6) AS margin FROM mg WHERE margin <= 0.4::DOUBLE")
def shell_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.shell(T.points(spark, sf_dir), T.seeds(spark, sf_dir), BOX, SHELL).select("id", "grain", R6(F.col("margin"), "margin"))


@query(
    f"WITH {VOXELS}, {POINTS.replace('pts AS', 'pt AS')} SELECT id, grain FROM pt JOIN voxels v ON v.i = least(floor(x/1.25)::INT, 15) AND v.j = least(floor(y/1.25)::INT, 15) AND v.k = least(floor(z/1.25)::INT, 15)"
)
def voxel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.lookup(T.points(spark, sf_dir), _voxels(spark, sf_dir), GRID, BOX).select("id", "grain")


def _lloyd_sql(steps: int) -> str:
    out, wrap = f"WITH {VOXELS}, s0 AS (SELECT grain, sx, sy, sz FROM seeds)", "({0}) - floor(({0})/20.0::DOUBLE)*20.0::DOUBLE"
    for t in range(steps):
        d = ", ".join(f"{IMAGE.format(f'p.{c} - s.s{c}')} AS d{c}" for c in "xyz")
        out += (
            f", o{t} AS (SELECT p.i, p.j, p.k, s.*, {d} FROM pts p, s{t} s), b{t} AS (SELECT *, row_number() OVER (PARTITION BY i, j, k ORDER BY {EUCLID}, grain) AS n FROM o{t}),"
            f" m{t} AS (SELECT grain, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz FROM b{t} WHERE n = 1 GROUP BY 1),"
            f" s{t + 1} AS (SELECT s.grain, " + ", ".join(wrap.format(f"s{c} + coalesce(d{c}, 0)") + f" AS s{c}" for c in "xyz") + f" FROM s{t} s LEFT JOIN m{t} USING (grain))"
        )
    return out + f" SELECT grain, round(sx, 6) AS sx, round(sy, 6) AS sy, round(sz, 6) AS sz FROM s{steps}"


_shared = T.shared


@query(_lloyd_sql(2))
def relaxed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _shared(spark)
    s = T.seeds(spark, sf_dir).select("grain", "sx", "sy", "sz")
    return fields.relax(grid.centers(spark, GRID, BOX), s, BOX, 2).select("grain", *[R6(F.col(c), c) for c in ("sx", "sy", "sz")])


_SECTION = (
    f"{SEEDS}, pts AS (SELECT ((u+0.5)*0.3125)::DOUBLE AS x, ((v+0.5)*0.3125)::DOUBLE AS y, 10.0::DOUBLE AS z, u::INT AS u, v::INT AS v FROM range(64) a(u), range(64) b(v)), {OFFSETS},"
    f" sec AS (SELECT u, v, arg_min(grain, ({EUCLID}, grain)) AS grain FROM offs GROUP BY 1, 2)"
)


def _section(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = spark.range(64 * 64).select(F.expr("cast(id div 64 as int) as u"), F.expr("cast(id % 64 as int) as v"))
    at = px.select("u", "v", ((F.col("u") + 0.5) * 0.3125).alias("x"), ((F.col("v") + 0.5) * 0.3125).alias("y"), F.lit(10.0).alias("z"))
    return A.assign(at, T.seeds(spark, sf_dir), BOX).select("u", "v", "x", "y", "grain")


@query(f"WITH {_SECTION} SELECT u, v, round((u+0.5)*0.3125, 6)::DOUBLE AS x, round((v+0.5)*0.3125, 6)::DOUBLE AS y, grain, phase FROM sec JOIN seeds USING (grain)")
def section_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a plane through the middle of the box, with grain and phase."""
    return _section(spark, sf_dir).join(F.broadcast(T.seeds(spark, sf_dir).select("grain", "phase")), "grain").select("u", "v", R6(F.col("x"), "x"), R6(F.col("y"), "y"), "grain", "phase")


@query(
    f"WITH {_SECTION}, edge AS (SELECT DISTINCT a.u, a.v FROM sec a JOIN sec b ON abs(a.u-b.u)+abs(a.v-b.v)=1 WHERE a.grain<>b.grain),"
    " c AS (SELECT eps, count(*) AS n FROM (SELECT DISTINCT eps, floor(u/eps) AS a, floor(v/eps) AS b FROM edge, (VALUES (3.0::DOUBLE),(5),(7),(9),(11),(13),(15)) s(eps)) GROUP BY 1)"
    " SELECT round(regr_slope(ln(n), ln(1/eps)), 6) AS dimension, sum(n)::BIGINT AS n_boxes FROM c"
)
def box_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of log count against log inverse size of boxes that meet the boundaries of a section."""
    counts = fields.box_counts(fields.perimeter(_section(spark, sf_dir)), list(range(3, 16, 2)))
    return counts.agg(R6(F.regr_slope(F.log("n"), F.log(1 / F.col("eps"))), "dimension"), F.sum("n").alias("n_boxes"))


# --- Label grids that fall apart ---------------------------------------------------------------------------

_SPOT = "(i*7 + j*13 + k*31) % 37 = 0"


def _spotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir).withColumn("grain", F.when(F.expr(_SPOT), (F.col("grain") + 1) % 25).otherwise(F.col("grain")))


@query(
    f"WITH RECURSIVE {VOXELS}, lab AS (SELECT (i*{GRID}+j)*{GRID}+k AS id, i, j, k, CASE WHEN {_SPOT} THEN (grain+1)%25 ELSE grain END AS grain FROM voxels),"
    " e0 AS (SELECT a.id AS a, b.id AS b FROM lab a CROSS JOIN (VALUES (1,0,0),(0,1,0),(0,0,1)) s(di,dj,dk)"
    f" JOIN lab b ON b.i=(a.i+di)%{GRID} AND b.j=(a.j+dj)%{GRID} AND b.k=(a.k+dk)%{GRID} WHERE a.grain=b.grain), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),"
    " r AS (SELECT id, id AS root FROM lab UNION SELECT e.b, r.root FROM r JOIN e ON e.a=r.id), c AS (SELECT id, min(root) AS component FROM r GROUP BY 1)"
    " SELECT grain, component, count(*) AS size FROM c JOIN lab USING (id) GROUP BY 1, 2"
)
def label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of each label, named by their smallest voxel number."""
    _shared(spark)
    found = graph.grid_components(_spotted(spark, sf_dir), GRID)
    return found.groupBy("grain", F.col("component").cast("int").alias("component")).agg(F.count("*").alias("size"))


@query()
def repaired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels whose label changes when fragments are voted away."""
    _shared(spark)
    labels = _spotted(spark, sf_dir)
    return fields.override(labels, graph.repair(labels, GRID))


@query()
def orientation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grains whose orientations are linked by steps of at most 12 degrees, under cubic symmetry."""
    _shared(spark)
    q = T.quats(spark, sf_dir)
    both = q.select(F.col("grain").alias("a"), F.col("q").alias("p")).join(q.select(F.col("grain").alias("b"), "q"), F.expr("a < b"))
    near = both.where(G.disorientation_angle(F.col("p"), F.col("q"), T.cubic_symmetry()) <= 12).select("a", "b")
    return graph.components(q.select(F.col("grain").alias("id")), near).select(F.col("id").alias("grain"), "component")


# --- Doping and phases -------------------------------------------------------------------------------------

_SHARE, _ENRICH = 0.05, 3.0
_SITES = (
    f"{_SHELL}, st AS (SELECT id, grain, margin, margin <= 0.4::DOUBLE AS shell, ((id*48271+11)%99991)/99991.0::DOUBLE AS u FROM mg),"
    " n AS (SELECT count(*) FILTER (shell) AS ns, count(*) FILTER (NOT shell) AS nb, round_even(0.05::DOUBLE*count(*), 0) AS target FROM st),"
    " sites AS (SELECT st.*, u < (CASE WHEN shell THEN 3.0::DOUBLE*(target/(nb+3.0::DOUBLE*ns)) ELSE target/(nb+3.0::DOUBLE*ns) END) AS dopant FROM st, n)"
)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.margin(T.points(spark, sf_dir), T.seeds(spark, sf_dir), BOX, A.distance).withColumn("shell", F.col("margin") <= F.lit(SHELL))
    n = m.agg(F.count_if("shell").alias("s"), F.count_if(~F.col("shell")).alias("b")).first()  # two counts
    bulk, shell = doping.probabilities(doping.target_count(_SHARE, n.s + n.b), n.s, n.b, _ENRICH)
    draw = (F.col("id") * 48271 + 11) % 99991 / F.lit(99991.0)
    return doping.substitute(m, draw, bulk, shell)


@query(
    f"{_SITES} SELECT grain, count(*) AS n_sites, count(*) FILTER (dopant) AS n_dopant, count(*) FILTER (dopant AND shell) AS n_shell, count(*) FILTER (dopant AND NOT shell) AS n_bulk,"
    " round(coalesce(count(*) FILTER (dopant AND shell)/nullif(count(*) FILTER (shell), 0)::DOUBLE, 0), 6) AS fraction_shell,"
    " round(coalesce(count(*) FILTER (dopant AND NOT shell)/nullif(count(*) FILTER (NOT shell), 0)::DOUBLE, 0), 6) AS fraction_bulk FROM sites GROUP BY 1"
)
def doping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doping.bookkeeping(_sites(spark, sf_dir))
    return found.select("grain", "n_sites", "n_dopant", "n_shell", "n_bulk", R6(F.col("fraction_shell"), "fraction_shell"), R6(F.col("fraction_bulk"), "fraction_bulk"))


@query(
    f"{_SITES}, b AS (SELECT least(floor(margin/0.125::DOUBLE)::INT, 19) AS bin, count(*) AS c, count(*) FILTER (dopant) AS d FROM sites WHERE margin <= 2.5 GROUP BY 1)"
    " SELECT s.bin::INT AS bin, coalesce(c, 0) AS n_candidate, coalesce(d, 0) AS n_dopant, round(coalesce(d/c::DOUBLE, 0), 6) AS local_fraction FROM range(20) s(bin) LEFT JOIN b ON b.bin=s.bin"
)
def doping_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doping.profile(_sites(spark, sf_dir), F.col("margin"), 0.125, 20).withColumn("local_fraction", F.round("local_fraction", 6))


@query(
    f"{_SITES}, a AS (SELECT count(*) FILTER (dopant AND shell)/count(*) FILTER (shell)::DOUBLE AS fs, count(*) FILTER (dopant AND NOT shell)/count(*) FILTER (NOT shell)::DOUBLE AS fb,"
    " count(*) FILTER (dopant)/count(*)::DOUBLE AS f FROM sites) SELECT 'dopant_fraction' AS gate, abs(f-0.05) <= 0.01 AS passed, round(f, 6) AS measured FROM a"
    " UNION ALL SELECT 'dopant_enrichment', abs(fs/fb/3.0::DOUBLE-1) <= 0.15, round(fs/fb, 6) FROM a"
)
def doping_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Achieved share within a point of the target, achieved enrichment within 15 per cent."""
    d, s = F.col("dopant"), F.col("shell")
    one = _sites(spark, sf_dir).agg((F.count_if(d & s) / F.count_if(s)).alias("fs"), (F.count_if(d & ~s) / F.count_if(~s)).alias("fb"), (F.count_if(d) / F.count("*")).alias("f"))
    rows = F.array(
        F.struct(F.lit("dopant_fraction").alias("gate"), (F.abs(F.col("f") - 0.05) <= 0.01).alias("passed"), R6(F.col("f"), "measured")),
        F.struct(F.lit("dopant_enrichment").alias("gate"), (F.abs(F.col("fs") / F.col("fb") / 3.0 - 1) <= 0.15).alias("passed"), R6(F.col("fs") / F.col("fb"), "measured")),
    )
    return one.select(F.inline(rows))


@query()
def interstitial_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd points as candidates among even hosts, at least the cutoff apart from hosts and from each other."""
    _shared(spark)
    every = T.few_points(spark, sf_dir)
    return doping.interstitial(every.where("id % 2 = 1"), every.where("id % 2 = 0"), CUTOFF, BOX).select("id")


def _owners_sql() -> str:
    """SQL of (id, grain) of all points."""
    return f"WITH {POINTS}, {SEEDS}, {OFFSETS}, r AS (SELECT id, grain, row_number() OVER (PARTITION BY id ORDER BY {EUCLID}, grain) AS n FROM offs) SELECT id, grain FROM r WHERE n = 1"


@query()
def phase_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells dealt to three phases of half, three tenths and a fifth of the volume."""
    return doping.partition(_volumes(spark, sf_dir).select("grain", "volume"), [0.5, 0.3, 0.2])


@query(
    f"WITH {VOXELS}, w AS (SELECT phase, count(*)::DOUBLE AS v FROM voxels JOIN seeds USING (grain) GROUP BY 1), c AS (SELECT phase, count(*)::DOUBLE AS n FROM ({_owners_sql()}) JOIN seeds USING (grain) GROUP BY 1),"
    " b AS (SELECT coalesce(n, 0)/(SELECT sum(n) FROM c) AS p, coalesce(v, 0)/(SELECT sum(v) FROM w) AS q FROM c FULL JOIN w USING (phase)) SELECT round(sum(abs(p-q))/2, 6) AS tv FROM b"
)
def atom_volume_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation between shares of atoms and shares of volume by phase."""
    atoms = A.assign(T.points(spark, sf_dir), T.seeds(spark, sf_dir), BOX).groupBy("grain").agg(F.count("*").alias("n"))
    both = _volumes(spark, sf_dir).join(atoms, "grain", "left").groupBy("phase").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum("volume").alias("v"))
    total = F.broadcast(both.agg(F.sum("n").alias("tn"), F.sum("v").alias("tv")))
    return both.crossJoin(total).agg(R6(F.sum(F.abs(F.col("n") / F.col("tn") - F.col("v") / F.col("tv"))) / 2, "tv"))


@query(
    "WITH a AS (SELECT l_returnflag AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS s, count(*)::DOUBLE AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)"
    " SELECT s AS species, round(coalesce(b.n, 0)/(SELECT sum(n) FROM b) - a.n/(SELECT sum(n) FROM a), 6) AS drift FROM a FULL JOIN b USING (s)"
)
def composition_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each species' share from all sites to the kept ones (here: those of line status F)."""
    rows = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("species")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("m"))
    total = F.broadcast(rows.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm")))
    return rows.crossJoin(total).select("species", R6(F.col("m") / F.col("tm") - F.col("n") / F.col("tn"), "drift"))


# --- Crystals ----------------------------------------------------------------------------------------------

TILTED = crystal.reduce_tilts(crystal.cell_matrix(20.0, 21.0, 22.0, 80.0, 75.0, 70.0))
# Positions of the face-centred cubic cell.
FCC = [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)]


@query()
def close_pairs_triclinic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crystal.triclinic_pairs(T.few_points(spark, sf_dir), CUTOFF, TILTED).select("i", "j", R6(F.col("d2"), "d2"))


@query()
def filled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms per grain when every cell is filled with a turned face-centred cubic lattice of edge 2."""
    cells = T.seeds(spark, sf_dir)
    atoms = crystal.fill(cells.select("grain", "sx", "sy", "sz"), T.quats(spark, sf_dir), FCC, 2.0, BOX, BOX * 0.867)
    return cells.select("grain").join(atoms.groupBy("grain").agg(F.count("*").alias("n")), "grain", "left").select("grain", F.coalesce("n", F.lit(0)).alias("n_atoms"))


@query()
def random_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform and fibre orientations of every point, by counters and not by state."""
    u = [doping.uniform(k, F.col("id")) for k in range(4)]
    out = T.few_points(spark, sf_dir).select("id", crystal.haar(*u[:3]).alias("q"), crystal.fibre((1, 1, 1), (0, 0, 1), u[3]).alias("f"))
    return out.select("id", *[R6(F.col(f"{k}.{c}"), f"{k}_{c}") for k in "qf" for c in "wxyz"])
