"""Operators without SQL against brute force, round trips and known values."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import crystal, doping, graph, kernel, pairs
from tessera.sources import files, sinks


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def test_triclinic_pairs_equal_all_images(spark):
    random.seed(2)
    h = np.array(crystal.reduce_tilts(crystal.cell_matrix(5.0, 6.0, 7.0, 70.0, 65.0, 60.0)))
    pts = [(i, *(h @ [random.random() * 3 - 1 for _ in range(3)])) for i in range(60)]
    steps = [h @ s for s in itertools.product(range(-4, 5), repeat=3)]
    want = {}
    for a, b in itertools.combinations(pts, 2):
        d = np.array(a[1:]) - np.array(b[1:])
        d2 = min(float(((d + s) ** 2).sum()) for s in steps)
        if d2 <= 1.21:
            want[a[0], b[0]] = round(d2, 6)
    df = spark.createDataFrame([(i, *map(float, p)) for i, *p in pts], "id long, x double, y double, z double")
    got = {(r.i, r.j): round(r.d2, 6) for r in crystal.triclinic_pairs(df, 1.1, tuple(map(tuple, h.tolist()))).collect()}
    assert got == want and want


def test_tilts_are_reduced_within_one_lattice():
    h = np.array(((100.0, 171.0, 321.0), (0.0, 100.0, 231.0), (0.0, 0.0, 100.0)))
    r = np.array(crystal.reduce_tilts(tuple(map(tuple, h.tolist()))))
    change = np.linalg.solve(h, r)
    assert np.allclose(change, np.rint(change)) and abs(round(np.linalg.det(change))) == 1
    assert abs(r[0, 1]) <= 50 and abs(r[0, 2]) <= 50 and abs(r[1, 2]) <= 50


def test_interstitial_sites_equal_a_scan(spark):
    random.seed(3)
    pts = [(i, *(random.random() * 4 for _ in range(3))) for i in range(120)]
    near = lambda a, b: sum((d - 4 * round(d / 4)) ** 2 for d in (x - y for x, y in zip(a[1:], b[1:], strict=True))) < 0.49
    hosts, candidates = pts[:30], pts[30:]
    kept = []
    for c in candidates:
        if not any(near(c, h) for h in hosts) and not any(near(c, k) for k in kept):
            kept.append(c)
    schema = "id long, x double, y double, z double"
    got = doping.interstitial(spark.createDataFrame(candidates, schema), spark.createDataFrame(hosts, schema), 0.7, 4.0)
    assert {r.id for r in got.collect()} == {k[0] for k in kept}


@pytest.mark.parametrize(("volumes", "shares"), [([5.0, 4.0, 3.0, 2.0, 1.0], [0.5, 0.5]), ([9.0, 1.0, 1.0], [0.9, 0.05, 0.05]), ([1.0, 1.0, 1.0, 1.0], [0.7, 0.2, 0.1])])
def test_partition_equals_the_greedy_scan(spark, volumes, shares):
    lack, want, empty = [s * sum(volumes) for s in shares], {}, set(range(len(shares)))
    order = sorted(range(len(volumes)), key=lambda g: (-volumes[g], g))
    for n, g in enumerate(order):
        open_ = empty if len(empty) == len(order) - n else range(len(shares))
        want[g] = min(open_, key=lambda p: (-lack[p], p))
        lack[want[g]] -= volumes[g]
        empty.discard(want[g])
    df = spark.createDataFrame(list(enumerate(volumes)), "grain int, volume double")
    assert {r.grain: r.part for r in doping.partition(df, shares).collect()} == want


def test_partition_needs_a_cell_for_each_part(spark):
    with pytest.raises(ValueError, match="fewer"):
        doping.partition(spark.createDataFrame([(0, 1.0)], "grain int, volume double"), [0.5, 0.5])


def test_chances_give_the_target():
    bulk, shell = doping.probabilities(50, 100, 900, 3.0)
    assert shell == 3 * bulk and math.isclose(100 * shell + 900 * bulk, 50)
    with pytest.raises(ValueError):
        doping.probabilities(500, 100, 10, 9.0)
    with pytest.raises(ValueError):
        doping.probabilities(1, 0, 0, 1.0)
    assert doping.probabilities(0, 0, 0, 1.0) == (0.0, 0.0)


def _parts(labels, n):
    seen, out = {}, collections.defaultdict(list)
    for v in sorted(labels):
        if v in seen:
            continue
        todo, seen[v] = [v], True
        part = []
        while todo:
            u = todo.pop()
            part.append(u)
            for a, d in itertools.product(range(3), (-1, 1)):
                w = tuple((c + d) % n if k == a else c for k, c in enumerate(u))
                if labels[w] == labels[u] and w not in seen:
                    seen[w] = True
                    todo.append(w)
        out[labels[v]].append(part)
    return out


def test_repair_equals_the_votes(spark):
    random.seed(5)
    n = 6
    labels = {(i, j, k): (0 if i < 3 else 1) for i, j, k in itertools.product(range(n), repeat=3)}
    for v in random.sample(sorted(labels), 22):
        labels[v] = random.randrange(3)
    labels[5, 5, 5] = labels[5, 5, 4] = 2
    df = spark.createDataFrame([(*v, g) for v, g in labels.items()], "i int, j int, k int, grain int")
    while True:
        lost = {v for parts in _parts(labels, n).values() for p in sorted(parts, key=lambda p: (-len(p), min(p)))[1:] for v in p}
        if not lost:
            break
        new = dict(labels)
        for u in lost:
            votes = collections.Counter(labels[w] for a, d in itertools.product(range(3), (-1, 1)) if (w := tuple((c + d) % n if k == a else c for k, c in enumerate(u))) not in lost)
            if votes:
                new[u] = min(votes, key=lambda g: (-votes[g], g))
        labels = new
    assert {(r.i, r.j, r.k): r.grain for r in graph.repair(df, n).collect()} == labels


def test_components_of_a_long_path_and_of_lone_nodes(spark):
    ids = list(range(40))
    random.seed(6)
    random.shuffle(ids)
    nodes = spark.createDataFrame([(i,) for i in range(42)], "id long")
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {i: 0 if i < 40 else i for i in range(42)}


def test_curvature_of_a_sphere_and_of_a_plane(spark):
    h, at = 0.01, (3.0, 4.0, 0.0)
    sphere = {o: F.lit(math.dist((0, 0, 0), [a + h * d for a, d in zip(at, o, strict=True)])) for o in G.STENCIL}
    plane = {o: F.lit(1.0 * o[0] * h) for o in G.STENCIL}
    s, p = spark.range(1).select(G.curvature(sphere, h).alias("s"), G.curvature(plane, h).alias("p")).first()
    assert abs(abs(s.mean) - 1 / 5) < 1e-4 and abs(s.gauss - 1 / 25) < 1e-4 and s.ok
    assert abs(p.mean) < 1e-9 and abs(p.gauss) < 1e-9


def test_euler_angles_where_the_tilt_is_nought(spark):
    row = spark.createDataFrame([(30.0, 0.0, 15.0), (350.0, 180.0, 20.0), (10.0, 90.0, 200.0)], "a double, b double, c double")
    q = row.withColumn("q", G.from_bunge(F.col("a"), F.col("b"), F.col("c")))
    got = [tuple(round(x, 5) for x in r[0]) for r in q.select(G.bunge(F.col("q"))).collect()]
    assert got == [(45.0, 0.0, 0.0), (330.0, 180.0, 0.0), (10.0, 90.0, 200.0)]


def test_axis_of_the_identity_and_of_no_axis(spark):
    zero, one = F.lit(0.0), F.lit(1.0)
    r = spark.range(1).select(G.axis_angle(G.quat(one, zero, zero, zero)).alias("i"), G.from_axis_angle(zero, zero, zero, one).alias("n")).first()
    assert tuple(r.i) == (0.0, 0.0, 1.0, 0.0) and r.n is None


def test_kernel_constants():
    k = kernel.degree(20.0)
    assert abs(math.cos(math.radians(20) / 2) ** (2 * k) - 0.5) < 0.01
    x = (np.arange(20000) + 0.5) / 20000 * math.pi  # rotation angles, with their density on the group
    assert abs(np.mean(kernel.norm(k) * np.cos(x / 2) ** (2 * k) * (1 - np.cos(x)) / math.pi) * math.pi - 1) < 1e-6


def test_filled_cells_hold_the_lattice_density(spark, sf_dir):
    from tessera.plans.catalog import QUERIES

    n = QUERIES["filled_cells"](spark, sf_dir).agg(F.sum("n_atoms")).first()[0]
    assert abs(n - 4000) <= 80


def _atoms(spark):
    random.seed(8)
    rows = [(g, o, *(random.random() * 9 for _ in range(3)), random.choice(["Cu", "Al"])) for g in (2, 0, 1) for o in (5, 1, 3)]
    return rows, spark.createDataFrame(rows, "grain int, ord long, x double, y double, z double, species string")


@pytest.mark.parametrize("molecular", [True, False])
def test_atom_files_read_back(spark, tmp_path, molecular):
    rows, df = _atoms(spark)
    sinks.write_atoms(df, f"{tmp_path}/a", (9.0, 9.0, 9.0), {"Cu": 63.546, "Al": 26.982}, molecular, (1.0, -2.0, 0.5))
    got = files.read_atom_rows(spark, f"{tmp_path}/a/*", molecular).orderBy("id").collect()
    want = [(n + 1, r[0] + 1 if molecular else None, 1 + (r[5] == "Cu"), *r[2:5]) for n, r in enumerate(sorted(rows))]
    assert [tuple(r) for r in got] == want
    head = {(r.key, r.a) for r in files.read_header(spark, f"{tmp_path}/a/header").collect()}
    assert {("atoms", 9.0), ("types", 2.0), ("x", 0.0), ("y", 0.0), ("z", 0.0), ("tilt", 1.0), ("mass", 1.0), ("mass", 2.0)} == head
    with pytest.raises(ValueError, match="mass"):
        sinks.write_atoms(df, f"{tmp_path}/b", (9.0, 9.0, 9.0), {"Cu": 1.0})


def test_xyz_files_read_back(spark, tmp_path):
    rows, df = _atoms(spark)
    sinks.write_xyz(df, f"{tmp_path}/x", (9.0, 9.0, 9.0))
    got = {tuple(r) for r in files.read_xyz(spark, f"{tmp_path}/x/*").collect()}
    assert got == {(r[5], *r[2:5], r[0]) for r in rows}


def test_label_fields_become_dense_labels(spark, tmp_path):
    labels = np.array([7, 3, 3, 900, 7, 7, 3, 900, 7, 7, 7, 3]).reshape(2, 3, 2)
    np.save(f"{tmp_path}/l.npy", labels)
    got = {(r.i, r.j, r.k): (r.label, r.grain) for r in files.dense(files.read_label_fields(spark, f"{tmp_path}/l.npy")).collect()}
    assert got == {v: (labels[v], {3: 0, 7: 1, 900: 2}[labels[v]]) for v in np.ndindex(labels.shape)}


def test_manifest_tells_changed_missing_and_extra_files(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    for name in "abc":
        (folder / name).write_text(name)
    before = spark.createDataFrame(sinks.manifest(spark, str(folder)).collect())
    (folder / "a").write_text("changed")
    (folder / "b").unlink()
    (folder / "d").write_text("d")
    status = {r.path: r.status for r in sinks.verify(before, sinks.manifest(spark, str(folder))).collect()}
    assert status == {"a": "FAIL", "b": "MISSING", "c": "OK", "d": "EXTRA"}
    line = before.select(F.concat_ws("  ", "sha256", F.col("size").cast("string"), "path"))
    line.write.text(f"{tmp_path}/m")
    assert {tuple(r) for r in files.read_manifest(spark, f"{tmp_path}/m").collect()} == {tuple(r) for r in before.select("sha256", "size", "path").collect()}


def test_reports_flatten_and_json(spark, tmp_path):
    df = spark.sql("select 1 as a, named_struct('b', 2.5D, 'c', named_struct('d', 'x')) as s, array(3, 4) as l, cast('NaN' as double) as n")
    got = {(r.key, r.value) for r in sinks.flatten(df, "t").collect()}
    assert got == {("a", "1"), ("s.b", "2.5"), ("s.c.d", "x"), ("l[0]", "3"), ("l[1]", "4"), ("n", "NaN")}
    assert sinks.json_rows(df.select("a", "n")).first().value == '{"a":1,"n":null}'
    sinks.write_report(df.select("a", "n"), f"{tmp_path}/r", ["a"])
    assert spark.read.csv(f"{tmp_path}/r", header=True).first().n == "nan"


def _lattice(n, box, seed):
    random.seed(seed)
    return [(i, *(random.random() * box for _ in range(3))) for i in range(n)]


def _square(a, b, box):
    return sum((d - box * round(d / box)) ** 2 for d in (x - y for x, y in zip(a[1:4], b[1:4], strict=True)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SCHEMA = "id long, x double, y double, z double"


def test_triclinic_pairs_meet_without_a_join(spark):
    h = crystal.reduce_tilts(crystal.cell_matrix(5.0, 6.0, 7.0, 70.0, 65.0, 60.0))
    assert "Join" not in _plan(crystal.triclinic_pairs(spark.createDataFrame(_lattice(20, 5.0, 1), SCHEMA), 1.1, h))


@pytest.mark.parametrize(("box", "cutoff"), [(4.0, 0.7), (4.0, 2.5), (4.0, 1.9), (12.0, 0.9)])
def test_range_pairs_and_far_points_equal_all_pairs(spark, box, cutoff):
    pts = [*_lattice(200, box, 7), (200, box, 0.0, -0.1), (201, 0.0, box, box)]
    df = spark.createDataFrame(pts, SCHEMA)
    want = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if _square(a, b, box) <= cutoff * cutoff}
    assert {(r.i, r.j) for r in pairs.range_pairs(df, cutoff, box).collect()} == want
    odd, even = pts[1::2], pts[:40:2]
    extra = spark.createDataFrame([(*p, str(p[0])) for p in [*odd, (999, None, None, None)]], SCHEMA + ", name string")
    far = pairs.far_from(extra, spark.createDataFrame(even, SCHEMA), cutoff, box)
    assert "Join" not in _plan(far) and far.columns == ["id", "x", "y", "z", "name"]
    alone = {str(p[0]) for p in odd if all(_square(p, q, box) >= cutoff * cutoff for q in even)} | {"999"}
    assert sorted(r.name for r in far.collect()) == sorted(alone)


def test_interstitial_search_broadcasts_nothing(spark):
    both = spark.createDataFrame(_lattice(60, 4.0, 3), SCHEMA)
    plan = _plan(doping.interstitial(both.where("id % 2 = 1"), both.where("id % 2 = 0"), 0.7, 4.0))
    assert "NestedLoop" not in plan and "BroadcastExchange" not in plan.split("LeftAnti")[0]
