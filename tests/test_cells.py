import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import shapes
from tessera.operators import cells as C
from tessera.operators import overlap as O
from tessera.operators import replicas, texture
from tessera.plans import tables as T
from tessera.sources import config, files


@pytest.fixture(scope="module", autouse=True)
def shared(spark):
    T.shared(spark)


def seeds(spark, n, seed, weighted=False, length=(10.0, 11.0, 12.0)):
    r = random.Random(seed)
    rows = [(k, *(r.random() * v for v in length), r.random() if weighted else 0.0) for k in range(n)]
    return spark.createDataFrame(rows, "grain int, sx double, sy double, sz double, w double")


@pytest.mark.parametrize(("n", "weighted", "periodic"), [(12, False, (True, True, True)), (9, True, (True, True, True)), (1, False, (True, True, True)), (2, False, (True, False, True)), (7, True, (False, False, False))])
def test_cells_tile_the_box(spark, n, weighted, periodic):
    length = (10.0, 11.0, 12.0)
    s = seeds(spark, n, n, weighted)
    found = C.faces(s, length, periodic).cache()
    v = {r.grain: r for r in C.volumes(found).collect()}
    assert sum(r.volume for r in v.values()) == pytest.approx(10 * 11 * 12, rel=1e-9)
    assert all(r.euler == 2 for r in C.euler(s, found, length).collect())
    walls = found.where("neighbor < 0").agg(F.sum("area")).first()[0] or 0
    assert walls == pytest.approx(sum(2 * 10 * 11 * 12 / length[k] for k in range(3) if not periodic[k]), rel=1e-9)


def test_bicrystal(spark):
    s = spark.createDataFrame([(0, 5.0, 10.0, 10.0), (1, 15.0, 10.0, 10.0)], "grain int, sx double, sy double, sz double")
    found = C.faces(s, (20.0, 20.0, 20.0)).cache()
    assert {(r.grain_i, r.grain_j, round(r.area, 6)) for r in C.graph(found).collect()} == {(0, 1, 800.0)}
    at = spark.createDataFrame([(1, 5.0, 3.0, 3.0, 0), (2, 9.0, 3.0, 3.0, 0), (3, 10.5, 3.0, 3.0, 1)], "id long, x double, y double, z double, grain int")
    assert [round(r.margin, 6) for r in C.face_margin(at, s, found, (20.0, 20.0, 20.0)).orderBy("id").collect()] == [3.0, 1.0, 0.5]  # faces to own images count
    assert C.triple_line_length(s, found, (20.0, 20.0, 20.0)).first().length == 0


def brute(found):
    gone = set()
    for i, j, k in sorted(found):
        if i not in gone and j not in gone:
            gone.add(k)
    return gone


def test_losers_are_those_of_a_scan(spark):
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(80), 2))) for _ in range(60)})
    pairs = [(i, j, r.choice((i, j))) for i, j in pairs] + [(1000 + k, 1001 + k, 1001 + k) for k in range(400)]
    got = {x.id for x in O.losers(spark.createDataFrame(pairs, "i long, j long, loser long").coalesce(1)).collect()}
    assert got == brute(pairs)


def test_merging_leaves_no_close_pair_of_two_grains(spark):
    r = random.Random(2)
    rows = [(k, r.random() * 6, r.random() * 6, r.random() * 6, r.randrange(3), 0.0, "A") for k in range(250)]
    atoms = spark.createDataFrame(rows, "id long, x double, y double, z double, grain int, margin double, species string")
    left = O.merge(atoms, 0.6, 6.0)
    assert O.close(left, 0.6, 6.0).where("grain_i <> grain_j").count() == 0 and 100 < left.count() < 250
    one = spark.createDataFrame([(1, 5.9, 1.0, 1.0, 0, 0.0, "A"), (2, 0.1, 1.0, 1.0, 1, 0.0, "A")], atoms.schema)
    x = O.merge(one, 0.6, 6.0).collect()
    assert len(x) == 1 and x[0].id == 1 and min(x[0].x, 6 - x[0].x) < 1e-9
    with pytest.raises(ValueError):
        O.merge(one.withColumn("species", F.when(F.col("id") == 1, "B").otherwise("A")), 0.6, 6.0)


def test_groups_are_closed_and_cleaned():
    assert [len(texture.group(f)) for f in ("cubic", "hexagonal", "trigonal", "tetragonal", "orthorhombic", "monoclinic", "triclinic")] == [24, 12, 6, 8, 4, 2, 1]
    r = [np.diag(v).astype(float) for v in ((1, 1, 1), (-1, -1, 1), (1, 1, -1), (1, 1, 1))]
    assert len(texture.proper_quats(np.array(r))) == 2
    q = texture.between((1, 0, 0), (-1, 0, 0))
    assert abs(q[0]) < 1e-12 and abs(q[1]) < 1e-12
    o = texture.of_plane_and_direction((1, 1, 0), (0, 0, 1), np.eye(3))
    assert abs(np.linalg.norm(o) - 1) < 1e-12
    d = texture.Drift(np.array([1.0, 2.0, 3.0]), np.array([0, 0, 1]))
    assert d.swap(0, 2) == pytest.approx(1 / 3) and d.swap(0, 2) == pytest.approx(0, abs=1e-12)


def test_generators():
    p = replicas.hard_seeds(40, (10.0, 10.0, 10.0), 1.5, 1, (True, True, False))
    d = p[:, None] - p[None]
    d[..., :2] -= np.rint(d[..., :2] / 10) * 10
    assert np.linalg.norm(d, axis=2)[np.triu_indices(40, 1)].min() >= 1.5
    with pytest.raises(RuntimeError):
        replicas.hard_seeds(100, (2.0, 2.0, 2.0), 1.5, 1, tries=20)
    assert replicas.hurst(replicas.random_field(32, 10.0, 2, "self_affine", hurst=0.5), 10.0) == pytest.approx(0.5, abs=0.15)
    f = replicas.random_field(16, 10.0, 2)
    assert abs(f.mean()) < 1e-12 and f.std() == pytest.approx(1)
    assert replicas.target_volumes(3, 6.0, "list", given=[1, 2, 3]).tolist() == [1, 2, 3]
    assert replicas.colored([(0, 1), (1, 2), (0, 2), (2, 3)], [0, 1, 2, 3]) == {2: 0, 0: 1, 1: 2, 3: 1}
    assert replicas.wigner_seitz(4 * math.pi / 3, 1) == pytest.approx(1)
    assert replicas.misfit(np.diag([4.0, 4.0, 4.1]), np.eye(3)) == pytest.approx(0.1)


def test_ownership_by_images(spark):
    s = spark.createDataFrame([(0, 2.0, 5.0, 5.0), (1, 7.0, 5.0, 5.0)], "grain int, sx double, sy double, sz double")
    at = spark.createDataFrame([(1, 0, 3.0, 5.0, 5.0), (2, 0, 5.0, 5.0, 5.0), (3, 0, -1.0, 5.0, 5.0), (4, 0, 4.4, 5.0, 5.0), (5, 0, 4.5, 5.0, 5.0), (6, 1, 4.5, 5.0, 5.0)], "id long, grain int, x double, y double, z double")
    images = replicas.replicated(s, (10.0, 10.0, 10.0), (True, True, True))
    assert {r.id for r in replicas.owns(at, images).collect()} == {1, 4, 5, 6}
    assert {r.id for r in at.where(replicas.inside((10.0, 10.0, 10.0), (False, True, True))).collect()} == {1, 2, 4, 5, 6}


def test_polygons(spark):
    square = [[0.0, 0.0, 1.0], [2.0, 0.0, 1.0], [2.0, 1.0, 1.0], [0.0, 1.0, 1.0]]
    df = spark.createDataFrame([([square[k] for k in (0, 2, 1, 3)], [0.0, 0.0, 1.0])], "p array<array<double>>, n array<double>")
    p = shapes.polygon_order(F.col("p"), F.col("n"))
    r = df.select(p.alias("o")).select(shapes.polygon_area(F.col("o")), shapes.polygon_centroid(F.col("o"))).first()
    assert r[0] == pytest.approx(2) and r[1] == pytest.approx([1, 0.5, 1])
    assert df.select(shapes.polygon_area(F.slice("p", 1, 2))).first()[0] == 0
    assert shapes.cutoff("0.85*d_nn", 2.0) == pytest.approx(1.7) and shapes.cutoff("2.5", 1.0) == 2.5 and shapes.cutoff("d_nn", 3.0) == 3.0
    for bad in ("x", "-1", "0"):
        with pytest.raises(ValueError):
            shapes.cutoff(bad, 1.0)


def test_rules_of_a_request(tmp_path):
    good = {"seed": {"mode": "fixed", "value": 1}, "box": {"lengths": [40, 40, 40]}, "grains": {"number": 4}, "crystal": {"space_group": 225, "lattice": {"a": 3.615}, "sites": [{"species": "Cu"}]}}
    assert config.check(good) == [] and config.validated(good) is good
    broken = {
        "1": {"seed": {"mode": "fixed"}}, "16": {"grains": {}}, "28": {"box": {}}, "2": {"box": {"lengths": [1, 1, 1], "vacuum": 5}}, "21": {"phases": [{"fraction": 1.0}]},
        "4": {"crystal": {"space_group": 194}, "analysis": {"csl": True}}, "6": {"grains": {"number": 4, "curved": {}}}, "24": {"grains": {"number": 1, "geometry": "curved", "curved": {"method": "warp"}}},
        "5b": {"crystal": {"sites": [{"occupancy": {"A": 0.5, "B": 0.6}}]}}, "14": {"mdf": {"target": {"histogram": [0, 0]}}},
    }
    for rule, change in broken.items():
        assert rule in [r for r, _, _ in config.check(good | change)], rule
        with pytest.raises(ValueError):
            config.validated(good | change)
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"))
    assert config.digest({"a": 1, "b": 2}) == config.digest({"b": 2, "a": 1})


def test_manifest_is_strict_and_sections_are_told_apart(spark, tmp_path):
    m = tmp_path / "MANIFEST"
    m.write_text("# made\n" + "a" * 64 + "  12  x.csv\n")
    assert [tuple(r) for r in files.read_manifest(spark, str(m)).collect()] == [("a" * 64, 12, "x.csv")]
    for bad in ("nonsense\n", "a" * 64 + "  1  ../x\n"):
        m.write_text(bad)
        with pytest.raises(Exception, match="not a manifest entry"):
            files.read_manifest(spark, str(m)).collect()
    m.write_text(("a" * 64 + "  12  x.csv\n") * 2)
    with pytest.raises(ValueError, match="twice"):
        files.read_manifest(spark, str(m))
    d = tmp_path / "atoms.data"
    d.write_text("made\n\n2 atoms\n1 atom types\n\nMasses\n\n1 63.5 # Cu\n\nAtoms # atomic\n\n1 1 0.5 1.5 2.5 0 0 1\n2 1 3 4 5\n\nVelocities\n\n1 0 0 0\n2 1 1 1 1\n")
    assert [tuple(r) for r in files.read_atom_rows(spark, str(d), molecular=False).orderBy("id").collect()] == [(1, None, 1, 0.5, 1.5, 2.5), (2, None, 1, 3.0, 4.0, 5.0)]
    first, last = files.ends(spark.range(10), "id", 2)
    assert [r.id for r in first.collect()] == [0, 1] and [r.id for r in last.collect()] == [8, 9]
    v = spark.createDataFrame([("a", "1.0"), ("b", "1.0")], "file string, version string")
    assert files.versions_agree(v).first().passed and not files.versions_agree(v.union(spark.createDataFrame([("c", "2")], v.schema))).first().passed


def _jobs(spark, run):
    name = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(name, "")
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("turn", [100, 10**6])
def test_a_dense_scan_takes_few_jobs(spark, monkeypatch, turn):
    from tessera.operators import pairs as P

    monkeypatch.setattr(P, "TURN", turn, raising=False)
    r = random.Random(9)
    found = [(i, j, r.choice((i, j))) for i in range(40) for j in range(i + 1, 40)]
    df = spark.createDataFrame(found, "i long, j long, loser long").coalesce(1)
    got, jobs = _jobs(spark, lambda: {x.id for x in P.resolve(df, F.col("loser")).collect()})
    assert got == brute(found)
    assert jobs < (100 if turn < len(found) else 20)  # rounds took hundreds


def test_one_atom_among_many_is_scanned_at_once(spark):
    from tessera.operators import pairs as P

    df = spark.range(1, 1203).selectExpr("0L as i", "id as j")
    assert P.resolve(df, F.col("j")).count() == 1202


@pytest.mark.parametrize("policy", ["delete_shallower", "keep_lower_id"])
def test_removal_of_a_crowd_equals_a_scan(spark, policy):
    r = random.Random(4)
    rows = [(k, r.random() * 3, r.random() * 3, r.random() * 3, r.randrange(3), r.randrange(4) / 4, "AB"[k % 2]) for k in range(150)]
    at = {x[0]: x for x in rows}
    found = []
    for i in range(150):
        for j in range(i + 1, 150):
            d = [a - b for a, b in zip(at[i][1:4], at[j][1:4], strict=True)]
            if sum((v - 3 * round(v / 3)) ** 2 for v in d) < 0.49:
                (gi, mi), (gj, mj) = at[i][4:6], at[j][4:6]
                later = i if gi > gj else j
                found.append((i, j, later if policy == "keep_lower_id" or mi == mj else i if mi < mj else j))
    atoms = spark.createDataFrame(rows, "id long, x double, y double, z double, grain int, margin double, species string")
    (kept, gone), jobs = _jobs(spark, lambda: O.remove(atoms, 0.7, 3.0, policy))
    assert {x.id for x in gone.collect()} == brute(found) and jobs < 20
    assert O.left_over(kept, 0.7, 3.0) == 0
    near = O.rule(O.close(atoms, 0.7, 3.0), policy)
    assert sum(x.n for x in O.ledger(atoms, gone, near).where("kind = 'pair'").collect()) == len(brute(found))


def test_merging_takes_as_many_passes_as_it_needs(spark):
    # One atom of grain 0 meets all others, and merges with one of them a pass.
    rows = [(k, 1.0, 1.0, 1.0, min(k, 1), 0.0, "A") for k in range(23)]
    atoms = spark.createDataFrame(rows, "id long, x double, y double, z double, grain int, margin double, species string")
    assert [tuple(x) for x in O.merge(atoms, 0.5, 4.0).collect()] == [rows[0]]


def test_points_left_are_scanned_without_listing_pairs(spark, monkeypatch):
    from tessera.operators import pairs as P

    monkeypatch.setattr(P, "ASKING", 7)
    r = random.Random(31)
    rows = [(k * 3 - 50, r.random() * 3, r.random() * 3, r.random() * 3) for k in range(200)] + [(None, 1.0, 1.0, 1.0), (900, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3)
    listed = [0]

    def pairs():
        listed[0] += 1
        return P.range_pairs(df, 0.7, 3.0).withColumn("loser", F.col("j"))

    run = lambda: {x.id for x in P.losers_of(df, 0.7, 3.0, False, (), lambda k, others, ranks: np.zeros(len(others), dtype=bool), pairs).collect()}
    got = run()
    assert not listed[0] and got == brute([(x.i, x.j, x.loser) for x in pairs().collect()])
    monkeypatch.setattr(P, "POINTS", 10)
    assert run() == got and listed[0] == 2


@pytest.mark.parametrize("policy", ["keep_lower_id", "delete_shallower"])
def test_ledger_lists_no_pairs(spark, monkeypatch, policy):
    from tessera.operators import pairs as P

    r = random.Random(8)
    nan = float("nan")
    rows = [(k * 7 % 601, r.random() * 3, r.random() * 3, r.random() * 3, r.choice((0, 1, 2, None)), r.choice((0.1, 0.2, r.random(), nan, None)), r.choice("AB")) for k in range(300)]
    rows += [(None, 1.0, 1.0, 1.0, 0, 0.0, "A"), (900, None, 1.0, 1.0, 0, 0.0, "A"), (901, nan, 1.0, 1.0, 0, 0.0, "A")]
    for some in (rows, rows + rows[:3]):  # ids that repeat have their pairs listed
        atoms = spark.createDataFrame(some, "id long, x double, y double, z double, grain int, margin double, species string")
        near = O.rule(O.close(atoms, 0.5, 3.0), policy).checkpoint()
        want = sorted(map(str, O.ledger(atoms, O.losers(near), near).collect()))
        with monkeypatch.context() as m:
            if some is rows:
                m.setattr(P, "scan", None)
                m.setattr(P, "ASKING", 50)
            assert sorted(map(str, O.removal_ledger(atoms, 0.5, 3.0, policy).collect())) == want and len(want) > 3


def test_merging_ends_in_one_task(spark, monkeypatch):
    from tessera.operators import pairs as P

    monkeypatch.setattr(P, "LOOSE", 9)
    r = random.Random(12)
    rows = [(k * 7 % 601, r.random() * 3 - 1, r.random() * 3, r.random() * 3, r.choice((0, 1, 2, None)), 0.0, "A") for k in range(300)] + [(None, 1.0, 1.0, 1.0, 0, 0.0, "A"), (900, None, 1.0, 1.0, 0, 0.0, "A")]
    atoms = spark.createDataFrame(rows, "id long, x double, y double, z double, grain int, margin double, species string")
    now, passes = P.written(atoms), 0
    while not (taken := O.merging(now, 0.4, 3.0)).isEmpty():
        now, passes = P.written(O.merge_once(now, 0.4, 3.0, taken)), passes + 1
    got, jobs = _jobs(spark, lambda: sorted(map(str, O.merge(atoms, 0.4, 3.0).collect())))
    assert got == sorted(map(str, now.collect())) and passes > 3
    assert jobs < 40 and len(O.merge(spark.createDataFrame(rows + rows[:1], atoms.schema), 0.4, 3.0).columns) == 7


@pytest.mark.parametrize("both", [False, True])
def test_scan_without_lists_equals_a_scan_of_all_pairs(monkeypatch, both):
    from tessera.operators import pairs as P

    rng, box = np.random.default_rng(5), 4.0
    for size, cutoff, share in ((1, 0.5, 0.9), (900, 0.5, 1 / 64), (900, 0.9, 0.9), (400, 2.0, 0.5)):
        monkeypatch.setattr(P, "SHARE", share)
        m = int(box // cutoff)
        at = rng.random((size, 3)) * box
        number = P._number(np.minimum((at / (box / m)).astype(np.int64), m - 1).T, (m, m, m))
        rank = rng.permutation(size)
        by = np.lexsort((rank, number))
        at, number, rank, deep = at[by], number[by], rank[by], rng.integers(0, 40, size)

        def near(i, j):
            return (((d := at[i] - at[j]) - np.rint(d / box) * box) ** 2).sum(axis=1) < cutoff**2

        got, i, j = P.scanned(number, rank, (m, m, m), near, lambda i, j: deep[i] < deep[j], both)
        gone, pairs = np.zeros(size, dtype=int), []
        order = np.argsort(rank)
        for k, a in enumerate(order.tolist()):
            others = order[k + 1 :]
            for b in others[near(np.full(len(others), a), others)].tolist():
                if not gone[a] and not gone[b] and (not both or deep[a] < deep[b]):
                    gone[[a, b] if both else a if deep[a] < deep[b] else b] = 1
                    pairs += [(a, b)] if both else []
        assert list(got) == gone.tolist() and list(zip(i, j, strict=True)) == pairs


def test_removal_lists_no_pairs(spark, monkeypatch):
    from tessera.operators import pairs as P

    monkeypatch.setattr(P, "near_pairs", lambda *a, **k: 1 / 0)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, *map(float, rng.random(3) * 3), int(rng.integers(4)), float(rng.random()), "A") for k in range(500)], "id long, x double, y double, z double, grain int, margin double, species string")
    left, gone = O.remove(df, 0.7, 3.0)
    assert left.count() + gone.count() == 500 > left.count()
