"""Parts of solids, closed meshes and merged solids next to brute force."""

from gridloom.model import Grid
from gridloom.operators import combine, surface, tree
from pyspark.sql import functions as F


def brute_segments(voxels):
    left, out = set(voxels), {}
    while left:
        todo, part = [min(left)], []
        left.discard(todo[0])
        while todo:
            i, j, k = todo.pop()
            part.append((i, j, k))
            for o in ((i + 1, j, k), (i - 1, j, k), (i, j + 1, k), (i, j - 1, k), (i, j, k + 1), (i, j, k - 1)):
                if o in left:
                    left.discard(o)
                    todo.append(o)
        out |= {v: (*min(part), len(part)) for v in part}
    return out


def test_parts_of_scattered_voxels(spark):
    voxels = [(i, j, k) for i in range(12) for j in range(9) for k in range(9) if (i * 7919 + j * 104729 + k * 1299709) % 31 < 12]
    rows = [(*v, 1.0, True) for v in voxels]
    g = Grid(spark.createDataFrame(rows, "i int, j int, k int, value double, active boolean"))
    assert {(r.i, r.j, r.k): (r.si, r.sj, r.sk, r.n) for r in tree.segments(g).collect()} == brute_segments(voxels)


def test_parts_of_one_large_solid_and_of_none(spark):
    rows = [(i, j, 0, 1.0, True) for i in range(40) for j in range(40)]
    g = Grid(spark.createDataFrame(rows, "i int, j int, k int, value double, active boolean"))
    assert {tuple(r)[3:] for r in tree.segments(g).collect()} == {(0, 0, 0, 1600)}
    assert tree.segments(Grid(g.df.where("false"))).collect() == []


def octahedra(spark, centres, size):
    rows = []
    for x, y, z in centres:
        for sx in (-1, 1):
            for sy in (-1, 1):
                for sz in (-1, 1):
                    a, b, c = (x + sx * size, y, z), (x, y + sy * size, z), (x, y, z + sz * size)
                    rows.append(tuple(map(float, (*a, *b, *c) if sx * sy * sz > 0 else (*a, *c, *b))))
    return spark.createDataFrame(rows, ", ".join(f"{p}{a} double" for p in "aec" for a in "xyz"))


def test_insides_of_meshes(spark):
    """Also where corners and edges of the mesh stand on voxels, and where meshes overlap."""
    for centres in ([(0, 0, 0)], [(0.3, 0.2, -0.1)], [(0, 0, 0), (2, 0, 0)]):
        g = surface.mesh_level_set(octahedra(spark, centres, 3), 2.0)
        for r in g.df.collect():
            away = min(abs(r.i - x) + abs(r.j - y) + abs(r.k - z) for x, y, z in centres) - 3
            # A voxel on a mesh, if only one inside another, has no sign.
            assert abs(r.value) < 1e-9 or (r.value < 0) == (away < 0), (centres, r)


def test_merged_solids_equal_pairs(spark):
    make = lambda rows: Grid(spark.createDataFrame([(i, 0, 0, v, a) for i, v, a in rows], "i int, j int, k int, value double, active boolean"), 3.0)
    a, b = make([(0, -1.0, True), (1, 2.0, True), (2, 3.0, False)]), make([(1, -2.0, True), (3, 1.0, False)])
    rows = lambda g: sorted((r.i, r.value, r.active) for r in g.df.collect())
    for kind, pair in (("union", combine.union), ("intersection", combine.intersection), ("difference", combine.difference)):
        assert [r[:2] for r in rows(combine.merge_csg([a, b], kind))] == [r[:2] for r in rows(pair(a, b))], kind
    assert rows(combine.merge_csg([a, b], "union")) == [(0, -1.0, True), (1, -2.0, True), (2, 3.0, False), (3, 1.0, False)]


def test_points_by_value_of_empty_grids(spark):
    from gridloom.operators import points

    g = Grid(spark.range(0).select(*[F.lit(0).alias(c) for c in "ijk"], F.lit(1.0).alias("value"), F.lit(True).alias("active")))
    assert points.scattered_by_value(g, 2.0).collect() == []
