"""Surface meshes with fewer polygons where the surface is flat.

Each cell that the surface crosses has a vertex and a plane: through the vertex, across the gradient. Cells merge
bottom-up, two by two by two, inside their leaf. A node's quadric is the sum of its cells' (squared distances to their
planes), so a level is one aggregation of the level below it. A node merges if all its children have and if the point
that its quadric puts the vertex at is within the tolerance of all planes together, and so of each. Two sheets or a sharp
edge in one node have no such point, so they stay apart.

Polygons are the quads between cells with each cell replaced by its node. Those that fall into less than three nodes
vanish. As the merging maps vertices to vertices, each edge that remains is still shared by an even number of polygons:
a closed mesh stays closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, LEAF, Grid
from gridloom.operators.band import Stages, staged
from gridloom.operators.surface import cells, corner, rings, vertices
from gridloom.operators.tree import _written

SUMS = ["a00", "a01", "a02", "a11", "a12", "a22", "b0", "b1", "b2", "c", "s0", "s1", "s2", "m"]
#: Share of the identity in a node's quadric: holds vertices of flat nodes at their mean.
HOLD = 0.01


def planes() -> Stages:
    """Quadrics of cells (corners and x, y, z), in coordinates from the origin of their leaf."""
    side = lambda n, v: " + ".join(corner(o) for o in [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)] if o[n] == v)
    slopes = {f"g{n}": f"({side(n, 1)} - ({side(n, 0).replace(' + ', ' - -1 * ')})) / 4" for n in range(3)}
    local = {f"s{n}": f"{a} - (({c} >> {LEAF}) * {1 << LEAF})" for n, (a, c) in enumerate(zip("xyz", IJK))}
    steep = {"steep": "greatest(sqrt(g0 * g0 + g1 * g1 + g2 * g2), cast(1e-12 as double))"}
    unit = {f"u{n}": f"g{n} / steep" for n in range(3)}
    reach = {"reach": "u0 * s0 + u1 * s1 + u2 * s2"}
    squares = {f"a{p}{q}": f"u{p} * u{q}" for p in range(3) for q in range(p, 3)}
    return [{**slopes, **local}, steep, unit, reach, {**squares, **{f"b{n}": f"u{n} * reach" for n in range(3)}, "c": "reach * reach", "m": "cast(1 as double)"}]


def placed(level: int) -> Stages:
    """Where a node's vertex goes (x0, x1, x2 from its leaf's origin, inside the node) and its ``error``, a square."""
    mean = {f"p{n}": f"s{n} / m" for n in range(3)}
    a = lambda p, q: f"a{min(p, q)}{max(p, q)}" if p != q else f"(a{p}{p} + {HOLD} * m)"
    rest = {f"r{n}": f"b{n} - ({' + '.join(f'a{min(n, q)}{max(n, q)} * p{q}' for q in range(3))})" for n in range(3)}
    minor = {f"k{p}{q}": f"{a((p + 1) % 3, (q + 1) % 3)} * {a((p + 2) % 3, (q + 2) % 3)} - {a((p + 1) % 3, (q + 2) % 3)} * {a((p + 2) % 3, (q + 1) % 3)}" for p in range(3) for q in range(p, 3)}
    whole = {"whole": " + ".join(f"{a(0, q)} * k0{q}" for q in range(3))}
    edge = 1 << level
    inside = {}
    for n, c in enumerate(("ni", "nj", "nk")):
        low = f"({c} * {edge} - (({c} >> {LEAF - level}) * {1 << LEAF}))"
        step = " + ".join(f"k{min(n, q)}{max(n, q)} * r{q}" for q in range(3))
        inside[f"x{n}"] = f"least(greatest(p{n} + ({step}) / whole, cast({low} as double)), cast({low} + {edge} as double))"
    bent = " + ".join(f"x{p} * x{q} * a{min(p, q)}{max(p, q)}" for p in range(3) for q in range(3))
    return [mean, {**rest, **minor}, whole, inside, {"error": f"{bent} - 2 * (x0 * b0 + x1 * b1 + x2 * b2) + c"}]


def adaptive(g: Grid, iso: float = 0.0, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(level, ni, nj, nk, x, y, z) of vertices, and polygons (axis, i, j, k, corners): structs of their nodes, in order."""
    own = _written(staged(cells(g).join(vertices(g, iso), list(IJK)), planes()).select(*IJK, "x", "y", "z", *SUMS))
    level, nodes, joined = own.select(*[F.col(c).alias(f"n{c}") for c in IJK], *SUMS), [], own.select(*IJK, "x", "y", "z")
    joined = joined.withColumns({"level": F.lit(0), **{f"n{c}": F.col(c) for c in IJK}})
    for depth in range(1, LEAF + 1):
        up = [F.shiftright(f"n{c}", 1).alias(f"n{c}") for c in IJK]
        # A node's children are all the nodes below it, merged or not; one that hasn't merged is missed in the count of cells.
        every = own.groupBy(*[F.shiftright(c, depth).alias(f"n{c}") for c in IJK]).agg(F.sum("m").alias("all"))
        sums = level.groupBy(*up).agg(*[F.sum(x).alias(x) for x in SUMS]).join(every, ["ni", "nj", "nk"]).where("m = all")
        level = _written(staged(sums, placed(depth)).select("ni", "nj", "nk", "x0", "x1", "x2", "error", *SUMS)).where(F.col("error") <= tolerance * tolerance)
        there = [(F.col(f"x{n}") + F.shiftleft(F.shiftright(f"n{c}", LEAF - depth), LEAF)).alias(a) for n, (c, a) in enumerate(zip(IJK, "xyz"))]
        nodes.append(level.select(F.lit(depth).alias("level"), "ni", "nj", "nk", *there))
        key = level.select(*[F.col(f"n{c}").alias(f"t{c}") for c in IJK], F.lit(depth).alias("deeper"))
        joined = joined.join(key, [F.shiftright(F.col(c), depth) == F.col(f"t{c}") for c in IJK], "left")
        joined = joined.withColumns({"level": F.coalesce("deeper", "level"), **{f"n{c}": F.coalesce(f"t{c}", f"n{c}") for c in IJK}}).drop("deeper", *[f"t{c}" for c in IJK])
    of = _written(joined)
    used = of.select("level", "ni", "nj", "nk").distinct()
    points = of.where("level = 0").select("level", "ni", "nj", "nk", "x", "y", "z")
    for n in nodes:
        points = points.unionByName(n.join(used, ["level", "ni", "nj", "nk"], "left_semi").select(points.columns))
    at = of.select(*[F.col(c).alias(f"v{c}") for c in IJK], F.struct("level", "ni", "nj", "nk").alias("node"))
    met = rings(g, iso).join(at, ["vi", "vj", "vk"]).groupBy("axis", *IJK).agg(*[F.max(F.when(F.col("corner") == n, F.col("node"))).alias(f"c{n}") for n in range(4)])
    whole = met.where(" and ".join(f"c{n} is not null" for n in range(4))).withColumn("corners", F.array_distinct(F.array("c0", "c1", "c2", "c3")))
    # Three nodes of which the repeated one isn't next to itself are a polygon that folds onto a line.
    kept = whole.where("size(corners) = 4 or (size(corners) = 3 and c0 <> c2 and c1 <> c3)")
    return points, kept.select("axis", *IJK, "corners")
