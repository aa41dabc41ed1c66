"""Surfaces: meshes from grids and grids from meshes, shapes of planes and tubes, level sets of masks.

A mesh is a relation of vertices, one for each cell of eight voxels that the surface crosses, and one of quads, one for
each edge between two voxels that it crosses. So both take one shuffle. Distances to triangles or tubes are made for the
voxels of their boxes only, and the least of a voxel is found before the shuffle, too.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid
from gridloom.operators.stencil import FACES, dealt, surface_mask, tasks_for
from gridloom.operators.tree import _written
from gridloom.operators.values import skin
from gridloom.workers import ready

CORNERS = list(product((0, 1), repeat=3))
#: Pairs of corners that an edge of a cell joins.
EDGES = [(a, b) for a in CORNERS for b in CORNERS if a < b and sum(x != y for x, y in zip(a, b)) == 1]

#: What a voxel knows of its nearest place.
NEAREST = [*IJK, "d", "fx", "fy", "fz"]
#: Bits of the edge of nodes that tasks spell out; voxels that they make at once, and rows of ``NEAREST`` that they hold.
NODE, PORTION, HELD = 4, 1 << 16, 1 << 18


def corner(o: tuple[int, int, int]) -> str:
    return "c" + "".join(map(str, o))


def cells(g: Grid) -> DataFrame:
    """(i, j, k, c000 ... c111): cells all of whose corners have a voxel."""
    sent = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in CORNERS]))
    rows = g.df.select(*IJK, "value", sent).select(*[(F.col(c) - F.col(f"d{c}")).alias(c) for c in IJK], "value", "di", "dj", "dk")
    own = [F.max(F.when((F.col("di") == o[0]) & (F.col("dj") == o[1]) & (F.col("dk") == o[2]), F.col("value"))).alias(corner(o)) for o in CORNERS]
    return rows.groupBy(*IJK).agg(F.count(F.lit(1)).alias("n"), *own).where("n = 8").drop("n")


def vertices(g: Grid, iso: float = 0.0) -> DataFrame:
    """(i, j, k, x, y, z): a vertex for each cell that the surface crosses, the mean of the crossings of its edges."""
    c = cells(g)
    crossed = [(F.col(corner(a)) < iso) != (F.col(corner(b)) < iso) for a, b in EDGES]
    n = reduce(Column.__add__, [F.when(x, 1.0).otherwise(0.0) for x in crossed])
    where = []
    for axis in range(3):
        terms = []
        for x, (a, b) in zip(crossed, EDGES):
            t = (F.lit(iso) - F.col(corner(a))) / (F.col(corner(b)) - F.col(corner(a)))
            terms.append(F.when(x, F.lit(float(a[axis])) + t * float(b[axis] - a[axis])).otherwise(0.0))
        where.append(F.col(IJK[axis]) + reduce(Column.__add__, terms) / n)
    return c.where(n > 0).select(*IJK, *[w.alias(a) for w, a in zip(where, "xyz")])


def quads(g: Grid, iso: float = 0.0) -> DataFrame:
    """(axis, i, j, k, out): a quad for each crossed edge from a voxel along an axis; its corners are the vertices of the
    cells (voxel minus 0 or 1 on the two other axes); ``out`` says that the surface looks along the axis."""
    steps = F.inline(F.array(*[F.struct(F.lit(n).alias("axis"), F.lit(d).alias("second")) for n in range(3) for d in (False, True)]))
    rows = g.df.select(*IJK, "value", steps)
    own = [(F.col(c) - F.when(F.col("second") & (F.col("axis") == n), 1).otherwise(0)).alias(c) for n, c in enumerate(IJK)]
    ends = [F.max(F.when(F.col("second") == s, F.col("value"))).alias(a) for s, a in ((False, "a"), (True, "b"))]
    met = rows.select("axis", *own, "value", "second").groupBy("axis", *IJK).agg(*ends)
    return met.where((F.col("a") < iso) != (F.col("b") < iso)).select("axis", *IJK, (F.col("a") < iso).alias("out"))


def segment_distance(p: str, a: str, b: str) -> str:
    """SQL of a point's distance to a segment; names are prefixes of columns with x, y, z."""
    ab, ap = [f"({b}{c} - {a}{c})" for c in "xyz"], [f"({p}{c} - {a}{c})" for c in "xyz"]
    t = f"least(greatest(({' + '.join(f'{x} * {y}' for x, y in zip(ab, ap))}) / greatest({' + '.join(f'{x} * {x}' for x in ab)}, cast(1e-300 as double)), cast(0 as double)), cast(1 as double))"
    return "sqrt(" + " + ".join(f"({x} - {y} * {t}) * ({x} - {y} * {t})" for x, y in zip(ap, ab)) + ")"


def triangle_distance(p: str, a: str, b: str, c: str) -> str:
    """SQL of a point's distance to a triangle: to its plane above its inside, else to the nearest edge."""
    ab, ac, ap = ([f"({x}{n} - {a}{n})" for n in "xyz"] for x in (b, c, p))
    dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v)) + ")"
    bb, bc, cc, pb, pc = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    area = f"({bb} * {cc} - {bc} * {bc})"
    u, v = f"(({cc} * {pb} - {bc} * {pc}) / greatest({area}, cast(1e-300 as double)))", f"(({bb} * {pc} - {bc} * {pb}) / greatest({area}, cast(1e-300 as double)))"
    plane = "sqrt(" + " + ".join(f"({x} - {u} * {y} - {v} * {z}) * ({x} - {u} * {y} - {v} * {z})" for x, y, z in zip(ap, ab, ac)) + ")"
    edges = ", ".join(segment_distance(p, x, y) for x, y in ((a, b), (b, c), (c, a)))
    return f"case when {area} > 0 and {u} >= 0 and {v} >= 0 and {u} + {v} <= 1 then {plane} else least({edges}) end"


def _boxed(rows: DataFrame, points: str, reach: Column) -> DataFrame:
    """Rows with each voxel of their box: that of the named points, wider by ``reach``."""
    for c, a in zip(IJK, "xyz"):
        low, high = (f(*[F.col(p + a) for p in points]) if len(points) > 1 else F.col(points + a) for f in (F.least, F.greatest))
        rows = rows.withColumn(c, F.explode(F.sequence(F.ceil(low - reach).cast("int"), F.floor(high + reach).cast("int"))))
    return rows.withColumns({f"p{a}": F.col(c).cast("double") for c, a in zip(IJK, "xyz")})


def _descended(triangles: DataFrame, reach: float, least: int = 0) -> DataFrame:
    """Triangles (ax ... cz) with the voxels within ``reach`` of them as px, py, pz, and few others.

    With ``least`` of 4 they are nodes of 16 voxels a side, numbered by i, j, k, that hold such voxels.

    Nodes of 256 voxels a side that a triangle's box meets are opened into nodes of 16 and these into voxels, each where
    its middle is near the triangle's plane and not far beyond one of its edges. So a triangle gives as many voxels as are
    near it, however large its box is. Triangles without area have no plane and give the voxels of their box. Triangles
    are dealt out first: a small table of them makes many rows.
    """
    rows = triangles.repartition(int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for c, a in zip(IJK, "xyz"):
        low, high = (f(*[F.col(p + a) for p in "aec"]) for f in (F.least, F.greatest))
        rows = rows.withColumns({f"_l{c}": F.ceil(low - reach).cast("int"), f"_h{c}": F.floor(high + reach).cast("int")})
    cross = lambda u, v: [u[(n + 1) % 3] * v[(n + 2) % 3] - u[(n + 2) % 3] * v[(n + 1) % 3] for n in range(3)]
    edge = lambda p, q: [F.col(q + x) - F.col(p + x) for x in "xyz"]
    rows = rows.withColumns({f"_n{m}": v for m, v in enumerate(cross(edge("a", "e"), edge("a", "c")))})
    flat = [F.col(f"_n{m}") for m in range(3)]
    rows = rows.withColumns({f"_o{k}{m}": v for k, (p, q) in enumerate(("ae", "ec", "ca")) for m, v in enumerate(cross(edge(p, q), flat))})
    length = lambda k: F.greatest(F.sqrt(reduce(Column.__add__, [F.col(f"{k}{m}") * F.col(f"{k}{m}") for m in range(3)])), F.lit(1e-300))
    rows = rows.withColumns({f"_s{k}": length(k) for k in ("_n", "_o0", "_o1", "_o2")})
    beyond = lambda k, p: reduce(Column.__add__, [F.col(f"{k}{m}") * (F.col("p" + x) - F.col(p + x)) for m, x in enumerate("xyz")]) / F.col(f"_s{k}")
    bits, step = 8, 4
    for c in IJK:
        rows = rows.withColumn(c, F.explode(F.sequence(F.shiftright(f"_l{c}", bits), F.shiftright(f"_h{c}", bits))))
    while True:
        middle = ((1 << bits) - 1) / 2
        far = reach + middle * 3**0.5
        rows = rows.withColumns({f"p{x}": (F.shiftleft(c, bits) + middle).cast("double") for c, x in zip(IJK, "xyz")})
        rows = rows.where((F.abs(beyond("_n", "a")) <= far) & (beyond("_o0", "a") <= far) & (beyond("_o1", "e") <= far) & (beyond("_o2", "c") <= far))
        if bits == least:
            return rows.drop(*[n for n in rows.columns if n[0] == "_"])
        bits -= step
        for c in IJK:
            first, last = F.greatest(F.shiftleft(c, step), F.shiftright(f"_l{c}", bits)), F.least(F.shiftleft(c, step) + ((1 << step) - 1), F.shiftright(f"_h{c}", bits))
            rows = rows.where(first <= last).withColumn(c, F.explode(F.sequence(first, last)))


def _foot(p: np.ndarray, a: np.ndarray, e: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of points to triangles a, e, c, and the points of these that are nearest; all are arrays of (3, rows)."""
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    part = lambda x, y: np.clip(x / np.maximum(y, 1e-300), 0.0, 1.0)
    u, v, w, s, r = e - a, c - a, p - a, c - e, p - e
    uu, uv, vv, wu, wv = dot(u, u), dot(u, v), dot(v, v), dot(w, u), dot(w, v)
    area = uu * vv - uv * uv
    g, h = (np.where(area > 0, x / np.maximum(area, 1e-300), -1.0) for x in (vv * wu - uv * wv, uu * wv - uv * wu))
    d, foot = None, None
    for to in (a + part(wu, uu) * u, a + part(wv, vv) * v, e + part(dot(r, s), dot(s, s)) * s):
        far = dot(p - to, p - to)
        d, foot = (far, to) if d is None else (np.where(far < d, far, d), np.where(far < d, to, foot))
    inner, to = (g >= 0) & (h >= 0) & (g + h <= 1), a + g * u + h * v
    return np.sqrt(np.where(inner, dot(p - to, p - to), d)), np.where(inner, to, foot)


def _spelt(nodes: np.ndarray, corners: np.ndarray, reach: float):
    """Voxels of nodes near the planes of their triangles, in portions: (3, rows), and the number of each one's triangle."""
    wide = reach + 1e-6
    first = np.maximum(nodes << NODE, np.ceil(corners.min(0) - wide).astype(np.int64))
    last = np.minimum((nodes << NODE) + (1 << NODE) - 1, np.floor(corners.max(0) + wide).astype(np.int64))
    size = np.maximum(last - first + 1, 0)
    many = size.prod(0)
    normal = np.cross(corners[1] - corners[0], corners[2] - corners[0], axis=0)
    far = wide * np.sqrt((normal * normal).sum(0))
    ends = np.cumsum(many)
    start = 0
    while start < len(many):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - many[start] + PORTION, "right")))
        of = np.repeat(np.arange(start, end), many[start:end])
        n = np.arange(len(of)) - np.repeat(ends[start:end] - many[start:end] - (ends[start] - many[start]), many[start:end])
        n, k = np.divmod(n, size[2, of])
        i, j = np.divmod(n, size[1, of])
        at = first[:, of] + np.stack([i, j, k])
        near = np.abs((normal[:, of] * (at - corners[0][:, of])).sum(0)) <= far[of]
        yield at[:, near], of[near]
        start = end


def _least(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Of rows of ``NEAREST`` the least of each voxel."""
    rows = [np.concatenate(x) for x in zip(*parts)]
    low = [int(x.min()) for x in rows[:3]]
    long = [int(x.max()) - m + 1 for x, m in zip(rows, low)]
    if long[0] * long[1] * long[2] < 1 << 62:
        key = ((rows[0] - low[0]) * long[1] + rows[1] - low[1]) * long[2] + rows[2] - low[2]
    else:
        key = np.unique(np.stack(rows[:3]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(key)
    key, rows = key[order], [x[order] for x in rows]
    for n in (*range(3, len(rows)), None):
        starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        if n is None or len(starts) == len(key):
            return [x[starts] for x in rows]
        keep = rows[n] == np.repeat(np.minimum.reduceat(rows[n], starts), np.diff(np.append(starts, len(key))))
        key, rows = key[keep], [x[keep] for x in rows]


def _nearest(batches, reach: float):
    """Nodes of triangles as each voxel's nearest place nearer than ``reach``, ties by coordinates.

    Rows are held until there are so many that a task sends the least of each voxel on.
    """
    held, count = [], 0

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n < 3 else pa.float64()) for n, x in enumerate(rows)], names=NEAREST)

    with np.errstate(all="ignore"):
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            corners = np.stack([[column(p + x) for x in "xyz"] for p in "aec"])
            for at, of in _spelt(np.stack([column(c) for c in IJK]).astype(np.int64), corners, reach):
                d, foot = _foot(at.astype(float), *[c[:, of] for c in corners])
                near = d < reach
                held.append([*at[:, near], d[near], *foot[:, near]])
                count += len(held[-1][0])
                if count > HELD:
                    held = [_least(held)]
                    count = len(held[0][0])
                    if count > HELD // 2:
                        yield told(held.pop())
                        count = 0
    if count:
        yield told(_least(held))


def nearest(triangles: DataFrame, reach: float) -> DataFrame:
    """(i, j, k, d, fx, fy, fz): voxels nearer than ``reach`` to triangles (ax ... cz), and their nearest place on them.

    Equal triangles count once. Tasks spell out the voxels of a triangle's nodes in arrays, as Spark's code for distances
    as columns is too long to be compiled. Nodes come sorted, so a task's triangles share voxels and it sends on one row
    for each of these; a node of many triangles is shared out.
    """
    ready(triangles.sparkSession)
    names = [p + x for p in "aec" for x in "xyz"]
    nodes = _descended(triangles.select(*[F.col(n).cast("double").alias(n) for n in names]).distinct(), reach + 1e-6, NODE)
    tasks = int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = nodes.select(*IJK, *names).repartitionByRange(tasks, *IJK, F.xxhash64(*names)).sortWithinPartitions(*IJK)
    found = sorted_.mapInArrow(partial(_nearest, reach=reach), ", ".join(f"{n} {'int' if n in IJK else 'double'}" for n in NEAREST))
    return found.groupBy(*IJK).agg(F.min(F.struct(*NEAREST[3:])).alias("best")).select(*IJK, "best.*")


def mesh_distance(triangles: DataFrame, half: float = 3.0) -> Grid:
    """Unsigned distances to triangles (ax ... ez, cx, cy, cz) in a band around them."""
    return Grid(nearest(triangles, half).select(*IJK, F.col("d").alias("value"), F.lit(True).alias("active")), half)


def tubes(segments: DataFrame, half: float = 3.0) -> Grid:
    """Narrow band of the union of capsules around segments (ax ... ez, r)."""
    near = _boxed(segments, "ae", F.col("r") + half).groupBy(*IJK).agg(F.min(F.expr(segment_distance("p", "a", "e")) - F.col("r")).alias("value"))
    return Grid(near.where(F.abs("value") < half).withColumn("active", F.lit(True)), half)


def balls(points: DataFrame, radius: float, half: float = 1.5) -> Grid:
    """Level set of blended spheres: mean position by a smooth weight within twice the radius, less the radius."""
    reach = 2 * radius
    rows = _boxed(points.select(*[F.col(f"p{a}").alias(f"a{a}") for a in "xyz"]), "a", F.lit(reach))
    d2 = reduce(Column.__add__, [(F.col(f"p{a}") - F.col(f"a{a}")) * (F.col(f"p{a}") - F.col(f"a{a}")) for a in "xyz"]) / (reach * reach)
    w = F.pow(F.lit(1.0) - d2, 3.0)
    met = rows.withColumn("w", w).where("w > 0").groupBy(*IJK).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"a{a}")).alias(a) for a in "xyz"])
    away = F.sqrt(reduce(Column.__add__, [(F.col(c) - F.col(a) / F.col("w")) * (F.col(c) - F.col(a) / F.col("w")) for c, a in zip(IJK, "xyz")])) - radius
    return Grid(met.select(*IJK, away.alias("value"), F.lit(True).alias("active")).where(F.abs("value") < half), half)


def solid(points: DataFrame, normals: list[tuple[float, float, float]], size: float, half: float = 3.0) -> Grid:
    """Narrow band of the union of convex solids around points: the largest distance to the planes of their faces."""
    rows = _boxed(points.select(*[F.col(f"p{a}").alias(f"a{a}") for a in "xyz"]), "a", F.lit(2 * size + half))
    planes = [reduce(Column.__add__, [(F.col(f"p{a}") - F.col(f"a{a}")) * x for a, x in zip("xyz", n)]) for n in normals]
    met = rows.groupBy(*IJK).agg((F.min(F.greatest(*planes)) - size).alias("value"))
    return Grid(met.where(F.abs("value") < half).withColumn("active", F.lit(True)), half)


def face_normals(faces: int) -> list[tuple[float, float, float]]:
    """Unit normals of the faces of a tetrahedron, octahedron, dodecahedron or icosahedron."""
    gold = (1 + 5**0.5) / 2
    signs = list(product((-1.0, 1.0), repeat=3))
    turn = lambda v: [v, (v[2], v[0], v[1]), (v[1], v[2], v[0])]
    pairs = lambda a, b: [t for x in (-a, a) for y in (-b, b) for t in turn((0.0, x, y))]
    found = {4: [s for s in signs if s[0] * s[1] * s[2] > 0], 8: signs, 12: pairs(1.0, gold), 20: signs + pairs(1 / gold, gold)}[faces]
    return [tuple(x / sum(y * y for y in v) ** 0.5 for x in v) for v in found]


def of_mask(g: Grid, half: int = 3) -> Grid:
    """Narrow band of the level set of a grid's active voxels: half a voxel from the nearest voxel of the other kind.

    Only voxels at the surface send their places, to a ball of offsets.
    """
    ball = [o for o in product(range(-half, half + 1), repeat=3) if sum(x * x for x in o) <= half * half]
    sent = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)], F.lit(float(sum(x * x for x in o)) ** 0.5).alias("d")) for o in ball]))
    on = g.on.select(*IJK)
    tasks = tasks_for(on, on.count() * (len(FACES) + 1) * len(ball))
    rows = skin(g, tasks).select(*IJK, "inner", sent).select(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK], "inner", "d")
    own = on.select(*IJK, F.lit(None).cast("boolean").alias("inner"), F.lit(None).cast("double").alias("d"), F.lit(True).alias("own"))
    rows = dealt(rows.withColumn("own", F.lit(None).cast("boolean")).unionByName(own), tasks)
    both = rows.groupBy(*IJK).agg(F.min(F.when(F.col("inner"), F.col("d"))).alias("to_in"), F.min(F.when(~F.col("inner"), F.col("d"))).alias("to_out"), F.max("own").alias("own"))
    both = both.withColumn("value", F.when(F.col("own"), F.lit(0.5) - F.col("to_out")).otherwise(F.col("to_in") - 0.5))
    return Grid(both.where("value is not null").select(*IJK, "value", F.lit(True).alias("active")), float(half))


def rings(g: Grid, iso: float = 0.0) -> DataFrame:
    """(axis, i, j, k, corner, vi, vj, vk): the four cells of each quad, counter-clockwise as seen from outside."""
    turn = [(0, 0), (-1, 0), (-1, -1), (0, -1)]
    sent = []
    for n in range(3):
        for m, (a, b) in enumerate(turn):
            step = {n: 0, (n + 1) % 3: a, (n + 2) % 3: b}
            sent.append(F.struct(F.lit(n).alias("of"), F.when(F.col("out"), m).otherwise(3 - m).alias("corner"), *[F.lit(step[x]).alias(f"d{c}") for x, c in enumerate(IJK)]))
    rows = quads(g, iso).select("axis", *IJK, "out", F.inline(F.array(*sent))).where("of = axis")
    return rows.select("axis", *IJK, "corner", *[(F.col(c) + F.col(f"d{c}")).alias(f"v{c}") for c in IJK])


def triangulated(g: Grid, iso: float = 0.0) -> DataFrame:
    """(ax ... cz): two triangles for each quad, seen counter-clockwise from outside; none where a corner has no vertex."""
    at = vertices(g, iso).select(*[F.col(c).alias(f"v{c}") for c in IJK], F.struct("x", "y", "z").alias("p"))
    met = rings(g, iso).join(at, ["vi", "vj", "vk"]).groupBy("axis", *IJK).agg(*[F.max(F.when(F.col("corner") == n, F.col("p"))).alias(f"p{n}") for n in range(4)])
    whole = met.where(" and ".join(f"p{n} is not null" for n in range(4)))
    three = [F.struct(*[F.col(f"p{n}")[a].alias(f"{to}{a}") for n, to in zip(of, "aec") for a in "xyz"]) for of in ((0, 1, 2), (0, 2, 3))]
    return whole.select(F.inline(F.array(*three)))


def rebuilt(g: Grid, iso: float = 0.0, half: float = 3.0) -> Grid:
    """A level set made anew from its surface: distances to the faces of its mesh, below 0 where that goes around a voxel."""
    return mesh_level_set(_written(triangulated(g, iso)), half)


def winding(triangles: DataFrame, voxels: DataFrame) -> DataFrame:
    """(i, j, k, turns): how often a closed mesh of triangles (ax ... cz) that look outwards goes around each voxel.

    A triangle sends its height and side to the lines along k that it crosses, and a running sum from the top of each
    line counts them; edges and corners belong to one of the triangles that share them. Lines are sorted, not collected.
    """
    rows = triangles
    for c, a in zip("ij", "xy"):
        low, high = (f(*[F.col(p + a) for p in "aec"]) for f in (F.least, F.greatest))
        rows = rows.withColumn(c, F.explode(F.sequence(F.floor(low).cast("int"), F.ceil(high).cast("int"))))
    ends = []
    for p, q in ("ae", "ec", "ca"):
        rising = F.col(f"{p}y") <= F.col(f"{q}y")
        (lx, ly), (hx, hy) = ([F.when(rising, F.col(x + a)).otherwise(F.col(y + a)) for a in "xy"] for x, y in ((p, q), (q, p)))
        ends.append(F.when((ly <= F.col("j")) & (hy > F.col("j")) & (lx + (F.col("j") - ly) / (hy - ly) * (hx - lx) > F.col("i")), 1).otherwise(0))
    rows = rows.where((ends[0] + ends[1] + ends[2]) % 2 == 1)
    (ux, uy, uz), (vx, vy, vz) = ([F.col(p + a) - F.col("a" + a) for a in "xyz"] for p in "ec")
    area = ux * vy - uy * vx
    height = F.col("az") - ((uy * vz - uz * vy) * (F.col("i") - F.col("ax")) + (uz * vx - ux * vz) * (F.col("j") - F.col("ay"))) / area
    met = rows.where(area != 0).select("i", "j", F.lit(None).cast("int").alias("k"), height.alias("z"), F.signum(area).cast("int").alias("turn"))
    both = met.unionByName(voxels.select(*IJK, F.col("k").cast("double").alias("z"), F.lit(0).alias("turn")))
    above = Window.partitionBy("i", "j").orderBy(F.desc("z"), F.desc_nulls_last("k")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("turns", F.sum("turn").over(above)).where("k is not null").select(*IJK, "turns")


def mesh_level_set(triangles: DataFrame, half: float = 3.0) -> Grid:
    """Narrow band of a closed mesh: distances to its triangles, below 0 where it goes around a voxel."""
    near = mesh_distance(triangles, half)
    told = near.df.join(winding(triangles, near.df), list(IJK))
    return near.with_df(told.withColumn("value", F.when(F.col("turns") > 0, -F.col("value")).otherwise(F.col("value"))))


def extended(g: Grid, carried: Grid, half: int = 3) -> DataFrame:
    """(i, j, k, value, away): values of another grid at the surface, carried to the voxels of the band around it.

    A voxel takes that of the nearest voxel whose sign differs from a face neighbour's, the first by place among equals.
    """
    edge = surface_mask(g).df.select(*IJK).join(carried.df.select(*IJK, "value"), list(IJK), "left").select(*IJK, F.coalesce("value", F.lit(carried.background)).alias("value"))
    ball = [o for o in product(range(-half, half + 1), repeat=3) if sum(x * x for x in o) <= half * half]
    sent = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)], F.lit(sum(x * x for x in o)).alias("d")) for o in ball]))
    rows = edge.select(F.struct(*IJK).alias("at"), *IJK, "value", sent)
    rows = rows.select(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK], F.struct("d", "at", "value").alias("best"))
    near = rows.groupBy(*IJK).agg(F.min("best").alias("best"))
    return near.join(g.on.select(*IJK), list(IJK)).select(*IJK, "best.value", F.sqrt(F.col("best.d").cast("double")).alias("away"))
