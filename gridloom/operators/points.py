"""Points: grouping by voxel, groups, filters, statistics, search, rasters, motion and copies."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import IJK, LEAF, Grid, cell
from gridloom.operators.sample import trilinear
from gridloom.operators.stencil import gradient
from gridloom.operators.tree import _written

P = ("px", "py", "pz")


def located(points: DataFrame) -> DataFrame:
    """Points with their voxel and their place in it, from -1/2 to 1/2."""
    at = points.withColumns({c: cell(F.col(p)) for c, p in zip(IJK, P)})
    return at.withColumns({f"o{c}": F.col(p) - F.col(c) for c, p in zip(IJK, P)})


def count(points: DataFrame) -> Grid:
    """Points of each voxel."""
    return Grid(located(points).groupBy(*IJK).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("active", F.lit(True)), 0.0)


def mask(points: DataFrame) -> Grid:
    """Voxels with a point."""
    return Grid(located(points).select(*IJK).distinct().select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")), 0.0)


def offsets(points: DataFrame) -> DataFrame:
    """(i, j, k, n, end): points of each voxel, and running count within its leaf, in order of coordinates."""
    leaf = [F.shiftright(c, LEAF) for c in IJK]
    per = located(points).groupBy(*IJK).agg(F.count(F.lit(1)).alias("n"))
    return per.select(*IJK, "n", F.sum("n").over(Window.partitionBy(*leaf).orderBy(*IJK)).alias("end"))


def grouped(points: DataFrame, **groups: Column) -> DataFrame:
    """Membership of each group as a boolean column grp_<name>."""
    return points.withColumns({f"grp_{n}": F.coalesce(c, F.lit(False)) for n, c in groups.items()})


def in_groups(points: DataFrame, include: list[str] = [], exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """Points of any of the groups included (all, if none is named) and none of those excluded."""
    keep = F.lit(not include)
    for n in include:
        keep = keep | F.col(f"grp_{n}")
    for n in exclude:
        keep = keep & ~F.col(f"grp_{n}")
    return points.where(keep)


def group_sizes(points: DataFrame) -> DataFrame:
    names = [c for c in points.columns if c.startswith("grp_")]
    return points.agg(*[F.count_if(c).alias(c.removeprefix("grp_")) for c in names])


def in_box(points: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    keep = F.lit(True)
    for p, a, b in zip(P, low, high):
        keep = keep & F.col(p).between(a, b)
    return points.where(keep)


def in_mask(points: DataFrame, g: Grid, inside: bool = True) -> DataFrame:
    """Points whose voxel is active in a grid (or isn't)."""
    return located(points).join(g.on.select(*IJK), list(IJK), "left_semi" if inside else "left_anti").select(*points.columns)


def in_level_set(points: DataFrame, g: Grid, low: float, high: float) -> DataFrame:
    """Points whose sampled distance is strictly between bounds; with low above high, strictly outside them."""
    found = trilinear(g, points.select("id", *[F.col(p).alias(a) for p, a in zip(P, "xyz")])).select("id", F.col("value").alias("_d"))
    d = F.col("_d")
    return points.join(found, "id").where((d > low) & (d < high) if low <= high else (d < high) | (d > low)).drop("_d")


def per_leaf(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points of each leaf, chosen by a hash of id; ties by id."""
    own = located(points)
    order = Window.partitionBy(*[F.shiftright(c, LEAF) for c in IJK]).orderBy(F.pmod(F.col("id") * 2654435761 + seed, F.lit(1 << 32)), "id")
    return own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select(*points.columns)


def attribute_statistics(points: DataFrame, name: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Count, extremes, mean and population variance of an attribute."""
    return points.groupBy(*by).agg(F.count(name).alias("n"), F.min(name).alias("least"), F.max(name).alias("most"), F.avg(name).alias("mean"), F.var_pop(name).alias("variance"))


def centre(points: DataFrame) -> DataFrame:
    """Mean position and covariance of all points: what principal axes are made of."""
    pairs = [(a, b) for n, a in enumerate(P) for b in P[n:]]
    return points.agg(*[F.avg(p).alias(f"m{p[1]}") for p in P], *[F.covar_pop(a, b).alias(f"c{a[1]}{b[1]}") for a, b in pairs])


def raster(points: DataFrame, name: str, normalise: bool = True) -> Grid:
    """An attribute spread to the eight voxels around each point by hat weights; a mean, or a sum."""
    part = points.select(*P, F.col(name).alias("v"), *[F.floor(p).cast("int").alias(f"l{p}") for p in P])

    def corner(o: tuple[int, ...]) -> Column:
        w = F.lit(1.0)
        for p, d in zip(P, o):
            t = F.col(p) - F.col(f"l{p}")
            w = w * (t if d else F.lit(1.0) - t)
        return F.struct(*[(F.col(f"l{p}") + d).alias(c) for p, c, d in zip(P, IJK, o)], w.alias("w"))

    rows = part.select("v", F.inline(F.array(*map(corner, product((0, 1), repeat=3))))).where("w > 0")
    summed = rows.groupBy(*IJK).agg(F.sum(F.col("w") * F.col("v")).alias("t"), F.sum("w").alias("w"))
    return Grid(summed.select(*IJK, (F.col("t") / F.col("w") if normalise else F.col("t")).alias("value"), F.lit(True).alias("active")), 0.0)


def sampled(points: DataFrame, g: Grid, into: str) -> DataFrame:
    """Points with a grid's trilinear value."""
    found = trilinear(g, points.select("id", *[F.col(p).alias(a) for p, a in zip(P, "xyz")]))
    return points.join(found.select("id", F.col("value").alias(into)), "id")


def _met(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """Pairs whose buckets of side ``radius`` touch, with their distance."""
    bucket = {f"b{c}": F.floor(F.col(p) / radius).cast("int") for c, p in zip(IJK, P)}
    right = points.select(F.col("id").alias("other"), *[F.col(p).alias(f"o{p}") for p in P], *[bucket[f"b{c}"].alias(f"b{c}") for c in IJK])
    left = queries.select("id", *P, *[e.alias(n) for n, e in bucket.items()])
    for c in IJK:
        left = left.withColumn(f"b{c}", F.explode(F.array(*[F.col(f"b{c}") + d for d in (-1, 0, 1)])))
    d = [F.col(p) - F.col(f"o{p}") for p in P]
    met = left.join(right, [f"b{c}" for c in IJK])
    return met.select("id", "other", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("distance"))


def within(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(id, other, distance): points in a sphere around each query, by an equality join on buckets."""
    return _met(points, queries, radius).where(F.col("distance") <= radius)


def closest(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(id, other, distance): the nearest point within a radius; ties by id."""
    best = within(points, queries, radius).groupBy("id").agg(F.min(F.struct("distance", "other")).alias("b"))
    return best.select("id", F.col("b")["other"].alias("other"), F.col("b")["distance"].alias("distance"))


def nearest(points: DataFrame, queries: DataFrame, radius: float, n: int) -> DataFrame:
    """(id, other, distance, place): the n nearest points within a radius, ties by id."""
    order = Window.partitionBy("id").orderBy("distance", "other")
    return within(points, queries, radius).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def nearest_others(points: DataFrame, queries: DataFrame, n: int = 1, radius: float = 1.0) -> DataFrame:
    """(id, other, distance, place): the n nearest other points of each query, however far; ties by id.

    The radius doubles for queries that have found fewer than n, until it spans all points.
    """
    ends = points.select(*P).unionByName(queries.select(*P)).agg(*[(F.max(p) - F.min(p)).alias(p) for p in P]).first()
    reach = sum((x or 0.0) ** 2 for x in ends) ** 0.5
    order = Window.partitionBy("id").orderBy("distance", "other")
    waiting, parts = queries.select("id", *P), []
    while True:
        met = within(points, waiting, radius).where("id <> other")
        met = _written(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n))
        if radius >= reach:
            parts.append(met)
            break
        full = met.where(F.col("place") == n).select("id")
        parts.append(met.join(full, "id", "left_semi"))
        waiting = _written(waiting.join(full, "id", "left_anti"))
        if waiting.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionByName, parts)


def moved(points: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({p: F.col(p) + d for p, d in zip(P, by)})


def carried(points: DataFrame, velocity: Grid, parts: tuple[str, str, str], time: float) -> DataFrame:
    """Points moved by a velocity grid with columns vx, vy, vz, sampled at the nearest voxel."""
    found = located(points).join(velocity.df.select(*IJK, *[F.col(v).alias(f"_{v}") for v in parts]), list(IJK), "left")
    return found.select(*[c for c in points.columns if c not in P], *[(F.col(p) + F.coalesce(f"_{v}", F.lit(0.0)) * time).alias(p) for p, v in zip(P, parts)])


def replicated(points: DataFrame, copies: int, spread: float) -> DataFrame:
    """Each point several times, its copies on a small spiral; ids are id * copies + n."""
    out = points.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    turn = F.col("_n") * 2.399963
    return out.withColumns({"id": F.col("id") * copies + F.col("_n"), "px": F.col("px") + F.cos(turn) * spread * F.col("_n"), "py": F.col("py") + F.sin(turn) * spread * F.col("_n")}).drop("_n")


def scattered(g: Grid, per_voxel: int, seed: int = 1) -> DataFrame:
    """Points in each active voxel, at places drawn from a hash of voxel, number and seed."""
    rows = g.on.select(*IJK, F.explode(F.sequence(F.lit(0), F.lit(per_voxel - 1))).alias("n"))
    draw = lambda m: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *IJK, "n", F.lit(m))), 1, 8), 16, 10).cast("double") / 2.0**32 - 0.5
    return rows.select(*IJK, "n", *[(F.col(c) + draw(m)).alias(p) for m, (c, p) in enumerate(zip(IJK, P))])


def deleted(points: DataFrame, groups: list[str], invert: bool = False, drop: bool = True) -> DataFrame:
    """Points without those of any of the groups (or only those); the groups' columns go, too."""
    member = reduce(Column.__or__, [F.col(f"grp_{n}") for n in groups])
    kept = points.where(member if invert else ~member)
    return kept.drop(*[f"grp_{n}" for n in groups]) if drop else kept


def attributes(points: DataFrame, append: dict[str, object] = {}, rename: dict[str, str] = {}, drop: list[str] = []) -> DataFrame:  # noqa: B006
    """Attributes added with one value, renamed, and dropped."""
    return points.withColumns({n: F.lit(v) for n, v in append.items()}).drop(*drop).withColumnsRenamed(rename)


def coded(points: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Points with a text attribute as numbers, and the table (code, text) of these; null is 0."""
    texts = points.select(name).where(F.col(name).isNotNull()).distinct()
    codes = texts.select(F.row_number().over(Window.orderBy(name)).cast("int").alias("code"), F.col(name).alias("text"))
    return points.join(codes.withColumnRenamed("text", name), name, "left").drop(name).withColumn(name, F.coalesce("code", F.lit(0))).drop("code"), codes


def unit_coded(x: Column, y: Column, z: Column, bits: int = 8) -> list[Column]:
    """A direction by two whole numbers: the vector on an octahedron, its lower half folded out."""
    total = F.abs(x) + F.abs(y) + F.abs(z)
    u, v = x / total, y / total
    fold = lambda a, b: (F.lit(1.0) - F.abs(b)) * F.when(a < 0, -1.0).otherwise(1.0)
    top = (1 << bits) - 1
    return [F.floor((F.when(z < 0, fold(a, b)).otherwise(a) * 0.5 + 0.5) * top + 0.5).cast("int") for a, b in ((u, v), (v, u))]


def unit_decoded(u: Column, v: Column, bits: int = 8) -> list[Column]:
    top = (1 << bits) - 1
    a, b = u * 2.0 / top - 1.0, v * 2.0 / top - 1.0
    z = F.lit(1.0) - F.abs(a) - F.abs(b)
    back = lambda p, q: F.when(z < 0, (F.lit(1.0) - F.abs(q)) * F.when(p < 0, -1.0).otherwise(1.0)).otherwise(p)
    x, y = back(a, b), back(b, a)
    n = F.sqrt(x * x + y * y + z * z)
    return [x / n, y / n, z / n]


def principal_spread(points: DataFrame) -> DataFrame:
    """(e1, e2, e3): variances along the principal axes, the largest first, in closed form."""
    c = centre(points)
    xx, xy, xz, yy, yz, zz = (F.col(n) for n in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
    q = (xx + yy + zz) / 3
    a, b, d = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + d * d + (xy * xy + xz * xz + yz * yz) * 2) / 6)
    det = a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)
    angle = F.acos(F.greatest(F.least(det / (p * p * p * 2), F.lit(1.0)), F.lit(-1.0))) / 3
    first, last = q + p * 2 * F.cos(angle), q + p * 2 * F.cos(angle + 2.0943951023931953)
    return c.select(first.alias("e1"), (q * 3 - first - last).alias("e2"), last.alias("e3"))


def advected(points: DataFrame, velocity, step: float, steps: int = 1) -> DataFrame:
    """Points moved through a field: ``velocity`` gives columns of a position's; by the fourth-order rule of Runge and Kutta."""
    for _ in range(steps):
        at = [F.col(p) for p in P]
        slopes = []
        for n, share in enumerate((0.0, 0.5, 0.5, 1.0), 1):
            here = [F.col(f"_{p}{n - 1}") * (share * step) + a if n > 1 else a for p, a in zip(P, at)]
            points = points.withColumns({f"_{p}{n}": v for p, v in zip(P, velocity(*here))})
            slopes.append([F.col(f"_{p}{n}") for p in P])
        moved_ = {p: at[m] + (slopes[0][m] + slopes[1][m] * 2 + slopes[2][m] * 2 + slopes[3][m]) * (step / 6) for m, p in enumerate(P)}
        points = points.withColumns(moved_).drop(*[f"_{p}{n}" for p in P for n in range(1, 5)])
    return points


def enright(x: Column, y: Column, z: Column) -> list[Column]:
    """Velocity of the divergence-free test field on the unit cube, at full strength."""
    pi = 3.141592653589793
    s = lambda v: F.sin(v * pi)
    t = lambda v: F.sin(v * (2 * pi))
    return [s(x) * s(x) * t(y) * t(z) * 2.0, -s(y) * s(y) * t(x) * t(z), -s(z) * s(z) * t(x) * t(y)]


def projected(points: DataFrame, g: Grid) -> DataFrame:
    """Points (id, px, py, pz) moved to a level set's surface: back along the gradient by the distance there.

    Distance and gradient are trilinear samples; a point where the gradient is 0 stays.
    """
    slope = gradient(g).withColumn("active", F.lit(True))
    asked = points.select("id", *[F.col(p).alias(a) for p, a in zip(P, "xyz")])
    out = points.join(trilinear(g, asked).select("id", F.col("value").alias("_d")), "id")
    for c in ("gx", "gy", "gz"):
        part = Grid(slope.select(*IJK, F.col(c).alias("value"), "active"), 0.0)
        out = out.join(trilinear(part, asked).select("id", F.col("value").alias(f"_{c}")), "id")
    steep = F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy") + F.col("_gz") * F.col("_gz")
    for p, c in zip(P, ("gx", "gy", "gz")):
        out = out.withColumn(p, F.when(steep > 0, F.col(p) - F.col("_d") * F.col(f"_{c}") / F.sqrt(steep)).otherwise(F.col(p)))
    return out.drop("_d", "_gx", "_gy", "_gz")


def _draw(seed: int, *parts: str) -> Column:
    """A number from 0 to 1 by a hash of columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 8), 16, 10).cast("double") / 2.0**32


#: Points of a voxel that one row makes.
RUN = 1024


def scattered_by_value(g: Grid, density: float, seed: int = 1) -> DataFrame:
    """Points in active voxels, value times density of them on average: the fraction is a draw by hash.

    A voxel's numbers are dealt out in runs of ``RUN``, so its points are made in many tasks, however many they are.
    """
    many = F.floor(F.greatest(F.col("value"), F.lit(0.0)) * density + _draw(seed, *IJK)).cast("int")
    runs = g.on.select(*IJK, many.alias("many")).where("many > 0")
    runs = runs.select(*IJK, "many", F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / RUN).cast("int"))).alias("run"))
    parts = runs.sparkSession.sparkContext.defaultParallelism * 4  # a fixed number isn't coalesced
    runs = runs.repartition(parts, *IJK, "run").withColumn("first", F.col("run") * RUN + 1)
    rows = runs.select(*IJK, F.explode(F.sequence(F.col("first"), F.least("many", F.col("first") + (RUN - 1)))).alias("n"))
    return rows.select(*IJK, "n", *[(F.col(c) + _draw(seed + m, *IJK, "n") - 0.5).alias(p) for m, (c, p) in enumerate(zip(IJK, P), 1)])


def in_frustum(points: DataFrame, at: tuple[float, float, float], size: float, taper: float, depth: float, voxels: int) -> DataFrame:
    """Points in a view along z from a square of ``size`` at a centre, widening by ``taper`` for each unit of depth, with
    the voxel (fi, fj, fk) of the ``voxels`` a side that the view is cut into."""
    z = F.col("pz") - at[2]
    width = (F.lit(1.0) + z * taper) * size
    u, v = ((F.col(p) - x) / width + 0.5 for p, x in zip(P[:2], at))
    inside = points.where((z >= 0) & (z < depth)).where((u >= 0) & (u < 1) & (v >= 0) & (v < 1))
    return inside.select("*", *[F.floor(x * voxels).cast("int").alias(c) for x, c in zip((u, v, z / depth), ("fi", "fj", "fk"))])


def clipped_to_frustum(g: Grid, at: tuple[float, float, float], size: float, taper: float, depth: float) -> Grid:
    """Voxels whose centre a view holds."""
    return g.with_df(in_frustum(g.df.select("*", *[F.col(c).cast("double").alias(p) for c, p in zip(IJK, P)]), at, size, taper, depth, 1))
