"""Neighbourhoods: differences, curvature, filters and morphology.

Every voxel sends its value to the voxels that it neighbours, and one aggregation brings a neighbourhood together; so
any stencil takes one shuffle, without joins. Missing neighbours are the background; inactive ones count with their
value. Results stand at active voxels only, whose topology stays as it was, but for dilation and erosion.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid

Offset = tuple[int, int, int]
FACES: list[Offset] = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
EDGES: list[Offset] = [o for o in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= 2]
CUBE: list[Offset] = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
NEAR = {6: FACES, 18: EDGES, 26: CUBE}
#: Messages between voxels that a task sends or brings together.
SENT = 1 << 20


def name(o: Offset) -> str:
    """n and a letter for each axis: m, c or p and a number."""
    return "n_" + "".join(f"{'m' if x < 0 else 'p' if x else 'c'}{abs(x)}" for x in o)


def gather(g: Grid, offsets: list[Offset], values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Active voxels with their own columns, and one column for each offset (and value, where there are several)."""
    many = len(values) > 1
    sent = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(-x).alias(f"d{c}") for c, x in zip(IJK, o)]) for n, o in enumerate([(0, 0, 0), *offsets])]))
    rows = g.df.select(*IJK, *values, "active", sent.alias("o"))
    rows = rows.select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in IJK], F.col("o.n").alias("n"), *values, "active")
    here = F.col("n") == 0
    own = [F.max(F.when(here, F.col(v))).alias(v) for v in values] + [F.max(F.when(here, F.col("active"))).alias("active")]
    near = [F.max(F.when(F.col("n") == n, F.col(v))).alias(f"{name(o)}_{v}" if many else name(o)) for n, o in enumerate(offsets, 1) for v in values]
    met = rows.groupBy(*IJK).agg(*own, *near).where("active")
    return met.select(*IJK, *values, "active", *[F.coalesce(c, F.lit(g.background)).alias(c) for c in met.columns if c.startswith("n_")])


def axis(n: int, step: int = 1) -> Offset:
    return tuple(step if x == n else 0 for x in range(3))  # type: ignore[return-value]


def _central(n: int, value: str = "", size: float = 1.0) -> Column:
    tail = f"_{value}" if value else ""
    return (F.col(name(axis(n)) + tail) - F.col(name(axis(n, -1)) + tail)) / (2 * size)


def gradient(g: Grid, size: float = 1.0) -> DataFrame:
    """(i, j, k, gx, gy, gz) by central differences."""
    return gather(g, FACES).select(*IJK, *[_central(n, size=size).alias(c) for n, c in enumerate(("gx", "gy", "gz"))])


def laplacian(g: Grid, size: float = 1.0) -> Grid:
    total = reduce(Column.__add__, [F.col(name(o)) for o in FACES])
    return g.with_df(gather(g, FACES).withColumn("value", (total - F.col("value") * 6) / (size * size)))


def norm(g: Grid, size: float = 1.0) -> Grid:
    """Length of the gradient."""
    d = gradient(g, size)
    return g.with_df(d.select(*IJK, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")).alias("value"), F.lit(True).alias("active")))


def divergence(v: Grid, size: float = 1.0) -> DataFrame:
    """(i, j, k, value) of a vector grid with columns vx, vy, vz."""
    d = gather(v, FACES, ("vx", "vy", "vz"))
    return d.select(*IJK, (_central(0, "vx", size) + _central(1, "vy", size) + _central(2, "vz", size)).alias("value"))


def curl(v: Grid, size: float = 1.0) -> DataFrame:
    """(i, j, k, cx, cy, cz) of a vector grid."""
    d = gather(v, FACES, ("vx", "vy", "vz"))
    c = lambda n, of: _central(n, of, size)
    return d.select(*IJK, (c(1, "vz") - c(2, "vy")).alias("cx"), (c(2, "vx") - c(0, "vz")).alias("cy"), (c(0, "vy") - c(1, "vx")).alias("cz"))


def mean_curvature(g: Grid, size: float = 1.0) -> Grid:
    """Mean curvature of iso-surfaces; 0 where the gradient vanishes."""
    d = gather(g, EDGES)
    x, y, z = (_central(n) for n in range(3))
    at = lambda o: F.col(name(o))
    second = lambda n: at(axis(n)) + at(axis(n, -1)) - F.col("value") * 2

    def mixed(a: int, b: int) -> Column:
        corner = lambda s, t: at(tuple(s if n == a else t if n == b else 0 for n in range(3)))
        return (corner(1, 1) - corner(1, -1) - corner(-1, 1) + corner(-1, -1)) / 4

    square = x * x + y * y + z * z
    alpha = x * x * (second(1) + second(2)) + y * y * (second(0) + second(2)) + z * z * (second(0) + second(1)) - (x * y * mixed(0, 1) + x * z * mixed(0, 2) + y * z * mixed(1, 2)) * 2
    own = d.select(*IJK, "active", alpha.alias("alpha"), square.alias("square"))
    value = F.when(F.col("square") > 1e-12, F.try_divide(F.col("alpha"), F.pow("square", F.lit(1.5)) * (2 * size))).otherwise(0.0)
    return g.with_df(own.withColumn("value", value))


def closest_point(g: Grid, size: float = 1.0) -> DataFrame:
    """(i, j, k, x, y, z): voxel minus distance times gradient."""
    d = gather(g, FACES)
    return d.select(*IJK, *[(F.col(c) * size - F.col("value") * _central(n, size=size)).alias(x) for n, (c, x) in enumerate(zip(IJK, "xyz"))])


def upwind_slope(outside: Column, size: float = 1.0) -> Column:
    """Godunov's norm of the gradient over gathered faces, from the side that information comes from."""
    total, zero = F.lit(0.0), F.lit(0.0)
    for n in range(3):
        back, ahead = (F.col("value") - F.col(name(axis(n, -1)))) / size, (F.col(name(axis(n))) - F.col("value")) / size
        plus = F.greatest(F.pow(F.greatest(back, zero), F.lit(2.0)), F.pow(F.least(ahead, zero), F.lit(2.0)))
        minus = F.greatest(F.pow(F.least(back, zero), F.lit(2.0)), F.pow(F.greatest(ahead, zero), F.lit(2.0)))
        total = total + F.when(outside, plus).otherwise(minus)
    return F.sqrt(total)


def upwind_norm(g: Grid, size: float = 1.0) -> Grid:
    """Godunov's norm of the gradient, with one-sided differences away from the surface."""
    return g.with_df(gather(g, FACES).withColumn("value", upwind_slope(F.col("value") > 0, size)))


def _keep_off(g: Grid, on: DataFrame) -> Grid:
    """New active voxels and the inactive ones as they were."""
    return g.with_df(on.select(*IJK, "value", "active").unionByName(g.df.where("not active")))


def box_pass(g: Grid, n: int, width: int) -> Grid:
    """Mean of the 2 width + 1 voxels along an axis."""
    steps = [axis(n, s) for s in range(-width, width + 1) if s]
    d = gather(g, steps)
    total = reduce(Column.__add__, [F.col(name(o)) for o in steps], F.col("value"))
    return _keep_off(g, d.withColumn("value", total / (2 * width + 1)))


def mean(g: Grid, width: int = 1) -> Grid:
    """Box filter, one axis after another."""
    return reduce(lambda x, n: box_pass(x, n, width), range(3), g)


def gaussian(g: Grid, width: int = 1, passes: int = 4) -> Grid:
    """Box filters in a row come near a Gaussian."""
    return reduce(lambda x, _: mean(x, width), range(passes), g)


def median(g: Grid) -> Grid:
    """Median of the 27 voxels around."""
    d = gather(g, CUBE)
    return _keep_off(g, d.withColumn("value", F.element_at(F.array_sort(F.array("value", *[name(o) for o in CUBE])), 14)))


def masked(g: Grid, changed: Grid, mask: Grid, low: float = 0.0, high: float = 1.0) -> Grid:
    """Blend of a grid and its filtered form by a mask's values, eased at both ends."""
    t = F.least(F.greatest((F.coalesce("m", F.lit(mask.background)) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    t = t * t * (F.lit(3.0) - t * 2)
    met = g.df.join(changed.df.select(*IJK, F.col("value").alias("new")), list(IJK), "left").join(mask.df.select(*IJK, F.col("value").alias("m")), list(IJK), "left")
    return g.with_df(met.withColumn("value", F.col("value") + (F.coalesce("new", "value") - F.col("value")) * t))


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows by voxel over a fixed number of tasks, which Spark doesn't merge; an aggregation by voxel needs no other shuffle."""
    return rows.repartition(tasks, *IJK)


def tasks_for(df: DataFrame, messages: int) -> int:
    """Tasks among which so many messages are dealt out."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-messages // SENT))


def _tasks(g: Grid, near: int, dilations: int, erosions: int = 0) -> int:
    """Tasks for as many messages as the widest of the steps can send: rows grow by their neighbours, within their box."""
    ends = g.df.agg(F.count(F.lit(1)), *[f(c) for c in IJK for f in (F.min, F.max)]).first()
    if not ends[0]:
        return tasks_for(g.df, 0)
    grown = dilations if erosions else dilations - 1
    box = 1
    for low, high in zip(ends[1::2], ends[2::2]):
        box *= high - low + 1 + 2 * grown
    rows = ends[0] * min((near + 1) ** grown, (2 * grown + 1) ** 3)
    return tasks_for(g.df, min(rows, box) * (near + 2))


def dilate(g: Grid, near: int = 6, steps: int = 1) -> Grid:
    """Neighbours of active voxels become active; their values stay, or are the background."""
    tasks = _tasks(g, near, steps)
    return _dilate(g.with_df(dealt(g.df, tasks)), near, steps, tasks)


def _dilate(g: Grid, near: int, steps: int, tasks: int) -> Grid:
    for _ in range(steps):
        sent = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in [(0, 0, 0), *NEAR[near]]]))
        grown = g.on.select(*IJK, sent.alias("o")).select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in IJK], F.lit(None).cast("double").alias("value"), F.lit(True).alias("active"))
        rows = dealt(grown.unionByName(g.df), tasks).groupBy(*IJK).agg(F.max("value").alias("value"), F.max("active").alias("active"))
        g = g.with_df(rows.withColumn("value", F.coalesce("value", F.lit(g.background))))
    return g


def erode(g: Grid, near: int = 6, steps: int = 1) -> Grid:
    """Active voxels with an inactive neighbour become inactive; values stay."""
    tasks = _tasks(g, near, 0, steps)
    return _erode(g.with_df(dealt(g.df, tasks)), near, steps, tasks)


def _erode(g: Grid, near: int, steps: int, tasks: int) -> Grid:
    for _ in range(steps):
        sent = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in [(0, 0, 0), *NEAR[near]]]))
        told = g.on.select(*IJK, sent.alias("o")).select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in IJK], F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("active"), F.lit(1).alias("n"))
        rows = dealt(told.unionByName(g.df.withColumn("n", F.lit(0))), tasks).groupBy(*IJK).agg(F.max("value").alias("value"), F.max("active").alias("active"), F.sum("n").alias("n"), F.count("value").alias("stored"))
        g = g.with_df(rows.where("active is not null").withColumn("active", F.col("active") & (F.col("n") == near + 1)))
    return g


def opened(g: Grid, near: int = 6, steps: int = 1) -> Grid:
    tasks = _tasks(g, near, steps)
    return _dilate(_erode(g.with_df(dealt(g.df, tasks)), near, steps, tasks), near, steps, tasks)


def closed(g: Grid, near: int = 6, steps: int = 1) -> Grid:
    tasks = _tasks(g, near, steps, steps)
    return _erode(_dilate(g.with_df(dealt(g.df, tasks)), near, steps, tasks), near, steps, tasks)


def surface_mask(g: Grid, iso: float = 0.0) -> Grid:
    """Active voxels where the values cross ``iso`` towards a neighbour."""
    d = gather(g, FACES)
    inside = F.col("value") < iso
    crosses = reduce(Column.__or__, [(F.col(name(o)) < iso) != inside for o in FACES])
    return Grid(d.where(crosses).select(*IJK, F.lit(1.0).alias("value"), "active"), 0.0)


def one_sided(g: Grid, step: int, size: float = 1.0) -> DataFrame:
    """(i, j, k, gx, gy, gz) by differences to the next (step 1) or the last (step -1) voxel."""
    d = gather(g, [axis(n, step) for n in range(3)])
    return d.select(*IJK, *[((F.col(name(axis(n, step))) - F.col("value")) * step / size).alias(c) for n, c in enumerate(("gx", "gy", "gz"))])
