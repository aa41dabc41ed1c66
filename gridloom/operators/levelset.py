"""Level sets: shapes, fog, motion, and solvers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid
from gridloom.operators.sample import trilinear
from gridloom.operators.stencil import FACES, gather, mean_curvature, name, norm, upwind_slope
from gridloom.operators.tree import _forget, _written


def lattice(spark: SparkSession, n: int, origin: int = 0) -> DataFrame:
    """All coordinates of a cube of n voxels a side."""
    rows = spark.range(n**3)
    return rows.select(F.expr(f"cast(id div {n * n} as int) + {origin}").alias("i"), F.expr(f"cast((id div {n}) % {n} as int) + {origin}").alias("j"), F.expr(f"cast(id % {n} as int) + {origin}").alias("k"))


def _band(rows: DataFrame, distance: Column, half: float) -> Grid:
    d = rows.withColumn("value", distance)
    return Grid(d.where(F.abs("value") < half).withColumn("active", F.lit(True)), half)


def sphere(spark: SparkSession, n: int, centre: tuple[float, float, float], radius: float, half: float = 3.0) -> Grid:
    """Narrow band of a sphere's signed distance."""
    d = [F.col(c) - x for c, x in zip(IJK, centre)]
    return _band(lattice(spark, n), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - radius, half)


def cube(spark: SparkSession, n: int, low: float, high: float, half: float = 3.0) -> Grid:
    """Narrow band of a cube's signed distance."""
    centre, side = (low + high) / 2, (high - low) / 2
    q = [F.abs(F.col(c) - centre) - side for c in IJK]
    zero = F.lit(0.0)
    out = [F.greatest(x, zero) for x in q]
    return _band(lattice(spark, n), F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2]) + F.least(F.greatest(*q), zero), half)


def torus(spark: SparkSession, n: int, centre: float, ring: float, tube: float, half: float = 3.0) -> Grid:
    """Narrow band of a torus around the k axis."""
    x, y, z = (F.col(c) - centre for c in IJK)
    flat = F.sqrt(x * x + y * y) - ring
    return _band(lattice(spark, n), F.sqrt(flat * flat + z * z) - tube, half)


def fog(g: Grid, cutoff: float) -> Grid:
    """Density: 1 inside beyond the cutoff, a ramp to 0 at the surface; only the inside stays."""
    ramp = F.least(F.col("value") / -cutoff, F.lit(1.0))
    return Grid(g.df.where("value < 0").withColumn("value", ramp).withColumn("active", F.lit(True)), 0.0)


def interior(g: Grid, iso: float = 0.0) -> Grid:
    """Mask of voxels below iso."""
    return Grid(g.df.where(F.col("value") < iso).select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")), 0.0)


def offset(g: Grid, distance: float) -> Grid:
    """The surface moved outwards by a distance."""
    return g.map(F.col("value") - distance)


def laplacian_flow(g: Grid, steps: int = 1, rate: float = 1 / 6) -> Grid:
    """Smoothing by the Laplacian, each step over the one before."""
    for _ in range(steps):
        total = reduce(Column.__add__, [F.col(name(o)) for o in FACES])
        d = gather(g, FACES).withColumn("value", F.col("value") + (total - F.col("value") * 6) * rate)
        g = g.with_df(d.unionByName(g.df.where("not active"), allowMissingColumns=True))
    return g


def curvature_flow(g: Grid, rate: float = 0.25) -> Grid:
    """One step of motion by mean curvature."""
    bend = mean_curvature(g).df.select(*IJK, F.col("value").alias("bend"))
    steep = norm(g).df.select(*IJK, F.col("value").alias("steep"))
    return g.with_df(g.on.join(bend, list(IJK)).join(steep, list(IJK)).withColumn("value", F.col("value") + F.col("bend") * F.col("steep") * rate))


def poisson(g: Grid, steps: int = 10) -> Grid:
    """Jacobi steps towards laplacian = value, with 0 outside the active voxels."""
    right = g.on.select(*IJK, F.col("value").alias("f"))
    x = Grid(right.select(*IJK, F.lit(0.0).alias("value"), F.lit(True).alias("active")), 0.0)
    for n in range(1, steps + 1):
        total = reduce(Column.__add__, [F.col(name(o)) for o in FACES])
        x = x.with_df(gather(x, FACES).join(right, list(IJK)).withColumn("value", (total - F.col("f")) / 6))
        if n % 4 == 0:
            x = x.with_df(_written(x.df))
    return x


def poisson_solved(g: Grid, tolerance: float = 1e-6) -> Grid:
    """laplacian = value in the active voxels, with 0 outside them, by conjugate gradients.

    Ends when the residual's length is ``tolerance`` of the right side's. A round is one shuffle and two sums.
    """
    state = _written(g.on.select(*IJK, F.lit(0.0).alias("x"), (-F.col("value")).alias("r"), (-F.col("value")).alias("p")))
    start = rest = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    while rest > tolerance**2 * start:
        total = reduce(Column.__add__, [F.col(name(o)) for o in FACES])
        near = gather(Grid(state.select(*IJK, F.col("p").alias("value"), F.lit(True).alias("active"))), FACES)
        both = _written(state.join(near.select(*IJK, (F.col("value") * 6 - total).alias("q")), list(IJK)))
        step = rest / both.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = both.select(*IJK, (F.col("x") + F.col("p") * step).alias("x"), (F.col("r") - F.col("q") * step).alias("r"), "p")
        left = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        old, state = state, moved.withColumn("p", F.col("r") + F.col("p") * (left / rest))
        _forget(old) if old.inputFiles() != both.inputFiles() else None
        rest = left
    return Grid(state.select(*IJK, F.col("x").alias("value"), F.lit(True).alias("active")), 0.0)


def distances(seeds: Grid, domain: Grid, far: float = 1e9) -> Grid:
    """Distance from seeds through active voxels of a domain along faces; ``far`` where no way leads.

    Rounds of four steps are written, until nothing changes.
    """
    start = domain.on.join(seeds.on.select(*IJK, F.lit(0.0).alias("s")), list(IJK), "left").select(*IJK, F.coalesce("s", F.lit(far)).alias("value"), F.lit(True).alias("active"))
    g, before = Grid(_written(start), far), None
    while True:
        old = g
        for _ in range(4):
            g = g.with_df(gather(g, FACES).withColumn("value", F.least("value", F.least(*[name(o) for o in FACES]) + 1.0)))
        g = g.with_df(_written(g.df))
        _forget(old.df)
        now = tuple(g.df.agg(F.count_if(F.col("value") < far), F.sum(F.when(F.col("value") < far, F.col("value")))).first())
        if now == before:
            return g
        before = now


def advect(g: Grid, velocity: tuple[float, float, float], time: float) -> Grid:
    """Semi-Lagrangian step: each voxel takes the value that stood upstream."""
    asked = g.on.select(F.struct(*IJK).alias("id"), *[(F.col(c) - v * time).alias(a) for c, a, v in zip(IJK, "xyz", velocity)])
    return Grid(trilinear(g, asked).select(*[F.col("id")[c].alias(c) for c in IJK], "value", F.lit(True).alias("active")), g.background)


def first_hits(g: Grid, along: int = 2) -> DataFrame:
    """Rays along an axis: for each line its first active voxel and value."""
    rest = [c for n, c in enumerate(IJK) if n != along]
    return g.on.groupBy(*rest).agg(F.min(IJK[along]).alias("hit"), F.min_by("value", IJK[along]).alias("value"))


def steepness(g: Grid) -> DataFrame:
    """Mean of |gradient| and its largest departure from 1: how far a level set is from a distance."""
    return norm(g).df.agg(F.avg("value").alias("mean"), F.max(F.abs(F.col("value") - 1)).alias("most"))


def normalised(g: Grid, steps: int = 1, rate: float = 0.3) -> Grid:
    """Steps towards slope 1 that leave the surface where it is: a level set becomes a distance again."""
    for n in range(1, steps + 1):
        v = F.col("value")
        moved = v - v / F.sqrt(v * v + 1.0) * (upwind_slope(v > 0) - 1.0) * rate
        g = g.with_df(gather(g, FACES).withColumn("value", moved).unionByName(g.df.where("not active"), allowMissingColumns=True))
        if n % 4 == 0:
            g = g.with_df(_written(g.df))
    return g


def morphed(g: Grid, target: Grid, rate: float = 0.3) -> Grid:
    """One step of a level set towards another: the surface moves along its normal by the target's value."""
    d = gather(g, FACES).join(target.df.select(*IJK, F.col("value").alias("speed")), list(IJK), "left")
    d = d.withColumn("speed", F.coalesce("speed", F.lit(target.background)))
    return g.with_df(d.withColumn("value", F.col("value") - F.col("speed") * upwind_slope(F.col("speed") > 0) * rate))


def particles(points: DataFrame, radius: Column, half: float = 3.0) -> Grid:
    """Narrow band of the union of spheres around points (px, py, pz).

    A point's rows are bounded by its radius; the nearest sphere of a voxel is found by a minimum, before the shuffle too.
    """
    rows = points.select("px", "py", "pz", radius.cast("double").alias("r"))
    for c, p in zip(IJK, ("px", "py", "pz")):
        reach = F.col("r") + half
        rows = rows.withColumn(c, F.explode(F.sequence(F.ceil(F.col(p) - reach).cast("int"), F.floor(F.col(p) + reach).cast("int"))))
    d = [F.col(c) - F.col(p) for c, p in zip(IJK, ("px", "py", "pz"))]
    away = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - F.col("r")
    nearest = rows.groupBy(*IJK).agg(F.min(away).alias("value"))
    return Grid(nearest.where(F.abs("value") < half).withColumn("active", F.lit(True)), half)


def trimmed(g: Grid, half: float) -> Grid:
    """The band made narrower: voxels at or beyond ``half`` go, and the background follows."""
    return Grid(g.df.where(F.abs("value") < half), half)


def tracked(g: Grid, half: float, steps: int = 1) -> Grid:
    """Upkeep after a motion: slope 1 again, then the band trimmed to ``half``."""
    return trimmed(normalised(g, steps), half)


def flowed(g: Grid, velocity, time: float) -> Grid:
    """An upwind step of a level set in a field: ``velocity`` gives columns of a position's."""
    d = gather(g, FACES).withColumns({f"u{c}": u for c, u in zip(IJK, velocity(*[F.col(c).cast("double") for c in IJK]))})
    zero, change = F.lit(0.0), F.lit(0.0)
    for n, c in enumerate(IJK):
        ahead, back = (tuple(s * (m == n) for m in range(3)) for s in (1, -1))
        u = F.col(f"u{c}")
        change = change + F.greatest(u, zero) * (F.col("value") - F.col(name(back))) + F.least(u, zero) * (F.col(name(ahead)) - F.col("value"))
    return g.with_df(d.withColumn("value", F.col("value") - change * time).unionByName(g.df.where("not active"), allowMissingColumns=True))
