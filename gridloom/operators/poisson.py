"""Poisson's equation with boundary terms, by conjugate gradients behind a multigrid cycle, and potential flow.

The matrix stands in the rows: ``diag`` and one weight for each face (w0 to w5, 0 where no voxel of the domain is). As
weights are symmetric, a product is one aggregation of what each row sends, without a join. A coarser matrix adds up the
rows of 2 x 2 x 2 voxels, weights within them falling out of the sum, so it comes from the aggregation that adds up the
residuals; no level is stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.model import IJK, Grid
from gridloom.operators.stencil import EDGES, FACES, Offset, gather, gradient, name
from gridloom.operators.tree import _forget, _written, segments

#: What the neighbour that a voxel lacks at an offset adds to its right side and to its diagonal.
Terms = Callable[[Offset], tuple[Column, Column]]

W = [f"w{n}" for n in range(len(FACES))]
MATRIX = ["diag", *W]
#: Share of a Jacobi correction that is taken, and by how much sums of 2 x 2 x 2 voxels are too stiff.
DAMPING, STIFF = 0.85, 1.8
#: Jacobi corrections before and after a coarser level: with two, rounds go from 9 to 11 as a cube's edge goes from 32 to 64.
SWEEPS = 2
#: Levels are added until no more cells than these are left, which one task solves.
COARSEST = 1024


@dataclass(frozen=True)
class Solution:
    """What a solver found, after how many rounds, and the residual's length by the right side's."""

    grid: Grid
    rounds: int
    error: float


def dirichlet(value: Column | float = 0.0) -> Terms:
    """A value beyond the domain. It may be made of the voxel's columns."""
    return lambda o: (-(value if isinstance(value, Column) else F.lit(float(value))), F.lit(-1.0))


def neumann(slope: Column | float = 0.0) -> Terms:
    """By how much the solution rises from the voxel to the neighbour that it lacks."""
    return lambda o: (-(slope if isinstance(slope, Column) else F.lit(float(slope))), F.lit(0.0))


def system(rows: DataFrame, terms: Terms) -> DataFrame:
    """(i, j, k, b, diag, w0 to w5) of -laplacian = -value on a domain of rows (i, j, k, value, others).

    ``terms`` are columns over these rows, asked for each of the six offsets. A null value counts as 0.
    """
    ones = Grid(rows.select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")))
    near = gather(ones, FACES).select(*IJK, *[F.col(name(o)).alias(w) for o, w in zip(FACES, W)])
    right, diag = F.coalesce(F.col("value").cast("double"), F.lit(0.0)), reduce(Column.__add__, map(F.col, W))
    for o, w in zip(FACES, W):
        source, diagonal = terms(o)
        right = right + F.when(F.col(w) == 0, source).otherwise(0.0)
        diag = diag - F.when(F.col(w) == 0, diagonal).otherwise(0.0)
    return near.join(rows, list(IJK)).select(*IJK, (-right).alias("b"), diag.alias("diag"), *W)


def _product(rows: DataFrame, x: str, into: str) -> DataFrame:
    """The matrix times a column, beside the rows' own columns."""
    keep = [c for c in rows.columns if c not in IJK]
    parts = [((0, 0, 0), f"diag * {x}"), *[(o, f"-{w} * {x}") for o, w in zip(FACES, W)]]
    sent = ", ".join(f"struct({'true' if n == 0 else 'false'} as _own, {o[0]} as _di, {o[1]} as _dj, {o[2]} as _dk, {part} as _part)" for n, (o, part) in enumerate(parts))
    out = rows.selectExpr(*IJK, *keep, f"inline(array({sent}))").where("_own or _part <> 0")
    out = out.selectExpr(*[f"{c} + _d{c} as {c}" for c in IJK], *[f"case when _own then {c} end as {c}" for c in keep], "_part")
    return out.groupBy(*IJK).agg(*[F.expr(f"max({c}) as {c}") for c in keep], F.expr(f"sum(_part) as {into}"))


def _coarser(rows: DataFrame) -> DataFrame:
    """(i, j, k, diag, w0 to w5, r) of cells of 2 x 2 x 2: sums of residuals and of weights that leave a cell."""
    leaves = [next(f"({c} & 1) = {int(x > 0)}" for c, x in zip(IJK, o) if x) for o in FACES]
    within = " + ".join(f"if({leave}, 0, {w})" for leave, w in zip(leaves, W))
    sums = [f"sum(diag - ({within})) / {STIFF}D as diag", *[f"sum(if({leave}, {w}, 0)) / {STIFF}D as {w}" for leave, w in zip(leaves, W)], "sum(_d) as r"]
    return rows.selectExpr(*[f"shiftright({c}, 1) as _p{c}" for c in IJK], *IJK, *MATRIX, "_d").groupBy(*[F.col(f"_p{c}").alias(c) for c in IJK]).agg(*map(F.expr, sums))


#: A damped Jacobi correction; a cell that nothing ties down gets none.
_JACOBI = f"if(diag > 1e-9D, {{}} / diag * {DAMPING}D, 0D)"


def _answered(cells: pd.DataFrame) -> pd.DataFrame:
    """The coarsest equations, at most COARSEST, solved at once; what they leave free is held by a trace of their size."""
    at = {tuple(c): n for n, c in enumerate(cells[list(IJK)].to_numpy().tolist())}
    m = np.diag(cells["diag"].to_numpy())
    for o, w in zip(FACES, W):
        for n, (c, weight) in enumerate(zip(at, cells[w])):
            if weight:
                m[n, at[tuple(np.add(c, o).tolist())]] -= weight
    m[np.diag_indices(len(m))] += 1e-8 * np.diag(m).max()
    return cells.assign(z=np.linalg.solve(m, cells["r"].to_numpy()))


def _cycle(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (i, j, k, matrix, r, others) with z, a symmetric multigrid cycle's answer to r."""
    if depth == 0:
        return rows.groupBy().applyInPandas(_answered, StructType([*rows.schema.fields, StructField("z", DoubleType())]))
    own = rows.columns
    smooth = rows.selectExpr("*", f"{_JACOBI.format('r')} as z")
    for _ in range(SWEEPS - 1):
        smooth = _product(smooth, "z", "_az").selectExpr(*own, f"z + {_JACOBI.format('(r - _az)')} as z")
    smooth = _product(smooth, "z", "_az").selectExpr(*own, "z", "r - _az as _d")
    found = _cycle(_coarser(smooth), depth - 1).selectExpr(*[f"{c} as _p{c}" for c in IJK], "z as _z")
    cells = smooth.selectExpr(*own, "z", *[f"shiftright({c}, 1) as _p{c}" for c in IJK])
    better = cells.join(found, [f"_p{c}" for c in IJK]).selectExpr(*own, "z + _z as z")
    for _ in range(SWEEPS):
        better = _product(better, "z", "_az").selectExpr(*own, f"z + {_JACOBI.format('(r - _az)')} as z")
    return better


def _depth(rows: DataFrame) -> int:
    """Levels above the voxels, until at most COARSEST cells are left."""
    depth, left = 0, rows.count()
    while left > COARSEST:
        depth += 1
        left = rows.select(*[F.shiftright(c, depth).alias(c) for c in IJK]).distinct().count()
    return depth


def _balanced(state: DataFrame) -> DataFrame:
    """The system's rows, with the mean taken off the right side in parts of the domain without any value beyond them.

    Such a part has a solution only if its right side sums to 0; the rest of it can't be met by any, and would grow in
    the rounds. Where each side of the domain has a value, no part is searched for.
    """
    beside = reduce(Column.__add__, map(F.col, W))
    if state.where((beside < len(FACES)) & (F.col("diag") - beside < len(FACES) - beside)).isEmpty():
        return state
    parts = segments(Grid(state.select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")))).select(*IJK, F.struct("si", "sj", "sk").alias("part"))
    parted = _written(state.join(parts, list(IJK)))
    free = parted.groupBy("part").agg(F.max(F.col("diag") - beside).alias("held"), F.avg("r").alias("mean")).where("held <= 1e-9D and mean <> 0").select("part", "mean")
    out = _written(parted.join(free, "part", "left").withColumn("r", F.col("r") - F.coalesce("mean", F.lit(0.0))).select(*state.columns))
    _forget(parted)
    _forget(state)
    return out


def solved(rows: DataFrame, terms: Terms | None = None, tolerance: float = 1e-6, rounds: int = 200, largest: float = float("inf")) -> Solution:
    """laplacian = value on a domain of rows (i, j, k, value, others), with terms for neighbours that the domain lacks.

    The stencil has the six faces (samples staggered). Without terms the solution is 0 beyond the domain. A part of the
    domain without any value beyond it has a solution up to a constant if its right side sums to 0, else none: it then
    gets that of its right side less the mean. Ends when the residual's length is ``tolerance`` of the right side's and at most ``largest``, which
    bounds every equation's error whatever the size of the values; the rounds hardly grow with the domain. A round writes two tables to the shared folder; the driver sees three sums.
    """
    state = _written(system(rows, terms or dirichlet()).select(*IJK, *MATRIX, F.lit(0.0).alias("x"), F.col("b").alias("r"), F.lit(0.0).alias("p")))
    state = _balanced(state)
    length = F.sum(F.col("r") * F.col("r"))
    start = left = state.agg(length).first()[0] or 0.0
    depth, done, rho, table = _depth(state) if start else 0, 0, None, state
    while left > min(tolerance**2 * start, largest**2) and done < rounds:
        answered = _written(_cycle(state, depth))
        _forget(table)
        now = answered.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
        turned = answered.withColumn("p", F.col("z") + F.col("p") * (now / rho if rho else 0.0)).drop("z")
        table = _written(_product(turned, "p", "q"))
        _forget(answered)
        step = now / table.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        state = table.withColumns({"x": F.col("x") + F.col("p") * step, "r": F.col("r") - F.col("q") * step}).drop("q")
        left = state.agg(length).first()[0]
        rho, done = now, done + 1
    grid = Grid(state.select(*IJK, F.col("x").alias("value"), F.lit(True).alias("active")), 0.0)
    return Solution(grid, done, (left / start) ** 0.5 if start else 0.0)


def applied(rows: DataFrame, terms: Terms, x: Grid) -> DataFrame:
    """(i, j, k, left, right): both sides of the equations that :func:`solved` solves, for a candidate x."""
    known = system(rows, terms).join(x.df.select(*IJK, F.col("value").alias("x")), list(IJK))
    return _product(known, "x", "ax").select(*IJK, (-F.col("ax")).alias("left"), (-F.col("b")).alias("right"))


# --- potential flow ----------------------------------------------------------------------------------------
def flow_domain(g: Grid, dilation: int = 5) -> Grid:
    """Voxels outside a level set within a number of steps over faces and edges.

    The inside needn't be full: steps go outwards only, as they can't cross a band of at least 1.5 voxels.
    """
    rows = g.on.where("value < 0").select(*IJK, F.lit(True).alias("inside"))
    outside = g.on.where("value >= 0").select(*IJK, F.lit(False).alias("inside"))
    here = F.struct(*[F.lit(0).alias(f"d{c}") for c in IJK], F.lit(True).alias("own"))
    sent = F.array(here, *[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)], F.lit(False).alias("own")) for o in EDGES])
    for n in range(dilation):
        spreads = F.col("inside") if n == 0 else ~F.col("inside")
        known = rows.unionByName(outside) if n == 0 else rows
        out = known.select(*IJK, "inside", F.inline(F.when(spreads, sent).otherwise(F.array(here))))
        met = out.select(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK], "inside", "own").groupBy(*IJK)
        if n == 0:
            rows = met.agg(F.max(F.when(F.col("own"), F.col("inside"))).alias("inside"), F.max(~F.col("own")).alias("next")).where("inside or (not inside and next)").select(*IJK, "inside")
        else:
            rows = met.agg(F.max("inside").alias("inside"))
        rows = _written(rows) if n % 4 == 3 else rows
    return Grid(rows.where("not inside").select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")), 0.0)


def wall_velocities(g: Grid, domain: Grid, wind: tuple[float, float, float], moving: DataFrame | None = None) -> DataFrame:
    """(i, j, k, vx, vy, vz): the part along a level set's normal of a wind and of the wall's own velocity.

    ``moving`` is (i, j, k, vx, vy, vz), 0 where it has no row. Voxels of the domain in the level set's band get a row,
    but where its gradient is 0. Nothing moves: no rows.
    """
    rows = gradient(g).join(domain.on.select(*IJK), list(IJK), "left_semi")
    if moving is None:
        rows = rows.withColumns({v: F.lit(float(w)) for v, w in zip(("vx", "vy", "vz"), wind)})
        rows = rows if any(wind) else rows.where(F.lit(False))
    else:
        rows = rows.join(moving.select(*IJK, "vx", "vy", "vz"), list(IJK), "left")
        rows = rows.withColumns({v: F.coalesce(v, F.lit(0.0)) + float(w) for v, w in zip(("vx", "vy", "vz"), wind)})
    dot = F.col("gx") * F.col("vx") + F.col("gy") * F.col("vy") + F.col("gz") * F.col("vz")
    rows = rows.withColumn("_along", dot).withColumn("_steep", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")).where("_steep > 0")
    return rows.select(*IJK, *[(F.col("_along") * F.col(a) / F.col("_steep")).alias(v) for v, a in zip(("vx", "vy", "vz"), ("gx", "gy", "gz"))])


def flow_equation(domain: Grid, wall: DataFrame) -> tuple[DataFrame, Terms]:
    """Rows and terms of a potential: a voxel with a wall velocity gives its slope, any other is next to 0."""
    rows = domain.on.select(*IJK, F.lit(0.0).alias("value")).join(wall.select(*IJK, "vx", "vy", "vz"), list(IJK), "left")

    def terms(o: Offset) -> tuple[Column, Column]:
        slope = reduce(Column.__add__, [F.col(v) * float(x) for v, x in zip(("vx", "vy", "vz"), o)])
        return F.coalesce(-slope, F.lit(0.0)), F.when(F.col("vx").isNull(), -1.0).otherwise(0.0)

    return rows, terms


def potential(domain: Grid, wall: DataFrame, tolerance: float = 1e-6, rounds: int = 200, largest: float = float("inf")) -> Solution:
    """The scalar potential whose slope at walls is the wall's velocity. Ends as :func:`solved` does.

    A part of the domain with walls all around has a potential only if what flows in flows out; else its equations stay
    unmet by the mean of their right sides, which is the least that any potential can reach in all of them at once.
    """
    return solved(*flow_equation(domain, wall), tolerance, rounds, largest)


def flow(potential: Grid, wall: DataFrame, wind: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(i, j, k, vx, vy, vz): the potential's gradient less the wind; at the domain's skin, the wall's velocity where it has one."""
    around = gather(Grid(potential.df.select(*IJK, "value", F.lit(1.0).alias("in"), "active"), 0.0), FACES, ("value", "in"))
    slopes = [(F.col(f"{name(tuple(int(m == n) for m in range(3)))}_value") - F.col(f"{name(tuple(-int(m == n) for m in range(3)))}_value")) / 2 for n in range(3)]
    skin = reduce(Column.__or__, [F.col(f"{name(o)}_in") == 0 for o in FACES])
    rows = around.select(*IJK, skin.alias("skin"), *[s.alias(f"g{a}") for s, a in zip(slopes, "xyz")]).join(wall.select(*IJK, "vx", "vy", "vz"), list(IJK), "left")
    held = F.col("skin") & F.col("vx").isNotNull()
    return rows.select(*IJK, *[(F.when(held, F.col(f"v{a}")).otherwise(F.col(f"g{a}")) - float(w)).alias(f"v{a}") for a, w in zip("xyz", wind)])
