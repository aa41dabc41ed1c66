"""Level sets that move, with bands that move along: upwind schemes, steps of several stages, tracking and resizing.

A step is as long as the fastest voxel allows. Its stages each bring the voxels of the stencil together in one shuffle:
one voxel on both sides of each axis for first-order differences, three for the fifth-order weighted essentially
non-oscillatory ones. Then the band follows the surface: it grows by a layer, is brought back to slope 1, and what is no
longer within its width goes. So the surface may move any distance. Every step is written to the shared folder, which
bounds the plan and what a lost executor repeats, and so is every stage but the last of a step. A voxel that the band lacks has the background on the side of the last
voxel before it on the axis.

Formulas are SQL text, in stages of named columns, so that no column is written out twice in a plan.

Defined results: grids without rows stay so; a surface that doesn't move is tracked all the same, once a step; where the
surface leaves or vanishes, so does its band.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid
from gridloom.operators.stencil import FACES, Offset, axis, name
from gridloom.operators.tree import _forget, _written

Stages = list[dict[str, str]]
Velocity = Callable[[Column, Column, Column, float], tuple[Column, Column, Column]]
#: Voxels that a difference scheme needs on each side.
REACH = {"first": 1, "weno5": 3}
#: Longest step in voxels by the number of stages, for motion along three axes at once, and for the return to slope 1.
CFL, NORMAL = {1: 0.3 / sqrt(3), 2: 0.9 / sqrt(3), 3: 1.0 / sqrt(3)}, 0.3
#: By the number of stages: how much of the first state each of them mixes in.
FIRST = {1: (0.0,), 2: (0.0, 0.5), 3: (0.0, 0.75, 1 / 3)}


def at(n: int, step: int) -> str:
    """Column of the voxel so many steps along an axis."""
    return "value" if step == 0 else f"q{n}{'m' if step < 0 else 'p'}{abs(step)}"


def offsets(scheme: str) -> list[Offset]:
    return [axis(n, s * k) for n in range(3) for k in range(1, REACH[scheme] + 1) for s in (-1, 1)]


def resolved(scheme: str, half: float) -> Stages:
    """Columns :func:`at` from gathered ones; what is missing is the background on the side of the voxel before."""
    return [{at(n, s * k): f"coalesce({name(axis(n, s * k))}, case when {at(n, s * (k - 1))} < 0 then cast({-half} as double) else cast({half} as double) end)" for n in range(3) for s in (-1, 1)} for k in range(1, REACH[scheme] + 1)]


def _differences(n: int, side: int, scheme: str) -> list[str]:
    """Differences in the order in which the scheme towards a side wants them."""
    gap = lambda a, b: f"({at(n, b)} - {at(n, a)})"
    if scheme == "first":
        return [gap(-1, 0) if side < 0 else gap(0, 1)]
    return [gap(a, a + 1) for a in range(-3, 2)] if side < 0 else [gap(a, a + 1) for a in range(2, -3, -1)]


def _weighed(tag: str, v: list[str]) -> Stages:
    """The derivative ``tag`` from one difference, or from five by three parabolas weighed by their smoothness."""
    if len(v) == 1:
        return [{tag: v[0]}]
    a, b, c, d, e = (f"{tag}_{n}" for n in range(5))
    square = lambda x: f"({x}) * ({x})"
    rough = [f"13.0 / 12 * {square(f'{a} - 2 * {b} + {c}')} + 0.25 * {square(f'{a} - 4 * {b} + 3 * {c}')}", f"13.0 / 12 * {square(f'{b} - 2 * {c} + {d}')} + 0.25 * {square(f'{b} - {d}')}", f"13.0 / 12 * {square(f'{c} - 2 * {d} + {e}')} + 0.25 * {square(f'3 * {c} - 4 * {d} + {e}')}"]
    weights = {f"{tag}_w{n}": f"cast({w} as double) / ({square(f'1e-6 + {r}')})" for n, (w, r) in enumerate(zip((0.1, 0.6, 0.3), rough))}
    w0, w1, w2 = weights
    mean = f"({w0} * (2 * {a} - 7 * {b} + 11 * {c}) + {w1} * (5 * {c} - {b} + 2 * {d}) + {w2} * (2 * {c} + 5 * {d} - {e})) / (6 * ({w0} + {w1} + {w2}))"
    return [dict(zip((a, b, c, d, e), v)), weights, {tag: mean}]


def _together(*parts: Stages) -> Stages:
    """Stages of independent columns side by side."""
    return [dict(item for p in parts if n < len(p) for item in p[n].items()) for n in range(max(map(len, parts)))]


def carried(scheme: str) -> Stages:
    """``rate``: how fast values change in a field of velocities u0, u1, u2, with differences from upwind."""
    upwind = [_weighed(f"d{n}", [f"case when u{n} > 0 then {m} else {p} end" for m, p in zip(_differences(n, -1, scheme), _differences(n, 1, scheme))]) for n in range(3)]
    return [*_together(*upwind), {"rate": "-(u0 * d0 + u1 * d1 + u2 * d2)"}]


def _slope2(scheme: str, outside: str) -> Stages:
    """``slope2``: Godunov's square of the gradient for a surface that moves outwards where ``outside`` holds."""
    both = [_weighed(f"{tag}{n}", _differences(n, side, scheme)) for n in range(3) for tag, side in (("b", -1), ("f", 1))]
    low, high = lambda x: f"least({x}, cast(0 as double))", lambda x: f"greatest({x}, cast(0 as double))"
    square = lambda x: f"{x} * {x}"
    terms = [f"case when {outside} then greatest({square(high(f'b{n}'))}, {square(low(f'f{n}'))}) else greatest({square(low(f'b{n}'))}, {square(high(f'f{n}'))}) end" for n in range(3)]
    return [*_together(*both), {"slope2": " + ".join(terms)}]


def pushed(scheme: str) -> Stages:
    """``rate`` of a surface that moves along its normal at a speed u0."""
    return [*_slope2(scheme, "u0 > 0"), {"rate": "-u0 * sqrt(slope2)"}]


def levelled(scheme: str) -> Stages:
    """``rate`` towards slope 1 that leaves the surface where it is."""
    return [*_slope2(scheme, "value > 0"), {"rate": "-value / sqrt(value * value + slope2 + 1e-30) * (sqrt(slope2) - 1)"}]


def _around(df: DataFrame, scheme: str, half: float, *keep: str) -> DataFrame:
    """Voxels (i, j, k, value, ...) with what stands along the axes; other columns stay at home."""
    sent = F.inline(F.array(*[F.struct(F.lit(n).alias("o"), *[F.lit(-x).alias(f"d{c}") for c, x in zip(IJK, o)]) for n, o in enumerate([(0, 0, 0), *offsets(scheme)])]))
    rows = df.select(*IJK, "value", *keep, sent).select(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK], "o", "value", *[F.when(F.col("o") == 0, F.col(c)).alias(c) for c in keep])
    near = [F.max(F.when(F.col("o") == n, F.col("value"))).alias(name(o)) for n, o in enumerate(offsets(scheme), 1)]
    met = rows.groupBy(*IJK).agg(F.max(F.when(F.col("o") == 0, F.col("value"))).alias("value"), *[F.max(c).alias(c) for c in keep], *near)
    return staged(met.where("value is not null"), resolved(scheme, half))


def staged(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} as {n}" for n, e in stage.items()])
    return df


def normalised(g: Grid, count: int = 3, scheme: str = "weno5", only: DataFrame | None = None) -> Grid:
    """Steps towards slope 1; ``only`` names the voxels (i, j, k) that may change."""
    df = g.on.select(*IJK, "value")
    if only is not None:
        df = df.join(only.select(*IJK, F.lit(True).alias("free")), list(IJK), "left")
    free = ["free"] * (only is not None)
    made = None
    for _ in range(count):
        near = staged(_around(df, scheme, g.background, *free), levelled(scheme))
        value = F.col("value") + F.col("rate") * NORMAL
        # Written each time: Catalyst would push a later filter on values down through the stages, and write them out.
        df = _written(near.select(*IJK, (value if only is None else F.when(F.col("free"), value).otherwise(F.col("value"))).alias("value"), *free))
        if made is not None:
            _forget(made)
        made = df
    return Grid(df.select(*IJK, "value", F.lit(True).alias("active")), g.background)


def layered(g: Grid, background: float) -> Grid:
    """The band and the face neighbours of its voxels; these have the background on the side that most of it is on."""
    sent = F.inline(F.array(*[F.struct(F.lit(n).alias("o"), *[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for n, o in enumerate([(0, 0, 0), *FACES])]))
    rows = g.on.select(*IJK, "value", sent).select(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK], F.when(F.col("o") == 0, F.col("value")).alias("own"), F.when(F.col("value") < 0, -1).otherwise(1).alias("side"))
    met = rows.groupBy(*IJK).agg(F.max("own").alias("own"), F.sum("side").alias("side"))
    return Grid(met.select(*IJK, F.coalesce("own", F.when(F.col("side") < 0, -background).otherwise(F.lit(background))).alias("value"), F.lit(True).alias("active")), background)


def tracked(g: Grid, count: int = 3, scheme: str = "weno5") -> Grid:
    """The band around where the surface is now: a layer more, slope 1, and nothing beyond the band's width."""
    layer = _written(layered(g, g.background).df)
    g = normalised(Grid(layer, g.background), count, scheme)
    if count:
        _forget(layer)
    return Grid(g.df.where(F.abs("value") < g.background), g.background)


def widened(g: Grid, layers: int = 1, count: int = 3, scheme: str = "weno5") -> Grid:
    """A band wider by layers, each brought to slope 1 while the voxels before it stay."""
    for _ in range(layers):
        old = _written(g.on.select(*IJK, "value", "active"))
        wide = layered(Grid(old, g.background), g.background + 1)
        new = _written(wide.df)
        g = normalised(Grid(new, wide.background), count, scheme, new.join(old, list(IJK), "left_anti"))
        _forget(old)
        if count:
            _forget(new)
    return g


def resized(g: Grid, half: float, count: int = 3, scheme: str = "weno5") -> Grid:
    """A band of another width: layers are added, or voxels beyond it go."""
    more = int(half) - int(g.background)
    if more > 0:
        g = widened(g, more, count, scheme)
    return Grid(g.on.select(*IJK, "value", "active").where(F.abs("value") < half), half)


def _moved(g: Grid, rate: Stages, speeds: Callable[[float, DataFrame], DataFrame], fastest: Column, start: float, end: float, stages: int, scheme: str, count: int, track_scheme: str) -> tuple[Grid, int]:
    """Steps from start to end; ``speeds`` adds the columns u to voxels at a time, ``fastest`` is the largest speed in them."""
    if stages not in FIRST or scheme not in REACH:
        raise ValueError(f"no integration of {stages} stages with differences {scheme}")
    time, steps, g = start, 0, Grid(_written(g.on.select(*IJK, "value", "active")), g.background)
    while end - time > 1e-12 * max(1.0, abs(end)):
        top = speeds(time, g.df).agg(F.max(fastest)).first()[0]
        if top is None:
            break
        dt = end - time if top == 0 else min(CFL[stages] / top, end - time)
        df = g.df.select(*IJK, "value", F.col("value").alias("first"))
        made = []
        for n, part in enumerate(FIRST[stages]):
            if n:
                df = _written(df)
                made.append(df)
            near = staged(speeds(time, _around(df, scheme, g.background, "first")), rate)
            df = near.select(*IJK, (F.col("first") * part + (F.col("value") + F.col("rate") * dt) * (1 - part)).alias("value"), "first")
        made.append(_written(df.select(*IJK, "value", F.lit(True).alias("active"))))
        moved = tracked(Grid(made[-1], g.background), count, track_scheme)
        old, g = g, moved
        for done in (old.df, *made[: None if count else -1]):
            _forget(done)
        time, steps = time + dt, steps + 1
    return g, steps


def advected(g: Grid, velocity: Velocity, start: float, end: float, stages: int = 2, scheme: str = "weno5", count: int = 3, track_scheme: str = "weno5") -> tuple[Grid, int]:
    """A level set carried by a field from a time to another, and in how many steps.

    ``velocity`` gives columns of a position's velocity at a time, in voxels.
    """

    def speeds(time: float, df: DataFrame) -> DataFrame:
        return df.withColumns({f"u{n}": u for n, u in enumerate(velocity(*[F.col(c).cast("double") for c in IJK], time))})

    return _moved(g, carried(scheme), speeds, F.sqrt(sum((F.col(f"u{n}") * F.col(f"u{n}") for n in range(1, 3)), F.col("u0") * F.col("u0"))), start, end, stages, scheme, count, track_scheme)


def morphed(g: Grid, target: Grid, start: float, end: float, stages: int = 2, scheme: str = "weno5", count: int = 3, track_scheme: str = "weno5") -> tuple[Grid, int]:
    """A level set that moves along its normals at the target's value there, until it lies on the target's surface.

    Where the target's band has no voxel, its background is the speed, as outside it.
    """
    field = target.df.select(*IJK, F.col("value").alias("u0"))

    def speeds(time: float, df: DataFrame) -> DataFrame:
        return df.join(field, list(IJK), "left").withColumn("u0", -F.coalesce("u0", F.lit(target.background)))

    # Where the target is below 0, inside it, the surface moves out; elsewhere it moves in.
    return _moved(g, pushed(scheme), speeds, F.abs("u0"), start, end, stages, scheme, count, track_scheme)
