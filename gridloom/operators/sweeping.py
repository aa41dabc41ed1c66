"""Distances from a surface through a sparse domain: the Eikonal equation |gradient| = 1, solved upwind.

The first layer, voxels next to a crossing, has distances from linear interpolation and stays. All others take the
solution of Godunov's quadratic from the least neighbour on each axis. That system has one solution, whatever the order
of the updates, and values only fall on the way to it.

Voxels are held by blocks of ``SIDE`` cubed, one row each, with the values of the voxels around a block as they were
last heard of. A block updates its voxels until nothing changes in it, and tells a neighbour what has changed on the face
between them. In the next round only blocks that were told something compute again; the others' rows are passed on as
they are. So a front crosses a block, not a voxel, in a round, and what can't change isn't computed. Rounds are written to
the shared folder, so a lost executor repeats its tasks only. Blocks are dense NumPy arrays inside a task: 18 cubed
numbers, whatever the grid's size.

A field that is carried along (``carried``) stays constant along the gradient: a voxel's value is that of the neighbours
which its distance came from, weighed by how much nearer they are. Signs are carried the same way, from the nearest one.

Defined results: voxels of the domain that no way leads to take the largest (or least) distance that was found; with no
surface at all, all are infinite. Inactive voxels are no part of the domain, but their values tell where the surface
crosses. Beside a density a missing voxel has the background; beside a level set's band it is on the band's own side, as
a band's outer and inner borders aren't its surface. A voxel at the value of the surface is at distance 0. Grids without
rows stay so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid
from gridloom.operators.stencil import FACES, axis, dilate, gather, name
from gridloom.operators.tree import _forget, _written
from gridloom.workers import ready, small_batches

BITS = 4
SIDE = 1 << BITS
EDGE = SIDE + 2  # with the voxels around
ROWS = 64  # blocks of an Arrow batch
FREE, FIXED, AROUND = 0, 1, 2
BLOCK = "bi int, bj int, bk int, at array<int>, d array<double>, s array<double>, e array<double>, kind array<int>"
SENT = "bi int, bj int, bk int, at array<int>, d array<double>, s array<double>, e array<double>"


def godunov(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Upwind solution of |gradient| = 1 from the least neighbours on each axis, sorted a <= b <= c."""
    with np.errstate(invalid="ignore", over="ignore"):
        one = a + 1
        two = (a + b + np.sqrt(np.maximum(2 - (a - b) ** 2, 0))) / 2
        total = a + b + c
        three = (total + np.sqrt(np.maximum(total * total - 3 * (a * a + b * b + c * c - 1), 0))) / 3
        return np.where(one <= b, one, np.where(two <= c, two, three))


def _sides(x: np.ndarray) -> list[np.ndarray]:
    """What stands before and after the inner cells on each axis."""
    inner = slice(1, -1)
    return [x[tuple(slice(0, -2) if m == n and low else slice(2, None) if m == n else inner for m in range(3))] for n in range(3) for low in (True, False)]


def relax(d: np.ndarray, s: np.ndarray, e: np.ndarray, free: np.ndarray) -> None:
    """Solve a block in place; ``free`` tells which inner cells may change. Cells outside the domain are infinite."""
    inner = d[1:-1, 1:-1, 1:-1]
    while True:
        x = _sides(d)
        least = np.sort(np.stack([np.minimum(x[n], x[n + 1]) for n in (0, 2, 4)]), axis=0)
        new = godunov(*least)
        lower = free & (new < inner)
        if not lower.any():
            break
        inner[lower] = new[lower]
    known = free & np.isfinite(inner)
    if not known.any():
        return
    x = np.stack(_sides(d))
    # Of the two neighbours on an axis the lesser counts, if it is nearer than the voxel itself.
    pick = np.stack([np.where(x[n] <= x[n + 1], n, n + 1) for n in (0, 2, 4)])
    with np.errstate(invalid="ignore"):
        weight = np.maximum(inner - np.take_along_axis(x, pick, 0), 0)
    weight[~np.isfinite(weight)] = 0
    total = weight.sum(0)
    nearest = x.argmin(0)[None]
    es, ss = e[1:-1, 1:-1, 1:-1], s[1:-1, 1:-1, 1:-1]
    while True:
        with np.errstate(invalid="ignore", divide="ignore"):
            carried = (weight * np.take_along_axis(np.stack(_sides(e)), pick, 0)).sum(0) / total
        sign = np.take_along_axis(np.stack(_sides(s)), nearest, 0)[0]
        differs = known & (((carried != es) & (total > 0)) | (sign != ss))
        if not differs.any():
            break
        take = known & (total > 0)
        es[take] = carried[take]
        ss[known] = sign[known]


def _worked(batches):
    """Blocks after their voxels are solved with what they were told, and what they tell others."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            d, s, e = (np.full(EDGE**3, v) for v in (np.inf, 0.0, 0.0))
            kind = np.full(EDGE**3, -1)
            at = np.array(row["at"])
            d[at], s[at], e[at], kind[at] = row["d"], row["s"], row["e"], row["kind"]
            first = not row["told"]
            for x in row["told"] or []:
                where = np.array(x["at"])
                d[where], s[where], e[where], kind[where] = x["d"], x["s"], x["e"], AROUND
            before = (d.copy(), s.copy(), e.copy())
            cube = (EDGE,) * 3
            free = np.argwhere(kind.reshape(cube) == FREE)
            if len(free):  # only the box of the voxels that may change, and those around it
                box = tuple(slice(low - 1, high + 2) for low, high in zip(free.min(0), free.max(0)))
                relax(*(x.reshape(cube)[box] for x in (d, s, e)), kind.reshape(cube)[box][1:-1, 1:-1, 1:-1] == FREE)
            changed = np.isfinite(d) if first else (d != before[0]) | (s != before[1]) | (e != before[2])
            changed = (changed & (kind >= 0) & (kind != AROUND)).reshape(cube)
            told = []
            for n, step in ((n, step) for n in range(3) for step in (-1, 1)):
                face = [slice(1, -1)] * 3
                face[n] = slice(1, 2) if step < 0 else slice(SIDE, SIDE + 1)
                where = np.argwhere(changed[tuple(face)])
                if len(where):
                    own = where + [f.start for f in face]
                    place = own.copy()
                    place[:, n] = EDGE - 1 if step < 0 else 0
                    own, place = (np.ravel_multi_index(p.T, cube) for p in (own, place))
                    key = [row[b] + step * (m == n) for m, b in enumerate(("bi", "bj", "bk"))]
                    told.append({"bi": key[0], "bj": key[1], "bk": key[2], "at": place.tolist(), "d": d[own].tolist(), "s": s[own].tolist(), "e": e[own].tolist()})
            at = np.flatnonzero(kind >= 0)
            rows.append({"bi": row["bi"], "bj": row["bj"], "bk": row["bk"], "at": at.tolist(), "d": d[at].tolist(), "s": s[at].tolist(), "e": e[at].tolist(), "kind": kind[at].tolist(), "out": told})
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_VALUES = [(n, pa.list_(pa.float64())) for n in ("d", "s", "e")]
_KEY = [(b, pa.int32()) for b in ("bi", "bj", "bk")]
_SCHEMA = pa.schema([*_KEY, ("at", pa.list_(pa.int32())), *_VALUES, ("kind", pa.list_(pa.int32())), ("out", pa.list_(pa.struct([*_KEY, ("at", pa.list_(pa.int32())), *_VALUES])))])
KEY = ["bi", "bj", "bk"]


def solved(cells: DataFrame) -> DataFrame:
    """(i, j, k, d, s, e) for cells (i, j, k, d, s, e): null distances are found, with what is carried along."""
    spark = cells.sparkSession
    ready(spark)
    place = reduce(lambda a, c: a * EDGE + (F.col(c).bitwiseAND(SIDE - 1) + 1), IJK, F.lit(0))
    rows = cells.select(*[F.shiftright(c, BITS).alias(b) for c, b in zip(IJK, KEY)], F.struct(place.alias("at"), F.coalesce("d", F.lit(float("inf"))).alias("d"), F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("e", F.lit(0.0)).alias("e"), F.when(F.col("d").isNull(), FREE).otherwise(FIXED).alias("kind")).alias("x"))
    blocks = rows.groupBy(*KEY).agg(F.collect_list("x").alias("x"))  # at most SIDE cubed
    blocks = blocks.select(*KEY, *[F.col(f"x.{c}").alias(c) for c in ("at", "d", "s", "e", "kind")])
    nothing = F.lit(None).cast(f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in SENT.split(', ')[3:])}>>")
    out = f"{BLOCK}, out array<struct<{', '.join(c.replace(' ', ': ', 1) for c in SENT.split(', '))}>>"
    with small_batches(spark, ROWS):
        state = _written(blocks.withColumn("told", nothing).mapInArrow(_worked, out))
        while True:
            told = state.select(F.inline("out")).groupBy(*KEY).agg(F.collect_list(F.struct("at", "d", "s", "e")).alias("told"))  # at most six
            told = _written(told.join(state.select(*KEY), KEY, "left_semi"))
            if told.isEmpty():
                _forget(told)
                break
            old = state.drop("out")
            again = old.join(told, KEY).mapInArrow(_worked, out)
            rest = old.join(told.select(*KEY), KEY, "left_anti").withColumn("out", F.array().cast(out.rpartition(" out ")[2]))
            before, state = state, _written(again.unionByName(rest))
            _forget(before)
            _forget(told)
    cell = state.select(*KEY, F.inline(F.arrays_zip("at", "d", "s", "e", "kind"))).where(F.col("kind") != AROUND)
    at = F.col("at")
    inside = [F.floor(at / EDGE**2), F.floor(at / EDGE) % EDGE, at % EDGE]
    return cell.select(*[(F.shiftleft(b, BITS) + x - 1).cast("int").alias(c) for c, b, x in zip(IJK, KEY, inside)], "d", "s", "e")


def crossings(g: Grid, iso: float, field: Callable[[Column, Column, Column], Column] | None = None, fog: bool = False) -> DataFrame:
    """(i, j, k, value, d, e) of active voxels: the distance of those next to the surface, else null, and the mean of a
    field of positions at their crossings, by the square of their nearness."""
    rows = gather(Grid(g.df, g.background if fog else None), FACES)
    less = F.col("value") < iso
    delta = F.col("value") - iso
    spans, fields = [], []
    for n in range(3):
        ways = []
        for step in (-1, 1):
            other = F.col(name(axis(n, step)))
            t = F.when(less != (F.coalesce(other, "value") < iso), F.abs(delta / (F.col("value") - other)))
            ways.append(F.when(t.isNotNull(), F.struct(t.alias("t"), F.lit(step).alias("step"))))
        best = F.least(*ways)
        spans.append(best["t"].alias(f"t{n}"))
        fields.append(best["step"].alias(f"step{n}"))
    rows = rows.select(*IJK, "value", *spans, *fields)
    on = F.coalesce(*[F.col(f"t{n}") for n in range(3)]).isNotNull()
    weight = [F.coalesce(F.try_divide(F.lit(1.0), F.col(f"t{n}") * F.col(f"t{n}")), F.lit(0.0)) for n in range(3)]
    total = reduce(Column.__add__, weight)
    d = F.when(on, F.when(F.abs(delta) < 1e-8, 0.0).otherwise(F.try_divide(F.lit(1.0), F.sqrt(total))))
    e = F.lit(None).cast("double")
    if field is not None:
        at = [F.col(c).cast("double") for c in IJK]
        there = [field(*[at[m] + F.col(f"step{n}") * F.col(f"t{n}") if m == n else at[m] for m in range(3)]) for n in range(3)]
        mean = F.try_divide(reduce(Column.__add__, [F.when(w > 0, w * v).otherwise(0.0) for w, v in zip(weight, there)]), total)
        e = F.when(on, F.when(F.abs(delta) < 1e-8, field(*at)).otherwise(mean))
    return rows.select(*IJK, "value", d.alias("d"), e.alias("e"))


def _signed(rows: DataFrame, background: float) -> Grid:
    """Grid of (i, j, k, d, s): what wasn't reached takes the extremes of what was."""
    far = rows.where(~F.isnan("d") & (F.col("d") != float("inf"))).agg(F.min(F.col("d") * F.col("s")), F.max(F.col("d") * F.col("s"))).first()
    low, high = (x if x is not None else sign * float("inf") for x, sign in zip(far, (-1, 1)))
    value = F.when(F.col("d") == float("inf"), F.when(F.col("s") < 0, low).otherwise(high)).otherwise(F.col("d") * F.col("s"))
    return Grid(rows.select(*IJK, (value + 0.0).alias("value"), F.lit(True).alias("active")), background)


def _swept(g: Grid, iso: float, above: float, field=None) -> DataFrame:
    """(i, j, k, d, s, e) of the active voxels; ``above`` is the sign of values over iso."""
    start = _written(crossings(g, iso, field, above < 0).withColumn("s", F.when(F.col("value") > iso, above).otherwise(-above)))
    found = solved(start.select(*IJK, "d", "s", "e"))
    # Signs are known from the values here; only those of new voxels are carried.
    return found.drop("s").join(start.select(*IJK, "s"), list(IJK))


def _background(g: Grid) -> float:
    return abs(g.background) or 1.0


def sdf_to_sdf(g: Grid, iso: float = 0.0) -> Grid:
    """True distances from the surface at ``iso`` of an approximate level set, positive where it is above."""
    return _signed(_swept(g, iso, 1.0), _background(g))


def fog_to_sdf(g: Grid, iso: float) -> Grid:
    """Distances from the surface at ``iso`` of a density, negative where it is above."""
    return _signed(_swept(g, iso, -1.0), _background(g))


def extension(g: Grid, iso: float, field: Callable[[Column, Column, Column], Column], fog: bool = False, side: int = 0, default: Grid | None = None, background: float = 0.0) -> tuple[Grid, Grid]:
    """The distances, and a field of positions at the surface carried along the gradient to all active voxels.

    ``side`` 1 or -1 carries it only to where values are above or below iso; elsewhere ``default`` holds. Voxels that
    aren't reached take the background.
    """
    rows = _written(_swept(g, iso, -1.0 if fog else 1.0, field))
    value = F.when(F.col("d") == float("inf"), F.lit(background)).otherwise(F.col("e"))
    ext = rows.select(*IJK, value.alias("value"), "s", F.lit(True).alias("active"))
    if side:
        where = F.col("s") * (-1 if fog else 1) * side > 0
        other = (default.df if default else g.df.where("false")).select(*IJK, F.col("value").alias("other"))
        ext = ext.join(other, list(IJK), "left").withColumn("value", F.when(where, F.col("value")).otherwise(F.coalesce("other", F.lit(default.background if default else background))))
    return _signed(rows, _background(g)), Grid(ext.select(*IJK, "value", "active"), background)


def masked(g: Grid, mask: Grid, side: int = 0) -> Grid:
    """A level set extended into the active voxels of a mask; its own values stay. ``side`` 1 or -1: only outwards or inwards."""
    own = g.on.select(*IJK, F.abs("value").alias("d"), F.when(F.col("value") < 0, -1.0).otherwise(1.0).alias("s"))
    new = mask.on.select(*IJK).join(own, list(IJK), "left_anti").select(*IJK, F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("s"))
    rows = _written(own.unionByName(new).withColumn("e", F.lit(None).cast("double")))
    found = solved(rows)
    if side:
        kept = rows.where("d is not null").select(*IJK, F.lit(True).alias("kept"))
        found = found.join(kept, list(IJK), "left").where(F.coalesce("kept", F.lit(False)) | (F.col("s") * side > 0))
    # Nothing says on which side unreached voxels are; they are outside.
    return _signed(found.withColumn("s", F.when(F.col("s") < 0, -1.0).otherwise(1.0)), g.background)


def dilated(g: Grid, steps: int, near: int = 6, side: int = 0) -> Grid:
    """A level set whose band is wider by a number of voxels, in both directions or one; the background grows with it."""
    wide = dilate(Grid(g.on, g.background), near, steps)
    return Grid(masked(g, wide, side).df, g.background + steps)
