"""Principal axes of each point's neighbourhood, and level sets of the ellipsoids that they make of points.

A neighbour at a distance d within the radius R weighs 1 - (d / R)^3, the point itself 1. Its neighbourhood's weighted
mean and covariance are sums over pairs of near places, so repeated points count once as a place with their number. Pairs
are the matrices of chunks that meet in a task, which sends sums only; their number grows with the square of a
neighbourhood's places, what is shuffled and held with the places. Axes are the eigenvectors of the covariance by Jacobi's rotations, all in columns.
Stretches are its eigenvalues, none below the largest times ``ratio``, scaled to a product of 1: an ellipsoid has the
volume of the point's sphere.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gridloom.model import IJK, Grid
from gridloom.operators.band import Stages, staged
from gridloom.operators.points import P
from gridloom.operators.tiles import KEY, TILES, chunked, finite, matrix, tiled, values
from gridloom.operators.tree import _written
from gridloom.workers import small_batches

PAIRS = [(p, q) for p in range(3) for q in range(p, 3)]
#: Each sweep squares the share of the matrix off its diagonal; after five it is below the rounding.
SWEEPS = 5


def eigen(sweeps: int = SWEEPS) -> Stages:
    """From a symmetric matrix a00 ... a22: eigenvalues e0 >= e1 >= e2, and u00 ... u22, whose columns are unit eigenvectors."""
    a = {(p, q): f"a{p}{q}" for p, q in PAIRS}
    v = {(p, q): f"cast({int(p == q)} as double)" for p in range(3) for q in range(3)}
    entry = lambda p, q: a[min(p, q), max(p, q)]
    stages: Stages = []
    for n in range(3 * sweeps):
        p, q = ((0, 1), (0, 2), (1, 2))[n % 3]
        k = 3 - p - q
        stages.append({f"h{n}": f"({a[q, q]} - {a[p, p]}) / nullif(2 * {a[p, q]}, 0)"})
        stages.append({f"t{n}": f"coalesce((case when h{n} < 0 then -1 else 1 end) / (abs(h{n}) + sqrt(h{n} * h{n} + 1)), cast(0 as double))"})
        stages.append({f"c{n}": f"1 / sqrt(t{n} * t{n} + 1)"})
        c, s = f"c{n}", f"(t{n} * c{n})"
        turned = {f"d{n}": f"{a[p, p]} - t{n} * {a[p, q]}", f"f{n}": f"{a[q, q]} + t{n} * {a[p, q]}"}
        turned |= {f"k{n}": f"{c} * {entry(k, p)} - {s} * {entry(k, q)}", f"l{n}": f"{s} * {entry(k, p)} + {c} * {entry(k, q)}"}
        turned |= {f"v{r}_{n}": f"{c} * {v[r, p]} - {s} * {v[r, q]}" for r in range(3)} | {f"w{r}_{n}": f"{s} * {v[r, p]} + {c} * {v[r, q]}" for r in range(3)}
        stages.append(turned)
        a |= {(p, p): f"d{n}", (q, q): f"f{n}", (p, q): "cast(0 as double)", (min(k, p), max(k, p)): f"k{n}", (min(k, q), max(k, q)): f"l{n}"}
        v |= {(r, p): f"v{r}_{n}" for r in range(3)} | {(r, q): f"w{r}_{n}" for r in range(3)}
    x, y, z = a[0, 0], a[1, 1], a[2, 2]
    stages.append({"o0": f"case when {x} >= {y} and {x} >= {z} then 0 when {y} >= {z} then 1 else 2 end", "o2": f"case when {z} <= {x} and {z} <= {y} then 2 when {y} <= {x} then 1 else 0 end"})
    stages.append({"o1": "3 - o0 - o2"})
    pick = lambda n, of: f"case o{n} when 0 then {of[0]} when 1 then {of[1]} else {of[2]} end"
    stages.append({f"e{n}": pick(n, (x, y, z)) for n in range(3)} | {f"u{r}{n}": pick(n, [v[r, m] for m in range(3)]) for r in range(3) for n in range(3)})
    return stages


def shaped(ratio: float, stretch: float, threshold: int) -> Stages:
    """From sums n, w, w0 ... w2, w00 ... w22 of a neighbourhood, about its point: mean m0 ... m2, stretches s0 ... s2 and axes u00 ... u22.

    Fewer than ``threshold`` points give no axes (nor does a threshold of 0), but equal stretches; coincident ones a sphere.
    """
    mean = {f"m{p}": f"w{p} / w" for p in range(3)}
    spread = {f"a{p}{q}": f"w{p}{q} / w - m{p} * m{q}" for p, q in PAIRS}
    least = {"g0": "e0", **{f"g{n}": f"greatest(e{n}, e0 * {ratio!r})" for n in (1, 2)}}
    flat = {"none": "e0 <= cast(1e-11 as double)", "few": f"n < {threshold} or {threshold} = 0"}
    size = {"size": "power(case when none then cast(1 as double) else g0 * g1 * g2 end, cast(1 as double) / 3)"}
    lengths = {f"s{n}": f"case when few then cast({stretch!r} as double) when none then cast(1 as double) else g{n} / size end" for n in range(3)}
    axes = {f"x{r}{n}": f"case when few or none then cast({int(r == n)} as double) else u{r}{n} end" for r in range(3) for n in range(3)}
    return [mean, spread, *eigen(), {**least, **flat}, size, {**lengths, **axes}]


#: Sums over a point's neighbours: their number, weights, and weighted first and second moments about the point.
SUMS = ["n", "w", *[f"w{p}" for p in range(3)], *[f"w{p}{q}" for p, q in PAIRS]]


def _summed(batches, radius: float):
    """Sums of each place of a chunk over the places of its tiles that came one after another."""
    chunk, at, sums = None, None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(x)) for x in (*at.T, *sums)], names=[*P, *SUMS])

    for batch in batches:
        for row in range(batch.num_rows):
            number = batch.column("chunk")[row].as_py()
            if number != chunk:
                if chunk is not None:
                    yield told()
                chunk, at = number, matrix(batch, list(P), row)
                sums = np.zeros((len(SUMS), len(at)))
            others, many = matrix(batch, [f"o{p}" for p in P], row), values(batch, "omany", row).astype(float)
            d = [others[None, :, p] - at[:, p, None] for p in range(3)]
            away = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
            near = away <= radius
            if not near.any():
                continue
            share = away / radius
            weight = np.where(near, (1.0 - share * share * share) * many, 0.0)
            firsts = [weight * x for x in d]
            parts = [near @ many, weight.sum(1), *[x.sum(1) for x in firsts], *[np.einsum("ij,ij->i", firsts[p], d[q]) for p, q in PAIRS]]
            sums += np.stack(parts)
    if chunk is not None:
        yield told()


def local_axes(points: DataFrame, radius: float, ratio: float = 0.25, stretch: float = 1.0, threshold: int = 20, average: float = 1.0) -> DataFrame:
    """Points with their neighbourhood's size n (they count, too), qx, qy, qz, s0 ... s2 and u00 ... u22.

    q is the point moved by the share ``average`` towards the weighted mean. The columns of u are the axes of the stretches, the
    longest first. Points with a null or non-finite coordinate have no neighbourhood: n is 0, q and the axes are null.
    """
    clean = points.where(finite(list(P)))
    places = _written(clean.groupBy(*[(F.col(p).cast("double") + 0.0).alias(p) for p in P]).agg(F.count(F.lit(1)).alias("many")))
    chunks = chunked(places, list(P), radius, [F.xxhash64(*P)])
    others = chunks.select(*KEY, *[F.col(p).alias(f"o{p}") for p in P], F.col("many").alias("omany"))
    numbers = ArrayType(DoubleType())
    lists = StructType([StructField(c, numbers) for c in (*P, *SUMS)])
    with small_batches(points.sparkSession, TILES):
        met = _written(tiled(chunks.drop("many"), others).mapInArrow(partial(_summed, radius=radius), lists))
    each = met.select(F.inline(F.arrays_zip(*P, *SUMS)))
    sums = each.groupBy(*P).agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in SUMS[1:]])
    shapes = staged(sums, shaped(ratio, stretch, threshold))
    axes = [F.col(f"x{r}{n}").alias(f"u{r}{n}") for r in range(3) for n in range(3)]
    moved = [(F.col(p) + F.col(f"m{n}") * average).alias(f"q{p[1]}") for n, p in enumerate(P)]
    told = shapes.select(*[F.col(p).alias(f"_{p}") for p in P], "n", *moved, *[f"s{n}" for n in range(3)], *axes)
    found = points.join(told, [(F.col(p) + 0.0) == F.col(f"_{p}") for p in P], "left").drop(*[f"_{p}" for p in P])
    return found.withColumn("n", F.coalesce("n", F.lit(0)))


def distance() -> Stages:
    """From a voxel's place d0 ... d2 about an ellipsoid of the radius ``r``: its distance ``value``, of first order.

    With |Mx| = 1 on the ellipsoid, it is (|Mx| - 1) over the slope of |Mx|; in the middle minus the shortest half axis.
    """
    inverse = {f"b{p}{q}": " + ".join(f"u{p}{n} * u{q}{n} / (s{n} * s{n})" for n in range(3)) for p, q in PAIRS}
    across = {f"y{p}": "(" + " + ".join(f"b{min(p, q)}{max(p, q)} * d{q}" for q in range(3)) + ") / (r * r)" for p in range(3)}
    lengths = {"k1": f"sqrt(greatest({' + '.join(f'd{p} * y{p}' for p in range(3))}, cast(0 as double)))", "k2": "sqrt(y0 * y0 + y1 * y1 + y2 * y2)"}
    return [inverse, across, lengths, {"value": "coalesce(k1 * (k1 - 1) / nullif(k2, 0), -r * least(s0, s1, s2))"}]


def ellipsoids(points: DataFrame, radius: Column, half: float = 3.0) -> Grid:
    """Narrow band of the union of the ellipsoids of points as :func:`local_axes` gives them.

    A point's rows are the box of its ellipsoid, ``half`` wider on each side. Points without axes give none.
    """
    shape = [f"q{a}" for a in "xyz"] + [f"s{n}" for n in range(3)] + [f"u{r}{n}" for r in range(3) for n in range(3)]
    rows = points.where("qx is not null").select(*shape, radius.cast("double").alias("r")).where("r > 0")
    for m, (c, a) in enumerate(zip(IJK, "xyz")):
        reach = F.col("r") * F.sqrt(reduce(Column.__add__, [F.col(f"u{m}{n}") * F.col(f"s{n}") * F.col(f"u{m}{n}") * F.col(f"s{n}") for n in range(3)])) + half
        rows = rows.withColumn(c, F.explode(F.sequence(F.ceil(F.col(f"q{a}") - reach).cast("int"), F.floor(F.col(f"q{a}") + reach).cast("int")))).withColumn(f"d{m}", F.col(c) - F.col(f"q{a}"))
    band = staged(rows, distance()).groupBy(*IJK).agg(F.min("value").alias("value")).where(F.abs("value") < half)
    return Grid(band.withColumn("active", F.lit(True)), half)
