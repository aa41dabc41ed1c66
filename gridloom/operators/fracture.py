"""Solids broken into pieces by copies of a cutter.

Pieces are rows (piece, i, j, k, value, cut) of many level sets in one table. A copy of the cutter takes from each piece
that it meets the part inside itself as a new piece, named after the old one and the copy's number, and the old piece
keeps the rest. A voxel near a cut is in the bands of both, but inside of one only, so volumes of pieces add up.

Copies whose boxes don't meet cut in the same round: none changes what another finds. So the rounds follow from how
copies overlap, not from how many there are, and each is one join of all pieces with the copies' voxels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid
from gridloom.operators.rays import transformed
from gridloom.operators.tree import _forget, _written, segments

Place = tuple[float, float, float]
#: Parts of fewer voxels, or with none inside, are not cut off, and a piece isn't cut down to such a rest.
FEWEST = 27


def rounds(boxes: list[tuple[Place, Place]]) -> list[list[int]]:
    """Copies by number for each round: one that meets an earlier copy's box is in a later round than it."""
    when: list[int] = []
    for n, (low, high) in enumerate(boxes):
        met = [when[m] for m in range(n) if all(low[x] <= boxes[m][1][x] and boxes[m][0][x] <= high[x] for x in range(3))]
        when.append(max(met) + 1 if met else 0)
    return [[n for n, w in enumerate(when) if w == turn] for turn in range(max(when, default=-1) + 1)]


def _box(g: Grid) -> tuple[Place, Place] | None:
    found = g.df.agg(*[F.min(c).alias(f"l{c}") for c in IJK], *[F.max(c).alias(f"h{c}") for c in IJK]).first()
    return None if found[0] is None else (tuple(found[:3]), tuple(found[3:]))


def _copies(cutter: Grid, places: list[Place], turns: list[list[list[float]]] | None) -> list[tuple[list[int], DataFrame]]:
    """For each round its copies' numbers and their voxels (n, i, j, k, by)."""
    if turns is None:
        box = _box(cutter)
        if box is None:
            return []
        moves = [tuple(round(x) for x in p) for p in places]
        boxes = [tuple(tuple(e + m for e, m in zip(end, move)) for end in box) for move in moves]
        out = []
        for numbers in rounds(boxes):
            sent = F.inline(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(m).alias(f"d{c}") for c, m in zip(IJK, moves[n])]) for n in numbers]))
            out.append((numbers, cutter.df.select(*IJK, "value", sent).select("n", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK], F.col("value").alias("by"))))
        return out
    grids = [transformed(cutter, m, p) for m, p in zip(turns, places)]
    grids = [g.with_df(_written(g.df)) for g in grids]
    found = [(n, g, b) for n, g in enumerate(grids) if (b := _box(g)) is not None]
    out = []
    for numbers in rounds([b for _, _, b in found]):
        parts = [found[m][1].df.select(F.lit(found[m][0]).alias("n"), *IJK, F.col("value").alias("by")) for m in numbers]
        out.append(([found[m][0] for m in numbers], reduce(DataFrame.unionByName, parts)))
    return out


def fractured(pieces: DataFrame, cutter: Grid, places: list[Place], half: float, turns: list[list[list[float]]] | None = None, overlap: bool = True) -> DataFrame:
    """(piece, i, j, k, value, cut): pieces (piece, i, j, k, value[, cut]) after all copies of the cutter have cut.

    Copies stand at ``places``, to the nearest voxel, or are turned by the matrices ``turns`` about the cutter's origin
    and sampled. Level sets need rows for all voxels inside; those at or beyond ``half`` outside have none. ``cut`` tells
    new pieces from rests; without ``overlap`` new ones are not cut again.
    """
    state = _written(pieces.select("piece", *IJK, "value", F.col("cut") if "cut" in pieces.columns else F.lit(False).alias("cut")).where(F.col("value") < half))
    for _, copies in _copies(cutter, places, turns):
        met = state.join(copies, list(IJK), "left").withColumn("n", F.when(F.col("cut") & F.lit(not overlap), None).otherwise(F.col("n")))
        met = _written(met.withColumns({"inner": F.greatest("value", "by"), "outer": F.greatest("value", -F.col("by"))}))
        whole = lambda v: (F.count(F.when(F.col(v) < half, 1)) >= FEWEST) & (F.min(v) < 0)
        good = _written(met.where("n is not null").groupBy("piece", "n").agg(whole("inner").alias("good")).where("good").select("piece", "n"))
        # What is left of a piece if all its good parts go; else the last of them stays with it.
        kept = met.join(good.select("piece", "n", F.lit(True).alias("goes")), ["piece", "n"], "left").withColumn("rest", F.when(F.col("goes"), F.col("outer")).otherwise(F.col("value")))
        rests = kept.groupBy("piece").agg(whole("rest").alias("whole"), F.max(F.when(F.col("goes"), F.col("n"))).alias("last")).where("last is not null")
        stay = _written(rests.where(~F.col("whole")).select("piece", F.col("last").alias("n")))
        goes = good.join(stay, ["piece", "n"], "left_anti").select("piece", "n", F.lit(True).alias("goes"))
        told = met.join(goes, ["piece", "n"], "left")
        new = F.struct(F.concat_ws("/", "piece", F.col("n").cast("string")).alias("piece"), F.col("inner").alias("value"), F.lit(True).alias("cut"))
        old = F.struct("piece", F.when(F.col("goes"), F.col("outer")).otherwise(F.col("value")).alias("value"), F.col("cut"))
        before, state = state, _written(told.select(*IJK, F.explode(F.when(F.col("goes"), F.array(old, new)).otherwise(F.array(old))).alias("_p")).select("_p.piece", *IJK, "_p.value", "_p.cut").where(F.col("value") < half))
        for t in (before, met, good, stay):
            _forget(t)
    return state


def parted(pieces: DataFrame, near: int = 6) -> DataFrame:
    """(piece, i, j, k, si, sj, sk, n): voxels inside each piece with the connected part they are in, named by its least voxel.

    Pieces that touch stay apart. Voxels outside, whose value is not below 0, are in no part.
    """
    inside = pieces.where("value < 0").select("piece", *IJK, "value", F.lit(True).alias("active"))
    return segments(Grid(inside), near, ("piece",))
