"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: sources share ``share`` times all words by weight; none gets more than ``epochs`` times its own. What a
clamped source leaves is shared by the others in proportion to their weights, until none is above its cap. That
has one solution, min(cap, level * weight). Sorted by cap / weight, the clamped sources come first, so running
sums over the list of sources give the level without a loop. This list has a row for each source: it is a
mixture's configuration, not data, and is the only thing that meets in one task.

Sampling: a document is taken floor(target / size of its source) times, and once more if the seeded order of its
source reaches it before the rest of the target is used up. The order is md5(seed:doc_id). Running sums over it
would bring a source together in one task, so they are made in two steps: over 4096 slices of the order that are
summed first, then inside the one slice in which the target ends. The document that ends nearest to what is then
still missing is added if that brings the source nearer to its target. Only whole documents are taken.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0 and are taken 0 words; a null
source is a source of its own, last in order; empty tables give no rows; rows with equal doc_id have equal places in
the order, so they are taken together; extra columns aren't read by :func:`plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, cut, fresh, table

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED, DIGITS = 1.5, 2, "mix", 3  # 16 ** DIGITS slices of a source's order


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, place): words of each document, and its place in the seeded order."""
    return docs.select(
        F.col("`doc_id`").alias("doc_id"),
        F.col("`source`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("`text`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")))).alias("place"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target): one row for each source."""
    every = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("double")
    known = every.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * epochs)
    all_ = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = known.select(
        "*",
        (F.sum("source_size").over(all_).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("among"),
    )
    clamped = rest.withColumn("clamped", F.col("cap") * F.col("among") <= F.col("weight") * F.col("left"))
    free_left = F.min(F.when(~F.col("clamped"), F.struct((-F.col("among")).alias("n"), F.col("left").alias("v")))).over(all_)
    level = clamped.withColumn("free", free_left)
    return level.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("free")["v"] * F.col("weight") / -F.col("free")["n"]).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for each row of (doc_id, text, source)."""
    sized = cut(sizes(docs, seed))
    goal = targets(sized, weights, share, epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = cut(goal.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))

    # What each slice of a source's order begins with; the slices are few, the documents many.
    part = F.substring("place", 1, DIGITS)
    slices = sized.groupBy("source", part.alias("slice")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = _with(starts, goal, "need")
    # The slice in which the need ends: those before it are taken whole, those after it aren't taken.
    last = ends.where((F.col("start") <= F.col("need")) & (F.col("start") + F.col("words") > F.col("need")))
    last = cut(last.select("source", "slice", "start", "need"))
    edge = _with(sized.withColumn("slice", part), last, "slice", "start", "need", own="edge_").where(F.col("slice") == F.col("edge_slice"))
    within = Window.partitionBy("source").orderBy("place")
    run = edge.select("source", "place", "size", "edge_start", "edge_need", (F.col("edge_start") + F.sum("size").over(within)).alias("end"))
    fits = run.where(F.col("end") <= F.col("edge_need")).groupBy("source").agg(F.max("place").alias("up_to"), F.max("end").alias("reached"))
    limits = _with(goal, last, "slice", "start", own="edge_", how="left")
    limits = _with(limits, fits, "up_to", "reached", own="fit_", how="left")
    limits = cut(
        limits.select(
            "source", "source_size", "target", "whole", "need", "edge_slice", F.coalesce("fit_up_to", F.concat("edge_slice", F.lit(" "))).alias("up_to"),
            (F.col("need") - F.coalesce("fit_reached", "edge_start")).alias("missing"),
        )
    )
    joined = _with(sized, limits, "source_size", "target", "whole", "need", "edge_slice", "up_to", "missing", own="")
    # Without an edge the need is 0 (nothing more is taken) or the whole source.
    in_order = F.when(F.col("edge_slice").isNull(), (F.col("need") > 0) & (F.col("need") >= F.col("source_size"))).otherwise((F.substring("place", 1, DIGITS) < F.col("edge_slice")) | (F.col("place") <= F.col("up_to")))
    chosen = joined.withColumn("more", F.coalesce((F.col("need") > 0) & in_order, F.lit(False)))
    off = F.abs(F.col("size") - F.col("missing"))
    nearest = chosen.where(~F.col("more") & F.col("edge_slice").isNotNull() & (off < F.col("missing"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("place"))).alias("best"))
    nearest = nearest.select("source", F.col("best")["place"].alias("place"))
    done = _with(chosen, nearest, "place", own="added_", how="left")
    copies = F.col("whole") + F.when(F.col("more") | F.coalesce(F.col("place") == F.col("added_place"), F.lit(False)), 1).otherwise(0)
    return done.select("doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _with(rows: DataFrame, of: DataFrame, *names: str, own: str = "", how: str = "inner") -> DataFrame:
    """rows with columns of a table that has one row for each source; null is a source."""
    right = of.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), *[F.col(n).alias(own + n) for n in names])
    return rows.withColumns({"_s": F.coalesce("source", F.lit("")), "_n": F.col("source").isNull()}).join(right, ["_s", "_n"], how).drop("_s", "_n")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, each as often as the plan takes it."""
    # Rows with equal doc_id and source have equal places, so equal copies.
    key, source, copies, copy = (fresh(docs, n) for n in ("_id", "_source", "_copies", "_copy"))
    wanted = plan(docs, **options).where("copies > 0").select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("copies").alias(copies)).distinct()
    taken = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col(key)) & docs["source"].cast("string").eqNullSafe(F.col(source)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, source, copies, copy)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the production weights."""
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) as place from documents),
every as (select source, sum(size) as source_size from sized group by source),
known as (
  select *, cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight,
    cast(source_size as double) * 2 as cap from every),
rest as (
  select *, cast(sum(source_size) over () as double) * 1.5 - coalesce(sum(cap) over w, 0) as rest_words, sum(weight) over () - coalesce(sum(weight) over w, 0) as among
  from known window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
clamp as (select *, cap * among <= weight * rest_words as clamped from rest),
goal as (
  select source, source_size, case when clamped then cap else
    (select arg_max(rest_words, among) from clamp where not clamped) * weight / (select max(among) from clamp where not clamped) end as target from clamp),
need as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from goal),
run as (
  select s.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size as need,
    sum(size) over (partition by s.source order by place) as run_end
  from sized s join need n on s.source is not distinct from n.source),
picked as (select *, need > 0 and run_end <= need as more, need - coalesce(max(case when run_end <= need then run_end end) over (partition by source), 0) as missing from run),
ranked as (
  select *, row_number() over (partition by source order by case when not more and abs(size - missing) < missing and need > 0 then 0 else 1 end, abs(size - missing), place) as r from picked)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
  cast(size * (whole + case when more or (r = 1 and not more and need > 0 and abs(size - missing) < missing) then 1 else 0 end) as bigint) as taken
from ranked
"""
